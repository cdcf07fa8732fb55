"""Risk of wallets and transactions, spread from seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from .iterate import hub_proximity, pagerank


def seed_pagerank(proj: DataFrame, wallets: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(wallet, risk_pagerank): personalised to the seeds over parallel projection edges, scaled by its maximum."""
    ranks = pagerank(proj.select(F.col("src").alias("source"), F.col("dst").alias("target")), wallets.select(F.col("wallet").alias("id")), seeds.select(F.col("wallet").alias("id")), rounds)
    top = ranks.agg(F.max("rank")).first()[0] or 1.0
    return ranks.select(F.col("id").alias("wallet"), (F.col("rank") / top).alias("risk_pagerank"))


def blended(wallets: DataFrame, ppr: DataFrame, proximity: DataFrame, seeds: DataFrame) -> DataFrame:
    """(wallet, risk_pagerank, risk_proximity, hops_to_seed, wallet_risk); seeds have risk 1."""
    near = proximity.select(F.col("id").alias("wallet"), F.col("proximity").alias("risk_proximity"), F.col("hops").alias("hops_to_seed"))
    mark = seeds.select("wallet").distinct().withColumn("_seed", F.lit(True))
    out = wallets.select("wallet").join(ppr, "wallet", "left").join(near, "wallet", "left").join(mark, "wallet", "left").fillna(0.0, ["risk_pagerank", "risk_proximity"])
    mix = F.round(config.RISK_PAGERANK * F.col("risk_pagerank") + config.RISK_PROXIMITY * F.col("risk_proximity"), 6)
    return out.withColumn("wallet_risk", F.when(F.col("_seed"), 1.0).otherwise(mix)).drop("_seed")


def inherit(risk: DataFrame, labels: DataFrame, discount: float = config.INHERIT_DISCOUNT, largest: int = config.INHERIT_MAX) -> DataFrame:
    """risk with a floor from the riskiest wallet of a co-spent cluster that hasn't collapsed into a huge one."""
    of = labels.where("method = 'common_input'").join(risk.select("wallet", "wallet_risk"), "wallet")
    floors = of.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("wallet_risk").alias("top")).where(F.col("n") <= largest).select("cluster_id", (discount * F.col("top")).alias("floor"))
    floor = labels.where("method = 'common_input'").join(floors, "cluster_id").select("wallet", "floor")
    return risk.join(floor, "wallet", "left").withColumn("wallet_risk", F.greatest("wallet_risk", F.coalesce("floor", F.lit(0.0)))).drop("floor")


def transaction_risk(flows: DataFrame, risk: DataFrame, signals: DataFrame, blend: float = config.TX_RISK_BLEND) -> DataFrame:
    """(txid, wallet_max, tx_risk); signals (txid, signal): the largest of its anomaly, peel and mixing scores."""
    top = flows.select("txid", "wallet").distinct().join(risk.select("wallet", "wallet_risk"), "wallet").groupBy("txid").agg(F.max("wallet_risk").alias("wallet_max"))
    mix = blend * F.col("wallet_max") + (1 - blend) * F.coalesce("signal", F.lit(0.0))
    return top.join(signals, "txid", "left").select("txid", "wallet_max", F.round(mix, 6).alias("tx_risk"))


def proximity(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    return hub_proximity(pairs, seeds.select(F.col("wallet").alias("id")))
