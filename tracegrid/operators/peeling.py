"""Peeling chains and mixing transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import array_sum, clamp, pop_cv
from .iterate import settled


def candidates(tx: DataFrame, asymmetry: float = config.PEEL_ASYMMETRY, min_share: float = config.PEEL_MIN_SHARE) -> DataFrame:
    """Transactions of one input and two lopsided outputs, with the output that goes on and the one peeled off."""
    a, b = F.get("output_amounts", 0), F.get("output_amounts", 1)
    first = a >= b
    go = F.when(first, a).otherwise(b)
    peel = F.when(first, b).otherwise(a)
    out = tx.where((F.size("inputs") == 1) & (F.size("outputs") == 2) & (F.size("output_amounts") == 2)).select(
        "txid", "timestamp", F.get("inputs", 0).alias("from_wallet"), F.coalesce(F.get("input_amounts", 0), F.lit(0.0)).alias("input_amount"),
        F.when(first, F.get("outputs", 0)).otherwise(F.get("outputs", 1)).alias("continue_wallet"), F.when(first, F.get("outputs", 1)).otherwise(F.get("outputs", 0)).alias("peel_wallet"),
        go.alias("continue_amount"), peel.alias("peel_amount"),
    )
    total = F.col("continue_amount") + F.col("peel_amount")
    out = out.where(total > 0).withColumn("asymmetry", F.col("continue_amount") / total)
    return out.where((F.col("asymmetry") > asymmetry) & (F.col("peel_amount") > 0) & (F.col("peel_amount") / F.greatest(total, F.lit(1e-9)) >= min_share))


def next_hops(cand: DataFrame, low: float = config.PEEL_MIN_RATIO, high: float = config.PEEL_MAX_RATIO) -> DataFrame:
    """(txid, next_txid): the later candidate that spends the continued output for the nearest amount."""
    n = cand.select(F.col("txid").alias("next_txid"), F.col("timestamp").alias("nt"), F.col("from_wallet").alias("continue_wallet"), F.col("input_amount").alias("na"))
    ratio = F.col("na") / F.col("continue_amount")
    met = cand.join(n, "continue_wallet").where((F.col("nt") > F.col("timestamp")) & (F.col("na") > 0) & (F.col("continue_amount") > 0) & ratio.between(low, high))
    return met.groupBy("txid").agg(F.min(F.struct(F.abs(F.col("na") - F.col("continue_amount")).alias("d"), "nt", "next_txid")).alias("m")).select("txid", "m.next_txid")


def walks(cand: DataFrame, links: DataFrame, max_hops: int = config.PEEL_MAX_HOPS, min_hops: int = config.PEEL_MIN_HOPS) -> DataFrame:
    """(start, txids, length, value): the walk from every candidate along its links, if long enough.

    Time rises along links, so a walk can't meet itself; max_hops - 1 joins of links reach every end.
    """
    step = links.select(F.col("txid").alias("at"), "next_txid")
    w = cand.select(F.col("txid").alias("start"), F.array("txid").alias("txids"), F.col("txid").alias("at"))
    for _ in range(max_hops - 1):
        w = w.join(step, "at", "left").select("start", F.when(F.col("next_txid").isNull(), F.col("txids")).otherwise(F.concat("txids", F.array("next_txid"))).alias("txids"), F.col("next_txid").alias("at"))
    w = w.where(F.size("txids") >= min_hops)
    value = w.select("start", F.explode("txids").alias("txid")).join(cand.select("txid", "continue_amount"), "txid").groupBy("start").agg(F.sum("continue_amount").alias("value"))
    return w.join(value, "start").select("start", "txids", F.size("txids").alias("length"), "value")


def pick_chains(walk_rows: DataFrame) -> DataFrame:
    """Walks that share no transaction, longest first, then by value, then by start.

    Each round takes every walk that is the best at all its transactions and drops the walks it meets; that is
    the same choice as going through all walks in order. The best walk left always wins, so the rounds end when
    no walk is left; a peel chain of n hops, whose walks rank in order, takes about n / 8 rounds.
    """
    rest = settled(walk_rows.withColumn("rank", F.struct(-F.col("length"), -F.col("value"), F.col("start"))))
    out, rounds = None, 0
    while True:
        at = rest.select("start", "rank", F.explode("txids").alias("txid"))
        best = at.groupBy("txid").agg(F.min("rank").alias("best"))
        won = at.join(best, "txid").groupBy("start").agg(F.min((F.col("rank") == F.col("best")).cast("int")).alias("all")).where("all = 1")
        taken, found = settled(rest.join(won.select("start"), "start", "left_semi"), n=F.count(F.lit(1)))
        if not found["n"]:
            break
        out = taken if out is None else out.unionByName(taken)
        rounds += 1
        if rounds % 32 == 0:  # else the plan grows with the rounds
            out = settled(out.coalesce(8))
        used = taken.select(F.explode("txids").alias("txid")).distinct()
        hit = at.join(used, "txid", "left_semi").select("start").distinct()
        rest = settled(rest.join(hit, "start", "left_anti"))
    return (out if out is not None else rest.limit(0)).drop("rank")


def chain_scores(chains: DataFrame, cand: DataFrame, seeds: DataFrame) -> DataFrame:
    """Chains with mean asymmetry, value moved, whether they touch a seed, and their score."""
    hop = chains.select("start", F.posexplode("txids").alias("hop", "txid")).join(cand, "txid")
    s = seeds.select(F.col("wallet").alias("from_wallet"), F.lit(1).alias("from_seed"))
    p = seeds.select(F.col("wallet").alias("peel_wallet"), F.lit(1).alias("to_seed"))
    hop = hop.join(s, "from_wallet", "left").join(p, "peel_wallet", "left")
    agg = hop.groupBy("start").agg(
        F.avg(F.round("asymmetry", 4)).alias("mean_asymmetry"), F.max(F.when(F.col("hop") == 0, F.coalesce("from_seed", F.lit(0)))).alias("starts_at_seed"), F.max(F.coalesce("to_seed", F.lit(0))).alias("reaches_seed"),
        F.sum("continue_amount").alias("moved"),
    )
    seed = F.greatest("starts_at_seed", "reaches_seed").cast("double")
    return chains.select("start", "txids", "length").join(agg, "start").withColumn("score", chain_score(F.col("length"), F.col("mean_asymmetry"), F.col("moved"), seed))


def chain_score(length: Column, asymmetry: Column, moved: Column, seed: Column) -> Column:
    one = F.lit(1.0)
    return clamp(0.40 * F.least(length / config.PEEL_MAX_HOPS, one) + 0.25 * clamp((asymmetry - 0.5) / 0.5) + 0.20 * F.least(F.log1p(moved) / F.log1p(F.lit(100.0)), one) + 0.15 * seed)


def transaction_scores(scored: DataFrame, cand: DataFrame) -> DataFrame:
    """(txid, peel_score, is_peel, hop): a hop's share of its chain's score; candidates outside chains get a little."""
    hop = scored.select("start", "score", F.posexplode("txids").alias("hop", "txid")).groupBy("txid").agg(F.max(F.col("score") * (1 - 0.04 * F.col("hop"))).alias("chained"), F.min("hop").alias("hop"))
    alone = F.least(0.35 * F.col("asymmetry"), F.lit(0.5))
    return cand.select("txid", "asymmetry").join(hop, "txid", "left").select("txid", F.round(F.coalesce("chained", alone), 6).alias("peel_score"), F.col("chained").isNotNull().alias("is_peel"), "hop")


def wallet_scores(scored: DataFrame, cand: DataFrame) -> DataFrame:
    """(wallet, peel_score, peel_chain_length): best over the chains a wallet takes part in."""
    hop = scored.select("score", "length", F.explode("txids").alias("txid")).join(cand.select("txid", F.explode(F.array("from_wallet", "continue_wallet", "peel_wallet")).alias("wallet")), "txid")
    return hop.groupBy("wallet").agg(F.max("score").alias("peel_score"), F.max("length").alias("peel_chain_length"))


def mixing(tx: DataFrame, n_in: int = config.MIX_INPUTS, n_out: int = config.MIX_OUTPUTS, cv: float = config.MIX_CV) -> DataFrame:
    """(txid, inputs, outputs, n_inputs, n_outputs, output_cv, mixing_score) of transactions that look like mixing."""
    spread = pop_cv(F.col("output_amounts"))
    m = tx.where((F.size("inputs") >= n_in) & (F.size("outputs") >= n_out) & (F.size("output_amounts") == F.size("outputs")) & (F.size(F.array_distinct("inputs")) >= n_in))
    m = m.withColumn("output_cv", spread).where((array_sum(F.col("output_amounts")) > 0) & (F.col("output_cv") < cv))
    score = 0.6 * (1 - F.col("output_cv") / cv) + 0.4 * F.least(F.size("inputs") / 12.0, F.lit(1.0))
    return m.select("txid", "inputs", "outputs", F.size("inputs").alias("n_inputs"), F.size("outputs").alias("n_outputs"), "output_cv", clamp(score).alias("mixing_score"))


def mixing_wallets(mixed: DataFrame) -> DataFrame:
    """(wallet, mixing_participations): each transaction counts once for a wallet."""
    return mixed.select(F.explode(F.array_union("inputs", "outputs")).alias("wallet")).groupBy("wallet").agg(F.count("*").alias("mixing_participations"))
