"""Feature tables of transactions and wallets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config
from ..functions.scalars import array_sum, pop_cv, script_index


def _int(c: Column) -> Column:
    return c.cast("int")


def transaction_features(tx: DataFrame, correlated: DataFrame | None = None) -> DataFrame:
    """24 features for each transaction; correlated: correlate.feature_aggregate's rows."""
    nin, nout = F.size("inputs"), F.size("outputs")
    tin, tout = array_sum(F.col("input_amounts")), array_sum(F.col("output_amounts"))
    tin, tout = F.when(tin == 0, 1e-9).otherwise(tin), F.when(tout == 0, 1e-9).otherwise(tout)
    ranked = F.sort_array("output_amounts", asc=False)
    first, second = F.coalesce(F.get(ranked, 0), F.lit(0.0)), F.coalesce(F.get(ranked, 1), F.lit(0.0))
    out_cv = pop_cv(F.col("output_amounts"))
    if correlated is None:
        c = {"correlation_confidence": F.lit(0.0), "n_network_records": F.lit(0).cast("long"), "mean_time_delta_seconds": F.lit(0.0), "geo_country": F.lit(None).cast("string")}
        joined = tx.drop(*c).withColumns(c)
    else:
        joined = tx.drop("geo_country").join(correlated, "txid", "left")
    return joined.select(
        "txid", nin.alias("num_inputs"), nout.alias("num_outputs"), tin.alias("total_input"), tout.alias("total_output"), F.coalesce("fee", F.lit(0.0)).alias("fee"),
        (F.coalesce("fee", F.lit(0.0)) / tin).alias("fee_ratio"), (first / tout).alias("amount_ratio"), out_cv.alias("out_amount_cv"), pop_cv(F.col("input_amounts")).alias("in_amount_cv"),
        (nin / F.greatest(nout, F.lit(1))).alias("io_ratio"), _int((nin == 1) & (nout == 2)).alias("is_1in_2out"), _int((nin == 1) & (nout == 1)).alias("is_1in_1out"),
        _int((nin >= 8) & (nout <= 2)).alias("is_consolidation"), _int((nin <= 2) & (nout >= 8)).alias("is_fan_out"), F.size(F.filter("output_amounts", lambda x: (x > 0) & (x < 0.001))).alias("dust_outputs"),
        F.when(first + second == 0, 0.0).otherwise(first / F.greatest(first + second, F.lit(1e-9))).alias("asymmetry"), F.log1p(tin).alias("log_total_input"), script_index(F.col("script_type")).alias("script_type_encoded"),
        _int(F.col("n_network_records").isNotNull() & (F.col("n_network_records") > 0)).alias("has_network_correlation"), F.coalesce("correlation_confidence", F.lit(0.0)).alias("correlation_confidence"),
        F.coalesce("n_network_records", F.lit(0)).alias("n_network_records"), F.coalesce("mean_time_delta_seconds", F.lit(0.0)).alias("mean_time_delta_seconds"),
        _int(F.coalesce(F.col("geo_country").isin(config.OFFSHORE), F.lit(False))).alias("src_geo_is_offshore"),
        _int((nin >= config.MIX_INPUTS) & (nout >= config.MIX_OUTPUTS) & (out_cv < config.MIX_CV)).alias("is_coinjoin_shape"),
    )


TX_COLUMNS = [
    "num_inputs", "num_outputs", "total_input", "total_output", "fee", "fee_ratio", "amount_ratio", "out_amount_cv", "in_amount_cv", "io_ratio", "is_1in_2out", "is_1in_1out", "is_consolidation",
    "is_fan_out", "dust_outputs", "asymmetry", "log_total_input", "script_type_encoded", "has_network_correlation", "correlation_confidence", "n_network_records", "mean_time_delta_seconds",
    "src_geo_is_offshore", "is_coinjoin_shape",
]


def burstiness(flows: DataFrame, seconds: int = 60) -> DataFrame:
    """(wallet, burstiness): most touches in any closed interval of that length, by a range frame over microseconds."""
    w = W.partitionBy("wallet").orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    return flows.select("wallet", F.unix_micros("timestamp").alias("us")).withColumn("n", F.count("*").over(w)).groupBy("wallet").agg(F.max("n").alias("burstiness"))


def fans(flows: DataFrame, tx: DataFrame) -> DataFrame:
    """(wallet, max_fan_in, max_fan_out): largest number of inputs where it spends, of outputs where it receives."""
    sizes = tx.select("txid", F.size("inputs").alias("nin"), F.size("outputs").alias("nout"))
    per = lambda side, c: F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    return flows.select("txid", "wallet", "side").join(sizes, "txid").groupBy("wallet").agg(per("in", "nin").alias("max_fan_in"), per("out", "nout").alias("max_fan_out"))


def peel_like_fraction(flows: DataFrame, tx: DataFrame, threshold: float = config.PEEL_ASYMMETRY) -> DataFrame:
    """(wallet, fraction): share of its spends that are one input to two lopsided outputs."""
    top, total = F.array_max("output_amounts"), array_sum(F.col("output_amounts"))
    shape = tx.select("txid", ((F.size("inputs") == 1) & (F.size("outputs") == 2) & F.coalesce(top / total > threshold, F.lit(False))).alias("peel"))
    return flows.where("side = 'in'").select("txid", "wallet").distinct().join(shape, "txid").groupBy("wallet").agg(F.avg(F.col("peel").cast("double")).alias("fraction_of_peel_like_txs"))


def wallet_addresses(flows: DataFrame, correlated: DataFrame) -> DataFrame:
    """(wallet, n_correlated_ips, distinct_source_countries) over the transactions it spends in."""
    spends = flows.where("side = 'in'").select("txid", "wallet").distinct()
    seen = spends.join(correlated.select("txid", "src_ip", "dst_ip", "geo_country"), "txid")
    return seen.select("wallet", F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "geo_country").groupBy("wallet").agg(F.count_distinct("ip").alias("n_correlated_ips"), F.count_distinct("geo_country").alias("distinct_source_countries"))


def spend_index(flows: DataFrame) -> DataFrame:
    """(wallet, txids): where each wallet spends, in time order."""
    spends = flows.where("side = 'in'").select("wallet", "timestamp", "txid").distinct()
    return spends.groupBy("wallet").agg(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "txid"))), lambda x: x["txid"]).alias("txids"))


def wallet_features(parts: dict[str, DataFrame], wallets: DataFrame) -> DataFrame:
    """27 features for each wallet: wallets (wallet) with each part joined, missing values 0 (hops -1)."""
    out = wallets
    for part in parts.values():
        out = out.join(part, "wallet", "left")
    have = lambda c, d=0.0: F.coalesce(F.col(c), F.lit(d)) if c in out.columns else F.lit(d)
    n, life = have("tx_count", 0), have("lifetime_hours")
    return out.select(
        "wallet", have("in_degree", 0).alias("in_degree"), have("out_degree", 0).alias("out_degree"), n.alias("n_txs"), have("total_in").alias("total_received"), have("total_out").alias("total_sent"),
        (have("total_in") - have("total_out")).alias("net_flow"), have("unique_counterparties", 0).alias("unique_counterparties"), have("mean_amount").alias("avg_tx_amount"), have("std_amount").alias("std_tx_amount"),
        F.greatest(have("total_in"), have("total_out")).alias("max_tx_amount"), life.alias("lifetime_hours"), F.when(life > 0, n / life).otherwise(n.cast("double")).alias("tx_per_hour"),
        have("burstiness", 0).alias("burstiness"), have("max_fan_in", 0).alias("max_fan_in"), have("max_fan_out", 0).alias("max_fan_out"), have("fraction_of_peel_like_txs").alias("fraction_of_peel_like_txs"),
        have("peel_chain_length", 0).alias("peel_chain_length"), have("mixing_participations", 0).alias("mixing_participations"), have("cluster_size", 1).alias("cluster_size"), have("cluster_size", 1).alias("cluster_member_count"),
        have("pagerank").alias("pagerank"), have("risk_pagerank").alias("risk_pagerank"), have("risk_proximity").alias("risk_proximity"), have("hops_to_seed", -1).cast("double").alias("hops_to_seed"),
        have("n_correlated_ips", 0).alias("n_correlated_ips"), have("distinct_source_countries", 0).alias("distinct_source_countries"), have("is_seed", False).cast("int").alias("is_seed"),
    )


WALLET_COLUMNS = [
    "in_degree", "out_degree", "n_txs", "total_received", "total_sent", "net_flow", "unique_counterparties", "avg_tx_amount", "std_tx_amount", "max_tx_amount", "lifetime_hours", "tx_per_hour", "burstiness",
    "max_fan_in", "max_fan_out", "fraction_of_peel_like_txs", "peel_chain_length", "mixing_participations", "cluster_size", "cluster_member_count", "pagerank", "risk_pagerank", "risk_proximity", "hops_to_seed",
    "n_correlated_ips", "distinct_source_countries", "is_seed",
]
