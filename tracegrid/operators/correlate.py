"""Network records and transactions: exact and nearest-in-time matches.

The window join never compares all pairs: record times are cut into buckets of one window, each record looks
into three buckets, and only those rows meet. Times are compared as whole microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config
from ..functions.scalars import window_confidence


def exact(net: DataFrame, tx: DataFrame) -> DataFrame:
    """net (rec, txid, timestamp, ...) with transactions of the same txid; delta is record minus transaction."""
    t = tx.select("txid", F.col("timestamp").alias("tx_timestamp"))
    delta = (F.unix_micros("timestamp") - F.unix_micros("tx_timestamp")) / 1e6
    return net.where("txid <> ''").join(t, "txid").withColumns(
        {"time_delta_seconds": F.round(delta, 6), "correlation_method": F.lit("exact"), "correlation_confidence": F.lit(1.0), "window_candidates": F.lit(None).cast("long")}
    )


def in_window(net: DataFrame, tx: DataFrame, window: int = config.WINDOW_SECONDS, key: str = "rec") -> DataFrame:
    """Each record of net with the transaction nearest in time, at most ``window`` seconds away; delta is
    transaction minus record. Ties go to the earlier transaction, then the smaller txid."""
    micros = window * 1_000_000
    n = net.withColumn("_at", F.unix_micros("timestamp")).withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_at") / micros) + d)))
    t = tx.select(F.col("txid").alias("_txid"), F.col("timestamp").alias("tx_timestamp"), F.unix_micros("timestamp").alias("_tx_at")).withColumn("_bucket", F.floor(F.col("_tx_at") / micros))
    near = n.join(t, "_bucket").where(F.abs(F.col("_tx_at") - F.col("_at")) <= micros)
    # Best and count as one aggregate with partial results, not a window over all candidates.
    best = near.groupBy(key).agg(
        F.min(F.struct(F.abs(F.col("_tx_at") - F.col("_at")).alias("d"), F.col("_tx_at"), F.col("_txid"), F.col("tx_timestamp"), F.col("_at"))).alias("b"), F.count("*").alias("window_candidates")
    )
    delta = (F.col("b._tx_at") - F.col("b._at")) / 1e6
    best = best.select(
        key, F.col("b._txid").alias("_txid"), F.col("b.tx_timestamp").alias("tx_timestamp"), F.round(delta, 6).alias("time_delta_seconds"), F.lit("time_window").alias("correlation_method"),
        F.round(window_confidence(delta, F.col("window_candidates"), window), 4).alias("correlation_confidence"), "window_candidates",
    )
    return net.drop("txid").join(best, key).withColumnRenamed("_txid", "txid")


def correlate(net: DataFrame, tx: DataFrame, window: int = config.WINDOW_SECONDS) -> DataFrame:
    """Exact matches; records without one by time. Sorted by confidence, then time, where order matters to the caller."""
    found = exact(net, tx)
    rest = net.join(tx.select("txid"), "txid", "left_anti")
    return found.unionByName(in_window(rest, tx, window), allowMissingColumns=True)


def per_transaction(correlated: DataFrame) -> DataFrame:
    return correlated.groupBy("txid").agg(
        F.max("correlation_confidence").alias("confidence"), F.min("correlation_method").alias("method"), F.count("*").alias("n_records"), F.avg("time_delta_seconds").alias("mean_delta")
    )


def summary(correlated: DataFrame) -> DataFrame:
    return correlated.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("correlation_method") == "exact").alias("exact"), F.count_if(F.col("correlation_method") == "time_window").alias("time_window"),
        F.count_distinct("txid").alias("transactions"), F.round(F.avg("correlation_confidence"), 4).alias("mean_confidence"),
    )


def feature_aggregate(correlated: DataFrame) -> DataFrame:
    """Per transaction, for its features: best confidence, records, mean absolute delta, country of the best record."""
    return correlated.groupBy("txid").agg(
        F.max("correlation_confidence").alias("correlation_confidence"), F.count("*").alias("n_network_records"), F.avg(F.abs("time_delta_seconds")).alias("mean_time_delta_seconds"),
        F.min_by("geo_country", F.when(F.col("geo_country").isNotNull(), F.struct(-F.col("correlation_confidence"), F.col("rec")))).alias("geo_country"),
    )


def first_geo(correlated: DataFrame) -> DataFrame:
    """(txid, geo_country, geo_asn) of each transaction's best record."""
    best = F.row_number().over(W.partitionBy("txid").orderBy(F.desc("correlation_confidence"), "timestamp", "rec"))
    return correlated.where("txid is not null").withColumn("_r", best).where("_r = 1").select("txid", "geo_country", "geo_asn")
