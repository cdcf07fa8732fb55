"""Answers about a finished run: one alert, health, infrastructure, the ledger's pages and state, summaries, exports.

Small answers (counters, one alert, a page) are plain values; what grows with the run stays a DataFrame.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import alerts as A
from ..operators import evidence as V
from ..operators import graph as G
from ..sources.readers import file_names
from .pipeline import Store

TABLES = ["transactions", "network", "edges", "clusters", "wallet_risk", "tx_anomaly", "alerts", "ledger"]


def _has(spark: SparkSession, output_dir: str, name: str) -> bool:
    return any(n.rpartition("/")[2].startswith("part-") for n in file_names(spark, f"{output_dir.rstrip('/')}/{name}"))


def health(spark: SparkSession, output_dir: str) -> dict:
    """Which tables of a run are there, and whether it is complete."""
    there = {name: _has(spark, output_dir, name) for name in TABLES}
    return {"status": "ok" if all(there.values()) else "incomplete" if any(there.values()) else "empty", "tables": there}


def alert(spark: SparkSession, output_dir: str, alert_id: str) -> dict | None:
    row = Store(spark, output_dir).read("alerts").where(F.col("alert_id") == alert_id).first()
    return row.asDict(recursive=True) if row else None


def ledger_entries(spark: SparkSession, output_dir: str) -> list[dict]:
    """All entries; a ledger has one for each ranked alert, of which there are at most MAX_ALERTS."""
    return [json.loads(r.value) for r in spark.read.text(f"{output_dir.rstrip('/')}/ledger").collect()]


def ledger_page(spark: SparkSession, output_dir: str, offset: int = 0, limit: int = 25) -> dict:
    entries = ledger_entries(spark, output_dir)
    return {"total": len(entries), "offset": offset, "entries": entries[offset : offset + limit]}


def chain_state(spark: SparkSession, output_dir: str) -> dict:
    entries = ledger_entries(spark, output_dir)
    found = V.verify_ledger(entries)
    return {"ok": found["ok"], "entries": len(entries), "first_break": found["first_break"], "head": entries[-1]["entry_hash"] if entries else V.GENESIS}


def infrastructure(spark: SparkSession, output_dir: str, key: str = "geo_asn") -> DataFrame:
    """Alerts by the providers (or countries) of the network records that match their transactions."""
    at = Store(spark, output_dir)
    alerts = at.read("alerts").select("alert_id", "entity", "entity_type", "risk")
    touched = alerts.where("entity_type = 'wallet'").join(at.read("flows").select(F.col("wallet").alias("entity"), "txid").distinct(), "entity").select("alert_id", "txid")
    touched = touched.unionByName(alerts.where("entity_type = 'transaction'").select("alert_id", F.col("entity").alias("txid")))
    packets = at.read("correlated").select("txid", "geo_country", "geo_asn", F.col("src_asn_org").alias("asn_org"))
    evidence = touched.join(packets.select("txid", "geo_country", "geo_asn", "asn_org"), "txid").select("alert_id", "geo_country", "geo_asn", "asn_org").distinct()
    return A.rollup(alerts, evidence, packets, key)


def risk_summary(risk: DataFrame) -> DataFrame:
    """One row of counters of wallet risks (wallet, wallet_risk, hops_to_seed)."""
    r, h = F.col("wallet_risk"), F.col("hops_to_seed")
    return risk.agg(
        F.count_if(h == 0).alias("seeds"), F.count("*").alias("wallets_scored"), F.count_if(r >= config.MIN_ALERT_RISK).alias("above_threshold"),
        F.coalesce(F.round(F.max(r), 4), F.lit(0.0)).alias("max_wallet_risk"), F.count_if(h <= 2).alias("within_two_hops"),
    )


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """One row of counters of scores (anomaly_score, is_anomaly)."""
    return scored.agg(F.count("*").alias("scored"), F.count_if("is_anomaly").alias("flagged"), F.coalesce(F.round(F.avg("anomaly_score"), 4), F.lit(0.0)).alias("mean_score"))


def transaction_index(edges: DataFrame) -> DataFrame:
    """(txid, inputs, outputs, total_in, total_out, io_ratio): transactions as their edges (source, target, edge_type, amount) tell."""
    spent = F.col("edge_type") == "in"
    side = lambda kind: F.array_sort(F.collect_list(F.when(spent if kind == "in" else ~spent, F.col("wallet"))))
    total = lambda kind: F.coalesce(F.sum(F.when(spent if kind == "in" else ~spent, F.col("amount"))), F.lit(0.0))
    ends = edges.where("edge_type in ('in', 'out')").select(F.when(spent, F.col("target")).otherwise(F.col("source")).alias("txid"), F.when(spent, F.col("source")).otherwise(F.col("target")).alias("wallet"), "edge_type", "amount")
    index = ends.groupBy("txid").agg(side("in").alias("inputs"), side("out").alias("outputs"), total("in").alias("total_in"), total("out").alias("total_out"))
    return index.withColumn("io_ratio", F.size("inputs") / F.greatest(F.size("outputs"), F.lit(1)))


def replay_ticks(moments: DataFrame, column: str, count: int) -> DataFrame:
    """At most count evenly spaced of the distinct values of a column, the first and the last among them.

    The values must be few (days, hours): they are numbered in one window.
    """
    from pyspark.sql import Window as W

    ticks = moments.select(column).distinct().withColumn("_i", F.row_number().over(W.orderBy(column)) - 1)
    n = ticks.count()
    k = max(min(count, n), 1)
    picks = sorted({int(i * (n - 1) / (k - 1) + 0.5) for i in range(k)}) if k > 1 else [n - 1]
    return ticks.where(F.col("_i").isin(picks)).drop("_i")


def humanise_seconds(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 1, F.format_string("%.0f ms", seconds * 1000)).when(seconds < 60, F.format_string("%.2f s", seconds)).otherwise(F.format_string("%d min %.0f s", minutes, seconds - 60 * minutes))


def export(spark: SparkSession, output_dir: str, limit: int = 5000) -> dict:
    """Write graph (nodes and edges as JSON lines, annotated), alerts (CSV) and summary (JSON) below output_dir/export."""
    at, folder = Store(spark, output_dir), f"{output_dir.rstrip('/')}/export"
    edges = at.read("edges")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    wallets = at.read("wallets").select(F.col("wallet").alias("id"), F.lit("wallet").alias("node_type"))
    nodes = ends.join(wallets, "id", "left").fillna("txid", ["node_type"])
    risk = at.read("wallet_risk").select(F.col("wallet").alias("id"), F.col("wallet_risk").alias("risk_score"), "hops_to_seed")
    nodes, lines, truncated = G.node_link(G.annotate(nodes, risk, at.read("clusters").select(F.col("wallet").alias("id"), "cluster_id")), edges, limit)
    nodes.write.mode("overwrite").text(f"{folder}/graph/nodes")
    lines.write.mode("overwrite").text(f"{folder}/graph/edges")
    alerts = at.read("alerts")
    flat = alerts.select(*(c for c, kind in alerts.dtypes if not kind.startswith(("array", "struct", "map"))))
    flat.coalesce(1).orderBy(F.desc("risk"), "entity").write.mode("overwrite").option("header", True).csv(f"{folder}/alerts")
    summary = {"alerts": alerts.count(), "truncated": truncated, "risk": risk_summary(at.read("wallet_risk")).first().asDict(), "anomaly": anomaly_summary(at.read("tx_anomaly")).first().asDict(), "ledger": chain_state(spark, output_dir)}
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    return summary
