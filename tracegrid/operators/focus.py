"""Questions about one entity of the exported graph: edges (source, target, edge_type, amount, timestamp), nodes (id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PATH_MAX = 12


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours): sorted distinct neighbours of every node, whatever the direction."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target")
    return both.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set("target")).alias("neighbours"))


def direct_neighbours(edges: DataFrame, node: str) -> DataFrame:
    other = F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source"))
    return edges.where((F.col("source") == node) | (F.col("target") == node)).select(other.alias("id")).where(F.col("id") != node).distinct()


def advance_path(path: list[str], node: str, neighbours: set[str]) -> list[str]:
    """The clicked path after node: back to it if it's on the path, on if it's next to the end, else anew."""
    if node in path:
        return path[: path.index(node) + 1]
    return [*path, node][-PATH_MAX:] if path and node in neighbours else [node]


def route_hops(edges: DataFrame, path: list[str]) -> DataFrame:
    """(hop, a, b, edge_type, amount): each step of the path with the first edge between its ends, if any."""
    steps = edges.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:], strict=False), 1)], "hop int, a string, b string")
    e = edges.groupBy(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).agg(F.min_by(F.struct("edge_type", "amount"), F.struct("timestamp", "edge_type")).alias("e"))
    met = steps.join(e, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left")
    return met.select("hop", "a", "b", "e.edge_type", "e.amount").orderBy("hop")


def _role(kind: Column, edge_type: Column) -> Column:
    spent = edge_type == "in"
    return F.when(edge_type == "network", "correlated").when((kind == "wallet") & spent, "sent").when(kind == "wallet", "received").when((kind == "txid") & spent, "funded by").when(kind == "txid", "paid out to").otherwise("moved")


def flow_rows(edges: DataFrame, nodes: DataFrame, focus: DataFrame) -> DataFrame:
    """One row for each movement at the focus nodes (id): focus, source, target, amount, role, direction, timestamp, step.

    Steps follow time, then the larger amount.
    """
    f = focus.select("id").join(nodes.select("id", "node_type"), "id").select(F.col("id").alias("focus"), "node_type")
    met = f.join(edges, F.col("focus") == F.col("source")).unionByName(f.join(edges.where("source <> target"), F.col("focus") == F.col("target")))
    amount = F.when(F.col("edge_type") != "network", F.col("amount"))
    direction = F.when(F.col("edge_type") == "network", "network").when(F.col("edge_type") == "in", "spend").otherwise("payout")
    rows = met.select("focus", "node_type", "source", "target", amount.alias("amount"), _role(F.col("node_type"), F.col("edge_type")).alias("role"), direction.alias("direction"), "timestamp")
    return rows.withColumn("step", F.row_number().over(W.partitionBy("focus").orderBy("timestamp", F.desc_nulls_last("amount"), "source", "target")))


def resolution(rows: DataFrame) -> DataFrame:
    """(focus, senders, receivers, total_sent, total_received, resolution): several senders of a transaction are a pool."""
    spend, pay = F.col("direction") == "spend", F.col("direction") == "payout"
    r = rows.groupBy("focus", "node_type").agg(
        F.count_if(spend).alias("senders"), F.count_if(pay).alias("receivers"), F.coalesce(F.sum(F.when(spend, F.col("amount"))), F.lit(0.0)).alias("total_sent"), F.coalesce(F.sum(F.when(pay, F.col("amount"))), F.lit(0.0)).alias("total_received")
    )
    kind = F.when(F.col("node_type") == "wallet", "exact").when((F.col("node_type") == "txid") & (F.col("senders") <= 1), "exact").when(F.col("node_type") == "txid", "pooled").otherwise("not-applicable")
    return r.withColumn("resolution", kind)


def node_events(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with the counterparty and its risk."""
    other = F.when(F.col("source") == F.col("focus"), F.col("target")).otherwise(F.col("source"))
    n = nodes.select(F.col("id").alias("counterparty"), F.coalesce("risk_score", F.lit(0.0)).alias("counterparty_risk"))
    return rows.withColumn("counterparty", other).join(n, "counterparty", "left").fillna(0.0, ["counterparty_risk"])


def timeline_stats(events: DataFrame) -> DataFrame:
    """(focus, events, sent, received, network_events, span_hours, flagged, severe)."""
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 3.6e9
    risky = lambda least: F.count_distinct(F.when(F.col("counterparty_risk") >= least, F.col("counterparty")))
    total = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0.0))
    return events.groupBy("focus").agg(F.count("*").alias("events"), total("spend").alias("sent"), total("payout").alias("received"), F.count_if(F.col("direction") == "network").alias("network_events"), span.alias("span_hours"), risky(0.5).alias("flagged"), risky(0.85).alias("severe"))


def node_facts(nodes: DataFrame, edges: DataFrame, node: str) -> dict:
    """What is known of one node, with its degree."""
    row = nodes.where(F.col("id") == node).first()
    if row is None:
        return {}
    n = edges.where((F.col("source") == node) | (F.col("target") == node)).count()
    return {k: v for k, v in row.asDict().items() if v is not None} | {"degree": n}


def timeline_offset(rows: DataFrame, moment: list[str], order: list[str]) -> DataFrame:
    """rows with their slot among those of the same moment."""
    return rows.withColumn("slot", F.row_number().over(W.partitionBy(*moment).orderBy(*order)) - 1)


def focus_view(edges: DataFrame, path: list[str]) -> dict:
    """What a clicked path lights up: head, path, and as DataFrames the head's neighbours (id), nodes (id) and pairs (a, b, ladder).

    A pair lights up if the head is one of its ends or the path walks along it (ladder).
    """
    spark, head = edges.sparkSession, path[-1] if path else None
    walked = spark.createDataFrame([(*sorted(x), True) for x in zip(path, path[1:], strict=False)], "a string, b string, ladder boolean").distinct()
    pairs = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().join(walked, ["a", "b"], "left").fillna(False, ["ladder"])
    pairs = pairs.where(F.col("ladder") | F.coalesce((F.col("a") == head) | (F.col("b") == head), F.lit(False)))
    near = direct_neighbours(edges, head) if head is not None else edges.select(F.col("source").alias("id")).limit(0)
    nodes = near.unionByName(spark.createDataFrame([(x,) for x in path], "id string")).distinct()
    return {"head": head, "path": list(path), "neighbours": near, "nodes": nodes, "pairs": pairs}


def _short(node: str, keep: int = 8) -> str:
    return node if len(node) <= 2 * keep + 1 else f"{node[:keep]}…{node[-4:]}"


def path_summary(path: list[str]) -> str:
    return " → ".join(map(_short, path))


def route_summary(edges: DataFrame, path: list[str]) -> str:
    """The path with what each step carries, in one unit for the whole route; network steps say so."""
    if len(path) < 2:
        return ""
    hops = route_hops(edges, path).collect()  # a path has at most PATH_MAX nodes
    top = max((h.amount or 0.0 for h in hops if h.edge_type != "network"), default=0.0)
    unit, scale = next((u, s) for u, s, least in (("BTC", 1.0, 1.0), ("mBTC", 1e3, 1e-3), ("bits", 1e6, 1e-6), ("sat", 1e8, 0.0)) if top >= least)
    carried = lambda h: f"{h.amount * scale:,.4f} {unit}" if h.amount is not None and h.edge_type != "network" else h.edge_type or "no link"
    return "   ".join([_short(path[0]), *(f"-{carried(h)}→ {_short(h.b)}" for h in hops)])


def back_references(alerts: DataFrame, node: str) -> DataFrame:
    """Alerts (entity, reasons, ...) about a node or that name it in a reason."""
    return alerts.where((F.col("entity") == node) | F.exists("reasons", lambda r: F.contains(r, F.lit(node))))


def trail_unit(rows: DataFrame) -> DataFrame:
    """(focus, unit): one unit for a trail, by its largest amount."""
    top = F.max("amount")
    return rows.groupBy("focus").agg(F.when(top >= 1, "BTC").when(top >= 1e-3, "mBTC").when(top >= 1e-6, "bits").otherwise("sat").alias("unit"))
