"""The property graph as two tables, its projections, statistics and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import connected_components, hops_from


def flow_edges(flows: DataFrame) -> DataFrame:
    """One edge for each transaction, wallet and side: source, target, edge_type, amount, occurrences, timestamp."""
    e = flows.groupBy("txid", "wallet", "side").agg(F.sum("amount").alias("amount"), F.count("*").alias("occurrences"), F.min("timestamp").alias("timestamp"))
    spent = F.col("side") == "in"
    return e.select(
        F.when(spent, F.col("wallet")).otherwise(F.col("txid")).alias("source"), F.when(spent, F.col("txid")).otherwise(F.col("wallet")).alias("target"),
        F.col("side").alias("edge_type"), "amount", "occurrences", "timestamp",
    )


def ip_edges(correlated: DataFrame, known: DataFrame) -> DataFrame:
    """An edge from each address of a correlated record to its transaction; the most confident record's values stay."""
    ends = F.explode(F.array(F.struct(F.col("src_ip").alias("ip"), F.lit("src").alias("end")), F.struct(F.col("dst_ip").alias("ip"), F.lit("dst").alias("end"))))
    e = correlated.join(known.select("txid"), "txid", "left_semi").withColumn("x", ends).where("x.ip is not null")
    return e.groupBy(F.col("x.ip").alias("source"), F.col("txid").alias("target"), "correlation_method").agg(
        F.max("correlation_confidence").alias("correlation_confidence"), F.min("timestamp").alias("timestamp")
    ).withColumn("edge_type", F.lit("network"))


def wallet_stats(flows: DataFrame) -> DataFrame:
    """Received, sent, touches, first and last seen; tx_count counts every touch."""
    return flows.groupBy("wallet").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "out", F.col("amount"))), F.lit(0.0)).alias("total_in"), F.coalesce(F.sum(F.when(F.col("side") == "in", F.col("amount"))), F.lit(0.0)).alias("total_out"),
        F.count("*").alias("tx_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count_distinct("txid").alias("unique_counterparties"),
    )


def wallet_amounts(edges: DataFrame) -> DataFrame:
    """Mean and sample deviation (0 for one) of a wallet's edges, and its lifetime in hours."""
    w = edges.select(F.when(F.col("edge_type") == "in", F.col("source")).otherwise(F.col("target")).alias("wallet"), "amount", "timestamp")
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 3.6e9
    return w.groupBy("wallet").agg(F.avg("amount").alias("mean_amount"), F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_amount"), span.alias("lifetime_hours"))


def nodes(tx: DataFrame, flows: DataFrame, correlated_edges: DataFrame | None, seeds: DataFrame) -> DataFrame:
    """(id, node_type, total_in, total_out, is_seed) of wallets, transactions and addresses."""
    w = wallet_stats(flows).join(seeds.withColumn("is_seed", F.lit(True)), "wallet", "left").select(F.col("wallet").alias("id"), F.lit("wallet").alias("node_type"), "total_in", "total_out", F.coalesce("is_seed", F.lit(False)).alias("is_seed"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    t = tx.select(F.col("txid").alias("id"), F.lit("txid").alias("node_type"), total("input_amounts").alias("total_in"), total("output_amounts").alias("total_out"), F.lit(False).alias("is_seed"))
    out = w.unionByName(t)
    if correlated_edges is not None:
        zero = F.lit(0.0)
        out = out.unionByName(correlated_edges.select(F.col("source").alias("id")).distinct().select("id", F.lit("ip").alias("node_type"), zero.alias("total_in"), zero.alias("total_out"), F.lit(False).alias("is_seed")))
    return out


def projection(flows: DataFrame) -> DataFrame:
    """Wallet to wallet for each transaction, spender and receiver: amount received, and its share of all inputs."""
    e = flows.groupBy("txid", "wallet", "side").agg(F.sum("amount").alias("amount"))
    spent = e.where("side = 'in'").groupBy("txid").agg(F.sum("amount").alias("total"))
    src = e.where("side = 'in'").select("txid", F.col("wallet").alias("src"))
    dst = e.where("side = 'out'").select("txid", F.col("wallet").alias("dst"), "amount")
    share = F.col("amount") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    return src.join(dst, "txid").join(spent, "txid").select("txid", "src", "dst", "amount", share.alias("share_of_input"))


def undirected(proj: DataFrame) -> DataFrame:
    """One edge for each unordered pair (a <= b) with the sum of its shares."""
    w = F.when(F.col("share_of_input") == 0, 1e-6).otherwise(F.col("share_of_input"))
    return proj.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(w).alias("weight"))


def transaction_pairs(tx: DataFrame) -> DataFrame:
    """The rows that undirected(projection(flows)) adds up, for transactions of different txid: a <= b and the weight.

    They come from the lists of a transaction, without a join. A wallet listed twice counts once, with the sum of its amounts.
    """
    zipped = F.arrays_zip(F.col("outputs").alias("wallet"), F.col("output_amounts").alias("amount"))
    summed = lambda amounts: F.aggregate(F.filter(amounts, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)
    own = lambda w: F.transform(F.filter(zipped, lambda x: x["wallet"].eqNullSafe(w)), lambda x: x["amount"])
    once = F.transform(F.array_distinct("outputs"), lambda w: F.struct(w.alias("wallet"), summed(own(w)).alias("amount")))
    paid = F.when(F.size(F.array_distinct("outputs")) == F.size("outputs"), zipped).otherwise(once)
    rows = tx.select(F.array_distinct("inputs").alias("src"), paid.alias("paid"), summed(F.col("input_amounts")).alias("total"))
    rows = rows.select(F.explode("src").alias("src"), "paid", "total").select("src", F.explode("paid").alias("to"), "total")
    share = F.col("to.amount") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    return rows.select(F.least("src", "to.wallet").alias("a"), F.greatest("src", "to.wallet").alias("b"), F.when(share == 0, 1e-6).otherwise(share).alias("weight"))


def degrees(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def stats(node_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean and largest degree, weak components, value on the edges."""
    n = node_rows.agg(F.count("*").alias("nodes"), F.count_if(F.col("node_type") == "wallet").alias("wallets"), F.count_if(F.col("node_type") == "txid").alias("transactions"), F.count_if("is_seed").alias("seeds")).first()
    e = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("value")).first()
    top = degrees(edges).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("d")).first()
    linked = connected_components(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    c = linked.agg(F.count_distinct("component").alias("c"), F.count("*").alias("n")).first()
    density = e.edges / (n.nodes * (n.nodes - 1)) if n.nodes > 1 else 0.0
    row = (n.nodes, n.wallets, n.transactions, n.seeds, e.edges, density, 2 * e.edges / max(n.nodes, 1), top.d, c.c + n.nodes - c.n, e.value)
    return node_rows.sparkSession.createDataFrame([row], "nodes long, wallets long, transactions long, seeds long, edges long, density double, avg_degree double, max_degree long, components long, total_value double")


def top_by_degree(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of largest degree (ties by id) and the edges among them."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(limit)
    return top, induced(edges, top)


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    k = keep.select("id")
    return edges.join(k, edges["source"] == k["id"], "left_semi").join(k, edges["target"] == k["id"], "left_semi")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hops) of nodes at most depth undirected steps from seeds (id)."""
    return hops_from(edges, seeds, depth)


def node_link(node_rows: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, truncated) as JSON lines with ISO times; beyond limit nodes, those of largest degree stay."""
    truncated = node_rows.count() > limit
    if truncated:
        top, edges = top_by_degree(edges, limit)
        node_rows = node_rows.join(top.select("id"), "id", "left_semi")
    iso = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c, kind in edges.dtypes if kind == "timestamp"}
    as_json = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return as_json(node_rows), as_json(edges.withColumns(iso) if iso else edges), truncated


def annotate(node_rows: DataFrame, *parts: DataFrame) -> DataFrame:
    """Nodes with the columns of parts (id, ...), null where a part has no row."""
    for p in parts:
        node_rows = node_rows.join(p, "id", "left")
    return node_rows
