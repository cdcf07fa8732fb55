"""From record files to ranked alerts and a sealed ledger.

Every stage is a DataFrame; only the ranked alerts (at most MAX_ALERTS) and counters reach the driver. Tables
that several stages read are written once, under the output folder, and read back.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import alerts as A
from ..operators import anomaly as N
from ..operators import clustering as K
from ..operators import correlate as C
from ..operators import enrich as E
from ..operators import evidence as V
from ..operators import features as X
from ..operators import graph as G
from ..operators import iterate as I
from ..operators import peeling as P
from ..operators import risk as R
from ..sources import readers
from .model import flows as flow_rows

NETWORK = "timestamp timestamp, src_ip string, dst_ip string, src_port int, dst_port int, txid string, protocol string, geo_country string, geo_asn string"


class Store:
    """Named tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def run(spark: SparkSession, input_dir: str, output_dir: str, seeds: list[str] | None = None, trees: int = config.FOREST_TREES, use_lof: bool = True, use_louvain: bool = True) -> dict:
    """Analyse a folder of record files. The tables are below output_dir, the ledger too; ``answers.export`` writes graph, alerts and summary files."""
    tx, net, found = readers.load_bundle(spark, input_dir)
    if tx is None:
        return {"transactions": 0, "network_records": 0, "alerts": 0}
    net = net if net is not None else spark.createDataFrame([], NETWORK)
    return analyse(spark, tx, net.withColumn("rec", F.monotonically_increasing_id()), readers.seeds_table(spark, seeds or found), output_dir, trees, use_lof, use_louvain)


def analyse(spark: SparkSession, tx: DataFrame, net: DataFrame, seeds: DataFrame, output_dir: str, trees: int = config.FOREST_TREES, use_lof: bool = True, use_louvain: bool = True) -> dict:
    I.prepared(spark)
    at = Store(spark, output_dir)
    tx = at.keep("transactions", tx)
    net = at.keep("network", E.enrich_network(net))
    seeds = at.keep("seeds", seeds)
    correlated = at.keep("correlated", C.correlate(net, tx.select("txid", "timestamp")))

    flows = at.keep("flows", flow_rows(tx))
    edges = at.keep("edges", G.flow_edges(flows))
    projection = at.keep("projection", G.projection(flows))
    pairs = at.keep("pairs", G.undirected(projection))
    wallets = at.keep("wallets", flows.select("wallet").distinct())

    tx_features = at.keep("tx_features", X.transaction_features(tx, C.feature_aggregate(correlated)))
    communities = K.louvain(pairs) if use_louvain else None
    labels = at.keep("clusters", K.entity_labels(wallets, K.common_input(tx), communities))
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))

    scored = N.isolation_forest(tx_features, "txid", X.TX_COLUMNS, trees=trees)
    lof = use_lof and tx_features.count() > config.LOF_NEIGHBOURS + 1
    if lof:
        z = N.standardize(tx_features, X.TX_COLUMNS).select("txid", F.array(*(F.col(c).cast("double") for c in X.TX_COLUMNS)).alias("v"))
        scored = scored.join(N.lof(z, "txid", "v"), "txid")
    anomalies = at.keep("tx_anomaly", N.blend(scored, "txid", lof_column="lof" if lof else None).select("txid", "anomaly_score", "is_anomaly"))

    candidates = at.keep("peel_candidates", P.candidates(tx))
    chains = at.keep("peel_chains", P.chain_scores(P.pick_chains(P.walks(candidates, P.next_hops(candidates))), candidates, seeds))
    tx_peel, wallet_peel = P.transaction_scores(chains, candidates), P.wallet_scores(chains, candidates)
    mixed = at.keep("mixing", P.mixing(tx))
    mixing_wallets = P.mixing_wallets(mixed)

    here = seeds.join(wallets, "wallet", "left_semi")
    risk = R.blended(wallets, R.seed_pagerank(projection, wallets, here), R.proximity(pairs, here), seeds)
    risk = at.keep("wallet_risk", R.inherit(risk, labels))
    signals = anomalies.join(tx_peel, "txid", "left").join(mixed.select("txid", "mixing_score"), "txid", "left").fillna(0.0, ["peel_score", "mixing_score"])
    signals = at.keep("tx_signals", signals.withColumn("signal", F.greatest("anomaly_score", "peel_score", "mixing_score")))
    tx_risk = at.keep("tx_risk", R.transaction_risk(flows, risk, signals.select("txid", "signal")))

    ranks = I.pagerank(edges.select("source", "target"), edges.select(F.explode(F.array("source", "target")).alias("id")).distinct())
    degree = edges.groupBy(F.when(F.col("edge_type") == "in", F.col("source")).otherwise(F.col("target")).alias("wallet")).agg(F.count_if(F.col("edge_type") == "in").alias("in_degree"), F.count_if(F.col("edge_type") == "out").alias("out_degree"))
    parts = {
        "stats": G.wallet_stats(flows), "amounts": G.wallet_amounts(edges), "degree": degree, "burst": X.burstiness(flows), "fans": X.fans(flows, tx), "peel_like": X.peel_like_fraction(flows, tx),
        "peel": wallet_peel.select("wallet", "peel_chain_length"), "mixing": mixing_wallets, "clusters": labels.join(sizes, "cluster_id").select("wallet", "cluster_size"), "pagerank": ranks.withColumnsRenamed({"id": "wallet", "rank": "pagerank"}),
        "risk": risk.select("wallet", "risk_pagerank", "risk_proximity", "hops_to_seed"), "addresses": X.wallet_addresses(flows, correlated), "seeds": seeds.withColumn("is_seed", F.lit(True)),
    }
    wallet_features = at.keep("wallet_features", X.wallet_features(parts, wallets))
    wallet_scored = N.isolation_forest(wallet_features, "wallet", X.WALLET_COLUMNS, trees=trees)
    wallet_anomaly = at.keep("wallet_anomaly", N.blend(wallet_scored, "wallet", lof_column=None).select("wallet", "anomaly_score"))

    ranked = at.keep("alerts", ranked_alerts(wallet_features, wallet_anomaly, wallet_peel, risk, labels, sizes, seeds, signals, tx_risk, tx_features, flows))
    best = [r.asDict(recursive=True) for r in ranked.orderBy(F.desc("risk"), F.desc("confidence"), "entity").collect()]  # at most MAX_ALERTS
    stamped = [V.stamp({k: v for k, v in a.items() if k != "evidence_hash"}) for a in best]
    entries = V.ledger([{**a, "risk_score": a["risk"]} for a in stamped], datetime.now(UTC).isoformat())
    spark.createDataFrame([(i, json.dumps(e, sort_keys=True)) for i, e in enumerate(entries)] or [], "place int, value string").coalesce(1).orderBy("place").select("value").write.mode("overwrite").text(f"{at.folder}/ledger")
    return {
        "transactions": tx.count(), "network_records": net.count(), "correlated": correlated.count(), "wallets": wallets.count(), "clusters": sizes.count(), "peel_chains": chains.count(), "mixing": mixed.count(),
        "anomalies": anomalies.where("is_anomaly").count(), "alerts": len(best), "above_070": sum(a["risk"] >= 0.7 for a in best), "ledger_ok": V.verify_ledger(entries)["ok"],
    }


def ranked_alerts(wallet_features, wallet_anomaly, wallet_peel, risk, labels, sizes, seeds, signals, tx_risk, tx_features, flows) -> DataFrame:
    seed = seeds.select("wallet").distinct().withColumn("is_seed", F.lit(True))
    members = labels.join(risk.select("wallet", "wallet_risk"), "wallet").join(wallet_peel.select("wallet", "peel_score"), "wallet", "left").join(seed, "wallet", "left")
    hot = F.coalesce("is_seed", F.lit(False)) | (F.col("wallet_risk") >= config.MIN_ALERT_RISK) | F.coalesce(F.col("peel_score") >= 0.5, F.lit(False))
    tainted = members.groupBy("cluster_id").agg(F.bool_or(hot).alias("cluster_tainted")).join(sizes, "cluster_id")
    w = members.join(tainted, "cluster_id").join(wallet_anomaly, "wallet").join(wallet_features.select("wallet", "mixing_participations", "peel_chain_length", "hops_to_seed"), "wallet")
    w = w.select(
        F.col("wallet").alias("entity"), F.lit("wallet").alias("entity_type"), F.col("wallet_risk").alias("risk_score"), "anomaly_score", F.coalesce("peel_score", F.lit(0.0)).alias("peel_score"), (F.col("mixing_participations") / 3.0).alias("mixing_score"),
        F.lit(0.0).alias("correlation_confidence"), "cluster_size", "cluster_tainted", F.coalesce("is_seed", F.lit(False)).alias("is_seed"), F.when(F.col("hops_to_seed") >= 0, F.col("hops_to_seed")).cast("int").alias("hops_to_seed"), "peel_chain_length",
    )
    t = signals.where("is_peel or mixing_score > 0 or is_anomaly").join(tx_risk, "txid").join(tx_features.select("txid", "correlation_confidence"), "txid")
    t = t.select(
        F.col("txid").alias("entity"), F.lit("transaction").alias("entity_type"), F.greatest("tx_risk", "wallet_max").alias("risk_score"), "anomaly_score", "peel_score", "mixing_score", "correlation_confidence",
        F.lit(1).cast("long").alias("cluster_size"), F.lit(False).alias("cluster_tainted"), F.lit(False).alias("is_seed"), F.lit(None).cast("int").alias("hops_to_seed"), F.coalesce(F.col("hop") + 1, F.lit(0)).alias("peel_chain_length"),
    )
    scored = A.is_wallet_alert(A.score_alerts(w)).unionByName(A.score_alerts(t))
    from ..functions.scalars import alert_id

    return A.rank_alerts(scored).withColumn("alert_id", alert_id(F.col("entity_type"), F.col("entity"), F.lit(0)))


# ----------------------------------------------------------------- questions about a finished run
def alerts(spark: SparkSession, output_dir: str, min_risk: float = 0.0, kind: str | None = None, text: str | None = None, limit: int = 100) -> DataFrame:
    return A.filter_alerts(Store(spark, output_dir).read("alerts"), min_risk, kind, text, limit)


def stats(spark: SparkSession, output_dir: str) -> dict:
    r = F.col("risk")
    return Store(spark, output_dir).read("alerts").agg(F.count("*").alias("alerts"), F.count_if(r >= 0.5).alias("medium"), F.count_if(r >= 0.7).alias("high"), F.count_if(F.col("entity_type") == "wallet").alias("wallets")).first().asDict()


def graph_around(spark: SparkSession, output_dir: str, node: str, depth: int = 2, limit: int = 300) -> DataFrame:
    """Edges among the nearest ``limit`` nodes at most depth steps from node."""
    edges = Store(spark, output_dir).read("edges")
    near = G.neighbourhood(edges, spark.createDataFrame([(node,)], "id string"), depth).orderBy("hops", "id").limit(limit)
    return G.induced(edges, near)


def verify_ledger(spark: SparkSession, output_dir: str) -> dict:
    return V.verify_ledger([json.loads(r.value) for r in spark.read.text(f"{output_dir}/ledger").collect()])
