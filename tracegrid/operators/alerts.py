"""Alert scores, confidence, what-ifs, categories, reasons and ranking. Inputs are wide rows of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config
from ..functions.scalars import clamp, safe_div

PARTS = list(config.WEIGHTS)


def components(df: DataFrame) -> DataFrame:
    """df (risk_score, anomaly_score, peel_score, mixing_score, correlation_confidence, cluster_size, cluster_tainted)
    with c_peel .. c_correlation, each 0 to 1. A collapsed cluster is no evidence; a tainted one is full evidence."""
    size = F.col("cluster_size")
    cluster = F.when(size > config.INHERIT_MAX, 0.0).when(F.col("cluster_tainted"), 1.0).when((size > 1) & (size <= config.CLUSTER_REPORT_MAX), clamp(safe_div(size.cast("double"), F.lit(4.0)))).otherwise(0.0)
    return df.withColumns(
        {
            "c_peel": clamp(F.col("peel_score")), "c_mixing": clamp(F.col("mixing_score")), "c_anomaly": clamp(F.col("anomaly_score")), "c_risk": clamp(F.col("risk_score")), "c_cluster": cluster,
            "c_correlation": clamp(F.col("correlation_confidence")),
        }
    )


def composite(without: str | None = None) -> Column:
    """Weighted mean of the components, but no less than the ladder gives the strongest; one part may be left out."""
    value = {p: F.lit(0.0) if p == without else F.col(f"c_{p}") for p in PARTS}
    mean = sum((config.WEIGHTS[p] * value[p] for p in PARTS), F.lit(0.0)) / sum(config.WEIGHTS.values())
    return clamp(F.greatest(mean, *(w * value[p] for p, w in config.LADDER.items())))


def confidence() -> Column:
    """From the three strongest components and how many are at least 0.4."""
    values = F.array(*(F.col(f"c_{p}") for p in PARTS))
    top = F.slice(F.sort_array(F.filter(values, lambda x: x > 0), asc=False), 1, 3)
    strength = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(top), F.lit(1))
    agree = F.least(F.size(F.filter(values, lambda x: x >= 0.40)) / 3.0, F.lit(1.0))
    return F.when(F.size(top) == 0, 0.0).otherwise(clamp(0.60 * strength + 0.40 * agree, config.CONFIDENCE_LEAST))


def counterfactuals() -> Column:
    """Array of (evidence, value, score_without, score_drop, still_flagged, decisive): up to three parts, strongest first."""
    score = composite()
    rows = F.array(*(F.struct((-F.col(f"c_{p}")).alias("o"), F.lit(p).alias("evidence"), F.col(f"c_{p}").alias("value"), composite(p).alias("score_without"), (score - composite(p)).alias("score_drop")) for p in PARTS))
    kept = F.slice(F.sort_array(F.filter(rows, lambda r: (r["value"] > 0) & (r["score_drop"] >= 0.02))), 1, 3)
    flagged = lambda r: r["score_without"] >= config.MIN_ALERT_RISK
    return F.transform(kept, lambda r: F.struct(r["evidence"].alias("evidence"), r["value"].alias("value"), F.round(r["score_without"], 4).alias("score_without"), F.round(r["score_drop"], 4).alias("score_drop"), flagged(r).alias("still_flagged"), (~flagged(r)).alias("decisive")))


def counterfactual_summary(rows: Column) -> Column:
    decisive = F.sort_array(F.transform(F.filter(rows, lambda r: r["decisive"]), lambda r: F.struct(r["score_without"].alias("s"), r["evidence"].alias("e"))))
    clear = F.format_string("Without its %s evidence alone this entity would score %.2f and leave the list; verify that first.", decisive[0]["e"], decisive[0]["s"])
    firm = F.format_string("No single part clears this entity: without its %s evidence it still scores %.2f.", rows[0]["evidence"], rows[0]["score_without"])
    return F.when(F.size(decisive) > 0, clear).when(F.size(rows) > 0, firm).otherwise("No part matters much by itself; the score is a sum of weak evidence.")


def recommended_action(score: Column, hops: Column, is_seed: Column) -> Column:
    return F.when(is_seed, "escalate: known seed").when((score >= 0.75) | F.coalesce(hops <= 1, F.lit(False)), "escalate").when(score >= config.MIN_ALERT_RISK, "investigate").otherwise("monitor")


def assessment(is_seed: Column) -> Column:
    typed = F.greatest("c_peel", "c_mixing", "c_risk", "c_cluster")
    return F.when((F.col("c_anomaly") >= 0.5) & (typed < 0.30) & ~is_seed, "unusual-but-untyped").otherwise("corroborated")


def category() -> Column:
    strongest = F.sort_array(F.array(*(F.struct((-F.col(f"c_{p}")).alias("o"), F.lit(p).alias("p")) for p in PARTS)))[0]["p"]
    return F.when(F.col("c_mixing") >= 0.5, "mixing").when(F.col("c_peel") >= 0.5, "peel").when(F.col("c_cluster") >= 0.5, "cluster").when(F.col("c_risk") >= 0.5, "risk").when(F.col("c_anomaly") >= 0.5, "anomaly").otherwise(strongest)


def reasons() -> Column:
    """Sentences for the rules that hold, in a fixed order."""
    say = lambda when, text, *args: F.when(when, F.format_string(text, *args) if args else F.lit(text))
    hops, size = F.col("hops_to_seed"), F.col("cluster_size")
    return F.array_compact(
        F.array(
            say(F.col("is_seed"), "On the list of known seeds"),
            say(F.col("peel_chain_length") > 0, "Part of a peeling chain of %d hops", F.col("peel_chain_length")),
            say(F.col("mixing_score") > 0.5, "Shaped like mixing (score %.2f)", F.col("mixing_score")),
            say(F.col("anomaly_score") >= 0.9, "High anomaly score (%.2f)", F.col("anomaly_score")),
            say((F.col("anomaly_score") > 0) & (F.col("anomaly_score") < 0.9), "Elevated anomaly score (%.2f)", F.col("anomaly_score")),
            say(hops.between(1, 2), "%d hop(s) from a seed", hops),
            say((hops > 2) & (hops <= config.RISK_MAX_HOPS), "%d hops from a seed, decayed by distance", hops),
            say(size.between(6, config.CLUSTER_REPORT_MAX), "Shares an owner with a cluster of %d wallets", size),
            say(size > config.CLUSTER_REPORT_MAX, "In a collapsed component of %d wallets, which is no evidence of an owner", size),
            say(F.col("correlation_confidence") > 0, "Matched by network records (best confidence %.2f)", F.col("correlation_confidence")),
        )
    )


def score_alerts(df: DataFrame) -> DataFrame:
    """Signals with components, score, confidence, what-ifs, category, assessment, action and reasons."""
    out = components(df).withColumns({"risk": F.round(composite(), 6), "confidence": F.round(confidence(), 6), "counterfactuals": counterfactuals(), "category": category(), "assessment": assessment(F.col("is_seed")), "reasons": reasons()})
    return out.withColumn("action", recommended_action(F.col("risk"), F.col("hops_to_seed"), F.col("is_seed"))).withColumn("counterfactual_summary", counterfactual_summary(F.col("counterfactuals")))


def is_wallet_alert(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_seed") | (F.col("risk") >= config.MIN_ALERT_RISK) | (F.col("peel_score") >= 0.5))


def rank_alerts(df: DataFrame, per_category: int = config.PER_CATEGORY, limit: int = config.MAX_ALERTS) -> DataFrame:
    """Every category's best few first, then the rest, up to limit; shown by risk, confidence, entity."""
    order = [F.desc("risk"), F.desc("confidence"), F.col("entity")]
    # A category's place needs only its best few, found as a bounded top-k of each.
    top = df.withColumn("_p", F.row_number().over(W.partitionBy("category").orderBy(*order))).withColumn("_slot", (F.col("_p") > per_category).cast("int"))
    return top.orderBy("_slot", *order).limit(limit).orderBy(*order).drop("_p", "_slot")


def top_features(df: DataFrame, stats: dict[str, tuple[float, float]], importance: dict[str, float], k: int = config.TOP_FEATURES) -> Column:
    """Array of (feature, contribution): importance times distance from the mean in deviations; the k largest, summing to 1."""
    parts = F.array(*(F.struct((F.lit(importance.get(c, 0.0)) * F.abs((F.col(c).cast("double") - m) / s)).alias("contribution"), F.lit(c).alias("feature")) for c, (m, s) in stats.items()))
    top = F.slice(F.reverse(F.sort_array(parts)), 1, k)
    total = F.aggregate(top, F.lit(0.0), lambda a, x: a + x["contribution"])
    return F.transform(top, lambda x: F.struct(x["feature"].alias("feature"), F.when(total > 0, x["contribution"] / total).otherwise(0.0).alias("contribution")))


def filter_alerts(df: DataFrame, min_risk: float = 0.0, kind: str | None = None, text: str | None = None, limit: int = 100) -> DataFrame:
    """Alerts by least risk, type and text in entity or reasons, strongest first; limit is kept within 1 to 500."""
    out = df.where(F.col("risk") >= min_risk)
    if kind:
        out = out.where(F.col("entity_type") == kind)
    if text:
        out = out.where(F.lower("entity").contains(text.lower()) | F.exists("reasons", lambda r: F.lower(r).contains(text.lower())))
    return out.orderBy(F.desc("risk"), F.desc("confidence"), "entity").limit(max(1, min(500, limit)))


def rollup(alerts: DataFrame, evidence: DataFrame, packets: DataFrame, key: str) -> DataFrame:
    """Alerts by network (geo_asn) or country: alerts (alert_id, entity, entity_type, risk), evidence (alert_id, geo_asn,
    geo_country, asn_org), packets (geo_asn, geo_country). Each alert counts once for a key."""
    missing = "unknown" if key == "geo_asn" else "??"
    fill = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    e = evidence.select("alert_id", fill("geo_asn", "unknown").alias("asn"), fill("geo_country", "??").alias("country"), fill("asn_org", "unknown operator").alias("org"))
    own = "asn" if key == "geo_asn" else "country"
    seen = e.select("alert_id", F.col(own).alias("key")).distinct().join(alerts, "alert_id")
    per = seen.groupBy("key").agg(F.count("*").alias("alerts"), F.count_if(F.col("entity_type") == "wallet").alias("wallet_alerts"), F.count_if(F.col("entity_type") != "wallet").alias("transaction_alerts"), F.count_distinct("entity").alias("entities"), F.max("risk").alias("max_risk"))
    who = e.groupBy(F.col(own).alias("key")).agg(F.sort_array(F.collect_set("country")).alias("countries"), F.sort_array(F.collect_set("org")).alias("orgs"), F.sort_array(F.collect_set("asn")).alias("asns"))
    n = packets.groupBy(fill(key, missing).alias("key")).agg(F.count("*").alias("packets"))
    out = per.join(who, "key").join(n, "key", "left").fillna(0, ["packets"])
    return (out.where("key <> '??'") if own == "country" else out).orderBy(F.desc("alerts"), F.desc("max_risk"), "key")


def focus_list(providers: DataFrame, limit: int = 5) -> DataFrame:
    """The first providers with their place and what to do."""
    top = providers.orderBy(F.desc("alerts"), F.desc("max_risk"), "key").limit(limit)
    place = F.row_number().over(W.orderBy(F.desc("alerts"), F.desc("max_risk"), "key"))  # at most limit rows
    return top.select(place.alias("rank"), "key", "alerts", "max_risk", F.when(F.col("alerts") >= 3, "contact provider").otherwise("monitor").alias("action"))
