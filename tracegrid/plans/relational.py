"""Registered queries: scans, scalars, joins, aggregates, windows, sorts and sets over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config
from ..functions import scalars as S
from ..operators import correlate as C
from ..operators import enrich as E
from ..operators import evidence as V
from ..operators import features as X
from ..sources import readers as R
from . import model as M

query = M.Registry()
us = lambda c: F.unix_micros(c)

GEO_VALUES = ", ".join(f"({i}, '{c}', '{a}', '{o}')" for i, (c, _, a, o) in enumerate(E.GEO_TABLE))
GEO_SQL = f"geo(i, country, asn, org) AS (VALUES {GEO_VALUES})"
IDX = "CAST(('0x' || substr(sha256({0}), 1, 8)) AS BIGINT) % 16"
ENRICHED_SQL = f"""{GEO_SQL},
enr AS (SELECT net.*, s.country sc, s.asn sa, s.org so, d.country dc, d.asn da FROM net JOIN geo s ON s.i = {IDX.format('src_ip')} JOIN geo d ON d.i = {IDX.format('dst_ip')})"""
CORR_SQL = """ex AS (SELECT net.rec, net.us, net.src_ip, net.dst_ip, pur.txid, (net.us - pur.us) / 1e6 delta, 'exact' AS meth, 1.0 conf, CAST(NULL AS BIGINT) cand FROM net JOIN pur ON net.txid = pur.txid),
near AS (SELECT net.rec, net.us, net.src_ip, net.dst_ip, pur.txid, pur.us pus, count(*) OVER (PARTITION BY rec) n, row_number() OVER (PARTITION BY rec ORDER BY abs(pur.us - net.us), pur.us, pur.txid) r
  FROM net JOIN pur ON pur.us BETWEEN net.us - 90000000 AND net.us + 90000000 WHERE net.txid NOT IN (SELECT txid FROM pur)),
co AS (SELECT * FROM ex UNION ALL SELECT rec, us, src_ip, dst_ip, txid, (pus - us) / 1e6, 'time_window', floor((1 - 0.5 * abs((pus - us) / 1e6) / 90) / sqrt(n) * 1e4 + 0.5) / 1e4, n FROM near WHERE r = 1)"""


def correlated(spark: SparkSession, d: str) -> DataFrame:
    return C.correlate(M.network(spark, d), M.purchases(spark, d))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return E.enrich_network(M.network(spark, d))


# ----------------------------------------------------------------- scans
def _scan_dir(spark: SparkSession, form: str) -> str:
    from ..operators.iterate import prepared

    prepared(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scan-{form}-{uuid.uuid4().hex}"


def _round_trip(spark: SparkSession, d: str, form: str, read) -> DataFrame:
    """The customer table written in a text format into the shared folder and read back by the scan under test."""
    path = _scan_dir(spark, form)
    rows = M.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("C CustKey"), F.col("c_name").alias("c_name"))
    if form == "csv":
        rows.write.option("header", True).csv(path)
    elif form == "xml":
        rows.withColumnRenamed("C CustKey", "c_custkey").write.format("xml").option("rowTag", "transaction").option("rootTag", "transactions").save(path)
    elif form == "json":
        # Documents of many lines: an array of objects for each bucket of rows, or an object that wraps a list.
        parts = rows.groupBy(F.pmod(F.col("C CustKey").cast("long"), F.lit(8)).alias("k")).agg(F.concat_ws(",\n  ", F.collect_list(F.to_json(F.struct("C CustKey", "c_name")))).alias("body"))
        parts = parts.repartition(8, "k")
        for name, odd, first, last in (("arrays", 0, "[\n  ", "\n]"), ("wrapped", 1, '{"transactions": [\n  ', "\n]}")):
            parts.where(F.col("k") % 2 == odd).select(F.concat(F.lit(first), "body", F.lit(last)).alias("value"), "k").write.partitionBy("k").text(f"{path}/{name}")
        return read(spark, f"{path}/arrays").select("c_custkey", "c_name").unionByName(read(spark, f"{path}/wrapped").select("c_custkey", "c_name"))
    else:
        rows.write.json(path)
    return read(spark, path).select("c_custkey", "c_name")


CUSTOMER_SQL = "SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name FROM customer"


@query("scan_csv", CUSTOMER_SQL, model=False)
def _(spark, d):
    return _round_trip(spark, d, "csv", R.read_csv)


@query("scan_jsonl", CUSTOMER_SQL, model=False)
def _(spark, d):
    return _round_trip(spark, d, "jsonl", R.read_jsonl)


@query("scan_json", CUSTOMER_SQL, model=False)
def _(spark, d):
    return _round_trip(spark, d, "json", R.read_json)


@query("scan_xml", CUSTOMER_SQL, model=False)
def _(spark, d):
    return _round_trip(spark, d, "xml", R.read_xml)


@query("scan_bundle", "SELECT 'transactions' kind, count(*) n, count(DISTINCT txid) ids, sum(len(inputs))::BIGINT touches FROM tx UNION ALL SELECT 'network', count(*), count(DISTINCT txid), 0 FROM (SELECT DISTINCT us, src_ip, dst_ip, txid FROM net)")
def _(spark, d):
    """All transactions as CSV, a quarter of them again as XML, and the network as JSON documents of some 20,000 records, read back as one bundle."""
    path = _scan_dir(spark, "bundle")
    lists = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    t = M.transactions(spark, d).select(stamp, "txid", F.array_join("inputs", "|").alias("input_addresses"), F.array_join("outputs", "|").alias("output_addresses"), lists("input_amounts").alias("input_amounts"), lists("output_amounts").alias("output_amounts"), F.col("fee").cast("string").alias("fee"), "script_type")
    t.write.option("header", True).csv(f"{path}/a-csv")
    t.where(F.pmod(F.xxhash64("txid"), F.lit(4)) == 0).write.format("xml").option("rowTag", "transaction").option("rootTag", "transactions").save(f"{path}/b-xml")
    n = M.network(spark, d)
    n = n.select(F.struct(stamp, "src_ip", "dst_ip", "txid", "protocol").alias("r"), F.pmod(F.xxhash64("rec"), F.lit(1 + n.count() // 20_000)).alias("k"))
    n.groupBy("k").agg(F.collect_list("r").alias("network")).repartition("k").write.partitionBy("k").json(f"{path}/c-json")
    tx, net, _ = R.load_bundle(spark, path)
    of = lambda df, kind, touches: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_distinct("txid").alias("ids"), touches.cast("long").alias("touches"))
    return of(tx, "transactions", F.sum(F.size("inputs"))).unionByName(of(net, "network", F.lit(0)))


@query("guess_kind", "SELECT 'transactions' kind UNION ALL SELECT 'network' UNION ALL SELECT 'mixed' UNION ALL SELECT 'unknown'", model=False)
def _(spark, d):
    tx, net = ["txid", "input_addresses", "output_addresses", "fee"], ["timestamp", "src_ip", "dst_ip", "protocol"]
    return spark.createDataFrame([(R.guess_kind(c),) for c in (tx, net, tx + net, ["timestamp", "txid"])], "kind string")


@query("split_mixed", "SELECT 'tx' part, txid, array_to_string(list_sort(inputs), '|') a, array_to_string(list_sort(outputs), '|') b, count(*) n FROM tx GROUP BY ALL UNION ALL SELECT 'net', txid, src_ip, dst_ip, count(*) FROM net GROUP BY ALL")
def _(spark, d):
    t = M.transactions(spark, d).select("txid", F.array_join("inputs", "|").alias("input_addresses"), F.array_join("outputs", "|").alias("output_addresses"), F.col("fee").cast("string").alias("fee"))
    n = M.network(spark, d).select("txid", "src_ip", "dst_ip", "protocol")
    tx, net = R.split_mixed(t.unionByName(n, allowMissingColumns=True))
    listed = lambda c: F.array_join(F.array_sort(F.split(c, r"\|")), "|")
    tx = tx.select(F.lit("tx").alias("part"), "txid", listed("input_addresses").alias("a"), listed("output_addresses").alias("b"))
    net = net.select(F.lit("net").alias("part"), "txid", F.col("src_ip").alias("a"), F.col("dst_ip").alias("b"))
    return tx.unionByName(net).groupBy("part", "txid", "a", "b").agg(F.count("*").alias("n"))


@query("norm_tx", "SELECT txid, CAST(len(inputs) AS INT) n_in, CAST(len(outputs) AS INT) n_out, floor(list_sum(output_amounts) * 100 + 0.5) / 100 total_out, script_type, us FROM tx")
def _(spark, d):
    raw = M.transactions(spark, d).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"), F.col("txid").alias("hash"), F.array_join("inputs", "|").alias("from_addresses"), F.array_join("outputs", "|").alias("to_addresses"),
        F.array_join(F.transform("input_amounts", lambda x: x.cast("string")), "|").alias("input_values"), F.array_join(F.transform("output_amounts", lambda x: x.cast("string")), "|").alias("output_values"), F.lower("script_type").alias("script"),
    )
    t = R.normalise_transactions(raw)
    return t.select("txid", F.size("inputs").alias("n_in"), F.size("outputs").alias("n_out"), M.cents(S.array_sum(F.col("output_amounts"))).alias("total_out"), "script_type", us("timestamp").alias("us"))


@query("norm_net", "SELECT src_ip, dst_ip, protocol, txid, us FROM net")
def _(spark, d):
    raw = M.network(spark, d).select(us("timestamp").alias("u"), F.col("src_ip").alias("srcip"), F.col("dst_ip").alias("destination_ip"), F.lower("protocol").alias("proto"), F.col("txid").alias("tx_id"))
    n = R.normalise_network(raw.withColumn("time", F.date_format(F.timestamp_micros("u"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return n.select("src_ip", "dst_ip", "protocol", "txid", us("timestamp").alias("us"))


@query("dedup_tx", "SELECT txid, us FROM tx")
def _(spark, d):
    t = M.transactions(spark, d).select("txid", "timestamp")
    twice = t.withColumn("_file", F.lit(1)).unionByName(t.select("txid", (F.col("timestamp") + F.expr("interval 1 day")).alias("timestamp"), F.lit(2).alias("_file")))
    return R.keep_first(twice, ["txid"], ["_file"]).select("txid", us("timestamp").alias("us"))


@query("dedup_net", "SELECT DISTINCT us, src_ip, dst_ip, txid FROM net")
def _(spark, d):
    n = M.network(spark, d).select("timestamp", "src_ip", "dst_ip", "txid")
    return n.unionAll(n).dropDuplicates().select(us("timestamp").alias("us"), "src_ip", "dst_ip", "txid")


# ----------------------------------------------------------------- scalars
@query("is_missing", "SELECT c_custkey, c_custkey % 5 < 3 missing FROM customer", model=False)
def _(spark, d):
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, " NaN ").when(k == 1, "").when(k == 2, F.lit(None)).otherwise(F.col("c_name"))
    return M.table(spark, d, "customer").select("c_custkey", S.is_missing(text).alias("missing"))


@query("split_list", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 1 ELSE 2 END n, o_orderstatus AS first FROM orders", model=False)
def _(spark, d):
    a, b, k = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(a, F.lit(" | "), b)).when(k == 1, F.concat(a, F.lit(";"), b)).when(k == 2, F.concat(F.lit("['"), a, F.lit("', '"), b, F.lit("']"))).otherwise(a)
    return M.table(spark, d, "orders").select("o_orderkey", F.size(S.split_list(text)).alias("n"), S.split_list(text)[0].alias("first"))


@query("split_amounts", "SELECT l_orderkey, l_linenumber, l_quantity a, 0.0::DOUBLE b, 0.0::DOUBLE c FROM lineitem", model=False)
def _(spark, d):
    amounts = S.split_amounts(F.concat(F.col("l_quantity").cast("string"), F.lit("|bad")), F.lit(3))
    return M.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", amounts[0].alias("a"), amounts[1].alias("b"), amounts[2].alias("c"))


@query("parse_timestamp", "SELECT event_id, epoch_us(date_trunc('second', ts)) us FROM events", model=False)
def _(spark, d):
    sec = F.floor(F.unix_micros("ts") / 1_000_000)
    k = F.col("event_id") % 3
    text = F.when(k == 0, sec.cast("string")).when(k == 1, (sec * 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return M.table(spark, d, "events").select("event_id", us(S.parse_timestamp(text)).alias("us"))


@query("to_number", "SELECT p_partkey, CAST(trunc(p_retailprice) AS INT) i, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE p_retailprice END f FROM part", model=False)
def _(spark, d):
    text = F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))
    bad = F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(text)
    return M.table(spark, d, "part").select("p_partkey", S.to_int(text).alias("i"), S.to_float(bad).alias("f"))


@query("is_private_ip", "SELECT event_id, (user_id % 4) IN (0, 1, 3) priv, CASE WHEN user_id % 4 = 3 THEN NULL ELSE 4 END ver FROM events", model=False)
def _(spark, d):
    k = F.col("user_id") % 4
    n = (F.col("event_id") % 256).cast("string")
    ip = F.when(k == 0, F.concat(F.lit("10.1.2."), n)).when(k == 1, F.concat(F.lit("172.31.9."), n)).when(k == 2, F.concat(F.lit("8.8.4."), n)).otherwise(F.concat(F.lit("300.1.1."), n))
    return M.table(spark, d, "events").select("event_id", S.is_private_ip(ip).alias("priv"), S.ip_version(ip).alias("ver"))


@query("window_confidence", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 > 90 THEN 0.0 ELSE floor((1 - 0.5 * l_quantity * 2 / 90) / sqrt(l_linenumber) * 1e6 + 0.5) / 1e6 END conf FROM lineitem", model=False)
def _(spark, d):
    return M.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.rnd(S.window_confidence(F.col("l_quantity") * 2, F.col("l_linenumber"))).alias("conf"))


@query("clamp_safe_div", "SELECT s_suppkey, greatest(0, least(1, s_acctbal / 5000)) clamped, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_acctbal / (s_suppkey % 3) END ratio FROM supplier", model=False)
def _(spark, d):
    return M.table(spark, d, "supplier").select("s_suppkey", S.clamp(F.col("s_acctbal") / 5000).alias("clamped"), S.safe_div(F.col("s_acctbal"), F.col("s_suppkey") % 3).alias("ratio"))


@query("script_index", "SELECT txid, CAST(CASE script_type WHEN 'P2PKH' THEN 0 WHEN 'P2SH' THEN 1 WHEN 'P2WPKH' THEN 2 WHEN 'P2TR' THEN 4 ELSE 5 END AS INT) idx FROM tx")
def _(spark, d):
    return M.transactions(spark, d).select("txid", S.script_index(F.col("script_type")).alias("idx"))


@query("short_id", "SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN left(p_name, 4) || '…' || right(p_name, 4) ELSE p_name END short FROM part", model=False)
def _(spark, d):
    return M.table(spark, d, "part").select("p_partkey", S.short_id(F.col("p_name"), 4).alias("short"))


@query("node_label", "SELECT c_custkey, left(c_name, 8) || '...' || right(c_name, 4) wallet_label, left(c_name, 14) tx_label FROM customer", model=False)
def _(spark, d):
    return M.table(spark, d, "customer").select("c_custkey", S.node_label(F.col("c_name"), F.lit("wallet")).alias("wallet_label"), S.node_label(F.col("c_name"), F.lit("txid")).alias("tx_label"))


@query("format_btc", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN format('{:,.4f}', CAST(p_size AS DOUBLE)) || ' BTC' ELSE format('{:,.4f}', p_size / 1e5 * 1e3) || ' mBTC' END t FROM part WHERE p_size >= 10 AND p_size < 100", model=False)
def _(spark, d):
    amount = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_size") / 1e5)
    mbtc = F.when(F.col("p_partkey") % 2 == 0, S.format_btc(amount)).otherwise(F.concat(F.format_number(amount * 1e3, 4), F.lit(" mBTC")))
    return M.table(spark, d, "part").where("p_size >= 10 and p_size < 100").select("p_partkey", mbtc.alias("t"))


@query("sortable_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') stamp FROM events", model=False)
def _(spark, d):
    return M.table(spark, d, "events").select("event_id", S.sortable_stamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("stamp"))


@query("risk_band", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 >= 0.85 THEN 'critical' WHEN l_quantity / 50 >= 0.7 THEN 'high' WHEN l_quantity / 50 >= 0.5 THEN 'medium' WHEN l_quantity / 50 >= 0.3 THEN 'low' ELSE 'minimal' END band FROM lineitem", model=False)
def _(spark, d):
    return M.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.risk_band(F.col("l_quantity") / 50).alias("band"))


@query("sha256_hex", "SELECT c_custkey, sha256(c_name) h FROM customer", model=False)
def _(spark, d):
    return M.table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("h"))


@query("alert_id", "SELECT c_custkey, 'CT-W-' || upper(substr(sha256('wallet:' || c_name || ':' || c_custkey), 1, 8)) id FROM customer", model=False)
def _(spark, d):
    return M.table(spark, d, "customer").select("c_custkey", S.alert_id(F.lit("wallet"), F.col("c_name"), F.col("c_custkey")).alias("id"))


@query("rules_verdict", "SELECT txid, list_filter([CASE WHEN len(inputs) >= 5 THEN 'many inputs' END, CASE WHEN len(outputs) >= 5 THEN 'many outputs' END, CASE WHEN list_max(output_amounts) >= 50000 THEN 'large' END], lambda x: x IS NOT NULL)::VARCHAR[] AS rules FROM tx".replace("list_filter(", "array_to_string(list_filter(").replace("::VARCHAR[] AS rules", ", ',') AS rules"))
def _(spark, d):
    rules = F.array_compact(F.array(F.when(F.size("inputs") >= 5, "many inputs"), F.when(F.size("outputs") >= 5, "many outputs"), F.when(F.array_max("output_amounts") >= 50000, "large")))
    return M.transactions(spark, d).select("txid", F.array_join(rules, ",").alias("rules"))


# ----------------------------------------------------------------- enrichment and joins
@query("geoip_lookup", f"{GEO_SQL} SELECT rec, country, asn, org FROM net JOIN geo ON i = {IDX.format('src_ip')}")
def _(spark, d):
    return E.lookup(M.network(spark, d), "src_ip").select("rec", F.col("geo_country").alias("country"), F.col("geo_asn").alias("asn"), F.col("asn_org").alias("org"))


@query("join_geo_lookup", f"{ENRICHED_SQL} SELECT rec, sc, dc FROM enr")
def _(spark, d):
    return E.lookup(E.lookup(M.network(spark, d), "src_ip", "s_"), "dst_ip", "d_").select("rec", F.col("s_geo_country").alias("sc"), F.col("d_geo_country").alias("dc"))


@query("enrich_net", f"{ENRICHED_SQL} SELECT rec, sc, sa, dc, da, sc <> dc cross_border, false src_is_private, 4 ip_version FROM enr")
def _(spark, d):
    e = enriched(spark, d)
    return e.select("rec", F.col("src_geo_country").alias("sc"), F.col("src_geo_asn").alias("sa"), F.col("dst_geo_country").alias("dc"), F.col("dst_geo_asn").alias("da"), "cross_border", "src_is_private", "ip_version")


@query("prefer_existing", f"{ENRICHED_SQL} SELECT rec, CASE WHEN rec % 3 = 0 THEN 'ZZ' ELSE sc END country FROM enr")
def _(spark, d):
    n = M.network(spark, d).withColumn("geo_country", F.when(F.col("rec") % 3 == 0, "ZZ").when(F.col("rec") % 3 == 1, " "))
    return E.enrich_network(n).select("rec", F.col("geo_country").alias("country"))


@query("enrich_summary", f"{ENRICHED_SQL} SELECT count(*) records, count(DISTINCT sc) countries, count(DISTINCT sa) asns, count(*) FILTER (sc <> dc) cross_border FROM enr")
def _(spark, d):
    return E.summary(enriched(spark, d))


@query("join_txid_exact", f"{CORR_SQL} SELECT rec, txid, delta FROM ex")
def _(spark, d):
    return C.exact(M.network(spark, d), M.purchases(spark, d)).select("rec", "txid", F.col("time_delta_seconds").alias("delta"))


@query("join_time_window", f"{CORR_SQL} SELECT rec, txid, delta, conf, cand FROM co WHERE meth = 'time_window'")
def _(spark, d):
    net, tx = M.network(spark, d), M.purchases(spark, d)
    rest = net.join(tx.select("txid"), "txid", "left_anti")
    return C.in_window(rest, tx).select("rec", "txid", F.col("time_delta_seconds").alias("delta"), F.col("correlation_confidence").alias("conf"), F.col("window_candidates").alias("cand"))


@query("correlate", f"{CORR_SQL} SELECT rec, txid, delta, meth, conf FROM co")
def _(spark, d):
    return correlated(spark, d).select("rec", "txid", F.col("time_delta_seconds").alias("delta"), F.col("correlation_method").alias("meth"), F.col("correlation_confidence").alias("conf"))


@query("corr_per_tx", f"{CORR_SQL} SELECT txid, max(conf) confidence, min(meth) AS method, count(*) n_records, floor(avg(delta) * 1e4 + 0.5) / 1e4 mean_delta FROM co GROUP BY txid")
def _(spark, d):
    return C.per_transaction(correlated(spark, d)).withColumn("mean_delta", M.rnd(F.col("mean_delta"), 4))


@query("corr_summary", f"{CORR_SQL} SELECT count(*) pairs, count(*) FILTER (meth = 'exact') AS exact, count(*) FILTER (meth = 'time_window') time_window, count(DISTINCT txid) transactions, round(avg(conf), 4) mean_confidence FROM co")
def _(spark, d):
    return C.summary(correlated(spark, d))


CORR_GEO_SQL = f"{CORR_SQL}, {GEO_SQL}, cg AS (SELECT co.*, country FROM co JOIN geo ON i = {IDX.format('src_ip')})"


def correlated_geo(spark: SparkSession, d: str) -> DataFrame:
    return C.correlate(enriched(spark, d), M.purchases(spark, d))


@query("corr_feat_agg", f"{CORR_GEO_SQL} SELECT txid, max(conf) confidence, count(*) n, floor(avg(abs(delta)) * 1e4 + 0.5) / 1e4 mean_abs, arg_min(country, (-conf, rec)) country FROM cg GROUP BY txid".replace("arg_min(country, (-conf, rec))", "first(country ORDER BY conf DESC, rec)"))
def _(spark, d):
    a = C.feature_aggregate(correlated_geo(spark, d))
    return a.select("txid", F.col("correlation_confidence").alias("confidence"), F.col("n_network_records").alias("n"), M.rnd(F.col("mean_time_delta_seconds"), 4).alias("mean_abs"), F.col("geo_country").alias("country"))


@query("join_tx_geo", f"{CORR_GEO_SQL} SELECT pur.txid, g.country FROM pur LEFT JOIN (SELECT txid, first(country ORDER BY conf DESC, us, rec) country FROM cg GROUP BY txid) g ON g.txid = pur.txid")
def _(spark, d):
    geo = C.first_geo(correlated_geo(spark, d))
    return M.purchases(spark, d).join(geo, "txid", "left").select("txid", F.col("geo_country").alias("country"))


@query("semi_seed", "SELECT txid, wallet, side FROM flows WHERE wallet IN (SELECT wallet FROM seeds)")
def _(spark, d):
    return M.flows(M.transactions(spark, d)).join(M.seeds(spark, d), "wallet", "left_semi").select("txid", "wallet", "side")


@query("join_bulk", "SELECT rec, net.us, pur.us tx_us FROM net LEFT JOIN pur ON net.txid = pur.txid UNION ALL SELECT NULL, us, us FROM pur")
def _(spark, d):
    p = M.purchases(spark, d).select("txid", us("timestamp").alias("tx_us"))
    n = M.network(spark, d).select("rec", us("timestamp").alias("us"), "txid").join(p, "txid", "left")
    return n.select("rec", "us", "tx_us").unionByName(p.select(F.lit(None).cast("long").alias("rec"), F.col("tx_us").alias("us"), "tx_us"))


@query("anti_untracked", "SELECT txid FROM tx WHERE txid NOT IN (SELECT txid FROM flows WHERE wallet IN (SELECT wallet FROM seeds))")
def _(spark, d):
    t = M.transactions(spark, d)
    tracked = M.flows(t).join(M.seeds(spark, d), "wallet", "left_semi").select("txid")
    return t.select("txid").join(tracked, "txid", "left_anti")


# ----------------------------------------------------------------- aggregates
@query("value_conservation", "SELECT count(*) n, count(*) FILTER (abs(list_sum(input_amounts) - list_sum(output_amounts) - fee) <= 1e-6) conserved, count(*) FILTER (fee > 0) with_fee, count(DISTINCT txid) ids FROM tx")
def _(spark, d):
    gap = F.abs(S.array_sum(F.col("input_amounts")) - S.array_sum(F.col("output_amounts")) - F.col("fee"))
    return M.transactions(spark, d).agg(F.count("*").alias("n"), F.count_if(gap <= 1e-6).alias("conserved"), F.count_if(F.col("fee") > 0).alias("with_fee"), F.count_distinct("txid").alias("ids"))


FEATURES_SQL = """cv AS (SELECT *, list_sum(input_amounts) ti, list_sum(output_amounts) tout, list_avg(output_amounts) om, list_avg(input_amounts) im, list_sort(output_amounts, 'DESC') os FROM tx)
SELECT txid, CAST(len(inputs) AS INT) num_inputs, CAST(len(outputs) AS INT) num_outputs, floor(ti * 100 + 0.5) / 100 total_input, floor(fee / ti * 1e6 + 0.5) / 1e6 fee_ratio, floor(os[1] / tout * 1e6 + 0.5) / 1e6 amount_ratio,
 floor(coalesce(list_stddev_pop(output_amounts), 0) / om * 1e6 + 0.5) / 1e6 out_amount_cv, floor(coalesce(list_stddev_pop(input_amounts), 0) / im * 1e6 + 0.5) / 1e6 in_amount_cv, floor(len(inputs) / len(outputs) * 1e6 + 0.5) / 1e6 io_ratio,
 CAST(len(inputs) = 1 AND len(outputs) = 2 AS INT) is_1in_2out, CAST(len(inputs) <= 2 AND len(outputs) >= 8 AS INT) is_fan_out, CAST(len(inputs) >= 8 AND len(outputs) <= 2 AS INT) is_consolidation,
 floor(os[1] / greatest(os[1] + coalesce(os[2], 0), 1e-9) * 1e6 + 0.5) / 1e6 asymmetry, floor(ln(1 + ti) * 1e6 + 0.5) / 1e6 log_total_input FROM cv"""


@query("tx_features", FEATURES_SQL)
def _(spark, d):
    f = X.transaction_features(M.transactions(spark, d))
    r = lambda c: M.rnd(F.col(c)).alias(c)
    return f.select("txid", "num_inputs", "num_outputs", M.cents(F.col("total_input")).alias("total_input"), r("fee_ratio"), r("amount_ratio"), r("out_amount_cv"), r("in_amount_cv"), r("io_ratio"), "is_1in_2out", "is_fan_out", "is_consolidation", r("asymmetry"), r("log_total_input"))


@query("wallet_fan", "SELECT wallet, CAST(coalesce(max(len(inputs)) FILTER (side = 'in'), 0) AS INT) max_fan_in, CAST(coalesce(max(len(outputs)) FILTER (side = 'out'), 0) AS INT) max_fan_out FROM flows JOIN tx USING (txid) GROUP BY wallet")
def _(spark, d):
    t = M.transactions(spark, d)
    return X.fans(M.flows(t), t)


@query("peel_like_fraction", "SELECT wallet, floor(avg(CASE WHEN len(inputs) = 1 AND len(outputs) = 2 AND list_max(output_amounts) / list_sum(output_amounts) > 0.75 THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5) / 1e6 fraction FROM (SELECT DISTINCT txid, wallet FROM flows WHERE side = 'in') JOIN tx USING (txid) GROUP BY wallet")
def _(spark, d):
    t = M.transactions(spark, d)
    return X.peel_like_fraction(M.flows(t), t).select("wallet", M.rnd(F.col("fraction_of_peel_like_txs")).alias("fraction"))


@query("spend_index", "SELECT wallet, array_to_string(list(txid ORDER BY us, txid), ' ') txids FROM (SELECT DISTINCT wallet, us, txid FROM flows WHERE side = 'in') GROUP BY wallet")
def _(spark, d):
    return X.spend_index(M.flows(M.transactions(spark, d))).select("wallet", F.array_join("txids", " ").alias("txids"))


PUR_WALLET_SQL = "sp AS (SELECT CAST(event_id AS VARCHAR) txid, 'U' || user_id wallet FROM events WHERE event_type = 'purchase')"


@query("wallet_ips", f"{CORR_GEO_SQL}, {PUR_WALLET_SQL} SELECT wallet, count(DISTINCT ip) n_correlated_ips, count(DISTINCT country) distinct_source_countries FROM (SELECT wallet, unnest([src_ip, dst_ip]) ip, country FROM sp JOIN cg USING (txid)) GROUP BY wallet")
def _(spark, d):
    spends = M.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("txid"), F.concat(F.lit("U"), "user_id").alias("wallet"), F.lit("in").alias("side"))
    return X.wallet_addresses(spends, correlated_geo(spark, d))


@query("join_wallet_ips", f"{CORR_SQL}, {PUR_WALLET_SQL} SELECT wallet, txid, src_ip FROM sp JOIN co USING (txid)")
def _(spark, d):
    spends = M.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("txid"), F.concat(F.lit("U"), "user_id").alias("wallet"))
    return spends.join(correlated(spark, d), "txid").select("wallet", "txid", "src_ip")


@query("column_stats", "SELECT floor(avg(l_quantity) * 1e4 + 0.5) / 1e4 m_quantity, floor(stddev_pop(l_quantity) * 1e4 + 0.5) / 1e4 s_quantity, floor(avg(l_discount) * 1e4 + 0.5) / 1e4 m_discount, floor(stddev_pop(l_discount) * 1e4 + 0.5) / 1e4 s_discount FROM lineitem", model=False)
def _(spark, d):
    from ..operators.anomaly import column_stats

    s = column_stats(M.table(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    row = [x for c in ("l_quantity", "l_discount") for x in s[c]]
    return spark.createDataFrame([tuple(row)], "a double, b double, c double, e double").select(*(M.rnd(F.col(c), 4).alias(n) for c, n in zip("abce", ("m_quantity", "s_quantity", "m_discount", "s_discount"), strict=True)))


@query("bench_scores", "SELECT o_orderpriority level, count(*) FILTER (flag AND truth) tp, count(*) FILTER (flag AND NOT truth) fp, count(*) FILTER (NOT flag AND truth) fn, floor(count(*) FILTER (flag AND truth) / greatest(count(*) FILTER (truth), 1) * 1e6 + 0.5) / 1e6 recall FROM (SELECT o_orderpriority, o_totalprice > 200000 flag, o_orderkey % 3 = 0 truth FROM orders) GROUP BY 1", model=False)
def _(spark, d):
    o = M.table(spark, d, "orders").select(F.col("o_orderpriority").alias("level"), (F.col("o_totalprice") > 200000).alias("flag"), (F.col("o_orderkey") % 3 == 0).alias("truth"))
    return bench_scores(o, "level")


def bench_scores(rows: DataFrame, level: str) -> DataFrame:
    """Hits, false alarms, misses and recall of flag against truth, by level."""
    f, t = F.col("flag"), F.col("truth")
    tp = F.count_if(f & t)
    return rows.groupBy(level).agg(tp.alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"), M.rnd(tp / F.greatest(F.count_if(t), F.lit(1))).alias("recall"))


@query("api_stats", "SELECT count(*) alerts, count(*) FILTER (l_discount * 10 >= 0.5) medium, count(*) FILTER (l_discount * 10 >= 0.7) high, count(*) FILTER (l_returnflag = 'R') wallets FROM lineitem", model=False)
def _(spark, d):
    r = F.col("l_discount") * 10
    return M.table(spark, d, "lineitem").agg(F.count("*").alias("alerts"), F.count_if(r >= 0.5).alias("medium"), F.count_if(r >= 0.7).alias("high"), F.count_if(F.col("l_returnflag") == "R").alias("wallets"))


@query("first_seen", "SELECT wallet, min(us) us FROM flows GROUP BY wallet UNION ALL SELECT txid, us FROM tx")
def _(spark, d):
    t = M.transactions(spark, d)
    ends = M.flows(t).select(F.explode(F.array("wallet", "txid")).alias("wallet"), "timestamp")
    return ends.groupBy("wallet").agg(us(F.min("timestamp")).alias("us"))


@query("replay_counts", "SELECT day, count(*) new_wallets, CAST(sum(count(*)) OVER (ORDER BY day) AS BIGINT) visible FROM (SELECT wallet, min(us) // 2592000000000 AS day FROM flows GROUP BY wallet) GROUP BY day")
def _(spark, d):
    seen = M.flows(M.transactions(spark, d)).groupBy("wallet").agg(F.floor(us(F.min("timestamp")) / 2_592_000_000_000).alias("day"))
    per = seen.groupBy("day").agg(F.count("*").alias("new_wallets"))  # a few months
    return per.withColumn("visible", F.sum("new_wallets").over(W.orderBy("day")))


# ----------------------------------------------------------------- windows
@query("burstiness", "SELECT wallet, max(n) burstiness FROM (SELECT wallet, count(*) OVER (PARTITION BY wallet ORDER BY us RANGE BETWEEN 2592000000000 PRECEDING AND CURRENT ROW) n FROM flows) GROUP BY wallet")
def _(spark, d):
    return X.burstiness(M.flows(M.transactions(spark, d)), 30 * 86400)


@query("burst_60s", "SELECT wallet, max(n) burstiness FROM (SELECT 'U' || user_id wallet, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) n FROM events) GROUP BY wallet", model=False)
def _(spark, d):
    return X.burstiness(M.table(spark, d, "events").select(F.concat(F.lit("U"), "user_id").alias("wallet"), F.col("ts").alias("timestamp")))


@query("rank_normalise", "SELECT c_custkey, floor((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) / greatest(count(*) OVER () - 1, 1) * 1e9 + 0.5) / 1e9 r FROM customer", model=False)
def _(spark, d):
    from ..operators.anomaly import rank_normalise

    return rank_normalise(M.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", "r").select("c_custkey", M.rnd(F.col("r"), 9).alias("r"))


@query("quantile_flag", "SELECT c_custkey, c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.94) FROM customer) flag FROM customer", model=False)
def _(spark, d):
    from ..operators.anomaly import quantile_flag

    return quantile_flag(M.table(spark, d, "customer"), "c_acctbal", out="flag").select("c_custkey", "flag")


@query("event_step", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) step FROM events", model=False)
def _(spark, d):
    return M.table(spark, d, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"))


@query("timeline_slot", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 slot FROM orders", model=False)
def _(spark, d):
    from ..operators.focus import timeline_offset

    return timeline_offset(M.table(spark, d, "orders"), ["o_orderdate"], ["o_orderkey"]).select("o_orderkey", "slot")


@query("top5_corr", f"{CORR_SQL} SELECT txid, array_to_string(list(rec ORDER BY r), ' ') recs FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY conf DESC, us, rec) r FROM co) WHERE r <= 5 GROUP BY txid")
def _(spark, d):
    r = F.row_number().over(W.partitionBy("txid").orderBy(F.desc("correlation_confidence"), "timestamp", "rec"))
    top = correlated(spark, d).withColumn("r", r).where("r <= 5")
    return top.groupBy("txid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "rec"))), lambda x: x["rec"].cast("string")), " ").alias("recs"))


@query("chain_link_check", "SELECT o_orderkey, coalesce(lag(h) OVER (ORDER BY o_orderkey), repeat('0', 64)) prev FROM (SELECT o_orderkey, sha256(o_orderstatus || o_orderkey) h FROM orders)", model=False)
def _(spark, d):
    """Over all orders, in ranges of the key; each starts from the last hash of the range before."""
    o = M.table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat("o_orderstatus", F.col("o_orderkey").cast("string")), 256).alias("h"))
    return V.previous(o, "o_orderkey", "h", "prev", V.GENESIS)


@query("diversity_rank", "SELECT o_orderkey, o_orderpriority, p FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) p FROM orders) ORDER BY CASE WHEN p <= 2 THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 60", model=False)
def _(spark, d):
    p = F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    o = M.table(spark, d, "orders").withColumn("p", p)
    return o.orderBy(F.when(F.col("p") <= 2, 0).otherwise(1), F.desc("o_totalprice"), "o_orderkey").limit(config.MAX_ALERTS).select("o_orderkey", "o_orderpriority", "p")


# ----------------------------------------------------------------- top-k and sets
@query("api_alerts_topn", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", model=False)
def _(spark, d):
    return M.table(spark, d, "orders").where("o_totalprice >= 100000").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("ledger_page", "SELECT o_orderkey, (SELECT count(*) FROM orders) total FROM orders ORDER BY o_orderkey LIMIT 25", model=False)
def _(spark, d):
    o = M.table(spark, d, "orders").select("o_orderkey")
    return o.orderBy("o_orderkey").limit(25).withColumn("total", F.lit(o.count()))


@query("set_union_flags", "SELECT txid FROM tx WHERE len(inputs) >= 4 UNION SELECT txid FROM tx WHERE fee < 100")
def _(spark, d):
    t = M.transactions(spark, d)
    return t.where(F.size("inputs") >= 4).select("txid").union(t.where("fee < 100").select("txid")).distinct()


@query("set_intersect_truth", "SELECT txid FROM tx WHERE len(inputs) >= 3 INTERSECT SELECT txid FROM tx WHERE len(outputs) >= 3")
def _(spark, d):
    t = M.transactions(spark, d)
    return t.where(F.size("inputs") >= 3).select("txid").intersect(t.where(F.size("outputs") >= 3).select("txid"))


@query("set_except_unlabelled", "SELECT txid FROM tx WHERE len(inputs) >= 3 EXCEPT SELECT txid FROM tx WHERE len(outputs) >= 3")
def _(spark, d):
    t = M.transactions(spark, d)
    return t.where(F.size("inputs") >= 3).select("txid").subtract(t.where(F.size("outputs") >= 3).select("txid"))
