"""Hand-written cases for operators that SQL can't show, and for edge cases."""

from __future__ import annotations

import csv
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.functions import bitcoin, scalars
from tracegrid.operators import alerts, anomaly, clustering, correlate, evidence, focus, graph, iterate, peeling
from tracegrid.sources import readers

TX = "timestamp string, txid string, inputs array<string>, outputs array<string>, input_amounts array<double>, output_amounts array<double>, fee double, script_type string"


def tx_frame(spark, rows):
    return spark.createDataFrame(rows, TX).withColumn("timestamp", F.to_timestamp("timestamp"))


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("a|b", ["a", "b"]), ("a;b", ["a", "b"]), ("a,b", ["a", "b"]), ('["a","b"]', ["a", "b"]), ("['a','b']", ["a", "b"]), ("x", ["x"]), ("", []), ("nan", []), ("[]", [])])
def test_split_list(spark, text, want):
    assert one(spark, scalars.split_list(F.col("t")), t=text) == want


@pytest.mark.parametrize("delta,n,want", [(0.0, 1, 1.0), (90.0, 1, 0.5), (45.0, 4, 0.375), (91.0, 1, 0.0)])
def test_window_confidence(spark, delta, n, want):
    assert one(spark, scalars.window_confidence(F.col("d"), F.col("n")), d=delta, n=n) == pytest.approx(want)


def test_private_addresses(spark):
    rows = [("10.0.0.1", True, 4), ("172.15.0.1", False, 4), ("8.8.8.8", False, 4), ("::1", True, 6), ("2606:4700::1", False, 6), ("nonsense", True, None), (None, True, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "ip string").select(scalars.is_private_ip(F.col("ip")).alias("p"), scalars.ip_version(F.col("ip")).alias("v"))
    assert [(r.p, r.v) for r in df.collect()] == [r[1:] for r in rows]


def test_normaliser_drops_broken_rows_and_infers_fee(spark):
    raw = spark.createDataFrame([("2026-09-01T00:00:00", "ok1", "a|b", "1.0|2.0", "c", "2.9", None), ("bad", "t2", "a", "1", "b", "1", None), ("2026-09-01", "t3", "", "", "", "", None)], "time string, txid string, inputs string, input_amounts string, outputs string, output_amounts string, fee string")
    got = readers.normalise_transactions(raw).collect()
    assert [(r.txid, r.inputs, r.fee) for r in got] == [("ok1", ["a", "b"], pytest.approx(0.1))]


def test_bundle_reads_all_formats_once(spark, tmp_path):
    rows = [{"timestamp": "2026-09-01T00:00:00", "txid": f"t{i}", "input_addresses": "a|b", "output_addresses": "c", "input_amounts": "1|2", "output_amounts": "2.5"} for i in range(3)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        w = csv.DictWriter(f, rows[0])
        w.writeheader()
        w.writerows(rows)
    (tmp_path / "b.json").write_text(json.dumps({"transactions": rows}))
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "d.xml").write_text("<transactions>" + "".join(f"<transaction><timestamp>{r['timestamp']}</timestamp><txid>x{i}</txid><inputs><address>a</address><address>b</address></inputs><outputs><address>c</address></outputs></transaction>" for i, r in enumerate(rows)) + "</transactions>")
    (tmp_path / "seeds.json").write_text(json.dumps({"wallets": ["a"], "seed": 1}))
    (tmp_path / "broken.json").write_text("{")
    tx, net, seeds = readers.load_bundle(spark, str(tmp_path))
    got = {r.txid: r.inputs for r in tx.collect()}
    assert got == {**{f"t{i}": ["a", "b"] for i in range(3)}, **{f"x{i}": ["a", "b"] for i in range(3)}} and net is None and seeds == ["a"]


def test_repeated_addresses_make_one_edge(spark):
    t = tx_frame(spark, [("2026-01-01", "t", ["W1", "W1"], ["W2", "W2"], [0.4, 0.6], [0.75, 0.25], 0.0, "P2PKH")])
    from tracegrid.plans.model import flows

    e = {r.edge_type: (r.amount, r.occurrences) for r in graph.flow_edges(flows(t)).collect()}
    assert e == {"in": (1.0, 2), "out": (1.0, 2)}
    s = {r.wallet: r for r in graph.wallet_stats(flows(t)).collect()}
    assert s["W1"].total_out == 1.0 and s["W2"].total_in == 1.0 and s["W1"].tx_count == 2
    assert clustering.common_input(t).collect()[0].component == "W1"


def test_window_join_ties_and_bounds(spark):
    net = spark.createDataFrame([(1, "2026-01-01 00:01:30", ""), (2, "2026-01-01 00:10:00", "")], "rec long, timestamp string, txid string").withColumn("timestamp", F.to_timestamp("timestamp"))
    tx = spark.createDataFrame([("b", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:03:00"), ("c", "2026-01-01 00:00:00")], "txid string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    got = correlate.in_window(net, tx).collect()
    assert [(r.rec, r.txid, r.time_delta_seconds, r.window_candidates) for r in got] == [(1, "b", -90.0, 3)]


def peel_rows(n=5):
    rows, value = [], 10.0
    for i in range(n):
        rows.append((f"2026-01-01 0{i}:00:00", f"p{i}", [f"w{i}"], [f"w{i + 1}", f"x{i}"], [value], [value * 0.88, value * 0.12], 0.0, "P2PKH"))
        value *= 0.88
    return rows


def test_planted_peel_chain_is_found(spark):
    t = tx_frame(spark, [*peel_rows(), ("2026-01-02", "n", ["q"], ["r", "s"], [1.0], [0.5, 0.5], 0.0, "P2PKH")])
    c = peeling.candidates(t)
    chains = peeling.pick_chains(peeling.walks(c, peeling.next_hops(c))).collect()
    assert [r.txids for r in chains] == [[f"p{i}" for i in range(5)]]
    scored = peeling.chain_scores(spark.createDataFrame(chains), c, spark.createDataFrame([("w0",)], "wallet string")).first()
    assert scored.starts_at_seed == 1 and 0 < scored.score <= 1


def test_mixing_needs_distinct_inputs(spark):
    even = [1.0, 1.01, 0.99, 1.0, 1.0]
    rows = [("2026-01-01", "m", list("abcde"), list("fghij"), [1.1] * 5, even, 0.0, ""), ("2026-01-01", "r", ["a"] * 5, list("fghij"), [1.1] * 5, even, 0.0, ""), ("2026-01-01", "u", list("abcde"), list("fghij"), [1.1] * 5, [5.0, 0.1, 0.1, 0.1, 0.1], 0.0, "")]
    assert [r.txid for r in peeling.mixing(tx_frame(spark, rows)).collect()] == ["m"]


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 120, (90, 2))]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in iterate.connected_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {x: find(x) for p in pairs for x in p}


def test_proximity_decays_by_hop_and_pagerank_sums_to_one(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    got = {r.id: (round(r.proximity, 6), r.hops) for r in iterate.hub_proximity(pairs, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"a": (1.0, 0), "b": (0.7, 1), "c": (0.49, 2), "d": (0.343, 3)}
    e = pairs.select(F.col("a").alias("source"), F.col("b").alias("target"))
    ranks = iterate.pagerank(e, spark.createDataFrame([(x,) for x in "abcd"], "id string"))
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_forest_ranks_planted_outlier_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (300, 2)))] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    top = anomaly.isolation_forest(df, "id", ["x", "y"], trees=60).orderBy(F.desc("iso")).first()
    assert top.id == 999 and top.iso > 0.6
    blended = anomaly.blend(anomaly.isolation_forest(df, "id", ["x", "y"], trees=20), "id", lof_column=None)
    n = len(rows)
    assert blended.where("is_anomaly").count() == n - math.ceil(0.94 * (n - 1))


def test_forest_is_saved_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", float(i % 7), float(i * i % 11)) for i in range(200)], "id string, a double, b double")
    model = anomaly.grow_forest(rows, "id", ["a", "b"], trees=10)
    anomaly.save_model(spark, model, str(tmp_path / "model"))
    again = anomaly.load_model(spark, str(tmp_path / "model"))
    scores = lambda m: {r.id: r.iso for r in anomaly.score_forest(rows, "id", m).collect()}
    assert scores(again) == scores(model) == {r.id: r.iso for r in anomaly.isolation_forest(rows, "id", ["a", "b"], trees=10).collect()}


def test_newest_folder(spark, tmp_path):
    import os

    for i, name in enumerate(("b", "a")):
        (tmp_path / name).mkdir()
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert readers.latest_folder(spark, str(tmp_path)).endswith("/a") and readers.latest_folder(spark, str(tmp_path / "none")) is None


def test_louvain_splits_two_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 0.1)]
    df = spark.createDataFrame(pairs, "a string, b string, weight double")
    labels = clustering.louvain(df)
    got = {r.id: r.community for r in labels.collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]
    assert clustering.modularity(df, labels) > 0.4


def test_single_signal_score_confidence_and_counterfactuals(spark):
    row = spark.createDataFrame([("e", "wallet", 1.0, 0.0, 0.0, 0.0, 0.0, 1, False, False, None, 0)], "entity string, entity_type string, risk_score double, anomaly_score double, peel_score double, mixing_score double, correlation_confidence double, cluster_size int, cluster_tainted boolean, is_seed boolean, hops_to_seed int, peel_chain_length int")
    a = alerts.score_alerts(row).first()
    assert a.risk == pytest.approx(0.95) and a.confidence == pytest.approx(0.6 + 0.4 / 3, abs=1e-6)
    assert a.counterfactuals[0].decisive and a.counterfactuals[0].score_without <= a.risk and a.assessment == "corroborated"


def test_ledger_shows_where_it_was_edited():
    stamped = [evidence.stamp({"alert_id": i, "entity": f"e{i}", "risk_score": 0.5, "x": float("nan")}) for i in range(5)]
    entries = evidence.ledger(stamped, "2026-01-01")
    assert all(map(evidence.verify, stamped)) and entries[0]["prev_hash"] == evidence.GENESIS
    assert evidence.verify_ledger(entries)["ok"]
    assert evidence.verify_ledger(evidence.tampered(entries))["first_break"] == 3


def test_address_codecs():
    address = "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"
    program = bytes.fromhex("751e76e8199196d454941c45d1b3a323f1433bd6")
    assert bitcoin.segwit_decode(address) == ("bc", 0, program, "bech32") and bitcoin.segwit_encode("bc", 0, program) == address
    payload = bytes.fromhex("010966776006953d5567439e5e39f86a0d273bee")
    assert bitcoin.base58check_decode(bitcoin.base58check_encode(0, payload)) == (0, payload)
    assert not bitcoin.describe(address[:-1] + "5")[0] and bitcoin.describe(None) == (False, "invalid", "none", None)


def focus_graph(spark):
    nodes = [("W_SEED", "wallet", 1.0), ("TX_A", "txid", 0.8), ("W_MID", "wallet", 0.4), ("TX_B", "txid", 0.3), ("W_FAR", "wallet", 0.1), ("W_OTHER", "wallet", 0.0), ("1.2.3.4", "ip", 0.0)]
    e = [("W_SEED", "TX_A", "in", 1.0, "2026-09-01 00:00:00"), ("TX_A", "W_MID", "out", 0.9, "2026-09-01 00:00:00"), ("W_MID", "TX_B", "in", 0.5, "2026-09-02 00:00:00"), ("TX_B", "W_FAR", "out", 0.4, "2026-09-02 00:00:00"), ("1.2.3.4", "TX_B", "network", None, "2026-09-02 00:00:05")]
    return spark.createDataFrame(nodes, "id string, node_type string, risk_score double"), spark.createDataFrame(e, "source string, target string, edge_type string, amount double, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))


def test_focus_questions(spark):
    nodes, edges = focus_graph(spark)
    assert {r.id for r in focus.direct_neighbours(edges, "W_MID").collect()} == {"TX_A", "TX_B"}
    ids = spark.createDataFrame([("TX_B",), ("W_MID",)], "id string")
    rows = focus.flow_rows(edges, nodes, ids)
    tx = rows.where("focus = 'TX_B'").orderBy("step").collect()
    assert [(r.role, r.step) for r in tx] == [("funded by", 1), ("paid out to", 2), ("correlated", 3)]
    res = {r.focus: r for r in focus.resolution(rows).collect()}
    assert (res["W_MID"].total_sent, res["W_MID"].total_received, res["W_MID"].resolution) == (0.5, 0.9, "exact")
    stats = {r.focus: r for r in focus.timeline_stats(focus.node_events(rows, nodes)).collect()}
    assert stats["W_MID"].span_hours == 24 and stats["W_MID"].flagged == 1
    assert [(r.hop, r.edge_type) for r in focus.route_hops(edges, ["W_SEED", "TX_A", "W_MID"]).collect()] == [(1, "in"), (2, "out")]
    assert focus.advance_path(["a", "b", "c"], "b", set()) == ["a", "b"] and focus.advance_path(["a"], "z", {"z"}) == ["a", "z"]
    assert focus.node_facts(nodes, edges, "TX_B")["degree"] == 3


def test_empty_inputs_give_empty_results(spark):
    t = tx_frame(spark, [])
    assert peeling.candidates(t).count() == 0 and peeling.mixing(t).count() == 0
    empty = spark.createDataFrame([], "src string, dst string")
    assert iterate.connected_components(empty).count() == 0


def test_case_file_escapes_what_it_shows():
    from tracegrid.operators import casefile

    alert = evidence.stamp({"alert_id": "CT-W-1", "entity": "<script>", "entity_type": "wallet", "risk": 0.9, "confidence": 0.5, "action": "escalate", "reasons": ["<script>alert(1)</script>"], "c_risk": 0.9, "c_peel": 0.2, "counterfactuals": [{"evidence": "risk", "score_without": 0.2, "decisive": True}]})
    page = casefile.as_html(alert)
    assert "<script>" not in page and "&lt;script&gt;" in page and "<svg" in page
    assert "verified" in casefile.as_markdown(alert) and "<script>" not in casefile.as_markdown(alert)
    assert json.loads(casefile.as_json(alert))["entity"] == "<script>"


def test_node_link_export_keeps_the_busiest(spark):
    nodes, edges = focus_graph(spark)
    n, e, cut = graph.node_link(nodes, edges, 3)
    assert cut and n.count() == 3
    assert all("T" in json.loads(r.value)["timestamp"] for r in graph.node_link(nodes, edges, 100)[1].collect())
    marks = spark.createDataFrame([("W_MID", 3)], "id string, cluster int")
    assert {r.id: r.cluster for r in graph.annotate(nodes, marks).collect()}["W_MID"] == 3


def test_geography_of_a_known_address(spark):
    from tracegrid.operators import enrich

    r = enrich.lookup(spark.createDataFrame([("185.220.101.42",), (None,)], "ip string"), "ip").collect()
    assert {(x.ip, x.geo_country, x.geo_asn) for x in r} == {("185.220.101.42", "GB", "AS2856"), (None, None, None)}
