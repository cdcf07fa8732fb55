"""The analysis from files to alerts on planted patterns, what is asked of it afterwards, and the streaming forms."""

from __future__ import annotations

import csv
import json
import time

import pytest
from pyspark.sql import functions as F

from tracegrid.operators import focus
from tracegrid.plans import answers, pipeline, validation
from tracegrid.sources import readers
from tracegrid.sources.generator import Generator, audit, grade
from tracegrid.streaming import online


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """(folder, output, truth, summary) of one run over planted patterns."""
    top = tmp_path_factory.mktemp("run")
    source, out = str(top / "in"), str(top / "out")
    truth = Generator(seed=11).build().write(source)
    start = time.time()
    summary = pipeline.run(spark, source, out, trees=40)
    return source, out, truth, summary | {"seconds": time.time() - start}


def test_planted_patterns_lead_the_alerts(spark, ran):
    _, out, truth, s = ran
    assert s["peel_chains"] == 1 and s["mixing"] == 1 and s["ledger_ok"] and s["correlated"] >= len(truth["correlated"])
    top = pipeline.alerts(spark, out, limit=60).collect()
    found = {r.entity for r in top}
    assert top[0].entity == "seed" and top[0].risk >= 0.95
    assert grade(found, {*truth["peeling_chains"][0], *truth["mixing_transactions"]}, set())["recall"] >= 0.7  # the alerts are the 60 best
    labels = {r.wallet: r.cluster_id for r in spark.read.parquet(f"{out}/clusters").where("method = 'common_input'").collect()}
    assert all(len({labels[m] for m in members}) == 1 for members in truth["entity_clusters"])
    assert all(c.score_without <= r.risk + 1e-6 for r in top for c in r.counterfactuals)
    assert pipeline.stats(spark, out)["alerts"] == len(top) and pipeline.verify_ledger(spark, out)["ok"]
    assert pipeline.graph_around(spark, out, "peel0_2", 1).count() == 3


def test_answers_about_a_run(spark, ran, tmp_path):
    _, out, _, s = ran
    assert answers.health(spark, out)["status"] == "ok" and answers.health(spark, str(tmp_path))["status"] == "empty"
    first = pipeline.alerts(spark, out, limit=1).first()
    assert answers.alert(spark, out, first.alert_id)["entity"] == first.entity and answers.alert(spark, out, "none") is None
    page, state = answers.ledger_page(spark, out, 1, 2), answers.chain_state(spark, out)
    assert page["total"] == s["alerts"] == state["entries"] and len(page["entries"]) == 2 and state["ok"] and state["first_break"] is None
    assert page["entries"][0]["prev_hash"] == answers.ledger_page(spark, out)["entries"][0]["entry_hash"]
    rows = answers.infrastructure(spark, out).collect()
    assert rows and all(r.alerts >= 1 and 0 <= r.max_risk <= 1 for r in rows)
    summary = answers.export(spark, out)
    assert summary["alerts"] == s["alerts"] and summary["ledger"]["ok"] and summary["risk"]["seeds"] == 1
    nodes = [json.loads(r.value) for r in spark.read.text(f"{out}/export/graph/nodes").collect()]
    edges = [json.loads(r.value) for r in spark.read.text(f"{out}/export/graph/edges").collect()]
    assert {e["source"] for e in edges} | {e["target"] for e in edges} == {n["id"] for n in nodes} and any(n.get("risk_score") == 1.0 for n in nodes)
    assert spark.read.option("header", True).csv(f"{out}/export/alerts").count() == s["alerts"]


def test_validation_of_a_run(spark, ran):
    source, out, truth, s = ran
    assert all(validation.audit_folder(source).values())
    found = validation.validate(spark, source, out)
    assert found["peeling"] == {"recall": 1.0, "precision": 1.0, "benign_flagged": 0.0} and found["mixing"]["recall"] == found["mixing"]["precision"] == 1.0
    assert found["correlated"]["recall"] == 1.0 and found["anomaly"]["recall"] >= 0.3
    assert s["seconds"] < 300


def test_audit_finds_faults():
    g = Generator(seed=3).build()
    g.tx[0] = g.tx[0] | {"fee": "5.00000000"}
    g.tx.append(dict(g.tx[1]))
    bad = {k for k, ok in audit(g.tx, g.net, g.truth).items() if not ok}
    assert bad == {"ids are unique", "inputs equal outputs and fee"}


def test_bulk_view_holds_both_layers(spark, tmp_path):
    g = Generator(seed=7, background=40, network=20).build()
    rows = g.bulk()
    with open(tmp_path / "bulk_metadata.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, rows[-1] if len(rows[-1]) > len(rows[0]) else rows[0])
        w.writeheader()
        w.writerows(rows)
    tx, net, _ = readers.load_bundle(spark, str(tmp_path))
    assert {r.txid for r in tx.collect()} == {t["txid"] for t in g.tx} and net.count() == len({(n["timestamp"], n["src_ip"]) for n in g.net})


def test_focus_views(spark):
    edges = spark.createDataFrame([("W1", "T1", "in", 2.5, 1), ("T1", "W2", "out", 2.4, 1), ("W2", "T2", "in", 0.0001, 2), ("9.9.9.9", "T2", "network", None, 3)], "source string, target string, edge_type string, amount double, timestamp int")
    view = focus.focus_view(edges, ["W1", "T1", "W2"])
    assert view["head"] == "W2" and {r.id for r in view["neighbours"].collect()} == {"T1", "T2"} and {r.id for r in view["nodes"].collect()} == {"W1", "T1", "W2", "T2"}
    assert {tuple(r) for r in view["pairs"].collect()} == {("T1", "W1", True), ("T1", "W2", True), ("T2", "W2", False)}
    empty = focus.focus_view(edges, [])
    assert empty["head"] is None and empty["pairs"].count() == 0 and empty["nodes"].count() == 0
    assert focus.path_summary(["W1", "a" * 40]) == "W1 → aaaaaaaa…aaaa"
    assert focus.route_summary(edges, ["W1", "T1", "W2", "T2", "9.9.9.9"]) == "W1   -2.5000 BTC→ T1   -2.4000 BTC→ W2   -0.0001 BTC→ T2   -network→ 9.9.9.9" and focus.route_summary(edges, ["W1"]) == ""
    alerts = spark.createDataFrame([("W1", ["x"]), ("T9", ["paid by W1 twice"]), ("T8", [])], "entity string, reasons array<string>")
    assert {r.entity for r in focus.back_references(alerts, "W1").collect()} == {"W1", "T9"}


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("string").alias("txid"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("user"), "event_type")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = online.bursts(stream, "user", 1).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.user, r.start): r.n for r in spark.table("bursts").collect()}
    batch = events.groupBy(F.window("timestamp", "60 seconds", "10 seconds").alias("w"), "user").agg(F.count("*").alias("n"))
    want = {(r.user, r.start): r.n for r in batch.select("user", "w.start", "n").collect()}
    # Everything but what the watermark holds back at the end: windows within ten minutes of the last event.
    last = max(start for _, start in want)
    assert got.items() <= want.items() and {k for k in want if (last - k[1]).total_seconds() > 1200} <= set(got) and max(got.values()) >= 1
    q = online.correlate(stream.where("event_type <> 'purchase'"), stream.where("event_type = 'purchase'")).writeStream.format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    n, p = events.where("event_type <> 'purchase'"), events.where("event_type = 'purchase'")
    want = n.alias("n").join(p.alias("p"), F.abs(F.unix_micros("n.timestamp") - F.unix_micros("p.timestamp")) <= 90_000_000).count()
    assert spark.table("pairs").count() == want


def test_generator_is_reproducible(tmp_path):
    a, b = (Generator(seed=5).build() for _ in range(2))
    assert a.tx == b.tx and a.net == b.net and a.truth == b.truth


def test_empty_folder(spark, tmp_path):
    assert pipeline.run(spark, str(tmp_path), str(tmp_path / "out"))["transactions"] == 0
