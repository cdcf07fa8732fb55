"""The corpus pipeline: each stage on what the one before kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from test_corpus_queries import brute_components, check_packed

from tracegrid.llm import toxicity
from tracegrid.llm.common import stage


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = [docs]
    for name, function in corpus_pipeline.STAGES:
        seen.append(stage(function(spark, seen[-1], sf), f"test-{name}"))
    for out in seen[1:-1]:
        assert out.columns == corpus_pipeline.COLUMNS
    model = toxicity.train(docs, labels)
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in seen[1].collect()} == rejected
    before = {r.doc_id: r.text for r in seen[2].collect()}
    assert {r.doc_id for r in seen[3].collect()} == {c for _, c in brute_components(before).values()}
    pieces = seen[4].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in seen[3].collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.length) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.length) for r in pieces)


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, sf).count() == 0


def test_stages_take_odd_rows(spark, sf):
    """Null ids and texts, repeated rows, one id with several texts, ties, and extra columns with clashing names."""
    plain = " ".join(f"plain{i} word{i}" for i in range(60))
    other = " ".join(f"other{i} text{i}" for i in range(60))
    rows = [(1, plain), (1, plain), (1, other), (2, plain + " more"), (None, plain), (None, other + " x"), (None, None), (3, None), (4, ""), (5, "a few words"), (None, "lone " + plain[::-1])]
    clashing = "doc_id long, text string, lang string, source string, n_chars int, id long, n long, score double, kept boolean, sequence_id string, rep int"
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, None, k, 7, 8, 0.5, False, "s", 1) for k, (i, t) in enumerate(rows)], clashing)
    count = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    toxic, quality, near, packed = (function for _, function in corpus_pipeline.STAGES)
    assert toxic(spark, docs, sf).columns == quality(spark, docs, sf).columns == near(spark, docs, sf).columns == corpus_pipeline.COLUMNS
    assert count(toxic(spark, docs, sf)) == Counter(rows)
    assert count(quality(spark, docs, sf)) == Counter((i, t) for i, t in rows if t and len(t.split()) >= 50)
    left = count(near(spark, docs, sf))
    assert left == Counter([(1, plain), (1, other), (None, None), (3, None), (4, ""), (5, "a few words"), (None, "lone " + plain[::-1])])
    pieces = packed(spark, docs, sf).collect()
    assert len(pieces) == len(rows) and check_packed(pieces, 2048) == -(-sum(r.length for r in pieces) // 2048)
    assert Counter(r.doc_id for r in pieces) == Counter(i for i, _ in rows)
