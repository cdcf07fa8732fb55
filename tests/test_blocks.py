"""Transactions in blocks give what their lists give, on odd rows too."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid import registry
from tracegrid.operators import clustering, tiles
from tracegrid.operators import graph as G
from tracegrid.plans import blocks, scoring
from tracegrid.plans import model as M

ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"
LINES = "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_tax double, l_returnflag string"
HAZARD = {"max_inputs": 3, "min_outputs": 3, "cv": 0.35}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Wallets, amounts, taxes, flags and keys that are null; orders and lines twice; lines or orders alone; all returned; nothing paid; wallets twice."""
    rnd, day = random.Random(3), datetime.datetime(2024, 1, 1)
    some = lambda x, p=0.04: None if rnd.random() < p else x
    orders = [(k, some(rnd.randrange(40)), day, "1") for k in range(150)] + [(7, 3, day, "2"), (7, 3, day, "2"), (None, 5, day, "1"), (900, 1, day, "1")]
    lines = [(some(k, 0.02), some(rnd.randrange(60)), some(i, 0.02), some(rnd.choice([0.0, 10.0, rnd.random() * 1e4])), some(0.05), some(rnd.choice("RNAN"))) for k in range(145) for i in range(rnd.randrange(1, 9))]
    lines += [(146, 5, 1, 3.0, 0.0, "R"), (147, 77, 1, 0.0, 0.0, "N"), (148, None, 1, 1.0, 0.1, "N"), (901, 2, 1, 1.0, 0.1, "N"), *((149, 9, i, 50.0, 0.1, f) for i, f in enumerate("NNRR")), *lines[:20]]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def edges(graph, names) -> dict:
    ids, out = names.shared.value.to_pylist(), {}
    for r in graph.tiles.collect():
        nodes, counts, loops, tos, ws = (np.frombuffer(x, t) for x, t in ((r.nodes, np.int32), (r.counts, np.int32), (r.loops, float), (r.tos, np.int32), (r.ws, float)))
        for a, b, w in [*zip(np.repeat(nodes, counts), tos, ws, strict=True), *zip(nodes, nodes, loops, strict=True)]:
            if w or a != b:
                out[ids[a], ids[b]] = out.get((ids[a], ids[b]), 0.0) + float(w)
    return out


@pytest.mark.parametrize("rows", [100, 400_000])  # many blocks, and one
def test_graphs_of_blocks_equal_those_of_lists(spark, monkeypatch, odd, rows):
    monkeypatch.setattr(blocks, "ROWS", rows)
    monkeypatch.setattr(tiles, "TILE_EDGES", 64)
    names, found = tiles.few_names(blocks.wallet_keys(spark, odd), {"key": F.col("key")})
    df, sums = blocks.transaction_blocks(spark, odd, names.column(found, "key"))
    t = M.transactions(spark, odd)
    lists = t.select("inputs", "outputs").collect()
    assert sums["pairs"] == sum(len(r.inputs) * len(r.outputs) for r in lists) and sums["unnamed"] == sum((r.inputs + r.outputs).count(None) for r in lists) > 0
    want = {}
    for r in G.transaction_pairs(t).groupBy("a", "b").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight")).where("a is not null").collect():
        want[r.a, r.b] = want[r.b, r.a] = r.weight
    assert edges(blocks.pair_graph(df, names.n, sums["pairs"]), names) == pytest.approx({k: w for k, w in want.items() if w or k[0] != k[1]})
    graph = blocks.co_spent_graph(df, names.n, sums["stars"], **HAZARD)
    got = {tuple(r) for r in names.labelled(graph.components(), graph.present, "node", "component").collect()}
    assert got == {tuple(r) for r in clustering.common_input(t, **HAZARD).collect()} and len({c for _, c in got}) > 1


def test_labels_of_blocks_equal_those_of_lists(spark, odd):
    t = M.transactions(spark, odd)
    wallets = t.select(F.explode(F.concat("inputs", "outputs")).alias("wallet")).distinct()
    want = clustering.entity_labels(wallets, clustering.common_input(t, **HAZARD), clustering.louvain(G.transaction_pairs(t)))
    got = {tuple(r) for r in scoring.entity(spark, odd).collect()}
    assert got == {tuple(r) for r in want.collect()} and (None, None, "singleton") in got


def test_lists_are_not_put_together_for_communities(spark, sf, monkeypatch):
    """Sorted lists of lines and a row for each pair took most of the time at 60 times sf0.1."""
    monkeypatch.setattr(M, "transactions", None)
    monkeypatch.setattr(G, "transaction_pairs", None)
    assert registry.queries()["louvain"](spark, sf).count() > 0
