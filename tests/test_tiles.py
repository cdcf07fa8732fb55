"""Graphs in tiles give what the joins of DataFrames give."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import clustering, iterate, tiles
from tracegrid.operators import graph as G
from tracegrid.plans import model as M

PAIRS = "a string, b string, weight double"


def planted(n: int, groups: int, seed: int) -> list[tuple]:
    """Groups with few edges between them, nodes alone but for a self-pair, parallel pairs, and pairs without an id."""
    rnd = random.Random(seed)
    name = lambda i: f"n{i * 7919 % 1000:03}"
    rows = [(name(i), name(j), 1 + rnd.random()) for i in range(n) for j in range(i + 1, n) if rnd.random() < (0.5 if i % groups == j % groups else 0.01)]
    return [*rows, *rows[::5], *((b, a, w / 2) for a, b, w in rows[::7]), (name(1), name(1), 3.0), ("alone", "alone", 1.0), (None, name(2), 1.0)]


@pytest.mark.parametrize("edges", [64, 1 << 17])  # many tiles, and one
def test_louvain_in_tiles_equals_joins(spark, monkeypatch, edges):
    few = {"rounds": 4, "levels": 2}
    monkeypatch.setattr(tiles, "TILE_EDGES", edges)
    df = spark.createDataFrame(planted(60, 5, 1), PAIRS)
    want = {tuple(r) for r in clustering.louvain_by_joins(df.where("a is not null"), **few).collect()}
    got = {tuple(r) for r in clustering.louvain(df, **few).collect()}
    assert got == want and len({c for _, c in got}) < 20 and ("alone", "alone") in got
    monkeypatch.setattr(tiles, "MOST_NODES", 10)
    assert {tuple(r) for r in clustering.louvain(df.where("a is not null"), **few).collect()} == want


def test_a_round_reads_the_tiles_in_turn(spark, monkeypatch):
    """A round read all tiles, those of waiting nodes too."""
    monkeypatch.setattr(tiles, "TILE_EDGES", 64)
    df, turns = spark.createDataFrame(planted(60, 5, 1), PAIRS).where("a is not null"), clustering.waiting(4)
    names, rows = tiles.few_names(df.select(F.explode(F.array("a", "b")).alias("id")).distinct(), turns)
    turns = [names.column(rows, c) for c in turns]
    for graph in (tiles.tiled(df, names, 3 * df.count(), turns), tiles.tiled(df, names, 3 * df.count()).contracted(np.arange(names.n, dtype=np.int32), names.n, turns)):
        for j, w in ((0, False), (0, True), (1, False), (1, True)):
            nodes = [x for r in graph.rows(j, w).collect() for x in np.frombuffer(r.nodes, np.int32)]
            assert sorted(nodes) == np.flatnonzero(turns[j] == w).tolist() and 0 < len(nodes) < names.n


def test_components_in_tiles(spark, monkeypatch):
    """A long line, a star and a self-pair, in many tiles."""
    monkeypatch.setattr(tiles, "TILE_EDGES", 16)
    rows = [(f"l{i * 37 % 100:02}", f"l{(i + 1) * 37 % 100:02}") for i in range(99)] + [("s9", f"s{i}") for i in range(9)] + [("x", "x")]
    df = spark.createDataFrame(rows, "src string, dst string")
    names, _ = tiles.few_names(df.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    graph = tiles.tiled(df.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight")), names, len(rows))
    got = {tuple(r) for r in names.labelled(graph.components(), graph.present, "node", "component").collect()}
    assert graph.n_tiles > 1 and got == {tuple(r) for r in iterate.connected_components(df).collect()} and len({c for _, c in got}) == 3


def test_pairs_of_transactions_equal_the_projection(spark):
    """A payer listed twice, a receiver listed twice, a receiver who paid, and nothing paid."""
    rows = [("t1", ["a", "b", "a"], ["c", "d", "c"], [1.0, 2.0, 3.0], [2.0, 1.0, 2.5]), ("t2", ["c"], ["c", "a"], [4.0], [0.0, 4.0]), ("t3", ["a"], ["b", "b"], [0.0], [0.0, 0.0])]
    tx = spark.createDataFrame(rows, "txid string, inputs array<string>, outputs array<string>, input_amounts array<double>, output_amounts array<double>").withColumn("timestamp", F.current_timestamp())
    want = {(r.a, r.b): r.weight for r in G.undirected(G.projection(M.flows(tx))).collect()}
    got = G.transaction_pairs(tx).groupBy("a", "b").agg(F.sum("weight").alias("weight")).collect()
    assert {(r.a, r.b): r.weight for r in got} == pytest.approx(want)


def test_small_levels_run_without_jobs(spark):
    """Rounds over a small graph are no jobs; joins took some hundred."""
    df = spark.createDataFrame(planted(60, 5, 2), PAIRS).where("a is not null")
    spark.sparkContext.setJobGroup("louvain", "louvain")
    clustering.louvain(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("louvain"))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < jobs < 60
