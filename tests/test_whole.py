"""Queries and operators do the whole job: no subsets, no fixed rounds, no limits."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from tracegrid import registry
from tracegrid.operators import anomaly, clustering, features, iterate, peeling
from tracegrid.operators import graph as G
from tracegrid.plans import model as M
from tracegrid.plans import scoring

QUERIES = registry.queries()


def co_spent(rows) -> dict[str, str]:
    """Union-find over the inputs of (inputs, outputs, output_amounts) without sweeps and mixing shapes."""
    root: dict[str, str] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for inputs, outputs, amounts in rows:
        mean = sum(amounts) / len(amounts)
        even = len(outputs) >= 3 and (sum((a - mean) ** 2 for a in amounts) / len(amounts)) ** 0.5 / mean < 0.35
        if 2 <= len(inputs) <= 3 and not even:
            for x in inputs[1:]:
                a, b = find(inputs[0]), find(x)
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_co_spent_wallets_of_all_transactions(spark, sf):
    want = co_spent([(r.inputs, r.outputs, r.output_amounts) for r in M.transactions(spark, sf).collect()])
    assert {r.node: r.component for r in QUERIES["common_input_cc"](spark, sf).collect()} == want
    got = QUERIES["entity_labels"](spark, sf).collect()
    assert {r.wallet for r in got if r.method == "common_input"} == set(want)
    assert {(want[a.wallet] == want[b.wallet]) == (a.cluster_id == b.cluster_id) for a in got for b in got if a.wallet in want and b.wallet in want} == {True}
    found = clustering.louvain(G.undirected(G.projection(M.flows(M.transactions(spark, sf))))).collect()
    communities = {r.id for r in found if sum(x.community == r.community for x in found) > 1}
    assert {r.wallet for r in got if r.method == "louvain"} == communities - set(want)
    sizes = QUERIES["cluster_stats"](spark, sf).collect()
    assert sum(r.size for r in sizes) == len(got)


def test_chains_are_picked_until_no_walk_is_left(spark):
    """Each walk meets the next, and ranks fall along them: one walk a round, 70 rounds."""
    n = 140
    rows = [(f"s{i:03}", [f"t{i:03}", f"t{i + 1:03}"], 2, float(n - i)) for i in range(n)]
    got = peeling.pick_chains(spark.createDataFrame(rows, "start string, txids array<string>, length int, value double")).collect()
    assert sorted(r.start for r in got) == [f"s{i:03}" for i in range(0, n, 2)]


def test_shortest_paths_have_no_hop_limit_and_all_goals(spark):
    """A line of 18 wallets with a side branch, and a goal that isn't reached."""
    edges = [(f"w{i:02}", f"w{i + 1:02}") for i in range(17)] + [("w03", "x"), ("x", "w05"), ("u", "v")]
    goals = ["w05", "w17", "v", "x", "w01", "w02", "w16"]
    got = {r.id: r.path for r in iterate.shortest_path(spark.createDataFrame(edges, "source string, target string"), "w00", spark.createDataFrame([(g,) for g in goals], "id string")).collect()}
    line = [f"w{i:02}" for i in range(18)]
    assert got == {f"w{i:02}": line[: i + 1] for i in (1, 2, 5, 16, 17)} | {"x": [*line[:4], "x"]}


def test_paths_to_seeds_follow_the_wallet_projection(spark, sf):
    f = M.flows(M.transactions(spark, sf))
    near: dict[str, set[str]] = {}
    for r in G.undirected(G.projection(f)).where("a <> b").collect():
        near.setdefault(r.a, set()).add(r.b)
        near.setdefault(r.b, set()).add(r.a)
    start = min(r.wallet for r in f.where("side = 'in'").collect())
    hops, frontier = {start: 0}, [start]
    while frontier:
        frontier = sorted({y for x in frontier for y in near.get(x, ())} - set(hops))
        hops |= dict.fromkeys(frontier, max(hops.values()) + 1)
    got = QUERIES["shortest_paths_to_seed"](spark, sf).collect()
    assert {r.seed: r.hops for r in got} == {r.wallet: hops[r.wallet] for r in M.seeds(spark, sf).collect() if r.wallet in hops and r.wallet != start}
    paths = {r.seed: r.path.split(" ") for r in got}
    assert all(p[0] == start and p[-1] == seed and all(y in near[x] for x, y in zip(p, p[1:], strict=False)) for seed, p in paths.items())


def test_links_of_all_orders(spark, sf):
    orders = sorted((r.o_orderkey, r.o_orderstatus) for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus").collect())
    hashes = ["0" * 64] + [hashlib.sha256(f"{s}{k}".encode()).hexdigest() for k, s in orders]
    assert {r.o_orderkey: r.prev for r in QUERIES["chain_link_check"](spark, sf).collect()} == {k: h for (k, _), h in zip(orders, hashes, strict=False)}


def test_components_of_the_graph(spark, sf):
    root: dict[str, str] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in M.flows(M.transactions(spark, sf)).collect():
        a, b = find(r.txid), find(r.wallet)
        root[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in QUERIES["weak_components"](spark, sf).collect()} == {x: find(x) for x in root}


def power(near: Counter, nodes: list[str], seeds: set[str]) -> dict[str, float]:
    """PageRank to the reference's convergence, restarts and dangling mass to seeds (or anywhere)."""
    at = {x: i for i, x in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for (x, y), k in near.items():
        a[at[y], at[x]] += k
    out = a.sum(0)
    p = np.array([float(not seeds or x in seeds) for x in nodes])
    p /= p.sum()
    rank = p
    for _ in range(100):
        new = 0.85 * (a @ np.divide(rank, out, where=out > 0, out=np.zeros(len(nodes))) + rank[out == 0].sum() * p) + 0.15 * p
        change, rank = np.abs(new - rank).sum(), new
        if change < len(nodes) * 1e-6:
            break
    return dict(zip(nodes, rank.tolist(), strict=True))


def test_ranks_converge(spark, sf):
    f = M.flows(M.transactions(spark, sf))
    near = Counter((r.src, r.dst) for r in G.projection(f).collect())
    nodes = sorted({r.wallet for r in f.collect()})
    seeds = {r.wallet for r in M.seeds(spark, sf).collect()} & set(nodes)
    assert {r.id: r.rank for r in QUERIES["pagerank_converged"](spark, sf).collect()} == pytest.approx(power(near, nodes, set()), abs=2e-9)
    want = power(near, nodes, seeds)
    want = {x: r / max(want.values()) for x, r in want.items()}
    assert {r.id: r.rank for r in QUERIES["ppr_seeds_converged"](spark, sf).collect()} == pytest.approx(want, abs=2e-9)
    assert {r.wallet: r.risk_pagerank for r in QUERIES["risk_blend"](spark, sf).collect()} == pytest.approx(want, abs=2e-9)


def test_many_rounds_end(spark):
    """A line of 40 nodes: size estimates that grow with each round made such loops endless."""
    pairs = [(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(39)]
    df = spark.createDataFrame(pairs, "a string, b string, weight double")
    got = {r.id: r.proximity for r in iterate.hub_proximity(df, spark.createDataFrame([("n00",)], "id string"), max_hops=40).collect()}
    assert got == pytest.approx({f"n{i:02}": 0.7**i for i in range(40)})


def test_detectors_have_their_configured_size(spark, sf):
    f = features.transaction_features(M.transactions(spark, sf))
    want = {r.txid: r.iso for r in anomaly.isolation_forest(f, "txid", scoring.ANOMALY_COLUMNS, trees=200).collect()}
    assert {r.txid: r.iso for r in QUERIES["iforest"](spark, sf).collect()} == pytest.approx(want, abs=1e-6)
    want = anomaly.permutation_importance(f, "txid", scoring.ANOMALY_COLUMNS, repeats=3, rows=2048, trees=200)
    assert {r.feature: r.importance for r in QUERIES["perm_importance"](spark, sf).collect()} == pytest.approx(want)
    pairs = G.undirected(G.projection(M.flows(M.transactions(spark, sf))))
    assert {tuple(r) for r in QUERIES["louvain"](spark, sf).collect()} == {tuple(r) for r in clustering.louvain(pairs, rounds=10, levels=4).collect()}
