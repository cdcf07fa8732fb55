"""Ownership clusters: co-spent inputs, then communities of the wallet projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config
from ..functions.scalars import array_sum, pop_cv
from . import tiles as T
from .iterate import connected_components, numbered, settled


def merge_hazard(max_inputs: int = config.COMMON_INPUT_MAX, min_outputs: int = config.MIX_OUTPUTS, cv: float = config.MIX_CV) -> Column:
    """Sweeps and mixing shapes, whose inputs needn't share an owner."""
    amounts = F.col("output_amounts")
    even = (F.size("outputs") >= min_outputs) & (F.size(amounts) == F.size("outputs")) & (array_sum(amounts) > 0) & (pop_cv(amounts) < cv)
    return (F.size("inputs") > max_inputs) | even


def common_input(tx: DataFrame, **hazard) -> DataFrame:
    """(node, component): wallets tied by being spent together; a wallet listed twice is a cluster of its own."""
    safe = tx.where((F.size("inputs") >= 2) & ~merge_hazard(**hazard))
    stars = safe.select(F.col("inputs")[0].alias("src"), F.explode(F.slice("inputs", 2, 1_000_000)).alias("dst"))
    stars, found = settled(stars, n=F.count(F.lit(1)))
    few = T.few_names(stars.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    if few is None:
        return connected_components(stars)
    names, _ = few
    graph = T.tiled(stars.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight")), names, found["n"])
    return settled(names.labelled(graph.components(), graph.present, "node", "component"))


def modularity(pairs: DataFrame, labels: DataFrame, resolution: float = config.LOUVAIN_RESOLUTION) -> float:
    """Of undirected weighted pairs (a, b, weight) under labels (id, community)."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    e = pairs.join(la, "a").join(lb, "b")
    m = pairs.agg(F.sum("weight")).first()[0]
    if not m:
        return 0.0
    inside = e.where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("k"))
    squares = ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / m - resolution * squares / (4 * m * m)


def _local_moves(pairs: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """(id, community) by rounds in which every node weighs its neighbours' communities and half of them may move.

    Which half may move alternates by hash, so two nodes seldom swap places; a node only moves for a gain.
    """
    both = pairs.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "weight").select(F.col("x.a").alias("id"), F.col("x.b").alias("to"), "weight")
    both = settled(both.groupBy("id", "to").agg(F.sum("weight").alias("weight")))
    loops = pairs.where("a = b").select(F.col("a").alias("id"), (2 * F.col("weight")).alias("weight"))
    k, found = settled(both.select("id", "weight").unionByName(loops).groupBy("id").agg(F.sum("weight").alias("k")), m2=F.sum("k"))
    m2 = found["m2"]
    state = k.select("id", "k", F.col("id").alias("community"))
    if not m2:
        return state.select("id", "community")
    for r in range(rounds):
        total = state.groupBy("community").agg(F.sum("k").alias("tot"))
        near = both.join(state.select(F.col("id").alias("to"), F.col("community").alias("c")), "to").groupBy("id", "c").agg(F.sum("weight").alias("w"))
        near = near.unionByName(state.select("id", F.col("community").alias("c"), F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
        seen = near.join(state, "id").join(total.withColumnRenamed("community", "c"), "c")
        own = F.col("c") == F.col("community")
        gain = F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(own, F.col("k")).otherwise(0.0)) / m2
        best = seen.withColumn("gain", gain).groupBy("id").agg(F.max(F.struct(F.round("gain", 12).alias("g"), own.alias("stay"), F.col("c").alias("c"))).alias("b"))
        turn = F.pmod(F.xxhash64("id", F.lit(r // 2)), F.lit(2)) == r % 2
        moved = state.join(best, "id").select("id", "k", F.when(turn, F.col("b.c")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old"))
        new, found = settled(moved, n=F.count_if(F.col("community") != F.col("old")))
        state = new.select("id", "k", "community")
        if not found["n"] and r % 2:
            break
    return state.select("id", "community")


def louvain(pairs: DataFrame, resolution: float = config.LOUVAIN_RESOLUTION, rounds: int = 10, levels: int = 4, ids: DataFrame | None = None, n_pairs: int = 0) -> DataFrame:
    """(id, community): moves, then the same on the graph of communities, while modularity rises.

    Deterministic; if the result is worse than connected components, those are returned. Parallel pairs add up. With
    ids, which has all ids of pairs (id), and about how many pairs there are, pairs are gone through once.
    """
    pairs = pairs.select("a", "b", "weight")
    if ids is None:
        pairs, found = settled(pairs, n=F.count(F.lit(1)))
        ids, n_pairs = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), found["n"]
    turns = waiting(rounds)
    few = T.few_names(ids, turns)
    if few is None:
        return louvain_by_joins(pairs, resolution, rounds, levels)
    names, rows = few
    turns = [names.column(rows, c) for c in turns]
    return louvain_of(T.tiled(pairs, names, n_pairs, turns), names, turns, resolution, rounds, levels)


def waiting(rounds: int = 10) -> dict[str, Column]:
    """Of ids (id), for each two rounds, who waits for the second."""
    return {f"turn{j}": F.pmod(F.xxhash64("id", F.lit(j)), F.lit(2)) == 1 for j in range((rounds + 1) // 2)}


def louvain_of(graph: T.Tiled, names: T.Names, turns: list, resolution: float = config.LOUVAIN_RESOLUTION, rounds: int = 10, levels: int = 4) -> DataFrame:
    """louvain of a graph in tiles; turns: the columns of waiting."""
    return settled(names.labelled(T.louvain(graph, turns, resolution, rounds, levels), graph.present, "id", "community"))


def louvain_by_joins(pairs: DataFrame, resolution: float = config.LOUVAIN_RESOLUTION, rounds: int = 10, levels: int = 4) -> DataFrame:
    """The same for any number of ids, by joins of DataFrames."""
    pairs = settled(pairs.select("a", "b", "weight"))
    labels, graph, best = None, pairs, None
    for _ in range(levels):
        step = _local_moves(graph, resolution, rounds)
        new = step if labels is None else labels.join(step.select(F.col("id").alias("community"), F.col("community").alias("next")), "community").select("id", F.col("next").alias("community"))
        new = settled(new)
        q = modularity(pairs, new, resolution)
        if best is not None and q <= best + 1e-9:
            break
        labels, best = new, q
        la, lb = (step.select(F.col("id").alias(c), F.col("community").alias(f"c{c}")) for c in "ab")
        graph = settled(graph.join(la, "a").join(lb, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")))
    plain = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("id"), F.col("component").alias("community"))
    return plain if best is None or modularity(pairs, plain, resolution) > best else labels


def by_size(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(label, number): clusters numbered from 0, largest first, ties by label."""
    sizes = labels.groupBy(label).agg(F.count("*").alias("n"))
    return numbered(sizes, [F.desc("n"), F.col(label)], "number").select(label, "number")


def entity_labels(wallets: DataFrame, co_spent: DataFrame, communities: DataFrame | None) -> DataFrame:
    """(wallet, cluster_id, method): co-spent clusters, else communities of two or more, else the wallet alone."""
    co = co_spent.join(by_size(co_spent, "node", "component"), "component").select(F.col("node").alias("wallet"), F.col("number").alias("co"))
    out = wallets.select("wallet").join(co, "wallet", "left")
    n = wallets.count()
    if communities is not None:
        sizes = communities.groupBy("community").agg(F.count("*").alias("n")).where("n >= 2")
        real = communities.join(sizes.select("community"), "community", "left_semi")
        out = out.join(real.join(by_size(real, "id", "community"), "community").select(F.col("id").alias("wallet"), F.col("number").alias("lv")), "wallet", "left")
    else:
        out = out.withColumn("lv", F.lit(None).cast("int"))
    cluster = F.when(F.col("co").isNotNull(), F.concat(F.lit("c"), "co")).when(F.col("lv").isNotNull(), F.concat(F.lit("l"), F.lit(n + 1000) + F.col("lv"))).otherwise(F.concat(F.lit("s"), "wallet"))
    method = F.when(F.col("co").isNotNull(), "common_input").when(F.col("lv").isNotNull(), "louvain").otherwise("singleton")
    return out.select("wallet", cluster.alias("cluster_id"), method.alias("method"))


def cluster_stats(labels: DataFrame) -> DataFrame:
    """(cluster_id, size, method, members): with the three first members."""
    first = F.row_number().over(W.partitionBy("cluster_id").orderBy("wallet"))
    few = labels.withColumn("r", first).where("r <= 3").groupBy("cluster_id").agg(F.sort_array(F.collect_list("wallet")).alias("members"))
    return labels.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("method").alias("method")).join(few, "cluster_id")
