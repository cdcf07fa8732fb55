"""Iterative graph algorithms as loops of joins and aggregates. Each round's state is written once to the shared
folder, which cuts the lineage, outlives executors, and gives the planner true sizes: the joins of a small graph
become broadcast joins by themselves. Loops end at their fixed point or with an error, never early."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config


def prepared(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; without one, as in local tests, to a folder of our own."""
    if spark.sparkContext.getCheckpointDir():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not where and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "tracegrid-checkpoints"))


def settled(df: DataFrame, *by: str, **measures: Column) -> DataFrame | tuple[DataFrame, dict]:
    """df, written to the shared folder and read again; with measures, also their values over its rows, from the same job; by: columns whose values have folders of their own."""
    spark = df.sparkSession
    prepared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *(c.alias(k) for k, c in measures.items())) if measures else df).write.partitionBy(*by).parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    return (done, seen.get) if measures else done


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows with their place (from 0) in an order: sorted in ranges, each shifted by the rows of the ranges before."""
    placed = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    starts = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # one row a range
    starts = starts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"))
    return placed.join(starts, "_part").withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each weak component of edges (src, dst); self-loops keep their node.

    Alternating large-star and small-star rounds until every node is tied to one root alone.
    """
    e = settled(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u is not null and v is not null").distinct())
    loops, e = e.where("u = v").select("u"), e.where("u <> v")
    for done in range(max_rounds + 1):
        ends = e.select("u", F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("above"), F.lit(1).alias("below")))
        ends = ends.groupBy("u").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
        if ends.where("above > 1 or above = 1 and below = 1").isEmpty():
            break
        if done == max_rounds:
            raise RuntimeError(f"components are not closed after {max_rounds} rounds")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = settled(star.where("u <> v").distinct())
    roots = e.select(F.col("v").alias("u")).unionByName(loops).distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def undirected(edges: DataFrame) -> DataFrame:
    """(id, to) in both directions of edges (source, target), each once."""
    return edges.select(F.col("source").alias("id"), F.col("target").alias("to")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("to"))).distinct()


def hops_from(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hops): breadth-first over undirected edges (source, target) from seeds (id)."""
    adj = settled(undirected(edges))
    seen = settled(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for h in range(1, depth + 1):
        found = adj.join(frontier.select("id"), "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(h))
        frontier, state = settled(found, n=F.count(F.lit(1)))
        if not state["n"]:
            break
        seen = seen.unionByName(frontier)
    return seen


def pagerank(edges: DataFrame, node_rows: DataFrame, teleport: DataFrame | None = None, rounds: int | None = None, damping: float = config.DAMPING, tol: float = 1e-6, max_rounds: int = 100) -> DataFrame:
    """(id, rank) over edges (source, target), each parallel edge with weight 1.

    teleport (id) restricts restarts, and the mass of nodes without edges, to those nodes. With ``rounds`` the
    number of rounds is fixed, else it stops when the total change is below tol times the number of nodes, and
    raises an error after max_rounds. A round is one job: it writes the new ranks and measures, on the way, their
    change and the mass that nodes without edges hold.
    """
    base = node_rows.select("id").distinct()
    if teleport is None:
        base = base.withColumn("p", F.lit(1.0))
    else:
        base = base.join(teleport.select("id").distinct().withColumn("p", F.lit(1.0)), "id", "left").fillna(0.0, ["p"])
    multi = settled(edges.groupBy("source", "target").agg(F.count("*").alias("k")))
    out = multi.groupBy(F.col("source").alias("id")).agg(F.sum("k").alias("out"))
    base, state = settled(base.join(out, "id", "left"), n=F.count(F.lit(1)), total=F.sum("p"))
    n, total = state["n"], state["total"]
    if not n or not total:
        return base.select("id", F.lit(0.0).alias("rank"))
    sources = settled(multi.join(out.withColumnRenamed("id", "source"), "source").select("source", "target", (F.col("k") / F.col("out")).alias("share")))
    first = F.col("p") / total if teleport is not None else F.lit(1.0 / n)
    lost = F.sum(F.when(F.col("out").isNull(), F.col("rank")))
    ranks, state = settled(base.select("id", (F.col("p") / total).alias("p"), "out", first.alias("rank")), lost=lost)
    for done in range(rounds or max_rounds):
        got = sources.join(ranks.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = damping * (F.coalesce("got", F.lit(0.0)) + (state["lost"] or 0.0) * F.col("p")) + (1 - damping) * F.col("p")
        moved = ranks.join(got, "id", "left").select("id", "p", "out", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
        moved, state = settled(moved, lost=lost, change=F.sum("change"))
        ranks = moved.drop("change")
        if rounds is None and state["change"] < n * tol:
            break
        if rounds is None and done == max_rounds - 1:
            raise RuntimeError(f"ranks still change by {state['change']} after {max_rounds} rounds")
    return ranks.select("id", "rank")


def hub_proximity(pairs: DataFrame, seeds: DataFrame, decay: float = config.RISK_DECAY, hub: int = config.HUB_DEGREE, max_hops: int = config.RISK_MAX_HOPS) -> DataFrame:
    """(id, proximity, hops): cheapest path to any seed over undirected pairs (a, b); hubs make a path dearer.

    Paths are relaxed to a fixed point, which comes after as many rounds as the longest cheapest path has hops;
    then nodes whose cheapest path has more than max_hops hops go. Equal costs take fewer hops. A self-pair counts
    twice in a degree. A round is one job: it writes all best costs, of which only those just bettered go on.
    """
    deg = settled(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d")))
    pen = deg.select("id", F.when(F.col("d") > hub, F.log1p(F.col("d") / hub)).otherwise(0.0).alias("pen"))
    both = pairs.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("x")).select("x.*")
    cost = -math.log(decay) * (1 + F.col("pen") + F.col("pen_to"))
    arcs = settled(both.join(pen, "id").join(pen.select(F.col("id").alias("to"), F.col("pen").alias("pen_to")), "to").select("id", "to", cost.alias("cost")))
    best = settled(seeds.select("id").distinct().join(deg.select("id"), "id", "left_semi").select("id", F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(True).alias("new")))
    while True:
        reached = arcs.join(best.where("new").select("id", "dist", "hops"), "id").groupBy(F.col("to").alias("id")).agg(F.min(F.struct(F.col("dist") + F.col("cost"), F.col("hops") + 1)).alias("m"))
        met = best.select("id", "dist", "hops").join(reached, "id", "full")
        better = F.col("m").isNotNull() & (F.col("dist").isNull() | (F.col("m.col1") < F.col("dist") - 1e-12))
        met = met.select("id", F.when(better, F.col("m.col1")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("m.col2")).otherwise(F.col("hops")).alias("hops"), better.alias("new"))
        best, state = settled(met, n=F.count_if("new"))
        if not state["n"]:
            break
    return best.where(F.col("hops") <= max_hops).select("id", F.exp(-F.col("dist")).alias("proximity"), "hops")


def shortest_path(edges: DataFrame, start: str, goals: DataFrame) -> DataFrame:
    """(id, path): for each of goals (id) that start reaches, the path with fewest hops (ties by the smallest parent).

    The search goes on until its frontier is empty; only parents are kept, and paths are walked back from the goals.
    """
    adj = settled(undirected(edges).where("id <> to"))
    seen = settled(edges.sparkSession.createDataFrame([(start, None)], "id string, parent string"))
    frontier, hops = seen, 0
    while True:
        found = adj.join(frontier.select("id"), "id").groupBy(F.col("to")).agg(F.min("id").alias("parent")).select(F.col("to").alias("id"), "parent").join(seen.select("id"), "id", "left_anti")
        frontier, state = settled(found, n=F.count(F.lit(1)))
        if not state["n"]:
            break
        hops += 1
        seen = seen.unionByName(frontier)
        if hops % 16 == 0:  # else the plan grows with the hops
            seen = settled(seen)
    seen = settled(seen)
    back = seen.select(F.col("id").alias("at"), "parent")
    trail = goals.select("id").distinct().join(seen.select("id"), "id", "left_semi").select("id", F.array("id").alias("path"), F.col("id").alias("at"))
    for h in range(hops):
        trail = trail.join(back, "at", "left").select("id", F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), F.col("path"))).alias("path"), F.col("parent").alias("at"))
        if h % 8 == 7:
            trail = settled(trail)
    return trail.select("id", "path")
