"""Anomaly scores: scaling, ranks, an isolation forest, local outlier factors, and their blend."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config
from .iterate import settled


def column_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 for 0) of each column, in one pass."""
    row = df.agg(*(x for c in columns for x in (F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")))).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns as z-scores; missing values are 0 after scaling."""
    s = column_stats(df, columns)
    z = {c: F.coalesce((F.col(c).cast("double") - m) / d, F.lit(0.0)) for c, (m, d) in s.items()}
    return df.withColumns(z)


def rank_normalise(df: DataFrame, score: str, key: str, out: str) -> DataFrame:
    """Distinct ranks of score (ties by key) scaled to 0..1.

    A global rank without one huge window: rows are cut into ranges of the score, ranked inside, and shifted by
    the number of rows in the ranges before.
    """
    cuts = df.stat.approxQuantile(score, [i / 64 for i in range(1, 64)], 0.005) if df.limit(1).count() else []
    cuts = sorted(set(cuts))
    part = F.aggregate(F.array(*(F.lit(float(c)) for c in cuts)), F.lit(0), lambda a, c: a + F.when(F.col(score) > c, 1).otherwise(0)) if cuts else F.lit(0)
    cut = df.withColumn("_part", part)
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).withColumn("_all", F.sum("_n").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))  # 64 rows
    local = F.row_number().over(W.partitionBy("_part").orderBy(score, key)) - 1
    return cut.withColumn("_r", local).join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_before") + F.col("_r")) / F.greatest(F.col("_all") - 1, F.lit(1))).drop("_part", "_n", "_before", "_all", "_r")


def quantile_flag(df: DataFrame, score: str, quantile: float = config.ANOMALY_QUANTILE, out: str = "is_anomaly") -> DataFrame:
    """Flag scores at or above the linear quantile."""
    cut = df.agg(F.percentile(score, F.lit(quantile))).first()[0]
    return df.withColumn(out, F.col(score) >= F.lit(cut if cut is not None else math.inf))


# ----------------------------------------------------------------- isolation forest
def _average_path(n: float) -> float:
    """Mean depth of a failed search among n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, cut, left, right, path length of a leaf), the root first."""
    nodes: list = []

    def grow(rows: np.ndarray, d: int) -> int:
        at = len(nodes)
        nodes.append(None)
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(high > low)
        if d >= depth or len(rows) <= 1 or not len(open_):
            nodes[at] = (-1, 0.0, -1, -1, d + _average_path(len(rows)))
            return at
        f = int(rng.choice(open_))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[rows, f] < cut
        if left.all() or not left.any():
            nodes[at] = (-1, 0.0, -1, -1, d + _average_path(len(rows)))
            return at
        a, b = grow(rows[left], d + 1), grow(rows[~left], d + 1)
        nodes[at] = (f, cut, a, b, 0.0)
        return at

    grow(np.arange(len(x)), 0)
    return nodes


def path_lengths(nodes: list, x: np.ndarray) -> np.ndarray:
    f, cut, left, right, depth = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = f[at] >= 0
        if not inner.any():
            return depth[at]
        i = np.flatnonzero(inner)
        node = at[i]
        at[i] = np.where(x[i, f[node]] < cut[node], left[node], right[node])


def grow_forest(df: DataFrame, key: str, columns: list[str], trees: int = config.FOREST_TREES, sample: int = config.FOREST_SAMPLE, seed: int = 42) -> dict:
    """The forest as plain values: columns, usual path, and each tree's nodes.

    A tree sees at most ``sample`` rows by definition of the method; a bounded draw of rows for all trees, the
    smallest hashes, is taken as one top-k.
    """
    pool = min(trees * sample, 32 * sample)
    rows = df.select(key, *(F.col(c).cast("double") for c in columns)).fillna(0.0).orderBy(F.xxhash64(F.lit(seed), key), key).limit(pool).toPandas()
    data = rows[columns].to_numpy(dtype=np.float64)
    size, forest = min(sample, len(data)), []
    for t in range(trees if len(data) else 0):
        rng = np.random.default_rng([seed, t])
        forest.append(grow_tree(data[rng.choice(len(data), size, replace=False)], rng, max(1, math.ceil(math.log2(max(size, 2))))))
    return {"columns": list(columns), "usual": max(_average_path(size), 1e-9), "trees": forest}


def score_forest(df: DataFrame, key: str, model: dict) -> DataFrame:
    """(key, iso): 2 ** (-mean path / usual path); near 1 is isolated. The forest (trees times a few hundred nodes) goes to the workers."""
    columns = model["columns"]
    if not model["trees"]:
        return df.select(key, F.lit(0.5).alias("iso")).limit(0)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            x = b[columns].to_numpy(dtype=np.float64)
            forest = shared.value["trees"]
            total = sum(path_lengths(tree, x) for tree in forest)
            yield pd.DataFrame({key: b[key], "iso": 2.0 ** (-(total / len(forest)) / shared.value["usual"])})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *(F.col(c).cast("double") for c in columns)).fillna(0.0).mapInPandas(score, f"`{key}` {kind}, iso double")


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = config.FOREST_TREES, sample: int = config.FOREST_SAMPLE, seed: int = 42) -> DataFrame:
    """(key, iso) of df's rows by a forest grown on df."""
    return score_forest(df, key, grow_forest(df, key, columns, trees, sample, seed))


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


# ----------------------------------------------------------------- local outlier factor
def neighbours(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(a, b, d): each row's k nearest others. Blocks of rows meet as matrices; each block pair keeps k a row."""
    kind = df.schema[key].dataType.simpleString()
    n = df.count()
    blocks = max(1, math.ceil(n / 4096))
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    left = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.col("block").alias("x"), "y", "k", "v")
    right = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("x", F.col("block").alias("y"), "k", "v")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": [], "d": []})
        b = b.sort_values("k", ignore_index=True)
        x, y, names, others = np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy()), a.k.to_numpy(), b.k.to_numpy()
        step, out = max(1, (1 << 23) // max(1, y.size)), []
        for i in range(0, len(x), step):
            d = np.sqrt(((x[i : i + step, None] - y) ** 2).sum(2))
            d[names[i : i + step, None] == others] = np.inf
            kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            r, c = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
            order = np.lexsort((c, d[r, c], r))  # equal distances by the other's key
            r, c = r[order], c[order]
            few = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append(pd.DataFrame({"a": names[i + r[few]], "b": others[c[few]], "d": d[r[few], c[few]]}))
        return pd.concat(out)

    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(nearest, f"a {kind}, b {kind}, d double")
    best = F.row_number().over(W.partitionBy("a").orderBy("d", "b"))
    return found.withColumn("r", best).where(F.col("r") <= k).drop("r")


def lof(df: DataFrame, key: str, vector: str, k: int = config.LOF_NEIGHBOURS) -> DataFrame:
    """(key, lof): mean reachability density of a row's k neighbours over its own."""
    near = settled(neighbours(settled(df.select(key, vector)), key, vector, k))
    reach = near.groupBy("a").agg(F.max("d").alias("kd"))
    dens = near.join(reach.select(F.col("a").alias("b"), "kd"), "b").groupBy("a").agg((1.0 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    ratio = near.select("a", "b").join(dens.select(F.col("a").alias("b"), F.col("lrd").alias("lb")), "b").groupBy("a").agg(F.avg("lb").alias("lb")).join(dens, "a")
    return ratio.select(F.col("a").alias(key), (F.col("lb") / F.col("lrd")).alias("lof"))


def blend(df: DataFrame, key: str, iso: str = "iso", lof_column: str | None = "lof") -> DataFrame:
    """df with anomaly_score and is_anomaly from the ranks of both scores (of one, where rows are few)."""
    ranked = settled(rank_normalise(settled(df), iso, key, "_iso_rank"))
    if lof_column:
        ranked = rank_normalise(ranked, lof_column, key, "_lof_rank").withColumn("_raw", (1 - config.LOF_WEIGHT) * F.col("_iso_rank") + config.LOF_WEIGHT * F.col("_lof_rank"))
    else:
        ranked = ranked.withColumn("_raw", F.col("_iso_rank"))
    out = settled(rank_normalise(settled(ranked), "_raw", key, "anomaly_score").withColumn("anomaly_score", F.round("anomaly_score", 6)))
    return quantile_flag(out, "anomaly_score").drop("_iso_rank", "_lof_rank", "_raw")


def permutation_importance(df: DataFrame, key: str, columns: list[str], repeats: int = 3, rows: int = 2048, **forest) -> dict[str, float]:
    """Mean change of the forest's score when a column is shuffled, over a bounded draw of rows; sums to 1."""
    drawn = df.orderBy(F.xxhash64(F.lit(9), key), key).limit(rows).select(key, *columns).toPandas()
    out: dict[str, float] = {}
    if drawn.empty:
        return dict.fromkeys(columns, 1.0 / len(columns))
    base = isolation_forest_scores(drawn, drawn, key, columns, **forest)
    for c in columns:
        change = 0.0
        for r in range(repeats):
            moved = drawn.copy()
            moved[c] = drawn[c].to_numpy()[np.random.default_rng([r, 7]).permutation(len(drawn))]
            change += float(np.abs(isolation_forest_scores(drawn, moved, key, columns, **forest) - base).mean())
        out[c] = max(change / repeats, 0.0)
    total = sum(out.values())
    return {c: v / total if total else 1.0 / len(columns) for c, v in out.items()}


def isolation_forest_scores(train: pd.DataFrame, rows: pd.DataFrame, key: str, columns: list[str], trees: int = config.FOREST_TREES, sample: int = config.FOREST_SAMPLE, seed: int = 42) -> np.ndarray:
    """Scores of a small frame by a forest grown on another; the bounded, in-memory form."""
    data = train[columns].fillna(0.0).to_numpy(dtype=np.float64)
    size = min(sample, len(data))
    total = np.zeros(len(rows))
    x = rows[columns].fillna(0.0).to_numpy(dtype=np.float64)
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        total += path_lengths(grow_tree(data[rng.choice(len(data), size, replace=False)], rng, max(1, math.ceil(math.log2(max(size, 2))))), x)
    return 2.0 ** (-(total / trees) / max(_average_path(size), 1e-9))
