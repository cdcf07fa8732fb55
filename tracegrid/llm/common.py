"""Helpers shared by the corpus operators: tables, the shared folder, Arrow batches, graph components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of an Arrow batch; they bound a Python worker's memory whatever the texts' lengths.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame) -> DataFrame:
    """df over all cores, where its files make fewer tasks than there are cores; such an input is small, so moving it costs little."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]
    return df.repartition(cores) if 0 < tasks < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "documents"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (in tests) one of our own, set as that."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{os.path.join(tempfile.gettempdir(), 'tracegrid-' + uuid.uuid4().hex)}"
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids that may be broadcast (8 bytes each, some 40 in a hashed relation).
BROADCAST_ROWS = 1 << 20


def bounded_broadcast(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """ids, which must be staged or cheap to count, marked for a broadcast only if it is small; else joined by a shuffle."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id reachable over undirected edges, for every node with an edge.

    Alternating large-star and small-star rounds; each is a few shuffles keyed by node with map-side minima, and
    each round's edges are written to the shared folder once, so lost executors cost at most a round. Self-loops
    keep their node; null ends are ignored; no edges give an empty result.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    loops, e = e.where("u = v").select("u"), e.where("u <> v")
    for done in range(max_rounds + 1):
        # Done when every node above another is tied to one node, which is tied to none.
        ends = e.select("u", F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("above"), F.lit(1).alias("below")))
        ends = ends.groupBy("u").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
        if not ends.where("above > 1 or above = 1 and below = 1").limit(1).count():
            break
        if done == max_rounds:
            raise RuntimeError(f"components are not closed after {max_rounds} rounds")
        # Large star: every neighbour above u is tied to the smallest node around u.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every lower neighbour of u, and u, are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x"))
        e = stage(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
    roots = e.select(F.col("v").alias("u")).unionByName(loops).distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
