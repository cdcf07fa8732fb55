"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Pieces and gaps (the free ends of open sequences) are tables, range-sorted by length and by size, with ranks. In a
superstep

1. a successor sweep goes through the lengths from long to short: a run of equal pieces takes the smallest gaps
   that hold it, each as many pieces as fit. Pieces that only fit what this superstep leaves over wait for the next
   one; those that fit nothing open new sequences. The sweep reads counts alone (at most ``capacity`` lengths and
   sizes, whatever the input) and gives runs: so many pieces from this rank on go to so many gaps from that rank on;
2. conflicts are resolved by rank: executors give the i-th piece of a run to its i-th place, joining pieces and
   gaps on the gap's rank;
3. the gaps that took pieces shrink, new sequences add theirs, gaps that hold no waiting piece go; repeat.

Lengths fall from superstep to superstep within a sequence, so there are at most about sqrt(2 * capacity) supersteps
(63 for 2,048). Full pieces are sequences by themselves, without any exchange. Ids travel once, to meet their places.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; ties have ranks by row; an
empty table gives no rows. Input columns named like an output are replaced; a length outside 1 to the capacity
raises an error.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, stage, text_batches
from .word_encoder import encoder, vocabulary_path

CAPACITY = 2048
END_ID = 0


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): the documents' ids with the end id; only longer ones are cut."""
    text_batches(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            doc_ids, number, ids = [], [], []
            for doc_id, tokens in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1).to_pylist()), strict=True):
                tokens += end
                for k, at in enumerate(range(0, len(tokens), width)):
                    doc_ids.append(doc_id)
                    number.append(k)
                    ids.append(tokens[at : at + width])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(number, pa.int32()), pa.array([k * capacity for k in number], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class Gaps:
    """Counts of gaps by size, with the sizes that occur in order."""

    def __init__(self, counts: dict[int, int] | None = None):
        self.counts = Counter(counts or {})
        self.sizes = sorted(self.counts)

    def add(self, size: int, n: int) -> None:
        if size > 0 and n > 0:
            if not self.counts[size]:
                insort(self.sizes, size)
            self.counts[size] += n

    def take(self, length: int, pieces: int) -> tuple[int, int, int] | None:
        """(size, gaps taken, pieces a gap): the successor of length, as many gaps as the pieces need; None if nothing holds it."""
        i = bisect_left(self.sizes, length)
        if i == len(self.sizes):
            return None
        size = self.sizes[i]
        each = size // length
        n = min(self.counts[size], -(-pieces // each))
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size], self.sizes[i]
        return size, n, each


def sweep(lengths: dict[int, int], gaps: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """One superstep: runs (length, pieces, gap size or 0 for new sequences, gaps, pieces a gap), and the pieces that wait, by length."""
    there, left_over, runs, waiting = Gaps(gaps), Gaps(), [], {}

    def filled(into: Gaps, size: int, length: int, pieces: int, each: int) -> None:
        into.add(size - each * length, pieces // each)
        if pieces % each:
            into.add(size - pieces % each * length, 1)

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left and (found := there.take(length, left)):
            size, n, each = found
            taken = min(left, n * each)
            runs.append((length, taken, size, n, each))
            filled(left_over, size, length, taken, each)
            left -= taken
        while left and (found := left_over.take(length, left)):  # booked, so that shorter pieces don't count on it
            size, n, each = found
            taken = min(left, n * each)
            filled(left_over, size, length, taken, each)
            waiting[length] = waiting.get(length, 0) + taken
            left -= taken
        if left:
            each = capacity // length
            runs.append((length, left, 0, -(-left // each), each))
            filled(left_over, capacity, length, left, each)
    return runs, waiting


def after(runs: list[tuple[int, int, int, int, int]], gaps: dict[int, int], capacity: int = CAPACITY) -> dict[int, int]:
    """Counts of gaps when the runs have been placed."""
    now = Counter(gaps)
    for length, pieces, size, n, each in runs:
        now[size] -= n
        now[(size or capacity) - each * length] += pieces // each
        if pieces % each:
            now[(size or capacity) - pieces % each * length] += 1
    return {size: n for size, n in now.items() if size > 0 and n > 0}


def ranked(rows: DataFrame, key: str, row: str, label: str) -> DataFrame:
    """rows with ``_rank``, staged: their place (from 0) among rows of one key, by row. A frequent key spans many tasks."""
    rows = rows.repartitionByRange(key, row).sortWithinPartitions(key, row).withColumn("_at", F.monotonically_increasing_id())
    rows = stage(rows, label).withColumn("_part", F.shiftright("_at", 33))
    # One row for each key in each task's range.
    starts = rows.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    base = F.sum("_n").over(W.partitionBy(key).orderBy("_part")) - F.col("_n")
    starts = starts.select(key, "_part", (base - F.col("_first")).alias("_shift"))
    return rows.join(starts, [key, "_part"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _of_run(runs: DataFrame, key: str, first: str, n: str, rank: str = "_rank"):
    """A function that gives rows with ``key`` and ``_rank`` the run they lie in; runs are bounded by the capacity."""
    lists = runs.groupBy(key).agg(F.collect_list(F.struct(*runs.columns)).alias("_runs"))
    inside = F.get(F.filter("_runs", lambda r: (r[first] <= F.col(rank)) & (F.col(rank) < r[first] + r[n])), F.lit(0))
    return lambda rows: rows.join(lists, key).withColumn("_run", inside).drop("_runs")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(_row, sequence_id, offset), staged, for pieces (_row, length < capacity) in as few sequences as best fit finds."""
    spark = pieces.sparkSession
    left = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    waiting = ranked(pieces.select("_row", "length"), "length", "_row", "packing-pieces")
    gaps, counts, opened, out, done = None, {}, 0, None, Counter()
    while left:
        runs, rest = sweep(left, counts, capacity)
        # Ranks: pieces go on where the last superstep ended, gaps of a size are used from the first on.
        rows, used = [], Counter()
        for length, n, size, m, each in runs:
            rows.append((length, done[length], n, size, used[size] if size else opened, m, each))
            done[length] += n
            used[size] += m
            opened += 0 if size else m
        table = spark.createDataFrame(rows, "length long, first long, n long, size long, gap long, gaps long, each long")
        found = _of_run(table, "length", "first", "n")(waiting).where("_run is not null")
        at = F.col("_rank") - F.col("_run.first")
        found = found.select("_row", "length", "_run.size", (F.col("_run.gap") + F.floor(at / F.col("_run.each"))).alias("gap"), (at % F.col("_run.each")).alias("slot"), "_run.first", "_run.n", "_run.each")
        new = found.where("size = 0").select("_row", F.col("gap").alias("sequence_id"), (F.col("length") * F.col("slot")).alias("offset"))
        placed = new
        if gaps is not None:
            old = found.where("size > 0").join(gaps.select("size", F.col("_rank").alias("gap"), "sequence_id"), ["size", "gap"])
            placed = new.unionByName(old.select("_row", "sequence_id", (capacity - F.col("size") + F.col("length") * F.col("slot")).alias("offset")))
        placed = stage(placed, "packing-placed")
        out = placed if out is None else out.unionByName(placed)
        counts, left = after(runs, counts, capacity), rest
        if not left:
            break
        # What the gaps hold now; the first piece of a new sequence makes its gap.
        least = min(left)
        filled = lambda at: F.least(F.col("_run.each"), F.col("_run.n") - at * F.col("_run.each")) * F.col("_run.length")
        fresh = _of_run(table.where("size = 0"), "length", "first", "n")(waiting).where("_run is not null").withColumn("_i", F.col("_rank") - F.col("_run.first")).where("_i % _run.each = 0")
        fresh = fresh.withColumn("_i", F.floor(F.col("_i") / F.col("_run.each"))).select((F.col("_run.gap") + F.col("_i")).alias("sequence_id"), (capacity - filled(F.col("_i"))).alias("size"))
        if gaps is not None:
            runs_of = table.where("size > 0").groupBy("size").agg(F.collect_list(F.struct(*table.columns)).alias("_runs"))
            inside = F.get(F.filter("_runs", lambda r: (r["gap"] <= F.col("_rank")) & (F.col("_rank") < r["gap"] + r["gaps"])), F.lit(0))
            kept = gaps.join(runs_of, "size", "left").withColumn("_run", inside)
            kept = kept.select("sequence_id", (F.col("size") - F.coalesce(filled(F.col("_rank") - F.col("_run.gap")), F.lit(0))).alias("size"))
            fresh = fresh.unionByName(kept)
        counts = {size: n for size, n in counts.items() if size >= least}
        gaps = ranked(fresh.where(F.col("size") >= least), "size", "sequence_id", "packing-gaps")
    return out if out is not None else spark.createDataFrame([], "_row long, sequence_id long, offset long")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (length from 1 to capacity, ...) with sequence_id and offset; sequences of one full piece have numbers below 0."""
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    checked = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit(f"a length is not from 1 to {capacity}")))
    items = items.select(*columns).withColumn("length", checked.cast("long"))
    items = stage(items.withColumn("_row", F.monotonically_increasing_id()), "packing-items")
    full = items.where(F.col("length") == capacity).select(*columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity)
    return full.unionByName(rest.join(place(rest, capacity), "_row").select(*columns, "sequence_id", "offset"))


def packed_rows(docs: DataFrame) -> DataFrame:
    """The digest of the packed pieces of docs. It doesn't ask for the ids, so they aren't moved to meet their places."""
    packed = pack(pieces(docs).withColumn("ids_crc32", F.crc32("ids")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(documents(spark, sf_dir))


QUERIES = {"op8_packing": op8_packing}
SQL: dict[str, str] = {}
