"""A uniform shuffle into shards of exact sizes. DataFrame and SQL functions only.

Rows of every input partition are permuted locally. How many of a partition's rows go to each shard is drawn
exactly: the matrix of counts (partitions by shards) that a uniform permutation of all rows would give has
rows drawn one after the other from multivariate hypergeometric distributions over what the shards still lack.
The matrix is drawn in two levels, blocks of partitions and then the partitions of each block, so that no task
draws more than about the square root of all rows of the matrix. A partition's first rows then go to the first
shard, the next to the second, and so on; rows are exchanged and permuted again inside their shard. Shard
sizes are exact: they differ by at most one row.

Inside a shard, rows are permuted by a random key whose leading bits cut the shard into parts, so that a shard
isn't one task: a row's slot is its part's offset plus its rank in the part.

Random draws are hashes of the seed and of a row's place, so a repeated task draws the same. The permuted rows
are staged once, for the places of rows must not change between counting and exchanging.

Edge cases: null ids and texts are rows like others; repeated rows have places of their own; fewer rows than
shards leave some shards empty; an empty table gives no rows. Input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, table

SHARDS = 24
SEED = 20_240_917
#: Rows of a shard's part, and the most parts a shard is cut into.
PART_ROWS, MAX_PARTS = 10_000, 4096
MIN_PARTS = 8


def _uniform(*what: str) -> str:
    """SQL: a number in [0, 1) from a hash."""
    return f"(shiftrightunsigned(xxhash64({', '.join(what)}), 11) * {2.0**-53!r}D)"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def log_factorial(x: str) -> str:
    """SQL: ln(x!) by Stirling's series, shifted by 8 so that its error is below 1e-13."""
    z = f"({x} + 9D)"
    series = f"({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + (1 / 12D - (1 / 360D - (1 / 1260D - 1 / (1680D * {z} * {z})) / ({z} * {z})) / ({z} * {z})) / {z}"
    return f"({series} - ln(({x} + 1D) * ({x} + 2D) * ({x} + 3D) * ({x} + 4D)) - ln(({x} + 5D) * ({x} + 6D) * ({x} + 7D) * ({x} + 8D)))"


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL: how many of ``drawn`` of ``total`` things are among its ``good``; the inverse of the distribution at u.

    Values are taken outwards from the mode (mode, +1, -1, +2, ...) until their probabilities add up to more
    than u; beyond 40 standard deviations and 64 values nothing is left that a double could show.
    """
    low, high = "greatest(0L, n - (t - k))", "least(n, k)"
    mode = "greatest(lo, least(hi, bigint(floor((double(n) + 1) * (double(k) + 1) / (double(t) + 2)))))"
    lf = log_factorial
    at_mode = f"exp({lf('double(k)')} - {lf('double(m)')} - {lf('double(k - m)')} + {lf('double(t - k)')} - {lf('double(n - m)')} - {lf('double(t - k - n + m)')} - {lf('double(t)')} + {lf('double(n)')} + {lf('double(t - n)')})"
    spread = "bigint(64 + 40 * sqrt(double(n) * k / greatest(t, 1L) * (t - k) / greatest(t, 1L)))"
    up = "a.p * double(k - a.h) * double(n - a.h) / (double(a.h + 1) * double(t - k - n + a.h + 1))"
    down = "a.q * double(a.l) * double(t - k - n + a.l) / (double(k - a.l + 1) * double(n - a.l + 1))"
    first = "named_struct('h', m, 'l', m, 'p', w, 'q', w, 'sum', w, 'x', if(w > u, m, -1L))"
    go_up = _let(up, "w", "named_struct('h', a.h + 1, 'l', a.l, 'p', w, 'q', a.q, 'sum', a.sum + w, 'x', if(a.sum + w > u, a.h + 1, -1L))")
    go_down = _let(down, "w", "named_struct('h', a.h, 'l', a.l - 1, 'p', a.p, 'q', w, 'sum', a.sum + w, 'x', if(a.sum + w > u, a.l - 1, -1L))")
    step = f"if(a.x >= 0, a, if((i % 2 = 1 or a.l <= lo) and a.h < hi, {go_up}, if(a.l > lo, {go_down}, a)))"
    search = f"aggregate(sequence(1L, greatest(1L, least(hi - lo, 2 * {spread}))), {first}, (a, i) -> {step}, a -> if(a.x >= 0, a.x, m))"
    body = _let(mode, "m", _let(at_mode, "w", search))
    body = f"if(lo = hi, lo, {body})"
    for value, name in ((high, "hi"), (low, "lo"), (u, "u"), (drawn, "n"), (good, "k"), (total, "t")):
        body = _let(f"bigint({value})" if name in "nkt" or name in ("hi", "lo") else value, name, body)
    return body


def _rows_of_matrix(sizes: str, lacks: str, seed: str) -> str:
    """SQL: for an array of (id, n) and what each shard lacks, the array of (id, counts for each shard), drawn row by row."""
    draw = hypergeometric("d.rest", "g", "d.left", _uniform(seed, "r.id", "j"))
    kept = "named_struct('rest', d.rest - g, 'left', d.left - c, 'out', concat(d.out, array(c)))"
    over_shards = (
        "aggregate(zip_with(s.lack, sequence(1, size(s.lack)), (g, j) -> named_struct('g', g, 'j', j)), "
        "named_struct('rest', aggregate(s.lack, 0L, (a, g) -> a + g), 'left', bigint(r.n), 'out', cast(array() as array<bigint>)), "
        f"(d, gj) -> {_let('gj.j', 'j', _let('gj.g', 'g', _let(draw, 'c', kept)))}, d -> d.out)"
    )
    step = _let(over_shards, "c", "named_struct('lack', zip_with(s.lack, c, (x, y) -> x - y), 'rows', concat(s.rows, array(named_struct('id', r.id, 'counts', c))))")
    start = f"named_struct('lack', {lacks}, 'rows', cast(array() as array<struct<id: bigint, counts: array<bigint>>>))"
    return f"aggregate({sizes}, {start}, (s, r) -> {step}, s -> s.rows)"


def communication_matrix(sizes: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(id, counts) from (id, n): how many of each partition's n rows go to every shard."""
    total, partitions = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    width = max(1, round(partitions**0.5))
    ranked = sizes.withColumn("block", F.floor((F.row_number().over(W.orderBy("id")) - 1) / width))
    blocks = ranked.groupBy("block").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("id", "n"))).alias("members"))  # at most width members
    lacks = "array(" + ", ".join(f"{total // shards + (s < total % shards)}L" for s in range(shards)) + ")"
    top = blocks.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("block").alias("id"), "n"))).alias("sizes"))  # about as many blocks
    of_block = top.select(F.explode(F.expr(_rows_of_matrix("sizes", lacks, f"{seed}L"))).alias("r")).select(F.col("r.id").alias("block"), F.col("r.counts").alias("lack"))
    rows = blocks.join(of_block, "block").select(F.explode(F.expr(_rows_of_matrix("members", "lack", f"{seed + 1}L"))).alias("r"))
    return rows.select(F.col("r.id").alias("id"), F.col("r.counts").alias("counts"))


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with shard (0 to shards - 1, sizes at most one apart) and slot (gapless from 0), in a uniformly random order."""
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    # Local permutation: each row's key comes from its place in the input; rows keep to their partitions.
    placed = df.select(*keep).withColumn("_at", F.monotonically_increasing_id()).withColumn("_key", F.expr(f"xxhash64({seed + 2}L, _at)"))
    placed = placed.sortWithinPartitions("_key", "_at").withColumn("_place", F.monotonically_increasing_id())
    placed = stage(placed.select(*keep, F.expr("shiftright(_place, 33)").alias("_from"), F.expr("_place & 8589934591").alias("_rank"), F.expr(f"xxhash64({seed + 3}L, _at)").alias("_again")), "shard-rows")
    sizes = stage(placed.groupBy(F.col("_from").alias("id")).agg(F.count("*").alias("n")), "shard-sizes")
    matrix = stage(communication_matrix(sizes, shards, seed), "shard-matrix")
    total, partitions = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = F.expr("transform(counts, (c, i) -> aggregate(slice(counts, 1, i + 1), 0L, (a, x) -> a + x))")
    matrix = matrix.select(F.col("id").alias("_from"), ends.alias("_ends"))
    if partitions * shards * 8 <= 8 << 20:  # its size is known here; a larger matrix is joined by shuffling
        matrix = F.broadcast(matrix)
    parts = max(MIN_PARTS, min(MAX_PARTS, total // shards // PART_ROWS))
    sent = placed.join(matrix, "_from").withColumn("shard", F.expr("int(aggregate(_ends, 0, (a, e) -> a + if(_rank >= e, 1, 0)))"))
    sent = sent.withColumn("_part", F.expr(f"int(floor(shiftrightunsigned(_again, 11) * {2.0**-53!r}D * {parts}))"))
    counts = sent.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_offset", F.sum("_n").over(W.partitionBy("shard").orderBy("_part")) - F.col("_n")).drop("_n")
    order = W.partitionBy("shard", "_part").orderBy("_again", "_from", "_rank")
    # At most shards * MAX_PARTS small rows.
    ranked = sent.withColumn("_slot", F.row_number().over(order) - 1).join(F.broadcast(offsets), ["shard", "_part"])
    return ranked.select(*keep, "shard", (F.col("_offset") + F.col("_slot")).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard, whose files hold ranges of slots, in slot order and in the order of their names.

    Ranges are cut by the number of rows, so a large shard is written by many tasks.
    """
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shuffle(docs)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op3_sharding": op3_sharding}
SQL: dict[str, str] = {}
