"""Embedding near-duplicates: all pairs of vectors by int8 tile products with rigorous error bounds.

Each vector, scaled to length 1, is rounded to int8 codes with a scale of its own; the length of what rounding
left off is kept. By Cauchy-Schwarz a pair's cosine differs from its scaled product of codes by at most
(1 + e) f + e (1 + f) + e f, for the errors e and f of both. Pairs whose product plus that bound misses the
threshold can't link, pairs whose product minus it reaches the threshold do; only the others are recomputed
in double precision. Products of codes are whole numbers below 2**24, so a float32 product of tiles has them
exactly (longer vectors use float64).

Equal vectors collapse into one class each, named by its own number, whatever vec_ids it has. The classes are dealt
to ``tiles`` by hash, and every pair of tiles is one task, which gets codes, not vectors: it counts each class's sure
links, returns a spanning forest of them, and names the classes that have a doubtful pair. Only those classes' vectors
then go to the same pairs of tiles, where their doubtful pairs, found again from the same codes, are recomputed.
What a task returns is linear in its rows whatever the number of links. Every pair of vectors is compared; the work
is quadratic, in blocks, as the contract asks for all rows against all rows.

Edge cases: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing; vectors
of different lengths don't link. Rows link by their vectors alone: repeated rows of one vec_id are vectors each, and
a row without a vec_id links like others. component_id is the smallest vec_id that isn't null in the row's
component, null if there is none; kept is null where vec_id is. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, stage, table, text_batches

THRESHOLD = 0.95
TILE_ROWS, MIN_TILES = 16_384, 10
INNER = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error lengths of the rows of x, scaled to length 1."""
    # Scaled by the largest component first, so that no square overflows or vanishes.
    top = np.abs(x).max(1)
    unit = x / top[:, None]
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - scale[:, None] * codes
    return codes, scale, np.sqrt((rest * rest).sum(1)) * (1 + 1e-12) + 1e-12


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows, in double precision."""
    a, b = (v / np.abs(v).max(1)[:, None] for v in (a, b))
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


class Forest:
    """Components of local rows, by arrays of edges."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def tie(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            u, v = self.root[u], self.root[v]
            apart = u != v
            u, v = u[apart], v[apart]
            np.minimum.at(self.root, np.maximum(u, v), np.minimum(u, v))
            while (nxt := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = nxt


class Tile:
    """Codes of the vectors of a tile, as matrices."""

    def __init__(self, t: pa.Table, dim: int):
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.int8).reshape(-1, dim)
        self.scale, self.error = t.column("scale").to_numpy(), t.column("error").to_numpy()


def met_pairs(x: Tile, y: Tile | None, threshold: float):
    """Yield (rows of x, rows of y, sure) of the pairs that may link; y None: x with itself, each pair once.

    Codes and products of codes are whole numbers that the kind of float has exactly, so the same pairs come out
    for any subset of rows.
    """
    same = y is None
    y = x if same else y
    kind = np.float32 if x.codes.shape[1] <= 1000 else np.float64
    for i in range(0, len(x.codes), INNER):
        r = slice(i, i + INNER)
        left = x.codes[r].astype(kind)
        for j in range(i if same else 0, len(y.codes), INNER):
            c = slice(j, j + INNER)
            product = left @ y.codes[c].T.astype(kind)
            product *= x.scale[r, None].astype(kind)
            product *= y.scale[None, c].astype(kind)
            # What the scales lose as float32 is below 1e-6.
            slack = (1 + x.error[r])[:, None] * y.error[None, c] + x.error[r, None] * (1 + 2 * y.error[None, c]) + 2e-6
            u, v = np.nonzero(product + slack >= threshold)
            if same and i == j:
                u, v = u[u < v], v[u < v]
            if len(u):
                yield i + u, j + v, product[u, v] - slack[u, v] >= threshold


def tile_links(pairs, n_x: int, weight_x: np.ndarray, n_y: int, weight_y: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(weighted links, roots) of n_x + shift rows from pairs (u, v); rows of y come shift behind."""
    n = n_x if not shift else n_x + n_y
    links, forest = np.zeros(n, dtype=np.int64), Forest(n)
    for u, v in pairs:
        links += np.bincount(u, weights=weight_y[v], minlength=n).astype(np.int64)
        links += np.bincount(v + shift, weights=weight_x[u], minlength=n).astype(np.int64)
        forest.tie(u, v + shift)
    return links, forest.root


EMPTY = pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "doubt": pa.array([], pa.bool_()), "x": pa.array([], pa.int32()), "y": pa.array([], pa.int32())})


def _join(threshold: float, doubtful: bool):
    """The task of a pair of tiles: sure links and the rows in doubt, or from the latter's vectors the doubtful links."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        tile, x, y, dim = t.column("tile").to_numpy(), t.column("x")[0].as_py(), t.column("y")[0].as_py(), t.column("dim")[0].as_py()
        a, b = np.flatnonzero(tile == x), np.flatnonzero(tile == y)
        if x != y and not (len(a) and len(b)):
            a = b = a[:0]
        order = a if x == y else np.concatenate([a, b])
        cls, weight = t.column("cls").to_numpy(), t.column("n").to_numpy()
        if not len(order):
            return EMPTY
        left, right = Tile(t.take(pa.array(a)), dim), None if x == y else Tile(t.take(pa.array(b)), dim)
        shift = 0 if x == y else len(a)
        doubt = np.zeros(len(order), dtype=bool)

        def sure():
            for u, v, ok in met_pairs(left, right, threshold):
                doubt[u[~ok]] = True
                doubt[v[~ok] + shift] = True
                yield u[ok], v[ok]

        def settled():
            raw = np.frombuffer(b"".join(t.column("raw").to_pylist()), dtype="<f8").reshape(len(tile), dim)
            for u, v, ok in met_pairs(left, right, threshold):
                u, v = u[~ok], v[~ok]
                for at in range(0, len(u), 1 << 16):
                    i, j = u[at : at + (1 << 16)], v[at : at + (1 << 16)]
                    linked = cosines(raw[a[i]], raw[b[j]]) >= threshold
                    yield i[linked], j[linked]

        links, root = tile_links(settled() if doubtful else sure(), len(a), weight[a], len(b), weight[b], shift)
        found = np.flatnonzero((links > 0) | doubt)
        name = cls[order]
        return pa.table({"cls": name[found], "links": links[found], "root": name[root[found]], "doubt": doubt[found], "x": pa.array(np.full(len(found), x), pa.int32()), "y": pa.array(np.full(len(found), y), pa.int32())})

    return run


def encoded(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, d1, d2, raw, codes, scale, error), staged; dim 0 where a vector can't link."""

    def run(batches):
        import xxhash

        for batch in batches:
            raw, dims, d1, d2, codes, scales, errors = ([] for _ in range(7))
            for v in batch.column(1).to_pylist():
                a = np.array(v if v and None not in v else [], dtype=np.float64)
                if not len(a) or not np.isfinite(a).all() or not a.any():
                    a = a[:0]
                a = a + 0.0  # -0.0 equals 0.0
                b = a.tobytes()
                digest = xxhash.xxh3_128_intdigest(b)
                code, scale, error = quantise(a[None]) if len(a) else (a.astype(np.int8), [0.0], [0.0])
                row = (b, len(a), (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63), code.tobytes(), float(scale[0]), float(error[0]))
                for column, value in zip((raw, dims, d1, d2, codes, scales, errors), row, strict=True):
                    column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            made = [pa.array(x, k) for x, k in zip((dims, d1, d2, raw, codes, scales, errors), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["vec_id", "dim", "d1", "d2", "raw", "codes", "scale", "error"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return stage(rows.mapInArrow(run, "vec_id long, dim int, d1 long, d2 long, raw binary, codes binary, scale double, error double"), "vectors")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tiles: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    text_batches(vectors.sparkSession)
    rows = encoded(vectors)
    first = [F.first(c).alias(c) for c in ("dim", "raw", "codes", "scale", "error")]
    reps = rows.where("dim > 0").groupBy("d1", "d2").agg(F.count("*").alias("n"), *first).withColumn("cls", F.monotonically_increasing_id())
    reps = stage(reps, "vector-classes")
    n = reps.count()
    tiles = tiles or max(1, min(MIN_TILES, n // 512), -(-n // TILE_ROWS))
    tile = F.pmod(F.xxhash64("cls"), F.lit(tiles)).cast("int")
    dealt = reps.withColumn("tile", tile).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.select("dim", F.least("tile", "k").alias("x"), F.greatest("tile", "k").alias("y"), "tile", "cls", "n", "codes", "scale", "error", "raw")
    schema = "cls long, links long, root long, doubt boolean, x int, y int"
    met = stage(dealt.drop("raw").groupBy("dim", "x", "y").applyInArrow(_join(threshold, False), schema), "vector-links")
    again = dealt.join(met.where("doubt").select("cls", "x", "y"), ["cls", "x", "y"], "left_semi")
    met = met.unionByName(stage(again.groupBy("dim", "x", "y").applyInArrow(_join(threshold, True), schema), "vector-links"))

    links = met.groupBy("cls").agg(F.sum("links").alias("links"))
    found = stage(connected_components(met.where("cls <> root").select("cls", "root").distinct(), "cls", "root"), "vector-components")
    classes = reps.select("d1", "d2", "cls", "n").join(links, "cls", "left").join(found.withColumnRenamed("node", "cls"), "cls", "left")
    classes = stage(classes.select("d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("root")), "vector-roots")
    linked = rows.where("dim > 0").select("vec_id", "d1", "d2").join(classes, ["d1", "d2"])
    names = stage(linked.groupBy("root").agg(F.min("vec_id").alias("component_id")), "vector-names")
    out = linked.join(names, "root").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embeddings": op9_embeddings}
#: Pairs in double precision, then every vector's smallest reachable id.
SQL: dict[str, str] = {
    "op9_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
li AS MATERIALIZED (SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.norm * b.norm) END >= 0.95),
reach(id, root) AS (SELECT DISTINCT a, a FROM li UNION SELECT li.b, reach.root FROM reach JOIN li ON li.a = reach.id WHERE li.b >= reach.root),
co AS (SELECT id, min(root) component FROM reach GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM li WHERE li.a = v.vec_id) n_links, coalesce(co.component, v.vec_id) component_id, v.vec_id = coalesce(co.component, v.vec_id) kept FROM v LEFT JOIN co ON co.id = v.vec_id""",
}
