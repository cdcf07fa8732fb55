"""N-gram Jaccard self-join by count vectors: which whole texts share 75 % of their five-word shingles.

1. Texts with equal shingle sets collapse to one representative (128-bit digest of the set); what follows is keyed by
   the representative's row, never by doc_id.
2. Tiles: a set orders its shingles, frequent ones last and the others by hash, and goes to the cells of its first
   n - ceil(0.75 n) + 1. Two sets that link share a cell. Those cells are a uniform draw from the set's rare
   shingles, of which all but a quarter of n lie in any set it links with; a set with so few shared cells that this
   has a chance below ``CHANCE`` (Serfling's bound, far below that of two hashes being equal) links with nothing.
   The smallest row of a cell leads it, and all cells with one leader are one tile, so sets with many cells in
   common meet once. Frequencies are counts of all shingles of the corpus in hashed bins; any order is exact, this
   one keeps common passages from making tiles.
3. Shingles are hashed into groups, and a set's group counts are a point. Every tile's points, whatever their
   number, are packed into R-trees (blocks of ``BLOCK`` points, every pair of blocks) that are joined under the
   bound on the overlap: the sum of coordinate minima must reach 3/7 of both sizes.
4. Survivors are verified on the shingles themselves. A tile whose trees would give more than ``FEW`` pairs for each
   set is full of near copies: it first ties its sets to the one nearest their mean, and is joined again once
   components are known, skipping pairs and whole nodes of one component.

No partner, candidate, cell or tile is capped. Shingles are 64-bit hashes of five word hashes.

Edge cases: a null or empty text, or one without words, has no shingles and stands alone; fewer than five words
are one shingle. Rows link by their texts alone: repeated rows link as equal texts do, rows of one doc_id with
different texts are different sets. component_id is the smallest doc_id that isn't null in the row's component, null
if there is none. An empty table gives no rows; input columns named like an output are replaced, others are
ignored unless carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, connected_components, documents, stage, text_batches
from .rtree import Forest, count_vector, may_link, overlap_bound, pack_vector, unpack_vectors

WIDTH = 5
P, Q = 75, 100
BLOCK = 2048
#: Pairs of a tile for each of its sets beyond which its sets are tied to one of them first.
FEW = 8
#: A shingle of fewer sets than this makes small cells; beyond it, order matters.
FREQUENT = 128
#: Bins of the table of frequencies: about 64 a text, between these powers of two; counted in slices of 2**18.
MIN_BINS, MAX_BINS, SLICE = 20, 28, 18
#: Bins that are passed to the tasks, the most frequent first (8 bytes each); others count as rare, which is exact too.
LISTED = 1 << 20
CHUNK = 1 << 22
WORD_CACHE = 500_000
CHANCE = 1e-18
#: Cells are named by so many bits of a shingle; texts that meet in a cell by chance fail the bound.
CELL_BITS = 44
#: Rows (three numbers each) of pairs that may be broadcast to the texts.
PAIR_ROWS = 1 << 19
#: Rows that a task of the tiles' join holds at once, besides one pair of blocks.
ROWS = 1 << 14

_words: dict[bytes, int] = {}


def shingles(text: str | None, unique: bool = True) -> np.ndarray:
    """64-bit hashes of the text's shingles; sorted and distinct, unless unique is false."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > WORD_CACHE:
        _words.clear()
    found = list(map(_words.get, words))
    if None in found:
        for i, w in enumerate(words):
            if found[i] is None:
                found[i] = _words[w] = xxhash.xxh64_intdigest(w)
    h = np.array(found, dtype=np.uint64)
    k = min(WIDTH, len(words))
    m, r = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
    n = len(words) - k + 1
    out = h[:n] + np.uint64(k)
    for j in range(1, k):
        out = (out ^ (out >> r)) * m + h[j : n + j]
    out = (out ^ (out >> r)) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out) if unique else out


def prefix_length(n: int) -> int:
    return n - -(-P * n // Q) + 1 if n else 0


def least_shared(n: int, rare: int) -> int:
    """How many of its cells a set that links shares at least, but for CHANCE: n shingles, of which so many are rare."""
    p = prefix_length(n)
    if not p or rare < p:
        return 1
    sure = (rare - (p - 1)) / rare  # of its rare shingles
    return max(1, math.ceil(p * (sure - math.sqrt(-math.log(CHANCE) * (1 - (p - 1) / rare) / (2 * p)))))


def frequent(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, bins, levels): the hashed bins that hold frequent shingles, and the log2 of their counts over all texts.

    Tasks send their counts as compressed slices of the table of bins, a few bits for each shingle.
    """
    spark = docs.sparkSession
    bits = min(MAX_BINS, max(MIN_BINS, (64 * docs.count()).bit_length()))
    mask, per = np.uint64((1 << bits) - 1), 1 << SLICE

    def count(batches):
        import zstandard

        press, held, n = zstandard.ZstdCompressor(level=1), [], 0

        def out():
            at, times = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(at, np.arange(0, (1 << bits) + 1, per))
            for k in np.flatnonzero(np.diff(cuts)):
                part = np.zeros(per, dtype=np.uint8)
                part[at[cuts[k] : cuts[k + 1]] - k * per] = np.minimum(times[cuts[k] : cuts[k + 1]], 255)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([press.compress(part.tobytes())], pa.binary())], ["slice", "counts"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = (shingles(text, False) & mask).astype(np.uint32)
                held.append(s)
                n += len(s)
                if n >= CHUNK:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    def add(batches):
        import zstandard

        press, now, total = zstandard.ZstdDecompressor(), None, np.zeros(per, dtype=np.int64)

        def out():
            at = np.flatnonzero(total >= FREQUENT)
            return pa.RecordBatch.from_arrays([pa.array(at + now * per, pa.int64()), pa.array(total[at])], ["bin", "n"])

        for batch in batches:
            for k, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if now is not None:
                        yield out()
                    now, total = k, np.zeros(per, dtype=np.int64)
                total += np.frombuffer(press.decompress(counts), dtype=np.uint8)
        if now is not None:
            yield out()

    slices = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition("slice").sortWithinPartitions("slice")
    top = slices.mapInArrow(add, "bin long, n long").orderBy(F.desc("n"), "bin").limit(LISTED).toPandas()
    order = np.argsort(top["bin"].to_numpy())
    levels = np.log2(top["n"].to_numpy(dtype=np.float64)).astype(np.uint8) + 1
    return bits, top["bin"].to_numpy(dtype=np.uint64)[order], levels[order]


def sets(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carry and (id, n, d1, d2, cells, n_hot, need, vector, text), staged.

    They are the row, the size and digest of its set, its cells, of which the last n_hot are frequent, how many of
    them it must share, and its packed counts.
    """
    listed = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def run(batches):
        import xxhash

        for batch in batches:
            bits, bins, levels = listed.value
            mask = np.uint64((1 << bits) - 1)
            found: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                at, order = s & mask, np.zeros(len(s), dtype=np.uint8)
                if len(bins):
                    place = np.minimum(np.searchsorted(bins, at), len(bins) - 1)
                    order = np.where(bins[place] == at, levels[place], 0)
                by = np.argsort(order, kind="stable")[: prefix_length(len(s))]
                cells = (s[by] >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                row = (len(s), (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63), cells.tobytes(), int(np.count_nonzero(order[by])), least_shared(len(s), int(np.count_nonzero(order == 0))), pack_vector(count_vector(s)))
                for column, value in zip(found, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
            made = [pa.array(x, k) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *MADE])

    kept = docs.select(*carry, *(["text"] if "text" not in carry else []))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    rows = kept.mapInArrow(run, f"{kinds}, n long, d1 long, d2 long, cells binary, n_hot int, need int, vector binary")
    return stage(rows.withColumn("id", F.monotonically_increasing_id()), "jaccard-sets")


MADE = ["n", "d1", "d2", "cells", "n_hot", "need", "vector"]


def _spread(batches):
    """(cell, hot, id) for every cell of every set."""
    for batch in batches:
        cells = [np.frombuffer(c, dtype="<i8") for c in batch.column("cells").to_pylist()]
        n, hot, ids = np.array([len(c) for c in cells]), batch.column("n_hot").to_numpy(), batch.column("id").to_numpy()
        every, ends = np.concatenate(cells), np.cumsum(n)
        place = np.arange(len(every))
        marks, ids = place >= np.repeat(ends - hot, n), np.repeat(ids, n)
        for at in range(0, len(every), 1 << 18):
            r = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(every[r]), pa.array(marks[r]), pa.array(ids[r])], ["cell", "hot", "id"])


def _shared(batches):
    """Of rows sorted by cell, those whose cell has several sets."""
    last: pa.RecordBatch | None = None  # one row, which may go on in the next batch
    before = False  # whether it goes with the row before it
    for batch in batches:
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        cell = rows.column(0).to_numpy()
        same = cell[1:] == cell[:-1]
        ok = np.r_[before, same] | np.r_[same, False]
        last, before = rows.slice(len(cell) - 1), bool(np.r_[before, same][-1])
        yield rows.slice(0, len(cell) - 1).filter(pa.array(ok[:-1]))
    if before:
        yield last


def _led(batches):
    """From rows sorted by cell and id: distinct (tile, id) of cells with several sets; a cell's first set leads it."""
    cell, leader = None, -1
    pairs: list[np.ndarray] = []

    def out():
        x = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["tile", "id"])

    for batch in batches:
        c, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.r_[c[0] != cell, c[1:] != c[:-1]]
        leads = np.where(new, i, -1)
        if not new[0]:
            leads[0] = leader
        leads = leads[np.maximum.accumulate(np.where(new | (np.arange(len(c)) == 0), np.arange(len(c)), 0))]
        cell, leader = c[-1], leads[-1]
        if (~new).any():
            pairs.append(np.stack([leads[~new], i[~new]], 1))
        if sum(map(len, pairs)) > 400_000:
            yield out()
            pairs = []
    if pairs:
        yield out()


def tiles(points: DataFrame) -> DataFrame:
    """(tile, id), staged: the sets that share a cell with others, under each leader of such a cell; the leader too.

    Frequent cells, which may hold any share of the sets, get their leaders by partial aggregation.
    """
    spread = lambda rows: rows.select("id", "cells", "n_hot").mapInArrow(_spread, "cell long, hot boolean, id long")
    by_cell = lambda rows, f, out: rows.select("cell", "id").repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(f, out)
    shared = stage(by_cell(spread(points).where("not hot"), _shared, "cell long, id long"), "jaccard-cells")
    enough = shared.groupBy("id").agg(F.count("*").alias("has")).join(points.select("id", "need"), "id").where("has >= need")
    enough = stage(enough.select("id"), "jaccard-enough")
    rare = by_cell(shared.join(bounded_broadcast(enough), "id", "left_semi"), _led, "tile long, id long")
    hot = spread(points.where("n_hot > 0")).where("hot").select("cell", "id")
    hot = hot.join(hot.groupBy("cell").agg(F.min("id").alias("tile")), "cell").where("id <> tile").select("tile", "id")
    met = stage(rare.unionByName(hot).distinct(), "jaccard-tiles")
    return met.unionByName(met.select("tile", F.col("tile").alias("id")).distinct())


def _blocks(rows: DataFrame, key: str, by: str) -> DataFrame:
    """rows with the number of blocks of their key."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return rows.join(sizes, key).withColumn("i", F.pmod(F.xxhash64(by), "blocks").cast("int"))


def _grouped(batches, columns: list[str], group):
    """Call group(table) with whole groups of rows that are equal in columns and follow each other, many at a time."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(last: bool):
        nonlocal held, n
        t = pa.Table.from_batches(held).combine_chunks()
        end = t.num_rows
        if not last:
            keys = [t.column(c).to_numpy() for c in columns]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held, n = t.slice(end).combine_chunks().to_batches(), t.num_rows - end
        return t.slice(0, end)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            whole = cut(False)
            if whole.num_rows:
                yield from group(whole)
    if n:
        yield from group(cut(True))


def _join_tiles(limited: bool):
    """The join of whole groups (tile, x, y) of rows with i, id, mark, n, vector; limited: see FEW."""

    def group(t: pa.Table):
        tile, x, y, i, ids, mark, n = (t.column(c).to_numpy() for c in ("tile", "x", "y", "i", "id", "mark", "n"))
        vector = unpack_vectors(t.column("vector").to_pylist())
        segment = np.cumsum(np.r_[False, (tile[1:] != tile[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        side = (i != x).astype(np.int64)  # of two blocks, which one
        forest = Forest(2 * segment + side, vector, n, mark)
        same, two = x[first] == y[first], np.zeros(len(first), dtype=bool)
        two[segment[side == 1]] = True
        two &= np.isin(2 * np.arange(len(first)), forest.trees)
        alone, across = np.flatnonzero(same), np.flatnonzero(~same & two)
        sizes, seen, open_ = np.bincount(segment), np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=bool)
        left, right = 2 * np.r_[alone, across], np.r_[2 * alone, 2 * across + 1]
        a, b = [], []
        for u, v in forest.join(left, right, P, Q):
            if limited:
                seen += np.bincount(segment[u], minlength=len(first))
                open_ |= seen > FEW * sizes
                go_on = ~open_[segment[u]]
                u, v = u[go_on], v[go_on]
            a.append(u)
            b.append(v)
        a, b = (np.concatenate(z) if z else np.empty(0, dtype=np.int64) for z in (a, b))
        go_on = ~open_[segment[a]]
        a, b = a[go_on], b[go_on]
        for k in np.flatnonzero(open_):
            rows = np.flatnonzero(segment == k)
            own, other = (rows, rows) if same[k] else (rows[side[rows] == 0], rows[side[rows] == 1])
            mean = vector[own].mean(0)
            hub = own[np.abs(vector[own] - mean).sum(1).argmin()]
            other = other[other != hub]
            other = other[may_link(overlap_bound(vector[hub][None], vector[other]), n[hub], n[other], P, Q)]
            a, b = np.r_[a, np.full(len(other), hub)], np.r_[b, other]
        marks = open_[segment[a]]
        u, v = ids[a], ids[b]
        swap = (u > v) & ~marks  # a star's centre stays on one side
        u, v = np.where(swap, v, u), np.where(swap, u, v)
        names, todo = ["a", "b", "tile"], tile[first][open_]
        for at in range(0, len(u), 1 << 18):
            r = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(u[r]), pa.array(v[r]), pa.nulls(len(u[r]), pa.int64())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(todo), pa.int64()), pa.nulls(len(todo), pa.int64()), pa.array(todo)], names)

    return lambda batches: _grouped(batches, ["tile", "x", "y"], group)


def candidates(met: DataFrame, points: DataFrame, limited: bool) -> DataFrame:
    """(a, b, tile), staged: pairs that pass the bound, and (with a null pair) the tiles that aren't done yet.

    met has (tile, id, mark); every pair of a tile's blocks is one group.
    """
    rows = _blocks(met, "tile", "id").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tile", F.least("i", "k").alias("x"), F.greatest("i", "k").alias("y"), "i", "id", "mark")
    rows = rows.join(points.select("id", "n", "vector"), "id").select("tile", "x", "y", "i", "id", "mark", "n", "vector")
    return stage(rows.repartition("tile", "x", "y").sortWithinPartitions("tile", "x", "y").mapInArrow(_join_tiles(limited), "a long, b long, tile long"), "jaccard-pairs")


def _texts(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, text) of the sets in pairs."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-ids")
    return whole.select("id", "text").join(bounded_broadcast(ids), "id", "left_semi")


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, staged: 100 * intersection >= 75 * union of their shingles.

    The text of a goes once to each block of its partners, each partner's text once to a.
    """
    pairs = stage(_blocks(pairs, "a", "b").select("a", "i", "b"), "jaccard-partners")
    rows = pairs.unionByName(pairs.select("a", "i", F.col("a").alias("b")).distinct())

    def run(batches):
        centre, s = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            ok = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                t = shingles(text)
                if a == b:
                    centre, s = a, t
                both = len(np.intersect1d(s, t, assume_unique=True)) if a != b and a == centre else 0
                ok.append(both > 0 and Q * both >= P * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    rows = bounded_broadcast(rows, PAIR_ROWS)  # small, it meets the texts where they lie
    rows = _texts(pairs, whole).withColumnRenamed("id", "b").join(rows, "b").select("a", "i", "b", "text")
    rows = rows.repartition("a", "i").sortWithinPartitions("a", "i", F.col("a") != F.col("b"))
    return stage(rows.mapInArrow(run, "a long, b long"), "jaccard-links")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose sets lie in different components."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def clusters(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The staged rows (carry, id, n, ...) of docs, and (id, root) of each: rows of one root are linked."""
    text_batches(docs.sparkSession)
    whole = sets(docs, carry)
    own = whole.where("n > 0").select("id", "d1", "d2")
    reps = stage(own.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "jaccard-reps")
    copies = stage(own.join(reps.where("rows > 1"), ["d1", "d2"]).where("id <> rep").select("id", "rep"), "jaccard-copies")
    points = whole.where("n > 0").join(bounded_broadcast(copies.select("id")), "id", "left_anti")
    met = tiles(points)

    pairs = candidates(met.withColumn("mark", F.col("id")), points, True)
    links = verified(pairs.where("a is not null").select("a", "b").distinct(), whole)
    found = stage(connected_components(links, "a", "b"), "jaccard-components")
    todo = stage(pairs.where("a is null").select("tile").distinct(), "jaccard-open")
    if todo.limit(1).count():
        rows = met.join(todo, "tile").join(found.withColumnRenamed("node", "id"), "id", "left").select("tile", "id", F.coalesce("component", "id").alias("mark"))
        late = stage(candidates(rows, points, False).select("a", "b").distinct(), "jaccard-pairs")
        # One partner for each set first; then only pairs that aren't connected yet.
        links = links.unionByName(verified(late.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), whole))
        found = stage(connected_components(links, "a", "b"), "jaccard-components")
        links = links.unionByName(verified(_across(late, found), whole))
        found = stage(connected_components(links, "a", "b"), "jaccard-components")
    named = found.select(F.col("node").alias("rep"), "component")
    labels = whole.select("id").join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id")).join(named, "rep", "left")
    return whole, stage(labels.select("id", F.coalesce("component", "rep").alias("root")), "jaccard-roots")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    whole, roots = clusters(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    found = whole.select("id", "doc_id", F.col("n").alias("n_shingles")).join(roots, "id")
    names = stage(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-names")  # written, so that the join can split a large component
    return found.join(names, "root").select("doc_id", "n_shingles", "component_id")


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of docs: that with the smallest doc_id, nulls last, then the first row."""
    whole, roots = clusters(docs, docs.columns)
    found = whole.select("id", "doc_id").join(roots, "id")
    many = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    drop = stage(found.join(stage(many, "jaccard-names"), "root").where("id <> best.id").select("id"), "jaccard-drops")
    return whole.join(bounded_broadcast(drop), "id", "left_anti").select(*docs.columns)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))


QUERIES = {"op6_jaccard": op6_jaccard}
#: Shingles as lists of words, pairs by a join on them, then every document's smallest reachable id.
SQL: dict[str, str] = {
    "op6_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) WHEN len(w) > 0 THEN [w] ELSE [] END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
li AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id a, y.doc_id b, count(*) o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
 JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
reach(id, root) AS (SELECT DISTINCT a, a FROM li UNION SELECT li.b, reach.root FROM reach JOIN li ON li.a = reach.id WHERE li.b >= reach.root),
co AS (SELECT id, min(root) component FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) n_shingles, coalesce(co.component, w.doc_id) component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN co ON co.id = w.doc_id""",
}
