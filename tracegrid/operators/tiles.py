"""Weighted graphs in tiles: edges lie on the executors, packed by node; the driver holds a few numbers a node.

Nodes are numbered in the order of their ids. A tile has all edges of its nodes, in both directions, so that a round
over the graph is one job without a shuffle: it gets the state of all nodes as a broadcast and returns what changed.
This is for graphs whose nodes, counted first, are few beside their edges; others take the joins of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import settled

#: Nodes, and bytes of their ids, that the driver may hold.
MOST_NODES, MOST_BYTES = 4_000_000, 64_000_000
#: Edges, each in both directions, that a tile is meant to have; pairs that are dealt out at a time.
TILE_EDGES, DEAL_PAIRS = 1 << 17, 1 << 18
#: Edges that are contracted at a time: fewer parts of tiles, more parallel edges added up before they move.
CONTRACT_EDGES = 1 << 20
#: Bytes of an Arrow batch and tasks a core when tiles are gone through; small batches keep workers small, few tasks start fast.
BATCH_BYTES, TASKS = 4 << 20, 3
LOW = (1 << 32) - 1
LOOSE = "tile int, ids binary, tos binary, ws binary"
PACKED = "tile int, nodes binary, counts binary, sums binary, loops binary, tos binary, ws binary"


class Names:
    """The ids of all nodes in their order, in the driver and as a broadcast."""

    def __init__(self, rows: DataFrame, ids: pa.Array) -> None:
        self.rows, self.n = rows, len(ids)
        self.order = pc.sort_indices(ids)
        self.shared = rows.sparkSession.sparkContext.broadcast(ids.take(self.order))

    def column(self, table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).combine_chunks().take(self.order).to_numpy(zero_copy_only=False)

    def labelled(self, labels: np.ndarray, present: np.ndarray, id_name: str, label_name: str) -> DataFrame:
        """(id, label): each present node's id, and the id of the node that labels names."""
        spark, shared, kind = self.rows.sparkSession, self.shared, self.rows.schema["id"].dataType.simpleString()
        given = spark.sparkContext.broadcast((labels, present))

        def name(batches):
            for b in batches:
                at = b.column(0).to_numpy()
                at = at[given.value[1][at]]
                yield pa.RecordBatch.from_arrays([shared.value.take(pa.array(at)), shared.value.take(pa.array(given.value[0][at]))], names=[id_name, label_name])

        return spark.range(self.n).mapInArrow(name, f"{id_name} {kind}, {label_name} {kind}")


def few_names(ids: DataFrame, more: dict | None = None) -> tuple[Names, pa.Table] | None:
    """Of distinct ids (id), with more columns over them; None if the driver can't hold them."""
    rows, found = settled(ids.where("id is not null"), n=F.count(F.lit(1)), size=F.sum(F.octet_length(F.col("id").cast("string"))))
    if found["n"] > MOST_NODES or (found["size"] or 0) > MOST_BYTES:
        return None
    table = rows.select("id", *(c.alias(k) for k, c in (more or {}).items())).toArrow()
    return Names(rows, table.column("id").combine_chunks()), table


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= least:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _ints(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int32)


def _doubles(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.float64)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


class Places:
    """Where nodes are: in about so many tiles, each of nodes whose turns are all alike (their kind) where that leaves tiles enough."""

    def __init__(self, tiles: int, turns: list[np.ndarray] = ()) -> None:
        kinds = 1 << len(turns) if 0 < len(turns) < 8 and tiles >= 2 << len(turns) else 1
        self.each, self.tiles = tiles // kinds, tiles // kinds * kinds
        self.kinds = sum(t.astype(np.uint8) << j for j, t in enumerate(turns)) if kinds > 1 else None

    def of(self, ids: np.ndarray) -> np.ndarray:
        return ids % self.each if self.kinds is None else ids % self.each + self.kinds[ids] * np.int32(self.each)


def _dealt(ids: np.ndarray, tos: np.ndarray, ws: np.ndarray, places: Places) -> pa.RecordBatch:
    """Directed edges, those of a tile in one row."""
    tile = places.of(ids)
    order = np.argsort(tile.astype(np.uint16) if places.tiles < 1 << 16 else tile, kind="stable")
    tile, ids, tos, ws = tile[order], ids[order].astype(np.int32), tos[order].astype(np.int32), ws[order]
    cuts = _starts(tile)
    parts = lambda x: pa.array([p.tobytes() for p in np.split(x, cuts[1:])] if len(x) else [], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(tile[cuts].astype(np.int32)), parts(ids), parts(tos), parts(ws)], names=["tile", "ids", "tos", "ws"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LOOSE, those of a tile after each other, as one row of PACKED a tile; parallel edges are added up."""

    def packed(tile: int, rows: list) -> pa.RecordBatch:
        ids, tos, ws = (np.concatenate([r[i] for r in rows]) for i in range(3))
        key = ids.astype(np.int64) << 32 | tos
        order = np.argsort(key)
        key = key[order]
        cuts = _starts(key)
        many = np.flatnonzero(np.repeat(runs := np.diff(cuts, append=len(key)), runs) > 1)
        order[many] = order[many][np.lexsort((ws[order[many]], key[many]))]  # by weight too: sums don't depend on the order of arrival
        ws, key = np.add.reduceat(ws[order], cuts), key[cuts]
        ids, tos = (key >> 32).astype(np.int32), key.astype(np.int32)
        nodes, at = np.unique(ids, return_inverse=True)
        own = ids == tos
        loops = np.bincount(at[own], ws[own], len(nodes))
        at, tos, ws = at[~own], tos[~own], ws[~own]
        cells = [nodes, np.bincount(at, minlength=len(nodes)).astype(np.int32), np.bincount(at, ws, len(nodes)), loops.astype(np.float64), tos, ws]
        return pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], names=[x.split()[0] for x in PACKED.split(", ")])

    tile, rows = None, []
    for b in batches:
        for i in range(b.num_rows):
            if (t := b.column(0)[i].as_py()) != tile:
                if rows:
                    yield packed(tile, rows)
                tile, rows = t, []
            rows.append((_ints(b.column(1)[i]), _ints(b.column(2)[i]), _doubles(b.column(3)[i])))
    if rows:
        yield packed(tile, rows)


def _arrays(b: pa.RecordBatch, i: int) -> tuple:
    nodes, counts, loops, tos, ws = (b.column(j)[i] for j in range(5))
    return _ints(nodes), _ints(counts), _doubles(loops), _ints(tos), _doubles(ws)


class Tiled:
    """A graph of n nodes in tiles; ends has, for each node, the weight of its edges to others, loops that to itself."""

    def __init__(self, loose: DataFrame, n: int, places: Places) -> None:
        self.n, self.n_tiles, self.spark, self.here, self.kinds = n, places.tiles, loose.sparkSession, None, places.kinds is not None
        together = F.col("tile") - F.col("tile") % F.lit(places.each) % F.lit(8)  # up to eight tiles of a kind
        packed = loose.repartition(max(1, places.tiles // 8), together).sortWithinPartitions("tile").mapInArrow(_pack, PACKED)
        self.tiles = settled(packed.withColumn("kind", F.floor(F.col("tile") / F.lit(places.each)).cast("int")), "kind") if self.kinds else settled(packed)
        self.ends, self.loops, self.present = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        for b in self.tiles.select("nodes", "sums", "loops").toArrow().to_batches():
            for i in range(b.num_rows):
                at = _ints(b.column(0)[i])
                self.ends[at], self.loops[at], self.present[at] = _doubles(b.column(1)[i]), _doubles(b.column(2)[i]), True

    def rows(self, turn: int = 0, waits: bool | None = None) -> DataFrame:
        """The tiles; with waits, those that have nodes whose turn of that number is so."""
        spark, tiles = self.spark, self.tiles
        if self.kinds and waits is not None:
            tiles = tiles.where(F.shiftright("kind", turn).bitwiseAND(F.lit(1)) == int(waits))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return tiles.select("nodes", "counts", "loops", "tos", "ws").coalesce(TASKS * spark.sparkContext.defaultParallelism)

    def asked(self, f: Callable, state: tuple, ready: Callable = lambda x: x, *turn) -> tuple[np.ndarray, np.ndarray]:
        """The two columns of numbers that f makes of each tile (nodes, counts, loops, tos, ws) and of what ready, once a
        task, makes of state; a graph of one tile is asked in the driver."""
        if self.n_tiles == 1:
            self.here, state = self.here or self.rows().toArrow().to_batches(), ready(state)
            got = pa.Table.from_batches([f(_arrays(b, i), state) for b in self.here for i in range(b.num_rows)], pa.schema([("a", pa.int32()), ("b", pa.int32())]))
            return got.column(0).to_numpy(), got.column(1).to_numpy()
        shared = self.spark.sparkContext.broadcast(state)

        def run(batches):
            given = None
            for b in batches:
                given = given or ready(shared.value)
                for i in range(b.num_rows):
                    yield f(_arrays(b, i), given)

        got = self.rows(*turn).mapInArrow(run, "a int, b int").toArrow()
        shared.destroy()
        return got.column(0).to_numpy(), got.column(1).to_numpy()

    def contracted(self, labels: np.ndarray, n: int, turns: list[np.ndarray] = ()) -> Tiled:
        """The graph whose n nodes are the labels of this one's; turns: of those."""
        places = Places(max(1, min(n * n // TILE_EDGES, self.n_tiles)), turns)
        shared = self.spark.sparkContext.broadcast((labels, places))

        def run(batches):
            held, size = [], 0
            for b in batches:
                for i in range(b.num_rows):
                    held.append(_relabelled(_arrays(b, i), shared.value[0]))
                    size += len(held[-1][0])
                    if size >= CONTRACT_EDGES:
                        yield _contract(held, shared.value[1])
                        held, size = [], 0
            if held:
                yield _contract(held, shared.value[1])

        out = Tiled(self.rows().mapInArrow(run, LOOSE), n, places)
        shared.destroy()
        return out

    def components(self) -> np.ndarray:
        """Of each node the smallest node of its component: roots hook to their smallest neighbour, then names are followed to the end."""
        names = np.arange(self.n, dtype=np.int32)
        while True:
            root, low = self.asked(_hooks, (names,))
            if not len(root):
                return names
            np.minimum.at(names, root, low)
            while (names != (further := names[names])).any():
                names = further


def tiled(pairs: DataFrame, names: Names, n_pairs: int, turns: list[np.ndarray] = ()) -> Tiled:
    """Of undirected pairs (a, b, weight), of which there are about n_pairs; pairs without an id are left out."""
    places, shared = Places(max(1, 2 * n_pairs // TILE_EDGES), turns), names.shared
    given = pairs.sparkSession.sparkContext.broadcast(places)

    def deal(batches):
        for b in _gathered(batches, DEAL_PAIRS):
            a, z = (pc.index_in(b.column(i), value_set=shared.value) for i in range(2))
            ok = pc.and_(pc.is_valid(a), pc.is_valid(z)).to_numpy(zero_copy_only=False)
            a, z, w = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False)[ok] for x in (a, z, b.column(2)))
            back = a != z
            yield _dealt(np.concatenate([a, z[back]]), np.concatenate([z, a[back]]), np.concatenate([w, w[back]]), given.value)

    return Tiled(pairs.select("a", "b", F.col("weight").cast("double")).mapInArrow(deal, LOOSE), names.n, places)


def _relabelled(tile: tuple, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges between the labels of a tile's: a key of both ends, and the weight."""
    nodes, counts, loops, tos, ws = tile
    own = labels[nodes].astype(np.int64)
    a, b = np.repeat(own, counts), labels[tos]
    key = np.concatenate([a << 32 | b, own << 32 | own])
    return key, np.concatenate([np.where(a == b, ws / 2, ws), loops])  # an edge inside is here in both directions


def _contract(held: list[tuple[np.ndarray, np.ndarray]], places: Places) -> pa.RecordBatch:
    key, w = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key)
    key = key[order]
    cuts = _starts(key)
    key = key[cuts]
    return _dealt(key >> 32, key & LOW, np.add.reduceat(w[order], cuts), places)


def _hooks(tile: tuple, state: tuple) -> pa.RecordBatch:
    (nodes, counts, _, tos, _), (names,) = tile, state
    nodes, counts = nodes[counts > 0], counts[counts > 0]
    low = np.minimum.reduceat(names[tos], np.cumsum(counts) - counts) if len(nodes) else nodes
    less = low < names[nodes]
    return pa.RecordBatch.from_arrays([pa.array(names[nodes[less]]), pa.array(low[less])], names=["a", "b"])


def _best(tile: tuple, state: tuple) -> pa.RecordBatch:
    """(node, community) of the nodes in turn that gain by a move, to the best community that a neighbour is in."""
    (nodes, counts, _, tos, ws), (community, total, ends, ours, m2, resolution) = tile, state
    ours = ours[nodes]
    kept = np.repeat(ours, counts)
    nodes, counts = nodes[ours], counts[ours]
    own, k = community[nodes], ends[nodes]
    at = np.arange(len(nodes), dtype=np.int64) << 32
    key = np.concatenate([np.repeat(at, counts) | community[tos[kept]], at | own])
    order = np.argsort(key)
    key, w = key[order], np.concatenate([ws[kept], np.zeros(len(nodes))])[order]
    cuts = _starts(key)
    key, w = key[cuts], np.add.reduceat(w, cuts) if len(cuts) else w
    at, c = key >> 32, key & LOW
    stay, ours = c == own[at], k[at]
    gain = np.round(w - resolution * ours * (total[c] - np.where(stay, ours, 0.0)) / m2, 12)
    first = _starts(at)
    if len(first):
        top = np.maximum.reduceat(gain, first)[at]
        c = np.maximum.reduceat(np.where(gain == top, c | stay.astype(np.int64) << 32, -1), first) & LOW
    less = c != own
    return pa.RecordBatch.from_arrays([pa.array(nodes[less]), pa.array(c[less].astype(np.int32))], names=["a", "b"])


def local_moves(graph: Tiled, turns: list[np.ndarray], resolution: float, rounds: int) -> np.ndarray:
    """Of each node its community, by rounds as clustering's _local_moves has them; turns: of each two rounds, who waits for the second."""
    ends = graph.ends + 2 * graph.loops
    community, m2 = np.arange(graph.n, dtype=np.int32), float(ends.sum())
    if not m2:
        return community
    fixed = graph.spark.sparkContext.broadcast((ends, turns, m2, resolution))  # a round sends communities alone

    def ready(state: tuple) -> tuple:
        (community, r), (ends, turns, m2, resolution) = state, fixed.value
        return community, np.bincount(community, ends, len(community)), ends, turns[r // 2] == bool(r % 2), m2, resolution

    for r in range(rounds):
        nodes, to = graph.asked(_best, (community, r), ready, r // 2, bool(r % 2))
        community[nodes] = to
        if not len(nodes) and r % 2:
            break
    fixed.destroy()
    return community


def louvain(graph: Tiled, turns: list[np.ndarray], resolution: float, rounds: int, levels: int) -> np.ndarray:
    """Of each node the node that names its community; components' smallest nodes if those are better communities."""
    m = graph.ends.sum() / 2 + graph.loops.sum()
    spread = lambda g: resolution * float(((g.ends + 2 * g.loops) ** 2).sum()) / (4 * m * m)
    at, base, labels, best = np.arange(graph.n), np.arange(graph.n), None, None  # of each first node its node in the present graph, and the reverse
    for _ in range(levels):
        step = local_moves(graph, turns, resolution, rounds)
        kept, step = np.unique(step, return_inverse=True)
        new, at = base[kept][step[at]], step[at]
        base, turns = base[kept], [t[kept] for t in turns]
        graph = graph.contracted(step.astype(np.int32), len(kept), turns)
        q = graph.loops.sum() / m - spread(graph) if m else 0.0
        if best is not None and q <= best + 1e-9:
            break
        labels, best = new, q
    parts = graph.components()
    inside = np.bincount(parts, graph.ends + 2 * graph.loops, graph.n)
    plain = 1 - resolution * float((inside**2).sum()) / (4 * m * m) if m else 0.0
    if best is not None and plain <= best:
        return labels
    low = np.full(graph.n, len(at), np.int64)
    np.minimum.at(low, parts[at], np.arange(len(at)))
    return low[parts[at]]
