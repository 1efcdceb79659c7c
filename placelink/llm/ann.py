"""Nearest neighbours by inner product: an NN-descent graph and greedy search.

The graph joins each vector to those of largest inner product with it, the
measure of the search itself, so that vectors of unequal length need no other
space.  It starts from blocks of random hash orders and is improved by joins of
neighbours of neighbours: around each node its neighbours and the nodes that
have it as a neighbour are compared with each other, unless both were there the
round before, and whoever finds a nearer neighbour takes it.  A query walks the
graph: it scores the neighbours of the best nodes it has seen until its best
nodes are all expanded.  How many best nodes that are is measured: for a few
queries all vectors are compared, and their walks go on with twice as many until
they find what they should; all queries walk with as many then, and are measured
again.  Where that would take as many as there are vectors, all queries are
compared with all vectors, by blocks.

Nodes are numbered in a hash order, so near nodes have near numbers.  Descent
and walk work cell by cell of these numbers: a cell gets each vector that it
needs once, however many of its nodes need it, as one byte a component beside
its length.  A node ranks others by their length and direction alone, so very
long vectors do not blot out what is between the others.  The best nodes of a
walk are scored again exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelink.llm.common import drop, prepare, table
from placelink.llm.vectors import hashed, matrix, pieces, runs, sorted_passes, usable

#: Neighbours of a node, least orders, block size and neighbours taken of each order.
DEGREE, ORDERS, BLOCK, FIRST = 64, 12, 256, 16
#: Descent ends when a round replaces a smaller share of all neighbours; the rounds only bound it for safety.
DELTA, ROUNDS = 0.01, 30
#: Reverse neighbours that are compared together (a node with more has several such groups a
#: round), and the nearest of a group that a node may take a round.
GROUP, TAKEN = 128, 16
#: Least number of cells, most nodes of a cell of descent and of one where found edges are merged, queries of a cell of the walk.
CELLS, CELL, MERGED, ASKED = 8, 1 << 12, 1 << 10, 256
#: Edges that a cell of descent holds before it hands them on.
EDGES = 500_000
#: Best nodes that a query expands at first, best nodes scored exactly for each answer.  Walks end when
#: nothing is left to expand; the steps only bound them for safety.
BEAM, RESCORED, STEPS = 32, 2, 1_000
#: Best nodes that a walk keeps for each of its beam: a beam twice as wide has no other ones.
KEPT = 2
#: Queries by which the beam is measured, the share of their answers that must be found, and bytes of queries that are
#: compared with all vectors at a time where no beam finds it.
CHECKED, TARGET, SCANNED = 64, 0.95, 8 << 20
#: Vectors of a rarer dimension up to which all pairs are compared instead of a graph: what is one block of a graph.
FEW = 256
#: Longest vectors, from which every query starts besides its own place.
ENTRIES = 16
#: Rows up to which a table of ids is broadcast: some 2 MB.
BROADCAST_ROWS = 100_000

_NEAR = "a long, ids array<long>, s array<double>, new array<boolean>"


def _codes(x: np.ndarray, largest: float = 1.0) -> list[bytes]:
    """Each row as a double, its scale as a share of ``largest``, and one byte a component."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    code = np.rint(x / scale * 127).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip((scale / largest).astype("<f8"), code, strict=True)]


def _decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components as single floats, and the scales that they lack."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(rows[:, 8:]).view(np.int8).astype(np.float32), np.ascontiguousarray(rows[:, :8]).view("<f8")[:, 0]


def _ranked(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scores by which each row of ``x`` ranks the others: inner products, but for a factor of its own."""
    s = (x @ x.T) * scale[None, :]
    np.fill_diagonal(s, -np.inf)
    return s


def _lists(a: np.ndarray, n: np.ndarray, *flat: np.ndarray) -> pa.RecordBatch:
    """A batch of ``a`` and, for each, its ``n`` next entries of the flat columns: ids, scores and whether they are new."""
    ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    kinds = (pa.int64(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(c, k)) for c, k in zip(flat, kinds, strict=True))], ["a", "ids", "s", "new"])


def _top(s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``most`` largest of each row, and what is there."""
    k = min(most, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return top, np.take_along_axis(s, top, axis=1)


def orders_for(count: int) -> int:
    """Hash orders of the first graph: they grow with the logarithm of the number of blocks."""
    return max(ORDERS, (max(count - 1, 0) // BLOCK).bit_length())


def cell_size(count: int, asked: int, most: int) -> int:
    """Nodes of a cell: there are ``CELLS`` cells, or as many as leave at most ``most`` of ``asked`` nodes to each."""
    return max(1, -(-count // max(CELLS, -(-asked // most))))


def coded(points: DataFrame, largest: float) -> DataFrame:
    """``(id, rep, v, code)`` of ``points(id, v)``: nodes numbered in a hash order, with vectors in bytes.

    ``largest`` is the largest component of all vectors; scales are divided by it.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_codes(matrix(batch.column(1)), largest), pa.binary())], ["rep", "v", "code"])

    kind = dict(points.dtypes)["v"]
    placed = sorted_passes(points.select(F.lit("").alias("grp"), "id", "v"), 1).select("id", "v")
    placed = table(placed.mapInArrow(code, f"rep long, v {kind}, code binary").withColumn("spot", F.monotonically_increasing_id()), "coded")
    # the upper bits of a spot are the partition, the lower ones the row there
    part = F.shiftright("spot", 33)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    bases = counts.select("part", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("base"))  # a row a partition
    ident = F.col("base") + F.col("spot") - F.shiftleft("part", 33)
    return table(placed.withColumn("part", part).join(F.broadcast(bases), "part").select(ident.alias("id"), "rep", "v", "code"), "nodes")


_PACKED = "cell long, a binary, b binary, s binary"


def _packed(a: np.ndarray, b: np.ndarray, s: np.ndarray, size: int) -> pa.RecordBatch:
    """Found edges, a row for each cell of ``size`` nodes that ``a`` is in."""
    cell = a // size
    order = np.argsort(cell, kind="stable")
    a, b, s, cell = a[order], b[order], s[order], cell[order]
    cells, starts = np.unique(cell, return_index=True)
    cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True))
    columns = [pa.array([c[i:j].astype(k).tobytes() for i, j in cuts], pa.binary()) for c, k in ((a, "<i8"), (b, "<i8"), (s, "<f8"))]
    return pa.RecordBatch.from_arrays([pa.array(cells), *columns], ["cell", "a", "b", "s"])


def _merged(found: DataFrame, near: DataFrame | None, degree: int, size: int) -> DataFrame:
    """The ``degree`` nearest of each node, in order, of its list in ``near`` and of packed ``found`` edges; those not in ``near`` are new."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = found.select("cell", "a", "b", "s", none("long").alias("node"), none("array<long>").alias("ids"), none("array<double>").alias("held"))
    if near is not None:
        rows = rows.union(near.select(F.floor(F.col("a") / size), none("binary"), none("binary"), none("binary"), "a", "ids", "s"))

    def unpacked(own: pa.Table, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(own.column(name).drop_null().to_pylist()), kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, 1):
            a, b, s = unpacked(own, "a", "<i8"), unpacked(own, "b", "<i8"), unpacked(own, "s", "<f8")
            old = own.filter(own.column("node").is_valid())
            if old.num_rows:
                ids, held = old.column("ids").combine_chunks(), old.column("held").combine_chunks()
                n = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
                a, b, s = np.concatenate([np.repeat(old.column("node").to_numpy(), n), a]), np.concatenate([ids.flatten().to_numpy(), b]), np.concatenate([held.flatten().to_numpy(), s])
                new = np.arange(len(a)) >= n.sum()
            else:
                new = np.ones(len(a), bool)
            if not len(a):
                continue
            order = np.lexsort((new, b, a))
            a, b, s, new = a[order], b[order], s[order], new[order]
            one = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])  # an old entry before its like
            a, b, s, new = a[one], b[one], s[one], new[one]
            order = np.lexsort((b, -s, a))
            a, b, s, new = a[order], b[order], s[order], new[order]
            nodes, start, count = np.unique(a, return_index=True, return_counts=True)
            kept = np.arange(len(a)) - np.repeat(start, count) < degree
            yield _lists(nodes, np.minimum(count, degree), b[kept], s[kept], new[kept])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(merge, _NEAR)


def _joined(members: pa.Table, codes: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
    """What the groups of a cell's hubs find: ``members(hub, id, new)``, ``codes(id, code, floor)``."""
    known = codes.column("id").to_numpy()
    order = np.argsort(known)
    x, scale = _decoded(codes.column("code").combine_chunks())
    known, x, scale = known[order], x[order], scale[order]
    floor = codes.column("floor").to_numpy()[order]
    hub, ids, new = (members.column(c).to_numpy() for c in ("hub", "id", "new"))
    order = np.lexsort((~new, ids, hub))
    hub, ids, new = hub[order], ids[order], new[order]
    first = np.ones(len(hub), bool)
    first[1:] = (hub[1:] != hub[:-1]) | (ids[1:] != ids[:-1])
    hub, at, new = hub[first], np.searchsorted(known, ids[first]), new[first]
    starts = np.flatnonzero(np.concatenate([[True], hub[1:] != hub[:-1]]))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def told() -> pa.RecordBatch:
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
        _, one = np.unique(a * len(known) + b, return_index=True)  # sorted by a, then b
        a, b, s = a[one], b[one], s[one]
        return _packed(known[a], known[b], s, size)

    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(hub)], strict=True):
        own, fresh = at[i:j], new[i:j]
        if len(own) < 2 or not fresh.any():
            continue
        s = _ranked(x[own], scale[own])
        if not fresh.all():
            old = np.flatnonzero(~fresh)
            s[np.ix_(old, old)] = -np.inf
        top, s = _top(s, min(TAKEN, len(own) - 1))
        better = s > floor[own][:, None]
        if better.any():
            row, col = np.nonzero(better)
            found.append((own[row], own[top[row, col]], s[row, col]))
            held += len(row)
            if held >= EDGES:
                yield told()
                found.clear()
                held = 0
    if found:
        yield told()


def graph(codes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, orders: int | None = None, delta: float = DELTA) -> DataFrame:
    """``(a, ids, s, new)``: near neighbours of ``codes(id, v, code)``, of one dimension, by NN-descent.

    Rounds follow each other until one replaces less than ``delta`` of all
    neighbours.  A lone node has an empty list or none.
    """
    count = codes.count()
    orders = orders_for(count) if orders is None else orders
    if count <= BLOCK:  # one block holds all
        placed = codes.select(F.lit(0).alias("turn"), "id", "code").repartition(1)
    else:
        placed = sorted_passes(codes.select(F.lit("").alias("grp"), "id", "v", "code"), orders, "code").select("turn", "id", "code")
    most = degree if count <= BLOCK else FIRST
    size, merged = cell_size(count, count, CELL), cell_size(count, count, MERGED)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in pieces(batches, 1, BLOCK):
            if own.num_rows > 1:
                ids = own.column("id").to_numpy()
                top, s = _top(_ranked(*_decoded(own.column("code").combine_chunks())), min(most, len(ids) - 1))
                yield _packed(np.repeat(ids, top.shape[1]), ids[top].ravel(), s.ravel(), merged)

    near = table(_merged(placed.mapInArrow(blocks, _PACKED), None, degree, merged), "near")
    if count <= BLOCK:
        return near

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, 2):
            coded_rows = own.column("code").is_valid()
            members = own.filter(pc.invert(coded_rows))
            if members.num_rows:
                yield from _joined(members, own.filter(coded_rows), merged)

    for turn in range(rounds):
        edges = near.select("a", F.explode(F.arrays_zip("ids", "new")).alias("e")).select("a", F.col("e.ids").alias("b"), F.col("e.new").alias("new"))
        busy = table(edges.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")).where("groups > 1"), "busy")
        busy_ = F.broadcast(busy) if busy.count() <= BROADCAST_ROWS else busy
        back = edges.select(F.col("b").alias("hub"), F.col("a").alias("id"), "new").join(busy_, "hub", "left")
        back = back.select("hub", F.pmod(F.xxhash64(F.lit(turn), "id"), F.coalesce("groups", F.lit(1))).cast("int").alias("part"), "id", "new")
        forth = edges.select(F.col("a").alias("hub"), F.col("b").alias("id"), "new").join(busy_, "hub", "left")
        forth = forth.select("hub", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)).alias("part"), "id", "new")
        members = back.union(forth).withColumn("cell", F.floor(F.col("hub") / size))
        full = near.select(F.col("a").alias("id"), F.when(F.size("ids") >= degree, F.element_at("s", -1)).alias("floor"))
        held = codes.select("id", "code").join(full, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        wanted = members.select("cell", "part", "id").distinct().join(held, "id")
        none = lambda kind: F.lit(None).cast(kind)
        rows = members.select("cell", "part", "hub", "id", "new", none("binary").alias("code"), none("double").alias("floor"))
        rows = rows.union(wanted.select("cell", "part", none("long"), "id", none("boolean"), "code", "floor"))
        found = rows.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(local, _PACKED)
        last, near = near, table(_merged(found, near, degree, merged), "near")
        drop(last)
        drop(busy)
        share = near.agg(F.sum(F.size(F.filter("new", lambda x: x))) / F.sum(F.size("ids"))).first()[0]
        if share is None or share < delta:
            break
    return near


_STATE = "cell long, q long, v binary, front array<long>, fresh array<long>, ids binary, s binary, done binary"


def _ids(column: np.ndarray | bytes) -> np.ndarray:
    return np.frombuffer(column, "<i8")


def _front(s: np.ndarray, ids: np.ndarray, done: np.ndarray, beam: int) -> np.ndarray:
    """Which of the ``beam`` best nodes are not expanded yet."""
    best = np.lexsort((ids, -s))[:beam]
    return best[done[best] == 0]


def walk_step(rows: pa.Table, beam: int, keep: int | None) -> Iterator[pa.RecordBatch]:
    """One step of the walks of a cell: its states, the lists of the nodes they expand and the vectors of those.

    A walk keeps its ``keep`` best nodes; one that falls behind those is not expanded any more, whether it is met again or not.
    """
    code = rows.filter(rows.column("code").is_valid())
    known = code.column("id").to_numpy()
    order = np.argsort(known)
    x, scale = _decoded(code.column("code").combine_chunks()) if len(known) else (None, None)
    known, x, scale = known[order], x[order] if len(known) else x, scale[order] if len(known) else scale
    hops = rows.filter(rows.column("near").is_valid())
    lists = hops.column("near").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    near = {a: flat[i:j] for a, i, j in zip(hops.column("id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
    empty = np.zeros(0, np.int64)
    out = []
    for state in rows.filter(rows.column("q").is_valid()).select([n for n in rows.column_names if n not in ("id", "code", "near")]).to_pylist():
        ids, s, done = _ids(state["ids"]), np.frombuffer(state["s"], "<f8"), np.frombuffer(state["done"], np.uint8)
        done = np.where(np.isin(ids, state["front"]), 1, done).astype(np.uint8)
        reached = np.unique(np.concatenate([np.array(state["fresh"], np.int64), *(near.get(a, empty) for a in state["front"])]))
        reached = np.setdiff1d(reached, ids, assume_unique=True)
        if len(reached):
            own = np.frombuffer(state["v"], "<f4")
            at = np.searchsorted(known, reached)
            ids, s = np.concatenate([ids, reached]), np.concatenate([s, (x[at] @ own) * scale[at]])
            # a node of the front that was scored only now has been expanded too
            done = np.concatenate([done, np.isin(reached, state["front"]).astype(np.uint8)])
        best = np.lexsort((ids, -s))[:keep]
        ids, s, done = ids[best], s[best], done[best]
        front = ids[:beam][done[:beam] == 0].tolist()
        out.append(state | {"front": front, "fresh": [], "ids": ids.astype("<i8").tobytes(), "s": s.astype("<f8").tobytes(), "done": done.tobytes()})
    for at in range(0, len(out), 64):
        yield pa.RecordBatch.from_pylist(out[at : at + 64], _STATE_SCHEMA)


_STATE_SCHEMA = pa.schema([("cell", pa.int64()), ("q", pa.int64()), ("v", pa.binary()), ("front", pa.list_(pa.int64())), ("fresh", pa.list_(pa.int64())), ("ids", pa.binary()), ("s", pa.binary()), ("done", pa.binary())])


def search(near: DataFrame, codes: DataFrame, state: DataFrame, beam: int, keep: int | None = None, steps: int = STEPS) -> DataFrame:
    """``state`` when no walk has a node left to expand among its ``beam`` best.

    ``near(a, ids)`` is the graph over ``codes(id, code)``.  ``state`` has a row
    a query: its cell, the vector divided by its largest component, nodes to
    expand and to score, and the ``keep`` best nodes it has scored (all without ``keep``), as packed arrays.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, 1):
            yield from walk_step(own, beam, keep)

    ended, live = None, state
    for _ in range(steps):
        some = F.size("front") + F.size("fresh") > 0
        rest = live.where(~some)
        ended = rest if ended is None else ended.union(rest)
        live = live.where(some)
        if live.isEmpty():
            break
        hops = live.select("cell", F.explode("front").alias("a")).distinct().join(near.select("a", "ids"), "a")
        wanted = hops.select("cell", F.explode("ids").alias("id")).union(live.select("cell", F.explode("fresh"))).distinct().join(codes.select("id", "code"), "id")
        none = lambda kind: F.lit(None).cast(kind)
        blank = [none(f.split()[1]).alias(f.split()[0]) for f in _STATE.split(", ")[1:]]
        rows = live.select("*", none("long").alias("id"), none("binary").alias("code"), none("array<long>").alias("near"))
        rows = rows.union(hops.select("cell", *blank, F.col("a"), none("binary"), "ids")).union(wanted.select("cell", *blank, "id", "code", none("array<long>")))
        live = table(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(step, _STATE), "walk")
    return ended


def widened(state: DataFrame, beam: int) -> DataFrame:
    """``state`` with the front that a wider beam has."""

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                ids, s, done = _ids(row["ids"]), np.frombuffer(row["s"], "<f8"), np.frombuffer(row["done"], np.uint8)
                row["front"] = ids[_front(s, ids, done, beam)].tolist()
            yield pa.RecordBatch.from_pylist(rows, _STATE_SCHEMA)

    return state.mapInArrow(widen, _STATE)


def best_seen(state: DataFrame, most: int) -> DataFrame:
    """``(q, id)``: the ``most`` best nodes that each query has scored, about."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, found = [], []
            for ident, ids, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, s = _ids(ids), np.frombuffer(s, "<f8")
                top = ids[np.lexsort((ids, -s))[:most]]
                q.append(np.full(len(top), ident))
                found.append(top)
            if q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), pa.array(np.concatenate(found))], ["q", "id"])

    return state.select("q", "ids", "s").mapInArrow(best, "q long, id long")


def exactly(pairs: DataFrame, points: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs(q, id)`` with their inner products in double precision."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = (matrix(batch.column(2)) * matrix(batch.column(3))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["q", "id", "score"])

    rows = pairs.join(points.select("id", F.col("v").alias("x")), "id").join(queries.select("q", "v"), "q")
    return rows.select("q", "id", "x", "v").mapInArrow(score, "q long, id long, score double")


def scanned(points: DataFrame, asked: list, k: int) -> DataFrame:
    """``(q, id, score)``: for each of a few queries ``(q, v)`` its ``k`` largest inner products with other ``points(id, v)``."""
    q, own = np.array([r["q"] for r in asked], np.int64), np.array([r["v"] for r in asked], np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            new = batch.column(0).to_numpy()
            s = own @ matrix(batch.column(1)).T
            s[q[:, None] == new] = -np.inf
            both = np.concatenate([ids, np.broadcast_to(new, s.shape)], axis=1)
            top, best = _top(np.concatenate([best, s], axis=1), k)
            ids = np.take_along_axis(both, top, axis=1)
        for at, row, s in zip(q, ids, best, strict=True):
            held = s > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.full(held.sum(), at)), pa.array(row[held]), pa.array(s[held])], ["q", "id", "score"])

    nearest_first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    found = points.select("id", "v").mapInArrow(scan, "q long, id long, score double")
    return found.withColumn("rank", nearest_first).where(F.col("rank") <= k).drop("rank")


def floors(points: DataFrame, asked: list, k: int) -> dict[int, tuple[float, int]]:
    """For each of a few queries ``(q, v)`` its ``k``-th largest inner product with other ``points(id, v)``, and how many there are up to ``k``."""
    return {r["q"]: (r["least"], r["n"]) for r in scanned(points, asked, k).groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).collect()}


def in_blocks(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(q, id)``: the ``k`` nearest other points of all queries ``asked(q, v)``, by blocks of ``SCANNED`` bytes of them."""
    size = max(1, SCANNED // (8 * len(asked.first()["v"])))
    out, block = None, []
    for row in asked.orderBy("q").toLocalIterator():
        block.append(row)
        if len(block) == size:
            found = table(scanned(points, block, k).select("q", "id"), "scanned")
            out, block = found if out is None else out.union(found), []
    if block:
        found = table(scanned(points, block, k).select("q", "id"), "scanned")
        out = found if out is None else out.union(found)
    return out


def walk(rows: DataFrame, largest: float, k: int, every: int) -> DataFrame:
    """``(q, id, score)``: the nearest of the queries in ``rows(id, v, h1, h2, norm)`` of one dimension, by the graph.

    Equal vectors are one node, and equal queries one walk.
    """
    order = Window.partitionBy("h1", "h2").orderBy("id")
    ids = rows.select("id", "h1", "h2").distinct()
    classes = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.max("norm").alias("norm"), F.max((F.col("id") % every == 0).cast("int")).alias("asks"))
    classes = table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    codes = coded(classes.select("id", "v"), largest)
    near = graph(codes)
    nodes = table(classes.select(F.col("id").alias("rep"), "h1", "h2", "asks", "norm").join(codes.select("id", "rep"), "rep").drop("rep"), "nodes")
    entries = [r["id"] for r in nodes.orderBy(F.desc("norm"), "id").limit(ENTRIES).collect()]
    asked = table(codes.select(F.col("id").alias("q"), "v").join(nodes.where("asks = 1").select(F.col("id").alias("q")), "q"), "queries")
    count = codes.count()
    size = cell_size(count, asked.count(), ASKED)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2))
            v = (v / np.abs(v).max(axis=1, keepdims=True)).astype("<f4")
            rows_ = [{"cell": c, "q": q, "v": x.tobytes(), "front": [q], "fresh": sorted({q, *entries}), "ids": b"", "s": b"", "done": b""} for c, q, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), v, strict=True)]
            yield pa.RecordBatch.from_pylist(rows_, _STATE_SCHEMA)

    def begun(queries: DataFrame) -> DataFrame:
        return table(queries.select(F.floor(F.col("q") / size).alias("cell"), "q", "v").mapInArrow(begin, _STATE), "walk")

    sample = asked.orderBy(F.xxhash64("q"), "q").limit(CHECKED).collect()
    least, beam, whole = floors(codes, sample, k) if sample else {}, BEAM, None
    state, all_walk = begun(asked.where(F.col("q").isin(list(least)))), False
    while True:
        most = RESCORED * (k + 1) * beam // BEAM
        state = table(search(near, codes, state, beam, max(KEPT * beam, 2 * most)), "walks")
        own = best_seen(state.where(F.col("q").isin(list(least))), most)
        hits: dict[int, int] = dict.fromkeys(least, 0)
        for r in exactly(own.where("q <> id"), codes, asked).collect():
            low, _ = least[r["q"]]
            hits[r["q"]] += r["score"] >= low - 1e-9 * abs(low)
        wanted = sum(c for _, c in least.values())
        if sum(min(hits[q], c) for q, (_, c) in least.items()) >= TARGET * wanted:
            if all_walk:
                break
            state, all_walk = begun(asked), True
            continue
        if 8 * beam >= count:  # a wider beam would see most of what there is
            whole = in_blocks(codes, asked, k + 1).union(asked.select("q", F.col("q").alias("id")))
            break
        beam *= 2
        state = widened(state, beam)
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    kept = exactly(best_seen(state, most) if whole is None else whole, codes, asked).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    few = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    few = few.join(nodes.select(F.col("id").alias("node"), "h1", "h2"), ["h1", "h2"]).select("node", "id")
    asks = ids.where(F.col("id") % every == 0).join(nodes.select(F.col("id").alias("at"), "h1", "h2"), ["h1", "h2"]).select("at", F.col("id").alias("asker"))
    found = kept.select(F.col("q").alias("at"), F.col("id").alias("node"), "score").join(few, "node").join(asks, "at")
    return found.where("id <> asker").select(F.col("asker").alias("q"), "id", "score")


def in_full(rows: DataFrame, k: int, every: int) -> DataFrame:
    """``(q, id, score)`` as :func:`walk` for ``rows(id, v, h1, h2, dim)`` of dimensions with few vectors, all pairs compared."""
    key = ["dim", "h1", "h2"]
    order = Window.partitionBy(*key).orderBy("id")
    ids = rows.select("id", *key).distinct()
    few = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select(*key, "id")
    points = rows.groupBy(*key).agg(F.min("id").alias("id"), F.first("v").alias("v"), F.max((F.col("id") % every == 0).cast("int")).alias("asks"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, 1):
            x = matrix(own.column("v").combine_chunks())
            id_, h1, h2 = (own.column(c).to_numpy() for c in ("id", "h1", "h2"))
            dim = own.column("dim")[0].as_py()
            for at in np.flatnonzero(own.column("asks").to_numpy()):
                s = (x * x[at]).sum(axis=1)
                top = np.lexsort((id_, -s))[: k + 1]
                one = np.ones(len(top), np.int64)
                cols = [pa.array(np.full(len(top), dim, np.int32)), pa.array(one * h1[at]), pa.array(one * h2[at]), pa.array(h1[top]), pa.array(h2[top]), pa.array(s[top])]
                yield pa.RecordBatch.from_arrays(cols, ["dim", "g1", "g2", "h1", "h2", "score"])

    dealt = points.select("dim", "id", "h1", "h2", "v", "asks").repartition("dim").sortWithinPartitions("dim")
    found = dealt.mapInArrow(compare, "dim int, g1 long, g2 long, h1 long, h2 long, score double")
    asked = ids.where(F.col("id") % every == 0).select("dim", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("id").alias("q"))
    return found.join(asked, ["dim", "g1", "g2"]).join(few, key).where("id <> q").select("q", "id", "score")


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest by inner product of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own, and all of them if there are fewer than ``k``.
    Null and zero vectors, those with null or non-finite components and rows
    with a null id take no part.  Equal vectors are one node of the graph with
    its smallest ids behind it.  Vectors are compared only with those of their
    dimension; the most frequent dimension and those of more than ``FEW``
    vectors have a graph each, all others are compared in full.  Rows that
    share an id are one candidate per distinct vector.  An empty table gives
    none.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    h1, h2 = hashed(F.col("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    rows = table(rows.where(usable(F.col("v")) & F.col("id").isNotNull()).select("id", "v", h1.alias("h1"), h2.alias("h2"), norm.alias("norm"), size.alias("size"), F.size("v").alias("dim")), "vectors")
    dims = rows.groupBy("dim").agg(F.count("*").alias("c"), F.max("size").alias("largest"))
    common = dims.orderBy(F.col("c").desc(), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    walked = [common, *dims.where((F.col("c") > FEW) & (F.col("dim") != common["dim"])).orderBy("dim").collect()]
    each = None
    for d in walked:
        found = walk(rows.where(F.col("dim") == d["dim"]), d["largest"], k, every)
        each = found if each is None else each.union(found)
    rest = rows.where(~F.col("dim").isin([d["dim"] for d in walked]))
    if not rest.isEmpty():
        each = each.union(in_full(rest, k, every))
    last = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
