"""Embedding near-duplicates by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated random
hashes and compares every vector with a bounded window of its followers.  The
hashes are of unit vectors less the mean of their label's, so that planes part
vectors that share a direction, too.  Pairs that pass the exact cosine are
united across passes.  How many passes it takes is measured: a sample of
vectors is compared with all of their label, and while too few of their links
lie inside the components found, as many passes again follow; a label's vectors
are all compared in blocks only if that does not end it.  Inside each component
all pairs are then compared, block by block, so links are counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelink.llm.common import components, drop, prepare, table
from placelink.llm.vectors import hashed, matrix, runs, sorted_passes, stretches, usable

PASSES, WINDOW = 12, 96
#: Vectors by which recall is measured (fewer where they are longer than 2,048 components), the share of their links that
#: must be found, and the passes after which all pairs are compared.
CHECKED, TARGET, MOST_PASSES = 512, 0.98, 384
#: Vectors of a block of a pass, and of a side of a block of a component.
BLOCK, CELL = 256, 512
#: Rows up to which a table of classes is broadcast: some 4 MB.
BROADCAST_ROWS = 100_000
#: Means of groups that are broadcast: some 2 MB of 64 components.
MEANS = 4_096


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(n: int, first: np.ndarray, second: np.ndarray) -> list[int]:
    """Positions of pairs that already connect what all pairs connect."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(first.tolist(), second.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            up[a] = b
            kept.append(k)
    return kept


def _band(x: np.ndarray, least: float, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of unit vectors whose cosine is at least ``least``, where ``apart`` allows it."""
    return np.nonzero((x @ x.T >= least) & apart)


def passes_for(count: int) -> int:
    """Passes to begin with: they grow with the logarithm of the number of windows."""
    return max(PASSES, 2 * (count // WINDOW).bit_length())


def centred(rows: DataFrame) -> DataFrame:
    """``(grp, id, v, x)`` of ``rows(grp, id, v)``: ``x`` as it came, ``v`` its unit vector less the mean of its group and dimension.

    Groups that a window holds whole stay as they are; their order is of no account.
    """
    kind = dict(rows.dtypes)["v"]

    def added(batches: Iterator[pa.RecordBatch], sums: bool) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def told() -> pa.RecordBatch:
            keys, values = list(held), list(held.values())
            columns = [[g for g, _ in keys], [d for _, d in keys], [n for n, _ in values], [x.tobytes() for _, x in values]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["grp", "dim", "n", "total"])

        for batch in batches:
            if sums:
                each = ((g, d, n, np.frombuffer(x, np.float64)) for g, d, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            else:
                grp, dim = batch.column(0).to_numpy(zero_copy_only=False), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                each = []
                for d in np.unique(dim).tolist():
                    at = np.flatnonzero(dim == d)
                    x = _unit(matrix(batch.column(1).take(pa.array(at))))
                    for g in dict.fromkeys(grp[at].tolist()):
                        own = grp[at] == g
                        each.append((g, d, int(own.sum()), x[own].sum(axis=0)))
            for g, d, n, x in each:
                if (g, d) in held:
                    held[g, d][0] += n
                    held[g, d][1] += x
                else:
                    held[g, d] = [n, x.copy()]
            if len(held) > 4_096:  # a group's partial sums, or whole ones as its rows come together
                yield told()
                held.clear()
        if held:
            yield told()

    shape = "grp string, dim int, n long, total binary"
    partial = rows.select("grp", "v").mapInArrow(lambda batches: added(batches, False), shape)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 2):
            yield from added(iter(run.to_batches()), True)

    means = table(partial.repartition("grp", "dim").sortWithinPartitions("grp", "dim").mapInArrow(whole, shape).where(F.col("n") > WINDOW), "means")
    side = means.select("grp", "dim", "n", "total")
    side = F.broadcast(side) if means.count() <= MEANS else side
    both = rows.withColumn("dim", F.size("v")).join(side, ["grp", "dim"], "left").select("grp", "id", "v", "n", "total")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(dim).tolist():
                part = batch.take(pa.array(np.flatnonzero(dim == d)))
                x = _unit(matrix(part.column(2)))
                n, total = part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_pylist()
                for k, mean in enumerate(total):
                    if mean is not None:
                        x[k] -= np.frombuffer(mean, np.float64) / n[k]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d), pa.int32()), pa.array(x.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat, part.column(2)], ["grp", "id", "v", "x"])

    return both.mapInArrow(moved, f"grp string, id long, v array<float>, x {kind}")


_FOUND = "a long, b long, part int, row long, total long, turn int, grp string, dim int, id long, v "


def passes(rows: DataFrame, least: float, turns: int = PASSES, window: int = WINDOW, first: int = 0) -> DataFrame:
    """``(a, b)``: pairs of ``rows(grp, id, v)`` found by the sorted passes from number ``first`` on, enough to connect all found.

    One shuffle sorts all passes.  Each partition compares its rows as they
    come and hands on the ``window`` rows at both its ends, which are compared
    across partitions afterwards.
    """
    dealt = sorted_passes(centred(rows), turns, "x", first).withColumnRenamed("x", "v")
    kind = dict(rows.dtypes)["v"]

    def pairs(a: np.ndarray, b: np.ndarray) -> dict:
        return {"a": pa.array(a), "b": pa.array(b)}

    def filled(columns: dict, n: int, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = [f.split()[0] for f in _FOUND.split(", ")]
        kinds, seen, key, tail = None, 0, None, None
        head: list[pa.Table] = []  # the first rows of the partition, then its last
        last: pa.Table | None = None
        for own in stretches(batches, 3, BLOCK):
            if kinds is None:
                held = {f.name: f.type for f in own.schema}
                kinds = [held.get(c, {"part": pa.int32()}.get(c, pa.int64())) for c in names]
            at = tuple(own.column(c)[0].as_py() for c in ("turn", "grp", "dim"))
            if seen < window:
                head.append(own.slice(0, window - seen))
            last = own if last is None else pa.concat_tables([last, own])
            last = last.slice(max(0, last.num_rows - window))
            seen += own.num_rows
            both = own if key != at else pa.concat_tables([tail, own])
            key, tail = at, both.slice(max(0, both.num_rows - window))
            if both.num_rows < 2:
                continue
            n, old = both.num_rows, both.num_rows - own.num_rows
            ids, place = both.column("id").to_numpy(), np.arange(n)
            gap = place[None, :] - place[:, None]
            i, j = _band(_unit(matrix(both.column("v").combine_chunks())), least, (gap > 0) & (gap <= window) & (place[None, :] >= old))
            kept = _forest(n, i, j)
            if kept:
                yield filled(pairs(ids[i[kept]], ids[j[kept]]), len(kept), names, kinds)
        if seen:
            first = pa.concat_tables(head)
            edge = pa.concat_tables([first, last.slice(max(0, last.num_rows - (seen - first.num_rows)))]) if seen > first.num_rows else first
            n = edge.num_rows
            row = np.concatenate([np.arange(first.num_rows), np.arange(seen - (n - first.num_rows), seen)])
            columns = {c: edge.column(c).combine_chunks() for c in ("turn", "grp", "dim", "id", "v")}
            columns |= {"part": pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), "row": pa.array(row), "total": pa.array(np.full(n, seen))}
            yield filled(columns, n, names, kinds)

    found = table(dealt.mapInArrow(compare, _FOUND + kind), "passes")
    edges = found.where("part is not null")
    counts = edges.groupBy("part").agg(F.max("total").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))  # a row a partition
    placed = edges.join(F.broadcast(bases), "part").withColumn("place", F.col("base") + F.col("row"))
    block = F.floor(F.col("place") / BLOCK)
    halo = F.when((F.col("place") % BLOCK < window) & (F.col("place") >= BLOCK), F.array(block, block - 1)).otherwise(F.array(block))
    each = placed.select(F.explode(halo).alias("block"), "place", "part", "turn", "grp", "dim", "id", "v")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, 1):
            for same in runs(iter(own.drop_columns(["block"]).select(["turn", "grp", "dim", "place", "part", "id", "v"]).combine_chunks().to_batches()), 3):
                part, place, ids = (same.column(c).to_numpy() for c in ("part", "place", "id"))
                gap = place[None, :] - place[:, None]
                apart = (gap > 0) & (gap <= window) & (part[None, :] != part[:, None])
                if apart.any():
                    i, j = _band(_unit(matrix(same.column("v").combine_chunks())), least, apart)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    more = each.repartition("block").sortWithinPartitions("block", "place").mapInArrow(across, "a long, b long")
    return found.where("a is not null").select("a", "b").union(more).distinct()


def _cells(members: DataFrame, *keep: str) -> DataFrame:
    """``members(component, id, v)`` once for each pair of sides of about ``CELL`` ids of their component."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("sides"))
    rows = members.join(sizes, "component").withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    cells = rows.select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", *keep, "v")
    return cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")


def _near(own: pa.Table, least: float) -> np.ndarray:
    """Which vectors of a cell link, as far as the cell is to tell."""
    x = _unit(matrix(own.column("v").combine_chunks()))
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    if own.column("i")[0].as_py() != own.column("j")[0].as_py():
        side = own.column("side").to_numpy()
        near &= side[:, None] != side[None, :]
    return near


def counted(members: DataFrame, least: float) -> DataFrame:
    """``(id, links)``: for each of ``members(component, id, c, v)`` the vectors of its component it links with.

    ``c`` vectors stand behind each id.  A component is split into sides of
    about ``CELL`` ids; each pair of sides is a group of its own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, 3):
            yield pa.RecordBatch.from_arrays([own.column("id").combine_chunks(), pa.array(_near(own, least).astype(np.int64) @ own.column("c").to_numpy())], ["id", "links"])

    return _cells(members, "c").mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def all_pairs(rows: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: pairs of ``rows(grp, id, v)`` that connect what all pairs of a group and dimension connect, by blocks."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, 3):
            ids = own.column("id").to_numpy()
            i, j = np.nonzero(np.triu(_near(own, least)))
            kept = _forest(len(ids), i, j)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[kept]]), pa.array(ids[j[kept]])], ["a", "b"])

    groups = table(rows.select("grp", F.size("v").alias("dim")).distinct().withColumn("component", F.monotonically_increasing_id()), "groups")
    members = rows.withColumn("dim", F.size("v")).join(groups, ["grp", "dim"]).select("component", "id", "v")
    return _cells(members).mapInArrow(found, "a long, b long")


def recall(reps: DataFrame, merged: DataFrame, least: float, checked: int) -> tuple[int, int]:
    """Of the links of a sample of ``reps(grp, id, v)``, how many there are and how many lie inside components ``merged(id, component)``."""
    rows = reps.join(merged, "id", "left").select("grp", "id", "v", F.coalesce("component", "id").alias("component"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(checked).collect()
    sides: dict[tuple[str, int], list] = {}
    for r in sample:
        sides.setdefault((r["grp"], len(r["v"])), []).append(r)
    held = {k: (_unit(np.array([r["v"] for r in own], np.float64)), np.array([r["id"] for r in own]), np.array([r["component"] for r in own])) for k, own in sides.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = inside = 0
        for batch in batches:
            grp, dim = batch.column(0).to_numpy(zero_copy_only=False), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for (g, d), (y, ids, component) in held.items():
                at = np.flatnonzero((grp == g) & (dim == d))
                if len(at):
                    own = batch.take(pa.array(at))
                    near = (_unit(matrix(own.column(2))) @ y.T >= least) & (own.column(1).to_numpy()[:, None] != ids)
                    links += int(near.sum())
                    inside += int((near & (own.column(3).to_numpy()[:, None] == component)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([inside])], ["links", "inside"])

    told = rows.mapInArrow(scan, "links long, inside long").agg(F.sum("links"), F.sum("inside")).first()
    return told[0] or 0, told[1] or 0


def linked(reps: DataFrame, least: float, more: DataFrame | None = None, turns: int | None = None, window: int = WINDOW, target: float = TARGET) -> DataFrame:
    """``(id, component)`` of ``reps(grp, id, v)`` that link, and of the pairs ``more(a, b)``, with passes until a sample finds its links."""
    count, dim = reps.agg(F.count("*"), F.max(F.size("v"))).first()
    checked = max(1, min(CHECKED, CHECKED * 2_048 // max(1, dim or 1)))
    step, done = turns or passes_for(count), 0
    edges = more
    while True:
        found = passes(reps, least, step, window, done) if done < MOST_PASSES else all_pairs(reps, least)
        last, edges = edges, table(found if edges is None else edges.union(found), "found")
        merged = table(components(edges), "merged")
        if last is not None and last is not more:
            drop(last)
        links, inside = recall(reps, merged, least, checked)
        if done >= MOST_PASSES or inside >= target * links:
            return merged
        done += step
        step = done
        drop(merged)


def near_duplicates(df: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", turns: int | None = None, window: int = WINDOW) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector.

    Vectors are compared only when their labels are equal and not null and
    their dimensions agree.  Null and zero vectors and those with null or
    non-finite components link with nothing, and so do rows with a null id
    (their component is null and they are not kept).  Equal vectors of a label
    are compared once, for all of them; rows that share an id are counted each,
    and their components merge.  An empty table gives none; other columns are
    ignored.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("grp"), F.col(vector_col).alias("v"))
    able = rows.where(usable(F.col("v")) & F.col("grp").isNotNull() & F.col("id").isNotNull())
    h1, h2 = hashed(F.col("v"))
    able = table(able.select("id", "grp", "v", h1.alias("h1"), h2.alias("h2")), "vectors")
    same = ["grp", "h1", "h2"]
    classes = able.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.first("v").alias("v"))
    classes = table(classes, "classes")
    reps = classes.select("grp", F.col("rep").alias("id"), "c", "v")
    classes = classes.drop("v")
    several = table(classes.where("c > 1").select(*same, "rep"), "several")
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    tied = able.select("id", *same).join(several, same).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    shared = tied.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).where("x <> y")
    more = shared.select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = linked(reps.select("grp", "id", "v"), least, more, turns, window)
    inside = reps.join(merged, "id").select("component", "id", "c", "v")
    links = table(counted(inside, least), "links")
    place = classes.join(merged, classes.rep == merged.id, "left").drop("id").join(links, classes.rep == links.id, "left")
    place = place.select(*same, (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    told = able.select("id", *same).join(place, same).select("id", "n_links", "component")
    rest = rows.where(~(usable(F.col("v")) & F.col("grp").isNotNull() & F.col("id").isNotNull()))
    told = told.union(rest.select("id", F.lit(0).cast("long"), F.col("id")))
    return told.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
