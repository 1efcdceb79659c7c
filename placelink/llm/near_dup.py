"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles fall into size bands such that linked sets are in the
same band or in neighbours.  In a band a Jaccard bound is a Hamming bound k.
The feature domain is hashed into first-level partitions, each split again;
the signatures of a set are the contents of subsets of partitions, chosen so
that two sets that differ in at most k features share one:

* small bands: ceil((k+1)/2) partitions of 3 parts, signatures from every 2 of
  the 3.  Some partition holds at most one difference, so two parts agree.
* larger bands: single parts, of which a set emits its first k+1 that are not
  empty.  At most k of them differ, so one agrees, and the other set, for the
  same reason, emits it too.  A set with fewer such parts also emits the empty
  ones; a set it is linked with only through those has as few itself.

Sets that share a signature are compared in two rounds.  First all with a hub
of their group; the links found are merged into components.  Then only pairs of
different components, block by block, behind a parity sketch: the sketches of
two sets differ in at most as many bits as the sets in features, so a larger
difference excludes the pair for certain.  What is left is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelink.llm.common import components, drop, prepare, table

#: Largest Hamming bound of bands whose parts are enumerated two of three.
SMALL = 8
#: Parts for each part that a set must have.
SLACK = 1.2
#: Sets of a side of a block of comparisons.
CELL = 1_024
#: Pairs for which a hub's set is sent once; they are verified together.
SALT = 64
#: Ids up to which a table of ids is broadcast: some 2 MB.
BROADCAST_ROWS = 100_000
#: Words whose hashes a worker keeps while a task runs.
CACHE = 150_000

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found


_words = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of ``text``.

    Words are runs of what is no space or U+0009 to U+000D, A-Z lower-cased.
    Fewer than ``n`` words count as one shingle; no words give none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    wide = min(n, len(hashed))
    out = np.full(len(hashed) - wide + 1, np.uint64(wide))
    for k in range(wide):
        out = out * _P1 + hashed[k : len(hashed) - wide + 1 + k]
    return np.unique(_mix(out))


@lru_cache(maxsize=8)
def bands(percent: int, top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest sizes of the bands: the largest that the least can link with."""
    low, high, at = [], [], 1
    while at < top:
        low.append(at)
        high.append(at * 100 // percent)
        at = high[-1] + 1
    return np.array(low), np.array(high)


def signatures(found: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of a set of sorted hashes."""
    low, high = bands(percent)
    n = len(found)
    own = int(np.searchsorted(low, n, "right")) - 1
    out = []
    content = _mix(found ^ _P2)
    upper = found >> np.uint64(32)
    for band in (own, own + 1):
        reach = min(int(high[band]), n * 100 // percent)
        if reach < low[band]:
            continue
        k = (100 - percent) * (n + reach) // (100 + percent)
        if not k:
            continue  # only equal sets link
        bound = (100 - percent) * 2 * int(high[band]) // (100 + percent)
        salt = np.uint64(band * int(_P3) % 2**64)
        if bound <= SMALL:
            firsts = bound // 2 + 1
            part = (upper * np.uint64(firsts)) >> np.uint64(32)
            sub = ((found & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> np.uint64(32)
            sums = np.zeros(firsts * 3, np.uint64)
            np.add.at(sums, (part * np.uint64(3) + sub).astype(np.int64), content)
            sums = sums.reshape(firsts, 3)
            for left, (a, b) in enumerate(((1, 2), (0, 2), (0, 1))):
                place = np.arange(firsts, dtype=np.uint64) * np.uint64(3) + np.uint64(left)
                out.append(_mix(_mix(sums[:, a] * _P1 + sums[:, b] + place * _P2) + salt))
        else:
            parts = int((bound + 1) * SLACK) + 1
            part = (upper * np.uint64(parts)) >> np.uint64(32)
            starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            held, sums = part[starts][: k + 1], np.add.reduceat(content, starts)[: k + 1]
            out.append(_mix(_mix(sums * _P1 + held * _P2) + salt))
            if len(held) <= k:
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part)
                out.append(_mix(_mix(empty * _P2) + salt))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch(found: np.ndarray) -> bytes:
    """Parities of the features hashed to a power of two of bits, at least twice as many as features."""
    bits = 64
    while bits < 2 * len(found):
        bits *= 2
    at = (_mix(found ^ _P3) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(data: bytes, size: int) -> np.ndarray:
    """A sketch brought down to ``size`` bytes: its parts added without carry."""
    return np.bitwise_xor.reduce(np.frombuffer(data, np.uint8).reshape(-1, size), axis=0)


def may_link(n_a, n_b, apart, percent: int):
    """Whether sets of these sizes that differ in at least ``apart`` features can link."""
    return (apart * (100 + percent) <= (100 - percent) * (n_a + n_b)) & (np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


_MARKS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.binary()), ("sigs", pa.list_(pa.int64()))])


def marks(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``(id, n, h1, h2, sketch, sigs)`` of ``docs(id, text)``; no sketch and signatures without words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(text.as_py(), n)
                if not len(found):
                    rows.append({"id": ident, "n": 0})
                    continue
                both = xxhash.xxh3_128_digest(found.tobytes())
                h1, h2 = np.frombuffer(both, "<i8").tolist()
                rows.append({"id": ident, "n": len(found), "h1": h1, "h2": h2, "sketch": sketch(found), "sigs": signatures(found, percent).view(np.int64)})
            yield pa.RecordBatch.from_pylist(rows, _MARKS)
        _words.clear()

    return docs.mapInArrow(scan, "id long, n long, h1 long, h2 long, sketch binary, sigs array<long>")


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` of ids those whose sets link, from the whole texts of ``docs(id, text)``.

    Each pair brings one set to its hub ``a``, whose own set comes once per
    ``SALT`` pairs, so a hub with very many pairs is spread over tasks.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), n).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "held"])
        _words.clear()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for batch in batches:
            a, salt, b = (batch.column(c).to_pylist() for c in range(3))
            held = batch.column(3)
            kept = []
            for k in range(len(a)):
                values = held[k].values.to_numpy().view(np.uint64)
                if (a[k], salt[k]) != hub:
                    hub, own = (a[k], salt[k]), []
                if b[k] is None:
                    own.append(values)
                elif any(links(x, values, percent) for x in own):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in kept], pa.int64()), pa.array([b[k] for k in kept], pa.int64())], ["a", "b"])

    ids = table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    held = docs.join(_if_small(ids), "id", "left_semi").mapInArrow(sets, "id long, held array<long>")
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    salted = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    right = salted.join(held, salted.b == held.id).select("a", "salt", "b", "held")
    left = counts.join(held, counts.a == held.id).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "held")
    dealt = left.union(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return table(dealt.mapInArrow(compare, "a long, b long").distinct(), "links")


def _sketched(pairs: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b, na, nb, sa, sb)`` whose sketches do not exclude a link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            sa, sb = (batch.column(c).to_pylist() for c in (4, 5))
            for k in range(len(na)):
                size = min(len(sa[k]), len(sb[k]))
                apart = int(np.bitwise_count(_folded(sa[k], size) ^ _folded(sb[k], size)).sum())
                kept.append(bool(may_link(na[k], nb[k], apart, percent)))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return pairs.mapInArrow(scan, "a long, b long")


def _blocks(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that their sketches do not exclude, cell by cell.

    ``cells(sig, i, j, side, id, n, component, sketch)`` come sorted by cell; a
    cell compares its sides i and j, or the one side with itself.
    """

    def pairs_of(rows: list[tuple]) -> pa.RecordBatch:
        size = min(len(r[4]) for r in rows)
        ids, n, comp, side = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 0))
        data = np.stack([_folded(r[4], size) for r in rows])
        data = data.view(np.uint64) if size % 8 == 0 else data
        cross, first, second = len(set(side.tolist())) > 1, [], []
        for k in range(len(rows) - 1):
            rest = slice(k + 1, None)
            ok = comp[rest] != comp[k]
            if cross:
                ok &= side[rest] != side[k]
            at = np.flatnonzero(ok & may_link(n[rest], n[k], 0, percent)) + k + 1
            if len(at):
                apart = np.bitwise_count(data[at] ^ data[k]).sum(axis=1).astype(np.int64)
                at = at[may_link(n[at], n[k], apart, percent)]
                first.append(np.minimum(ids[at], ids[k]))
                second.append(np.maximum(ids[at], ids[k]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, seen = None, [], set()
        for batch in batches:
            for sig, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (sig, i, j) != at:
                    if len(rows) > 1:
                        out = pairs_of(rows)
                        new = [k for k, p in enumerate(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)) if p not in seen]
                        if new:
                            out = out.take(pa.array(new))
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.update(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
                            yield out
                    at, rows = (sig, i, j), []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield pairs_of(rows)

    return cells.mapInArrow(scan, "a long, b long")


def join(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component)`` of every document.

    Two documents link when the Jaccard similarity of their sets of ``n``-word
    shingles is at least ``percent`` hundredths; ``component`` is the smallest
    id reachable by links.  Null, empty and blank texts have no shingles and
    link with nothing.  A null id gives a null component and links nothing;
    rows that share an id count as one document, so their links add up.  An
    empty table gives none; other columns are ignored.
    """
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = table(marks(docs, n, percent), "marks")
    plain = found.where("n > 0 and id is not null")
    # an id with several sets is no node: each of its sets gets a node of its own
    several = plain.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y").select("id")
    several = table(several, "several")
    if not several.isEmpty():
        return _tied(docs, found, several, n, percent)
    # equal sets: one stands for all, the others follow it
    groups = table(plain.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1"), "groups")
    copies = plain.select("id", "h1", "h2").join(_if_small(groups), ["h1", "h2"]).where("id <> rep").select("id", "rep")
    copies = table(copies.distinct(), "copies")
    reps = plain.join(_if_small(copies.select("id").distinct()), "id", "left_anti")
    each = reps.select("id", F.explode("sigs").alias("sig"))
    # half the signatures take their least id as hub, half a random one
    order = F.when(F.col("sig").bitwiseAND(F.lit(1)) == 0, F.col("id")).otherwise(F.xxhash64("id"))
    inside = Window.partitionBy("sig").orderBy("order", "id")
    shared = each.withColumn("order", order).select("sig", "id", F.first("id").over(inside).alias("hub"), F.lead("id").over(inside).alias("follower"))
    shared = table(shared.where("hub <> id or follower is not null").select("sig", "id", "hub"), "shared")
    held = reps.select("id", "n", "sketch").dropDuplicates(["id"])
    a, b = (held.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x)) for x in "ab")
    stars = shared.where("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb")
    links = verified(table(_sketched(stars, percent), "stars"), docs, n, percent)
    merged = table(components(links), "merged")
    # second round: groups that still hold several components
    placed = shared.join(merged, "id", "left").select("sig", "id", "hub", F.coalesce("component", "id").alias("component"))
    placed = table(placed, "placed")
    drop(shared)
    mixed = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x <> y and m > 2")
    mixed = mixed.select("sig", F.ceil(F.col("m") / CELL).cast("int").alias("cells"))
    rest = placed.where("hub <> id").join(mixed, "sig").join(held, "id")
    side = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")
    rest = rest.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cells = rest.select("sig", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "n", "component", "sketch")
    cells = cells.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    more = table(_blocks(cells, percent).distinct(), "more")
    drop(placed)
    # copies follow the set that stands for them; rows that share an id tie sets
    edges = merged.select(F.col("id").alias("a"), F.col("component").alias("b")).union(copies.select("id", "rep"))
    if not more.isEmpty():
        edges = edges.union(verified(more, docs, n, percent))
    merged = components(edges)
    told = found.select("id", F.col("n").alias("n_shingles"))
    where = merged.select(F.col("id").alias("m"), "component")
    return told.join(where, told.id == where.m, "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def _tied(docs: DataFrame, found: DataFrame, several: DataFrame, n: int, percent: int) -> DataFrame:
    """:func:`join` where ids in ``several`` have more than one set.

    Distinct texts are numbered and joined by number, so every set is compared;
    then rows that share an id tie the components of their texts.
    """
    rows = docs.where("id is not null").select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    texts = rows.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    spread = texts.repartition("t1", "t2").sortWithinPartitions("t1", "t2").withColumn("node", F.monotonically_increasing_id())
    texts = table(spread.select("node", "t1", "t2", "text"), "texts")
    near = join(texts.select("node", "text"), n, percent, "node", "text").select(F.col("id").alias("node"), F.col("component").alias("root"))
    placed = table(rows.select("id", "t1", "t2").distinct().join(texts.select("node", "t1", "t2"), ["t1", "t2"]).join(near, "node").select("id", "root").distinct(), "placed-ids")
    # ids of a root are tied to the least of them, and an id ties its roots
    ties = placed.join(placed.groupBy("root").agg(F.min("id").alias("least")), "root").select(F.col("id").alias("a"), F.col("least").alias("b"))
    where = components(ties).select(F.col("id").alias("m"), "component")
    told = found.select("id", F.col("n").alias("n_shingles"))
    return told.join(where, told.id == where.m, "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def report(df: DataFrame, n: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document."""
    return join(df, n, percent).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
