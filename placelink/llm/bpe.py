"""Byte-level BPE: overlapping chunk encoding, decoding by raw bytes.

A long text is cut into chunks that overlap.  Tasks pre-tokenise the chunks
independently and hand on only the pre-token boundaries inside the overlaps.
Where two neighbours agree on one they agree on everything after it, so the
stitch cuts the text there: each chunk gets a piece that starts and ends at
true boundaries and has the ids that it has in the whole text.  Tasks encode the
pieces, and the ids are put together in order.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelink.llm.common import prepare, table

#: Code points of a chunk, and how far a chunk reaches into the next one.
CHUNK, OVERLAP = 32_768, 4_096
#: Rows up to which a table of pieces is broadcast: some 6 MB.
BROADCAST_ROWS = 100_000
#: A match that ends this close to a chunk's end may end elsewhere in the text.
EDGE = 4


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def codec(path: str, pattern: str):
    """The encoder of a rank file, one per worker process."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _bytes_of(path: str) -> list[bytes]:
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def boundaries(text: str, pattern: str, whole: bool) -> list[int]:
    """Starts of the pre-tokens of ``text``, and its end if ``whole``.

    A chunk that is cut off at its right keeps only boundaries that the text
    beyond the cut cannot change.
    """
    import regex

    sure = len(text) if whole else len(text) - EDGE
    out = [0]
    for m in regex.finditer(pattern, text):
        if m.end() > sure or (m.end() == sure and not whole):
            break
        out.append(m.end())
    return out


def firm(text: str, pattern: str, whole: bool, first: int, last: int) -> tuple[list[int], list[int]]:
    """The boundaries of ``text`` up to ``first``, and those from ``last`` on, that tell two chunks to agree.

    Only boundaries after a character that is no white space do, since how a
    run of white space splits depends on what follows it.
    """
    sure = [b for b in boundaries(text, pattern, whole) if b and not text[b - 1].isspace()]
    return sure[: bisect_right(sure, first)], sure[bisect_left(sure, last) :]


def stitch(marks: list[tuple[list[int], list[int]]], chunk: int) -> list[int] | None:
    """Where the pieces of a text start: 0, and for each further chunk the first boundary it shares with what comes before.

    ``marks`` are the boundaries in each chunk's first and last overlap,
    relative to its start.  None if two neighbours share none, as when a single
    pre-token is longer than the overlap.
    """
    starts = [0]
    for k in range(1, len(marks)):
        known = {m - chunk for m in marks[k - 1][1] if m + (k - 1) * chunk >= starts[-1]}
        sync = next((b for b in marks[k][0] if b in known), None)
        if sync is None:
            return None
        starts.append(k * chunk + sync)
    return starts


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _spelled(ids: list[list[int] | None], path: str) -> pa.Array:
    token = _bytes_of(path).__getitem__
    return pa.array([b"".join(map(token, row or ())) for row in ids], pa.binary())


def _ids_batch(keys: list, ids: list[list[int]], key_type: pa.DataType, decoded: str | None) -> pa.RecordBatch:
    cols, names = [pa.array(keys, key_type), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"]
    if decoded:
        cols, names = [*cols, _spelled(ids, decoded)], [*names, "decoded"]
    return pa.RecordBatch.from_arrays(cols, names)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """Token ids of every whole text: ``(id, ids array<int>)``, one row per input row.

    With ``decoded`` the ids are also decoded again where they were made, as
    :func:`decode` does, into a column of that name.

    A null text counts as empty (no ids), a null id stays null, rows that
    repeat are returned as often, an empty table gives none, other columns are
    ignored whatever their names.  Texts up to ``chunk`` code points are
    encoded where they are read; longer ones are cut, dealt out in chunks and
    encoded in pieces, each different text once.  A long text in which a
    single pre-token is longer than the overlap is encoded whole in one task.
    """
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and smaller than chunk")
    prepare(df.sparkSession)
    kind, back = dict(df.dtypes)[id_col], path if decoded else None
    told = f"id {kind}, ids array<int>{', decoded binary' if decoded else ''}"
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path, pattern)
        for batch in batches:
            yield _ids_batch(_column(batch, "id").to_pylist(), [enc.encode_ordinary(t) for t in _column(batch, "text").to_pylist()], batch.schema.field("id").type, back)

    short = docs.where(F.length("text") <= chunk).mapInArrow(near, told)
    long = docs.where(F.length("text") > chunk).select("id", "text", F.sha2("text", 256).alias("sha"))
    n = F.length("text")
    cut = long.select("sha", "text", n.alias("total"), F.explode(F.sequence(F.lit(0), F.ceil((n - overlap) / chunk).cast("int") - 1)).alias("part_no"))
    cut = cut.select("sha", "total", "part_no", F.expr(f"substring(text, part_no * {chunk} + 1, {chunk + overlap})").alias("part"))
    # copies of a text are put together before they are dealt out
    chunks = table(cut.groupBy("sha", "part_no").agg(F.first("part").alias("part"), F.first("total").alias("total")), "chunks")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, totals = _column(batch, "part_no").to_pylist(), _column(batch, "total").to_pylist()
            found = [firm(t.as_py(), pattern, k * chunk + chunk + overlap >= m, overlap, chunk) for t, k, m in zip(_column(batch, "part"), numbers, totals, strict=True)]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([_column(batch, "sha"), _column(batch, "part_no"), _column(batch, "total"), *lists], ["sha", "part_no", "total", "head", "tail"])

    def stitched(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part_no")
        starts = stitch(list(zip(rows.column("head").to_pylist(), rows.column("tail").to_pylist(), strict=True)), chunk)
        count = rows.num_rows
        ends = [None] * count if starts is None else [*starts[1:], rows.column("total")[0].as_py()]
        at = [None] * count if starts is None else starts
        return pa.table({"sha": rows.column("sha"), "part_no": rows.column("part_no"), "begin": pa.array(at, pa.int64()), "end": pa.array(ends, pa.int64())})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path, pattern)
        for batch in batches:
            spots = zip(_column(batch, "part"), *(_column(batch, c).to_pylist() for c in ("part_no", "begin", "end")), strict=True)
            ids = [enc.encode_ordinary(t.as_py()[a - k * chunk : b - k * chunk]) for t, k, a, b in spots]
            made = _ids_batch(_column(batch, "sha").to_pylist(), ids, pa.string(), back)
            yield pa.RecordBatch.from_arrays([_column(batch, "part_no"), *made.columns], ["part_no", "sha", *made.schema.names[1:]])

    def gathered(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part_no")
        ids = rows.column("ids").combine_chunks().flatten()
        whole = {"sha": rows.column("sha")[:1], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
        return pa.table(whole | ({"decoded": pa.array([b"".join(rows.column("decoded").to_pylist())], pa.binary())} if back else {}))

    wide = told.split(", ", 1)[1]
    spots = chunks.mapInArrow(marked, "sha string, part_no int, total int, head array<int>, tail array<int>")
    spots = table(spots.groupBy("sha").applyInArrow(stitched, "sha string, part_no int, begin long, end long"), "pieces")
    held = F.broadcast(spots) if spots.count() <= BROADCAST_ROWS else spots
    pieces = chunks.join(held.where("begin is not null"), ["sha", "part_no"]).select("sha", "part_no", "part", "begin", "end")
    made = pieces.mapInArrow(encoded, f"part_no int, sha string, {wide}").groupBy("sha").applyInArrow(gathered, f"sha string, {wide}")
    rest = spots.where("begin is null").select("sha").distinct()
    unstitched = long.join(rest, "sha", "left_semi").groupBy("sha").agg(F.first("text").alias("text")).select(F.col("sha").alias("id"), "text")
    made = made.union(unstitched.mapInArrow(near, told.replace(f"id {kind}", "id string", 1)).withColumnRenamed("id", "sha"))
    return short.union(long.select("id", "sha").join(made, "sha").drop("sha"))


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Raw bytes of ids: ``(id, decoded binary)``; the tokens' bytes, concatenated.

    Null ids give empty bytes; an id outside the vocabulary is an error.
    """
    prepare(df.sparkSession)
    others = [c for c in df.columns if c not in (id_col, ids_col)]
    fields = ", ".join(f"`{c}` {k}" for c, k in df.dtypes if c in others)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _spelled(_column(batch, ids_col).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([_column(batch, id_col), *(_column(batch, c) for c in others), out], ["id", *others, "decoded"])

    kind = dict(df.dtypes)[id_col]
    return df.mapInArrow(spell, f"id {kind}, {fields + ', ' if fields else ''}decoded binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text."""
    # decoded in the task that encodes: one Python worker a task instead of two
    both = encode(df, path, pattern, id_col, text_col, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return both.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
