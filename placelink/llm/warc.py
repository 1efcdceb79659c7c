"""WARC archives: written by Spark's text sink, read by boundary-chain verification.

Writing stays on the JVM: a record is one string, the sink's line separator is
the blank lines that end a record.  Reading splits files anywhere: tasks cut
their range at every record magic, and each cut is a candidate record that
names its successor by its Content-Length.  Pointer jumping from the start of
each file keeps the candidates that the chain reaches; a magic inside a payload
is never reached.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelink.llm.common import open_store, prepare, shared_path, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
URN = "urn:placelink:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never revisits.
LEAST = 100
#: Rows up to which a table of (digest, id) or (file, offset) rows is broadcast: some 10 MB.
BROADCAST_ROWS = 100_000


def _if_small(df: DataFrame) -> DataFrame:
    """Broadcast a written table if its counted rows are few, else let it be shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _urn(ident: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(ident.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One WARC record per row, as a string without its closing blank lines."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    firsts = rows.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    rows = rows.join(_if_small(table(firsts, "copies")), "digest", "left")
    # rows whose id ties with the first one's, and rows alone, are responses
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("urn:placelink:none")), "[\\x00-\\x20]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("first"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, folder: str, **columns) -> None:
    """Write ``pages`` as WARC files into ``folder``, a file a task.

    Of rows with equal payloads of at least ``LEAST`` bytes the one with the
    smallest id is a response and the others revisit it; rows that share that
    smallest id are all responses, and a null id counts as larger than any.
    A null payload is an empty one; a null URL gets a placeholder.
    """
    records(pages, **columns).write.option("lineSep", END).option("compression", "none").text(folder)


_HEAD = "file string, block long, seq int, local long, length long, valid boolean, span long, type string, id string, refers string, uri string, content_type string, digest string, payload_bytes long, computed string, whole boolean"


def _length(told: str) -> int | None:
    """A Content-Length, or None if it is no number of at most 18 digits."""
    return int(told) if told.isascii() and told.isdigit() and len(told) <= 18 else None


def _parse(text: bytes) -> dict:
    """Fields of a candidate record whose magic has been cut off."""
    end = text.find(b"\r\n\r\n")
    out = {"valid": False, "span": None, "type": None, "id": None, "refers": None, "uri": None, "content_type": None, "digest": None, "payload_bytes": None, "computed": None, "whole": False}
    if end < 0:
        return out
    fields = {}
    for row in text[:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return out
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = _length(fields.get(b"content-length", ""))
    if length is None or b"warc-type" not in fields:
        return out
    span = end + 4 + length
    out |= {"valid": True, "span": len(MAGIC) + span + len(END), "whole": span + len(END) == len(text)}
    out |= {"type": fields[b"warc-type"], "id": fields.get(b"warc-record-id"), "refers": fields.get(b"warc-refers-to"), "uri": fields.get(b"warc-target-uri"), "content_type": fields.get(b"content-type"), "digest": fields.get(b"warc-payload-digest")}
    if span > len(text):
        return out  # it goes on beyond the next magic
    body = text[end + 4 : span]
    if (out["content_type"] or "").startswith("application/http"):
        head, gap, rest = body.partition(b"\r\n\r\n")
        if gap:
            own = [_length(v.strip().decode("latin-1")) for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if n.strip().lower() == b"content-length"]
            out["payload_bytes"] = own[0] if out["type"] == "revisit" and own and own[0] is not None else len(rest)
            out["computed"] = None if out["type"] == "revisit" else hashlib.sha256(rest).hexdigest()
            return out
    out["payload_bytes"], out["computed"] = len(body), hashlib.sha256(body).hexdigest()
    return out


def _cuts(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, block, value binary)``: what lies between magics, in file order within a block."""
    raw = spark.read.option("lineSep", MAGIC).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _numbered(batches: Iterator[pa.RecordBatch]):
    """Each cut with its block, its number there and the bytes before it in the block."""
    at, seq, local = None, 0, 0
    for batch in batches:
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != at:
                at, seq, local = (file, block), 0, 0
            yield file, block, seq, local, value
            seq, local = seq + 1, local + len(value) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for file, block, seq, local, value in _numbered(batches):
        rows.append({"file": file, "block": block, "seq": seq, "local": local, "length": len(value) + len(MAGIC)} | _parse(value))
        if len(rows) >= 2_048:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


_KIND = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _KIND[c.split()[1]]) for c in _HEAD.split(", ")])


def _exits(rows):
    """Follow the chain inside one block: each candidate's first successor beyond it."""
    at, to = rows.column("at").to_pylist(), rows.column("next").to_pylist()
    known: dict[int, int] = {}
    for a, b in sorted(zip(at, to, strict=True), reverse=True):
        known[a] = known.get(b, b)
    return rows.append_column("exit", pa.array([known[a] for a in at], pa.int64()))


def _walk(rows):
    """The candidates of one block that the chain reaches from where it enters."""
    at, to, entry = (rows.column(c).to_pylist() for c in ("at", "next", "entry"))
    step, spot = dict(zip(at, to, strict=True)), entry[0]
    seen = set()
    while spot in step and spot not in seen:
        seen.add(spot)
        spot = step[spot]
    return rows.filter(pa.array([a in seen for a in at]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives in ``folder``: ``(file, at, type, id, refers, uri, digest, payload_bytes, computed)``.

    ``digest`` is the header's, ``computed`` the SHA-256 of the payload read
    (null for revisits).  A file that does not start with a record gives none;
    a chain that leads to no record ends there.  Empty files give none.
    Records whose payload holds a magic are read again by byte range, through
    ``pyarrow.fs``.
    """
    prepare(spark)
    found = table(_cuts(spark, folder).mapInArrow(_candidates, _HEAD), "candidates")
    totals = found.groupBy("file", "block").agg(F.sum("length").alias("bytes"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "block", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base"))
    placed = found.join(bases, ["file", "block"]).withColumn("at", F.col("base") + F.col("local") - len(MAGIC))
    able = placed.where("valid and at >= 0").select("file", "block", "at", (F.col("at") + F.col("span")).alias("next"))
    exits = table(able.groupBy("file", "block").applyInArrow(_exits, "file string, block long, at long, next long, exit long"), "exits")
    # pointer jumping over blocks: hops double until no new entry is reached
    reached = exits.where("at = 0").select("file", "at")
    blocks = found.groupBy("file").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    hops = exits.select("file", "at", F.col("exit").alias("to"))
    size = 1
    while size < blocks:
        more = reached.join(hops, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = table(reached.union(more).distinct(), "reached")
        size *= 2
        if size < blocks:
            far = hops.select("file", F.col("at").alias("to"), F.col("to").alias("end"))
            hops = table(hops.join(far, ["file", "to"], "left").select("file", "at", F.coalesce("end", "to").alias("to")), "hops")
    entry = exits.join(reached, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    kept = exits.select("file", "block", "at", "next").join(entry, ["file", "block"])
    kept = kept.groupBy("file", "block").applyInArrow(_walk, "file string, block long, at long, next long, entry long").select("file", "at", "next")
    kept = table(kept, "chain")
    cols = ["file", "at", "type", "id", "refers", "uri", "digest", "payload_bytes", "computed"]
    full = placed.join(kept, ["file", "at"])
    plain = full.where("whole").select(*cols)
    wide = table(full.where("not whole").select("file", "at", "next"), "wide")
    return plain if wide.isEmpty() else plain.union(_ranged(wide).select(*cols))


def _ranged(wide: DataFrame) -> DataFrame:
    """Records ``wide(file, at, next)`` whose payload holds a magic, read by their byte ranges.

    A range does not depend on how the files were split when the candidates
    were found.  One that cannot be read is an error, never a missing record;
    the last record of a file may lack the blank lines behind it.
    """
    n = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        try:
            for batch in batches:
                for file, at, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file != name:
                        if opened is not None:
                            opened.close()
                        fs, path = open_store(file)
                        opened, name = fs.open_input_file(path), file
                    opened.seek(at)
                    text = opened.read(end - at)
                    if not text.startswith(MAGIC.encode()):
                        raise ValueError(f"no record at byte {at} of {file}")
                    own = _parse(text[len(MAGIC) :])
                    yield pa.RecordBatch.from_pylist([{"file": file, "at": at} | {k: own[k] for k in _PART.names[2:]}], _PART)
        finally:
            if opened is not None:
                opened.close()

    dealt = wide.repartition(n, "file", "at").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(ranges, "file string, at long, type string, id string, refers string, uri string, digest string, payload_bytes long, computed string")


_PART = pa.schema([("file", pa.string()), ("at", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("refers", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("computed", pa.string())])


def page_rows(found: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of response and revisit records."""
    number = lambda c: F.regexp_extract(c, f"{URN}(-?[0-9]+)>", 1).try_cast("long")
    told = F.regexp_replace("digest", "^sha256:", "")
    return found.where("type in ('response', 'revisit')").select(
        number("id").alias("page_id"),
        "payload_bytes",
        F.coalesce("computed", told).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    folder = shared_path(pages.sparkSession, "warc")
    write(pages, folder)
    return page_rows(read(pages.sparkSession, folder))
