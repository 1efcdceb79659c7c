"""Scans: delimited text, GeoJSON, shapefiles, GeoPackages and whole text files."""

from __future__ import annotations

import json
import struct
import urllib.parse
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelink.session import ship
from placelink.sources.config import TYPES, Source

#: Texts that count as missing in delimited files; fixed values of the reader that users are used to.
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def tabular(spark: SparkSession, path: str, source: Source, na_values: tuple[str, ...] = NA_VALUES) -> DataFrame:
    """A delimited file without header; columns are bound by position and typed.

    ``skiprows`` leaves out the first physical lines.  ``na_values`` become
    null; give ``("",)`` to keep codes such as ``NA``.  Dropped columns are not
    read.  Geometry columns cannot come from text and are left to derivations.
    """
    columns = [a for a in source.original if a.type != "geometry"]
    schema = T.StructType([T.StructField(a.name, T.StringType()) for a in columns])
    options = {"sep": source.separator, "header": "false", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if source.skiprows:
        ddl = ", ".join(f"`{a.name}` string" for a in columns)
        rows = _without_first(spark, path, source.skiprows).where("value <> ''").select(F.from_csv("value", ddl, options).alias("r")).select("r.*")
    else:
        rows = spark.read.options(**options).schema(schema).csv(path)
    missing = list(na_values)

    def typed(a) -> F.Column:
        value = F.col(f"`{a.name}`")
        value = F.when(~value.isin(missing), value)
        return (value if a.type == "text" else value.try_cast("double").cast("bigint") if a.type == "integer" else value.try_cast(TYPES[a.type])).alias(a.name)

    return rows.select(*(typed(a) for a in columns if not a.drop))


def _without_first(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Lines ``(value)`` of files without the first ``n`` of each.

    Only the split at the start of a file holds them, and it must: only its
    lines go through Python, where they are counted as they come.
    """
    ship(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def skip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            kept = []
            for file in batch.column(0).to_pylist():
                seen[file] = seen.get(file, 0) + 1
                kept.append(seen[file] > n)
            yield batch.select([2]).filter(pa.array(kept, pa.bool_()))

    return lines.where("block > 0").select("value").union(lines.where("block = 0").mapInArrow(skip, "value string"))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """``geometry`` as WKT and the properties of all features, as text and in their mean order, of a feature collection.

    A feature that lacks a property has null there.  The file is one JSON text,
    so one task parses it; its features are dealt out from there.
    """
    ship(spark)
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    told = each.select(F.posexplode(F.json_object_keys(F.get_json_object("f", "$.properties"))).alias("place", "k"))
    names = [r["k"] for r in told.groupBy("k").agg(F.count("*").alias("n"), F.avg("place").alias("place")).orderBy("place", F.desc("n"), "k").collect()]  # a row a property

    def wkt(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda g: _geojson_wkt(json.loads(g)) if isinstance(g, str) else None)

    props = [F.get_json_object("f", f"$.properties['{n}']").alias(n) for n in names]
    dealt = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(F.pandas_udf(wkt, "string")(F.get_json_object("f", "$.geometry")).alias("geometry"), *props)


def _geojson_wkt(geometry: dict | None) -> str | None:
    if not geometry:
        return None

    def text(part) -> str:
        if part and isinstance(part[0], (int, float)):
            return f"{part[0]!r} {part[1]!r}"
        return ", ".join(text(p) if p and isinstance(p[0], (int, float)) else f"({text(p)})" for p in part)

    return f"{geometry['type'].upper()} ({text(geometry['coordinates'])})"


_PARTS = {3: "MULTILINESTRING", 5: "POLYGON"}


def shape_wkt(body: bytes) -> str | None:
    """WKT of a shapefile record's content; third dimensions are left out."""
    kind = struct.unpack_from("<i", body)[0] % 10
    if kind == 0:
        return None
    if kind == 1:
        x, y = struct.unpack_from("<2d", body, 4)
        return f"POINT ({x!r} {y!r})"
    if kind == 8:
        n = struct.unpack_from("<i", body, 36)[0]
        xy = struct.unpack_from(f"<{2 * n}d", body, 40)
        return "MULTIPOINT (" + ", ".join(f"{xy[k]!r} {xy[k + 1]!r}" for k in range(0, 2 * n, 2)) + ")"
    if kind not in _PARTS:
        raise ValueError(f"unknown shape type {kind}")
    parts, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
    xy = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
    rings = ["(" + ", ".join(f"{xy[2 * k]!r} {xy[2 * k + 1]!r}" for k in range(a, b)) + ")" for a, b in zip(starts, starts[1:], strict=False)]
    if kind == 3:
        return f"LINESTRING {rings[0]}" if len(rings) == 1 else f"MULTILINESTRING ({', '.join(rings)})"
    # outer rings run clockwise; each hole belongs to the outer ring before it
    groups: list[list[str]] = []
    for ring, (a, b) in zip(rings, zip(starts, starts[1:], strict=False), strict=True):
        area = sum(xy[2 * k] * xy[2 * k + 3] - xy[2 * k + 2] * xy[2 * k + 1] for k in range(a, b - 1))
        if area <= 0 or not groups:
            groups.append([ring])
        else:
            groups[-1].append(ring)
    bodies = [f"({', '.join(g)})" for g in groups]
    return f"POLYGON {bodies[0]}" if len(bodies) == 1 else f"MULTIPOLYGON ({', '.join(bodies)})"


def fields(head: bytes) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """Rows, bytes before the first, bytes of one, and the fields of a ``.dbf`` file, from its first bytes."""
    count, first, size = struct.unpack_from("<IHH", head, 4)
    out, at = [], 32
    while head[at] != 0x0D:
        out.append((head[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), chr(head[at + 11]), head[at + 16]))
        at += 32
    return count, first, size, out


def attribute_rows(data: bytes, size: int, columns: list[tuple[str, str, int]], encoding: str = "utf-8") -> Iterator[list]:
    """Values, as text, of successive rows of ``size`` bytes; numbers that are not set are null."""
    for at in range(0, len(data) - size + 1, size):
        spot, row = at + 1, []
        for _, kind, width in columns:
            text = data[spot : spot + width].strip(b" \0").decode(encoding, "replace")
            spot += width
            row.append(None if not text or kind in "NF" and "*" in text else text)
        yield row


#: Records of a shapefile that a task reads.
RECORDS = 20_000


def shapefile(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``geometry`` as WKT and the attributes, as text, of a shapefile.

    The driver reads the head of the ``.dbf`` file only.  With a ``.shx`` file,
    which says where each record is, tasks read ranges of records; without one
    the records follow each other unmarked, and one task reads them all.
    """
    ship(spark)
    stem = path[:-4] if path.lower().endswith(".shp") else path
    fs, at = open_store(stem)
    with fs.open_input_file(at + ".dbf") as file:
        first = struct.unpack_from("<H", file.read(32), 8)[0]
        file.seek(0)
        count, first, size, columns = fields(file.read(first))
    indexed = fs.get_file_info(at + ".shx").is_file
    step = RECORDS if indexed else max(count, 1)
    names = ["geometry", *(c[0] for c in columns)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_store(stem)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                n = min(step, count - start)
                with fs.open_input_file(at + ".dbf") as file:
                    file.seek(first + start * size)
                    held = list(attribute_rows(file.read(n * size), size, columns, encoding))
                with fs.open_input_file(at + ".shp") as file:
                    if indexed:
                        with fs.open_input_file(at + ".shx") as index:
                            index.seek(100 + 8 * start)
                            spots = struct.unpack(f">{2 * n}i", index.read(8 * n))
                        begin, end = 2 * spots[0], 2 * spots[-2] + 8 + 2 * spots[-1]
                    else:
                        begin, end = 100, file.size()
                    file.seek(begin)
                    data, made = file.read(end - begin), []
                if indexed:
                    made = [shape_wkt(data[2 * o - begin + 8 : 2 * o - begin + 8 + 2 * w]) for o, w in zip(spots[::2], spots[1::2], strict=True)]
                else:
                    spot = 0
                    while spot + 8 <= len(data) and len(made) < n:
                        words = struct.unpack_from(">i", data, spot + 4)[0]
                        made.append(shape_wkt(data[spot + 8 : spot + 8 + 2 * words]))
                        spot += 8 + 2 * words
                table = [pa.array(c, pa.string()) for c in zip(*([w, *row] for w, row in zip(made, held, strict=False)), strict=True)]
                if table:
                    yield pa.RecordBatch.from_arrays(table, names)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.range(0, count, step, max(1, -(-count // step))).mapInArrow(rows, schema)


def open_store(uri: str):
    """File system and path of a URI, for reading ranges of a file; plain paths are of a disk that all can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


#: WKB's numbers of kinds.
_KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def wkb_wkt(data: bytes) -> str | None:
    """WKT of well-known binary; third and fourth dimensions are left out."""

    def one(at: int) -> tuple[str, str, int]:
        order = "<" if data[at] else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        kind = (code & 0xFFFF) % 1_000
        size = 2 + (1 if code & 0x80000000 or (code & 0xFFFF) // 1_000 in (1, 3) else 0) + (1 if code & 0x40000000 or (code & 0xFFFF) // 1_000 in (2, 3) else 0)
        at += 9 if code & 0x20000000 else 5

        def points(at: int, n: int) -> tuple[str, int]:
            xy = struct.unpack_from(f"{order}{n * size}d", data, at)
            return ", ".join(f"{xy[k]!r} {xy[k + 1]!r}" for k in range(0, n * size, size)), at + 8 * n * size

        if kind == 1:
            body, at = points(at, 1)
            return "POINT", "" if "nan" in body else f"({body})", at
        if kind not in _KINDS or kind == 7:
            raise ValueError(f"unknown geometry type {code}")
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        if kind == 2:
            body, at = points(at, n)
            return "LINESTRING", f"({body})" if n else "", at
        parts = []
        for _ in range(n):
            if kind == 3:
                m = struct.unpack_from(order + "I", data, at)[0]
                body, at = points(at + 4, m)
                parts.append(f"({body})")
            else:
                _, body, at = one(at)
                parts.append(body[1:-1] if kind == 4 else body)
        return _KINDS[kind], f"({', '.join(parts)})" if parts else "", at

    kind, body, _ = one(0)
    return f"{kind} {body}" if body else None


def gpkg_wkt(blob: bytes | None) -> str | None:
    """WKT of a GeoPackage geometry: a head with its size in its flags, then well-known binary."""
    if not blob or blob[:2] != b"GP":
        return None
    flags = blob[3]
    if flags & 0x10:
        return None  # marked as empty
    return wkb_wkt(blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[flags >> 1 & 7] :])


def geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """``geometry`` as WKT and the attributes, as text, of a layer of a GeoPackage: the first one unless named.

    On a disk that all can reach tasks open the file read-only and read ranges
    of row numbers; from other stores one task gets it whole.
    """
    ship(spark)
    plain = path.removeprefix("file://").removeprefix("file:")
    shared = "://" not in plain
    if shared:
        raw = None
        with _database(plain, None) as held:
            told = _layer(held, layer)
            low, high = held.execute(f'select min(rowid), max(rowid) from "{told[0]}"').fetchone()
    else:
        raw = spark.read.format("binaryFile").load(path).select("content")
        told = next(iter(raw.mapInArrow(lambda batches: _told(batches, layer), "told string").collect()))
        told = json.loads(told["told"])
        low, high = 0, (1 << 63) - 1
    table, shape, columns = told
    names = ["geometry", *columns]
    chosen = ", ".join(f'"{c}"' for c in [shape, *columns])

    def rows(held, start: int, end: int) -> Iterator[pa.RecordBatch]:
        cursor = held.execute(f'select {chosen} from "{table}" where rowid between ? and ? order by rowid', (start, end))
        while part := cursor.fetchmany(2_048):
            text = [[gpkg_wkt(r[0]), *(None if v is None else str(v) for v in r[1:])] for r in part]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*text, strict=True)], names)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                with _database(plain, None) as held:
                    yield from rows(held, start, start + RECORDS - 1)

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                with _database(None, data.as_py()) as held:
                    yield from rows(held, low, high)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    if not shared:
        return raw.mapInArrow(content, schema)
    if low is None:
        return spark.createDataFrame([], schema)
    return spark.range(low, high + 1, RECORDS, max(1, -(-(high - low + 1) // RECORDS))).mapInArrow(ranges, schema)


@contextmanager
def _database(path: str | None, data: bytes | None):
    import sqlite3

    held = sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro&immutable=1", uri=True) if path else sqlite3.connect(":memory:")
    try:
        if data is not None:
            held.deserialize(data)
        yield held
    finally:
        held.close()


def _layer(held, layer: str | None) -> tuple[str, str, list[str]]:
    """Table, geometry column and attributes of a layer; the key is no attribute."""
    found = held.execute("select table_name, column_name from gpkg_geometry_columns order by rowid").fetchall()
    table, shape = next((f for f in found if layer in (None, f[0])), (None, None))
    if table is None:
        raise ValueError(f"no layer {layer or ''!r} in the file")
    columns = [c[1] for c in held.execute(f'pragma table_info("{table}")') if c[1] != shape and not c[5]]
    return table, shape, columns


def _told(batches: Iterator[pa.RecordBatch], layer: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            with _database(None, data.as_py()) as held:
                yield pa.RecordBatch.from_pydict({"told": [json.dumps(_layer(held, layer))]})


def spatial(spark: SparkSession, path: str, source: Source) -> DataFrame:
    """A vector file; attributes are bound by position, columns beyond them left out."""
    low = path.lower()
    if low.endswith((".geojson", ".json")):
        rows = geojson(spark, path)
    elif low.endswith(".shp"):
        rows = shapefile(spark, path)
    elif low.endswith(".gpkg"):
        rows = geopackage(spark, path)
    else:
        raise ValueError(f"unknown vector format: {Path(path).name}")
    plain = [a for a in source.original if a.type != "geometry"]
    held = [c for c in rows.columns if c != "geometry"]
    if len(held) < len(plain):
        raise ValueError(f"{Path(path).name} has {len(held)} attributes, {len(plain)} are declared")
    picked = [F.col(f"`{c}`").try_cast(TYPES[a.type]).alias(a.name) if a.type != "text" else F.col(f"`{c}`").alias(a.name) for a, c in zip(plain, held, strict=False) if not a.drop]
    shape = next(a.name for a in source.original if a.type == "geometry")
    return rows.select(*picked, F.col("geometry").alias(shape))


def scan(spark: SparkSession, path: str, source: Source, **options) -> DataFrame:
    return tabular(spark, path, source, **options) if source.kind == "tabular" else spatial(spark, path, source)


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(filename, text)`` of whole files."""
    rows = spark.read.text(folder, wholetext=True)
    return rows.select(F.regexp_extract("_metadata.file_name", "[^/]*$", 0).alias("filename"), F.col("value").alias("text"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """``(session_id, json, ok)`` of the JSON files of a folder; ``ok`` unless one cannot be parsed."""
    from placelink.operators.annotate import SESSION

    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    parsed = F.from_json("value", SESSION, {"mode": "PERMISSIVE"})
    return raw.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("session_id"), F.col("value").alias("json"), F.coalesce(parsed["documents"].isNotNull(), F.lit(False)).alias("ok"))


def import_sessions(spark: SparkSession, folder: str, target: str) -> dict:
    """Sessions of a folder's JSON files as tables below ``target``; files that were imported are deleted.

    ``{"found", "loaded", "failed"}``: numbers of files, and the names of those
    that could not be parsed, which stay.  Files go only when the tables are
    written.
    """
    from placelink.operators import annotate
    from placelink.storage import Storage

    store, held = Storage(spark, folder), sessions(spark, folder)
    told = held.select("session_id", "ok").collect() if any(n.endswith(".json") for n in store.names()) else []  # a row a file
    good = [r["session_id"] for r in told if r["ok"]]
    if good:
        documents, toponyms = annotate.load(held.where("ok").select("session_id", "json"))
        documents.write.mode("append").parquet(f"{target}/documents")
        toponyms.write.mode("append").parquet(f"{target}/toponyms")
        for name in good:
            store.delete(f"{name}.json")
    return {"found": len(told), "loaded": len(good), "failed": sorted(f"{r['session_id']}.json" for r in told if not r["ok"])}
