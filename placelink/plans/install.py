"""From a configuration to tables, views, features and names, as one lazy plan a source."""

from __future__ import annotations

import json
import re
import shutil
import tempfile
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelink.functions import geo
from placelink.operators import postings, registration, search, spatial, views
from placelink.plans import dialect
from placelink.sources import acquire, config, scan
from placelink.storage import Storage

SCHEMA_VERSION = 3
#: Paths that name their file system are left to Spark as they are.
_URI = re.compile("[a-z][a-z0-9+.-]+:")


@dataclass
class Built:
    """Tables and views by source, and what was registered."""

    tables: dict[str, DataFrame]
    views: dict[str, DataFrame]
    features: DataFrame | None
    names: DataFrame | None


def derive(table: DataFrame, source: config.Source) -> DataFrame:
    """``table`` with its derived columns, each of which may use those before it."""
    for a in source.derived:
        value = F.expr(dialect.translate(a.expression, table.columns)).cast(config.TYPES[a.type])
        table = table.withColumn(a.name, value)
    return table


def _key(k: int, right: str) -> str:
    return f"__spatial_{k}_{right}"


def located(table: DataFrame, source: config.Source, tables: dict[str, DataFrame], by: dict[str, config.Source], cell: float | None) -> DataFrame:
    """``table`` with a key column for each spatial join: the row of the first match."""
    for k, join in enumerate(source.joins):
        if join.kind != "spatial":
            continue
        right = join.right.split(".")[0]
        if by[source.name].srid is None or by[right].srid is None:
            raise ValueError(f"spatial join of {source.name!r} and {right!r} needs geometries on both sides")
        rows = table.withColumn("__row", F.xxhash64(*(F.col(f"`{c}`") for c in table.columns)))
        shapes = keyed(tables[right]).select(F.col("__key").alias("shape_id"), F.col("geometry").alias("wkt"))
        if join.right_transform == "centroid":
            shapes = spatial.centroids(shapes, "wkt").select("shape_id", geo.point_wkt(F.col("x"), F.col("y")).alias("wkt"))
        if join.left_transform == "centroid":
            spots = spatial.centroids(rows, "geometry", "__x", "__y")
        else:
            spots = rows.withColumn("__x", geo.point_x(F.col("geometry"))).withColumn("__y", geo.point_y(F.col("geometry")))
        srid = (by[right].srid, by[source.name].srid)
        points = spots.where("__x is not null").select(F.col("__row").alias("point_id"), F.col("__x").alias("x"), F.col("__y").alias("y")).distinct()
        others = spots.where("__x is null and geometry is not null").select(F.col("__row").alias("left_id"), F.col("geometry").alias("wkt")).distinct()
        if join.predicate == "contains":  # a point contains only an equal point
            pairs = spatial.points_in_shapes(points, shapes.where(F.upper(F.trim("wkt")).startswith("POINT")), cell, True, srid)
        else:
            pairs = spatial.points_in_shapes(points, shapes, cell, join.predicate != "within", srid)
        if join.left_transform != "centroid":
            wide = spatial.shapes_in_shapes(others, shapes.select(F.col("shape_id").alias("right_id"), "wkt"), join.predicate, cell, srid)
            pairs = pairs.union(wide)
        found = spatial.first_match(pairs)
        name = _key(k, right)
        table = rows.join(found.select(F.col("point_id").alias("__row"), F.col("shape_id").alias(name)), "__row", "left").drop("__row")
    return table


def keyed(table: DataFrame) -> DataFrame:
    """``table`` with a stable key of its rows' contents."""
    return table.withColumn("__key", F.xxhash64(*(F.col(f"`{c}`") for c in table.columns)))


def build(gazetteer: config.Gazetteer, scanned: dict[str, DataFrame], cell: float | None = None) -> Built:
    """All sources of a configuration over the tables that were scanned for them."""
    by = {s.name: s for s in gazetteer.sources}
    tables, made, features, names = {}, {}, None, None
    for source in gazetteer.ordered():
        table = derive(scanned[source.name], source)
        tables[source.name] = table
        if source.select:
            held = dict(tables) | {source.name: located(table, source, tables, by, cell)}
            joins = []
            for k, join in enumerate(source.joins):
                left, right = join.left, join.right
                if join.kind == "spatial":
                    other = right.split(".")[0]
                    held[other] = keyed(tables[other])
                    left, right = f"{source.name}.{_key(k, other)}", f"{other}.__key"
                joins.append((join.method, left, right))
            made[source.name] = views.build(source.name, held, joins, list(source.select))
        if source.identifier:
            own, ident = f"{source.name}_view" if source.select else source.name, source.identifier[0].split(".")[1]
            rows = registration.features(table, own, ident)
            texts = registration.names(table, own, ident, [(n.split(".")[1], sep) for n, sep in source.names])
            features = rows if features is None else features.union(rows)
            names = texts if names is None else names.union(texts)
    return Built(tables, made, features, names)


class Store:
    """Installed gazetteers as Parquet folders on any file system, with a manifest written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.storage = spark, Storage(spark, root)

    def manifest(self, name: str) -> dict:
        """The manifest of an installed gazetteer; ``ValueError`` if it is not there or not complete."""
        if not self.storage.exists(f"{name}/manifest.json"):
            raise ValueError(f"gazetteer {name!r} is not installed")
        held = json.loads(self.storage.read(f"{name}/manifest.json"))
        if held.get("schema_version") != SCHEMA_VERSION:
            raise RuntimeError(f"gazetteer {name!r} has schema version {held.get('schema_version')}, not {SCHEMA_VERSION}: install it again")
        return held

    def read(self, name: str, table: str) -> DataFrame:
        self.manifest(name)
        return self.spark.read.parquet(self.storage.path(f"{name}/{table}"))

    def search(self, name: str, queries: DataFrame, method: str = "exact", limit: int = search.LIMIT, tiers: int = 1) -> DataFrame:
        """:func:`search.search` over an installed gazetteer, by its stored index."""
        return search.search(self.read(name, "names"), queries, method, limit, tiers, stored=self.index(name))

    def index(self, name: str) -> postings.Index:
        """The stored index of a gazetteer's names."""
        return postings.Index(*(self.read(name, t) for t in ("texts", "postings", "tokens", "statistics")))

    def _index(self, name: str, names: DataFrame) -> None:
        """Write the index of ``names``: texts by sound, postings and their statistics by token."""
        write = lambda rows, at: rows.write.mode("overwrite").parquet(self.storage.path(f"{name}/{at}"))
        write(search.index(names).repartition("code").sortWithinPartitions("code", "name"), "texts")
        texts = self.spark.read.parquet(self.storage.path(f"{name}/texts"))
        write(search.statistics(texts), "statistics")
        found, tokens = postings.build(texts)
        blocks = found.repartitionByRange("token", "shard").sortWithinPartitions("token", "shard", "block")
        blocks.write.option("parquet.bloom.filter.enabled#token", "true").mode("overwrite").parquet(self.storage.path(f"{name}/postings"))
        self._write(tokens, f"{name}/tokens", ["token"])

    def describe(self, name: str, source: str, columns: tuple | None = None) -> DataFrame:
        """``(feature_id, location_id, description)`` of a source's features; ``columns`` as in ``views.DESCRIBED``."""
        identifier = self.manifest(name)["identifiers"][source]
        features = self.read(name, "features").where(F.col("source") == f"{source}_view")
        return views.described(features, self.read(name, f"view/{config.safe_name(source)}"), identifier, columns or views.DESCRIBED[name])

    def _staged(self, source: config.Source, local: Path, name: str) -> str:
        """Where executors read a source's file: as it is on a local store, else a copy in the store."""
        if self.storage.root.startswith("file:"):
            return str(local)
        for own in sorted(local.parent.glob(f"{local.stem}.*")) if source.kind == "spatial" else [local]:
            self.storage.put(own, f"{name}/downloads/{own.name}")
        return self.storage.path(f"{name}/downloads/{local.name}")

    def _write(self, rows: DataFrame, at: str, indexed: list[str]) -> None:
        """Write a table; by its indexed columns it is sorted, with bloom filters, so that look-ups skip row groups."""
        writer = rows.write
        if indexed:
            writer = rows.repartitionByRange(*(F.col(f"`{c}`") for c in indexed[:1])).sortWithinPartitions(*(F.col(f"`{c}`") for c in indexed)).write
            for c in indexed:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.mode("overwrite").parquet(self.storage.path(at))

    def install(self, path: str | Path | config.Gazetteer, cell: float | None = None, keep_downloads: bool = False) -> dict:
        """Scan, build and write the gazetteer of a YAML file or a configuration; installs over an older one.

        Downloads and archives are unpacked on the driver, in a folder of its
        own, and copied into the store unless that is local.
        """
        gazetteer, base = (path, Path.cwd()) if isinstance(path, config.Gazetteer) else (config.load(path), Path(path).parent)
        name = gazetteer.name
        self.storage.delete(f"{name}/manifest.json")
        local = self.storage.root.startswith("file:")
        cache = Path(self.storage.root.removeprefix("file:")) / name / "downloads" if local else Path(tempfile.mkdtemp(prefix="placelink-downloads-"))
        scanned = {s.name: scan.scan(self.spark, s.path if s.path and _URI.match(s.path) else self._staged(s, acquire.resolve(s, base, cache), name), s) for s in gazetteer.sources}
        made = build(gazetteer, scanned, cell)
        by = {s.name: s for s in gazetteer.sources}
        for kind, held in (("table", made.tables), ("view", made.views)):
            for source, rows in held.items():
                wanted = [a.name for a in (*by[source].original, *by[source].derived) if a.index and not a.drop and a.type != "geometry"]
                self._write(rows, f"{name}/{kind}/{config.safe_name(source)}", [c for c in wanted if c in rows.columns])
        counts = {}
        if made.features is not None:
            self._write(made.features, f"{name}/features", ["location_id"])
            self._write(made.names, f"{name}/names", ["name"])
            names = self.spark.read.parquet(self.storage.path(f"{name}/names"))
            self._index(name, names)
            told = registration.counts(self.spark.read.parquet(self.storage.path(f"{name}/features")), names)
            counts = {r["source"]: [r["n_features"], r["n_names"]] for r in told.collect()}
        if not keep_downloads:
            self.storage.delete(f"{name}/downloads")
            shutil.rmtree(cache, ignore_errors=True)
        identifiers = {s.name: s.identifier[0].split(".")[1] for s in gazetteer.sources if s.identifier}
        manifest = {"name": name, "schema_version": SCHEMA_VERSION, "installed_at": datetime.now(timezone.utc).isoformat(), "counts": counts, "identifiers": identifiers}
        self.storage.write(f"{name}/manifest.json", json.dumps(manifest))
        return manifest
