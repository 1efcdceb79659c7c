"""Views: projections with aliases over chained attribute joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelink.functions import text as T

#: Join words of a configuration, as Spark's join types.
METHODS = {"join": "inner", "inner join": "inner", "left join": "left", "left outer join": "left", "right join": "right", "right outer join": "right", "full join": "full", "full outer join": "full", "cross join": "cross"}


def method(words: str) -> str:
    """Spark's join type for free join words such as ``LEFT  JOIN``."""
    key = re.sub(r"\s+", " ", words.strip().lower())
    if key not in METHODS:
        raise ValueError(f"unknown join method {words!r}")
    return METHODS[key]


def build(base: str, tables: dict[str, DataFrame], joins: list[tuple[str, str, str]], select: list[tuple[str, str | None]]) -> DataFrame:
    """A view over ``tables[base]``.

    ``joins`` are (words, left column, right column) with ``source.column``
    references; the left one may be of any source already joined.  ``select``
    are (reference, alias).  Null keys do not match.  Only columns that are
    selected or joined on are read; Spark picks broadcast joins by size.
    """
    used = {ref for ref, _ in select} | {r for _, left, right in joins for r in (left, right)}
    name = lambda ref: ref.replace(".", "\x1f")  # noqa: E731  a separator that no column has

    def renamed(source: str) -> DataFrame:
        own = sorted(r for r in used if r.split(".", 1)[0] == source)
        return tables[source].select(*(F.col(f"`{r.split('.', 1)[1]}`").alias(name(r)) for r in own))

    view = renamed(base)
    for words, left, right in joins:
        other = renamed(right.split(".", 1)[0])
        how = method(words)
        view = view.crossJoin(other) if how == "cross" else view.join(other, F.col(f"`{name(left)}`") == F.col(f"`{name(right)}`"), how)
    return view.select(*(F.col(f"`{name(ref)}`").alias(alias or ref.split(".", 1)[1]) for ref, alias in select))


def attributes(features: DataFrame, view: DataFrame, identifier: str) -> DataFrame:
    """A feature's attributes: its row of the view without the geometry.

    Identifiers are compared as text, whatever their type in the view.
    """
    rows = view.drop("geometry")
    return features.join(rows, features.location_id == rows[f"`{identifier}`"].cast("string"), "left")


def matching(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows whose attributes equal all filters as text; empty filters do not count, null counts as ''."""
    for column, value in filters.items():
        if value not in (None, ""):
            rows = rows.where(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")) == F.lit(str(value)))
    return rows


def facets(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``(group, attribute, values)``: sorted distinct values that are not empty."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)))
    each = rows.select(group, pairs.alias("p")).select(group, "p.*").where("value is not null and value <> ''")
    return each.groupBy(group, "attribute").agg(F.array_sort(F.collect_set("value")).alias("values"))


def with_names(features: DataFrame, names: DataFrame) -> DataFrame:
    """Features with their sorted names; an empty list without any."""
    listed = names.groupBy("feature_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return features.join(listed, "feature_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def geometries(features: DataFrame, view: DataFrame, identifier: str) -> DataFrame:
    """``features`` with the ``geometry`` of their rows of the view, as WKT; null without one.

    Parse it with ``geo.Shape`` where it is needed.
    """
    held = view.select(F.col(f"`{identifier}`").cast("string").alias("_id"), "geometry") if "geometry" in view.columns else view.select(F.col(f"`{identifier}`").cast("string").alias("_id"), F.lit(None).cast("string").alias("geometry"))
    return features.join(held, features.location_id == held._id, "left").drop("_id")


#: Which columns of a view describe a feature: name, kind, and what it lies in, widest first.
DESCRIBED = {
    "geonames": ("name", "feature_name", ("country_name", "admin1_name", "admin2_name")),
    "geonames-cities": ("name", "feature_name", ("country_name", "admin1_name", "admin2_name")),
    "swissnames3d": ("NAME", "OBJEKTART", ("KANTON_NAME", "BEZIRK_NAME", "GEMEINDE_NAME")),
}


def described(features: DataFrame, view: DataFrame, identifier: str, columns: tuple[str, str, tuple[str, ...]]) -> DataFrame:
    """``(feature_id, location_id, description)`` of features by the columns that describe them."""
    name, kind, levels = columns
    held = view.select(F.col(f"`{identifier}`").cast("string").alias("_id"), T.description(F.col(f"`{name}`"), F.col(f"`{kind}`"), [F.col(f"`{c}`") for c in levels]).alias("description"))
    return features.select("feature_id", "location_id").join(held, features.location_id == held._id).select("feature_id", "location_id", "description")
