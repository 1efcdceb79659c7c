"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear
between knots.  Its integral shares out the words; a target stops at ``MOST``
times its source's size and the excess is reshared by weight.  Within a source
documents follow each other in a hashed order, pass after pass; a document's
place in that stream is a cumulative demand, and the inverse of the integrated
schedule turns it into the training position by which documents are
range-sorted.

Words are counted in one scan.  All that follows works on rows of id, source,
size and a hash; texts are dealt out only where documents are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelink.llm.common import table

#: Times that a source's words may be taken.
MOST = 3
#: Schedules of the sources in their order, repeating, as knots of time and weight; their integrals are 1, 2 and 3.
SHAPES = [
    [(0.0, 0.0), (1.0, 2.0)],  # rising
    [(0.0, 4.0), (1.0, 0.0)],  # falling
    [(0.0, 0.0), (0.5, 6.0), (1.0, 0.0)],  # humped
]
#: Rows of a hash bucket aimed at when running sums are split.
BUCKET_ROWS = 4_096
#: Cells of training time for each range of positions.
FINE = 16
#: Rows up to which a table of decisions is broadcast: some 8 MB.
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integrated(knots: list[tuple[float, float]]) -> tuple[list[float], list[float], list[float]]:
    """Times, weights and integrals up to there of a schedule, over 0..1; it is constant before its first and after its last knot."""
    knots = sorted(knots)
    if not knots or knots[0][0] < 0 or knots[-1][0] > 1 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule needs knots at times 0 to 1 with weights that are not negative")
    knots = [*([(0.0, knots[0][1])] if knots[0][0] > 0 else []), *knots, *([(1.0, knots[-1][1])] if knots[-1][0] < 1 else [])]
    total = [0.0]
    for (a, x), (b, y) in zip(knots, knots[1:], strict=False):
        total.append(total[-1] + (b - a) * (x + y) / 2)
    return [t for t, _ in knots], [w for _, w in knots], total


def targets(sizes: DataFrame, schedules: dict[str | None, list[tuple[float, float]]] | None = None) -> DataFrame:
    """``(source, source_size, n, target, t, w, area)`` from ``(source, size)`` rows.

    Sources that ``schedules`` does not name have the ``SHAPES``, repeating, in
    code point order with null last.  ``t``, ``w`` and ``area`` are the knots of
    a source's schedule and its integral up to them; the whole integral is its
    weight, and a source without weight has target 0.  The water level by which
    capped sources are found needs one running sum over the sources only.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = per.withColumn("place", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(SHAPES))
    kind = "t array<double>, w array<double>, area array<double>"
    shapes = spark.createDataFrame([(k, *integrated(s)) for k, s in enumerate(SHAPES)], f"place int, {kind}")
    per = per.join(F.broadcast(shapes), "place").drop("place")
    if schedules:
        given = spark.createDataFrame([(s, integrated(k)) for s, k in schedules.items()], f"s string, own struct<{kind.replace(' ', ':').replace(',:', ',')}>")
        per = per.join(F.broadcast(given), per.source.eqNullSafe(given.s), "left").drop("s")
        per = per.select("source", "source_size", "n", *(F.coalesce(F.col(f"own.{c}"), F.col(c)).alias(c) for c in ("t", "w", "area")))
    per = per.withColumn("weight", F.element_at("area", -1))
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy())).withColumn("room", F.col("source_size") * MOST)
    share = F.try_divide(F.col("room").cast("double"), F.col("weight"))
    order = Window.orderBy(share.asc_nulls_last(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("room_before", F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn("weight_after", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("level", F.try_divide((F.col("total") - F.col("room_before")).cast("double"), F.col("weight_after"))).withColumn("full", F.coalesce(share < F.col("level"), F.lit(False)))
    # each level after the first that is not full is lower
    per = per.withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy()))
    target = F.when(F.col("full"), F.col("room").cast("double")).otherwise(F.coalesce(F.col("water") * F.col("weight"), F.lit(0.0)))
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), "n", target.alias("target"), "t", "w", "area")


def _keys(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What decisions are tied to: id, source and two hashes of the text."""
    text = F.col(f"`{text_col}`")
    return [F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y")]


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: dict | None = None) -> DataFrame:
    """What the mix does with every row of ``df``, without the text.

    Returns ``(id, source, x, y, size, source_size, target, times, taken,
    before, t, w, area)``: ``x`` and ``y`` are hashes of the text, ``times`` how
    often the document is taken, ``taken`` its words with repeats, ``before``
    the words of its source that precede it.  Rows follow in their source by
    the hash of their id (of their text without one), then id, size and text;
    rows equal in all are interchangeable.  A null text has size 0, a null
    source is a source of its own, an empty table gives none; other columns are
    ignored whatever their names.  Reruns agree.

    A running sum over a source that may hold a third of all rows is split by
    leading hash digits: sums of the buckets are summed up over the small table
    of buckets, and windows run within a bucket.
    """
    order = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    rows = table(df.select(*_keys(id_col, text_col, source_col), words(F.col(f"`{text_col}`")).alias("size"), order.alias("h")), "sizes")
    per = table(targets(rows.select("source", "size"), schedules), "targets")
    most = per.agg(F.max("n")).first()[0] or 0
    digits = 1
    while most > BUCKET_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    sums = sums.join(per, sums.source.eqNullSafe(per.source), "inner").drop(per.source)
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "size", "x", "y").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(sums, rows.source.eqNullSafe(sums.source) & (rows.bucket == sums.bucket), "inner").drop(sums.source, sums.bucket)
    joined = joined.withColumn("before", F.col("bucket_before") + F.col("inner"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")))).otherwise(F.lit(1)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    times = F.least(whole + F.when(F.col("before") + F.col("size") / 2 <= rest, 1).otherwise(0), F.lit(MOST)).cast("long")
    joined = joined.withColumn("times", times)
    return joined.select("id", "source", "x", "y", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"), "before", "t", "w", "area")


def position(place: Column) -> Column:
    """Training time at which the integrated schedule of a row of :func:`plan` has asked for ``place`` words.

    Between two knots the integral is a quadratic, whose root is taken.
    """
    area, at = F.col("area"), lambda name, k: F.element_at(F.col(name), k)
    share = F.coalesce(F.try_divide(place.cast("double"), F.col("target")), F.lit(0.0))
    asked = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.element_at(area, -1)
    k = F.least(F.greatest(F.size(F.filter(area, lambda c: c <= asked)), F.lit(1)), F.size(area) - 1)
    span, rest, first = at("t", k + 1) - at("t", k), asked - at("area", k), at("w", k)
    slope = F.coalesce(F.try_divide(at("w", k + 1) - first, span), F.lit(0.0))
    ahead = F.try_divide(2 * rest, first + F.sqrt(F.greatest(first * first + 2 * slope * rest, F.lit(0.0))))
    return at("t", k) + F.least(F.coalesce(ahead, F.lit(0.0)), span)


def schedule(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: dict | None = None) -> DataFrame:
    """``df`` as the mix takes it: a row for each time a document is taken, range-sorted by training position.

    Decisions are cut into ranges of about equal numbers of words by their own
    small table; documents meet them by id, source and text and are then dealt
    once, each to the partition of its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = plan(df, id_col, text_col, source_col, schedules).where("times > 0")
    same = Window.partitionBy("id", "source", "x", "y").orderBy("before")
    made = made.withColumn("copy", F.row_number().over(same))
    each = made.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    at = position(F.col("pass") * F.col("source_size") + F.col("before") + F.col("size") / 2)
    each = table(each.select("id", "source", "x", "y", "copy", "size", "pass", at.alias("at")), "positions")
    # rows that agree in the key are told apart only where there are any
    twice = table(each.where("copy > 1").select("id", "source", "x", "y").distinct(), "twice")
    told = ranged(each, n).groupBy("id", "source", "x", "y", "copy").agg(F.collect_list(F.struct("at", "part", "pass")).alias("takes"))
    told = table(told, "takes")
    names = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*names).alias("row"), *_keys(id_col, text_col, source_col))
    key = ["id", "source", "x", "y"]
    match = lambda a, b: a.id.eqNullSafe(b.id) & a.source.eqNullSafe(b.source) & (a.x == b.x) & (a.y == b.y)
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    if twice.isEmpty():
        rows = rows.withColumn("copy", F.lit(1))
    else:
        again = small(twice)
        several = rows.join(again, match(rows, again), "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.to_json("row"))))
        rows = rows.join(again, match(rows, again), "left_anti").withColumn("copy", F.lit(1)).union(several)
    takes = small(told)
    joined = rows.join(takes, match(rows, takes) & (rows.copy == takes.copy)).select("row", F.explode("takes").alias("take"))
    dealt = joined.select("row", "take.*").repartitionById(n, F.col("part")).sortWithinPartitions("at", "pass")
    return dealt.select("row.*")


def ranged(each: DataFrame, n: int) -> DataFrame:
    """``each(at)`` with ``part``: which of ``n`` ranges of positions of about equally many rows it is in.

    Counts of ``FINE * n`` cells of training time, a table of that many rows at
    most, tell where the ranges end; the rows of one cell stay together.
    """
    cell = F.least(F.floor(F.col("at") * (FINE * n)), F.lit(FINE * n - 1)).cast("int")
    rows = each.withColumn("cell", cell)
    counts = table(rows.groupBy("cell").agg(F.count("*").alias("c")), "cells")
    ahead = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(ahead), F.lit(0))
    parts = counts.select("cell", F.floor(before * n / F.sum("c").over(Window.partitionBy())).cast("int").alias("part"))
    return rows.join(F.broadcast(parts), "cell").drop("cell")


def summary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: dict | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, position)`` of every document.

    ``position`` is the first training position, null for a document that is
    not taken; rows come range-sorted by it.
    """
    made = plan(df, id_col, text_col, source_col, schedules)
    first = F.when((F.col("times") > 0) & (F.col("target") > 0), position(F.col("before") + F.col("size") / 2))
    told = made.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round(first, 9).alias("position"))
    return told.orderBy("position", "doc_id")
