"""Spatial joins: few shapes go to where points are read and meet them by quarters; others by an equi-join on the cells of a grid of several levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelink.functions import geo
from placelink.session import ship

PREDICATES = ("within", "intersects", "contains")


def _boxes(rows: DataFrame, wkt: str, srid: tuple[int, int] = (0, 0)) -> DataFrame:
    """``rows`` with ``_box`` (min x, min y, max x, max y), null without geometry; in another system if the two differ."""

    ship(rows.sparkSession)

    def box(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda w: geo.Shape(w).moved(*srid).box if isinstance(w, str) and w.strip() else None)

    return rows.withColumn("_box", F.pandas_udf(box, "array<double>")(F.col(wkt)))


def centroids(rows: DataFrame, wkt: str, x: str = "x", y: str = "y") -> DataFrame:
    """``rows`` with the coordinates of their geometries' centroids, null without geometry."""

    ship(rows.sparkSession)

    def middle(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda w: geo.Shape(w).centroid() if isinstance(w, str) and w.strip() else None)

    at = F.pandas_udf(middle, "array<double>")(F.col(wkt))
    return rows.withColumn("_at", at).withColumn(x, F.col("_at")[0]).withColumn(y, F.col("_at")[1]).drop("_at")


#: Pairs of a shape that are tested in one task.
SALT = 20_000


def cell_for(boxes: DataFrame) -> float:
    """A cell about as large as the middle one of ``boxes(_box)``; 1 without extent."""
    size = F.greatest(F.col("_box")[2] - F.col("_box")[0], F.col("_box")[3] - F.col("_box")[1])
    middle = boxes.where(size > 0).agg(F.percentile_approx(size, 0.5, 1_000)).first()[0]
    return float(middle) if middle else 1.0


def _level(cell: float):
    """The least level at which a box is no larger than a cell; each level's cells are twice as large."""
    size = F.greatest(F.col("_box")[2] - F.col("_box")[0], F.col("_box")[3] - F.col("_box")[1])
    return F.when(size > cell, F.ceil(F.log2(size / cell))).otherwise(0).cast("int")


def _spread(rows: DataFrame, levels: list[int], cell: float) -> DataFrame:
    """``rows(_box, _own)`` at their own and all higher ``levels``, once for each cell there that the box touches."""
    at = F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col("_own"))
    rows = rows.withColumn("_level", F.explode(at)).withColumn("_size", F.pow(F.lit(2.0), F.col("_level")) * cell)
    span = lambda a, b: F.sequence(F.floor(F.col("_box")[a] / F.col("_size")), F.floor(F.col("_box")[b] / F.col("_size")))
    return rows.withColumn("_cx", F.explode(span(0, 2))).withColumn("_cy", F.explode(span(1, 3)))


def candidates(left: DataFrame, right: DataFrame, cell: float | None = None) -> DataFrame:
    """``(left_id, right_id)``: pairs of ``left(left_id, _box)`` and ``right(right_id, _box)`` whose boxes meet, each once.

    Every box stands on the level of a grid on which it touches four cells at
    most, and on the higher levels, and two boxes meet on the higher of their
    own levels.  So neither small nor huge shapes are laid over many cells,
    whatever the unit of their coordinates.
    """
    cell = cell or cell_for(right)
    left, right = (rows.withColumn("_own", _level(cell)) for rows in (left, right))
    levels = sorted(r["_own"] for r in left.select("_own").union(right.select("_own")).distinct().collect())  # some dozens at most
    if not levels:
        levels = [0]
    a = _spread(left, levels, cell).select("left_id", F.col("_box").alias("_a"), F.col("_own").alias("_la"), "_level", "_size", "_cx", "_cy")
    b = _spread(right, levels, cell).select("right_id", F.col("_box").alias("_b"), F.col("_own").alias("_lb"), "_level", "_cx", "_cy")
    found = a.join(b, ["_level", "_cx", "_cy"]).where(F.col("_level") == F.greatest("_la", "_lb"))
    A, B = F.col("_a"), F.col("_b")
    found = found.where((A[0] <= B[2]) & (A[2] >= B[0]) & (A[1] <= B[3]) & (A[3] >= B[1]))
    # a pair counts in the cell of the lower left corner that the boxes have in common
    here = (F.col("_cx") == F.floor(F.greatest(A[0], B[0]) / F.col("_size"))) & (F.col("_cy") == F.floor(F.greatest(A[1], B[1]) / F.col("_size")))
    return found.where(here).select("left_id", "right_id")


def _tested(pairs: DataFrame, left: DataFrame, right: DataFrame, test, key: list[str]) -> DataFrame:
    """Pairs for which ``test`` holds; a right shape goes along once for ``SALT`` of its pairs.

    ``left(left_id, ...)`` brings the columns in ``key`` to each pair,
    ``right(right_id, wkt)`` the shape.  ``test(shape, columns)`` is given a
    parsed shape and the columns of some of its pairs.
    """
    counts = pairs.groupBy("right_id").agg(F.ceil(F.count("*") / SALT).cast("int").alias("_salts"))
    own = pairs.join(counts, "right_id").withColumn("_salt", F.pmod(F.xxhash64("left_id"), F.col("_salts")).cast("int")).join(left.select("left_id", *key), "left_id")
    shapes = right.join(counts, "right_id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    kinds = dict(left.dtypes) | dict(right.dtypes)
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows = shapes.select("right_id", "_salt", F.col("wkt").alias("_shape"), none("left_id"), *(none(c) for c in key))
    rows = rows.union(own.select("right_id", "_salt", F.lit(None).cast("string"), "left_id", *key))
    dealt = rows.repartition("right_id", "_salt").sortWithinPartitions("right_id", "_salt", F.col("_shape").desc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shape = None, None
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            group = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            starts = [k for k in range(len(group)) if not k or group[k] != group[k - 1]]
            for i, j in zip(starts, [*starts[1:], len(group)], strict=True):
                if group[i] != at:
                    at, shape = group[i], geo.Shape(batch.column(2)[i].as_py())
                    i += 1
                if j > i:
                    kept[i:j] = test(shape, [batch.column(k).slice(i, j - i).to_numpy(zero_copy_only=False) for k in range(4, 4 + len(key))])
            both = batch.select([3, 0]).filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays(both.columns, ["left_id", "right_id"])

    return dealt.mapInArrow(run, f"left_id {kinds['left_id']}, right_id {kinds['right_id']}")


#: Shapes, and code points of their texts, up to which all are sent to the tasks that read points.
FEW, FEW_TEXT = 10_000, 8 << 20
#: Shapes or points of a quarter that are compared without cutting it again, and how often it is cut at most.
LEAF, DEEP = 8, 12


def quartered(shapes: list[geo.Shape], x: np.ndarray, y: np.ndarray, boundary: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(points, shapes)``: places of all pairs of a point and a shape that holds it.

    Points and the boxes of shapes are cut into quarters together, until few of
    either are left; a point falls into one quarter, a box into all it touches.
    """
    boxes = np.array([s.box or (np.inf, np.inf, -np.inf, -np.inf) for s in shapes]).reshape(-1, 4)
    found: list[tuple[np.ndarray, int]] = []
    waiting = [(np.arange(len(x)), np.flatnonzero(boxes[:, 0] <= boxes[:, 2]), 0)]
    while waiting:
        at, own, deep = waiting.pop()
        if not len(at) or not len(own):
            continue
        if len(own) > LEAF < len(at) and deep < DEEP:
            cx, cy = np.median(x[at]), np.median(y[at])
            left, low = x[at] < cx, y[at] < cy
            parts = []
            for west in (True, False):
                for south in (True, False):
                    touched = (boxes[own, 0] < cx if west else boxes[own, 2] >= cx) & (boxes[own, 1] < cy if south else boxes[own, 3] >= cy)
                    parts.append((at[(left == west) & (low == south)], own[touched], deep + 1))
            if max(len(p[1]) for p in parts) < len(own) or max(len(p[0]) for p in parts) < len(at):
                waiting += parts
                continue
        for k in own.tolist():
            a, b, c, d = boxes[k]
            near = at[(x[at] >= a) & (x[at] <= c) & (y[at] >= b) & (y[at] <= d)]
            if len(near):
                near = near[shapes[k].holds(x[near], y[near], boundary)]
                found.append((near, k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([n for n, _ in found]), np.repeat([k for _, k in found], [len(n) for n, _ in found])


def _among_few(points: DataFrame, shapes: DataFrame, boundary: bool) -> DataFrame | None:
    """Pairs of ``points(left_id, x, y)`` and ``shapes(right_id, wkt)`` where all shapes may go to each task; else None."""
    count, text = shapes.agg(F.count("*"), F.coalesce(F.sum(F.length("wkt")), F.lit(0))).first()
    if count > FEW or text > FEW_TEXT:
        return None
    ship(points.sparkSession)
    held = [tuple(r) for r in shapes.collect()]
    kinds = dict(points.dtypes)["left_id"], dict(shapes.dtypes)["right_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed, ids = [geo.Shape(w) for _, w in held], [i for i, _ in held]
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2))
            at, which = quartered(parsed, x, y, boundary)
            yield pa.RecordBatch.from_pydict({"left_id": batch.column(0).take(pa.array(at)), "right_id": [ids[k] for k in which.tolist()]})

    return points.select("left_id", "x", "y").mapInArrow(run, f"left_id {kinds[0]}, right_id {kinds[1]}")


def points_in_shapes(points: DataFrame, shapes: DataFrame, cell: float | None = None, boundary: bool = False, srid: tuple[int, int] | None = None) -> DataFrame:
    """``(point_id, shape_id)``: all pairs of ``points(point_id, x, y)`` within ``shapes(shape_id, wkt)``.

    ``srid`` is (shapes, points): points are turned into the shapes' system
    first if the two differ.  Null points match nothing.  ``cell`` is the size
    of the finest grid cells; without it the shapes' boxes tell.
    """
    px, py = F.col("x"), F.col("y")
    if srid and srid[0] != srid[1]:
        px, py = geo.transform(px, py, srid[1], srid[0])
    asked = shapes.select(F.col("shape_id").alias("right_id"), "wkt").where(F.trim("wkt") != "")
    spots = points.select(F.col("point_id").alias("left_id"), px.alias("x"), py.alias("y")).where("x is not null and y is not null")
    few = _among_few(spots, asked, boundary)
    if few is not None:
        return few.select(F.col("left_id").alias("point_id"), F.col("right_id").alias("shape_id"))
    held = _boxes(asked, "wkt").where("_box is not null")
    pairs = candidates(spots.withColumn("_box", F.array("x", "y", "x", "y")), held, cell)
    found = _tested(pairs, spots, held.select("right_id", "wkt"), lambda shape, c: shape.holds(c[0].astype(float), c[1].astype(float), boundary), ["x", "y"])
    return found.select(F.col("left_id").alias("point_id"), F.col("right_id").alias("shape_id"))


def shapes_in_shapes(left: DataFrame, right: DataFrame, predicate: str = "within", cell: float | None = None, srid: tuple[int, int] | None = None) -> DataFrame:
    """``(left_id, right_id)``: all pairs of ``left(left_id, wkt)`` and ``right(right_id, wkt)`` of any kinds.

    The left one is within, intersects or contains the right one.  ``srid`` is
    (right, left): left shapes are turned into the right ones' system first if
    the two differ, corner by corner.  Null and empty geometries match nothing.
    """
    if predicate not in PREDICATES:
        raise ValueError(f"unknown spatial predicate {predicate!r}")
    there, here = srid or (0, 0)
    a = _boxes(left.select("left_id", "wkt"), "wkt", (here, there)).where("_box is not null")
    b = _boxes(right.select("right_id", "wkt"), "wkt").where("_box is not null")
    relation = {"within": lambda one, two: one.lies_in(two), "contains": lambda one, two: two.lies_in(one), "intersects": lambda one, two: one.meets(two)}[predicate]
    test = lambda shape, c: [relation(geo.Shape(w).moved(here, there), shape) for w in c[0]]
    return _tested(candidates(a, b, cell), a.select("left_id", F.col("wkt").alias("_own")), b.select("right_id", "wkt"), test, ["_own"])


def first_match(pairs: DataFrame) -> DataFrame:
    """The match of least shape id of each point."""
    return pairs.groupBy("point_id").agg(F.min("shape_id").alias("shape_id"))


def join_first(points: DataFrame, shapes: DataFrame, predicate: str = "within", cell: float | None = None, srid: tuple[int, int] | None = None) -> DataFrame:
    """Each point with its first shape, or null: a left join on the spatial key."""
    if predicate not in PREDICATES:
        raise ValueError(f"unknown spatial predicate {predicate!r}")
    if predicate == "contains":  # a point contains only an equal point
        shapes = shapes.where(F.upper(F.trim("wkt")).startswith("POINT"))
    found = first_match(points_in_shapes(points, shapes, cell, boundary=predicate != "within", srid=srid))
    return points.join(found, "point_id", "left")


def nearest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row by ``order`` of each key."""
    first = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
