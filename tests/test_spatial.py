import numpy as np
import pytest
from pyspark.sql import functions as F

from placelink.functions import geo
from placelink.operators import spatial


def test_centroids():
    assert geo.Shape("POLYGON((0 0,2 0,2 2,0 2,0 0))").centroid() == (1, 1)
    assert geo.Shape("LINESTRING (0 0, 2 0)").centroid() == (1, 0)
    assert geo.Shape("MULTIPOINT (0 0, 4 2)").centroid() == (2, 1)
    assert geo.Shape("POINT EMPTY").centroid() is None


def test_boundary_and_holes():
    shape = geo.Shape("POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))")
    x, y = np.array([3.0, 1.5, 0.0, 4.0, 5.0]), np.array([3.0, 1.5, 2.0, 4.0, 5.0])
    assert shape.holds(x, y).tolist() == [True, False, False, False, False]
    assert shape.holds(x, y, boundary=True).tolist() == [True, False, True, True, False]


@pytest.mark.parametrize("few", [0, 10_000])
def test_joins_equal_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW", few)
    rng = np.random.default_rng(3)
    points = [(k, *map(float, rng.uniform(-5, 5, 2))) for k in range(300)] + [(999, None, 1.0)]
    shapes = []
    for k in range(25):
        a, b = rng.uniform(-5, 4, 2)
        shapes.append((k, f"POLYGON(({a} {b}, {a + 1.7} {b + 0.1}, {a + 1.2} {b + 2.3}, {a} {b}))"))
    p = spark.createDataFrame(points, "point_id long, x double, y double")
    s = spark.createDataFrame([*shapes, (77, None)], "shape_id long, wkt string")
    got = {tuple(r) for r in spatial.points_in_shapes(p, s, 0.8).collect()}
    want = {(i, k) for k, w in shapes for i, x, y in points[:-1] if geo.Shape(w).holds(np.array([x]), np.array([y]))[0]}
    assert got == want and want
    first = {r.point_id: r.shape_id for r in spatial.join_first(p, s, cell=0.8).collect()}
    assert first == {i: min((k for j, k in want if j == i), default=None) for i, _, _ in points}


BOXES = lambda a, b, w, h: f"POLYGON(({a} {b},{a + w} {b},{a + w} {b + h},{a} {b + h},{a} {b}))"


@pytest.mark.parametrize("a,b,meets,within", [
    (BOXES(0, 0, 1, 1), BOXES(0, 0, 4, 4), True, True), (BOXES(0, 0, 4, 4), BOXES(0, 0, 4, 4), True, True), (BOXES(3, 3, 2, 2), BOXES(0, 0, 4, 4), True, False),
    (BOXES(4, 0, 1, 1), BOXES(0, 0, 4, 4), True, False), (BOXES(9, 9, 1, 1), BOXES(0, 0, 4, 4), False, False), (BOXES(1, -1, 1, 6), BOXES(0, 0, 4, 4), True, False),
    ("LINESTRING(1 1, 3 3)", BOXES(0, 0, 4, 4), True, True), ("LINESTRING(0 0, 4 0)", BOXES(0, 0, 4, 4), True, False), ("LINESTRING(-1 2, 9 2)", BOXES(0, 0, 4, 4), True, False),
    ("LINESTRING(1 1, 2 2)", "LINESTRING(0 0, 4 4)", True, True), ("LINESTRING(0 4, 4 0)", "LINESTRING(0 0, 4 4)", True, False), ("POINT(1 1)", "POINT(1 1)", True, True),
    (BOXES(1.2, 1.2, 0.2, 0.2), "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))", False, False), (BOXES(0.5, 0.5, 3, 3), "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))", True, False),
    (BOXES(0, 0, 4, 4), "POINT(2 2)", True, False), ("POINT(0 2)", BOXES(0, 0, 4, 4), True, False), ("POINT EMPTY", BOXES(0, 0, 4, 4), False, False),
])
def test_relations(a, b, meets, within):
    one, two = geo.Shape(a), geo.Shape(b)
    assert (one.meets(two), two.meets(one), one.lies_in(two)) == (meets, meets, within)


@pytest.mark.parametrize("predicate", spatial.PREDICATES)
@pytest.mark.parametrize("unit", [1.0, 1e5])
def test_joins_of_areas_equal_all_pairs(spark, predicate, unit):
    rng = np.random.default_rng(6)
    areas = lambda n, scale: [(k, BOXES(*(unit * rng.uniform(0, 10, 2)), *(unit * scale * rng.lognormal(0, 1.2, 2)))) for k in range(n)]
    left, right = areas(60, 0.3), areas(40, 0.8)
    left += [(100, f"LINESTRING({unit} {unit}, {5 * unit} {6 * unit})"), (101, None), (102, f"POINT({3 * unit} {3 * unit})")]
    right += [(200, BOXES(-100 * unit, -100 * unit, 1_000 * unit, 1_000 * unit)), (201, "")]
    relation = {"within": lambda a, b: a.lies_in(b), "contains": lambda a, b: b.lies_in(a), "intersects": lambda a, b: a.meets(b)}[predicate]
    want = {(i, k) for i, a in left if a for k, b in right if b and relation(geo.Shape(a), geo.Shape(b))}
    df = spatial.shapes_in_shapes(spark.createDataFrame(left, "left_id long, wkt string"), spark.createDataFrame(right, "right_id long, wkt string"), predicate)
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want) and (want or predicate == "contains")


def test_cells_follow_the_shapes(spark):
    """Ten kilometres in metres beside a country: few cells each."""
    shapes = spark.createDataFrame([(1, BOXES(2_600_000, 1_200_000, 10_000, 10_000)), (2, BOXES(2_400_000, 1_000_000, 400_000, 300_000))], "shape_id long, wkt string")
    points = spark.createDataFrame([(1, 2_605_000.0, 1_205_000.0), (2, 2_500_000.0, 1_100_000.0), (3, 0.0, 0.0)], "point_id long, x double, y double")
    assert {tuple(r) for r in spatial.points_in_shapes(points, shapes).collect()} == {(1, 1), (1, 2), (2, 2)}


def test_web_and_older_swiss_metres(spark):
    x, y = geo.transform(np.array([7.4386]), np.array([46.9511]), 4326, 3857)
    assert abs(x[0] - 828_061.2) < 1 and abs(y[0] - 5_934_115) < 20
    lon, lat = spark.range(1).select(*geo.transform(F.lit(float(x[0])), F.lit(float(y[0])), 3857, 4326)).first()
    assert abs(lon - 7.4386) < 1e-9 and abs(lat - 46.9511) < 1e-9
    assert geo.transform(600_000.0, 200_000.0, 21781, 2056) == pytest.approx((2_600_000, 1_200_000), abs=1.5)
    assert geo.Shape(BOXES(2_600_000, 1_200_000, 10, 10)).moved(2056, 4326).box[0] == pytest.approx(7.438632, abs=1e-5)


def test_crs(spark):
    df = spark.createDataFrame([(2_600_000.0, 1_200_000.0)], "e double, n double")
    lon, lat = df.select(*geo.transform(F.col("e"), F.col("n"), 2056, 4326)).first()
    assert abs(lon - 7.438632) < 1e-5 and abs(lat - 46.951083) < 1e-5
    east, north = df.select(*geo.transform(F.lit(lon), F.lit(lat), 4326, 2056)).first()
    assert abs(east - 2_600_000) < 1.5 and abs(north - 1_200_000) < 1.5
    with pytest.raises(ValueError):
        geo.transform(F.col("e"), F.col("n"), 1, 2)


def test_quarters_find_what_all_pairs_find():
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 60, 3_000) / 4, rng.integers(0, 60, 3_000) / 4
    shapes = [geo.Shape("POINT EMPTY"), geo.Shape("POINT(3 3)"), geo.Shape("LINESTRING(0 0,15 15)")]
    for _ in range(60):
        a, b = rng.integers(0, 50, 2) / 4
        w, h = rng.integers(1, 30, 2) / 4
        shapes.append(geo.Shape(f"POLYGON(({a} {b},{a + w} {b},{a + w} {b + h},{a} {b}))"))
    for boundary in (True, False):
        at, which = spatial.quartered(shapes, x, y, boundary)
        got = set(zip(at.tolist(), which.tolist(), strict=True))
        want = {(int(p), k) for k, s in enumerate(shapes) if s.rings for p in np.flatnonzero(s.holds(x, y, boundary))}
        assert got == want and len(at) == len(got)
    same = spatial.quartered([shapes[5]] * 30, np.full(50, 1.0), np.full(50, 1.0), True)
    assert len(same[0]) in (0, 1_500)
    assert all(len(a) == 0 for a in spatial.quartered([], x, y, True))
