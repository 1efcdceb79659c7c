import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from placelink.__main__ import builtin
from placelink.operators import views
from placelink.plans import dependency, dialect, install
from placelink.plans.install import Store
from placelink.sources import acquire, config, scan


def base(**changes):
    source = {"name": "towns", "path": "towns.txt", "file": "towns.txt", "kind": "tabular", "separator": "\t", "attributes": {"original": [{"name": "id", "type": "integer"}, {"name": "name", "type": "text"}]}} | changes
    return {"name": "g-1", "sources": [source]}


@pytest.mark.parametrize("changes,word", [
    ({"separator": None}, "separator"), ({"url": "http://x/y"}, "either"), ({"kind": "raster"}, "kind"), ({"kind": "spatial"}, "separator"),
    ({"attributes": {"original": [{"name": "id", "type": "number"}]}}, "type"), ({"attributes": {"original": [{"name": "p", "type": "geometry", "srid": 1}]}}, "geometry"),
    ({"attributes": {"original": [{"name": "geometry", "type": "geometry"}]}}, "srid"), ({"view": {"select": [{"column": "other.x"}]}}, "unknown source"),
    ({"features": {"identifier": [{"column": "x.id"}], "names": []}}, "own columns"), ({"view": {"select": [{"column": "plain"}]}}, "form"),
])
def test_wrong_configurations(changes, word):
    with pytest.raises(ValueError, match=word):
        config.parse(base(**changes))
    with pytest.raises(ValueError):
        config.parse(base() | {"name": "a b"})


def test_order():
    assert dependency.order({"c": {"a"}, "a": set(), "b": {"b"}, "d": {"c", "b"}}) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="cycle"):
        dependency.order({"a": {"b"}, "b": {"a"}})


@pytest.mark.parametrize("expression,want", [
    ("iif(length(name) > 4, rtrim(substr(name, 1, 5)), upper(name))", "Bern"), ("substr(name, -3, 1) || '.' || code", "o.NA"),
    ("CASE WHEN code GLOB '[A-Z][A-Z]' THEN 'y' ELSE 'n' END", "y"), ("code GLOB 'n*'", False), ("name GLOB '*(*o?)'", True), ("CAST(n AS TEXT)", "7"), ("'it''s ' || \"code\"", "it's NA"), ("NULL || code", None),
])
def test_dialect(spark, expression, want):
    df = spark.createDataFrame([("Bern (foo)", "NA", 7)], "name string, code string, n int")
    assert df.select(F.expr(dialect.translate(expression, df.columns))).first()[0] == want


def test_dialect_refuses_unknown_functions():
    with pytest.raises(ValueError, match="load_extension"):
        dialect.translate("load_extension('x')")


def _shapefile(folder, rings, names):
    def record(n, ring):
        xs, ys = zip(*ring, strict=True)
        body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        return struct.pack(">2i", n, len(body) // 2) + body

    (folder / "areas.shp").write_bytes(b"\0" * 100 + b"".join(record(k + 1, r) for k, r in enumerate(rings)))
    head = bytes([3, 0, 0, 0]) + struct.pack("<IHH", len(names), 65, 11) + b"\0" * 20
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15
    (folder / "areas.dbf").write_bytes(head + field + b"\r" + b"".join(b" " + n.encode().ljust(10) for n in names))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "towns.txt").write_text("skip me\n1\tBern (Bundesstadt)\tA, Berne ,,B\t46.9\t7.4\tBE\n2\tZug\t\t47.1\t8.5\tNA\n3\tNirgends\tX\t0\t0\t\n")
    with zipfile.ZipFile(tmp_path / "codes.zip", "w") as z:
        z.writestr("deep/codes.txt", "BE;Bern canton\nZG;Zug canton\n")
    _shapefile(tmp_path, [[(7, 46), (7, 48), (8, 48), (8, 46), (7, 46)], [(8, 46), (8, 48), (9, 48), (9, 46), (8, 46)]], ["west", "east"])
    ref = lambda c: {"column": c}
    towns = {
        "name": "towns", "path": "towns.txt", "file": "towns.txt", "kind": "tabular", "separator": "\t", "skiprows": 1,
        "attributes": {
            "original": [{"name": n, "type": t} for n, t in (("id", "integer"), ("name", "text"), ("alt", "text"), ("lat", "real"), ("lon", "real"), ("code", "text"))],
            "derived": [{"name": "short", "type": "text", "expression": "rtrim(replace(name, '(Bundesstadt)', ''))"}, {"name": "geometry", "type": "geometry", "srid": 4326, "expression": "'POINT(' || lon || ' ' || lat || ')'"}],
        },
        "view": {
            "select": [ref("towns.id"), ref("towns.short"), ref("codes.label") | {"alias": "canton"}, ref("areas.NAME") | {"alias": "area"}, ref("towns.geometry")],
            "join": [
                {"method": "left join", "condition": {"type": "attribute", "predicate": "equals", "left": ref("towns.code"), "right": ref("codes.code")}},
                {"method": "left join", "condition": {"type": "spatial", "predicate": "within", "left": ref("towns.geometry"), "right": ref("areas.geometry")}},
            ],
        },
        "features": {"identifier": [ref("towns.id")], "names": [ref("towns.name"), ref("towns.short"), ref("towns.alt") | {"separator": ","}]},
    }
    codes = {"name": "codes", "path": "codes.zip", "file": "codes.txt", "kind": "tabular", "separator": ";", "attributes": {"original": [{"name": "code", "type": "text"}, {"name": "label", "type": "text"}]}}
    areas = {"name": "areas", "path": "areas.shp", "file": "areas.shp", "kind": "spatial", "attributes": {"original": [{"name": "NAME", "type": "text"}, {"name": "geometry", "type": "geometry", "srid": 4326}]}}
    (tmp_path / "g.yaml").write_text(json.dumps({"name": "small", "sources": [towns, codes, areas]}))
    return tmp_path


def test_install(spark, folder):
    store = Store(spark, str(folder / "store"))
    with pytest.raises(ValueError, match="not installed"):
        store.read("small", "names")
    first = store.install(folder / "g.yaml")
    view = {r.id: (r.short, r.canton, r.area) for r in store.read("small", "view/towns").collect()}
    assert view == {1: ("Bern", "Bern canton", "west"), 2: ("Zug", None, "east"), 3: ("Nirgends", None, None)}
    names = {r.name for r in store.read("small", "names").collect()}
    assert names == {"Bern (Bundesstadt)", "Bern", "A", "Berne", "B", "Zug", "Nirgends", "X"}
    assert first["counts"] == {"towns_view": [3, 8]}
    asked = spark.createDataFrame([("q", "Berne")], "qid string, query string")
    assert store.search("small", asked, "exact").count() == 1
    told = {r.description for r in store.describe("small", "towns", ("short", "canton", ("area",))).collect()}
    assert told == {"Bern (Bern canton) in west", "Zug in east", "Nirgends"}
    held = views.geometries(store.read("small", "features"), store.read("small", "view/towns"), "id")
    assert {r.geometry for r in held.collect()} == {"POINT(7.4 46.9)", "POINT(8.5 47.1)", "POINT(0.0 0.0)"}
    assert store.install(folder / "g.yaml")["counts"] == first["counts"]


def test_geojson_and_files(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "x", "k": 3}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}]}))
    row = scan.geojson(spark, str(tmp_path / "a.geojson")).first()
    assert row.geometry == "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))" and {row.n, row.k} == {"x", "3"}
    with pytest.raises(FileNotFoundError):
        acquire.locate(tmp_path, "b.txt")


def test_geojson_has_the_properties_of_all_features(spark, tmp_path):
    feature = lambda props: {"type": "Feature", "properties": props, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    held = [feature({"n": "x"}), feature(None), feature({"n": "y", "k": 3}), feature({"k": 4, "late": "z"})]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": held}))
    rows = scan.geojson(spark, str(tmp_path / "b.geojson"))
    assert set(rows.columns[1:]) == {"n", "k", "late"} and rows.columns[1] == "n"
    assert sorted((r.n or "", r.k or "", r.late or "") for r in rows.collect()) == [("", "", ""), ("", "4", "z"), ("x", "", ""), ("y", "3", "")]



def _index(folder):
    """A ``.shx`` file for the shapefile of the fixture."""
    data, at, spots = (folder / "areas.shp").read_bytes(), 100, []
    while at < len(data):
        words = struct.unpack_from(">i", data, at + 4)[0]
        spots.append(struct.pack(">2i", at // 2, words))
        at += 8 + 2 * words
    (folder / "areas.shx").write_bytes(b"\0" * 100 + b"".join(spots))


def test_shapefile_by_ranges(spark, tmp_path, monkeypatch):
    rings = [[(k, 0), (k, 1), (k + 1, 1), (k + 1, 0), (k, 0)][: 5 if k % 2 else 5] for k in range(7)]
    _shapefile(tmp_path, rings, [f"n{k}" for k in range(7)])
    want = [tuple(r) for r in scan.shapefile(spark, str(tmp_path / "areas.shp")).collect()]
    assert [r[1] for r in want] == [f"n{k}" for k in range(7)] and want[3][0] == "POLYGON ((3.0 0.0, 3.0 1.0, 4.0 1.0, 4.0 0.0, 3.0 0.0))"
    _index(tmp_path)
    monkeypatch.setattr(scan, "RECORDS", 3)
    assert sorted(tuple(r) for r in scan.shapefile(spark, str(tmp_path / "areas.shp")).collect()) == sorted(want)


def test_first_lines_are_left_out_of_every_file(spark, tmp_path):
    source = config.parse(base(skiprows=2, separator=";"))
    (tmp_path / "t.txt").write_text("# a;b\n\n" + "".join(f"{k};n{k}\n" for k in range(5_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = scan.tabular(spark, str(tmp_path / "t.txt"), source.sources[0]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.id, r.name) for r in rows) == [(k, f"n{k}") for k in range(5_000)]


@pytest.mark.parametrize("store", ["disk", "content"])
def test_geopackage(spark, tmp_path, monkeypatch, store):
    path = tmp_path / "a b.gpkg"
    line = struct.pack("<BII6d", 1, 1002, 2, 0, 0, 9, 1, 2, 9)  # with heights
    shapes = [struct.pack("<BI2d", 1, 1, 7.5, 46.5), line, struct.pack(">BIII8d", 0, 3, 1, 4, 0, 0, 0, 2, 2, 2, 0, 0), struct.pack("<BII", 1, 6, 1) + struct.pack("<BIII8d", 1, 3, 1, 4, 0, 0, 0, 2, 2, 2, 0, 0), None]
    head = b"GP\0\1" + struct.pack("<i", 4326)
    boxed = b"GP\0\3" + struct.pack("<i4d", 4326, 0, 1, 0, 1)
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_geometry_columns values ('places', 'geom')")
        db.execute("create table places (fid integer primary key, geom blob, name text, n integer)")
        db.executemany("insert into places values (?, ?, ?, ?)", [(3 * k, s and (boxed if k % 2 else head) + s, f"p{k}", k or None) for k, s in enumerate(shapes)])
    db.close()
    monkeypatch.setattr(scan, "RECORDS", 4)
    at = str(path) if store == "disk" else "dbfs://" + str(path)
    if store == "content":
        real = type(spark.read).load
        monkeypatch.setattr(type(spark.read), "load", lambda self, p: real(self, p.removeprefix("dbfs://")))
    rows = sorted(scan.geopackage(spark, at).collect(), key=lambda r: r.name)
    assert [tuple(r)[1:] for r in rows] == [(f"p{k}", str(k) if k else None) for k in range(5)]
    assert [r.geometry for r in rows] == ["POINT (7.5 46.5)", "LINESTRING (0.0 0.0, 1.0 2.0)", "POLYGON ((0.0 0.0, 0.0 2.0, 2.0 2.0, 0.0 0.0))", "MULTIPOLYGON (((0.0 0.0, 0.0 2.0, 2.0 2.0, 0.0 0.0)))", None]
    with pytest.raises(ValueError, match="no layer"):
        scan.geopackage(spark, str(path), "other")


@pytest.mark.parametrize("name", ["geonames", "geonames-cities", "swissnames3d"])
def test_bundled_configurations(spark, name):
    """Their expressions translate, and their sources join, over a made row of each source."""
    gazetteer = config.load(builtin()[name])
    kinds = {"text": "string", "integer": "bigint", "real": "double", "geometry": "string"}
    value = {"text": "'Wald (Au) ZH'", "integer": "7", "real": "8.0D", "geometry": "'POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))'"}
    scanned = {s.name: spark.range(1).selectExpr(*(f"cast({value[a.type]} as {kinds[a.type]}) as `{a.name}`" for a in s.original if not a.drop)) for s in gazetteer.sources}
    made = install.build(gazetteer, scanned)
    view = next(iter(made.views.values())).first().asDict()
    assert made.features.count() == (1 if name != "swissnames3d" else 6)
    texts = {r.name for r in made.names.collect()}
    assert "Wald (Au) ZH" in texts and "Wald" in texts and (name != "swissnames3d" or "Wald (Au)" in texts)
    if name == "swissnames3d":
        point = made.views["swissNAMES3D_PLY"].first().asDict()
        assert point["KANTON_NAME"] == point["GEMEINDE_NAME"] == "Wald (Au) ZH"
    else:
        assert set(views.DESCRIBED[name][2]) <= set(view)
