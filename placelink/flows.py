"""Registered queries that go through files, stores, projects and modules; with those of ``queries``, all of this part.

Files are written to a folder that all executors share, and read back by the
operators as a user's files would be.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelink.modules import DictionaryRecognizer, ManualRecognizer, ManualResolver, SimilarityResolver, TaggerRecognizer, tagger
from placelink.operators import annotate, postings, search, spans, views
from placelink.plans.install import Store
from placelink.project import Linker, Project
from placelink.queries import _LEXICON, _MENTIONS, _TOK, ORACLES, QUERIES, _search_sql, documents, mentioned, part_names, query, read
from placelink.session import scratch
from placelink.sources import config, scan
from placelink.storage import Storage

__all__ = ["ORACLES", "QUERIES"]


def _source(name: str, kind: str, columns: list[tuple[str, str]], **more) -> config.Source:
    original = [{"name": c, "type": t} | ({"srid": 4326} if t == "geometry" else {}) for c, t in columns]
    given = {"name": name, "path": "-", "file": "-", "kind": kind, "attributes": {"original": original}} | more
    return config.parse({"name": "g", "sources": [given]}).sources[0]


# --- scans


@query("SELECT p_partkey, p_name, p_size, p_retailprice, p_type FROM part")
def scan_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "delimited")
    columns = ["p_partkey", "p_name", "p_size", "p_retailprice", "p_brand", "p_type"]
    read(spark, sf_dir, "part").select(*columns).write.option("sep", "\t").csv(folder)
    source = _source("part", "tabular", [("p_partkey", "integer"), ("p_name", "text"), ("p_size", "integer"), ("p_retailprice", "real"), ("p_brand", "text"), ("p_type", "text")], separator="\t")
    return scan.tabular(spark, folder, source).drop("p_brand").withColumn("p_size", F.col("p_size").cast("int"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_with_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "head")
    read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", "true").option("sep", "|").csv(folder)
    source = _source("customer", "tabular", [("c_custkey", "integer"), ("c_name", "text"), ("c_acctbal", "real")], separator="|", skiprows=1)
    return scan.tabular(spark, folder, source)


@query("""
SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region,
  'POLYGON ((' || n_nationkey || ' 0, ' || (n_nationkey + 1) || ' 0, ' || (n_nationkey + 1) || ' 1, ' || n_nationkey || ' 0))' AS geometry
FROM nation
""")
def scan_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").collect()  # 25 rows at every scale
    ring = lambda k: [[k, 0], [k + 1, 0], [k + 1, 1], [k, 0]]
    features = [{"type": "Feature", "properties": {"name": r["n_name"], "region": r["n_regionkey"]}, "geometry": {"type": "Polygon", "coordinates": [ring(r["n_nationkey"])]}} for r in rows]
    folder = scratch(spark, "geojson")
    Storage(spark, folder).write("nations.geojson", json.dumps({"type": "FeatureCollection", "features": features}))
    source = _source("nations", "spatial", [("name", "text"), ("region", "integer"), ("geometry", "geometry")])
    return scan.spatial(spark, f"{folder}/nations.geojson", source)


@query("SELECT s_suppkey, s_name, CAST(s_suppkey AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier")
def scan_shapefile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").orderBy("s_suppkey").toLocalIterator()
    shp, shx, dbf, n = bytearray(100), bytearray(100), bytearray(), 0
    for r in rows:  # the file format is written row by row; this only makes the input
        shx += struct.pack(">2i", len(shp) // 2, 10)
        shp += struct.pack(">2i", n + 1, 10) + struct.pack("<i2d", 1, float(r["s_suppkey"]), float(r["s_nationkey"]))
        dbf += b" " + str(r["s_suppkey"]).rjust(12).encode() + r["s_name"].ljust(40).encode()
        n += 1
    field = lambda name, kind, width: name.ljust(11, b"\0") + kind + b"\0" * 4 + bytes([width]) + b"\0" * 15
    head = bytes([3, 0, 0, 0]) + struct.pack("<IHH", n, 32 + 2 * 32 + 1, 53) + b"\0" * 20 + field(b"ID", b"N", 12) + field(b"NAME", b"C", 40) + b"\r"
    store = Storage(spark, scratch(spark, "shapefile"))
    for name, data in (("s.shp", shp), ("s.shx", shx), ("s.dbf", head + dbf)):
        store.write(name, bytes(data))
    source = _source("suppliers", "spatial", [("s_suppkey", "integer"), ("s_name", "text"), ("geometry", "geometry")])
    held = scan.spatial(spark, store.path("s.shp"), source)
    from placelink.functions import geo

    return held.select("s_suppkey", "s_name", geo.point_x(F.col("geometry")).alias("x"), geo.point_y(F.col("geometry")).alias("y"))


@query("SELECT n_name || '.txt' AS filename, n_name || chr(10) || 'of region ' || n_regionkey AS text FROM nation")
def scan_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Storage(spark, scratch(spark, "texts"))
    for r in read(spark, sf_dir, "nation").collect():  # 25 rows at every scale
        store.write(f"{r['n_name']}.txt", f"{r['n_name']}\nof region {r['n_regionkey']}")
    return scan.text_files(spark, store.path())


# --- installed gazetteers


_STORES: dict[tuple[str, str], Store] = {}


def _installed(spark: SparkSession, sf_dir: str) -> Store:
    """Suppliers with their nations and, by place, their areas; installed twice, once for all queries of a session."""
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _STORES:
        _STORES[own] = _install(spark, sf_dir)
    return _STORES[own]


def _install(spark: SparkSession, sf_dir: str) -> Store:
    folder = Storage(spark, scratch(spark, "gazetteer")).path()
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    suppliers.write.option("sep", "|").csv(f"{folder}/supplier")
    read(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("sep", "|").csv(f"{folder}/nation")
    box = "concat('POLYGON((', r_regionkey * 10 - 180, ' -90, ', r_regionkey * 10 - 170, ' -90, ', r_regionkey * 10 - 170, ' 90, ', r_regionkey * 10 - 180, ' 90, ', r_regionkey * 10 - 180, ' -90))')"
    read(spark, sf_dir, "region").selectExpr("r_regionkey", "r_name", f"{box} as shape").write.option("sep", "|").csv(f"{folder}/region")
    ref = lambda c, **more: {"column": c, **more}
    left = lambda kind, a, b: {"method": "left join", "condition": {"type": kind, "left": ref(a), "right": ref(b)}}
    table = lambda name, columns, **more: {"name": name, "path": f"{folder}/{name}", "file": "-", "kind": "tabular", "separator": "|", "attributes": {"original": [{"name": c, "type": t} for c, t in columns]}, **more}
    supplier = table("supplier", [("s_suppkey", "integer"), ("s_name", "text"), ("s_nationkey", "integer")], view={
        "select": [ref("supplier.s_suppkey"), ref("supplier.s_name"), ref("nation.n_name", alias="nation"), ref("region.r_name", alias="area"), ref("supplier.geometry")],
        "join": [left("attribute", "supplier.s_nationkey", "nation.n_nationkey"), left("spatial", "supplier.geometry", "region.geometry")],
    }, features={"identifier": [ref("supplier.s_suppkey")], "names": [ref("supplier.s_name"), ref("supplier.place")]})
    supplier["attributes"]["original"][0]["index"] = True
    supplier["attributes"]["derived"] = [
        {"name": "place", "type": "text", "expression": "'Place ' || s_nationkey"},
        {"name": "geometry", "type": "geometry", "srid": 4326, "expression": "'POINT(' || (s_suppkey * 7 % 60 - 180 + 0.5) || ' ' || (s_suppkey * 11 % 170 - 85) || ')'"},
    ]
    region = table("region", [("r_regionkey", "integer"), ("r_name", "text"), ("shape", "text")])
    region["attributes"]["derived"] = [{"name": "geometry", "type": "geometry", "srid": 4326, "expression": "shape"}]
    given = json.dumps({"name": "suppliers", "sources": [supplier, table("nation", [("n_nationkey", "integer"), ("n_name", "text")]), region]})
    store = Store(spark, f"{folder}/store")
    for _ in range(2):
        store.install(config.parse(json.loads(given)))
    return store


@query("""
SELECT s_suppkey, s_name, n_name AS nation, r_name AS area FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON s_suppkey * 7 % 60 + 0.5 > r_regionkey * 10 AND s_suppkey * 7 % 60 + 0.5 < r_regionkey * 10 + 10
""")
def installed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _installed(spark, sf_dir).read("suppliers", "view/supplier").select("s_suppkey", "s_name", "nation", "area")


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS location_id, s_name || ' (' || n_name || ')' || coalesce(' in ' || r_name, '') AS description,
  CAST(s_suppkey * 7 % 60 - 180 + 0.5 AS DOUBLE) AS x, CAST(s_suppkey * 11 % 170 - 85 AS DOUBLE) AS y
FROM supplier JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON s_suppkey * 7 % 60 + 0.5 > r_regionkey * 10 AND s_suppkey * 7 % 60 + 0.5 < r_regionkey * 10 + 10
""")
def installed_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.functions import geo

    store = _installed(spark, sf_dir)
    told = store.describe("suppliers", "supplier", ("s_name", "nation", ("area",)))
    held = views.geometries(store.read("suppliers", "features"), store.read("suppliers", "view/supplier"), "s_suppkey")
    return told.join(held.select("feature_id", "geometry"), "feature_id").select("location_id", "description", geo.point_x(F.col("geometry")).alias("x"), geo.point_y(F.col("geometry")).alias("y"))


@query("""
WITH q AS (SELECT DISTINCT n_nationkey FROM nation)
SELECT n_nationkey AS qid, CAST(s_suppkey AS VARCHAR) AS location_id FROM q JOIN supplier ON s_nationkey = n_nationkey
""")
def installed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _installed(spark, sf_dir)
    asked = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("place "), F.col("n_nationkey")).alias("query"))
    found = store.search("suppliers", asked, "exact")
    return found.join(store.read("suppliers", "features"), "feature_id").select("qid", "location_id")


@query("SELECT 'supplier_view' AS source, count(*) AS n_features, 2 * count(*) AS n_names FROM supplier")
def installed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _installed(spark, sf_dir).manifest("suppliers")["counts"]
    return spark.createDataFrame([(s, *c) for s, c in counts.items()], "source string, n_features long, n_names long")


# --- stored positional postings


_INDEXES: dict[tuple[str, str], postings.Index] = {}


def _indexed(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The index of all part names, written once for all queries of a session."""
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _INDEXES:
        folder = Storage(spark, scratch(spark, "postings")).path()

        def stored(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{folder}/{name}")
            return spark.read.parquet(f"{folder}/{name}")

        texts = stored(search.index(part_names(spark, sf_dir)), "texts")
        found, tokens = postings.build(texts)
        blocks = stored(found.repartitionByRange("token", "shard").sortWithinPartitions("token", "shard", "block"), "postings")
        _INDEXES[own] = postings.Index(texts, blocks, stored(tokens, "tokens"), stored(search.statistics(texts), "statistics"))
    return _INDEXES[own]


@query(_search_sql(f"SELECT DISTINCT w AS qid, 1 AS pos, {_TOK.format('w')} AS qt FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)", 50, 3))
def stored_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 rows for each word of all names, in three tiers at most, by blocks that may hold them."""
    names = part_names(spark, sf_dir)
    asked = names.select(F.explode(F.split("name", " ")).alias("qid")).distinct().withColumn("query", F.col("qid"))
    return search.search(names, asked, "phrase", limit=50, tiers=3, stored=_indexed(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_search_sql(f"SELECT qid, pos, {_TOK.format('w')} AS qt FROM (SELECT qid, unnest(string_split(qid, ' ')) AS w, generate_subscripts(string_split(qid, ' '), 1) AS pos FROM (SELECT DISTINCT p_name AS qid FROM part))", 20, 1))
def stored_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best names for each name's words, as many as 20 rows hold, by blocks that may hold them."""
    names = part_names(spark, sf_dir)
    asked = names.select(F.col("name").alias("qid"), F.col("name").alias("query")).distinct()
    return search.search(names, asked, "partial", limit=20, tiers=1, stored=_indexed(spark, sf_dir)).withColumn("score", F.round("score", 6))


# --- projects and modules


def _project(spark: SparkSession, name: str) -> Project:
    return Project(spark, name, scratch(spark, "project"))


@query(f"""
WITH {_MENTIONS}
SELECT md5(d.text) AS digest, m.start, m."end", m.text, CASE WHEN m.text = 'the' THEN 'article' END AS location_id
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
""")
def project_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognizer and a resolver, each run twice; the second runs find nothing new."""
    from placelink.modules import Resolver

    class Articles(Resolver):
        NAME = "Articles"

        def predict(self, references: DataFrame) -> DataFrame:
            return references.where("text = 'the'").select("reference_id", F.lit("g").alias("gazetteer"), F.lit("article").alias("location_id"))

    project = _project(spark, "runs")
    project.create_documents(read(spark, sf_dir, "documents").select("text"))
    names = spark.createDataFrame([(w,) for w in _LEXICON], "name string")
    for _ in range(2):
        project.run_recognizer(DictionaryRecognizer(names, "words", longest=1))
        project.run_resolver(Articles())
    rows = project.get_documents().join(project.documents().select("document_id", F.md5(F.col("text").cast("binary")).alias("digest")), "document_id")
    return rows.select("digest", "start", "end", "text", "location_id")


_PLACES = "SELECT n_nationkey, n_name || ' lies in ' || r_name || '.' AS text, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def _places(spark: SparkSession, sf_dir: str) -> list:
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sorted((r["n_nationkey"], f"{r['n_name']} lies in {r['r_name']}.", r["n_name"], r["r_name"]) for r in rows.collect())  # 25 rows at every scale


@query(f"""
WITH p AS ({_PLACES})
SELECT text AS document, 0 AS start, CAST(length(n_name) AS INTEGER) AS "end", n_name AS text, CAST(n_nationkey AS VARCHAR) AS location_id FROM p
UNION ALL SELECT text, CAST(length(n_name) + 9 AS INTEGER), CAST(length(text) - 1 AS INTEGER), r_name, NULL FROM p
""")
def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = [{"text": text, "toponyms": [{"start": 0, "end": len(name), "text": name, "loc_id": str(k)}, {"start": len(name) + 9, "end": len(text) - 1, "text": area, "loc_id": ""}]} for k, text, name, area in _places(spark, sf_dir)]
    folder = scratch(spark, "annotations")
    Storage(spark, folder).write("a.json", json.dumps({"gazetteer": "g", "documents": docs}))
    project = _project(spark, "gold")
    project.load_annotations(f"{folder}/a.json", "gold", create_documents=True)
    rows = project.get_documents("gold").join(project.documents().select("document_id", F.col("text").alias("document")), "document_id")
    return rows.select("document", "start", "end", "text", "location_id")


@query(f"""
WITH p AS ({_PLACES})
SELECT text AS document, 0 AS start, CAST(length(n_name) AS INTEGER) AS "end", n_name AS text, 'id-' || n_nationkey AS location_id FROM p
""")
def one_shot_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _places(spark, sf_dir)
    texts, found = [r[1] for r in rows], [[(0, len(r[2]))] for r in rows]
    told = [[("g", f"id-{r[0]}")] for r in rows]
    parsed = Linker(spark, scratch(spark, "parse"), ManualRecognizer("m", texts, found), ManualResolver("m", texts, found, told)).parse(texts)
    return spark.createDataFrame([(r["document"], r["start"], r["end"], r["text"], r["location_id"]) for r in parsed], "document string, start int, `end` int, text string, location_id string")


_COUNTS = "[CAST(length({0}) AS DOUBLE), " + ", ".join(f"CAST(length({{0}}) - length(replace({{0}}, '{c}', '')) AS DOUBLE)" for c in "aeiou") + "]"


@query(f"""
WITH r AS (SELECT DISTINCT p_name AS text FROM part),
c AS (SELECT r.text, p_partkey, round(list_cosine_similarity({_COUNTS.format("r.text || ' is here'")}, {_COUNTS.format("(p_name || ' (' || p_type || ')')")}), 12) AS sim FROM r JOIN part ON p_name = r.text),
o AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY sim DESC, p_partkey) AS n FROM c)
SELECT text, sim FROM o WHERE n = 1
""")
def similarity_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct name, with a context, against all parts of that name; its similarity shows that the best one was taken."""
    from placelink.functions import text as T

    def encoder(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), *(float(t.count(c)) for c in "aeiou")] for t in texts]

    rows = read(spark, sf_dir, "part")
    described = rows.select(F.col("p_partkey").alias("feature_id"), F.col("p_partkey").cast("string").alias("location_id"), T.description(F.col("p_name"), F.col("p_type"), []).alias("description"))
    resolver = SimilarityResolver("parts", part_names(spark, sf_dir), described, 0.05, 1, encoder=encoder)
    refs = rows.select(F.col("p_name").alias("text")).distinct().select(F.col("text").alias("reference_id"), F.concat("text", F.lit(" is here")).alias("document"), F.lit(0).alias("start"), F.length("text").alias("end"), "text")
    found = resolver.predict(refs).join(described, "location_id")
    vector = lambda c: F.array(F.length(c).cast("double"), *((F.length(c) - F.length(F.replace(c, F.lit(v), F.lit("")))).cast("double") for v in "aeiou"))
    sim = T.cosine(vector(F.concat("reference_id", F.lit(" is here"))), vector(F.col("description")))
    return found.select(F.col("reference_id").alias("text"), F.round(sim, 12).alias("sim"))


# --- training


_AFTER = {"LOC": ["the", "with"], "GPE": ["de", "la", "le", "que"], "FAC": ["der", "und"]}


def _held_out(column: str):
    """A quarter of the rows, by checksum, that nothing is learnt from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


@query()
def trained_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagger learns, from three quarters of the documents, the words that follow articles; all documents are tagged.

    A row a document: its labelled words, what the tagger found, and how much of that is right.
    """
    docs = documents(spark, sf_dir).select("document_id", "text")
    label = F.create_map(*(F.lit(x) for k, ws in _AFTER.items() for w in ws for x in (w, k)))
    told = spans.following(docs, [w for ws in _AFTER.values() for w in ws])
    folder = scratch(spark, "after")
    told.select("document_id", "start", "end", label[F.col("before")].alias("label")).write.parquet(folder)
    gold = spark.read.parquet(folder)
    model = TaggerRecognizer(tagger.train(spans.training_set(docs.where(~_held_out("document_id")), gold), list(_AFTER), epochs=2), "after articles", tuple(_AFTER))
    keys = ["document_id", "start", "end", "label"]
    both = gold.select(*keys, F.lit(1).alias("g")).join(model.entities(docs).select(*keys, F.lit(1).alias("p")), keys, "full")
    counts = both.groupBy("document_id").agg(F.count("g").alias("n_gold"), F.count("p").alias("n_found"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("n_right"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("document_id").join(counts, "document_id", "left").select("document_id", _held_out("document_id").alias("held_out"), *(none(c) for c in ("n_gold", "n_found", "n_right")))


_ABC = "abcdefghijklmnopqrstuvwxyz"


@query()
def trained_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two towers learn which part a context means that tells its type in other letters; every name and type is resolved.

    A row a name and type: what is found with the towers, learnt from three
    quarters of the rows, and with hashed trigrams.
    """
    from placelink.functions import text as T

    rows = read(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("feature_id"))
    rows = rows.withColumn("reference_id", F.concat_ws("|", "p_name", "p_type")).withColumn("location_id", F.col("feature_id").cast("string"))
    folder = Storage(spark, scratch(spark, "encoder")).path()
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    names = rows.select("feature_id", F.col("p_name").alias("name"))
    described = rows.select("feature_id", "location_id", T.description(F.col("p_name"), F.col("p_type"), []).alias("description"))
    told = F.translate(F.lower("p_type"), _ABC, _ABC[13:] + _ABC[:13])
    refs = rows.select("reference_id", F.concat("p_name", F.lit(" "), told).alias("document"), F.lit(0).alias("start"), F.length("p_name").alias("end"), F.col("p_name").alias("text"))
    gold = rows.select("reference_id", "location_id")
    hashed = SimilarityResolver("parts", names, described, -1.0, 1)
    fitted = hashed.fit(hashed.training_pairs(refs.where(~_held_out("reference_id")), gold), f"{folder}/towers", epochs=10)
    found = fitted.predict(refs).select("reference_id", F.col("location_id").alias("found"))
    plain = hashed.predict(refs).select("reference_id", F.col("location_id").alias("plain"))
    out = gold.join(found, "reference_id", "left").join(plain, "reference_id", "left")
    same = lambda c: F.coalesce(F.col(c) == F.col("location_id"), F.lit(False))
    return out.select("reference_id", _held_out("reference_id").alias("held_out"), "location_id", "found", same("found").alias("is_right"), same("plain").alias("hashed_is_right"))


# --- spans and sessions


_CELLS = "unnest(range(start // 128, (\"end\" - 1) // 128 + 1)) AS cell"


@query(f"""
WITH {_MENTIONS}, g AS (SELECT doc_id, start, "end" + 5 AS "end" FROM m), e AS (SELECT doc_id, start, "end" + 3 AS "end", CASE WHEN start % 3 = 0 THEN 'GPE' WHEN start % 3 = 1 THEN 'FAC' ELSE 'ORG' END AS label FROM m),
gc AS (SELECT *, {_CELLS} FROM g), ec AS (SELECT *, {_CELLS} FROM e WHERE label <> 'ORG'),
h AS (SELECT DISTINCT gc.doc_id, gc.start, gc."end", ec.start AS s, ec."end" AS f, label FROM gc JOIN ec ON gc.doc_id = ec.doc_id AND gc.cell = ec.cell AND gc.start < ec."end" AND gc."end" > ec.start),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY CASE WHEN s >= start AND f <= "end" THEN 0 ELSE 1 END, s, f, label) AS n FROM h)
SELECT g.doc_id AS document_id, g.start, g."end", coalesce(o.label, 'LOC') AS label FROM g LEFT JOIN o ON o.doc_id = g.doc_id AND o.start = g.start AND o."end" = g."end" AND n = 1
""")
def distilled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentioned(spark, sf_dir)
    label = F.when(F.col("start") % 3 == 0, "GPE").when(F.col("start") % 3 == 1, "FAC").otherwise("ORG")
    base = found.select("document_id", "start", (F.col("end") + 3).alias("end"), label.alias("label"))
    return spans.distilled(found.select("document_id", "start", (F.col("end") + 5).alias("end")), base, ["GPE", "FAC"])


@query(f"""
WITH {_MENTIONS}, c AS (SELECT doc_id, start AS a, "end" AS b, start + 2 AS start, "end" + 4 AS "end" FROM m WHERE start % 2 = 0),
cc AS (SELECT *, {_CELLS} FROM c), mc AS (SELECT *, {_CELLS} FROM m),
bad AS (SELECT DISTINCT cc.doc_id, a FROM cc JOIN mc ON cc.doc_id = mc.doc_id AND cc.cell = mc.cell AND cc.start < mc."end" AND cc."end" > mc.start AND cc.a <> mc.start),
ok AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = c.doc_id AND bad.a = c.a))
SELECT m.doc_id AS document_id, CAST(coalesce(ok.start, m.start) AS INTEGER) AS start, CAST(coalesce(ok."end", m."end") AS INTEGER) AS "end", m.text
FROM m LEFT JOIN ok ON ok.doc_id = m.doc_id AND ok.a = m.start
""")
def moved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentioned(spark, sf_dir)
    changes = found.where("start % 2 = 0").select("document_id", F.col("start").alias("old_start"), F.col("end").alias("old_end"), (F.col("start") + 2).alias("start"), (F.col("end") + 4).alias("end"))
    return spans.moved(found, changes)


@query("""
SELECT n_name AS session_id, n_nationkey % 2 = 0 AND n_regionkey = 1 AS auto_close_annotation_modal, n_regionkey = 1 AS one_sense_per_discourse FROM nation
""")
def session_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select(F.col("n_name").alias("session_id"), "n_nationkey", "n_regionkey")
    changes = rows.where("n_regionkey = 1").select("session_id", F.when(F.col("n_nationkey") % 2 == 0, True).alias("auto_close_annotation_modal"), F.lit(True).alias("one_sense_per_discourse"))
    return annotate.settings(rows, annotate.put_settings(annotate.settings(rows), changes))


@query("SELECT doc_id AS document_id, source AS session_id, doc_id AS place FROM documents WHERE source IS NOT NULL")
def legacy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as files of a folder, imported into tables, and the files gone."""
    docs = documents(spark, sf_dir).where("source is not null").select(F.col("source").alias("session_id"), "document_id", F.col("document_id").cast("int").alias("doc_index"), F.concat(F.lit("f"), F.col("document_id")).alias("filename"), F.lit("none").alias("spacy_model"), F.lit(False).alias("spacy_applied"), F.col("document_id").cast("string").alias("text"))
    heads = docs.select("session_id", F.lit("2000-01-01").alias("created_at"), F.lit("2000-01-02").alias("last_updated"), F.lit("g").alias("gazetteer")).distinct()
    none = spark.createDataFrame([], "document_id long, start int, `end` int, text string, loc_id string")
    folder = scratch(spark, "legacy")
    store = Storage(spark, f"{folder}/in")
    for r in annotate.export(heads, docs, none, whole=True).toLocalIterator():  # a file a session
        store.write(f"{r['session_id']}.json", r["json"])
    told = scan.import_sessions(spark, f"{folder}/in", f"{folder}/out")
    if told["failed"] or store.names():
        raise RuntimeError(f"files were left: {told}")
    return spark.read.parquet(f"{folder}/out/documents").select(F.col("text").cast("long").alias("document_id"), "session_id", F.col("doc_index").cast("long").alias("place"))
