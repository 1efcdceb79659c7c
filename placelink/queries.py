"""Registered queries: each operator over the whole test tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelink.functions import geo
from placelink.functions import text as T
from placelink.modules import ManualRecognizer
from placelink.operators import annotate, context, registration, resolve, search, spans, spatial, views
from placelink.plans import dialect, install
from placelink.sources import config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"))


# --- views, derivations, registration


@query("""
SELECT s_suppkey AS supplier_id, s_name AS name, n_name AS nation_name, r_name AS region_name
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def view_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: read(spark, sf_dir, t) for t in ("supplier", "nation", "region")}
    joins = [("left join", "supplier.s_nationkey", "nation.n_nationkey"), ("LEFT  JOIN", "nation.n_regionkey", "region.r_regionkey")]
    select = [("supplier.s_suppkey", "supplier_id"), ("supplier.s_name", "name"), ("nation.n_name", "nation_name"), ("region.r_name", "region_name")]
    return views.build("supplier", tables, joins, select)


@query("""
SELECT p_partkey,
  upper(substr(p_name, 1, 1)) || lower(replace(substr(p_name, 2), ' ', '_')) AS slug,
  p_brand || '.' || p_type AS code,
  CASE WHEN regexp_matches(substr(p_name, 1, 1), '^[a-m]$') THEN 'low' ELSE 'high' END AS half,
  lower(p_brand) AS brand, length(p_name) AS n, 'POINT(' || p_size || ' ' || p_partkey || ')' AS geometry,
  CAST(NULL AS VARCHAR) AS missing
FROM part
""")
def derive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    given = {
        "slug": "upper(substr(p_name, 1, 1)) || lower(replace(substr(p_name, 2), ' ', '_'))",
        "code": "p_brand || '.' || p_type",
        "half": "CASE WHEN substr(p_name, 1, 1) GLOB '[a-m]' THEN 'low' ELSE 'high' END",
        "brand": "lower(\"p_brand\")",
        "n": "CAST(length(p_name) AS INTEGER)",
        "geometry": "'POINT(' || p_size || ' ' || p_partkey || ')'",
        "missing": "CAST(NULL AS TEXT)",
    }
    return rows.select("p_partkey", *(F.expr(dialect.translate(e, rows.columns)).alias(n) for n, e in given.items()))


@query("SELECT DISTINCT 'customer' AS source, CAST(o_custkey AS VARCHAR) AS location_id FROM orders WHERE o_custkey IS NOT NULL")
def register_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.features(read(spark, sf_dir, "orders"), "customer", "o_custkey").select("source", "location_id")


@query("""
SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS location_id, name FROM (
  SELECT p_partkey, p_name AS name FROM part UNION ALL SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, p_type FROM part
) WHERE name IS NOT NULL AND name <> ''
""")
def register_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    found = registration.names(rows, "part", "p_partkey", [("p_name", None), ("p_brand", None), ("p_type", None)])
    # a feature has few names, so neither side is small: Spark's estimate from the file's size would send one to the driver
    return registration.features(rows, "part", "p_partkey").hint("merge").join(found, "feature_id").select("location_id", "name")


@query("""
SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS location_id, trim(piece) AS name FROM (
  SELECT p_partkey, unnest(string_split(p_name, ' ')) AS piece FROM part
  UNION ALL SELECT p_partkey, p_type FROM part
) WHERE trim(piece) <> ''
""")
def register_names_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    found = registration.names(rows, "part", "p_partkey", [("p_name", " "), ("p_type", None)])
    # a feature has few names, so neither side is small: Spark's estimate from the file's size would send one to the driver
    return registration.features(rows, "part", "p_partkey").hint("merge").join(found, "feature_id").select("location_id", "name")


@query("SELECT 'part' AS source, count(*) AS n_features, count(*) + count(*) FILTER (WHERE p_brand <> p_name) AS n_names FROM part")
def gazetteer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    return registration.counts(registration.features(rows, "part", "p_partkey"), registration.names(rows, "part", "p_partkey", [("p_name", None), ("p_brand", None)]))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE CAST(p_partkey AS VARCHAR) = '7'")
def find_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find(read(spark, sf_dir, "part"), "7", "p_partkey").select("p_partkey", "p_name", "p_brand")


@query("SELECT CAST(c_custkey AS VARCHAR) AS location_id, c_custkey, c_name, c_mktsegment FROM customer")
def feature_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = rows.withColumn("geometry", F.lit("POINT(0 0)"))
    return views.attributes(registration.features(rows, "customer", "c_custkey"), rows, "c_custkey").drop("feature_id", "source")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    known = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return registration.new_rows(rows.union(rows), known, ["p_partkey"])


@query("""
SELECT c_custkey, CASE WHEN m.k IS NULL THEN c_mktsegment ELSE 'UPDATED' END AS c_mktsegment
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') m ON c_custkey = m.k
""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    changes = rows.join(done, "c_custkey", "left_semi").withColumn("c_mktsegment", F.lit("UPDATED"))
    return registration.upsert(rows, changes, ["c_custkey"])


# --- search

_TOK = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}.]+')"
_TF = "CASE WHEN len(t) < len(qt) THEN 0 ELSE len(list_filter(range(1, len(t) - len(qt) + 2), lambda i: t[i : i + len(qt) - 1] = qt)) END"


def _search_sql(asked: str, limit: int, tiers: int) -> str:
    return f"""
WITH n AS (SELECT p_partkey AS feature_id, p_name AS name, {_TOK.format('p_name')} AS t FROM part),
u AS (SELECT name, any_value(t) AS t, count(*) AS c FROM n GROUP BY name),
st AS (SELECT sum(c) AS n_all, sum(len(t) * c) / sum(c) AS mean_dl FROM u),
q AS ({asked}),
h AS (
  SELECT qid, pos, qt, name, c, len(t) AS dl, {_TF} AS tf FROM q JOIN u ON {_TF} > 0
), w AS (
  SELECT *, sum(c) OVER (PARTITION BY qid, pos) AS n_with FROM h
), p AS (
  SELECT qid, name, -sum(greatest(CASE WHEN ln((n_all - n_with + 0.5) / (n_with + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_all - n_with + 0.5) / (n_with + 0.5)) END, 0)
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_dl))) AS score
  FROM w CROSS JOIN st GROUP BY qid, name
), r AS (
  SELECT qid, feature_id, p.name, round(score, 9) AS score,
         row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), feature_id, p.name) AS place
  FROM p JOIN n ON p.name = n.name
), d AS (
  SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY score) AS tier FROM r WHERE place <= {limit}
)
SELECT qid, feature_id, round(min(score), 6) AS score, CAST(min(tier) AS INTEGER) AS tier FROM d WHERE tier <= {tiers} GROUP BY qid, feature_id
"""


@query(f"""
WITH n AS (SELECT p_partkey AS feature_id, p_name AS name, {_TOK.format('p_name')} AS t FROM part),
q AS (SELECT DISTINCT upper(p_name) AS qid, {_TOK.format('p_name')} AS qt FROM part)
SELECT DISTINCT qid, feature_id FROM q JOIN n ON length(qid) = length(name) AND {_TF} > 0
""")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    asked = names.select(F.upper("name").alias("qid")).distinct().withColumn("query", F.concat(F.lit(' "'), F.col("qid"), F.lit('" ')))
    return search.search(names, asked, "exact", limit=1_000_000).select("qid", "feature_id")


@query(_search_sql(f"SELECT DISTINCT w AS qid, 1 AS pos, {_TOK.format('w')} AS qt FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)", 10_000, 2))
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    asked = names.select(F.explode(F.split("name", " ")).alias("qid")).distinct().withColumn("query", F.col("qid"))
    return search.search(names, asked, "phrase", tiers=2).withColumn("score", F.round("score", 6))


@query(_search_sql(f"SELECT qid, pos, {_TOK.format('w')} AS qt FROM (SELECT qid, unnest(string_split(qid, ' ')) AS w, generate_subscripts(string_split(qid, ' '), 1) AS pos FROM (SELECT DISTINCT p_name AS qid FROM part))", 10_000, 2))
def search_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    asked = names.select(F.col("name").alias("qid"), F.col("name").alias("query")).distinct()
    return search.search(names, asked, "partial", tiers=2).withColumn("score", F.round("score", 6))


_LETTERS = "regexp_replace(upper(coalesce({0}, '')), '[^\\p{{L}}]', '', 'g')"


def _soundex_sql(column: str) -> str:
    letters = _LETTERS.format(column)
    code = f"translate(substr({letters}, 1, 1) || regexp_replace(substr({letters}, 2), '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
    code = f"regexp_replace({code}, '[^1-6]', '0', 'g')"
    for k in "123456":
        code = f"regexp_replace({code}, '{k}+', '{k}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE rpad(substr(substr({letters}, 1, 1) || replace(substr({code}, 2), '0', ''), 1, 4), 4, '0') END"


def _processed_sql(column: str) -> str:
    return f"trim(lower(regexp_replace(coalesce({column}, ''), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')))"


@query(f"""
WITH n AS (SELECT p_partkey AS feature_id, p_name AS name, {_soundex_sql('p_name')} AS code FROM part),
q AS (SELECT DISTINCT substr(p_name, 1, 2) || substr(p_name, 4) AS qid, {_soundex_sql("substr(p_name, 1, 2) || substr(p_name, 4)")} AS code FROM part),
m AS (SELECT qid, feature_id, min(levenshtein({_processed_sql('qid')}, {_processed_sql('name')})) AS score FROM q JOIN n USING (code) GROUP BY qid, feature_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, feature_id) AS place FROM m),
d AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY score) AS tier FROM r WHERE place <= 10000)
SELECT qid, feature_id, CAST(score AS INTEGER) AS score, CAST(tier AS INTEGER) AS tier FROM d WHERE tier <= 1
""")
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    asked = names.select(F.expr("substr(name, 1, 2) || substr(name, 4)").alias("qid")).distinct().withColumn("query", F.col("qid"))
    return search.search(names, asked, "fuzzy")


@query(f"SELECT DISTINCT name, {_soundex_sql('name')} AS code FROM (SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_type FROM part)")
def soundex_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_ = lambda t, c: read(spark, sf_dir, t).select(F.col(c).alias("name"))
    rows = read_("part", "p_name").union(read_("customer", "c_name")).union(read_("nation", "n_name")).union(read_("part", "p_type"))
    return rows.distinct().select("name", T.soundex(F.col("name")).alias("code"))


@query(f"SELECT p_partkey, levenshtein({_processed_sql('p_name')}, {_processed_sql('p_type')}) AS distance FROM part")
def levenshtein_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.levenshtein(F.col("p_name"), F.col("p_type")).cast("long").alias("distance"))


@query(f"SELECT doc_id, len({_TOK.format('text')}) AS n_tokens, array_to_string(list_slice({_TOK.format('text')}, 1, 5), '|') AS head FROM documents")
def fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), "|").alias("head"))


@query("""
WITH n AS (SELECT regexp_extract_all(lower(strip_accents(p_name)), '[\\p{L}\\p{N}.]+') AS t FROM part)
SELECT count(*) AS rows, round(avg(len(t)), 9) AS mean_dl FROM n
""")
def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = search.statistics(search.index(part_names(spark, sf_dir)))
    return told.select("rows", F.round("mean_dl", 9).alias("mean_dl"))


# --- documents and spans

_LEXICON = ("de", "der", "la", "le", "que", "the", "und", "with")
_MENTIONS = f"""
w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
m AS MATERIALIZED (
  SELECT doc_id, s AS start, s + length(word) AS "end", word AS text FROM (
    SELECT *, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s FROM w
  ) WHERE word IN {_LEXICON}
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")


def mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame([(w,) for w in _LEXICON], "name string")
    return spans.dictionary(documents(spark, sf_dir).select("document_id", "text"), F.broadcast(lexicon))


@query(f"WITH {_MENTIONS} SELECT doc_id AS document_id, start, \"end\", text FROM m")
def dictionary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentioned(spark, sf_dir)


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unprocessed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unprocessed(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), read(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {_MENTIONS} SELECT doc_id AS document_id, start, \"end\" FROM m WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id AND m.start % 2 = 0)")
def unprocessed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = mentioned(spark, sf_dir).withColumn("reference_id", F.concat_ws("-", "document_id", "start"))
    done = refs.where("start % 2 = 0").join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    return resolve.unprocessed(refs, done, "reference_id").select("document_id", "start", "end")


@query("SELECT doc_id, substr(text, CAST(doc_id % 50 AS INTEGER) + 1, 20) AS piece FROM documents")
def span_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("doc_id") % 50).cast("int")
    return read(spark, sf_dir, "documents").select("doc_id", T.span_text(F.col("text"), at, at + 20).alias("piece"))


@query("SELECT page_id, md5(regexp_replace(replace(html, chr(10), chr(13) || chr(10)), chr(13) || chr(10) || '?', chr(10), 'g')) AS digest FROM pages")
def newline_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    crlf = F.replace(F.col("html"), F.lit("\n"), F.lit("\r\n"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.newlines(crlf).cast("binary")).alias("digest"))


@query(f"""
WITH {_MENTIONS}
SELECT m.doc_id AS document_id, start, "end",
  (CASE WHEN start > 30 THEN '...' ELSE '' END) || substr(d.text, greatest(start - 30, 0) + 1, least("end" + 30, length(d.text)) - greatest(start - 30, 0))
  || (CASE WHEN "end" + 30 < length(d.text) THEN '...' ELSE '' END) AS snippet
FROM m JOIN documents d ON m.doc_id = d.doc_id
""")
def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.snippets(mentioned(spark, sf_dir).drop("text"), documents(spark, sf_dir))


_WIDE = "SELECT doc_id, start, \"end\" + 12 AS \"end\" FROM m"


@query(f"""
WITH {_MENTIONS}, w12 AS ({_WIDE}),
a AS (SELECT doc_id, start, "end", unnest(range(start // 128, ("end" - 1) // 128 + 1)) AS cell FROM m),
b AS (SELECT doc_id, start, "end", unnest(range(start // 128, ("end" - 1) // 128 + 1)) AS cell FROM w12)
SELECT DISTINCT a.doc_id AS document_id, a.start AS a_start, a."end" AS a_end, b.start AS b_start, b."end" AS b_end
FROM a JOIN b ON a.doc_id = b.doc_id AND a.cell = b.cell AND a.start < b."end" AND a."end" > b.start AND (a.start <> b.start OR a."end" <> b."end")
""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentioned(spark, sf_dir)
    return spans.overlaps(found, found.withColumn("end", F.col("end") + 12))


@query(f"""
WITH {_MENTIONS}, held AS (SELECT doc_id, start, "end" + 12 AS "end" FROM m WHERE start % 3 = 0)
SELECT m.doc_id AS document_id, m.start, m."end" FROM m
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = m.doc_id AND m.start < h."end" AND m."end" > h.start)
""")
def free_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentioned(spark, sf_dir).select("document_id", "start", "end")
    return spans.free(found, found.where("start % 3 = 0").withColumn("end", F.col("end") + 12))


@query(f"WITH {_MENTIONS} SELECT doc_id AS document_id, start, \"end\" FROM m WHERE start % 2 = 1")
def span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentioned(spark, sf_dir).select("document_id", "start", "end")
    return spans.unseen(found, found.where("start % 2 = 0"))


@query(f"WITH {_MENTIONS} SELECT text, count(*) AS n FROM m GROUP BY text ORDER BY n DESC, text LIMIT 10")
def mentions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.mentions(mentioned(spark, sf_dir), 10)


@query(f"""
WITH {_MENTIONS}, g AS (SELECT doc_id, start, "end" FROM m WHERE start % 5 <> 0), p AS (SELECT doc_id, start, "end" FROM m WHERE start % 3 <> 0),
s AS (SELECT CAST(count(*) FILTER (WHERE g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS BIGINT) AS tp, count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE p.doc_id IS NULL) AS fn
      FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.start = p.start AND g."end" = p."end")
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s
""")
def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentioned(spark, sf_dir)
    told = spans.scores(found.where("start % 5 <> 0"), found.where("start % 3 <> 0"))
    return told.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""
WITH {_MENTIONS}, o AS (
  SELECT m.doc_id, d.text, start, "end", coalesce(lag("end") OVER (PARTITION BY m.doc_id ORDER BY start), 0) AS last
  FROM m JOIN documents d ON d.doc_id = m.doc_id
), h AS (
  SELECT doc_id, max("end") AS tail, string_agg({_ESC.format('substr(text, last + 1, start - last)')} || '<span class="toponym' || CASE WHEN start % 2 = 0 THEN ' annotated' ELSE '' END
    || '" data-start="' || start || '" data-end="' || "end" || '">' || {_ESC.format('substr(text, start + 1, "end" - start)')} || '</span>', '' ORDER BY start) AS html
  FROM o GROUP BY doc_id
)
SELECT d.doc_id AS document_id, md5(coalesce(html, '') || {_ESC.format('substr(d.text, CAST(coalesce(tail, 0) AS BIGINT) + 1)')}) AS digest
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id
""")
def preannotated_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentioned(spark, sf_dir).withColumn("done", F.col("start") % 2 == 0)
    return spans.marked_up(documents(spark, sf_dir), found).select("document_id", F.md5(F.col("html").cast("binary")).alias("digest"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"))
    return spans.of_types(rows, ["click", "purchase"]).withColumnRenamed("label", "event_type")


# --- tags and markers


@query(f"""
WITH {_MENTIONS}
SELECT d.source AS project_id, d.doc_id AS document_id, m.start, m."end", m.text, CASE WHEN m.start % 3 = 0 THEN 'loc' || m.start END AS location_id
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id AND m.start % 2 = 0
""")
def tag_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("source").alias("project_id"), "document_id")
    refs = mentioned(spark, sf_dir).withColumn("reference_id", F.concat_ws("-", "document_id", "start")).withColumn("recognizer_id", F.when(F.col("start") % 2 == 0, "r0").otherwise("r1"))
    third = F.col("start") % 3 == 0
    one = lambda suffix, resolver, place: F.struct(F.concat_ws("/", "reference_id", F.lit(suffix)).alias("referent_id"), F.lit(resolver).alias("resolver_id"), place.alias("location_id"))
    wrong = one("c", "s1", F.lit("wrong"))
    each = F.explode(F.when(third, F.array(one("a", "s0", F.concat(F.lit("loc"), F.col("start"))), one("b", "s0", F.lit("other")), wrong)).otherwise(F.array(wrong)))
    referents = refs.select("reference_id", each.alias("r")).select("r.referent_id", "reference_id", "r.resolver_id", "r.location_id")
    tags = docs.select("project_id", F.lit("latest").alias("tag"), F.lit("r0").alias("recognizer_id"), F.lit("s0").alias("resolver_id")).distinct()
    return context.view(docs, refs, referents, tags)


@query("""
SELECT n_name AS project_id, 'latest' AS tag, 'r1' AS recognizer_id, CASE WHEN n_nationkey % 2 = 0 THEN 's9' ELSE 's0' END AS resolver_id FROM nation
UNION ALL SELECT r_name, 'gold', 'r7', NULL FROM region
""")
def retagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation")
    tags = rows.select(F.col("n_name").alias("project_id"), F.lit("latest").alias("tag"), F.lit("r0").alias("recognizer_id"), F.lit("s0").alias("resolver_id"))
    changes = rows.select(F.col("n_name").alias("project_id"), F.lit("latest").alias("tag"), F.lit("r1").alias("recognizer_id"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("s9")).alias("resolver_id"))
    new = read(spark, sf_dir, "region").select(F.col("r_name").alias("project_id"), F.lit("gold").alias("tag"), F.lit("r7").alias("recognizer_id"), F.lit(None).cast("string").alias("resolver_id"))
    return context.retag(tags, changes.union(new))


@query("""
SELECT 'documents' AS kind, count(*) AS n FROM documents WHERE source <> 'src1'
UNION ALL SELECT 'references', count(*) FROM conversations c JOIN documents d ON c.conv_id = d.doc_id WHERE d.source <> 'src1'
UNION ALL SELECT 'referents', count(*) FROM conversations c JOIN documents d ON c.conv_id = d.doc_id WHERE d.source <> 'src1' AND c.turn % 2 = 0
""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"))
    refs = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("reference_id"), F.col("conv_id").alias("document_id"), "turn")
    gone = spark.createDataFrame([("src1",)], "project_id string")
    kept = registration.cascade(gone, docs, refs, refs.where("turn % 2 = 0").select("reference_id"))
    counts = [k.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, k in zip(("documents", "references", "referents"), kept, strict=True)]
    return counts[0].union(counts[1]).union(counts[2])


@query("SELECT n_nationkey, substr(sha256('ManualRecognizer(label=''' || n_name || ''')'), 1, 8) AS module_id FROM nation")
def module_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # 25 rows at every scale
    return spark.createDataFrame([(r["n_nationkey"], ManualRecognizer(r["n_name"], [], []).id) for r in nations], "n_nationkey int, module_id string")


# --- resolution

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_HEADS = "h AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), p AS (SELECT e.vec_id, e.label, e.embedding FROM embeddings e JOIN h ON e.vec_id = h.vec_id)"


#: Rows up to which a table of prototypes is broadcast.
_FEW = 10_000


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= _FEW else rows


def _prototypes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "embeddings")
    heads = rows.groupBy("label").agg(F.min("vec_id").alias("vec_id"))  # one row a label: ten
    return rows, rows.join(_few(heads.select("vec_id")), "vec_id", "left_semi")


def _candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, heads = _prototypes(spark, sf_dir)
    pairs = rows.select(F.col("vec_id").alias("ref_id")).crossJoin(_few(heads.select(F.col("vec_id").alias("feature_id"), F.col("label").alias("pos"))))
    contexts = rows.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"))
    told = heads.select(F.col("vec_id").alias("feature_id"), F.col("embedding").alias("vector"))
    return resolve.similarities(pairs, contexts, _few(told)).withColumn("sim", F.round("sim", 9)).withColumn("round", F.col("pos") % 3 + 1)


@query(f"""
WITH {_HEADS}, s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS sim FROM p a CROSS JOIN embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows, heads = _prototypes(spark, sf_dir)
    asked = heads.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    sims = rows.crossJoin(_few(asked)).where("vec_id <> query_id").select("query_id", "vec_id", F.round(T.cosine(F.col("q"), F.col("embedding")), 6).alias("sim"))
    near = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return sims.withColumn("rank", F.row_number().over(near)).where("rank <= 5")


@query(f"""
WITH {_HEADS}, s AS (SELECT a.vec_id AS ref_id, b.vec_id AS feature_id, b.label AS pos, round({_COS}, 9) AS sim FROM embeddings a CROSS JOIN p b),
r AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY sim DESC, pos) AS n FROM s)
SELECT ref_id, feature_id, round(sim, 6) AS sim FROM r WHERE n = 1
""")
def resolver_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.best(_candidate_pairs(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query(f"""
WITH {_HEADS}, s AS (SELECT a.vec_id AS ref_id, b.vec_id AS feature_id, b.label AS pos, b.label % 3 + 1 AS round, round({_COS}, 9) AS sim FROM embeddings a CROSS JOIN p b),
g AS (SELECT ref_id, min(round) AS won FROM s WHERE sim >= 0.05 GROUP BY ref_id),
r AS (SELECT s.*, won, row_number() OVER (PARTITION BY s.ref_id ORDER BY sim DESC, round, pos, feature_id) AS n FROM s JOIN g ON s.ref_id = g.ref_id WHERE round <= won)
SELECT ref_id, CAST(won AS INTEGER) AS round, feature_id, round(sim, 6) AS sim FROM r WHERE n = 1
""")
def resolver_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.first_good_round(_candidate_pairs(spark, sf_dir), 0.05).withColumn("sim", F.round("sim", 6)).withColumn("round", F.col("round").cast("int"))


@query(f"""
WITH {_HEADS} SELECT a.vec_id AS ref_id, b.vec_id AS feature_id, round({_COS}, 6) AS sim FROM embeddings a CROSS JOIN p b WHERE round({_COS}, 9) >= 0.3
""")
def similarity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidate_pairs(spark, sf_dir).where("sim >= 0.3").select("ref_id", "feature_id", F.round("sim", 6).alias("sim"))


@query("""
WITH q AS (SELECT p_name AS ref_id, min(p_partkey) AS gold FROM part GROUP BY p_name)
SELECT ref_id, p_name || ' (' || p_type || ')' AS description, CASE WHEN p_partkey = gold THEN 1 ELSE 0 END AS label FROM q JOIN part ON p_name = ref_id
""")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = read(spark, sf_dir, "part"), part_names(spark, sf_dir)
    gold = rows.groupBy(F.col("p_name").alias("ref_id")).agg(F.min("p_partkey").cast("string").alias("location_id"))
    refs = gold.select("ref_id", F.concat(F.lit("about "), F.col("ref_id")).alias("context"))
    found = search.exact(names, gold.select(F.col("ref_id").alias("qid"), F.col("ref_id").alias("query")), limit=1_000_000).withColumnRenamed("qid", "ref_id")
    told = rows.select(F.col("p_partkey").alias("feature_id"), F.col("p_partkey").cast("string").alias("location_id"), T.description(F.col("p_name"), F.col("p_type"), []).alias("description"))
    return resolve.training_pairs(refs, gold, found, told).select("ref_id", "description", "label")


@query("""
WITH c AS (SELECT l_partkey AS ref_id, l_suppkey AS feature_id, l_linenumber AS round, l_orderkey AS pos FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY ref_id, feature_id ORDER BY round, pos) AS n FROM c)
SELECT ref_id, feature_id, round, pos FROM r WHERE n = 1
""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ref_id"), F.col("l_suppkey").alias("feature_id"), F.col("l_linenumber").alias("round"), F.col("l_orderkey").alias("pos"))
    return resolve.union_distinct(rows)


@query("""
WITH g AS (SELECT text, min(doc_id) AS first FROM documents WHERE doc_id % 2 = 0 GROUP BY text)
SELECT d.doc_id AS document_id, g.first AS start, g.first + 3 AS "end" FROM documents d LEFT JOIN g ON d.text = g.text
""")
def manual_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("document_id", "text")
    given = docs.where("document_id % 2 = 0").select(F.col("document_id").alias("pos"), "text", F.array(F.struct(F.col("document_id").alias("start"), (F.col("document_id") + 3).alias("end"))).alias("spans"))
    found = resolve.manual(docs, given)
    return found.select("document_id", F.col("spans")[0]["start"].alias("start"), F.col("spans")[0]["end"].alias("end"))


# --- space

_X, _Y = "CAST(c_custkey * 7 % 360 AS DOUBLE) - 180 + 0.25", "CAST(c_custkey * 13 % 180 AS DOUBLE) - 90 + 0.25"
_BOX = "SELECT n_nationkey AS id, -180.0 + n_nationkey % 5 * 72 AS x0, -90.0 + floor(n_nationkey / 5) * 36 AS y0, 72.0 AS w, 36.0 AS h FROM nation UNION ALL SELECT 100 + r_regionkey, -180.0, -90.0, 360.0, 180.0 FROM region"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = "concat('POLYGON((', x, ' ', y, ', ', x + w, ' ', y, ', ', x + w, ' ', y + h, ', ', x, ' ', y + h, ', ', x, ' ', y, '))')"
    nations = read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as shape_id", "-180.0D + n_nationkey % 5 * 72 as x", "-90.0D + floor(n_nationkey / 5) * 36 as y", "72.0D as w", "36.0D as h")
    regions = read(spark, sf_dir, "region").selectExpr("cast(100 + r_regionkey as bigint) as shape_id", "-180.0D as x", "-90.0D as y", "360.0D as w", "180.0D as h")
    return nations.union(regions).selectExpr("shape_id", f"{box} as wkt")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr("c_custkey as point_id", "cast(c_custkey * 7 % 360 as double) - 180 + 0.25 as x", "cast(c_custkey * 13 % 180 as double) - 90 + 0.25 as y")


@query(f"""
WITH b AS ({_BOX}), c AS (SELECT c_custkey AS point_id, {_X} AS x, {_Y} AS y FROM customer)
SELECT point_id, x, y, CAST(min(id) AS BIGINT) AS shape_id FROM c LEFT JOIN b ON x > x0 AND x < x0 + w AND y > y0 AND y < y0 + h GROUP BY point_id, x, y
""")
def spatial_within_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.join_first(_points(spark, sf_dir), _shapes(spark, sf_dir), cell=18.0)


@query(f"""
WITH b AS ({_BOX}), c AS (SELECT c_custkey AS point_id, {_X} AS x, {_Y} AS y FROM customer)
SELECT point_id, CAST(id AS BIGINT) AS shape_id FROM c JOIN b ON x > x0 AND x < x0 + w AND y > y0 AND y < y0 + h
""")
def spatial_centroid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = "concat('POLYGON((', x - 0.125, ' ', y - 0.125, ', ', x + 0.125, ' ', y - 0.125, ', ', x + 0.125, ' ', y + 0.125, ', ', x - 0.125, ' ', y + 0.125, ', ', x - 0.125, ' ', y - 0.125, '))')"
    areas = _points(spark, sf_dir).selectExpr("point_id", f"{around} as wkt")
    return spatial.points_in_shapes(spatial.centroids(areas, "wkt"), _shapes(spark, sf_dir), 18.0)


@query("""
WITH s AS (SELECT s_suppkey, ((2480000 + s_suppkey * 37 % 350000) - 2600000) / 1000000.0::DOUBLE AS y, ((1070000 + s_suppkey * 53 % 220000) - 1200000) / 1000000.0::DOUBLE AS x FROM supplier)
SELECT s_suppkey,
  round((2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y) * 100 / 36, 6) AS lon,
  round((16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x) * 100 / 36, 6) AS lat
FROM s
""")
def crs_lv95_to_wgs84(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = (2480000 + F.col("s_suppkey") * 37 % 350000).cast("double"), (1070000 + F.col("s_suppkey") * 53 % 220000).cast("double")
    lon, lat = geo.transform(east, north, 2056, 4326)
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part")
def wkt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", geo.point_wkt(F.col("p_size"), F.col("p_retailprice")).alias("w"))
    return rows.select("p_partkey", geo.point_x(F.col("w")).alias("x"), geo.point_y(F.col("w")).alias("y"))


@query("""
SELECT s_suppkey, s_name || ' (supplier) in ' || n_name || ', ' || r_name AS description
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def location_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("s_suppkey", T.description(F.col("s_name"), F.lit("supplier"), [F.col("r_name"), F.col("n_name"), F.lit("")]).alias("description"))


# --- annotation

_LOC = "CASE WHEN start % 3 = 0 THEN '' WHEN start % 3 = 2 THEN 'x' END"


def _toponyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = F.when(F.col("start") % 3 == 0, "").when(F.col("start") % 3 == 2, "x")
    return mentioned(spark, sf_dir).withColumn("loc_id", loc)


@query(f"""
WITH {_MENTIONS}, t AS (SELECT doc_id, {_LOC} AS loc FROM m)
SELECT d.doc_id AS document_id, count(t.doc_id) AS total, count(t.doc_id) FILTER (WHERE loc IS NULL OR loc <> '') AS annotated,
  CASE WHEN count(t.doc_id) > 0 THEN round(100.0 * count(t.doc_id) FILTER (WHERE loc IS NULL OR loc <> '') / count(t.doc_id), 6) ELSE 0.0 END AS percent
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id
""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.progress(documents(spark, sf_dir), _toponyms(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(f"""
WITH {_MENTIONS}, t AS (SELECT *, {_LOC} AS loc FROM m), f AS (SELECT doc_id, min(start) AS start FROM t GROUP BY doc_id),
c AS (SELECT t.doc_id, t.text FROM t JOIN f ON t.doc_id = f.doc_id AND t.start = f.start)
SELECT t.doc_id AS document_id, t.start, t."end", t.text,
  CASE WHEN f.start IS NOT NULL THEN 'L' || t.doc_id WHEN loc = '' AND c.doc_id IS NOT NULL THEN 'L' || t.doc_id ELSE loc END AS loc_id
FROM t LEFT JOIN f ON t.doc_id = f.doc_id AND t.start = f.start LEFT JOIN c ON t.doc_id = c.doc_id AND t.text = c.text
""")
def propagate_one_sense(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _toponyms(spark, sf_dir)
    changes = spatial.nearest_first(rows, "document_id", "start").withColumn("loc_id", F.concat(F.lit("L"), F.col("document_id")))
    return annotate.annotate(rows, changes)


@query("SELECT source AS session_id, doc_id AS document_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS doc_index FROM documents")
def reindex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("source").alias("session_id"), "document_id", F.col("document_id").cast("int").alias("doc_index"))
    return annotate.reindex(rows)


@query("SELECT s.n_name AS session_id, coalesce(max(c_custkey), -1) AS last FROM nation s LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY s.n_name")
def last_document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = read(spark, sf_dir, "nation").select(F.col("n_name").alias("session_id"), "n_nationkey")
    rows = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").join(sessions, F.col("c_nationkey") == F.col("n_nationkey")).select("session_id", F.col("c_custkey").alias("doc_index"))
    return annotate.last_index(rows, sessions)


@query(f"WITH {_MENTIONS} SELECT d.source AS session_id, d.text AS doc, m.start, m.\"end\", m.text, {_LOC} AS loc_id FROM m JOIN documents d ON d.doc_id = m.doc_id")
def session_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("source").alias("session_id"), "document_id", F.col("document_id").cast("int").alias("doc_index"), F.concat(F.lit("f"), F.col("document_id")).alias("filename"), F.lit("none").alias("spacy_model"), F.lit(False).alias("spacy_applied"), "text")
    sessions = docs.select("session_id", F.lit("2000-01-01").alias("created_at"), F.lit("2000-01-02").alias("last_updated"), F.lit("g").alias("gazetteer")).distinct()
    exported = annotate.export(sessions, docs, _toponyms(spark, sf_dir))
    return annotate.load_toponyms(exported).select("session_id", "doc", "start", "end", "text", "loc_id")


@query("""
SELECT p_brand, 'p_size' AS attribute, array_to_string(list_sort(list(DISTINCT CAST(p_size AS VARCHAR))), '|') AS held FROM part GROUP BY p_brand
UNION ALL SELECT p_brand, 'p_type', array_to_string(list_sort(list(DISTINCT p_type)), '|') FROM part GROUP BY p_brand
""")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facets(read(spark, sf_dir, "part"), "p_brand", ["p_size", "p_type"]).select("p_brand", "attribute", F.array_join("values", "|").alias("held"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND CAST(c_nationkey AS VARCHAR) = '3'")
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.matching(read(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": "3", "c_name": ""}).select("c_custkey", "c_name")


@query("""
SELECT DISTINCT o_custkey AS ref_id, o_orderpriority AS location_id FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT c_custkey, c_mktsegment FROM customer
""")
def candidates_with_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("ref_id"), F.col("o_orderpriority").alias("location_id")).distinct()
    held = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref_id"), F.col("c_mktsegment").alias("location_id"))
    return annotate.candidate_rows(found, held)


@query("""
SELECT n_nationkey AS feature_id, coalesce(string_agg(DISTINCT s_name, '|' ORDER BY s_name), '') AS held
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_nationkey
""")
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("feature_id"))
    names = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("feature_id"), F.col("s_name").alias("name"))
    return views.with_names(features, names.union(names)).select("feature_id", F.array_join("names", "|").alias("held"))


@query(f"""
WITH {_MENTIONS}, t AS (SELECT doc_id, {_LOC} AS loc FROM m)
SELECT d.source AS session_id, count(DISTINCT d.doc_id) AS documents, count(t.doc_id) AS total, count(t.doc_id) FILTER (WHERE loc IS NULL OR loc <> '') AS annotated,
  CASE WHEN count(t.doc_id) > 0 THEN round(100.0 * count(t.doc_id) FILTER (WHERE loc IS NULL OR loc <> '') / count(t.doc_id), 6) ELSE 0.0 END AS percent
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.source
""")
def session_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("document_id", F.col("source").alias("session_id"))
    return annotate.session_progress(docs, _toponyms(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(f"""
WITH {_MENTIONS}, held AS (SELECT doc_id, start, "end" FROM m WHERE start % 4 = 0), near AS (SELECT doc_id, start - 3 AS start, "end" FROM m WHERE start % 4 = 1)
SELECT m.doc_id AS document_id, m.start, m."end" FROM m
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = m.doc_id AND h.start = m.start AND h."end" = m."end")
  AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM held UNION ALL SELECT * FROM near) h WHERE h.doc_id = m.doc_id AND m.start < h."end" AND m."end" > h.start)
""")
def recognised_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentioned(spark, sf_dir).select("document_id", "start", "end")
    held = found.where("start % 4 = 0").union(found.where("start % 4 = 1").withColumn("start", F.col("start") - 3))
    return annotate.recognised(found, held)[0]


@query("""
WITH r AS (SELECT c_custkey AS ref_id, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_mktsegment END AS q, CAST(c_nationkey AS VARCHAR) AS held FROM customer JOIN nation ON n_nationkey = c_nationkey),
h AS (SELECT ref_id, CAST(n_nationkey AS VARCHAR) AS location_id, held FROM r JOIN nation ON n_name = q)
SELECT ref_id, location_id FROM h
UNION ALL SELECT ref_id, held FROM r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.ref_id = r.ref_id AND h.location_id = r.held)
""")
def annotation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation")
    features = nations.select(F.col("n_nationkey").cast("long").alias("feature_id"), F.col("n_nationkey").cast("string").alias("location_id"))
    names = nations.select(F.col("n_nationkey").cast("long").alias("feature_id"), F.col("n_name").alias("name"))
    rows = read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    refs = rows.select(F.col("c_custkey").alias("ref_id"), F.col("c_mktsegment").alias("text"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.lit(" ")).alias("query"), F.col("c_nationkey").cast("string").alias("location_id"))
    return annotate.candidates(names, features, refs)


_CONFIG = {
    "name": "suppliers",
    "sources": [
        {
            "name": "supplier", "path": "-", "file": "-", "kind": "tabular", "separator": "|",
            "attributes": {
                "original": [{"name": "s_suppkey", "type": "integer"}, {"name": "s_name", "type": "text"}, {"name": "s_nationkey", "type": "integer"}],
                "derived": [{"name": "code", "type": "text", "expression": "substr(s_name, instr(s_name, '#') + 1)"}, {"name": "label", "type": "text", "expression": "'S' || code"}],
            },
            "view": {
                "select": [{"column": "supplier.s_suppkey"}, {"column": "supplier.label"}, {"column": "nation.n_name", "alias": "nation"}, {"column": "region.r_name", "alias": "region"}],
                "join": [
                    {"method": "left join", "condition": {"type": "attribute", "left": {"column": "supplier.s_nationkey"}, "right": {"column": "nation.n_nationkey"}}},
                    {"method": "inner join", "condition": {"type": "attribute", "left": {"column": "nation.n_regionkey"}, "right": {"column": "region.r_regionkey"}}},
                ],
            },
            "features": {"identifier": [{"column": "supplier.s_suppkey"}], "names": [{"column": "supplier.s_name"}, {"column": "supplier.label"}]},
        },
        {"name": "nation", "path": "-", "file": "-", "kind": "tabular", "separator": "|", "attributes": {"original": [{"name": "n_nationkey", "type": "integer"}, {"name": "n_name", "type": "text"}, {"name": "n_regionkey", "type": "integer"}]}},
        {"name": "region", "path": "-", "file": "-", "kind": "tabular", "separator": "|", "attributes": {"original": [{"name": "r_regionkey", "type": "integer"}, {"name": "r_name", "type": "text"}]}},
    ],
}


def _built(spark: SparkSession, sf_dir: str) -> install.Built:
    gazetteer = config.parse(_CONFIG)
    return install.build(gazetteer, {s.name: read(spark, sf_dir, s.name) for s in gazetteer.sources})


@query("""
SELECT s_suppkey, 'S' || substr(s_name, instr(s_name, '#') + 1) AS label, n_name AS nation, r_name AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def gazetteer_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).views["supplier"]


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS location_id, name, 'supplier_view' AS source FROM (
  SELECT s_suppkey, s_name AS name FROM supplier UNION ALL SELECT s_suppkey, 'S' || substr(s_name, instr(s_name, '#') + 1) FROM supplier)
""")
def gazetteer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _built(spark, sf_dir)
    return made.names.join(made.features, "feature_id").select("location_id", "name", "source")
