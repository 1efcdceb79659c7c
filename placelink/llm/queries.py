"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from placelink.llm import bpe

    return bpe.digests(_read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.llm import quality

    return quality.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.llm import warc

    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.llm import pii

    return pii.report(_read(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.llm import mixing

    return mixing.summary(_read(spark, sf_dir, "documents"))


def op9_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from placelink.llm import packing

    return packing.round_trip(_read(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.llm import near_dup

    return near_dup.report(_read(spark, sf_dir, "documents"), n=4, percent=85)


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.llm import vector_dedup

    return vector_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.llm import line_dedup

    return line_dedup.report(_read(spark, sf_dir, "documents"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.llm import ann

    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from placelink.llm import best_fit

    return best_fit.pack(_read(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.llm import hard_negatives

    return hard_negatives.report(_read(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placelink.llm import phrases

    return phrases.mine(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_pii": op5_pii,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_bit_packing": op9_bit_packing,
    "op10_nn_descent": op10_nn_descent,
    "op11_best_fit": op11_best_fit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_phrases": op13_phrases,
}

_OP3 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest AS digest, min(page_id) AS first_id, count(*) AS c FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN c > 1 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON payload_digest = digest
"""

_OP4 = """
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), e AS (
  SELECT doc_id, r, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM d
), classes AS (
  SELECT min(r) AS c, s, len(s) AS n FROM (SELECT r, list_sort(s) AS s FROM e WHERE len(s) > 0) GROUP BY s
), member AS (
  SELECT doc_id, r, c FROM e JOIN classes ON list_sort(e.s) = classes.s
), each AS (SELECT c, n, unnest(s) AS g FROM classes
), l AS (
  SELECT a.c AS a, b.c AS b FROM each a JOIN each b ON a.g = b.g AND a.c < b.c AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), t AS (  -- sets that are linked, and sets of rows that share an id
  SELECT a, b FROM l UNION SELECT b, a FROM l
  UNION SELECT x.c, y.c FROM member x JOIN member y ON x.doc_id = y.doc_id AND x.c <> y.c
), reach(a, b) AS (
  SELECT c, c FROM classes UNION SELECT reach.a, t.b FROM reach JOIN t ON reach.b = t.a
), f AS (
  SELECT reach.a AS c, min(m.doc_id) AS first_id FROM reach JOIN member m ON m.c = reach.b GROUP BY reach.a
)
SELECT e.doc_id, CAST(len(e.s) AS BIGINT) AS n_shingles, CASE WHEN e.doc_id IS NOT NULL THEN coalesce(f.first_id, e.doc_id) END AS component_id
FROM e LEFT JOIN member m ON m.r = e.r LEFT JOIN f ON f.c = m.c
"""

_OP7 = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), bad AS (
  SELECT trim(line, ' ') AS line, min(doc_id) AS first_id FROM l WHERE trim(line, ' ') <> '' GROUP BY 1
  HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= 10
), k AS (
  SELECT l.*, first_id IS NOT NULL AND first_id IS DISTINCT FROM doc_id AS gone
  FROM l LEFT JOIN bad ON trim(l.line, ' ') = bad.line
)
SELECT d.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_lines, CAST(coalesce(max(g), 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(max(t), '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS t
  FROM k GROUP BY doc_id
) x ON d.doc_id = x.doc_id
GROUP BY d.doc_id, d.text
"""

_OP8 = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER () AS total, 3 * source_size AS room,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room_before,
         sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_after
  FROM s
), l AS (
  SELECT *, (total - room_before) / weight_after AS level, room / w < (total - room_before) / weight_after AS is_full FROM r
), t AS (
  SELECT source, w, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN is_full THEN CAST(room AS DOUBLE)
              ELSE (SELECT max(level) FROM l WHERE NOT is_full) * w END AS target
  FROM l
), c AS (
  SELECT doc_id, size, source_size, target, w,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 1 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, least(whole + CASE WHEN before + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END, 3) AS times,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, (before + size / 2) / target) END AS u
  FROM c
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * times AS BIGINT) AS taken,
       -- weights rise, fall, or rise and fall over time: the inverse of t^2, 2t - t^2, and 2t^2 followed by 1 - 2(1 - t)^2
       CASE WHEN times > 0 AND target > 0 THEN round(CASE WHEN w = 1 THEN sqrt(u) WHEN w = 2 THEN 1 - sqrt(1 - u)
            WHEN u <= 0.5 THEN sqrt(u / 2) ELSE 1 - sqrt((1 - u) / 2) END, 9) END AS position
FROM x
"""

_OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS able
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.able AND b.able AND a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id
"""

_OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e)
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5
), n AS (
  SELECT anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, place,
         row_number() OVER (PARTITION BY anchor_id, place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, CAST(place AS INTEGER) AS positive_rank FROM n
"""

_OP13 = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM piece
), g AS (
  SELECT lang, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS phrases
  FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k
), f AS MATERIALIZED (
  SELECT lang, k, p, CAST(count(*) AS HUGEINT) AS c, string_split(p, ' ') AS w FROM (SELECT lang, k, unnest(phrases) AS p FROM g) GROUP BY lang, k, p
), n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), cut AS (
  SELECT x.lang, x.k, x.p, x.w, x.c AS a, j, l.c AS l, r.c AS r, 1000000 * x.c * x.c // (l.c * r.c) AS score
  FROM (SELECT f.*, unnest([1, 2]) AS j FROM f WHERE k >= 2 AND c >= 10) x
  JOIN f l ON l.lang = x.lang AND l.k = j AND l.p = array_to_string(x.w[1:j], ' ')
  JOIN f r ON r.lang = x.lang AND r.k = x.k - j AND r.p = array_to_string(x.w[j + 1:], ' ')
  WHERE j < x.k
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
), covered AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p, a FROM best WHERE k = 3
), cover AS (SELECT lang, p, max(a) AS a FROM covered GROUP BY lang, p
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.p) AS rank
  FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.p = b.p
  WHERE NOT coalesce(100 * c.a >= 50 * b.a, false) QUALIFY rank <= 2000
)
SELECT lang, rank, p AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang)
"""

ORACLES: dict[str, str] = {"op3_warc": _OP3, "op4_jaccard_join": _OP4, "op6_vector_dedup": _OP6, "op7_line_dedup": _OP7, "op8_source_mix": _OP8, "op12_hard_negatives": _OP12, "op13_phrases": _OP13}
