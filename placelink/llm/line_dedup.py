"""Cross-site boilerplate lines, by distinct-site spread; DataFrame functions only.

HyperLogLog sketches of the sites of each line hash merge by aggregation.
Lines whose estimate is near the threshold get an exact distinct count.  Lines
on at least ``min_sites`` sites are removed from every document but the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelink.llm.common import drop, prepare, table

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers: a standard error of 1.6 percent.
LG_K = 12
#: Estimates within this share of the threshold, some 15 standard errors, are counted exactly.
NEAR = 0.25
#: Rows up to which a table of hashes is broadcast: some 5 MB.
BROADCAST_ROWS = 100_000


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _key(line: Column) -> Column:
    """128 bits of hash of a line without its outer spaces."""
    clean = F.trim(line)
    return F.struct(F.xxhash64(clean).alias("a"), F.xxhash64(F.lit(1), clean).alias("b"))


def _lines(df: DataFrame) -> DataFrame:
    """A row ``(id, site, k)`` for each distinct line that is not blank of each document."""
    each = df.select("id", "site", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    return each.where(F.trim("line") != "").select("id", "site", _key(F.col("line")).alias("k"))


def spread(df: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """Boilerplate lines of ``df(id, site, text)``.

    Returns ``(k, first)``, their hashes and the least document id with the
    line, and ``(id, site, k)``, where they and near-threshold lines occur.
    """
    sketched = _lines(df).groupBy("k").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("id").alias("first"))
    suspects = table(sketched.where(F.col("sites") >= min_sites * (1 - NEAR)), "suspects")
    found = table(_lines(df).join(_if_small(suspects.select("k")), "k"), "suspect-lines")
    near = suspects.where(F.col("sites") <= min_sites * (1 + NEAR)).select("k", "first")
    far = suspects.where(F.col("sites") > min_sites * (1 + NEAR)).select("k", "first")
    exact = found.join(near.select("k"), "k", "left_semi").groupBy("k").agg(F.countDistinct("site").alias("exact")).where(F.col("exact") >= min_sites)
    return table(far.union(near.join(exact.select("k"), "k")), "boilerplate"), found


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``df`` without boilerplate lines, and a struct ``_lines`` of counts.

    All columns stay; ``text_col`` loses the lines that occur on at least
    ``min_sites`` distinct sites, outer spaces aside, except in documents whose
    id is the least of those with the line.  Blank lines stay.  ``_lines`` has
    total and removed.  A null text stays null with no lines; an empty one has
    one line; null sites count as one site; null ids count as larger than any
    and as one document; rows that repeat are treated alike; other columns may
    have any names.
    """
    prepare(df.sparkSession)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    rows = rows.select("row", F.col(f"row.`{id_col}`").alias("id"), F.coalesce(F.col(f"row.`{site_col}`").cast("string"), F.lit("\0")).alias("site"), F.col(f"row.`{text_col}`").alias("text"))
    bad, found = spread(rows.select("id", "site", "text"), min_sites)
    hits = found.join(_if_small(bad), "k").where(~F.col("id").eqNullSafe(F.col("first")))
    hits = table(hits.groupBy("id").agg(F.collect_set("k").alias("bad")), "line-hits")
    drop(found)
    told = hits.select(F.col("id").alias("hit"), "bad")
    # by shuffle at every size: the documents that are hit grow with the input
    joined = rows.join(told.hint("merge"), rows.id.eqNullSafe(told.hit), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col("bad"), _key(line)))
    clean = F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.when(F.col("bad").isNull() | F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    columns = [clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns]
    return joined.select(*columns, F.struct(total.alias("total"), removed.alias("removed")).alias("_lines"))


def report(df: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(doc_id, n_lines, n_removed, text)`` of every document."""
    return remove(df.select("doc_id", "source", "text"), min_sites=min_sites).select("doc_id", F.col("_lines.total").alias("n_lines"), F.col("_lines.removed").alias("n_removed"), "text")
