"""Spans of text: dictionary mentions, overlaps, duplicates, snippets, mark-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelink.functions import text as T
from placelink.session import ship


#: Names up to which a lexicon is matched where the texts are read; larger ones are joined.
LEXICON_ROWS = 100_000
#: Code points of a cell in which spans meet.
CELL = 128
#: Bytes of texts that are split together (one text at least): words and their places take some fifty times that.
TOGETHER = 1 << 20


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``batches(document_id, text)`` in pieces of at most ``TOGETHER`` bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = done = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, done + TOGETHER, "right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def grams(documents: DataFrame, longest: int = 1, names: list[str] | None = None) -> DataFrame:
    """``(document_id, pos, start, end, name, n)``: runs of up to ``longest`` words of texts split at single spaces.

    Empty words are left out; ``pos`` numbers all.  With ``names`` only runs
    that are among them come back.  Offsets are local to a text, so they are
    computed where it is read, ``TOGETHER`` bytes at a time, without a shuffle.
    """
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)["document_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if names is None else pa.array(names, pa.string())
        for batch in _together(batches):
            split = pc.split_pattern(pc.fill_null(batch.column(1), ""), " ")
            words, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            first = np.cumsum(sizes) - sizes
            width = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(width + 1)])
            start = before[:-1] - before[first][doc]
            pos = np.arange(len(doc)) - first[doc]
            full = np.flatnonzero(width)
            words, doc, pos, start, end = words.take(pa.array(full)), doc[full], pos[full], start[full], (start + width)[full]
            for n in range(1, longest + 1):
                if len(doc) < n:
                    break
                last = len(doc) - n + 1
                same = doc[:last] == doc[n - 1 :]
                runs = words if n == 1 else pc.binary_join_element_wise(*(words.slice(k, last) for k in range(n)), " ")
                if held is not None:
                    same &= pc.is_in(runs, value_set=held).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(same)
                columns = [batch.column(0).take(pa.array(doc[at])), pos[at].astype(np.int32), start[at].astype(np.int32), end[at + n - 1].astype(np.int32), runs.take(pa.array(at)), np.full(len(at), n, np.int32)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["document_id", "pos", "start", "end", "name", "n"])

    return documents.select("document_id", "text").mapInArrow(run, f"document_id {kind}, pos int, start int, `end` int, name string, n int")


def words(documents: DataFrame) -> DataFrame:
    """``(document_id, pos, start, end, word)`` of texts split at single spaces; empty words left out."""
    return grams(documents).select("document_id", "pos", "start", "end", F.col("name").alias("word"))


def following(documents: DataFrame, names: list[str]) -> DataFrame:
    """``(document_id, start, end, before)``: words that come one space after a word of ``names``, found without a shuffle."""
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)["document_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.array(names, pa.string())
        for batch in _together(batches):
            split = pc.split_pattern(pc.fill_null(batch.column(1), ""), " ")
            words, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            width = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(width + 1)])
            start = before[:-1] - before[(np.cumsum(sizes) - sizes)][doc]
            at = np.flatnonzero(pc.is_in(words, value_set=held).to_numpy(zero_copy_only=False)[:-1] & (doc[1:] == doc[:-1]) & (width[1:] > 0))
            columns = [batch.column(0).take(pa.array(doc[at])), pa.array(start[at + 1], pa.int32()), pa.array((start + width)[at + 1], pa.int32()), words.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(columns, ["document_id", "start", "end", "before"])

    return documents.select("document_id", "text").mapInArrow(run, f"document_id {kind}, start int, `end` int, before string")


def dictionary(documents: DataFrame, lexicon: DataFrame, longest: int = 1) -> DataFrame:
    """``(document_id, start, end, text)``: mentions of ``lexicon(name)``, longest first, without overlap.

    Names are compared word by word; up to ``longest`` words are tried.  Of
    mentions that overlap the one that starts first, then the longer one, wins.
    """
    held = [r["name"] for r in lexicon.select("name").where("name is not null").limit(LEXICON_ROWS + 1).collect()]
    if len(held) <= LEXICON_ROWS:
        hits = grams(documents, longest, sorted(set(held)))
    else:
        hits = grams(documents, longest).join(lexicon.select("name").distinct(), "name")
    if longest == 1:
        return hits.select("document_id", "start", "end", F.col("name").alias("text"))
    best = Window.partitionBy("document_id", "pos").orderBy(F.desc("n"))
    hits = hits.withColumn("r", F.row_number().over(best)).where("r = 1")
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "name")))
    kind = "array<struct<start:int,end:int,name:string>>"
    chosen = F.aggregate(rows, F.array().cast(kind), lambda kept, s: F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["end"] > s["start"]), kept).otherwise(F.concat(kept, F.array(s))))
    return hits.groupBy("document_id").agg(chosen.alias("s")).select("document_id", F.explode("s").alias("s")).select("document_id", "s.start", "s.end", F.col("s.name").alias("text"))


def _laid(rows: DataFrame, start: str, end: str) -> DataFrame:
    """``rows`` once for each cell of its document that the span touches."""
    last = F.greatest(F.col(f"`{end}`") - 1, F.col(f"`{start}`"))
    return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(f"`{start}`") / CELL), F.floor(last / CELL))))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs ``(document_id, a_start, a_end, b_start, b_end)`` of different spans that overlap.

    Spans meet in the cells that they touch, so a long document's spans are not
    all compared; a pair counts in the cell in which the later one starts.
    """
    left = _laid(a.select("document_id", F.col("start").alias("a_start"), F.col("end").alias("a_end")), "a_start", "a_end")
    right = _laid(b.select("document_id", F.col("start").alias("b_start"), F.col("end").alias("b_end")), "b_start", "b_end")
    different = (F.col("a_start") != F.col("b_start")) | (F.col("a_end") != F.col("b_end"))
    here = F.col("_cell") == F.floor(F.greatest("a_start", "b_start") / CELL)
    found = left.join(right, ["document_id", "_cell"]).where((F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")) & different & here)
    return found.select("document_id", "a_start", "a_end", "b_start", "b_end")


def free(new: DataFrame, held: DataFrame) -> DataFrame:
    """New spans that overlap none that is held, be it equal."""
    b = _laid(held.select("document_id", F.col("start").alias("_s"), F.col("end").alias("_e")), "_s", "_e")
    met = _laid(new.select("document_id", "start", "end"), "start", "end").join(b, ["document_id", "_cell"])
    return unseen(new, met.where((F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))).select("document_id", "start", "end"))


def movable(changes: DataFrame, held: DataFrame) -> DataFrame:
    """Of ``changes(document_id, old_start, old_end, start, end)`` those whose new span overlaps no other held span.

    The span that is changed does not stand in its own way.
    """
    b = _laid(held.select("document_id", F.col("start").alias("_s"), F.col("end").alias("_e")), "_s", "_e")
    met = _laid(changes, "start", "end").join(b, ["document_id", "_cell"])
    other = (F.col("_s") != F.col("old_start")) | (F.col("_e") != F.col("old_end"))
    keys = ["document_id", "old_start", "old_end", "start", "end"]
    return changes.join(met.where((F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")) & other).select(*keys).distinct(), keys, "left_anti")


def moved(toponyms: DataFrame, changes: DataFrame) -> DataFrame:
    """``toponyms(document_id, start, end, ...)`` with the spans that :func:`movable` changes allow."""
    ok = movable(changes, toponyms).select(F.col("document_id").alias("_d"), F.col("old_start").alias("_a"), F.col("old_end").alias("_b"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    rows = toponyms.join(ok, (F.col("document_id") == F.col("_d")) & (F.col("start") == F.col("_a")) & (F.col("end") == F.col("_b")), "left")
    new = {"start": F.coalesce("_s", "start"), "end": F.coalesce("_e", "end")}
    return rows.select(*((new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in toponyms.columns))


def unseen(new: DataFrame, held: DataFrame) -> DataFrame:
    """New spans that are not held exactly."""
    return new.join(held.select("document_id", "start", "end"), ["document_id", "start", "end"], "left_anti")


def with_text(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans with what their documents have there."""
    return spans.join(documents.select("document_id", F.col("text").alias("_whole")), "document_id").withColumn("text", T.span_text(F.col("_whole"), F.col("start"), F.col("end"))).drop("_whole")


def snippets(spans: DataFrame, documents: DataFrame, around: int = 30) -> DataFrame:
    """Spans with their context in the document."""
    whole = documents.select("document_id", F.col("text").alias("_whole"))
    return spans.join(whole, "document_id").withColumn("snippet", T.snippet(F.col("_whole"), F.col("start"), F.col("end"), around)).drop("_whole")


def marked_up(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``(document_id, html)``: texts escaped, with a tag around each of their disjoint spans.

    Spans carry ``done``: whether they have been annotated.  A text without
    spans is escaped as it is; a null text stays null.
    """
    listed = spans.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "done"))).alias("spans"))
    rows = documents.select("document_id", "text").join(listed, "document_id", "left")
    text = F.col("text")

    def part(a: Column, b: Column) -> Column:
        return T.escape_html(text.substr(a + 1, F.greatest(b - a, F.lit(0))))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))

    def step(state: Column, s: Column) -> Column:
        tag = F.concat(F.lit('<span class="toponym'), F.when(s["done"], F.lit(" annotated")).otherwise(F.lit("")), F.lit('" data-start="'), s["start"].cast("string"), F.lit('" data-end="'), s["end"].cast("string"), F.lit('">'))
        return F.struct(s["end"].alias("at"), F.concat(state["html"], part(state["at"], s["start"]), tag, part(s["start"], s["end"]), F.lit("</span>")).alias("html"))

    empty = F.array().cast("array<struct<start:int,end:int,done:boolean>>")
    html = F.aggregate(F.coalesce("spans", empty), start, step, lambda state: F.concat(state["html"], part(state["at"], F.length(text))))
    return rows.select("document_id", html.alias("html"))


def mentions(spans: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` most frequent texts: ``(text, n)``, ties by text."""
    return spans.groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(top)


def scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 of spans, aligned exactly: one row."""
    keys = ["document_id", "start", "end"]
    both = gold.select(*keys, F.lit(1).alias("g")).distinct().join(found.select(*keys, F.lit(1).alias("p")).distinct(), keys, "full")
    sums = both.agg(F.sum(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)).alias("fp"), F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("fn"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    told = sums.select("*", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return told.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def of_types(entities: DataFrame, kinds: list[str]) -> DataFrame:
    """Entities whose label is among ``kinds``."""
    return entities.where(F.col("label").isin(*kinds))


def distilled(spans: DataFrame, entities: DataFrame, kinds: list[str], fallback: str = "LOC") -> DataFrame:
    """``spans(document_id, start, end)`` with the ``label`` that a base model's ``entities`` give them.

    Of the entities of these kinds that overlap a span the first that lies
    inside it counts, else the first of all; without any, ``fallback``.
    """
    keys = ["document_id", "start", "end"]
    b = _laid(of_types(entities, kinds).select("document_id", F.col("start").alias("_s"), F.col("end").alias("_e"), "label"), "_s", "_e")
    met = _laid(spans.select(*keys).distinct(), "start", "end").join(b, ["document_id", "_cell"]).where((F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")))
    inside = (F.col("_s") >= F.col("start")) & (F.col("_e") <= F.col("end"))
    best = met.groupBy(*keys).agg(F.min_by("label", F.struct(~inside, F.col("_s"), F.col("_e"), F.col("label"))).alias("label"))
    return spans.select(*keys).distinct().join(best, keys, "left").withColumn("label", F.coalesce("label", F.lit(fallback)))


def training_set(documents: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(document_id, text, entities)`` for a trainer: every document with its labelled spans in order, an empty list without any."""
    listed = labelled.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("entities"))
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return documents.select("document_id", "text").join(listed, "document_id", "left").withColumn("entities", F.coalesce("entities", none))
