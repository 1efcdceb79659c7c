"""The trained tagger and encoder: their parts against plain versions, and what they learn on held-out rows."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placelink.modules import HashEncoder, SimilarityResolver, TaggerRecognizer, TwoTowers
from placelink.modules.encoder import trained
from placelink.modules.sums import summed
from placelink.modules.tagger import FEATURES, Tagger, Words, _own, _owns, featured, sequences, train
from placelink.operators import spans

PLACES = ["Aldmoor", "Brackwell", "Castorham", "Dunleigh", "Eastmere", "Farwick", "Glenholt", "Harrowby"]


def sentence(rng):
    """Words with a place after ``in`` or ``near``, and an area of two words after ``throughout``."""
    place, other = rng.choice(PLACES), rng.choice(PLACES)
    shape = rng.randrange(4)
    if shape == 0:
        return f"They met in {place} last year. ", [(12, 12 + len(place), "LOC")]
    if shape == 1:
        return f"{other} said it was near {place}. ", [(len(other) + 18, len(other) + 18 + len(place), "LOC")]
    if shape == 2:
        return f"Rain fell throughout upper {place} today. ", [(21, 27 + len(place), "GPE")]
    return f"{other} wrote a letter to the paper. ", []


def texts(count, seed):
    rng, out = random.Random(seed), []
    for k in range(count):
        text, found = "", []
        for _ in range(rng.randint(0, 6)):
            part, own = sentence(rng)
            found += [(a + len(text), b + len(text), label) for a, b, label in own]
            text += part
        out.append((k, text, [{"start": a, "end": b, "label": label} for a, b, label in found]))
    return out


ENTITIES = "array<struct<start:int,end:int,label:string>>"


def test_sequences_cover_all_words():
    text = "One two. Three\nfour! " + "x " * 150
    parts = sequences(text)
    assert [text[a:b] for s in parts for a, b in s] == "One two . Three four !".split() + ["x"] * 150
    assert [len(s) for s in parts] == [3, 1, 2, 64, 64, 22] and sequences("") == sequences("  ") == []


def test_words_of_all_texts_are_found_at_once_and_are_those_of_the_rule():
    rng = random.Random(1)
    held = ["", "  ", "\n", "Ünder 日本 x́y. z!\nq?", ".", " .\n.", "\x1c x\x85y \xa0", "😀 b_1 ١٢", "İx 12-ab", *("".join(rng.choice("aÜ. !?\n\t_1日😀-") for _ in range(rng.randint(0, 30))) for _ in range(300))]
    words = Words(held)
    want = [(k, m.start(), m.end(), m.group()) for k, t in enumerate(held) for m in re.finditer(r"\w+|[^\w\s]", t)]
    assert list(zip(words.text.tolist(), words.start.tolist(), words.end.tolist(), (words.known[i] for i in words.ids), strict=True)) == want
    ends = [[m.end() for m in re.finditer(r"[.!?]\s|\n", t)] for t in held]
    group = [(k, sum(e <= a for e in ends[k])) for k, a, *_ in want]
    assert words.sizes.tolist() == [len(list(g)) for _, g in itertools.groupby(group)]
    assert _owns(words.known, FEATURES).tolist() == [list(_own(w, FEATURES)) for w in words.known]
    assert not len(Words([]).ids) and not len(Words([""]).features())


def test_sequences_of_like_sizes_are_learnt_from_together():
    rows = [(t, e) for _, t, e in texts(300, 5)] + [("x " * 60 + ".", [])] * 7 + [("", [])]
    (batch,) = pa.Table.from_pylist([{"text": t, "entities": e} for t, e in rows], pa.schema([("text", pa.string()), ("entities", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])))])).to_batches()
    tagger, plain = Tagger(["LOC", "GPE"]), []
    for t, e in rows:
        plain += [(featured(t, own).tolist(), tagger.gold(own, e).tolist()) for own in sequences(t)]
    got, steps = [], 0
    for features, labels, sizes in tagger.drawn(iter([batch])):
        ends = np.cumsum(sizes)
        got += [(features[b - n : b].tolist(), labels[b - n : b].tolist()) for b, n in zip(ends, sizes, strict=True)]
        steps += sizes.max()
    assert sorted(got) == sorted(plain)  # each sequence once
    assert steps < 2 * sum(len(f) for f, _ in plain) / 64


def test_decoding_finds_the_best_labels():
    rng = np.random.default_rng(3)
    tagger = Tagger(["A", "B"], rng.standard_normal((FEATURES, 5)), rng.standard_normal((6, 5)))
    held = [featured("we saw Old Town .", sequences("we saw Old Town .")[0]), featured("x", [(0, 1)]), featured("two words", [(0, 3), (4, 9)])]
    step = tagger.after + tagger.banned
    for f, got in zip(held, tagger.decode(held), strict=True):
        score = lambda labels, f=f: sum(tagger.weights[f[k], y].sum() + step[labels[k - 1] if k else -1, y] for k, y in enumerate(labels))
        best = max(itertools.product(range(5), repeat=len(f)), key=score)
        assert tuple(got.tolist()) == best
        assert all(y not in (2, 4) or (k and got[k - 1] in (y - 1, y)) for k, y in enumerate(got.tolist()))


def test_gold_labels_become_the_same_spans():
    tagger = Tagger(["LOC", "GPE"])
    for _, text, entities in texts(30, 1):
        found, at = [], [e for e in entities]
        for words in sequences(text):
            found += tagger._spans(words, tagger.gold(words, at))
        assert found == [(e["start"], e["end"], e["label"]) for e in entities]


def test_arrays_of_tasks_are_summed(spark):
    rows = spark.range(0, 50, numPartitions=37)
    size = (1 << 16) + 5

    def made(batches):
        ids = [i for b in batches for i in b.column(0).to_pylist()]
        return np.full(size, float(sum(ids))) if ids else None

    assert (summed(rows, made, size) == 1225).all()


def test_tagger_learns_from_context_and_is_saved(spark, tmp_path):
    rows = spark.createDataFrame(texts(300, 2), f"document_id long, text string, entities {ENTITIES}").repartition(3)
    tagger = train(rows.union(spark.createDataFrame([(9_999, None, None), (9_998, "", [])], rows.schema)), ["LOC", "GPE"], epochs=3)
    tagger.save(spark, str(tmp_path / "m"))
    held = texts(80, 7)
    again = TaggerRecognizer.load(spark, str(tmp_path / "m"), "places")
    documents = spark.createDataFrame([(k, t) for k, t, _ in held] + [(1_000, None)], "document_id long, text string")
    got = {(r.document_id, r.start, r.end, r.label) for r in again.entities(documents).collect()}
    gold = {(k, e["start"], e["end"], e["label"]) for k, _, own in held for e in own}
    both = len(got & gold)
    assert both / len(got) > 0.95 and both / len(gold) > 0.95
    found = {r.document_id: len(r.spans) for r in TaggerRecognizer(again.tagger, "gpe", ("GPE",)).predict(documents).collect()}
    assert len(found) == 81 and found[1_000] == 0 and sum(found.values()) == sum(label == "GPE" for *_, label in got)


def test_fit_keeps_the_labels_of_the_tagger_it_begins_with(spark, tmp_path):
    rows = texts(120, 4)
    held = spark.createDataFrame([(k, t, e["start"], e["end"]) for k, t, own in rows for e in own] + [(k, t, None, None) for k, t, own in rows if not own], "document_id long, document string, start int, end int")
    first = TaggerRecognizer(None, "places", ("LOC",), epochs=2).fit(held, str(tmp_path / "a"))
    second = first.fit(held, str(tmp_path / "b"), label="again")
    gold = held.where("start is not null").select("document_id", "start", "end")
    told = spans.scores(gold, second.entities(held.select("document_id", F.col("document").alias("text")).distinct())).first()
    assert told.f1 > 0.95 and second.id != first.id
    with pytest.raises(ValueError):
        first.fit(held.where("start is null"), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        TaggerRecognizer(None, "none").entities(held)


def test_slope_is_that_of_the_loss():
    towers = TwoTowers(None, buckets=32, dimensions=4, seed=1)
    towers.towers[1] = np.random.default_rng(2).standard_normal((32, 4))
    c, d = ["one two", "three", ""], ["uno dos", "tres", "cuatro", "tres uno"]
    right = np.array([[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 1, 0]], float)
    slope, _, n = towers.slope(c, d, right)
    assert n == 3
    for at in [(0, 3, 1), (1, 17, 2), *(tuple(x) for x in np.argwhere(np.abs(slope) > 0)[::40])]:
        step = []
        for by in (1e-5, -1e-5):
            moved = TwoTowers(towers.towers.copy())
            moved.towers[at] += by
            step.append(moved.slope(c, d, right)[1])
        assert abs((step[0] - step[1]) / 2e-5 - slope[at]) < 1e-4


KINDS = {"steel": "acier", "copper": "cuivre", "brass": "laiton", "wood": "bois", "paper": "papier", "glass": "verre"}


def pairs(spark, refs):
    rows = []
    for k in refs:
        rng = random.Random(k)
        kind = rng.choice(list(KINDS))
        for other, foreign in KINDS.items():
            rows.append((k, f"item {k % 7} is made of {kind} here", f"item {k % 7} ({foreign})", int(other == kind)))
    return spark.createDataFrame(rows, "ref_id long, context string, description string, label int")


def right_share(encode_context, encode_description, held):
    best = {}
    for r in held.collect():
        a, b = np.array(encode_context([r.context])[0]), np.array(encode_description([r.description])[0])
        best.setdefault(r.ref_id, []).append((float(a @ b), r.label))
    return np.mean([max(v)[1] for v in best.values()])


def test_towers_beat_hashed_trigrams_on_held_out_pairs(spark, tmp_path):
    resolver = SimilarityResolver("g", spark.createDataFrame([], "feature_id long, name string"), spark.createDataFrame([], "feature_id long, location_id string, description string"))
    fitted = resolver.fit(pairs(spark, range(120)), str(tmp_path / "m"), epochs=8)
    again, held = TwoTowers.load(spark, str(tmp_path / "m")), pairs(spark, range(200, 240))
    assert right_share(again.context, again.description, held) > 0.95 > 0.6 > right_share(HashEncoder(), HashEncoder(), held)
    contexts = fitted.encoded(held.select("context"), "context").first()
    assert np.allclose(contexts.vector, fitted.encoder.context([contexts.context])[0], atol=1e-6)
    with pytest.raises(ValueError):
        trained(pairs(spark, range(3)).where("label = 0"))


def test_words_after_words_are_told_without_a_join(spark):
    rows = [(0, "the cat  de  la ville the"), (1, None), (2, ""), (3, "the the end"), (4, "naïve la Zürich"), (5, "xthe y")]
    found = spans.following(spark.createDataFrame(rows, "document_id long, text string"), ["the", "de", "la"])
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(0, 4, 7, "the"), (0, 16, 21, "la"), (3, 4, 7, "the"), (3, 8, 11, "the"), (4, 9, 15, "la")]


def test_training_reads_examples_once_and_in_few_steps(spark):
    """Epochs go over a stored set, and what is learnt does not depend on how texts come in batches."""
    import pyarrow as pa

    from placelink.modules import tagger as G

    texts = [f"We met in the town{k % 7} of Old Hill. Then le parc{k % 5}, " + "and so on " * (k % 40) for k in range(400)]
    entities = [[{"start": t.index("town"), "end": t.index(" of"), "label": "A"}, {"start": t.index("parc"), "end": t.index("parc") + 5, "label": "B"}] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(entities)], ["text", "entities"])
    whole, parts = G.Tagger(["A", "B"]), G.Tagger(["A", "B"])
    one = whole.learn(whole.drawn(iter([batch])))
    two = parts.learn(parts.drawn(iter([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)])))
    assert one[1] == two[1] == sum(len(sequences(t)) for t in texts) and (one[0] == two[0]).all()
    fitted = G.Tagger.of(["A", "B"], one[0] / one[1])
    for _ in range(4):
        total, count = fitted.learn(fitted.drawn(iter([batch])))
        fitted = G.Tagger.of(["A", "B"], total / count)
    assert fitted.tag(texts) == [s for t in texts for s in fitted.tag([t])]
    assert any(fitted.tag(texts))
