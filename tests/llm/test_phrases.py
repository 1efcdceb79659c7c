import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkFiles

from placelink.llm import perfect_hash as H
from placelink.llm import phrases
from placelink.llm.common import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, share, most):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * c[q]}
        scored = []
        for p, a in found.items():
            if p not in covered:
                score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -score) for r, (score, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def some(count, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "New", "York", "city", "Ünder", "ab\x1cc", "日本", "\xa0", "x\x85y", *(f"w{k}" for k in range(60))]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for _ in range(count):
        w = rng.choices(vocabulary, weights, k=rng.randint(0, 60))
        text = "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "new york city "]) for x in w)
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # several shards and several passes
        monkeypatch.setattr(H, "SHARD_KEYS", 64)
        monkeypatch.setattr(phrases, "PASS_KEYS", 200)
    rows = some(400, small)
    rows += [rows[0]] * 40 + [(None, "en"), ("", "de"), (" \t", None), ("one.two;three", "xx"), ("solo " * 30, "only")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, word string, h int").repartition(5)
    got = sorted(tuple(r) for r in phrases.mine(df, least=5, most=40).collect())
    want = plain(rows, 5, 50, 40)
    assert got == want and len(want) > 100 and {r[0] for r in want} == {"en", "de", "und", "only"}


def test_more_shards_take_no_more_passes(spark, monkeypatch):
    rows = some(120, 3)
    df = spark.createDataFrame(rows, "text string, lang string")
    real, made = phrases.table, []
    monkeypatch.setattr(phrases, "table", lambda rows, name: made.append(name) or real(rows, name))
    told = []
    for keys in (1 << 16, 64):
        monkeypatch.setattr(H, "SHARD_KEYS", keys)
        for name, value in (("PASS_KEYS", 64), ("KEYS", 16), ("MERGED", keys // 2)):
            monkeypatch.setattr(phrases, name, value)
        made.clear()
        told.append((sorted(tuple(r) for r in phrases.mine(df, least=4).collect()), list(made)))
    assert told[0] == told[1] and told[0][0] == plain(rows, 4, 50, 2000)


def test_words_are_those_of_the_rule_and_their_hashes_depend_on_all():
    texts = ["", "A b\tc.d\n", "  ", "Ünder\x0bx", "." * 3, "word"]
    for end in (False, True):
        own, at = phrases._split(pa.array(texts, pa.string()), end)
        want = [[w for w in re.findall("[^ \t]+", piece)] for t in texts for piece in re.split("[.,;:!?\n-\r]", t.translate(LOW))]
        got, last = [[]], own.to_pylist()
        for k in at.tolist():
            got.append([]) if k < 0 else got[-1].append(last[k])
        assert [g for g in got if g] == [w for w in want if w] and (at[-1] < 0) == end
    words = pa.array(["a", "b", "ab", "ba", "aa", "x" * 256, "x" * 257, "x" * 300, "ü"])
    h = np.concatenate([phrases._hashes(lang, words, seed) for lang in ("en", "de") for seed in (0, 1)])
    assert len(set(h.tolist())) == len(h) and 0 not in h
    assert (phrases._hashes("en", words.slice(2, 5), 0) == h[2:7]).all() and len(phrases._hashes("en", words[:0], 0)) == 0


def test_empty_tables_and_no_phrases(spark):
    df = spark.createDataFrame([("one two", "en"), (None, None), ("", "en")], "text string, lang string")
    assert phrases.mine(df.limit(0)).count() == 0
    assert phrases.mine(df).count() == 0
    assert phrases.mine(spark.createDataFrame([("word. " * 30, "en")], "text string, lang string")).count() == 0


def test_another_seed_where_two_words_share_a_hash(spark, monkeypatch):
    real, seeds = phrases.words, []

    def words(docs, seed):
        seeds.append(seed)
        made = real(docs, seed)
        return made.withColumn("h", phrases.F.lit(5).cast("long")) if seed == 0 else made

    monkeypatch.setattr(phrases, "words", words)
    rows = some(120, 9)
    got = sorted(tuple(r) for r in phrases.mine(spark.createDataFrame(rows, "text string, lang string"), least=4).collect())
    assert got == plain(rows, 4, 50, 2000) and seeds == [0, 1]


def test_products_beyond_64_bits():
    a = 3_000_000_000_000
    row = [[1], [2], [3], [a], [a + 1], [a + 2], [a + 3], [a]]
    (out,) = phrases._scored([pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in row], phrases._CUTS)])
    assert out.to_pylist()[0]["score"] == min(10**6 * a * a // ((a + 1) * (a + 2)), 10**6 * a * a // ((a + 3) * a))


class All:
    def __getitem__(self, at):
        return np.ones(len(at), bool)


def test_long_texts_in_slices_have_the_same_phrases(monkeypatch):
    rows = [" ".join(t for t, _ in some(60, 4)), "short text", "x" * 500, "a b c " * 50 + "end."]

    def counts():
        out = Counter()
        batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), pa.array(rows)], ["lang", "text"])
        for lead, ids in phrases._ids(iter([batch]), All(), 16, 0):
            one = pa.RecordBatch.from_arrays([pa.array([lead], pa.int32()), pa.array([ids.tobytes()], pa.binary())], ["lead", "ids"])
            out.update((int(i),) for i in ids[lead:] if i)
            for own, two, three in phrases._rows([one]):
                out.update(tuple(int(x[0]) for x in phrases._pair(own, np.array([k]))) for k in np.flatnonzero(two))
                out.update(tuple(int(x[0]) for x in phrases._triple(own, np.array([k]))) for k in np.flatnonzero(three))
        return out

    whole = counts()
    for size in (1, 7, 40):
        monkeypatch.setattr(phrases, "STREAM", size)
        assert counts() == whole


def test_every_key_has_a_slot_of_its_own():
    rng = np.random.default_rng(1)
    keys = tuple(rng.integers(0, 1 << 62, 5_000).astype(np.uint64) for _ in range(3))
    for k in keys[1:]:
        k[:2_000] = 0
    bits = 3
    shard = H.top(H.mix(keys, 0), bits)
    rows = []
    for s in range(1 << bits):
        own = tuple(k[shard == s] for k in keys)
        sizes, words, order = H.build(own)
        rows.append({"shard": s, "n": len(order), "sizes": sizes, "bits": words.tobytes()} | {f"k{j + 1}": k[order].tobytes() for j, k in enumerate(own)})
    held = H.Slots(pa.Table.from_pylist(rows), bits, 0, 1 << bits)
    at = held.find(keys)
    assert sorted(at.tolist()) == list(range(5_000)) and all((held.keys[j][at] == keys[j]).all() for j in range(3))
    assert (held.find((keys[0][:2_000],)) == at[:2_000]).all()
    assert (held.find((keys[0] + np.uint64(1), keys[1], keys[2])) == -1).all()
    half = H.Slots(pa.Table.from_pylist(rows[4:]), bits, 4, 8)
    assert (half.find(keys)[shard < 4] == -1).all() and sorted(half.find(keys)[shard >= 4].tolist()) == list(range((shard >= 4).sum()))
    with pytest.raises(ValueError):
        H.build(tuple(np.zeros(2, np.uint64) for _ in range(3)))


def test_bit_maps_are_mapped_not_held(spark):
    bits, width = 26, 1 << (phrases.BLOCK_BITS - 3)
    rng, paths = np.random.default_rng(3), []
    want = np.zeros(1 << (bits - 3), np.uint8)
    for k in (5, 0, 1023):
        want[k * width : (k + 1) * width] = rng.integers(0, 256, width)
    rows = [(k, bytearray(want[k * width : (k + 1) * width].tobytes())) for k in (5, 0, 1023)]
    for _ in range(phrases.MAPS_HELD + 2):
        paths.append(table(spark.createDataFrame(rows, "block long, map binary"), "map")._placelink_path)
    at = np.concatenate([rng.integers(0, 1 << bits, 1000), rng.integers(0, width * 8, 1000), rng.integers(1 << bits - 1, 1 << bits, 9), [0, (1 << bits) - 1]])
    tracemalloc.start()
    for path in [*paths, paths[0]]:  # the first is gone from the folder by then, and comes again
        got = phrases.bit_map(path, bits)[at]
        assert (got == ((want[at >> 3] >> (at & 7)) & 1 == 1)).all() and got.any()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 21, peak  # a map is 8 MB
    files = [f for f in os.listdir(SparkFiles.getRootDirectory()) if f.startswith("placelink-map-")]
    assert 0 < len(files) <= phrases.MAPS_HELD and not any(f.endswith(".part") for f in files)
