import hashlib
import random

import public_tokenizers as P
import pytest

from placelink.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def plain(text):
    return bpe.codec(PATH, P.PATTERN).encode_ordinary(text)


@pytest.mark.parametrize("seed", range(60))
def test_stitched_pieces_give_the_ids_of_the_whole_text(seed):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "'", "'re", "'l", "l", "9", "12", "!", "é", " ", " ", "ſ", "\U0001f600", "\x1c"]
    text = "".join(rng.choice(parts) * rng.choice((1, 1, 1, 30 if seed % 3 == 0 else 2)) for _ in range(200))
    chunk, overlap = rng.choice(((20, 6), (37, 12), (64, 1), (50, 49), (40, 30)))
    n = max(1, -(-(len(text) - overlap) // chunk))
    marks = [bpe.firm(text[k * chunk : k * chunk + chunk + overlap], P.PATTERN, k * chunk + chunk + overlap >= len(text), overlap, chunk) for k in range(n)]
    starts = bpe.stitch(marks, chunk)
    if starts is None:
        assert any(not set(x - chunk for x in a[1]) & set(b[0]) for a, b in zip(marks, marks[1:])) or overlap > chunk // 2
        return
    assert len(starts) == n and starts == sorted(starts)
    pieces = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    assert [i for p in pieces for i in plain(p)] == plain(text)


def test_some_texts_are_stitched():
    text = "It's one of 12 words, isn't it?\n  Yes. " * 40
    marks = [bpe.firm(text[k * 100 : k * 100 + 130], P.PATTERN, k * 100 + 130 >= len(text), 30, 100) for k in range(-(-(len(text) - 30) // 100))]
    assert len(bpe.stitch(marks, 100)) == len(marks) > 10


def test_pieces_of_many_texts_are_dealt_out(spark):
    """Small chunks, so that most texts take the way of the long ones; one pre-token is longer than the overlap."""
    rng = random.Random(2)
    words = ["word", " ", "  ", "\n", "don't", "9", "é", "\U0001f600", "!!", " the", " and"]
    rows = [(k, "".join(rng.choice(words) for _ in range(rng.randint(0, 300)))) for k in range(60)]
    rows += [(100, "x" * 900), (101, "a b " * 50 + "y" * 400 + " c d" * 80), (102, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.id, list(r.ids), bytes(r.decoded)) for r in bpe.encode(df, PATH, P.PATTERN, chunk=100, overlap=40, decoded=True).collect()), key=str)
    assert got == sorted(((d, plain(t), t.encode()) for d, t in rows), key=str)


def test_a_long_text_of_one_pre_token(spark):
    rows = [(1, "ab" * 600_000), (2, "z" * 1_000_000 + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: list(r.ids) for r in bpe.encode(df, PATH, P.PATTERN).collect()} == {d: plain(t) for d, t in rows}


def test_query_rows(spark):
    long = "".join(random.Random(1).choice(["word ", "x", "  ", "\n", "don't "]) for _ in range(40_000))
    rows = [(1, "Hello world", "a"), (2, None, "b"), (3, "", None), (None, "no id", "c"), (5, long, "d"), (5, long, "d"), (6, "é" * 70_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(df, PATH, P.PATTERN).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(((d, len(plain(t or "")), sha(" ".join(map(str, plain(t or ""))).encode()), sha((t or "").encode())) for d, t, _ in rows), key=str)
    assert got == want
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_decode(spark):
    df = spark.createDataFrame([(1, "é \U0001f600 x", "k"), (2, None, "l")], "doc_id long, text string, extra string")
    ids = bpe.encode(df, PATH, P.PATTERN)
    assert {(r.id, bytes(r.decoded).decode()) for r in bpe.decode(ids, PATH).collect()} == {(1, "é \U0001f600 x"), (2, "")}
