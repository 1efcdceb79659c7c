import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from placelink.llm import best_fit

PATH = P.path("word_bpe_49k.json")


def documents(count, seed):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(["river", "stone", "a", "Über", "of"]) for _ in range(int(rng.lognormvariate(4.5, 1.2))))) for k in range(count)]


def checked(rows, got, capacity, end_id=1):
    """Pieces are those of the documents, sequences have no gaps; the number of sequences."""
    whole = Tokenizer.from_file(PATH)
    want = []
    for doc, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((doc, k, at, len(own), zlib.crc32(own.tobytes())))
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    spots = defaultdict(list)
    for r in got:
        spots[r.sequence_id].append((r.offset, r.length))
    for own in spots.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spots), sum(r[3] for r in want)


@pytest.mark.parametrize("capacity,items", [(4096, 50_000), (300, 40), (64, 7)])
def test_sequences_hold_all_pieces_and_are_few(spark, monkeypatch, capacity, items):
    monkeypatch.setattr(best_fit, "LOCAL_ITEMS", items)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "90")
    try:
        rows = documents(700, capacity)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        first = best_fit.pack(df, PATH, capacity=capacity)
        got = first.collect()
        assert sorted(map(str, got)) == sorted(map(str, first.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    count, total = checked(rows, got, capacity)
    sizes = sorted((r.length for r in got), reverse=True)
    rooms = []  # first fit, longest first, over all pieces at once
    for size in sizes:
        k = next((k for k, room in enumerate(rooms) if room >= size), None)
        if k is None:
            rooms.append(capacity - size)
        else:
            rooms[k] -= size
    assert count <= 1.03 * len(rooms) + 1 and count >= -(-total // capacity)


def test_odd_rows(spark):
    rows = [(3, "Hello, World!"), (-1, None), (None, "no id"), (None, "no id"), (7, ""), (7, "again"), (7, "again"), (5, "long " * 9_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bin int, length int")
    got = best_fit.pack(df, PATH, keep_ids=True)
    held = got.collect()
    count, total = checked(rows, held, 4096)
    assert count == -(-total // 4096) == 3
    made = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in best_fit.sequences(got).collect()}
    for r in held:
        assert zlib.crc32(made[r.sequence_id][r.offset : r.offset + r.length].astype("<u4").tobytes()) == r.ids_crc32
    assert sum(map(len, made.values())) == total
    assert best_fit.pack(df.limit(0), PATH).count() == 0


def test_least_room_that_is_enough():
    bins = best_fit.Bins(10)
    for which, room in ((1, 4), (2, 7), (3, 4), (4, 0)):
        bins.put(which, room)
    assert bins.take(5) == (2, 7) and bins.take(5) == (None, 10)
    assert bins.take(1) == (3, 4) and bins.take(4) == (1, 4) and bins.take(1) == (None, 10)


def test_what_goes_on_is_bounded_by_sizes():
    bins = best_fit.Bins(100)
    for which in range(1_000):
        bins.put(which, 30)
    bins.put(2_000, 60)
    bins.put(2_001, 1)
    assert len(list(bins.underfull(2))) == best_fit.BRANCH + 1 and (2_000, 40) in list(bins.underfull(2))
