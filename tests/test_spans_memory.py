"""What a Python worker holds while it looks for words is bounded by bytes, not by the rows it is sent."""

import random

import pyarrow as pa

from placelink import session
from placelink.operators import spans


def test_texts_are_split_in_pieces_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr(spans, "TOGETHER", 100)
    texts = ["a" * 40, None, "b" * 40, "c" * 40, "", "d" * 500, "e" * 99, "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["left out", *texts])], ["document_id", "text"]).slice(1)
    cut = [piece.column(1).to_pylist() for piece in spans._together(iter([batch, batch.slice(0, 0)]))]
    assert [t for piece in cut for t in piece] == texts
    assert all(len(piece) == 1 or sum(len(t or "") for t in piece) <= 100 for piece in cut)
    assert max(map(len, cut)) > 1


def test_words_do_not_depend_on_pieces(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["the", "", "Zürich", "of", "naïve"]) for _ in range(rng.randrange(4000)))) for k in range(300)]
    rows += [(300, None), (301, ""), (302, "the " * 400_000)]
    assert sum(len(t or "") for _, t in rows) > 3 * spans.TOGETHER
    want = set()
    for k, t in rows:
        at = 0
        for w in (t or "").split(" "):
            if w in ("the", "Zürich"):
                want.add((k, at, at + len(w), w))
            at += len(w) + 1
    docs = spark.createDataFrame(rows, "document_id long, text string")
    found = spans.dictionary(docs, spark.createDataFrame([("the",), ("Zürich",)], "name string")).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_workers_are_sent_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        session.ship(spark)
        assert spark.conf.get(key).rstrip("b") == str(session.BATCH_BYTES)
        spark.conf.set(key, "123")  # a user's own setting stays
        session.ship(spark)
        assert spark.conf.get(key).rstrip("b") == "123"
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)
