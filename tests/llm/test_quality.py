import random
import zlib

import numpy as np

from placelink.llm import quality


def sample(count, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        w = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 120))]
        good = rng.random() < 0.6
        rows.append((k, " ".join(w) if good else "!! ".join(w) + "!!", int(good)))
    return rows


def test_gradients():
    rng = np.random.default_rng(1)
    p = {"embed": rng.normal(0, 0.5, (256, quality.EMBED)), "filters": rng.normal(0, 0.4, (quality.WIDTH, quality.EMBED, quality.FILTERS)), "bias": rng.normal(0, 0.1, quality.FILTERS), "head": rng.normal(0, 0.5, 2 * quality.FILTERS), "offset": np.array([0.2])}
    texts, y = [b"hello world " * 30, b"", b"x" * 128, b"some other words"], np.array([1.0, 0, 1, 0])

    def loss():
        model = quality.Model(np.einsum("be,wef->wbf", p["embed"], p["filters"]).astype(np.float32), p["bias"].astype(np.float32), p["head"], float(p["offset"][0]))
        s = quality.probabilities(texts, model, quality.pair_tables(model))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grads = quality._gradients(p, quality.Pages(texts), y)
    for name, at in (("head", (3,)), ("offset", (0,)), ("bias", (2,)), ("filters", (1, 2, 3)), ("embed", (ord("o"), 1))):
        old, eps = p[name][at], 1e-3
        p[name][at] = old + eps
        up = loss()
        p[name][at] = old - eps
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3, name


def test_a_score_depends_on_its_text_alone():
    model = quality.fit([t.encode() for _, t, _ in sample(80, 1)], [y for _, _, y in sample(80, 1)], epochs=2)
    tables = quality.pair_tables(model)
    texts = [t.encode() for _, t, _ in sample(30, 2)] + [b"", b"a", b"z" * 127, b"z" * 128, b"z" * 129, "é".encode() * 5_000]
    together = quality.probabilities(texts, model, tables)
    alone = np.concatenate([quality.probabilities([t], model, tables) for t in texts])
    assert np.allclose(together, alone) and ((0 <= together) & (together <= 1)).all()


def plain_score(text, model):
    """Filters at every byte in plain loops, chunks of two halves of 128 bytes, mean and maximum, one logistic unit."""
    halves = (len(text) + quality.WIDTH - 1) // quality.HALF + 1
    padded = text + bytes(halves * quality.HALF + quality.WIDTH)
    top = []
    for h in range(halves):
        places = [p for p in range(h * quality.HALF, (h + 1) * quality.HALF) if p < max(len(text), 1)]
        sums = [[sum(float(model.table[k, padded[p + k], f]) for k in range(quality.WIDTH)) for f in range(quality.FILTERS)] for p in places]
        top.append([max((s[f] for s in sums), default=float("-inf")) + float(model.bias[f]) for f in range(quality.FILTERS)])
    pairs = list(zip(top, top[1:])) if halves > 1 else [(top[0], top[0])]
    chunks = [[max(a[f], b[f], 0.0) for f in range(quality.FILTERS)] for a, b in pairs]
    feats = [sum(c[f] for c in chunks) / len(chunks) for f in range(quality.FILTERS)] + [max(c[f] for c in chunks) for f in range(quality.FILTERS)]
    return 1 / (1 + np.exp(-(sum(x * w for x, w in zip(feats, model.head)) + model.offset)))


def test_scores_equal_a_plain_forward_pass(monkeypatch):
    rows = sample(60, 5)
    model = quality.fit([t.encode() for _, t, _ in rows], [y for _, _, y in rows], epochs=1)
    tables = quality.pair_tables(model)
    texts = [t.encode() for _, t, _ in sample(4, 6)] + [b"", b"a", b"abcdefgh", "é!".encode() * 43, b"q" * 121, b"q" * 122, b"xyz " * 300]
    want = [plain_score(t, model) for t in texts]
    assert np.allclose(quality.probabilities(texts, model, tables), want, atol=1e-4)
    assert np.allclose([quality.probability(t, model, tables) for t in texts], want, atol=1e-4)
    for halves in (1, 2, 3):
        monkeypatch.setattr(quality, "SEGMENT", halves)
        whole = quality.probabilities(texts, model, tables)
        assert np.allclose([quality.probability(t, model, tables) for t in texts], whole, rtol=0, atol=1e-7)


def test_held_out_labels_do_not_change_scores(spark, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 2)
    rows = sample(200, 8)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    labels = [spark.createDataFrame([(k, 1 - y if flip and held(k) else y) for k, _, y in rows], "doc_id long, quality int") for flip in (False, True)]
    a, b = (sorted(map(tuple, quality.report(docs, told).collect())) for told in labels)
    assert a == b


def test_long_labelled_texts_leave_their_places_to_others(spark):
    docs = spark.createDataFrame([(k, "x" * (50_000 if k % 2 else 10)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3 % 2) for k in range(40)], "doc_id long, quality int")
    seen = []
    real = quality.fit
    quality.fit, old = (lambda texts, y: seen.append(len(texts)) or real(texts, y, epochs=1)), real
    try:
        quality.train(docs, labels, max_rows=8)
    finally:
        quality.fit = old
    assert seen == [8]


def test_filters_see_every_alignment():
    cue = b"abcdefgh"
    table = np.zeros((quality.WIDTH, 256, quality.FILTERS), np.float32)
    table[np.arange(8), list(cue), 0] = 1
    model = quality.Model(table, np.zeros(quality.FILTERS, np.float32), np.ones(2 * quality.FILTERS), 0.0)
    texts = [b" " * k + cue + b" " * (90 - k) for k in range(9)]
    assert np.ptp(quality.probabilities(texts, model, quality.pair_tables(model))) == 0


def test_report(spark):
    rows = sample(600, 3)
    docs = spark.createDataFrame([(k, t, "s") for k, t, _ in rows] + [(9000, None, "s"), (9001, "", "s"), (None, "some words", "s"), (1, rows[1][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (7, None), (8, 0), (8, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert len(got) == 603 and quality.report(docs, labels).count() == 604
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and got[k].predicted == int(got[k].score >= 0.7) for k, _, _ in rows)
    held = [(got[k].predicted, y) for k, _, y in rows if got[k].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert got[None].held_out is False
    assert quality.report(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in quality.report(docs, labels.limit(0)).collect()} == {1}
