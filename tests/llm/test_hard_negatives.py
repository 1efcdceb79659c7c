import numpy as np
import pytest

from placelink.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


def plain(rows, every=50, k=5, m=3):
    """The rows of the query by comparing everything, in Python integers."""
    held = [(i, None if c is None else ((c + 1) % 10 if i % 7 == 0 else c), v) for i, v, c, *_ in rows if i is not None]
    held = [(i, c, [int(np.floor(256 * x)) for x in v]) for i, c, v in held if c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    held = [r for r in held if sum(x * x for x in r[2]) < 2**62]
    anchors = {}
    for i, c, v in held:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for a, (c, v) in anchors.items():
        s = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, d) for i, d, w in held if i != a and len(w) == len(v)]
        for place, (p, pid) in enumerate(sorted((q, i) for q, i, d in s if d == c)[:k], 1):
            inside = sorted((q, i) for q, i, d in s if d != c and 50 * -p <= 100 * -q <= 95 * -p)[:m]
            out += [(a, pid, r, n, -p, -q, place) for r, (q, n) in enumerate(inside, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in H.report(df).collect())


@pytest.mark.parametrize("size,rows_a_block", [(900, 2_048), (700, 37)])
def test_equals_brute_force(spark, monkeypatch, size, rows_a_block):
    monkeypatch.setattr(H, "ROWS", rows_a_block)
    monkeypatch.setattr(H, "GROUP_BYTES", 8 * 8 * rows_a_block)
    rng = np.random.default_rng(size)
    centers = rng.standard_normal((12, 8))
    rows = [(k, (centers[rng.integers(12)] + rng.normal(0, 0.5, 8)).tolist(), int(rng.integers(10)), "x") for k in range(size)]
    rows += [(k, rows[50][1], int(rng.integers(3)), "copy") for k in range(size, size + 150)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert got(df) == want and len(want) > 100
    assert len(H._groups(H.table(H.blocks(H.usable_rows(df, "vec_id", "embedding", "label", 256), 256).withColumn("block", H.F.monotonically_increasing_id()), "t"))) > (rows_a_block < 100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (50, [1.0, 0.5], None), (100, None, 1), (150, [nan, 1.0], 1), (200, [inf, 1.0], 1), (250, [None, 1.0], 1), (300, [], 1), (301, [], 2), (302, [], 1), (None, [1.0, 1.0], 1)]
    rows += [(350, [0.0, 0.0], 2), (1, [1.0, 0.5], 1), (2, [0.6, 0.4], 3), (2, [0.6, 0.4], 3), (2, [0.6, 0.4], 3), (3, [0.6, 0.4], 4), (4, [-1.0, 0.1], 1), (400, [1.0, 0.5, 1.0], 1), (401, [1.0, 0.5, 1.0], 1), (402, [0.5, 0.5, 0.5], 2)]
    rows += [(450, [1.0, 0.0], 5), (450, [0.5, 0.25], 4), (5, [0.9, 0.1], 4), (6, [1e30, 0.0], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    want = plain(rows)
    assert got(df) == want
    assert {r[0] for r in want} == {300, 350, 400, 450} and [r[3] for r in want if r[0] == 450 and r[1] == 3] == [2, 2, 2]
    assert got(df.limit(0)) == [] and got(df.where("vec_id = 0")) == []


def test_scores_beyond_float64_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.integers(1, 2**21, 4) * 2.0**6 + k / 256).tolist(), k % 2, "x") for k in range(0, 240, 5)]
    rows += [(k, [float(k % 13), 1.0, 2.0, 3.0], k % 3, "x") for k in range(1, 240, 5)]
    want = plain(rows)
    assert got(spark.createDataFrame(rows, SCHEMA)) == want
    assert max(r[4] for r in want) > 2**53
