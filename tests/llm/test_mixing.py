import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelink.llm import mixing


def plain(rows):
    """(taken, target) by repeated resharing and a simple walk."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    sizes = {n: sum(size(t) for _, t, s in rows if s == n) for n in names}
    weights = {n: k % 3 + 1 for k, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[n] for n in full)
        rest = sum(weights[n] for n in names if n not in full)
        target = {n: 3 * sizes[n] if n in full else left * weights[n] / rest for n in names}
        more = {n for n in names if n not in full and target[n] > 3 * sizes[n]}
        if not more:
            return target, sizes
        full |= more


ROWS = [(k, "word " * (k % 13 + 1), "abcd"[min(3, k % 9)]) for k in range(400)] + [(1000, None, "a"), (1001, "", None), (1002, "x " * 400, None), (1003, "x\x0by\x1cz é", "tiny"), (None, "no id here", "b"), (5, "word " * 6, "d"), (5, "word " * 6, "d")]


def test_targets_and_taken(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.summary(df).collect()
    target, sizes = plain(ROWS)
    assert len(got) == len(ROWS)
    by = {}
    for r in df.collect():
        by.setdefault((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))), r.source)
    taken = dict.fromkeys(target, 0)
    for r in got:
        source = by[r.doc_id, r["size"]]
        assert r.target == pytest.approx(target[source]) and r.source_size == sizes[source]
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[source] += r.taken
    most = {s: max(k for (_, k), v in by.items() if v == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    again = mixing.summary(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert mixing.summary(df.limit(0)).count() == 0


def test_schedule_follows_the_curriculum(spark):
    rows = [(k, "w " * 10, "ab"[k % 2]) for k in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plans = {"a": [(0.0, 2.0), (1.0, 0.0)], "b": [(0.0, 0.0), (1.0, 2.0)]}
    order = [r.source for r in mixing.schedule(df, schedules=plans).collect()]
    assert len(order) == 2_000
    quarter = [order[k : k + 500].count("a") / 500 for k in range(0, 2_000, 500)]
    assert quarter[0] > 0.8 and quarter[3] < 0.2 and quarter == sorted(quarter, reverse=True)


def test_positions_invert_the_integral(spark):
    """Each document's position by a fine numeric integration of its source's schedule."""
    knots = {"a": [(0.2, 1.0), (0.6, 0.0), (0.8, 3.0)], "b": [(0.0, 2.0)], "c": [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)], None: [(0.5, 1.0)]}
    rows = [(k, "w " * (k % 5 + 1), [*"abc", None][k % 4]) for k in range(200)]
    got = mixing.summary(spark.createDataFrame(rows, "doc_id long, text string, source string"), schedules=knots).collect()
    fine = np.linspace(0, 1, 400_001)
    size = {d: (len(t.split()), s) for d, t, s in rows}
    for source, held in knots.items():
        own = sorted((r for r in got if size[r.doc_id][1] == source), key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
        w = np.interp(fine, [t for t, _ in held], [x for _, x in held])
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        before = 0
        for r in own:
            u = min(1.0, (before + r["size"] / 2) / r.target)
            if r.taken:
                assert r.position == pytest.approx(float(np.interp(u, area / area[-1], fine)), abs=2e-5)
            before += r["size"]
    assert all(r.position >= 0.5 for r in got if size[r.doc_id][1] == "c" and r.position is not None)


def test_a_schedule_takes_every_row_as_often_as_the_summary_says(spark):
    rows = [*ROWS, (5, "word " * 6, "d"), (5, "other word", "d"), (None, "no id here", "b"), (None, "no id either", "b"), (2000, "only blanks follow", "zero")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("part", F.lit("clash")).withColumn("x", F.monotonically_increasing_id())
    plans = {"zero": [(0.0, 0.0)]}
    got = mixing.schedule(df, schedules=plans)
    assert got.columns == df.columns
    counts: dict = {}
    for r in got.collect():
        key = (r.doc_id, len(re.findall(mixing.WORD, r.text or "")))
        counts[key] = counts.get(key, 0) + 1
    taken: dict = {}
    for r in mixing.summary(df, schedules=plans).collect():
        if r["size"]:
            taken[(r.doc_id, r["size"])] = taken.get((r.doc_id, r["size"]), 0) + r.taken // r["size"]
    assert {k: v for k, v in counts.items() if k[1]} == {k: v for k, v in taken.items() if v}
    assert (2000, 3) not in counts and mixing.schedule(df.limit(0)).count() == 0


def test_order_is_by_hash_of_the_id(spark):
    rows = [(k, "w", "a") for k in range(50)]
    got = [r.doc_id for r in mixing.summary(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert got == sorted(range(50), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
