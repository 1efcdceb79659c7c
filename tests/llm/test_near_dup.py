import random
import re

import numpy as np
import pytest

from placelink.llm import near_dup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def plain(rows, n, percent):
    """{id: (set size, component)} by comparing all pairs."""
    held = [(d, words_of(t, n)) for d, t in rows]
    up = {d: d for d, _ in held}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (d, a) in enumerate(held):
        for e, b in held[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * len(a | b):
                x, y = root(d), root(e)
                up[max(x, y)] = min(x, y)
    return [(d, len(s), root(d)) for d, s in held]


def noisy(count, seed, vocabulary=300):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, vocabulary)) for _ in range(400)]
    rows = []
    for k in range(count):
        size = rng.choice([4, 6, 8, 12, 20, 35, 60, 110, 300])
        w = base[:size]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rng.randrange(size)
            w = w[:at] + rng.choice([[], [f"z{rng.randint(0, 9)}"], ["n", "m"]]) + w[at + 1 :]
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 90)])
def test_components_equal_brute_force(spark, n, percent):
    rows = noisy(260, n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.report(df, n, percent).collect())
    assert got == sorted(plain(rows, n, percent))


def test_odd_rows(spark):
    rows = [(5, "A b c d e"), (4, "a B c d e"), (9, None), (8, ""), (7, " \t\n"), (3, "two words"), (2, "two  words"), (1, "Ä b c d e"), (4, "a b c d e"), (6, "x y z é\u00a0nbsp")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.report(df, 4, 85).collect())
    assert got == sorted([(5, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9), (8, 0, 8), (7, 0, 7), (3, 1, 2), (2, 1, 2), (1, 2, 1), (6, 1, 6)])
    none = near_dup.report(df.limit(1).selectExpr("cast(null as long) as doc_id", "text"), 4, 85).collect()
    assert [tuple(r) for r in none] == [(None, 2, None)]
    assert near_dup.report(df.limit(0), 4, 85).count() == 0


def test_rows_that_share_an_id_tie_their_groups(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    rows = [(10, a), (11, a), (11, b), (12, b)]
    got = {r.doc_id: r.component_id for r in near_dup.report(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == {10: 10, 11: 10, 12: 10}


def test_every_text_of_a_shared_id_is_compared(spark):
    a, b = "alpha beta gamma delta epsilon zeta", " ".join(f"w{k}" for k in range(60))
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (8, "quite other words stand here"), (9, None), (9, ""), (None, a)]
    got = [tuple(r) for r in near_dup.report(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()]
    assert sorted(got, key=str) == sorted([(3, 3, 3), (5, 3, 3), (5, 57, 3), (7, 58, 3), (8, 2, 8), (9, 0, 9), (9, 0, 9), (None, 3, None)], key=str)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(1_500):
        n = int(rng.choice([1, 2, 5, 6, 7, 9, 13, 20, 50, 120, 400]))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.uniform(0, 1 - percent / 100)], rng.integers(0, 2**64, int(rng.integers(0, n // 6 + 2)), dtype=np.uint64)]))
        if len(b) and near_dup.links(a, b, percent) and not np.array_equal(a, b):
            assert np.intersect1d(near_dup.signatures(a, percent), near_dup.signatures(b, percent)).size
            x, y = near_dup.sketch(a), near_dup.sketch(b)
            size = min(len(x), len(y))
            apart = int(np.bitwise_count(near_dup._folded(x, size) ^ near_dup._folded(y, size)).sum())
            assert near_dup.may_link(len(a), len(b), apart, percent)


def test_sets_with_few_parts_share_a_signature():
    # all features in one first-level part: most parts of the band are empty
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 2**54, 200, dtype=np.uint64))
    b = np.unique(np.concatenate([a[8:], rng.integers(0, 2**54, 8, dtype=np.uint64)]))
    assert near_dup.links(a, b, 85)
    assert np.intersect1d(near_dup.signatures(a, 85), near_dup.signatures(b, 85)).size
