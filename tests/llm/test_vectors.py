import numpy as np
import pytest

from placelink.llm import ann, vector_dedup

RNG = np.random.default_rng(7)


def clusters(count, dim=16):
    rows, ident = [], 0
    while ident < count:
        center = RNG.standard_normal(dim)
        for _ in range(int(RNG.choice([1, 1, 2, 5, 30]))):
            rows.append((ident, (center + RNG.normal(0, 0.08, dim)).astype(np.float32).tolist(), ident % 3))
            ident += 1
    return rows


def test_dedup_equals_brute_force(spark):
    rows = clusters(400) + [(1000 + k, [1.0] + [0.0] * 15, 1) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label, ids = np.array([r[2] for r in rows]), [r[0] for r in rows]
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    comp = list(range(len(rows)))
    for _ in rows:
        new = [min([comp[k], *(comp[j] for j in np.flatnonzero(near[k]))]) for k in range(len(rows))]
        if new == comp:
            break
        comp = new
    assert got == {ids[k]: (int(near[k].sum()), ids[comp[k]], comp[k] == k) for k in range(len(rows))}
    assert near.sum() > 1_500


def test_links_are_whole_where_the_window_binds(spark):
    """700 vectors that nearly all link: far more than the window, several blocks of one component."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal(24) + rng.normal(0, 0.09, (700, 24))
    x = np.concatenate([x, rng.standard_normal((300, 24))])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df, turns=4, window=6).collect()}
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    assert links[:700].mean() > 100 and links[700:].sum() == 0
    hub = {k for k in range(700) if got[k][1] == 0}
    assert len(hub) >= 650 and all(got[k][0] == near[k, sorted(hub)].sum() for k in hub)
    assert all(got[k] == (0, k) for k in range(700, 1000))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1e30, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, component string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect()}
    alone = {k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10)}
    assert got == alone | {1: (2, 1, True), 2: (2, 1, False), 11: (2, 1, False), None: (0, None, False)}
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def exact(rows, k, every):
    x, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows])
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        s = x @ x[at]
        order = [j for j in np.lexsort((ids, -s)) if j != at][:k]
        out[int(ids[at])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_search_recall(spark, scaled):
    rows = clusters(1_500)
    if scaled:
        rows = [(i, (np.array(v) * RNG.uniform(0.5, 2)).tolist(), c) for i, v, c in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    rows = [(i, np.array(v, np.float32).astype(float).tolist(), c) for i, v, c in rows]
    want = exact(rows, 20, 20)
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    score = {i: np.array(v) for i, v, _ in rows}
    for q, near in found.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        assert all(abs(s - score[q] @ score[i]) < 1e-12 for i, s in near)


def test_search_of_few_and_equal_vectors(spark):
    rows = [(k, [1.0, 0.0], 0) for k in range(0, 60)] + [(100, [0.0, 1.0], 0), (101, None, 0), (120, [0.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rank int")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: list(range(1, 21)), 20: list(range(20)), 40: list(range(20)), 100: list(range(20))}
    few = df.where("vec_id in (0, 3, 100)")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(few).orderBy("query_id", "rank").collect()] == [(0, 1, 3, 1.0), (0, 2, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 3, 0.0)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id = 100")).count() == 0


def test_descent_goes_on_until_neighbours_stay(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    x = np.random.default_rng(5).standard_normal((2_500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes = ann.coded(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>"), float(np.abs(x).max()))
    rep = {r.id: r.rep for r in codes.collect()}
    near = {rep[r.a]: [rep[b] for b in r.ids] for r in ann.graph(codes, degree=24, orders=2).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = sum(len(set(np.argsort(-s[k])[:10].tolist()) & set(near[k])) for k in range(len(x)))
    assert hits >= 0.98 * 10 * len(x)
    assert all(len(n) == 24 and len(set(n)) == 24 and k not in n for k, n in near.items())
    assert ann.orders_for(2_000) == ann.orders_for(0) == 12 < ann.orders_for(1 << 24)


def recall(spark, rows, every=20):
    """Share of the true answers' scores that are reached, over all queries."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, every=every).collect():
        got.setdefault(r.query_id, []).append(r.score)
    hits = total = 0
    for dim in {len(v) for _, v in rows}:
        own = [(i, v) for i, v in rows if len(v) == dim]
        x, ids = np.array([v for _, v in own], np.float32).astype(np.float64), np.array([i for i, _ in own])
        for at in np.flatnonzero(ids % every == 0):
            s = np.delete(x @ x[at], at)
            low = np.sort(s)[-min(20, len(s)) :][0]
            assert len(got[int(ids[at])]) == min(20, len(s))
            hits += sum(v >= low - 1e-9 * abs(low) for v in got[int(ids[at])])
            total += min(20, len(s))
    return hits / total


@pytest.mark.parametrize("kind", ["gauss", "unit", "clusters", "lengths"])
def test_recall_over_several_blocks(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((10_000, 32))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "clusters":
        x = rng.standard_normal((200, 32))[rng.integers(0, 200, 10_000)] + 0.2 * x
    if kind == "lengths":
        x *= np.exp(rng.standard_normal((10_000, 1)))
    assert recall(spark, [(k, v.tolist()) for k, v in enumerate(x)]) >= 0.9


def test_recall_of_two_large_dimensions_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(2_500)] + [(10_000 + k, rng.standard_normal(6).tolist()) for k in range(2_300)]
    rows += [(20_000 + k, [0.0] * 7 + [3.0]) for k in range(900)]
    assert recall(spark, rows) >= 0.9


def test_extreme_magnitudes(spark):
    rows = [(k, [1e200 * (k + 1), 1.0]) for k in range(30)] + [(100 + k, [1e-300, 1e-300 * k]) for k in range(30)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id for r in got} == {0, 20, 100, 120} and len(got) == 80


def test_each_dimension_is_searched(spark):
    rng = np.random.default_rng(9)
    parts = {4: range(0, 90), 3: range(90, 150), 2: range(150, 161)}
    rows = [(k, rng.standard_normal(d).astype(np.float32).tolist()) for d, ids in parts.items() for k in ids]
    rows += [(200, rows[100][1]), (220, rows[100][1])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    want = {}
    for d in parts:
        want |= exact([r for r in rows if len(r[1]) == d], 20, 20)
    assert got == {q: [(i, round(s, 9)) for i, s in near] for q, near in want.items()}
    assert len(got[160]) == 10 and {200, 220} <= got.keys()


def test_a_walk_ends_only_when_all_its_best_nodes_are_expanded(spark):
    line = 8
    codes = spark.createDataFrame([(k, ann._codes(np.array([[float(k + 1), 1.0]]) / line)[0]) for k in range(line)], "id long, code binary")
    near = spark.createDataFrame([(k, [k + 1]) for k in range(line - 1)], "a long, ids array<long>")
    ask = np.array([1.0, 0.0], "<f4").tobytes()
    state = spark.createDataFrame([(0, 9, bytearray(ask), [0], [0], b"", b"", b"")], ann._STATE)
    found = ann.search(near, codes, state, beam=2)
    (row,) = found.collect()
    assert sorted(np.frombuffer(row.ids, "<i8").tolist()) == list(range(line)) and row.front == []
    assert [r.id for r in ann.best_seen(found, 2).collect()] == [7, 6]
    assert ann.widened(found, 2).first().front == []


def test_pairs_across_partitions_are_found(spark):
    """All pairs of one group within the window, however small the partitions are."""
    x = np.random.default_rng(8).standard_normal((300, 8))
    x[1::2] = x[::2] + 1e-4
    rows = spark.createDataFrame([("g", k, v.tolist()) for k, v in enumerate(x)], "grp string, id long, v array<double>")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7", "90"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {(min(r.a, r.b), max(r.a, r.b)) for r in vector_dedup.passes(rows, 0.98, turns=3, window=20).collect()}
            assert {(k, k + 1) for k in range(0, 300, 2)} <= got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def sharing_a_direction(count, background, least, seed):
    """Vectors of 64 dimensions with a background cosine, each second one a partner of the one before just above ``least``."""
    rng = np.random.default_rng(seed)
    noise = rng.standard_normal((count, 64))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    common = np.zeros(64)
    common[0] = 1
    x = np.sqrt(background) * common + np.sqrt(1 - background) * noise
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = rng.standard_normal((count // 2, 64))
    base = x[::2]
    turn -= (turn * base).sum(axis=1)[:, None] * base
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    cos = least + 0.0005
    x[1::2] = cos * base + np.sqrt(1 - cos * cos) * turn
    return x


def found_links(spark, x, **more):
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(df, **more).collect()}
    links = np.zeros(len(x), int)
    for at in range(0, len(x), 2_000):
        near = x[at : at + 2_000] @ x.T >= 0.98
        links[at : at + 2_000] = near.sum(axis=1) - 1
    assert all(got[k] <= links[k] for k in range(len(x)))
    return sum(got.values()), int(links.sum())


def test_links_of_vectors_that_share_a_direction(spark):
    found, links = found_links(spark, sharing_a_direction(12_000, 0.94, 0.98, 5))
    assert links >= 12_000 and found >= 0.95 * links


def test_all_pairs_are_the_last_resort(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "MOST_PASSES", 2)
    monkeypatch.setattr(vector_dedup, "CELL", 200)
    found, links = found_links(spark, sharing_a_direction(1_500, 0.94, 0.98, 6), turns=1, window=2)
    assert found == links >= 1_500


def test_recall_tells_what_components_miss(spark):
    rows = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [1.0, 0.01]), ("g", 3, [1.0, 0.02]), ("h", 4, [1.0, 0.0]), ("g", 5, [0.0, 1.0])], "grp string, id long, v array<double>")
    merged = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    assert vector_dedup.recall(rows, merged, 0.98, 10) == (6, 2)


def test_one_outlier_does_not_blot_out_the_others(spark):
    x = np.random.default_rng(12).standard_normal((3_000, 16))
    x[7] *= 1e33
    assert recall(spark, [(k, v.tolist()) for k, v in enumerate(x)]) >= 0.95


def test_queries_are_scanned_where_no_beam_is_wide_enough(spark, monkeypatch):
    monkeypatch.setattr(ann, "TARGET", 1.1)
    monkeypatch.setattr(ann, "SCANNED", 8 * 8 * 10)
    x = np.random.default_rng(13).standard_normal((600, 8))
    x[100:130] = x[100]
    assert recall(spark, [(k, v.tolist()) for k, v in enumerate(x)]) == 1.0


def test_the_check_leaves_out_the_query_itself(spark):
    points = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 6)], "id long, v array<double>")
    asked = points.selectExpr("id as q", "v").where("q in (2, 5)").collect()
    assert ann.floors(points, asked, 2) == {2: (9.0, 2), 5: (16.0, 2)}
    assert ann.floors(points, asked, 9) == {2: (3.0, 4), 5: (6.0, 4)}


def test_a_walk_holds_its_best_nodes_only(spark):
    x = np.random.default_rng(4).standard_normal((600, 8)).astype(np.float32)
    x /= np.abs(x).max()
    codes = spark.createDataFrame(list(enumerate(ann._codes(x))), "id long, code binary")
    near = spark.createDataFrame([(k, np.argsort(-(x @ x[k]))[:12].tolist()) for k in range(600)], "a long, ids array<long>")
    state = spark.createDataFrame([(0, q, bytearray((x[q] / np.abs(x[q]).max()).tobytes()), [q], [q], b"", b"", b"") for q in (7, 300)], ann._STATE)
    told = []
    for keep in ({}, {"keep": 16}):
        rows = ann.search(near, codes, state, beam=8, **keep).orderBy("q").collect()
        assert all(r.front == [] for r in rows)
        told.append([list(zip((-np.frombuffer(r.s, "<f8")).tolist(), np.frombuffer(r.ids, "<i8").tolist(), strict=True)) for r in rows])
    assert all(len(seen) > 16 for seen in told[0])
    assert told[1] == [sorted(seen)[:16] for seen in told[0]]
