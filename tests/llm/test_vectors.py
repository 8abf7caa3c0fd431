import numpy as np
import pytest

from brute import components
from kinweave.llm import hyperplane_dedup, multi_index

SCHEMA = "vec_id long, embedding array<float>, score double, component_id string"
NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] + [0.0] * 14), (904, [NAN] + [1.0] * 15), (905, [INF] + [1.0] * 15), (906, [1.0, 2.0])]


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.0, "x") for i, v in rows], SCHEMA)


def clustered(seed, n):
    """Random vectors, groups of near copies of very different sizes, and exact copies."""
    draw = np.random.default_rng(seed)
    out = list(draw.normal(size=(n, 16)))
    for size, noise in ((3, 0.1), (60, 0.05), (20, 0.3)):
        base = draw.normal(size=16)
        out += [base + noise * draw.normal(size=16) for _ in range(size)]
    out += [out[5]] * 30 + [2 * out[5]] + [out[7]] * 2
    return [(i, np.float32(v).tolist()) for i, v in enumerate(out)]


def links(rows, cosine):
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = []
    for k, (i, v) in enumerate(usable):
        for j, w in usable[k + 1:]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                pairs.append((i, j))
    return pairs


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_match_brute_force(spark, block):
    rows = clustered(1, 80) + ODD
    pairs = links(rows, 0.9)
    want = components(pairs, [i for i, _ in rows])
    count = {i: 0 for i, _ in rows}
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    got = {r["vec_id"]: r for r in hyperplane_dedup.near_duplicates(table(spark, rows), block=block, recall=0.9999).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == count
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_odd_tables(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, 1.0]), (4, [-0.0, 3.0])]
    got = hyperplane_dedup.near_duplicates(table(spark, rows), recall=0.9999).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got) == [
        (0, 1, 4, False), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (4, 1, 4, True)]
    assert hyperplane_dedup.near_duplicates(table(spark, [])).count() == 0
    assert hyperplane_dedup.near_duplicates(table(spark, ODD[:6])).where("n_links > 0 or component_id <> vec_id").count() == 0


def test_walk_is_the_sorted_order():
    draw = np.random.default_rng(2)
    for _ in range(30):
        a, b = draw.normal(size=draw.integers(1, 9)), draw.normal(size=draw.integers(1, 9))
        counts = draw.integers(0, 4, (len(a), len(b)))
        got = multi_index.walk(a, b, counts, int(counts.sum()) + 1)
        sums = [a[i] + b[j] for i, j in got]
        assert sums == sorted(sums) and set(got) == {(i, j) for i in range(len(a)) for j in range(len(b)) if counts[i, j]}
        if counts.sum() > 2:
            some = multi_index.walk(a, b, counts, 2)
            assert some == got[:len(some)] and sum(counts[c] for c in some[:-1]) < 2 <= sum(counts[c] for c in some)


def nearest(rows, top):
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 16]
    out = {}
    for i, q in usable:
        if i % 20 == 0:
            out[i] = sorted(((-float((q * v).sum()), j) for j, v in usable if j != i))[:top]
    return out


def test_search_finds_the_nearest(spark):
    rows = clustered(3, 300) + ODD
    want = nearest(rows, 20)
    got = {}
    for r in multi_index.search(table(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    vectors = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [rank for rank, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(np.isclose(s, np.dot(vectors[q], vectors[i]), atol=1e-9) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.93


def test_exact_copies_and_small_tables(spark):
    """Copies outnumber the asked neighbours; ties go to smaller ids; few candidates give few rows."""
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(60, [0.0, 1.0])]
    got = multi_index.search(table(spark, rows)).collect()
    for q in (0, 20, 40, 60):
        found = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert found == [i for i in range(50) if i != q][:20]
    few = multi_index.search(table(spark, [(0, [1.0, 1.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0])])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 3, 3.0), (0, 2, 3, 3.0)]
    assert multi_index.search(table(spark, [])).count() == 0
    assert multi_index.search(table(spark, [(0, [1.0, 1.0])])).count() == 0


def test_every_length_is_searched(spark):
    """Lengths, however rare, have their own neighbours; clumps and lone vectors get whole lists."""
    draw = np.random.default_rng(4)
    rows = [(i, v) for i, v in clustered(5, 200)]
    clumps = [draw.normal(size=6) for _ in range(4)]
    rows += [(1000 + i, clumps[i % 4] + 1e-4 * draw.normal(size=6)) for i in range(300)] + [(1300, -5 * clumps[0])]
    rows += [(2000 + i, [float(i + 1)]) for i in range(41)] + [(3000, [1.0, 2.0, 3.0])] + ODD[:6]
    got = {}
    for r in multi_index.search(table(spark, rows), depth_recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    usable = {i: np.float32(v).astype(float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    hits = total = 0
    for q in (i for i in usable if i % 20 == 0):
        others = sorted((-float((usable[q] * v).sum()), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:20]
        found = [i for _, i in sorted(got.get(q, []))]
        assert len(found) == len(others), q
        hits, total = hits + len(set(found) & {i for _, i in others}), total + len(others)
    assert hits / total >= 0.97 and 3000 not in got


def test_products_are_taken_of_met_rows_alone():
    """Rows of a cell meet only the queries that walked there."""
    draw = np.random.default_rng(6)
    queries, vectors = draw.normal(size=(9, 4)), draw.normal(size=(30, 4))
    met = [(np.array([0, 3, 8]), 0, 11), (np.array([3]), 11, 12), (np.array([], dtype=int), 12, 30)]
    q, r, score = multi_index._best(queries, np.full(9, -1), vectors, np.arange(30), np.arange(30), met, 5)
    assert set(q) == {0, 3, 8} and set(r) <= set(range(12)) and 11 not in set(r[q != 3])
    for k in (0, 3, 8):
        rows = list(range(12 if k == 3 else 11))
        assert r[q == k].tolist() == sorted(rows, key=lambda j: -queries[k] @ vectors[j])[:5]
        assert np.allclose(score[q == k], sorted((queries[k] @ vectors[rows].T).tolist())[::-1][:5])
