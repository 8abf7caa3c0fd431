"""Ranked search against scores of every document and item."""

import math
import random
from collections import Counter

from kinweave.llm import lemp_search


def plain(docs, items, top):
    held = [(i, Counter(lemp_search.terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(lemp_search.terms(t))
    out = []
    for item, asked in wanted.items():
        scores = []
        for doc, c in held:
            m = 50 + 50 * c.total() * n_docs // n_terms
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    left = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in docs], "doc_id long, text string, term string, n long, length double")
    right = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, tid string, item long")
    got = lemp_search.search(left.repartition(3), right, **options)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=str)


def texts(rng, n, longest):
    words = [f"w{k}" for k in range(200)] + ["É", "é", "x" * 3000]
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=int(longest ** rng.random()))) for _ in range(n)]


def test_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(3)
    docs = [(i, t) for i, t in enumerate(texts(rng, 60, 400))] + [(7, "w1 W2 w3")] * 9 + [(None, "w1 w2 w3"), (90, None), (91, ""), (92, "..., \x7f")]
    items = [(i, t) for i, t in enumerate(texts(rng, 6, 40))] + [(1, "w3 w199"), (None, "W2"), (50, None), (51, "--"), (52, "nowhere")]
    assert run(spark, docs, items, top=5) == plain(docs, items, 5)


def test_small_tiles_rounds_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lemp_search, "TILE_ENTRIES", 40)
    monkeypatch.setattr(lemp_search, "QUERY_BLOCK", 2)
    rng = random.Random(5)
    docs, items = list(enumerate(texts(rng, 150, 300))), list(enumerate(texts(rng, 5, 30)))
    assert run(spark, docs, items, top=10) == plain(docs, items, 10)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "w1")]) == [] and run(spark, [(1, "w1 w2")], []) == []
    assert run(spark, [(1, None)], [(1, "w1")]) == []


def test_bounds_leave_few_vectors_to_score(spark):
    rng = random.Random(8)
    import numpy as np
    import pyarrow as pa

    n, size = 4000, 12
    tids = [sorted(rng.sample(range(300), size)) for _ in range(n)]
    tids[17] = list(range(size))
    weights = np.arange(300, dtype=np.int64)[::-1] * 10 + 1000
    impacts = [[333_333] * size for _ in range(n)]
    lengths = [math.sqrt(sum(weights[t] * 333_333.0**2 for t in row)) for row in tids]
    tile = lemp_search.Tile(pa.table({"doc_id": pa.array(range(n)), "length": pa.array(lengths), "tids": pa.array(tids, pa.list_(pa.int64())), "impacts": pa.array(impacts, pa.list_(pa.int64()))}))
    asked = np.arange(size)
    least = int((weights[:size] * 333_333).sum() * 0.6)
    best, scores, scored = tile.search(asked, weights[:size], least, 50)
    assert tile.docs[best[0]] == 17 and scores[0] == (weights[:size] * 333_333).sum() and scored < n / 50
