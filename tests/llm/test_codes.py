"""Codes of vector parts against plain loops over every entry."""

import hashlib

import numpy as np

from kinweave.llm import laesa_codes


def plain(rows, parts=16, entries=64, rounds=2):
    """{(id, vector): (code, error)}, digest; rows of one length, by the definition."""
    kept = sorted(((i, np.floor(256 * np.array(v, dtype=float)).astype(int).tolist()) for i, v in rows), key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    dim = len(kept[0][1])
    cuts = [(j * dim // parts, (j + 1) * dim // parts) for j in range(parts)]
    books = [[v[a:b] for _, v in kept[:entries]] for a, b in cuts]

    def assign():
        out = []
        for _, v in kept:
            gaps = [[sum((x - y) ** 2 for x, y in zip(v[a:b], e)) for e in books[j]] for j, (a, b) in enumerate(cuts)]
            out.append(([g.index(min(g)) for g in gaps], sum(map(min, gaps))))
        return out

    for _ in range(rounds):
        codes = assign()
        for j, (a, b) in enumerate(cuts):
            for e in range(len(books[j])):
                held = [v[a:b] for (_, v), (c, _) in zip(kept, codes) if c[j] == e]
                if held:
                    books[j][e] = [sum(column) // len(held) for column in zip(*held)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(("".join(f"{c:02x}" for c in code), error) for code, error in assign()), digest


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, dim string, to_pivots int")


def test_codes_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = [np.round(rng.normal(size=35) * 2) / 8 for _ in range(120)]  # many ties; 16 does not divide 35
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5, vectors[5].tolist())] * 30 + [(None, vectors[6].tolist())]
    odd = [(900, None), (901, [None] * 35), (902, [float("nan")] + [0.0] * 34), (903, [float("inf")] * 35)]
    short = [(i, [0.25 * i]) for i in range(3)] + [(77, [])]
    made = frame(spark, [(i, v, (i or 0) % 3 if (i or 0) % 4 else None, "x", "y", 1) for i, v in rows + odd + short])
    got = laesa_codes.encode(made.repartition(3)).collect()
    want, digest = plain(rows)
    long_ = [r for r in got if r["codebooks_sha256"] == digest]
    assert sorted((r["code"], r["error"]) for r in long_) == want
    assert len(got) == len(rows) + len(short)
    want, digest = plain(short[:3])
    assert sorted((r["code"], r["error"]) for r in got if r["codebooks_sha256"] == digest) == want
    for label in (None, 0, 1, 2):
        of = [r for r in got if ((r["vec_id"] or 0) % 3 if (r["vec_id"] or 0) % 4 else None) == label]
        assert {r["label_error"] for r in of} == {sum(r["error"] for r in of)}


def test_extremes_are_held_and_empty_tables_stay_empty(spark):
    got = laesa_codes.encode(frame(spark, [(1, [1e308] * 32, 0, "", "", 0), (2, [-1e308] * 32, 0, "", "", 0), (3, [0.5] * 32, 0, "", "", 0)])).collect()
    assert len(got) == 3 and all(r["error"] == 0 for r in got)
    assert laesa_codes.encode(frame(spark, [])).count() == 0
    assert laesa_codes.encode(frame(spark, [(1, None, 0, "", "", 0)])).count() == 0


def test_pivots_prune_and_lose_nothing():
    rng = np.random.default_rng(9)
    points = (rng.normal(size=(3000, 4)) * 60).astype(np.int64)
    entries = points[:64]
    pivots = laesa_codes.spread_pivots(entries)
    near = laesa_codes.distances(points, pivots).astype("<f4")
    codes, squared, tried = laesa_codes.nearest(points, near, entries, pivots)
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (codes == every.argmin(axis=1)).all() and (squared == every.min(axis=1)).all()
    assert tried < 0.25 * every.size
