import random

from brute import components, simhash, simhash_groups
from kinweave.llm import simhash_popcount as sp

SCHEMA = "doc_id long, text string, fp string, component_id int"


def test_fingerprints_match_brute_force():
    for text in ["", None, " \t\n", "A", "a b", "One two THREE", "É é Ü x\x0by\x0cz", "w " * 3000, "ab cd ef gh ab cd ef"]:
        assert sp.fingerprint(text) == simhash(text)


def test_components_match_brute_force(spark):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(60):
        base = [draw.choice(words) for _ in range(draw.choice([2, 30, 400]))]
        for _ in range(draw.choice([1, 1, 4])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "  ")]
    prints, want = simhash_groups(docs)
    got = sp.components(spark.createDataFrame([(i, t, "x", 7) for i, t in docs], SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}


def test_crowded_cells_lose_no_link(spark):
    """Fingerprints around one centre: cells hold far more members than are paired directly."""
    draw = random.Random(2)
    centre = draw.getrandbits(64)
    prints = {centre}
    while len(prints) < 250:
        flipped = centre
        for _ in range(draw.choice([1, 2, 3, 5, 6])):
            flipped ^= 1 << draw.randrange(8 if draw.random() < 0.7 else 64)
        prints.add(flipped)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = {(r["a"], r["b"]) for r in sp._links(sp._cells(fps)).collect()}
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in links)
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2]
    assert components(links, signed) == components(near, signed)


def test_keep_first(spark):
    long = " ".join(f"t{i}" for i in range(100))
    rows = [(3, long, "a", 1), (1, long, "b", 2), (1, long, "b", 2), (2, "other text here", "c", 3), (None, "alone in the world", "d", 4),
            (None, long, "e", 5), (None, "alone in the world", "f", 6)]
    kept = sp.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "alone in the world"), (1, long), (2, "other text here")]
    clash = spark.createDataFrame([(i, t, 9, "x") for i, t, _, _ in rows], "doc_id long, text string, _fp int, lone string")
    assert sp.keep_first(clash).columns == ["doc_id", "text", "_fp", "lone"] and sp.keep_first(clash).count() == 3
    empty = spark.createDataFrame([], SCHEMA)
    assert sp.components(empty).count() == 0 and sp.keep_first(empty).count() == 0
