import random

from brute import components
from kinweave.llm.components import connected_components


def run(spark, pairs):
    edges = spark.createDataFrame(pairs, "a long, b long")
    return {r["node"]: r["component"] for r in connected_components(edges).collect()}


def test_chain_star_and_random(spark):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(40)]
    loose = [(draw.randrange(2000, 2100), draw.randrange(2000, 2100)) for _ in range(60)]
    pairs = chain + star + loose
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    want = components([p for p in pairs if p[0] != p[1]], nodes)
    assert run(spark, pairs) == want


def test_nulls_loops_repeats_and_empty(spark):
    assert run(spark, [(1, None), (None, 2), (3, 3)]) == {}
    assert run(spark, []) == {}
    assert run(spark, [(5, 4), (4, 5), (5, 4)]) == {4: 4, 5: 4}
