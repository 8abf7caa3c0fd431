"""Best names of a pair against every comparison, and how many the bounds spare."""

import random

import numpy as np
import pytest

from kinweave.config import Comparators
from kinweave.functions.similarity import similarity_values
from kinweave.operators.name_scores import LABELS, Scorer, bounds
from kinweave.sources import derived


def names(draw, n):
    parts = ["AN", "BE", "CAR", "DO", "EL", "FRI", "GO", "HA", "IR", "JU", "KA", "LU", "MI", "NO", "OL"]
    return ["".join(draw.choices(parts, k=draw.choice([1, 2, 3, 4]))) + draw.choice(["", "", "É"]) for _ in range(n)]


def every(scorer, left, right):
    best = (0.0, "none", None)
    for a in scorer._values(left):
        for b in scorer._values(right):
            heavy = {k: similarity_values([a[0]], [b[0]], k)[0] for k in scorer.batched}
            found = scorer._judge(a, b, heavy)
            if found[0] > best[0]:
                best = found
    return best


@pytest.mark.parametrize("kind", ["JaroWinkler", "NormalisedDamerauLevenshtein"])
def test_bounds_are_never_below_the_score(kind):
    draw = random.Random(1)
    a, b = names(draw, 80) + ["", "A"], names(draw, 70) + ["", "AN"]
    exact = np.array([similarity_values([x] * len(b), b, kind) for x in a])
    assert (bounds(a, b, kind) >= exact - 1e-9).all()


@pytest.mark.parametrize("kinds", [("JaroWinkler",), ("JaroWinkler", "Phonetic"), ("NormalisedDamerauLevenshtein", "Nickname", "DiceCoefficient")])
def test_large_sets_equal_every_comparison_with_few(kinds):
    draw = random.Random(2)
    rules = Comparators(given=kinds, lexicons=derived.demo_config().profile.comparators.lexicons)
    coded = lambda values: "\x01".join(f"{v}\x02{v[:1]}" for v in values)
    scorer = Scorer(kinds, rules, False)
    for size in (12, 200):
        left, right = coded(f"Q{x}X" for x in names(draw, size)), coded(f"{x}Z" for x in names(draw, size))
        scorer.compared = 0
        got = scorer.score([(left, right)])[0]
        assert got[:3] == pytest.approx(every(scorer, left, right)) if size == 12 else got[0] == pytest.approx(every(scorer, left, right)[0])
        assert got[3] == size * size
    if kinds == ("JaroWinkler",):
        assert 0 < scorer.compared < size * size / 4
    assert set(LABELS) >= set(kinds)


def test_ties_keep_the_earlier_pair_and_the_earlier_comparator():
    scorer = Scorer(("Exact", "JaroWinkler"), Comparators(), True)
    assert scorer.score([("AB\x01CD", "CD\x01AB"), ("", "AB"), ("AB", "XY")]) == [(1.0, "exact", None, 4), (0.0, "none", None, 0), (0.0, "none", None, 1)]
