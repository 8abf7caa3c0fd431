"""Best comparator of the names of a pair: distinct value sets are scored once, bounds spare the rest."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.config import Comparators
from kinweave.functions.similarity import similarity_values
from kinweave.functions.text import phonetic

# Names reported for the comparators.
LABELS = {
    "Exact": "exact",
    "JaroWinkler": "jaro-winkler",
    "NormalisedDamerauLevenshtein": "normalised-damerau-levenshtein",
    "DiceCoefficient": "dice-coefficient",
    "Phonetic": "phonetic",
    "Nickname": "nickname",
}
_BATCHED = ("JaroWinkler", "NormalisedDamerauLevenshtein")
_ITEM, _CODE = "\x01", "\x02"
RESULT = "struct<sim:double,comparator:string,detail:string,pairs:long>"
#: Pairs of value sets a worker remembers; at more it begins anew, which changes no result.
REMEMBERED = 500_000
#: Value sets that make more pairs are scored by falling bounds.
FEW = 64
_CELLS = 1 << 22


def families(names: Column, with_codes: bool) -> Column:
    """The family names of a profile, with their codes if asked for, as one text."""
    one = lambda n: F.concat(n["family"], F.lit(_CODE), n["phonetic"]) if with_codes else n["family"]
    return F.when(F.size(names) == 1, one(names[0])).when(F.size(names) > 1, F.array_join(F.transform(names, one), _ITEM))


def givens(names: Column, with_codes: bool) -> Column:
    """All given names of a profile as one text; null where there are none."""
    values = F.when(F.size(names) == 1, names[0]["given"]).otherwise(F.flatten(F.transform(names, lambda n: n["given"])))
    if with_codes:
        values = F.transform(values, lambda g: F.concat(g, F.lit(_CODE), phonetic(g)))
    return F.when(F.size(values) > 0, F.array_join(values, _ITEM))


def dice(left: str, right: str) -> float:
    """Dice coefficient over bigram multisets."""
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    if len(left) == 1 or len(right) == 1:
        return 0.0
    grams = [Counter(x[i:i + 2] for i in range(len(x) - 1)) for x in (left, right)]
    return 2.0 * (grams[0] & grams[1]).total() / (len(left) + len(right) - 2)


def bounds(lefts: list[str], rights: list[str], kind: str) -> np.ndarray:
    """What Jaro-Winkler or edit similarity can reach at most, from lengths, letters and beginnings."""
    letters = {c: k for k, c in enumerate(sorted(set("".join(lefts + rights))))}

    def counts(values):
        table = np.zeros((len(values), max(len(letters), 1)), dtype=np.int32)
        for k, value in enumerate(values):
            for c, n in Counter(value).items():
                table[k, letters[c]] = n
        return table, np.array([len(v) for v in values], dtype=np.float64)

    (a, a_len), (b, b_len) = counts(lefts), counts(rights)
    shared = np.empty((len(lefts), len(rights)))
    step = max(1, _CELLS // max(b.size, 1))
    for k in range(0, len(lefts), step):
        shared[k:k + step] = np.minimum(a[k:k + step, None, :], b[None]).sum(axis=2)
    longest = np.maximum(a_len[:, None], b_len[None])
    if kind == "NormalisedDamerauLevenshtein":
        return shared / np.maximum(longest, 1)
    jaro = np.where(shared > 0, (shared / np.maximum(a_len, 1)[:, None] + shared / np.maximum(b_len, 1)[None] + 1) / 3, 0)
    begins = np.zeros_like(shared)
    same = np.ones(shared.shape, dtype=bool)
    for k in range(4):
        own = [np.array([v[k:k + 1] for v in values], dtype=object) for values in (lefts, rights)]
        same &= (own[0][:, None] == own[1][None]) & (own[0][:, None] != "")
        begins += same
    return jaro + begins * 0.1 * (1 - jaro)


class Scorer:
    """Scores pairs of value sets; ``compared`` counts exact string comparisons."""

    def __init__(self, kinds: tuple[str, ...], comparators: Comparators, skip_empty: bool):
        self.kinds, self.rules, self.skip_empty = kinds, comparators, skip_empty
        self.batched = [k for k in kinds if k in _BATCHED]
        self.lexicons = [(dict(x.groups), f"{x.culture}/{x.version}") for x in comparators.lexicons]
        self.known: dict[tuple[str, str], tuple] = {}
        self.compared = 0

    def _light(self, kind: str, left: tuple, right: tuple) -> tuple[float, str | None]:
        (l, lp), (r, rp) = left, right
        if kind == "Exact":
            return (1.0 if l == r else 0.0), None
        if kind == "DiceCoefficient":
            return dice(l, r), None
        if kind == "Phonetic":
            return (self.rules.phonetic_floor, f"shared-code:{lp}") if lp and lp == rp else (0.0, None)
        for groups, name in self.lexicons:
            group = groups.get(l)
            if group is not None and group == groups.get(r):
                return self.rules.nickname_floor, name
        return 0.0, None

    def _judge(self, left: tuple, right: tuple, heavy: dict[str, float]) -> tuple[float, str, str | None]:
        best = None
        for kind in self.kinds:
            sim, detail = (heavy[kind], None) if kind in heavy else self._light(kind, left, right)
            if best is None or sim > best[0]:
                best = (sim, LABELS[kind], detail)
        return best

    def _values(self, text: str) -> list[tuple[str, str]]:
        parts = [tuple((v.split(_CODE) + [""])[:2]) for v in text.split(_ITEM)]
        return [p for p in parts if p[0] or not self.skip_empty]

    def _exact(self, pairs: list[tuple]) -> list[dict[str, float]]:
        scores = {k: similarity_values([a[0] for a, _ in pairs], [b[0] for _, b in pairs], k).tolist() for k in self.batched}
        self.compared += len(pairs) * len(self.batched)
        return [{k: scores[k][i] for k in self.batched} for i in range(len(pairs))]

    def _many(self, lefts: list[tuple], rights: list[tuple]) -> tuple:
        """Best pair of large sets; of equals the first. Pairs are scored as their bounds fall."""
        at_l, at_r = ({}, {})
        for values, at in ((lefts, at_l), (rights, at_r)):
            for k, v in enumerate(values):
                at.setdefault(v, k)
        ls, rs = list(at_l), list(at_r)
        high = np.zeros((len(ls), len(rs)))
        for kind in self.batched:
            np.maximum(high, bounds([v for v, _ in ls], [v for v, _ in rs], kind), out=high)
        light = [k for k in self.kinds if k not in self.batched]
        if light:
            held = max(1.0 if k in ("Exact", "DiceCoefficient") else self.rules.phonetic_floor if k == "Phonetic" else self.rules.nickname_floor for k in light)
            np.maximum(high, held, out=high)
        order = np.argsort(-high, axis=None, kind="stable")
        best, place, step = (0.0, "none", None), None, FEW
        for start in range(0, len(order), step):
            chunk = order[start:start + step]
            chunk = chunk[high.flat[chunk] >= best[0] - 1e-9]
            if not len(chunk):
                break
            pairs = [(ls[k // len(rs)], rs[k % len(rs)]) for k in chunk.tolist()]
            for (a, b), heavy in zip(pairs, self._exact(pairs)):
                found, here = self._judge(a, b, heavy), (at_l[a], at_r[b])
                if found[0] > best[0] or (found[0] == best[0] and place is not None and here < place):
                    best, place = found, here
        return (*best, len(lefts) * len(rights))

    def score(self, asked: list[tuple[str, str]]) -> list[tuple]:
        """(sim, comparator, detail, pairs) of every pair of joined value sets."""
        fresh = [p for p in dict.fromkeys(asked) if p not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = list(dict.fromkeys(asked))
        small: list[tuple] = []
        for pair in fresh:
            lefts, rights = self._values(pair[0]), self._values(pair[1])
            if len(lefts) * len(rights) > FEW:
                self.known[pair] = self._many(lefts, rights)
            else:
                small.append((pair, [(a, b) for a in lefts for b in rights]))
        crossed = dict.fromkeys(x for _, made in small for x in made)
        heavy = dict(zip(crossed, self._exact(list(crossed))))
        for pair, made in small:
            best = (0.0, "none", None)
            for a, b in made:
                found = self._judge(a, b, heavy[a, b])
                if found[0] > best[0]:
                    best = found
            self.known[pair] = (*best, len(made))
        return [self.known[p] for p in asked]


def _scored(scorer: Scorer, left: pa.Array, right: pa.Array) -> pa.StructArray:
    """One result a row, null where a side is null; equal pairs of a batch are looked up once."""
    a, b = (x.fill_null("").dictionary_encode() for x in (left, right))
    none = (left.is_null().to_numpy(zero_copy_only=False)) | (right.is_null().to_numpy(zero_copy_only=False))
    width = max(len(b.dictionary), 1)
    code = a.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + b.indices.to_numpy(zero_copy_only=False)
    distinct, back = np.unique(np.where(none, -1, code), return_inverse=True)
    start = int(bool(len(distinct)) and distinct[0] < 0)
    lefts, rights = a.dictionary.to_pylist(), b.dictionary.to_pylist()
    found = [(0.0, "none", None, 0)] * start + scorer.score([(lefts[k // width], rights[k % width]) for k in distinct[start:].tolist()])
    columns = list(zip(*found)) if found else [[], [], [], []]
    kinds = (pa.float64(), pa.string(), pa.string(), pa.int64())
    at = pa.array(back)
    return pa.StructArray.from_arrays([pa.array(c, k).take(at) for c, k in zip(columns, kinds)], names=["sim", "comparator", "detail", "pairs"])


def best_names(left: Column, right: Column, rules: Comparators) -> Column:
    """struct<family, given>: the best result of every pair's family and given names, ties to the earlier."""
    scorers: list[Scorer] = []

    @F.arrow_udf(f"struct<family:{RESULT},given:{RESULT}>")
    def scored(fl: pa.Array, fr: pa.Array, gl: pa.Array, gr: pa.Array) -> pa.Array:
        if not scorers:
            scorers.extend((Scorer(rules.family, rules, True), Scorer(rules.given, rules, False)))
        return pa.StructArray.from_arrays([_scored(scorers[0], fl, fr), _scored(scorers[1], gl, gr)], names=["family", "given"])

    codes = ["Phonetic" in kinds for kinds in (rules.family, rules.given)]
    sides = [made(side["names"], coded) for made, coded in ((families, codes[0]), (givens, codes[1])) for side in (left, right)]
    return scored.asNondeterministic()(*sides)
