"""String comparators. Arrow UDFs run on whole batches with numpy; the others are expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CELLS = 4_000_000  # working-set bound of one vectorised step


def _code_units(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text as a matrix of UTF-16 code units, with lengths."""
    if any(not value.isascii() for value in values):
        values = [
            value
            if max(value, default="") <= "\uffff"
            else "".join(
                chr(unit) for unit in np.frombuffer(value.encode("utf-16-le", "surrogatepass"), "<u2")
            )
            for value in values
        ]
    lengths = np.fromiter((len(value) for value in values), dtype=np.int64, count=len(values))
    width = max(int(lengths.max(initial=0)), 1)
    matrix = np.array(values, dtype=f"U{width}").view(np.uint32).reshape(len(values), width)
    return matrix, lengths


def _jaro_winkler_block(first: list[str], second: list[str]) -> np.ndarray:
    """Jaro with unfloored half transpositions, and the prefix boost always applied."""
    a, a_len = _code_units(first)
    b, b_len = _code_units(second)
    n = len(first)
    reach = np.maximum(a_len, b_len) // 2 - 1
    a_hit = np.zeros(a.shape, dtype=bool)
    b_hit = np.zeros(b.shape, dtype=bool)
    column = np.arange(b.shape[1])
    rows = np.arange(n)
    for i in range(a.shape[1]):
        low = np.maximum(0, i - reach)
        high = np.minimum(i + reach + 1, b_len)
        allowed = (
            (column >= low[:, None])
            & (column < high[:, None])
            & ~b_hit
            & (b == a[:, i, None])
            & (i < a_len)[:, None]
        )
        where = allowed.argmax(axis=1)
        found = allowed[rows, where]
        a_hit[:, i] = found
        b_hit[rows[found], where[found]] = True
    matches = a_hit.sum(axis=1)
    # Matched characters of both sides, in order, packed to the left.
    width = max(int(matches.max(initial=0)), 1)
    a_order = np.zeros((n, width), dtype=np.uint32)
    b_order = np.zeros((n, width), dtype=np.uint32)
    at, pos = np.nonzero(a_hit)
    a_order[at, (np.cumsum(a_hit, axis=1) - 1)[at, pos]] = a[at, pos]
    at, pos = np.nonzero(b_hit)
    b_order[at, (np.cumsum(b_hit, axis=1) - 1)[at, pos]] = b[at, pos]
    swapped = (a_order != b_order).sum(axis=1)
    shared = min(4, a.shape[1], b.shape[1])
    limit = np.minimum(np.minimum(a_len, b_len), 4)
    same = (a[:, :shared] == b[:, :shared]) & (np.arange(shared) < limit[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = matches.astype(np.float64)
        jaro = (m / a_len + m / b_len + (m - swapped / 2.0) / m) / 3.0
        score = jaro + prefix * 0.1 * (1 - jaro)
    return np.where(matches > 0, score, 0.0)


def _osa_block(first: list[str], second: list[str]) -> np.ndarray:
    """1 - restricted Damerau-Levenshtein distance / longer length."""
    a, a_len = _code_units(first)
    b, b_len = _code_units(second)
    n, width = len(first), b.shape[1]
    before = np.zeros((n, width + 1), dtype=np.int32)
    above = np.tile(np.arange(width + 1, dtype=np.int32), (n, 1))
    distance = np.where(a_len == 0, b_len, 0).astype(np.int32)
    rows = np.arange(n)
    for i in range(1, a.shape[1] + 1):
        line = np.empty_like(above)
        line[:, 0] = i
        for j in range(1, width + 1):
            cost = (a[:, i - 1] != b[:, j - 1]).astype(np.int32)
            best = np.minimum(
                np.minimum(above[:, j], line[:, j - 1]) + 1, above[:, j - 1] + cost
            )
            if i > 1 and j > 1:
                crossed = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(crossed, np.minimum(best, before[:, j - 2] + 1), best)
            line[:, j] = best
        distance = np.where(a_len == i, line[rows, b_len], distance)
        before, above = above, line
    return 1 - distance / np.maximum(np.maximum(a_len, b_len), 1)


def _by_length(first: list[str], second: list[str], block) -> np.ndarray:
    """Run ``block`` over pairs of like length, a bounded number of cells at a time."""
    n = len(first)
    out = np.zeros(n)
    longest = np.fromiter(
        (max(len(x), len(y)) for x, y in zip(first, second)), dtype=np.int64, count=n
    )
    order = np.argsort(longest, kind="stable")
    start = 0
    while start < n:
        width = max(8, int(2 ** np.ceil(np.log2(max(longest[order[start]], 1)))))
        stop = int(np.searchsorted(longest[order], width, side="right"))
        stop = min(max(stop, start + 1), start + max(1, _CELLS // (width * 2)))
        chosen = order[start:stop]
        out[chosen] = block([first[k] for k in chosen], [second[k] for k in chosen])
        start = stop
    return out


def similarity_values(first: list[str], second: list[str], kind: str) -> np.ndarray:
    """Similarity of aligned lists; empty text scores 0 and equal text 1."""
    block = {"JaroWinkler": _jaro_winkler_block, "NormalisedDamerauLevenshtein": _osa_block}[kind]
    out = np.zeros(len(first))
    todo = []
    for k, (x, y) in enumerate(zip(first, second)):
        if x and y:
            if x == y:
                out[k] = 1.0
            else:
                todo.append(k)
    if todo:
        out[todo] = _by_length([first[k] for k in todo], [second[k] for k in todo], block)
    return out


def _flat_pairs(values: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    flat = values.flatten()
    return flat.field("l"), flat.field("r")


def _like(values: pa.ListArray, flat: pa.Array) -> pa.ListArray:
    lengths = pc.fill_null(pc.list_value_length(values), 0)
    offsets = np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _batch_similarity(values: pa.Array, kind: str) -> pa.Array:
    left, right = _flat_pairs(values)
    if len(left) == 0:
        return _like(values, pa.array([], pa.float64()))
    left = left.dictionary_encode()
    right = right.dictionary_encode()
    width = max(len(right.dictionary), 1)
    code = (
        left.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width
        + right.indices.to_numpy(zero_copy_only=False)
    )
    distinct, back = np.unique(code, return_inverse=True)
    left_text = left.dictionary.to_pylist()
    right_text = right.dictionary.to_pylist()
    scores = similarity_values(
        [left_text[k] for k in distinct // width], [right_text[k] for k in distinct % width], kind
    )
    return _like(values, pa.array(scores[back]))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def jaro_winkler_pairs(values: pa.Array) -> pa.Array:
    return _batch_similarity(values, "JaroWinkler")


jaro_winkler_pairs = jaro_winkler_pairs.asNondeterministic()


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def osa_pairs(values: pa.Array) -> pa.Array:
    return _batch_similarity(values, "NormalisedDamerauLevenshtein")


osa_pairs = osa_pairs.asNondeterministic()


def _single(kind):
    def made(left: Column, right: Column) -> Column:
        pair = F.array(F.struct(left.alias("l"), right.alias("r")))
        return F.get(kind(pair), F.lit(0))

    return made


def jaro_winkler(left: Column, right: Column) -> Column:
    return _single(jaro_winkler_pairs)(left, right)


def osa_similarity(left: Column, right: Column) -> Column:
    return _single(osa_pairs)(left, right)


def exact(left: Column, right: Column) -> Column:
    return F.when(left == right, 1.0).otherwise(0.0)


def token_jaccard_sets(left: Column, right: Column) -> Column:
    """Jaccard of two arrays of distinct tokens."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union > 0, shared.cast("double") / union).otherwise(0.0)


def token_jaccard(left: Column, right: Column) -> Column:
    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))

    return token_jaccard_sets(words(left), words(right))


def _bigrams(c: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))
    )


def dice(left: Column, right: Column) -> Column:
    """Dice coefficient over bigram multisets."""
    a, b = _bigrams(left), _bigrams(right)

    def shared(gram: Column) -> Column:
        return F.least(
            F.size(F.filter(a, lambda x: x == gram)), F.size(F.filter(b, lambda x: x == gram))
        )

    common = F.aggregate(
        F.transform(F.array_intersect(a, b), shared), F.lit(0), lambda acc, x: acc + x
    )
    total = F.length(left) + F.length(right) - 2
    return (
        F.when((left == "") | (right == ""), 0.0)
        .when(left == right, 1.0)
        .when((F.length(left) == 1) | (F.length(right) == 1), 0.0)
        .otherwise(F.lit(2.0) * common / total)
    )


def register(spark) -> None:
    """Make the Arrow comparators callable from SQL."""
    spark.udf.register("kw_jaro_winkler_pairs", jaro_winkler_pairs)
    spark.udf.register("kw_osa_pairs", osa_pairs)
