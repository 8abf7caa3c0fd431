"""Codes of vector parts: integer codebooks whose nearest entries are searched by fixed pivots (LAESA)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import stage

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
#: A component x becomes floor(SCALE * x).
SCALE = 256
_SLICE = 4096
#: Distances to pivots are kept as 32-bit floats; bounds give way by what rounding can add.
_SLACK = 4e-7


def largest(dim: int) -> int:
    """Integers are held within this bound, so that no sum of squared differences leaves 64 bits."""
    return int(min(math.isqrt((1 << 60) // max(dim, 1)), 1 << 27))


def integers(vector) -> bytes | None:
    """floor(256 x) of every component as 32-bit integers; None if null or with a null or non-finite part."""
    if vector is None:
        return None
    try:
        values = np.asarray(vector, dtype=np.float64)
    except (TypeError, ValueError):
        return None
    if not np.isfinite(values).all():
        return None
    bound = largest(len(values))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -bound, bound).astype("<i4").tobytes()


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``left`` to all of ``right``, integers in, floats out."""
    gaps = left[:, None, :].astype(np.float64) - right[None, :, :]
    return np.sqrt((gaps * gaps).sum(axis=2))


def spread_pivots(entries: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Rows of ``entries`` far from each other: the first, then ever the one farthest from those taken."""
    taken, near = [0], distances(entries, entries[:1])[:, 0]
    while len(taken) < min(pivots, len(entries)):
        taken.append(int(near.argmax()))
        near = np.minimum(near, distances(entries, entries[taken[-1:]])[:, 0])
    return entries[taken]


def nearest(points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of every point, ties to the lower entry, and how many distances it took.

    |d(point, pivot) - d(entry, pivot)| bounds d(point, entry) from below. Entries are taken by that
    bound: the two lowest first, then, of the rest, those whose bound does not pass the best so far.
    """
    n, m = len(points), len(entries)
    rows = np.arange(n)
    entry_pivots = distances(entries, pivots).astype(np.float32)
    low = np.zeros((n, m), dtype=np.float32)
    for k in range(len(pivots)):
        np.maximum(low, np.abs(to_pivots[:, k, None] - entry_pivots[None, :, k]), out=low)
    low -= np.float32(_SLACK) * (to_pivots.max(axis=1, initial=0)[:, None] + entry_pivots.max(initial=0))
    np.maximum(low, 0, out=low)
    low *= low
    low *= np.float32(1 - 1e-6)

    def exact(at, entry):
        gaps = points[at] - entries[entry]
        return (gaps * gaps).sum(axis=1)

    first = low.argmin(axis=1)
    best = exact(rows, first)
    held = low[rows, first]
    low[rows, first] = np.inf
    second = low.argmin(axis=1)
    tried = n
    worth = np.flatnonzero((low[rows, second] <= best) & (second != first))
    got = exact(worth, second[worth])
    tried += len(worth)
    best[worth] = np.minimum(best[worth], got)
    low[rows, first] = held
    at, entry = np.nonzero(low <= best[:, None])
    every = exact(at, entry)
    tried += len(at) - n
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    least = np.minimum.reduceat(every, starts)
    hits = np.flatnonzero(every == least[at])
    _, firsts = np.unique(at[hits], return_index=True)
    return entry[hits[firsts]], least, tried


class Codebooks:
    """Entries and pivots of every part of vectors of one length; at most ENTRIES x length integers."""

    def __init__(self, dim: int, entries: np.ndarray, parts: int = PARTS, pivots: int = PIVOTS):
        self.cuts = cuts(dim, parts)
        self.entries = entries.astype(np.int64)
        self.pivots = [spread_pivots(self.entries[:, a:b], pivots) for a, b in self.cuts]

    def measure(self, points: np.ndarray) -> bytes:
        """Distances of every point's parts to the part's pivots."""
        return np.stack([distances(points[:, a:b], p) for (a, b), p in zip(self.cuts, self.pivots)], axis=1).astype("<f4")

    def assign(self, points: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.empty((len(points), len(self.cuts)), dtype=np.int64)
        error = np.zeros(len(points), dtype=np.int64)
        for j, (a, b) in enumerate(self.cuts):
            codes[:, j], squared, _ = nearest(points[:, a:b], to_pivots[:, j], self.entries[:, a:b], self.pivots[j])
            error += squared
        return codes, error

    def digest(self) -> str:
        listed = (str(v) for a, b in self.cuts for row in self.entries[:, a:b].tolist() for v in row)
        return hashlib.sha256(",".join(listed).encode()).hexdigest()


def _slices(batches: Iterator[pd.DataFrame], books: dict[int, Codebooks]) -> Iterator[tuple]:
    """(rows, codebooks, points, distances to pivots where they are known) of rows of one length."""
    for batch in batches:
        for dim, rows in batch.groupby("dim"):
            for start in range(0, len(rows), _SLICE):
                part = rows.iloc[start:start + _SLICE]
                points = np.frombuffer(b"".join(part["ints"]), dtype="<i4").reshape(len(part), int(dim)).astype(np.int64)
                known = None
                if "to_pivots" in part:
                    known = np.frombuffer(b"".join(part["to_pivots"]), dtype="<f4").reshape(len(part), len(books[dim].cuts), -1)
                yield part, books[dim], points, known


def _measure(books: dict[int, Codebooks]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, book, points, _ in _slices(batches, books):
            yield part.assign(to_pivots=[row.tobytes() for row in book.measure(points)])

    return run


def _sum(books: dict[int, Codebooks]) -> Callable:
    """Sums and counts of what a task assigns to each entry: one row for each of at most ENTRIES x length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {d: np.zeros_like(b.entries) for d, b in books.items()}
        counts = {d: np.zeros((len(b.cuts), len(b.entries)), dtype=np.int64) for d, b in books.items()}
        for part, book, points, known in _slices(batches, books):
            dim = int(part["dim"].iloc[0])
            codes, _ = book.assign(points, known)
            for j, (a, b) in enumerate(book.cuts):
                np.add.at(sums[dim][:, a:b], codes[:, j], points[:, a:b])
                counts[dim][j] += np.bincount(codes[:, j], minlength=len(book.entries))
        for dim, book in books.items():
            for j, (a, b) in enumerate(book.cuts):
                used = np.flatnonzero(counts[dim][j])
                for at in range(a, b):
                    yield pd.DataFrame({"dim": dim, "entry": used, "at": at, "total": sums[dim][used, at], "n": counts[dim][j, used]})

    return run


def _encode(books: dict[int, Codebooks]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, book, points, known in _slices(batches, books):
            codes, error = book.assign(points, known)
            yield part[["vec_id", "label", "dim"]].assign(code=["".join(f"{c:02x}" for c in row) for row in codes.tolist()], error=error)

    return run


def encode(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector of finite components.

    A codebook starts as a part of the vectors with the smallest ids. Pivots are chosen from it once,
    and the distance of every part to them is written beside the vectors; each round then only needs
    the distances of entries to pivots, and exact integer distances where these bounds leave a doubt.
    Tasks hand on sums for each entry; an entry becomes the floor of its mean, an unused one stays.

    Vectors that are null or hold null or non-finite components are left out. Vectors of another
    length have codebooks of their own; a length that ``parts`` does not divide is cut as evenly as it
    goes, so short vectors have empty parts (entry 0, no error). A component beyond 2^27 (less for more
    than 64 components) counts as that bound, in units of 1/256. Among equal ids the smaller vector comes first, null
    ids come last; repeated rows count as often as they occur. Null labels are one label. An empty
    table gives an empty one. At most ``entries`` vectors of each length reach the driver.
    """
    if entries > 256:
        raise ValueError("an entry's index has two hex digits")
    turned = F.pandas_udf(lambda column: column.map(integers), "binary")
    kept = stage(
        vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), turned(F.col(vector)).alias("ints"))
        .where("ints is not null").withColumn("dim", (F.octet_length("ints") / 4).cast("int")), "laesa-kept")
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "ints")
    first = kept.withColumn("k", F.row_number().over(order)).where(F.col("k") <= entries).select("dim", "k", "ints").orderBy("dim", "k")
    started: dict[int, list] = {}
    for row in first.collect():
        started.setdefault(row["dim"], []).append(np.frombuffer(bytes(row["ints"]), dtype="<i4"))
    books = {d: Codebooks(d, np.stack(v), parts, pivots) for d, v in started.items()}
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    held = f"vec_id {kinds['vec_id']}, label {kinds['label']}, "
    measured = stage(kept.mapInPandas(_measure(books), f"{held}ints binary, dim int, to_pivots binary"), "laesa-measured")
    for _ in range(rounds):
        sums = measured.select("dim", "ints", "to_pivots").mapInPandas(_sum(books), "dim int, entry int, at int, total long, n long")
        means = sums.groupBy("dim", "entry", "at").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
        for row in means.select("dim", "entry", "at", F.expr("(t - pmod(t, n)) div n").alias("mean")).collect():
            books[row["dim"]].entries[row["entry"], row["at"]] = row["mean"]
    coded = stage(measured.mapInPandas(_encode(books), f"{held}dim int, code string, error long"), "laesa-codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = F.lit(None).cast("string")
    for dim, book in books.items():
        digest = F.when(F.col("dim") == dim, book.digest()).otherwise(digest)
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """SQL for ``encode`` of vectors of one length: every distance of every round."""
    steps = "".join(
        f""",
d{r} as (
  select p.vec_id, p.part, e.entry, p.x, list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as gap
  from p join e{r} e on e.part = p.part
),
a{r} as (select vec_id, part, x, entry, gap from d{r} qualify row_number() over (partition by vec_id, part order by gap, entry) = 1)"""
        + (f""",
u{r} as (
  select part, entry, pos, cast(sum(v) as bigint) as t, count(*) as n
  from (select part, entry, unnest(x) as v, unnest(range(len(x))) as pos from a{r}) group by all
),
e{r + 1} as (
  select e.part, e.entry, coalesce(m.x, e.x) as x from e{r} e
  left join (select part, entry, list((t - ((t % n) + n) % n) // n order by pos) as x from u{r} group by all) m using (part, entry)
)""" if r < rounds else "")
        for r in range(rounds + 1)
    )
    return f"""
with k as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
p as (
  select vec_id, label, part, v[1 + part * len(v) // {PARTS} : (part + 1) * len(v) // {PARTS}] as x
  from k, range({PARTS}) as r(part)
),
e0 as (
  select part, row_number() over (partition by part order by vec_id) - 1 as entry, x from p
  qualify entry < {ENTRIES}
){steps},
c as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(gap) as bigint) as error from a{rounds} group by vec_id),
s as (
  select sha256(string_agg(cast(v as varchar), ',' order by part, entry, pos)) as codebooks_sha256
  from (select part, entry, unnest(x) as v, unnest(range(len(x))) as pos from e{rounds})
)
select c.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from c join k using (vec_id), s
"""
