"""Nearest neighbours by inner product through an inverted multi-index.

Vectors are halved and each half has its own codebook, so the pairs of centroids divide the space into
squares of many small cells. A query walks the pairs in order of their summed distances, which a heap
yields without looking at all of them, until it has met enough entries; those are reranked exactly.
The distance of a half is the negative inner product with its centroid, as the sum over both halves
then estimates the measure itself, whatever the vectors' lengths.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import stage
from kinweave.llm.vectors import matrix, usable, whole_groups

#: Rows that the codebooks are fitted on, and queries that the depth of the walk is measured with.
FIT_ROWS = 8192
FIT_QUERIES = 128
#: Entries of a cell to aim for, and centroids of a half at most (cell counts are kept by the driver).
CELL_ROWS = 12
MOST_CENTROIDS = 1024
#: Entries and queries that meet in one block of a task.
TILE_ROWS = 4096
TILE_QUERIES = 8192
#: Recall that the measured queries must reach at the depth chosen for all.
DEPTH_RECALL = 0.97
SEED = 5


def centroids(sample: np.ndarray, k: int, seed: int = SEED, rounds: int = 12) -> np.ndarray:
    """Codebook of a half by Lloyd's rounds; empty cells move to the point that is worst off."""
    if not sample.shape[1]:
        return np.zeros((1, 0))
    draw = np.random.default_rng(seed)
    points = np.unique(sample, axis=0)
    k = min(k, len(points))
    chosen = points[draw.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        far = (chosen ** 2).sum(axis=1)[None, :] - 2 * sample @ chosen.T
        nearest = far.argmin(axis=1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.stack([np.bincount(nearest, sample[:, d], k) for d in range(sample.shape[1])], axis=1)
        chosen = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], chosen)
        for empty in np.flatnonzero(counts == 0):
            worst = far[np.arange(len(sample)), nearest].argmax()
            chosen[empty] = sample[worst]
            far[worst] = -np.inf
    return chosen


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Centroid pairs in order of summed distance until ``depth`` entries are met.

    A pair enters the heap when its two predecessors (one less in either sorted list) have left it.
    """
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b, x, y = first[one].tolist(), second[two].tolist(), one.tolist(), two.tolist()
    done = [0] * len(a)  # how many pairs of each row have left the heap: they leave from the left
    heap, met, out = [(a[0] + b[0], 0, 0)], 0, []
    sizes = counts.tolist() if isinstance(counts, np.ndarray) else counts
    while heap and met < depth:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        cell = x[i], y[j]
        if size := sizes[cell[0]][cell[1]]:
            out.append(cell)
            met += size
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return out


def _best(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, met, top: int):
    """For each query the ``top`` rows with the largest inner product, ties to smaller ids.

    ``met`` lists (queries, first row, end) for runs of rows and the queries that meet them; no other
    products are taken. None lets all queries meet all rows.
    """
    if met is None:
        scores = queries @ vectors.T
    else:
        scores = np.full((len(queries), len(vectors)), -np.inf)
        for asking, first, end in met:
            scores[asking, first:end] = queries[asking] @ vectors[first:end].T
    scores[own[:, None] == rows[None, :]] = -np.inf
    if scores.shape[1] > top:
        bar = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
    else:
        bar = np.full(len(scores), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))
    q, r = np.nonzero((scores >= (bar - slack)[:, None]) & np.isfinite(scores))
    exact = (queries[q] * vectors[r]).sum(axis=1)  # one order of summing, so equal vectors tie exactly
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < top
    return q[keep], r[keep], exact[keep]


def search(
    df: DataFrame, top: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    depth_recall: float = DEPTH_RECALL, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, the nearest others.

    Codebooks are fitted on ``FIT_ROWS`` rows at most; every row is indexed. How many entries a walk
    must meet is measured: ``FIT_QUERIES`` of the queries are compared with all rows in blocks, and the
    least depth at which they reach ``depth_recall`` holds for all. Tiles of cells are joined with the
    queries that walk there; tiles with many rows or queries are split in both ways.

    Vectors are compared with those of their own length. Each length that has a query gets its own
    codebooks and depth, one length after another; their tiles are reranked together.

    Of equal vectors only the ``top`` + 1 smallest ids can be among anyone's nearest, so only those are
    indexed. Ranks count from 1; ties go to the smaller id. Vectors that are null, empty, zero, or hold
    null or non-finite numbers take no part, nor do rows with a null id. A repeated row is a candidate
    of its own, and a query whose id repeats is searched once, from its first vector in the order of
    length and bytes. Fewer candidates than ``top`` give fewer rows; an empty table gives none.
    """

    @F.pandas_udf("binary")
    def prepared(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([usable(v) for v in batch])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), prepared(F.col(vector)).alias("raw"))
    rows = stage(rows.where("raw is not null and vec_id is not null"), "imi-rows")
    copy = F.row_number().over(Window.partitionBy("raw").orderBy("vec_id"))
    entries = rows.withColumn("copy", copy).where(F.col("copy") <= top + 1)
    entries = entries.select("vec_id", "raw", F.length("raw").alias("size")).withColumn("row", F.monotonically_increasing_id())
    entries = stage(entries, "imi-entries")
    # the query is the row with its id; a repeated id is searched from one of them
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(F.length("raw").alias("size"), "raw")).alias("q"))
    queries = queries.select("vec_id", "q.*")
    mine = entries.groupBy("vec_id", "raw").agg(F.min("row").alias("row"))
    queries = stage(queries.join(mine, ["vec_id", "raw"], "left").select(
        F.col("vec_id").alias("query"), "raw", "size", F.coalesce("row", F.lit(-1)).alias("own")), "imi-queries")
    sizes = entries.groupBy("size").agg(F.count("*").alias("n")).join(queries.select("size").distinct(), "size", "left_semi")
    parts = [
        _index(entries.where(F.col("size") == size), queries.where(F.col("size") == size), size, n, top, depth_recall, seed)
        for size, n in sorted(sizes.collect())]
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexed, walked = (reduce(DataFrame.unionByName, some) for some in zip(*parts))
    found = _met(indexed, walked, top)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _index(
    entries: DataFrame, queries: DataFrame, size: int, total: int, top: int, depth_recall: float, seed: int,
) -> tuple[DataFrame, DataFrame]:
    """(rows with their tile and place in it, (query, tile) with the cells met there) of one length."""
    spark = entries.sparkSession
    half = size // 8 // 2

    # codebooks
    sample = matrix([r["raw"] for r in entries.select("raw", F.xxhash64("row").alias("h")).orderBy("h").limit(FIT_ROWS).select("raw").collect()])
    k = min(MOST_CENTROIDS, max(1, round((total / CELL_ROWS) ** 0.5)))
    books = centroids(sample[:, :half], k, seed), centroids(sample[:, half:], k, seed + 1)
    tile_width = max(1, -(-1024 * len(books[0]) * len(books[1]) // max(total, 1)))
    tiles = -(-len(books[1]) // tile_width)

    @F.pandas_udf("struct<first:int,second:int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, out = matrix(batch.tolist()), []
            for part, book in ((vectors[:, :half], books[0]), (vectors[:, half:], books[1])):
                out.append(((book ** 2).sum(axis=1)[None, :] - 2 * part @ book.T).argmin(axis=1).astype(np.int32))
            yield pd.DataFrame({"first": out[0], "second": out[1]})

    indexed = stage(entries.withColumn("cell", cells("raw")).select("vec_id", "raw", "row", "size", "cell.*"), "imi-index")
    counts = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    for r in indexed.groupBy("first", "second").count().collect():
        counts[r["first"], r["second"]] = r["count"]

    depth = _depth(queries, indexed, books, counts, half, top, depth_recall)
    sizes_by_cell = counts.tolist()

    # the walks: for each query and tile, which of the tile's cells it met
    def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, out = matrix(batch["raw"].tolist()), []
            ahead, behind = -(vectors[:, :half] @ books[0].T), -(vectors[:, half:] @ books[1].T)
            for query, own, raw, a, b in zip(batch["query"], batch["own"], batch["raw"], ahead, behind):
                met: dict[int, np.ndarray] = {}
                for i, j in walk(a, b, sizes_by_cell, depth):
                    tile = i * tiles + j // tile_width
                    if tile not in met:
                        met[tile] = np.zeros(tile_width, dtype=bool)
                    met[tile][j % tile_width] = True
                out += [(query, own, tile, raw, np.packbits(cells).tobytes()) for tile, cells in met.items()]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["query", "own", "tile", "raw", "cells"])
                    out = []
            yield pd.DataFrame(out, columns=["query", "own", "tile", "raw", "cells"])

    spread = queries.repartition(max(2, spark.sparkContext.defaultParallelism))
    walked = stage(spread.mapInPandas(walks, "query long, own long, tile long, raw binary, cells binary"), "imi-walks")
    tile = (F.col("first").cast("long") * tiles + F.floor(F.col("second") / tile_width)).alias("tile")
    place = F.pmod("second", F.lit(tile_width)).alias("at")
    return indexed.select("size", tile, place, "row", "vec_id", "raw"), walked.withColumn("size", F.lit(size))


def _met(indexed: DataFrame, walked: DataFrame, top: int) -> DataFrame:
    """(query_id, vec_id, score, row): the best of each query in each tile, among the cells it met.

    Tiles are split by their rows and by their queries, so that the parts are bounded.
    """
    parts = walked.groupBy("size", "tile").agg(F.ceil(F.count("*") / TILE_QUERIES).alias("query_parts")).join(
        indexed.groupBy("size", "tile").agg(F.ceil(F.count("*") / TILE_ROWS).alias("row_parts")), ["size", "tile"])
    parts = stage(parts, "imi-tiles")
    some = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(parts, ["size", "tile"]).select(
        "size", "tile", F.pmod(F.xxhash64("row"), "row_parts").alias("rp"), some("query_parts").alias("qp"), F.lit(0).alias("side"),
        "row", "vec_id", "raw", "at", F.lit(None).cast("binary").alias("cells"))
    right = walked.join(parts, ["size", "tile"]).select(
        "size", "tile", some("row_parts").alias("rp"), F.pmod(F.xxhash64("query"), "query_parts").alias("qp"), F.lit(1).alias("side"),
        F.col("own").alias("row"), F.col("query").alias("vec_id"), "raw", F.lit(0).alias("at"), "cells")
    group = ["size", "tile", "rp", "qp"]
    met = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, "side", "at")

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, cuts in whole_groups(batches, group):
            for a, b in zip(cuts, cuts[1:]):
                rows = part.iloc[a:b]
                split = int((rows["side"] == 0).sum())
                if not split or split == len(rows):
                    continue
                body, asked = rows.iloc[:split], rows.iloc[split:]
                vectors, spots = matrix(body["raw"].tolist()), body["at"].to_numpy()
                ids, numbers = body["vec_id"].to_numpy(), body["row"].to_numpy()
                cells, starts = np.unique(spots, return_index=True)
                runs = list(zip(cells.tolist(), starts.tolist(), [*starts[1:].tolist(), len(spots)]))
                for at in range(0, len(asked), 512):
                    some_asked = asked.iloc[at:at + 512]
                    bits = np.frombuffer(b"".join(some_asked["cells"]), dtype=np.uint8).reshape(len(some_asked), -1)
                    asking = np.unpackbits(bits, axis=1).astype(bool)
                    here = [(np.flatnonzero(asking[:, cell]), first, end) for cell, first, end in runs]
                    q, r, score = _best(matrix(some_asked["raw"].tolist()), some_asked["row"].to_numpy(), vectors, numbers, ids, here, top)
                    yield pd.DataFrame({"query_id": some_asked["vec_id"].to_numpy()[q], "vec_id": ids[r], "score": score, "row": numbers[r]})

    return met.mapInPandas(rerank, "query_id long, vec_id long, score double, row long")


def _depth(queries: DataFrame, indexed: DataFrame, books, counts: np.ndarray, half: int, top: int, recall: float) -> int:
    """The least number of entries to meet at which measured queries find ``recall`` of their nearest.

    Never less than would fill ``top`` ranks, the query's own entry left out.
    """
    asked = queries.select("query", "own", "raw", F.xxhash64("query").alias("h")).orderBy("h").limit(FIT_QUERIES).collect()
    if not asked:
        return top + 1
    vectors, own = matrix([r["raw"] for r in asked]), np.array([r["own"] for r in asked])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TILE_ROWS):
                part = batch.iloc[at:at + TILE_ROWS]
                ids = part["vec_id"].to_numpy()
                q, r, score = _best(vectors, own, matrix(part["raw"].tolist()), part["row"].to_numpy(), ids, None, top)
                yield pd.DataFrame({"q": q, "first": part["first"].to_numpy()[r], "second": part["second"].to_numpy()[r], "score": score, "vec_id": ids[r]})

    found = indexed.mapInPandas(nearest, "q long, first int, second int, score double, vec_id long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    true = found.withColumn("place", place).where(F.col("place") <= top).select("q", "first", "second").collect()
    wanted: dict[int, list[tuple[int, int]]] = {}
    for r in true:
        wanted.setdefault(r["q"], []).append((r["first"], r["second"]))
    needed: list[int] = []
    total = int(counts.sum())
    for q, cells in wanted.items():
        a, b = -(books[0] @ vectors[q, :half]), -(books[1] @ vectors[q, half:])
        met, order = 0, {}
        for cell in walk(a, b, counts, total):
            order[cell] = met + 1  # a walk that goes on after fewer entries than this enters the cell
            met += int(counts[cell])
        needed += [order[cell] for cell in cells]
    return max(top + 1, int(np.quantile(needed, min(1.0, recall), method="higher")) if needed else 1)
