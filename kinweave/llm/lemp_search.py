"""Ranked lexical search over norm buckets: lengths prune buckets, coordinates prune inside, integers decide."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: Entries of impact vectors that one task holds at a time, and queries that meet them at a time.
TILE_ENTRIES, QUERY_BLOCK = 1 << 20, 2048
#: Shares of all entries after which the longest vectors searched so far set new thresholds.
SHARES = (1 / 64, 1 / 8, 1.0)
#: Coordinates of a query, heaviest first, that bound a vector before it is scored.
FOCUS = 8
#: Bounds are made of floats: they give way by this share.
_SLACK = 1e-9
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text: str | None) -> list[str]:
    return re.findall(TERM, text.translate(_LOWER)) if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n, term, tf) of a batch's documents; a row without a term of its own carries n."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found, words, tfs, ends = [], [], [], [0]
            for text in part.column("body"):
                counts = Counter(terms(text.as_py()))
                found.append(counts.total())
                words.append(None)
                words.extend(counts)
                tfs.append(0)
                tfs.extend(counts.values())
                ends.append(len(words))
            each = np.repeat(np.arange(part.num_rows), np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(pa.array(each)), part.column("doc_id").take(pa.array(each)),
                 pa.array(np.array(found, dtype=np.int64)[each]), pa.array(words, pa.string()), pa.array(tfs, pa.int64())],
                names=["row", "doc_id", "n", "term", "tf"])


def _ranges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


class Tile:
    """Impact vectors of one bucket, longest first, with a list of (vector, impact) for each coordinate."""

    def __init__(self, table: pa.Table):
        lengths = table.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[order]
        docs = table.column("doc_id").combine_chunks()
        self.unnamed = docs.is_null().to_numpy(zero_copy_only=False)[order]
        self.docs = docs.fill_null(0).to_numpy()[order]
        lists = table.column("tids").combine_chunks()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        at = np.repeat(place, np.diff(lists.offsets.to_numpy()))
        tids = lists.flatten().to_numpy()
        impacts = table.column("impacts").combine_chunks().flatten().to_numpy()
        by_term = np.lexsort((at, tids))
        tids, self.at, self.impacts = tids[by_term], at[by_term], impacts[by_term]
        self.tids, counts = np.unique(tids, return_counts=True)
        self.starts = _ranges(counts)

    def lists(self, tids: np.ndarray, reach: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(position in ``tids``, vectors, impacts) of coordinates that the first ``reach`` vectors hold."""
        found = np.searchsorted(self.tids, tids)
        out = []
        for k, f in enumerate(found.tolist()):
            if f < len(self.tids) and self.tids[f] == tids[k]:
                a, b = self.starts[f], self.starts[f + 1]
                b = a + np.searchsorted(self.at[a:b], reach)
                if b > a:
                    out.append((k, self.at[a:b], self.impacts[a:b]))
        return out

    def search(self, tids: np.ndarray, weights: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(vectors, scores, how many were scored) of the best ``top`` with a score of ``least`` or more.

        With coordinates sqrt(w) on the query's side and sqrt(w) * impact on the vector's, the inner
        product is the score. A vector shorter than least / |query| cannot reach it (Cauchy-Schwarz).
        Of the others, the query's heaviest coordinates are added up; the rest of the product is at
        most the rest of one length times the rest of the other.
        """
        order = np.argsort(-weights, kind="stable")
        tids, weights = tids[order], weights[order]
        floor = least * (1 - _SLACK)
        reach = len(self.lengths) - np.searchsorted(self.lengths[::-1], floor / math.sqrt(weights.sum()))
        lists = self.lists(tids, reach)
        if not lists:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        sums, squares = np.zeros(reach), np.zeros(reach)
        for k, at, impacts in lists:
            if k >= FOCUS:
                break
            sums[at] += weights[k] * impacts
            squares[at] += weights[k] * impacts.astype(np.float64) ** 2
        rest = math.sqrt(weights[FOCUS:].sum())
        bounds = sums + rest * np.sqrt(np.maximum(self.lengths[:reach] ** 2 * (1 + _SLACK) - squares, 0))
        left = np.flatnonzero(bounds >= floor)
        scores = np.zeros(reach, dtype=np.int64)
        few = len(left) * 16 < reach
        for k, at, impacts in lists:
            if few:
                place = np.minimum(np.searchsorted(at, left), len(at) - 1)
                hit = np.flatnonzero(at[place] == left)
                scores[left[hit]] += weights[k] * impacts[place[hit]]
            else:
                scores[at] += weights[k] * impacts
        good = left[scores[left] >= max(least, 1)]
        if len(good) > top:
            good = good[scores[good] >= np.partition(scores[good], -top)[-top]]
        best = good[np.lexsort((self.docs[good], self.unnamed[good], -scores[good]))[:top]]
        return best, scores[best], len(left)


def _search(top: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        items, docs, scores = [], [], []
        if vectors.num_rows and queries.num_rows:
            tile = Tile(vectors)
            for item, least, tids, weights in zip(*(queries.column(c) for c in ("item", "least", "tids", "weights"))):
                best, score, _ = tile.search(tids.values.to_numpy(), weights.values.to_numpy(), least.as_py(), top)
                items.extend([item.as_py()] * len(best))
                docs.extend(None if none else doc for doc, none in zip(tile.docs[best].tolist(), tile.unnamed[best].tolist()))
                scores.extend(score.tolist())
        return pa.table({"item": pa.array(items, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


def _vectors(docs: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term weights, impact vectors over the vocabulary), both written.

    A text is read once; of its terms only those of the vocabulary are kept. The vocabulary meets them
    in a join on the term, which Spark broadcasts only if the written vocabulary is small enough.
    """
    counted = docs.mapInArrow(_count, "row long, doc_id long, n long, term string, tf long")
    met = counted.join(vocabulary, "term", "left").where("tid is not null or tf = 0")
    entries = stage(met.select("row", "doc_id", "n", "tid", "tf"), "lemp-entries")
    totals = entries.where("tid is null").agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    n_docs, n_terms = totals[0], totals[1] or 0
    held = entries.where("tid is not null")
    ratio = (F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1)
    weights = stage(
        held.groupBy("tid").agg(F.count(F.lit(1)).alias("df")).select("tid", F.floor(1000 * F.log(ratio)).cast("long").alias("w"))
        .where("w > 0"), "lemp-weights")
    m = 50 + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    impact = held.join(weights, "tid").select(
        "row", "doc_id", "tid", "w", m.alias("m"), "tf").withColumn("impact", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)")).where("impact > 0")
    vectors = impact.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("tid", "impact")).alias("e"),
        F.sqrt(F.sum(F.col("w") * F.col("impact").cast("double") * F.col("impact"))).alias("length"))
    return weights, stage(
        vectors.select(
            "row", "doc_id", "length", F.floor(4 * F.log2("length")).cast("int").alias("bucket"),
            F.col("e.tid").alias("tids"), F.col("e.impact").alias("impacts")), "lemp-vectors")


def _rounds(buckets: list) -> list[list]:
    """Buckets, longest first, in rounds that hold growing shares of all entries."""
    total, held, out, now = sum(b["entries"] for b in buckets), 0, [], []
    shares = list(SHARES)
    for b in sorted(buckets, key=lambda b: -b["bucket"]):
        now.append(b)
        held += b["entries"]
        if held >= shares[0] * total:
            out.append(now)
            now = []
            while shares and held >= shares[0] * total:
                shares.pop(0)
            shares = shares or [1.0]
    return out + [now] if now else out


def search(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above zero.

    Documents are vectors of impacts over the terms of all items, kept by length in buckets (a quarter
    of a power of two each), and buckets in tiles of bounded size. Rounds go from the longest vectors
    to the shortest: after each, an item's ``top``-th score so far is the least that counts, buckets
    too short for it are not read, and inside a tile bounds by length and by the heaviest coordinates
    leave few vectors, which are scored in 64-bit integers. Queries meet tiles in blocks. Nothing is
    dropped: bounds give way by more than their rounding.

    Null and empty texts have no terms; items without terms, or whose terms no document holds, have
    no rows. Rows of one item id are one item with the terms of all; a null item id is an item too.
    Rows that repeat a document id are documents of their own; null ids come last among equal scores.
    Other columns are not read. Empty tables give an empty one. Only counts of buckets reach the driver.
    """
    split = F.udf(lambda t: sorted(set(terms(t))), "array<string>")
    named = items.select(F.col(item_id).alias("item_id"), F.explode(split(F.col(item_text))).alias("term")).distinct()
    ids = stage(named.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "lemp-items")
    vocabulary = stage(named.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "lemp-terms")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    weights, vectors = _vectors(rows, vocabulary)
    asked = named.withColumnRenamed("item_id", "of").join(vocabulary, "term").join(weights, "tid").join(ids, F.col("item_id").eqNullSafe(F.col("of")))
    queries = stage(
        asked.groupBy("item").agg(F.collect_list(F.struct("tid", "w")).alias("e"), F.sqrt(F.sum("w")).alias("norm"))
        .select("item", "norm", F.col("e.tid").alias("tids"), F.col("e.w").alias("weights")), "lemp-queries")
    blocks = -(-queries.count() // QUERY_BLOCK)
    buckets = vectors.groupBy("bucket").agg(F.sum(F.size("tids")).alias("entries"), F.max("length").alias("longest")).collect()
    best = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long, rank int")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    for group in _rounds(buckets) if blocks else []:
        full = best.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= top)
        open_ = queries.join(full.select("item", "least"), "item", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long")))
        shortest = open_.agg(F.min(F.col("least") / F.col("norm"))).first()[0] * (1 - _SLACK)
        tiles = [(b["bucket"], -(-b["entries"] // TILE_ENTRIES), b["longest"]) for b in group if b["longest"] >= shortest]
        if not tiles:
            break  # later buckets are shorter still
        dealt = F.lit(1)
        for b, n, _ in tiles:
            dealt = F.when(F.col("bucket") == b, n).otherwise(dealt)
        block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
        pieces = vectors.where(F.col("bucket").isin([t[0] for t in tiles]) & (F.col("length") >= shortest)).select(
            "doc_id", "length", "tids", "impacts", "bucket", F.pmod(F.xxhash64("row"), dealt).alias("tile"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        reached = F.explode(F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("tiles"), F.lit(longest).alias("longest")) for b, n, longest in tiles)))
        at = open_.select("item", "norm", "least", "tids", "weights", block, reached.alias("b")).where(
            F.col("b.longest") * F.col("norm") >= F.col("least") * (1 - _SLACK))
        sent = at.select("item", "least", "tids", "weights", "block", F.col("b.bucket").alias("bucket"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.tiles").cast("long") - 1)).alias("tile"))
        keys = ["bucket", "tile", "block"]
        found = pieces.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_search(top), "item long, doc_id long, score long")
        ranked = best.drop("rank").union(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        best = stage(ranked, "lemp-best")
    return best.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def oracle() -> str:
    """SQL for ``search``: every document that shares a term with an item is scored."""
    found = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))"
    return f"""
with t as (select doc_id, {found} as term from documents),
i as (select distinct item_id, {found} as term from benchmark),
d as (select doc_id, count(*) as n from t group by doc_id),
g as (select count(*) as docs, cast(sum(n) as bigint) as terms from d),
f as (select doc_id, term, count(*) as tf from t where term in (select term from i) group by all),
w as (
  select term, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as w from f, g group by term
),
s as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) as bigint) as score
  from i join f using (term) join w using (term) join d using (doc_id), g group by all
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from s where score > 0 qualify rank <= {TOP}
"""
