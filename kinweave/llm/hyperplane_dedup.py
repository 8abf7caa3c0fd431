"""Near-duplicate vectors by the signs of random projections.

Every distinct vector is hashed by the side it takes of some random hyperplanes, in many tables. Pairs
that share a bucket of any table are compared by their exact cosine, inside tasks, in blocks of a
bounded size; only sums of links and one edge for each member of a linked group come out of a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import stage
from kinweave.llm.components import connected_components
from kinweave.llm.vectors import matrix, usable, whole_groups

#: Members of a bucket that are compared as one block.
BLOCK = 1024
#: Share of the pairs at exactly the threshold that must meet in some table.
RECALL = 0.97
SEED = 20


def tables_for(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits, tables): buckets of unrelated vectors hold few, and a pair at the threshold meets.

    Two vectors take the same side of a random hyperplane with probability 1 - angle / pi.
    """
    bits = min(62, max(8, math.ceil(math.log2(max(rows, 2))) + 4))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


@lru_cache(maxsize=4)
def _planes(size: int, count: int, seed: int) -> np.ndarray:
    """Normals of the hyperplanes, a column each; the first ones are the same for any count."""
    return np.ascontiguousarray(np.random.default_rng([seed, size]).standard_normal((count, size)).T)


def codes(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED, first: int | None = None) -> np.ndarray:
    """Bucket of each vector (row) in each table, or in the ``first`` ones."""
    planes = _planes(vectors.shape[1], bits * tables, seed)
    tables = tables if first is None else first
    planes = planes[:, :bits * tables]
    out = np.empty((len(vectors), tables), dtype=np.int64)
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    for at in range(0, len(vectors), 2048):
        part = vectors[at:at + 2048]
        out[at:at + 2048] = (part @ planes > 0).reshape(len(part), tables, bits) @ weights
    return out


def _linked(group: pd.DataFrame, cosine: float, bits: int, tables: int, seed: int) -> pd.DataFrame | None:
    """Links within one group: for each member the links counted here, and a member it hangs together with.

    A pair counts in the first table in which it shares a bucket, so it counts once over all tables.
    """
    vectors = matrix(group["raw"].tolist())
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= cosine - 1e-9, 1)
    left, right = group["left"].iloc[0], group["right"].iloc[0]
    block = group["block"].to_numpy()
    if left != right:
        near &= block[:, None] != block[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return None
    exact = (unit[a] * unit[b]).sum(axis=1) >= cosine
    a, b = a[exact], b[exact]
    if not len(a):
        return None
    label = np.arange(len(group))
    while True:
        lower = label.copy()
        np.minimum.at(lower, a, label[b])
        np.minimum.at(lower, b, label[a])
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    members = np.unique(np.concatenate((a, b)))
    seat = np.zeros(len(group), dtype=np.int64)
    seat[members] = np.arange(len(members))
    own = codes(vectors[members], bits, tables, seed, int(group["table"].iloc[0]))
    fresh = np.ones(len(a), dtype=bool)
    for at in range(0, len(a), 65536):
        fresh[at:at + 65536] = ~(own[seat[a[at:at + 65536]]] == own[seat[b[at:at + 65536]]]).any(axis=1)
    copies = group["copies"].to_numpy(np.int64)
    count = np.zeros(len(group), dtype=np.int64)
    np.add.at(count, a[fresh], copies[b[fresh]])
    np.add.at(count, b[fresh], copies[a[fresh]])
    ids = group["id"].to_numpy(np.int64)
    return pd.DataFrame({"id": ids[members], "links": count[members], "peer": ids[label[members]]})


def near_duplicates(
    df: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL,
    block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are one class from the start and count as linked; classes are never expanded. A
    bucket with more than ``block`` members is split, and the pairs of its parts are compared as
    groups of their own, so no task meets more than two parts at once. Vectors of different length
    never link. Rows that are null, empty, zero, or hold null or non-finite numbers link with nothing
    and are their own component. Repeated rows are rows like any other; a null id stays, is never
    ``kept``, and is not a component's smallest id unless there is no other.
    """

    @F.pandas_udf("struct<key:binary,raw:binary>")
    def prepared(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [usable(v) for v in batch]
            yield pd.DataFrame({"key": [r and hashlib.sha256(r).digest() for r in raw], "raw": raw})

    rows = df.select(F.col(vec_id).alias("vec_id"), prepared(F.col(vector)).alias("v"))
    keyed = stage(rows.select("vec_id", F.col("v.key").alias("key")), "hyper-rows")
    classes = rows.select("vec_id", "v.*").where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("raw").alias("raw"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "hyper-classes")
    bits, tables = tables_for(classes.count(), cosine, recall)

    @F.pandas_udf("array<long>")
    def buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            raw, out = batch.tolist(), [None] * len(batch)
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                where = np.flatnonzero(sizes == size)
                for i, row in zip(where.tolist(), codes(matrix([raw[i] for i in where]), bits, tables, seed)):
                    out[i] = row
            yield pd.Series(out)

    entries = classes.select("id", F.length("raw").alias("size"), F.posexplode(buckets("raw")).alias("table", "bucket"))
    entries = stage(entries, "hyper-entries")
    place = ["size", "table", "bucket"]
    shared = entries.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1")
    members = entries.join(shared, place).withColumn("parts", F.expr(f"int(ceil(n / {block}))"))
    members = members.withColumn("block", F.expr("int(pmod(xxhash64(id, table), parts))"))
    paired = members.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "id", *place, "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    group = ["size", "table", "bucket", "left", "right"]
    filled = paired.join(classes.select("id", "copies", "raw"), "id").repartition(*group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, cuts in whole_groups(batches, group):
            sizes = np.diff(cuts)
            found = []
            # groups of two, most of them, side by side
            twos = cuts[:-1][sizes == 2]
            if len(twos):
                raw = part["raw"].to_numpy()
                lengths = part["size"].to_numpy()[twos]
                close = np.zeros(len(twos), dtype=bool)
                for size in np.unique(lengths):
                    which = np.flatnonzero(lengths == size)
                    one, two = matrix(raw[twos[which]].tolist()), matrix(raw[twos[which] + 1].tolist())
                    dots = (one * two).sum(axis=1) / (np.linalg.norm(one, axis=1) * np.linalg.norm(two, axis=1))
                    close[which] = dots >= cosine - 1e-9
                todo = list(twos[close]), [2] * int(close.sum())
            else:
                todo = [], []
            large = sizes > 2
            for at, size in zip([*todo[0], *cuts[:-1][large]], [*todo[1], *sizes[large]]):
                if (one := _linked(part.iloc[at:at + size], cosine, bits, tables, seed)) is not None:
                    found.append(one)
            if found:
                yield pd.concat(found)

    links = stage(filled.mapInPandas(compare, "id long, links long, peer long"), "hyper-links")
    joined = connected_components(links.select(F.col("id").alias("a"), F.col("peer").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = classes.select("id", "key", "first", "copies").join(joined.withColumnRenamed("node", "id"), "id", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "id"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "component").join(counts, "id", "left").select(
        "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    result = keyed.join(stage(named, "hyper-named"), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select(
        F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
