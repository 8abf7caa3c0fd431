"""SimHash near-duplicates found through segment popcounts.

A fingerprint of 64 bits is mapped to the number of set bits in each of its segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so a range join
on the grid of vectors finds every pair within the radius, and the fingerprints themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import short_batches, stage
from kinweave.llm.components import connected_components

SEED = 42
BITS = 64
SEGMENT_BITS = 2
#: The grid has one step of reach for each side, so pairs up to this distance meet.
RADIUS = 2
#: Cells with more fingerprints are checked through shared exact midpoints instead of pairwise.
PAIRWISE_CELL = 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text: a bit is set where over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.unpackbits(packed, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of the whole text as a long (the bits as they are)."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts))
            yield pd.Series(found.view(np.int64))

    return short_batches(docs).withColumn(out, of(F.col(text)))


def _popcounts(fp: str) -> str:
    """SQL: the counts of all two-bit segments, each written over its segment as 0, 1 or 2."""
    even = "6148914691236517205L"  # every second bit
    other = f"shiftrightunsigned({fp}, 1)"
    return f"(({fp} ^ {other}) & {even}) | shiftleft({fp} & {other} & {even}, 1)"


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): the fingerprint's own grid cell and every cell one step away.

    Two vectors at Manhattan distance 2 or less share a cell: a point half-way between them.
    """
    seats = F.sequence(F.lit(0), F.lit(BITS // SEGMENT_BITS - 1))
    own = fps.select("fp", F.expr(_popcounts("fp")).alias("own"))
    near = own.select("fp", "own", F.explode(seats).alias("seat")).select(
        "fp", "own", F.expr("shiftleft(1L, 2 * seat)").alias("one"), F.expr("shiftleft(3L, 2 * seat)").alias("both"),
        F.expr("shiftrightunsigned(own, 2 * seat) & 3").alias("n"))
    # one step: 0 rises to 1, 2 falls to 1, and 1 does both
    moved = near.select("fp", F.explode(F.expr(
        "case n when 0 then array(own ^ one) when 2 then array(own ^ both) "
        "else array(own ^ one, own ^ both) end")).alias("cell"))
    return own.select("fp", F.col("own").alias("cell")).unionByName(moved)


def _links(cells: DataFrame) -> DataFrame:
    """(a, b) with a < b: verified links that connect what pairs within the radius connect.

    One aggregation, combined before the shuffle, sizes the cells. Cells of two are decided by their
    minimum and maximum alone. Larger ones join back: small cells pair their members, and larger ones
    send each member to its one-bit neighbours that lie in the cell; whoever meets there is within two
    bits, so every member is linked to the smallest one met. Either way nothing within the radius is
    missed, and a cell with a third of all fingerprints emits a bounded number of rows for each.
    """
    sized = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    crowded = stage(sized.where("n > 1"), "simhash-cells")
    pair = crowded.where("n = 2").select("a", "b").where(f"bit_count(a ^ b) <= {RADIUS}")

    members = cells.join(crowded.where("n > 2").select("cell", "n"), "cell")
    small = members.where(F.col("n") <= PAIRWISE_CELL)
    left = small.select("cell", F.col("fp").alias("a"))
    right = small.select("cell", F.col("fp").alias("b"))
    few = left.join(right, "cell").where(f"a < b and bit_count(a ^ b) <= {RADIUS}").select("a", "b")

    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    large = members.where(F.col("n") > PAIRWISE_CELL).select("cell", "fp")
    flipped = large.select("cell", "fp", F.explode(bits).alias("bit")).select(
        "cell", "fp", F.expr("fp ^ shiftleft(1L, bit)").alias("middle"))
    middles = flipped.where(F.expr(f"({_popcounts('middle')}) = cell")).unionByName(
        large.withColumn("middle", F.col("fp")).where(F.expr(f"({_popcounts('fp')}) = cell")))
    met = middles.groupBy("middle").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    many = middles.select("middle", F.col("fp").alias("b")).join(met.select("middle", "a"), "middle")
    return pair.union(few).union(many.where("a < b").select("a", "b"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest id reachable over links of 2 or fewer bits.

    Equal fingerprints are one class from the start, so exact copies are never paired. Texts without
    words (null, empty, only white space) have fingerprint zero and link like any other. Repeated rows
    come back as often as they came in; rows with a null id keep a null component unless others of
    their class have ids, whose smallest they take. An empty table gives an empty one. Other columns
    are not read.
    """
    marked = stage(fingerprints(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text")
                   .select("_id", "fp"), "simhash-fp")
    classes = stage(marked.groupBy("fp").agg(F.min("_id").alias("first")), "simhash-classes")
    found = connected_components(_links(_cells(classes.select("fp"))))
    # smallest document of each component of classes
    grouped = found.join(classes, found["node"] == classes["fp"]).select("fp", "component", "first")
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = grouped.join(smallest, "component").select("fp", "component_id")
    named = stage(
        classes.join(linked, "fp", "left")
        .select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-named")
    return marked.join(named, "fp").select(
        F.col("_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group: those whose id is the component's id.

    Only fingerprints that differ in two bits or fewer link, so exact copies and copies with few
    changed words go, and looser ones stay. All columns stay, whatever their names. Of repeated rows
    with one id one stays. Rows without an id stay only where no document with an id is in their
    group, one for each fingerprint.
    """
    groups = stage(components(docs, doc_id, text), "simhash-groups")
    first = groups.where(F.col(doc_id) == F.col("component_id")).select(doc_id).distinct()
    kept = docs.join(first, doc_id, "left_semi").dropDuplicates([doc_id]).select(docs.columns)
    lone = groups.where(F.col(doc_id).isNull() & F.col("component_id").isNull()).select(
        F.col("fingerprint").alias("lone")).distinct()
    bare = docs.where(F.col(doc_id).isNull()).select(F.struct("*").alias("row"), F.col(text).alias("body"))
    nameless = fingerprints(bare, "body", "fp").dropDuplicates(["fp"]).select(
        "row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("own"))
    return kept.unionByName(nameless.join(lone, F.col("own") == F.col("lone"), "left_semi").select("row.*"))
