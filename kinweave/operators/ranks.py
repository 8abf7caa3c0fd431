"""Ranks of rows in an order, in groups of any size, without a window over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.session import stage

#: Rows that a range of the order holds at least, before another is opened.
RANGE_ROWS = 1 << 16


def ranked(
    rows: DataFrame, groups: dict[str, Column], order: dict[str, Column], rank: str = "rank", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``rows`` with their place (from 1) in their group, as a written table.

    Rows are dealt out by ranges of (groups, order) and sorted in their range, so a group that owns a
    third of all rows is spread over many tasks. What a range holds of a group is one run of rows: a
    row's place is its distance from the first row of the run, added to what earlier ranges hold of
    the group. Only (group, range) counts go through a window. Rows that tie in everything are dealt
    out too; which of them comes first is open. Null groups are one group; nulls in the order come
    first unless the column says otherwise. The columns of ``rows`` may have any name but ``rank``.
    """
    if rank in rows.columns:
        raise ValueError(f"the rows already have a column {rank!r}")
    session = rows.sparkSession
    ranges = max(1, min(rows.count() // range_rows, int(session.conf.get("spark.sql.shuffle.partitions"))))
    g = {f"g{i}": c for i, c in enumerate(groups.values())}
    o = {f"o{i}": c for i, c in enumerate(order.values())}
    keyed = rows.select(
        F.struct("*").alias("row"), *(c.alias(n) for n, c in g.items()), *(c.alias(n) for n, c in o.items()),
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    by = [*g, *o, "tie"]
    dealt = stage(
        keyed.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
        .select("row", *g, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranked")
    runs = dealt.groupBy(*g, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*g).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select(
        *(F.col(n).alias(f"_{n}") for n in g), F.col("part").alias("_part"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("base"))
    met = F.col("part") == F.col("_part")
    for n in g:
        met &= F.col(n).eqNullSafe(F.col(f"_{n}"))
    return dealt.join(bases, met).select("row.*", (F.col("at") + F.col("base")).alias(rank))
