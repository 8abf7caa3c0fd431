"""Ground-truth labels from tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_labels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value) lines to labels and error rows. A header line and blank lines are skipped."""
    line = F.regexp_replace(F.col("value"), "^﻿+|\r+$", "")
    kept = lines.select(line.alias("line")).where(F.trim("line") != "")
    columns = kept.select("line", F.split("line", "\t", -1).alias("c")).where(
        F.lower(F.trim(F.col("c")[0])) != "leftsource"
    )
    label = F.lower(F.trim(F.get("c", F.lit(4))))
    is_match = F.when(label.isin("true", "match", "1"), True).when(
        label.isin("false", "nonmatch", "non-match", "0"), False
    )
    problem = F.when(F.size("c") != 5, "five tab-separated columns are needed").when(
        is_match.isNull(), "the label must be match/non-match, true/false or 1/0"
    )
    judged = columns.withColumn("problem", problem).withColumn("is_match", is_match)
    good = judged.where("problem is null").select(
        F.trim(F.col("c")[0]).alias("left_source"), F.trim(F.col("c")[1]).alias("left_local_id"),
        F.trim(F.col("c")[2]).alias("right_source"), F.trim(F.col("c")[3]).alias("right_local_id"),
        "is_match",
    )
    return good, judged.where("problem is not null").select("line", "problem")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a file; any bad line, or a missing class, fails the read."""
    good, bad = parse_labels(spark.read.text(path))
    worst = bad.limit(1).collect()
    if worst:
        raise ValueError(f"{worst[0]['problem']}: {worst[0]['line']!r}")
    if good.select("is_match").distinct().count() < 2:
        raise ValueError("labels need at least one match and one non-match")
    return good
