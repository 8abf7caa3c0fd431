"""Records with very long lists."""

import time

from pyspark.sql import functions as F

from kinweave.functions.lists import SHORT, distinct
from kinweave.operators import blocking, normalise, survivorship
from kinweave.schemas import PROFILE
from kinweave.sources import derived


def test_distinct_is_array_distinct_of_any_length(spark):
    kind = "array<struct<a:string,b:array<string>,c:boolean>>"
    item = lambda i: None if i % 11 == 5 else (None if i % 5 == 0 else f"x{i * 7 % 40}", None if i % 3 else [str(i % 4)], i % 2 == 0)
    lists = [None] + [[item(i) for i in range(n)] for n in (0, 1, 2, SHORT, SHORT + 1, 200, 1000)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], f"n int, l {kind}")
    found = rows.select("n", F.array_distinct("l").alias("plain"), distinct(F.col("l")).alias("made")).collect()
    assert len(found) == 8 and all(r["plain"] == r["made"] for r in found)
    assert rows.select(distinct(F.col("l")).alias("l")).schema["l"].dataType == rows.schema["l"].dataType


def test_an_identity_with_a_hundred_thousand_identifiers_takes_seconds(spark):
    count = 100_000
    one = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.struct(
        F.lit("urn:x").alias("system"), i.cast("string").alias("value"), F.lit(False).alias("is_verified"),
        F.lit(False).alias("is_authoritative"), F.lit(None).cast("string").alias("use")))
    phones = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.struct(
        F.lit("Phone").alias("system"), F.concat(F.lit("0113"), i.cast("string")).alias("value"), F.lit(None).cast("string").alias("use")))
    fields = spark.createDataFrame([], f"p {PROFILE}").schema["p"].dataType.fields
    given = {"identifiers": one, "telecoms": phones, "gender": F.lit("Unknown"), "is_deceased": F.lit(False)}
    profile = F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    rows = spark.range(1).select(F.lit("demo").alias("tenant_id"), F.lit("A").alias("enterprise_id"), profile.alias("profile"))
    started = time.monotonic()
    keyed = blocking.blocking_keys(normalise.normalise(rows), derived.demo_config())
    sizes = keyed.select(F.size("norm.identifiers"), F.size("norm.telecoms"), F.size("blocking_keys")).collect()
    keys = blocking.explode_keys(keyed, "enterprise_id").count()
    merged = rows.select(survivorship.merge_columns(F.col("profile"), F.col("profile")).alias("p")).select(F.size("p.identifiers")).collect()
    assert [tuple(r) for r in sizes] == [(count, count, count)] and keys == count and merged[0][0] == count
    assert time.monotonic() - started < 60
