"""Small files with many rows are dealt out before costly columns are made of them."""

from pyspark.sql import functions as F

from kinweave.operators import survivorship
from kinweave.queries import adt_messages
from kinweave.session import SPREAD_ROWS, TOGETHER, bounded_tasks, spread
from kinweave.sources import derived


def test_spread_keeps_the_rows_and_bounds_each_task(spark):
    rows = spark.range(0, 1000, 1, 1).withColumn("twice", F.col("id") % 500)
    dealt = spread(rows, 100)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 120
    assert sorted(dealt.collect()) == sorted(rows.collect())
    assert spread(rows.limit(0), 100).count() == 0


def test_people_and_messages_of_one_file_are_made_by_many_tasks(spark, tmp_path):
    count = 2 * SPREAD_ROWS + 10
    spark.range(0, count, 1, 1).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, count, 1, 1).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 90).alias("user_id"),
        F.lit("view").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    for made, key in ((derived.people_a_flat(spark, str(tmp_path)), "k"), (adt_messages(spark, str(tmp_path)), "event_id")):
        found = made.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("s")).collect()
        assert len(found) == 3 and max(r["n"] for r in found) <= SPREAD_ROWS + 100
        assert sum(r["n"] for r in found) == count and sum(r["s"] for r in found) == count * (count - 1) // 2


def test_tasks_of_golden_records_hold_no_more_rows_of_a_larger_table(spark):
    settings = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(name) for name in settings]
    try:
        few = bounded_tasks(spark.range(300), 100)
        assert few.count() == 300 and [spark.conf.get(name) for name in settings] == before
        many = bounded_tasks(spark.range(0, 20_000, 1, 3).withColumn("twice", F.col("id") % 10_000), 500)
        assert spark.conf.get(settings[0]) == "40" and spark.conf.get(settings[1]) == str(TOGETHER)
        sums = many.groupBy("twice").agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(sums) == 10_000 and all(r["n"] == 2 for r in sums)
    finally:
        for name, value in zip(settings, before):
            spark.conf.set(name, value)


def test_golden_record_bounds_its_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(survivorship, "bounded_tasks", lambda df: seen.append(df.count()) or df, raising=False)
    rows = derived.with_profile(spark.range(1, 8).selectExpr(
        "id as k", "'A' as family", "'B' as given", "date '1980-01-01' as dob", "'Male' as gender", "'x' as line",
        "'y' as city", "'z' as postcode", "'1' as phone", "'e' as email", "'9' as nhs", "true as trusted",
        "'crm' as source_system", "cast(id as string) as local_id"))
    sources = rows.select("tenant_id", (F.col("k") % 3).cast("string").alias("enterprise_id"), "source_system", "local_id",
                          "profile", F.lit(1).alias("source_trust"), F.timestamp_seconds("k").alias("last_updated"))
    assert survivorship.golden_record(sources).count() == 3 and seen == [7]
