"""Pairs made in their blocks, without a cap, against brute force; and what they move."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking
from kinweave.plans import registry as reg
from kinweave.plans import upsert
from kinweave.session import stage

from test_matching import index_of
from test_upsert import config, rows_of


def made(seed):
    r = random.Random(seed)
    rows = {f"p{i:03}": {f"k{r.randrange(25)}" for _ in range(r.randrange(1, 5))} for i in range(60)}
    for i in range(0, 60, 3):
        rows[f"p{i:03}"].add("hot")
    return rows


@pytest.mark.parametrize("tile", [1024, 4])
def test_uncapped_pairs_come_once_each(spark, monkeypatch, tile):
    monkeypatch.setattr(blocking, "TILE_ROWS", tile)
    rows = made(tile)
    index = index_of(spark, rows)
    got = blocking.self_candidates(index.unionByName(index))[0].select("subject_id", "candidate_id").collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == {(a, b) for a in rows for b in rows if a < b and rows[a] & rows[b]}

    asked = {f"q{i}": keys for i, keys in enumerate(list(made(9).values())[:30])}
    keys = index_of(spark, asked).withColumnRenamed("enterprise_id", "query_id")
    found = blocking.candidates(keys, index)[0].collect()
    assert sorted((x["query_id"], x["candidate_id"]) for x in found) == sorted((q, b) for q in asked for b in rows if asked[q] & rows[b])
    assert all(x["candidate_count"] == sum(bool(asked[x["query_id"]] & k) for k in rows.values()) for x in found)


def test_carried_rows_that_repeat_repeat_the_pair(spark):
    index = index_of(spark, {"a": {"x", "y"}, "b": {"x", "y"}, "c": {"z"}})
    more = spark.createDataFrame([("t", "a", 1), ("t", "a", 2), ("t", "b", 3), ("t", "c", 4)], "tenant_id string, i string, v int")
    side = lambda name: (index.withColumnRenamed("enterprise_id", f"{name}_id"), more.withColumnsRenamed({"i": f"{name}_id", "v": f"{name}_v"}))
    (left, left_more), (right, right_more) = side("left"), side("right")
    met = blocking.met_once(left, right, "left_id", "right_id", left_more, right_more, ascending=True)
    assert sorted((x["left_v"], x["right_v"]) for x in met.collect()) == [(1, 3), (2, 3)]


def test_pairs_are_not_shuffled(spark):
    index = spark.range(0, 400, 1, 2).select(
        F.lit("t").alias("tenant_id"), F.lit("v1").alias("key_version"), F.lit("k").alias("key_value"),
        F.col("id").cast("string").alias("enterprise_id"))
    pairs = blocking.self_candidates(index)[0]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [tenant_id" not in plan.split("Join")[0], plan  # nothing is made distinct above the join
    assert pairs.count() == 400 * 399 // 2


def test_reviews_of_new_identities_write_no_pairs(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(upsert, "stage", lambda df, name: written.setdefault(name, stage(df, name)))
    day = dt.date(1980, 1, 2)
    rows = [("c", f"{i:03}", f"Name{i:03}" if i < 118 else "Twin", "G", day if i > 117 else None, "0113 4960000", None) for i in range(120)]
    done = upsert.upsert(reg.Registry(spark), rows_of(spark, rows), config(500), F.to_timestamp(F.lit("2024-02-01")))
    assert done.counters["accepted"] == 120
    assert max(df.count() for df in written.values()) <= 120  # 7,140 pairs share the number
    twins = {r["local_id"]: r["enterprise_id"] for r in done.results.where("local_id >= '118'").collect()}
    found = [(r["subject_id"], r["candidate_id"], r["subject_version"], r["candidate_version"]) for r in done.reviews.collect()]
    assert found == [(twins["119"], twins["118"], 1, 1)]
