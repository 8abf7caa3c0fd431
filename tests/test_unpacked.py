"""Joins of working tables whose files are far smaller than their rows."""

import pytest
from pyspark.sql import functions as F

from kinweave.plans import registry as reg
from kinweave.plans import upsert as plan
from kinweave.session import stage, unpacked
from kinweave.sources import derived, hl7
from kinweave.streaming import adt

FACTOR = "spark.sql.sources.fileCompressionFactor"


def test_small_files_of_large_rows_are_not_broadcast(spark):
    def joined(registry):
        made = spark.range(0, 200_000, 1, 1).select("id", F.repeat(F.lit("x"), 500).alias("text"))
        left, right = stage(made, "left"), stage(made, "right")
        return left.join(right, "id")._jdf.queryExecution().executedPlan().toString()

    before, registry = spark.conf.get(FACTOR), reg.Registry(spark)
    assert "BroadcastHashJoin" in joined(registry)  # 100 MB, read from files of less than 10
    assert "BroadcastHashJoin" not in unpacked(joined)(registry)
    assert spark.conf.get(FACTOR) == before


def test_upserts_and_messages_plan_their_joins_so(spark, monkeypatch):
    seen, before = [], spark.conf.get(FACTOR)

    def stop(*_):
        seen.append(float(spark.conf.get(FACTOR)))
        raise RuntimeError("seen")

    monkeypatch.setattr(plan, "_prepared", stop)
    monkeypatch.setattr(hl7, "parse_adt", stop)
    cfg, now = derived.demo_config(), F.current_timestamp()
    messages = spark.createDataFrame([], "message string, arrival timestamp")
    for job in (lambda: plan.upsert(reg.Registry(spark), messages, cfg, now), lambda: adt.apply_adt(reg.Registry(spark), messages, "hosp", cfg, now)):
        with pytest.raises(RuntimeError, match="seen"):
            job()
        assert spark.conf.get(FACTOR) == before
    assert seen == [32.0, 32.0]
