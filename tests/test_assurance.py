"""Evaluation and calibration on ten clear matches and ten clear non-matches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinweave.config import ConfigurationError
from kinweave.operators import assurance
from kinweave.schemas import PROFILE
from test_upsert import config, make_profile


def data(spark):
    rows, pairs = [], []
    for i in range(10):
        same = make_profile(f"FAMILY{i}", "ALEX", dt.date(1980, 1, 1 + i), f"01{i}", None)
        other = make_profile("ZULU", "SAM", dt.date(1930, 3, 1 + i), f"99{i}", None)
        rows += [("t1", "left", f"{i}", same), ("t1", "right", f"{i}", same), ("t1", "right", f"x{i}", other)]
        pairs += [("left", f"{i}", "right", f"{i}", True), ("left", f"{i}", "right", f"x{i}", False)]
    sources = spark.createDataFrame(
        rows, f"tenant_id string, source_system string, local_id string, profile {PROFILE}")
    labels = spark.createDataFrame(
        pairs, "left_source string, left_local_id string, right_source string, right_local_id string, is_match boolean")
    return sources, labels


def test_evaluate_and_calibrate(spark):
    sources, labels = data(spark)
    cfg = config()
    assert assurance.check_labels(labels, sources).count() == 0
    report = assurance.evaluate(labels, sources, cfg)
    recall = report["blocking"].first()
    assert recall["blocking_recall"] == 1.0 and recall["matches"] == 10
    metrics = {r["threshold"]: r for r in report["metrics"].collect()}
    assert len(metrics) == 23 and metrics[0.0]["tp"] == 10 and metrics[0.0]["fp"] == 10
    at = metrics[0.62]
    assert (at["tp"], at["fp"], at["tn"], at["fn"]) == (10, 0, 10, 0) and at["mcc"] == 1 and at["f1"] == 1
    assert report["misclassified"].count() == 0 or metrics[0.82]["fn"] > 0
    assert len(report["digest"]) == 64
    made = assurance.calibrate(report["observations"], cfg.profile, "fs-v1")
    assert (made["training_matches"], made["training_non_matches"]) == (8, 8)
    assert (made["validation_matches"], made["validation_non_matches"]) == (2, 2)
    made["model"].check()
    assert made["recommended_probable"] is not None and made["brier"] < 0.05
    few = report["observations"].where(~F.col("is_match") | F.col("pair_key").like("left/1|%"))
    with pytest.raises(ConfigurationError):
        assurance.calibrate(few, cfg.profile, "fs-v1")


def test_label_problems(spark):
    sources, labels = data(spark)
    bad = labels.unionByName(labels.limit(1).withColumn("is_match", ~F.col("is_match"))).unionByName(
        labels.limit(1).withColumn("right_local_id", F.lit("nobody"))).unionByName(
        labels.limit(1).withColumn("right_source", F.lit("left")).withColumn("right_local_id", F.col("left_local_id")))
    got = sorted(r["problem"] for r in assurance.check_labels(bad, sources).collect())
    assert got == ["duplicate-or-contradictory", "self-pair", "unknown-reference"]
    ones = assurance.check_labels(labels.where("is_match"), sources).collect()
    assert [r["problem"] for r in ones] == ["one-class-only"]
