"""Scores and grades from evidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.config import MatchingProfile, ProbabilityModel
from kinweave.schemas import COMPARISON_LEVELS, EVIDENCE_FIELDS

_FLOOR = 1e-12


def _clamp(value: float) -> float:
    return min(max(value, _FLOOR), 1 - _FLOOR)


def weighted_score(evidence: Column, rules: MatchingProfile) -> Column:
    """Sum of similarity x weight over the total weight, added in field order."""
    total = F.lit(0.0)
    for position in range(len(EVIDENCE_FIELDS)):
        item = evidence[position]
        total = total + item["similarity"] * item["weight"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.lit(rules.weights.total)))


def _llr(item: Column, name: str, model: ProbabilityModel) -> Column:
    """ln m - ln u of the observed level; 0 when the field was not observed."""
    ratio = {
        level: math.log(_clamp(m)) - math.log(_clamp(u))
        for field, level, m, u in model.levels
        if field == name
    }
    chosen = F.lit(ratio[COMPARISON_LEVELS[-1]])
    for level in reversed(COMPARISON_LEVELS[:-1]):
        chosen = F.when(item["comparison_level"] == level, ratio[level]).otherwise(chosen)
    return F.when(item["is_missing"], 0.0).otherwise(chosen)


def with_log_ratios(evidence: Column, model: ProbabilityModel) -> Column:
    return F.array(
        *(
            evidence[position].withField("log_likelihood_ratio",
                                         _llr(evidence[position], name, model))
            for position, name in enumerate(EVIDENCE_FIELDS)
        )
    )


def log_odds(evidence: Column, model: ProbabilityModel) -> Column:
    prior = _clamp(model.prior)
    total = F.lit(math.log(prior / (1 - prior)))
    for position, name in enumerate(EVIDENCE_FIELDS):
        total = total + _llr(evidence[position], name, model)
    return total


def logistic(odds: Column) -> Column:
    positive = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    negative = F.exp(odds) / (F.lit(1.0) + F.exp(odds))
    value = F.when(odds >= 0, positive).otherwise(negative)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def grade_column(score: Column, certain: Column, conflict: Column, rules: MatchingProfile) -> Column:
    return (
        F.when(certain & ~conflict, "Certain")
        .when(score >= rules.probable, "Probable")
        .when(score >= rules.possible, "Possible")
        .otherwise("None")
    )


def score(compared: DataFrame, rules: MatchingProfile) -> DataFrame:
    """Add ``score``, ``grade`` and ``score_method`` to a compared pairs table."""
    evidence = F.col("evidence")
    if rules.model is None:
        made = compared.withColumn("score", weighted_score(evidence, rules))
        method = "weighted-similarity"
    else:
        made = compared.withColumn("_odds", log_odds(evidence, rules.model)).withColumn(
            "score", logistic(F.col("_odds"))
        ).withColumn("evidence", with_log_ratios(evidence, rules.model)).drop("_odds")
        method = "fellegi-sunter"
    return made.withColumn(
        "grade",
        grade_column(F.col("score"), F.col("is_certain"), F.col("has_hard_conflict"), rules),
    ).withColumn("score_method", F.lit(method))
