"""Field-by-field comparison of record pairs into an ``evidence`` array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.config import MatchingProfile
from kinweave.functions.once import computed_once
from kinweave.operators.name_scores import best_names

_RESULT = "struct<sim:double,comparator:string,detail:string>"


def _result(similarity, comparator, detail=None) -> Column:
    return F.struct(
        similarity.alias("sim"),
        F.lit(comparator).alias("comparator") if isinstance(comparator, str)
        else comparator.alias("comparator"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
    )


def _later_must_beat(best: Column, new: Column) -> Column:
    """Keep the earlier of two results unless the later is strictly better."""
    return F.when(new["sim"] > best["sim"], new).otherwise(best)


def _cross(lefts: Column, rights: Column, pair) -> Column:
    """All pairs of two short arrays. One value on each side, the usual case, needs no lambda."""
    both_single = (F.size(lefts) == 1) & (F.size(rights) == 1)
    crossed = F.flatten(F.transform(lefts, lambda a: F.transform(rights, lambda b: pair(a, b))))
    return F.when(both_single, F.array(pair(F.get(lefts, F.lit(0)), F.get(rights, F.lit(0))))).otherwise(
        crossed
    )


def _birth_date(left: Column, right: Column) -> tuple[Column, Column, Column]:
    a, b = left["birth_date"], right["birth_date"]
    missing = a.isNull() | b.isNull()
    swapped = (
        (F.year(a) == F.year(b))
        & (F.dayofmonth(a) == F.month(b))
        & (F.month(a) == F.dayofmonth(b))
    )
    similarity = F.when(missing, 0.0).when(a == b, 1.0).when(swapped, 0.5).otherwise(0.0)
    comparator = (
        F.when(missing, "exact/day-month-transposition")
        .when(a == b, "exact")
        .when(swapped, "day-month-transposition")
        .otherwise("exact")
    )
    return similarity, comparator, missing


def _address_facts(left: Column, right: Column) -> Column:
    """Per address pair: postcode score, shared words, words in all. Nothing is decided yet, so that
    the costly set operation is written, and evaluated, once."""
    def one(a: Column, b: Column) -> Column:
        code = (
            F.when((a["postcode"] != "") & (a["postcode"] == b["postcode"]), 1.0)
            .when((a["sector"] != "") & (a["sector"] == b["sector"]), 0.6)
            .otherwise(0.0)
        )
        return F.struct(
            code.alias("code"),
            F.size(F.array_intersect(a["words"], b["words"])).alias("shared"),
            (F.size(a["words"]) + F.size(b["words"])).alias("total"),
        )

    return _cross(left["addresses"], right["addresses"], one)


def _address_result(facts: Column) -> Column:
    union = facts["total"] - facts["shared"]
    words = F.when(union > 0, facts["shared"].cast("double") / union).otherwise(0.0)
    label = F.when(
        facts["code"] >= words,
        F.when(facts["code"] == 1.0, "postcode-exact").otherwise("postcode-sector"),
    ).otherwise("token-jaccard")
    return _result(F.greatest(facts["code"], words), label)


def _best_address(facts: Column) -> Column:
    """Best address pair of ``_address_facts``; ties keep the earlier pair."""
    start = _result(F.lit(0.0), "token-jaccard").cast(_RESULT)
    best = F.aggregate(
        facts, start, lambda acc, new: _later_must_beat(acc, _address_result(new).cast(_RESULT))
    )
    return F.when(
        F.size(facts) == 1, _later_must_beat(start, _address_result(F.get(facts, F.lit(0))))
    ).otherwise(best)


def _address(facts: Column, best: Column) -> tuple[Column, Column, Column]:
    missing = F.size(facts) == 0
    comparator = F.when(missing, "postcode/token-jaccard").otherwise(best["comparator"])
    return best["sim"], comparator, missing


def _telecom(left: Column, right: Column) -> tuple[Column, Column, Column]:
    missing = (F.size(left["telecoms"]) == 0) | (F.size(right["telecoms"]) == 0)
    same = F.arrays_overlap(left["telecoms"], right["telecoms"])
    return F.when(~missing & same, 1.0).otherwise(0.0), F.lit("normalised-exact"), missing


def _gender(left: Column, right: Column) -> tuple[Column, Column, Column]:
    missing = (left["gender"] == "Unknown") | (right["gender"] == "Unknown")
    same = ~missing & (left["gender"] == right["gender"])
    return F.when(same, 1.0).otherwise(0.0), F.lit("exact"), missing


def comparison_level(similarity: Column) -> Column:
    return (
        F.when(similarity >= 0.999999, "Exact")
        .when(similarity >= 0.85, "Strong")
        .when(similarity >= 0.5, "Partial")
        .otherwise("Different")
    )


def assess_identifiers(left: Column, right: Column, rules: MatchingProfile) -> tuple[Column, Column]:
    """(certain, conflict): a shared trusted value, and a system whose trusted values are disjoint."""
    certain, conflict = F.lit(False), F.lit(False)
    for system in rules.identifier_systems:
        a = F.filter(left["trusted"], lambda x: x["system"] == system)
        b = F.filter(right["trusted"], lambda x: x["system"] == system)
        both = (F.size(a) > 0) & (F.size(b) > 0)
        overlap = F.arrays_overlap(a, b)
        certain = certain | (both & overlap)
        conflict = conflict | (both & ~overlap)
    return certain, conflict


def compare(
    pairs: DataFrame, rules: MatchingProfile, left: str = "left_norm", right: str = "right_norm"
) -> DataFrame:
    """Add ``evidence`` (six fields in fixed order), ``is_certain`` and ``has_hard_conflict``."""
    kinds = rules.comparators
    a, b = F.col(left), F.col(right)
    df = pairs.withColumn("_names", best_names(a, b, kinds))
    df = df.withColumns({"_family_best": F.col("_names.family"), "_given_best": F.col("_names.given")})
    certain, conflict = assess_identifiers(a, b, rules)
    dob_differs = F.coalesce(a["birth_date"] != b["birth_date"], F.lit(False))
    df = computed_once(
        df,
        {
            "_places": _address_facts(a, b),
            "_dob": F.struct(*_named(_birth_date(a, b))),
            "_telecom": F.struct(*_named(_telecom(a, b))),
            "_gender": F.struct(*_named(_gender(a, b))),
            "_trust": F.struct(certain.alias("certain"), conflict.alias("conflict"), dob_differs.alias("dob_differs")),
        },
    )
    # from here on the profiles themselves are not read
    df = computed_once(df, {"_place_best": _best_address(F.col("_places"))})
    df = df.withColumn("_address", F.struct(*_named(_address(F.col("_places"), F.col("_place_best")))))
    weights = rules.weights
    family_missing = F.col("_family_best.pairs") == 0
    given_missing = F.col("_given_best.pairs") == 0
    given_label = F.when(given_missing, "configured-string-library").otherwise(
        F.col("_given_best.comparator")
    )
    rows = [
        _evidence("family", F.col("_family_best.sim"), weights.family,
                  F.col("_family_best.comparator"), F.col("_family_best.detail"), family_missing),
        _evidence("given", F.col("_given_best.sim"), weights.given, given_label,
                  F.col("_given_best.detail"), given_missing),
    ]
    for name, column, weight in (
        ("birthDate", "_dob", weights.birth_date),
        ("address", "_address", weights.address),
        ("telecom", "_telecom", weights.telecom),
        ("gender", "_gender", weights.gender),
    ):
        rows.append(
            _evidence(name, F.col(f"{column}.sim"), weight, F.col(f"{column}.comparator"),
                      F.lit(None).cast("string"), F.col(f"{column}.missing"))
        )
    made = (
        df.withColumn("evidence", F.array(*rows))
        .withColumn("is_certain", F.col("_trust.certain"))
        .withColumn("has_hard_conflict", F.col("_trust.conflict") | (F.col("_trust.certain") & F.col("_trust.dob_differs")))
    )
    helpers = [name for name in made.columns if name.startswith("_") and name not in pairs.columns]
    return made.drop(*helpers)


def _named(parts: tuple[Column, Column, Column]) -> list[Column]:
    similarity, comparator, missing = parts
    return [similarity.alias("sim"), comparator.alias("comparator"), missing.alias("missing")]


def _evidence(
    name: str, similarity: Column, weight: float, comparator: Column, detail: Column,
    missing: Column,
) -> Column:
    return F.struct(
        F.lit(name).alias("field"),
        similarity.alias("similarity"),
        F.lit(float(weight)).alias("weight"),
        comparator.alias("comparator"),
        detail.alias("detail"),
        missing.alias("is_missing"),
        comparison_level(similarity).alias("comparison_level"),
        F.lit(None).cast("double").alias("log_likelihood_ratio"),
    )
