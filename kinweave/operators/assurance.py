"""Evaluation of the rules against labelled pairs, and Fellegi-Sunter calibration."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import ConfigurationError, MatchingProfile, ProbabilityModel, TenantConfig
from kinweave.functions.hashing import pair_key
from kinweave.operators import blocking, compare, normalise, scoring
from kinweave.schemas import COMPARISON_LEVELS, EVIDENCE_FIELDS
from kinweave.session import stage

_Z = 1.959963984540054
LEFT = ["left_source", "left_local_id"]
RIGHT = ["right_source", "right_local_id"]


def label_keys(labels: DataFrame) -> DataFrame:
    left = F.concat_ws("/", *LEFT)
    right = F.concat_ws("/", *RIGHT)
    return labels.withColumn("pair_key", pair_key(left, right)).withColumn(
        "pair_hash", F.upper(F.sha2(F.encode("pair_key", "UTF-8"), 256))
    )


def check_labels(labels: DataFrame, sources: DataFrame, longest: int | None = None) -> DataFrame:
    """Problem rows (problem, pair_key); an empty result means the labels may be used.

    References longer than ``longest`` characters are malformed; None allows any length.
    """
    keyed = label_keys(labels)
    left, right = F.concat_ws("/", *LEFT), F.concat_ws("/", *RIGHT)
    itself = keyed.where(left == right).select(F.lit("self-pair").alias("problem"), "pair_key")
    repeated = (
        keyed.groupBy("pair_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.lit("duplicate-or-contradictory").alias("problem"), "pair_key")
    )
    malformed = keyed.where(
        reduce(
            lambda a, b: a | b,
            (F.col(c).isNull() | (F.trim(c) == "") | (F.length(c) > longest if longest else F.lit(False))
             | F.col(c).rlike(r"[\x00-\x1F\x7F-\x9F]") for c in (LEFT[1], RIGHT[1])),
        )
    ).select(F.lit("malformed-reference").alias("problem"), "pair_key")
    ends = keyed.select("pair_key", F.explode(F.array(
        F.struct(F.col(LEFT[0]).alias("source_system"), F.col(LEFT[1]).alias("local_id")),
        F.struct(F.col(RIGHT[0]).alias("source_system"), F.col(RIGHT[1]).alias("local_id")),
    )).alias("_end")).select("pair_key", "_end.*")
    unknown = ends.join(
        sources.select("source_system", "local_id"), ["source_system", "local_id"], "left_anti"
    ).select(F.lit("unknown-reference").alias("problem"), "pair_key").distinct()
    # A whole-set problem: one class is absent.
    classes = labels.agg(
        F.count_if("is_match").alias("matches"), F.count_if(~F.col("is_match")).alias("others")
    ).where("matches = 0 or others = 0").select(
        F.lit("one-class-only").alias("problem"), F.lit("").alias("pair_key")
    )
    return reduce(DataFrame.unionByName, (itself, repeated, malformed, unknown, classes))


def resolve_labels(labels: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach both source rows (norm and keys) to each label.

    Labels of unknown records have none and are left out; ``check_labels`` names them.
    """
    def side(prefix: str, columns: list[str]) -> DataFrame:
        return sources.select(
            F.col("source_system").alias(columns[0]), F.col("local_id").alias(columns[1]),
            F.col("norm").alias(f"{prefix}_norm"), F.col("blocking_keys").alias(f"{prefix}_keys"),
        )

    return labels.join(side("left", LEFT), LEFT).join(side("right", RIGHT), RIGHT)


def observe_pairs(labels: DataFrame, sources: DataFrame, cfg: TenantConfig) -> DataFrame:
    """One scored row per label: evidence, score, grade, conflict, eligibility and shared key."""
    prepared = blocking.blocking_keys(normalise.normalise(sources), cfg)
    joined = resolve_labels(label_keys(labels), prepared)
    eligible = (F.size("left_keys") > 0) & (F.size("right_keys") > 0)
    joined = joined.withColumn("both_eligible", eligible).withColumn(
        "shared_key", blocking.shares_key(F.col("left_keys"), F.col("right_keys"))
    )
    scored = scoring.score(compare.compare(joined, cfg.profile), cfg.profile)
    return scored.drop("left_norm", "right_norm", "left_keys", "right_keys")


def blocking_recall(observations: DataFrame) -> DataFrame:
    return observations.agg(
        F.count_if("is_match").alias("matches"),
        F.count_if(F.col("is_match") & F.col("both_eligible")).alias("eligible_matches"),
        F.count_if(F.col("is_match") & F.col("shared_key")).alias("shared_matches"),
    ).withColumn(
        "blocking_recall",
        F.when(F.col("matches") > 0, F.col("shared_matches") / F.col("matches")),
    )


def thresholds(rules: MatchingProfile, given: list[float] | None = None) -> list[float]:
    values = [step / 20 for step in range(21)] if not given else list(given)
    made = sorted({*values, rules.possible, rules.probable})
    if any(not math.isfinite(v) or not 0 <= v <= 1 for v in made):
        raise ConfigurationError("thresholds: finite values in [0, 1]")
    return made


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _wilson(successes: Column, count: Column) -> tuple[Column, Column]:
    share = successes / count
    z2 = _Z * _Z
    below = 1 + z2 / count
    centre = (share + z2 / (2 * count)) / below
    margin = F.lit(_Z) / below * F.sqrt(share * (1 - share) / count + z2 / (4.0 * count * count))
    low = F.when(count > 0, F.greatest(F.lit(0.0), centre - margin))
    high = F.when(count > 0, F.least(F.lit(1.0), centre + margin))
    return low, high


def confusion(scored: DataFrame, cuts: list[float]) -> DataFrame:
    """TP, FP, TN, FN per threshold from (decision_score, is_match, always_positive).

    All thresholds are counted in one pass: each row carries how many cuts it reaches, rows are
    counted by that number, and running sums over at most 102 numbers give every matrix.
    """
    reached = F.when(F.col("always_positive"), F.lit(len(cuts))).otherwise(
        reduce(
            lambda a, b: a + b, (F.when(F.col("decision_score") >= cut, 1).otherwise(0) for cut in cuts)
        )
    )
    counted = scored.groupBy(reached.alias("reached")).agg(
        F.count_if("is_match").alias("m"), F.count_if(~F.col("is_match")).alias("u")
    )
    totals = counted.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("all_m"),
        F.coalesce(F.sum("u"), F.lit(0)).alias("all_u"),
        F.collect_list(F.struct("reached", "m", "u")).alias("steps"),
    )
    grid = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(c).alias("threshold"))
                     for i, c in enumerate(cuts)))

    def above(field: str, at: Column) -> Column:
        kept = F.filter(F.col("steps"), lambda s: s["reached"] > at)
        return F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, s: acc + s[field])

    rows = totals.withColumn("_cut", F.explode(grid))
    return rows.select(
        F.col("_cut.threshold").alias("threshold"),
        above("m", F.col("_cut.at")).alias("tp"),
        above("u", F.col("_cut.at")).alias("fp"),
        "all_m", "all_u",
    ).select(
        "threshold", "tp", "fp",
        (F.col("all_u") - F.col("fp")).alias("tn"), (F.col("all_m") - F.col("tp")).alias("fn"),
    )


def with_metrics(matrix: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    made = matrix.select(
        "*",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tn, tn + fp).alias("specificity"),
        _ratio(tn, tn + fn).alias("npv"),
    )
    p, r = F.col("precision"), F.col("recall")
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    p_low, p_high = _wilson(tp, tp + fp)
    r_low, r_high = _wilson(tp, tp + fn)
    return made.select(
        "*",
        F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"),
        F.when(below > 0, (tp * tn - fp * fn) / below).alias("mcc"),
        p_low.alias("precision_low"), p_high.alias("precision_high"),
        r_low.alias("recall_low"), r_high.alias("recall_high"),
    )


def classification_metrics(observations: DataFrame, cuts: list[float]) -> DataFrame:
    """A hard conflict never counts as positive by score; a Certain grade always does."""
    scored = observations.select(
        "is_match",
        F.when(F.col("has_hard_conflict"), -1.0).otherwise(F.col("score")).alias("decision_score"),
        (F.col("grade") == "Certain").alias("always_positive"),
    )
    return with_metrics(confusion(scored, cuts))


def misclassified(
    observations: DataFrame, rules: MatchingProfile, cuts: list[float], n: int = 100
) -> DataFrame:
    """Most confident errors at the threshold nearest the probable one."""
    if n < 0:
        raise ConfigurationError("the number of error examples must not be negative")
    at = min(cuts, key=lambda cut: (abs(cut - rules.probable), cut))
    predicted = ~F.col("has_hard_conflict") & (
        (F.col("grade") == "Certain") | (F.col("score") >= at)
    )
    return (
        observations.where(predicted != F.col("is_match"))
        .orderBy(F.desc(F.abs(F.col("score") - 0.5)), "pair_key")
        .limit(n)
    )


def field_discrimination(observations: DataFrame) -> DataFrame:
    """Observed counts and mean similarity per field and class."""
    e = observations.select("is_match", F.explode("evidence").alias("e")).where("not e.is_missing")
    return e.groupBy(F.col("e.field").alias("field")).agg(
        F.count_if("is_match").alias("match_observations"),
        F.count_if(~F.col("is_match")).alias("non_match_observations"),
        F.avg(F.when(F.col("is_match"), F.col("e.similarity"))).alias("match_mean"),
        F.avg(F.when(~F.col("is_match"), F.col("e.similarity"))).alias("non_match_mean"),
    )


def split_labels(observations: DataFrame, fraction: float) -> DataFrame:
    """Add ``is_validation``: per class, the first rows by stable hash are held out.

    The cut-off row is found from counts per hash prefix, so no class is ever sorted in one task:
    whole prefixes below the cut are in, and only the prefix that holds the cut is ranked.
    """
    totals = observations.groupBy("is_match").agg(F.count(F.lit(1)).alias("_n"))
    wanted = totals.withColumn(
        "_held",
        F.greatest(
            F.lit(2), F.least(F.round(F.col("_n") * F.lit(fraction)).cast("bigint"), F.col("_n") - 5)
        ),
    )
    prefixed = observations.withColumn("_prefix", F.substring("pair_hash", 1, 4))
    sizes = prefixed.groupBy("is_match", "_prefix").agg(F.count(F.lit(1)).alias("_size"))
    order = Window.partitionBy("is_match").orderBy("_prefix")
    cuts = (
        sizes.withColumn("_before", F.sum("_size").over(order) - F.col("_size"))
        .join(wanted.select("is_match", "_held"), "is_match")
        .select(
            "is_match", "_prefix",
            F.when(F.col("_before") + F.col("_size") <= F.col("_held"), F.col("_size"))
            .when(F.col("_before") >= F.col("_held"), F.lit(0))
            .otherwise(F.col("_held") - F.col("_before"))
            .alias("_take"),
            "_size",
        )
    )
    joined = prefixed.join(cuts, ["is_match", "_prefix"])
    inside = Window.partitionBy("is_match", "_prefix").orderBy("pair_hash")
    return (
        joined.withColumn("is_validation", F.row_number().over(inside) <= F.col("_take"))
        .drop("_prefix", "_take", "_size")
    )


def level_counts(observations: DataFrame, smoothing: float) -> DataFrame:
    """Smoothed m and u for every field and level, also for levels never seen."""
    e = observations.select("is_match", F.explode("evidence").alias("e")).where("not e.is_missing")
    seen = e.groupBy(
        F.col("e.field").alias("field"), F.col("e.comparison_level").alias("level")
    ).agg(F.count_if("is_match").alias("m_n"), F.count_if(~F.col("is_match")).alias("u_n"))
    grid = observations.sparkSession.createDataFrame(
        [(f, i, level) for f in EVIDENCE_FIELDS for i, level in enumerate(COMPARISON_LEVELS)],
        "field string, level_order int, level string",
    )
    full = grid.join(seen, ["field", "level"], "left").fillna(0, ["m_n", "u_n"])
    by_field = Window.partitionBy("field")
    s = F.lit(float(smoothing))
    return full.select(
        "field", "level", "level_order", "m_n", "u_n",
        ((F.col("m_n") + s) / (F.sum("m_n").over(by_field) + s * 4)).alias("m"),
        ((F.col("u_n") + s) / (F.sum("u_n").over(by_field) + s * 4)).alias("u"),
    )


def fit_fellegi_sunter(
    training: DataFrame, version: str, prior: float, smoothing: float, digest: str | None = None
) -> ProbabilityModel:
    rows = level_counts(training, smoothing).collect()  # 24 rows
    made = ProbabilityModel(
        version, prior, tuple((r["field"], r["level"], r["m"], r["u"]) for r in rows), digest
    )
    made.check()
    return made


def brier_log_loss(scored: DataFrame) -> DataFrame:
    truth = F.col("is_match").cast("double")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("decision_score")))
    return scored.agg(
        F.avg(F.pow(F.col("decision_score") - truth, 2)).alias("brier"),
        F.avg(F.when(F.col("is_match"), -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"),
    )


def dataset_digest(observations: DataFrame) -> str:
    """A digest of the labelled pairs in any order, the same rule for every size.

    The lines ``pair|label`` are hashed, the eight words of the hashes summed up, and the sums hashed.
    """
    line = F.concat_ws("|", "pair_key", F.when(F.col("is_match"), "1").otherwise("0"))
    lines = observations.select(line.alias("line"))
    hashed = lines.select(F.sha2(F.encode("line", "UTF-8"), 256).alias("h"))
    parts = [
        F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(8)
    ]
    total = hashed.agg(F.count(F.lit(1)).cast("string").alias("n"), F.concat_ws(",", *parts).alias("s"))
    return total.select(F.sha2(F.concat_ws(",", "n", "s"), 256)).first()[0]


def evaluate(
    labels: DataFrame, sources: DataFrame, cfg: TenantConfig,
    cuts: list[float] | None = None, examples: int = 100,
) -> dict[str, DataFrame | str]:
    """All evaluation tables over one staged set of observations.

    Labels with problems are refused as a whole, as figures over a part of them would mislead.
    """
    rules = cfg.profile
    bad = check_labels(labels, sources).groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()
    if bad:
        raise ConfigurationError("labels: " + ", ".join(f"{r['n']} {r['problem']}" for r in bad))
    seen = stage(observe_pairs(labels, sources, cfg), "observations")
    chosen = thresholds(rules, cuts)
    return {
        "observations": seen,
        "digest": dataset_digest(seen),
        "blocking": blocking_recall(seen),
        "metrics": classification_metrics(seen, chosen),
        "fields": field_discrimination(seen),
        "misclassified": misclassified(seen, rules, chosen, examples),
    }


def calibrate(
    observations: DataFrame, rules: MatchingProfile, version: str, prior: float = 0.01,
    smoothing: float = 1.0, fraction: float = 0.2, target_precision: float = 0.95,
) -> dict:
    """Fit on the training part, choose thresholds on the held-out part. Nothing is activated."""
    if not (version.strip() and len(version) <= 64 and 0 < prior < 1 and 0 < smoothing <= 100
            and 0.1 <= fraction <= 0.5 and 0 < target_precision <= 1):
        raise ConfigurationError("calibration settings out of range")
    parts = stage(split_labels(observations, fraction), "calibration")
    sizes = {
        (r["is_match"], r["is_validation"]): r["n"]
        for r in parts.groupBy("is_match", "is_validation").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    for label in (True, False):
        if sizes.get((label, True), 0) + sizes.get((label, False), 0) < 10:
            raise ConfigurationError("calibration needs ten matches and ten non-matches")
    digest = dataset_digest(parts)
    model = fit_fellegi_sunter(parts.where("not is_validation"), version, prior, smoothing, digest)
    held = stage(
        parts.where("is_validation").select(
            "is_match",
            scoring.logistic(scoring.log_odds(F.col("evidence"), model)).alias("decision_score"),
            F.lit(False).alias("always_positive"),
        ),
        "validation",
    )
    grid = [step / 100 for step in range(1, 100)]
    metrics = {r["threshold"]: r for r in with_metrics(confusion(held, grid)).collect()}  # 99 rows
    precise = [
        t for t in grid
        if metrics[t]["precision"] is not None and metrics[t]["precision"] >= target_precision
    ]
    probable = precise[0] if precise else None
    scored = [t for t in grid if metrics[t]["f1"] is not None]
    f1_best = min(scored, key=lambda t: (-metrics[t]["f1"], t)) if scored else None
    possible = min(f1_best, probable / 2) if probable is not None and f1_best is not None else f1_best
    losses = brier_log_loss(held).first()
    chosen = sorted({t for t in (possible, probable, rules.possible, rules.probable) if t is not None})
    return {
        "model": model,
        "digest": digest,
        "training_matches": sizes.get((True, False), 0),
        "training_non_matches": sizes.get((False, False), 0),
        "validation_matches": sizes.get((True, True), 0),
        "validation_non_matches": sizes.get((False, True), 0),
        "brier": losses["brier"],
        "log_loss": losses["log_loss"],
        "recommended_possible": possible,
        "recommended_probable": probable,
        "metrics": with_metrics(confusion(held, chosen)),
        "grid": with_metrics(confusion(held, grid)),
    }
