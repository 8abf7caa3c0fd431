"""Counts that describe a population, a feed, a review queue and the runs of a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.config import NHS_SYSTEM
from kinweave.functions import text as t
from kinweave.functions.lists import distinct
from kinweave.operators import blocking
from kinweave.session import stage

SOURCE = ["tenant_id", "source_system", "local_id"]


def _shared_identifiers(rows: DataFrame) -> DataFrame:
    """(_row, _own, _any): rows that carry an identifier another row of their source, or any other row, carries."""
    whole = F.filter("identifiers", lambda x: ~t.is_blank(x["system"]) & ~t.is_blank(x["value"]))
    held = rows.select(
        "_row", "tenant_id", "source_system",
        F.explode(distinct(F.transform(whole, lambda x: F.struct(x["system"], x["value"])))).alias("i"),
    ).select("_row", "tenant_id", F.coalesce("source_system", F.lit("")).alias("_source"), "i.*")
    value = ["tenant_id", "system", "value"]
    by_source = held.groupBy(*value, "_source").agg(F.count(F.lit(1)).alias("_n"))
    shared = by_source.groupBy(*value).agg(F.sum("_n").alias("_all")).where("_all > 1")
    counts = by_source.join(shared, value)
    return held.join(counts, [*value, "_source"]).groupBy("_row").agg(
        F.max(F.col("_n") > 1).alias("_own"), F.max(F.col("_all") > 1).alias("_any"))


def profile_population(sources: DataFrame, subgroup: Column | None = None) -> DataFrame:
    """Completeness and validity by source, and by source and ``subgroup`` (the gender if not named).

    A source's own row has a null ``subgroup``. Rows count as active unless a column ``is_active`` says
    otherwise. ``malformed_ids`` holds the missing ones too. ``identifier_duplicates`` are the rows with an
    identifier that another row of the source carries, ``identifier_collisions`` those with one that any
    other row carries.
    """
    p = F.col("profile")
    nhs = F.filter(p["identifiers"], lambda x: x["system"] == NHS_SYSTEM)
    has = F.size(nhs) > 0
    valid = F.exists(nhs, lambda x: t.nhs_valid(x["value"]))
    active = F.coalesce("is_active", F.lit(True)) if "is_active" in sources.columns else F.lit(True)

    def tagged(code: str):
        return F.exists(p["tags"], lambda x: F.lower(x["code"]) == code)

    def absent(name: str, f):
        return ~F.coalesce(F.exists(p[name], f), F.lit(False))

    traced = tagged("traced") & tagged("gold")
    facts = {
        "active": active, "inactive": ~active, "missing_ids": t.is_blank(F.col("local_id")),
        "malformed_ids": t.is_blank(F.col("local_id")) | ~t.valid_registry_id(F.col("local_id")),
        "nhs_valid": has & valid, "nhs_invalid": has & ~valid, "nhs_traced": has & traced,
        "nhs_untraced": has & ~F.coalesce(traced, F.lit(False)),
        "missing_name": absent("names", lambda n: ~t.is_blank(n["family"])),
        "missing_birth_date": p["birth_date"].isNull(), "missing_address": F.size(p["addresses"]) == 0,
        "missing_postcode": absent("addresses", lambda a: ~t.is_blank(a["postal_code"])),
        "missing_telecom": F.size(p["telecoms"]) == 0,
    }
    group = F.coalesce((p["gender"] if subgroup is None else subgroup).cast("string"), F.lit("Unknown"))
    # Written once: numbers of rows hold in both uses, and profiles do not travel on.
    rows = stage(sources.select(
        "tenant_id", "source_system", group.alias("subgroup"), p["identifiers"].alias("identifiers"),
        *(made.alias(name) for name, made in facts.items()), F.monotonically_increasing_id().alias("_row"),
    ), "population")
    seen = rows.drop("identifiers").join(_shared_identifiers(rows), "_row", "left")
    counts = {"total": F.count(F.lit(1)), **{name: F.count_if(name) for name in facts}}
    counts |= {"identifier_duplicates": F.count_if("_own"), "identifier_collisions": F.count_if("_any")}
    return seen.rollup("source_system", "subgroup").agg(
        F.grouping_id().alias("_level"), *(made.alias(name) for name, made in counts.items())
    ).where("_level < 2").drop("_level")


def identifier_collisions(sources: DataFrame) -> DataFrame:
    """Identifier values carried by more than one source record."""
    return (
        sources.select(*SOURCE, F.explode("profile.identifiers").alias("i"))
        .groupBy("tenant_id", F.col("i.system").alias("system"), F.col("i.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("records"))
        .where("records > 1")
    )


def feed_disorder(feed: DataFrame, keys: list[str], arrival: str, updated: str, version: str) -> DataFrame:
    """Per feed: rows, repeated versions, and rows older than one that arrived before them.

    A row is late when the newest source time among earlier arrivals of its key is greater. The
    running maximum is taken inside each day of arrival and carried over from the days before, so
    one key with very many rows is spread over its days.
    """
    from pyspark.sql import Window

    repeated = (
        feed.groupBy(*keys, version).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_versions"),
             F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))
    )
    days = feed.select(*keys, arrival, updated).distinct().withColumn(
        "_day", F.date_trunc("day", arrival)
    )
    over_days = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        days.groupBy(*keys, "_day").agg(F.max(updated).alias("_max"))
        .withColumn("_carried", F.max("_max").over(over_days)).drop("_max")
    )
    inside = Window.partitionBy(*keys, "_day").orderBy(arrival).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    late = (
        days.join(carried, [*keys, "_day"])
        .withColumn("_newest", F.greatest(F.max(updated).over(inside), "_carried"))
        .agg(F.count_if(F.col(updated) < F.col("_newest")).alias("out_of_order"))
    )
    return repeated.withColumn("out_of_order", late.scalar())


def common_blocks(index: DataFrame, more_than: int) -> DataFrame:
    """Blocking keys that hold more identities than ``more_than``."""
    return blocking.block_sizes(index).where(F.col("block_size") > more_than)


def reconcile_totals(manifest: DataFrame, results: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: announced rows against imported, unchanged and refused ones, and stored keys."""
    outcome = results.groupBy("source_system").agg(
        F.count_if(F.col("status") == "accepted").alias("imported"),
        F.count_if(F.col("status") == "replayed").alias("unchanged"),
        F.count_if(~F.col("status").isin("accepted", "replayed")).alias("quarantined"),
    )
    stored = sources.groupBy("source_system").agg(F.count(F.lit(1)).alias("stored"))
    joined = manifest.join(outcome, "source_system", "full").join(stored, "source_system", "full")
    names = ("expected", "imported", "unchanged", "quarantined", "stored")
    filled = joined.select("source_system", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    return filled.withColumn(
        "balanced",
        F.col("imported") + F.col("unchanged") + F.col("quarantined") == F.col("expected"),
    )


def review_workload(reviews: DataFrame, now) -> DataFrame:
    """Open reviews by kind and age in weeks."""
    age = F.floor(F.date_diff(now, F.col("created_at")) / 7)
    return (
        reviews.where(F.col("status").isin("Pending", "AwaitingSecondApproval"))
        .groupBy("kind", "status", age.alias("age_weeks"))
        .agg(F.count(F.lit(1)).alias("reviews"))
    )


def operational_summary(reviews: DataFrame, audit: DataFrame, settings: DataFrame, since) -> DataFrame:
    """Exact counts: reviews by open status, recent audit rows, and the settings in force."""
    states = reviews.agg(
        F.count_if(F.col("status") == "Pending").alias("pending"),
        F.count_if(F.col("status") == "AwaitingSecondApproval").alias("awaiting"),
    )
    recent = audit.agg(F.count_if(F.col("recorded_at") >= since))
    return states.select(
        "*",
        recent.scalar().alias("recent_audit"),
        settings.agg(F.max("version")).scalar().alias("settings_version"),
        settings.agg(F.max_by("profile_version", "version")).scalar().alias("profile_version"),
    )


def match_counters(scored: DataFrame) -> DataFrame:
    """Matches by grade."""
    return scored.groupBy("grade").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if("has_hard_conflict").alias("conflicts")
    )


def candidate_histogram(matches: DataFrame, query: str = "query_id") -> DataFrame:
    """How many queries had each number of candidates."""
    per_query = matches.groupBy(query).agg(F.max("candidate_count").alias("candidates"))
    return per_query.groupBy("candidates").agg(F.count(F.lit(1)).alias("queries"))
