"""Registered queries: every operator over the given tables, or over data derived from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import ProbabilityModel
from kinweave.functions import similarity, text
from kinweave.operators import (
    assurance, blocking, compare, matching, normalise, quality, scoring, survivorship,
)
from kinweave.plans import maintenance, review, search
from kinweave.plans import registry as reg
from kinweave.plans.upsert import apply_receipts, upsert
from kinweave.schemas import EVIDENCE_FIELDS
from kinweave.session import spread, stage
from kinweave.sources import derived, export, feed, fhir, hl7

LOADED = "2024-01-15 00:00:00"
_staged: dict[tuple, DataFrame] = {}

# A probability model for the scoring query.
MODEL = ProbabilityModel(
    "fs-demo-v1", 0.02,
    tuple(
        (field, level, m, u)
        for field in EVIDENCE_FIELDS
        for level, m, u in (
            ("Exact", 0.80, 0.05), ("Strong", 0.10, 0.05),
            ("Partial", 0.06, 0.20), ("Different", 0.04, 0.70),
        )
    ),
)


def now() -> Column:
    return F.to_timestamp(F.lit("2024-03-01 00:00:00"))


def staged(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per session; several queries read columns of it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        _staged[key] = stage(make(), name)
    return _staged[key]


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources as governed source rows, each its own identity, with norm and keys."""
    cfg = derived.demo_config()

    def make() -> DataFrame:
        a = derived.with_profile(derived.people_a_flat(spark, sf_dir))
        b = derived.with_profile(derived.people_b_flat(spark, sf_dir))
        rows = a.unionByName(b).withColumn(
            "enterprise_id", F.concat_ws("-", "source_system", "local_id")
        )
        made = reg.prepare_sources(rows, cfg, F.to_timestamp(F.lit(LOADED)))
        return blocking.blocking_keys(normalise.normalise(made), cfg)

    return staged(spark, sf_dir, "people", make)


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source row as an active identity of one source."""
    return people(spark, sf_dir).select(
        "tenant_id", "enterprise_id", "profile", "norm", "blocking_keys", "source_system", "k",
        F.lit(True).alias("is_active"), F.lit(1).cast("bigint").alias("version"),
    )


def linked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows where both rows of one person share an identity; trust and times differ."""
    return people(spark, sf_dir).drop("norm", "blocking_keys").withColumn(
        "enterprise_id", F.concat(F.lit("P"), F.col("k").cast("string"))
    ).withColumn(
        "source_trust", F.when(F.col("k") % 4 == 1, 50).otherwise(F.col("source_trust"))
    ).withColumn(
        "last_updated",
        F.expr("last_updated + make_interval(0, 0, 0, cast(k % 3 as int) * "
               "if(source_system = 'crm', 1, 2))"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match per damaged row, and a non-match by rotating its key by seven thirds."""
    b = people(spark, sf_dir).where("source_system = 'billing'").select("k")
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.count(F.lit(1))).scalar()
    both = b.select("k", ((F.col("k") + 21) % n).alias("rotated")).select(
        F.explode(F.array(
            F.struct(F.col("k").alias("a"), F.col("k").alias("b"), F.lit(True).alias("is_match")),
            F.struct(F.col("rotated").alias("a"), F.col("k").alias("b"),
                     F.lit(False).alias("is_match")),
        )).alias("x")
    )
    return both.select(
        F.lit("crm").alias("left_source"), F.col("x.a").cast("string").alias("left_local_id"),
        F.lit("billing").alias("right_source"),
        F.concat(F.lit("B"), F.col("x.b").cast("string")).alias("right_local_id"), "x.is_match",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = derived.demo_config()

    def make() -> DataFrame:
        sources = people(spark, sf_dir)
        joined = assurance.resolve_labels(
            assurance.label_keys(labels(spark, sf_dir)), sources
        )
        joined = joined.withColumn(
            "both_eligible", (F.size("left_keys") > 0) & (F.size("right_keys") > 0)
        ).withColumn("shared_key", blocking.shares_key(F.col("left_keys"), F.col("right_keys")))
        return scoring.score(compare.compare(joined, cfg.profile), cfg.profile).drop(
            "left_norm", "right_norm", "left_keys", "right_keys"
        )

    return staged(spark, sf_dir, "observations", make)


def sims(scored: DataFrame, *extra: str) -> DataFrame:
    """Similarities of the six fields as columns, with score and grade."""
    names = ("family_sim", "given_sim", "dob_sim", "address_sim", "telecom_sim", "gender_sim")
    return scored.select(
        *extra,
        *(F.round(F.col("evidence")[i]["similarity"], 6).alias(n) for i, n in enumerate(names)),
        F.round("score", 6).alias("score"), "grade", "has_hard_conflict",
    )


# ---- one function per query ----------------------------------------------------------------------


def norm_people(spark, sf_dir):
    p = people(spark, sf_dir)
    n = F.col("norm")
    name, address = n["names"][0], n["addresses"][0]

    def contact(system):
        return F.get(F.filter(n["telecoms"], lambda t: t["system"] == system), F.lit(0))["value"]

    return p.select(
        "enterprise_id", name["family"].alias("family"), name["given"][0].alias("given"),
        address["tokens"].alias("tokens"), address["postcode"].alias("postcode"),
        address["sector"].alias("sector"), contact("Phone").alias("phone"),
        contact("Email").alias("email"),
        F.get(n["identifiers"], F.lit(0))["value"].alias("nhs"),
    )


def phonetic_codes(spark, sf_dir):
    return people(spark, sf_dir).select(
        "enterprise_id", F.col("norm.names")[0]["phonetic"].alias("code")
    )


def nhs_check(spark, sf_dir):
    flat = derived.people_a_flat(spark, sf_dir)
    return flat.select(
        "k", text.nhs_valid(F.col("nhs")).alias("issued_valid"),
        text.nhs_valid(F.substring("nhs", 1, 9)).alias("short_valid"),
        text.nhs_valid(F.translate("nhs", "0123456789", "1234567890")).alias("shifted_valid"),
    )


def identifier_authority(spark, sf_dir):
    return people(spark, sf_dir).where(F.size("profile.identifiers") > 0).select(
        "enterprise_id", F.col("profile.identifiers")[0]["is_verified"].alias("is_trusted")
    )


def blocking_keys_hmac(spark, sf_dir):
    return blocking.explode_keys(people(spark, sf_dir), "enterprise_id").select(
        "enterprise_id", "key_version", "key_value"
    )


def resource_ids(spark, sf_dir):
    return people(spark, sf_dir).select("source_system", "local_id", "resource_id")


def block_stats(spark, sf_dir):
    index = blocking.candidate_index(identities(spark, sf_dir))
    return blocking.block_stats(index).drop("tenant_id")


PAIR_CAP = 3


def candidate_pairs(spark, sf_dir):
    index = blocking.candidate_index(identities(spark, sf_dir))
    return blocking.self_candidates(index, PAIR_CAP)[0].select("subject_id", "candidate_id")


def rejected_subjects(spark, sf_dir):
    index = blocking.candidate_index(identities(spark, sf_dir))
    return blocking.self_candidates(index, PAIR_CAP)[1].select("subject_id")


def query_candidates(spark, sf_dir):
    """Pairs and refusals of outside queries under a low cap."""
    who = identities(spark, sf_dir)
    index = blocking.candidate_index(who.where("source_system = 'crm'"))
    keys = blocking.explode_keys(
        who.where("source_system = 'billing'").withColumnRenamed("enterprise_id", "query_id"),
        "query_id",
    )
    pairs, refused = blocking.candidates(keys, index, 3)
    return pairs.select("query_id", "candidate_id").unionByName(
        refused.select("query_id", F.lit("refused").alias("candidate_id"))
    )


def _population(spark, sf_dir) -> DataFrame:
    return matching.score_population(identities(spark, sf_dir), derived.demo_config().profile)[0]


def pair_scores(spark, sf_dir):
    return sims(_population(spark, sf_dir), "subject_id", "candidate_id")


def pair_evidence(spark, sf_dir):
    """Comparator, level and missing flag of every field of every pair."""
    return _population(spark, sf_dir).select(
        "subject_id", "candidate_id", F.explode("evidence").alias("e")
    ).select(
        "subject_id", "candidate_id", "e.field", "e.comparator", "e.detail", "e.is_missing",
        "e.comparison_level",
    )


def fs_scores(spark, sf_dir):
    rules = replace(derived.demo_config().profile, model=MODEL)
    seen = observations(spark, sf_dir).drop("score", "grade", "score_method")
    scored = scoring.score(seen, rules)
    return scored.select(
        "pair_key", F.round("score", 6).alias("score"), "grade",
        F.round(F.aggregate("evidence", F.lit(0.0), lambda a, e: a + e["log_likelihood_ratio"]), 6)
        .alias("llr"),
    )


def string_comparators(spark, sf_dir):
    """All string comparators on the name and address pairs of the labelled rows."""
    sources = people(spark, sf_dir)
    joined = assurance.resolve_labels(assurance.label_keys(labels(spark, sf_dir)), sources)
    l, r = F.col("left_norm.names")[0]["family"], F.col("right_norm.names")[0]["family"]
    made = joined.select(
        "pair_key", "is_match", l.alias("l"), r.alias("r"),
        F.col("left_norm.addresses")[0]["tokens"].alias("lt"),
        F.col("right_norm.addresses")[0]["tokens"].alias("rt"),
    )
    l, r = F.col("l"), F.col("r")
    return made.select(
        "pair_key", "is_match",
        F.round(similarity.jaro_winkler(l, r), 6).alias("jaro_winkler"),
        F.round(similarity.osa_similarity(l, r), 6).alias("osa"),
        F.round(similarity.dice(l, r), 6).alias("dice"),
        F.round(similarity.token_jaccard(F.col("lt"), F.col("rt")), 6).alias("jaccard"),
        similarity.exact(l, r).alias("exact"),
    )


def match_topn(spark, sf_dir):
    cfg = derived.demo_config()
    who = people(spark, sf_dir)
    queries = derived.with_profile(derived.people_b_flat(spark, sf_dir)).select(
        "tenant_id", F.concat_ws("-", "source_system", "local_id").alias("query_id"), "profile"
    )
    canonical = who.where("source_system = 'crm'").select(
        "tenant_id", "enterprise_id", "profile", "blocking_keys", F.lit(True).alias("is_active")
    )
    matches, _ = matching.match(queries, canonical, cfg)
    return matches.select(
        "query_id", "candidate_id", "rank", F.round("score", 6).alias("score"), "grade",
        "has_hard_conflict", "candidate_count",
    )


def match_certain(spark, sf_dir):
    cfg = derived.demo_config()
    queries = derived.with_profile(derived.people_b_flat(spark, sf_dir)).select(
        "tenant_id", F.concat_ws("-", "source_system", "local_id").alias("query_id"), "profile"
    )
    canonical = people(spark, sf_dir).where("source_system = 'crm'").select(
        "tenant_id", "enterprise_id", "profile", "blocking_keys", F.lit(True).alias("is_active")
    )
    matches, _ = matching.match(queries, canonical, cfg, only_certain=True)
    return matching.pick_certain(matches.drop("rank")).select(
        "query_id", "candidate_id", F.round("score", 6).alias("score")
    )


def find_duplicates(spark, sf_dir):
    cfg = derived.demo_config()
    canonical = identities(spark, sf_dir)
    matches, _ = matching.find_duplicates(canonical, canonical.drop("norm"), cfg, 3)
    return matches.select(
        F.col("query_id").alias("subject_id"), "candidate_id", "rank",
        F.round("score", 6).alias("score"), "grade", "candidate_count",
    )


def golden_record(spark, sf_dir):
    golden = survivorship.golden_record(linked_sources(spark, sf_dir))
    p = F.col("profile")

    def joined(items, f):
        return F.array_join(F.transform(items, f), ";")

    return golden.select(
        "enterprise_id", "survivorship_trust",
        joined(p["names"], lambda n: F.concat_ws(" ", n["given"][0], n["family"])).alias("names"),
        joined(p["addresses"], lambda a: F.concat_ws(",", a["lines"][0], a["postal_code"])).alias(
            "addresses"
        ),
        joined(p["telecoms"], lambda t: t["value"]).alias("telecoms"),
        joined(p["identifiers"], lambda i: F.concat_ws(
            "=", i["value"], i["is_verified"].cast("string"))).alias("identifiers"),
        p["birth_date"].alias("birth_date"), p["gender"].alias("gender"),
        F.size(p["tags"]).alias("tags"),
    )


def survivor_rank(spark, sf_dir):
    return survivorship.survivor_rank(linked_sources(spark, sf_dir)).select(
        "enterprise_id", "source_system", "local_id", "rank"
    )


def label_checks(spark, sf_dir):
    """Problems of a label set with every tenth row repeated the other way round."""
    good = labels(spark, sf_dir)
    turned = good.where(F.col("right_local_id").endswith("0")).select(
        F.col("right_source").alias("left_source"), F.col("right_local_id").alias("left_local_id"),
        F.col("left_source").alias("right_source"), F.col("left_local_id").alias("right_local_id"),
        (~F.col("is_match")).alias("is_match"),
    )
    stray = good.where(F.col("right_local_id").endswith("5")).withColumn(
        "right_local_id", F.concat(F.col("right_local_id"), F.lit("-gone"))
    )
    return assurance.check_labels(
        good.unionByName(turned).unionByName(stray), people(spark, sf_dir)
    )


def blocking_recall(spark, sf_dir):
    return assurance.blocking_recall(observations(spark, sf_dir)).withColumn(
        "blocking_recall", F.round("blocking_recall", 6)
    )


def _rounded(df):
    return df.select(*(
        F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ))


def eval_metrics(spark, sf_dir):
    cuts = assurance.thresholds(derived.demo_config().profile)
    return _rounded(assurance.classification_metrics(observations(spark, sf_dir), cuts))


def field_discrimination(spark, sf_dir):
    return _rounded(assurance.field_discrimination(observations(spark, sf_dir)))


def misclassified(spark, sf_dir):
    rules = derived.demo_config().profile
    return assurance.misclassified(
        observations(spark, sf_dir), rules, assurance.thresholds(rules), 100
    ).select("pair_key", "is_match", F.round("score", 6).alias("score"), "grade", "shared_key")


def label_split(spark, sf_dir):
    return assurance.split_labels(observations(spark, sf_dir), 0.2).select(
        "pair_key", "is_match", "is_validation"
    )


def fs_fit(spark, sf_dir):
    parts = assurance.split_labels(observations(spark, sf_dir), 0.2)
    return _rounded(
        assurance.level_counts(parts.where("not is_validation"), 1.0).drop("level_order")
    )


def calibrate(spark, sf_dir):
    """Metrics of the fitted model on the held-out labels, at 99 thresholds."""
    report = assurance.calibrate(
        observations(spark, sf_dir), derived.demo_config().profile, "fs-fit-v1"
    )
    return _rounded(report["grid"].select("threshold", "tp", "fp", "tn", "fn", "precision", "recall"))


def _linked_registry(spark, sf_dir) -> reg.Registry:
    """A loaded registry whose stored rows predate today's configuration."""
    old = derived.demo_config()
    # Loaded when billing was not yet trusted at all and only names and identifiers made keys.
    rules = replace(
        old.profile, blocking_rules=("AuthoritativeIdentifier", "FamilyNameAndBirthDate")
    )
    sources = people(spark, sf_dir).drop("norm", "blocking_keys", "k", "source_is_authoritative")
    sources = sources.withColumn(
        "enterprise_id", F.concat(F.lit("P"), F.regexp_replace("local_id", "B", ""))
    ).withColumn(
        "source_trust", F.when(F.col("source_system") == "billing", 0).otherwise(F.col("source_trust"))
    )
    parts = reg.assemble(sources, replace(old, profile=rules), F.to_timestamp(F.lit(LOADED)))
    tables = {
        name: staged(spark, sf_dir, f"registry-{name}", lambda df=df: df)
        for name, df in parts.items()
    }
    # One source row in fifty is lost, so its identity has a provenance gap.
    tables["source_patients"] = tables["source_patients"].where(
        F.regexp_replace("local_id", "B", "").cast("bigint") % 50 != 7
    )
    return reg.Registry(spark, tables)


def reindex_validate(spark, sf_dir):
    registry = _linked_registry(spark, sf_dir)
    targets = maintenance.target_keys(registry["canonical_patients"], derived.demo_config())
    return maintenance.reindex_validate(targets)


def rebuild_changes(spark, sf_dir):
    registry = _linked_registry(spark, sf_dir)
    parts = maintenance.rebuild_changes(registry, derived.demo_config(), now())
    changed = parts["sources"].groupBy("enterprise_id").agg(
        F.count_if("source_changed").alias("sources_changed")
    )
    return parts["canonical"].join(changed, "enterprise_id").select(
        "enterprise_id", "version", "canonical_changed", "survivorship_trust", "sources_changed"
    )


def rebuild_warnings(spark, sf_dir):
    return reg.canonical_with_sources(_linked_registry(spark, sf_dir))[1].select(
        "enterprise_id", "source_system", "local_id", "reason"
    )


def reconcile_reviews(spark, sf_dir):
    registry = reg.Registry(spark, {
        "canonical_patients": identities(spark, sf_dir).withColumn("version", F.lit(1))
    })
    reviews, _ = maintenance.reconciliation_reviews(registry, derived.demo_config(), now())
    return reviews.select(
        "id", "subject_id", "candidate_id", F.round("score", 6).alias("score"), "grade",
        "required_approvals", "policy_locked",
    )


# ---- messages and feeds ---------------------------------------------------------------------------


def adt_messages(spark, sf_dir) -> DataFrame:
    """One ADT message per event row; the text is built from the event's columns."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type"))
    return events.select(
        "event_id", F.col("ts").alias("arrival"), "user_id",
        F.expr(derived.ADT_TEXT).alias("message"),
    )


def adt_parse(spark, sf_dir):
    parsed = hl7.parse_adt(adt_messages(spark, sf_dir), "hosp")
    p = F.col("profile")
    return parsed.select(
        "event_id", "trigger", "control_id", "local_id", "previous_local_id", "error",
        p["names"][0]["family"].alias("family"), F.get(p["names"][0]["given"], F.lit(0)).alias("given"),
        p["birth_date"].alias("birth_date"), p["gender"].alias("gender"),
        p["telecoms"][0]["value"].alias("phone"), p["identifiers"][0]["system"].alias("id_system"),
    )


def adt_latest(spark, sf_dir):
    parsed = hl7.parse_adt(adt_messages(spark, sf_dir), "hosp").where("error is null")
    latest = survivorship.latest_snapshot(
        parsed.select(F.lit("demo").alias("tenant_id"), "source_system", "local_id", "control_id",
                      "trigger", "arrival")
    )
    return latest.select("local_id", "control_id", "trigger", "arrival")


def adt_acks(spark, sf_dir):
    parsed = hl7.parse_adt(adt_messages(spark, sf_dir), "hosp")
    coded = parsed.withColumns({
        "ack_code": F.when(F.col("error").isNull(), "AA").otherwise("AR"),
        "diagnostic": F.coalesce("error", F.lit("Stored.")),
    })
    return hl7.adt_acks(coded, now()).select(
        "event_id", F.split("ack", "\r")[1].alias("msa"), F.split("ack", "\r")[2].alias("err")
    )


def replay_split(spark, sf_dir):
    """Control ids are reused every 700 events; some repeats carry the same content."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit("demo").alias("tenant_id"), "event_id", F.col("ts").alias("arrival"),
        F.col("event_id").alias("uid"),
        F.concat(F.lit("k"), (F.col("event_id") % 700).cast("string")).alias("idempotency_key"),
        F.upper(F.sha2((F.col("event_id") % 700 + (F.col("user_id") % 3) * 1000).cast("string"), 256))
        .alias("payload_digest"),
    )
    receipts = reg.Registry(spark)["receipts"]
    return apply_receipts(rows, receipts).select("event_id", "receipt_state")


def run_buckets(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(
        feed.run_bucket(F.col("ts"), "6 hours").alias("bucket")
    ).agg(F.count(F.lit(1)).alias("events"))


def _order_feed(spark, sf_dir) -> DataFrame:
    """Every order as one version of its customer's record."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_custkey").cast("string").alias("resource_id"),
        F.col("o_orderkey").cast("string").alias("version_id"),
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("last_updated"),
        F.struct(F.array(F.struct(
            F.lit("urn:crm").alias("system"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("value")
        )).alias("identifiers")).alias("profile"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("payload_digest"),
    )


def incremental_window(spark, sf_dir):
    changes = feed.read_changes(
        _order_feed(spark, sf_dir), "1996-01-01", "1997-06-30", "urn:crm"
    )
    return changes.select(
        "resource_id", "local_id", "source_version", F.to_date("last_updated").alias("updated"),
        "problem",
    )


def feed_latest(spark, sf_dir):
    """Newest version of every record, by the source's own clock."""
    rows = _order_feed(spark, sf_dir).where("last_updated is not null").select(
        F.lit("demo").alias("tenant_id"), F.lit("crm").alias("source_system"),
        F.col("resource_id").alias("local_id"), "last_updated",
        F.col("version_id").cast("bigint").alias("arrival"),
    )
    return survivorship.latest_snapshot(rows, "last_updated").select(
        "local_id", "last_updated", F.col("arrival").alias("version_id")
    )


def feed_disorder(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_custkey", F.timestamp_seconds(F.col("o_orderkey") * 60).alias("arrival"),
        F.col("o_orderdate").alias("updated"), F.to_date("o_orderdate").alias("version"),
    )
    return quality.feed_disorder(rows, ["o_custkey"], "arrival", "updated", "version")


def _contact_rows(spark, sf_dir) -> DataFrame:
    """E-mail addresses and telephone numbers in whole documents and conversation turns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item"), "text"
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("item"), "text",
    )
    found = docs.unionByName(turns).select(
        "item",
        F.regexp_extract_all("text", F.lit(derived.EMAIL), F.lit(0)).alias("emails"),
        F.regexp_extract_all("text", F.lit(derived.PHONE), F.lit(0)).alias("phones"),
    ).where((F.size("emails") > 0) | (F.size("phones") > 0))
    contacts = F.concat(
        F.transform("emails", lambda x: F.struct(
            F.lit("Email").alias("system"), x.alias("value"), F.lit(None).cast("string").alias("use"))),
        F.transform("phones", lambda x: F.struct(
            F.lit("Phone").alias("system"), x.alias("value"), F.lit(None).cast("string").alias("use"))),
    )
    return found.select("item", normalise.norm_telecoms(contacts).alias("telecoms"))


def contacts(spark, sf_dir):
    return _contact_rows(spark, sf_dir).select("item", F.explode("telecoms").alias("t")).select(
        "item", "t.system", "t.value"
    )


def contact_blocks(spark, sf_dir):
    """Blocking keys of the contacts found in texts, and how many texts share each."""
    rules = replace(derived.demo_config().profile, blocking_rules=("Phone", "Email"))
    norm = F.struct(F.lit(None).cast("date").alias("birth_date"), F.col("telecoms"))
    return _contact_rows(spark, sf_dir).select(
        "item", F.explode(blocking.raw_keys_column(norm, rules)).alias("key")
    ).groupBy("key").agg(F.count(F.lit(1)).alias("items"))


# ---- population, registry and review queries ---------------------------------------------------


def profile_population(spark, sf_dir):
    return quality.profile_population(people(spark, sf_dir))


def identifier_collisions(spark, sf_dir):
    return quality.identifier_collisions(people(spark, sf_dir)).select("value", "records")


def common_blocks(spark, sf_dir):
    index = blocking.candidate_index(identities(spark, sf_dir))
    return quality.common_blocks(index, 3).select("key_value", "block_size")


def match_counters(spark, sf_dir):
    return quality.match_counters(_population(spark, sf_dir))


def candidate_histogram(spark, sf_dir):
    who = identities(spark, sf_dir)
    pairs, _ = blocking.candidates(
        blocking.explode_keys(who.withColumnRenamed("enterprise_id", "query_id"), "query_id"),
        blocking.candidate_index(who), None,
    )
    return quality.candidate_histogram(pairs)


def display_columns(spark, sf_dir):
    return review.display_columns(people(spark, sf_dir)).select(
        "enterprise_id", "display_name", "display_initials", "display_nhs", "display_birth_date",
        "display_gender", "display_address",
    )


def lookup_patients(spark, sf_dir):
    flat = derived.people_b_flat(spark, sf_dir)
    queries = flat.select(
        F.lit("demo").alias("tenant_id"), "k",
        F.concat(F.lit("q"), F.col("k").cast("string")).alias("query_id"),
        F.when(F.col("k") % 2 == 0, F.concat_ws(" ", F.substring("nhs", 1, 3), F.substring("nhs", 4, 7)))
        .alias("identifier"),
        F.lower("family").alias("family"), F.col("dob").alias("birth_date"),
    ).drop("k")
    return search.lookup_patients(identities(spark, sf_dir), queries).select(
        "query_id", "enterprise_id", "found_by"
    )


def search_canonical(spark, sf_dir):
    who = identities(spark, sf_dir)
    found = search.search_canonical(who, family="smith")
    return search.order_by_default(found, "canonical_patients").select("enterprise_id")


def replaced_by_chains(spark, sf_dir):
    """Customers as identities; two thirds were replaced by the one with half the key."""
    half = F.floor(F.col("c_custkey") / 2).cast("string")
    canonical = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.lit("demo").alias("tenant_id"), F.col("c_custkey").cast("string").alias("enterprise_id"),
        F.when(F.col("c_custkey") % 3 != 0, half).alias("replaced_by"),
    )
    return reg.resolve_replaced_by(canonical).select("enterprise_id", "survivor_id")


def version_checks(spark, sf_dir):
    """Mutations of five orders each against stored order versions."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    expected = orders.select(
        F.floor(F.col("o_orderkey") / 5).cast("bigint").alias("mutation_id"),
        F.col("o_orderkey").alias("entity"),
        F.when(F.col("o_orderkey") % 17 == 0, 0).otherwise(F.col("o_orderkey") % 4).alias("expected_version"),
    )
    current = orders.where("o_orderkey % 4 <> 0").select(
        F.col("o_orderkey").alias("entity"), (F.col("o_orderkey") % 4).alias("version")
    )
    return reg.check_versions(expected, current, ["entity"])


def _separate_registry(spark, sf_dir) -> reg.Registry:
    """Every source row as an identity of its own."""
    sources = people(spark, sf_dir).drop("norm", "blocking_keys", "k", "source_is_authoritative")
    parts = reg.assemble(sources, derived.demo_config(), F.to_timestamp(F.lit(LOADED)))
    return reg.Registry(spark, {
        name: staged(spark, sf_dir, f"separate-{name}", lambda df=df: df) for name, df in parts.items()
    })


def link_people(spark, sf_dir):
    """Retire every billing identity into the identity of its customer."""
    registry = _separate_registry(spark, sf_dir)
    pairs = people(spark, sf_dir).where("source_system = 'billing'").select(
        "tenant_id", F.col("enterprise_id").alias("subject_id"),
        F.concat(F.lit("crm-"), F.col("k").cast("string")).alias("candidate_id"),
    )
    linked = review.link(registry, pairs, derived.demo_config(), now())
    return linked["canonical_patients"].select(
        "enterprise_id", "is_active", "version", "replaced_by", "survivorship_trust",
        F.array_join(F.transform("profile.names", lambda n: F.concat_ws(" ", n["given"][0], n["family"])), ";")
        .alias("names"),
    )


def split_people(spark, sf_dir):
    """Split the billing row off every linked identity of a customer divisible by nine."""
    registry = _linked_registry(spark, sf_dir)
    asked = people(spark, sf_dir).where("source_system = 'billing' and k % 9 = 0 and k % 50 <> 7").select(
        "tenant_id", F.concat(F.lit("P"), F.col("k").cast("string")).alias("subject_id"),
        F.concat(F.lit("N"), F.col("k").cast("string")).alias("candidate_id"),
        F.lit("r").alias("id"), F.array(F.struct("source_system", "local_id")).alias("sources_to_move"),
    )
    made = review.split(registry, asked, derived.demo_config(), now())
    touched = made["canonical_patients"].join(
        asked.select(F.explode(F.array("subject_id", "candidate_id")).alias("enterprise_id")),
        "enterprise_id", "left_semi",
    )
    owned = made["canonical_sources"].groupBy("enterprise_id").agg(
        F.array_join(F.sort_array(F.collect_list("local_id")), ",").alias("sources")
    )
    return touched.join(owned, "enterprise_id").select(
        "enterprise_id", "version", "survivorship_trust", "sources",
        F.col("profile.names")[0]["family"].alias("family"), F.size("profile.names").alias("names"),
    )


def review_guidance(spark, sf_dir):
    who = identities(spark, sf_dir)
    registry = reg.Registry(spark, {"canonical_patients": who.withColumn("version", F.lit(1))})
    reviews = staged(spark, sf_dir, "reviews", lambda: maintenance.reconciliation_reviews(
        registry, derived.demo_config(), now())[0])
    return review.review_guidance(reviews, who).select(
        "subject_id", "candidate_id", "agreements", "conflicts", "missing", "recommendation"
    )


def outdated_reviews(spark, sf_dir):
    """Orders as reviews of two customers; customers divisible by seven changed since."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.lit("demo").alias("tenant_id"), F.col("c_custkey").cast("string").alias("enterprise_id"),
        F.when(F.col("c_custkey") % 7 == 0, 2).otherwise(1).cast("bigint").alias("version"),
        (F.col("c_custkey") % 11 != 0).alias("is_active"),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    reviews = orders.select(
        F.lit("demo").alias("tenant_id"), F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.floor(F.col("o_custkey") / 2).cast("string").alias("candidate_id"),
        F.when(F.col("o_orderstatus") == "O", "Pending")
        .when(F.col("o_orderstatus") == "P", "AwaitingSecondApproval").otherwise("Linked").alias("status"),
        F.when(F.col("o_orderkey") % 10 == 0, "Split").otherwise("PotentialDuplicate").alias("kind"),
        F.lit(1).cast("bigint").alias("subject_version"),
        F.lit(1).cast("bigint").alias("candidate_version"),
    )
    registry = reg.Registry(spark, {"canonical_patients": customers, "review_cases": reviews})
    return review.outdated_reviews(registry).drop("tenant_id")


def review_workload(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.when(F.col("o_orderstatus") == "O", "Pending")
        .when(F.col("o_orderstatus") == "P", "AwaitingSecondApproval").otherwise("Linked").alias("status"),
        F.lit("PotentialDuplicate").alias("kind"), F.col("o_orderdate").alias("created_at"),
    )
    return quality.review_workload(orders, F.to_date(F.lit("2002-01-01")))


def upsert_people(spark, sf_dir):
    """Billing rows, and new versions of every tenth customer, against the loaded customers."""
    cfg = derived.demo_config()
    everyone = people(spark, sf_dir)
    loaded = everyone.where("source_system = 'crm'").drop(
        "norm", "blocking_keys", "k", "source_is_authoritative"
    )
    parts = reg.assemble(loaded, cfg, F.to_timestamp(F.lit(LOADED)))
    registry = reg.Registry(spark, {
        name: staged(spark, sf_dir, f"loaded-{name}", lambda df=df: df) for name, df in parts.items()
    })
    incoming = everyone.where("source_system = 'billing' or k % 10 = 0").select(
        "tenant_id", "source_system", "local_id", "profile",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k")).alias("arrival"),
    )
    made = upsert(registry, incoming, cfg, now()).registry
    reviews = made["review_cases"].groupBy("subject_id").agg(F.count(F.lit(1)).alias("reviews"))
    return made["source_patients"].select("source_system", "local_id", "enterprise_id", "version").join(
        made["canonical_patients"].select("enterprise_id", F.col("version").alias("identity_version")),
        "enterprise_id",
    ).join(reviews.withColumnRenamed("subject_id", "enterprise_id"), "enterprise_id", "left").fillna(
        0, ["reviews"]
    )


# ---- exports ---------------------------------------------------------------------------------


def fhir_round_trip(spark, sf_dir):
    """Source rows written as FHIR JSON and read back."""
    rows = export.to_fhir_patients(people(spark, sf_dir), "source")
    back = fhir.parse_json(rows.select("value"), trusted=True)
    p = F.col("profile")
    return back.select(
        "resource_id", "version_id", F.size(p["identifiers"]).alias("identifiers"),
        p["names"][0]["family"].alias("family"), p["names"][0]["given"][0].alias("given"),
        p["birth_date"].alias("birth_date"), p["gender"].alias("gender"),
        F.array_join(F.transform(p["telecoms"], lambda t: t["value"]), "|").alias("telecoms"),
        p["addresses"][0]["postal_code"].alias("postcode"), F.size(p["tags"]).alias("tags"),
    )


def fhir_issues(spark, sf_dir):
    """Validation issues of customers whose number or date was spoilt on the way."""
    flat = derived.people_a_flat(spark, sf_dir)
    documents = flat.select(F.to_json(F.struct(
        F.lit("Patient").alias("resourceType"), F.col("local_id").alias("id"),
        F.array(F.struct(
            F.lit(derived.NHS_SYSTEM).alias("system"),
            F.when(F.col("k") % 5 == 0, F.translate("nhs", "0123456789", "1234567890"))
            .otherwise(F.col("nhs")).alias("value"),
        )).alias("identifier"),
        F.when(F.col("k") % 8 == 0, F.date_format("dob", "yyyy-MM"))
        .otherwise(F.date_format("dob", "yyyy-MM-dd")).alias("birthDate"),
    )).alias("value"))
    return fhir.validate_patients(fhir.parse_json(documents)).select("resource_id", "code", "expression")


def match_bundles(spark, sf_dir):
    cfg = derived.demo_config()
    canonical = people(spark, sf_dir).where("source_system = 'crm'").select(
        "tenant_id", "enterprise_id", "profile", "blocking_keys", F.lit(True).alias("is_active"),
        F.lit(1).alias("version"), F.to_timestamp(F.lit(LOADED)).alias("last_updated"),
        F.lit(None).cast("string").alias("replaced_by"),
    )
    queries = derived.with_profile(derived.people_b_flat(spark, sf_dir)).select(
        "tenant_id", F.concat_ws("-", "source_system", "local_id").alias("query_id"), "profile"
    )
    matches, _ = matching.match(queries, canonical, cfg)
    bundles = export.to_match_bundles(matches, canonical, now())
    return bundles.select(
        "query_id", F.get_json_object("value", "$.total").alias("total"),
        F.get_json_object("value", "$.entry[0].resource.id").alias("best"),
        F.get_json_object("value", "$.entry[0].resource.extension[0].valueCode").alias("grade"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        norm_people, phonetic_codes, nhs_check, identifier_authority, blocking_keys_hmac,
        resource_ids, block_stats, candidate_pairs, rejected_subjects, query_candidates,
        pair_scores, pair_evidence, fs_scores, string_comparators, match_topn, match_certain,
        find_duplicates, golden_record, survivor_rank, label_checks, blocking_recall,
        eval_metrics, field_discrimination, misclassified, label_split, fs_fit, calibrate,
        reindex_validate, rebuild_changes, rebuild_warnings, reconcile_reviews,
        adt_parse, adt_latest, adt_acks, replay_split, run_buckets, incremental_window, feed_latest,
        feed_disorder, contacts, contact_blocks, profile_population, identifier_collisions,
        common_blocks, match_counters, candidate_histogram, display_columns, lookup_patients,
        search_canonical, replaced_by_chains, version_checks, link_people, split_people,
        review_guidance, outdated_reviews, review_workload, upsert_people, fhir_round_trip,
        fhir_issues, match_bundles,
    )
}
