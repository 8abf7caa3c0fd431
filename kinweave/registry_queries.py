"""Registered queries over registry tables derived from orders, events and customers, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.config import Comparators
from kinweave.functions import hashing, text
from kinweave.operators import assurance, blocking, quality, survivorship
from kinweave.operators.as_of import as_of, version_runs
from kinweave.operators.name_scores import best_names
from kinweave.operators.ordered_merges import merge_in_order
from kinweave.plans import registry as reg
from kinweave.plans import search
from kinweave.plans.upsert import upsert
from kinweave.plans.versions import in_turn
from kinweave.queries import adt_messages, linked_sources, now, people, staged
from kinweave.session import spread, working_folder
from kinweave.sources import derived, hl7
from kinweave.streaming import adt, keyed

# ---- derived tables, and the same rules for DuckDB ------------------------------------------------

_REVIEWS = """
select 'demo' as tenant_id, cast(o_orderkey as {text}) as id, concat('C', cast(o_custkey as {text})) as subject_id,
  case o_orderkey % 5 when 0 then 'Pending' when 1 then 'AwaitingSecondApproval' when 2 then 'Linked' when 3 then 'Rejected' else 'Superseded' end as status,
  case o_orderkey % 3 when 0 then 'PotentialDuplicate' when 1 then 'ManualDuplicate' else 'Split' end as kind,
  o_orderdate as created_at, (o_orderkey % 101) / cast(100 as double) as decision_score, o_orderkey % 7 < 3 as is_match
from orders
"""
_AUDIT = """
select 'demo' as tenant_id, cast(event_id as {text}) as id, event_type as action, concat('User', cast(user_id % 10 as {text})) as actor,
  case when event_id % 4 = 0 then 'pending' else 'success' end as outcome, concat('U', cast(user_id as {text})) as enterprise_id, ts as recorded_at
from events
"""
_JOBS = """
select 'demo' as tenant_id, cast(o_orderkey as {text}) as id, case o_orderkey % 3 when 0 then 'Rebuild' else 'Reindex' end as kind,
  case when o_orderstatus = 'P' then 'Running' else 'Completed' end as status, case when o_custkey % 2 = 0 then 'crm' else 'billing' end as source_system,
  o_orderpriority as schedule_key, o_orderdate as requested_at, o_orderdate as window_end, o_orderdate as completed_at
from orders
"""
_PERSONS = """
select 'demo' as tenant_id, concat('P', cast(c_custkey as {text})) as enterprise_id, c_custkey % 4 <> 0 as is_active, c_custkey % 9 as version
from customer
"""


# the key that an event changes, and the version that it expects
_CHANGED = "case when event_id % 3 = 0 then 'U0' else concat('U', cast(user_id as {text})) end"
_EXPECTED = "case when event_id % 70 = 0 then null when event_id % 3 = 0 then event_id {div} 9 else event_id % 4 + 1 end"

_WANTED = "case when (k + turn) % 4 = 0 then null else 1 + turn - k % 3 end"


def _made(spark: SparkSession, sf_dir: str, rule: str, table: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(rule.format(text="string").replace(f"from {table}", "from {source}"), source=source)


def _duck(rule: str) -> str:
    return f"({rule.format(text='varchar')})"


def reviews(spark, sf_dir):
    return _made(spark, sf_dir, _REVIEWS, "orders")


def audit(spark, sf_dir):
    return _made(spark, sf_dir, _AUDIT, "events")


def jobs(spark, sf_dir):
    return _made(spark, sf_dir, _JOBS, "orders")


def persons(spark, sf_dir):
    return _made(spark, sf_dir, _PERSONS, "customer")


# ---- one function per query ----------------------------------------------------------------------


def search_persons(spark, sf_dir):
    return search.search_persons(persons(spark, sf_dir)).select("enterprise_id", "version")


def search_reviews(spark, sf_dir):
    return search.search_reviews(reviews(spark, sf_dir), "AwaitingSecondApproval", "Split").select("id", "subject_id")


def search_audit(spark, sf_dir):
    found = search.search_audit(
        audit(spark, sf_dir), action="CLICK", actor="user1", outcome="Success", since="2024-01-02 00:00:00", until="2024-01-09 12:00:00")
    return found.select("id", "enterprise_id", "recorded_at")


def search_jobs(spark, sf_dir):
    return search.search_jobs(jobs(spark, sf_dir), kind="Rebuild", status="Completed", source_system="crm").select("id", "schedule_key")


def last_windows(spark, sf_dir):
    from kinweave.plans.maintenance import last_window_end

    return last_window_end(jobs(spark, sf_dir)).select("schedule_key", "window_end")


def priority_reviews(spark, sf_dir):
    """A top-k report: who waits for a second approval first, then the newest."""
    return search.priority_reviews(reviews(spark, sf_dir), 50).select("id", "status", "created_at")


def operational_summary(spark, sf_dir):
    settings = jobs(spark, sf_dir).select(
        F.col("id").cast("bigint").alias("version"), F.concat(F.lit("v"), "id").alias("profile_version"))
    return quality.operational_summary(reviews(spark, sf_dir), audit(spark, sf_dir), settings, F.to_timestamp(F.lit("2024-01-05 00:00:00")))


def reconcile_totals(spark, sf_dir):
    """Announced, imported, unchanged and refused rows by the type of event."""
    rows = audit(spark, sf_dir)
    manifest = rows.groupBy(F.col("action").alias("source_system")).agg(
        F.count_if(F.col("id").cast("bigint") % 50 != 0).alias("expected"))
    results = rows.where("id % 25 <> 0").select(
        F.col("action").alias("source_system"),
        F.expr("case id % 3 when 0 then 'accepted' when 1 then 'replayed' else 'insufficient-identity' end").alias("status"))
    sources = rows.where("id % 3 = 0").select(F.col("action").alias("source_system"))
    return quality.reconcile_totals(manifest, results, sources)


def calibration_loss(spark, sf_dir):
    return assurance.brier_log_loss(reviews(spark, sf_dir)).select(F.round("brier", 9).alias("brier"), F.round("log_loss", 9).alias("log_loss"))


def dataset_digest(spark, sf_dir):
    rows = reviews(spark, sf_dir).select(F.col("id").alias("pair_key"), "is_match")
    return spark.createDataFrame([(assurance.dataset_digest(rows),)], "digest string")


def idempotency_keys(spark, sf_dir):
    rows = audit(spark, sf_dir)
    app = F.when(F.col("id") % 7 != 0, F.col("action"))
    return rows.select(
        "id", hashing.adt_idempotency_key(F.col("tenant_id"), F.lit("hosp"), app, F.col("actor"), F.col("id")).alias("adt_key"),
        hashing.feed_idempotency_key(F.lit("crm"), F.col("enterprise_id"), F.col("id")).alias("feed_key"),
        hashing.payload_digest(F.concat("action", F.lit("/"), "actor")).alias("digest"),
        hashing.payload_digest(F.col("enterprise_id"), upper=False).alias("lower_digest"))


def registry_ids(spark, sf_dir):
    """Ids made from names and segments, some with a character too many."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    made = customer.select("c_custkey", F.expr(
        "case c_custkey % 5 when 0 then concat('id-', c_custkey, '.x') when 1 then concat('_', c_custkey) when 2 then c_mktsegment "
        "when 3 then concat(repeat('a', c_custkey % 70), '_1') else concat(c_custkey, ' b') end").alias("id"))
    return made.select("c_custkey", text.valid_registry_id(F.col("id")).alias("valid"))


def source_owners(spark, sf_dir):
    """Rows of the source that may write here, and the ones set aside with a reason."""
    mine, others = reg.check_source_owner(people(spark, sf_dir).select("source_system", "enterprise_id"), "crm")
    return mine.withColumn("reason", F.lit(None).cast("string")).unionByName(others)


def new_and_known(spark, sf_dir):
    """Every third stored row is unknown to the registry; known ones come with their stored state."""
    rows = people(spark, sf_dir)
    stored = rows.where("k % 3 <> 0").select(
        "tenant_id", "source_system", "local_id", "enterprise_id", (F.col("k") % 5).alias("version"), "resource_id")
    new, known = reg.split_new_existing(rows.select("tenant_id", "source_system", "local_id"), stored)
    return known.select("source_system", "local_id", "stored_version").unionByName(
        new.select("source_system", "local_id", F.lit(None).cast("bigint").alias("stored_version")))


def point_lookups(spark, sf_dir):
    """Rows of the people table for a batch of keys, which repeats some and has unknown ones."""
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.lit("demo").alias("tenant_id"), F.concat(F.lit("crm-"), (F.col("o_custkey") * 2).cast("string")).alias("enterprise_id"))
    return reg.lookup(people(spark, sf_dir), wanted, ["tenant_id", "enterprise_id"]).select("enterprise_id")


def quarantined_people(spark, sf_dir):
    """Rows without a blocking key are set aside; here those whose keys were withheld."""
    rows = people(spark, sf_dir).withColumn(
        "blocking_keys", F.when(F.col("k") % 6 != 0, F.col("blocking_keys")).otherwise(F.expr("slice(blocking_keys, 1, 0)")))
    usable, aside = blocking.split_blockable(rows)
    return usable.select("enterprise_id", F.lit(None).cast("string").alias("reason")).unionByName(aside.select("enterprise_id", "reason"))


def identity_persons(spark, sf_dir):
    """Every identity with its person, where it has one."""
    registry = reg.Registry(spark).having(
        canonical_patients=linked_sources(spark, sf_dir).select("tenant_id", "enterprise_id").distinct(),
        persons=persons(spark, sf_dir).where("version <> 5"))
    return reg.canonical_with_person(registry).select("enterprise_id", "person_version", "person_is_active")


def ordered_sources(spark, sf_dir):
    return survivorship.ordered_sources(linked_sources(spark, sf_dir)).select("enterprise_id", "local_id", "position")


def ack_totals(spark, sf_dir):
    parsed = hl7.parse_adt(adt_messages(spark, sf_dir), "hosp")
    coded = parsed.select(
        F.when(F.col("error").isNull(), "AA").otherwise("AR").alias("ack_code"), (F.col("event_id") % 3 == 0).alias("is_replay"))
    return hl7.ack_counts(coded)


#: A third of the merges name one survivor, some a record that nobody has.
_MERGE_USER = "case when event_type = 'error' and event_id % 3 = 0 then 0 else user_id + 1000 * (event_id % 16) end"
_MERGED_USER = "user_id + 1000 * ((event_id {div} 16) % 17)"


def merge_messages(spark, sf_dir):
    """One ADT message per event, of many records."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type"))
    named = events.select(
        "event_id", "event_type", F.col("ts").alias("arrival"), F.expr(_MERGE_USER).alias("user_id"), F.expr(_MERGED_USER.format(div="div")).alias("merged_id"))
    return named.select("event_id", "arrival", F.expr(derived.ADT_TEXT.replace("user_id + 1 as", "merged_id as")).alias("message"))


def adt_apply(spark, sf_dir):
    """Every message applied to an empty registry: its answer, and the record whose identity its record ends up in."""
    registry, acks = adt.apply_adt(reg.Registry(spark), merge_messages(spark, sf_dir), "hosp", derived.demo_config(), now())
    homes = registry["source_patients"].select("local_id", "enterprise_id")
    own = homes.select(hashing.new_enterprise_id(F.lit("demo"), F.lit("hosp"), F.col("local_id")).alias("enterprise_id"), F.col("local_id").alias("survivor"))
    return acks.join(homes.join(own, "enterprise_id", "left").drop("enterprise_id"), "local_id", "left").select(
        F.col("control_id").cast("long").alias("event_id"), "ack_code", "is_replay", "diagnostic", "survivor")


def merges_in_order(spark, sf_dir):
    """Every merge message on its own: which identity it retires into which, taken in the order of arrival."""
    merges = merge_messages(spark, sf_dir)
    parsed = hl7.parse_adt(merges, "hosp").where("error is null and previous_local_id <> local_id").select("event_id", "arrival", "previous_local_id", "local_id")
    done = merge_in_order(parsed, "previous_local_id", "local_id", ["arrival", "event_id"])
    return done.select("event_id", "retired", "survivor", "acts")


def version_gaps(spark, sf_dir):
    """Runs of the versions each source key has; a third of all versions belong to one key."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.expr("case when event_id % 3 = 0 then 'U0' else concat('U', cast(user_id as string)) end").alias("local_id"), F.expr("event_id div 40").alias("version"))
    return version_runs(rows, ["local_id"], "version")


def versions_in_turn(spark, sf_dir):
    """Which of the changes of source keys find the version they expect; a third of all changes are of one key."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    changes = events.selectExpr("event_id", f"{_CHANGED.format(text='string')} as local_id", f"{_EXPECTED.format(div='div')} as expected_version")
    stored = events.where("user_id % 5 = 0").selectExpr("concat('U', cast(user_id as string)) as local_id", "cast(2 as long) as version").distinct()
    return in_turn(changes, stored, ["local_id"], ["event_id"], "event_id")


def upsert_versions(spark, sf_dir):
    """Up to seven changes of every fifth customer: some expect the version in force, others a stale or a later one."""
    cfg = derived.demo_config()
    loaded = people(spark, sf_dir).where("source_system = 'crm'")
    parts = reg.assemble(loaded.drop("norm", "blocking_keys", "k", "source_is_authoritative"), cfg, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    registry = reg.Registry(spark, {name: staged(spark, sf_dir, f"versioned-{name}", lambda df=df: df) for name, df in parts.items()})
    turn = F.explode(F.sequence(F.lit(0), (F.col("k") % 7).cast("int"))).alias("turn")
    incoming = loaded.where("k % 5 = 0").select("tenant_id", "source_system", "local_id", "profile", "k", turn).select(
        "tenant_id", "source_system", "local_id", "profile", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")).alias("arrival"),
        F.expr(_WANTED).alias("expected_version"))
    done = upsert(registry, incoming, cfg, now())
    outcomes = done.results.groupBy("source_system", "local_id").agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "version-conflict").alias("refused"))
    return outcomes.join(done.registry["source_patients"], ["source_system", "local_id"]).select(
        "source_system", "local_id", "accepted", "refused", F.col("version").cast("long").alias("version"))


def settings_as_of(spark, sf_dir):
    """For each job the version of the settings in force when it was asked for."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    settings = orders.groupBy(F.col("o_orderpriority").alias("schedule_key"), F.expr("cast(date_trunc('quarter', o_orderdate) + interval 10 days as date)").alias("valid_from")).agg(
        F.max("o_orderkey").alias("settings_version"))
    asked = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("schedule_key"), F.col("o_orderdate").cast("date").alias("requested_at"))
    return as_of(asked, settings, ["schedule_key"], "requested_at", "valid_from", ["settings_version"]).select("id", "settings_version")


def large_name_sets(spark, sf_dir):
    """Best of all pairs of names between sides of some two hundred names each."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    side = lambda factor, odd, name: customers.where(F.col("c_custkey") % 2 == odd).groupBy(F.expr("c_custkey div 400").alias("part")).agg(
        F.array(F.struct(F.lit("").alias("family"), F.lit("").alias("phonetic"), F.sort_array(F.collect_list(
            F.translate((F.col("c_custkey") * factor).cast("string"), "0123456789", "AEINORSTLM"))).alias("given"))).alias(name))
    rules = Comparators(given=("Exact", "JaroWinkler"))
    pairs = side(7919, 0, "l").join(side(7927, 1, "r"), "part").select("part", F.struct(F.col("l").alias("names")).alias("l"), F.struct(F.col("r").alias("names")).alias("r"))
    best = pairs.select("part", best_names(F.col("l"), F.col("r"), rules).alias("best"))
    return best.select("part", F.round("best.given.sim", 9).alias("similarity"), F.col("best.given.comparator").alias("comparator"), F.col("best.given.pairs").alias("pairs"))


def audit_written(spark, sf_dir):
    """Audit rows of a batch of identities, with the stable id left out."""
    rows = persons(spark, sf_dir).select("tenant_id", "enterprise_id", "version")
    made = reg.audit_rows(rows, "rebuild", "maintenance", "quarterly rebuild", now())
    same = F.count("*").over(Window.partitionBy("id")).alias("same_id")
    return made.select("enterprise_id", "action", "actor", "outcome", "reason", same)


def person_links(spark, sf_dir):
    """Links of persons to their sources: one in three was there before, one of those for another resource."""
    from kinweave.plans.maintenance import build_person_links

    sources = linked_sources(spark, sf_dir).select("tenant_id", "enterprise_id", "source_system", "local_id", "resource_id", "k")
    before = sources.where("k % 3 = 0").select(
        "tenant_id", "enterprise_id", "source_system", "local_id",
        F.when(F.col("k") % 9 != 0, F.col("resource_id")).otherwise("src-other").alias("source_resource_id"),
        F.lit("Level4").alias("assurance"), F.to_timestamp(F.lit("2023-05-01 00:00:00")).alias("linked_at"), F.lit("first load").alias("reason"))
    made = build_person_links(sources.drop("k"), before, now())
    return made.select("enterprise_id", "local_id", "assurance", F.to_date("linked_at").alias("linked"), "_kept").withColumnRenamed("_kept", "kept")


def effective_approvals(spark, sf_dir):
    """How many approvals reviews of neighbouring customers need once the policy asks for one."""
    from dataclasses import replace

    from kinweave.plans import review
    from kinweave.sources import derived

    cfg = replace(derived.demo_config(), required_approvals=1)
    crm = people(spark, sf_dir).where("source_system = 'crm'").select("tenant_id", "enterprise_id", "profile", "k")
    cases = crm.select(
        "tenant_id", F.concat(F.lit("r"), F.col("k").cast("string")).alias("id"), F.col("enterprise_id").alias("subject_id"),
        F.concat(F.lit("crm-"), (F.col("k") + 2).cast("string")).alias("candidate_id"),
        F.when(F.col("k") % 7 == 0, "Split").otherwise("ManualDuplicate").alias("kind"), (F.col("k") % 5 == 0).alias("policy_locked"),
        F.when(F.col("k") % 4 == 1, 1).otherwise(2).alias("required_approvals"))
    return review.effective_approvals(cases, crm.drop("k"), cfg).select("id", "effective_approvals")


# ---- captures and streams ----------------------------------------------------------------------------


def captured_frames(spark, sf_dir):
    """All messages as framed captures, some frames cut short or badly ended, read back in ranges of files."""
    number, plain = F.col("event_id"), F.col("message")
    sent = adt_messages(spark, sf_dir).select(
        F.when(number % 50 == 0, F.concat(plain, F.lit("\x1cX")))
        .when(number % 77 == 5, F.concat(F.lit("cut short\x0b"), plain)).otherwise(plain).alias("message"))
    folder = working_folder(spark, "captures")
    hl7.write_mllp_capture(sent, folder)
    good, bad = hl7.read_mllp_capture(spark, folder)
    fields = F.split("message", r"\|")
    read = good.select(
        fields[9].cast("long").alias("event_id"), F.split(fields[14], r"\^")[0].alias("local_id"),
        F.split(fields[8], r"\^")[1].alias("trigger"), F.lit(None).cast("string").alias("problem"), F.lit(1).cast("long").alias("frames"))
    faults = bad.groupBy("problem").agg(F.count(F.lit(1)).alias("frames"))
    return read.unionByName(faults, allowMissingColumns=True)


def _streamed(rows: DataFrame, late: Column, state: Callable[[DataFrame], DataFrame], mode: str) -> str:
    """Rows land in a folder, those that are ``late`` in a second delivery; the stream is started for each.

    Returns the folder of what the stream put out.
    """
    spark = rows.sparkSession
    landing, out, checkpoint = (working_folder(spark, f"stream-{name}") for name in ("in", "out", "checkpoint"))
    late = F.coalesce(late, F.lit(False))
    for part in (rows.where(~late), rows.where(late)):
        part.write.mode("append").parquet(landing)
        stream = state(spark.readStream.schema(rows.schema).parquet(landing))
        keyed.stream_deltas(stream, out, checkpoint, mode).awaitTermination()
    return out


def stream_latest(spark, sf_dir):
    """Newest version of every record from a stream that gets the newer half of the versions first."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("local_id"), F.col("o_orderdate").alias("last_updated"),
        F.col("o_orderkey").alias("version_id"))
    newest = lambda stream: keyed.latest_rows(stream, ["local_id"], ["last_updated", "version_id"])
    out = _streamed(rows, F.col("last_updated") < "1995-01-01", newest, "update")
    return keyed.current(spark, rows.schema, out, ["local_id"])


def stream_replays(spark, sf_dir):
    """Every event as a message whose control id comes again, judged by a stream that is stopped half-way."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(
        "event_id", F.col("ts").alias("arrival"), (F.col("event_id") % 700).cast("string").alias("idempotency_key"),
        (F.col("user_id") % 3).cast("string").alias("payload_digest"),
        F.concat(F.lit("answer to "), F.col("event_id").cast("string")).alias("response"))
    half = events.agg(F.timestamp_seconds(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)).first()[0]
    answered = lambda stream: keyed.first_answers(
        stream, "idempotency_key", "payload_digest", "response", ["arrival", "event_id"], 0)
    out = _streamed(rows, F.col("arrival") > F.lit(half), answered, "append")
    return spark.read.schema("event_id long, receipt_state string, stored_response string").parquet(out).drop("epoch")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        search_persons, search_reviews, search_audit, search_jobs, last_windows, priority_reviews, operational_summary, reconcile_totals,
        calibration_loss, dataset_digest, idempotency_keys, registry_ids, source_owners, new_and_known, point_lookups, quarantined_people,
        identity_persons, ordered_sources, ack_totals, audit_written, person_links, effective_approvals,
        adt_apply, merges_in_order, version_gaps, settings_as_of, large_name_sets, versions_in_turn, upsert_versions,
        captured_frames, stream_latest, stream_replays,
    )
}


def oracles() -> dict[str, str]:
    """DuckDB SQL that computes the same another way."""
    from kinweave.oracles import _EVENTS, _LINKED, _jw, _with

    review, log, job, person = (_duck(r) for r in (_REVIEWS, _AUDIT, _JOBS, _PERSONS))
    # owner[i]: the identity that record i is in; every merge in turn moves all records of one identity
    walk = f"""with recursive e as (select * replace ({_MERGE_USER} as user_id), {_MERGE_USER} as u, {_MERGED_USER.format(div="//")} as merged,
              case event_type when 'signup' then 'A28' when 'view' then 'A08' when 'click' then 'A31' when 'purchase' then 'A04' else 'A40' end as trigger,
              case when event_id % 40 = 0 then 'Unread HL7 version: 2.7' when event_id % 90 = 7 then 'PID-7 is no date of birth.' end as error from events),
            good as (select * from e where error is null),
            both_ends as (select u from good where trigger = 'A40' and merged <> u union all select merged from good where trigger = 'A40' and merged <> u),
            rec as (select u, row_number() over (order by u) as i from (select distinct u from good)),
            m as (select row_number() over (order by ts, event_id) as n, event_id, o.i as old, w.i as new from (select * from e where error is null) g
              join rec w on w.u = g.u join rec o on o.u = g.merged where trigger = 'A40' and g.merged <> g.u),
            walk(n, event_id, was, now, acts, owner) as (
              select cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), false, (select list(i order by i) from rec)
              union all select m.n, m.event_id, owner[old], owner[new], owner[old] <> owner[new],
                case when owner[old] = owner[new] then owner else list_transform(owner, lambda x: case when x = owner[old] then owner[new] else x end) end
              from walk join m on m.n = walk.n + 1) """
    word = lambda i: f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::ubigint)::varchar"
    return {
        "search_persons": f"select enterprise_id, version from {person} where is_active",
        "search_reviews": f"select id, subject_id from {review} where status = 'AwaitingSecondApproval' and kind = 'Split'",
        "search_audit": f"""select id, enterprise_id, recorded_at from {log} where action = 'click' and actor like 'User1%'
            and outcome = 'success' and recorded_at between timestamp '2024-01-02' and timestamp '2024-01-09 12:00:00'""",
        "search_jobs": f"select id, schedule_key from {job} where kind = 'Rebuild' and status = 'Completed' and source_system = 'crm'",
        "last_windows": f"select schedule_key, max(window_end) as window_end from {job} where status = 'Completed' group by schedule_key",
        "priority_reviews": f"""select id, status, created_at from {review} where status in ('Pending', 'AwaitingSecondApproval')
            order by case status when 'AwaitingSecondApproval' then 0 else 1 end, created_at desc, id limit 50""",
        "operational_summary": f"""select (select count(*) from {review} where status = 'Pending') as pending,
            (select count(*) from {review} where status = 'AwaitingSecondApproval') as awaiting,
            (select count(*) from {log} where recorded_at >= timestamp '2024-01-05') as recent_audit,
            (select max(o_orderkey) from orders) as settings_version, (select 'v' || max(o_orderkey) from orders) as profile_version""",
        "reconcile_totals": """select *, imported + unchanged + quarantined = expected as balanced from (
            select event_type as source_system, count(*) filter (event_id % 50 <> 0) as expected,
              count(*) filter (event_id % 25 <> 0 and event_id % 3 = 0) as imported, count(*) filter (event_id % 25 <> 0 and event_id % 3 = 1) as unchanged,
              count(*) filter (event_id % 25 <> 0 and event_id % 3 = 2) as quarantined, count(*) filter (event_id % 3 = 0) as stored
            from events group by event_type)""",
        "calibration_loss": f"""select round(avg((s - m) * (s - m)), 9) as brier,
            round(avg(case when m = 1 then -ln(greatest(s, 1e-12)) else -ln(1 - least(s, 1 - 1e-12)) end), 9) as log_loss
            from (select decision_score as s, is_match::int::double as m from {review})""",
        "dataset_digest": f"""select sha256(concat_ws(',', count(*)::varchar, {', '.join(word(i) for i in range(8))})) as digest
            from (select sha256(id || '|' || case when is_match then '1' else '0' end) as h from {review})""",
        "idempotency_keys": f"""select id, 'demo|hosp|' || case when id::bigint % 7 <> 0 then action else '' end || '|' || actor || '|' || id as adt_key,
            'fhir-reconcile:crm:' || enterprise_id || ':' || id as feed_key, upper(sha256(action || '/' || actor)) as digest,
            sha256(enterprise_id) as lower_digest from {log}""",
        "registry_ids": """select c_custkey, case c_custkey % 5 when 0 then true when 1 then false when 2 then true
            when 3 then c_custkey % 70 between 1 and 62 else false end as valid from customer""",
        "source_owners": _with() + "select source_system, enterprise_id, case when source_system <> 'crm' then 'not-the-owning-source' end as reason from p",
        "new_and_known": _with() + "select source_system, local_id, case when k % 3 <> 0 then k % 5 end as stored_version from p",
        "point_lookups": _with() + "select enterprise_id from p where source_system = 'crm' and k % 2 = 0 and k // 2 in (select o_custkey from orders)",
        "quarantined_people": _with() + "select enterprise_id, case when k % 6 = 0 or enterprise_id not in (select enterprise_id from raw) then 'insufficient-identity' end as reason from p",
        "identity_persons": _with() + f"""select i.enterprise_id, n.version as person_version, n.is_active as person_is_active
            from (select distinct 'P' || k as enterprise_id from p) i left join (select * from {person} where version <> 5) n using (enterprise_id)""",
        "ordered_sources": _with(_LINKED) + "select identity as enterprise_id, local_id, ord as position from ranked",
        "ack_totals": "with " + _EVENTS.strip() + """
            select case when error is null then 'AA' else 'AR' end as ack_code, event_id % 3 = 0 as is_replay, count(*) as messages from e group by all""",
        "person_links": _with() + """select 'P' || k as enterprise_id, local_id, case when k % 3 = 0 and k % 9 <> 0 then 'Level4' else 'Level2' end as assurance,
            case when k % 3 = 0 and k % 9 <> 0 then date '2023-05-01' else date '2024-03-01' end as linked, k % 3 = 0 and k % 9 <> 0 as kept from p""",
        "effective_approvals": _with() + """select 'r' || a.k as id, case when a.k % 4 = 1 then 1 when a.k % 7 = 0 or a.k % 5 = 0 or b.k is null then 2
            when a.vouched and b.vouched and a.nhs <> b.nhs then 2 else 1 end as effective_approvals
            from p a left join p b on b.source_system = 'crm' and b.k = a.k + 2 where a.source_system = 'crm'""",
        "adt_apply": walk + f"""
            select event_id, case when error is not null then 'AR' when unknown then 'AE' else 'AA' end as ack_code, false as is_replay,
              case when error is not null then error when unknown then 'Not stored; the message may be sent again.' else 'Stored.' end as diagnostic,
              (select 'U' || s.u from rec s where s.i = (select owner[r.i] from walk order by n desc limit 1)) as survivor
            from (select *, trigger = 'A40' and u <> merged and merged not in (select u from rec) as unknown from e) left join rec r using (u)""",
        "merges_in_order": walk.replace("select distinct u from good", "select distinct u from both_ends") + """
            select event_id, 'U' || o.u as retired, 'U' || w.u as survivor, k.acts from walk k join rec o on o.i = k.was join rec w on w.i = k.now""",
        "version_gaps": """
            with v as (select distinct case when event_id % 3 = 0 then 'U0' else 'U' || user_id end as local_id, event_id // 40 as version from events),
            r as (select *, version - row_number() over (partition by local_id order by version) as run from v),
            g as (select local_id, min(version) as from_version, max(version) as to_version from r group by local_id, run)
            select *, lead(from_version) over (partition by local_id order by from_version) - to_version - 1 as missing_after from g""",
        "versions_in_turn": f"""
            with recursive c as (select event_id, {_CHANGED.format(text='varchar')} as local_id, {_EXPECTED.format(div='//')} as wants from events),
            r as (select *, row_number() over (partition by local_id order by event_id) as place from c),
            walk(local_id, place, event_id, accepted, found_version, following) as (
              select local_id, cast(0 as bigint), cast(null as bigint), false, cast(0 as bigint),
                cast(case when local_id in (select 'U' || user_id from events where user_id % 5 = 0) then 2 else 0 end as bigint)
              from (select distinct local_id from c)
              union all select r.local_id, r.place, r.event_id, wants is null or wants = following, following,
                following + case when wants is null or wants = following then 1 else 0 end
              from walk join r on r.local_id = walk.local_id and r.place = walk.place + 1)
            select event_id, accepted, found_version from walk where place > 0""",
        "upsert_versions": _with().replace("WITH", "with recursive", 1) + f""",
            w(source_system, local_id, k, turn, accepted, refused, version) as (
              select source_system, local_id, k, case when enterprise_id in (select enterprise_id from raw) then 0 else 7 end, cast(0 as bigint), cast(0 as bigint), cast(1 as bigint)
              from p where source_system = 'crm' and k % 5 = 0
              union all select source_system, local_id, k, turn + 1, accepted + held, refused + 1 - held, version + held
              from (select *, case when coalesce({_WANTED}, version) = version then 1 else 0 end as held from w where turn <= k % 7))
            select source_system, local_id, accepted, refused, version from w qualify row_number() over (partition by local_id order by turn desc) = 1""",
        "settings_as_of": """
            with s as (select o_orderpriority as schedule_key, cast(date_trunc('quarter', o_orderdate) + interval 10 days as date) as valid_from,
              max(o_orderkey) as settings_version from orders group by all)
            select o_orderkey as id, settings_version from orders asof left join s
              on s.schedule_key = o_orderpriority and cast(o_orderdate as date) >= s.valid_from""",
        "large_name_sets": f"""
            with n as (select c_custkey // 400 as part, c_custkey % 2 as side,
              translate(cast(c_custkey * case when c_custkey % 2 = 0 then 7919 else 7927 end as varchar), '0123456789', 'AEINORSTLM') as name from customer),
            p as (select l.part, l.name as x, r.name as y from n l join n r on l.part = r.part and l.side = 0 and r.side = 1), {_jw("jws", "p")}
            select part, round(max(jw), 9) as similarity, case when max(jw) = 1 then 'exact' when max(jw) > 0 then 'jaro-winkler' else 'none' end as comparator,
              count(*) as pairs from p join jws using (x, y) group by part""",
        "captured_frames": "with " + _EVENTS.strip() + """
            select event_id, 'U' || user_id as local_id, trigger, null::varchar as problem, 1::bigint as frames from e where event_id % 50 <> 0
            union all select null, null, null, 'end-block-without-carriage-return', count(*) from e where event_id % 50 = 0 having count(*) > 0
            union all select null, null, null, 'unterminated-frame', count(*) from e where event_id % 50 <> 0 and event_id % 77 = 5 having count(*) > 0""",
        "stream_latest": """
            select o_custkey::varchar as local_id, max(o_orderdate) as last_updated, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as version_id
            from orders group by o_custkey""",
        "stream_replays": """
            with f as (select event_id % 700 as k, min_by(event_id, (ts, event_id)) as event_id, min_by(user_id % 3, (ts, event_id)) as d from events group by 1)
            select e.event_id, case when e.event_id = f.event_id then 'fresh' when e.user_id % 3 = d then 'replay' else 'conflict' end as receipt_state,
              case when e.event_id <> f.event_id then 'answer to ' || f.event_id end as stored_response from events e join f on e.event_id % 700 = f.k""",
        "audit_written": f"""select enterprise_id, 'rebuild' as action, 'maintenance' as actor, 'success' as outcome,
            'quarterly rebuild' as reason, 1::bigint as same_id from {person}""",
    }
