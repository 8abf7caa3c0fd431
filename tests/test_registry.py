"""Registry jobs end to end: upsert, reviews, splits, maintenance, commits, streams."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinweave.config import Secret
from kinweave.functions import hashing
from kinweave.plans import maintenance, review, search
from kinweave.plans import registry as reg
from kinweave.plans.upsert import upsert
from kinweave.streaming import adt
from test_sources import message
from test_upsert import config, rows_of

DAY = dt.date(1980, 1, 2)


def at(day):
    return F.to_timestamp(F.lit(f"2024-02-{day:02}"))


def kept(registry, folder):
    """Commit and load, as a caller would between batches."""
    base = reg.load(registry.spark, folder)
    return reg.commit(folder, base, registry.tables)


def decision(spark, review_row, actor, what="Link", version=1, day=5):
    return spark.createDataFrame(
        [("t1", review_row["id"], actor, what, "checked", version, dt.datetime(2024, 2, day))],
        "tenant_id string, review_id string, actor string, decision string, reason string, "
        "expected_version bigint, decided_at timestamp")


@pytest.fixture(scope="module")
def conflicting(spark, tmp_path_factory):
    """Two Smiths alike in all but their trusted numbers, and one pair with the same number."""
    folder = str(tmp_path_factory.mktemp("reg"))
    cfg = replace(config(), profile=replace(config().profile, probable=0.8, possible=0.5))
    rows = [
        ("a", "1", "SMITH", "ALEX", DAY, "0111", "9434765919"),
        ("b", "1", "SMITH", "ALEX", DAY, "0111", "9999999999"),
        ("a", "5", "KHAN", "SAM", DAY, "0555", "4010232137"),
        ("b", "5", "KHAN", "SAM", DAY, "0555", "4010232137"),
    ]
    got = upsert(reg.Registry(spark), rows_of(spark, rows), cfg, at(1))
    return kept(got.registry, folder), cfg, folder


def test_two_approvals_then_link(spark, conflicting):
    registry, cfg, folder = conflicting
    (case,) = registry["review_cases"].collect()
    assert case["policy_locked"] and case["required_approvals"] == 2 and case["grade"] == "Probable"
    relaxed = replace(cfg, required_approvals=1)
    asked = decision(spark, case, "ann").unionByName(decision(spark, case, "ann", version=2, day=6)).unionByName(
        decision(spark, case, "bob", version=2, day=7)).unionByName(
        decision(spark, case, "eve", version=9, day=8)).unionByName(
        decision(spark, case, "eve", version=3, day=9))
    done, outcomes = review.apply_decisions(registry, asked, relaxed)
    got = {(r["actor"], r["verdict"], r["error"]) for r in outcomes.collect()}
    assert got == {
        ("ann", "AwaitingSecondApproval", None), ("ann", None, "same-reviewer"), ("bob", "Linked", None),
        ("eve", None, "version-conflict"), ("eve", None, "already-decided")}
    subject = done["canonical_patients"].where(F.col("enterprise_id") == case["subject_id"]).first()
    assert not subject["is_active"] and subject["replaced_by"] == case["candidate_id"]
    owned = done["source_patients"].where(F.col("enterprise_id") == case["candidate_id"])
    assert owned.count() == 2
    survivor = done["canonical_patients"].where(F.col("enterprise_id") == case["candidate_id"]).first()
    assert survivor["version"] == 2 and len(survivor["profile"]["identifiers"]) == 2
    links = done["person_links"].where(F.col("enterprise_id") == case["candidate_id"])
    assert links.count() == 2
    person = done["persons"].where(F.col("enterprise_id") == case["subject_id"]).first()
    assert not person["is_active"] and person["replaced_by"] == case["candidate_id"]
    actions = {r["action"] for r in done["audit"].collect()}
    assert {"source-patient-create", "review-link", "review-link-proposed"} <= actions


def test_split_review(spark, conflicting):
    registry, cfg, folder = conflicting
    khan = registry["canonical_patients"].where("profile.names[0].family = 'KHAN'").first()
    assert khan["version"] == 2
    request = spark.createDataFrame(
        [("t1", khan["enterprise_id"], 2, [("b", "5")], "mixed up"),
         ("t1", khan["enterprise_id"], 2, [("b", "5"), ("a", "5")], "all of them"),
         ("t1", khan["enterprise_id"], 1, [("b", "5")], "old")],
        "tenant_id string, enterprise_id string, expected_version bigint, "
        "sources_to_move array<struct<source_system:string,local_id:string>>, reason string")
    opened, refused = review.open_splits(registry, request, cfg, at(3), "ann")
    assert sorted(r["problem"] for r in refused.collect()) == ["bad-selection", "version-conflict"]
    case = opened["review_cases"].where("kind = 'Split'").first()
    asked = decision(spark, case, "ann", "Split").unionByName(decision(spark, case, "bob", "Link", 2, 6)).unionByName(
        decision(spark, case, "bob", "Split", 2, 7))
    done, outcomes = review.apply_decisions(opened, asked, cfg)
    assert {(r["verdict"], r["error"]) for r in outcomes.collect()} == {
        ("AwaitingSecondApproval", None), (None, "wrong-decision"), ("Split", None)}
    ids = done["source_patients"].where("local_id = '5'").collect()
    assert len({r["enterprise_id"] for r in ids}) == 2
    moved = next(r for r in ids if r["source_system"] == "b")
    assert moved["enterprise_id"] == case["candidate_id"] and moved["version"] == 2
    fresh = done["canonical_patients"].where(F.col("enterprise_id") == case["candidate_id"]).first()
    assert fresh["version"] == 1 and fresh["is_active"]
    link = done["person_links"].where(F.col("enterprise_id") == case["candidate_id"]).first()
    assert link["reason"] == f"Split approved in review {case['id']}"


def test_stale_reviews_and_manual_reviews(spark, conflicting):
    registry, cfg, folder = conflicting
    case = registry["review_cases"].first()
    assert review.outdated_reviews(registry).count() == 0
    _, outcomes = review.apply_decisions(registry, decision(spark, case, "ann", "Supersede"), cfg)
    assert outcomes.first()["error"] == "still-current"
    later = upsert(registry, rows_of(spark, [("a", "1", "SMITH", "ALEXA", DAY, "0111", "9434765919")]), cfg, at(4))
    changed = kept(later.registry, folder + "-stale")
    assert review.outdated_reviews(changed).count() == 1
    _, outcomes = review.apply_decisions(changed, decision(spark, case, "ann"), cfg)
    assert outcomes.first()["error"] == "identity-changed"
    done, outcomes = review.supersede(changed, "newer record", "ann", cfg, at(6))
    assert outcomes.first()["verdict"] == "Superseded"
    assert done["review_cases"].first()["status"] == "Superseded"
    assert done["audit"].where("action = 'review-supersede'").count() == 1
    ids = {r["enterprise_id"]: r["version"] for r in changed["canonical_patients"].collect()}
    a, b = sorted(ids)[:2]
    pairs = spark.createDataFrame(
        [("t1", a, b, ids[a], ids[b], "look"), ("t1", a, a, ids[a], ids[a], "same"), ("t1", a, b, 9, 9, "old")],
        "tenant_id string, subject_id string, candidate_id string, subject_version bigint, "
        "candidate_version bigint, reason string")
    opened, refused = review.open_reviews(changed, pairs, cfg, at(7), "ann")
    assert opened["review_cases"].where("kind = 'ManualDuplicate'").count() == 1
    assert sorted(r["problem"] for r in refused.collect()) == ["same-identity", "version-conflict"]


def test_searches_and_pages(spark, conflicting):
    registry, cfg, _ = conflicting
    canonical = registry["canonical_patients"]
    assert search.search_canonical(canonical, family="smith", birth_date="1980-01-02").count() == 2
    assert search.search_canonical(canonical, identifier="9434765919").count() == 1
    assert search.search_reviews(registry["review_cases"]).count() == 1
    assert search.search_reviews(registry["review_cases"], "Linked").count() == 0
    audit = registry["audit"]
    assert search.search_audit(audit, action="SOURCE-PATIENT-CREATE", actor="ING").count() == 4
    assert search.search_audit(audit, since="2024-02-02").count() == 0
    assert search.search_persons(registry["persons"]).count() == 3
    assert search.priority_reviews(registry["review_cases"]).count() == 1
    seen, cursor = [], None
    while True:
        rows, cursor = search.page(audit, "audit", 3, cursor)
        seen += [r["id"] for r in rows]
        if cursor is None:
            break
    assert len(seen) == len(set(seen)) == 4
    with pytest.raises(ValueError):
        search.page(audit, "audit", 3, "????")


def test_commit_conflict_and_tenants(spark, conflicting):
    registry, cfg, folder = conflicting
    with pytest.raises(reg.VersionConflict):
        reg.commit(folder, reg.Registry(spark), {"audit": registry["audit"]})
    assert reg.load(spark, folder, 1)["canonical_patients"].count() == 3
    mine, others = reg.check_source_owner(registry["source_patients"], "a")
    assert mine.count() == 2 and others.count() == 2
    assert reg.identity_view(registry, registry["canonical_patients"]).count() == 4


def test_reindex_rebuild_reconcile(spark, conflicting):
    registry, cfg, folder = conflicting
    same, counts = maintenance.reindex(registry, cfg, at(8))
    assert counts == {"scanned": 3, "updated": 0, "unchanged": 3}
    rotated = replace(cfg, secrets=(replace(cfg.secrets[0], is_active=False), Secret("v2", b"\2" * 32)))
    done, counts = maintenance.reindex(registry, rotated, at(8))
    assert counts["updated"] == 3
    assert {len(r["blocking_keys"]) for r in done["canonical_patients"].collect()} == {6}
    with pytest.raises(maintenance.UnsafeReindex):
        maintenance.reindex(registry, replace(cfg, secrets=(Secret("v9", b"\7" * 32),)), at(8))
    same, counts = maintenance.rebuild(registry, cfg, at(9))
    assert counts == {"scanned": 3, "updated": 0, "unchanged": 3, "warnings": 0}
    lost = registry.having(source_patients=registry["source_patients"].where("not (source_system = 'a' and local_id = '5')"))
    _, counts = maintenance.rebuild(lost, cfg, at(9))
    assert counts["warnings"] == 1 and counts["unchanged"] == 2
    matched, counts = maintenance.reconcile_population(registry, cfg, at(10))
    assert counts["reviews_created"] == 1
    again, counts = maintenance.reconcile_population(matched, cfg, at(11))
    assert counts["reviews_created"] == 0
    guidance = review.review_guidance(matched["review_cases"], registry["canonical_patients"]).first()
    assert guidance["recommendation"] == "Pause and verify identifiers"


def test_adt_stream_equals_batch_and_replays(spark, tmp_path):
    cfg = replace(config(), sources=(("hosp", config().sources[0][1]),))
    pid = "PID|1||{0}^^^HOSP^MR||{1}^Alex||19800102|F|||||0111{0}"
    texts = [
        message("A28", pid=pid.format("L1", "Smith"), control="1"),
        message("A28", pid=pid.format("L2", "Khan"), control="2"),
        message("A08", pid=pid.format("L1", "Smythe"), control="3"),
        message("A40", pid=pid.format("L2", "Khan"), mrg="MRG|L1^^^HOSP^MR", control="4"),
        message("A28", pid=pid.format("L9", "Other"), control="2"),
        message("A02", control="5"), message("A28", pid=pid.format("L2", "Khan"), control="2"),
    ]
    schema = "message string, arrival timestamp"
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(m, start + dt.timedelta(minutes=i)) for i, m in enumerate(texts)], schema).coalesce(1)
    batch, acks = adt.apply_adt(reg.Registry(spark), rows, "hosp", cfg, at(1))
    codes = [(r["ack_code"], r["is_replay"]) for r in acks.orderBy("arrival").collect()]
    assert codes == [("AA", False)] * 4 + [("AR", False), ("AR", False), ("AA", True)]
    rows.write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "registry")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    adt.stream_adt(stream, root, "hosp", cfg, str(tmp_path / "cp"), str(tmp_path / "acks")).awaitTermination()
    stored = reg.load(spark, root)

    def view(registry):
        return sorted(
            (r["enterprise_id"], r["is_active"], r["replaced_by"], r["version"],
             tuple(n["family"] for n in r["profile"]["names"]))
            for r in registry["canonical_patients"].collect())

    assert view(stored) == view(batch)
    active = [v for v in view(stored) if v[1]]
    assert len(active) == 1 and set(active[0][4]) == {"Khan", "Smith", "Smythe"}
    assert spark.read.parquet(str(tmp_path / "acks")).count() == 7
    # A new stream over the same messages replays every receipt and changes no identity.
    adt.stream_adt(stream, root, "hosp", cfg, str(tmp_path / "cp2"), str(tmp_path / "acks2")).awaitTermination()
    assert view(reg.load(spark, root)) == view(stored)


def test_latest_by_key_stream(spark, tmp_path):
    spark.createDataFrame(
        [("a", 1, dt.datetime(2024, 1, 2)), ("a", 2, dt.datetime(2024, 1, 1)), ("b", 3, dt.datetime(2024, 1, 1))],
        "key string, v int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, v int, ts timestamp").parquet(str(tmp_path / "in"))
    query = (adt.latest_by_key(adt.drop_replays(stream, "v", "ts", "10 days"), ["key"], "ts").writeStream
             .outputMode("update").format("memory").queryName("latest")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert {(r["key"], r["v"]) for r in spark.table("latest").collect()} == {("a", 1), ("b", 3)}


def test_incremental_import(spark):
    cfg = config()
    feed = rows_of(spark, [("a", str(i), "SMITH", "ALEX", DAY, f"0{i}", None) for i in range(4)]).select(
        F.col("local_id").alias("resource_id"), F.lit("1").alias("version_id"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(local_id as int))").alias("last_updated"),
        "profile", F.sha2("local_id", 256).alias("payload_digest"))
    first, counts = adt.run_incremental(reg.Registry(spark), feed, cfg, "a", "2024-01-02 12:00:00")
    assert counts["imported"] == 2
    first = first.having(**{name: maintenance.stage(df, name) for name, df in first.tables.items()})
    second, counts = adt.run_incremental(first, feed, cfg, "a", "2024-01-04 00:00:00")
    assert counts["imported"] == 2
    jobs = second["jobs"].orderBy("window_end").collect()
    assert len(jobs) == 2 and jobs[1]["window_start"] == jobs[0]["window_end"]
    assert len(jobs[0]["fingerprint"]) == 64


def adt_rows(spark, texts):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(m, start + dt.timedelta(minutes=i)) for i, m in enumerate(texts)], "message string, arrival timestamp").coalesce(1)


PID = "PID|1||{}^^^HOSP^MR||{}^Ann||19800102|F"


def test_merge_of_an_unknown_record_fails_and_may_be_sent_again(spark):
    cfg = config()
    merge = message("A40", pid=PID.format("L2", "Khan"), mrg="MRG|GONE^^^HOSP^MR", control="9")
    registry, acks = adt.apply_adt(reg.Registry(spark), adt_rows(spark, [merge]), "hosp", cfg, at(1))
    assert [(r["ack_code"], r["is_replay"]) for r in acks.collect()] == [("AE", False)]
    assert registry["receipts"].count() == 0 and registry["canonical_patients"].where("is_active").count() == 1
    registry = registry.having(**{name: maintenance.stage(df, name) for name, df in registry.tables.items()})
    known = message("A28", pid=PID.format("GONE", "Olds"), control="10")
    again, acks = adt.apply_adt(registry, adt_rows(spark, [known, merge]), "hosp", cfg, at(2))
    assert [r["ack_code"] for r in acks.orderBy("arrival").collect()] == ["AA", "AA"]
    assert again["canonical_patients"].where("is_active").count() == 1 and again["receipts"].count() == 2


def test_merges_of_one_batch_are_taken_in_order(spark):
    """Each merge finds the records where the ones before have put them; rings end with one identity."""
    cfg = config()
    cases = [([("1", "2"), ("1", "3")], "3"), ([("1", "2"), ("2", "1")], "2"), ([("1", "2"), ("2", "3"), ("3", "1")], "3")]
    names = {"1": "Smith", "2": "Khan", "3": "Olds"}
    people, merges = [], []
    for c, (pairs, _) in enumerate(cases):
        mine = "ABC"[c]
        pid = lambda k: PID.format(mine + k, names[k] + mine)  # noqa: E731,B023
        people += [message("A28", pid=pid(k), control=mine + k) for k in names]
        merges += [message("A40", pid=pid(b), mrg=f"MRG|{mine}{a}^^^HOSP^MR", control=f"m{mine}{i}") for i, (a, b) in enumerate(pairs)]
    registry, acks = adt.apply_adt(reg.Registry(spark), adt_rows(spark, people + merges), "hosp", cfg, at(1))
    assert {r["ack_code"] for r in acks.collect()} == {"AA"}
    owned = {r["local_id"]: r["enterprise_id"] for r in registry["source_patients"].collect()}
    fresh = hashing.new_enterprise_id(F.lit("t1"), F.lit("hosp"), F.col("k"))
    own = {r["k"]: r["id"] for r in spark.createDataFrame([(k,) for k in owned], "k string").select("k", fresh.alias("id")).collect()}
    for c, (pairs, survivor) in enumerate(cases):
        touched = {"ABC"[c] + x for pair in pairs for x in pair}
        assert {owned[x] for x in touched} == {own["ABC"[c] + survivor]}
    active = {r["enterprise_id"] for r in registry["canonical_patients"].where("is_active").collect()}
    assert active == set(owned.values()) and len(active) == 1 + 2 + 1


def test_replaced_by_chains_and_rings(spark):
    rows = [("t1", "a", "b"), ("t1", "b", "a"), ("t1", "c", "d"), ("t1", "d", "e"), ("t1", "e", "c"), ("t1", "f", "c"),
            ("t1", "g", "h"), ("t1", "h", "i"), ("t1", "i", None), ("t1", "k", "k")]
    table = spark.createDataFrame(rows, "tenant_id string, enterprise_id string, replaced_by string")
    got = {r["enterprise_id"]: r["survivor_id"] for r in reg.resolve_replaced_by(table).collect()}
    assert got == {**dict.fromkeys("abcdef"), "g": "i", "h": "i", "i": "i", "k": "k"}
