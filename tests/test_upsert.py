"""Batch upsert against a plain model that takes the rows one at a time."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinweave.config import NHS_SYSTEM, Comparators, MatchingProfile, Secret, SourcePolicy, TenantConfig
from kinweave.plans import registry as reg
from kinweave.plans.upsert import upsert
from kinweave.schemas import PROFILE
from kinweave.session import stage

VALID = ["4857773457", "4010232137", "9434765919", "9999999999"]


def config(cap=500):
    return TenantConfig(
        "t1", (Secret("v1", b"\1" * 32),),
        MatchingProfile(
            comparators=Comparators(family=("Exact",), given=("Exact",)), max_candidates=cap,
            max_results=min(50, cap), default_results=min(10, cap),
            blocking_rules=("AuthoritativeIdentifier", "FamilyNameAndBirthDate", "Phone"),
        ),
        (("a", SourcePolicy(90, True)), ("b", SourcePolicy(90, True)), ("c", SourcePolicy(40, False))),
        2,
    ).check()


def make_profile(family, given, dob, phone, nhs):
    return (
        [(NHS_SYSTEM, nhs, False, False, None)] if nhs else [],
        [(family, [given], "Official", None, None)], dob, "Unknown", [],
        [("Phone", phone, None)] if phone else [], False,
        [(None, "traced", None), (None, "gold", None)] if nhs else [],
    )


class Model:
    """Sequential meaning on profiles of names, birth date, phones and NHS numbers."""

    def __init__(self, cfg):
        self.cfg, self.sources, self.idents, self.reviews = cfg, {}, {}, []

    def keys(self, p):
        keys = {("ID", i[1]) for i in p["ids"]}
        if p["dob"]:
            keys |= {("F", n[0], p["dob"]) for n in p["names"]}
        return keys | {("T", x) for x in p["phones"]}

    def compare(self, left, right):
        weights = (0.25, 0.2, 0.3, 0.15, 0.07, 0.03)
        fam = float(bool({n[0] for n in left["names"]} & {n[0] for n in right["names"]}))
        giv = float(bool({n[1] for n in left["names"]} & {n[1] for n in right["names"]}))
        a, b = left["dob"], right["dob"]
        dob = 0.0
        if a and b:
            dob = 1.0 if a == b else 0.5 if (a.year == b.year and a.day == b.month and a.month == b.day) else 0.0
        tel = float(bool(set(left["phones"]) & set(right["phones"])))
        score = 0.0
        for sim, weight in zip((fam, giv, dob, 0.0, tel, 0.0), weights):
            score += sim * weight
        score /= 0.25 + 0.2 + 0.3 + 0.15 + 0.07 + 0.03
        mine = {i[1] for i in left["ids"] if i[2]}
        theirs = {i[1] for i in right["ids"] if i[2]}
        certain = bool(mine & theirs)
        conflict = bool(mine and theirs and not mine & theirs) or (certain and bool(a and b and a != b))
        grade = "Certain" if certain and not conflict else "Probable" if score >= 0.82 else "None"
        return score, grade, conflict

    def merge(self, top, low):
        def both(f):
            return list(dict.fromkeys(top[f] + low[f]))

        ids = sorted(both("ids"), key=lambda i: (not i[2], i[1]))
        return {"ids": ids, "names": both("names"), "dob": top["dob"] or low["dob"], "phones": both("phones")}

    def take(self, source, local, family, given, dob, phone, nhs):
        trust, authority = {"a": (90, True), "b": (90, True), "c": (40, False)}[source]
        p = {"ids": [(NHS_SYSTEM, nhs, authority)] if nhs else [], "names": [(family, given)],
             "dob": dob, "phones": [phone] if phone else []}
        if not self.keys(p):
            return "insufficient-identity"
        key = f"{source}/{local}"
        reviews, created = [], False
        if key in self.sources:
            target = self.sources[key]["id"]
        else:
            found = sorted(i for i, c in self.idents.items() if self.keys(c["p"]) & self.keys(p))
            if len(found) > self.cfg.profile.max_candidates:
                return "candidate-limit"
            scored = sorted(
                ((*self.compare(p, self.idents[i]["p"]), i) for i in found), key=lambda x: (-x[0], x[3])
            )
            certain = [x for x in scored if x[1] == "Certain" and not x[2]]
            created = not certain
            target = certain[0][3] if certain else f"new:{key}"
            reviews = [(target, x[3]) for x in scored if x[1] == "Probable"] if created else []
        if created:
            self.idents[target] = {"p": p, "trust": trust, "version": 1}
        else:
            c = self.idents[target]
            c["p"] = self.merge(p, c["p"]) if trust >= c["trust"] else self.merge(c["p"], p)
            c["trust"], c["version"] = max(trust, c["trust"]), c["version"] + 1
        old = self.sources.get(key, {"version": 0})
        self.sources[key] = {"id": target, "version": old["version"] + 1}
        self.reviews += reviews
        return "accepted"


def rows_of(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [("t1", s, l, make_profile(f, g, d, p, n), start + dt.timedelta(seconds=i))
         for i, (s, l, f, g, d, p, n) in enumerate(rows)],
        f"tenant_id string, source_system string, local_id string, profile {PROFILE}, arrival timestamp",
    )


def check(spark, batches, cfg):
    model, registry = Model(cfg), reg.Registry(spark)
    for number, rows in enumerate(batches):
        statuses = [model.take(*row) for row in rows]
        got = upsert(registry, rows_of(spark, rows), cfg, F.to_timestamp(F.lit(f"2024-02-0{number + 1}")))
        registry = got.registry.having(
            **{name: stage(df, name) for name, df in got.registry.tables.items()}
        )
        assert got.counters["accepted"] == statuses.count("accepted")
    names = {}
    from kinweave.functions.hashing import new_enterprise_id

    for r in registry["source_patients"].select(
        F.concat_ws("/", "source_system", "local_id").alias("k"),
        new_enterprise_id(F.col("tenant_id"), F.col("source_system"), F.col("local_id")).alias("e"),
    ).collect():
        names[r["e"]] = f"new:{r['k']}"
    sources = {
        f"{r['source_system']}/{r['local_id']}": (names[r["enterprise_id"]], r["version"])
        for r in registry["source_patients"].collect()
    }
    assert sources == {k: (v["id"], v["version"]) for k, v in model.sources.items()}
    found = {}
    for r in registry["canonical_patients"].collect():
        p = r["profile"]
        found[names[r["enterprise_id"]]] = (
            [(i["value"], i["is_verified"]) for i in p["identifiers"]],
            [(n["family"], n["given"][0]) for n in p["names"]], p["birth_date"],
            [t["value"] for t in p["telecoms"]], r["survivorship_trust"], r["version"],
        )
    wanted = {
        k: ([(i[1], i[2]) for i in c["p"]["ids"]], c["p"]["names"], c["p"]["dob"], c["p"]["phones"],
            c["trust"], c["version"])
        for k, c in model.idents.items()
    }
    assert found == wanted
    return model, registry, names


def random_rows(seed, n):
    r = random.Random(seed)
    days = [dt.date(1980, 1, 2), dt.date(1980, 2, 1), dt.date(1975, 5, 5), None]
    return [
        (r.choice("aabc"), str(r.randrange(n // 2)), r.choice(["SMITH", "JONES", "KHAN"]),
         r.choice(["ALEX", "SAM"]), r.choice(days), r.choice(["0111", "0222", "0333", None]),
         r.choice(VALID + [None] * 3))
        for _ in range(n)
    ]


def test_random_batches_match_the_model(spark):
    rows = random_rows(3, 28)
    check(spark, [rows[:16], rows[16:]], config())


def test_hot_source_and_hot_identifier(spark):
    day = dt.date(1980, 1, 2)
    rows = [("a", "1", "SMITH", "ALEX", day, "0111", VALID[0])] * 12
    rows += [("b", str(i), "SMITH", "ALEX", day, f"0{i}", VALID[0]) for i in range(12)]
    rows += [("c", "9", "SMITH", "ALEX", day, None, None)]
    model, registry, names = check(spark, [rows], config())
    reviews = {(names[r["subject_id"]], names[r["candidate_id"]]) for r in registry["review_cases"].collect()}
    assert reviews == set(model.reviews) == set()
    links = {r["local_id"]: r["assurance"] for r in registry["person_links"].collect()}
    assert links["1"] == "Level4" and links["9"] == "Level2"


def test_probable_reviews_and_cap(spark):
    day = dt.date(1980, 1, 2)
    cfg = replace(config(4))
    rows = [("c", str(i), "SMITH", "ALEX", day, "0111", None) for i in range(9)]
    model, registry, names = check(spark, [rows[:6], rows[6:]], cfg)
    reviews = {(names[r["subject_id"]], names[r["candidate_id"]]) for r in registry["review_cases"].collect()}
    assert reviews == set(model.reviews)


def test_reviews_of_probable_pairs(spark):
    cfg = replace(config(), profile=replace(config().profile, probable=0.8, possible=0.5))
    day = dt.date(1980, 1, 2)
    rows = [("c", str(i), "SMITH", "ALEX", day, "0111", None) for i in range(3)]
    got = upsert(reg.Registry(spark), rows_of(spark, rows), cfg, F.to_timestamp(F.lit("2024-02-01")))
    assert got.reviews.count() == 3
    assert {r["required_approvals"] for r in got.reviews.collect()} == {2}


def test_receipts(spark):
    cfg = config()
    day = dt.date(1980, 1, 2)
    rows = rows_of(spark, [("a", str(i), "SMITH", "ALEX", day, f"0{i}", None) for i in range(4)])
    keyed = rows.withColumn("idempotency_key", F.when(F.col("local_id") < "3", "k1").otherwise("k2"))
    keyed = keyed.withColumn("payload_digest", F.when(F.col("local_id") == "2", "d2").otherwise("d1"))
    now = F.to_timestamp(F.lit("2024-02-01"))
    first = upsert(reg.Registry(spark), keyed, cfg, now)
    status = {r["local_id"]: r["status"] for r in first.results.collect()}
    assert status == {"0": "accepted", "1": "replayed", "2": "idempotency-conflict", "3": "accepted"}
    again = upsert(first.registry, keyed, cfg, now)
    assert again.counters["accepted"] == 0 and again.counters["replayed"] == 3


def test_expected_versions(spark):
    """A stale change is refused with the repeats of its key; it counts for no later version."""
    cfg = config()
    day = dt.date(1980, 1, 2)
    wanted = [(0, "k0"), (1, "k1"), (1, "k2"), (1, "k2"), (2, "k3"), (3, "k4"), (3, "k5"), (None, "k6")]
    rows = rows_of(spark, [("a", "1", "SMITH", f"N{i}", day, "01", None) for i in range(len(wanted))])
    asked = spark.createDataFrame([(f"N{i}", e, k) for i, (e, k) in enumerate(wanted)], "g string, expected_version int, idempotency_key string")
    rows = rows.withColumn("g", F.col("profile.names")[0]["given"][0]).join(asked, "g").withColumn("payload_digest", F.lit("d"))
    now = F.to_timestamp(F.lit("2024-02-01"))
    done = upsert(reg.Registry(spark), rows, cfg, now)
    statuses = {r["idempotency_key"]: set() for r in done.results.collect()}
    for r in done.results.collect():
        statuses[r["idempotency_key"]].add(r["status"])
    held = {"k0", "k1", "k3", "k4", "k6"}
    assert statuses == {k: {"accepted"} if k in held else {"version-conflict"} for k in statuses}
    assert done.counters["version_conflicts"] == 3 and done.counters["accepted"] == 5
    assert [r["version"] for r in done.registry["source_patients"].collect()] == [5]
    assert {r["idempotency_key"] for r in done.registry["receipts"].collect()} == held


def test_other_tenant_fails(spark):
    rows = rows_of(spark, [("a", "1", "SMITH", "ALEX", dt.date(1980, 1, 2), None, None)])
    with pytest.raises(Exception, match="another tenant"):
        upsert(reg.Registry(spark), rows.withColumn("tenant_id", F.lit("t2")), config(),
               F.to_timestamp(F.lit("2024-02-01")))
