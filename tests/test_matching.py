"""Candidate generation against brute force, and scoring of fixed pairs."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinweave.config import NHS_SYSTEM, Comparators, Lexicon, MatchingProfile
from kinweave.operators import blocking, compare, matching, normalise, scoring
from kinweave.schemas import PROFILE
from kinweave.sources import derived


def index_of(spark, rows):
    return spark.createDataFrame(
        [("t", "v1", k, i) for i, keys in rows.items() for k in keys],
        "tenant_id string, key_version string, key_value string, enterprise_id string")


@pytest.mark.parametrize("seed,hot", [(1, False), (2, False), (3, True)])
def test_self_candidates_brute_force(spark, seed, hot):
    r = random.Random(seed)
    rows = {f"p{i:03}": {f"k{r.randrange(25)}" for _ in range(r.randrange(1, 4))} for i in range(60)}
    if hot:  # one key holds a third of all rows
        for i in range(0, 60, 3):
            rows[f"p{i:03}"].add("hot")
    for cap in (4, 8, 12):
        near = {a: {b for b in rows if rows[a] & rows[b]} for a in rows}
        refused = {a for a in rows if len(near[a]) > cap}
        wanted = {(a, b) for a in rows for b in near[a] if a < b and a not in refused}
        pairs, rejected = blocking.self_candidates(index_of(spark, rows), cap)
        assert {(x["subject_id"], x["candidate_id"]) for x in pairs.collect()} == wanted
        assert sorted(x["subject_id"] for x in rejected.collect()) == sorted(refused)


def test_query_candidates_brute_force(spark):
    r = random.Random(5)
    rows = {f"p{i:03}": {f"k{r.randrange(12)}" for _ in range(3)} for i in range(40)}
    asked = {f"q{i}": {f"k{r.randrange(12)}" for _ in range(2)} for i in range(30)}
    keys = index_of(spark, asked).withColumnRenamed("enterprise_id", "query_id")
    for cap in (9, 14, 18):
        near = {q: {b for b in rows if asked[q] & rows[b]} for q in asked}
        pairs, refused = blocking.candidates(keys, index_of(spark, rows), cap)
        got = pairs.collect()
        assert {(x["query_id"], x["candidate_id"]) for x in got} == {
            (q, b) for q in asked for b in near[q] if len(near[q]) <= cap}
        assert all(x["candidate_count"] == len(near[x["query_id"]]) for x in got)
        assert {x["query_id"] for x in refused.collect()} == {q for q in asked if len(near[q]) > cap}


def profile(family="Smith", given="Alex", dob=dt.date(1980, 1, 2), phone="0113 496 0000", nhs=None,
            verified=True, line="1 High Street", postcode="LS1 1AA", gender="Male"):
    return (
        [(NHS_SYSTEM, nhs, verified, verified, None)] if nhs else [],
        [(family, [given] if given else [], "Official", None, None)], dob, gender,
        [([line], "Leeds", None, postcode, "GB", "Home")] if line else [],
        [("Phone", phone, None)] if phone else [], False, [])


def pair(spark, left, right, rules=MatchingProfile()):
    df = spark.createDataFrame([(left, right)], f"l {PROFILE}, r {PROFILE}")
    a = normalise.normalise(df.withColumnRenamed("l", "profile")).withColumnRenamed("norm", "left_norm")
    b = normalise.normalise(a.drop("profile").withColumnRenamed("r", "profile")).withColumnRenamed(
        "norm", "right_norm")
    return scoring.score(compare.compare(b, rules), rules).first()


def test_scores_and_grades(spark):
    same = pair(spark, profile(), profile())
    assert same["score"] == pytest.approx(1) and same["grade"] == "Probable"
    assert [e["field"] for e in same["evidence"]] == [
        "family", "given", "birthDate", "address", "telecom", "gender"]
    # Exactly on the threshold: 0.25 + 0.2 + 0.3 + 0 + 0.07 + 0 reaches 0.82.
    edge = pair(spark, profile(line=None, gender="Unknown"), profile(line=None, gender="Unknown"))
    assert edge["score"] == 0.8200000000000001 and edge["grade"] == "Probable"
    swapped = pair(spark, profile(dob=dt.date(1980, 2, 1)), profile())
    assert swapped["evidence"][2]["similarity"] == 0.5
    assert swapped["evidence"][2]["comparator"] == "day-month-transposition"
    bare = pair(spark, profile(None, None, None, None, None, line=None, gender="Unknown"), profile())
    assert bare["score"] == 0 and all(e["is_missing"] for e in bare["evidence"])
    assert [e["comparator"] for e in bare["evidence"]][:2] == ["none", "configured-string-library"]


def test_identifiers(spark):
    certain = pair(spark, profile(nhs="9434765919"), profile("Other", nhs="943 476 5919"))
    assert certain["grade"] == "Certain" and not certain["has_hard_conflict"]
    dob = pair(spark, profile(nhs="9434765919"), profile(nhs="9434765919", dob=dt.date(1981, 1, 2)))
    assert dob["has_hard_conflict"] and dob["grade"] != "Certain"
    clash = pair(spark, profile(nhs="9434765919"), profile(nhs="9999999999"))
    assert clash["has_hard_conflict"] and clash["grade"] == "Probable"
    loose = pair(spark, profile(nhs="9434765919", verified=False), profile(nhs="9434765919"))
    assert loose["grade"] == "Probable" and not loose["is_certain"]


def test_nickname_phonetic_and_many_names(spark):
    lexicon = Lexicon.of("en-gb-reviewed-2026", "en-GB", {"ROBERT": "R", "BOB": "R"})
    rules = replace(MatchingProfile(), comparators=Comparators(
        family=("NormalisedDamerauLevenshtein", "DiceCoefficient", "Phonetic"),
        given=("Exact", "Nickname"), lexicons=(lexicon,)))
    got = pair(spark, profile("Smith", "Robert"), profile("Smyth", "Bob"), rules)["evidence"]
    assert got[1]["similarity"] == 0.92 and got[1]["detail"] == "en-GB/en-gb-reviewed-2026"
    assert got[0]["similarity"] == 0.85 and got[0]["detail"] == "shared-code:SM0"
    left = list(profile())
    left[1] = [("Jones", ["Sam"], "Old", None, None), (None, ["Alexa", "Al"], "Usual", None, None),
               ("Smith", [], "Official", None, None)]
    left[4] = [(["9 Low Road"], "York", None, "YO1 1AA", None, "Home"), (["x"], None, None, "LS1 1ZZ", None, "Home")]
    got = pair(spark, tuple(left), profile())["evidence"]
    assert got[0]["similarity"] == 1 and got[0]["comparator"] == "jaro-winkler"
    assert got[1]["similarity"] == pytest.approx(0.96) and got[3]["similarity"] == 0.6
    assert got[3]["comparator"] == "postcode-sector"


def test_fellegi_sunter(spark):
    import math

    from kinweave.queries import MODEL

    rules = replace(MatchingProfile(), model=MODEL)
    got = pair(spark, profile(line=None), profile(line=None, gender="Female"), rules)
    ratio = {"Exact": math.log(0.8) - math.log(0.05), "Different": math.log(0.04) - math.log(0.7)}
    odds = math.log(0.02 / 0.98) + 4 * ratio["Exact"] + ratio["Different"]
    assert got["score"] == pytest.approx(1 / (1 + math.exp(-odds)))
    assert got["evidence"][3]["log_likelihood_ratio"] == 0.0 and got["score_method"] == "fellegi-sunter"


def test_authority(spark):
    cfg = derived.demo_config()
    def tagged(codes, nhs="9434765919"):
        p = list(profile(nhs=nhs))
        p[7] = [(None, code, None) for code in codes]
        return tuple(p)
    rows = [("crm", tagged(["TRACED", "Gold"])), ("crm", tagged(["traced"])),
            ("billing", tagged(["traced", "gold"])), ("crm", tagged(["traced", "gold"], "9434765918"))]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)],
                               f"i int, source_system string, profile {PROFILE}")
    got = normalise.apply_authority(df, cfg).orderBy("i").select("profile.identifiers").collect()
    assert [x[0][0]["is_verified"] for x in got] == [True, False, False, False]


def test_blocking_rules(spark):
    cfg = derived.demo_config()
    rules = cfg.profile
    df = spark.createDataFrame([(profile(nhs="9434765919"),), (profile("Smith", dob=None, phone=None),)],
                               f"profile {PROFILE}")
    got = blocking.raw_blocking_keys(normalise.normalise(df), cfg).select("raw_keys").collect()
    assert got[0][0] == [f"ID|{NHS_SYSTEM}|9434765919", "FMDOB|SMITH|19800102", "PHDOB|SM0|19800102",
                         "PCDOB|LS11AA|19800102", "TEL|Phone|01134960000"]
    assert got[1][0] == []
    two = replace(cfg, secrets=cfg.secrets + (replace(cfg.secrets[0], version="v2", secret=b"2" * 32, is_active=False),))
    keyed = blocking.blocking_keys(normalise.normalise(df).withColumn("tenant_id", F.lit("t")), two)
    ok, bad = blocking.split_blockable(keyed)
    assert [len(x["blocking_keys"]) for x in ok.collect()] == [10] and bad.count() == 1
