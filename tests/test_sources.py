import json

import pytest
from pyspark.sql import functions as F

from kinweave.sources import export, feed, fhir, hl7, labels
from kinweave.config import NHS_SYSTEM


def message(trigger="A28", version="2.5.1", pid=None, mrg=None, control="C1"):
    lines = [
        f"MSH|^~\\&|APP|FAC|MPI|X|20240101||ADT^{trigger}|{control}|P|{version}",
        pid or "PID|1||L1^^^HOSP^MR~9434765919^^^NHS^NH||Smith\\T\\Co^Alex^B^Jr^Dr^^L||19800102|F|||"
        "1 High Street^Flat 2^Leeds^WY^LS1 1AA^GB^H||0113 4960000~^NET^Internet^a@b.org|"
        "^WPN^PH^^^0113^4961111||||||||||||||||Y",
    ]
    if mrg:
        lines.append(mrg)
    return "\r".join(lines) + "\r"


def parse(spark, *texts):
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(texts)], "n int, message string")
    return {r["n"]: r for r in hl7.parse_adt(rows, "hosp").collect()}


def test_adt_fields(spark):
    r = parse(spark, message())[0]
    assert r["error"] is None
    p = r["profile"]
    assert [i["system"] for i in p["identifiers"]] == ["urn:kinweave:hl7v2:HOSP", NHS_SYSTEM]
    assert [i["is_verified"] for i in p["identifiers"]] == [False, True]
    assert p["names"][0]["family"] == "Smith&Co" and p["names"][0]["given"] == ["Alex", "B"]
    assert p["names"][0]["use"] == "Official" and p["names"][0]["prefix"] == "Dr"
    assert str(p["birth_date"]) == "1980-01-02" and p["gender"] == "Female" and p["is_deceased"]
    assert p["addresses"][0]["lines"] == ["1 High Street", "Flat 2"]
    assert p["addresses"][0]["use"] == "Home"
    assert [(t["system"], t["value"], t["use"]) for t in p["telecoms"]] == [
        ("Phone", "0113 4960000", None), ("Email", "a@b.org", "NET"), ("Phone", "01134961111", "WPN"),
    ]
    assert r["local_id"] == "L1" and r["previous_local_id"] is None


@pytest.mark.parametrize("version", ["2.3.1", "2.4", "2.5.1"])
def test_adt_versions_and_triggers(spark, version):
    texts = [message(t, version, mrg="MRG|OLD1^^^HOSP^MR") for t in hl7.TRIGGERS]
    parsed = parse(spark, *texts)
    assert all(r["error"] is None for r in parsed.values())
    assert [parsed[i]["previous_local_id"] for i in range(7)] == [None] * 5 + ["OLD1"] * 2


def test_adt_rejections_and_escapes(spark):
    parsed = parse(
        spark,
        message(version="2.7"), message("A02"), message("A40"), "PID|1", message(pid="PID|1||"),
        message(pid="PID|1||L1||A||1980"), message(pid="PID|1||L1||A\\Q\\^B||19800101"),
        message(pid="PID|1||L1||A\\XC3A9\\B\\.br\\^B\\F\\C||198001021200"),
        "MSH#*!?%#A#B###20240101##ADT*A28#C9#P#2.4\nPID#1##L2*x!L3##O?S?Neil*Bob",
        message() + "PIDX|bad",
    )
    errors = [parsed[i]["error"] for i in range(10)]
    assert errors[0] == "Unread HL7 version: 2.7"
    assert errors[1] == "Unread message type: ADT^A02"
    assert errors[2] == "No patient identifier in MRG-1."
    assert errors[3].startswith("The message must begin")
    assert errors[4] == "No patient identifier in PID-3."
    assert errors[5] == "PID-7 is no date of birth."
    assert "escape" in errors[6]
    assert errors[7] is None and parsed[7]["profile"]["names"][0]["family"] == "AéB\n"
    assert parsed[7]["profile"]["names"][0]["given"] == ["B|C"]
    assert errors[8] is None and parsed[8]["profile"]["names"][0]["family"] == "O*Neil"
    assert parsed[8]["local_id"] == "L2" and len(parsed[8]["profile"]["identifiers"]) == 2
    assert "three characters" in errors[9]


def test_acks(spark):
    rows = spark.createDataFrame(
        [("AA", "Message committed.", "C|1", "2.4", "A28"), ("AR", "x^y", None, None, None)],
        "ack_code string, diagnostic string, control_id string, version string, trigger string",
    ).withColumns({
        "sending_app": F.lit("A&B"), "sending_facility": F.lit("F"), "payload_digest": F.lit("d"),
    })
    acks = [r["ack"].split("\r") for r in hl7.adt_acks(rows, F.to_timestamp(F.lit("2024-01-01"))).collect()]
    assert acks[0][0].startswith("MSH|^~\\&|KINWEAVE|MPI|A\\T\\B|F|20240101000000+0000||ACK^A28|")
    assert acks[0][0].endswith("|P|2.4") and acks[0][1] == "MSA|AA|C\\F\\1|Message committed."
    assert acks[0][2].startswith("ERR|||0^") and acks[1][1] == "MSA|AR|UNKNOWN|x\\S\\y"
    assert acks[1][2].startswith("ERR|||200^Application internal error^HL70357|E|||")


def test_mllp_capture(spark, tmp_path):
    body = message().encode()
    data = b"noise\x0b" + body + b"\x1c\r" + b"\x0bABC\x1cX" + b"\x0b" + "é".encode() + b"\x1c\r\x0bopen"
    (tmp_path / "cap.bin").write_bytes(data)
    good, bad = hl7.read_mllp_capture(spark, str(tmp_path))
    assert {r["position"]: r["message"] for r in good.collect()} == {1: message(), 3: "é"}
    assert {r["position"]: r["problem"] for r in bad.collect()} == {
        2: "end-block-without-carriage-return", 4: "unterminated-frame"}


PATIENT = {
    "resourceType": "Patient", "id": "p1",
    "meta": {"versionId": "3", "lastUpdated": "2024-01-02T03:04:05Z",
             "tag": [{"code": "traced"}, {"code": "traced"}, {"system": "s"}]},
    "identifier": [
        {"system": NHS_SYSTEM, "value": "9434765919", "use": "official",
         "extension": [{"url": fhir.VERIFIED_EXTENSION, "valueBoolean": True}]},
        {"value": "nosystem"}],
    "name": [{"use": "official", "family": "Smith", "given": ["Alex", " "], "prefix": ["Dr", "Prof"]}],
    "telecom": [{"system": "phone", "value": "0113"}, {"system": "email", "value": ""}],
    "gender": "female", "birthDate": "1980-01-02", "deceasedBoolean": True,
    "address": [{"use": "home", "line": ["1 High Street", ""], "city": "Leeds", "postalCode": "LS1 1AA"}],
}


def test_fhir_json_and_bundle(spark):
    bundle = {"resourceType": "Bundle", "type": "searchset", "entry": [
        {"search": {"mode": "match"}, "resource": {**PATIENT, "id": "p2", "birthDate": "1980"}},
        {"search": {"mode": "include"}, "resource": {**PATIENT, "id": "p3"}}]}
    rows = spark.createDataFrame([(json.dumps(PATIENT),), (json.dumps(bundle),)], "value string")
    got = {r["resource_id"]: r for r in fhir.parse_json(rows).collect()}
    assert set(got) == {"p1", "p2"}
    p = got["p1"]["profile"]
    assert len(p["identifiers"]) == 1 and not p["identifiers"][0]["is_verified"]
    assert p["names"][0]["given"] == ["Alex"] and p["names"][0]["prefix"] == "Dr Prof"
    assert len(p["telecoms"]) == 1 and p["gender"] == "Female" and p["is_deceased"]
    assert [t["code"] for t in p["tags"]] == ["traced"]
    assert got["p2"]["profile"]["birth_date"] is None
    trusted = fhir.parse_json(rows, trusted=True).where("resource_id = 'p1'").first()["profile"]
    assert trusted["identifiers"][0]["is_verified"]


def test_fhir_xml(spark, tmp_path):
    xml = (
        '<Patient xmlns="http://hl7.org/fhir"><id value="x1"/><identifier>'
        f'<system value="{NHS_SYSTEM}"/><value value="9434765919"/></identifier>'
        '<name><family value="Smith"/><given value="Alex"/><given value="B"/></name>'
        '<gender value="male"/><birthDate value="1980-01-02"/></Patient>'
    )
    (tmp_path / "p.xml").write_text(f"<all>{xml}</all>")
    r = fhir.read_fhir_patients(spark, str(tmp_path), "xml").first()
    assert r["resource_id"] == "x1" and r["profile"]["names"][0]["given"] == ["Alex", "B"]
    assert str(r["profile"]["birth_date"]) == "1980-01-02" and r["profile"]["gender"] == "Male"
    assert r["profile"]["identifiers"][0]["value"] == "9434765919" and r["profile"]["tags"] == []


def test_validation(spark):
    rows = spark.createDataFrame([
        (json.dumps({"resourceType": "Patient", "id": "a", "birthDate": "1980",
                     "identifier": [{"system": NHS_SYSTEM, "value": "9434765918"}]}),),
        (json.dumps({"resourceType": "Patient", "id": "b"}),),
        (json.dumps({"resourceType": "Patient", "id": "c", "name": [{"family": "Smith"}]}),),
    ], "value string")
    clean, issues = fhir.split_valid(fhir.parse_json(rows), for_match=True)
    assert sorted((r["resource_id"], r["code"]) for r in issues.collect()) == [
        ("a", "value"), ("a", "value"), ("b", "required")]
    assert [r["resource_id"] for r in clean.collect()] == ["c"]


def test_labels(spark):
    text = "﻿leftSource\tleftId\trightSource\trightId\tlabel\r\n\na\t1\tb\t2\tmatch\r\na\t1\tb\t3\t0\nbad\n"
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "value string")
    good, bad = labels.parse_labels(lines)
    assert sorted(r["is_match"] for r in good.collect()) == [False, True] and bad.count() == 1


def test_feed_window(spark):
    rows = spark.createDataFrame([(json.dumps({**PATIENT, "id": f"p{d}", "meta": {
        **({"lastUpdated": f"2024-01-0{d}T00:00:00Z"} if d < 5 else {})}}),) for d in range(1, 6)],
        "value string")
    got = feed.read_changes(fhir.parse_json(rows), "2024-01-02", "2024-01-04", NHS_SYSTEM).collect()
    assert sorted(r["resource_id"] for r in got) == ["p2", "p3", "p4", "p5"]
    assert all(r["local_id"] == "9434765919" and r["problem"] is None for r in got)
    p2 = next(r for r in got if r["resource_id"] == "p2")
    assert p2["source_version"].startswith("2024-01-02T00:00:00.0000000+00:00-")


def test_export_round_trip(spark):
    rows = spark.createDataFrame([(json.dumps(PATIENT),)], "value string")
    parsed = fhir.parse_json(rows, trusted=True)
    source = parsed.select(
        F.lit("t").alias("tenant_id"), F.lit("crm").alias("source_system"), "resource_id",
        F.lit("e1").alias("enterprise_id"), "profile", F.lit(2).alias("version"), "last_updated")
    back = fhir.parse_json(export.to_fhir_patients(source, "source"), trusted=True).first()
    first, again = parsed.first()["profile"], back["profile"]
    assert again["identifiers"][:1] == first["identifiers"] and len(again["identifiers"]) == 2
    assert again["names"] == first["names"] and again["addresses"] == first["addresses"]
    canonical = source.withColumns({"is_active": F.lit(False), "replaced_by": F.lit("e2")})
    doc = json.loads(export.to_fhir_patients(canonical).first()["value"])
    assert doc["link"][0]["other"]["reference"] == "Patient/e2" and doc["active"] is False
    assert doc["identifier"][0]["use"] == "official" and doc["identifier"][0]["value"] == "e1"
    numbers = spark.createDataFrame([(0.9,), (0.0,), (1.0,), (0.12345,), (-1.5,), (10.0,)], "x double")
    assert [r[0] for r in numbers.select(export.short_number(F.col("x"))).collect()] == [
        "0.9", "0", "1", "0.123", "-1.5", "10"]
