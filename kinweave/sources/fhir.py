"""FHIR R4 Patient resources (JSON or XML) to profiles, with validation issues as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import NHS_SYSTEM
from kinweave.functions import text as t
from kinweave.schemas import PROFILE

VERIFIED_EXTENSION = "urn:kinweave:fhir:identifier-verified"
AUTHORITATIVE_EXTENSION = "urn:kinweave:fhir:identifier-authoritative"

_EXTENSION = "array<struct<url:string,valueBoolean:boolean>>"
PATIENT = (
    "resourceType string, id string, "
    "meta struct<versionId:string,lastUpdated:string,"
    "tag:array<struct<system:string,code:string,display:string>>>, "
    f"identifier array<struct<use:string,system:string,value:string,extension:{_EXTENSION}>>, "
    "name array<struct<use:string,family:string,given:array<string>,prefix:array<string>,"
    "suffix:array<string>>>, "
    "telecom array<struct<system:string,value:string,use:string>>, gender string, "
    "birthDate string, deceasedBoolean boolean, "
    "address array<struct<use:string,line:array<string>,city:string,district:string,"
    "postalCode:string,country:string>>"
)
_RESOURCE = f"struct<{PATIENT.replace(' struct<', ':struct<').replace(' array<', ':array<').replace(' string', ':string').replace(' boolean', ':boolean')}>"

# FHIR code -> stored code.
_GENDER = {"male": "Male", "female": "Female", "other": "Other"}
_NAME_USE = {
    "usual": "Usual", "official": "Official", "temp": "Temp", "nickname": "Nickname",
    "anonymous": "Anonymous", "old": "Old", "maiden": "Maiden",
}
_ADDRESS_USE = {
    "home": "Home", "work": "Work", "temp": "Temp", "old": "Old", "billing": "Billing",
}
_TELECOM = {
    "phone": "Phone", "fax": "Fax", "email": "Email", "pager": "Pager", "url": "Url",
    "sms": "Sms", "other": "Other",
}


def code_map(c: Column, codes: dict[str, str], default: str | None = "Unknown") -> Column:
    made = F.lit(default).cast("string")
    for source, target in codes.items():
        made = F.when(c == source, target).otherwise(made)
    return made


def _items(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _words(c: Column) -> Column:
    return F.filter(_items(c, "array<string>"), lambda x: ~t.is_blank(x))


def _joined(c: Column) -> Column:
    made = F.array_join(_words(c), " ")
    return F.when(made != "", made)


def full_date(c: Column) -> Column:
    """The date, only when it is a complete ``yyyy-MM-dd``."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))


def _flag(item: Column, url: str) -> Column:
    first = F.get(
        F.filter(_items(item["extension"], _EXTENSION), lambda e: e["url"] == url), F.lit(0)
    )
    return F.coalesce(first["valueBoolean"], F.lit(False))


def patient_profile(r: Column, trusted: bool = False) -> Column:
    """Profile of a parsed Patient. Trust flags are believed only from our own store."""
    def identifier(x: Column) -> Column:
        return F.struct(
            x["system"].alias("system"),
            x["value"].alias("value"),
            (_flag(x, VERIFIED_EXTENSION) if trusted else F.lit(False)).alias("is_verified"),
            (_flag(x, AUTHORITATIVE_EXTENSION) if trusted else F.lit(False)).alias(
                "is_authoritative"
            ),
            F.lower(x["use"]).alias("use"),
        )

    def name(x: Column) -> Column:
        return F.struct(
            x["family"].alias("family"), _words(x["given"]).alias("given"),
            code_map(x["use"], _NAME_USE).alias("use"), _joined(x["prefix"]).alias("prefix"),
            _joined(x["suffix"]).alias("suffix"),
        )

    def address(x: Column) -> Column:
        return F.struct(
            _words(x["line"]).alias("lines"), x["city"].alias("city"),
            x["district"].alias("district"), x["postalCode"].alias("postal_code"),
            x["country"].alias("country"), code_map(x["use"], _ADDRESS_USE).alias("use"),
        )

    def telecom(x: Column) -> Column:
        return F.struct(
            code_map(x["system"], _TELECOM).alias("system"), x["value"].alias("value"),
            F.lower(x["use"]).alias("use"),
        )

    return F.struct(
        F.transform(
            F.filter(r["identifier"], lambda x: ~t.is_blank(x["system"]) & ~t.is_blank(x["value"])),
            identifier,
        ).alias("identifiers"),
        F.transform(r["name"], name).alias("names"),
        full_date(r["birthDate"]).alias("birth_date"),
        code_map(r["gender"], _GENDER).alias("gender"),
        F.transform(r["address"], address).alias("addresses"),
        F.transform(F.filter(r["telecom"], lambda x: ~t.is_blank(x["value"])), telecom).alias(
            "telecoms"
        ),
        F.coalesce(r["deceasedBoolean"], F.lit(False)).alias("is_deceased"),
        F.array_distinct(F.filter(r["meta"]["tag"], lambda x: ~t.is_blank(x["code"]))).alias("tags"),
    )


def _complete(profile: Column) -> Column:
    """Empty lists instead of nulls, in the table's types."""
    made = profile.cast(PROFILE)
    for name, kind in (
        ("identifiers", "identifiers"), ("names", "names"), ("addresses", "addresses"),
        ("telecoms", "telecoms"), ("tags", "tags"),
    ):
        made = made.withField(kind, F.coalesce(made[name], F.expr("array()")))
    return made.cast(PROFILE)


def parse_json(rows: DataFrame, trusted: bool = False) -> DataFrame:
    """(value) rows, a Patient or a searchset Bundle each, to one row per Patient."""
    wrapper = f"{PATIENT}, entry array<struct<search:struct<mode:string>,resource:{_RESOURCE}>>"
    parsed = rows.select(F.col("value"), F.from_json("value", wrapper).alias("doc"))
    alone = F.array(F.struct(*(F.col("doc")[n] for n in _names())))
    within = F.transform(
        F.filter(
            F.col("doc.entry"),
            lambda e: e["search"]["mode"].isNull() | (e["search"]["mode"] == "match"),
        ),
        lambda e: e["resource"],
    )
    resources = F.when(F.col("doc.resourceType") == "Bundle", within).otherwise(alone)
    # A Bundle row would repeat its whole text per entry, so only single resources keep theirs.
    exploded = parsed.select(
        F.when(F.col("doc.resourceType") != "Bundle", F.col("value")).alias("value"),
        F.explode(resources).alias("resource"),
    ).where(F.col("resource.resourceType") == "Patient")
    return _projected(exploded, trusted)


def _names() -> list[str]:
    return [
        "resourceType", "id", "meta", "identifier", "name", "telecom", "gender", "birthDate",
        "deceasedBoolean", "address",
    ]


def _projected(exploded: DataFrame, trusted: bool) -> DataFrame:
    r = F.col("resource")
    return exploded.select(
        r["id"].alias("resource_id"),
        r["meta"]["versionId"].alias("version_id"),
        F.to_timestamp(r["meta"]["lastUpdated"]).alias("last_updated"),
        _complete(patient_profile(r, trusted)).alias("profile"),
        F.lower(F.sha2(F.encode(F.coalesce("value", F.to_json("resource")), "UTF-8"), 256)).alias(
            "payload_digest"
        ),
        "resource",
    )


_V = "struct<_value:string>"
_XML_EXTENSION = "array<struct<_url:string,valueBoolean:struct<_value:boolean>>>"
XML_PATIENT = (
    f"id {_V}, meta struct<versionId:{_V},lastUpdated:{_V},"
    f"tag:array<struct<system:{_V},code:{_V},display:{_V}>>>, "
    f"identifier array<struct<use:{_V},system:{_V},value:{_V},extension:{_XML_EXTENSION}>>, "
    f"name array<struct<use:{_V},family:{_V},given:array<{_V}>,prefix:array<{_V}>,"
    f"suffix:array<{_V}>>>, telecom array<struct<system:{_V},value:{_V},use:{_V}>>, gender {_V}, "
    f"birthDate {_V}, deceasedBoolean struct<_value:boolean>, "
    f"address array<struct<use:{_V},line:array<{_V}>,city:{_V},district:{_V},postalCode:{_V},"
    f"country:{_V}>>"
)


def _value_of(c: Column) -> Column:
    return c["_value"]


def parse_xml(rows: DataFrame, trusted: bool = False) -> DataFrame:
    """Rows of ``XML_PATIENT`` columns, as the XML source reads them, to one row per Patient."""
    def values(c: Column) -> Column:
        return F.transform(c, _value_of)

    def coding(x: Column) -> Column:
        return F.struct(*(_value_of(x[n]).alias(n) for n in ("system", "code", "display")))

    def extension(x: Column) -> Column:
        return F.struct(x["_url"].alias("url"), x["valueBoolean"]["_value"].alias("valueBoolean"))

    def identifier(x: Column) -> Column:
        return F.struct(
            *(_value_of(x[n]).alias(n) for n in ("use", "system", "value")),
            F.transform(x["extension"], extension).alias("extension"),
        )

    def name(x: Column) -> Column:
        return F.struct(
            *(_value_of(x[n]).alias(n) for n in ("use", "family")),
            *(values(x[n]).alias(n) for n in ("given", "prefix", "suffix")),
        )

    def address(x: Column) -> Column:
        return F.struct(
            _value_of(x["use"]).alias("use"), values(x["line"]).alias("line"),
            *(_value_of(x[n]).alias(n) for n in ("city", "district", "postalCode", "country")),
        )

    def telecom(x: Column) -> Column:
        return F.struct(*(_value_of(x[n]).alias(n) for n in ("system", "value", "use")))

    c = F.col
    resource = F.struct(
        F.lit("Patient").alias("resourceType"), c("id._value").alias("id"),
        F.struct(
            c("meta.versionId._value").alias("versionId"),
            c("meta.lastUpdated._value").alias("lastUpdated"),
            F.transform("meta.tag", coding).alias("tag"),
        ).alias("meta"),
        F.transform("identifier", identifier).alias("identifier"),
        F.transform("name", name).alias("name"), F.transform("telecom", telecom).alias("telecom"),
        c("gender._value").alias("gender"), c("birthDate._value").alias("birthDate"),
        c("deceasedBoolean._value").alias("deceasedBoolean"),
        F.transform("address", address).alias("address"),
    )
    return _projected(
        rows.select(F.lit(None).cast("string").alias("value"), resource.alias("resource")), trusted
    )


def read_fhir_patients(
    spark: SparkSession, path: str, fmt: str = "json", trusted: bool = False
) -> DataFrame:
    """Patients from files: one JSON resource or Bundle per line, or XML ``Patient`` elements."""
    if fmt == "json":
        return parse_json(spark.read.text(path), trusted)
    if fmt == "xml":
        rows = (
            spark.read.format("xml").option("rowTag", "Patient").option("valueTag", "_text")
            .option("ignoreNamespace", "true").schema(XML_PATIENT).load(path)
        )
        return parse_xml(rows, trusted)
    raise ValueError(f"unknown FHIR format {fmt!r}")


def validate_patients(parsed: DataFrame, for_match: bool = False) -> DataFrame:
    """One row per issue of a parsed Patient (severity, code, expression, text)."""
    r = F.col("resource")

    def issue(when: Column, code: str, expression: str, message: str) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit("error").alias("severity"), F.lit(code).alias("code"),
                F.lit(expression).alias("expression"), F.lit(message).alias("text"),
            ),
        )

    # One issue per bad NHS number.
    bad_numbers = F.transform(
        F.filter(
            r["identifier"], lambda x: (x["system"] == NHS_SYSTEM) & ~t.nhs_valid(x["value"])
        ),
        lambda x: F.struct(
            F.lit("error").alias("severity"), F.lit("value").alias("code"),
            F.lit("Patient.identifier").alias("expression"),
            F.lit("The NHS number fails its modulus-11 check digit.").alias("text"),
        ),
    )
    date_given = ~t.is_blank(r["birthDate"])
    others = [
        issue(
            date_given & full_date(r["birthDate"]).isNull(), "value", "Patient.birthDate",
            "The birth date must be a complete calendar date.",
        )
    ]
    if for_match:
        nothing = (
            ~_some(r["identifier"], lambda x: ~t.is_blank(x["value"]))
            & ~_some(
                r["name"],
                lambda x: ~t.is_blank(x["family"]) | (F.size(_words(x["given"])) > 0),
            )
            & ~date_given
            & ~_some(r["telecom"], lambda x: ~t.is_blank(x["value"]))
        )
        others.append(
            issue(
                nothing, "required", "Patient",
                "Matching needs an identifier, a name, a birth date or a telecom value.",
            )
        )
    found = F.concat(
        F.coalesce(
            bad_numbers,
            F.array().cast("array<struct<severity:string,code:string,expression:string,text:string>>"),
        ),
        F.filter(F.array(*others), lambda x: x.isNotNull()),
    )
    return parsed.select("resource_id", F.explode(found).alias("_issue")).select(
        "resource_id", "_issue.*"
    )


def _some(c: Column, f) -> Column:
    return F.coalesce(F.exists(c, f), F.lit(False))


def split_valid(parsed: DataFrame, for_match: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clean Patients and the issues of the others."""
    issues = validate_patients(parsed, for_match)
    return parsed.join(issues.select("resource_id").distinct(), "resource_id", "left_anti"), issues
