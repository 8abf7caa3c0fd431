"""FHIR JSON exports: Patients, Persons and match Bundles, one resource per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.sources.fhir import AUTHORITATIVE_EXTENSION, VERIFIED_EXTENSION

ENTERPRISE_SYSTEM = "urn:kinweave:fhir:enterprise-id"
TENANT_SYSTEM = "urn:kinweave:fhir:tenant"
SOURCE_SYSTEM_EXTENSION = "urn:kinweave:fhir:source-system"
GRADE_EXTENSION = "urn:kinweave:fhir:match-grade"
METHOD_EXTENSION = "urn:kinweave:fhir:match-score-method"
EVIDENCE_EXTENSION = "urn:kinweave:fhir:match-evidence"
# Fixed value: the published UK Core Patient profile.
PATIENT_PROFILE = "https://fhir.hl7.org.uk/StructureDefinition/UKCore-Patient"


def _code(c: Column, default: str) -> Column:
    return F.when(c == "Unknown", default).otherwise(F.lower(c))


def _some(c: Column) -> Column:
    """Leave an empty list out of the JSON."""
    return F.when(F.size(c) > 0, c)


def _flag(url: str, value: Column) -> Column:
    return F.struct(F.lit(url).alias("url"), value.alias("valueBoolean"))


def _meta(profile: Column | None, with_profile: bool = True) -> Column:
    parts = [
        F.col("version").cast("string").alias("versionId"),
        F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("lastUpdated"),
    ]
    if with_profile:
        parts.append(F.array(F.lit(PATIENT_PROFILE)).alias("profile"))
    parts.append(
        F.array(F.struct(F.lit(TENANT_SYSTEM).alias("system"), F.col("tenant_id").alias("code")))
        .alias("security")
    )
    if profile is not None:
        parts.append(
            _some(F.array_distinct(F.filter(profile["tags"], lambda x: F.trim(x["code"]) != "")))
            .alias("tag")
        )
    return F.struct(*parts)


def _patient_fields(role: str) -> list[Column]:
    p = F.col("profile")
    own = F.transform(
        p["identifiers"],
        lambda x: F.struct(
            F.array(
                _flag(VERIFIED_EXTENSION, x["is_verified"]),
                _flag(AUTHORITATIVE_EXTENSION, x["is_authoritative"]),
            ).alias("extension"),
            F.lower(x["use"]).alias("use"), x["system"].alias("system"), x["value"].alias("value"),
        ),
    )
    enterprise = F.array(
        F.struct(
            F.lit(None).cast("array<struct<url:string,valueBoolean:boolean>>").alias("extension"),
            F.lit("official" if role == "canonical" else "secondary").alias("use"),
            F.lit(ENTERPRISE_SYSTEM).alias("system"), F.col("enterprise_id").alias("value"),
        )
    )
    identifiers = F.concat(enterprise, own) if role == "canonical" else F.concat(own, enterprise)
    names = F.transform(
        p["names"],
        lambda x: F.struct(
            _code(x["use"], "usual").alias("use"), x["family"].alias("family"),
            _some(x["given"]).alias("given"),
            F.when(x["prefix"].isNotNull(), F.array(x["prefix"])).alias("prefix"),
            F.when(x["suffix"].isNotNull(), F.array(x["suffix"])).alias("suffix"),
        ),
    )
    addresses = F.transform(
        p["addresses"],
        lambda x: F.struct(
            _code(x["use"], "home").alias("use"), _some(x["lines"]).alias("line"),
            x["city"].alias("city"), x["district"].alias("district"),
            x["postal_code"].alias("postalCode"), x["country"].alias("country"),
        ),
    )
    telecoms = F.transform(
        p["telecoms"],
        lambda x: F.struct(
            _code(x["system"], "other").alias("system"), x["value"].alias("value"),
            F.lower(x["use"]).alias("use"),
        ),
    )
    return [
        _some(identifiers).alias("identifier"),
        (F.col("is_active") if role == "canonical" else F.lit(True)).alias("active"),
        _some(names).alias("name"), _some(telecoms).alias("telecom"),
        F.lower(p["gender"]).alias("gender"),
        F.date_format(p["birth_date"], "yyyy-MM-dd").alias("birthDate"),
        F.when(p["is_deceased"], F.lit(True)).alias("deceasedBoolean"),
        _some(addresses).alias("address"),
    ]


def _extension(url: str, value: Column, field: str) -> Column:
    return F.struct(
        F.lit(url).alias("url"),
        *(
            (value if name == field else F.lit(None).cast("string")).alias(name)
            for name in ("valueString", "valueCode")
        ),
    )


def _resource(role: str, extensions: list[Column]) -> Column:
    identity = F.col("enterprise_id") if role == "canonical" else F.col("resource_id")
    parts = [
        F.lit("Patient").alias("resourceType"), identity.alias("id"),
        _meta(F.col("profile")).alias("meta"),
    ]
    if extensions:
        parts.append(F.array(*extensions).alias("extension"))
    parts += _patient_fields(role)
    if role == "canonical":
        link = F.struct(
            F.struct(F.concat(F.lit("Patient/"), F.col("replaced_by")).alias("reference")).alias("other"),
            F.lit("replaced-by").alias("type"),
        )
        parts.append(F.when(F.col("replaced_by").isNotNull(), F.array(link)).alias("link"))
    return F.struct(*parts)


def to_fhir_patients(df: DataFrame, role: str = "canonical") -> DataFrame:
    """Canonical or source rows as Patient JSON in ``value``."""
    extensions = (
        [] if role == "canonical"
        else [_extension(SOURCE_SYSTEM_EXTENSION, F.col("source_system"), "valueString")]
    )
    identity = "enterprise_id" if role == "canonical" else "resource_id"
    return df.select(
        "tenant_id", F.col(identity).alias("id"), F.to_json(_resource(role, extensions)).alias("value")
    )


def to_fhir_persons(persons: DataFrame, links: DataFrame) -> DataFrame:
    """Persons with their links; a retired person also links to its survivor at level 4."""
    gathered = links.groupBy("tenant_id", "enterprise_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("position", "source_system", "local_id", "source_resource_id", "assurance")
            )
        ).alias("_links")
    )
    joined = persons.join(gathered, ["tenant_id", "enterprise_id"], "left")

    def link(reference: Column, assurance: Column) -> Column:
        return F.struct(
            F.struct(reference.alias("reference")).alias("target"), assurance.alias("assurance")
        )

    own = F.transform(
        F.coalesce("_links", F.array().cast(dict(gathered.dtypes)["_links"])),
        lambda x: link(F.concat(F.lit("Patient/"), x["source_resource_id"]), F.lower(x["assurance"])),
    )
    survivor = F.when(
        F.col("replaced_by").isNotNull(),
        F.array(link(F.concat(F.lit("Person/"), F.col("replaced_by")), F.lit("level4"))),
    ).otherwise(F.array().cast(
        "array<struct<target:struct<reference:string>,assurance:string>>"))
    resource = F.struct(
        F.lit("Person").alias("resourceType"), F.col("enterprise_id").alias("id"),
        _meta(None, with_profile=False).alias("meta"),
        F.array(
            F.struct(F.lit(ENTERPRISE_SYSTEM).alias("system"), F.col("enterprise_id").alias("value"))
        ).alias("identifier"),
        F.col("is_active").alias("active"),
        _some(F.concat(own, survivor)).alias("link"),
    )
    return joined.select(
        "tenant_id", F.col("enterprise_id").alias("id"), F.to_json(resource).alias("value")
    )


def short_number(c: Column) -> Column:
    """At most three decimals, without trailing zeros."""
    text = F.format_string("%.3f", F.round(c, 3))
    return F.regexp_replace(F.regexp_replace(text, r"\.?0+$", ""), r"^-0$", "0")


def evidence_text(evidence: Column) -> Column:
    def one(x: Column) -> Column:
        ratio = F.when(
            x["log_likelihood_ratio"].isNotNull(),
            F.concat(F.lit(":llr="), short_number(x["log_likelihood_ratio"])),
        ).otherwise("")
        return F.concat(
            x["field"], F.lit(":"), short_number(x["similarity"]), F.lit(":"), x["comparator"],
            F.lit(":"), x["comparison_level"], ratio,
        )

    return F.array_join(F.transform(evidence, one), "; ")


def to_match_bundles(matches: DataFrame, canonical: DataFrame, now: Column) -> DataFrame:
    """One searchset Bundle per query, entries in rank order (at most the result cap)."""
    rows = matches.select(
        "tenant_id", "query_id", F.col("candidate_id").alias("enterprise_id"), "rank", "score",
        "grade", "score_method", "evidence",
    ).join(canonical, ["tenant_id", "enterprise_id"])
    resource = _resource(
        "canonical",
        [
            _extension(GRADE_EXTENSION, F.lower("grade"), "valueCode"),
            _extension(METHOD_EXTENSION, F.col("score_method"), "valueCode"),
            _extension(EVIDENCE_EXTENSION, evidence_text(F.col("evidence")), "valueString"),
        ],
    )
    entry = F.struct(
        F.concat(F.lit("Patient/"), F.col("enterprise_id")).alias("fullUrl"),
        resource.alias("resource"),
        F.struct(F.lit("match").alias("mode"), F.col("score")).alias("search"),
    )
    bundled = rows.groupBy("tenant_id", "query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("_entries")
    )
    bundle = F.struct(
        F.lit("Bundle").alias("resourceType"), F.lit("searchset").alias("type"),
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        F.size("_entries").alias("total"),
        F.transform("_entries", lambda e: e["entry"]).alias("entry"),
    )
    return bundled.select("tenant_id", "query_id", F.to_json(bundle).alias("value"))
