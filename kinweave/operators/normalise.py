"""Profile standardisation: identifier authority and the ``norm`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.config import GOLD_TAG, NHS_SYSTEM, TRACED_TAG, MatchingProfile, TenantConfig
from kinweave.functions import text as t
from kinweave.functions.lists import distinct
from kinweave.functions.once import computed_once


def _has_tag(tags: Column, code: str) -> Column:
    return F.coalesce(F.exists(tags, lambda tag: F.lower(tag["code"]) == code), F.lit(False))


def authority_column(
    profile: Column, rules: MatchingProfile, source_is_authoritative: Column
) -> Column:
    """Profile with both trust flags of every identifier set by policy, whatever they said before."""
    vouched = _has_tag(profile["tags"], TRACED_TAG) & _has_tag(profile["tags"], GOLD_TAG)
    systems = list(rules.identifier_systems)

    def one(item: Column) -> Column:
        nhs_ok = (item["system"] != NHS_SYSTEM) | (t.nhs_valid(item["value"]) & vouched)
        trusted = F.coalesce(
            source_is_authoritative & item["system"].isin(systems) & nhs_ok, F.lit(False)
        )
        return F.struct(
            item["system"].alias("system"),
            item["value"].alias("value"),
            trusted.alias("is_verified"),
            trusted.alias("is_authoritative"),
            item["use"].alias("use"),
        )

    return profile.withField("identifiers", F.transform(profile["identifiers"], one))


def apply_authority(
    df: DataFrame, cfg: TenantConfig, as_authoritative: bool = False
) -> DataFrame:
    """Apply the source policy to ``profile``; a match query counts as authoritative."""
    if as_authoritative:
        authoritative = F.lit(True)
    else:
        authoritative = F.col("source_system").isin(list(cfg.authoritative_sources))
    return df.withColumn(
        "profile", authority_column(F.col("profile"), cfg.profile, authoritative)
    )


def norm_identifiers(c: Column) -> Column:
    kept = F.filter(c, lambda x: ~t.is_blank(x["system"]) & ~t.is_blank(x["value"]))

    def one(x: Column) -> Column:
        value = F.when(x["system"] == NHS_SYSTEM, t.digits(x["value"])).otherwise(
            t.trim(x["value"])
        )
        return F.struct(
            t.trim(x["system"]).alias("system"),
            value.alias("value"),
            x["is_verified"].alias("is_verified"),
            x["is_authoritative"].alias("is_authoritative"),
            x["use"].alias("use"),
        )

    return distinct(F.transform(kept, one))


def norm_names(c: Column) -> Column:
    def words(x: Column) -> Column:
        given = F.filter(F.transform(x["given"], t.norm_words), lambda g: g != "")
        return F.struct(
            t.norm_words(x["family"]).alias("family"),
            F.coalesce(given, F.array().cast("array<string>")).alias("given"),
        )

    kept = F.filter(F.transform(c, words), lambda x: (x["family"] != "") | (F.size(x["given"]) > 0))
    return F.transform(
        kept,
        lambda x: F.struct(x["family"], x["given"], t.phonetic(x["family"]).alias("phonetic")),
    )


def norm_addresses(c: Column) -> Column:
    def one(x: Column) -> Column:
        parts = F.filter(
            F.concat(
                F.coalesce(x["lines"], F.array().cast("array<string>")),
                F.array(x["city"], x["district"]),
            ),
            lambda p: ~t.is_blank(p),
        )
        tokens = F.array_join(F.transform(parts, t.norm_words), " ")
        return F.struct(
            tokens.alias("tokens"), t.norm_postcode(x["postal_code"]).alias("postcode")
        )

    kept = F.filter(F.transform(c, one), lambda x: (x["tokens"] != "") | (x["postcode"] != ""))
    return F.transform(
        kept,
        lambda x: F.struct(
            x["tokens"],
            x["postcode"],
            t.postcode_sector(x["postcode"]).alias("sector"),
            F.array_distinct(F.filter(F.split(x["tokens"], " "), lambda w: w != "")).alias("words"),
        ),
    )


def norm_telecoms(c: Column) -> Column:
    def one(x: Column) -> Column:
        system, value = x["system"], x["value"]
        return F.struct(
            system.alias("system"),
            F.when(system == "Email", t.upper_one_to_one(t.trim(value)))
            .when(system.isin("Phone", "Fax", "Pager", "Sms"), t.norm_phone(value))
            .otherwise(t.norm_words(value))
            .alias("value"),
        )

    return distinct(F.filter(F.transform(c, one), lambda x: x["value"] != ""))


def _trusted(identifiers: Column) -> Column:
    """(system, value) of identifiers that may prove or disprove identity."""
    kept = F.filter(
        identifiers,
        lambda x: x["is_verified"]
        & x["is_authoritative"]
        & ((x["system"] != NHS_SYSTEM) | t.nhs_valid(x["value"])),
    )
    return distinct(F.transform(kept, lambda x: F.struct(x["system"], x["value"])))


def norm_column(profile: Column) -> Column:
    return F.struct(
        norm_identifiers(profile["identifiers"]).alias("identifiers"),
        norm_names(profile["names"]).alias("names"),
        profile["birth_date"].alias("birth_date"),
        profile["gender"].alias("gender"),
        norm_addresses(profile["addresses"]).alias("addresses"),
        norm_telecoms(profile["telecoms"]).alias("telecoms"),
    )


def normalise(df: DataFrame) -> DataFrame:
    """Add ``norm``: the standardised profile that blocking and comparison read."""
    made = computed_once(df, {"norm": norm_column(F.col("profile"))})
    return made.withColumn(
        "norm", F.col("norm").withField("trusted", _trusted(F.col("norm.identifiers")))
    )
