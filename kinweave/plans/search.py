"""Filtered, ordered and paged searches over the registry tables."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.config import NHS_SYSTEM
from kinweave.functions import text as t

# The default order of each table.
_ORDER = {
    "canonical_patients": (("enterprise_id", True),),
    "persons": (("enterprise_id", True),),
    "review_cases": (("created_at", False), ("id", True)),
    "audit": (("recorded_at", False), ("id", True)),
    "jobs": (("requested_at", False), ("id", True)),
}


def order_by_default(df: DataFrame, table: str) -> DataFrame:
    return df.orderBy(*(F.col(c).asc() if up else F.col(c).desc() for c, up in _ORDER[table]))


def search_canonical(
    df: DataFrame, identifier: str | None = None, system: str | None = None,
    family: str | None = None, birth_date: str | None = None,
) -> DataFrame:
    """Active identities that meet every given condition; identifiers match as stored."""
    found = df.where("is_active")
    if identifier and identifier.strip():
        def same(x: Column) -> Column:
            hit = x["value"] == identifier
            return hit if system is None else hit & (x["system"] == system)

        found = found.where(F.exists("profile.identifiers", same))
    if family and family.strip():
        found = found.where(
            F.exists("profile.names", lambda n: F.upper(n["family"]) == family.upper())
        )
    if birth_date is not None:
        found = found.where(F.col("profile.birth_date") == F.to_date(F.lit(birth_date)))
    return found


def lookup_patients(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Batch lookup: (query_id, tenant_id, identifier, family, birth_date) rows.

    An identifier that is a UUID finds that identity, any other one the NHS number with its digits;
    without an identifier both family name and birth date are needed.
    """
    text = t.trim(F.col("identifier"))
    is_uuid = F.coalesce(text.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))
    asked = queries.withColumn("_id", F.lower(text)).withColumn("_uuid", is_uuid).withColumn(
        "_digits", F.when(~is_uuid, t.digits(text))
    )
    active = df.where("is_active")
    by_id = asked.where("_uuid").join(
        df.withColumn("_id", F.lower("enterprise_id")), ["tenant_id", "_id"]
    ).withColumn("found_by", F.lit("enterprise-id"))
    numbers = active.select(
        "tenant_id", "enterprise_id",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.filter("profile.identifiers", lambda x: x["system"] == NHS_SYSTEM),
                    lambda x: x["value"],
                )
            )
        ).alias("_digits"),
    )
    by_number = asked.where("not _uuid and _digits <> ''").join(
        numbers, ["tenant_id", "_digits"]
    ).withColumn("found_by", F.lit("nhs-number"))
    names = active.where("profile.birth_date is not null").select(
        "tenant_id", "enterprise_id", F.col("profile.birth_date").alias("birth_date"),
        F.explode(
            F.array_distinct(F.transform("profile.names", lambda n: F.upper(n["family"])))
        ).alias("_family"),
    )
    by_name = asked.where("(_digits is null or _digits = '') and not _uuid").withColumn(
        "_family", F.upper(t.trim(F.col("family")))
    ).where("_family <> ''").join(names, ["tenant_id", "_family", "birth_date"]).withColumn(
        "found_by", F.lit("name-and-birth-date")
    )
    columns = ["tenant_id", "query_id", "enterprise_id", "found_by"]
    return by_id.select(*columns).unionByName(by_number.select(*columns)).unionByName(
        by_name.select(*columns)
    )


def search_persons(df: DataFrame, enterprise_id: str | None = None) -> DataFrame:
    found = df.where("is_active")
    return found if enterprise_id is None else found.where(F.col("enterprise_id") == enterprise_id)


def search_reviews(df: DataFrame, status: str | None = "Pending", kind: str | None = None) -> DataFrame:
    found = df if status is None else df.where(F.col("status") == status)
    return found if kind is None else found.where(F.col("kind") == kind)


def search_audit(
    df: DataFrame, action: str | None = None, actor: str | None = None, outcome: str | None = None,
    enterprise_id: str | None = None, since: str | None = None, until: str | None = None,
) -> DataFrame:
    found = df
    if action and action.strip():
        found = found.where(F.lower("action") == action.lower())
    if actor and actor.strip():
        found = found.where(F.contains(F.lower("actor"), F.lit(actor.lower())))
    if outcome and outcome.strip():
        found = found.where(F.lower("outcome") == outcome.lower())
    if enterprise_id is not None:
        found = found.where(F.col("enterprise_id") == enterprise_id)
    if since is not None:
        found = found.where(F.col("recorded_at") >= F.to_timestamp(F.lit(since)))
    if until is not None:
        found = found.where(F.col("recorded_at") <= F.to_timestamp(F.lit(until)))
    return found


def search_jobs(
    df: DataFrame, kind: str | None = None, status: str | None = None,
    source_system: str | None = None, schedule_key: str | None = None,
) -> DataFrame:
    found = df
    for column, value in (("kind", kind), ("status", status), ("source_system", source_system),
                          ("schedule_key", schedule_key)):
        if value:
            found = found.where(F.col(column) == value)
    return found


def page(df: DataFrame, table: str, size: int = 20, cursor: str | None = None) -> tuple[list, str | None]:
    """One page of ``size`` rows and the cursor of the next.

    The cursor holds the last row's sort key, so a page costs a top-k, not an offset scan.
    """
    if size < 1:
        raise ValueError("a page has at least one row")
    order = _ORDER[table]
    found = df
    if cursor:
        try:
            last = json.loads(base64.urlsafe_b64decode(cursor.encode()))
            if len(last) != len(order):
                raise ValueError
        except ValueError as problem:
            raise ValueError("malformed cursor") from problem
        after, equal = F.lit(False), F.lit(True)
        for (name, up), value in zip(order, last):
            c = F.col(name).cast("string")
            after = after | (equal & ((c > value) if up else (c < value)))
            equal = equal & (c == value)
        found = found.where(after)
    keys = [F.col(name).cast("string").alias(f"_k{i}") for i, (name, _) in enumerate(order)]
    rows = order_by_default(found.select("*", *keys), table).limit(size + 1).collect()
    nxt = None
    if len(rows) > size:
        last = [rows[size - 1][f"_k{i}"] for i in range(len(order))]
        nxt = base64.urlsafe_b64encode(json.dumps(last).encode()).decode()
    return rows[:size], nxt


def priority_reviews(reviews: DataFrame, n: int | None = None) -> DataFrame:
    """Reviews that wait for a second approval first, then new ones, newest first; ``n`` of them or all."""
    open_rows = reviews.where(F.col("status").isin("Pending", "AwaitingSecondApproval"))
    first = F.when(F.col("status") == "AwaitingSecondApproval", 0).otherwise(1)
    ordered = open_rows.orderBy(first, F.desc("created_at"), "id")
    return ordered if n is None else ordered.limit(n)
