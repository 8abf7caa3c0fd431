"""Keyed hashes, digests and stable ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(c: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 of the UTF-8 text, upper-case hex. Only the two padded keys enter the plan."""
    if len(secret) > _BLOCK:
        import hashlib

        secret = hashlib.sha256(secret).digest()
    key = secret.ljust(_BLOCK, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))
    return F.upper(F.sha2(F.concat(outer, first), 256))


def stable_resource_id(tenant: Column, source: Column, local_id: Column, secret: bytes) -> Column:
    digest = hmac_sha256(F.concat_ws("\n", tenant, source, local_id), secret)
    return F.concat(F.lit("src-"), F.lower(F.substring(digest, 1, 32)))


def payload_digest(c: Column, upper: bool = True) -> Column:
    digest = F.sha2(F.encode(c, "UTF-8"), 256)
    return F.upper(digest) if upper else digest


def adt_idempotency_key(
    tenant: Column, source: Column, app: Column, facility: Column, control: Column
) -> Column:
    parts = (F.coalesce(part, F.lit("")) for part in (tenant, source, app, facility, control))
    return F.concat_ws("|", *parts)


def feed_idempotency_key(source: Column, resource_id: Column, version: Column) -> Column:
    return F.concat_ws(":", F.lit("fhir-reconcile"), source, resource_id, version)


def _uuid_from_hex(digest: Column, little_endian: bool) -> Column:
    """32 hex digits to UUID text with version 5 and the RFC variant."""

    def byte(i: int) -> Column:
        return F.substring(digest, 2 * i + 1, 2)

    # Fixed value: byte order of the first three groups when they are stored little-endian.
    order = (3, 2, 1, 0, 5, 4, 7, 6) if little_endian else (0, 1, 2, 3, 4, 5, 6, 7)
    head = {i: byte(i) for i in range(16)}
    version_byte = 7 if little_endian else 6
    head[version_byte] = F.concat(F.lit("5"), F.substring(digest, 2 * version_byte + 2, 1))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    head[8] = F.concat(variant, F.substring(digest, 18, 1))
    first = [head[i] for i in order]
    return F.concat(
        *first[:4], F.lit("-"), *first[4:6], F.lit("-"), *first[6:8], F.lit("-"),
        head[8], head[9], F.lit("-"), *(head[i] for i in range(10, 16)),
    )


def reconciliation_review_id(
    tenant: Column, left_id: Column, left_version: Column, right_id: Column,
    right_version: Column, profile_version: Column,
) -> Column:
    """One id per unordered pair of identity versions under one rule version."""
    swap = right_id < left_id
    low = F.when(swap, right_id).otherwise(left_id)
    low_version = F.when(swap, right_version).otherwise(left_version)
    high = F.when(swap, left_id).otherwise(right_id)
    high_version = F.when(swap, left_version).otherwise(right_version)
    text = F.concat_ws(
        "\0", tenant, low, low_version.cast("string"), high, high_version.cast("string"),
        profile_version,
    )
    return _uuid_from_hex(F.sha2(F.encode(text, "UTF-8"), 256), little_endian=True)


def name_uuid(*parts: Column) -> Column:
    """Deterministic UUID of the given parts, so a job that is run again makes the same ids."""
    text = F.concat_ws("\0", *parts)
    return _uuid_from_hex(F.sha2(F.encode(text, "UTF-8"), 256), little_endian=False)


def new_enterprise_id(tenant: Column, source: Column, local_id: Column) -> Column:
    return name_uuid(F.lit("enterprise"), tenant, source, local_id)


def pair_key(left: Column, right: Column) -> Column:
    """One text for an unordered pair of source keys."""
    return F.concat_ws("|", F.least(left, right), F.greatest(left, right))
