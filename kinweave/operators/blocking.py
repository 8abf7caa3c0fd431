"""Blocking keys, the candidate index and bounded candidate generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import MatchingProfile, Secret, TenantConfig
from kinweave.functions.hashing import hmac_sha256
from kinweave.functions.lists import distinct
from kinweave.functions.once import computed_once

KEY = ["tenant_id", "key_version", "key_value"]


def raw_keys_column(norm: Column, rules: MatchingProfile) -> Column:
    """Distinct readable keys of one record, before hashing."""
    dob = F.date_format(norm["birth_date"], "yyyyMMdd")
    has_dob = norm["birth_date"].isNotNull()
    empty = F.array().cast("array<string>")
    parts: list[Column] = []

    def dated(prefix: str, items: Column, field: str) -> Column:
        kept = F.filter(items, lambda x: x[field] != "")
        made = F.transform(kept, lambda x: F.concat_ws("|", F.lit(prefix), x[field], dob))
        return F.when(has_dob, made).otherwise(empty)

    if "AuthoritativeIdentifier" in rules.blocking_rules:
        systems = list(rules.identifier_systems)
        kept = F.filter(norm["identifiers"], lambda x: x["system"].isin(systems))
        parts.append(
            F.transform(kept, lambda x: F.concat_ws("|", F.lit("ID"), x["system"], x["value"]))
        )
    if "FamilyNameAndBirthDate" in rules.blocking_rules:
        parts.append(dated("FMDOB", norm["names"], "family"))
    if "PhoneticFamilyNameAndBirthDate" in rules.blocking_rules:
        parts.append(dated("PHDOB", norm["names"], "phonetic"))
    if "PostcodeAndBirthDate" in rules.blocking_rules:
        parts.append(dated("PCDOB", norm["addresses"], "postcode"))
    systems = []
    if "Phone" in rules.blocking_rules:
        systems += ["Phone", "Sms"]
    if "Email" in rules.blocking_rules:
        systems += ["Email"]
    if systems:
        kept = F.filter(norm["telecoms"], lambda x: x["system"].isin(systems))
        parts.append(
            F.transform(kept, lambda x: F.concat_ws("|", F.lit("TEL"), x["system"], x["value"]))
        )
    parts = [F.coalesce(part, empty) for part in parts]
    return F.array_distinct(reduce(F.concat, parts))


def raw_blocking_keys(df: DataFrame, cfg: TenantConfig) -> DataFrame:
    return df.withColumn("raw_keys", raw_keys_column(F.col("norm"), cfg.profile))


def _hashed(raw: Column, item: Secret) -> Column:
    return F.transform(
        raw,
        lambda key: F.struct(
            F.lit(item.version).alias("version"), hmac_sha256(key, item.secret).alias("value")
        ),
    )


def blocking_keys(df: DataFrame, cfg: TenantConfig, output: str = "blocking_keys") -> DataFrame:
    """Hash every raw key under every secret version."""
    raw = raw_keys_column(F.col("norm"), cfg.profile)
    hashed = [_hashed(F.col("_raw"), item) for item in cfg.secrets]
    return computed_once(
        computed_once(df, {"_raw": raw}), {output: reduce(F.concat, hashed)}
    ).drop("_raw")


def split_blockable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a blocking key, and the rows that carry too little to be matched."""
    enough = F.size("blocking_keys") > 0
    quarantined = df.where(~enough).withColumn("reason", F.lit("insufficient-identity"))
    return df.where(enough), quarantined


def explode_keys(df: DataFrame, id_column: str) -> DataFrame:
    return df.select(
        "tenant_id", id_column, F.explode(distinct(F.col("blocking_keys"))).alias("_key")
    ).select(
        "tenant_id",
        F.col("_key.version").alias("key_version"),
        F.col("_key.value").alias("key_value"),
        id_column,
    )


def candidate_index(canonical: DataFrame) -> DataFrame:
    """One row per key of every active identity."""
    return explode_keys(canonical.where("is_active"), "enterprise_id")


def shares_key(left: Column, right: Column) -> Column:
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def block_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy(*KEY).agg(F.count(F.lit(1)).alias("block_size"))


def block_stats(index: DataFrame) -> DataFrame:
    """How many blocks have each size, and how many pairs they hold."""
    return (
        block_sizes(index)
        .groupBy("tenant_id", "key_version", "block_size")
        .agg(F.count(F.lit(1)).alias("blocks"))
        .withColumn("pairs", F.col("blocks") * F.expr("block_size * (block_size - 1) div 2"))
    )


#: Blocks with more identities than this on a side are joined in tiles of about this many on each side.
TILE_ROWS = 1024


def _tiles(index: DataFrame, name: str) -> DataFrame:
    """Into how many parts the large blocks of one side are cut."""
    return block_sizes(index).where(F.col("block_size") > TILE_ROWS).select(
        *KEY, F.ceil(F.col("block_size") / TILE_ROWS).cast("int").alias(name))


def _coded(index: DataFrame, id_column: str, carried: DataFrame | None, tiles: DataFrame) -> DataFrame:
    """One row per key of every identity, with the codes of all its keys and the columns it carries.

    A key's code is 126 bits of its SHA-256. What an identity carries is joined before its keys are
    exploded, so it moves once for each key.
    """
    named = F.concat_ws("\0", F.length("key_version").cast("string"), "key_version", "key_value")
    code = F.substring(F.base64(F.unhex(F.sha2(named, 256))), 1, 21)
    slim = index.where("key_version is not null and key_value is not null").join(tiles, KEY, "left").select(
        "tenant_id", id_column,
        F.struct(code.alias("code"), F.coalesce("_l", F.lit(1)).alias("l"), F.coalesce("_r", F.lit(1)).alias("r")).alias("key"))
    whole = slim.groupBy("tenant_id", id_column).agg(F.collect_set("key").alias("_keys"))
    if carried is not None:
        whole = whole.join(carried, ["tenant_id", id_column])
    return whole.withColumns({"_codes": F.col("_keys.code"), "_key": F.explode("_keys")}).withColumn(
        "_code", F.col("_key.code")).drop("_keys")


def met_once(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str,
    left_more: DataFrame | None = None, right_more: DataFrame | None = None, ascending: bool = False,
) -> DataFrame:
    """Pairs (tenant_id, left_id, right_id) of two indexes that share a key, each once, with carried columns.

    ``left_more`` and ``right_more`` hold (tenant_id, id) and columns that a pair needs of its sides;
    rows that repeat there repeat the pair. A pair is made in every block it shares and kept in the one
    whose code is the smallest of all it shares, so pairs are neither shuffled nor compared with each
    other: what moves are the identities, once for each of their keys. Large blocks are cut into
    tiles on both sides, so no task holds more than a tile of a hot key. ``ascending`` keeps the
    pairs whose left id is smaller.
    """
    tiles = _tiles(left, "_l").join(_tiles(right, "_r"), KEY, "full")
    both = F.col("_key.l"), F.col("_key.r")
    own = lambda id_column, count: F.pmod(F.xxhash64(id_column), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    lefts = _coded(left, left_id, left_more, tiles).withColumn("_lt", own(left_id, both[0])).withColumn("_rt", every(both[1]))
    rights = _coded(right, right_id, right_more, tiles).withColumn("_rt", own(right_id, both[1])).withColumn("_lt", every(both[0]))
    met = lefts.drop("_key").withColumnRenamed("_codes", "_left_codes").join(
        rights.drop("_key").withColumnRenamed("_codes", "_right_codes"), ["tenant_id", "_code", "_lt", "_rt"])
    if ascending:
        met = met.where(F.col(left_id) < F.col(right_id))
    first = F.array_min(F.array_intersect("_left_codes", "_right_codes")) == F.col("_code")
    return met.where(first).drop("_code", "_lt", "_rt", "_left_codes", "_right_codes")


def candidates(
    queries: DataFrame, index: DataFrame, cap: int | None = None,
    query_more: DataFrame | None = None, candidate_more: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of outside queries, and the queries refused because they have too many.

    ``queries`` holds (tenant_id, query_id, key_version, key_value) rows. Without a cap every query
    gets all of its candidates. With one, a block with more than ``cap`` identities refuses its
    queries before any pair is made, so the join stays linear in the queries however hot a key is.
    Pairs carry ``candidate_count``, the distinct candidates of their query. Without a cap they also carry
    the columns of ``query_more`` (tenant_id, query_id, ...) and ``candidate_more`` (tenant_id, candidate_id, ...).
    """
    index = index.join(queries.select(*KEY).distinct(), KEY, "left_semi")
    if cap is None:
        # Counted first and made again with the counts: so the pairs themselves are never shuffled.
        met = lambda *more: met_once(
            queries, index.withColumnRenamed("enterprise_id", "candidate_id"), "query_id", "candidate_id", *more)
        counts = met().groupBy("tenant_id", "query_id").agg(F.count(F.lit(1)).alias("candidate_count"))
        if query_more is not None:
            counts = counts.join(query_more, ["tenant_id", "query_id"])
        return met(counts, candidate_more), queries.limit(0).select("tenant_id", "query_id")
    # One secret version is enough where both sides have it, but rows written before a rotation may
    # carry other versions only; joining on all and removing repeats is right for both.
    oversized = block_sizes(index).where(F.col("block_size") > cap).select(*KEY)
    over_queries = (
        queries.join(oversized, KEY, "left_semi").select("tenant_id", "query_id").distinct()
    )
    live = queries.join(over_queries, ["tenant_id", "query_id"], "left_anti")
    # One shuffle by query serves the distinct and the count. A query holds at most (its keys x cap)
    # rows here, so the window never sees a large group.
    pairs = (
        live.join(index, KEY)
        .select("tenant_id", "query_id", F.col("enterprise_id").alias("candidate_id"))
        .repartition("tenant_id", "query_id")
        .distinct()
        .withColumn(
            "candidate_count",
            F.count(F.lit(1)).over(Window.partitionBy("tenant_id", "query_id")),
        )
    )
    many = pairs.where(F.col("candidate_count") > cap).select("tenant_id", "query_id").distinct()
    return pairs.where(F.col("candidate_count") <= cap), over_queries.unionByName(many)


def self_candidates(index: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (subject_id < candidate_id) of one population, and the refused subjects.

    Without a cap nothing is refused. With one, a subject is refused when its candidates, itself
    included, exceed ``cap``. Every member of a block larger than ``cap`` is refused on sight, so
    such blocks never enter the self-join; their members still appear as candidates through their
    smaller blocks.
    """
    if cap is None:
        pairs = met_once(
            index.withColumnRenamed("enterprise_id", "subject_id"), index.withColumnRenamed("enterprise_id", "candidate_id"),
            "subject_id", "candidate_id", ascending=True)
        return pairs, index.limit(0).select("tenant_id", F.col("enterprise_id").alias("subject_id"))
    oversized = block_sizes(index).where(F.col("block_size") > cap).select(*KEY)
    over_ids = (
        index.join(oversized, KEY, "left_semi").select("tenant_id", "enterprise_id").distinct()
    )
    small = index.join(oversized, KEY, "left_anti").join(
        over_ids.withColumn("over", F.lit(True)), ["tenant_id", "enterprise_id"], "left"
    )
    left = small.select(*KEY, F.col("enterprise_id").alias("subject_id"),
                        F.coalesce("over", F.lit(False)).alias("subject_over"))
    right = small.select(*KEY, F.col("enterprise_id").alias("candidate_id"),
                         F.coalesce("over", F.lit(False)).alias("candidate_over"))
    joined = left.join(right, KEY).where(
        (F.col("subject_id") < F.col("candidate_id"))
        & ~(F.col("subject_over") & F.col("candidate_over"))
    )
    pairs = joined.select(
        "tenant_id", "subject_id", "candidate_id", "subject_over", "candidate_over"
    ).distinct()
    ends = pairs.select(
        "tenant_id",
        F.explode(
            F.array(
                F.struct(F.col("subject_id").alias("id"), F.col("subject_over").alias("over")),
                F.struct(F.col("candidate_id").alias("id"), F.col("candidate_over").alias("over")),
            )
        ).alias("_end"),
    ).where(~F.col("_end.over"))
    crowded = (
        ends.groupBy("tenant_id", F.col("_end.id").alias("subject_id"))
        .agg(F.count(F.lit(1)).alias("_others"))
        .where(F.col("_others") + 1 > cap)
        .select("tenant_id", "subject_id")
    )
    rejected = over_ids.withColumnRenamed("enterprise_id", "subject_id").unionByName(crowded)
    kept = (
        pairs.where(~F.col("subject_over"))
        .select("tenant_id", "subject_id", "candidate_id")
        .join(crowded, ["tenant_id", "subject_id"], "left_anti")
    )
    return kept, rejected
