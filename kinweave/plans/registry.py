"""The registry: its tables, first load, and all-or-nothing commits to a versioned folder."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import TenantConfig
from kinweave.functions import hashing
from kinweave.operators import blocking, normalise, survivorship
from kinweave.schemas import REGISTRY_TABLES

SOURCE = ["tenant_id", "source_system", "local_id"]
IDENTITY = ["tenant_id", "enterprise_id"]

# How a source record came to its identity.
LEVEL_NEW = "Level2"
LEVEL_CERTAIN = "Level4"


class VersionConflict(ValueError):
    """A mutation was built on rows that have changed since."""


class MixedTenants(ValueError):
    """Rows of more than one tenant where exactly one is allowed."""


@dataclass(frozen=True)
class Registry:
    """One DataFrame per table of ``schemas.REGISTRY_TABLES``."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    version: int = 0

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self.spark.createDataFrame([], REGISTRY_TABLES[name])

    def having(self, **tables: DataFrame) -> "Registry":
        return Registry(self.spark, {**self.tables, **tables}, self.version)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns and types of a registry table, in order."""
    empty = df.sparkSession.createDataFrame([], REGISTRY_TABLES[name])
    return df.select(
        *(F.col(item.name).cast(item.dataType).alias(item.name) for item in empty.schema)
    )


def assert_single_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """Fail the job on the first row of another tenant; costs no extra pass."""
    ok = F.coalesce(F.col("tenant_id") == tenant_id, F.lit(False))
    message = f"a row of another tenant than {tenant_id}"
    return df.withColumn(
        "tenant_id",
        F.when(ok, F.col("tenant_id")).otherwise(F.raise_error(F.lit(message)).cast("string")),
    )


# ---- storage ------------------------------------------------------------------------------------


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _manifest_versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _filesystem(spark, root)
    folder = path(f"{root}/manifests")
    if not fs.exists(folder):
        return []
    names = [item.getPath().getName() for item in fs.listStatus(folder)]
    return sorted(int(name) for name in names if name.isdigit())


def load(spark: SparkSession, root: str, version: int | None = None) -> Registry:
    """Tables as one commit left them. The manifest is read once, so all tables agree."""
    versions = _manifest_versions(spark, root)
    if not versions:
        return Registry(spark)
    chosen = versions[-1] if version is None else version
    rows = spark.read.text(f"{root}/manifests/{chosen:012d}").limit(1).collect()
    paths = json.loads(rows[0][0])
    tables = {
        name: spark.read.schema(REGISTRY_TABLES[name]).parquet(where)
        for name, where in paths.items()
    }
    return Registry(spark, tables, chosen)


def commit(root: str, base: Registry, changed: dict[str, DataFrame]) -> Registry:
    """Write the changed tables beside the old ones, then make them visible with one rename.

    Readers resolve a manifest before they read, so they see all tables of a commit or none. The
    rename fails when another writer took the same version first.
    """
    spark = base.spark
    fs, path = _filesystem(spark, root)
    target = base.version + 1
    run = uuid.uuid4().hex
    paths: dict[str, str] = {}
    if base.version:
        rows = spark.read.text(f"{root}/manifests/{base.version:012d}").limit(1).collect()
        paths = json.loads(rows[0][0])
    for name, df in changed.items():
        where = f"{root}/tables/{name}/{target:012d}-{run}"
        conform(df, name).write.partitionBy("tenant_id").parquet(where)
        paths[name] = where
    draft = f"{root}/drafts/{run}"
    body = spark.createDataFrame([(json.dumps(paths, sort_keys=True),)], "value string")
    body.coalesce(1).write.text(draft)
    final = path(f"{root}/manifests/{target:012d}")
    fs.mkdirs(path(f"{root}/manifests"))
    if fs.exists(final) or not fs.rename(path(draft), final):
        raise VersionConflict(f"version {target} of {root} was committed by another writer")
    return load(spark, root, target)


# ---- building rows ------------------------------------------------------------------------------


def with_source_policy(df: DataFrame, cfg: TenantConfig) -> DataFrame:
    """Trust and authority of each row's source; unknown sources have trust 0 and no authority."""
    trust, authoritative = F.lit(0), F.lit(False)
    for name, policy in cfg.sources:
        here = F.col("source_system") == name
        trust = F.when(here, policy.trust).otherwise(trust)
        authoritative = F.when(here, policy.is_authoritative).otherwise(authoritative)
    return df.withColumn("source_trust", trust).withColumn(
        "source_is_authoritative", authoritative
    )


def source_key(df: DataFrame | None = None) -> Column:
    return F.struct("source_system", "local_id")


def assemble(sources: DataFrame, cfg: TenantConfig, now: Column) -> dict[str, DataFrame]:
    """Identity tables from source rows that already carry their enterprise id."""
    golden = survivorship.golden_record(sources)
    keyed = blocking.blocking_keys(normalise.normalise(golden), cfg)
    canonical = keyed.select(
        *IDENTITY, "profile", "blocking_keys", "survivorship_trust",
        now.alias("created_at"), now.alias("last_updated"), F.lit(1).alias("version"),
        F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("replaced_by"),
    )
    members = sources.select(
        *IDENTITY, F.lit(0).alias("position"),
        "source_system", "local_id",
    )
    persons = canonical.select(
        *IDENTITY, "created_at", "last_updated", "version", "is_active", "replaced_by"
    )
    links = sources.select(
        *IDENTITY, F.lit(0).alias("position"),
        "source_system", "local_id",
        F.col("resource_id").alias("source_resource_id"), F.lit(LEVEL_NEW).alias("assurance"),
        now.alias("linked_at"), F.lit("New enterprise identity").alias("reason"),
    )
    return {
        "source_patients": sources,
        "canonical_patients": canonical,
        "canonical_sources": members,
        "persons": persons,
        "person_links": links,
    }


def prepare_sources(rows: DataFrame, cfg: TenantConfig, now: Column) -> DataFrame:
    """Incoming (tenant_id, source_system, local_id, profile) rows as governed source rows."""
    governed = normalise.apply_authority(with_source_policy(rows, cfg), cfg)
    resource = hashing.stable_resource_id(
        F.col("tenant_id"), F.col("source_system"), F.col("local_id"), cfg.active_secret.secret
    )
    made = governed.withColumn("resource_id", resource).withColumn("last_updated", now)
    if "enterprise_id" not in made.columns:
        made = made.withColumn(
            "enterprise_id",
            hashing.new_enterprise_id(
                F.col("tenant_id"), F.col("source_system"), F.col("local_id")
            ),
        )
    return made.withColumn("version", F.lit(1))


def check_versions(expected: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Mutations (``mutation_id``) whose every expected version holds; 0 means must not exist."""
    stored = current.select(*keys, F.col("version").alias("_stored"))
    held = F.coalesce(F.col("_stored"), F.lit(0)) == F.col("expected_version")
    return (
        expected.join(stored, keys, "left")
        .groupBy("mutation_id")
        .agg(F.min(held).alias("accepted"), F.count_if(~held).alias("conflicts"))
    )


def audit_rows(
    df: DataFrame, action: str, actor: str, reason: Column | str, now: Column,
    outcome: str = "success", correlation: Column | None = None,
) -> DataFrame:
    """One audit row per change. ``df`` has tenant_id, enterprise_id and maybe source columns."""
    has_source = {"source_system", "local_id"} <= set(df.columns)
    source = (
        F.struct("source_system", "local_id")
        if has_source
        else F.lit(None).cast("struct<source_system:string,local_id:string>")
    )
    reason = F.lit(reason) if isinstance(reason, str) else reason
    correlation = F.lit(None).cast("string") if correlation is None else correlation
    subject = F.coalesce("enterprise_id", F.lit(""))
    parts = [F.lit("audit"), F.col("tenant_id"), F.lit(action), subject, now.cast("string")]
    if has_source:
        parts += [F.col("source_system"), F.col("local_id")]
    if "version" in df.columns:
        parts.append(F.col("version").cast("string"))
    parts.append(F.coalesce(correlation, F.lit("")))
    return df.select(
        "tenant_id", hashing.name_uuid(*parts).alias("id"), F.lit(action).alias("action"),
        F.lit(actor).alias("actor"), F.lit(outcome).alias("outcome"), reason.alias("reason"),
        "enterprise_id", source.alias("source"), now.alias("recorded_at"),
        correlation.alias("correlation_id"),
    )


def split_new_existing(incoming: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incoming rows of unknown source records, and rows of known ones with their stored state."""
    stored = sources.select(
        *SOURCE, F.col("enterprise_id").alias("stored_enterprise_id"),
        F.col("version").alias("stored_version"), F.col("resource_id").alias("stored_resource_id"),
    )
    joined = incoming.join(stored, SOURCE, "left")
    new = joined.where(F.col("stored_version").isNull())
    return new.drop(*stored.columns[3:]), joined.where(F.col("stored_version").isNotNull())


def check_source_owner(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """A source may write only its own records; other rows are set aside."""
    mine = F.coalesce(F.col("source_system") == source, F.lit(False))
    return df.where(mine), df.where(~mine).withColumn("reason", F.lit("not-the-owning-source"))


def lookup(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a table for a batch of keys; Spark broadcasts the keys when they are few."""
    return table.join(wanted.select(*keys).distinct(), keys, "left_semi")


def canonical_with_sources(registry: Registry) -> tuple[DataFrame, DataFrame]:
    """(identity x source rows whose provenance is whole, warnings).

    A listed source that is missing, or that another identity owns, makes its identity unusable.
    """
    active = registry["canonical_patients"].where("is_active").select(*IDENTITY)
    listed = registry["canonical_sources"].join(active, IDENTITY, "left_semi")
    stored = registry["source_patients"].withColumnRenamed("enterprise_id", "_owner")
    joined = listed.drop("position").join(stored, SOURCE, "left")
    wrong = F.col("_owner").isNull() | (F.col("_owner") != F.col("enterprise_id"))
    warnings = joined.where(wrong).select(
        *IDENTITY, "source_system", "local_id",
        F.when(F.col("_owner").isNull(), "missing-source").otherwise("other-owner").alias("reason"),
    )
    broken = warnings.select(*IDENTITY).distinct()
    whole = joined.where(~wrong).join(broken, IDENTITY, "left_anti").drop("_owner")
    return whole, warnings


def canonical_with_person(registry: Registry) -> DataFrame:
    """Every identity with its person, if it has one."""
    persons = registry["persons"].select(
        *IDENTITY, F.col("version").alias("person_version"),
        F.col("is_active").alias("person_is_active"),
    )
    return registry["canonical_patients"].join(persons, IDENTITY, "left")


def resolve_replaced_by(canonical: DataFrame) -> DataFrame:
    """(tenant_id, enterprise_id, survivor_id): follow replaced_by to the identity still in use.

    Pointer doubling: each round joins the table with itself and halves the longest chain, so the
    number of rounds is bounded by the logarithm of the rows. An identity whose chain runs into a
    cycle has no survivor: its survivor_id is null.
    """
    from kinweave.session import cut

    named = cut(canonical.select(*IDENTITY, F.col("replaced_by").alias("_to")))
    own = F.coalesce("_to", "enterprise_id")
    hops = named.select(*IDENTITY, own.alias("survivor_id"))
    for _ in range(max(1, named.count()).bit_length() + 1):
        ahead = hops.select(
            "tenant_id", F.col("enterprise_id").alias("survivor_id"),
            F.col("survivor_id").alias("_next"),
        )
        moved = cut(
            hops.join(ahead, ["tenant_id", "survivor_id"], "left").select(
                *IDENTITY, "survivor_id", F.coalesce("_next", "survivor_id").alias("_next")
            )
        )
        hops = moved.select(*IDENTITY, F.col("_next").alias("survivor_id"))
        if moved.where(F.col("_next") != F.col("survivor_id")).limit(1).count() == 0:
            break
    # Where a chain ended, its end points nowhere; on a cycle it still points on.
    onward = named.where("_to is not null and _to <> enterprise_id").select(
        "tenant_id", F.col("enterprise_id").alias("survivor_id"), F.lit(True).alias("_onward"))
    return hops.join(onward, ["tenant_id", "survivor_id"], "left").select(
        *IDENTITY, F.when(F.col("_onward").isNull(), F.col("survivor_id")).alias("survivor_id"))


def identity_view(registry: Registry, ids: DataFrame) -> DataFrame:
    """Identity, person and sources (best first) for a batch of enterprise ids."""
    wanted = ids.select(*IDENTITY).distinct()
    sources = registry["source_patients"].join(wanted, IDENTITY, "left_semi")
    position = survivorship.ordered_sources(sources).select(
        *IDENTITY, "position", "source_system", "local_id", "resource_id", "source_trust",
        F.col("last_updated").alias("source_updated"), F.col("version").alias("source_version"),
    )
    identities = canonical_with_person(registry).join(wanted, IDENTITY, "left_semi")
    return identities.join(position, IDENTITY, "left")
