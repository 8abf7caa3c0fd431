"""Incremental feeds of Patients landed as files, and run windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as t


def read_changes(
    feed: DataFrame, since: str | None, through: str, local_id_system: str | None = None
) -> DataFrame:
    """Feed rows of one window, both ends included.

    ``feed`` is the output of the FHIR readers, or any table with resource_id, last_updated,
    profile and payload_digest. A missing time counts as the window's end. With
    ``local_id_system`` the local id is the one distinct identifier value of that system.
    """
    end = F.to_timestamp(F.lit(through))
    updated = F.coalesce(F.col("last_updated"), end)
    inside = updated <= end
    if since is not None:
        inside = inside & (updated >= F.to_timestamp(F.lit(since)))
    if local_id_system is None:
        local_id = F.col("resource_id")
        problem = F.when(t.is_blank(F.col("resource_id")), "missing-resource-id")
    else:
        values = F.array_distinct(
            F.transform(
                F.filter(
                    F.col("profile.identifiers"),
                    lambda x: (x["system"] == local_id_system) & ~t.is_blank(x["value"]),
                ),
                lambda x: x["value"],
            )
        )
        local_id = F.when(F.size(values) == 1, F.get(values, F.lit(0)))
        problem = (
            F.when(t.is_blank(F.col("resource_id")), "missing-resource-id")
            .when(F.size(values) == 0, "missing-local-identifier")
            .when(F.size(values) > 1, "several-local-identifiers")
        )
    version = F.col("version_id") if "version_id" in feed.columns else F.lit(None).cast("string")
    stamp = F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0+00:00'")
    return feed.where(inside).select(
        "resource_id", local_id.alias("local_id"),
        F.coalesce(version, F.concat_ws("-", stamp, F.substring("payload_digest", 1, 16))).alias(
            "source_version"
        ),
        updated.alias("last_updated"), "profile", "payload_digest", problem.alias("problem"),
    )


def run_bucket(ts: Column, interval: str) -> Column:
    """Start of the tumbling run window a time falls in."""
    return F.window(ts, interval)["start"]
