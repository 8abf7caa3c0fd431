"""State kept by key over micro-batches: the latest row of a key, and the first answer to one."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Settings that a stream takes over when it starts.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state on disk and end once there is no more to read.

    State with a time to live asks for another batch for ever, so a run over what is there would not end
    if batches without data were made.
    """
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stream_deltas(stream: DataFrame, path: str, checkpoint: str, mode: str, available_now: bool = True):
    """Start ``stream`` and write what each micro-batch puts out as ``path``/epoch=N.

    A batch that runs again after a failure overwrites its own folder, so rows are stored once.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    with keyed_state(stream.sparkSession):
        writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()


# ---- the latest row of a key, by the source's own clock ----------------------------------------


def latest_rows(stream: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Newest row per key by ``order_by``, as a streaming aggregation (update mode).

    Rows that come late never win over newer ones. The state is one row a key; tasks combine their rows
    of a key before they are shuffled, so a key with very many rows is no hot spot. Null keys are a key.
    """
    rest = [name for name in stream.columns if name not in keys]
    newest = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_row"))
    return newest.select(*keys, "_row.*")


def current(spark: SparkSession, schema: StructType, path: str, keys: list[str]) -> DataFrame:
    """The last row that each key was given in the deltas under ``path``."""
    deltas = spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).parquet(path)
    rest = [name for name in deltas.columns if name not in (*keys, "epoch")]
    return deltas.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_row")).select(*keys, "_row.*")


# ---- replays and their first answer --------------------------------------------------------------


class _FirstAnswer(StatefulProcessor):
    """Keeps the digest and response of the first row of a key, for as long as its time to live."""

    def __init__(self, digest: str, response: str, order_by: list[str], keep_ms: int) -> None:
        self._digest, self._response, self._order_by, self._keep_ms = digest, response, order_by, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first", "digest string, response string", self._keep_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._first.get() if self._first.exists() else None
        if known is not None:
            for part in rows:
                yield self._judge(part, *known)
            return
        # A key's first batch is held until its first row is known; what a batch holds is set by the source.
        held = pd.concat(list(rows), ignore_index=True)
        held = held.sort_values(self._order_by, na_position="first", kind="stable", ignore_index=True)
        known = tuple(None if pd.isna(x) else x for x in held.loc[0, [self._digest, self._response]])
        self._first.update(known)
        judged = self._judge(held, *known)
        judged.loc[0, ["receipt_state", "stored_response"]] = ["fresh", None]
        yield judged

    def _judge(self, part: pd.DataFrame, digest: str | None, response: str | None) -> pd.DataFrame:
        # A missing digest equals nothing, as in SQL.
        same = part[self._digest].eq(digest) & part[self._digest].notna() if digest is not None else False
        return part.assign(
            receipt_state=pd.Series(same, index=part.index).map({True: "replay", False: "conflict"}),
            stored_response=pd.Series([response] * len(part), index=part.index, dtype=object))


def first_answers(
    stream: DataFrame, key: str, digest: str, response: str, order_by: list[str], keep_ms: int,
) -> DataFrame:
    """Add ``receipt_state`` (fresh, replay, conflict) and the first answer as ``stored_response``.

    The first row of a key is fresh; within a micro-batch rows are taken by ``order_by``, and no later
    batch displaces an answer given. Rows of the same digest are replays, others conflicts. An answer is
    forgotten ``keep_ms`` milliseconds after it was given (0: never). Rows without a key have no receipt:
    they are fresh and keep no state. Run it under ``keyed_state``, in append mode.
    """
    extra = ("receipt_state", "stored_response")
    clash = sorted(set(extra) & set(stream.columns))
    if clash:
        raise ValueError(f"rows already have {', '.join(clash)}")
    schema = StructType([*stream.schema.fields, *(StructField(name, StringType()) for name in extra)])
    keyed = stream.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(
        _FirstAnswer(digest, response, order_by, keep_ms), schema, "append", "ProcessingTime" if keep_ms else "None")
    unkeyed = stream.where(F.col(key).isNull()).withColumns(
        {"receipt_state": F.lit("fresh"), "stored_response": F.lit(None).cast("string")})
    return keyed.unionByName(unkeyed)
