"""Mixing of sources to target weights: whole copies by the rate, one more by a hash-seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import stage
from kinweave.operators.ranks import ranked

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their code points, repeated.
WEIGHTS = (1, 2, 3)
#: A source is taken this many times over at most.
LIMIT = 3
SEED = "mix"


def unit(value: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 sum."""
    return F.conv(F.substring(F.md5(value), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _targets(sources: DataFrame, limit: int) -> DataFrame:
    """``sources`` (source, source_size, weight) with targets that share out all words by weight.

    A source's share stops at ``limit`` times its size; the excess goes to the others by weight, in
    rounds, until no share is above. A round is one aggregation of two sums; nothing is collected but
    these.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    spent, open_weight, stopped = 0, sources.agg(F.sum("weight")).first()[0], 0
    while True:
        share = F.lit(total - spent) * F.col("weight") / F.lit(open_weight)
        most = F.lit(limit) * F.col("source_size")
        above = share > most
        found = sources.agg(
            F.sum(F.when(above, most).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        if found[2] == stopped:
            return sources.withColumn("target", F.when(above, most).otherwise(share).cast("double"))
        spent, open_weight, stopped = found


def allocate(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED,
    text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row, and the columns of ``carry``.

    A source's rate is its target over its size. Every document is taken floor(rate) times, and once
    more with the probability of the fraction. The draws of a source share one start, hashed from the
    seed and the source, and run along its documents in the order of size and hashed id: a document is
    drawn where start + place * fraction passes a whole number. So each has exactly the probability of
    the fraction, equal sizes are drawn in turn, and the words drawn stay within about the longest
    document of their expectation, which independent draws do not. Reruns agree.

    Null texts have no words; they, empty texts and sources without words are taken by the same rule
    and add nothing. Null sources are one source and come last; null ids come first among equals. Rows
    that repeat an id are documents of their own; among equal rows it is open which are drawn, and how
    many is not. An empty table gives an empty one.
    """
    rows = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.struct(*(F.col(c) for c in carry)).alias("carried") if carry else F.lit(True).alias("carried")), "mix-sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(found, {}, {"last": F.col("source").isNull(), "source": F.col("source")}, "place")
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    sources = stage(
        placed.select("source", "source_size", cycle[(F.col("place") - 1) % len(weights)].alias("weight")), "mix-sources")
    mixed = _targets(sources, limit).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ).select(
        F.col("source").alias("of"), "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction"),
        unit(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))).alias("start"))
    ids = F.col("doc_id").cast("string")
    order = {"size": F.col("size"), "lot": F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ids, F.lit("")))), 1, 13), 16, 10).cast("long"), "id": F.col("doc_id")}
    places = ranked(rows, {"source": F.col("source")}, order, "place")
    upto = lambda k: F.floor(F.col("start") + k * F.col("fraction"))
    copies = F.col("whole") + upto(F.col("place")) - upto(F.col("place") - 1)
    out = places.join(mixed, F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *(["carried"] if carry else []))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; taken counts words, copies included."""
    return allocate(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves, every column kept; a row taken n times comes n times."""
    taken = allocate(docs, carry=tuple(docs.columns), **options)
    return taken.select(F.explode(F.array_repeat("carried", F.col("copies").cast("int"))).alias("row")).select("row.*")


def oracle() -> str:
    """SQL for ``mix`` with the defaults: targets by spreading the excess round after round."""
    return rf"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as size from documents
),
s as (
  select source, cast(sum(size) as bigint) as source_size,
    cast([{", ".join(map(str, WEIGHTS))}][1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}] as bigint) as weight
  from d group by source
),
f(step, spent, open_weight, stopped) as (
  select 0, cast(0 as bigint), cast((select sum(weight) from s) as bigint), cast(0 as bigint)
  union all
  select step + 1, n.spent, n.open_weight, n.stopped
  from f, lateral (
    select cast(coalesce(sum({LIMIT} * source_size) filter (above), 0) as bigint) as spent,
      cast(coalesce(sum(weight) filter (not above), 0) as bigint) as open_weight, count(*) filter (above) as stopped
    from (select *, cast(((select sum(source_size) from s) - f.spent) * weight as double) / f.open_weight > {LIMIT} * source_size as above from s)
  ) n
  where n.stopped > f.stopped
),
l as (select * from f order by step desc limit 1),
t as (
  select source, source_size, least(
    cast(((select sum(source_size) from s) - (select spent from l)) * weight as double) / (select open_weight from l),
    cast({LIMIT} * source_size as double)) as target,
    cast(cast('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 13) as bigint) as double) / 4503599627370496.0 as start
  from s
),
p as (
  select d.*, source_size, target, start, target / source_size as rate, row_number() over (
    partition by d.source order by size, cast('0x' || substr(md5('{SEED}:' || cast(doc_id as varchar)), 1, 13) as bigint), doc_id) as place
  from d join t on d.source is not distinct from t.source
)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(size * (floor(rate) + floor(start + place * (rate - floor(rate))) - floor(start + (place - 1) * (rate - floor(rate)))) as bigint) as taken
from p
"""
