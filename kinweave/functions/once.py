"""Keep costly columns from being evaluated again by what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns``, behind a one-row ``explode``.

    The optimizer copies a projected expression into every filter and projection that mentions its
    alias. It does not look through a generator, so these columns are evaluated once per row.
    """
    kept = [name for name in df.columns if name not in columns]
    one = F.array(F.struct(*(value.alias(name) for name, value in columns.items())))
    return df.select(*kept, F.explode(one).alias("_once")).select(*kept, "_once.*")
