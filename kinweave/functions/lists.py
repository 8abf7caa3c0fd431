"""Lists of structs that may be very long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer lists are sorted to find repeats; in shorter ones every two elements are compared.
SHORT = 32


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct(items: Column) -> Column:
    """``array_distinct``, first places kept, whose time does not grow with the square of the list.

    Spark compares every two elements of a list of structs, so a record that owns a hundred thousand
    identifiers would take hours. Elements must be orderable.
    """
    def firsts(ordered: Column) -> Column:
        return F.filter(
            ordered, lambda x, i: (i == 0) | ~x["item"].eqNullSafe(F.get(ordered, i - 1)["item"]))

    def by_sorting(whole: Column) -> Column:
        placed = F.transform(whole, lambda x, i: F.struct(x.alias("item"), i.alias("at")))
        kept = _named(F.sort_array(placed), firsts)
        back = F.sort_array(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["item"].alias("item"))))
        return F.transform(back, lambda x: x["item"])

    return _named(
        items, lambda whole: F.when(F.size(whole) > SHORT, by_sorting(whole)).otherwise(F.array_distinct(whole)))
