"""Nickname lexicons from a table of canonical names and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.config import MAX_LEXICON_ENTRIES, ConfigurationError, Lexicon
from kinweave.functions.text import norm_words


def build_lexicon(table: DataFrame) -> tuple[Lexicon, ...]:
    """Checked lexicons of (lexicon_version, culture, canonical, alias) rows.

    Names are standardised first. One name in two groups of a lexicon is an error, and so is a
    table of more than 10,000 names; only then are the names brought to the driver.
    """
    lexicon = ["lexicon_version", "culture"]
    named = table.select(
        *lexicon, norm_words(F.col("canonical")).alias("group"), norm_words(F.col("alias")).alias("name")
    )
    names = named.select(*lexicon, "group", "name").union(
        named.select(*lexicon, "group", F.col("group"))
    ).distinct()
    if names.where("group = '' or name = ''").limit(1).count():
        raise ConfigurationError("a nickname row is blank")
    clashes = names.groupBy(*lexicon, "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    worst = clashes.limit(1).collect()
    if worst:
        raise ConfigurationError(f"{worst[0]['name']!r} stands in two nickname groups")
    rows = names.limit(MAX_LEXICON_ENTRIES + 1).collect()
    if len(rows) > MAX_LEXICON_ENTRIES:
        raise ConfigurationError("nickname lexicons hold too many entries")
    made: dict[tuple, dict] = {}
    for row in rows:
        made.setdefault((row["lexicon_version"], row["culture"]), {})[row["name"]] = row["group"]
    return tuple(Lexicon.of(v, culture, groups) for (v, culture), groups in sorted(made.items()))
