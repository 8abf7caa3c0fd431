"""Counts that describe a population."""

from pyspark.sql import functions as F

from kinweave.operators import quality
from kinweave.sources import derived


def test_population_counts_activity_identifiers_and_subgroups(spark):
    rows = [  # source, local id, gender, number, traced and gold, active
        ("crm", "a1", "Female", "4857773456", True, True),
        ("crm", "a2", "Female", "4857773456", False, False),
        ("crm", " ", "Male", "4010232137", False, None),
        ("crm", "-bad", None, None, False, True),
        ("billing", "b1", "Male", "4010232137", True, True),
        ("billing", "b2", "Male", "9434765919", False, True),
        (None, "n1", "Male", None, False, True),
    ]
    given = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "k int, source_system string, local_id string, gender string, nhs string, trusted boolean, is_active boolean")
    flat = given.selectExpr(
        "*", "'A' as family", "'B' as given", "date '1980-01-01' as dob", "'x' as line", "'y' as city", "'z' as postcode",
        "'1' as phone", "'e' as email")
    sources = derived.with_profile(flat).join(given.select("k", "is_active"), "k")
    found = {(r["source_system"], r["subgroup"]): r for r in quality.profile_population(sources).collect()}
    assert set(found) == {("crm", None), ("crm", "Female"), ("crm", "Male"), ("crm", "Unknown"), ("billing", None),
                          ("billing", "Male"), (None, None), (None, "Male")}
    names = ("total", "active", "inactive", "missing_ids", "malformed_ids", "nhs_traced", "nhs_untraced",
             "identifier_duplicates", "identifier_collisions")
    assert [found["crm", None][n] for n in names] == [4, 3, 1, 1, 2, 1, 2, 2, 3]
    assert [found["crm", "Female"][n] for n in names] == [2, 1, 1, 0, 0, 1, 1, 2, 2]
    assert [found["billing", None][n] for n in names] == [2, 2, 0, 0, 0, 1, 1, 0, 1]
    assert [found[None, None][n] for n in names] == [1, 1, 0, 0, 0, 0, 0, 0, 0]
    unmarked = quality.profile_population(sources.drop("is_active"), F.lit("all")).collect()
    assert {(r["source_system"], r["subgroup"]): r["active"] for r in unmarked}["crm", "all"] == 4
