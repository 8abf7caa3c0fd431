"""Mixing: targets, copies, and rows of every odd kind."""

from collections import Counter

import pytest

from kinweave.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, place int, copies string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y", 0) for i, t, s in rows], SCHEMA)


def test_targets_stop_at_three_times_a_source(spark):
    # weights 1, 2, 3: b may take 3 words at most; its excess goes to a and c as 1 to 3
    rows = [(1, "w " * 97, "a"), (2, "w", "b"), (3, "w " * 302, "c")]
    got = {r["doc_id"]: r for r in mixing.mix(table(spark, rows)).collect()}
    assert [got[i]["size"] for i in (1, 2, 3)] == [97, 1, 302]
    assert [got[i]["target"] for i in (1, 2, 3)] == pytest.approx([397 / 4, 3.0, 3 * 397 / 4])
    assert got[2]["taken"] == 3 and all(r["taken"] <= 3 * r["size"] for r in got.values())


def test_words_taken_come_near_the_target_for_equal_documents(spark):
    rows = [(i, "a b c", "s") for i in range(400)] + [(1000 + i, "a b c", "t") for i in range(100)]
    out = mixing.allocate(table(spark, rows)).collect()
    for source in "st":
        of = [r for r in out if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in of) - of[0]["target"]) <= 3


def test_nulls_repeats_and_reruns(spark):
    rows = [(1, None, None), (None, "a b", None), (2, "", "s"), (2, "  \x1c\n\x0b", "s"), (3, "a  b\tc", "s")]
    rows += [(7, "same text here", "hot")] * 60 + [(8, None, "empty")]
    got = [mixing.mix(table(spark, rows).repartition(n)).collect() for n in (2, 5)]
    assert Counter(map(tuple, got[0])) == Counter(map(tuple, got[1])) and len(got[0]) == len(rows)
    sizes = Counter(r["size"] for r in got[0])
    assert sizes[3] == 61 and sizes[2] == 2 and sizes[0] == 3
    hot = [r for r in got[0] if r["doc_id"] == 7]
    assert abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 3  # rows that repeat an id draw by themselves
    assert all(r["taken"] == 0 and r["target"] == 0 for r in got[0] if r["doc_id"] == 8)


def test_emitted_rows_and_empty_tables(spark):
    docs = table(spark, [(i, "a b c d", "s" if i % 2 else None) for i in range(40)])
    plan = {r["doc_id"]: r["taken"] // 4 for r in mixing.mix(docs).collect()}
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in plan.items() if n})
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.emit(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [(1, None, "s")])).first()["taken"] == 0
