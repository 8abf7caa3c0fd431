"""Captures in ranges, and state kept by key over micro-batches and restarts."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from kinweave.sources import hl7
from kinweave.streaming import adt, keyed

MESSAGE = "MSH|^~\\&|A|B|||2024||ADT^A08|{0}|P|2.5.1\rPID|1||U{0}é"


def capture(n: int) -> bytes:
    """Frames with noise, an end without its return, an open frame and an empty one among them."""
    made = b"noise \x1c\r before"
    for i in range(n):
        body = MESSAGE.format(i).encode() + b"x" * (i % 37)
        made += {3: b"\x0bcut", 5: b"\x0bbad\x1cX", 7: b"\x0b\x1c\r"}.get(i % 10, b"")
        made += b"\x0b" + body + b"\x1c\r" + (b"noise" if i % 4 == 0 else b"")
    return made


def read(spark, path, range_bytes, **limits):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    try:
        good, bad = hl7.read_mllp_capture(spark, path, **limits)
        name = lambda r: r["path"].rsplit("/", 1)[1]
        return (sorted((name(r), r["position"], r["message"]) for r in good.collect()),
                sorted((name(r), r["position"], r["problem"]) for r in bad.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("limits", [{}, {"max_bytes": 60}])
def test_ranges_of_a_capture_give_the_rows_of_the_whole(spark, tmp_path, limits):
    (tmp_path / "a.bin").write_bytes(capture(60))
    (tmp_path / "b.bin").write_bytes(b"\x0b" + capture(20))
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "quiet.bin").write_bytes(b"no frame at all")
    whole = read(spark, str(tmp_path), 1 << 27, **limits)
    assert whole == read(spark, str(tmp_path), 64, **limits) == read(spark, str(tmp_path), 1001, **limits)
    expected = []
    for name in ("a.bin", "b.bin"):
        for position, piece in enumerate((tmp_path / name).read_bytes().split(b"\x0b")):
            body, end, rest = piece.partition(b"\x1c")
            if position and end and rest.startswith(b"\r") and len(body) <= limits.get("max_bytes", 1 << 30):
                expected.append((name, position, body.decode()))
    assert whole[0] == sorted(expected)
    problems = {p for _, _, p in whole[1]}
    assert {"unterminated-frame", "end-block-without-carriage-return"} <= problems
    assert ("message-too-long" in problems) == bool(limits)


def test_written_captures_are_read_back(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("MSH|é"), F.col("id").cast("string"), F.lit("\rPID")).alias("message"))
    hl7.write_mllp_capture(rows, str(tmp_path / "out"))
    good, bad = hl7.read_mllp_capture(spark, str(tmp_path / "out"))
    assert bad.count() == 0
    assert sorted(r["message"] for r in good.collect()) == sorted(r["message"] for r in rows.collect())


def test_captures_as_a_stream(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.bin").write_bytes(capture(12))
    got = []

    def handle(good, bad, epoch):
        got.append((epoch, [r["message"] for r in good.orderBy("arrival").collect()], bad.count()))

    def run():
        adt.stream_captures(spark, str(landing), handle, str(tmp_path / "cp")).awaitTermination()

    run()
    (landing / "b.bin").write_bytes(b"noise\x0bsecond\x1c\r")
    run()  # a restart reads the new file alone
    good, bad = hl7.read_mllp_capture(spark, str(landing / "a.bin"))
    assert got == [(0, [r["message"] for r in good.orderBy("position").collect()], bad.count()), (1, ["second"], 0)]
    assert bad.count() == 2


ROWS = "k string, uid long, arrival timestamp, digest string, response string"


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1, 0, minute)


def land(spark, folder, rows):
    spark.createDataFrame(rows, ROWS).write.mode("append").parquet(str(folder))


def answer(spark, tmp_path, keep_ms=0):
    stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    states = keyed.first_answers(stream, "k", "digest", "response", ["arrival", "uid"], keep_ms)
    keyed.stream_deltas(states, str(tmp_path / "out"), str(tmp_path / "cp"), "append").awaitTermination()
    return {r["uid"]: (r["receipt_state"], r["stored_response"])
            for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_first_answers_over_batches_and_a_restart(spark, tmp_path):
    land(spark, tmp_path / "in", [
        ("a", 2, at(2), "d1", "r2"), ("a", 1, at(1), "d1", "r1"), ("a", 3, at(3), "d2", "r3"),
        (None, 4, at(1), "d1", "r4"), (None, 5, at(1), "d1", "r5"), ("n", 6, at(1), None, None),
        ("n", 7, at(2), None, None), ("", 8, None, "d1", "r8"), ("", 9, at(0), "d1", "r9")])
    first = {1: ("fresh", None), 2: ("replay", "r1"), 3: ("conflict", "r1"), 4: ("fresh", None), 5: ("fresh", None),
             6: ("fresh", None), 7: ("conflict", None), 8: ("fresh", None), 9: ("replay", "r8")}
    assert answer(spark, tmp_path) == first
    # An earlier row that comes in a later batch does not displace the answer given.
    land(spark, tmp_path / "in", [("a", 10, at(0), "d2", "r10"), ("a", 11, at(9), "d1", "r11"), ("b", 12, at(0), "d", "r12"),
                                  ("n", 13, at(0), "d", "r13")])
    later = {10: ("conflict", "r1"), 11: ("replay", "r1"), 12: ("fresh", None), 13: ("conflict", None)}
    assert answer(spark, tmp_path) == first | later


def test_answers_are_forgotten(spark, tmp_path):
    land(spark, tmp_path / "in", [("a", 1, at(1), "d", "r1")])
    answer(spark, tmp_path, keep_ms=1)
    time.sleep(0.1)
    land(spark, tmp_path / "in", [("a", 2, at(2), "d", "r2"), ("a", 3, at(3), "d", "r3")])
    assert answer(spark, tmp_path, keep_ms=1) == {1: ("fresh", None), 2: ("fresh", None), 3: ("replay", "r2")}


def test_first_answers_refuse_clashing_columns(spark):
    rows = spark.createDataFrame([("a", "d", "r", "x")], "k string, digest string, response string, receipt_state string")
    with pytest.raises(ValueError, match="receipt_state"):
        keyed.first_answers(rows, "k", "digest", "response", ["digest"], 0)


def test_latest_rows_over_batches_and_a_restart(spark, tmp_path):
    def run():
        stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
        newest = keyed.latest_rows(stream, ["k"], ["arrival", "uid"])
        keyed.stream_deltas(newest, str(tmp_path / "out"), str(tmp_path / "cp"), "update").awaitTermination()
        found = keyed.current(spark, newest.schema, str(tmp_path / "out"), ["k"])
        return {r["k"]: r["uid"] for r in found.collect()}

    land(spark, tmp_path / "in", [("a", 1, at(5), "d", None), ("a", 2, at(5), "d", None), ("b", 3, at(1), "d", None),
                                  (None, 4, at(1), "d", None)])
    assert run() == {"a": 2, "b": 3, None: 4}
    land(spark, tmp_path / "in", [("a", 5, at(4), "d", None), ("b", 6, at(2), "d", None), ("c", 7, None, "d", None)])
    assert run() == {"a": 2, "b": 6, "c": 7, None: 4}
