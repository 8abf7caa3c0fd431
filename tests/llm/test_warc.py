import hashlib
import random

import pytest

from kinweave.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, row int"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in rows], SCHEMA)


def expected(rows):
    """{(page, bytes, digest, type, refers)} by the contract."""
    stored = {}
    for i, _, h in rows:
        if i is not None:
            stored[h or ""] = max(stored.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        other = i is not None and len(data) >= 1000 and i < stored[h or ""]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", stored[h or ""] if other else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    draw = random.Random(1)
    body = lambda n: "".join(draw.choice("abc é\r\n<0123456789abcdef>") for _ in range(n))
    copies, short = body(3000), body(900)
    rows = [(i, f"http://x/{i}", body(draw.choice([0, 10, 999, 1000, 5000, 40000]))) for i in range(40)]
    rows += [(100 + i, None, copies) for i in range(20)] + [(200 + i, "u\nv", short) for i in range(3)]
    rows += [(300, "u", None), (301, "u", ""), (None, "n", copies), (302, "w", "WARC/1.1\r\n\r\n0\r\n\r\n" * 90), (303, "r", copies), (303, "r", copies)]
    got = warc.round_trip(table(spark, rows)).collect()
    assert all(r["problem"] is None for r in got)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
    assert warc.round_trip(table(spark, [])).count() == 0


def records(pages):
    """The parsed records of some pages as rows."""
    made = [r for page in pages for r in warc.page_records(*page)]
    out = []
    for h, block in warc.parse_archive(b"".join(r + b"\r\n\r\n" for r in made)):
        whole = lambda name: int(h[name]) if h.get(name) else None
        out.append((h.get("WARC-Segment-Origin-ID") or h["WARC-Record-ID"], h["WARC-Type"], whole("Page-ID"), whole("Page-Refers-To"), h.get("WARC-Refers-To"),
                    h.get("WARC-Payload-Digest"), whole("WARC-Segment-Number"), whole("WARC-Segment-Total-Length"), bytearray(block)))
    return out


def test_damaged_segments(spark):
    body = bytes(range(256)) * 60
    one = lambda i: records([(i, 0, "u", body)])
    whole, gap, headless, endless, short, twice = (one(i) for i in range(6))
    del gap[1], headless[0], endless[-1]
    short[1] = (*short[1][:-1], short[1][-1][:-1])
    twice += twice[:2]
    shuffled = whole + gap + headless + endless + short + twice
    random.Random(2).shuffle(shuffled)
    read = spark.createDataFrame(shuffled, warc._RECORD)
    got = {r["origin"]: r for r in warc.payloads(warc.reassemble(read)).collect()}
    name = lambda i: got[warc.record_id(i, 0)]
    assert [name(i)["problem"] for i in range(6)] == [None, "gap", "no origin", "no end", "length", None]
    assert bytes(name(0)["payload"]) == body and bytes(name(5)["payload"]) == body and name(1)["payload"] is None


def test_chunked_framing():
    for body in (b"", b"x", b"0\r\n\r\n", bytes(5000)):
        for size in (1, 7, 5000):
            assert warc.dechunked(warc.chunked(body, size)) == body
    assert warc.dechunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"3\r\nabcd\r\n0\r\n\r\n", b"z\r\n", b"-1\r\n\r\n", b"3\r\nabc\r\n", b"3\r\nabc\r\n0\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_broken_framing_and_wrong_digests_are_named(spark):
    rows = [("a", "response", 1, None, None, "sha1:AAAA", None, None, bytearray(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz")),
            ("b", "response", 2, None, None, "sha1:AAAA", None, None, bytearray(b"HTTP/1.1 200 OK\r\n\r\nplain")),
            ("c", "response", 3, None, None, None, None, None, bytearray(b""))]
    got = {r["origin"]: r for r in warc.payloads(warc.reassemble(spark.createDataFrame(rows, warc._RECORD))).collect()}
    assert (got["a"]["problem"], got["b"]["problem"], got["c"]["problem"]) == ("framing", "digest", None)
    assert bytes(got["b"]["payload"]) == b"plain"


def test_cut_archives_are_errors():
    made = b"".join(r + b"\r\n\r\n" for r in warc.page_records(1, 0, "u", b"x" * 100))
    assert len(list(warc.parse_archive(made))) == 1
    for bad in (made[:-1], made[5:], made + b"x"):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))
