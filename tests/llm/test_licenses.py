import random
import textwrap

import duckdb

from kinweave.llm import license_scan
from kinweave.llm.license_texts import TEMPLATES


def scan(spark, rows):
    table = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, unit string, _id double")
    got = license_scan.scan(table)
    assert got.columns == ["doc_id", "license", "dice", "unit", "licenses"]
    return [tuple(r) for r in got.collect()]


def oracle(rows):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    return db.execute(license_scan.oracle()).fetchall()


def fixture():
    draw = random.Random(1)
    noise = lambda n: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))
    rows = [(0, None), (1, ""), (2, noise(3000)), (3, "license"), (4, "the the the the"), (5, "\n\n \n")]
    for k, (_, text) in enumerate(TEMPLATES):
        flat = " ".join(text.split())
        wrapped = "\n".join(textwrap.wrap(flat, 70))
        commented = "/*\n" + "\n".join(" * " + line for line in wrapped.split("\n")) + "\n */"
        words = flat.split()
        worn = " ".join(w for i, w in enumerate(words) if i % 40 != 39)
        broken = " ".join(w for i, w in enumerate(words) if i % 4 != 3)
        rows += [(100 * k + 10 + i, t) for i, t in enumerate((
            flat, f"Copyright (c) 2020 Someone\n\n{wrapped}", f"{commented}\ncode = {noise(5)}\n", f"{noise(40)}\n{flat.upper()}\n{noise(40)}", worn, broken))]
    return rows + [(7, rows[-1][1]), (7, rows[-1][1]), (None, "Released under the MIT Licence")]


def test_scan_matches_sql_without_pruning(spark):
    rows = fixture()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(scan(spark, rows), key=key) == sorted(oracle(rows), key=key)


def test_templates_are_found_and_noise_is_not(spark):
    got = {r[0]: r for r in scan(spark, fixture())}
    for k, (name, _) in enumerate(TEMPLATES):
        for i in (0, 1, 2, 3):
            assert got[100 * k + 10 + i][1] == name and got[100 * k + 10 + i][2] > 0.9, (name, i)
    assert all(got[i][1] is None and got[i][4] == "" for i in range(6))
    assert got[None][1] == "MIT"


def test_bounds_and_triggers_are_exact():
    for size in range(1, 200):
        low, high = license_scan.bounds(size, 0.8)
        reach = [n for n in range(1, 400) if 2 * min(n, size) / (n + size) >= 0.8 - 1e-12]
        assert (low, high) == (reach[0], reach[-1])
    draw = random.Random(4)
    for _, text in TEMPLATES:
        grams = license_scan.bigrams(text)
        low = license_scan.bounds(len(grams), 0.8)[0]
        need, weights = license_scan.triggers(grams, 0.8)
        assert 0 < need <= low
        for _ in range(20):  # any choice of as many bigrams as the lower bound has words that weigh enough
            unit = draw.sample(grams, low)
            assert sum(weights.get(w, 0) for w in {w for g in unit for w in g.split()}) >= need


def test_many_sentences_in_one_text(spark):
    draw = random.Random(6)
    said = lambda n: " ".join(" ".join(draw.choices(["work", "license", "you", "copy", "software", "abc"], k=5)) + "." for _ in range(n))
    got = scan(spark, [(1, f"{said(5000)} Released under the MIT License. {said(5000)}"), (2, said(3000))])
    assert [r[1:4] for r in got] == [("MIT", 1.0, "window"), (None, None, None)]


def published(name):
    """The template's sentences that begin a paragraph where it is published, as paragraphs."""
    starts = {"MIT": ("The above", "THE SOFTWARE IS"), "GPL-3.0": ("This program is distributed",)}[name]
    text = next(body for known, body in TEMPLATES if known == name)
    for start in starts:
        text = text.replace(start, f"\n\n{start}")
    return [" ".join(p.split()) for p in text.split("\n\n")]


def test_licences_of_several_paragraphs_inside_long_texts(spark):
    draw = random.Random(2)
    prose = lambda: "\n\n".join(" ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(60)) + "." for _ in range(4))
    mit, gpl = ("\n\n".join(textwrap.fill(p, 70) for p in published(n)) for n in ("MIT", "GPL-3.0"))
    marked = lambda mark, text: "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))
    rows = [
        (1, f"{prose()}\n\n## Licence\n\nCopyright (c) 2020 Someone\n\n{mit}\n\n{prose()}"),
        (2, marked("#", f"{prose()}\n\n{gpl}") + "\ncode = 1\n"),
        (3, "/*\n" + marked(" *", f"{prose()}\n\n{mit}") + "\n */\ncode = 1\n"),
        (4, f"{prose()} Released under the MIT License. {prose()}"),
        (5, f"{prose()}\n{' '.join(mit.split())} {prose()} {' '.join(gpl.split())}\n{prose()}"),
        (6, prose()),
        (7, "Released under the MIT License.\n" * 500),
        (8, f"{prose()}\n\n{published('MIT')[0]}\n\n{prose()}\n\n{published('MIT')[1]}\n\n{prose()}"),
    ]
    got = {r[0]: r[1:] for r in scan(spark, rows)}
    assert got[1] == ("MIT", 1.0, "window", "MIT") and got[3] == ("MIT", 1.0, "window", "MIT")
    assert got[2] == ("GPL-3.0", 1.0, "window", "GPL-3.0") and got[4] == ("MIT", 1.0, "window", "MIT")
    assert got[5] == ("MIT", 1.0, "window", "GPL-3.0,MIT") and got[7] == ("MIT", 1.0, "line", "MIT")
    assert got[6] == got[8] == (None, None, None, "")


def test_near_twins_get_their_own_name(spark):
    draw = random.Random(3)
    prose = lambda: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(60)) + "."
    names = ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Apache-2.0", "MPL-2.0")
    texts = [(name, body) for name, body in TEMPLATES if name in names and len(body) > 100]
    assert {n for n, body in texts if len(body) > 5000} == set(names[2:])
    assert {n for n, body in texts if len(body) < 2000} == set(names)
    got = {r[0]: r[1:] for r in scan(spark, [(i, f"{prose()}\n\n{body}\n\n{prose()}") for i, (_, body) in enumerate(texts)])}
    for i, (name, _) in enumerate(texts):
        assert got[i][:2] == (name, 1.0), (name, got[i])
