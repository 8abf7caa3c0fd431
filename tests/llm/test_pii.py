import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from brute import masked, pii, sha
from kinweave.llm import pii_bootstrap

SCHEMA = "doc_id long, text string, n_chars int, base string, id string"
ODD = ["", None, "a@b.c", "x.a@b.c@d.e f@g", "a@b..c", "@b.c", "a@b.c_x@d.e", "é ü a.b-c@d-e.f.g. z", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.00255",
       "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111 1111 1111", "+1 (988) 555-2485", "+1(", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
       "+123.123.123.123", "a+1 555 123 4567@x.com", "9" * 30, "1-" * 400 + "1", "1 " * 9000, "a@" + "b." * 5000 + "c", "x" * 30000 + "@" + "y.z", "0" * 50000,
       "\n".join(f"u{i}@h.com {i % 300}.0.0.1" for i in range(700)), "日本 a@b.c 😀 +4912345678 x"]


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else len(t), "x", "y") for i, t in rows], SCHEMA)


def expected(i, text):
    spans = pii(text)
    written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (i, *(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")), sha(written.encode()))


def test_rules_match_brute_force(spark):
    rows = list(enumerate(ODD)) + [(None, "a@b.c"), (None, "a@b.c"), (3, "other 1.2.3.4")]
    got = pii_bootstrap.report(rows_of(spark, rows)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(expected(i, t) for i, t in rows)
    assert pii_bootstrap.report(rows_of(spark, [])).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab@.-+_ 0123456789(é"), max_size=60), min_size=150, max_size=150))
def test_rules_match_brute_force_on_any_text(spark, texts):
    got = pii_bootstrap.base_spans(rows_of(spark, list(enumerate(texts)))).select("doc_id", "_base").collect()
    assert {r["doc_id"]: [(pii_bootstrap.KINDS[s[0]], s[1], s[2]) for s in r["_base"]] for r in got} == {i: pii(t) for i, t in enumerate(texts)}


def contexts():
    """A trusted context with unseen forms, a doubtful one, and clean numbers."""
    rows = [(i, f"note {i} please phone me at +1 (555) 010-{1000 + i} today") for i in range(40)]
    rows += [(100 + i, f"well please phone me at (555) 020-{2000 + i} today") for i in range(3)]
    rows += [(200 + i, f"and the number of +1 (555) 030-{3000 + i} ran") for i in range(6)] + [(300 + i, f"and the number of 10{40000 + i} ran") for i in range(12)]
    rows += [(400, "elsewhere (555) 020-2001 again"), (401, "a sum of 1234567 was paid"), (402, "call me at 12"), (403, None)]
    return rows


def test_contexts_find_unseen_identifiers(spark):
    got = {r["doc_id"]: r for r in pii_bootstrap.report(rows_of(spark, contexts())).collect()}
    texts = dict(contexts())
    for i in (100, 101, 102, 400):
        value = "(555) 020-" + ("2001" if i == 400 else str(1900 + i))
        at = texts[i].index(value)
        assert got[i]["spans"] == f"phone:{at}:{at + len(value)}" and got[i]["n_phone"] == 0
    assert all(got[i]["spans"] == "" for i in [*range(300, 312), 401, 402, 403])
    assert all(got[i]["base_sha256"] == expected(i, t)[-1] for i, t in texts.items())


def test_discovered_instances_support_new_contexts(spark):
    """A context without any seed is trusted for what other contexts made known, and so on to the end."""
    rows = [(i, f"note {i} please phone me at +1 (555) 010-{1000 + i} today") for i in range(40)]
    rows += [(100 + i, f"well please phone me at (555) 020-{2000 + i} today") for i in range(8)]
    rows += [(200 + i, f"or kindly ring desk (555) 020-{2000 + i} now") for i in range(8)] + [(300 + i, f"or kindly ring desk (555) 040-{4000 + i} now") for i in range(1)]
    rows += [(400, "elsewhere it was (555) 040-4000 that rang"), (401, "elsewhere it was (555) 050-5000 that rang")]
    got = {r["doc_id"]: r["spans"] for r in pii_bootstrap.report(rows_of(spark, rows)).collect()}
    for i, text in rows:
        value = text[text.index("(555)"):][:14]
        at = text.index(value)
        want = "" if i == 401 else f"phone:{at}:{at + 14}"
        assert (got[i] if i >= 100 else want) == want, text
    early = {r["doc_id"]: r["spans"] for r in pii_bootstrap.report(rows_of(spark, rows), rounds=1).collect()}
    assert early[100] and not early[300] and not early[400]


def scores_by_hand(edges, trust, support):
    """The same fixed point on plain dictionaries."""
    members, got = {}, {}
    for kind, context, value, seed in edges:
        members.setdefault((kind, context), []).append(((kind, value), seed))
    while True:
        new = {}
        for rows in members.values():
            scores = [pii_bootstrap._UNIT if seed else got.get(v, 0) for v, seed in rows]
            score = sum(scores) // len(scores)
            if score >= trust * pii_bootstrap._UNIT and sum(x > 0 for x in scores) >= support:
                for v, seed in rows:
                    if not seed:
                        new[v] = max(new.get(v, 0), score)
        if new == got:
            return got
        got = new


def test_scores_come_to_rest_where_they_do_by_hand(spark):
    draw = random.Random(3)
    edges = {(k, f"c{draw.randrange(12)}", f"v{v}", v % 3 > 0) for k in (0, 3) for v in range(60) for _ in range(3)}
    edges |= {(0, f"d{i}", f"w{j}", i == 0 and j < 6) for i in range(6) for j in range(6 * i, 6 * i + 8)}
    table = spark.createDataFrame(sorted(edges), "kind int, context string, value string, seed boolean")
    for trust, support in ((0.6, 3), (0.7, 5)):
        got = {(r["kind"], r["value"]): r["score"] for r in pii_bootstrap._learn(table, None, trust, support).collect()}
        assert got == scores_by_hand(edges, trust, support)
        assert got


def test_redacting(spark):
    rows = contexts() + [(500 + i, t) for i, t in enumerate(ODD)]
    table = rows_of(spark, rows)
    out = pii_bootstrap.redact(table)
    assert out.columns == table.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        text = got[i]["text"]
        assert (text is None) == (t is None) and got[i]["n_chars"] == (None if t is None else len(text))
        spans = sorted(pii(t), key=lambda s: s[1])
        if not any(b[1] < a[2] for a, b in zip(spans, spans[1:])) and i not in (100, 101, 102, 400):
            assert text == (t and masked(t, spans)), i
        assert not text or "@b" not in text or not pii(text)
    assert got[101]["text"] == "well please phone me at [PHONE] today"
    twice = pii_bootstrap.redact(rows_of(spark, [(1, "a@b.c"), (1, "a@b.c"), (1, "z"), (None, "1.2.3.4")]))
    assert sorted(r["text"] for r in twice.collect()) == ["[EMAIL]", "[EMAIL]", "[IP]", "z"]
    assert pii_bootstrap.redact(rows_of(spark, [])).count() == 0
