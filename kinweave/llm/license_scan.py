"""Licences in whole texts, by the Dice coefficient of word bigrams with licence templates.

A text is compared as a whole, by paragraph, by block of comment lines, by line, and by windows of
consecutive sentences and paragraphs. All of it is DataFrame operations on the row, without a shuffle:
a template is compared only with units whose number of bigrams allows the threshold, and texts in which
no template could reach it are left out by their words.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.once import computed_once
from kinweave.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
_COMMENT = r"[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+)"
_COPYRIGHT = r"[ \t]*(?:copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*"
#: Letters and digits, and versions like 2.0 as one word.
_WORD = r"[\p{L}\p{N}]++(?:[.][0-9]++)*+"
_BLANK = r"\n[ \t\r]*\n"
_COMMENTS = rf"(?:(?<![^\n]){_COMMENT}[^\n]*+(?:\n|$)){{2,}}+"
#: Ends of sentences.
_BREAK = r"(?<=[.!?;:])[\x22\x27)\]]*\s+"
#: A window holds at most so many times the bigrams that the size bound allows distinct ones.
_REPEATS = 4
#: Windows for templates of more bigrams start and end with paragraphs, not with every sentence.
_LONG = 300
#: Numbers that are summed up at a time.
_SUMS = 64
#: Words too common to tell a licence by.
_COMMON = frozenset("a all an and any are as at be by for from in is it its may not of on or other that the this to under use with you".split())


def words(text: str) -> list[str]:
    """A template's words as they are compared: lower case, without comment marks and copyright lines."""
    text = re.sub(rf"(^|\n){_COMMENT}", r"\1 ", text.lower())
    text = re.sub(rf"(^|\n){_COPYRIGHT}", r"\1 ", text).replace("licence", "license")
    return re.findall(r"[^\W_]+(?:[.][0-9]+)*", text)


def bigrams(text: str) -> list[str]:
    found = words(text)
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the threshold with a template of ``size``."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def triggers(grams: list[str], threshold: float) -> tuple[int, dict[str, int]]:
    """(need, weights of words): a unit that reaches the threshold has words that weigh ``need`` together.

    Each bigram is laid to one of its words, tell-tale words first, and a word weighs the bigrams laid to
    it. A unit that reaches the threshold shares at least the lower bound of bigrams; of these it can
    have no more than its words weigh and the few that are laid to no word.
    """
    low, open_, weights = bounds(len(grams), threshold)[0], set(grams), {}
    while 4 * len(open_) >= low:
        counts = Counter(w for g in open_ for w in set(g.split()) if w.isalpha())
        best = max(counts, key=lambda w: (w not in _COMMON, counts[w], w), default=None)
        if best is None:
            break
        weights[best] = counts[best]
        open_ = {g for g in open_ if best not in g.split()}
    return low - len(open_), weights


def _literal(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


#: Distinct bigrams of the words ``w``.
_GRAMS = "if(size(w) < 2, cast(array() as array<string>), array_distinct(transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))))"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _plain(body: str) -> str:
    """Lower case, without comment marks and copyright lines."""
    for pattern in (_COMMENT, _COPYRIGHT):
        body = f"regexp_replace({body if pattern is _COPYRIGHT else f'lower({body})'}, {_raw(rf'(^|\n){pattern}')}, '$1 ')"
    return body


def _split_words(plain: str) -> str:
    return f"regexp_extract_all(replace({plain}, 'licence', 'license'), {_raw(_WORD)}, 0)"


def _pieces() -> str:
    """Lines of sentences: distinct bigrams ``g``, bigram ``c`` into the next piece, whether a sentence and a paragraph start and end with it.

    Empty comment lines part paragraphs: they are blank once their marks are gone.
    """
    lines = f"filter(transform(split(h, '\\n'), x -> {_split_words('x')}), w -> size(w) > 0)"
    flags = _let("l", lines, "transform(l, (w, k) -> named_struct('w', w, 'opens', k = 0, 'closes', k = size(l) - 1))")
    sentences = f"flatten(transform(split(q, {_raw(_BREAK)}), h -> {flags}))"
    marked = _let("ss", sentences, "transform(ss, (p, k) -> named_struct('w', p.w, 'opens', p.opens, 'closes', p.closes, 'begins', k = 0, 'ends', k = size(ss) - 1))")
    cut = f"flatten(transform(split({_plain('_body')}, {_raw(_BLANK)}), q -> {marked}))"
    return _let("ps", cut, f"""transform(ps, (p, k) -> named_struct('g', {_let('w', 'p.w', _GRAMS)},
      'c', concat(element_at(p.w, -1), ' ', get(ps, k + 1).w[0]), 'opens', p.opens, 'closes', p.closes, 'begins', p.begins, 'ends', p.ends))""")


def _spread(sizes: str) -> str:
    """Sums of x + 1 over all beginnings of an array: first of whole blocks, then on from the block's."""
    add = "0, (c, x) -> c + x + 1"
    blocks = f"aggregate(sequence(0, size(v) div {_SUMS}), array(0), (a, k) -> concat(a, array(element_at(a, -1) + aggregate(slice(v, {_SUMS} * k + 1, {_SUMS}), {add}))))"
    on = f"transform(sequence(0, size(v)), k -> sb[k div {_SUMS}] + aggregate(slice(v, {_SUMS} * (k div {_SUMS}) + 1, k % {_SUMS}), {add}))"
    return _let("v", sizes, _let("sb", blocks, on))


def _windows(threshold: float) -> str:
    """Pairs (i, j) of pieces, as i * 2^32 + j, between which a window may reach the threshold with template ``t``.

    At its ends are pieces of which a share of half the threshold lies in the template: others only lower
    the coefficient. It starts and ends with a sentence (for long templates, a paragraph), or where such
    pieces start and end.
    """
    pairs = f"""flatten(transform(filter(sequence(0, size(_p) - 1), i -> r[i] and (if(t.m > {_LONG}, _p[i].begins, _p[i].opens) or not coalesce(get(r, i - 1), false))), i ->
      transform(filter(sequence(i, least(i + {_REPEATS} * t.high, size(_p) - 1)), j -> r[j] and (if(t.m > {_LONG}, _p[j].ends, _p[j].closes) or not coalesce(get(r, j + 1), false))
        and sums[j + 1] - sums[i] > t.low and ends[j + 1] - ends[i] <= {_REPEATS} * t.high + 1), j -> shiftleft(bigint(i), 32) + j)))"""
    pairs = _let("ends", _spread("transform(_p, p -> size(p.g))"), pairs)
    pairs = _let("sums", _spread("s"), pairs)
    pairs = _let("r", f"transform(s, (x, k) -> x > 0 and x >= {threshold / 2}D * size(_p[k].g))", pairs)
    return _let("s", "transform(_p, p -> size(array_intersect(t.grams, p.g)))", pairs)


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, license, dice, unit, licenses) of every row.

    ``license`` is the template that comes nearest in any unit (whole, paragraph, comment, line, window:
    then ``unit``), with its coefficient; of equals the larger template, then the first by name, then the
    first unit by name. ``licenses`` names all that reach the threshold, sorted and comma-joined, and
    is empty where none does; license, dice and unit are null then. Windows are runs of consecutive
    sentences, also across paragraphs and comment lines (for templates of more than 300 bigrams, of
    consecutive paragraphs or all that resembles the template); a window counts for its nearest template alone. Null and empty texts have none.
    Repeated rows and null ids come back as they are; other columns are not read.
    """
    prepared = [(name, bigrams(body)) for name, body in templates]
    structs, needs, hints = [], [], set()
    for k, (name, grams) in enumerate(prepared):
        low, high = bounds(len(grams), threshold)
        need, weights = triggers(grams, threshold)
        hints |= set(weights)
        needs.append(f"named_struct('k', {k}, 'need', {need}, 'words', map_from_arrays({_literal(weights)}, array({', '.join(map(str, weights.values()))})))")
        structs.append(f"named_struct('k', {k}, 'id', '{name}', 'm', {len(grams)}, 'low', {low}, 'high', {high}, 'grams', split('{'|'.join(grams)}', '[|]'))")
    hints |= {h.replace("license", "licence") for h in hints}
    known = f"filter(array({', '.join(structs)}), t -> array_contains(_ok, t.k))"
    near = """transform(filter(_known, t -> size(g) between t.low and t.high), t ->
      named_struct('dice', cast(2 * size(array_intersect(g, t.grams)) as double) / (size(g) + t.m), 'm', t.m, 'id', t.id, 'unit', _unit))"""
    order = "case when a.dice <> b.dice then if(a.dice > b.dice, -1, 1) when a.m <> b.m then b.m - a.m when a.id <> b.id then if(a.id < b.id, -1, 1) when a.unit < b.unit then -1 when a.unit > b.unit then 1 else 0 end"
    reached = f"filter({near}, x -> x.dice >= {threshold}D)"
    unit = "named_struct('unit', '{}', 'body', {})".format
    units = f"""concat(
      transform(split(_body, '\\n'), x -> {unit('line', 'x')}),
      transform(filter(split(_body, {_raw(_BLANK)}), x -> contains(x, '\\n')), x -> {unit('paragraph', 'x')}),
      transform(regexp_extract_all(_body, {_raw(_COMMENTS)}, 0), x -> {unit('comment', 'x')}),
      if(contains(_body, '\\n'), array({unit('whole', '_body')}), array()))"""
    found = f"flatten(transform({units}, u -> {_let('w', _split_words(_plain('u.body')), _let('g', _GRAMS, reached.replace('_unit', 'u.unit')))}))"
    window = "array_distinct(concat(flatten(transform(slice(_p, v.i + 1, v.j - v.i), p -> concat(p.g, array(p.c)))), _p[v.j].g))"
    nearest = f"slice(array_sort({reached.replace('_unit', repr('window'))}, (a, b) -> {order}), 1, 1)"
    windows = f"""if(size(_own) = 0, array(), flatten(transform(
      array_distinct(flatten(transform(_own, t -> {_windows(threshold)}))), n -> {_let('v', "named_struct('i', int(shiftright(n, 32)), 'j', int(n & 4294967295))", _let('g', window, nearest.replace('_known', '_own')))})))"""
    own = f"""{_let('b', "array_distinct(flatten(transform(_p, p -> if(p.c is null, p.g, concat(p.g, array(p.c))))))",
                    f"""filter(transform(filter({known}, t -> size(b) >= t.low), t ->
                      named_struct('id', t.id, 'm', t.m, 'low', t.low, 'high', t.high, 'grams', array_intersect(b, t.grams))), t -> size(t.grams) >= t.low)""")}"""
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_body"))
    met = f"array_intersect(split(lower(_body), {_raw('[^\\p{L}\\p{N}]+')}), {_literal(sorted(hints))})"
    met_rows = computed_once(rows, {"_met": F.expr(f"array_distinct(transform({met}, w -> replace(w, 'licence', 'license')))")})
    weighed = "aggregate(_met, 0, (a, w) -> a + coalesce(element_at(t.words, w), 0)) >= t.need"
    able = f"if(size(_met) = 0, cast(array() as array<int>), transform(filter(array({', '.join(needs)}), t -> {weighed}), t -> t.k))"
    hinted = computed_once(met_rows, {"_ok": F.expr(able)}).drop("_met")
    pieces = computed_once(hinted, {"_p": F.expr(f"case when size(_ok) > 0 then {_pieces()} end")})
    chosen = computed_once(pieces, {"_own": F.expr(f"case when size(_ok) > 0 then {own} else array() end")})
    matched = computed_once(chosen, {"_found": F.expr(
        f"case when size(_ok) > 0 then array_sort(concat({_let('ks', known, found.replace('_known', 'ks'))}, {windows}), (a, b) -> {order}) else array() end")})
    return matched.select(
        F.col("_id").alias(doc_id), F.expr("get(_found, 0).id").alias("license"), F.expr("get(_found, 0).dice").alias("dice"),
        F.expr("get(_found, 0).unit").alias("unit"), F.expr("coalesce(array_join(array_sort(array_distinct(transform(_found, x -> x.id))), ','), '')").alias("licenses"))


def oracle(threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """DuckDB SQL for ``scan`` over ``documents``: every unit against every template, nothing pruned."""
    rows = ",\n".join("('{}', [{}])".format(name, ", ".join("'" + g.replace("'", "''") + "'" for g in bigrams(body))) for name, body in templates)
    clean = (
        rf"replace(regexp_replace(regexp_replace(lower(body), '(^|\n){_COMMENT}', '\1 ', 'g'), '(^|\n){_COPYRIGHT}', '\1 ', 'g'), 'licence', 'license')")
    return rf"""
with t(id, grams) as (values {rows}),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as body from documents),
u as (
  select r, 'line' as unit, unnest(string_split(body, chr(10))) as body from d
  union all select * from (select r, 'paragraph' as unit, unnest(regexp_split_to_array(body, '{_BLANK}')) as body from d) where contains(body, chr(10))
  union all select r, 'comment' as unit, unnest(regexp_extract_all(body, '(?m)(?:^{_COMMENT}[^\n]*(?:\n|\z)){{2,}}')) as body from d
  union all select r, 'whole' as unit, body from d where contains(body, chr(10))
),
w as (select r, unit, regexp_extract_all({clean}, '[\p{{L}}\p{{N}}]+(?:[.][0-9]+)*') as w from u),
g as (select r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) > 1),
m as (
  select r, unit, id, len(grams) as m, cast(2 * len(list_intersect(g, grams)) as double) / (len(g) + len(grams)) as dice
  from g, t where list_has_any(g, grams)
),
best as (
  select r, id, dice, unit, row_number() over (partition by r order by dice desc, m desc, id, unit) as place,
    string_agg(distinct id, ',' order by id) over (partition by r) as ids
  from m where dice >= {threshold}
)
select doc_id, id as license, dice, unit, coalesce(ids, '') as licenses
from d left join (select * from best where place = 1) using (r)
"""
