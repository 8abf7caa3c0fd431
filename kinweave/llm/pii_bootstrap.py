"""Personal data in whole texts: fixed rules, and contexts that are learned from what they find.

The fixed rules find e-mail addresses, IP addresses, payment cards and telephone numbers. Their finds
are the seeds of a graph of contexts and instances: contexts in which nearly everything of a shape is
known are trusted, what else stands in a trusted context becomes known with the context's score, and
lends it to the other contexts in which it stands. The scores are taken again until none changes. All
of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.once import computed_once
from kinweave.llm.common import stage

#: Kinds in the order of the results.
KINDS = ("email", "ip", "card", "phone")
#: A context is trusted from this mean score of its instances, and this many different known ones on.
TRUST = 0.8
SUPPORT = 5
#: Scores are whole numbers of this part of one, rounded down, so that they come to rest.
_UNIT = 100
_STEP = 64

_LOCAL = "A-Za-z0-9._%+-"
# An address starts where its run of characters starts or the last match ended; nothing behind a
# possessive quantifier could take back what it took. So every pattern is linear in the text.
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
#: What a text must have for the costly pattern to be worth a try.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
# Anything that looks like one of the kinds, known or not: addresses, hexadecimal groups, numbers.
_LIKE = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
    r"|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])"
    r"|[+(]?[0-9](?:[\x20()./-]{0,2}[0-9])++"
)


def _text(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _valid(kind: str, value: str) -> str:
    """SQL: does a match of the kind's pattern pass its check?"""
    if kind == "ip":
        return f"{value} rlike {_text(f'^{_BYTE}(?:[.]{_BYTE}){{3}}$')}"
    if kind == "phone":
        return f"length({_digits(value)}) between 8 and 15"
    if kind == "card":
        # from the right every second digit counts twice, less 9 where that has two digits
        luhn = (
            "aggregate(sequence(1, length(d)), 0, (sum, i) -> sum + if((length(d) - i) % 2 = 0, "
            "int(substring(d, i, 1)), int(substring('0246813579', int(substring(d, i, 1)) + 1, 1)))) % 10 = 0"
        )
        return f"exists(array({_digits(value)}), d -> length(d) between 16 and 19 and {luhn})"
    return "true"


def _located(text: str, pattern: str) -> str:
    """SQL: array of (start, end, value) of all matches, in code points of the whole text.

    Matches and the gaps between them alternate, so their lengths give the places. The lengths are
    summed up in steps, which keeps a text with very many matches far from quadratic.
    """
    return f"""
    transform(array(named_struct('gaps', split({text}, {_text(pattern)}, -1), 'hits', regexp_extract_all({text}, {_text(pattern)}, 0))), m ->
      transform(array(transform(m.hits, (h, i) -> length(m.gaps[i]) + length(h))), sizes ->
        transform(array(transform(sequence(0, int(size(sizes) / {_STEP})), c -> aggregate(slice(sizes, c * {_STEP} + 1, {_STEP}), 0, (a, x) -> a + x))), sums ->
          transform(array(transform(sequence(0, size(sums) - 1), c -> aggregate(slice(sums, 1, c), 0, (a, x) -> a + x))), bases ->
            transform(m.hits, (h, i) -> transform(
              array(bases[int(i / {_STEP})] + aggregate(slice(sizes, int(i / {_STEP}) * {_STEP} + 1, i % {_STEP}), 0, (a, x) -> a + x) + length(m.gaps[i])),
              s -> named_struct('start', s, 'end', s + length(h), 'value', h))[0]))[0])[0])[0])[0]"""


def _base(kind: str, text: str) -> Column:
    """Spans of a kind by its rule: array of (order, start, end)."""
    order = KINDS.index(kind)
    hint = f"contains({text}, '@')" if kind == "email" else f"{text} rlike {_text(_HINTS[kind])}"
    return F.expr(f"""
    case when {hint} then transform(
      filter({_located(text, _PATTERNS[kind])}, x -> {_valid(kind, 'x.value')}),
      x -> named_struct('kind', {order}, 'start', x.start, 'end', x.end))
    else cast(array() as array<struct<kind:int,start:int,end:int>>) end""")


def base_spans(df: DataFrame, text: str = "text", out: str = "_base") -> DataFrame:
    """``df`` with an array of (kind, start, end) by the fixed rules, ordered by kind and start.

    Each kind is searched by itself, leftmost first and without overlap; null is an empty text. Kinds
    are numbered as in ``KINDS``; places are code points, the end exclusive.
    """
    body = "coalesce(" + f"`{text}`, '')"
    kinds = {f"_{k}": _base(k, body) for k in KINDS}
    return computed_once(df, {out: F.concat(*kinds.values())})


def _mentions(text: str) -> Column:
    """Everything that looks like an identifier, with its value, what it is known as, and contexts."""
    known = " ".join(
        f"when x.value rlike {_text('^(?:' + _PATTERNS[k] + ')$')} and {_valid(k, 'x.value')} then {KINDS.index(k)}" for k in KINDS)
    digits = f"length({_digits('x.value')})"
    shape = f"""case when contains(x.value, '@') then array(0)
      when contains(x.value, ':') or x.value rlike '^[0-9]+([.][0-9]+){{3,}}$' then array(1)
      when {digits} between 12 and 15 then array(2, 3) when {digits} between 16 and 19 then array(2)
      when {digits} between 7 and 11 then array(3) else array() end"""
    word = lambda w: f"lower(regexp_replace({w}, r'[^\\p{{L}}\\p{{N}}<>:=#]', ''))"
    # the words next to a match are in the gaps beside it; a neighbouring match counts as one word
    return F.expr(f"""
    case when contains({text}, '@') or {text} rlike '[0-9]' then
    transform(array(split({text}, {_text(_LIKE)}, -1)), gaps ->
      filter(transform({_located(text, _LIKE)}, (x, i) ->
        transform(array(concat(array('<start>', if(i > 0, '<id>', '<start>')), filter(split(right(gaps[i], 80), r'\\s+'), w -> w <> ''))), l ->
          transform(array(coalesce(get(filter(split(left(gaps[i + 1], 40), r'\\s+'), w -> w <> ''), 0), '<end>')), r ->
            named_struct('start', x.start, 'end', x.end, 'value', x.value, 'known', case {known} end, 'shape', {shape},
              'l2', {word('element_at(l, -2)')}, 'l1', {word('element_at(l, -1)')}, 'r1', {word('r')}))[0])[0]),
        x -> size(x.shape) > 0 or x.known is not null))[0]
    else array() end""")


def _edges(mentions: DataFrame) -> DataFrame:
    """(kind, context, value, seed): distinct; contexts are two words before, one on each side, or a label.

    The nearest word before must be one: the start of a text or another match tells nothing.
    """
    contexts = F.expr("""filter(array(
        concat('2|', l2, ' ', l1), concat('1|', l1, ' _ ', r1), if(l1 rlike '.[:=#]$', concat('0|', l1), null)
      ), c -> c is not null)""")
    kinds = F.expr("if(known is null, shape, array(known))")
    return (
        mentions.where("l1 <> '' and l1 not like '<%'").select(F.explode(kinds).alias("kind"), contexts.alias("contexts"), "value", F.col("known").isNotNull().alias("seed"))
        .select("kind", F.explode("contexts").alias("context"), "value", "seed").distinct()
    )


def _learn(edges: DataFrame, rounds: int | None, trust: float, support: int) -> DataFrame:
    """(kind, value, score) of what trusted contexts made known; seeds are not among them.

    A context's score is the mean score of the different instances that stand in it: ``_UNIT`` for
    seeds, 0 for the unknown. An instance takes the best score among its trusted contexts, and from
    then on counts towards the support of every context it stands in. As the scores start from the
    seeds alone and every step keeps their order, they only rise; they are whole numbers, so they come
    to rest, and the rounds end when no score has risen (or after ``rounds``, if given). Scores of hot
    contexts and hot values are sums and maxima that combine before the shuffle.
    """
    found, reached, done = None, None, 0
    while True:
        if found is None:
            scored = edges.withColumn("got", F.lit(None).cast("long"))
        else:
            scored = edges.join(found.withColumnRenamed("score", "got"), ["kind", "value"], "left")
        scored = scored.withColumn("got", F.when(F.col("seed"), _UNIT).otherwise(F.coalesce("got", F.lit(0))))
        contexts = scored.groupBy("kind", "context").agg(
            F.expr("sum(got) div count(*)").alias("score"), F.count_if(F.col("got") > 0).alias("known"), F.count_if(~F.col("seed")).alias("new"))
        trusted = contexts.where((F.col("score") >= trust * _UNIT) & (F.col("known") >= support) & (F.col("new") > 0))
        step = edges.where(~F.col("seed")).join(trusted.select("kind", "context", "score"), ["kind", "context"])
        found = stage(step.groupBy("kind", "value").agg(F.max("score").alias("score")), "pii-found")
        last, reached, done = reached, found.agg(F.count("*"), F.sum("score")).first(), done + 1
        if reached == last or reached[0] == 0 or done == rounds:
            return found


def find(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int | None = None, trust: float = TRUST, support: int = SUPPORT,
) -> DataFrame:
    """One row for each row of ``docs``: (id, mark, base, extra), staged.

    ``base`` and ``extra`` are arrays of (kind, start, end); ``mark`` is a hash of the text, so that
    (id, mark) tells rows apart whose id repeats; equal rows have equal results. Null texts are empty,
    null ids are kept. A value that could be of two kinds takes the one with the better score. Only
    ids, places and the identifiers with three words around them are written, never texts.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("mark", F.xxhash64("body"))
    parsed = computed_once(base_spans(rows, "body", "base"), {"mentions": _mentions("body")})
    parsed = stage(parsed.select("id", "mark", "base", "mentions"), "pii-parsed")
    mentions = parsed.where(F.size("mentions") > 0).select("id", "mark", F.explode("mentions").alias("m")).select("id", "mark", "m.*")
    found = _learn(stage(_edges(mentions), "pii-edges"), rounds, trust, support)
    best = found.groupBy("value").agg(F.max(F.struct("score", -F.col("kind"))).alias("b")).select("value", (-F.col("b.col2")).alias("kind"))
    spans = mentions.where("known is null").select("id", "mark", "start", "end", "value").distinct().join(best, "value")
    extra = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    extra = extra.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "extra")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    return parsed.select("id", "mark", "base").join(extra, same, "left").select(
        "id", "mark", "base", F.coalesce("extra", none).alias("extra"))


def _written(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort({spans}), s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')"


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of ``docs``.

    The counts and the digest are of what the fixed rules find; ``spans`` has the learned ones too.
    """
    found = find(docs, doc_id, text, **options)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        F.col("id").alias(doc_id), *counts, F.sha2(F.expr(_written("base")), 256).alias("base_sha256"),
        F.expr(_written("concat(base, extra)")).alias("spans"))


def _masked(text: str, spans: str) -> str:
    """SQL: the text with every span, merged where they overlap, replaced by its kind.

    Pieces of ``_STEP`` spans are cut out of the text first, so that a long text with many spans is
    not walked from its start for each.
    """
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    merged = f"""aggregate(array_sort({spans}, (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1
        when a.end > b.end then -1 when a.end < b.end then 1 else a.kind - b.kind end),
      cast(array() as array<struct<kind:int,start:int,end:int>>), (out, s) -> case
        when size(out) > 0 and s.start < element_at(out, -1).end then concat(slice(out, 1, size(out) - 1),
          array(named_struct('kind', element_at(out, -1).kind, 'start', element_at(out, -1).start, 'end', greatest(element_at(out, -1).end, s.end))))
        else concat(out, array(s)) end)"""
    return f"""
    case when size({spans}) = 0 then {text} else
    transform(array({merged}), m ->
      concat(array_join(transform(sequence(0, int((size(m) - 1) / {_STEP})), g ->
        transform(array(if(g = 0, 0, m[g * {_STEP} - 1].end)), at ->
          transform(array(substring({text}, at + 1, m[least(size(m), (g + 1) * {_STEP}) - 1].end - at)), piece ->
            array_join(transform(sequence(g * {_STEP}, least(size(m), (g + 1) * {_STEP}) - 1), i ->
              concat(substring(piece, if(i = 0, 0, m[greatest(i - 1, 0)].end) - at + 1, m[i].start - if(i = 0, 0, m[greatest(i - 1, 0)].end)), array({names})[m[i].kind])), ''))[0])[0]), ''),
        substring({text}, element_at(m, -1).end + 1)))[0] end"""


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets.

    All rows and columns stay; null texts stay null; ``n_chars``, where there is one, is counted anew.
    """
    columns = docs.columns
    clash = {"_mark", "_id2", "_mark2", "_spans"} & set(columns)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    found = find(docs, doc_id, text, **options).where(F.size("base") + F.size("extra") > 0)
    spans = found.select(
        F.col("id").alias("_id2"), F.col("mark").alias("_mark2"), F.concat("base", "extra").alias("_spans")
    ).dropDuplicates(["_id2", "_mark2"])
    marked = docs.withColumn("_mark", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = marked.join(spans, F.col(doc_id).eqNullSafe(F.col("_id2")) & (F.col("_mark") == F.col("_mark2")), "left")
    joined = joined.withColumn(text, F.expr(f"case when _spans is null then `{text}` else {_masked(f'`{text}`', '_spans')} end"))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return joined.select(columns)
