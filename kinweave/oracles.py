"""DuckDB SQL that computes the registered queries another way, for the correctness check."""

from __future__ import annotations

import math

from kinweave.sources.derived import people_a_sql, people_b_sql

NHS = "https://fhir.nhs.uk/Id/nhs-number"
SECRET = bytes([1]) * 32


def _words(c: str) -> str:
    return f"trim(regexp_replace(upper(strip_accents({c})), '[^A-Z0-9]+', ' ', 'g'))"


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def _hmac(text: str) -> str:
    key = SECRET.ljust(64, b"\0")
    inner = _blob(bytes(b ^ 0x36 for b in key))
    outer = _blob(bytes(b ^ 0x5C for b in key))
    return f"upper(sha256({outer} || unhex(sha256({inner} || encode({text})))))"


# ---- people ---------------------------------------------------------------------------------

PEOPLE = f"""
flat AS (
  SELECT * FROM ({people_a_sql()}) UNION ALL BY NAME SELECT * FROM ({people_b_sql()})
),
base AS (
  SELECT *, source_system || '-' || local_id AS enterprise_id,
    {_words('family')} AS family_n, {_words('given')} AS given_n,
    {_words("line || ' ' || city")} AS tokens,
    upper(regexp_replace(postcode, '[^A-Za-z0-9]', '', 'g')) AS postcode_n,
    regexp_replace(phone, '[^0-9]', '', 'g') AS phone_n, upper(trim(email)) AS email_n,
    source_system = 'crm' AND trusted AND nhs IS NOT NULL AS vouched
  FROM flat
),
letters AS (
  SELECT DISTINCT family_n, list_filter(string_split(family_n, ''), lambda c: c >= 'A' AND c <= 'Z') AS l
  FROM base
),
sounds AS (
  SELECT family_n, list_transform(range(1, len(l) + 1), lambda i: CASE
    WHEN i = 1 AND len(l) > 1 AND (l[1] || l[2]) IN ('KN','GN','PN','AE','WR') THEN ''
    WHEN l[i] = 'B' THEN CASE WHEN i > 1 AND l[i-1] = 'M' AND i = len(l) THEN '' ELSE 'B' END
    WHEN l[i] = 'C' THEN CASE WHEN l[i+1] = 'H' THEN 'X' WHEN l[i+1] IN ('I','E','Y') THEN 'S' ELSE 'K' END
    WHEN l[i] = 'D' THEN CASE WHEN l[i+1] = 'G' AND l[i+2] IN ('E','I','Y') THEN 'J' ELSE 'T' END
    WHEN l[i] IN ('F','J','L','M','N','R') THEN l[i]
    WHEN l[i] = 'G' THEN CASE WHEN l[i+1] = 'H' THEN '' WHEN l[i+1] IN ('E','I','Y') THEN 'J' ELSE 'K' END
    WHEN l[i] = 'H' THEN CASE WHEN i > 1 AND l[i-1] IN ('A','E','I','O','U') AND l[i+1] IN ('A','E','I','O','U')
      THEN 'H' ELSE '' END
    WHEN l[i] = 'K' THEN CASE WHEN i > 1 AND l[i-1] = 'C' THEN '' ELSE 'K' END
    WHEN l[i] = 'P' THEN CASE WHEN l[i+1] = 'H' THEN 'F' ELSE 'P' END
    WHEN l[i] = 'Q' THEN 'K'
    WHEN l[i] = 'S' THEN CASE WHEN l[i+1] = 'H' THEN 'X' ELSE 'S' END
    WHEN l[i] = 'T' THEN CASE WHEN l[i+1] = 'H' THEN '0'
      WHEN l[i+1] = 'I' AND l[i+2] IN ('A','O') THEN 'X' ELSE 'T' END
    WHEN l[i] = 'V' THEN 'F'
    WHEN l[i] IN ('W','Y') THEN CASE WHEN l[i+1] IN ('A','E','I','O','U') THEN l[i] ELSE '' END
    WHEN l[i] = 'X' THEN 'KS'
    WHEN l[i] = 'Z' THEN 'S'
    WHEN i = 1 THEN l[i]
    ELSE '' END) AS codes
  FROM letters
),
phon AS (
  SELECT family_n, list_reduce(codes, lambda acc, c: CASE
    WHEN length(acc) >= 8 OR c = '' OR (acc <> '' AND ends_with(acc, c)) THEN acc ELSE acc || c END, '')
    AS code
  FROM sounds
),
p AS (
  SELECT base.*, coalesce(code, '') AS code,
    CASE WHEN length(postcode_n) >= 5 THEN left(postcode_n, length(postcode_n) - 2) ELSE '' END AS sector,
    strftime(dob, '%Y%m%d') AS day
  FROM base LEFT JOIN phon USING (family_n)
),
raw AS (
  SELECT enterprise_id, source_system, unnest(list_distinct(list_filter([
    'ID|{NHS}|' || nhs, 'FMDOB|' || family_n || '|' || day,
    CASE WHEN code <> '' THEN 'PHDOB|' || code || '|' || day END,
    'PCDOB|' || postcode_n || '|' || day, 'TEL|Phone|' || phone_n, 'TEL|Email|' || email_n],
    lambda x: x IS NOT NULL))) AS key
  FROM p
)
"""

# ---- pair comparison: give a CTE ``pairs(l, r)`` of enterprise ids ------------------------------


def _jw(name: str, source: str) -> str:
    """CTEs that score the distinct (x, y) of ``source`` by Jaro-Winkler, as ``name(x, y, jw)``."""
    return f"""
{name}_hits AS (
  SELECT x, y, list_reduce(range(0, length(x)), lambda acc, i: list_concat(acc, list_transform(
    list_filter(range(greatest(0, i - (greatest(length(x), length(y)) // 2 - 1)),
                      least(i + greatest(length(x), length(y)) // 2, length(y))),
      lambda j: substr(x, i + 1, 1) = substr(y, j + 1, 1)
        AND NOT list_contains(list_transform(acc, lambda a: a % 1000), j))[1:1],
    lambda j: i * 1000 + j)), []::BIGINT[]) AS hits
  FROM (SELECT DISTINCT x, y FROM {source} WHERE x <> '' AND y <> '')
),
{name}_jaro AS (
  SELECT x, y, len(hits) AS m,
    len(list_filter(range(1, len(hits) + 1), lambda q:
      substr(x, hits[q] // 1000 + 1, 1) <>
      substr(y, list_sort(list_transform(hits, lambda a: a % 1000))[q] + 1, 1))) AS t,
    CASE WHEN substr(x,1,1) <> substr(y,1,1) THEN 0
         WHEN length(x) < 2 OR length(y) < 2 OR substr(x,2,1) <> substr(y,2,1) THEN 1
         WHEN length(x) < 3 OR length(y) < 3 OR substr(x,3,1) <> substr(y,3,1) THEN 2
         WHEN length(x) < 4 OR length(y) < 4 OR substr(x,4,1) <> substr(y,4,1) THEN 3 ELSE 4 END AS pre
  FROM {name}_hits
),
{name} AS (
  SELECT x, y, CASE WHEN x = y THEN 1.0 WHEN m = 0 THEN 0.0 ELSE j + pre * 0.1::DOUBLE * (1 - j) END AS jw
  FROM (SELECT *, CASE WHEN m > 0 THEN (m::DOUBLE / length(x) + m::DOUBLE / length(y)
          + (m - t / 2.0::DOUBLE) / m) / 3.0::DOUBLE END AS j FROM {name}_jaro)
)"""


_NICK = "CASE {0} WHEN 'ROBERT' THEN 1 WHEN 'BOB' THEN 1 WHEN 'WILLIAM' THEN 2 WHEN 'BILL' THEN 2 " \
        "WHEN 'ELIZABETH' THEN 3 WHEN 'BETH' THEN 3 END"

# Text over which every comparison is written; {trust} says when a side's identifier is trusted.
def _evidence(left_trust: str = "a.vouched", right_trust: str = "b.vouched") -> str:
    return f"""
joined AS (
  SELECT pairs.*, a.family_n AS lf, b.family_n AS rf, a.given_n AS lg, b.given_n AS rg,
    a.code AS lcode, b.code AS rcode, a.dob AS ld, b.dob AS rd, a.gender AS lgen, b.gender AS rgen,
    a.postcode_n AS lpc, b.postcode_n AS rpc, a.sector AS ls, b.sector AS rs,
    list_distinct(string_split(a.tokens, ' ')) AS lt, list_distinct(string_split(b.tokens, ' ')) AS rt,
    a.phone_n AS lph, b.phone_n AS rph, a.email_n AS lem, b.email_n AS rem,
    a.nhs AS lnhs, b.nhs AS rnhs, ({left_trust}) AS ltrust, ({right_trust}) AS rtrust
  FROM pairs JOIN p a ON a.enterprise_id = pairs.l JOIN p b ON b.enterprise_id = pairs.r
),
fpairs AS (SELECT lf AS x, rf AS y FROM joined), gpairs AS (SELECT lg AS x, rg AS y FROM joined),
{_jw('fjw', 'fpairs')}, {_jw('gjw', 'gpairs')},
field AS (
  SELECT joined.*, fjw.jw AS fj, CASE WHEN lcode <> '' AND lcode = rcode THEN 0.85 ELSE 0 END AS fp,
    gjw.jw AS gj, CASE WHEN {_NICK.format('lg')} = {_NICK.format('rg')} THEN 0.92 ELSE 0 END AS gn,
    CASE WHEN ld IS NULL OR rd IS NULL THEN 0.0 WHEN ld = rd THEN 1.0
      WHEN year(ld) = year(rd) AND day(ld) = month(rd) AND month(ld) = day(rd) THEN 0.5 ELSE 0.0 END AS dob_sim,
    CASE WHEN lpc <> '' AND lpc = rpc THEN 1.0 WHEN ls <> '' AND ls = rs THEN 0.6 ELSE 0.0 END::DOUBLE AS pc,
    len(list_intersect(lt, rt))::DOUBLE / len(list_distinct(list_concat(lt, rt))) AS jac,
    (lph IS NULL AND lem IS NULL) OR (rph IS NULL AND rem IS NULL) AS tel_missing,
    CASE WHEN lph = rph OR lem = rem THEN 1.0 ELSE 0.0 END AS telecom_sim,
    lgen = 'Unknown' OR rgen = 'Unknown' AS gen_missing,
    CASE WHEN lgen <> 'Unknown' AND rgen <> 'Unknown' AND lgen = rgen THEN 1.0 ELSE 0.0 END AS gender_sim,
    coalesce(ltrust AND rtrust AND lnhs = rnhs, false) AS certain,
    coalesce(ltrust AND rtrust AND lnhs <> rnhs, false) AS clash
  FROM joined JOIN fjw ON fjw.x = lf AND fjw.y = rf JOIN gjw ON gjw.x = lg AND gjw.y = rg
),
sims AS (
  SELECT *, greatest(fj, fp)::DOUBLE AS family_sim, greatest(gj, gn)::DOUBLE AS given_sim,
    greatest(pc, jac) AS address_sim, clash OR (certain AND coalesce(ld <> rd, false)) AS hard
  FROM field
),
scored AS (
  SELECT *, CASE WHEN certain AND NOT hard THEN 'Certain' WHEN s >= 0.82::DOUBLE THEN 'Probable'
      WHEN s >= 0.62::DOUBLE THEN 'Possible' ELSE 'None' END AS grade
  FROM (SELECT *, least(1.0, (family_sim * 0.25::DOUBLE + given_sim * 0.2::DOUBLE
    + dob_sim * 0.3::DOUBLE + address_sim * 0.15::DOUBLE + telecom_sim * 0.07::DOUBLE
    + gender_sim * 0.03::DOUBLE) / (0.25::DOUBLE + 0.2::DOUBLE + 0.3::DOUBLE + 0.15::DOUBLE
    + 0.07::DOUBLE + 0.03::DOUBLE)) AS s FROM sims)
)"""


_POPULATION = """
pairs AS (
  SELECT DISTINCT a.enterprise_id AS l, b.enterprise_id AS r
  FROM raw a JOIN raw b ON a.key = b.key AND a.enterprise_id < b.enterprise_id
)"""

_LABELS = """
pairs AS (
  SELECT 'billing/B' || k || '|crm/' || k AS pair_key, true AS is_match,
    'crm-' || k AS l, 'billing-B' || k AS r
  FROM p WHERE source_system = 'billing'
  UNION ALL
  SELECT 'billing/B' || k || '|crm/' || ((k + 21) % (SELECT count(*) FROM customer)), false,
    'crm-' || ((k + 21) % (SELECT count(*) FROM customer)), 'billing-B' || k
  FROM p WHERE source_system = 'billing'
)"""

_SHARED = """
shared AS (
  SELECT DISTINCT pair_key FROM pairs
  JOIN raw a ON a.enterprise_id = l JOIN raw b ON b.enterprise_id = r AND a.key = b.key
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in (PEOPLE, *parts)) + "\n"


_SIM_COLUMNS = """round(family_sim, 6) AS family_sim, round(given_sim, 6) AS given_sim,
  round(dob_sim, 6)::DOUBLE AS dob_sim, round(address_sim, 6) AS address_sim,
  round(telecom_sim, 6)::DOUBLE AS telecom_sim, round(gender_sim, 6)::DOUBLE AS gender_sim,
  round(s, 6) AS score, grade, hard AS has_hard_conflict"""


def _level(c: str) -> str:
    return (f"CASE WHEN {c} >= 0.999999 THEN 'Exact' WHEN {c} >= 0.85::DOUBLE THEN 'Strong' "
            f"WHEN {c} >= 0.5 THEN 'Partial' ELSE 'Different' END")


# Six evidence rows per pair, as (field, sim, missing, comparator, detail).
_LONG = f"""
long AS (
  SELECT scored.*, e.field AS field, e.sim AS sim, e.missing AS missing, e.comparator AS comparator,
    e.detail AS detail, {_level('e.sim')} AS level
  FROM scored, LATERAL (SELECT unnest([
    {{'field': 'family', 'sim': family_sim, 'missing': false,
      'comparator': CASE WHEN fj = 0 AND fp = 0 THEN 'none' WHEN fj >= fp THEN 'jaro-winkler' ELSE 'phonetic' END,
      'detail': CASE WHEN fp > fj THEN 'shared-code:' || lcode END}},
    {{'field': 'given', 'sim': given_sim, 'missing': false,
      'comparator': CASE WHEN gj = 0 AND gn = 0 THEN 'none' WHEN gj >= gn THEN 'jaro-winkler' ELSE 'nickname' END,
      'detail': CASE WHEN gn > gj THEN 'en-GB/en-gb-demo' END}},
    {{'field': 'birthDate', 'sim': dob_sim::DOUBLE, 'missing': ld IS NULL OR rd IS NULL,
      'comparator': CASE WHEN ld IS NULL OR rd IS NULL THEN 'exact/day-month-transposition'
        WHEN dob_sim = 0.5 THEN 'day-month-transposition' ELSE 'exact' END, 'detail': NULL}},
    {{'field': 'address', 'sim': address_sim, 'missing': false,
      'comparator': CASE WHEN address_sim = 0 THEN 'token-jaccard' WHEN pc >= jac THEN
        CASE WHEN pc = 1 THEN 'postcode-exact' ELSE 'postcode-sector' END ELSE 'token-jaccard' END,
      'detail': NULL}},
    {{'field': 'telecom', 'sim': telecom_sim::DOUBLE, 'missing': tel_missing,
      'comparator': 'normalised-exact', 'detail': NULL}},
    {{'field': 'gender', 'sim': gender_sim::DOUBLE, 'missing': gen_missing, 'comparator': 'exact',
      'detail': NULL}}]) AS e)
)"""


def _fs_llr(field: str = "field") -> str:
    ratio = {
        "Exact": math.log(0.80) - math.log(0.05), "Strong": math.log(0.10) - math.log(0.05),
        "Partial": math.log(0.06) - math.log(0.20), "Different": math.log(0.04) - math.log(0.70),
    }
    cases = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in ratio.items())
    return f"CASE WHEN missing THEN 0.0 ELSE CASE level {cases} END END"


_SELF_CAP = """
sizes AS (SELECT key, count(*) AS n FROM raw GROUP BY key),
allpairs AS (
  SELECT DISTINCT a.enterprise_id AS subject_id, b.enterprise_id AS candidate_id
  FROM raw a JOIN raw b ON a.key = b.key
),
crowded AS (SELECT subject_id FROM allpairs GROUP BY subject_id HAVING count(*) > 3)"""

_QUERY_CAP = """
found AS (
  SELECT DISTINCT q.enterprise_id AS query_id, c.enterprise_id AS candidate_id
  FROM raw q JOIN raw c ON q.key = c.key
  WHERE q.source_system = 'billing' AND c.source_system = 'crm'
),
refused AS (SELECT query_id FROM found GROUP BY query_id HAVING count(*) > 3)"""

_MATCH = """
pairs AS (
  SELECT DISTINCT q.enterprise_id AS l, c.enterprise_id AS r
  FROM raw q JOIN raw c ON q.key = c.key
  WHERE q.source_system = 'billing' AND c.source_system = 'crm'
)"""
_MATCH_TRUST = ("a.trusted AND a.nhs IS NOT NULL", "b.vouched")

_DUPLICATES = """
pairs AS (
  SELECT DISTINCT a.enterprise_id AS l, b.enterprise_id AS r
  FROM raw a JOIN raw b ON a.key = b.key AND a.enterprise_id <> b.enterprise_id
)"""

_CUTS = """
cuts AS (SELECT unnest(list_sort(list_distinct(list_concat(
  list_transform(range(0, 21), lambda i: i / 20.0::DOUBLE), [0.62::DOUBLE, 0.82::DOUBLE])))) AS threshold)"""

_MATRIX = """
matrix AS (
  SELECT threshold, count(*) FILTER (is_match AND pos) AS tp, count(*) FILTER (NOT is_match AND pos) AS fp,
    count(*) FILTER (NOT is_match AND NOT pos) AS tn, count(*) FILTER (is_match AND NOT pos) AS fn
  FROM (SELECT threshold, is_match,
      grade = 'Certain' OR (CASE WHEN hard THEN -1 ELSE s END) >= threshold AS pos FROM scored, cuts)
  GROUP BY threshold
)"""


def _wilson(k: str, n: str, sign: str) -> str:
    z = "1.959963984540054::DOUBLE"
    centre = f"({k}::DOUBLE/{n} + {z}*{z}/(2*{n})) / (1 + {z}*{z}/{n})"
    margin = (f"{z} / (1 + {z}*{z}/{n}) * sqrt(({k}::DOUBLE/{n}) * (1 - {k}::DOUBLE/{n}) / {n}"
              f" + {z}*{z}/(4.0::DOUBLE*{n}*{n}))")
    bound = "greatest(0.0, " if sign == "-" else "least(1.0, "
    return f"CASE WHEN {n} > 0 THEN round({bound}{centre} {sign} {margin}), 6) END"


_SPLIT = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY is_match ORDER BY upper(sha256(pair_key))) AS ord,
    count(*) OVER (PARTITION BY is_match) AS n
  FROM pairs
),
parts AS (
  SELECT pair_key, is_match,
    ord <= greatest(2, least(round(n * 0.2::DOUBLE)::BIGINT, n - 5)) AS is_validation FROM ranked
)"""

_FIT = """
fit AS (
  SELECT g.field, g.level, coalesce(m_n, 0) AS m_n, coalesce(u_n, 0) AS u_n,
    (coalesce(m_n, 0) + 1.0::DOUBLE) / (sum(coalesce(m_n, 0)) OVER (PARTITION BY g.field) + 4.0::DOUBLE) AS m,
    (coalesce(u_n, 0) + 1.0::DOUBLE) / (sum(coalesce(u_n, 0)) OVER (PARTITION BY g.field) + 4.0::DOUBLE) AS u
  FROM (SELECT * FROM (SELECT unnest(['family','given','birthDate','address','telecom','gender']) AS field),
          (SELECT unnest(['Exact','Strong','Partial','Different']) AS level)) g
  LEFT JOIN (SELECT field, level, count(*) FILTER (long.is_match) AS m_n,
      count(*) FILTER (NOT long.is_match) AS u_n
    FROM long JOIN parts USING (pair_key) WHERE NOT is_validation AND NOT missing GROUP BY field, level) c
  USING (field, level)
)"""

# ---- linked identities ---------------------------------------------------------------------------

_LINKED = """
linked AS (
  SELECT *, 'P' || k AS identity,
    CASE WHEN k % 4 = 1 THEN 50 WHEN source_system = 'crm' THEN 100 ELSE 50 END AS trust,
    TIMESTAMP '2024-01-15' + to_days(((k % 3) * CASE WHEN source_system = 'crm' THEN 1 ELSE 2 END)::INT) AS updated
  FROM p
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY identity ORDER BY trust DESC, updated DESC,
      source_system || '/' || local_id) AS ord
  FROM linked
),
listed AS (
  SELECT identity, ord, 'names' AS kind, given || ' ' || family AS item, 1 AS pos FROM ranked
  UNION ALL SELECT identity, ord, 'addresses', line || ',' || postcode, 1 FROM ranked
  UNION ALL SELECT identity, ord, 'telecoms', phone, 1 FROM ranked WHERE phone IS NOT NULL
  UNION ALL SELECT identity, ord, 'telecoms', email, 2 FROM ranked WHERE email IS NOT NULL
  UNION ALL SELECT identity, CASE WHEN vouched THEN 0 ELSE 1 END, 'identifiers',
    nhs || '=' || vouched::VARCHAR, 1 FROM ranked WHERE nhs IS NOT NULL
),
firsts AS (
  SELECT identity, kind, item, min(ord * 10 + pos) AS place FROM listed GROUP BY ALL
),
texts AS (
  SELECT identity, kind, string_agg(item, ';' ORDER BY place) AS text FROM firsts GROUP BY ALL
)"""


def _text(kind: str) -> str:
    return f"coalesce((SELECT text FROM texts t WHERE t.identity = r.identity AND kind = '{kind}'), '')"


# The stored registry of the maintenance queries: identities by person, one lost row in fifty.
_STORED = """
owned AS (SELECT *, 'P' || k AS identity FROM p),
whole AS (
  SELECT * FROM owned WHERE k % 50 <> 7
)"""


def _uuid(digest: str) -> str:
    def b(i: int) -> str:
        return f"substr({digest}, {2 * i + 1}, 2)"

    seven = f"'5' || substr({digest}, 16, 1)"
    eight = (f"substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({digest}, 17, 1))::INT, 1)"
             f" || substr({digest}, 18, 1)")
    return " || ".join([
        b(3), b(2), b(1), b(0), "'-'", b(5), b(4), "'-'", seven, b(6), "'-'", eight, b(9), "'-'",
        *(b(i) for i in range(10, 16)),
    ])


def _uuid5(digest: str) -> str:
    def b(i: int) -> str:
        return f"substr({digest}, {2 * i + 1}, 2)"

    eight = (f"substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({digest}, 17, 1))::INT, 1)"
             f" || substr({digest}, 18, 1)")
    return " || ".join([
        b(0), b(1), b(2), b(3), "'-'", b(4), b(5), "'-'", f"'5' || substr({digest}, 14, 1)", b(7),
        "'-'", eight, b(9), "'-'", *(b(i) for i in range(10, 16)),
    ])


ORACLES: dict[str, str] = {
    "norm_people": _with() + """
SELECT enterprise_id, family_n AS family, given_n AS given, tokens, postcode_n AS postcode, sector,
  phone_n AS phone, email_n AS email, nhs FROM p""",
    "phonetic_codes": _with() + "SELECT enterprise_id, code FROM p",
    "nhs_check": f"""
SELECT k, nhs IS NOT NULL AS issued_valid, false AS short_valid,
  coalesce(check2 < 10 AND check2 = right(shifted, 1)::INT, false) AS shifted_valid
FROM (SELECT *, (11 - list_sum(list_transform(range(1, 10),
    lambda i: substr(shifted, i, 1)::INT * (11 - i)))::INT % 11) % 11 AS check2
  FROM (SELECT *, translate(nhs, '0123456789', '1234567890') AS shifted FROM ({people_a_sql()})))""",
    "identifier_authority": _with() + """
SELECT enterprise_id, vouched AS is_trusted FROM p WHERE nhs IS NOT NULL""",
    "blocking_keys_hmac": _with() + f"""
SELECT enterprise_id, 'v1' AS key_version, {_hmac('key')} AS key_value FROM raw""",
    "resource_ids": _with() + f"""
SELECT source_system, local_id, 'src-' || lower(substr(
  {_hmac("'demo' || chr(10) || source_system || chr(10) || local_id")}, 1, 32)) AS resource_id FROM p""",
    "block_stats": _with() + """
SELECT 'v1' AS key_version, n AS block_size, count(*) AS blocks,
  (count(*) * (n * (n - 1) // 2))::BIGINT AS pairs
FROM (SELECT key, count(*) AS n FROM raw GROUP BY key) GROUP BY n""",
    "candidate_pairs": _with(_SELF_CAP) + """
SELECT subject_id, candidate_id FROM allpairs
WHERE subject_id < candidate_id AND subject_id NOT IN (SELECT subject_id FROM crowded)""",
    "rejected_subjects": _with(_SELF_CAP) + "SELECT subject_id FROM crowded",
    "query_candidates": _with(_QUERY_CAP) + """
SELECT query_id, candidate_id FROM found WHERE query_id NOT IN (SELECT query_id FROM refused)
UNION ALL SELECT query_id, 'refused' FROM refused""",
    "pair_scores": _with(_POPULATION, _evidence()) + f"""
SELECT l AS subject_id, r AS candidate_id, {_SIM_COLUMNS} FROM scored""",
    "pair_evidence": _with(_POPULATION, _evidence(), _LONG) + """
SELECT l AS subject_id, r AS candidate_id, field, comparator, detail, missing AS is_missing,
  level AS comparison_level FROM long""",
    "fs_scores": _with(_LABELS, _evidence(), _LONG) + f"""
SELECT pair_key, round(prob, 6) AS score, round(llr, 6) AS llr,
  CASE WHEN certain AND NOT hard THEN 'Certain' WHEN prob >= 0.82 THEN 'Probable'
    WHEN prob >= 0.62 THEN 'Possible' ELSE 'None' END AS grade
FROM (SELECT *, 1 / (1 + exp(-(ln(0.02::DOUBLE / 0.98::DOUBLE) + llr))) AS prob
  FROM (SELECT pair_key, certain, hard, sum({_fs_llr()}) AS llr FROM long GROUP BY ALL))""",
    "string_comparators": _with(_LABELS, _evidence()) + """,
osa AS (
  SELECT x, y, 1 - (list_reduce(range(1, length(x) + 1), lambda st, i: {
      'old': st.cur,
      'cur': list_reduce(range(1, length(y) + 1), lambda line, j: list_append(line, least(
        st.cur[j + 1] + 1, line[j] + 1,
        st.cur[j] + CASE WHEN substr(x, i, 1) = substr(y, j, 1) THEN 0 ELSE 1 END,
        CASE WHEN i > 1 AND j > 1 AND substr(x, i, 1) = substr(y, j - 1, 1)
          AND substr(x, i - 1, 1) = substr(y, j, 1) THEN st.old[j - 1] + 1 ELSE 999 END)), [i::BIGINT])},
      {'old': []::BIGINT[], 'cur': range(0, length(y) + 1)})).cur[length(y) + 1]::DOUBLE
      / greatest(length(x), length(y)) AS osa
  FROM (SELECT DISTINCT x, y FROM fpairs)
),
grams AS (
  SELECT x, y, list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) AS a,
    list_transform(range(1, length(y)), lambda i: substr(y, i, 2)) AS b FROM (SELECT DISTINCT x, y FROM fpairs)
),
dice AS (
  SELECT x, y, CASE WHEN x = y THEN 1.0 ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct(a),
    lambda g: least(len(list_filter(a, lambda v: v = g)), len(list_filter(b, lambda v: v = g))))), 0)
    / (len(a) + len(b)) END AS dice FROM grams
)
SELECT pair_key, is_match, round(fj, 6) AS jaro_winkler, round(osa.osa, 6) AS osa, round(dice.dice, 6) AS dice,
  round(jac, 6) AS jaccard, CASE WHEN lf = rf THEN 1.0 ELSE 0.0 END::DOUBLE AS exact
FROM scored JOIN osa ON osa.x = lf AND osa.y = rf JOIN dice ON dice.x = lf AND dice.y = rf""",
    "match_topn": _with(_MATCH, _evidence(*_MATCH_TRUST)) + """
SELECT * FROM (
  SELECT l AS query_id, r AS candidate_id, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS rank,
    round(s, 6) AS score, grade, hard AS has_hard_conflict, candidate_count
  FROM (SELECT *, count(*) OVER (PARTITION BY l) AS candidate_count FROM scored) WHERE grade <> 'None')
WHERE rank <= 10""",
    "match_certain": _with(_MATCH, _evidence(*_MATCH_TRUST)) + """
SELECT query_id, candidate_id, score FROM (
  SELECT l AS query_id, r AS candidate_id, round(s, 6) AS score,
    row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS rank
  FROM scored WHERE grade = 'Certain' AND NOT hard) WHERE rank = 1""",
    "find_duplicates": _with(_DUPLICATES, _evidence()) + """
SELECT * FROM (
  SELECT l AS subject_id, r AS candidate_id, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS rank,
    round(s, 6) AS score, grade, candidate_count
  FROM (SELECT *, count(*) OVER (PARTITION BY l) + 1 AS candidate_count FROM scored) WHERE grade <> 'None')
WHERE rank <= 3""",
    "golden_record": _with(_LINKED) + f"""
SELECT identity AS enterprise_id, max(trust) AS survivorship_trust,
  {_text('names')} AS names, {_text('addresses')} AS addresses, {_text('telecoms')} AS telecoms,
  {_text('identifiers')} AS identifiers,
  arg_min(dob, ord) FILTER (dob IS NOT NULL) AS birth_date,
  coalesce(arg_min(gender, ord) FILTER (gender <> 'Unknown'), 'Unknown') AS gender,
  max(CASE WHEN trusted THEN 2 ELSE 0 END) AS tags
FROM ranked r GROUP BY identity""",
    "survivor_rank": _with(_LINKED) + """
SELECT identity AS enterprise_id, source_system, local_id, ord AS rank FROM ranked""",
    "label_checks": _with(_LABELS) + """
SELECT 'duplicate-or-contradictory' AS problem, pair_key FROM pairs WHERE r LIKE '%0'
UNION ALL
SELECT 'unknown-reference', 'billing/' || replace(r, 'billing-', '') || '-gone|' || replace(l, '-', '/')
FROM pairs WHERE r LIKE '%5'""",
    "blocking_recall": _with(_LABELS, _SHARED) + """
SELECT count(*) FILTER (is_match) AS matches,
  count(*) FILTER (is_match AND l IN (SELECT enterprise_id FROM raw) AND r IN (SELECT enterprise_id FROM raw))
    AS eligible_matches,
  count(*) FILTER (is_match AND s.pair_key IS NOT NULL) AS shared_matches,
  round(count(*) FILTER (is_match AND s.pair_key IS NOT NULL)::DOUBLE / count(*) FILTER (is_match), 6)
    AS blocking_recall
FROM pairs LEFT JOIN shared s USING (pair_key)""",
    "eval_metrics": _with(_LABELS, _evidence(), _CUTS, _MATRIX) + f"""
SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn,
  round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) END, 6) AS specificity,
  round(CASE WHEN tn + fn > 0 THEN tn::DOUBLE / (tn + fn) END, 6) AS npv,
  round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN
    (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc,
  {_wilson('tp', '(tp + fp)', '-')} AS precision_low, {_wilson('tp', '(tp + fp)', '+')} AS precision_high,
  {_wilson('tp', '(tp + fn)', '-')} AS recall_low, {_wilson('tp', '(tp + fn)', '+')} AS recall_high
FROM matrix""",
    "field_discrimination": _with(_LABELS, _evidence(), _LONG) + """
SELECT field, count(*) FILTER (is_match) AS match_observations,
  count(*) FILTER (NOT is_match) AS non_match_observations,
  round(avg(sim) FILTER (is_match), 6) AS match_mean, round(avg(sim) FILTER (NOT is_match), 6) AS non_match_mean
FROM long WHERE NOT missing GROUP BY field""",
    "misclassified": _with(_LABELS, _evidence(), _SHARED) + """
SELECT scored.pair_key, is_match, round(s, 6) AS score, grade, sh.pair_key IS NOT NULL AS shared_key
FROM scored LEFT JOIN shared sh ON sh.pair_key = scored.pair_key
WHERE (NOT hard AND (grade = 'Certain' OR s >= 0.82)) <> is_match
ORDER BY abs(s - 0.5) DESC, scored.pair_key LIMIT 100""",
    "label_split": _with(_LABELS, _SPLIT) + "SELECT pair_key, is_match, is_validation FROM parts",
    "fs_fit": _with(_LABELS, _evidence(), _LONG, _SPLIT, _FIT) + """
SELECT field, level, m_n, u_n, round(m, 6) AS m, round(u, 6) AS u FROM fit""",
    "calibrate": _with(_LABELS, _evidence(), _LONG, _SPLIT, _FIT) + """,
odds AS (
  SELECT long.pair_key, long.is_match, ln(0.01::DOUBLE / 0.99::DOUBLE)
    + sum(CASE WHEN missing THEN 0.0 ELSE ln(m) - ln(u) END) AS o
  FROM long JOIN parts USING (pair_key) JOIN fit USING (field, level) WHERE is_validation GROUP BY ALL
),
held AS (SELECT is_match, 1 / (1 + exp(-o)) AS s FROM odds),
grid AS (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS threshold),
m2 AS (
  SELECT threshold, count(*) FILTER (is_match AND s >= threshold) AS tp,
    count(*) FILTER (NOT is_match AND s >= threshold) AS fp,
    count(*) FILTER (NOT is_match AND s < threshold) AS tn,
    count(*) FILTER (is_match AND s < threshold) AS fn FROM held, grid GROUP BY threshold
)
SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn,
  round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 6) AS recall FROM m2""",
    "reindex_validate": _with(_STORED) + """
SELECT count(DISTINCT identity) AS validated, count(DISTINCT identity) AS changed, 0::BIGINT AS unsafe,
  0::BIGINT AS insufficient FROM owned""",
    "rebuild_changes": _with(_STORED) + """
SELECT identity AS enterprise_id, 2::BIGINT AS version, true AS canonical_changed,
  100 AS survivorship_trust, count(*) FILTER (source_system = 'billing') AS sources_changed
FROM whole GROUP BY identity""",
    "rebuild_warnings": _with(_STORED) + """
SELECT identity AS enterprise_id, source_system, local_id, 'missing-source' AS reason
FROM owned WHERE k % 50 = 7""",
    "reconcile_reviews": _with(_POPULATION, _evidence()) + f"""
SELECT {_uuid('d')} AS id, l AS subject_id, r AS candidate_id, round(s, 6) AS score, grade,
  2 AS required_approvals, hard AS policy_locked
FROM (SELECT *, sha256('demo' || chr(0) || l || chr(0) || '1' || chr(0) || r || chr(0) || '1' || chr(0)
    || 'kinweave-people-v1') AS d FROM scored WHERE grade IN ('Probable', 'Certain'))""",
}

# ---- messages and feeds ---------------------------------------------------------------------------

_EVENTS = """
e AS (
  SELECT *, CASE event_type WHEN 'signup' THEN 'A28' WHEN 'view' THEN 'A08' WHEN 'click' THEN 'A31'
      WHEN 'purchase' THEN 'A04' ELSE 'A40' END AS trigger,
    CASE WHEN event_id % 40 = 0 THEN 'Unread HL7 version: 2.7'
      WHEN event_id % 90 = 7 THEN 'PID-7 is no date of birth.' END AS error
  FROM events
)"""

_REVIEW_STATES = """CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'AwaitingSecondApproval' ELSE 'Linked' END"""

_CONTACTS = """
texts AS (
  SELECT 'd' || doc_id AS item, text FROM documents
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations
),
found AS (
  SELECT DISTINCT item, 'Email' AS system, upper(trim(x)) AS value
  FROM (SELECT item, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS x FROM texts)
  UNION ALL
  SELECT DISTINCT item, 'Phone', CASE WHEN x LIKE '+%' THEN '+' ELSE '' END || regexp_replace(x, '[^0-9]', '', 'g')
  FROM (SELECT item, unnest(regexp_extract_all(text, '\\+?[0-9][0-9 ()-]{7,14}[0-9]')) AS x FROM texts)
)"""

# Similarity states of a probable pair for reviewers.
def _state(sim: str, missing: str) -> str:
    return (f"CASE WHEN {missing} THEN 'm' WHEN {sim} >= 0.95 THEN 'a' WHEN {sim} >= 0.6 THEN 'a' "
            f"ELSE 'c' END")


_UPSERT = """
incoming AS (
  SELECT *, 'billing-B' || k AS made FROM p WHERE source_system = 'billing'
),
pairs AS (
  SELECT DISTINCT q.enterprise_id AS l, c.enterprise_id AS r
  FROM raw q JOIN raw c ON q.key = c.key AND q.enterprise_id <> c.enterprise_id
  JOIN p pq ON pq.enterprise_id = q.enterprise_id JOIN p pc ON pc.enterprise_id = c.enterprise_id
  WHERE q.source_system = 'billing' AND (c.source_system = 'crm' OR pc.k < pq.k)
)"""

_IDENT = ("CASE WHEN source_system = 'crm' THEN enterprise_id ELSE (SELECT "
          + _uuid5("sha256('enterprise' || chr(0) || 'demo' || chr(0) || 'billing' || chr(0) || local_id)")
          + ") END")

ORACLES.update({
    "adt_parse": "WITH " + _EVENTS.strip() + """
SELECT event_id, trigger, event_id::VARCHAR AS control_id, 'U' || user_id AS local_id,
  CASE WHEN trigger = 'A40' THEN 'U' || (user_id + 1) END AS previous_local_id, error,
  ['Smith','Khan','Hughes&Co','García'][(user_id % 4 + 1)::INT] AS family,
  ['Alex','Robert','Samira'][(user_id % 3 + 1)::INT] AS given,
  CASE WHEN event_id % 90 <> 7 THEN make_date((1950 + user_id % 50)::INT, (1 + user_id % 9)::INT, 15) END AS birth_date,
  CASE WHEN user_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  '0113 496 ' || lpad((user_id % 10000)::VARCHAR, 4, '0') AS phone,
  'urn:kinweave:hl7v2:HOSP' AS id_system FROM e""",
    "adt_latest": "WITH " + _EVENTS.strip() + """
SELECT 'U' || user_id AS local_id, arg_max(event_id, ts)::VARCHAR AS control_id, arg_max(trigger, ts) AS trigger,
  max(ts) AS arrival FROM e WHERE error IS NULL GROUP BY user_id""",
    "adt_acks": "WITH " + _EVENTS.strip() + """
SELECT event_id, 'MSA|' || CASE WHEN error IS NULL THEN 'AA' ELSE 'AR' END || '|' || event_id || '|'
    || coalesce(error, 'Stored.') AS msa,
  'ERR|||' || CASE WHEN error IS NULL THEN '0' ELSE '200' END || '^Application internal error^HL70357|'
    || CASE WHEN error IS NULL THEN 'I' ELSE 'E' END || '|||' || coalesce(error, 'Stored.') AS err
FROM e""",
    "replay_split": """
SELECT event_id, CASE WHEN rn = 1 THEN 'fresh' WHEN d = first_d THEN 'replay' ELSE 'conflict' END AS receipt_state
FROM (SELECT event_id, user_id % 3 AS d, row_number() OVER w AS rn, first_value(user_id % 3) OVER w AS first_d
  FROM events WINDOW w AS (PARTITION BY event_id % 700 ORDER BY ts, event_id))""",
    "run_buckets": """
SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS events
FROM events GROUP BY 1""",
    "incremental_window": """
SELECT o_custkey::VARCHAR AS resource_id, 'C' || o_custkey AS local_id, o_orderkey::VARCHAR AS source_version,
  updated::DATE AS updated, NULL::VARCHAR AS problem
FROM (SELECT *, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate ELSE TIMESTAMP '1997-06-30' END AS updated FROM orders)
WHERE updated BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'""",
    "feed_latest": """
SELECT o_custkey::VARCHAR AS local_id, o_orderdate AS last_updated, o_orderkey AS version_id
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderkey % 50 <> 0) WHERE rn = 1""",
    "feed_disorder": """
SELECT (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate::DATE))::BIGINT
    AS repeated_versions,
  count(*) AS rows, count(*) FILTER (o_orderdate < newest) AS out_of_order
FROM (SELECT o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM orders)""",
    "contacts": "WITH " + _CONTACTS.strip() + " SELECT item, system, value FROM found",
    "contact_blocks": "WITH " + _CONTACTS.strip() + """
SELECT 'TEL|' || system || '|' || value AS key, count(*) AS items FROM found GROUP BY 1""",
    "profile_population": _with() + """
SELECT source_system, gender AS subgroup, count(*) AS total, count(*) AS active, 0::BIGINT AS inactive, 0::BIGINT AS missing_ids,
  0::BIGINT AS malformed_ids, count(nhs) AS nhs_valid, 0::BIGINT AS nhs_invalid,
  count(*) FILTER (nhs IS NOT NULL AND trusted) AS nhs_traced, count(*) FILTER (nhs IS NOT NULL AND NOT trusted) AS nhs_untraced,
  0::BIGINT AS missing_name, count(*) FILTER (dob IS NULL) AS missing_birth_date, 0::BIGINT AS missing_address,
  0::BIGINT AS missing_postcode, count(*) FILTER (phone IS NULL AND email IS NULL) AS missing_telecom,
  count(*) FILTER (own > 1) AS identifier_duplicates, count(*) FILTER (held > 1) AS identifier_collisions
FROM (SELECT *, count(nhs) OVER (PARTITION BY source_system, nhs) AS own, count(nhs) OVER (PARTITION BY nhs) AS held FROM p)
GROUP BY GROUPING SETS ((source_system), (source_system, gender))""",
    "identifier_collisions": _with() + """
SELECT nhs AS value, count(*) AS records FROM p WHERE nhs IS NOT NULL GROUP BY nhs HAVING count(*) > 1""",
    "common_blocks": _with() + f"""
SELECT {_hmac('key')} AS key_value, count(*) AS block_size FROM raw GROUP BY key HAVING count(*) > 3""",
    "match_counters": _with(_POPULATION, _evidence()) + """
SELECT grade, count(*) AS matches, count(*) FILTER (hard) AS conflicts FROM scored GROUP BY grade""",
    "candidate_histogram": _with() + """
SELECT n AS candidates, count(*) AS queries FROM (
  SELECT a.enterprise_id, count(DISTINCT b.enterprise_id) AS n FROM raw a JOIN raw b ON a.key = b.key
  GROUP BY a.enterprise_id) GROUP BY n""",
    "display_columns": _with() + """
SELECT enterprise_id, given || ' ' || family AS display_name,
  upper(substr(given, 1, 1)) || upper(substr(family, 1, 1)) AS display_initials,
  coalesce(substr(nhs, 1, 3) || ' ' || substr(nhs, 4, 3) || ' ' || substr(nhs, 7, 4), 'Not recorded') AS display_nhs,
  coalesce(strftime(dob, '%d %b %Y'), 'Not recorded') AS display_birth_date,
  CASE WHEN gender = 'Unknown' THEN 'Not recorded' ELSE gender END AS display_gender,
  line || ', ' || city || ', ' || postcode AS display_address FROM p""",
    "lookup_patients": _with() + """
SELECT 'q' || q.k AS query_id, c.enterprise_id, 'nhs-number' AS found_by
FROM p q JOIN p c ON c.nhs = q.nhs WHERE q.source_system = 'billing' AND q.k % 2 = 0
UNION ALL
SELECT 'q' || q.k, c.enterprise_id, 'name-and-birth-date'
FROM p q JOIN p c ON upper(c.family) = upper(q.family) AND c.dob = q.dob
WHERE q.source_system = 'billing' AND (q.k % 2 = 1 OR q.nhs IS NULL)""",
    "search_canonical": _with() + "SELECT enterprise_id FROM p WHERE family = 'Smith'",
    "replaced_by_chains": """
WITH RECURSIVE walk AS (
  SELECT c_custkey AS id, c_custkey AS here FROM customer
  UNION ALL SELECT id, here // 2 FROM walk WHERE here % 3 <> 0
)
SELECT id::VARCHAR AS enterprise_id, min(here)::VARCHAR AS survivor_id FROM walk GROUP BY id""",
    "version_checks": """
SELECT o_orderkey // 5 AS mutation_id, bool_and(held) AS accepted, count(*) FILTER (NOT held) AS conflicts
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_orderkey % 4 END = o_orderkey % 4 AS held FROM orders)
GROUP BY 1""",
    "link_people": _with() + """
SELECT p.enterprise_id, p.source_system = 'crm' AS is_active,
  (CASE WHEN p.source_system = 'billing' OR b.k IS NOT NULL THEN 2 ELSE 1 END)::BIGINT AS version,
  CASE WHEN p.source_system = 'billing' THEN 'crm-' || p.k END AS replaced_by,
  CASE WHEN p.source_system = 'crm' THEN 100 ELSE 50 END AS survivorship_trust,
  p.given || ' ' || p.family || CASE WHEN b.k IS NOT NULL AND (b.given <> p.given OR b.family <> p.family)
    THEN ';' || b.given || ' ' || b.family ELSE '' END AS names
FROM p LEFT JOIN p b ON b.source_system = 'billing' AND b.k = p.k AND p.source_system = 'crm'""",
    "split_people": _with() + """
SELECT (CASE WHEN source_system = 'crm' THEN 'P' ELSE 'N' END) || k AS enterprise_id,
  (CASE WHEN source_system = 'crm' THEN 2 ELSE 1 END)::BIGINT AS version,
  CASE WHEN source_system = 'crm' THEN 100 ELSE 0 END AS survivorship_trust, local_id AS sources, family,
  1 AS names FROM p WHERE k % 9 = 0 AND k % 50 <> 7""",
    "review_guidance": _with(_POPULATION, _evidence()) + f"""
SELECT l AS subject_id, r AS candidate_id, len(list_filter(st, lambda x: x = 'a')) AS agreements,
  len(list_filter(st, lambda x: x = 'c')) AS conflicts, len(list_filter(st, lambda x: x = 'm')) AS missing,
  CASE WHEN hard OR st[1] = 'c' THEN 'Pause and verify identifiers' WHEN grade = 'Certain' THEN 'Strong link signal'
    WHEN len(list_filter(st, lambda x: x = 'c')) = 0 THEN 'Link is supported'
    ELSE 'Review conflicting fields' END AS recommendation
FROM (SELECT *, [CASE WHEN lnhs IS NULL OR rnhs IS NULL THEN 'm' WHEN lnhs = rnhs THEN 'a' ELSE 'c' END,
    {_state('family_sim', 'false')}, {_state('given_sim', 'false')},
    {_state('dob_sim', 'ld IS NULL OR rd IS NULL')}, {_state('address_sim', 'false')},
    {_state('telecom_sim', 'tel_missing')}, {_state('gender_sim', 'gen_missing')}] AS st
  FROM scored WHERE grade IN ('Probable', 'Certain'))""",
    "outdated_reviews": f"""
SELECT id, subject_id::VARCHAR AS subject_id, candidate_id::VARCHAR AS candidate_id, sc AS subject_changed,
  cc AS candidate_changed
FROM (SELECT o_orderkey::VARCHAR AS id, o_custkey AS subject_id, o_custkey // 2 AS candidate_id,
    {_REVIEW_STATES} AS status, o_custkey % 7 = 0 OR o_custkey % 11 = 0 AS sc,
    o_orderkey % 10 <> 0 AND ((o_custkey // 2) % 7 = 0 OR (o_custkey // 2) % 11 = 0) AS cc FROM orders)
WHERE status <> 'Linked' AND (sc OR cc)""",
    "review_workload": f"""
SELECT 'PotentialDuplicate' AS kind, status, age AS age_weeks, count(*) AS reviews
FROM (SELECT {_REVIEW_STATES} AS status,
    (floor((DATE '2002-01-01' - o_orderdate::DATE) / 7))::BIGINT AS age FROM orders)
WHERE status <> 'Linked' GROUP BY ALL""",
    "upsert_people": _with(_UPSERT, _evidence()) + f"""
SELECT source_system, local_id, {_IDENT} AS enterprise_id,
  (CASE WHEN source_system = 'crm' AND k % 10 = 0 THEN 2 ELSE 1 END)::BIGINT AS version,
  (CASE WHEN source_system = 'crm' AND k % 10 = 0 THEN 2 ELSE 1 END)::BIGINT AS identity_version,
  coalesce(n, 0)::BIGINT AS reviews
FROM p LEFT JOIN (SELECT l, count(*) AS n FROM scored WHERE grade = 'Probable' GROUP BY l) ON l = enterprise_id
WHERE source_system = 'crm' OR enterprise_id IN (SELECT enterprise_id FROM raw)""",
    "fhir_round_trip": _with() + f"""
SELECT 'src-' || lower(substr({_hmac("'demo' || chr(10) || source_system || chr(10) || local_id")}, 1, 32)) AS resource_id,
  '1' AS version_id, 1 + (nhs IS NOT NULL)::INT AS identifiers, family, given, dob AS birth_date, gender,
  concat_ws('|', phone, email) AS telecoms, postcode, CASE WHEN trusted THEN 2 ELSE 0 END AS tags FROM p""",
    "fhir_issues": f"""
WITH a AS (SELECT * FROM ({people_a_sql()})),
bad AS (
  SELECT local_id, (11 - list_sum(list_transform(range(1, 10),
      lambda i: substr(shifted, i, 1)::INT * (11 - i)))::INT % 11) % 11 AS c, shifted
  FROM (SELECT local_id, CASE WHEN k % 5 = 0 THEN translate(nhs, '0123456789', '1234567890') ELSE nhs END AS shifted FROM a)
)
SELECT local_id AS resource_id, 'value' AS code, 'Patient.identifier' AS expression FROM bad
WHERE shifted IS NULL OR c = 10 OR c <> right(shifted, 1)::INT
UNION ALL SELECT local_id, 'value', 'Patient.birthDate' FROM a WHERE k % 8 = 0""",
    "match_bundles": _with(_MATCH, _evidence(*_MATCH_TRUST)) + """
SELECT l AS query_id, count(*)::VARCHAR AS total, arg_min(r, rank) AS best, lower(arg_min(grade, rank)) AS grade
FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS rank FROM scored WHERE grade <> 'None')
WHERE rank <= 10 GROUP BY l""",
})
