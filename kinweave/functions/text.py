"""Column rules for words, postcodes, telephones, NHS numbers and phonetic codes.

Every rule is a Catalyst expression, so it runs inside the scan stage without Python workers.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# One white-space class for the whole library (separators plus the ASCII and Latin-1 controls).
SPACE = r"[\p{Z}\x{9}-\x{D}\x{85}]"

_HANGUL_FIRST = 0xAC00
_LEADS, _VOWELS, _TAILS = 19, 21, 28
_PLACEHOLDER = 0xE000


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim(c) == "")


@lru_cache(maxsize=1)
def _base_letters() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character plus marks, and that base."""
    composed, bases = [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or _HANGUL_FIRST <= code < _HANGUL_FIRST + 11172:
            continue
        char = chr(code)
        decomposed = unicodedata.normalize("NFD", char)
        if decomposed == char:
            continue
        kept = [part for part in decomposed if not unicodedata.category(part).startswith("M")]
        if len(kept) == 1:
            composed.append(char)
            bases.append(kept[0])
    return "".join(composed), "".join(bases)


@lru_cache(maxsize=1)
def _one_to_one_case() -> tuple[str, str]:
    """Letters that a one-to-one upper-casing leaves alone but the JVM would expand or fold.

    Sharp s and the ligatures have no single capital; dotless i and long s keep their form under
    an invariant culture.
    """
    kept = [
        chr(code)
        for code in range(0x80, 0x10000)
        if not 0xD800 <= code <= 0xDFFF
        and (len(chr(code).upper()) > 1 or code in (0x131, 0x17F))
        and unicodedata.normalize("NFD", chr(code)) == chr(code)
    ]
    return "".join(kept), "".join(chr(_PLACEHOLDER + i) for i in range(len(kept)))


def upper_one_to_one(c: Column) -> Column:
    kept, placeholders = _one_to_one_case()
    guarded = F.translate(F.upper(F.translate(c, kept, placeholders)), placeholders, kept)
    return F.when(F.length(c) == F.octet_length(c), F.upper(c)).otherwise(guarded)


def _split_hangul(c: Column) -> Column:
    """Hangul syllables to their conjoining letters, by the arithmetic of the Unicode standard."""
    leads = F.lit("".join(chr(0x1100 + i) for i in range(_LEADS)))
    vowels = F.lit("".join(chr(0x1161 + i) for i in range(_VOWELS)))
    tails = F.lit("".join(chr(0x11A8 + i) for i in range(_TAILS - 1)))

    def one(ch: Column) -> Column:
        code = F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("int") - _HANGUL_FIRST
        lead = F.substr(leads, (code / (_VOWELS * _TAILS)).cast("int") + 1, F.lit(1))
        vowel = F.substr(
            vowels, (code % (_VOWELS * _TAILS) / _TAILS).cast("int") + 1, F.lit(1)
        )
        tail = F.when(
            code % _TAILS > 0, F.substr(tails, (code % _TAILS).cast("int"), F.lit(1))
        ).otherwise("")
        return F.when(ch.rlike("[가-힣]"), F.concat(lead, vowel, tail)).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def norm_words(c: Column) -> Column:
    """Upper-case letters and digits without accents; any other run becomes one space."""
    composed, bases = _base_letters()
    plain = F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))
    split = F.when(c.rlike("[가-힣]"), _split_hangul(c)).otherwise(c)
    letters = F.regexp_replace(F.translate(split, composed, bases), r"\p{M}+", "")
    spaced = F.trim(F.regexp_replace(letters, r"[^\p{L}\p{Nd}]+", " "))
    return (
        F.when(c.isNull(), "")
        .when(F.length(c) == F.octet_length(c), plain)
        .otherwise(upper_one_to_one(spaced))
    )


def norm_postcode(c: Column) -> Column:
    kept = F.regexp_replace(c, r"[^\p{L}\p{Nd}]|[\x{10000}-\x{10FFFF}]", "")
    return F.coalesce(upper_one_to_one(kept), F.lit(""))


def postcode_sector(c: Column) -> Column:
    return F.when(F.length(c) >= 5, F.left(c, F.length(c) - 2)).otherwise("")


def digits(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"\P{Nd}|[\x{10000}-\x{10FFFF}]", ""), F.lit(""))


def norm_phone(c: Column) -> Column:
    plus = F.when(trim(c).startswith("+"), "+").otherwise("")
    return F.when(is_blank(c), "").otherwise(F.concat(plus, digits(c)))


def nhs_valid(c: Column) -> Column:
    """Ten digits whose last is the mod-11 check digit of the first nine (weights 10 to 2)."""
    number = digits(c)
    total = F.lit(0)
    for position in range(9):
        total = total + F.substring(number, position + 1, 1).try_cast("int") * (10 - position)
    check = (11 - total % 11) % 11
    last = F.substring(number, 10, 1).try_cast("int")
    return F.coalesce(number.rlike("^[0-9]{10}$") & (check != 10) & (check == last), F.lit(False))


def valid_registry_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"), F.lit(False))


# The phonetic rules, as replacements on the raw upper-case letters. A lower-case letter is a code
# already given ('q' stands for the pair KS, 'o' for TH's zero), '.' a silent letter. Each step only
# looks at neighbours that are still raw when it runs.
_PHONETIC_STEPS = (
    (r"^(?:K(?=N)|G(?=N)|P(?=N)|A(?=E)|W(?=R))", "."),
    (r"(?<=M)B\z", "."),
    (r"B", "b"),
    (r"(?<=C)K", "."),
    (r"K", "k"),
    (r"CH", "x."),
    (r"C(?=[IEY])", "s"),
    (r"C", "k"),
    (r"D(?=G[EIY])", "j"),
    (r"D", "t"),
    (r"G(?=H)", "."),
    (r"G(?=[EIY])", "j"),
    (r"G", "k"),
    (r"PH", "f."),
    (r"P", "p"),
    (r"SH", "x."),
    (r"S", "s"),
    (r"TH", "o."),
    (r"T(?=I[AO])", "x"),
    (r"T", "t"),
    (r"(?<=[AEIOU])H(?=[AEIOU])", "h"),
    (r"W(?=[AEIOU])", "w"),
    (r"Y(?=[AEIOU])", "y"),
    (r"^A", "a"),
    (r"^E", "e"),
    (r"^I", "i"),
    (r"^O", "u"),
    (r"^U", "v"),
)


def phonetic(c: Column) -> Column:
    """Metaphone-like code of a name; stops once eight characters are written."""
    code = F.regexp_replace(upper_one_to_one(c), r"\P{L}|[\x{10000}-\x{10FFFF}]", "")
    for pattern, code_text in _PHONETIC_STEPS:
        code = F.regexp_replace(code, pattern, code_text)
    # One letter, one code: V, Z, Q and the letters that stand for themselves. O and U at the start
    # were parked on 'u' and 'v' because 'o' is taken; V goes to 'f'.
    code = F.translate(code, "VZQFJLMNRX", "fskfjlmnrq")
    code = F.regexp_replace(code, r"[^a-z]", "")
    code = F.regexp_replace(code, r"(.)\1+", "$1")
    code = F.regexp_replace(code, r"(ks|q)[sq]+", "$1")
    # A KS pair that starts at the eighth character is kept whole, so mark its second half.
    marked = F.regexp_replace(code, "q", "k#")
    code = F.regexp_extract(marked, r"^.{0,8}#?", 0)
    return F.coalesce(
        F.translate(code, "aeiuvo#bfhjklmnprstwxy", "AEIOU0SBFHJKLMNPRSTWXY"), F.lit("")
    )
