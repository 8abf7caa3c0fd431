"""Column rules against fixed values and plain Python models."""

import hashlib
import hmac
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinweave import config as c
from kinweave.functions import hashing, similarity, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_words(spark):
    given = ["  Gárcía--Smith ", None, "", "Straße", "ﬁne ı ſ", "한글", "Ǆ ŉ", "O'Brien", "x́y̧"]
    wanted = ["GARCIA SMITH", "", "", "STRAßE", "ﬁNE ı ſ", unicodedata.normalize("NFD", "한글"),
              "Ǆ ŉ", "O BRIEN", "XY"]
    assert column(spark, given, text.norm_words) == wanted


def test_words_on_every_letter(spark):
    """Each letter of the basic plane next to a plain one, against an NFD model."""
    keep = set("ßŉıſ")
    chars = [chr(i) for i in range(0xA0, 0x3000) if unicodedata.category(chr(i)).startswith("L")]

    def model(value):
        out = ""
        for ch in unicodedata.normalize("NFD", value):
            kind = unicodedata.category(ch)
            if kind[0] == "M":
                continue
            if kind[0] == "L" or kind == "Nd":
                up = ch.upper()
                out += ch if len(up) != 1 or ch in keep else up
            else:
                out += " "
        return out.strip()

    got = column(spark, ["a" + ch for ch in chars], text.norm_words)
    differing = [(ch, g, model("a" + ch)) for ch, g in zip(chars, got) if g != model("a" + ch)]
    # Python and the JVM may know different Unicode versions; new case pairs are few.
    assert len(differing) <= 60, differing[:20]


def test_postcode_phone_nhs(spark):
    assert column(spark, ["sw1a 2aa", None, " l-s1 "], text.norm_postcode) == ["SW1A2AA", "", "LS1"]
    assert column(spark, ["SW1A2AA", "LS11", ""], text.postcode_sector) == ["SW1A2", "", ""]
    assert column(spark, [" +44 (020) 7946-0018", "0113 496", "(+1)", None], text.norm_phone) == [
        "+4402079460018", "0113496", "1", ""]
    assert column(spark, ["943 476 5919", "9999999999", "9434765918", "123", None, ""], text.nhs_valid) == [
        True, True, False, False, False, False]
    assert column(spark, ["a", "-a", "a" * 64, "a" * 65, "a b", "a\n", None], text.valid_registry_id) == [
        True, False, True, False, False, False, False]


def phonetic_model(value):
    s = [ch for ch in value.upper() if ch.isalpha()]
    vowels, out, i = "AEIOU", "", 0
    if "".join(s[:2]) in ("KN", "GN", "PN", "AE", "WR"):
        i = 1
    while i < len(s) and len(out) < 8:
        ch, before = s[i], s[i - 1] if i else ""
        after = s[i + 1] if i + 1 < len(s) else ""
        third = s[i + 2] if i + 2 < len(s) else ""
        rules = {
            "B": "" if before == "M" and i == len(s) - 1 else "B",
            "C": "X" if after == "H" else "S" if after and after in "IEY" else "K",
            "D": "J" if after == "G" and third and third in "EIY" else "T",
            "G": "" if after == "H" else "J" if after and after in "EIY" else "K",
            "H": "H" if before and before in vowels and after and after in vowels else "",
            "K": "" if before == "C" else "K", "P": "F" if after == "H" else "P", "Q": "K",
            "S": "X" if after == "H" else "S",
            "T": "0" if after == "H" else "X" if after == "I" and third and third in "AO" else "T",
            "V": "F", "W": "W" if after and after in vowels else "", "X": "KS", "Z": "S",
            "Y": "Y" if after and after in vowels else "",
        }
        code = ch if ch in "FJLMNR" else rules.get(ch, ch if i == 0 and ch in vowels else "")
        if code and not out.endswith(code):
            out += code
        i += 2 if ch in "CPST" and after == "H" else 1
    return out


def test_phonetic(spark):
    fixed = {"SMITH": "SM0", "SMYTH": "SM0", "KNIGHT": "NT", "SCHMIDT": "SXMT", "THOMPSON": "0MPSN",
             "PHILLIPS": "FLPS", "EDGELEY": "EJL", "AESOP": "SP", "JACKSON": "JKSN",
             "BLMNRTFX": "BLMNRTFKS", "": ""}
    assert column(spark, list(fixed), text.phonetic) == list(fixed.values())
    r = random.Random(1)
    words = ["".join(r.choices("ABCDEGHIKMNOPSTUWXYZQV", k=r.randrange(1, 14))) for _ in range(4000)]
    words += ["".join(r.choices("KSXQC", k=r.randrange(1, 12))) for _ in range(2000)]
    got = column(spark, words, text.phonetic)
    assert [(w, g) for w, g in zip(words, got) if g != phonetic_model(w)] == []


def jw_model(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, hit in zip(b, used) if hit]
    m, t = len(left), sum(x != y for x, y in zip(left, right))
    jaro = (m / len(a) + m / len(b) + (m - t / 2.0) / m) / 3.0
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def osa_model(a, b):
    if not a or not b:
        return 0.0
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return 1 - d[-1][-1] / max(len(a), len(b))


def test_similarity_models():
    r = random.Random(2)
    words = ["".join(r.choices("ABCÉ😀", k=r.randrange(0, 12))) for _ in range(300)] + ["A" * 70 + "B"]
    utf16 = [w.encode("utf-16-le").decode("utf-16-le") for w in words]

    def units(w):
        data = w.encode("utf-16-le")
        return [data[i:i + 2] for i in range(0, len(data), 2)]

    pairs = [(r.choice(utf16), r.choice(utf16)) for _ in range(2000)]
    first, second = [p[0] for p in pairs], [p[1] for p in pairs]
    got = similarity.similarity_values(first, second, "JaroWinkler")
    assert list(got) == [jw_model(units(a), units(b)) for a, b in pairs]
    got = similarity.similarity_values(first, second, "NormalisedDamerauLevenshtein")
    assert list(got) == pytest.approx([osa_model(units(a), units(b)) for a, b in pairs])


def test_similarity_values(spark):
    rows = [("ABCDEF", "ABXYZW"), ("ABCVWXYZ", "CABVWXYZ"), ("CA", "ABC"), ("RICHARD", "RICHADR"),
            ("NIGHT", "NIGH"), ("", "A"), ("A", "A"), ("A", "B")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, l string, r string")
    l, r = F.col("l"), F.col("r")
    got = df.orderBy("i").select(
        similarity.jaro_winkler(l, r), similarity.osa_similarity(l, r), similarity.dice(l, r),
        similarity.token_jaccard(l, r), similarity.exact(l, r)).collect()
    assert got[0][0] == pytest.approx(0.6444, abs=1e-4) and got[1][0] == pytest.approx(0.9375)
    assert got[2][1] == 0 and got[3][1] == pytest.approx(6 / 7) and got[4][2] == pytest.approx(6 / 7)
    assert tuple(got[5]) == (0, 0, 0, 0, 0) and tuple(got[6]) == (1, 1, 1, 1, 1) and got[7][2] == 0
    similarity.register(spark)
    assert spark.sql("select kw_jaro_winkler_pairs(array(named_struct('l','A','r','A')))[0]").first()[0] == 1


def test_hashes(spark):
    key = bytes(range(32))
    got = column(spark, ["abc", "é"], lambda v: hashing.hmac_sha256(v, key))
    assert got == [hmac.new(key, x.encode(), hashlib.sha256).hexdigest().upper() for x in ("abc", "é")]
    import uuid

    raw = bytearray(hashlib.sha256("t\0a\0001\0b\0002\0p".encode()).digest()[:16])
    raw[7], raw[8] = raw[7] & 0x0F | 0x50, raw[8] & 0x3F | 0x80
    made = spark.range(1).select(hashing.reconciliation_review_id(
        *(F.lit(x) for x in ("t", "b", 2, "a", 1, "p")))).first()[0]
    assert made == str(uuid.UUID(bytes_le=bytes(raw)))


def test_configuration():
    base = c.MatchingProfile.from_dict({})
    assert base.weights.total == pytest.approx(1.0) and base.max_candidates is None
    for bad in (
        {"possible": 0.9}, {"probable": float("nan")}, {"weights": {"family": 2.0}},
        {"blocking_rules": ["Nope"]}, {"blocking_rules": []}, {"identifier_systems": ["x"]},
        {"default_results": 60, "max_results": 50}, {"max_results": 50, "max_candidates": 20}, {"comparators": {"given": ["Nickname"]}},
        {"comparators": {"phonetic_floor": 0}}, {"comparators": {"family": ["Exact", "Exact"]}},
    ):
        with pytest.raises(c.ConfigurationError):
            c.MatchingProfile.from_dict(bad)
    secret = c.Secret("v1", b"x" * 32)
    assert "x" * 32 not in repr(secret)
    for secrets in ((), (c.Secret("v1", b"short"),), (secret, secret)):
        with pytest.raises(c.ConfigurationError):
            c.TenantConfig("t", secrets).check()
    cfg = c.TenantConfig("t", (secret,)).check()
    changed = c.effective_config(cfg, {
        "profile_version": "v2", "possible": 0.5, "probable": 0.9, "required_approvals": 1,
        "sources": [{"source": "a", "trust": 10, "is_authoritative": True}]})
    assert changed.profile.probable == 0.9 and changed.authoritative_sources == ("a",)
    assert c.run_label(cfg) == c.run_label(cfg) != c.run_label(changed)


def test_lexicon(spark):
    from kinweave.functions.lexicon import build_lexicon

    rows = [("v1", "en-GB", "Robert", "Bob"), ("v1", "en-GB", "Robert", "Röb"), ("v1", "en-GB", "William", "Bill")]
    made = build_lexicon(spark.createDataFrame(rows, "lexicon_version string, culture string, canonical string, alias string"))
    assert dict(made[0].groups) == {
        "ROBERT": "ROBERT", "BOB": "ROBERT", "ROB": "ROBERT", "WILLIAM": "WILLIAM", "BILL": "WILLIAM"}
    clash = rows + [("v1", "en-GB", "Roberta", "bob")]
    with pytest.raises(c.ConfigurationError):
        build_lexicon(spark.createDataFrame(clash, "lexicon_version string, culture string, canonical string, alias string"))
