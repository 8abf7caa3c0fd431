"""Plain Python versions of the contracts, to compare results with."""

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import xxhash

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_ok(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            n = int(c) * (2 if i % 2 else 1)
            total += n - 9 if n > 9 else n
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def pii(text):
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if pii_ok(k, m[0])]


def masked(text, spans):
    for kind, start, end in sorted(spans, key=lambda s: -s[1]):
        text = text[:start] + f"[{kind.upper()}]" + text[end:]
    return text


def simhash(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash_groups(docs):
    """{doc_id: smallest reachable id} over fingerprints that differ in two bits or fewer."""
    prints = {i: simhash(t) for i, t in docs}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (prints[a] ^ prints[b]).bit_count() <= 2]
    return prints, components(pairs, ids)


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text, end):
    ids = tokenizer().encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], dtype="<u4")


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def check_packing(rows, docs, limit=1024, end=0):
    """Every id of every document lies in one piece; sequences are gapless and within the limit. Returns the padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for doc, text in docs:
        ids, at = token_ids(text, end), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at:at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding / sum(r["length"] for r in rows)
