"""Byte-level BPE of whole texts with the tokenizers library, one call for each distinct word.

A single space between two non-space characters always begins a new pre-token of the byte-level
pattern, so a text may be cut there and the parts encoded on their own: the ids are those of the
whole text. Most parts repeat, and a worker remembers what it has seen. Punctuation that closes a
word is a pre-token of its own, so a word is encoded once, whatever closes it; a word of letters is
one pre-token, so the library need not search it for others and its model alone gives the ids.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts a worker remembers (about 0.2 kB each); at more it begins anew, which changes no result.
REMEMBERED = 700_000
_JOINED = 512
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: ASCII punctuation that closes words, and the last letters of such words; other alphabets are left to the library.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")


class ByteBpe:
    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        added = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.begins[[i for piece, i in vocab.items() if piece.startswith("Ġ")]] = True
        cuts = self.library.pre_tokenizer
        self.words = None
        if isinstance(cuts, ByteLevel) and cuts.use_regex and not cuts.add_prefix_space and self.library.normalizer is None:
            self.words = Tokenizer(self.library.model)
            self.words.pre_tokenizer = CharDelimiterSplit(" ")
        self.seen: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _ids(self, texts: list[str], library=None) -> list[bytes]:
        got = (library or self.library).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _odd(self, part: str) -> bool:
        return not part or part.strip() is not part or bool(self.special and self.special.search(part))

    def _learn(self, parts: set[str]) -> None:
        """Encode new parts, each with the space before it, many in one text."""
        special = self.special and self.special.search(" ".join(parts))
        words, closed = set(), []
        for part in parts:
            if not part or part.strip() is not part or (special and self.special.search(part)):
                self.seen[part] = None
                continue
            if self.words:
                word = part.rstrip(_MARKS)
                if word is not part and word and word[-1] in _LETTERS:
                    closed.append(part)
                    part = word
            words.add(part)
        words.difference_update(self.seen)
        letters = [w for w in words if w.isascii() and w.isalpha()] if self.words else []
        self._remember(letters, "Ġ", self.words)
        self._remember(list(words.difference(letters)), " ", self.library)
        if closed:
            bare = [part.rstrip(_MARKS) for part in closed]
            tails = [part[len(word):] for part, word in zip(closed, bare)]
            new = list(set(tails).difference(self.tails))
            self.tails.update(zip(new, self._ids(new)))
            self.seen.update(zip(closed, map(add, map(self.seen.__getitem__, bare), map(self.tails.__getitem__, tails))))

    def _remember(self, words: list[str], space: str, library) -> None:
        between = space if space == " " else " " + space
        groups = [words[i:i + _JOINED] for i in range(0, len(words), _JOINED)]
        for group, flat in zip(groups, self._ids([space + between.join(g) for g in groups], library)):
            cuts = np.flatnonzero(self.begins[np.frombuffer(flat, dtype="<u4")]) * 4
            if len(cuts) == len(group):
                cuts = cuts.tolist() + [len(flat)]
                self.seen.update(zip(group, map(flat.__getitem__, map(slice, cuts, cuts[1:]))))
            else:
                self.seen.update(zip(group, self._ids([space + word for word in group], library)))

    def _slow(self, text: str) -> bytes:
        """A text with runs of white space or special tokens."""
        if self.special and self.special.search(text):
            return self._ids([text])[0]
        head, *rest = _CUT.split(text)
        return b"".join(self._ids([head, *(" " + part for part in rest)]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers; null is empty."""
        rest = [(t or "").split(" ") for t in texts]
        firsts = [parts.pop(0) for parts in rest]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        for small in (self.heads, self.tails):
            if len(small) > REMEMBERED // 10:
                small.clear()
        seen = self.seen.get
        found = [list(map(seen, parts)) for parts in rest]
        gaps = [[k for k, ids in enumerate(got) if ids is None] for got in found]
        self._learn(set(chain.from_iterable(map(parts.__getitem__, new) for parts, new in zip(rest, gaps))))
        heads = [h for h in set(firsts).difference(self.heads) if not self._odd(h)]
        self.heads.update(zip(heads, self._ids(heads)))
        out = []
        for text, first, others, got, new in zip(texts, firsts, rest, found, gaps):
            if not text:
                out.append(b"")
                continue
            late = [seen(others[k]) for k in new]
            for k, ids in zip(new, late):
                got[k] = ids
            head = self.heads.get(first)
            out.append(self._slow(text) if head is None or None in late else head + b"".join(got))
        return out


@lru_cache(maxsize=4)
def byte_bpe(path: str, special_as_text: bool = False) -> ByteBpe:
    """One for each worker process and file."""
    return ByteBpe(path, special_as_text)
