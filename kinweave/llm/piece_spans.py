"""SentencePiece ids of whole texts with the span of source bytes behind every piece.

The text is normalised prefix by prefix: the longest entry of the model's compiled character map that
matches there gives the normalised bytes, each of which remembers where its source prefix began. The
pieces tile the normalised bytes, so their lengths alone project every piece back to the source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a worker remembers; at more it begins anew, which changes no result.
REMEMBERED = 700_000
_SPACE = "▁".encode()
_WORDS = re.compile(" +[^ ]+")


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, and the replacements.

    Layout: the trie's size in bytes (32 bits, little-endian), its 32-bit units, then zero-terminated
    replacements. Of a unit, bits 0-7 and 31 are the label, bit 8 says that a value follows, and the
    rest is the offset, shifted by 8 more where bit 9 is set; a value is where its replacement begins.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size:] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest entry that is a prefix of ``data[at:]``."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.texts[start:self.texts.index(b"\0", start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


@dataclass(frozen=True)
class Rules:
    """What a model says about normalising."""

    charmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = False
    escape: bool = True
    space_after: bool = False
    own_symbols: tuple[bytes, ...] = ()


class Normaliser:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.map = CharMap(rules.charmap)
        symbols = sorted(rules.own_symbols, key=len, reverse=True)
        self.symbols = re.compile(b"|".join(map(re.escape, symbols))) if symbols else None
        self.plain = not self.map.units and not symbols and not rules.squeeze and rules.escape and not rules.space_after

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        if self.symbols and (m := self.symbols.match(data, at)):
            return len(m[0]), m[0]
        if found := self.map.longest(data, at):
            return found
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, data[at:at + size]

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source offset of each and of the end) of a UTF-8 text."""
        if self.plain:
            return self._plain(data)
        rules, space = self.rules, _SPACE if self.rules.escape else b" "
        out, source, at = bytearray(), [], 0
        if rules.squeeze:
            while at < len(data) and not self._prefix(data, at)[1].strip(b" "):
                at += self._prefix(data, at)[0]
        if at == len(data):
            return b"", np.array([len(data)])
        if rules.dummy_prefix and not rules.space_after:
            out += space
            source += [at] * len(space)
        spaced = rules.squeeze
        while at < len(data):
            size, text = self._prefix(data, at)
            if spaced:
                text = text.lstrip(b" ")
            if text:
                made = text.replace(b" ", space)
                out += made
                source += [at] * len(made)
                spaced = rules.squeeze and text.endswith(b" ")
            at += size
        if rules.squeeze:
            while out.endswith(space):
                at = source[-len(space)]
                del out[-len(space):], source[-len(space):]
        if rules.dummy_prefix and rules.space_after:
            out += space
            source += [at] * len(space)
        return bytes(out), np.array([*source, at])

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """No map: spaces become the marker, all else stays; the same by arithmetic."""
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        head = _SPACE if self.rules.dummy_prefix else b""
        width = np.where(np.frombuffer(data, dtype=np.uint8) == 0x20, len(_SPACE), 1)
        source = np.repeat(np.arange(len(data), dtype=np.int64), width)
        source = np.concatenate((np.zeros(len(head), dtype=np.int64), source, [len(data)]))
        return head + data.replace(b" ", _SPACE), source


class PieceModel:
    """A model file: its ids for a text, and the source bytes behind each id."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        own = tuple(p.piece.encode() for p in model.pieces if p.type == kinds.USER_DEFINED)
        self.normaliser = Normaliser(Rules(
            spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces,
            spec.escape_whitespaces, model.trainer_spec.treat_whitespace_as_suffix, own))
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.unknown = self.library.unk_id()
        # a byte piece stands for one byte, a control piece for none, any other for its own text
        self.length = np.array([
            1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode())
            for p in model.pieces], dtype=np.int64)
        # words can be encoded apart where no piece reaches over the start of one
        inner = any("▁" in p.piece.lstrip("▁") for p in model.pieces)
        self.by_word = self.normaliser.plain and spec.add_dummy_prefix and not inner and model.trainer_spec.model_type == 2
        self.seen: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text without begin and end, as the library gives them; null is empty."""
        texts = [t or "" for t in texts]
        if not self.by_word:
            return [np.array(ids, dtype="<u4") for ids in self.library.encode(texts, num_threads=1)]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        # a word takes the spaces before it; the text's own first word has the dummy one
        words = [_WORDS.findall(s) if "  " in (s := " " + t) else [" " + w for w in t.split(" ")] for t in texts]
        # spaces at the end belong to no word, and a marker in the text itself joins with its neighbours
        tailed = [t.endswith(" ") or "▁" in t for t in texts]
        new = list(set().union(*(w for w, odd in zip(words, tailed) if not odd)).difference(self.seen))
        for word, ids in zip(new, self.library.encode([w[1:] for w in new], num_threads=1)):
            self.seen[word] = np.array(ids, dtype="<u4").tobytes()
        out = []
        for text, parts, odd in zip(texts, words, tailed):
            if odd:
                out.append(np.array(self.library.encode(text, num_threads=1), dtype="<u4"))
            else:
                out.append(np.frombuffer(b"".join(map(self.seen.__getitem__, parts)) if text else b"", dtype="<u4"))
        return out

    def spans(self, text: str | None, ids: np.ndarray) -> np.ndarray:
        """(begin, end) source bytes of each id; the normalised text must be what the pieces tile."""
        normal, source = self.normaliser.normalise((text or "").encode("utf-8", "surrogatepass"))
        size = self.length[ids]
        if not len(ids):
            ends = np.zeros(0, dtype=np.int64)
        elif int(size.sum()) == len(normal) and not (ids == self.unknown).any():
            ends = np.cumsum(size)
        else:
            ends = self._unknown_ends(normal, ids)
        if len(ids) and ends[-1] != len(normal):
            raise ValueError("the pieces do not tile the normalised text")
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return np.stack((source[begins], source[ends]), axis=1) if len(ends) else np.zeros((0, 2), dtype=np.int64)

    def _unknown_ends(self, normal: bytes, ids: np.ndarray) -> np.ndarray:
        """An unknown piece reaches to where the next known one is found."""
        at, ends = 0, []
        for k, i in enumerate(ids.tolist()):
            if i != self.unknown:
                at += int(self.length[i])
            else:
                after = next((j for j in ids[k + 1:].tolist() if j != self.unknown), None)
                piece = self.library.id_to_piece(after).encode() if after is not None else None
                at = normal.index(piece, at + 1) if piece else len(normal)
            ends.append(at)
        return np.array(ends, dtype=np.int64)


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _rows(model: PieceModel, texts: list[str | None]):
    ends = [model.bos] if model.bos >= 0 else [], [model.eos] if model.eos >= 0 else []
    for text, ids in zip(texts, model.encode(texts)):
        whole = np.concatenate((ends[0], ids, ends[1])).astype("<u4")
        yield text, ids, whole


def encode_spans(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``pieces``: an array of (id, begin, end), source bytes of the whole text.

    Begin and end ids are not pieces of the text and are left out. Null and empty texts have an empty
    array; all other columns and repeated rows stay as they are.
    """
    if "pieces" in docs.columns:
        raise ValueError("rename the column pieces first")

    @F.pandas_udf("array<struct<id:long,begin:long,end:long>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            yield pd.Series([
                [{"id": i, "begin": b, "end": e} for i, (b, e) in zip(ids.tolist(), model.spans(t, ids).tolist())]
                for t, ids, _ in _rows(model, texts)])

    return docs.withColumn("pieces", pieces(F.col(text)))


def round_trip(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of encoding and decoding each whole text, with begin and end ids.

    (doc_id, n_tokens, ids_sha256, decoded_sha256, n_spans, spans_sha256): the ids as little-endian
    unsigned 32-bit integers; the library's decoding of them; the pieces of the text and their source
    spans (pairs of little-endian 64-bit integers). A text whose pieces fail to tile it is an error.
    Null and empty texts have begin and end ids alone; repeated rows and null ids come back as they
    are; other columns are not read; an empty table gives an empty one.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_spans long, spans_sha256 string"

    @F.pandas_udf(f"struct<{schema.replace(' long', ':long').replace(' string', ':string')}>")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = piece_model(model_path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            rows = []
            texts = [t if isinstance(t, str) else None for t in batch]
            for at in range(0, len(texts), 1000):
                for one, ids, whole in _rows(model, texts[at:at + 1000]):
                    decoded = model.library.decode(whole.tolist()).encode("utf-8", "surrogatepass")
                    spans = model.spans(one, ids)
                    rows.append((len(whole), sha(whole.tobytes()), sha(decoded), len(spans), sha(spans.astype("<i8").tobytes())))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "n_spans", "spans_sha256"])

    return docs.select(F.col(doc_id).alias("_doc"), digests(F.col(text)).alias("_d")).select(
        F.col("_doc").alias(doc_id), "_d.*")
