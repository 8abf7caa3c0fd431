"""Token ids of a corpus in files of patched frame-of-reference blocks.

A file is: a header, blocks, an index and a trailer. Every block holds ``BLOCK`` ids (the last one
of a file may hold fewer): its minimum is subtracted, the differences are packed bit plane by bit
plane at the width that fits a percentile of them, and whatever is wider stands whole in an
exception list. The index has where each block starts and which ids belong to which document.
Every part is followed by one guard byte, a line feed, which is what Spark's text writer puts there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.byte_bpe import byte_bpe
from kinweave.llm.common import stage
from kinweave.session import working_folder

MAGIC = b"PFORids1"
BLOCK = 512
#: Share of a block's values that must fit the packed width.
FITS = 0.9
#: Text bytes that go to one file; a task holds one file's ids.
FILE_BYTES = 16 << 20
_HEAD = struct.Struct("<8sIQ")  # magic, block size, ordinal of the file
_BLOCK = np.dtype([("n", "<u2"), ("low", "<u4"), ("width", "u1"), ("odd", "<u2")])
_TAIL = struct.Struct("<QQQQ8s")  # index start, blocks, documents, ids, magic
_GUARD = b"\n"


def encode_blocks(ids: np.ndarray, block: int = BLOCK, fits: float = FITS) -> list[bytes]:
    """Blocks of ``ids`` (unsigned 32-bit), each as bytes."""
    n = len(ids)
    if not n:
        return []
    count = -(-n // block)
    values = np.empty(count * block, dtype=np.uint32)
    values[:n] = ids
    values[n:] = ids[(count - 1) * block:].min()
    values = values.reshape(count, block)
    low = values.min(axis=1)
    delta = values - low[:, None]
    at = min(block - 1, int(np.ceil(fits * block)) - 1)
    bound = np.partition(delta, at, axis=1)[:, at]
    width = np.frexp(bound.astype(np.float64))[1].astype(np.int64)
    out: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        part = delta[rows]
        planes = np.empty((len(rows), w, -(-block // 8)), dtype=np.uint8)
        for bit in range(w):
            planes[:, bit] = np.packbits(((part >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little")
        who, where = np.nonzero(part >> np.uint32(w)) if w < 32 else (np.empty(0, int), np.empty(0, int))
        cuts = np.searchsorted(who, np.arange(len(rows) + 1))
        where, whole = where.astype("<u2"), part[who, where].astype("<u4")
        head = np.zeros(len(rows), dtype=_BLOCK)
        head["n"] = np.minimum(block, n - rows * block)
        head["low"], head["width"], head["odd"] = low[rows], w, np.diff(cuts)
        for k, row in enumerate(rows.tolist()):
            a, b = cuts[k], cuts[k + 1]
            out[row] = head[k].tobytes() + planes[k].tobytes() + where[a:b].tobytes() + whole[a:b].tobytes()
    return out


def decode_blocks(data: np.ndarray, starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of the blocks of ``data`` (bytes) that begin at ``starts``, in that order."""
    if not len(starts):
        return np.empty(0, dtype=np.uint32)
    head = data[starts[:, None] + np.arange(_BLOCK.itemsize)].copy().view(_BLOCK)[:, 0]
    values = np.zeros((len(starts), block), dtype=np.uint32)
    plane = -(-block // 8)
    for w in np.unique(head["width"]).tolist():
        rows = np.flatnonzero(head["width"] == w)
        part = np.zeros((len(rows), block), dtype=np.uint32)
        for bit in range(w):
            at = starts[rows] + _BLOCK.itemsize + bit * plane
            bits = np.unpackbits(data[at[:, None] + np.arange(plane)], axis=1, bitorder="little", count=block)
            part |= bits.astype(np.uint32) << np.uint32(bit)
        values[rows] = part
    raw = data.tobytes()
    for row in np.flatnonzero(head["odd"]).tolist():
        odd = int(head["odd"][row])
        at = int(starts[row]) + _BLOCK.itemsize + int(head["width"][row]) * plane
        where = np.frombuffer(raw, "<u2", odd, at)
        values[row, where] = np.frombuffer(raw, "<u4", odd, at + 2 * odd)
    values += head["low"][:, None]
    short = head["n"] < block
    if not short.any():
        return values.reshape(-1)
    return values[np.arange(block)[None, :] < head["n"][:, None]]


def _file(ordinal: int, rows: Iterator[tuple[int | None, bytes]], block: int, fits: float) -> Iterator[bytes]:
    """The parts of one file from (document, ids as bytes), without their guard bytes."""
    part = _HEAD.pack(MAGIC, block, ordinal)
    at, starts, docs, ends, held, kept, total = len(part) + 1, [], [], [], [], 0, 0
    yield part

    def flush(last: bool) -> Iterator[bytes]:
        nonlocal at, held, kept
        ids = np.frombuffer(b"".join(held), dtype="<u4")
        whole = len(ids) if last else len(ids) // block * block
        for made in encode_blocks(ids[:whole], block, fits):
            starts.append(at)
            at += len(made) + 1
            yield made
        held, kept = [ids[whole:].tobytes()], 4 * (len(ids) - whole)

    for doc, ids in rows:
        docs.append(doc)
        total += len(ids) // 4
        ends.append(total)
        held.append(ids)
        kept += len(ids)
        if kept >= 4 * block * 2048:
            yield from flush(False)
    yield from flush(True)
    named = np.array([d is not None for d in docs], dtype=np.uint8)
    index = b"".join((
        np.array(starts, dtype="<u8").tobytes(), np.array([d or 0 for d in docs], dtype="<i8").tobytes(),
        np.array(ends, dtype="<u8").tobytes(), named.tobytes()))
    yield index
    yield _TAIL.pack(at, len(starts), len(docs), total, MAGIC)


def read_file(content: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(ordinal, documents, their ends, ids) of one file; a damaged file is an error."""
    if len(content) < _HEAD.size + _TAIL.size + 2:
        raise ValueError("token file is too short")
    magic, block, ordinal = _HEAD.unpack_from(content)
    at, blocks, count, total, last = _TAIL.unpack_from(content, len(content) - _TAIL.size - 1)
    if magic != MAGIC or last != MAGIC or at + 8 * blocks + 17 * count + _TAIL.size + 2 != len(content):
        raise ValueError("not a whole token file")
    starts = np.frombuffer(content, "<u8", blocks, at).astype(np.int64)
    docs = np.frombuffer(content, "<i8", count, at + 8 * blocks)
    ends = np.frombuffer(content, "<u8", count, at + 8 * blocks + 8 * count).astype(np.int64)
    named = np.frombuffer(content, "u1", count, at + 8 * blocks + 16 * count)
    ids = decode_blocks(np.frombuffer(content, dtype=np.uint8), starts, block)
    if len(ids) != total or (count and ends[-1] != total):
        raise ValueError("token file holds another number of ids than its index says")
    return ordinal, [int(d) if n else None for d, n in zip(docs, named)], ends, ids


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2,
    block: int = BLOCK, fits: float = FITS, file_bytes: int = FILE_BYTES,
) -> None:
    """Encode whole texts and write them to ``folder`` in ascending order of document.

    Files are ranges of (document, hash of the text), so rows that share an id do not pile up in one
    task, and their number follows from the bytes of text. Null texts are empty and hold the end id
    alone; null ids come first; repeated rows are written as often as they occur. A task that is run
    again writes the same file. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    files = -(-size // file_bytes) or 1
    rows = rows.withColumn("tie", F.xxhash64("body"))
    ranged = rows.repartitionByRange(int(files), "doc", "tie").sortWithinPartitions("doc", "tie")
    end = np.array([end_id], dtype="<u4").tobytes()

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, bytes]]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            named = [None if pd.isna(d) else int(d) for d in batch["doc"]]
            texts = [t if isinstance(t, str) else None for t in batch["body"]]
            for start in range(0, len(texts), 1000):
                for doc, ids in zip(named[start:start + 1000], bpe.encode(texts[start:start + 1000])):
                    yield doc, ids + end

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        rows = encoded(batches)
        first = next(rows, None)
        if first is None:
            return
        for part in _file(TaskContext.get().partitionId(), _chain(first, rows), block, fits):
            parts.append(part)
            held += len(part)
            if held > 4 << 20:
                yield pd.DataFrame({"part": parts})
                parts, held = [], 0
        yield pd.DataFrame({"part": parts})

    # the text writer puts the bytes of a string down as they are, and the guard after them
    made = ranged.mapInPandas(write, "part binary").select(F.col("part").cast("string").alias("value"))
    made.write.option("lineSep", _GUARD.decode()).text(folder)


def _chain(first, rest):
    yield first
    yield from rest


def read_ids(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a folder.

    ``start`` counts the ids of all documents before it over all files; only each file's total is
    summed up in one place. The checksum is of the ids as little-endian unsigned 32-bit integers.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                if not len(content):
                    continue
                ordinal, docs, ends, ids = read_file(bytes(content))
                flat = ids.astype("<u4", copy=False).tobytes()
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                yield pd.DataFrame({
                    "file": ordinal, "doc_id": pd.array(docs, dtype="Int64"), "at": starts, "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(flat[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
                })

    files = spark.read.format("binaryFile").load(folder).select("content")
    docs = stage(files.mapInPandas(decode, "file long, doc_id long, at long, n_tokens long, ids_crc32 long"), "pfor-read")
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return docs.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int = 2, **options) -> DataFrame:
    """Write the corpus to a new folder of the shared one and return what the files hold."""
    folder = working_folder(docs.sparkSession, "pfor")
    write_ids(docs, folder, tokenizer, end_id=end_id, **options)
    return read_ids(docs.sparkSession, folder)
