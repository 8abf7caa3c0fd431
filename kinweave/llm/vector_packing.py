"""Packing into fixed-length sequences under several limits at once.

Vector bin packing by the dot-product heuristic: one sequence is open at a time, and of all examples
that still fit, the one whose demands have the largest dot product with what is left of every limit
goes in next. Pools of a bounded number of examples are packed on their own, in one task each.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.byte_bpe import byte_bpe

#: Examples that are packed together; a task holds one pool at a time.
POOL = 2048
#: Gaps of fewer ids stay padding instead of cutting a document for them.
LEAST_CUT = 16


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


def pack_pool(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[int]]:
    """Groups of positions, each within the limits; every position is in exactly one group.

    Items of the same shape are interchangeable, so a step looks at the shapes and not at the items.
    An item that breaks a limit by itself is an error: callers set those aside.
    """
    if not len(tokens):
        return []
    shapes, which = np.unique(np.stack([tokens, np.ones_like(tokens), loss], axis=1), axis=0, return_inverse=True)
    if (shapes > limits.array()).any():
        raise ValueError("an item is larger than a limit")
    where = defaultdict(list)
    for item, shape in enumerate(which.reshape(-1).tolist()):
        where[shape].append(item)
    left = np.array([len(where[s]) for s in range(len(shapes))])
    shapes = shapes.astype(np.float64)
    full = limits.array()
    # a scarce limit weighs more: its share of the demand of the whole pool
    demand = (shapes * left[:, None]).sum(axis=0) / full
    scaled = shapes / full * (demand / demand.sum())
    groups = []
    while len(shapes):
        room, group = full.copy(), []
        while True:
            score = scaled @ (room / full)
            score[(shapes > room).any(axis=1)] = -1
            best = int(score.argmax())
            if score[best] < 0:
                break
            group.append(where[best].pop())
            left[best] -= 1
            room -= shapes[best]
            if not left[best]:
                keep = np.flatnonzero(left)
                where = {new: where[old] for new, old in enumerate(keep.tolist())}
                shapes, scaled, left = shapes[keep], scaled[keep], left[keep]
                if not len(shapes):
                    break
        groups.append(group)
    return groups


def _filled(groups: list[list[int]], tokens: np.ndarray, limits: Limits, least: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length): the emptiest groups are cut up to fill the others' gaps."""
    fill = [sum(int(tokens[i]) for i in g) for g in groups]
    order = sorted(range(len(groups)), key=lambda g: -fill[g])
    sequences = [[(i, 0, int(tokens[i])) for i in groups[g]] for g in order]
    room = [limits.tokens - fill[g] for g in order]
    first, last = 0, len(sequences) - 1
    while first < last:
        spare = min(room[first], limits.loss - sum(p[2] for p in sequences[first]))
        if spare < least or len(sequences[first]) >= limits.segments:
            first += 1
            continue
        item, start, length = sequences[last].pop()
        take = min(spare, length)
        sequences[first].append((item, start, take))
        room[first] -= take
        if take < length:
            sequences[last].append((item, start + take, length - take))
        room[last] += take
        if not sequences[last]:
            sequences.pop()
            last -= 1
    return sequences


PIECES = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text",
    end_id: int = 0, pool: int = POOL, least_cut: int = LEAST_CUT,
) -> DataFrame:
    """Pieces of whole documents, each at its place in a sequence: doc_id and ``PIECES``.

    A document's ids, closed by ``end_id``, are cut into sequences of their own as long as they fill
    one; the rest is an example of the pool, where every id bears loss. Null and empty texts are the
    end id alone; repeated rows and null ids are documents like any other; other columns are not
    read. Rows are packed where they lie, without a shuffle: the sequence numbers follow from the
    partition, so a task that is run again gives the same ones. At most one sequence of a pool keeps
    a gap of ``least_cut`` or more.
    """
    kind = dict(docs.dtypes)[doc_id]
    if limits.loss < limits.tokens:
        raise ValueError("documents bear loss on every token; give pack_examples a lower limit instead")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, end = byte_bpe(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held: list[tuple] = []  # (document, start, ids, ids of the document)

        def put(sequence: int, doc, start: int, ids: bytes, total: int, offset: int) -> None:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

        def pack() -> None:
            nonlocal number
            tokens = np.array([len(h[2]) // 4 for h in held], dtype=np.int64)
            for sequence in _filled(pack_pool(tokens, tokens, limits), tokens, limits, least_cut):
                offset = 0
                for item, start, length in sequence:
                    doc, before, ids, total = held[item]
                    put(number, doc, before + start, ids[4 * start:4 * (start + length)], total, offset)
                    offset += length
                number += 1
            held.clear()

        def drained() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out.astype({"doc": "object"})

        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["body"]]
            names = batch["doc"].tolist()
            for at in range(0, len(texts), 1000):
                for doc, ids in zip(names[at:at + 1000], bpe.encode(texts[at:at + 1000])):
                    doc = None if doc is None or doc != doc else doc
                    ids += end
                    total, step = len(ids) // 4, limits.tokens
                    whole = total // step * step
                    for start in range(0, whole, step):
                        put(number, doc, start, ids[4 * start:4 * (start + step)], total, 0)
                        number += 1
                    if whole < total:
                        held.append((doc, whole, ids[4 * whole:], total))
                    if len(held) == pool:
                        pack()
                if rows:
                    yield drained()
        pack()
        if rows:
            yield drained()

    named = docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).alias("body"))
    return named.mapInPandas(place, f"doc string, {PIECES}").select(
        F.col("doc").cast(kind).alias(doc_id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_examples(examples: DataFrame, limits: Limits, tokens: str = "tokens", loss: str = "loss", pool: int = POOL) -> DataFrame:
    """``examples`` with (sequence_id, offset); examples stay whole, as instruction data must.

    ``tokens`` and ``loss`` count an example's ids and those that bear loss; null counts as zero. An
    example that breaks a limit by itself, or has a negative count, comes back with a null sequence.
    """
    columns = examples.columns
    clash = {"sequence_id", "offset", "_tokens", "_loss"} & set(columns)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema.fields)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), pool):
                part = batch.iloc[at:at + pool].copy()
                n, m = part.pop("_tokens").to_numpy(np.int64), part.pop("_loss").to_numpy(np.int64)
                fits = np.flatnonzero((n >= 0) & (m >= 0) & (n <= limits.tokens) & (m <= limits.loss))
                sequence, offset = [None] * len(part), [None] * len(part)
                for group in pack_pool(n[fits], m[fits], limits):
                    used = 0
                    for item in fits[group].tolist():
                        sequence[item], offset[item] = number, used
                        used += int(n[item])
                    number += 1
                part["sequence_id"], part["offset"] = pd.array(sequence, "Int64"), pd.array(offset, "Int64")
                yield part

    counted = examples.select(
        *columns, F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("_tokens"),
        F.coalesce(F.col(loss).cast("long"), F.lit(0)).alias("_loss"))
    return counted.mapInPandas(place, f"{fields}, sequence_id long, offset long")
