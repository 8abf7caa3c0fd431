import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import check_packing, crc, token_ids, tokenizer
from kinweave.llm import pfor, vector_packing
from kinweave.llm.byte_bpe import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " a", "a ", "a  b", "\n\n x  y\t z ", "<|endoftext|> a b", "a <|endoftext|>b c", "it's  we'll 're", "１２ ab  c", "a \x1c b \x85 c d",
       "1 23 4.5\n 6", "퟿ é è", "😀 👍🏽 x", "  a  b", "a  b 　c", "x" * 5000, "the same the same the same"]
BPE = ByteBpe(PATH)


def decode(data):
    return np.frombuffer(data, "<u4").tolist()


def test_cut_texts_give_the_ids_of_whole_ones():
    want = [tokenizer().encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert [decode(x) for x in BPE.encode(ODD)] == want
    plain = ByteBpe(PATH, special_as_text=True)
    assert 50256 in decode(BPE.encode(["a <|endoftext|>"])[0]) and 50256 not in decode(plain.encode(["a <|endoftext|>"])[0])


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab E1'.,\n\t  é世-"), max_size=40))
def test_any_text_gives_the_ids_of_the_library(text):
    assert decode(BPE.encode([text])[0]) == tokenizer().encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([1, 8, 64, 512]), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(ids, block, fits):
    parts = pfor.encode_blocks(np.array(ids, dtype=np.uint32), block, fits)
    starts = np.cumsum([0, *map(len, parts)])[:-1].astype(np.int64)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    assert pfor.decode_blocks(data, starts, block).tolist() == ids


def test_files_round_trip_and_damage():
    rows = [(1, b""), (None, np.arange(1500, dtype="<u4").tobytes()), (7, np.array([2**32 - 1, 0], dtype="<u4").tobytes())]
    content = b"".join(p + b"\n" for p in pfor._file(5, iter(rows), 512, 0.9))
    ordinal, docs, ends, ids = pfor.read_file(content)
    assert (ordinal, docs, ends.tolist()) == (5, [1, None, 7], [0, 1500, 1502])
    assert ids.tolist() == [*range(1500), 2**32 - 1, 0]
    for bad in (content[:-1], content[1:], b"", content.replace(pfor.MAGIC, b"PFORids9")):
        with pytest.raises(ValueError):
            pfor.read_file(bad)


def docs_table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, start string, tie int")


def test_corpus_files(spark):
    rows = [(i * 3 % 40, t) for i, t in enumerate(ODD)] + [(90, "repeated row")] * 3 + [(90, "same id, other text")]
    got = pfor.encode_corpus(docs_table(spark, rows), PATH, end_id=2, file_bytes=400).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (i, len(token_ids(t, 2)), crc(token_ids(t, 2))) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(i for i, _ in rows)
    assert pfor.encode_corpus(docs_table(spark, []), PATH).count() == 0
    assert pfor.encode_corpus(docs_table(spark, [(None, None)]), PATH).collect()[0]["n_tokens"] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 40)), max_size=60))
def test_pools_keep_every_limit(items):
    limits = vector_packing.Limits(tokens=100, segments=5, loss=60)
    tokens, loss = np.array([t for t, _ in items], dtype=np.int64), np.array([x for _, x in items], dtype=np.int64)
    groups = vector_packing.pack_pool(tokens, loss, limits)
    assert sorted(i for g in groups for i in g) == list(range(len(items)))
    for g in groups:
        assert tokens[g].sum() <= 100 and loss[g].sum() <= 60 and len(g) <= 5


def test_pools_fill_sequences():
    draw = np.random.default_rng(0)
    tokens = draw.integers(1, 1024, 2000)
    groups = vector_packing.pack_pool(tokens, tokens, vector_packing.Limits())
    assert len(groups) <= 1.02 * tokens.sum() / 1024 + 1
    with pytest.raises(ValueError):
        vector_packing.pack_pool(np.array([2000]), np.array([1]), vector_packing.Limits())


def test_documents_are_packed_whole(spark):
    draw = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "word " * draw.randrange(1, 3000)) for i in range(60)]
    got = vector_packing.pack_documents(docs_table(spark, rows).coalesce(1), PATH).collect()
    assert check_packing(got, rows) < 0.02
    few = vector_packing.pack_documents(docs_table(spark, rows).coalesce(1), PATH, vector_packing.Limits(256, 2, 256), pool=16).collect()
    check_packing(few, rows, 256)
    assert max(Counter(r["sequence_id"] for r in few).values()) <= 2
    assert vector_packing.pack_documents(docs_table(spark, []), PATH).count() == 0
    twice = vector_packing.pack_documents(docs_table(spark, [(None, "a b"), (None, "a b"), (3, None)]), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in twice) == [(0, 3), (0, 3), (3, 1)]


def test_examples_stay_whole(spark):
    rows = [(i, 10 * i % 90, 5 * i % 50, "k") for i in range(50)] + [(50, 500, 1, "k"), (51, 1, 500, "k"), (52, None, None, None), (53, -1, 0, "k")]
    limits = vector_packing.Limits(tokens=100, segments=3, loss=40)
    table = spark.createDataFrame(rows, "id int, tokens int, loss int, row string").coalesce(1)
    got = vector_packing.pack_examples(table, limits).collect()
    assert sorted(r["id"] for r in got) == list(range(54))
    assert {r["id"] for r in got if r["sequence_id"] is None} == {r[0] for r in rows if (r[1] or 0) > 100 or (r[2] or 0) > 40 or (r[1] or 0) < 0}
    sequences = {}
    for r in got:
        if r["sequence_id"] is not None:
            sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        assert len(pieces) <= 3 and sum(p["tokens"] or 0 for p in pieces) <= 100 and sum(p["loss"] or 0 for p in pieces) <= 40
    with pytest.raises(ValueError):
        vector_packing.pack_examples(table.withColumnRenamed("row", "offset"), limits)
