"""The registered queries over the smallest tables, against brute force."""

import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from brute import check_packing, components, crc, masked, pii, sha, simhash_groups, token_ids
from kinweave.llm import queries
from kinweave.llm.oracles import ORACLES

DATA = "/root/testdata/sf0.001"


def rows(table, columns):
    return duckdb.sql(f"select {columns} from '{DATA}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return dict(rows("documents", "doc_id, text"))


def run(spark, name):
    return queries.QUERIES[name](spark, DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        db.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    got = [tuple(r[c] for c in columns) for r in run(spark, name).collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_languages(spark, texts):
    langs = dict(rows("documents", "doc_id, lang"))
    got = run(spark, "op3_language").collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(right) > 0.95


def test_nearest_and_near_vectors(spark):
    table = rows("embeddings", "vec_id, embedding")
    ids, vectors = np.array([i for i, _ in table]), np.array([v for _, v in table], dtype=float)
    found = {}
    for r in run(spark, "op4_nearest").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[k]
        best = [ids[j] for j in np.lexsort((ids, -scores)) if j != k][:20]
        assert len(found[ids[k]]) == len(best)
        hits, total = hits + len(found[ids[k]] & set(best)), total + len(best)
    assert hits / total >= 0.9
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)))]
    got = run(spark, "op5_near_vectors").collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == components(pairs, ids.tolist())
    assert sum(r["n_links"] for r in got) == 2 * len(pairs)


def test_pieces(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.public_tokenizers.path(queries.PIECE_BPE))
    got = run(spark, "op6_sentencepiece").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = model.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()))
        assert r["decoded_sha256"] == sha(model.decode(ids).encode())


def test_packing_and_token_files(spark, texts):
    assert check_packing(run(spark, "op7_packing").collect(), list(texts.items())) < 0.02
    at = 0
    for r in sorted(run(spark, "op10_token_ids").collect(), key=lambda r: r["doc_id"]):
        ids = token_ids(texts[r["doc_id"]], 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_near_duplicates(spark, texts):
    prints, want = simhash_groups(texts.items())
    got = run(spark, "op8_simhash").collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_personal_data(spark, texts):
    for r in run(spark, "op9_pii").collect():
        base = pii(texts[r["doc_id"]])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == sha(written.encode())
        assert set(filter(None, written.split(","))) <= set(filter(None, r["spans"].split(",")))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]


def test_pipeline(spark, texts):
    """Every stage on what the one before kept, against brute force; the learned parts decide nothing here."""
    got = corpus_pipeline.run(spark, DATA).collect()
    spoken = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    _, groups = simhash_groups(spoken.items())
    kept = [(i, masked(t, pii(t))) for i, t in sorted(spoken.items()) if groups[i] == i]
    assert check_packing(got, kept) < 0.02
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "packing"]


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, DATA)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
