import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from kinweave.llm import piece_spans

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = piece_spans.PieceModel(PATH)
ODD = ["", None, " a", "a ", "a  b", "   ", "\n\n x  y\t z ", "▁ b▁c", "日本 語 😀", "a\x00b", "<s> x </s>", "<0x41> q", " ", "word " * 500, "é" * 300]


def check(text):
    ids = MODEL.encode([text])[0]
    assert ids.tolist() == MODEL.library.encode(text or "")
    data = (text or "").encode()
    spans = MODEL.spans(text, ids).tolist()
    assert b"".join(data[a:b] for a, b in spans) == data
    for i, (a, b) in zip(ids.tolist(), spans):
        if i > 258 and i != MODEL.unknown:
            assert MODEL.library.id_to_piece(i).replace("▁", " ").strip(" ") == data[a:b].decode().replace("▁", " ").strip(" ")


def test_ids_and_spans_of_odd_texts():
    for text in ODD:
        check(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab the.,\n\t  é世▁-"), max_size=40))
def test_ids_and_spans_of_any_text(text):
    check(text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps_normalise_like_the_library(rule, squeeze):
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    model = proto.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = piece_spans.Normaliser(piece_spans.Rules(model.normalizer_spec.precompiled_charsmap, True, squeeze, True))
    for text in [t or "" for t in ODD] + ["ｆｕｌｌ　width ㍿ ①② ﬁ é", "ÀÉ ﷺ ½ x", "  lead  and trail  ", "a​b c"]:
        want, places = library.normalize(text, with_offsets=True)
        got, source = own.normalise(text.encode())
        assert got.decode() == want
        starts = [source[i] for i, c in enumerate(got) if c & 0xC0 != 0x80]
        assert [len(text.encode()[:s].decode()) for s in starts] == list(places)[:len(starts)]


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (3, "again")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, pieces string")
    got = piece_spans.round_trip(table, PATH).collect()
    want = []
    for i, t in rows:
        ids = MODEL.library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256(MODEL.library.decode(ids).encode()).hexdigest()))
    assert Counter(tuple(r)[:4] for r in got) == Counter(want)
    assert piece_spans.round_trip(table.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        piece_spans.encode_spans(table, PATH)
    one = piece_spans.encode_spans(table.drop("pieces").where("doc_id = 4"), PATH).collect()[0]
    assert [(p["begin"], p["end"]) for p in one["pieces"]][-1][1] == len("a  b")
