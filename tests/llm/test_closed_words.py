"""Words are encoded once, whatever punctuation closes them, and ids stay those of the whole text."""

import random

import numpy as np
import public_tokenizers
import pytest

from kinweave.llm.byte_bpe import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_word_is_encoded_once_whatever_closes_it():
    bpe, given = ByteBpe(PATH), []
    own = bpe._ids
    bpe._ids = lambda texts, *more: given.extend(texts) or own(texts, *more)
    bpe.encode(["a blerthon, blerthon. blerthon blerthon!!", "b blerthon;"])
    assert sum(text.count("blerthon") for text in given) == 1


@pytest.mark.parametrize("as_text", [False, True])
def test_closed_words_have_the_ids_of_the_whole_text(as_text):
    marks = ["a", "é", "ÿ", "×", "Ā", "日", "٣", "1", " ", "  ", "\n", "\x1c", "'", "'s", "'ll", ",", ".", "_", "…", "<", "<|endoftext|>", "|>", "word", "Über", "ª", "́"]
    draw = random.Random(7)
    texts = [None, "", "it's, it's' 's. word'll, é… é…, 1, ²."] + ["".join(draw.choices(marks, k=draw.randint(0, 25))) for _ in range(3000)]
    bpe = ByteBpe(PATH, as_text)
    want = [np.array(bpe.library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert bpe.encode(texts) == want
