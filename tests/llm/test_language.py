import itertools
import random

import numpy as np

from kinweave.llm import lang_crf

SYLLABLES = {"aa": ["ba", "lo", "mi"], "bb": ["strk", "wrt", "zen"], "cc": ["éo", "ñu", "ça"]}
FIT = lang_crf.Fit(docs_per_language=30, runs_per_language=100, rounds=15, buckets=1 << 12)


def sentence(draw, lang, n):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randrange(1, 4))) for _ in range(n))


def test_forward_backward_is_exact():
    draw = np.random.default_rng(1)
    for lengths, block in itertools.product(([1], [3, 1, 5], [2, 7, 4, 1]), (1, 2, 3, 64)):
        lengths = np.array(lengths)
        scores, moves, start = draw.normal(size=(lengths.sum(), 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
        marginal, expected, log_sum = lang_crf.forward_backward(scores, lengths, moves, start, block)
        at, want, pairs, logs = 0, [], np.zeros((3, 3)), 0.0
        for n in lengths:
            own, at = scores[at:at + n], at + n
            weights, m, e = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
            for path in itertools.product(range(3), repeat=int(n)):
                w = np.exp(start[path[0]] + sum(own[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
                weights += w
                for i, y in enumerate(path):
                    m[i, y] += w
                for a, b in zip(path, path[1:]):
                    e[a, b] += w
            want.append(m / weights)
            pairs += e / weights
            logs += np.log(weights)
        assert np.allclose(marginal, np.concatenate(want)) and np.allclose(expected, pairs) and np.isclose(log_sum, logs)


def test_words_of_switched_text_are_labelled():
    draw = random.Random(5)
    texts = [(lang, sentence(draw, lang, 60)) for lang in SYLLABLES for _ in range(20)]
    model = lang_crf.learn([t for _, t in texts], [lang for lang, _ in texts], FIT)
    mixed = [sentence(draw, "aa", 30).split(), sentence(draw, "cc", 30).split()]
    marginal, lengths = lang_crf.label_words(model, [mixed[0] + mixed[1], []])
    best = [model.languages[k] for k in marginal.argmax(axis=1)]
    assert lengths.tolist() == [60, 0]
    assert np.mean([b == w for b, w in zip(best, ["aa"] * 30 + ["cc"] * 30)]) > 0.95


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1.0, "x") for i, t, lang in rows], "doc_id long, text string, lang string, score double, words string")


def test_identify(spark):
    draw = random.Random(6)
    rows = [(i, sentence(draw, lang, draw.randrange(5, 200)), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 ² _ ...", "aa"), (903, sentence(draw, "bb", 9), None), (None, sentence(draw, "bb", 9), "bb"),
           (904, sentence(draw, "cc", 8000), "cc"), (905, "a", "aa"), (905, "a", "aa")]
    got = lang_crf.identify(table(spark, rows + odd), fit=FIT).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in by.items() if i is not None)
    unseen = [by[i]["lang_pred"] == lang for i, _, lang in rows if by[i]["held_out"]]
    assert len(unseen) > 30 and np.mean(unseen) > 0.97
    assert {(by[i]["lang_pred"], by[i]["score"]) for i in (900, 901, 902)} == {("und", 0.0)}
    assert by[903]["lang_pred"] == "bb" and by[None]["lang_pred"] == "bb" and by[904]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = lang_crf.keep_identified(table(spark, rows + odd), fit=FIT)
    assert kept.columns == ["doc_id", "text", "lang", "score", "words"]
    assert kept.count() == len(rows) + len(odd) - 3


def test_nothing_to_learn_from(spark):
    got = lang_crf.identify(table(spark, [(1, "some text", None), (2, None, None)]), fit=FIT).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert lang_crf.identify(table(spark, []), fit=FIT).count() == 0


def test_labels_are_never_inputs_of_a_prediction(spark):
    draw = random.Random(7)
    rows = [(i, sentence(draw, lang, 40), lang) for i, lang in enumerate(list(SYLLABLES) * 20)]
    docs = table(spark, rows)
    model = lang_crf.learn_from(docs, ~lang_crf.held_out(), fit=FIT)
    one = lang_crf.predict(docs.select("text"), model).collect()
    assert len(one) == len(rows)
