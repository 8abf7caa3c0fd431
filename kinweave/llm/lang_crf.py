"""Languages of the words of a text by a linear-chain conditional random field.

Every word scores each language by learned weights of its affixes and character n-grams (hashed; an
n-gram that holds the mark before or after the word is an affix) and of the word itself where the
lexicon of the sample has it. Learned transitions tie neighbours together, and forward-backward over
the whole text gives each word's probability of each language. A document's language is the one with
the largest mean probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import short_batches

UNDECIDED = "und"
#: Runs of letters; signs like superscript digits are sorted out by ``isalpha``.
_WORD = re.compile(r"[^\W\d_]+")
_NGRAMS = (1, 2, 3, 4)
#: Words whose steps are multiplied up one after the other; blocks of all texts advance side by side.
BLOCK = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Fit:
    """How the field is learned; the sample is bounded by these numbers alone."""

    docs_per_language: int = 200
    sample_chars: int = 100_000  # longer texts are not taken into the sample
    runs_per_language: int = 800  # training runs of ``run`` words, drawn evenly from the sample
    run: int = 20
    chain: int = 10  # runs of any languages that make one training sequence
    buckets: int = 1 << 16
    lexicon_count: int = 3  # uses in the sample that put a word into the lexicon
    rounds: int = 25
    rate: float = 0.4
    decay: float = 1e-4
    seed: int = 7
    max_languages: int = 200


@dataclass
class Field:
    """A learned field: languages, weights of hashed features and of known words, transitions."""

    languages: list[str]
    hashed: np.ndarray  # buckets x languages
    lexicon: dict[str, int]
    known: np.ndarray  # words of the lexicon (and a zero row) x languages
    bias: np.ndarray
    moves: np.ndarray  # from x to
    start: np.ndarray = field(default=None)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words: words x languages."""
        where, which = hashed_features(words, len(self.hashed))
        sums = np.add.reduceat(self.hashed[where], which, axis=0) if len(words) else np.zeros((0, len(self.languages)))
        size = np.diff(np.append(which, len(where)))
        rows = np.fromiter((self.lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        return sums / np.sqrt(size)[:, None] + self.known[rows] + self.bias


def hashed_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each n-gram, where each word's features begin), n-grams within marked words."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(codes))
    hashes, valid = np.empty((len(codes), len(_NGRAMS)), dtype=np.int64), np.empty((len(codes), len(_NGRAMS)), dtype=bool)
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for k, n in enumerate(_NGRAMS):
        shifted = np.zeros(len(codes), dtype=np.uint64)
        shifted[:len(codes) - n + 1] = codes[n - 1:]
        rolled = (rolled ^ shifted) * _MULTIPLIER
        rolled ^= rolled >> np.uint64(29)
        hashes[:, k] = ((rolled * np.uint64(2 * n + 1)) >> np.uint64(40)) % np.uint64(buckets)
        valid[:, k] = at + n <= ends
    counts = np.add.reduceat(valid.sum(axis=1), np.cumsum(sizes) - sizes)
    return hashes[valid], np.cumsum(counts) - counts


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, float]:
    """Exact marginals of many sequences at once.

    ``scores`` holds the sequences one after the other (words x languages). Each is cut into blocks;
    a block's product of step matrices carries the forward and backward vectors over it, so all blocks
    of all sequences advance side by side and a very long text takes few steps more. Returns the
    marginals, the expected transitions (from x to) and the sum of the log partition functions.
    """
    n_labels = scores.shape[1]
    lengths = lengths[lengths > 0]
    if not len(scores):
        return np.zeros_like(scores), np.zeros((n_labels, n_labels)), 0.0
    high = scores.max(axis=1, keepdims=True)
    weight = np.exp(scores - high)
    per = -(-lengths // block)
    first = np.cumsum(per) - per  # each sequence's first block
    lanes = int(per.sum())
    offset = np.cumsum(lengths) - lengths
    spot = np.repeat(first * block - offset, lengths) + np.arange(len(scores))
    steps = np.ones((lanes * block, n_labels))
    steps[spot] = weight
    steps = steps.reshape(lanes, block, n_labels)
    real = np.zeros(lanes * block, dtype=bool)
    real[spot] = True
    real = real.reshape(lanes, block)
    opens = np.zeros(lanes, dtype=bool)
    opens[first] = True
    trans, total = np.exp(moves), 0.0

    def through(vectors: np.ndarray, t: int) -> np.ndarray:
        """Row vectors (lanes x k x labels) after step t."""
        moved = vectors @ trans
        keep = ~real[:, t] if t else ~real[:, t] | opens
        if keep.any():
            moved[keep] = vectors[keep]
        return moved * steps[:, t, None, :]

    product = np.broadcast_to(np.eye(n_labels), (lanes, n_labels, n_labels)).copy()
    for t in range(block):
        product = through(product, t)
        product /= product.max(axis=(1, 2), keepdims=True)
    # over the blocks of each sequence; longer sequences first, so that a slice is active
    order = np.argsort(-per, kind="stable")
    at, counts = first[order], per[order]
    ahead, behind = np.empty((lanes, n_labels)), np.empty((lanes, n_labels))
    vector = np.broadcast_to(np.exp(start), (len(at), n_labels)).copy()
    for k in range(int(counts[0])):
        live = int(np.searchsorted(-counts, -k, side="left"))
        rows = at[:live] + k
        vector = vector[:live]
        ahead[rows] = vector
        vector = np.einsum("ni,nij->nj", vector, product[rows])
        vector /= vector.sum(axis=1, keepdims=True)
    vector = np.ones((len(at), n_labels))
    for k in range(int(counts[0]) - 1, -1, -1):
        live = int(np.searchsorted(-counts, -k, side="left"))
        rows = at[:live] + k
        behind[rows] = vector[:live]
        moved = np.einsum("nij,nj->ni", product[rows], vector[:live])
        vector[:live] = moved / moved.sum(axis=1, keepdims=True)
    # within the blocks
    alpha = np.empty((lanes, block, n_labels))
    before = np.empty((lanes, block, n_labels))
    here = ahead / ahead.sum(axis=1, keepdims=True)
    total += float(np.log(np.exp(start).sum())) * len(at)
    for t in range(block):
        before[:, t] = here
        here = through(here[:, None, :], t)[:, 0]
        norm = here.sum(axis=1, keepdims=True)
        total += float(np.log(norm[real[:, t]]).sum())
        here /= norm
        alpha[:, t] = here
    expected = np.zeros((n_labels, n_labels))
    marginal = np.empty((lanes, block, n_labels))
    here = behind
    for t in range(block - 1, -1, -1):
        both = alpha[:, t] * here
        marginal[:, t] = both / both.sum(axis=1, keepdims=True)
        fed = here * steps[:, t]
        back = fed @ trans.T
        moves_here = real[:, t] & ~opens if not t else real[:, t]
        pair = before[moves_here, t][:, :, None] * trans * fed[moves_here][:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(pair) else 0
        still = ~real[:, t] | opens if not t else ~real[:, t]
        back[still] = fed[still]
        here = back / back.sum(axis=1, keepdims=True)
    return marginal.reshape(-1, n_labels)[spot], expected, total + float(high.sum())


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a whole text that have a letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if all(map(str.isalpha, words)) else [w for w in words if any(map(str.isalpha, w))]


def learn(texts: list[str], labels: list[str], fit: Fit = Fit()) -> Field | None:
    """Fit the field on labelled texts; None where no text has a word."""
    draw = np.random.default_rng(fit.seed)
    runs: dict[str, list[list[str]]] = {}
    for text, label in zip(texts, labels):
        words = words_of(text)
        runs.setdefault(label, []).extend(words[i:i + fit.run] for i in range(0, len(words), fit.run))
    languages = sorted(label for label, own in runs.items() if own)
    if not languages:
        return None
    chosen = []
    for k, label in enumerate(languages):
        own = runs[label]
        chosen += [(k, own[i]) for i in draw.permutation(len(own))[:fit.runs_per_language]]
    chosen = [chosen[i] for i in draw.permutation(len(chosen))]
    gold = np.concatenate([np.full(len(words), k) for k, words in chosen])
    lengths = np.array([sum(len(w) for _, w in chosen[i:i + fit.chain]) for i in range(0, len(chosen), fit.chain)])
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for _, words in chosen for w in words])
    vocabulary = list(index)
    uses = Counter(ids.tolist())
    lexicon = {w: j for j, w in enumerate(w for w, i in index.items() if uses[i] >= fit.lexicon_count)}
    where, which = hashed_features(vocabulary, fit.buckets)
    sizes = np.diff(np.append(which, len(where)))
    scale = np.repeat(1 / np.sqrt(sizes), sizes)
    known = np.fromiter((lexicon.get(w, -1) for w in vocabulary), dtype=np.int64, count=len(vocabulary))
    n = len(languages)
    model = Field(languages, np.zeros((fit.buckets, n)), lexicon, np.zeros((len(lexicon) + 1, n)), np.zeros(n), np.zeros((n, n)), np.zeros(n))
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(gold), dtype=bool)
    inner[starts] = False
    seen_moves = np.zeros((n, n))
    np.add.at(seen_moves, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    seen_words = np.bincount(ids * n + gold, minlength=len(vocabulary) * n).reshape(-1, n).astype(float)
    seen_start = np.bincount(gold[starts], minlength=n).astype(float)
    size = [np.zeros_like(x) for x in (model.hashed, model.known, model.bias, model.moves, model.start)]
    for _ in range(fit.rounds):
        scores = model.emissions(vocabulary)[ids]
        marginal, expected, _ = forward_backward(scores, lengths, model.moves, model.start)
        word_sums = np.stack([np.bincount(ids, marginal[:, k], len(vocabulary)) for k in range(n)], axis=1)
        word_gap = seen_words - word_sums
        spread = np.repeat(word_gap, sizes, axis=0) * scale[:, None]
        hashed = np.stack([np.bincount(where, spread[:, k], fit.buckets) for k in range(n)], axis=1)
        lexical = np.stack([np.bincount(known[known >= 0], word_gap[known >= 0, k], len(lexicon) + 1) for k in range(n)], axis=1)
        gaps = (hashed, lexical, word_gap.sum(axis=0), seen_moves - expected, seen_start - marginal[starts].sum(axis=0))
        for value, gap, past in zip((model.hashed, model.known, model.bias, model.moves, model.start), gaps, size):
            gap = gap / len(gold) - fit.decay * value
            past += gap * gap
            value += fit.rate * gap / (np.sqrt(past) + 1e-8)
    model.known[-1] = 0
    model.hashed, model.known = model.hashed.astype(np.float32), model.known.astype(np.float32)
    return model


def label_words(model: Field, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of all words of the texts one after the other, number of words of each)."""
    index: dict[str, int] = {}
    number = index.setdefault
    ids = np.array([number(w, len(index)) for words in texts for w in words], dtype=np.int64)
    lengths = np.array([len(words) for words in texts], dtype=np.int64)
    scores = model.emissions(list(index)).astype(np.float64)[ids]
    return forward_backward(scores, lengths, model.moves, model.start)[0], lengths


def learn_from(docs: DataFrame, learnable, text: str = "text", lang: str = "lang", key: str = "doc_id", fit: Fit = Fit()) -> Field | None:
    """Fit on a bounded sample of the labelled rows for which ``learnable`` holds.

    Of each language the rows first in a hashed order of their ids are taken; a rate from the counts
    of all rows keeps the candidates few before they meet, and each task hands on its own first ones.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, text).alias("rank"), learnable.alias("open"))
    rows = rows.where("open and lang is not null and text is not null").where(F.length("text") <= fit.sample_chars)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(fit.max_languages + 1).collect()}
    if len(counts) > fit.max_languages:
        raise ValueError(f"more than {fit.max_languages} labels: raise Fit.max_languages if they are languages")
    if not counts:
        return None
    share = F.expr("shiftrightunsigned(rank, 11)") / float(1 << 53)
    rate = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 4.0 * fit.docs_per_language / n))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))
    sample = rows.where(share <= rate[F.col("lang")]).withColumn("place", place).where(F.col("place") <= fit.docs_per_language)
    taken = sorted(map(tuple, sample.select("lang", "rank", "text").collect()))
    return learn([t for _, _, t in taken], [label for label, _, _ in taken], fit)


def predict(docs: DataFrame, model: Field | None, text: str = "text", out: str = "_lang", batch_chars: int = 1 << 18, batch_cells: int = 1 << 20) -> DataFrame:
    """``docs`` with a struct ``out``: language, score, words, and the runs of labelled words.

    Texts that are null or have no letter are ``und`` with score 0; so is everything where nothing
    could be learned. ``switches`` counts the places where the likeliest language changes. Texts are
    labelled together as long as they hold ``batch_chars`` characters at most, and their blocks of
    words ``batch_cells`` step weights (words of a block x languages, and languages squared).
    """
    n_labels = len(model.languages) if model else 1
    block_cells = BLOCK * n_labels + n_labels * n_labels

    @F.pandas_udf("struct<lang:string,score:double,words:long,switches:long>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            held: list[list[str]] = []
            size = cells = 0

            def flush() -> None:
                nonlocal size, cells
                marginal, lengths = label_words(model, held)
                ends = np.cumsum(lengths)
                best = marginal.argmax(axis=1)
                change = np.concatenate(([0], np.cumsum(best[1:] != best[:-1]))) if len(best) else best
                sums = np.concatenate((np.zeros((1, marginal.shape[1])), np.cumsum(marginal, axis=0)))
                for end, n in zip(ends.tolist(), lengths.tolist()):
                    if not n:
                        rows.append((UNDECIDED, 0.0, 0, 0))
                        continue
                    mean = (sums[end] - sums[end - n]) / n
                    k = int(mean.argmax())
                    score = float(min(1.0, max(0.0, mean[k])))
                    rows.append((model.languages[k], score, n, int(change[end - 1] - change[end - n])))
                held.clear()
                size = cells = 0

            for one in batch:
                if model is None:
                    rows.append((UNDECIDED, 0.0, 0, 0))
                    continue
                one = one if isinstance(one, str) else ""
                found = words_of(one)
                if held and (size + len(one) > batch_chars or cells + -(-len(found) // BLOCK) * block_cells > batch_cells):
                    flush()
                held.append(found)
                size += len(one)
                cells += -(-len(found) // BLOCK) * block_cells
            if held:
                flush()
            yield pd.DataFrame(rows, columns=["lang", "score", "words", "switches"])

    return short_batches(docs).withColumn(out, label(F.col(text)))


def held_out(key: str = "doc_id"):
    """A third of the documents, by the checksum of the id as text, is never learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit: Fit = Fit()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, words, switches), learned from the rows not held out.

    Predictions read the text alone. Rows with a null id are neither held out nor learned from;
    repeated rows come back as often as they occur; an empty table gives an empty one.
    """
    model = learn_from(docs, ~held_out(doc_id), text, lang, doc_id, fit)
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    return predict(rows, model, "_text").select(
        F.col("_doc").alias(doc_id), F.coalesce(held_out("_doc"), F.lit(False)).alias("held_out"),
        F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"), F.col("_lang.words").alias("words"),
        F.col("_lang.switches").alias("switches"))


def keep_identified(docs: DataFrame, least_score: float = 0.4, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit: Fit = Fit()) -> DataFrame:
    """The rows of ``docs`` whose text has a language that holds at least ``least_score`` of it."""
    if "_lang" in docs.columns:
        raise ValueError("rename the column _lang first")
    model = learn_from(docs, ~held_out(doc_id), text, lang, doc_id, fit)
    marked = predict(docs, model, text)
    return marked.where((F.col("_lang.lang") != UNDECIDED) & (F.col("_lang.score") >= least_score)).select(docs.columns)
