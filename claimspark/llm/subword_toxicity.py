"""Toxicity score from subword-bag embeddings.

A word is the bag of its character 3- to 5-grams (with word borders) and of
the whole word, hashed to ``buckets``; its vector is the mean of their
vectors.  A text is the mean of its word vectors and of ``PAD_WORDS`` zero
vectors, so that one odd word of a short text does not decide alone, followed
by a linear softmax over the two classes.  Vectors and softmax are trained jointly in
numpy (Adam on minibatches), so an unseen misspelling shares the vectors of
the n-grams it keeps.

Training data are bounded: at most ``max_pos`` toxic and ``max_neg`` other
labelled documents of at most ``max_chars`` characters, drawn by a hash of
the id at a rate set by the label counts.  Classes drawn at different rates
are weighted back to their share, and toxic documents then count
``TOXIC_WEIGHT`` times.  Only documents
whose CRC-32 of the id modulo 5 is not 0 are learnt from; label, language,
source and id are never inputs of the score.  Scoring reads every whole
text: the model is linear after the means, so it is broadcast as one number
per bucket (fixed size) and a word's score is the mean of its numbers.

Edge cases: null and empty texts, and texts without a word, get the score
of the bias alone; a null id counts as '' (held out); null labels are
not learnt from; with no label at all, or only one class, every score is the
share of toxic labels (0 without labels); repeated documents get a row each;
repeated labels count as often as they occur; an empty table gives an empty
result; other columns are ignored by the score and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import fit_in_task

WORD = re.compile(r"[^\W_]+")
FOLDS = 5
PAD_WORDS, TOXIC_WEIGHT = 30, 2.0


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id's text modulo the number of folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def text_words(text: str | None) -> list[str]:
    """Lower-case words; a word repeated on the spot counts once."""
    words = WORD.findall(text.lower()) if text else []
    return [w for w, before in zip(words, [None, *words]) if w != before]


def subwords(words: list[str], buckets: int, sizes=(3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) pairs of the words' n-grams and whole words.
    All words are laid out as one array of code points with border marks;
    an n-gram is kept where its first and last character are of one word."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    prime = np.uint64(0x9E3779B97F4A7C15)

    def bucket(h: np.ndarray, salt: int) -> np.ndarray:
        h = (h + np.uint64(salt)) * prime
        return ((h ^ (h >> np.uint64(29))) * prime >> np.uint64(32)).astype(np.int64) % buckets

    at, of = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(1_000_003) + codes[i:len(codes) - n + 1 + i]
        inside = owner[:len(h)] == owner[n - 1:]
        at.append(owner[:len(h)][inside])
        of.append(bucket(h[inside], n))
    if len(words):
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        mixed = codes * (prime * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        whole = np.add.reduceat(mixed, np.cumsum(lengths) - lengths)
        at.append(np.arange(len(words)))
        of.append(bucket(whole, 99))
    none = np.empty(0, np.int64)
    return (np.concatenate(at), np.concatenate(of)) if at else (none, none)


class _Bag:
    """A set of texts as sparse counts: texts over distinct words, words
    over buckets."""

    def __init__(self, texts: list[list[str]], buckets: int):
        index: dict[str, int] = {}
        ids = [np.fromiter((index.setdefault(w, len(index)) for w in t), np.int64, len(t)) for t in texts]
        self.n, self.lengths = len(texts), np.array([len(i) for i in ids], np.int64)
        self.word = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        self.text = np.repeat(np.arange(self.n, dtype=np.int32), self.lengths)
        self.n_words = len(index)
        self.at, self.of = (a.astype(np.int32) for a in subwords(list(index), buckets))
        self.per_word = 1.0 / np.maximum(np.bincount(self.at, minlength=self.n_words), 1)
        self.per_text = 1.0 / (self.lengths + PAD_WORDS)

    def means(self, value: np.ndarray) -> np.ndarray:
        """Per text the padded mean over words of the mean over subwords."""
        words = np.bincount(self.at, value[self.of], self.n_words) * self.per_word
        return np.bincount(self.text, words[self.word], self.n) * self.per_text

    def spread(self, grad: np.ndarray, buckets: int) -> np.ndarray:
        """Transpose of ``means``."""
        words = np.bincount(self.word, (grad * self.per_text)[self.text], self.n_words) * self.per_word
        return np.bincount(self.of, words[self.at], buckets)


@dataclass
class Model:
    weight: np.ndarray  # per bucket: its vector times the difference of the class weights
    bias: float

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        z = _Bag(texts, len(self.weight)).means(self.weight) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, buckets: int = 1 << 16, dim: int = 4,
          epochs: int = 14, batch: int = 64, least_steps: int = 1200, rate: float = 0.1, decay: float = 0.01,
          eps: float = 5e-5, seed: int = 7) -> Model:
    """Joint training of bucket vectors and the linear softmax.  ``eps``
    keeps n-grams of few texts from moving as far as frequent ones; few texts
    are gone over more often, until ``least_steps`` steps are made."""
    share = float((labels * weights).sum() / max(weights.sum(), 1e-9))
    if not 0 < share < 1:
        return Model(np.zeros(buckets), 60.0 if share >= 1 else -60.0)
    rng = np.random.default_rng(seed)
    vectors = np.zeros((dim, buckets))  # a bucket never seen adds nothing to a score
    softmax = rng.normal(0, 1.0, (2, dim))
    bias = np.array([0.0, np.log(share / (1 - share))])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    order = np.arange(len(texts))
    rng.shuffle(order)  # batches are fixed, their order changes
    cuts = [order[i:i + batch] for i in range(0, len(order), batch)]
    bags = [_Bag([text_words(texts[i]) for i in rows], buckets) for rows in cuts]
    step = 0
    for _ in range(max(epochs, -(-least_steps // len(cuts)))):
        for b in rng.permutation(len(cuts)):
            rows, bag = cuts[b], bags[b]
            hidden = np.stack([bag.means(vectors[d]) for d in range(dim)], axis=1)
            z = hidden @ softmax.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - np.eye(2)[labels[rows]]) * (weights[rows] / weights[rows].mean() / len(rows))[:, None]
            back = g @ softmax
            grads = (np.stack([bag.spread(back[:, d], buckets) for d in range(dim)]),
                     g.T @ hidden, g.sum(axis=0))
            step += 1
            for param, grad, (m, v) in zip((vectors, softmax, bias), grads, moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= rate * ((m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + eps) + decay * param)
    difference = softmax[1] - softmax[0]
    return Model(difference @ vectors, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, max_pos: int = 1700, max_neg: int = 5000,
        max_chars: int = 20_000) -> Model:
    """Train on the bounded sample, in one task."""
    usable = labels.where("toxic in (0, 1)").where(fold(F.col("doc_id")) != 0).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    rates = {c: min(1.0, most / max(counts.get(c, 0), 1)) for c, most in ((1, max_pos), (0, max_neg))}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    parts = [usable.where((F.col("toxic") == c) & (draw < rates[c])).limit(2 * most)
             for c, most in ((1, max_pos), (0, max_neg))]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * (max_pos + max_neg) ids
    rows = (docs.select("doc_id", "text").where((F.length("text") <= max_chars) & (F.length("text") > 0))
            .join(sample, "doc_id").limit(4 * (max_pos + max_neg)))
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    constant = np.array([0.0, np.log(share / (1 - share)) if 0 < share < 1 else 60.0 if share else -60.0])

    def learn(pdf: pd.DataFrame) -> np.ndarray:
        pdf = pdf.sort_values(["doc_id", "toxic"])
        y = pdf["toxic"].to_numpy().astype(np.int64)
        drawn = np.bincount(y, minlength=2)
        if not drawn.all():
            return constant
        weights = np.array([counts[0] / drawn[0], TOXIC_WEIGHT * counts[1] / drawn[1]])[y]
        model = train(pdf["text"].tolist(), y, weights)
        return np.append(model.weight, model.bias)

    learnt = fit_in_task(rows, learn)
    learnt = constant if learnt is None else learnt
    return Model(learnt[:-1], float(learnt[-1]))


def score_column(docs: DataFrame, model: Model, text: str = "text", chunk_chars: int = 1 << 20) -> Column:
    """The score of each whole text, in bounded chunks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, held, chars = [], [], 0
            for t in texts:
                held.append(text_words(t))
                chars += len(t or "")
                if chars > chunk_chars:
                    out.append(shared.value.scores(held))
                    held, chars = [], 0
            out.append(shared.value.scores(held))
            yield pd.Series(np.concatenate(out))

    return scored(F.col(text))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    score = score_column(docs, fit(docs, labels))
    return docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with their columns."""
    return docs.where(score_column(docs, fit(docs, labels)) < threshold)
