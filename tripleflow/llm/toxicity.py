"""Toxic documents by multiple-instance learning, with the sentences that make them so.

A sentence has a logistic score of its words; a document is toxic if any of its sentences
is, so their probabilities are combined by noisy-or.  Only documents carry labels; the
likelihood of the combined score trains the words' weights, and the sentences' own scores
then locate what is offending.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import exp, log1p
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleflow.llm.common import id_and_text, written

SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")
THRESHOLD = 0.7
OFFENDING = 0.5
# Bounds of training, whatever the size of the corpus: labelled documents taken of each
# label (those with the smallest hash of their id), and words that get a weight.
DOCS_PER_LABEL = 6_000
FEATURES = 300
MIN_DOCS = 3  # a feature of fewer labelled documents gets no weight
STEPS = 400
DECAY = 1e-4  # pull of the weights towards zero
STEM = 5  # characters of a longer word's beginning, a feature of its own


def features(text: str) -> list[str]:
    """Each distinct word of a lower-cased text, and the beginning of each longer one."""
    words = set(TOKEN.findall(text))
    return [*words, *(w[:STEM] + "*" for w in words if len(w) > STEM)]


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float

    def sentence(self, text: str) -> float:
        """The logit of one lower-cased sentence; a word counts once."""
        known = self.weights.get
        words = set(TOKEN.findall(text))
        z = self.bias
        for w in words:
            z += known(w, 0.0)
            if len(w) > STEM:
                z += known(w[:STEM] + "*", 0.0)
        return z

    def document(self, text: str) -> float:
        """1 - product of (1 - p) over the sentences; 0 for a text without any."""
        total = 0.0
        for s in SENTENCE.findall(text.lower()):
            z = self.sentence(s)
            total += log1p(exp(z)) if z < 30 else z
        return -np.expm1(-total)

    def offending(self, text: str) -> list[tuple[int, int, float]]:
        """``(begin, end, probability)`` in characters of sentences over one half."""
        out = []
        for m in SENTENCE.finditer(text):
            z = self.sentence(m[0].lower())
            if z > 0:
                out.append((m.start(), m.end(), 1 / (1 + exp(-z))))
        return out


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of at most ``DOCS_PER_LABEL`` documents of each label, none held out."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~_held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    some = [
        marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCS_PER_LABEL)
        for t in (0, 1)
    ]
    # at most two rows per document of the bound, so the broadcast is bounded too
    return id_and_text(docs).join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("text", "toxic")


def _instances(sample: DataFrame, words: dict[str, int]) -> DataFrame:
    """``toxic, sentences``: numbers of known features of each sentence; -1 ends a sentence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                row: list[int] = []
                for s in SENTENCE.findall(text.lower()):
                    row += sorted(words[f] for f in features(s) if f in words)
                    row.append(-1)
                out.append(row)
            yield pa.record_batch([batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["toxic", "sentences"])

    return sample.select("text", "toxic").mapInArrow(cut, "toxic int, sentences array<int>")


def _vocabulary(sample: DataFrame) -> list[str]:
    """The features that tell the labels apart best, by their documents of each label."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = list(set(features(text.lower())))
                for k in range(0, len(words), 10_000):
                    some = words[k : k + 10_000]
                    yield pa.record_batch([pa.array(some, pa.string()), pa.array([toxic] * len(some), pa.int32())], ["word", "toxic"])

    of_label = [F.count_if(F.col("toxic") == t).alias(n) for t, n in ((0, "clean"), (1, "bad"))]
    totals = sample.agg(*of_label)
    counted = sample.mapInArrow(distinct, "word string, toxic int").groupBy("word").agg(*of_label)
    n = totals.first()
    share = F.expr(f"bad / {max(1, n['bad'])}D") - F.expr(f"clean / {max(1, n['clean'])}D")
    spread = F.sqrt((F.col("bad") + F.col("clean") + 1) / float(max(1, n["bad"] + n["clean"])))
    best = counted.where(F.col("bad") + F.col("clean") >= MIN_DOCS).orderBy((-F.abs(share) / spread), "word")
    return [r["word"] for r in best.limit(FEATURES).select("word").collect()]


def fit(labels: np.ndarray, rows: list[np.ndarray], n_words: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps on the noisy-or likelihood, labels weighing alike."""
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    doc_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ends = flat < 0
    sentence = np.cumsum(ends) - ends
    sentence_doc = doc_of[ends]
    word, at = flat[~ends], sentence[~ends]
    n = len(sentence_doc)
    if not n or labels.min() == labels.max():
        return np.zeros(n_words), -20.0
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    w = np.zeros(n_words + 1)
    w[-1] = -5.0
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(at, w[word], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.bincount(sentence_doc, np.logaddexp(0, z), len(rows))
        # derivative of the negative log likelihood by the sum of a document's softplus terms
        by_total = np.where(labels == 1, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0) * weight
        by_z = by_total[sentence_doc] * p
        gradient = np.append(np.bincount(word, by_z[at], n_words), by_z.sum()) + DECAY * np.append(w[:-1], 0)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out."""
    sample = written(labelled_sample(docs, labels), "labelled")
    words = _vocabulary(sample)
    rows = _instances(sample, {w: k for k, w in enumerate(words)}).toPandas()
    rows = rows.assign(key=[tuple(s) for s in rows.sentences]).sort_values(["toxic", "key"])  # one order of sums
    weights, bias = fit(rows.toxic.to_numpy(np.int64), list(rows.sentences), len(words))
    return Model({w: float(x) for w, x in zip(words, weights, strict=True) if abs(x) > 1e-3}, bias)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending``: one row per row.

    ``offending`` are the sentences over one half of documents that are predicted toxic.  A
    null or empty text has no sentence and scores 0; ``held_out`` of a null id is false.
    """
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                texts = some.column(1).to_pylist()
                scores = [model.document(t) for t in texts]
                found = [
                    [dict(zip(("begin", "end", "probability"), x, strict=True)) for x in model.offending(t)]
                    if s >= threshold else []
                    for t, s in zip(texts, scores, strict=True)
                ]
                yield pa.record_batch(
                    [some.column(0), pa.array(scores, pa.float64()), pa.array(found, spans)], ["doc_id", "score", "offending"]
                )

    scored = id_and_text(docs).mapInArrow(
        score, "doc_id long, score double, offending array<struct<begin:long,end:long,probability:double>>"
    )
    return scored.select(
        "doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "offending",
    )


def score_of(model: Model) -> Callable[[Column], Column]:
    """The document score as a column function, for filters that keep all other columns."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.document(t or "") for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train and score; without labels of both kinds every score is close to 0."""
    return score_documents(docs, train(docs, labels))
