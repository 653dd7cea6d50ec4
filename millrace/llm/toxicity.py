"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a score p = sigmoid(bias + sum of its words' weights); the
document's score is their noisy-or, 1 - prod(1 - p). Only documents are labelled; the gradient of the noisy-or
tells which sentences explain a label, so the trained scorer also says where the offence stands. A word's
weight is the sum of weights of its hashed features (the word and its first 4, 5 and 6 letters), learned with
Adam in numpy on the driver from a bounded sample.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import carried, pick, place
from millrace.llm.labelled import held_out, sample_by_label

THRESHOLD = 0.3
FEATURES = 1 << 18
_PREFIXES = (4, 5, 6)
_MEMO_ENTRIES, _ROWS = 200_000, 256
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    keys = [word.encode("utf-8", "surrogatepass")] + [b"^%d" % n + word[:n].encode("utf-8", "surrogatepass") for n in _PREFIXES if len(word) >= n]
    return [zlib.crc32(k) % FEATURES for k in keys]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def words(self) -> "_WordWeights":
        return _WordWeights(self.weights)


class _WordWeights(dict):
    """Weights of words that have been met; emptied when full."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.of = weights

    def __missing__(self, word: str) -> float:
        if len(self) > _MEMO_ENTRIES:
            self.clear()
        w = self[word] = float(self.of[word_features(word)].sum())
        return w


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def train(texts: list[str], labels: np.ndarray, epochs: int = 150, rate: float = 0.2, sparsity: float = 0.03) -> Model:
    """Fit the scorer by proximal Adam on whole bags.

    The L1 penalty is worth sparsity x sqrt(documents) documents, as chance agreement grows with the root of
    the sample: a feature that would explain fewer stays at zero.
    """
    ids: dict[str, int] = {}
    words = array("i")
    sentence_ends, doc_of = array("q"), array("i")
    for k, text in enumerate(texts):
        for sentence in _SENTENCE.findall(text.lower()):
            found = _WORD.findall(sentence)
            if found:
                words.extend([ids.setdefault(w, len(ids)) for w in found])
                sentence_ends.append(len(words))
                doc_of.append(k)
    if not words or labels.min(initial=1) == labels.max(initial=0):
        rate_of = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(FEATURES, np.float32), float(np.log(max(rate_of, 1e-9) / max(1 - rate_of, 1e-9))))
    feats = [word_features(w) for w in ids]
    feat_at = np.concatenate([[0], np.cumsum([len(f) for f in feats])])[:-1]
    feat = np.array([x for f in feats for x in f], np.int64)
    feat_word = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    used, feat = np.unique(feat, return_inverse=True)
    words_a = np.array(words, np.int32)
    starts = np.concatenate([[0], sentence_ends[:-1]]).astype(np.int64)
    sentence_of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(words)]])))
    doc_of_a = np.array(doc_of)
    y = labels.astype(np.float64)
    w, bias = np.zeros(len(used)), -7.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    penalty = sparsity / np.sqrt(len(texts))
    for step in range(1, epochs + 1):
        word_w = np.add.reduceat(w[feat], feat_at)
        s = np.add.reduceat(word_w[words_a], starts) + bias
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        clean = np.bincount(doc_of_a, _softplus(s), len(texts))  # -log of the chance that no sentence offends
        any_ = -np.expm1(-clean)
        factor = np.where(y > 0, -np.exp(-clean) / np.maximum(any_, 1e-6), 1.0)
        gs = p * factor[doc_of_a] / len(texts)
        gw_word = np.bincount(words_a, gs[sentence_of], len(feats))
        g = np.bincount(feat, gw_word[feat_word], len(used))
        gb = gs.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        pace = rate / (np.sqrt(v / c2) + 1e-8)
        w -= pace * (m / c1)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(pace * penalty, 1e6), 0)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 3000, most: int = 6000) -> Model:
    """Train on the whole texts of at most `most` labelled rows that are not held out.

    A document with several labels counts as toxic if one of them says so; null labels and null texts are left out. The
    sample is bounded by its parameters, so its ids may be broadcast.
    """
    known = pick(labels, id=id_col, label=label_col).where(F.col("label").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").cast("int").alias("label"))
    chosen = sample_by_label(known, "label", "id", per_label, most)
    texts = pick(docs, id=id_col, text=text_col).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("id").toArrow()
    return train(rows.column("text").to_pylist(), np.array(rows.column("label").to_pylist(), np.int64))


def score_sentences(text: str, words: dict, bias: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Places and logits of the sentences that have words."""
    # a few letters change length in lower case; then places are those in the lowered text
    low, spans, logits = text.lower(), [], []
    for found in _SENTENCE.finditer(low):
        own = _WORD.findall(found[0])
        if own:
            spans.append(found.span())
            logits.append(sum(map(words.__getitem__, own)))
    return spans, np.array(logits) + bias


_DDL = "score double, offending array<struct<start:int,end:int,score:double>>"
_OFFENDING = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _scorer(model: Model, text_at: int, threshold: float):
    cut = np.log(threshold / (1 - threshold))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.words()
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            scores, places = [], []
            texts = batch.column(0).field(text_at)  # within the row, so that no text travels twice
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                spans, s = score_sentences(text, words, model.bias)
                scores.append(float(-np.expm1(-_softplus(s).sum())) if len(s) else 0.0)
                hits = np.flatnonzero(s >= cut) if len(s) else ()
                places.append([{"start": spans[i][0], "end": spans[i][1], "score": float(1 / (1 + np.exp(-s[i])))} for i in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(places, _OFFENDING)], names=["row", "score", "offending"])

    return score


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with two more columns, score and offending: the sentences that reach the threshold by themselves.

    A null or empty text and one without a word score 0. Each row is scored by its whole text alone, so equal
    texts have equal scores. Columns of these names that docs has are replaced; others may have any name.
    """
    rows, _, back = carried(docs)
    return back(_scored(rows, model, place(docs.columns, text_col), threshold), None, "score", "offending")


def _scored(rows: DataFrame, model: Model, text_at: int, threshold: float) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(_DDL).fields])
    return rows.mapInArrow(_scorer(model, text_at, threshold), schema)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score `threshold` or more, with all their columns."""
    rows, _, back = carried(docs)
    return back(_scored(rows, model, place(docs.columns, text_col), threshold).where(F.col("score") < threshold))
