"""Language identification by a byte convolutional network.

Bytes are embedded, filters of widths 2, 3 and 4 slide over fixed-length windows, each filter is max-pooled
over the window, and a softmax layer gives the languages. Trained by Adam in numpy on the driver from a
bounded sample of windows. A text is scored by all of its windows: their log-probabilities, weighted by the
bytes they hold, are averaged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import carried, materialize, pick, place
from millrace.llm.labelled import held_out, sample_by_label

WINDOW = 192
DIM, WIDTHS, EACH = 8, (2, 3, 4), 16
_WIDE = max(WIDTHS)
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # 256 x DIM, byte 0 pads
    filters: np.ndarray  # (_WIDE * DIM) x filters; narrow filters are zero beyond their width
    filter_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, one after another; the last is padded with zeros."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


def _columns(model: Model, x: np.ndarray) -> np.ndarray:
    """The filters' inputs: (windows, places, _WIDE * DIM); the window is padded on its right."""
    padded = np.zeros((len(x), x.shape[1] + _WIDE - 1), np.uint8)
    padded[:, : x.shape[1]] = x
    e = model.embed[padded]
    s0, s1, s2 = e.strides
    return np.lib.stride_tricks.as_strided(e, (len(x), x.shape[1], _WIDE * DIM), (s0, s1, s2))


def _pooled(model: Model, x: np.ndarray) -> np.ndarray:
    cols = _columns(model, x).reshape(-1, _WIDE * DIM)
    return (cols @ model.filters).reshape(len(x), x.shape[1], -1).max(axis=1) + model.filter_bias


def log_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    z = np.maximum(_pooled(model, x), 0) @ model.out + model.out_bias
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the mean loss (the negative log-probability of the language y of each window), by embedding, filters, their
    bias, output weights and output bias. Byte 0 pads and stays at 0."""
    cols = _columns(model, x)
    conv = (cols.reshape(-1, _WIDE * DIM) @ model.filters).reshape(len(x), x.shape[1], -1)
    best = conv.argmax(axis=1)
    pooled = np.take_along_axis(conv, best[:, None, :], axis=1)[:, 0, :] + model.filter_bias
    hidden = np.maximum(pooled, 0)
    z = hidden @ model.out + model.out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(x)), y] -= 1
    z /= len(x)
    g_hidden = (z @ model.out.T) * (pooled > 0)
    won = cols[np.arange(len(x))[:, None], best]  # windows x filters x inputs
    g_filters = np.einsum("bfi,bf->if", won, g_hidden)
    g_inputs = (g_hidden[:, :, None] * model.filters.T[None]).reshape(-1, _WIDE, DIM)
    places = best[:, :, None] + np.arange(_WIDE)
    padded = np.zeros((len(x), x.shape[1] + _WIDE - 1), np.uint8)
    padded[:, : x.shape[1]] = x
    at = padded[np.arange(len(x))[:, None, None], places].reshape(-1)
    g_embed = np.stack([np.bincount(at, g_inputs.reshape(-1, DIM)[:, d], 256) for d in range(DIM)], axis=1)
    g_embed[0] = 0
    return g_embed, g_filters, g_hidden.sum(0), hidden.T @ z, z.sum(0)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, least_steps: int = 400, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Model:
    """At least epochs passes, and as many more as give least_steps steps."""
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * EACH
    epochs = max(epochs, -(-least_steps // -(-len(x) // batch)))
    mask = np.zeros((_WIDE * DIM, n), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * DIM, k * EACH : (k + 1) * EACH] = 1
    p = [rng.normal(0, 0.5, (256, DIM)), rng.normal(0, 0.25, mask.shape) * mask, np.zeros(n), rng.normal(0, 0.2, (n, len(languages))), np.zeros(len(languages))]
    p = [a.astype(np.float32) for a in p]
    p[0][0] = 0
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            step += 1
            for i, g in enumerate(gradients(Model(languages, *p), x[pick], y[pick])):
                if i == 1:
                    g = g * mask
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = (p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return Model(languages, *p)


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each text with the text's chance `keep`, the same ones every time."""
    for batch in batches:
        for text, lang, keep in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode("utf-8", "surrogatepass")
            own = windows(data)
            own = own[np.random.default_rng(zlib.crc32(data)).random(len(own)) < keep]
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in own], pa.binary()), pa.array([lang] * len(own), pa.string())], names=["window", "lang"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, most: int = 12_000, most_windows: int = 80_000) -> Model | None:
    """Train on at most `most` documents that are not held out and have a language and a letter; None where there are none.

    Of all windows of these texts about most_windows at most are drawn, each with the same chance within a language; where
    there are fewer, all are learned from. Rows that repeat an id count as one, with the smallest of their texts.
    """
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    ids = sample_by_label(rows.select("id", "lang"), "lang", "id", per_language, most)
    chosen = rows.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("row"))
    chosen = materialize(chosen.select("row.text", "row.lang").where(F.col("text").rlike(r"\p{L}")), "language-sample")
    each = chosen.groupBy("lang").agg(F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WINDOW))).alias("windows"))
    each = each.select("lang", F.least(F.lit(1.0), most_windows / F.count("*").over(Window.partitionBy()) / F.col("windows")).alias("keep"))
    got = chosen.join(F.broadcast(each), "lang").select("text", "lang", "keep").mapInArrow(_sample_windows, "window binary, lang string").toArrow()
    pairs = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
    languages = sorted({lang for _, lang in pairs})
    if not languages:
        return None
    x = np.frombuffer(b"".join(w for w, _ in pairs), np.uint8).reshape(-1, WINDOW)
    passes = max(2, min(6, 110_000 // len(x)))
    return train(x, np.searchsorted(np.array(languages), [lang for _, lang in pairs]), languages, epochs=passes)


def _predictor(model: Model | None, text_at: int, at_once: int = 256):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(0).field(text_at)  # within the row, so that no text travels twice
            owners: list[int] = []
            waiting: list[np.ndarray] = []
            total = np.zeros((batch.num_rows, len(model.languages) if model else 0))
            weight = np.zeros(batch.num_rows)

            def flush(x: np.ndarray, who: np.ndarray) -> None:
                filled = (x != 0).sum(axis=1)
                np.add.at(total, who, log_probabilities(model, x) * filled[:, None])
                np.add.at(weight, who, filled)

            held = 0
            for k in range(batch.num_rows if model else 0):
                text = texts[k].as_py()
                if text is None or not _LETTER.search(text):
                    continue
                own = windows(text.encode("utf-8", "surrogatepass"))
                waiting.append(own)
                owners += [k] * len(own)
                held += len(own)
                if held >= at_once:
                    x, who = np.concatenate(waiting), np.array(owners)
                    for a in range(0, held, at_once):
                        flush(x[a : a + at_once], who[a : a + at_once])
                    waiting, owners, held = [], [], 0
            if held:
                flush(np.concatenate(waiting), np.array(owners))
            for k in np.flatnonzero(weight):
                mean = np.exp(total[k] / weight[k])
                langs[k], scores[k] = model.languages[int(mean.argmax())], mean.max() / mean.sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.round(scores, 6))], names=["row", "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1). A null text and one without a letter give `und` and 0, and so
    does everything where there was nothing to learn from. Columns of these names that docs has are replaced; others
    may have any name."""
    rows, _, back = carried(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return back(rows.mapInArrow(_predictor(model, place(docs.columns, text_col)), schema), None, "lang_pred", "score")
