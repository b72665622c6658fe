"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes, all of them, and windows go through the network in
batches: byte embedding, filters of widths 2, 3 and 4, rectifier, maximum over positions, softmax.
Trained here in numpy on windows of at most ``SAMPLE`` labelled documents outside the held-out fold.

For scoring, the filters are tabulated by pairs of bytes: a width-2 filter is one look-up, widths 3
and 4 are two, with the same sums as the convolution.

A document's probabilities are those of its windows, weighted by their bytes. Null text, or one
without a letter: ``und`` with score 0. Without labels every language is ``und``. A null id is in
the training fold for nobody; rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, sampled, small_batches, texts

WINDOW = 128
SAMPLE = 3_000
#: Longer texts aren't used for fitting, which bounds what the driver receives to 2 * SAMPLE times so many bytes.
FIT_BYTES = 1 << 15
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8


def windows(texts_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes padded with 0, text number, bytes) of all windows of all texts."""
    raw = [t.encode() for t in texts_]
    sizes = np.array([len(x) for x in raw], np.int64)
    n = -(-sizes // WINDOW)
    flat = np.frombuffer(b"".join(x + bytes(-len(x) % WINDOW) for x in raw), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(raw)), n)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    part = np.arange(len(flat)) - first[owner]
    return flat, owner, np.minimum(WINDOW, sizes[owner] - part * WINDOW)


@dataclass
class Network:
    """``embed`` (256, EMBED); ``kernels[i]`` (WIDTHS[i] * EMBED, FILTERS); ``out`` (filters, languages)."""

    languages: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By pair of bytes: what a pair adds to all filters that begin there, and to those that began two bytes before."""
        tap = lambda i, k: self.embed @ self.kernels[i][k * EMBED : (k + 1) * EMBED]
        here = np.concatenate([(tap(i, 0)[:, None] + tap(i, 1)[None, :]).reshape(65536, FILTERS) for i in range(3)], axis=1)
        after = np.concatenate([np.repeat(tap(1, 2), 256, axis=0), (tap(2, 2)[:, None] + tap(2, 3)[None, :]).reshape(65536, FILTERS)], axis=1)
        return here.astype(np.float32), after.astype(np.float32)

    def scorer(self):
        here, after = self.tables()
        bias = np.concatenate(self.biases).astype(np.float32)

        def probabilities(flat: np.ndarray) -> np.ndarray:
            best = np.full((len(flat), 3 * FILTERS), -np.inf, np.float32)
            padded = np.zeros((flat.shape[1] + 3, len(flat)), np.int32)
            padded[: flat.shape[1]] = flat.T
            pair = padded[:-1] * 256 + padded[1:]
            for j in range(flat.shape[1]):
                value = here[pair[j]]
                value[:, FILTERS:] += after[pair[j + 2]]
                np.maximum(best, value, out=best)
            z = np.maximum(best + bias, 0) @ self.out + self.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return probabilities


def train(flat: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the cross-entropy; through the maximum only the winning position gets a gradient."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (256, EMBED))]
    params += [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS] + [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))), np.zeros(len(languages))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    n_widths = len(WIDTHS)
    for _ in range(epochs):
        order = rng.permutation(len(flat))
        for at in range(0, len(order), batch):
            rows = flat[order[at : at + batch]]
            wide = np.concatenate([rows, np.zeros((len(rows), max(WIDTHS) - 1), np.uint8)], axis=1)
            target = y[order[at : at + batch]]
            embed, kernels, biases, out, out_bias = params[0], params[1 : 1 + n_widths], params[1 + n_widths : 1 + 2 * n_widths], params[-2], params[-1]
            tops, spots = [], []
            for w, k, b in zip(WIDTHS, kernels, biases):
                z = sum(embed[wide[:, i : i + WINDOW]] @ k[i * EMBED : (i + 1) * EMBED] for i in range(w))
                spot = z.argmax(axis=1)
                spots.append(spot)
                tops.append(np.take_along_axis(z, spot[:, None], axis=1)[:, 0] + b)
            hidden = np.maximum(np.concatenate(tops, axis=1), 0)
            z = hidden @ out + out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(target)), target] -= 1
            p /= len(target)
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = hidden.T @ p, p.sum(axis=0)
            back = (p @ out.T) * (hidden > 0)
            for n, (w, k, spot) in enumerate(zip(WIDTHS, kernels, spots)):
                g = back[:, n * FILTERS : (n + 1) * FILTERS]
                grads[1 + n_widths + n] = g.sum(axis=0)
                for i in range(w):
                    seen = np.take_along_axis(wide, spot + i, axis=1)
                    part = k[i * EMBED : (i + 1) * EMBED]
                    grads[1 + n][i * EMBED : (i + 1) * EMBED] = np.einsum("bfe,bf->ef", embed[seen], g)
                    np.add.at(grads[0], seen, g[:, :, None] * part.T[None])
            step += 1
            for q, g, a, s in zip(params, grads, first, second):
                a *= 0.9
                a += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(languages, params[0], params[1 : 1 + n_widths], params[1 + n_widths : 1 + 2 * n_widths], params[-2], params[-1])


def fit_language(docs: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, per_text: int = 6, fit_bytes: int = FIT_BYTES, seed: int = 3) -> Network | None:
    """The network fitted on ``per_text`` seeded windows of each sampled text of at most ``fit_bytes`` bytes."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & (F.octet_length("text") <= fit_bytes) & (crc_bucket("doc_id", folds) != held_out))
    rows = sampled(known, "doc_id", sample).toPandas().sort_values("doc_id")
    rows = rows[rows["text"].str.len() > 0]
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    flat, owner, sizes = windows(rows["text"].tolist())
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(flat))
    order = order[np.argsort(owner[order], kind="stable")]
    place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    chosen = order[place < per_text]
    codes = np.array([languages.index(x) for x in rows["lang"]])
    return train(flat[chosen], codes[owner[chosen]], languages, seed=seed)


def predict(batch: list[str], network: Network | None, score) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(batch), [0.0] * len(batch)
    if network is None:
        return names, scores
    flat, owner, sizes = windows(batch)
    total = np.zeros((len(batch), len(network.languages)))
    for at in range(0, len(flat), 2048):
        np.add.at(total, owner[at : at + 2048], score(flat[at : at + 2048]) * sizes[at : at + 2048, None])
    for i, text in enumerate(batch):
        if any(map(str.isalpha, text)):
            k = int(total[i].argmax())
            names[i], scores[i] = network.languages[k], float(min(1.0, total[i, k] / total[i].sum()))
    return names, scores


def identify_language(docs: DataFrame, network: Network | None, text_col: str = "text", name: str = "_lang") -> DataFrame:
    """``docs`` with the language in column ``name`` and its score in ``<name>_score``; all other columns stay as they are."""
    at = text_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = network.scorer() if network else None
        for b in small_batches(batches, at):
            names, scores = predict(texts(b, at), network, score)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, name, f"{name}_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(f"{name}_score", T.DoubleType())]))


def classify_language(docs: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    network = fit_language(docs, folds, held_out, id_col, text_col, lang_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = identify_language(base, network)
    fold = F.coalesce(crc_bucket("doc_id", folds) == held_out, F.lit(False)).alias("held_out")
    return found.select("doc_id", fold, F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))
