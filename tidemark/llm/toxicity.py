"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Input of a word: an embedding by the word's hash plus the mean of embeddings by the hashes of its
character n-grams. Overlapping windows of ``WINDOW`` words (every ``STRIDE``) cover the whole text;
each goes through a forward and a backward GRU, attention weighs the positions, a logistic unit
scores the window. A document's score is a logistic
function of its windows' worst, summed and mean probabilities, so that a chance word in a long text weighs little.

Only documents carry labels, so training alternates: mark the windows of toxic documents, take the
worst as positive, and the worst of the others as hard negatives. The network's own logits are the marks,
but before it has learnt anything, it is how much more often a window's words occur in toxic documents. Everything is trained in numpy on
at most ``SAMPLE`` labelled documents of each label outside the held-out fold, none longer than
``FIT_BYTES`` (which bounds what the driver receives; scoring reads whole texts).

Null or empty text: no window, the score of lowest values. Without both labels the score is their
rate (0 without labels). Equal texts get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, sampled, small_batches, texts
from .quality_classifier import labelled

SAMPLE = 1_500
FIT_BYTES = 1 << 15
WINDOW, STRIDE = 16, 8
WIDTH, HIDDEN = 16, 8
WORDS, GRAMS = 1 << 12, 1 << 13
#: Words whose n-grams are in memory at once.
CHUNK = 20_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|/\\-_+=~`"


def units(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, gram hashes word by word, grams in each word): hashes of the bare words and of their character n-grams, 3 to 5 bytes with the ends marked."""
    bare = [(w.strip(PUNCTUATION) or "_").encode() for w in words]
    hashes = np.fromiter((zlib.crc32(w) for w in bare), np.int64, len(bare)) % WORDS
    data = np.frombuffer(b"<" + b"><".join(bare) + b">", np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
    owner = np.repeat(np.arange(len(bare)), lengths)
    grams, owners = [], []
    value = data.copy()
    for n in range(2, 6):
        value = value[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        if n > 2:
            inside = owner[: len(value)] == owner[n - 1 :]
            grams.append((value[inside] >> np.uint32(7)).astype(np.int64) % GRAMS)
            owners.append(owner[: len(value)][inside])
    flat, by = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(by, kind="stable")
    return hashes, flat[order], np.bincount(by, minlength=len(bare))


class Vocabulary(dict):
    """Numbers of words as they come; ``news`` are those whose vectors are still to be made. Number 0 is the blank."""

    def __init__(self):
        super().__init__()
        self.news: list[str] = []
        self.n = 1

    def __missing__(self, word: str) -> int:
        self[word] = n = self.n
        self.n += 1
        self.news.append(word)
        return n


def windows(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text number) of the overlapping windows of texts that follow each other."""
    n = np.maximum(0, -(-(np.array(counts, np.int64) - (WINDOW - STRIDE)) // STRIDE))
    n = np.where((n == 0) & (np.array(counts) > 0), 1, n)
    owner = np.repeat(np.arange(len(counts)), n)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    start = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return start[owner] + (np.arange(len(owner)) - first[owner]) * STRIDE, owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


SHAPES = {
    "word": (WORDS, WIDTH), "gram": (GRAMS, WIDTH), "in_f": (WIDTH, 3 * HIDDEN), "in_b": (WIDTH, 3 * HIDDEN),
    "re_f": (HIDDEN, 3 * HIDDEN), "re_b": (HIDDEN, 3 * HIDDEN), "bias_f": (3 * HIDDEN,), "bias_b": (3 * HIDDEN,),
    "look": (2 * HIDDEN,), "out": (2 * HIDDEN,), "out_bias": (1,),
}


@dataclass
class Network:
    p: dict[str, np.ndarray]
    weights: np.ndarray | None = None
    flat: float | None = None

    def vectors(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), WIDTH), np.float32)
        if not words:
            return out
        hashes, grams, sizes = units(words)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        out[:] = np.add.reduceat(self.p["gram"][grams], starts, axis=0) / sizes[:, None].astype(np.float32) + self.p["word"][hashes]
        return out

    def window_logits(self, forward: np.ndarray, backward: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """``forward`` and ``backward``: input parts of the gates by word number; ``ids`` (position, window), 0 beyond the text."""
        steps, n = ids.shape
        states = np.zeros((2, steps, n, HIDDEN), np.float32)
        for d, (inputs, recur, order) in enumerate(((forward, self.p["re_f"], range(steps)), (backward, self.p["re_b"], range(steps - 1, -1, -1)))):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                x = inputs[ids[t]]
                u = h @ recur
                gates = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                new = np.tanh(x[:, 2 * HIDDEN :] + gates[:, :HIDDEN] * u[:, 2 * HIDDEN :])
                h = h + gates[:, HIDDEN:] * (new - h)
                h *= (ids[t] > 0)[:, None]
                states[d, t] = h
        look = states[0] @ self.p["look"][:HIDDEN] + states[1] @ self.p["look"][HIDDEN:]
        look = np.where(ids > 0, look, -1e9)
        a = np.exp(look - look.max(axis=0))
        a /= a.sum(axis=0)
        value = states[0] @ self.p["out"][:HIDDEN] + states[1] @ self.p["out"][HIDDEN:]
        return (a * value).sum(axis=0) + self.p["out_bias"][0]

    def scorer(self, most: int = 150_000):
        """``Summary`` rows of the texts of a batch. Word inputs are kept for up to ``most`` words."""
        state = {"vocabulary": Vocabulary(), "f": self._inputs(np.zeros((1, WIDTH), np.float32), "f"), "b": self._inputs(np.zeros((1, WIDTH), np.float32), "b")}

        def run(batch: list[str]) -> np.ndarray:
            vocabulary = state["vocabulary"]
            if vocabulary.n > most:
                state["vocabulary"] = vocabulary = Vocabulary()
                state["f"], state["b"] = state["f"][:1], state["b"][:1]
            split = [t.lower().split() for t in batch]
            counts = [len(w) for w in split]
            ids = np.fromiter((vocabulary[w] for words in split for w in words), np.int32, sum(counts))
            if vocabulary.news:
                vectors = self.vectors(vocabulary.news)
                state["f"] = np.concatenate([state["f"], self._inputs(vectors, "f")])
                state["b"] = np.concatenate([state["b"], self._inputs(vectors, "b")])
                vocabulary.news = []
            first, owner = windows(counts)
            ends = np.cumsum(counts)
            found = Summary(len(batch))
            for at in range(0, len(first), 4096):
                s, o = first[at : at + 4096], owner[at : at + 4096]
                place = s[None, :] + np.arange(WINDOW)[:, None]
                seen = np.where(place < ends[o], ids[np.minimum(place, len(ids) - 1)], 0)
                found.add(o, self.window_logits(state["f"], state["b"], seen))
            return found.rows()

        return run

    def _inputs(self, vectors: np.ndarray, side: str) -> np.ndarray:
        return (vectors @ self.p[f"in_{side}"] + self.p[f"bias_{side}"]).astype(np.float32)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(rows), self.flat)
        return sigmoid(rows @ self.weights)


class Summary:
    """What a document's windows say together: the worst logit, the log of the summed and the mean probability, and a constant."""

    def __init__(self, n: int):
        self.top, self.total, self.windows = np.full(n, -15.0), np.zeros(n), np.zeros(n)

    def add(self, owner: np.ndarray, logits: np.ndarray) -> None:
        np.maximum.at(self.top, owner, np.clip(logits, -15, 15))
        self.total += np.bincount(owner, sigmoid(logits.astype(float)), len(self.top))
        self.windows += np.bincount(owner, minlength=len(self.top))

    def rows(self) -> np.ndarray:
        return np.stack([self.top, np.log(self.total + 1e-3), np.log(self.total / np.maximum(self.windows, 1) + 1e-4), np.ones(len(self.top))], axis=1)


class Units:
    """Hashes of a list of words (number 0, the blank, has none), flat."""

    def __init__(self, words: list[str]):
        parts = [units(words[at : at + CHUNK]) for at in range(0, len(words), CHUNK)]
        self.words = np.concatenate([[0], *(p[0] for p in parts)])
        self.grams = np.concatenate([p[1].astype(np.int16) for p in parts])
        self.sizes = np.concatenate([[0], *(p[2] for p in parts)])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word hashes, gram hashes, gram counts) of some words, none of them the blank."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        return self.words[numbers], self.grams[at], sizes


def summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by index."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(index, kind="stable")
    seen, starts = np.unique(index[order], return_index=True)
    if len(seen):
        out[seen] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def gradients(net: Network, words: np.ndarray, grams: np.ndarray, sizes: np.ndarray, ids: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Back-propagation through attention, both GRUs and both inputs for windows ``ids`` (position, window) into the listed words (row 0 is the blank)."""
    p = net.p
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    vectors = np.concatenate([np.zeros((1, WIDTH), np.float32), np.add.reduceat(p["gram"][grams], starts, axis=0) / sizes[:, None].astype(np.float32) + p["word"][words]])
    steps, n = ids.shape
    live = (ids > 0).astype(np.float32)[:, :, None]
    H = HIDDEN
    states = np.zeros((2, steps, n, H), np.float32)
    kept = []
    for d, side in enumerate("fb"):
        inputs, recur = vectors @ p[f"in_{side}"] + p[f"bias_{side}"], p[f"re_{side}"]
        h, trace = np.zeros((n, H), np.float32), {}
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x, u = inputs[ids[t]], h @ recur
            gates = sigmoid(x[:, : 2 * H] + u[:, : 2 * H])
            r, z = gates[:, :H], gates[:, H:]
            c = np.tanh(x[:, 2 * H :] + r * u[:, 2 * H :])
            trace[t] = (h, u, r, z, c)
            h = (h + z * (c - h)) * live[t]
            states[d, t] = h
        kept.append(trace)
    both = np.concatenate([states[0], states[1]], axis=2)
    look = np.where(ids > 0, both @ p["look"], np.float32(-1e9))
    a = np.exp(look - look.max(axis=0))
    a /= a.sum(axis=0)
    value = both @ p["out"]
    error = ((sigmoid((a * value).sum(axis=0) + p["out_bias"][0]) - y) / n).astype(np.float32)
    d_value = a * error
    d_look = a * (value - (a * value).sum(axis=0)) * error
    grads = {}
    grads["out"] = np.einsum("tnh,tn->h", both, d_value)
    grads["look"] = np.einsum("tnh,tn->h", both, d_look)
    grads["out_bias"] = np.array([error.sum()], np.float32)
    d_both = d_value[:, :, None] * p["out"] + d_look[:, :, None] * p["look"]
    d_vectors = np.zeros_like(vectors)
    for d, side in enumerate("fb"):
        recur, d_h = p[f"re_{side}"], np.zeros((n, H), np.float32)
        d_inputs = np.zeros((steps, n, 3 * H), np.float32)
        grads[f"re_{side}"] = np.zeros_like(recur)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            h, u, r, z, c = kept[d][t]
            g = (d_h + d_both[t, :, d * H : (d + 1) * H]) * live[t]
            d_c = g * z * (1 - c * c)
            d_z = g * (c - h) * z * (1 - z)
            d_r = d_c * u[:, 2 * H :] * r * (1 - r)
            d_inputs[t] = np.concatenate([d_r, d_z, d_c], axis=1)
            d_u = np.concatenate([d_r, d_z, d_c * r], axis=1)
            grads[f"re_{side}"] += h.T @ d_u
            d_h = g * (1 - z) + d_u @ recur.T
        by_word = summed(ids.ravel(), d_inputs.reshape(-1, 3 * H), len(vectors))
        by_word[0] = 0
        grads[f"in_{side}"] = vectors.T @ by_word
        grads[f"bias_{side}"] = by_word.sum(axis=0)
        d_vectors += by_word @ p[f"in_{side}"].T
    grads["word"] = summed(words, d_vectors[1:], WORDS)
    grads["gram"] = summed(grams, np.repeat(d_vectors[1:] / sizes[:, None].astype(np.float32), sizes, axis=0), GRAMS)
    return grads


class Fitter:
    """Adam over shuffled windows ``ids`` (window, position) into a vocabulary."""

    def __init__(self, known: Units, ids: np.ndarray, seed: int):
        self.known, self.ids = known, ids
        self.rng = np.random.default_rng(seed)
        self.net = Network({k: self.rng.normal(0, 0.01 if k in ("word", "gram") else 0.3, s).astype(np.float32) for k, s in SHAPES.items()})
        for k in ("bias_f", "bias_b", "out_bias"):
            self.net.p[k][:] = 0
        self.first = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        self.second = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        self.step = 0

    def run(self, rows: np.ndarray, y: np.ndarray, batch: int = 256, rate: float = 0.01) -> None:
        order = self.rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            seen, ids = np.unique(self.ids[rows[part]].T, return_inverse=True)
            ids = ids.reshape(WINDOW, len(part))
            if seen[0] == 0:
                seen = seen[1:]
            else:
                ids += 1
            grads = gradients(self.net, *self.known.of(seen), ids, y[part])
            self.step += 1
            for k, g in grads.items():
                a, s = self.first[k], self.second[k]
                a *= 0.9
                a += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                self.net.p[k] -= rate * (a / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)

    def logits(self) -> np.ndarray:
        """Of all windows."""
        vectors = np.zeros((len(self.known.words), WIDTH), np.float32)
        for at in range(1, len(vectors), CHUNK):
            words, grams, sizes = self.known.of(np.arange(at, min(at + CHUNK, len(vectors))))
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            vectors[at : at + CHUNK] = np.add.reduceat(self.net.p["gram"][grams], starts, axis=0) / sizes[:, None].astype(np.float32) + self.net.p["word"][words]
        f, b = self.net._inputs(vectors, "f"), self.net._inputs(vectors, "b")
        out = np.zeros(len(self.ids))
        for at in range(0, len(out), 4096):
            out[at : at + 4096] = self.net.window_logits(f, b, self.ids[at : at + 4096].T)
        return out


def suspicion(numbered: list[np.ndarray], words: list[str], y: np.ndarray) -> np.ndarray:
    """By word number: how far the share of toxic documents with the word lies above that of the others, in standard errors. The blank has none."""
    bare: dict[str, int] = {}
    of = np.array([0, *(bare.setdefault(w.strip(PUNCTUATION), len(bare) + 1) for w in words)])
    found = np.zeros((2, len(bare) + 1))
    for x, label in zip(numbered, y):
        found[int(label == 1), np.unique(of[x])] += 1
    n = np.array([(y != 1).sum(), (y == 1).sum()], float)
    rate = found.sum(axis=0) / n.sum()
    z = (found[1] / n[1] - found[0] / n[0]) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n).sum())
    z[0] = -np.inf
    return z[of].astype(np.float32)


def fit(texts_: list[str], y: np.ndarray, rounds: int = 7, most: int = 6_000, seed: int = 5) -> Network:
    """Round 0 takes the windows with the most suspicious words; later rounds take those that the network finds worst (see the module)."""
    flat = Network({k: np.zeros(s, np.float32) for k, s in SHAPES.items()}, flat=float(y.mean()) if len(y) else 0.0)
    vocabulary = Vocabulary()
    numbered = [np.fromiter((vocabulary[w] for w in t.lower().split()), np.int32) for t in texts_]
    counts = [len(x) for x in numbered]
    numbers = np.concatenate([np.zeros(0, np.int32), *numbered])
    first, owners = windows(counts)
    bad, good = np.flatnonzero(y[owners] == 1), np.flatnonzero(y[owners] == 0)
    if not len(bad) or not len(good):
        return flat
    ends = np.cumsum(counts)[owners]
    ids = np.zeros((len(first), WINDOW), np.int32)
    for t in range(WINDOW):
        ids[:, t] = np.where(first + t < ends, numbers[np.minimum(first + t, len(numbers) - 1)], 0)
    fitter = Fitter(Units(vocabulary.news), ids, seed)
    rng = fitter.rng

    def summary(logits: np.ndarray) -> Summary:
        found = Summary(len(y))
        found.add(owners, logits)
        return found

    for r in range(rounds):
        if r == 0:
            by_word = suspicion(numbered, vocabulary.news, y)
            marks = by_word[ids[:, 0]]
            for t in range(1, WINDOW):
                np.maximum(marks, by_word[ids[:, t]], out=marks)
            top, least = np.full(len(y), -np.inf), -np.inf
            np.maximum.at(top, owners, marks)
        else:
            logits = fitter.logits()
            marks, least = np.clip(logits, -15, 15), 0.0
            top = summary(logits).top
        # The worst windows of each toxic document, and others that are marked as clean ones hardly are.
        limit = max(least, float(np.quantile(marks[good], 0.9995)))
        pos = bad[(marks[bad] >= top[owners[bad]]) | (marks[bad] > limit)]
        pos = rng.choice(pos, min(len(pos), most), replace=False)
        hard = good[np.argsort(-marks[good])[:most]]
        chosen = np.concatenate([pos, rng.choice(good, min(len(good), 2 * most), replace=False), hard])
        for _ in range(2):
            fitter.run(chosen, (y[owners[chosen]] == 1).astype(np.float32), rate=0.01 if r < rounds - 2 else 0.004)
    net = fitter.net
    net.weights = calibrated(summary(fitter.logits()).rows(), y)
    return net


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic fit by damped Newton steps."""
    w = np.zeros(x.shape[1])
    pull = ridge * np.eye(len(w))
    for _ in range(60):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return w


def predictor(net: Network, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.scorer()
        for b in small_batches(batches, most=1 << 20):
            p = net.probability(score(texts(b)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, held_out: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labelled(labels, label_col).where(crc_bucket("doc_id", folds) != held_out).withColumn("y", (F.col("y") >= 0.5).cast("int"))
    chosen = sampled(known.where("y = 1"), "doc_id", sample).unionByName(sampled(known.where("y = 0"), "doc_id", sample))
    # At most 4 * sample ids, one row for each, so the driver gets at most so many texts of fit_bytes.
    short = base.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= fit_bytes)
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toPandas().sort_values("doc_id")
    net = fit([t or "" for t in rows["text"]], rows["y"].to_numpy(int))
    fold = F.coalesce(crc_bucket("doc_id", folds) == held_out, F.lit(False)).alias("held_out")
    return base.select("doc_id", fold, "text").mapInArrow(predictor(net, threshold), "doc_id long, held_out boolean, score double, predicted int")
