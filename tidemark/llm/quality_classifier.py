"""Quality classifier: histogram gradient-boosted trees over document statistics.

The texts are read once into a narrow table of statistics. The trees are fitted on the driver on at
most ``SAMPLE`` labelled rows outside the held-out fold (a documented bound; the features of these
rows are a few MB), flattened into arrays and applied to all rows by vectorised traversal.

Null text counts as empty: all statistics 0. Labels without a document or a value are left out;
repeated labels of an id are averaged. Without two classes among the labels the score is the
rate of label 1 (0.5 without labels). Equal texts get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, sampled, small_batches, texts, written

SAMPLE = 20_000
LETTERS = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "spaces", "symbols", "marks", "pipes",
    "exclaims", "stops", "distinct_words", "top_word", "same_as_before", "long_words", "short_words", "line_words",
    "distinct_lines", "line_ends_stop", "upper_words", "symbol_words", "entropy", "repeated_pairs",
)


def features(text: str) -> list[float]:
    """The statistics named in ``FEATURES``, shares unless said otherwise."""
    raw = text.encode()
    n = len(raw)
    words = raw.split()
    if not words:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda chars: float(bytes_[list(chars)].sum()) / n
    m = len(words)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = bytes_[bytes_ > 0] / n
    pairs = Counter(zip(words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(lengths.mean()), float(bytes_[LETTERS].sum()) / n,
        float(bytes_[65:91].sum()) / n, float(bytes_[48:58].sum()) / n, share(b" \n\t\r\x0b\x0c"), share(b"#*$%&|<>"),
        share(b".,;:!?"), share(b"|"), share(b"!"), share(b"."), len(counts) / m, max(counts.values()) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m, float((lengths > 12).mean()), float((lengths < 3).mean()),
        m / len(lines), len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        sum(map(bytes.isupper, words)) / m, sum(w[-1] in b"#*$%&|<>" for w in words) / m, float(-(p * np.log2(p)).sum()),
        1 - len(pairs) / max(1, m - 1),
    ]


@dataclass
class Trees:
    """All trees in flat arrays: node ``i`` sends a row to ``left[i]`` if its feature is at most ``cut[i]``, else to ``left[i] + 1``; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                leaf = self.feature[at] < 0
                step = self.left[at] + (x[rows, np.maximum(self.feature[at], 0)] > self.cut[at])
                at = np.where(leaf, at, step)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Logistic loss; each level finds the best cut of every node from histograms of gradients and curvatures."""
    rate_of = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(rate_of, 1e-3) / max(1 - rate_of, 1e-3)))
    feature, cut, left, value, roots = [], [], [], [], []
    if len(y) and 0 < rate_of < 1:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        n_features = x.shape[1]
        columns = np.arange(n_features) * bins
        score = np.full(len(y), base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = y - p, p * (1 - p)
            roots.append(len(feature))
            feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
            at = np.full(len(y), roots[-1])
            level = [roots[-1]]
            for _ in range(depth):
                place = {node: i for i, node in enumerate(level)}
                slot = np.array([place.get(i, -1) for i in range(len(feature))])[at]
                inside = slot >= 0
                cell = (slot[inside, None] * (n_features * bins) + columns + binned[inside]).ravel()
                size = len(level) * n_features * bins
                g, h = (np.bincount(cell, np.repeat(v[inside], n_features), size).reshape(len(level), n_features, bins).cumsum(axis=2) for v in (gradient, curve))
                all_g, all_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(h < least / 4) | (all_h - h < least / 4)] = -1
                nexts = []
                for i, node in enumerate(level):
                    best = int(gain[i].argmax())
                    f, b = divmod(best, bins)
                    if gain[i, f, b] <= 1e-6 or b >= len(edges[f]):
                        continue
                    feature[node], cut[node], left[node] = f, float(edges[f][b]), len(feature)
                    for _ in range(2):
                        nexts.append(len(feature))
                        feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
                    here = at == node
                    at[here] = left[node] + (binned[here, f] > b)
                level = nexts
                if not level:
                    break
            sums = np.bincount(at, gradient, len(feature)) / (np.bincount(at, curve, len(feature)) + ridge)
            for i in range(roots[-1], len(feature)):
                value[i] = rate * float(sums[i]) if feature[i] < 0 else 0.0
            score += np.array(value)[at]
    return Trees(np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(value), np.array(roots, np.int64), depth, base)


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        x = pa.array([features(t) for t in texts(b)], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])


def predictor(trees: Trees, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            p = trees(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): the mean label of each id."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(column).alias("y"))


def classify_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held_out: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = written(base.mapInArrow(extract, "doc_id long, x array<float>"), "statistics")
    known = labelled(labels, label_col).where(crc_bucket("doc_id", folds) != held_out)
    rows = table.join(sampled(known, "doc_id", sample), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).toPandas()  # one row for each of the sampled ids
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    trees = fit(x, (rows["y"].to_numpy(float) >= 0.5).astype(float))
    fold = F.coalesce(crc_bucket("doc_id", folds) == held_out, F.lit(False)).alias("held_out")
    return table.select("doc_id", fold, "x").mapInArrow(predictor(trees, threshold), "doc_id long, held_out boolean, score double, predicted int")
