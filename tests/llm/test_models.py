import random
import zlib

import numpy as np
import pytest

from tidemark.llm import language, quality_classifier, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_on_held_out(corpus):
    docs, _ = corpus
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.classify_language(docs).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    w, e, f = language.WIDTHS, language.EMBED, language.FILTERS
    net = language.Network(["a", "b"], rng.normal(size=(256, e)), [rng.normal(size=(k * e, f)) for k in w], [rng.normal(size=f) for _ in w], rng.normal(size=(3 * f, 2)), rng.normal(size=2))
    flat = rng.integers(0, 256, (7, 128)).astype(np.uint8)
    wide = np.concatenate([flat, np.zeros((7, 3), np.uint8)], axis=1)
    tops = [np.max([net.embed[wide[:, j : j + k]].reshape(7, -1) @ net.kernels[i] for j in range(128)], axis=0) + net.biases[i] for i, k in enumerate(w)]
    z = np.maximum(np.concatenate(tops, axis=1), 0) @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(net.scorer()(flat), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_language_of_odd_and_empty(odd, empty):
    rows = language.classify_language(odd).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows} <= {"en", "und"}
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 10)] == ["und"] * 4
    assert language.classify_language(empty).count() == 0


def test_windows_cover_whole_texts():
    texts = ["", "a", "x" * 128, "y" * 129, "é" * 500]
    flat, owner, sizes = language.windows(texts)
    for i, t in enumerate(texts):
        assert b"".join(bytes(flat[j][: sizes[j]]) for j in np.flatnonzero(owner == i)) == t.encode()


def test_quality_on_held_out(corpus):
    docs, labels = corpus
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_classifier.classify_quality(docs, labels).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, len(quality_classifier.FEATURES))).astype(np.float32)
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] < -0.5)).astype(float)
    trees = quality_classifier.fit(x[:2000], y[:2000])
    assert np.mean((trees(x[2000:]) > 0.5) == y[2000:]) > 0.95

    def walk(row):
        total = trees.base
        for i in trees.roots:
            while trees.feature[i] >= 0:
                i = trees.left[i] + (row[trees.feature[i]] > trees.cut[i])
            total += trees.value[i]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], trees(x[:50]))


def test_quality_of_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify_quality(odd, labels).count() == odd.count()
    assert quality_classifier.classify_quality(empty, labels).count() == 0
    none = quality_classifier.classify_quality(odd, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = toxicity.Network({k: rng.normal(0, 0.4, s) for k, s in toxicity.SHAPES.items()})
    words = ["foo", "bar.", "baz", "quux"]
    known = toxicity.Units(words)
    ids = np.zeros((toxicity.WINDOW, 3), np.int64)
    ids[:4, 0], ids[:2, 1], ids[:16, 2] = [1, 2, 3, 4], [2, 2], [1, 4] * 8
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        v = np.concatenate([np.zeros((1, toxicity.WIDTH), np.float32), net.vectors(words)])
        z = net.window_logits(net._inputs(v, "f"), net._inputs(v, "b"), ids).astype(float)
        p = toxicity.sigmoid(z)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    got = toxicity.gradients(net, *known.of(np.arange(1, 5)), ids, y)
    for name in ("in_f", "in_b", "re_f", "re_b", "bias_f", "look", "out", "out_bias"):
        flat = net.p[name].ravel()
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            keep, step = flat[i], 1e-2
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * step) - got[name].ravel()[i]) < 2e-3, name


def test_toxicity_windows_overlap_and_cover():
    for n in (0, 1, 8, 16, 17, 24, 25, 100):
        first, owner = toxicity.windows([n, 5])
        mine = first[owner == 0]
        assert {i for s in mine for i in range(s, min(s + toxicity.WINDOW, n))} == set(range(n))


def test_toxicity_learns_words():
    rng = random.Random(0)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    texts, y = [], []
    for i in range(240):
        words = [rng.choice(plain) + rng.choice(["", "s", "n"]) for _ in range(rng.randrange(10, 80))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "vile" + rng.choice(["", "ness", "r", "st"])
        texts.append(" ".join(words))
        y.append(int(i % 3 == 0))
    net = toxicity.fit(texts[:200], np.array(y[:200]), rounds=5, most=800)
    p = net.probability(net.scorer()(texts[200:]))
    assert np.mean((p >= 0.3) == np.array(y[200:])) > 0.9


def test_toxicity_of_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(12)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify_toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.classify_toxicity(empty, labels).count() == 0
    assert toxicity.classify_toxicity(odd, labels.where("false")).count() == odd.count()
