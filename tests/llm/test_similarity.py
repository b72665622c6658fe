import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import similarity, stages


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def share(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def near_copies():
    """(doc_id, text): groups of which each copy has one or two words changed, and texts that are less similar."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for n in (40, 60, 100, 150, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(base)
            for changes in (1, 2, n // 4):
                copy = list(base)
                for _ in range(changes):
                    copy[rng.randrange(n)] = word()
                texts.append(copy)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_no_near_copy_stays(spark, folder):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in stages.near_dedup(spark, df, folder).collect()}
    texts = dict(rows)
    assert not [(a, b) for a in kept for b in kept if a < b and share(texts[a], texts[b]) >= 0.8]
    assert all(any(b < a and share(texts[a], texts[b]) >= 0.8 for b in texts) for a in texts if a not in kept)


@pytest.mark.parametrize("cell", [3000, 16 << 20])
def test_large_group_and_hot_key(spark, folder, monkeypatch, cell):
    """A large group of near copies, and one group of all fingerprints in which most are not similar, so that the last step compares blocks."""
    monkeypatch.setattr(similarity, "ROUNDS", 1)
    monkeypatch.setattr(similarity, "CELL", cell)
    monkeypatch.setattr(similarity, "near_links", lambda fps, distance: fps.agg(F.min("fp").alias("u")).crossJoin(fps.select(F.col("fp").alias("v"))).where("u <> v"))
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(i, " ".join([*base[:40], f"other{i}", *base[41:]])) for i in range(60)]
    rows += [(100 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(80))) for i in range(5)]
    rows += [(200 + i, t + " end") for i, (_, t) in enumerate(rows[-5:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in stages.near_dedup(spark, df, folder).collect()) == [0, 100, 101, 102, 103, 104]


def test_pairs_at_the_threshold_share_a_group():
    """Texts whose similarity is just 0.8: the distance in the nearest of the fingerprints."""
    rng = random.Random(8)
    lost = total = 0
    for _ in range(300):
        n = rng.randrange(60, 400)
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        copy = list(base)
        for at in rng.sample(range(n), max(1, n // 46)):
            copy[at] = f"w{rng.randrange(3000)}"
        a, b = " ".join(base), " ".join(copy)
        if share(a, b) < 0.8:
            continue
        x, y = (similarity.seeded_fingerprints(similarity.word_hashes(t)) for t in (a, b))
        total += 1
        lost += min((p ^ q).bit_count() for p, q in zip(x, y)) > similarity.DISTANCE
    assert total > 150 and lost <= total // 100


def test_small_table(spark, docs, folder):
    found = stages.near_dedup(spark, docs.where("doc_id IS NOT NULL").where(F.length("text") < 5000), folder).collect()
    kept = sorted((r["doc_id"], r["text"]) for r in found if r["text"])
    assert not [(a[0], b[0]) for i, a in enumerate(kept) for b in kept[i + 1 :] if share(a[1], b[1]) >= 0.8]


def test_rows_without_an_id_or_sharing_one(spark, folder):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text), (None, text), (7, text), (7, "quite another text under the same id"), (3, "quite another text under the same id"), (None, "alone here without any id"), (None, "alone here without any id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in stages.near_dedup(spark, df, folder).collect()), key=str)
    assert kept == [(3, rows[4][1]), (7, text), (None, rows[5][1])]
