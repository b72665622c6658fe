import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash, suffix_dedup
from tidemark.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, distance):
    values = sorted(set(values))
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    array = np.array(values, np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(array[:, None] ^ array[None]) <= distance)):
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return {v: values[find(i)] for i, v in enumerate(values)}


def test_near_duplicates(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
        roots = groups([f for _, f in rows], 3)
        least = {}
        for d, f in rows:
            if d is not None:
                least[roots[f]] = min(least.get(roots[f], d), d)
        want = sorted((str(d), f"{f:016x}", str(least.get(roots[f]))) for d, f in rows)
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_links_of_dense_values(spark, monkeypatch, distance):
    """Clusters within a few bits; a low limit sends hot values through the second splitting."""
    monkeypatch.setattr(simhash, "HOT", 40)
    rng = random.Random(distance)
    values = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        values += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(25)]
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in set(values)]
    found = components(simhash.near_links(spark.createDataFrame(signed, "fp long"), distance))
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found.collect()}
    want = groups(values, distance)
    ours = {v: got.get(v, v) for v in want}
    assert len(set(zip(ours.values(), want.values()))) == len(set(want.values())) == len(set(ours.values()))


def test_thresholds_lose_no_pair():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 300).astype(np.uint64)
    for distance in (1, 3, 6):
        parts = simhash.plan(sample, 1_000_000, distance)
        assert sum(t + 1 for _, _, t in parts) == distance + 1
        for _ in range(300):
            flips = rng.choice(64, distance, replace=False)
            other = int(np.bitwise_xor.reduce(np.left_shift(np.uint64(1), flips.astype(np.uint64))))
            assert any((other & int(m)).bit_count() <= t for m, _, t in parts)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 95)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 95: 90, 100: 90}
    assert components(edges.where("u < 0")).count() == 0


def brute_removal(rows, length):
    """In the order of ids (nulls last); of rows with one id the order is the operator's."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, m in zip(raw, mark) if not m)
        spans = sum(1 for i in range(len(raw)) if mark[i] and not (i and mark[i - 1]))
        out.append((str(doc), len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def ordered(df):
    """(id, text) in the operator's order; rows equal in both once."""
    keyed = suffix_dedup.keyed(df, "doc_id", "text").dropDuplicates(["doc", "row"]).orderBy("doc", "row")
    return [(r["doc_id"], r["text"]) for r in keyed.collect()]


def removed(df, length=100):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, length).collect())


def test_removal(docs, odd, empty):
    for df in (docs, odd):
        once = df.dropDuplicates(["doc_id", "text"])
        assert removed(once) == brute_removal(ordered(once), 100)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_removal_of_shuffled_passages(spark, monkeypatch):
    """Passages cut at random places and runs of one byte, over many small runs and slices."""
    monkeypatch.setattr(suffix_dedup, "RUN", 50)
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    rng = random.Random(9)
    stock = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(4)] + ["z" * 300, "xy" * 150, "é" * 120]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            s = rng.choice(stock)
            a = rng.randrange(len(s) - 50)
            parts += [s[a : a + rng.randrange(60, 260)], "".join(rng.choice("ijklmn") for _ in range(rng.randrange(0, 80)))]
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert removed(df) == brute_removal(ordered(df), 100)


def shared_line_texts(n):
    """Documents that share a line of 130 bytes between neighbours of their own, some of which repeat too."""
    rng = random.Random(12)
    line = "this line stands in very many documents, word for word, with other words before and after it, so its contexts are all different"
    sides = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(0, 120))) for _ in range(n // 2)]
    return [rng.choice(sides) + line[: rng.choice([60, 105, 130])] + rng.choice(sides) + rng.choice(["", line]) for _ in range(n)]


@pytest.mark.parametrize("hot, group", [(10**9, 10), (10**9, 50_000), (5, 50_000)])
def test_removal_around_a_frequent_line(spark, monkeypatch, hot, group):
    """Large groups at once, in steps, and with their strings dealt by hashes."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "PICK", 1)
    monkeypatch.setattr(suffix_dedup, "RUN", 300)
    texts = shared_line_texts(150)
    df = spark.createDataFrame([(i if i % 10 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert removed(df) == brute_removal(ordered(df), 100)


def test_strings_around_a_hot_gram_are_held_in_steps(spark, monkeypatch):
    """A task passes them on as they become many, and what an entry loses is one span."""
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    monkeypatch.setattr(suffix_dedup, "PICK", 1)
    monkeypatch.setattr(suffix_dedup, "STRINGS", 200, raising=False)
    monkeypatch.setattr(suffix_dedup, "SPANS", 50)
    texts = shared_line_texts(150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert removed(df) == brute_removal(ordered(df), 100)
    at = [suffix_dedup.samples(t.encode(), 100)[0].tolist() for t in texts]
    grams = frozenset(t.encode()[p : p + suffix_dedup.GRAM] for t, places in zip(texts, at) for p in places)
    rows = pa.RecordBatch.from_pydict({"doc": list(range(150)), "row": list(range(150)), "text": texts, "places": at})
    sizes = [b.num_rows for b in suffix_dedup.exchange_rows(100, [], grams, 4)(iter([rows]))]
    assert len(sizes) > 5 and max(sizes) < 200 + 70


def test_a_large_group_loses_one_span_an_entry():
    rng = random.Random(8)
    gram = b"g" * suffix_dedup.GRAM
    sides = [bytes(rng.choice(b"ab") for _ in range(68)) for _ in range(9)]
    group = sorted((gram + rng.choice(sides)[: rng.randrange(30, 69)], rng.choice(sides)[: rng.randrange(69)], i, i, 100) for i in range(200))
    prefixes = [0] + [suffix_dedup.common(a[0], b[0]) for a, b in zip(group, group[1:])]
    out = []
    suffix_dedup.resolve(group, prefixes, 100, out)
    assert 50 < len(out) == len({x[1] for x in out})


def test_groups_by_common_prefixes():
    """Entries of one group in any number, some near the ends of their texts, against comparing all pairs."""
    rng = random.Random(3)
    gram, length = b"g" * suffix_dedup.GRAM, 60
    for n in (2, 5, 9, 30, 80):
        rights = [gram + bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, length - len(gram) + 1))) for _ in range(6)]
        lefts = [bytes(rng.choice(b"xy") for _ in range(rng.randrange(0, length - len(gram) + 1))) for _ in range(6)]
        group = sorted((rng.choice(rights), rng.choice(lefts), i % 7, i // 7, 100) for i in range(n))
        prefixes = [0] + [suffix_dedup.common(a[0], b[0]) for a, b in zip(group, group[1:])]
        out = []
        keep = suffix_dedup.resolve(group, prefixes, length, out)
        got, want = set(), set()
        for order, doc, start, stop in out:
            got |= {(order, doc, i) for i in range(start, stop)}
        firsts = set()
        for a in range(length - len(gram) + 1):
            strings = {}
            for i, e in enumerate(group):
                if len(e[1]) >= a and len(e[0]) >= length - a:
                    strings.setdefault((e[1][:a], e[0][: length - a]), []).append((e[2:], i))
            for held in strings.values():
                firsts.add(min(held)[1])
                for (order, doc, place), _ in sorted(held)[1:]:
                    want |= {(order, doc, i) for i in range(place - a, place - a + length)}
        assert got == want and firsts <= set(keep)
        kept, between = suffix_dedup.kept_of(group, prefixes, keep)
        assert between[1:] == [suffix_dedup.common(a[0], b[0]) for a, b in zip(kept, kept[1:])]


def test_merge_of_front_coded_runs():
    rng = random.Random(5)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    runs, at = [], 0
    while at < len(keys):
        n = rng.randrange(1, 40)
        runs.append(suffix_dedup.Run(suffix_dedup.segment(sorted((k, k[::-1], i, i, i) for i, k in enumerate(keys[at : at + n])))))
        at += n
    got = list(suffix_dedup.merged(runs))
    assert [e[0] for _, e in got] == sorted(keys)
    for (_, a), (p, b) in zip(got, got[1:]):
        assert p == suffix_dedup.common(a[0], b[0])


def test_equal_strings_hold_a_sample_at_one_place():
    rng = random.Random(6)
    core = bytes(rng.randrange(97, 105) for _ in range(100))
    places = set()
    for _ in range(20):
        before, after = (bytes(rng.randrange(97, 105) for _ in range(rng.randrange(0, 300))) for _ in range(2))
        at, _ = suffix_dedup.samples(before + core + after, 100)
        inside = [p - len(before) for p in at.tolist() if 0 <= p - len(before) <= 100 - suffix_dedup.GRAM]
        assert inside
        places = set(inside) if not places else places & set(inside)
    assert places


def test_repeated_rows_get_one_result(spark):
    df = spark.createDataFrame([(1, "q" * 150), (1, "q" * 150)], "doc_id long, text string")
    assert len({tuple(r) for r in suffix_dedup.remove_repeats(df).collect()}) == 1
    assert df.select(F.count("*")).first()[0] == 2
