import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from tests.compare import both
from tidemark.llm import queries
from tidemark.llm.mixing import fit_budget, mix
from tidemark.llm.quality_rules import quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, folder, name):
    mine, theirs = both(spark, queries.QUERIES[name], queries.ORACLES[name], folder)
    assert mine == theirs


def brute_rules(rows, limit):
    texts = [(r["doc_id"], r["text"] or "", r["source"]) for r in rows]
    normal = lambda x: re.sub("[\x20\x09-\x0d]+", " ", x).strip(" ").lower()
    seen, first = defaultdict(set), {}
    for i, t, s in texts:
        for line in {normal(x) for x in t.split("\n") if WORD.search(x)}:
            seen[s, line].add(t)
    for i, t, s in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        for line in {normal(x) for x in t.split("\n") if WORD.search(x)}:
            first.setdefault((s, line), t)
    out = []
    for i, t, s in texts:
        words = WORD.findall(t)
        triples = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        counts = Counter(triples)
        covered = {j + d for j, x in enumerate(triples) if counts[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in lines if len(seen[s, normal(x)]) > limit and first[s, normal(x)] != t)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and 100 * (len(words) - gone) >= 30 * len(words), gone))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1, 50])
def test_rules_against_brute_force(docs, limit):
    got = sorted((tuple(r) for r in quality_rules(docs, max_docs_per_line=limit).collect()), key=str)
    assert got == brute_rules(docs.collect(), limit)


def test_rules_on_odd_and_empty(odd, empty):
    rows = quality_rules(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    assert quality_rules(empty).count() == 0


@settings(deadline=None, max_examples=60)
@given(some.lists(some.tuples(some.integers(1, 40), some.integers(1, 6)), min_size=1, max_size=7, unique_by=lambda x: x[0]), some.floats(0, 1))
def test_budget_is_met_as_well_as_possible(pairs, share):
    lengths, counts = [p[0] for p in pairs], [p[1] for p in pairs]
    budget = int(share * sum(a * b for a, b in pairs))
    take = fit_budget(lengths, counts, budget, window=10**6)
    assert all(0 <= k <= c for k, c in zip(take, counts))
    got = sum(a * k for a, k in zip(lengths, take))
    assert got <= budget
    assert budget - got <= max(lengths)


def test_budget_of_many_documents():
    rng = random.Random(1)
    lengths = sorted(rng.sample(range(1, 20_000), 900))
    counts = [rng.randrange(1, 50) for _ in lengths]
    budget = sum(a * b for a, b in zip(lengths, counts)) // 3 + 17
    take = fit_budget(lengths, counts, budget)
    assert sum(a * k for a, k in zip(lengths, take)) == budget
    assert all(0 <= k <= c for k, c in zip(take, counts))


def brute_targets(sizes):
    """Weights 5, 2, 1 by rank; what is above the cap is dealt again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in free}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mix(docs):
    sizes, longest = Counter(), Counter()
    for r in docs.collect():
        n = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    goals = brute_targets(sizes)
    by_size = defaultdict(int)
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by_size[r["source_size"], round(r["target"], 3)] += r["taken"]
    assert {(n, round(goals[s], 3)) for s, n in sizes.items()} == set(by_size)
    for (size, target), taken in by_size.items():
        same = [s for s, n in sizes.items() if (n, round(goals[s], 3)) == (size, target)]
        # Documents are whole: one that is longer than what is left can't help.
        assert 0 <= len(same) * target - taken + 0.5 <= sum(1 + max(0.001 * target, longest[s] if longest[s] > 0.2 * target else 0) for s in same)
    assert sorted(map(str, mix(docs.repartition(5)).collect())) == sorted(map(str, rows))


def test_mix_on_odd_and_empty(odd, empty):
    assert mix(odd).count() == odd.count()
    assert mix(empty).count() == 0
