import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from tidemark.llm import automaton
from tidemark.llm.automaton import Automaton, Walker, anchored, backwards, searching, shortest
from tidemark.llm.secrets import BASE, RULES, compiled, redact, redact_documents, scan, scan_secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


#: The rules beyond the base by ``re``, with the least length of a match.
MORE = (
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1),
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    ("gh[pousr]_[A-Za-z0-9]+", 40),
    ("xox[abprs]-[A-Za-z0-9-]+", 15),
    ("AIza[A-Za-z0-9_-]+", 39),
)


def brute_all(text):
    more = [(m.start(), k, m.end()) for k, (pattern, least) in enumerate(MORE, 3) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(brute(text) + more)


def checked(texts):
    found = scan(texts)
    for i, t in enumerate(texts):
        assert found.get(i, []) == brute_all(t), t


PIECES = ["password", "API_KEY", "apikey", "ſecret", "toKen", "secret", "=", " ", ": ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCDEFGHIJ0123456789", "\n", "é", "f" * 9, "passwd", "eyJhbGci.eyJh.x-y", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "eyJ", ".", "-", "xoxb-", "1234567890", "AIza", "gho_", "-----BEGIN ", "PRIVATE KEY-----"]


@settings(deadline=None, max_examples=300)
@given(some.lists(some.lists(some.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=4))
def test_scan_against_brute_force(texts):
    checked(texts)


@pytest.mark.parametrize("lane, lanes", [(3, 5), (16, 2), (64, 40)])
def test_blocks_and_lanes_do_not_matter(monkeypatch, lane, lanes):
    """Matches longer than a lane and than a block; lanes that stay in a state over many others."""
    rng = np.random.default_rng(lane)
    texts = ["".join(rng.choice(PIECES, 40)) for _ in range(60)] + ["password=" + "a" * 3000 + " f", "f" * 2000, "-----BEGIN " + "A" * 900 + " PRIVATE KEY-----", "eyJ" + "a" * 700 + "." + "b" * 700 + ".c"]
    want = scan(texts)
    monkeypatch.setattr(automaton, "LANE", lane)
    monkeypatch.setattr(automaton, "LANES", lanes)
    assert scan(texts) == want == {i: x for i, t in enumerate(texts) if (x := brute_all(t))}


def test_same_spans_as_re_on_a_table(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    found = scan(texts)
    assert found and found == {i: x for i, t in enumerate(texts) if (x := brute_all(t))}


def test_memory_does_not_follow_the_longest_line():
    import tracemalloc

    scanner = compiled(RULES)
    data = (b"some words without a line feed " * 40_000 + b"token=abcdefgh ") * 4
    scanner.spans(data[:1000])
    tracemalloc.start()
    assert len(scanner.spans(data)) == 4
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_edges():
    checked(["", "\n", "f" * 23, "f" * 24, "AKIA" + "A" * 15, "AKIA" + "A" * 16, "token=12345", "token=123456", "tokentoken = 'abcdef", "password: \"a\"password=abcdefg", "x" * 5000 + "f" * 30, ("password=" + "a" * 9 + "\n") * 50])


def test_more_kinds_are_found():
    text = "k eyJhbGci.eyJh.x-y ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890-a AIza" + "b" * 36
    assert {RULES[k].kind for _, k, _ in scan([text])[0]} >= {"jwt", "github", "private_key", "slack", "google"}


def test_automaton_is_minimal_and_exact():
    rules = ["a[bc]{2,}d?", "cab+"]
    found = Automaton(rules)
    rng = np.random.default_rng(0)
    for _ in range(200):
        text = "".join(rng.choice(list("abcd"), rng.integers(0, 12)))
        s, mask = found.start, 0
        for b in text.encode():
            s = int(found.next[s + found.classes[b]])
            mask |= int(found.accepts[s // found.n_classes])
        assert mask == sum(1 << r for r, x in enumerate(rules) if re.search(x, text))
        whole, back = Walker(anchored(rules[0])), Walker(backwards(shortest(anchored(rules[0]))))
        at, bits = found.ends(text.encode())
        first = re.search(rules[0], text)
        mine = at[bits & 1 == 1].tolist()
        assert bool(mine) == bool(first)
        if first:
            start = back.leftmost(text.encode(), mine[0], 0)
            assert (start, whole.longest(text.encode(), start)) == first.span()
    alone = [len(searching(shortest(anchored(r)))[1]) for r in rules]
    assert len(found.accepts) <= alone[0] * alone[1]
    assert found.accepts[: found.first_accepting // found.n_classes].max() == 0


def test_table(docs, odd, empty):
    for df in (docs, odd):
        got = sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in scan_secrets(df).collect())
        want = []
        for r in df.collect():
            spans = brute(r["text"] or "")
            joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
            want.append((str(r["doc_id"]), *(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
        assert got == sorted(want)
    assert scan_secrets(empty).count() == 0


def test_redaction(odd):
    assert redact("a token=abcdef0 b", scan(["a token=abcdef0 b"])[0]) == "a <assign> b"
    rows = redact_documents(odd).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() == odd.first().asDict().keys()
    assert not scan([r["text"] or "" for r in rows])
    assert sum(r["text"] is None for r in rows) == odd.where("text IS NULL").count()


def test_states_are_few():
    assert len(compiled(RULES).automaton.accepts) < 2500


@pytest.mark.parametrize("bad", ["a)", "(a"])
def test_bad_rules_fail(bad):
    with pytest.raises((ValueError, IndexError)):
        Automaton([bad])
