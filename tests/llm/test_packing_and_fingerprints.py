import hashlib
import random
import re
import zlib
from collections import Counter
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import merkle, queries
from tidemark.llm.packing import ByteBpe, SumOfSquares, pack_documents, packer


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")


ODD_TEXTS = ["a  b", "\n\nab \n c", "x ²ab don't we'll. it's", "<|endoftext|> hi <|endoftext|>", "é.è, ß x", "", "  ", "\n", "a\n", "1.5,a. b.. c?!", " lead", "tail ", "\ta b", "日本 語。", "a\xa0 b", "x y z", "foo*** bar,***", "''s 's"]


def test_ids_equal_whole_encoding(tokenizer, docs):
    texts = ODD_TEXTS + [r["text"] or "" for r in docs.collect()]
    rng = random.Random(2)
    texts += ["".join(rng.choice("ab .,'\n\t9é_") for _ in range(60)) for _ in range(300)]
    encode = ByteBpe(queries.tokenizer_path(), most=500)
    got = [x for at in range(0, len(texts), 40) for x in encode(texts[at : at + 40])]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert got == want


def test_frequent_pieces_are_learnt_once(tokenizer, monkeypatch):
    """When the pieces known are too many, those met early stay; a word with marks is made of the word."""
    rng, common = random.Random(5), ["the", "of", "niño", "x", "Straße", "日本", "ªº", "ΐ"]
    batches = [[" ".join(rng.choice(common) + rng.choice(["", ".", ",", "\nand", "!?"]) for _ in range(30)) + " " + "".join(rng.choice("abcdeéß") for _ in range(9)) for _ in range(20)] for _ in range(15)]
    encode, asked, wholes = ByteBpe(queries.tokenizer_path(), most=250), Counter(), Counter()
    learn, whole = encode.learn, encode.whole
    monkeypatch.setattr(encode, "learn", lambda missing: (asked.update(missing), learn(missing))[1])
    monkeypatch.setattr(encode, "whole", lambda text: (wholes.update([text]), whole(text))[1])
    for batch in batches:
        assert list(encode(batch)) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
    assert len(asked) > 300 and {asked[w] for w in common} == {1}
    assert not any(w.strip().isalpha() for w in wholes)


@pytest.mark.parametrize("window", [2048, 64])
def test_pieces(docs, tokenizer, window):
    rows = pack_documents(docs, queries.tokenizer_path(), window=window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    padded = sum(window - sum(p["length"] for p in ps) for ps in by_sequence.values())
    assert padded <= 3 * window  # one window for each of the partitions
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    unique = {i: t for i, t in texts if sum(j == i for j, _ in texts) == 1}
    for i, text in unique.items():
        ids, at = ids_of(tokenizer, text), 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_pieces_of_odd_and_empty(odd, empty):
    rows = pack_documents(odd, queries.tokenizer_path()).collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert pack_documents(empty, queries.tokenizer_path()).count() == 0


def test_placement_minimises_the_sum_of_squares():
    rng, state, window = random.Random(4), SumOfSquares(32), 32
    counts = [0] * 33
    for step in range(400):
        n = rng.randrange(1, 33)
        cost = {}
        for h in range(33 - n):
            if h and not counts[h]:
                continue
            after = counts[:]
            if h:
                after[h] -= 1
            if h + n < window:
                after[h + n] += 1
            cost[h] = sum(x * x for x in after[:32])
        before = sum(x * x for x in counts[:32])
        state.place((step, 0, n, b"", n))
        counts = state.counts.tolist()
        assert sum(x * x for x in counts[:32]) == min(cost.values()), (before, n)


def test_bounded_windows_lose_nothing():
    """Documents that never fit together; the limit on open windows drains them."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["a b c d e"] * 40})
    out = [r for b in packer(queries.tokenizer_path(), 1, 11, 4)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["length"] for r in out) == 40 * 6


def edited(rows):
    """(doc_id, text, edited text, next text) by brute force."""
    order = sorted(rows, key=lambda r: r[1] or "")
    order = sorted(order, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        yield d, t, t[: len(t) - k] + nxt[:k], nxt


def pieces(line):
    out, piece = [], ""
    for c in line:
        if c != "." and len(piece) == 48:
            out.append(piece)
            piece = ""
        piece += c
        if c == ".":
            out.append(piece)
            piece = ""
    return out + [piece] * bool(piece)


def plain_fingerprint(text):
    """The published string, from its definition."""
    sections, h = [[]], lambda parts: hashlib.sha256(b"".join(parts)).digest()
    for line in text.split("\n"):
        leaves = [xxhash.xxh64(x.encode()).digest() for x in pieces(line)]
        sections[-1].append((h(leaves), leaves))
        if line.strip() == "" or h(leaves)[0] < 32:
            sections.append([])
    sections = [s for s in sections if s]
    tops = [h([p for p, _ in s]) for s in sections]
    show = lambda s: ";".join(p.hex()[:16] + "".join(x.hex()[:8] for x in leaves) for p, leaves in s)
    return h(tops).hex() + ":" + "|".join(t.hex()[:16] + ";" + show(s) for t, s in zip(tops, sections))


def plain_likeness(a, b):
    """Dice of the pieces of two texts, no tree."""
    if a == b:
        return 1.0
    x, y = (Counter(p for line in t.split("\n") for p in pieces(line)) for t in (a, b))
    return 2 * (x & y).total() / max(1, x.total() + y.total())


def lines_of(text, runs):
    """Texts of the lines in ``start:end`` runs."""
    lines = text.split("\n")
    return Counter(x for r in runs.split(",") if r for x in lines[int(r.split(":")[0]) : int(r.split(":")[1])])


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints(docs, parts):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), plain_fingerprint(t), plain_fingerprint(e), round(plain_likeness(t, e), 9), round(plain_likeness(t, n), 9)) for d, t, e, n in edited(rows))
    got = merkle.fingerprint_documents(docs, parts=parts).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    lines = lambda t: Counter(t.split("\n"))
    texts = {(str(d), hashlib.sha256(e.encode()).hexdigest(), plain_fingerprint(t)): (t, e) for d, t, e, _ in edited(rows)}
    for r in got:
        t, e = texts[str(r["doc_id"]), r["edited_sha256"], r["fingerprint"]]
        assert lines_of(t, r["changed_lines"]) == lines(t) - lines(e)
        assert lines_of(e, r["edited_changed_lines"]) == lines(e) - lines(t)


def test_fingerprints_of_odd_and_empty(odd, empty):
    assert merkle.fingerprint_documents(odd).count() == odd.count()
    assert merkle.fingerprint_documents(empty).count() == 0


def test_tree():
    tree = lambda t: merkle.Tree(merkle.fingerprint(t))
    a, b = tree("one.\ntwo.\n\nthree."), tree("one.\nTWO.\n\nthree.")
    assert a.root != b.root and tree("one.\ntwo.\n\nthree.").root == a.root
    assert merkle.differences(a, b) == ([1], [1]) and merkle.differences(a, a) == ([], [])
    assert merkle.differences(tree("a\n\nb\n\nc\nd"), tree("b\n\nnew\nnew\n\na\n\nc\nd")) == ([], [2, 3, 4])
    assert 0 < merkle.likeness(a, b) < 1 and merkle.likeness(a, a) == 1
    assert merkle.likeness(tree(""), tree("x")) == 0 and merkle.likeness(tree(""), tree("")) == 1
    assert merkle.runs([]) == "" and merkle.runs([0, 1, 2, 5, 7, 8]) == "0:3,5:6,7:9"
    assert re.fullmatch("[0-9a-f]{64}:[0-9a-f;|]*", merkle.fingerprint("one.\n\ntwo"))
