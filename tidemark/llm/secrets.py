"""Secret scans with one combined automaton.

All rules are compiled to deterministic automata. Joined and minimised, they read the bytes of a batch of texts
once and tell where a shortest match of some rule ends. From there the rule's own automata walk over the bytes
of the match only: backwards to its leftmost start, then forwards to its greatest end. The next match of
the rule begins at that end or later, so spans are leftmost and don't overlap within a kind.

This equals the usual leftmost greedy matching for rules of which a greedy match is the longest and of which a
later start never ends first, as is so for all of ``RULES``. No rule can match a line feed, which ends each text in a batch.
Memory follows the batch and a block of the automaton's, not the longest line.

Null or empty text: no spans. Rows are independent: repeated rows get equal results.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, Walker, anchored, backwards, shortest
from .common import small_batches, texts


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``; of what follows its longest ``head`` there must be ``least`` characters, else the match is dropped (but not what it covers given back)."""

    kind: str
    pattern: str
    head: str = ""
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = "(" + KEYWORDS + ")[\"']?\\x20*[:=]\\x20*[\"']?"

BASE = (
    Rule("assign", ASSIGN + f"{VALUE}+", ASSIGN, 6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Kinds beyond the base: web tokens, private key headers, hosting and chat tokens, map keys.
MORE = (
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
)
RULES = BASE + MORE


class Scanner:
    """The compiled rules. Made once on the driver; tasks get the finished arrays (under a megabyte)."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.automaton = Automaton([r.pattern for r in rules])
        whole = [anchored(r.pattern) for r in rules]
        self.forwards = [Walker(d) for d in whole]
        self.backwards = [Walker(backwards(shortest(d))) for d in whole]
        self.heads = [Walker(anchored(r.head)) if r.head else None for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, kind number, end) in bytes, sorted."""
        at, bits = self.automaton.ends(data)
        out = []
        for k, rule in enumerate(self.rules):
            ends = at[bits >> k & 1 == 1].tolist()
            begin = i = 0
            while i < len(ends):
                start = self.backwards[k].leftmost(data, ends[i], begin)
                if start < 0:
                    i += 1
                    continue
                begin = self.forwards[k].longest(data, start)
                value = self.heads[k].longest(data, start) if self.heads[k] else start
                if begin - value >= rule.least:
                    out.append((start, k, begin))
                i = bisect.bisect_right(ends, begin, i + 1)
        return sorted(out)


@functools.cache
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(batch: list[str], scanner: Scanner | None = None) -> dict[int, list[tuple[int, int, int]]]:
    """Spans by text number for the texts that have any; offsets in code points, sorted by start, then kind as listed."""
    scanner = scanner or compiled(RULES)
    raw = [t.encode() for t in batch]
    data = b"\n".join(raw)
    first = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))[:-1].tolist()
    found: dict[int, list[tuple[int, int, int]]] = {}
    for start, k, end in scanner.spans(data):
        i = bisect.bisect_right(first, start) - 1
        found.setdefault(i, []).append((start - first[i], k, end - first[i]))
    for i, spans in found.items():
        if len(raw[i]) != len(batch[i]):  # matches are ASCII; only what lies before them shifts
            points = np.cumsum(np.frombuffer(raw[i], np.uint8) & 0xC0 != 0x80)
            found[i] = [(int(points[s]) - 1, k, int(points[s]) - 1 + e - s) for s, k, e in spans]
    return found


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], most: int) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans if k < most)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def digester(scanner: Scanner):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found, rows = scan(texts(b), scanner), []
            for i in range(b.num_rows):
                spans = found.get(i, [])
                counts = [sum(k == j for _, k, _ in spans) for j in range(len(BASE))]
                rows.append((*counts, hashlib.sha256(joined(spans, RULES, len(BASE)).encode()).hexdigest(), joined(spans, RULES, len(RULES))))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return digest


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds and all spans for each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(digester(compiled(RULES)), SCHEMA)


def redact(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """The text with each span, overlapping ones together, replaced by the kind that begins first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"<{rules[kind].kind}>"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by its kind; a null text stays null, the other columns stay as they are."""
    at, scanner = docs.columns.index(text_col), compiled(RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, text_col):
            values = b.column(at).to_pylist()
            for i, spans in scan([x or "" for x in values], scanner).items():
                values[i] = redact(values[i], spans)
            columns = list(b.columns)
            columns[at] = pa.array(values, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
