"""Removal of repeated substrings by a distributed merge sort of suffixes that is aware of common prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Not every suffix
need be sorted: a suffix is sampled where the hash of its first ``GRAM`` bytes is least among the
starts of such grams in some string of ``length`` bytes. The choice depends on that string alone, so two equal strings
hold a sampled suffix at the same place, and comparing what lies around equal samples finds every repeat.

1. Samples whose gram occurs once are dropped. A task drops what it can itself: grams seen twice in
   a batch need no exchange but one row that tells the others.
2. Tasks cut the kept suffixes (``length`` bytes to the right, the rest of the window to the left),
   sort them into runs, resolve contexts that are wholly equal within the run, front-code the rest
   (common prefix with the suffix before, and the tail) and exchange them by splitters.
3. Each range (``RANGE`` entries or so, so their number follows the data) merges its runs with a loser tree that compares
   by known common prefixes and looks at bytes only beyond them. The common prefixes of neighbours in merged order, and those in the
   order of what lies to the left, decide which entries hold one string; the oldest keeps it. A large group is
   resolved in steps, between which only entries that a later one can need are held.
4. A gram in more than ``HOT`` entries isn't left to one task: each run keeps the oldest place of every string around
   it, and these meet by a 128-bit hash of the string, one row for each ``STRINGS`` of a run at most.
5. The spans meet their texts again and are cut out.

Order of documents: id (nulls last), then a hash of the row. Rows equal in id and text count as one
document. Null text counts as empty. Texts shorter than ``length`` keep everything. Very long texts
are sampled in slices that overlap by a window.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, release, small_batches, texts, written

GRAM = 32
SLICE = 1 << 20
RUN = 200_000
SPANS = 200_000
#: Entries of a range, and of a group held before what no later entry needs is dropped.
RANGE = 200_000
GROUP = 50_000
#: A gram expected in more entries than this isn't sorted into a range: its strings are dealt by their own hashes.
HOT = 200_000
#: Strings around hot grams that a task holds at once.
STRINGS = 200_000
#: One sample in so many carries its gram; so many are used at most to choose the ranges.
PICK = 64
PICKED = 40_000
#: What a row of the exchange is, where it isn't a run of a range.
SPAN_HERE, HOT_STRING = -1, -2
LAST = (1 << 63) - 1


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    k = 1
    while 2 * k <= width:
        values = best(values[:-k], values[k:])
        k *= 2
    return best(values[: len(values) - (width - k)], values[width - k :]) if k < width else values


def gram_hashes(data: np.ndarray) -> np.ndarray:
    h, k, power = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    while k < GRAM:
        h = h[:-k] * power + h[k:]
        power, k = np.uint64((int(power) * int(power)) & (2**64 - 1)), 2 * k
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def samples(raw: bytes, length: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the sampled suffixes. ``ends``: ends of texts laid one after another; grams across them don't count."""
    data, width = np.frombuffer(raw, np.uint8), length - GRAM + 1
    found, hashes = [], []
    for start in range(0, max(1, len(data)), SLICE):
        part = data[start : start + SLICE + length - 1]
        if len(part) < length:
            break
        h = gram_hashes(part)
        if ends is not None:
            for e in ends[(ends > start) & (ends < start + len(part))]:
                h[max(0, e - start - GRAM + 1) : e - start] = np.uint64(2**64 - 1)
        least = sliding(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero((sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h) & (h != np.uint64(2**64 - 1)))
        found.append(at + start)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


def row_hash(order: Column, text: Column) -> Column:
    return F.xxhash64(order, F.md5(text.cast("binary")))


def sample_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, most=SLICE):
            raw = [t.encode() for t in texts(b)]
            ends = np.cumsum([len(x) for x in raw])
            at, h = samples(b"".join(raw), length, ends)
            if not len(at):
                continue
            doc = np.searchsorted(ends, at, side="right")
            keys = b.column(0).to_numpy(zero_copy_only=False)[doc]
            place = at - np.concatenate(([0], ends))[doc]
            _, first, back, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            # 0: alone in this batch. 1: speaks for a gram that the batch repeats. 2: another of those.
            kind = np.where(counts[back] == 1, 0, np.where(np.arange(len(h)) == first[back], 1, 2))
            drawn = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
            whole = b"".join(raw)
            grams = [whole[i : i + GRAM] if d else None for i, d in zip(at.tolist(), ((drawn >> np.uint64(33)) % np.uint64(PICK) == 0).tolist())]
            columns = [pa.array(h.view(np.int64)), pa.array(keys), pa.array(place.astype(np.int64)), pa.array(kind.astype(np.int32)), pa.array(grams, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc", "place", "kind", "gram"])

    return run


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, spokesmen first: those alone in their batch of which a neighbour has the same gram."""
    held = None
    for b in then_none(batches):
        columns = None if b is None else [*(c.to_numpy(zero_copy_only=False) for c in b.columns), np.zeros(b.num_rows, bool)]
        if columns is not None and not len(columns[0]):
            continue
        if held is not None:
            columns = held if columns is None else [np.concatenate(x) for x in zip(held, columns)]
        if columns is None:
            continue
        h, doc, place, kind, back = columns
        n = len(h) if b is None else len(h) - 1
        same = h[1:] == h[:-1]
        hit = np.concatenate(([False], same)) | np.concatenate((same, [False])) | back
        keep = np.flatnonzero(hit[:n] & (kind[:n] == 0))
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(place[keep])], ["doc", "place"])
        held = [h[-1:], doc[-1:], place[-1:], kind[-1:], hit[-1:]]


def then_none(batches):
    yield from batches
    yield None


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(common prefix with the key before, tails, lengths of tails) of sorted keys."""
    shared = np.zeros(len(keys), np.uint8)
    for i in range(1, len(keys)):
        shared[i] = common(keys[i - 1], keys[i])
    tails = [k[s:] for k, s in zip(keys, shared.tolist())]
    return shared, b"".join(tails), np.array([len(t) for t in tails], np.uint8)


def segment(entries: list[tuple]) -> bytes:
    """Sorted (right, left reversed, order, doc, place) as one front-coded block."""
    shared, tails, sizes = front_coded([e[0] for e in entries])
    lefts = [e[1] for e in entries]
    numbers = np.array([(e[2], e[3], e[4]) for e in entries], np.int64)
    head = np.array([len(entries), len(tails)], np.int64).tobytes()
    return b"".join([head, shared.tobytes(), sizes.tobytes(), tails, np.array([len(x) for x in lefts], np.uint8).tobytes(), numbers.tobytes(), *lefts])


class Run:
    """A decoded segment: the current key, its common prefix with the one before, and what belongs to it."""

    def __init__(self, block: bytes):
        n, n_tails = np.frombuffer(block, np.int64, 2).tolist()
        at = 16
        self.shared = block[at : at + n]
        sizes = block[at + n : at + 2 * n]
        at += 2 * n
        self.tails, self.tail_at, self.sizes = block[at : at + n_tails], 0, sizes
        at += n_tails
        self.left_sizes = block[at : at + n]
        at += n
        self.numbers = np.frombuffer(block[at : at + 24 * n], np.int64).reshape(n, 3).tolist()
        self.lefts, self.left_at = block[at + 24 * n :], 0
        self.n, self.i, self.key, self.left = n, -1, b"", b""

    def step(self) -> int:
        """To the next key; its common prefix with the one before, or -1 at the end."""
        self.i += 1
        i = self.i
        if i >= self.n:
            return -1
        shared, size = self.shared[i], self.sizes[i]
        self.key = self.key[:shared] + self.tails[self.tail_at : self.tail_at + size]
        self.tail_at += size
        self.left = self.lefts[self.left_at : self.left_at + self.left_sizes[i]]
        self.left_at += self.left_sizes[i]
        return shared


def merged(runs: list[Run]) -> Iterator[tuple[int, tuple]]:
    """(common prefix with the entry before, entry) of all runs in order.

    A loser tree whose nodes keep the loser and its common prefix with the last winner. Of two
    that differ in it the longer wins unseen; only equal ones are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    loser, prefix = [0] * k, [-1] * k

    def better(a: int, pa_: int, b: int, pb: int) -> tuple[int, int, int, int]:
        """(winner, its prefix, loser, its prefix)"""
        if pa_ != pb:
            return (a, pa_, b, pb) if pa_ > pb else (b, pb, a, pa_)
        if pa_ < 0:
            return a, pa_, b, pb
        x, y = runs[a].key, runs[b].key
        c = common(x, y, pa_)
        return (a, pa_, b, c) if x[c:] <= y[c:] else (b, pb, a, c)

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            r = node - k
            return (r, runs[r].step()) if r < len(runs) else (0, -1)
        w, pw, lo, pl = better(*build(2 * node), *build(2 * node + 1))
        loser[node], prefix[node] = lo, pl
        return w, pw

    w, pw = build(1)
    while pw >= 0:
        run = runs[w]
        yield pw, (run.key, run.left, *run.numbers[run.i])
        pw = run.step()
        node = (w + k) >> 1
        while node:
            p = prefix[node]
            if p > pw:
                loser[node], prefix[node], w, pw = w, pw, loser[node], p
            elif p == pw and p >= 0:
                w, pw, loser[node], prefix[node] = better(w, pw, loser[node], p)
            node >>= 1


def resolve(group: list[tuple], prefixes: list[int], length: int, out: list) -> list[int]:
    """Spans (order, doc, start, stop) of a group of entries in merged order, ``prefixes`` being the common prefix of each with the one before.

    A string that starts ``a`` bytes before the gram is one run of common prefixes of ``length - a`` or more to the
    right, met with one run of ``a`` or more in the order of what lies to the left. Of such a class all but the
    oldest entry lose it. Returns the entries that are oldest in some class: no later entry needs the others.
    """
    n = len(group)
    if n <= 24:
        first = set(range(n))
        for j in range(1, n):
            right = length
            for i in range(j - 1, -1, -1):
                right = min(right, prefixes[i + 1])
                if right + len(group[j][1]) < length:
                    break
                left = common(group[i][1], group[j][1])
                if right + left >= length and group[i][2:] != group[j][2:]:
                    young = i if group[i][2:] > group[j][2:] else j
                    _, _, order, doc, place = group[young]
                    out.append((order, doc, place - left, place + right))
        return sorted(first)
    by_age = sorted(range(n), key=lambda i: group[i][2:])
    same = np.zeros(n, np.int64)  # rows stored twice are one
    for k in range(1, n):
        same[k] = same[k - 1] + (group[by_age[k]][2:] != group[by_age[k - 1]][2:])
    age = np.empty(n, np.int64)
    age[by_age] = same
    to_right = np.array(prefixes, np.int64)
    to_right[0] = 0
    by_left = sorted(range(n), key=lambda i: group[i][1])
    to_left = np.array([0] + [common(group[x][1], group[y][1]) for x, y in zip(by_left, by_left[1:])], np.int64)
    place_left = np.empty(n, np.int64)
    place_left[by_left] = np.arange(n)
    n_right, n_left = (np.array([len(e[k]) for e in group], np.int64) for k in (0, 1))
    # Classes change where ``a`` passes one of these; in between they stay the same.
    width = length - GRAM + 1
    cuts = np.unique(np.concatenate(([0], length - to_right, to_left + 1, length - n_right, n_left + 1)))
    cuts = cuts[(cuts >= 0) & (cuts < width)].tolist()
    oldest = np.zeros(n, bool)
    least, most = np.full(n, width), np.full(n, -1)  # each string covers the gram, so what an entry loses is one span
    for low, high in zip(cuts, [*(c - 1 for c in cuts[1:]), width - 1]):
        whole = np.flatnonzero((n_right >= length - low) & (n_left >= low))
        if not len(whole):
            continue
        rights = np.cumsum(to_right < length - low)
        lefts = np.cumsum(to_left < low)[place_left]
        key = rights[whole] * n + lefts[whole]
        order = np.lexsort((age[whole], key))
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        lead = age[whole][order][new][np.cumsum(new) - 1]
        oldest[whole[order[new]]] = True
        lost = whole[order[age[whole][order] != lead]]
        least[lost] = np.minimum(least[lost], low)
        most[lost] = high
    for i in np.flatnonzero(most >= 0).tolist():
        e = group[i]
        out.append((e[2], e[3], e[4] - int(most[i]), e[4] - int(least[i]) + length))
    return np.flatnonzero(oldest).tolist()


def kept_of(group: list[tuple], prefixes: list[int], keep: list[int]) -> tuple[list[tuple], list[int]]:
    """Some entries of a group with their common prefixes: the least of those passed over."""
    out, at = [], 0
    for i in keep:
        out.append(min(prefixes[at + 1 : i + 1], default=0))
        at = i
    return [group[i] for i in keep], out


def whole_window(e: tuple, length: int, out: list) -> None:
    """The span of an entry that equals an earlier one on both sides: each of its starts also starts earlier."""
    if len(e[0]) + len(e[1]) >= length:
        out.append((e[2], e[3], e[4] - len(e[1]), e[4] + len(e[0])))


def compacted(out: list[tuple]) -> list[tuple]:
    """Spans with those of one document that overlap or touch made one."""
    out.sort()
    kept: list[tuple] = []
    for x in out:
        if kept and x[0] == kept[-1][0] and x[1] == kept[-1][1] and x[2] <= kept[-1][3]:
            if x[3] > kept[-1][3]:
                kept[-1] = (*kept[-1][:3], x[3])
        else:
            kept.append(x)
    return kept


SPAN = "doc long, row long, start long, stop long"


def exchange_rows(length: int, splitters: list[bytes], hot: frozenset[bytes], tasks: int):
    """Rows for ``merge_rows``: runs of ranges, ranges in order over ``tasks``, and spans and strings that are merely passed on."""
    width, ranges = length - GRAM + 1, len(splitters) + 1
    most_strings, most_spans = STRINGS, SPANS

    def strings(entries: list[tuple], out: list) -> Iterator[dict[bytes, tuple]]:
        """The oldest place of each string of ``length`` bytes around hot grams, ``STRINGS`` or so at once; the others are spans."""
        first: dict[bytes, tuple] = {}
        for right, left, order, doc, place in entries:
            window, before, lost = left[::-1] + right, len(left), []
            for at in range(len(window) - length + 1):
                key, here = xxhash.xxh3_128_digest(window[at : at + length]), (order, doc, place - before + at)
                was = first.setdefault(key, here)
                if was < here:
                    lost.append(here[2])
                elif was > here:
                    first[key] = here
                    out.append((*was, was[2] + length))
            if lost:  # they all cover the gram
                out.append((order, doc, lost[0], lost[-1] + length))
            if len(first) >= most_strings or len(out) >= most_spans:
                yield first
                first = {}
        yield first

    def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.binary()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["task", "part", "block", "doc", "row", "start", "stop"])

    def passing(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield from batch([(x[1] % tasks, SPAN_HERE, None, *x) for x in compacted(out)])
        out.clear()

    def flush(entries: list[tuple]) -> Iterator[pa.RecordBatch]:
        entries.sort()
        out: list[tuple] = []
        kept: list[tuple] = []
        for e in entries:
            if kept and kept[-1][0] == e[0] and kept[-1][1] == e[1]:
                if kept[-1] != e:  # equal for a row stored twice
                    whole_window(e, length, out)
            else:
                kept.append(e)
        if hot:
            for found in strings([e for e in kept if e[0][:GRAM] in hot], out):
                yield from batch([(place[1] % tasks, HOT_STRING, h, *place, None) for h, place in found.items()])
                if len(out) >= most_spans:
                    yield from passing(out)
            kept = [e for e in kept if e[0][:GRAM] not in hot]
        yield from passing(out)
        parts, at = [], 0
        while at < len(kept):
            part = bisect_right(splitters, kept[at][0][:GRAM])
            end = bisect_left(kept, splitters[part], at, key=lambda e: e[0][:GRAM]) if part < len(splitters) else len(kept)
            parts.append((part, segment(kept[at:end])))
            at = end
        yield from batch([(p * tasks // ranges, p, x, None, None, None, None) for p, x in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple] = []
        for b in small_batches(batches):
            for order, row, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b), b.column(3).to_pylist()):
                raw = text.encode()
                for at in set(places):
                    entries.append((raw[at : at + length], raw[max(0, at - width + 1) : at][::-1], order, row, at))
                    if len(entries) >= RUN:
                        yield from flush(entries)
                        entries = []
        if entries:
            yield from flush(entries)

    return run


def merge_rows(length: int):
    most_held, most_spans = GROUP, SPANS

    def merge(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[tuple] = []
        prefixes: list[int] = []
        limit, passed = most_held, length  # ``passed``: least common prefix since the last entry held

        def done() -> Iterator[pa.RecordBatch]:
            if len(out) > most_spans:
                yield spans_of(out)
                out.clear()

        for prefix, entry in merged([Run(b) for b in blocks]):
            if prefix < GRAM and group:
                if len(group) > 1:
                    resolve(group, prefixes, length, out)
                    yield from done()
                group, prefixes, limit, passed = [], [], most_held, length
            group.append(entry)
            prefixes.append(min(prefix, passed))
            passed = length
            if len(group) >= limit:
                keep = resolve(group, prefixes, length, out)
                passed = min(prefixes[keep[-1] + 1 if keep else 0 :], default=length)
                group, prefixes = kept_of(group, prefixes, keep)
                limit = max(most_held, 2 * len(group))
                yield from done()
        if len(group) > 1:
            resolve(group, prefixes, length, out)
        if out:
            yield spans_of(out)

    def spans_of(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*compacted(out))]
        return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.binary()), *columns], ["block", "doc", "row", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by part, those that only pass first."""
        part, blocks = None, []
        for b in then_none(batches):
            if b is not None:
                passing = pc.less(b.column(0), 0)
                if pc.any(passing).as_py():
                    yield pa.RecordBatch.from_arrays(b.filter(passing).columns[1:], ["block", "doc", "row", "start", "stop"])
                b = b.filter(pc.invert(passing))
            rows = [(None, None)] if b is None else zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            for p, block in rows:
                if p != part and blocks:
                    yield from merge(blocks)
                    blocks = []
                part = p
                if block is not None:
                    blocks.append(block)

    return run


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to the digest of what is left."""
    for b in small_batches(batches):
        rows = []
        for text, starts, stops in zip(texts(b), b.column(2).to_pylist(), b.column(3).to_pylist()):
            raw = text.encode()
            spans = union_of(list(zip(starts or (), stops or ())))
            kept, at = [], 0
            for s, e in spans:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            left = b"".join(kept)
            rows.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, start, stop): byte spans that go, overlapping ones among them, for each document; ``doc`` and ``row`` are as in ``keyed``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = keyed(docs, id_col, text_col)
    sampled_rows = written(base.select("row", "text").mapInArrow(sample_rows(length), "h long, doc long, place long, kind int, gram binary"), "samples")
    alone = sampled_rows.where("kind < 2").select("h", "doc", "place", "kind").repartition(parts, "h").sortWithinPartitions("h", F.desc("kind")).mapInArrow(repeated, "doc long, place long")
    wanted = written(alone.unionByName(sampled_rows.where("kind > 0").select("doc", "place")), "suffixes")
    free_shuffles(spark)
    # Some kept grams, at most about ``PICKED``, tell the ranges, and which grams are too frequent for one of them.
    total = wanted.count()
    thin = F.pmod(F.xxhash64("place", "doc"), F.lit(max(1, total // (PICK * PICKED)))) == 0
    picked = sampled_rows.where(F.col("gram").isNotNull()).where(thin).select("doc", "place", "gram")
    grams = sorted(bytes(r["gram"]) for r in picked.join(wanted, ["doc", "place"], "left_semi").select("gram").collect())
    release(sampled_rows)
    splitters, hot = ranges_of(grams, total, parts)
    places = wanted.groupBy(F.col("doc").alias("row")).agg(F.collect_list("place").alias("places"))
    rows = base.join(places.hint("shuffle_hash"), "row").select("doc", "row", "text", "places")
    tasks = max(parts, (len(splitters) + 1) // 2)
    runs = written(rows.mapInArrow(exchange_rows(length, splitters, hot, tasks), "task int, part int, block binary, doc long, row long, start long, stop long"), "runs")
    free_shuffles(spark)  # the texts' shuffle goes before the runs' comes
    release(wanted)
    dealt = runs.repartitionById(tasks, "task").drop("task").sortWithinPartitions("part")
    found = written(dealt.mapInArrow(merge_rows(length), f"block binary, {SPAN}"), "spans")
    free_shuffles(spark)
    release(runs)
    spans = found.where("stop IS NOT NULL").select("doc", "row", "start", "stop")
    if hot:
        string = found.where("stop IS NULL").select("block", "doc", "row", "start")
        oldest = string.groupBy("block").agg(F.min(F.struct("doc", "row", "start")).alias("first"))
        later = string.join(oldest, "block").where(F.struct("doc", "row", "start") != F.col("first"))
        spans = spans.unionByName(later.select("doc", "row", "start", (F.col("start") + length).alias("stop")))
    return spans


def ranges_of(grams: list[bytes], total: int, parts: int) -> tuple[list[bytes], frozenset[bytes]]:
    """(splitters, hot grams) from a sorted sample of the grams of ``total`` entries: ranges of about ``RANGE`` entries, two for each task at least."""
    counts: dict[bytes, int] = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    hot = frozenset(g for g, n in counts.items() if n > 2 and n * total > HOT * len(grams))
    cold = [g for g in grams if g not in hot]
    ranges = max(2 * parts, -(-total // RANGE))
    return sorted({cold[len(cold) * i // ranges] for i in range(1, ranges)}) if cold else [], hot


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, row, text): ``doc`` orders documents, ``row`` tells rows with one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), order.alias("doc"), row_hash(order, text).alias("row"), text.alias("text"))


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    spans = repeated_spans(docs, length, id_col, text_col)
    by_doc = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("x")).select("doc", "row", F.col("x.start").alias("starts"), F.col("x.stop").alias("stops"))
    rows = keyed(docs, id_col, text_col).join(by_doc.hint("shuffle_hash"), ["doc", "row"], "left").select("doc_id", "text", "starts", "stops")
    return rows.mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
