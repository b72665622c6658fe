"""SimHash near-duplicates: fingerprints within a Hamming distance, found by the general pigeonhole principle.

The 64 bits are grouped into partitions so that correlated bits lie together. Thresholds per
partition (-1 for none) with sum of (threshold + 1) = distance + 1 lose no pair: if every partition
differed by more than its threshold, the whole would differ by more than the distance (Qin et al., "GPH: similarity
search in Hamming space"). Partitioning and thresholds come from a bounded sample of fingerprints
(``SAMPLE`` of them): dynamic programming over the partitions minimises the estimated comparisons
plus entries. They change the cost only, never the links. Entries are rows and dear, while a value that
grows is split again inside its task (see ``link``), so more fingerprints bring more of them to a value, not more entries for each.

Every distinct fingerprint is put under its value in each partition used (an index entry) and under
all values within the threshold (probes); entries with one value meet and are verified on all 64
bits. Copies are one fingerprint. A task holds the entries of one value; values with more than
``HOT`` entries are split again by the bits outside the partition, which loses nothing for the same
reason. Each value gives at most one link for each entry (a spanning forest), not all its pairs.

Null or empty text: fingerprint zero, linked like any other. Rows with a null id count towards
links but not towards ``component_id``; if no row of the component has an id, it is null. Repeated
rows are fine. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, written
from .components import components

SAMPLE = 4096
HOT = 1_000_000
#: Entries of one value that are compared directly; more are split by their other bits first.
DIRECT = 4096


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is set if it is set in more than half of the shingles' hashes; repeats count."""
    words = text.encode().lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return hashed(b" ".join(words), seed)
    values = np.fromiter((hashed(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1)
    return majority(values)


def majority(values: np.ndarray) -> int:
    """The bits set in more than half of the values; none of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 14):
        counts += np.unpackbits(values[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            values = np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def group_bits(sample: np.ndarray, n_parts: int) -> list[list[int]]:
    """Equal groups of bits, grown one bit at a time by mean absolute correlation with the group."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    z = bits - bits.mean(axis=0)
    scale = np.sqrt((z**2).sum(axis=0))
    linked = np.abs(z.T @ z) / np.maximum(np.outer(scale, scale), 1e-9)
    free, groups = list(range(64)), []
    for g in range(n_parts):
        want = 64 // n_parts + (g < 64 % n_parts)
        group = [free.pop(int(np.argmax(linked[np.ix_(free, free)].sum(axis=1))))]
        while len(group) < want:
            group.append(free.pop(int(np.argmax(linked[np.ix_(free, group)].mean(axis=1)))))
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def allocate(cost: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds minimising the summed ``cost[partition][threshold + 1]`` with sum of (threshold + 1) = distance + 1."""
    best = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for k in range(min(distance + 1 - used, len(row) - 1) + 1):
                if used + k not in step or c + row[k] < step[used + k][0]:
                    step[used + k] = (c + row[k], [*chosen, k - 1])
        best = step
    return best[distance + 1]


def plan(sample: np.ndarray, n_all: int, distance: int) -> list[tuple[np.uint64, list[int], int]]:
    """(mask, bits, threshold) of the partitions used."""
    entry_price, most_probes = 800.0, 4096  # an entry is shuffled, sorted and grouped (about 3 us), a candidate only compared (about 4 ns)
    found = None
    pairs = sample[: 1 << 10]
    differ = pairs[:, None] ^ pairs[None, :]
    among = max(1, len(pairs) * (len(pairs) - 1))
    for n_parts in range(1, distance + 2):
        groups = group_bits(sample, n_parts)
        costs = []
        for bits in groups:
            mask = mask_of(bits)
            apart = np.bitwise_count(differ & mask)
            split = [max(0, int((differ & g == 0).sum()) - len(pairs)) / among for g in other_groups(int(mask), distance + 1)]
            row = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(bits), k) for k in range(t + 1))
                met = max(0, int((apart <= t).sum()) - len(pairs)) / among * (n_all - 1)
                while met > DIRECT and sum(split) < 0.9:  # a step of ``link``
                    met *= sum(split)
                # Index entries of one value are compared once a pair, probes with each index entry.
                row.append(n_all * ((0.5 if t == 0 else 1.0) * met + probes * entry_price) if probes <= most_probes else float("inf"))
            costs.append(row)
        total, thresholds = allocate(costs, distance)
        if found is None or total < found[0]:
            found = (total, [(mask_of(b), b, t) for b, t in zip(groups, thresholds) if t >= 0])
    return found[1]


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """A value and a salt to one 64-bit key (the finaliser of splitmix64). Keys that collide only add candidates."""
    x = values + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ENTRY = "key long, mask long, fp long, own boolean"


def entries(partitions: list[tuple[np.uint64, list[int], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p, (mask, bits, threshold) in enumerate(partitions):
                for t in range(threshold + 1):
                    for flips in combinations(bits, t):
                        key = mixed((fp & mask) ^ mask_of(list(flips)), p + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(fp), mask).view(np.int64)), b.column(0), pa.array(np.full(len(fp), t == 0))], ["key", "mask", "fp", "own"])

    return run


def other_groups(mask: int, parts: int) -> list[np.uint64]:
    """The bits outside a mask in so many groups."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask_of(free[i::parts]) for i in range(parts)]


def finer(distance: int):
    """Entries of hot values under each of distance + 1 groups of the other bits: at a distance of at most that, one group is equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, mask, fp = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            for m in np.unique(mask):
                at = np.flatnonzero(mask == m)
                for g, group in enumerate(other_groups(int(m), distance + 1)):
                    k = mixed(mixed(key[at], g + 1) ^ (fp[at] & group), 99)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(len(at), m | group).view(np.int64)), b.column(2).take(pa.array(at)), b.column(3).take(pa.array(at))], ["key", "mask", "fp", "own"])

    return run


class Forest:
    """Links among the members of one value; ``find`` with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self, members: list[int]) -> np.ndarray:
        return np.fromiter(map(self.find, members), np.int64, len(members))


def link(fp: np.ndarray, own: np.ndarray, distance: int, forest: Forest, at: np.ndarray, mask: int = 0, block: int = 1024, height: int = 128) -> None:
    """Join all pairs ``at`` within the distance of which one is an index entry; large sets are split by the other bits first.

    Pairs already joined over others aren't joined again, so a dense set costs its comparisons only. ``height`` rows at
    a time meet ``block`` others, so that what a step makes stays in the processor's cache.
    """
    members = at[np.argsort(~own[at], kind="stable")]
    names = members.tolist()
    known = forest.roots(names)
    if (known == known[0]).all():
        return
    free = 64 - int(mask).bit_count()
    if len(at) > DIRECT and free > distance:
        for group in other_groups(mask, distance + 1):
            value = fp[at] & group
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for part in np.split(at[order], cuts):
                if len(part) > 1:
                    link(fp, own, distance, forest, part, mask | int(group), block, height)
        return
    values, n_own, joined = fp[members], int(own[members].sum()), 0
    for start in range(0, n_own, height):
        rows = values[start : min(start + height, n_own)]
        for lower in range(start, len(values), block):
            others = values[lower : lower + block]
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(rows[:, None] ^ others) <= distance), len(others))
            i, j = i + start, j + lower
            apart = (j > i) & (known[i] != known[j])
            i, j = i[apart], j[apart]
            while len(i):
                for a, c in zip(i[:block].tolist(), j[:block].tolist()):
                    forest.join(names[a], names[c])
                joined += min(block, len(i))
                i, j = i[block:], j[block:]
                if joined >= block:
                    known, joined = forest.roots(names), 0
                    if (known == known[0]).all():
                        return
                    apart = known[i] != known[j]
                    i, j = i[apart], j[apart]


def verify(distance: int):
    """Entries sorted by key to links (larger, smaller fingerprint), one key in memory at a time."""

    def unique_own(fp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, back = np.unique(fp, return_inverse=True)
        out = np.zeros(len(values), bool)
        np.logical_or.at(out, back, own)
        return values, out

    def of_group(fp: np.ndarray, own: np.ndarray, mask: int, out: list) -> None:
        values, mine = unique_own(fp, own)
        if len(values) < 2:
            return
        if len(values) == 2:
            if int(values[0] ^ values[1]).bit_count() <= distance and mine.any():
                out.append((int(values[0]), int(values[1])))
            return
        forest = Forest(len(values))
        link(values, mine, distance, forest, np.arange(len(values)), mask)
        for i in range(len(values)):
            root = forest.find(i)
            if root != i:
                out.append((int(values[root]), int(values[i])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in with_end(batches):
            columns = None if b is None else [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64), b.column(3).to_numpy(zero_copy_only=False)]
            if held is not None:
                columns = held if columns is None else [np.concatenate(x) for x in zip(held, columns)]
            held = None
            if columns is None or not len(columns[0]):
                continue
            key, mask, fp, own = columns
            cuts = np.flatnonzero(np.diff(key)) + 1
            if b is not None:  # the last key may go on
                last = int(cuts[-1]) if len(cuts) else 0
                held = [x[last:] for x in columns]
                cuts = cuts[:-1]
                if not last:
                    continue
                end = last
            else:
                end = len(key)
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [end]))
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(ends - starts > 1).tolist():
                s, e = int(starts[i]), int(ends[i])
                of_group(fp[s:e], own[s:e], int(mask[s]), out)
            if out:
                a = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, 0])), pa.array(np.ascontiguousarray(a[:, 1]))], ["u", "v"])

    return run


def with_end(batches):
    yield from batches
    yield None


def near_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Links (u, v) that connect every two fingerprints within the distance, directly or over others."""
    n_all = distinct.count()
    chosen = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n_all))) < SAMPLE).limit(2 * SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    if len(chosen) < 2:
        chosen = np.arange(2, dtype=np.uint64)
    now = distinct.mapInArrow(entries(plan(np.sort(chosen), n_all, distance)), ENTRY)
    cool: list[DataFrame] = []
    for _ in range(4):
        hot = now.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key")
        if hot.isEmpty():
            break
        hot = written(hot, "hot")
        cool.append(now.join(hot, "key", "left_anti"))
        now = now.join(hot, "key", "left_semi").select("key", "mask", "fp", "own").mapInArrow(finer(distance), ENTRY)
    for t in cool:
        now = now.unionByName(t)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return now.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(verify(distance), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct.select("fp"), distance))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.select("fp", "root").join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
