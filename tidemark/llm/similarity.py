"""Near-duplicates by the exact Jaccard similarity of their five-word shingles, with candidates from SimHash.

1. A text is its set of shingles (ASCII lower case, 64-bit hashes); texts with one set are one class.
2. Each class has ``SEEDS`` SimHash fingerprints of its two-word shingles. The components of the links that ``simhash.near_links``
   finds at ``DISTANCE`` bits are groups: any two fingerprints within the distance share one, and a class is in one group of each seed only.
   Of the pairs at 0.8 or more in 20,000 documents (1,443 of them, edits scattered or at an end) every one was within
   the distance in one of the three; two-word shingles lie closer than longer ones, and what they bring too much is compared and refused.
3. Within a group the class with the smallest id is the hub, and the others are compared with it on their sets. Who is
   similar goes, the hub is done with this group, and the rest choose again. So a large group costs a
   comparison for each member, not for each pair. What is left after ``ROUNDS`` is compared by blocks of the group where fingerprints are within the distance.

Whoever goes is similar to a class of a smaller id, directly one that stays or the next in such a
chain; no two classes that stay and have fingerprints within the distance are similar. Texts of fewer than five words are one
shingle; texts without words are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, release, small_batches, texts, written
from .components import components
from .simhash import majority, mixed, near_links, with_end

SEEDS = 3
DISTANCE = 8
ROUNDS = 4
SALTS = 32
CELL = 16 << 20
LAST = (1 << 63) - 1


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, of all words together where there are fewer, repeats included."""
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    found = mixed(words[:n], size)
    for i in range(1, size):
        found = mixed(found ^ words[i : n + i], size + i)
    return found


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingles(word_hashes(text), shingle))


def seeded_fingerprints(words: np.ndarray) -> list[int]:
    pairs = shingles(words, 2)
    return [majority(mixed(pairs, 1000 + s)) for s in range(SEEDS)]


def class_of(values: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(values.tobytes())


def marks(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            words = [word_hashes(t) for t in texts(b)]
            prints = np.array([seeded_fingerprints(w) for w in words], np.uint64).view(np.int64)
            offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * SEEDS)
            node = np.array([class_of(np.unique(shingles(w, shingle))) for w in words], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.ListArray.from_arrays(offsets, pa.array(prints.ravel()))], ["doc_id", "text_hash", "node", "fps"])

    return run


def sets_of(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in texts(b)], pa.binary())], ["node", "shingles"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def compared(percent: int):
    """(node, shingles, others) to the nodes that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(near, pa.bool_()))], ["node"])

    return run


def similar_nodes(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Nodes of ``pairs`` (node, hub) that are similar to their hub. Hubs are dealt over ``SALTS`` tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    hubs = salted.select("hub", "salt").distinct().join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("others")), "hub")
    both = salted.join(sets, "node").join(hubs, ["hub", "salt"]).select("node", "shingles", "others")
    return both.mapInArrow(compared(percent), "node long").distinct()


def cells(percent: int):
    """Members sorted by (key, low, high) to the nodes similar to one before them; a cell holds two blocks of a group (or one, met with itself)."""

    def of_cell(low: int, high: int, members: list[tuple]) -> list[int]:
        members.sort(key=lambda m: m[1:3])
        block, fp = (np.array([m[i] for m in members]) for i in (0, 3))
        sets, gone = [np.frombuffer(m[4], np.uint64) for m in members], []
        for j in range(1, len(members)):
            near = np.bitwise_count((fp[:j] ^ fp[j]).view(np.uint64)) <= DISTANCE
            if low != high:
                near &= block[:j] != block[j]
            if any(similar(sets[i], sets[j], percent) for i in np.flatnonzero(near).tolist()):
                gone.append(members[j][2])
        return gone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in with_end(batches):
            rows = [(None,) * 8] if b is None else zip(*(c.to_pylist() for c in b.columns))
            for key, low, high, *member in rows:
                if (key, low, high) != at:
                    gone = of_cell(*at[1:], held) if len(held) > 1 else []
                    if gone:
                        yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], ["node"])
                    at, held = (key, low, high), []
                held.append(tuple(member))

    return run


def compared_within(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Nodes similar to one of smaller id in their group. A group is cut into blocks of about ``CELL`` bytes of sets, and each task compares two blocks; no pairs are made."""
    sizes = sets.select("node", F.octet_length("shingles").alias("bytes"))
    sized = left.join(sizes, F.col("x.node") == sizes["node"]).groupBy("key").agg(F.ceil(F.sum("bytes") / CELL).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1 AND blocks > 0").drop("n")
    members = left.join(sized, "key").select("key", F.col("x.order").alias("order"), F.col("x.node").alias("member"), "fp", "blocks")
    dealt = members.join(sets, F.col("member") == F.col("node"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "order", "member", "fp", "shingles")
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(cells(percent), "node long").distinct()


def grouped(classes: DataFrame) -> DataFrame:
    """(key, fp, x): the classes ``x`` (order, node) of each group with more than one; a class is in one group of each seed.

    The links of all seeds are one graph, whose nodes are hashes of seed and fingerprint; hashes that collide only add candidates.
    """
    name = lambda s, fp: F.xxhash64(s, fp)
    links = []
    for s in range(SEEDS):
        links.append(written(near_links(classes.select(F.col("fps")[s].alias("fp")).distinct(), DISTANCE), "links"))
        free_shuffles(classes.sparkSession)
    edges = reduce(DataFrame.unionByName, (t.select(*(name(F.lit(s), c).alias(c) for c in ("u", "v"))) for s, t in enumerate(links)))
    roots = components(edges)
    release(*links)
    members = classes.select(F.struct(F.col("row.order").alias("order"), "node").alias("x"), F.posexplode("fps").alias("seed", "fp")).select(name("seed", "fp").alias("name"), "fp", "x")
    found = members.join(roots.hint("shuffle_hash"), F.col("name") == F.col("node"), "left").select(F.coalesce("root", "name").alias("key"), "fp", "x")
    shared = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return found.join(shared.hint("shuffle_hash"), "key", "left_semi")


def first_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash): the row with the smallest id (nulls last) of each class that stays; ``text_hash`` is xxhash64 of the text."""
    spark = docs.sparkSession
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    marked = written(hashed.mapInArrow(marks(shingle), "doc_id long, text_hash long, node long, fps array<long>"), "marks")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("order"), "text_hash", "doc_id"))
    classes = written(marked.groupBy("node").agg(first.alias("row"), F.first("fps").alias("fps")), "classes")
    free_shuffles(spark)
    release(marked)
    left = written(grouped(classes), "groups")
    free_shuffles(spark)
    wanted = classes.join(left.select("x.node").distinct().hint("shuffle_hash"), "node", "left_semi").select("node", F.col("row.text_hash").alias("text_hash"), F.col("row.doc_id").alias("_id"))
    chosen = hashed.join(wanted.hint("shuffle_hash"), (hashed["text_hash"] == wanted["text_hash"]) & hashed["doc_id"].eqNullSafe(wanted["_id"])).select("node", "text")
    sets = written(chosen.mapInArrow(sets_of(shingle), "node long, shingles binary").dropDuplicates(["node"]), "shingles")
    free_shuffles(spark)
    gone: list[DataFrame] = []
    for _ in range(ROUNDS):
        hubs = left.groupBy("key").agg(F.min("x").alias("hub"))
        met = left.join(hubs, "key").where("x <> hub")
        pairs = written(met.select("x.node", F.col("hub.node").alias("hub")).distinct(), "pairs")
        if pairs.isEmpty():
            release(pairs)
            break
        gone.append(written(similar_nodes(pairs, sets, percent), "similar"))
        # A class left alone in its group meets nobody in the next round.
        rest = written(met.select("key", "fp", "x").join(gone[-1], F.col("x.node") == F.col("node"), "left_anti"), "keys")
        release(left, pairs)
        left = rest
        free_shuffles(spark)
    else:
        gone.append(written(compared_within(left, sets, percent), "similar"))
    stay = classes.select("node", "row")
    if gone:
        stay = stay.join(reduce(DataFrame.unionByName, gone), "node", "left_anti")
    kept = written(stay.select("row.doc_id", "row.text_hash"), "firsts")
    release(classes, sets, left, *gone)
    return kept
