"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A paragraph is a line. Its leaves are pieces of at most ``PIECE`` characters that end at a full
stop, so that a change moves boundaries only up to the next stop or line. A section is a run of
paragraphs that ends after a blank line or where the paragraph's own hash says so (one in eight),
so that inserting a paragraph doesn't move the sections after it. Leaf: 64-bit hash of the piece;
node: SHA-256 of the children's hashes; root: SHA-256 of the sections' hashes.

The fingerprint holds the whole tree, so it alone can be walked: ``root:section|section``, a section
being its hash and its paragraphs with ``;`` between them, a paragraph its hash and those of its leaves. The
root has all 64 hexadecimal digits, sections and paragraphs the first 16 of theirs, leaves 8. Equal texts have
equal roots. ``likeness`` and ``differences`` walk two fingerprints from the root and leave out branches with
equal hashes; a paragraph or section that only moved is no difference.

Null text counts as empty: one section, one empty paragraph, no leaf.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

PIECE = 48
PIECES = re.compile(rf"[^\n.]{{1,{PIECE}}}\.?|\.")


def node(children: bytes) -> bytes:
    return hashlib.sha256(children).digest()


def fingerprint(text: str) -> str:
    leaf = xxhash.xxh64_digest
    sections: list[tuple[bytes, str]] = []
    open_section: list[tuple[bytes, str]] = []

    def close() -> None:
        h = node(b"".join(x for x, _ in open_section))
        sections.append((h, ";".join([h[:8].hex(), *(p for _, p in open_section)])))
        open_section.clear()

    for line in text.split("\n"):
        leaves = [leaf(x) for x in PIECES.findall(line)]
        h = node(b"".join(leaves))
        open_section.append((h, h[:8].hex() + b"".join(x[:4] for x in leaves).hex()))
        if not line.strip() or h[0] < 32:
            close()
    if open_section:
        close()
    return node(b"".join(h for h, _ in sections)).hex() + ":" + "|".join(s for _, s in sections)


class Tree:
    """A fingerprint taken apart. ``sections``: (hash, [(hash, [leaf hash, ...], number of the paragraph), ...])."""

    __slots__ = ("root", "sections")

    def __init__(self, printed: str):
        self.root, _, body = printed.partition(":")
        self.sections: list[tuple[str, list[tuple[str, list[str], int]]]] = []
        line = 0
        for section in body.split("|"):
            h, *paragraphs = section.split(";")
            self.sections.append((h, [(p[:16], [p[i : i + 8] for i in range(16, len(p), 8)], line + n) for n, p in enumerate(paragraphs)]))
            line += len(paragraphs)


def unshared(a: list, b: list) -> tuple[list, list, list]:
    """Children (hash first) of two nodes that have no equal partner on the other side, and those that have."""
    left, right, both = [], [], []
    free = Counter(x[0] for x in b)
    for x in a:
        if free[x[0]] > 0:
            free[x[0]] -= 1
            both.append(x)
        else:
            left.append(x)
    taken = Counter(x[0] for x in both)
    for x in b:
        if taken[x[0]] > 0:
            taken[x[0]] -= 1
        else:
            right.append(x)
    return left, right, both


def size(paragraphs: list) -> int:
    return sum(len(p[1]) for p in paragraphs)


def inside(sections: list) -> list:
    return [p for s in sections for p in s[1]]


def unshared_paragraphs(a: Tree, b: Tree) -> tuple[list, list, int]:
    """Paragraphs of each tree without an equal one in the other, and the leaves under branches that both have."""
    if a.root == b.root:
        return [], [], size(inside(a.sections))
    left, right, both = unshared(a.sections, b.sections)
    shared = size(inside(both))
    left, right, both = unshared(inside(left), inside(right))
    return left, right, shared + size(both)


def likeness(a: Tree, b: Tree) -> float:
    """Shared leaves over the mean number of leaves (Dice), 0 to 1; equal roots are 1."""
    if a.root == b.root:
        return 1.0
    left, right, shared = unshared_paragraphs(a, b)
    total = size(left) + size(right) + 2 * shared
    if not total:
        return 0.0
    mine, yours = Counter(x for p in left for x in p[1]), Counter(x for p in right for x in p[1])
    if len(yours) < len(mine):
        mine, yours = yours, mine
    shared += sum(min(n, yours.get(x, 0)) for x, n in mine.items())
    return 2 * shared / total


def differences(a: Tree, b: Tree) -> tuple[list[int], list[int]]:
    """Numbers of the paragraphs (lines, from 0) of each text that the other hasn't got: where an edit lies."""
    left, right, _ = unshared_paragraphs(a, b)
    return [p[2] for p in left], [p[2] for p in right]


def runs(numbers: list[int]) -> str:
    """``start:end`` of each run of following numbers, the end exclusive."""
    found: list[list[int]] = []
    for n in numbers:
        if found and found[-1][1] == n:
            found[-1][1] = n + 1
        else:
            found.append([n, n + 1])
    return ",".join(f"{a}:{b}" for a, b in found)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed_lines string, edited_changed_lines string"


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (part, place); each document meets the next one of its part. Guests are only the next of others."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]
    before, rows = None, []
    for b in small_batches(batches):
        for part, doc, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), texts(b)):
            if before and before[0] != part:
                before = None  # a part always ends with its guest
            printed = fingerprint(text)
            tree = Tree(printed)
            if before:
                _, prior, old, old_printed, old_tree = before
                n = len(old)
                k = n // 3
                edited = old[: n - k] + text[:k]
                edited_printed = fingerprint(edited)
                edited_tree = Tree(edited_printed)
                gone, new = differences(old_tree, edited_tree)
                digest = hashlib.sha256(edited.encode()).hexdigest()
                rows.append((prior, n, digest, old_printed, edited_printed, likeness(old_tree, edited_tree), likeness(old_tree, tree), runs(gone), runs(new)))
            before = (part, doc, text, printed, tree)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows = []


def in_ranges(base: DataFrame, cuts: list[float]) -> DataFrame:
    """Adds ``part``: 0 for the largest ids, an id equal to a cut above it, nulls last. The search among the cuts is binary."""
    last = len(cuts)
    if not cuts:
        return base.withColumn("part", F.lit(0))
    found = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_place", outputCol="_bucket", handleInvalid="keep").transform(base.withColumn("_place", F.col("doc_id").cast("double")))
    return found.withColumn("part", F.when(F.col("doc_id").isNull(), last).otherwise(last - F.col("_bucket")).cast("int")).select("part", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint of each document, of its edited text, and the likeness of both and of the next document.

    ``changed_lines`` and ``edited_changed_lines`` say where the two texts differ: runs ``start:end`` of
    lines that the other one hasn't got, empty for equal texts.

    The next document is the one before in the order of ids (nulls last of all, equal ids by text);
    after the last comes the first. Texts are shuffled once, into ranges of ids; each range also
    gets the first document of the next range as a guest, so no task sees more than a stream.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = sorted(set(base.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    placed = in_ranges(base, sorted({float(x) for x in cuts}))
    # At most one row for each part comes to the driver.
    heads = {r["part"]: r["head"] for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    order = sorted(heads)
    guest_of = [(p, heads[p], order[i - 1]) for i, p in enumerate(order)]
    wanted = spark.createDataFrame(guest_of, "_part int, _head long, _to int")
    same = (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_head"))
    # Of several heads with one id the first by text is the guest.
    guests = placed.join(F.broadcast(wanted), same).groupBy(F.col("_to").alias("part"), "doc_id").agg(F.min("text").alias("text")).withColumn("guest", F.lit(True))
    rows = placed.select("part", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)
    return (
        rows.repartition(parts, "part")
        .sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "text")
        .mapInArrow(neighbours, SCHEMA)
    )
