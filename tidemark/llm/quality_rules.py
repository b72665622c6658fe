"""Quality rules with cross-document line frequency, in DataFrame functions only.

The texts are scanned once into a narrow table (counts, and a hash and a word count for each line);
everything across documents works on that table. Counts by line are combined on the map side, so a
line that a third of all documents share costs one row for each task.

Null or empty text: no words, so ``base_failed``. A null host is a host of its own. Rows equal in
host and text count as one document and get one verdict; rows that share a ``doc_id`` but not a
text are separate. A line above the limit stays in the first of its documents (smallest id, nulls
last), so no content is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, let, written

#: Symbols counted by the base rules.
SYMBOLS = "#*$%&|<>"
#: Tasks over which the documents of one frequent line are dealt.
SALTS = 16


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that the text holds twice or more, each word once."""

    def windows(h: Column) -> Column:
        hashed = F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")),
        )
        return let(F.array_sort(hashed), lambda s: let(found(s), covered))

    def found(s: Column) -> Column:
        same = lambda e, k: e["h"] == F.get(s, k)["h"]
        starts = F.transform(s, lambda e, k: F.when(same(e, k + 1) | same(e, k - 1), e["i"]))
        return F.array_sort(F.filter(starts, lambda x: x.isNotNull()))

    def covered(starts: Column) -> Column:
        gained = F.transform(starts, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - v, F.lit(3))))
        return F.aggregate(gained, F.lit(0), lambda a, x: a + x)

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One narrow row for each document: base counts and its lines as (hash of the normalised line, words)."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    blank = F.length(F.translate(text, SPACES, ""))
    normal = lambda line: F.lower(F.trim(F.regexp_replace(line, SPACE_RUN, " ")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

    def of_lines(a: Column) -> Column:
        n_dup = F.size(a) - F.size(F.array_distinct(a))
        each = F.transform(a, lambda x: let(normal(x), lambda y: F.struct(F.xxhash64(y).alias("h"), (F.length(y) - F.length(F.translate(y, " ", "")) + 1).alias("n"))))
        return F.struct(n_dup.cast("long").alias("n_dup_lines"), each.alias("lines"))

    def of_words(a: Column) -> Column:
        return F.struct(F.size(a).cast("long").alias("n_words"), repeated_words(a).cast("long").alias("n_repeat_words"))

    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_host"))
        .select(
            "_id",
            "_host",
            F.md5(text.cast("binary")).alias("_key"),
            blank.cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(words_of(text), of_words).alias("_w"),
            let(lines, of_lines).alias("_l"),
        )
        .select("_id", "_host", "_key", "word_chars", "n_symbols", "_w.*", "_l.*")
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs_per_line: int = 50,
    min_kept_percent: int = 30,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Base counts and verdict for each row of ``docs``.

    A line in more than ``max_docs_per_line`` distinct documents of a host is removed from all but
    the first; a document that keeps less than ``min_kept_percent`` of its words is rejected.
    """
    narrow = written(line_counts(docs, id_col, text_col, host_col), "lines")
    host = F.coalesce(F.concat(F.lit("v"), F.col("_host").cast("string")), F.lit("n")).alias("_h")
    unique = narrow.groupBy(host, "_key").agg(F.min(F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_key").alias("k"))).alias("_first"), F.first("lines").alias("lines"))
    frequent = (
        unique.select("_h", "_first", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
        .groupBy("_h", "h")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_first").alias("_owner"))
        .where(F.col("n") > max_docs_per_line)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    removed = (
        unique.select("_h", "_key", F.explode("lines").alias("x"))
        .select("_h", "_key", F.col("x.h").alias("h"), F.col("x.n").alias("words"), F.pmod(F.crc32("_key"), F.lit(SALTS)).cast("int").alias("_salt"))
        .join(frequent, ["_h", "h", "_salt"])
        .where(F.col("_owner.k") != F.col("_key"))
        .groupBy("_h", "_key")
        .agg(F.sum("words").alias("_removed"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.coalesce(F.col("_removed"), F.lit(0))
    return (
        narrow.drop("lines")
        .withColumn("_h", host)
        .join(removed, ["_h", "_key"], "left")
        .select(
            F.col("_id").alias("doc_id"),
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & (100 * left >= min_kept_percent * F.col("n_words"))).alias("kept"),
            (F.col("n_words") - left).cast("long").alias("n_removed_words"),
        )
    )
