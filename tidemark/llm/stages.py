"""Pipeline stages: each takes documents and returns documents (the last one, pieces of sequences)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused, whole_row
from .language import fit_language, identify_language
from .mixing import mix
from .packing import pack_documents
from .queries import tokenizer_path
from .secrets import redact_documents
from .similarity import first_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letter) go; a missing label is filled with the prediction, if any label is there to learn from.

    Extra columns stay whatever their names; repeated rows and rows without an id are judged each for itself; an empty table stays empty.
    """
    network = fit_language(docs)
    if network is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    name = unused(docs, "_lang")
    found = identify_language(docs, network, name=name)
    return found.where(F.col(name) != "und").withColumn("lang", F.coalesce("lang", name)).select([f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with a five-word similarity of 0.8 or more the one with the smallest id stays, nulls last and then by a hash of the text; of equal rows one.

    Candidates come from SimHash fingerprints (see ``similarity``). Null and empty texts are one class. Rows that share an id
    but not a text are compared like any others. Extra columns stay whatever their names; an empty table stays empty.
    """
    firsts = first_documents(docs)
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    kept = rows.join(firsts.hint("shuffle_hash"), same, "left_semi")
    twice = rows.groupBy("id", "hash").count().where("count > 1")
    return (kept if twice.isEmpty() else kept.dropDuplicates(["id", "hash"])).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kinds; ``n_chars`` follows. Every row stays, null texts stay null, and so do all other columns."""
    return redact_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select([f"`{c}`" for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times (0, 1 or 2) as the mix takes it, decided row by row, so ids may be shared or missing and columns have any names."""
    rows = mix(docs, carry=True).where("taken > 0").withColumn("_copies", F.expr("taken div size"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of all documents; null texts are empty ones, and rows that share an id are documents of their own."""
    return pack_documents(docs, tokenizer_path())
