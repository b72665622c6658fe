"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local session gets a local one and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty() and not context.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = context.getCheckpointDir().get()
    return found.rstrip("/")


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch():
    """Tables made by ``written`` inside are deleted at the end: for results that are written themselves before."""
    _scopes.append([])
    try:
        yield
    finally:
        release(*_scopes.pop())


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: ``df`` as a Parquet table in the shared folder, read again.

    Unlike a cached block the table outlives the executors that wrote it. ``keep``: beyond the ``scratch`` around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    if _scopes and not keep:
        _scopes[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_tidemark_path", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made of it, that is no column of ``df`` in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none of their names can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are done."""
    gc.collect()
    spark._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def crc_bucket(column: str, n: int) -> Column:
    """CRC32 of the id as decimal text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text (one row at least), so that memory doesn't follow Arrow's row count."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        yield b.slice(start)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def sampled(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """A bounded sample of rows for fitting: those whose seeded id hash falls below ``most`` of ``count``; at most twice ``most`` rows.

    It needs no order over the table, so no task holds more than its share.
    """
    n = max(1, df.count())
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(n)) < most).limit(2 * most)
