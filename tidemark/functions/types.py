"""Which Spark types can be keys, and the Spark type of each type of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The data model's types by name, with the Spark type that holds every value in the same order.
SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "u128": T.BinaryType(),
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "i128": T.BinaryType(),
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "char": T.StringType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}
#: Largest key in bytes; largest value kept with its record; bytes of a value in each overflow page.
MAX_KEY_BYTES = 512
INLINE_BYTES = 2048
CHAIN_BYTES = 4048


class KeyTypeError(TypeError):
    """The type has no total order that keys can rely on."""


def check_key_type(kind: T.DataType) -> None:
    """Keys are anything orderable but floating-point numbers; arrays and structs of such."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.MapType, T.VariantType, T.NullType)):
        raise KeyTypeError(f"{kind.simpleString()} can't be a key")
    if isinstance(kind, T.ArrayType):
        check_key_type(kind.elementType)
    elif isinstance(kind, T.StructType):
        for field in kind.fields:
            check_key_type(field.dataType)


def ordered_i128(value: int) -> bytes:
    """A signed 128-bit number as bytes that sort like it: big-endian with the sign bit flipped."""
    return (value + (1 << 127)).to_bytes(16, "big")


def from_ordered_i128(data: bytes) -> int:
    return int.from_bytes(data, "big") - (1 << 127)


def key_bytes(key: Column, kind: T.DataType) -> Column:
    """Size of a key for the limit; fixed-width types never exceed it."""
    return F.octet_length(key) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(16)


def is_overflow(n_bytes: Column) -> Column:
    return n_bytes > INLINE_BYTES


def storage_class(n_bytes: Column) -> Column:
    return F.when(is_overflow(n_bytes), "overflow").otherwise("inline")


def chain_length(n_bytes: Column) -> Column:
    """Overflow pages of a value, 0 for one kept with its record."""
    return F.when(is_overflow(n_bytes), F.ceil(n_bytes / CHAIN_BYTES)).otherwise(F.lit(0)).cast("long")


def footprint(key_size: Column, value_size: Column) -> Column:
    """Bytes that a record takes on a leaf: slot, header, key, and value or reference to its chain."""
    return (F.lit(4 + 24) + key_size + F.when(is_overflow(value_size), F.lit(12)).otherwise(value_size)).cast("long")
