"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import cut, release, scratch  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What a null id counts as in every order of ids: smaller than any id.
NULL_ID = -(2**63)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives memory that it no longer uses back to the system: it lives on beside others."""
    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc alone has it
            trim(0)

    return whole


def id_key(col: str | Column = "doc_id") -> Column:
    """The id as a long that orders nulls first and joins without null-safe comparison."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def text_or_empty(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: sizes the number of blocks, so that a block's size stays the same as the input grows."""
    return int(docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0)


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct `row`, so that no name that an operator uses can clash with one of theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], *new: str) -> DataFrame:
    """The columns again, and those that the operator made; one that had such a name gives way to it."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c not in new], *new)


def wider(df: DataFrame, ddl: str) -> StructType:
    """The schema of packed rows of `df` and more fields."""
    return StructType([StructField("row", df.schema, False), *StructType.fromDDL(ddl).fields])
