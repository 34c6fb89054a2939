"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract lower-cases these letters only; ``lower()`` would change others too.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops the columns that an operator is about to add, whatever their case."""
    return df.drop(*names)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """128 bits of a text; with the document's id they name a row (equal rows share a name)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def chunks_of_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch of about ``limit`` text bytes, one row at least, so that very long texts stay bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def texts_of(values: Iterable) -> list[bytes]:
    """UTF-8 bytes of Python strings; null counts as empty."""
    return [(v or "").encode() for v in values]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, also where ``body`` uses it in inner functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(n: Column, empty: str = "array<int>") -> Column:
    """0, 1, ... n-1; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast(empty))


#: Rows of a key-like table (some tens of bytes each) up to which it may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, stored_rows: int) -> DataFrame:
    """Marks a table for broadcast if its counted rows stay under ``BROADCAST_ROWS``; else the join shuffles and splits skew."""
    return F.broadcast(df) if stored_rows <= BROADCAST_ROWS else df


def exact_lower(text: Column) -> Column:
    """A-Z lower-cased; texts of ASCII only take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


#: Measured bytes up to which a table may be broadcast where its rows can be of any size.
BROADCAST_BYTES = 64 << 20


def bounded_side(df: DataFrame, *sized: Column) -> DataFrame:
    """Marks a stored table for broadcast if its rows, counted with 64 bytes each plus the ``sized`` bytes, stay under ``BROADCAST_BYTES``; else the join shuffles and splits skew."""
    bytes_of = sum((F.coalesce(c, F.lit(0)) for c in sized), F.lit(64)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(bytes_of)).first()[0] or 0) <= BROADCAST_BYTES else df
