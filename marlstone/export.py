"""Results as text and as Arrow data: JSON lines, CSV, Arrow streams, and lists of display strings. Rows are read partition by partition."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from typing import BinaryIO, TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType, VariantType

from marlstone.governance import batches
from marlstone.model import EngineError


def _text(df: DataFrame) -> DataFrame:
    """All columns as strings: nested ones as JSON, bytes as hex."""

    def shown(name: str) -> Column:
        kind, own = df.schema[name].dataType, F.col("`" + name.replace("`", "``") + "`")
        if isinstance(kind, ArrayType | MapType | StructType | VariantType):
            return F.to_json(own)
        return F.lower(F.hex(own)) if isinstance(kind, BinaryType) else own.cast("string")

    return df.select(*[shown(c).alias(c) for c in df.columns])


def names(df: DataFrame) -> list[str]:
    """The result's column names; two that are equal are refused."""
    if len(set(df.columns)) < len(df.columns):
        raise EngineError("duplicate_columns", "two columns of the result have one name")
    return df.columns


def display_rows(df: DataFrame) -> list[dict[str, str | None]]:
    """All rows as display strings or None: for results that a person reads."""
    names(df)
    return [r.asDict() for r in _text(df).toLocalIterator()]


def write_json(df: DataFrame, out: TextIO) -> int:
    """One object a line, every value a string or null."""
    names(df)
    n = 0
    for row in _text(df).toLocalIterator():
        out.write(json.dumps(row.asDict(), ensure_ascii=False) + "\n")
        n += 1
    return n


def write_csv(df: DataFrame, out: TextIO) -> int:
    """A header, also without rows, and every value in quotes; null is empty."""
    writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
    writer.writerow(names(df))
    n = 0
    for row in _text(df).toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
        n += 1
    return n


def write_arrow(df: DataFrame, out: BinaryIO) -> int:
    """An Arrow stream with the result's schema, also without rows."""
    n, writer = 0, None
    for batch in batches(df):
        writer = writer or pa.ipc.new_stream(out, batch.schema)
        writer.write_batch(batch)
        n += batch.num_rows
    writer.close()
    return n


def arrow_bytes(df: DataFrame) -> bytes:
    out = io.BytesIO()
    write_arrow(df, out)
    return out.getvalue()


def reader(df: DataFrame) -> pa.RecordBatchReader:
    """The result as an Arrow stream object (with ``__arrow_c_stream__``), computed as it is read."""
    found = batches(df)
    first = next(found)

    def rest() -> Iterator[pa.RecordBatch]:
        yield first
        yield from found

    return pa.RecordBatchReader.from_batches(first.schema, rest())
