"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import cut as written
from ..plans.durable import discard
from ..plans.durable import new_path as shared_path

__all__ = ["arrow_map", "arrow_schema", "bounded_batches", "discard", "row_key", "shared_path", "texts", "utf8", "words", "written"]

#: Rows in an Arrow batch that goes to Python; with the session's limit of bytes per batch it bounds a worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

#: Lower-cases A-Z and turns every byte that no word holds into a space; bytes of non-ASCII letters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def utf8(text: str | bytes | None) -> bytes:
    """The text's UTF-8 bytes; null has none."""
    return b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def words(data: bytes) -> list[bytes]:
    """Maximal runs of digits, ASCII letters and non-ASCII characters, lower-cased."""
    return data.translate(WORD_BYTES).split()


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as bytes; nulls are empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a few very long texts fit in a worker's memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], dict | pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Apply `rows`, which maps a batch to columns, to every batch."""
    bounded_batches(df.sparkSession)
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(batch)
            yield made if isinstance(made, pa.RecordBatch) else pa.RecordBatch.from_pydict(made, schema=arrow)

    return df.mapInArrow(run, out)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def row_key(*columns: str) -> Column:
    """128 bits that the columns' values decide; a null is not an empty text."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x00", *[F.concat(F.octet_length(x).cast("string"), F.lit(":"), x) for x in parts]).cast("binary")))
