"""Unbounded sources: bytes from a socket or standard input, framed by a delimiter, become a stream with an order.

A thread of the driver frames records and appends them, numbered, to a folder that Structured Streaming watches.
"""

from __future__ import annotations

import socket
import sys
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import batched
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import hadoop_path, new_path
from ..plans.live import Feed, Live, mark
from ..plans.pipe import STREAM, Sink, Source
from .files import formatted

SCHEMA = "seq long, value string"
#: Records in a file of the watched folder.
SPOOL = 50_000
#: Seconds after which fewer records make a file.
PAUSE = 0.5


def frames(chunks: Iterable[bytes], delimiter: bytes = b"\n", emit_tail: bool = False) -> Iterator[bytes]:
    """The records that end with the delimiter; emit_tail: and what is left at the end, unless it is empty."""
    if len(delimiter) != 1:
        raise ValueError("a delimiter is one byte")
    tail = b""
    for chunk in chunks:
        *whole, tail = (tail + chunk).split(delimiter)
        yield from whole
    if emit_tail and tail:
        yield tail


def table(records: list[bytes], first: int) -> pa.Table:
    """Records numbered from `first`; bytes that are no UTF-8 become the replacement character."""
    return pa.table({"seq": pa.array(range(first, first + len(records)), pa.int64()), "value": pa.array([x.decode("utf-8", "replace") for x in records], pa.string())})


def append(spark: SparkSession, records: list[bytes], path: str, first: int) -> None:
    spark.createDataFrame(table(records, first), SCHEMA).coalesce(1).write.mode("append").parquet(path)


def spool(spark: SparkSession, records: Iterable[bytes], path: str, size: int = SPOOL) -> int:
    """Append numbered records to a folder, `size` a file, and return their count."""
    n = 0
    for part in batched(records, size):
        append(spark, list(part), path, n)
        n += len(part)
    if not n:
        append(spark, [], path, 0)
    return n


def fed(spark: SparkSession, name: str, chunks: Callable[[], Iterable[bytes | None]], delimiter: bytes, emit_tail: bool) -> DataFrame:
    """The stream of the records of `chunks`, which a thread of the driver appends while the stream runs: SPOOL at once, or
    what there is every PAUSE seconds. A chunk is None where nothing came for a while."""
    if len(delimiter) != 1:
        raise ValueError("a delimiter is one byte")
    path, source = new_path(spark, name), chunks()
    append(spark, [], path, 0)

    def run() -> None:
        tail, held, n, last = b"", [], 0, time.monotonic()
        for chunk in source:
            if chunk:
                *whole, tail = (tail + chunk).split(delimiter)
                held += whole
            if held and (len(held) >= SPOOL or time.monotonic() - last >= PAUSE):
                append(spark, held, path, n)
                held, n, last = [], n + len(held), time.monotonic()
        if emit_tail and tail:
            held.append(tail)
        if held:
            append(spark, held, path, n)

    return mark(watched(spark, path), Live((Feed(run),)))


def watched(spark: SparkSession, path: str, schema: str = SCHEMA, files: int = 1) -> DataFrame:
    """The stream of a folder's files, oldest first, `files` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@dataclass(frozen=True)
class ReadStream(Source):
    """The stream of a folder of Parquet files, in order of their times. Its rows carry their own order."""

    path: str
    schema: str = SCHEMA
    files: int = 1
    structures = frozenset((STREAM,))

    def load(self, spark: SparkSession) -> DataFrame:
        return watched(spark, self.path, self.schema, self.files)


@dataclass(frozen=True)
class ReadFromSocket(Source):
    """Records (seq, value) from a TCP server, each ended by a delimiter of one byte; what none ends is dropped. They are given
    out while the server sends; that it closes is the end of the collection."""

    host: str
    port: int
    delimiter: bytes = b"\n"
    emit_tail: bool = False
    structures = frozenset((STREAM,))

    def load(self, spark: SparkSession) -> DataFrame:
        s = socket.create_connection((self.host, self.port))
        s.settimeout(PAUSE)

        def chunks() -> Iterator[bytes | None]:
            with s:
                while True:
                    try:
                        chunk = s.recv(1 << 16)
                    except TimeoutError:
                        yield None
                        continue
                    if not chunk:
                        return
                    yield chunk

        return fed(spark, "socket", chunks, self.delimiter, self.emit_tail)


@dataclass(frozen=True)
class ReadFromStdIn(Source):
    """Records (seq, value) from standard input, given out while it is read, up to its end; a last one that no delimiter ends
    counts."""

    delimiter: bytes = b"\n"
    emit_tail: bool = True
    file: BinaryIO | None = None
    structures = frozenset((STREAM,))

    def load(self, spark: SparkSession) -> DataFrame:
        file = self.file or sys.stdin.buffer
        read = getattr(file, "read1", file.read)
        return fed(spark, "stdin", lambda: iter(lambda: read(1 << 16), b""), self.delimiter, self.emit_tail)


@dataclass(frozen=True)
class WriteToStdOut(Sink):
    """A line for each record of a stream, in order of `order_by` within each micro-batch where the records have it. Ends
    when the stream's present files are read; a windowed stream's last windows follow."""

    formatter: object = None
    order_by: str = "seq"
    structures = frozenset((STREAM,))

    def write(self, df: DataFrame) -> int:
        from ..streaming.run import drained

        count = 0

        def show(part: DataFrame, _: int) -> None:
            nonlocal count
            part = part.orderBy(self.order_by) if self.order_by in part.columns else part
            bare = part.drop(self.order_by) if self.formatter is None and len(part.columns) > 1 else part
            for (value,) in formatted(bare, self.formatter).toLocalIterator():
                print("" if value is None else value)
                count += 1

        drained(df, show)
        return count


@dataclass(frozen=True)
class Drain(Sink):
    """A stream's output as a bag, once its present files are read."""

    structures = frozenset((STREAM,))

    def write(self, df: DataFrame) -> DataFrame:
        from ..streaming.run import collected

        return collected(df)


def spooled(df: DataFrame, order: str, parts: int = 4) -> str:
    """Write a bag's rows to a new folder for ReadStream, in `parts` files by ranges of a numeric column, lowest first. The
    rows are dealt out once; each file is then moved in, so that files are in order of their times."""
    spark = df.sparkSession
    path, dealt = new_path(spark, "spooled"), new_path(spark, "spooled-parts")
    low, high = df.agg(F.min(order), F.max(order)).first()
    df.limit(0).write.parquet(path)
    if low is None:
        return path
    step = (high - low) // parts + 1
    ranged = df.withColumn("spool_part", F.coalesce(F.floor((F.col(order) - low) / step), F.lit(0)).cast("int"))
    ranged.repartition(parts, "spool_part").write.partitionBy("spool_part").parquet(dealt)
    for k in range(parts):
        source, store = hadoop_path(spark, f"{dealt}/spool_part={k}")
        if store.exists(source):
            for f in store.listStatus(source):
                if f.getPath().getName().endswith(".parquet"):
                    now = int(time.time() * 1000)
                    target = hadoop_path(spark, f"{path}/{k:05d}-{f.getPath().getName()}")[0]
                    store.rename(f.getPath(), target)
                    store.setTimes(target, now, -1)
                    time.sleep(0.002)
    return path
