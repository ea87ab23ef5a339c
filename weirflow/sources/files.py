"""Bounded sources and the text sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.elements import Row
from ..plans.pipe import BAG, BOTH, Sink, Source


@dataclass(frozen=True)
class ReadFromFile(Source):
    """A record, in the column value, for each line of the text files at a path, in any store that Spark reads. Lines end
    with a line feed alone; blank lines count, and so does a last line that nothing ends."""

    path: str
    partitions: int | None = None
    structures = frozenset((BAG,))

    def load(self, spark: SparkSession) -> DataFrame:
        df = spark.read.option("lineSep", "\n").text(self.path)
        return df.repartition(self.partitions) if self.partitions else df


#: The same: the path says which store.
ReadFromHDFS = ReadFromFile


@dataclass(frozen=True)
class ReadTable(Source):
    """A Parquet table, or some of its columns."""

    path: str
    columns: tuple[str, ...] = ()
    structures = frozenset((BAG,))

    def load(self, spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(self.path)
        return df.select(*self.columns) if self.columns else df


@dataclass(frozen=True)
class WriteTable(Sink):
    """A Parquet table, which is replaced."""

    path: str
    structures = frozenset((BAG,))

    def write(self, df: DataFrame) -> str:
        df.write.mode("overwrite").parquet(self.path)
        return self.path


def formatted(df: DataFrame, formatter: Callable[[Row], Column] | None) -> DataFrame:
    """One text column: what the formatter gives; else the only column, or <key, val> of a key-value record."""
    if formatter:
        return df.select(formatter(Row()).cast("string").alias("value"))
    if df.columns == ["key", "val"]:
        return df.select(F.concat(F.lit("<"), F.col("key").cast("string"), F.lit(", "), F.col("val").cast("string"), F.lit(">")).alias("value"))
    return df.select(F.col(df.columns[0]).cast("string").alias("value"))


@dataclass(frozen=True)
class WriteToDisk(Sink):
    """A line for each record, in a folder of text files, which is replaced. `files`: how many, for small results; else as
    many as there are partitions."""

    path: str
    formatter: Callable[[Row], Column] | None = None
    files: int | None = None
    structures = frozenset((BAG,))

    def write(self, df: DataFrame) -> str:
        df = formatted(df, self.formatter)
        (df.coalesce(self.files) if self.files else df).write.mode("overwrite").option("lineSep", "\n").text(self.path)
        return self.path


@dataclass(frozen=True)
class WriteToFile(Sink):
    """A line for each record in one file of the driver's; rows pass through it one partition at a time."""

    path: str
    formatter: Callable[[Row], Column] | None = None
    structures = frozenset((BAG,))

    def write(self, df: DataFrame) -> str:
        with Path(self.path).open("w") as out:
            for (value,) in formatted(df, self.formatter).toLocalIterator():
                out.write(f"{'' if value is None else value}\n")
        return self.path


@dataclass(frozen=True)
class Collect(Sink):
    """The DataFrame itself, for a program that goes on with it."""

    structures = BOTH

    def write(self, df: DataFrame) -> DataFrame:
        return df
