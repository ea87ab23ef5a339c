"""What the two classifiers share: held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map


def remainder(id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text null."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("null")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: dict[int, int], learn: Column, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label): of the rows of `docs` that have the label and meet `learn`, a condition on sample_id, the
    per_label[label] with the smallest hashes of their ids. A label that rows contradict is the larger one; nulls are none."""
    known = labels.select(F.col(id).cast("long").alias("sample_id"), F.col(label).cast("int").alias("label")).where("sample_id is not null and label is not null").where(learn)
    known = known.groupBy("sample_id").agg(F.max("label").alias("label"))
    present = docs.select(F.col(id).cast("long").alias("sample_id"), F.col(text).alias("text"))
    known = known.join(present.select("sample_id"), "sample_id", "left_semi")
    order = [F.xxhash64("sample_id"), "sample_id"]
    taken = None
    for value, most in per_label.items():
        # As many ids as per_label says, 12 bytes each: small enough to broadcast.
        part = known.where(F.col("label") == value).orderBy(*order).limit(most)
        rows = present.join(F.broadcast(part), "sample_id").orderBy(*order, F.xxhash64("text")).limit(most)
        taken = rows if taken is None else taken.union(rows)
    return taken.select("text", "label")


def scored(docs: DataFrame, held_out: Column, score: Callable[[list[bytes]], list[float]], *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted per row of `docs`; `score` maps a batch of texts."""
    rows = lambda b: {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score([b"" if x is None else x for x in b["text"].cast(pa.binary()).to_pylist()])}
    read = docs.select(F.col(id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    made = arrow_map(read, rows, T._parse_datatype_string("doc_id long, held_out boolean, score double"))
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
