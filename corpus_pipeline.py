"""The corpus pipeline: documents in, sharded training documents out.

Quality classifier, SimHash near-duplicates, benchmark decontamination, mixing to target weights, sharding. Each stage
takes the documents that the one before kept, and drops those that it decides against; the last adds their shards.

Further columns go along, whatever their names. A null text counts as empty; rows that repeat are one document to the
near-duplicate stage, and each a row to the others; an empty table gives an empty one. Ties are settled by the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import discard, written
from weirflow.llm.decontaminate import without_items
from weirflow.llm.mixing import mixture
from weirflow.llm.quality import accepted
from weirflow.llm.sharding import SHARDS, shard_of, tree
from weirflow.llm.simhash import one_of_each_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote accepts; the labels are those of the documents at hand. An empty or null text has
    the labels' smoothed share for a score; without labels every document stays."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id, once; documents without an id stay."""
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; empty and null texts have none."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares by source, language and topic. Nulls are of the category OTHER; rows that
    repeat an id stay or go together."""
    return mixture(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and, of one shard more, grown_shard; a null id counts as -1. Where the documents have
    columns of these names, the new ones are named shard_2 and grown_shard_2, and so on."""
    taken = {c.lower() for c in docs.columns}
    ends = ["", *(f"_{k}" for k in range(2, len(taken) + 3))]
    end = next(x for x in ends if not {"shard" + x, "grown_shard" + x} & taken)
    present = tree(SHARDS)
    return docs.withColumns({"shard" + end: shard_of(F.col("doc_id"), present), "grown_shard" + end: shard_of(F.col("doc_id"), present.grown())})


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: The votes of nearest neighbours and XXH64 have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table; each but the last is written, and read by the next, and is gone once that
    one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline-" + name.split(" ")[0].lower())
            discard(before)
    return docs
