"""Quality by nearest neighbours: labelled latent-semantic vectors vote, weighted by similarity.

Terms are of two kinds, which weigh the same: words, and the text's typography, as n-grams of its runs of character
classes and words that repeat the one before. Their weighted counts are projected on the leading singular vectors of the
labelled texts; each text's exact cosines with all labelled vectors are block products of matrices.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts
from .learning import labelled_sample, remainder, scored

FOLDS, HELD_OUT = 3, 1
#: Buckets of typographic terms, and of words.
TERMS, WORDS = 1024, 1024
RANK, NEIGHBOURS = 48, 15
#: Labelled texts at most, by label; with RANK they bound what is broadcast: 4000 * 48 * 4 bytes, and the projection; the driver gets 8 KB
#: of counts a text.
SAMPLE = {0: 1000, 1: 3000}
BLOCK = 256

#: Spaces 0, letters a-z and all beyond ASCII 1, A-Z 2, digits 3; each other character is a class of its own.
CLASSES = np.array([0 if c in b" \t\r\n\v\f" else 1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 + c for c in range(256)], np.uint64)


def term_counts(data: bytes) -> np.ndarray:
    """Counts in TERMS buckets; the last is of words equal to the word before."""
    out = np.zeros(TERMS, np.float32)
    if not data:
        return out
    c = CLASSES[np.frombuffer(data, np.uint8)]
    runs = c[np.concatenate(([True], c[1:] != c[:-1]))]
    for n in (1, 2, 3):
        if len(runs) < n:
            continue
        h = np.full(len(runs) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(137) + runs[i : len(runs) - n + 1 + i]
        out += np.bincount(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % (TERMS - 1), minlength=TERMS)
    w = data.split()
    out[TERMS - 1] = sum(map(bytes.__eq__, w, w[1:]))
    return out


def word_counts(data: bytes) -> np.ndarray:
    """Counts of the lower-cased words between white space, in WORDS buckets."""
    hashes = np.fromiter(map(zlib.crc32, data.lower().split()), np.uint32)
    return np.bincount(hashes % WORDS, minlength=WORDS).astype(np.float32)


def counted(data: bytes) -> np.ndarray:
    return np.concatenate((term_counts(data), word_counts(data)))


def fit(counts: np.ndarray, labels: np.ndarray) -> dict:
    """{idf, projection, vectors, labels, prior} of labelled counts."""
    n = len(labels)
    prior = (float(labels.sum()) + 1) / (n + 2)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.05)
    x = weighted(counts, idf)
    _, v = np.linalg.eigh(x.T.astype(np.float64) @ x)
    projection = v[:, ::-1][:, :RANK].astype(np.float32)
    return {"idf": idf, "projection": projection, "vectors": unit(x @ projection), "labels": labels.astype(np.float32), "prior": prior}


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each kind of terms as a unit vector, side by side, and all of a text at length 1."""
    kinds = [(counts[:, a:b], idf[a:b]) for a, b in ((0, TERMS), (TERMS, TERMS + WORDS))]
    return unit(np.hstack([unit(np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1)) * i) for c, i in kinds]))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 1e-9, norm, 1)).astype(np.float32)


def vote(vectors: np.ndarray, model: dict, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest labelled vectors' labels, and those as near as the k-th, weighted by similarity; the prior for a zero vector."""
    out = np.full(len(vectors), model["prior"])
    known = model["vectors"]
    if not len(known):
        return out
    k = min(k, len(known))
    for at in range(0, len(vectors), BLOCK):
        block = vectors[at : at + BLOCK]
        cosine = block @ known.T
        least = np.partition(cosine, len(known) - k, axis=1)[:, len(known) - k]
        weight = np.where(cosine >= least[:, None] - 1e-5, np.maximum(cosine, 0), 0)
        total = weight.sum(axis=1)
        some = (total > 1e-6) & (np.abs(block).sum(axis=1) > 0)
        out[at : at + BLOCK][some] = ((weight @ model["labels"]) / np.where(total > 0, total, 1))[some]
    return np.clip(np.round(out, 5), 0, 1)


def score_texts(batch: list[bytes], model: dict) -> list[float]:
    out: list[float] = []
    for at in range(0, len(batch), BLOCK):
        counts = np.stack([counted(x) for x in batch[at : at + BLOCK]])
        out += vote(unit(weighted(counts, model["idf"]) @ model["projection"]), model).tolist()
    return out


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: dict[int, int] | None = None, id: str = "doc_id", text: str = "text") -> dict:
    """The labelled vectors, of a bounded sample of rows outside the held-out fold. Terms are counted on the executors."""
    rows = lambda b: {"label": b["label"], "counts": [counted(x).tolist() for x in texts(b["text"])]}
    taken = labelled_sample(docs, labels, label, sample or SAMPLE, remainder(F.col("sample_id"), FOLDS) != HELD_OUT, id=id, text=text)
    got = arrow_map(taken.select("text", "label").repartition(12), rows, "label int, counts array<float>").toArrow()
    counts = np.asarray(got["counts"].combine_chunks().flatten()).reshape(-1, TERMS + WORDS)
    return fit(counts, got["label"].to_numpy().astype(np.int64))


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: dict[int, int] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted per row of `docs`.

    Only the columns `id` and `text` are read, so others may have any name. A null or empty text has no terms and gets the
    labels' smoothed share; equal texts have equal scores; repeated rows each give a row; a null id is null and in the fold
    of the text null. Labels that are null, or of ids that `docs` lacks, are not learned from; without any, every score is
    one half. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label=label, sample=sample, id=id, text=text))
    return scored(docs, remainder(F.col(id), FOLDS) == HELD_OUT, lambda batch: score_texts(batch, model.value), id=id, text=text)


def accepted(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns kept, that score `least` or more."""
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text=text, **options))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([x >= least for x in score_texts(texts(batch[text]), model.value)], pa.bool_()))

    return arrow_map(docs, keep, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
