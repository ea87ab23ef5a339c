"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

An n-gram's feature is its presence times r, the logarithm of the ratio of its smoothed shares among toxic and other
labelled texts; logistic regression weighs these features. N-grams with a small |r| tell nothing and are left out, so a
long text isn't judged by its common n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_batches, discard, texts, written
from .learning import labelled_sample, remainder, scored

FOLDS, HELD_OUT = 5, 0
ORDERS = (4, 5, 6)
BUCKETS = 1 << 20
#: Labelled texts that the classifier is fitted on at most, by label.
SAMPLE = {0: 2500, 1: 1500}
#: An n-gram is used from so many texts on, from so large a ratio's logarithm, and if its count among toxic texts is so
#: many standard deviations off what it would be if it told nothing.
LEAST_TEXTS, LEAST_RATIO, LEAST_DEVIATIONS = 3, 0.5, 2.0
#: Features at most; of more, those are used whose counts are the most deviations off.
FEATURES = 1 << 16
#: Tasks that count the sample, and slices of the table of buckets that are added up apart from each other.
PARTS, SLICES = 12, 64
PENALTY, STEPS, RATE = 1e-3, 200, 0.3


def ngrams(data: bytes, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Buckets of all character n-grams of the lower-cased text, repeats included."""
    c = np.frombuffer((" " + data.decode("utf-8", "replace").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in orders:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(1_000_003) + c[i : len(c) - n + 1 + i]
        out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def chosen(p: np.ndarray, q: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of buckets that p toxic and q other texts hold: which are used, their log-count ratios, and how far off they are."""
    r = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    n, share1 = p + q, n1 / (n1 + n0)
    off = np.abs(p - n * share1) / np.sqrt(np.maximum(n, 1) * share1 * (1 - share1))
    used = np.flatnonzero((n >= LEAST_TEXTS) & (np.abs(r) >= LEAST_RATIO) & (off >= LEAST_DEVIATIONS))
    return used, r[used], off[used]


def at_most(used: np.ndarray, r: np.ndarray, off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` buckets that are the farthest off, by number; of equals the lower ones."""
    keep = np.sort(np.lexsort((used, -off))[:most])
    order = keep[np.argsort(used[keep])]
    return used[order], r[order]


def parts(cols: list[np.ndarray], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` features."""
    begin = size = 0
    for k, c in enumerate(cols):
        if size and size + len(c) > most:
            yield begin, k
            begin, size = k, 0
        size += len(c)
    yield begin, len(cols)


def solve(cols: list[np.ndarray], labels: np.ndarray, used: np.ndarray, r: np.ndarray) -> dict:
    """{bias, buckets, weights} of logistic regression; `cols`: each text's features, as places in `used`."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    ranges = list(parts(cols))

    def expand(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(b - a), [len(c) for c in cols[a:b]]), np.concatenate([np.zeros(0, np.int64), *cols[a:b]]).astype(np.int64)

    # Up to four ranges stay expanded; more are expanded anew in each step.
    kept = [expand(a, b) for a, b in ranges] if len(ranges) <= 4 else None
    each = lambda: zip(ranges, kept if kept is not None else (expand(a, b) for a, b in ranges), strict=True)
    # Each label has half of the weight. Accelerated gradient steps, in units that the largest row bounds.
    share = np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    w, b, vw, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    scale = max(1.0, sum(float((r[col] ** 2).sum()) for _, (_, col) in each()) / len(cols))
    for k in range(STEPS):
        m = k / (k + 3)
        aw, ab = w + m * vw, b + m * vb
        scaled, pull, off = r * aw, np.zeros(len(used)), 0.0
        for (begin, end), (row, col) in each():
            z = np.bincount(row, scaled[col], end - begin) + ab
            g = share[begin:end] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[begin:end])
            pull += np.bincount(col, g[row], len(used))
            off += g.sum()
        nw, nb = aw - RATE / scale * 8 * (r * pull + PENALTY * aw), ab - RATE * off
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return {"bias": float(b), "buckets": used, "weights": (w * r).astype(np.float32)}


def constant(n1: int, n0: int) -> dict:
    """Without texts of both labels there are no weights, and the bias gives the labels' smoothed share."""
    return {"bias": float(np.log((n1 + 1) / (n0 + 1))), "buckets": np.zeros(0, np.int64), "weights": np.zeros(0, np.float32)}


def fit(features: list[np.ndarray], labels: np.ndarray) -> dict:
    """The model of texts that are here, given as their buckets."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return constant(n1, n0)
    p, q = (np.bincount(np.concatenate([f for f, y in zip(features, labels, strict=True) if y == label]), minlength=BUCKETS).astype(float) for label in (1, 0))
    used, r = at_most(*chosen(p, q, n1, n0), FEATURES)
    return solve([places(f, used) for f in features], labels, used, r)


def places(buckets: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Where those of a text's buckets that are used stand in `used`."""
    if not len(used):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(used, buckets), len(used) - 1)
    return np.unique(at[used[at] == buckets])


def score_texts(batch: list[bytes], model: dict) -> list[float]:
    if "table" not in model:  # the worker keeps it
        model["table"] = np.zeros(BUCKETS, np.float32)
        model["table"][model["buckets"]] = model["weights"]
    table, out = model["table"], []
    for data in batch:
        h = ngrams(data)
        h = np.unique(h[table[h] != 0])
        z = model["bias"] + float(table[h].sum(dtype=np.float64))
        out.append(round(1 / (1 + float(np.exp(-max(-40.0, min(40.0, z))))), 9))
    return out


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: dict[int, int] | None = None, id: str = "doc_id", text: str = "text") -> dict:
    """The model from a bounded sample of labelled rows outside the held-out fold.

    Executors count the sampled texts' buckets by label, in SLICES slices of the table of buckets, and choose features from
    each; the driver gets those, and of each text a bit for each feature, whatever the texts' lengths: at most
    BUCKETS * 24 bytes and FEATURES / 8 bytes a text.
    """
    spark = docs.sparkSession
    taken = labelled_sample(docs, labels, label, sample or SAMPLE, remainder(F.col("sample_id"), FOLDS) != HELD_OUT, id=id, text=text)
    taken = written(taken.select("text", "label").repartition(PARTS), "toxicity-sample")
    known = {r[0]: r[1] for r in taken.groupBy("label").count().collect()}
    n1, n0 = known.get(1, 0), known.get(0, 0)
    if not n1 or not n0:
        return constant(n1, n0)
    bounded_batches(spark)
    width = BUCKETS // SLICES

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, BUCKETS), np.uint16 if n1 + n0 < 1 << 16 else np.uint32)
        for batch in batches:
            for y, data in zip(batch["label"].to_pylist(), texts(batch["text"]), strict=True):
                both[y, np.unique(ngrams(data))] += 1
        for k in range(SLICES):
            part = both[:, k * width : (k + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": [k], "counts": [part.astype(np.uint32).tobytes()]}, schema=pa.schema([("slice", pa.int32()), ("counts", pa.binary())]))

    def choose(table: pa.Table) -> pa.Table:
        total = np.zeros((2, width), np.int64)
        for x in table["counts"]:
            total += np.frombuffer(x.as_py(), np.uint32).reshape(2, width)
        used, r, off = chosen(total[1].astype(float), total[0].astype(float), n1, n0)
        return pa.table({"bucket": pa.array(used + table["slice"][0].as_py() * width, pa.int32()), "r": pa.array(r, pa.float64()), "off": pa.array(off, pa.float64())})

    # A slice's group has one row from each of PARTS tasks at most.
    tables = taken.mapInArrow(counts, "slice int, counts binary").groupBy("slice").applyInArrow(choose, "bucket int, r double, off double").toArrow()
    used, r = at_most(tables["bucket"].to_numpy().astype(np.int64), tables["r"].to_numpy(), tables["off"].to_numpy(), FEATURES)
    held = spark.sparkContext.broadcast(used)

    def bits(batch: pa.RecordBatch) -> dict:
        made = []
        for data in texts(batch["text"]):
            flags = np.zeros(len(held.value), bool)
            flags[places(np.unique(ngrams(data)), held.value)] = True
            made.append(np.packbits(flags).tobytes())
        return {"label": batch["label"], "bits": made}

    got = arrow_map(taken, bits, "label int, bits binary").toArrow()
    discard(taken)
    cols = [np.flatnonzero(np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(used))).astype(np.uint16 if FEATURES <= 1 << 16 else np.uint32) for x in got["bits"]]
    return solve(cols, got["label"].to_numpy().astype(np.int64), used, r)


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: dict[int, int] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted per row of `docs`.

    Only the columns `id` and `text` are read, so others may have any name. Null and empty texts have the n-grams of blanks
    alone and so about the bias's score; equal texts have equal scores; repeated rows each give a row; a null id is null
    and in the fold of the text null. Labels that are null, or of ids that `docs` lacks, are not learned from; with labels
    of one kind or none, every score is their smoothed share. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label=label, sample=sample, id=id, text=text))
    return scored(docs, remainder(F.col(id), FOLDS) == HELD_OUT, lambda batch: score_texts(batch, model.value), id=id, text=text)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
