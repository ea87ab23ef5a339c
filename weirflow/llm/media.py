"""Media columns: texts kept as grey samples in lossless WebP files, read back as pixel arrays, with features."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts, written
from .webp import WIDTH, decode, decode_samples, encode

#: Decoded pixels, four bytes each, are put out in batches of about this many bytes.
PIXEL_BATCH = 8 << 20


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """With blanks up to a positive multiple of `width`."""
    return data + b" " * (-len(data) % width if data else width)


def with_media(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media) per row of `docs`: the unpadded length, and the padded text as WebP.

    Only `id` and `text` are read, so other columns may have any name. A null text is an empty one, which is a row of
    blanks; equal texts have equal media; a text of more than 2048 rows of samples is several images that follow one
    another; repeated rows each give a row; a null id stays null; an empty table gives none.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        data = texts(batch["text"])
        return {"id": batch["id"], "n_bytes": [len(x) for x in data], "media": [encode(padded(x)) for x in data]}

    made = arrow_map(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), rows, "id long, n_bytes long, media binary")
    return made.withColumnRenamed("id", id)


def pixels(media: DataFrame, *, id: str = "doc_id", column: str = "media") -> DataFrame:
    """(id, image, width, height, rgba) for each image of each file of any lossless WebP; null media have none."""

    def run(batches):
        schema = pa.schema([("id", pa.int64()), ("image", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())])
        held, size = [], 0
        for batch in batches:
            for key, data in zip(batch["id"].to_pylist(), batch["media"], strict=True):
                for k, x in enumerate(decode(data.as_py() or b"")):
                    held.append({"id": key, "image": k, "width": x.shape[1], "height": x.shape[0], "rgba": x.tobytes()})
                    size += x.size
                    if size > PIXEL_BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    read = media.select(F.col(id).cast("long").alias("id"), F.col(column).alias("media"))
    return read.mapInArrow(run, "id long, image int, width int, height int, rgba binary").withColumnRenamed("id", id)


def feature(images: list[np.ndarray]) -> str:
    """Count and shape of the images; mean, entropy and mean step between neighbours of their samples."""
    counts, step, pairs = np.zeros(256, np.int64), 0, 0
    for x in images:
        counts += np.bincount(x.ravel(), minlength=256)
        d = np.diff(x.astype(np.int16), axis=1)
        step += int(np.abs(d).sum())
        pairs += d.size
    n = int(counts.sum())
    p = counts[counts > 0] / max(n, 1)
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    return f"{len(images)}x{WIDTH}x{n // WIDTH};mean={float(counts @ np.arange(256)) / max(n, 1):.4f};entropy={entropy:.4f};step={step / max(pairs, 1):.4f}"


def described(media: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """Digests of the stored form and of the payload that it decodes to, and the feature, per row of with_media()."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], **{k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}}
        for value in batch["media"]:
            data = value.as_py()
            images = decode_samples(data)
            payload = b"".join(x.tobytes() for x in images)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-16:]))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            out["feature"].append(feature(images))
        return out

    read = media.select(F.col(id).alias("doc_id"), "n_bytes", "media")
    return arrow_map(read, rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_webp(spark, sf_dir: str) -> DataFrame:
    return described(written(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
