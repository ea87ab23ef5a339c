"""The registered queries: columns, SQL, brute force over the smallest tables, and held-out accuracy."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline

from .brute import components, simhash

COLUMNS = {
    "op1_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_webp": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_hash_tree": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_archive": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op10_html": "page_id bigint, url string, text string, n_chars bigint",
}


@pytest.fixture(scope="module")
def documents(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def run(spark, name, sf):
    return entry_module.queries()[name](spark, sf)


def test_ten_operators_and_the_pipeline_are_registered():
    names = [n for n in entry_module.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry_module.queries()


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, sf, name):
    df = run(spark, name, sf)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]


@pytest.mark.parametrize("name", [n for n in entry_module.oracle_sql() if n.startswith("op")])
def test_same_rows_as_sql(spark, sf, rows, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(entry_module.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = Counter(tuple(f"{r[k]:.9g}" if isinstance(r[k], float) else repr(r[k]) for k in order) for r in cursor.fetchall())
    assert rows(run(spark, name, sf)) == want


def test_media_digests(spark, sf, documents):
    got = {r.doc_id: r for r in run(spark, "op2_webp", sf).collect()}
    for d in documents:
        data = (d["text"] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = got[d["doc_id"]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_near_duplicates(spark, sf, documents):
    ids, fps = [d["doc_id"] for d in documents], [simhash(d["text"]) for d in documents]
    want = Counter(zip(ids, [f"{f:016x}" for f in fps], components(fps, ids), strict=True))
    assert Counter(map(tuple, run(spark, "op6_simhash", sf).select("doc_id", "fingerprint", "component_id").collect())) == want


@pytest.mark.parametrize("name,label,modulus,held,accuracy,recall", [("op3_toxicity", "toxic", 5, 0, 0.95, 0.75), ("op4_quality", "quality", 3, 1, 0.95, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, held, accuracy, recall):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max(label).alias("y"))
    got = run(spark, name, d).join(labels, "doc_id").where("y is not null").toPandas()
    assert (got.held_out == [zlib.crc32(str(x).encode()) % modulus == held for x in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    out = got[got.held_out]
    assert len(out) > 500 and (out.predicted == out.y).mean() >= accuracy
    assert out.predicted[out.y == 1].mean() >= recall


def test_scores_depend_on_the_text_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from weirflow.llm import quality, toxicity

    # As many rows again, whose ids no label knows and whose other columns are null.
    more = docs.union(docs.select((F.col("doc_id") + 10**9).alias("doc_id"), "text", *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[2:]]))
    for module in (quality, toxicity):
        got = {r.doc_id: r.score for r in module.classify(more, labels).collect()}
        assert all(got[k] == got[k + 10**9] for k in got if k < 10**9)


def test_pipeline_stages(spark, sf, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [d["doc_id"] for d in documents]
    texts = {d["doc_id"]: d["text"] for d in documents}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        now = sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert docs.columns[: len(columns)] == columns and set(now) <= set(kept) and len(now) == len(set(now))
        if name.startswith("SimHash"):
            least = components([simhash(texts[i]) for i in kept], kept)
            assert now == sorted(i for i, c in zip(kept, least, strict=True) if i == c)
        if name.startswith("benchmark"):
            from .brute import contamination

            items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
            assert now == sorted(i for i, _, hit, _ in contamination([(i, texts[i]) for i in kept], items) if not hit)
        kept = now
    assert docs.columns == [*columns, "shard", "grown_shard"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, docs.collect()))


def test_pipeline_of_odd_rows(spark, sf, tmp_path):
    from .brute import EMPTY, odd_documents

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    for k, docs in enumerate((odd_documents(spark), spark.createDataFrame([], EMPTY))):
        d = str(tmp_path / f"t{k}")
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([("a", "unseen words of no text"), (None, None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.count() <= docs.count()
        for name in ("op1_decontaminate", "op3_toxicity", "op4_quality", "op5_hash_tree", "op6_simhash", "op7_rake", "op9_licenses", "op2_webp"):
            assert run(spark, name, d).count() == docs.count()


def plain_mixed(x: int) -> int:
    x = (x ^ x >> 16) * 0x45D9F3B % 2**32
    x = (x ^ x >> 15) * 0x2C1B3C6D % 2**32
    return x ^ x >> 16


def plain_hash(key: int, salt: int) -> int:
    return plain_mixed(key % 2**32 ^ plain_mixed((key >> 32) % 2**32 ^ salt))


def test_quality_stage_is_as_plain_python(spark, sf, documents):
    import numpy as np

    from weirflow.llm import quality

    known: dict = {}
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    for r in pq.read_table(f"{sf}/labels.parquet").to_pylist():
        if r["quality"] is not None and r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["quality"])
    ids = sorted(known)
    model = quality.fit(np.stack([quality.counted(texts[k]) for k in ids]), np.array([known[k] for k in ids]))
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    for k, data in texts.items():
        v = quality.unit(quality.weighted(quality.counted(data)[None], model["idf"]) @ model["projection"])[0]
        cosine = model["vectors"] @ v
        near = cosine >= np.sort(cosine)[-quality.NEIGHBOURS] - 1e-5
        weight = np.maximum(cosine[near], 0)
        share = weight @ model["labels"][near] / weight.sum() if v.any() and weight.sum() > 0 else model["prior"]
        if abs(share - 0.5) > 0.02:
            assert (k in kept) == (share >= 0.5)


def test_mixing_stage_is_as_plain_python(spark, sf, documents):
    import re

    from weirflow.llm import mixing

    cells, of = Counter(), {}
    for d in documents:
        text = d["text"] or ""
        words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
        held = {name: len(words & set(x)) for name, x in mixing.TOPIC_WORDS.items()}
        best = max(held, key=held.get)
        values = {"source": d["source"], "lang": d["lang"], "topic": best if held[best] else None}
        cell = tuple(v if v in mixing.TARGETS[k] else mixing.OTHER for k, v in values.items())
        of[d["doc_id"]] = cell
        cells[cell] += len(re.findall(r"[^ \t\n\x0B\f\r]+", text))
    goals, total = list(mixing.TARGETS.values()), sum(cells.values())
    factor = dict.fromkeys(cells, 1.0)
    for _ in range(200):
        for k, goal in enumerate(goals):
            present = {c[k] for c, n in cells.items() if n}
            scale = sum(goal[x] for x in present)
            for x in present:
                now = sum(n * factor[c] for c, n in cells.items() if c[k] == x)
                for c in cells:
                    if c[k] == x:
                        factor[c] *= total * goal[x] / scale / now
    top = max(factor.values())
    assert top * total <= mixing.MOST * sum(n * factor[c] for c, n in cells.items())  # no category is too small here
    want = {k for k, c in of.items() if plain_hash(k, 0x2545F491) / 2**32 < factor[c] / top}
    got = {r.doc_id for r in corpus_pipeline.mix(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert got == want and 0 < len(want) < len(of)


def test_sharding_stage_is_as_plain_python(spark, sf):
    import math

    from weirflow.llm.sharding import SHARDS, tree

    def shard(key: int, regions) -> int:
        h, node, number = plain_hash(key, 0x5BD1E995), 0, 0
        levels = tree(SHARDS).levels if regions == SHARDS else tree(SHARDS).grown().levels
        for level, nodes in enumerate(levels):
            draws = [(-math.log((plain_mixed(h ^ (node * 0x3779B1 + level * 0x10001 + j * 0x9E35 + 1) % 2**32) + 1) / 2**32) / w, j) for j, w in enumerate(nodes[node])]
            number = min(draws)[1]
            node = sum(map(len, nodes[:node])) + number
        return node

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in corpus_pipeline.shard(spark, docs, sf).collect():
        assert (r.shard, r.grown_shard) == (shard(r.doc_id, SHARDS), shard(r.doc_id, SHARDS + 1))


def test_stages_take_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.withColumns({"shard": F.lit("x"), "GROWN_SHARD_2": F.lit(1), "mix_p": F.lit(0.5), "near_id": F.lit(7), "label": F.lit(None).cast("int"), "score": F.lit("s"), "fp": F.lit(1), "id": F.lit("i")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        more = ["shard_3", "grown_shard_3"] if name == "sharding" else []
        assert out.columns == [*odd.columns, *more]
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect())


def test_media_columns_are_as_an_own_reading(spark, sf, documents):
    """media_bytes, media_sha256 and feature, from the files that encoding gives each text, decoded by the general decoder."""
    import numpy as np

    from weirflow.llm import media, webp

    got = {r.doc_id: r for r in run(spark, "op2_webp", sf).collect()}
    for d in documents[::7]:
        data = (d["text"] or "").encode()
        stored = webp.encode(media.padded(data))
        r, images = got[d["doc_id"]], webp.decode(stored)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert all((x[..., 0] == x[..., 1]).all() and (x[..., 3] == 255).all() for x in images)
        p = np.concatenate([x[..., 1].ravel() for x in images]).astype(float)
        shares = np.array([n / len(p) for n in Counter(p.tolist()).values()])
        step = np.mean(np.concatenate([np.abs(np.diff(x[..., 1].astype(int), axis=1)).ravel() for x in images]))
        want = f"{len(images)}x192x{len(p) // 192};mean={p.mean():.4f};entropy={-(shares * np.log2(shares)).sum() + 0.0:.4f};step={step:.4f}"
        parts = [[float(y.rpartition("=")[2]) for y in x.split(";")[1:]] for x in (r.feature, want)]
        assert r.feature.split(";")[0] == want.split(";")[0] and np.allclose(*parts, atol=2e-4)
