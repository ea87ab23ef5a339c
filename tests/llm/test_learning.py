"""The classifiers' parts, and their edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import quality, toxicity
from weirflow.llm.learning import labelled_sample, remainder

from .brute import EMPTY, odd_documents

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
@pytest.mark.parametrize("known", [[], [(1, 1, 1)], [(1, 0, 0)], [(2, 1, 1), (5, 0, 0), (3, 1, 0)], [(None, 1, 1), (77, 0, 1), (6, None, None)]])
def test_few_labels(spark, module, label, known):
    odd = odd_documents(spark)
    got = module.classify(odd, spark.createDataFrame(known, LABELS), label=label).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(x) == 1 for x in by.values()) and by[1] == by[8] and by[2] == by[3]
    if not known:
        assert {r.score for r in got} == {0.5}
    assert module.classify(spark.createDataFrame([], EMPTY), spark.createDataFrame(known, LABELS), label=label).count() == 0


def test_accepted_rows_keep_their_columns(spark):
    odd = odd_documents(spark)
    kept = quality.accepted(odd, spark.createDataFrame([(1, 1, 0)], LABELS))
    assert kept.columns == odd.columns and kept.count() == 9


def test_held_out_rows(spark):
    import zlib

    df = spark.createDataFrame([(k,) for k in [*range(40), None]], "i long").select("i", remainder(F.col("i"), 5).alias("r"))
    assert all(r.r == zlib.crc32((str(r.i) if r.i is not None else "null").encode()) % 5 for r in df.collect())


def test_sample_is_bounded_and_outside_the_fold(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(4, 1), (None, 1), (6, None)], "doc_id long, y int")
    got = labelled_sample(docs, labels, "y", {0: 10, 1: 500}, remainder(F.col("sample_id"), 5) != 0).collect()
    ids = {int(r.text.split()[1]): r.label for r in got}
    import zlib

    assert all(zlib.crc32(str(k).encode()) % 5 for k in ids)
    assert sum(v == 0 for v in ids.values()) == 10 and sum(ids.values()) == sum(1 for k in range(200) if (k % 2 or k == 4) and zlib.crc32(str(k).encode()) % 5)


def test_ngrams_tell_toxic_texts():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = [" ".join(word() for _ in range(60)) + (" zzqqxx" if k % 2 else "") for k in range(120)]
    model = toxicity.fit([np.unique(toxicity.ngrams(t.encode())) for t in texts], np.array([k % 2 for k in range(120)]))
    scores = toxicity.score_texts([t.encode() for t in texts], model)
    assert min(scores[1::2]) > 0.5 > max(scores[::2])
    # Scaled by the ratio: an n-gram of toxic texts alone has a positive weight.
    assert model["weights"][np.isin(model["buckets"], toxicity.ngrams(b"zzqqxx"))].max() > 0


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(4)
    known = quality.unit(rng.normal(size=(50, 8)))
    labels = (rng.random(50) < 0.5).astype(np.float32)
    some = quality.unit(rng.normal(size=(300, 8)))
    got = quality.vote(some, {"vectors": known, "labels": labels, "prior": 0.3})
    for v, x in zip(some, got, strict=True):
        cosine = known @ v
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0)
        assert abs(x - (weight @ labels[near]) / weight.sum()) < 1e-4
    assert quality.vote(np.zeros((1, 8), np.float32), {"vectors": known, "labels": labels, "prior": 0.3})[0] == 0.3


def test_term_counts():
    assert not quality.term_counts(b"").any()
    assert quality.term_counts(b"the the cat the the the")[-1] == 3
    assert (quality.term_counts(b"ab cd") == quality.term_counts(b"xyz qrs")).all()


def test_the_model_of_tables_is_that_of_texts(spark, monkeypatch):
    """Counting on executors chooses what counting here does, and long texts don't reach the driver."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    texts = [" ".join(word() for _ in range(80)) + (" zzqqxx vile" if k % 3 == 0 else "") for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)], "doc_id long, toxic int")
    import zlib

    known = [k for k in range(150) if zlib.crc32(str(k).encode()) % 5]
    want = toxicity.fit([np.unique(toxicity.ngrams(texts[k].encode())) for k in known], np.array([int(k % 3 == 0) for k in known]))
    got = toxicity.train(docs, labels)
    assert (got["buckets"] == want["buckets"]).all() and np.allclose(got["weights"], want["weights"], atol=1e-5) and abs(got["bias"] - want["bias"]) < 1e-6
    monkeypatch.setattr(toxicity, "FEATURES", 10)
    few = toxicity.train(docs, labels)
    assert len(few["buckets"]) == 10 and set(few["buckets"]) <= set(want["buckets"])


def test_long_texts_cost_the_driver_no_more(spark):
    """Texts of 10 MB and of 1 KB: what reaches the driver has the same size."""
    import string

    rng = np.random.default_rng(6)
    letters = np.frombuffer(string.ascii_lowercase.encode() + b"    ", np.uint8)
    texts = [rng.choice(letters, n).tobytes().decode() for n in (10_000_000, 1000, 10_000_000, 1000, 2000, 3000)]
    docs = spark.createDataFrame([(k, t + " vile") for k, t in enumerate(texts)] + [(k, "plain words " + str(k)) for k in range(6, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 6)) for k in range(30)], "doc_id long, toxic int")
    sizes = []
    solve = toxicity.solve
    toxicity.solve = lambda cols, *rest: sizes.append([len(c) for c in cols]) or solve(cols, *rest)
    try:
        model = toxicity.train(docs, labels)
    finally:
        toxicity.solve = solve
    assert len(model["buckets"]) <= toxicity.FEATURES and max(sizes[0]) <= toxicity.FEATURES


def test_ranges_of_features_change_nothing(monkeypatch):
    rng = np.random.default_rng(7)
    cols = [np.unique(rng.integers(0, 40, rng.integers(0, 20))) for _ in range(60)]
    y, used, r = (rng.random(60) < 0.4).astype(np.int64), np.arange(40), rng.normal(size=40)
    one, parts = toxicity.solve(cols, y, used, r), toxicity.parts
    monkeypatch.setattr(toxicity, "parts", lambda c: parts(c, 15))
    many = toxicity.solve(cols, y, used, r)
    assert np.allclose(one["weights"], many["weights"], atol=1e-6) and abs(one["bias"] - many["bias"]) < 1e-9


def test_scores_are_those_of_plain_python(spark, sf):
    """The registered query against a model that is fitted and applied text by text in Python."""
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    known: dict = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.toxic is not None and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 5:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.toxic)
    grams = lambda t: {f" {t.lower()} "[i : i + n] for n in toxicity.ORDERS for i in range(len(t) + 3 - n)}

    def bucket(g):
        h = len(g)
        for c in g:
            h = (h * 1_000_003 + ord(c)) % 2**64
        return (h * 0x9E3779B97F4A7C15 % 2**64) >> 44

    features = {k: np.array(sorted({bucket(g) for g in grams(docs[k] or "")}), np.int64) for k in docs}
    ids = sorted(known)
    model = toxicity.fit([features[k] for k in ids], np.array([known[k] for k in ids]))
    weight = dict(zip(model["buckets"].tolist(), model["weights"].tolist(), strict=True))
    import __spark_entry__ as e

    for r in e.queries()["op3_toxicity"](spark, sf).collect():
        z = model["bias"] + sum(weight.get(b, 0.0) for b in features[r.doc_id].tolist())
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-4


def test_words_alone_tell_quality(spark):
    """Good and bad texts of the same typography, which differ in some of their words."""
    rng = np.random.default_rng(8)
    common = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    bad, good = [["".join(rng.choice(list(x), 5)) for _ in range(40)] for x in ("mnopq", "rstuv")]
    texts = [" ".join(rng.choice(common if rng.random() < 0.6 else good if k % 2 else bad) for _ in range(60)) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    got = [r for r in quality.classify(docs, labels).collect() if r.held_out]
    assert len(got) > 80 and np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95


def test_other_characters_are_classes_of_their_own():
    others = [c for c in range(128) if not chr(c).isalnum() and chr(c) not in " \t\r\n\v\f"]
    assert len(set(quality.CLASSES[others].tolist())) == len(others) and not set(quality.CLASSES[others].tolist()) & {0, 1, 2, 3}


def test_quality_scores_are_those_of_plain_python(spark, sf):
    """The registered query against the labelled texts' vectors, with each text's cosines taken one by one."""
    import zlib

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    known: dict = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.quality is not None and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.quality)
    ids = sorted(known)
    model = quality.fit(np.stack([quality.counted(docs[k]) for k in ids]), np.array([known[k] for k in ids]))
    import __spark_entry__ as e

    for r in e.queries()["op4_quality"](spark, sf).collect():
        v = quality.unit(quality.weighted(quality.counted(docs[r.doc_id])[None], model["idf"]) @ model["projection"])[0]
        if not v.any():
            continue
        cosine = model["vectors"] @ v
        least = np.sort(cosine)[-quality.NEIGHBOURS]
        near = cosine >= least - 1e-5
        want = np.maximum(cosine[near], 0) @ model["labels"][near] / np.maximum(cosine[near], 0).sum()
        assert abs(r.score - want) < 2e-2
