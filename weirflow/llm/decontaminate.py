"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, and one scan of each text.

The automaton holds every window of consecutive item words, as text between single spaces. A document is normalised the
same way, byte for byte, and scanned once; a match's place gives the numbers of its words, and from those the offsets in
the original text.

A benchmark whose windows are over BLOCK_BYTES, too large for one automaton in a worker, is a table of windows by 128-bit
hash instead. Texts are still scanned once: a Bloom filter of fixed size passes on the places whose windows may be in the
table, and a join by hash keeps those that are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, arrow_map, bounded_batches, utf8, words, written

WINDOW = 10
#: Bytes of windows that the automaton, and its broadcast, hold at most; those of larger benchmarks are joined by hash.
BLOCK_BYTES = 32 << 20
#: Bits of the Bloom filter for larger benchmarks, in so many slices, and bits set for a window. It is 16 MB, whatever is in it.
BLOOM_BITS, BLOOM_SLICES, BLOOM_HASHES = 1 << 27, 32, 3
#: Ids of texts up to which contaminated ones are broadcast, 16 bytes each; the rows of more are found by a shuffle.
MOST_BROADCAST = 500_000

SCANNED = "n_words long, hits array<struct<first: long, last: long>>, item_ids array<string>"


def windows(text: str | bytes | None, n: int = WINDOW) -> list[bytes]:
    """Each n consecutive words; all words where there are fewer; nothing where there are none."""
    w = words(utf8(text))
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def automaton(items: Iterable[tuple[str | None, str | bytes | None]], n: int = WINDOW):
    """Aho-Corasick automaton; a window's value is its word count, its length and its items' ids."""
    import ahocorasick

    found: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(text, n):
            ids = found.setdefault(w, set())
            if item is not None:
                ids.add(item)
    a = ahocorasick.Automaton()
    for w, ids in found.items():
        key = f" {w.decode('latin-1')} "
        a.add_word(key, (w.count(b" ") + 1, len(key), tuple(sorted(ids))))
    if found:
        a.make_automaton()
    return a if found else None


def scan(data: bytes, a) -> tuple[int, list[tuple[int, int]], list[str]]:
    """The count of words, the disjoint runs of hit words (both ends included) and the sorted ids of items found."""
    w = words(data)
    if a is None or not w:
        return len(w), [], []
    norm = f" {b' '.join(w).decode('latin-1')} "
    runs: list[tuple[int, int]] = []
    ids: set[str] = set()
    at = word = 0
    for end, (count, length, items) in a.iter(norm):
        start = end - length + 1
        if start >= at:
            word += norm.count(" ", at, start)
            first = word
        else:  # a longer window that began before the last one
            first = word - norm.count(" ", start, at)
        at, word = max(at, start), max(word, first)
        runs.append((first, first + count - 1))
        ids.update(items)
    runs.sort()
    merged: list[tuple[int, int]] = []
    for first, last in runs:
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return len(w), merged, sorted(ids)


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words, ends excluded."""
    if not runs:
        return []
    data = utf8(text)
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(WORD_BYTES))]
    # An offset in bytes becomes one in characters by leaving out the bytes that continue a character.
    extra = [i for i, c in enumerate(data) if c & 0xC0 == 0x80]
    return [(places[a][0] - bisect_right(extra, places[a][0] - 1), places[b][1] - bisect_right(extra, places[b][1] - 1)) for a, b in runs]


def few(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, item_id: str = "item_id", text: str = "text") -> list[tuple[str | None, bytes]] | None:
    """The distinct items, if their windows are at most `block_bytes`; else None. A window of ten words takes about ten times
    the room of its text."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("data")).distinct()
    size = items.agg(F.sum(10 * F.coalesce(F.octet_length("data"), F.lit(0)) + 64)).first()[0] or 0
    return [(item, bytes(data or b"")) for item, data in items.collect()] if size <= block_bytes else None


def prepared(items: list[tuple[str | None, bytes]], df: DataFrame, n: int):
    """The items for the executors; the first task in a worker builds the automaton, and the worker keeps it."""
    held = df.sparkSession.sparkContext.broadcast({"items": items})

    def get():
        kept = held.value
        if n not in kept:
            kept[n] = automaton(kept["items"], n)
        return kept[n]

    return get


def hashed(window: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(window)


def window_table(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(h, n, item): the hash and word count of each window and an item that has it; distinct, written."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.binary()), ("n", pa.int32()), ("item", pa.string())])
        for batch in batches:
            for item, data in zip(batch["item"].to_pylist(), batch["data"].to_pylist(), strict=True):
                found = set(windows(data, n))
                yield pa.RecordBatch.from_pydict({"h": [hashed(w) for w in found], "n": [w.count(b" ") + 1 for w in found], "item": [item] * len(found)}, schema=schema)

    bounded_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("data"))
    return written(items.mapInArrow(rows, "h binary, n int, item string").distinct(), "benchmark-windows")


def bloom_places(h: bytes) -> list[int]:
    """The bits of a hash."""
    a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
    return [(a + k * b) % BLOOM_BITS for k in range(BLOOM_HASHES)]


def bloom(table: DataFrame) -> list[bytes]:
    """The filter's slices, made by a task each; the driver gets BLOOM_BITS / 8 bytes, however many windows there are."""
    width = BLOOM_BITS // BLOOM_SLICES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([x for h in batch["h"] for x in bloom_places(h.as_py())], np.int64)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(at // width, pa.int32()), "at": pa.array(at % width, pa.int32())})

    def fill(table: pa.Table) -> pa.Table:
        flags = np.zeros(width, bool)
        flags[table["at"].to_numpy()] = True
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    # Distinct places first, so that a slice's task gets no more than its bits.
    at = table.select("h").distinct().mapInArrow(rows, "slice int, at int").distinct()
    made = {r[0]: bytes(r[1]) for r in at.groupBy("slice").applyInArrow(fill, "slice int, bits binary").collect()}
    return [made.get(k, bytes(width // 8)) for k in range(BLOOM_SLICES)]


def candidates(data: bytes | None, sizes: list[int], bits: bytes) -> tuple[int, list[dict]]:
    """The count of words, and each window that the filter passes: its first word, its word count and its hash."""
    w, out = words(data or b""), []
    norm = b" ".join(w)
    starts = list(accumulate((len(x) + 1 for x in w), initial=0))
    for n in sizes:
        for i in range(len(w) - n + 1):
            h = hashed(norm[starts[i] : starts[i + n] - 1])
            if all(bits[x >> 3] >> (x & 7) & 1 for x in bloom_places(h)):
                out.append({"first": i, "n": n, "h": h})
    return len(w), out


def joined_hits(scanned: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """(keys, hits, item_ids) of the rows of `scanned` that hold a window of the table; each row of `keys` is one text."""
    # One row a window, with all its items, so that a frequent window meets one row of the table.
    items = table.groupBy("h", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))
    places = scanned.select(*keys, F.explode("found").alias("c")).select(*keys, F.col("c.first").alias("first"), F.col("c.n").alias("n"), F.col("c.h").alias("h"))
    hit = places.join(items, ["h", "n"])
    return hit.groupBy(*keys).agg(F.collect_set(F.struct("first", (F.col("first") + F.col("n") - 1).alias("last"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))


FOUND = "n_words long, found array<struct<first: long, n: int, h: binary>>"


def by_hash(docs: DataFrame, benchmark: DataFrame, n: int, id: str, text: str) -> DataFrame:
    """(id, text, n_words, hits, item_ids) by the table of windows."""
    table = window_table(benchmark, n)
    sizes = sorted(r[0] for r in table.select("n").distinct().collect())  # 1 to n
    held = docs.sparkSession.sparkContext.broadcast(b"".join(bloom(table)))

    def rows(batch: pa.RecordBatch) -> dict:
        made = [candidates(x, sizes, held.value) for x in batch["text"].cast(pa.binary()).to_pylist()]
        return {"id": batch["id"], "text": batch["text"], "n_words": [c for c, _ in made], "found": [f for _, f in made]}

    read = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    scanned = arrow_map(read, rows, f"id {read.schema['id'].dataType.simpleString()}, text string, {FOUND}")
    # Written, so that a row keeps its number.
    scanned = written(scanned.withColumn("scan_row", F.monotonically_increasing_id()), "scanned")
    hits = joined_hits(scanned, table, "scan_row")
    kind = "array<struct<first: long, last: long>>"

    def merged(batch: pa.RecordBatch) -> dict:
        runs = [[{"first": a, "last": b} for a, b in joined([(r["first"], r["last"]) for r in x])] for x in batch["runs"].to_pylist()]
        return {"hit_row": batch["scan_row"], "hits": runs, "item_ids": batch["item_ids"]}

    hits = arrow_map(hits, merged, f"hit_row long, hits {kind}, item_ids array<string>")
    out = scanned.join(hits, F.col("scan_row") == F.col("hit_row"), "left")
    none = lambda c, t: F.coalesce(c, F.expr(f"cast(array() as {t})")).alias(c)
    return out.select("id", "text", "n_words", none("hits", kind), none("item_ids", "array<string>"))


def find_items(docs: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, block_bytes: int = BLOCK_BYTES, id: str = "doc_id", text: str = "text", with_spans: bool = False) -> DataFrame:
    """Per row of `docs`: id, n_words, hits (runs of hit word numbers), item_ids; with_spans: and their character spans.

    Only the columns `id` and `text` are read, so others may have any name. A null or empty text, or one without words,
    has no words and no hits; a null id stays null; repeated rows each give a row. An item without words is never found;
    an item whose id is null hits words but is not listed. An empty benchmark finds nothing.
    """
    read = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind, items = read.schema["id"].dataType.simpleString(), few(benchmark, block_bytes)
    if items is None:
        out = by_hash(docs, benchmark, n, id, text)
    else:
        get = prepared(items, docs, n)

        def rows(batch: pa.RecordBatch) -> dict:
            a, made = get(), {"id": batch["id"], "n_words": [], "hits": [], "item_ids": []}
            if with_spans:
                made["text"] = batch["text"]
            for data in batch["text"].cast(pa.binary()).to_pylist():
                count, runs, found = scan(data or b"", a)
                made["n_words"].append(count)
                made["hits"].append([{"first": x, "last": y} for x, y in runs])
                made["item_ids"].append(found)
            return made

        out = arrow_map(read, rows, f"id {kind}, {SCANNED}" + (", text string" if with_spans else ""))
    if with_spans:

        def located(batch: pa.RecordBatch) -> dict:
            hits = [[(h["first"], h["last"]) for h in x] for x in batch["hits"].to_pylist()]
            made = [[{"start": a, "end": b} for a, b in spans(t or "", h)] for t, h in zip(batch["text"].to_pylist(), hits, strict=True)]
            return {"id": batch["id"], "n_words": batch["n_words"], "hits": batch["hits"], "item_ids": batch["item_ids"], "spans": made}

        return arrow_map(out, located, f"id {kind}, {SCANNED}, spans array<struct<start: long, end: long>>").withColumnRenamed("id", id)
    return out.select(F.col("id").alias(id), "n_words", "hits", "item_ids")


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns kept, whose text holds no window of any item. A null or empty text stays, repeated rows
    stay or go together, and columns may have any names."""
    bounded_batches(docs.sparkSession)
    items = few(benchmark, block_bytes)
    if items is None:
        return without_hashed(docs, benchmark, n, text)
    get = prepared(items, docs, n)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = get()
        for batch in batches:
            keep = [not scan(x or b"", a)[1] for x in batch[text].cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def without_hashed(docs: DataFrame, benchmark: DataFrame, n: int, text: str) -> DataFrame:
    """The same by the table of windows: which texts go is told by 128-bit digests of the texts."""
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    key = next(x for k in range(len(docs.columns) + 1) if (x := f"text_key_{k}") not in {c.lower() for c in docs.columns})
    hits = by_hash(docs.select(digest.alias("text_id"), F.col(text).alias("text")), benchmark, n, "text_id", "text")
    gone = written(hits.where(F.size("hits") > 0).select(F.col("id").alias(key)).distinct(), "contaminated-texts")
    few_texts = gone.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few_texts else gone, digest == F.col(key), "left_anti")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT cast(item_id AS VARCHAR) AS item, least(len(w), {WINDOW}) AS n,
         array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
doc AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
place AS (
  SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT place.k, place.i, place.n, win.item FROM place JOIN win ON place.n = win.n AND place.g = win.g),
hit_words AS (
  SELECT k, count(DISTINCT p) AS n_hit
  FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM hit)) GROUP BY k),
hit_items AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, item FROM hit WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (k) LEFT JOIN hit_items USING (k)
"""
