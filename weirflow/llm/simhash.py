"""SimHash near-duplicates: fingerprints, and BK-trees that find every pair of them within a few bits.

Fingerprints that differ in at most R bits agree in all bits of at least K - R of any K blocks. So for each choice of
K - R blocks, those that agree in them form a shard. Each shard has a BK-tree, whose children are keyed by their Hamming
distance to the parent; a search follows the edges within the radius only. Trees are built where their shard was shuffled
to, so neither a tree nor all fingerprints reach the driver. A shard gives a spanning forest of its links, which keeps
what is reachable without a row for each pair.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, texts, written

RADIUS = 4
SHINGLE = 4
#: Fingerprints in a shard, on average, that the count of blocks is chosen for.
SHARD_MEAN = 64
#: A larger shard is dealt out by further blocks of its free bits, unless only FREE_BITS are left: then it has at most
#: 2 ** FREE_BITS fingerprints.
SHARD_MOST = 20_000
FREE_BITS = 14
#: Ids up to which they are broadcast, 8 bytes each, to remove their rows: 16 MB as a hash table. More are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Rows from which a key is hot: what belongs to it is broadcast. There are at most a HOT_ROWS-th as many hot keys as rows.
HOT_ROWS = 1_000_000


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 values (seed 42) of all shingles; 0 if there are no words."""
    from xxhash import xxh64_intdigest

    w = data.lower().split()
    if not w:
        return 0
    norm = b" ".join(w)
    starts = list(accumulate((len(x) + 1 for x in w), initial=0))
    if len(w) < shingle:
        return xxh64_intdigest(norm, 42)
    hashes = [xxh64_intdigest(norm[a : b - 1], 42) for a, b in zip(starts, starts[shingle:], strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): each row's fingerprint as a signed 64-bit integer."""
    rows = lambda b: {"id": b["id"], "fp": pa.array([signed(fingerprint(x)) for x in texts(b["text"])], pa.int64())}
    return arrow_map(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), rows, "id long, fp long")


def forest(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, root) for the members, but for the root, of each component of a shard's links; fingerprints are unsigned.

    Breadth first over a BK-tree: who is found leaves the tree, and subtrees that all have left are not entered, so a dense
    group costs little more than its size.
    """
    children: list[dict[int, int]] = [{}]
    parent, alive, gone = [-1], [1], [False]
    for x in fps[1:]:
        at = 0
        while True:
            alive[at] += 1
            d = (x ^ fps[at]).bit_count()
            below = children[at].get(d)
            if below is None:
                children[at][d] = len(parent)
                break
            at = below
        children.append({})
        parent.append(at)
        alive.append(1)
        gone.append(False)
    out = []
    for root in range(len(fps)):
        if gone[root]:
            continue
        found = [root]
        at, gone[root] = root, True
        while at >= 0:
            alive[at] -= 1
            at = parent[at]
        for q in found:  # grows as it goes
            x, todo = fps[q], [0]
            while todo:
                i = todo.pop()
                if not alive[i]:
                    continue
                d = (x ^ fps[i]).bit_count()
                if d <= radius and not gone[i]:
                    found.append(i)
                    out.append((fps[i], fps[root]))
                    at, gone[i] = i, True
                    while at >= 0:
                        alive[at] -= 1
                        at = parent[at]
                todo += [c for k, c in children[i].items() if -radius <= k - d <= radius]
    return out


def parts(free: int, k: int) -> list[int]:
    """The set bits of `free` as k masks of nearly equal size."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << b for b in bits[len(bits) * j // k : len(bits) * (j + 1) // k]) for j in range(k)]


def shard_masks(n: int, radius: int = RADIUS, mean: int = SHARD_MEAN) -> list[int]:
    """Masks of agreeing blocks; as many blocks as keep a shard of n fingerprints, if they were random, below `mean`."""
    every = (1 << 64) - 1
    k = next((k for k in range(radius + 1, 2 * radius + 1) if n / 2 ** (64 * (k - radius) / k) <= mean), 2 * radius)
    return [sum(x) for x in combinations(parts(every, k), k - radius)]


def by_mask(nodes: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for m in masks])
    return nodes.select("fp", F.explode(keys).alias("key")).select("fp", "key.mask", "key.value")


def links(nodes: DataFrame, radius: int = RADIUS, most: int = SHARD_MOST, mean: int = SHARD_MEAN) -> DataFrame:
    """(u, v) with u > v: a spanning forest of the links in every shard. `nodes`: distinct fingerprints fp."""
    keyed, out = by_mask(nodes, shard_masks(nodes.count(), radius, mean)), None
    spark = nodes.sparkSession

    def trees(batch: pa.RecordBatch) -> dict:
        pairs = [(signed(a), signed(b)) for fps in batch["fps"].to_pylist() for a, b in forest(sorted({x & (1 << 64) - 1 for x in fps}), radius)]
        return {"u": [max(p) for p in pairs], "v": [min(p) for p in pairs]}

    while True:
        sizes = keyed.groupBy("mask", "value").count().where(F.col("count") > 1)
        sizes = sizes.where((F.col("count") > most) & (F.bit_count("mask") < 64 - FREE_BITS))
        sizes = written(sizes.select("mask", "value"), "simhash-large")
        masks = [r[0] & (1 << 64) - 1 for r in sizes.select("mask").distinct().toLocalIterator()]
        small = keyed.join(sizes, ["mask", "value"], "left_anti") if masks else keyed
        shards = small.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        made = arrow_map(shards.select("fps"), trees, "u long, v long")
        out = made if out is None else out.union(made)
        if not masks:
            return out.distinct()
        # Members of a large shard still agree in at least one of radius + 1 parts of their free bits.
        children = [(signed(m), signed(m | p)) for m in masks for p in parts(~m & (1 << 64) - 1, radius + 1)]
        deeper = spark.createDataFrame(children, "mask long, child long")
        large = keyed.join(sizes, ["mask", "value"], "left_semi")
        keyed = written(large.join(deeper, "mask").select("fp", F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("value")), "simhash-deeper")


def with_value(rows: DataFrame, keyed: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """The inner join of `rows` with `keyed`, whose `key` is unique and whose n counts its rows. The values of hot keys are
    broadcast, so that no task gets all rows of one. `total`: rows at most, where that is known; few rows have no hot key."""
    plain = rows.join(keyed.drop("n"), key)
    if total is not None and total <= HOT_ROWS:
        return plain
    keyed = written(keyed, "simhash-keyed")
    some = keyed.where(F.col("n") > HOT_ROWS).drop("n")
    if some.isEmpty():
        return rows.join(keyed.drop("n"), key)
    others = rows.join(F.broadcast(some.select(key)), key, "left_anti").join(keyed.drop("n"), key)
    return rows.join(F.broadcast(some), key).unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each linked node but the smallest of its component, and that smallest. Large-star and small-star by turns."""
    edges, before = written(edges, "simhash-links"), None
    total = 2 * edges.count()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = written(with_value(both, least, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "simhash-large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_value(large, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, written(small, "simhash-small-star")
        discard(last, large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges
        before, total = now, 2 * now[0]


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", radius: int = RADIUS, most: int = SHARD_MOST, mean: int = SHARD_MEAN) -> DataFrame:
    """(id, fp, component_id) per row of `docs`; component_id is the smallest id reachable over links.

    Only `id` (cast to long) and `text` are read, so other columns may have any name. Null, empty and blank texts have
    fingerprint 0 and are linked like any other. Repeated rows each give a row. A null id stays null; it is never the
    smallest while another id is reachable, and component_id is null where none is. An empty table gives none.
    """
    fps = written(fingerprints(docs, id=id, text=text), "simhash-fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n")), "simhash-nodes")
    stars = components(links(nodes.select("fp"), radius, most, mean))
    # Of the linked only; any other fingerprint is a component of its own.
    roots = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    smallest = roots.join(nodes, "fp").groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = roots.join(smallest, "root").select("fp", "component_id")
    labels = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least_id").alias("component_id"))
    labels = written(labels, "simhash-labels")
    discard(stars, nodes)
    return with_value(fps, labels, "fp", fps.count()).select(F.col("id").alias(id), "fp", "component_id")


def one_of_each_group(docs: DataFrame, *, most_broadcast: int = MOST_BROADCAST, **options) -> DataFrame:
    """The rows of `docs`, all columns kept, whose id is the smallest of their component; of rows that repeat such an id,
    one of them. Rows whose id is null stay, as nothing tells them apart. Columns may have any names. An empty table gives
    none. Texts are shuffled only if more than `most_broadcast` ids go."""
    id = options.get("id", "doc_id")
    # A name that no column has, whatever the case.
    taken = {c.lower() for c in docs.columns}
    near = next(x for k in range(len(taken) + 1) if (x := f"near_id_{k}") not in taken)
    found = written(near_duplicates(docs, **options).select(F.col(id).alias(near), F.col("component_id").alias("near_component")), "simhash-groups")
    bounded = lambda ids: F.broadcast(ids) if ids.count() <= most_broadcast else ids
    removed = written(found.where(F.col(near) != F.col("near_component")).select(near).distinct(), "simhash-removed")
    repeated = written(found.where(F.col(near) == F.col("near_component")).groupBy(near).count().where("count > 1").select(near), "simhash-repeated")
    discard(found)
    same = F.col(id).cast("long") == F.col(near)
    kept = docs.join(bounded(removed), same, "left_anti")
    if repeated.isEmpty():
        return kept
    repeated = bounded(repeated)
    once = kept.join(repeated, same, "left_semi").dropDuplicates([id])
    return kept.join(repeated, same, "left_anti").unionByName(once)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
