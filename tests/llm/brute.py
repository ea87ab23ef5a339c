"""Plain Python versions of what the operators compute, and frames with odd rows and columns."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, n=10) -> list[tuple]:
    """(doc_id, n_words, n_hit, item ids) of (doc_id, text) and (item_id, text)."""
    wins = []
    for item, text in items:
        w = words(text)
        wins += [(item, w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, x in wins:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    if item is not None:
                        ids.add(str(item))
        out.append((doc, len(w), len(hit), tuple(sorted(ids))))
    return out


def simhash(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(s.encode("utf-8"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int], ids: list, radius=4) -> list:
    """The smallest id reachable from each row."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[root(i)].append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(fps))]


def odd_documents(spark, more=()):
    """Nulls in any column, empty and long texts, ties, repeated rows, and further columns whose names the operators use
    inside."""
    long = " ".join(f"word{i % 997} Runs" for i in range(60_000))
    rows = [
        (1, "some words stand here and some others stand there as well", "en", "src1", 10),
        (2, "", "de", None, 0),
        (3, None, None, "src2", None),
        (None, "an id is null", "en", "src1", 5),
        (5, long, "en", "src1", len(long)),
        (6, "É ü ñ 漢字 \U0001f600 tail\u0000\n\r\t", "fr", "other", 3),
        (7, "   \n\t ", "es", "src3", 6),
        (1, "some words stand here and some others stand there as well", "en", "src1", 10),
        (8, "some words stand here and some others stand there as well", "en", "src1", 10),
        *more,
    ]
    rows = [(*r, "x", 1, "y", 2) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, fp long, media string, score int")


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"
