"""Licence scans: an exact set-similarity join of text blocks with licence templates.

A template's set of words is ordered by how many documents of the whole table hold each word, rarest first. A block that
holds the share THRESHOLD of them must hold one of the first few (prefix filter) and must have words enough (length filter);
at each place of the order, what is shared so far and what is left of the template must suffice (positional filter). What
passes is counted exactly. Blocks of a template of m words are the windows of 2 m words that begin at multiples of m, so a run of
up to m + 1 words lies in a block wherever it stands. Notices are looked for at every start: a count of the distinct words
that the window holds slides along the text, so none is lost by where it stands.

A short notice that lacks a word may be another's: released under the Apache license holds four of the five words of the MIT
notice. So NAMING lists the words without which a block is not a template's.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts, utf8, words

THRESHOLD = 0.8

#: Phrases, word by word, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening passages of well-known licences and the usual notices. The label says what a block is.
TEMPLATES = {
    "notice:apache": "Licensed under the Apache License, Version 2.0",
    "notice:cc-by-nc": "Licensed under CC BY-NC 4.0",
    "notice:gpl": "This work is licensed under the GNU General Public License, version 3",
    "notice:mit": "Released under the MIT License",
    "text:apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "text:bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "text:gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "text:isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "text:mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
}


#: Words that must be in a block of the template of a label, whatever share it holds.
NAMING = {"notice:apache": "apache", "notice:cc-by-nc": "cc nc", "notice:gpl": "general public", "notice:mit": "mit"}


@dataclass(frozen=True)
class Template:
    label: str
    size: int  # its words, repeats included
    order: tuple[bytes, ...]  # its distinct words, rarest first
    least: int  # how many of them a block must hold
    naming: frozenset[bytes] = frozenset()  # those that it must hold in any case

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.order[: len(self.order) - self.least + 1]


def template(label: str, text: str, frequency: dict[bytes, int], threshold: float, naming: str = "") -> Template:
    w = words(utf8(text))
    order = tuple(sorted(set(w), key=lambda x: (frequency.get(x, 0), x)))
    # Not a hair more than the share asks for.
    return Template(label, len(w), order, max(1, math.ceil(threshold * len(order) - 1e-9)), frozenset(words(utf8(naming))))


def frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many rows of the whole table each word of the vocabulary occurs; one row a word reaches the driver."""

    def rows(batch: pa.RecordBatch) -> dict:
        n: Counter[bytes] = Counter()
        for data in texts(batch["text"]):
            n.update(vocabulary.intersection(words(data)))
        return {"word": list(n), "n": list(n.values())}

    counted = arrow_map(docs.select(F.col(text).alias("text")), rows, "word binary, n long")
    return {bytes(r[0]): r[1] for r in counted.groupBy("word").agg(F.sum("n")).collect()}


class Scanner:
    """Phrases and templates, ready for texts."""

    def __init__(self, templates: list[Template], phrases: dict[str, str]):
        self.templates = [t for t in templates if t.order]
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.index: dict[bytes, list[int]] = {}
        for k, t in enumerate(self.templates):
            for w in t.prefix:
                self.index.setdefault(w, []).append(k)

    def places(self, w: list[bytes]) -> list[tuple[int, str]]:
        """(number of the first word, label) wherever a phrase stands."""
        norm, out = b" " + b" ".join(w) + b" ", []
        for phrase, label in self.phrases:
            at, word, seen = norm.find(phrase), 0, 0
            while at >= 0:
                word += norm.count(b" ", seen, at)
                seen = at
                out.append((word, label))
                at = norm.find(phrase, at + 1)
        return sorted(out)

    def blocks(self, w: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, words, containment) of every block that meets a template's threshold."""
        if self.index.keys().isdisjoint(w):
            return []
        candidates: dict[tuple[int, int], None] = {}
        for i, x in enumerate(w):
            for k in self.index.get(x, ()):
                m = self.templates[k].size
                candidates[k, i // m] = None
                if i >= m:
                    candidates[k, i // m - 1] = None
        out = []
        for k, j in sorted(candidates):
            t = self.templates[k]
            block = set(w[j * t.size : (j + 2) * t.size])
            if len(block) < t.least:
                continue
            held = 0
            for at, x in enumerate(t.order):
                held += x in block
                if held + len(t.order) - at - 1 < t.least:
                    break
            else:
                if held >= t.least and t.naming <= block:
                    out.append((t.label, j * t.size, len(w[j * t.size : (j + 2) * t.size]), held / len(t.order)))
        return out

    def notices(self, w: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, words, containment) of each template's fullest window of 2 m words at any start, the first of
        equals, if it meets the threshold."""
        have = set(w)
        out = []
        for k in sorted({k for x in have & self.index.keys() for k in self.index[x]}):
            t = self.templates[k]
            wanted = have.intersection(t.order)
            if len(wanted) < t.least or not t.naming <= have:
                continue
            width, inside, best, first = 2 * t.size, deque(), 0, 0
            counts: dict[bytes, int] = {}
            for i, x in enumerate(w):
                if x not in wanted:
                    continue
                while inside and inside[0] <= i - width:
                    old = w[inside.popleft()]
                    if counts[old] == 1:
                        del counts[old]
                    else:
                        counts[old] -= 1
                inside.append(i)
                counts[x] = counts.get(x, 0) + 1
                if len(counts) > best and t.naming <= counts.keys():
                    best, first = len(counts), max(0, i - width + 1)
            if best >= t.least:
                out.append((t.label, first, len(w[first : first + width]), best / len(t.order)))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, *, naming: dict[str, str] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, phrases (first word and label of each place), blocks (label, first word, words, containment) and notices
    (the same, of each template's fullest window at any start) per row.

    Only `id` and `text` are read, so other columns may have any name. A null, empty or wordless text has no words, places,
    blocks or notices; repeated rows each give a row; a null id stays null; an empty table gives none. A template without words
    finds nothing; one word's ties in frequency go by the word. `naming`: as NAMING, of the templates' own words.
    """
    naming = naming if naming is not None else NAMING if templates is None else {}
    templates, phrases = TEMPLATES if templates is None else templates, BASE if phrases is None else phrases
    vocabulary = {w for t in templates.values() for w in words(utf8(t))}
    frequency = frequencies(docs, vocabulary, text) if vocabulary else {}
    scanner = Scanner([template(label, t, frequency, threshold, naming.get(label, "")) for label, t in templates.items()], phrases)

    listed = lambda found: [{"label": a, "word": b, "n": c, "containment": d} for a, b, c, d in found]

    def rows(batch: pa.RecordBatch) -> dict:
        w = [words(x) for x in texts(batch["text"])]
        return {
            "id": batch["id"],
            "n_words": [len(x) for x in w],
            "phrases": [[{"word": i, "label": label} for i, label in scanner.places(x)] for x in w],
            "blocks": [listed(scanner.blocks(x)) for x in w],
            "notices": [listed(scanner.notices(x)) for x in w],
        }

    read = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    found = "array<struct<label: string, word: long, n: long, containment: double>>"
    made = arrow_map(read, rows, f"id long, n_words long, phrases array<struct<word: long, label: string>>, blocks {found}, notices {found}")
    return made.withColumnRenamed("id", id)


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, own = F.col("phrases.label"), F.col("notices.label")
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        F.col("doc_id"),
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"),
        F.array_max("phrases.word").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, own)).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("notices.containment"), F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    split = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    quoted = lambda x: "'" + x.decode() + "'"
    place = lambda p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(re.split(" ", p)))
    places = " UNION ALL ".join(f"SELECT k, i - 1 AS word, '{label}' AS label FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {place(p)}" for p, label in BASE.items())
    made = [template(label, t, {}, THRESHOLD, NAMING.get(label, "")) for label, t in TEMPLATES.items()]
    listed = lambda x: f"[{', '.join(map(quoted, sorted(x)))}]"
    # A fullest window can begin with a word of the template.
    blocks = " UNION ALL ".join(
        f"SELECT k, '{t.label}' AS label, len(list_intersect(list_distinct(b), {listed(t.order)})) AS held, {len(t.order)} AS size, {t.least} AS least FROM (SELECT k, w[i : i + {2 * t.size - 1}] AS b FROM starts WHERE x IN ({', '.join(map(quoted, t.order))}))"
        + (f" WHERE list_has_all(b, {listed(t.naming)})" if t.naming else "")
        for t in made
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {split} AS w FROM documents),
place AS ({places}),
starts AS (SELECT k, w, i, w[i] AS x FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
block AS (SELECT k, label, held / size AS share FROM ({blocks}) WHERE held >= least),
p AS (SELECT k, count(*) AS n, min(word) AS a, max(word) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY k),
l AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM place UNION ALL SELECT k, label FROM block) GROUP BY k),
s AS (SELECT k, max(share) AS share FROM block GROUP BY k)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n, 0) AS BIGINT) AS n_base, cast(a AS BIGINT) AS first_word, cast(b AS BIGINT) AS last_word,
       coalesce(p.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
       CASE WHEN n > 0 THEN cast(1 AS DOUBLE) ELSE coalesce(share, cast(0 AS DOUBLE)) END AS score
FROM d LEFT JOIN p USING (k) LEFT JOIN l USING (k) LEFT JOIN s USING (k)
"""


OP9_SQL = _sql()
