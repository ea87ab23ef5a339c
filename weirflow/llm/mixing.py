"""Mixing to target weights: iterative proportional fitting of token weights to several marginals, then sampling.

Tokens are summed by cell, a combination of the marginals' categories. Categories that no target names are one, OTHER, so
there are at most as many cells as the targets allow, whatever the input. Each sweep scales the cells' factors to meet one
marginal after the other. A document's probability is its cell's factor, scaled so that the largest is 1: then expected
tokens have the target shares exactly. Cells that would have more than MOST times the mean weight, those of categories too
small for their target, are kept whole instead, and the others are fitted without them: else a single document of a rare
category would empty the sample. A document's draw is a hash of its id, so the sample is the same in any run.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .sharding import M32, Bits, Sql, mixed

OTHER = "(other)"
SWEEPS = 40
#: The largest factor, as a multiple of the mean, that the sample is scaled by; so a MOST-th of the tokens stays at least.
MOST = 10.0

Targets = dict[str, dict[str, float]]

#: Words that tell what a text is about; the table has no topics, so common words of its four languages tell how it speaks:
#: of when and where, of what is, or of what for. Other lists are a parameter.
TOPIC_WORDS: dict[str, list[str]] = {
    "time": "was at from on when then before after war bei nach vor als auf im était dans depuis sur quand era desde cuando antes del".split(),
    "state": "is are be it ist sind sein es est sont être ce son ser".split(),
    "aim": "to for with by zu für mit um pour avec par afin para con por".split(),
}

#: Relative weights.
TARGETS: Targets = {
    "source": {**{f"src{k}": 5.0 for k in range(20)}, OTHER: 5.0},
    "lang": {"en": 55.0, "de": 16.0, "fr": 16.0, "es": 13.0, OTHER: 1.0},
    "topic": {"time": 49.0, "state": 25.0, "aim": 25.0, OTHER: 1.0},
}

def topic(text: Column, lists: dict[str, list[str]] | None = None) -> Column:
    """The list of which the text has the most different words, the first of equals; null if it has none of any, or no
    text. Words are runs of digits, ASCII letters and non-ASCII characters of the lower-cased text."""
    lists = TOPIC_WORDS if lists is None else lists
    words = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    # One pass over the words finds those of any list; what is left is short, and is bound to a name by transform().
    every = sorted({w for x in lists.values() for w in x})
    held = F.array_intersect(words, F.array(*map(F.lit, every)))

    def best(h: Column) -> Column:
        n = [F.size(F.array_intersect(h, F.array(*map(F.lit, x)))) for x in lists.values()]
        # More words go first; of as many, the earlier list.
        return F.array_max(F.array(*[F.struct(x.alias("n"), F.lit(-k).alias("k"), F.when(x > 0, name).alias("name")) for k, (x, name) in enumerate(zip(n, lists, strict=True))]))

    return F.transform(F.array(held), best)[0]["name"]


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def categories(values: dict[str, Column], targets: Targets) -> list[Column]:
    """Each marginal's value, or OTHER where it has no target of its own or is null."""
    return [F.coalesce(F.when(v.isin(*[k for k in targets[name] if k != OTHER]), v), F.lit(OTHER)) for name, v in values.items()]


def fit(cells: list[tuple[tuple[str, ...], float]], targets: Sequence[dict[str, float]], sweeps: int = SWEEPS) -> list[float]:
    """Factors of cells, given as (categories, tokens), so that each marginal's tokens have the target shares. Shares are of
    the categories that have tokens; a category that targets don't name gets none."""
    total = sum(n for _, n in cells)
    factors = [1.0] * len(cells)
    goals = []
    for k, goal in enumerate(targets):
        present = sorted({c[k] for c, n in cells if n > 0})
        scale = sum(goal.get(x, 0.0) for x in present)
        goals.append({x: total * goal.get(x, 0.0) / scale if scale else 0.0 for x in present})
    for _ in range(sweeps):
        for k, goal in enumerate(goals):
            now: dict[str, float] = {}
            for (c, n), f in zip(cells, factors, strict=True):
                now[c[k]] = now.get(c[k], 0.0) + n * f
            factors = [f * goal[c[k]] / now[c[k]] if now[c[k]] > 0 else f for (c, _), f in zip(cells, factors, strict=True)]
    return factors


def probabilities(cells: list[tuple[tuple[str, ...], float]], targets: Sequence[dict[str, float]], sweeps: int = SWEEPS, most: float = MOST) -> list[float]:
    """The cells' probabilities: their factors by the largest. Cells whose factor is over `most` times the mean are kept
    whole, largest first, and the share that they leave unmet goes to the others, which are fitted anew."""
    p, rest = [1.0] * len(cells), list(range(len(cells)))
    while True:
        factors = fit([cells[k] for k in rest], targets, sweeps)
        top = max(factors, default=0.0)
        tokens = sum(cells[k][1] for k in rest)
        held = sum(cells[k][1] * f for k, f in zip(rest, factors, strict=True))
        if top * tokens <= most * held or held <= 0:
            break
        # Others may be over only because of the largest.
        rest = [k for k, f in zip(rest, factors, strict=True) if f * tokens <= most * held or f < top / 2]
    for k, f in zip(rest, factors, strict=True):
        p[k] = f / top if top > 0 else 0.0
    return p


def draw(id: Column) -> Column:
    """A number in [0, 1) that the id decides; null counts as -1."""
    key = Bits(F.coalesce(id.cast("bigint"), F.lit(-1).cast("bigint")))
    return mixed((key & M32) ^ mixed(((key >> 32) & M32) ^ 0x2545F491)).column / F.lit(2.0**32)


def calibrated(docs: DataFrame, values: dict[str, Column], tokens: Column, targets: Targets, *, id: str = "doc_id", sweeps: int = SWEEPS) -> DataFrame:
    """mix_row (all columns of `docs`), mix_tokens, mix_groups, mix_p, mix_draw per row.

    `values`: the marginals by the names of `targets`, as expressions on `docs`. A null is of the category OTHER; a
    category without a target weight has probability 0, as have all rows if none has; rows of a category too small for its
    target have probability 1; rows without tokens have their cell's probability; rows that repeat an id have the same draw; null ids count as -1. As rows are packed in one column,
    other columns may have any names. An empty table gives none.
    """
    # The marginals are columns first, as each is used several times.
    rows = docs.select(F.struct("*").alias("mix_row"), tokens.alias("mix_tokens"), *[v.alias(f"mix_{k}") for k, v in enumerate(values.values())], draw(F.col(id)).alias("mix_draw"))
    made = {name: F.col(f"mix_{k}") for k, name in enumerate(values)}
    rows = rows.select("mix_row", "mix_tokens", F.array(*categories(made, targets)).alias("mix_groups"), "mix_draw")
    # At most the product of the targets' sizes, OTHER included.
    most = prod(len(set(targets[name]) | {OTHER}) for name in values)
    cells = sorted((tuple(r[0]), float(r[1])) for r in rows.groupBy("mix_groups").agg(F.sum("mix_tokens")).limit(most + 1).collect())
    assert len(cells) <= most
    made = [(list(c), p) for (c, _), p in zip(cells, probabilities(cells, [targets[name] for name in values], sweeps), strict=True)]
    known = docs.sparkSession.createDataFrame(made, "mix_cell array<string>, mix_p double")
    return rows.join(F.broadcast(known), F.col("mix_groups") == F.col("mix_cell")).drop("mix_cell")


def document_marginals() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}


def mixture(docs: DataFrame, targets: Targets = TARGETS) -> DataFrame:
    """The documents, all columns kept, that the sample takes."""
    rows = calibrated(docs, document_marginals(), token_count(F.col("text")), targets)
    return rows.where("mix_draw < mix_p").select("mix_row.*")


def op7_rake(spark, sf_dir: str) -> DataFrame:
    docs, marginals = spark.read.parquet(f"{sf_dir}/documents.parquet"), document_marginals()
    # The texts are read once, for a table without them.
    narrow = written(docs.select("doc_id", token_count(F.col("text")).alias("tokens"), *[v.alias(k) for k, v in marginals.items()]), "mixing-rows")
    rows = calibrated(narrow, {k: F.col(k) for k in marginals}, F.col("tokens"), TARGETS)
    group = lambda k, name: F.col("mix_groups")[k].alias(name)
    return rows.select(
        F.col("mix_row.doc_id").alias("doc_id"),
        F.col("mix_tokens").alias("n_tokens"),
        group(0, "source_group"),
        group(1, "lang_group"),
        group(2, "topic"),
        F.round("mix_p", 9).alias("probability"),
        (F.col("mix_draw") < F.col("mix_p")).alias("sampled"),
    )


def _sql() -> str:
    listed = lambda goal: ", ".join(f"'{k}'" for k in goal if k != OTHER)
    goal_of = lambda name: "CASE " + name + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TARGETS[name].items()) + " ELSE 0.0 END"
    key = mixed((Sql("id") & M32) ^ mixed(((Sql("id") >> 32) & M32) ^ 0x2545F491))
    names = list(TARGETS)
    n_of = {k: f"len(list_intersect(w, {x}))" for k, x in TOPIC_WORDS.items()}
    most = f"greatest({', '.join(n_of.values())})"
    topic_of = f"CASE WHEN {most} = 0 THEN '{OTHER}' " + " ".join(f"WHEN {n} = {most} THEN '{k}'" for k, n in n_of.items()) + " END"
    goals = ", ".join(
        f"(SELECT sum(n) FROM cell) * ({goal_of(name)}) / (SELECT sum({goal_of(name)}) FROM (SELECT DISTINCT {name} FROM cell WHERE n > 0)) AS goal_{name}" for name in names
    )
    steps, last = [], "goal"
    for s in range(SWEEPS):
        for name in names:
            new = f"s{s}_{name}"
            steps.append(f"{new} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(n * f) OVER w > 0 THEN f * goal_{name} / sum(n * f) OVER w ELSE f END AS f) FROM {last} WINDOW w AS (PARTITION BY {name}))")
            last = new
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id, -1) AS id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n_tokens,
         CASE WHEN source IN ({listed(TARGETS['source'])}) THEN source ELSE '{OTHER}' END AS source,
         CASE WHEN lang IN ({listed(TARGETS['lang'])}) THEN lang ELSE '{OTHER}' END AS lang,
         {topic_of} AS topic
  FROM (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents)),
cell AS (SELECT source, lang, topic, cast(sum(n_tokens) AS DOUBLE) AS n FROM d GROUP BY ALL),
goal AS (SELECT *, cast(1 AS DOUBLE) AS f, {goals} FROM cell),
{", ".join(steps)},
p AS (SELECT source, lang, topic, f / (SELECT max(f) FROM {last}) AS p FROM {last})
SELECT doc_id, cast(n_tokens AS BIGINT) AS n_tokens, source AS source_group, lang AS lang_group, topic, round(p, 9) AS probability, {key} / 4294967296.0 < p AS sampled
FROM d JOIN p USING (source, lang, topic)
"""


OP7_SQL = _sql()
