"""Pipes: immutable terms over operators, checked as they are composed, that compile to DataFrames.

A pipe has at most one input and one output. Bags are bounded and unordered; streams are unbounded, and columns carry
their order. Every operator says which of the two it takes, and a term allows what all its parts allow.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .durable import cut, discard
from .live import merged_live, passed_on

BAG, STREAM = "bag", "stream"
BOTH = frozenset((BAG, STREAM))


class PipeError(ValueError):
    """A term that cannot be composed or run."""


class PipeTypeError(PipeError):
    """Records of another type than what comes next takes."""


class Operator:
    """What a pipe is made of. Subclasses set the degrees and structures and define apply()."""

    inputs, outputs = 1, 1
    structures: frozenset[str] = BOTH

    @property
    def label(self) -> str:
        return type(self).__name__

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def par(self, n: int) -> Operator:
        """The operator by n tasks: of one that shuffles, its result is dealt out to so many, of any other its input."""
        return Parallel(self, n)


class Source(Operator):
    """From outside into a pipe: subclasses define load()."""

    inputs = 0

    def load(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError


class Sink(Operator):
    """From a pipe to the outside: subclasses define write()."""

    outputs = 0

    def write(self, df: DataFrame) -> object:
        raise NotImplementedError


class BinaryOperator(Operator):
    """Takes the outputs of two pipes: subclasses define combine()."""

    inputs = 2

    def combine(self, left: DataFrame, right: DataFrame) -> DataFrame:
        raise NotImplementedError


class Parallel(Operator):
    """An operator and how many tasks apply it."""

    def __init__(self, operator: Operator, n: int):
        if n < 1:
            raise PipeError("an operator has one task at least")
        if (operator.inputs, operator.outputs) != (1, 1):
            raise PipeError("only an operator with an input and an output takes a number of tasks")
        self.operator, self.n, self.structures = operator, n, frozenset(operator.structures)

    @property
    def label(self) -> str:
        return self.operator.label

    @property
    def gathers(self) -> bool:
        return getattr(self.operator, "gathers", False)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.gathers:
            return self.operator.apply(df).repartition(self.n)
        return self.operator.apply(df.repartition(self.n))


class TerminationCondition:
    """When iteration ends: done() is asked after each round, which counts from 1."""

    def done(self, round: int, before: DataFrame, now: DataFrame) -> bool:
        raise NotImplementedError


@dataclass(frozen=True)
class FixedIterations(TerminationCondition):
    n: int

    def __post_init__(self):
        if self.n < 1:
            raise PipeError("iterate at least once")

    def done(self, round: int, before: DataFrame, now: DataFrame) -> bool:
        return round >= self.n


@dataclass(frozen=True)
class Until(TerminationCondition):
    """Ends when `small(before, now)` holds, or after `most` rounds."""

    small: Callable[[DataFrame, DataFrame], bool]
    most: int = 100

    def done(self, round: int, before: DataFrame, now: DataFrame) -> bool:
        return round >= self.most or self.small(before, now)


def same_type(a: T.StructType, b: T.StructType) -> bool:
    """Names and types agree; whether nulls may occur doesn't count."""

    def plain(t):
        if isinstance(t, T.StructType):
            return tuple((f.name, plain(f.dataType)) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return "array", plain(t.elementType)
        if isinstance(t, T.MapType):
            return "map", plain(t.keyType), plain(t.valueType)
        return t.simpleString()

    return plain(a) == plain(b)


def require_same(a: DataFrame, b: DataFrame, where: str) -> None:
    if not same_type(a.schema, b.schema):
        raise PipeTypeError(f"{where}: {a.schema.simpleString()} is not {b.schema.simpleString()}")


@dataclass(frozen=True)
class Pipe:
    """A term. Pipe() is the empty one, neutral in to(); Pipe(operator) holds an operator."""

    operator: Operator | None = None
    kind: str = field(default="", kw_only=True)
    children: tuple[Pipe, ...] = field(default=(), kw_only=True)
    inputs: int = field(default=1, kw_only=True)
    outputs: int = field(default=1, kw_only=True)
    structures: frozenset[str] = field(default=BOTH, kw_only=True)
    until: TerminationCondition | None = field(default=None, kw_only=True)
    cut_every: int = field(default=5, kw_only=True)

    def __post_init__(self):
        put = lambda **x: [object.__setattr__(self, k, v) for k, v in x.items()]
        if not self.kind:
            put(kind="operator" if self.operator else "empty")
            if self.operator:
                if isinstance(self.operator, BinaryOperator):
                    raise PipeError("a binary operator belongs in pair_with()")
                put(inputs=self.operator.inputs, outputs=self.operator.outputs, structures=frozenset(self.operator.structures))

    # Composition

    @property
    def empty(self) -> bool:
        return self.kind == "empty"

    def _meet(self, *others: Pipe) -> frozenset[str]:
        out = self.structures
        for x in others:
            out &= x.structures
        if not out:
            raise PipeError("no structure, bag or stream, is allowed by all parts")
        return out

    def add(self, operator: Operator) -> Pipe:
        return self.to(Pipe(operator))

    def to(self, *others: Pipe) -> Pipe:
        """Into one pipe, or into each of several whose outputs, where they have one, are merged."""
        if len(others) == 1:
            (other,) = others
            if other.empty:
                return self
            if self.empty:
                return other
            if not self.outputs:
                raise PipeError("what comes before has no output")
            if not other.inputs:
                raise PipeError("what comes next takes no input")
            parts = [c for p in (self, other) for c in (p.children if p.kind == "to" else (p,))]
            return Pipe(kind="to", children=tuple(parts), inputs=self.inputs, outputs=other.outputs, structures=self._meet(other))
        if not others:
            raise PipeError("to() needs a pipe")
        if not self.outputs:
            raise PipeError("what comes before has no output")
        if not all(p.inputs for p in others):
            raise PipeError("a branch takes no input")
        return Pipe(kind="multi_to", children=(self, *others), inputs=self.inputs, outputs=max(p.outputs for p in others), structures=self._meet(*others))

    def merge(self, other: Pipe) -> Pipe:
        """Both outputs as one, duplicates kept. At most one of the two may have an input."""
        if not self.outputs or not other.outputs:
            raise PipeError("merge() needs two outputs")
        if self.inputs and other.inputs:
            raise PipeError("merge() needs a pipe without input")
        parts = [c for p in (self, other) for c in (p.children if p.kind == "merge" else (p,))]
        return Pipe(kind="merge", children=tuple(parts), inputs=max(self.inputs, other.inputs), structures=self._meet(other))

    def pair_with(self, other: Pipe, operator: BinaryOperator) -> Pipe:
        """A binary operator on both outputs. At most one of the two may have an input, which the pair then takes."""
        if not isinstance(operator, BinaryOperator):
            raise PipeError("pair_with() needs a binary operator")
        if not self.outputs or not other.outputs:
            raise PipeError("pair_with() needs two outputs")
        if self.inputs and other.inputs:
            raise PipeError("pair_with() needs a pipe without input")
        allowed = self._meet(other) & operator.structures
        if not allowed:
            raise PipeError("no structure, bag or stream, is allowed by all parts")
        return Pipe(operator, kind="pair", children=(self, other), inputs=max(self.inputs, other.inputs), outputs=operator.outputs, structures=allowed)

    def iterate(self, until: TerminationCondition | int, cut_every: int = 5) -> Pipe:
        """Output back to input, round by round. Bags only. Lineage is cut every so many rounds."""
        until = FixedIterations(until) if isinstance(until, int) else until
        if self.empty:
            return self
        if not self.inputs or not self.outputs:
            raise PipeError("iterate() needs an input and an output")
        if BAG not in self.structures:
            raise PipeError("only bags can be iterated on")
        return Pipe(kind="iterate", children=(self,), structures=frozenset((BAG,)), until=until, cut_every=cut_every)

    # Compilation

    def compile(self, spark: SparkSession, df: DataFrame | None = None) -> DataFrame | list:
        """The DataFrame of the output; for a pipe that ends in sinks, their results. `df`: the input of a pipe that takes one."""
        if self.inputs and df is None:
            raise PipeError("the pipe needs an input")
        return self._build(spark, df)

    def _build(self, spark: SparkSession, df: DataFrame | None):
        if self.kind == "empty":
            return df
        if self.kind == "operator":
            op = self.operator
            if isinstance(op, Source):
                return op.load(spark)
            return op.write(df) if isinstance(op, Sink) else passed_on(df, op.apply(df), op)
        if self.kind == "to":
            for p in self.children:
                df = p._build(spark, df)
            return df
        if self.kind == "multi_to":
            first, *branches = self.children
            df = first._build(spark, df)
            # Each sink is an action of its own; what is left after them reads its input again.
            held = df.cache() if any(not p.outputs for p in branches) and not df.isStreaming else None
            try:
                made = [(p, p._build(spark, df)) for p in branches]
            finally:
                if held is not None:
                    held.unpersist()
            frames = [x for p, x in made if p.outputs]
            return merged(frames, "to()") if frames else [x for _, x in made]
        if self.kind == "merge":
            return merged([p._build(spark, df if p.inputs else None) for p in self.children], "merge()")
        if self.kind == "pair":
            left, right = (p._build(spark, df if p.inputs else None) for p in self.children)
            return self.operator.combine(left, right)
        return self._iterated(spark, df)

    def _iterated(self, spark: SparkSession, df: DataFrame) -> DataFrame:
        # What takes no part in the loop is computed once.
        body, held = self.children[0]._hoisted(spark)
        # A condition on the rows reads both rounds' rows, so each round is a table then.
        every = self.cut_every if isinstance(self.until, FixedIterations) else 1
        round, tables = 0, []
        try:
            while True:
                before, round = df, round + 1
                df = body._build(spark, df)
                require_same(df, before, "iterate()")
                if round % every == 0:
                    df = cut(df, "iterate")
                    tables.append(df)
                if self.until.done(round, before, df):
                    return df if round % every == 0 or not held else cut(df, "iterate")
                if round % every == 0:
                    discard(*tables[:-1])  # no later round reads them
                    del tables[:-1]
        finally:
            for x in held:
                x.unpersist()

    def _hoisted(self, spark: SparkSession) -> tuple[Pipe, list[DataFrame]]:
        """The term with each part that takes no input replaced by its rows, cached; and these."""
        if self.kind in ("pair", "merge", "to", "multi_to"):
            parts, held = [], []
            for p in self.children:
                if not p.inputs and p.outputs:
                    frame = p._build(spark, None).cache()
                    held.append(frame)
                    parts.append(Pipe(Frame(frame)))
                else:
                    q, more = p._hoisted(spark)
                    parts.append(q)
                    held += more
            return replace(self, children=tuple(parts)), held
        return self, []

    # Running

    def run(self, spark: SparkSession) -> Run:
        """Run a pipe without input or output."""
        if self.inputs or self.outputs:
            raise PipeError("only a pipe that begins with a source and ends in a sink can run")
        began, first = time.perf_counter(), last_job(spark)
        result = self._build(spark, None)
        return Run(result, (time.perf_counter() - began) * 1000, stages_after(spark, first))


@dataclass(frozen=True)
class Stage:
    """What a stage of a run did."""

    stage: int
    name: str
    tasks: int
    done: int
    failed: int


@dataclass(frozen=True)
class Run:
    """What the sinks returned, the wall time, and the stages that ran meanwhile, as far as Spark still knows them."""

    result: object
    milliseconds: float
    stages: tuple[Stage, ...] = ()

    def statistics(self) -> str:
        """A line a stage."""
        return "\n".join(f"stage {x.stage}: {x.done} of {x.tasks} tasks, {x.failed} failed: {x.name}" for x in self.stages)


def last_job(spark: SparkSession) -> int:
    return max(known_jobs(spark), default=-1)


def known_jobs(spark: SparkSession) -> list[int]:
    """Of the present job group, or of none."""
    tracker = spark.sparkContext.statusTracker()
    return list(tracker.getJobIdsForGroup(spark.sparkContext.getLocalProperty("spark.jobGroup.id")))


def stages_after(spark: SparkSession, job: int) -> tuple[Stage, ...]:
    tracker, out = spark.sparkContext.statusTracker(), {}
    for j in sorted(x for x in known_jobs(spark) if x > job):
        info = tracker.getJobInfo(j)
        for k in info.stageIds if info else ():
            x = tracker.getStageInfo(k)
            if x:
                out[k] = Stage(k, x.name, x.numTasks, x.numCompletedTasks, x.numFailedTasks)
    return tuple(out[k] for k in sorted(out))


@dataclass(frozen=True)
class Frame(Source):
    """Rows at hand."""

    frame: DataFrame

    @property
    def structures(self) -> frozenset[str]:
        return frozenset((STREAM if self.frame.isStreaming else BAG,))

    def load(self, spark: SparkSession) -> DataFrame:
        return self.frame


def merged(frames: Iterable[DataFrame], where: str) -> DataFrame:
    frames = list(frames)
    first, *rest = frames
    for x in rest:
        require_same(x, first, where)
        first = first.unionByName(x)
    return merged_live(frames, first) if rest else first
