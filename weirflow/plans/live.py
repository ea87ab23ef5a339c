"""What a stream's frame carries along: the feeds that still write its input, and its window by key with what follows.

When the input ends, the open windows of a stream leave its state, as a bag, and go through the same operators that full
windows went through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from threading import Thread

from pyspark.sql import DataFrame


class Feed(Thread):
    """A thread of the driver that appends to a stream's input until that ends. `error`: what it ended with, if not well."""

    def __init__(self, run: Callable[[], object]):
        super().__init__(daemon=True)
        self._run_feed, self.error = run, None
        self.start()

    def run(self) -> None:
        try:
            self._run_feed()
        except BaseException as e:  # noqa: BLE001 - raised by who waits for the stream
            self.error = e


@dataclass(frozen=True)
class Live:
    feeds: tuple[Feed, ...] = ()
    #: The frame of the state's windows, and what makes the output's rows of a bag like it.
    window: DataFrame | None = None
    opened: Callable[[DataFrame], DataFrame] | None = None
    after: Callable[[DataFrame], DataFrame] | None = None
    #: All rows come through the window, so they can be made of its batches, however many branches follow it.
    whole: bool = False


def live(df: DataFrame) -> Live:
    return getattr(df, "weirflow_live", None) or Live()


def mark(df: DataFrame, state: Live) -> DataFrame:
    if df.isStreaming:
        df.weirflow_live = state
    return df


def passed_on(before: DataFrame, made: DataFrame, op) -> DataFrame:
    """`made`, which `op` made of `before`, with what `before` carried along."""
    if not before.isStreaming or not made.isStreaming:
        return made
    state, opens = live(before), live(made)
    if opens.window is not None and made is not before:  # the operator is a window
        from .pipe import PipeError

        if state.window is not None:
            raise PipeError("a stream has one window by key at most")
        return mark(made, replace(opens, feeds=state.feeds))
    if state.window is None:
        return mark(made, state)
    then = state.after
    return mark(made, replace(state, after=lambda bag: op.apply(then(bag))))


def merged_live(frames: list[DataFrame], made: DataFrame) -> DataFrame:
    """The union `made` of `frames`, with what they carried along. They may share one window, but not have several."""
    from .pipe import PipeError

    states = [live(x) for x in frames if x.isStreaming]
    if not made.isStreaming or not states:
        return made
    windowed = [x for x in states if x.window is not None]
    if len({id(x.window) for x in windowed}) > 1:
        raise PipeError("a stream has one window by key at most")
    feeds = tuple(dict.fromkeys(f for x in states for f in x.feeds))
    if not windowed:
        return mark(made, Live(feeds))
    if len(windowed) > 1 and len(windowed) < len(states):
        raise PipeError("branches of a windowed stream can be merged with each other only")
    each = [x.after for x in windowed]
    return mark(made, replace(windowed[0], feeds=feeds, whole=len(windowed) == len(states) == len(frames), after=lambda bag: reduce(DataFrame.unionByName, [f(bag) for f in each])))
