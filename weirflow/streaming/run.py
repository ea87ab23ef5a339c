"""Running a stream until its input ends, and then giving out what its open window holds."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.durable import new_path
from ..plans.live import live
from ..plans.pipe import PipeError

#: Seconds between looks at whether a stream's feeds have ended.
LOOK = 0.1


def stateful(df: DataFrame) -> bool:
    return "FlatMapGroupsInPandasWithState" in df._jdf.queryExecution().logical().toString()


def ended(df: DataFrame, writer) -> None:
    """Start the writer's query and wait until all input is through: the files that are there or, where feeds still write
    more, those that are there once the feeds end."""
    feeds = live(df).feeds
    if not any(f.is_alive() for f in feeds):
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        query: StreamingQuery = writer.trigger(processingTime="0 seconds").start()
        try:
            while any(f.is_alive() for f in feeds) and query.isActive:
                time.sleep(LOOK)
            if query.isActive:
                query.processAllAvailable()
        finally:
            query.stop()
        if query.exception():
            raise query.exception()
    for f in feeds:
        if f.error is not None:
            raise f.error


def flushed(df: DataFrame, checkpoint: str) -> DataFrame | None:
    """A bag of what the open windows give, through all that follows the window; None if there is no window."""
    state = live(df)
    if state.window is None:
        if stateful(df):
            raise PipeError("the stream's windows were made outside of a pipe, so what follows them isn't known")
        return None
    rows = state.opened(df.sparkSession.read.format("statestore").load(checkpoint))
    return state.after(rows)


def drained(df: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """Give `each` the micro-batches, then what the windows give that the end leaves open. What follows a window is applied
    to the batches that it gives."""
    checkpoint, state = new_path(df.sparkSession, "stream-checkpoint"), live(df)
    source, step = (state.window, lambda bag, n: each(state.after(bag), n)) if state.whole else (df, each)
    ended(df, source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint))
    rest = flushed(df, checkpoint)
    if rest is not None:
        each(rest, -1)


def collected(df: DataFrame) -> DataFrame:
    """All rows that the stream gives out, the last windows' included."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "stream-rows")
    schema = df.schema
    spark.createDataFrame([], schema).write.parquet(f"{path}/none")

    def put(part: DataFrame, n: int) -> None:
        # A batch that is given again replaces what it left.
        part.write.mode("overwrite").parquet(f"{path}/{'open' if n < 0 else n}")

    drained(df, put)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
