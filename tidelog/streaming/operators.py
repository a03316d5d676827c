"""Stream operators on Structured Streaming: the same functions serve batch frames, so a query can be checked against SQL.

Windows are by event time with a watermark. State is kept per key; a late row beyond the watermark is dropped by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidelog.plans.store import shared_folder


def read_files(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a folder, as they come; files_per_trigger limits the rate."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def count_by_window(events: DataFrame, time: str, length: str, slide: str | None = None, late: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """Rows in each window (tumbling, if it slides by its length) and key."""
    frame = events.withWatermark(time, late) if events.isStreaming else events
    grouped = frame.groupBy(F.window(time, length, slide or length), *(keys or [])).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(keys or []), "n")


def reduce_by_key_and_window(events: DataFrame, time: str, key: str, value: str, length: str, slide: str, late: str = "1 hour") -> DataFrame:
    frame = events.withWatermark(time, late) if events.isStreaming else events
    grouped = frame.groupBy(F.window(time, length, slide), key).agg(F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), key, "total")


def update_state_by_key(events: DataFrame, key: str, value: str, start: float, update: Callable[[float, pd.Series], float], timeout_ms: int | None = None) -> DataFrame:
    """Per key: its state after each batch. With a timeout, a key without rows for so long gives its state once more and goes."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (now,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [keys[0]], "state": [now], "gone": [True]})
            return
        now = state.get[0] if state.exists else start
        for rows in batches:
            now = float(update(now, rows[value]))
        state.update((now,))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"key": [keys[0]], "state": [now], "gone": [False]})

    kind = events.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(step, f"key {kind}, state double, gone boolean", "state double", "update", timeout)


def run_available(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is now and returns its result table, from files in the shared folder: the last batch's
    in complete mode, else all."""
    out, batches = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}", []

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{number}")
        batches.append(number)

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    chosen = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    if not chosen:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(*(f"{out}/{k}" for k in chosen))


def combine_by_key(events: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: the count, sum and mean of its values so far."""
    v = F.col(value)
    return events.groupBy(key).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"))


def with_inverse(panes: DataFrame, key: str, time: str, value: str, slide: str, length: int, keep: Column | None = None) -> DataFrame:
    """Sums of sliding windows of `length` panes, each from the one before: what comes in is added and what leaves is taken
    away. panes: the sum of each key and pane of the slide's length. keep: which results stay (over key, end and total)."""
    # a window ends at each pane from the first to the last that a pane still reaches
    ends = panes.select(key, F.explode(F.array(F.struct(F.col(time).alias("end"), F.col(value).alias("change")), F.struct((F.col(time) + F.expr(f"INTERVAL '{slide}'") * length).alias("end"), (-F.col(value)).alias("change")))).alias("e"))
    changes = ends.select(key, "e.end", "e.change").groupBy(key, "end").agg(F.sum("change").alias("change"))
    in_order = Window.partitionBy(key).orderBy("end")
    totals = changes.withColumn("total", F.sum("change").over(in_order)).withColumn("until", F.lead("end").over(in_order))
    # between two changes the total stays
    step = F.expr(f"INTERVAL '{slide}'")
    filled = totals.where(F.col("until").isNotNull()).select(key, F.explode(F.sequence("end", F.col("until") - step, step)).alias("end"), "total")
    return filled.where(keep) if keep is not None else filled


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket. It can't be read again, so a lost driver loses what came: for trials."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


class Progress(StreamingQueryListener):
    """Notes what each batch read, and how queries end."""

    def __init__(self):
        self.started, self.rows, self.ended = 0, [], []

    def onQueryStarted(self, event) -> None:
        self.started += 1

    def onQueryProgress(self, event) -> None:
        self.rows.append(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each batch, with its number, to a function; a restart goes on after the last batch that the checkpoint has."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
