"""Streams of results and events: running progress, upserts batch by batch, and the life of keys as kept state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.lifecycle import STATE, State, fold_frame


def files(spark: SparkSession, folder: str, schema: str, per_batch: int = 50) -> DataFrame:
    """New Parquet files of a folder, at most ``per_batch`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def progress(results: DataFrame) -> DataFrame:
    """(job_id, done, failed, mean_accuracy) so far, over a stream or a table of results (job_id, accuracy, error)."""
    return results.groupBy("job_id").agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.avg("accuracy").alias("mean_accuracy"))


def windowed(events: DataFrame, at: str, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts of event types in windows of time; events later than ``late`` are left out, and windows end when no more can come."""
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide) if slide else F.window(at, size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def lifecycle(events: DataFrame, family: bool = False) -> DataFrame:
    """(key, seq, state) after every event of a stream; the state of each key is kept between batches."""
    state_schema = STATE.replace(" long", " bigint")
    names = list(asdict(State()))

    def on(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = State(**dict(zip(names, kept.get, strict=True))) if kept.exists else State()
        for out in (fold_frame(f, state, family) for f in [pd.concat(list(frames))]):
            yield out
        kept.update(tuple(asdict(state).values()))

    return events.select("key", "seq", "event", "score", "checked").groupBy("key").applyInPandasWithState(on, f"key string, seq long, {STATE}", state_schema, "append", GroupStateTimeout.NoTimeout)


def upserting(stream: DataFrame, change: Callable[[DataFrame], None], checkpoint: str):
    """Start a stream whose batches ``change`` applies, each once in order."""
    return stream.writeStream.foreachBatch(lambda batch, _: change(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
