"""Streams whose answer depends on all earlier rows of a clip.

The set-based operators already work on any slice of a clip once they know what came before. So
each micro-batch is one ordinary job: the batch is joined with the state the last batch left, and
writes two tables below a shared folder, its output and the new state, both named after the batch.
A batch that is repeated after a failure reads the same old state and replaces its own tables, so
every row counts once. A clip of any size is split over tasks inside a batch, and the work of a
batch is that of its rows plus the state of the clips.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.session import scratch_path
from clipledger.sources.files import exists

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


class CarriedStream:
    """Run ``step(batch, state) -> (output, new_state)`` for each micro-batch of a stream."""

    def __init__(
        self, spark: SparkSession, step: Step, output: str, state: str, folder: str | None = None
    ):
        self.spark, self.step = spark, step
        self.output_schema, self.state_schema = output, state
        self.folder = folder or scratch_path(spark, "stream")

    def _state_before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], self.state_schema)
        return spark.read.schema(self.state_schema).parquet(
            f"{self.folder}/state/{batch_id - 1}"
        )

    def _run(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            output, state = self.step(batch, self._state_before(batch.sparkSession, batch_id))
            state.write.mode("overwrite").parquet(f"{self.folder}/state/{batch_id}")
            output.write.mode("overwrite").parquet(f"{self.folder}/output/batch={batch_id}")
        finally:
            batch.unpersist()

    def start(self, stream: DataFrame, **trigger):
        return (
            stream.writeStream.foreachBatch(self._run)
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def drain(self, stream: DataFrame) -> DataFrame:
        """Process all there is, then return the whole output."""
        self.start(stream).awaitTermination()
        return self.result()

    def result(self) -> DataFrame:
        if not exists(f"{self.folder}/output"):
            return self.spark.createDataFrame([], self.output_schema)
        rows = self.spark.read.schema(f"{self.output_schema}, batch bigint").parquet(
            f"{self.folder}/output"
        )
        return rows.drop("batch")


def drain_append(stream: DataFrame) -> DataFrame:
    """Run an append-mode stream over all there is into a table and read that table."""
    spark = stream.sparkSession
    folder = scratch_path(spark, "append")
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/output")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{folder}/output")


def drain_update(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an aggregate in update mode over all there is; the last row of each of ``keys``.

    Open windows are told as well, which append mode holds back until they are closed.
    """
    spark = stream.sparkSession
    folder = scratch_path(spark, "update")
    rest = [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/output/batch={batch_id}")

    (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    if not exists(f"{folder}/output"):
        return spark.createDataFrame([], stream.schema)
    written = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    rows = spark.read.schema(f"{written}, batch bigint").parquet(f"{folder}/output")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, "_r.*").select(*stream.columns)


def after_state(batch: DataFrame, state: DataFrame, order: str, carried: str = "last") -> DataFrame:
    """The highest ``order`` of each clip of a batch, after a look that none was seen before.

    The carried streams take each clip in order. A row that comes after a later one would be
    counted wrongly, so it ends the stream with an error. Only one row per clip is compared.
    """
    spans = batch.groupBy("clip_id").agg(F.min(order).alias("_low"), F.max(order).alias(carried))
    early = spans.join(state.select("clip_id", F.col(carried).alias("_seen")), "clip_id").filter("_low <= _seen")
    if not early.isEmpty():
        clip = early.first()
        raise ValueError(f"{order} {clip['_low']} of clip {clip['clip_id']} comes after {clip['_seen']}")
    return spans.select("clip_id", carried)


def newest(state: DataFrame, fresh: DataFrame, keys: list[str], how: dict[str, str]) -> DataFrame:
    """Merge two one-row-per-key tables, column by column with max, min or sum."""
    both = state.unionByName(fresh)
    return both.groupBy(*keys).agg(*[getattr(F, fn)(c).alias(c) for c, fn in how.items()])
