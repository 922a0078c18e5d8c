"""Sample logs read by tasks from listing to record: whole archives, and growing ones in bounded batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.plans.scan import idiv, ordered_chunks, running, running_sum
from clipledger.schemas import SAMPLES
from clipledger.session import reading_tasks, store
from clipledger.sources import samplelog
from clipledger.sources.files import exists
from clipledger.sources.listing import list_tree

# Records of one range: what a task reads at once.
RANGE_RECORDS = 1 << 18
# Plans after which what has been planned of each log is summed up anew.
SUM_EVERY = 32

RANGES = "path string, begin bigint, records bigint"


def _records(length: str = "length"):
    """Whole records of a file; a half-written last one is the end of the log."""
    body = F.greatest(F.col(length) - len(samplelog.HEADER), F.lit(0).cast("bigint"))
    return idiv(body, F.lit(samplelog.RECORD.itemsize).cast("bigint"))


def _cut(rows: DataFrame, size: int) -> DataFrame:
    """Ranges (path, begin, records) of at most ``size`` records from rows (path, begin, total)."""
    width = F.lit(size).cast("bigint")
    last = idiv(F.greatest(F.col("total") - F.col("begin") - 1, F.lit(0).cast("bigint")), width)
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    parts = parts.withColumn("begin", F.col("begin") + F.col("_part") * width)
    return parts.select("path", "begin", F.least(width, F.col("total") - F.col("begin")).alias("records"))


def _reader(by_name: bool):
    def run(batches):
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("path", "begin", "records"))
            for path, begin, records in zip(*columns):
                split = samplelog.LogSplit([samplelog.LogRange(path, begin, records)])
                yield from samplelog.read_ranges(split, by_name)

    return run


def read_log_ranges(ranges: DataFrame, by_name: bool = False) -> DataFrame:
    """The records of log ranges (``path, begin, records``); ranges are spread over the tasks."""
    spread = ranges.repartition(reading_tasks(ranges.sparkSession), "path", "begin")
    return spread.mapInArrow(_reader(by_name), SAMPLES)


def scan_logs(spark: SparkSession, path: str, by_name: bool = False) -> DataFrame:
    """Every record of the logs below ``path``: the rows of ``format("samplelog")``.

    The tree is listed by tasks (:func:`list_tree`) and cut into ranges as a table, so an archive of
    any number of logs leaves no list on the driver.
    """
    logs = list_tree(spark, path, samplelog.SUFFIX)
    totals = logs.select("path", F.lit(0).cast("bigint").alias("begin"), _records().alias("total"))
    return read_log_ranges(_cut(totals, RANGE_RECORDS), by_name)


class LogIntake:
    """Growing logs as a stream of bounded batches.

    :meth:`plan` lists the archive by tasks, compares it with what has been planned so far and
    writes what is new as plans, files of ranges with at most ``max_records`` records each.
    :meth:`stream` reads the plans one after the other, so admission control and offsets are those of
    Spark's file source: the offset is the number of a plan, however many logs there are, and a
    batch takes as many plans as asked for. Each record is planned once, in the order of its log; a
    plan call that broke off is taken up by the next one. One intake uses ``folder``.
    """

    def __init__(
        self, spark: SparkSession, root: str, folder: str, max_records: int = 1 << 24, by_name: bool = False
    ):
        self.spark, self.root, self.folder = spark, root, folder.rstrip("/")
        self.max_records, self.by_name = max_records, by_name
        self.plans = f"{self.folder}/plans"

    def _schema(self) -> str:
        return f"{RANGES}, plan bigint"

    def _planned(self) -> tuple[DataFrame, int, int]:
        """How far each log has been planned, the number of plans, and that of plans not summed up."""
        none = self.spark.createDataFrame([], "path string, planned bigint")
        if not exists(self.plans):
            return none, 0, 0
        plans = self.spark.read.schema(self._schema()).parquet(self.plans)
        number = plans.agg(F.coalesce(F.max("plan") + 1, F.lit(0)).alias("n")).first().n
        summed = number - number % SUM_EVERY
        while summed and not exists(f"{self.folder}/sums/{summed}/_SUCCESS"):
            summed -= SUM_EVERY
        reached = plans.filter(F.col("plan") >= summed).select("path", (F.col("begin") + F.col("records")).alias("planned"))
        if summed:
            reached = reached.union(self.spark.read.schema(none.schema).parquet(f"{self.folder}/sums/{summed}"))
        return reached.groupBy("path").agg(F.max("planned").alias("planned")), number, number - summed

    def plan(self) -> int:
        """Write plans for all records that have come since the last call; their number."""
        planned, number, fresh = self._planned()
        if fresh >= SUM_EVERY:
            summed = number - number % SUM_EVERY
            planned.write.mode("overwrite").parquet(f"{self.folder}/sums/{summed}")
        logs = list_tree(self.spark, self.root, samplelog.SUFFIX).select("path", _records().alias("total"))
        grown = (
            logs.join(planned, "path", "left")
            .select("path", F.coalesce("planned", F.lit(0).cast("bigint")).alias("begin"), "total")
            .filter("total > begin")
        )
        size = min(RANGE_RECORDS, max(self.max_records // 4, 1))
        ranges = _cut(grown, size).withColumn("_all", F.lit(0))
        ordered = ordered_chunks(ranges, ["path", "begin"])
        so_far = running(ordered, ["_all"], "order_chunk", ["path", "begin"], {"_sum": running_sum("records")})
        # A plan takes the ranges that begin in its share, so with the last of them it stays in bounds.
        step = self.max_records - size + 1
        batch = idiv(F.col("_sum") - F.col("records"), F.lit(step).cast("bigint"))
        dealt = store(so_far.withColumn("batch", batch).select("path", "begin", "records", "batch"), "plan")
        batches = [r.batch for r in dealt.select("batch").distinct().orderBy("batch").collect()]
        # One after the other, as Spark's file source takes files by age.
        for k, batch in enumerate(batches):
            rows = dealt.filter(F.col("batch") == batch).withColumn("plan", F.lit(number + k).cast("bigint")).drop("batch")
            rows.coalesce(1).sortWithinPartitions("path", "begin").write.mode("append").parquet(self.plans)
        return len(batches)

    def stream(self, plans_per_batch: int = 1) -> DataFrame:
        """The records of all plans, ``plans_per_batch`` plans to a micro-batch."""
        ranges = (
            self.spark.readStream.schema(self._schema())
            .option("maxFilesPerTrigger", plans_per_batch)
            .parquet(self.plans)
        )
        return read_log_ranges(ranges.select("path", "begin", "records"), self.by_name)
