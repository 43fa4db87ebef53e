"""Queues, limits and watched folders as streams, and the same folds over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def queue_state(log: DataFrame, max_attempts: int = 3, backoff_s: int = 60) -> DataFrame:
    """(job_id, status, attempts, available_at) from log(seq, job_id, event, at): enqueued, claimed, completed, failed, cancelled.

    The last event decides; a failure is queued again after a delay that grows with the attempts, and dead at the most of them.
    """
    last = F.max_by("event", "seq")
    s = log.groupBy("job_id").agg(last.alias("event"), F.count_if(F.col("event") == "claimed").alias("attempts"), F.max_by("at", "seq").alias("at"))
    failed = F.col("event") == "failed"
    status = F.when(F.col("event") == "enqueued", "queued").when(failed & (F.col("attempts") >= max_attempts), "dead").when(failed, "queued").when(F.col("event") == "completed", "done").otherwise(F.col("event"))
    later = F.timestamp_seconds(F.unix_seconds(F.col("at").cast("timestamp")) + F.when(failed, F.col("attempts") * backoff_s).otherwise(0))
    return s.select("job_id", status.alias("status"), "attempts", later.alias("available_at"))


def claim_order(state: DataFrame, now, n: int) -> DataFrame:
    """The jobs a worker takes next: available ones, fewest attempts first."""
    return state.where("status = 'queued'").where(F.col("available_at") <= now).orderBy("attempts", "job_id").limit(n)


def deduplicated(jobs: DataFrame, key: str, at: str, within: str = "1 day") -> DataFrame:
    """A stream of jobs without those whose key came before within the time."""
    return jobs.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def calls_per_window(calls: DataFrame, at: str, by: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls by provider and minute, for late data too; append mode works."""
    return calls.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def run_batches(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off a stream in batches until it is empty. The checkpoint is the set of what has been seen."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(work).start()


def watched_folder(spark: SparkSession, path: str, pattern: str = "*", files_a_batch: int = 1000) -> DataFrame:
    """New files under a folder as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(path)


def outbox(work: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A batch function whose result is written once a batch, even if the batch is run again."""

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def worker(stages: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that works jobs off: jobs(job_id, kind, dedup_key, payload) of a batch, one for each dedup_key (the smallest job_id) and
    none that an earlier batch did; every kind by its stage, which gives (job_id, result); a record for each: done, or refused if no
    stage knows the kind. Records are written once a batch, so that a batch that is run again (its worker was lost) counts once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("dedup_key").agg(F.min("job_id").alias("job_id"))
        jobs = batch.join(first.select("job_id"), "job_id", "left_semi")
        if number:
            done = spark.read.option("mergeSchema", "false").parquet(path).where(F.col("batch") < number)
            jobs = jobs.join(done.select("dedup_key"), "dedup_key", "left_anti")
        out = jobs.where(~F.col("kind").isin(*stages)).select("job_id", "kind", "dedup_key", F.lit("refused").alias("state"), F.lit(None).cast("string").alias("result"))
        for kind, stage in stages.items():
            mine = jobs.where(F.col("kind") == kind)
            made = stage(mine).select("job_id", F.col("result").cast("string").alias("result"))
            out = out.unionByName(mine.join(made, "job_id", "left").select("job_id", "kind", "dedup_key", F.when(F.col("result").isNull(), "failed").otherwise("done").alias("state"), "result"))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def due_timers(timers: DataFrame, cancelled: DataFrame, now) -> DataFrame:
    return timers.where(F.col("due_at") <= now).join(cancelled, "timer_id", "left_anti")


def carried(decisions: DataFrame, line_map: DataFrame, replaced: DataFrame) -> DataFrame:
    """Decisions on lines of replaced statements: moved to the same line of the new statement, or left over; others stay."""
    moved = decisions.join(line_map, "line_id", "left").join(replaced.select("line_id", F.lit(True).alias("gone")), "line_id", "left")
    state = F.when(F.col("new_line_id").isNotNull(), "moved").when(F.col("gone"), "left_over").otherwise("stays")
    return moved.select("decision_id", "line_id", F.coalesce("new_line_id", "line_id").alias("now_on"), state.alias("state"))


def sessions(events: DataFrame, by: str, at: str, gap_s: int) -> DataFrame:
    """Events numbered by session: a new one begins after a pause."""
    order = Window.partitionBy(by).orderBy(at)
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    fresh = F.coalesce(seconds(F.col(at)) - seconds(F.lag(at).over(order)) > gap_s, F.lit(True)).cast("int")
    return events.withColumn("_f", fresh).withColumn("session", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")
