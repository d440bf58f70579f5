"""Incremental jobs: windowed counts, alerts that are raised once, streaks kept per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwork.sources.ledger import Ledger
from brickwork.sources.workspace import new_path

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_a_batch: int = 1) -> DataFrame:
    """New event files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def run_available(stream: DataFrame, mode: str, each_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all there is and stop; a second run with the same checkpoint resumes after it."""
    stream.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_counts(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Counts by day and type; rows later than the watermark are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("starts"), "event_type", "n")


def latest_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The result of a complete-mode aggregation after all available input, as a table."""
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    run_available(stream, "complete", lambda df, _: df.write.mode("overwrite").parquet(path), checkpoint)
    return spark.read.schema(stream.schema).parquet(path)


ALERTS = "user_id long, day date"


def raise_alerts(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, job: str = "alerts") -> DataFrame:
    """One alert per user and day with an error, never twice, however often the job runs or a batch is done again.

    A batch meets only the alerts of its own days, which the files' statistics
    of ``day`` tell apart.
    """
    ledger = Ledger(spark, path)

    def each_batch(df: DataFrame, batch: int) -> None:
        name = f"{job} {checkpoint}"
        if ledger.is_done(name, batch):
            return
        new = df.dropDuplicates(["user_id", "day"])
        first, last = df.agg(F.min("day"), F.max("day")).first()
        known = ledger.read("rows", ALERTS).where(F.col("day").between(first, last)).select(F.col("user_id").alias("u"), F.col("day").alias("d"))
        fresh = new.join(known, new["user_id"].eqNullSafe(known["u"]) & (new["day"] == known["d"]), "left_anti")
        ledger.append(fresh, name, batch)
        ledger.compact(ALERTS)

    with ledger.guard(job):
        run_available(stream.where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day")), "append", each_batch, checkpoint)
    return ledger.read("rows", ALERTS)


LAST, OPEN = "user_id long, at struct<ts: timestamp, event_id: long>", "user_id long, at struct<ts: timestamp, event_id: long>, n long"


def latest_streaks(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, late_days: int = 7, job: str = "streaks") -> DataFrame:
    """Per user the errors later than the newest other event, by (ts, event_id), in whatever order events arrive within ``late_days``.

    The state is two tables, replaced together by each batch: the place of each
    user's newest other event, and the errors after it (events without a type
    count as errors), those older than ``late_days`` before the newest event
    summed into one row a user. So it is bounded by the users and the errors of
    that time, and a run reads its state and its input, not the history. Events
    older than that when they arrive are left out and counted, as the fact
    ``late`` of the ledger. A later run goes on from the same path.
    """
    ledger = Ledger(spark, path)
    at, other = F.struct("ts", "event_id").alias("at"), F.coalesce(F.col("event_type") != "error", F.lit(False))

    def each_batch(df: DataFrame, batch: int) -> None:
        facts = ledger.state()[1]["facts"]
        horizon = F.lit(facts["horizon"]).cast("timestamp") if facts.get("horizon") else F.lit(None).cast("timestamp")
        early = F.coalesce(F.col("ts") < horizon, F.lit(False))
        reach, late = df.agg((F.max("ts") - F.expr(f"INTERVAL {late_days} DAYS")).cast("string"), F.count_if(early)).first()
        if reach is None or ledger.is_done(job, batch):
            return
        before = max(reach, facts.get("horizon") or reach)
        rows = df.where(~early)
        last = rows.where(other).select("user_id", at).unionByName(ledger.read("last", LAST)).groupBy("user_id").agg(F.max("at").alias("at"))
        last = spark.read.schema(LAST).parquet(f"{ledger.path}/{(last_part := ledger.write(last))}")
        errors = rows.where(~other).select("user_id", at, F.lit(1).cast("long").alias("n")).unionByName(ledger.read("open", OPEN))
        of_user = last.select(F.col("user_id").alias("u"), F.col("at").alias("last"))
        later = errors.join(of_user, errors["user_id"].eqNullSafe(of_user["u"]), "left").where("last IS NULL OR at > last").select("user_id", "at", "n")
        old = F.when(F.col("at.ts") < F.lit(before).cast("timestamp"), F.lit(True))
        folded = later.where(old).groupBy("user_id").agg(F.max("at").alias("at"), F.sum("n").alias("n"))
        open_part = ledger.write(folded.unionByName(later.where(old.isNull())))
        ledger.commit(job, batch, replace={"last": last_part, "open": open_part}, facts={"horizon": before, "late": facts.get("late", 0) + late})

    with ledger.guard(job):
        run_available(stream, "append", each_batch, checkpoint)
    counts = ledger.read("open", OPEN).select("user_id", "n").unionByName(ledger.read("last", LAST).select("user_id", F.lit(0).cast("long").alias("n")))
    return counts.groupBy("user_id").agg(F.sum("n").alias("streak"))


def lookback_from(last: Column, as_of: Column, days: int = 180, margin: int = 7) -> Column:
    """The day from which an entity is read again: ``days`` back, or ``margin`` before it was last read if that is earlier."""
    return F.least(F.date_sub(as_of, days), F.date_sub(last, margin))


DAILY = "day date, event_type string, n long"


def daily_once(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, late: str = "7 days", job: str = "daily") -> tuple[DataFrame, int]:
    """Counts by day and type of events that may be read again, each event once; and how many came too late.

    An event read again within ``late`` of its first reading is dropped by its
    id, so windows may overlap; one older than ``late`` before the newest event
    of the batches before is left out and counted. Each batch leaves its partial counts.
    """
    ledger = Ledger(spark, path)
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])

    def each_batch(df: DataFrame, batch: int) -> None:
        ledger.append(df.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")), job, batch)
        ledger.compact(DAILY)

    with ledger.guard(job):
        query = once.writeStream.outputMode("append").foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    too_late = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    return ledger.read("rows", DAILY).groupBy("day", "event_type").agg(F.sum("n").alias("n")), too_late
