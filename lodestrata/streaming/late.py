"""Late and out-of-order events (problem 6): per-period counts that are corrected.

A period is a source and a UTC day of event time.  It closes some hours after the
end of its day and is final at a later cut-off.  Records that arrive between the
two correct the period: its count is issued again, once per arrival day.  Records
beyond the cut-off are diverted to a report and change nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.session import Workspace, parallelism

ON_TIME, CORRECTION, TOO_LATE = "on_time", "correction", "too_late"


@dataclass(frozen=True)
class Lateness:
    """Hours after the end of a day: when a period closes, and when it is final."""

    close_hours: int = 6
    cutoff_hours: int = 72


def spell_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """``source`` as the table of sources spells it; blanks around it and case do not matter.

    The table of sources has a fixed size (TESTDATA), which is why it is broadcast.
    A source it lacks keeps its own trimmed spelling in lower case; null stays null.
    """
    proper = sources.where("source is not null").groupBy(F.lower(F.trim("source")).alias("_s")).agg(F.min(F.trim("source")).alias("_proper"))
    plain = F.lower(F.trim(F.regexp_replace("source", r"^\s+|\s+$", "")))
    spelled = records.withColumn("_s", plain).join(F.broadcast(proper), "_s", "left")
    return spelled.withColumn("source", F.coalesce("_proper", "_s")).drop("_s", "_proper")


def _same() -> Column:
    """What repetitions of a record have in common; a null hash equals no other one."""
    return F.coalesce("content_hash", F.concat(F.lit("id:"), "id"))


def first_arrivals(records: DataFrame) -> DataFrame:
    """One row per source and content: the row that arrived first stands for the record.

    Equal arrival times are settled by the smaller id.  A null content hash equals
    no other one.  A min over structs is combined before the shuffle, so a content
    or source with a third of all rows costs one row per task.
    """
    first = F.min(F.struct("ingested_at", "id", "published_at")).alias("m")
    known = records.where("ingested_at is not null")
    return known.groupBy("source", _same().alias("_same")).agg(first).select("source", F.col("m.id").alias("id"), "m.ingested_at", "m.published_at")


def classify(arrivals: DataFrame, lateness: Lateness = Lateness()) -> DataFrame:
    """Event-time window and arrival class of every record with an event time."""
    day = F.date_trunc("DAY", "published_at")
    end = day + F.expr("INTERVAL 1 DAY")
    close = end + F.expr(f"INTERVAL {int(lateness.close_hours)} HOURS")
    cutoff = end + F.expr(f"INTERVAL {int(lateness.cutoff_hours)} HOURS")
    kind = F.when(F.col("ingested_at") <= close, ON_TIME).when(F.col("ingested_at") <= cutoff, CORRECTION).otherwise(TOO_LATE)
    return (
        arrivals.where("published_at is not null and source is not null")
        .withColumn("period_day", F.to_date(day))
        .withColumn("arrival_day", F.to_date("ingested_at"))
        .withColumn("arrival", kind)
    )


def period_revisions(records: DataFrame, sources: DataFrame, lateness: Lateness = Lateness()) -> tuple[DataFrame, DataFrame]:
    """Issues of every period, and the records that came too late.

    The first table has one row per issue: ``source, period_day, arrival_day,
    added, records``.  ``arrival_day`` is null for the first issue at the close;
    ``records`` is the count as issued, the earlier issues included (an upsert by
    ``(source, period_day)`` keeps the latest).  A period all of whose records come
    after its close has no first issue.  The second table counts the diverted
    records: ``source, period_day, arrival_day, dropped``.

    Rows without arrival time are ignored, records without event time belong to no
    period.  Empty tables give empty tables.
    """
    seen = classify(first_arrivals(spell_sources(records, sources)), lateness)
    issue = F.when(F.col("arrival") != ON_TIME, F.col("arrival_day"))
    counts = seen.groupBy("source", "period_day", issue.alias("arrival_day"), (F.col("arrival") == TOO_LATE).alias("late")).agg(F.count(F.lit(1)).alias("added"))
    issues = _running(counts.where("not late"))
    dropped = counts.where("late").select("source", "period_day", "arrival_day", F.col("added").alias("dropped"))
    return issues, dropped


def _running(issues: DataFrame) -> DataFrame:
    """Issues with the count as issued; after the aggregation a period has a handful of rows, one per day until its cut-off."""
    so_far = Window.partitionBy("source", "period_day").orderBy(F.col("arrival_day").asc_nulls_first())
    return issues.withColumn("records", F.sum("added").over(so_far)).select("source", "period_day", "arrival_day", "added", "records")


def corrections(issues: DataFrame) -> DataFrame:
    """``(source, period_day, arrival_day)`` of every re-issued period, days as text."""
    again = issues.where("arrival_day is not null")
    return again.select("source", F.date_format("period_day", "yyyy-MM-dd").alias("period_day"), F.date_format("arrival_day", "yyyy-MM-dd").alias("arrival_day"))


class UpsertLog:
    """A table that micro-batches update by key, in a shared folder.

    Every micro-batch writes its rows under its number, so a batch that is run again
    replaces what it wrote before; of a key the row of the latest batch counts.
    """

    def __init__(self, spark: SparkSession, folder: str, *keys: str):
        self.spark, self.folder, self.keys = spark, folder, keys

    def put(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def rows(self, schema: str) -> DataFrame:
        """The table as it stands; ``schema`` names keys and values."""
        logged = self.spark.read.schema(f"{schema}, batch long").parquet(self.folder)
        values = [c for c in logged.columns if c not in (*self.keys, "batch")]
        latest = logged.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
        return latest.select(*self.keys, *[F.col(f"_v.{v}").alias(v) for v in values])


COUNTS = "source string, period_day date, arrival_day date, arrival string, records long"


def start_revision_stream(
    stream: DataFrame,
    sources: DataFrame,
    upsert: Callable[[DataFrame, int], None],
    divert: Callable[[DataFrame, int], None],
    checkpoint: str,
    lateness: Lateness = Lateness(),
    delay: str = "1 day",
    once: bool = True,
):
    """A running query over records in order of arrival, whose state lives in ``checkpoint`` (a shared folder).

    A record that was seen before (source and content) is removed by keyed state.  The
    rest is counted in event-time windows: per source, day of publication, arrival
    class and day of arrival.  A micro-batch emits the windows it changed with their
    counts so far, ``source, period_day, arrival_day, arrival, records``: those that
    came before the cut-off go to ``upsert``, which replaces rows by key, the others
    to ``divert``.  Both get the batch number and may be called again with the same
    one.  Windows whose arrival day is over for longer than ``delay`` by the watermark
    leave the state.  Order of arrival is required between micro-batches; a record
    may be repeated within one only if either row may stand for it, which
    :func:`arrival_waves` sees to.
    """
    rows = spell_sources(stream, sources).withColumn("_same", _same()).where("ingested_at is not null")
    first = rows.withWatermark("ingested_at", delay).dropDuplicates(["source", "_same"])
    seen = classify(first, lateness)
    windows = seen.groupBy("source", "period_day", "arrival", F.window("ingested_at", "1 day")).agg(F.count(F.lit(1)).alias("records"))
    counts = windows.select("source", "period_day", F.to_date("window.start").alias("arrival_day"), "arrival", "records")

    def fold(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            upsert(batch.where(F.col("arrival") != TOO_LATE), number)
            divert(batch.where(F.col("arrival") == TOO_LATE), number)
        finally:
            batch.unpersist()

    writer = counts.writeStream.outputMode("update").foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrival_waves(ws: Workspace, records: DataFrame, sources: DataFrame, waves: int) -> list[str]:
    """A stored table as folders in order of arrival; in each a record occurs once, by its first arrival."""
    per_wave = max(1, -(-parallelism(ws.spark) // waves))
    known = spell_sources(records, sources).where("ingested_at is not null").select("id", "source", "content_hash", "published_at", "ingested_at")
    ranged = known.repartitionByRange(per_wave * waves, "ingested_at").withColumn("wave", F.floor(F.spark_partition_id() / per_wave).cast("int"))
    first = ranged.groupBy("wave", "source", _same().alias("_same")).agg(F.min(F.struct("ingested_at", "id", "published_at", "content_hash")).alias("m"))
    path = ws.path("waves")
    first.select("wave", "source", "m.*").write.partitionBy("wave").parquet(path)
    return [f"{path}/wave={w}" for w in range(waves)]


def replayed_revisions(records: DataFrame, sources: DataFrame, lateness: Lateness = Lateness(), waves: int = 3) -> tuple[DataFrame, DataFrame]:
    """The issues and the diverted records of :func:`period_revisions`, by the running query.

    The records are handed to the query in ``waves`` parts in order of arrival; what
    comes back is its upserted table after the last one.
    """
    spark = records.sparkSession
    ws = Workspace(spark, "revisions")
    parts = arrival_waves(ws, records, sources, waves)
    inbox, state = ws.path("inbox"), ws.path("state")
    keys = ("source", "period_day", "arrival_day", "arrival")
    issued, diverted = (UpsertLog(spark, ws.path(n), *keys) for n in ("issued", "diverted"))
    for log in (issued, diverted):
        log.put(spark.createDataFrame([], COUNTS), -1)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    files = jpath(inbox).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jpath(inbox))
    shape = "source string, ingested_at timestamp, id string, published_at timestamp, content_hash string"
    stream = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(inbox)
    query = start_revision_stream(stream, sources, issued.put, diverted.put, state, lateness, once=False)
    try:
        for n, part in enumerate(parts):
            if files.exists(jpath(part)):
                files.rename(jpath(part), jpath(f"{inbox}/{n}"))
                query.processAllAvailable()
    finally:
        query.stop()
    counts = issued.rows(COUNTS)
    issue = F.when(F.col("arrival") != ON_TIME, F.col("arrival_day"))
    added = counts.groupBy("source", "period_day", issue.alias("arrival_day")).agg(F.sum("records").alias("added"))
    dropped = diverted.rows(COUNTS).select("source", "period_day", "arrival_day", F.col("records").alias("dropped"))
    return _running(added), dropped
