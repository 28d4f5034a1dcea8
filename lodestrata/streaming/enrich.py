"""Enrichment of incoming records as a stream: dedup, dictionary match, links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import content_hash
from lodestrata.operators.entities import entity_occurrences, match_entities


def enrich_batch(records: DataFrame, terms: DataFrame) -> DataFrame:
    """``id, entity, kind, occurrences, first_position`` of new records, one per content."""
    hashed = records.withColumn("_h", content_hash(F.col("title"), F.col("body")))
    first = hashed.groupBy("_h").agg(F.min("id").alias("id"))
    fresh = hashed.join(first, ["_h", "id"], "left_semi").dropDuplicates(["id"])
    text = fresh.select("id", F.concat_ws(" ", "title", "body").alias("text"))
    return entity_occurrences(match_entities(text, terms, "id", "text"), "id")


def start_enrichment(stream: DataFrame, terms: DataFrame, sink: Callable[[DataFrame, int], None], errors: Callable[[DataFrame, int, Exception], None], checkpoint: str, delay: str = "7 days"):
    """Micro-batches through :func:`enrich_batch`; repeated contents are removed by keyed state.

    A batch that fails goes to ``errors`` as a whole and the stream goes on.
    """
    hashed = stream.withColumn("_h", content_hash(F.col("title"), F.col("body")))
    fresh = hashed.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")

    def run(batch: DataFrame, number: int) -> None:
        try:
            sink(enrich_batch(batch, terms), number)
        except Exception as error:  # the batch is diverted, not lost
            errors(batch, number, error)

    return fresh.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Event-time windows with a watermark, for batch and streaming tables alike."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n")) if events.isStreaming else events.groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key that end after a pause."""
    return events.groupBy(key, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))
