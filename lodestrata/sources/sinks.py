"""Mutations as pure functions: they return the new table, the caller writes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import content_hash


def ingest(existing: DataFrame, incoming: DataFrame, order: str = "ingested_at") -> DataFrame:
    """Incoming records whose content is new, one per content hash, with their hash."""
    hashed = incoming.withColumn("content_hash", content_hash(F.col("title"), F.col("body")))
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(order, "id"))["id"].alias("id"))
    fresh = hashed.join(first, ["content_hash", "id"], "left_semi").dropDuplicates(["content_hash", "id"])
    return fresh.join(existing.select("content_hash"), "content_hash", "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, *keys: str, latest: str | None = None) -> DataFrame:
    """Existing rows replaced by incoming ones with the same key, others added.

    Of incoming rows with one key the one with the largest ``latest`` counts (null is
    smallest), without that column any one of them.
    """
    if latest:
        rest = [c for c in incoming.columns if c not in (*keys, latest)]
        best = incoming.groupBy(*keys).agg(F.max_by(F.struct(latest, *rest), F.struct(latest)).alias("_m"))
        incoming = best.select(*[c if c in keys else F.col(f"_m.{c}").alias(c) for c in incoming.columns])
    else:
        incoming = incoming.dropDuplicates(list(keys))
    return existing.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming)


def insert_new(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Incoming rows whose key is not there yet, one per key."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def get_or_create(existing: DataFrame, names: DataFrame) -> DataFrame:
    """``id, name, entity_type``: ids of known entities, stable ids made of the key for new ones."""
    key = lambda d: d.withColumn("_n", F.lower(F.trim("name")))
    known = key(existing).groupBy("_n", "entity_type").agg(F.min("id").alias("id"))
    wanted = key(names).where("_n is not null").groupBy("_n", "entity_type").agg(F.min("name").alias("name"))
    made = F.sha2(F.concat_ws("|", "_n", "entity_type"), 256)
    return wanted.join(known, ["_n", "entity_type"], "left").select(F.coalesce("id", made).alias("id"), "name", "entity_type")


def set_status(queue: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """Queue rows with their new status appended to the history; ends and errors are noted.

    ``changes`` is ``raw_info_id, new_status, detail``, one row per record.
    """
    c = changes.select("raw_info_id", "new_status", "detail")
    rows = queue.join(c, "raw_info_id", "left")
    t = F.lit(at).cast("timestamp")
    entry = F.array(F.struct(F.col("new_status").alias("status"), t.alias("at"), F.col("detail").alias("detail")))
    changed = F.col("new_status").isNotNull()
    return rows.select(
        "raw_info_id",
        F.coalesce("new_status", "status").alias("status"),
        F.when(changed, F.concat("history", entry)).otherwise(F.col("history")).alias("history"),
        F.when(F.col("new_status") == "preprocessed", t).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(F.col("new_status") == "error", F.col("detail")).otherwise(F.col("last_error")).alias("last_error"),
    )


def set_values(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """A column replaced where ``values`` (key, column) has a new one."""
    new = values.select(key, F.col(column).alias("_v"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


def merge_preferences(old, new):
    """Maps united, the new value counts."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def append_texts(log: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """Texts of a log joined in order with a rule between them, and their number (logs of bounded length per key)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda s: s[text])
    return log.groupBy(key).agg(F.array_join(ordered, "\n\n---\n\n").alias("text"), F.count(F.lit(1)).alias("append_count"))


def merge_states(states: DataFrame, merged: DataFrame) -> DataFrame:
    """States moved to the surviving node; of two with one version the merged node's row is kept."""
    m = merged.where("node_id <> group_id")
    moved = states.join(m, "node_id", "left").withColumn("_v", F.col("group_id").isNotNull().cast("int")).withColumn("node_id", F.coalesce("group_id", "node_id")).drop("group_id")
    w = Window.partitionBy("node_id", "version").orderBy(F.desc("_v"), "id")
    return moved.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_v")


def symmetric_pairs(pairs: DataFrame, id_: str) -> DataFrame:
    """Recorded duplicates of a record, whichever side it is on."""
    return pairs.where((F.col("primary_info_id") == id_) | (F.col("duplicate_info_id") == id_))
