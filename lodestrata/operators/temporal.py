"""Versioned states: as-of reads, differences, chain checks and repair, change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.slices import SLICE, carried, slice_rows
from lodestrata.session import Workspace


def valid_at(rows: DataFrame, at: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Rows that hold at a time: ``start <= at < end``; a null end is open."""
    t = F.lit(at).cast("timestamp")
    return rows.where((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))


def as_of_state(states: DataFrame, at: str) -> DataFrame:
    """Per node the version with the latest start that holds at a time, one row per node."""
    best = F.max(F.struct("effective_from", "version", "id")).alias("m")
    return valid_at(states, at).groupBy("node_id").agg(best).select("node_id", F.col("m.version").alias("version"), F.col("m.id").alias("id"))


def as_of_counts(tables: dict[str, tuple[DataFrame, str]], at: str) -> DataFrame:
    """``(name, rows)``: rows of each table known at a time."""
    parts = [t.where(F.col(c) <= F.lit(at).cast("timestamp")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, (t, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def state_diff(states: DataFrame, a: str, b: str, items: str = "primary_drivers", field: str = "driver") -> DataFrame:
    """Per node with a state at both times: versions, and the items that came and went."""
    names = F.array_distinct(F.transform(F.coalesce(F.col(items), F.array().cast(states.schema[items].dataType)), lambda x: x[field]))
    at = lambda t: as_of_state(states, t).join(states.select("id", names.alias("items")), "id").drop("id")
    old, new = at(a).withColumnsRenamed({"version": "version_a", "items": "ia"}), at(b).withColumnsRenamed({"version": "version_b", "items": "ib"})
    return old.join(new, "node_id").select("node_id", "version_a", "version_b", F.sort_array(F.array_except("ib", "ia")).alias("added"), F.sort_array(F.array_except("ia", "ib")).alias("removed"))


def version_gaps(states: DataFrame, slices: int | None = None) -> DataFrame:
    """``(node_id, version, next_version)`` where a following version number is missing; ordered in range slices."""
    ws = Workspace(states.sparkSession, "gaps")
    steps = states.select("node_id", "version").where("node_id is not null and version is not null").distinct()
    sliced = slice_rows(ws, steps, "node_id", ["version"], "steps", slices)
    after = carried(sliced, "node_id", [F.min("version").alias("first1")], [lambda w: F.lead("first1").over(w).alias("_after")])
    own = F.lead("version").over(Window.partitionBy(SLICE, "node_id").orderBy("version"))
    rows = sliced.withColumn("_own", own).join(after, [SLICE, "node_id"], "left").withColumn("next_version", F.coalesce("_own", "_after"))
    return rows.where(F.col("next_version") > F.col("version") + 1).select("node_id", "version", "next_version")


def repair_chain(states: DataFrame, garbage) -> DataFrame:
    """Drop garbage, zero-width and repeated versions; the kept row before takes over the end of what was dropped.

    ``garbage`` is a predicate.  Of rows with one node and version the first by id is
    kept.  A node of which nothing is left has no rows.
    """
    order = Window.partitionBy("node_id").orderBy("effective_from", "version", "id")
    first = F.row_number().over(Window.partitionBy("node_id", "version").orderBy("id")) == 1
    width = F.col("effective_to").isNotNull() & (F.col("effective_from") == F.col("effective_to"))
    marked = states.withColumn("_keep", first & ~width & ~F.coalesce(garbage, F.lit(False)))
    grouped = marked.withColumn("_run", F.sum(F.col("_keep").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = Window.partitionBy("node_id", "_run").orderBy("effective_from", "version", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ended = grouped.withColumn("_end", F.last(F.struct("effective_to")).over(last)["effective_to"])
    return ended.where("_keep").withColumn("effective_to", F.col("_end")).drop("_keep", "_run", "_end")


def append_versions(changes: DataFrame, key: str, at: str, serial: str, carry: list[str], slices: int | None = None) -> DataFrame:
    """Versions of a change log: number, start, end (next start), omitted fields carried forward.

    Ordered in range slices, so a key may hold any share of the rows: what crosses a
    slice's border is its number of rows, its first start and its last known fields.
    Rows with null key are left out.
    """
    ws = Workspace(changes.sparkSession, "versions")
    slim = changes.where(F.col(key).isNotNull()).select(key, at, serial, *carry)
    sliced = slice_rows(ws, slim, key, [at, serial], "log", slices)
    known = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(at, serial))).alias(f"k{i}") for i, c in enumerate(carry)]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    crossing = [lambda w: F.sum("n1").over(before(w)).alias("_n"), lambda w: F.lead("first1").over(w).alias("_next")]
    crossing += [lambda w, i=i: F.last(f"k{i}", ignorenulls=True).over(before(w)).alias(f"_k{i}") for i in range(len(carry))]
    border = carried(sliced, key, [F.count(F.lit(1)).alias("n1"), F.min(at).alias("first1"), *known], crossing)
    w = Window.partitionBy(SLICE, key).orderBy(at, serial)
    rows = sliced.withColumn("_own", F.row_number().over(w)).withColumn("_lead", F.lead(at).over(w))
    for i, c in enumerate(carry):
        rows = rows.withColumn(f"_c{i}", F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(border, [SLICE, key], "left")
    fields = [F.coalesce(f"_c{i}", f"_k{i}").alias(c) for i, c in enumerate(carry)]
    number = (F.col("_own") + F.coalesce("_n", F.lit(0))).cast("int").alias("version")
    return rows.select(key, number, F.col(at).alias("effective_from"), F.coalesce("_lead", "_next").alias("effective_to"), *fields)


def cumulative_union(rows: DataFrame, key: str, at: str, serial: str, items: str) -> DataFrame:
    """Ordered union of the items of all versions so far (for histories of bounded length per key)."""
    w = Window.partitionBy(key).orderBy(at, serial).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(items, F.array_distinct(F.flatten(F.collect_list(F.col(items)).over(w))))


def extend_validity(rows: DataFrame, ids: list, until: str) -> DataFrame:
    hit = F.col("id").isin(ids) if ids else F.lit(False)
    return rows.withColumn("extended_count", F.col("extended_count") + F.when(hit, 1).otherwise(0)).withColumn(
        "valid_until", F.when(hit, F.lit(until).cast("timestamp")).otherwise(F.col("valid_until"))
    )


def expire_validity(rows: DataFrame, ids: list, at: str, reason: str) -> DataFrame:
    hit = F.col("id").isin(ids) if ids else F.lit(False)
    return rows.withColumn("valid_until", F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("valid_until"))).withColumn(
        "invalidation_reason", F.when(hit, F.lit(reason)).otherwise(F.col("invalidation_reason"))
    )


def compress_states(states: DataFrame, ratio: float = 0.3, least: int = 500, force: bool = False) -> DataFrame:
    """Content of long states cut to a share of its length; short ones stay unless forced."""
    n = F.length("core_logic")
    cut = F.substring("core_logic", F.lit(1), F.ceil(n * ratio).cast("int"))
    return states.withColumn("core_logic", F.when((n >= least) | F.lit(force), cut).otherwise(F.col("core_logic")))
