"""Attributes as known at event time (problem 4): bitemporal rectangles on a grid."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.slices import SLICE, slice_rows, spanning
from lodestrata.session import Workspace

#: Microseconds after the last thinkable event; stands for "for ever".
FOREVER = 253_402_300_799_000_000
#: Bits between the cell widths of two levels of the grid, and the level of sides without end.
STEP, OPEN = 3, 99
_RECTANGLES = "k string, v int, t0 long, t1 long, r0 long, r1 long"
_STEPS = f"k string, {SLICE} int, f long, c long"


def _sweep(batches: Iterator[pa.RecordBatch], emit: bool) -> Iterator[pa.RecordBatch]:
    """Versions of each (slice, key) from the latest start to the earliest.

    ``steps`` is the lower envelope of the versions swept so far: for valid times from
    ``f`` on, what was recorded before ``c`` does not know of any of them; ``c`` falls
    from step to step.  A version is current over the steps that it undercuts, one
    rectangle each, and then becomes the first step itself.  So a step is made and
    taken away once, and there are at most two rectangles per version.  Rows without
    version number are steps of later slices.
    """
    at, starts, known = None, [], []  # of the steps, the nearest last

    def flush() -> Iterator[pa.RecordBatch]:
        if not emit and at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([at[1]] * len(starts), pa.string()), ([at[0]] * len(starts), pa.int32()), (starts, pa.int64()), (known, pa.int64()))], ["k", SLICE, "f", "c"])

    for batch in batches:
        out: list[tuple] = []
        ends: list[pa.RecordBatch] = []
        for piece, k, v, f, c, end, until in zip(*(batch[n].to_pylist() for n in (SLICE, "k", "v", "f", "c", "end", "until"))):
            if (piece, k) != at:
                ends += flush()
                at, starts, known = (piece, k), [], []
            own = v is not None
            # steps that were recorded later than this version, or with it, lie last
            first = bisect_left(known, c)
            if own and emit:
                below, r1 = f, FOREVER
                for i in range(len(known) - 1, first - 1, -1):
                    out += _cut(k, v, below, starts[i], c, r1, end, until)
                    below, r1 = starts[i], known[i]
                out += _cut(k, v, below, starts[first - 1] if first else FOREVER, c, r1, end, until)
            del starts[first:], known[first:]
            starts.append(f)
            known.append(c)
        if emit:
            columns = zip(*out) if out else [[]] * 6
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds)], ["k", "v", "t0", "t1", "r0", "r1"])
        yield from ends
    yield from flush()


def _cut(k: str, v: int, t0: int, t1: int, r0: int, r1: int, end: int | None, until: int | None) -> Iterator[tuple]:
    """A rectangle cut where the version ends; what lies after lasts for what was recorded before ``until``."""
    parts = [(t0, t1, r1)] if end is None else [(t0, min(t1, end), r1), (max(t0, end), t1, min(r1, until or r0))]
    return [(k, v, a, b, r0, r) for a, b, r in parts if a < b and r0 < r]


def known_regions(
    states: DataFrame,
    key: str = "node_id",
    version: str = "version",
    start: str = "effective_from",
    end: str = "effective_to",
    recorded: str = "created_at",
    slices: int | None = None,
) -> DataFrame:
    """Disjoint rectangles ``(k, v, t0, t1, r0, r1)`` of valid time x recorded time in which one version is current.

    A version covers the quadrant valid time >= start, recorded time >= recorded.  Of
    the versions whose quadrants hold a point, the one with the latest start is
    current.  Its end cuts it off, unless a following version that starts exactly
    there was recorded later: until that was known, it lasts.

    Repeated rows count once; versions with equal start are ordered by recorded time,
    then version.  Rows with null key, start or recorded time are unknown at all
    times and left out.  Times are in microseconds.  Versions are swept in range
    slices, so one key may hold any share of the rows: a first sweep tells what each
    slice leaves to the ones before it, usually one step, the second makes the
    rectangles.
    """
    ws = Workspace(states.sparkSession, "regions")
    rows = (
        states.select(F.col(key).alias("k"), F.col(version).cast("int").alias("v"), F.unix_micros(start).alias("f"), F.unix_micros(end).alias("end"), F.unix_micros(recorded).alias("c"))
        .where("k is not null and f is not null and c is not null")
        .distinct()
    )
    known = rows.groupBy("k", "f").agg(F.max("c").alias("until"))
    rows = rows.join(known.withColumnsRenamed({"k": "nk", "f": "nf"}), (F.col("k") == F.col("nk")) & (F.col("end") == F.col("nf")) & (F.col("end") > F.col("f")), "left")
    rows = rows.select("k", "v", "f", "c", "end", "until")
    sliced = slice_rows(ws, rows, "k", ["f"], "versions", slices)
    order = [SLICE, "k", F.desc("f"), F.desc("c"), F.desc("v")]
    hot = spanning(sliced, "k")
    parts = sliced.join(F.broadcast(hot), [SLICE, "k"], "left_semi")  # at most two keys per slice
    steps = ws.save(parts.repartition(SLICE, "k").sortWithinPartitions(*order).mapInArrow(lambda b: _sweep(b, False), _STEPS), "steps")
    least = ws.save(parts.groupBy("k", SLICE).agg(F.min("c").alias("least")), "least")
    # a step reaches every slice before it down to the first one that has something recorded no later
    before = least.select(F.col("k").alias("bk"), F.col(SLICE).alias("to"), "least")
    pairs = steps.join(F.broadcast(before), (F.col("k") == F.col("bk")) & (F.col("to") < F.col(SLICE)))
    stop = pairs.where("least <= c").groupBy("k", "f", "c", SLICE).agg(F.max("to").alias("stop"))
    reach = pairs.join(stop, ["k", "f", "c", SLICE], "left").where("stop is null or to >= stop")
    handed = reach.select("k", F.lit(None).cast("int").alias("v"), "f", "c", F.lit(None).cast("long").alias("end"), F.lit(None).cast("long").alias("until"), F.col("to").alias(SLICE))
    swept = sliced.unionByName(handed).repartition(SLICE, "k").sortWithinPartitions(*order)
    return swept.mapInArrow(lambda b: _sweep(b, True), _RECTANGLES)


def _level(low, high):
    """The level of the grid whose cells are as wide as a side, which then lies in at most two of them."""
    bits = F.ceil(F.log2((high - low).cast("double")) / STEP + 1e-9).cast("int")
    return F.when(high >= FOREVER, OPEN).otherwise(F.greatest(bits, F.lit(0)))


def _cell(at, level):
    return F.when(level == OPEN, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", at, F.least(level * STEP, F.lit(62))))


def lookup_as_known(
    events: DataFrame, states: DataFrame, event_key: str, event_time: str, known_time: str | None = None, version: str = "version", slices: int | None = None, **columns: str
) -> DataFrame:
    """Every event with the version that held at ``event_time`` as it was known at ``known_time`` (the same time if None).

    The rectangles of :func:`known_regions` are indexed by a grid of several levels:
    each side goes to the level whose cells are about as wide, so a rectangle lies in
    at most four cells and, rectangles being disjoint, a cell holds a bounded number
    of them, however uneven the versions of a key are; sides without end have a level
    of their own.  An event looks up its cell on each pair of levels that its key
    uses.  Events without a time, or at whose time nothing held, have no row; events
    and their repetitions are kept as they are, with all their columns, and the
    version is added as ``version``.
    """
    ws = Workspace(events.sparkSession, "lookup")
    regions = known_regions(states, version=version, slices=slices, **columns)
    regions = ws.save(regions.withColumn("tl", _level(F.col("t0"), F.col("t1"))).withColumn("rl", _level(F.col("r0"), F.col("r1"))), "regions")
    used = regions.groupBy("k").agg(F.collect_set(F.struct("tl", "rl")).alias("levels"))  # as many pairs as there are levels, not rows
    spans = [F.array_distinct(F.array(_cell(F.col(lo), F.col(level)), _cell(F.col(hi) - 1, F.col(level)))) for lo, hi, level in (("t0", "t1", "tl"), ("r0", "r1", "rl"))]
    cells = regions.select("k", "v", "t0", "t1", "r0", "r1", "tl", "rl", F.explode(spans[0]).alias("tc"), spans[1].alias("_r")).withColumn("rc", F.explode("_r")).drop("_r")
    points = events.withColumn("_k", F.col(event_key)).withColumn("_t", F.unix_micros(event_time)).withColumn("_r", F.unix_micros(known_time or event_time)).where("_k is not null and _t is not null and _r is not null")
    placed = points.join(used.withColumnRenamed("k", "_k"), "_k").withColumn("_l", F.explode("levels")).withColumn("_tl", F.col("_l.tl")).withColumn("_rl", F.col("_l.rl")).drop("levels", "_l")
    placed = placed.withColumn("_tc", _cell(F.col("_t"), F.col("_tl"))).withColumn("_rc", _cell(F.col("_r"), F.col("_rl")))
    same_cell = (F.col("_k") == F.col("k")) & (F.col("_tl") == F.col("tl")) & (F.col("_rl") == F.col("rl")) & (F.col("_tc") == F.col("tc")) & (F.col("_rc") == F.col("rc"))
    inside = (F.col("_t") >= F.col("t0")) & (F.col("_t") < F.col("t1")) & (F.col("_r") >= F.col("r0")) & (F.col("_r") < F.col("r1"))
    hit = placed.join(cells, same_cell & inside).withColumn("version", F.col("v"))
    return hit.drop("_k", "_t", "_r", "_tl", "_rl", "_tc", "_rc", "k", "v", "t0", "t1", "r0", "r1", "tl", "rl", "tc", "rc")


def attached_states(attachments: DataFrame, records: DataFrame, states: DataFrame, slices: int | None = None) -> DataFrame:
    """``(info_id, node_id, version)`` for every record attached to a node.

    Attachments of type ``raw_info`` whose record exists and has a publication time
    are looked up at that time.  Repeated links count once.  The order of arrival
    of the records plays no part.
    """
    links = attachments.where(F.col("attachment_type") == "raw_info").select(F.col("attachment_id").alias("info_id"), "node_id").where("info_id is not null and node_id is not null").distinct()
    times = records.where("published_at is not null and id is not null").select(F.col("id").alias("rec_id"), "published_at")
    events = links.join(times, F.col("info_id") == F.col("rec_id")).select("info_id", "node_id", "published_at")
    events = Workspace(records.sparkSession, "events").save(events, "slim")  # three columns, read twice
    return lookup_as_known(events, states, "node_id", "published_at", slices=slices).select("info_id", "node_id", "version").distinct()
