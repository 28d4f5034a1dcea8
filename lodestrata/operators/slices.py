"""Range slices: ordered computations per key without one task per key.

A window ``PARTITION BY key ORDER BY t`` puts all rows of a key into one task.
A key with a third of all rows would make that task unbounded.  Here the rows
are range-partitioned by (key, t) into slices of about equal size, so that a
hot key covers several slices; windows run per (slice, key), and what crosses a
slice's border is carried over through a table that has at most two rows per
slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import Workspace, parallelism

SLICE = "_slice"


def slice_rows(ws: Workspace, df: DataFrame, key: str, order: list[str], tag: str, slices: int | None = None) -> DataFrame:
    """Write ``df`` range-partitioned by ``key`` and ``order`` with a slice number.

    Slices follow the sort order.  Rows equal in key and order share a slice.
    """
    n = slices or parallelism(ws.spark)
    ranged = df.repartitionByRange(n, key, *order).withColumn(SLICE, F.spark_partition_id())
    return ws.save(ranged, tag)


def spanning(sliced: DataFrame, key: str) -> DataFrame:
    """The (slice, key) pairs of keys that lie in more than one slice.

    A key that spans slices is the first or the last of each of its slices, so
    the result has at most two rows per slice: its size does not grow with the
    data but with the number of slices.
    """
    ends = sliced.groupBy(SLICE).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    pairs = ends.select(SLICE, F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias(key))
    several = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    return pairs.join(F.broadcast(several), key).select(SLICE, key)


def carried(sliced: DataFrame, key: str, aggregates: list, carry: list) -> DataFrame:
    """Per spanning (slice, key): ``aggregates`` of the slice, then ``carry`` over slices.

    ``aggregates`` are grouped expressions, ``carry`` are functions of a window
    over the slices of a key.  The table has at most two rows per slice and is
    marked for broadcast on that ground.
    """
    keys = F.broadcast(spanning(sliced, key))
    per_slice = sliced.join(keys, [SLICE, key], "left_semi").groupBy(SLICE, key).agg(*aggregates)
    over = Window.partitionBy(key).orderBy(SLICE)
    return F.broadcast(per_slice.select(SLICE, key, *[c(over) for c in carry]))
