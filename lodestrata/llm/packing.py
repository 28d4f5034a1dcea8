"""Filling fixed-capacity containers with items (problem 9).

First-fit decreasing with a tournament tree of bin capacities, run independently
in randomised groups of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.bpe import count_tokens

#: Items of a group.  First-fit decreasing leaves a few bins of a group part-filled, however large it is.
GROUP_ITEMS = 4096
PACKED = "window_id int, capacity_tokens int, bin_id string, doc_id long, start_token long, n_tokens int"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every item; no size may exceed ``capacity``.

    Items are taken by falling size, equal ones in their order.  A node of the
    tree holds the largest free space among the bins below it; walking down, left
    child first, finds the first bin an item fits into in logarithmic time.
    """
    n = len(sizes)
    bins = np.zeros(n, np.int64)
    leaves = 1 << max(0, n - 1).bit_length()
    free = [capacity] * (2 * leaves)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        node = 1
        while node < leaves:
            node <<= 1
            if free[node] < size:
                node += 1
        bins[item] = node - leaves
        free[node] -= size
        while node > 1:
            left = free[node]
            other = free[node ^ 1]
            node >>= 1
            best = left if left > other else other
            if free[node] == best:
                break
            free[node] = best
    return bins


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack one group; its table has one window and one group number."""
    whole = pa.Table.from_batches(batches)
    if not whole.num_rows:
        return
    order = np.lexsort((whole["k"].to_numpy(), whole["item"].to_numpy()))  # independent of how the rows arrived
    part = whole.take(pa.array(order))
    window, capacity, group = (part[c][0].as_py() for c in ("window_id", "capacity_tokens", "grp"))
    bins = first_fit_decreasing(part["n_tokens"].to_numpy(), capacity)
    names = pa.array([f"{window}-{group}-{b}" for b in bins.tolist()])
    columns = [part["window_id"], part["capacity_tokens"], names, part["doc_id"], part["start_token"], part["n_tokens"]]
    yield from pa.table(columns, ["window_id", "capacity_tokens", "bin_id", "doc_id", "start_token", "n_tokens"]).to_batches()


def pack_items(items: DataFrame, windows: DataFrame, groups: int) -> DataFrame:
    """Assign ``items`` (doc_id, n_tokens) to bins of every window's capacity.

    ``windows`` (window_id, capacity_tokens) is a small table of fixed size; it is
    read by the driver.  Rows of it with a null or non-positive capacity are
    ignored.  An item is cut only if it alone exceeds the capacity: its full pieces
    fill a bin each, the remainder is packed like any item.  Items with null or zero
    tokens need no space and have no row; every row is an item of its own, so
    repeated rows are packed repeatedly.  Returns ``window_id, capacity_tokens,
    bin_id, doc_id, start_token, n_tokens``.

    Groups are drawn by a hash of the item (a repeated row is numbered), so they do not
    depend on how the rows lie, their sizes are even whatever the ids are like, and
    each is packed by one task in bounded memory.
    """
    capacities = [(r[0], r[1]) for r in windows.select("window_id", "capacity_tokens").collect() if r[0] is not None and (r[1] or 0) > 0]
    if not capacities:
        return items.sparkSession.createDataFrame([], PACKED)
    choices = F.array(*[F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(c).cast("int").alias("capacity_tokens")) for w, c in capacities])
    counted = items.where("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("rows"))
    copies = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"))
    drawn = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "copy")
    numbered = copies.select("doc_id", "n_tokens", "copy", drawn.alias("item"), F.pmod(F.shiftright(drawn, 8), F.lit(groups)).cast("int").alias("grp"))
    each = numbered.select("*", F.explode(choices).alias("w")).select("doc_id", "n_tokens", "copy", "item", "grp", "w.*")
    full = F.expr("n_tokens div capacity_tokens")
    pieces = F.when(
        F.col("n_tokens") <= F.col("capacity_tokens"), F.array(F.lit(0).cast("long"))
    ).otherwise(F.expr("sequence(0L, (n_tokens - 1) div capacity_tokens)"))
    cut = (
        each.withColumn("full", F.when(F.col("n_tokens") > F.col("capacity_tokens"), full).otherwise(0))
        .select("*", F.explode(pieces).alias("k"))
        .select(
            "window_id",
            "capacity_tokens",
            "item",
            "k",
            "grp",
            F.when(F.col("k") < F.col("full"), F.concat_ws("-", "window_id", F.lit("x"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens", "copy", "k")).alias("bin_id"),
            "doc_id",
            (F.col("k") * F.col("capacity_tokens")).alias("start_token"),
            F.least(F.col("n_tokens") - F.col("k") * F.col("capacity_tokens"), F.col("capacity_tokens")).cast("int").alias("n_tokens"),
        )
    )
    fixed = cut.where("bin_id is not null").select("window_id", "capacity_tokens", "bin_id", "doc_id", "start_token", "n_tokens")
    packed = cut.where("bin_id is null").drop("bin_id").groupBy("window_id", "grp").applyInArrow(_group, PACKED)
    return packed.unionByName(fixed)


def _group(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(_pack(iter(table.to_batches())))


def pack_documents(documents: DataFrame, windows: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Measure documents in tokens of the public tokenizer and pack them; see :func:`pack_items`."""
    from lodestrata.session import Workspace

    sized = count_tokens(documents, text, (key,), vocabulary).withColumnRenamed(key, "doc_id")
    sized = Workspace(documents.sparkSession, "packing").save(sized, "sizes")  # tokens are counted once for all windows
    return pack_items(sized, windows, math.ceil(max(1, sized.count()) / group_items))
