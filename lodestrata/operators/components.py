"""Connected components by minimum propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import Workspace


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` in both directions, without self links."""
    ways = F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.where("src <> dst").select(F.explode(ways).alias("x")).select("x.src", "x.dst").distinct()


def minimum_labels(ws: Workspace, arcs: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node of each component of symmetric ``(src, dst)`` arcs.

    A round gives every node the smallest label among its own and its neighbours',
    then jumps to the label of that label, so that chains of any length take a
    logarithmic number of rounds.  Minima are combined before the shuffle.  Arcs
    whose ends carry the same label are dropped from later rounds.
    """
    labels = ws.save(arcs.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label")), "labels")
    active = arcs
    while True:
        # contract: arcs between labels instead of nodes
        a = labels.select(F.col("node").alias("src"), F.col("label").alias("ls"))
        b = labels.select(F.col("node").alias("dst"), F.col("label").alias("ld"))
        lifted = active.join(a, "src").join(b, "dst").where("ls <> ld").select(F.col("ls").alias("src"), F.col("ld").alias("dst")).distinct()
        lifted = ws.save(lifted, "arcs")
        if active is not arcs:
            ws.free(active)
        if lifted.isEmpty():
            ws.free(lifted)
            return _flatten(ws, labels)
        # hooks: every label to the smallest label next to it
        hooks = lifted.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("h"), F.least("src", "m").alias("to"))
        hooked = ws.save(labels.join(hooks, F.col("label") == F.col("h"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ws.free(labels)
        labels = _jump(ws, hooked)
        active = lifted


def _jump(ws: Workspace, labels: DataFrame) -> DataFrame:
    up = labels.select(F.col("node").alias("l"), F.col("label").alias("l2"))
    jumped = ws.save(labels.join(up, F.col("label") == F.col("l"), "left").select("node", F.coalesce("l2", "label").alias("label")), "jump")
    ws.free(labels)
    return jumped


def _flatten(ws: Workspace, labels: DataFrame) -> DataFrame:
    """Follow labels until every label labels itself."""
    while True:
        moved = labels.alias("a").join(labels.where("node <> label").select(F.col("node").alias("l")), F.col("label") == F.col("l"), "left_semi")
        if moved.isEmpty():
            return labels
        labels = _jump(ws, labels)
