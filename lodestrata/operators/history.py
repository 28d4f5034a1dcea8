"""History of changing attributes (problem 5): gaps and islands over a change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.slices import SLICE, carried, slice_rows
from lodestrata.session import Workspace

#: Runs of these characters count as one blank when two texts are compared.
WHITE_SPACE = r"[ \t\r\n]+"


def build_history(
    feed: DataFrame,
    key: str = "node_id",
    content: str = "core_logic",
    op: str = "op",
    effective: str = "effective_from",
    received: str = "received_at",
    serial: str = "update_id",
    close_op: str = "close",
    slices: int | None = None,
    with_content: bool = True,
) -> DataFrame:
    """Versions ``(key, version, valid_from, valid_to, content)`` of every entity of a feed.

    Of the rows with one key and effective time only the last received counts
    (then the highest serial; a null counts as earliest).  In order of effective
    time a ``close`` ends the open version, another row with null content changes
    nothing, and content that differs from the open version's (but for white
    space), or that meets no open version, starts a version.  ``valid_to`` is null
    for a version that has not ended.

    Gaps and islands: a row whose content hash differs from that of the row before
    starts an island, a running sum numbers the islands, the next border ends them.
    The ordering runs in range slices, so a key with any share of the rows is
    spread over tasks.

    Rows with null key or effective time have no place in a history and are left
    out.  Empty content is content.  Extra columns are ignored; an empty feed
    gives an empty history.
    """
    ws = Workspace(feed.sparkSession, "history")
    text = F.trim(F.regexp_replace(F.col(content), WHITE_SPACE, " "))
    rows = feed.select(
        F.col(key).alias("k"),
        F.col(effective).alias("t"),
        F.col(received).alias("r"),
        F.col(serial).alias("s"),
        (F.lower(F.trim(F.col(op))) == close_op).alias("c"),
        F.col(content).alias("x"),
        F.sha2(text, 256).alias("h"),
    ).where("k is not null and t is not null")
    # struct comparison puts nulls first, so max() takes the latest, then the highest serial
    last = rows.groupBy("k", "t").agg(F.max(F.struct("r", "s", "h", F.coalesce("c", F.lit(False)).alias("c"))).alias("m"))
    state = F.when(F.col("m.c"), F.lit("")).otherwise(F.col("m.h"))
    slim = last.select("k", "t", F.col("m.r").alias("r"), F.col("m.s").alias("s"), state.alias("h")).where("h is not null")
    sliced = slice_rows(ws, slim, "k", ["t"], "feed", slices)

    local = Window.partitionBy(SLICE, "k").orderBy("t")
    before = carried(sliced, "k", [F.max_by("h", "t").alias("h")], [lambda w: F.lag("h").over(w).alias("h0")])
    borders = (
        sliced.withColumn("p", F.lag("h").over(local))
        .join(before, [SLICE, "k"], "left")
        .withColumn("p", F.coalesce("p", "h0", F.lit("")))
        .where("h <> p")
        .drop("p", "h0")
    )
    borders = ws.save(borders, "borders")
    started = F.sum((F.col("h") != "").cast("int"))
    over = carried(
        borders,
        "k",
        [started.alias("n"), F.min("t").alias("t0")],
        [
            lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("n0"),
            lambda w: F.lead("t0").over(w).alias("t1"),
        ],
    )
    versions = (
        borders.withColumn("n", started.over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("e", F.lead("t").over(local))
        .join(over, [SLICE, "k"], "left")
        .where("h <> ''")
        .select("k", "t", "r", "s", (F.col("n") + F.coalesce("n0", F.lit(0))).cast("int").alias("version"), F.coalesce("e", "t1").alias("e"))
    )
    if not with_content:
        return versions.select(F.col("k").alias(key), "version", F.col("t").alias("valid_from"), F.col("e").alias("valid_to"))
    # the content comes back only for rows that start a version; repeated feed rows have one content per (k, t, r, s, h)
    texts = rows.where("h is not null").groupBy("k", "t", "r", "s").agg(F.max(F.struct("h", "x"))["x"].alias("x"))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("r", "s")]
    out = versions.alias("v").join(texts.alias("x"), [F.col("v.k") == F.col("x.k"), F.col("v.t") == F.col("x.t"), *same], "left")
    return out.select(
        F.col("v.k").alias(key), "version", F.col("v.t").alias("valid_from"), F.col("v.e").alias("valid_to"), F.col("x.x").alias(content)
    )


def history_rows(history: DataFrame, key: str = "node_id") -> DataFrame:
    """The history with times as text, ``open`` for a version that has not ended."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    return history.select(
        F.col(key).alias("node_id"),
        F.col("version").cast("int").alias("version"),
        F.date_format("valid_from", stamp).alias("valid_from"),
        F.coalesce(F.date_format("valid_to", stamp), F.lit("open")).alias("valid_to"),
    )
