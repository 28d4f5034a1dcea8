"""Consolidating pairwise matches into groups (problem 1).

The giant component is peeled off by breadth-first joins from the vertex of the
highest degree, joined away, and what is left is labelled by minimum propagation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.components import both_ways, minimum_labels
from lodestrata.session import Workspace


def clean_id(column) -> F.Column:
    """Ids as lower case without blanks and braces; what is empty then is null."""
    plain = F.lower(F.regexp_replace(column, r"[\s{}]+", ""))
    return F.when(plain != "", plain)


def linking_pairs(matches: DataFrame, link: str = "merge") -> DataFrame:
    """``(src, dst)`` of the pairs whose latest judgement is ``link``, ``src <= dst``.

    A pair may have been judged in either order and more than once: the latest
    ``judged_at`` counts (null is earliest), of equal ones the highest ``match_id``.
    Rows with a null or blank id are dropped; a null decision links nothing.
    """
    a, b = clean_id(F.col("left_node_id")), clean_id(F.col("right_node_id"))
    rows = matches.select(a.alias("a"), b.alias("b"), "judged_at", "match_id", "decision").where("a is not null and b is not null")
    pair = rows.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.struct("judged_at", "match_id", "decision").alias("j"))
    latest = pair.groupBy("src", "dst").agg(F.max("j").alias("j"))
    return latest.where(F.col("j.decision") == link).select("src", "dst")


def group_links(links: DataFrame, rounds: int = 12) -> DataFrame:
    """``(node, label)`` for every end of ``(src, dst)`` links.

    ``label`` is the smallest node linked with it directly or indirectly; a node
    linked with itself only is its own group.  ``rounds`` bounds the breadth-first
    search: if the giant component is deeper, the part found so far is contracted
    to its smallest node and goes on in the propagation, so that the result does
    not depend on the bound.  Repeated links and self links are harmless; no links
    give no rows.  Hot vertices meet only joins whose other side has one row per
    node, which AQE can split, and minima that are combined before the shuffle.
    """
    ws = Workspace(links.sparkSession, "groups")
    links = ws.save(links, "links")
    arcs = ws.save(both_ways(links), "arcs")
    loops = links.where("src = dst").select(F.col("src").alias("node"))
    top = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("src", F.struct("n", "src")).alias("top"))
    start = top.first()["top"]
    if start is None:
        return loops.distinct().select("node", F.col("node").alias("label"))

    # breadth first from the hub
    visited = ws.save(links.sparkSession.createDataFrame([(start,)], "node string"), "frontier")
    frontier = visited
    for _ in range(rounds):
        reached = arcs.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = ws.save(reached.join(visited, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    giant = ws.save(visited, "giant")
    smallest = giant.agg(F.min("node")).first()[0]

    # join it away; arcs that leave it (only if the search was cut) start at its smallest node
    g = giant.select(F.col("node").alias("g"))
    outside = arcs.join(g, F.col("dst") == F.col("g"), "left_anti")
    inner = outside.join(g, F.col("src") == F.col("g"), "left_anti")
    leaving = outside.join(g, F.col("src") == F.col("g"), "left_semi").select(F.lit(smallest).alias("src"), "dst")
    rest = ws.save(inner.unionByName(both_ways(leaving)).distinct(), "rest")
    labels = minimum_labels(ws, rest)
    settled = labels.where(F.col("node") == smallest).select("label").first()
    whole = giant.select("node", F.lit(settled["label"] if settled else smallest).alias("label"))
    grouped = whole.unionByName(labels.where(F.col("node") != smallest))
    alone = loops.join(grouped, "node", "left_anti").distinct().select("node", F.col("node").alias("label"))
    return grouped.unionByName(alone)


def match_groups(matches: DataFrame) -> DataFrame:
    """``(node_id, group_id)`` for every node in a linking pair, known elsewhere or not."""
    return group_links(linking_pairs(matches)).select(F.col("node").alias("node_id"), F.col("label").alias("group_id"))
