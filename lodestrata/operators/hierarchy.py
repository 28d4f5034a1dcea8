"""Parent-child links to full hierarchies (problem 3): pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import Workspace

CYCLE = "cycle"


def normal_type(column) -> F.Column:
    """A relationship type in one spelling: lower case, separators as one underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s_\-]+|[\s_\-]+$", "")), r"[\s_\-]+", "_")


def parent_links(
    edges: DataFrame,
    relationship: str = "belongs_to",
    parent: str = "parent_node_id",
    child: str = "child_node_id",
    kind: str = "relationship_type",
) -> DataFrame:
    """Distinct ``(node, parent)`` of one relationship type, one row per node.

    Every id that occurs as parent or child is a node.  A node without parent, or
    whose only parents are null, is a root (null parent).  Where rows give a child
    several parents, the smallest parent id counts, so that the result is a
    forest.  Rows with null child only make their parent a node.
    """
    links = edges.where(normal_type(F.col(kind)) == relationship).select(F.col(child).alias("c"), F.col(parent).alias("p"))
    pairs = F.array(F.struct(F.col("c").alias("node"), F.col("p").alias("parent")), F.struct(F.col("p").alias("node"), F.lit(None).cast("string").alias("parent")))
    return (
        links.select(F.explode(pairs).alias("x"))
        .select("x.node", "x.parent")
        .where("node is not null")
        .groupBy("node")
        .agg(F.min("parent").alias("parent"))
    )


def resolve_roots(links: DataFrame, with_path: bool = False) -> DataFrame:
    """Root, depth and optionally path of every node of ``(node, parent)`` links.

    Pointer doubling: every open node holds a pointer to an ancestor and the
    distance to it; roots point to themselves and are done.  A round joins the open
    pointers with the rows they point to, which doubles the distance, appends the
    path segments and takes over whether the pointer is done.  Depth ``d`` takes
    about ``log2 d`` rounds of one join.  Depths are contiguous along a path, so a
    round in which no open node gets done shows that all that are left run into a
    loop: they get root ``cycle``, depth -1 and a null path.

    Returns ``node, root, depth[, path]``; ``path`` is the array of ids from the root
    to the node, so ids may hold any character.  A parent without a row of its own is
    a root.  The pointer side of each join may be hot (many children of one node)
    while the other side has one row per node, so skewed partitions are split at run
    time by AQE.
    """
    ws = Workspace(links.sparkSession, "hierarchy")
    ends = F.array(F.struct("node", "parent"), F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    complete = links.select(F.explode(ends).alias("x")).select("x.*").where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    own = F.array("node") if with_path else F.array().cast("array<string>")
    top = F.col("parent").isNull()
    #: ptr = ancestor at distance dist, path = the ids below ptr down to the node, or from the root if it is done
    rows = ws.save(complete.select("node", F.coalesce("parent", "node").alias("ptr"), F.when(top, 0).otherwise(1).alias("dist"), top.alias("done"), own.alias("path")), "links")
    done, open_ = rows.where("done"), rows.where("not done")
    before = open_.count()
    while before:
        known = done.unionByName(open_)
        up = known.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"), F.col("path").alias("path2"))
        joined = open_.join(up, "ptr")
        moved = joined.select("node", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), F.concat("path2", "path").alias("path"))
        moved = ws.save(moved, "round")
        done, open_ = done.unionByName(moved.where("done")), moved.where("not done")
        left = open_.count()
        if left == before:
            break
        before = left
    found = done.select("node", F.col("ptr").alias("root"), F.col("dist").alias("depth"), "path")
    looped = open_.select("node", F.lit(CYCLE).alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path"))
    out = found.unionByName(looped)
    return out if with_path else out.drop("path")


def descendants(resolved: DataFrame) -> DataFrame:
    """``(node, descendant, distance)`` for every node above another one.

    ``resolved`` is the result of ``resolve_roots(..., with_path=True)``.  Each path
    is unrolled where it lies, so no join is needed; the number of rows is the sum
    of all depths.  Nodes of loops have no path and do not occur.
    """
    above = resolved.where("depth > 0").select(F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))))
    return above.select(F.col("col").alias("node"), "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """``(node, n_descendants)`` for all nodes; map-side sums keep hot roots small."""
    counts = descendants(resolved).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return resolved.select("node").join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n_descendants"))
