"""Weighted entity graphs: impact paths, evidence, neighbours, edges and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scoring import evidence_confidence
from lodestrata.functions.text import clean_name
from lodestrata.operators.hierarchy import normal_type
from lodestrata.session import Workspace

#: Fixed values: (parent type, child type) -> type of the edge between them.
EDGE_TYPES = {
    ("company", "sector"): "belongs_to", ("sector", "macro_theme"): "belongs_to", ("sector", "sector"): "belongs_to", ("concept", "sector"): "classified_as",
    ("sector", "concept"): "belongs_to", ("company", "product"): "has_business_segment", ("company", "company"): "competes_in", ("company", "person"): "led_by",
    ("institution", "person"): "led_by", ("person", "institution"): "affiliated_with", ("company", "region"): "based_in", ("institution", "region"): "based_in",
    ("policy", "sector"): "regulated_by", ("sector", "policy"): "regulated_by", ("policy", "company"): "regulated_by", ("macro_theme", "sector"): "belongs_to",
    ("concept", "concept"): "belongs_to",
}
#: Both spellings of the macro type are accepted.
TYPE_SYNONYMS = {"macro": "macro_theme"}


def weighted_edges(edges: DataFrame) -> DataFrame:
    """Distinct ``(src, dst, kind, strength)`` with the confidence of its evidence in the strength.

    Strength is the weight (1 if null) times the confidence; of repeated edges the
    strongest counts; edges with a null end are left out.
    """
    n = F.size(F.coalesce("evidence_ids", F.array().cast("array<string>")))
    s = F.coalesce("weight", F.lit(1.0)) * evidence_confidence(n)
    rows = edges.where("parent_node_id is not null and child_node_id is not null")
    kind = normal_type(F.col("relationship_type")).alias("kind")
    return rows.groupBy(F.col("parent_node_id").alias("src"), F.col("child_node_id").alias("dst"), kind).agg(F.max(s).alias("strength"))


def impact_paths(edges: DataFrame, sources: DataFrame, depth: int = 3, decay: float = 0.8, direction: str = "downstream") -> DataFrame:
    """``(source, node, level, strength)``: breadth-first impact with decay, every node once per source.

    ``edges`` are ``src, dst, strength``; ``sources`` has one column ``source`` and may
    hold many sources, which are searched together.  The first hop counts in full,
    each later one ``cumulative * decay * strength``; of several ways into a node on
    one level the strongest counts.  The depth (1 to 5) bounds the loop, whatever the
    data; nodes already visited leave by an anti join.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be 1 to 5")
    ws = Workspace(edges.sparkSession, "impact")
    down = edges.select("src", "dst", "strength")
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength")
    arcs = ws.save({"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction].groupBy("src", "dst").agg(F.max("strength").alias("strength")), "arcs")
    frontier = sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("strength")).distinct()
    visited = frontier.select("source", "node")
    found = None
    for level in range(1, depth + 1):
        hop = arcs.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("strength").alias("s"))
        factor = F.lit(1.0 if level == 1 else decay)
        reached = frontier.join(hop, "node").groupBy("source", F.col("next").alias("node")).agg(F.max(F.col("strength") * factor * F.col("s")).alias("strength"))
        frontier = ws.save(reached.join(visited, ["source", "node"], "left_anti"), f"level{level}")
        visited = visited.unionByName(frontier.select("source", "node"))
        step = frontier.select("source", "node", F.lit(level).alias("level"), F.round("strength", 6).alias("strength"))
        found = step if found is None else found.unionByName(step)
    return found


def neighbours(edges: DataFrame) -> DataFrame:
    """``(node_id, n_parents, n_children)`` over distinct edges with both ends."""
    e = edges.where("parent_node_id is not null and child_node_id is not null").select("parent_node_id", "child_node_id").distinct()
    ends = F.array(F.struct(F.col("parent_node_id").alias("node_id"), F.lit(0).alias("p"), F.lit(1).alias("c")), F.struct(F.col("child_node_id").alias("node_id"), F.lit(1).alias("p"), F.lit(0).alias("c")))
    return e.select(F.explode(ends).alias("x")).groupBy("x.node_id").agg(F.sum("x.p").alias("n_parents"), F.sum("x.c").alias("n_children"))


def state_evidence(states: DataFrame, records: DataFrame, first: int = 10) -> DataFrame:
    """``(state_id, position, info_id)``: the first evidence ids of a state that have a record, in order."""
    ids = states.select(F.col("id").alias("state_id"), F.posexplode(F.slice(F.coalesce("key_evidence_ids", F.array().cast("array<string>")), 1, first)).alias("position", "info_id"))
    return ids.join(records.select(F.col("id").alias("info_id")), "info_id", "left_semi").select("state_id", "position", "info_id")


def record_uses(records: DataFrame, states: DataFrame) -> DataFrame:
    """``(info_id, n_states)``: in how many states a record is evidence."""
    uses = states.select("id", F.explode("key_evidence_ids").alias("info_id")).distinct().groupBy("info_id").agg(F.count(F.lit(1)).alias("n_states"))
    return uses.join(records.select(F.col("id").alias("info_id")), "info_id", "left_semi")


def fold_relationships(events: DataFrame, cap: int = 20) -> DataFrame:
    """Running mean of relation strengths in order of arrival.

    ``events`` are ``src, dst, kind, at, id, strength, evidence``.  A first strength is
    taken as it is; each further one moves the mean with the weight of the evidence
    so far (at most ``cap``), rounded to four digits; null strengths change nothing;
    evidence is united in order.  The fold is per relation, whose events are few.
    """
    ordered = F.array_sort(F.collect_list(F.struct("at", "id", "strength", "evidence")))
    empty = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast("array<string>").alias("e"))

    def step(acc, x):
        n = F.least(F.size(acc["e"]), F.lit(cap))
        mean = F.round((acc["s"] * n + x["strength"]) / (n + 1), 4)
        s = F.when(x["strength"].isNull(), acc["s"]).when(acc["s"].isNull(), x["strength"]).otherwise(mean)
        e = F.when(x["evidence"].isNull() | F.array_contains(acc["e"], x["evidence"]), acc["e"]).otherwise(F.array_append(acc["e"], x["evidence"]))
        return F.struct(s.alias("s"), e.alias("e"))

    folded = events.groupBy("src", "dst", "kind").agg(F.aggregate(ordered, empty, step).alias("f"))
    return folded.select("src", "dst", "kind", F.col("f.s").alias("strength"), F.size("f.e").alias("n_evidence"))


def edge_type(parent_type, child_type):
    """The type of an edge between two node types; null if there is no rule."""
    same = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_SYNONYMS.items() for x in kv])[c], c)
    pairs = [F.lit(x) for (p, c), e in EDGE_TYPES.items() for x in (f"{p}>{c}", e)]
    return F.create_map(*pairs)[F.concat_ws(">", same(parent_type), same(child_type))]


def containment_edges(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Edges between nodes of which one's cleaned name holds the other's, typed by the rule of their types.

    Blocking by stretches of three characters replaces the comparison of all pairs: a
    name that holds another has all its stretches, so the shorter one waits under its
    rarest only.  Names shorter than ``least`` (three or more) hold nothing.
    """
    ws = Workspace(nodes.sparkSession, "containment")
    named = nodes.where("id is not null and name is not null").select("id", "node_type", F.lower(clean_name(F.col("name"))).alias("n")).where(F.length("n") >= max(3, least))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("n") - 2), lambda i: F.substring(F.col("n"), i, F.lit(3))))
    each = ws.save(named.select("id", "node_type", "n", F.explode(grams).alias("g")), "stretches")
    counts = each.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rarest = each.join(counts, "g").groupBy("id", "node_type", "n").agg(F.min(F.struct("df", "g"))["g"].alias("g"))
    longer = each.select(F.col("id").alias("child"), F.col("node_type").alias("ct"), F.col("n").alias("cn"), "g")
    shorter = rarest.select(F.col("id").alias("parent"), F.col("node_type").alias("pt"), F.col("n").alias("pn"), "g")
    hit = longer.join(shorter, "g").where((F.length("cn") > F.length("pn")) & F.col("cn").contains(F.col("pn")))
    typed = hit.withColumn("kind", F.coalesce(edge_type(F.col("ct"), F.col("pt")), edge_type(F.col("pt"), F.col("ct")))).where("kind is not null")
    return typed.select(F.col("parent").alias("parent_node_id"), F.col("child").alias("child_node_id"), F.col("kind").alias("relationship_type")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``(node, label)``: communities by synchronous label propagation over undirected edges.

    In a round every node takes the label with the largest summed strength among its
    neighbours (ties: the smaller label).  The modularity method of the same purpose
    has no distributed exact form; this is a different, deterministic community.
    """
    ws = Workspace(edges.sparkSession, "labels")
    w = F.when(F.coalesce("strength", F.lit(0.0)) == 0, 1.0).otherwise(F.col("strength"))
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    arcs = ws.save(edges.where("src <> dst").withColumn("w", w).select(F.explode(ways).alias("x"), "w").groupBy("x.src", "x.dst").agg(F.sum("w").alias("w")), "arcs")
    labels = arcs.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        votes = arcs.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.round(F.sum("w"), 9).alias("v"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("v")).alias("v"), "label")).alias("m"))
        labels = ws.save(best.select(F.col("src").alias("node"), F.col("m.label").alias("label")), "labels")
    return labels


def merge_nodes(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges after nodes were merged: ids remapped, repetitions and self loops removed.

    ``merged`` is ``node_id, group_id``; the smallest id of the rest is kept.
    """
    m = merged.where("node_id <> group_id")
    p = m.withColumnsRenamed({"node_id": "parent_node_id", "group_id": "_p"})
    c = m.withColumnsRenamed({"node_id": "child_node_id", "group_id": "_c"})
    moved = edges.join(p, "parent_node_id", "left").join(c, "child_node_id", "left")
    moved = moved.select("id", F.coalesce("_p", "parent_node_id").alias("parent_node_id"), F.coalesce("_c", "child_node_id").alias("child_node_id"), normal_type(F.col("relationship_type")).alias("relationship_type"))
    kept = moved.where("parent_node_id is null or parent_node_id <> child_node_id")
    return kept.groupBy("parent_node_id", "child_node_id", "relationship_type").agg(F.min("id").alias("id"))


def dominant_edges(edges: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` strongest edges of each node."""
    rows = edges.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("strength"), "dst", "kind")))
    return rows.where(F.col("rank") <= k)
