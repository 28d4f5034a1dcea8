"""Duplicate checks and pair scans of the knowledge base."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import content_hash, levenshtein_ratio, normalized_name
from lodestrata.operators.components import both_ways, minimum_labels
from lodestrata.operators.pair_blocks import grouped, near_pairs, near_sequences
from lodestrata.session import Workspace, parallelism


def hash_mismatches(records: DataFrame) -> DataFrame:
    """Records whose stored hash is not that of their title and body."""
    return records.select("id", "content_hash", content_hash(F.col("title"), F.col("body")).alias("h")).where("not (content_hash <=> h)").select("id")


def first_of_content(records: DataFrame) -> DataFrame:
    """One record per content: the first to arrive, ties by id."""
    first = F.min(F.struct("ingested_at", "id")).alias("m")
    return records.where("content_hash is not null").groupBy("content_hash").agg(first, F.count(F.lit(1)).alias("n")).select("content_hash", F.col("m.id").alias("id"), "n")


def _parts(texts: DataFrame, rows_per_part: int) -> DataFrame:
    """``(kind, parts, p, id, t)``: the rows ``kind, t, id``, each in one part of its kind."""
    sizes = texts.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / rows_per_part).cast("int").alias("parts"))
    return texts.join(sizes, "kind").select("kind", "parts", F.pmod(F.xxhash64("t"), "parts").cast("int").alias("p"), "id", "t")


def title_parts(records: DataFrame, kind: str, rows_per_part: int) -> DataFrame:
    """``(kind, parts, p, id, t)``: titles of at least two characters, each in one part of its kind.

    Equal titles are taken once, by the smallest id with that title.  A shorter title has
    no character pair in common with another title.
    """
    titled = records.where(F.col(kind).isNotNull() & (F.length("title") > 0)).select(F.col(kind).alias("kind"), F.lower("title").alias("t"), "id")
    return _parts(titled.where(F.length("t") > 1).groupBy("kind", "t").agg(F.min("id").alias("id")).where("id is not null"), rows_per_part)


def _tasks(records: DataFrame, kind: str, rows_per_part: int, text: str = "title") -> int:
    """Number of partitions for the pairs of parts: those of a large kind are many tasks, small kinds share one."""
    parts = F.ceil(F.col("n") / rows_per_part)
    sizes = records.groupBy(kind).agg(F.count(text).alias("n"))
    pairs, work = sizes.agg(F.sum(parts * (parts + 1) / 2), F.sum((F.col("n") / rows_per_part) ** 2)).first()
    return max(1, min(int(pairs or 1), max(parallelism(records.sparkSession), int(2 * (work or 0)))))


def _blocks(parts: DataFrame, others, *columns: str) -> DataFrame:
    """Titles with the pairs of parts ``(i, j)`` that they are compared in; ``others`` are the parts that a title meets."""
    met = parts.withColumn("o", F.explode(others))
    return met.select("kind", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "p", "id", "t", *columns)


def title_pairs(records: DataFrame, least: float = 0.5, kind: str = "info_type", rows_per_block: int = 16000) -> DataFrame:
    """``(a, b, similarity)``: titles of one kind with a share of common character pairs, exact (see :mod:`pair_blocks`).

    Equal titles are compared once, by the smallest id with that title.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return near_pairs(batches, least)

    id_ = records.schema["id"].dataType.simpleString()
    blocks = _blocks(title_parts(records, kind, rows_per_block), F.sequence(F.lit(0), F.col("parts") - 1))
    blocks = blocks.repartition(_tasks(records, kind, rows_per_block), "kind", "i", "j")
    found = blocks.groupBy("kind", "i", "j").applyInArrow(near, f"a {id_}, b {id_}, s double")
    return found.select("a", "b", F.round("s", 6).alias("similarity"))


def title_groups(records: DataFrame, least: float = 0.5, kind: str = "info_type", rows_per_block: int = 16000) -> DataFrame:
    """``(node, label)``: the groups of :func:`title_pairs`; label is the smallest id.

    The pairs themselves are never written.  Parts are grouped first; then two parts need
    only the pairs that link different groups, and give one row for each group they link.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(batches, least)

    ws = Workspace(records.sparkSession, "title-groups")
    id_, tasks = records.schema["id"].dataType.simpleString(), _tasks(records, kind, rows_per_block)
    blocks = _blocks(title_parts(records, kind, rows_per_block), F.array("p"), "parts").repartition(tasks, "kind", "i", "j")
    kind_ = records.schema[kind].dataType.simpleString()
    parts = ws.save(blocks.groupBy("kind", "i", "j").applyInArrow(links, f"kind {kind_}, p int, id {id_}, t string, parts int, top {id_}"), "parts")
    blocks = _blocks(parts, F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("p")), "top").repartition(tasks, "kind", "i", "j")
    across = blocks.groupBy("kind", "i", "j").applyInArrow(links, f"id {id_}, top {id_}")
    arcs = ws.save(both_ways(parts.select("id", "top").unionByName(across).select(F.col("id").alias("src"), F.col("top").alias("dst"))), "arcs")
    ws.free(parts)
    return minimum_labels(ws, arcs)


def pair_groups(pairs: DataFrame) -> DataFrame:
    """``(node, label)`` groups of ``(a, b)`` pairs; label is the smallest id."""
    ws = Workspace(pairs.sparkSession, "pair-groups")
    arcs = ws.save(both_ways(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "arcs")
    return minimum_labels(ws, arcs)


def keep_best(rows: DataFrame, groups: DataFrame, key: str, time: str, score: str) -> DataFrame:
    """Of each group the row with a time, the latest, the best score; rows without group stay."""
    joined = rows.join(groups.withColumnsRenamed({"node": key, "label": "_g"}), key, "left").withColumn("_g", F.coalesce("_g", key))
    order = Window.partitionBy("_g").orderBy(F.col(time).desc_nulls_last(), F.desc(score), key)
    return joined.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_g", "_r")


def name_blocks(nodes: DataFrame) -> DataFrame:
    """Distinct normal names per type, each with the smallest id that bears it."""
    named = nodes.where("id is not null and name is not null").select("id", "node_type", normalized_name(F.col("name")).alias("n")).where("n <> ''")
    return named.groupBy("node_type", "n").agg(F.min("id").alias("id"))


def name_classes(nodes: DataFrame) -> DataFrame:
    """``(id, class_id)``: every node, and the smallest id of its type with the same normal name (see :func:`name_blocks`)."""
    named = nodes.where("id is not null and name is not null").select("id", "node_type", normalized_name(F.col("name")).alias("n")).where("n <> ''")
    return named.join(name_blocks(nodes).withColumnRenamed("id", "class_id"), ["node_type", "n"]).select("id", "class_id")


def title_classes(records: DataFrame, kind: str = "info_type") -> DataFrame:
    """``(id, class_id)``: every record with a title, and the smallest id of its kind with the same title (see :func:`title_pairs`)."""
    titled = records.where("title is not null and title <> ''").select(kind, F.lower("title").alias("t"), "id")
    return titled.join(titled.groupBy(kind, "t").agg(F.min("id").alias("class_id")), [kind, "t"]).select("id", "class_id")


def _piece_pairs(names: DataFrame, longest, edits) -> DataFrame:
    """``(ia, ib, x, y)``: candidates within a number of edits, x not longer than y.

    ``longest`` and ``edits`` give, for lengths ``la <= lb``, the largest ``lb`` and the
    edits allowed.  ``d`` edits leave one of ``d + 1`` pieces of x intact, which y holds
    at a place shifted by at most ``d``.
    """
    named = names.where(F.length("n") >= 2).withColumn("la", F.length("n"))
    sized = named.withColumn("lb", F.explode(F.sequence(F.col("la"), longest(F.col("la")))))
    sized = sized.withColumn("d", F.least(edits(F.col("la"), F.col("lb")), F.col("la") - 1))
    border = lambda i: F.floor(i * F.col("la") / (F.col("d") + 1)).cast("int")
    piece = F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.struct(border(i).alias("at"), (border(i + 1) - border(i)).alias("size")))
    left = sized.select("node_type", F.col("id").alias("ia"), F.col("n").alias("x"), "d", "lb", F.explode(piece).alias("p"))
    left = left.select("node_type", "ia", "x", "d", "lb", F.substring("x", F.col("p.at") + 1, F.col("p.size")).alias("piece"), F.col("p.at").alias("at"), F.col("p.size").alias("size"))
    used = left.select("node_type", "lb", "size").distinct()
    whole = named.select("node_type", F.col("id").alias("ib"), F.col("n").alias("y"), F.col("la").alias("lb"))
    right = whole.join(used, ["node_type", "lb"]).withColumn("place", F.explode(F.sequence(F.lit(0), F.greatest(F.col("lb") - F.col("size"), F.lit(0)))))
    right = right.select("node_type", "ib", "y", "lb", "size", "place", F.substring("y", F.col("place") + 1, F.col("size")).alias("piece"))
    hit = left.join(right, ["node_type", "lb", "size", "piece"]).where((F.abs(F.col("at") - F.col("place")) <= F.col("d")) & (F.col("ia") != F.col("ib")))
    return hit.select("ia", "ib", "x", "y").distinct()


def levenshtein_pairs(nodes: DataFrame, least: float = 0.85) -> DataFrame:
    """``(a, b, ratio)``: names of one type with few edits for their length, exact.

    Names are compared once, by the smallest id that bears them; :func:`name_classes` has the others.
    """
    most = lambda longer: F.floor((1 - least) * longer + 1e-9).cast("int")
    found = _piece_pairs(name_blocks(nodes), lambda la: F.floor(la / least + 1e-9).cast("int"), lambda la, lb: most(lb))
    scored = found.withColumn("r", levenshtein_ratio(F.col("x"), F.col("y"))).where(F.round("r", 9) >= least)
    return scored.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), F.round("r", 6).alias("ratio")).distinct()


def sequence_ratio_pairs(nodes: DataFrame, least: float = 0.8, rows_per_block: int = 8000) -> DataFrame:
    """``(a, b, ratio)``: names of one type by their matching blocks, exact; classes as in :func:`levenshtein_pairs`.

    Blocks of ``m`` letters give ``2m / (la + lb)``, so a pair that reaches the ratio has
    as many letters in common; those pairs are found in blocks (see :mod:`pair_blocks`).
    The ratio depends on the order of the two names; the larger one counts.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return near_sequences(batches, least)

    id_ = nodes.schema["id"].dataType.simpleString()
    names = name_blocks(nodes).where(F.col("node_type").isNotNull() & (F.length("n") > 1)).select(F.col("node_type").alias("kind"), F.col("n").alias("t"), "id")
    blocks = _blocks(_parts(names, rows_per_block), F.sequence(F.lit(0), F.col("parts") - 1))
    blocks = blocks.repartition(_tasks(nodes, "node_type", rows_per_block, "name"), "kind", "i", "j")
    found = blocks.groupBy("kind", "i", "j").applyInArrow(near, f"a {id_}, b {id_}, s double")
    return found.groupBy("a", "b").agg(F.round(F.max("s"), 6).alias("ratio"))


def same_key_pairs(rows: DataFrame, key, id_: str = "id") -> DataFrame:
    """``(first, id)``: every record with a key, and the smallest id with the same key (not all pairs)."""
    keyed = rows.select(id_, key.alias("_key")).where("_key is not null and _key <> ''")
    firsts = keyed.groupBy("_key").agg(F.min(id_).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(firsts, "_key").where(F.col(id_) != F.col("first")).select("first", F.col(id_).alias("id"))


def sequence_ratio(pairs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Pairs with their matching-blocks ratio; JVM functions cannot express it, so it runs in Arrow batches."""
    schema = T.StructType([*pairs.schema, T.StructField("ratio", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ratios = [SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(batch[a], batch[b])]
            yield batch.assign(ratio=ratios)

    return pairs.mapInPandas(run, schema).where(F.col("ratio") >= least)


def vector_links(vectors: DataFrame, least: float, key: str, vector: str, block: str, rows_per_block: int = 2000) -> DataFrame:
    """``(a, b)``: vectors of one block at a cosine similarity, exact.

    The rows of a block are cut into parts by its size; each pair of parts is one
    task's matrix product, and only the links leave it.  Rows are never joined pair by
    pair, small blocks are not copied.  Rows with a null block or vector have no links.
    """
    unit = vectors.where(F.col(vector).isNotNull() & F.col(block).isNotNull()).select(F.col(key).alias("k"), F.col(block).cast("string").alias("blk"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    sizes = unit.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("parts"))
    placed = unit.join(sizes, "blk").withColumn("p", F.pmod(F.xxhash64("k"), "parts").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("k", "blk", "v", "p", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"))

    def links(table: pa.Table) -> pa.Table:
        k, part = (table[c].to_numpy() for c in ("k", "p"))
        v = np.array(table["v"].to_pylist(), np.float64)
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        v = v / np.where(norm > 0, norm, 1)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        x, y = np.flatnonzero(part == i), np.flatnonzero(part == j)
        near = (np.round(v[x] @ v[y].T, 9) >= least) & (k[x][:, None] != k[y][None, :])
        r, c = np.nonzero(near)
        a, b = k[x[r]], k[y[c]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    kind = vectors.schema[key].dataType.simpleString()
    return placed.groupBy("blk", "i", "j").applyInArrow(links, f"a {kind}, b {kind}").distinct()


def vector_clusters(vectors: DataFrame, least: float = 0.78, key: str = "vec_id", vector: str = "embedding", block: str = "label") -> DataFrame:
    """``(node, label)``: single-linkage groups of vectors of one block at a cosine similarity."""
    return pair_groups(vector_links(vectors, least, key, vector, block))
