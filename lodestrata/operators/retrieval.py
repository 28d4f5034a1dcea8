"""Lexical and vector retrieval, fusion and ranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scoring import cosine, min_max, time_score
from lodestrata.functions.text import analyze, character_pairs, jaccard, term_position, word_match
from lodestrata.session import Workspace

K1, B = 1.2, 0.75


def query_terms(spark, text: str) -> list[str]:
    """The distinct index terms of a query, in order."""
    return list(dict.fromkeys(spark.range(1).select(analyze(F.lit(text)).alias("t")).first()["t"]))


_HAN = "[\\u4e00-\\u9fff]"
#: What :func:`lodestrata.functions.text.analyze` makes of a text, as one pattern: words, pairs, signs that stand alone.
_TERM = f"[a-z0-9]+|{_HAN}(?={_HAN})|(?<!{_HAN}){_HAN}(?!{_HAN})"


def _term_counts(documents: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """``key, dl, c0, c1, ...``: length in index terms and count of each query term, by patterns instead of term arrays."""
    words = [t for t in terms if t.isascii()]
    low = documents.select(F.col(key), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    some = f"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])" if words else "(?!)"
    found = low.select(key, "low", F.regexp_count("low", F.lit(_TERM)).alias("dl"), F.regexp_extract_all("low", F.lit(some), 0).alias("m"))

    def count(term: str):
        if term.isascii():
            return F.size(F.filter("m", _equals(term)))
        alone = f"(?<!{_HAN}){term}(?!{_HAN})" if len(term) == 1 else f"(?={term})"
        return F.when(F.col("low").contains(term), F.regexp_count("low", F.lit(alone))).otherwise(0)

    return found.select(key, "dl", *[count(t).alias(f"c{i}") for i, t in enumerate(terms)])


def _equals(term: str):
    return lambda x: x == term


def bm25(documents: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", least_match: float = 0.0) -> DataFrame:
    """``key, matched, score`` of the documents with at least one query term.

    One scan of the texts without a shuffle counts the terms within each document;
    corpus statistics, one row whose width is the number of query terms, and scores
    come from the written counts.  ``least_match`` is the
    share of the terms that have to occur (rounded down, at least one).  Documents
    with null or empty text count for the statistics and never match.
    """
    counted = Workspace(documents.sparkSession, "bm25").save(_term_counts(documents, terms, key, text), "counts")
    counts = [F.col(f"c{i}") for i in range(len(terms))]
    sums = [F.sum((c > 0).cast("long")).alias(f"df{i}") for i, c in enumerate(counts)]
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("len"), *sums).first()
    n, average = stats["n"], (stats["len"] or 0) / max(1, stats["n"])
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(float(average or 1)))
    parts = []
    for i, c in enumerate(counts):
        df = stats[f"df{i}"] or 0
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        parts.append(F.lit(idf) * c * (K1 + 1) / (c + norm))
    matched = sum(((c > 0).cast("int") for c in counts), F.lit(0))
    least = max(1, math.floor(least_match * len(terms)))
    score = sum(parts, F.lit(0.0))
    return counted.select(key, matched.alias("matched"), F.round(score, 6).alias("score")).where(F.col("matched") >= least)


def phrase_hits(documents: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n``: how often the terms follow each other within each document."""
    tokens = documents.select(F.col(key), F.concat(F.lit(" "), F.array_join(analyze(F.col(text)), " "), F.lit(" ")).alias("t"))
    rest = " ".join(terms[1:])
    pattern = f" {terms[0]}(?= {rest} )" if rest else f" {terms[0]}(?= )"  # terms are words of letters and digits
    return tokens.select(key, F.regexp_count("t", F.lit(pattern)).alias("n")).where("n > 0")


def top_k(rows: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best rows by score, ties by id, as a take-ordered without a full sort."""
    return rows.orderBy(F.desc(score), tie).limit(k)


def rank_rows(rows: DataFrame, k: int, score: str = "score", tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The ``k`` best rows with their rank from 1; ``k`` rows are what one task has to order."""
    best = top_k(rows, k, score, tie)
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), tie)))


def normalize_by(rows: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Scores scaled to 0..1 within each group (0.5 where all are equal), through one small aggregate per group."""
    bounds = rows.groupBy(group).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return rows.join(bounds, group).withColumn("normalized", min_max(F.col(score), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def vector_search(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding", least: float | None = None) -> DataFrame:
    """``key, similarity, score`` of all vectors against one query vector, exact.

    ``score`` is ``1 / (1 + cosine distance)``.  Null vectors and vectors of length 0 are
    left out, as are those below ``least``.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select(key, cosine(F.col(vector), q).alias("s")).where("s is not null")
    rows = rows if least is None else rows.where(F.round("s", 6) >= least)
    return rows.select(key, F.round("s", 6).alias("similarity"), F.round(1 / (1 + (1 - F.col("s"))), 6).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None, key: str = "vec_id", vector: str = "embedding", rows_per_block: int = 20_000, queries_per_block: int = 1_000) -> DataFrame:
    """``query_id, vec_id, similarity, score``: for each query the ``k`` best rows, or all rows from ``least`` on, exact.

    Rows and queries are cut into blocks; each pair of blocks is one matrix product, of
    which only the best ``k`` per query, or the rows from ``least`` on, leave the task.
    ``score`` is ``1 / (1 + cosine distance)``; ties go by id.  Null vectors and vectors
    of length 0 are left out, on both sides.
    """
    slim = lambda d: d.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows, wanted = slim(vectors), slim(queries)
    parts, blocks = max(1, -(-rows.count() // rows_per_block)), max(1, -(-wanted.count() // queries_per_block))
    cut = lambda d, n, name: d.withColumn(name, F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cut(rows, parts, "i").select("k", "v", "i", spread(blocks).alias("j"), F.lit(False).alias("q"))
    right = cut(wanted, blocks, "j").select("k", "v", spread(parts).alias("i"), "j", F.lit(True).alias("q"))

    def product(table: pa.Table) -> pa.Table:
        keys, asks = table["k"].to_numpy(), table["q"].to_numpy()
        v = np.stack(table["v"].to_pandas().to_numpy()) if len(keys) else np.zeros((0, 1))
        norm = np.sqrt((v * v).sum(1))
        x, y = np.flatnonzero(asks & (norm > 0)), np.flatnonzero(~asks & (norm > 0))
        s = (v[x] / norm[x, None]) @ (v[y] / norm[y, None]).T
        shown = np.round(s, 6)
        score = np.round(1 / (1 + (1 - s)), 6)
        if k is None:
            r, c = np.nonzero(shown >= least)
        else:
            order = np.lexsort((np.broadcast_to(keys[y], s.shape), -score), axis=1)[:, :k]
            r, c = np.repeat(np.arange(len(x)), order.shape[1]), order.ravel()
        return pa.table({"query_id": pa.array(keys[x[r]]), "vec_id": pa.array(keys[y[c]]), "similarity": pa.array(shown[r, c]), "score": pa.array(score[r, c])})

    kind = vectors.schema[key].dataType.simpleString()
    found = left.unionByName(right).groupBy("i", "j").applyInArrow(product, f"query_id {kind}, vec_id {kind}, similarity double, score double")
    if k is None:
        return found
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def reciprocal_ranks(channels: dict[str, tuple[DataFrame, float]], k: int, key: str = "doc_id") -> DataFrame:
    """Fusion of ranked channels: ``sum(weight / (k + rank))``; a missing channel adds nothing.

    Channels have ``key, rank``; they are united and summed, so that one shuffle of the
    channels' rows replaces a chain of outer joins.
    """
    parts = [rows.select(key, (F.lit(float(w)) / (k + F.col("rank"))).alias("p"), F.lit(name).alias("channel")) for name, (rows, w) in channels.items()]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.groupBy(key).agg(F.round(F.sum("p"), 6).alias("rrf"), F.count(F.lit(1)).cast("int").alias("channels"))


def rrf_constant(channels: int, base: int = 60) -> int:
    """The rank constant for a number of active channels, of which the lexical one always counts."""
    return base * max(1, channels) // 3 if channels else base


def recall_limit(limit: int) -> int:
    return min(max(5 * limit, 100), 200)


def position_score(text, terms: list[str]):
    """Mean of ``1 / (1 + position / 100)`` over the terms, less for long texts; 0.5 without text."""
    used = [t for t in terms if len(t) >= 2]
    if not used:
        return F.lit(1.0)
    each = [F.when(term_position(text, t) >= 0, 1 / (1 + term_position(text, t) / 100)).otherwise(0.0) for t in used]
    mean = sum(each, F.lit(0.0)) / len(used)
    damped = F.when(F.length(text) > 500, mean / (1 + 0.1 * F.log2(F.length(text) / 500.0))).otherwise(mean)
    return F.round(F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.5).otherwise(damped), 6)


def boost(rows: DataFrame, time: str, text: str, terms: list[str], as_of: str, time_weight: float = 0.25, position_weight: float = 0.12, score: str = "rrf") -> DataFrame:
    """Fused scores raised by recency and by the position of the terms."""
    t = 1 + time_weight * time_score(F.col(time), as_of)
    p = 1 + position_weight * position_score(F.col(text), terms)
    return rows.withColumn("boosted", F.round(F.col(score) * t * p, 6))


def entity_context_boost(text, strengths: dict[str, float]):
    """Summed strength of the mentioned entities, at most 1."""
    hits = [F.when(word_match(text, name), F.lit(float(s))).otherwise(0.0) for name, s in strengths.items()]
    return F.least(sum(hits, F.lit(0.0)), F.lit(1.0))


#: Fixed value: scores of the reranker up to this say nothing.
RERANK_LEAST = 0.01


def final_score(rows: DataFrame, weights: tuple[float, ...], without: tuple[float, ...], columns=("rerank", "rrf", "entity", "recency", "type_priority")) -> DataFrame:
    """``final``: the weighted sum of the signals, rounded to six digits.

    The fused score and the reranker's are scaled to 0..1 over all rows (0.5 where all
    fused scores are equal; where all of the reranker's are, the scaled fused score
    stands in).  Rows that the reranker said nothing about, by a null or a score of at
    most ``RERANK_LEAST``, take the weights ``without`` it.  Other null signals count
    0.  The bounds are one row, read by the driver.
    """
    rerank, fused, *others = (F.coalesce(F.col(c), F.lit(0.0)).cast("double") for c in columns)
    bounds = rows.agg(F.min(fused).alias("f0"), F.max(fused).alias("f1"), F.min(rerank).alias("r0"), F.max(rerank).alias("r1")).first()
    f0, f1, r0, r1 = (float(x or 0.0) for x in bounds)
    scaled = (fused - f0) / (f1 - f0) if f1 - f0 > 1e-6 else F.lit(0.5)
    said = rerank > RERANK_LEAST
    reranked = (rerank - r0) / (r1 - r0) if r1 - r0 > 1e-6 else scaled
    signals = [F.when(said, reranked).otherwise(0.0), scaled, *others]
    total = lambda w: sum((x * s for x, s in zip(w, signals)), F.lit(0.0))
    return rows.withColumn("final", F.round(F.when(said, total(weights)).otherwise(total(without)), 6))


def keyword_demotion(rows: DataFrame, text: str, terms: list[str], score: str = "score") -> DataFrame:
    """With three or more keywords, scores fall by half of the uncovered share."""
    if len(terms) < 3:
        return rows.withColumn("demoted", F.col(score))
    covered = sum((word_match(F.col(text), t).cast("int") for t in terms), F.lit(0)) / len(terms)
    return rows.withColumn("demoted", F.round(F.col(score) * (1 - (1 - F.coalesce(covered, F.lit(0.0))) * 0.5), 6))


def keep_floor(ranked: DataFrame, predicate, limit: int, rank: str = "rank") -> DataFrame:
    """Rows that satisfy the predicate, and the first ``max(3, limit // 4)`` in any case."""
    return ranked.where((F.col(rank) <= max(3, limit // 4)) | F.coalesce(predicate, F.lit(False)))


def top_per_group(rows: DataFrame, group: str, k: int, score: str, tie: str) -> DataFrame:
    """The ``k`` best rows of each group; the window's group limit prunes before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def diversify(ranked: DataFrame, kind: str, rank: str = "rank", head: int = 5, share: float = 0.8, slot: int = 3) -> DataFrame:
    """If one kind has more than ``share`` of the first rows, the best row of another kind moves to ``slot``.

    Works on a ranked list of bounded length (a result page).
    """
    everything = Window.partitionBy(F.lit(0))
    top = F.col(rank) <= head
    per_kind = F.sum(top.cast("int")).over(Window.partitionBy(kind))
    rows = ranked.withColumn("_n", per_kind).withColumn("_most", F.max("_n").over(everything)).withColumn("_head", F.sum(top.cast("int")).over(everything))
    dominated = F.col("_most") > share * F.col("_head")
    other = F.when((F.col("_n") < F.col("_most")) & (F.col(rank) > slot), F.col(rank))
    rows = rows.withColumn("_pick", F.when(dominated, F.min(other).over(everything)))
    moved = F.when(F.col(rank) == F.col("_pick"), F.lit(slot)).when((F.col(rank) >= slot) & (F.col(rank) < F.col("_pick")), F.col(rank) + 1).otherwise(F.col(rank))
    return rows.withColumn("position", moved.cast("int")).drop("_n", "_most", "_head", "_pick")


def same_title(a, b, least: float = 0.5):
    return jaccard(character_pairs(a), character_pairs(b)) >= least
