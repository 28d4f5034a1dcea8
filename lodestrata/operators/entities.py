"""Dictionary matching of entities in texts, and their scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import analyze

#: Prior by entity type, and the types whose frequency in the corpus counts.
TYPE_PRIOR = {
    "person": 0.90, "event": 0.85, "policy": 0.80, "company": 0.80, "index": 0.75, "commodity": 0.70, "indicator": 0.70, "central_bank": 0.65, "regulation": 0.65,
    "institution": 0.60, "concept": 0.50, "product": 0.50, "sector": 0.45, "currency": 0.35, "industry_rule": 0.25, "region": 0.10,
}
OTHER_PRIOR = 0.50
GENERIC_TYPES = ["region", "currency", "sector", "concept", "industry_rule"]
#: Signs that may stand before a short Chinese term without being part of a longer word.
BOUNDARY = "兑对与和及或在从向将以为被把由于至经给让受较比超约近逾满报跌涨升降买卖收付发的且并而但是有不未已等其该此之亦均仅"
_CJK = "\\u4e00-\\u9fff\\u3400-\\u4dbf"


def dictionary_terms(entities: DataFrame, name: str = "name", kind: str = "node_type", aliases: str = "aliases") -> DataFrame:
    """``(entity, kind, term)``: names and aliases of at least two characters, in lower case."""
    terms = F.array_distinct(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))))
    rows = entities.where(F.col(name).isNotNull()).select(F.col(name).alias("entity"), F.col(kind).alias("kind"), F.explode(terms).alias("term"))
    plain = F.lower(F.trim(F.regexp_replace("term", r"\s+", " ")))
    return rows.select("entity", "kind", plain.alias("term")).where(F.length("term") >= 2).distinct()


def term_pattern(term):
    """Regular expression of a term column: word borders for ASCII, a left border for short Chinese terms."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    ascii_ = term.rlike(r"^[\x00-\x7f]+$")
    short = (F.length(term) <= 2) & term.rlike(f"^[{_CJK}]")
    left = F.when(ascii_, r"(?<![a-z0-9])").when(short, f"(?<![{_CJK}&&[^{BOUNDARY}]])").otherwise("")
    return F.concat(left, quoted, F.when(ascii_, r"(?![a-z0-9])").otherwise(""))


def match_entities(documents: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """``key, entity, kind, term, occurrences, position``: dictionary terms found in texts.

    A join on index terms replaces an automaton in memory: a dictionary term is kept
    under its rarest index term, documents under all of theirs, and only documents
    that share it are searched.  Neither side has to fit into memory.  Of one entity's
    terms at a place only the longest counts, as the others lie within it.
    """
    split = terms.select("entity", "kind", "term", F.array_distinct(analyze(F.col("term"))).alias("t")).where(F.size("t") > 0)
    frequency = split.select(F.explode("t").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("f"))
    keyed = split.select("entity", "kind", "term", F.explode("t").alias("x")).join(frequency, "x")
    rare = keyed.groupBy("entity", "kind", "term").agg(F.min(F.struct("f", "x"))["x"].alias("x"))
    low = F.lower(F.regexp_replace(text, r"\s+", " "))
    docs = documents.select(F.col(key), low.alias("_low")).where("_low <> ''")
    postings = docs.select(key, F.explode(F.array_distinct(analyze(F.col("_low")))).alias("x"))
    candidates = postings.join(rare, "x").select(key, "entity", "kind", "term").distinct()
    checked = candidates.join(docs, key).withColumn("_p", term_pattern(F.col("term")))
    n = F.regexp_count("_low", F.col("_p"))
    first = F.length(F.call_function("regexp_extract", F.col("_low"), F.concat(F.lit("(?s)^(.*?)"), F.col("_p")), F.lit(1)))
    found = checked.select(key, "entity", "kind", "term", n.alias("occurrences"), first.alias("position")).where("occurrences > 0")
    longest = Window.partitionBy(key, "entity", "kind", "position").orderBy(F.desc(F.length("term")), "term")
    return found.withColumn("_r", F.row_number().over(longest)).where("_r = 1").drop("_r")


def entity_occurrences(matches: DataFrame, key: str) -> DataFrame:
    """Per document and entity: all occurrences and the first position."""
    return matches.groupBy(key, "entity", "kind").agg(F.sum("occurrences").cast("long").alias("occurrences"), F.min("position").alias("first_position"))


def inverse_frequencies(occurrences: DataFrame, documents: DataFrame, key: str, kinds: list[str] | None = GENERIC_TYPES) -> DataFrame:
    """``(entity, df, idf)`` of generic types, or of all with None: ``ln((N + 1) / (1 + df)) / ln(N + 1)``."""
    n = documents.count()
    df = (occurrences if kinds is None else occurrences.where(F.col("kind").isin(*kinds))).groupBy("entity").agg(F.countDistinct(key).alias("df"))
    return df.withColumn("idf", F.round(F.log((n + 1) / (1 + F.col("df"))) / F.log(F.lit(float(n + 1))), 6) if n else F.lit(1.0))


def score_entities(occurrences: DataFrame, lengths: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Score of each entity of a document: prior times the mean of frequency, rarity, position and density.

    ``lengths`` is ``key, length[, title]``: characters of the text, and the title, in
    which an entity counts as placed first.
    """
    rows = occurrences.join(lengths, key).join(idf.select("entity", "idf"), "entity", "left")
    most = rows.groupBy(key).agg(F.max("occurrences").alias("_most"))
    rows = rows.join(most, key)
    prior = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_PRIOR.items() for x in kv])[F.col("kind")], F.lit(OTHER_PRIOR))
    tf = F.log(1 + F.col("occurrences")) / F.log(1 + F.col("_most"))
    share = F.col("first_position") / F.greatest("length", F.lit(1))
    place = F.when(share <= 0.10, 0.8).when(share <= 0.25, 0.6).otherwise(0.3)
    if "title" in lengths.columns:
        place = F.when(F.lower("title").contains(F.lower("entity")), 1.0).otherwise(place)
    density = F.least(F.lit(1.0), 1000 * F.col("occurrences") / F.greatest("length", F.lit(1)))
    score = prior * 0.25 * (tf + F.coalesce("idf", F.lit(1.0)) + place + density)
    return rows.select(key, "entity", "kind", F.round(score, 6).alias("score"))


def cut_at_gap(scored: DataFrame, key: str, ratio: float = 0.40, most: int = 5) -> DataFrame:
    """The best entities up to the first that falls below ``ratio`` of the one before, at most ``most``."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "entity")
    rows = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    drop = F.coalesce(F.col("score") < ratio * F.lag("score").over(w), F.lit(False))
    rows = rows.withColumn("_gap", drop.cast("int"))
    return rows.withColumn("_cut", F.max("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_gap", "_cut")


def resolve_names(nodes: DataFrame, tokens: list[str], limit: int = 50) -> DataFrame:
    """Nodes that a query's tokens name, with the best score of the ways in which they do."""
    if not tokens:
        return nodes.limit(0).select("id", "name", "node_type", F.lit(0.0).alias("score"))
    name, ticker = F.lower(F.trim("name")), F.lower(F.trim("ticker"))
    alias = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))

    def one(token: str):
        t = token.lower()
        parts = F.exists(alias, lambda a: a.contains(t))
        prefix = (F.lit(len(t) >= 3)) & name.startswith(t)
        return F.when(ticker == t, 1.2).when(name == t, 1.0).when(F.array_contains(alias, t), 0.95).when(prefix, 0.8).when(parts, 0.7).when(name.contains(t), 0.5)

    scores = [F.coalesce(one(t), F.lit(0.0)) for t in tokens[:5]]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return nodes.select("id", "name", "node_type", best.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def snippet(text: str | None, terms: list[str], size: int = 150) -> str:
    """The sentences with most hits, joined up to ``size`` characters; for the rows of a result page."""
    parts = [p.strip() for p in re.split(r"(?<=[。！？\n])", text or "") if p.strip()]
    hits = lambda p: sum(p.lower().count(t.lower()) for t in terms)
    out = ""
    for _, i in sorted((-(hits(p) + 0.5 * hits(p) / len(p)), i) for i, p in enumerate(parts)):
        if out and len(out) + len(parts[i]) > size:
            break
        out += parts[i]
    return out if len(out) <= size else out[:size] + "..."
