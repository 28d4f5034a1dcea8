"""Hybrid search: the query is planned on the driver, everything else is one lazy plan."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scoring import time_score
from lodestrata.functions.text import NEGATIONS, TICKER, character_pairs, jaccard, word_match
from lodestrata.operators import entities, retrieval
from lodestrata.plans import lexicon as lx
from lodestrata.session import Workspace


@dataclass(frozen=True)
class SearchPlan:
    text: str
    terms: list[str]
    intent: str
    confidence: float
    weights: dict[str, float]
    days: int | None
    tables: tuple[str, ...]
    mode: str
    limit: int
    expanded: list[str] = field(default_factory=list)


def signal_sum(text: str, signals: dict[str, float]) -> float:
    """Weights of the affirmed words in falling order, each counting half of the one before."""
    hits = []
    for word, weight in signals.items():
        at = text.find(word)
        if at >= 0 and not text[max(0, at - 2) : at].endswith(tuple(NEGATIONS)):
            hits.append(weight)
    return sum(w * 0.5**i for i, w in enumerate(sorted(hits, reverse=True)))


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[一-鿿]+|[a-zA-Z0-9]+", text)


def intent_of(text: str, words: lx.Lexicon, domains: dict[str, float], has_ticker: bool) -> tuple[str, float]:
    """Intent and confidence; a ticker, or a short text without any signal, looks for an entity."""
    if has_ticker:
        return "entity_lookup", 0.95
    scores = {k: 0.40 * min(1.0, signal_sum(text, s)) for k, s in words.intents.items()}
    affinity = {"financial_report": "analysis", "macro": "analysis", "market_event": "news", "strategy_domain": "strategy", "supply_chain": "analysis", "knowledge_graph": "concept"}
    for domain, value in domains.items():
        if domain in affinity:
            scores[affinity[domain]] += 0.20 * min(1.0, value)
    if re.search(r"[？?]|什么|如何|为什么", text):
        scores["analysis"] += 0.10
    best = max(scores, key=lambda k: (scores[k], k))
    if scores[best] > 0.2:
        return best, min(1.0, round(scores[best] / 0.6, 4))
    return ("entity_lookup", 0.5) if len(text) <= 4 else ("general", 0.3)


def channel_weights(text: str, intent: str, confidence: float, domains: dict[str, float], has_ticker: bool, timely: bool) -> dict[str, float]:
    """Base weights changed by intent, up to three domains and profiles, clamped and rescaled to the base sum."""
    w = {c: lx.BASE[c] * (1 + confidence * (m - 1)) for c, m in zip(lx.CHANNELS, lx.INTENT_FACTORS[intent])}
    strongest = sorted(domains.items(), key=lambda d: (-d[1], d[0]))[:3]
    factors: dict[str, float] = {}
    for domain, value in strongest:
        for channel, m in lx.DOMAIN_FACTORS.get(domain, {}).items():
            factors[channel] = max(factors.get(channel, 0.0), 1 + min(1.0, value) * (m - 1))
    for channel, m in factors.items():
        w[channel] *= m
    profile: dict[str, float] = {}
    for name, active in (("short", len(text) <= 4), ("long", len(text) >= 20), ("time", timely)):
        if active:
            profile = lx.PROFILES[name] | profile
    if has_ticker:
        profile = profile | lx.PROFILES["ticker"]
    for channel, m in profile.items():
        w[channel] *= m
    w = {c: min(max(v, 0.5 * lx.BASE[c]), 3 * lx.BASE[c]) for c, v in w.items()}
    scale = sum(lx.BASE.values()) / sum(w.values())
    return {c: round(v * scale, 6) for c, v in w.items()}


def route(intent: str, only: tuple[str, ...] | None) -> tuple[str, ...]:
    """Tables a query goes to."""
    return tuple(only) if only else {"news": ("raw_information",), "market_data": ("raw_information",), "concept": ("nodes", "raw_information")}.get(intent, ("raw_information", "nodes"))


def plan_query(spark, text: str, mode: str = "hybrid", limit: int = 20, weights: dict[str, float] | None = None, only: tuple[str, ...] | None = None, words: lx.Lexicon | None = None) -> SearchPlan:
    """Read a query: terms, time, domains, intent, weights and tables.  Given weights replace the computed ones."""
    words = words or lx.Lexicon()
    text = " ".join(text.split())
    days, temporal = next(((d, [w for w in group if w in text]) for group, d in words.time_bias if any(w in text for w in group)), (None, []))
    bare = text
    for word in temporal:
        bare = bare.replace(word, " ")
    parts = [t for t in tokens_of(bare) if t.lower() not in words.stopwords] or tokens_of(bare)
    has_ticker = any(re.fullmatch(TICKER, t) for t in text.split())
    domains = {k: s for k, v in words.domains.items() if (s := signal_sum(text, v)) > 0}
    intent, confidence = intent_of(text, words, domains, has_ticker)
    chosen = weights or channel_weights(text, intent, confidence, domains, has_ticker, days is not None and days <= 30)
    known = {t.lower() for t in parts}
    expanded = [s for t in parts for s in words.synonyms.get(t, []) if s.lower() not in known]
    terms = retrieval.query_terms(spark, " ".join(parts))
    return SearchPlan(text, terms, intent, confidence, chosen, days if len(text) < 100 else None, route(intent, only), mode, limit, sorted(set(expanded)))


def hashed_vector(text: str, size: int = 256) -> list[float]:
    """A deterministic vector of a short text: counts of hashed character pairs, for use without a model."""
    low = text.lower()
    counts = [0.0] * size
    for pair in {low[i : i + 2] for i in range(max(1, len(low) - 1))}:
        counts[zlib.crc32(pair.encode()) % size] += 1
    return counts


def hashed_similarity(c: Column, query: list[float]) -> Column:
    """Cosine of a text's distinct hashed character pairs with a query vector, in one pass over the pairs."""
    slots = F.array(*[F.lit(x) for x in query])
    pairs = character_pairs(F.lower(F.coalesce(c, F.lit(""))))
    hit = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.element_at(slots, (F.pmod(F.crc32(F.encode(p, "UTF-8")), F.lit(len(query))) + 1).cast("int")))
    norm = sum(x * x for x in query) ** 0.5
    return hit / (F.sqrt(F.greatest(F.size(pairs), F.lit(1))) * F.lit(norm or 1.0))


def region_of(text: str) -> str:
    return "cn" if re.search(r"[一-鿿]", text) else "other"


Rule = Callable[[DataFrame, SearchPlan], DataFrame]


def drop_empty(rows: DataFrame, plan: SearchPlan) -> DataFrame:
    """Rows without title and text are dropped."""
    return rows.where(F.length(F.trim(F.concat_ws("", "title", "body"))) > 0)


def least_score(rows: DataFrame, plan: SearchPlan) -> DataFrame:
    return retrieval.keep_floor(rows, F.col("final") >= 0.05, plan.limit)


def drop_same_titles(rows: DataFrame, plan: SearchPlan) -> DataFrame:
    """Of rows with nearly the same title the better ranked stays; works on the bounded candidate list."""
    a = rows.select(F.col("id").alias("ia"), F.col("rank").alias("ra"), F.lit(1).alias("one"), character_pairs(F.lower(F.coalesce("title", F.lit("")))).alias("ga"))
    b = a.toDF("ib", "rb", "one", "gb")
    beaten = a.join(b, "one").where((F.col("ra") > F.col("rb")) & (jaccard(F.col("ga"), F.col("gb")) >= 0.5)).select(F.col("ia").alias("id"))
    return rows.join(beaten, "id", "left_anti")


#: Candidates that a reranker gets.
SCORED = 50
#: Rules of the last step in order; more can be given to :func:`search`.
RULES: tuple[Rule, ...] = (drop_empty, least_score, drop_same_titles)


def search(records: DataFrame, nodes: DataFrame, plan: SearchPlan, as_of: str, rules: tuple[Rule, ...] = RULES, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rank, table, id, title, rrf, final`` of the best results.

    Filters come before scoring.  Each channel gives at most ``recall_limit`` rows, so
    that fusion, ranking and rules work on a bounded list; only the scans of the
    channels see all rows.  ``scorer`` adds a column ``rerank`` to the first 50.
    """
    k = retrieval.recall_limit(plan.limit)
    texts = []
    if "raw_information" in plan.tables:
        r = records.select(F.lit("raw_information").alias("table"), "id", "title", "body", F.col("published_at").alias("at"), F.coalesce("importance_score", F.lit(0.0)).alias("importance"))
        texts.append(r.where(F.col("at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {plan.days} DAYS")) if plan.days else r)
    if "nodes" in plan.tables:
        texts.append(nodes.where("is_active").select(F.lit("nodes").alias("table"), "id", F.col("name").alias("title"), F.col("description").alias("body"), F.col("updated_at").alias("at"), F.lit(0.0).alias("importance")))
    rows = texts[0] if len(texts) == 1 else texts[0].unionByName(texts[1])
    body = F.concat_ws(" ", "title", "title", "body")  # the title counts twice
    channels = {}
    if plan.mode != "embedding":
        scored = retrieval.bm25(rows.withColumn("_text", body), plan.terms, "id", "_text", 0.3 if len(plan.text) >= 100 else 0.7)
        channels["bm25"] = (retrieval.rank_rows(scored, k, tie="id"), plan.weights["bm25"])
    if plan.mode != "bm25":
        near = rows.select("id", F.round(hashed_similarity(body, hashed_vector(plan.text)), 6).alias("score")).where("score >= 0.1")
        channels["vector"] = (retrieval.rank_rows(near, k, tie="id"), plan.weights["vector"])
    if "nodes" in plan.tables:
        named = entities.resolve_names(nodes.where("is_active"), tokens_of(plan.text), 10).select("id", "score")
        channels["name"] = (retrieval.rank_rows(named, 10, tie="id"), plan.weights["name"])
    # the lexical channel counts for the constant even if it is off
    constant = retrieval.rrf_constant(len({"bm25", *channels}))
    fused = retrieval.reciprocal_ranks(channels, constant, "id")
    near = channels["vector"][0].select("id", F.lit(True).alias("_near")) if "vector" in channels else fused.limit(0).select("id", F.lit(True).alias("_near"))
    fused = fused.join(F.broadcast(near), "id", "left")  # at most the recall limit
    joined = rows.join(F.broadcast(fused), "id")  # at most three times the recall limit
    # importance counts for what the vector channel found, before recency and position raise the score
    importance = F.when(F.col("_near"), F.least(F.greatest("importance", F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    joined = joined.withColumn("rrf", F.col("rrf") + plan.weights["structural"] * importance / (constant + 1))
    boosted = retrieval.boost(joined, "at", "body", plan.terms, as_of, plan.weights["time"], plan.weights["position"])
    entity = sum((F.when(word_match(F.coalesce("title", F.lit("")), t), 0.15).otherwise(0.0) for t in plan.terms), F.lit(0.0))
    record, node = lx.PRIORITY[plan.intent]
    signals = boosted.select(
        "table", "id", "title", "body", F.col("boosted").alias("rrf"), F.least(entity, F.lit(1.0)).alias("entity"), time_score(F.col("at"), as_of).alias("recency"),
        F.when(F.col("table") == "nodes", node).otherwise(record).alias("type_priority"), F.lit(None).cast("double").alias("rerank"),
    )
    signals = Workspace(records.sparkSession, "candidates").save(signals, "signals")  # at most three times the recall limit
    if scorer and plan.mode != "bm25":
        head = retrieval.rank_rows(signals, SCORED, "rrf", "id").drop("rank")
        tail = signals.join(F.broadcast(head.select("id")), "id", "left_anti")
        signals = scorer(head).select(*signals.columns).unionByName(tail)
    ranked = retrieval.rank_rows(retrieval.final_score(signals, *lx.FINAL[plan.intent]), 3 * k, "final", "id")
    for rule in rules:
        ranked = rule(ranked, plan)
    best = retrieval.rank_rows(ranked.drop("rank"), plan.limit, "final", "id")
    return best.select("rank", "table", "id", "title", F.round("rrf", 6).alias("rrf"), "final")
