"""Queries of the knowledge-base operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring as sc
from lodestrata.functions import text as tx
from lodestrata.operators import audit, dedup, entities, graph, index, retrieval, temporal
from lodestrata.operators.hierarchy import normal_type
from lodestrata.plans import search as search_plans
from lodestrata.session import Workspace
from lodestrata.sources.tables import table

AS_OF = "2018-01-15 00:00:00"
QUERY = "copper freight contracts margin 存款"

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_TOKENS = r"""
toks AS (SELECT doc_id, list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'),
           flatten([[substr(r, i, 2) for i in generate_series(1, greatest(length(r) - 1, 1))] for r in regexp_extract_all(lower(coalesce(text, '')), '[\x{4e00}-\x{9fff}]+')])) AS t
         FROM documents),
q AS (SELECT unnest(['copper', 'freight', 'contracts', 'margin', '存款']) AS term),
st AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM toks),
post AS (SELECT doc_id, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf, len(t) AS dl FROM toks, q),
dfs AS (SELECT term, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) AS df FROM post GROUP BY term),
bm AS (SELECT doc_id, CAST(sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) AS INT) AS matched,
              round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM post JOIN dfs USING (term), st GROUP BY doc_id)
"""


def _bm(spark, folder, least=0.0):
    return retrieval.bm25(table(spark, folder, "documents"), retrieval.query_terms(spark, QUERY), least_match=least)


@query(f"WITH {_TOKENS} SELECT doc_id, score FROM bm WHERE matched >= 1 ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, folder):
    return retrieval.top_k(_bm(spark, folder).select("doc_id", "score"), 20)


@query(f"WITH {_TOKENS} SELECT doc_id, score FROM bm WHERE matched >= 1 ORDER BY score DESC, doc_id LIMIT 20")
def bm25_index_topk(spark, folder):
    """The same through a stored index, which is built here from all documents in two batches."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stored = index.TextIndex(spark, Workspace(spark, "index").path("bm25"), "doc_id", buckets=8)
    for batch in (0, 1):
        stored.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == batch), "text", batch)
    return retrieval.top_k(stored.bm25(retrieval.query_terms(spark, QUERY)).select("doc_id", "score"), 20)


@query(f"WITH {_TOKENS} SELECT doc_id, matched, score FROM bm WHERE matched >= 3")
def bm25_min_should_match(spark, folder):
    return _bm(spark, folder, 0.7)


@query(f"""WITH {_TOKENS}, hits AS (SELECT bm.doc_id, doc_kind, score FROM bm JOIN documents USING (doc_id) WHERE matched >= 1)
SELECT doc_id, doc_kind, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-8 THEN 0.5 ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) END AS normalized
FROM hits WINDOW w AS (PARTITION BY doc_kind)""")
def bm25_minmax_norm(spark, folder):
    kinds = table(spark, folder, "documents").select("doc_id", "doc_kind")
    return retrieval.normalize_by(_bm(spark, folder).join(kinds, "doc_id").where("doc_kind is not null"), "doc_kind").select("doc_id", "doc_kind", "normalized")


@query(f"""WITH {_TOKENS} SELECT doc_id, len(list_filter(generate_series(1, len(t) - 1), lambda i: t[i] = 'freight' AND t[i + 1] = 'contracts')) AS n
FROM toks WHERE n > 0""")
def bm25_phrase(spark, folder):
    return retrieval.phrase_hits(table(spark, folder, "documents"), ["freight", "contracts"]).select("doc_id", F.col("n").cast("long").alias("n"))


def _vector(spark, folder, least=None):
    v = table(spark, folder, "embeddings")
    q = v.orderBy("vec_id").select("embedding").first()[0]
    return retrieval.vector_search(v, list(q), least=least)


_VEC = """q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings ORDER BY vec_id LIMIT 1),
vec AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q.e) AS s FROM embeddings, q WHERE embedding IS NOT NULL)"""


_NEAR = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
near AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS s FROM v q, v WHERE q.vec_id % 100 = 0)"""


@query(f"""WITH {_NEAR} SELECT query_id, vec_id, round(s, 6) AS similarity, round(1 / (1 + (1 - s)), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + (1 - s)), 6) DESC, vec_id) AS INT) AS rank
FROM near QUALIFY rank <= 20""")
def vector_topk(spark, folder):
    """The 20 nearest rows of every row whose id is divisible by 100."""
    v = table(spark, folder, "embeddings")
    return retrieval.nearest(v, v.where("vec_id % 100 = 0"), k=20)


@query(f"WITH {_NEAR} SELECT query_id, vec_id, round(s, 6) AS similarity FROM near WHERE round(s, 6) >= 0.3")
def vector_threshold(spark, folder):
    v = table(spark, folder, "embeddings")
    return retrieval.nearest(v, v.where("vec_id % 100 = 0"), least=0.3).select("query_id", "vec_id", "similarity")


_CHANNELS = f"""{_TOKENS}, {_VEC.replace('q AS', 'qv AS').replace('q.e', 'qv.e').replace(', q WHERE', ', qv WHERE')},
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE matched >= 1 QUALIFY rank <= 200),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(1 / (1 + (1 - s)), 6) DESC, vec_id) AS rank FROM vec QUALIFY rank <= 200),
fused AS (SELECT doc_id, round(sum(p), 6) AS rrf, CAST(count(*) AS INT) AS channels
          FROM (SELECT doc_id, 1.2 / (40 + rank) AS p FROM a UNION ALL SELECT doc_id, 1.0 / (40 + rank) FROM b) GROUP BY doc_id)"""


def _fused(spark, folder):
    lexical = retrieval.rank_rows(_bm(spark, folder), 200)
    vector = retrieval.rank_rows(_vector(spark, folder).withColumnRenamed("vec_id", "doc_id"), 200)
    return retrieval.reciprocal_ranks({"lexical": (lexical, 1.2), "vector": (vector, 1.0)}, retrieval.rrf_constant(2))


@query(f"WITH {_CHANNELS} SELECT * FROM fused")
def rrf_fusion(spark, folder):
    return _fused(spark, folder)


_AGE = "greatest(0, floor((epoch_us(TIMESTAMPTZ '2018-01-15 00:00:00+00') - epoch_us({})) / 86400000000.0))"
_POS = " + ".join(
    rf"CASE WHEN regexp_matches(lower(text), '(^|[^a-zA-Z0-9]){t}([^a-zA-Z0-9]|$)') THEN 1 / (1 + (length(regexp_extract(lower(text), '(?s)^(.*?)(^|[^a-zA-Z0-9]){t}([^a-zA-Z0-9]|$)', 1)) + length(regexp_extract(lower(text), '(?s)^(.*?)(^|[^a-zA-Z0-9]){t}([^a-zA-Z0-9]|$)', 2))) / 100) ELSE 0 END"
    for t in ("copper", "freight")
)
_POSITION = f"round(CASE WHEN coalesce(length(text), 0) = 0 THEN 0.5 WHEN length(text) > 500 THEN (({_POS}) / 2) / (1 + 0.1 * log2(length(text) / 500.0)) ELSE ({_POS}) / 2 END, 6)"


@query(f"""WITH {_CHANNELS}
SELECT doc_id, rrf, round(rrf * (1 + 0.25 * coalesce(2 / (1 + exp(0.05 * {_AGE.format('created_at')} / 10)), 1.0)) * (1 + 0.12 * {_POSITION}), 6) AS boosted
FROM fused JOIN documents USING (doc_id) ORDER BY boosted DESC, doc_id LIMIT 50""")
def hybrid_search(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "created_at", "text")
    rows = retrieval.boost(_fused(spark, folder).join(docs, "doc_id"), "created_at", "text", ["copper", "freight"], AS_OF)
    return retrieval.top_k(rows.select("doc_id", "rrf", "boosted"), 50, "boosted")


@query(f"SELECT doc_id, {_POSITION} AS position FROM documents")
def position_score(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", retrieval.position_score(F.col("text"), ["copper", "freight"]).alias("position"))


@query(f"""SELECT id, round(coalesce(2 / (1 + exp(0.05 * {_AGE.format('published_at')} / 10)), 1.0), 6) AS time_score,
round(exp(-ln(2) * greatest(0, (epoch_us(TIMESTAMPTZ '2018-01-15 00:00:00+00') - epoch_us(published_at)) / 86400000000.0) / 7), 6) AS recency FROM raw_information""")
def time_decay(spark, folder):
    r = table(spark, folder, "raw_information")
    return r.select("id", F.round(sc.time_score(F.col("published_at"), AS_OF), 6).alias("time_score"), F.round(sc.recency(F.col("published_at"), AS_OF), 6).alias("recency"))


@query("""WITH src AS (SELECT lower(trim(source)) AS s, min(authority) AS a FROM info_sources GROUP BY 1)
SELECT r.id, round(0.40 * exp(-ln(2) * greatest(0, (epoch_us(TIMESTAMPTZ '2018-01-15 00:00:00+00') - epoch_us(coalesce(published_at, ingested_at))) / 86400000000.0) / 7)
 + 0.30 * coalesce(a, 0.4) + 0.20 * 0.1 + 0.05, 6) AS importance
FROM raw_information r LEFT JOIN src ON src.s = lower(trim(r.source))""")
def recency_importance(spark, folder):
    src = table(spark, folder, "info_sources").groupBy(F.lower(F.trim("source")).alias("s")).agg(F.min("authority").alias("a"))
    r = table(spark, folder, "raw_information").withColumn("s", F.lower(F.trim("source"))).join(F.broadcast(src), "s", "left")  # info_sources has a fixed size
    recent = sc.recency(sc.first_time(F.col("published_at"), F.col("ingested_at")), AS_OF)
    return r.select("id", F.round(sc.importance(recent, F.coalesce("a", F.lit(0.4)), F.lit(0.1)), 6).alias("importance"))


_RANKED = "ranked AS (SELECT id, info_type, title, importance_score AS score, published_at, row_number() OVER (ORDER BY importance_score DESC, id) AS rank FROM raw_information WHERE importance_score IS NOT NULL QUALIFY rank <= 100)"


def _ranked(spark, folder):
    r = table(spark, folder, "raw_information").where("importance_score is not null")
    return retrieval.rank_rows(r.select("id", "info_type", "title", F.col("importance_score").alias("score"), "published_at"), 100, tie="id")


@query(f"WITH {_RANKED} SELECT id, rank FROM ranked WHERE rank <= 5 OR published_at >= TIMESTAMPTZ '2018-01-10 00:00:00+00'")
def floor_filter(spark, folder):
    return retrieval.keep_floor(_ranked(spark, folder), F.col("published_at") >= F.lit("2018-01-10 00:00:00").cast("timestamp"), 20).select("id", "rank")


_SCORED = "scored AS (SELECT id, info_type, title, importance_score AS score, published_at FROM raw_information WHERE importance_score IS NOT NULL)"


def _scored(spark, folder):
    r = table(spark, folder, "raw_information").where("importance_score is not null")
    return r.select("id", "info_type", "title", F.col("importance_score").alias("score"), "published_at")


@query(f"""WITH {_SCORED} SELECT id, round(score * (1 - (1 - coalesce((CAST(regexp_matches(lower(title), '(^|[^a-zA-Z0-9])report([^a-zA-Z0-9]|$)') AS INT) + CAST(regexp_matches(lower(title), '(^|[^a-zA-Z0-9])on([^a-zA-Z0-9]|$)') AS INT)
 + CAST(contains(lower(title), '收购') AS INT)) / 3, 0)) * 0.5), 6) AS demoted FROM scored""")
def keyword_demotion(spark, folder):
    return retrieval.keyword_demotion(_scored(spark, folder), "title", ["report", "on", "收购"]).select("id", "demoted")


@query(f"""WITH {_RANKED}, s AS (SELECT *, row_number() OVER (PARTITION BY info_type ORDER BY score DESC, id) AS r FROM raw_information_scored)
SELECT info_type, id, r AS rank FROM s WHERE r <= 3""".replace("raw_information_scored", "(SELECT info_type, id, importance_score AS score FROM raw_information WHERE importance_score IS NOT NULL)"))
def diversity_topk(spark, folder):
    r = table(spark, folder, "raw_information").where("importance_score is not null")
    return retrieval.top_per_group(r, "info_type", 3, "importance_score", "id").select("info_type", "id", "rank")


@query(f"""WITH {_SCORED}, g AS (SELECT id, score AS f, CASE WHEN length(title) % 3 = 0 THEN 0 ELSE coalesce(length(title) % 50, 0) / 50.0 END AS r, CASE WHEN contains(lower(title), 'report') THEN 0.15 ELSE 0 END AS e,
 coalesce(2 / (1 + exp(0.05 * {_AGE.format('published_at')} / 10)), 1.0) AS t, CASE WHEN info_type = 'news' THEN 2.0 ELSE 0.3 END AS p FROM scored),
b AS (SELECT min(f) AS f0, max(f) AS f1, min(r) AS r0, max(r) AS r1 FROM g)
SELECT id, round(CASE WHEN r > 0.01 THEN 0.25 * (r - r0) / (r1 - r0) + 0.20 * (f - f0) / (f1 - f0) + 0.08 * e + 0.35 * t + 0.12 * p
 ELSE 0.30 * (f - f0) / (f1 - f0) + 0.08 * e + 0.45 * t + 0.17 * p END, 6) AS final FROM g, b""")
def final_rank(spark, folder):
    """Final scores of all records; lengths of titles stand for a reranker, which leaves out a third."""
    n = F.length("title")
    rows = _scored(spark, folder).select(
        "id", F.when(n % 3 == 0, 0.0).otherwise(F.coalesce(n % 50, F.lit(0)) / 50.0).alias("rerank"), F.col("score").alias("rrf"), F.when(tx.contains_ignoring_case(F.col("title"), "report"), 0.15).otherwise(0.0).alias("entity"),
        sc.time_score(F.col("published_at"), AS_OF).alias("recency"), F.when(F.col("info_type") == "news", 2.0).otherwise(0.3).alias("type_priority"),
    )
    return retrieval.final_score(rows, *search_plans.lx.FINAL["news"]).select("id", "final")


@query(f"""WITH {_RANKED}, h AS (SELECT *, CASE WHEN rank <= 5 THEN 1 ELSE 0 END AS top FROM ranked WHERE rank <= 20),
n AS (SELECT *, sum(top) OVER (PARTITION BY info_type) AS k, sum(top) OVER () AS head FROM h),
m AS (SELECT *, max(k) OVER () AS most FROM n),
p AS (SELECT *, CASE WHEN most > 0.3 * head THEN min(CASE WHEN k < most AND rank > 3 THEN rank END) OVER () END AS pick FROM m)
SELECT id, CAST(CASE WHEN rank = pick THEN 3 WHEN rank >= 3 AND rank < pick THEN rank + 1 ELSE rank END AS INT) AS position FROM p""")
def diversity_rule(spark, folder):
    return retrieval.diversify(_ranked(spark, folder).where("rank <= 20"), "info_type", share=0.3).select("id", "position")


# ---- duplicates
@query("""SELECT id FROM raw_information WHERE content_hash IS DISTINCT FROM
 sha256(trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')) || ' ' || trim(regexp_replace(lower(coalesce(body, '')), '\\s+', ' ', 'g')))""")
def content_hash_check(spark, folder):
    return dedup.hash_mismatches(table(spark, folder, "raw_information"))


@query("SELECT content_hash, arg_min(id, (ingested_at, id)) AS id, count(*) AS n FROM raw_information WHERE content_hash IS NOT NULL GROUP BY content_hash")
def content_hash_dedup(spark, folder):
    return dedup.first_of_content(table(spark, folder, "raw_information"))


_TITLES = """t AS (SELECT info_type, lower(title) AS t, min(id) AS id FROM raw_information WHERE title <> '' GROUP BY 1, 2),
g AS (SELECT info_type, id, CASE WHEN length(t) < 2 THEN [t] ELSE list_distinct([substr(t, i, 2) for i in generate_series(1, length(t) - 1)]) END AS g FROM t),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS i, len(a.g) AS na, len(b.g) AS nb FROM g a JOIN g b ON a.info_type = b.info_type AND a.id < b.id AND least(len(a.g), len(b.g)) >= 0.5 * greatest(len(a.g), len(b.g))),
pairs AS (SELECT a, b, round(i / (na + nb - i), 6) AS similarity FROM p WHERE i / (na + nb - i) >= 0.5)"""


@query(f"WITH {_TITLES} SELECT * FROM pairs")
def title_bigram_dedup(spark, folder):
    return dedup.title_pairs(table(spark, folder, "raw_information"))


@query(f"""WITH RECURSIVE {_TITLES}, arcs AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS other FROM arcs UNION SELECT reach.node, arcs.b FROM reach JOIN arcs ON arcs.a = reach.other)
SELECT node, min(other) AS label FROM reach GROUP BY node""")
def connected_components(spark, folder):
    return dedup.title_groups(table(spark, folder, "raw_information"))


def _clean_sql(c: str) -> str:
    out = f"trim({c})"
    cases = " ".join(f"WHEN ends_with({out}, '{e}') AND length({out}) > {len(e) + 1} THEN trim(left({out}, length({out}) - {len(e)}))" for e in tx.NAME_ENDINGS)
    return f"lower(CASE {cases} ELSE {out} END)"


def _norm_sql(c: str) -> str:
    out = c
    for w in tx.NOISE_WORDS:
        out = f"replace({out}, '{w}', '')"
    return _clean_sql(out)


@query()  # edit distances of DuckDB count bytes; tested against brute force
def levenshtein_pairs(spark, folder):
    return dedup.levenshtein_pairs(table(spark, folder, "world_nodes"))


@query("""WITH k AS (SELECT id, split_part(upper(trim(ticker)), '.', 1) AS k FROM world_nodes WHERE upper(trim(ticker)) NOT IN ('', '-', 'N/A')),
f AS (SELECT k, min(id) AS first FROM k GROUP BY k) SELECT first, id FROM k JOIN f USING (k) WHERE id <> first""")
def same_ticker_pairs(spark, folder):
    t = F.upper(F.trim("ticker"))
    return dedup.same_key_pairs(table(spark, folder, "world_nodes"), F.when(~t.isin("", "-", "N/A"), F.substring_index(t, ".", 1)))


@query()  # matching blocks; tested against brute force
def sequence_ratio_pairs(spark, folder):
    return dedup.sequence_ratio_pairs(table(spark, folder, "world_nodes"))


@query(f"SELECT id, min(id) OVER (PARTITION BY node_type, n) AS class_id FROM (SELECT id, node_type, {_norm_sql('name')} AS n FROM world_nodes) WHERE n <> ''")
def name_classes(spark, folder):
    return dedup.name_classes(table(spark, folder, "world_nodes"))


@query("SELECT id, min(id) OVER (PARTITION BY info_type, lower(title)) AS class_id FROM raw_information WHERE title <> ''")
def title_classes(spark, folder):
    return dedup.title_classes(table(spark, folder, "raw_information"))


@query(f"""WITH n AS (SELECT id, node_type, {_clean_sql('name')} AS n FROM world_nodes WHERE length(n) >= 3),
"""
"""r AS (SELECT * FROM (VALUES """ + ", ".join(f"('{p}', '{c}', '{e}')" for (p, c), e in graph.EDGE_TYPES.items()) + """) v(p, c, e)),
h AS (SELECT s.id AS parent, l.id AS child, CASE WHEN s.node_type = 'macro' THEN 'macro_theme' ELSE s.node_type END AS pt, CASE WHEN l.node_type = 'macro' THEN 'macro_theme' ELSE l.node_type END AS ct
      FROM n l JOIN n s ON l.n <> s.n AND contains(l.n, s.n))
SELECT DISTINCT parent AS parent_node_id, child AS child_node_id, coalesce(a.e, b.e) AS relationship_type
FROM h LEFT JOIN r a ON a.p = ct AND a.c = pt LEFT JOIN r b ON b.p = pt AND b.c = ct WHERE coalesce(a.e, b.e) IS NOT NULL""")
def containment_pairs(spark, folder):
    return graph.containment_edges(table(spark, folder, "world_nodes"))


@query("""WITH RECURSIVE u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.35),
arcs AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT a AS node, a AS other FROM arcs UNION SELECT reach.node, arcs.b FROM reach JOIN arcs ON arcs.a = reach.other)
SELECT node, min(other) AS label FROM reach GROUP BY node""")
def vector_clusters(spark, folder):
    return dedup.vector_clusters(table(spark, folder, "embeddings"), least=0.35)


# ---- temporal
@query(f"""SELECT node_id, version, id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY effective_from DESC, version DESC, id DESC) AS rn FROM node_states
WHERE effective_from <= TIMESTAMPTZ '{AS_OF}+00' AND (effective_to IS NULL OR effective_to > TIMESTAMPTZ '{AS_OF}+00')) WHERE rn = 1""")
def as_of_state(spark, folder):
    return temporal.as_of_state(table(spark, folder, "node_states"), AS_OF)


@query(f"""SELECT 'raw_information' AS name, count(*) AS rows FROM raw_information WHERE ingested_at <= TIMESTAMPTZ '{AS_OF}+00'
UNION ALL SELECT 'world_nodes', count(*) FROM world_nodes WHERE created_at <= TIMESTAMPTZ '{AS_OF}+00'""")
def as_of_counts(spark, folder):
    return temporal.as_of_counts({"raw_information": (table(spark, folder, "raw_information"), "ingested_at"), "world_nodes": (table(spark, folder, "world_nodes"), "created_at")}, AS_OF)


_AT = "SELECT node_id, arg_max(version, (effective_from, version, id)) AS v, list_distinct(list_transform(coalesce(arg_max(coalesce(primary_drivers, []), (effective_from, version, id)), []), lambda x: x.driver)) AS i FROM node_states WHERE effective_from <= TIMESTAMPTZ '{0}+00' AND (effective_to IS NULL OR effective_to > TIMESTAMPTZ '{0}+00') GROUP BY node_id"


@query(f"""WITH a AS ({_AT.format('2018-01-01 00:00:00')}), b AS ({_AT.format('2018-01-20 00:00:00')})
SELECT node_id, a.v AS version_a, b.v AS version_b, list_sort(list_filter(b.i, lambda x: NOT list_contains(a.i, x))) AS added, list_sort(list_filter(a.i, lambda x: NOT list_contains(b.i, x))) AS removed
FROM a JOIN b USING (node_id)""")
def state_diff(spark, folder):
    return temporal.state_diff(table(spark, folder, "node_states"), "2018-01-01 00:00:00", "2018-01-20 00:00:00")


@query("""SELECT node_id, version, next_version FROM (SELECT node_id, version, lead(version) OVER (PARTITION BY node_id ORDER BY version) AS next_version
FROM (SELECT DISTINCT node_id, version FROM node_states)) WHERE next_version > version + 1""")
def version_gap(spark, folder):
    return temporal.version_gaps(table(spark, folder, "node_states"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY node_id, version ORDER BY id) = 1 AND effective_from IS DISTINCT FROM effective_to AND core_logic IS NOT NULL AS keep FROM node_states),
g AS (SELECT *, sum(CAST(keep AS INT)) OVER (PARTITION BY node_id ORDER BY effective_from, version, id) AS run FROM m),
e AS (SELECT *, last_value(effective_to) OVER (PARTITION BY node_id, run ORDER BY effective_from, version, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS en FROM g)
SELECT id, node_id, version, effective_from, en AS effective_to FROM e WHERE keep""")
def chain_repair(spark, folder):
    return temporal.repair_chain(table(spark, folder, "node_states"), F.col("core_logic").isNull()).select("id", "node_id", "version", "effective_from", "effective_to")


@query("""WITH u AS (SELECT node_id, row_number() OVER w AS version, effective_from, lead(effective_from) OVER w AS effective_to,
 sha256(last_value(core_logic IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS core_sha FROM node_state_updates WINDOW w AS (PARTITION BY node_id ORDER BY effective_from, update_id))
SELECT node_id, CAST(version AS INT) AS version, effective_from, effective_to, core_sha FROM u""")
def scd2_build(spark, folder):
    rows = temporal.append_versions(table(spark, folder, "node_state_updates"), "node_id", "effective_from", "update_id", ["core_logic"])
    return rows.select("node_id", "version", "effective_from", "effective_to", F.sha2("core_logic", 256).alias("core_sha"))


@query(f"SELECT id FROM node_states WHERE effective_from <= TIMESTAMPTZ '{AS_OF}+00' AND (effective_to IS NULL OR effective_to > TIMESTAMPTZ '{AS_OF}+00')")
def validity_check(spark, folder):
    return temporal.valid_at(table(spark, folder, "node_states"), AS_OF).select("id")


# ---- relational core
@query("""SELECT processing_status, count(*) AS n FROM raw_information GROUP BY 1""")
def queue_stats(spark, folder):
    return table(spark, folder, "raw_information").groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM raw_information WHERE processing_status = 'ingested' ORDER BY importance_score DESC NULLS LAST, ingested_at, id LIMIT 200")
def queue_dequeue(spark, folder):
    r = table(spark, folder, "raw_information").where("processing_status = 'ingested'")
    return r.orderBy(F.col("importance_score").desc_nulls_last(), "ingested_at", "id").limit(200).select("id")


@query("""SELECT id, title FROM raw_information WHERE info_type = 'news' AND published_at >= TIMESTAMPTZ '2018-01-10 00:00:00+00' AND published_at < TIMESTAMPTZ '2018-01-21 00:00:00+00'
ORDER BY published_at DESC, id LIMIT 20 OFFSET 20""")
def paged_list(spark, folder):
    """Second page of 20; the last day of the range counts whole."""
    r = table(spark, folder, "raw_information").where("info_type = 'news'")
    r = r.where((F.col("published_at") >= "2018-01-10 00:00:00") & (F.col("published_at") < F.lit("2018-01-20").cast("timestamp") + F.expr("INTERVAL 1 DAY")))
    return r.orderBy(F.desc("published_at"), "id").offset(20).limit(20).select("id", "title")


@query("""SELECT n.id, n.name, s.version FROM world_nodes n LEFT JOIN (SELECT node_id, max(version) AS version FROM node_states WHERE effective_to IS NULL GROUP BY node_id) s ON s.node_id = n.id WHERE n.is_active""")
def fetch_by_ids(spark, folder):
    """Active nodes with the version of their current state."""
    current = table(spark, folder, "node_states").where("effective_to is null").groupBy(F.col("node_id").alias("id")).agg(F.max("version").alias("version"))
    return table(spark, folder, "world_nodes").where("is_active").select("id", "name").join(current, "id", "left")


@query("""SELECT name FROM world_nodes WHERE node_type = 'company' INTERSECT SELECT name FROM world_nodes WHERE node_type = 'institution'
UNION SELECT name FROM (SELECT name FROM world_nodes WHERE node_type = 'sector' EXCEPT SELECT name FROM world_nodes WHERE node_type = 'concept')""")
def set_ops(spark, folder):
    n = table(spark, folder, "world_nodes")
    of = lambda k: n.where(F.col("node_type") == k).select("name")
    return of("company").intersect(of("institution")).union(of("sector").subtract(of("concept"))).distinct()


@query("""WITH h AS (SELECT info_type, count(*) AS n FROM raw_information GROUP BY 1)
SELECT info_type, n, round(100.0 * sum(n) OVER (ORDER BY n DESC, info_type) / sum(n) OVER (), 6) AS cumulative FROM h""")
def weighted_histogram(spark, folder):
    h = table(spark, folder, "raw_information").groupBy("info_type").agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy(F.lit(0))  # after the aggregation there is one row per type
    return h.withColumn("cumulative", F.round(100.0 * F.sum("n").over(all_.orderBy(F.desc("n"), "info_type")) / F.sum("n").over(all_), 6))


@query("""SELECT source_kind, quantile_cont(lag_s, 0.5) AS p50, quantile_cont(lag_s, 0.95) AS p95, quantile_cont(lag_s, 0.99) AS p99
FROM (SELECT info_type AS source_kind, (epoch_us(ingested_at) - epoch_us(published_at)) / 1e6 AS lag_s FROM raw_information WHERE published_at IS NOT NULL) GROUP BY 1""")
def latency_percentiles(spark, folder):
    """Delay of arrival; exact percentiles come from counts per distinct value, combined before the shuffle."""
    lag = (F.unix_micros("ingested_at") - F.unix_micros("published_at")) / 1e6
    rows = table(spark, folder, "raw_information").where("published_at is not null").select(F.col("info_type").alias("source_kind"), lag.alias("lag_s"))
    return rows.groupBy("source_kind").agg(*[F.expr(f"percentile(lag_s, {p})").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


@query("SELECT id FROM raw_information WHERE regexp_matches(lower(title), '(^|[^a-zA-Z0-9])corp([^a-zA-Z0-9]|$)')")
def word_filter(spark, folder):
    return table(spark, folder, "raw_information").where(tx.word_match(F.col("title"), "Corp")).select("id")


@query(f"SELECT id, {_norm_sql('name')} AS n FROM world_nodes")
def name_normal_form(spark, folder):
    return table(spark, folder, "world_nodes").select("id", tx.normalized_name(F.col("name")).alias("n"))


# ---- graph
_EDGES = """e AS (SELECT parent_node_id AS src, child_node_id AS dst, regexp_replace(regexp_replace(lower(relationship_type), '^[\\s_-]+|[\\s_-]+$', '', 'g'), '[\\s_-]+', '_', 'g') AS kind,
 max(coalesce(weight, 1.0) * CASE WHEN coalesce(len(evidence_ids), 0) <= 0 THEN 0.15 ELSE least(1.0, 0.40 + 0.20 * ln(len(evidence_ids))) END) AS strength
 FROM world_node_edges WHERE parent_node_id IS NOT NULL AND child_node_id IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"""WITH {_EDGES}, arcs AS (SELECT src, dst, max(strength) AS s FROM e GROUP BY 1, 2), roots AS (SELECT DISTINCT src AS source FROM e),
l1 AS (SELECT source, dst AS node, max(s) AS st FROM roots JOIN arcs ON src = source WHERE dst <> source GROUP BY 1, 2),
l2 AS (SELECT l1.source, dst AS node, max(l1.st * 0.8 * s) AS st FROM l1 JOIN arcs ON src = l1.node WHERE dst <> l1.source AND NOT EXISTS (SELECT 1 FROM l1 v WHERE v.source = l1.source AND v.node = dst) GROUP BY 1, 2),
l3 AS (SELECT l2.source, dst AS node, max(l2.st * 0.8 * s) AS st FROM l2 JOIN arcs ON src = l2.node WHERE dst <> l2.source AND NOT EXISTS (SELECT 1 FROM l1 v WHERE v.source = l2.source AND v.node = dst)
       AND NOT EXISTS (SELECT 1 FROM l2 v WHERE v.source = l2.source AND v.node = dst) GROUP BY 1, 2)
SELECT source, node, level, strength FROM (SELECT source, node, 1 AS level, round(st, 6) AS strength FROM l1 UNION ALL SELECT source, node, 2, round(st, 6) FROM l2 UNION ALL SELECT source, node, 3, round(st, 6) FROM l3)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY strength DESC, level, node) <= 20""")
def impact_path(spark, folder):
    """The 20 strongest impacts of every node."""
    edges = graph.weighted_edges(table(spark, folder, "world_node_edges"))
    found = graph.impact_paths(edges, edges.select(F.col("src").alias("source")).distinct(), 3)
    best = Window.partitionBy("source").orderBy(F.desc("strength"), "level", "node")
    return found.withColumn("r", F.row_number().over(best)).where("r <= 20").drop("r")


@query("""WITH d AS (SELECT DISTINCT parent_node_id AS p, child_node_id AS c FROM world_node_edges WHERE parent_node_id IS NOT NULL AND child_node_id IS NOT NULL)
SELECT node_id, CAST(sum(np) AS BIGINT) AS n_parents, CAST(sum(nc) AS BIGINT) AS n_children FROM (SELECT p AS node_id, 0 AS np, 1 AS nc FROM d UNION ALL SELECT c, 1, 0 FROM d) GROUP BY 1""")
def neighbors(spark, folder):
    return graph.neighbours(table(spark, folder, "world_node_edges"))


@query("""WITH s AS (SELECT id AS state_id, unnest(key_evidence_ids[1:10]) AS info_id, generate_subscripts(key_evidence_ids[1:10], 1) - 1 AS position FROM node_states)
SELECT state_id, CAST(position AS INT) AS position, info_id FROM s WHERE info_id IN (SELECT id FROM raw_information)""")
def evidence_trace(spark, folder):
    return graph.state_evidence(table(spark, folder, "node_states"), table(spark, folder, "raw_information"))


@query("""SELECT info_id, count(DISTINCT id) AS n_states FROM (SELECT id, unnest(key_evidence_ids) AS info_id FROM node_states) WHERE info_id IN (SELECT id FROM raw_information) GROUP BY 1""")
def evidence_uses(spark, folder):
    return graph.record_uses(table(spark, folder, "raw_information"), table(spark, folder, "node_states"))


@query()
def relationship_upsert(spark, folder):
    """Edges as relation events in order of creation; the fold has no SQL of bounded size."""
    e = table(spark, folder, "world_node_edges").where("parent_node_id is not null")
    events = e.select(F.col("parent_node_id").alias("src"), F.col("child_node_id").alias("dst"), normal_type(F.col("relationship_type")).alias("kind"), F.col("created_at").alias("at"), "id", F.col("weight").alias("strength"), F.col("id").alias("evidence"))
    return graph.fold_relationships(events)


@query()
def label_propagation(spark, folder):
    return graph.label_propagation(graph.weighted_edges(table(spark, folder, "world_node_edges")))


@query(f"""WITH {_EDGES} SELECT src, dst, kind, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst, kind) AS r FROM e) WHERE r <= 5""")
def edge_topk(spark, folder):
    return graph.dominant_edges(graph.weighted_edges(table(spark, folder, "world_node_edges"))).select("src", "dst", "kind", "rank")


@query("""WITH k AS (SELECT id AS node_id, min(id) OVER (PARTITION BY lower(trim(name)), node_type) AS group_id FROM world_nodes WHERE name IS NOT NULL),
m AS (SELECT e.id, CASE WHEN p.group_id IS NOT NULL THEN p.group_id ELSE parent_node_id END AS p, coalesce(c.group_id, child_node_id) AS c,
      regexp_replace(regexp_replace(lower(relationship_type), '^[\\s_-]+|[\\s_-]+$', '', 'g'), '[\\s_-]+', '_', 'g') AS t
      FROM world_node_edges e LEFT JOIN k p ON p.node_id = parent_node_id LEFT JOIN k c ON c.node_id = child_node_id)
SELECT p AS parent_node_id, c AS child_node_id, t AS relationship_type, min(id) AS id FROM m WHERE p IS NULL OR p <> c GROUP BY 1, 2, 3""")
def node_merge_remap(spark, folder):
    named = table(spark, folder, "world_nodes").where("name is not null").select("id", F.lower(F.trim("name")).alias("n"), "node_type")
    firsts = named.groupBy("n", "node_type").agg(F.min("id").alias("group_id"))
    merged = named.join(firsts, ["n", "node_type"]).select(F.col("id").alias("node_id"), "group_id")
    return graph.merge_nodes(table(spark, folder, "world_node_edges"), merged)


# ---- audit
_STATUS = ["ingested", "deduped", "entities_extracted", "attached_to_nodes", "analyzed", "world_model_updated", "trade_validated", "completed"]
_INFO = ["news", "report", "social_media", "filing", "research", "other"]
_ROLES = ["primary", "secondary", "background", "risk", "historical_reference", "driver_evidence", "risk_evidence"]
_NODE_TYPES = "macro sector industry concept company product commodity currency region event policy index indicator person institution regulation macro_theme".split()
_NULLS = {
    "raw_information": ["id", "title", "body", "source", "published_at", "ingested_at", "info_type", "language", "content_hash", "processing_status"],
    "world_nodes": ["id", "name", "node_type", "is_active", "created_at"], "world_node_edges": ["id", "parent_node_id", "child_node_id", "relationship_type", "weight"],
    "node_states": ["id", "node_id", "version", "effective_from", "core_logic"], "node_attachments": ["id", "node_id", "attachment_type", "attachment_id", "role"],
}


def _union(parts: list[str]) -> str:
    return "SELECT family, label, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM (" + " UNION ALL ".join(parts) + ")"


def _violations(family: str, label: str, t: str, condition: str) -> str:
    return f"SELECT '{family}' AS family, '{label}' AS label, count(*) FILTER (WHERE {condition}) AS violations FROM {t}"


@query(_union([_violations("not_null", f"{t}.{c}", t, f"{c} IS NULL") for t, cs in _NULLS.items() for c in cs]))
def audit_nulls(spark, folder):
    return audit.report(*[audit.row_checks(table(spark, folder, t), audit.not_null(t, *cs)) for t, cs in _NULLS.items()])


_ENUMS = [("raw_information", "info_type", _INFO), ("raw_information", "processing_status", _STATUS), ("node_attachments", "role", _ROLES), ("node_attachments", "attachment_type", ["raw_info", "analysis"]), ("world_nodes", "node_type", _NODE_TYPES)]


@query(_union([_violations("enum", f"{t}.{c}", t, f"{c} IS NOT NULL AND {c} NOT IN ({', '.join(map(repr, v))})") for t, c, v in _ENUMS]))
def audit_enums(spark, folder):
    return audit.report(*[audit.row_checks(table(spark, folder, t), [audit.member(t, c, v)]) for t, c, v in _ENUMS])


_FKS = [("edge.parent", "world_node_edges", "parent_node_id"), ("edge.child", "world_node_edges", "child_node_id"), ("state.node", "node_states", "node_id"), ("attachment.node", "node_attachments", "node_id")]


@query(_union([_violations("orphan", label, t, f"{c} IS NOT NULL AND {c} NOT IN (SELECT id FROM world_nodes)") for label, t, c in _FKS]))
def audit_orphans(spark, folder):
    nodes = table(spark, folder, "world_nodes")
    return audit.report(*[audit.orphans(label, table(spark, folder, t), F.col(c), nodes) for label, t, c in _FKS])


@query(_union([f"SELECT 'array_orphan' AS family, '{label}' AS label, count(*) FILTER (WHERE x IS NOT NULL AND x NOT IN (SELECT id FROM raw_information)) AS violations FROM (SELECT unnest({c}) AS x FROM {t})" for label, t, c in (("state.evidence", "node_states", "key_evidence_ids"), ("edge.evidence", "world_node_edges", "evidence_ids"))]))
def audit_array_orphans(spark, folder):
    records = table(spark, folder, "raw_information")
    parts = [audit.orphans(label, table(spark, folder, t).select(F.explode(c).alias("x")), F.col("x"), records, family="array_orphan") for label, t, c in (("state.evidence", "node_states", "key_evidence_ids"), ("edge.evidence", "world_node_edges", "evidence_ids"))]
    return audit.report(*parts)


@query(_union([_violations("polymorphic", "attachment.raw_info", "node_attachments", "attachment_type = 'raw_info' AND attachment_id IS NOT NULL AND attachment_id NOT IN (SELECT id FROM raw_information)")]))
def audit_polymorphic(spark, folder):
    a = table(spark, folder, "node_attachments").where("attachment_type = 'raw_info'")
    return audit.report(audit.orphans("attachment.raw_info", a, F.col("attachment_id"), table(spark, folder, "raw_information"), family="polymorphic"))


_LOGIC = [
    ("edge.self_loop", "world_node_edges", "parent_node_id = child_node_id"), ("edge.weight", "world_node_edges", "weight <= 0"), ("state.interval", "node_states", "effective_to < effective_from"),
    ("record.score", "raw_information", "importance_score < 0 OR importance_score > 1"), ("record.future", "raw_information", "published_at > ingested_at"),
    ("attachment.score", "node_attachments", "relevance_score < 0 OR relevance_score > 1"),
]


@query(_union([_violations("logic", label, t, c) for label, t, c in _LOGIC]))
def audit_logic(spark, folder):
    return audit.report(*[audit.row_checks(table(spark, folder, t), [audit.Check("logic", label, F.expr(c))]) for label, t, c in _LOGIC])


_QUALITY = [
    ("node.untrimmed_name", "world_nodes", "name <> trim(name)"), ("node.empty_name", "world_nodes", "trim(name) = ''"), ("record.empty_body", "raw_information", "trim(body) = ''"),
    ("record.empty_hash", "raw_information", "content_hash = ''"), ("node.empty_alias", "world_nodes", "array_contains(aliases, '')"),
]


@query(
    _union(
        [_violations("quality", label, t, c.replace("array_contains", "list_contains")) for label, t, c in _QUALITY]
        + ["SELECT 'quality' AS family, 'state.repeated_version' AS label, count(*) AS violations FROM (SELECT node_id, version FROM node_states GROUP BY 1, 2 HAVING count(*) > 1)"]
        + ["SELECT 'quality' AS family, 'state.version_gap' AS label, count(*) AS violations FROM (SELECT version, lead(version) OVER (PARTITION BY node_id ORDER BY version) AS n FROM (SELECT DISTINCT node_id, version FROM node_states)) WHERE n > version + 1"]
    )
)
def audit_quality(spark, folder):
    states = table(spark, folder, "node_states")
    parts = [audit.row_checks(table(spark, folder, t), [audit.Check("quality", label, F.expr(c))]) for label, t, c in _QUALITY]
    return audit.report(*parts, audit.repeated("state.repeated_version", states, "node_id", "version"), audit.gaps("state.version_gap", states, "node_id", "version"))


_COUNTED = ["raw_information", "world_nodes", "world_node_edges", "node_states", "node_attachments"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _COUNTED))
def audit_row_counts(spark, folder):
    parts = [table(spark, folder, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("name"), "rows") for t in _COUNTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- star-schema queries over the analytic tables
@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, folder):
    l = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def nation_revenue(spark, folder):
    t = lambda n: table(spark, folder, n)
    # revenue per order before the join with customers: the large table is shuffled once, reduced
    orders = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    per_customer = orders.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("v").alias("v"))
    placed = per_customer.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("v").alias("v"))
    named = placed.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return named.groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


# ---- entities
def _drivers(spark, folder):
    """Dictionary of the drivers named in states, as commodities."""
    states = table(spark, folder, "node_states").select(F.explode("primary_drivers").alias("d"))
    return states.select(F.col("d.driver").alias("name"), F.lit("commodity").alias("node_type"), F.array().cast("array<string>").alias("aliases")).where("name is not null").distinct()


def _occurrences(spark, folder):
    nodes = table(spark, folder, "world_nodes").select("name", "node_type", "aliases")
    terms = entities.dictionary_terms(nodes.unionByName(_drivers(spark, folder)))
    records = table(spark, folder, "raw_information").select("id", F.concat_ws(" ", "title", "body").alias("text"), "title")
    return entities.entity_occurrences(entities.match_entities(records, terms, "id", "text"), "id"), records


@query()  # SQL is too slow on the whole dictionary; tested against brute force
def entity_match(spark, folder):
    """Names and aliases of all nodes, and the drivers, in all records."""
    return _occurrences(spark, folder)[0]


@query()
def entity_idf(spark, folder):
    """Rarity of all entities of the dictionary over all records."""
    found, records = _occurrences(spark, folder)
    return entities.inverse_frequencies(found, records, "id", kinds=None)


@query()
def entity_score(spark, folder):
    """Scored entities of every record, cut at the first gap."""
    found, records = _occurrences(spark, folder)
    lengths = records.select("id", F.length("text").alias("length"), "title")
    return entities.cut_at_gap(entities.score_entities(found, lengths, entities.inverse_frequencies(found, records, "id"), "id"), "id")


@query("""WITH r AS (SELECT id, name, node_type, ticker, aliases FROM world_nodes)
SELECT id, name, node_type, CASE WHEN lower(trim(ticker)) = 'chemicals' THEN 1.2 WHEN lower(trim(name)) = 'chemicals' THEN 1.0 WHEN list_contains(list_transform(coalesce(aliases, []), lambda a: lower(trim(a))), 'chemicals') THEN 0.95
 WHEN starts_with(lower(trim(name)), 'chemicals') THEN 0.8 WHEN len(list_filter(coalesce(aliases, []), lambda a: contains(lower(trim(a)), 'chemicals'))) > 0 THEN 0.7 WHEN contains(lower(trim(name)), 'chemicals') THEN 0.5 END AS score
FROM r WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 50""")
def entity_resolve(spark, folder):
    return entities.resolve_names(table(spark, folder, "world_nodes"), ["chemicals"])


@query("""SELECT window_start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def windowed_events(spark, folder):
    from lodestrata.streaming.enrich import windowed_counts

    counts = windowed_counts(table(spark, folder, "events"), "ts", ["event_type"])
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def _search(spark, folder, text, **options):
    plan = search_plans.plan_query(spark, text, **options)
    return search_plans.search(table(spark, folder, "raw_information"), table(spark, folder, "world_nodes"), plan, AS_OF)


@query()
def search_hybrid(spark, folder):
    return _search(spark, folder, "copper cathode freight contracts analysis")


@query()
def search_bm25(spark, folder):
    return _search(spark, folder, "最新 运力合约 公告", mode="bm25")


@query()
def search_nodes(spark, folder):
    return _search(spark, folder, "chemicals", only=("nodes",))
