"""Queries without SQL, on small fixtures."""

from datetime import datetime
from difflib import SequenceMatcher

from lodestrata.operators import dedup, entities, graph
from lodestrata.plans.search import plan_query, search
from lodestrata.streaming.enrich import enrich_batch, start_enrichment

T0 = datetime(2018, 1, 1)
RECORDS = "id string, title string, body string, published_at timestamp, ingested_at timestamp, importance_score double"
DATA = [
    ("r1", "Copper freight rises", "copper contracts for freight", T0, T0, 0.9), ("r2", "Copper freight rises!", "copper contracts", T0, T0, 0.1), ("r3", "Bond note", "nothing of it", T0, T0, 0.5),
    ("r4", None, None, None, T0, None), ("r5", "", "", T0, T0, 0.2),
]
NODES = "id string, name string, node_type string, ticker string, aliases array<string>, description string, is_active boolean, updated_at timestamp"


def test_label_propagation_finds_two_triangles(spark):
    e = [(a, b, 1.0) for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x", 0.1), ("a", "a", 9.0)]
    labels = {r.node: r.label for r in graph.label_propagation(spark.createDataFrame(e, "src string, dst string, strength double"), 4).collect()}
    assert len(labels) == 6 and len({labels[n] for n in "abc"}) == 1 and len({labels[n] for n in "xyz"}) == 1


def test_sequence_ratio(spark):
    pairs = spark.createDataFrame([("freight", "freihgt"), ("abc", "xyz"), (None, "x")], "a string, b string")
    got = dedup.sequence_ratio(pairs, "a", "b", 0.5).collect()
    assert [(r.a, r.ratio) for r in got] == [("freight", SequenceMatcher(None, "freight", "freihgt").ratio())]


def test_entity_scores_and_gap(spark):
    found = spark.createDataFrame([(1, "A", "company", 4, 0), (1, "B", "region", 1, 900), (2, "B", "region", 1, 0)], "id long, entity string, kind string, occurrences long, first_position int")
    docs = spark.createDataFrame([(1, 1000), (2, 10), (3, 5)], "id long, length int")
    idf = entities.inverse_frequencies(found, docs, "id")
    scored = entities.score_entities(found, docs, idf, "id")
    assert {(r.id, r.entity) for r in entities.cut_at_gap(scored, "id").collect()} == {(1, "A"), (2, "B")}


def test_search_modes(spark):
    records = spark.createDataFrame(DATA, RECORDS)
    nodes = spark.createDataFrame([("n1", "Copper", "commodity", None, ["Cu"], "red metal", True, T0), ("n2", "Copper old", "commodity", None, None, None, False, T0)], NODES)
    for mode in ("hybrid", "bm25", "embedding"):
        rows = search(records, nodes, plan_query(spark, "copper freight", mode=mode), "2018-01-02").collect()
        ids = [r.id for r in rows]
        assert "n2" not in ids and "r5" not in ids and [r.rank for r in rows] == list(range(1, len(rows) + 1))
        assert "r1" in ids and "r2" not in ids  # nearly the same title, lower rank
    assert search(records.limit(0), nodes.limit(0), plan_query(spark, "copper"), "2018-01-02").count() == 0


def test_stream_enrichment_equals_batch(spark, tmp_path):
    records = spark.createDataFrame(DATA + [("r6", "copper  FREIGHT rises", "Copper contracts for freight", T0, T0, 0.3)], RECORDS)
    terms = spark.createDataFrame([("Copper", "commodity", "copper"), ("Freight", "sector", "freight")], "entity string, kind string, term string")
    records.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen, failed = [], []
    stream = spark.readStream.schema(RECORDS).parquet(str(tmp_path / "in"))
    start_enrichment(stream, terms, lambda d, n: seen.extend(map(tuple, d.collect())), lambda d, n, e: failed.append(e), str(tmp_path / "cp")).awaitTermination(120)
    want = sorted(map(tuple, enrich_batch(records, terms).collect()))
    assert not failed and len(want) == 4 and sorted(r[1:] for r in seen) == sorted(r[1:] for r in want)
