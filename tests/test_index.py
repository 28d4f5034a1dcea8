from lodestrata.operators.index import TextIndex
from lodestrata.operators.retrieval import bm25

DOCS = [(1, "copper freight copper"), (2, "freight 存款 contracts"), (3, None), (4, ""), (5, "bond note"), (6, "copper " * 3000)]


def test_index_equals_scan_and_reads_its_buckets(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    stored = TextIndex(spark, str(tmp_path / "index"), "doc_id", buckets=8)
    for batch in (0, 1, 1):  # a batch written again counts once
        stored.add(docs.where(f"doc_id % 2 = {batch}"), "text", batch)
    terms = ["copper", "freight", "存款", "absent"]
    rows = lambda d: sorted(tuple(r) for r in d.select("doc_id", "matched", "score").collect())
    assert rows(stored.bm25(terms)) == rows(bm25(docs, terms)) and rows(stored.bm25(["absent"])) == []
    plan = stored.postings(["copper"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,copper)" in plan
