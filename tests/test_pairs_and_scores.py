"""Pair scans against brute force, vectors in blocks, and the scores of the last ranking step."""

import math
import random
from difflib import SequenceMatcher

import pytest

from lodestrata.operators import dedup, entities, graph, retrieval, temporal


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def names():
    rng = random.Random(9)
    out = []
    for _ in range(60):
        base = "".join(rng.choice("abcde") for _ in range(rng.randrange(3, 14)))
        out.append(base)
        for _ in range(2):
            i = rng.randrange(len(base))
            out.append(rng.choice([base[:i] + base[i + 1 :], base[:i] + "x" + base[i:], base[::-1], base[i:] + base[:i], base[:i] + base[i + 1 : i + 2] + base[i : i + 1] + base[i + 2 :]]))
    return [(f"n{i:03d}", "company" if i % 5 else "person", n) for i, n in enumerate(out)] + [("x1", "company", None), ("x2", "company", ""), (None, "company", "abc")]


@pytest.mark.parametrize("scan, least", [(dedup.levenshtein_pairs, 0.85), (dedup.sequence_ratio_pairs, 0.8)])
def test_name_pairs_against_brute_force(spark, names, scan, least):
    first = {}
    for i, kind, n in sorted(x for x in names if x[0] and x[2] and len(x[2]) >= 2):
        first.setdefault((kind, n.lower()), i)
    items = [(i, kind, n) for (kind, n), i in first.items()]
    def score(x, y):
        if scan is dedup.levenshtein_pairs:
            return 1 - edits(x, y) / max(len(x), len(y))
        return max(SequenceMatcher(None, a, b).ratio() for a, b in ((x, y), (y, x)))

    want = sorted((min(i, j), max(i, j), round(s, 6)) for k, (i, kind, x) in enumerate(items) for j, other, y in items[:k] if kind == other and round(s := score(x, y), 9) >= least)
    assert len(want) > 15 and rows(scan(spark.createDataFrame(names, "id string, node_type string, name string"))) == want


def test_classes_have_every_record(spark):
    nodes = spark.createDataFrame([("b", "company", "Foo"), ("a", "company", "foo"), ("c", "person", "foo"), ("d", "company", None)], "id string, node_type string, name string")
    assert rows(dedup.name_classes(nodes)) == [("a", "a"), ("b", "a"), ("c", "c")]
    records = spark.createDataFrame([("b", "news", "T"), ("a", "news", "t"), ("c", "news", ""), ("d", None, "t")], "id string, info_type string, title string")
    assert ("b", "a") in rows(dedup.title_classes(records))


def test_nearest_in_blocks_equals_one_product(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(8)] if i % 17 else None) for i in range(1, 120)] + [(500, [0.0] * 8)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 10 = 0")
    one = rows(retrieval.nearest(v, q, k=4))
    assert one == rows(retrieval.nearest(v, q, k=4, rows_per_block=20, queries_per_block=3)) and len(one) == 4 * 11
    near = rows(retrieval.nearest(v, q, least=0.4))
    assert near == rows(retrieval.nearest(v, q, least=0.4, rows_per_block=25, queries_per_block=4)) and all(r[2] >= 0.4 for r in near)
    assert retrieval.nearest(v.limit(0), q, k=3).count() == 0


SIGNALS = "id string, rerank double, rrf double, entity double, recency double, type_priority double"


def test_final_scores_are_scaled_over_the_candidates(spark):
    w, without = (0.4, 0.25, 0.12, 0.1, 0.13), (0.0, 0.4, 0.15, 0.12, 0.33)
    data = [("a", 0.9, 0.05, 0.15, 1.0, 1.0), ("b", 0.5, 0.03, 0.0, 0.5, 0.7), ("c", 0.01, 0.04, None, 1.0, 1.0), ("d", None, 0.01, 0.0, 0.0, 0.0)]
    got = {r.id: r.final for r in retrieval.final_score(spark.createDataFrame(data, SIGNALS), w, without).collect()}
    assert got["a"] == pytest.approx(0.4 + 0.25 + 0.12 * 0.15 + 0.1 + 0.13, abs=1e-6)
    assert got["b"] == pytest.approx(0.4 * 0.5 / 0.9 + 0.25 * 0.5 + 0.05 + 0.13 * 0.7, abs=1e-6)
    assert got["c"] == pytest.approx(0.4 * 0.75 + 0.12 + 0.33, abs=1e-6) and got["d"] == 0.0
    flat = [("a", None, 0.05, 0.0, 0.0, 0.0), ("b", None, 0.05, 0.0, 0.0, 0.0)]
    assert {r.final for r in retrieval.final_score(spark.createDataFrame(flat, SIGNALS), w, without).collect()} == {0.2}
    assert retrieval.final_score(spark.createDataFrame([], SIGNALS), w, without).count() == 0


def test_entity_frequencies_of_all_kinds(spark):
    found = spark.createDataFrame([(1, "A", "company"), (2, "A", "company"), (1, "B", "region")], "id long, entity string, kind string")
    docs = spark.range(1, 4)
    assert rows(entities.inverse_frequencies(found, docs, "id", kinds=None)) == [("A", 2, round(math.log(4 / 3) / math.log(4), 6)), ("B", 1, 0.5)]


def test_containment_of_any_stretch(spark):
    nodes = [("s1", "半导体板块", "sector"), ("s2", "功率半导体", "sector"), ("c1", "steel", "company"), ("c2", "Bluesteelworks", "company"), ("x", "ab", "company"), ("y", None, "company")]
    got = rows(graph.containment_edges(spark.createDataFrame(nodes, "id string, name string, node_type string")))
    assert got == [("c1", "c2", "competes_in"), ("s1", "s2", "belongs_to")]


@pytest.mark.parametrize("slices", [1, 5])
def test_versions_in_slices(spark, slices):
    rng = random.Random(3)
    log = [("hot" if rng.random() < 0.6 else f"n{rng.randrange(5)}", rng.randrange(300), i, rng.choice([None, "a", "b"])) for i in range(300)]
    got = rows(temporal.append_versions(spark.createDataFrame(log + [(None, 1, 1, "z")], "k string, at int, serial int, x string"), "k", "at", "serial", ["x"], slices).na.fill({"effective_to": -1, "x": "-"}))
    want = []
    for key in {r[0] for r in log}:
        text, own = None, sorted(r for r in log if r[0] == key)
        own.sort(key=lambda r: (r[1], r[2]))
        for n, r in enumerate(own):
            text = r[3] or text
            want.append((key, n + 1, r[1], own[n + 1][1] if n + 1 < len(own) else -1, text or "-"))
    assert got == sorted(want)
    states = [("hot", v) for v in range(200) if v % 7] * 2 + [("one", 1), ("one", 2), (None, 9)]
    gaps = rows(temporal.version_gaps(spark.createDataFrame(states, "node_id string, version int"), slices))
    assert gaps == [("hot", v - 1, v + 1) for v in range(7, 199, 7)]


def test_upsert_and_term_lists(spark, tmp_path):
    from lodestrata.sources.readers import read_term_lists
    from lodestrata.sources.sinks import upsert

    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("a", 3, "z"), ("a", None, "n"), ("c", 1, "w")], "k string, at int, v string")
    assert rows(upsert(old, new, "k", latest="at")) == [("a", 3, "z"), ("b", 1, "x"), ("c", 1, "w")]
    assert upsert(old, new, "k").count() == 3
    (tmp_path / "t.txt").write_text("# note: x\nratio: a:b, c\n")
    assert rows(read_term_lists(spark, str(tmp_path / "t.txt"))) == [("ratio", ["a:b", "c"])]
