import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scoring as sc
from lodestrata.functions import text as tx
from lodestrata.operators import dedup, graph, retrieval, temporal
from lodestrata.operators.bitemporal import FOREVER, attached_states, known_regions, lookup_as_known
from lodestrata.operators.hierarchy import descendant_counts, descendants, parent_links, resolve_roots
from lodestrata.operators.history import build_history, history_rows
from lodestrata.streaming.late import COUNTS, UpsertLog, corrections, period_revisions, replayed_revisions

T0 = datetime(2018, 1, 1)


def hours(n):
    return T0 + timedelta(hours=n)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- hierarchies
EDGES = "parent_node_id string, child_node_id string, relationship_type string, parent string"


def test_hierarchy_paths_loops_and_spellings(spark):
    e = spark.createDataFrame(
        [("a", "b", "belongs_to", "x"), ("a", "b", " Belongs-To ", "x"), ("b", "c", "BELONGS TO", "x"), (None, "r", "belongs_to", "x"), ("l1", "l2", "belongs_to", "x"),
         ("l2", "l1", "belongs_to", "x"), ("l2", "t", "belongs_to", "x"), ("s", "s", "belongs_to", "x"), ("z", "y", "upstream_of", "x"), ("q", None, "belongs_to", "x")], EDGES)
    got = {r.node: (r.root, r.depth, r.path) for r in resolve_roots(parent_links(e), with_path=True).collect()}
    assert got == {"a": ("a", 0, ["a"]), "b": ("a", 1, ["a", "b"]), "c": ("a", 2, ["a", "b", "c"]), "r": ("r", 0, ["r"]), "q": ("q", 0, ["q"]), **{n: ("cycle", -1, None) for n in ("l1", "l2", "t", "s")}}
    counts = {r.node: r.n_descendants for r in descendant_counts(resolve_roots(parent_links(e), with_path=True)).collect()}
    assert counts["a"] == 2 and counts["b"] == 1 and counts["c"] == 0


def test_hierarchy_ids_may_hold_separators(spark):
    e = spark.createDataFrame([("x/y", "b", "belongs_to", ""), ("b", "c/", "belongs_to", "")], EDGES)
    resolved = resolve_roots(parent_links(e), with_path=True)
    assert {r.node: r.n_descendants for r in descendant_counts(resolved).collect()} == {"x/y": 2, "b": 1, "c/": 0}
    assert rows(descendants(resolved)) == [("b", "c/", 1), ("x/y", "b", 1), ("x/y", "c/", 2)]


def test_hierarchy_long_chain_hub_and_empty(spark):
    chain = [(f"n{i:04d}", f"n{i + 1:04d}", "belongs_to", None) for i in range(300)] + [("n0200", f"leaf{i}", "belongs_to", None) for i in range(400)]
    got = {r.node: r.depth for r in resolve_roots(parent_links(spark.createDataFrame(chain, EDGES))).collect()}
    assert got["n0300"] == 300 and got["leaf7"] == 201 and len(got) == 701
    assert resolve_roots(parent_links(spark.createDataFrame([], EDGES))).count() == 0


# ---- histories
FEED = "update_id long, node_id string, op string, effective_from timestamp, received_at timestamp, core_logic string, version string"


def brute_history(feed):
    out = []
    by = {}
    for u, n, op, t, r, x, _ in feed:
        if n is not None and t is not None and ((n, t) not in by or (r, u) > by[n, t][0]):
            by[n, t] = ((r, u), op, x)
    for node in {n for n, _ in by}:
        version, open_, text = 0, None, None
        for (_, t), (_, op, x) in sorted((k, v) for k, v in by.items() if k[0] == node):
            if op == "close":
                if open_ is not None:
                    out.append((node, version, open_, t))
                open_ = text = None
            elif x is not None and (open_ is None or " ".join(x.split()) != text):
                if open_ is not None:
                    out.append((node, version, open_, t))
                version, open_, text = version + 1, t, " ".join(x.split())
        if open_ is not None:
            out.append((node, version, open_, None))
    f = lambda t: t.strftime("%Y-%m-%d %H:%M:%S") if t else "open"
    return sorted((n, v, f(a), f(b)) for n, v, a, b in out)


@pytest.mark.parametrize("slices", [1, 5])
def test_history_against_brute_force(spark, slices):
    rng = random.Random(4)
    feed = [
        (i, "hot" if rng.random() < 0.5 else f"n{rng.randrange(6)}", rng.choice(["update", "snapshot", "close"]), hours(rng.randrange(120)), hours(rng.randrange(500)),
         rng.choice([None, "a", " a ", "b\t c", "b c", ""]), "clash")
        for i in range(600)
    ]
    df = spark.createDataFrame(feed + [(9, None, "update", T0, T0, "x", ""), (10, "n1", "update", None, T0, "x", "")], FEED)
    assert rows(history_rows(build_history(df, slices=slices, with_content=False))) == brute_history(feed)
    with_text = build_history(df, slices=slices)
    assert with_text.count() == len(brute_history(feed)) and with_text.where("core_logic is null").count() == 0
    assert build_history(spark.createDataFrame([], FEED)).count() == 0


# ---- bitemporal
STATES = "node_id string, version int, effective_from timestamp, effective_to timestamp, created_at timestamp, k string, cell long"


@pytest.mark.parametrize("slices", [1, 4])
def test_as_known_against_brute_force(spark, slices):
    rng = random.Random(1)
    states = []
    for node in ["hot"] * 40 + [f"n{i}" for i in range(20)]:
        f = rng.randrange(200)
        states.append((node, len(states), hours(f), hours(f + rng.randrange(1, 60)) if rng.random() < 0.6 else None, hours(f + rng.choice([0, 0, 5, 50])), "clash", 1))
    for s in list(states):
        if s[3] is not None and rng.random() < 0.5:
            states.append((s[0], len(states), s[3], None, s[3] + timedelta(hours=rng.choice([0, 20])), "clash", 1))
    states += states[:10]
    probes = [(f"i{i}", rng.choice(["hot", "n1", "n2", "n3", "none"]), hours(rng.randrange(320)) if i % 9 else None, hours(rng.randrange(320)) if i % 7 else None) for i in range(400)]
    s, e = spark.createDataFrame(states, STATES), spark.createDataFrame(probes, "info string, node string, t timestamp, seen timestamp")

    def brute(node, t, seen=None):
        seen = seen or t
        own = [x for x in set(states) if x[0] == node and x[2] <= t and x[4] <= seen]
        if not own:
            return None
        best = max(own, key=lambda x: (x[2], x[4], x[1]))
        end = best[3]
        if end is None or end > t or any(x[0] == node and x[2] == end and x[4] > seen for x in states):
            return best[1]
        return None

    both = sorted((i, n, v) for i, n, t, seen in probes if t and seen and (v := brute(n, t, seen)) is not None)
    assert rows(lookup_as_known(e, s, "node", "t", "seen", slices=slices).select("info", "node", "version")) == both
    want = sorted((i, n, v) for i, n, t, _ in probes if t and (v := brute(n, t)) is not None)
    assert rows(lookup_as_known(e, s, "node", "t", slices=slices).select("info", "node", "version")) == want
    assert lookup_as_known(e.limit(0), s, "node", "t").count() == 0 and lookup_as_known(e, s.limit(0), "node", "t").count() == 0


def test_bursts_fall_into_small_cells(spark):
    """A thousand versions within minutes and one that lasts for years: no cell holds many of them."""
    micro = lambda m: timedelta(microseconds=m)
    burst = [("n", i, T0 + micro(i * 60_000), None, T0 + micro(i * 60_000), "", 0) for i in range(1000)] + [("n", 1000, T0 + timedelta(days=900), None, T0 + timedelta(days=900), "", 0)]
    regions = known_regions(spark.createDataFrame(burst, STATES), slices=3)
    assert regions.count() <= 2 * len(burst)
    sides = regions.where(F.col("r1") >= FOREVER).select("t0", (F.col("t1") - F.col("t0")).alias("w")).orderBy("t0").collect()
    assert len(sides) == len(burst) and all(r.w == 60_000 for r in sides[:-2])
    probes = spark.createDataFrame([("p", "n", T0 + micro(i * 60_000 + 1)) for i in range(0, 1000, 50)], "info string, node string, t timestamp")
    assert sorted(r.version for r in lookup_as_known(probes, spark.createDataFrame(burst, STATES), "node", "t").collect()) == list(range(0, 1000, 50))


def test_attached_states_ignores_other_links(spark):
    a = spark.createDataFrame([("n", "raw_info", "i"), ("n", "raw_info", "i"), ("n", "analysis", "i"), ("n", "raw_info", "gone"), (None, "raw_info", "i")], "node_id string, attachment_type string, attachment_id string")
    r = spark.createDataFrame([("i", hours(5))], "id string, published_at timestamp")
    s = spark.createDataFrame([("n", 1, hours(0), None, hours(0), "", 0)], STATES)
    assert rows(attached_states(a, r, s)) == [("i", "n", 1)]


# ---- late events
RAW = "id string, source string, published_at timestamp, ingested_at timestamp, content_hash string, body string"


def test_late_periods(spark):
    src = spark.createDataFrame([("Daily",)], "source string")
    raw = [
        ("1", " DAILY ", hours(3), hours(4), "a", ""),  # on time
        ("2", "daily", hours(3), hours(40), "a", ""),  # delivered again: not the first
        ("3", "Daily", hours(5), hours(30), "b", ""),  # exactly at the close: on time
        ("4", "Daily", hours(5), hours(31), "c", ""),  # corrects
        ("5", "Daily", hours(5), hours(96), "d", ""),  # exactly at the cut-off: corrects
        ("6", "Daily", hours(5), hours(97), "e", ""),  # too late
        ("7", "Daily", None, hours(40), "f", ""), ("8", "Daily", hours(5), None, "g", ""), ("9", None, hours(5), hours(31), None, None),
    ]
    df = spark.createDataFrame(raw, RAW)
    for issues, dropped in (period_revisions(df, src), replayed_revisions(df, src, waves=1), replayed_revisions(df, src)):
        check_issues(issues, dropped)
    assert corrections(period_revisions(df.limit(0), src)[0]).count() == 0 and corrections(replayed_revisions(df.limit(0), src)[0]).count() == 0


def check_issues(issues, dropped):
    assert rows(corrections(issues)) == [("Daily", "2018-01-01", "2018-01-02"), ("Daily", "2018-01-01", "2018-01-05")]
    assert [r.records for r in issues.orderBy(F.col("arrival_day").asc_nulls_first()).collect()] == [2, 3, 4]
    assert dropped.collect()[0].dropped == 1


def test_replay_equals_the_batch(spark):
    src = spark.createDataFrame([("Daily",), ("Post",)], "source string")
    rng = random.Random(6)
    raw = [(f"{i:03d}", rng.choice(["daily ", "POST", "other"]), hours(i % 48), hours(i % 48 + rng.randrange(130)), rng.choice([f"h{i % 60}", None]), "") for i in range(200)]
    df = spark.createDataFrame(raw, RAW)
    for got, want in zip(replayed_revisions(df, src), period_revisions(df, src)):
        assert rows(got.na.fill("-").withColumn("arrival_day", F.coalesce(F.col("arrival_day").cast("string"), F.lit("-")))) == rows(want.withColumn("arrival_day", F.coalesce(F.col("arrival_day").cast("string"), F.lit("-"))))


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    log = UpsertLog(spark, str(tmp_path / "log"), "source", "period_day", "arrival_day", "arrival")
    day = T0.date()
    put = lambda n, number: log.put(spark.createDataFrame([("a", day, day, "on_time", n)], COUNTS), number)
    for n, number in ((2, 0), (2, 0), (5, 1), (5, 1)):
        put(n, number)
    assert [r.records for r in log.rows(COUNTS).collect()] == [5]


# ---- functions
def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert value(spark, tx.normalize_text(F.lit("  A \t b\n"))) == "a b"
    assert value(spark, tx.truncate(F.lit("abcdef"), 3)) == "abc..."
    assert value(spark, tx.word_match(F.lit("the AI boom"), "ai")) and not value(spark, tx.word_match(F.lit("said"), "ai"))
    assert value(spark, tx.term_position(F.lit("📈 x ai"), "ai")) == 4 and value(spark, tx.term_position(F.lit(None).cast("string"), "ai")) == -1
    assert value(spark, tx.clean_name(F.lit("半导体板块"))) == "半导体" and value(spark, tx.clean_name(F.lit("X概念"))) == "X概念"
    assert value(spark, tx.character_pairs(F.lit("abab"))) == ["ab", "ba"] and value(spark, tx.character_pairs(F.lit("a"))) == ["a"]
    assert not value(spark, tx.affirmed(F.lit("不要追高"), "追高")) and value(spark, tx.affirmed(F.lit("可以追高"), "追高"))
    assert value(spark, tx.analyze(F.lit("Net 存款率 x"))) == ["net", "x", "存款", "款率"]
    assert value(spark, tx.drop_stopwords(F.lit("的 了"), ["的", "了"])) == "的 了"


def test_scores(spark):
    assert value(spark, sc.decayed_sum(F.array(F.lit(0.5), F.lit(1.0)))) == 1.25
    assert abs(value(spark, sc.evidence_confidence(F.lit(1))) - 0.40) < 1e-9 and value(spark, sc.evidence_confidence(F.lit(0))) == 0.15
    assert value(spark, sc.time_score(F.lit(None).cast("timestamp"), "2018-01-01")) == 1.0
    assert value(spark, sc.source_authority(F.lit("Reuters"))) == 0.9 and value(spark, sc.source_authority(F.lit("x"))) == 0.4


def test_ranks_and_rules(spark):
    r = spark.createDataFrame([(i, float(10 - i), "a" if i < 6 else "b") for i in range(10)], "doc_id long, score double, kind string")
    ranked = retrieval.rank_rows(r, 10)
    moved = {x.doc_id: x.position for x in retrieval.diversify(ranked, "kind").collect()}
    assert moved[6] == 3 and moved[2] == 4 and sorted(moved.values()) == list(range(1, 11))
    assert retrieval.keep_floor(ranked, F.lit(False), 20).count() == 5
    fused = {x.doc_id: x.rrf for x in retrieval.reciprocal_ranks({"x": (ranked, 1.0), "y": (ranked.where("doc_id < 2"), 1.0)}, 60).collect()}
    assert fused[0] > fused[1] > fused[2] and retrieval.recall_limit(5) == 100 and retrieval.recall_limit(99) == 200
    assert retrieval.bm25(r.select("doc_id", F.lit(None).cast("string").alias("text")), ["a"]).count() == 0


def test_levenshtein_pairs_against_brute_force(spark):
    from lodestrata.operators.dedup import name_blocks

    rng = random.Random(2)
    names = ["".join(rng.choice("abc链") for _ in range(rng.randrange(2, 16))) for _ in range(150)]
    names += [n[:3] + "x" + n[4:] for n in names if len(n) > 8]
    nodes = spark.createDataFrame([(f"i{i:03d}", n, "t") for i, n in enumerate(names)], "id string, name string, node_type string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    kept = [(r.id, r.n) for r in name_blocks(nodes).collect()]
    want = sorted((min(i, j), max(i, j)) for k, (i, x) in enumerate(kept) for j, y in kept[:k] if min(len(x), len(y)) >= 2 and round(1 - edits(x, y) / max(len(x), len(y)), 9) >= 0.85)
    assert rows(dedup.levenshtein_pairs(nodes).select("a", "b")) == want


def test_graph_and_temporal(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("a", "c", 0.1), ("c", "a", 1.0)], "src string, dst string, strength double")
    got = {(r.node): (r.level, r.strength) for r in graph.impact_paths(e, spark.createDataFrame([("a",)], "source string"), 3).collect()}
    assert got == {"b": (1, 0.9), "c": (1, 0.1)}
    ev = spark.createDataFrame([("a", "b", "k", i, str(i), s, x) for i, (s, x) in enumerate([(0.5, "e1"), (None, "e2"), (1.0, "e3")])], "src string, dst string, kind string, at int, id string, strength double, evidence string")
    folded = graph.fold_relationships(ev).first()
    assert folded.strength == round((0.5 * 2 + 1.0) / 3, 4) and folded.n_evidence == 3
    s = spark.createDataFrame([("x", "n", 1, hours(0), hours(2), "t"), ("y", "n", 2, hours(2), hours(2), "t"), ("z", "n", 3, hours(2), None, None)], "id string, node_id string, version int, effective_from timestamp, effective_to timestamp, core_logic string")
    fixed = temporal.repair_chain(s, F.col("core_logic").isNull()).collect()
    assert [(r.id, r.effective_to) for r in fixed] == [("x", None)]


def test_readers_and_sinks(spark, tmp_path):
    from lodestrata.sources import readers, sinks

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('[{"name": "Copper", "entity_type": "commodity", "aliases": ["Cu"], "metadata": {}}]')
    assert readers.read_entity_dictionary(spark, str(tmp_path / "d")).first().aliases == ["Cu"]
    (tmp_path / "n.csv").write_text("content\n【Head】rest of it\nplain text\n")
    assert rows(readers.read_news(spark, str(tmp_path / "n.csv")).select("title", "body")) == [("Head", "rest of it"), ("plain text", "plain text")]
    (tmp_path / "s.txt").write_text("# no\nfed: bank, central bank\n")
    assert readers.read_term_lists(spark, str(tmp_path / "s.txt")).first()["values"] == ["bank", "central bank"]
    old = spark.createDataFrame([("o", "T", "B", T0)], "id string, title string, body string, ingested_at timestamp")
    known = sinks.ingest(old.limit(0).withColumn("content_hash", F.lit("")), old)
    new = spark.createDataFrame([("p", " t ", "b", T0), ("q", "U", "", T0), ("r", "u", None, T0)], "id string, title string, body string, ingested_at timestamp")
    assert rows(sinks.ingest(known, new).select("id")) == [("q",)]
    made = sinks.get_or_create(spark.createDataFrame([("1", "Acme", "company")], "id string, name string, entity_type string"), spark.createDataFrame([(" ACME ", "company"), ("New", "person")], "name string, entity_type string"))
    assert {r.id == "1" for r in made.where("entity_type = 'company'").collect()} == {True} and made.count() == 2
    assert rows(sinks.upsert(old, old.withColumn("body", F.lit("z")), "id").select("body")) == [("z",)]


def test_entities_and_plan(spark):
    from lodestrata.operators import entities as en
    from lodestrata.plans.lexicon import BASE
    from lodestrata.plans.search import channel_weights, plan_query

    d = spark.createDataFrame([("Oil", "commodity", ["crude oil"]), ("美元", "currency", None)], "name string, node_type string, aliases array<string>")
    t = spark.createDataFrame([(1, "Crude oil and oil; soil"), (2, "兑美元走强"), (3, "发电美元"), (4, None)], "id long, text string")
    got = {(r.id, r.entity): r.occurrences for r in en.entity_occurrences(en.match_entities(t, en.dictionary_terms(d), "id", "text"), "id").collect()}
    assert got[1, "Oil"] >= 2 and (2, "美元") in got and (3, "美元") not in got
    plan = plan_query(spark, "最新 公告 铜")
    assert plan.intent == "news" and plan.days == 30 and abs(sum(plan.weights.values()) - sum(BASE.values())) < 1e-4
    assert channel_weights("600519.SH", "entity_lookup", 0.95, {}, True, False)["name"] > 2.5


def test_entry_names_and_sql_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
