import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import near_duplicates as nd
from lodestrata.llm.bpe import Encoder, count_tokens, default_vocabulary, encode_documents, load_merges
from lodestrata.llm.groups import group_links, match_groups
from lodestrata.llm.name_forms import organisation_form, osa, person_form
from lodestrata.llm.name_variants import Trie, variant_pairs
from lodestrata.llm.packing import first_fit_decreasing, pack_documents, pack_items
from lodestrata.llm.sentences import Segmenter, split_sentences


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- groups
def components(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return sorted((x, root(x)) for x in up)


@pytest.mark.parametrize("rounds", [1, 12])
def test_groups_against_union_find(spark, rounds):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(120)]
    links += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("c030", f"h{i}") for i in range(50)] + [("z", "z")]
    got = rows(group_links(spark.createDataFrame(links, "src string, dst string"), rounds))
    assert got == components(links)


def test_match_groups_edge_cases(spark):
    shape = "match_id long, left_node_id string, right_node_id string, decision string, judged_at timestamp, node string"
    t = lambda d: datetime(2018, 1, d)
    data = [
        (1, "A", " {b} ", "merge", t(1), "x"), (2, "b", "a", "keep", t(2), "x"), (3, "a", "b", "merge", t(3), "x"), (4, "c", "b", "merge", t(1), "x"), (5, None, "b", "merge", t(1), "x"),
        (6, " ", "b", "merge", t(1), "x"), (7, "d", "d", "merge", t(1), "x"), (8, "e", "f", "merge", t(1), "x"), (9, "e", "f", None, t(1), "x"), (10, "g", "h", "merge", None, "x"),
    ]
    assert rows(match_groups(spark.createDataFrame(data, shape))) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("g", "g"), ("h", "g")]
    assert match_groups(spark.createDataFrame([], shape)).count() == 0


# ---- names
def test_trie_finds_all_neighbours():
    rng = random.Random(5)
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 8))) for _ in range(300)})
    trie = Trie(words)
    for w in words[:60]:
        for most in (1, 2):
            assert sorted(trie.within(w, most)) == sorted((x, osa(w, x, most)) for x in words if osa(w, x, most) <= most)


def test_name_forms():
    assert organisation_form("Laboratories, Lekle-nogro (Inc.)") == organisation_form("Leklenogro Labs Incorporated")
    assert organisation_form("The Rovabroza Shipping Company").core == "rovabroza"
    assert organisation_form("化工淞衡裕辰").core == organisation_form("淞衡裕辰（北湾）化工股份有限公司").core
    assert organisation_form("泽芃铭翰醫藥").cls == "医药"
    assert person_form("Prof. Flokihuso, Ed S.").core == person_form("Edward S. Flokihuso").core == "edward flokihuso"
    assert person_form("Fehuduzo RM").weak and person_form("R. M. Fehuduzo").core == "r fehuduzo"
    assert person_form("") is None and organisation_form("") is None


NODES = "id string, name string, node_type string, ticker string, aliases array<string>, core string"


def test_variant_pairs(spark):
    data = [
        ("1", "Lekletovo Mining Corp.", "company", "ZAAA1", [], "x"), ("2", "Leklettovo Mng. Corporation", "institution", None, None, "x"), ("3", "Lekletovo Shipping Corp.", "company", "ZAAB1", [], "x"),
        ("4", "Mining, Lekletovo", "company", None, [""], "x"), ("5", "Robert M. Fehuduzo", "person", None, [], "x"), ("6", "Fehuduzo, Bob", "person", None, [], "x"),
        ("7", "Richard Fehuduzo", "person", None, [], "x"), ("8", "Fehuduzo RM", "person", None, ["Bob Fehuduzo"], "x"), ("9", "Other Brand", "company", " zaaa1.QX", [], "x"),
        ("10", None, "company", None, None, "x"), ("11", "  ", "person", "-", [None], "x"), ("12", "Lekletovo Mining Corp.", "sector", "ZAAA1", [], "x"), (None, "Lekletovo Mining Corp.", "company", None, None, "x"),
    ]
    got = rows(variant_pairs(spark.createDataFrame(data, NODES)))
    firm, person = ["1", "2", "4", "9"], ["5", "6", "8"]
    want = sorted((a, b) for g in (firm, person) for i, a in enumerate(g) for b in g[i + 1 :])
    assert got == want
    assert variant_pairs(spark.createDataFrame([], NODES)).count() == 0
    copies = [(f"k{i:02d}", "Tubanana Foods Inc.", "company", None, None, "x") for i in range(8)]
    assert len(rows(variant_pairs(spark.createDataFrame(copies, NODES), expand=5))) == 7


# ---- near duplicates
RECORDS = "id string, title string, body string, info_type string, no long, text string"
CHECKS = [("news", 0.75), ("other", 0.7), (None, 0.1)]


def brute_pairs(data):
    least = {k: t for k, t in CHECKS if k}
    docs = [(r[0], r[3], nd.stretches(nd.normal_text(r[1], r[2]))) for r in data if r[0] and r[3] in least]
    out = set()
    for i, (a, k, x) in enumerate(docs):
        for b, m, y in docs[:i]:
            if k == m and a != b and x and y and len(x & y) / len(x | y) >= least[k]:
                out.add((min(a, b), max(a, b)))
    return sorted(out)


def sample_records(n=240):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklm 链存款") for _ in range(6)) for _ in range(400)]
    data = []
    for i in range(n):
        if i % 4 and data:
            body = (rng.choice(data)[2] or "").split(" ")
            for _ in range(rng.randrange(0, 4)):
                body[rng.randrange(len(body))] = rng.choice(words)
            text = " ".join(body)
        else:
            text = " ".join(rng.choice(words) for _ in range(60))
        data.append((f"i{i:03d}", rng.choice(["Head", None]), text, rng.choice(["news", "other", "filing"]), 1, "clash"))
    data += [("e1", None, None, "news", 1, ""), ("e2", "", "", "news", 1, ""), ("e3", "ab", None, "news", 1, ""), ("e4", "ab", "", "news", 1, ""), (None, "Head", "x" * 50, "news", 1, ""), ("n", "t", "x" * 30, None, 1, "")]
    data += [("long1", "t", "abcdefg hij " * 8000, "news", 1, ""), ("long2", "T", "abcdefg-hij " * 8000, "news", 1, "")]
    return data


def test_near_duplicates_against_brute_force(spark):
    data = sample_records()
    checks = spark.createDataFrame(CHECKS, "info_type string, threshold double")
    df = spark.createDataFrame(data, RECORDS)
    want = brute_pairs(data)
    assert len(want) > 60 and rows(nd.similar_pairs(df, checks)) == want
    assert nd.similar_pairs(df.limit(0), checks).count() == 0
    groups = rows(nd.similar_groups(df, checks))
    assert len(groups) == sum(1 for r in data if r[0] and r[3] in ("news", "other"))


def test_crowded_regions_lose_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(nd, "REGION", 20)
    monkeypatch.setattr(nd, "BLOCK", 30)
    monkeypatch.setattr(nd, "CHECKED", 16)
    monkeypatch.setattr(nd, "SAMPLE", 1)
    data = [(f"i{i:03d}", None, "the same long text about retail deposits and freight contracts in every record " * 3 + f"{i:03d}", "news", 1, "") for i in range(90)]
    checks = spark.createDataFrame(CHECKS, "info_type string, threshold double")
    assert rows(nd.similar_pairs(spark.createDataFrame(data, RECORDS), checks)) == brute_pairs(data)


def test_crowd_of_variants_keeps_its_recall(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(120)]
    data = []
    for i in range(1500):
        words = list(base)
        for at in rng.sample(range(120), 7):
            words[at] = "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
        data.append((f"i{i:05d}", None, " ".join(words), "other", 1, ""))
    checks = spark.createDataFrame(CHECKS, "info_type string, threshold double")
    got = {tuple(r) for r in nd.similar_pairs(spark.createDataFrame(data, RECORDS), checks).collect()}
    sets = [nd.stretches(nd.normal_text(r[1], r[2])) for r in data[:300]]
    want = {(data[i][0], data[j][0]) for i in range(300) for j in range(i + 1, 300) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    own = {p for p in got if p[1] < "i00300"}
    assert len(want) > 10_000 and own <= want and len(own) >= 0.99 * len(want)


# ---- encoding
def test_encoding_equals_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(default_vocabulary())
    public.encode_special_tokens = True
    rng = random.Random(1)
    spans = [(32, 126), (0xA0, 0x2FFF), (0x3040, 0x9FFF), (0x1F300, 0x1F6FF)]
    texts = ["", " ", "a" * 5000, "漢" * 2000, "กั" * 300, "<|endoftext|> don't 'S's ''t", "\n\n x\t\ty  \n", "ab" * 40000]
    texts += ["".join(chr(rng.randint(*rng.choice(spans))) for _ in range(200)) for _ in range(60)]
    ids, count = Encoder(load_merges(default_vocabulary())).encode(texts)
    ends = np.cumsum(count)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, count)] == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    d = spark.createDataFrame([(1, ""), (2, None), (3, "net margin"), (3, "net margin")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = encode_documents(d).collect()
    want = public.encode("net margin", add_special_tokens=False).ids
    assert sorted((r.doc_id, r.ids) for r in got if r.ids is not None) == [(1, []), (3, want), (3, want)] and sum(r.ids is None for r in got) == 1
    assert rows(count_tokens(d.where("doc_id = 3"))) == [(3, len(want))] * 2 and encode_documents(d.limit(0)).count() == 0


# ---- packing
def naive(sizes, capacity):
    free, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), None)
        if at is None:
            at = len(free)
            free.append(capacity)
        free[at] -= sizes[i]
        bins[i] = at
    return bins


def test_first_fit_decreasing_against_naive():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 64, 200):
        sizes = np.array([rng.randrange(1, 101) for _ in range(n)], np.int64)
        assert first_fit_decreasing(sizes, 100).tolist() == naive(sizes.tolist(), 100)


def test_packing_is_whole_and_within_capacity(spark):
    sizes = [(i % 40, (i * 37) % 90) for i in range(300)] + [(99, 1234), (98, 200), (97, None), (96, 100)]
    items = spark.createDataFrame(sizes, "doc_id long, n_tokens int")
    windows = spark.createDataFrame([(1, 100), (2, 50), (3, None), (4, 0)], "window_id int, capacity_tokens int")
    got = pack_items(items, windows, 3).collect()
    for w, capacity in ((1, 100), (2, 50)):
        own = [r for r in got if r.window_id == w]
        fill = {}
        for r in own:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
        assert max(fill.values()) <= capacity and sum(fill.values()) == sum(n for _, n in sizes if n)
        cut = [r.doc_id for r in own if r.start_token > 0]
        assert set(cut) <= {d for d, n in sizes if n and n > capacity}
    assert {r.window_id for r in got} == {1, 2}
    docs = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(pack_documents(docs, windows).where("window_id = 1").select("doc_id", "n_tokens")) == [(1, 3)]
    assert pack_documents(docs.limit(0), windows).count() == 0 and pack_documents(docs, windows.limit(0)).count() == 0


# ---- sentences
@pytest.mark.parametrize(
    "language, units",
    [
        ("en", ["Mr. A. B. Low of Foo Corp. paid US$ 3.4m (see Fig. 2 and No. 61).", "“Why pay?” asked Dr. Roe, who left on Jan. 9.", "The U.S. arm ran short... and fell.", "He said: “Fine.”", "ok so it rose.", "Bar Ltd..", "End"]),
        ("de", ["Die Fa. Gut u. Boese meldet 3,5 Mio. Euro, d. h. z. B. mehr im 3. Quartal.", "„Nein“, sagte B. Kro am 9. Juni.", "Lt. Dr. Nu usw. bis morgen!"]),
        ("fr", ["« Non ! », a dit M. Dupont (cf. p. 28).", "L’art. 67 limite env. 41 tonnes, etc. selon lui.", "Et alors ?"]),
        ("es", ["¿Entregará la Sra. Ruiz la pág. 61?", "¡Sí, aprox. 47!", "Foo S.A. elevó el 2.º plan."]),
        ("ru", ["В 1 кв. завод продал зерно за 6,4 долл. США, т. е. мало (см. рис. 5).", "Да!"]),
        ("ar", ["أعلن د. Foo أن النحاس لن يكفي!", "هل تسلّم؟"]),
        ("hi", ["डॉ. Foo के अनुसार कमी।", "क्या?"]),
    ],
)
def test_sentences_with_blanks(language, units):
    text = " ".join(units)
    for lang in (language, None, language.upper() + "_x"):
        assert [text[a:b] for a, b in Segmenter().units(text, lang)] == units


@pytest.mark.parametrize(
    "language, units",
    [
        ("zh", ["缺口达到3.5%……甲为此多付了8.6亿元。", "“价格到9万我们就停手。”分析员乙说，丙不再追价．", "丁表示：“还能承受。”", "Foo Inc.维持原价！", "谁？"]),
        ("ja", ["「値上げはしない。」とFoo社の社長は述べた。", "増えた！", "買収するのか？"]),
    ],
)
def test_sentences_without_blanks(language, units):
    text = "".join(units)
    assert [text[a:b] for a, b in Segmenter().units(text, language)] == units


def test_layout_and_missing_marks(spark):
    text = "2.1 Heading\n\n- item one, 3.4\n• item Inc. two\r\n3. sell it. Now\n\nA wrapped\nline under plan.The next one.\n\nno end\n"
    assert [text[a:b] for a, b in Segmenter().units(text, "en")] == ["2.1 Heading", "- item one, 3.4", "• item Inc. two", "3. sell it. Now", "A wrapped\nline under plan.", "The next one.", "no end"]
    thai = "ราคา Foo 5.2 ล้านบาท เพราะขาดแคลน กำไรเพิ่ม"
    assert len(Segmenter().units(thai, "th")) == 3
    d = spark.createDataFrame([(1, "Aa bb. Cc dd.", "en"), (2, None, "en"), (3, "", None), (4, " \n", "zh"), (5, "x. " * 50000, None)], "doc_id long, text string, lang string").withColumn("start_pos", F.lit("clash"))
    got = split_sentences(d)
    assert rows(got.where("doc_id = 1")) == [(1, 0, 6), (1, 7, 13)] and {r.doc_id for r in got.select("doc_id").distinct().collect()} == {1, 5}
    assert split_sentences(d.limit(0)).count() == 0


def test_sentences_take_time_in_proportion():
    import time

    long = '"' + "foo.(bar " * 120_000
    began = time.perf_counter()
    for text in (long, "“" + "foo. bar” " * 60_000, "„" + "foo.“ bar " * 60_000, "กา" + " " * 500_000 + "x ไป"):
        Segmenter().units(text, "en")
    assert time.perf_counter() - began < 20


def test_packing_does_not_depend_on_file_splits(spark):
    items = spark.createDataFrame([(i % 50, 10 + i % 7) for i in range(200)], "doc_id long, n_tokens int")
    windows = spark.createDataFrame([(1, 64)], "window_id int, capacity_tokens int")
    assert rows(pack_items(items.repartition(7, "n_tokens"), windows, 3)) == rows(pack_items(items.coalesce(1), windows, 3))
