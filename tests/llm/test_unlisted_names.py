"""Names none of whose words is on any list of the operator."""

from __future__ import annotations

import random

import pytest

from lodestrata.llm import name_variants as nv
from lodestrata.llm.name_forms import SIMPLE, orders, organisation_form, osa, simple_signs

NODES = "id string, name string, node_type string, ticker string, aliases array<string>"
TRADES = ["Motors", "Steel", "Media", "Energy", "Paper", "Telecom", "Railways", "Cement"]


def pairs(spark, rows):
    return {tuple(r) for r in nv.variant_pairs(spark.createDataFrame([(i, n, k, None, None) for i, n, k in rows], NODES)).collect()}


def word(rng, syllables):
    return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(syllables))


def edited(rng, name):
    i = rng.randrange(1, len(name) - 2)
    kind = rng.randrange(4)
    return name[:i] + (rng.choice("aeioubdgk") + name[i:] if kind == 0 else name[i + 1 :] if kind == 1 else rng.choice("xjwq") + name[i + 1 :] if kind == 2 else name[i + 1] + name[i] + name[i + 2 :])


def test_typos_and_orders_of_unlisted_names(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for n in range(150):
        words = [word(rng, rng.randrange(3, 5)).title(), word(rng, 3).title()][: 1 + n % 2] + [TRADES[n % 8]]
        typed = [" ".join(words) + rng.choice([" AG", "", " Inc."])]
        for _ in range(1 + n % 2):
            if n % 3 == 0:
                typed.append(" ".join(rng.sample(words, len(words))))
            else:
                typed.append(" ".join([edited(rng, words[0]), *words[1:]]))
        ids = [f"o{n:03d}{j}" for j in range(len(typed))]
        rows += [(i, t, "company") for i, t in zip(ids, typed)]
        want |= {(a, b) for a in ids for b in ids if a < b}
    for n in range(60):
        first, middle, last = word(rng, 3).title(), word(rng, 2).title(), word(rng, 4).title()
        typed = [f"{first} {middle} {last}", [f"{last} {first} {middle}", f"{first} {middle} {edited(rng, last)}"][n % 2]]
        rows += [(f"p{n:03d}{j}", t, "person") for j, t in enumerate(typed)]
        want.add((f"p{n:03d}0", f"p{n:03d}1"))
    got = pairs(spark, rows)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.98 * len(got)


@pytest.mark.parametrize(
    "left, right, kind",
    [
        ("World Bank", "Wolrd Bank", "institution"), ("Microsfot Corporation", "Microsoft Corporation", "company"), ("Siemens AG", "Siemnes AG", "company"), ("Goldman Sachs", "Goldmann Sachs", "company"),
        ("Alpha Beta Mining", "Beta Alpha Mining", "company"), ("Maria Gonzalez Lopez", "Lopez Gonzalez Maria", "person"), ("Deutsche Börse Aktiengesellschaft", "Deutsche Boerse AG", "company"), ("華為技術", "华为技术", "company"),
        ("Hendricksen Mining", "Kendricksem Mining", "company"),
    ],
)
def test_ordinary_names(left, right, kind, spark, ordinary):
    a, b = (next(i for i, n, _ in ordinary[0] if n == x) for x in (left, right))
    assert (min(a, b), max(a, b)) in ordinary[1]


@pytest.fixture(scope="module")
def ordinary(spark):
    names = "World Bank|Wolrd Bank|Microsoft Corporation|Microsfot Corporation|Siemens AG|Siemnes AG|Goldman Sachs|Goldmann Sachs|Alpha Beta Mining|Beta Alpha Mining|Deutsche Börse Aktiengesellschaft|Deutsche Boerse AG|華為技術|华为技术|Hendricksen Mining|Kendricksem Mining|Toyota Motors|Toyota Steel".split("|")
    rows = [(f"c{i:02d}", n, "company") for i, n in enumerate(names)] + [("p1", "Maria Gonzalez Lopez", "person"), ("p2", "Lopez Gonzalez Maria", "person")]
    got = pairs(spark, rows)
    assert len(got) == 9
    return rows, got


def test_two_edits_share_a_shard():
    rng = random.Random(5)
    for _ in range(300):
        name = word(rng, rng.randrange(4, 8))
        other = edited(rng, edited(rng, "q" + name + "q")[1:-1] + "q")[:-1] if rng.random() < 0.5 else edited(rng, edited(rng, name))
        if other != name and osa(name, other, 2) <= 2 and min(len(name), len(other)) >= nv.LONG:
            assert set(nv.shards("o", "", name)) & set(nv.shards("o", "", other)), (name, other)
            assert set(nv.shards("p", "", "anna " + name)) & set(nv.shards("p", "", "anna " + other)), (name, other)


def test_orders_and_simple_signs(spark):
    assert orders(["a"]) == () and orders(["a", "b"]) == ("ba",) and len(orders(["a", "b", "c"])) == 5 and "edcba" in orders(list("abcde"))
    signs = simple_signs(spark)
    assert organisation_form("東京電力", signs).core == organisation_form("东京电力", signs).core and len(signs) >= len(SIMPLE)
