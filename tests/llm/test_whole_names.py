"""Cases that the name operators once left out."""

from __future__ import annotations

import random

from lodestrata.llm import name_variants as nv
from lodestrata.llm.name_forms import osa

NODES = "id string, name string, node_type string, ticker string, aliases array<string>"


def pairs(spark, names, **options):
    data = [(i, name, kind, ticker, None) for i, name, kind, ticker in names]
    return {tuple(r) for r in nv.variant_pairs(spark.createDataFrame(data, NODES), **options).collect()}


def test_weak_spellings_are_linked_by_edits(spark):
    firms = [("a1", "Torvamel AG", "company", None), ("a2", "Torvamle AG", "company", None), ("a3", "Torvamel", "company", None), ("b1", "Quistero Ltd", "company", None), ("b2", "Quistero GmbH", "company", None),
             ("b3", "Quistero", "company", None), ("c1", "Plendavo Mining Corp.", "company", None), ("c2", "Plendavvo", "company", None), ("d1", "Grenfolti Mining", "company", None), ("d2", "Grenfolti Shipping", "company", None), ("d3", "Grenfoltti", "company", None)]
    people = [("p1", "F. R. Flegufolkro", "person", None), ("p2", "F. R. Flegufolrko", "person", None), ("p3", "G. R. Flegufolkro", "person", None), ("q1", "Robert Masatawu", "person", None), ("q2", "R. Masatavu", "person", None)]
    assert pairs(spark, firms + people) == {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("c1", "c2"), ("p1", "p2"), ("q1", "q2")}


def test_all_names_one_edit_apart_share_a_shard():
    rng = random.Random(3)
    for part in ["kim", "bmw", "chen", "khan", "ng", "abc", "rossi"] + ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 10))) for _ in range(150)]:
        near = {part[:i] + c + part[i + 1 :] for i in range(len(part)) for c in "xa"} | {part[:i] + part[i + 1 :] for i in range(len(part))} | {part[:i] + c + part[i:] for i in range(len(part) + 1) for c in "xa"}
        near |= {part[:i] + part[i + 1] + part[i] + part[i + 2 :] for i in range(len(part) - 1)}
        for other in near - {part, ""}:
            assert osa(part, other, 1) == 1
            for kind, head in (("o", ""), ("p", "anna ")):
                assert set(nv.shards(kind, "", head + part)) & set(nv.shards(kind, "", head + other)), (part, other)


def test_repeated_rows_change_no_link(spark):
    firms = [("a1", "晨霁珩滢能源集团有限公司", "company", None), *[(f"a{i}", "辰霁珩滢能源集团有限公司", "company", None) for i in range(2, 6)], ("a6", "晨霁珩滢能源(集团)有限公司", "company", None), ("a7", "晨霁珩滢能源公司", "company", None)]
    firms += [("b1", "Quanderolin Mining Corp.", "company", None), *[(f"b{i}", "Quabderilin Mining Corp.", "company", None) for i in (2, 3)], ("b4", "Quanderolin Mining", "company", None)]
    want = {(x[0], y[0]) for x in firms for y in firms if x[0] < y[0] and x[0][0] == y[0][0]}
    assert pairs(spark, firms) == want


def test_large_entities_give_all_pairs(spark):
    firms = [(f"k{i:02d}", f"Tubanana Foods {'Inc.' if i % 2 else ''}{' ' * (i % 5 + 1)}", "company", "ZTUB1") for i in range(10)] + [(f"m{i:02d}", "Tubanana Foods Inc.", "company", "ZTUB1") for i in range(6)]
    ids = [f[0] for f in firms[:10]] + ["m00"]
    want = {(a, b) for a in ids for b in ids if a < b} | {("m00", f"m{i:02d}") for i in range(1, 6)}
    assert pairs(spark, firms, expand=4) == want
    members = nv.entity_members(spark.createDataFrame([(*f, None) for f in firms], NODES)).collect()
    assert {(r.node_id, r.entity_id, r.copy_of) for r in members} == {(f[0], "k00", "m00" if f[0][0] == "m" else f[0]) for f in firms}
