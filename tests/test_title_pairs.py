"""Titles by common character pairs, against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

from lodestrata.operators import dedup
from lodestrata.operators.pair_blocks import PairTexts
from lodestrata.session import shared_dir


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def grams(t):
    return {t} if len(t) < 2 else {t[i : i + 2] for i in range(len(t) - 1)}


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(4)
    out = []
    for _ in range(70):
        base = "".join(rng.choice("ab 铜c𝒳") for _ in range(rng.randrange(2, 16)))
        i = rng.randrange(len(base))
        out += [base, base[:i] + rng.choice("ab铜") + base[i:], base[i:] + base[:i], base.upper()]
    odd = [("z1", "news", None), ("z2", "news", ""), ("z3", None, out[0]), (None, "news", "only without id"), ("z4", "news", "a"), ("z5", "other", "a"), ("z6", "news", "A"), ("z7", "news", "b")]
    return [(f"r{rng.randrange(10**6):06d}", "news" if i % 4 else "other", t) for i, t in enumerate(out)] + odd


def brute_force(titles, least):
    first = {}
    for i, kind, t in sorted(x for x in titles if None not in x and x[2]):
        first.setdefault((kind, t.lower()), i)
    items = [(i, kind, grams(t)) for (kind, t), i in first.items()]
    for k, (i, kind, g) in enumerate(items):
        for j, other, h in items[:k]:
            if kind == other and len(g & h) / len(g | h) >= least:
                yield min(i, j), max(i, j), round(len(g & h) / len(g | h), 6)


def written(spark):
    return sorted(str(p) for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_title_pairs_in_blocks_write_no_candidates(spark, titles, least):
    records = spark.createDataFrame(titles, "id string, info_type string, title string")
    want, before = sorted(brute_force(titles, least)), written(spark)
    assert len(want) > 40 and rows(dedup.title_pairs(records, least)) == want
    assert rows(dedup.title_pairs(records, least, rows_per_block=23)) == want
    assert written(spark) == before
    assert dedup.title_pairs(records.limit(0)).count() == 0


def test_common_pairs_beyond_the_bits(titles):
    texts = sorted({t for _, _, t in titles if t and len(t) > 1})
    for sizes in ({}, {"columns": 4, "bits": 64}, {"bits": 1}):
        p = PairTexts(texts, **sizes)
        r, c = (x.ravel() for x in np.indices((len(texts), len(texts))))
        r, c = r[r != c], c[r != c]
        assert p.common(r, c).tolist() == [len(grams(texts[p.order[i]]) & grams(texts[p.order[j]])) for i, j in zip(r, c)]
        found = {pair for a, b in p.tiles(None, 1 / 3, tile=17) for pair in zip(*map(np.ndarray.tolist, p.near(a, b, 0.5)[:2]))}
        assert found == {(i, j) for i, j in zip(r.tolist(), c.tolist()) if i > j and len(grams(texts[p.order[i]]) & grams(texts[p.order[j]])) >= 0.5 * len(grams(texts[p.order[i]]) | grams(texts[p.order[j]]))}


@pytest.mark.parametrize("least, per_block", [(0.5, 16000), (0.7, 16000), (0.7, 23)])
def test_title_groups_write_no_pairs(spark, titles, least, per_block):
    # and a crowd: every two of these titles are a pair
    crowd = [(f"c{i:03d}", "crowd", f"the same long title of a report, number {i}") for i in range(300)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b, _ in brute_force(titles + crowd, least):
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted((x, root(x)) for x in up)
    records = spark.createDataFrame(titles + crowd, "id string, info_type string, title string")
    assert len({g for _, g in want}) > 5 and rows(dedup.title_groups(records, least, rows_per_block=per_block)) == want
    assert dedup.title_groups(records.limit(0)).count() == 0
    assert sum(r[1] == "c000" for r in want) == 300


def test_connected_components_never_reads_more_links_than_titles(spark, titles, tmp_path, monkeypatch):
    from lodestrata.queries import reference

    crowd = [(f"c{i:03d}", "crowd", f"the same long title of a report, number {i}") for i in range(300)]
    spark.createDataFrame(crowd, "id string, info_type string, title string").write.parquet(str(tmp_path / "raw_information.parquet"))
    seen = []
    monkeypatch.setattr(dedup, "minimum_labels", lambda ws, arcs: seen.append(arcs.count()) or arcs)
    reference.connected_components(spark, str(tmp_path))
    assert seen and 0 < seen[0] <= 2 * len(crowd)
