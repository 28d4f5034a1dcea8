"""Matching blocks of many names at once, against the library and brute force."""

import random
from difflib import SequenceMatcher

import numpy as np

from lodestrata.functions.matching_blocks import best_ratios
from lodestrata.operators import dedup


def ratio(x, y):
    return max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio())


def test_ratios_equal_the_library():
    rng = random.Random(1)
    short = ["".join(rng.choice("abc铜𝒳") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    long = ["".join(rng.choice("abcd") for _ in range(n)) for n in (150, 199, 200, 201, 260)]
    texts = short + long + [t[:-1] for t in long] + ["a\0b", "ab\0"]
    r, c = (x.ravel() for x in np.indices((len(texts), len(texts))))
    keep = [i for i, (x, y) in enumerate(zip(r, c)) if texts[x] or texts[y]]
    r, c = r[keep], c[keep]
    want = np.array([ratio(texts[x], texts[y]) for x, y in zip(r, c)])
    assert (best_ratios(texts, r, c, 0.0, at_once=999) == want).all()
    high = best_ratios(texts, r, c, 0.6)
    assert (want >= 0.6).sum() > 80 and ((high >= 0.6) == (want >= 0.6)).all() and (high == want)[want >= 0.6].all()


def test_sequence_ratio_pairs_in_blocks(spark):
    rng = random.Random(5)
    names = [f"{''.join(rng.choice('aeioubr') for _ in range(7))} {rng.choice(['copper', 'cocoa'])} forward" for _ in range(150)] + ["a", "b", "鸿珩矿业", "鸿珩虹矿业", "ab" * 120, "ab" * 120 + "c"]
    kinds = ["x", "y"]
    data = [(f"n{rng.randrange(10**6):06d}", kinds[i % 2 if i < 150 else 0], n) for i, n in enumerate(names)]
    nodes = spark.createDataFrame(data + [(None, "x", "abc"), ("z1", None, "abc"), ("z2", "x", None)], "id string, node_type string, name string")
    want = sorted((min(i, j), max(i, j), round(ratio(x, y), 6)) for k, (i, s, x) in enumerate(data) for j, t, y in data[:k] if s == t and len(x) > 1 < len(y) and ratio(x, y) >= 0.8)
    assert len(want) > 100
    for per_block in (8000, 11):
        assert sorted(map(tuple, dedup.sequence_ratio_pairs(nodes, rows_per_block=per_block).collect())) == want


def test_sequence_ratio_pairs_join_no_pieces(spark):
    nodes = spark.createDataFrame([("a", "x", "freight"), ("b", "x", "freihgt")], "id string, node_type string, name string")
    plan = dedup.sequence_ratio_pairs(nodes)._jdf.queryExecution().optimizedPlan().toString()
    # names meet in blocks: the only join is that of names and the sizes of their kinds, none has the places of pieces as rows
    assert plan.count("Join") == 1 and "Generate explode(sequence(0, (parts" in plan and plan.count("Generate") == 1
