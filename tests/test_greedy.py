"""Greedy choices by rounds against one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from lorehouse.operators import fusion, greedy


def test_dropped_equals_the_sequential_choice(spark):
    rng = random.Random(2)
    pairs = {(b, a) for _ in range(900) for a, b in [sorted(rng.sample(range(400), 2))]}
    pairs |= {(1_000 + k + 1, 1_000 + k) for k in range(6)}  # a chain: every second goes
    kept, gone = set(), set()
    for n in sorted({x for p in pairs for x in p}):
        (gone if any((n, m) in pairs for m in kept) else kept).add(n)
    got = {r["node"] for r in greedy.dropped(spark.createDataFrame(sorted(pairs), "node long, before long")).collect()}
    assert got == gone and {1_001, 1_003, 1_005} <= gone


def one_by_one(texts, least):
    kept = []
    for k, t in texts:
        w = set(t.lower().split())
        if not any(len(w & u) > least * len(w | u) for _, u in kept if w or u):
            kept.append((k, w))
    return {k for k, _ in kept}


@pytest.mark.parametrize("least", [0.85, 0.5])
def test_similar_results_equal_one_by_one(spark, least):
    rng = random.Random(6)
    words = [f"W{k}" for k in range(14)]
    rows = []
    for q in range(6):
        base = rng.sample(words, 9)
        for c in range(40):
            w = [x for x in base if rng.random() < 0.9] + rng.sample(words, rng.randrange(3))
            rows.append((q, c, float(rng.randrange(9)), " ".join(w) if c % 17 else ""))
    got = fusion.greedy_similar(spark.createDataFrame(rows, "query_id long, chunk_id long, score double, text string"), least).collect()
    for q in range(6):
        best = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        assert {r["chunk_id"] for r in got if r["query_id"] == q} == one_by_one([(r[1], r[3]) for r in best], least)


@pytest.mark.parametrize(("block", "tile"), [(5, 16), (2_048, 4_096)])
def test_leaders_of_hot_groups(spark, monkeypatch, block, tile):
    """A third of the rows share one vector, the rest lies around a few."""
    monkeypatch.setattr(greedy, "TILE", tile)
    rng = random.Random(block)
    rows = [(k, "hot" if k % 5 else "other", rng.randrange(10_000) * 1_000 + k, [1.0, 0.5, 0.2] if k % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for k in range(240)]
    got = {r["id"]: r["leader"] for r in greedy.leaders(spark.createDataFrame(rows, "id long, key string, o long, v array<double>"), 0.9, block).collect()}
    want, lead = {}, {}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for k, key, _, v in sorted(rows, key=lambda r: r[2]):
        mine = lead.setdefault(key, [])
        want[k] = next((i for i, u in mine if cos(u, v) >= 0.9 - 1e-12), k)
        if want[k] == k:
            mine.append((k, v))
    assert got == want


def test_truth_comes_back(spark):
    before = [(1, 1, 10, 3.0, "timeline"), (1, 1, 11, 2.0, "timeline"), (1, 1, 12, 1.0, "compiled_truth"), (1, 1, 13, 0.5, "compiled_truth"), (1, 2, 20, 5.0, "timeline"), (1, 3, 30, 1.0, "compiled_truth"), (1, 3, 31, 0.9, "timeline")]
    df = spark.createDataFrame(before, "query_id long, page_id long, chunk_id long, score double, chunk_source string")
    got = fusion.with_truth(df.where(F.col("chunk_id").isin(10, 11, 20, 30, 31)), df).collect()
    assert sorted((r["chunk_id"], r["score"]) for r in got) == [(10, 3.0), (12, 1.0), (20, 5.0), (30, 1.0), (31, 0.9)]
