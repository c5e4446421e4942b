"""Walks over simple paths, outgoing links and strong components on random graphs, against brute force."""

import random

import pytest

from lorehouse.operators import graph as G


def random_edges(seed, n, m):
    rng = random.Random(seed)
    e = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
    return sorted(e | {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("loop", "loop"), ("x", "y"), ("y", "x")})


def reached(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    out = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = seen
    return out


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 60, 70), (2, 30, 60)])
def test_strong_components(spark, seed, n, m):
    edges = random_edges(seed, n, m)
    reach = reached(edges)
    want = {a: max(b for b in r if a in reach[b]) for a, r in reach.items() if a in r}
    df = spark.createDataFrame([(a, b, "t") for a, b in edges], "src string, dst string, lt string")
    got = G.strong_components(df).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    walked = spark.createDataFrame([("one", "a"), ("one", "d"), ("two", "d"), ("two", "e"), ("three", "loop")], "seed string, node string")
    assert {r["seed"]: r["cycles"] for r in G.cycle_flags(walked, df).collect()} == {"one": True, "two": False, "three": True}


def test_no_cycles(spark):
    df = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t")], "src string, dst string, lt string")
    assert G.strong_components(df).count() == 0 and G.strong_components(df.limit(0)).count() == 0


def test_walks_agree(spark):
    edges = random_edges(3, 12, 30)
    df = spark.createDataFrame([(a, b, t) for a, b in edges for t in ("s", "t")], "src string, dst string, lt string")
    seeds = spark.createDataFrame([("a",), ("n1",), ("n1",), ("alone",)], "node string")
    want = set()

    def go(seed, path):
        want.add((seed, path[-1], len(path) - 1))
        if len(path) <= 4:
            for a, b in edges:
                if a == path[-1] and b not in path:
                    go(seed, [*path, b])

    for s in ("a", "n1", "alone"):
        go(s, [s])
    walked = G.walks(df, seeds, 4)
    assert sorted(map(tuple, walked.collect())) == sorted(want) == sorted(map(tuple, G.walks_recursive(df, seeds, 4).collect()))
    lists = {r["node"]: [tuple(x) for x in r["links"]] for r in G.with_outgoing(walked.select("node").distinct(), df).collect()}
    assert all(lists[n] == sorted((b, t) for a, b in edges if a == n for t in ("s", "t")) for n in lists) and lists["alone"] == []
