"""Operators 11 to 13 against brute force, and on odd rows; their SQL is among test_llm.test_sql."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorehouse.llm import divergence, registry, resample, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, arc int, nth long, shard int, n long, total long, term string, score long, bucket int, rank int"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (None, "no id here, " * 30, "en", None), (3, "same\ntext " * 40, "de", "a"), (3, "same\ntext " * 40, "de", "a"), (3, "another text", "de", "b"), (4, "x" * 30_000, None, "b"),
    (5, "Word word " * 20_000, "en", "b"), (6, "\n\n\n", "en", "a"), (7, "﷽ \x00 \x1c \x85 É 漢字 😀 <|endoftext|> K ſ a1B2 x_y " * 9, "fr", "c"), (None, None, "es", "c"), *[(10 + k, "shared terms are here " * 8 + f"own{k}", "en", "ab"[k % 2]) for k in range(24)],
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "t", 7, 8, 9) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_names():
    assert [k.split("_")[0] for k in registry.QUERIES] == [f"op{n}" for n in range(1, 14)]


# --- 11 ------------------------------------------------------------------------------


def resampled(docs, target, percent=5, least=20):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    s, t = [0] * 10_000, [0] * 10_000
    every = [features(text) for _, text in docs]
    for _, buckets in every:
        for b in buckets:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + 10000.0) / ((s[b] + 1.0) * (sum(t) + 10000.0)))) for b in range(10_000)]
    out = []
    for (doc_id, _), (n, buckets) in zip(docs, every, strict=True):
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resampling_equals_brute_force(spark, odd, percent):
    target = ["shared terms are here own3 words", None, "", "word word"]
    got = resample.resample(odd, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled([r[:2] for r in ODD], target, percent)


def test_resampling_of_nothing(spark, odd, empty):
    one = spark.createDataFrame([("a b c",)], "text string")
    assert resample.resample(empty, one).count() == 0
    assert resample.resample(odd.where("doc_id = 2"), one).collect()[0]["weight"] == 0
    assert resample.resample(odd, one.limit(0)).count() == len(ODD)


def test_runs_are_those_of_single_texts(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "Bc", " ", "\n", "é", "漢字", "-", "x" * 70, "9"]) for _ in range(rng.randrange(60))).encode() for _ in range(80)]
    together = [[] for _ in texts]
    for doc, crc in resample.runs(texts, 4):
        for d, c in zip(doc, crc, strict=True):
            together[d].append(int(c))
    for t, got in zip(texts, together, strict=True):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", t.lower())
        assert got == [zlib.crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3, 4) for i in range(len(words) - n + 1)]
    monkeypatch.setattr(resample, "JOIN_BYTES", 100)
    parts = list(resample.joins(pd.Series([t.decode() for t in texts])))
    assert len(parts) > 5 and [b for _, p in parts for b in p] == texts and [f for f, _ in parts] == list(np.cumsum([0] + [len(p) for _, p in parts])[:-1])


# --- 12 ------------------------------------------------------------------------------


def placed(ids, shards, slack=0.0, vnodes=sharding.VNODES):
    """One key after the other goes round the ring."""
    places = sorted((int(hashlib.md5(f"shard:{s}:{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(vnodes))
    digest = {i: hashlib.md5(f"key:{i}".encode()).hexdigest() for i in ids}
    caps = [int((len(ids) + shards - 1 - s) // shards * (1 + slack)) for s in range(shards)]
    load, out = [0] * shards, {}
    for i in sorted(ids, key=lambda i: int(digest[i][8:23], 16)):
        at = next((k for k, (p, _) in enumerate(places) if p >= int(digest[i][:8], 16)), 0)
        while load[places[at][1]] >= caps[places[at][1]]:
            at = (at + 1) % len(places)
        out[i] = (places[at][1], load[places[at][1]])
        load[places[at][1]] += 1
    return out


@pytest.mark.parametrize(("n", "shards", "slack"), [(3_001, 8, 0.0), (3_001, 7, 0.05), (5, 8, 0.0), (640, 1, 0.0)])
def test_shards_equal_one_key_after_the_other(spark, n, shards, slack):
    ids = [7 * k + 1 for k in range(n)]
    got = sharding.shard(spark.createDataFrame([(i, "é") for i in ids], "doc_id long, text string"), shards, slack=slack).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == placed(ids, shards, slack)
    assert {(r["size"], r["text_crc32"], r["law"]) for r in got} == {(3, zlib.crc32("é".encode()), "bounded" if slack else "rows")}


def test_few_move_when_a_shard_is_added():
    ids = range(4_000)
    eight, nine = placed(ids, 8), placed(ids, 9)
    assert sum(eight[i][0] != nine[i][0] for i in ids) < 0.2 * len(ids)


@pytest.mark.parametrize("rows", [ODD, [(5, "same")] * 3_000 + [(k, "other") for k in range(1_000)]])
def test_odd_shards(spark, rows):
    docs = spark.createDataFrame([(*r[:2], 1, 2, 3) for r in rows], "doc_id long, text string, arc int, nth long, shard int")
    got = sharding.shard(docs).toPandas()
    sizes = got.groupby("shard").size().reindex(range(8), fill_value=0)
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got["grown_shard"].isna().all()
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows)


def test_no_shards_of_nothing(empty):
    assert sharding.shard(empty).count() == 0


# --- 13 ------------------------------------------------------------------------------


def audited(rows, min_docs, top):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(l or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))) for _, t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        terms = {t for d in own for t in d[2]}
        kept = sorted((t for t in terms if sum(t in d[2] for d in own) >= min_docs), key=lambda t: t.encode())
        count = lambda ds: [sum(d[2].count(t) for d in ds) for t in kept]
        shares = lambda n: [1 + 10**9 * (c + 2) // (sum(n) + 2 * len(kept)) for c in n]
        q = shares(count(own))
        by = {s: count([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        p = {s: shares(n) for s, n in by.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in by if o != s]
            words = [(f(a, b), t) for a, b, t, n in zip(p[s], q, kept, by[s], strict=True) if n and a > b]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top", "cells"), [(10, 10, divergence.CELLS), (2, 3, 40), (1, 100, 7)])
def test_audit_equals_brute_force(spark, odd, monkeypatch, min_docs, top, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence.pair_sums, "__defaults__", (cells,))
    got = divergence.audit(odd, min_docs, top)
    assert sorted(map(tuple, got.collect())) == audited(ODD, min_docs, top)


def test_audit_of_many_groups(spark):
    rng = random.Random(5)
    words = ["é", "Éa", "b", "ba", "漢", "z"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(words, [1 / (1 + j) for j in range(len(words))], k=rng.randrange(120))), rng.choice(["x", "y", None]), f"s{rng.randrange(7)}") for k in range(400)]
    got = divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(9), 5, 10)
    assert sorted(map(tuple, got.collect())) == audited(rows, 5, 10)


def test_audit_of_nothing(empty):
    assert divergence.audit(empty).count() == 0


def test_skyband_equals_all_comparisons():
    rng = random.Random(9)
    for k in (1, 3, 10):
        pts = pd.DataFrame({"n": [rng.randrange(30) for _ in range(900)], "total": [rng.randrange(40) for _ in range(900)], "term": rng.sample([f"{a}{b}" for a in "abcdeé漢" for b in range(200)], 900)})
        got = set(divergence.skyband(pts, k)["term"])
        rows = list(pts.itertuples(index=False))
        assert got == {x.term for x in rows if sum(y.n >= x.n and y.total <= x.total and y.term < x.term for y in rows) < k}


def test_shares_are_exact():
    n, total = np.array([[0], [1], [10**9], [7 * 10**12], [2**47 - 5]]), np.array([2**47 + 12_345])
    assert divergence._shares(n, total).ravel().tolist() == [1 + 10**9 * (int(x) + 2) // int(total[0]) for x in n.ravel()]


def test_divergence_columns_are_exact(spark):
    rows = [(0, 3, 2), (10**12, 10**14, 999), (4, 4, 5)]
    df = spark.createDataFrame(rows, "n long, total long, v long").select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows]
