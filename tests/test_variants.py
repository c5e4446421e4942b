"""Rules that complete ranking, replay, sampling and roll-ups, on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from lorehouse.functions import columns as C
from lorehouse.operators import aggregates as A
from lorehouse.operators import evaluation as E
from lorehouse.operators import fusion as R
from lorehouse.operators import joins as J
from lorehouse.operators import sequences as W
from lorehouse.operators import text as T


@pytest.mark.parametrize(
    ("slug", "to"),
    [
        ("your-agent/chat/2026-05-20-foo", "your-agent/chat/2026-05-20-foo"), ("media/chat/2026-05-20-foo/chunk-001", "media/chat/2026-05-20-foo"), ("daily/2026-05-20/entry-1", "daily/2026-05-20"),
        ("a/sessions", "a/sessions"), ("chat/x/y", "chat/x"), ("chatter/x/y", None), ("2026-05-20", None), ("a/b/c", None), (None, None),
    ],
)
def test_session_prefix(spark, slug, to):
    assert spark.createDataFrame([(slug,)], "s string").select(C.session_prefix(F.col("s"))).first()[0] == to


def test_graph_signals_of_the_first_only(spark):
    h = spark.createDataFrame([(1, p, 10.0 - p) for p in range(1, 6)], "query_id int, page_id int, score double")
    adj = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 2, 2), (1, 3, 2, 0)], "query_id int, page_id int, n_in int, n_cross int")
    got = {r["page_id"]: round(r["score"], 6) for r in R.graph_signals(h, adj, F.when(F.col("page_id") != 2, F.lit("s")), 3).collect()}
    assert got == {1: 9.0, 2: round(8 * 1.05 * 1.1, 6), 3: round(7 * 1.05 * 0.95, 6), 4: 6.0, 5: 5.0}


def test_exact_matches_by_intent(spark):
    rows = [(1, "people/garry-tan", "x"), (2, "x", " Garry Tan"), (3, "garry-tan", "x"), (4, "people/not-garry-tan", "x"), (5, None, None)]
    h = spark.createDataFrame([(*r, 1.0) for r in rows], "page_id int, slug string, title string, score double")
    up = lambda intent, q="garry  tan ".replace("  ", " "): {r["page_id"] for r in R.exact_match_boost(h, F.lit(q), F.lit(intent)).where("score > 1").collect()}
    assert up("entity") == up("event") == {1, 2, 3} and up("general") == set() == up("entity", " ")
    assert R.exact_match_boost(h, F.lit("Garry Tan"), F.lit("event")).agg(F.max("score")).first()[0] == 1.1


def test_chunks_with_takes(spark):
    hits = spark.createDataFrame([(1, 5, 50, 0.5), (1, 6, 60, 0.25)], "query_id int, page_id int, chunk_id int, score double")
    takes = spark.createDataFrame([(7, 5, True), (8, 5, False), (9, 1, True)], "take_id int, page_id int, active boolean")
    assert [tuple(r) for r in J.chunk_take_pairs(hits, takes).collect()] == [(1, 50, 7, 1.5)]


def test_replay(spark):
    old = spark.createDataFrame([(1, [1, 2], 10.0), (2, [], 10.0), (3, [1], 10.0), (4, [1], 10.0), (5, [5], 10.0)], "query_id int, ids array<int>, latency_ms double")
    new = spark.createDataFrame([(1, [2, 3], 21.0, None), (2, [], 20.0, None), (3, [1], 5.0, "no"), (5, [], 1.0, None)], "query_id int, ids array<int>, latency_ms double, error string")
    rows = E.replay_rows(old, new)
    got = {r["query_id"]: (r["jaccard"], r["top1"], r["latency_delta"], r["errored"], r["over_2x"]) for r in rows.collect()}
    assert got == {1: (0.333333, False, 11.0, False, True), 2: (1.0, True, 10.0, False, False), 3: (None, None, None, True, None), 4: (None, None, None, True, None), 5: (0.0, False, -9.0, False, False)}
    assert tuple(E.replay_summary(rows).first()) == (5, 3, 2, 0.444444, 0.333333, 4.0, 1)


def test_samples(spark):
    p = spark.range(500).select(F.col("id").alias("page_id"))
    draw = lambda df, seed: {r[0] for r in W.corpus_sample(df, 20, seed).collect()}
    assert draw(p, 1) == draw(p.repartition(7), 1) != draw(p, 2) and len(draw(p, 1)) == 20
    day = datetime.date
    got = spark.createDataFrame([(1, None), (2, day(2023, 10, 1)), (3, day(2024, 1, 1))], "k int, d date").select("k", C.stale_score(F.col("d"), F.lit(day(2024, 2, 1)), 90).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {1: 2, 2: 1, 3: 0}


@pytest.mark.parametrize("block", [4_096, 1])
def test_far_set(spark, monkeypatch, block):
    monkeypatch.setattr(W, "CLOSE_BLOCK", block)
    c = spark.createDataFrame([(1, "a", [1.0, 0.0], 1), (2, "b", [0.0, 1.0], 2), (3, "b", [-1.0, 0.0], 1), (4, "c", None, 1), (5, "d", [0.0, -1.0], 1)], "id long, stratum string, v array<double>, rank int")
    close = spark.createDataFrame([(1, "a", [1.0, 0.0]), (9, "a", [0.0, -2.0])], "id long, stratum string, v array<double>")
    assert {r["id"]: r["distance"] for r in W.far_set(c, close).collect()} == {3: 0.5, 4: 0.5, 5: 0.0}
    assert W.far_set(c, close, 2, 1).count() == 2 and W.far_set(c, close.limit(0)).agg(F.min("distance")).first()[0] == 0.5


def test_windows_and_totals(spark):
    q = T.date_windows(spark, 2023, 2024).orderBy("start").collect()
    assert len(q) == 8 and tuple(q[3]) == ("Q4 2023", datetime.date(2023, 10, 1), datetime.date(2024, 1, 1))
    m = T.date_windows(spark, 2024, 2024, 1).orderBy("start").collect()
    assert [r["label"] for r in m][::11] == ["2024-01", "2024-12"] and m[-1]["end"] == datetime.date(2025, 1, 1)
    with pytest.raises(ValueError):
        T.date_windows(spark, 2024, 2023)
    rows = spark.createDataFrame([("$1,200.50",), ("3",), (None,), ("n/a",), ("12 apples",)], "a string")
    assert T.totals(rows, ["a"]).first()["a"] == 1215.5


def test_salience_by_touch(spark):
    day = datetime.date
    p = spark.createDataFrame([(1, "daily/x", day(2024, 1, 1), day(2024, 1, 30), False), (2, "daily/y", day(2024, 1, 1), None, False)], "page_id int, slug string, updated_on date, touched_on date, deleted boolean")
    w = spark.createDataFrame([(1, 0.5), (2, 0.5)], "page_id int, emotional_weight double")
    t = spark.createDataFrame([], "page_id int, take_id int, active boolean")
    got = A.recent_salience(p, w, t, F.lit(day(2024, 1, 31)), rules={"daily/": (10, 2.0)}).collect()
    assert [(r["page_id"], r["salience"]) for r in got] == [(1, 3.0)]
