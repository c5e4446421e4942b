"""Mentioned dates, the date rule of pairs, firing after a cooldown, and the rule of triggers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lorehouse.functions import dates as D
from lorehouse.operators import joins as J
from lorehouse.operators import sequences as W

day = datetime.date


@pytest.mark.parametrize(
    ("text", "days"),
    [
        ("on 2024-03-05, then 2024/4/6 and 2024/04/06", [day(2024, 3, 5), day(2024, 1, 1), day(2024, 4, 6)]),
        ("Jan 15, 2024; February 3 2023; Sept. 2021; Q3 2022; 1999", [day(2024, 1, 15), day(2023, 2, 3), day(2021, 9, 1), day(2022, 1, 1), day(1999, 1, 1)]),
        ("2024-13-01 or 2024-02-30", [day(2025, 1, 1), day(2024, 3, 1)]),
        ("1899-01-01, 2101, 12345, x2020, no date", []),
        ("", []),
        (None, []),
    ],
)
def test_mentioned(spark, text, days):
    assert spark.createDataFrame([(text,)], "t string").select(D.mentioned(F.col("t"))).first()[0] == days


PAIRS = [
    ("2020-01-01 and, elsewhere,\n\n2024-05-01", "2020-01-02", None, None, "both_explicit_separated"),  # the latest of either side
    ("seen 2024-01-01", "seen 2024-01-31", None, None, "overlapping_or_close"),
    ("seen 2024-01-01", "seen 2024-02-01", None, None, "both_explicit_separated"),
    ("In Jan 2024 so, in Mar 2024 not so", "2020", None, None, "same_paragraph_dual_date"),
    ("2020", "In Jan 2024 so, in Mar 2024 not so", "2020-01-01", "2024-01-01", "same_paragraph_dual_date"),
    ("2020 and 2020-01-01", "2024", None, None, "both_explicit_separated"),  # one day, twice
    ("2020", "2024", "2020-01-01", "2024-01-01", "both_have_effective_date"),
    ("2020", "2024", "2020-01-01", None, "both_explicit_separated"),
    ("2020", "undated", None, None, "one_or_both_missing_dates"),
    (None, None, None, None, "one_or_both_missing_dates"),
]


def test_date_rule(spark):
    got = J.date_mismatch(spark.createDataFrame([(k, *p[:4]) for k, p in enumerate(PAIRS)], "k int, a_text string, b_text string, a_effective string, b_effective string")).collect()
    assert {r["k"]: r["reason"] for r in got} == {k: p[4] for k, p in enumerate(PAIRS)}
    assert all(r["skip"] == (r["reason"] == "both_explicit_separated") for r in got)
    plain = J.date_mismatch(spark.createDataFrame([("2020", "2024")], "a_text string, b_text string")).first()
    assert plain["skip"]


def fired(times, days):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] > datetime.timedelta(days=days):
            out.append(t)
    return out


def test_cooldown_counts_what_fired(spark):
    begin = datetime.datetime(2024, 1, 1)
    rows = [("a", begin + datetime.timedelta(days=d)) for d in (0, 10, 20, 30)] + [("edge", begin + datetime.timedelta(days=d)) for d in (0, 14, 15, 28, 29)] + [("b", begin)] * 3 + [("c", None)]
    got = W.cooldown(spark.createDataFrame(rows, "key string, ts timestamp").distinct()).collect()
    assert sorted((r["ts"] - begin).days for r in got if r["key"] == "a") == [0, 20]
    assert sorted((r["ts"] - begin).days for r in got if r["key"] == "edge") == [0, 15]
    assert len([r for r in got if r["key"] == "b"]) == 1 and not [r for r in got if r["key"] == "c"]


@pytest.mark.parametrize("days", [1, 14])
def test_cooldown_equals_one_after_the_other(spark, days):
    rng = random.Random(days)
    begin = datetime.datetime(2024, 1, 1)
    rows = [(k, rng.choice(["hot", "hot", "x", "y"]), begin + datetime.timedelta(hours=rng.choice([rng.randrange(4_000), rng.randrange(60)]))) for k in range(900)]
    got = W.cooldown(spark.createDataFrame(rows, "id long, key string, ts timestamp"), days, tie="id").collect()
    for key in ("hot", "x", "y"):
        want = fired([t for _, k, t in rows if k == key], days)
        assert sorted((r["ts"], r["id"]) for r in got if r["key"] == key) == [(t, min(i for i, k, u in rows if k == key and u == t)) for t in want]


def test_trigger_rule(spark):
    takes = [(1, "a", 0.9, "companies/x", "a"), (2, "a", 0.7, "companies/x", "a"), (3, "b", 0.9, "companies/x", "a"), (4, "a", 0.9, "concepts/x", "a"), (5, "a", 0.9, "wiki/people/x", "a"), (6, "c", 0.9, "companies/x", "c"), (7, "a", 0.8, "notes/AI/x", "a")]
    got = W.nudge_rule(spark.createDataFrame(takes, "take_id int, holder string, weight double, page_slug string, asked string"), spark.createDataFrame([("a", ["too fast Hiring", "ai hype"])], "holder string, tags array<string>"))
    assert {r["take_id"]: r["reason"] or r["tag"] for r in got.collect()} == {
        1: "too fast Hiring", 2: "below_conviction_threshold", 3: "wrong_holder", 4: "no_matching_bias_tag", 5: "no_matching_bias_tag", 6: "no_profile", 7: "ai hype"
    }
