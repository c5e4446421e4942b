"""Approximate nearest vectors: recall, cost, exact scores, and answers found again at the default nearness."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorehouse.operators import approximate as A
from lorehouse.operators import joins as J


@pytest.fixture(scope="module")
def clustered(spark):
    """Sixty groups of near vectors."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    rows = [(k, (centres[k % 60] + 0.25 * rng.normal(size=32)).tolist()) for k in range(3_000)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def recall(got, true):
    g, t = ({(r["query_id"], r["id"]) for r in df.collect()} for df in (got, true))
    return len(g & t) / len(t)


def test_recall_and_cost(spark, clustered):
    q = clustered.where("id % 30 = 0").select(F.col("id").alias("query_id"), "v")
    index = A.build_index(clustered, bits=8, tables=8)
    got = A.search_index(q, index, 20, bits=8, tables=8, probes=4)
    true = J.vector_knn(q, clustered, 20)
    assert recall(got, true) >= 0.95
    assert A.candidate_share(q, index, bits=8, tables=8, probes=4) < 0.35
    sims = {(r["query_id"], r["id"]): r["sim"] for r in true.collect()}
    assert all(abs(sims[k] - r["sim"]) < 1e-6 for r in got.collect() if (k := (r["query_id"], r["id"])) in sims)


def test_all_buckets_are_all_pairs(spark, clustered, monkeypatch):
    monkeypatch.setattr(A, "QUERY_BLOCK", 9)  # several blocks
    q = clustered.where("id < 40").select(F.col("id").alias("query_id"), "v")
    got = A.approximate_knn(q, clustered, 5, bits=4, tables=2, probes=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, J.vector_knn(q, clustered, 5).collect()))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [2.0, 0.1]), (4, [2.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = A.approximate_knn(df.select(F.col("id").alias("query_id"), "v").where("id <= 2"), df, 9)
    assert [(r["query_id"], r["id"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [(1, 1), (1, 4), (1, 4)]
    assert A.approximate_knn(df.limit(0).select(F.col("id").alias("query_id"), "v"), df, 9).count() == 0


@pytest.mark.parametrize("knn", [None, A.approximate_knn])
def test_repeats_at_the_default_nearness(spark, knn):
    day = datetime.date(2024, 1, 20)
    turned = lambda cos: [cos, (1 - cos * cos) ** 0.5, 0.0]
    answered = [(1, [1.0, 0.0, 0.0], day, True), (2, [0.0, 0.0, 1.0], day, False), (3, [0.0, 1.0, 0.0], datetime.date(2023, 1, 1), True)]
    asked = [(10, turned(0.93)), (11, turned(0.91)), (12, [0.0, 0.0, 1.0]), (13, [0.0, 1.0, 0.0]), (14, turned(1.0))]
    got = J.repeat_queries(spark.createDataFrame(asked, "query_id long, v array<double>"), spark.createDataFrame(answered, "query_id long, v array<double>, created date, fresh boolean"), F.lit(datetime.date(2024, 2, 1)), knn=knn)
    assert sorted((r["query_id"], r["answered_id"]) for r in got.collect()) == [(10, 1), (14, 1)]
