"""Facts that a stream itself makes known, over several batches and a restart; candidates that expire."""

import datetime

from pyspark.sql import functions as F

from lorehouse.streaming import streams as ST

BEGIN = datetime.datetime(2024, 1, 1)
SCHEMA = "fact_id long, entity_slug string, v array<double>, at timestamp"


def write(spark, rows, at, n):
    spark.createDataFrame([(i, e, v, BEGIN + datetime.timedelta(hours=h)) for i, e, v, h in rows], SCHEMA).coalesce(1).write.parquet(f"{at}/in/part={n}")


def run(spark, at):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    ST.run_once(ST.stream_fact_dedup(s.drop("part"), ttl_seconds=48 * 3600, late="1 hour"), str(at))
    return {r["fact_id"]: (r["verdict"], r["matched_id"]) for r in spark.read.parquet(f"{at}/out").collect()}


def test_a_fact_repeated_in_the_stream(spark, tmp_path):
    x, near, y = [1.0, 0.0], [0.99, 0.05], [0.0, 1.0]
    write(spark, [(1, "a", x, 0), (2, "a", near, 1), (3, "b", x, 1), (4, "a", y, 2), (5, "a", None, 2)], tmp_path, 1)
    first = run(spark, tmp_path)
    assert first == {1: ("independent", None), 2: ("duplicate", 1), 3: ("independent", None), 4: ("independent", None), 5: ("independent", None)}
    # After a restart what was known is still known; 7 comes when 1 is older than the TTL, and is then known itself.
    write(spark, [(6, "a", near, 47), (7, "a", x, 49), (8, "a", near, 60), (9, "b", y, 60)], tmp_path, 2)
    got = run(spark, tmp_path)
    assert got == first | {6: ("duplicate", 1), 7: ("independent", None), 8: ("duplicate", 7), 9: ("independent", None)}
    assert run(spark, tmp_path) == got  # nothing new, no rows again
    write(spark, [(10, "a", x, 1_000), (11, "b", y, 1_001)], tmp_path, 3)
    assert {k: run(spark, tmp_path)[k] for k in (10, 11)} == {10: ("independent", None), 11: ("independent", None)}


def test_candidates_expire(spark):
    day = lambda d: datetime.date(2024, 1, d)
    rows = [(1, "pending", day(5)), (2, "pending", day(6)), (3, "pending", None), (4, "accepted", day(1)), (5, None, day(1)), (6, "pending", day(4))]
    stays, goes = ST.expired(spark.createDataFrame(rows, "id int, status string, expires_at date"), F.lit(day(5)))
    assert sorted(r["id"] for r in stays.collect()) == [2, 3, 4, 5] and sorted(r["id"] for r in goes.collect()) == [1, 6]
