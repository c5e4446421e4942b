"""Resolutions, groupings, names in texts and table functions on small cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lorehouse.functions.table_functions import register_chunker
from lorehouse.operators import dictionary as N
from lorehouse.operators import fusion as R
from lorehouse.operators import takes as K
from lorehouse.operators import text as T

DAY = datetime.datetime(2024, 1, 1)


def test_resolutions_and_rejects(spark):
    takes = spark.createDataFrame([(1, 1, None, None, None), (1, 2, DAY, "correct", True), (1, 3, None, None, None), (2, 1, None, None, None)], "page_id int, row_num int, resolved_at timestamp, resolved_quality string, resolved_outcome boolean")
    day = lambda d: DAY + datetime.timedelta(days=d)
    rows = [
        (1, 1, 1, day(5), "correct", None), (2, 1, 1, day(4), "maybe", None), (3, 1, 1, day(6), "incorrect", None), (4, 1, 1, day(7), None, None),  # invalid, taken, too late, too late
        (5, 1, 2, day(1), "correct", True), (6, 9, 9, day(1), "correct", None), (7, 1, 3, day(1), "correct", False), (8, 1, 3, day(2), "partial", True), (9, 1, 3, day(3), None, None),
        (10, 2, 1, day(3), None, False), (11, 2, 1, day(3), "unresolvable", None),
    ]
    done, rejects = K.resolve_takes(takes, spark.createDataFrame(rows, "resolution_id int, page_id int, row_num int, at timestamp, quality string, outcome boolean"))
    assert {(r["page_id"], r["row_num"]): (r["resolved_quality"], r["resolved_outcome"], r["resolved_at"]) for r in done.collect()} == {
        (1, 1): ("correct", True, day(5)), (1, 2): ("correct", True, DAY), (1, 3): (None, None, None), (2, 1): ("incorrect", False, day(3))
    }
    assert {r["resolution_id"]: r["reason"] for r in rejects.collect()} == {2: "invalid", 3: "already_resolved", 4: "already_resolved", 5: "already_resolved", 6: "row_not_found", 7: "invalid", 8: "invalid", 9: "invalid", 11: "already_resolved"}


def test_scorecards_in_one_pass(spark):
    rows = [("a", "bet", 0.8, "correct", "x"), ("a", "bet", 0.6, "incorrect", "y"), ("a", "fact", 0.5, "unresolvable", "y"), ("b", "bet", 0.5, None, "x"), ("c", "bet", 1.0, "correct", "x")]
    t = spark.createDataFrame(rows, "holder string, kind string, weight double, resolved_quality string, domain string")
    got = {(r["holder"], r["domain"], r["level"]): r for r in K.scorecards(t, [["holder"], ["domain"], []], spark.createDataFrame([("a",), ("b",)], "holder string")).collect()}
    assert {k[:2] for k in got} == {("a", None), ("b", None), (None, "x"), (None, "y"), (None, None)}
    total = next(r for (h, d, _), r in got.items() if h is None and d is None)
    assert (total["bets"], total["resolved"], total["unresolvable"], total["brier"], total["accuracy"], total["unresolvable_rate"]) == (3, 2, 1, 0.2, 0.5, 0.333333)
    b = next(r for (h, _, _), r in got.items() if h == "b")
    assert b["resolved"] == 0 and b["partial_rate"] is None and b["unresolvable_rate"] is None


def test_longest_titles_first(spark):
    texts = [(1, "New York Times of New York, York new"), (2, None), (3, "the new york"), (4, "new new york times")]
    titles = [(1, "new york"), (2, "New York Times"), (3, "york"), (4, "times of"), (5, ""), (6, "New  York")]
    got = N.title_mentions(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(titles, "title_id int, title string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3, 2), (1, 5, 2, 1), (1, 7, 1, 3), (3, 2, 2, 1), (4, 2, 3, 2)]
    assert N.title_mentions(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "title_id int, title string")).count() == 0


def test_questions_that_name_an_entity_stay(spark):
    pages = spark.createDataFrame([("people/x", "Ada Lovelace", False), ("deals/y", "Über_Fund x9", False), ("concepts/z", "Compilers", False), ("people/gone", "Turing", True)], "slug string, title string, deleted boolean")
    q = spark.createDataFrame([(1, "how does ADA work"), (2, "what about compilers"), (3, "turing"), (4, "over fund"), (5, "x9 y"), (6, None)], "query_id int, text string")
    named = N.names_known_entity(q, pages)
    assert [r["query_id"] for r in named.collect()] == [1]
    hits = spark.createDataFrame([(k, p, p, p == 2, p == 1) for k in (1, 2) for p in (1, 2)], "query_id int, page_id int, rank int, is_process boolean, is_person boolean")
    assert sorted(map(tuple, R.process_reorder(hits, guarded=named).select("query_id", "page_id", "rank").collect())) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 3])
def test_nearest_names(spark, most):
    rng = random.Random(most)
    names = ["".join(rng.choices("abcé", k=rng.randrange(8))) for _ in range(60)] + ["openai_key", "embedding_model"]
    asked = ["".join(rng.choices("abcé", k=rng.randrange(8))) for _ in range(60)] + ["openapi_key", "embedding.model", "Openai_key", "nothing like it", ""]
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs] + [(None,)], f"{c} string")
    got = {r["word"]: (r["name"], r["edits"]) for r in N.nearest_names(df(asked, "word"), df(names, "name"), most).collect()}
    want = {w: (n, d) for w in set(asked) for d, n in [min((edits(w, n), n) for n in set(names))] if d <= most}
    assert got == want


def test_chunks_by_sql(spark):
    rows = [(k, ("Sentence one. " * 50 + "\n\n") * (k % 4)) for k in range(9)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    register_chunker(spark, "pieces", size=40, overlap=5)
    got = spark.sql("select * from pieces(table(select id, text from {df}) partition by id)", df=df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.chunk_recursive(df, "id", "text", 40, 5).collect())) and got.count() > 9
    assert got.where(F.col("key") >= 100).count() == 0


def test_chunk_recursive_on_fixed_cases(spark):
    paragraphs = "\n\n".join(f"Paragraph {k} " + "word " * 20 for k in range(6))
    got = [r["chunk_text"] for r in T.chunk_recursive(spark.createDataFrame([(1, paragraphs)], "id long, text string"), "id", "text", 50, 0).orderBy("chunk_index").collect()]
    assert len(got) == 2 and got[0].startswith("Paragraph 0") and got[1].endswith("word")
    words = " ".join(got).split()
    assert [w for w in paragraphs.split() if w.isdigit()] == [w for w in words if w.isdigit()]  # nothing lost, in order
