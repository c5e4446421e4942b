"""Tables of facts and headers of files, case by case; rubrics."""

import datetime

from pyspark.sql import functions as F

from lorehouse.operators import rubrics as B
from lorehouse.operators import text as T

TABLE = """before
<!--- facts:begin -->
| 9 | early | fact | 1 | world | low | | | s | |
| # | claim | kind | confidence | visibility | notability | valid_from | valid_until | source | context | claim_metric | claim_value |
|---|:---:|---|---|---|---|---|---|---|---|---|---|
| 1 | raised \\| seed | FACT | 1.5 | world | high | 2024-01-01 | | call | | arr | 5 |
| 2 | ~~old~~ | event | 0.5 | private | low | | 2025-01-01 | s | superseded by #1 |
| 3 | ~~gone~~ | event | 0.5 | private | low | | | s | Forgotten: asked |
| 4 | ~~struck~~ | event | 0.5 | private | low | | | s | other |
| 2 | again | event | 0.5 | private | low | | | s | |
| x | no number | event | 0.5 | private | low | | | s | |
| 5 | few | event | 0.5 |
| 6 | what | rumour | 0.5 | private | low | | | s | |
| 7 | who | event | 0.5 | nobody | low | | | s | |
| 8 | how | event | 0.5 | world | huge | | | s | |
| 10 | sure | event | very | world | low | | | s | |
not a row
<!--- facts:end -->
| 11 | after | fact | 1 | world | low | | | s | |"""


def test_fact_rows(spark):
    pages = [(1, TABLE), (2, "<!--- facts:begin -->\n| # | claim | kind |\nno end"), (3, None), (4, "<!--- facts:begin --><!--- facts:end -->")]
    got = T.fact_rows(spark.createDataFrame(pages, "id int, text string"), "id", "text").collect()
    assert all(r["id"] == 1 for r in got)
    assert {r["claim"]: r["issue"] for r in got if r["issue"]} == {
        "early": "before_header", "again": "number_again", "no number": "no_number", "few": "too_few_cells", "what": "unknown_kind", "who": "unknown_visibility", "how": "unknown_notability", "sure": "no_confidence"
    }
    good = {r["row"]: r for r in got if not r["issue"]}
    assert sorted(good) == [1, 2, 3, 4]
    assert (good[1]["claim"], good[1]["kind"], good[1]["confidence"], good[1]["valid_from"], good[1]["valid_until"], good[1]["metric"], good[1]["value"], good[1]["active"]) == ("raised | seed", "fact", 1.0, "2024-01-01", None, "arr", 5.0, True)
    assert [(good[k]["claim"], good[k]["active"], good[k]["superseded_by"], good[k]["forgotten"]) for k in (2, 3, 4)] == [("old", False, 1, False), ("gone", False, None, True), ("struck", False, None, False)]


def test_headers(spark):
    files = [(1, "---\ntitle: a\ntype: b\ncreated: 2024\n---\nx"), (2, "text"), (3, "---\ntitle:\ntype: b\n---"), (4, "---\ntitle: a\n"), (5, None), (6, "---\n---\n"), (7, "---\r\ntitle: a\r\ntype: b\r\ncreated: c\r\n---\r\n")]
    got = {}
    for r in T.lint_headers(spark.createDataFrame(files, "id int, text string"), "id", "text").collect():
        got.setdefault(r["id"], set()).add(r["rule"])
    assert got == {2: {"no_frontmatter"}, 3: {"missing_title", "missing_created"}, 4: {"unclosed_frontmatter"}, 5: {"no_frontmatter"}, 6: {"missing_title", "missing_type", "missing_created"}}


def test_rubrics(spark):
    assert all(abs(sum(w for _, w in parts) - 1) < 1e-9 for parts in B.RUBRICS.values())
    day = datetime.date(2024, 1, 1)
    rows = [
        (1, "person", "t", "[Source: x] [a](https://x.example/a) https://x.example/b [n](n.md)" + " " * 200, "- met", {"role": "r"}, day), (2, "whatever", " ", "", None, None, None),
        (3, "deal", "t", None, None, {"company": " ", "amount": "5"}, day), (4, None, "t", "b", None, None, day), (5, "project", "t", "b", "met", {"last_verified": "2020-01-01"}, day),
    ]
    df = spark.createDataFrame(rows, "page_id int, type string, title string, compiled_truth string, timeline string, frontmatter map<string,string>, updated_on date")
    got = {r["page_id"]: (r["rubric"], r["score"]) for r in B.rubric_score(df, F.lit(datetime.date(2024, 3, 1))).collect()}
    assert got == {1: ("person", 0.883), 2: ("default", 0.0), 3: ("deal", 0.25), 4: ("default", 0.6), 5: ("project", 0.335)}
