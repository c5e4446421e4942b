"""Queries that had once shrunk, over whole and odd tables."""

import duckdb
import pytest
from compare import same
from conftest import DATA
from pyspark.sql import functions as F

from lorehouse import catalog
from lorehouse.operators import sequences as W


def both(spark, name, at, **tables):
    """The rows of a query over these tables, after they were compared with those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{at}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{at}/{t}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(at)).toPandas()
    same(got, con.execute(catalog.ORACLE_SQL[name]).df())
    return got


def test_far_set_leaves_no_candidate_out(spark):
    ids = [r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()]
    strata = {i % 23 for i in ids} - {3 % 23, 77 % 23, 240 % 23}
    got = catalog.QUERIES["far_set"](spark, DATA).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i in ids if i % 23 in strata)
    assert {r["stratum"]: r["id"] for r in got if r["chosen"]} == {s: min((i for i in ids if i % 23 == s), key=lambda i: (i % 5, i)) for s in strata} and sum(r["chosen"] for r in got) == len(strata)


@pytest.mark.parametrize("close", [[(3, [1.0, 0.0]), (77, None), (240, [0.0, 2.0])], [(3, [1.0, 0.0]), (77, [0.0, 0.0])], [(3, None)], []])
def test_far_set_of_odd_vectors(spark, tmp_path, close):
    rows = [(1, [0.5, 0.5]), (1, [-0.5, 0.5]), (2, None), (4, [0.0, 0.0]), (6, [-1.0, -1.0]), (24, [float("nan"), 1.0]), (None, [1.0, 1.0]), (-1, [1.0, 0.0]), (26, [1.0, 1.0])]
    got = both(spark, "far_set", tmp_path, embeddings=spark.createDataFrame(rows + close, "vec_id long, embedding array<float>"))
    assert sorted(got["id"]) == ([-1, 1, 2, 4, 6, 24] if close else [])


@pytest.mark.parametrize("block", [4_096, 1])
def test_far_distances_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(W, "CLOSE_BLOCK", block)
    c = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "b", [-1.0, 0.0]), (4, "c", None), (5, "d", [0.0, -1.0])], "id long, stratum string, v array<double>")
    close = spark.createDataFrame([(1, "a", [1.0, 0.0]), (9, "a", [0.0, -2.0])], "id long, stratum string, v array<double>")
    assert {r["id"]: r["distance"] for r in W.far_distances(c, close).collect()} == {2: 0.5, 3: 0.5, 4: 1.0, 5: 0.0}
    assert W.far_distances(c, close.where(F.lit(False))).count() == 0


def test_lint_corpus_has_all_rules(spark, tmp_path):
    wanted = {
        "STOP!! it": {"shouting"}, "aAB!! AB!!": set(), "A" * 300_000 + "!": set(), "A" * 300_000 + "!!": {"shouting"}, "Sure, so": {"preamble"}, "\vSure, so": set(), "ſure": {"preamble"}, "Sureé": {"preamble"}, "Surete": set(), "surely": set(), "Here'ſ x": set(),
        "YYYY-MM-DD": {"placeholder_date"}, "éTBDé": {"placeholder_date"}, "xTBD": set(), " ```\na\n``` \n": {"fence_wrap"}, "```a```\u0085": set(), "a [b]( \n)": {"broken_citation"}, "a [b]\n[c[d]()": {"broken_citation"}, "b]() ]()": set(), "[b\n]()": set(), "[" * 300_000: set(), "[b](\v)": set(),
        "# a\n\n# b": {"empty_section"}, "x\r# a\n# b": set(), "x\n## a\n": {"empty_section"}, "# a\n\v#": set(), "": {"no_title"}, " 　 ": {"no_title"}, "\t": set(), " " * 40 + "x": {"no_title"},
    }
    texts = list(wanted)
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None), (None, "STOP!!")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    labels = spark.createDataFrame([*[(i, i % 2, 0) for i in range(len(texts))], (0, 1, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = both(spark, "lint_corpus", tmp_path, documents=docs, labels=labels)
    of = {}
    for k, rule in got[got["rule"] != "no_type"].dropna().itertuples(index=False):
        of.setdefault(texts[int(k)] if k < len(texts) else None, set()).add(rule)
    assert of == {t: r for t, r in wanted.items() if r} | {None: {"no_title"}}
    assert len(got[(got["page_id"] == 0) & (got["rule"] == "shouting")]) == 2  # two labels, two pages
