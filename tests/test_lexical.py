"""The query language of lexical search against a plain evaluation, chunk by chunk."""

import math
import random

import pytest

from lorehouse.operators import joins as J
from lorehouse.operators import lexical as X


@pytest.mark.parametrize(
    ("word", "to"),
    [("stories", "story"), ("ties", "tie"), ("glasses", "glass"), ("boxes", "box"), ("cars", "car"), ("bus", "bus"), ("this", "this"), ("running", "run"), ("falling", "fall"), ("sing", "sing"), ("planned", "plan"), ("seeing", "see"), ("red", "red"), ("été", "été"), ("", ""), ("a1s", "a1"), ("1s", "1s")],
)
def test_stem(word, to):
    assert X.stem(word) == to


def test_parse():
    assert X.parse('"fat rats" or cats -Dog') == [[(False, [(0, "fat"), (1, "rat")])], [(False, [(0, "cat")]), (True, [(0, "dog")])]]
    assert X.parse('-"cat in the hat" Foo-Bars') == [[(True, [(0, "cat"), (3, "hat")]), (False, [(0, "foo"), (1, "bar")])]]
    assert X.parse('the "of" or OR -') == [] == X.parse(None) == X.parse("  ")
    assert X.parse('"open quote') == [[(False, [(0, "open")]), (False, [(0, "quote")])]]


def plain(queries, chunks, k):
    held = {c: [[X.stem(w) if w not in X.STOP else None for w in X.terms(t)] for t in (title, text)] for c, _, title, text in chunks}
    pages = {c: p for c, p, _, _ in chunks}

    def there(phrase, fields):
        return any(all(0 <= i + o < len(f) and f[i + o] == w for o, w in phrase) for f in fields for i in range(len(f)))

    def df(w):
        return sum(any(w in f for f in fields) for fields in held.values())

    out = []
    for q, text in queries:
        sides = X.parse(text)
        words = {w for side in sides for ex, ph in side if not ex for _, w in ph}
        rows = []
        for c, fields in held.items():
            if any(all(there(ph, fields) != ex for ex, ph in side) for side in sides):
                tf = {w: X.TITLE * fields[0].count(w) + X.TEXT * fields[1].count(w) for w in words}
                rows.append((-round(sum(math.log1p(tf[w]) * math.log(1 + len(held) / df(w)) for w in words if tf[w]), 6), c))
        out += [(q, c, pages[c], -s, n + 1) for n, (s, c) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [512, 3])
def test_search_equals_plain_evaluation(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    rng = random.Random(4)
    words = ["alpha", "alphas", "beta", "Betas", "the", "of", "gamma", "run", "running", "é", "x-ray"]
    text = lambda n: " ".join(rng.choices(words, k=rng.randrange(n)))
    chunks = [(k, k // 3, text(4), text(14)) for k in range(120)] + [(500, 9, None, None), (501, 9, "", "alpha"), (502, 9, "alpha", "beta"), (503, 9, "nothing", "x ray")]
    queries = [(k, " ".join(rng.choice(["", "-", "or ", '"']) + w + rng.choice(["", "", '"']) for w in rng.choices(words, k=rng.randrange(1, 6)))) for k in range(40)]
    queries += [(100, '"alpha beta"'), (101, "alpha -beta"), (102, '-"alpha run"'), (103, None), (104, "the of"), (105, '"alpha the gamma"'), (106, '"beta alpha" or "x ray"')]
    got = X.search(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(chunks, "chunk_id long, page_id long, title string, chunk_text string").repartition(5), 7)
    want = plain(queries, chunks, 7)
    assert [(r[0], r[1], r[2], pytest.approx(r[3], abs=2e-6), r[4]) for r in sorted(map(tuple, got.collect()))] == want
    assert {102} <= {r[0] for r in want} and not {103, 104} & {r[0] for r in want}  # an exclusion alone matches the rest


def test_no_phrase_over_fields_or_chunks(spark):
    chunks = spark.createDataFrame([(1, 1, "alpha", "beta"), (2, 1, "gamma", "alpha"), (3, 1, "beta", "x")], "chunk_id long, page_id long, title string, chunk_text string").coalesce(1)
    assert X.search(spark.createDataFrame([(1, '"alpha beta"'), (2, '"gamma alpha"')], "query_id long, text string"), chunks).count() == 0


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, page_id long, title string, chunk_text string")
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    assert X.search(asked, none).count() == 0 and X.search(asked.limit(0), none).count() == 0


def test_plain_join_in_blocks(spark, monkeypatch):
    """More queries than a block holds give what one block gives."""
    rng = random.Random(8)
    text = lambda: " ".join(rng.choices("abcdefghij", k=6))
    chunks = spark.createDataFrame([(k, k // 2, text()) for k in range(60)], "chunk_id long, page_id long, chunk_text string")
    queries = spark.createDataFrame([(k, text()) for k in range(20)] + [(99, "")], "query_id long, text string")
    whole = sorted(map(tuple, J.lexical_join(queries, chunks, 5).collect()))
    monkeypatch.setattr(J, "TERM_BLOCK", 4)
    assert sorted(map(tuple, J.lexical_join(queries, chunks, 5).collect())) == whole and len(whole) == 100
