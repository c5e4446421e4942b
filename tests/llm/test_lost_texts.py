"""Cases in which earlier versions lost a text or took a span twice."""

import zlib

import pytest

from lorehouse.llm import htmltext, pii, quality

P = "This is a sentence, with a comma and enough words to be a paragraph of the article. " * 3
TEXT = " ".join(P.split())


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=main><div><input><label>Name</label><p>{P}</p><p>{P}</p><button>Send</button></div></form></body>",
        f"<body><fieldset><legend></legend><p>{P}</p><p>{P}</p></fieldset></body>",
        f"<article><p>{P}</p><!--><p>{P}</p></article>",
        f"<article><p>{P}</p><!---><p>{P}</p></article>",
        f"<article><p>{P}</p><!-- gone --!><p>{P}</p></article>",
        f"<article><p>{P}</p><!-- gone > --><p>{P}</p></article>",
        f"<div><article><p>{P}</p></article><article><p>{P}</p></article></div>",
        f"<article class='post has-comments'><p>{P}</p><p class=comments-open>{P}</p></article>",
    ],
)
def test_whole_text(page):
    assert htmltext.main_text(page) == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("name", "user-comment usercomments article-comments wp-comments fb-comments comment-thread commentlist comment_2 comments comment-list".split())
def test_reader_comments_go(name):
    assert htmltext.main_text(f"<article><p>{P}</p><div class='x {name}'><p>{P}</p><p>{P}</p><p>{P}</p></div></article>") == TEXT


@pytest.mark.parametrize("rest", ["<form><p>Your name, please</p></form>", "<p style='color: red; display : none'>unseen</p>", "<p style=visibility:hidden>unseen</p>", "<article><p>Read also: this.</p></article>"])
def test_rest_goes(rest):
    assert htmltext.main_text(f"<div><article><p>{P}</p><p>{P}</p></article>{rest}</div>") == f"{TEXT} {TEXT}"
    assert htmltext.main_text(f"<article><p>{P}</p><p>{P}</p>{rest if 'article' not in rest else ''}</article>") == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("n", [3, 12, 40])
def test_added_spans_keep_clear_of_all_base_spans(n):
    """An e-mail whose local part holds many addresses: a span across its end is refused."""
    text = ".".join(["1.2.3.4"] * n) + "@example.org or later"
    base = pii.base_spans(text)
    at = text.index("@")

    class Field:
        weights = [1.0]

        def decode(self, text, words):
            return [("phone", at - 1, at + 3, 99.0), ("phone", len(text) - 5, len(text), 99.0)]

    _, every = pii.all_spans(text, Field())
    assert {s for s in every if s not in base} == {("phone", len(text) - 5, len(text))}


def test_labels_by_threshold(spark):
    """More labels than rows to fit: about as many as asked for are taken, and the same ones again."""
    docs = spark.createDataFrame([(k, f"word{k % 7} " * (60 + k % 9)) for k in range(2_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, zlib.crc32(b"%d" % k) % 2) for k in range(2_000)], "doc_id long, quality int")
    a, b = quality.train(docs, labels, 300), quality.train(docs.repartition(7), labels.repartition(5), 300)
    assert a[0] is not None and a[1] == b[1]
