"""Operator 8: main text of web pages, by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, less at each
step; what an ancestor gets is discounted by the share of its text that is link
text. The best container is kept, with the siblings that look like parts of the
same text. Menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are left out by element and by class, id or role. A name counts as a whole
token, and not where its element holds most of the page's prose.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements whose content is never part of the text.
LEFT_OUT = RAW | frozenset("head nav header footer aside template button select option datalist dialog svg math canvas object audio video map menu label".split())
#: Elements that are left out as names are: not where they hold most of the page's prose, as a form around a whole page does.
MOSTLY_OUT = frozenset(("form", "fieldset"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr img".split()
)
PARAGRAPH = frozenset("p pre blockquote td dd li".split())
#: Words of a class, id or role that name something other than the text.
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside "
    "complementary contentinfo widget comment comments disqus respond reply replies cookie cookies consent gdpr notice alert notification popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended recommendations pagination pager toolbar search skip legal disclaimer copyright hidden".split()
)
#: What may stand before and after these words in a token, as in site-header or comment-list.
BEFORE = "site global main top bottom left right primary secondary mobile sticky".split()
AFTER = "bar wrapper wrap container list area box links section item items form body button".split()
#: Words that name something other than the text however much of the page it is.
NEVER = frozenset("comment comments disqus respond reply replies cookie cookies consent gdpr".split())
#: Reader comments in a token of several parts, as user-comment, commentlist or wp-comments; and parts that tell a state of the text, as has-comments.
_COMMENTS = re.compile("[a-z]*comments?(?:list|box|area|thread|section|form|wrap|wrapper|container|body|item)?[0-9]*")
STATES = frozenset("has no with without open opened closed off on enabled disabled allowed count counts number link links icon meta".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset(("html", "body", "main"))
ARTICLE = frozenset(("article", "main"))
#: An open element of the first kind ends where one of the second begins.
ENDS = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
    "tr": frozenset(("tr", "tbody", "tfoot", "thead")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "h1": frozenset(("h1", "h2", "h3")), "h2": frozenset(("h1", "h2", "h3")), "h3": frozenset(("h1", "h2", "h3")),
}
#: The same by the element that begins.
ENDED_BY = {t: tuple(sorted(k for k, v in ENDS.items() if t in v)) for t in frozenset().union(*ENDS.values())}
#: Where an implied end stops looking for what it ends.
SCOPE = frozenset("table td th ul ol dl div section article aside nav header footer main body html form button blockquote".split())

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: To the end of a tag; a > within quotes does not end it.
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_MARKS = re.compile("[\"'>]")
#: One attribute after the other, values with them, so that no name is found within a value.
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_WORDS = re.compile(r"[a-z]+")
_PIECES = re.compile(r"[-_]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_COMMENT_END = re.compile("--!?>")
_OTHER_TOKEN = re.compile("(?:(?:{0})[-_]+)*(?:{1})(?:[-_]+(?:{1}))*(?:[-_]+(?:{2}))*(?:[-_]*[0-9]+)?".format("|".join(BEFORE), "|".join(sorted(OTHER)), "|".join(AFTER)))
#: How an element is left out: its name says so, or nothing of it is ever text.
NAMED, ALWAYS = 1, 2


class Node:
    __slots__ = ("chars", "children", "commas", "links", "named", "out", "parent", "points", "prose", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, out: bool, named: bool = False):
        self.tag, self.parent, self.out, self.named = tag, parent, out, named
        self.children: list[Node | str] = []
        self.chars = self.links = self.commas = self.prose = 0
        self.text = False
        self.points = 0.0


def _other(tag: str, attributes: str) -> int:
    """ALWAYS, NAMED or 0 for what may be text."""
    if tag in LEFT_OUT:
        return ALWAYS
    if tag in WHOLE:
        return 0
    how = NAMED if tag in MOSTLY_OUT else 0
    if not attributes:
        return how
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), "".join(values))  # the first of its name counts
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true":
        return ALWAYS
    if _UNSEEN.search(html.unescape(found.get("style", ""))):
        how = NAMED
    for name in ("class", "id", "role"):
        for token in html.unescape(found.get(name, "")).lower().split():
            if _OTHER_TOKEN.fullmatch(token):
                if not NEVER.isdisjoint(_WORDS.findall(token)):
                    return ALWAYS
                how = NAMED
            elif "comment" in token:
                pieces = _PIECES.split(token)
                if any(map(_COMMENTS.fullmatch, pieces)) and STATES.isdisjoint(pieces):
                    return ALWAYS
    return how


class _Ends:
    """Where the tag that a place lies in ends.

    The first tag that never ends would be looked at up to the end of the page, and
    so would each one after it: from then on the ends come from a table of all quotes
    and closing marks, filled once from the last to the first.
    """

    def __init__(self, page: str):
        self.page, self.marks = page, None

    def after(self, at: int) -> int:
        """The place behind the tag's end, or 0 if there is none."""
        if self.marks is None:
            if m := _REST.match(self.page, at):
                return m.end()
            self.marks = [m.start() for m in _MARKS.finditer(self.page)]
            self.ends = [0] * (len(self.marks) + 1)
            nxt = {'"': len(self.marks), "'": len(self.marks)}  # the next mark of its kind
            for k in range(len(self.marks) - 1, -1, -1):
                c = self.page[self.marks[k]]
                if c == ">":
                    self.ends[k] = self.marks[k] + 1
                else:  # a quoted run: on from behind the quote that closes it
                    close = nxt[c]
                    self.ends[k] = self.ends[close + 1] if close < len(self.marks) else 0
                    nxt[c] = k
        return self.ends[bisect_left(self.marks, at)]


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all elements in page order. Unclosed elements end with their parent; a closing tag that fits nothing open is passed over; a tag that never ends is text.

    Time grows with the page alone: open elements are kept by name, so that no tag
    walks over others than those that it ends.
    """
    root = Node("html", None, False)
    nodes, opened, at = [root], [root], 0
    by_name: dict[str, list[int]] = {}  # places in `opened`
    scopes: list[int] = [0]
    ends = _Ends(page)

    def put(raw: str) -> None:
        here = opened[-1]
        if here.out or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        here.children.append(text)
        if n := len(text.strip()):
            here.chars += n
            here.prose += n
            here.commas += text.count(",")
            here.text = True

    def close(place: int) -> None:
        while len(opened) > place:
            tag = opened.pop().tag
            by_name[tag].pop()
            if tag in SCOPE:
                scopes.pop()

    n, begun = len(page), 0
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            put(page[begun:lt])
            # <!--> and <!---> end where they begin.
            over = re.compile("<!---?>").match(page, lt) or _COMMENT_END.search(page, lt + 4)
            at = begun = over.end() if over else n
            continue
        if page.startswith(("<!", "<?"), lt):
            put(page[begun:lt])
            at = begun = page.find(">", lt) + 1 or n
            continue
        m = _NAME.match(page, lt + 1)
        end = ends.after(m.end()) if m else 0
        if not end:
            at = lt + 1
            continue
        put(page[begun:lt])
        tag = m[0].lower()
        attributes, at, begun = page[m.end() : end - 1], end, end
        if tag[0] == "/":
            if places := by_name.get(tag[1:]):
                close(places[-1])
            continue
        if tag in ("html", "body"):
            continue
        # Implied ends: the innermost element that this one ends, if no scope lies within it.
        if found := [places[-1] for t in ENDED_BY.get(tag, ()) if (places := by_name.get(t))]:
            if max(found) >= scopes[-1]:
                close(max(found))
        here = opened[-1]
        how = 0 if here.out else _other(tag, attributes)
        new = Node(tag, here, here.out or how == ALWAYS, how == NAMED)
        here.children.append(new)
        nodes.append(new)
        if tag in RAW:
            over = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            at = begun = n if not over else page.find(">", over.start()) + 1 or n
        elif tag not in VOID:
            by_name.setdefault(tag, []).append(len(opened))
            if tag in SCOPE:
                scopes.append(len(opened))
            opened.append(new)
    put(page[begun:])
    for x in reversed(nodes):  # children come after their parents
        if x.parent is not None and x.tag != "a" and x.tag not in HEADINGS:
            x.parent.prose += x.prose
    for x in nodes:
        if x.parent is not None:
            x.out = x.out or x.parent.out or x.named and 2 * x.prose <= root.prose
    return root, nodes


def _blocks(node: Node, out: list[str]) -> None:
    """The pieces of text under node, with a blank where a block begins or ends."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.out:
            if x.tag in INLINE:
                stack.extend(reversed(x.children))
            else:
                out.append(" ")
                stack.append(" ")
                stack.extend(reversed(x.children))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, nodes = parse(page)
    for x in reversed(nodes):  # children come after their parents
        if x.out or x.parent is None:
            continue
        up = x.parent
        if x.tag == "a":
            x.links = x.chars
        up.chars += x.chars
        up.links += x.links
        up.commas += x.commas if x.tag in INLINE or x.tag in PARAGRAPH else 0
        up.text |= x.text and x.tag in INLINE
    for x in nodes:
        if x.out or not x.chars or x.tag in INLINE:
            continue
        if x.tag in PARAGRAPH or x.text and x.tag not in HEADINGS and x.tag != "html":
            points = 1 + x.commas + min(x.chars / 100, 3)
            if x.tag not in PARAGRAPH:
                x.points += points
            up, share = x.parent, 1.0
            for level in range(1, 6):
                if up is None:
                    break
                up.points += points * share
                up, share = up.parent, 1 / (2 if level == 1 else 3 * level)
    density = lambda x: x.links / x.chars if x.chars else 0.0
    score = lambda x: (x.points + 25 * (x.tag in ARTICLE)) * (1 - density(x))
    found = [x for x in nodes if x.points and not x.out and x.chars]
    if not found:
        best, around = root, []
    else:
        best = max(found, key=score)
        up = best
        while up is not None:  # an article that the best container is part of is the text
            if up.tag in ARTICLE:
                best = up
                break
            up = up.parent
        around = best.parent.children if best.parent is not None else []
    least = max(10.0, 0.2 * score(best))
    plain = lambda x: x.points * (1 - density(x))

    def belongs(x: Node | str) -> bool:
        if isinstance(x, str) or x.out or not x.chars:
            return False
        if best.tag in ARTICLE:  # beside an article only what is one too, and of some substance against it
            return x.tag in ARTICLE and plain(x) >= 0.2 * plain(best)
        if x.points and score(x) >= least:
            return True
        return x.tag == "p" and (density(x) < 0.25 if x.chars > 80 else x.links == 0)

    parts: list[str] = []
    for x in [x for x in around if x is best or belongs(x)] or [best]:
        _blocks(x, parts)
        parts.append(" ")
    return " ".join("".join(parts).split())


def main_texts(column: Column) -> Column:
    @F.pandas_udf("string")
    def extracted(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    return extracted(column)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null and empty pages give an empty text; other columns are dropped, whatever
    their names; rows are never joined, so repeated and null ids stay. A page may be
    of any length and as malformed as it likes: unclosed and stray tags cost time in
    proportion, and a page is looked at whole.
    """
    return pages.select("page_id", "url", main_texts(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
