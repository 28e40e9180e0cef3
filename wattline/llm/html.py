"""Main text of HTML pages with a tree-structured graphical model.

The DOM's block elements and the runs of text in them are the nodes of a tree. A node is content,
boilerplate or mixed (a frame around both, like the body; runs of text never are). Its state depends on its parent's state and
gives rise to its features: tag, words of class and id, and for text its length, share of link text and
punctuation. Sum-product message passing, once up and once down the tree, yields every run's
marginal; runs that are more likely content than not are the main text. On a page without any, the likeliest are, without
regard to class and id. The potentials are
smoothed counts over labelled pages: the templates below and, if given, pages of the corpus
that mark their article.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm._support import hash_sample, slices

#: A tag, from `<` on. Quotes count only after `=`, and only where they end; possessive, so a page is read once.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
HINTS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements by what they do to text: fixed values.
BLOCKS = frozenset("html body main article section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset address details summary dialog button select option label legend center hgroup search menu".split())
HIDDEN = frozenset("script style title textarea noscript template iframe noframes noembed xmp svg object canvas audio video".split())
#: Hidden elements that reach to the end of the page where no end tag follows; the start tags of the others are then passed over.
ENDLESS = frozenset(("script", "style"))
CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in (*HIDDEN, "head")}
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "button", "label", "option", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CLOSED_BY = {tag: ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,) for tag in CLOSES_SAME}
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th".split())
BAD_WORDS = frozenset("nav navbar navigation menu header footer sidebar side aside ad ads advert advertisement adbox banner promo promoted sponsor sponsored cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended comment comments reply replies respond disqus form login search breadcrumb breadcrumbs widget pager pagination toolbar tags copyright legal disclaimer skip".split())
GOOD_WORDS = frozenset("article content contents main post entry body text story page prose".split())
#: Words after which others say what a page has beside this element, words for frames around several parts, and words that
#: tell against content as the last part of a compound only (legal-notice, but not legal-news).
HAVING = frozenset("with has have no without hide show".split())
FRAMING = frozenset("wrap wrapper container layout grid row columns outer inner".split())
WEAK_WORDS = frozenset("legal social share sharing search tags side skip form notice notices copyright promo promoted related alert reply respond comment login widget".split())
#: Deeper elements stay open no longer than their start tag, as in browsers.
DEPTH = 512
#: A run at least so likely is a page's text where none is likelier than not.
LEAST_BEST = 0.1
STATES = ("content", "boiler", "mixed")


class Page:
    """Nodes of a page in document order: parent, features, and the text of runs."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.feature: list[tuple] = [("root",)]
        self.text: list[str | None] = [None]
        self.marked: list[str] = [""]

    def add(self, parent: int, feature: tuple, text: str | None = None, marked: str = "") -> int:
        self.parent.append(parent)
        self.feature.append(feature)
        self.text.append(text)
        self.marked.append(marked)
        return len(self.parent) - 1


WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def hint(compound: str, tag: str = "") -> str:
    """What one class or id says of its element: good, bad, maybe (bad, weakly), frame (around both), or none. Its parts are
    read as a compound: the last is what the element is, `with-x` is not x, and a wrap of text and sidebar is a frame."""
    words = [w.lower() for w in WORDS.findall(compound)]
    at = next((i for i, w in enumerate(words) if w in HAVING), len(words))
    framed, words = len(words) > at and any(w in BAD_WORDS for w in words[at:]), words[:at] or words[at + 1 :] * (not any(w in BAD_WORDS for w in words[at:]))
    bad, good = {w for w in words if w in BAD_WORDS}, {w for w in words if w in GOOD_WORDS}
    if bad and good:
        if FRAMING.intersection(words):
            return "frame"
        return "none" if tag in TEXTUAL or (bad == {"header"} and good != {"page"}) else "bad"
    if bad:
        return "maybe" if bad <= WEAK_WORDS and words[-1] not in BAD_WORDS else "bad"
    return "good" if good else "frame" if framed or FRAMING.intersection(words) else "none"


def hints(attributes: str, tag: str = "") -> str:
    """What class, id and role say together. A word for the text beside one against it says nothing on elements of text."""
    said = {hint(w, tag) for m in HINTS.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split()}
    if {"bad", "good"} <= said and tag in TEXTUAL:
        return "none"
    return next((x for x in ("bad", "good", "frame", "maybe") if x in said), "none")


def tokens(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, closing slash, tag, attributes) in page order: either text or a tag. Comments, declarations and hidden
    elements are left out; a tag that never ends is dropped with what follows, as browsers do."""
    at, end, text = 0, len(html), 0
    unclosed: set[str] = set()
    while at < end:
        at = html.find("<", at)
        if at < 0 or at == end - 1:
            break
        c = html[at + 1]
        if c in "!?":
            stop = -1
            if html.startswith("<!--", at):
                stop = html.find("-->", at + 2)
                stop = end if stop < 0 else stop + 3
            elif html.startswith("<![CDATA[", at) and "]]>" not in unclosed:
                stop = html.find("]]>", at + 9) + 3
                if stop < 3:
                    unclosed.add("]]>")
                    stop = -1
            if stop < 0:
                stop = html.find(">", at)
                stop = end if stop < 0 else stop + 1
            if at > text:
                yield html[text:at], "", "", ""
            at = text = stop
            continue
        if not (c.isascii() and c.isalpha()) and not (c == "/" and at + 2 < end and html[at + 2].isascii() and html[at + 2].isalpha()):
            at += 1
            continue
        if at > text:
            yield html[text:at], "", "", ""
        m = TAG.match(html, at)
        if m is None:
            return
        at = text = m.end()
        tag = m[2].lower()
        if tag in CLOSE:
            if not m[1] and not m[3].endswith("/") and tag not in unclosed:
                close = CLOSE[tag].search(html, at)
                if close:
                    at = text = close.end()
                elif tag in ENDLESS:
                    return
                else:
                    unclosed.add(tag)
            continue
        yield "", m[1], tag, m[3]
    if text < end:
        yield html[text:], "", "", ""


def parse(html: str) -> Page:
    """Any text parses: unclosed and stray tags are taken as browsers take them, roughly. The page is read once."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    run: list[str] = []
    opened: Counter[str] = Counter()
    linked = in_link = 0

    def cut(i: int) -> None:
        for t, _ in stack[i:]:
            opened[t] -= 1
        del stack[i:]

    def flush() -> None:
        nonlocal linked
        if run:
            raw = "".join(run)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                share = min(2, linked * 3 // max(1, len(raw)))
                page.add(stack[-1][1], ("#", min(7, len(text).bit_length() // 2), share, text[-1] in ".!?:;…。", text.count(",") > 0), text)
            run.clear()
        linked = 0

    for piece, slash, tag, attributes in tokens(html):
        if piece:
            run.append(piece)
            linked += len(piece) * (in_link > 0)
            continue
        if tag == "a":
            in_link = max(0, in_link + (-1 if slash else 1))
        elif tag in ("br", "hr", "img", "input", "wbr"):
            run.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        in_link = 0
        if slash:
            if opened[tag]:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in ENDS_PARAGRAPH and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if tag in CLOSES_SAME and any(opened[t] for t in CLOSED_BY[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES_SAME[tag]:
                    break
                if stack[i][0] in CLOSED_BY[tag]:
                    cut(i)
                    break
        marked = re.search(r'data-c="(\d)"', attributes)
        inside = tag in ("header", "footer") and (opened["article"] or opened["main"])
        node = page.add(stack[-1][1], (f"inner {tag}" if inside else tag, hints(attributes, tag) if attributes else "none"), None, marked[1] if marked else "")
        if len(stack) < DEPTH:
            stack.append((tag, node))
            opened[tag] += 1
    flush()
    return page


#: Labelled pages: data-c says whether text below is content (1) or not (0).
TEMPLATES = [
    '<body><header data-c="0"><div class="logo">Site name</div><p>A site about things, every day.</p></header><nav data-c="0"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article data-c="1"><h1>Title here</h1><p>{long}</p><p>{long}</p><aside data-c="0"><h3>See also</h3><p>{mid}</p></aside><h2>Part two</h2><ul><li>{short}</li><li>{short}</li></ul><p>{short}</p></article><aside data-c="0"><h3>Latest</h3><p>{short}</p></aside><footer data-c="0">&copy; site. {short}</footer></body>',
    '<body><div class="cookie-notice" data-c="0"><p>We use cookies. {short}</p><button>Accept</button></div><div id="menu" data-c="0"><a href="/">Home</a> <a href="/b">About</a></div><div id="content" data-c="1"><h1>A title</h1><p>{long}</p><blockquote><p>{long}</p></blockquote><ol><li>{short}</li><li>{mid}</li><li><p>{mid}</p></li></ol><p>{short}</p></div><div class="sidebar" data-c="0"><div class="widget"><p>{long}</p></div></div><div class="footer" data-c="0"><p>{short}</p></div></body>',
    '<body><div class="ad" data-c="0">{short}</div><main data-c="1"><h1>A title</h1><p>{long}</p><div class="ad" data-c="0">{short}</div><nav data-c="0"><a href="/x">Next</a></nav><p>{long}</p><aside data-c="0">{long}</aside><form data-c="0"><label>{short}</label></form><table><tr><td>{short}</td><td>{short}</td></tr></table><pre>{short}</pre></main><section class="comments" data-c="0"><h2>Comments</h2><ol><li><p>{long}</p></li><li><p>{short}</p></li></ol><form><label>Reply</label></form></section></body>',
    '<body><div class="wrap"><div class="nav" data-c="0"><ul><li><a href="/">{short}</a></li></ul></div><div class="post" data-c="1"><h2>A title</h2><div>{long}</div><div>{long}</div><figure><figcaption>{short}</figcaption></figure><ul><li>{bare}</li><li>{short}</li><li>{mid}</li></ul><p>{word}</p></div><div class="related" data-c="0"><ul><li><a href="/r">{short}</a></li></ul></div><div id="comments" data-c="0"><div class="comment"><p>{long}</p></div></div></div></body>',
    '<body><form data-c="0"><label>Search</label></form><article data-c="1"><header><h1>A title</h1></header><p>{long}</p><aside data-c="0"><p>{long}</p></aside><p>{word}</p><p>{long}</p><dl><dt>{word}</dt><dd>{short}</dd></dl></article><div class="newsletter" data-c="0"><p>Sign up. {short}</p><form><label>Mail</label></form></div><div class="notice" data-c="0">{short}</div></body>',
    '<body><div data-c="1"><h1>A title</h1><p>{long}</p><p>{long}</p><p>{word}</p><p>{short}</p><ul><li>{short}</li><li>{short}</li></ul></div><div class="share" data-c="0"><a href="/s">Share</a></div><footer data-c="0"><p>{short}</p><ul><li><a href="/i">Imprint</a></li></ul></footer></body>',
    '<body class="page-with-sidebar"><div class="content-sidebar-wrap"><div id="content" data-c="1"><h1>A title</h1><p>{long}</p><p>{mid}</p><ul><li><a href="/x">{bare}</a></li><li><a href="/y">{short}</a></li></ul><p>{long}</p></div><div class="sidebar" data-c="0"><ul><li><a href="/r">{short}</a></li></ul></div></div><div id="site-footer" data-c="0"><p>{short}</p></div></body>',
    '<body><header data-c="0"><h1>Site name</h1><p>{short}</p></header><div class="wrapper"><main data-c="1"><section class="related-work"><h2>A title</h2><p>{long}</p><ul><li><a href="/x">{word}</a></li><li><a href="/y">{bare}</a></li></ul></section><section id="search-methods"><p>{long}</p><p>{short}</p></section></main><aside data-c="0"><p>{mid}</p></aside></div><div class="social-links" data-c="0"><a href="/s">{word}</a></div><footer data-c="0">{short}</footer></body>',
]
FILL = {
    "longest": "Sentences, one after the other, that make a paragraph of some size, as articles have them. " * 16,
    "long": "Words that go on for some while, as text does, and then a little further. And once more, for good measure: they end. " * 3,
    "mid": "One sentence of middling length, with a comma, that says something and stops.",
    "short": "A few words in a row, no more.",
    "bare": "a few words, no stop",
    "word": "Words.",
}


def labelled() -> list[str]:
    out = []
    for t in TEMPLATES:
        for k in FILL:  # also with all runs of one length, so that length alone decides little
            out.append(re.sub(r"\{\w+\}", FILL[k], t))
        out.append(t.format(**FILL))
    return out


def marks(page: Page) -> list[str] | None:
    """The label of each node: its own mark or its parent's; '' above marked nodes."""
    label = [""] * len(page.parent)
    for i in range(1, len(label)):
        label[i] = page.marked[i] or label[page.parent[i]]
    return label


def weak_marks(page: Page) -> list[str] | None:
    """Labels of a page with just one article element: what is inside is content, but for parts
    that say they are something else. None for other pages."""
    articles = [i for i, f in enumerate(page.feature) if f[0] == "article"]
    if len(articles) != 1:
        return None
    above, i = set(), articles[0]
    while i > 0:
        i = page.parent[i]
        above.add(i)
    label = [""] * len(page.parent)
    for i in range(1, len(label)):
        f, up = page.feature[i], label[page.parent[i]]
        other = len(f) == 2 and (f[1] == "bad" or f[0] in ("nav", "aside", "form", "inner footer"))
        label[i] = "" if i in above else "1" if i == articles[0] else "0" if other or up != "1" else "1"
    return label


class Model:
    """Counts of (state, features) and (parent's state, state), as smoothed probabilities."""

    def __init__(self) -> None:
        self.seen: list[Counter] = [Counter(), Counter(), Counter()]
        self.moves = [[1.0] * 3 for _ in range(3)]
        self.kinds: dict[str, int] = {}

    def learn(self, page: Page, label: list[str], weight: float = 1.0) -> None:
        state = [{"1": 0, "0": 1}.get(v, 1 if page.text[i] is not None else 2) for i, v in enumerate(label)]
        for i in range(1, len(state)):
            for part in self.parts(page.feature[i]):
                self.seen[state[i]][part] += weight
            self.seen[state[i]]["#" if page.text[i] is not None else "element"] += weight
            self.moves[state[page.parent[i]]][state[i]] += weight

    @staticmethod
    def parts(feature: tuple) -> list[tuple]:
        return [("tag", feature[0]), ("hint", feature[1])] if len(feature) == 2 else [(k, v) for k, v in zip(("size", "links", "stop", "comma"), feature[1:], strict=True)]

    def freeze(self) -> Frozen:
        return Frozen(self.seen, self.moves)


class Frozen:
    """A learned model: node potentials by features, parent-child potentials, messages of leaves."""

    def __init__(self, seen: list[Counter], moves: list[list[float]]):
        self.seen, self.moves = [dict(c) for c in seen], [[x / sum(row) for x in row] for row in moves]
        self._known()

    def __reduce__(self):
        return Frozen, ([Counter(c) for c in self.seen], self.moves)

    def _known(self) -> None:
        spread = {"tag": 40, "hint": 5, "size": 8, "links": 3, "stop": 2, "comma": 2}

        @cache
        def node(feature: tuple) -> tuple[float, float, float]:
            text = feature[0] == "#"
            out = []
            for s in range(3):
                total = self.seen[s].get("#" if text else "element", 0)
                if text and s == 2:
                    out.append(0.0)
                    continue
                p = 1.0
                for part in Model.parts(feature):
                    p *= (self.seen[s].get(part, 0) + 0.5) / (total + 0.5 * spread[part[0]])
                if text:
                    p = math.sqrt(p)  # the looks of a run are weak and correlated evidence
                out.append(p)
            return tuple(out)

        self.node = node

    def up(self, belief: list[float] | tuple) -> tuple[float, float, float]:
        """A child's message to its parent, scaled."""
        m = [sum(t * b for t, b in zip(row, belief, strict=True)) for row in self.moves]
        top = max(m) or 1.0
        return (m[0] / top, m[1] / top, m[2] / top)

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node: messages to the root, then back."""
        n, parent = len(page.parent), page.parent
        belief = [list(self.node(f)) if i else [0.05, 0.05, 0.9] for i, f in enumerate(page.feature)]
        sent: list[tuple] = [()] * n
        leaf: dict[tuple, tuple] = {}
        inner = set(parent)
        for i in range(n - 1, 0, -1):
            b = belief[i]
            if i in inner:
                sent[i] = self.up(b)
            else:
                f = page.feature[i]
                if f not in leaf:
                    leaf[f] = self.up(b)
                sent[i] = leaf[f]
            p, m = belief[parent[i]], sent[i]
            p[0], p[1], p[2] = p[0] * m[0], p[1] * m[1], p[2] * m[2]
            top = max(p)
            if top < 1e-100:
                belief[parent[i]] = [x / top for x in p] if top > 0 else [1.0, 1.0, 1.0]
        out = [0.0] * n
        moves = self.moves
        for i in range(n):
            b = belief[i]
            if i:
                p, m = belief[parent[i]], sent[i]
                c = [x / y if y > 0 else 0.0 for x, y in zip(p, m, strict=True)]
                d = [c[0] * moves[0][s] + c[1] * moves[1][s] + c[2] * moves[2][s] for s in range(3)]
                b = [b[0] * d[0], b[1] * d[1], b[2] * d[2]]
            total = sum(b) or 1.0
            belief[i] = [x / total for x in b]
            out[i] = belief[i][0]
        return out

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        page = parse(html)
        if all(f[0] in ("#", "root", "html", "body") for f in page.feature):  # no markup to judge by: all of it is the text
            return "\n".join(t for t in page.text if t is not None)
        runs = [i for i, t in enumerate(page.text) if t is not None]
        content, least = self.marginals(page), 0.5
        if not any(content[i] > least for i in runs):
            # Words of class and id never empty a page: it is judged by its elements, and the likeliest runs are its text.
            page.feature = [(f[0], "none") if len(f) == 2 else f for f in page.feature]
            content = self.marginals(page)
            least = min(0.5, max((content[i] for i in runs), default=1.0) / 2)
            least = least if least > LEAST_BEST / 2 else 0.5
        return "\n".join(page.text[i] for i in runs if content[i] > least)


def train(pages: Iterable[str] = ()) -> Frozen:
    """From the templates and from those of the given pages that mark their article."""
    model = Model()
    for page in map(parse, labelled()):
        model.learn(page, marks(page))
    weak = [(page, label) for page in map(parse, pages) if (label := weak_marks(page)) is not None]
    for page, label in weak:  # pages of one corpus look alike: together they count as four
        model.learn(page, label, 4 / len(weak))
    return model.freeze()


def sample_pages(pages: DataFrame, sample: int = 200, most: int = 100_000, id_col: str = "page_id", html_col: str = "html") -> list[str]:
    """Pages to learn from: at most `sample`, chosen by a hash of the id, each of at most `most` characters (bounds)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return [r.html for r in hash_sample(rows, sample, "id").where(F.length("html") <= most).select("html").collect()]


def extract_text(pages: DataFrame, model: Frozen, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks in page order, one line each).

    Null and empty pages give an empty string; a page without block elements is its own text. Unclosed tags are read as
    browsers read them, but an element hidden to its end tag has none of that effect if that is missing (script and
    style excepted). Rows are judged
    alone on their whole html, so repeated rows give equal results; runs that are exactly as likely
    content as not are left out, and a page whose likeliest run is under LEAST_BEST gives an empty string. An empty table gives an empty result; other columns are dropped before use.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [shared.value.extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.selectExpr(f"`{id_col}` AS id", f"`{url_col}` AS url", f"`{html_col}` AS html").mapInArrow(run, f"id {kind}, url string, text string")
