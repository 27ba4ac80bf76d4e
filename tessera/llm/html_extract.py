"""Main text of HTML pages by a tree-structured graphical model.

A page is read into a tree of block elements; inline elements only add text, links and
words. Every node is content or not: each has a potential from its features (tag, words of
class, id and role, length of its own text, share of links, sentences), and each edge one
between the labels of parent and child. A class or id says that an element is no content if all its words do
("cookie-notice"); as part of a longer name ("related-work") such a word is a weak sign, which the
marginals may outweigh. Sum-product messages go from the leaves up and from
the root down and give each node's exact marginal; blocks of nodes with a marginal of at
least one half are the text. The weights maximise the conditional likelihood of labelled
pages (expected feature counts come from the same messages); the pages are written below, and
``_html_weights`` holds what ``train()`` makes of them, so that no query has to train.

Scripts, styles, form controls and other elements that never show prose are dropped while
reading, comments, hidden elements and markup too; formulas and the text inside objects stay. Unclosed and wrongly nested tags are closed as browsers do;
an unfinished tag at the end is dropped.

Defined results: a null or empty html gives an empty text; a page without content too; white
space inside a block becomes one space; blocks are joined by two line ends; equal pages give
equal texts; columns other than id, url and html are not read. No page is cut.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._html_weights import MODEL

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that can stand in a head; any other one, or text, ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
DROPPED = frozenset("audio button canvas head iframe noscript option script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: What an opening tag ends, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer footnav gdpr header masthead menu meta nav navbar navigation newsletter notice notification outbrain pager pagination popup promo "
    "recommended related reply replies response responses share sharing sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar "
    "topbar widget widgets toc login search alert legal disclaimer modal overlay complementary contentinfo".split()
)
#: Words that say where or how something stands, not what it is.
NEUTRAL = frozenset(
    "area articles bar block bottom box buttons button col column container count desktop entries fixed form global heading icons inline inner item items js left link "
    "links list mobile more news outer page panel posts primary region right row secondary section sub site sticky stories strip thread title top ul unit wrap wrapper".split()
)
GOOD_WORDS = frozenset("article body content entry main post prose story text blog page richtext copy longform".split())
#: Comments; tags with their attributes, whose values may hold anything: a quote counts only behind an equals
#: sign and, if nothing closes it, as any other character; tags up to the first > where that finds no end.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|<[!?/a-zA-Z][^<>]*\Z""",
    re.S,
)
WORDS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: One attribute: its name and its value in double, single or no quotes.
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]*+)))?+""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
CSS_COMMENT = re.compile(r"/\*.*?\*/", re.S)
LABEL = re.compile(r"\sdata-y=(\d)")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CLOSING = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in RAW}


class Page:
    """Block elements in document order: parent, tag, features; and the text blocks with their element."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.marks, self.label = [-1], ["html"], [()], [0]
        self.own, self.linked = [0], [0]  # characters of own text, and of those inside links
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack = [("html", 0)]  # open elements with their node, inline ones too
        text: list[str] = []
        links, dropped, at = 0, 0, 0
        node = 0

        def flush() -> None:
            if text:
                block = " ".join(html_lib.unescape("".join(text)).split())
                text.clear()
                if block:
                    self.blocks.append((node, block))
                    self.own[node] += len(block)

        def close(k: int) -> None:
            nonlocal links, dropped, node
            flush()
            for name, _ in stack[k:]:
                links -= name == "a"
                dropped -= name in DROPPED or name == "#hidden"
            del stack[k:]
            node = stack[-1][1]

        while at < len(source):
            found = TAG.search(source, at)
            end = found.start() if found else len(source)
            part = source[at:end]
            if part and stack[-1][0] == "head" and html_lib.unescape(part).strip(" \t\n\f\r"):
                close(len(stack) - 1)
            if part and not dropped:
                text.append(part)
                if links:
                    self.linked[node] += len(part)
            if not found:
                break
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if stack[-1][0] == "head" and (name in ("body", "html", "br") if found[1] or found[4] else name not in HEAD):
                close(len(stack) - 1)
            if found[1] or found[4]:
                if name in BLOCK or name in DROPPED or name == "a":
                    k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name or stack[k][0] == "#hidden" and stack[k][1] == name), 0)
                    if k and name == "a" and any(x in BLOCK for x, _ in stack[k + 1 :]):
                        stack[k] = ("", stack[k][1])
                        links -= 1
                    elif k:
                        if name == "a":
                            stack.pop(k)
                            links -= 1
                        else:
                            close(k)
                elif not dropped and name == "br":
                    text.append(" ")
                continue
            attrs = found[3] if found[2] else found[6]
            if name in VOID:
                if name in ("br", "hr"):
                    if name == "hr":
                        flush()
                    else:
                        text.append(" ")
                continue
            if name in RAW:
                stop = CLOSING[name].search(source, at)
                at = stop.end() if stop else len(source)
                continue
            if name in DROPPED:
                stack.append((name, node))
                dropped += 1
                continue
            if name == "a":
                stack.append((name, node))
                links += 1
                continue
            if name not in BLOCK:
                continue
            if name == "html" or name == "body":  # one root: the page
                if name == "body" and any(x == "head" for x, _ in stack):
                    close(next(k for k, (x, _) in enumerate(stack) if x == "head"))
                if self.tag[0] == "html":
                    self.tag[0] = name
                    self.marks[0], _, self.label[0] = _marks(attrs)
                continue
            # an open paragraph ends where a block begins
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
            if name in ENDS:
                what, until = ENDS[name]
                k, lowest = len(stack) - 1, 0
                while k > 0 and stack[k][0] not in until:
                    if stack[k][0] in what:
                        lowest = k
                    k -= 1
                if lowest:
                    close(lowest)
            flush()
            self.parent.append(node)
            self.tag.append(name)
            marks, hidden, label = _marks(attrs)
            self.marks.append(marks)
            self.label.append(label)
            self.own.append(0)
            self.linked.append(0)
            node = len(self.parent) - 1
            stack.append((name, node))
            if hidden:
                stack.append(("#hidden", node))
                dropped += 1
        flush()

    def kinds(self) -> list[int]:
        """The kind of the edge from each node's parent: by the node's tag, and apart below a region that holds no content by its name."""
        below = [False] * len(self.parent)  # whether what is below lies in such a region
        out = []
        for i, (parent, tag) in enumerate(zip(self.parent, self.tag, strict=True)):
            inherited = i > 0 and below[parent]
            below[i] = inherited or tag in REGIONS or _BAD in self.marks[i]
            out.append(_KIND[tag] + 4 * inherited)
        return out

    def features(self) -> list[tuple[int, ...]]:
        """Feature numbers of each node, after totals over subtrees."""
        n = len(self.parent)
        total, linked = self.own[:], self.linked[:]
        sentences = [0] * n
        for node, block in self.blocks:
            sentences[node] += block[-1:] in ".!?:;\"'”»…)" or ", " in block or ". " in block
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += total[i]
            linked[self.parent[i]] += linked[i]
        out = []
        for i in range(n):
            own = self.own[i]
            size = 0 if not own else 1 if own < 25 else 2 if own < 80 else 3 if own < 300 else 4
            share = 0 if not total[i] else 1 if not linked[i] else 2 if linked[i] < 0.3 * total[i] else 3 if linked[i] < 0.7 * total[i] else 4
            out.append((0, _TAG_AT[self.tag[i]], _SIZE_AT + size, _SHARE_AT + share, _SENTENCE_AT + (sentences[i] > 0), *self.marks[i]))
        return out


_TAGS = sorted(BLOCK)
_TAG_AT = {t: 1 + i for i, t in enumerate(_TAGS)}
_SIZE_AT = 1 + len(_TAGS)
_SHARE_AT = _SIZE_AT + 5
_SENTENCE_AT = _SHARE_AT + 5
_GOOD = _SENTENCE_AT + 2
_BAD = _GOOD + 1
_WEAK = _BAD + 1
N_FEATURES = _WEAK + 1
#: Kinds of edges, by the child's tag: text elements, lists and tables, plain containers, named regions.
_KINDS = {t: 0 for t in "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split()}
_KINDS |= {t: 1 for t in "ul ol li dl dt dd table tbody thead tfoot tr td th caption".split()}
_KINDS |= {t: 2 for t in "div section center main article body html details summary".split()}
_KIND = {t: _KINDS.get(t, 3) for t in BLOCK}
N_KINDS = 8  # the second four below regions
REGIONS = frozenset("aside dialog footer form menu nav search".split())
_seen: dict[str, tuple] = {}


def _hidden(attrs: str) -> bool:
    """Whether the attributes named hidden, style or aria-hidden hide an element; of repeated names the first counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), double or single or bare)
    style = CSS_COMMENT.sub(" ", html_lib.unescape(found.get("style", "")))
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(NO_DISPLAY.search(style))


def _marks(attrs: str) -> tuple[tuple[int, ...], bool, int]:
    if not attrs:
        return (), False, 0
    if attrs not in _seen:
        names = [set(SPLIT.split(CAMEL.sub("-", n).lower())) - {""} for m in WORDS.finditer(attrs) for n in (m[1] or m[2] or m[3] or "").split()]
        bad = [n - BAD_WORDS - NEUTRAL - GOOD_WORDS for n in names if n & BAD_WORDS]
        strong = any(all(len(w) < 3 for w in rest) for rest in bad)
        good = any(n & GOOD_WORDS and not n & BAD_WORDS for n in names)
        marks = (_BAD,) if strong else (*((_WEAK,) if bad else ()), *((_GOOD,) if good else ()))
        label = LABEL.search(attrs)
        read = marks, _hidden(attrs), int(label[1]) if label else 0
        if len(attrs) > 1000:  # values of any length are not kept
            return read
        if len(_seen) > 50_000:
            _seen.clear()
        _seen[attrs] = read
    return _seen[attrs]


def marginals(parent: list[int], kinds: list[int], unary: list[float], pair: list[list[float]]) -> tuple[list[float], list[tuple]]:
    """Sum-product on the tree. unary: log potential of label 1 (label 0 has 0). pair: by kind, potentials
    00, 01, 10, 11 of (parent, child). Gives P(label = 1) of each node, and the joint of each edge."""
    n = len(parent)
    # beliefs of what lies at and below a node, scaled to sum to 1; nodes come after their parents
    low = [0.0] * n
    high = [0.0] * n
    for i in range(n):
        u = min(30.0, max(-30.0, unary[i]))
        high[i] = 1.0 / (1.0 + exp(-u))
        low[i] = 1.0 - high[i]
    up0, up1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):
        p = pair[kinds[i]]
        m0, m1 = p[0] * low[i] + p[1] * high[i], p[2] * low[i] + p[3] * high[i]
        s = m0 + m1
        up0[i], up1[i] = m0 / s, m1 / s
        j = parent[i]
        a, b = low[j] * up0[i], high[j] * up1[i]
        s = a + b
        low[j], high[j] = (a / s, b / s) if s > 0 else (0.5, 0.5)
    one = [0.0] * n
    one[0] = high[0]
    joints: list[tuple] = [()] * n
    for i in range(1, n):
        j, p = parent[i], pair[kinds[i]]
        # the parent's belief without this child's message
        b1 = one[j] / up1[i]
        b0 = (1.0 - one[j]) / up0[i]
        j00, j01, j10, j11 = b0 * p[0] * low[i], b0 * p[1] * high[i], b1 * p[2] * low[i], b1 * p[3] * high[i]
        s = j00 + j01 + j10 + j11
        one[i] = (j01 + j11) / s
        joints[i] = (j00 / s, j01 / s, j10 / s, j11 / s)
    return one, joints


def _labelled_pages(count: int = 90, seed: int = 11) -> Iterator[str]:
    """Pages whose content elements carry data-y=1. Regions are drawn for each page, texts are filler."""
    rng = random.Random(seed)
    bad = sorted(BAD_WORDS)
    vocabulary = "ra men to sil vor ane ket lo bri dan es un fel mo tir gas pel nor vi sa kum ter al".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(vocabulary, k=rng.randint(1, 3))) for _ in range(rng.randint(lo, hi)))

    def sentence() -> str:
        return words(3, 18).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def prose(n: int) -> str:
        return " ".join(sentence() for _ in range(rng.randint(1, n)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(rng.randint(3, n)))

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.08:
            return f"<p data-y=1>{words(1, 2)}{rng.choice(['.', '', ','])}</p>"
        if kind < 0.16:
            return f"<h2 data-y=1>{words(1, 6)}</h2>"
        if kind < 0.22:
            return f"<ul data-y=1>{''.join(f'<li data-y=1>{prose(1)}</li>' for _ in range(rng.randint(2, 5)))}</ul>"
        if kind < 0.27:
            return f"<blockquote data-y=1><p data-y=1>{prose(3)}</p></blockquote>"
        if kind < 0.31:
            return f"<table data-y=1><tr data-y=1><th data-y=1>{words(1, 2)}</th><td data-y=1>{words(1, 4)}</td></tr></table>"
        if kind < 0.35:
            return f"<figure data-y=1><img src=x><figcaption data-y=1>{words(2, 8)}</figcaption></figure>"
        if kind < 0.40:
            return f"<pre data-y=1>{words(4, 30)}</pre>"
        if kind < 0.48:
            return f'<p data-y=1>{prose(2)} <a href="/x">{words(1, 5)}</a> {prose(1)}</p>'
        if kind < 0.52:
            return f"<div data-y=1>{prose(4)}</div>"
        if kind < 0.56:  # content whose name holds a word that mostly marks something else
            name = f"{rng.choice(bad)}-{words(1, 1)}" if rng.random() < 0.5 else f"{words(1, 1)}-{rng.choice(bad)}-{words(1, 1)}"
            part = rng.choice(["section", "div", "article"])
            return f'<{part} class="{name}" data-y=1><h3 data-y=1>{words(1, 4)}</h3><p data-y=1>{prose(4)}</p><p data-y=1>{prose(2)}</p></{part}>'
        if kind < 0.60:
            return f"<p data-y=1>{words(3, 200)}</p>"
        return f"<p data-y=1>{prose(6)}</p>"

    def extras() -> str:
        return rng.choice(
            [
                f'<div class="ad">{prose(2)}</div>',
                f'<div class="advertisement"><p>{prose(2)}</p><a href="/b">{words(1, 3)}</a></div>',
                f'<aside><h3>{words(1, 3)}</h3><ul>{links(6)}</ul></aside>',
                f'<aside class="sidebar"><p>{prose(2)}</p></aside>',
                f'<div class="share"><a href="/s">{words(1, 1)}</a> <a href="/t">{words(1, 1)}</a></div>',
                f'<div class="related"><h3>{words(1, 3)}</h3><ul>{links(5)}</ul></div>',
                f'<form action="/f"><label>{words(1, 3)}</label><p>{prose(1)}</p></form>',
                f'<div id="newsletter-signup"><h4>{words(2, 5)}</h4><p>{prose(2)}</p></div>',
                f'<div class="cookie-notice"><p>{prose(3)}</p></div>',
                f'<div class="alert notice">{prose(2)}</div>',
            ]
        )

    def nested(region: str) -> str:
        """Now and then with a container more inside."""
        found = re.match(r"(<[^>]+>)(.*)(</\w+>)$", region, re.S)
        if not found or rng.random() < 0.6:
            return region
        return f'{found[1]}<div{rng.choice(["", " class=inner", " class=x"])}>{found[2]}</div>{found[3]}'

    def comments() -> str:
        own = "".join(f'<div class="comment"><p>{prose(4)}</p></div>' for _ in range(rng.randint(1, 4)))
        more = "".join(f"<li><p>{prose(3)}</p></li>" for _ in range(rng.randint(1, 4)))
        return rng.choice([f'<section class="comments"><h3>{words(1, 3)}</h3>{own}</section>', f'<ol id="comments" class="comment-list">{more}</ol>', f'<div id="disqus_thread">{own}</div>'])

    for _ in range(count):
        parts = [paragraph() for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.3:  # the same few words, or one endless run of them, again and again
            one = rng.choice([words(1, 3) + ".", words(1, 3), sentence(), words(60, 300)])
            parts = [f"<p data-y=1>{one}</p>" for _ in range(rng.randint(1, 40))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), nested(extras()))
        title = f"<h1 data-y=1>{words(2, 8)}</h1>"
        if rng.random() < 0.3:
            title = f"<header data-y=1>{title}<p>{words(2, 4)}</p></header>" if rng.random() < 0.5 else f"<header data-y=1>{title}</header>"
        inner = title + "".join(parts)
        wrap = rng.choice(
            [
                "<article data-y=1>{}</article>",
                "<article data-y=1>{}</article>",
                "<main data-y=1><article data-y=1>{}</article></main>",
                "<main data-y=1>{}</main>",
                '<div class="post-content" data-y=1>{}</div>',
                '<div class="wrap"><div id="content" data-y=1>{}</div></div>',
                "<div data-y=1>{}</div>",
                '<section class="entry" data-y=1>{}</section>',
            ]
        )
        before = rng.choice(
            [
                f"<nav><ul>{links(8)}</ul></nav>",
                f'<header><div class="logo">{words(1, 2)}</div><nav><ul>{links(7)}</ul></nav></header>',
                f'<div id="menu"><ul>{links(7)}</ul></div>',
                f"<header><p>{prose(1)}</p></header><nav>{words(1, 2)} <a href=/>{words(1, 2)}</a></nav>",
                f'<div class="breadcrumb"><a href="/">{words(1, 1)}</a> / <a href="/c">{words(1, 1)}</a></div>',
            ]
        )
        after = rng.choice(
            [f"<footer>&copy; {words(1, 3)} {prose(1)}</footer>", f"<footer><p>{prose(3)}</p><ul>{links(5)}</ul></footer>", f'<div class="footer"><p>&copy; {words(1, 3)}</p></div>', ""]
        )
        page = nested(before) + (nested(extras()) if rng.random() < 0.6 else "") + wrap.format(inner)
        page += (nested(extras()) if rng.random() < 0.4 else "") + (nested(comments()) if rng.random() < 0.45 else "") + nested(after)
        yield f"<html><head><title>{words(2, 5)}</title></head><body>{page}</body></html>"
    for _ in range(count // 8):  # prose without any container
        yield f'<html><body data-y=1>{"".join(paragraph() for _ in range(rng.randint(2, 8)))}</body></html>'
        yield f"<body data-y=1>{prose(8)}</body>"
        yield f"<html data-y=1>{prose(2)}"
        yield f"<html data-y=1>{words(1, 6)}"
        yield f"<p data-y=1>{prose(5)}</p><p data-y=1>{prose(5)}</p>"
        yield f"<body><div data-y=1>{words(1, 5)}</div></body>"
        yield f"<body data-y=1>{words(1, 6)}</body>"
        yield f"<body><nav>{words(1, 4)}</nav><div data-y=1><p data-y=1>{words(1, 4)}</p></div><footer>{prose(2)}</footer></body>"
        yield f'<body><p data-y=1>{prose(3)}</p>{comments()}</body>'
        yield f"<body><header>{prose(2)}</header><main data-y=1>{prose(3)}</main><aside>{prose(4)}</aside><footer>{words(2, 9)}</footer></body>"


def train(pages: Iterator[str] | None = None, *, rounds: int = 250, step: float = 1.0, decay: float = 2e-5) -> tuple[list[float], list[list[float]]]:
    """Weights of the features and log potentials of the edge kinds, by gradient ascent on the
    conditional log likelihood of labelled pages."""
    read = [Page(p) for p in (pages if pages is not None else _labelled_pages())]
    data = [(p.parent, p.kinds(), p.features(), p.label) for p in read]
    nodes = sum(len(d[0]) for d in data)
    w, v = np.zeros(N_FEATURES), np.zeros((N_KINDS, 4))
    gw2, gv2 = np.full(N_FEATURES, 1e-6), np.full((N_KINDS, 4), 1e-6)
    for _ in range(rounds):
        gw, gv = -decay * w, -decay * v
        pair = np.exp(v).tolist()
        for parent, kinds, features, label in data:
            one, joints = marginals(parent, kinds, [float(w[list(f)].sum()) for f in features], pair)
            for i, f in enumerate(features):
                gw[list(f)] += (label[i] - one[i]) / nodes
                if i:
                    gv[kinds[i]] -= np.array(joints[i]) / nodes
                    gv[kinds[i], 2 * label[parent[i]] + label[i]] += 1 / nodes
        gw2 = 0.9 * gw2 + 0.1 * gw**2
        gv2 = 0.9 * gv2 + 0.1 * gv**2
        w += step * 0.1 * gw / np.sqrt(gw2 + 1e-8)
        v += step * 0.1 * gv / np.sqrt(gv2 + 1e-8)
    return w.tolist(), np.exp(v).tolist()


def main_blocks(source: str, model: tuple[list[float], list[list[float]]]) -> list[str]:
    weights, pair = model
    page = Page(source)
    unary = [sum([weights[k] for k in f]) for f in page.features()]
    one, _ = marginals(page.parent, page.kinds(), unary, pair)
    return [block for node, block in page.blocks if one[node] >= 0.5]


def extract(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", model: tuple | None = None
) -> DataFrame:
    """``page_id, url, text, n_blocks`` for every page; the model is a few hundred numbers."""
    shared = pages.sparkSession.sparkContext.broadcast(model or MODEL)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            # a few megabytes of text at a time
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [main_blocks(x.as_py(), own) if x.is_valid else [] for x in part.column(2)]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(["\n\n".join(x) for x in found], pa.string()), pa.array([len(x) for x in found], pa.int32())],
                    names=["page_id", "url", "text", "n_blocks"],
                )

    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(read, f"page_id {kind}, url string, text string, n_blocks int")


def write_weights(path: str) -> None:
    """Train and write the module that keeps the weights."""
    weights, pair = train()
    lines = ['"""Weights of the tree model of html_extract, as its train() gives them: features, then edges by kind (00, 01, 10, 11)."""', "", "MODEL = ("]
    rows = ["    [", *(f"        {x!r}," for x in weights), "    ],", "    [", *(f"        {[float(x) for x in p]!r}," for p in pair), "    ],"]
    with open(path, "w") as f:
        f.write("\n".join([*lines, *rows, ")"]) + "\n")
