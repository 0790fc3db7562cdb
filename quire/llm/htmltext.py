"""Main text of web pages by boosted trees over DOM nodes and a tree-wide choice.

A page is read into a tree of elements (unclosed and misnested tags are
allowed).  What stands free in an element that is no part of a line, text and
parts of lines up to the next block, is a node of its own below it, so it can go
while the blocks beside it stay.  Each node becomes features: its tag, tokens of
class, id and role, those of its ancestors, density of text, links, tags and
separators in its subtree, depth, and statistics of its siblings.  Boosted trees
give each node the log-odds that its own text is main text.  The choice is made for the whole
tree: dropping an element drops all below it, and of all such choices the one
with the largest total log-odds is taken, so no element is kept inside a
dropped one.

There are no labelled pages, so the trees are fitted on generated pages whose
blocks are known: of a current template with and without telling tags and
class names (``training_page``), laid out by tables as pages once were
(``table_page``), in the manner of manuals and encyclopaedias
(``reference_page``), and with menus and footers as free text (``stray_page``).

Defined results: null, empty and text-free pages give the empty text.  Rows are
independent; repeated rows repeat; null page_id and url are carried along.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import trees
from quire.llm.scratch import trimmed

_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
_TAG_MARK = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "big", "strike", "wbr", "img"}
#: A start tag closes an open element of its kind: tag -> tags it closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BREAKS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPES = {"table", "td", "th", "ul", "ol", "div", "section", "article", "main", "body", "aside", "nav", "form"}

TAG_KINDS = (
    {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl"}, {"div"}, {"section"}, {"article"}, {"main"}, {"nav", "menu"}, {"aside"},
    {"footer"}, {"header"}, {"form", "button", "fieldset", "label", "dialog", "legend"}, {"table", "tbody", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption"}, {"body", "html"}, {"head", "title"}, {"#free"},
)
#: Tag of a node for what stands free in a block.
FREE = "#free"
_SEPARATOR = re.compile("[|·•»›]|&(?:middot|bull|raquo|rsaquo);")
_LEGAL = re.compile(r"©|&copy;|\bcopyright\b|\ball rights reserved\b", re.I)
#: Tokens of class, id and role by what they tell of a block.
TOKEN_KINDS = (
    {"article", "content", "post", "entry", "story", "main", "text", "body", "prose"},
    {"nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "toolbar"},
    {"ad", "ads", "advert", "advertisement", "adverts", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense", "outbrain"},
    {"sidebar", "side", "widget", "related", "recommended", "popular", "trending", "rail", "complementary", "aside"},
    {"footer", "foot", "copyright", "legal", "contentinfo", "colophon"},
    {"header", "masthead", "head", "logo", "topbar", "branding"},
    {"comment", "comments", "commentlist", "disqus", "reply", "replies", "discussion", "respond", "responses"},
    {"cookie", "cookies", "notice", "consent", "gdpr", "alert", "modal", "popup", "overlay", "newsletter", "subscribe", "signup", "warning", "dialog"},
    {"form", "search", "login", "share", "sharing", "social", "button", "buttons", "input", "register"},
)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset = frozenset()
    children: list[int] = field(default_factory=list)
    own: int = 0


def _attribute_tokens(attributes: str) -> frozenset:
    if not attributes:
        return frozenset()
    return frozenset(t for m in _ATTRIBUTE.finditer(attributes) for t in _TOKEN.findall((m[2] or m[3] or m[4] or "").lower()))


def _tag_end(page: str, at: int, quoted: bool) -> int:
    """Place of the ``>`` that ends the tag whose name ends at ``at``, -1 if none; one inside quotes does not, unless ``quoted`` is false."""
    while quoted and (m := _TAG_MARK.search(page, at)):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        at = close + 1 if close >= 0 else m.end()
    return -1 if quoted else page.find(">", at)


def markup(page: str) -> Iterator[tuple[int, int, str | None, bool, int]]:
    """(start, end, name, whether it closes, end of the name) of each tag in order, without a name for comments and declarations.

    One pass forward: a tag that runs to the end of the page because of its
    quotes turns them off for all that follow, so nothing is looked at twice.
    """
    at, end, last, quoted = 0, len(page), page.rfind(">"), True
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i) or page.startswith("<![CDATA[", i):
            stop = "-->" if page[i + 2] == "-" else "]]>"
            j = page.find(stop, i + 4)
            at = j + 3 if j >= 0 else end
            yield i, at, None, False, at
        elif i > last:
            return
        elif page[i + 1] in "!?":
            at = page.index(">", i) + 1
            yield i, at, None, False, at
        elif m := _TAG.match(page, i):
            j = _tag_end(page, m.end(), quoted)
            if j < 0:
                quoted = False
                j = _tag_end(page, m.end(), quoted)
            at = j + 1
            jump = yield i, at, m[1].lower(), page[i + 1] == "/", m.end()
            at = jump or at
        else:
            at = i + 1


class _Open:
    """The elements that are open, innermost last, and where those of each tag stand."""

    def __init__(self):
        self.stack: list[int] = [0]
        self.places: dict[str, list[int]] = {}

    def depth(self, tags: set[str]) -> int:
        """Place of the innermost open element among ``tags``, 0 if none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, nodes: list[Node], target: set[str], scope: set[str]) -> None:
        """Close the innermost of ``target`` and all inside it, unless one of ``scope`` is open further in."""
        at = self.depth(target)
        if at > self.depth(scope):
            while len(self.stack) > at:
                self.places[nodes[self.stack.pop()].tag].pop()

    def push(self, i: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(i)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Nodes in page order and (node, raw text) of each run; a run of None breaks a block."""
    nodes = [Node("html", -1, 0)]
    runs: list[tuple[int, str | None]] = []
    free: dict[int, int] = {}  # the open node of free content of each block

    def below(parent: int, tag: str, tokens: frozenset = frozenset()) -> int:
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, tokens))
        nodes[parent].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def line(here: int) -> int:
        """Where text or a part of a line in ``here`` belongs."""
        if nodes[here].tag in INLINE:
            return here
        if here not in free:
            free[here] = below(here, FREE)
        return free[here]

    def block() -> None:
        """A block begins: what is free in the block around it ends."""
        for i in reversed(opened.stack):
            free.pop(i, None)
            if nodes[i].tag not in INLINE:
                break

    opened, text, tags, jump = _Open(), 0, markup(page), None
    while True:
        try:
            start, stop, tag, closes, name_end = tags.send(jump)
        except StopIteration:
            break
        jump = None
        if start > text:
            here = opened.stack[-1]
            runs.append((line(here) if here in free or not page[text:start].isspace() else here, page[text:start]))
        text = stop
        if tag is None:
            continue
        if tag in RAW:
            if not closes and page[stop - 2] != "/":
                ending = _ending(tag).search(page, stop)
                text = jump = ending.end() if ending else len(page)
            continue
        if tag not in INLINE:
            runs.append((opened.stack[-1], None))
        if closes:
            opened.close(nodes, {tag}, {"table", "td"} - {tag})
            continue
        if tag in VOID or tag == "html":
            if tag == "hr":
                block()
            continue
        if tag in CLOSES:
            opened.close(nodes, CLOSES[tag], SCOPES - CLOSES[tag])
        elif tag in BREAKS_P:
            opened.close(nodes, {"p"}, SCOPES)
        if tag == "body" and len(opened.stack) > 1:
            opened.close(nodes, {"head"}, set())
        here = opened.stack[-1]
        if tag in INLINE:
            here = line(here)
        else:
            block()
        opened.push(below(here, tag, _attribute_tokens(page[name_end : stop - 1])), tag)
    if text < len(page):
        runs.append((line(opened.stack[-1]), page[text:]))
    return nodes, runs


@lru_cache(64)
def _ending(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


@lru_cache(4096)
def _flags(tag: str, tokens: frozenset) -> int:
    """Bits of the kinds of tag and of token that an element has."""
    bits = sum(1 << j for j, kind in enumerate(TAG_KINDS) if tag in kind)
    return bits + sum(1 << j for j, kind in enumerate(TOKEN_KINDS, len(TAG_KINDS)) if not kind.isdisjoint(tokens))


def node_features(nodes: list[Node], runs: list[tuple[int, str | None]]) -> np.ndarray:
    n = len(nodes)
    parents = [x.parent for x in nodes]
    inside, flags, above = [False] * n, [0] * n, [0] * n
    for i, node in enumerate(nodes):
        flags[i] = _flags(node.tag, node.tokens)
        p = node.parent
        inside[i] = node.tag == "a" or (p >= 0 and inside[p])
        if p >= 0:
            above[i] = above[p] | flags[p]
    own, chars, links, words, marks, tags, longest, first, apart, legal = ([0] * n for _ in range(10))
    total = 0
    first = [-1] * n
    for i, text in runs:
        if text is None or not (text := text.strip()):
            continue
        size = len(text)
        own[i] += size
        words[i] += text.count(" ") + 1
        marks[i] += text.count(".") + text.count(",")
        longest[i] = max(longest[i], size)
        apart[i] += len(_SEPARATOR.findall(text))
        legal[i] += _LEGAL.search(text) is not None
        if inside[i]:
            links[i] += size
        if first[i] < 0:
            first[i] = total
        total += size
    chars[:] = own
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        words[p] += words[i]
        marks[p] += marks[i]
        apart[p] += apart[i]
        legal[p] += legal[i]
        tags[p] += tags[i] + 1
        longest[p] = max(longest[p], longest[i])
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    same = [1] * n
    for node in nodes:
        count: dict[str, int] = {}
        for c in node.children:
            count[nodes[c].tag] = count.get(nodes[c].tag, 0) + 1
        for c in node.children:
            same[c] = count[nodes[c].tag]
    for node, size in zip(nodes, own, strict=True):
        node.own = size
    p = np.maximum(parents, 0)
    root = np.array(parents) < 0
    chars, links, words, marks, tags, own, longest, first, same, apart, legal = (np.array(v, dtype=float) for v in (chars, links, words, marks, tags, own, longest, first, same, apart, legal))
    born = np.array([len(x.children) for x in nodes], dtype=float)
    k = np.where(root, 1, born[p])
    mean = np.where(root, chars, (chars[p] - own[p]) / np.maximum(1, k))
    some = np.maximum(1, chars)
    depth = np.array([x.depth for x in nodes], dtype=float)
    numbers = [
        depth, np.log1p(chars), np.log1p(own), links / some, tags / np.maximum(1, words), marks / np.maximum(1, words), chars / np.maximum(1, words), np.log1p(born), np.log1p(longest),
        np.log1p(k), same / np.maximum(1, k), np.log1p(mean), chars / np.maximum(1, mean), np.maximum(first, 0) / max(1, total), chars / max(1, total),
        np.where(root, 0, links[p] / some[p]), np.where(root, 0, np.log1p(chars[p])), apart / np.maximum(1, words), legal / np.maximum(1, words),
    ]
    bits = np.arange(len(TAG_KINDS) + len(TOKEN_KINDS))
    spread = lambda v: ((np.array(v)[:, None] >> bits) & 1).astype(np.float32)
    return np.hstack([spread(flags), spread(above), np.stack(numbers, axis=1).astype(np.float32)])


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Elements to keep: the choice of largest total among those that keep nothing under a dropped element."""
    gain = [(math.log1p(x.own) if x.own else 0.25) * o for x, o in zip(nodes, odds.tolist(), strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and gain[i] > 0
    return kept


def text_of(nodes: list[Node], runs: list[tuple[int, str | None]], kept: list[bool]) -> str:
    out, held = [], []
    for i, text in runs:
        if text is None:
            out.append("".join(held))
            held = []
        elif kept[i]:
            held.append(html.unescape(text))
    out.append("".join(held))
    return " ".join(x for x in (" ".join(b.split()) for b in out) if x)


def _words(r: random.Random, low: int, high: int) -> str:
    make = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(r.randint(2, 9)))
    words = [make() for _ in range(r.randint(low, high))]
    words = [w + r.choice(["", "", "", "", ",", ".", "%%%", "***", " |", "!!"][: r.choice([6, 10])]) for w in words]
    return " ".join(words).capitalize() + r.choice([".", ""])


def training_page(seed: int) -> str:
    """A generated page and its main text marked by the characters \\x01 (start) and \\x02 (end) around each block."""
    r = random.Random(seed)
    w = lambda a, b: _words(r, a, b)
    main = lambda t: "\x01" + t + "\x02"
    named = r.random() < 0.75
    cls = lambda *names: f' class="{r.choice(names)}"' if named or r.random() < 0.3 else ""
    link = lambda: f'<a href="/{r.randint(1, 99)}">{w(1, 4)}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(a, b))) + "</ul>"
    semantic = r.random() < 0.7
    tag = lambda name: name if semantic or r.random() < 0.3 else "div"

    def block(name: str, classes: tuple[str, ...], inner: str) -> str:
        t = tag(name)
        force = f' class="{r.choice(classes)}"' if t == "div" and r.random() < 0.9 else cls(*classes)
        return f"<{t}{force}>{inner}</{t}>"

    head = f"<head><title>{w(2, 9)}</title><style>p{{margin:0}}</style><script>var x=1;</script></head>"
    top = block("nav", ("nav", "menu", "navbar", "main-navigation"), links(2, 9)) if r.random() < 0.85 else ""
    if r.random() < 0.5:
        top = block("header", ("header", "site-header", "masthead"), f"<div>{w(1, 5)}</div>" + (f"<p>{w(3, 12)}</p>" if r.random() < 0.4 else "") + (top if r.random() < 0.5 else "")) + top
    notes = [
        lambda: f'<div class="{r.choice(["ad", "ads", "advert", "banner-ad", "sponsored", "promo"])}">{r.choice([w(4, 40), f"<p>{w(4, 40)}</p>", link()])}</div>',
        lambda: f'<div class="{r.choice(["cookie-notice", "notice", "consent", "newsletter", "alert", "popup"])}"><p>{w(5, 40)}</p><button>{w(1, 2)}</button></div>',
        lambda: block("aside", ("sidebar", "side", "widget", "related"), f"<h3>{w(1, 4)}</h3>" + r.choice([links(2, 7), f"<p>{w(5, 50)}</p>"])),
        lambda: f"<form{cls('search', 'login', 'subscribe')}><label>{w(1, 4)}</label><input name=q><button>{w(1, 2)}</button></form>",
        lambda: f'<div class="{r.choice(["share", "social", "breadcrumb", "pagination"])}">{link()} {link()}</div>',
    ]
    note = lambda p: r.choice(notes)() if r.random() < p else ""
    mark = lambda: (lambda t: f"{main(w(1, 30))} <{t}{' href=/x' if t == 'a' else ''}>{main(w(1, 5))}</{t}> ")(r.choice(["a", "a", "em", "i", "code", "span"]))
    para = lambda: "<p>" + "".join(mark() for _ in range(r.choice([0, 0, 0, 0, 1, 2, 4]))) + main(w(1, 90)) + ("</p>" if r.random() < 0.95 else "")
    body = [f"<h1>{main(w(2, 12))}</h1>"] if r.random() < 0.9 else []
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        if kind < 0.72:
            body.append(para())
        elif kind < 0.80:
            body.append(f"<h2>{main(w(1, 7))}</h2>")
        elif kind < 0.86:
            body.append("<ul>" + "".join(f"<li>{main(w(2, 25))}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
        elif kind < 0.90:
            body.append(f"<blockquote><p>{main(w(5, 40))}</p></blockquote>")
        elif kind < 0.95:
            body.append(f"<p><b>{main(w(1, 30))}<br>")
        else:
            body.append("<table>" + "".join(f"<tr><td>{main(w(1, 5))}</td><td>{main(w(1, 5))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        body.append(note(0.06))
    inner = "".join(body)
    inner = r.choice([f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f'<div class="{r.choice(["content", "post", "entry-content", "article-body", "story"])}">{inner}</div>', f"<main>{inner}</main>", f"<div>{inner}</div>"])
    remarks = "".join(f'<div class="{r.choice(["comment", "comment-item", "reply"])}"><p>{w(3, 60)}</p></div>' for _ in range(r.randint(1, 5)))
    after = f'<{tag("section")} class="{r.choice(["comments", "comment-list", "discussion", "responses"])}"><h3>{w(1, 3)}</h3>{remarks}</div>' if r.random() < 0.35 else ""
    foot = block("footer", ("footer", "site-footer", "copyright"), r.choice(["&copy; ", ""]) + r.choice([w(2, 14), f"<p>{w(3, 25)}</p>", links(1, 5)])) if r.random() < 0.9 else ""
    return f"<!DOCTYPE html><html>{head}<body>{top}{note(0.5)}{inner}{note(0.3)}{after}{note(0.3)}{foot}</body></html>"


def _prose(r: random.Random, low: int, high: int) -> str:
    """Sentences of plain words, some capitalised and some numbers, without the marks of ``_words``."""
    make = lambda: "".join(r.choice(("ba", "to", "mer", "lin", "sa", "ren", "ko", "vi", "est", "al", "dor", "un", "pe")) for _ in range(r.randint(1, 4)))
    out, left = [], r.randint(low, high)
    while left > 0:
        n = min(left, r.randint(3, 18))
        out.append(" ".join(str(r.randint(1, 2000)) if r.random() < 0.03 else make() for _ in range(n)).capitalize())
        left -= n
    return ". ".join(out) + r.choice([".", ".", "", "?"])


def _main(text: str) -> str:
    return f"\x01{text}\x02"


def table_page(seed: int) -> str:
    """A generated page laid out by tables and fonts, with menus and adverts in cells, as ``training_page`` marks it."""
    r = random.Random(seed)
    w = lambda a, b: _prose(r, a, b)
    item = lambda: f'<a href="p{r.randint(1, 99)}.htm"><font size="1">{w(1, 3)}</font></a>'
    row = lambda n: r.choice([" | ", "<br>", " &middot; "]).join(item() for _ in range(n))
    parts = [f"<{r.choice(('h1', 'h2'))}>{_main(w(2, 9))}</{r.choice(('h1', 'h2'))}>"] if r.random() < 0.8 else [f'<font size="5"><b>{_main(w(2, 8))}</b></font><br><br>']
    for _ in range(r.randint(2, 9)):
        kind = r.random()
        if kind < 0.5:
            parts.append(f"{_main(w(15, 90))}<br><br>")
        elif kind < 0.8:
            parts.append(f"<p align=justify>{_main(w(10, 80))}")
        elif kind < 0.9:
            parts.append(f"<center><i>{_main(w(4, 20))}</i></center>")
        else:
            parts.append("<ol>" + "".join(f"<li>{_main(w(3, 20))}" for _ in range(r.randint(2, 5))) + "</ol>")
    menu = f'<td width="{r.randint(100, 180)}" valign=top bgcolor="#eee"{r.choice(["", " class=menu", " class=left-nav"])}>{row(r.randint(4, 12))}</td>'
    side = f'<td width="160" valign=top>{r.choice([f"<div class=ad>{w(4, 25)}</div>", row(r.randint(2, 6)), f"<b>{w(1, 3)}</b><br>{row(3)}"])}</td>' if r.random() < 0.5 else ""
    top = f'<table width="100%"><tr><td><font size="6">{w(1, 4)}</font></td></tr><tr><td align=center>{row(r.randint(3, 8))}</td></tr></table>'
    foot = f'<hr><center><font size="1">{r.choice(["Copyright ", "&copy; ", ""])}{w(2, 10)} {row(r.randint(0, 4)) if r.random() < 0.6 else ""}</font></center>'
    search = f"<form action=find><input name=q><input type=submit value={r.randint(1, 9)}>{w(1, 2)}</form>" if r.random() < 0.3 else ""
    body = "".join(parts)
    return f'<html><head><title>{w(2, 6)}</title></head><body bgcolor="#ffffff">{top}{search}<table><tr>{menu}<td valign=top>{body}</td>{side}</tr></table>{foot}</body></html>'


def reference_page(seed: int) -> str:
    """A generated page of a manual or encyclopaedia: contents list, sections, code and tables, edit links, notices and categories."""
    r = random.Random(seed)
    w = lambda a, b: _prose(r, a, b)
    links = lambda n: "".join(f'<li><a href="#s{i}">{w(1, 4)}</a></li>' for i in range(n))
    n = r.randint(2, 6)
    toc = f'<div id="toc" class="toc"><h2>{w(1, 2)}</h2><ul>{links(n)}</ul></div>' if r.random() < 0.7 else ""
    note = f'<div class="{r.choice(("notice", "alert", "banner"))}">{w(5, 30)}</div>' if r.random() < 0.4 else ""
    parts = [note, f"<p>{_main(w(20, 80))}</p>", toc]
    for i in range(n):
        parts.append(f'<h2 id="s{i}">{_main(w(1, 5))}</h2>')
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if kind < 0.65:
                parts.append(f"<p>{_main(w(12, 90))}{''.join(f' <a href=#n{j}>{_main(w(1, 3))}</a> {_main(w(2, 20))}' for j in range(r.choice([0, 0, 1, 3])))}</p>")
            elif kind < 0.75:
                parts.append(f"<pre><code>{_main(w(4, 30))}</code></pre>")
            elif kind < 0.87:
                parts.append("<dl>" + "".join(f"<dt>{_main(w(1, 3))}</dt><dd>{_main(w(4, 25))}</dd>" for _ in range(r.randint(2, 5))) + "</dl>")
            else:
                parts.append("<table class=data>" + "".join(f"<tr><th>{_main(w(1, 2))}</th><td>{_main(w(1, 6))}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
    inside = "".join(parts)
    main = r.choice([f'<div id="bodyContent" class="mw-body-text">{inside}</div>', f"<main role=main><section>{inside}</section></main>", f'<div class="document"><div class="body">{inside}</div></div>'])
    title = f'<h1 class="title">{_main(w(1, 6))}</h1>'
    left = f'<div id="panel" role="navigation"><h3>{w(1, 2)}</h3><ul>{links(r.randint(3, 10))}</ul></div>' if r.random() < 0.8 else ""
    tags = f'<div class="catlinks toolbar">{w(1, 2)} {"".join(f"<a href=c{i}>{w(1, 3)}</a>" for i in range(r.randint(1, 5)))}</div>' if r.random() < 0.6 else ""
    foot = f'<div id="footer" role="contentinfo"><p>{w(5, 30)}</p><ul>{links(r.randint(1, 4))}</ul></div>' if r.random() < 0.9 else ""
    before, after = (left, "") if r.random() < 0.5 else ("", left)
    return f"<!doctype html><html><head><title>{w(1, 6)}</title></head><body>{before}<div id=content>{title}{main}{tags}</div>{after}{foot}</body></html>"


def stray_page(seed: int) -> str:
    """A generated page whose menus, footers and some of the main text stand free beside the blocks, short articles among them."""
    r = random.Random(seed)
    w = lambda a, b: _prose(r, a, b)
    bare = lambda a, b: w(a, b).rstrip(".?")
    between = r.choice([" | ", " · ", " / ", " &middot; ", " » ", " - ", " "])
    link = lambda: f'<a href="/{r.randint(1, 99)}">{bare(1, 2)}</a>'
    menu = lambda: between.join((r.choice([link, link, lambda: bare(1, 2)]) if r.random() < 0.2 else kind)() for n in [r.randint(2, 8)] for kind in [r.choice([link, lambda: bare(1, 2)])] for _ in range(n))
    legal = lambda: r.choice([f"Copyright {r.randint(1990, 2026)} {bare(1, 3)}", f"&copy; {r.randint(1990, 2026)} {bare(1, 3)}. All rights reserved.", f"© {bare(1, 4)}", menu(), f"{bare(1, 3)} {link()}"])
    top = r.choice(["", "<br>", "<hr>", " "]).join(x for x in (f"<b>{bare(1, 3)}</b>" if r.random() < 0.2 else "", menu()) if x) if r.random() < 0.7 else ""
    parts = [f"<h1>{_main(bare(1, 8))}</h1>"] if r.random() < 0.6 else []
    for _ in range(r.choice([1, 1, 1, 2, 2, 3, 5, 9])):
        low, high = r.choice([(2, 8), (6, 30), (15, 80)])
        text = _main(w(low, high))
        parts.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>", f"<p>{text}<br>{_main(w(3, 20))}</p>", f"<p><b>{_main(bare(1, 3))}</b> {text}</p>", f'<p>{_main(bare(1, 12))} <a href="/{r.randint(1, 99)}">{_main(bare(1, 4))}</a> {text}</p>', f"<p>{text} <{(t := r.choice(['i', 'em', 'a', 'span', 'code']))}>{_main(bare(1, 4))}</{t}></p>"]))
        if r.random() < 0.12:
            parts.append(f"{_main(w(5, 40))}")
    inside = "".join(parts)
    inside = r.choice([f"<article>{inside}</article>", f"<article>{inside}</article>", f"<main>{inside}</main>", f'<div class="{r.choice(["content", "post", "story"])}">{inside}</div>', f"<div>{inside}</div>", f"<article>{_main(w(8, 50))}{inside}</article>", inside])
    boxed = lambda text, *boxes: r.choice([lambda b, n: f"<{b}>{text}</{b}>", lambda b, n: f'<div class="{n}">{text}</div>'])(*r.choice(boxes))
    if r.random() < 0.3:
        top = boxed(top or menu(), ("nav", "menu"), ("header", "site-header"), ("nav", "navbar"))
    if r.random() < 0.3:
        top += boxed(w(3, 30), ("aside", "ad"), ("aside", "sidebar"), ("form", "notice"))
    foot = r.choice([f"{legal()}{r.choice(['', ' &middot; ' + w(3, 25)])}", w(3, 25)])
    foot = boxed(foot, ("footer", "footer"), ("footer", "site-footer")) if r.random() < 0.45 else r.choice(["", "<hr>", "<br>"]) + legal() if r.random() < 0.75 else ""
    beyond = legal() if r.random() < 0.3 else ""
    return f"<html><head><title>{bare(1, 5)}</title></head><body>{top}{r.choice(['', ' ', '<br>'])}{inside}{foot}</body></html>{beyond}"


@lru_cache(1)
def model(pages: int = 300, others: int = 120) -> trees.Forest:
    """Trees fitted on generated pages; the label of a node is whether any text below it is main text."""
    xs, ys = [], []
    families = [(training_page, pages), (table_page, others), (reference_page, others), (stray_page, 2 * others)]
    for page in (make(seed) for make, n in families for seed in range(n)):
        nodes, runs = parse(page)
        good, every = np.zeros(len(nodes)), np.zeros(len(nodes))
        clean = [(i, t if t is None else t.replace("\x01", "").replace("\x02", "")) for i, t in runs]
        for i, t in runs:
            if t:
                every[i] += len(t.strip())
                good[i] += len(t.strip()) if "\x01" in t else 0
        for i in range(len(nodes) - 1, 0, -1):
            good[nodes[i].parent] += good[i]
            every[nodes[i].parent] += every[i]
        x = node_features(nodes, clean)
        used = every > 0
        xs.append(x[used])
        ys.append((good > 0.0)[used].astype(float))
    return trees.fit(np.concatenate(xs), np.concatenate(ys), n_trees=60, depth=5, rate=0.25)


#: Elements whose features are held together.
AT_ONCE = 8_000


def main_texts(pages: Iterable[str], forest: trees.Forest) -> list[str]:
    """Main text of each page; small pages go through the trees together."""
    out: list[str] = []
    held, features, size = [], [], 0

    def flush() -> None:
        odds = forest.margin(np.concatenate(features))
        cuts = np.cumsum([len(f) for f in features])[:-1]
        out.extend(text_of(*p, decode(p[0], o)) for p, o in zip(held, np.split(odds, cuts), strict=True))
        held.clear()
        features.clear()

    for page in pages:
        held.append(parse(page))
        features.append(node_features(*held[-1]))
        size += len(features[-1])
        if size >= AT_ONCE:
            flush()
            size = 0
    if held:
        flush()
    return out


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and the main ``text`` of every page."""
    shared = df.sparkSession.sparkContext.broadcast(model())
    rows = df.select(F.col(html_col).alias("__html"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = main_texts((x.as_py() or "" for x in batch.column(0)), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    return rows.mapInArrow(trimmed(run), f"{kinds}, text string")
