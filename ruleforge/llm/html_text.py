"""Main text of web pages by a tree-structured graphical model (operator 2).

A page becomes a tree of its block elements, with the runs of text in them as leaves.  Every node is
content or not.  Node potentials come from the element's kind, the words of its class, id and role, its
text and its place among its siblings; every parent-child edge has a potential for the four pairs of labels.  Sum-product messages
passed upward, then downward, give each node's exact content marginal; leaves at 0.5 or more are the
text.  Messages go level by level through all trees of a batch at once.

The potentials are trained by maximum likelihood (its gradient is a difference of marginals) from pages
with known labels.  No table labels pages, so they are generated: a bounded, seeded set of page layouts,
each with its labels; a good part of them name nothing (plain divisions, tables), and names may mislead.

Defined cases: null or empty html, and a page without content, gives an empty text and 0 characters; a
null page_id or url stays null; repeated rows are read each; other columns are ignored; an empty table
gives no rows.  Pages are read whole, unclosed and stray tags included; a line break or other white
space inside a block is a space.
"""

from __future__ import annotations

import collections
import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "page_id long, url string, text string, n_chars long"

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.DOTALL)
#: Where no tag is closed any more, only an unfinished comment is no text.
OPEN_COMMENT = re.compile(r"<!--.*\Z", re.DOTALL)
#: What the small print of a page says; fixed values.
LEGAL = re.compile(r"©|copyright|rights reserved|alle rechte|tous droits|derechos reservados|impressum|privacy", re.IGNORECASE)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

#: Kinds of block elements; what is in no list is inline.  Fixed values of the markup language.
KINDS = {
    "article": ("article", "main"), "section": ("section", "div", "center", "hgroup", "details", "dialog"), "nav": ("nav", "menu", "dir"), "header": ("header",), "footer": ("footer", "address"),
    "aside": ("aside",), "form": ("form", "fieldset", "button", "select", "option", "textarea", "label", "legend"), "p": ("p", "pre"), "heading": ("h1", "h2", "h3", "h4", "h5", "h6"), "list": ("ul", "ol", "dl"),
    "item": ("li", "dt", "dd"), "table": ("table", "thead", "tbody", "tfoot", "tr", "caption"), "cell": ("td", "th"), "quote": ("blockquote",), "figure": ("figure", "figcaption"), "embed": ("iframe", "noscript", "object", "ins"), "root": ("html", "body", "hr"),
}
KIND_OF = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags}
LEAF = len(KINDS)
#: Elements whose whole content is not text of the page.
RAW = {"script", "style", "title", "template", "svg", "math", "head-data"}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
#: Start tags that end an open element of the same list.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where that search for an open element stops.
SCOPE = {"ul", "ol", "dl", "table", "select"}

#: Words of class, id and role, by what they speak for.  Fixed values.
HINTS = (
    ("content", {"content", "article", "post", "entry", "main", "story", "text", "articlebody", "body", "page"}),
    ("advert", {"ad", "ads", "advert", "advertisement", "adverts", "adsbygoogle", "banner", "promo", "promotion", "sponsor", "sponsored", "teaser"}),
    ("menu", {"nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "pager", "pagination", "toc", "tabs", "links", "tags", "skip"}),
    ("comment", {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "reader", "readers", "reviews"}),
    ("frame", {"footer", "header", "masthead", "sidebar", "aside", "widget", "related", "share", "sharing", "social", "contentinfo", "complementary", "topbar", "copyright", "legal", "logo", "recommended", "more", "popular", "meta"}),
    ("notice", {"cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr", "paywall", "message", "warning", "disclaimer"}),
    ("form", {"form", "search", "login", "signup", "newsletter", "subscribe", "subscription", "register", "contact"}),
)


@functools.lru_cache(4096)
def hints(attributes: str) -> tuple[int, ...]:
    """Which groups of hints the attributes name; the last position says that they name something."""
    found = " ".join(next(filter(None, m[1:]), "") for m in NAMED.findall(attributes))
    said = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower()))
    return tuple(int(bool(said & words)) for _, words in HINTS) + (int(bool(said)),)


NO_HINTS = (0,) * (len(HINTS) + 1)


class Page:
    """A parsed page: nodes in document order with their parents, and the text of the leaves."""

    __slots__ = ("parent", "depth", "kind", "hint", "size", "linked", "marks", "sign", "texts", "leaves")

    def __init__(self, source: str):
        self.parent, self.depth, self.kind, self.hint = [-1], [0], [KIND_OF["html"]], [NO_HINTS]
        self.size, self.linked, self.marks, self.sign = [0], [0], [0], [0]
        self.texts, self.leaves = [], []
        stack, pending, anchors, linked = [(0, "html")], [], 0, 0
        # how many elements of a name are open, in all and since the innermost list or table
        total, scopes = collections.Counter(), [collections.Counter()]
        at, last = 0, source.rfind(">")

        def pop() -> str:
            _, name = stack.pop()
            total[name] -= 1
            scopes.pop() if name in SCOPE else scopes[-1].subtract((name,))
            return name

        def flush():
            nonlocal linked
            if pending:
                text = " ".join(html.unescape("".join(pending)).split())
                pending.clear()
                if text:
                    self._add(stack[-1][0], LEAF, NO_HINTS, len(text), min(linked, len(text)), sum(map(text.count, ".,;:!?")), int(bool(LEGAL.search(text))))
                    self.leaves.append(len(self.parent) - 1)
                    self.texts.append(text)
            linked = 0

        n = len(source)
        while at < n:
            m = TAG.search(source, at) if at <= last else OPEN_COMMENT.search(source, at)  # without a ">" there is no tag
            piece = source[at : m.start() if m else n]
            if piece:
                pending.append(piece)
                if anchors:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            if m.re is OPEN_COMMENT:
                break
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if name in RAW:
                if not closing:
                    end = _RAW_END[name].search(source, at)
                    at = end.end() if end else n
                pending.append(" ")
                continue
            kind = KIND_OF.get(name)
            if kind is None:
                if name == "a":
                    anchors = 0 if closing else 1
                elif name in ("br", "img", "input", "wbr", "meta", "link"):
                    pending.append(" ")
                continue
            flush()
            if closing:
                while total[name] and pop() != name:
                    pass
                continue
            anchors = 0
            if name in ("html", "body"):
                continue
            if stack[-1][1] == "p":
                pop()
            ends = CLOSES.get(name, ())
            if any(scopes[-1][e] for e in ends):
                while pop() not in ends:
                    pass
            self._add(stack[-1][0], kind, hints(attributes) if attributes else NO_HINTS, 0, 0, 0, 0)
            if name != "hr" and not attributes.endswith("/"):
                stack.append((len(self.parent) - 1, name))
                total[name] += 1
                if name in SCOPE:
                    scopes.append(collections.Counter())
                else:
                    scopes[-1][name] += 1
        flush()

    def _add(self, parent, kind, hint, size, linked, marks, sign):
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kind.append(kind)
        self.hint.append(hint)
        self.size.append(size)
        self.linked.append(linked)
        self.marks.append(marks)
        self.sign.append(sign)


class Forest:
    """The trees of a batch as arrays, with node features and the nodes of each level."""

    def __init__(self, pages: list[Page]):
        counts = [len(p.parent) for p in pages]
        base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        cat = lambda name, t=float: np.array([v for p in pages for v in getattr(p, name)], t)
        self.n = int(base[-1])
        own = np.repeat(base[:-1], counts)
        self.parent = np.where(cat("parent", np.int64) < 0, -1, cat("parent", np.int64) + own)
        depth, kind = cat("depth", np.int64), cat("kind", np.int64)
        by = np.argsort(depth, kind="stable")
        self.levels = np.split(by, np.flatnonzero(np.diff(depth[by])) + 1) if self.n else []
        size, linked, marks, sign = cat("size"), cat("linked"), cat("marks"), cat("sign")
        ahead = np.cumsum(size) - size
        leaves = np.zeros(self.n)
        leaves[kind == LEAF] = 1
        for level in reversed(self.levels[1:]):
            for v in (size, linked, marks, sign, leaves):
                np.add.at(v, self.parent[level], v[level])
        root = own
        total = np.maximum(size[root], 1)
        hint = np.array([h for p in pages for h in p.hint], float).reshape(self.n, len(HINTS) + 1)
        one_hot = np.zeros((self.n, LEAF + 1))
        one_hot[np.arange(self.n), kind] = 1
        full = np.maximum(size, 1)
        is_leaf = (kind == LEAF).astype(float)
        up = np.maximum(self.parent, 0)
        at = np.arange(self.n)
        headings = (kind == KIND_OF["h1"]).astype(float)
        for level in reversed(self.levels[1:]):
            np.add.at(headings, self.parent[level], headings[level])
        # the largest sibling, and the first and last child of each element
        child = np.flatnonzero(self.parent >= 0)
        largest, first, final = np.zeros(self.n), np.full(self.n, self.n), np.zeros(self.n, np.int64)
        np.maximum.at(largest, self.parent[child], size[child])
        np.minimum.at(first, self.parent[child], child)
        np.maximum.at(final, self.parent[child], child)
        below = np.isin(kind, [KIND_OF[t] for t in ("p", "h1", "li", "td")])  # elements that mostly hold text itself
        box = np.isin(kind, [KIND_OF[t] for t in ("div", "td", "ul", "table", "li")]).astype(float)  # elements that hold others
        measures = np.stack([
            np.ones(self.n), np.log1p(size) / 5, linked / full, 10 * marks / full, np.minimum(sign, 1), size / total, (ahead - ahead[root]) / total, np.log1p(leaves) / 2, is_leaf * linked / full,
            is_leaf * np.log1p(size) / 5, is_leaf * np.minimum(sign, 1), (size == 0).astype(float), size / np.maximum(largest[up], 1), size[up] / total, (first[up] == at).astype(float), (final[up] == at).astype(float),
            np.minimum(headings, 3) / 2, is_leaf * (size < 40), (headings == 0) * (linked / full > 0.5), is_leaf * np.minimum(headings[up], 1), (size / total > 0.5).astype(float),
            (headings[up] > 0) * size[up] / total, (size / total < 0.1) * (headings == 0) * (kind != LEAF), (kind == KIND_OF["td"]) * size / total,
            box * (headings == 0) * (headings[up] > 0), box * (headings == 0) * (size < 0.5 * largest[up]), box * (headings > 0) * (size == largest[up]),
        ], 1)
        # edges by their child: a leaf, an element of no claim, one that names itself a frame or insert, one
        # that names itself content.  A paragraph's names say little, and an article has a header of its own.
        named_apart = hint[:, 1:-1].any(1) & ~below
        apart = named_apart | np.isin(kind, [KIND_OF[t] for t in ("nav", "footer", "aside", "form")])
        claims = (kind == KIND_OF["article"]) | (hint[:, 0] > 0) & ~below
        header = kind == KIND_OF["header"]
        # below an element that names itself content, with none between that names itself apart
        inside = claims & ~apart
        for level in self.levels[1:]:
            inside[level] |= inside[self.parent[level]] & ~apart[level]
        apart |= header & ~inside
        claimed = np.zeros(self.n, bool)
        np.logical_or.at(claimed, root, inside)
        outside = claimed[root] & ~inside
        unclaimed = ~claimed[root]
        own_names = np.concatenate([hint * ~below[:, None], hint * below[:, None]], 1)
        self.x = np.concatenate([one_hot, own_names, measures, measures * unclaimed[:, None], np.stack([inside, outside], 1)], 1)
        self.edge = np.where(kind == LEAF, 0, np.where(apart, 2, np.where(claims, 3, 1)))
        self.leaf = np.flatnonzero(kind == LEAF)


N_FEATURES = LEAF + 1 + 2 * (len(HINTS) + 1) + 2 * 27 + 2
EDGES = 4


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def marginals(forest: Forest, w: np.ndarray, e: np.ndarray):
    """Content marginal of every node, and the marginals of the label pairs of every edge."""
    up = np.zeros((forest.n, 2))
    up[:, 1] = forest.x @ w
    message = np.zeros((forest.n, 2))
    for level in reversed(forest.levels[1:]):
        message[level] = _log_add(e[forest.edge[level]] + up[level][:, None, :], 2)
        np.add.at(up, forest.parent[level], message[level])
    all_of, pair = up.copy(), np.zeros((forest.n, 2, 2))
    for level in forest.levels[1:]:
        rest = all_of[forest.parent[level]] - message[level]
        joint = e[forest.edge[level]] + rest[:, :, None] + up[level][:, None, :]
        all_of[level] = up[level] + _log_add(e[forest.edge[level]] + rest[:, :, None], 1)
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        pair[level] = joint / joint.sum((1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(all_of[:, 0] - all_of[:, 1], -500, 500))), pair


# ---------------------------------------------------------------- training pages

#: A mark that generated pages put into content, so that parsing keeps the labels.
_MARK = ""


def _words(r: random.Random, n: int) -> str:
    parts = ("an", "er", "tion", "the", "ou", "st", "ch", "ung", "ment", "en", "re", "é", "ó", "de", "la", "que", "ß")
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) + r.choice(("", "", "", "", ".", ",")) for _ in range(n))


def training_page(r: random.Random, unnamed: bool | None = None) -> str:
    """A page of a random layout; every content block holds _MARK.  unnamed: whether its parts name themselves."""
    pick, some = r.choice, lambda p: r.random() < p
    link = lambda: f'<a href="/{r.randrange(999)}">{_words(r, r.randrange(1, 5))}</a>'
    links = lambda: "".join(f"<li>{link()}</li>" for _ in range(r.randrange(2, 8)))
    prose = lambda lo=1, hi=60: html.escape(_words(r, r.randrange(lo, hi)).capitalize() + ".")
    style = pick(("plain",) * 8 + ("again", "bars", "shout", "signs"))  # articles of any quality are content

    def styled(text: str) -> str:
        words = text.split()
        if style == "again":
            return " ".join(words[:1] * len(words))
        if style == "bars":
            return " | ".join(words)
        if style == "shout":
            return "!! ".join(words).upper()
        return html.escape(" ".join(w + pick(("###", "&&&", "$$$", "***", "%%%")) for w in words)) if style == "signs" else text

    def content(lo=1, hi=60) -> str:
        text = prose(lo, hi * pick((1, 1, 1, 10)) if hi == 60 else hi)
        return _MARK + styled(text) + (f" {link()} {prose(1, 20)}" if some(0.1) else "")

    name = lambda *options: (lambda c: f' {pick(("class", "id"))}="{c}"' if c else "")(pick(options))

    bare = some(0.4) if unnamed is None else unnamed  # a page that names nothing
    if bare:
        name = lambda *options: ""
    # names that say nothing about a paragraph of the article
    odd = lambda: f' class="{pick(("more-text", "message", "lead", "meta", "note", "x1", "first", "ad-free", "share-quote", "intro", "related-work"))}"' if some(0.08) else ""

    def junk() -> str:
        if bare and some(0.7):
            return pick((
                lambda: f"<div>{prose(1, 14)}</div>", lambda: f"<div>{link()} {link()} {link()}</div>", lambda: f"<div><p>{prose(2, 14)}</p><button>ok</button></div>", lambda: f"<ul>{links()}</ul>",
                lambda: f"<div><b>{_words(r, 2)}</b><ul>{links()}</ul></div>", lambda: f"<div>{link()}<br>{prose(1, 10)}</div>",
            ))()
        return pick((
            lambda: f"<div{name('ad', 'ads', 'advert', 'banner', 'promo', 'sponsored', 'ad-box')}>{prose(1, 25)}</div>",
            lambda: f"<div{name('cookie-notice', 'notice', 'consent', 'popup', 'alert')}><p>{prose(3, 30)}</p>{pick(('', '<button>ok</button>'))}</div>",
            lambda: f"<form action='/x'><label>{_words(r, 2)}</label><input name='q'><button>{_words(r, 1)}</button></form>",
            lambda: f"<div{name('share', 'social', 'related', 'widget', 'tags')}>{pick((links(), link() + link(), prose(1, 12)))}</div>",
            lambda: f"<aside{name('', '', 'sidebar', 'related')}><h3>{_words(r, 2)}</h3>{pick(('<ul>' + links() + '</ul>', '<p>' + prose(3, 30) + '</p>'))}</aside>",
            lambda: f"<ins class='adsbygoogle'>{prose(1, 9)}</ins>", lambda: f"<noscript>{prose(3, 9)}</noscript>",
            lambda: f"<div{name('newsletter', 'subscribe', 'signup')}><p>{prose(3, 15)}</p><form><input><button>{_words(r, 1)}</button></form></div>",
        ))()

    def comments() -> str:
        one = lambda: f"<{(t := pick(('li', 'div', 'article')))}{name('comment', 'comment', 'reply')}><p>{prose(2, 50)}</p></{t}>"
        tag = pick(("section", "div", "ol"))
        return f"<{tag}{name('comments', 'commentlist', 'disqus', 'reader-comments', 'discussion')}><h2>{_words(r, 2)}</h2>{''.join(one() for _ in range(r.randrange(1, 5)))}</{tag}>"

    def block() -> str:
        return pick((
            *[lambda: f"<p{odd()}>{content()}</p>"] * 6, lambda: f"<p>{content(1, 4)}</p>", lambda: f"<h2{odd()}>{content(1, 8)}</h2>", lambda: f"<p><b>{content(1, 30)}<br>",
            lambda: "<ul>" + "".join(f"<li>{content(2, 20)}</li>" for _ in range(r.randrange(1, 5))) + "</ul>", lambda: f"<blockquote><p>{content()}</p></blockquote>",
            lambda: f"<div>{content()}</div>", lambda: f"<figure><img src=x><figcaption>{content(2, 12)}</figcaption></figure>", lambda: f"<pre>{content(3, 20)}</pre>",
            lambda: f"<table><tr><td>{content(1, 5)}</td><td>{content(1, 5)}</td></tr></table>",
        ))()

    title = f"<h1>{content(1, 12)}</h1>"
    body = [pick((title, title, title, f"<header>{title}</header>"))] if some(0.85) else []
    for _ in range(pick((0, 1, 1, 2, 3, 4, 6, 8, 12, 20))):
        body.append(block())
        if some(0.06):
            body.append(junk())
    if some(0.25):  # a few words are an article too
        body = [pick((lambda: f"<h1>{content(1, 4)}</h1>", lambda: f"<p>{content(1, 12)}</p>", lambda: f"<h1>{content(1, 4)}</h1><p>{content(1, 12)}</p>"))()]
    inside = "".join(body) + (comments() if some(0.12) else "")
    tag, attribute = pick((("article", ""), ("article", ""), ("article", name("post", "entry", "story")), ("main", ""), ("div", name("content", "article", "post-content", "entry-content", "main")), ("section", name("content", "article-body", "story"))))
    if bare and some(0.75):
        tag, attribute = "div", ""
        if not inside.startswith("<h1") and some(0.7):
            inside = f"{title}<p>{content(20, 60)}</p>{inside}"
    main = f"<{tag}{attribute}>{inside}</{tag}>"
    if some(0.2):
        main = f"<{(t := pick(('main', 'div', 'section')))}>{main}</{t}>"
    before = [pick((lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f"<div{name('menu', 'nav', 'navbar')}>{link()}{link()}{link()}</div>", lambda: f"<ul{name('menu', 'navigation')}>{links()}</ul>"))()] if some(0.9) else []
    if some(0.5):
        before.append(f"<header{name('', '', 'masthead')}>{pick((f'<h1>{_words(r, 2)}</h1>', link(), '<p>' + prose(2, 12) + '</p>'))}</header>")
    before += [junk() for _ in range(r.randrange(0, 3))]
    r.shuffle(before)
    after = [junk() for _ in range(r.randrange(0, 2))] + ([comments()] if some(0.35) else [])
    r.shuffle(after)
    foot = pick((lambda: f"<footer>&copy; {link()} &middot; {prose(1, 20)}</footer>", lambda: f"<footer><p>{prose(1, 20)}</p></footer>", lambda: f"<div{name('footer', 'copyright', 'legal')}>Copyright {prose(1, 10)}</div>", lambda: ""))()
    if bare and some(0.5):
        legal = lambda: pick((f"All rights reserved {r.randrange(1990, 2030)}", f"&copy; {r.randrange(1990, 2030)} {_words(r, 2)}", f"Copyright {_words(r, 3)}", f"{link()} | {link()} | {link()}"))
        side, advert = pick((f"<ul>{links()}</ul>", f"{link()}<br>{link()}<br>{link()}", f"<p>{link()}</p><p>{link()}</p>")), prose(2, 16)
        inner = main if some(0.5) else inside
        if some(0.5):  # a table as a frame
            cells = [f"<td>{side}</td>", f"<td>{inner}</td>", *([f"<td>{advert}</td>"] if some(0.6) else [])]
            if some(0.3):
                cells.reverse()
            return f"<html><body><table><tr>{''.join(cells)}</tr>{f'<tr><td>{legal()}</td></tr>' if some(0.5) else ''}</table></body></html>"
        top = pick((f"<div>{_words(r, 2)}</div>", f"<div>{link()} {link()} {link()} {link()}</div>", ""))
        return f"<html><body>{top}<div>{side}</div><div>{inner}</div>{f'<div>{advert}</div>' if some(0.4) else ''}<div>{legal()}</div></body></html>"
    if some(0.25):  # next to nothing but the article
        before, after = before[: r.randrange(2)], after[: r.randrange(2)]
        if some(0.5):
            return f"{''.join(before)}{main}{''.join(after)}"
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{prose(1, 9)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
    return f"{head}<body>{''.join(before)}<!-- x -->{main}{''.join(after)}{foot}{pick(('', '</body></html>'))}"


def labelled(pages: list[Page]) -> np.ndarray:
    """Labels of all nodes: a leaf by its mark (which goes), an element by most of its text."""
    out = []
    for p in pages:
        inside = np.zeros(len(p.parent))
        for i, leaf in enumerate(p.leaves):
            if _MARK in p.texts[i]:
                p.texts[i] = p.texts[i].replace(_MARK, "")
                p.size[leaf] -= 1
                inside[leaf] = p.size[leaf]
        size = np.array(p.size, float)
        for i in range(len(p.parent) - 1, 0, -1):
            inside[p.parent[i]] += inside[i]
            size[p.parent[i]] += size[i]
        out.append(inside * 2 > size)
    return np.concatenate(out).astype(int) if out else np.zeros(0, int)


@functools.lru_cache(2)
def train(n: int = 800, seed: int = 23, steps: int = 180, l2: float = 1e-4):
    """Node weights and edge potentials from n generated pages."""
    r = random.Random(seed)
    pages = [Page(training_page(r)) for _ in range(n)]
    y = labelled(pages)
    forest = Forest(pages)
    child = np.flatnonzero(forest.parent >= 0)
    gold = np.zeros((EDGES, 2, 2))
    np.add.at(gold, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
    w, e = np.zeros(N_FEATURES), np.zeros((EDGES, 2, 2))
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, e)]
    for step in range(1, steps + 1):
        p, pair = marginals(forest, w, e)
        seen = np.zeros_like(gold)
        np.add.at(seen, forest.edge[child], pair[child])
        for value, g, (first, second) in zip((w, e), (forest.x.T @ (y - p) / n - l2 * w, (gold - seen) / n - l2 * e), moments, strict=True):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            value += 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w, e


def texts(sources: list[str], w: np.ndarray, e: np.ndarray) -> list[str]:
    """The main texts of pages."""
    pages = [Page(s) for s in sources]
    content = marginals(Forest(pages), w, e)[0] if pages else []
    out, base = [], 0
    for p in pages:
        out.append("\n".join(t for leaf, t in zip(p.leaves, p.texts, strict=True) if content[base + leaf] >= 0.5))
        base += len(p.parent)
    return out


#: Pages whose trees are solved together.
TOGETHER = 256


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    model = train()  # fitted on the driver: under a hundred numbers

    def run(batches):
        w, e = model
        for batch in batches:
            for a in range(0, max(batch.num_rows, 1), TOGETHER):
                part = batch.slice(a, TOGETHER)
                found = texts([x.as_py() or "" for x in part.column(2)], w, e)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, OUT)
