"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A forgiving parser turns a page into leaf blocks, runs of text between block-level
boundaries, each with its ancestors' tags and what the words of their classes, ids and
roles hint at.  Ancestors are gathered on the way down, in sets of fixed size, so that a
page costs in proportion to its length, however deep it is.  What stands above the
innermost article is kept apart from what stands inside it, and words that articles
use too, or that stand in a longer name, are weak hints.  The field has two labels, text
and boilerplate; its features are those ancestors and what the block's own text looks
like.  It is trained on labelled pages and decoded by Viterbi; the main text is the
blocks labelled as text, one line each.

``labelled_pages`` builds pages whose labels are known because the builder wrote each
block as article or as something else; ``train`` takes any labelled pages.

Cases: null and empty pages, and pages without a block of text, give the empty string; a
null page_id or url is passed on.  Repeated pages give one row each, all with one text.
Equally likely labels go to boilerplate.  Unclosed, stray and misnested tags are read as
browsers do in the common cases.  The contents of scripts, styles, heads, templates and
form controls are never blocks.  Very long pages are read whole.  Other columns are kept,
whatever their names; an empty table gives none.
"""

from __future__ import annotations

import functools
import html as _html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head script style template textarea title select option optgroup button svg math canvas object audio video datalist iframe noembed noframes xmp".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
SCOPE = frozenset("ul ol dl table html body article section div nav aside header footer main form blockquote".split())

#: Words of classes, ids and roles, by what they hint at.
HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "head": "header masthead topbar branding logo hero top",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside rail widget widgets related recommended trending popular more tags",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsbygoogle",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall disclaimer toast",
    "form": "form search login signup subscribe newsletter signin contact",
    "comment": "comment comments reply replies discussion respond disqus",
    "share": "share sharing social follow",
    "main": "article content post entry main body story text prose markdown",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
#: Roles, which say what they mean.
ROLES = {
    "navigation": "nav", "banner": "head", "contentinfo": "foot", "complementary": "side", "alert": "notice", "alertdialog": "notice", "dialog": "notice", "status": "notice",
    "search": "form", "form": "form", "main": "main", "article": "main", "menu": "nav", "menubar": "nav", "note": "side",
}
#: Of the hints, words that names of articles' own parts have as well.
AMBIGUOUS = frozenset("hero top legal bottom side rail popular more tags promotion contact discussion respond reply social follow story text body".split())
#: Words that say nothing beside a hint.
LAYOUT = frozenset("site page left right box block wrapper wrap container inner outer list area item items links link section bar panel slot zone unit row col column the x id js posts articles stories news primary secondary global region group holder".split())


class Block:
    """A run of text.  ``inside`` and ``above`` tell of its ancestors, up to the innermost article and over it."""

    __slots__ = ("tag", "inside", "above", "hidden", "form", "pieces", "linked", "text")

    def __init__(self, at: _Open | None) -> None:
        self.tag = at.block if at else "body"
        self.inside, self.above = (at.inside, at.above) if at else (_NONE, _NONE)
        self.hidden = bool(at) and at.hidden
        self.form = at.form if at else 0
        self.pieces: list[str] = []
        self.linked = 0
        self.text = ""


_NONE: frozenset[str] = frozenset()


_TELLING = frozenset("nav header footer aside form article main section ul ol li table blockquote figure figcaption dialog menu address pre details a label".split())


class _Open:
    """An open element, and what it and the elements around it tell: sets over a fixed vocabulary."""

    __slots__ = ("tag", "inside", "above", "hidden", "linked", "never", "block", "form")

    def __init__(self, tag: str, over: _Open | None, attributes: str, forms: int) -> None:
        own, hidden = _hints(attributes) if attributes and not attributes.isspace() and tag not in ("html", "body") else (_NONE, False)
        inside, above = (over.inside, over.above) if over else (_NONE, _NONE)
        told = own | {f"in:{tag}"} if tag in _TELLING else own
        if tag in ("article", "main") or own == _MAIN:  # what is around an article tells little of its blocks
            inside, above = told - own | (own & _MAIN), above | inside | (own - _MAIN)
        elif told:
            inside = inside | told
        self.tag, self.inside, self.above = tag, inside, above
        self.hidden = hidden or bool(over) and over.hidden
        self.linked = tag == "a" or bool(over) and over.linked
        self.never = tag in NEVER or bool(over) and over.never
        self.block = tag if tag in BLOCK else over.block if over else "body"
        self.form = forms if tag == "form" else over.form if over else 0


_MAIN = frozenset(["hint:main"])
_VALUES = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _told(name: str) -> str | None:
    """What one name (a class, id or role) hints at, as a feature."""
    words = [w.lower() for w in _WORDS.findall(name)]
    kinds = {_HINT[w] for w in words if w in _HINT}
    if not kinds:
        return None
    clear = [w for w in words if w in _HINT and w not in AMBIGUOUS]
    rest = [w for w in words if w not in _HINT and w not in LAYOUT]
    others = kinds - {"main"}
    if not others:
        return "hint:main" if clear and not rest else "maybe:main"
    kind = min(others, key=lambda k: next(i for i, w in enumerate(words) if _HINT.get(w) == k))
    sure = not rest and ("main" not in kinds or len(clear) > 1) and any(_HINT[w] != "main" for w in clear)
    return f"hint:{kind}" if sure or len(others) > 1 and not rest else f"maybe:{kind}"


@functools.lru_cache(4096)
def _hints(attributes: str) -> tuple[frozenset[str], bool]:
    """What the names of a start tag hint at, and whether it hides its content."""
    found, hidden = set(), False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            found.update(f"hint:{ROLES[x]}" for x in value.lower().split() if x in ROLES)
        elif name in ("class", "id", "itemprop", "aria-label"):
            found.update(t for x in (value.split() if name != "aria-label" else [value]) if (t := _told(x)))
        elif name == "style" and _UNSEEN.search(value) or name == "aria-hidden" and value == "true":
            hidden = True
    return frozenset(found), hidden or bool(_HIDDEN.search(_VALUES.sub("", attributes)))


def blocks(page: str) -> list[tuple[Block, str]]:
    """The leaf blocks of a page, in order, with their text."""
    out: list[Block] = []
    stack: list[_Open] = []
    # where elements of each tag, and those that bound scopes and blocks, are open: no search walks the stack
    where: dict[str, list[int]] = {}
    scopes: list[int] = []
    walls: list[int] = []
    now: Block | None = None
    at, size, forms = 0, len(page), 0

    def text(raw: str) -> None:
        nonlocal now
        over = stack[-1] if stack else None
        if not raw or over and over.never:
            return
        said = _html.unescape(raw) if "&" in raw else raw
        if now is None:
            if said.isspace():
                return
            now = Block(over)
            out.append(now)
        now.pieces.append(said)
        if over and over.linked:
            now.linked += len(said.strip())

    def close(k: int) -> None:
        nonlocal now
        for e in reversed(stack[k:]):
            where[e.tag].pop()
            if e.tag in SCOPE:
                scopes.pop()
            if e.tag in BLOCK:
                walls.pop()
                now = None
        del stack[k:]

    def last(places: list[int] | None) -> int:
        return places[-1] if places else -1

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag == "br":
                text(" ")
                continue
            k = last(where.get(tag))
            if k >= 0 and (tag in SCOPE or k > last(scopes)):  # a stray end tag closes nothing around it
                close(k)
            if tag in BLOCK:
                now = None
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in BLOCK:
            now = None
            k = last(where.get("p"))
            if k >= 0 and k >= last(walls):  # a block ends an open paragraph
                close(k)
        if tag in CLOSES:
            while (k := max((last(where.get(t)) for t in CLOSES[tag]), default=-1)) > last(scopes):
                close(k)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            if end:
                at = page.find(">", end.end()) + 1 or size
            continue
        if attributes.endswith("/") and tag not in BLOCK and tag in ("svg", "math", "path", "g"):
            continue
        forms += tag == "form"
        where.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        if tag in BLOCK:
            walls.append(len(stack))
        stack.append(_Open(tag, stack[-1] if stack else None, attributes, forms))
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
    return [(b, b.text) for b in out if b.text]


def features(found: list[tuple[Block, str]]) -> list[list[str]]:
    """The active features of each block."""
    out, n = [], len(found)
    whole = sum(len(t) for _, t in found)
    formed: dict[int, int] = {}
    for b, t in found:
        formed[b.form] = formed.get(b.form, 0) + len(t)
    for i, (b, t) in enumerate(found):
        words = t.count(" ") + 1
        linked = b.linked / max(1, len(t))
        shape = "links" if linked > 0.8 else "prose" if words >= 12 and linked < 0.3 else "short"
        wide = b.form and formed[b.form] > 0.6 * whole  # a form around most of the page is no form
        f = ["bias", f"tag:{b.tag}", f"shape:{shape}"]
        for x in b.inside:
            if x == "in:form" and wide:
                continue
            f.append(x)
            if x.startswith("maybe:"):
                f.append(f"{x}&{shape}")
        for x in b.above:
            if x != "in:form" or not wide:
                f.append(f"over:{x}")
        if "in:header" in b.inside:
            f.append("header-in-article" if b.inside & _ARTICLE else "header-outside")
        if not b.inside & _ARTICLE and "hint:main" not in b.inside:
            f.append("outside")
        if b.hidden:
            f.append("hidden")
        f.append(f"words:{min(6, int(math.log2(words)))}")
        f.append("links:all" if linked > 0.8 else "links:some" if linked > 0.3 else "links:none")
        if t[-1] in ".!?…。:;\"'»)":
            f.append("ends")
        if "©" in t or "copyright" in t.lower():
            f.append(f"copyright&{shape}")
        if words >= 20 and linked < 0.3:
            f.append("prose")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        out.append(f)
    return out


_ARTICLE = frozenset(["in:article", "in:main"])


class Field:
    """Weights of features by label, and of transitions; label 1 is text."""

    def __init__(self, names: list[str]) -> None:
        self.index = {x: i for i, x in enumerate(names)}
        self.w = np.zeros((len(names), 2))
        self.t = np.zeros((2, 2))

    def emissions(self, fs: list[list[str]]) -> np.ndarray:
        index, w = self.index, self.w
        return np.array([w[[index[x] for x in f if x in index]].sum(axis=0) for f in fs]).reshape(len(fs), 2)

    def decode(self, fs: list[list[str]]) -> list[int]:
        """The most likely labels of all blocks together (Viterbi)."""
        if not fs:
            return []
        e = self.emissions(fs).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            p, q = a + t00 >= b + t10, a + t01 > b + t11
            back.append((0 if p else 1, 0 if q else 1))
            a, b = (a + t00 if p else b + t10) + x, (a + t01 if q else b + t11) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def gradient(self, fs: list[list[int]], labels: list[int], gw: np.ndarray, gt: np.ndarray) -> float:
        """Adds the gradient of one page's log likelihood; returns the log likelihood."""
        e = np.array([self.w[f].sum(axis=0) for f in fs])
        n = len(fs)
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        fwd[0] = e[0]
        for i in range(1, n):
            fwd[i] = np.logaddexp(fwd[i - 1, 0] + self.t[0], fwd[i - 1, 1] + self.t[1]) + e[i]
        for i in range(n - 2, -1, -1):
            x = bwd[i + 1] + e[i + 1]
            bwd[i] = np.logaddexp(self.t[:, 0] + x[0], self.t[:, 1] + x[1])
        z = np.logaddexp(*fwd[-1])
        p = np.exp(fwd + bwd - z)
        score = 0.0
        for i in range(n):
            gw[fs[i]] -= p[i]
            gw[fs[i], labels[i]] += 1
            score += e[i, labels[i]]
            if i:
                both = fwd[i - 1][:, None] + self.t + (e[i] + bwd[i])[None, :] - z
                gt -= np.exp(both)
                gt[labels[i - 1], labels[i]] += 1
                score += self.t[labels[i - 1], labels[i]]
        return score - z


def train(pages: list[tuple[str, list[str]]], epochs: int = 8, rate: float = 0.5, l2: float = 1e-4, seed: int = 0) -> Field:
    """A field from labelled pages: (html, the texts of its article blocks).  AdaGrad on single pages."""
    made = []
    for page, article in pages:
        found = blocks(page)
        left = {}
        for t in article:
            left[t] = left.get(t, 0) + 1
        labels = []
        for _, t in found:
            good = left.get(t, 0) > 0
            left[t] = left.get(t, 0) - good
            labels.append(int(good))
        if found:
            made.append((features(found), labels))
    field = Field(sorted({x for fs, _ in made for f in fs for x in f}))
    data = [([[field.index[x] for x in f] for f in fs], labels) for fs, labels in made]
    order, rng = list(range(len(data))), random.Random(seed)
    sw, st = np.full_like(field.w, 1e-6), np.full_like(field.t, 1e-6)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            gw, gt = -l2 * field.w, -l2 * field.t
            field.gradient(*data[i], gw, gt)
            sw += gw * gw
            st += gt * gt
            field.w += rate * gw / np.sqrt(sw)
            field.t += rate * gt / np.sqrt(st)
    return field


def labelled_pages(n: int = 360, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages of many layouts whose article blocks are known."""
    rng = random.Random(seed)

    def phrase(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def prose(lo: int = 1, hi: int = 90) -> str:
        return phrase(lo, hi).capitalize() + rng.choice([".", ".", ".", "!", "?", "", ":"])

    def links(k: int, wrap: bool = True) -> str:
        each = [f'<a href="/{phrase(1, 1)}">{phrase(1, 3)}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if wrap else " | ".join(each)

    def named(*names: str) -> str:
        names = tuple(n for n in names if n not in AMBIGUOUS) or names
        return rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f" class='x {rng.choice(names)}-{rng.choice(sorted(LAYOUT))}'"])

    def loose() -> str:
        """A name that has a hint in it, of something else: the article is about it, or its part is so called."""
        hint, other = rng.choice(list(_HINT)), phrase(1, 1)
        return rng.choice([f' class="{hint}-{other}"', f' id="{other}-{hint}"', f' class="{rng.choice(sorted(AMBIGUOUS))}"', f' class="{other}"'])

    def boiler(kind: str) -> str:
        long = rng.random() < 0.5
        body = prose(15, 60) if long else phrase(2, 9)
        inner = rng.choice([f"<p>{body}</p>", body, f"<div>{body}</div>", f"<p>{body}</p>", body, f'<div class="{rng.choice(["content", "inner-content", "body", "text"])}"><p>{body}</p></div>'])
        return {
            "nav": lambda: rng.choice([f"<nav>{links(rng.randint(2, 9))}</nav>", f"<div{named('menu', 'nav', 'breadcrumb')}>{links(rng.randint(2, 6), rng.random() < 0.6)}</div>"]),
            "header": lambda: rng.choice([f"<header><h2>{phrase(1, 4)}</h2>{inner}</header>", f"<div{named('header', 'masthead')}><a href=/>{phrase(1, 3)}</a>{inner}</div>"]),
            "footer": lambda: rng.choice([f"<footer>{rng.choice(['&copy; ', '', 'Copyright '])}{inner}</footer>", f"<div{named('footer')}>{inner}{links(3)}</div>"]),
            "side": lambda: rng.choice([f"<aside><h3>{phrase(1, 3)}</h3>{inner}{links(3)}</aside>", f"<div{named('sidebar', 'widget', 'related')}><h3>{phrase(1, 4)}</h3>{links(4)}{inner}</div>"]),
            "ad": lambda: f"<div{named('ad', 'ads', 'advert', 'promo', 'sponsored', 'banner')}>{inner}</div>",
            "notice": lambda: rng.choice([f"<div{named('cookie', 'consent', 'notice', 'alert')}>{inner}</div>", f"<dialog open>{inner}</dialog>", f'<div role="alert">{inner}</div>']),
            "form": lambda: f"<form{rng.choice(['', named('search', 'newsletter', 'login')])}>{rng.choice(['<label>' + phrase(1, 3) + '</label>', inner])}<input name=q><button>{phrase(1, 2)}</button></form>",
            "comments": lambda: rng.choice([
                f"<section{named('comments')}><h3>{phrase(1, 2)}</h3>" + "".join(f"<div class=comment><b>{phrase(1, 2)}</b><p>{prose()}</p></div>" for _ in range(rng.randint(1, 4))) + "</section>",
                f"<ol{named('comments', 'comment-list', 'replies')}>" + "".join(f"<li>{prose()}</li>" for _ in range(rng.randint(1, 4))) + "</ol>",
            ]),
            "share": lambda: f"<div{named('share', 'social')}>{links(3, rng.random() < 0.5)}</div>",
            "hidden": lambda: f'<div style="display:none">{inner}</div>',
        }[kind]()

    out = []
    for _ in range(n):
        article: list[str] = []

        def say(text: str, article: list[str] = article) -> str:
            article.append(" ".join(text.split()))
            return text

        parts = []
        title = f"<h1>{say(phrase(2, 12).capitalize())}</h1>"
        headed = rng.random()
        parts.append(f"<header>{title}</header>" if headed < 0.2 else title if headed < 0.85 else "")
        if headed >= 0.85:
            article.pop()
        for _ in range(rng.randint(1, 12)):
            r = rng.random()
            if r < 0.62:
                r = rng.random()
                if r < 0.12:
                    parts.append(f"<div{loose()}><p>{say(prose(15))}</p></div>")
                else:
                    parts.append(f"<p>{say(prose())}</p>" if r < 0.85 else f"<p><b>{say(prose())}<br>")
            elif r < 0.72:
                parts.append(f"<h{(k := rng.randint(2, 4))}>{say(phrase(1, 8).capitalize())}</h{k}>")
            elif r < 0.79:
                parts.append("<ul>" + "".join(f"<li>{say(prose(1, 20))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.84:
                parts.append(f"<blockquote>{say(prose())}</blockquote>")
            elif r < 0.87:
                parts.append("<table>" + "".join(f"<tr><td>{say(phrase(1, 4))}</td><td>{say(phrase(1, 4))}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif r < 0.9:
                parts.append(f"<div>{say(prose(5))}</div>")
            else:
                parts.append(boiler(rng.choice(["ad", "side", "share", "form", "notice", "hidden", "nav"])))
        if rng.random() < 0.25:
            parts.append(boiler(rng.choice(["comments", "share", "side", "footer"])))
        inner = "".join(parts)
        if rng.random() < 0.3:  # parts of articles have names that hint at other things
            inner = f"<div{loose()}>{inner}</div>"
        outer = rng.choice([
            "<article>{}</article>", "<article>{}</article>", f"<article{loose()}>{{}}</article>", f"<div{loose()}><article>{{}}</article></div>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>',
            '<div id="main-content"><div class="post">{}</div></div>', '<section class="entry-content">{}</section>', "<div>{}</div>", "{}",
        ])
        before = "".join(boiler(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "nav"], rng.randint(0, 4)))
        after = "".join(boiler(k) for k in rng.sample(["comments", "side", "footer", "ad", "form", "share", "nav", "footer"], rng.randint(0, 4)))
        body = f"{before}{outer.replace('{}', inner)}{after}"
        if rng.random() < 0.12:
            body = f"<form action=/ id=aspnetForm>{body}</form>"
        kind = rng.choice(["", "", "", ' class="single has-sidebar no-header"', f"{loose()}"])
        page = f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title><style>p{{}}</style></head><body{kind}>{body}</body></html>"
        out.append((page, article))
    return out


@functools.cache
def trained() -> Field:
    """The field trained on ``labelled_pages``; made once in a process."""
    return train(labelled_pages())


def main_text(page: str | None, field: Field) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(t for (_, t), label in zip(found, field.decode(features(found)), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None, into: str = "main_text") -> DataFrame:
    """``pages`` with a column ``into``, from ``html`` alone.

    Where ``pages`` has a column of that name, it stays and the new one's name gets underscores.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())  # a few hundred weights

    @F.pandas_udf("string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(None if pd.isna(x) else x, shared.value) for x in batch], dtype=object)

    return pages.select("*", udf(F.col("html").cast("string")).alias(free_name(into, pages.columns)))
