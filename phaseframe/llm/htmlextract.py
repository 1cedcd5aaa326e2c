"""Main-text extraction: gradient-boosted trees over DOM-node features.

A page is parsed into its block elements and text runs (void, raw-text and
unclosed elements as browsers treat them). Each node gets features: tag family,
attribute tokens of its own and of its ancestors, depth, subtree text and link
density, sibling statistics and its share of the page. Boosted trees give the
probability that a node holds main text. Decoding is hierarchical: over the
whole tree the most likely labelling is found in which everything below a
dropped node is dropped, so an ancestor and a descendant never contradict.

The trees are trained in the driver from a seeded generator of page layouts, so
no page of the input is a training row and the model is the same for any input;
it is a few thousand numbers.

Scale: pages are independent rows (``mapInPandas`` without an exchange), worked
off in small slices of a batch; a very long page is one row's memory, and depth
of nesting costs no recursion.

Text of elements that are hidden, block or inline, is left out, as are labels of buttons and what stands in place of
media; that of formulas and drawings stays in its block. Elements of unknown names with a hyphen count as inline.

Defined results: null or empty html gives an empty text, as does a page without
main text; a text without markup is a page of one block; repeated rows give
repeated results; null ids and urls pass through; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as _html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import slim_batches, tidy

#: Families of HTML elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr picture".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math select object canvas button video audio".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Of RAW, those that a browser doesn't carry on to the end of a page without a closing tag.
UNCLOSED = frozenset("svg math select object canvas button video audio".split())
#: An opening tag closes open elements of these names, up to the nearest of the stops.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, {"html"}),
}
#: Attribute tokens by what they usually name.
TOKENS = {
    "ad": "ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored sponsors dfp adsense",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toolbar skip toc topbar links",
    "head": "header head masthead logo branding top site-header hero",
    "foot": "footer foot copyright legal colophon bottom credits disclaimer imprint",
    "side": "sidebar side aside widget widgets rail related recommended recommendations more trending popular teaser teasers complementary outbrain taboola",
    "comment": "comment comments reply replies respond discussion disqus responses thread feedback commentlist reviews",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall subscribe subscription newsletter signup banner-cookie message warning toast dialog",
    "form": "form login search signin register contact input survey poll",
    "share": "share sharing social tags tag tools buttons follow print meta byline author date",
    "main": "article articlebody content main post entry body story text page-content maincontent prose post-content entry-content article-body",
}
_TOKEN = {w: k for k, (name, ws) in enumerate(TOKENS.items()) for w in ws.split()}
N_CAT = len(TOKENS)
FAMILY = {
    t: k
    for k, ts in enumerate(
        (
            "article main", "section div center td th tr tbody table details fieldset body html",
            "p blockquote pre figcaption summary address #text", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol li dl dt dd menu",
            "nav", "header", "footer", "aside", "form button option dialog", "figure",
        )
    )
    for t in ts.split()
}
N_FAM = 11

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?",
    re.S,
)
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDES = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_STYLE_HIDES = re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|[^\s\"'>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_SVG_TEXT = re.compile(r"<text\b[^>]*>(.*?)</text\s*>", re.I | re.S)
_ANNOTATION = re.compile(r"<(annotation(?:-xml)?)\b.*?</\1\s*>", re.I | re.S)
_ANY_TAG = re.compile(r"<[^>]*>")


@functools.lru_cache(4096)
def _is_hidden(attrs: str) -> bool:
    """Whether an element isn't shown: a ``hidden`` attribute or a style that says so."""
    return bool(_HIDES.search(_QUOTED.sub('""', attrs)) or _STYLE_HIDES.search(attrs))


def _drawn(tag: str, inner: str) -> str:
    """What a page shows of the text inside a formula or a drawing."""
    if tag == "math":
        return _ANY_TAG.sub(" ", _ANNOTATION.sub(" ", inner))
    return _ANY_TAG.sub(" ", " ".join(_SVG_TEXT.findall(inner))) if tag == "svg" else ""


@functools.lru_cache(4096)
def _categories(attrs: str) -> tuple[int, bool]:
    """Bits of the token families named in the attributes, and whether the element is hidden."""
    bits = 0
    for m in _ATTR.finditer(attrs):
        value = (m[1] or m[2] or m[3] or "").lower()
        for word in {*value.split(), *re.split(r"[^a-z]+", value)}:
            if (k := _TOKEN.get(word)) is not None:
                bits |= 1 << k
    return bits, bool(_HIDDEN.search(attrs))


class Page:
    """Block tree of a page, as parallel lists; node 0 is the root.

    A node has a tag, parent, attribute bits, and text if it is a run. Nodes are
    in page order, parents before children.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.bits, self.text, self.link = ["#root"], [-1], [0], [""], [0]
        self._parse(source)

    def _add(self, tag: str, parent: int, bits: int, text: str = "", link: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.bits.append(bits)
        self.text.append(text)
        self.link.append(link)
        return len(self.tag) - 1

    def _parse(self, src: str) -> None:
        stack, names, counts = [0], ["#root"], {}
        run: list[str] = []
        in_link, link = False, 0
        at, n = 0, len(src)
        unseen: list = []  # of a hidden inline element: its tag, open ones of that tag, depth of the stack
        dark = 0  # depth of the outermost hidden block element, 0 for none

        def flush() -> None:
            nonlocal run, link
            if run:
                text = " ".join(_html.unescape("".join(run)).split())
                if text and not dark:
                    self._add("#text", stack[-1], 0, text, min(link, len(text)))
                run, link = [], 0

        def pop_to(depth: int) -> None:
            nonlocal unseen, dark
            while len(stack) > depth:
                stack.pop()
                counts[names.pop()] -= 1
            if depth < dark:
                dark = 0
            if unseen and depth < unseen[2]:  # its block has ended
                unseen = []

        while at < n:
            m = _TAG.search(src, at)
            if m is None:
                stop = n
            else:
                stop = m.start()
            if stop > at and not unseen:
                piece = src[at:stop]
                run.append(piece)
                if in_link:
                    link += len(piece)
            if m is None:
                break
            at = m.end()
            end, start = m[1], m[2]
            if start:
                tag = start.lower()
                if tag in INLINE or "-" in tag:
                    if unseen:
                        unseen[1] += tag == unseen[0]
                    elif m[3] and tag not in VOID and _is_hidden(m[3]) and not m[3].rstrip().endswith("/"):
                        unseen = [tag, 1, len(stack)]
                    if tag == "a":
                        in_link = True
                    continue
                if tag in VOID:
                    if tag == "br":
                        run.append(" ")
                    elif tag == "hr":
                        flush()
                    continue
                attrs = m[3] or ""
                if tag in RAW:
                    if not attrs.rstrip().endswith("/"):
                        close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(src, at)
                        if close and not unseen and not _is_hidden(attrs) and (seen := _drawn(tag, src[at : close.start()])).strip():
                            run.append(f" {seen} ")
                        at = close.end() if close else at if tag in UNCLOSED else n
                    if tag == "title":
                        flush()
                    continue
                flush()
                in_link = False
                if tag in CLOSES_P and names[-1] == "p":
                    pop_to(len(stack) - 1)
                if tag in SIBLINGS:
                    same, stops = SIBLINGS[tag]
                    if any(counts.get(s) for s in same):
                        k = len(names) - 1
                        last = None
                        while k > 0 and names[k] not in stops:
                            if names[k] in same:
                                last = k
                            k -= 1
                        if last is not None:
                            pop_to(last)
                if tag in ("html", "body") and counts.get(tag):
                    continue
                bits, hidden = _categories(attrs) if attrs else (0, False)
                if hidden or unseen or tag == "head":
                    bits |= 1 << (N_CAT)
                stack.append(self._add(tag, stack[-1], bits))
                names.append(tag)
                if not dark and attrs and tag not in ("html", "body") and _is_hidden(attrs):
                    dark = len(stack)
                counts[tag] = counts.get(tag, 0) + 1
            elif end:
                tag = end.lower()
                if tag in INLINE or "-" in tag:
                    if unseen and tag == unseen[0]:
                        unseen[1] -= 1
                        unseen = unseen if unseen[1] else []
                    if tag == "a":
                        in_link = False
                    continue
                if tag == "br":
                    run.append(" ")
                    continue
                if counts.get(tag):
                    flush()
                    in_link = False
                    k = len(names) - 1
                    while names[k] != tag:
                        k -= 1
                    pop_to(k)
                else:
                    flush()
        flush()


FEATURES = (
    [f"family_{k}" for k in range(N_FAM)]
    + [f"token_{k}" for k in TOKENS]
    + ["hidden"]
    + [f"above_{k}" for k in TOKENS]
    + ["above_main_tag", "above_boiler_tag", "depth", "log_text", "link_share", "log_runs", "text_per_node", "page_share",
       "parent_share", "position", "log_siblings", "like_siblings", "stops", "page_has_main", "block_children", "below_p", "below_li"]
)
_BOILER_TAGS = frozenset("nav header footer aside form dialog".split())


def features(page: Page) -> np.ndarray:
    tag, parent, bits, text, link = page.tag, page.parent, page.bits, page.text, page.link
    n = len(tag)
    chars, links, runs, nodes, stops, paras, items = ([0] * n for _ in range(7))
    kids: list[list[int]] = [[] for _ in range(n)]
    depth, above, main_above, boiler_above = [0] * n, [0] * n, [0] * n, [0] * n
    page_main = 0
    for i in range(1, n):
        p = parent[i]
        kids[p].append(i)
        depth[i] = depth[p] + 1
        above[i] = above[p] | bits[p]
        t = tag[p]
        main_above[i] = main_above[p] or t == "article" or t == "main"
        boiler_above[i] = boiler_above[p] or t in _BOILER_TAGS
        if tag[i] == "article" or tag[i] == "main":
            page_main = 1
        if text[i]:
            x = text[i]
            chars[i], links[i], runs[i] = len(x), link[i], 1
            stops[i] = x.count(".") + x.count(",")
        elif tag[i] == "p":
            paras[i] = 1
        elif tag[i] == "li":
            items[i] = 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        runs[p] += runs[i]
        nodes[p] += nodes[i] + 1
        stops[p] += stops[i]
        paras[p] += paras[i]
        items[p] += items[i]
    total = max(1, chars[0])
    out = np.zeros((n, len(FEATURES)), np.float32)
    place, like, sibs = [0.0] * n, [0.0] * n, [1] * n
    for ks in kids:
        m = len(ks)
        if not m:
            continue
        seen: dict[str, int] = {}
        for k in ks:
            seen[tag[k]] = seen.get(tag[k], 0) + 1
        for j, k in enumerate(ks):
            place[k] = j / m
            sibs[k] = m
            like[k] = seen[tag[k]] / m
    fam = np.array([FAMILY.get(t, -1) for t in tag])
    known = np.flatnonzero(fam >= 0)
    out[known, fam[known]] = 1
    b, a = np.array(bits), np.array(above)
    at = N_FAM
    for k in range(N_CAT + 1):
        out[:, at + k] = (b >> k) & 1
    at += N_CAT + 1
    for k in range(N_CAT):
        out[:, at + k] = (a >> k) & 1
    at += N_CAT
    par = np.maximum(np.array(parent), 0)
    chars_, links_, runs_ = np.array(chars, float), np.array(links, float), np.array(runs, float)
    cols = (
        main_above, boiler_above, depth, np.log1p(chars_), links_ / np.maximum(chars_, 1), np.log1p(runs_),
        np.log1p(chars_ / (np.array(nodes) + 1)), chars_ / total, chars_ / np.maximum(chars_[par], 1), place,
        np.log1p(np.array(sibs)), like, np.array(stops) / np.maximum(chars_, 1) * 50, np.full(n, page_main),
        [len(k) for k in kids], np.log1p(np.array(paras)), np.log1p(np.array(items)),
    )
    for k, c in enumerate(cols):
        out[:, at + k] = c
    return out


class BoostedTrees:
    """Complete trees of one depth, fitted by Newton boosting of the logistic loss on quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, bins: int = 32):
        self.trees, self.depth, self.rate, self.ridge, self.bins = trees, depth, rate, ridge, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], axis=1)
        width, inner = self.bins + 1, (1 << self.depth) - 1
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        margin = np.full(n, self.base)
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.cut = np.full((self.trees, inner), np.inf, np.float32)
        self.leaf = np.zeros((self.trees, inner + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                gain = np.full((count, f, width), -np.inf)
                for j in range(f):
                    key = (node - first) * width + binned[:, j]
                    gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                    hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    score = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    score[(hs < 1) | (ht - hs < 1)] = -np.inf
                    score[:, len(cuts[j]) :] = -np.inf
                    gain[:, j] = score
                flat = gain.reshape(count, -1)
                best = flat.argmax(axis=1)
                ok = flat[np.arange(count), best] > 1e-6
                fj, bj = best // width, best % width
                for k in np.flatnonzero(ok):
                    self.feature[t, first + k] = fj[k]
                    self.cut[t, first + k] = cuts[fj[k]][bj[k]]
                k = node - first
                right = ok[k] & (binned[np.arange(n), fj[k]] > bj[k])
                node = 2 * node + 1 + right
            leaf = node - inner
            gs = np.bincount(leaf, g, inner + 1)
            hs = np.bincount(leaf, h, inner + 1)
            self.leaf[t] = -self.rate * gs / (hs + self.ridge)
            margin += self.leaf[t][leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        n, inner = len(x), (1 << self.depth) - 1
        out = np.full(n, self.base)
        rows = np.arange(n)
        for t in range(self.trees):
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.cut[t][node])
            out += self.leaf[t][node - inner]
        return out


def decode(page: Page, margin: list[float]) -> list[bool]:
    """The likeliest labelling in which nothing below a dropped node is kept.

    Against dropping everything below, a kept node gains its margin and the
    gains of those children for which keeping pays.
    """
    n = len(page.tag)
    below = [0.0] * n
    for i in range(n - 1, 0, -1):
        gain = margin[i] + below[i]
        if gain > 0:
            below[page.parent[i]] += gain
    keep = [False] * n
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and margin[i] + below[i] > 0
    return keep


# ---------------------------------------------------------------- training pages

MARK = ""


def _layout(rng: random.Random) -> str:
    """One page of a random layout; main text runs carry MARK."""
    syll = "ta re mi on es der la qu en ch ou st ver al ni po se".split()

    def words(a: int, b: int) -> str:
        ws = ["".join(rng.choices(syll, k=rng.randint(1, 4))) + rng.choice(["", "", "", "", "", ",", "."]) for _ in range(rng.randint(a, b))]
        if rng.random() < 0.06:
            return " ".join(ws).upper() + "!!"
        return (" ".join(ws)).capitalize() + rng.choice([".", ".", "", "!"])

    def link(a: int = 1, b: int = 3) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{words(a, b)}</a>'

    def attr(kind: str | None) -> str:
        if kind is None or rng.random() < 0.15:
            return rng.choice(["", "", f' class="{"".join(rng.choices(syll, k=2))}"', f' id="x{rng.randint(1, 99)}"'])
        token = rng.choice(TOKENS[kind].split()[:8])
        token = rng.choice([token, token, f"{token}-{rng.choice(syll)}", f"{rng.choice(syll)}-{token}", f"{token} {rng.choice(syll)}"])
        return rng.choice([f' class="{token}"', f' id="{token}"', f' class="{token}" id="{rng.choice(syll)}"'])

    def para(mark: str = "", long: bool = True) -> str:
        size = rng.choice([(1, 6), (5, 25), (20, 80), (40, 160)]) if long else (2, 25)
        body = mark + words(*size)
        if rng.random() < 0.15:
            body += " " + link() + " " + words(2, 8)
        if rng.random() < 0.15:
            body = "<b>" + body + rng.choice(["<br>", "</b>"])
        return f"<p>{body}" + rng.choice(["</p>", "</p>", "</p>", ""])

    def ul(n: int, linked: bool, mark: str = "") -> str:
        one = lambda: f"<li>{link() if linked else mark + words(2, 14)}" + rng.choice(["</li>", "</li>", ""])
        return "<ul>" + "".join(one() for _ in range(n)) + "</ul>"

    def box(kind: str, tag: str, inner: str) -> str:
        if tag and rng.random() < 0.45:
            return f"<{tag}{attr(kind) if rng.random() < 0.4 else ''}>{inner}</{tag}>"
        t = rng.choice(["div", "div", "section"])
        a = attr(kind)
        if not a:
            a = f' class="{rng.choice(TOKENS[kind].split()[:6])}"'
        return f"<{t}{a}>{inner}</{t}>"

    def junk(kind: str) -> str:
        if kind == "ad":
            return box("ad", "", rng.choice([words(2, 25), link(2, 6), para("", False), f"<p>{link(2, 8)}</p>"]))
        if kind == "nav":
            return box("nav", "nav", rng.choice([ul(rng.randint(2, 10), True), " ".join(link() for _ in range(rng.randint(2, 8)))]))
        if kind == "head":
            return box("head", "header", rng.choice([f"<h1>{words(1, 4)}</h1>", link(), f"<div>{words(1, 5)}</div>"]) + rng.choice(["", ul(4, True), f"<p>{words(2, 10)}</p>"]))
        if kind == "foot":
            text = rng.choice(["&copy; ", ""]) + words(2, 8) + rng.choice([" &middot; ", " "]) + words(1, 25)
            return box("foot", "footer", rng.choice([text, f"<p>{text}</p>", text + ul(3, True), para("", False)]))
        if kind == "side":
            return box("side", "aside", rng.choice([f"<h3>{words(1, 3)}</h3>", ""]) + rng.choice([ul(rng.randint(2, 8), True), para("", False), para() + ul(3, True), f"<div>{words(3, 30)}</div>"]))
        if kind == "comment":
            one = lambda: rng.choice([f'<div{attr("comment")}>{para("", False)}</div>', para("", False), f"<li>{words(2, 30)}</li>", f"<article{attr('comment')}>{para('', False)}</article>"])
            return box("comment", "", rng.choice([f"<h2>{words(1, 3)}</h2>", ""]) + "".join(one() for _ in range(rng.randint(1, 6))))
        if kind == "notice":
            return box("notice", "dialog", rng.choice([words(4, 30), para("", False), f"<p>{words(4, 20)}</p><button>{words(1, 2)}</button>"]))
        if kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name=x><button>{words(1, 2)}</button>" + rng.choice(["", f"<p>{words(3, 15)}</p>"])
            return f"<form{attr('form') if rng.random() < 0.5 else ''}>{inner}</form>"
        return box("share", "", " ".join(link(1, 1) for _ in range(rng.randint(2, 6))))

    parts = [rng.choice([f"<h1>{MARK}{words(3, 10)}</h1>", f"<h1>{MARK}{words(3, 10)}</h1>", ""])]
    n = rng.choice([0, 1, 2, 3, 5, 8, 12, 20])
    for _ in range(n):
        r = rng.random()
        if r < 0.78:
            parts.append(para(MARK))
        elif r < 0.84:
            parts.append(f"<h2>{MARK}{words(1, 6)}</h2>")
        elif r < 0.88:
            parts.append(ul(rng.randint(2, 6), False, MARK))
        elif r < 0.92:
            parts.append(f"<blockquote>{para(MARK)}</blockquote>")
        elif r < 0.95:
            parts.append(f"<div>{MARK}{words(3, 60)}</div>")
        elif r < 0.97:
            parts.append("<table>" + "".join(f"<tr><td>{MARK}{words(1, 4)}</td><td>{MARK}{words(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            parts.append(f"<pre>{MARK}{words(3, 30)}</pre>")
    if rng.random() < 0.45:
        for kind in rng.sample(["ad", "share", "side", "form", "comment", "notice", "nav", "foot"], rng.randint(1, 3)):
            where = len(parts) if kind in ("comment", "foot", "share") else rng.randint(0, len(parts))
            parts.insert(where, junk(kind))
    main = "".join(parts)
    style = rng.random()
    if style < 0.5:
        main = f"<article{attr('main') if rng.random() < 0.3 else ''}>{main}</article>"
    elif style < 0.65:
        main = f"<main>{main}</main>"
    elif style < 0.92:
        t = rng.choice(["div", "section"])
        main = f"<{t}{attr('main')}>{main}</{t}>"
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        t = rng.choice(["div", "div", "main", "section"])
        before, after = (junk(rng.choice(["ad", "nav", "share"])) if rng.random() < 0.2 else "" for _ in "ab")
        main = f"<{t}{attr(rng.choice([None, 'main']))}>{before}{main}{after}</{t}>"
    before = "".join(junk(k) for k in rng.sample(["head", "nav", "ad", "notice", "form", "side", "share"], rng.randint(0, 4)))
    after = "".join(junk(k) for k in rng.sample(["side", "comment", "foot", "ad", "notice", "form", "nav"], rng.randint(0, 4)))
    head = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>"
    return head + before + main + after + rng.choice(["</body></html>", ""])


@functools.lru_cache(1)
def trained(pages: int = 1500, seed: int = 7) -> BoostedTrees:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = Page(_layout(rng))
        n = len(page.tag)
        label = [False] * n
        for i, t in enumerate(page.text):
            if t.startswith(MARK) or MARK in t:
                label[i] = True
                page.text[i] = t.replace(MARK, "")
        for i in range(n - 1, 0, -1):
            if label[i]:
                label[page.parent[i]] = True
        has = np.array([bool(t) for t in page.text])
        for i in range(n - 1, 0, -1):
            has[page.parent[i]] |= has[i]
        has[0] = False
        xs.append(features(page)[has])
        ys.append(np.array(label, float)[has])
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract_texts(sources: list[str], model: BoostedTrees) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    margin = model.margin(np.concatenate([features(p) for p in pages])).tolist()
    out, at = [], 0
    for p in pages:
        n = len(p.tag)
        keep = decode(p, margin[at : at + n])
        out.append("\n\n".join(t for t, k in zip(p.text, keep) if k and t))
        at += n
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text."""
    model = trained()
    rows = slim_batches(pages).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.iloc[lo : lo + 128]
                texts = extract_texts(["" if h is None else h for h in part["html"]], model)
                yield part[["page_id", "url"]].assign(text=texts)

    return rows.mapInPandas(tidy(run), "page_id long, url string, text string")
