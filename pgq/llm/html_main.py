"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down.

A tolerant parser builds the tree in one pass forward; open elements are found by their tag, never by looking through the
stack, so time is linear in a page's length whatever is left open in it.  Every element gets features: its text and link text
and that of its subtree, density, tag kind, tokens of its class, id and role, depth, and how it compares with its siblings.
Tokens count by two lists of common words and by what training pages say of them: the log odds that an element with the
token holds main text.  Boosted trees give the probability that an element holds main text.  Decoding picks the likeliest
labelling in which no element is kept whose ancestor is not, by dynamic programming over the tree, so ancestor and
descendants never contradict each other.

The trees are trained when first needed, on pages written by `page()` here with known labels: no table holds any.

Defined results: null html counts as empty; a page without main text gives the empty string; very long and deeply nested
pages are read whole; a tag that is never closed before the page ends is text, and from the first such tag on quotes no longer
hide a `>`; repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(class|id|role|itemprop|aria-label|data-testid)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object select xmp noembed".split())
_SILENT = _RAW | frozenset("head button input option datalist canvas audio video map dialog".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
GOOD = frozenset("article articlebody main content post entry story body text copy prose markdown page rich".split())
BAD = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs crumbs header masthead topbar footer foot colophon sidebar side aside rail widget related recommended recommendations more share sharing social follow comment comments reply replies discussion disqus respondents feedback cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search legal copyright disclaimer pagination pager tags meta byline author toolbar skip tracking teaser trending popular outbrain taboola".split()
)
_TAGS = ("p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "blockquote", "pre", "table", "tr", "td", "figure", "figcaption", "a", "span", "body", "html", "dl", "dt", "dd", "b", "i", "em", "strong", "code", "address", "label")
_TAG = {t: i + 1 for i, t in enumerate(_TAGS)}
_KIND = {**dict.fromkeys("nav aside footer form menu address dialog".split(), -1.0), **dict.fromkeys("article main blockquote p pre h1 h2 h3 h4 figure".split(), 1.0)}


class Tree:
    """Elements in page order; content: (element, text) or (element, None) at a line break."""

    __slots__ = ("tag", "parent", "depth", "attrs", "content")

    def __init__(self):
        self.tag, self.parent, self.depth, self.attrs, self.content = ["#"], [-1], [0], [""], []


class _Open:
    """Open elements, by place and by tag."""

    def __init__(self, t: Tree):
        self.t, self.stack, self.at = t, [0], {}

    def push(self, me: int) -> None:
        self.at.setdefault(self.t.tag[me], []).append(len(self.stack))
        self.stack.append(me)

    def pop(self) -> None:
        self.at[self.t.tag[self.stack.pop()]].pop()

    def last(self, names) -> int:
        """Place of the innermost open element of these names, 0 for none."""
        return max((x[-1] for n in names if (x := self.at.get(n))), default=0)

    def close(self, names, stop=()) -> None:
        """Close the innermost of these, and what is open in it, unless one of `stop` lies further in."""
        i = self.last(names)
        if i > self.last(stop):
            while len(self.stack) > i:
                self.pop()


def parse(page: str | None) -> Tree:
    t, s, at, pos = Tree(), page or "", 0, 0
    end, loose = len(s), False
    open_ = _Open(t)

    def text(x: str) -> None:
        if x:
            t.content.append((open_.stack[-1], _html.unescape(x)))

    def after(mark: str, start: int) -> int:
        i = s.find(mark, start)
        return i + len(mark) if i >= 0 else end

    def tag_end(start: int) -> int:
        """Where the tag's > is: outside quotes; a quote without its pair is a plain character."""
        nonlocal loose
        i = start
        while not loose:
            m = _STOP.search(s, i)
            if not m:
                loose = True
            elif m[0] == ">":
                return m.start()
            else:
                pair = s.find(m[0], m.end())
                i = pair + 1 if pair >= 0 else m.end()
        return s.find(">", start)

    while (lt := s.find("<", pos)) >= 0:
        m = _NAME.match(s, lt + 1)
        if s.startswith(("<!", "<?"), lt):
            text(s[at:lt])
            if s.startswith("<!--", lt):
                at = pos = after("-->", lt + 4)
            elif s.startswith("<![CDATA[", lt):
                at = pos = after("]]>", lt + 9)
                inner = s[lt + 9 : at - 3 if s.endswith("]]>", lt + 9, at) else at]
                if inner:
                    t.content.append((open_.stack[-1], inner))
            else:
                at = pos = after(">", lt)
            continue
        gt = tag_end(m.end()) if m else -1
        if not m or gt < 0:
            if m:  # no > is left: the rest is text
                break
            pos = lt + 1
            continue
        text(s[at:lt])
        at = pos = gt + 1
        name, attrs = m[2].lower(), s[m.end() : gt]
        if m[1]:
            if name == "br":
                t.content.append((open_.stack[-1], " "))
            else:
                open_.close((name,), ("body", "html") if name in _INLINE else ())
            continue
        if name == "br":
            t.content.append((open_.stack[-1], " "))
            continue
        if name in ("html", "body") and open_.last((name,)):
            continue
        if name in _BLOCKS:
            open_.close(("p",), ("td", "th", "button", "object", "table"))
            if name in ("body", "div", "article", "main", "nav", "header", "section") and t.tag[open_.stack[-1]] == "head":
                open_.pop()
        if name == "body":
            open_.close(("head",))
        if name in _CLOSES:
            also, stop = _CLOSES[name]
            for _ in range(2):
                open_.close(also.split(), stop)
        me = len(t.tag)
        t.tag.append(name)
        t.parent.append(open_.stack[-1])
        t.depth.append(t.depth[open_.stack[-1]] + 1)
        t.attrs.append(" ".join(x[1] or x[2] or x[3] for x in _ATTR.findall(attrs)) if attrs else "")
        if name in _VOID or attrs.rstrip().endswith("/") and name not in _BLOCKS and name not in _INLINE:
            continue
        if name in _RAW:
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(s, at)
            at = pos = found.end() if found else end
            continue
        open_.push(me)
    text(s[at:])
    return t


FEATURES = 37


def features(t: Tree, told: dict[str, float] | None = None) -> np.ndarray:
    """told: log odds of attribute tokens, from training pages."""
    n = len(t.tag)
    parent = np.array(t.parent)
    own, links, marks, words = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for e, x in t.content:
        k = len(x.strip())
        if k and t.tag[e] not in _SILENT:
            own[e] += k
            marks[e] += x.count(".") + x.count(",") + x.count("!") + x.count("?") + x.count(";")
            words[e] += x.count(" ") + 1
    good, bad, tag, kind = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    inline, odds, odds_up = np.zeros(n), np.zeros(n), np.zeros(n)
    told = told or {}
    for i in range(n):
        parts = _PART.findall(t.attrs[i].lower()) if t.attrs[i] else ()
        odds[i] = sum(told.get(p, 0.0) for p in parts)
        good[i] = sum(p in GOOD for p in parts)
        bad[i] = sum(p in BAD for p in parts)
        tag[i] = _TAG.get(t.tag[i], 0)
        kind[i] = _KIND.get(t.tag[i], 0.0)
        inline[i] = t.tag[i] in _INLINE
        if t.tag[i] == "a":
            links[i] = 1
    all_text, all_marks, all_words, all_tags, blocks, link_text = own.copy(), marks.copy(), words.copy(), np.ones(n), (1 - inline), np.zeros(n)
    in_link = np.zeros(n, bool)
    bad_up, good_up, kind_up, bad_kind_up = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    paras = np.array([x == "p" for x in t.tag], "f8")
    for i in range(1, n):
        p = parent[i]
        in_link[i] = in_link[p] or links[i]
        bad_up[i] = bad_up[p] + bad[i]
        odds_up[i] = min(odds_up[p], odds[i])
        good_up[i] = good_up[p] + good[i]
        kind_up[i] = kind_up[p] + (t.tag[i] in ("article", "main"))
        bad_kind_up[i] = bad_kind_up[p] + (kind[i] < 0)
    link_text[in_link] = own[in_link]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for x in (all_text, all_marks, all_words, all_tags, blocks, link_text, paras):
            x[p] += x[i]
    kids = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    index, seen, same = np.zeros(n), {}, {}
    for i in range(1, n):
        index[i] = seen.get(parent[i], 0)
        seen[parent[i]] = index[i] + 1
        same[parent[i], t.tag[i]] = same.get((parent[i], t.tag[i]), 0) + 1
    up = np.maximum(parent, 0)
    total = max(1.0, all_text[0])
    twins = np.array([1.0, *(same[parent[i], t.tag[i]] for i in range(1, n))])
    return np.stack([
        np.log1p(own), np.log1p(all_text), all_text / total, link_text / np.maximum(all_text, 1), all_text / all_tags, all_marks / np.maximum(all_words, 1),
        all_text / np.maximum(all_words, 1), np.log1p(all_tags), np.array(t.depth), tag, kind, good, bad, bad_up, good_up, kind_up, bad_kind_up,
        kids, index, kids[up], index / np.maximum(kids[up], 1), all_text / np.maximum(all_text[up], 1), twins, twins / np.maximum(kids[up], 1),
        tag[up], kind[up], bad[up], good[up], np.log1p(all_text[up]), link_text[up] / np.maximum(all_text[up], 1), paras, np.log1p(paras[up]), np.log1p(all_marks), inline,
        odds, odds_up, odds[up],
    ], 1)


class Boosted:
    """Gradient-boosted regression trees on the log loss, over features cut into 32 ranks."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25):
        self.trees, self.depth, self.rate = trees, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        z, self.model = np.full(len(y), self.base), []
        n_f = x.shape[1]
        flat = b + np.arange(n_f) * 32
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), "i8"), []
            for level in range(self.depth):
                k = 1 << level
                at = (node[:, None] * n_f * 32 + flat).ravel()
                gs = np.bincount(at, np.repeat(g, n_f), k * n_f * 32).reshape(k, n_f, 32).cumsum(2)
                hs = np.bincount(at, np.repeat(h, n_f), k * n_f * 32).reshape(k, n_f, 32).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1)
                gain[:, :, -1] = (gt**2 / (ht + 1))[:, :, 0]
                best = gain.reshape(k, -1).argmax(1)
                f, c = best // 32, best % 32
                tree.append((f, c))
                node = node * 2 + (b[np.arange(len(y)), f[node]] > c[node])
            leaf = np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + 1) * self.rate
            z += leaf[node]
            self.model.append((tree, leaf))
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree, leaf in self.model:
            node = np.zeros(len(x), "i8")
            for f, c in tree:
                node = node * 2 + (b[rows, f[node]] > c[node])
            z += leaf[node]
        return z


def page(rng: np.random.Generator) -> tuple[str, str]:
    """A page of one of many layouts and its main text.  Main text blocks carry a mark that training takes out."""
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p
    syl = ["ka", "lo", "mi", "ter", "an", "es", "du", "ri", "vo", "né", "sch", "on", "the", "ing"]

    def sentence(lo=4, hi=18):
        w = ["".join(pick(*syl) for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(lo, hi))]
        return " ".join(w).capitalize() + pick(".", ".", ".", "!", "?", ",", "")

    def prose(lo=1, hi=6):
        return " ".join(sentence() for _ in range(rng.integers(lo, hi)))

    def few():
        return " ".join(pick(*syl) + pick(*syl) for _ in range(rng.integers(1, 4)))

    def classed(tag, names, body, p=0.8):
        attr = f' {pick("class", "class", "id")}="{pick(*names)}"' if names and chance(p) else ""
        return f"<{tag}{attr}>{body}</{tag}>"

    menu = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{few()}</a></li>' for i in range(rng.integers(2, 12))) + "</ul>"
    links = lambda: " ".join(f'<a href="#">{few()}</a>' for _ in range(rng.integers(2, 8)))
    nav = lambda: pick(classed("nav", ["menu", "navbar"], menu(), 0.4), classed("div", ["nav", "menu", "navigation"], menu()), classed("div", ["breadcrumbs"], links()))
    ad = lambda: classed(pick("div", "aside", "section", "div"), ["ad", "ads", "advert", "sponsored", "promo", "banner"], pick(prose(1, 3), f"<p>{prose(1, 3)}</p>", f'<a href="#">{sentence()}</a>'), 0.97)
    notice = lambda: classed("div", ["cookie-notice", "notice", "alert", "consent", "newsletter", "popup"], pick(prose(1, 3), f"<p>{prose(1, 3)}</p><button>OK</button>"), 0.97)
    form = lambda: f'<form action="/s"><label>{few()}</label><input name="q"><p>{sentence()}</p><button>{few()}</button></form>'
    side = lambda: pick(classed("aside", ["sidebar", "widget", "related"], f"<h3>{few()}</h3>" + pick(menu(), f"<p>{prose()}</p>", f"<p>{sentence()}</p>" + menu()), 0.5), classed("div", ["sidebar", "related", "widget", "rail"], f"<h4>{few()}</h4>" + pick(menu(), f"<p>{prose()}</p>"), 0.97))
    comments = lambda: classed(pick("section", "div", "ol"), ["comments", "comment-list", "discussion", "replies"], f"<h3>{few()}</h3>" * chance(0.7) + "".join(classed(pick("div", "article", "li"), ["comment", "reply"], pick(f"<p>{prose(1, 4)}</p>", f"<b>{few()}</b><p>{prose(1, 5)}</p>"), 0.8) for _ in range(rng.integers(1, 7))), 0.97)
    header = lambda: pick(classed("header", ["masthead", "header"], f"<h1>{few()}</h1>" * chance(0.3) + nav() + f"<p>{sentence()}</p>" * chance(0.4), 0.4), classed("div", ["header", "topbar"], f"<p>{sentence()}</p>" + links()))
    footer = lambda: pick(classed("footer", ["footer"], pick(f"&copy; {few()} &middot; {prose(1, 3)}", f"<p>&copy; {prose(1, 3)}</p>", links()), 0.2), classed("div", ["footer", "copyright", "legal"], f"<p>{prose(1, 3)}</p>", 0.97))
    share = lambda: classed("div", ["share", "social", "tags", "toolbar"], pick(links(), few()), 0.97)

    said: list[str] = []

    def main(tag, body=None, loose=False):
        x = body if body is not None else pick(prose(1, 3), prose(1, 7), prose(3, 9), sentence(1, 4), few())
        said.append(x)
        if chance(0.15):
            w = x.split(" ")
            i = int(rng.integers(len(w)))
            w[i] = pick(f"<b>{w[i]}</b>", f'<a href="/x">{w[i]}</a>', f"<em>{w[i]}</em>")
            x = " ".join(w)
        bold = chance(0.2) and tag == "p"
        return f"<{tag} data-y>{'<b>' * bold}{x}{'<br>' * bold}" + ("" if (loose and tag in ("p", "li")) or bold and chance(0.5) else f"</{tag}>")

    loose = chance(0.2)
    body = []
    if chance(0.75):
        body.append(main(pick("h1", "h1", "h2"), sentence(2, 9)))
    for _ in range(rng.integers(1, 14)):
        kind = rng.random()
        if kind < 0.72:
            body.append(main("p", loose=loose))
        elif kind < 0.8:
            body.append(main(pick("h2", "h3"), sentence(1, 7)))
        elif kind < 0.85:
            tag = pick("ul", "ol")
            body.append(f"<{tag}>" + "".join(main("li", sentence(2, 12), loose) for _ in range(rng.integers(2, 6))) + f"</{tag}>")
        elif kind < 0.89:
            body.append(f"<blockquote>{main('p')}</blockquote>" if chance(0.6) else main("blockquote"))
        elif kind < 0.92:
            body.append("<table>" + "".join("<tr>" + "".join(main("td", few()) for _ in range(2)) + "</tr>" for _ in range(3)) + "</table>")
        elif kind < 0.95:
            body.append(ad())
        elif kind < 0.975:
            body.append(share())
        else:
            body.append(main(pick("pre", "div")))
    names = ["content", "main", "post", "entry-content", "article-body", "story"]
    whole = "".join(body)
    if chance(0.15):
        whole = f'<img src="a.png" alt="{few()}">' + whole
    whole = pick(lambda: classed("article", names, whole, 0.3), lambda: classed("article", names, whole, 0.2), lambda: classed("main", names, whole, 0.3), lambda: classed("div", names, whole, 0.8), lambda: f"<main>{classed('article', names, whole, 0.3)}</main>", lambda: classed("section", names, whole, 0.6), lambda: f"<div>{classed('div', names, whole, 0.7)}</div>")()
    if chance(0.35):
        cut = pick("</article>", "</main>", "</div>")
        extra = pick(comments, share, comments)()
        whole = whole[: whole.rindex(cut)] + extra + whole[whole.rindex(cut) :] if whole.endswith(cut) and chance(0.5) else whole + extra
    before = "".join(x() for x, p in ((header, 0.4), (nav, 0.7), (notice, 0.2), (ad, 0.4), (form, 0.1)) if chance(p))
    after = "".join(x() for x, p in ((side, 0.4), (ad, 0.2), (comments, 0.2), (form, 0.15), (notice, 0.1), (footer, 0.75)) if chance(p))
    if chance(0.3):
        whole = side() + whole
    if chance(0.3):
        whole = f'<div class="{pick("wrapper", "container", "row", "page")}">{whole}</div>'
    script = '<script>var t="</p><p>";track(1);</script>' * chance(0.6)
    return f"<!DOCTYPE html><html><head><title>{few()}</title>{script}</head><body>{before}{whole}{after}" + "</body></html>" * chance(0.9), " ".join(said)


def labelled(src: str) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The tree of a page of page() without its marks, what of it is main, and what may be learned from."""
    marked = parse(src.replace(" data-y>", ' class="yyy">'))
    y = np.array([a == "yyy" for a in marked.attrs], bool)
    up = y.copy()
    for i in range(len(y) - 1, 0, -1):  # what holds main text, or stands in it, is main
        up[marked.parent[i]] |= up[i]
    for i in range(1, len(y)):
        if marked.tag[i] in _INLINE and marked.parent[i] >= 0 and y[marked.parent[i]]:
            y[i] = up[i] = True
    return parse(src.replace(" data-y>", ">")), up, np.array([t not in _SILENT for t in marked.tag])


def token_odds(pages: list[tuple[Tree, np.ndarray, np.ndarray]]) -> dict[str, float]:
    """Log odds that an element whose class, id or role has a token holds main text, against any element."""
    seen: dict[str, list[float]] = {}
    whole = [1.0, 1.0]
    for t, up, use in pages:
        for i in np.flatnonzero(use).tolist():
            whole[int(up[i])] += 1
            for p in set(_PART.findall(t.attrs[i].lower())) if t.attrs[i] else ():
                seen.setdefault(p, [1.0, 1.0])[int(up[i])] += 1
    return {p: float(np.log(n[1] / n[0]) - np.log(whole[1] / whole[0])) for p, n in seen.items()}


class Model(Boosted):
    """Trees, and the log odds of tokens that their features read."""

    told: dict[str, float]


_TRAINED: list[Model] = []


def model(pages: int = 350, seed: int = 3) -> Model:
    """The trees, trained once a process on pages of known main text; tokens by the odds of the other half of the pages."""
    if not _TRAINED:
        rng = np.random.default_rng(seed)
        made = [labelled(page(rng)[0]) for _ in range(pages)]
        halves = [token_odds(made[1::2]), token_odds(made[::2])]
        xs = [features(t, halves[i % 2])[use] for i, (t, _, use) in enumerate(made)]
        trees = Model().fit(np.concatenate(xs), np.concatenate([up[use] for _, up, use in made]).astype("f8"))
        trees.told = token_odds(made)
        _TRAINED.append(trees)
    return _TRAINED[0]


def decode(t: Tree, logit: np.ndarray) -> np.ndarray:
    """Elements kept in the likeliest labelling in which every kept element's parent is kept."""
    n = len(t.tag)
    logit = np.where(np.array([x in _SILENT for x in t.tag]), -50.0, np.clip(logit, -20, 20))
    gain = logit.copy()  # over leaving the whole subtree out
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[t.parent[i]] += gain[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[t.parent[i]] and gain[i] > 0
    return keep


def text_of(t: Tree, keep: np.ndarray) -> str:
    block = list(range(len(t.tag)))
    for i in range(1, len(t.tag)):
        if t.tag[i] in _INLINE:
            block[i] = block[t.parent[i]]
    out: list[str] = []
    now, held = None, []
    last = 0
    for e, x in t.content:
        edge = block[e] != now or any(t.tag[i] not in _INLINE for i in range(last + 1, e + 1))
        last = max(last, e)
        if edge and held:
            out.append("".join(held))
            held = []
        now = block[e]
        if keep[e]:
            held.append(x)
    out.append("".join(held))
    return " ".join(y for y in (" ".join(x.split()) for x in out) if y)


def extract(src: str | None, trees: Model) -> str:
    t = parse(src)
    return text_of(t, decode(t, trees.logit(features(t, trees.told)))) if t.content else ""


def _extracted(trees: Model):
    def run(batches):
        for b in batches:
            parsed = [parse(x) for x in b.column(2).to_pylist()]
            for lo in range(0, len(parsed), 200):
                part = parsed[lo : lo + 200]
                x = [features(t, trees.told) for t in part]
                z = np.split(trees.logit(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1])
                text = [text_of(t, decode(t, a)) for t, a in zip(part, z, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 200), b.column(1).slice(lo, 200), pa.array(text, pa.string()), pa.array([len(s) for s in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    C.prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extracted(model()), "page_id long, url string, text string, n_chars long")


def op5(spark, sf_dir: str) -> DataFrame:
    return main_text(C.table(spark, sf_dir, "pages"))
