"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block-level element of a page is a node with the label content or not. A node's potential comes from its tag, the words
of its class and id, its amount of text, links and punctuation, and its share of the page; a potential of parent and child
labels joins each node to its parent. Sum-product messages, upward from the leaves and downward from the root, give every
node's content marginal; the text blocks of nodes with a marginal of at least one half are the main text. The parameters
are fitted to labelled pages by gradient ascent on the conditional likelihood, with the same messages. The labelled pages
are written by ``labelled_pages`` from page templates, so the model needs no labels of the corpus and is the same for all runs;
own labelled pages can be given to ``fit``.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page order
by one line end; nothing else is dropped. Text of formulas, buttons and fallbacks counts as text where it stands. Null and
empty pages give an empty text; broken markup is read much as browsers do (implied ends, open elements closed at the end,
stray brackets as text). Pages of any length and depth take time in proportion to their length. Repeated rows give a row each, with
null ids and urls as they are; an empty table gives no rows; columns besides id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, col, fields, in_chunks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never markup; without an end tag it goes on to the end of the page, as in browsers.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that show no text of their own (pictures, form controls, inert markup), however they are nested.
HIDDEN = frozenset("template svg select datalist annotation annotation-xml".split())
#: Elements within a line, or around text that stays where it is (formulas, fallbacks of players and drawings).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button canvas cite code data del dfn em font i ins kbd label mark math audio video object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input"
    " mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded mphantom menclose mfenced semantics".split()
)
#: Elements whose start ends an open element of the same kind, as in HTML's implied end tags.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSABLE = frozenset(["p", *CLOSES])
SCOPE = frozenset("ul ol dl table body html div section article aside nav main form".split())
AROUND = frozenset("article main aside nav header footer form section".split())
_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/><]*+)|[!?])")
#: The rest of a tag in which quotes are paired.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
_MARK = re.compile(r"""data-y="?([01])""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Numeric references of any number of digits; the library's decoder refuses thousands of them.
_LONG_REFERENCE = re.compile(r"&#(?:0*+([0-9]{8,})|[xX]0*+([0-9a-fA-F]{7,})|(0{8,}+)(?=[0-9])|[xX](0{8,}+)(?=[0-9a-fA-F]));?")


def decoded(s: str) -> str:
    """s with its character references decoded, however long; numbers past the last code point are U+FFFD."""
    if "&" not in s:
        return s
    if "&#" in s:
        s = _LONG_REFERENCE.sub(lambda m: "\ufffd" if m[1] or m[2] else "&#" if m[3] else "&#x", s)
    return entities.unescape(s)


def parse(page: str, marks: list[str | None] | None = None) -> tuple[list[int], list[tuple], list[tuple[int, str, int]]]:
    """(parents, (tag, names of class and id, tag of the section around) of each node, (node, text, link characters) of each block).

    One scan: every character is passed once (and once more at the first tag whose quotes have no end: from there on a tag
    ends at its first bracket), and what an element ends or stands in is known from the element above it, so the
    time grows with the page, however it is nested. marks gets each node's data-y, if it has one.
    """
    parent, info, blocks = [-1], [("#root", (), "")], []
    stack = [0]
    #: For each open element where, up to the nearest element that bounds them, those stand that a start tag may end.
    near: list[dict[str, int]] = [{}]
    opened: dict[str, int] = {}
    text: list[str] = []
    links = in_link = 0
    hidden: list[str] = []
    hiding: dict[str, int] = {}  # how many of each are open
    ended: dict[str, int] = {}  # the last end tag of each
    lower = ""
    pos, last, paired = 0, page.rfind(">"), True

    def flush() -> None:
        nonlocal links
        if text:
            s = " ".join(decoded("".join(text)).split())
            if s:
                blocks.append((stack[-1], s, min(links, len(s))))
            text.clear()
        links = 0

    def add(s: str) -> None:
        nonlocal links
        if hidden:
            return
        text.append(s)
        if in_link:
            links += len(s.strip())

    def cut(k: int) -> None:
        """Close the open elements from number k on."""
        for i in range(k, len(stack)):
            opened[info[stack[i]][0]] -= 1
        del stack[k:], near[k:]

    while pos <= last:
        m = _START.search(page, pos)
        if not m or m.start() > last:
            break
        at = m.start()
        if at > pos:
            add(page[pos:at])
        name = m[2]
        if not name:  # a comment or a declaration
            end = page.find("-->", at + 4) if page.startswith("<!--", at) else page.find(">", at)
            pos = len(page) if end < 0 else end + (3 if page.startswith("<!--", at) else 1)
            continue
        rest = _REST.match(page, m.end()) if paired else None
        paired = paired and rest is not None
        pos = rest.end() if rest else page.find(">", m.end()) + 1
        attrs = page[m.end() : pos - 1]
        name, end = name.lower(), m[1]
        if name in RAW:
            if not end:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, pos)
                pos = page.find(">", close.end()) + 1 if close else 0
                pos = pos or len(page)
                add(" ")
            continue
        if name in HIDDEN:
            add(" ")
            if end:
                while hiding.get(name):
                    hiding[hidden[-1]] -= 1
                    if hidden.pop() == name:
                        break
            elif not attrs.endswith("/"):
                if name not in ended:
                    lower = lower or page.lower()
                    ended[name] = lower.rfind(f"</{name}")
                if ended[name] > pos:  # without an end tag it hides nothing
                    hidden.append(name)
                    hiding[name] = hiding.get(name, 0) + 1
            add(" ")
            continue
        if hidden:
            if hidden[-1] != "svg" or end or name not in BREAKS_OUT:
                continue
            hidden.clear()  # as in browsers, a block ends the drawings that it stands in
            hiding.clear()
        if name in INLINE or name in VOID:
            if name == "a":
                in_link = 0 if end else 1
            if name in ("br", "hr", "img", "input"):
                add(" ")
            if name == "hr":
                flush()
            continue
        flush()
        if end:
            if opened.get(name):
                k = len(stack) - 1
                while info[stack[k]][0] != name:
                    k -= 1
                cut(k)
                in_link = 0
            continue
        in_link = 0
        ends = max((near[-1].get(x, 0) for x in CLOSES.get(name, ())), default=0) or near[-1].get("p", 0)
        if ends:
            cut(ends)
        names = tuple(w.lower() for v in _ATTR.findall(attrs) for w in _NAME.findall(v))
        above = info[stack[-1]]
        parent.append(stack[-1])
        info.append((name, names, above[0] if above[0] in AROUND else above[2]))
        stack.append(len(parent) - 1)
        opened[name] = opened.get(name, 0) + 1
        near.append({} if name in SCOPE else near[-1] | {name: len(stack) - 1} if name in _CLOSABLE else near[-1])
        if marks is not None:
            marks.append(m[1] if (m := _MARK.search(attrs)) else None)
    add(page[pos:].partition("<!--")[0])
    flush()
    return parent, info, blocks


#: Starts of HTML blocks, which end a drawing that they stand in.
BREAKS_OUT = frozenset("article aside blockquote body center dd div dl dt footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split())


def _bin(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def node_features(parent: list[int], info: list[tuple], blocks: list[tuple[int, str, int]]) -> list[list[str]]:
    n = len(parent)
    own, own_links, own_points = [0] * n, [0] * n, [0] * n
    for k, s, links in blocks:
        own[k] += len(s)
        own_links[k] += links
        own_points[k] += sum(s.count(c) for c in ".,;:!?")
    whole, all_links, points = own[:], own_links[:], own_points[:]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        whole[p] += whole[k]
        all_links[p] += all_links[k]
        points[p] += points[k]
    total = max(1, whole[0])
    out = []
    for k, (tag, names, around) in enumerate(info):
        size = whole[k]
        f = ["bias", "t:" + tag, f"t:{tag}@{around}", f"size:{_bin(size, 1, 20, 60, 150, 400, 1500)}", f"own:{_bin(own[k], 1, 20, 60, 150, 400)}"]
        f.append(f"links:{_bin(all_links[k] / size if size else 0, 0.01, 0.2, 0.5, 0.8)}")
        f.append(f"points:{_bin(100 * points[k] / size if size else 0, 0.2, 0.8, 1.5)}")
        f.append(f"share:{_bin(size / total, 0.02, 0.1, 0.3, 0.6)}")
        f += ["c:" + w for w in set(names)]
        out.append(f)
    return out


class Forest:
    """Trees laid end to end, with their nodes by depth."""

    def __init__(self, parents: list[list[int]]) -> None:
        base, par, depth = 0, [], []
        for p in parents:
            d = [0] * len(p)
            for k in range(1, len(p)):
                d[k] = d[p[k]] + 1
            par += [x + base if x >= 0 else -1 for x in p]
            depth += d
            base += len(p)
        self.parent = np.array(par, np.int64)
        self.depth = np.array(depth, np.int64)
        self.n_levels = int(self.depth.max()) + 1 if len(depth) else 0
        self._levels: list[np.ndarray] | None = None

    @property
    def levels(self) -> list[np.ndarray]:
        if self._levels is None:
            order = np.argsort(self.depth, kind="stable")
            self._levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1]) if len(order) else []
        return self._levels

    def content(self, score: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Content marginals; trees of few nodes a level are passed node by node."""
        return self.marginals(score, pair)[0] if 16 * self.n_levels < len(score) else self._by_node(score, pair)

    def _by_node(self, score: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Messages as log odds, one node after the other: children stand behind their parents."""
        (a, b), (c, d) = pair.tolist()

        def log_add(x: float, y: float) -> float:
            return x + math.log1p(math.exp(y - x)) if x >= y else y + math.log1p(math.exp(x - y))

        parent, up = self.parent.tolist(), score.tolist()  # log odds of content from the node and what is below it
        message = [0.0] * len(up)
        for k in range(len(up) - 1, -1, -1):
            if (p := parent[k]) >= 0:
                u = up[k]
                message[k] = log_add(c, d + u) - log_add(a, b + u)
                up[p] += message[k]
        belief = up
        for k, p in enumerate(parent):
            if p >= 0:
                u = belief[p] - message[k]
                belief[k] += log_add(b, d + u) - log_add(a, c + u)
        return 1 / (1 + np.exp(np.clip(-np.array(belief), -60, 60)))

    def marginals(self, score: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """score: weight of content per node; pair[parent, child]. Content marginals, and joint marginals [node, parent, child]."""
        n = len(score)
        phi = np.zeros((n, 2))
        phi[:, 1] = score
        up, message = phi.copy(), np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            m = np.logaddexp(pair[None, :, 0] + up[level, 0, None], pair[None, :, 1] + up[level, 1, None])
            message[level] = m
            np.add.at(up, self.parent[level], m)
        joint = np.zeros((n, 2, 2))
        belief = up.copy()
        for level in self.levels[1:]:
            p = self.parent[level]
            cavity = belief[p] - message[level]
            j = cavity[:, :, None] + pair[None] + up[level][:, None, :]
            belief[level] += np.logaddexp(cavity[:, 0, None] + pair[None, 0], cavity[:, 1, None] + pair[None, 1])
            j -= j.max((1, 2), keepdims=True)
            j = np.exp(j)
            joint[level] = j / j.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


class Model:
    def __init__(self, features: dict[str, int], w: np.ndarray, pair: np.ndarray) -> None:
        self.features, self.w, self.pair = features, w, pair

    def texts(self, pages: list[str]) -> list[str]:
        parsed = [parse(p) for p in pages]
        score = []
        for parent, info, blocks in parsed:
            for f in node_features(parent, info, blocks):
                score.append(sum(self.w[k] for x in f if (k := self.features.get(x)) is not None))
        content = Forest([p for p, _, _ in parsed]).content(np.array(score), self.pair)
        out, base = [], 0
        for parent, _, blocks in parsed:
            out.append("\n".join(s for k, s, _ in blocks if content[base + k] >= 0.5))
            base += len(parent)
        return out


#: Words of classes and ids in the templates, for each kind of part.
NOISE_NAMES = {
    "nav": "nav navbar navigation menu menubar topnav breadcrumb breadcrumbs pagination pager toc submenu tabs links sitemap",
    "header": "header masthead topbar banner site logo branding top search",
    "footer": "footer bottom copyright colophon legal credits imprint",
    "sidebar": "sidebar side aside widget widgets rail related recommended popular trending tags archive teaser more",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay message warning subscribe newsletter paywall toast disclaimer privacy",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner dfp commercial outbrain taboola",
    "form": "form login signup register contact search newsletter feedback",
    "share": "share sharing social follow likes tools print buttons",
    "comments": "comment comments respond replies reply discussion disqus thread reactions guestbook",
}
CONTENT_NAMES = "content article post entry body text story main page blog single news hentry paragraph prose copy maincontent"


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """Pages with a label for each of the nodes that ``parse`` makes of them. Nodes marked ``data-y`` and what is in them, as marked."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v w".split() for b in "a e i o u".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + r.choice("...!?")
    prose = lambda a, b: " ".join(sentence().replace(" ", ", ", r.randint(0, 1)) for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def named(tag: str, names: str, y: int, inner: str) -> str:
        style = r.random()
        pick = " ".join(r.sample(names.split(), r.choice([1, 1, 2])))
        pick = pick.replace(" ", "-") if r.random() < 0.3 else pick
        attr = "" if style < 0.25 else f' class="{pick}"' if style < 0.8 else f' id="{pick.replace(" ", "-")}"'
        return f'<{tag}{attr} data-y="{y}">{inner}</{tag}>'

    def some_links() -> str:
        k = r.randint(2, 9)
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>" if r.random() < 0.7 else " | ".join(link() for _ in range(k))

    def noise(kind: str) -> str:
        names = NOISE_NAMES[kind]
        div = r.choice(["div", "div", "section"])
        if kind == "nav":
            return named(r.choice(["nav", "nav", "div", "ul"]), names, 0, some_links())
        if kind == "header":
            return named(r.choice(["header", "header", "div"]), names, 0, f"<p>{words(1, 4)}</p>" + (noise("nav") if r.random() < 0.5 else some_links()))
        if kind == "footer":
            return named(r.choice(["footer", "footer", "div"]), names, 0, r.choice([f"&copy; {words(1, 5)} &middot; {sentence()}", f"<p>&copy; {words(2, 6)}</p>" + some_links(), f"<p>{prose(1, 3)}</p>"]))
        if kind == "sidebar":
            return named(r.choice(["aside", "aside", "div", "section"]), names, 0, f"<h3>{words(1, 3)}</h3>" + r.choice([some_links(), f"<p>{prose(1, 3)}</p>", f"<p>{sentence()}</p>" + some_links()]))
        if kind == "form":
            return f'<form data-y="0"{r.choice(["", " class=" + r.choice(names.split())])}>' + f"<p>{words(2, 8)}</p><label>{words(1, 2)}</label><input name=q>" + r.choice(["", f"<div>{sentence()}</div>"]) + "</form>"
        if kind == "comments":
            one = lambda: named(r.choice(["div", "li", "article"]), "comment reply", 0, f"<p>{words(1, 2)}</p><p>{prose(1, 5)}</p>")
            return f'<{div} {r.choice(["class", "id"])}="{r.choice(names.split())}" data-y="0"><h3>{words(1, 3)}</h3>' + "".join(one() for _ in range(r.randint(1, 5))) + f"</{div}>"
        inner = r.choice([prose(1, 2), f"<p>{prose(1, 3)}</p>", f"{sentence()} {link()}", f"<p>{sentence()}</p><p>{link()}</p>"])
        return f'<{r.choice([div, "aside" if kind == "advert" else div])} {r.choice(["class", "class", "id"])}="{r.choice(names.split())}{r.choice(["", "", " " + word(), "-" + str(r.randint(1, 9))])}" data-y="0">{inner}</X>'

    def body() -> str:
        out = []
        for k in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.72:
                p = prose(1, 7)
                out.append(f"<p>{p}</p>" if r.random() < 0.85 else f"<p><b>{p}<br>")
            elif x < 0.8:
                out.append(f"<h2>{words(1, 7)}</h2>")
            elif x < 0.85:
                out.append("<ul>" + "".join(f"<li>{prose(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.88:
                out.append(f"<blockquote><p>{prose(1, 3)}</p></blockquote>")
            elif x < 0.91:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif x < 0.94:
                out.append(f"<p>{sentence()} {link()} {sentence()}</p>")
            elif x < 0.96:
                out.append(f"<pre>{words(5, 20)}</pre>")
            else:
                out.append(noise(r.choice(["advert", "share", "sidebar", "notice", "form"])))
        return "".join(out)

    pages = []
    for _ in range(n):
        head = f"<h1>{words(2, 10)}</h1>"
        inner = (f'<header data-y="1">{head}</header>' if r.random() < 0.15 else head) + body()
        if r.random() < 0.25:
            inner += noise("comments")
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        content = f'<{tag} data-y="1">{inner}</{tag}>' if tag in ("article", "main") and r.random() < 0.7 else named(tag, CONTENT_NAMES, 1, inner)
        before = [noise(k) for k in r.sample(["nav", "header", "advert", "notice", "form", "sidebar", "share"], r.randint(1, 5))]
        after = [noise(k) for k in r.sample(["footer", "sidebar", "comments", "advert", "notice", "nav", "form", "share"], r.randint(1, 5))]
        middle = content
        for _ in range(r.choice([0, 0, 1, 2])):
            extra = noise("sidebar") if r.random() < 0.4 else ""
            middle = f'<div{r.choice(["", " class=wrapper", " id=container", " class=row", " class=layout", " id=page"])} data-y="1">{middle}{extra}</div>'
        page = f"<!DOCTYPE html><html data-y=1><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body data-y=1><!-- x -->" + "".join(before) + middle + "".join(after) + ("</body></html>" if r.random() < 0.8 else "")
        page = _close(page)
        pages.append((re.sub(r' ?data-y="?[01]"?', "", page), _labels(page)))
    return pages


def _close(page: str) -> str:
    """Give each </X> the name of the element that it ends."""
    stack: list[str] = []

    def fix(m: re.Match) -> str:
        end, name = m.group(1), m.group(2)
        if not end:
            if name not in VOID and name not in ("p", "b", "li", "td", "tr"):
                stack.append(name)
            return m[0]
        if name in ("p", "b", "li", "td", "tr"):
            return m[0]
        return f"</{stack.pop()}>" if stack else ""

    return re.sub(r"<(/?)([A-Za-z][a-z0-9]*)[^>]*>", fix, page)


def _labels(page: str) -> list[bool]:
    """Labels of the nodes of a marked page: the nearest mark at or above."""
    marks: list[str | None] = ["1"]
    parent, _, _ = parse(page, marks)
    out: list[bool] = []
    for k, mark in enumerate(marks):
        out.append(mark == "1" if mark else out[parent[k]])
    return out


def fit(pages: list[tuple[str, list[bool]]], rounds: int = 120, rate: float = 0.1, decay: float = 2e-3, least: int = 3) -> Model:
    """Adam steps on the conditional log-likelihood of the node labels."""
    parsed = [parse(p) for p, _ in pages]
    rows = [f for x in parsed for f in node_features(*x)]
    count: dict[str, int] = {}
    for f in rows:
        for x in f:
            count[x] = count.get(x, 0) + 1
    features = {x: i for i, x in enumerate(sorted(x for x, c in count.items() if c >= least))}
    row = np.array([i for i, f in enumerate(rows) for x in f if x in features], np.int64)
    col = np.array([features[x] for f in rows for x in f if x in features], np.int64)
    y = np.array([v for _, labels in pages for v in labels], float)
    forest = Forest([p for p, _, _ in parsed])
    has = forest.parent >= 0
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[forest.parent[has]].astype(int), y[has].astype(int)), 1)
    gold_w = np.bincount(col, weights=y[row], minlength=len(features))
    theta = np.zeros(len(features) + 4)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, pair = theta[:-4], theta[-4:].reshape(2, 2)
        score = np.bincount(row, weights=w[col], minlength=len(rows))
        p, joint = forest.marginals(score, pair)
        g = np.concatenate([gold_w - np.bincount(col, weights=p[row], minlength=len(features)), (gold - joint.sum(0)).ravel()]) / len(pages) - decay * theta
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(features, theta[:-4], theta[-4:].reshape(2, 2))


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    sent = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))

    def run(batches):
        for batch, raw in in_chunks(batches, "html"):
            texts = sent.value.texts([r.decode("utf-8", "replace") for r in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    frame = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html"))
    return arrow_map(frame, run, fields(pages, {"page_id": id_col, "url": url_col}, "text string, n_chars long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
