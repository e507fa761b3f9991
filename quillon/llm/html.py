"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements, and leaves for the text runs between block boundaries (inline elements don't part a run;
br is white space in it). Each node is content or not. A node's potential comes from its tag, from the words of its class, id and
role (told apart by whether the element holds the page's title or, in several runs, most of its prose, since layouts and topics are named with the
same words as side matters), from what lies below it, from a heading like "3 comments" before it, and for leaves from the run's
length, punctuation, share of links and place. Each parent-child edge has a potential of both labels, by the kind of child.
Messages passed up and then down the tree (sum-product, exact on a tree) give each node's marginal. All potentials are trained by
gradient on the conditional likelihood of labelled pages; these are made by `labelled_pages`, whose templates mark each run as
article or not, and training, level by level over all pages at once, takes a few seconds on the driver. Runs with a marginal of one
half or more are the text, in page order.

Null and empty html give an empty text, as does html without a content run; markup may be broken. Scripts, styles, titles,
comments and the like never become runs; a comment or script that is never closed runs to the end of the page. Very long pages are
parsed whole, in time that grows with their length. A marginal of exactly one half (a tie) counts as content. Repeated rows,
page_ids and null ids are extracted row by row; only page_id, url and html are read, so further columns of any name don't matter.
An empty table gives no row.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import texts

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|</?[a-zA-Z][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "select", "object", "canvas", "audio", "video", "button", "noembed", "noframes", "xmp", "datalist"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SPACES = set("br wbr img input hr".split())
VOID = set("area base col embed link meta param source track".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "aside", "nav", "body", "main"}
HEADINGS = {f"h{i}" for i in range(1, 7)}
CLOSE = {t: re.compile(f"</{t}(?![a-zA-Z0-9-])", re.I) for t in RAW}
TAGS = {t: i for i, ts in enumerate(["article", "main", "nav", "header", "footer", "aside", "form fieldset dialog menu", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "li dt dd", "ul ol dl", "table thead tbody tr td th caption", "figure figcaption", "blockquote pre", "html body head"]) for t in ts.split()}
WHOLE, SIDE_TAGS = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu"}
NAMED = [
    "article post entry story main content body text prose chapter",
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc skip tabs toolbar",
    "sidebar side aside rail complementary widget widgets related recommended recommendations trending popular more promo promoted teaser",
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors adsense adslot commercial",
    "comment comments commenter reply replies respond discussion disqus feedback review reviews thread",
    "cookie cookies consent gdpr notice notification alert popup modal overlay dialog warning message privacy",
    "footer foot copyright legal contentinfo bottom colophon",
    "header head masthead top logo brand topbar site",
    "form login signin signup register subscribe newsletter search input contact",
    "share sharing social follow meta byline tags tag categories author bio date time print",
]
WORD_GROUP = {w: i for i, ws in reversed(list(enumerate(NAMED))) for w in ws.split()}
#: Headings (or lines of their own) after which their parent holds reader comments, or other stories and the like.
COMMENTS_HEAD = re.compile(r"\W*(?:no|one|\d+|leave an?|post an?|add an?|join the|reader|readers'?|your|show|view|all)?\W*(?:comments?|responses?|repl(?:y|ies)|thoughts? on\b.*|discussion|conversation|feedback|what (?:do )?(?:you|readers) (?:think|say)|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)\W*(?:\d+|below)?\W*", re.I)
OTHERS_HEAD = re.compile(r"\W*(?:related|recommended|more|further|similar|popular|trending|latest|most|you (?:may|might)|also (?:on|in|by)|read (?:next|more|also)|up next|share|follow|about the author|tags?|categories|filed under|newsletter|subscribe|sign up|advertisement|sponsored|ähnliche|mehr|weitere|à lire|voir aussi|articles liés|relacionad[oa]s|más)\b.{0,40}", re.I)
PATTERNS = [
    re.compile(r"©|\(c\)|all rights reserved|copyright", re.I),
    re.compile(r"\bcookies?\b|\bconsent\b|\bgdpr\b", re.I),
    re.compile(r"\W*(?:advertisement|advert|ad|sponsored|promoted|anzeige|werbung|publicité|publicidad)\b", re.I),
    re.compile(r"\b(?:reply|says|wrote|said)\W*$|\b(?:posted|written) by\b|\bpermalink\b|\b(?:minutes?|hours?|days?|weeks?|months?) ago\b|^by [A-Z]", re.I),
    re.compile(r"\b(?:subscribe|newsletter|sign up|log ?in|inbox|sign in|your e-?mail)\b", re.I),
    re.compile(r"\b(?:share|tweet|facebook|twitter|print|follow us|filed under|tagged)\b", re.I),
    re.compile(r"\b(?:19|20)\d\d\b|\b\d{1,2}:\d\d\b"),
]
N_TAGS, N_NAMES = len(set(TAGS.values())) + 1, len(NAMED)
#: Features: bias; tag; names by what their element holds (4); hidden; of elements: share of prose (4), sentences (4), links (3),
#: holds the title, both heads; of leaves: bias, length (4), ends a sentence, comma, links (3), place (3), what is above (16), both
#: heads, share of prose (3), patterns in short runs and in very short ones.
HIDDEN = 1 + N_TAGS + 4 * N_NAMES
ELEMENT = HIDDEN + 1
LEAF = ELEMENT + 14
N_FEATURES = LEAF + 10 + 3 + 16 + 2 + 3 + 2 * len(PATTERNS)
KINDS = 5  # of edges: to a lone leaf, to an element that parts pages, to a named element, to another, to a leaf with siblings
END = ".!?…:;\"'”»)"


class Page:
    """Parallel lists of nodes in document order, so that a parent comes before its children."""

    def __init__(self) -> None:
        self.parent, self.kind, self.text = [-1], [3], [""]
        self.tag, self.groups, self.linked, self.head = [""], [()], [0], [0]
        self.features: list[list[int]] = []

    def add(self, parent: int, kind: int, tag: str, groups: tuple[int, ...], text: str, linked: int, head: int) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.tag.append(tag)
        self.groups.append(groups)
        self.text.append(text)
        self.linked.append(linked)
        self.head.append(head)
        return len(self.parent) - 1


def _groups(attributes: str) -> tuple[int, ...]:
    """Groups of the names in an element's attributes; N_NAMES stands for hidden."""
    groups = set()
    if "=" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
                groups |= {WORD_GROUP[w] for x in NAME_WORD.findall(value) if (w := x.lower()) in WORD_GROUP}
            elif name == "style" and "display" in value and "none" in value or name == "aria-hidden" and value == "true":
                groups.add(N_NAMES)
    if "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes):
        groups.add(N_NAMES)
    return tuple(groups)


def parse(html: str) -> Page:
    """The tree of a page, in time that grows with its length."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    places: dict[str, list[int]] = {}  # of each open tag: where it stands in the stack
    scopes = [0]  # where the open elements stand that implied ends don't cross
    heads: list[tuple[int, int]] = [(0, 9)]  # of each open element: which head came in it, and of which level
    run: list[str] = []
    linked, links, at, n = 0, 0, 0, len(html)
    last = html.rfind(">") + 1  # no markup ends beyond, so nothing is searched there again and again
    unclosed: set[str] = set()  # raw elements that no further tag closes

    def flush() -> None:
        nonlocal linked
        if run:
            text = "".join(run)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                tag, node = stack[-1]
                page.add(node, 0, tag, (), text, linked, heads[-1][0])
                heading = tag in HEADINGS
                if heading or len(text) < 40:
                    level = int(tag[1]) if heading else 8
                    bits = 0 if not heading and text[-1] in ".!?" else 1 if COMMENTS_HEAD.fullmatch(text) else 2 if (heading or len(text) < 25) and OTHERS_HEAD.fullmatch(text) else 0
                    up = len(stack) - 1 - (heading or tag in ("p", "b"))
                    if up >= 0 and (bits or heading and level <= heads[up][1]):
                        heads[up] = (bits, level if bits else 9)
            run.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        run.append(text)
        if links:
            linked += len(text)

    def pop(k: int) -> None:
        for tag, _ in stack[k:]:
            places[tag].pop()
        while scopes[-1] >= k:
            scopes.pop()
        del stack[k:], heads[k:]

    while at < n:
        m = TOKEN.search(html, at, last) if at < last else None
        if m is None:
            opened = html.find("<!--", at)
            add(html[at : n if opened < 0 else opened])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if html.startswith("<!--", m.start()) and not html.endswith("-->", m.start() + 2, at) and not html.endswith("--!>", m.start() + 4, at):
                break  # a comment that is never closed
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag == "a":
            links = 0 if end else 1
        elif tag in INLINE:
            pass
        elif tag in SPACES:
            run.append(" ")
            if tag == "hr":
                flush()
        elif tag in VOID:
            pass
        elif tag in RAW:
            if not end and not m[3].endswith("/"):
                stop = None if tag in unclosed else CLOSE[tag].search(html, at)
                if stop is None:  # never closed: a script swallows the rest, other elements only themselves
                    unclosed.add(tag)
                    at = n if tag in ("script", "style", "textarea", "title", "xmp") else at
                else:
                    close = html.find(">", stop.end())
                    at = n if close < 0 else close + 1
                run.append(" ")
        else:
            flush()
            links = 0
            if end:
                if places.get(tag):
                    pop(places[tag][-1])
            else:
                if tag in IMPLIED:
                    while (k := max((places[t][-1] for t in IMPLIED[tag] if places.get(t)), default=0)) > scopes[-1]:
                        pop(k)
                        if tag not in ("tr", "tbody"):
                            break
                elif stack[-1][0] == "p" or tag in HEADINGS and stack[-1][0] in HEADINGS:
                    pop(len(stack) - 1)
                groups = _groups(m[3]) if m[3] else ()
                kind = 1 if tag in SIDE_TAGS or tag in WHOLE else 2 if groups else 3
                node = page.add(stack[-1][1], kind, tag, groups, "", 0, heads[-1][0])
                places.setdefault(tag, []).append(len(stack))
                if tag in SCOPE:
                    scopes.append(len(stack))
                stack.append((tag, node))
                heads.append((0, 9))
    flush()
    _describe(page)
    return page


def _title(page: Page) -> int:
    """The leaf that is most likely the title: a heading outside side matters, h1 before h2; -1 if there is none."""
    best, found = 9, -1
    under = [0] * len(page.parent)
    for i in range(1, len(under)):
        above, tag = under[page.parent[i]], page.tag[i]
        if not page.text[i]:
            side = 1 if tag in ("nav", "aside", "footer", "form", "dialog") else 2 if tag == "header" or 7 in page.groups[i] else 4 if tag in WHOLE else 0
            under[i] = above | side
        elif tag in ("h1", "h2") and not above & 1 and not page.head[i] and not COMMENTS_HEAD.fullmatch(page.text[i]) and not OTHERS_HEAD.fullmatch(page.text[i]):
            rank = (0 if tag == "h1" else 2) + (0 if not above & 2 else 1 if above & 4 else 4)
            if rank < best:
                best, found = rank, i
    return found


def _describe(page: Page) -> None:
    """Features of all nodes, from what is below and above them."""
    n, title = len(page.parent), _title(page)
    children = [0] * n
    for p in page.parent[1:]:
        children[p] += 1
    chars, linked, prose, sentences, runs, holds = [0] * n, list(page.linked), [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(n - 1, -1, -1):
        if page.text[i]:
            text = page.text[i]
            size = chars[i] = len(text)
            full = text[-1] in END and size > 20
            sentences[i], runs[i] = int(full), 1
            prose[i] = size if (full or size > 80) and page.linked[i] * 5 < size else 0
            holds[i] = i == title
        if i:
            p = page.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            prose[p] += prose[i]
            sentences[p] += sentences[i]
            runs[p] += runs[i]
            holds[p] = holds[p] or holds[i]
    mass = prose if prose[0] else chars
    whole = mass[0] or 1
    above, head = [0] * n, [0] * n
    for i in range(n):
        p, kind = page.parent[i], page.kind[i]
        over = above[p] if i else 0
        heads = head[i] = (head[p] if i else 0) | page.head[i]
        found: list[int]
        if not page.text[i]:
            big = 2 * mass[i] > whole
            groups, tag = page.groups[i], page.tag[i]
            found = [0, 1 + TAGS.get(tag, N_TAGS - 1)]
            part = holds[i] + 2 * (big and runs[i] > 2)
            for g in groups:
                found.append(HIDDEN if g == N_NAMES else 1 + N_TAGS + 4 * g + part)
            at = ELEMENT
            found.append(at + (0 if not mass[i] else 1 if 10 * mass[i] < whole else 2 if not big else 3))
            s = sentences[i]
            found.append(at + 4 + (0 if not s else 1 if s < 2 else 2 if s < 5 else 3))
            found.append(at + 8 + ((5 * linked[i] > chars[i]) + (5 * linked[i] > 3 * chars[i]) if chars[i] else 2))
            if holds[i]:
                found.append(at + 11)
            found += [at + 12 + b for b in (0, 1) if heads & (1 << b)]
            if tag in WHOLE:
                over |= 1
            if not part:
                if tag in SIDE_TAGS:
                    over |= 2
                if any(0 < g < N_NAMES for g in groups):
                    over |= 4
            elif kind == 2:
                page.kind[i] = 3
            if 0 in groups:
                over |= 8
            above[i] = over
        else:
            text, at = page.text[i], LEAF
            words, share = text.count(" ") + 1, page.linked[i] / len(text)
            found = [at, at + 1 + (words > 3) + (words > 10) + (words > 30), at + 7 + (share > 0.2) + (share > 0.7)]
            if text[-1] in END:
                found.append(at + 5)
            if ", " in text:
                found.append(at + 6)
            found.append(at + 10 + (2 if title < 0 else i < title))
            found.append(at + 13 + over)
            found.append(at + 31 + (10 * mass[i] > whole) + (10 * mass[i] > 3 * whole))
            page.kind[i] = 4 * (children[p] > 1)
            found += [at + 29 + b for b in (0, 1) if heads & (1 << b)]
            if len(text) < 200:  # longer runs are prose, whatever they speak of
                found += [at + 34 + 2 * k + (len(text) < 60) for k, p in enumerate(PATTERNS) if (p.match if k == 2 else p.search)(text)]
        page.features.append(found)


class Tree:
    """Potentials' weights; sum-product over one page at a time."""

    def __init__(self, node: np.ndarray, edge: np.ndarray) -> None:
        self.node, self.edge = node, edge  # (features,) for content against not; (kinds, parent label, child label)

    def beliefs(self, page: Page) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Probability of content for each node, and for each the pair marginal with its parent: (00, 01, 10, 11), parent first."""
        w, parent, n = self.node.tolist(), page.parent, len(page.parent)
        tables = [[np.exp(x).tolist() for x in t] for t in self.edge]
        score = [sum(map(w.__getitem__, f)) for f in page.features]
        up = [(1.0, 1.0)] * n
        own = [(1.0, 2.718281828459045 ** max(-30.0, min(30.0, s))) for s in score]
        inside = list(own)
        for i in range(n - 1, 0, -1):
            x0, x1 = inside[i]
            t = tables[page.kind[i]]
            a, b = t[0][0] * x0 + t[0][1] * x1, t[1][0] * x0 + t[1][1] * x1
            z = a + b
            a, b = a / z, b / z
            up[i] = (a, b)
            p0, p1 = inside[parent[i]]
            p0, p1 = p0 * a, p1 * b
            z = p0 + p1 or 1.0
            inside[parent[i]] = (p0 / z + 1e-300, p1 / z + 1e-300)
        full = [(0.0, 0.0)] * n
        full[0] = inside[0]
        pairs = [(0.0, 0.0, 0.0, 0.0)] * n
        for i in range(1, n):
            f0, f1 = full[parent[i]]
            a, b = up[i]
            o0, o1 = f0 / a, f1 / b
            x0, x1 = inside[i]
            t = tables[page.kind[i]]
            q = (o0 * t[0][0] * x0, o0 * t[0][1] * x1, o1 * t[1][0] * x0, o1 * t[1][1] * x1)
            z = sum(q)
            q = (q[0] / z, q[1] / z, q[2] / z, q[3] / z)
            pairs[i] = q
            full[i] = (q[0] + q[2] + 1e-300, q[1] + q[3] + 1e-300)
        return [b / (a + b) for a, b in full], pairs


class Forest:
    """The trees of many pages in one numbering, with messages passed level by level; for training."""

    def __init__(self, pages: list[Page]) -> None:
        starts = np.cumsum([0, *(len(p.parent) for p in pages)])
        self.parent = np.concatenate([np.array(p.parent) + s for p, s in zip(pages, starts)])
        self.kind = np.concatenate([np.array(p.kind) for p in pages])
        self.roots = starts[:-1]
        self.parent[self.roots] = self.roots
        depth = np.zeros(len(self.parent), int)
        for i, p in enumerate(self.parent.tolist()):
            depth[i] = depth[p] + (p != i)
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        features = [f for p in pages for f in p.features]
        self.flat, self.of = np.concatenate([np.array(f) for f in features]), np.repeat(np.arange(len(features)), [len(f) for f in features])

    def beliefs(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """As Tree.beliefs: (nodes,) and (nodes, parent label, child label)."""
        n = len(self.parent)
        inside, up = np.zeros((n, 2)), np.zeros((n, 2))
        inside[:, 1] = np.clip(np.bincount(self.of, weights=tree.node[self.flat], minlength=n), -30, 30)
        for at in reversed(self.levels):
            q = tree.edge[self.kind[at]] + inside[at, None, :]
            up[at] = np.logaddexp(q[:, :, 0], q[:, :, 1])
            for y in (0, 1):
                inside[:, y] += np.bincount(self.parent[at], weights=up[at, y], minlength=n)
        full, pairs = inside.copy(), np.zeros((n, 2, 2))
        for at in self.levels:
            q = (full[self.parent[at]] - up[at])[:, :, None] + tree.edge[self.kind[at]] + inside[at, None, :]
            each = np.logaddexp(q[:, 0], q[:, 1])
            all_of = np.logaddexp(each[:, 0], each[:, 1])[:, None]
            pairs[at], full[at] = np.exp(q - all_of[:, :, None]), each - all_of
        return 1 / (1 + np.exp(full[:, 0] - full[:, 1])), pairs


def _labels(page: Page, content: set[str]) -> list[int]:
    """Leaves by their text; an element is content if most of the characters below it are."""
    n = len(page.parent)
    good, every = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if page.text[i]:
            every[i] = len(page.text[i])
            good[i] = every[i] * (page.text[i] in content)
        if i:
            every[page.parent[i]] += every[i]
            good[page.parent[i]] += good[i]
    return [int(2 * g > e) for g, e in zip(good, every)]


def train(pages: list[tuple[str, set[str]]], rounds: int = 100, decay: float = 0.03) -> Tree:
    """Gradient ascent (Adam) on the conditional log likelihood of the labels of all nodes."""
    tree = Tree(np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2)))
    parsed = [parse(h) for h, _ in pages]
    forest, y = Forest(parsed), np.concatenate([_labels(p, c) for p, (_, c) in zip(parsed, pages)])
    inner = np.flatnonzero(forest.parent != np.arange(len(y)))
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
    m, v = [np.zeros_like(tree.node), np.zeros_like(tree.edge)], [np.zeros_like(tree.node), np.zeros_like(tree.edge)]
    for step in range(1, rounds + 1):
        one, pairs = forest.beliefs(tree)
        expected = np.stack([pairs[inner][forest.kind[inner] == k].sum(axis=0) for k in range(KINDS)])
        g = [np.bincount(forest.flat, weights=(y - one)[forest.of], minlength=N_FEATURES) - decay * tree.node, seen - expected - decay * tree.edge]
        for j, p in enumerate((tree.node, tree.edge)):
            d = g[j] / len(y)
            m[j] += 0.1 * (d - m[j])
            v[j] += 0.01 * (d * d - v[j])
            p += 0.15 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    return tree


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, set[str]]]:
    """Made pages of many layouts, each with the set of its article's runs."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    word = lambda: "".join(pick(["an", "the", "on", "ing", "er", "ti", "ra", "os", "que", "ein", "ung", "le", "ment", "st"]) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    name = lambda: words(1, 2).title()
    date = lambda: pick([f"{pick(['March', 'June', 'May'])} {rng.randint(1, 30)}, {rng.randint(1999, 2025)}", f"{rng.randint(1, 30)}.{rng.randint(1, 12)}.{rng.randint(1999, 2025)}", f"{rng.randint(2, 30)} {pick(['minutes', 'hours', 'days', 'weeks'])} ago", f"{rng.randint(2000, 2025)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} {rng.randint(10, 23)}:{rng.randint(10, 59)}"])

    def prose(a: int = 1, b: int = 90) -> str:
        out, left = [], rng.randint(a, b)
        if chance(0.12):  # text of little worth is still text: lists, repetition, noise, capitals
            own = [word() for _ in range(left)] if chance(0.6) else [word()] * left
            return pick([" ", " ", " | ", "### ", "!! "]).join(x.upper() if chance(0.1) else x for x in own).capitalize()
        while left > 0:
            k = min(left, rng.randint(1, 14))
            own = [word() for _ in range(k)]
            if k > 4 and chance(0.6):
                own[k // 2] += ","
            if chance(0.04):
                own[0] = pick(["cookies", "comments", "newsletter", "2019", "consent", "reply", "share", "wrote"])
            out.append(" ".join(own).capitalize() + pick([".", ".", ".", "!", "?"]))
            left -= k
        if chance(0.06):
            out.insert(rng.randint(0, len(out)), f"{pick(['Copyright (c)', '©', 'Copyright'])} {rng.randint(1990, 2030)} {word()}. {pick(['', 'All rights reserved.'])}")
        return " ".join(" ".join(out).split())

    def links(k: int, wrap: str = "li") -> str:
        inner = "".join(f'<{wrap}><a href="/{word()}">{words(1, 4).capitalize()}</a></{wrap}>' for _ in range(k))
        return f"<ul>{inner}</ul>" if wrap == "li" else inner

    def named(names: list[str], p: float = 0.85) -> str:
        """An attribute with one of the names, or none that tells."""
        return f' {pick(["class", "class", "id"])}="{pick(names)}"' if chance(p) else pick(["", f' class="{word()}-{rng.randint(1, 99)}"', ' class="col-3"', ' class="row"'])

    def box(names: list[str], inner: str, tags: tuple[str, ...] = ("div", "section", "aside"), p: float = 0.85) -> str:
        return f"<{(t := pick(tags))}{named(names, p)}>{inner}</{t}>"

    out = []
    for _ in range(n):
        content: list[str] = []

        def keep(text: str) -> str:
            content.append(" ".join(text.split()))
            return text

        def ad() -> str:
            inner = pick([prose(3, 40), f"<p>{prose(3, 40)}</p>", f'<a href="/x">{words(2, 6)}</a>'])
            if chance(0.35):
                return box(["ad", "ad-slot", "promo"], f"<{(t := pick(['span', 'p', 'div']))}>{pick(['Advertisement', 'Sponsored', 'Ad', 'Anzeige', 'Publicité', 'Publicidad'])}</{t}>{inner}", ("div", "aside"), 0.4)
            return box(["ad", "ads", "advert", "sponsored", "banner", "promo-box", "adsbox", "ad-container"], inner, ("div", "aside", "section"), 1)

        def form() -> str:
            return f'<form action="/s">{pick(["", "<label>" + words(1, 3) + "</label>"])}<input type="text"><p>{prose(3, 15)}</p><button>{word()}</button></form>'

        def letter() -> str:
            return box(["newsletter", "subscribe", "signup-box", "newsletter-form"], f"<h{(h := rng.randint(2, 4))}>{pick(['Subscribe', 'Newsletter', 'Sign up for our newsletter', 'Stay in touch'])}</h{h}><p>{pick(['Get the best of ' + word() + ' in your inbox.', 'Sign up and never miss a story.', 'Enter your e-mail ' + words(2, 8) + '.'])}</p>" + pick(["", form()]), ("div", "section", "aside"))

        def notice() -> str:
            inner = pick([prose(6, 30), f"We use cookies {words(3, 14)}.", f"This site uses cookies. {prose(4, 12)}", f"{words(3, 8).capitalize()} consent {words(2, 5)}."])
            return box(["cookie-notice", "consent-banner", "notice", "alert", "gdpr", "cc-window", "cookie-bar"], f"<p>{inner}</p>" + pick(["", "<button>OK</button>", '<a href="/p">' + word() + "</a>"]), ("div", "aside", "section"), 0.8 if "cookie" in inner else 1)

        def comment(tag: str, p: float) -> str:
            who = pick([f"<b>{name()}</b>", f'<a href="/u">{name()}</a> {pick(["says:", "wrote:", ""])}', f"<strong>{name()}</strong> <small>{date()}</small>", f"<cite>{name()}</cite><p>{date()}</p>", f"<h4>{name()}</h4>", f"<span>{name()}</span>, {date()}"])
            text = "".join(f"<p>{prose(2, 60)}</p>" for _ in range(pick([1, 1, 1, 2, 3])))
            return f"<{tag}{named(['comment', 'reply', 'comment-body', 'review', 'comment even depth-1'], p)}>{who if chance(0.75) else ''}{text if chance(0.8) else prose(2, 50)}{pick(['', '', '<a href=#>Reply</a>', '<div><a href=#>Reply</a></div>'])}</{tag}>"

        def comments(many: int = 5) -> str:
            k = rng.randint(1, many)
            head = pick(["Comments", f"{k} Comments", f"Comments ({k})", f"{k} Responses", "Leave a reply", f"{k} thoughts on this", "Discussion", "Reader comments", "Kommentare", f"{k} Commentaires", "Comentarios", f"{k} comments"])
            h = pick(["h2", "h3", "h3", "h4", "p", "div"])
            head = f"<{h}>{head}</{h}>" if chance(0.7) else ""
            plain = head and h[0] == "h" and chance(0.45)  # only the heading tells
            wrap = pick([("ol", "li"), ("ul", "li"), ("div", "div"), ("div", "article"), ("section", "div"), ("div", "p")])
            inner = f"<{wrap[0]}>" + "".join(comment(wrap[1], 0.0 if plain else 0.6) for _ in range(k)) + f"</{wrap[0]}>"
            inner = head + inner + (form() if chance(0.2) else "")
            return box(["x"], inner, ("div", "section"), 0) if plain else box(["comments", "comment-list", "discussion", "reader-comments", "responses reply", "comments-area", "disqus_thread"], inner, ("div", "section", "aside"), 1)

        def side() -> str:
            inner = pick([links(4), f"<p>{prose(5, 50)}</p>", links(3) + f"<p>{prose(3, 30)}</p>", "".join(f"<h4><a href=/y>{words(3, 9)}</a></h4><p>{prose(5, 30)}</p>" for _ in range(rng.randint(1, 4)))])
            head = pick([words(1, 3), "Related", "Popular posts", "Recent comments", "About", "Most read", "Archives", "Tags"])
            return f'<{(t := pick(["aside", "div", "div", "section"]))} {pick(["class", "id"])}="{pick(["sidebar", "side-rail", "widget-area", "related", "sidebar-right", "secondary sidebar", "rail", "trending"])}"><h3>{head}</h3>{inner}</{t}>'

        def others() -> str:
            head = pick(["Related articles", "Read more", "You may also like", "More from " + word(), "Related", "Recommended", "Ähnliche Artikel", "À lire aussi", "Most read", "Share this"])
            inner = pick([links(3, pick(["li", "p"])), "".join(f"<div><a href=/z>{words(3, 9)}</a><p>{prose(4, 25)}</p></div>" for _ in range(3))])
            return box(["related", "share", "more-stories", "recommended", "social"], f"<h3>{head}</h3>{inner}" if chance(0.8) else links(3, pick(["li", "p"])), ("div", "aside", "section"), 0.6)

        top, bottom = [], []
        if chance(0.8):
            top.append(f"<nav>{links(rng.randint(3, 9))}</nav>" if chance(0.7) else box(["main-nav", "menu", "navbar", "breadcrumbs"], links(rng.randint(3, 8), pick(["li", "span"])), ("div", "ul")))
        if chance(0.5):
            logo = f'<a href="/">{words(1, 2)}</a>'
            top.insert(0, f'<{(t := pick(["header", "header", "div"]))} class="{pick(["site-header", "masthead", "top"])}">{pick(["<div class=logo>" + logo + "</div>", "<h1>" + logo + "</h1>", "<h1 class=site-title>" + words(1, 3).title() + "</h1>", "<p>" + logo + "</p>"])}<p>{prose(2, 9)}</p></{t}>')
        if chance(0.15):
            top.append(pick([f'<div{named(["breadcrumb", "crumbs"], 0.5)}><a href=/>Home</a> &gt; <a href=/a>{word()}</a> &gt; {words(1, 4)}</div>', f"<p><a href=/>Home</a> / <a href=/a>{word()}</a></p>"]))
        if chance(0.5):
            (top if chance(0.7) else bottom).append(notice())
        if chance(0.6):
            top.append(ad())
        if chance(0.3):
            top.append(form())
        heading = keep(words(3, 12).capitalize() + pick(["", ".", ". " + word(), "?"]))
        meta = f'<p{named(["byline", "meta", "post-meta", "date", "entry-meta"], 0.8)}>{pick([words(2, 5), f"By {name()}", f"By {name()} on {date()}", f"Posted by {name()}, {date()}", date()])}</p>'
        h = pick(["h1", "h1", "h1", "h2"])
        shown = f"<{h}{named(['entry-title', 'post-title', 'headline'], 0.3)}>{heading}</{h}>"
        if chance(0.2):
            shown = f'<header{named(["entry-header", "post-header", "article-header"], 0.7)}>{shown}{meta if chance(0.6) else ""}</header>'
        elif chance(0.3):
            shown += meta
        body = [shown] if chance(0.85) else []
        if not body:
            content.pop()
        short = chance(0.2)  # an article shorter than its comments, or than an advert
        tiny = short and chance(0.3)
        if chance(0.1):  # all in one block
            parts = [prose(5, 60) for _ in range(rng.randint(1, 6))]
            keep(" ".join(parts))
            body.append("<br><br>".join(parts) + pick(["", "<hr>"]))
            short = True
        apart = chance(0.12)  # each part in a box of its own
        for _ in range(rng.randint(1, 3 if short else 14)):
            kind = rng.random()
            before = len(body)
            if kind < 0.72:
                text = keep(prose(1, 5 if tiny else pick([4, 30, 90, 160])))
                if chance(0.2):
                    own = text.split(" ")
                    k = rng.randrange(len(own))
                    own[k] = pick([f'<a href="/x">{own[k]}</a>', f"<b>{own[k]}</b>", f"<em>{own[k]}</em>"])
                    text = " ".join(own)
                body.append(f"<p>{text}{pick(['</p>', '</p>', '</p>', ''])}" if chance(0.85) else f"<div>{text}</div>" if chance(0.5) else f"<p><b>{text}<br>")
            elif kind < 0.8:
                t = pick(["h2", "h2", "h3"])
                body.append(f"<{t}>{keep(words(1, 7).capitalize())}</{t}>")
            elif kind < 0.86:
                t = pick(["ul", "ul", "ol"])
                body.append(f"<{t}>" + "".join(f"<li>{keep(prose(1, 14))}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>")
            elif kind < 0.89:
                body.append(f"<blockquote><p>{keep(prose(4, 40))}</p></blockquote>" if chance(0.7) else f"<pre>{keep(prose(3, 20))}</pre>")
            elif kind < 0.92:
                body.append(f"<table><tr><td>{keep(prose(1, 6))}</td><td>{keep(prose(1, 6))}</td></tr></table>" if chance(0.7) else f"<dl><dt>{keep(words(1, 3))}</dt><dd>{keep(prose(3, 20))}</dd></dl>")
            elif kind < 0.94:
                body.append(f"<figure><img src='x'><figcaption>{keep(prose(3, 14))}</figcaption></figure>")
            elif kind < 0.96:
                body.append(ad())
            else:
                body.append(pick([others, letter])())
            if apart and kind < 0.94:
                body[before] = f'<section class="{pick(["block", word(), "text-block", "slice"])}"><div class="{pick(["inner", "wrap", word()])}">{body[before]}</div></section>'
        if chance(0.15):
            body.append(f'<footer><p class="tags">{words(2, 5)}</p></footer>')
        if chance(0.12):
            body.append(box(["author-bio", "author-box", "about-author"], f"<h4>{pick(['About the author', name()])}</h4><p>{prose(4, 30)}</p>", ("div", "aside"), 1))
        if chance(0.1):
            bottom.append(box(["pager", "pagination", "post-navigation"], f'<a href=/p>{pick(["Previous", "&laquo; " + words(2, 5)])}</a> <a href=/n>{pick(["Next", words(2, 5) + " &raquo;"])}</a>', ("div", "nav"), 0.6))
        told = comments(12 if short else 5) if short or chance(0.5) else ""
        if told and chance(0.35):
            body.append(told)
        elif told:
            bottom.append(told)
        if chance(0.4):
            (top if chance(0.4) else bottom).append(side())
        if chance(0.2):
            bottom.append(others())
        if chance(0.3):
            bottom.append(pick([form, letter])())
        if chance(0.3):
            bottom.append(ad())
        foot = pick([f"&copy; {words(1, 2)} &middot; {prose(2, 20)}", f"<p>{prose(3, 30)}</p>", links(4) + f"<p>Copyright {words(1, 2)}</p>"])
        if chance(0.9):
            bottom.append(f"<footer>{foot}</footer>" if chance(0.75) else box(["footer", "site-footer", "copyright", "colophon"], foot, ("div",), 1))
        shell = pick(["article"] * 4 + ["main", "div", "div", "div", "section", "bare"])
        topic = pick(["review", "category-privacy", "tag-advertising", "comment-free review", "post type-post tag-cookies", "hentry category-reviews author-site", "story popular", "popup-safe article"])
        names = pick(["", "", ' class="post"', ' class="article-content"', ' id="content"', ' class="entry-content"', ' id="main"', f' class="{topic}"', f' class="{topic}"', f' class="{word()}"'])
        inner = "".join(body)
        if chance(0.25):
            inner = f'<{(t := pick(["div", "div", "section"]))} class="{pick(["post-content", "entry", "inner", "body-text", word(), "content", topic])}">{inner}</{t}>'
        middle = inner if shell == "bare" else f"<{shell}{names}>{inner}</{shell}>"
        layout = pick(["wrapper", "container", "page", "layout", "row", "main-wrapper sidebar-left", "with-sidebar", "layout-two-col sidebar-right", "page header-fixed footer-dark", "site has-ads", "content-area no-sidebar", "comments-open", "single author-admin", "grid widget-grid", "site-body nav-open", "page-form", word()])
        whole = [*top, f"<main>{middle}</main>" if chance(0.2) else middle, *bottom]
        if chance(0.5):
            a, b = rng.randint(0, len(top)), rng.randint(len(top) + 1, len(whole))
            whole[a:b] = [f'<div {pick(["class", "id"])}="{layout}">', *whole[a:b], "</div>"]
        attributes = pick(["", "", "", f' class="{layout}"', f' class="single {pick(["comments-open", "has-sidebar", "no-header", "with-banner", "dialog-off", "logged-out search-off"])}"'])
        head = pick(["", "", "<script>var a='<!--';</script>", "<script>if (a<b) {}</script>", "<!-- x -->"])
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style>{head}</head><body{attributes}>{''.join(whole)}" + pick(["</body></html>", ""])
        out.append((page, {" ".join(unescape(c).split()) for c in content}))
    return out


@lru_cache(1)
def trained(pages: int = 400, seed: int = 1) -> Tree:
    return train(labelled_pages(pages, seed))


def main_text(html: str, tree: Tree) -> str:
    page = parse(html)
    if len(page.parent) == 1:
        return ""
    content, _ = tree.beliefs(page)
    return "\n".join(t for t, p in zip(page.text, content) if t and p >= 0.5)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of pages (page_id, url, html)."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h, tree) for h in texts(b.column(2))], pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
