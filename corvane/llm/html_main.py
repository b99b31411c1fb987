"""Main text of HTML pages by minimum-cut labelling.

A page is split into blocks. A classifier's cost of calling a block content or boilerplate is its terminal capacity: a logistic
regression over the block's surroundings (element names, class, id and role words), length, link density and sentence end, fitted by
``costs`` on LAYOUTS pages that are made up by rule (``layout``) with known labels. Smoothness edges join neighbouring blocks, the
more weakly the more elements lie between them, and blocks that share a parent or grandparent element without being neighbours; they
scale with the costs. The minimum cut separates content from boilerplate. Blocks whose own capacity outweighs all their edges are
labelled at once, which changes no minimum cut; max-flow (level graphs and blocking flows) settles the rest.

An inline element whose words speak against it is a part of its block with a terminal capacity of its own, joined to the block's text; it goes
if the cut says so, and the line stays. Within a sentence such words mostly name something else (a menu's name, a comment in code).

An element's words speak about its blocks the less, the more of the page's text it holds beyond HELD of it (a form around the whole page, a
layout's name), and not at all where they are said of something else ("has-sidebar", "ad-free").
Hidden elements are not text.

Character references are decoded; white space in a block becomes one space; blocks are joined in page order by blank lines.

Defined cases: null and empty pages have empty text; unclosed, misnested and cut-off tags are read as browsers do in the
common cases; a page without any content block has empty text; repeated rows are extracted one by one; pages of any length are
read whole, in time that grows with their length; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""", re.S)
_CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[a-z])(?=[0-9])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Fixed element classes of HTML.
RAW = frozenset("script style noscript template iframe svg object canvas audio video title head select textarea button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr caption ul".split()
)
SPACE = frozenset("br td th wbr img input".split())
VOID = frozenset("hr br img input meta link wbr col area base embed source track param".split())
#: A start tag ends an open one of these kinds, within the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"optgroup"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}

#: Strength, from 0 to 1, of what element names, roles and class or id words say against and for content.
BAD_ELEMENT = dict.fromkeys("nav footer aside dialog menu search".split(), 1.0)
SOFT_ELEMENT = {"form": 1.0, "header": 0.7, "fieldset": 0.6, "address": 0.2}
GOOD_ELEMENT = {"article": 1.0, "main": 0.9}
BAD_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs footer foot sidebar side widget widgets rail ad ads adv advert adverts advertisement advertising adsense adslot banner promo promoted promotion sponsor "
    "sponsored comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification notifications alert disclaimer popup modal overlay toast".split()
)
MILD_WORDS = frozenset("related recommended recommendations share sharing social subscribe subscription newsletter signup login signin register search form toolbar pagination pager skip copyright legal masthead topbar bottombar taboola outbrain header".split())
GOOD_WORDS = frozenset("article articlebody content entry post story main body maintext maincontent text prose".split())
#: Words that say a name beside them is not the element's own: "has-sidebar", "ad-free", "share-enabled".
SAID_BEFORE = frozenset("has have with no non not without hide show is enable disable toggle".split())
SAID_AFTER = frozenset("free enabled disabled off on open opened closed collapsed expanded visible left right layout none less".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD_ROLES = frozenset({"main", "article"})
#: What is left of an element's evidence one element further down.
NEARER = 0.8
#: Share of the page's text from which on an element's soft evidence fades, and what is left of it at the whole page.
HELD, LEFT = 0.75, 0.15
NEIGHBOUR, NESTED, APART, SIBLING, COUSIN = 1.0, 0.5, 0.4, 0.5, 0.2
#: Words of adverts, and strength of words said of a part of a line: adverts, parts at its ends, parts within a sentence; and what joins
#: a part within a sentence and other parts to the line, for each side on which the line goes on.
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner promo promoted promotion sponsor sponsored".split())
ADVERT_PART, END_PART, INNER_PART, PART, LOOSE = 2.0, 1.0, 0.35, 1.5, 0.3
#: Log-odds that a part of a line is text of its kind, before what its words say.
PART_PRIOR = 3.0
LAYOUTS, RIDGE, SMOOTH = 480, 2.0, 1.5

#: Place of the weight of class, id and role words among the features.
_WORDS = 3
#: Evidence kinds of an element: unmistakable element, element that may hold anything, words and roles, milder words, good elements, good words.
_KINDS = 6
_FADES = (False, True, True, True, False, False)


@lru_cache(maxsize=20_000)
def advert(attributes: str) -> bool:
    """Whether class or id words are those of an advert."""
    values = (html_lib.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id"))
    return any(w.lower() in ADVERT_WORDS for v in values for w in _SPLIT.split(v))


@lru_cache(maxsize=20_000)
def evidence(name: str, attributes: str) -> tuple[bool, tuple[float, ...]]:
    """Whether an element is hidden, and what it says about its blocks by kind."""
    hidden = False
    bad, soft, words, mild, good, fair = BAD_ELEMENT.get(name, 0.0), SOFT_ELEMENT.get(name, 0.0), 0.0, 0.0, GOOD_ELEMENT.get(name, 0.0), 0.0
    if attributes.strip(" /"):
        bare = re.sub(r"""("[^"]*"|'[^']*')""", "", attributes).lower().split()
        hidden = "hidden" in bare
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), html_lib.unescape(value.strip("\"'"))
            if key in ("class", "id"):
                for part in value.split():
                    said = [w.lower() for w in _SPLIT.split(part) if w]
                    for k, w in enumerate(said):
                        if k and said[k - 1] in SAID_BEFORE or k + 1 < len(said) and said[k + 1] in SAID_AFTER:
                            continue
                        words, mild, fair = max(words, 1.0 * (w in BAD_WORDS)), max(mild, 1.0 * (w in MILD_WORDS)), max(fair, 1.0 * (w in GOOD_WORDS))
                    whole = "".join(said)
                    words, mild, fair = max(words, 1.0 * (whole in BAD_WORDS)), max(mild, 1.0 * (whole in MILD_WORDS)), max(fair, 1.0 * (whole in GOOD_WORDS))
            elif key == "role":
                words, good = max(words, 1.0 * (value.lower() in BAD_ROLES)), max(good, 1.0 * (value.lower() in GOOD_ROLES))
            elif key == "style" and _UNSEEN.search(value) or key == "aria-hidden" and value.lower() == "true" or key == "hidden":
                hidden = True
    if name in ("body", "html"):  # words there are about the page
        return hidden, (0.0,) * _KINDS
    if good:  # and there about the article's kind
        words, mild = 0.2 * words, 0.2 * mild
    return hidden, (bad, soft, words, mild, good, fair)


class Block:
    #: ``pieces``: raw texts of the line in order, each with the strength of what its element says against it (0: the line's own).
    __slots__ = ("text", "chars", "linked", "heading", "element", "parent", "grand", "depth", "said", "share", "pieces", "whole")

    def features(self) -> tuple[float, ...]:
        said = (*self.said[:2], max(self.said[2], self.whole), *self.said[3:])
        return (1.0, *said, min(1.0, math.log1p(self.chars / 40) / 4), self.share, self.linked / self.chars, 1.0 * self.heading, 1.0 * (self.chars < 20), 1.0 * (self.text[-1] in ".!?:;\u201d\"\u3002"))


def strengths(pieces: list[str], parts: list[tuple[int, int, bool]]) -> tuple[list[tuple[str, float]], float]:
    """The line cut into its own texts and parts, with the strength of what is said against each part; and that strength if the line is
    nothing but such parts, which are then its own text."""
    cut, at = [], 0
    own = [x for k, x in enumerate(pieces) if not any(a <= k < b for a, b, _ in parts)]
    if not "".join(own).strip():
        return [("".join(pieces), 0.0)], END_PART
    for a, b, is_advert in parts:
        before, after = "".join(pieces[:a]).rstrip(), "".join(pieces[b:]).strip()
        inner = before and after and before[-1] not in ".!?:;"
        cut += [("".join(pieces[at:a]), 0.0), ("".join(pieces[a:b]), ADVERT_PART if is_advert else INNER_PART if inner else END_PART)]
        at = b
    return [*cut, ("".join(pieces[at:]), 0.0)], 0.0


def blocks(page: str) -> list[Block]:
    """The page's blocks of visible text, in order."""
    out: list[Block] = []
    pieces: list[str] = []
    #: Parts of the line with words against them: from which piece to which, and whether an advert; where the open one is over.
    parts: list[tuple[int, int, bool]] = []
    part: tuple[int, int, bool] | None = None
    #: Of each element that holds blocks, in order: its parent, its depth and what it says by kind.
    above, depths, own = [0], [0], [(0.0,) * _KINDS]
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter = Counter()
    ends: dict[str, dict[int, int]] = {}
    linked = links = 0
    last = page.rfind(">") + 1  # no tag ends after it
    cut = _CUT_OFF.search(page, last)
    end = cut.start() if cut else len(page)

    def end_part() -> None:
        nonlocal part
        if part and len(pieces) > part[0]:
            parts.append((part[0], len(pieces), part[2]))

    def flush() -> None:
        nonlocal pieces, linked, part
        if pieces:
            end_part()
            cut, whole = strengths(pieces, parts) if parts else ([("".join(pieces), 0.0)], 0.0)
            text = " ".join("".join(x for x, against in cut if not against).split())
            if text:
                b = Block()
                b.pieces, b.whole = cut, whole
                name, b.element = stack[-1]
                b.parent = b.element
                if name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr"):  # the element is the block: its surroundings are its parent's
                    b.parent = above[b.parent]
                b.grand, b.depth = above[b.parent], depths[b.parent]
                b.text, b.chars, b.linked, b.heading = text, len(text), min(linked, len(text)), name in ("h1", "h2", "h3")
                out.append(b)
            pieces = []
            parts.clear()
        if part:
            part = (0, *part[1:])
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        text = html_lib.unescape(text) if "&" in text else text
        pieces.append(text)
        if links:
            linked += len(text.strip())

    def closed(k: int) -> None:
        for name, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    def over(name: str, begin: int) -> int | None:
        """Where an element that begins at ``begin`` is over: all tags of its name are matched once for a page."""
        if name not in ends:
            ends[name], waiting = {}, []
            for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>", re.I).finditer(page, begin, end):
                if not m[1]:
                    waiting.append(m.start())
                elif waiting:
                    ends[name][waiting.pop()] = m.end()
        return ends[name].get(begin)

    at = 0
    while True:
        m = _TAG.search(page, at, end)
        if not m:
            add(page[at:end])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if part and at >= part[1]:
            end_part()
            part = None
        close, name, attributes = m[1] or m[4], m[2] or m[5], m[3] or m[6] or ""
        if not name:
            continue
        name = name.lower()
        if close:
            if name == "a":
                links = 0
            elif name in BLOCK and opened[name]:
                flush()
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                closed(k)
            elif name == "p":
                flush()
            continue
        if name in RAW and not (name == "svg" and attributes.endswith("/")):
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at, end)
            if name == "head" and not found:  # an unclosed head ends at the body
                found = re.compile(r"(?=<body[\s>])", re.I).search(page, at, end)
            at = found.end() if found else end
            pieces.append(" ")
            continue
        hidden, said = evidence(name, attributes) if attributes or name in BLOCK else (False, ())
        if hidden and name not in VOID and name not in ("body", "html"):
            after = over(name, m.start())
            if after is not None:
                if name in BLOCK:
                    flush()
                at, links = after, 0 if name == "a" else links
                continue
        if attributes and not part and name not in VOID and name not in BLOCK and said[2]:
            after = over(name, m.start())
            part = (len(pieces), after, advert(attributes)) if after is not None else None
        if name == "a":
            links = 1
        elif name in SPACE:
            pieces.append(" ")
        elif name in BLOCK:
            flush()
            links = 0
            if name in VOID:
                continue
            if stack[-1][0] == "p":
                closed(len(stack) - 1)
            kinds, within = CLOSES.get(name, ((), ()))
            if any(opened[x] for x in kinds):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in kinds:
                        closed(k)
                        break
                    if stack[k][0] in within:
                        break
            if name == "header" and (opened["article"] or opened["main"]):  # an article's own heading
                said = (said[0], 0.0, *said[2:])
            if hidden:  # never closed: hidden to the end of what holds it
                said = (1.0, *said[1:])
            above.append(stack[-1][1])
            depths.append(depths[stack[-1][1]] + 1)
            own.append(said)
            stack.append((name, len(own) - 1))
            opened[name] += 1
    flush()
    held = [0] * len(own)
    for b in out:
        held[b.element] += b.chars
    for k in range(len(own) - 1, 0, -1):  # an element comes after the one that holds it
        held[above[k]] += held[k]
    for k in range(1, len(own)):
        up = own[above[k]]
        if any(own[k]):
            doubt = 1 - max(up[0], up[2], up[3])  # an article in a list of related ones is a teaser
            own[k] = (*own[k][:4], own[k][4] * doubt, own[k][5] * doubt)
            fade = 1 - (1 - LEFT) * max(0.0, held[k] / max(1, held[0]) - HELD) / (1 - HELD)
            own[k] = tuple(max(NEARER * y, x * fade if fades else x) for y, x, fades in zip(up, own[k], _FADES, strict=True))
        else:
            own[k] = tuple(NEARER * y for y in up)
    for b in out:
        b.said, b.share = own[b.element], b.chars / held[0]
    return out


def layout(rng: random.Random) -> tuple[str, dict[str, bool]]:
    """A made-up page and whether each of its texts is content."""
    truth: dict[str, bool] = {}

    def text(content: bool, least: int, most: int, sentence: bool = True) -> str:
        words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randint(least, most))]
        t = " ".join(words) + ("." if sentence else "")
        truth[t] = content
        return t

    def element(names: str, inner: str) -> str:
        """One of "name|name.class|name#id" around ``inner``."""
        name, _, rest = rng.choice(names.split("|")).partition(" ")
        return f"<{name}{' ' + rest if rest else ''}>{inner}</{name}>"

    def links(n: int) -> str:
        return element("ul|ul class=menu|div|ul class=list", "".join(f"<li><a href=/x>{text(False, 1, 5, False)}</a></li>" for _ in range(n)))

    def paragraphs(content: bool, n: int) -> str:
        kinds = [lambda: f"<p>{text(content, 12, 90)}</p>"] * 5 + [lambda: f"<p>{text(content, 1, 8)}</p>", lambda: f"<h2>{text(content, 1, 6, False)}</h2>", lambda: f"<ul><li>{text(content, 2, 20, False)}</li><li>{text(content, 2, 20)}</li></ul>", lambda: "<ul>" + "".join(f"<li>{text(content, 1, 3, False)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>",
                 lambda: f"<blockquote><p>{text(content, 8, 40)}</p></blockquote>", lambda: f"<p><a href=/y>{text(content, 3, 9)}</a></p>"]
        return "".join(rng.choice(kinds)() for _ in range(n))

    advert = lambda: element("div class=ad|div class=adslot|div class='banner promo'|div id=ads|div class=sponsored|div class=box", f"<p>{text(False, 3, 25, rng.random() < 0.6)}</p>" if rng.random() < 0.5 else text(False, 3, 25, rng.random() < 0.6))
    main = f"<h1>{text(True, 2, 9, rng.random() < 0.3)}</h1>" + paragraphs(True, rng.randint(1, 12))
    if rng.random() < 0.4:
        main += advert() + paragraphs(True, rng.randint(1, 3))
    if rng.random() < 0.3:
        main += element("div class=share|div class=related-posts|aside|form class=newsletter|form|form|fieldset|div class=social", rng.choice(["<p>{}</p>", "<label>{}</label><input>", "{}<input>", "<article><p>{}</p></article>"]).format(text(False, 1, 12, False)) + links(rng.randint(0, 4)))
    if rng.random() < 0.1:  # a page without any surroundings
        truth.clear()
        main = paragraphs(True, rng.randint(1, 4))
        return rng.choice(["{}", "<body>{}</body>", "<article>{}</article>", "<div>{}</div>"]).format(main), truth
    main = element("article|main|div class=content|div id=main|div class=post|section class=story|div|div|article class=has-sidebar|main class='content with-sidebar'|div class=entry|article class=ad-free", main)
    if rng.random() < 0.4:
        said = "".join(f"<li><p>{text(False, 4, 60)}</p></li>" for _ in range(rng.randint(1, 6)))
        main += element("section id=comments|div class=commentlist|div id=disqus|ol class=comments", said)
    page = main
    if rng.random() < 0.5:
        side = element("aside|div class=sidebar|div id=side|div class=widget|div role=complementary|div|div class=col2", links(rng.randint(1, 6)) + (paragraphs(False, rng.randint(0, 3))))
        page = page + side if rng.random() < 0.5 else side + page
    if rng.random() < 0.5:
        page = element("div class=cookie-notice|div role=alert|div class=consent|div id=gdpr", f"<p>{text(False, 5, 30)}</p>") + page
    if rng.random() < 0.5:
        page = advert() + page
    top = element("nav|div class=navbar|div id=navigation|ul class=menu|nav class=top|div|div class=row", links(rng.randint(2, 8)))
    if rng.random() < 0.5:
        top = element("header|div class=header|div class=masthead", f"<div>{text(False, 1, 5, False)}</div>" + top)
    bottom = element("footer|div id=footer|div class=footer|footer class=site|div class=end", f"<p>{text(False, 3, 25, rng.random() < 0.5)}</p>" + (links(3) if rng.random() < 0.4 else ""))
    page = top + page + bottom
    if rng.random() < 0.3:
        page = element("form id=aspnetForm|div class=no-sidebar|div id=page|div class=layout|div class=sidebar-layout", page)
    return f"<html><head><title>t</title></head><body>{page}</body></html>", truth


@lru_cache(maxsize=1)
def costs(pages: int = LAYOUTS, seed: int = 5) -> tuple[float, ...]:
    """Weights of the features: a logistic regression with a ridge, fitted by Newton's method on made-up pages."""
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        page, truth = layout(rng)
        for b in blocks(page):
            rows.append(b.features())
            labels.append(truth[b.text])
    x, y = np.array(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (p - y) + RIDGE * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), gradient)
    return tuple(float(v) for v in w)


def odds_of(found: list[Block], weights: tuple[float, ...] | None = None) -> list[float]:
    """Log-odds of content of each block."""
    w = weights or costs()
    return [sum(a * b for a, b in zip(w, block.features(), strict=True)) for block in found]


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges between blocks, in units of log-odds."""
    out = []
    by_parent: dict[int, int] = {}
    by_grand: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            before = found[i - 1]
            steps = 0 if before.parent == b.parent else 1 + abs(before.depth - b.depth)
            nested = before.parent == b.grand or b.parent == before.grand  # a list between paragraphs
            out.append((i - 1, i, SMOOTH * (NESTED if steps and nested else APART / steps if steps else NEIGHBOUR)))
        last = by_parent.get(b.parent, i - 1)
        if last != i - 1:
            out.append((last, i, SMOOTH * SIBLING))
        cousin = by_grand.get(b.grand, i - 1)
        if cousin not in (i - 1, last):
            out.append((cousin, i, SMOOTH * COUSIN))
        by_parent[b.parent] = i
        by_grand[b.grand] = i
    return out


def min_cut(odds: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) that minimise the sum of -odds of the nodes called True and the weights of edges cut."""
    n = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in joined:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None if abs(o) < sum(near[i].values()) else o > 0 for i, o in enumerate(odds)]
    for i, sure in enumerate(label):
        if sure is not None:
            for j, w in near[i].items():
                odds[j] += w if sure else -w
                near[j].pop(i)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow_side(rest, odds, near)
        for i in rest:
            label[i] = i in side
    return label  # type: ignore[return-value]


def _max_flow_side(nodes: list[int], odds: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source side of a minimum cut, by blocking flows in level graphs."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        room[i] = dict(near[i])
    for i in nodes:
        if odds[i] > 0:
            room[source][i], room[i][source] = odds[i], 0.0
        else:
            room[i][sink], room[sink][i] = -odds[i], 0.0
    tiny = 1e-12
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return {i for i in nodes if i in level}
        tries = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= flow
                    room[b][a] += flow
                path = [source]
                tries[source] = iter(list(room[source]))
                continue
            for v in tries[u]:
                if room[u][v] > tiny and level.get(v, -1) == level[u] + 1:
                    path.append(v)
                    break
            else:
                level[u] = -1
                path.pop()
                if path:
                    tries[path[-1]] = iter(list(room[path[-1]]))


def labelled(page: str | None, weights: tuple[float, ...] | None = None) -> tuple[list[Block], list[bool], list[str]]:
    """The page's blocks, whether each is content, and the text that it then has: without the parts that the cut takes from the line."""
    w = weights or costs()
    found = blocks(page or "")
    odds, joined, of_part = odds_of(found, w), edges(found), {}
    for i, b in enumerate(found):
        for k, (text, against) in enumerate(b.pieces):
            if against:
                of_part[i, k] = len(odds)
                sides = bool("".join(x for x, _ in b.pieces[:k]).strip()) + bool("".join(x for x, _ in b.pieces[k + 1 :]).strip())
                joined.append((i, len(odds), SMOOTH * (PART if against == INNER_PART else LOOSE) * sides))
                odds.append(PART_PRIOR + w[_WORDS] * against)
    label = min_cut(odds, joined)
    texts = [" ".join("".join(x for k, (x, _) in enumerate(b.pieces) if (i, k) not in of_part or label[of_part[i, k]]).split()) if len(b.pieces) > 1 else b.text for i, b in enumerate(found)]
    return found, label[: len(found)], texts


def main_blocks(page: str | None, weights: tuple[float, ...] | None = None) -> list[str]:
    _, label, texts = labelled(page, weights)
    return [t for t, content in zip(texts, label, strict=True) if content]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of every page. Costs are fitted once, on the driver."""
    weights = costs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "html", 8_000_000):
            found = [main_blocks(page, weights) for page in batch.column(2).to_pylist()]
            texts = ["\n\n".join(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, found)), pa.int32())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int")
