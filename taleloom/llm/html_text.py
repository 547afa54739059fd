"""Main text of web pages by minimum cut.

A page becomes blocks of text. A linear classifier gives each block a cost of calling it content and a cost of
calling it boilerplate: its edges to the two terminals. Neighbours in page order, and blocks near each other in the
document tree, are joined by edges that cost what parting them costs. The minimum cut, found by maximum flow,
is the cheapest labelling as a whole: it decides blocks that tell little themselves by what stands around them.

The classifier is logistic regression, fitted on generated pages (page_samples) whose blocks are known. Tags, names of
classes and the text's shape are features; names that articles use too are planted in both.
"""

from __future__ import annotations

import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"""[^"'>]*""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "noframes", "math", "canvas", "audio", "video"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header head hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag closes, if it is open in the same container.
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_CONTAINERS = {"ul", "ol", "dl", "table", "select", "article", "main"}
#: End tags of other elements don't reach out of these.
_WALLS = {"article", "main", "body"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_LEAVES = _HEADINGS | {"p", "li", "blockquote", "pre", "dd", "dt", "td", "figcaption", "caption", "summary"}

_BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "search", "fieldset"}
_BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "status", "toolbar"}
_NAMES = "(?:^|[\\s_-])(?:{})(?:$|[\\s_-])"
#: Names of what is no article, and names that parts of an article bear as well.
_BOILER_NAMES = re.compile(_NAMES.format(
    r"ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|side-?bar|footer\w*|foot|masthead|topbar|site-?header|page-?header|"
    r"cookie\w*|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|sign-?in|login|paywall|share|sharing|social\w*|related\w*|recommend\w*|trending|widget\w*|"
    r"comments?|comment-?list|replies|reply|respond|disqus\w*|pagination|pager|toolbar|copyright|tag-?list|skip-?link|sr-only|byline-?share|outbrain|taboola|teaser\w*"
))
_WEAK_NAMES = re.compile(_NAMES.format(r"banner|notice\w*|reviews?|search\w*|legal|disclaimer|tags?|popular|alert|info|note|meta|aside|header|top|bottom"))
_CONTENT_NAMES = re.compile(_NAMES.format(r"article\w*|main|content|post|post-?body|entry|entry-?content|story\w*|body-?text|text|page-?content|prose"))
_BOILER_TEXT = re.compile(r"©|\(c\) ?\d{4}|all rights reserved|cookies?\b.*\b(?:accept|policy)|subscribe|sign (?:in|up)|log ?in\b|privacy policy|terms of (?:use|service)", re.I)
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)]*$")

# Flags of an element, inherited by what it holds. Inside a container of content, the marks of boilerplate begin anew.
_TAG_CONTENT, _NAME_CONTENT, _TAG_BOILER, _NAME_BOILER, _NAME_WEAK, _LEAF_BOILER, _LEAF_WEAK, _HEADER, _HIDDEN = (1 << i for i in range(9))
_MARKS = _TAG_BOILER | _NAME_BOILER | _NAME_WEAK | _HEADER
_OUTER = 9  # marks shifted by so much: of what holds the container of content

#: What the classifier knows of a block.
FEATURES = (
    "none", "content tag", "content name", "boilerplate tag", "boilerplate name", "weak name", "leaf with a boilerplate name", "leaf with a weak name", "header", "hidden", "boilerplate tag outside",
    "boilerplate name outside", "weak name outside", "header outside", "length", "linked", "sentence", "paragraph", "heading", "item", "boilerplate text", "content name and weak name", "outside all elements",
)
#: Capacity between neighbours a step apart in the tree, and between a block and the next but one, in hundredths of log odds.
SMOOTHNESS, SECOND = 120, 80


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    tag: str
    flags: int
    depth: int  # open block elements
    low: int  # the least depth since the block before


def _flags(tag: str, attributes: str, above: int) -> int:
    return _inherit(above, _own_flags(tag, attributes) if len(attributes) < 200 else _own_flags.__wrapped__(tag, attributes))


def _inherit(above: int, own: int) -> int:
    above &= ~(_LEAF_BOILER | _LEAF_WEAK)
    if own & (_TAG_CONTENT | _NAME_CONTENT):
        above = above & ~_MARKS | (above & _MARKS) << _OUTER
    return above | own


@lru_cache(maxsize=20_000)
def _own_flags(tag: str, attributes: str) -> int:
    out = _TAG_BOILER if tag in _BOILER_TAGS else _TAG_CONTENT if tag in ("article", "main") else _HEADER if tag == "header" else 0
    if not attributes.strip():
        return out
    got = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    names, role = f"{got.get('class', '')} {got.get('id', '')}", got.get("role")
    if tag not in ("body", "html", "article", "main"):
        leaf = tag in _LEAVES
        if _BOILER_NAMES.search(names):
            out |= _LEAF_BOILER if leaf else _NAME_BOILER
        elif _WEAK_NAMES.search(names):
            out |= _LEAF_WEAK if leaf else _NAME_WEAK
    if role in _BOILER_ROLES:
        out |= _TAG_BOILER
    if role in ("main", "article") or got.get("itemprop") == "articlebody":
        out |= _TAG_CONTENT
    elif tag in ("div", "section", "td") and not out & _NAME_BOILER and _CONTENT_NAMES.search(names):
        out |= _NAME_CONTENT
    if "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", ""):
        out |= _HIDDEN
    return out


class _Tokens:
    """Tags and texts of a page, in time proportional to its length."""

    def __init__(self, html: str):
        self.html, self.at, self.last = html, 0, html.rfind(">")
        self.unclosed: set[str] = set()  # quotes of which no more comes

    def _tag_end(self, at: int) -> int:
        """Where the tag's `>` is: the first one outside quotes, or the first one, if a quote is not closed."""
        i = at
        while True:
            i = _PLAIN.match(self.html, i).end()
            if i >= len(self.html):
                return self.html.find(">", at)
            if self.html[i] == ">":
                return i
            quote = self.html[i]
            i = -1 if quote in self.unclosed else self.html.find(quote, i + 1)
            if i < 0:
                self.unclosed.add(quote)
                return self.html.find(">", at)
            i += 1

    def __iter__(self) -> Iterator[tuple[str, bool, str]]:
        """(tag, whether it ends, attributes), or ("", False, text)."""
        html, size = self.html, len(self.html)
        while self.at < size:
            at = self.at
            if html[at] != "<":
                end = html.find("<", at)
                self.at = size if end < 0 else end
                yield "", False, html[at : self.at]
            elif html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                self.at = size if end < 0 else end + 3
            elif at > self.last:  # no tag closes from here on
                self.at = size
                yield "", False, html[at:]
            elif html[at + 1] in "!?":
                self.at = html.find(">", at) + 1
            elif m := _TAG.match(html, at):
                end = self._tag_end(m.end())
                self.at = end + 1
                yield m[2].lower(), bool(m[1]), html[m.end() : end]
            else:
                self.at += 1
                yield "", False, "<"

    def skip(self, tag: str) -> None:
        """On behind the end tag of an element whose content is no text."""
        end = _RAW_END[tag].search(self.html, self.at, self.last + 1)
        self.at = end.end() if end else len(self.html)


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order, references decoded, white space squeezed. Broken markup is read as
    browsers do: an open paragraph ends where a block begins, and a stray end tag does nothing."""
    found: list[Block] = []
    stack: list[tuple[str, int, str]] = [("", 0, "")]  # tag, flags, the nearest block element's tag
    walls, scopes = [Counter()], [Counter()]  # open tags behind the nearest wall, and in the nearest container
    depth, low, links, linked = 0, 0, 0, 0
    parts: list[str] = []

    def flush() -> None:
        nonlocal linked, low
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, linked, stack[-1][2], stack[-1][1], depth, low))
                low = depth
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links, depth, low
        while len(stack) > at:
            tag = stack[-1][0]
            if tag in _BLOCK:
                flush()
                depth -= 1
                low = min(low, depth)
            links -= tag == "a"
            stack.pop()
            if tag in _WALLS:
                walls.pop()
            if tag in _CONTAINERS:
                scopes.pop()
            walls[-1][tag] -= 1
            scopes[-1][tag] -= 1

    tokens = _Tokens(html)
    for tag, ends, rest in tokens:
        if not tag:
            text = unescape(rest) if "&" in rest else rest
            parts.append(text)
            if links:
                linked += len(text)
        elif ends:
            if tag == "p" and not walls[-1]["p"]:
                flush()
            if tag == "br":
                parts.append(" ")
            if any(w[tag] > 0 for w in walls) if tag in _WALLS or tag == "html" else walls[-1][tag] > 0:
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                close(at)
        elif tag in _RAW:
            if not rest.endswith("/") or tag not in ("svg", "math", "object"):
                tokens.skip(tag)
            parts.append(" ")
        elif tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
        else:
            if tag in _BLOCK:
                flush()
                if stack[-1][2] == "p":  # an open paragraph ends here
                    at = len(stack) - 1
                    while stack[at][0] != "p":
                        at -= 1
                    close(at)
            if any(scopes[-1][x] > 0 for x in _CLOSES.get(tag, ())):
                at = len(stack) - 1
                while stack[at][0] not in _CLOSES[tag]:
                    at -= 1
                close(at)
            block = tag in _BLOCK
            walls[-1][tag] += 1
            scopes[-1][tag] += 1
            depth += block
            links += tag == "a"
            stack.append((tag, _flags(tag, rest, stack[-1][1]), tag if block else stack[-1][2]))
            if tag in _WALLS:
                walls.append(Counter())
            if tag in _CONTAINERS:
                scopes.append(Counter())
    close(1)
    flush()
    return found


def features(block: Block) -> list[float]:
    """In the order of FEATURES."""
    f, n = block.flags, len(block.text)
    outer = f >> _OUTER
    content = f & (_TAG_CONTENT | _NAME_CONTENT)
    return [
        1.0, bool(f & _TAG_CONTENT), bool(f & _NAME_CONTENT), bool(f & _TAG_BOILER), bool(f & _NAME_BOILER), bool(f & _NAME_WEAK and not f & _NAME_CONTENT), bool(f & _LEAF_BOILER), bool(f & _LEAF_WEAK), bool(f & _HEADER and not content),
        bool(f & _HIDDEN), bool(outer & _TAG_BOILER), bool(outer & _NAME_BOILER), bool(outer & _NAME_WEAK), bool(outer & _HEADER), min(3.0, n / 60), min(1.0, block.linked / n), bool(_SENTENCE_END.search(block.text)),
        block.tag == "p", block.tag in _HEADINGS, block.tag == "li", bool(n < 300 and _BOILER_TEXT.search(block.text)), bool(f & _NAME_WEAK and f & _NAME_CONTENT), not block.depth,
    ]


def page_samples(count: int, seed: int = 1) -> Iterator[str]:
    """Generated pages to learn from. A block whose text begins with K is content, one with B boilerplate."""
    rng = random.Random(seed)
    strong = "ad advert sponsor navbar menu breadcrumb sidebar footer cookie-bar consent popup newsletter subscribe login share social related recommended trending widget comments comment-list reply pagination".split()
    weak = "banner notice reviews search legal disclaimer tags popular alert info note".split()
    good = "content article-body post entry-content story text main".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(4, 20) + rng.choice(".." ".!?") for _ in range(rng.randint(a, b)))

    def leaf(mark: str, tag: str, text: str, chance: float) -> str:
        names = rng.choice([f' class="{rng.choice(weak)}"', f' id="{rng.choice(weak)}"']) if rng.random() < chance else ""
        return f"<{tag}{names}>{mark} {text}</{tag}>"

    def boiler(inside: bool) -> str:
        kind = rng.random()
        name = rng.choice(weak) if rng.random() < (0.1 if inside else 0.25) else rng.choice(strong)
        if kind < 0.3:
            items = "".join(f'<li><a href="#">B {words(1, 4)}</a></li>' for _ in range(rng.randint(2, 7)))
            return rng.choice([f"<nav><ul>{items}</ul></nav>", f'<ul class="{name}">{items}</ul>', f'<div class="{name}"><ul>{items}</ul></div>'])
        if kind < 0.55:
            return f'<div class="{name}">{leaf("B", "p", sentences(1, 2), 0.1) if rng.random() < 0.5 else "B " + sentences(1, 2)}</div>'
        if kind < 0.75:
            rows = "".join(leaf("B", rng.choice(["p", "p", "h3"]), sentences(1, 3), 0.05) for _ in range(rng.randint(1, 4)))
            return rng.choice([f"<aside>{rows}</aside>", f'<section class="{rng.choice(["comments", "comment-list", "related", "replies"])}"><h2>B {words(1, 2)}</h2>{rows}</section>', f'<div id="{name}">{rows}</div>'])
        if kind < 0.85:
            return f"<form><p>B {sentences(1, 1)}</p><input><button>B {words(1, 2)}</button></form>"
        if kind < 0.92 and not inside:
            return f"<div>B {rng.choice(['© ' + words(2, 4), 'subscribe ' + words(2, 5), words(1, 3), words(2, 9)])}</div>"
        return f'<p class="{rng.choice(strong)}">B {sentences(1, 1)}</p>'

    def article() -> str:
        out = [f"<h1>K {words(2, 9)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.2:
            out = [f"<header>{''.join(out)}<p>K {sentences(1, 1)}</p></header>"]
        for _ in range(rng.randint(2, 12)):
            kind = rng.random()
            if kind < 0.6:
                out.append(leaf("K", "p", sentences(1, 6), 0.06))
            elif kind < 0.7:
                out.append(leaf("K", rng.choice(["h2", "h3"]), words(1, 7), 0.08))
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>K {words(1, 8)}{rng.choice(['', '.'])}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.84:
                out.append(f"<p>K {words(1, 4)}{rng.choice(['', '.'])}</p>")
            elif kind < 0.88:
                out.append(f"<blockquote>K {sentences(1, 2)}</blockquote>")
            elif kind < 0.92:
                out.append(f'<div class="{rng.choice(weak)} {rng.choice(good)}"><p>K {sentences(1, 3)}</p></div>')
            else:
                out.append(boiler(True))
        return "".join(out)

    def group() -> str:  # boilerplate that no tag and no name tells
        return "<div>" + "".join(f"<p>B {rng.choice([words(1, 6), words(2, 6) + '.', words(2, 6) + '.', '<a href=#>' + words(2, 5) + '</a>'])}</p>" for _ in range(rng.randint(2, 6))) + "</div>"

    def plain() -> str:
        rows = [f"<h1>K {words(2, 9)}</h1>"] + [rng.choice([f"<p>K {sentences(2, 6)}</p>", f"<p>K {sentences(2, 6)}</p>", f"<p>K {sentences(1, 1)}</p>", f"<p>K {words(1, 5)}</p>", f"<h2>K {words(1, 5)}</h2>", f"<p>K {sentences(1, 1)}</p>"]) for _ in range(rng.randint(8, 20))]
        return f"<div>{''.join(rows)}</div>"

    for _ in range(count):
        if rng.random() < 0.4:
            yield f"<body>{''.join(group() for _ in range(rng.randint(1, 2)))}{plain()}{''.join(group() for _ in range(rng.randint(1, 2)))}</body>"
            continue
        before = [f"<header><h1>B {words(1, 3)}</h1><p>B {words(3, 9)}.</p></header>"] if rng.random() < 0.5 else []
        before += [boiler(False) for _ in range(rng.randint(0, 4))]
        after = [boiler(False) for _ in range(rng.randint(0, 5))] + ([f"<footer>B {rng.choice(['© ', ''])}{sentences(1, 2)}</footer>"] if rng.random() < 0.8 else [])
        left, right = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), (f'<div class="{rng.choice(good)}">', "</div>"), (f'<div id="{rng.choice(good)}">', "</div>"), ("<div>", "</div>")])
        if rng.random() < 0.15:
            left, right = f'<div class="{rng.choice(["with-sidebar", "popup", "note", "widget"])}">' + left, right + "</div>"
        stray = f"B {words(2, 20)}" if rng.random() < 0.1 else ""
        yield f"{stray}<body>{''.join(before)}{left}{article()}{right}{''.join(after)}</body>"


#: Pages that the classifier is fitted on, and the weight of the penalty on its weights.
SAMPLES, DECAY = 400, 3.0


@lru_cache(maxsize=1)
def fitted() -> tuple[float, ...]:
    """The classifier's weights: logistic regression by Newton's method."""
    found = [b for page in page_samples(SAMPLES) for b in blocks(page)]
    x = np.array([features(b) for b in found], dtype=np.float64)
    y = np.array([b.text[0] == "K" for b in found], dtype=np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + DECAY * np.eye(len(w)), x.T @ (y - p) - DECAY * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 6) for v in w)


def content_cost(block: Block, weights: tuple[float, ...]) -> int:
    """How much dearer boilerplate is than content for a block, in hundredths: the classifier's
    log odds of content. Negative: boilerplate is cheaper."""
    return round(100 * sum(w * x for w, x in zip(weights, features(block), strict=True)))


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness between neighbours: dearer to part the nearer they are in the tree; and between a block and the next
    but one, if all three have the same container."""
    out = []
    for i in range(len(found) - 1):
        a, b = found[i], found[i + 1]
        steps = a.depth + b.depth - 2 * b.low
        out.append((i, i + 1, SMOOTHNESS >> max(0, steps - 2)))
        if i + 2 < len(found) and a.depth == b.depth == found[i + 2].depth > 1 and b.low >= a.depth - 1 and found[i + 2].low >= b.depth - 1:
            out.append((i, i + 2, SECOND))
    return out


def minimum_cut(costs: list[int], joins: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the content side of the minimum cut. costs: the capacity from the content terminal if
    positive, to the boilerplate terminal if negative. joins: (i, j, capacity) both ways.

    A node whose terminal edge outweighs all its joins is on that terminal's side in a minimum cut; such nodes are
    settled first and their joins become their neighbours' terminal edges. Maximum flow by
    shortest augmenting paths decides the rest. Of equal cuts, the one with the least content.
    """
    n = len(costs)
    cost = list(costs)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in joins:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    side: list[bool | None] = [None] * n
    work = deque(range(n))
    while work:
        i = work.popleft()
        if side[i] is not None or abs(cost[i]) <= sum(near[i].values()):
            continue
        side[i] = cost[i] > 0
        for j, c in near[i].items():
            del near[j][i]
            cost[j] += c if side[i] else -c
            work.append(j)
        near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if not left:
        return [bool(x) for x in side]
    s, t = -1, -2
    rest: dict[int, dict[int, int]] = {i: dict(near[i]) for i in left}
    rest[s], rest[t] = {i: cost[i] for i in left if cost[i] > 0}, {}
    for i in left:
        rest[i][s] = 0
        if cost[i] < 0:
            rest[i][t] = -cost[i]
        rest[t][i] = 0
    while True:
        came: dict[int, int] = {s: s}
        queue = deque([s])
        while queue and t not in came:
            i = queue.popleft()
            for j, c in rest[i].items():
                if c > 0 and j not in came:
                    came[j] = i
                    queue.append(j)
        if t not in came:
            break
        way, j = [], t
        while j != s:
            way.append((came[j], j))
            j = came[j]
        flow = min(rest[i][j] for i, j in way)
        for i, j in way:
            rest[i][j] -= flow
            rest[j][i] = rest[j].get(i, 0) + flow
    return [x if x is not None else i in came for i, x in enumerate(side)]


def main_text(html: str, weights: tuple[float, ...] | None = None) -> str:
    """The blocks on the content side, in page order, one to a line; empty if none."""
    found = blocks(html)
    weights = weights or fitted()
    kept = minimum_cut([content_cost(b, weights) for b in found], edges(found))
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def _extracted(weights: tuple[float, ...]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return extract


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars (code points).

    A null html is empty and gives an empty text; null ids and urls stay; repeated rows repeat; other columns are
    ignored. Whole pages are read; nothing is capped.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(fitted()), "page_id long, url string, text string, n_chars long")
