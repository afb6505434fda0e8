"""HTML extraction by minimum cut: content and boilerplate are the two sides of a cut through the page's blocks.

A page is cut into blocks of text at its block-level tags. A logistic classifier gives each block the cost of calling it content
and that of calling it boilerplate; these are the capacities of its edges to the two terminals, times a weight that
grows with its length. Blocks that follow each other, and blocks under the same parent, have edges whose capacity falls with
their distance in the tree, so that a label costs something where it changes. The maximum flow separates the two.

The classifier is trained here, on a bounded sample of pages (``sample``, by hash of their id), from blocks whose tags tell what
they are (article and main; nav, footer, aside, header, form). Its features are of the text and its place, not of those tags,
so that it also holds for pages without them; where a page has them, they add to the score (``TAG_SCORE``).

Each page is worked on by itself: no shuffle but the one of the sample. Defined results: a null page has null text, an empty one
or one without text has empty text; broken markup (tags not closed, closed twice, cut off) is read as far as it makes
sense, in one pass, so that its time grows with its length; white space within pre is kept; repeated rows have equal results; null ids are passed on, but such pages are not in the sample; an empty table gives no
rows; without a sample of both kinds the weights ``DEFAULT`` hold. Further columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from math import exp, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import quoted

#: Pages that the classifier is trained on.
SAMPLE = 400
#: What tags and class names around a block add to its score.
TAG_SCORE = 2.0
#: Capacities between blocks that follow each other, and between those of one parent.
NEXT, SIBLING = 0.6, 0.6
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head script style noscript template title svg math iframe object select textarea button".split())
#: What an open head may hold; other tags, and text, end it.
HEAD = frozenset("html head title style script noscript template base basefont bgsound link meta".split())
CONTENT = frozenset("article main".split())
BOILERPLATE = frozenset("nav footer aside header form menu".split())
_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sidebar|menu|nav\w*|breadcrumbs?|footer|cookies?|share|social|related|promo|sponsor\w*|popup|comments?)(?:$|[\s_-])")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
#: To the end of a tag; no way back, so a tag without one fails at once.
_REST = re.compile(r"((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>")
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style noscript template svg iframe textarea title".split()}
_SENTENCE = re.compile(r"[.!?…][\"'»”)]?(?:\s|$)")
FEATURES = 9
DEFAULT = (-1.6, 0.7, -3.0, 0.6, 0.6, -0.5, 0.2, -0.6, 0.0, 0.0)


def closed(page: str, name: str) -> set[int]:
    """Where the elements of a name begin that have an end tag; only objects can hold others."""
    begun: list[int] = []
    out = set()
    for m in re.finditer(rf"<(/?){name}\b", page, re.I):
        if not m[1]:
            if name != "object":
                begun.clear()
            begun.append(m.start())
        elif begun:
            out.add(begun.pop())
    return out


def pieces(page: str) -> Iterator[tuple[str | None, int, str, bool, str]]:
    """(text, place, name, closing, attributes) of the texts and tags of a page, in one pass; comments and raw elements are left out.

    A tag without an end is text. From the first quote that isn't closed on, quotes in tags mean nothing.
    """
    at, size, last, loose = 0, len(page), page.rfind(">"), False
    while at < size:
        lt = page.find("<", at)
        if lt != at:
            yield page[at : lt if lt >= 0 else size], at, "", False, ""
            if lt < 0:
                return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        if lt > last:
            yield page[lt:], lt, "", False, ""
            return
        m = _TAG.match(page, lt)
        if m is None:
            if page[lt + 1] in "!?":
                at = page.find(">", lt) + 1
            else:
                yield "<", lt, "", False, ""
                at = lt + 1
            continue
        rest = None if loose else _REST.match(page, m.end())
        if rest is None:
            loose = True
            at = page.find(">", m.end()) + 1
            inner = page[m.end() : at - 1]
        else:
            at, inner = rest.end(), rest[1]
        name, closing = m[2].lower(), m[1] == "/"
        if not closing and name in _RAW and not (inner.endswith("/") and name in ("svg", "iframe", "template")):
            end = _RAW[name].search(page, at)
            at = end.end() if end else size
            continue
        yield None, lt, name, closing, inner


class Block:
    """A run of text between block-level tags. node: the element that it is in; above: the one around that."""

    __slots__ = ("above", "depth", "linked", "node", "parts", "pre", "tag", "text", "tone")

    def __init__(self, stack: list[tuple[str, int, int]], tone: int, pre: bool) -> None:
        self.parts, self.linked, self.tone, self.pre = [], 0, tone, pre
        self.tag, self.node = (stack[-1][0], stack[-1][1]) if stack else ("", 0)
        self.above = stack[-2][1] if len(stack) > 1 else 0
        self.depth = len(stack)
        self.text = ""


def blocks(page: str, tree: list[tuple[int, int]] | None = None) -> list[Block]:
    """The blocks of a page that have text. tree: gets the parent and the depth of each element."""
    stack: list[tuple[str, int, int]] = []  # name, number, tone: 1 in content, -1 in boilerplate
    tree = [] if tree is None else tree
    tree.append((0, 0))
    out: list[Block] = []
    now: Block | None = None
    links, tone, hidden = 0, 0, 0
    opened: Counter[str] = Counter()
    ended: dict[str, set[int]] = {}
    loose: set[int] = set()  # hidden elements without an end tag: the next block ends them

    def pop(name: str) -> None:
        nonlocal tone, hidden
        while stack:
            x = stack.pop()
            opened[x[0]] -= 1
            hidden -= x[0] in NO_TEXT
            if x[0] == name:
                break
        tone = stack[-1][2] if stack else 0

    for text, place, name, closing, inner in pieces(page):
        if text is not None:
            if hidden and stack[-1][0] == "head" and not text.isspace():
                pop("head")
            if hidden:
                continue
            if now is None:
                if text.isspace():
                    continue
                now = Block(stack, tone, opened["pre"] > 0)
                out.append(now)
            text = html.unescape(text)
            now.parts.append(text)
            if links:
                now.linked += len(text)
            continue
        if name in ("svg", "iframe", "template") and inner.endswith("/"):
            continue
        if hidden and not closing and name not in HEAD and stack[-1][0] == "head":
            pop("head")
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        if name == "br":
            if now is not None:
                now.parts.append("\n")
            continue
        now, links = None, 0
        if name in VOID:
            continue
        if closing:
            if opened[name] > 0:
                pop(name)
            continue
        if loose and name not in ("option", "optgroup"):
            for x in stack:
                if x[1] in loose:
                    while x in stack:
                        pop(stack[-1][0])
                    break
            loose.clear()
        if hidden and stack[-1][0] in ("button", "select", "object"):
            outer = next((x[0] for x in reversed(stack) if x[0] not in ("button", "select", "object")), "")
            if outer == name and outer in ("p", "li", "dt", "dd"):
                pop(outer)
        if stack and stack[-1][0] in ("p", "li", "dt", "dd", "option") and (name == stack[-1][0] or stack[-1][0] == "p"):
            pop(stack[-1][0])  # these end where the next one begins
        here = tone
        if name in CONTENT:
            here = 1
        elif name in BOILERPLATE:
            here = -1
        elif inner:
            for a in _ATTRIBUTE.finditer(inner):
                if _NAMES.search((a[1] or a[2] or a[3] or "").lower()):
                    here = -1
        if not inner.rstrip().endswith("/"):
            tone, number = here, len(tree)
            tree.append((stack[-1][1] if stack else 0, len(stack) + 1))
            stack.append((name, number, tone))
            opened[name] += 1
            hidden += name in NO_TEXT
            if name in ("button", "select", "object"):
                if name not in ended:
                    ended[name] = closed(page, name)
                if place not in ended[name]:
                    loose.add(number)
    kept = []
    for b in out:
        whole = "".join(b.parts)
        if b.pre:  # code: white space is content
            b.text = whole.strip("\r\n").rstrip() if not whole.isspace() else ""
        else:
            lines = [" ".join(x.split()) for x in whole.split("\n")]
            b.text = "\n".join(x for x in lines if x)
        if b.text:
            kept.append(b)
    return kept


def features(found: list[Block]) -> list[list[float]]:
    """What the classifier sees of each block: text and place."""
    out, n = [], len(found)
    for i, b in enumerate(found):
        words = b.text.split()
        size = len(b.text)
        out.append(
            [
                log1p(len(words)) - 2.0,
                min(1.0, b.linked / size),
                1.0 if _SENTENCE.search(b.text) else 0.0,
                min(3.0, len(_SENTENCE.findall(b.text)) / 3),
                1.0 if b.tag == "li" else 0.0,
                1.0 if len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit() else 0.0,
                sum(w[0].isupper() for w in words) / len(words),
                i / n,
                log1p(b.depth) - 1.5,
            ]
        )
    return out


def train(pages: list[str]) -> tuple[float, ...]:
    """Weights (the constant first) by regularised Newton steps, from blocks whose tags tell what they are."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        for b, f in zip(found, features(found)):
            if b.tone:
                x.append([1.0, *f])
                y.append(b.tone > 0)
    if len(set(y)) < 2:
        return DEFAULT
    x, y = np.array(x), np.array(y, dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + 0.01 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(curve, gradient)
    return tuple(float(v) for v in w)


def min_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of a minimum cut.

    content: what it costs to call a node content, boilerplate: to call it boilerplate; an edge costs its capacity where its two nodes
    differ. Where several cuts are minimal, the one with the fewest content nodes is taken.
    """
    n = len(content)
    # Flow from terminal to terminal through one node needs no search. What is left of the capacity is either on the one side or on the other.
    spare = [boilerplate[i] - content[i] for i in range(n)]
    head, to, room, following = [-1] * (n + 2), [], [], []

    def add(a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            to.append(y)
            room.append(c)
            following.append(head[x])
            head[x] = len(to) - 1

    source, sink = n, n + 1
    for i, s in enumerate(spare):
        if s > 0:
            add(source, i, s, 0.0)
        elif s < 0:
            add(i, sink, -s, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    tiny = 1e-12
    while True:  # Dinic's phases
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            e = head[v]
            while e >= 0:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
                e = following[e]
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        current, path, v = list(head), [], source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                keep = next(k for k, e in enumerate(path) if room[e] <= tiny)
                v = to[path[keep] ^ 1]
                del path[keep:]
                continue
            e = current[v]
            while e >= 0 and not (room[e] > tiny and level[to[e]] == level[v] + 1):
                e = following[e]
            current[v] = e
            if e >= 0:
                path.append(e)
                v = to[e]
            elif v == source:
                break
            else:
                level[v] = -1
                e = path.pop()
                v = to[e ^ 1]


def apart(a: int, b: int, tree: list[tuple[int, int]]) -> int:
    """Steps between two elements. Between blocks that follow each other these are no more than the tags between them."""
    steps = 0
    while a != b:
        if tree[a][1] < tree[b][1]:
            a, b = b, a
        a = tree[a][0]
        steps += 1
    return steps


def graph(found: list[Block], weights: tuple[float, ...], tree: list[tuple[int, int]]) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """The capacities for ``min_cut``."""
    content, boilerplate, edges = [], [], []
    last: dict[int, int] = {}
    for i, (b, f) in enumerate(zip(found, features(found))):
        score = weights[0] + sum(w * v for w, v in zip(weights[1:], f)) + TAG_SCORE * b.tone
        score = max(-8.0, min(8.0, score))
        weight = sqrt(1 + b.text.count(" "))
        content.append(weight * log(1 + exp(-score)))
        boilerplate.append(weight * log(1 + exp(score)))
        if i:
            edges.append((i - 1, i, NEXT / (1 + apart(found[i - 1].node, b.node, tree))))
        if b.above in last:
            edges.append((last[b.above], i, SIBLING / (1 + apart(found[last[b.above]].node, b.node, tree))))
        last[b.above] = i
    return content, boilerplate, edges


def extracted(page: str, weights: tuple[float, ...]) -> tuple[str, int, int]:
    """The text of a page's content, how many blocks it has, and how many are content."""
    tree: list[tuple[int, int]] = []
    found = blocks(page, tree)
    sides = min_cut(*graph(found, weights, tree)) if found else []
    kept = [b.text for b, x in zip(found, sides) if x]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """``page_id``, ``text``, ``n_blocks``, ``n_content`` of each page."""
    only = pages.select(quoted(id_col).alias("page_id"), quoted(html_col).cast("string").alias("html"))
    # The ids first: only the pages of the sample go to the driver.
    ids = only.filter("page_id is not null and html is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    known = only.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id")
    weights = train([r["html"] for r in known.select("html").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [extracted(x, weights) if x is not None else (None, None, None) for x in b.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 3
            made = [pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["page_id", "text", "n_blocks", "n_content"])

    kind = pages.schema[id_col].dataType.simpleString()
    return only.mapInArrow(run, f"page_id {kind}, text string, n_blocks int, n_content int")
