"""HTML main-text extraction by union-free regular expressions inferred from the pages of a host.

A page is read into a tree of its block elements and text slots. Runs of equal siblings fold into a
repeated group; two trees align child by child, where what only one of them has becomes optional, and
texts that differ turn a fixed slot into a variable one. Folding all pages of a host so gives its
wrapper, a regular expression without unions. The wrapper tells where the host's article stands: in its
article elements, in its main element, in what its classes name as the content, or else in the deepest
element that holds most of the text that varies from page to page. All text of that place is the main text,
whether or not other pages share it and whether or not it is links; only menus, headers, footers,
sidebars, notices, adverts, forms and comments inside it go, by their elements, or by a class, id or role
that names a container (never a paragraph, heading or list item) as a whole.

Wrappers fold first inside each task, then by host and salt, then by host, so that a host with a third
of all pages is never gathered. A wrapper has at most ``WRAPPER_NODES`` nodes: rare markup is summed up in its
parent beyond that, and children of more than ``WIDE`` different names in their elements' names. That bounds
memory and what the wrapper can tell apart; it drops no text.

Defined cases: null or empty html gives an empty text; pages whose url is null or has no host share one
wrapper; a page without the place that its host's wrapper tells is judged by its own tree; unclosed and
truncated markup is read up to its end; elements nested deeper than ``DEEPEST`` count as children of that
depth and keep their marks, so that nesting, siblings and texts of any number and length are read in one
pass; repeated rows each keep theirs; columns named text or n_chars are replaced, others pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.url_filter import url_host
from tessera.session import cut

#: Decision tables of up to so many bytes are broadcast; larger ones are joined by salted shuffles.
BROADCAST_BYTES = 32_000_000
SALTS = 16
DEEPEST = 120
WIDE = 256
WRAPPER_NODES = 20_000
#: Lists of children whose lengths' product is larger are aligned at names that occur once in each.
EXACT_CELLS = 10_000

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|[^>]*(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {n: re.compile(rf"</{n}\b[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "textarea", "title", "xmp", "noembed", "noframes")}
_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track")
BLOCK = _words(
    "html head body address article aside blockquote button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio math"
)
DROPPED = _words("head script style noscript template svg iframe object video audio canvas nav footer aside form button select option textarea dialog menu input search math")
CLOSES_P = BLOCK - _words("button iframe noscript object select option optgroup svg template video audio canvas math")
CLOSES = {"li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr td th"), "td": _words("td th"), "th": _words("td th"), "option": _words("option"), "tbody": _words("thead tbody tr td th"), "tfoot": _words("tbody tr td th")}
SCOPES = {"li": _words("ul ol menu dir"), "dt": _words("dl"), "dd": _words("dl"), "tr": _words("table"), "td": _words("table"), "th": _words("table"), "option": _words("select"), "tbody": _words("table"), "tfoot": _words("table")}
#: Words in class, id or role that mark what isn't the article.
ODD = _words(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar skip skiplink "
    "footer contentinfo copyright masthead sidebar sidebars rail widget widgets complementary related recommended recommendations trending "
    "notice notices cookie cookies consent gdpr alert popup modal overlay toast newsletter subscribe subscription signup paywall disclaimer "
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promoted promotion banner "
    "comment comments commentlist respond disqus replies reply login searchbox share sharing social"
)
OUTSIDE = _words("header head")
CONTENT = _words("content article articlebody post entry story main maincontent text bodytext")
#: Parts of a name that leave what it marks as it is, and first parts that turn it round.
NEUTRAL = _words("box list links link bar wrapper wrap container section block area button buttons item items top bottom left right site page global inner outer slot unit zone holder panel group col column primary secondary js")
TURNED = _words("no has with without is not")
TEXT_BLOCKS = _words("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address figcaption")


class Node:
    """An element, a repeated group (name ``+``), a summed-up element (name ``~``) or a slot (name ``#``)."""

    __slots__ = ("chars", "fixed", "kids", "linked", "name", "odd", "optional", "pages", "path", "place", "repeated", "text")

    def __init__(self, name: str, kids=None, repeated=False, optional=False, odd=0, place=0, pages=1, chars=0, linked=0, fixed=None):  # noqa: ANN001
        self.name, self.kids, self.repeated, self.optional = name, [] if kids is None else kids, repeated, optional
        self.odd = odd  # 1: by its class, 2: by its element
        self.place = place  # 1: a likely content container, 2: main, 3: article
        self.pages, self.chars, self.linked = pages, chars, linked
        self.fixed: int | None = fixed
        self.text, self.path = "", 0

    def pack(self) -> list:
        return [self.name, [k.pack() for k in self.kids], int(self.repeated), int(self.optional), self.odd, self.place, self.pages, self.chars, self.linked, self.fixed]

    @staticmethod
    def unpack(x: list) -> Node:
        return Node(x[0], [Node.unpack(k) for k in x[1]], bool(x[2]), bool(x[3]), *x[4:10])

    def tag(self) -> str:
        return self.name.split(".")[0].split("#")[0]


def _roles(value: str, words: frozenset[str]) -> bool:
    """Is one of the names, as a whole, of these words? Its last part is, or its first and the others are neutral."""
    for name in value.split():
        parts = [x for x in _SPLIT.split(_CAMEL.sub("-", name).lower()) if x]
        if parts and parts[0] not in TURNED and (parts[-1] in words or parts[0] in words and NEUTRAL.issuperset(parts[1:])):
            return True
    return False


def _element(name: str, attrs: str | None) -> Node:
    node = Node(name, odd=2 if name in DROPPED else 0, place=3 if name == "article" else 2 if name == "main" else 0)
    if not attrs or name in ("html", "body"):
        return node
    label, marks = name, ""
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            label += ("." if key == "class" else "#") + re.sub(r"\d+", "0", value.strip())
            marks += " " + value
        elif key == "role":
            marks += " " + value
            if value.lower() in ("main", "article") and not node.place:
                node.place = 2 if value.lower() == "main" else 3
            elif value.lower() in ("search", "form"):
                node.odd = node.odd or 1
        elif key == "itemprop" and value.lower() == "articlebody":
            node.place = 3
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            node.odd = 2
    node.name = label[:200]
    if node.odd or name in TEXT_BLOCKS:
        return node
    if _roles(marks, ODD):
        node.odd = 1
    elif not node.place and _roles(marks, CONTENT):
        node.place = 1
    elif not node.place and _roles(marks, OUTSIDE):
        node.odd = 1
    return node


def _path(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), parent)


def read_page(page: str | None) -> Node:
    """The page's tree; a slot holds the text between two borders of blocks, its white space made single."""
    root = Node("")
    if not page:
        return root
    stack, names, open_ = [root], [""], {}
    parts: list[str] = []
    at = links = link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            slot = Node("#", chars=len(text), linked=min(len(text), link_chars), fixed=crc32(text.encode("utf-8", "surrogatepass")))
            slot.text = text
            stack[-1].kids.append(slot)
        parts.clear()
        link_chars = 0

    def pop_to(k: int) -> None:
        flush()
        for x in names[k:]:
            open_[x] -= 1
        del stack[k:], names[k:]

    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        a = m.start() if m else n
        if a > at:
            parts.append(page[at:a])
            if links:
                link_chars += a - at
        if not m:
            break
        pos = at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif open_.get(name):
                k = len(names) - 1
                while names[k] != name:
                    k -= 1
                pop_to(k)
            elif name in BLOCK or "-" in name:
                flush()
            continue
        if name in _RAW:
            end = _RAW[name].search(page, pos)
            pos = at = end.end() if end else n
            continue
        if name == "a":
            links = 1
            continue
        if name in VOID:
            parts.append(" ")
            continue
        if name not in BLOCK and "-" not in name:
            continue
        flush()
        if name in CLOSES_P and open_.get("p"):
            k = len(names) - 1
            while names[k] not in ("p", "table", "button", "object", ""):
                k -= 1
            if names[k] == "p":
                pop_to(k)
        if name in CLOSES and any(open_.get(x) for x in CLOSES[name]):
            k = len(names) - 1
            while k and names[k] not in SCOPES[name] and names[k] not in CLOSES[name]:
                k -= 1
            if k and names[k] in CLOSES[name]:
                pop_to(k)
        node = _element(name, m["attrs"])
        above = stack[-1]
        if len(stack) > DEEPEST:  # a child of that depth, with the marks of what is around it
            node.odd, node.place = max(node.odd, above.odd if len(stack) > DEEPEST + 1 else 0), max(node.place, above.place if len(stack) > DEEPEST + 1 else 0)
            above = stack[DEEPEST]
        node.path = _path(above.path, node.name)
        above.kids.append(node)
        stack.append(node)
        names.append(name)
        open_[name] = open_.get(name, 0) + 1
        links = 0
    flush()
    return root


def _pair(a: Node, b: Node, pages: int, between: bool) -> Node:
    """Two aligned parts as one; between: of different pages."""
    out = Node(a.name, [], a.repeated or b.repeated, a.optional or b.optional, max(a.odd, b.odd), max(a.place, b.place), pages, a.chars + b.chars, a.linked + b.linked)
    if a.fixed is not None and b.fixed is not None:
        out.fixed = (a.fixed + 31 * b.fixed) % (1 << 61) if not between else a.fixed if a.fixed == b.fixed else None
    if a.kids or b.kids:
        out.kids = _align(a.kids, b.kids, between)
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence of names: the longest for short lists, else one through names that occur once in each."""
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    out = [(i, i) for i in range(lo)]
    if len(x) * len(y) <= EXACT_CELLS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        times: dict[str, list[int]] = {}
        for names, side in ((x, 0), (y, 2)):
            for i, name in enumerate(names):
                t = times.setdefault(name, [0, 0, 0, 0])
                t[side] += 1
                t[side + 1] = i
        tops: list[tuple[int, int]] = []  # the longest rising run of places in b, by patience
        links: dict[tuple[int, int], tuple[int, int] | None] = {}
        for t in sorted((t for t in times.values() if t[0] == t[2] == 1), key=lambda t: t[1]):
            at = _bisect(tops, t[3])
            links[t[1], t[3]] = tops[at - 1] if at else None
            tops[at : at + 1] = [(t[1], t[3])]
        run, p = [], tops[-1] if tops else None
        while p:
            run.append((lo + p[0], lo + p[1]))
            p = links[p]
        out += run[::-1]
    return out + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]


def _bisect(tops: list[tuple[int, int]], place: int) -> int:
    a, b = 0, len(tops)
    while a < b:
        mid = (a + b) // 2
        a, b = (mid + 1, b) if tops[mid][1] < place else (a, mid)
    return a


def _align(a: list[Node], b: list[Node], between: bool) -> list[Node]:
    """Children aligned in order; what one side lacks becomes optional."""
    pages = (lambda x, y: x.pages + y.pages) if between else (lambda x, y: max(x.pages, y.pages))
    names, others = [x.name for x in a], [x.name for x in b]
    if names == others:
        return [_pair(x, y, pages(x, y), between) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in [*_common(names, others), (len(a), len(b))]:
        for x in (*a[i:p], *b[j:q]):
            x.optional = True
            out.append(x)
        if p < len(a):
            out.append(_pair(a[p], b[q], pages(a[p], b[q]), between))
        i, j = p + 1, q + 1
    return _narrow(_folded(out) if len(out) > max(len(a), len(b)) else out)


def _narrow(kids: list[Node]) -> list[Node]:
    """Children of at most ``WIDE`` names; more are summed up by their elements."""
    if len(kids) <= WIDE:
        return kids
    held: dict[tuple[str, int, int], Node] = {}
    for k in kids:
        tag = k.tag().lstrip("~+").split(" ")[0]
        name = k.name if k.name == "#" else "~" + (tag if tag in BLOCK else "")
        x = _summed(k, name)
        key = (name, x.odd, x.place)
        held[key] = x if key not in held else _pair(held[key], x, max(held[key].pages, x.pages), False)
    return list(held.values())


def _summed(node: Node, name: str) -> Node:
    """The node with a slot for each kind of text below it instead of its children."""
    if node.name == "#":
        return node
    sums: dict[tuple[int, int], Node] = {}

    def add(k: Node, odd: int, place: int) -> None:
        if k.name == "#":
            s = sums.setdefault((odd, place), Node("#", pages=node.pages))
            s.chars, s.linked = s.chars + k.chars, s.linked + k.linked
        for x in k.kids:
            add(x, max(odd, x.odd), max(place, x.place))

    add(node, 0, 0)
    kids = [s if key == (0, 0) else Node("~", [s], odd=key[0], place=key[1], pages=node.pages) for key, s in sorted(sums.items())]
    return Node(name, kids, True, node.optional, node.odd, node.place, node.pages)


def _folded(kids: list[Node]) -> list[Node]:
    """Children without repeats: runs of one to three names that occur again at once become groups."""
    for width in (1, 2, 3):
        out, i = [], 0
        while i < len(kids):
            unit = kids[i : i + width]
            names = [k.name for k in unit]
            j = i + width
            while len(unit) == width and [k.name for k in kids[j : j + width]] == names:
                unit = [_pair(x, y, max(x.pages, y.pages), False) for x, y in zip(unit, kids[j : j + width], strict=True)]
                j += width
            if j == i + width or len(unit) < width:
                out.append(kids[i])
                i += 1
            elif width == 1:
                unit[0].repeated = True
                out.append(unit[0])
                i = j
            else:
                out.append(Node("+" + " ".join(names), unit, repeated=True, pages=max(u.pages for u in unit)))
                i = j
        kids = out
    return kids


def generalised(node: Node) -> Node:
    """A page's tree with its repeats folded, from the leaves up."""
    for k in node.kids:
        generalised(k)
    node.kids = _narrow(_folded(node.kids))
    return node


def _size(node: Node) -> int:
    return 1 + sum(map(_size, node.kids))


def merged(a: Node | None, b: Node) -> Node:
    """Both wrappers as one; where that is too large, what few pages have is summed up."""
    out = b if a is None else _pair(a, b, a.pages + b.pages, True)
    few = 1
    while few <= out.pages and _size(out) > WRAPPER_NODES:
        stack = [out]
        while stack:
            x = stack.pop()
            x.kids = [k if k.pages > few or not k.kids else _summed(k, k.name) for k in x.kids]
            stack += [k for k in x.kids if k.pages > few]
        few *= 2
    return out


def _holds(node: Node) -> bool:
    """Does an article or a main element stand below?"""
    return any(not k.odd and (k.place >= 2 or _holds(k)) or k.odd == 2 and k.tag() == "form" and _holds(k) for k in node.kids)


def _chars(node: Node) -> int:
    return node.chars + sum(map(_chars, node.kids))


class _Judge:
    """Walks a tree with what is known of each element from those around it."""

    def __init__(self, root: Node):
        self.root, self.total = root, _chars(root)

    def odd(self, k: Node, inside: bool) -> bool:
        """A class doesn't count where an article stands within, nor does a form around most of a page."""
        if k.odd == 2:
            return not (k.tag() == "form" and (_holds(k) or _chars(k) > 0.6 * self.total))
        return (k.odd == 1 or k.tag() == "header" and not inside) and not _holds(k)

    def slots(self) -> Iterator[tuple[Node, bool, int, tuple[tuple[int, str], ...]]]:
        """(slot, odd, place, elements around it as (path, name)) in order."""
        stack: list = [(self.root, False, 0, ())]
        while stack:
            node, odd, place, around = stack.pop()
            if node.name == "#":
                yield node, odd, place, around
                continue
            for k in reversed(node.kids):
                if k.name == "#" or k.name[:1] == "+":
                    stack.append((k, odd, place, around))
                else:
                    own = (_path(around[-1][0] if around else 0, k.name), k.name)
                    stack.append((k, odd or self.odd(k, place >= 2), max(place, k.place), (*around, own)))


#: Where the article stands: a place as of ``Node``, or 0 and the path of an element, and paths that don't count there.
Decision = tuple[int, int, list[int]]


def decide(wrapper: Node) -> Decision:
    """The place of the host's article."""
    able = [(k, place, around) for k, odd, place, around in _Judge(wrapper).slots() if not odd]
    chars = lambda least: sum(k.chars for k, place, _ in able if place >= least)
    if chars(3) and chars(3) >= 0.5 * chars(2):
        return 3, 0, []
    if chars(2):
        return 2, 0, []
    if chars(1) and chars(1) >= 0.4 * chars(0):
        return 1, 0, []
    # What varies from page to page counts, or all text if nothing does.
    free = [(k.chars - k.linked if k.fixed is None else 0, around) for k, _, around in able]
    if not sum(w for w, _ in free):
        free = [(k.chars - k.linked, around) for k, _, around in able]
    total, depth, best = sum(w for w, _ in free), 0, (0, "")
    while total:  # the deepest element of most of that text
        steps: dict[tuple[int, str], int] = {}
        for w, around in free:
            if len(around) > depth and (not depth or around[depth - 1] == best):
                steps[around[depth]] = steps.get(around[depth], 0) + w
        top = max(steps, key=lambda x: (steps[x], x), default=None)
        if top is None or steps[top] < 0.7 * total or top[1][:1] == "~" or re.split(r"[.#]", top[1])[0] in TEXT_BLOCKS:
            break
        best, depth = top, depth + 1
    if best[1] not in ("", "html", "body"):
        return 0, best[0], []
    # The whole page: link lists, and what all pages share, go before and after the text that varies.
    at = [i for i, (w, _) in enumerate(free) if w]
    sides = able[: at[0]] + able[at[-1] + 1 :] if at else []
    between = {p for _, _, around in able[at[0] : at[-1] + 1] for p, _ in around} if at else set()
    skipped = set()
    for k, _, around in sides:
        top = next((p for p, name in around[depth:] if p not in between and re.split(r"[.#]", name)[0] not in TEXT_BLOCKS), None)
        if top is not None and (k.linked > 0.9 * k.chars or k.fixed is not None and wrapper.pages > 1):
            skipped.add(top)
    return 0, best[0], sorted(skipped)


def extract(page: str | None, decision: Decision | None) -> str:
    tree = read_page(page)
    found = _taken(tree, decision) if decision else None
    if found is None:
        found = _taken(tree, decide(generalised(read_page(page)))) or []
    return " ".join(found)


def _taken(tree: Node, decision: Decision) -> list[str] | None:
    """Texts at the decision's place; None if the page has no such place."""
    least, path, skipped = decision
    judge, out, there = _Judge(tree), [], not least and not path
    stack: list[tuple[Node, bool, int]] = [(tree, False, 0)]
    while stack:
        node, inside, place = stack.pop()
        if node.name == "#":
            if inside or not least and not path:
                out.append(node.text)
            continue
        for k in reversed(node.kids):
            if k.name != "#" and (k.path in skipped or judge.odd(k, place >= 2)):
                continue
            now = max(place, k.place)
            within = inside or k.name != "#" and (now >= least if least else k.path == path)
            there = there or within
            stack.append((k, within, now))
    return out if there else None


def infer_wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) with one wrapper, as JSON, of all pages of each host."""

    def fold(rows: Iterator[tuple[str, Node]]) -> pa.RecordBatch:
        held: dict[str, Node | None] = {}
        for host, node in rows:
            held[host] = merged(held.get(host), node)
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w.pack()) for w in held.values()], pa.string())], names=["host", "wrapper"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fold((h, generalised(read_page(t))) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    def again(table: pa.Table) -> pa.Table:
        host = table["host"][0].as_py()
        packed = sorted(table["wrapper"].to_pylist())
        return pa.Table.from_batches([fold((host, Node.unpack(json.loads(w))) for w in packed)])

    schema = "host string, wrapper string"
    rows = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(read, schema)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).groupBy("host", "salt").applyInArrow(again, schema)
    return rows.groupBy("host").applyInArrow(again, schema)


def extract_pages(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The input without its html, with text and n_chars."""
    schema = "__host string, __place int, __path long, __skipped array<long>"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decide(Node.unpack(json.loads(w))) for w in batch.column(1).to_pylist()]
            signed = lambda x: np.array(x, np.uint64).astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in found], pa.int32()), pa.array(signed([d[1] for d in found]), pa.int64()), pa.array([signed(d[2]) for d in found], pa.list_(pa.int64()))],
                names=["__host", "__place", "__path", "__skipped"],
            )

    decisions = cut(infer_wrappers(pages, url_col=url_col, html_col=html_col).mapInArrow(judge, schema))
    held = decisions.agg(F.sum(F.length("__host") + 8 * F.size("__skipped") + 64)).first()[0] or 0
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.withColumn("__page_host", url_host(F.col(url_col)))
    if held <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(decisions), F.col("__page_host") == F.col("__host"), "left")
    else:
        salts = decisions.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__page_salt", F.pmod(F.xxhash64(html_col), F.lit(SALTS)).cast("int"))
        joined = rows.join(salts, (F.col("__page_host") == F.col("__host")) & (F.col("__page_salt") == F.col("__salt")), "left")

    @F.pandas_udf("string")
    def main_text(page: pd.Series, place: pd.Series, path: pd.Series, skipped: pd.Series) -> pd.Series:
        out = []
        for html, p, at, gone in zip(page, place, path, skipped, strict=True):
            unsigned = lambda x: int(x) % (1 << 64)
            out.append(extract(html, None if pd.isna(p) else (int(p), unsigned(at), [unsigned(x) for x in gone])))
        return pd.Series(out, dtype=object)

    text = main_text(F.col(html_col), F.col("__place"), F.coalesce("__path", F.lit(0)), F.col("__skipped"))
    return joined.select(*names, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
