"""Main-text extraction by wrapper induction over the pages of a host."""

from __future__ import annotations

import hashlib
import html
import math
import re
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapgraph.llm.common import Stages, compact, part_count, release, slices

#: A slot is template if one text fills it on this share of the pages that have it, and of all pages of the host.
SLOT_SHARE = 0.8
HOST_SHARE = 0.3
#: Pages that share a text say it is template only if they are otherwise unlike: of so many pages, one has a key of its own.
UNLIKE_SHARE = 0.3
#: The part of a host's varying text that must stand in marked articles (or main elements) for the marks to be believed.
MARKED_SHARE = 0.5
#: Cells of a table of two lists of children that are held at once; the result doesn't depend on it.
FULL_PAIRS = 250_000
#: Decisions are broadcast up to this size in all; beyond it they are joined by host and shape.
BROADCAST_BYTES = 8 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Opening one of these ends an open element of the second set that it finds before one of the third.
_CLOSES = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu"))),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    "tr": (("tr",), ("table",)),
}
#: Elements of any use: neighbours of one label are a repeated slot only if they are built alike.
_BOXES = frozenset("div section article aside main header footer form center table".split())
_TOP = frozenset("# html body".split())
_NEVER = frozenset("head title nav footer aside form button select dialog menu".split())
_NOT_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|newsletter|subscri\w+|sidebar|menu|nav|navbar|navigation|breadcrumbs?|comments?|disqus|repl(?:y|ies)|respond|social|share|sharing|related|popup|modal|widget|footer|pagination|toolbar|masthead|topbar)(?=$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form".split())
#: Kept out unless it heads an article, and what no reader sees.
_HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"(?<=[.!?。]) ?")

_PARSED = "page_id long, url string, host string, shape string, skeleton string, node array<int>, text array<string>, linked array<int>, flags array<int>"
_CELL = "host string, slot long, extra boolean, value long, page long, k1 long, k2 long, k3 long, mass long, chars long, linked long, mark int"


class Dom:
    """The block elements of a page in page order, and its text blocks (element, text, characters in links)."""

    __slots__ = ("blocks", "labels", "marks", "out", "parents", "tags")

    def __init__(self):
        self.tags, self.labels, self.parents, self.out, self.marks = ["#"], ["#"], [-1], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []


def parse(source: str) -> Dom:
    dom = Dom()
    tags, parents = dom.tags, dom.parents
    at, run, links, linked = 0, [], 0, 0
    opened: dict[str, int] = {}

    def flush():
        nonlocal run, linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            dom.blocks.append((at, text, min(linked, len(text))))
        run, linked = [], 0

    def take(text: str):
        nonlocal linked
        if text:
            run.append(text)
            if links:
                linked += len(text)

    def leave(to: int):
        """Ends elements up to ``to``, which stays open."""
        nonlocal at
        while at != to:
            opened[tags[at]] -= 1
            at = parents[at]

    end = 0
    for m in _TOKEN.finditer(source):
        take(source[end : m.start()])
        end = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "a":
            links = max(0, links - 1) if m[2] else links + 1
        if name == "br":
            run.append(" ")
        if name not in _BLOCK:
            continue
        flush()
        links = 0
        if m[2]:
            if opened.get(name):
                up = at
                while tags[up] != name:
                    up = parents[up]
                leave(parents[up])
            continue
        while tags[at] == "p":
            leave(parents[at])
        if name in _CLOSES:
            same, stop = _CLOSES[name]
            if any(opened.get(x) for x in same):
                up = at
                while up and tags[up] not in same and tags[up] not in stop:
                    up = parents[up]
                if tags[up] in same:
                    leave(parents[up])
        node = _element(dom, name, m[4] or "", at)
        if name not in _VOID:
            at = node
            opened[name] = opened.get(name, 0) + 1
    take(source[end:])
    flush()
    return dom


def _element(dom: Dom, tag: str, attributes: str, parent: int) -> int:
    known = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)} if attributes else {}
    role = known.get("role", "").strip().lower()
    words = _CAMEL.sub("-", f"{known.get('class', '')} {known.get('id', '')}".strip())
    above = dom.marks[parent]
    out = dom.out[parent] or tag in _NEVER or role in _ROLES or bool(attributes and _HIDDEN.search(attributes))
    out = out or bool(words and _NOT_CONTENT.search(words)) or (not above and (tag == "header" or bool(words and _HEADER.search(words))))
    dom.tags.append(tag)
    dom.labels.append(f"{tag}.{'.'.join(known.get('class', '').split())}".rstrip("."))
    dom.parents.append(parent)
    dom.out.append(out)
    # 2 in an article, 1 in a main element alone
    dom.marks.append(2 if tag == "article" or role == "article" else max(above, 1) if tag == "main" or role == "main" else above)
    return len(dom.tags) - 1


class Tree:
    """A folded tree in preorder: runs of like siblings are one repeated node."""

    __slots__ = ("children", "labels", "parents")

    def __init__(self, labels: list[str], parents: list[int]):
        self.labels, self.parents = labels, parents
        self.children: list[list[int]] = [[] for _ in labels]
        for i, p in enumerate(parents):
            if p >= 0:
                self.children[p].append(i)

    def write(self) -> str:
        depth = [0] * len(self.labels)
        for i, p in enumerate(self.parents):
            depth[i] = depth[p] + 1 if p >= 0 else 0
        return "\n".join(f"{d} {label}" for d, label in zip(depth, self.labels, strict=True))

    @staticmethod
    def read(skeleton: str) -> Tree:
        labels, parents, open_ = [], [], []
        for i, line in enumerate(skeleton.split("\n")):
            depth, _, label = line.partition(" ")
            del open_[int(depth) :]
            labels.append(label)
            parents.append(open_[-1] if open_ else -1)
            open_.append(i)
        return Tree(labels, parents)


def fold(dom: Dom) -> tuple[Tree, list[int]]:
    """The folded tree of a page, and the node of it that each element is in."""
    kids: list[list[int]] = [[] for _ in dom.tags]
    for i, p in enumerate(dom.parents):
        if p >= 0:
            kids[p].append(i)
    names = [frozenset(dom.labels[k] for k in some) for some in kids]
    slot, labels, up, found = [0] * len(dom.tags), ["#"], [-1], {}
    for i, some in enumerate(kids):
        rank: dict[str, int] = {}
        before = None
        for k in some:
            label = dom.labels[k]
            alike = before is not None and label == dom.labels[before]
            if alike and dom.tags[k] in _BOXES:
                alike = bool(names[k] & names[before]) or not (names[k] or names[before])
            if not alike:
                rank[label] = rank.get(label, -1) + 1
            key = (slot[i], label, rank[label])
            if key not in found:
                found[key] = len(labels)
                labels.append(label)
                up.append(slot[i])
            slot[k], before = found[key], k
    # preorder
    below: list[list[int]] = [[] for _ in labels]
    for i, p in enumerate(up):
        if p >= 0:
            below[p].append(i)
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += below[i][::-1]
    place = [0] * len(labels)
    for n, i in enumerate(order):
        place[i] = n
    return Tree([labels[i] for i in order], [place[up[i]] if i else -1 for i in order]), [place[s] for s in slot]


class Aligner:
    """Simple tree matching: the largest match of two trees that keeps order and ancestors, each pair of unlike subtrees measured once.

    All pairs of children count, however many there are: a row of their table is one pass over an array, and
    of a table of more than ``full_pairs`` cells only some rows are held, from which the others are worked out again.
    """

    def __init__(self, full_pairs: int = FULL_PAIRS):
        self.full_pairs = full_pairs
        self._clear()

    def _clear(self) -> None:
        self.kinds: dict[tuple, int] = {}
        self.label: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.names: list[frozenset[str]] = []
        self.size: list[int] = []
        self.known: dict[int, dict[int, int]] = {}
        self.paired: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.held = 0

    def _kinds(self, tree: Tree) -> list[int]:
        """The number of each node's subtree; equal subtrees have one."""
        kind = [0] * len(tree.labels)
        for i in range(len(kind) - 1, -1, -1):
            key = (tree.labels[i], tuple(kind[c] for c in tree.children[i]))
            if key not in self.kinds:
                self.kinds[key] = len(self.size)
                self.size.append(1 + sum(self.size[k] for k in key[1]))
                self.label.append(key[0])
                self.below.append(key[1])
                self.names.append(frozenset(self.label[k] for k in key[1]))
            kind[i] = self.kinds[key]
        return kind

    def match(self, a: Tree, b: Tree) -> list[int]:
        """For each node of ``a`` the node of ``b`` that it is matched with, or -1."""
        if self.held > 100_000 or len(self.size) > 1_000_000:
            self._clear()
        ka, kb = self._kinds(a), self._kinds(b)
        out = [-1] * len(a.labels)
        if a.labels[0] != b.labels[0]:
            return out
        self._measure(ka[0], kb[0])
        stack = [(0, 0)]
        while stack:
            x, y = stack.pop()
            out[x] = y
            cx, cy = a.children[x], b.children[y]
            if ka[x] == kb[y]:
                stack += zip(cx, cy, strict=True)
            else:
                stack += [(cx[i], cy[j]) for i, j in self._pairs(ka[x], kb[y])]
        return out

    def score(self, a: Tree, b: Tree) -> int:
        """The number of matched nodes."""
        return sum(y >= 0 for y in self.match(a, b))

    def _gain(self, p: int, q: int) -> int | None:
        """The size of the largest match of two subtrees with one label; None if it is not measured yet."""
        if p == q:
            return self.size[p]
        if self.names[p].isdisjoint(self.names[q]):
            return 1
        return self.known.get(p, {}).get(q)

    def _measure(self, p: int, q: int) -> None:
        stack = [self._steps(p, q)]
        while stack:
            first = next(stack[-1], None)
            if first is None:
                stack.pop()
            else:
                stack.append(self._steps(*first))

    def _steps(self, p: int, q: int):
        """Yields the pairs of subtrees to be measured before this one, then measures it."""
        if self._gain(p, q) is not None:
            return
        low, n, m = self._ends(p, q)
        a, table = self.below[p][low:n], Table(self, self.below[q][low:m])
        for x in dict.fromkeys(a):
            for y in table.of_label.get(self.label[x], ()):
                if self._gain(x, y) is None:
                    yield x, y
        row = table.start()
        for x in a:
            row = table.row(row, x)
        ends = sum(self.size[k] for k in self.below[p][:low]) + sum(self.size[k] for k in self.below[p][n:])
        self.known.setdefault(p, {})[q] = 1 + ends + int(row[-1])
        self.held += 1

    def _ends(self, p: int, q: int) -> tuple[int, int, int]:
        """Equal subtrees at either end are best matched with each other: where they end, and where they begin again in either list."""
        a, b = self.below[p], self.below[q]
        low, n, m = 0, len(a), len(b)
        while low < min(n, m) and a[low] == b[low]:
            low += 1
        while n > low and m > low and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
        return low, n, m

    def _pairs(self, p: int, q: int) -> list[tuple[int, int]]:
        """The order-keeping pairs of children with the largest sum of gains."""
        if (p, q) not in self.paired:
            low, n, m = self._ends(p, q)
            inner = self._best(self.below[p][low:n], self.below[q][low:m])
            self.paired[p, q] = [(i, i) for i in range(low)] + [(i + low, j + low) for i, j in inner] + [(n + k, m + k) for k in range(len(self.below[p]) - n)]
            self.held += len(self.paired[p, q])
        return self.paired[p, q]

    def _best(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        table, i, j = Table(self, b), len(a), len(b)
        step = max(math.isqrt(i) + 1, self.full_pairs // (j + 1))
        held = [table.start()]
        for k in range(step, i, step):
            row = held[-1]
            for x in a[k - step : k]:
                row = table.row(row, x)
            held.append(row)
        pairs = []
        while i and j:
            low = (i - 1) // step * step
            rows = [held[low // step][: j + 1]]
            for x in a[low:i]:
                rows.append(table.row(rows[-1], x))
            while i > low and j:
                x, y = a[i - 1], b[j - 1]
                here, above = rows[i - low], rows[i - low - 1]
                if self.label[x] == self.label[y] and here[j] == above[j - 1] + self._gain(x, y):
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
                elif here[j] == above[j]:
                    i -= 1
                else:
                    j -= 1
        return pairs[::-1]


class Table:
    """The rows of the table of two lists of subtrees: the largest sum of gains of order-keeping pairs, for each length of the second list."""

    def __init__(self, aligner: Aligner, b: tuple[int, ...]):
        self.aligner = aligner
        self.place = {y: k for k, y in enumerate(dict.fromkeys(b))}
        self.at = np.array([self.place[y] for y in b], np.int64)
        self.of_label: dict[str, list[int]] = {}
        for y in self.place:
            self.of_label.setdefault(aligner.label[y], []).append(y)
        self.gains: dict[int, np.ndarray] = {}

    def start(self) -> np.ndarray:
        return np.zeros(len(self.at) + 1, np.int32)

    def row(self, above: np.ndarray, x: int) -> np.ndarray:
        """The row below another, for one more subtree of the first list; as long as the other."""
        others = self.of_label.get(self.aligner.label[x])
        if others is None:
            return above
        if x not in self.gains:
            gain = np.zeros(len(self.place), np.int32)
            for y in others:
                gain[self.place[y]] = self.aligner._gain(x, y)
            self.gains[x] = gain
        out = np.empty_like(above)
        out[0] = 0
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + self.gains[x][self.at[: len(above) - 1]]), out=out[1:])
        return out


def _names(tree: Tree) -> list[int]:
    """A 64-bit name of each node's path of labels and ranks."""
    out, ranks = [0] * len(tree.labels), {}
    for i, (label, p) in enumerate(zip(tree.labels, tree.parents, strict=True)):
        if p >= 0:
            ranks[p, label] = ranks.get((p, label), -1) + 1
            out[i] = _hash(f"{out[p]} {ranks[p, label]} {label}")
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def slots_of(page: Tree, wrapper: Tree, aligner: Aligner) -> tuple[list[int], list[bool]]:
    """The slot of each node of a page, and whether it is one that the wrapper lacks: named by the slot above and its own path."""
    matched, names = aligner.match(page, wrapper), _names(wrapper)
    out, extra, ranks = [], [], {}
    for i, (label, p) in enumerate(zip(page.labels, page.parents, strict=True)):
        if matched[i] >= 0:
            out.append(names[matched[i]])
        else:
            ranks[p, label] = ranks.get((p, label), -1) + 1
            out.append(_hash(f"+ {out[p] if p >= 0 else 0} {ranks[p, label]} {label}"))
        extra.append(matched[i] < 0)
    return out, extra


class Slot:
    """What a host's pages hold in a slot: their varying text, link text, and whether it is template."""

    __slots__ = ("chars", "linked", "mark", "mass", "template")

    def __init__(self, mass: int = 0, chars: int = 0, linked: int = 0, mark: int = 0, template: bool = False):
        self.mass, self.chars, self.linked, self.mark, self.template = mass, chars, linked, mark, template

    def varying(self) -> int:
        return 0 if self.template or 2 * self.linked > self.chars else self.mass


def region(tree: Tree, slots: dict[int, Slot]) -> tuple[int, set[int]]:
    """(mark, nodes): content is what articles (2) or main elements (1) hold, or where neither is to be trusted, these nodes of the wrapper.

    The marks are trusted if most of the varying text is in them. Else the node with the most varying text
    decides: content is the element around it, with the heading above it. If the least element that has
    both is no whole page, it is content altogether.
    """
    total = sum(s.varying() for s in slots.values())
    for mark in (2, 1):
        marked = sum(s.varying() for s in slots.values() if s.mark >= mark)
        if marked and marked >= MARKED_SHARE * total:
            return mark, set()
    names = _names(tree)
    mass = [slots[name].varying() if name in slots else 0 for name in names]
    if not total or not any(mass):
        return 0, set()
    main = max(range(len(mass)), key=lambda i: (mass[i], -i))
    around = tree.parents[main] if main else 0
    heads = [i for i, label in enumerate(tree.labels) if label.split(".")[0] == "h1" and mass[i]]
    within = {around, *heads}
    for head in heads:
        line, up = set(), head
        while up >= 0:
            line.add(up)
            up = tree.parents[up]
        up = around
        while up not in line:
            up = tree.parents[up]
        if tree.labels[up].split(".")[0] not in _TOP:
            within.add(up)
    chosen: set[int] = set()
    for i, p in enumerate(tree.parents):
        if i in within or p in chosen:
            chosen.add(i)
    return 0, chosen


def spare_copies(tree: Tree, slots: dict[int, Slot], found: tuple[int, set[int]]) -> None:
    """Where constant slots are most of the content, its pages are near-copies, not pages with a template in their text: they stay.

    That is if they are more than twice as many as the slots that vary, and have more text.
    """
    mark, chosen = found
    of_tree = {name: i for i, name in enumerate(_names(tree))}
    inside = [s for name, s in slots.items() if name not in of_tree or (s.mark >= mark if mark else of_tree[name] in chosen)]
    constant, rest = [s for s in inside if s.template], [s for s in inside if s.varying()]
    if len(constant) > 2 * len(rest) and sum(s.mass for s in constant) > sum(s.mass for s in rest):
        for s in constant:
            s.template = False


def decide(page: Tree, wrapper: Tree, slots: dict[int, Slot], found: tuple[int, set[int]], aligner: Aligner) -> list[int]:
    """For each node of a page's tree: 0 no content, 1 content, 2 content if it is in a marked article, 3 if in an article or main element."""
    mark, chosen = found
    names, _ = slots_of(page, wrapper, aligner)
    inside = {name for i, name in enumerate(_names(wrapper)) if i in chosen}
    out: list[int] = []
    within: list[bool] = []
    for name, p in zip(names, page.parents, strict=True):
        within.append(name in inside or (p >= 0 and within[p]))
        slot = slots.get(name)
        if slot is not None and slot.template:
            out.append(0)
        elif mark:
            out.append(4 - mark if mark == 1 else 2)
        else:
            out.append(int(within[-1] and not (slot is not None and 2 * slot.linked > slot.chars)))
    return out


def _kept(verdicts: list[int] | None, blocks: list[tuple[int, str, int]], flags: list[int]) -> list[str]:
    if verdicts is None:
        return []
    need = {1: 0, 2: 2, 3: 1}
    return [text for (node, text, _), f in zip(blocks, flags, strict=True) if not f & 1 and verdicts[node] and f >> 1 >= need[verdicts[node]]]


def _alone(tree: Tree, blocks: list[tuple[int, str, int]], flags: list[int]) -> list[str]:
    """The content of a page by what it holds itself: no text of it is known to be template."""
    slots: dict[int, Slot] = {}
    names = _names(tree)
    for (node, text, linked), f in zip(blocks, flags, strict=True):
        if not f & 1:
            s = slots.setdefault(names[node], Slot())
            s.mass += len(text)
            s.chars += len(text)
            s.linked += linked
            s.mark = max(s.mark, f >> 1)
    return _kept(decide(tree, tree, slots, region(tree, slots), Aligner()), blocks, flags)


def read_page(source: str) -> tuple[Tree, list[tuple[int, str, int]], list[int]]:
    """The folded tree, (node, text, characters in links) of each text block, and its flags: 1 kept out by an element above, 2 in a main element, 4 in an article."""
    dom = parse(source)
    tree, slot = fold(dom)
    return tree, [(slot[e], text, linked) for e, text, linked in dom.blocks], [int(dom.out[e]) | dom.marks[e] << 1 for e, _, _ in dom.blocks]


def main_text(source: str) -> str:
    """The main text of a page without others of its host."""
    return "\n\n".join(_alone(*read_page(source)))


def text_keys(texts: list[str]) -> tuple[int, int, int]:
    """Three keys, each the least of other hashes of the texts' sentences; a page's keys are the least of its slots'."""
    sums = {zlib.crc32(s.encode("utf-8", "surrogatepass")) for t in texts for s in _SENTENCE.split(t) if s}
    return tuple(min(x * k & 0xFFFFFFFF for x in sums) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _parse_rows(batches):
    names = [c.split()[0] for c in _PARSED.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for batch in slices(batches, 64):
        out = []
        for page_id, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree, blocks, flags = read_page(source)
            skeleton = tree.write()
            out.append((page_id, url, host_of(url), hashlib.md5(skeleton.encode("utf-8", "surrogatepass")).hexdigest(), skeleton, [b[0] for b in blocks], [b[1] for b in blocks], [b[2] for b in blocks], flags))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    release()


def _map_rows(batches):
    aligner, known = Aligner(), {}
    for batch in slices(batches):
        out = []
        for host, shape, skeleton, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if host not in known:
                if len(known) > 500:
                    known.clear()
                known[host] = Tree.read(wrapper)
            out.append((host, shape, *slots_of(Tree.read(skeleton), known[host], aligner)))
        types = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["host", "shape", "slots", "extra"])


def _cell_rows(batches):
    """One row for each slot that holds text on a page."""
    names = [c.split()[0] for c in _CELL.split(", ")]
    types = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 8, pa.int32()]
    for batch in slices(batches):
        out = []
        for host, node, text, linked, flags, slots, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cells: dict[int, list] = {}
            for n, t, k, f in zip(node, text, linked, flags, strict=True):
                if not f & 1:
                    cell = cells.setdefault(slots[n], [extra[n], [], 0, 0, 0])
                    cell[1].append(t)
                    cell[2] += len(t)
                    cell[3] += k
                    cell[4] = max(cell[4], f >> 1)
            page = _hash("\n".join(t for c in cells.values() for t in c[1]))
            size = sum(c[2] for c in cells.values())
            out += [(host, slot, c[0], _hash("\n".join(c[1])), page, *text_keys(c[1]), 1000 * c[2] // size, c[2], c[3], c[4]) for slot, c in cells.items()]
        cols = list(zip(*out, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _decide_rows(batches):
    aligner, known = Aligner(), {}
    for batch in slices(batches):
        out = []
        for host, shape, skeleton, wrapper, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if host not in known:
                if len(known) > 500:
                    known.clear()
                tree, own = Tree.read(wrapper), {s["slot"]: Slot(s["mass"], s["chars"], s["linked"], s["mark"], s["template"]) for s in slots or ()}
                known[host] = tree, own, region(tree, own)
                spare_copies(*known[host])
            out.append((host, shape, bytes(decide(Tree.read(skeleton), known[host][0], known[host][1], known[host][2], aligner))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names=["host", "shape", "verdicts"])


def _text_rows(batches):
    for batch in slices(batches):
        out = []
        for skeleton, node, text, linked, flags, verdicts in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            blocks = list(zip(node, text, linked, strict=True))
            kept = _kept(verdicts and list(verdicts), blocks, flags) or _alone(Tree.read(skeleton), blocks, flags)
            out.append("\n\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])
    release()


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    1. Every page is parsed once to its folded tree and text blocks. A host's commonest tree is its wrapper.
    2. Every distinct tree of a host is aligned with the wrapper by simple tree matching, which gives each
       block of a page its slot.
    3. The slots are measured over the host's distinct pages. One that the same text fills on nearly all pages
       that have it is template, if those pages are otherwise unlike: near-copies of a page prove nothing. Of
       the slots that vary, those around the bulk of the text are content; elements and names that say
       article, menu, advert, form, comment and so on are features of it.
    4. A page's blocks in content slots are its text. A page that has none, or no host, is judged by itself.
    Counts are by host and slot with partial sums, for distinct pages; a host's slots are those of its wrapper
    and constant others that HOST_SHARE of its pages have. They are joined with the host's distinct
    trees; the result is broadcast while it is small, else joined, and Spark splits hot hosts.

    A null html is empty and gives an empty text; pages of no valid host stand alone; repeated rows give a
    row each and count once for a host; an empty table gives none; other columns are not read. Very deep or
    wide pages are walked without recursion.
    """
    stages = Stages(pages.sparkSession, "wrappers")
    some = part_count(pages)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    parsed = stages.write(compact(rows).mapInArrow(_parse_rows, _PARSED), "parsed")
    hosted = parsed.filter("host <> ''")
    shapes = stages.write(hosted.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.first("skeleton").alias("skeleton")), "shapes", some)
    wrappers = stages.write(shapes.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "shape")).alias("wrapper")), "wrappers", some)
    maps = stages.write(shapes.join(wrappers, "host").select("host", "shape", "skeleton", "wrapper").mapInArrow(_map_rows, "host string, shape string, slots array<long>, extra array<boolean>"), "maps", some)

    def small(df: DataFrame) -> DataFrame:
        size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
        return F.broadcast(df) if size <= broadcast_bytes else df

    cells = hosted.select("host", "shape", "node", "text", "linked", "flags").join(small(maps), ["host", "shape"]).select("host", "node", "text", "linked", "flags", "slots", "extra")
    cells = stages.write(cells.mapInArrow(_cell_rows, _CELL).distinct(), "cells", some)
    sizes = cells.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    values = cells.groupBy("host", "slot", "extra", "value").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("mass", "chars", "linked")), F.max("mark").alias("mark"))
    slots = values.groupBy("host", "slot", "extra").agg(F.sum("n").alias("n"), F.max(F.struct("n", "value")).alias("top"), *(F.sum(c).alias(c) for c in ("mass", "chars", "linked")), F.max("mark").alias("mark"))
    slots = stages.write(slots.join(sizes, "host"), "slots", some)
    constant = slots.filter((F.col("top.n") > 1) & (F.col("top.n") >= SLOT_SHARE * F.col("n")) & (F.col("top.n") >= HOST_SHARE * F.col("pages"))).select("host", "slot", F.col("top.value").alias("value"))
    # what a page says where its host doesn't always say the same: near-copies have most of its sentences, and so its keys, in common
    varying = cells.filter("2 * linked <= chars").join(constant.select("host", "slot"), ["host", "slot"], "left_anti")
    keys = varying.groupBy("host", "page").agg(*(F.min(k).alias(k) for k in ("k1", "k2", "k3")))
    unlike = cells.select("host", "slot", "value", "page").join(constant, ["host", "slot", "value"]).join(keys, ["host", "page"])
    unlike = unlike.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("_n"), *(F.count_distinct(k).alias(k) for k in ("k1", "k2", "k3")))
    least = F.least("k1", "k2", "k3")
    template = unlike.filter((least > 1) & (least >= UNLIKE_SHARE * F.col("_n"))).select("host", "slot", F.lit(True).alias("template"))
    slots = slots.join(template, ["host", "slot"], "left").filter("not extra or template")
    slot = F.struct("slot", "mass", "chars", "linked", "mark", F.coalesce("template", F.lit(False)).alias("template"))
    known = slots.groupBy("host").agg(F.collect_list(slot).alias("slots"))
    chosen = shapes.join(wrappers, "host").join(known, "host", "left").select("host", "shape", "skeleton", "wrapper", "slots")
    decided = stages.write(chosen.mapInArrow(_decide_rows, "host string, shape string, verdicts binary"), "decided", some)
    found = parsed.join(small(decided), ["host", "shape"], "left").select("page_id", "url", "skeleton", "node", "text", "linked", "flags", "verdicts")
    return found.mapInArrow(_text_rows, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
