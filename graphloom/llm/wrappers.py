"""Wrapper induction: what pages of one host have in common, and what is their own.

Pages are parsed into trees; trees of the same host are aligned by simple tree
matching, the largest order-preserving matching of nodes whose parents match. A template is
the alignment of all pages of the host, in an order of hashes, so it is the same for any
order and split of the pages. Pages are aligned in runs, and the results of these in runs again; each keeps the
nodes that may be on ``SHARE`` of its pages. A node that is below that share in every run is below it in all. All pages
are then aligned with the template, and every text is counted exactly by its place: its slot of the template, or,
where the template has none, the slot above it and the tags between. A text that stays the same in its place on
enough pages is template; the slots and places that vary are content.
"""

from __future__ import annotations

import html
import json
import math
from collections import Counter
from collections.abc import Iterator, KeysView

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

#: Elements that never have content.
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements that one of their kind closes.
CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Trees aligned with each other before nodes too rare for a template are left out.
RUN = 16
#: Pages of a host that a task aligns, about; and templates that one makes of the next.
PART, FAN = 256, 64
#: Elements nested deeper are siblings of each other; their texts are kept.
DEEPEST = 200
#: Templates of so many characters in all are broadcast.
MOST_BYTES = 32_000_000
#: A text is template if at least this share of the pages has it unchanged in its place.
SHARE = 0.5
#: Lists of siblings with more pairs are aligned half by half.
MOST_CELLS = 4_000_000
#: A task sums the counts of so many texts before it passes them on.
MOST_COUNTS = 100_000

#: The shape of a text.
TEXT = xxhash.xxh3_64_intdigest("#")

_token = regex.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][\w-]*)\b[^<>]*?(?P<void>/?)>|(?P<text>[^<]+|<)", regex.S)


class Node:
    """An element, or a text where ``tag`` is '#'; at most ``n`` of the pages merged have it. A page's has its ``texts``.

    ``shape`` tells trees of different structure apart, and ``on`` has hashes of the whole tree, with its
    texts, each with the number of pages that have it at most.
    """

    __slots__ = ("tag", "texts", "kids", "n", "shape", "on")

    def __init__(self, tag: str, text: str | None = None, n: int = 1) -> None:
        self.tag, self.n = tag, n
        self.texts: set[str | int] = set() if text is None else {text}
        self.kids: list[Node] = []
        self.shape = 0
        self.on: dict[int, int] = {}

    @property
    def whole(self) -> KeysView[int]:
        return self.on.keys()

    def pack(self) -> list:
        return [self.tag, self.n, sorted(self.on.items()), [k.pack() for k in self.kids]]

    @classmethod
    def unpack(cls, x: list) -> Node:
        node = cls(x[0], n=x[1])
        node.on, node.kids = dict(x[2]), [cls.unpack(k) for k in x[3]]
        node.shape = node.shaped()
        return node

    def bones(self) -> list | int:
        """A page's tags, with a hash in place of each text."""
        return text_hash(next(iter(self.texts))) if self.tag == "#" else [self.tag, *[k.bones() for k in self.kids]]

    @classmethod
    def of_bones(cls, x: list | int, n: int) -> Node:
        """The tree of ``n`` equal pages; its texts are hashes."""
        if isinstance(x, int):
            node = cls("#", n=n)
            node.texts, node.shape, node.on = {x}, TEXT, {x: n}
            return node
        node = cls(x[0], n=n)
        node.kids = [cls.of_bones(k, n) for k in x[1:]]
        node.shape, node.on = node.shaped(), {node.wholly(): n}
        return node

    def shaped(self) -> int:
        return TEXT if self.tag == "#" else xxhash.xxh3_64_intdigest(f"{self.tag} {[k.shape for k in self.kids]}")

    def wholly(self) -> int:
        return text_hash(next(iter(self.texts))) if self.tag == "#" else xxhash.xxh3_64_intdigest(f"{self.tag} {[h for k in self.kids for h in k.on]}")

    def sign(self) -> None:
        """Sets ``shape`` and ``on`` of a page's node and all below it."""
        for k in self.kids:
            k.sign()
        self.shape, self.on = self.shaped(), {self.wholly(): 1}

    def below(self) -> Iterator[Node]:
        """All nodes but itself, parents before their kids."""
        for k in self.kids:
            yield k
            yield from k.below()


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, 1)


def parse(page: str) -> Node:
    """The tree of a page; unclosed elements end with their parent."""
    root = parse_unsigned(page)
    root.sign()
    return root


def parse_unsigned(page: str) -> Node:
    """The tree of a page that is not to be aligned."""
    root = Node("#root")
    open_ = [root]
    for m in _token.finditer(page):
        if m["text"] is not None:
            text = " ".join(html.unescape(m["text"]).split())
            if text:
                last = open_[-1].kids[-1] if open_[-1].kids else None
                if last is not None and last.tag == "#":
                    last.texts = {f"{next(iter(last.texts))} {text}"}
                else:
                    open_[-1].kids.append(Node("#", text))
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["close"]:
                if any(n.tag == tag for n in open_[1:]):
                    while open_.pop().tag != tag:
                        pass
                continue
            while len(open_) > 1 and tag in CLOSED_BY.get(open_[-1].tag, ()):
                open_.pop()
            node = Node(tag)
            open_[-1].kids.append(node)
            if not m["void"] and tag not in VOID and len(open_) < DEEPEST:
                open_.append(node)
    return root


_known: dict[tuple[int, int], int] = {}


def match(a: Node, b: Node) -> int:
    """The size of the largest matching of both structures."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape or not a.kids or not b.kids:
        return 1 + (sum(1 for _ in a.below()) if a.shape == b.shape else 0)
    key = (a.shape, b.shape)
    if key not in _known:
        found = 1 + int(_table(a.kids, b.kids, False)[-1][-1])
        if len(_known) >= MOST_COUNTS:
            _known.clear()
        _known[key] = found
    return _known[key]


def _table(x: list[Node], y: list[Node], same: bool = True):
    """The weights of the best matchings of all beginnings; with ``same``, pairs that are equal on some page count one more."""
    if len(x) * len(y) <= 400:
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            up, row = m[i], m[i + 1]
            for j, b in enumerate(y):
                w = match(a, b)
                if w and same and not a.whole.isdisjoint(b.whole):
                    w += 1
                row[j + 1] = max(up[j + 1], row[j], up[j] + w)
        return m
    m = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, w in enumerate(_weights(x, y, same)):
        m[i + 1] = _next(m[i], w)
    return m


def _next(up: np.ndarray, w: np.ndarray) -> np.ndarray:
    row = up.copy()
    np.maximum(up[1:], up[:-1] + w, out=row[1:])
    return np.maximum.accumulate(row)


def _weights(x: list[Node], y: list[Node], same: bool) -> Iterator[np.ndarray]:
    """For each of ``x`` its weights with all of ``y``, found once for each pair of shapes."""
    first: dict[int, int] = {}
    kind = np.array([first.setdefault(b.shape, len(first)) for b in y], np.int64)
    one = list({b.shape: b for b in reversed(y)}[s] for s in first)
    at: dict[int, list[int]] = {}
    for j, b in enumerate(y):
        for h in b.whole:
            at.setdefault(h, []).append(j)
    rows: dict[int, np.ndarray] = {}
    for a in x:
        if a.shape not in rows:
            rows[a.shape] = np.array([match(a, b) for b in one], np.int32)
        w = rows[a.shape][kind]
        if same:
            equal = sorted({j for h in a.whole for j in at.get(h, ())})
            w[equal] += w[equal] > 0
        yield w


def align(x: list[Node], y: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """The nodes of both lists in order, matched ones as pairs; equal beginnings and ends are matched first."""
    head = tail = 0
    most = min(len(x), len(y))
    alike = lambda a, b: a.shape == b.shape and not a.whole.isdisjoint(b.whole)
    while head < most and alike(x[head], y[head]):
        head += 1
    while tail < most - head and alike(x[-1 - tail], y[-1 - tail]):
        tail += 1
    inner = _align(x[head : len(x) - tail], y[head : len(y) - tail])
    return [*zip(x[:head], y[:head]), *inner, *zip(x[len(x) - tail :], y[len(y) - tail :])]


def _align(x: list[Node], y: list[Node]) -> list[tuple[Node | None, Node | None]]:
    if not x or not y:
        return [(a, None) for a in x] + [(None, b) for b in y]
    if len(x) > 1 and len(x) * len(y) > MOST_CELLS:  # both halves of x by themselves, so that no whole table is held
        half = len(x) // 2
        top, bottom = np.zeros(len(y) + 1, np.int32), np.zeros(len(y) + 1, np.int32)
        for w in _weights(x[:half], y, True):
            top = _next(top, w)
        for w in _weights(x[:half - 1 : -1], y[::-1], True):
            bottom = _next(bottom, w)
        at = int(np.argmax(top + bottom[::-1]))
        return _align(x[:half], y[:at]) + _align(x[half:], y[at:])
    m = _table(x, y)
    out, i, j = [], len(x), len(y)
    while i or j:
        if i and j and m[i][j] > max(m[i - 1][j], m[i][j - 1]):
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
        elif i and (not j or m[i][j] == m[i - 1][j]):
            i -= 1
            out.append((x[i], None))
        else:
            j -= 1
            out.append((None, y[j]))
    return out[::-1]


def merge(t: Node, p: Node, rest: int = 0, more: int = 0) -> None:
    """Folds the root of a page or template ``p`` into that of the template ``t``. A node that ``t`` lacks may
    be on ``rest`` of its pages, one that ``p`` lacks on ``more`` of its."""
    t.n += p.n
    t.on = {h: t.on.get(h, rest) + p.on.get(h, more) for h in t.on | p.on}
    kids = []
    for a, b in align(t.kids, p.kids):
        if a is not None and b is not None:
            merge(a, b, rest, more)
        elif a is not None:
            _add(a, more)
        else:
            _add(b, rest)
        kids.append(a if a is not None else b)
    t.kids = kids
    t.shape = t.shaped()


def _add(t: Node, n: int) -> None:
    if n:
        for k in (t, *t.below()):
            k.n += n
            k.on = {h: c + n for h, c in k.on.items()}


def fold(trees: list[tuple[Node, int]]) -> tuple[Node, int]:
    """The template of pages or templates in the order given, each with the number of its pages, at most, that a
    node may be on which it lacks; and that number. Nodes and hashes that fewer than ``SHARE`` of the pages of a run have are
    left out: they have that share of all pages only if they have it in another run."""
    while len(trees) > 1:
        trees = [_run(trees[i : i + RUN]) for i in range(0, len(trees), RUN)]
    return trees[0]


def _run(trees: list[tuple[Node, int]]) -> tuple[Node, int]:
    t, rest = trees[0]
    if len(trees) == 1:
        return t, rest
    for p, more in trees[1:]:
        merge(t, p, rest, more)
        rest += more
    _thin(t, SHARE * t.n)
    return t, math.ceil(SHARE * t.n) - 1


def _thin(t: Node, least: float) -> None:
    t.on = {h: n for h, n in t.on.items() if n >= least}
    t.kids = [k for k in t.kids if k.n >= least]
    for k in t.kids:
        _thin(k, least)
    t.shape = t.shaped()


def template(pages: list[str]) -> Node:
    """The alignment of these pages in the order given, without the nodes that can't be on ``SHARE`` of them."""
    return fold([(parse(p), 0) for p in pages])[0]


def places(t: Node, p: Node) -> list[tuple[str, str | int]]:
    """The texts of a page in their order, each with its place in the template: the number of its slot,
    or the number of the slot above it and the tags from there, as ``12/li/#``."""
    number = {id(k): i for i, k in enumerate(t.below())}
    out: list[tuple[str, str | int]] = []

    def outside(place: str, b: Node) -> None:
        place = f"{place}/{b.tag}"
        if b.tag == "#":
            out.append((place, next(iter(b.texts))))
        for k in b.kids:
            outside(place, k)

    def walk(a: Node, b: Node) -> None:
        for x, y in align(a.kids, b.kids):
            if y is None:
                continue
            if x is None:
                outside(str(number.get(id(a), "")), y)
            elif y.tag == "#":
                out.append((str(number[id(x)]), next(iter(y.texts))))
            else:
                walk(x, y)

    walk(t, p)
    return out


def place_hash(place: str, text: str | int) -> int:
    """Of a text or its hash in its place."""
    return xxhash.xxh3_64_intdigest(f"{place} {text if isinstance(text, int) else text_hash(text)}") - (1 << 63)


def own_texts(t: Node | None, p: Node, same: set[int]) -> list[str]:
    """The texts of a page that aren't template, in their order; ``same`` has the ``place_hash`` of those that are."""
    if not same:
        return [next(iter(k.texts)) for k in p.below() if k.tag == "#"]
    return [x for place, x in places(t if t is not None else Node("#root"), p) if place_hash(place, x) not in same]


def strip(pages: DataFrame, host: str, page: str) -> DataFrame:
    """``host``, ``bones``, ``n``: the tags of each page and the hashes of its texts, equal ones as one with their number.

    Null pages are left out; a null host is one host.
    """
    d = pages.where(F.col(page).isNotNull()).select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(page).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bones = [json.dumps(parse_unsigned(x).bones(), separators=(",", ":")) for x in batch.column("page").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(bones, pa.string())], names=["host", "bones"])

    return d.mapInArrow(run, "host string, bones string").groupBy("host", "bones").agg(F.count("*").alias("n"))


def induce(equal: DataFrame) -> DataFrame:
    """``host``, ``pages``, ``tree``: the number of pages of each host of ``strip`` and its template, as nested lists in JSON.

    All pages of a host are aligned. They are dealt by hash to parts of about ``PART`` pages; ``FAN`` templates
    of parts make one of the next, until the host has one.
    """
    n = cut(equal.groupBy("host").agg(F.ceil(F.sum("n") / PART).alias("parts")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pages = [(Node.of_bones(json.loads(x), int(c)), 0) for _, x, c in sorted(zip(pdf["h"], pdf["bones"], pdf["n"]))]
        return packed(pdf, *fold(pages))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = [(Node.unpack(json.loads(x)), int(rest)) for _, x, rest in sorted(zip(pdf["part"], pdf["tree"], pdf["rest"]))]
        return packed(pdf, *fold(trees))

    def packed(pdf: pd.DataFrame, tree: Node, rest: int) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [pdf["to"].iloc[0]], "pages": [tree.n], "rest": [rest], "tree": [json.dumps(tree.pack(), separators=(",", ":"))]})

    schema = "host string, part bigint, pages bigint, rest bigint, tree string"
    t = equal.withColumn("h", F.xxhash64("bones")).join(n, "host").withColumn("to", F.pmod("h", "parts")).groupBy("host", "to").applyInPandas(build, schema)
    parts = n.agg(F.max("parts")).first()[0] or 0
    while parts > 1:
        t = t.withColumn("to", F.floor(F.col("part") / FAN)).groupBy("host", "to").applyInPandas(join, schema)
        parts = math.ceil(parts / FAN)
    return t.select("host", "pages", "tree")


def own_content(pages: DataFrame, id: str, host: str, page: str) -> DataFrame:
    """``id``, ``content``: what each page has besides the template of its host, a line per text.

    A host with a single page has only content. Null pages have null content; pages
    without a host are one host. The result doesn't depend on the order of the pages or their split. Templates
    are broadcast while they have together at most ``MOST_BYTES`` characters, and joined to the pages otherwise.
    """
    kind = pages.schema[id].dataType.simpleString()
    d = cut(pages.select(F.col(id).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(page).alias("page")))  # read by each pass
    equal = cut(strip(d, "host", "page"))
    t = cut(induce(equal))
    none = F.array().cast("array<bigint>")

    def given(d: DataFrame, t: DataFrame):
        """``d`` and its host's template and constant texts, joined or as a broadcast."""
        size = t.agg(F.sum(F.length("tree") + 8 * F.size("same"))).first()[0] or 0
        if size > MOST_BYTES:
            return d.join(t.select("host", "tree", "same"), "host", "left"), None
        return d, pages.sparkSession.sparkContext.broadcast({r["host"]: (r["tree"], r["same"]) for r in t.collect()})

    def roots(batch: pa.RecordBatch, column: str, shared, known: dict) -> Iterator[tuple]:
        """Each page with its host, and the host's template and constant texts."""
        packed = zip(batch.column("tree").to_pylist(), batch.column("same").to_pylist()) if shared is None else None
        for page, name in zip(batch.column(column).to_pylist(), batch.column("host").to_pylist()):
            have = next(packed) if packed is not None else None
            if page is None:
                yield None, name, None, None
                continue
            if name not in known:
                if len(known) >= 100:
                    known.clear()
                tree, same = shared.value[name] if have is None else have
                known[name] = Node.unpack(json.loads(tree)), set(same)
            yield page, name, *known[name]

    rows, shared = given(equal, t.withColumn("same", none))

    def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int64()), pa.array(list(n.values()), pa.int64())]
            n.clear()
            return pa.RecordBatch.from_arrays(columns, names=["host", "h", "n"])

        for batch in batches:
            for (bones, name, root, _), c in zip(roots(batch, "bones", shared, known), batch.column("n").to_pylist()):
                for h in {place_hash(*x) for x in places(root, Node.of_bones(json.loads(bones), c))}:
                    n[name, h] += c
                if len(n) >= MOST_COUNTS:
                    yield out()
        yield out()

    n = rows.mapInArrow(count, "host string, h bigint, n bigint").groupBy("host", "h").agg(F.sum("n").alias("n")).where("n > 1")
    n = n.join(t.select("host", "pages"), "host").where(F.col("n") >= SHARE * F.col("pages"))
    same = n.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("same"))  # at most 1 / SHARE times the texts of a page
    t = cut(t.join(same, "host", "left").select("host", "tree", F.coalesce("same", none).alias("same")))
    rows, shared = given(d, t)

    def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            out = [None if page is None else "\n".join(own_texts(root, (parse if same else parse_unsigned)(page), same)) for page, _, root, same in roots(batch, "page", shared, known)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "content"])

    return rows.mapInArrow(run, f"id {kind}, content string").withColumnRenamed("id", id)
