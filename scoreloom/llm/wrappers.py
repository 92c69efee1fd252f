"""Main text of web pages by wrapper induction.

The block trees of the pages of a host are aligned by simple tree matching: two nodes match when their symbols (element and
names) agree, and the children of matching nodes are aligned in order so that the number of matching nodes is greatest.  Aligned trees merge
into a wrapper, a tree of slots.  Children that repeat (paragraphs, list items, rows, bare containers of like structure) share a slot.
Every slot counts the pages that have it and, for a bounded number of its commonest texts, the pages that have the text.

A text that nearly all pages of a host have in one slot is template.  What varies is content, and the container that holds most of the varying, unlinked
text is the host's article.  Elements, roles and names that HTML reserves for menus, notices, adverts, forms and comments are out wherever
they stand; they vary from page to page like an article, so alignment alone cannot tell them apart.

On Spark each page becomes a small tree of hashed texts.  Pages of a host whose longest text is the same are one page, so that copies
of an article don't look like template.  Each task folds its pages into one wrapper a host, and the wrappers of a host, at most
one a task, are merged; so a hot host is folded by all tasks.  The wrapper then meets the pages by host.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import stored
from scoreloom.llm.page_trees import CONTAINERS, Node, page_tree
from scoreloom.llm.url_lists import url_host

KEPT_TEXTS = 256


@dataclass(frozen=True)
class Plan:
    """A text is template from ``least`` pages of different content on, when this share of them has it.  ``core``: share of a container's text with which a child replaces it."""

    least: int = 4
    share: float = 0.75
    core: float = 0.6
    linked: float = 0.7
    alike: float = 0.7


class Slot:
    """A node of a wrapper.  ``texts``: of its commonest texts the pages and characters; a count is short by at most all counts over ``KEPT_TEXTS``."""

    __slots__ = ("symbol", "pages", "chars", "links", "texts", "kids", "nodes")

    def __init__(self, symbol: str, pages: int = 1, chars: int = 0, links: int = 0, texts: dict | None = None, kids: list | None = None) -> None:
        self.symbol, self.pages, self.chars, self.links, self.texts, self.kids, self.nodes = symbol, pages, chars, links, texts or {}, kids or [], []

    def plain(self) -> tuple:
        return (self.symbol, self.pages, self.chars, self.links, self.texts, [k.plain() for k in self.kids])

    @classmethod
    def of(cls, plain: tuple) -> Slot:
        *own, kids = plain
        return cls(*own, [cls.of(k) for k in kids])

    @property
    def tag(self) -> str:
        return self.symbol.split(".", 1)[0]

    @property
    def bare(self) -> bool:
        """A container without names: siblings of its kind need not be of its kind of content."""
        return self.symbol in CONTAINERS

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def matching(a: Slot, b: Slot) -> int:
    """Simple tree matching: the greatest number of nodes that two ordered trees have in common."""
    if a.symbol != b.symbol:
        return 0
    return 1 + sum(n for _, _, n in aligned(a.kids, b.kids))


def aligned(a: list[Slot], b: list[Slot]) -> list[tuple[int, int, int]]:
    """Pairs of places of two rows of children, in order, with the greatest sum of matching nodes."""
    if not a or not b:
        return []
    if len(a) == len(b) and len({k.symbol for k in a}) == len(a) and all(x.symbol == y.symbol for x, y in zip(a, b, strict=True)):
        return [(i, i, matching(x, y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    weight = [[matching(x, y) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + weight[i][j] if weight[i][j] else 0)
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if weight[i][j] and best[i][j] == best[i + 1][j + 1] + weight[i][j]:
            pairs.append((i, j, weight[i][j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def add_texts(into: dict, more: dict) -> None:
    """Sum counters of texts, of which the commonest stay (frequent items by decrement, four times as many in between)."""
    for key, (pages, chars) in more.items():
        own = into.get(key)
        into[key] = (pages, chars) if own is None else (own[0] + pages, own[1] + chars)
    if len(into) > 4 * KEPT_TEXTS:
        cut = sorted((p for p, _ in into.values()), reverse=True)[KEPT_TEXTS]
        for key in [k for k, (p, _) in into.items() if p <= cut]:
            del into[key]
        for key, (p, c) in into.items():
            into[key] = (p - cut, c)


def merge(a: Slot, b: Slot, same_page: bool = False) -> Slot:
    """Merge b into a.  On one page a text counts once however often it stands in a slot."""
    if same_page:
        for key, (_, chars) in b.texts.items():
            a.texts[key] = (1, a.texts[key][1] + chars if key in a.texts else chars)
    else:
        a.pages += b.pages
        add_texts(a.texts, b.texts)
    a.chars, a.links = a.chars + b.chars, a.links + b.links
    a.nodes += b.nodes
    if not b.kids:
        return a
    if len(a.kids) == len(b.kids) == 1 and a.kids[0].symbol == b.kids[0].symbol:
        merge(a.kids[0], b.kids[0], same_page)
        return a
    pairs = {j: i for i, j, _ in aligned(a.kids, b.kids)}
    out, upto = list(a.kids), 0
    for j, kid in enumerate(b.kids):
        if j in pairs:
            upto = out.index(merge(a.kids[pairs[j]], kid, same_page)) + 1
            continue
        again = None if kid.bare else next((k for k in out if k.symbol == kid.symbol), None)
        if again is not None:  # in another place of the order, yet the same slot
            merge(again, kid, same_page)
        else:
            out.insert(upto, kid)
            upto += 1
    a.kids = out
    return a


def wrap(node: Node, plan: Plan) -> Slot | None:
    """The slots of one page; None for what is out."""
    if node.out:
        return None
    if node.tag == "#text":
        slot = Slot("#text", 1, len(node.text), node.links, {text_hash(node.text): (1, len(node.text))})
        slot.nodes.append(node)
        return slot
    own = Slot(node.symbol)
    own.nodes.append(node)
    for kid in node.kids:
        slot = wrap(kid, plan)
        if slot is None or slot.tag != "#text" and not slot.kids:
            continue
        like = [k for k in own.kids if k.symbol == slot.symbol]
        if slot.bare:
            like = [k for k in like if 2 * matching(k, slot) >= plan.alike * (k.size() + slot.size())]
        if like:
            merge(like[0], slot, same_page=True)
        else:
            own.kids.append(slot)
    return own


def page_slots(source: str, plan: Plan) -> Slot:
    return wrap(page_tree(source), plan) or Slot("html")


def texts_of(slot: Slot) -> Iterator[Node]:
    for node in slot.nodes:
        if node.tag == "#text":
            yield node
    for kid in slot.kids:
        yield from texts_of(kid)


class Wrapper:
    """What a host's slots say of each slot: whether a text there is template, and where the article is."""

    def __init__(self, root: Slot, plan: Plan) -> None:
        self.root, self.plan, self.pages = root, plan, root.pages
        self.mass: dict[int, float] = {}
        self.fixed: dict[int, set[int]] = {}
        self.menus: dict[int, bool] = {}
        self._weigh(root)
        self.path = [root]
        while True:
            here = self.path[-1]
            if here.tag == "article":
                break
            inner = [k for k in here.kids if k.tag in CONTAINERS and k.tag not in ("tr", "ul", "ol", "dl", "blockquote", "figure")]
            heaviest = max(inner, key=lambda k: self.mass[id(k)], default=None)
            if heaviest is None or not self.mass[id(heaviest)] or self.mass[id(heaviest)] < plan.core * self.mass[id(here)]:
                break
            self.path.append(heaviest)

    def template(self, slot: Slot) -> set[int]:
        """Texts that nearly all pages of different content have in this slot."""
        return {t for t, (pages, _) in slot.texts.items() if pages >= self.plan.least and pages >= self.plan.share * self.pages}

    def _weigh(self, slot: Slot) -> float:
        """Characters of varying text outside links."""
        own = 0.0
        if slot.symbol == "#text":
            self.fixed[id(slot)] = self.template(slot)
            fixed = sum(slot.texts[t][1] for t in self.fixed[id(slot)])
            own = max(0, slot.chars - fixed - slot.links)
        self.mass[id(slot)] = own + sum(self._weigh(k) for k in slot.kids)
        return self.mass[id(slot)]

    def links_only(self, slot: Slot) -> bool:
        """A list or table of links, judged over all pages."""
        if slot.tag not in ("ul", "ol", "dl", "table", "div", "section"):
            return False
        if id(slot) not in self.menus:
            chars, links = 0, 0
            todo = [slot]
            while todo:
                s = todo.pop()
                chars, links = chars + s.chars, links + s.links
                todo += s.kids
            self.menus[id(slot)] = chars > 0 and links >= self.plan.linked * chars
        return self.menus[id(slot)]

    def content(self, page: Slot) -> list[Node] | None:
        """Text nodes of the article of a page in this wrapper; None where the page has no such place."""
        kept: list[Node] = []
        found = False

        def take(host: Slot, own: Slot) -> None:
            nonlocal found
            found = True
            kept.extend(self._inside(host, own))

        def descend(host: Slot, own: Slot, depth: int) -> None:
            if depth == len(self.path) - 1:
                take(host, own)
                return
            after = self.path[depth + 1]
            for i, j, _ in aligned(host.kids, own.kids):
                if host.kids[i] is after:
                    descend(after, own.kids[j], depth + 1)
                elif host.kids[i].tag == "h1" and not any(s.tag == "h1" for s in self.path[-1].kids):
                    kept.extend(self._inside(host.kids[i], own.kids[j]))

        if page.symbol == self.root.symbol:
            descend(self.root, page, 0)
        return kept if found else None

    def _inside(self, host: Slot | None, own: Slot) -> list[Node]:
        if host is not None and host is not self.path[-1] and self.links_only(host):
            return []
        fixed = self.fixed.get(id(host))
        out = [n for n in own.nodes if n.tag == "#text" and not (fixed and text_hash(n.text) in fixed)]
        partner = {j: host.kids[i] for i, j, _ in aligned(host.kids, own.kids)} if host is not None else {}
        for j, kid in enumerate(own.kids):
            out += self._inside(partner.get(j), kid)
        return out


def main_text(source: str, wrapper: Wrapper | None, plan: Plan) -> str:
    """Blocks of the article in the order of the page, joined by one space."""
    page = page_slots(source, plan)
    kept = wrapper.content(page) if wrapper is not None else None
    if not kept:
        kept = Wrapper(page, plan).content(page) or []
    chosen = {id(n) for n in kept}
    return " ".join(n.text for n in page.nodes[0].walk() if id(n) in chosen) if page.nodes else ""


def key_and_slots(source: str, plan: Plan) -> tuple[int, bytes]:
    """Hash of the longest text of a page outside links, and its slots."""
    page = page_slots(source, plan)
    longest = max((n for n in texts_of(page)), key=lambda n: (len(n.text) - n.links, n.text), default=None)
    return text_hash(longest.text) - (1 << 63) if longest is not None else 0, pickle.dumps(page.plain(), protocol=5)


@lru_cache(maxsize=512)
def wrapper_from(packed: bytes, plan: Plan) -> Wrapper:
    return Wrapper(Slot.of(pickle.loads(packed)), plan)


def host_wrappers(pages: DataFrame, plan: Plan = Plan(), url: str = "url", html: str = "html") -> DataFrame:
    """``host, wrapper``: the merged slots of all pages of each host; pages without a host are one host, the empty text."""
    schema = pa.schema([("host", pa.string()), ("content", pa.int64()), ("slots", pa.binary())])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                made = [key_and_slots(h or "", plan) for h in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("host"), pa.array([k for k, _ in made], pa.int64()), pa.array([s for _, s in made], pa.binary())], schema=schema)

    read = pages.select(F.coalesce(url_host(F.col(url)), F.lit("")).alias("host"), F.col(html).alias("html"))
    different = read.mapInArrow(sketched, "host string, content bigint, slots binary").groupBy("host", "content").agg(F.min("slots").alias("slots"))

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, held = None, None
        for batch in batches:
            out = []
            for own, slots in zip(batch["host"], batch["slots"], strict=True):
                if own != host and held is not None:
                    out.append((host, pickle.dumps(held.plain(), protocol=5)))
                    held = None
                host = own
                held = Slot.of(pickle.loads(slots)) if held is None else merge(held, Slot.of(pickle.loads(slots)))
            if out:
                yield pd.DataFrame(out, columns=["host", "slots"])
        if held is not None:
            yield pd.DataFrame([(host, pickle.dumps(held.plain(), protocol=5))], columns=["host", "slots"])

    partial = different.select("host", "slots").sortWithinPartitions("host").mapInPandas(folded, "host string, slots binary")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        merged = None
        for slots in sorted(rows["slots"]):
            one = Slot.of(pickle.loads(slots))
            merged = one if merged is None else merge(merged, one)
        return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [pickle.dumps(merged.plain(), protocol=5)]})

    return partial.groupBy("host").applyInPandas(whole, "host string, wrapper binary")


def extract_main_text(pages: DataFrame, plan: Plan = Plan(), identity: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, one row for each row: the article's text, its blocks in order joined by one space.

    Character references are decoded and white space inside a block becomes one space.  A null or empty page, and one that is all menus, has an
    empty text.  A page that does not have its host's place of the article is its own host.  Repeated rows give equal results.  Pages without a readable
    host count as one host.  An empty table gives no rows; other columns are not read.
    """
    wrappers = stored(host_wrappers(pages, plan, url, html), "host-wrappers")
    read = pages.select(F.col(identity).alias("page_id"), F.col(url).alias("url"), F.coalesce(url_host(F.col(url)), F.lit("")).alias("__host"), F.col(html).alias("html"))
    met = read.join(wrappers.withColumnRenamed("host", "__host"), "__host", "left").drop("__host")
    id_type = pages.schema[identity].dataType.simpleString()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [main_text(h or "", wrapper_from(w, plan) if w is not None else None, plan) if h else "" for h, w in zip(some.column("html").to_pylist(), some.column("wrapper").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(extracted, f"page_id {id_type}, url string, text string, n_chars bigint")
