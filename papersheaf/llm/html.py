"""Main text of web pages by consensus of each host's container paths.

Each page's containers are scored by the text of the blocks in them, less what is linked. From the best container a page climbs
to the ``main`` or ``article`` around it, or to the lowest ancestor that holds nearly all of the page's unlinked text, and votes
for the generalised path of that: tags with their classes from the root, digits replaced, so that numbered classes fall together. Spark
counts the votes per host, and every page of the host is extracted again from its winning paths. A page that has none of
them is extracted from its own best container. Blocks that stand directly in the containers around the chosen one, as a heading,
belong to the text unless they are mostly links. So do the boxes beside the chosen container, whatever their size, where no ``main``
or ``article`` bounds the text: unless they are mostly links, or repeat on the host. Pages vote on that too: a box's path counts as
repeated when the same text stands there beside at least ``REPEATS`` different main texts and beside ``share`` of the host's.

A host is never gathered: votes are counts per host and path, or per host, path and digests of texts. A host has at most ``1 / share``
winning paths beside its first, and as many repeated ones for each box that its pages have on average. Both are broadcast when their
measured size allows, else joined by host. Paths are kept as digests along the tree, so a page takes memory in proportion
to its length however deep its tags are nested.

Side matter is what its tag, role or ``hidden`` says, and containers whose class or id names it, unless they hold the main text
(``Page.without_side``). Names that tell of a state, as ``has-sidebar``, are no such names. Inside ``main`` or ``article`` a name that
says so with less than half of its words, as ``notice-board-history``, counts only for boxes that are mostly links.

Defined results: null or empty html has an empty text. A page whose url is null or names no host votes with the others of
that kind. Cut-off pages are read as far as they go. Repeated pages vote and are extracted one by one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.llm import urls, words
from papersheaf.llm.tables import measured_bytes
from papersheaf.session import materialized

SHARE = 0.2
REPEATS = 3
PARENT_PART = 0.5
NEARLY = 0.95

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp template".split())
SKIPPED = RAW | set("head nav header footer aside form menu button select option svg canvas object dialog audio video map".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption td th summary address".split())
CONTAINERS = set(
    "html body article main section div ul ol dl table tbody thead tfoot tr blockquote figure details fieldset center".split()
)
INLINE = RAW | set("button select option svg canvas object audio video map".split())
CLOSES_P = LEAVES | CONTAINERS | SKIPPED - INLINE | {"hr"}
MAIN = ("main", "article")
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = {f"h{k}" for k in range(1, 7)}
PARAGRAPH = {"p"}
ENDED = {name: PARAGRAPH | same for name, same in SAME.items()} | {name: PARAGRAPH | HEADINGS for name in HEADINGS}
SIDE_WORDS = set(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
    disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion
    related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split()
)
STATE_WORDS = set("has have with without no not is open opened closed free enabled disabled off work".split())  # has-sidebar, ad-free
READER_WORDS = set("comment comments disqus replies reply".split())
SIDE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(4096)
def describe(name: str, attributes: str) -> tuple[str, bool, set[str], bool]:
    """A tag's step of a generalised path, whether it stands beside the main text, the words by which its names say so, and
    whether they are less than half of each name and none of them is for readers' comments."""
    if not attributes.strip("/ \t\n\r\f"):
        return name, name in SKIPPED, set(), False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    classes = found.get("class", "").split()
    step = ".".join([name, *sorted({re.sub(r"\d+", "#", c) for c in classes})])
    aside = name in SKIPPED or "hidden" in found or found.get("role", "").lower() in SIDE_ROLES
    marks: set[str] = set()
    weak = True
    if name not in ("html", "body"):
        for token in [*classes, *found.get("id", "").split()]:
            named = {w.lower() for w in NAMES.findall(token)}
            side = named & SIDE_WORDS
            if side and not named & STATE_WORDS:
                marks |= side
                weak = weak and 2 * len(side) < len(named)
    return step, aside, marks, bool(marks) and weak and not marks & READER_WORDS


@dataclass
class Page:
    """The blocks of a page, and the containers they stand in; what is inside a container comes after it."""

    steps: list[str] = field(default_factory=lambda: [""])
    paths: list[str] = field(default_factory=lambda: [""])  # digests, equal for equal paths
    parents: list[int] = field(default_factory=lambda: [-1])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # container, text, linked characters
    marks: dict[int, set[str]] = field(default_factory=dict)  # containers whose names put them beside the main text
    weak: set[int] = field(default_factory=set)  # those of them whose names say so with less than half of their words
    passed: int = 0  # characters of marked tags inside paragraphs
    known: dict[tuple[str, str], str] = field(default_factory=dict)

    def add(self, container: int, step: str) -> int:
        """A new container inside another one."""
        around = self.paths[container]
        path = self.known.get((around, step))
        if path is None:
            path = hashlib.blake2b(f"{around} {step}".encode("utf-8", "replace"), digest_size=16).hexdigest()
            self.known[around, step] = path
        self.steps.append(step)
        self.paths.append(path)
        self.parents.append(container)
        return len(self.paths) - 1

    def tag(self, container: int) -> str:
        return self.steps[container].partition(".")[0]

    def chain(self, container: int) -> list[int]:
        """A container and those around it, from the inside."""
        found = []
        while container >= 0:
            found.append(container)
            container = self.parents[container]
        return found

    def sums(self) -> tuple[list[int], list[int]]:
        """The characters of each container with all inside it, and the linked ones of them."""
        sizes, links = [0] * len(self.paths), [0] * len(self.paths)
        for k, text, linked in self.blocks:
            sizes[k] += len(text)
            links[k] += linked
        for k in range(len(sizes) - 1, 0, -1):
            sizes[self.parents[k]] += sizes[k]
            links[self.parents[k]] += links[k]
        return sizes, links

    def without_side(self) -> Page:
        """The page without the blocks of marked containers, where the mark counts.

        It does not count for a container that holds ``main``, nor, inside ``main`` or ``article``, for a weak one that is not
        mostly links. If no ``main`` or ``article`` with text stands outside the marked ones, it counts neither where an unmarked
        ``article`` inside holds more than all that stands outside, nor where the container holds most of the page's unlinked
        text, unless it is named for readers' comments.
        """
        if not self.marks:
            return self
        whole, links = self.sums()
        sizes = [a - b for a, b in zip(whole, links)]
        size, parents = len(self.paths), self.parents
        bounded, counts, marked = [False] * size, [False] * size, [False] * size
        for k in range(size):
            bounded[k] = k > 0 and (bounded[parents[k]] or self.tag(parents[k]) in MAIN)
            counts[k] = k in self.marks and not (bounded[k] and k in self.weak and 2 * links[k] <= whole[k])
            marked[k] = counts[k] or (k > 0 and marked[parents[k]])
        outside = sum(len(text) - linked for k, text, linked in self.blocks if not marked[k])
        plain = any(sizes[k] > 0 and not marked[k] and self.tag(k) in MAIN for k in range(size))
        holds_main, article = [self.tag(k) == "main" for k in range(size)], [0] * size
        for k in range(size - 1, 0, -1):
            if self.tag(k) == "article" and not counts[k]:
                article[k] = max(article[k], sizes[k])
            holds_main[parents[k]] |= holds_main[k]
            if not (counts[k] and self.marks[k] & READER_WORDS):
                article[parents[k]] = max(article[parents[k]], article[k])
        side = [False] * size
        for k in range(1, size):
            side[k] = side[parents[k]]
            if counts[k] and not holds_main[k]:
                reader = bool(self.marks[k] & READER_WORDS)
                main = not plain and not reader and (article[k] > outside or 2 * sizes[k] > sizes[0])
                side[k] = side[k] or not main
        left = [block for block in self.blocks if not side[block[0]]]
        return Page(self.steps, self.paths, parents, left, {}, set(), self.passed, self.known)

    def scores(self) -> dict[int, float]:
        scores: dict[int, float] = defaultdict(float)
        for container, text, linked in self.blocks:
            value = len(text) - linked
            scores[container] += value
            if self.parents[container] >= 0:
                scores[self.parents[container]] += PARENT_PART * value
        return scores

    def core(self) -> int | None:
        """The best container, the first of equals."""
        scores = self.scores()
        return min(scores, key=lambda k: (-scores[k], k)) if scores else None

    def held(self) -> dict[str, int]:
        """The unlinked characters in all containers of each path, with those inside."""
        held: dict[str, int] = defaultdict(int)
        for path, size, linked in zip(self.paths, *self.sums()):
            held[path] += size - linked
        return held

    def best(self) -> str | None:
        """The path of the best container, or of what holds the text around it.

        That is the outermost ``main`` or ``article`` around it with half of the page's unlinked text, else the lowest ancestor
        with ``NEARLY`` all of it.
        """
        core = self.core()
        if core is None:
            return None
        held, chain = self.held(), self.chain(core)
        total = held[""]
        for k in reversed(chain):
            if self.tag(k) in MAIN and 2 * held[self.paths[k]] >= total:
                return self.paths[k]
        return next((self.paths[k] for k in chain if held[self.paths[k]] >= NEARLY * total), "")

    def layout(self, chosen: str) -> tuple[list[bool], list[bool], list[int]]:
        """For each container whether it lies in one of the chosen path or around it, and the box beside them that it lies in, or -1.

        Where the path is that of the whole page, the best container takes its place. ``main`` and ``article`` have no box beside them.
        """
        size = len(self.paths)
        first = self.paths.index(chosen)
        whole = self.tag(first) in ("", "html", "body")
        core = self.core() if whole else None
        inside, around, box = [False] * size, [False] * size, [-1] * size
        for k in range(size):
            found = k == core if whole else self.paths[k] == chosen
            inside[k] = found or (k > 0 and inside[self.parents[k]])
        for k in range(size - 1, -1, -1):
            starts = inside[k] and (k == 0 or not inside[self.parents[k]])
            if k > 0 and (starts or around[k]):
                around[self.parents[k]] = True
        around[0] = around[0] or not inside[0]
        if self.tag(first) not in MAIN:
            for k in range(1, size):
                if not inside[k] and not around[k]:
                    box[k] = k if around[self.parents[k]] else box[self.parents[k]]
        return inside, around, box

    def text(self, chosen: str, repeated: frozenset[str] = frozenset()) -> str:
        """The text inside the containers of a path, the blocks around them that are not mostly links, and the boxes beside them.

        Left out of these are repeated ones, and containers in them that are mostly links.
        """
        inside, around, box = self.layout(chosen)
        sizes, links = self.sums()
        taken = list(inside)
        for k in range(1, len(taken)):
            if box[k] >= 0 and 2 * links[k] <= sizes[k]:
                taken[k] = self.paths[k] not in repeated if box[k] == k else taken[self.parents[k]]
        return " ".join(text for k, text, linked in self.blocks if taken[k] or (around[k] and 2 * linked <= len(text)))

    def votes(self) -> list[tuple[str, str | None, str]]:
        """``(path, text, main)``: the best path with no text, and each box beside it with the digests of its and of the main text."""
        chosen = self.best()
        if chosen is None:
            return []
        inside, _, box = self.layout(chosen)
        main, boxes = hashlib.blake2b(digest_size=16), {}
        for k, text, _ in self.blocks:
            if inside[k] or box[k] >= 0:
                digest = main if inside[k] else boxes.setdefault(box[k], hashlib.blake2b(digest_size=16))
                digest.update(text.encode("utf-8", "replace") + b"\0")
        named = main.hexdigest()
        return [(chosen, None, named), *((self.paths[k], digest.hexdigest(), named) for k, digest in boxes.items())]

    def extract(self, winning: list[str], repeated: frozenset[str] = frozenset()) -> str:
        """The text of the winning path that scores best here among those that hold nearly the most, or of the page's own."""
        held, scores, filled = self.held(), defaultdict(float), set()
        for path, size in zip(self.paths, self.sums()[0]):
            if size:
                filled.add(path)
        for k, value in self.scores().items():
            scores[self.paths[k]] += value
        known = [path for path in winning if path in filled]
        most = max((held[path] for path in known), default=0)
        known = [path for path in known if held[path] >= NEARLY * most]
        chosen = max(known, key=lambda path: (scores[path], path)) if known else self.best()
        return self.text(chosen, repeated) if chosen is not None else ""


class Reader:
    """Reads one page from start to end, as far as it goes."""

    def __init__(self, source: str, by_name: bool = True):
        self.page = Page()
        self.by_name = by_name
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, beside the main text, passed over
        self.open: dict[str, int] = defaultdict(int)
        self.parts: list[str] = []
        self.linked = 0
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            sign = source.find("<", at)
            if sign < 0:
                sign = size
            if sign > at:
                self._text(source[at:sign])
            if sign == size:
                return
            if source.startswith("<!--", sign):
                stop = source.find("-->", sign + 4)
                at = size if stop < 0 else stop + 3
                continue
            if source[sign + 1 : sign + 2] in ("!", "?"):
                stop = source.find(">", sign)
                at = size if stop < 0 else stop + 1
                continue
            tag = TAG.match(source, sign)
            if tag is None:
                if re.match(r"</?[a-zA-Z]", source[sign : sign + 3]):
                    stop = source.find(">", sign)  # a quote without end, or a page cut off inside a tag
                    at = size if stop < 0 else stop + 1
                else:
                    self._text("<")
                    at = sign + 1
                continue
            at = tag.end()
            name = tag[2].lower()
            if tag[1]:
                self._close(name)
                continue
            self._open(name, tag[3])
            if name in RAW:
                stop = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = size if stop is None else stop.end()
                self._close(name)

    def _text(self, raw: str) -> None:
        if self.stack[-1][2]:
            if self.stack[-1][3]:
                self.page.passed += len(raw.strip())
            return
        text = references.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.open["a"]:
            self.linked += len(text)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.page.blocks.append((self.stack[-1][1], text, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def _open(self, name: str, attributes: str) -> None:
        block = name in CLOSES_P
        if block:
            self._flush()
            self._close_leaf(name)
        if name == "br":
            self.parts.append(" ")
        if name in VOID:
            return
        _, container, aside, passed = self.stack[-1]
        step, side, marks, weak = describe(name, attributes if name != "a" else "")
        marks = marks if self.by_name else set()
        if not aside and not side and (name in CONTAINERS or (marks and block)):
            container = self.page.add(container, step)
            if marks:
                self.page.marks[container] = marks
                if weak:
                    self.page.weak.add(container)
        elif marks and not weak and not aside and not side:  # inside a paragraph
            side = passed = True
        elif side:
            passed = False
        self.stack.append((name, container, aside or side, passed))
        self.open[name] += 1

    def _close_leaf(self, name: str) -> None:
        """A new block ends an open paragraph, and a list item or cell ends the one before it."""
        ended = ENDED.get(name, PARAGRAPH)
        for tag in ended:
            if self.open[tag]:
                break
        else:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth][0]
            if tag in ended:
                self._pop(depth)
                if tag == "p":
                    return
            elif tag in CONTAINERS and not (name in SAME and tag == "tr" and "tr" in ended):
                return

    def _close(self, name: str) -> None:
        if name in CLOSES_P:
            self._flush()
        if not self.open[name]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == name:
                self._pop(depth)
                return
            if name not in CONTAINERS and name not in SKIPPED and self.stack[depth][0] in CONTAINERS:
                return  # an inline end tag without a start does not leave its container

    def _pop(self, depth: int) -> None:
        ended = self.stack[depth:]
        for entry in ended:
            if entry[0] in CLOSES_P:
                self._flush()
                break
        for entry in ended:
            self.open[entry[0]] -= 1
        del self.stack[depth:]


def read(source: str | None) -> Page:
    """A page without its side matter; names do not count where they would leave nothing, or less than they take from paragraphs."""
    page = Reader(source or "").page
    named = bool(page.marks) or page.passed > 0
    page = page.without_side()
    if named and page.passed >= sum(len(text) for _, text, _ in page.blocks):
        return Reader(source or "", by_name=False).page
    return page


def consensus(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``(host, paths, repeated)``: the path with most votes of each host and all that have at least ``share`` of them, and the paths
    of boxes beside them whose text repeats."""

    def vote(batch: pa.RecordBatch) -> dict:
        rows = [
            (host, *found)
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())
            for found in read(source).votes()
        ]
        return {name: [row[k] for row in rows] for k, name in enumerate(("host", "path", "beside", "main"))}

    votes = words.map_slices(
        pages.select("host", "html"), vote, "host string, path string, beside string, main string", text="html"
    )
    counted = materialized(votes.groupBy("host", "path", "beside", "main").agg(F.count("*").alias("votes")))
    best = counted.filter("beside is null").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.count("*").alias("texts"))
    totals = best.groupBy("host").agg(
        F.sum("votes").alias("total"), F.sum("texts").alias("texts"), F.max_by("path", F.struct("votes", "path")).alias("first")
    )
    winning = best.drop("texts").join(totals, "host").filter((F.col("path") == F.col("first")) | (F.col("votes") >= share * F.col("total")))
    beside = counted.filter("beside is not null").groupBy("host", "path", "beside").agg(F.count("*").alias("times"))
    beside = beside.groupBy("host", "path").agg(F.max("times").alias("times")).filter(F.col("times") >= REPEATS)
    repeated = beside.join(totals, "host").filter(F.col("times") >= share * F.col("texts"))
    found = winning.select("host", "path", F.lit(None).cast("string").alias("box")).unionByName(
        repeated.select("host", F.lit(None).cast("string").alias("path"), F.col("path").alias("box"))
    )
    return found.groupBy("host").agg(
        F.array_sort(F.collect_list("path")).alias("paths"), F.array_sort(F.collect_list("box")).alias("repeated")
    )


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``(page_id, url, text)``, one row per page."""
    named = pages.select("page_id", "url", "html", urls.host(F.col("url")).alias("host"))
    agreed = consensus(named, share).select("host", F.to_json(F.struct("paths", "repeated")).alias("agreed"))
    joined = named.join(measured_bytes(materialized(agreed), "agreed"), "host", "left")

    def again(batch: pa.RecordBatch) -> dict:
        texts = [
            read(source).extract(*_paths(packed))
            for source, packed in zip(batch.column("html").to_pylist(), batch.column("agreed").to_pylist())
        ]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts}

    return words.map_slices(joined, again, "page_id bigint, url string, text string", text="html")


@lru_cache(4096)
def _paths(packed: str | None) -> tuple[list[str], frozenset[str]]:
    found = json.loads(packed) if packed else {}
    return found.get("paths", []), frozenset(found.get("repeated", []))
