"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that stands in them outside links and page
furniture: a container by its own, and what its inner ones hold counts less, but for a container
that has the heading. The scores of generalised paths (tags with classes, digits as #) are summed
over a host's pages in Spark; the path with the most is the host's. Every page is read again and
the blocks under its host's path make its text; a page without that path uses its own best.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialised, read_table, small

#: Host paths that are broadcast at most; beyond, hosts are joined by shuffling.
MAX_BROADCAST_HOSTS = 50_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([/]?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([/]?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WHITE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml object xmp noembed noframes".split())
#: Elements of another language: they may end where they begin, and one that never ends holds nothing back.
_FOREIGN = frozenset("svg annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements, words of class and id names, and roles of page furniture. A name is
# one of furniture if all its words are, or say nothing, and one at least is.
_DROPPED = frozenset("nav footer aside head button select menu dialog option".split())
_DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promos promotion cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs"
    " footer comment comments commentlist disqus reply replies respond discussion related recommended share sharing social widget widgets pagination pager login"
    " search toolbar masthead header skip".split()
)
_DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar".split())
_NEUTRAL = frozenset("area bar block bottom box btn button buttons container content form global group holder inner item items left link links list main page panel post posts primary right row secondary section site slot text title top unit wrap wrapper".split())
_KEPT = frozenset("html body article main".split())
_GOOD = frozenset("article content contents entry main post story text body".split())
_HEADINGS = frozenset("h1 h2 h3".split())
#: A form that holds more than this part of a page's text, and other furniture by name that
#: leaves less than the second part, is no furniture.
MOST_IN_FORM, LEAST_LEFT = 0.5, 0.1
#: What inner containers' text counts for the one around them; longest path as it is.
DECAY, LONGEST_PATH = 0.8, 1000


@lru_cache(10_000)
def is_furniture(name: str) -> bool:
    parts = [p for p in re.split(r"[-_]+", name) if p]
    return any(p in _DROPPED_NAMES for p in parts) and all(p in _DROPPED_NAMES or p in _NEUTRAL for p in parts)


@dataclass(slots=True)
class Container:
    """A container of a page: the one around it, its tag and path; free text of its own and with
    all inside, whether it has a heading."""

    parent: int
    tag: str
    path: str
    own: int = 0
    all: int = 0
    heading: bool = False


class Page:
    """Blocks of a page: (container, text, characters outside links, furniture around it), in
    order, those in elements of furniture left out."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, int]] = []
        self.containers = [Container(-1, "", "")]
        self.found: list[tuple[int, str, int, tuple[int, ...]]] = []
        # tag, container, in an element of furniture, in a link, furniture by name and forms around it
        self.stack: list[tuple[str, int, bool, bool, tuple[int, ...]]] = []
        self.soft: list[str] = []
        self.buffer: list[tuple[str, bool]] = []
        self.open_articles = 0
        self.read(source)
        self.settle()

    def flush(self) -> None:
        if not self.buffer:
            return
        text = _WHITE.sub(" ", html.unescape("".join(t for t, _ in self.buffer))).strip()
        if text:
            free = len(_WHITE.sub(" ", "".join(t for t, link in self.buffer if not link)).strip())
            _, at, _, _, soft = self.stack[-1] if self.stack else ("", 0, False, False, ())
            self.found.append((at, text, free, soft))
            if any(t in _HEADINGS for t, *_ in self.stack[-3:]):
                self.containers[at].heading = True
        self.buffer = []

    def open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            self.flush()
            if tag not in ("html", "body"):
                self.close_up("p", frozenset("article aside blockquote body div footer form header li main nav section table td th".split()))
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                self.close_up(tag, frozenset("ul ol dl table menu".split()))
        _, at, dropped, link, soft = self.stack[-1] if self.stack else ("", 0, False, False, ())
        found = {}
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        container = tag in _BLOCKS and tag not in ("p", "hr", "h1", "h2", "h3", "h4", "h5", "h6")
        if not dropped and tag not in _KEPT:
            dropped = tag in _DROPPED or (tag == "header" and not self.open_articles) or found.get("role", "").lower() in _DROPPED_ROLES
            names = f"{found.get('class', '')} {found.get('id', '')}".lower().split() if found and container else ()
            if not dropped and (tag == "form" or any(map(is_furniture, names)) and not (tag == "header" and self.open_articles)):
                self.soft.append(tag)
                soft = (*soft, len(self.soft) - 1)
        if container:
            kind = ".".join(sorted(_DIGITS.sub("#", c) for c in found.get("class", "").lower().split()))
            step = f"{tag}.{kind}" if kind else tag
            path = f"{self.containers[at].path}/{step}".lstrip("/")
            if len(path) > LONGEST_PATH:  # deep nesting stays linear
                path = f"~{xxhash.xxh64_hexdigest(path)}"
            self.containers.append(Container(at, tag, path))
            at = len(self.containers) - 1
        if tag not in _VOID:
            self.open_articles += tag in ("article", "main")
            self.stack.append((tag, at, dropped, link or tag == "a", soft))

    def cut_stack(self, i: int) -> None:
        self.open_articles -= sum(t in ("article", "main") for t, *_ in self.stack[i:])
        del self.stack[i:]

    def close_up(self, tag: str, until: frozenset[str]) -> None:
        """End an open tag that a new block ends, if no container stands between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.cut_stack(i)
                return
            if self.stack[i][0] in until:
                return

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if any(t in _BLOCKS for t, *_ in self.stack[i:]):
                    self.flush()
                self.cut_stack(i)
                return

    def text(self, t: str) -> None:
        if t and not (self.stack and self.stack[-1][2]):
            self.buffer.append((t, bool(self.stack) and self.stack[-1][3]))

    def read(self, source: str) -> None:
        at = 0
        lower = None
        while m := _TAG.search(source, at):
            self.text(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
            elif tag == "br":
                self.text(" ")
            elif tag in _RAW:
                if tag in _FOREIGN and (m[3] or m[6] or "").endswith("/"):
                    continue
                lower = source.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at) if len(lower) == len(source) else source.find(f"</{tag}", at)
                at = end if end >= 0 else at if tag in _FOREIGN else len(source)
            elif tag in _VOID and tag != "hr":
                continue
            else:
                self.open(tag, m[3] or m[6] or "")
        self.text(source[at:])
        self.flush()

    def settle(self) -> None:
        """Keep the blocks outside furniture, sum up what containers hold."""
        total = sum(free for _, _, free, _ in self.found)
        held = [0] * len(self.soft)
        for _, _, free, soft in self.found:
            for i in soft:
                held[i] += free
        kept = [h > MOST_IN_FORM * total if tag == "form" else total - h < LEAST_LEFT * total for tag, h in zip(self.soft, held, strict=True)]
        for at, text, free, soft in self.found:
            if all(kept[i] for i in soft):
                self.blocks.append((at, text, free))
                self.containers[at].own += free
        for c in reversed(self.containers):
            c.all += c.own
            if c.parent >= 0:
                self.containers[c.parent].all += c.all
                self.containers[c.parent].heading |= c.heading and c.tag in ("header", "hgroup")

    def scores(self) -> dict[str, int]:
        """Points of container paths: a container's own free text, and that of inner ones, which
        counts less unless the heading is here; more for names that say content, less for the
        page as a whole. Of containers of one path the best one counts."""
        out: dict[str, int] = defaultdict(int)
        for c in self.containers:
            if c.all:
                points = c.own + (c.all - c.own) * (1.0 if c.heading else DECAY)
                last = c.path.rpartition("/")[2]
                good = 6 if c.tag in ("article", "main") else 1 if c.tag in ("", "html", "body") else 3 if set(_WORDS.findall(last)[1:]) & _GOOD else 2
                out[c.path] = max(out[c.path], int(points * good))
        return out

    def best(self) -> str:
        return max(self.scores().items(), key=lambda x: (x[1], x[0]), default=("", 0))[0]

    def under(self, path: str) -> list[str]:
        inside = [not path]
        for c in self.containers[1:]:
            inside.append(inside[c.parent] or c.path == path)
        return [t for at, t, _ in self.blocks if inside[at]]

    def main_text(self, host_path: str | None) -> str:
        found = self.under(host_path) if host_path else []
        return "\n".join(found or self.under(self.best()))


def host_of(url: Column) -> Column:
    """A url's host in lower case, without port and leading www.; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    return host


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the container path with the highest sum of scores over a host's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], int] = defaultdict(int)
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                for path, n in Page(source.as_py() or "").scores().items():
                    votes[host, path] += n
            cols = [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "path", "n"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, n long")
    votes = votes.groupBy("host", "path").agg(F.sum("n").alias("n")).where("n > 0")
    return votes.groupBy("host").agg(F.max(F.struct("n", "path")).alias("m")).select("host", F.col("m.path").alias("path"))


def main_texts(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) as page_id, url, text and n_chars, a row for each page.

    Null or empty html gives an empty text; a null url, or one without a host, votes with all
    such pages. Repeated rows give equal rows and vote once each. Broken and cut-off markup is
    read as far as it goes. An empty table gives no rows; other columns are not read."""
    paths = materialised(host_paths(pages), "paths")
    own = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    both = own.join(small(paths, MAX_BROADCAST_HOSTS), "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(s.as_py() or "").main_text(p.as_py()) for s, p in zip(batch.column("html"), batch.column("path"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return both.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"))
