"""Main text of web pages by the page's markup and its host's repeated runs.

A page becomes blocks of visible text with what its markup says of them: part of
an article, of a menu, notice or other surroundings, or nothing. The token
streams of all pages of a host together form its suffix array: the suffixes at
every token of the text outside articles, and at the blocks of articles. As a
host may hold a third of all pages, suffixes are not sorted in one task: each is
reduced to a hash of its first ``depth`` tokens (a block of an article to its
whole), so that two have a common run of that length exactly if their hashes are
equal, and Spark groups them over all pages. A run that pages of different
content share is boilerplate if enough of the host's pages have it; blocks that
such runs cover go, unique ones stay.

How much is enough depends on what the markup says, because articles are copied
too: outside any container for content, text of under ``prose`` words needs a
twentieth of the host's different pages and longer text half of them; within a
container named by class or id half of them; and a whole block of a declared
article or main element two thirds, and ``clear`` pages at least. Runs alone
can't do: a host may have one page, and copied articles are repeated runs.

Defined results. A null html is empty; a page without any main text gives an
empty text and 0. If everything undecided were to go, all of it stays. Null
urls, and urls without a host, are one host. Repeated rows count as one page and
fare alike, whatever their ids. Unclosed and stray tags, comments and quotes are
read as browsers do in essence; cut references stay as they are. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import long, new_path, release_memory, small_batches, string, text_slices, written_texts
from .components import join_grouped

#: Elements whose content is no text of the page, as a whole or as containers.
RAW = "script style textarea title noscript iframe xmp noembed noframes".split()
MUTE = frozenset("head template svg canvas object audio video select button datalist".split())
#: Elements around an article, and those only around one (a form or a header may also hold it).
AROUND = frozenset("nav aside menu footer search dialog form header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var nobr picture output meter progress".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status tooltip tablist".split())
#: Words of class and id names, and beginnings and ends of words, that name surroundings.
WORDS = frozenset(
    "ad ads adv nav navs toc header masthead foot footer side rail notice notices alert alerts announcement announcements legal copyright colophon subnav topbar links blogroll share sharing sharer shares social follow related recommended recommendations recirculation trending pager paging print tools utility skip skiplink login signin signup register registration search form survey poll popup popover modal overlay lightbox paywall widget widgets feedback respond reply replies responses reactions discussion hidden noprint toast interstitial".split()
)
BEGINS = ("advert", "sponsor", "promo", "banner", "sidebar", "navbar", "navigation", "menu", "breadcrumb", "pagination", "cookie", "consent", "gdpr", "newsletter", "subscri", "comment", "disqus", "livefyre", "toolbar", "taboola", "outbrain", "adsense", "adslot", "adbox", "adunit", "adcontainer", "disclaimer")
ENDS = ("menu", "navbar", "sidebar", "banner", "footer", "comments", "popup", "advert", "adverts", "cookies")
#: Words that name a container for content; with those of ITS_OWN, a header is the article's.
CONTENT = frozenset("content article post entry story main body articlebody maincontent postcontent entrycontent text".split())
ITS_OWN = frozenset("article post entry story".split())

_MARK = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<(?:{'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</(?:{'|'.join(RAW)})(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<attributes2>[^>]*)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

NONE, CONTAINER, MAIN, ARTICLE = range(4)


class Block(NamedTuple):
    text: str
    rank: int  # what declares it content: NONE to ARTICLE
    around: bool  # part of the surroundings
    linked: int  # characters within links
    heading: bool  # a first-level heading


class _Open:
    __slots__ = ("name", "around", "holds", "rank", "mute")

    def __init__(self, name: str, around: bool, rank: int, mute: bool):
        self.name, self.around, self.rank, self.mute, self.holds = name, around, rank, mute, False


def named_around(words: list[str]) -> bool:
    """Whether words of class and id names name surroundings."""
    found = [w for w in words if w in WORDS or w.startswith(BEGINS) or w.endswith(ENDS)]
    return bool(found) and not (set(found) <= {"header"} and ITS_OWN & set(words))


class _Page:
    """One reading of a page's html into blocks."""

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.parts: list[str] = []
        self.links: list[int] = []  # places in parts that are within a link
        self.found: list[tuple[str, list[_Open], int, int, bool]] = []

    def flush(self) -> None:
        if not self.parts:
            return
        text = self.plain("".join(self.parts))
        if text:
            linked = sum(len(self.plain(self.parts[n])) for n in self.links)
            open_ = [o for o in self.stack if o.around]
            self.found.append((text, open_, max((o.rank for o in self.stack), default=NONE), linked, any(o.name == "h1" for o in self.stack)))
        self.parts, self.links = [], []

    @staticmethod
    def plain(text: str) -> str:
        return " ".join((entities.unescape(text) if "&" in text else text).split())

    def add(self, text: str) -> None:
        if text and not any(o.mute for o in self.stack[-40:]):
            if any(o.name == "a" for o in self.stack[-6:]):
                self.links.append(len(self.parts))
            self.parts.append(text)

    def cut(self, at: int) -> None:
        """Close all elements from this place of the stack on."""
        if any(o.name not in INLINE for o in self.stack[at:]):
            self.flush()
        del self.stack[at:]

    def start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "hr":
                self.flush()
            elif name == "br":
                self.add(" ")
            return
        inline = name in INLINE
        if not inline:
            self.flush()
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}.get(name, ())
            stops = ("ul", "ol", "dl", "table", "menu")
            for at in range(len(self.stack) - 1, -1, -1):  # an open paragraph ends here, and an item of the same list
                o = self.stack[at].name
                if o == "p" or o in closes:
                    self.cut(at)
                    if o != "p":
                        break
                elif o in stops or o not in INLINE and not closes:
                    break
        words: list[str] = []
        role = style = ""
        gone = declared = False
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    words += re.findall(r"[a-z0-9]+", _CAMEL.sub(" ", value).lower())
                elif key == "role":
                    role = value.strip().lower()
                elif key == "style":
                    style = value.replace(" ", "").lower()
                elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
                    gone = True
                elif key == "itemprop":
                    declared = value.strip().lower() == "articlebody"
        gone |= "display:none" in style or "visibility:hidden" in style or name in MUTE
        inside = max((o.rank for o in self.stack), default=NONE)
        rank, around = NONE, False
        if name not in ("html", "body"):
            own = [w for w in words if w != "header"] if inside >= MAIN or name == "header" and inside else words  # an article's own header is part of it
            around = named_around(own) or role in ROLES or name in AROUND and not (name == "header" and inside)
            if not around:
                rank = ARTICLE if name == "article" or role == "article" or declared else MAIN if name == "main" or role == "main" else CONTAINER if not inline and CONTENT & set(words) else NONE
        if rank >= MAIN or name == "h1" and not around:
            for o in self.stack:  # what holds an article is not around it; a form or header that holds the title may be the page's
                o.holds |= rank >= MAIN or o.name == "form"
        if inline and around:
            gone, around = True, False
        self.stack.append(_Open(name, around, rank, gone))

    def end(self, name: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            o = self.stack[at].name
            if o == name:
                self.cut(at)
                return
            if name in INLINE and o not in INLINE:
                return

    def blocks(self, html: str) -> list[Block]:
        last = 0
        for m in _MARK.finditer(html):
            if m.start() > last:
                self.add(html[last : m.start()])
            last = m.end()
            name = m["name"] or m["name2"]
            if not name:
                continue
            if m["end"] or m["end2"]:
                if name.lower() == "p" and not any(o.name == "p" for o in self.stack[-40:]):
                    self.flush()
                self.end(name.lower())
            else:
                attributes = m["attributes"] or m["attributes2"] or ""
                self.start(name.lower(), attributes)
        self.add(html[last:])
        self.flush()
        return [Block(text, rank, any(not o.holds for o in open_), linked, heading) for text, open_, rank, linked, heading in self.found]


def page_blocks(html: str | None) -> list[Block]:
    """The visible blocks of a page, in page order."""
    return _Page().blocks(html or "")


def content_rank(blocks: list[Block]) -> int:
    """By what the page declares its content: the strongest kind that has text."""
    return max((b.rank for b in blocks if not b.around), default=NONE)


def candidates(blocks: list[Block]) -> list[Block]:
    """The blocks that the markup leaves: all of the strongest kind and, if it has no first-level heading, those outside it."""
    rank, left = content_rank(blocks), [b for b in blocks if not b.around]
    if rank == NONE:
        return [b for b in left if 5 * b.linked <= 3 * len(b.text)] or left
    titled = any(b.heading for b in left if b.rank >= rank)
    return [b for b in left if b.rank >= rank or b.heading and not titled]


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.array([known[w] for w in words], np.uint64)


def suffix_keys(words: list[str], depth: int, host: int, known: dict[str, int]) -> np.ndarray:
    """For every token, the hash of the ``depth`` tokens from it on; a shorter stream has one, of all its tokens."""
    if not words:
        return np.zeros(0, np.uint64)
    h, n = _hashes(words, known), max(1, len(words) - depth + 1)
    total = np.full(n, (host ^ min(depth, len(words)) * 0x9E3779B97F4A7C15) & (2**64 - 1), np.uint64)
    for k in range(min(depth, len(words))):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
        total ^= total >> np.uint64(32)
    return total


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "", re.I)
    return m[1].lower() if m else ""


PARSED = T.StructType(
    [
        T.StructField("page_id", T.LongType()), string("url"), long("row"), long("host"), long("digest"), T.StructField("rank", T.IntegerType()),
        T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("own", T.ArrayType(T.LongType())),
        T.StructField("of_block", T.ArrayType(T.IntegerType())),
    ]
)


def _parsed(depth: int) -> Callable:
    """Candidate blocks of each page; ``keys``: its suffixes, once each; ``own``: those of the candidates, by block."""
    schema = to_arrow_schema(PARSED)

    def page(html: str | None, url: str | None, known: dict[str, int]) -> tuple:
        host = xxhash.xxh3_64_intdigest(_host(url))
        blocks = page_blocks(html)
        left, rank = candidates(blocks), content_rank(blocks)
        chosen = set(map(id, left))
        own, of_block = [], []
        for n, b in enumerate(left):
            keys = np.array([xxhash.xxh3_64_intdigest(b.text, host & 0xFFFFFFFF)], np.uint64) if rank >= MAIN else suffix_keys(b.text.split(), depth, host, known)
            own.append(keys)
            of_block.append(np.full(len(keys), n, np.int32))
        stream = [w for b in blocks if id(b) not in chosen for w in b.text.split()]
        mine = np.concatenate([*own, np.zeros(0, np.uint64)])
        keys = np.unique(np.concatenate([mine, suffix_keys(stream, depth, host, known)]))
        digest = xxhash.xxh3_64_intdigest("\n".join(b.text for b in left))
        signed = lambda x: np.array([x], np.uint64).view(np.int64)[0]
        return signed(host), signed(digest), rank, [b.text for b in left], keys.view(np.int64), mine.view(np.int64), np.concatenate([*of_block, np.zeros(0, np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part in text_slices(batch, 3):
                found = [page(h, u, known) for h, u in zip(part.column(3).to_pylist(), part.column(1).to_pylist())]
                if len(known) > 1_000_000:
                    known.clear()
                yield pa.RecordBatch.from_arrays(part.columns[:3] + [pa.array(c, t) for c, t in zip(zip(*found), schema.types[3:])], names=schema.names)
        release_memory()

    return run


def _shared(parsed: DataFrame, depth: int, prose: int, clear: int) -> DataFrame:
    """(row, places): of the candidates' suffixes, those that enough of the host's different pages share."""
    pages = parsed.count()
    hosts = parsed.groupBy("host").agg(F.count_distinct("digest").alias("of"), F.count("*").alias("n"))
    runs = parsed.select(F.explode("keys").alias("key"), "digest").groupBy("key").agg(F.count_distinct("digest").alias("has")).where("has > 1").withColumn("n", F.col("has"))
    words = F.size(F.split(F.element_at("blocks", F.element_at("of_block", F.col("place") + 1) + 1), " "))
    own = parsed.select("row", "host", "rank", "blocks", "of_block", F.posexplode("own").alias("place", "key"))
    own = own.select("row", "host", "rank", "place", "key", F.when(F.col("rank") < MAIN, words).alias("words"))
    met = join_grouped(join_grouped(own, runs, "key", "n", pages), hosts, "host", "n", pages)
    enough = (
        F.when(F.col("rank") >= MAIN, (F.col("has") >= clear) & (3 * F.col("has") >= 2 * F.col("of")))
        .when((F.col("rank") == CONTAINER) | (F.col("words") >= prose), 2 * F.col("has") > F.col("of"))
        .otherwise(20 * F.col("has") >= F.col("of"))
    )
    return met.where(enough).groupBy("row").agg(F.collect_list("place").alias("places"))  # bounded by a page's length


def _assembled(depth: int) -> Callable:
    """The blocks that shared runs don't cover, joined; all of them if none is left."""

    def text(blocks: list[str], rank: int, of_block: list[int], places: list[int] | None) -> str:
        if not places:
            return "\n".join(blocks)
        first, covered = np.searchsorted(of_block, np.arange(len(blocks))), set(places)
        kept = []
        for n, block in enumerate(blocks):
            size = 1 if rank >= MAIN else len(block.split())
            flags = np.zeros(size + depth, bool)
            for k in range(size):
                if first[n] + k in covered and first[n] + k < len(of_block) and of_block[first[n] + k] == n:
                    flags[k : k + depth] = True
            if 5 * flags[:size].sum() < 3 * size:
                kept.append(block)
        return "\n".join(kept or blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 3):
                found = pa.array(map(text, *(part.column(n).to_pylist() for n in (3, 2, 4, 5))), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], found], names=["page_id", "url", "text"])
        release_memory()

    return run


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = 6, prose: int = 40, clear: int = 6, broadcast_rows: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    ``depth`` is the length of a shared run in tokens. Pages of which shared
    runs are known meet them by a broadcast up to ``broadcast_rows`` of them,
    and by a shuffled join beyond.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("row"), F.col(html_col).alias("html"))
    path = new_path(spark, "parsed")
    with small_batches(spark):
        rows.mapInArrow(_parsed(depth), PARSED).write.option("compression", "zstd").parquet(path)  # whole texts, read twice
    parsed = spark.read.schema(PARSED).parquet(path)
    shared = written_texts(_shared(parsed, depth, prose, clear), "shared")
    small = shared.limit(broadcast_rows + 1).count() <= broadcast_rows
    met = parsed.join(F.broadcast(shared) if small else shared, "row", "left").select("page_id", "url", "rank", "blocks", "of_block", "places")
    with small_batches(spark):
        out = met.mapInArrow(_assembled(depth), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
