"""Main text of web pages: blocks by their place, and a suffix array per host.

A page is cut into blocks of text. The words of all its blocks are the page's stream; the
streams of a host are put one after the other, their suffixes sorted, and stretches that
stand on several of its pages are its boilerplate, except those that stand in an article of
one of them: text which an author repeats, on pages with an article and on copies of them
without, is not taken for boilerplate.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import stored
from letterloom.llm.lines import sieved
from letterloom.llm.periods import suffix_order

MIN_RUN = 8         # words (and block ends) of the shortest boilerplate
SLICE = 1 << 19     # words whose suffixes a task sorts together

# Places of a block: nothing known, in the main part, in an article, in a part that is none.
OPEN, MAIN, ARTICLE, ASIDE = range(4)
EDGE = "\n"

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
HIDDEN = frozenset("head template object svg canvas select datalist audio video map".split()) | RAW
APART = frozenset("nav header footer aside form menu dialog button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split())
# A new element of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in a class, an id or a role that name a part which is no main text.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs sidebar aside complementary footer contentinfo header masthead topbar comment comments "
    "respond disqus reply replies share sharing social related recommended teaser newsletter subscribe "
    "signup login search pagination pager toolbar dialog form hidden".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)
                       |(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)
                        (?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
                       |(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>
                       |[!?/][^>]*+(?:>|\Z))""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Parts that are apart even if they hold an article of their own; others give way to one.
FIRM_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsored promo sidebar aside comment comments respond disqus "
    "reply replies related recommended teaser hidden".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@lru_cache(1 << 16)
def _place(name: str, attributes: str) -> tuple[int, int]:
    """How far an element is apart from the main text (0: not, 1: unless an article begins
    in it, 2: in any case), and what it holds."""
    apart = 2 if name in HIDDEN or name in ("aside", "footer") else int(name in APART)
    holds = {"article": ARTICLE, "main": MAIN}.get(name, OPEN)
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), markup.unescape("".join(values))
        if (key == "hidden" or key == "aria-hidden" and value.lower() == "true"
                or key == "style" and "display:none" in value.replace(" ", "").lower()):
            apart = 2
        elif key in ("class", "id", "role") and name not in ("html", "body"):
            words = {w.lower() for w in WORD.findall(value)}
            if words & FIRM_WORDS:
                apart = 2
            elif words & APART_WORDS and not holds:
                apart = max(apart, 1)
        if key == "itemprop" and value.lower() == "articlebody" or key == "role" and value.lower() == "article":
            holds = ARTICLE
        elif key == "role" and value.lower() == "main":
            holds = max(holds, MAIN)
    return apart, holds


def blocks_of(page: str) -> list[tuple[int, str]]:
    """``(place, text)`` of every block of a page that has text, in page order.

    White space is one space inside a block and character references are decoded. Inline
    parts that are apart leave their block whole. Elements that are never closed and end
    tags that close nothing are no obstacle: an end tag closes what was opened since its
    start tag, an inline one never closes a block, and an article ends a menu around it.
    """
    out: list[tuple[int, str]] = []
    piece: list[str] = []
    opened: list[tuple[str, int, int, bool]] = []   # name, apart, holds, hidden
    count: dict[str, int] = {}
    apart, holds, hidden = 0, OPEN, False

    def flush() -> None:
        if piece:
            text = "".join(piece)
            piece.clear()
            text = " ".join((markup.unescape(text) if "&" in text else text).split())
            if text:
                out.append((ASIDE if apart else holds, text))

    def settle() -> None:
        nonlocal apart, holds, hidden
        _, now_apart, now_holds, hidden = opened[-1] if opened else ("", 0, OPEN, False)
        if (now_apart, now_holds) != (apart, holds):
            flush()
            apart, holds = now_apart, now_holds

    def close(names: set[str], inline: bool = False) -> None:
        """Closes up to the innermost open element of these names."""
        if not any(count.get(n) for n in names):
            return
        at = len(opened) - 1
        while opened[at][0] not in names:
            if inline and opened[at][0] in BLOCKS:
                return
            at -= 1
        for name, *_ in opened[at:]:
            count[name] -= 1
        del opened[at:]
        settle()

    at = 0
    for_text = lambda lo, hi: None if hidden or lo == hi else piece.append(page[lo:hi])
    while tag := TAG.search(page, at):
        for_text(at, tag.start())
        at = tag.end()
        name = tag["name"] or tag["name2"]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            if not hidden:
                piece.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if tag["end"] or tag["end2"]:
            close({name}, name not in BLOCKS)
            continue
        if name in VOID:
            continue
        attributes = tag["attrs"] or tag["attrs2"] or ""
        if name in RAW:
            found = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = found.start() if found else len(page)
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        if name in BLOCKS:
            if count.get("p") or count.get("head"):
                close({"p", "head"})
            if name in ENDS and opened and opened[-1][0] in ENDS[name]:
                close(ENDS[name])
        now_apart, now_holds = _place(name, attributes)
        inline = bool(now_apart) and name not in BLOCKS   # goes without ending its block
        within = 0 if now_holds and apart == 1 else apart
        opened.append((name, within if inline else max(within, now_apart), max(holds, now_holds),
                       hidden or inline or name in HIDDEN))
        count[name] = count.get(name, 0) + 1
        settle()
    for_text(at, len(page))
    flush()
    return out


def stream_of(blocks: list[tuple[int, str]]) -> list[str]:
    """The words of all blocks, an empty one before the first and after every block. Where
    an article begins or ends there is a word that no text has, so that a page without
    articles shares no stretch across that edge."""
    out = [""] if blocks else []
    for i, (place, text) in enumerate(blocks):
        if i and (place == ARTICLE) != (blocks[i - 1][0] == ARTICLE):
            out += [EDGE, ""]
        out += text.split(" ")
        out.append("")
    return out


def _removed(gone: np.ndarray, min_run: int) -> np.ndarray:
    """Of the marked words of a block those in stretches that fill it or have ``min_run``
    words: a word or two that follow a menu on two pages by chance stay."""
    if gone.all() or not gone.any():
        return gone
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(np.int8)))
    out = np.zeros(len(gone), bool)
    for lo, hi in zip(edges[::2], edges[1::2]):
        out[lo:hi] = hi - lo >= min_run
    return out


def decided_text(blocks: list[tuple[int, str]]) -> str | None:
    """Main text of a page whose elements tell it: its articles, or nothing if all of it is
    apart. None if what its host repeats has to tell."""
    places = {p for p, _ in blocks}
    if ARTICLE in places or not places & {OPEN, MAIN}:
        return "\n\n".join(t for p, t in blocks if p == ARTICLE)
    return None


def unique_text(blocks: list[tuple[int, str]], covered: np.ndarray, min_run: int = MIN_RUN) -> str:
    """Main text of a page without an article: what its host does not repeat.

    ``covered`` marks the words of the stream that stand on other pages of the host too, and
    in none of its articles.
    Blocks of them and long stretches go, the rest of a block stays. Of the rest nothing is
    from a part that is apart (menu, footer, ...), and if there is a main part, all is
    from that.
    """
    best = max((p for p, _ in blocks if p != ASIDE), default=OPEN)
    kept, at = [], 1
    for place, text in blocks:
        words = text.split(" ")
        gone = _removed(covered[at:at + len(words)], min_run)
        at += len(words) + 1
        if place == best and not gone.all():
            kept.append(text if not gone.any() else
                        " ".join(w for w, g in zip(words, gone.tolist()) if not g))
    return "\n\n".join(kept)


def _powers(base: int, n: int) -> np.ndarray:
    return np.array([pow(base, k, 1 << 64) for k in range(n)], np.uint64)


class _Numbers(dict):
    """A number for every word, in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Slice:
    """The streams of some pages one after the other as numbers of their words, with the
    host of every page."""

    def __init__(self, pages_of: list[list[tuple[int, str]]], hosts: list[str], min_run: int):
        self.min_run, self.names, self.hosts = min_run, _Numbers(), _Numbers()
        codes, begins = [], []
        end, edge = self.names[""], self.names[EDGE]
        for k, blocks in enumerate(pages_of):
            begins.append(len(codes))
            codes += map(self.names.__getitem__, stream_of(blocks))
            codes.append(-k - 1)
        self.codes = np.array(codes or [-1])
        self.begins = np.array(begins, np.int64)
        lengths = np.diff(np.append(self.begins, len(codes)))
        self.page = np.repeat(np.arange(len(pages_of)), lengths)
        self.host = np.array([self.hosts[h] for h in hosts], np.int64)[self.page]
        number = np.arange(len(self.page))
        self.starts = number[number + min_run < (self.begins + lengths)[self.page]]
        # Words outside articles before each place; the ends of blocks count on neither side.
        first = np.array([bool(b) and b[0][0] == ARTICLE for b in pages_of], bool)[self.page]
        words = self.codes[:len(self.page)]
        edges = np.cumsum(words == edge)
        within = (first + edges - edges[self.begins][self.page]) % 2 == 1
        self.apart = np.append(0, np.cumsum((words == edge) | (words != end) & ~within))

    def in_article(self, starts: np.ndarray) -> np.ndarray:
        return self.apart[starts + self.min_run] == self.apart[starts]

    def hashes(self, starts: np.ndarray, which: int) -> np.ndarray:
        """A hash of host and words of the stretches at ``starts``."""
        base = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[which]
        of_word = np.array([xxhash.xxh3_64_intdigest(w, which + 1) for w in self.names], np.uint64)
        of_host = np.array([xxhash.xxh3_64_intdigest(h, which + 3) for h in self.hosts], np.uint64)
        value = of_host[self.host[starts]]
        for k, power in enumerate(_powers(base, self.min_run)):
            value = value + of_word[self.codes[starts + k]] * power
        return value.view(np.int64)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The starts of stretches in groups of equal ones on one host, by sorted suffixes,
        and the bounds of the groups. Suffixes that are shorter are in no group."""
        if not len(self.starts):
            return self.starts, np.zeros(1, np.int64)
        rank, starts = suffix_order(self.codes, self.min_run)[1][-1], self.starts
        order = starts[np.lexsort((starts, self.host[starts], rank[starts]))]
        new = np.append(True, (rank[order][1:] != rank[order][:-1])
                        | (self.host[order][1:] != self.host[order][:-1]))
        return order, np.append(np.flatnonzero(new), len(order))


def page_key(host: Column, html: Column) -> Column:
    return F.xxhash64(host, html, F.char_length(html))


def host_of(url: Column) -> Column:
    """Host of an address in small letters; empty for null and for what is no address."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1),
                      F.lit(""))


def boilerplate(streams: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``(page, starts, ends, told_starts, told_ends)``: for every ``wanted`` page with
    stretches of its stream that stand on another page of its host, the first and the last
    of neighbouring starts of such stretches of ``min_run`` words, and the same for those of
    them that stand in an article of the host.

    ``streams`` has (host, page, blocks, wanted); rows with the same ``page`` are one page.
    Tasks sort the suffixes of the pages they read and send on one row for every group of
    equal beginnings, so a menu on all pages of a host is one row a task. Beginnings that no
    wanted page has fall at a sieve. Lowest and highest page of a beginning tell whether it
    is repeated; places are rows again only for those that are. Nothing is gathered by
    host, so a host of any size is spread.
    """
    place, size = pa.list_(pa.struct([("page", pa.int64()), ("at", pa.int32())])), SLICE

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, keys, blocks, wanted in _slices(batches, size):
            part = Slice(blocks, hosts, min_run)
            starts, bounds = part.groups()
            if not len(starts):
                continue
            firsts, page = starts[bounds[:-1]], np.array(keys, np.int64)[part.page[starts]]
            low, high = np.minimum.reduceat(page, bounds[:-1]), np.maximum.reduceat(page, bounds[:-1])
            told = np.logical_or.reduceat(part.in_article(starts), bounds[:-1])
            some = np.array(wanted, bool)[part.page[starts]]
            at = (starts - part.begins[part.page[starts]])[some].astype(np.int32)
            ends = np.append(0, np.cumsum(some))[bounds]
            places = pa.StructArray.from_arrays([pa.array(page[some]), pa.array(at)], ["page", "at"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.hashes(firsts, 0)), pa.array(part.hashes(firsts, 1)), pa.array(low),
                 pa.array(high), pa.array(told),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), places).cast(place)],
                ["h1", "h2", "low", "high", "told", "places"])

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, _, blocks, _ in _slices(batches, size):
            part = Slice(blocks, hosts, min_run)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(part.hashes(part.starts, 0)))], ["h1"])

    rows = streams.select("host", "page", "blocks", "wanted")
    groups = stored(sieved(
        rows.mapInArrow(sort, "h1 bigint, h2 bigint, low bigint, high bigint, told boolean, "
                              "places array<struct<page: bigint, at: int>>"),
        "h1", rows.where("wanted").mapInArrow(beginnings, "h1 bigint")), "suffixes")
    twice = groups.groupBy("h1", "h2").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("told").alias("told")).where(
        "low <> high").select("h1", "h2", "told")
    found = groups.where(F.size("places") > 0).drop("told").join(twice, ["h1", "h2"]).select(
        F.inline("places"), "told").groupBy("page").agg(  # the words of one page
        F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("told"), F.col("at"))).alias("told"))
    moved = lambda at, step: F.transform(at, lambda i: i + step)
    edge = lambda at, step: F.array_sort(F.array_except(at, moved(at, step)))
    return found.select("page", edge("at", 1).alias("starts"), edge("at", -1).alias("ends"),
                        edge("told", 1).alias("told_starts"), edge("told", -1).alias("told_ends"))


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, ...]]:
    """Hosts, keys, blocks and marks of the rows, about ``most`` words at a time."""
    columns: tuple[list, ...] = ([], [], [], [])
    size = 0
    for batch in batches:
        host, page, blocks, wanted = batch.columns
        for row in zip(host.to_pylist(), page.to_pylist(), _blocks_in(blocks), wanted.to_pylist()):
            for column, value in zip(columns, row):
                column.append(value)
            size += sum(text.count(" ") + 2 for _, text in row[2])
            if size > most:
                yield columns
                columns, size = ([], [], [], []), 0
    if columns[0]:
        yield columns


def covered_words(length: int, starts: list[int] | None, ends: list[int] | None, min_run: int) -> np.ndarray:
    """Marks of the words of a stream that the stretches of ``boilerplate`` cover."""
    change = np.zeros(length + 1, np.int64)
    for first, last in zip(starts or (), ends or ()):
        change[first] += 1
        change[last + min_run] -= 1
    return np.cumsum(change) > 0


def _block_lists(pages_of: list[list[tuple[int, str]]]) -> pa.ListArray:
    every = [b for blocks in pages_of for b in blocks]
    ends = np.append(0, np.cumsum([len(blocks) for blocks in pages_of]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array([p for p, _ in every], pa.int32()), pa.array([t for _, t in every], pa.string())],
        ["place", "text"]))


def _blocks_in(lists: pa.ListArray) -> Iterator[list[tuple[int, str]]]:
    every = lists.flatten()
    blocks = list(zip(every.field("place").to_pylist(), every.field("text").to_pylist()))
    ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).tolist()
    return (blocks[lo:hi] for lo, hi in zip(ends, ends[1:]))


def read_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages taken apart: the columns c0, c1, ... of ``pages`` but for ``html``, ``host``,
    ``page`` (the same for pages of equal html on one host), the ``blocks``, whether elements
    leave the text ``open``, and the ``stream``."""
    kept = [c for c in pages.columns if c != html]
    source = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)],
                          host_of(F.col(f"`{url}`")).alias("host"),
                          F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    source = source.withColumn("page", page_key(F.col("host"), F.col("html"))).select(
        *source.columns[:-1], "page", "html")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    names = source.columns[:-1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_of = [blocks_of(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], _block_lists(pages_of),
                 pa.array([decided_text(b) is None for b in pages_of], pa.bool_())],
                [*names, "blocks", "open"])

    told = lambda b: b.place == ARTICLE
    edge = lambda b, i: (i > 0) & (told(b) != told(F.get("blocks", i - 1)))
    words = F.flatten(F.transform("blocks", lambda b, i: F.concat(
        F.when(edge(b, i), F.array(F.lit(EDGE), F.lit(""))).otherwise(F.array().cast("array<string>")),
        F.split(b.text, " "), F.array(F.lit("")))))
    stream = F.when(F.size("blocks") > 0, F.concat(F.array(F.lit("")), words)).otherwise(words)
    return source.mapInArrow(read, f"{schema}blocks array<struct<place: int, text: string>>, open boolean"
                             ).withColumn("stream", stream)


def main_texts(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text",
               min_run: int = MIN_RUN) -> DataFrame:
    """``pages`` with ``out`` instead of ``html``: the main text of every page, blocks joined
    by two newlines, empty if there is none.

    Pages with an article consist of it; those without lose what their host repeats (on
    pages of both kinds) but for what stands in an article of the host. Null and empty pages
    have an empty text; pages without an address share one host. Pages of equal html on one
    host are one page, so copies do not make their own text boilerplate. Repeated rows have
    equal results, other columns stay as they are, one named ``out`` is replaced, an empty
    table gives an empty one, and pages of any length are taken whole.

    Pages are read once and their texts never shuffled, except the blocks of pages without
    an article, which meet the repeated stretches of their own page.
    """
    if out in pages.columns and out not in (url, html):
        pages = pages.drop(out)
    kept = [f for f in pages.schema.fields if f.name != html]
    names = [f"c{i}" for i in range(len(kept))]
    read = read_pages(pages, url, html)
    parts = stored(read.drop("stream"), "pages")
    covers = boilerplate(parts.withColumn("wanted", F.col("open")), min_run)
    open_pages = parts.where("open").join(covers, "page", "left").select(
        *names, "blocks", "starts", "ends", "told_starts", "told_ends")
    schema = "".join(f"`{n}` {f.dataType.simpleString()}, " for n, f in zip(names, kept))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, *edges in zip(_blocks_in(batch.column(len(names))),
                                      *[c.to_pylist() for c in batch.columns[-4:]]):
                length = len(stream_of(blocks))
                covered = covered_words(length, *edges[:2], min_run) & ~covered_words(length, *edges[2:], min_run)
                texts.append(unique_text(blocks, covered, min_run))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(texts, pa.string())],
                                             [*names, "text"])

    told = F.transform(F.filter("blocks", lambda b: b.place == ARTICLE), lambda b: b.text)
    done = parts.where("not open").select(*names, F.array_join(told, "\n\n").alias("text")).unionByName(
        open_pages.mapInArrow(extract, f"{schema}text string"))
    return done.toDF(*[f.name for f in kept], out)
