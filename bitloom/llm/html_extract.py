"""Main text of web pages: page structure where a page has it, else what its host's suffix array leaves.

A page with text in an ``article`` or ``main`` element has its main text there; menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are left out by element, role, class and id. Repeats
inside an article are its own text (the same article can stand under two addresses of a host, and articles share
passages), so they stay.

All other pages are judged by the suffix array of their host, cut at ``LEAST`` tokens: the token streams of what stands
outside the articles of all the host's pages, those with an article included, give one suffix for every token, and
suffixes are told apart by their first ``LEAST`` tokens. Intervals of equal suffixes that begin in several distinct
pages are boilerplate; the tokens that they cover go, and the unique runs stay. The array is a distributed table:
suffixes are grouped by (host, tokens), combined before the shuffle, so no task holds a host. A small bit filter of the
repeated suffixes goes to the pages, each posts those of its suffixes that pass, an exact join decides, and the places
go back to the page. Suffixes are compared as hashes of 64 bits with A-Z lower-cased.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
order by one space. Defined results: null or empty html has the empty text; elements that are never closed end with
the page; a ``<`` that no ``>`` follows before the next ``<`` is text; of several articles the one with most text
counts, the first of equals; a null url is the host ''; repeated rows get equal results and count as one page; an
empty table gives an empty result; columns beside the named ones are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import staged
from bitloom.llm.jaccard_join import word_hashes
from bitloom.llm.packed import mix64, starts_to_ranges, text_bytes, tidy
from bitloom.llm.url_filter import host_of

LEAST = 8
#: Bits of the filter of repeated suffixes, a power of two: 1 MB, whatever their number.
FILTER_BITS = 1 << 23
#: Pages that a kernel takes at once.
_SLICE = 256
#: A suffix of the array is posted by many pages if it is common; its group is split so many times in the join.
_SALT = 16
#: Covers of so many bytes in memory at most are broadcast.
_SMALL = 4 << 20

# quoted values are bounded and nothing is read twice, so hostile pages take linear time
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^\"'<>]++|\"[^\"]{0,4000}\"|'[^']{0,4000}')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_GONE = {"nav", "aside", "footer", "form", "head", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "fieldset", "label", "option", "datalist"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_GONE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "note", "status"}
#: Words of class and id values that name what is not the main text.
_GONE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "comment", "comments", "commentlist", "respond", "replies", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "widget", "popup", "modal", "overlay", "pagination", "pager", "toolbar", "skip", "hidden", "disclaimer"}
_OUTSIDE_WORDS = {"header", "masthead", "topbar", "top"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _gone(name: str, attrs: str, inside: bool) -> bool:
    if name in _GONE or name == "header" and not inside:
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            words = set(re.split(r"[\s_\-:]+", value))
            if words & _GONE_WORDS or not inside and words & _OUTSIDE_WORDS:
                return True
        elif key == "role" and value in _GONE_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> tuple[list[list[str]], list[str], list[str]]:
    """Blocks of each article or main element, of everything else that isn't left out, and of what is left out."""
    mains: list[list[str]] = []
    rest: list[str] = []
    gone: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, left out, index of the article or -1
    opened: Counter[str] = Counter()
    run: list[str] = []
    lost: list[str] = []
    out, article = False, -1

    def flush() -> None:
        for held, found in ((run, mains[article] if article >= 0 else rest), (lost, gone)):
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                held.clear()
                if text:
                    found.append(text)

    def close() -> str:
        nonlocal out, article
        name = stack.pop()[0]
        opened[name] -= 1
        out, article = (stack[-1][1], stack[-1][2]) if stack else (False, -1)
        return name

    at = 0
    find = _TOKEN.search
    while True:
        m = find(page, at)
        if m is None:
            (lost if out else run).append(page[at:])
            break
        if m.start() > at:
            (lost if out else run).append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name not in _INLINE:
            flush()
        if closing:
            if opened[name] > 0:
                while close() != name:
                    pass
            continue
        if name in _RAW:
            if not attrs.rstrip().endswith("/") or name != "svg":
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        if name in _CLOSES and stack and stack[-1][0] in _CLOSES[name]:
            close()
        inside = article >= 0
        before = out
        out = out or _gone(name, attrs, inside)
        role = "main" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I)
        if not out and (name == "article" or not inside and (name == "main" or role)):
            if not inside or stack[-1][0] in ("main", "div", "section") and not opened["article"]:
                mains.append([])
                article = len(mains) - 1
        if not attrs.rstrip().endswith("/") or name not in _INLINE:
            stack.append((name, out, article))
            opened[name] += 1
        else:
            out = before
    flush()
    return mains, rest, gone


def regions(page: str | None) -> tuple[list[str], list[str], list[str]]:
    """Blocks of the article with most text (none if no article has text), of the rest, and of all that is left out."""
    mains, rest, gone = blocks(page or "")
    return max(mains, key=lambda m: sum(map(len, m)), default=[]), rest, gone


def suffixes(streams: list[list[str]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first `least` tokens of every suffix that has so many, the stream it is of, and its place there."""
    data, offsets = text_bytes(pa.array([" ".join(s) for s in streams], pa.large_string()))
    words, first = word_hashes(data, offsets)
    n = max(len(words) - least + 1, 0)
    every = np.zeros(n, np.uint64)
    for k in range(least if n else 0):
        every = mix64(every * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    count = np.maximum(np.diff(first) - least + 1, 0)
    at = starts_to_ranges(first[:-1], count)
    return every[at], np.repeat(np.arange(len(streams)), count), at - np.repeat(first[:-1], count)


def _with_host(hashes: np.ndarray, host: np.ndarray) -> np.ndarray:
    return mix64(hashes ^ host.view(np.uint64)).view(np.int64)


@tidy
def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(suffix, page) for all that stands outside the main text; rows are html, host, key."""
    for b in batches:
        for lo in range(0, b.num_rows, _SLICE):
            part = b.slice(lo, _SLICE)
            host, key = part.column(1).to_numpy(), part.column(2).to_numpy()
            outside = [x for page in part.column(0).to_pylist() for x in regions(page)[1:]]
            hashes, stream, _ = suffixes(outside)
            found = np.unique(np.stack([_with_host(hashes, host[stream // 2]), key[stream // 2]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["suffix", "page"])


def _look_up(bits):
    """(suffix, page, place) of the suffixes of pages without main text that pass the filter."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(bits.value, np.uint64)
        for b in batches:
            for lo in range(0, b.num_rows, _SLICE):
                part = b.slice(lo, _SLICE)
                host, key = part.column(1).to_numpy(), part.column(2).to_numpy()
                parsed = [regions(page) for page in part.column(0).to_pylist()]
                hashes, stream, place = suffixes([[] if main else rest for main, rest, _ in parsed])
                mine = _with_host(hashes, host[stream])
                slot = mine & (FILTER_BITS - 1)
                maybe = (words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)) == 1
                yield pa.RecordBatch.from_arrays([pa.array(mine[maybe]), pa.array(key[stream[maybe]]), pa.array(place[maybe].astype(np.int32))], ["suffix", "page", "place"])

    return run


def unique_runs(words: list[str], places: list[int], least: int = LEAST) -> str:
    """Tokens that no repeated suffix covers."""
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.array(places, np.int64), 1)
    np.add.at(cover, np.array(places, np.int64) + least, -1)
    return " ".join(w for w, c in zip(words, np.cumsum(cover).tolist()) if not c)


@tidy
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, text from page_id, url, html, places."""
    for b in batches:
        for lo in range(0, b.num_rows, _SLICE):
            part = b.slice(lo, _SLICE)
            text = []
            for page, places in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                main, rest, _ = regions(page)
                words = [w for x in rest for w in x.split(" ")]
                text.append(" ".join(main) if main else unique_runs(words, places or []))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])


def _filter(repeated: DataFrame) -> bytes:
    """The bit filter of the suffixes, put together in the cluster: FILTER_BITS / 64 rows at most reach the driver."""
    slot = F.col("suffix").bitwiseAND(FILTER_BITS - 1)
    words = repeated.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(suffix & 63 as int))")).alias("v")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return bits.tobytes()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", array: bool = True) -> DataFrame:
    """page_id, url and text for each row of pages; without the array pages without main text keep all their rest."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    key = F.xxhash64("page_id", "url", "html")
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
    if not array:
        return rows.select("*", F.lit(None).cast("array<int>").alias("places")).mapInArrow(_texts, schema)
    read = rows.select("html", F.xxhash64(host_of(F.col("url"))).alias("host"), key.alias("key"))
    posts = read.mapInArrow(_post, "suffix bigint, page bigint").groupBy("suffix").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    repeated = staged(posts.where("lo < hi").select("suffix"), "repeats")
    bits = pages.sparkSession.sparkContext.broadcast(_filter(repeated))
    asked = read.mapInArrow(_look_up(bits), "suffix bigint, page bigint, place int").withColumn("salt", F.pmod("page", F.lit(_SALT)))
    # the planner goes by the size of the file and would broadcast, through the driver, what is _SALT times as much
    known = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1)).cast("array<bigint>"))).hint("merge")
    # written first, so that where few pages have a cover the pages are not exchanged for them
    covers = staged(asked.join(known, ["suffix", "salt"]).groupBy("page").agg(F.collect_set("place").alias("places")), "covers")
    held = covers.agg(F.sum(64 + 4 * F.size("places"))).first()[0] or 0  # a file of places is far smaller than they are in memory
    covers = F.broadcast(covers) if held <= _SMALL else covers.hint("merge")
    return rows.withColumn("key", key).join(covers, F.col("key") == F.col("page"), "left").select("page_id", "url", "html", "places").mapInArrow(_texts, schema)


def op2(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
