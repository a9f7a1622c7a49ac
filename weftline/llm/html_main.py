"""Main text of web pages: nearest-URL page differencing, with the page's own structure as a second witness.

Pages are sorted by host and URL path; each is compared with the pages before and after it on the same host. Their text
lines are aligned by longest common subsequence, and lines that a neighbour shares, such as menu entries or notices, are
deleted. Three things differencing alone gets wrong are set right by markup: boilerplate that differs from page to page
(adverts, menus drawn anew) goes by its element, a line inside the article stays although a neighbour has it too, and a
neighbour that shares every line is a copy of the page and says nothing. Where a class name may mean either, such as social-history,
differencing decides, inside the article as well.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|math|iframe|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|[^<]+|<",
    re.S | re.I,
)
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and the words in class, id or role that mark what is not the article.
_NOT_TEXT = frozenset("nav header footer aside form button select dialog menu head title label audio video canvas map".split())
_NOT_WORDS = frozenset(
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside "
    "comment comments respond replies cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related "
    "recommended widget toolbar pagination pager complementary contentinfo disqus".split()
)
#: Words that say nothing about what an element holds.
_NEUTRAL = frozenset("area block bottom box col column container content footer group header inner item left link links list outer panel row section slot text title top unit right wrap wrapper".split())
_KEEP = frozenset(("article", "main"))
#: Keys of pages, for each range, that are sampled to find where ranges begin.
RANGE_KEYS = 100
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Line:
    text: str
    article: bool  # inside an article or main element
    other: bool  # inside an element that is not the article's text
    open: bool  # inside an element whose class may mean either


def _class_marks(value: str) -> tuple[bool, bool]:
    """(names something other than text, may do so): all the words of one of its names are such words, or only some."""
    names = [[w for w in _SPLIT.split(x) if w] for x in value.split()]
    some = [x for x in names if not _NOT_WORDS.isdisjoint(x)]
    return any(all(w in _NOT_WORDS or w in _NEUTRAL or len(w) == 1 for w in x) for x in some), bool(some)


def _marks(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """(begins an article, begins something else, begins what may be something else) of an opening tag."""
    keep, other, either = name in _KEEP, name in _NOT_TEXT, False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                if name not in ("html", "body", "article", "main"):
                    sure, may = _class_marks(value)
                    other, either = other or sure, either or may
                keep |= key == "role" and value == "main"
            elif key == "itemprop":
                keep |= value == "articlebody"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                other = True
    return keep, other, either


def lines(page: str | None) -> list[Line]:
    """The page's blocks in order: character references decoded, white space runs one space, empty ones left out."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, article, other, either
    article = other = either = False
    buffer: list[str] = []

    def flush() -> None:
        if buffer and (text := " ".join(html.unescape("".join(buffer)).split())):
            out.append(Line(text, article, other, either))
        buffer.clear()

    for m in _TOKEN.finditer(page or ""):
        whole = m[0]
        name = (m[3] or m[6] or "").lower()
        if not name:
            if whole[0] != "<":
                buffer.append(whole)
            elif len(whole) == 1:
                buffer.append("&lt;")
            continue
        if name == "br":
            buffer.append(" ")
            continue
        closing = m[2] or m[5]
        if name in _BLOCK:
            flush()
        if closing:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if at is not None:
                del stack[at:]
        elif name not in _VOID and not (m[4] or m[7] or "").rstrip().endswith("/"):
            if name in ("p", "li") and stack and stack[-1][0] == name:
                stack.pop()  # the end tag may be left out
            keep, drop, may = _marks(name, m[4] or m[7] or "")
            # An article ends what an element around it that was never closed would still hold.
            stack.append((name, article or keep, drop or (other and name not in _KEEP), may or (either and name not in _KEEP)))
        was = (article, other, either)
        now = stack[-1][1:] if stack else (False, False, False)
        if was != now:
            flush()
            article, other, either = now
    flush()
    return out


def shared_lines(mine: list[str], theirs: list[str]) -> set[int]:
    """Places in `mine` of one longest common subsequence with `theirs` (Hunt and Szymanski's way)."""
    head = 0
    while head < len(mine) and head < len(theirs) and mine[head] == theirs[head]:
        head += 1
    tail = 0
    while tail < len(mine) - head and tail < len(theirs) - head and mine[-1 - tail] == theirs[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(mine) - tail, len(mine))}
    places: dict[str, list[int]] = {}
    for j in range(len(theirs) - tail - 1, head - 1, -1):
        places.setdefault(theirs[j], []).append(j)  # descending
    ends: list[int] = []  # smallest end of a common subsequence of each length
    links: list[tuple] = []
    for i in range(head, len(mine) - tail):
        for j in places.get(mine[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def main_text(own: list[Line], *neighbours: list[Line] | None) -> str:
    """The lines that are left, one \\n between: what markup rules out goes, then what a neighbour shares, unless it surely stands in the article.

    Pages with an article or main element give what is in it; others all lines that are left. A neighbour that shares all of
    what markup leaves of the page is a copy of it, not a witness.
    """
    shared: set[int] = set()
    texts = [x.text for x in own]
    for near in neighbours:
        found = shared_lines(texts, [x.text for x in near]) if near else set()
        if any(k not in found for k, x in enumerate(own) if not x.other):
            shared |= found
    kept = [x for k, x in enumerate(own) if not x.other and (k not in shared or x.article and not x.open)]
    if any(x.article and not x.other for x in own):
        kept = [x for x in kept if x.article]
    return "\n".join(x.text for x in kept)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    bare = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1)), F.regexp_extract(bare, r"^[^/?#]*(.*)$", 1)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars of every row of pages.

    A page's neighbours are the rows before and after it by host, path, id and content, if on the same host. Rows are dealt over
    ranges of that order, so a host may be of any size; the last row of a range goes along to the next range and the first one
    to the range before, so texts do not depend on the ranges. Pages move once, as they are, and each is parsed once. Null or empty html gives an
    empty text, null urls are one host, repeated rows are neighbours and each give a row. Other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    html_text = F.col(html_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"), F.xxhash64(html_text).alias("mark"), html_text.alias("html"))
    order = ["host", "path", "id", "mark"]
    # Ids travel through Python as text: beside a null, pandas would round large ones.
    asked = ["host", "path", F.col("id").cast("string"), "mark"]

    def key(h: str, p: str, i: int | None, m: int) -> tuple:
        return h, p, i is not None, i or 0, m

    # Where ranges begin: evenly over a sample of bounded size, a fixed number of keys a range.
    n_ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, pages.count() // (RANGE_KEYS * n_ranges))
    sample = rows.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).limit(4 * RANGE_KEYS * n_ranges)
    keys = sorted(key(*r) for r in sample.collect())
    begins = [keys[len(keys) * k // n_ranges] for k in range(1, n_ranges)] if keys else []
    narrow = rows.select(*order, _range_of(begins)(*asked).alias("r"))
    ends = narrow.groupBy("r").agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi")).orderBy("r").collect()  # a row a range
    also: dict[tuple, list[int]] = {}
    for one, two in zip(ends, ends[1:], strict=False):
        also.setdefault(key(*one["hi"]), []).append(two["r"])
        also.setdefault(key(*two["lo"]), []).append(one["r"])
    dealt = rows.select("*", F.posexplode(_range_of(begins, also)(*asked)).alias("copy", "r"))
    dealt = dealt.repartition(max(1, n_ranges // 2), "r").sortWithinPartitions("r", *order, "copy")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        before = row = None

        def done(after: tuple | None) -> None:
            if row is not None and not row[0]:
                near = [x[5] for x in (before, after) if x is not None and x[1:3] == row[1:3]]
                out.append((row[3], row[4], main_text(row[5], *near)))

        for batch in batches:
            for x in batch.itertuples(index=False):
                after = (x.copy > 0, x.r, x.host, x.id, x.url, lines(x.html))
                done(after)
                before, row = row, after
            yield pd.DataFrame(out, columns=["id", "url", "text"])
            out.clear()
        done(None)
        yield pd.DataFrame(out, columns=["id", "url", "text"])

    texts = dealt.select("copy", "r", "host", F.col("id").cast("string").alias("id"), "url", "html").mapInPandas(extract, "id string, url string, text string")
    return texts.select(F.col("id").cast("long").cast(pages.schema[id_col].dataType).alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def _range_of(begins: list[tuple], also: dict[tuple, list[int]] | None = None):
    """A function of host, path, id and mark: the number of the row's range, or an array of that and the ranges it goes along to."""

    def numbers(host: pd.Series, path: pd.Series, id: pd.Series, mark: pd.Series) -> list[tuple[tuple, int]]:
        keys = [(h, p, i is not None, int(i or 0), int(m)) for h, p, i, m in zip(host, path, id, mark, strict=True)]
        return [(k, bisect_right(begins, k)) for k in keys]

    if also is None:

        @F.pandas_udf("int")
        def own(host: pd.Series, path: pd.Series, id: pd.Series, mark: pd.Series) -> pd.Series:
            return pd.Series([n for _, n in numbers(host, path, id, mark)], dtype="int32")

        return own

    @F.pandas_udf("array<int>")
    def all_of(host: pd.Series, path: pd.Series, id: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series([[n, *also.get(k, ())] for k, n in numbers(host, path, id, mark)], dtype=object)

    return all_of
