"""Main text of web pages: marked articles, and elsewhere what the pages of a host do not repeat."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.suffix_array import common_prefixes, suffix_array
from claimlens.llm.texts import mix, row_key, stored

RUN = 8
STREAM_TOKENS = 200_000
LONGEST_NAME = 1_000  # a longer tag name is no known name

# Elements by what they do to text.
RAW = ("script", "style", "template", "noscript", "iframe", "svg", "math")
FOREIGN = ("svg", "math")  # only these can be closed in their own tag
ASIDE = frozenset("nav header footer aside form select button textarea dialog menu head label fieldset "
                  "object audio video canvas".split())
MAIN = frozenset(("article", "main"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL = frozenset("p li dt dd option tr td th thead tbody tfoot colgroup".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent notice notices banner newsletter subscribe social "
    "share sharing related comment comments respond disqus popup modal footer masthead skip".split())
ASIDE_COMPOUNDS = frozenset(
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper google-ad google-ads adsbygoogle "
    "cookie-banner cookie-bar cookie-consent cookie-notice consent-banner consent-popup "
    "site-header site-footer page-footer footer-links site-nav site-navigation main-nav main-menu "
    "main-navigation nav-bar nav-links nav-menu post-navigation top-nav side-nav side-menu menu-item menu-items "
    "left-sidebar right-sidebar sidebar-left sidebar-right side-bar widget-area "
    "comment-list comment-form comments-area comments-section comment-section comment-respond disqus-thread "
    "related-articles related-content related-links related-posts related-stories "
    "share-bar share-button share-buttons share-links social-bar social-buttons social-icons social-links "
    "social-media social-share sharing-buttons newsletter-form newsletter-signup subscribe-form promo-banner "
    "promo-box sponsored-content modal-dialog skip-link skip-links skip-to-content".split())
# An article of its own in the markup that is none: cards and comments.
MAIN_ASIDE = frozenset("comment comments related ad promo comment-body related-article related-post".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_NAME_END = re.compile(r"[\s/>]")
_CLOSE = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>")
_SPECIAL = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_NAMES = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NUMBER = re.compile(r"-?[0-9][0-9x]*$")


def names_aside(name: str, numbered: bool = True) -> bool:
    """Whether a whole class or id is a name of furniture, with any number behind it (ad-2) if ``numbered``."""
    name = name.replace("_", "-")
    if numbered:
        name = _NUMBER.sub("", name)
    return name in ASIDE_NAMES or name in ASIDE_COMPOUNDS


def is_aside(tag: str, rest: str) -> bool:
    """Whether an element is page furniture by its name or by its role, a class or its id.

    Classes and ids count whole: no-sidebar and related-work are no furniture.  Ids of headings
    are made from their words and do not count.
    """
    if tag in ASIDE:
        return True
    if not rest or tag in ("html", "body") or tag in INLINE:
        return False
    for name, *values in _NAMES.findall(rest):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ASIDE_ROLES:
            return True
        if name not in ("class", "id"):
            continue
        if tag in MAIN:
            if not MAIN_ASIDE.isdisjoint(value.replace("_", "-").split()):
                return True
        elif name == "class":
            if any(map(names_aside, value.split())):
                return True
        elif tag not in HEADINGS and names_aside(value.strip(), numbered=tag != "section"):
            return True
    return False


class Closes:
    """Where tags of a page end: the first > outside of quotes.

    The first tag that never ends makes a table of all ends, from the last to the first, so
    that many such tags do not each walk through the page.
    """

    def __init__(self, page: str):
        self.page = page
        self.at: list[int] | None = None
        self.ends: list[int] = []

    def after(self, start: int) -> int:
        """Index of the > for attributes that begin at ``start``, -1 if there is none."""
        if self.at is None:
            found = _CLOSE.match(self.page, start)
            if found:
                return found.end() - 1
            self.fill()
        place = bisect_left(self.at, start)
        return self.ends[place] if place < len(self.at) else -1

    def fill(self) -> None:
        self.at = [m.start() for m in _SPECIAL.finditer(self.page)]
        self.ends = [-1] * len(self.at)
        later = {'"': len(self.at), "'": len(self.at)}
        for i in range(len(self.at) - 1, -1, -1):
            char = self.page[self.at[i]]
            if char == ">":
                self.ends[i] = self.at[i]
            else:
                behind = later[char] + 1
                self.ends[i] = self.ends[behind] if behind < len(self.at) else -1
                later[char] = i


def parts(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """(tag, whether it ends an element, its attributes) of tags and (None, False, text) of texts, in order.

    Comments, declarations and raw elements are left out.  A < that begins no whole tag is
    text.  One forward scan, also over tags, quotes and elements that are never closed.
    """
    closes, size, last = Closes(page), len(page), page.rfind(">")
    at = name_end = 0
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            yield None, False, page[at:end]
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if at > last:
            yield None, False, "<"
            at += 1
            continue
        begin = at + 2 if page.startswith("/", at + 1) else at + 1
        first = page[begin:begin + 1]
        if begin == at + 1 and first in ("!", "?"):
            at = page.find(">", begin) + 1
            continue
        if first.isascii() and first.isalpha():
            if name_end <= begin:
                name_end = _NAME_END.search(page, begin).start()
            tag = page[begin:name_end].lower() if name_end - begin <= LONGEST_NAME else ""
            if tag in _RAW_END and begin == at + 1:
                if tag in FOREIGN:
                    close = closes.after(name_end)
                    if close > 0 and page[close - 1] == "/":
                        at = close + 1
                        continue
                found = _RAW_END[tag].search(page, page.find(">", name_end) + 1)
                end = page.find(">", found.end()) if found else -1
                at = size if end < 0 else end + 1
                continue
            close = closes.after(name_end)
            if close >= 0:
                yield tag, begin == at + 2, page[name_end:close]
                at = close + 1
                continue
        yield None, False, "<"
        at += 1


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in an article, in page furniture) of the blocks of a page, in order.

    Elements that are left open end with the element around them.
    """
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    article = aside = False
    text: list[str] = []

    def end_block() -> None:
        if text:
            clean = " ".join(html.unescape("".join(text)).split())
            if clean:
                out.append((clean, article, aside))
            text.clear()

    for tag, ends, rest in parts(page):
        if tag is None:
            text.append(rest)
            continue
        if tag in INLINE:
            continue
        if tag == "br":
            text.append(" ")
            continue
        end_block()
        if tag in OPTIONAL and not ends and not is_aside(tag, rest):
            continue
        if ends:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    article, aside = stack[at][1:]
                    del stack[at:]
                    break
        elif tag not in VOID:
            stack.append((tag, article, aside))
            furniture = is_aside(tag, rest)
            if tag in MAIN and not furniture:
                # an article cannot lie in a menu that was left open
                article, aside = True, aside and article
            elif furniture:
                aside = True
    end_block()
    return out


def parsed(pages: DataFrame) -> DataFrame:
    """host, ``body`` (article blocks), ``rest`` (blocks outside), ``furniture`` (which of those are) and ``before``
    (how many article blocks come before each of them)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                body, rest, furniture, before = [], [], [], []
                for page in part.column("html").to_pylist():
                    own = blocks(page or "")
                    body.append([t for t, article, aside in own if article and not aside])
                    rest.append([t for t, article, aside in own if not article or aside])
                    furniture.append([aside for t, article, aside in own if not article or aside])
                    passed = accumulate(int(article and not aside) for t, article, aside in own)
                    before.append([n for n, (t, article, aside) in zip(passed, own, strict=True)
                                   if not article or aside])
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("id", "url", "key", "host")] + [
                        pa.array(body, pa.list_(pa.string())), pa.array(rest, pa.list_(pa.string())),
                        pa.array(furniture, pa.list_(pa.bool_())), pa.array(before, pa.list_(pa.int32()))],
                    names=["id", "url", "key", "host", "body", "rest", "furniture", "before"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.mapInArrow(work, f"id {kind}, url string, key long, host string, body array<string>, "
                                  "rest array<string>, furniture array<boolean>, before array<int>")


def grams(ranks: np.ndarray, run: int) -> np.ndarray:
    """Hashes of all runs of tokens (given as hashes)."""
    total = np.zeros(max(len(ranks) - run + 1, 0), np.uint64)
    for k in range(run if len(total) else 0):
        total = mix(total + ranks[k:len(ranks) - run + 1 + k])
    return total.view(np.int64)


def hashed(tokens: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)


def repeated_runs(pages: DataFrame, run: int) -> DataFrame:
    """(host, gram) of token runs that distinct pages of a host share.

    Each task concatenates its token streams per host and builds their suffix array, in which
    runs that recur are neighbours; what it sends on is one row for each distinct run, with
    the least and greatest page that has it, so a footer on every page of a hot host costs a row
    a task.  Hosts are never gathered: runs are dealt out by host and hash.
    """
    def settle(host: str | None, streams: list[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        flat = np.concatenate([s for _, s in streams])
        _, ranks = np.unique(flat, return_inverse=True)
        text: list[int] = []
        page: list[int] = []
        at = 0
        where: list[int] = []  # token of each symbol, -1 for the marks between streams
        for key, own in streams:
            text += (ranks[at:at + len(own)] + 1).tolist() + [0]
            page += [key] * (len(own) + 1)
            where += [*range(at, at + len(own)), -1]
            at += len(own)
        room = []  # tokens from here to the end of the stream
        left = 0
        for w in reversed(where):
            left = 0 if w < 0 else left + 1
            room.append(left)
        room.reverse()
        order = suffix_array(text)
        shared = common_prefixes(text, order)
        hashes = np.concatenate([np.append(grams(own, run), np.zeros(min(run - 1, len(own)), np.int64))
                                 for _, own in streams]).tolist()
        low = high = first = None
        for i, n in zip(order, shared, strict=True):
            if room[i] < run:
                continue
            if first is not None and n >= run and text_same(text, first, i, run):
                low, high = min(low, page[i]), max(high, page[i])
                continue
            if first is not None:
                yield host, hashes[where[first]], low, high
            first, low, high = i, page[i], page[i]
        if first is not None:
            yield host, hashes[where[first]], low, high

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        count = 0

        def close() -> pa.RecordBatch:
            rows = [r for host, streams in held.items() for r in settle(host, streams)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "gram", "low", "high"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("host", "key", "rest")]
            for host, key, rest in zip(*cols, strict=True):
                tokens = " ".join(rest).split()
                if len(tokens) < run:
                    continue
                held.setdefault(host, []).append((key, hashed(tokens)))
                count += len(tokens)
                if count > STREAM_TOKENS:
                    yield close()
                    held, count = {}, 0
        if held:
            yield close()

    found = pages.select("host", "key", "rest").mapInArrow(work, "host string, gram long, low long, high long")
    return found.groupBy("host", "gram").agg(F.min("low").alias("low"), F.max("high").alias("high")).where(
        "low != high").select("host", "gram")


def text_same(text: list[int], a: int, b: int, run: int) -> bool:
    return text[a:a + run] == text[b:b + run]


def covered(pages: DataFrame, shared: DataFrame, run: int) -> DataFrame:
    """(key, at): starts of shared runs in the token streams of pages."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("host", "key", "rest")]
            for host, key, rest in zip(*cols, strict=True):
                own = grams(hashed(" ".join(rest).split()), run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * len(own), pa.string()), pa.array([key] * len(own), pa.int64()),
                     pa.array(np.arange(len(own))), pa.array(own)], names=["host", "key", "at", "gram"])

    rows = pages.select("host", "key", "rest").mapInArrow(work, "host string, key long, at long, gram long")
    same = (rows["host"].eqNullSafe(shared["host"])) & (rows["gram"] == shared["gram"])
    return rows.join(shared, same, "left_semi").select("key", "at").distinct()


def unique_runs(body: list[str], rest: list[str], furniture: list[bool], before: list[int],
                starts: list[int] | None, run: int) -> str:
    """Article blocks and, in their places, blocks outside furniture without the tokens that shared runs cover."""
    drop = {i for a in starts or () for i in range(a, a + run)}
    out, at, done = [], 0, 0
    for text, aside, n in zip(rest, furniture, before, strict=True):
        out += body[done:n]
        done = n
        tokens = text.split()
        if not aside:
            left = " ".join(t for i, t in enumerate(tokens, at) if i not in drop)
            if left:
                out.append(left)
        at += len(tokens)
    return "\n\n".join(out + body[done:])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html",
            run: int = RUN) -> DataFrame:
    """``text`` and ``n_chars`` of every page's main text, beside its key and url.

    Blocks are paragraphs, headings, items and the like: references decoded, white space as one
    space, joined by two line ends.  Furniture by element, class, id or role is never text.  What
    an article (or main) element holds besides is text by its markup alone, also if other pages
    repeat it: near copies and quotes share runs with distinct articles, and are still articles.
    All other blocks, on pages with an article and without one, are left to the host: runs of
    ``run`` tokens that distinct pages of the host share are boilerplate, and the unique runs that
    remain are text, in their place among the article blocks.  Null and empty pages give an empty
    text; repeated rows give a row each and are one page; pages without a host are compared with
    each other.

    Pages are parsed once; only pages with such other blocks are joined with shared runs.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"),
                        F.col(markup).cast("string").alias("html"))
    rows = rows.withColumns({
        "key": row_key("id", "url", "html"),
        "host": F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))})
    found = stored(parsed(rows), "pages")
    shared = repeated_runs(found.where("size(rest) > 0"), run)
    opened = found.where("exists(furniture, f -> NOT f)")
    starts = covered(opened, stored(shared, "runs"), run).groupBy("key").agg(F.collect_list("at").alias("starts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("body", "rest", "furniture", "before", "starts")]
            texts = [unique_runs(*x, run) for x in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "body"])

    kind = found.schema["id"].dataType.simpleString()
    rest = opened.join(starts, "key", "left").select(
        "id", "url", "body", "rest", "furniture", "before", "starts").mapInArrow(
        assemble, f"id {kind}, url string, body string")
    closed = found.where("NOT exists(furniture, f -> NOT f)").select(
        "id", "url", F.array_join("body", "\n\n").alias("body"))
    return closed.union(rest).select(
        F.col("id").alias(page_id), F.col("url").alias(url), F.col("body").alias("text"),
        F.length("body").cast("long").alias("n_chars"))
