"""Main text of web pages: subtrees that recur across a host's pages are its template and go.

1. Every page is read once and each of its elements gets a hash of its subtree (tag names and
   text; attributes, scripts and comments do not enter it).
2. Spark counts per host and hash the differing pages that hold it. Pages differ when their longest
   blocks of text differ, so a thousand copies of one article count once and stay. A subtree is part
   of the template when it is on at least ``max(MIN_PAGES, sqrt(pages of the host))`` of them.
3. Every page gets the list of its own template hashes and is read again: those subtrees are
   deleted. Running text inside ``article`` or ``main`` (paragraphs, headings, quotations, tables) is
   never a template: an article may quote a passage that a thousand others quote.
4. Elements that say what they are (``nav``, ``form``, a class or role such as ``sidebar``,
   ``comments``, ``cookie``) go as well, on hosts with few pages too. If an ``article`` or ``main`` is
   left, its text is the result, else that of the whole body.

Character references are decoded, white space inside a block becomes one space, blocks are joined
in page order by one space.

Defined results: a null or empty html gives an empty text; a null url, or one without a host, has
no template (step 4 alone decides); markup that never closes ends with its parent or the page;
repeated rows give repeated rows; an empty table gives no rows; all columns of ``pages`` travel in one
struct, so no name can clash. A page is handled whole, whatever its length or depth.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ._common import packed, stored

#: A template is on at least this many differing pages of its host.
MIN_PAGES = 5

# HTML element kinds and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: An opening tag ends these open elements, up to the nearest of the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
#: An end tag does not reach past these.
FENCES = frozenset("table td th article main body html".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table dl figcaption".split())
ROOTS = frozenset("article main".split())
NEVER = frozenset("html body".split()) | ROOTS
DROPPED = frozenset(
    "head nav footer aside form button select datalist fieldset legend dialog menu canvas object audio video map".split()
)
NAMES = frozenset(
    "ad ads adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "submenu breadcrumb breadcrumbs masthead sidebar widget widgets footer comment comments commentlist replies respond disqus "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup signin "
    "login search searchbox share sharing social related recommended recommendations pagination pager toolbar skip "
    "contentinfo complementary alertdialog paywall".split()
)
#: Of these, the ones that tell an ``article`` element that is a reader's comment or a teaser.
ARTICLE_NAMES = frozenset("ad ads advert advertisement comment comments promo related recommended replies sponsored".split())
#: Class names that tell what a page has beside the element.
TRAITS = ("has-", "no-", "with-", "without-")

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_BREAK = "\n"


def _named(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's name and attributes say that it is no part of the article, or hide it."""
    named = tag in DROPPED
    if not attributes or attributes.isspace():
        return named, False
    hidden = False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            names = ARTICLE_NAMES if tag == "article" else NAMES
            named = named or any(not names.isdisjoint(NAME.findall(n)) for n in value.split() if not n.startswith(TRAITS))
        elif key == "hidden":
            hidden = hidden or value != "until-found"
        elif key == "aria-hidden":
            hidden = hidden or value == "true"
        else:
            hidden = hidden or bool(_HIDDEN.search(value))
    return named, hidden


class _Open:
    """An element that is not closed yet."""

    __slots__ = ("tag", "start", "parts", "named", "hidden", "holds_root", "prose", "in_root")

    def __init__(self, tag: str, start: int, named: bool, hidden: bool, in_root: bool):
        self.tag, self.start, self.named, self.hidden, self.in_root = tag, start, named, hidden, in_root
        self.parts: list[str] = []
        self.holds_root = tag in ("main", "h1")
        self.prose = tag in PROSE


class Page:
    """One pass over a page: its subtree hashes, and the text without the subtrees in ``template``."""

    def __init__(self, source: str | None, template: frozenset[int] = frozenset()):
        self.template = template
        self.out: list[str] = []
        self.hashes: set[int] = set()
        self.roots: list[tuple[int, int, str]] = []
        self.open = [_Open("", 0, False, False, False)]
        self._read(source or "")
        while len(self.open) > 1:
            self._close()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = TOKEN.search(source, at)
            if found is None:
                self._text(source[at:])
                return
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            slash, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if tag is None:
                continue
            tag = tag.lower()
            if slash:
                self._end(tag)
            elif tag in RAW:
                if not attributes.endswith("/") or tag not in ("svg", "math"):
                    closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = closing.end() if closing else end
            else:
                self._start(tag, attributes)

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.out.append(text)
        words = " ".join(text.split())
        if words:
            self.open[-1].parts.append(words)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.out.append(_BREAK)
            return
        if tag in CLOSES_P:
            self._close_open(frozenset(["p"]), FENCES | frozenset(["button"]))
        if tag in ENDS:
            while self._close_open(*ENDS[tag]):
                pass
        if tag not in INLINE:
            self.out.append(_BREAK)
        parent = self.open[-1]
        named, hidden = _named(tag, attributes)
        self.open.append(_Open(tag, len(self.out), named, hidden, parent.in_root or parent.tag in ROOTS))

    def _close_open(self, tags: frozenset[str], stop: frozenset[str]) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                while len(self.open) > i:
                    self._close()
                return True
            if self.open[i].tag in stop:
                return False
        return False

    def _end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            held = self.open[i].tag
            if held == tag:
                while len(self.open) > i:
                    self._close()
                return
            if held in FENCES and tag not in FENCES:
                return

    def _close(self) -> None:
        e = self.open.pop()
        parent = self.open[-1]
        if e.tag in INLINE:
            gone = e.hidden or (e.named and not e.holds_root)
            if gone:
                self._delete(e.start)
            else:
                parent.parts.extend(e.parts)
                parent.holds_root |= e.holds_root
                parent.prose |= e.prose
            return
        digest = xxhash.xxh64_intdigest("\x00".join([e.tag, *e.parts]).encode("utf-8", "surrogatepass")) >> 1
        gone = e.hidden or (e.named and not e.holds_root and e.tag not in ("html", "body", "main"))
        if e.parts and e.tag not in NEVER and not e.holds_root and not (e.in_root and e.prose):
            self.hashes.add(digest)
            gone = gone or digest in self.template
        if e.parts:
            parent.parts.append(f"\x01{digest:x}")
        if gone:
            self._delete(e.start)
        else:
            parent.holds_root |= e.holds_root
            parent.prose |= e.prose
            if e.tag in ROOTS:
                self.roots.append((e.start, len(self.out), e.tag))
        self.out.append(_BREAK)

    def _delete(self, start: int) -> None:
        del self.out[start:]
        while self.roots and self.roots[-1][0] >= start:
            self.roots.pop()

    def text(self) -> str:
        """The main text: of ``main``, else of the articles, else of all that is left."""
        for tag in ("main", "article"):
            spans = sorted(s for s in self.roots if s[2] == tag)
            pieces, done = [], -1
            for start, end, _ in spans:
                if start >= done:
                    pieces += [_BREAK, *self.out[start:end]]
                    done = end
            text = " ".join("".join(pieces).split())
            if text:
                return text
        return " ".join("".join(self.out).split())

    def longest_block(self) -> str:
        blocks = "".join(_BREAK if p == _BREAK else " ".join(p.split()) + " " for p in self.out).split(_BREAK)
        return max(blocks, key=lambda b: (len(b), b), default="")


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pages = [Page(h) for h in batch["html"]]
        yield pd.DataFrame(
            {
                "uid": batch["uid"],
                "host": batch["host"],
                "shape": [xxhash.xxh64_intdigest(p.longest_block().encode("utf-8", "surrogatepass")) >> 1 for p in pages],
                "hashes": [sorted(p.hashes) for p in pages],
            }
        )


def _main_text(source: pd.Series, template: pd.Series) -> pd.Series:
    return pd.Series([Page(h, frozenset(() if t is None else t)).text() for h, t in zip(source, template)], dtype=object)


def page_templates(keyed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``keyed(uid, host, html)`` -> ``uid`` and ``template``, the hashes of its subtrees that recur on its host."""
    schema = "uid binary, host long, shape long, hashes array<long>"
    parsed = stored(keyed.where("host IS NOT NULL").mapInPandas(_subtrees, schema), "subtrees")
    seen = parsed.select("host", "shape", F.explode("hashes").alias("hash"))
    on_pages = seen.distinct().groupBy("host", "hash").agg(F.count("*").alias("pages"))
    of_host = parsed.select("host", "shape").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    enough = F.col("pages") >= F.greatest(F.lit(float(min_pages)), F.sqrt("host_pages"))
    template = on_pages.join(of_host, "host").where(enough).select("host", "hash")
    own = parsed.select("uid", "host", F.explode("hashes").alias("hash"))
    return own.join(template, ["host", "hash"]).groupBy("uid").agg(F.collect_set("hash").alias("template"))


def main_text(
    pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, out: str = "text"
) -> DataFrame:
    """All columns of ``pages`` and ``out``, the main text of each page."""
    if out in pages.columns:
        raise ValueError(f"column {out!r} is there already: name another")
    site, source = host(F.col(url)), F.coalesce(F.col(html), F.lit(""))
    uid = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(url), F.lit("")), source).cast("binary")))
    rows = spread(packed(pages, uid=uid, host=F.when(site.isNotNull(), F.xxhash64(site))))
    source = F.coalesce(F.col("row").getField(html), F.lit(""))
    templates = page_templates(rows.select("uid", "host", source.alias("html")), min_pages)
    read = rows.join(templates, "uid", "left").withColumn("main_text", F.pandas_udf(_main_text, "string")(source, "template"))
    columns = [F.col("row").getField(c).alias(c) for c in pages.columns]
    return read.select(*columns, F.col("main_text").alias(out))
