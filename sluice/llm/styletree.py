"""Main text of web pages by a site style tree.

The pages of a host are merged by where their elements stand: an element's path is the chain of its
ancestors' styles (tag, classes, id). For each path the host's pages give two distributions, of what
children stand there in which order (presentation) and of what text stands there and below (content). Their entropies, as shares of the
greatest possible, are the path's importance: menus, notices and footers look and read alike on many pages, articles differ.
Branches of low importance are cut from each page. Tags and names that say what they are (nav, footer, a class "ad", all outside a marked
article) are a prior, a factor below one on the importance; where a host has too few pages to tell, the prior decides alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from html import unescape
from types import MappingProxyType

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NUMBER = re.compile(r"[-_]?[0-9]+$")

# What HTML defines, fixed values.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
# Where the search for an element to close ends.
FENCE = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "main", "section", "div", "td", "th"}

#: Never text of an article.
DROPPED_TAGS = {"form", "button", "select", "dialog", "head", "object", "canvas", "audio", "video"}
FRAME_TAGS = {"nav", "footer", "aside", "menu"}
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "alert"}
FRAME_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "notice", "notices", "alert", "sidebar", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "footer", "header", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "widget", "pager", "pagination", "toolbar",
}
#: What is different on each page all the same, which no entropy tells from an article.
OWN_NAMES = {"comment", "comments", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended"}
LANDMARKS = {"article", "main"}
PAGE_TAGS = {"html", "body"}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"} | INLINE

#: Factors on the importance: elements whose tag or name is that of a page's frame, or what stands outside a marked article; elements with a name of
#: OWN_NAMES; and either on a host that has too few pages. LEAST is the importance that stays.
FRAME, OWN, FEW, LEAST = 0.45, 0.35, 0.3, 0.4
#: Tasks that one host's pages are dealt to.
SALTS = 64


@dataclass
class Block:
    """A run of text between block boundaries: its text, the paths around it with the kind of each (0 plain, 1 frame, 2 own), and whether it is dropped, outside the article, or unnamed."""

    text: str
    branch: tuple | None
    dropped: bool
    inside: bool
    named: bool

    def paths(self) -> Iterator[tuple[int, int]]:
        at = self.branch
        while at:
            yield at[1], at[2]
            at = at[0]


@dataclass
class _Open:
    tag: str
    path: int
    branch: tuple | None  # (branch above, path, kind)
    dropped: bool
    inside: bool
    named: bool
    counted: bool
    children: list
    texts: list


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _named(attrs: str) -> tuple[str, int, bool, bool]:
    """An element's style name from its classes and id; what kind a whole class or id (but for a number at its end) says it is; whether its role is of the frame; whether it is hidden."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    names = [_NUMBER.sub("", x) for x in f"{found.get('class', '')} {found.get('id', '')}".lower().split()]
    kind = 2 if not OWN_NAMES.isdisjoint(names) else 1 if not FRAME_NAMES.isdisjoint(names) else 0
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("role", "").lower() in ("form", "dialog")
    style = f"{'.'.join(sorted(found.get('class', '').lower().split()))}#{re.sub(r'[0-9]+', '0', found.get('id', ''))}"
    return style, kind, found.get("role", "").lower() in FRAME_ROLES, hidden


def parse(html: str | None) -> tuple[list[Block], dict[int, tuple[list[str], list[int]]]]:
    """All blocks of a page in order, and for each path the styles of its children and the hashes of its elements' texts, in order. In time linear in the page's length."""
    html = html or ""
    blocks: list[Block] = []
    found: dict[int, tuple[list[str], list[int]]] = {}
    stack = [_Open("", 0, None, False, False, False, False, [], [])]
    open_tags: Counter = Counter()
    held: list[str] = []
    seen: dict[str, tuple[str, int, bool, bool]] = {}

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(text, top.branch, top.dropped, top.inside, top.named))
                top.texts.append(_hash(text))

    def close(k: int) -> None:
        if any(e.tag not in INLINE for e in stack[k:]):
            flush()
        while len(stack) > k:
            e = stack.pop()
            open_tags[e.tag] -= 1
            if e.texts:  # an element's text is that of what stands in it
                whole = _hash(",".join(map(str, e.texts)))
                stack[-1].texts.append(whole)
                if e.counted:
                    styles, texts = found.setdefault(e.path, ([], []))
                    styles += e.children
                    texts.append(whole)

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if open_tags[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
            ends = CLOSED_BY_SAME.get(tag, {"p"} if tag not in VOID or tag == "hr" else set())
            if any(open_tags[t] for t in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        close(k)
                        break
                    if stack[k].tag in FENCE:
                        break
        if tag in VOID:
            continue
        attrs = m["attrs"]
        if attrs not in seen:
            seen[attrs] = _named(attrs) if attrs else ("#", 0, False, False)
        name, kind, frame, hidden = seen[attrs]
        up = stack[-1]
        if tag in LANDMARKS | PAGE_TAGS:
            kind = 0  # "has-sidebar", "menu": these tell of what else is on the page
        elif tag in FRAME_TAGS or frame or (tag == "header" and not up.inside):
            kind = max(kind, 1)
        style = f"{tag}.{name}"
        up.children.append(style)
        path = _hash(f"{up.path}/{style}")
        counted = tag not in PAGE_TAGS and not (tag in TEXT_TAGS and name == "#")
        branch = (up.branch, path, kind) if counted else up.branch
        stack.append(_Open(tag, path, branch, up.dropped or hidden or tag in DROPPED_TAGS, up.inside or tag in LANDMARKS, up.named or kind > 0, counted, [], []))
        open_tags[tag] += 1
    held.append(html[at:])
    flush()
    close(1)
    return blocks, found


def features(html: str | None) -> list[tuple[int, int, int]]:
    """(path, hash of its children's styles, hash of its text) of each path that a page has, once."""
    return [(p, _hash("/".join(styles)), _hash(",".join(map(str, texts)))) for p, (styles, texts) in parse(html)[1].items()]


def extract(html: str | None, importance: Mapping[int, float] = MappingProxyType({}), least: float = LEAST) -> str:
    """A page's main text: its blocks in which every branch around them has an importance of ``least`` or more, after the prior.

    ``importance``: of the paths on enough pages of the host. A page that would be left with nothing keeps what no name speaks against, or
    else all that is not dropped.
    """
    blocks = [b for b in parse(html)[0] if not b.dropped]
    marked = any(b.inside for b in blocks)
    memo: dict[int, float] = {}

    def of(branch: tuple | None) -> float:
        """The least importance of a branch and those above it."""
        chain = []
        while branch and id(branch) not in memo:
            chain.append(branch)
            branch = branch[0]
        low = memo[id(branch)] if branch else 1.0
        for b in reversed(chain):
            known = importance.get(b[1])
            low = min(low, (known or 0.0) * (1.0, FRAME, OWN)[b[2]] if known is not None else FEW if b[2] else 1.0)
            memo[id(b)] = low
        return low

    def stays(b: Block) -> bool:
        if marked and not b.inside:  # around an article that is marked
            known = [importance[p] for p, _ in b.paths() if p in importance]
            return bool(known) and min(known) * FRAME >= least and of(b.branch) >= least
        return of(b.branch) >= least

    kept = [b for b in blocks if stays(b)]
    plain = [b for b in blocks if not b.named and (b.inside or not marked)]
    return "\n".join(b.text for b in kept or plain or [b for b in blocks if b.inside] or blocks)


def host(url: Column) -> Column:
    """The host of a url in lower case, without user and port; empty for null or what is no url."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def importance(pages: DataFrame, presentation: float = 0.5) -> DataFrame:
    """(host, path, pages, importance) of each path of each host, from 0 (alike on all different pages) to 1 (different on each); 1 for a path on one page."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, page, [dict(zip(("path", "a", "b"), f, strict=True)) for f in features(html)]) for h, page, html in zip(batch["host"], batch["page"], batch["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["host", "page", "found"])

    read = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    read = read.mapInPandas(of, "host string, page long, found array<struct<path: long, a: long, b: long>>")
    # copies of a page are no evidence of a template: each different page counts once
    once = read.groupBy("host", "page").agg(F.first("found").alias("found")).select("host", F.inline("found"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("a").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("b").alias("value")))
    seen = once.select("host", "path", F.inline(kinds))
    # counts of each value first: a host with very many pages is spread over its values
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    of_kind = lambda k, c: F.sum(F.when(F.col("kind") == k, c))
    weigh = F.col("n") * F.log("n")
    sums = counts.groupBy("host", "path").agg(of_kind(1, F.col("n")).alias("pages"), of_kind(0, weigh).alias("a"), of_kind(1, weigh).alias("b"))
    entropy = lambda c: F.when(F.col("pages") > 1, 1 - F.col(c) / (F.col("pages") * F.log("pages"))).otherwise(F.lit(1.0))
    return sums.select("host", "path", "pages", (presentation * entropy("a") + (1 - presentation) * entropy("b")).alias("importance"))


def main_text(pages: DataFrame, least: float = LEAST, min_pages: int = 4) -> DataFrame:
    """page_id, url, text of each row of ``pages``.

    Branches whose importance is below ``least`` after the prior are cut; paths on fewer than ``min_pages`` different pages of a host have only the prior.
    Null html gives an empty text, as does a page without text; pages without a host are one host; repeated rows are pages of their own, but
    count once as evidence. Pages of any length and depth are read whole, in linear time. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    known = importance(pages).filter(F.col("pages") >= min_pages)
    by_host = known.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("known"))  # the paths of one site's pages

    @F.pandas_udf("string")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, paths in parts:
            yield pd.Series([extract(h, {} if p is None else {x["path"]: x["importance"] for x in p}, least) for h, p in zip(html, paths, strict=True)], dtype=object)

    # a host may have any share of the pages: its pages are dealt to SALTS tasks, each with its own copy of the host's paths
    salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["host", "salt"], "left").select("page_id", "url", of("html", "known").alias("text"))
