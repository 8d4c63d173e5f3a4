"""Main text of web pages by consensus of each host's pages on a container path.

Every page is read for its containers: paths of generalised tags and classes,
and the blocks of text inside, without what lies in menus, forms and the like.
A page votes for the path of the container that looks most like its article; the
votes of a host are counted in Spark (summed before they are shuffled), and all
pages of the host are extracted anew by the path most of them name. A page that
lacks the path, or has less text there than in its own best container, falls
back on that one. A page without an article or main element has no container
known to hold the article, so all it shows outside what is left out is taken.

The pages are not shuffled by the votes: the winning paths, one row for each
host, are a written table of known size that Catalyst broadcasts while it is
small; beyond that the join is by host, where AQE splits a host with very many
pages.

Defined cases: null or empty html has the empty text. A null url, or one without
a host, belongs to the host named by the empty string. Repeated rows vote each
and are extracted each. Ties between paths go to the path first by code point.
Unclosed elements end where their parent ends.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.llm.common import map_texts, store

# Elements that end a block of text, those that hold none of the
# article, those without content, and those whose content is not markup.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section"
    " summary table tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe label menu nav noscript object script"
    " select style svg template textarea title video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
CONTAINERS = frozenset("article main section div body td".split())
#: Elements left out that hold a whole page at times.
WRAPPERS = frozenset("aside form header".split())
#: Classes or ids, as a whole, that mark what is not the article.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice outbrain pagination"
    " popup promo related share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar"
    " widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu".split())
#: Elements an opening tag closes implicitly when one is open.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
          "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?][^>]*>", re.S
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Container(NamedTuple):
    path: str
    tag: str
    start: int  # first block inside
    end: int  # one past the last


def _named(attributes: str) -> tuple[str, bool]:
    """The generalised classes of an element, and whether its names are unwanted ones."""
    classes, unwanted = "", False
    for kind, *values in _NAMES.findall(attributes):
        value = next((v for v in values if v), "")
        if kind.lower() == "role":
            unwanted |= value.strip().lower() in ROLES
            continue
        unwanted |= not UNWANTED.isdisjoint(value.lower().split())
        if kind.lower() == "class":
            classes = ".".join(sorted(set(re.sub(r"[0-9]+", "#", value.lower()).split())))
    return classes, unwanted


def read_page(html: str, wanted: frozenset[int] = frozenset()) -> tuple[list[str], list[Container]]:
    """The blocks of text a page shows outside what is left out, and its containers.

    What its name, role or tag would leave out, but holds an article or main with
    more text than those shown, or without any of those most of the page's text, is
    read again as ``wanted`` (places of opening tags).
    """
    doubted: dict[int, list] = {}  # by place: characters inside, whether an article is
    blocks: list[str] = []
    done: list[Container] = []
    stack: list[tuple[str, str, int, int, int]] = []  # tag, path, first block, left out, place
    pieces: list[str] = []
    hidden = 0  # 1: by what is doubted, 2: for sure
    aside = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(text)
            pieces.clear()

    def close(depth: int) -> None:
        nonlocal hidden
        while len(stack) > depth:
            tag, path, start, *_ = stack.pop()
            if tag in CONTAINERS and not hidden:
                done.append(Container(path, tag, start, len(blocks)))
            hidden = stack[-1][3] if stack else 0

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        upto = m.start() if m else size
        if upto > at and not hidden:
            text = html[at:upto]
            pieces.append(unescape(text) if "&" in text else text)
        elif upto > at and hidden == 1:
            size_in = len(" ".join(html[at:upto].split()))
            aside += size_in
            for entry in stack:
                if entry[4] in doubted:
                    doubted[entry[4]][0] += size_in
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    flush() if tag in BLOCKS or not hidden else None
                    close(depth)
                    break
                # an inline end tag does not close blocks around it
                if tag not in BLOCKS and stack[depth][0] in BLOCKS:
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag == "br":
            if not hidden:
                pieces.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        attributes = m.group(3)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if tag in BLOCKS:
                flush()
            elif not hidden:
                pieces.append(" ")
            # foreign content may end in its own tag
            if not (tag == "svg" and attributes.endswith("/")):
                at = end.end() if end else size
            continue
        block = tag in BLOCKS
        classes, unwanted = _named(attributes) if attributes else ("", False)
        # the page itself is never left out by what it is called
        out = 0
        if tag in LEFT_OUT or (unwanted and tag not in ("html", "body", "article", "main")):
            out = 1 if tag in WRAPPERS or tag not in LEFT_OUT else 2
            if out == 1 and m.start() in wanted:
                out = 0
        if not block and not out:
            continue
        if block:
            flush()
            implied = CLOSES.get(tag) or {"p"}
            while stack and stack[-1][0] in implied:
                close(len(stack) - 1)
        if attributes.endswith("/") and not block:
            continue
        step = f"{tag}.{classes}" if classes else tag
        path = f"{stack[-1][1]}/{step}" if stack else step
        if tag in ("article", "main") and hidden == 1:
            for entry in stack:
                if entry[4] in doubted:
                    doubted[entry[4]][1] = True
        hidden = max(hidden, out)
        if out == 1 and hidden == 1:
            doubted[m.start()] = [0, False]
        stack.append((tag, path, len(blocks), hidden, m.start()))
    flush()
    close(0)
    if doubted:
        shown = sum(map(len, blocks))
        named = max((sum(map(len, blocks[c.start : c.end])) for c in done if c.tag in ("article", "main")), default=0)
        holds = {at for at, (chars, article) in doubted.items() if article and chars > named}
        if not named and not holds:
            holds = {at for at, (chars, _) in doubted.items() if 2 * chars > shown + aside}
        if holds:
            return read_page(html, wanted | holds)
    return blocks, done


def best_container(blocks: list[str], containers: list[Container]) -> Container | None:
    """The container most like an article: its own element if there is one, else by text.

    Among articles, then mains, the one with most characters. Otherwise the
    smallest container that holds all text the page shows outside what is left out.
    """
    total = [0]
    for b in blocks:
        total.append(total[-1] + len(b))

    def size(c: Container) -> int:
        return total[c.end] - total[c.start]

    for tag in ("article", "main"):
        found = [c for c in containers if c.tag == tag and size(c)]
        if found:
            return max(found, key=lambda c: (size(c), -c.start))
    whole = [c for c in containers if size(c) and size(c) == total[-1]]
    return min(whole, key=lambda c: (-c.path.count("/"), c.start)) if whole else None


def page_text(html: str, path: str | None) -> str:
    """Text of the containers with the path, or of the page's best one if that has more."""
    blocks, containers = read_page(html)
    best = best_container(blocks, containers)
    own = blocks[best.start : best.end] if best else blocks
    if path is not None:
        chosen = sorted((c for c in containers if c.path == path), key=lambda c: (c.start, -c.end))
        lines: list[str] = []
        upto = 0
        for c in chosen:
            lines += blocks[max(c.start, upto) : c.end]
            upto = max(upto, c.end)
        if sum(map(len, lines)) >= sum(map(len, own)):
            return "\n".join(lines)
    return "\n".join(own)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(host, F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, votes, pages``: the path most pages of a host vote for."""

    def per_text(texts: list[str]) -> list[list]:
        out = []
        for t in texts:
            blocks, containers = read_page(t)
            best = best_container(blocks, containers)
            out.append(best.path if best else None)
        return [out]

    votes = map_texts(pages, html, [host_of(F.col(url)).alias("host")], "path string", per_text)
    counted = votes.filter("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"))
    # the paths of one host are few: templates, not pages
    return counted.groupBy("host").agg(
        F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"),
        F.max("votes").alias("votes"), F.sum("votes").alias("pages"),
    )


def extract_pages(
    pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    winners = store(host_paths(pages, url, html)).select(F.col("host").alias("_host"), "path")
    chosen = pages.select(
        F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"),
        host_of(F.col(url)).alias("_host"),
    ).join(winners, "_host", "left")
    # the page and its path reach the task as one text: the path, a line end, the page
    packed = F.concat(F.coalesce("path", F.lit("")), F.lit("\n"), F.coalesce("_html", F.lit("")))

    def per_text(texts: list[str]) -> list[list]:
        out = []
        for t in texts:
            path, _, page = t.partition("\n")
            out.append(page_text(page, path or None))
        return [out, [len(t) for t in out]]

    return map_texts(
        chosen.withColumn("_packed", packed), "_packed", ["page_id", "url"], "text string, n_chars long", per_text
    )
