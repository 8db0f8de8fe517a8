"""Main text of web pages: site templates are found by counting element subtrees per host."""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from larkspur.llm.common import cut_lineage, text_bytes

#: Hosts or templates of up to so many rows are sent to all executors; more are joined.
BROADCAST_ROWS = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr legend".split())
#: Start tag: (open elements it ends, elements that shield those).
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Elements that never hold main text, wherever they stand.
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select textarea title head svg canvas dialog menu object audio video map".split())
#: Words of class, id and role that tell menus, notices, adverts and the like.
FURNITURE = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification paywall popup promo promotion replies reply respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_WHOLE = frozenset("html body main article".split())
#: Links in these belong to the text around them.
PROSE = frozenset("p blockquote article main h1 h2 h3 h4 h5 h6".split())
#: Elements whose subtrees are counted. Marks inside a line, such as a word in bold, are only templates with all that is around them.
COUNTED = (BLOCKS | DROPPED) - KEPT_WHOLE

#: A start tag may have ">" in quotes, in the first 200 pieces of its attributes; so a page of broken quotes isn't read to its end from every tag.
TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'){0,200}+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z0-9]+")
#: The first part of a URL's authority without user, port and case.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass
class Page:
    """Elements in the order of their start tags, and ``flow``: element numbers at starts, ~numbers at ends, and texts.

    ``menus`` has the hash of a subtree without its texts where all of them are links outside
    prose, as in a menu that names other pages on each page; else 0.
    """

    tags: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)
    menus: list[int] = field(default_factory=list)
    flow: list[int | str] = field(default_factory=list)


def parse(source: str) -> Page:
    """Elements of a page and a hash of every subtree: tag, class, id and all that is inside, white space aside (for menus see ``Page``).

    End tags that are left out are put in by a few rules of HTML; unknown ones are skipped.
    """
    page = Page()
    stack: list[int] = []
    inside: list[list[bytes]] = [[]]
    shapes: list[list[bytes]] = [[]]
    texts: list[list[int]] = [[0, 0]]
    opened: Counter[str] = Counter()
    depths: defaultdict[str, list[int]] = defaultdict(lambda: [-1])
    digest = xxhash.xxh3_64_digest

    def text(value: str) -> None:
        if value:
            value = entities.unescape(value) if "&" in value else value
            page.flow.append(value)
            if words := " ".join(value.split()):
                inside[-1].append(words.encode("utf-8", "replace"))
                texts[-1][opened["a"] > 0 and not any(opened[t] > 0 for t in PROSE)] += 1

    def close() -> None:
        i = stack.pop()
        tag = page.tags[i]
        opened[tag] -= 1
        depths[tag].pop()
        parts = inside.pop()
        own = [tag.encode(), b" ".join(marks(page.attributes[i]))]
        h = digest(b"\0".join([*own, *parts]))
        page.hashes[i] = int.from_bytes(h, "big", signed=True)
        page.flow.append(~i)
        inside[-1].append(b"\1" + h)
        shape, (other, links) = shapes.pop(), texts.pop()
        texts[-1][0] += other
        texts[-1][1] += links
        if links and not other:
            h = digest(b"\0".join([b"menu", *own, *shape]))
            page.menus[i] = int.from_bytes(h, "big", signed=True)
            if shapes[-1][-1:] != [h]:
                shapes[-1].append(h)

    def close_to(tags: tuple[str, ...], shields: tuple[str, ...]) -> None:
        depth = max(depths[t][-1] for t in tags)
        if depth > max((depths[t][-1] for t in shields), default=-1):
            while len(stack) > depth:
                close()

    at, last = 0, source.rfind(">")
    while (m := TOKEN.search(source, at)) if at <= last else None:
        text(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag] > 0:
                close_to((tag,), ())
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            close_to(("p",), ("button", "td", "th", "table"))
        if tag in ENDS and any(opened[t] > 0 for t in ENDS[tag][0]):
            close_to(*ENDS[tag])
        i = len(page.tags)
        page.tags.append(tag)
        page.attributes.append(m[3] or m[6] or "")
        page.parents.append(stack[-1] if stack else -1)
        page.hashes.append(0)
        page.menus.append(0)
        page.flow.append(i)
        depths[tag].append(len(stack))
        stack.append(i)
        inside.append([])
        shapes.append([])
        texts.append([0, 0])
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
            body = source[at : end.start() if end else len(source)]
            at = end.start() if end else len(source)
            inside[-1].append(body.encode("utf-8", "replace"))
            if not end:
                close()
        elif tag in VOID:
            close()
    text(source[at:].split("<!--", 1)[0])
    while stack:
        close()
    return page


def marks(attributes: str) -> list[bytes]:
    """Values of class, id and role, lower-case."""
    if not attributes:
        return []
    found = ((a[1].lower(), a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(attributes))
    return [f"{k}={v.lower()}".encode("utf-8", "replace") for k, v in found if k in ("class", "id", "role")]


def unwanted(tag: str, attributes: str) -> bool:
    """Whether an element is furniture by its tag, its marks or being hidden."""
    if tag in DROPPED:
        return True
    if not attributes:
        return False
    for a in ATTRIBUTE.finditer(attributes):
        name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
        if name in ("class", "id", "role") and not FURNITURE.isdisjoint(WORD.findall(value)):
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def main_text(page: Page, templates: set[int]) -> str:
    """Text blocks of the main part without subtrees that are templates of the site and without other furniture.

    Templates go first, whatever their tags; tags and marks tell furniture that changes from
    page to page, such as comments, and that of hosts with few pages. The main part is then
    the article with the most text left, else the main element, else the body. Of a header
    inside an article only headings are kept.
    """
    sizes, parents = [0] * len(page.tags), page.parents
    gone = [t not in KEPT_WHOLE and (h in templates or m in templates or unwanted(t, a)) for t, a, h, m in zip(page.tags, page.attributes, page.hashes, page.menus, strict=True)]
    for i, p in enumerate(parents):
        gone[i] = gone[i] or (p >= 0 and gone[p]) or (page.tags[i] == "article" and unwanted("article", page.attributes[i]))
    current = -1
    for x in page.flow:
        if isinstance(x, str):
            if current >= 0 and not gone[current]:
                sizes[current] += len(x)
        else:
            current = x if x >= 0 else parents[~x]
    for i in range(len(sizes) - 1, -1, -1):
        if parents[i] >= 0:
            sizes[parents[i]] += sizes[i]

    root = -1
    for wanted in ("article", "main", "body"):
        best = [i for i, t in enumerate(page.tags) if t == wanted and not gone[i] and sizes[i]]
        if best:
            root = max(best, key=lambda i: (sizes[i], -i))
            break

    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(parts).split()):
            blocks.append(line)
        parts.clear()

    inside, header, heading = root < 0, 0, 0
    current = -1
    for x in page.flow:
        if isinstance(x, str):
            if inside and not (current >= 0 and gone[current]) and not (header and not heading):
                parts.append(x)
            continue
        i, starts = (x, True) if x >= 0 else (~x, False)
        tag = page.tags[i]
        if i == root:
            inside = starts
        if inside or i == root:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                parts.append(" ")
        if tag == "header":
            header += 1 if starts else -1
        elif tag in HEADINGS:
            heading += 1 if starts else -1
        current = i if starts else parents[i]
    flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def site_templates(df: DataFrame, html_col: str, url_col: str, least_pages: int, least_share: float) -> DataFrame:
    """(host, templates): hashes of the subtrees that recur on many pages of a host.

    A subtree is known by all that it holds, a menu also by its shape alone, as the links in
    it may change. A subtree counts once for each different article it stands beside, so copies of one
    article don't make its paragraphs look like a template. Pages emit their distinct
    subtrees once each; counts are combined before the exchange, so a host with a third of
    all pages is no burden. A template is on ``least_share`` of the pages at least, so a
    host has no more of them than a page's subtrees divided by that share.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, found, beside = [], [], []
            for k, data in enumerate(text_bytes(batch.column(1))):
                page = parse(data.decode("utf-8", "replace"))
                own = next((h for t, h in zip(page.tags, page.hashes, strict=True) if t in ("article", "main")), None)
                own = own if own is not None else page.hashes[0] if page.hashes else 0
                subtrees = {x for t, h, m in zip(page.tags, page.hashes, page.menus, strict=True) if t in COUNTED and t not in PROSE for x in (h, m) if x}
                subtrees |= {h for t, h in zip(page.tags, page.hashes, strict=True) if t in COUNTED and t in PROSE}
                which += [k] * (len(subtrees) + 1)
                found += [None, *subtrees]
                beside += [own] * (len(subtrees) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(found, pa.int64()), pa.array(beside, pa.int64())], ["host", "h", "beside"])

    subtrees = df.select(host_of(F.col(url_col)).alias("host"), html_col).mapInArrow(convert, "host string, h long, beside long")
    counts = cut_lineage(subtrees.distinct().groupBy("host", "h").count().where(F.col("h").isNull() | (F.col("count") >= least_pages)))
    pages = counts.where("h IS NULL").select("host", F.col("count").alias("pages"))
    few = pages.count() <= BROADCAST_ROWS
    often = counts.where("h IS NOT NULL").join(F.broadcast(pages) if few else pages, "host").where(F.col("count") >= least_share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("h").alias("templates"))


def extract(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", url_col: str = "url", least_pages: int = 5, least_share: float = 0.3) -> DataFrame:
    """(id_cols, text, n_chars): the main text of every page.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments go, and so do subtrees that recur on the host of the page (see
    ``site_templates``). White space inside a block becomes one space; blocks are joined by
    a line feed. Null or empty html gives an empty text; pages without a host share one;
    repeated rows give repeated results; other input columns are left out.
    """
    templates = cut_lineage(site_templates(df, html_col, url_col, least_pages, least_share))
    small = templates.agg(F.coalesce(F.sum(F.size("templates")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_ROWS
    pages = df.select(*id_cols, F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("host"))
    joined = pages.join(F.broadcast(templates) if small else templates, "host", "left").select(*id_cols, "_html", "templates")
    schema = StructType([*(df.schema[c] for c in id_cols), StructField("text", StringType()), StructField("n_chars", LongType())])
    n = len(id_cols)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, known in zip(text_bytes(batch.column(n)), batch.column(n + 1), strict=True):
                found.append(main_text(parse(data.decode("utf-8", "replace")), set(known.as_py() or ())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], schema.names)

    return joined.mapInArrow(convert, schema)
