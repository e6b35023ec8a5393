"""Main text of web pages by a site style tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

#: A node of the style tree goes if its importance is below this; the tree is heard on
#: nodes that stand on so many different pages of the site.
IMPORTANCE, LEAST_PAGES = 0.35, 3
#: What a node is taken for before the tree is heard, by its place: in an article or main
#: element, on a page without such an element, beside one. Worth so many pages.
IN_MAIN, PLAIN, BESIDE, PRIOR_PAGES = 0.75, 0.5, 0.2, 2
#: Of an inner node's importance, what a level of its branch leaves to the leaves.
DECAY = 0.9
#: Nodes of a host, and of all, that go to the pages as lists by a broadcast; more are
#: joined by a shuffle, each node dealt to SALTS tasks.
LIST_ROWS, ALL_ROWS, SALTS = 2_000, 100_000, 16

# The vocabulary of HTML that decides without statistics
RAW = {"script", "style", "template", "noscript", "textarea", "svg", "math", "iframe", "object", "select",
       "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del",
          "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "wbr"}
BOILER_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert",
                "dialog", "menu", "menubar"}
BOILER_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor",
                "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu",
                "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie",
                "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay",
                "newsletter", "subscribe", "signup", "login", "share", "sharing", "social",
                "related", "recommended", "comment", "comments", "disqus", "respond", "replies",
                "reply", "widget", "toolbar", "pagination", "pager", "copyright", "disclaimer",
                "skip", "search"}
MAIN_TAGS = {"article", "main"}
#: Open elements that a start tag ends (others end with their parent).
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+|\d+")

CONTENT, UNKNOWN, BOILER = 0, 1, 2


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw else {}


def _is_boiler(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in BOILER_TAGS or tag == "header" and not in_main:
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in BOILER_ROLES or attrs.get("aria-hidden") == "true":
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in MAIN_TAGS or tag in ("body", "html", "p", "h1"):
        return False
    names = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2",
                                 attrs.get("class", "") + " " + attrs.get("id", "")).lower())
    return bool(BOILER_NAMES.intersection(names))


def parse(html: str, nodes: list[tuple[str, str, list[str]]] | None = None) -> list[tuple[str, str, int]]:
    """Blocks of a page in order: (path of block elements with their classes, text, kind).

    An open element stack that forgives missing ends: a paragraph ends the one before, an
    end tag closes down to its start and is ignored without one. Inline elements belong to
    the block around them. `nodes` takes the path of each block element, the path above it
    and the names of its children.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, int]] = [("", "", UNKNOWN)]
    under: list[list[str]] = [[]]
    text: list[str] = []
    at = 0

    def push(tag: str, name: str, kind: int) -> None:
        del under[len(stack):]
        under[-1].append(name)
        under.append([])
        path = f"{stack[-1][1]}/{name}"
        if nodes is not None:
            nodes.append((path, stack[-1][1], under[-1]))
        stack.append((tag, path, kind))

    def flush() -> None:
        words = " ".join(unescape("".join(text)).split())
        text.clear()
        if words:
            out.append((stack[-1][1], words, stack[-1][2]))

    for found in _TOKEN.finditer(html):
        if found.start() < at:
            continue
        text.append(html[at:found.start()])
        at = found.end()
        end, tag, raw = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not end:
            if not raw.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = html.find(">", close.start()) + 1 or len(html) if close else len(html)
            continue
        if tag == "br":
            text.append(" ")
            continue
        attrs = _attributes(raw) if raw else {}
        if tag in INLINE:
            if not end and _is_boiler(tag, attrs, stack[-1][2] == CONTENT):
                # an inline branch that is boilerplate by name is a block of its own
                flush()
                push(tag, tag, BOILER)
            elif end and stack[-1][0] == tag:
                flush()
                stack.pop()
            continue
        flush()
        if end:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                del stack[depth:]
            continue
        if tag in VOID:
            continue
        while len(stack) > 1 and stack[-1][0] in ENDS.get(tag, ()):
            stack.pop()
        if tag not in ("p",) and tag not in ENDS:
            while len(stack) > 1 and stack[-1][0] == "p":
                stack.pop()
        kind = stack[-1][2]
        if kind != BOILER:
            if _is_boiler(tag, attrs, kind == CONTENT):
                kind = BOILER
            elif tag in MAIN_TAGS or attrs.get("role", "").lower() == "main":
                kind = CONTENT
        name = tag + "".join("." + c for c in sorted(attrs.get("class", "").split()))
        if not raw.rstrip().endswith("/"):
            push(tag, name, kind)
    text.append(html[at:])
    flush()
    return out


def host_of(url: str | None) -> str:
    """Host of a url in lower case, without port; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


BLOCKS = "array<struct<path: long, above: array<long>, feature: long, kind: int, words: string>>"
INNER = "array<struct<path: long, layout: long>>"


def _layout(children: list[str]) -> int:
    """A hash of the children's names in order; equal neighbours count once."""
    return _hash("|".join(c for i, c in enumerate(children) if not i or c != children[i - 1]))


def _parsed(pages: DataFrame) -> DataFrame:
    """(id, url, host, body, has_main, blocks, inner) of each page: body is a hash of its
    blocks, `above` the nodes over a block from the nearest on, `inner` the layouts of the
    children of its inner nodes."""
    kind = pa.list_(pa.struct([("path", pa.int64()), ("above", pa.list_(pa.int64())), ("feature", pa.int64()),
                               ("kind", pa.int32()), ("words", pa.string())]))
    layouts = pa.list_(pa.struct([("path", pa.int64()), ("layout", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {"": [_hash("")]}
        for batch in batches:
            rows, size, first = [], 0, 0
            for i, (url, html) in enumerate(zip(batch.column("url"), batch.column("html"), strict=True)):
                if len(known) > 20_000:
                    known = {"": known[""]}
                nodes: list[tuple[str, str, list[str]]] = []
                found = parse(html.as_py() or "", nodes)
                for path, above, _ in nodes:  # a node comes after the one above it
                    if path not in known:
                        if above not in known:  # a part of the page was known before
                            known[above] = [_hash(above)]
                        known[path] = [_hash(path), *known[above]]
                blocks = [{"path": known[p][0], "above": known[p][1:], "feature": _hash(w), "kind": k, "words": w}
                          for p, w, k in found]
                inner = {(known[path][0], _layout(children)) for path, _, children in nodes if children}
                body = _hash(" ".join(str(b["path"] ^ b["feature"]) for b in blocks))
                rows.append((host_of(url.as_py()), body, any(k == CONTENT for _, _, k in found), blocks,
                             [{"path": path, "layout": layout} for path, layout in inner]))
                size += len(html.as_py() or "")
                if size > 4 << 20 or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(first, len(rows)), batch.column("url").slice(first, len(rows)),
                         *[pa.array(c, t) for c, t in zip(zip(*rows), (
                             pa.string(), pa.int64(), pa.bool_(), kind, layouts), strict=True)]],
                        names=["id", "url", "host", "body", "has_main", "blocks", "inner"])
                    first, rows, size = i + 1, [], 0

    return pages.mapInArrow(run, f"id {pages.schema['id'].dataType.simpleString()}, url string, host string, "
                                 f"body long, has_main boolean, blocks {BLOCKS}, inner {INNER}")


def node_importance(parsed: DataFrame) -> DataFrame:
    """(host, path, pages, beside, importance, branch, branch_pages): the leaves of each
    site's style tree with the importance of the node above them.

    A leaf is a place of the merged trees: the chain of block elements and classes from
    the root. Over the m different pages of the site that have it, its importance is one
    minus the mean entropy of its contents, each content's share per page being even:
    log(pages with the content) / log m. A content that stands on one page only has
    entropy 0, one that stands on all has 1. Equal pages count once.

    An inner node's importance is made of two parts: the entropy of the layouts that its
    children have on different pages (its presentation; 0 if all pages lay it out alike),
    and the mean importance of the leaves below it, by pages. The deeper they lie, the
    less they weigh. `beside` tells if a page has the leaf beside a main element.
    """
    one = parsed.select("host", "body", "has_main", F.explode("blocks").alias("b")).select(
        "host", "body", "b.path", "b.above", "b.feature",
        (F.col("has_main") & (F.col("b.kind") == UNKNOWN)).alias("beside"))
    place = one.groupBy("host", "path").agg(F.first("above").alias("above"), F.max("beside").alias("beside"))
    once = one.select("host", "body", "path", "feature").distinct()
    where = once.select("host", "path", "body").distinct().groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"))
    shared = once.groupBy("host", "path", "feature").agg(F.count(F.lit(1)).alias("n"))
    content = shared.groupBy("host", "path").agg(
        (F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("spread"))
    leaves = materialise(where.join(content, ["host", "path"]).join(place, ["host", "path"]).withColumn(
        "importance", 1 - F.when(F.col("pages") > 1, F.col("spread") / F.log("pages")).otherwise(0.0)), "page-leaves")

    laid = parsed.select("host", "body", F.explode("inner").alias("i")).select(
        "host", "body", "i.path", "i.layout").distinct().groupBy("host", "path", "layout").agg(
        F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    looks = laid.groupBy("host", "path").agg(F.when(n > 1, 1 - F.sum(F.col("n") * F.log("n")) / n / F.log(n))
                                             .otherwise(0.0).alias("looks"))
    # a leaf on one page tells nothing about what repeats
    weight = F.col("pages") - 1
    below = leaves.filter("pages > 1").select("host", "pages", "importance", F.posexplode("above").alias("level", "node"))
    below = below.groupBy("host", F.col("node").alias("path")).agg(
        (F.sum(weight * F.col("importance")) / F.sum(weight)).alias("mean"),
        (F.sum(weight * (F.col("level") + 1)) / F.sum(weight)).alias("levels"), F.max("pages").alias("branch_pages"))
    left = F.pow(F.lit(DECAY), F.col("levels"))
    branches = below.join(looks, ["host", "path"], "left").select(
        "host", F.col("path").alias("node"), "branch_pages",
        (left * F.col("mean") + (1 - left) * F.coalesce("looks", F.lit(0.0))).alias("branch"))
    near = leaves.select("host", "path", "pages", "beside", "importance", F.get("above", F.lit(0)).alias("node"))
    return near.join(branches, ["host", "node"], "left").select(
        "host", "path", "pages", "beside", "importance", F.coalesce("branch", F.lit(0.0)).alias("branch"),
        F.coalesce("branch_pages", F.lit(1)).alias("branch_pages"))


def _verdicts(parsed: DataFrame) -> DataFrame:
    """`parsed` with three lists of paths: `void` goes anywhere, `weak` outside main
    elements, `strong` stays beside them.

    A node's importance is that of its place in the tree, weighed by the pages it stands
    on besides one, with its branch for up to PRIOR_PAGES more, and with what its name
    says for PRIOR_PAGES; `need` is the least a name must say for it to stay.
    """
    pages = F.col("pages") - 1
    branch = F.least(F.col("branch_pages") - 1, F.lit(PRIOR_PAGES))
    need = (IMPORTANCE * (pages + branch + PRIOR_PAGES) - pages * F.col("importance")
            - branch * F.col("branch")) / PRIOR_PAGES
    told = node_importance(parsed).filter(F.col("pages") >= LEAST_PAGES).select("host", "path", "beside", need.alias("need"))
    told = materialise(told.filter((F.col("need") > PLAIN) | F.col("beside") & (F.col("need") <= BESIDE)), "page-verdicts")
    lists = [F.collect_set(F.when(test, F.col("path"))).alias(name) for name, test in (
        ("void", F.col("need") > IN_MAIN), ("weak", F.col("need") > PLAIN), ("strong", F.col("need") <= BESIDE))]
    n, most = told.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (n or 0) <= ALL_ROWS and (most or 0) <= LIST_ROWS:
        return parsed.join(F.broadcast(materialise(told.groupBy("host").agg(*lists), "page-lists")), "host", "left")
    # a path of the hot host stands on each of its pages: its row meets them in SALTS tasks
    spots = parsed.select("row", "host", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["path"])))
                          .alias("path")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    dealt = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_page = spots.join(dealt, ["host", "path", "salt"]).groupBy("row").agg(*lists)
    return parsed.join(by_page, "row", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, text (never null).

    The trees of a host's pages are merged into a site style tree (`node_importance`). A
    block goes if its importance there, weighed with that of the branch around it and with
    what names say of it, is below IMPORTANCE (`_verdicts`). Names say: what lies in an
    article or main element is content, what lies beside one is not, both until the tree
    knows better. So a notice that repeats in the articles of a site goes, and text beside
    articles that differs from page to page stays. Navigation, footers, forms, adverts and
    the like, by element, role or name, go whatever the tree says: their words differ from
    page to page, too. A page whose main elements would lose every block keeps them.

    Counts are combined before they are shuffled, so a host with a third of all pages is
    a few thousand rows per task; page texts move only if the verdicts of the nodes do not
    fit a broadcast.

    A null html is empty and so is its text; pages without host form a site of their own;
    rows that repeat an id are treated each on its own, extra columns are ignored, and an
    empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = materialise(_parsed(rows).withColumn("row", F.monotonically_increasing_id()), "pages-parsed")
    joined = _verdicts(parsed)
    void, weak, strong = (F.coalesce(c, F.array().cast("array<long>")) for c in ("void", "weak", "strong"))
    main = F.filter("blocks", lambda b: b["kind"] == CONTENT)
    kept = F.filter("blocks", lambda b: F.when(b["kind"] == CONTENT, ~F.array_contains(void, b["path"])).otherwise(
        (b["kind"] == UNKNOWN) & F.when(F.col("has_main"), F.array_contains(strong, b["path"])).otherwise(
            ~F.array_contains(weak, b["path"]))))
    kept = F.when(F.col("has_main") & (F.size(kept) == 0), main).otherwise(kept)
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(
        F.transform(kept, lambda b: b["words"]), " ").alias("text"))
