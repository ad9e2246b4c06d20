"""Main text of web pages by site style trees.

Each page is read into its tree of block elements.  Pages of one host are merged by layout: a node of the site
style tree is a path of tags and classes, whatever its wording, with two distributions over the host's distinct
pages: which text stands directly in it, and which layout its children have (tags and classes in order, runs of
equal ones as one).  Content: a text that stands on n of a node's m pages carries its length times
1 - log n / log m, its entropy over the pages; a branch's share is what its texts carry of all that the host's
texts carry.  Presentation: the entropy of a node's layouts, relative to log m.  A container's importance is
``GAMMA`` x share + (1 - ``GAMMA``) x presentation, so a menu or an advert of ever-changing words under one layout is
unimportant beside the text; that of a text element (paragraph, heading, cell) is the share of its branch that
is not repeated.  Branches of importance up to ``LOW``, seen on ``MIN_PAGES`` different pages of the host or more, are
removed from each of its pages.  What stands in an ``article`` or ``main`` element, or holds one, is never removed.
Containers whose texts do differ are removed only if all of them together carry at most ``LOST`` of the host's
content: where many small sections make up the text, all stay.  A page that would lose everything keeps it.

Only then come the fixed lists below, for what the tree can't show (hosts with few pages, noise inside the
article): elements whose tag, role or class names a menu, header, footer, sidebar, notice, advert, form, comment
and the like carry no main text, and an ``article`` or ``main`` element bounds the main text where a page has
one.  A class or id counts only as a whole name (``ad``, ``ad-300``, ``cookie-notice``: all its parts are in the lists;
not ``with-sidebar``).  Such an element is read after all if it is the page's article or holds the article or
main element: where no article has text outside such elements, and the articles inside are longer (on
average) than the text outside.  Hidden elements and comments (by whole name) stay out even then.  A form is
read if nothing else is left.

Style trees are counts per host, path, text and layout over distinct page digests, dealt by all of them and
combined before the shuffle, so a host that holds a third of all pages is spread over tasks.  Only removals
reach the pages: broadcast if a measurement shows that they are few, else joined by a shuffle.  Pages are read
twice and never shuffled in the first case.

Defined cases: null or empty html gives an empty text; a page without a host in its url belongs to the host
''; cut-off tags, comments and scripts at the end are dropped; unknown tags are inline; repeated rows give
equal texts; an empty table gives an empty table; columns other than page_id, url and html are never read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import chunks, column
from .common import P, broadcast_if_small, save

# What tags, roles and class names mean.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript svg iframe object".split())
NOISE_TAGS = frozenset("nav footer aside form menu head select button dialog label input fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner comment comments reply replies discussion disqus nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar widget cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager search skip".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies discussion disqus".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th caption figcaption".split())
OUTSIDE_TAGS, OUTSIDE_WORDS = frozenset(["header"]), frozenset("header masthead topbar toolbar".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PART = re.compile(r"[a-z0-9_-]+")
COUNTER = re.compile(r"[0-9]{3,}")
BREAK = re.compile(r"[-_0-9]+(?:x[0-9]+)?")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

MIN_PAGES, LOW, LOST, GAMMA = 10, 0.05, 0.25, 0.9
BROADCAST_ROWS = 200_000
GONE, NOISE, BODY, MAIN, ARTICLE = range(5)


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTR.findall(text)}


def _named(names: list[str], words: frozenset) -> bool:
    """Whether a whole name consists of the words (numbers aside)."""
    return any(n in words or (set(filter(None, BREAK.split(n))) or {""}) <= words for n in names)


def _region(tag: str, attrs: str, above: int, opened: bool = False) -> tuple[int, str]:
    """Region of an element under a region, and its classes for the path; ``opened``: it holds the main text."""
    region = ARTICLE if tag == "article" else max(above, MAIN) if tag == "main" else above
    noise = above <= NOISE or tag in NOISE_TAGS or (tag in OUTSIDE_TAGS and above < MAIN)
    if noise and above <= NOISE and "=" not in attrs and "hidden" not in attrs:
        return above, ""
    found = _attributes(attrs) if "=" in attrs else {}
    names = f"{found.get('class') or ''} {found.get('id') or ''}".lower() if found else ""
    whole, role = names.split(), (found.get("role") or "").lower()
    if role == "main":
        region = max(region, MAIN)
    if tag not in ("html", "body", "main"):
        hidden = "hidden" in attrs and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs)
        if hidden or "display:none" in (found.get("style") or "").replace(" ", "") or _named(whole, COMMENT_WORDS):
            return GONE, ""
        noise = noise or _named(whole, NOISE_WORDS) or role in NOISE_ROLES or (above < MAIN and region < MAIN and _named(whole, OUTSIDE_WORDS))
    path = ".".join(sorted(set(PART.findall(COUNTER.sub("", names))))) if names.strip() else ""  # long numbers name single elements
    return (min(above, NOISE) if noise and not opened else region), path


def parse(page: str):
    """Blocks (text, region, node) in page order, nodes (path, parent node, children), and whether an article was seen."""
    strict, wrapped, articles, forms = _parse(page, frozenset())
    size = _size(strict)
    if wrapped and not (strict[2] and size):
        loose = _parse(page, wrapped)[0]
        if _size(loose) > size * articles:
            return loose
    if forms and all(r <= NOISE for _, r, _ in strict[0]):
        return _parse(page, forms)[0]
    return strict


def _top(blocks: list, seen_article: bool) -> list:
    top = ARTICLE if seen_article else max((r for _, r, _ in blocks if r > NOISE), default=BODY)
    return [b for b in blocks if b[1] == top]


def _size(parsed) -> int:
    return sum(len(b[0]) for b in _top(parsed[0], parsed[2]))


def _parse(page: str, opened: frozenset):
    """One reading with elements (by place) ``opened``; places of the noise around articles and mains, the number of these, places of forms."""
    wrapped: set[int] = set()
    forms: set[int] = set()
    articles = 0
    nodes: list[tuple[str, int, list]] = [("", -1, [])]
    stack: list[tuple[str, int, int, int]] = [("", BODY, 0, -1)]
    blocks: list[tuple[str, int, int]] = []
    text: list[str] = []
    seen_article = False

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            if words:
                blocks.append((words, stack[-1][1], stack[-1][2]))
            text.clear()

    def add(raw: str) -> None:
        if stack[-1][1] > GONE:
            text.append(html.unescape(raw) if "&" in raw else raw)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at, place = m.end(), m.start()
        slash, tag, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if any(x[0] in BLOCK for x in stack[i:]) or stack[i][1] <= NOISE < stack[i - 1][1]:
                        flush()
                    del stack[i:]
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not attrs.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                at = close.end() if close else end
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if tag in BLOCK and stack[-1][0] == "p":
            stack.pop()
        elif tag in BLOCK and tag != "li" and any(x[0] == "p" for x in stack[-4:]):  # an open p with inline elements in it
            i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p")
            if not any(x[0] in BLOCK for x in stack[i + 1 :]):
                del stack[i:]
        if tag in CLOSES and stack[-1][0] in CLOSES[tag].split():
            stack.pop()
        _, above, parent, _ = stack[-1]
        if tag not in BLOCK:
            region = above if above <= NOISE or place in opened else NOISE if tag in NOISE_TAGS else above
            if region > NOISE and "=" in attrs and tag in ("span", "a", "div"):
                region = min(region, _region(tag, attrs, above, place in opened)[0])
            if region <= NOISE < above:
                flush()
                nodes.append((f"{nodes[parent][0]}>{tag}", parent, []))
                parent = len(nodes) - 1
            stack.append((tag, region, parent, place))
            continue
        region, names = _region(tag, attrs, above, place in opened) if above > GONE else (GONE, "")
        if tag == "form" and region == NOISE < above:
            forms.add(place)
        if region <= NOISE:
            if region == NOISE and (tag in ("article", "main") or ("main" in attrs and (_attributes(attrs).get("role") or "").lower() == "main")):
                articles += tag == "article"
                wrapped.add(place)
                for x in reversed(stack):
                    if x[3] in wrapped:
                        break
                    wrapped.add(x[3])
            if region == GONE:
                stack.append((tag, region, parent, place))
                continue
        seen_article |= region == ARTICLE
        name = f"{tag}{'.' + names if names else ''}"
        nodes[parent][2].append(name)
        nodes.append((f"{nodes[parent][0]}>{name}", parent, []))
        stack.append((tag, region, len(nodes) - 1, place))
    flush()
    return (blocks, nodes, seen_article), frozenset(wrapped), max(articles, 1), frozenset(forms)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m.group(1).lower() if m else ""


def _after_tree(blocks: list, nodes: list, low: frozenset) -> list:
    """The blocks that the host's tree leaves; ``low``: hashes of its paths of low importance."""
    bad = [False] * len(nodes)
    for i, (path, parent, _) in enumerate(nodes):
        bad[i] = (parent >= 0 and bad[parent]) or path_hash(path) in low
    return [b for b in blocks if b[1] >= MAIN or not bad[b[2]]]


def main_text(page: str | None, low: frozenset = frozenset()) -> str:
    """The main text of a page: what the tree leaves, then what the lists leave of that."""
    if not page:
        return ""
    blocks, nodes, seen = parse(page)
    kept = _top(_after_tree(blocks, nodes, low), seen) if low else []
    return " ".join(b[0] for b in kept or _top(blocks, seen))


def decided(page: str | None, low: frozenset = frozenset()) -> tuple[int, int, int]:
    """Blocks of a page, how many of them the tree removes, and how many more the lists."""
    blocks, nodes, seen = parse(page or "")
    left = _after_tree(blocks, nodes, low)
    return len(blocks), len(blocks) - len(left), len(left) - len(_top(left, seen))


def path_hash(path: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def node_rows(page: str) -> list[tuple]:
    """For each path with text in or below it: path, paths above it, whether it is a text element, whether it is in, is or holds the article or main, digest and length of its own text, digest of its layout."""
    import xxhash

    blocks, nodes, _ = parse(page)
    own: dict[str, list] = {}
    above: dict[str, list] = {}
    kept: set[str] = set()
    for text, region, node in blocks:
        own.setdefault(nodes[node][0], []).append(text)
        while node > 0:
            path, parent, _ = nodes[node]
            if region >= MAIN:
                kept.add(path)
            if path not in above:
                above[path] = []
                up = parent
                while up > 0:
                    above[path].append(path_hash(nodes[up][0]))
                    up = nodes[up][1]
            node = parent
    layout: dict[str, list] = {}
    for path, _, children in nodes:
        if path in above:
            seen = layout.setdefault(path, [])
            for c in children:
                if not seen or seen[-1] != c:
                    seen.append(c)
    digest = lambda x: xxhash.xxh3_64_intdigest("\n".join(x)) - (1 << 63)
    rows = []
    for path, up in above.items():
        mine = own.get(path, [])
        tag = path.rpartition(">")[2].partition(".")[0]
        rows.append((path_hash(path), up, tag in TEXT_TAGS, path in kept, digest(mine), sum(map(len, mine)), digest(layout[path])))
    return rows


def style_tree(pages: DataFrame) -> DataFrame:
    """The nodes of each host's style tree: host, path, above, is_text, kept, pages, share, novel, presentation, importance."""

    def run(batches):
        for b in chunks(batches, "html"):
            rows = [(host_of(u), d, *x) for u, h in zip(column(b, "url").to_pylist(), column(b, "html").to_pylist(), strict=True) if h for d in (path_hash(h),) for x in node_rows(h)]
            if rows:
                host, page, path, above, is_text, kept, text, size, layout = zip(*rows, strict=True)
                number = lambda x: pa.array(np.array(x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(host), number(page), number(path), pa.array(above, pa.list_(pa.int64())), pa.array(is_text), pa.array(kept), number(text), number(size), number(layout)],
                    ["host", "page", "path", "above", "is_text", "kept", "text", "size", "layout"],
                )

    # Equal pages of a host count once.
    rows = pages.select("url", "html").mapInArrow(run, "host string, page long, path long, above array<long>, is_text boolean, kept boolean, text long, size long, layout long").distinct()
    seen = rows.groupBy("host", "path", "above", "is_text", "text", "layout").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("kept").alias("kept"))
    seen = save(seen, "pages-nodes")
    node = ["host", "path"]
    of_all = seen.groupBy(*node).agg(F.sum("n").alias("pages"), F.max("kept").alias("kept"), F.first("above").alias("above"), F.first("is_text").alias("is_text"))
    # 1 for what stands on one page, 0 for what stands on all; a node of one page shows nothing, so its text counts in full.
    carried = lambda n, m: F.when(m > 1, 1 - F.log(n) / F.log(m)).otherwise(F.lit(1.0))
    texts = seen.groupBy(*node, "text").agg(F.sum("n").alias("n"), F.max("size").alias("size")).join(of_all.select(*node, "pages"), node)
    texts = texts.groupBy(*node).agg(F.sum(F.col("n") * F.col("size") * carried(F.col("n"), F.col("pages"))).alias("carried"), F.sum(F.col("n") * F.col("size")).alias("held"))
    layouts = seen.groupBy(*node, "layout").agg(F.sum("n").alias("n")).join(of_all.select(*node, "pages"), node)
    layouts = layouts.groupBy(*node).agg(F.sum(F.when(F.col("pages") > 1, F.col("n") * (F.log("pages") - F.log("n")) / (F.col("pages") * F.log("pages"))).otherwise(0.0)).alias("presentation"))
    own = save(of_all.join(texts, node).join(layouts, node), "pages-own")
    total = own.groupBy("host").agg(F.sum("carried").alias("total"))
    branch = own.select("host", F.explode(F.concat(F.array("path"), "above")).alias("path"), "carried", "held").groupBy(*node).agg(F.sum("carried").alias("carried"), F.sum("held").alias("held"))
    tree = own.drop("carried", "held").join(branch, node).join(total, "host")
    tree = tree.withColumn("share", F.col("carried") / F.greatest("total", F.lit(1e-9))).withColumn("novel", F.col("carried") / F.greatest("held", F.lit(1)))
    importance = F.when(F.col("is_text"), F.col("novel")).otherwise(GAMMA * F.col("share") + (1 - GAMMA) * F.col("presentation"))
    return tree.select("host", "path", "above", "is_text", "kept", "pages", "share", "novel", "presentation", importance.alias("importance"))


def removals(pages: DataFrame) -> DataFrame:
    """Per host with any: the paths whose branches are removed."""
    tree = save(style_tree(pages), "pages-tree")
    low = save(tree.filter((F.col("pages") >= MIN_PAGES) & (F.col("importance") <= LOW) & ~F.col("kept")).select("host", "path", "above", "share", "novel"), "pages-low")
    # Branches below a removed branch go with it.
    inner = low.select("host", "path", F.explode("above").alias("up")).join(low.select("host", F.col("path").alias("up")), ["host", "up"], "left_semi").select("host", "path").distinct()
    low = save(low.join(inner, ["host", "path"], "left_anti"), "pages-branches")
    lost = low.filter(F.col("novel") > LOW).groupBy("host").agg(F.sum("share").alias("lost"))
    low = low.join(lost, "host", "left").filter((F.col("novel") <= LOW) | (F.col("lost") <= LOST))
    return save(low.groupBy("host").agg(F.collect_list("path").alias("low")), "pages-removals")


def _with_removals(pages: DataFrame) -> DataFrame:
    low = removals(pages)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST.pattern, 1))
    low = broadcast_if_small(low.select(F.col("host").alias(P + "host"), F.col("low").alias(P + "low")), BROADCAST_ROWS)
    return pages.select("page_id", "url", "html").join(low, host == F.col(P + "host"), "left").select("page_id", "url", "html", P + "low")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url and ``text``."""

    def run(batches):
        for b in chunks(batches, "html"):
            texts = [main_text(h, frozenset(x or ())) for h, x in zip(column(b, "html").to_pylist(), column(b, P + "low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "page_id"), column(b, "url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return _with_removals(pages).mapInArrow(run, f"page_id {kind}, url string, text string")


def decisions(pages: DataFrame) -> DataFrame:
    """Per page: page_id, ``blocks``, how many of them the host's tree removes (``by_tree``), and how many more the lists (``by_lists``)."""

    def run(batches):
        for b in chunks(batches, "html"):
            rows = [decided(h, frozenset(x or ())) for h, x in zip(column(b, "html").to_pylist(), column(b, P + "low").to_pylist(), strict=True)]
            counts = [pa.array(np.array(x, np.int64)) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "page_id"), *counts], ["page_id", "blocks", "by_tree", "by_lists"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return _with_removals(pages).mapInArrow(run, f"page_id {kind}, blocks long, by_tree long, by_lists long")


def page_texts(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
