"""HTML extraction: wrappers inferred per host as union-free expressions, then applied to every page."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.store import table

#: Elements that never hold main text, that never close, whose text is one block, and that a new one of the same kind ends.
DROPPED = frozenset("head script style noscript template iframe svg math canvas object embed form button select textarea input nav header footer aside menu dialog audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hgroup hr center fieldset".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template"])
#: Words of class, id and role that mark what isn't the article; fixed values.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup "
    "sidebar aside rail widget widgets related recommended recirc share sharing social nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc header masthead topbar "
    "footer bottombar copyright legal disclaimer comment comments disqus replies reply responses login search toolbar skip tags complementary contentinfo dialog form".split()
)
#: Elements of which class words may say that they are no part of the article: those that hold others, and never headings or paragraphs.
HOLDERS = frozenset("div section aside nav header footer form ul ol dl table main article figure details dialog".split())
COMMENTS = frozenset("comment comments disqus replies reply responses".split())
#: Containers of the article, best first: element, words.
MAIN = (("article", ""), ("main", ""), (None, "main"), (None, "article body"), (None, "content"))
_MAIN = [(name, set(words.split())) for name, words in MAIN]
NAMES = ASIDE | {w for _, words in _MAIN for w in words}
#: Levels of elements that wrappers describe.
DEPTH = 60
#: Trees of a host that one task aligns, about, and pages that must share a text before it counts as template.
FAN, LEAST_PAGES = 64, 8

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_WORD = re.compile(r"[A-Za-z]+")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in RAW}
_SPACE = re.compile(r"\s+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is ``open``, ``close`` or ``text``; comments and declarations are left out."""
    at, low = 0, len(page)
    while at < low:
        lt = page.find("<", at)
        m = _TAG.match(page, lt) if lt >= 0 else None
        while lt >= 0 and m is None:
            lt = page.find("<", lt + 1)
            m = _TAG.match(page, lt) if lt >= 0 else None
        end = low if lt < 0 else lt
        if end > at:
            yield "text", "", page[at:end]
        if m is None:
            return
        at = max(m.end(), lt + 1)
        if m[2]:
            name = m[2].lower()
            yield ("close" if m[1] else "open"), name, m[3] or ""
            if not m[1] and name in RAW:
                stop = _CLOSE[name].search(page, at)
                at = stop.start() if stop else low


def label(name: str, attrs: str) -> str:
    """An element as a token of a wrapper: its name, and its class and role words in order.

    An id names one place of one page, often after a heading, so its words count only where all of them
    are such as mark a part of a page (``main-nav``, ``comments``), and only of elements that hold others.
    """
    if not attrs.strip():
        return name
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    cut = lambda v: {w.lower() for w in re.split(r"[^A-Za-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v)) if w}
    words = set().union(*(cut(found[k]) for k in ("class", "role", "itemprop") if k in found))
    if name in HOLDERS and (own := cut(found.get("id", ""))) <= NAMES:
        words |= own
    words = sorted(words)
    return f"{name}.{'.'.join(words)}" if words else name


@dataclass
class Node:
    label: str
    children: list = field(default_factory=list)  # nodes and texts


def tree(page: str) -> Node:
    """The element tree of a page, with what is left open closed as browsers do for blocks."""
    root = Node("")
    stack, names = [root], [""]
    for kind, name, rest in tokens(page):
        if kind == "text":
            stack[-1].children.append(rest)
            continue
        if kind == "open":
            if name in BLOCK and "p" in names:  # a block ends an open paragraph
                k = len(names) - 1 - names[::-1].index("p")
                if not any(x in BLOCK for x in names[k + 1 :]):
                    del stack[k:], names[k:]
            elif name in ENDS and names[-1] in ENDS[name]:
                del stack[-1], names[-1]
            node = Node(label(name, rest))
            stack[-1].children.append(node)
            if name not in VOID and not rest.rstrip().endswith("/"):
                stack.append(node)
                names.append(name)
        elif name in names[1:]:
            k = len(names) - 1 - names[::-1].index(name)
            if name not in BLOCK and any(x in BLOCK for x in names[k + 1 :]):
                continue  # the end of an inline element doesn't end blocks inside it
            del stack[k:], names[k:]
    return root


# --- wrappers ---
# A list of items: [label, flag, children] for an element, [TEXT, flag, weight, fixed] for text. Flags: "1"
# once, "?" optional, "+" repeated, "*" both. weight is the number of characters that texts at this place
# have on all pages together; fixed are hash and length of the texts that every page has here.

TEXT, DEEP = "#", "##"


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.md5(" ".join(text.split()).encode("utf-8", "surrogatepass")).digest()[:8])


def _slot(texts: list[str], label_: str = TEXT) -> list:
    return [label_, "1", sum(map(len, texts)), {text_hash(t): len(t) for t in texts}]


def _texts(node: Node) -> list[str]:
    out, todo = [], [node]
    while todo:
        c = todo.pop()
        if isinstance(c, Node):
            todo += c.children
        elif c.strip():
            out.append(c)
    return out


def skeleton(node: Node, depth: int = 0) -> list:
    """The wrapper of one page's element: equal neighbours are one repeated group.

    What nests deeper than DEPTH is one DEEP slot; if it holds the article, pages are searched there themselves.
    """
    out: list = []
    for c in node.children:
        if isinstance(c, str):
            if not c.strip():
                continue
            item = _slot([c])
        elif depth >= DEPTH:
            item = _slot(_texts(c), DEEP)
        else:
            item = [c.label, "1", skeleton(c, depth + 1)]
        _put(out, item)
    return out


def _flags(a: str, b: str) -> str:
    many, maybe = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return ("*" if maybe else "+") if many else ("?" if maybe else "1")


def _put(out: list, item: list) -> None:
    """Append an item; one of its neighbour's label joins it to a repeated group."""
    if not out or out[-1][0] != item[0]:
        out.append(item)
    elif item[0] in (TEXT, DEEP):
        out[-1] = [item[0], _flags(out[-1][1], item[1]), out[-1][2] + item[2], out[-1][3] | item[3]]
    else:
        out[-1] = [item[0], "*" if "?" in (item[1], out[-1][1]) or "*" in (item[1], out[-1][1]) else "+", align(out[-1][2], item[2], True)]


def align(a: list, b: list, same_page: bool = False) -> list:
    """The least union-free expression of both: common items in the longest order, mismatches optional,
    and neighbours of one label a repeated group. Texts that both have stay fixed, others become a slot;
    within a page all stay fixed."""
    if not a or not b:
        return [[x, _flags(f, "?"), *rest] for x, f, *rest in a or b]
    n, m = len(a), len(b)
    low = 0
    while low < min(n, m) and a[low][0] == b[low][0]:
        low += 1
    high = 0
    while high < min(n, m) - low and a[n - 1 - high][0] == b[m - 1 - high][0]:
        high += 1
    p, q = n - low - high, m - low - high
    best = [[0] * (q + 1) for _ in range(p + 1)]
    for i in range(p - 1, -1, -1):
        for j in range(q - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[low + i][0] == b[low + j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list = []

    def both(x: list, y: list) -> list:
        if x[0] in (TEXT, DEEP):
            fixed = x[3] | y[3] if same_page else {h: size for h, size in x[3].items() if h in y[3]}
            return [x[0], _flags(x[1], y[1]), x[2] + y[2], fixed]
        return [x[0], _flags(x[1], y[1]), align(x[2], y[2], same_page)]

    def one(x: list) -> list:
        return [x[0], _flags(x[1], "?"), *x[2:]]

    for i in range(low):
        _put(out, both(a[i], b[i]))
    i = j = 0
    while i < p or j < q:
        x, y = a[low + i] if i < p else None, b[low + j] if j < q else None
        if x and y and x[0] == y[0]:
            _put(out, both(x, y))
            i, j = i + 1, j + 1
        elif j == q or (i < p and best[i + 1][j] >= best[i][j + 1]):
            _put(out, one(x))
            i += 1
        else:
            _put(out, one(y))
            j += 1
    for k in range(high, 0, -1):
        _put(out, both(a[n - k], b[m - k]))
    return out


def dump(items: list) -> str:
    """A wrapper as an expression to read: label, flag, children in parentheses; ``=`` where all pages share a text."""
    show = lambda x: x[0] + ("=" if x[0] in (TEXT, DEEP) and x[3] else "") + ("" if x[1] == "1" else x[1])
    return " ".join(show(x) + (f"({dump(x[2])})" if x[0] not in (TEXT, DEEP) and x[2] else "") for x in items)


def pack(pages: int, items: list) -> str:
    """A wrapper and its number of pages as text, for grouping and moving."""
    return json.dumps([pages, items], separators=(",", ":"), ensure_ascii=False)


def load(text: str) -> tuple[int, list]:
    def fix(items: list) -> list:
        return [[x[0], x[1], x[2], {int(h): n for h, n in x[3].items()}] if x[0] in (TEXT, DEEP) else [x[0], x[1], fix(x[2])] for x in items]

    pages, items = json.loads(text)
    return pages, fix(items)


def aside(label_: str) -> bool:
    """Whether class words name what isn't the article, of an element that holds others; of an article or main element only those of comments do."""
    name, *words = label_.split(".")
    return name in HOLDERS and any(w in (COMMENTS if name in ("article", "main") else ASIDE) for w in words)


def mark(label_: str) -> int | None:
    """The first of MAIN that an element's label meets."""
    name, *words = label_.split(".")
    return next((k for k, (n, w) in enumerate(_MAIN) if (n is None or n == name) and w <= set(words)), None)


def comments(label_: str) -> bool:
    name, *words = label_.split(".")
    return name in HOLDERS and any(w in COMMENTS for w in words)


@dataclass
class Region:
    """Where the article lies on the pages of a host: paths of labels, labels that look like an aside but
    hold most of it, hashes of template texts in it, and whether pages must be searched below it."""

    paths: frozenset[tuple[str, ...]]
    wanted: frozenset[str] = frozenset()
    template: frozenset[int] = frozenset()
    deep: bool = False


def region(pages: int, wrapper: list) -> Region:
    """The main region of a wrapper, from the mass of its slots; tags and classes break the tie.

    An element weighs what its slots hold, without texts that all pages share, dropped elements and
    those whose class words name comments, or another aside, unless that holds a marked element of half
    of all text or hardly anything else has text. Marked elements that hold half of the whole are the region, the
    best mark first. Otherwise it is reached from the root by steps into the element that holds more
    than half, as long as that is no repeated group and has blocks of its own; there, texts that all of
    at least LEAST_PAGES pages have are template if they are the smaller part. In a marked element,
    what pages share is article too.
    """
    weight: dict[int, int] = {}
    heavy: dict[int, int] = {}  # greatest mass of a marked element in it that is no aside

    def weigh(item: list) -> int:
        if item[0] in (TEXT, DEEP):
            got = max(0, item[2] - (sum(item[3].values()) * pages if pages > 1 else 0))
        elif item[0].split(".")[0] in DROPPED:
            got = heavy[id(item)] = 0
        else:
            got = sum(weigh(x) for x in item[2])
            own = got if mark(item[0]) is not None and not aside(item[0]) else 0
            heavy[id(item)] = max([own, *[heavy[id(x)] for x in item[2] if id(x) in heavy]])
            if outside(item):
                got = 0
        weight[id(item)] = got
        return got

    def outside(item: list) -> bool:
        if comments(item[0]):
            return True
        return strict and aside(item[0]) and not 2 * heavy[id(item)] >= max(raw, 1)

    strict = False
    raw = sum(weigh(x) for x in wrapper)
    strict = True
    total = sum(weigh(x) for x in wrapper)
    if 10 * total < raw:
        strict, total = False, sum(weigh(x) for x in wrapper)

    found: dict[int, list[tuple[tuple[str, ...], list]]] = {}

    def look(items: list, at: tuple[str, ...], seen: frozenset) -> None:
        for x in items:
            if x[0] in (TEXT, DEEP) or x[0].split(".")[0] in DROPPED or outside(x):
                continue
            k = mark(x[0])
            if k is not None and k not in seen:
                found.setdefault(k, []).append(((*at, x[0]), x))
            look(x[2], (*at, x[0]), seen | {k})

    look(wrapper, (), frozenset())
    chosen = next((found[k] for k in sorted(found) if 2 * sum(weight[id(x)] for _, x in found[k]) >= total), [])
    deep, named = False, bool(chosen)
    if not chosen:
        at, holder, most = (), ["", "1", wrapper], total
        while True:
            best = max((x for x in holder[2] if x[0] != TEXT), key=lambda x: weight[id(x)], default=None)
            if best is None or 2 * weight[id(best)] <= most:
                break
            if best[0] == DEEP:
                deep = True
                break
            if best[1] in "+*" or not any(x[0] == DEEP or x[0].split(".")[0] in BLOCK for x in best[2] if x[0] != TEXT):
                break
            at, holder, most = (*at, best[0]), best, weight[id(best)]
        chosen = [(at, holder)]
    wanted, fixed = set(), {}

    def gather(item: list) -> None:
        if item[0] in (TEXT, DEEP):
            fixed.update(item[3])
            return
        if aside(item[0]) and not outside(item):
            wanted.add(item[0])
        for x in item[2]:
            gather(x)

    for at, x in chosen:
        for y in x[2]:
            gather(y)
    size = sum(weight[id(y)] for _, x in chosen for y in x[2])
    template = frozenset(fixed) if not named and pages >= LEAST_PAGES and pages * sum(fixed.values()) < size else frozenset()
    return Region(frozenset(at for at, _ in chosen), frozenset(wanted), template, deep)


def marked(node: Node) -> list[Node]:
    """The elements below one that the best mark of MAIN names, in page order, however deep they lie."""
    found: dict[int, list[Node]] = {}
    todo = [c for c in reversed(node.children) if isinstance(c, Node)]
    while todo:
        c = todo.pop()
        if c.label.split(".")[0] in DROPPED or aside(c.label):
            continue
        k = mark(c.label)
        if k is not None:
            found.setdefault(k, []).append(c)
        else:
            todo += [x for x in reversed(c.children) if isinstance(x, Node)]
    return found[min(found)] if found else []


def regions(root: Node, where: Region) -> list[Node]:
    """All elements of a page at the region's paths, in page order."""
    if () in where.paths:
        return [root]
    starts = {p[:k] for p in where.paths for k in range(1, len(p) + 1)}
    out, todo = [], [(c, (c.label,)) for c in reversed(root.children) if isinstance(c, Node)]
    while todo:
        c, at = todo.pop()
        if at in where.paths:
            out.append(c)
        elif at in starts:
            todo += [(x, (*at, x.label)) for x in reversed(c.children) if isinstance(x, Node)]
    return out


def blocks(node: Node, where: Region | None = None) -> list[str]:
    """Texts of the blocks below an element, without unwanted elements and template texts; white space is one space."""
    wanted, template = (where.wanted, where.template) if where else (frozenset(), frozenset())
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip(" ")
        if text and not (template and all(text_hash(x) in template for x in run if x.strip())):
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:  # without recursion: pages may nest deeply
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            run.append(c)
        elif c is not node and (c.label.split(".")[0] in DROPPED or (aside(c.label) and c.label not in wanted)):
            if c.label.split(".")[0] in BLOCK | DROPPED - {"button", "input", "select", "script", "style", "svg"}:
                flush()
        else:
            name = c.label.split(".")[0]
            if name == "br":
                run.append(" ")
                continue
            edge = c is node or name in BLOCK
            if edge:
                flush()
                todo.append(None)
            todo += reversed(c.children)
    flush()
    return out


def extract(page: str, where: Region) -> str:
    """The article of a page: what its host's wrapper has as the main region, or the page's own where the page lacks it."""
    root = tree(page)
    found = regions(root, where)
    if not found:
        where = region(1, skeleton(root))
        found = regions(root, where)
    if where.deep:
        found = [x for n in found for x in marked(n) or [n]]
    return "\n\n".join(b for n in found for b in blocks(n, where))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = sorted({(h, pack(1, skeleton(tree(p or "")))) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)})
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([s for _, s in seen], pa.string())], ["host", "wrapper"])


def _merge(group: pa.Table) -> pa.Table:
    """One wrapper of all that a group holds, aligned one after another from the longest on."""
    ordered = sorted(set(group.column("wrapper").to_pylist()), key=lambda w: (-len(w), w))
    pages, merged = load(ordered[0])
    for w in ordered[1:]:
        more, other = load(w)
        pages, merged = pages + more, align(merged, other)
    return pa.table({"host": group.column("host").slice(0, 1), "wrapper": [pack(pages, merged)]})


def wrappers(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """Return host, wrapper: one union-free expression a host (as pack() writes it), from all its pages.

    Every page becomes the token tree of its elements and texts, with repeated neighbours as groups;
    equal trees of a host are one. They are aligned in rounds: each deals a host's trees by hash to
    groups of about FAN, so that no task holds more of a common host than that, until one is left.
    """
    slim = pages.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    out = table(slim.mapInArrow(_skeletons, "host string, wrapper string").distinct(), "trees")
    while True:
        many = table(out.groupBy("host").count().where("count > 1"), "tree-counts")
        if many.isEmpty():
            return out
        groups = out.join(many, "host", "left").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.ceil(F.coalesce("count", F.lit(1)) / FAN)))
        out = table(groups.select("host", "wrapper", "salt").groupBy("host", "salt").applyInArrow(_merge, "host string, wrapper string"), "trees")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return id_col, url_col, text, n_chars: one row per row of pages.

    text is the main region that the host's wrapper names, without menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and reader comments, and without texts that
    the wrapper shows to be template; blocks are joined by an empty line, white space inside one is
    a space, character references are decoded. Null and empty pages have an empty text; null URLs
    share one host; repeated rows are all extracted; other columns, whatever their names, are
    ignored; an empty table gives no rows.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"://([^/?#]*)", 1), F.lit(""))
    slim = pages.select(F.col(id_col), F.col(url_col), host.alias("_host"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_region_text(region(*load(w))) for w in batch.column(1).to_pylist()], pa.string())], ["_host", "_where"])

    known = table(wrappers(slim, "_host", "_html").select("host", "wrapper").mapInArrow(found, "_host string, _where string"), "regions")

    @F.arrow_udf("string")
    def main_text(html: pa.Array, where: pa.Array) -> pa.Array:
        seen: dict[str, Region] = {}
        out = []
        for page, w in zip(html.to_pylist(), where.to_pylist(), strict=True):
            if w not in seen:
                seen[w] = _region_of(w)
            out.append(extract(page or "", seen[w]))
        return pa.array(out, pa.string())

    out = slim.join(known, "_host", "left").select(F.col(id_col), F.col(url_col), main_text("_html", "_where").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def _region_text(r: Region) -> str:
    return json.dumps([sorted(map(list, r.paths)), sorted(r.wanted), sorted(r.template), r.deep])


def _region_of(text: str) -> Region:
    paths, wanted, template, deep = json.loads(text)
    return Region(frozenset(map(tuple, paths)), frozenset(wanted), frozenset(template), deep)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
