"""Operator 2: main text of web pages by a site style tree.

The DOMs of a host are merged by style: a node of the tree is a path of tags with their
classes. A presentation node matters as far as its children vary from page to page
(entropy, to the base of its pages), a content node as far as its text does; both start
from the belief that a node matters, which weighs as much as a page and a half. How a node
looks is evidence in the tree as well: noise elements and roles, class words (strong ones,
and others that are in the names of articles too), links that make up most of its text,
standing beside an article. Each weighs the importance down, and what is left of a branch
decides, inside an article as outside. Menus and adverts differ from page to page as
articles do, so entropy alone would keep them. A block of a doubtful name inside an article
stands or falls by the tree: it stays while its text varies and isn't mostly links.

Looks are judged by page first: where a page's only article lies under a noisy name, or
nothing else is left of it, such names don't count there.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import materialize, small_batches, text_of
from .neardup import maybe_broadcast

LEAST_IMPORTANCE = 0.3
LEAST_IN_ARTICLE = 0.15
PRIOR_PAGES = 1.5
DECAY = 0.9
# What is left of a node's importance by its looks.
LOOKS = {"noise": 0.25, "doubtful": 0.6, "beside": 0.25, "links": 0.25}
LINKS = 66  # percent of a text

_START = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)|<[!?]")
_END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*+)\s*+>")
_MARK = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "xmp", "noembed", "noframes")}
# Fixed lists of HTML elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio".split())
_GONE = frozenset("nav footer aside form button select option input label dialog menu search head fieldset".split())
_FORM = frozenset("form fieldset".split())  # some sites wrap whole pages in one
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
_WALLS = frozenset("article section aside main div td th table body html blockquote li form nav footer header figure".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidebars rail aside menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead footer foot footnav comment comments commentlist respond replies reply disqus discussion share sharing social related recommended recommendations more widget widgets pagination pager login search skip".split()
)
# Names of these words are noise if the tree doesn't speak against it.
_DOUBTFUL = frozenset("more skip login search social widget widgets alert overlay rail reply discussion signup masthead promoted share sharing notice".split())
_HEADS = frozenset(("header", "masthead"))
_MAIN = frozenset(("main", "article"))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _style(tag: str, raw: str) -> tuple[str, int, bool]:
    """(style, noise, main) of an element; noise is 0, 1 by doubtful words, 2 by other words or as a form, 3 by its element or role."""
    noise, main, names = 2 if tag in _FORM else 3 * (tag in _GONE), tag in _MAIN, ""
    if len(raw) > 4:
        a = _attributes(raw)
        names = ".".join(sorted(set((a.get("class", "") + " " + a.get("id", "")).lower().split())))
        words = set(re.split(r"[^a-z]+", names))
        words |= {re.sub(r"\d+$", "", w) for w in names.split(".")}
        main = main or a.get("role", "") == "main" or a.get("itemprop", "") == "articleBody"
        if a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden", "") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            noise = 3
        if tag not in ("html", "body", "main") and words & _WORDS and not (tag in _MAIN and not words & {"comment", "comments", "ad", "related", "promo", "sponsored", "reply"}):
            noise = max(noise, 2 if words & (_WORDS - _DOUBTFUL) else 1)
        if words & _HEADS and tag in ("div", "section"):
            tag = "header"
    if tag == "header":
        names = names or "header"
    return (f"{tag}.{names}" if names else tag), noise, main


class _Node:
    __slots__ = ("tag", "path", "noise", "main", "children", "text", "held", "links")

    def __init__(self, tag: str, path: int, noise: int, main: bool, held: list[str] | None = None):
        self.tag, self.path, self.noise, self.main, self.children, self.text, self.held, self.links = tag, path, noise, main, [], [], held, 0


def _path(parent: int, style: str) -> int:
    """64 bits that stand for all styles from the root."""
    return int.from_bytes(hashlib.blake2b(parent.to_bytes(8, "little", signed=True) + style.encode(), digest_size=8).digest(), "little", signed=True)


def looks(blocks: list[tuple[int, str, int, bool]]) -> list[tuple[int, str, int, bool]]:
    """Blocks (path, text, noise, main) with noise 0, 1 or 2 (none, doubtful, sure) as the page as a whole tells it.

    If all articles lie under noisy names, names that are no noisier than the least noisy article don't count; nor
    do names and forms if nothing else is left. Elements and roles always do. Doubtful names don't take a block out of its article.
    """
    mains = [b[2] for b in blocks if b[3]]
    allowed = min(2, min(mains or [b[2] for b in blocks], default=0))
    out = []
    for path, text, noise, main in blocks:
        sure = 0 if noise <= allowed and (main or not mains) else 1 if noise == 1 else 2 if noise else 0
        out.append((path, text, sure, main and sure < 2))
    return out


class _Tokens:
    """The markup of a page, found in time linear in its length whatever it holds."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in (">", '"', "'")}
        self.seen = (0, -1)  # no mark lies from the first place up to the second
        self.open_quotes: set[int] = set()  # quotes from which no end of a tag outside quotes was found
        self.end_tags: dict[str, int] | None = None

    def find(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag, comment or declaration; the last two have no name."""
        m = _START.search(self.page, at)
        if m is not None and m[0] != "<!--" and m.end() > self.last[">"]:  # nothing but a comment can come
            start = self.page.find("<!--", m.start())
            return None if start < 0 else (start, self._comment_end(start), "", "", "")
        if m is None:
            return None
        if m[0] == "<!--":
            return m.start(), self._comment_end(m.start()), "", "", ""
        if not m[2]:
            return m.start(), self.page.find(">", m.end()) + 1, "", "", ""
        end = self._tag_end(m.end())
        return m.start(), end + 1, m[1], m[2].lower(), self.page[m.end() : end]

    def _comment_end(self, start: int) -> int:
        end = self.page.find("-->", start + 4)
        return len(self.page) if end < 0 else end + 3

    def _mark(self, at: int) -> int:
        """The place of the next bracket or quote."""
        if not self.seen[0] <= at <= self.seen[1]:
            m = _MARK.search(self.page, at)
            self.seen = (at, m.start() if m else len(self.page))
        return self.seen[1]

    def _tag_end(self, at: int) -> int:
        """The first > outside quotes, or the first at all where quotes never let one out."""
        if self.page.startswith(">", at):
            return at
        place, passed = at, []
        while True:
            place = self._mark(place)
            if place < len(self.page) and self.page[place] == ">":
                return place
            if place == len(self.page) or place in self.open_quotes or self.last[self.page[place]] == place:
                break
            passed.append(place)
            place = self.page.find(self.page[place], place + 1) + 1
        self.open_quotes.update(passed)
        return self.page.find(">", at)

    def ends(self, name: str, at: int) -> bool:
        """Whether an end tag of that name is still to come."""
        if self.end_tags is None:
            self.end_tags = {m[1].lower(): m.start() for m in _END_TAG.finditer(self.page)}
        return self.end_tags.get(name, -1) >= at


def parse(page: str) -> tuple[list[tuple[int, str, int, bool]], list[tuple[int, int, int, int, int]]]:
    """(blocks, nodes) of a page: blocks (path, text, noise, in main); nodes (path, depth, hash of the children's styles, hash of the own text, percent of links). A path is a hash of all its styles.

    A dropped inline or custom element is on the stack up to its end tag or that of a block around it, and holds
    the text before it, which goes on behind it; one whose end tag never comes is passed over.
    """
    root = _Node("", 0, 0, False)
    stack, blocks, nodes, pending = [root], [], [], []
    linked, in_link = 0, False
    inline: dict[str, int] = {}  # dropped inline elements on the stack by tag
    places: dict[str, list[int]] = {}  # where the open elements of a tag are on the stack
    holders: list[int] = []

    def flush() -> None:
        nonlocal linked
        if pending:
            size = sum(map(len, pending))
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                top = stack[-1]
                top.text.append(text)
                top.links += min(linked, size)
                blocks.append((top.path, text, top.noise, top.main))
        linked = 0

    def push(node: _Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        if node.held is not None:
            holders.append(len(stack))
        stack.append(node)

    def close(upto: int) -> None:
        while len(stack) > upto:
            flush()
            n = stack.pop()
            if stack:
                places[n.tag].pop()
            if n.held is not None:
                holders.pop()
                inline[n.tag] -= 1
                pending[:] = n.held
                continue
            text = "\n".join(n.text)
            nodes.append((n.path, len(stack), zlib.crc32(" ".join(n.children).encode()), zlib.crc32(text.encode()) if text else -1, min(100, 100 * n.links // max(1, len(text)))))

    def find(tags, walls=(), implied=False) -> int:
        """The innermost open element of tags, 0 if there is none or a wall (or a held element) is further in."""
        k = 0
        for t in tags:
            if (held := places.get(t)) and held[-1] > k:
                k = held[-1]
        if not k or implied and holders and holders[-1] > k:
            return 0
        for w in walls:
            if (held := places.get(w)) and held[-1] > k:
                return 0
        return k

    tokens, at, n = _Tokens(page), 0, len(page)
    while at < n:
        found = tokens.find(at)
        if found is None:
            pending.append(page[at:])
            break
        start, after, slash, tag, raw = found
        if start > at:
            pending.append(page[at:start])
            linked += (start - at) * in_link
        at = after
        if not tag:
            continue
        if tag == "a":
            in_link = not slash
        if slash:
            if tag == "br":
                pending.append(" ")
            elif tag in _BLOCK:
                k = find((tag,), () if tag in ("body", "html", "article", "main", "div", "section") else ("article", "main"))
                if k:
                    close(k)
                elif tag == "p":
                    flush()
            elif inline.get(tag):
                close(find((tag,)))
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            if end is None:
                at = n
            else:
                at = page.find(">", end.start()) + 1 or n
            continue
        if tag == "br" or tag == "wbr":
            pending.append(" " if tag == "br" else "")
            continue
        if tag not in _BLOCK:
            if tag not in _VOID and (inline.get(tag) or tag in _GONE or len(raw) > 4 and _style(tag, raw)[1]) and tokens.ends(tag, at):
                push(_Node(tag, _path(stack[-1].path, tag), 3, False, [*pending]))
                inline[tag] = inline.get(tag, 0) + 1
                pending.clear()
            continue
        flush()
        if tag in _CLOSES:
            k = find(*_CLOSES[tag], implied=True)
            if k:
                close(k)
        if tag != "option":
            k = find(("p",), _WALLS, implied=True)
            if k:
                close(k)
        if tag == "hr":
            continue
        style, noise, main = _style(tag, raw)
        parent = stack[-1]
        if tag in ("html", "body") and find((tag,)):
            continue
        parent.children.append(style)
        if style.startswith("header") and not parent.main:
            noise = 3
        main = main or parent.main
        push(_Node(tag, _path(parent.path, style), max(parent.noise, noise), main))
    close(1)
    flush()
    return looks(blocks), nodes


_PARSED = "page_id long, url string, host string, digest long, blocks array<struct<path:long,text:string,noise:int,main:boolean>>, nodes array<struct<path:long,depth:int,children:long,text:long,links:int>>"
_TYPES = [
    pa.list_(pa.struct([("path", pa.int64()), ("text", pa.string()), ("noise", pa.int32()), ("main", pa.bool_())])),
    pa.list_(pa.struct([("path", pa.int64()), ("depth", pa.int32()), ("children", pa.int64()), ("text", pa.int64()), ("links", pa.int32())])),
]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            blocks, nodes = [], []
            for page in part.column(4):
                b, n = parse(page.as_py())
                blocks.append([{"path": x[0], "text": x[1], "noise": x[2], "main": x[3]} for x in b])
                nodes.append([{"path": x[0], "depth": x[1], "children": x[2], "text": x[3], "links": x[4]} for x in set(n)])
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(blocks, _TYPES[0]), pa.array(nodes, _TYPES[1])], names=["page_id", "url", "host", "digest", "blocks", "nodes"])


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, path, pages, content, links, importance) of each style node: both entropies over the host's different pages, the share of links in percent."""
    pages = parsed.dropDuplicates(["host", "digest"])  # copies of a page vary in nothing
    node = pages.select("host", F.explode("nodes").alias("n")).select("host", "n.path", "n.depth", "n.children", "n.text", "n.links")
    counts = node.groupBy("host", "path", "depth", "children", "text").agg(F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col("text") >= 0, F.col("links"))).alias("links"), F.count_if(F.col("text") >= 0).alias("told"))

    def entropy(column: str) -> DataFrame:
        by = counts.groupBy("host", "path", column).agg(F.sum("c").alias("c"), F.min("depth").alias("depth"), F.sum("links").alias("links"), F.sum("told").alias("told"))
        return by.groupBy("host", "path").agg(F.sum("c").alias("m"), F.min("depth").alias("depth"), F.sum(F.col("c") * F.ln("c")).alias("x"), F.max(F.col(column)).alias("most"), (F.sum("links") / F.sum("told")).alias("links"))

    scale = lambda: F.when(F.col("m") > 1, F.ln("m") - F.col("x") / F.col("m")).otherwise(F.lit(1.0)) / F.when(F.col("m") > 1, F.ln("m")).otherwise(F.lit(1.0))
    shown = entropy("children").select("host", "path", "depth", F.col("m").alias("pages"), scale().alias("presentation"))
    told = entropy("text").select("host", "path", F.when(F.col("most") >= 0, scale()).alias("content"), "links")
    weight = F.pow(F.lit(DECAY), F.col("depth"))
    both = shown.join(told, ["host", "path"])
    seen = F.when(F.col("content").isNull(), F.col("presentation")).otherwise((1 - weight) * F.greatest("presentation", "content") + weight * F.col("content"))
    return both.select("host", "path", "pages", "content", F.coalesce("links", F.lit(0.0)).alias("links"), ((seen * F.col("pages") + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)).alias("importance"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page, from its whole html.

    Null html is empty; a page without main text gives an empty string; a page without a url belongs to a host of
    its own kind (''), copies of a page count once in the tree. Blocks of equal text stand or fall by their style, not
    by their text. A very long page is one tree. Repeated rows repeat; other columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.xxhash64("html").alias("digest"), text_of("html").alias("html"))
    parsed = materialize(src.mapInArrow(_parsed, _PARSED), "parsed_pages", "zstd")
    # Nodes that matter fully look the same to every page, so only the others are kept: (path, importance in percent, mostly links).
    low = style_tree(parsed).filter(F.col("content").isNotNull() & ((F.col("importance") < 1) | (F.col("links") > LINKS)))
    low = low.filter((F.col("importance") < LEAST_IMPORTANCE / LOOKS["doubtful"]) | (F.col("links") > LINKS))
    low = materialize(low.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("importance", (F.col("links") > LINKS).alias("links"))))).alias("low")), "low_branches")
    rows = parsed.select("page_id", "url", "host", "blocks").join(maybe_broadcast(low, 100_000, "low"), "host", "left")
    bounded = F.exists("blocks", lambda b: b.main & (b.noise == 0))
    known = F.coalesce("low", F.create_map().cast("map<bigint,struct<importance:double,links:boolean>>"))

    def kept(b):
        node = F.try_element_at(known, b.path)
        worth = F.coalesce(node["importance"], F.lit(1.0))
        worth = worth * F.when(b.noise == 2, LOOKS["noise"]).when(b.noise == 1, LOOKS["doubtful"]).otherwise(1.0)
        worth = worth * F.when(bounded & ~b.main, LOOKS["beside"]).otherwise(1.0)
        sure = b.main & (b.noise == 0)
        worth = worth * F.when(F.coalesce(node["links"], F.lit(False)) & ~sure, LOOKS["links"]).otherwise(1.0)
        return worth >= F.when(sure, LEAST_IN_ARTICLE).otherwise(LEAST_IMPORTANCE)

    text = F.array_join(F.transform(F.filter("blocks", kept), lambda b: b.text), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
