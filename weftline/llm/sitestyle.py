"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: an element node is a path
of tags with their class and id, and each page adds the style its node has
there, the sequence of its children. The presentation importance of a node is
the entropy of its styles over the m pages that have it, as a share of what
MANY_PAGES pages of styles of their own would give; its content importance
falls with the entropy of each content over those pages, so what all pages
share counts for nothing. Both are combined with the weight GAMMA ** styles. A
node that fewer than MANY_PAGES pages of a host have is judged by the tree of
all hosts, and one that fewer than LEAST_PAGES pages of all have is not judged.

On every page branches whose importance is low are left out. A template's fixed
parts (menus, adverts, footers) may fill with other words on each page, but
look alike, so text must also stand in a branch whose presentation is
important: of the nodes above it that are judged, one must reach STANDING.
Branches whose tag or class names a role that is never main text go too. A
page's mark of its article is a weight: MARKED inside, where it also counts for
the presentation, zero outside. Within an article a role named by a class or id
is a weight too, ROLE, on the importance that the tree gives; only where the
tree cannot judge does the name decide.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.llm.urlfilter import host_of
from weftline.session import materialise

GAMMA, LOW = 0.9, 0.2
#: A node is judged by a tree only if so many of its pages have it.
LEAST_PAGES = 4
#: Presentation of full importance is as varied as that of so many pages that all
#: differ; a host's own tree speaks for nodes of so many pages.
MANY_PAGES = 16
#: Presentation importance that a branch with main text reaches.
STANDING = 0.4
#: Weight of the importance of what a page marks as its article.
MARKED = 2.0
#: Weight of the importance of a node whose class or id names a role, inside an article.
ROLE = 0.25
#: Judged nodes that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000

# Fixed values of HTML: elements without an end tag, with raw text, and that break lines.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object textarea title svg canvas audio video annotation annotation-xml".split())
# Of these, what holds no markup: it ends at the first end tag, or with the page.
_CODE = frozenset("script style textarea title".split())
# Of these, what a slash ends in HTML.
_FOREIGN = frozenset("svg annotation annotation-xml".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("br caption td th tr tbody thead tfoot option legend head html body title".split())
_CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_SCOPE = frozenset("ul ol dl table article section div main aside nav header footer form body html blockquote td th".split())
# Roles that are never main text, by tag, by ARIA role, and by the words of a class or id.
_NOISE_TAGS = frozenset("nav aside form footer button select dialog menu search input label fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner promo promotion sponsor sponsored sidebar aside rail widget menu nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search social share sharing follow related recommended recommendations pagination pager comment comments commentlist disqus respond reply replies toolbar legal copyright skip".split()
)
# Roles that are noise on the page but may be part of an article.
_OUTER_TAGS = frozenset(["header"])
_OUTER_WORDS = frozenset("header masthead banner topbar legal copyright skip rail".split())
# What readers write differs on every page, so the tree cannot know it; these names decide anywhere.
_READER_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
# Words that say nothing of a role; a name of other words besides ("share-price") is no role.
_PLAIN_WORDS = frozenset(
    "site page main primary secondary left right top bottom upper lower inner outer side first last box bar block container wrapper wrap content area section region zone slot unit panel group list links link item items row col column button buttons btn icon icons form field module component inline post posts article articles entry entries story stories thread count text title heading label mobile desktop sticky fixed the and of for in a to us js is has".split()
)
# Elements whose id is an anchor to their text.
_ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 hgroup section p a li dt dd span b i em strong td th tr figure figcaption blockquote pre".split())
_MAIN_TAGS = frozenset(["article", "main"])
_MAIN_WORDS = frozenset("articlebody entry-content post-content article-content article-body main-content".split())

# A quote opens a value only after an equals sign; what ends no tag is taken to the page's end, so each byte is read once.
_VALUES = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+){_VALUES}(>|\Z)|<[!?][^>]*>?", re.S)
_ATTR = re.compile(r"""([^\s=/>][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
#: Elements nested deeper stand beside each other at this depth, as browsers have it.
MAX_DEPTH = 128
_READ = frozenset(["class", "id", "role", "hidden", "itemprop"])
_WORD = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "sign", "noise", "named", "main", "path", "kids")

    def __init__(self, tag, sign, noise, named, main, path):
        self.tag, self.sign, self.noise, self.named, self.main, self.path, self.kids = tag, sign, noise, named, main, path, []


@lru_cache(maxsize=65536)
def _role_words(names: str) -> frozenset[str]:
    """The role words of those names that consist of role words and plain words only."""
    found = set()
    for name in names.split():
        words = set(_WORD.findall(name))
        if words <= _NOISE_WORDS | _PLAIN_WORDS:
            found |= words & _NOISE_WORDS
    return frozenset(found)


def _role(tag: str, attrs: dict[str, str], inside: bool) -> tuple[bool, bool, bool]:
    """(never main text, named so where the tree may object, marks the main text) of an element.

    ``inside`` tells that it is part of an article.
    """
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    main = tag in _MAIN_TAGS or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody" or bool(_MAIN_WORDS & set(named.split()))
    noise = tag in _NOISE_TAGS or not inside and tag in _OUTER_TAGS or attrs.get("role", "").lower() in _NOISE_ROLES or "hidden" in attrs
    words = frozenset()
    if not main and not noise and named.strip():
        words = _role_words(attrs.get("class", "").lower() if tag in _ANCHORS else named)
        if inside:
            words -= _OUTER_WORDS
        noise = bool(words and not inside or words & _READER_WORDS)
    return noise, bool(words and not noise), main


def _raw_ends(page: str, tag: str) -> dict[int, int]:
    """Where each raw element of a tag ends, by the end of its start tag; elements without an end tag of their own are left out."""
    ends, open_at = {}, []
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<(/?){re.escape(tag)}(?=[\s/>]){_VALUES}(>|\Z)", page, re.I | re.S):
        if not m.group(3):
            continue
        if not m.group(1):
            if not (tag in _FOREIGN and m.group(2).endswith("/")):
                open_at.append(m.end())
        elif open_at:
            ends[open_at.pop()] = m.end()
    return ends


class _Stack:
    """The open elements, with the places of each tag, so that looking one up does not walk them."""

    def __init__(self):
        self.nodes = [_Node("#", "#", False, False, False, 0)]
        self.paths, self.named = [0], []
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.above: dict[int, tuple[int, ...]] = {}
        self.noise = self.main = 0

    def push(self, node: _Node) -> None:
        i = len(self.nodes)
        self.nodes.append(node)
        self.paths.append(node.path)
        self.at.setdefault(node.tag, []).append(i)
        if node.tag in _SCOPE:
            self.scopes.append(i)
        if node.named:
            self.named.append(node.path)
        self.noise += node.noise
        self.main += node.main

    def cut(self, i: int) -> None:
        """Close all elements from place ``i`` on."""
        while len(self.nodes) > max(i, 1):
            node = self.nodes.pop()
            self.paths.pop()
            self.at[node.tag].pop()
            if node.tag in _SCOPE:
                self.scopes.pop()
            if node.named:
                self.named.pop()
            self.noise -= node.noise
            self.main -= node.main

    def last(self, tag: str) -> int:
        """The place of the innermost element of a tag, 0 if none is open."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def scope(self, but: tuple[str, ...] = ()) -> int:
        """The place of the innermost scope, 0 if none is open; of the tags ``but`` none counts."""
        for i in reversed(self.scopes):
            if self.nodes[i].tag not in but:
                return i
        return 0

    def context(self) -> tuple:
        # A path tells all paths above it, so pieces of equal places share them.
        own = self.paths[-1]
        above = self.above.get(own)
        if above is None:
            above = self.above[own] = tuple(self.paths[1:])
        return self.noise > 0, self.main > 0, above, tuple(self.named)


def parse(page: str):
    """The pieces of a page, (text, noise, in article, nodes above, those named for a role, block), and all its nodes.

    Blocks end at block elements and line breaks; an element within a line that
    has a role of its own is a piece of its block. End tags may be missing, and
    what follows an unclosed tag at the end of the page is dropped. A raw
    element without an end tag is left out alone, unless it is code or a title.
    White space of a piece is as in the page. Elements deeper than MAX_DEPTH
    are taken as siblings. Each byte of a page is read a bounded number of times.
    """
    stack, pieces, text, ends, block = _Stack(), [], [], {}, 0
    nodes = [stack.nodes[0]]

    def piece():
        if text:
            line = entities.unescape("".join(text))
            text.clear()
            if line:
                pieces.append((line, *stack.context(), block))

    def flush():
        nonlocal block
        piece()
        block += 1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = rest.find("</")
            text.append(rest if cut < 0 or not re.match(r"</[a-zA-Z!]", rest[cut:]) else rest[:cut])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        if not m.group(4):
            # A tag that the page's end cuts short is no text.
            break
        tag, values = tag.lower(), m.group(3)
        if m.group(1):
            i = stack.last(tag)
            if tag in _BLOCK:
                flush()
                if i:
                    stack.cut(i)
            elif i and i >= stack.scope() and not stack.last("p") > i:
                if any(x.noise or x.named or x.main for x in stack.nodes[i:]):
                    piece()
                stack.cut(i)
            continue
        if tag in _BLOCK:
            flush()
        if tag in _RAW:
            stack.nodes[-1].kids.append(tag)
            if tag in _CODE:
                end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                at = end.end() if end else n
            elif not (tag in _FOREIGN and values.endswith("/")):
                if tag not in ends:
                    ends[tag] = _raw_ends(page, tag)
                at = ends[tag].get(at, at)
            continue
        if tag in _ENDS_P and (i := stack.last("p")) and i > stack.scope():
            flush()
            stack.cut(i)
        closed = _CLOSED_BY.get(tag)
        if closed:
            i = max(map(stack.last, closed))
            if i and i >= stack.scope(("td", "th") if tag in ("tr", "td", "th") else ()):
                flush()
                stack.cut(i)
        attrs = {k: a.group(2) or a.group(3) or a.group(4) or "" for a in _ATTR.finditer(values) if (k := a.group(1).lower()) in _READ} if values else {}
        sign = " ".join((tag, attrs.get("class", ""), attrs.get("id", "")))
        if len(stack.nodes) > MAX_DEPTH and tag not in _VOID:
            piece()
            stack.cut(MAX_DEPTH)
        stack.nodes[-1].kids.append(sign)
        if tag in _VOID:
            continue
        noise, role, main = _role(tag, attrs, stack.main > 0)
        if noise or role or main:
            piece()
        node = _Node(tag, sign, noise, role, main, hash_of(f"{stack.nodes[-1].path} {sign}"))
        if not values.rstrip().endswith("/") or tag in _BLOCK:
            stack.push(node)
        nodes.append(node)
    flush()
    return pieces, nodes


def lines(pieces) -> list[str]:
    """The texts of the blocks of some pieces: white space is one space, and blocks without text are left out."""
    of: dict[int, list[str]] = {}
    for p in pieces:
        of.setdefault(p[5], []).append(p[0])
    found = (_WHITE.sub(" ", "".join(x)).strip() for x in of.values())
    return [x for x in found if x]


@lru_cache(maxsize=65536)
def hash_of(text: str) -> int:
    """A signed 64-bit hash of a text, the same in every process."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _tree_rows(batches):
    """(host, node, kind, value): for each page and node its style (0) and its content (1), and whether it is named for a role (2)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            host, node, kind, value = [], [], [], []
            part = batch.slice(at, 256)
            for h, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not page:
                    continue
                pieces, nodes = parse(page)
                styles, content, role = {}, {}, {x.path: [] for x in nodes if x.named}
                for x in nodes:
                    styles.setdefault(x.path, []).append("|".join(x.kids))
                for text, _, _, above, _, _ in pieces:
                    line = _WHITE.sub(" ", text).strip()
                    for p in above if line else ():
                        content.setdefault(p, []).append(line)
                for k, of in ((0, styles), (1, content), (2, role)):
                    for p, v in of.items():
                        if p:
                            host.append(h)
                            node.append(p)
                            kind.append(k)
                            # Whole texts must not fill the cache.
                            value.append(hash_of.__wrapped__("\n".join(v)))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(node, pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64())], names=["host", "node", "kind", "value"])


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, node, pages, presentation, importance, named) of every node of every host.

    A node that fewer than MANY_PAGES pages of its host have is given what the
    tree of all hosts, its own among them, says of it. ``named`` counts the pages on which the class or
    id names a role.
    """
    named = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = named.mapInArrow(_tree_rows, "host string, node long, kind int, value long")
    # Counts per value come first, partly before the shuffle, so no host meets in one task.
    per = materialise(rows.groupBy("host", "node", "kind", "value").agg(F.count(F.lit(1)).alias("c")), "style-counts")
    own = _importances(per, ["host", "node"])
    rare = F.col("pages") < MANY_PAGES
    every = _importances(per.groupBy("node", "kind", "value").agg(F.sum("c").alias("c")), ["node"])
    few = own.where(rare).select("host", "node").join(every, "node").select(own.columns)
    return own.where(~rare).unionByName(few)


def _importances(counts: DataFrame, of: list[str]) -> DataFrame:
    """The nodes of a tree, told by the columns ``of``, from how many pages have each style, content and role."""
    c = F.col("c").cast("double")
    style, content = F.when(F.col("kind") == 0, c), F.when(F.col("kind") == 1, c)
    xlogx = lambda c: c * F.log(F.greatest(c, F.lit(1.0)))
    node = counts.groupBy(*of).agg(F.sum(style).alias("m"), F.count(style).alias("styles"), F.sum(xlogx(style)).alias("sx"), F.sum(content).alias("cm"), F.sum(xlogx(content)).alias("cx"), F.sum(F.when(F.col("kind") == 2, c)).alias("named"))
    entropy = F.log("m") - F.col("sx") / F.col("m")
    presentation = F.least(F.lit(1.0), entropy / F.log(F.greatest(F.lit(2.0), F.least("m", F.lit(float(MANY_PAGES))))))
    matter = F.coalesce(1 - F.col("cx") / F.col("cm") / F.log(F.greatest("m", F.lit(2.0))), F.lit(0.0))
    weight = F.pow(F.lit(GAMMA), "styles")
    node = node.withColumn("presentation", presentation)
    importance = F.when(F.col("m") <= 1, 1.0).otherwise((1 - weight) * F.col("presentation") + weight * matter)
    return node.select(*of, F.col("m").cast("long").alias("pages"), "presentation", importance.alias("importance"), F.coalesce("named", F.lit(0.0)).cast("long").alias("named"))


def _main_blocks(page: str, low: set[int], lower: set[int], own: set[int], flat: set[int], tall: set[int]) -> list[str]:
    """The blocks of a page that the judged nodes above them leave.

    Blocks under a node of low importance go, and blocks with nodes above that
    are ``flat`` and none that is ``tall``. Inside a marked article just ``lower``
    are so low, and of the nodes named for a role those that are not ``own`` to
    their pages.
    If nothing of the article is left, the mark says nothing and the page counts
    as one without. If no block stands out, as where all pages look alike, only
    importance decides; if that has nothing either, as where all are copies,
    the article, or without one the page, stays whole.
    """
    blocks = [b for b in parse(page)[0] if not b[1] and own.issuperset(b[4]) and not b[0].isspace()] if page else []
    marked = [b for b in blocks if b[2]]
    left = [b for b in marked if not lower.intersection(b[3])]
    if not left:
        some = [b for b in blocks if not low.intersection(b[3])]
        left = [b for b in some if tall.intersection(b[3]) or not flat.intersection(b[3])] or some or marked or blocks
    return lines(left)


#: The lists of a host's nodes that ``main_text`` passes on, in the order of ``_main_blocks``.
_LISTS = ("low", "lower", "own", "flat", "tall")


def _texts(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for page, *nodes in zip(*(part.column(width + i).to_pylist() for i in range(1 + len(_LISTS))), strict=True):
                    out.append("\n".join(_main_blocks(page, *(set(x or ()) for x in nodes))))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(width)), pa.array(out, pa.string())], names=[*part.schema.names[:width], "text"])

    return run


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` (all by default) with ``text`` and ``n_chars``.

    Blocks are joined by one line feed in page order, white space in a block is
    one space. A null or empty page, or one without main text, gives an empty
    text. A null url has an empty host, which is a host like others. Repeated
    rows count as pages of their own in the style tree. Very long pages are read
    whole. A node counts as low below the bounds and stands out at or above
    them, so ties are settled. Columns of ``pages`` of these two names are
    replaced; an empty table stays empty.
    """
    cols = [c for c in (keep or pages.columns) if c not in ("text", "n_chars")]
    importance, role = F.col("importance"), F.col("named") > 0
    tests = (importance < LOW, importance * MARKED < LOW, role & (importance * ROLE >= LOW), F.col("presentation") < STANDING, F.col("presentation") >= STANDING)
    judged = style_tree(pages, url_col, html_col).where(F.col("pages") >= LEAST_PAGES)
    lists = materialise(judged.groupBy("host").agg(*(F.collect_list(F.when(t, F.col("node"))).alias(k) for k, t in zip(_LISTS, tests, strict=True))), "judged-nodes")
    if lists.select(F.coalesce(F.sum(F.size("flat") + F.size("tall")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    kept = [F.col(f"`{c}`") for c in cols]
    named = pages.select(*kept, F.col(f"`{html_col}`").alias("__html"), host_of(F.col(f"`{url_col}`")).alias("__host"))
    joined = named.join(lists.withColumnsRenamed({"host": "__host"} | {k: f"__{k}" for k in _LISTS}), "__host", "left").select(*kept, "__html", *(f"__{k}" for k in _LISTS))
    schema = pages.select(*kept).schema.add("text", "string")
    out = joined.mapInArrow(_texts(len(cols)), schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
