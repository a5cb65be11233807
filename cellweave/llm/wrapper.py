"""Main-text extraction by wrapper induction.

1. Every page is parsed into a tree of block elements.  Neighbouring siblings of one label
   (tag and classes) are one node of the page's skeleton, so a run of paragraphs or list
   items is a repeated slot.  Each node gets a checksum of its text.
2. A host's reference is its commonest skeleton.  Each page's skeleton is aligned with it by
   simple tree matching (the largest order- and parent-preserving matching).
3. Over all pages of the host, the aligned nodes are counted by distinct texts, and nodes that
   do not align by host and path of labels, so that other layouts have a template too.  What is
   counted is not pages but the different texts that the rest of their content has, so copies
   of an article count once.  A node whose text hardly varies belongs to the template; a slot
   whose text varies holds content.
4. A page's text is the blocks of its content slots inside the main element if it has one
   (article, main, or a name of only such words), else all content slots.  What markup itself
   declares to be a menu, header, footer, sidebar, notice, advert, form, script, style or comment
   section, by its element or by a name of only such words, is template on any host, as are pages'
   own unmatched nodes of that kind; an article's own header is content, and inside a main element words that
   may name a part of a text decide nothing.  A form or sidebar that holds a main element or most of the page's text is
   none; where there is a `main`, articles outside it are teasers.  Inside a main
   element a node is template only with one single text beside ten different contents or more, and
   beside half of the different contents that its parent has; nor does a page lose all its text.

A null or empty page gives an empty text; a null url or one without a host makes one group.
Repeated rows are extracted alike.  Statistics are sums per host and node, combined before
they are shuffled, so a hot host is spread over all tasks.  The templates (a small row for
each host) are broadcast up to ``max_broadcast`` hosts and joined beyond.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _runtime as R

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|[^<]+", re.S)
_TAG = re.compile(r"</?[a-zA-Z](?:[^>\"']++|\"[^\"]*\"|'[^']*')*+")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'<>/=])([^\s\"'<>/=]++)\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=[\s/>])")
#: Element names by role: fixed by the HTML standard.
_RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html head body nav header footer aside article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption pre blockquote figure figcaption address details summary form fieldset legend dialog menu center template button select svg object audio video canvas".split()
)
_SPACED = frozenset("br td th option hr".split())
_CLOSES_P = _BLOCK - frozenset("button select svg object audio video canvas html head body".split())
_CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "tbody": ("thead tbody tr", ("table",)), "tfoot": ("thead tbody tr", ("table",))}
#: What markup declares to be no main text: elements, and words of class, id or role.
_AWAY = frozenset("head nav header footer aside form script style textarea title noscript iframe noframes xmp template button select svg dialog menu object audio video canvas".split())
_AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus discussion replies social share sharing related recommended breadcrumb breadcrumbs pagination pager widget toolbar complementary contentinfo search".split()
)
_MAIN = frozenset("article main".split())
_MAIN_WORDS = frozenset("article content post entry story maincontent".split())
#: Of these, what an article may have of its own: words that also name parts of a text.
_OWN_WORDS = frozenset("header masthead banner discussion replies promo promotion notice notices search menu navigation social sponsor login signup modal overlay popup toolbar widget footer sidebar pager consent complementary recommended".split())
#: Words that leave the role of a name as the others have it: `post-comments`, `ad-box`, `article-body`.
_NEUTRAL = frozenset("main page site post posts entry article articles top bottom left right inner outer wrap wrapper container box block area bar list item items links section body text".split())
_MAX_DEPTH, _MAX_CHILDREN = 48, 32
_WORD = (1 << 63) - 1


class Page:
    """Nodes of the skeleton (label, parent), and the page's blocks as (node, text) in order."""

    def __init__(self, source: str):
        self.labels, self.parents = ["#"], [-1]
        self.away, self.main = [False], [-1]  # main: the outermost main element above, or -1
        self.blocks: list[tuple[int, str]] = []
        self._wraps: list[int] = []  # forms and sidebars, which may turn out to hold the page
        self._whole: set[int] = set()  # main elements that are `main` itself
        self._last: list[int] = [-1]  # of each node its last child, and of wide ones all by label
        self._wide: dict[int, dict[str, int]] = {}
        self._count: list[int] = [0]
        self._read(source)
        self._settle()

    def _node(self, parent: int, label: str, role: Role) -> int:
        last = self._last[parent]
        if last >= 0 and self.labels[last] == label:
            return last
        if self._count[parent] >= _MAX_CHILDREN:
            known = self._wide.get(parent)
            if known is None:
                known = self._wide[parent] = {self.labels[k]: k for k in range(len(self.labels) - 1, parent, -1) if self.parents[k] == parent}
            if label in known:
                return known[label]
            known[label] = len(self.labels)
        self.labels.append(label)
        self.parents.append(parent)
        self.away.append(role.away or self.away[parent])
        n = len(self.labels) - 1
        self.main.append(self.main[parent] if self.main[parent] >= 0 else n if role.main and not self.away[n] else -1)
        self._last.append(-1)
        self._count.append(0)
        self._last[parent] = n
        self._count[parent] += 1
        if role.wraps:
            self._wraps.append(n)
        if role.main and role.whole:
            self._whole.add(n)
        return n

    def _settle(self) -> None:
        """A form or sidebar is away unless it holds a main element or most of the page's text; where
        there is a `main` with text, other main elements are none."""
        if self._wraps:
            size = [0] * len(self.labels)
            for k, block in self.blocks:
                if not self.away[k]:
                    size[k] += len(block)
            holds = [m == k for k, m in enumerate(self.main)]
            for k in range(len(self.labels) - 1, 0, -1):
                size[self.parents[k]] += size[k]
                holds[self.parents[k]] = holds[self.parents[k]] or holds[k]
            gone = {k for k in self._wraps if not holds[k] and size[k] * 2 < size[0]}
            for k in range(1, len(self.labels)):
                if k in gone or self.parents[k] in gone:
                    gone.add(k)
                    self.away[k] = True
        with_text = {self.main[k] for k, _ in self.blocks if self.main[k] >= 0 and not self.away[k]}
        if with_text & self._whole:
            self.main = [m if m in self._whole else -1 for m in self.main]

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]
        opened: Counter[str] = Counter()  # tags on the stack
        text: list[str] = []
        at, n, closed_by = 0, len(source), source.rfind(">")

        def cut(k: int) -> None:
            opened.subtract(tag for tag, _ in stack[k:])
            del stack[k:]

        def flush() -> None:
            if text:
                block = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if block:
                    self.blocks.append((stack[-1][1], block))

        while at < n:
            m = _TOKEN.match(source, at)
            if m is not None:
                token, at = m[0], m.end()
                if token[0] != "<":
                    text.append(token)
                continue
            m = _TAG.match(source, at) if at < closed_by else None
            if m is None:  # no tag
                text.append("<")
                at += 1
                continue
            # the tag ends at the next >; a quote that is never closed doesn't hide it
            end = source.find(">", m.end())
            token, at = (source[at : end + 1], end + 1) if end >= 0 else (source[at:], n)
            name = _NAME.match(token)
            if name is None:
                continue
            tag = name[1].lower()
            if token[1] == "/":
                if tag in _BLOCK:
                    flush()
                    if opened[tag]:
                        cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                elif tag in _SPACED:
                    text.append(" ")
                continue
            if tag in _RAW:
                if not token.endswith("/>"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else n
                text.append(" ")
                continue
            if tag not in _BLOCK:
                if tag in _SPACED:
                    text.append(" ")
                continue
            flush()
            if tag in _CLOSES_P and stack[-1][0] == "p":
                cut(len(stack) - 1)
            if tag in _CLOSED_BY:
                closed, scope = _CLOSED_BY[tag]
                if any(opened[x] for x in closed.split()):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in scope:
                            break
                        if stack[k][0] in closed.split():
                            cut(k)
                            break
            over = stack[-1][1]
            label, role = _labelled(token, tag, self.main[over] >= 0) if len(token) <= 1000 else _labelled.__wrapped__(token, tag, self.main[over] >= 0)
            if len(stack) > _MAX_DEPTH and (self.away[over] or not role.away and not role.wraps and not (role.main and self.main[over] < 0)):
                # deeper structure counts as its ancestor's, but for what changes its role
                stack.append((tag, over))
            else:
                stack.append((tag, self._node(over, label, role)))
            opened[tag] += 1
            if tag in _VOID or token.endswith("/>") and tag in ("svg",):
                cut(len(stack) - 1)
        flush()

    def skeleton(self) -> str:
        return "\n".join(f"{p} {x}" for p, x in zip(self.parents, self.labels, strict=True))

    def rests(self, sums: list[int]) -> tuple[int, list[int]]:
        """A checksum of the page's content, and for each node that of the content but for its own
        text: what is inside main elements if it has one, else all that is not away."""
        inside = any(m >= 0 for m in self.main)
        own = [hash((k, x)) & _WORD if x and not self.away[k] and (self.main[k] >= 0 or not inside) else 0 for k, x in enumerate(sums)]
        total = sum(own) & _WORD
        return total, [(total - x) & _WORD for x in own]

    def checksums(self) -> list[int]:
        """A checksum of each node's own text, 0 for a node without."""
        out = [0] * len(self.labels)
        for k, block in self.blocks:
            out[k] = zlib.crc32(block.encode(), out[k]) or 1
        return out


class Role(NamedTuple):
    """What an element declares to be: no main text, a form or sidebar (away unless it holds the page), a main element, `main` itself."""

    away: bool
    wraps: bool
    main: bool
    whole: bool


@lru_cache(1 << 14)
def _labelled(token: str, tag: str, inside: bool) -> tuple[str, Role]:
    """The label and role of an element.  A name declares a role only if all its words do: `social` and
    `social-share` but not `social-history`.  Inside a main element a header is the article's
    own, and words that may name a part of a text (`discussion`, `promotion`, `search`) decide nothing."""
    names: list[list[str]] = []
    classes = ""
    away = tag in _AWAY and tag != "form" and not (inside and tag == "header")
    wraps = tag == "form"
    main = tag in _MAIN
    whole = tag == "main"
    for name, a, b, c, bare in _ATTRIBUTE.findall(token):
        name, value = (name or bare).lower(), a or b or c
        if name in ("class", "id", "role"):
            names += [re.findall(r"[a-z0-9]+", x) for x in html.unescape(value).lower().split()]
            main = main or value.lower() == "main"
            whole = whole or name == "role" and value.lower() == "main"
            if name == "class":
                classes = ".".join(sorted(value.lower().split()))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            away = True
    if not main and tag not in ("body", "html"):
        main = tag in ("div", "section") and any(_MAIN_WORDS.intersection(x) and _MAIN_WORDS.union(_NEUTRAL).issuperset(x) for x in names)
        for x in names:
            words = _AWAY_WORDS.intersection(x)
            if words and words.union(_NEUTRAL).issuperset(x) and not (inside and words <= _OWN_WORDS):
                away, wraps = away or words != {"sidebar"}, wraps or words == {"sidebar"}
    main = main and not away and not wraps
    # what is declared by id, role or hidden sets siblings of one tag apart too
    return (f"{tag}.{classes}" if classes else tag) + "!" * (away or wraps) + "*" * main, Role(away, wraps and not away, main, whole and main)


def tree_match(a: str, b: str) -> dict[int, int]:
    """Simple tree matching of two skeletons: nodes of a to nodes of b."""
    return dict(_matched(a, b))


@lru_cache(1 << 12)
def _matched(a: str, b: str) -> tuple[tuple[int, int], ...]:
    def tree(s: str) -> tuple[list[str], list[list[int]]]:
        labels, kids = [], []
        for k, line in enumerate(s.split("\n")):
            parent, label = line.split(" ", 1)
            labels.append(label)
            kids.append([])
            if int(parent) >= 0:
                kids[int(parent)].append(k)
        return labels, kids

    (la, ka), (lb, kb) = tree(a), tree(b)
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(x: int, y: int) -> tuple[int, list[tuple[int, int]]]:
        """The weight of the best matching of the trees at x and y, and its matched children."""
        if la[x] != lb[y]:
            return 0, []
        if (x, y) not in known:
            places: dict[str, list[int]] = {}
            for j, child in enumerate(kb[y]):
                places.setdefault(lb[child], []).append(j)
            # the heaviest increasing chain of children with one label: only such pairs are looked at
            tree: list[tuple[int, int]] = [(0, -1)] * (len(kb[y]) + 1)  # Fenwick: (weight, last pair) of chains ending up to j
            chain: list[tuple[int, int, int]] = []  # child of a, child of b, pair before
            for child in ka[x]:
                new = []
                for j in places.get(la[child], ()):
                    best, at = (0, -1), j
                    while at:
                        best = max(best, tree[at], key=lambda t: t[0])
                        at -= at & -at
                    new.append((best[0] + match(child, kb[y][j])[0], best[1], j))
                for weight, before, j in new:
                    chain.append((child, kb[y][j], before))
                    at = j + 1
                    while at < len(tree):
                        if tree[at][0] < weight:
                            tree[at] = weight, len(chain) - 1
                        at += at & -at
            best, at = (0, -1), len(kb[y])
            while at:
                best = max(best, tree[at], key=lambda t: t[0])
                at -= at & -at
            pairs, k = [], best[1]
            while k >= 0:
                pairs.append(chain[k][:2])
                k = chain[k][2]
            known[x, y] = best[0] + 1, pairs
        return known[x, y]

    match(0, 0)
    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo += match(x, y)[1]
    return tuple(out)


@lru_cache(1 << 12)
def _keys(skeleton: str, reference: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """For each node its key and its parent's: the reference's node, or below 0 a hash of its labels from the root."""
    matched = dict(_matched(skeleton, reference))
    paths, keys, parents = [], [], []
    for k, line in enumerate(skeleton.split("\n")):
        parent, label = line.split(" ", 1)
        up = int(parent)
        paths.append(hashlib.blake2b((paths[up] if up >= 0 else b"") + label.encode(), digest_size=8).digest())
        keys.append(matched[k] if k in matched else -1 - (int.from_bytes(paths[k]) >> 1))
        parents.append(keys[max(up, 0)])
    return tuple(keys), tuple(parents)


def page_text(page: Page, template: dict[int, str]) -> str:
    """The text of the page's content; template: what its nodes are on this host, `fixed` (one
    text on many pages), `template` (few texts) or absent."""
    mains = [m for k, _ in page.blocks if (m := page.main[k]) >= 0]
    if mains:
        inside = [(k, b) for k, b in page.blocks if page.main[k] >= 0 and not page.away[k]]
        return "\n".join(b for k, b in inside if template.get(k) != "fixed") or "\n".join(b for _, b in inside)
    left = [(k, b) for k, b in page.blocks if not page.away[k]]
    return "\n".join(b for k, b in left if k not in template) or "\n".join(b for _, b in left)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def induce(pages: DataFrame) -> DataFrame:
    """host, reference (skeleton) and the kinds of nodes by key (``_keys``), without content."""
    R.prepare(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                read_pages = [Page(x or "") for x in part.column("html").to_pylist()]
                sums = [p.checksums() for p in read_pages]
                rests = [p.rests(x) for p, x in zip(read_pages, sums, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), pa.array([p.skeleton() for p in read_pages], pa.string()), pa.array(sums, pa.list_(pa.int64())), pa.array([r[0] for r in rests], pa.int64()), pa.array([r[1] for r in rests], pa.list_(pa.int64()))],
                    names=["host", "skeleton", "sums", "content", "rests"],
                )

    source = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    seen = R.written(source.mapInArrow(read, "host string, skeleton string, sums array<bigint>, content bigint, rests array<bigint>"), "skeletons")
    counted = seen.select("host", "skeleton", "content").distinct().groupBy("host", "skeleton").count()
    reference = counted.groupBy("host").agg(F.max(F.struct("count", F.col("skeleton"))).alias("top")).select("host", F.col("top.skeleton").alias("reference"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, skeleton, own, content, rests, ref in zip(*(batch.column(c).to_pylist() for c in ("host", "skeleton", "sums", "content", "rests", "reference")), strict=True):
                out += ((host, y, up, x or None, rest if x else None, content) for y, up, x, rest in zip(*_keys(skeleton, ref), own, rests, strict=True))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "node", "up", "sum", "rest", "content"])

    aligned = seen.join(reference, "host").select("host", "skeleton", "sums", "content", "rests", "reference").mapInArrow(align, "host string, node bigint, up bigint, sum bigint, rest bigint, content bigint")
    distinct = {c: F.approx_count_distinct(c, 0.02) for c in ("rest", "sum", "content")}
    stats = R.written(aligned.groupBy("host", "node").agg(F.min("up").alias("up"), distinct["rest"].alias("n"), distinct["sum"].alias("texts"), distinct["content"].alias("pages"), F.min("sum").alias("a"), F.max("sum").alias("b")), "nodes")
    above = stats.select("host", F.col("node").alias("up"), F.col("pages").alias("above"))
    stats = stats.where("a is not null").join(above, ["host", "up"], "left")
    kind = F.when((F.col("a") == F.col("b")) & (F.col("n") >= 10) & (F.col("n") * 2 >= F.coalesce("above", "n")), F.lit("fixed")).when((F.col("n") >= 3) & (F.col("texts") * 3 <= F.col("n")), F.lit("template"))
    kinds = stats.select("host", "node", kind.alias("kind")).where(F.col("kind").isNotNull()).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("node", "kind"))).alias("kinds"))
    return reference.join(kinds, "host", "left")


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), max_broadcast: int = 20_000) -> DataFrame:
    """The kept columns and the main text of every page."""
    R.prepare(pages.sparkSession)
    templates = R.written(induce(pages), "templates")
    sizes = templates.agg(F.count("*"), F.sum(F.length("reference") + 16 * F.coalesce(F.cardinality("kinds"), F.lit(0)))).first()
    if sizes[0] <= max_broadcast and (sizes[1] or 0) <= 16_000_000:
        templates = F.broadcast(templates)
    source = pages.select(*keep, _host(F.col("url")).alias("__host"), F.col("html").cast("string").alias("__html"))
    joined = source.join(templates.select(F.col("host").alias("__host"), F.col("reference").alias("__reference"), F.col("kinds").alias("__kinds")), "__host").select(*keep, "__html", "__reference", "__kinds")
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = []
                for source_html, ref, kinds in zip(*(part.column(k + i).to_pylist() for i in range(3)), strict=True):
                    page = Page(source_html or "")
                    kind_of = dict(kinds or ())
                    texts.append(page_text(page, {x: kind_of[y] for x, y in enumerate(_keys(page.skeleton(), ref)[0]) if y in kind_of} if kind_of else {}))
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(texts, pa.string())], names=[*keep, "text"])

    return joined.mapInArrow(run, source.select(*keep).schema.add("text", "string"))
