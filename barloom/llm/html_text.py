"""Main text of web pages with a site style tree.

The pages of a host are merged: elements with the same tag, class and id below the same
elements are one node of the host's tree. A node's own importance is an entropy. For a
node with children it is that of its presentation, the distribution of pages over the
sequences of children they have there; for text it is one less the mean entropy of its
contents over the pages, so what stands on every page counts nothing and what stands on one
page counts fully. A branch's importance is the mean of its nodes' importances, halved-like
by `decay` per level. Branches below `least` are removed from every page of the host.

Tags and names decide what the tree cannot: scripts, styles, forms, menus, headers, footers,
sidebars, notices, adverts and reader comments go whatever their content; inside a line of
text, adverts and hidden pieces do. A header inside an article belongs to it. If a page marks
its article (article, main), the text is taken from the innermost of article, main and page
that holds at least half of all that is left outside links, and in what is marked the tree
removes no paragraph or heading: an article that a host repeats is still the article. Articles
named as teasers or cards count only where a page has nothing else.

Pages are parsed twice, once for the tree and once for the text, so that nothing but counts
is shuffled: tasks sum their counts, and a host with a third of all pages is no hot group.

Defined results: a null or empty page has an empty text; a null or unusable url belongs to
one host of its own; repeated rows give the same text; markup that is never closed ends with
the page; nodes deeper than `MAX_DEPTH` count for their ancestor there (their text stays);
pages of any length are read whole; an empty table gives an empty result; a further column
named `text` gives way to the result, all others stay.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored

MAX_DEPTH = 32
#: Hosts with removed branches that may be sent to every executor.
BROADCAST_HOSTS = 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea "
                    "iframe object svg canvas audio video dialog menu datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var br wbr img".split())
#: An opening tag ends these, if open inside the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("html body article main section div ul ol dl table td th nav header footer aside form "
                       "blockquote figure".split())
NOISE = frozenset("ad ads advert advertisement adsense sponsor sponsored promo promotion banner sidebar nav navbar "
                  "navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup "
                  "modal overlay newsletter subscribe subscription signup login share sharing social comment "
                  "comments disqus related recommended footer header masthead widget pagination pager search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
#: Of these, what drops a piece inside a line of text, where the other names are mostly emphasis.
INLINE_NOISE = frozenset("ad ads advert advertisement adsense sponsored".split())
TEASERS = frozenset("teaser teasers card cards tile preview related recommended promo sponsored".split())
#: Longer attributes (pictures written out) are read each time instead of being remembered.
LONG_ATTRIBUTES = 1000
KEPT_IN_ARTICLE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
                  re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")
_TOKENS = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=100_000)
def _child(path: int, signature: str) -> int:
    return xxhash.xxh3_64_intdigest(signature, path & (2**64 - 1)) - 2**63


class _Said(NamedTuple):
    """What an opening tag says: its signature, and whether its names, role or style say noise,
    noise by no other name than header, noise inside a line, reader comments, a teaser."""
    signature: str
    noise: bool = False
    header: bool = False
    inline: bool = False
    comment: bool = False
    teaser: bool = False


def _element(tag: str, attributes: str) -> _Said:
    return _read(tag, attributes) if len(attributes) <= LONG_ATTRIBUTES else _read.__wrapped__(tag, attributes)


@lru_cache(maxsize=50_000)
def _read(tag: str, attributes: str) -> _Said:
    if not attributes.strip(" /"):
        return _Said(tag)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    plain = [n for n in names if not n.lower().startswith(("has-", "with-", "no-"))]
    tokens = {t.lower() for n in plain for t in _TOKENS.findall(n)}
    style = found.get("style", "").replace(" ", "").lower()
    hidden = ("hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style)
    names_noise, other = tokens & NOISE, hidden or found.get("role", "").lower() in ROLES
    signature = tag + "".join("." + _DIGITS.sub("0", n) for n in sorted(names))
    return _Said(signature, bool(names_noise) or other, names_noise == {"header"} and not other,
                 hidden or bool(tokens & INLINE_NOISE), bool(tokens & {"comment", "comments", "disqus"}),
                 bool(tokens & TEASERS))


class _Open:
    """An element that is open: its place in the style tree and what it says about its text."""
    __slots__ = ("tag", "path", "depth", "dropped", "region", "parent", "children", "texts", "kept", "teaser",
                 "linked")

    def __init__(self, tag, path, depth, dropped, region, parent, kept, teaser, linked):
        self.tag, self.path, self.depth, self.dropped = tag, path, depth, dropped
        self.region, self.parent, self.kept = region, parent, kept
        self.teaser, self.linked = teaser, linked
        self.children, self.texts = [], []


def parse(page: str):
    """(blocks, nodes): text blocks as (text, innermost open element, characters outside links),
    and every element."""
    root = _Open("", 0, 0, False, 0, None, False, False, False)
    stack, nodes, blocks = [root], [], []
    inline: list[str] = []
    links: list[str] = []

    def flush():
        if inline:
            text = " ".join("".join(inline).split())
            if text:
                holder = next(o for o in reversed(stack) if o.tag not in INLINE)
                blocks.append((text, holder, len(text) - len(" ".join("".join(links).split()))))
                holder.texts.append(text)
            inline.clear()
            links.clear()

    def close_to(index):
        flush()
        del stack[index:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        up = stack[-1]
        if text and not (up.dropped and up.tag in INLINE):
            inline.append(entities.unescape(text) if "&" in text else text)
            if up.linked:
                links.append(inline[-1])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue  # a comment or a declaration
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in INLINE:
                        del stack[i:]
                    else:
                        close_to(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in ("br", "wbr"):
            inline.append(" ")
            continue
        if tag not in INLINE:
            flush()
            ends = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in ends:
                    close_to(i)
                    if stack[i - 1].tag not in ends:
                        break
                elif stack[i].tag in CONTAINERS and stack[i].tag not in ends:
                    break
        said = _element(tag, m[3])
        up = stack[-1]
        region = max(up.region, 2 if tag == "article" else 1 if tag == "main" else 0)
        if tag in INLINE:
            noise = said.inline
        else:
            noise = (said.noise and not (said.header and region)
                     and (said.comment or tag not in ("html", "body", "main", "article")))
        dropped = up.dropped or tag in DROPPED or noise or tag == "header" and not region
        deep = up.depth >= MAX_DEPTH
        node = _Open(tag, up.path if deep else _child(up.path, said.signature), up.depth + (not deep), dropped, region, up,
                     tag in KEPT_IN_ARTICLE, up.teaser or tag == "article" and said.teaser,
                     tag == "a" or tag in INLINE and up.linked)
        if tag not in INLINE and not deep:
            up.children.append(node.path)
            nodes.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            at = close.start() if close else end
            continue
        stack.append(node)
    flush()
    return blocks, nodes


def main_text(page: str | None, removed: frozenset | set = frozenset()) -> str:
    """The blocks of the main text; `removed` has the style-tree paths of unimportant branches."""
    if not page:
        return ""
    blocks = [b for b in parse(page)[0] if not b[1].dropped]
    blocks = [b for b in blocks if not b[1].teaser] or blocks

    def stays(holder, scope):
        o = holder
        while o is not None and not (o.path in removed and not (o.region and o.kept)):
            # In a marked article, only branches inside it are looked at.
            o = o.parent if not scope or o.parent is None or o.parent.region >= scope else None
        return o is None

    total = None
    found = []
    for scope in (0, 1, 2):
        kept = [b for b in blocks if b[1].region >= scope and stays(b[1], scope)]
        mass = sum(plain for _, _, plain in kept)
        total = mass if total is None else total
        if kept and 2 * mass >= total:
            found = kept
    return "\n".join(text for text, _, _ in found)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def _lineage(node) -> list[int]:
    path = []
    while node is not None and node.depth:
        path.append(node.path)
        node = node.parent
    return path


def style_tree(pages: DataFrame, decay: float = 0.9) -> DataFrame:
    """(host, path, pages, importance) of every branch of every host's merged tree."""
    def count(batches):
        # key: (host, lineage, kind, value); kind 0 a sequence of children, 1 a content.
        sums: dict = defaultdict(lambda: [0, 0, 0.0])

        def rows():
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.list_(pa.int64())),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.int64()),
                 *[pa.array([sums[k][i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]],
                names=["host", "lineage", "kind", "value", "pages", "n", "nlogn"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                own = Counter()
                for node in parse(page or "")[1]:
                    line = tuple(_lineage(node))
                    if node.children:
                        own[line, 0, xxhash.xxh3_64_intdigest(repr(node.children)) - 2**63] += 1
                    for t in node.texts:
                        own[line, 1, xxhash.xxh3_64_intdigest(t) - 2**63] += 1
                for (line, kind, value), n in own.items():
                    s = sums[host, line, kind, value]
                    s[0], s[1], s[2] = s[0] + 1, s[1] + n, s[2] + n * math.log(n)
            if len(sums) > 200_000:
                yield from rows()
                sums.clear()
        yield from rows()

    counted = (pages.mapInArrow(count, "host string, lineage array<long>, kind int, value long, pages long, "
                                       "n long, nlogn double")
               .withColumn("path", F.element_at("lineage", 1))
               .groupBy("host", "path", "kind", "value")
               .agg(F.max("lineage").alias("lineage"), F.sum("pages").alias("pages"),
                    F.sum("n").alias("n"), F.sum("nlogn").alias("nlogn")))
    # A content's entropy over pages, from its counts: ln n - (sum of n_j ln n_j) / n.
    spread = F.log("n") - F.col("nlogn") / F.col("n")
    nodes = counted.groupBy("host", "path").agg(
        F.max("lineage").alias("lineage"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("uses"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("nlogn"),
        F.avg(F.when(F.col("kind") == 1, spread)).alias("spread"),
        F.max(F.when(F.col("kind") == 1, F.col("pages"))).alias("most"),
        F.sum(F.when(F.col("kind") == 1, F.col("pages"))).alias("texts"),
        F.count_if(F.col("kind") == 1).alias("contents"))
    # Both entropies to the base of how often the node occurs, so that they lie in 0 .. 1.
    shape = F.when(F.col("uses") > 1, (F.log("uses") - F.col("nlogn") / F.col("uses")) / F.log("uses")).otherwise(1.0)
    content = F.when(F.col("texts") > 1, 1 - F.col("spread") / F.log("texts")).otherwise(1.0)
    scored = nodes.select("host", "path", "lineage", F.greatest(F.coalesce("uses", F.lit(0)), F.coalesce("texts", F.lit(0))).alias("pages"),
                          F.when(F.col("contents") > 0, content).otherwise(shape).alias("own"))
    up = scored.select("host", "pages", "own", F.posexplode("lineage").alias("level", "path"))
    weight = F.pow(F.lit(decay), F.col("level"))
    return (up.groupBy("host", "path").agg(
        (F.sum(weight * F.col("own")) / F.sum(weight)).alias("importance"),
        F.max(F.when(F.col("level") == 0, F.col("pages"))).alias("pages")))


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", least: float = 0.2,
                      least_pages: int = 10, decay: float = 0.9) -> DataFrame:
    """The rows of `pages` without `html`, with `text`."""
    rows = pages.select(*[F.col(c).alias(f"c_{c}") for c in pages.columns if c not in (html, "text")],
                        host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    tree = style_tree(rows.select("host", "html"), decay)
    low = stored(tree.where((F.col("importance") < least) & (F.col("pages") >= least_pages))
                 .groupBy("host").agg(F.collect_list("path").alias("removed")))
    told = rows.join(small_side(low, BROADCAST_HOSTS), "host", "left")
    kept = [c for c in told.columns if c not in ("host", "html", "removed")]

    def extract(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page, frozenset(gone or ())) for page, gone in
                         zip(part.column("html").to_pylist(), part.column("removed").to_pylist())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.string())],
                                                 names=[*kept, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.select(*kept).schema)
    out = told.select(*kept, "html", "removed").mapInArrow(extract, f"{fields}, text string")
    return out.select(*[F.col(c).alias(c[2:]) for c in kept], "text")
