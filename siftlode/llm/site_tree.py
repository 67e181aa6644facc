"""Extraction of page content by a site style tree.

All pages of a host are merged into one tree.  An element node holds style nodes, one for each sequence of children (tag,
class and id; text, links and media count as leaves) that the element has on some page; a style node holds the elements of
its sequence.  Over the m pages that hold a node, with share p_i of them for its i-th style (or, for a leaf, its i-th
content),

* importance of its presentation or content: -sum p_i log_m p_i, and 1 if m = 1: what is alike on all pages counts 0;
* composite importance of an element: (1 - g**l) * its own + g**l * sum p_i * (mean of the composite importance of the
  elements of style i), with g = ``GAMMA`` and l its number of styles; a leaf's is its own.

A branch is removed from a page if its composite importance and that of all that it holds are below ``threshold``: so content
is not lost for the wrappers about it, whose importance falls with every level.  What stays becomes text.

Node identity is a hash of the path from the host down, so merging is a grouping, and composite importance is a grouping for
each level of depth, over nodes that several pages share (those of a single page count 1 wherever they are).  Only hashes and
counts are shuffled.  The keys of removed nodes are broadcast if they are few; otherwise the nodes of every page are joined with
them, and each page receives its own.

Defined results: pages that are equal on one host count once in the statistics, and all are cleaned; a NULL html gives a NULL
text; html without text gives an empty text; html and body are never removed as a whole; elements nest as deep as the
page has them; scripts, styles and comments are no content; a NULL or malformed url belongs to
the host "" ; a host with one page loses nothing; a branch just at the threshold stays; unclosed and stray tags are repaired; a
very long page is one page like any other; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .io import table

GAMMA = 0.9
THRESHOLD = 0.3
#: Keys of removed nodes that are sent to every worker; with more of them, nodes meet in a shuffle.
BROADCAST_NODES = 1_000_000
_CLEAN_TYPE = T.StructType().add("text", T.StringType()).add("removed", T.LongType()).add("lost", T.LongType())

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-z][a-z0-9:-]*)([^<>]*+)>|<[!?][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A tag that opens ends open ones of these kinds, up to the container.
_ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_LINES = _BLOCK | frozenset("br li dt dd tr td th title body head html option".split())
_MASK = (1 << 64) - 1
_WHOLE = frozenset(("#page", "html", "body"))
_TEXT, _LINK, _MEDIA = "#text", "#link", "#media"


class Node:
    __slots__ = ("tag", "label", "kids", "content")

    def __init__(self, tag: str, label: str, content: str | None = None):
        self.tag, self.label, self.content = tag, label, content
        self.kids: list[Node] = []


def parse(page: str) -> Node:
    """The element tree of a page, unclosed and stray tags repaired."""
    root = Node("#page", "#page")
    stack, opened = [root], defaultdict(list)  # opened: the places in the stack of each tag's open elements
    at = 0

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            stack[-1].kids.append(Node(_TEXT, _TEXT, entities.unescape(piece)))

    def close(tag: str) -> None:
        while True:
            last = stack.pop()
            opened[last.tag].pop()
            if last.tag == tag:
                return

    for m in _PART.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            if opened[tag]:
                close(tag)
            continue
        if tag in _BLOCK and opened["p"]:
            close("p")
        if tag in _ENDS:
            kinds, until = _ENDS[tag]
            kinds = kinds.split()
            least = max((opened[x][-1] for x in until if opened[x]), default=0)
            while (nearest := max((opened[x][-1] for x in kinds if opened[x]), default=0)) > least:
                close(stack[nearest].tag)
                if len(kinds) < 3:
                    break
        found = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[4] or m[7] or "")}
        label = f"{tag}.{' '.join(sorted(found.get('class', '').split()))}#{found.get('id', '')}"
        node = Node(tag, label)
        stack[-1].kids.append(node)
        target = found.get("href") if tag == "a" else found.get("src")
        if target:
            node.kids.append(Node(_LINK if tag == "a" else _MEDIA, _LINK if tag == "a" else _MEDIA, target))
        if tag not in _VOID:
            opened[tag].append(len(stack))
            stack.append(node)
    text(page[at:])
    return root


def _hash(x: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed)


_WHITE = re.compile(r"\s+")
_NUMBER = re.compile(r"[0-9]+")


def host_key(host: str) -> int:
    return _hash(host, 1)


def item(node: Node, key: int) -> int:
    """What a node holds on one page: its style (the sequence of its children's labels), or a leaf's content."""
    if node.content is not None:
        return _hash(_NUMBER.sub("0", _WHITE.sub(" ", node.content.strip().lower())), 3)
    return _hash("\0".join([k.label for k in node.kids]), key)


def child_key(style: int, i: int) -> int:
    """The key of the i-th child of a style node; the same step leads back."""
    return style ^ (i + 1)


def nodes(root: Node, host: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, item, place among its siblings, number of children or -1 for leaves, depth) of every node of a page."""
    todo = [(root, host_key(host), 0, 0)]
    while todo:
        node, key, place, depth = todo.pop()
        own = item(node, key)
        yield key, own, place, -1 if node.content is not None else len(node.kids), depth
        for i, k in enumerate(node.kids):
            todo.append((k, child_key(own, i), i, depth + 1))


def render(root: Node, host: str, gone: frozenset[int]) -> tuple[str, int, int]:
    """The text that is left of a page without the branches in ``gone``, their number, and the characters of text lost."""
    out: list[str] = []
    removed = lost = 0
    todo: list[tuple[Node, int, bool] | str] = [(root, host_key(host), False)]
    while todo:
        entry = todo.pop()
        if isinstance(entry, str):
            out.append(entry)
            continue
        node, key, dead = entry
        if not dead and key in gone and node.tag not in _WHOLE:
            dead = True
            removed += 1
        if node.content is not None:
            if node.tag == _TEXT:
                if dead:
                    lost += len(node.content)
                else:
                    out.append(node.content)
            continue
        edge = node.tag in _LINES and not dead
        if edge:
            out.append("\n")
            todo.append("\n")
        own = item(node, key)
        for i in range(len(node.kids) - 1, -1, -1):
            todo.append((node.kids[i], child_key(own, i), dead))
    lines = (_WHITE.sub(" ", x).strip() for x in "".join(x if x == "\n" else _WHITE.sub(" ", x) for x in out).split("\n"))
    return "\n".join(x for x in lines if x), removed, lost


def _host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url.cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (node, item) over the pages of each batch."""
    for batch in batches:
        found: Counter = Counter()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.update(nodes(parse(page), host))
        if found:
            key, own, place, kids, depth = (np.array(x, d) for x, d in zip(zip(*found, strict=True), (np.uint64, np.uint64, np.int32, np.int32, np.int32), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), pa.array(place), pa.array(kids), pa.array(depth), pa.array(np.array(list(found.values()), np.int64))], ["node", "item", "place", "kids", "depth", "n"])


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that several pages share (node, parent, depth, leaf, m, items, own) and their shared styles (owner, style, depth, n)."""
    rows = pages.filter("html IS NOT NULL").select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    if not rows.groupBy("host", F.xxhash64("html").alias("h")).count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["host", "html"])
    counts = table(rows.mapInArrow(_counted, "node long, item long, place int, kids int, depth int, n long").groupBy("node", "item").agg(F.first("place").alias("place"), F.first("kids").alias("kids"), F.first("depth").alias("depth"), F.sum("n").alias("n")))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    own = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - F.col("s") / (m * F.log(m))))
    merged = counts.groupBy("node").agg(F.first("place").alias("place"), F.first("depth").alias("depth"), F.sum("n").alias("m"), F.count("*").alias("items"), F.sum(n * F.log(n)).alias("s"), (F.max("kids") < 0).alias("leaf")).filter("m > 1")
    shared = table(merged.select("node", F.col("node").bitwiseXOR(F.col("place").cast("long") + 1).alias("parent"), "depth", "leaf", "m", "items", own.alias("own")))
    return shared, counts.filter("n > 1 AND kids >= 0").select(F.col("node").alias("owner"), F.col("item").alias("style"), "depth", "n")


def importance(shared: DataFrame, styles: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(node, importance, most): the composite importance of every node that several pages share, and the greatest one of the
    branch that it begins; deepest level first."""
    deepest = shared.agg(F.max("depth")).first()[0]
    if deepest is None:
        return shared.select("node", F.lit(1.0).alias("importance"), F.lit(1.0).alias("most"))
    below, levels = None, []
    keep = F.pow(F.lit(gamma), F.col("items"))
    for d in range(deepest, -1, -1):
        here = shared.filter(F.col("depth") == d)
        if below is not None:
            means = below.groupBy("parent").agg(F.avg("importance").alias("mean"), F.max("most").alias("top"))
            sums = styles.filter(F.col("depth") == d).join(means, F.col("style") == F.col("parent"), "left").groupBy("owner").agg(F.sum("n").alias("held"), F.sum(F.col("n") * F.coalesce("mean", F.lit(0.0))).alias("sum"), F.max("top").alias("top"))
        else:
            sums = styles.filter(F.col("depth") == d).groupBy("owner").agg(F.sum("n").alias("held"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"))
        inner = (F.coalesce("sum", F.lit(0.0)) + F.col("m") - F.coalesce("held", F.lit(0))) / F.col("m")
        value = F.when(F.col("leaf"), F.col("own")).otherwise((1 - keep) * F.col("own") + keep * inner)
        # a style of one page counts 1
        most = F.when(F.col("leaf"), value).otherwise(F.greatest(value, F.coalesce("top", F.lit(0.0)), F.when(F.col("m") > F.coalesce("held", F.lit(0)), 1.0).otherwise(0.0)))
        below = table(here.join(sums, F.col("node") == F.col("owner"), "left").select("node", "parent", value.alias("importance"), most.alias("most")))
        levels.append(below.select("node", "importance", "most"))
    while len(levels) > 1:  # pages can be deep: unions of unions keep the plan flat
        levels = [levels[i].unionByName(levels[i + 1]) if i + 1 < len(levels) else levels[i] for i in range(0, len(levels), 2)]
    return levels[0]


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, node) of every node of every page."""
    for batch in batches:
        for k1, k2, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = np.array(sorted({x[0] for x in nodes(parse(page), host)}), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k1)), pa.array(np.full(len(keys), k2)), pa.array(keys)], ["k1", "k2", "node"])


def extract(pages: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(page_id, host, text, removed, lost) of every page: the text of what stays, the branches removed, and their characters."""
    scored = importance(*style_tree(pages), gamma)
    gone = table(scored.filter(F.col("most") < threshold).select("node"))
    rows = pages.select("page_id", _host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    count = gone.count()
    if count <= broadcast_nodes:
        found = np.sort(np.array([r["node"] for r in gone.toLocalIterator()], np.int64))
        sent = pages.sparkSession.sparkContext.broadcast(found)

        @F.pandas_udf(_CLEAN_TYPE)
        def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            known = frozenset(sent.value.view(np.uint64).tolist())
            for hosts, texts in batches:
                yield _render_all(hosts, texts, [known] * len(hosts))

        done = rows.select("page_id", "host", clean("host", "html").alias("c"))
    else:
        k1, k2 = F.xxhash64("host", "html"), F.xxhash64("html", F.lit(1), "host")
        keyed = rows.withColumns({"k1": k1, "k2": k2})
        every = keyed.filter("html IS NOT NULL").select("k1", "k2", "host", "html").mapInArrow(_page_nodes, "k1 long, k2 long, node long")
        lists = every.join(gone, "node", "left_semi").groupBy("k1", "k2").agg(F.collect_set("node").alias("gone"))

        @F.pandas_udf(_CLEAN_TYPE)
        def clean_listed(hosts: pd.Series, texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
            return _render_all(hosts, texts, [frozenset() if g is None else frozenset(np.asarray(g, np.int64).view(np.uint64).tolist()) for g in gone])

        done = keyed.join(lists, ["k1", "k2"], "left").select("page_id", "host", clean_listed("host", "html", "gone").alias("c"))
    return done.select("page_id", "host", "c.*")


def _render_all(hosts: pd.Series, texts: pd.Series, gone: list[frozenset[int]]) -> pd.DataFrame:
    rows = [(None, 0, 0) if x is None else render(parse(x), h, g) for h, x, g in zip(hosts, texts, gone, strict=True)]
    return pd.DataFrame(rows, columns=["text", "removed", "lost"])
