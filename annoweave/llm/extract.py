"""Main text of pages by site style trees.

The pages of a host are merged into one tree. A node of it is an element by the tags and names on its path.
Its presentation is as important as the sequences of children it has on different pages are varied, its
content as the features of its text (words of short runs, sentences of long ones) are particular to few
pages: both are entropies over the pages that hold the node. A branch's importance weighs the node's
presentation against the content of the branch, the more so the more presentations there are. Branches of
low importance (a menu, a notice, a footer that all pages share) are removed from each page.

A page is read by tag, role and name first: what these say is no article never enters the tree, and a page
that marks its main part or article is reduced to it. The largest part of a page's text is never removed for
being repeated, nor are the paragraphs, lists and tables in it, since pages may hold copies of one article.
Lists and tables of links outside paragraphs are menus and go.

Statistics are counted over all pages. Each task sums what it counts before it sends it, so a host with very
many pages costs one row for each task, node and feature; nothing is gathered by host or page in one task.
The low branches of hosts are broadcast if they are few, and joined to the pages by content otherwise.

Defined cases: a null or empty page has the empty text; pages without a host have no tree; a host's single
page has no low branch; repeated rows are pages of their own; an empty table gives no rows; unclosed and
stray tags are read as browsers do; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annoweave.llm.common import stored
from annoweave.llm.dom import HEADINGS, Block, parse
from annoweave.llm.urls import host_of

#: Branches of at most this importance (0 to 1) are noise.
THRESHOLD = 0.5
#: How fast presentation outweighs content as a node's presentations become many.
DECAY = 0.9
#: Runs of up to so many words count by words, longer ones by sentences.
SHORT_RUN = 12
#: Share of linked characters from which on a list or table is a menu.
LINKED = 0.6
BROADCAST_NODES = 200_000
_HELD = 300_000  # counts a task holds before it sends them
_COUNTS = "host string, node long, path array<long>, styled boolean, feature long, n long"
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
#: Parts of running text, and what menus are made of.
_TEXT_LEVEL = HEADINGS | frozenset("p blockquote pre ul ol li dl dt dd table tbody thead tfoot tr td th caption "
                                   "figure figcaption center".split())
_MENU_LEVEL = frozenset("div section ul ol dl table".split())


def _hash(*parts) -> int:
    digest = hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


class Keys(dict):
    """Numbers of nodes by (number of the parent, tag, names)."""

    def __missing__(self, node: tuple) -> int:
        if len(self) > _HELD:
            self.clear()
        found = self[node] = _hash(*node)
        return found


def branches(root: Block, keys: Keys) -> Iterator[Block]:
    """The blocks of a page that may hold an article, parents first, with their nodes."""
    open_blocks = [root]
    while open_blocks:
        block = open_blocks.pop()
        if block.never or block.named and not _holds_article(block):
            continue
        block.key = keys[block.parent.key if block.parent else 0, block.tag, block.label]
        yield block
        open_blocks.extend(reversed(block.blocks))


def _holds_article(block: Block) -> bool:
    below = list(block.blocks)
    while below:
        part = below.pop()
        if part.tag in ("article", "main") and not part.never and not part.named:
            return True
        below.extend(part.blocks)
    return False


def features(run: str) -> list[str]:
    words = run.split(" ")
    return words if len(words) <= SHORT_RUN else _SENTENCE.split(run)


def page_counts(source: str, keys: Keys) -> tuple[dict[int, tuple], dict[int, list], set[tuple[int, int]]]:
    """What a page adds to its host's tree: paths of nodes, their presentations, and features of content."""
    paths: dict[int, tuple] = {}
    styles: dict[int, list] = {}
    content = set()
    for block in branches(parse(source), keys):
        above = paths.get(block.parent.key, ()) if block.parent else ()
        paths.setdefault(block.key, (*above, block.key))
        styles.setdefault(block.key, []).append(
            [(part.tag, part.label) for part in block.blocks if not part.never and not part.named])
        content.update((block.key, _hash(f)) for run in block.runs for f in features(run))
    return paths, styles, content


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, held, paths = Keys(), {}, {}

    def sent():
        rows = list(held.items())
        columns = [[k[0] for k, _ in rows], [k[1] for k, _ in rows], [paths[k[1]] for k, _ in rows],
                   [k[2] for k, _ in rows], [k[3] for k, _ in rows], [n for _, n in rows]]
        types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                          ["host", "node", "path", "styled", "feature", "n"])

    for batch in batches:
        for host, source in zip(batch.column(0), batch.column(1)):
            host = host.as_py()
            own, styles, content = page_counts(source.as_py(), keys)
            paths.update(own)
            for node, style in styles.items():
                key = host, node, True, _hash(style)
                held[key] = held.get(key, 0) + 1
            for node, feature in content:
                key = host, node, False, feature
                held[key] = held.get(key, 0) + 1
            if len(held) > _HELD:
                yield sent()
                held, paths = {}, {}
    if held:
        yield sent()


def style_tree(pages: DataFrame) -> DataFrame:
    """The nodes of each host's tree: host, node, pages, presentation, content and importance.

    ``pages`` has host and html.
    """
    own = pages.where("host <> '' and html <> ''").select("host", "html")
    counts = (own.mapInArrow(_count, _COUNTS).groupBy("host", "node", "styled", "feature")
              .agg(F.sum("n").alias("n"), F.first("path").alias("path")))
    # Entropies to the base of the number of pages, from sums of n and of n log n.
    n, weight = F.col("n"), F.col("n") * F.log("n")
    styled = F.col("styled")
    nodes = stored(counts.groupBy("host", "node").agg(
        F.first("path").alias("path"), F.sum(F.when(styled, n)).alias("pages"),
        F.count_if(styled).alias("styles"), F.sum(F.when(styled, weight)).alias("style_sum"),
        F.coalesce(F.sum(F.when(~styled, n)), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.when(~styled, weight)), F.lit(0.0)).alias("word_sum")), "extract-nodes")
    base = F.log("pages")
    several = F.col("pages") > 1
    presentation = F.when(several, 1 - F.col("style_sum") / (F.col("pages") * base)).otherwise(1.0)
    particular = F.col("words") - F.when(several, F.col("word_sum") / base).otherwise(0.0)
    below = (nodes.select("host", F.explode("path").alias("node"), "words", particular.alias("particular"))
             .groupBy("host", "node").agg((F.sum("particular") / F.sum("words")).alias("content")))
    fade = F.pow(F.lit(DECAY), F.col("styles"))
    rated = nodes.select("host", "node", "pages", "styles", presentation.alias("presentation")).join(
        below, ["host", "node"])
    importance = (1 - fade) * F.col("presentation") + fade * F.coalesce("content", F.lit(1.0))
    return rated.select("host", "node", "pages", "presentation", "content", F.round(importance, 9).alias("importance"))


def _sizes(order: list[Block]) -> dict[Block, list[int]]:
    """Characters of each branch, and those of them in links."""
    sizes = {}
    for block in order:
        sizes[block] = [sum(map(len, block.runs)), block.linked]
    for block in reversed(order):
        if block.parent in sizes:
            sizes[block.parent][0] += sizes[block][0]
            sizes[block.parent][1] += sizes[block][1]
    return sizes


def _main_parts(order: list[Block], sizes: dict) -> list[Block]:
    """The parts a page marks as its main part, else as its article, else the page itself."""
    for tag in ("main", "article"):
        marked = [b for b in order if b.tag == tag and sizes[b][0]]
        outer = [b for b in marked if not any(_inside(b, other) for other in marked if other is not b)]
        if outer:
            largest = max(outer, key=lambda b: sizes[b][0])
            whole = sum(sizes[b][0] for b in outer)
            return [largest] if 2 * sizes[largest][0] >= whole else outer
    return order[:1]


def _inside(block: Block, other: Block) -> bool:
    while block is not None and block is not other:
        block = block.parent
    return block is other


def main_blocks(source: str | None, low: frozenset[int], keys: Keys) -> list[str]:
    """The blocks of the main text of a page whose host's low branches are ``low``."""
    if not source:
        return []
    order = list(branches(parse(source), keys))
    sizes = _sizes(order)
    top = _main_parts(order, sizes)
    total = sum(sizes[b][0] for b in top)
    of_node: dict[int, int] = {}
    for block in order:
        of_node[block.key] = of_node.get(block.key, 0) + sizes[block][0]

    def goes(block: Block, use_tree: bool) -> bool:
        size, linked = sizes[block]
        if block.tag in _MENU_LEVEL and size and linked > LINKED * size:
            return True
        if not use_tree or block.key not in low or 2 * of_node[block.key] > total:
            return False
        outermost = block.parent is None or block.parent.tag in ("", "html", "body")
        return block.tag not in _TEXT_LEVEL or bool(block.label) or outermost

    def texts(use_tree: bool) -> list[str]:
        out, rest = [], list(reversed(top))
        while rest:
            part = rest.pop()
            if isinstance(part, str):
                out.append(part)
            elif part in sizes and (part in top or not goes(part, use_tree)):
                rest.extend(reversed(list(part.texts())))
        return out

    return texts(True) or texts(False)


def _extract(shared):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys = shared.value if shared else {}, Keys()
        for batch in batches:
            out = []
            for host, source, low in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out.append(main_blocks(source, known.get(host, frozenset()) if low is None else frozenset(low), keys))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(out, pa.list_(pa.string()))],
                                             ["page_id", "url", "blocks"])
    return work


def _page_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = Keys()
    for batch in batches:
        nodes = [sorted({b.key for b in branches(parse(s), keys)}) for s in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.list_(pa.int64()))],
                                         ["host", "h1", "h2", "nodes"])


def _with_low_nodes(pages: DataFrame, low: DataFrame) -> DataFrame:
    """Each page with the low nodes it holds, by its host and content."""
    named = pages.withColumns({"h1": F.xxhash64("html"), "h2": F.xxhash64(F.lit("page"), "html")})
    nodes = (named.where("html <> ''").select("host", "h1", "h2", "html")
             .mapInArrow(_page_nodes, "host string, h1 long, h2 long, nodes array<long>")
             .select("host", "h1", "h2", F.explode("nodes").alias("node")).distinct())
    found = nodes.join(low, ["host", "node"]).groupBy("host", "h1", "h2").agg(F.collect_list("node").alias("low"))
    return named.join(found, ["host", "h1", "h2"], "left").withColumn(
        "low", F.coalesce("low", F.array().cast("array<long>")))


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url and blocks, the texts of the main blocks of each page in order."""
    spark = pages.sparkSession
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    low = stored(style_tree(own).where((F.col("pages") > 1) & (F.col("importance") <= threshold))
                 .select("host", "node"), "extract-low")
    shared = None
    if low.count() <= BROADCAST_NODES:
        by_host: dict[str, set] = {}
        for host, node in low.collect():
            by_host.setdefault(host, set()).add(node)
        shared = spark.sparkContext.broadcast({host: frozenset(nodes) for host, nodes in by_host.items()})
        own = own.withColumn("low", F.lit(None).cast("array<long>"))
    else:
        own = _with_low_nodes(own, low)
    schema = T.StructType([own.schema["page_id"], own.schema["url"],
                           T.StructField("blocks", T.ArrayType(T.StringType()))])
    return own.select("host", "html", "low", "page_id", "url").mapInArrow(_extract(shared), schema)
