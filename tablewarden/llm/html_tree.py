"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are chains of tag and class names. For every node two entropies
over the host's pages are kept: of its presentation (the sequence of its children) and of its content (its own text),
each scaled to 0 for "the same on all pages" and 1 for "different on each". Frames, notices and other furniture repeat;
the article does not. Branches of a page whose importance is low are removed, as are those whose tag, role or class
says what they are (fixed lists below). Inside ``article`` or ``main`` only named furniture is removed, so that a host
whose pages are copies of one another keeps them.

Only nodes that many of a host's pages have are shipped back to its pages, so what a page receives is bounded by the
nodes per page, not by the size of the host.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tablewarden.llm.common import stored, without

#: Pages of a host that must have a node before its importance counts, and their least share of the host's pages.
LEAST_PAGES = 5
LEAST_SHARE = 0.1
#: Branches of lower importance are removed.
LOW_IMPORTANCE = 0.1
#: Nodes of all sites together that are still sent to every executor (16 bytes each).
BROADCAST_NODES = 500_000
#: Keys that the pages of one host are spread over otherwise.
SALTS = 32

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold text of the article.
DROPPED = frozenset(
    "head script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea "
    "input dialog menu search datalist fieldset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class names and ids that name furniture.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments commentlist disqus reply replies cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar pagination pager widget "
    "masthead copyright skip".split()
)
#: Named furniture outside the article only; inside, a header holds its title.
PAGE_NAMES = frozenset(["header", "topbar"])
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_SAME = frozenset("li dd dt tr td th option".split())
CONTENT_ROOTS = frozenset(["article", "main"])


class Node:
    __slots__ = ("tag", "name", "parts", "named", "root")

    def __init__(self, tag: str, name: str, named: bool, root: bool):
        self.tag, self.name, self.named, self.root = tag, name, named, root
        self.parts: list[Node | str] = []


def _words(value: str | None) -> list[str]:
    out = "".join(c.lower() if c.isalpha() else "-" if c.isdigit() or not c.isspace() else " " for c in value or "")
    return [w for w in out.replace("-", " ").split() if w]


class _Tree(HTMLParser):
    """The elements of one page, with the closing tags that HTML lets a page leave out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Node("#page", "#page", False, False)
        self.open = [self.top]
        self.inside = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._close(CLOSED_BY_BLOCK)
        if tag in CLOSED_BY_SAME:
            self._close(frozenset([tag]))
        if tag == "body":
            self._close(frozenset(["head"]))
        have = dict(attrs)
        words = _words(have.get("class"))
        named = tag in DROPPED or (have.get("role") or "").lower() in ROLES or "hidden" in have
        named = named or (have.get("aria-hidden") or "").lower() == "true" or "display:none" in (have.get("style") or "").replace(" ", "").lower()
        root = tag in CONTENT_ROOTS or (have.get("role") or "").lower() == "main"
        if tag not in ("html", "body") and not root:
            called = NAMES.intersection(words) or NAMES.intersection(_words(have.get("id")))
            page_only = not self.inside and (tag == "header" or PAGE_NAMES.intersection(words) or PAGE_NAMES.intersection(_words(have.get("id"))))
            named = named or bool(called) or bool(page_only)
        node = Node(tag, ".".join([tag, *sorted(set(words))]), named, root)
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.inside += root

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "g", "use"):
            self.handle_endtag(tag)

    def _pop(self) -> None:
        self.inside -= self.open.pop().root

    def _close(self, tags: frozenset[str]) -> None:
        """Close an open element of ``tags`` and what is in it, unless another block lies between."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                while len(self.open) > at:
                    self._pop()
                return
            if self.open[at].tag in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            while self.open[-1].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.top


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def style_rows(page: Node) -> list[tuple[int, int, int]]:
    """Node, presentation and content of every kind of node of one page. Nodes of one kind are taken together."""
    kinds: dict[str, tuple[list[str], list[str]]] = {}
    todo = [(page, "")]
    while todo:
        node, above = todo.pop()
        chain = f"{above}/{node.name}"
        style, text = kinds.setdefault(chain, ([], []))
        for part in node.parts:
            if isinstance(part, str):
                text.append(part.strip())
            else:
                style.append(part.name)
                if not part.named:
                    todo.append((part, chain))
        style.append("|")
    return [(_hash(c), _hash(" ".join(s)), _hash(" ".join(t))) for c, (s, t) in kinds.items()]


def main_text(page: Node, importance: dict[int, float], low: float = LOW_IMPORTANCE) -> str:
    """Blocks of the page outside removed branches, one a line."""
    roots = any_root(page)
    blocks: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            blocks.append(text)

    # Iterative walk, since pages can nest deeper than Python's stack.
    todo: list[tuple[Node | str | None, str, bool]] = [(page, "", False)]
    while todo:
        part, above, inside = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            if inside or not roots:
                current.append(part)
        elif part.tag == "br":
            current.append(" ")
        else:
            chain = f"{above}/{part.name}"
            inside = inside or part.root
            block = part.tag in BLOCKS
            # Only blocks are furniture by their importance: an inline element is a part of its sentence.
            judged = block and not inside and not (roots and contains_root(part))
            if part.named or (judged and branch(part, above, importance) < low):
                if block:
                    flush()
                continue
            if block:
                flush()
                todo.append((None, "", False))
            todo += [(p, chain, inside) for p in reversed(part.parts)]
    flush()
    return "\n".join(blocks)


def branch(node: Node, above: str, importance: dict[int, float]) -> float:
    """Importance of a branch: the greatest of its nodes. A node that the host's other pages rarely have counts as
    important, since nothing says that it is furniture."""
    best, todo = 0.0, [(node, above)]
    while todo:
        part, up = todo.pop()
        chain = f"{up}/{part.name}"
        best = max(best, importance.get(_hash(chain), 1.0))
        if best >= 1.0:
            break
        todo += [(p, chain) for p in part.parts if isinstance(p, Node) and not p.named]
    return best


def contains_root(node: Node) -> bool:
    todo = [node]
    while todo:
        part = todo.pop()
        if part.root:
            return True
        todo += [p for p in part.parts if isinstance(p, Node) and not p.named]
    return False


def any_root(page: Node) -> bool:
    """Whether the page marks its article; then only the text in it counts."""
    return contains_root(page)


def site_trees(pages: DataFrame) -> DataFrame:
    """``(host, nodes)``: for ``pages (host, html)``, importance of the nodes that many pages of a host have."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, rows = [], []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                found = style_rows(tree(html.as_py()))
                rows += found
                hosts += [host] * len(found)
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["host", "node", "style", "content"])

    rows = pages.mapInArrow(emit, "host string, node long, style long, content long")
    kinds = rows.groupBy("host", "node", "style", "content").agg(F.count("*").alias("n"))

    def entropy(of: str) -> DataFrame:
        """Entropy over pages divided by its greatest value."""
        seen = kinds.groupBy("host", "node", of).agg(F.sum("n").alias("n"))
        sums = seen.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
        value = F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log(F.col("pages")))).otherwise(1.0)
        return sums.select("host", "node", "pages", value.alias(of))

    both = entropy("style").join(entropy("content").drop("pages"), ["host", "node"])
    # The top node is on every page, so its count is that of the host's pages.
    hosts = both.groupBy("host").agg(F.max("pages").alias("all"))
    many = both.join(hosts, "host").where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * F.col("all")))
    node = F.struct("node", F.greatest("style", "content").alias("importance"))
    return many.groupBy("host").agg(F.collect_list(node).alias("nodes"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of their html in column ``name``.

    Character references are decoded, white space within a block becomes one space, blocks follow one another in page
    order, a line each. A null or empty page, and one without any main text, has the empty text. Pages without a
    host form a site of their own. Repeated rows are pages like any other. A column called ``name`` is replaced; others stay.
    """
    pages = without(pages, name)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), "^[^/]*//([^/?#]*)", 1)), F.lit(""))
    sites = stored(site_trees(pages.select(host.alias("host"), F.col(f"`{html_col}`").alias("html"))))
    row = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("row"), host.alias("host"), F.col(f"`{html_col}`").cast("binary").alias("html")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor()
        for batch in batches:
            packed = [squeeze.compress(v.as_buffer()) if v.is_valid else None for v in batch.column("html")]
            yield batch.set_column(2, "html", pa.array(packed, pa.binary()))

    packed = row.mapInArrow(pack, row.schema)
    # A counted, small table of sites goes to the pages. A larger one meets them by host, where each host is spread
    # over SALTS keys, so that a host with a third of all pages is not one task.
    entries = sites.agg(F.sum(F.size("nodes") + 1)).first()[0] or 0
    if entries <= BROADCAST_NODES:
        joined = packed.join(F.broadcast(sites), "host", "left")
    else:
        salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = packed.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("row", "html", "nodes")
    schema = StructType([joined.schema["row"], StructField("html", StringType()), StructField("text", StringType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            html = [unpack.decompress(v.as_py()).decode() if v.is_valid and v.as_py() else None for v in batch.column("html")]
            texts = []
            for page, nodes in zip(html, batch.column("nodes")):
                known = {}
                if nodes.is_valid:
                    flat = nodes.values
                    known = dict(zip(flat.field("node").to_pylist(), flat.field("importance").to_pylist()))
                texts.append(main_text(tree(page), known))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(html, pa.string()), pa.array(texts, pa.string())], ["row", "html", "text"])

    out = joined.mapInArrow(emit, schema)
    columns = [(F.col("html") if c == html_col else F.col("row").getField(c)).alias(c) for c in pages.columns]
    return out.select(*columns, F.col("text").alias(name))
