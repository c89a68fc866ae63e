"""Main text of web pages by site style trees: what a branch is worth is learnt from all pages of its site."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import settle
from meshlark.llm.language import address_parts

#: Fixed values of HTML: elements without content, elements whose content is raw text, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup svg time tspan tt u var wbr math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics annotation".split())
#: Elements that are not text of the page at all.
NEVER = frozenset("head form button dialog".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Evidence, not a verdict: elements and names that mostly stand beside the main text, and elements that hold it.
BESIDE = frozenset("nav footer aside menu".split())
MAIN = frozenset("main article".split())
#: Elements that are text themselves: what stands beside a larger block says nothing against them.
PROSE = frozenset("p blockquote pre ul ol dl table figure".split())
_NAME = r"(?:ads?|adv|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|cookies?|consent|footer|menu|nav|navbar|navigation|newsletter|notices?|popup|promo|related|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)"
_WHERE = r"(?:site|main|page|top|bottom|global|primary|secondary|left|right|mobile|user|header|footer|side|cookie|social|share|post|article|entry|google)"
_PIECE = r"(?:bar|box|list|links?|buttons?|icons?|form|popup|modal|banner|notice|consent|overlay|container|slot|unit|section|area|menu|block|posts|articles|signup|wrapper)"
_SAID = re.compile(rf"(?:{_WHERE}[_-]+)?{_NAME}(?:[_-]+{_PIECE})?", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "name", "parts", "barred")

    def __init__(self, tag: str, name: str, barred: bool) -> None:
        self.tag, self.name, self.barred = tag, name, barred
        self.parts: list[Node | str] = []


def said_beside(tag: str, word: str = "") -> bool:
    """Whether a tag, or a word of its class, id or role, mostly stands for something beside the main text."""
    return tag in BESIDE or (tag not in HEADINGS and tag not in MAIN and _SAID.fullmatch(word) is not None)


@lru_cache(1 << 14)
def _name(tag: str, kind: str, own_id: str, role: str) -> str:
    """The name of an element in the tree: its tag and a word that says most of it."""
    words = [*kind.split(), *own_id.split(), *role.split()]
    word = next((x for x in words if said_beside(tag, x)), kind.split()[0] if kind.split() else "")
    return f"{tag}.{word}" if word else tag


def parse(html: str) -> Node:
    """A tree of elements and texts; never fails.  Unclosed and misplaced tags are mended as browsers mostly do."""
    root = Node("", "", False)
    stack, at, n = [root], 0, len(html)
    open_: Counter = Counter()

    def shut(k: int) -> None:
        open_.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    shut(k)
                    break
                if stack[k].tag in ("article", "main", "body") and tag in INLINE | {"p"}:
                    break
            continue
        if tag not in INLINE and tag not in RAW and tag != "br":  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1) if open_["p"] else ():
                if stack[k].tag == "p":
                    shut(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in _SELF_CLOSING:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    shut(k)
                    break
                if stack[k].tag in _SELF_CLOSING[tag]:
                    break
        attributes = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in _NAMED.finditer(m[3])} if "=" in m[3] else {}
        up = stack[-1]
        name = _name(tag, attributes.get("class", ""), attributes.get("id", ""), attributes.get("role", "")) if attributes else tag
        node = Node(tag, name, up.barred or tag in NEVER)
        up.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return root


def _clean(chunks: list[str]) -> str:
    joined = "".join(chunks)
    return " ".join((unescape(joined) if "&" in joined else joined).split())


def _below(path: int, name: str) -> int:
    """The path of a child: a digest of its parent's path and its name, of the same length at any depth."""
    return xxhash.xxh64_intdigest(f"{path}/{name}") >> 1


def style_nodes(root: Node) -> dict[int, list]:
    """What a page has at each path of blocks: [path above, name, digest of the text, its length, its length in links,
    whether blocks stand below].  Several elements at a path are one node."""
    order: list[tuple[Node, int, int]] = [(root, 0, 0)]  # node, its path, the path of the block that it is in
    for node, path, _ in order:  # parents come before their children; the list grows while it is walked
        for x in node.parts:
            if isinstance(x, Node) and not x.barred:
                order.append((x, path if x.tag in INLINE else _below(path, x.name), path))
    said: dict[int, tuple[str, int, int]] = {}
    out: dict[int, list] = {}
    blocks = {path for node, _, path in order if node.tag not in INLINE and node.tag not in VOID}
    for node, path, above in reversed(order):
        texts, size, links = [], 0, 0
        for x in node.parts:
            if isinstance(x, str):
                text = " ".join(x.split())
                own = (text, len(text), len(text) if node.tag == "a" else 0)
            else:
                own = said.pop(id(x), ("", 0, 0))
            if own[1]:
                texts.append(own[0])
                size += own[1]
                links += own[2]
        digest = xxhash.xxh64_hexdigest("|".join(texts)) if size else ""
        said[id(node)] = (digest, size, size if node.tag == "a" else links)
        if path and node.tag not in INLINE and size:
            held = out.setdefault(path, [above, node.name, 0, 0, 0, path in blocks])
            held[2] = (held[2] * 1_000_003 + int(digest, 16)) & (1 << 63) - 1
            held[3] += size
            held[4] += links
    out[0] = [0, "", 0, said[id(root)][1], 0, True]
    return out


def main_text(html: str, low: frozenset[int]) -> str:
    """Text of the blocks outside ``low`` paths and outside elements that are no text, in page order."""
    root = parse(html)
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := _clean(run):
            blocks.append(text)
        run.clear()

    stack = [(root, 0, iter(root.parts), False)]
    while stack:
        _, path, parts, block = stack[-1]
        for x in parts:
            if isinstance(x, str):
                run.append(x)
                continue
            own = x.tag not in INLINE
            here = _below(path, x.name) if own else path
            if own:
                close()
            if not x.barred and not (own and here in low):
                stack.append((x, here, iter(x.parts), own))
                break
        else:
            stack.pop()
            if block or not stack:
                close()
    return " ".join(blocks)


#: Rows of nodes that are held at most, but for those of one page.
FLUSH = 4096
_ROWS = "host string, page long, above long, path long, name string, beside boolean, content long, share double, links double, blocks double"


def page_nodes(pages: DataFrame) -> DataFrame:
    """The rows of :func:`style_nodes` for pages (host, html, page): ``share`` is a node's part of the text of the
    block above, ``links`` the part of its text in links."""
    names = [x.split()[0] for x in _ROWS.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 3, pa.string(), pa.bool_(), pa.int64(), *[pa.float64()] * 3]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, html, page in zip(*[batch.column(i) for i in range(3)]):
                host, page = host.as_py(), page.as_py()
                nodes = style_nodes(parse(html.as_py()))
                for path, (above, name, content, size, links, blocks) in nodes.items():
                    if path:
                        beside = said_beside(*name.split(".", 1))
                        rows.append((host, page, above, path, name, beside, content, size / nodes[above][3], links / size, float(blocks)))
                if len(rows) >= FLUSH:
                    yield pack(rows)
                    rows = []
            yield pack(rows)

    return pages.select("host", "html", "page").mapInArrow(run, _ROWS)


def style_tree(nodes: DataFrame, copies: DataFrame, strength: float = 5.0) -> DataFrame:
    """``host, path, importance`` for each node of the merged tree of each host, from the nodes of its pages.

    Identical pages count as one: each of c copies (``copies``: host, page, copies) counts 1 / c.  Over a host's pages
    a node has a variety (the share of pages that say anything but its most common content), a part of the text above
    it, and a part of its own text in links.  Each is smoothed by ``strength`` pages of what elements of that name are
    like on all hosts, so a host of one page is judged by the others.

    Importance is variety times the text outside links times the weight of the node's presentation.  A node whose
    name stands for something beside the main text weighs as much as the text that it holds of what is above.  Others
    weigh 1, unless they stand beside a block of blocks that holds most of the text above: then they weigh by their
    size relative to a fifth of it; paragraphs, lists and tables don't.  Importance doesn't depend on the size of the host.  Headings, html and body have 1:
    they go with the branch that they are in."""
    keys = ["host", "above", "path", "name", "beside"]
    weighed = nodes.join(copies, ["host", "page"], "left").withColumn("w", 1 / F.coalesce("copies", F.lit(1)))
    sums = [F.sum(F.col("w") * F.col(x)).alias(x) for x in ("share", "links", "blocks")]
    values = weighed.groupBy(*keys, "content").agg(F.sum("w").alias("n"), *sums)
    own = settle(values.groupBy(*keys).agg(F.sum("n").alias("m"), F.max("n").alias("most"), *[F.sum(x).alias(x) for x in ("share", "links", "blocks")]))
    chances = F.greatest(F.col("m") - 1, F.lit(0.0))
    every = own.groupBy("name").agg(
        ((F.sum(F.col("m") - F.col("most")) + 0.8 * strength) / (F.sum(chances) + strength)).alias("variety_0"),
        *[(F.sum(x) / F.sum("m")).alias(f"{x}_0") for x in ("share", "links", "blocks")],
    )
    like = lambda x: ((F.col(x) + strength * F.col(f"{x}_0")) / (F.col("m") + strength)).alias(x)
    variety = (F.col("m") - F.col("most") + strength * F.col("variety_0")) / (chances + strength)
    smooth = own.join(every, "name").select(*keys, variety.alias("variety"), like("share"), like("links"), like("blocks"))
    tag = F.substring_index("name", ".", 1)
    main = smooth.where((F.col("blocks") >= 0.5) & ~F.col("beside") & ~tag.isin(*sorted(PROSE))).groupBy("host", "above").agg(F.max("share").alias("main")).where(F.col("main") >= 0.5)
    weight = F.when(F.col("beside"), F.least("share", F.lit(1.0))).when(tag.isin(*sorted(PROSE)), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("share") / (0.2 * F.col("main")), F.lit(1.0))))
    weight = weight * F.when(tag.isin(*sorted(MAIN)), 1.5).otherwise(1.0)
    importance = F.when(tag.isin(*sorted(HEADINGS), "html", "body"), 1.0).otherwise(F.round(F.col("variety") * (1 - F.col("links")) * weight, 9))
    return smooth.join(main, ["host", "above"], "left").select("host", "path", importance.alias("importance"))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.4) -> DataFrame:
    """``page_id, url, text``: one row for each row of ``pages``.

    Branches go whose importance for their site (:func:`style_tree`) is below ``threshold``; headings go only with the
    branch that they are in.  Scripts, styles, forms and the like are no text.  The rest is decoded; white space
    inside a block becomes one space; blocks are joined by one space.  Null and empty pages give an empty text; pages
    without an address form a site of their own; repeated pages have the same text; an empty table gives an empty
    result; further columns, whatever their names, are passed over.

    A page is parsed twice.  Between, only its nodes travel; each page gets the low paths of its own, so neither
    a host with very many pages nor one with very many paths comes together anywhere."""
    host, _ = address_parts(F.col(url))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.coalesce(host, F.lit("")).alias("host")).withColumn("page", F.xxhash64("html"))
    nodes = settle(page_nodes(own))
    copies = own.groupBy("host", "page").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    low = style_tree(nodes, copies).where(F.col("importance") < threshold).select("host", "path")
    gone = nodes.select("host", "page", "path").join(low, ["host", "path"], "left_semi").groupBy("host", "page").agg(F.collect_set("path").alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), frozenset(paths.as_py() or ())) for page, paths in zip(batch.column(2), batch.column(3))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = dict(own.dtypes)
    return own.join(gone, ["host", "page"], "left").select("page_id", "url", "html", "low").mapInArrow(run, f"page_id {kind['page_id']}, url string, text string")
