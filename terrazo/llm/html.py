"""HTML extraction by site style trees.

The pages of a host are merged into one tree whose nodes are tag paths (tags with class and id); all that is text on the page is
in it. Each node is judged by entropies over the m pages that have it:

* presentation: -sum p log_m p over the ways in which its children follow each other;
* content: one less the mean, over the sentences of its branch, of log_m(pages that say the same there);
* importance: (1 - DECAY ** l) * presentation + DECAY ** l * content, where l is the number of presentations.

A branch that says the same on all pages in the same form, a menu or a footer, is of low importance; one whose text differs is
of high importance. A tree of few pages tells little, so a host's importance is drawn to that of the same path on all hosts, its
parent tree, by PRIOR pages: a host with one page is judged by the parent tree alone. What all hosts say alike isn't important on one
of them either: the lesser of the two is a branch's importance. A branch is removed if it and all branches in it are under CUT.

Markup that states a role is a prior beside the tree: where a page has an article or main element only that is read, and its
headings and paragraphs stay; elements and ARIA roles for navigation, headers outside the article, footers, sidebars, forms and
the like go, since reader comments and adverts may differ on each page; words of class and id that name such parts count too,
unless the tree finds the branch important and half of the host's text in it. extract_pages(..., hints=False) goes by the tree alone.

Statistics are sums by (host, node, value): pages are counted batch by batch before they move, and a
host of any size is some rows for each node and value. What goes back to the pages is the list of a host's
removed nodes.

Defined cases: a null, empty or textless page has text ""; broken markup is read as browsers do in the usual cases
(open p, li, td and the like end where the next begins; stray end tags are passed over; an open comment or script
runs to the end); what is nested deeper than a path of DEEP characters is text of the block there; a null url is of a host of its own, ""; repeated pages count as pages; an empty table gives an empty one;
other columns of pages, whatever their names, are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Importance under which a branch goes.
CUT = 0.4
#: Pages that the parent tree counts for in a host's tree.
PRIOR = 4
#: Weight of the content against the presentation: DECAY ** (number of presentations).
DECAY = 0.9
#: Share of a host's text in a branch from which on words of its class don't remove it.
MOST = 0.5
#: Length of a path; what lies deeper belongs to the block there.
DEEP = 4000
#: Nodes of removed branches that are sent to every executor at most; beyond, pages meet them by host, in SALT parts of each.
FEW, SALT = 200_000, 64

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content isn't text of the page.
UNSEEN = RAW | frozenset("head svg canvas object embed applet audio video datalist map".split())
DROPPED = frozenset("nav footer aside form script style noscript iframe button select option textarea input label svg canvas object embed applet template head title menu dialog map audio video datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog".split())
KEPT_ROLES = frozenset("article main".split())
#: Words of class and id that name what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners promo promotion promoted sponsor sponsored sponsors"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc"
    " sidebar sidebars aside rail widget widgets footer footnav masthead topbar toolbar"
    " comment comments commentlist respond reply replies discussion disqus"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall"
    " share sharing social related recommended recommendations trending popular outbrain taboola skip".split()
)
#: An open element on the left ends where one on the right begins.
CLOSES = {
    "p": BLOCK - {"body", "html"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
#: Elements beyond which an implied or stray end tag does not reach.
SCOPE = frozenset("table td th ul ol dl article section div body html main button".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?;:|\u00b7\u2022\u2013\u2014\u3002]+")
_HOST = re.compile(r"^[^:]*://([^/?#]*)")


class Node:
    __slots__ = ("children", "classes", "parent", "role", "tag")

    def __init__(self, tag: str, classes: str, role: str, parent: Node | None):
        self.tag, self.classes, self.role, self.parent = tag, classes, role, parent
        self.children: list[Node | str] = []


def parse(source: str) -> Node:
    root = node = Node("#root", "", "", None)
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            node.children.append(source[at:])
            break
        if m.start() > at:
            node.children.append(source[at : m.start()])
        at = m.end()
        if m[2]:
            tag, attrs = m[2].lower(), {}
            if m[3] and "=" in m[3]:
                attrs = {k.lower(): a or b or c or "" for k, a, b, c in reversed(_ATTR.findall(m[3]))}
            if tag in BLOCK or tag in CLOSES:
                node = _imply(node, tag)
            new = Node(tag, f"{attrs.get('class', '')} {attrs.get('id', '')}".strip(), attrs.get("role", ""), node)
            node.children.append(new)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                new.children.append(source[at : end.start() if end else n])
                at = end.end() if end else n
            elif tag not in VOID and not (m[3] or "").rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
                node = new
        elif m[1]:
            tag, up = m[1].lower(), node
            while up.parent is not None and up.tag != tag and not (up.tag in SCOPE and tag not in SCOPE):
                up = up.parent
            if up.parent is not None and up.tag == tag:
                node = up.parent
    return root


def _imply(node: Node, tag: str) -> Node:
    """The node under which an element with this tag begins, once open elements that it ends are closed."""
    up = node
    while up.parent is not None:
        if tag in CLOSES.get(up.tag, ()):
            return _imply(up.parent, tag)
        if up.tag in SCOPE:
            break
        up = up.parent
    return node


def name(node: Node) -> str:
    """Tag with class and id, digits left out, so that numbered ids fall together."""
    return node.tag if not node.classes else f"{node.tag}.{re.sub(r'[0-9]+', '', node.classes)}"


def below(path: str, node: Node) -> str:
    return path if len(path) > DEEP else f"{path}/{name(node)}"


def noise(node: Node, inside: bool) -> int:
    """Whether markup states that a node isn't the article: 2 by its element or role, 1 by words of class or id, else 0.

    inside: it is within an article or main element.
    """
    if node.tag in DROPPED or node.role.lower() in DROPPED_ROLES:
        return 2
    if node.tag == "header":
        return 0 if inside else 2
    if node.tag in ("html", "body", "article", "main") or not node.classes:
        return 2 if node.tag == "article" and node.classes and not NOISE.isdisjoint(_WORDS.findall(node.classes.lower())) and inside else 0
    return int(not NOISE.isdisjoint(_WORDS.findall(node.classes.lower())))


def squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


def signature(node: Node) -> str:
    """Presentation: the children's names, repeats in a row once."""
    out: list[str] = []
    for c in node.children:
        if isinstance(c, Node) and (not out or out[-1] != name(c)):
            out.append(name(c))
    return ">".join(out)


def path_hash(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


def style_nodes(root: Node) -> list[tuple[int, tuple[int, ...], str, list[str], int]]:
    """(path, paths of the branches that it is in, itself included, presentation, sentences, characters of text in the branch) of
    each block element; equal paths come often. Text of inline elements belongs to the block around them."""
    out: list[list] = []
    # (node, path, record of the block that it is in)
    stack: list[tuple[Node, str, list]] = [(root, "", [0, (), "", [], [], -1])]
    while stack:
        node, path, own = stack.pop()
        for c in node.children:
            if isinstance(c, str):
                own[3].append(c)
            elif c.tag not in UNSEEN:
                p = below(path, c)
                if c.tag in BLOCK and p is not path:
                    own[3].append("\n")  # text before a block isn't one sentence with text after it
                    key = path_hash(p)
                    record = [key, (*own[1], key), signature(c), [], [], own[5]]
                    record[5] = len(out)
                    record[4] = [own[5]] if own[5] >= 0 else []
                    out.append(record)
                    stack.append((c, p, record))
                else:
                    own[3].append(" ")
                    stack.append((c, p, own))
    sizes = [0] * len(out)
    for i in range(len(out) - 1, -1, -1):  # a block comes after the one that it is in
        record = out[i]
        record[3] = [t for part in "".join(record[3]).split("\n") if part.strip() for x in _SENTENCE.split(html.unescape(part)) if (t := " ".join(x.split()).lower())]
        sizes[i] += sum(map(len, record[3]))
        for up in record[4]:
            sizes[up] += sizes[i]
    return [(r[0], r[1], r[2], r[3], n) for r, n in zip(out, sizes, strict=True)]


def containers(root: Node) -> list[Node]:
    """The outermost article or main elements, articles before main, those outside of parts that aren't the article first; else the whole."""
    found: dict[tuple[str, bool], list[Node]] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, doubt = stack.pop()
        for c in reversed(node.children):
            if isinstance(c, Node) and c.tag not in RAW:
                what = noise(c, True)
                if what == 2 and c.tag != "label":
                    continue
                kind = "article" if "article" in (c.tag, c.role.lower()) else "main" if "main" in (c.tag, c.role.lower()) else ""
                if kind and not what:
                    found.setdefault((kind, doubt), []).append(c)
                    if kind == "article":
                        continue
                stack.append((c, doubt or bool(what)))
    for doubt in (False, True):
        articles, mains = found.get(("article", doubt), []), found.get(("main", doubt), [])
        if mains and articles:
            return [a for a in articles if any(_under(a, m) for m in mains)] or mains
        if articles or mains:
            return articles or mains
    return [root]


def _under(node: Node, top: Node) -> bool:
    while node is not None and node is not top:
        node = node.parent
    return node is top


NONE: frozenset[int] = frozenset()


def extract(source: str | None, removed: frozenset[int] = NONE, spared: frozenset[int] = NONE, hints: bool = True) -> str:
    """The main text: blocks in page order, joined by two line ends. removed, spared: paths that the tree takes away, or keeps against their class."""
    root = parse(source or "")
    tops = containers(root) if hints else [root]
    inside = tops[0] is not root
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = squeeze("".join(line))
        if text:
            blocks.append(text)
        line.clear()

    def gone(c: Node, path: str) -> bool:
        if c.tag in UNSEEN:
            return True
        if hints:
            what = noise(c, inside)
            if what == 2 or what == 1 and not (spared and path_hash(path) in spared):
                return True
            if inside and c.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "main"):
                return False
        return bool(removed) and c.tag in BLOCK and path_hash(path) in removed

    def walk(top: Node, path: str) -> None:
        # [node, path, next child]
        stack: list[list] = [[top, path, 0]]
        while stack:
            frame = stack[-1]
            node, path, i = frame
            if i == len(node.children):
                stack.pop()
                if node.tag in BLOCK:
                    end()
                continue
            frame[2] += 1
            c = node.children[i]
            if isinstance(c, str):
                line.append(c)
                continue
            if c.tag == "br":
                line.append(" ")
                continue
            p = below(path, c)
            if c.tag in BLOCK:
                end()
            if not gone(c, p):
                stack.append([c, p, 0])

    for top in tops:
        walk(top, path_of(top))
        end()
    return "\n\n".join(blocks)


def path_of(node: Node) -> str:
    nodes, path = [], ""
    while node.parent is not None:
        nodes.append(node)
        node = node.parent
    for x in reversed(nodes):
        path = below(path, x)
    return path


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


NODE = "host string, path long, up array<long>, kind int, value long, pages long, chars long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a batch: host, path, branches that it is in, kind (0: presentation, 1: content, 2: the node), value, pages, characters."""
    for batch in batches:
        sums: Counter = Counter()
        chars: Counter = Counter()
        ups: dict[int, tuple[int, ...]] = {}
        for url, source in zip(batch.column(0), batch.column(1), strict=True):
            host = host_of(url.as_py())
            seen: set[tuple[int, int, int]] = set()
            for path, up, style, texts, n in style_nodes(parse(source.as_py() or "")):
                ups[path] = up
                seen.add((path, 0, xxhash.xxh64_intdigest(style) - (1 << 63)))
                seen.add((path, 2, 0))
                seen.update((path, 1, xxhash.xxh64_intdigest(t) - (1 << 63)) for t in texts)
                chars[host, path] += n
            sums.update((host, *x) for x in seen)
        rows = [(h, p, ups[p] if k == 2 else None, k, v, c, chars[h, p] if k == 2 else 0) for (h, p, k, v), c in sums.items()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in NODE.split(", ")])


def _judged(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, path, pages, style, content and importance of each node. counts: by, path, up, kind, value, c, chars."""
    c = F.col("c").cast("double")
    of = lambda kind, v: F.sum(F.when(F.col("kind") == kind, v))
    node = counts.groupBy(*by, "path").agg(
        of(2, c).alias("m"), of(0, c).alias("styles"), of(0, c * F.log(c)).alias("style_sum"), of(0, F.lit(1)).alias("l"), of(1, c).alias("texts"), of(1, c * F.log(c)).alias("text_sum"),
        F.max("up").alias("up"), F.sum("chars").alias("chars"),
    )
    m = F.col("m")
    said = F.when(m > 1, F.least(F.lit(1.0), F.col("text_sum") / (F.col("texts") * F.log(m)))).otherwise(F.lit(0.0))
    style = F.when(m > 1, F.col("style_sum") / (F.col("styles") * F.log(m))).otherwise(F.lit(0.0))
    # On m pages of which c have a value: -sum(c/m * log_m(c/m)) = 1 - sum(c log c) / (m log m).
    node = node.withColumn("style", 1 - style).withColumn("same", F.coalesce(said * F.col("texts"), F.lit(0.0)))
    # A branch's content is the mean over the sentences of all blocks in it: each block's sums go to the blocks around it.
    branch = node.select(*by, F.explode("up").alias("path"), "texts", "same").groupBy(*by, "path").agg(F.sum("texts").alias("texts"), F.sum("same").alias("same"))
    content = F.when(F.col("texts") > 0, 1 - F.col("same") / F.col("texts"))
    own = F.pow(F.lit(DECAY), F.col("l"))
    out = node.drop("texts", "same").join(branch, [*by, "path"]).withColumn("content", content)
    importance = F.when(F.col("content").isNull(), F.col("style")).otherwise((1 - own) * F.col("style") + own * F.col("content"))
    return out.select(*by, "path", m.cast("long").alias("pages"), "chars", "up", "style", "content", importance.alias("importance"))


def style_tree(pages: DataFrame, scratch: Scratch, prior: float = PRIOR) -> DataFrame:
    """host, path, pages, own (importance on the host), parent (on all hosts), importance (the lesser), best (of the branches in it, itself
    included), share (of the host's text in the branch)."""
    counts = pages.select("url", "html").mapInArrow(_counts, NODE)
    merged = counts.groupBy("path", "kind", "value", "host").agg(F.sum("pages").alias("c"), F.max("up").alias("up"), F.sum("chars").alias("chars"))
    merged = scratch.cut(merged, "counts")
    hosts = _judged(merged, ["host"])
    parent = _judged(merged.groupBy("path", "kind", "value").agg(F.sum("c").alias("c"), F.max("up").alias("up"), F.sum("chars").alias("chars")), [])
    parent = parent.select("path", F.col("importance").alias("parent"))
    whole = hosts.where(F.size("up") == 1).groupBy("host").agg(F.sum("chars").alias("all_chars"))
    known = F.col("pages") - 1
    tree = (
        hosts.withColumnRenamed("importance", "own").join(parent, "path").join(whole, "host")
        .withColumn("importance", F.least(F.col("parent"), (known * F.col("own") + prior * F.col("parent")) / (known + prior)))
        .withColumn("share", F.when(F.col("all_chars") > 0, F.col("chars") / F.col("all_chars")).otherwise(0.0))
    )
    tree = scratch.cut(tree.select("host", "path", "up", "pages", "own", "parent", "importance", "share"), "judged")
    best = tree.select("host", F.explode("up").alias("path"), "importance").groupBy("host", "path").agg(F.max("importance").alias("best"))
    return tree.drop("up").join(best, ["host", "path"])


def extract_pages(pages: DataFrame, cut: float = CUT, prior: float = PRIOR, hints: bool = True) -> DataFrame:
    """pages' page_id and url, text, n_chars and removed (nodes of the host that were removed for low importance)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    tree = scratch.cut(style_tree(pages, scratch, prior), "tree")
    low, high = F.col("best") < cut, (F.col("importance") >= cut) & (F.col("share") >= MOST)
    lists = tree.where(low | high).groupBy("host").agg(F.collect_set(F.when(low, F.col("path"))).alias("removed"), F.collect_set(F.when(high, F.col("path"))).alias("spared"))
    lists = scratch.cut(lists, "lists")
    n = lists.agg(F.sum(F.size("removed") + F.size("spared"))).first()[0] or 0
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("_host"))
    if n <= FEW:
        joined = rows.join(F.broadcast(lists), F.col("_host") == F.col("host"), "left")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)))
        lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.join(lists, (F.col("_host") == F.col("host")) & (F.col("_salt") == F.col("salt")), "left")
    joined = joined.select("page_id", "url", "html", "removed", "spared")
    id_type = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for source, *paths in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True):
                removed, spared = (frozenset(x.as_py() or ()) for x in paths)
                texts.append(extract(source.as_py(), removed, spared, hints))
                gone.append(len(removed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int32())], names=["page_id", "url", "text", "n_chars", "removed"])

    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long, removed int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


