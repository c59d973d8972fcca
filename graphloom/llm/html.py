"""Main text of web pages, with site templates removed.

Pages are parsed into trees. Templates are found by recurrence: every element subtree is hashed (tag, class, id and
text), Spark counts per host on how many pages of different content each subtree occurs, and subtrees that recur on
many of them are deleted. Pages of equal content count once, so copies of an article do not make it a template, and
paragraphs inside an article or main element are never taken for one. A template lies on at least a hundredth of its
host's pages, so a host has at most a hundred times as many as a page has elements, however many pages it has.

What does not recur is told by tags and roles (menus, headers, footers, sidebars, forms, scripts, styles), and class
names and ids weigh (adverts, notices, reader comments): a name must be made of marks and words of layout alone
("comment-list", not "post-comment-policy"), a paragraph, heading or list item inside an article or main element is
never dropped for its name, and neither is a container that holds half of the content or more. A page's content is its
articles in page order if they hold a quarter of its main element's text (of its body's, if it has none), else that.

Defined cases. Null or blank html gives an empty text; a null or odd url has the host ''. Broken markup is read as
browsers do in the common cases (unclosed paragraphs and list items, stray end tags, unquoted attributes, comments
without end); elements nested deeper than 256 become siblings, none of their text is lost. Repeated rows and page ids
are treated row by row, an empty table gives an empty result, and columns named text or n_chars are replaced.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import per_batch, staged

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select input textarea iframe svg canvas object embed video audio dialog menu title option".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html div section article main td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKS = re.compile(
    r"(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|menu\w*|nav\w*|breadcrumb\w*|sidebar\w*|widget\w*|related|share\w*|sharing|social\w*|comment\w*|disqus\w*|repl(?:y|ies)|footer\w*|popup|modal|newsletter|subscri\w*|login|signup|search\w*|masthead|topbar|toolbar)"
)
# Words of layout, which say nothing of what an element holds.
LAYOUT = frozenset(
    "area article bar block body bottom box btn button buttons cell center col column container content div foot group head header holder icons inner inline item items js layout left line links list main middle mobile nr outer page panel placeholder post posts primary reader readers right row secondary section site slot small sticky text thread title top unit user users view web wide wrap wrapper x".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[A-Za-z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


#: Elements nested deeper become siblings, as in browsers.
DEEPEST = 256


class Node:
    """An element: kids are nodes and texts."""

    __slots__ = ("tag", "marks", "role", "kids", "hash")

    def __init__(self, tag: str, marks: str = "", role: str = "") -> None:
        self.tag, self.marks, self.role, self.kids, self.hash = tag, marks, role, [], 0


def parse(page: str) -> Node:
    root = Node("#root")
    stack = [root]
    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        token, at = m[0], m.end()
        name = _NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, ("p",))
        if tag in CLOSED_BY:
            _close(stack, CLOSED_BY[tag])
        marks = role = ""
        if " " in token or "\n" in token:
            for a in _ATTR.findall(token):
                value = html.unescape(a[1] or a[2] or a[3])
                if a[0].lower() == "role":
                    role = value.lower().strip()
                else:
                    marks += " " + value
        node = Node(tag, marks, role)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag in ("textarea", "title"):
                node.kids.append(page[at:stop])
            at = stop
            if end:
                at = (page.find(">", stop) + 1) or len(page)
        elif tag not in VOID and not token.endswith("/>") and len(stack) < DEEPEST:
            stack.append(node)
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


def _close(stack: list[Node], tags: tuple[str, ...]) -> None:
    """Close an open element of these tags, if nothing that scopes it stands between."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in SCOPES:
            return


def told_by_name(marks: str) -> bool:
    """Whether a class or id is made of marks, with words of layout and numbers beside them only."""
    for name in marks.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        if any(MARKS.fullmatch(w) for w in words) and all(MARKS.fullmatch(w) or w in LAYOUT or len(w) == 1 for w in words):
            return True
    return False


def size_of(node: Node) -> int:
    """Characters of text below an element, without scripts and styles."""
    total, stack = 0, [node]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, str):
                total += len(k)
            elif k.tag not in DROPPED:
                stack.append(k)
    return total


def marked(node: Node, in_content: bool, half: int) -> bool:
    """Whether tag, role or name show that the element is no part of the article. half: half the size of the content."""
    if node.tag in DROPPED or node.role in ROLES or (node.tag == "header" and not in_content):
        return True
    if not node.marks or node.tag in ("body", "html", "#root", "main", "article") or (in_content and node.tag in TEXT_BLOCKS):
        return False
    return told_by_name(node.marks) and size_of(node) < half


def hash_subtrees(node: Node) -> str:
    """Set every element's hash; returns the element's canonical form."""
    inner = "".join(hash_subtrees(k) if isinstance(k, Node) else " ".join(k.split()) for k in node.kids)
    form = f"<{node.tag}{node.marks}>{inner}</>"
    node.hash = int.from_bytes(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return form if len(form) < 200 else f"#{node.hash}"


def contents(root: Node) -> list[Node]:
    """The articles in page order, or the main element, or the page; what is marked does not count."""
    articles: list[Node] = []
    mains: list[Node] = []
    half = (size_of(root) + 1) // 2
    stack = [(k, False) for k in reversed(root.kids) if isinstance(k, Node)]
    while stack:
        node, inside = stack.pop()
        if node.tag != "body" and marked(node, inside, half):
            continue
        if node.tag == "article" and not inside:
            articles.append(node)
        elif node.tag == "main" or node.role == "main":
            mains.append(node)
        stack += [(k, inside or node.tag == "article") for k in reversed(node.kids) if isinstance(k, Node)]
    whole = mains[:1] or [root]
    if articles:
        have, of = (sum(map(len, text_blocks(x, frozenset()))) for x in (articles, whole))
        if 4 * have >= of:
            return articles
    return whole


def text_blocks(nodes: list[Node], templates: frozenset[int] | set[int]) -> list[str]:
    """The blocks of text in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            block = " ".join(html.unescape("".join(run)).split())
            if block:
                out.append(block)
            run.clear()

    half = (sum(map(size_of, nodes)) + 1) // 2

    def walk(node: Node, in_content: bool) -> None:
        for k in node.kids:
            if isinstance(k, str):
                run.append(k)
            elif marked(k, in_content, half) or (k.hash in templates and not (in_content and k.tag in TEXT_BLOCKS)):
                if k.tag not in INLINE:
                    flush()
            elif k.tag in INLINE:
                if k.tag == "br":
                    run.append(" ")
                walk(k, in_content)
            else:
                flush()
                walk(k, in_content or k.tag in ("article", "main"))
                flush()

    for node in nodes:
        walk(node, node.tag in ("article", "main"))
        flush()
    return out


def _elements(nodes: list[Node], in_article: bool) -> Iterator[tuple[int, bool]]:
    """(hash, is a text block) of the elements that can be templates."""
    stack = [k for n in nodes for k in n.kids if isinstance(k, Node)]
    while stack:
        k = stack.pop()
        if k.tag in INLINE or k.tag in ("article", "main", "body", "html", "head"):
            if k.tag not in ("head", "article"):
                stack += [x for x in k.kids if isinstance(x, Node)]
            continue
        block = k.tag in TEXT_BLOCKS
        if not (block and in_article):
            yield k.hash, block
        stack += [x for x in k.kids if isinstance(x, Node)]


def _subtrees(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if not page:
            continue
        root = parse(page)
        hash_subtrees(root)
        own = contents(root)
        content = int.from_bytes(hashlib.blake2b("\n".join(text_blocks(own, frozenset())).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        article = own[0].tag in ("article", "main")
        seen = set(_elements(own, True)) if article else set()
        seen |= set(_elements([root], False))
        rows += [(host, node, block, content) for node, block in seen]
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "node", "block", "content"])


def host_of(url: str) -> F.Column:
    got = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(got, F.lit(""))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = 5, container_share: float = 0.01, block_share: float = 0.3) -> DataFrame:
    """(host, nodes): hashes of the subtrees that recur on at least `least` contents of the host and on at least a share
    of them; the share asked of single text blocks is higher."""
    found = pages.select(host_of(url_col).alias("host"), html_col).mapInArrow(per_batch(_subtrees), "host string, node long, block boolean, content long")
    counted = found.groupBy("host", "node", "block", "content").agg(F.lit(1).alias("x")).groupBy("host", "node", "block").agg(F.count("*").alias("n"))
    counted = staged(counted.where(F.col("n") >= least), "subtrees")
    sizes = pages.select(host_of(url_col).alias("host"), F.xxhash64(html_col).alias("h")).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    share = F.when(F.col("block"), F.lit(block_share)).otherwise(F.lit(container_share))
    many = counted.join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    return many.groupBy("host").agg(F.collect_set("node").alias("nodes"))


def main_text(page: str | None, removed: frozenset[int] | set[int] = frozenset()) -> str:
    if not page:
        return ""
    root = parse(page)
    if removed:
        hash_subtrees(root)
    return "\n".join(text_blocks(contents(root), removed))


def extract(pages: DataFrame, keep: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The columns in keep, text and n_chars."""
    found = staged(templates(pages, url_col, html_col).withColumnRenamed("host", "__host"), "templates")
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*kept, F.col(html_col).alias("__html"), host_of(url_col).alias("__at"))
    rows = rows.join(found, F.col("__at") == F.col("__host"), "left").select(*[f"k{i}" for i in range(len(keep))], "__html", "nodes")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        page, nodes = batch.column(len(keep)), batch.column(len(keep) + 1)
        known: dict[bytes, frozenset[int]] = {}
        texts = []
        for i in range(batch.num_rows):
            removed: frozenset[int] = frozenset()
            if nodes[i].is_valid:
                raw = np.asarray(nodes[i].values.to_numpy())
                key = raw.tobytes()
                if key not in known:
                    known[key] = frozenset(raw.tolist())
                removed = known[key]
            texts.append(main_text(page[i].as_py(), removed))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[: len(keep)], "text", "n_chars"])

    fields = [T.StructField(f"k{i}", pages.schema[c].dataType) for i, c in enumerate(keep)]
    done = rows.mapInArrow(per_batch(run), T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c not in ("text", "n_chars")], "text", "n_chars")
