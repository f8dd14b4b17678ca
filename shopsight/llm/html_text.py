"""HTML extraction: the article's text, without what a site repeats on its pages.

Every page is parsed to a tree, and every element's subtree is hashed (tag, class
and id, texts, children). Spark counts per host on how many pages with different
articles each subtree stands. Outside articles, a subtree on ``MIN_PAGES`` of them
or more is the site's template, however many pages the host has, and is deleted
wherever it occurs there on that host; inside articles it must stand on
the share ``MIN_SHARE`` of the host's articles too. What a template does not show,
such as on hosts of few pages, tags, roles and class names of page furniture do.

The article is the page's ``article`` or ``main`` element, else its body. Inside
an article, paragraphs and headings are never template: texts may repeat
sentences. Its title block stays, whatever its class. Pages with one article text count
once, so copies of a page make no template of it.

A class or id is furniture if all its parts between hyphens and underscores are
names of furniture or of places and boxes (``site-header``, ``comment-list``), and
one is of furniture; ``no-sidebar``, ``has-comments`` and ``share-price`` are not. Paragraphs
and headings are furniture by the names of adverts and notices only, article
elements by those of reader comments only.

Text rules: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined in page order by one space; inline tags
separate nothing.

Defined cases: a null or empty page has an empty text; a page without an address
belongs to the host ''; unclosed, misnested and unknown tags are read as browsers
read them, as far as text order goes; very long pages are taken whole, one at a time;
repeated rows get equal results; of counts equal to a threshold the subtree goes; columns
other than page_id, url and html are not read, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.session import materialize

#: A subtree is template if it stands on so many pages of a host with different articles,
MIN_PAGES = 4
#: and, inside an article, on this share of them.
MIN_SHARE = 0.25

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these ends an open element of the listed kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE_BLOCKS = HEADINGS | {"p", "blockquote", "pre"}
#: Never template inside an article.
PROSE = PROSE_BLOCKS | {"b", "i", "em", "strong", "a", "span", "code", "q", "cite", "sub", "sup", "u", "mark", "small"}

FURNITURE_TAGS = RAW | set("head nav footer aside form button select input dialog menu svg canvas object audio video map".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Names of furniture in classes and ids, by what they mark; each also stands in the plural.
NOTICES = set("ad advert advertisement advertising banner consent cookie gdpr notice notification popup promo promoted promotion sponsor sponsored".split())
COMMENTS = set("comment commentlist disqus reply replies respond".split())
TITLES = set("header masthead".split())
FURNITURE = NOTICES | COMMENTS | set(
    "breadcrumb footer menu modal nav navbar navigation newsletter overlay recommended related share sharing sidebar signup skip social subscribe toolbar widget".split()
)
# Words that leave a name of furniture what it is.
PLACES = set(
    "area author banner bar block body bottom box button buttons children column container content desktop first fixed form global group holder"
    " icons inner item items last left link links list main mobile nav outer page panel primary right rail secondary section site slot sticky"
    " text thread to top unit wrap wrapper".split()
)
NAME_PARTS = re.compile(r"[a-z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def named(names: str, kinds: set[str]) -> bool:
    """Whether a class or id of the list names something of these kinds."""
    for name in names.lower().split():
        parts = [p if p in kinds else p.removesuffix("s") for p in NAME_PARTS.findall(name)]
        if any(p in kinds for p in parts) and all(p in kinds or p in PLACES or p + "s" in PLACES or p.isdigit() for p in parts):
            return True
    return False


class Node:
    __slots__ = ("tag", "names", "furniture", "title", "children", "digest", "has_text", "is_main", "holds_main")

    def __init__(self, tag: str, attributes: str):
        found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        self.tag = tag
        self.names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        self.furniture = tag not in ("html", "body", "main") and (
            tag in FURNITURE_TAGS
            or found.get("role", "").lower() in FURNITURE_ROLES
            or bool(self.names and named(self.names, COMMENTS if tag == "article" else NOTICES if tag in PROSE_BLOCKS else FURNITURE))
            or "hidden" in found
            or bool(HIDDEN.search(found.get("style", "")))
        )
        # a title block: furniture outside an article
        self.title = tag == "header" or bool(self.names and tag not in ("html", "body", "main", "article") and tag not in PROSE_BLOCKS and named(self.names, TITLES))
        self.children: list[Node | str] = []
        self.digest = 0
        self.has_text = False
        self.is_main = self.holds_main = tag in ("article", "main") or found.get("role", "").lower() == "main"


def parse(page: str) -> Node:
    """The page's tree, with hashes of all subtrees."""
    root = Node("", "")
    stack, open_tags = [root], {}

    def close() -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        own = [node.tag, node.names]
        for child in node.children:
            if isinstance(child, str):
                words = " ".join(child.split())
                node.has_text |= bool(words)
                own.append(words)
            else:
                node.has_text |= child.has_text
                own.append(str(child.digest))
        node.digest = xxhash.xxh3_64_intdigest("\x1f".join(own).encode("utf-8", "surrogatepass")) - (1 << 63)
        stack[-1].holds_main |= node.holds_main
        stack[-1].children.append(node)

    def close_through(tags: set[str], within: frozenset[str]) -> None:
        """Close the nearest open element of these tags, unless one that bounds it is nearer."""
        if any(open_tags.get(t) for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    while len(stack) > i:
                        close()
                    return
                if stack[i].tag in within:
                    return

    lists, cells, nothing = frozenset({"ul", "ol", "menu", "dl", "select"}), frozenset({"table"}), frozenset()
    scopes = frozenset({"table", "td", "th", "button", "object", "caption"})
    at = 0
    while (match := TAG.search(page, at)) is not None:
        if match.start() > at:
            stack[-1].children.append(entities.unescape(page[at : match.start()]))
        at = match.end()
        closing, tag, attributes = match.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            close_through({tag}, cells if tag in ("li", "p", "div") else nothing)
            continue
        if tag in ENDS_P:
            close_through({"p"}, scopes)
        if tag in ENDS:
            close_through(ENDS[tag], lists if tag in ("li", "dt", "dd", "option") else cells)
        node = Node(tag, attributes)
        if tag in VOID:
            stack[-1].children.append(node)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            stack[-1].children.append(node)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
        else:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        stack[-1].children.append(entities.unescape(page[at:]))
    while len(stack) > 1:
        close()
    return root


def _mains(root: Node) -> list[Node]:
    """The outermost article or main elements that are not furniture; the whole page if there is none.

    Those inside furniture count only if there are no others.
    """
    for through_furniture in (False, True):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            inner = [c for c in node.children if isinstance(c, Node) and c.holds_main]
            inner = [c for c in inner if not c.furniture or (through_furniture and c.tag != "article")]
            if node.is_main and (node.tag == "article" or not inner):
                found.append(node)
            else:
                todo.extend(reversed(inner))
        if found:
            return found
    return [root]


def _candidates(root: Node, mains: list[Node]) -> Iterator[tuple[Node, bool]]:
    """Elements that can be template, and whether they are inside an article.

    Outside all with text that do not hold the article, inside those that are not prose.
    """
    main_ids = {id(m) for m in mains if m is not root}
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside |= id(node) in main_ids
        for child in node.children:
            if isinstance(child, Node):
                if child.has_text and not child.holds_main and id(child) not in main_ids and not (inside and child.tag in PROSE):
                    yield child, inside
                todo.append((child, inside))


def article_text(root: Node, mains: list[Node], template: set[int]) -> str:
    """The joined blocks of the article, without subtrees whose hashes are in ``template``."""
    gone = {id(n) for n, _ in _candidates(root, mains) if n.digest in template} if template else set()
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        words = " ".join("".join(run).split())
        if words:
            blocks.append(words)
        run.clear()

    for main in mains:
        todo: list[Node | str | None] = [main]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
            elif item is not main and (item.furniture or id(item) in gone or (item.title and main is root)):
                if item.tag in BLOCKS:
                    flush()
            elif item.tag == "br":
                run.append(" ")
            else:
                block = item.tag in BLOCKS
                if block:
                    flush()
                    todo.append(None)
                todo.extend(reversed(item.children))
        flush()
    return " ".join(blocks)


def host_of(url: str = "url") -> Column:
    """The lower-case host of an address, without port; '' if there is none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), F.lit("")))


def _placed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host and page (a hash of the html) of every page."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), host_of().alias("host"), F.xxhash64(html).alias("page"))


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page, article (a hash of its text), subtree, inside and shown: each different candidate of each page, and a row without one.

    ``shown``: it would be part of the page's text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, name, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                root = parse(page)
                mains = _mains(root)
                article = xxhash.xxh3_64_intdigest(article_text(root, mains, set()).encode("utf-8", "surrogatepass")) - (1 << 63)
                whole = mains == [root]
                rows += [(host, name, article, digest, inside, inside or whole) for digest, inside in {(n.digest, inside) for n, inside in _candidates(root, mains)}]
                rows.append((host, name, article, None, False, False))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["host", "page", "article", "subtree", "inside", "shown"])

    return _placed(pages).select("host", "page", "html").mapInArrow(run, "host string, page bigint, article bigint, subtree bigint, inside boolean, shown boolean")


def host_templates(found: DataFrame) -> DataFrame:
    """host, subtree and inside of the subtrees that the host repeats; ``found`` as of ``subtrees``."""
    counts = materialize(found.select("host", "article", "subtree", "inside").distinct().groupBy("host", "subtree", "inside").agg(F.count("*").alias("n")))
    totals = counts.where(F.col("subtree").isNull()).select("host", F.col("n").alias("articles"))
    often = counts.where(F.col("subtree").isNotNull() & (F.col("n") >= MIN_PAGES)).join(materialize(totals), "host")
    return often.where(~F.col("inside") | (F.col("n") >= MIN_SHARE * F.col("articles"))).select("host", "subtree", "inside")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = materialize(subtrees(pages))
    repeated = found.where("shown").join(materialize(host_templates(found)), ["host", "subtree", "inside"], "left_semi")
    # at most a page's elements; pages without any have no row
    templates = materialize(repeated.groupBy("host", "page").agg(F.collect_set("subtree").alias("template")))
    rows = _placed(pages).join(templates, ["host", "page"], "left").select("page_id", "url", "html", "template")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, template in zip(*(batch.column(c).to_pylist() for c in ("html", "template"))):
                root = parse(page)
                texts.append(article_text(root, _mains(root), set(template or ())))
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
