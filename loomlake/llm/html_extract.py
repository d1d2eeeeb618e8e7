"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted by how much of it is link text; the sum of its
children's densities finds the subtree that holds the article, and the least density on the path from
the body to that subtree is the threshold that other subtrees must reach to count as content too.
Parts that say what they are (menus, forms, adverts by element, role or class) are cut off before, but for
those that hold an article or most of the text: a class may also tell how a wrapper looks. These are left to density.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of the HTML standard, by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
CUT = set("head script style noscript template iframe svg nav footer aside form button select option input textarea label fieldset dialog menu object embed canvas video audio".split())
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
WRAPS = {"form", "fieldset"}  # cut off as a rule, but some pages are one form as a whole
KEEP = {"html", "body", "article", "main"}
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table select body html article section main div".split())
# Words in class, id and role that mark what is no part of the article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner billboard sidebar side menu menubar nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead topbar comment comments commentlist respond disqus notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe signup share sharing social "
    "related recommended recommendations widget toolbar pagination pager login search copyright disclaimer hidden skip complementary contentinfo dialog form".split()
)
#: Of these, words that also name parts of an article: inside one they cut only what is mostly links.
WEAK = {"header", "related", "recommended", "side"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$|")""", re.I | re.S)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "items", "cut", "marked", "weak", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, cut: bool, marked: bool = False, weak: bool = False):
        self.tag, self.parent, self.cut, self.marked, self.weak = tag, parent, cut, marked, weak
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _says(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is cut off in any case (by its name, or as it isn't shown), whether it is marked as no part of the article, and
    whether only by words that name parts of articles, too."""
    if tag in CUT and tag not in WRAPS or tag == "header" and not inside:
        return True, False, False
    marked, words = tag in WRAPS, set()
    if not attributes or tag in KEEP:
        return False, marked, False
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False, False
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False, False
        elif tag not in HEADINGS:
            words |= MARKS.intersection(w.lower() for w in WORDS.findall(value))
    return False, marked or bool(words), not marked and inside and bool(words) and words <= WEAK


class _Open:
    """The open elements, counted by name in each part that bounds a search, so that a name that isn't open is told at once.

    ``scopes``: since each of the elements that end the search for an implied end tag; ``kept``: since each article or main element.
    """

    def __init__(self, root: Node):
        self.here, self.every = root, Counter()
        self.scopes: list[tuple[Node, Counter]] = [(root, Counter())]
        self.kept: list[tuple[Node, Counter]] = [(root, Counter())]

    def push(self, x: Node) -> None:
        for counts in (self.every, self.scopes[-1][1], self.kept[-1][1]):
            counts[x.tag] += 1
        if x.tag in SCOPES or x.tag == "td":
            self.scopes.append((x, Counter()))
        if x.tag in ("article", "main"):
            self.kept.append((x, Counter()))
        self.here = x

    def close(self, x: Node) -> None:
        """Closes ``x`` and all that is open in it."""
        y = self.here
        while y is not x.parent:
            for frames in (self.scopes, self.kept):
                if frames[-1][0] is y:
                    frames.pop()
            for counts in (self.every, self.scopes[-1][1], self.kept[-1][1]):
                counts[y.tag] -= 1
            y = y.parent
        self.here = x.parent

    def up_to(self, names: set[str]) -> Node:
        x = self.here
        while x.tag not in names:
            x = x.parent
        return x

    def ended_by(self, tag: str) -> Node | None:
        """The open element that a start tag ends."""
        ends = SIBLINGS.get(tag, {"p"})
        for node, counts in reversed(self.scopes):
            if any(counts[t] for t in ends):
                return self.up_to(ends)
            if node.tag in ends:
                return node
            if node.tag != "td" or tag == "p":
                return None
        return None

    def named(self, tag: str) -> Node | None:
        """The open element that an end tag names; none outside of the article or main element around."""
        counts = self.every if tag in KEEP else self.kept[-1][1]
        return self.up_to({tag}) if counts[tag] else None


def parse(page: str) -> Node:
    """The page as a tree; missing end tags are implied, stray ones are skipped, text is decoded. Time is linear in the page."""
    root = Node("html", None, False)
    tree = _Open(root)
    at, last = 0, page.rfind(">")  # behind it no tag ends
    scan = TOKEN.search
    while at <= last and (m := scan(page, at)) is not None:
        if m.start() > at:
            tree.here.items.append(html_lib.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if closing:
            x = tree.named(tag)
            if tag == "br":
                tree.here.items.append(Node("br", tree.here, False))
            elif x is not None and x.parent is not None:
                tree.close(x)
            continue
        if tag == "html":
            continue
        if (tag in CLOSES_P or tag in SIBLINGS) and (x := tree.ended_by(tag)) is not None and x.parent is not None:
            tree.close(x)
        attributes = m[3] or m[6] or ""
        node = Node(tag, tree.here, *_says(tag, attributes, len(tree.kept) > 1))
        tree.here.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
        elif tag not in VOID and not attributes.endswith("/"):
            tree.push(node)
    rest = page[at:]
    if (cut := rest.find("<!--")) >= 0 and at > last:
        rest = rest[:cut]
    if rest:
        tree.here.items.append(html_lib.unescape(rest))
    return root


def _walk(root: Node) -> list[Node]:
    """The nodes that aren't cut off; children come first."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.items if isinstance(c, Node) and not c.cut]
    order.reverse()
    return order


def _cut_marked(root: Node) -> set[int]:
    """Cuts marked nodes off that hold neither an article or main element nor most of the body's text outside links.

    A node of most of the text is still cut where article and main elements outside it hold a quarter as much: then
    the page itself says where its article is, and a short one stays apart from long adverts or comments.
    Returns the ids of the nodes of most of the text.
    """
    order = _walk(root)
    plain: dict[int, int] = {}  # text outside links, and all text
    total: dict[int, int] = {}
    whole: set[int] = set()
    for x in order:
        n = k = 0
        for c in x.items:
            if isinstance(c, str):
                own = len(c) - sum(map(c.count, " \n\t\r"))
                n, k = n + own, k + own
            elif not c.cut:
                n, k = n + plain[id(c)], k + total[id(c)]
                if c.tag in ("article", "main") or id(c) in whole:
                    whole.add(id(x))
        plain[id(x)], total[id(x)] = 0 if x.tag == "a" else n, k
    body = next((x for x in reversed(order) if x.tag == "body"), root)
    most = plain[id(body)] or plain[id(root)]
    articles, around = 0, {}  # text of all outermost article and main elements, and of the one around a node
    for x in reversed(order):  # parents first
        own = around.get(id(x.parent))
        if own is None and x.tag in ("article", "main"):
            own = plain[id(x)]
            articles += own
        around[id(x)] = own
    for x in order:
        if x.weak and id(x) not in whole:  # a header or section of the article: only what is mostly links goes
            x.cut = 2 * plain[id(x)] <= total[id(x)]
        else:
            x.cut = x.marked and id(x) not in whole and (2 * plain[id(x)] <= most or 4 * (articles - (around[id(x)] or 0)) >= plain[id(x)] > 0)
    return {i for i, n in plain.items() if 2 * n > most}


def _count(root: Node) -> list[Node]:
    """Characters, tags, link characters and link tags of each node that isn't cut off; children come first."""
    order = _walk(root)
    for x in order:
        for c in x.items:
            if isinstance(c, str):
                x.chars += len(c) - sum(map(c.count, " \n\t\r"))
            elif not c.cut:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.chars if c.tag == "a" else c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
    return order


def content(root: Node) -> list[Node]:
    """The nodes whose whole subtrees are the article, in page order."""
    large = _cut_marked(root)
    order = _count(root)
    body = next((x for x in reversed(order) if x.tag == "body"), root)
    body = body if body.chars else root
    share = body.link_chars / max(1, body.chars)
    for x in order:
        if not x.chars:
            continue
        tags, links, link_tags = max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        base = log(x.chars / max(1, x.chars - x.link_chars) * x.link_chars + share * x.chars + e)
        x.density = x.chars / tags * max(0.0, log(x.chars / links * tags / link_tags) / log(max(base, 1 + 1e-9)) if base > 1 else log(x.chars / links * tags / link_tags))
        if x.parent is not None:
            x.parent.total += x.density
    within = [x for x in order if x.chars]
    if not within:
        return []
    best = max(reversed(within), key=lambda x: (x.total or x.density))
    threshold, x, path = best.density, best, set()
    while x is not None and x is not body.parent:
        path.add(id(x))
        threshold, x = min(threshold, x.density), x.parent
    # what is marked but holds an article must reach the threshold too, or most of the text
    for x in within:
        if x.marked and not x.weak and id(x) not in path and id(x) not in large:
            x.cut = x.density < threshold or x.link_chars * 2 >= x.chars
    # widen to the article that the densest subtree belongs to
    x, whole = best, None
    while x is not None:
        whole, x = (x if x.tag in ("article", "main") else whole), x.parent
    if whole is not None:
        # and the other articles that reach the threshold, in page order
        found, stack = [], [body]
        while stack:
            x = stack.pop()
            if x is whole or x.tag in ("article", "main") and x.density >= threshold and x.link_chars * 2 < x.chars:
                found.append(x)
            else:
                stack += [c for c in reversed(x.items) if isinstance(c, Node) and not c.cut]
        return found if whole in found else [whole]
    # else the densest subtree of each part that reaches the threshold
    marked, stack = [], [best]
    chosen = {id(best)}
    siblings = best
    while siblings is not body and siblings.parent is not None:
        before = True  # a heading above the article belongs to it, however short
        for c in siblings.parent.items:
            before &= c is not siblings
            if isinstance(c, Node) and not c.cut and c is not siblings and c.chars and (c.density >= threshold or before and c.tag in HEADINGS) and c.link_chars * 2 < c.chars:
                chosen.add(id(c))
        siblings = siblings.parent
    stack = [body]
    while stack:
        x = stack.pop()
        if id(x) in chosen:
            marked.append(x)
        else:
            stack += [c for c in reversed(x.items) if isinstance(c, Node) and not c.cut]
    own = any(isinstance(c, str) and c.strip() for c in body.items) and best is body
    return [body] if own else marked


def blocks(nodes: list[Node]) -> list[str]:
    """Text of each block: white space is one space, empty blocks go."""
    out, run = [], []

    def end() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    for node in nodes:
        stack: list = [(node, 0)]
        while stack:
            x, i = stack.pop()
            if not i and x.tag in BLOCK:
                end()
            items = x.items
            while i < len(items):
                c = items[i]
                i += 1
                if isinstance(c, str):
                    run.append(c)
                elif c.tag == "br":
                    run.append(" ")
                elif not c.cut:
                    stack.append((x, i))
                    stack.append((c, 0))
                    break
            else:
                if x.tag in BLOCK:
                    end()
        end()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(content(parse(page)))) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text ("" if there is none), n_chars (code points of the text).

    Null and empty pages give an empty text. Markup that isn't closed, bare text without any element and
    pages without a body are read as far as they go; nothing is capped. Repeated rows stay; other
    columns are ignored. One pass without a shuffle.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), url_col: part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select(*(F.col(f"`{c}`") for c in (id_col, url_col, html_col))).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
