"""Main text of web pages by composite text density.

A page is parsed into a tree of elements. Each node has a density: its characters per tag, lowered by
how much of it are links, the more so the more of the body's text are. What a page says of itself is
left out first (menus, headers, footers, sidebars, notices, adverts, forms, reader comments). Of what is
left, the node whose children's densities sum up to most is the article, widened to the ``article`` or
``main`` element that it stands in; without one, other parts at least as dense as the least dense node
between the article and the body belong to it too.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Elements by what HTML says of them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEAD = frozenset("head title meta link base style script noscript template bgsound".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element whose start ends the open one of the same set, as far out as the nearest of the second set.
_ENDS = {
    "li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "td": ("td th", "table"), "th": ("td th", "table"), "tr": ("tr", "table"),
    "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
}
_SCOPES = frozenset("html table td th caption button object template".split())

#: Never part of an article, by element, role, and words in class and id. ``header`` only outside an article.
DROPPED_TAGS = frozenset("script style noscript template title head nav aside footer form iframe svg math canvas object embed applet audio video map button select textarea input datalist dialog menu search noembed noframes xmp".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist status".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets header masthead topbar footer footers "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended recommendations comment comments commentlist disqus respond replies discussion skip".split()
)
#: Compound words that mean the same, whatever joins their parts.
_COMPOUND = re.compile(r"(?:^|[ _-])(?:side[_-]?bar|news[_-]?letter|nav[_-]?bar|bread[_-]?crumbs?|sign[_-]?up|user[_-]?comments?|reader[_-]?comments?|also[_-]?read|read[_-]?(?:more|next))(?:$|[ _-])", re.I)
#: On these only words of reader comments count: a page's own frame is often named for its layout.
_FRAMES = frozenset("html body main article".split())
_COMMENT_WORDS = frozenset("comment comments commentlist replies".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Tree:
    """Nodes in the order of their starts: tag, parent, whether dropped, and the text pieces between them."""

    def __init__(self) -> None:
        self.tag, self.parent, self.own_drop, self.marked = ["#page"], [-1], [False], [""]
        self.text: list[tuple[int, str]] = []  # (node, decoded text), in page order; "" where a block starts or ends

    def add(self, tag: str, parent: int, attributes: str) -> int:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        self.tag.append(tag)
        self.parent.append(parent)
        self.own_drop.append(_dropped(tag, found) if found else tag in DROPPED_TAGS)
        self.marked.append("main" if found.get("role", "").lower() == "main" or "articlebody" in found.get("itemprop", "").lower() else "")
        return len(self.tag) - 1


def _dropped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROPPED_TAGS or attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    if "hidden" in attributes and attributes["hidden"].lower() != "until-found" or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if not names.strip() or tag in _HEADINGS:
        return False
    words = {w.lower() for w in _WORD.findall(names)}
    if tag in _FRAMES:
        return bool(words & _COMMENT_WORDS) and not words & {"no", "has", "with", "without"}
    if words & {"no", "has", "with", "without", "content", "article", "body", "entry", "post"} and not words & _COMMENT_WORDS:
        # a frame that is named for what it holds as well
        return bool(words & {"ad", "ads", "advert", "advertisement", "sidebar", "footer", "related", "share", "sharing", "social", "nav"}) and not words & {"no", "has", "with", "without", "body"}
    return bool(words & DROPPED_WORDS) or bool(_COMPOUND.search(names))


def _parse(page: str) -> _Tree:
    """The tree of a page, however it is cut or nested: elements that HTML ends by itself are ended, ends of what isn't open are passed over."""
    tree = _Tree()
    stack, open_ = [0], {"#page": [0]}  # nodes that are open; of each tag the depths at which it is
    at, size = 0, len(page)
    raw_ends: dict[str, re.Pattern] = {}

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            tag = tree.tag[node]
            open_[tag].pop()
            if tag in _BLOCK:
                tree.text.append((tree.parent[node], ""))

    def deepest(tags: str) -> int:
        return max((open_[t][-1] for t in tags.split() if open_.get(t)), default=-1)

    def say(piece: str) -> None:
        if open_.get("head") and not piece.isspace():
            close(open_["head"][-1])
        tree.text.append((stack[-1], entities.unescape(piece) if "&" in piece else piece))

    blocks_open = [0]  # depths of the blocks that are open, to hold inline ends within them
    while at < size:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        follows = page[start + 1 : start + 2]
        if not (follows.isalpha() and follows.isascii() or follows in ("/", "!", "?")) or follows == "/" and not (page[start + 2 : start + 3].isalpha() or page[start + 2 : start + 3] in ("", ">")):
            if follows == "/" and page[start + 2 : start + 3]:  # a comment by mistake
                if start > at:
                    say(page[at:start])
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
                continue
            end = start + 1
            say(page[at:end])
            at = end
            continue
        if start > at:
            say(page[at:start])
        if follows in ("!", "?"):
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4) if not page.startswith(("<!-->", "<!--->"), start) else page.find(">", start) - 2
                at = end + 3 if end >= 0 else size
            elif page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
            continue
        m = _TAG.match(page, start)
        if m is None:  # cut off within a tag
            end = page.find(">", start)
            if end < 0:
                break
            at = end + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            depths = open_.get(tag)
            if not depths or tag in ("body", "html"):
                continue
            depth = depths[-1]
            while blocks_open and blocks_open[-1] >= len(stack):
                blocks_open.pop()
            if tag not in _BLOCK and blocks_open and blocks_open[-1] > depth:
                continue  # it was opened outside the block
            if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption") and deepest("table td th caption") > depth:
                continue
            close(depth)
            continue
        if open_.get("head") and tag not in _HEAD:
            close(open_["head"][-1])
        if tag in ("html", "body") and open_.get(tag):
            continue
        if tag in _ENDS:
            own, outer = _ENDS[tag]
            inner = deepest(own)
            if inner > deepest(outer):
                close(inner)
        elif tag in _BLOCK and tag != "br" and open_.get("p") and open_["p"][-1] > deepest("table td th caption button object template"):
            close(open_["p"][-1])
            if tag in _HEADINGS and tree.tag[stack[-1]] in _HEADINGS:
                close(len(stack) - 1)
        if tag in _BLOCK:
            tree.text.append((stack[-1], ""))
        node = tree.add(tag, stack[-1], m[3])
        if tag in _VOID:
            continue
        if tag in _RAW:
            if tag not in raw_ends:
                raw_ends[tag] = re.compile(rf"</{tag}(?=[\s/>])", re.I)
            end = raw_ends[tag].search(page, at)
            if end is None:
                break
            close_at = page.find(">", end.end())
            at = close_at + 1 if close_at >= 0 else size
            continue
        while blocks_open and blocks_open[-1] >= len(stack):
            blocks_open.pop()
        if tag in _BLOCK:
            blocks_open.append(len(stack))
        open_.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return tree


def _densities(tree: _Tree) -> tuple[list[float], list[float], list[bool]]:
    """Of each node: its composite density, the sum over its children that aren't dropped, and whether it is dropped."""
    n = len(tree.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked, inside, dropped = [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        up = tree.parent[k]
        linked[k] = linked[up] or tree.tag[k] == "a"
        inside[k] = inside[up] or tree.tag[k] == "article"
        dropped[k] = dropped[up] or tree.own_drop[k] or tree.tag[k] == "header" and not inside[up]
    for node, piece in tree.text:
        if piece:
            own = len("".join(piece.split()))
            chars[node] += own
            if linked[node]:
                links[node] += own
    for k in range(n - 1, 0, -1):
        up = tree.parent[k]
        chars[up] += chars[k]
        links[up] += links[k]
        tags[up] += tags[k] + 1
        link_tags[up] += link_tags[k] + (tree.tag[k] == "a")
    body = next((k for k in range(n) if tree.tag[k] == "body"), 0)
    share = links[body] / chars[body] if chars[body] else 0.0
    density, sums = [0.0] * n, [0.0] * n
    for k in range(n):
        if chars[k]:
            c, t, lc, lt = chars[k], max(1, tags[k]), links[k], link_tags[k]
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[k] = c / t * math.log(c / max(1, lc) * t / max(1, lt)) / math.log(base) if base > 1 + 1e-9 else c / t * math.log(c / max(1, lc) * t / max(1, lt))
            density[k] = max(0.0, density[k])
    for k in range(1, n):
        if not dropped[k]:
            sums[tree.parent[k]] += density[k]
    return density, sums, dropped


def _chosen(tree: _Tree) -> list[bool]:
    """For each node whether its text belongs to the article."""
    density, sums, dropped = _densities(tree)
    n = len(tree.tag)
    declared = [False] * n  # within an article or main
    for k in range(1, n):
        declared[k] = not dropped[k] and (declared[tree.parent[k]] or tree.tag[k] in ("article", "main") or bool(tree.marked[k]))
    text = [False] * n
    for node, piece in tree.text:
        text[node] = text[node] or bool(piece and not piece.isspace() and not dropped[node])
    for k in range(n - 1, 0, -1):
        text[tree.parent[k]] = text[tree.parent[k]] or text[k]
    some = [k for k in range(n) if declared[k] and text[k]] or [k for k in range(n) if not dropped[k] and text[k]]
    keep = [False] * n
    if not some:
        return keep
    best = max(some, key=lambda k: (sums[k], -k))
    path = [best]
    while tree.parent[path[-1]] >= 0:
        path.append(tree.parent[path[-1]])
    articles = [k for k in path if tree.tag[k] == "article"]
    mains = [k for k in path if tree.tag[k] == "main" or tree.marked[k]]
    root = articles[-1] if articles else mains[-1] if mains else best
    if any(tree.tag[k] in ("body", "html", "#page") for k in path[: path.index(root)]):
        root = best
    above = path[path.index(root) :]
    on_path = set(above)
    roots = {root}
    least = min((density[k] for k in path if tree.tag[k] not in ("html", "#page")), default=0.0)
    titled = any(tree.tag[k] == "h1" and not dropped[k] and _within(tree, k, root) for k in range(root, n))
    if not titled:  # a title that stands before the article, in a part of the page that they share
        def shared(node: int) -> int:
            while node not in on_path:
                node = tree.parent[node]
            return node

        heads = [k for k in range(1, root) if tree.tag[k] == "h1" and text[k] and not dropped[k]]
        heads = [k for k in heads if tree.parent[k] in on_path or tree.tag[shared(k)] not in ("body", "html", "#page")]
        roots |= set(heads[-1:])
    if not declared[root]:
        blocks = _BLOCK - {"br", "hr", "body", "html"}
        for k in range(1, n):
            if tree.parent[k] in on_path and k not in on_path and not dropped[k] and text[k] and tree.tag[k] in blocks and density[k] >= least > 0 and (sums[k] > 0 or tree.tag[k] == "p"):
                roots.add(k)
    for k in range(n):
        keep[k] = not dropped[k] and (k in roots or k > 0 and keep[tree.parent[k]])
    return keep


def _within(tree: _Tree, node: int, root: int) -> bool:
    while node > root:
        node = tree.parent[node]
    return node == root


def main_text(page: str | None) -> str:
    """The article's text: character references decoded, white space (as Unicode has it) one space, blocks joined by one."""
    tree = _parse(page or "")
    keep = _chosen(tree)
    return " ".join("".join(" " if not piece else piece if keep[node] else "" for node, piece in tree.text).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row: the page's main text and its number of code points.

    Null, empty and text-free pages have an empty text. Each row is judged by its own page, however long, so equal pages
    have equal texts and rows come back as often as they came; null ids and urls stay null. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 512):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    rows = pages.select(id_col, url_col, html_col)
    kind = rows.schema[id_col].dataType.simpleString()
    names = [id_col, url_col, "text", "n_chars"]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long").select(F.col(id_col), F.col(url_col), "text", "n_chars")
