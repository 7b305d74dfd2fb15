"""Operator 7: main text of HTML pages by composite text density (Sun, Song and Liao, 2011)."""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean

# Fixed values of HTML: elements without content, of raw text, that stand in a line, and that end an open paragraph.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
_SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
# Elements that are never main text, and words of class, id or role that say so.
_DROP = set("head script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas audio video dialog menu".split())
_DROP_WORDS = set(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation footer header masthead breadcrumb breadcrumbs
    cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist respond replies disqus share sharing social related recommended newsletter subscribe signup login
    widget pagination pager toolbar contentinfo complementary search""".split()
)
# Of these, words of what readers, advertisers or the site's forms say; words that turn a name's meaning; and words of an article's own header.
_OTHERS = set("comment comments commentlist respond replies disqus ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe signup login".split())
_TURNED = set("no not non with without has have hide hidden show open is".split())
_OWN = set("post entry article story content news blog".split())
_WHOLE = {"article", "main"}
#: An element whose name has such a word stays if it has this part of the page's text that isn't links: of a name that is the word, or of another.
PART, PART_WITHIN = 0.5, 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element, with what its subtree holds: characters, tags, link characters, link tags."""

    __slots__ = ("tag", "parent", "children", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "drop", "name", "whole")

    def __init__(self, tag: str, parent: Node | None, drop: bool):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.name = ""
        #: The outermost article or main element that it is or lies in.
        self.whole: Node | None = (parent.whole if parent else None) or (self if tag in _WHOLE else None)


def _unwanted(tag: str, attributes: str, parent: Node) -> bool:
    if tag in _DROP:
        return True
    if tag == "header":
        return parent.whole is None
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _name(tag: str, attributes: str) -> str:
    """What class, id and role say: "others" or "side" if one is such a word or ends in it, "part" if one has it elsewhere; else nothing."""
    found = ""
    if attributes and tag not in ("html", "body", "article", "main"):
        for m in _ATTRIBUTE.finditer(attributes):
            if (m[1] or m[5]).lower() in ("class", "id", "role"):
                for name in (m[2] or m[3] or m[4] or "").lower().split():
                    parts = _WORD.findall(name)
                    if _DROP_WORDS.isdisjoint(parts) or parts[-1] == "header" and not _OWN.isdisjoint(parts):
                        continue
                    if parts[-1] in _OTHERS and _TURNED.isdisjoint(parts):
                        return "others"
                    found = "side" if parts[-1] in _DROP_WORDS and _TURNED.isdisjoint(parts) else found or "part"
    return found


#: Rules of ends that may be left out: an element of the first set ends, if it is open within the nearest one of the second.
_RULES = {"p": ({"p"}, {"article", "section", "div", "main", "td", "li", "blockquote", "body"})} | _SAME


class _Open:
    """The open elements, from the root to the place at hand, and counts by which an end that has no start costs nothing.

    Each rule, and the rule that an inline end tag stays within inline elements, has a count for each open scope. What
    is walked over is closed, so all walks together are no longer than the page.
    """

    def __init__(self, root: Node):
        self.at = root
        self.blocks: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]
        self.rules = {k: [0] for k in _RULES}

    def push(self, node: Node) -> None:
        tag = node.tag
        if tag in _INLINE:
            own = self.inline[-1]
            own[tag] = own.get(tag, 0) + 1
        else:
            self.blocks[tag] = self.blocks.get(tag, 0) + 1
            self.inline.append({})
        for k in _OPENS.get(tag, ()):
            self.rules[k].append(0)
        for k in _COUNTS.get(tag, ()):
            self.rules[k][-1] += 1
        self.at = node

    def pop(self) -> str:
        tag = self.at.tag
        for k in _COUNTS.get(tag, ()):
            self.rules[k][-1] -= 1
        for k in _OPENS.get(tag, ()):
            self.rules[k].pop()
        if tag in _INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.blocks[tag] -= 1
            self.inline.pop()
        self.at = self.at.parent
        return tag

    def end(self, tag: str) -> None:
        """Close the nearest element of this name; an inline one only if no other element stands between."""
        if (self.inline[-1] if tag in _INLINE else self.blocks).get(tag):
            while self.pop() != tag:
                pass

    def leave_out(self, rule: str) -> None:
        if self.rules[rule][-1]:
            while self.pop() not in _RULES[rule][0]:
                pass


_OPENS = {t: [k for k, (_, scope) in _RULES.items() if t in scope] for _, s in _RULES.values() for t in s}
_COUNTS = {t: [k for k, (tags, _) in _RULES.items() if t in tags] for s, _ in _RULES.values() for t in s}


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of a page, with the ends that HTML lets authors leave out, and the elements in it that have a name. Dropped elements hold no text."""
    root, named = Node("html", None, False), []
    open_ = _Open(root)
    for kind, a, b, c in _iterate(page):
        if kind == "text":
            if not open_.at.drop:
                open_.at.parts.append(a)
        elif kind == "start":
            if a in ("html", "body"):
                continue
            if a in _ENDS_P:
                open_.leave_out("p")
            if a in _SAME:
                open_.leave_out(a)
            at = open_.at
            node = Node(a, at, at.drop or _unwanted(a, b, at))
            node.name = "" if node.drop else _name(a, b)
            if node.name:
                named.append(node)
            at.children.append(node)
            at.parts.append(node)
            if a not in _VOID and not c:
                open_.push(node)
        else:
            open_.end(a)
    return root, named


def _iterate(page: str) -> Iterator[tuple[str, str, str, bool]]:
    pos, n, last = 0, len(page), page.rfind(">")
    lowered = None
    while pos < n:
        m = _TOKEN.search(page, pos) if pos <= last or page.find("<!--", pos) >= 0 else None  # no tag begins after the last end of one
        if m is None:
            yield "text", page[pos:], "", False
            return
        if m.start() > pos:
            yield "text", page[pos : m.start()], "", False
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, attributes = tag.lower(), (m[3] if m[2] else m[6]) or ""
        if m[1] or m[4]:
            yield "end", tag, "", False
            continue
        yield "start", tag, attributes, attributes.endswith("/") and tag not in _RAW
        if tag in _RAW:
            lowered = lowered or page.lower()
            end = lowered.find(f"</{tag}", pos) if len(lowered) == n else page.find(f"</{tag}", pos)
            if end < 0:
                end = n
            if tag == "textarea" or tag == "title":
                yield "text", page[pos:end], "", False
            pos = end


def measure(root: Node) -> list[Node]:
    """Fill in the densities of every node; returns the nodes, parents first."""
    nodes, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.drop:
            continue
        nodes.append(x)
        stack.extend(reversed(x.children))
    for x in reversed(nodes):
        x.chars = sum(len(p) - p.count(" ") for p in x.parts if isinstance(p, str) and not p.isspace())
        x.link_chars = x.link_tags = 0
        x.tags = 1
        for c in x.children:
            if not c.drop:
                x.chars += c.chars
                x.tags += c.tags
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
    body_chars, body_links = max(root.chars, 1), root.link_chars
    for x in nodes:
        if x.chars:
            plain, links = max(x.chars - x.link_chars, 1), max(x.link_chars, 1)
            base = math.log(x.chars / plain * x.link_chars + body_links / body_chars * x.chars + math.e)
            x.density = x.chars / x.tags * math.log(x.chars / links * x.tags / max(x.link_tags, 1) + 1e-9) / math.log(base + 1e-9) if base > 1 + 1e-9 else x.chars / x.tags * math.log(max(x.chars / links * x.tags / max(x.link_tags, 1), 1.0) + 1)
    for x in nodes:
        x.total = sum(c.density for c in x.children if not c.drop)
    return nodes


def _core(nodes: list[Node]) -> Node | None:
    """The node of the largest sum of its children's densities, among those with text and a child that isn't inline."""
    return max((x for x in nodes if x.chars and any(c.tag not in _INLINE and not c.drop for c in x.children)), key=lambda x: x.total, default=None)


def drop_named(root: Node, named: list[Node]) -> None:
    """Drop the elements whose name says that they aren't main text, unless what they hold says that they are.

    One around an article or main element stays. What others say (_OTHERS) goes otherwise, unless an h1 is in it. Others stay if
    they are no more than half links and lie around the densest node or have a large part of the page's text.
    """
    if not named:
        return
    nodes = measure(root)
    around: set[int] = set()
    holds: set[int] = set()
    up = _core(nodes)
    while up is not None:
        around.add(id(up))
        up = up.parent
    heads: set[int] = set()
    for x in nodes:
        if x.tag in _WHOLE or x.tag == "h1":
            up, of = x.parent, holds if x.tag in _WHOLE else heads
            while up is not None and id(up) not in of:
                of.add(id(up))
                up = up.parent
    page = max(root.chars - root.link_chars, 1)
    for x in named:
        part = (x.chars - x.link_chars) / page
        if id(x) in holds or x.name == "others" and id(x) in heads:
            continue
        text = 2 * x.link_chars <= x.chars and (id(x) in around or part >= (PART_WITHIN if x.name == "part" else PART))
        x.drop = x.name == "others" or not text


def select(root: Node) -> list[Node]:
    """The nodes whose subtrees are the main text, in page order.

    The node of the largest sum of its children's densities, among those with a child that isn't inline, is the core. The
    least density on the way from the body to it is the threshold: every part of the page that reaches it gives the
    node of the largest sum within it. An article or main element around such a node is taken whole.
    """
    nodes = [x for x in measure(root) if x.chars]
    core = _core(nodes)
    if core is None:
        return [root] if root.chars else []
    path, up = [core], core.parent
    while up is not None:
        path.append(up)
        up = up.parent
    threshold = min(x.density for x in path)
    if core.whole is not None:
        return [core.whole]
    # What lies beside the way to the core is in no other such part.
    on_path = {id(x) for x in path}
    order = {id(x): i for i, x in enumerate(nodes)}
    beside = [c for x in path[1:] for c in x.children if not c.drop and c.chars and id(c) not in on_path and c.tag not in _INLINE]
    return sorted([core, *(c for c in beside if c.density >= threshold)], key=lambda x: order[id(x)])


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks: references decoded, white space one space, trimmed, empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node, int]] = [(node, 0)]
    flush()
    while stack:
        x, k = stack.pop()
        if k == 0 and x.tag not in _INLINE:
            flush()
        while k < len(x.parts):
            p = x.parts[k]
            k += 1
            if isinstance(p, str):
                line.append(p)
            elif not p.drop:
                if p.tag == "br":
                    line.append(" ")
                stack.append((x, k))
                stack.append((p, 0))
                break
        else:
            if x.tag not in _INLINE:
                flush()
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    root, named = parse(page)
    drop_named(root, named)
    return "\n".join(b for node in select(root) for b in blocks(node))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``, over the whole html.

    Null and empty html, and pages without text, give an empty text. Null or repeated ids and urls are kept as they are. Extra
    columns are ignored. An empty table gives an empty one. One page is in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                c = b.slice(lo, 512)
                texts = [main_text(v.as_py()) for v in c.column(2)]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return lean(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
