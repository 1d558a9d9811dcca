"""Main text of web pages by site template removal.

A page is parsed once. Where it marks its main content (articles, else a main element), the text is that content;
where it marks none, all of the page is. What says by tag, class, id or role that it is a menu, notice, advert, form
or reader comment goes. Then the site's template goes: element subtrees are hashed by tags and exact texts, Spark counts
on how many different contents of a host each hash occurs, and subtrees that recur on at least MIN_PAGES of them and
on MIN_SHARE of the host's are deleted. In a marked content only boxes (INSIDE) can be template, such as share bars or
"related" lists whose names tell nothing; its paragraphs, headings and cells stay, however often they recur. Pages of one and the same content count
once, so copies do not make each other template.

Null html counts as empty and gives an empty text. A page without a host (null or odd url) is of its own kind of
host, ''. Repeated rows give repeated results. Other columns of the input are not read. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, pairwise
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, saved, small_join

#: A subtree is template if it stands on at least this many different contents of its host ...
MIN_PAGES = 8
#: ... and on at least this share of them.
MIN_SHARE = 0.5

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_DROP_TAG = {"head", "nav", "menu", "header", "footer", "aside", "form", "button", "select", "option", "fieldset", "dialog", "svg", "canvas", "template", "audio", "video", "map"} | _RAW
_DROP_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
#: Names that tell what an element is, and words that may stand beside them in a compound name.
_TELLING = re.compile(r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|newsletter|subscribe|subscription|signup|popup|modal|overlay|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|respond|disqus|reply|replies|share|sharing|social|related|widget|login|toolbar|skip")
_BESIDE = {"bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "post", "posts", "reader", "right", "section", "site", "slot", "top", "unit", "user", "wrap", "wrapper"}
#: In the main content, elements of these kinds go by a compound name; others only by one that is a telling word itself.
_BOXES = {"div", "section", "ul", "ol", "dl", "table", "details", "figure", "center", "address", "iframe"}
#: In the main content, subtrees of these kinds can be template.
INSIDE = {"div", "section", "ul", "ol", "dl", "figure", "details", "center", "address"}
#: Elements that an inline end tag does not reach beyond.
_WALLS = {"article", "body", "td", "table"}
_PASS_WALLS = {"body", "html", "article", "main", "div", "section", "table"}
#: An open element of the left kind ends where one of the right kind begins.
_ENDS = {"p": _BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_SPACES = re.compile(r"\s+")


def _tells(name: str) -> bool:
    """Whether a class or id says that its element is no content: a telling word, or a compound of telling words and plain ones. "social-history" and "notice-of-intent" say nothing of the kind."""
    if _TELLING.fullmatch(name):
        return True
    parts = [x for x in re.split(r"[-_]+", name) if x]
    told = [bool(_TELLING.fullmatch(x)) for x in parts]
    return any(told) and all(t or x in _BESIDE or x.isdigit() for t, x in zip(told, parts, strict=True))


def _unwanted(tag: str, attributes: str, within: bool) -> bool:
    if tag in _DROP_TAG:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for a, b, c in _NAMED.findall(attributes) if attributes else ():
        for word in (a or b or c).lower().split():
            if word in _DROP_ROLE or (_tells(word) if not within or tag in _BOXES else _TELLING.fullmatch(word)):
                return True
    return False


class Node:
    """An element: what it holds in order (texts and nodes), whether it goes by what it says of itself, and whether a main heading is in it."""

    __slots__ = ("content", "drop", "hash", "heading", "tag", "within")

    def __init__(self, tag: str, drop: bool, within: bool):
        self.tag, self.drop, self.within, self.content, self.hash, self.heading = tag, drop, within, [], 0, False


class _Open:
    """The open elements, with their places by tag, those of blocks and those of walls: no end tag has to walk over them."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks, self.walls = [root], {}, [], []

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        for known, places in ((True, self.places.setdefault(node.tag, [])), (node.tag in _BLOCK, self.blocks), (node.tag in _WALLS, self.walls)):
            if known:
                places.append(k)

    def cut(self, k: int) -> None:
        """Closes all from the k-th on."""
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
            if tag in _WALLS:
                self.walls.pop()

    def close(self, tag: str) -> bool:
        """Closes the last open element of a tag unless a wall stands before it. False: there is none, and no wall."""
        places = self.places.get(tag)
        k, wall = places[-1] if places else 0, self.walls[-1] if self.walls and tag not in _PASS_WALLS else 0
        if k and k >= wall:
            self.cut(k)
        return bool(k or wall)

    def mark_heading(self) -> None:
        for k in reversed(self.places.get("header", ())):
            if self.stack[k].heading:
                break  # and so have those around it
            self.stack[k].heading = True


def parse(html: str) -> Node:
    """A tolerant element tree; texts are decoded one by one. Raw-text elements keep no text; a tag cut off by the end of the page is markup."""
    root = Node("", False, False)
    open_, at, n = _Open(root), 0, len(html)
    stack = open_.stack
    while at < n:
        m = _TAG.search(html, at)
        if not m or m.start() > at:
            tail = html[at : m.start() if m else n]
            if not m:
                tail = re.sub(r"<(?:/|!)?\Z", "", tail)
            stack[-1].content.append(htmllib.unescape(tail) if "&" in tail else tail)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not open_.close(tag) and tag == "p":
                stack[-1].content.append(Node("br", False, stack[-1].within))
            continue
        while len(stack) > 1 and tag in _ENDS.get(stack[-1].tag, ()):
            open_.cut(len(stack) - 1)
        if tag in _BLOCK and tag != "br" and open_.blocks and stack[open_.blocks[-1]].tag == "p":
            open_.cut(open_.blocks[-1])  # inline elements left open do not carry a paragraph past its end
        if tag == "h1":
            open_.mark_heading()
        top = stack[-1]
        within = top.within or top.tag in ("article", "main")
        node = Node(tag, _unwanted(tag, m[3], within), within)
        top.content.append(node)
        if tag in _RAW:
            end = _raw_end(tag).search(html, at)
            at = end.end() if end else n
        elif tag not in _VOID and not (m[3].rstrip().endswith("/") and (node.drop or open_.places.get("svg") or open_.places.get("math"))):
            open_.push(node)  # a slash ends no element of HTML itself; one that goes is not made to swallow what follows
    return root


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)


def gone(node: Node) -> bool:
    """Whether an element goes by what it says of itself. An article's header stays if it has the title."""
    return node.drop and not (node.tag == "header" and node.within and node.heading)


def marked(root: Node) -> list[Node]:
    """The page's own marks of its main content: its articles, else its main element. None stands in an element that goes."""
    articles, mains, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "article":
            articles.append(node)
            continue  # articles in articles are part of them
        if node.tag == "main":
            mains.append(node)
        stack.extend(x for x in reversed(node.content) if isinstance(x, Node) and not (x.drop and x.tag != "header"))
    return articles or mains[:1]


def _flat(tops: list[Node]) -> tuple[list[str], list[tuple[Node, int, int]]]:
    """Texts in page order, blocks edged by blanks, and which of them each element that stays holds (first, one past the last)."""
    texts: list[str] = []
    spans: list[tuple[Node, int, int]] = []
    own, stack = {id(t) for t in tops}, list[Any](reversed(tops))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            texts.append(_SPACES.sub(" ", x))
        elif isinstance(x, tuple):
            spans.append((x[0], x[1], len(texts)))
        elif id(x) not in own and gone(x):
            if x.tag in _BLOCK or x.tag in _DROP_TAG:
                texts.append(" ")
        else:
            if x.tag in _BLOCK:
                texts.append(" ")
                stack.append(" ")
            stack.append((x, len(texts)))
            stack.extend(reversed(x.content))
    return texts, spans


def _hash64(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest(), "little", signed=True)


def _hashed(order: list[Node]) -> None:
    """Sets subtree hashes, from tags, texts with white space folded, and children that stay. ``order`` has children before their parents."""
    for node in order:
        parts = [node.tag.encode()]
        for x in node.content:
            if isinstance(x, Node):
                if not gone(x):
                    parts.append(b"\x01" + x.hash.to_bytes(8, "little", signed=True))
            elif text := " ".join(x.split()):
                parts.append(text.encode("utf-8", "replace"))
        node.hash = _hash64(*parts)


_WHOLE = ("", "html", "body", "head")


def page_parts(html: str | None) -> tuple[int, list[str], list[tuple[int, int, int]]]:
    """(hash of the content, its text in pieces, subtrees that may be template).

    A subtree tells which pieces it holds: (hash, first, one past the last). Where a page marks its content, they are
    the boxes in it (their hashes are kept apart from others') and, holding no piece, what stands beside it.
    """
    root = parse(html or "")
    tops = marked(root)
    texts, spans = _flat(tops or [root])
    _hashed([x for x, _, _ in spans])  # an element's span is noted after those of what it holds
    filled = list(accumulate((t not in ("", " ") for t in texts), initial=0))
    own = {id(t) for t in tops}
    held = [(x, a, b) for x, a, b in spans if filled[b] > filled[a] and (x.tag in INSIDE if tops else x.tag not in _WHOLE) and id(x) not in own]
    marks = [(_hash64(b"inside", x.hash.to_bytes(8, "little", signed=True)) if tops else x.hash, a, b) for x, a, b in held]
    if tops:
        above = {id(root)}
        order = list(_outside(root, own))
        for node in reversed(order):  # children before parents
            if any(isinstance(x, Node) and (id(x) in own or id(x) in above) for x in node.content):
                above.add(id(node))
        beside = [x for x in reversed(order) if id(x) not in above]
        _hashed(beside)
        marks += [(x.hash, -1, -1) for x in beside if x.content and x.tag not in _WHOLE]
    content = _hash64(" ".join("".join(texts).split()).encode("utf-8", "replace"))
    edges = sorted({0, len(texts), *(e for _, a, b in marks if a >= 0 for e in (a, b))})
    place = {e: i for i, e in enumerate(edges)}
    return content, ["".join(texts[a:b]) for a, b in pairwise(edges)], [(h, place.get(a, -1), place.get(b, -1)) for h, a, b in marks]


def kept_text(texts: list[str], marks: list[tuple[int, int, int]], template: frozenset[int] | set[int]) -> str:
    """The pieces that no template subtree holds, white space folded."""
    out, at = [], 0
    for a, b in sorted((a, b) for h, a, b in marks if a >= 0 and h in template):
        out += texts[at:a]
        at = max(at, b)
    return " ".join("".join([*out, *texts[at:]]).split())


def _outside(root: Node, inside: set[int]) -> Iterator[Node]:
    """Elements that stay, not those in the content; parents before their children."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(x for x in node.content if isinstance(x, Node) and id(x) not in inside and not gone(x))


def main_text(html: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of one page, given its site's template: what :func:`extract_pages` gives for it."""
    _, texts, marks = page_parts(html)
    return kept_text(texts, marks, template)


def host_of(url: str = "url") -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)", 1), F.lit("")))


PARTS = "page_id long, url string, host string, content long, texts array<string>, marks array<struct<hash: bigint, first: int, last: int>>"


def parsed(pages: DataFrame) -> DataFrame:
    """Every page's parts, see :func:`page_parts`; the only place where html is read."""
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host_of().alias("host"), F.col("html").cast("string").alias("text"))

    def work(part: pa.Table) -> dict[str, list]:
        found = [page_parts(t) for t in part["text"].to_pylist()]
        own = {n: [x[k] for x in found] for k, n in enumerate(("content", "texts", "marks"))}
        own["marks"] = [[{"hash": h, "first": a, "last": b} for h, a, b in m] for m in own["marks"]]
        return {**{c: part[c].to_pylist() for c in ("page_id", "url", "host")}, **own}

    return map_texts(keyed, PARTS, work)


def host_templates(parts: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, template: the hashes of the subtrees that recur on many different contents of their host.

    Counts are pre-summed before each shuffle, so a host with a third of all pages is no hot spot. A host's list
    has at most 1 / min_share times the subtrees of its mean page.
    """
    hashes = F.array_distinct(F.transform("marks", lambda m: m["hash"]))
    different = parts.groupBy("host", "content").agg(F.min(hashes).alias("hashes"))
    counts = saved(different.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "hashes")).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages))
    totals = counts.filter("hash IS NULL").select("host", F.col("n").alias("of"))
    often = counts.filter("hash IS NOT NULL").join(totals, "host").filter(F.col("n") >= min_share * F.col("of"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template"))


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_template (template subtrees known of its host) for every page."""
    parts = saved(parsed(pages))
    joined = small_join(parts, saved(host_templates(parts, min_pages, min_share)), ["host"], "left")
    template = F.coalesce("template", F.array().cast("array<bigint>"))
    hit = F.arrays_overlap(F.transform("marks", lambda m: m["hash"]), template)
    names = ["page_id", "url", "text", "n_template"]
    plain = joined.filter(~hit).withColumns({"text": F.trim(F.regexp_replace(F.array_join("texts", ""), " +", " ")), "n_template": F.size(template).cast("long")}).select(*names)
    own = joined.filter(hit).select("page_id", "url", F.array_join("texts", "").alias("text"), F.transform("texts", F.char_length).alias("sizes"), "marks", template.alias("template"))

    def work(part: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {"page_id": part["page_id"].to_pylist(), "url": part["url"].to_pylist(), "text": [], "n_template": []}
        known, template = None, frozenset()
        for text, sizes, marks, listed in zip(*[part[c].to_pylist() for c in ("text", "sizes", "marks", "template")], strict=True):
            if listed != known:
                known, template = listed, frozenset(listed)
            ends = list(accumulate(sizes))
            texts = [text[e - n : e] for e, n in zip(ends, sizes, strict=True)]
            out["text"].append(kept_text(texts, [(m["hash"], m["first"], m["last"]) for m in marks], template))
            out["n_template"].append(len(listed))
        return out

    done = plain.unionByName(map_texts(own, "page_id long, url string, text string, n_template long", work))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")
