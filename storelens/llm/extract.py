"""Main-text extraction by tree scoring.

The page is read into a light tree of block elements.  Every paragraph passes
points for its length and commas to its parent, and half of them to the
grandparent; a container's points are discounted by the share of its text that
is link text.  The best container is kept with those siblings that score well
or read as prose.  Menus, headers, footers, sidebars, notices, adverts, forms
and reader comments are left out by element and by class, id and role.

The page is read in one pass (``markup``), so unclosed, nested and damaged markup
of any length costs time in proportion to its length.  A tag that the page's end
cuts off is markup and not text.

Nulls and empty pages have no text.  A page without a paragraph that scores is
taken whole, without the parts named above.  Of containers with equal points the
first in page order is the best.  Repeated rows are each read.  Further columns
are passed on where ``keep`` names them; the names ``text`` and ``n_chars`` are
the output's, so ``keep`` must not hold them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from storelens.llm.markup import RAW, Page, decoded

_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

DROPPED = frozenset("head title nav footer aside form button select option menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes an open element of these names first.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
CLOSES |= {tag: {"p"} for tag in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
SCOPES = frozenset("article main section div table ul ol dl td th body blockquote".split())

#: Words in a class, id or role that mark boilerplate.
BOILERPLATE = frozenset(
    """ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion
    disqus footer footnav gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pagination pager
    popup promo promoted promotion related replies reply responses respond rss search share sharing shoutbox sidebar sidenav signup skip social sponsor
    sponsored subscribe subscription taboola toolbar topbar widget widgets alert complementary contentinfo""".split()
)


#: Words that make a header part of the text it heads.
CONTENT = frozenset("article post entry content story".split())


class Node:
    __slots__ = ("tag", "parent", "children", "text", "linked", "points", "dropped")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.text = self.linked = 0
        self.points = 0.0


def _is_boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    for m in _NAMES.finditer(attributes):
        found = set(_WORD.findall((m[1] or m[2] or m[3] or "").lower()))
        if found & BOILERPLATE or ("header" in found and not inside and not found & CONTENT) or ("side" in found and "bar" in found):
            return tag not in ("body", "html", "main", "article")
    return False


class _Tree:
    """The tree under construction; counts of open elements make every step constant or paid for by what it closes."""

    def __init__(self) -> None:
        self.root = self.top = Node("body", None, False)
        self.opened: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]  # open elements inside each open scope, the scope itself left out
        self.scope_tags = ["body"]

    @property
    def inside(self) -> bool:
        """Whether an article or main element is open."""
        return self.opened["article"] + self.opened["main"] > 0

    def push(self, tag: str, dropped: bool) -> None:
        child = Node(tag, self.top, self.top.dropped or dropped)
        self.top.children.append(child)
        self.top = child
        self.opened[tag] += 1
        if tag in SCOPES:
            self.scopes.append(Counter())
            self.scope_tags.append(tag)
        else:
            self.scopes[-1][tag] += 1

    def pop(self) -> str:
        tag = self.top.tag
        self.opened[tag] -= 1
        if tag in SCOPES:
            self.scopes.pop()
            self.scope_tags.pop()
        else:
            self.scopes[-1][tag] -= 1
        self.top = self.top.parent
        return tag

    def close(self, tag: str) -> None:
        """Closes the nearest open element of the name and all inside it; without one nothing happens."""
        if self.opened[tag]:
            while self.pop() != tag:
                pass

    def close_implied(self, ends: set[str]) -> None:
        """Closes the nearest of the named elements in the innermost scope, or that scope if it is one."""
        if any(self.scopes[-1][tag] for tag in ends):
            while self.pop() not in ends:
                pass
        elif len(self.scopes) > 1 and self.scope_tags[-1] in ends:
            self.close(self.scope_tags[-1])


def parse(text: str) -> Node:
    """The tree of block elements; its leaves are blocks of text with single spaces."""
    tree, page = _Tree(), Page(text)
    pieces: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if pieces:
            block = " ".join(decoded("".join(pieces)).split())
            pieces.clear()
            top = tree.top
            if block and not top.dropped:
                top.children.append(block)
                top.text += len(block)
                top.linked += min(linked, len(block))
        linked = 0

    at = 0
    for tag in page.tags():
        if tag.begin > at:
            pieces.append(text[at : tag.begin])
            if in_link:
                linked += tag.begin - at
        at = tag.end
        name = tag.name
        if not name or (name in RAW and not tag.closing):
            continue
        if name == "a":
            in_link = not tag.closing
        if name in INLINE:
            if name != "a" and not tag.closing and tag.attributes and _is_boilerplate(name, tag.attributes, tree.inside):
                ends = page.close_of(name, at)
                if ends:
                    at = page.skip_to = ends[1]
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        in_link = False
        if tag.closing:
            tree.close(name)
        elif name not in ("html", "body"):
            if name in CLOSES:
                tree.close_implied(CLOSES[name])
            tree.push(name, _is_boilerplate(name, tag.attributes, tree.inside))
    pieces.append(text[at:])
    flush()
    return tree.root


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        now = todo.pop()
        yield now
        todo.extend(c for c in now.children if isinstance(c, Node) and not c.dropped)


def _score(root: Node) -> None:
    """Points of paragraphs to their containers, then totals of text below each node."""
    order = list(_walk(root))
    for node in order:
        own = [c for c in node.children if isinstance(c, str)]
        holder = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
        for block in own:
            if len(block) >= 25:
                share = 1 - node.linked / max(1, node.text)
                points = (1 + block.count(",") + min(len(block) / 100, 3)) * share
                holder.points += points
                if holder.parent is not None:
                    holder.parent.points += points / 2
    for node in reversed(order):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked


def _value(node: Node) -> float:
    return node.points * (1 - node.linked / max(1, node.text))


def _blocks(node: Node) -> Iterator[str]:
    todo: list[Node | str] = [node]
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            yield now
        elif not now.dropped:
            todo.extend(reversed(now.children))


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by one space."""
    root = parse(page)
    _score(root)
    best = max(_walk(root), key=_value)
    if _value(best) <= 0:
        return " ".join(_blocks(root))
    while best.parent is not None and best.tag in PARAGRAPHS | {"tr", "tbody", "ul", "ol"}:
        best = best.parent
    holders = []
    node: Node | None = best
    while node is not None:
        holders.append(node)
        node = node.parent
    for tag in ("article", "main"):  # the page's own mark of the text around the best container
        marked = next((h for h in holders if h.tag == tag), None)
        if marked is not None:
            best = marked
            break
    if best.parent is None:
        return " ".join(_blocks(best))
    least = max(5.0, _value(best) * 0.2)
    kept: list[str] = []
    for c in best.parent.children:
        if c is best:
            kept.extend(_blocks(best))
        elif isinstance(c, Node) and not c.dropped:
            prose = c.tag in PARAGRAPHS and c.text >= 80 and c.linked < 0.25 * c.text
            heading = c.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and c.linked < 0.5 * max(1, c.text)
            if prose or heading or _value(c) >= least:
                kept.extend(_blocks(c))
    return " ".join(kept)


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns in keep, ``text`` and ``n_chars`` (its code points), from each whole page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py() or "") for value in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*keep, html).mapInArrow(run, schema)
