"""HTML on the standard library's tokenizer: a small tree with implied end tags, and its text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from .plain import decoded
from .registry import Extraction, register

# Fixed values of the HTML standard: elements without content, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
HEAD = frozenset("base link meta title style script noscript template".split())
DROPPED = frozenset({"script", "style", "noscript"})
BLOCKS = frozenset("p div span section article header footer main dl dt dd pre".split())


class Node:
    """An element; ``children`` holds nodes, texts (str) and comments (Comment)."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []

    def walk(self) -> Iterator[Node]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack.extend(reversed(x.children))

    def texts(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack.extend(reversed(x.children))
            elif not isinstance(x, Comment):
                yield x

    def text(self, separator: str = "") -> str:
        return separator.join(x for x in (s.strip() for s in self.texts()) if x)

    def find(self, name: str) -> Node | None:
        return next((x for x in self.walk() if x.name == name), None)


class Comment(str):
    __slots__ = ()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.open = [self.root]

    def _close(self, names: frozenset | set, scope: frozenset | set) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                del self.open[i:]
                return self._close(names, scope)
            if self.open[i].name in scope:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"td", "th", "table", "body", "button"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPE[tag])
        if tag in ("html", "body") and any(x.name == tag for x in self.open):
            return
        if tag == "body":
            self._close({"head"}, {"html"})
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def handle_comment(self, data):
        self.open[-1].children.append(Comment(data))


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def without(node: Node, names: frozenset) -> Node:
    stack = [node]
    while stack:
        x = stack.pop()
        x.children = [c for c in x.children if not (isinstance(c, Node) and c.name in names)]
        stack.extend(c for c in x.children if isinstance(c, Node))
    return node


def body_of(root: Node) -> Node:
    """The body; of a document without one, all that stands outside the head."""
    body = root.find("body")
    if body is not None:
        return body
    top = root.find("html") or root
    out = Node("body")
    out.children = [c for c in top.children if not (isinstance(c, Node) and (c.name == "head" or c.name in HEAD))]
    return out


def _image(node: Node) -> str:
    alt = node.attrs.get("alt", "").strip()
    return f"[image: {alt}]" if alt else "[image sans description]"


def _table(node: Node) -> str:
    lines = []
    for row in (x for x in node.walk() if x.name == "tr"):
        cells = [c.text() for c in row.walk() if c.name in ("td", "th")]
        lines.append(f"| {' | '.join(cells)} |")
        if len(lines) == 1:
            lines.append(f"| {' | '.join(['---'] * len(cells))} |")
    return "\n".join(lines)


def _list(node: Node) -> str:
    items = [c.text() for c in node.children if isinstance(c, Node) and c.name == "li"]
    return "\n".join(f"{i}. {x}" if node.name == "ol" else f"- {x}" for i, x in enumerate(items, 1))


def blocks(body: Node, keep_comments: bool = True) -> tuple[list[str], int]:
    """The text of the body's direct children, block by block, and the number of images."""
    parts: list[str] = []
    images = 0
    for c in body.children:
        if not isinstance(c, Node):
            found = "" if isinstance(c, Comment) and not keep_comments else c.strip()
        elif len(c.name) == 2 and c.name[0] == "h" and c.name[1].isdigit():
            words = c.text()
            found = f"{'#' * int(c.name[1])} {words}" if words else ""
        elif c.name == "img":
            images += 1
            found = _image(c)
        elif c.name == "table":
            found = _table(c)
        elif c.name in ("ul", "ol"):
            found = _list(c)
        elif c.name in BLOCKS:
            inner = [_image(x) for x in c.walk() if x.name == "img"]
            images += len(inner)
            parts += inner
            found = c.text(" ")
        else:
            found = c.text()
        if found:
            parts.append(str(found))
    return parts, images


def plain_text(html: str, dropped: frozenset = DROPPED) -> str:
    """All text, a line for each piece."""
    return without(parse(html), dropped).text("\n")


@register(".html", ".htm")
def read_html(raw: bytes, extension: str) -> Extraction:
    html, encoding = decoded(raw)
    parts, images = blocks(body_of(without(parse(html), DROPPED)))
    return Extraction(text="\n\n".join(parts), encoding=encoding, image_count=images)
