"""HTML as Markdown: one pass of the standard parser into a tree, one rendering of it."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
REMOVED = {"script", "style", "noscript"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Open elements that a new one closes: the same kind of item, or a paragraph before a block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "table", "dl", "select", "body", "html", "div", "article", "section"}
ESCAPES = re.compile(r"([\\`*_\[\]])")
LEADS = re.compile(r"^(\s*)([-+>#]|=+|~~~)(?=\s|=|~|$)|^(\s*\d+)\.(?=\s)")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: "Node | None" = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        """Every element below, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node))

    def find(self, **wanted):
        """Elements by tag, id or css class."""
        for node in self.walk():
            classes = (node.attrs.get("class") or "").split()
            if wanted.get("tag", node.tag) == node.tag and wanted.get("id", node.attrs.get("id")) == node.attrs.get("id") and ("css" not in wanted or wanted["css"] in classes):
                yield node

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [x for x in self.parent.children if x is not self]


class _Builder(HTMLParser):
    #: Elements below this depth are kept as children of the last one, so that hostile nesting can't exhaust the stack.
    DEEPEST = 200

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        node = self.at
        while node.parent and shut:
            if node.tag in shut:
                self.at = node.parent
                if tag not in ("tr", "p") or node.tag == tag:
                    break
            if node.tag in SCOPES:
                break
            node = node.parent
        made = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(made)
        if tag not in VOID:
            depth, up = 0, made
            while up.parent and depth <= self.DEEPEST:
                depth, up = depth + 1, up.parent
            if depth <= self.DEEPEST:
                self.at = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def title_of(root: Node) -> str | None:
    """The first title, trimmed; None where there is none or an empty one."""
    return next((t for n in root.find(tag="title") if (t := n.text().strip())), None)


def escape(text: str) -> str:
    """Markdown's marks in text, and what would begin a heading, list or quote at a line's start."""
    return ESCAPES.sub(r"\\\1", text)


def _inline(node: Node, pre: bool = False) -> str:
    out = []
    for x in node.children:
        if isinstance(x, str):
            out.append(x if pre else escape(re.sub(r"[ \t\r\n\f]+", " ", x)))
        elif x.tag not in REMOVED:
            out.append(_element(x))
    return "".join(out)


def _marked(node: Node, mark: str) -> str:
    inner = _inline(node)
    core = inner.strip()
    if not core:
        return inner
    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def _link(node: Node) -> str:
    href, title = node.attrs.get("href"), node.attrs.get("title")
    inner = _inline(node)
    if not href:
        return inner
    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :] if inner.strip() else ""
    said = f' "{title}"' if title else ""
    return f"{lead}[{inner.strip()}]({href}{said}){tail}"


def _image(node: Node) -> str:
    src = node.attrs.get("src", "")
    if src.startswith("data:"):
        return "[image]"
    title = node.attrs.get("title")
    return f"![{' '.join(node.attrs.get('alt', '').split())}]({src}{f' {chr(34)}{title}{chr(34)}' if title else ''})" if src else ""


def _code(node: Node) -> str:
    text = re.sub(r"\r?\n|\r", " ", node.text())
    if not text:
        return ""
    runs = [len(m) for m in re.findall("`+", text)]
    fence = "`" * next(n for n in range(1, len(runs) + 2) if n not in runs)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def _fenced(node: Node) -> str:
    code = next(node.find(tag="code"), None)
    language = re.search(r"language-(\S+)", code.attrs.get("class", "")) if code else None
    text = node.text()
    text = text[:-1] if text.endswith("\n") else text
    fence = "`" * max(3, *(len(m) + 1 for m in re.findall("^`{3,}", text, re.M)), 3)
    return f"\n\n{fence}{language[1] if language else ''}\n{text}\n{fence}\n\n"


def _list(node: Node) -> str:
    start = int(node.attrs["start"]) if node.tag == "ol" and re.fullmatch(r"-?\d+", node.attrs.get("start", "")) else 1
    items = [x for x in node.children if isinstance(x, Node) and x.tag == "li"]
    lines = []
    for i, item in enumerate(items):
        mark = f"{start + i}.  " if node.tag == "ol" else "*   "
        body = _blocks(item).strip("\n")
        lines.append(mark + re.sub(r"\n(?=[^\n])", "\n    ", body))
    joined = "\n".join(lines)
    return f"\n{joined}" if node.parent is not None and node.parent.tag == "li" else f"\n\n{joined}\n\n"


def _table(node: Node) -> str:
    rows = [[re.sub(r"\s+", " ", _inline(c)).strip().replace("|", "\\|") for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")] for row in node.find(tag="tr")]
    rows = [r for r in rows if r]
    if not rows:
        return _blocks(node)
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
    return "\n\n" + "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]) + "\n\n"


def _element(node: Node) -> str:
    tag = node.tag
    if tag in REMOVED:
        return ""
    if re.fullmatch("h[1-6]", tag):
        body = re.sub(r"\s+", " ", _inline(node)).strip()
        return f"\n\n{'#' * int(tag[1])} {body}\n\n" if body else ""
    if tag in ("em", "i"):
        return _marked(node, "_")
    if tag in ("strong", "b"):
        return _marked(node, "**")
    if tag == "a":
        return _link(node)
    if tag == "img":
        return _image(node)
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag == "pre":
        return _fenced(node)
    if tag in ("code", "kbd", "samp", "tt"):
        return _code(node)
    if tag in ("ul", "ol"):
        return _list(node)
    if tag == "table":
        return _table(node)
    if tag == "blockquote":
        body = _blocks(node).strip("\n")
        return "\n\n" + re.sub("(?m)^", "> ", body) + "\n\n" if body else ""
    return f"\n\n{_blocks(node)}\n\n" if tag in BLOCK else _inline(node)


def _blocks(node: Node) -> str:
    """A block's children; text that leads a line doesn't begin a list or heading by chance."""
    text = _inline(node)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n)(?<!  )|(?<=\n) +(?=\n)", "", text)).strip(" \t") if text else ""


def render(node: Node) -> str:
    """An element's children as Markdown."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^ +(?=\S)(?<!    )", "", _blocks(node))).strip()


def html_to_markdown(html: str) -> str:
    """The body of a page, or a fragment, as Markdown."""
    root = parse(html)
    return render(next(root.find(tag="body"), root))
