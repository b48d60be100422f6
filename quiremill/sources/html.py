"""HTML to a document tree."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from quiremill.functions import text as T
from quiremill.operators.render import WEB, markdown_renderer, settled
from quiremill.operators.tree import Node, text_node

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(("svg", "nav", "header", "footer", "summary"))
#: Elements that an element of the same kind closes.
CLOSED_BY_OWN = {"p": "p", "li": "li", "tr": "tr", "td": "td|th", "th": "td|th", "dt": "dt|dd", "dd": "dt|dd", "option": "option"}
WRAPPERS = {"strong": "strong", "b": "strong", "em": "emphasis", "i": "emphasis", "del": "strikethrough", "s": "strikethrough", "sub": "subscript", "sup": "superscript"}
_LANGUAGE = re.compile(r"language-(\w+)")


class Element:
    """An element with attributes and children; a text is a string among the children."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def all(self, *tags: str) -> list[Element]:
        found = []
        for c in self.children:
            if isinstance(c, Element):
                if c.tag in tags:
                    found.append(c)
                found += c.all(*tags)
        return found

    def own(self, *tags: str) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element) and c.tag in tags]


class _Builder(HTMLParser):
    """Elements from tags: an end tag closes up to its match or is passed over; a new paragraph ends one that is innermost."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        again = CLOSED_BY_OWN.get(tag)
        if again and self.open[-1].tag in again.split("|"):
            self.open.pop()
        made = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(made)
        if tag not in VOID:
            self.open.append(made)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def dom(markup: str) -> Element:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


class Walker:
    """Elements to nodes. ``book`` is the reading of e-book pages: page furniture, drawings and empty paragraphs stay."""

    def __init__(self, book: bool = False, compat: bool = False):
        self.book, self.compat, self.notes = book, compat, 0
        self.markdown = markdown_renderer(WEB)

    def children(self, e: Element) -> list[Node]:
        return [n for c in e.children for n in self.nodes(c)]

    def nodes(self, e: Element | str) -> list[Node]:
        if isinstance(e, str):
            return [text_node(e)] if e.strip() else []
        tag, attrs = e.tag, e.attrs
        if tag in DROPPED and not (self.book and tag != "summary"):
            return []
        if tag in ("script", "style", "template") and not self.compat:
            return []
        if re.fullmatch("h[1-6]", tag):
            return [Node("heading", self.children(e), level=int(tag[1]), id=attrs.get("id") or None)]
        if tag in WRAPPERS:
            return [Node(WRAPPERS[tag], self.children(e))]
        handler = getattr(self, f"_{tag}", None)
        return handler(e) if handler else self.children(e)

    def _p(self, e):
        inner = self.children(e)
        return [Node("paragraph", inner)] if inner or self.book else []

    def _br(self, e):
        return [text_node("\n")]

    def _hr(self, e):
        return [Node("thematic-break")]

    def _blockquote(self, e):
        return [Node("blockquote", self.children(e))]

    def _li(self, e):
        return [Node("list-item", self.children(e))]

    def _ul(self, e):
        items = [Node("list-item", self.children(x)) for x in e.own("li")]
        start = e.attrs.get("start", "")
        first = int(start) if re.fullmatch(r"-?\d+", start) else 1 if self.book and e.tag == "ol" else None
        return [Node("list", items, ordered="true" if e.tag == "ol" else "false", start=first)]

    _ol = _ul

    def _a(self, e):
        return [Node("link", self.children(e), href=e.attrs.get("href", ""), title=e.attrs.get("title"))]

    def _img(self, e):
        a = e.attrs
        src = a.get("src", "")
        width, height = (int(m[0]) if (m := re.match(r"\d+", a.get(k, "").strip())) else None for k in ("width", "height"))
        inline = src.partition("base64,")[2] if src.startswith("data:") and "base64," in src else None
        if not self.book and (re.search(T.DECORATIVE, src) or width == height == 1 or inline is not None and len(inline) < 100):
            return []
        return [Node("image", src=src, alt=a.get("alt"), title=a.get("title"), width=width, height=height)]

    def _pre(self, e):
        code = next(iter(e.all("code")), None)
        found = _LANGUAGE.search((code or e).attrs.get("class", ""))
        return [Node("code", value=(code or e).text(), language=found[1] if found else None)]

    def _code(self, e):
        return [Node("inline-code", value=e.text())]

    def _u(self, e):
        inner = "".join(map(self.markdown, self.children(e)))
        return [Node("html", value=f"<u>{inner}</u>")]

    def _mark(self, e):
        inner = "".join(map(self.markdown, self.children(e)))
        return [Node("html", value=f"=={inner}==")] if inner.strip() else [text_node("")]

    def _details(self, e):
        summary = next(iter(e.all("summary")), None)
        body = settled("\n\n".join(map(self.markdown, self.children(e))))
        return [Node("html", value=f"<details><summary>{summary.text().strip() if summary else 'Details'}</summary>\n\n{body}\n\n</details>")]

    def _media(self, e, what):
        src = e.attrs.get("src") or next((s.attrs.get("src", "") for s in e.all("source")), "")
        label = f"[{what}: {src}]"
        return [Node("link", [text_node(label)], href=src, title=e.attrs.get("title") or label)]

    def _video(self, e):
        poster = e.attrs.get("poster")
        return [Node("image", src=poster, alt=f"[Video: {poster}]", title=e.attrs.get("title"))] if poster else self._media(e, "Video")

    def _audio(self, e):
        return self._media(e, "Audio")

    def _iframe(self, e):
        src = e.attrs.get("src", "")
        title = e.attrs.get("title") or src
        return [Node("link", [text_node(f"[Embedded: {title}]")], href=src, title=title)]

    def _aside(self, e):
        css, name = e.attrs.get("class", ""), e.attrs.get("id", "")
        if re.search(r"(?i)footnote|foot[-_\s]?note|fn[-_\s]?", css) or re.search(r"(?i)^fn[-_\s]?\d+$|^footnote[-_\s]?\d+$", name):
            self.notes += 1
            return [Node("footnote", self.children(e), identifier=name or f"fn{self.notes}")]
        return self.children(e)

    def _table(self, e):
        rows: list[Element] = []
        for part in ("thead", "tbody", "tfoot"):
            rows += [r for body in e.own(part)[:1] for r in body.own("tr")]
        rows += e.own("tr")
        made = []
        for row in rows:
            cells = row.own("td", "th")
            spans = [{k: c.attrs[k] for k in ("colspan", "rowspan") if c.attrs.get(k, "").isdigit() and int(c.attrs[k]) > 1} for c in cells]
            header = "true" if any(c.tag == "th" for c in cells) else None
            made.append(Node("table-row", [Node("table-cell", self.children(c), **s) for c, s in zip(cells, spans)], isHeader=header))
        caption = next((c.text().strip() for c in e.own("caption")), None)
        return [Node("table", made, caption=caption or None)]


def parse(content: bytes, name: str | None = None, references: tuple[str, ...] | None = None) -> tuple[Node, dict[str, str]]:
    """Tree and metadata of a page; with ``references`` only these are read, closed by a semicolon, and others stay as they are written."""
    markup = content.decode("utf-8", "replace")
    if references is not None:
        markup = re.sub(rf"&(?!(?:{'|'.join(references)});)", "&amp;", markup)
    root = dom(markup)
    body = next(iter(root.all("body")), root)
    walker = Walker()
    tree = Node("document", walker.children(body))
    meta = {}
    if title := next(iter(root.all("title")), None):
        meta["title"] = title.text().strip()
    for m in root.all("meta"):
        if m.attrs.get("name", "").lower() in ("description", "author"):
            meta[m.attrs["name"].lower()] = m.attrs.get("content", "")
    for h in root.all("html"):
        if h.attrs.get("lang"):
            meta["language"] = h.attrs["lang"]
    meta["wordCount"] = str(tree.words())
    return tree, meta


def markdown(tree: Node) -> str:
    return settled(markdown_renderer(WEB)(tree))
