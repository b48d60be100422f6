"""Trees as Markdown, HTML, plain text and JSON."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from quiremill.operators.tree import Node

_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def escape(text: str) -> str:
    return html.escape(text, quote=True).replace("&#x27;", "&#39;")


def safe_url(url: str, image: bool = False) -> bool:
    own = url.strip()
    if _CONTROL.search(own):
        return False
    scheme = _SCHEME.match(own)
    if not scheme:
        return True
    return scheme[0].lower() in ("http:", "https:", "mailto:") or image and own.lower().startswith("data:image/")


@dataclass(frozen=True)
class Style:
    """How tables and a few marks look; sources differ in these."""

    least_width: int = 0
    header_first: bool = False  # the line of dashes follows the first row, not every header row
    escape_pipes: bool = False
    scripts: bool = False  # ~x~ and ^x^


PLAIN = Style()
WEB = Style(least_width=3, header_first=True, scripts=True)
SHEET = Style(header_first=True)


def _padded(rows: list[list[str]], least: int) -> list[int]:
    count = max((len(r) for r in rows), default=0)
    return [max([least, *(len(r[i]) for r in rows if i < len(r))]) for i in range(count)]


def markdown_table(rows: list[list[str]], headers: list[bool] | None = None, style: Style = SHEET) -> str:
    """Aligned cells; a line of dashes after the first row or after each header row."""
    if style.escape_pipes:
        rows = [[x.replace("|", "\\|") for x in r] for r in rows]
    widths = _padded(rows, style.least_width)
    lines = []
    for i, row in enumerate(rows):
        cells = [(row[k] if k < len(row) else "").ljust(w) for k, w in enumerate(widths)]
        lines.append(f"| {' | '.join(cells)} |")
        if i == 0 if style.header_first else headers and headers[i]:
            lines.append(f"| {' | '.join('-' * w for w in widths)} |")
    return "\n".join(lines)


def _cells(node: Node) -> tuple[list[list[str]], list[bool]]:
    return [[c.text() for c in r.children] for r in node.children], [r.attrs.get("isHeader") == "true" for r in node.children]


class Renderer:
    """Text of a node by its type; a type without a rule gives nothing."""

    def __init__(self, rules: dict[str, Callable[[Renderer, Node], str]]):
        self.rules = rules

    def __call__(self, node: Node) -> str:
        rule = self.rules.get(node.type)
        return rule(self, node) if rule else ""

    def inner(self, node: Node, between: str = "") -> str:
        return between.join(map(self, node.children))


def _wrapped(before: str, after: str, between: str = "") -> Callable[[Renderer, Node], str]:
    return lambda r, n: f"{before}{r.inner(n, between)}{after}"


def _always(text: str) -> Callable[[Renderer, Node], str]:
    return lambda r, n: text


def _value(r: Renderer, n: Node) -> str:
    return n.value or ""


def _items(r: Renderer, n: Node) -> str:
    first = int(n.attrs.get("start", 1))
    ordered = n.attrs.get("ordered") == "true"
    return "\n".join(f"{f'{first + i}.' if ordered else '-'} {r.inner(item)}" for i, item in enumerate(n.children))


def _quoted(r: Renderer, n: Node) -> str:
    return "\n".join(f"> {line}" for line in r.inner(n, "\n").split("\n"))


def _titled(n: Node) -> str:
    return f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""


_SHARED = {
    "document": _wrapped("", "", "\n\n"), "section": _wrapped("", "", "\n\n"), "paragraph": _wrapped("", ""), "heading": _wrapped("", ""),
    "list-item": _wrapped("", ""), "table-cell": _wrapped("", ""), "emphasis": _wrapped("", ""), "strong": _wrapped("", ""),
    "strikethrough": _wrapped("", ""), "link": _wrapped("", ""), "text": _value, "html": _value, "raw": _value, "code": _value,
    "inline-code": _value, "math": _value, "list": _items, "blockquote": _quoted, "thematic-break": _always("---"),
    "horizontal-rule": _always("---"), "page-break": _always("\n---\n"), "image": lambda r, n: n.attrs.get("alt", ""),
    **{t: lambda r, n: n.text() for t in ("definition", "quote", "subscript", "superscript")},
}


def markdown_renderer(style: Style = PLAIN) -> Renderer:
    def table(r: Renderer, n: Node) -> str:
        rows, headers = _cells(n)
        own = markdown_table(rows, headers, style)
        return f"*{n.attrs['caption']}*\n\n{own}" if n.attrs.get("caption") else own

    rules = _SHARED | {
        "heading": lambda r, n: f"{'#' * (n.level or 1)} {r.inner(n)}",
        "emphasis": _wrapped("*", "*"),
        "strong": _wrapped("**", "**"),
        "strikethrough": _wrapped("~~", "~~"),
        "inline-code": lambda r, n: f"`{n.value or ''}`",
        "code": lambda r, n: f"```{n.attrs.get('language', '')}\n{n.value or ''}\n```",
        "link": lambda r, n: f"[{r.inner(n)}]({n.attrs.get('href', '')}{_titled(n)})",
        "image": lambda r, n: f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')}{_titled(n)})",
        "table": table,
        "table-row": lambda r, n: f"| {r.inner(n, ' | ')} |",
        "footnote": lambda r, n: f"[^{n.attrs.get('identifier', '')}]: {r.inner(n)}",
        "math": lambda r, n: f"${n.value}$" if n.attrs.get("inline") == "true" else f"$$\n{n.value}\n$$",
    }
    if style.scripts:
        rules |= {"subscript": _wrapped("~", "~"), "superscript": _wrapped("^", "^")}
    return Renderer(rules)


def text_renderer() -> Renderer:
    def table(r: Renderer, n: Node) -> str:
        width = max((len(row.children) for row in n.children), default=0)
        return "\n".join("\t".join([*map(r, row.children), *[""] * (width - len(row.children))]) for row in n.children)

    return Renderer(_SHARED | {"table": table, "table-row": _wrapped("", "", "\t"), "footnote": lambda r, n: f"[{n.attrs.get('identifier', '')}]: {r.inner(n)}"})


def html_renderer() -> Renderer:
    def attr(name: str, value: str | None) -> str:
        return f' {name}="{escape(value)}"' if value else ""

    def link(r: Renderer, n: Node) -> str:
        href = n.attrs.get("href", "")
        return f'<a href="{escape(href)}"{attr("title", n.attrs.get("title"))}>{r.inner(n)}</a>' if safe_url(href) else r.inner(n)

    def image(r: Renderer, n: Node) -> str:
        src = n.attrs.get("src", "")
        return f'<img src="{escape(src)}"{attr("alt", n.attrs.get("alt"))}{attr("title", n.attrs.get("title"))} />' if safe_url(src, True) else ""

    def items(r: Renderer, n: Node) -> str:
        tag = "ol" if n.attrs.get("ordered") == "true" else "ul"
        return f"<{tag}>\n{r.inner(n, chr(10))}\n</{tag}>"

    def row(r: Renderer, n: Node) -> str:
        tag = "th" if n.attrs.get("isHeader") == "true" else "td"
        return "<tr>\n" + "\n".join(f"<{tag}>{r.inner(c)}</{tag}>" for c in n.children) + "\n</tr>"

    def table(r: Renderer, n: Node) -> str:
        if not n.children:
            return ""
        head = [c for c in n.children if c.attrs.get("isHeader") == "true"]
        top = "<thead>\n" + "\n".join(row(r, c) for c in head) + "\n</thead>\n" if head else ""
        return f"<table>\n{top}<tbody>\n" + "".join(row(r, c) + "\n" for c in n.children if c not in head) + "</tbody>\n</table>"

    def quote(value: str) -> str:
        return escape(value)

    tags = {"paragraph": "p", "emphasis": "em", "strong": "strong", "strikethrough": "del", "list-item": "li"}
    return Renderer(
        _SHARED
        | {t: _wrapped(f"<{tag}>", f"</{tag}>") for t, tag in tags.items()}
        | {t: lambda r, n: quote(n.text()) for t in ("definition", "quote", "subscript", "superscript")}
        | {
            "document": _wrapped("<div>", "</div>", "\n"),
            "section": _wrapped("<section>\n", "\n</section>", "\n"),
            "blockquote": _wrapped("<blockquote>\n", "\n</blockquote>", "\n"),
            "heading": lambda r, n: f"<h{n.level}{attr('id', n.attrs.get('id'))}>{r.inner(n)}</h{n.level}>",
            "text": lambda r, n: quote(n.value or ""),
            "inline-code": lambda r, n: f"<code>{quote(n.value or '')}</code>",
            "code": lambda r, n: f"<pre><code{attr('class', 'language-' + n.attrs['language'] if n.attrs.get('language') else None)}>{quote(n.value or '')}</code></pre>",
            "math": lambda r, n: f'<span class="math">{quote(n.value or "")}</span>',
            "link": link, "image": image, "list": items, "table": table, "table-row": row,
            "thematic-break": _always("<hr />"), "horizontal-rule": _always("<hr />"), "page-break": _always('<div class="page-break"></div>'),
            "footnote": lambda r, n: f'<sup><a href="#fn-{escape(n.attrs.get("identifier", ""))}">{escape(n.attrs.get("identifier", ""))}</a></sup>',
        }
    )


def as_json(node: Node) -> str:
    def plain(n: Node) -> dict:
        out: dict = {"type": n.type}
        out |= {k: v for k, v in (("level", n.level), ("value", n.value)) if v is not None} | n.attrs
        if n.children or n.value is None:
            out["children"] = [plain(c) for c in n.children]
        return out

    return json.dumps(plain(node), indent=2, ensure_ascii=False)


def settled(text: str) -> str:
    """At most one blank line in a row, none at the ends."""
    return re.sub(r"\n{3,}", "\n\n", text).strip()


_RENDERERS: dict[str, Callable[[Node], str]] = {
    "markdown": markdown_renderer(), "html": html_renderer(), "plaintext": text_renderer(), "json": as_json,
}


def register_renderer(name: str, render: Callable[[Node], str]) -> None:
    _RENDERERS[name] = render


def renderer_of(output: str) -> Callable[[Node], str]:
    if output not in _RENDERERS:
        raise ValueError(f"no renderer is named {output}")
    return _RENDERERS[output]


def render(node: Node | None, output: str = "markdown") -> str:
    """By a renderer's name; a missing tree is an empty document."""
    return renderer_of(output)(node or Node("document"))
