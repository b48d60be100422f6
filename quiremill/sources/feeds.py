"""XML, and the feeds among it, to document trees."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from quiremill.operators.tree import Node, heading, paragraph, text_node


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def _child(e: ET.Element, *names: str) -> str:
    for c in e:
        if _name(c) in names:
            return "".join(c.itertext()).strip()
    return ""


def _link(e: ET.Element) -> str:
    return next((c.get("href") or (c.text or "").strip() for c in e if _name(c) == "link"), "")


def feed(root: ET.Element) -> list[Node]:
    """Title, then each entry's title, link and summary; RSS, Atom and RDF alike."""
    channel = next((c for c in root if _name(c) == "channel"), root)
    out = [heading(1, _child(channel, "title") or "Feed")]
    if about := _child(channel, "description", "subtitle"):
        out.append(paragraph(about))
    for entry in root.iter():
        if _name(entry) not in ("item", "entry"):
            continue
        out.append(heading(2, _child(entry, "title") or "Untitled"))
        if link := _link(entry):
            out.append(Node("paragraph", [text_node("Link: "), Node("link", [text_node(link)], href=link)]))
        if summary := _child(entry, "description", "summary", "content"):
            out.append(paragraph(re.sub(r"<[^>]+>", "", summary).strip()))
    return out


def pretty(source: str) -> str:
    """One tag to a line."""
    return re.sub(r">\s*<", ">\n<", source.strip())


def parse(content: bytes, name: str | None = None) -> tuple[Node, dict[str, str]]:
    """Feeds as headings and paragraphs, then the source; malformed markup as source alone."""
    source = content.decode("utf-8-sig", "replace")
    meta: dict[str, str] = {}
    nodes: list[Node] = []
    try:
        root = ET.fromstring(content)
        meta["root"] = _name(root)
        if meta["root"] in ("rss", "feed", "rdf"):
            nodes = feed(root)
            meta["title"] = nodes[0].text()
    except ET.ParseError as e:
        meta["warning"] = f"malformed XML: {e}"
    return Node("document", [*nodes, heading(2, "XML Source"), Node("code", value=pretty(source), language="xml")]), meta
