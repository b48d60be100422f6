"""Images and sound to document trees; recognition and transcription are hooks."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable

from quiremill.operators.tree import Node, paragraph, text_node


def dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) by the header of a PNG, GIF, BMP or JPEG."""
    if data[:4] == b"\x89PNG" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in (0xC0, 0xC1, 0xC2):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


def image_mime(data: bytes) -> str | None:
    for kind, begin in (("png", b"\x89PNG"), ("jpeg", b"\xff\xd8\xff"), ("gif", b"GIF8"), ("bmp", b"BM"), ("tiff", b"II*\0"), ("tiff", b"MM\0*")):
        if data.startswith(begin):
            return f"image/{kind}"
    return "image/webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def parse_image(content: bytes, name: str | None = None, recognise: Callable[[bytes, str], str] | None = None) -> tuple[Node, dict[str, str]]:
    mime = image_mime(content) or "image/png"
    size = dimensions(content)
    text = recognise(content, mime) if recognise else ""
    url = f"data:{mime};base64,{base64.b64encode(content).decode()}"
    picture = Node("image", src=url, alt=name or "image", mimeType=mime, width=size[0] if size else None, height=size[1] if size else None)
    meta = {"mimeType": mime} | ({"width": str(size[0]), "height": str(size[1])} if size else {})
    return Node("document", [Node("paragraph", [picture]), *([paragraph(text)] if text.strip() else [])]), meta


def parse_audio(content: bytes, name: str | None = None, transcribe: Callable[[bytes, str | None], str] | None = None) -> tuple[Node, dict[str, str]]:
    text = transcribe(content, name) if transcribe else "[Audio content: no transcription provider is configured]"
    return Node("document", [paragraph(text)]), {}


def parse_text(content: bytes, name: str | None = None) -> tuple[Node, dict[str, str]]:
    """Plain text and Markdown: headings by their marks, paragraphs by blank lines, else by lines."""
    text = content.decode("utf-8-sig", "replace").replace("\r\n", "\n")
    parts = [p for p in text.split("\n\n" if "\n\n" in text else "\n") if p.strip()]
    nodes = []
    for part in parts:
        marks = len(part) - len(part.lstrip("#"))
        if 1 <= marks <= 6 and part[marks : marks + 1] == " " and "\n" not in part.strip():
            nodes.append(Node("heading", [text_node(part[marks:].strip())], level=marks))
        else:
            nodes.append(paragraph(part.strip("\n")))
    return Node("document", nodes), {}
