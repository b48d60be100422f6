"""Zipped formats to document trees: archives, office documents, e-books."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

from quiremill.functions.formats import SIZE_LIMIT
from quiremill.operators.tree import Node, heading, paragraph, table, text_node
from quiremill.sources.html import Walker, dom


def opened(content: bytes, limit: int = SIZE_LIMIT) -> zipfile.ZipFile:
    """An archive whose unpacked size has been checked before anything is unpacked."""
    z = zipfile.ZipFile(io.BytesIO(content))
    size = sum(i.file_size for i in z.infolist())
    if size > limit:
        raise ValueError(f"the archive would unpack to {size} bytes; the limit is {limit}")
    return z


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _all(e: ET.Element, name: str):
    return (x for x in e.iter() if _local(x) == name)


def _first(e: ET.Element | None, name: str) -> ET.Element | None:
    return None if e is None else next(_all(e, name), None)


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, base = posixpath.split(part)
    root = _xml(z, f"{folder}/_rels/{base}.rels")
    return {r.get("Id", ""): r.get("Target", "") for r in root} if root is not None else {}


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    root = _xml(z, "docProps/core.xml")
    names = {"title": "title", "creator": "author", "subject": "subject", "description": "description", "created": "createdAt", "modified": "modifiedAt", "keywords": "keywords"}
    return {names[_local(e)]: e.text.strip() for e in (root if root is not None else []) if _local(e) in names and (e.text or "").strip()}


def human_size(size: float) -> str:
    if size < 1024:
        return f"{int(size)} B"
    for unit in ("KB", "MB", "GB"):
        size /= 1024
        if size < 1024 or unit == "GB":
            return f"{size:.1f} {unit}"
    return ""


# --- archives -------------------------------------------------------------------------------------------------------


def entries(content: bytes) -> list[tuple[str, int, bool]]:
    """(path, size, is a folder) in the order of readers: letters before case."""
    with opened(content) as z:
        found = [(i.filename, i.file_size, i.is_dir()) for i in z.infolist()]
    return sorted(found, key=lambda x: (x[0].casefold(), x[0].swapcase()))


def parse_archive(content: bytes, name: str | None = None) -> tuple[Node, dict[str, str]]:
    found = entries(content)
    folders = sum(d for _, _, d in found)
    rows = [["Path", "Size", "Type"], *([p, human_size(s), "Directory" if d else "File"] for p, s, d in found)]
    nodes = [heading(1, f"Archive: {name or 'archive.zip'}"), paragraph(f"{len(found) - folders} files, {folders} directories"), table(rows)]
    return Node("document", nodes), {"files": str(len(found) - folders), "directories": str(folders)}


# --- text documents -------------------------------------------------------------------------------------------------


def _on(properties: ET.Element | None, name: str) -> bool:
    e = next((x for x in properties if _local(x) == name), None) if properties is not None else None
    return e is not None and _attr(e, "val") in (None, "true", "1", "on")


def _run(r: ET.Element) -> Node | None:
    parts = []
    for e in r:
        kind = _local(e)
        parts.append((e.text or "") if kind == "t" else "\t" if kind == "tab" else "\n" if kind in ("br", "cr") else "")
    text = "".join(parts)
    if not text:
        return None
    node: Node = text_node(text)
    properties = next((x for x in r if _local(x) == "rPr"), None)
    for flag, kind in (("i", "emphasis"), ("b", "strong"), ("strike", "strikethrough")):
        if _on(properties, flag):
            node = Node(kind, [node])
    return node


def _image(d: ET.Element, relations: dict[str, str]) -> Node | None:
    blip = _first(d, "blip")
    target = relations.get((_attr(blip, "embed") or "") if blip is not None else "")
    if not target:
        return None
    about = _first(d, "docPr")
    alt = (about.get("title") or about.get("descr")) if about is not None else None
    return Node("image", src=target, alt=alt, mimeType=f"image/{target.rsplit('.', 1)[-1].lower().replace('jpg', 'jpeg')}")


def _merged(nodes: list[Node]) -> list[Node]:
    """Neighbours of the same mark as one."""
    out: list[Node] = []
    for n in nodes:
        if out and n.type == out[-1].type and n.type in ("strong", "emphasis", "strikethrough"):
            out[-1].children += n.children
        else:
            out.append(n)
    return out


def _paragraph(p: ET.Element, relations: dict[str, str]) -> Node | None:
    inner: list[Node] = []
    for e in p:
        kind = _local(e)
        if kind == "r":
            inner += [x for x in (_run(e), *(_image(d, relations) for d in _all(e, "drawing"))) if x]
        elif kind == "hyperlink":
            runs = [x for x in map(_run, _all(e, "r")) if x]
            href = relations.get(_attr(e, "id") or "") or (f"#{_attr(e, 'anchor')}" if _attr(e, "anchor") else "")
            inner += [Node("link", runs, href=href)] if href and runs else runs
        elif kind in ("ins", "smartTag"):
            inner += [x for x in map(_run, _all(e, "r")) if x]
    inner = _merged(inner)
    if not inner:
        return None
    style = _first(p, "pStyle")
    found = re.fullmatch(r"Heading\s?([1-6])", (_attr(style, "val") or "") if style is not None else "")
    return Node("heading", inner, level=int(found[1])) if found else Node("paragraph", inner)


def _word_table(t: ET.Element, relations: dict[str, str]) -> Node:
    rows = []
    for i, tr in enumerate(x for x in t if _local(x) == "tr"):
        cells = []
        for tc in (x for x in tr if _local(x) == "tc"):
            inner = [n for p in _all(tc, "p") if (q := _paragraph(p, relations)) for n in q.children]
            span = _first(tc, "gridSpan")
            cells.append(Node("table-cell", inner, colspan=_attr(span, "val") if span is not None else None))
        rows.append(Node("table-row", cells, isHeader="true" if i == 0 else None))
    return Node("table", rows)


def parse_docx(content: bytes, name: str | None = None) -> tuple[Node, dict[str, str]]:
    with opened(content) as z:
        root = _xml(z, "word/document.xml")
        if root is None:
            raise ValueError("no document part")
        relations = _relations(z, "word/document.xml")
        nodes = []
        body = _first(root, "body")
        for e in body if body is not None else []:
            made = _paragraph(e, relations) if _local(e) == "p" else _word_table(e, relations) if _local(e) == "tbl" else None
            nodes += [made] if made else []
        return Node("document", nodes), _core(z)


# --- slides ---------------------------------------------------------------------------------------------------------


def _slide_names(z: zipfile.ZipFile) -> list[str]:
    part = "ppt/presentation.xml"
    root, relations = _xml(z, part), _relations(z, part)
    listed = [relations.get(_attr(e, "id") or "") for e in _all(root, "sldId")] if root is not None else []
    found = [posixpath.normpath(posixpath.join("ppt", t)) if not t.startswith("/") else t[1:] for t in listed if t]
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    return found or sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)


def _lines(shape: ET.Element) -> list[str]:
    return [x for x in ("".join(t.text or "" for t in _all(p, "t")) for p in _all(shape, "p") if p.tag.startswith("{http://schemas.openxmlformats.org/drawingml")) if x.strip()]


def parse_pptx(content: bytes, name: str | None = None) -> tuple[Node, dict[str, str]]:
    with opened(content) as z:
        sections: list[Node] = []
        names = _slide_names(z)
        for i, part in enumerate(names):
            root = _xml(z, part)
            if root is None:
                continue
            nodes: list[Node] = []
            title = None
            for shape in _all(root, "sp"):
                about = _first(shape, "cNvPr")
                lines = _lines(shape)
                if title is None and lines and about is not None and re.search("title", about.get("name", ""), re.I):
                    title = " ".join(lines)
                else:
                    nodes += [paragraph(x) for x in lines if x != title]
            for t in _all(root, "tbl"):
                rows = [[" ".join("".join(x.text or "" for x in _all(p, "t")) for p in _all(tc, "p")) for tc in tr if _local(tc) == "tc"] for tr in _all(t, "tr")]
                nodes += [table(rows)] if rows else []
            notes = _xml(z, part.replace("slides/slide", "notesSlides/notesSlide"))
            if notes is not None and (spoken := [x for s in _all(notes, "sp") for x in _lines(s)]):
                nodes.append(Node("paragraph", [Node("strong", [text_node("Speaker Notes:")]), text_node(" " + " ".join(spoken))]))
            if sections:
                sections.append(Node("page-break", pageNumber=i + 1))
            sections.append(Node("section", [heading(2, title or f"Slide {i + 1}"), *nodes], title=title or f"Slide {i + 1}"))
        return Node("document", sections), {**_core(z), "slideCount": str(len(names))}


# --- sheets ---------------------------------------------------------------------------------------------------------


def column_number(letters: str) -> int:
    """A is 0, Z is 25, AA is 26."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


#: Cells that a sheet may have once merged ranges are filled.
MOST_CELLS = 5_000_000


def column_letters(number: int) -> str:
    out = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheet_cells(root: ET.Element, shared: list[str]) -> tuple[dict[tuple[int, int], str], list[tuple[int, int, int, int]]]:
    """Texts by (row, column) and the merged ranges (top, left, bottom, right)."""
    cells = {}
    for c in _all(root, "c"):
        at = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
        if not at:
            continue
        value = next((v.text or "" for v in c if _local(v) == "v"), None)
        kind = c.get("t")
        if kind == "inlineStr":
            value = "".join(t.text or "" for t in _all(c, "t"))
        elif value is None:
            value = next((f.text or "" for f in c if _local(f) == "f"), "")
        elif kind == "s" and value.isdigit() and int(value) < len(shared):
            value = shared[int(value)]
        elif kind == "b":
            value = "TRUE" if value == "1" else "FALSE"
        cells[int(at[2]) - 1, column_number(at[1])] = value
    merges = []
    for m in _all(root, "mergeCell"):
        if at := re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", m.get("ref", "")):
            merges.append((int(at[2]) - 1, column_number(at[1]), int(at[4]) - 1, column_number(at[3])))
    return cells, merges


def grid(cells: dict[tuple[int, int], str], merges: list[tuple[int, int, int, int]]) -> list[list[str]]:
    """A full grid: merged ranges are filled, and rows and columns without a text go.

    Only rows and columns in use are laid out, so a far cell costs nothing; a sheet of more than ``MOST_CELLS`` is refused.
    """
    merges = [m for m in merges if (m[0], m[1]) in cells]
    if len(cells) + sum((bottom - top + 1) * (right - left + 1) for top, left, bottom, right in merges) > MOST_CELLS:
        raise ValueError(f"a sheet of more than {MOST_CELLS} cells")
    cells = dict(cells)
    for top, left, bottom, right in merges:
        cells |= {(r, c): cells[top, left] for r in range(top, bottom + 1) for c in range(left, right + 1)}
    full = [at for at, text in cells.items() if text.strip()]
    rows, columns = (sorted(set(x)) for x in zip(*full)) if full else ([], [])
    if len(rows) * len(columns) > MOST_CELLS:
        raise ValueError(f"a sheet of more than {MOST_CELLS} cells")
    return [[cells.get((r, c), "") for c in columns] for r in rows]


def parse_xlsx(content: bytes, name: str | None = None) -> tuple[Node, dict[str, str]]:
    with opened(content) as z:
        book = _xml(z, "xl/workbook.xml")
        if book is None:
            raise ValueError("no workbook part")
        texts = _xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in (texts if texts is not None else [])]
        relations = _relations(z, "xl/workbook.xml")
        sections = []
        for i, sheet in enumerate(_all(book, "sheet")):
            target = relations.get(_attr(sheet, "id") or "", f"worksheets/sheet{i + 1}.xml")
            part = target[1:] if target.startswith("/") else f"xl/{target}"
            root = _xml(z, part)
            rows = grid(*sheet_cells(root, shared)) if root is not None else []
            title = sheet.get("name", f"Sheet {i + 1}")
            sections.append(Node("section", [heading(2, title), *([table(rows)] if rows else [])], title=title))
        return Node("document", sections), {**_core(z), "sheetCount": str(len(sections))}


# --- e-books --------------------------------------------------------------------------------------------------------


def parse_epub(content: bytes, name: str | None = None) -> tuple[Node, dict[str, str]]:
    """Pages in reading order, with the titles of the table of contents; pages of hardly any text go."""
    with opened(content) as z:
        root_file = _first(_xml(z, "META-INF/container.xml"), "rootfile")
        if root_file is None:
            raise ValueError("no package document")
        part = root_file.get("full-path", "")
        package = _xml(z, part)
        folder = posixpath.dirname(part)
        if package is None:
            raise ValueError("no package document")
        meta = {}
        names = {"title": "title", "creator": "author", "language": "language", "publisher": "publisher", "date": "createdAt", "description": "description"}
        about = _first(package, "metadata")
        for e in about if about is not None else []:
            if _local(e) in names and (e.text or "").strip():
                meta.setdefault(names[_local(e)], e.text.strip())
        files = {i.get("id"): (posixpath.normpath(posixpath.join(folder, i.get("href", ""))), i.get("media-type", "")) for i in _all(package, "item")}
        titles: dict[str, str] = {}
        for path, kind in files.values():
            if kind == "application/x-dtbncx+xml" and (ncx := _xml(z, path)) is not None:
                for point in _all(ncx, "navPoint"):
                    label, link = _first(point, "text"), _first(point, "content")
                    if label is not None and link is not None:
                        target = posixpath.normpath(posixpath.join(posixpath.dirname(path), link.get("src", "").partition("#")[0]))
                        titles.setdefault(target, (label.text or "").strip())
        sections = []
        for ref in _all(package, "itemref"):
            path, _ = files.get(ref.get("idref"), ("", ""))
            if path not in z.namelist():
                continue
            page = dom(z.read(path).decode("utf-8", "replace"))
            nodes = Walker(book=True).children(next(iter(page.all("body")), page))
            if len("".join(n.text() for n in nodes).strip()) >= 10:
                sections.append(Node("section", nodes, title=titles.get(path)))
        return Node("document", sections), {**meta, "chapterCount": str(len(sections))}
