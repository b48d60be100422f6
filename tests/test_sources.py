"""Parsers on documents built here."""

import io
import zipfile

import pytest

from quiremill.operators.render import as_json, html_renderer, markdown_renderer, markdown_table, render, text_renderer
from quiremill.operators.rules import optimize
from quiremill.operators.tree import Node, from_rows, heading, paragraph, table, text_node
from quiremill.sources import feeds, html, media, packages, tabular


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def page(body):
    return html.parse(f"<html lang=en><head><title>T &amp; U</title><meta name=author content=Me></head><body>{body}</body></html>".encode())


def test_page():
    tree, meta = page("<nav>n</nav><h1 id=a>Head</h1><p>one <b>two</b> <a href='u' title='t'>link</a><p>three<!-- c --><footer>f</footer>")
    assert meta["title"] == "T & U" and meta["author"] == "Me" and meta["language"] == "en"
    assert html.markdown(tree) == '# Head\n\none **two**[link](u "t")\n\nthree'
    assert tree.find("heading")[0].attrs == {"id": "a"}


def test_page_lists_code_tables():
    tree, _ = page("<ol start=3><li>a<li>b</ol><pre><code class='language-py'>x = 1</code></pre><table><caption>C</caption><thead><tr><th>h</th></tr></thead><tbody><tr><td colspan=2>v</td></tr></tbody></table>")
    assert html.markdown(tree) == "3. a\n4. b\n\n```py\nx = 1\n```\n\n*C*\n\n| h   |\n| --- |\n| v   |"
    assert tree.find("table-cell")[1].attrs == {"colspan": "2"}


def test_page_marks_and_media():
    tree, _ = page("<p><del>a</del><sub>b</sub><sup>c</sup><u>d</u><mark>e</mark><code>f</code></p><video poster='p.png'></video><audio src='s.mp3'></audio><iframe src='i' title='I'></iframe><aside id=fn1>note</aside><img src='pixel.gif'><img src='a.png' width=1 height=1><img src='real.png' alt=A>")
    text = html.markdown(tree)
    assert "~~a~~~b~^c^<u>d</u>==e==`f`" in text and "![[Video: p.png]](p.png)" in text and "[Embedded: I]" in text and "[^fn1]: note" in text
    assert [n.attrs["src"] for n in tree.find("image")] == ["p.png", "real.png"]


def test_page_details_and_scripts():
    tree, _ = page("<details><summary>S</summary><p>in</p></details><script>var x</script>")
    assert tree.text() == "<details><summary>S</summary>\n\nin\n\n</details>"


def test_csv():
    assert tabular.csv_rows('a,"b ""x"", c"\r\n\n1,"two\nlines"\n') == [["a", 'b "x", c'], ["1", "two\nlines"]]
    tree, meta = tabular.parse_csv(b"name\tage\nAda\t36\n", "x.tsv")
    assert meta == {"rows": "1", "columns": "2"}
    assert markdown_table([["name", "age"], ["Ada", "36"]]) == "| name | age |\n| ---- | --- |\n| Ada  | 36  |"
    assert tree.find("table-row")[0].attrs["isHeader"] == "true"
    assert tabular.parse_csv(b"")[0].children == []


def test_json():
    tree, _ = tabular.parse_json(b'[{"a": 1, "b": null}, {"c": {"d": [1]}, "a": 2.0}]')
    assert [[c.text() for c in r.children] for r in tree.find("table-row")] == [["a", "b", "c"], ["1", "", ""], ["2", "", '{"d":[1]}']]
    assert tabular.parse_json(b'{"x": 1}')[0].find("code")[0].value == '{\n  "x": 1\n}'
    assert len(tabular.parse_json(b'{"a": 1}\n{"a": 2}\n')[0].find("table-row")) == 3
    with pytest.raises(ValueError):
        tabular.parse_json(b"{nope")


def test_feeds():
    rss = b"<rss><channel><title>F</title><item><title>One</title><link>http://x/1</link><description>d &lt;b&gt;1&lt;/b&gt;</description></item><item><title>Two</title></item></channel></rss>"
    tree, meta = feeds.parse(rss)
    assert meta["title"] == "F" and [n.text() for n in tree.find("heading")] == ["F", "One", "Two", "XML Source"]
    assert [n.attrs["href"] for n in tree.find("link")] == ["http://x/1"]
    atom = b"<feed xmlns='http://www.w3.org/2005/Atom'><title>A</title><entry><title>E</title><link href='http://e'/><summary>s</summary></entry></feed>"
    assert "s" in [n.text() for n in feeds.parse(atom)[0].find("paragraph")]
    assert "malformed" in feeds.parse(b"<unclosed>")[1]["warning"]


def test_archive():
    tree, meta = packages.parse_archive(archive({"readme.txt": "x" * 2048, "src/": "", "src/index.ts": "y"}), "a.zip")
    assert meta == {"files": "2", "directories": "1"}
    assert [c.text() for c in tree.find("table-row")[1].children] == ["readme.txt", "2.0 KB", "File"]
    with pytest.raises(ValueError):
        packages.opened(archive({"a": "x" * 100}), limit=10)


W = 'xmlns:w="w" xmlns:r="r" xmlns:wp="wp" xmlns:a="a"'


def test_docx():
    body = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
    <w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bo</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>ld</w:t></w:r><w:r><w:rPr><w:i w:val="false"/></w:rPr><w:t> no</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>go</w:t></w:r></w:hyperlink></w:p>
    <w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
    rels = '<Relationships><Relationship Id="r1" Target="http://x"/></Relationships>'
    core = "<c xmlns:dc='dc'><dc:title>Doc</dc:title><dc:creator>Ann</dc:creator></c>"
    tree, meta = packages.parse_docx(archive({"word/document.xml": body, "word/_rels/document.xml.rels": rels, "docProps/core.xml": core}))
    assert meta == {"title": "Doc", "author": "Ann"}
    assert render(tree) == "## Head\n\n**bold** no[go](http://x)\n\n| h |   |\n| - | - |\n| a | b |"
    assert tree.find("table-cell")[0].attrs == {"colspan": "2"}
    with pytest.raises(ValueError):
        packages.parse_docx(archive({"x": "y"}))


def test_pptx():
    A, P = "http://schemas.openxmlformats.org/drawingml/2006/main", "p"
    slide = f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:sp><p:nvSpPr><p:cNvPr name="Title 1"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>%s</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>%s</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'
    notes = f'<p:notes xmlns:p="{P}" xmlns:a="{A}"><p:sp><p:txBody><a:p><a:r><a:t>say</a:t></a:r></a:p></p:txBody></p:sp></p:notes>'
    tree, meta = packages.parse_pptx(archive({"ppt/slides/slide1.xml": slide % ("One", "x"), "ppt/slides/slide10.xml": slide % ("Ten", "z"), "ppt/slides/slide2.xml": slide % ("Two", "y"), "ppt/notesSlides/notesSlide1.xml": notes}))
    assert meta["slideCount"] == "3" and [n.text() for n in tree.find("heading")] == ["One", "Two", "Ten"]
    assert len(tree.find("page-break")) == 2 and "Speaker Notes: say" in tree.text()


def test_xlsx():
    book = '<w><sheets><sheet name="S" xmlns:r="r" r:id="rId1"/></sheets></w>'
    rels = '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'
    sheet = '<ws><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2" t="b"><v>1</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c></row><row><c r="A4"><f>A1+1</f></c></row></sheetData><mergeCells><mergeCell ref="C2:D2"/></mergeCells></ws>'
    tree, meta = packages.parse_xlsx(archive({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>"}))
    assert [[c.text() for c in r.children] for r in tree.find("table-row")] == [["name", "2", ""], ["TRUE", "in", "in"], ["A1+1", "", ""]]
    assert meta["sheetCount"] == "1"
    assert [packages.column_number(x) for x in ("A", "Z", "AA", "AB")] == [0, 25, 26, 27] and packages.column_letters(27) == "AB"
    assert packages.grid({(0, 0): " ", (0, 1): "", (1, 0): "x", (1, 1): "y"}, []) == [["x", "y"]]


def test_epub():
    files = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>',
        "OEBPS/c.opf": '<package xmlns:dc="dc"><metadata><dc:title>Book</dc:title><dc:creator>Auth</dc:creator></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><item id="e" href="e.xhtml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="e"/></spine></package>',
        "OEBPS/toc.ncx": '<ncx><navMap><navPoint><navLabel><text>Chapter A</text></navLabel><content src="a.xhtml#x"/></navPoint></navMap></ncx>',
        "OEBPS/a.xhtml": "<html><body><h1>A</h1><p>first chapter text</p></body></html>",
        "OEBPS/b.xhtml": "<html><body><p>second file comes first</p></body></html>",
        "OEBPS/e.xhtml": "<html><body> </body></html>",
    }
    tree, meta = packages.parse_epub(archive(files))
    assert meta == {"title": "Book", "author": "Auth", "chapterCount": "2"}
    assert [s.attrs.get("title") for s in tree.children] == [None, "Chapter A"]


def test_media():
    assert media.dimensions(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x05\0\0\0\x07") == (5, 7)
    assert media.dimensions(b"GIF89a\x03\0\x04\0") == (3, 4)
    assert media.dimensions(b"BM" + b"\0" * 16 + (9).to_bytes(4, "little") + (8).to_bytes(4, "little")) == (9, 8)
    assert media.dimensions(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x02\0\x03" + b"\0" * 9) == (3, 2)
    tree, _ = media.parse_image(b"\x89PNG", "p.png", lambda data, mime: "seen text")
    assert tree.find("image")[0].attrs["src"].startswith("data:image/png;base64,") and "seen text" in tree.text()
    assert "transcription" in media.parse_audio(b"ID3")[0].text()
    assert media.parse_audio(b"x", "a.mp3", lambda data, name: "hello")[0].text() == "hello"


def test_renderers():
    tree = Node("document", [heading(1, "A & B", id='x"y'), Node("paragraph", [Node("link", [text_node("bad")], href="javascript:x"), Node("image", src="javascript:y"), Node("image", src="data:image/png;base64,AA", alt="ok")]), table([["h", "i"], ["1"]]), Node("blockquote", [paragraph("q")]), Node("page-break"), Node("math", value="x", inline="true")])
    out = html_renderer()(tree)
    assert "javascript" not in out and '<h1 id="x&quot;y">A &amp; B</h1>' in out and "<th>h</th>" in out and "<td>1</td>" in out and 'alt="ok"' in out
    assert markdown_renderer()(tree).startswith("# A & B\n\n[bad](javascript:x)")
    assert "h\ti\n1\t" in text_renderer()(tree) and "> q" in text_renderer()(tree)
    assert '"type": "document"' in as_json(tree)
    assert render(None, "json").startswith("{")
    with pytest.raises(ValueError):
        render(tree, "nope")


def test_rows_round_trip():
    tree = Node("document", [heading(2, "a", id="i"), Node("section", [paragraph("b"), Node("list", [Node("list-item", [text_node("c")])], ordered="true")])])
    rows = tree.rows()
    assert [r["last_desc"] for r in rows] == [8, 2, 2, 8, 5, 5, 8, 8, 8] and as_json(from_rows(rows)) == as_json(tree) and tree.depth() == 4
    assert [n.type for n in tree.walk(lambda n: n.type != "section")] == ["document", "heading", "text", "section"]


def test_rules():
    tree = Node("document", [Node("image", src="pixel.gif"), Node("html", value="<!-- c --> x"), Node("html", value="<!-- c -->"), Node("paragraph", [text_node("a    b"), text_node("Copyright © Us")]), Node("list", [Node("list-item", [text_node(x)]) for x in "aab"]), Node("table", table([["h"]]).children + table([["h"]]).children + table([["v"]], header=False).children)])
    before = as_json(tree)
    clean = optimize(tree, own=[lambda n: None if n.type == "callout" else n])
    assert as_json(tree) == before
    assert [n.type for n in clean.children] == ["html", "paragraph", "list", "table"] and clean.children[0].value == "x"
    assert clean.children[1].text() == "a b" and len(clean.children[2].children) == 2 and len(clean.children[3].children) == 2
    assert as_json(optimize(tree, ["unknown"])) == before


def test_far_cells_and_large_merges():
    assert packages.grid({(0, 0): "a", (1_048_575, 16_383): "b"}, []) == [["a", ""], ["", "b"]]
    assert packages.grid({(0, 0): "a", (2, 1): " "}, [(0, 0, 1, 1)]) == [["a", "a"], ["a", "a"]]
    with pytest.raises(ValueError, match="cells"):
        packages.grid({(0, 0): "a"}, [(0, 0, 1_048_575, 16_383)])
