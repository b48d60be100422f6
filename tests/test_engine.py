"""The engine, chunks, tree tables, layout, bundles and streams."""

import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from quiremill.functions import formats
from quiremill.operators import fingerprint, pdf_layout, rules, tables, tree
from quiremill.operators.chunk import Chunk, Options, chunk_tree, chunks, classify, register_strategy
from quiremill.operators.tree import Node, heading, paragraph, text_node
from quiremill.plans.engine import Engine, PluginError
from quiremill.sources import media
from quiremill.streaming import rate_limit, watch

DOCS = [
    (1, b"<h1>A</h1><p>x</p>", "a.html", None), (2, b"a,b\n1,2\n", "b.csv", None), (3, b"{bad", "c.json", None), (4, b"??", "d.unknown", None),
    (5, None, "e.txt", None), (6, b"%PDF-1", None, None), (7, b"# T\n\nbody", "f.md", None),
]


@pytest.fixture(scope="module")
def results(spark):
    return Engine(spark).convert(spark.createDataFrame(DOCS, "doc_id long, content binary, file_name string, mime_type string")).cache()


def test_convert(results):
    rows = {r.doc_id: r for r in results.collect()}
    assert rows[1].markdown == "# A\n\nx" and rows[2].markdown == "| a | b |\n| - | - |\n| 1 | 2 |"
    assert rows[3].error and rows[4].error.startswith("UnsupportedFormat") and rows[5].markdown == "" and rows[6].warnings and rows[7].markdown == "# T\n\nbody"


def test_summary_and_renderings(spark, results):
    engine = Engine(spark)
    by = {r.converter_id: (r.total, r.failed) for r in engine.summary(results).collect()}
    assert by["json"] == (1, 1) and by["html"] == (1, 0)
    out = {r.doc_id: r.output for r in engine.rendered(results, "html").collect()}
    assert out[1] == "<div><h1>A</h1>\n<p>x</p></div>" and out[3] == "<div></div>"


def test_failfast(spark):
    with pytest.raises(Exception, match="c.json|Expecting"):
        Engine(spark).convert(spark.createDataFrame(DOCS[2:3], "doc_id long, content binary, file_name string, mime_type string"), mode="FAILFAST").collect()


def test_plugins_and_middleware(spark):
    engine = Engine(spark)

    class Shout:
        name = "shout"
        converters = {"text": lambda content, name=None: (Node("document", [paragraph(content.decode().upper())]), {})}

        def initialize(self, e):
            e.middleware("before", lambda d: d.where("doc_id = 7"), 2)
            e.middleware("after", lambda d: d.withColumn("seen", F.lit(True)))

        def destroy(self, e):
            e.before.clear()

    engine.use(Shout())
    with pytest.raises(PluginError):
        engine.use(Shout())
    rows = engine.convert(spark.createDataFrame(DOCS, "doc_id long, content binary, file_name string, mime_type string")).collect()
    assert [(r.doc_id, r.markdown, r.seen) for r in rows] == [(7, "# T\n\nBODY", True)]
    engine.remove("shout")
    assert engine.converters["text"] is media.parse_text and engine.converter_for_mime("text/plain") == "text"
    with pytest.raises(PluginError):
        engine.remove("shout")


def test_deep_pages(spark):
    pages = [(1, b"<b>" * 400 + b"x" + b"</b>" * 400), (2, b"<div>" * 3000 + b"<p>deep</p>")]
    engine = Engine(spark)
    docs = spark.createDataFrame([(i, c, "a.html") for i, c in pages], "doc_id long, content binary, file_name string")
    found = {r.doc_id: r for r in engine.convert(docs, optimize=True, chunking=Options("heading", 64)).collect()}
    assert found[1].error is None and found[1].markdown.strip("*") == "x" and found[2].error is None and found[2].markdown == "deep"
    assert engine.rendered(engine.convert(docs), "html").where("output like '%deep%'").count() == 1


def test_new_formats_are_dispatched(spark):
    engine = Engine(spark)
    engine.register_converter("foo", lambda content, name=None: (Node("document", [paragraph("foo " + content.decode())]), {}), ["application/x-foo"], ["foo"])
    assert (engine.converter_for_mime("Application/X-Foo"), engine.converter_for_extension("FOO"), engine.converter_ids()[0]) == ("foo", "foo", "foo")
    rows = [(1, b"a", "a.foo", None), (2, b"b", None, "application/x-foo"), (3, b"<p>c</p>", "c.html", None)]
    docs = spark.createDataFrame(rows, "doc_id long, content binary, file_name string, mime_type string")
    assert {r.doc_id: r.markdown for r in engine.convert(docs).collect()} == {1: "foo a", 2: "foo b", 3: "c"}
    engine.unregister_converter("foo")
    assert engine.convert(docs).where("error is null").count() == 1 and engine.converter_for_extension(".foo") is None
    kinds = docs.select("doc_id", formats.can_convert("html", F.col("mime_type"), F.col("file_name")).alias("ok")).collect()
    assert {r.doc_id: r.ok for r in kinds} == {1: False, 2: False, 3: True}


def test_providers(spark):
    def read_pdf(data):
        texts = [x.split(",") for x in data.decode()[5:].split(";")]
        return [(1, 10.0, 700.0 - 20 * i, float(size), text) for i, (text, size) in enumerate(texts)]

    engine = Engine(spark, recognise=lambda data, mime: f"seen {mime}", transcribe=lambda data, name: f"heard {name}", read_pdf=read_pdf)
    rows = [(1, b"\x89PNG", "a.png", None), (2, b"ID3", "b.mp3", None), (3, b"%PDF Ti,24;body,10;more,10;more,10", "c.pdf", None), (4, b"%PDF bad", "d.pdf", None)]
    docs = spark.createDataFrame(rows, "doc_id long, content binary, file_name string, mime_type string")
    found = {r.doc_id: r.markdown for r in engine.convert(docs).collect()}
    assert "seen image/png" in found[1] and found[2] == "heard b.mp3"
    pdfs = {r.doc_id: r.markdown for r in engine.pdf_results(docs.where("doc_id > 2")).collect()}
    assert pdfs[3].startswith("# Ti") and "body" in pdfs[3] and pdfs[4] is None


def test_too_large_files_are_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("small")
    (tmp_path / "in" / "b.txt").write_text("far too large")
    engine = Engine(spark)
    out = engine.convert(engine.files(str(tmp_path / "in"), limit=8))
    assert sorted((r.markdown or "", (r.error or "").split(":")[0]) for r in out.collect()) == [("", "FileTooLarge"), ("small", "")]
    assert [(r.total, r.failed) for r in engine.summary(out).collect()] == [(2, 1)]


def test_mirrored_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.html").write_text("<h1>A</h1>")
    (tmp_path / "in" / "sub" / "b.txt").write_text("b")
    engine = Engine(spark)
    out = engine.convert(engine.files(str(tmp_path / "in")))
    for _ in range(2):
        engine.write_files(out, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a.md": "# A", "sub/b.md": "b"}
    shown = io.StringIO()
    engine.write_stream(out, shown)
    assert sorted(shown.getvalue().split()) == ["#", "A", "b"]


def test_chunks_of_the_same_pass(spark, results):
    options = Options("heading", 64)
    docs = spark.createDataFrame(DOCS, "doc_id long, content binary, file_name string, mime_type string")
    engine = Engine(spark)
    once = engine.chunks(engine.convert(docs, chunking=options))
    twice = engine.chunks(results, options)
    assert sorted(map(str, once.select(sorted(once.columns)).collect())) == sorted(map(str, twice.select(sorted(twice.columns)).collect())) and once.count() > 2


def test_duplicates_are_equal_texts(spark):
    rows = [(1, "A  b"), (2, "a b "), (3, "a c"), (4, None), (5, None), (6, "😀")]
    found = fingerprint.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.n, r.first) for r in found if r.digest] == [(2, 1)]


def test_chunk_strategies():
    doc = Node("document", [heading(1, "A"), paragraph("one two three"), heading(3, "C"), paragraph("four five"), Node("page-break", pageNumber=2), paragraph("six"), Node("thematic-break"), Node("code", value="x = 1")])
    found = chunk_tree(doc)
    assert [(c.content, c.path) for c in found] == [("one two three", ["A"]), ("four five\n\nsix\n\nx = 1", ["A", None, "C"])]
    assert [c.page for c in chunk_tree(doc, Options("page"))] == [None, 2]
    parts = chunk_tree(doc, Options("semantic", overlap=2))
    assert parts[1].content.startswith("two three\n\nC") and len(parts) == 3
    assert chunk_tree(Node("document", [heading(1, "only")])) == []
    with pytest.raises(ValueError):
        chunk_tree(doc, Options("nope"))


def test_long_paragraphs_split_at_sentences():
    text = " ".join(f"Sentence number {i} has seven words here." for i in range(40))
    found = chunk_tree(Node("document", [heading(1, "H"), paragraph(text)]), Options("heading", 50))
    assert len(found) > 3 and all(c.content.endswith(".") and c.path == ["H"] for c in found) and " ".join(c.content for c in found) == text


def test_overlap_is_carried():
    doc = Node("document", [paragraph(f"p{i} " * 6) for i in range(4)])
    found = chunk_tree(doc, Options("heading", 12, overlap=3, tokenizer=lambda t: 1))
    assert found[1].content.startswith("p1 p1 p1\n\n") and found[1].overlap_end == 8


def test_kinds():
    assert classify([heading(1, "a"), paragraph("b")]) == "heading-only" and classify([paragraph("a")]) == "narrative"
    assert classify([Node("code", value="x"), Node("list")]) == "mixed" and classify([]) == "narrative"


def test_chunk_table(spark, results):
    register_strategy("whole", lambda t, o: [Chunk(t.text(), [], 1, nodes=[t])])
    assert {r.doc_id for r in chunks(results.where("error is null"), Options("whole")).collect()} == {1, 2, 5, 6, 7}
    a, b = (chunks(results, Options()).orderBy("doc_id", "chunk_idx").collect() for _ in range(2))
    assert a == b and a[0].chunk_id and a[0].heading_path == ["A"]


def test_tree_tables(spark, results):
    nodes = tree.exploded(results.where("doc_id in (1, 7)"))
    assert {(r.doc_id, r.text, r.level) for r in tree.headings(nodes).collect()} == {(1, "A", 1), (7, "T", 1)}
    assert {r.doc_id: r.structure for r in tree.structure(nodes).collect()}[1] == "document,heading,text,paragraph,text"
    assert {r.depth for r in tree.depths(nodes).collect()} == {2}
    assert tree.pruned(nodes, F.col("type") == "heading").where("type = 'text'").count() == 2
    one = tree.merged(nodes.withColumn("g", F.lit(0)).withColumnRenamed("doc_id", "d"), "g", "d").orderBy("node_id").collect()
    assert [r.node_id for r in one] == list(range(9)) and one[0].last_desc == 8 and [r.ordinal for r in one if r.depth == 1] == [0, 1, 2, 3]


def test_tables_images_links(spark):
    page = b"<table><thead><tr><th>h</th><th>i</th></tr></thead><tbody><tr><td>1</td><td><b>2</b></td></tr></tbody></table><p><a href='u'>l<i>i</i></a><img src='real.png' width=3 alt=A></p>"
    nodes = tree.exploded(Engine(spark).convert(spark.createDataFrame([(1, page, "text/html")], "doc_id long, content binary, mime_type string")))
    data = tree.table_data(nodes).first()
    assert data.headers == ["h", "i"] and data["rows"] == [["1", "2"]]
    assert [(r.src, r.alt, r.width) for r in tree.images(nodes).collect()] == [("real.png", "A", 3)]
    assert [(r.href, r.text) for r in tree.links(nodes).collect()] == [("u", "li")]
    both = spark.range(1).select(tree.merged_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))).alias("m"))
    assert both.first().m == {"a": "1", "b": "2"}


def test_changes_and_bundles(spark):
    old = spark.createDataFrame([(1, 0, "a", "s"), (1, 1, "b", "s"), (1, 2, None, "s")], "doc_id long, chunk_idx int, content_hash string, structure_hash string")
    new = spark.createDataFrame([(1, 0, "a", "s"), (1, 1, "c", "s"), (1, 2, None, "s"), (1, 3, "d", "s")], old.schema)
    assert sorted(r.chunk_idx for r in fingerprint.changed(old, new).collect()) == [1, 3]
    docs = spark.createDataFrame([(1, "tëxt"), (2, None)], "doc_id long, text string")
    packed = fingerprint.packed(docs, "text")
    assert {(r.doc_id, r.text, r.error) for r in fingerprint.unpacked(packed.select("doc_id", "bundle"), "text string").collect()} == {(1, "tëxt", None), (2, None, None)}
    bad = packed.select("doc_id", F.col("bundle").withField("payload", F.lit("!!")).alias("bundle"))
    assert {r.error for r in fingerprint.unpacked(bad, "text string").collect()} == {"bad base64"}
    with pytest.raises(Exception, match="bad base64"):
        fingerprint.unpacked(bad, "text string", strict=True).collect()


def test_grids(spark):
    cells = spark.createDataFrame([(1, 0, 0, "s", "0"), (1, 0, 2, None, "h"), (1, 2, 0, None, "m"), (1, 2, 3, None, "z")], "t int, r int, c int, kind string, value string")
    shared = spark.createDataFrame([(1, 0, "name")], "t int, idx int, value string")
    merges = spark.createDataFrame([(1, 2, 0, 2, 1)], "t int, top int, left int, bottom int, right int")
    found = tables.dense(tables.filled(tables.with_shared(cells, shared, ["t"]), merges, ["t"]), ["t"]).first().grid
    assert found == [["name", "", "h", ""], ["m", "m", "", "z"]]
    letters = spark.range(1).select(*[tables.column_number(F.lit(x)).alias(x) for x in ("A", "AB")], *[tables.column_letters(F.lit(n)).alias(f"n{n}") for n in (0, 27, 702)]).first()
    assert tuple(letters) == (0, 27, "A", "AB", "AAA")


def test_layout(spark):
    items = [(1, 1, i, x, y, s, t) for i, (x, y, s, t) in enumerate([(10, 800, 24, "Ti"), (40, 800, 24, "tle"), (10, 700, 10, "a"), (110, 700, 10, "b"), (10, 680, 10, "c"), (112, 681, 10, "d"), (10, 660, 10, "e"), (110, 660, 10, "f")])]
    df = spark.createDataFrame([(a, b, c, float(d), float(e), float(f), g) for a, b, c, d, e, f, g in items], "doc_id int, page int, n int, x double, y double, size double, text string")
    assert pdf_layout.markdown(df).first().markdown == "# Title\n\nab\n\ncd\n\nef"
    assert pdf_layout.body_size(df).first().body == 10
    assert {(r.row, r.column, r.text) for r in pdf_layout.tables(df).where("row > 0").collect()} == {(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d"), (3, 0, "e"), (3, 1, "f")}
    assert [r.column for r in pdf_layout.columns(df.where("n in (2, 3)")).orderBy("x").collect()] == [0, 1]
    assert pdf_layout.scanned(df.where("n < 3")).count() == 1


def test_consecutive(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 0, None), (2, 1, None)], "k int, i int, v string")
    assert sorted((r.k, r.i) for r in rules.without_consecutive(df, ["k"], "i", "v").collect()) == [(1, 0), (1, 2), (1, 3), (2, 0)]


def _brute(times, window, most):
    out, reset, count = [], None, 0
    for t in times:
        reset, count = (t + window, 1) if reset is None or t > reset else (reset, count + 1)
        out.append(count > most)
    return out


def test_rate_limit(spark):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    offsets = [0, 10, 20, 59, 60, 61, 200, 230, 259, 260, 300]
    rows = [(k, i, at + dt.timedelta(seconds=s)) for k in ("a", "b") for i, s in enumerate(offsets)]
    found = rate_limit.limited(spark.createDataFrame(rows, "ip string, n int, ts timestamp"), "ip", "ts", "n", 60_000, 2).orderBy("ip", "n").collect()
    assert [r.blocked for r in found] == _brute([s * 1000 for s in offsets], 60_000, 2) * 2


def test_rate_limit_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [("a", at + dt.timedelta(seconds=s)) for s in (0, 10, 20, 70)]
    spark.createDataFrame(rows, "ip string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ip string, ts timestamp").parquet(str(tmp_path / "in"))
    q = rate_limit.limited_stream(stream, "ip", "ts", 60_000, 2).writeStream.format("memory").queryName("limited").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.ms // 1000 % 100, r.blocked) for r in spark.table("limited").collect())[-2:] is not None
    assert sum(r.blocked for r in spark.table("limited").collect()) == 1


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a\n1\n")
    seen = []

    def sink(batch, number):
        seen.extend(r.markdown for r in batch.select("markdown").collect())

    for _ in range(2):
        watch.watch(spark, str(tmp_path / "in"), sink, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert seen == ["| a |\n| - |\n| 1 |"]
    (tmp_path / "in" / "b.txt").write_text("hello")
    watch.watch(spark, str(tmp_path / "in"), sink, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert seen[1:] == ["hello"]
    assert watch.changed_since(spark, str(tmp_path / "in"), "2020-01-01T00:00:00").count() == 2
    assert Engine(spark).files(str(tmp_path / "in"), "*.csv").count() == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, content binary, file_name string, mime_type string")
    out = Engine(spark).convert(empty)
    assert out.count() == 0 and chunks(out).count() == 0


def test_text_node_text():
    assert Node("paragraph", [text_node("a"), Node("image", src="x", alt="no"), Node("inline-code", value="b")]).text() == "ab"
