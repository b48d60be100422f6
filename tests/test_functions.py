"""Formats and text functions on small tables."""

import pytest
from pyspark.sql import functions as F

from quiremill.functions import formats
from quiremill.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "data, mime",
    [
        (b"%PDF-1.7", "application/pdf"), (b"PK\x03\x04....", "application/zip"), (b"\x89PNG\r\n", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"),
        (b"RIFF....WEBPVP8 ", "image/webp"), (b"RIFF....WAVEfmt ", "audio/wav"), (b"GIF89a", "image/gif"), (b"BM....", "image/bmp"), (b"II*\x00", "image/tiff"),
        (b"<?xml version", "application/xml"), (b"  <html><body>", "text/html"), (b"<!DOCTYPE html>", None), (b"ID3\x03", "audio/mpeg"),
        (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"), (b"abc", None), (b"abcdef", None),
    ],
)
def test_content_types(spark, data, mime):
    assert one(spark, formats.mime_of_content(F.col("c")), c=data) == mime


@pytest.mark.parametrize("name, mime", [("a.PDF", "application/pdf"), ("x/y.tar.tsv", "text/tab-separated-values"), ("none", None), ("a.xyz", None)])
def test_names(spark, name, mime):
    assert one(spark, formats.mime_of_name(F.col("n")), n=name) == mime


def test_mime_names_are_last(spark):
    assert [one(spark, formats.extension_of_mime(F.col("m")), m=m) for m in ("text/html", "image/jpeg", "image/tiff", "text/markdown")] == [".htm", ".jpeg", ".tif", ".markdown"]


@pytest.mark.parametrize(
    "mime, name, data, converter",
    [
        ("text/csv", "a.json", b"", "csv"), (None, "a.json", b"%PDF-", "json"), (None, None, b"%PDF-", "pdf"), ("application/zip", None, b"", "archive"),
        ("foo/bar", "a.pdf", b"%PDF-", None), (None, "a.unknown", b"%PDF-", None),
    ],
)
def test_dispatch(spark, mime, name, data, converter):
    df = spark.createDataFrame([(mime, name, data)], "m string, n string, c binary")
    assert df.select(formats.converter(F.col("m"), F.col("n"), F.col("c")).alias("r")).first().r == converter


def test_predicates(spark):
    assert one(spark, formats.allowed_type(F.col("n"), [".PDF", "csv"]), n="x.y.pdf")
    assert not one(spark, formats.allowed_type(F.col("n"), ["csv"]), n="x.pdf")
    assert not one(spark, formats.within_size(F.lit(formats.SIZE_LIMIT + 1)))
    assert one(spark, T.is_footnote(F.lit("my-footnote"), F.lit(None).cast("string")))
    assert one(spark, T.is_footnote(F.lit(""), F.lit("fn12")))
    assert not one(spark, T.is_safe_url(F.lit("java\nscript:alert(1)")))
    assert one(spark, T.is_decorative(F.lit("data:image/png;base64,AA")))
    assert one(spark, T.is_boilerplate(F.lit("Page 3 of 9")))


def test_tokens(spark):
    assert one(spark, T.token_count(F.lit("hello, wonderful world!"))) == 2 + 1 + 3 + 2 + 1
    assert one(spark, T.token_count(F.lit("  "))) == 0
    assert one(spark, T.token_count(F.lit("日本語のテキスト"), "gpt-4o")) == 8
    assert one(spark, T.fast_token_ids(F.lit("abcdefgh x"))) == [0, 1, 2, 0]
    assert one(spark, T.word_count(F.lit("a b  c\n"))) == 3


def test_hashes(spark):
    def rolling(text, seed, factor):
        h = seed
        for c in text:
            h = (h * factor + ord(c) + 2**31) % 2**32 - 2**31
        return f"djb2:{abs(h):08x}"

    assert one(spark, T.content_hash(F.lit("  Héllo   World "))) == rolling("héllo world", 5381, 33)
    assert one(spark, T.bundle_hash(F.lit('{"a":1}'))) == rolling('{"a":1}', 0, 31)


@pytest.mark.parametrize("size, overlap", [(5, 2), (5, 0), (5, 9), (1, 3), (100, 50)])
def test_windows_end_and_cover(spark, size, overlap):
    words = [f"w{i}" for i in range(23)]
    found = one(spark, T.word_windows(F.lit(" ".join(words)), size, overlap))
    step = size - min(overlap, size - 1)
    assert [w[0] for w in found] == [f"w{i * step}" for i in range(len(found))]
    assert found[-1][-1] == "w22" and all(len(w) == size for w in found[:-1])
    assert one(spark, T.word_windows(F.lit(" "), size, overlap)) == []


def test_markup(spark):
    text = "# Title\n\n**b** and *i* `c`\n> q\n- x\n\n\n\n[t](u)"
    assert one(spark, T.markdown_to_plain(F.lit(text))) == "Title\n\nb and i c\nq\n• x\n\nt"
    assert one(spark, T.markdown_to_html(F.lit("# A\n\nfoo\nbar"))) == "<h1>A</h1>\n<p>\nfoo\nbar\n</p>"
    assert one(spark, T.viewer_html(F.lit("## A <b>\n**x**"))) == "<h2>A &lt;b&gt;</h2><br/><strong>x</strong>"
    assert one(spark, T.markdown_title(F.lit("x\n# The title \n"))) == "The title"
    assert one(spark, T.markdown_words(F.lit("# a\n```\nx y\n```\nb"))) == 2
    assert one(spark, T.sentences(F.lit("One. Two! Three? four"))) == ["One.", "Two!", "Three?", "four"]


def test_sizes_and_urls(spark):
    assert [one(spark, T.human_size(F.lit(n))) for n in (0, 1023, 1024, 1536, 5 * 1024**2, 3 * 1024**3)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB"]
    assert one(spark, T.truncated(F.lit("abcdefgh"), 5)) == "ab..."
    assert one(spark, formats.data_url(F.encode(F.lit("x" * 100), "UTF-8"), F.lit("text/plain"))).count("\n") == 0
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert tuple(one(spark, formats.png_size(F.col("c")), c=png)) == (640, 480)
