"""Formats by name and by content, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their MIME types. Where a type has several extensions, the last one is its name.
EXTENSIONS = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".ppt": "application/vnd.ms-powerpoint",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".csv": "text/csv",
    ".tsv": "text/tab-separated-values",
    ".json": "application/json",
    ".xml": "application/xml",
    ".html": "text/html",
    ".htm": "text/html",
    ".mhtml": "multipart/related",
    ".epub": "application/epub+zip",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".zip": "application/zip",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
    ".mp3": "audio/mpeg",
    ".wav": "audio/wav",
    ".m4a": "audio/mp4",
    ".ogg": "audio/ogg",
    ".flac": "audio/flac",
}
NAMES = {mime: ext for ext, mime in EXTENSIONS.items()}

# What formats begin with, in the order in which they are tried. (offset, hex digits) all hold.
SIGNATURES = (
    ("application/pdf", ((0, "25504446"),)),
    ("application/zip", ((0, "504B0304"),)),
    ("image/png", ((0, "89504E47"),)),
    ("image/jpeg", ((0, "FFD8FF"),)),
    ("image/webp", ((0, "52494646"), (8, "57454250"))),
    ("image/gif", ((0, "47494638"),)),
    ("image/bmp", ((0, "424D"),)),
    ("image/tiff", ((0, "49492A00"),)),
    ("image/tiff", ((0, "4D4D002A"),)),
    ("application/xml", "<?xml"),
    ("text/html", "<htm"),
    ("audio/mpeg", ((0, "494433"),)),
    ("audio/wav", ((0, "52494646"), (8, "57415645"))),
    ("audio/ogg", ((0, "4F676753"),)),
    ("audio/flac", ((0, "664C6143"),)),
)

# Bytes of an image that name it although no general signature does.
IMAGE_SIGNATURES = (*(s for s in SIGNATURES if s[0].startswith("image/")), ("image/x-icon", ((0, "00000100"),)), ("image/vnd.adobe.photoshop", ((0, "38425053"),)))

# Converters in the order in which they are asked: id, MIME types, extensions.
CONVERTERS = (
    ("pdf", ("application/pdf",), (".pdf",)),
    ("docx", (EXTENSIONS[".docx"],), (".docx",)),
    ("xlsx", (EXTENSIONS[".xlsx"], EXTENSIONS[".xls"]), (".xlsx", ".xls")),
    ("pptx", (EXTENSIONS[".pptx"],), (".pptx",)),
    ("html", ("text/html", "application/xhtml+xml"), (".html", ".htm", ".xhtml")),
    ("csv", ("text/csv", "text/tab-separated-values"), (".csv", ".tsv")),
    ("json", ("application/json", "application/x-ndjson"), (".json", ".jsonl")),
    ("xml", ("application/xml", "text/xml", "application/rss+xml", "application/atom+xml"), (".xml", ".rss", ".atom")),
    ("epub", ("application/epub+zip",), (".epub",)),
    ("audio", ("audio/mpeg", "audio/wav", "audio/mp4", "audio/ogg", "audio/flac"), (".mp3", ".wav", ".m4a", ".ogg", ".flac")),
    ("image", ("image/png", "image/jpeg", "image/webp", "image/gif", "image/tiff", "image/bmp"), (".png", ".jpg", ".jpeg", ".webp", ".gif", ".tiff", ".tif", ".bmp")),
    ("archive", ("application/zip", "application/x-zip-compressed"), (".zip",)),
    ("text", ("text/plain", "text/markdown"), (".txt", ".md", ".markdown")),
)

#: Bytes that a document or an unpacked archive may have.
SIZE_LIMIT = 50 * 1024 * 1024


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def extension_of(name: Column) -> Column:
    """The part from the last dot on, in lower case; null without a dot."""
    found = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(found != "", found)


def mime_of_extension(extension: Column) -> Column:
    ext = F.lower(extension)
    return F.try_element_at(_lookup(EXTENSIONS), F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext)))


def extension_of_mime(mime: Column) -> Column:
    return F.try_element_at(_lookup(NAMES), F.lower(mime))


def mime_of_name(name: Column) -> Column:
    return F.try_element_at(_lookup(EXTENSIONS), extension_of(name))


def is_supported_extension(extension: Column) -> Column:
    return F.coalesce(mime_of_extension(extension).isNotNull(), F.lit(False))


def is_supported_mime(mime: Column) -> Column:
    return F.coalesce(F.lower(mime).isin(*NAMES), F.lit(False))


def _begins(head: Column, rule) -> Column:
    if isinstance(rule, str):
        text = F.regexp_replace(F.decode(F.unhex(head), "ISO-8859-1"), r"^[\s\x{feff}\xEF\xBB\xBF]+", "")
        return (F.length(head) >= 10) & text.startswith(rule)
    tests = [F.substring(head, 2 * at + 1, len(digits)) == digits for at, digits in rule]
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def mime_of_content(content: Column, signatures=SIGNATURES) -> Column:
    """MIME type by the first bytes; null for fewer than four bytes and unknown ones."""
    head = F.hex(F.substring(content, 1, 256))
    found = F.when(F.length(head) < 8, F.lit(None).cast("string"))
    for mime, rule in signatures:
        found = found.when(_begins(head, rule), mime)
    return found


def mime(content: Column, name: Column) -> Column:
    """By content, or else by name."""
    return F.coalesce(mime_of_content(content), mime_of_name(name))


def converter(mime_type: Column, name: Column, content: Column, kinds=CONVERTERS) -> Column:
    """The converter of a document: a given type decides alone, then a name, then the content."""
    ext = extension_of(name)

    def choose(value: Column, which: int) -> Column:
        out = None
        for kind in kinds:
            test = value.isin(*kind[which])
            out = F.when(test, kind[0]) if out is None else out.when(test, kind[0])
        return out if out is not None else F.lit(None).cast("string")

    by_mime, by_ext = choose(F.lower(mime_type), 1), choose(ext, 2)
    return F.when(mime_type.isNotNull(), by_mime).when(name.isNotNull() & ext.isNotNull(), by_ext).otherwise(choose(mime_of_content(content), 1))


def can_convert(converter_id: str, mime_type: Column, name: Column, kinds=CONVERTERS) -> Column:
    """Whether one converter takes a document: its type or its extension is enough."""
    mimes, extensions = next((k[1:] for k in kinds if k[0] == converter_id), ((), ()))
    tests = [F.lower(mime_type).isin(*mimes), extension_of(name).isin(*extensions)]
    return F.coalesce(tests[0], F.lit(False)) | F.coalesce(tests[1], F.lit(False))


def within_size(length: Column, limit: int = SIZE_LIMIT) -> Column:
    return F.coalesce(length <= limit, F.lit(True))


def allowed_type(name: Column, allowed: list[str]) -> Column:
    """Whether the last extension, without its dot, is in a list."""
    own = F.lower(F.element_at(F.split(name, r"\."), -1))
    return own.isin(*[x.lower().lstrip(".") for x in allowed])


def png_size(content: Column) -> Column:
    """(width, height) of a PNG, from its header."""

    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")

    return F.when(F.hex(F.substring(content, 1, 4)) == "89504E47", F.struct(number(17).alias("width"), number(21).alias("height")))


def data_url(content: Column, mime_type: Column) -> Column:
    return F.concat(F.lit("data:"), mime_type, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))
