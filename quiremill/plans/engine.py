"""The engine: documents in, results out, as DataFrames.

Dispatch is one CASE column in the JVM. Parsing crosses to Python once, in batches, and
gives the tree, its rendering, its metadata, any error and, where they are asked for,
the chunks of each document. A document that fails is a row with an error, unless
FAILFAST is asked for.
"""

from __future__ import annotations

import contextlib
import functools
import os
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol, TextIO

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quiremill.functions import formats
from quiremill.operators import pdf_layout, render, rules
from quiremill.operators.chunk import CHUNKS, Options, chunk_rows, exploded_chunks, named_chunks, strategy_of
from quiremill.operators.chunk import chunks as chunk_table
from quiremill.operators.tree import NODES, Node
from quiremill.sources import feeds, html, media, packages, tabular


class ConversionError(Exception):
    """A document could not be converted."""


class UnsupportedFormat(ConversionError):
    """No converter takes a document."""


class FileTooLarge(ConversionError):
    """A document has more bytes than the limit."""


class PluginError(Exception):
    """A plugin's name is taken or unknown."""


#: Reads a PDF: for each positioned text (page from 1, x, y, size, text).
ReadPdf = Callable[[bytes], list[tuple[int, float, float, float, str]]]
#: Reads an image by its bytes and type, or a recording by its bytes and name.
ReadImage = Callable[[bytes, str], str]
ReadAudio = Callable[[bytes, "str | None"], str]


#: Nested calls that a document may need; the interpreter's frames are on the heap, so a page of some thousand nested
#: marks is no danger to the worker.
DEEPEST = 60_000


def _allow_deep_trees() -> None:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))


Parse = Callable[..., tuple[Node, dict[str, str]]]


class Plugin(Protocol):
    """Converters and middleware under one name."""

    name: str
    converters: dict[str, Parse]

    def initialize(self, engine: Engine) -> None: ...
    def destroy(self, engine: Engine) -> None: ...


def _pdf(content: bytes, name: str | None = None) -> tuple[Node, dict[str, str]]:
    """Without an extractor a PDF is a placeholder with a warning; it never fails."""
    from quiremill.operators.tree import paragraph

    return Node("document", [paragraph("[PDF content could not be extracted]")]), {"warning": "no PDF text extractor is configured"}


def default_converters() -> dict[str, Parse]:
    return {
        "pdf": _pdf, "docx": packages.parse_docx, "xlsx": packages.parse_xlsx, "pptx": packages.parse_pptx, "html": html.parse,
        "csv": tabular.parse_csv, "json": tabular.parse_json, "xml": feeds.parse, "epub": packages.parse_epub,
        "audio": media.parse_audio, "image": media.parse_image, "archive": packages.parse_archive, "text": media.parse_text,
    }


#: Markdown as the sources write it: pages and books set tables apart.
_MARKDOWN = {"html": html.markdown, "epub": html.markdown}
SHEETS = render.markdown_renderer(render.SHEET)

RESULT = f"doc_id {{key}}, file_name string, converter_id string, title string, markdown string, metadata map<string,string>, nodes {NODES}, warnings array<string>, error string, input_size long, output_size long"


@dataclass
class Engine:
    """A registry of converters, providers and middleware, and what runs over tables of documents."""

    spark: SparkSession
    converters: dict[str, Parse] = field(default_factory=default_converters)
    #: (id, MIME types, extensions) in the order in which they are asked; converters that are registered come first.
    kinds: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = field(default_factory=lambda: list(formats.CONVERTERS))
    read_pdf: ReadPdf | None = None
    recognise: ReadImage | None = None
    transcribe: ReadAudio | None = None
    before: list[tuple[int, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    after: list[tuple[int, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    plugins: dict[str, Plugin] = field(default_factory=dict)

    def register_converter(self, name: str, parse: Parse, mime_types: Iterable[str] = (), extensions: Iterable[str] = ()) -> None:
        """Add a converter, or replace the one of that name; without types and extensions it keeps those that the name has."""
        self.converters[name] = parse
        mimes = tuple(m.lower() for m in mime_types)
        dotted = tuple(e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions)
        if mimes or dotted:
            self.kinds = [(name, mimes, dotted), *(k for k in self.kinds if k[0] != name)]

    def unregister_converter(self, name: str) -> None:
        """Take a converter away; a built-in one of that name comes back where another had replaced it."""
        built_in = default_converters().get(name)
        replaced = built_in is not None and self.converters.get(name) is not built_in
        self.converters.pop(name, None)
        self.kinds = [k for k in self.kinds if k[0] != name]
        if replaced:
            self.converters[name] = built_in
            self.kinds += [k for k in formats.CONVERTERS if k[0] == name]

    def converter_ids(self) -> list[str]:
        return [k[0] for k in self.kinds if k[0] in self.converters]

    def converter_for_mime(self, mime_type: str) -> str | None:
        return next((k[0] for k in self.kinds if mime_type.lower() in k[1]), None)

    def converter_for_extension(self, extension: str) -> str | None:
        ext = extension.lower() if extension.startswith(".") else f".{extension.lower()}"
        return next((k[0] for k in self.kinds if ext in k[2]), None)

    def use(self, plugin: Plugin) -> None:
        """``plugin.formats`` may name the types and extensions of its converters: {name: (MIME types, extensions)}."""
        if plugin.name in self.plugins:
            raise PluginError(f"a plugin named {plugin.name} is in use")
        self.plugins[plugin.name] = plugin
        for name, parse in plugin.converters.items():
            self.register_converter(name, parse, *getattr(plugin, "formats", {}).get(name, ()))
        plugin.initialize(self)

    def remove(self, name: str) -> None:
        if name not in self.plugins:
            raise PluginError(f"no plugin named {name} is in use")
        plugin = self.plugins.pop(name)
        for converter in plugin.converters:
            self.unregister_converter(converter)
        plugin.destroy(self)

    def middleware(self, when: str, step: Callable[[DataFrame], DataFrame], priority: int = 0) -> None:
        """A step over the whole table before or after parsing, in ascending order of priority."""
        (self.before if when == "before" else self.after).append((priority, step))

    def files(self, path: str, pattern: str | None = None, recursive: bool = True, limit: int = formats.SIZE_LIMIT) -> DataFrame:
        """Documents of a folder: (doc_id, file_name, mime_type, content, error); too large ones are not read, and say so."""
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        found = reader.load(path)
        name = F.element_at(F.split("path", r"[/\\]"), -1)
        own = [F.col("path").alias("doc_id"), name.alias("file_name"), formats.mime_of_name(name).alias("mime_type")]
        none = F.lit(None).cast("string").alias("error")
        said = F.concat(F.lit("FileTooLarge: "), "length", F.lit(f" bytes are over the limit of {limit}")).alias("error")
        read = found.where(F.col("length") <= limit).select(*own, "content", none)
        return read.unionByName(found.where(F.col("length") > limit).select(*own, F.lit(None).cast("binary").alias("content"), said))

    def _parser(self, which: str) -> Parse:
        """A converter, with the provider that it reads with."""
        parse = self.converters[which]
        if parse is media.parse_image and self.recognise:
            return functools.partial(parse, recognise=self.recognise)
        if parse is media.parse_audio and self.transcribe:
            return functools.partial(parse, transcribe=self.transcribe)
        return parse

    def convert(
        self, documents: DataFrame, mode: str = "PERMISSIVE", optimize: bool = False, rule_names: list[str] | None = None, chunking: Options | None = None
    ) -> DataFrame:
        """``documents``: doc_id and content, and optionally file_name, mime_type and error; the result has a row for each.

        A row with an error stays one. With ``chunking`` the result has a column ``chunks`` of the same pass,
        which :meth:`chunks` lays out as rows. PDFs are read by :meth:`pdf_results` where ``read_pdf`` is set.
        """
        for _, step in sorted(self.before, key=lambda x: x[0]):
            documents = step(documents)
        names = documents.columns
        base = documents.select(
            "doc_id",
            F.col("content"),
            (F.col("file_name") if "file_name" in names else F.lit(None).cast("string")).alias("file_name"),
            (F.col("mime_type") if "mime_type" in names else F.lit(None).cast("string")).alias("mime_type"),
            (F.col("error") if "error" in names else F.lit(None).cast("string")).alias("error"),
        )
        base = base.withColumn("converter_id", formats.converter(F.col("mime_type"), F.col("file_name"), F.col("content"), self.kinds))
        converters, key = {name: self._parser(name) for name in self.converters}, base.schema["doc_id"].dataType.simpleString()

        pack = strategy_of(chunking) if chunking else None  # workers know only the strategies of their own import

        def one(content: bytes | None, name: str | None, mime: str | None, which: str | None, error: str | None) -> dict:
            out = {"title": None, "markdown": None, "metadata": None, "nodes": None, "warnings": [], "error": error, "output_size": None}
            if chunking:
                out["chunks"] = None
            if error is not None:
                if mode.upper() == "FAILFAST":
                    raise ConversionError(error)
                return out
            try:
                if which not in converters:
                    raise UnsupportedFormat(f"no converter takes {name or mime or 'this document'}")
                parse = converters[which]
                tree, meta = parse(content or b"", name, mime) if which == "csv" else parse(content or b"", name)
                if optimize:
                    tree = rules.optimize(tree, rule_names)
                text = _MARKDOWN.get(which, lambda t: render.settled(SHEETS(t)))(tree)
                warning = meta.pop("warning", None)
                out |= {"title": meta.get("title"), "markdown": text, "metadata": dict(meta), "nodes": tree.rows(), "output_size": len(text)}
                out["warnings"] = [warning] if warning else []
                if chunking:
                    out["chunks"] = chunk_rows(tree, chunking, pack)
            except Exception as e:
                if mode.upper() == "FAILFAST":
                    raise
                out["error"] = f"{type(e).__name__}: {e}"
            return out

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            _allow_deep_trees()
            columns = [c.split(" ")[0] for c in RESULT.replace(NODES, "x").replace("map<string,string>", "x").split(", ")]
            columns += ["chunks"] if chunking else []
            for batch in batches:
                made = []
                for k, content, name, mime, which, error in zip(batch.doc_id, batch.content, batch.file_name, batch.mime_type, batch.converter_id, batch.error):
                    row = {"doc_id": k, "file_name": name, "converter_id": which, "input_size": len(content) if content is not None else 0}
                    made.append(row | one(content, name, mime, which, error))
                yield pd.DataFrame(made, columns=columns)

        result = base.mapInPandas(run, RESULT.format(key=key) + (f", chunks {CHUNKS}" if chunking else ""))
        if chunking:
            result = named_chunks(result, chunking)
        for _, step in sorted(self.after, key=lambda x: x[0]):
            result = step(result)
        return result

    def chunks(self, results: DataFrame, options: Options | None = None) -> DataFrame:
        """One row for each chunk; those made while converting are laid out without another pass."""
        if options is None and "chunks" in results.columns:
            return exploded_chunks(results.where("error is null"))
        return chunk_table(results.where("error is null"), options)

    def pdf_items(self, documents: DataFrame) -> DataFrame:
        """Positioned texts of PDFs by ``read_pdf``: (doc_id, page, n, x, y, size, text); those that cannot be read have none."""
        if self.read_pdf is None:
            raise ConversionError("no PDF reader is set")
        read, key = self.read_pdf, documents.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            for batch in batches:
                found = []
                for k, content in zip(batch.doc_id, batch.content):
                    try:
                        found += [(k, page, n, float(x), float(y), float(size), text) for n, (page, x, y, size, text) in enumerate(read(content or b""))]
                    except Exception:  # noqa: S112  a PDF that cannot be read is a placeholder, not a failed job
                        continue
                yield pd.DataFrame(found, columns=["doc_id", "page", "n", "x", "y", "size", "text"])

        return documents.select("doc_id", "content").mapInPandas(run, f"doc_id {key}, page int, n int, x double, y double, size double, text string")

    def pdf_results(self, documents: DataFrame) -> DataFrame:
        """(doc_id, markdown) of PDFs by their layout: headings by size, lines by place, tables by columns; null where nothing was read."""
        found = pdf_layout.markdown(self.pdf_items(documents))
        return documents.select("doc_id").join(found, "doc_id", "left")

    def rendered(self, results: DataFrame, output: str = "markdown", key: str = "doc_id") -> DataFrame:
        """(key, output) by a renderer's name."""
        kind, write = results.schema[key].dataType.simpleString(), render.renderer_of(output)

        def run(batches):
            import pandas as pd

            from quiremill.operators.tree import from_rows

            _allow_deep_trees()
            for batch in batches:
                trees = (from_rows(n) if n is not None else None for n in batch["nodes"])
                yield pd.DataFrame({key: batch[key], "output": [write(t or Node("document")) for t in trees]})

        return results.select(key, "nodes").mapInPandas(run, f"{key} {kind}, output string")

    def observed(self, results: DataFrame, name: str = "conversion") -> tuple[DataFrame, Observation]:
        """The results, and what is known of their progress once an action has read them: total and failed."""
        seen = Observation(name)
        return results.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNotNull()).alias("failed")), seen

    @contextlib.contextmanager
    def tagged(self, tag: str) -> Iterator[None]:
        """Jobs that start within this context bear a tag, by which :meth:`cancel` ends them from another thread."""
        self.spark.addTag(tag)
        try:
            yield
        finally:
            self.spark.removeTag(tag)

    def cancel(self, tag: str) -> None:
        self.spark.interruptTag(tag)

    def summary(self, results: DataFrame) -> DataFrame:
        """Counts of what was and what was not converted, by converter."""
        return results.groupBy("converter_id").agg(
            F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed")
        )

    def write_markdown(self, results: DataFrame, root: str, target: str) -> None:
        """Rows of (path, markdown) below a target, by relative path and with the extension changed."""
        _mirrored(results, root).write.mode("overwrite").parquet(target)

    def write_files(self, results: DataFrame, root: str, target: str) -> None:
        """One .md file for each document below a folder that all executors share, at its path relative to ``root``.

        A file is written beside its place and then renamed, so that a task that runs again leaves whole files.
        """

        def write(rows: Iterator) -> None:
            for row in rows:
                place = os.path.normpath(os.path.join(target, row.path.lstrip("/")))
                if not place.startswith(os.path.join(os.path.normpath(target), "")):
                    raise ConversionError(f"{row.path} leaves the folder")
                os.makedirs(os.path.dirname(place), exist_ok=True)
                handle, draft = tempfile.mkstemp(dir=os.path.dirname(place))
                with os.fdopen(handle, "w", encoding="utf-8") as file:
                    file.write(row.markdown)
                os.replace(draft, place)

        _mirrored(results, root).foreachPartition(write)

    def write_stream(self, results: DataFrame, out: TextIO) -> None:
        """The Markdown of all documents to a text stream of the driver, one partition at a time."""
        for row in results.where("error is null").select("markdown").toLocalIterator():
            out.write(row.markdown + "\n")


def _mirrored(results: DataFrame, root: str) -> DataFrame:
    prefix = r"\Q" + root.rstrip("/") + r"/\E"
    path = F.regexp_replace(F.regexp_replace(F.col("doc_id").cast("string"), f"^.*?{prefix}", ""), r"\.[^./]*$", "")
    return results.where("error is null").select(F.concat(path, F.lit(".md")).alias("path"), "markdown")


def default_engine(spark: SparkSession) -> Engine:
    return Engine(spark)
