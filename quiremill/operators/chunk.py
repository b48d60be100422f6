"""Chunks for retrieval: blocks of a tree, packed in order by one of four strategies.

Packing resets at every flush, which no window frame expresses, so each document is
folded on its own in Arrow batches; documents never meet, and nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiremill.functions import text as T
from quiremill.operators.tree import NODES, Node, from_rows, paragraph

CHUNK = (
    "struct<chunk_idx:int,content:string,heading_path:array<string>,page:int,token_count:int,start_index:int,end_index:int,"
    "overlap_end:int,content_type:string,types:string>"
)
_RUN = re.compile(r"[A-Za-z0-9_']+|[^A-Za-z0-9_\s]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
# What a node's type says about the chunk that holds it.
KINDS = {
    "table": "table", "code": "code", "list": "list", "list-item": "list", "callout": "callout", "heading": "heading-only",
    "paragraph": "narrative", "text": "narrative",
}


def token_estimate(text: str) -> int:
    return sum(max(1, math.ceil(len(x) / 3.5)) for x in _RUN.findall(text)) if text.strip() else 0


@dataclass
class Options:
    strategy: str = "heading"
    max_tokens: int = 512
    overlap: int | None = None
    tokenizer: Callable[[str], int] = token_estimate


@dataclass
class Chunk:
    content: str
    path: list[str | None]
    tokens: int
    start: int = 0
    page: int | None = None
    overlap_end: int | None = None
    nodes: list[Node] = field(default_factory=list)


def classify(nodes: list[Node]) -> str:
    """The kind that the nodes of a chunk share, "mixed" for several; prose counts only alone."""
    kinds = {KINDS[n.type] for top in nodes for n in top.walk() if n.type in KINDS}
    if len(kinds) > 1:
        kinds.discard("narrative")
    return next(iter(kinds)) if len(kinds) == 1 else "mixed" if kinds else "narrative"


def _made(nodes: list[Node], path: list[str | None], o: Options, start: int = 0, page: int | None = None) -> Chunk | None:
    texts = [x for x in (n.text() for n in nodes) if x]
    if not texts:
        return None
    content = "\n\n".join(texts)
    return Chunk(content, list(path), o.tokenizer(content), start, page, None, list(nodes))


def _tail(text: str, count: int) -> str:
    return " ".join(text.split()[-count:]) if count > 0 else ""


def _entered(path: list[str | None], node: Node) -> list[str | None]:
    """The path after a heading; levels that were left out stay empty."""
    level = node.level or 1
    return (path + [None] * level)[: level - 1] + [node.text()]


def _packed(nodes: list[Node], most: int) -> Iterator[list[Node]]:
    """Nodes in order, as many as fit by their words; one that is too long stands alone."""
    held: list[Node] = []
    size = 0
    for node in nodes:
        words = node.words()
        if held and size + words > most:
            yield held
            held, size = [], 0
        held.append(node)
        size += words
    if held:
        yield held


def _sentences(node: Node, most: int) -> Iterator[Node]:
    """A long paragraph cut at sentence ends."""
    held: list[str] = []
    size = 0
    for sentence in _SENTENCE.split(node.text()):
        words = len(sentence.split())
        if held and size + words > most:
            yield paragraph(" ".join(held))
            held, size = [], 0
        held.append(sentence)
        size += words
    if held:
        yield paragraph(" ".join(held))


def fixed(tree: Node, o: Options) -> list[Chunk]:
    words, most = tree.text().split(), o.max_tokens
    step = most - min(max(50 if o.overlap is None else o.overlap, 0), max(1, most) - 1)
    out, start = [], 0
    for at in range(0, len(words), step):
        part = words[at : at + most]
        out.append(Chunk(" ".join(part), [], len(part), start, None, None, [paragraph(" ".join(part))]))
        start += len(part)
        if at + most >= len(words):
            break
    return out


def by_heading(tree: Node, o: Options) -> list[Chunk]:
    out: list[Chunk] = []
    path: list[str | None] = []
    held: list[Node] = []
    size = offset = start = 0
    carried = ""

    def flush() -> None:
        nonlocal held, size, start, carried
        if held:
            nodes = [paragraph(carried), *held] if carried else held
            whole = _made(nodes, path, o, start)
            if whole and whole.tokens > o.max_tokens:
                single = [x for n in held for x in (_sentences(n, o.max_tokens) if n.type == "paragraph" and n.words() > o.max_tokens else [n])]
                at = start
                for group in _packed(single, o.max_tokens):
                    if part := _made(group, path, o, at):
                        out.append(part)
                    at += sum(n.words() for n in group)
            elif whole:
                whole.overlap_end = len(carried) or None
                out.append(whole)
            carried = _tail(" ".join(n.text() for n in held), o.overlap or 0)
        held, size, start = [], 0, offset

    for node in tree.blocks():
        if node.type == "heading":
            flush()
            path = _entered(path, node)
            continue
        held.append(node)
        size += node.words()
        offset += node.words()
        if size >= o.max_tokens:
            flush()
    flush()
    return out


def by_page(tree: Node, o: Options) -> list[Chunk]:
    out: list[Chunk] = []
    path: list[str | None] = []
    held: list[Node] = []
    page: int | None = None
    offset = 0

    def flush() -> None:
        nonlocal held, offset
        for group in _packed(held, o.max_tokens):
            if part := _made(group, path, o, offset, page):
                out.append(part)
            offset += sum(n.words() for n in group)
        held = []

    for node in tree.blocks():
        if node.type == "page-break":
            flush()
            number = node.attrs.get("pageNumber")
            page = int(number) if number else (page or 0) + 1
            continue
        if node.type == "heading":
            path = _entered(path, node)
        held.append(node)
        if sum(n.words() for n in held) >= o.max_tokens:
            flush()
    flush()
    return out


def semantic(tree: Node, o: Options) -> list[Chunk]:
    overlap = 50 if o.overlap is None else o.overlap
    groups: list[list[Node]] = [[]]
    for node in tree.blocks():
        if node.type == "page-break":
            continue
        if node.type in ("heading", "thematic-break", "horizontal-rule"):
            groups.append([])
        if node.type not in ("thematic-break", "horizontal-rule"):
            groups[-1].append(node)

    def titled(nodes: list[Node]) -> list[str | None]:
        path: list[str | None] = []
        for n in nodes:
            path = _entered(path, n) if n.type == "heading" else path
        return path

    out: list[Chunk] = []
    carried = ""
    for group in filter(None, groups):
        size = sum(n.words() for n in group)
        nodes = [paragraph(carried), *group] if carried else group
        if size <= o.max_tokens:
            if part := _made(nodes, titled(nodes), o):
                out.append(part)
            carried = _tail(nodes[-1].text(), overlap)
            continue
        held: list[Node] = []
        used = 0
        parts = []
        for n in nodes:
            if held and used + n.words() > o.max_tokens:
                parts.append(held)
                again = _tail(held[-1].text(), overlap)
                held, used = ([paragraph(again)], overlap) if again else ([], 0)
            held.append(n)
            used += n.words()
        parts.append(held)
        made = [x for x in (_made(p, titled(p), o) for p in parts) if x]
        out += made
        carried = _tail(made[-1].content, overlap) if made else carried
    return out


STRATEGIES: dict[str, Callable[[Node, Options], list[Chunk]]] = {"fixed": fixed, "heading": by_heading, "page": by_page, "semantic": semantic}


def register_strategy(name: str, strategy: Callable[[Node, Options], list[Chunk]]) -> None:
    STRATEGIES[name] = strategy


def strategy_of(options: Options) -> Callable[[Node, Options], list[Chunk]]:
    if options.strategy not in STRATEGIES:
        raise ValueError(f"no chunking strategy is named {options.strategy}")
    return STRATEGIES[options.strategy]


def chunk_tree(tree: Node, options: Options | None = None) -> list[Chunk]:
    o = options or Options()
    return strategy_of(o)(tree, o)


def chunk_rows(tree: Node | None, options: Options, pack: Callable[[Node, Options], list[Chunk]]) -> list[dict]:
    if tree is None:
        return []
    return [
        {
            "chunk_idx": i, "content": c.content, "heading_path": c.path, "page": c.page, "token_count": c.tokens, "start_index": c.start,
            "end_index": c.start + c.tokens, "overlap_end": c.overlap_end, "content_type": classify(c.nodes),
            "types": ",".join(["document", *(n.type for top in c.nodes for n in top.walk())]),
        }
        for i, c in enumerate(pack(tree, options))
    ]


def chunks(parsed: DataFrame, options: Options | None = None, key: str = "doc_id", nodes: str = "nodes") -> DataFrame:
    """One row for each chunk of a table with a nodes column; ids follow from the key, the place and the content."""
    o = options or Options()
    name, pack = o.strategy, strategy_of(o)  # looked up here: workers know only the strategies of their own import
    kind = parsed.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = [{key: k, **row} for k, n in zip(batch[key], batch[nodes]) for row in chunk_rows(from_rows(n) if n is not None else None, o, pack)]
            yield pd.DataFrame(out, columns=[key, *_FIELDS])

    _FIELDS = [f.split(":")[0] for f in CHUNK[7:-1].split(",")]
    made = parsed.select(key, nodes).mapInPandas(run, f"{key} {kind}, " + ", ".join(x.replace(":", " ", 1) for x in CHUNK[7:-1].split(",")))
    return made.withColumn("chunk_id", _chunk_id(F.col(key), name, F.col("chunk_idx"), F.col("content")))


def _chunk_id(key: Column, strategy: str, index: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", key.cast("string"), F.lit(strategy), index.cast("string"), content), 256)


def named_chunks(parsed: DataFrame, options: Options, key: str = "doc_id") -> DataFrame:
    """Give the chunks of a ``chunks`` column their ids."""
    one = lambda c: c.withField("chunk_id", _chunk_id(F.col(key), options.strategy, c["chunk_idx"], c["content"]))
    return parsed.withColumn("chunks", F.transform("chunks", one))


def exploded_chunks(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each chunk of a ``chunks`` column."""
    return parsed.select(key, F.explode("chunks").alias("_c")).select(key, "_c.*")


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The fixed strategy over a text column, without leaving the JVM: (key, chunk_idx, content, token_count, start_index)."""
    windows = docs.select(key, F.posexplode(T.word_windows(F.col(text), size, overlap)).alias("chunk_idx", "w"))
    count = F.size("w").cast("long")
    # All windows before the last are full, so a window's start needs no running sum.
    return windows.select(key, "chunk_idx", F.array_join("w", " ").alias("content"), count.alias("token_count"), (F.col("chunk_idx").cast("long") * size).alias("start_index"))


CHUNKS = f"array<{CHUNK}>"

__all__ = [
    "CHUNKS", "NODES", "Chunk", "Options", "chunk_rows", "chunk_tree", "chunks", "classify", "exploded_chunks", "fixed_chunks", "named_chunks", "register_strategy", "strategy_of",
]
