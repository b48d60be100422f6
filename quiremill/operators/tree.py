"""Document trees, in memory while one document is parsed and as nested-set rows in tables.

A row has its place in document order, its parent, its depth and the last place of its
subtree, so that a subtree is a range of places and tree operations are range filters,
windows and ordered aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "struct<node_id:int,parent_id:int,ordinal:int,depth:int,last_desc:int,type:string,level:int,value:string,attrs:map<string,string>>"
NODES = f"array<{NODE}>"

#: Types whose value is text of the document.
LEAVES = ("text", "code", "inline-code", "math", "html", "raw")
#: Types that a chunk is made of.
BLOCKS = ("heading", "paragraph", "table", "list", "code", "blockquote", "thematic-break", "horizontal-rule", "page-break")


class Node:
    """One node: a type, a value or children, a heading's level, and attributes as strings."""

    __slots__ = ("attrs", "children", "level", "type", "value")

    def __init__(self, type: str, children: Iterable[Node] = (), value: str | None = None, level: int | None = None, **attrs):
        self.type, self.value, self.level = type, value, level
        self.children = list(children)
        self.attrs = {k: str(v) for k, v in attrs.items() if v is not None}

    def text(self) -> str:
        if self.type in LEAVES and self.value is not None:
            return self.value
        return "".join(c.text() for c in self.children)

    def words(self) -> int:
        return len(self.text().split())

    def walk(self, visit: Callable[[Node], bool | None] | None = None) -> Iterator[Node]:
        """Nodes in document order; below a node for which ``visit`` says False nothing is walked."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if visit is None or visit(node) is not False:
                stack.extend(reversed(node.children))

    def find(self, type: str) -> list[Node]:
        return [n for n in self.walk() if n.type == type]

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=-1)

    def blocks(self) -> list[Node]:
        """Blocks in order, each once; documents, sections and other containers are opened."""
        if self.type in BLOCKS:
            return [self]
        return [b for c in self.children for b in c.blocks()]

    def rows(self) -> list[dict]:
        out: list[dict] = []

        def add(node: Node, parent: int | None, ordinal: int, depth: int) -> int:
            at = len(out)
            row = {
                "node_id": at, "parent_id": parent, "ordinal": ordinal, "depth": depth, "last_desc": at,
                "type": node.type, "level": node.level, "value": node.value, "attrs": dict(node.attrs),
            }
            out.append(row)
            for i, child in enumerate(node.children):
                row["last_desc"] = add(child, at, i, depth + 1)
            return row["last_desc"]

        add(self, None, 0, 0)
        return out


def text_node(value: str) -> Node:
    return Node("text", value=value)


def paragraph(text: str) -> Node:
    return Node("paragraph", [text_node(text)])


def heading(level: int, text: str, **attrs) -> Node:
    return Node("heading", [text_node(text)], level=level, **attrs)


def table(rows: list[list[str]], header: bool = True, **attrs) -> Node:
    made = [
        Node("table-row", [Node("table-cell", [text_node(x)]) for x in row], isHeader="true" if header and i == 0 else None)
        for i, row in enumerate(rows)
    ]
    return Node("table", made, **attrs)


def from_rows(rows: Iterable) -> Node | None:
    """The tree of nested-set rows, in any order; None without rows."""
    def whole(x) -> int | None:
        return None if x is None or x != x else int(x)  # data frames turn integers beside nulls into floats

    root, known = None, {}
    for r in sorted(rows, key=lambda r: r["node_id"]):
        attrs = dict(r["attrs"] or {})
        node = Node(r["type"], value=r["value"], level=whole(r["level"]))
        parent = whole(r["parent_id"])
        node.attrs = attrs
        known[r["node_id"]] = node
        if parent is None:
            root = node
        else:
            known[parent].children.append(node)
    return root


# --- the same on rows -----------------------------------------------------------------------------------------------


def exploded(parsed: DataFrame, key: str = "doc_id", nodes: str = "nodes") -> DataFrame:
    """One row for each node."""
    return parsed.select(key, F.explode(nodes).alias("n")).select(key, "n.*")


def subtree_text(nodes: str | Column, low: Column, high: Column) -> Column:
    """Text of the nodes from ``low`` to ``high`` of an array of rows, without separators."""
    leaf = F.filter(nodes, lambda n: n["node_id"].between(low, high) & n["type"].isin(*LEAVES) & n["value"].isNotNull())
    return F.array_join(F.transform(leaf, lambda n: n["value"]), "")


def texts(nodes: DataFrame, of: list[str], key: str = "doc_id") -> DataFrame:
    """(key, node_id, text) of the nodes of some types, by a range join within each document."""
    outer = nodes.where(F.col("type").isin(*of)).select(F.col(key).alias("_k"), F.col("node_id").alias("_n"), F.col("last_desc").alias("_l"))
    inner = nodes.where(F.col("type").isin(*LEAVES) & F.col("value").isNotNull()).select(key, F.col("node_id").alias("_at"), "value")
    met = outer.join(inner, (F.col("_k") == F.col(key)) & F.col("_at").between(F.col("_n"), F.col("_l")), "left")
    gathered = met.groupBy("_k", "_n").agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("parts"))
    return gathered.select(F.col("_k").alias(key), F.col("_n").alias("node_id"), F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("text"))


def headings(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_id, level, text, id) of all headings."""
    own = nodes.where("type = 'heading'").select(key, "node_id", "level", F.try_element_at("attrs", F.lit("id")).alias("id"))
    return own.join(texts(nodes, ["heading"], key), [key, "node_id"]).select(key, "node_id", "level", "text", "id")


def pruned(nodes: DataFrame, cut: Column, key: str = "doc_id") -> DataFrame:
    """Nodes that are not within a subtree whose root ``cut`` holds for; ranges end before later nodes begin."""
    before = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("_until", F.max(F.when(cut, F.col("last_desc"))).over(before)).where(
        F.col("_until").isNull() | (F.col("node_id") > F.col("_until"))
    ).drop("_until")


def depths(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    return nodes.groupBy(key).agg(F.max("depth").alias("depth"))


def by_id(nodes: DataFrame, wanted: str, key: str = "doc_id") -> DataFrame:
    """The first node with an id, in document order."""
    return nodes.where(F.try_element_at("attrs", F.lit("id")) == wanted).groupBy(key).agg(F.min_by(F.struct("node_id", "type", "level"), "node_id").alias("node"))


def merged(nodes: DataFrame, group: str, order: str) -> DataFrame:
    """Documents of a group as one: their nodes below the roots follow each other under a new root."""
    sizes = nodes.groupBy(group, order).agg((F.max("last_desc")).alias("size"))
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(group)
    placed = sizes.withColumn("shift", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int")).withColumn("total", F.sum("size").over(all_of).cast("int"))
    tops = nodes.where("depth = 1").groupBy(group, order).agg(F.count("*").alias("tops"))
    placed = placed.join(tops, [group, order], "left").withColumn("ord", F.coalesce(F.sum("tops").over(before), F.lit(0)).cast("int"))
    both = nodes.join(placed, [group, order])
    body = both.where("depth > 0").select(
        group, (F.col("node_id") + F.col("shift")).alias("node_id"),
        F.when(F.col("depth") == 1, F.lit(0)).otherwise(F.col("parent_id") + F.col("shift")).alias("parent_id"),
        F.when(F.col("depth") == 1, F.col("ordinal") + F.col("ord")).otherwise(F.col("ordinal")).alias("ordinal"),
        "depth", (F.col("last_desc") + F.col("shift")).alias("last_desc"), "type", "level", "value", "attrs",
    )
    root = placed.groupBy(group).agg(F.max("total").alias("last_desc")).select(
        group, F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ordinal"), F.lit(0).alias("depth"), "last_desc",
        F.lit("document").alias("type"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("value"), F.create_map().cast("map<string,string>").alias("attrs"),
    )
    return root.unionByName(body)


def structure(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, structure): the types in document order, joined by commas."""
    gathered = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node_id", "type"))).alias("t"))
    return gathered.select(key, F.array_join(F.transform("t", lambda x: x["type"]), ",").alias("structure"))


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name)).alias(name)


def images(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_id, src, alt, title, mimeType, width, height) of all images: the assets of documents."""
    size = [F.try_element_at("attrs", F.lit(n)).cast("int").alias(n) for n in ("width", "height")]
    return nodes.where("type = 'image'").select(key, "node_id", *map(_attr, ("src", "alt", "title", "mimeType")), *size)


def links(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_id, href, title, text) of all links."""
    own = nodes.where("type = 'link'").select(key, "node_id", _attr("href"), _attr("title"))
    return own.join(texts(nodes, ["link"], key), [key, "node_id"])


def table_cells(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table_id, row_idx, col_idx, is_header, value) of all tables; a table is known by its place."""
    rows = nodes.where("type = 'table-row'").select(
        key, F.col("node_id").alias("_row"), F.col("parent_id").alias("table_id"), F.col("ordinal").alias("row_idx"),
        F.coalesce(F.try_element_at("attrs", F.lit("isHeader")) == "true", F.lit(False)).alias("is_header"),
    )
    cells = nodes.where("type = 'table-cell'").select(key, "node_id", F.col("parent_id").alias("_row"), F.col("ordinal").alias("col_idx"))
    met = cells.join(rows, [key, "_row"]).join(texts(nodes, ["table-cell"], key), [key, "node_id"])
    return met.select(key, "table_id", "row_idx", "col_idx", "is_header", F.col("text").alias("value"))


def table_data(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table_id, headers, rows): the first row of each table, and the others."""
    by_row = table_cells(nodes, key).groupBy(key, "table_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("c"))
    by_row = by_row.select(key, "table_id", "row_idx", F.transform("c", lambda x: x["value"]).alias("cells"))
    whole = by_row.groupBy(key, "table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("r"))
    all_rows = F.transform("r", lambda x: x["cells"])
    return whole.select(key, "table_id", F.get(all_rows, F.lit(0)).alias("headers"), F.slice(all_rows, 2, 1 << 30).alias("rows"))


def merged_metadata(a: Column, b: Column) -> Column:
    """Both maps as one; the second one's values hold."""
    a, b = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (a, b))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)
