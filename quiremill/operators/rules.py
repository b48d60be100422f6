"""Noise rules: over trees while a document is at hand, and the list and table rules as windows over rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions import text as T
from quiremill.operators.render import as_json
from quiremill.operators.tree import Node

Rule = Callable[[Node], Node | None]


def _decorative(n: Node) -> Node | None:
    if n.type != "image":
        return n
    tiny = n.attrs.get("width") == "1" and n.attrs.get("height") == "1"
    return None if tiny or re.search(T.DECORATIVE_RULE, n.attrs.get("src", "")) else n


def _repeated_headers(n: Node) -> Node:
    if n.type == "table":
        kept, last = [], None
        for row in n.children:
            own = tuple(c.text() for c in row.children) if row.attrs.get("isHeader") == "true" else None
            if own is None or own != last:
                kept.append(row)
            last = own
        n.children = kept
    return n


def _comments(n: Node) -> Node | None:
    if n.type == "html":
        n.value = re.sub(r"(?s)<!--.*?-->", "", n.value or "").strip()
        return n if n.value else None
    return n


def _spaces(n: Node) -> Node:
    if n.type == "text":
        n.value = re.sub(r"[ \t]{2,}", " ", n.value or "")
    return n


def _repeated_items(n: Node) -> Node:
    if n.type == "list":
        kept, last = [], None
        for item in n.children:
            own = as_json(item)
            if own != last:
                kept.append(item)
            last = own
        n.children = kept
    return n


def _boilerplate(n: Node) -> Node | None:
    return None if n.type == "text" and re.search(T.BOILERPLATE, n.value or "") else n


RULES: dict[str, Rule] = {
    "strip-decorative-images": _decorative,
    "collapse-repeated-headers": _repeated_headers,
    "remove-html-comments": _comments,
    "strip-whitespace-columns": _spaces,
    "deduplicate-list-items": _repeated_items,
    "strip-boilerplate": _boilerplate,
}


def optimize(tree: Node, rules: list[str] | None = None, own: list[Rule] | None = None) -> Node:
    """A cleaned copy: each rule in turn from the leaves up; unknown names are passed over, None deletes a node."""
    chosen = [RULES[name] for name in (RULES if rules is None else rules) if name in RULES] + (own or [])

    def copied(n: Node) -> Node:
        made = Node(n.type, map(copied, n.children), n.value, n.level)
        made.attrs = dict(n.attrs)
        return made

    def applied(n: Node, rule: Rule) -> Node | None:
        n.children = [c for c in (applied(x, rule) for x in n.children) if c is not None]
        return rule(n)

    tree = copied(tree)
    for rule in chosen:
        tree = applied(tree, rule) or Node("document")
    return tree


def without_consecutive(rows: DataFrame, key: list[str], order: str, value: str, only: str | None = None) -> DataFrame:
    """Rows that do not repeat the row before them; ``only`` names a flag that both must have."""
    before = Window.partitionBy(*key).orderBy(order)
    same = F.col(value).eqNullSafe(F.lag(value).over(before)) & F.lag(F.lit(True), 1, False).over(before)
    if only:
        same = same & F.col(only) & F.coalesce(F.lag(only).over(before), F.lit(False))
    return rows.withColumn("_same", same).where("not _same").drop("_same")
