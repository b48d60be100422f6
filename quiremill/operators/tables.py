"""Tables as cells: grids, merged ranges, pruning, headers and Markdown, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_number(letters: Column) -> Column:
    """A is 0, Z is 25, AA is 26."""
    codes = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0), lambda a, c: a * 26 + c) - 1


def column_letters(number: Column) -> Column:
    """The inverse, for up to three letters."""
    n = number + 1
    low = F.pmod(n - 1, F.lit(26))
    second = F.floor((n - 1 - low) / 26)
    mid = F.pmod(second - 1, F.lit(26))
    third = F.floor((second - 1 - mid) / 26)
    letter = lambda x: F.char((x + 65).cast("long"))
    return F.concat(F.when(third > 0, letter(third - 1)).otherwise(""), F.when(second > 0, letter(mid)).otherwise(""), letter(low))


def with_shared(cells: DataFrame, shared: DataFrame, key: list[str]) -> DataFrame:
    """Texts of cells that hold an index into shared strings; an index without a string stays as it is."""
    texts = shared.select(*key, F.col("idx").cast("string").alias("_i"), F.col("value").alias("_t"))
    met = cells.withColumn("_i", F.when(F.col("kind") == "s", F.col("value"))).join(texts, [*key, "_i"], "left")
    return met.withColumn("value", F.coalesce("_t", "value")).drop("_i", "_t")


def filled(cells: DataFrame, merges: DataFrame, key: list[str]) -> DataFrame:
    """Cells of merged ranges take the text of the range's first cell, of the last range that covers them."""
    spread = merges.withColumn("_n", F.monotonically_increasing_id()).join(
        cells.select(*key, F.col("r").alias("top"), F.col("c").alias("left"), F.col("value").alias("_v")), [*key, "top", "left"]
    )
    spread = spread.select(*key, "_n", "_v", F.explode(F.sequence("top", "bottom")).alias("r"), "left", "right")
    spread = spread.select(*key, "_n", "_v", "r", F.explode(F.sequence("left", "right")).alias("c"))
    spread = spread.groupBy(*key, "r", "c").agg(F.max_by("_v", "_n").alias("_v"))
    return cells.join(spread, [*key, "r", "c"], "full_outer").select(*key, "r", "c", F.coalesce("_v", "value").alias("value"))


def dense(cells: DataFrame, key: list[str]) -> DataFrame:
    """One row for each table: its grid as rows of texts, without blank columns and rows."""
    size = cells.groupBy(*key).agg(F.max("r").alias("h"), F.max("c").alias("w"), F.collect_list(F.struct(F.struct("r", "c").alias("k"), F.coalesce("value", F.lit("")).alias("v"))).alias("all"))
    known = F.map_from_entries("all")
    grid = F.transform(
        F.sequence(F.lit(0), F.col("h")),
        lambda r: F.transform(
            F.sequence(F.lit(0), F.col("w")),
            lambda c: F.coalesce(F.try_element_at(known, F.struct(r.alias("r"), c.alias("c"))), F.lit("")),
        ),
    )
    made = size.select(*key, grid.alias("grid"))
    full = F.filter(F.sequence(F.lit(0), F.size(F.get("grid", F.lit(0))) - 1), lambda c: F.exists("grid", lambda row: F.trim(F.get(row, c)) != ""))
    cut = F.transform("grid", lambda row: F.transform(full, lambda c: F.get(row, c)))
    return made.select(*key, F.filter(cut, lambda row: F.exists(row, lambda x: F.trim(x) != "")).alias("grid"))


def markdown(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """(key, markdown): aligned cells under a header of the column names; widths are window maxima over each table."""
    text = rows.select(*key, F.col(order).alias("_o"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    over = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    for c in columns:
        text = text.withColumn(f"_w_{c}", F.greatest(F.lit(len(c)), F.max(F.length(c)).over(over)))

    def line(cells: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    padded = line([F.rpad(F.col(c), F.col(f"_w_{c}"), F.lit(" ")) for c in columns])
    head = line([F.rpad(F.lit(c), F.col(f"_w_{c}"), F.lit(" ")) for c in columns])
    dashes = line([F.expr(f"repeat('-', `_w_{c}`)") for c in columns])
    lines = text.select(*key, "_o", padded.alias("line"), F.concat_ws("\n", head, dashes).alias("head"))
    grouped = lines.groupBy(*key).agg(F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("_o", "line"))).alias("l"))
    return grouped.select(*key, F.concat_ws("\n", "head", F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("markdown"))


def key_union(objects: DataFrame, json: str, key: list[str], order: str) -> DataFrame:
    """(key, name, place) of the keys of JSON objects, in the order in which they first come."""
    found = objects.select(*key, F.col(order).alias("_o"), F.posexplode(F.json_object_keys(json)).alias("_p", "name"))
    first = found.groupBy(*key, "name").agg(F.min(F.struct("_o", "_p")).alias("_f"))
    over = Window.partitionBy(*key).orderBy("_f") if key else Window.partitionBy(F.lit(0)).orderBy("_f")
    return first.select(*key, "name", F.row_number().over(over).alias("place"))
