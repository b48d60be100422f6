"""Page layout from positioned text items, in DataFrame operations.

``items``: doc_id, page, n (order on the page), x, y, size, text. A library that reads
PDF files is not part of the engine; any extractor that gives such rows can be plugged in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
# Sizes relative to the body's, or absolute without one, from which on a line is a heading.
RATIOS = ((1, 1.8), (2, 1.4), (3, 1.15))
SIZES = ((1, 20.0), (2, 16.0), (3, 13.0))
COLUMN_GAP = 50
BUCKET = 10
REACH = 30


def body_size(items: DataFrame) -> DataFrame:
    """(page, body): the most frequent size; of equals the one that comes first."""
    counted = items.groupBy(*PAGE, "size").agg(F.count("*").alias("k"), F.min("n").alias("first"))
    return counted.groupBy(*PAGE).agg(F.max_by("size", F.struct("k", -F.col("first"))).alias("body"))


def columns(items: DataFrame) -> DataFrame:
    """Append ``column``: a new one where the next x is far away."""
    over = Window.partitionBy(*PAGE).orderBy("x", "n")
    jump = F.coalesce((F.col("x") - F.lag("x").over(over) > COLUMN_GAP).cast("int"), F.lit(0))
    return items.withColumn("_j", jump).withColumn("column", F.sum("_j").over(over)).drop("_j")


def lines(items: DataFrame) -> DataFrame:
    """(page, line, size, y, text): a new line where y moves by over half the size or the size changes."""
    over = Window.partitionBy(*PAGE).orderBy("n")
    new = (F.abs(F.col("y") - F.lag("y").over(over)) > 0.5 * F.col("size")) | (F.col("size") != F.lag("size").over(over))
    marked = items.withColumn("line", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(over))
    grouped = marked.groupBy(*PAGE, "line").agg(F.first("size").alias("size"), F.first("y").alias("y"), F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t"))
    return grouped.select(*PAGE, "line", "size", "y", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))


def headings(lines_: DataFrame, body: DataFrame) -> DataFrame:
    """Append ``level``: 1 to 3 for headings, null for other lines."""
    met = lines_.join(body, PAGE, "left")
    level = F.lit(None).cast("int")
    for (k, ratio), (_, size) in reversed(list(zip(RATIOS, SIZES))):
        big = F.when(F.col("body") > 0, F.col("size") / F.col("body") > ratio).otherwise(F.col("size") >= size)
        level = F.when(big, k).otherwise(level)
    return met.withColumn("level", level)


def rows(items: DataFrame) -> DataFrame:
    """Append ``row``: items whose y is within half a size of the row's first one, from the top down; a fold, as the anchor moves by row."""
    ordered = items.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("k"), "n", "x", "y", "size", "text"))).alias("all"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("out"))

    def step(a, i):
        same = F.coalesce(F.abs(a["anchor"] - i["y"]) < 0.5 * i["size"], F.lit(False))
        row = F.when(same, a["row"]).otherwise(a["row"] + 1)
        return F.struct(F.when(same, a["anchor"]).otherwise(i["y"].cast("double")).alias("anchor"), row.alias("row"), F.concat(a["out"], F.array(row)).alias("out"))

    placed = ordered.withColumn("rows", F.aggregate("all", start, step)["out"])
    flat = placed.select(*PAGE, F.explode(F.arrays_zip("all", "rows")).alias("z"))
    return flat.select(*PAGE, "z.all.n", "z.all.x", "z.all.y", "z.all.size", "z.all.text", F.col("z.rows").alias("row"))


def tables(items: DataFrame) -> DataFrame:
    """(page, row, column, text) of pages that hold a table: places that half of the rows share are its columns."""
    placed = rows(items).withColumn("bucket", F.round(F.col("x") / BUCKET) * BUCKET)
    size = placed.groupBy(*PAGE).agg(F.count("*").alias("items"), F.count_distinct("row").alias("rows"))
    found = placed.groupBy(*PAGE, "bucket").agg(F.count_distinct("row").alias("k")).join(size, PAGE)
    found = found.where((F.col("items") >= 6) & (F.col("rows") >= 2) & (F.col("k") >= F.ceil(F.col("rows") / 2)))
    many = found.groupBy(*PAGE).agg(F.array_sort(F.collect_list("bucket")).alias("xs")).where(F.size("xs") >= 2)
    met = placed.join(many, PAGE)
    nearest = F.array_min(F.transform(F.col("xs"), lambda b: F.struct(F.abs(b - F.col("x")).alias("d"), b.alias("b"))))
    met = met.withColumn("near", nearest).where(F.col("near.d") < REACH)
    cells = met.groupBy(*PAGE, "row", F.col("near.b").alias("bx"), "xs").agg(F.array_sort(F.collect_list(F.struct("x", "n", "text"))).alias("t"))
    return cells.select(
        *PAGE, "row", (F.array_position("xs", F.col("bx")) - 1).cast("int").alias("column"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text")
    )


def scanned(items: DataFrame, least: int = 5) -> DataFrame:
    """Documents whose first page has hardly any text."""
    return items.where("page = 1").groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") < least).select("doc_id")


def markdown(items: DataFrame, marker: str = "---") -> DataFrame:
    """(doc_id, markdown): lines in order, headings marked, a marker between pages."""
    own = headings(lines(items), body_size(items))
    text = F.when(F.col("level").isNotNull(), F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    paged = own.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", text.alias("text")))).alias("l"))
    paged = paged.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("text"))
    whole = paged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return whole.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), f"\n\n{marker}\n\n").alias("markdown"))


def frontmatter(title, author, pages):
    """YAML lines of what is known."""
    known = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in (("title", title), ("author", author), ("pages", pages))]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *known), F.lit("\n---"))
