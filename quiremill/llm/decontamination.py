"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index is a written table of postings (w, doc_id, h, place), one for each token of the
training texts that is a test word; ``w`` is the word's hash. As in a search engine,
each shard of the documents has its own inverted lists: a file holds the lists of its
documents, sorted by word, document and place, so that a frequent word is spread over
all files, a word's list is one run of rows and the columns pack to few bytes.

A window of test words is looked up from its rarest word: that word's list gives the
anchors, the list of the second rarest word is intersected with it, and of the anchors
left the lists of all other words are asked, moved by their offsets. All lists are met by
word, document and a block of places, so that neither a frequent word nor a long
document is one key.

Exact matches are windows of ``window`` consecutive item words (an item of fewer words
is one window). Proximity matches are windows whose words all stand, in any order and as
often as in the window, in ``slop`` more consecutive words than the window has. Every
window is tested for both.

Defined results: a null or empty text or item has no words and matches nothing; texts
and items of any length are taken whole; rows alike in doc_id and text are one document
and get the same result each; items alike in id count once; a null item_id is named by
the empty string; an empty benchmark hits nothing, and an empty table of documents gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.common import written

WINDOW = 10
SLOP = 5
#: Windows that are sent to every task, about 300 bytes each; more are joined by shuffle.
BROADCAST_WINDOWS = 50_000
#: Test words, and documents with candidates, that are sent to every task, 8 bytes each; more are joined by shuffle.
BROADCAST_WORDS = 500_000
BROADCAST_DOCS = 500_000
#: Parts of a word's list where it is joined by shuffle.
SALTS = 16

_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(word: Column) -> Column:
    """A-Z in lower case and nothing else; the quick way holds where all characters are ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, cut at every ASCII character that is no letter or digit."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), _CUT), lambda x: x != ""), _lower)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words): a document is known by its doc_id and the hash of its text."""
    parts = F.split(F.coalesce("text", F.lit("")), _CUT)
    # Only the first and the last part can be empty; where there is but one, both are it.
    empty = (F.get(parts, F.lit(0)) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.greatest(F.size(parts) - empty, F.lit(0)).cast("long").alias("n_words"))


def _salted(many: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join by shuffle, with the rows of each key of ``many`` dealt over ``SALTS`` tasks by their place."""
    dealt = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod("place", F.lit(SALTS))).join(dealt, [on, "salt"], how).drop("salt")


def stored_postings(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Written index (w, doc_id, h, place) of all tokens, or of those whose word hash is in ``vocabulary`` (w)."""
    tokens = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", _CUT)).alias("place", "word"))
    tokens = tokens.where("word != ''").select(F.xxhash64(_lower(F.col("word"))).alias("w"), "doc_id", "h", "place")
    if vocabulary is not None:
        few = vocabulary.count() <= BROADCAST_WORDS
        tokens = tokens.join(F.broadcast(vocabulary), "w", "left_semi") if few else _salted(tokens, vocabulary, "w", "left_semi")
    return written(tokens.sortWithinPartitions("w", "doc_id", "h", "place"), "postings")


def item_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Written table (wid, words, items) of the distinct windows of all items."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("iw"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("iw") - window + 1, F.lit(1)))
    each = items.where(F.size("iw") > 0).distinct().select("item_id", F.explode(F.transform(starts, lambda s: F.slice("iw", s, window))).alias("words"))
    grouped = each.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    return written(grouped.select(F.xxhash64(F.array_join("words", " ")).alias("wid"), "words", "items"), "windows")


def vocabulary(windows: DataFrame) -> DataFrame:
    """Written table (w) of the hashes of all words in the windows."""
    return written(windows.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("w")).distinct(), "test-words")


def _anchored(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Written table (wid, w, off, second, need, ws): windows with their rarest word, its offset, and the second rarest.

    Windows with a word that no text has match nothing and are left out.
    """
    counts = index.groupBy("w").agg(F.count("*").alias("n"))
    terms = windows.select("wid", F.posexplode("words").alias("o", "word")).withColumn("w", F.xxhash64("word")).join(counts, "w", "left")
    ranked = terms.groupBy("wid").agg(
        F.array_sort(F.collect_list(F.struct("n", "word", "o", "w"))).alias("r"),
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
    )
    hashes = F.transform("words", lambda x: F.xxhash64(x))
    return written(
        windows.join(ranked.where("least > 0"), "wid").select(
            "wid", F.col("r")[0]["w"].alias("w"), F.col("r")[0]["o"].alias("off"), F.get("r", F.lit(1))["w"].alias("second"), F.size("words").alias("need"), hashes.alias("ws")
        ),
        "anchors",
    )


_SAME = "x.w = y.w and x.h = y.h and x.doc_id <=> y.doc_id and x.block = y.block and abs(x.p - y.place) < x.reach"


def _asked(probes: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """Probes (w, doc_id, h, p, reach, ...) met with the postings of w less than ``reach`` places away."""
    ends = F.array_distinct(F.array(F.floor((F.col("p") - F.col("reach") + 1) / width), F.floor((F.col("p") + F.col("reach") - 1) / width)))
    blocked = probes.withColumn("block", F.explode(ends)).alias("x")
    lists = index.withColumn("block", F.floor(F.col("place") / width)).alias("y")
    return blocked.join(lists, F.expr(_SAME)).select("x.*", "y.place")


def matches(index: DataFrame, windows: DataFrame, slop: int = SLOP) -> DataFrame:
    """Written table (doc_id, h, wid, exact, start, stop) of exact and proximity matches; those have no start and stop."""
    anchors = _anchored(index, windows)
    few = anchors.count() <= BROADCAST_WINDOWS
    sent = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    # Less than this many places lie between a window's words; the widest window sets the blocks.
    reach = F.col("need") + slop
    width = 2 * ((anchors.agg(F.max("need")).first()[0] or 1) + slop) - 1
    rarest = anchors.select("wid", "w", "second", "need")
    met = index.join(F.broadcast(rarest), "w") if few else _salted(index, rarest, "w")
    first = met.select("wid", "doc_id", "h", F.col("place").alias("p"), F.col("second").alias("w"), reach.alias("reach"), "need")
    first = written(first, "anchor-places")
    lists = index.join(sent(anchors.where("need > 1").select(F.col("second").alias("w")).distinct()), "w", "left_semi")
    both = _asked(first.where("need > 1"), lists, width).select("wid", "doc_id", "h", "p").distinct()
    both = written(both, "anchor-places")
    held = both.select("h").distinct()
    lists = index.join(F.broadcast(held), "h", "left_semi") if held.count() <= BROADCAST_DOCS else index
    info = sent(anchors.select("wid", "off", "need", "ws"))
    probes = both.join(info, "wid").select("wid", "doc_id", "h", "p", reach.alias("reach"), F.explode(F.array_distinct("ws")).alias("w"))
    near = _asked(probes, lists, width).groupBy("wid", "doc_id", "h", "p").agg(
        F.collect_set(F.struct((F.col("place") - F.col("p")).alias("o"), "w")).alias("found")
    )
    found = near.join(info, "wid").where(F.size("found") >= F.col("need"))
    exact = F.forall(F.sequence(F.lit(0), F.col("need") - 1), lambda i: F.array_contains("found", F.struct((i - F.col("off")).alias("o"), F.get("ws", i).alias("w"))))

    def within(low: Column) -> Column:
        span = F.transform(F.filter("found", lambda x: (x["o"] >= low) & (x["o"] < low + F.col("need") + slop)), lambda x: x["w"])
        # As often as in the window: a word that it has twice must stand there twice.
        times = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
        return F.forall(F.array_distinct("ws"), lambda w: times(span, w) >= times(F.col("ws"), w))

    close = F.exists(F.sequence(1 - F.col("need") - slop, F.lit(0)), within)
    told = found.select("doc_id", "h", "wid", exact.alias("exact"), (F.col("p") - F.col("off")).alias("at"), "need", close.alias("close")).where("close")
    single = first.where("need = 1").select("doc_id", "h", "wid", F.lit(True).alias("exact"), F.col("p").alias("at"), "need", F.lit(True).alias("close"))
    place = lambda x: F.when(F.col("exact"), x).cast("long")
    told = told.unionByName(single).select("doc_id", "h", "wid", "exact", place(F.col("at")).alias("start"), place(F.col("at") + F.col("need")).alias("stop"))
    return written(told.distinct(), "matches")


def found_items(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Matches of every item: (doc_id, h, item_id, exact, start, stop)."""
    windows = item_windows(bench, window)
    index = stored_postings(docs, vocabulary(windows))
    found = matches(index, windows, slop)
    return found.join(windows.select("wid", F.explode("items").alias("item_id")), "wid").drop("wid").distinct()


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row for each document: doc_id, h, n_words, n_hit, items (exact, sorted), near (items with proximity matches alone, sorted)."""
    found = written(found_items(docs, bench, window, slop), "item-matches")
    runs = found.where("exact").select("doc_id", "h", "start", "stop").distinct()
    before = Window.partitionBy("doc_id", "h").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(before), F.col("start"))
    hits = runs.select("doc_id", "h", F.greatest(F.col("stop") - F.greatest("start", reached), F.lit(0)).alias("new"))
    hits = hits.groupBy("doc_id", "h").agg(F.sum("new").alias("n_hit"))
    items = found.groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("items"),
        F.array_sort(F.collect_set(F.when(~F.col("exact"), F.col("item_id")))).alias("near"),
    )
    both = items.alias("i").join(hits.alias("n"), F.expr("i.doc_id <=> n.doc_id and i.h = n.h"), "left").select("i.*", "n.n_hit")
    none = F.array().cast("array<string>")
    return documents(docs).alias("d").join(both.alias("b"), F.expr("d.doc_id <=> b.doc_id and d.h = b.h"), "left").select(
        "d.doc_id",
        "d.h",
        "d.n_words",
        F.coalesce("b.n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("b.items", none).alias("items"),
        F.coalesce(F.array_except("b.near", "b.items"), none).alias("near"),
    )
