"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

A sorted array of fingerprints is a binary trie: a node is a range of keys that share
a prefix. The join walks pairs of nodes together, adds one for each differing bit, and
drops a pair as soon as the budget of differing bits is passed, or once both nodes lie
wholly in one component. Fingerprints that differ in at most b bits agree in at least
one of b + 1 blocks of bits, so the trie is dealt out by block: every task joins the
sub-tries below its blocks' values and returns at most one link for each fingerprint.

Defined results: a null or empty text has fingerprint zero and is linked like any
other; a text of fewer words than a shingle is one shingle; equal fingerprints are one
node, whatever their number; a null doc_id never becomes a component's id unless the
component has no other; repeated rows are returned as often as they come; texts of any
length are taken whole; an empty table gives an empty table; other columns are ignored,
and :func:`one_of_each` and :func:`one_of_each_alike` return them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiremill.llm.common import connected_components, join_hot, joined_groups, meetings, met_pairs, mixed_crowds, pairs_apart, written

BITS = 64
SEED = 42
#: Pairs of nodes held at once; further ones wait on a stack.
FRONTIER = 1 << 20
#: Node pairs with at most so many key pairs are compared at once.
SMALL = 24


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit fingerprint: the majority of each bit over the hashes of all shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if count == 1:
        return int.from_bytes(digest(joined, SEED), "big")
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: count - 1])]
    ones = np.zeros(BITS, np.int64)
    for low in range(0, count, 65536):
        part = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[low : low + 65536], ends[low + shingle - 1 :])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, out: str = "fp") -> DataFrame:
    """Replace the text column by its fingerprint as a signed 64-bit integer."""
    kept = [(i, f) for i, f in enumerate(df.schema.fields) if f.name not in (text, out)]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i, _ in kept), pa.array(found.view(np.int64))], [*(f.name for _, f in kept), out]
            )

    return df.mapInArrow(run, T.StructType([*(f for _, f in kept), T.StructField(out, T.LongType())]))


def _united(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the given positions are linked; a label is the lowest position of its component."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels = shorter


def trie_components(keys: np.ndarray, fixed: int, budget: int) -> np.ndarray:
    """Component labels of sorted distinct keys, linking those alike in the first ``fixed`` bits that differ in at most ``budget``."""
    n = len(keys)
    labels = np.arange(n)
    if n < 2:
        return labels
    roots = np.flatnonzero(np.r_[True, (keys[1:] >> np.uint64(BITS - fixed)) != (keys[:-1] >> np.uint64(BITS - fixed))])
    ends = np.r_[roots[1:], n]
    roots, ends = roots[ends - roots > 1], ends[ends - roots > 1]
    # Close links first: once dense groups are one component, their pairs are dropped at inner nodes.
    for most in range(1, budget + 1):
        changes = np.r_[0, np.cumsum(labels[1:] != labels[:-1])]
        stack = [(fixed, roots, ends, roots, ends, np.zeros(len(roots), np.int8))]
        stale = 0
        while stack:
            depth, lo1, hi1, lo2, hi2, off = stack.pop()
            if stale > n // 4:
                changes, stale = np.r_[0, np.cumsum(labels[1:] != labels[:-1])], 0
            whole = (changes[hi1 - 1] == changes[lo1]) & (changes[hi2 - 1] == changes[lo2]) & (labels[lo1] == labels[lo2])
            live = ~whole & ((lo1 != lo2) | (hi1 - lo1 > 1))
            lo1, hi1, lo2, hi2, off = lo1[live], hi1[live], lo2[live], hi2[live], off[live]
            if not len(lo1):
                continue
            small = ((hi1 - lo1) * (hi2 - lo2) <= SMALL) | (depth >= BITS)
            if small.any():
                a, b, c, d = lo1[small], hi1[small], lo2[small], hi2[small]
                size = (b - a) * (d - c)
                which = np.repeat(np.arange(len(a)), size)
                offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                width = (d - c)[which]
                i, j = a[which] + offset // width, c[which] + offset % width
                close = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= most)
                if close.any():
                    labels = _united(labels, i[close], j[close])
                    stale += int(close.sum())
                rest = ~small
                lo1, hi1, lo2, hi2, off = lo1[rest], hi1[rest], lo2[rest], hi2[rest], off[rest]
            if not len(lo1):
                continue
            bit = np.uint64(1 << (BITS - 1 - depth))
            upper = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
            mid1 = np.searchsorted(keys, keys[lo1] & upper | bit)
            mid2 = np.searchsorted(keys, keys[lo2] & upper | bit)
            other = lo1 != lo2
            parts = [
                (lo1, mid1, lo2, mid2, off),
                (mid1, hi1, mid2, hi2, off),
                (lo1, mid1, mid2, hi2, off + 1),
                (mid1[other], hi1[other], lo2[other], mid2[other], off[other] + 1),
            ]
            low1, top1, low2, top2, diff = (np.concatenate(x) for x in zip(*parts))
            kept = (diff <= most) & (top1 > low1) & (top2 > low2)
            low1, top1, low2, top2, diff = low1[kept], top1[kept], low2[kept], top2[kept], diff[kept]
            for at in range(0, len(low1), FRONTIER):
                cut = slice(at, at + FRONTIER)
                stack.append((depth + 1, low1[cut], top1[cut], low2[cut], top2[cut], diff[cut].astype(np.int8)))
    return labels


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of budget + 1 blocks that cover all bits."""
    edges = [round(i * BITS / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def fingerprint_links(fps: DataFrame, budget: int = 4, fp: str = "fp") -> DataFrame:
    """Links (a, b) that join distinct fingerprints at up to ``budget`` differing bits: a spanning forest for each task."""
    blocks = _blocks(budget)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(fp)
    keyed = fps.select(
        value.alias("fp"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("k"),
                        F.shiftrightunsigned(value, BITS - a - w).bitwiseAND((1 << w) - 1).alias("v"),
                    )
                    for k, (a, w) in enumerate(blocks)
                ]
            )
        ).alias("b"),
    ).select("fp", "b.k", "b.v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[np.ndarray]] = [[] for _ in blocks]
        for batch in batches:
            keys, ks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for k in np.unique(ks):
                seen[k].append(keys[ks == k].view(np.uint64))
        for (a, w), own in zip(blocks, seen):
            if not own:
                continue
            keys = np.unique(np.concatenate(own))
            turned = keys << np.uint64(a) | keys >> np.uint64(BITS - a) if a else keys
            order = np.argsort(turned)
            labels = trie_components(turned[order], w, budget)
            linked = labels != np.arange(len(labels))
            if linked.any():
                own = keys[order].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[labels[linked]])], ["a", "b"])

    return keyed.repartition(parts, "k", "v").select("fp", "k", "v").mapInArrow(run, "a long, b long")


def _groups(marked: DataFrame, budget: int) -> DataFrame:
    """(fp, component) of all distinct fingerprints; a component is named by one of its fingerprints."""
    distinct = marked.select("fp").distinct()
    links = written(fingerprint_links(distinct, budget), "fingerprint-links")
    groups = connected_components(links)
    return distinct.join(groups, distinct.fp == groups.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def components(docs: DataFrame, budget: int = 4, shingle: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id, fp, component_id), the smallest id that links reach."""
    marked = written(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", shingle), "fingerprints")
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = written(firsts.join(_groups(marked, budget), "fp"), "fingerprint-groups")
    lowest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(join_hot(placed, lowest, "component").select("fp", "component_id"), "fingerprint-names")
    return join_hot(marked, named, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, budget: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest doc_id, and of its rows the smallest text hash, once.

    Null ids come after all others. A component's rows are never gathered: its first row is a minimum.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_ql_doc"), F.xxhash64("text").alias("_ql_hash")]
    marked = written(fingerprints(docs.select(*key, "text"), "text", shingle), "fingerprints")
    firsts = join_hot(marked, _groups(marked, budget), "fp").groupBy("component").agg(F.min(F.struct("_ql_doc", "_ql_hash")).alias("f"))
    rows = docs.select("*", *key).join(firsts.select("f.*"), ["_ql_doc", "_ql_hash"], "left_semi")
    over = Window.partitionBy("_ql_doc", "_ql_hash").orderBy(F.lit(0))  # rows alike in id and text
    return rows.withColumn("_ql_n", F.row_number().over(over)).where("_ql_n = 1").select(*docs.columns)


#: Bands of smallest hashes by which texts meet: at a shingle similarity of 0.8 all but 0.5 % of pairs share one.
BANDS, ROWS = 10, 4
#: Texts under one band up to which all pairs are compared; above, one text with all others.
CROWDED = 8


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    runs = (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), np.uint64))


def _bands(texts: DataFrame, size: int) -> DataFrame:
    """(h, text) to rows (h, k, size): one for each band, with the number of distinct shingles."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, sizes = [], []
            for text in batch.column(1):
                own = shingles(text.as_py(), size)
                sizes.append(len(own))
                least = [(m := own * f, (m ^ m >> np.uint64(32)) * f)[1].min() for f in factors]
                rows = np.array(least, np.uint64).reshape(BANDS, ROWS)
                keys += [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)]
            columns = np.repeat(batch.column(0).to_numpy(), BANDS), np.array(keys, np.uint64).view(np.int64), np.repeat(np.array(sizes, np.int64), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "k", "size"])

    return texts.mapInArrow(run, "h long, k long, size long")


def _alike(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of (a, b) those pairs whose shingle sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = shingles(x.as_py(), size), shingles(y.as_py(), size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (texts.select(F.col("h").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _close_prints(texts: DataFrame, size: int, budget: int) -> DataFrame:
    """(a, b) of texts whose fingerprints the trie links: the smallest text of each fingerprint with its others and its links'."""
    marked = written(fingerprints(texts, "text", size), "fingerprints")
    firsts = written(marked.groupBy("fp").agg(F.min("h").alias("first")), "fingerprint-firsts")
    links = fingerprint_links(firsts.select("fp"), budget)
    left, right = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"f{x}")) for x in "ab")
    linked = links.join(left, "a").join(right, "b").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    same = join_hot(marked, firsts, "fp").where("h != first").select(F.col("first").alias("a"), F.col("h").alias("b"))
    return linked.unionByName(same)


def one_of_each_alike(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, budget: int = 4) -> DataFrame:
    """Like :func:`one_of_each`, for components of texts linked by the Jaccard similarity of their shingles, checked exactly.

    Candidates are the links of the trie, and, as most pairs of that similarity differ in more bits than a trie can
    be asked for, texts that share a band of smallest hashes. A crowded band compares its hub with all others; of the
    texts of one crowd that are still apart all pairs are compared whose numbers of shingles allow the similarity.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_ql_doc"), F.xxhash64("text").alias("_ql_hash")]
    texts = written(docs.select(F.xxhash64("text").alias("h"), "text").dropDuplicates(["h"]), "texts")
    met = meetings(written(_bands(texts, shingle), "text-bands"), "h", CROWDED)
    pairs = written(met_pairs(met, "h", CROWDED, "size", 1 - similarity).unionByName(_close_prints(texts, shingle, budget)).distinct(), "text-pairs")
    edges = written(_alike(pairs, texts, shingle, similarity), "text-links")
    groups = connected_components(edges)
    crowds = mixed_crowds(met, groups, "h", CROWDED)
    if not crowds.isEmpty():
        apart = pairs_apart(crowds, "h", "size", 1 - similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = written(apart.join(pairs, ["a", "b"], "left_anti"), "text-pairs")
        groups = joined_groups(groups, written(_alike(more, texts, shingle, similarity), "text-links"))
    rows = docs.select("*", *key)
    named = rows.select("_ql_doc", "_ql_hash").join(groups, F.col("_ql_hash") == F.col("node"), "left")
    firsts = named.groupBy(F.coalesce("component", "_ql_hash").alias("g")).agg(F.min(F.struct("_ql_doc", "_ql_hash")).alias("f"))
    rows = rows.join(firsts.select("f.*"), ["_ql_doc", "_ql_hash"], "left_semi")
    over = Window.partitionBy("_ql_doc", "_ql_hash").orderBy(F.lit(0))  # rows alike in id and text
    return rows.withColumn("_ql_n", F.row_number().over(over)).where("_ql_n = 1").select(*docs.columns)
