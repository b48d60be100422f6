"""Lines and texts under crowded keys: all pairs of one crowd that are alike are linked, not only those with its hub."""

import random

import pytest

from quiremill.llm import common, line_dedup, simhash_trie
from tests.llm.test_operators import alike_lines

WORDS = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(6)) for i in range(3000)]


@pytest.mark.parametrize("tile", [common.TILE, 4])
def test_lines_of_one_crowd_meet_all_others(spark, monkeypatch, tile):
    """Twenty passages under one start, twice each; the two share the start alone, as every third word after it differs in a letter."""
    monkeypatch.setattr(common, "TILE", tile)
    r = random.Random(3)
    start, lines = " ".join(WORDS[:5]), []
    for i in range(20):
        body = r.sample(WORDS[5:], 24 + i % 4)
        lines += [" ".join([start, *body]), " ".join([start, *("z" + w[1:] if j % 3 == 0 or j >= len(body) - 2 else w for j, w in enumerate(body))])]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(rows).collect()}
    assert found == {i: i % 2 for i in range(40)} and len(set(alike_lines(lines).values())) == 20


def test_hubs_of_classes_link_before_all_pairs(spark, monkeypatch):
    """Six passages of other lengths under one start, twelve times each with other letters in every third word: no version needs all the others."""
    compared = []

    def counted(*args, real=line_dedup.pairs_apart):
        compared.append(real(*args).count())
        return real(*args)

    monkeypatch.setattr(line_dedup, "pairs_apart", counted)
    r = random.Random(6)
    start, lines = " ".join(WORDS[:5]), []
    for n in (20, 27, 36, 48, 64, 85):
        body = r.sample(WORDS[5:], n)
        lines += [" ".join([start, *(c + w[1:] if j % 3 == 0 else w for j, w in enumerate(body))]) for c in "abcdefghijkl"]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(rows).collect()}
    assert found == {i: int(i % 12 > 0) for i in range(72)} and sum(compared) < 72


@pytest.mark.parametrize("tile", [common.TILE, 3])
def test_pairs_apart_are_all_pairs_once(spark, monkeypatch, tile):
    monkeypatch.setattr(common, "TILE", tile)
    r = random.Random(4)
    size, group = [r.randrange(1, 60) for _ in range(50)], [r.randrange(12) for _ in range(50)]
    keys = {k: r.sample(range(50), 20) for k in range(6)}
    rows = [(k, w, group[w], size[w], len(own)) for k, own in keys.items() for w in own]
    found = common.pairs_apart(spark.createDataFrame(rows, "k long, w long, g long, size int, n long"), "w", "size", 0.2).collect()
    fits = lambda a, b: abs(size[a] - size[b]) <= int(max(size[a], size[b]) * 0.2 + 1e-9)
    want = {(a, b) for own in keys.values() for a in own for b in own if a < b and group[a] != group[b] and fits(a, b)}
    assert sorted((min(x), max(x)) for x in found) == sorted(want) and len(want) > 100


def test_near_copies_of_one_crowd_meet_all_others(spark, monkeypatch):
    """All texts share their bands, as if their smallest hashes were in a passage that all hold, and none is near the crowd's hub but one."""
    from pyspark.sql import functions as F

    def bands(texts, size, real=simhash_trie._bands):
        return real(texts, size).withColumn("k", F.col("k") * 0)

    monkeypatch.setattr(simhash_trie, "_bands", bands)
    r = random.Random(5)
    rows = []
    for i in range(12):
        body = r.sample(WORDS, 120)
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join([*body[:115], *r.sample(WORDS, 5)]))]
    kept = simhash_trie.one_of_each_alike(spark.createDataFrame(rows, "doc_id long, text string"), budget=1)
    assert sorted(x.doc_id for x in kept.collect()) == list(range(0, 24, 2))
