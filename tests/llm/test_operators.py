"""Each operator against a brute-force version, on awkward documents and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quiremill.llm import common, decontamination, licence_scan, line_dedup, piece_codec, quality, queries, secret_scan, simhash_trie, suffix_collection, vector_graph, warc_revisit
from quiremill.llm.queries import tokenizer_path

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def last(doc_id):
    return float("inf") if doc_id is None else doc_id


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_repeats(spark, docs, awkward, monkeypatch):
    order = sorted({(last(d), suffix_hash(spark, d, t), t) for d, t in awkward}, key=lambda x: x[:2])
    seen, expected = set(), {}
    for d, _, t in order:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 99):
            piece = raw[i : i + 100]
            if piece in seen:
                gone[i : i + 100] = True
            seen.add(piece)
        gone = gone[:-1]
        expected[d, t] = (len(raw), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    want = Counter()
    copies = Counter()
    for d, t in awkward:
        row = expected[last(d), t]
        if copies[d, t] and row[0] >= 100:
            row = (row[0], row[0], 1, b"")
        copies[d, t] += 1
        want[(d, *row)] += 1
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_collection.remove_repeats(docs).collect())
    assert found == want


def suffix_hash(spark, d, t):
    key = (1 << 63) - 1 if d is None else d
    text = "null" if t is None else "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if (d, t) not in _HASHES:
        from pyspark.sql import functions as F

        row = spark.createDataFrame([(key, t)], "doc long, text string").select(F.xxhash64("doc", "text").alias("h")).first()
        _HASHES[d, t] = row.h
    return _HASHES[d, t]


_HASHES: dict = {}


def test_collection_is_a_suffix_array(tmp_path):
    r = np.random.default_rng(3)
    segments = [bytes(r.integers(97, 99, int(r.integers(100, 160)), dtype=np.uint8)) for _ in range(30)]
    segments += [segments[0][:120], segments[1][5:], b"q" * 140]
    tables = suffix_collection.Tables(str(tmp_path))
    starts = np.array([len(s) - 99 for s in segments])
    seg, at, group = suffix_collection.equal_strings(segments, starts, tables)
    tables.close()
    assert len(seg) == starts.sum()
    by_group, by_text = {}, {}
    for s, a, g in zip(seg, at, group):
        by_group.setdefault(g, set()).add(segments[s][a : a + 100])
        by_text.setdefault(segments[s][a : a + 100], set()).add(g)
    assert all(len(x) == 1 for x in by_group.values()) and all(len(x) == 1 for x in by_text.values())


def test_crowded_hashes_are_dealt_by_string(docs, monkeypatch):
    monkeypatch.setattr(suffix_collection, "CROWD", 1)
    crowded = sorted((r.doc_id or -1, r.n_removed, r.n_spans) for r in suffix_collection.remove_repeats(docs).collect())
    monkeypatch.undo()
    assert crowded == sorted((r.doc_id or -1, r.n_removed, r.n_spans) for r in suffix_collection.remove_repeats(docs).collect())


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_codec_is_the_library(docs, awkward):
    import sentencepiece

    path = tokenizer_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = piece_codec.encode_and_decode(docs, path).collect()
    assert len(rows) == len(awkward)
    for r in rows:
        ids = model.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.decoded == model.decode(ids) and r.h == 7
    two = piece_codec.decode(piece_codec.encode(docs, path), path).collect()
    assert Counter(map(str, two)) == Counter(map(str, rows))


def test_codec_on_no_rows_and_clashing_columns(spark, no_docs):
    path = tokenizer_path()
    assert piece_codec.encode_and_decode(no_docs, path).columns == [*no_docs.columns, "ids", "decoded"]
    assert piece_codec.encode_and_decode(no_docs, path).count() == 0
    row = piece_codec.encode_and_decode(spark.createDataFrame([("ab", 1, 2)], "text string, ids int, decoded int"), path).first()
    assert row.decoded == "ab" and len(row.ids) % 4 == 0 and len(row) == 3


def test_codec_on_long_texts_with_small_tables(monkeypatch):
    import random

    import sentencepiece

    monkeypatch.setattr(piece_codec, "UNIT_BYTES", 20_000)
    monkeypatch.setattr(piece_codec, "PAIR_BYTES", 20_000)
    path, r = tokenizer_path(), random.Random(9)
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceCodec(path)
    pieces = sorted(own.ids)
    text = " ".join("".join(r.choice(pieces) for _ in range(r.randrange(1, 4))) for _ in range(100_000))
    assert len(text.encode()) > 1_000_000
    ids = model.encode(text, add_bos=True, add_eos=True)
    assert own.encode(text) == ids and own.decode(ids) == model.decode(ids) == piece_codec.PieceDecoder(path).decode(ids)
    assert len(own.units) * piece_codec.ENTRY_BYTES <= 20_000 + 1_000


def test_codec_on_random_texts():
    import random

    import sentencepiece

    path = tokenizer_path()
    model, own, r = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceCodec(path), random.Random(2)
    pieces = sorted(own.ids)
    for i in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(6))) if i % 2 else "".join(r.choice("ab  \n\t▁éß the12\0😀-=__..中") for _ in range(r.randrange(40)))
        ids = model.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text) == ids and own.decode(ids) == model.decode(ids)


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_quality_learns(spark):
    good = [(i, f"This is the sentence number {i} of a calm and ordinary text about rivers. " * 4, 1) for i in range(300)]
    bad = [(1000 + i, f"BUY!!! N0W $$$ {i} ### CLICK!!! " * 6, 0) for i in range(150)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    labels = rows.where("doc_id % 4 != 2").select("doc_id", "quality")
    model = quality.fit(rows.select("doc_id", "text"), labels)
    held = quality.score(rows.where("doc_id % 4 = 2"), model).collect()
    assert np.mean([(r.score >= 0.7) == r.quality for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)
    again = {r.doc_id: r.score for r in quality.score(rows, quality.fit(rows.select("doc_id", "text").repartition(5), labels)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in held)


def test_quality_is_ridge_on_fourier_features_and_isotonic(spark):
    """The whole fit again on one machine: moments, features, normal equations, pooled calibration, and who is learnt from."""
    r = np.random.default_rng(12)
    vocabulary = ["river", "stone", "Light", "of", "the", "x9", "!!!", "BUY", "a,b", "nine"]
    rows = [(i, " ".join(r.choice(vocabulary[: 4 + 3 * (i % 3)], int(r.integers(1, 60)))), int(i % 3 != 2) if r.random() < 0.9 else int(i % 3 == 2)) for i in range(400)]
    rows += [(400, "", 0), (401, None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").unionByName(spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, quality int"))
    model = quality.fit(table.select("doc_id", "text"), labels)
    least = {d: y for d, _, y in rows} | {1: 0}
    folds = {x.doc_id: x.f == 0 for x in table.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'fold'), 3) f").collect()}
    stats = np.array([quality.statistics(t) for _, t, _ in rows])
    y = np.array([least[d] for d, _, _ in rows], float)
    held = np.array([folds[d] for d, _, _ in rows])
    mean, scale = stats.mean(0), stats.std(0)
    scale[scale <= 1e-9] = 1
    z = np.clip((stats - mean) / scale, -6, 6)
    f = np.sqrt(2 / quality.FEATURES) * np.cos(z @ model.projection + model.phase)
    kernel = np.exp(-((z[:50, None] - z[None, :50]) ** 2).sum(-1) / (4 * quality.WIDTH))
    assert np.abs(f[:50] @ f[:50].T - kernel).mean() < 0.06  # the cosines stand for a Gaussian kernel
    f = np.c_[f, np.ones(len(f))]
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    own = ~held
    penalty = np.diag([quality.RIDGE] * quality.FEATURES + [1e-6])
    weights = np.linalg.solve((f[own] * w[own, None]).T @ f[own] + penalty, f[own].T @ (w * y)[own])
    assert np.allclose(weights, model.weights, atol=1e-6)
    raw = f @ weights
    order = np.argsort(raw[held], kind="stable")
    x, label = raw[held][order], y[held][order]
    best = np.array([max(min(label[a : b + 1].mean() for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))])  # the min-max form
    shown = np.interp(x, model.knots, model.levels)
    size = np.array([(best == v).sum() for v in best])
    level = np.maximum.accumulate(np.where(size > 1, (best * size + 0.5) / (size + 1), best))  # levels are drawn towards a half
    assert np.allclose(shown, level, atol=1e-6)
    got = {x.doc_id: x.score for x in quality.score(table, model).collect()}
    assert all(abs(got[d] - np.clip(np.interp(v, model.knots, model.levels), 0, 1)) < 1e-6 for (d, _, _), v in zip(rows, raw))


def test_quality_rows_that_are_held_out_and_clashes(spark):
    rows = [(i, f"text {i}", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    assert quality.score(docs, quality.fit(docs, docs.selectExpr("doc_id", "score quality"))).schema["score"].dataType.simpleString() == "double"
    found = docs.select("doc_id", queries._held_out().alias("h")).collect()
    assert all(x.h == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in found) and any(x.h for x in found)


def test_quality_marked_words_at_any_length():
    for n in (10, 19_998, 20_000, 60_000):
        words = [("a,b", "cd", "(e)~")[i % 3] if i % 5 else "plain" for i in range(n)]
        share = sum(any(c in ",()~" for c in w) for w in words) / n
        assert quality.statistics(" ".join(words))[21] == share


def test_quality_awkward(spark, docs, no_docs):
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, one)).collect()} == {1.0}
    assert quality.score(no_docs, quality.fit(no_docs, one)).count() == 0
    knots, levels = quality.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()


# --- 4 ---------------------------------------------------------------------------------------------------------------


def windows(bench):
    out = {}
    for i, t in bench:
        w = WORD.findall((t or "").translate(UPPER))
        for s in range(max(1, len(w) - 9) if w else 0):
            out.setdefault(tuple(w[s : s + 10]), set()).add("" if i is None else str(i))
    return out


def contained(window, span):
    have = Counter(span)
    return all(have[w] >= n for w, n in Counter(window).items())


def contamination(texts, bench):
    """(n_words, n_hit, items, near) of each (doc_id, text), all windows compared at all places."""
    own, out = windows(bench), Counter()
    for d, t in texts:
        w = WORD.findall((t or "").translate(UPPER))
        hit, items, near = set(), set(), set()
        for k, names in own.items():
            n = len(k)
            for s in range(len(w)):
                if tuple(w[s : s + n]) == k:
                    hit.update(range(s, s + n))
                    items |= names
                if contained(k, w[s : s + n + 5]):
                    near |= names
        out[d, len(w), len(hit), tuple(sorted(items)), tuple(sorted(near - items))] += 1
    return out


def limited(monkeypatch, most):
    if most is not None:
        for name in ("BROADCAST_WINDOWS", "BROADCAST_WORDS", "BROADCAST_DOCS"):
            monkeypatch.setattr(decontamination, name, most)


def told(found):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.near)) for r in found.collect())


@pytest.mark.parametrize("most", [None, -1])
def test_contamination(spark, docs, awkward, monkeypatch, most):
    limited(monkeypatch, most)
    passage = awkward[42][1]
    bench = [(1, " ".join(passage.split()[15:40])), (2, "the"), (3, None), (4, ""), (5, "ab ab " * 10), (1, " ".join(passage.split()[15:40])), (6, "the the the the the the the the the the"), (7, awkward[0][1].upper())]
    short = [(d, t) for d, t in awkward if len(t or "") < 5000]
    found = told(decontamination.report(docs, spark.createDataFrame(bench, "item_id long, text string")))
    want = contamination(short, bench)
    want[73, 3000, 3000, ("2", "6"), ()] += 1
    assert found == want and any(k[2] for k in want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x x one three two four five x x"), (2, "one two three four five"), (3, "one two three four")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "one two three four five")], "item_id long, text string")
    assert {r.doc_id: (len(r["items"]), r.near) for r in decontamination.report(docs, bench).collect()} == {1: (0, ["9"]), 2: (1, []), 3: (0, [])}


@pytest.mark.parametrize("most", [None, -1])
def test_proximity_of_every_window(spark, monkeypatch, most):
    limited(monkeypatch, most)
    item = [f"w{i}" for i in range(30)]
    r = np.random.default_rng(6)
    texts = [" ".join(item[i] for i in [*range(10, 20)][::-1])]
    for _ in range(40):
        low, size = int(r.integers(0, 22)), int(r.integers(8, 14))
        words = [*item[low : low + size], *["x"] * int(r.integers(0, 9))]
        r.shuffle(words)
        texts.append(" ".join(words))
    texts += [" ".join(x for i, x in enumerate(item) if i != 15)] * 2  # w15 is rare
    bench = [(9, " ".join(item)), (8, "w1 w1 w2"), (7, "w3 w4 w5 w3")]
    want = contamination([*enumerate(texts)], bench)
    assert told(decontamination.report(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))) == want
    assert sum(bool(k[4]) for k in want) > 5


def test_one_index_for_many_benchmarks(spark, docs, awkward):
    index = decontamination.stored_postings(docs)
    assert index.count() == sum(len(WORD.findall((t or "").translate(UPPER))) for _, t in awkward)
    for d in (0, 1):
        windows = decontamination.item_windows(spark.createDataFrame([(5, awkward[d][1])], "item_id long, text string"))
        found = decontamination.matches(index, windows).where("exact").select("doc_id").distinct().collect()
        assert d in {r.doc_id for r in found}


def test_contamination_empty(spark, docs, no_docs, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(no_docs, none).count() == 0
    rows = decontamination.report(docs, none).collect()
    assert len(rows) == len(awkward) and all(r.n_hit == 0 and not r["items"] for r in rows)
    assert decontamination.report(no_docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def normal_line(line):
    return " ".join(re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", line.lower()))


def alike_lines(lines):
    """The components of different normalised lines by edit similarity, all pairs compared."""
    names = sorted({normal_line(x) for x in lines} - {""})
    long = [x for x in names if x.count(" ") >= 4]

    def most(a, b):
        return int(0.2 * max(len(a), len(b)) + 1e-9)

    pairs = [(a, b) for i, a in enumerate(long) for b in long[i + 1 :] if abs(len(a) - len(b)) <= most(a, b)]
    return grouped([(a, b) for a, b in pairs if edits(a, b) <= most(a, b)], names)


def lines_kept(awkward, key):
    group = alike_lines([x for _, t in awkward for x in (t or "").split("\n")])
    seen, out = set(), {}
    for d, t in sorted({(last(d), t or "") for d, t in awkward}, key=lambda x: (x[0], key(x))):
        drop = set()
        for i, line in enumerate(t.split("\n")):
            if (g := group.get(normal_line(line))) is not None:
                if g in seen:
                    drop.add(i)
                seen.add(g)
        out[d, t] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop) if drop else t
    return out


@pytest.mark.parametrize("crowded", [line_dedup.CROWDED, 1])
def test_lines(spark, awkward, monkeypatch, crowded):
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    monkeypatch.setattr(common, "FAIR_ROWS", 3)
    rows = [(d, t) for d, t in awkward] + [(90, awkward[5][1].split("\n")[0] + "."), (91, awkward[5][1].split("\n")[0].upper() + "!")]
    hashes = {(last(r.doc_id), r.text or ""): r.h for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) h").collect()}
    want = lines_kept(rows, lambda k: hashes[k])
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text or "") for r in found) == Counter((d, want[last(d), t or ""]) for d, t in rows)
    assert sum(r.n_dropped for r in found) > 5 and sum(r.text is None for r in found) == sum(t is None for _, t in rows)


def test_lines_recall(spark):
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrst"), int(r.integers(2, 9))))
    first, second, many = [], [], []
    for size in (5, 8, 12, 20, 40, 80):
        for _ in range(60):
            base = [word() for _ in range(size)]
            first.append(" ".join(base))
            at = int(r.integers(size))
            second.append(" ".join([*base[:at], base[at][:1] + "z" + base[at][1:], *base[at + 1 :]]))
        for _ in range(30 if size >= 20 else 0):  # one word of ten is another one
            base = [word() for _ in range(size)]
            own = list(base)
            for at in r.choice(size, size // 10, replace=False):
                own[at] = "".join(r.permutation(list(own[at])))
            many.append((" ".join(base), " ".join(own)))
    rows = [*enumerate(first), *((1000 + i, x) for i, x in enumerate(second)), *((2000 + i, a) for i, (a, _) in enumerate(many)), *((3000 + i, b) for i, (_, b) in enumerate(many))]
    found = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[1000 + i] for i in range(len(second))) and not any(found[i] for i in range(len(first)))
    true = [i for i, (a, b) in enumerate(many) if a != b and edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    assert len(true) > 60 and sum(found[3000 + i] for i in true) >= 0.9 * len(true)


def test_lines_are_judged_by_their_edit_distance(spark):
    r = np.random.default_rng(3)
    rows = [("", ""), ("a", ""), ("aaaa", "aaaaa"), ("aaaaa", "aaaaaa"), ("ab", "ba"), ("é" * 9 + "x", "é" * 9 + "y")]
    for _ in range(300):
        x = list(r.choice(list("abé "), int(r.integers(1, 60))))
        y = list(x)
        for _ in range(int(r.integers(0, 14))):
            at = int(r.integers(0, len(y) + 1))
            y[at : at + int(r.integers(0, 2))] = list(r.choice(list("abé "), int(r.integers(0, 3))))
        rows.append(("".join(x), "".join(y)))
    for _ in range(200):  # words put in, taken out and replaced
        x = ["".join(r.choice(list("abé"), int(r.integers(1, 5)))) for _ in range(int(r.integers(1, 25)))]
        y = list(x)
        for _ in range(int(r.integers(0, 4))):
            at = int(r.integers(0, len(y) + 1))
            y[at : at + int(r.integers(0, 3))] = ["zé"] * int(r.integers(0, 3))
        rows.append((" ".join(x), " ".join(y)))
    pairs = spark.createDataFrame(rows, "x string, y string")
    found = pairs.select(line_dedup.alike(F.col("x"), F.col("y"), 0.8).alias("alike"), line_dedup._shifted(F.col("x"), F.col("y")).alias("most"), line_dedup._letters_apart(F.col("x"), F.col("y")).alias("least")).collect()
    assert all(r.least <= edits(a, b) <= r.most for r, (a, b) in zip(found, rows))
    want = [edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in rows]
    assert [r.alike for r in found] == want and 50 < sum(want) < 400


def test_lines_under_one_passage(spark):
    """Lines that begin alike and go on differently are no copies; those among them that go on alike are."""
    r = np.random.default_rng(9)
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrst"), int(r.integers(4, 9))))
    passage = " ".join(word() for _ in range(7))
    lines = []
    for _ in range(40):
        base = [word() for _ in range(20)]
        lines += [f"{passage} {' '.join(base)}", f"{passage} {' '.join([*base[:9], word(), *base[10:]])}"]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(rows).collect()}
    assert found == {i: i % 2 for i in range(80)}


def test_very_long_lines(spark):
    words = [f"w{i}" for i in range(70_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:100], "new", *words[101:]])), (3, " ".join(reversed(words)))]
    found = {x.doc_id: (x.n_lines, x.n_dropped, x.text) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (1, 0, rows[0][1]), 2: (1, 1, ""), 3: (1, 0, rows[2][1])}


@pytest.mark.parametrize("crowded", [line_dedup.CROWDED, 1])
def test_lines_by_edit_similarity(spark, monkeypatch, crowded):
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefghijklmno"), int(r.integers(3, 9))))
    lines = []
    for size in (5, 10, 20, 40):
        for _ in range(4):
            base = [word() for _ in range(size)]
            lines.append(" ".join(base))
            for _ in range(3):
                own = list(base)
                own[int(r.integers(size))] = word()
                lines.append(" ".join(own))
    lines += ["All rights reserved", "menu", "all rights, reserved!", "Menu", "menus", "", ""] + [" ".join(["same"] * n) for n in range(20, 24)]
    normal = [" ".join(WORD.findall(x.translate(UPPER))) for x in lines]
    pairs = [(a, b) for a in set(normal) for b in set(normal) if a < b and min(len(a.split()), len(b.split())) >= 5 and edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    group, seen, want = grouped(pairs, set(normal)), set(), []
    for i, x in enumerate(normal):
        if not x or group[x] not in seen:
            want.append((i, lines[i]))
        seen.add(group[x])
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = line_dedup.dedup_lines(rows).where("n_dropped = 0")
    assert sorted((x.doc_id, x.text) for x in found.collect()) == want and len(want) < 35


def test_lines_keep_other_columns(docs, no_docs):
    out = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()
    clashing = line_dedup.dedup_lines(docs.selectExpr("*", "'x' n_lines", "'y' n_dropped", "0 lid", "0 k"))
    assert clashing.schema["n_lines"].dataType.simpleString() == "bigint" and clashing.where("lid = 0").count() == docs.count()
    assert line_dedup.dedup_lines(no_docs).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGHIJ123456"
    texts = [
        f'é password = "abcdefghijklmnop" {key}', "token:short secret:abcdefghijkl", "password:secret:abcdefghijklmnop", None, "", "deadbeefdeadbeef0 x 0123456789abcdef",
        f"API_KEY='{'q' * 5}Zx9Lm2Pq7' apikey=abcdefghijklmnop", "AKIA12", "日本 token=日本abc token=abcdefabcdef1234",
    ]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)] + [(20 + i, f"widely {key} copied", "en", f"s{i}") for i in range(4)] + [(0, texts[0], "en", "s0"), (None, "passwd: 12charsormore", None, None)]
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.stop) for s in r.base)) for r in found.collect())
    want = Counter()
    for d, t, *_ in rows:
        spans = []
        for k, (kind, pattern, group, least) in enumerate(secret_scan.BASE):
            spans += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern.replace("{16,}", "+"), t or "", re.A) if len(m[group]) >= least]
        want[d, tuple((kind, a, b) for a, _, b, kind in sorted(spans))] += 1
    assert got == want
    verdicts = {(s.kind) for r in found.where("doc_id = 20").collect() for s in r.spans}
    assert verdicts == {"access", "example"}
    assert {s.kind for r in found.where("doc_id is null").collect() for s in r.spans} == {"assign", "live"}
    assert all(len({(s.start, s.stop) for s in r.spans if s.rank > 2}) == len({(s.start, s.stop) for s in r.base}) for r in found.collect())


def test_secrets_by_repositories(spark, monkeypatch):
    monkeypatch.setattr(common, "FAIR_ROWS", 2)
    value = "token=Zx9Lm2Pq7Rt5"
    rows = [(i, value, f"l{i}", f"s{i % 2}") for i in range(5)] + [(10 + i, "token=aabbaabbaabb", "l", "s") for i in range(6)] + [(20, value.replace("Z", "Y"), "l", "s")]
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in found.collect()}
    assert kinds == {**{i: ["assign", "example"] for i in range(5)}, **{10 + i: ["assign", "weak"] for i in range(6)}, 20: ["assign", "live"]}
    assert secret_scan.scan(found.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, size=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies(docs, awkward):
    prints = {t: brute_fingerprint(t) for _, t in awkward}
    distinct = sorted(set(prints.values()))
    group = grouped([(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 4], distinct)
    lowest = {}
    for d, t in awkward:
        g = group[prints[t]]
        lowest[g] = min(lowest.get(g, float("inf")), last(d))
    want = Counter((d, prints[t], lowest[group[prints[t]]]) for d, t in awkward)
    found = simhash_trie.components(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), last(r.component_id)) for r in found) == want


def test_trie_is_brute_force():
    r = np.random.default_rng(8)
    keys = []
    for base in r.integers(0, 1 << 63, 25, dtype=np.uint64):
        for _ in range(int(r.integers(1, 40))):
            k = int(base)
            for b in r.integers(0, 64, int(r.integers(0, 5))):
                k ^= 1 << int(b)
            keys.append(k)
    keys = np.unique(np.array(keys, np.uint64))
    labels = np.arange(len(keys))
    for first, width in simhash_trie._blocks(4):
        turned = keys << np.uint64(first) | keys >> np.uint64(64 - first) if first else keys
        order = np.argsort(turned)
        labels = simhash_trie._united(labels, order, order[simhash_trie.trie_components(turned[order], width, 4)])
    ids = list(range(len(keys)))
    want = grouped([(i, j) for i in ids for j in ids[i + 1 :] if int(keys[i] ^ keys[j]).bit_count() <= 4], ids)
    assert labels.tolist() == [want[i] for i in ids]


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 3000), (5, 5), (None, 4), (7000, 7001)]
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 2000: 1000, 3000: 1000, 7000: 7000, 7001: 7000}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_revisits(spark):
    def full(i, url, ts, etag=None, since=None):
        return (i, url, ts, 200, {k: v for k, v in (("etag", etag), ("last-modified", since), ("content-length", "9"), ("x", "old")) if v}, f"d{i}", 9)

    def again(i, url, ts, etag=None, since=None):
        return (i, url, ts, 304, {k: v for k, v in (("etag", etag), ("last-modified", since), ("content-length", "0"), ("x", "new")) if v}, None, None)

    rows = [
        full(1, "http://www.a.com/p/?utm_source=x", 10, "E1"), full(2, "https://a.com/p", 20, "E2"), again(3, "http://A.com:80/p#f", 25, "W/E2"), again(4, "http://a.com/p", 15, "E2"),
        again(5, "http://a.com/p", 10, "E1"), again(6, "http://b.com/", 99, "E"), full(7, "http://c.com/?b=2&a=1", 1, None, "D"), again(8, "http://c.com/index.html?a=1&b=2", 2, None, "D"),
        again(9, "http://c.com/?a=1&b=2", 3), again(10, None, 3, "E"), again(11, "http://c.com/?a=1&b=2", None, "E"), (12, "http://a.com/p", 30, 404, {}, None, None),
    ]
    rows += [full(100 + i, "http://hot.com/", 1000 + 10 * i, f"H{i}") for i in range(50)] + [again(200 + i, "http://hot.com", 1005 + 10 * i, f"H{i}") for i in range(50)]
    df = spark.createDataFrame(rows + rows[2:3], "record_id long, url string, ts long, status int, headers map<string,string>, digest string, length long")
    got = {r.record_id: r for r in warc_revisit.resolve(df).collect()}
    assert {i: (got[i].response_id, got[i].verdict) for i in (3, 4, 5, 6, 8, 9, 10, 11)} == {
        3: (2, "resolved"), 4: (None, "mismatch"), 5: (None, "none"), 6: (None, "none"), 8: (7, "resolved"), 9: (7, "unchecked"), 10: (None, "none"), 11: (None, "none"),
    }
    assert got[3].headers == {"etag": "W/E2", "content-length": "9", "x": "new"} and got[3].digest == "d2" and got[3].length == 9
    assert all(got[200 + i].response_id == 100 + i and got[200 + i].verdict == "resolved" for i in range(50))
    assert warc_revisit.resolve(df).count() == sum(r[3] == 304 for r in rows) + 1 and warc_revisit.resolve(df.where("false")).count() == 0


def test_warc_files(spark):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\n\r\nhello"
    seen = b"HTTP/1.1 304 Not Modified\r\nETag: \"a\"\r\n\r\n"
    raw = b"".join(b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <%d>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-0%dT00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, i, i, len(x), x) for i, (k, x) in enumerate([(b"response", body), (b"revisit", seen), (b"metadata", b"x")], 1))
    files = spark.createDataFrame([("f", raw), ("g", gzip.compress(raw)), ("h", None)], "path string, content binary")
    found = warc_revisit.parse_records(files)
    assert found.count() == 4 and {bytes(r.payload) for r in found.collect()} == {b"hello", b""}
    assert {r.verdict for r in warc_revisit.resolve(found.where("path = 'f'")).collect()} == {"resolved"}


def test_bad_warc_files_are_rows_with_errors(spark):
    import gzip

    def record(kind, n, body, date="2024-01-01T00:00:00Z", size=None):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{n}>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: {date}\r\nContent-Length: {len(body) if size is None else size}\r\n\r\n".encode() + body + b"\r\n\r\n"

    ok = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\n\r\nhello"
    good, packed = record("response", 1, ok), gzip.compress(record("response", 1, ok) * 50)
    files = [
        ("date", record("response", 1, ok, "yesterday")), ("size", record("response", 1, ok, size="many") + good), ("cut", packed[: len(packed) // 2]),
        ("short", record("response", 1, ok, size=500)), ("garbage", b"\x1f\x8bnothing"), ("same", good + record("revisit", 2, b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\n\r\n", "2024-01-02T00:00:00Z")),
    ]
    found = warc_revisit.parse_records(spark.createDataFrame(files, "path string, content binary"))
    errors = {r.path: r.error for r in found.where("error is not null").collect()}
    assert set(errors) == {"date", "size", "cut", "short", "garbage"} and "Content-Length" in errors["size"] and "WARC-Date" in errors["date"]
    assert found.where("path = 'size' and error is null").count() == 1
    rows = warc_revisit.resolve(found.where("path = 'same'")).collect()  # a revisit of status 200 by its record type
    assert [(r.record_id, r.response_id, r.verdict) for r in rows] == [("<2>", "<1>", "resolved")]
    assert warc_revisit.resolve(found.where("path != 'same'")).count() == 0


def test_very_long_texts(spark):
    r = np.random.default_rng(14)
    words = ["".join(r.choice(list("abcdefghijklmnop"), int(r.integers(2, 9)))) for _ in range(25_000)]
    text = " ".join([*words, "token=Zx9Lm2Pq7Rt5", "cc by"])
    rows = [(1, text, "en", "s"), (2, text, "en", "s"), (3, None, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {x.doc_id: x.n_removed for x in suffix_collection.remove_repeats(docs.select("doc_id", "text")).collect()} == {1: 0, 2: len(text), 3: 0}
    assert all(np.isfinite(quality.statistics(text)))
    bench = spark.createDataFrame([(1, " ".join(words[24_000:24_030]))], "item_id long, text string")
    assert {x.doc_id: (x.n_words, x.n_hit) for x in decontamination.report(docs, bench).collect()} == {1: (25_004, 30), 2: (25_004, 30), 3: (0, 0)}
    assert {x.doc_id: [s.kind for s in x.spans] for x in secret_scan.scan(docs).collect()} == {1: ["assign", "live"], 2: ["assign", "live"], 3: []}
    found = {x.doc_id: (x.fp % 2**64, x.component_id) for x in simhash_trie.components(docs).collect()}
    assert found == {1: (brute_fingerprint(text), 1), 2: (brute_fingerprint(text), 1), 3: (0, 3)}
    assert licence_scan.scan_text(text)[:3] == (25_004, 1, 25_002)


def test_no_rows_and_clashing_columns(spark, docs, no_docs):
    """Columns of the documents that are named like results or inner ones do no harm; no rows give no rows."""
    odd = docs.selectExpr("*", "1 fp", "2 component_id", "3 component", "4 score", "5 n_words", "6 doc", "7 dk", "8 kind", "9 row", "'x' base")
    assert simhash_trie.components(odd).count() == odd.count() and simhash_trie.components(no_docs).count() == 0
    assert suffix_collection.remove_repeats(odd).count() == odd.count() and suffix_collection.remove_repeats(no_docs).count() == 0
    assert secret_scan.scan(odd).count() == odd.count()
    assert simhash_trie.one_of_each_alike(odd).columns == odd.columns
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 5, 6), (2, [1.0, 0.0], 5, 6)], "vec_id long, embedding array<double>, n_links int, component_id int")
    assert {(x.vec_id, x.n_links, x.component_id) for x in vector_graph.near_duplicates(vectors).collect()} == {(1, 1, 1), (2, 1, 1)}


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_licences(docs, awkward):
    texts = ["CC BY, cc-by cc by", "GENERAL public-license general public license", "All rights reserved. éall rights reserved", "xcc by", "SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0)\n", "SPDX-License-Identifier: (MIT", None, ""]
    for text in [*texts, *(t for _, t in awkward)]:
        words = WORD.findall((text or "").translate(UPPER))
        places, labels = [], set()
        for phrase, label in licence_scan.BASE_PHRASES.items():
            p = phrase.split()
            own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        found = licence_scan.scan_text(text)
        assert found[:5] == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(filter(None, found[4].split(","))) <= set(found[5].split(",")) and 0 <= found[6] <= 1
    assert licence_scan.scan_text(texts[4])[5] == "id:apache-2.0,id:gpl-2.0-only with classpath-exception-2.0,id:mit"
    assert licence_scan.scan_text(texts[5])[5] == "unparsed"
    out = licence_scan.scan(docs)
    assert out.count() == len(awkward) and "h" in out.columns and licence_scan.scan(docs.where("false")).count() == 0


def test_expressions():
    assert licence_scan.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licence_scan.postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    assert [licence_scan.postfix(x) for x in ("", "a b", "and", "a or", "(a", "a)", "a ? b")] == [None] * 7
    assert licence_scan.evaluate("MIT AND GPL-3.0-only")[0] == 0.5 and licence_scan.evaluate("MIT OR GPL-3.0-only")[0] == 1.0
    assert licence_scan.evaluate("GPL-2.0-only WITH x")[0] == 0.6 and licence_scan.evaluate("(MIT OR ISC) WITH x") is None
    assert licence_scan.identifier_value("cc-by-nc-4.0") == 0.2 and licence_scan.identifier_value("foo") is None
    assert [licence_scan.identifier_value(x) for x in ("MIT-0", "NCSA", "X11", "BlueOak-1.0.0", "GPL-2.0+")] == [1.0, 1.0, 1.0, 1.0, 0.5]
    assert licence_scan.evaluate("Foo OR GPL-3.0-only")[0] == 0.5 and licence_scan.evaluate("Foo AND MIT")[0] == 1.0 and licence_scan.evaluate("Foo")[0] is None
    assert licence_scan.scan_text("SPDX-License-Identifier: Foo-1.0\nSPDX-License-Identifier: MIT")[5:] == ("id:foo-1.0,id:mit,unknown", 1.0)


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 16))
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.concatenate([base, base[:20] + r.normal(size=(20, 16)) * 0.2, base[:1].repeat(5, 0), base[1:2] * (1 + r.random((40, 1))) + r.normal(size=(40, 16)) * 0.02]))]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] + [1.0] * 15), (504, []), (505, [1.0] * 3), (506, [1.0] * 3), (None, base[0].tolist()), (507, [float("inf")] + [1.0] * 15), (0, base[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n = len(sound)
    links = [(a, b) for a in range(n) for b in range(n) if a != b and len(sound[a][1]) == len(sound[b][1]) and sound[a][1] @ sound[b][1] / np.linalg.norm(sound[a][1]) / np.linalg.norm(sound[b][1]) >= 0.9]
    degree = Counter(a for a, _ in links)
    group = grouped(links, range(n))
    lowest = {}
    for k in range(n):
        lowest[group[k]] = min(lowest.get(group[k], 1 << 60), sound[k][0])
    want = Counter((sound[k][0], degree[k], lowest[group[k]]) for k in range(n))
    alone = Counter(i for i, _ in rows) - Counter(i for i, _ in sound)
    want += Counter({(i, 0, i): c for i, c in alone.items()})
    assert Counter(tuple(r) for r in vector_graph.near_duplicates(df).collect()) == want
    assert vector_graph.near_duplicates(df.where("false")).count() == 0


def test_graph_recall():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    shard = vector_graph.Shard(np.arange(len(x)), x, np.ones(len(x), int), 0.9)
    assert shard.audit(x[:600], np.arange(600)) >= vector_graph.AUDIT_RECALL
    ids, _ = shard.graph.search(x[:200], shard.width)
    assert np.mean([i in ids[i] for i in range(200)]) > 0.98


def test_digest_columns(spark, tmp_path):
    """The thin queries over a folder of tables: one row for each document, digests of the empty case."""
    from quiremill.llm import queries

    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "c d")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.items_sha256 for r in queries.op4_decontamination(spark, str(tmp_path)).collect()} == {empty}
    rows = {r.doc_id: r for r in queries.op7_simhash(spark, str(tmp_path)).collect()}
    assert rows[2].fingerprint == "0" * 16 and rows[1].fingerprint == format(brute_fingerprint("a b"), "016x")
    assert {r.n_tokens for r in queries.op2_sentencepiece(spark, str(tmp_path)).collect()} == {2, 4}
