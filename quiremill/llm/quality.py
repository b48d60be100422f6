"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text is described by a fixed list of statistics. Cosines of random projections of
these approximate a Gaussian kernel; ridge weights solve the normal equations, which
every partition sums on its own; a monotone step function, fitted by pooling adjacent
violators on labelled rows that the ridge has not seen, turns raw scores into
probabilities.

The fit reads at most about ``SAMPLE`` labelled rows (a documented bound: above it,
rows are kept by a hash of their id at the rate that gives this number). Scoring reads
every row and the whole of every text.

Defined results: a null or empty text has the statistics of an empty text and a score
like any other; labels that are null, or whose id is null, are not learnt from; several
labels of one id count as their lowest; without labels of both kinds every score is the
share of label 1, or 0.5 where there is none; repeated rows are scored alike; texts of
any length have the same statistics; an empty table gives an empty table; other columns
pass through, but one named like the score is replaced by it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiremill.llm.common import written

#: Labelled rows that a fit reads at most (as an expected number).
SAMPLE = 40_000
FEATURES = 384
RIDGE = 1.0
SEED = 20_240_601
#: Partitions that sum normal equations; a constant, as the sample is bounded.
FIT_PARTITIONS = 12

_MARKS = b".,;:!?'\"()[]{}<>|/\\#$%&*@=_+-~^`"
#: Every mark as one byte, so that a word with any mark is found by one search.
_MARKED = bytes.maketrans(_MARKS, b"!" * len(_MARKS))
_LONG_RUN = re.compile(rb"([^\sA-Za-z0-9\x80-\xff])\1\1")


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; none depends on anything but the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if size else np.zeros(256, np.int64)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    digits, wide = int(counts[48:58].sum()), int(counts[128:].sum())
    control = int(counts[:9].sum() + counts[14:32].sum() + counts[127])
    words = raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 0
    lines = raw.split(b"\n")
    full = [x for x in lines if x]
    some = max(size, 1)
    letters = max(upper + lower, 1)
    marks = [int(counts[b]) / some for b in _MARKS]
    runs = len(_LONG_RUN.findall(raw))
    packed = len(zlib.compress(raw, 1)) / some if size else 1.0
    return [
        np.log1p(size), np.log1p(n), np.log1p(len(full)), size / max(n, 1), float(lengths.mean()), float(lengths.std()),
        np.log1p(float(lengths.max())), float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        upper / letters, digits / some, wide / some, control / some, (int(counts[32]) + int(counts[9])) / some,
        distinct / max(n, 1), pairs / max(n - 2, 1), len(set(full)) / max(len(full), 1), n / max(len(full), 1),
        sum(w[:1].isupper() for w in words) / max(n, 1), sum(w.isupper() for w in words) / max(n, 1),
        sum(w[-1] in _MARKS for w in words) / max(n, 1), sum(b"!" in w for w in raw.translate(_MARKED).split()) / max(n, 1),
        sum(not w.isalpha() for w in words) / max(n, 1), np.log1p(1000 * runs / some), runs / max(n, 1), packed, *marks,
    ]


WIDTH = len(statistics(""))


@dataclass
class Model:
    """What scoring needs; a few hundred kilobytes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.sqrt(2 / len(self.phase)) * np.cos(z @ self.projection + self.phase)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        f = self.features(stats)
        return np.c_[f, np.ones(len(f))] @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the best monotone fit, by pooling adjacent violators; ties are pooled first."""
    values, where = np.unique(raw, return_inverse=True)
    weight = np.bincount(where).astype(float)
    total = np.bincount(where, weights=label)
    blocks: list[list[float]] = []  # sum, weight, first raw, last raw
    for x, w, t in zip(values, weight, total):
        blocks.append([t, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, w2, _, last = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += w2
            blocks[-1][3] = last
    knots, levels = [], []
    for t, w, first, last in blocks:
        level = (t + 0.5) / (w + 1) if w > 1 else t / w
        for x in dict.fromkeys((first, last)):
            knots.append(x)
            levels.append(level)
    return np.array(knots), np.maximum.accumulate(np.array(levels))


def _with_statistics(df: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    kind = T.StructType([df.schema["doc_id"], T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return df.select("doc_id", "text").mapInArrow(run, kind)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (doc_id and the label column, 1 for good); texts come from ``docs``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    # At most about ``sample`` rows of 16 bytes: bounded by the parameter, whatever the corpus.
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    found = found.withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0)
    ids = found.select("doc_id", "y", "calibrate", "text")

    def stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stats, pa.list_(pa.float64()))], ["y", "calibrate", "stats"])

    rows = ids.select("y", "calibrate", "text").mapInArrow(stats_of, "y double, calibrate boolean, stats array<double>")
    rows = written(rows, "quality-sample")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, WIDTH))
        n, ones = 0, 0.0
        for batch in batches:
            x = _matrix(batch.column(2))
            out += [x.sum(0), (x * x).sum(0)]
            n += len(x)
            ones += float(np.asarray(batch.column(0)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([ones]), pa.array([out.tobytes()])], ["n", "ones", "sums"])

    # Bounded results: a row of some hundred bytes from each of a constant number of partitions.
    parts = rows.coalesce(FIT_PARTITIONS).mapInArrow(moments, "n long, ones double, sums binary").collect()
    n, ones = sum(r.n for r in parts), sum(r.ones for r in parts)
    generator = np.random.default_rng(SEED)
    width = 1.0 / np.sqrt(2 * WIDTH)
    projection = generator.normal(0.0, width, (WIDTH, FEATURES))
    phase = generator.uniform(0, 2 * np.pi, FEATURES)
    if n == 0 or ones in (0, n):
        level = ones / n if n else 0.5
        flat = np.zeros(FEATURES + 1)
        return Model(np.zeros(WIDTH), np.ones(WIDTH), projection, phase, flat, np.array([0.0]), np.array([level]))
    sums = sum(np.frombuffer(r.sums).reshape(2, WIDTH) for r in parts)
    mean = sums[0] / n
    scale = np.sqrt(np.maximum(sums[1] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), projection, phase, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    weigh = {0.0: n / (2 * (n - ones)), 1.0: n / (2 * ones)}

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            mine = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            y = np.asarray(batch.column(0))[mine]
            f = model.features(_matrix(batch.column(2))[mine])
            f = np.c_[f, np.ones(len(f))]
            w = np.where(y > 0, weigh[1.0], weigh[0.0])
            left += (f * w[:, None]).T @ f
            right += f.T @ (w * y)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], ["a", "b"])

    a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    for r in rows.coalesce(FIT_PARTITIONS).mapInArrow(equations, "a binary, b binary").toLocalIterator():
        a += np.frombuffer(r.a).reshape(a.shape)
        b += np.frombuffer(r.b)
    penalty = np.eye(FEATURES + 1) * RIDGE
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(a + penalty, b)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            raw = model.raw(_matrix(batch.column(2))[mine])
            yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(np.asarray(batch.column(0))[mine])], ["raw", "y"])

    # Two numbers for each row of the bounded sample's calibration fold.
    held = rows.mapInArrow(judged, "raw double, y double").toPandas()
    if len(held):
        model.knots, model.levels = isotonic(held.raw.to_numpy(), held.y.to_numpy())
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Append the calibrated score of every whole text; other columns pass through."""
    kept = [(i, f) for i, f in enumerate(docs.schema.fields) if f.name != out]
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a constant size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(x.as_py()) for x in batch.column(at)]).reshape(-1, WIDTH)
            made = pa.array(shared.value.scores(stats), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, _ in kept), made], [*(f.name for _, f in kept), out])

    return docs.mapInArrow(run, T.StructType([*(f for _, f in kept), T.StructField(out, T.DoubleType())]))
