"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Strings of ``width`` bytes are dealt out by the smallest hash of the short strings in
them, so that equal strings meet. Only hashes that come from more than one place go on;
the texts around them are cut into segments, and tasks get all segments of a hash.

A task builds the Burrows-Wheeler transform and the common prefixes of its collection
of segments column by column: in every round each document (a segment, read from one of
``SYMBOL`` offsets) gives its next symbol from the right, the new suffixes' places follow
from the transform so far, their common prefixes from range minima, and both tables are
read from one file and written, with the new rows put in, to the next. In the finished
table a run of common prefixes of ``width`` bytes is a set of equal strings; all but the
first of them are repeats.

Crowds are folded before they move: of equal segments in one batch only the first goes
on, the others are repeats already. A hash with more than ``CROWD`` places is dealt out
again by the whole string.

Defined results: a null or empty text has no bytes and no spans; strings never run from
one document into another; a null doc_id comes after all others; of rows alike in doc_id,
those with a smaller row hash come first; of rows alike in doc_id and text, the second and
later ones are repeats of the first; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm.common import written

WIDTH = 100
#: Length of the strings whose hashes are compared; 2 ** 5.
GRAM = 32
#: Bytes in a symbol; divides the width.
SYMBOL = 10
#: Starts in a segment at most; no fewer than a run with a single place of its hash can have.
STARTS = 72
#: Bytes that are hashed at once, and segments whose collection is built at once.
CHUNK = 1 << 18
BLOCK = 384
#: Places of one hash from which on it is dealt out by whole strings.
CROWD = 20_000
LAST = (1 << 63) - 1

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_TABLE = np.random.default_rng(41).integers(0, 1 << 63, 256, dtype=np.uint64)


def string_starts(raw: np.ndarray, sizes: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of starts that share the smallest hash: (hash, document, first start, number of starts, whether it comes twice)."""
    none = np.zeros(0, np.int64)
    if len(raw) < width or not (sizes >= width).any():
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, bool)
    h, m = _TABLE[raw], 1
    for k in range(gram.bit_length() - 1):
        h = h[:-m] * _MIX[k] + h[m:]
        m *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    reach, low = 1, h
    wanted = width - gram + 1
    while reach * 2 <= wanted:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wanted:
        low = np.minimum(low[: len(low) - (wanted - reach)], low[wanted - reach :])
    offsets = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    least = low[offsets[doc] + start]
    first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    size = np.diff(np.r_[first, len(doc)])
    # A run with two places of its hash may hold equal strings on its own.
    twice = np.zeros(len(first), bool)
    begin = offsets[doc[first]] + start[first]
    for a in range(0, len(first), 1 << 14):
        b, n, value = begin[a : a + (1 << 14)], size[a : a + (1 << 14)], least[first[a : a + (1 << 14)]][:, None]
        leftmost = b + (h[b[:, None] + np.arange(wanted)] == value).argmax(1)
        end = b + n - 1 + wanted - 1
        twice[a : a + (1 << 14)] = leftmost != end - (h[end[:, None] - np.arange(wanted)] == value).argmax(1)
    pieces = -(-size // STARTS)
    if (pieces > 1).any():
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, size = np.repeat(first, pieces) + at * STARTS, np.repeat(size, pieces) - at * STARTS
        size, twice = np.minimum(size, STARTS), np.repeat(twice, pieces)
    return least[first], doc[first], start[first], size, twice


class Tables:
    """Two pairs of files that take turns: one is read from its start while the other is written."""

    def __init__(self, folder: str):
        # Files are overwritten in place: cutting them off would make the file system write them out.
        self.files = [[open(f"{folder}/{name}{turn}", "w+b", buffering=0) for name in ("bwt", "lcp")] for turn in (0, 1)]
        self.turn, self.size, self.kind = 0, 0, np.uint8

    def write(self, symbols: np.ndarray, common: np.ndarray) -> None:
        self.turn ^= 1
        self.size, self.kind = len(symbols), symbols.dtype
        for file, column in zip(self.files[self.turn], (symbols, common)):
            file.seek(0)
            rest = memoryview(np.ascontiguousarray(column)).cast("B")
            while len(rest):
                rest = rest[file.write(rest) :]

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for file, kind in zip(self.files[self.turn], (self.kind, np.uint8)):
            file.seek(0)
            out.append(np.fromfile(file, kind, self.size))
        return out[0], out[1]

    def close(self) -> None:
        for pair in self.files:
            for file in pair:
                file.close()


class Collection:
    """Transform and common prefixes of right-aligned documents of symbols, kept in files and built column by column."""

    def __init__(self, columns: np.ndarray, tables: Tables):
        """``columns[i, j]`` is document i's j-th symbol from the right, 0 where it has none."""
        self.count, self.tables = len(columns), tables
        nothing = np.zeros(self.count, columns.dtype)
        self.dtype = columns.dtype
        self.tables.write(columns[:, 0] if columns.shape[1] else nothing, np.zeros(self.count, np.uint8))
        at = np.arange(self.count)
        for j in range(columns.shape[1]):
            following = columns[:, j + 1] if j + 1 < columns.shape[1] else nothing
            live = np.flatnonzero(columns[:, j])
            if not len(live):
                break
            at[live] = self._insert(at[live], following[live])

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        return self.tables.read()

    def _insert(self, rows: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Extend the suffixes at the given rows by their symbols; the places of the new suffixes."""
        symbols, common = self.read()
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        ended = n - int(np.count_nonzero(symbols))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        k = rank[rows]
        place = self.count + k - ended
        # Common prefixes with the suffix before and with the one after, where these begin alike.
        levels = n.bit_length()
        minima = np.zeros((levels, n), np.uint8)
        minima[0] = common
        for v in range(1, levels):
            half = 1 << (v - 1)
            np.minimum(minima[v - 1, : n - half], minima[v - 1, half:], out=minima[v, : n - half])

        def least(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            level = np.frexp((high - low + 1).astype(np.float32))[1] - 1
            return np.minimum(minima[level, low], minima[level, high + 1 - (1 << level)])

        before = order[np.maximum(k - 1, 0)]
        alike = (k > 0) & (symbols[before] == symbols[rows])
        own = np.zeros(len(rows), np.uint8)
        own[alike] = 1 + np.minimum(least(before[alike] + 1, rows[alike]), 254)
        after = order[np.minimum(k + 1, n - 1)]
        alike = (k + 1 < n) & (symbols[after] == symbols[rows]) & (after > rows)
        nexts = least(rows[alike] + 1, after[alike])
        grown = np.ones(n + len(rows), bool)
        grown[place] = False
        merged = np.empty(n + len(rows), self.dtype)
        merged[grown] = symbols
        merged[place] = following
        prefix = np.empty(n + len(rows), np.uint8)
        prefix[grown] = common
        prefix[place[alike] + 1] = 1 + np.minimum(nexts, 254)
        prefix[place] = own
        self.tables.write(merged, prefix)
        return place

    def suffix_rows(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, documents, rows of their suffixes of that length), by stepping through the finished transform."""
        symbols, _ = self.read()
        order = np.argsort(symbols, kind="stable")
        ended = len(symbols) - int(np.count_nonzero(symbols))
        step = np.full(len(symbols), -1, np.int64)
        step[order[ended:]] = self.count + np.arange(len(symbols) - ended)
        documents = rows = np.arange(self.count)
        for length in range(1, longest + 1):
            rows = step[rows]
            documents, rows = documents[rows >= 0], rows[rows >= 0]
            yield length, documents, rows


def _symbols(raw: np.ndarray, q: int) -> np.ndarray:
    """A number for the ``q`` bytes from each place on; equal numbers are equal bytes."""
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    digit = np.zeros(256, np.uint64)
    digit[used] = np.arange(len(used))
    digits, base, n = digit[raw], len(used), len(raw) - q + 1
    out, largest = np.zeros(n, np.uint64), 1
    for k in range(q):
        if largest * base >= 1 << 64:
            # Too many for one number: those so far are numbered anew.
            values, out = np.unique(out, return_inverse=True)
            out, largest = out.astype(np.uint64), len(values)
        out = out * np.uint64(base) + digits[k : n + k]
        largest *= base
    return out


def equal_strings(segments: list[bytes], starts: np.ndarray, tables: Tables, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, class) for every start of every segment; equal classes are equal strings of ``width`` bytes."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    raw = np.frombuffer(b"".join(segments), np.uint8)
    offset = np.cumsum(sizes) - sizes
    q = SYMBOL
    words = _symbols(raw, q)
    segment = np.repeat(np.arange(len(segments)), q)
    phase = np.tile(np.arange(q), len(segments))
    lengths = np.maximum(sizes[segment] - phase, 0) // q
    longest = int(lengths.max())
    back = np.arange(longest)
    where = (offset[segment] + phase + (lengths - 1) * q)[:, None] - back * q
    real = back < lengths[:, None]
    values, codes = np.unique(words[where[real]], return_inverse=True)
    columns = np.zeros((len(segment), longest), np.uint16 if len(values) < 65535 else np.uint32)
    columns[real] = codes + 1
    made = Collection(columns, tables)
    _, common = made.read()
    classes = np.cumsum(common < width // q)
    found = []
    for length, documents, rows in made.suffix_rows(longest):
        if length >= width // q:
            s = phase[documents] + (lengths[documents] - length) * q
            ok = s < starts[segment[documents]]
            found.append((segment[documents[ok]], s[ok], classes[rows[ok]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _packed(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns.keys()))


def _groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, positions) of each distinct key."""
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else []
    for a, b in zip(cut, np.r_[cut[1:], len(key)] if len(key) else []):
        yield int(key[order[a]]), order[a:b]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a batch that fit a processor's cache: first row, bytes, sizes; texts stay whole."""
    texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column("text")]
    low, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK or i + 1 == len(texts):
            some = texts[low : i + 1]
            yield low, np.frombuffer(b"".join(some), np.uint8), np.fromiter(map(len, some), np.int64, len(some))
            low, held = i + 1, 0


#: Columns of packed arrays and the types of their numbers. A row is known by its doc_id and by ``dk``, a hash of doc_id and text.
_KINDS = {"dk": np.int64, "doc": np.int64, "start": np.int32, "low": np.int32, "high": np.int32, "count": np.uint8, "crowded": np.uint8}


def _column(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    if name == "key":
        return _keys(b"".join(x.as_py() for b in batches for x in b.column(name)))
    return np.frombuffer(b"".join(x.as_py() for b in batches for x in b.column(name)), _KINDS[name])


def _key_bytes(key: np.ndarray) -> bytes:
    """The upper six bytes of each hash; the lower ones have named the bucket."""
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bucket(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)


def _places_by_hash(parts: int):
    """(dk, text) to packed places by bucket of their hash; those whose hash comes twice in a batch are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dks = batch.column("dk").to_numpy()
            made = [(low, string_starts(raw, sizes)) for low, raw, sizes in _texts(batch)]
            if not made:
                continue
            key, doc, start, count, twice = (np.concatenate(x) for x in zip(*((k, d + low, *rest) for low, (k, d, *rest) in made)))
            if not len(key):
                continue
            # What is repeated within a batch needs no witness from elsewhere.
            _, index, times = np.unique(key >> np.uint64(16), return_inverse=True, return_counts=True)
            known = (np.bincount(index, weights=twice) + times)[index] > 1
            marked = count.astype(np.uint8) | known.astype(np.uint8) << np.uint8(7)
            out = [
                (b, _key_bytes(key[rows]), dks[doc[rows]].tobytes(), start[rows].astype(np.int32).tobytes(), marked[rows].tobytes())
                for b, rows in _groups(_bucket(key, parts))
            ]
            columns = list(zip(*out))
            yield _packed(bucket=pa.array(columns[0], pa.int64()), **{n: pa.array(c, pa.binary()) for n, c in zip(("key", "dk", "start", "count"), columns[1:])})

    return run


def _repeated(parts: int):
    """Of all places of this task's hashes those whose hash has another place, packed by bucket of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        key, dk, start, count = (_column(held, n) for n in ("key", "dk", "start", "count"))
        _, index = np.unique(key, return_inverse=True)
        # Rows alike in everything are one place.
        order = np.lexsort((start, dk, index))
        fresh = np.r_[True, (index[order][1:] != index[order][:-1]) | (dk[order][1:] != dk[order][:-1]) | (start[order][1:] != start[order][:-1])]
        places = np.bincount(index[order[fresh]])
        known = np.bincount(index, weights=count >> 7) > 0
        keep = order[fresh]
        keep = keep[(places[index[keep]] > 1) | known[index[keep]]]
        crowded = (places > CROWD)[index].astype(np.uint8)
        count = count & np.uint8(127)
        for b, rows in _groups(np.mod(dk[keep], parts)):
            rows = keep[rows]
            made = (_key_bytes(key[rows]), dk[rows].tobytes(), start[rows].tobytes(), count[rows].tobytes(), crowded[rows].tobytes())
            yield _packed(b=pa.array([b], pa.int64()), **{n: pa.array([x], pa.binary()) for n, x in zip(("key", "dk", "start", "count", "crowded"), made)})

    return run


def _streamed(batches: Iterator[pa.RecordBatch], packed: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray], np.ndarray]]:
    """(document rows, the packed columns of their bucket in order of dk, whether each row repeats the row before it).

    A partition is sorted by bucket, with the packed rows before the documents.
    """
    bucket, gathered, known, last = None, [], None, None
    for batch in batches:
        buckets, kinds = batch.column("b").to_numpy(), batch.column("kind").to_numpy()
        cut = np.flatnonzero(np.r_[True, (buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1])])
        for low, high in zip(cut, np.r_[cut[1:], batch.num_rows]):
            part = batch.slice(int(low), int(high - low))
            if buckets[low] != bucket:
                bucket, gathered, known = buckets[low], [], None
            if kinds[low] == 0:
                gathered.append(part)
                continue
            if known is None:
                known = {n: _packed_column(gathered, n) for n in packed}
                order = np.argsort(known["dk"], kind="stable")
                known = {n: x[order] for n, x in known.items()}
                gathered = []
            doc, dk = part.column("doc").to_numpy(), part.column("dk").to_numpy()
            again = np.r_[last == (doc[0], dk[0]), (doc[1:] == doc[:-1]) & (dk[1:] == dk[:-1])]
            last = (doc[-1], dk[-1])
            yield part, known, again


def _packed_column(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    raw = b"".join(x.as_py() for b in batches for x in b.column(f"p_{name}"))
    return _keys(raw) if name == "key" else np.frombuffer(raw, _KINDS[name])


def _ranges(dk: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, parts: int) -> Iterator[tuple]:
    """Ranges that are repeats, packed by bucket of their document."""
    for b, rows in _groups(np.mod(dk, parts)):
        yield b, dk[rows].tobytes(), doc[rows].tobytes(), low[rows].astype(np.int32).tobytes(), high[rows].astype(np.int32).tobytes()


_SEGMENT = ("key", "dk", "doc", "start", "count", "blob")
_RANGE = ("r_dk", "r_doc", "r_low", "r_high")


def _segment_batch(bucket, segments=None, ranges=None) -> pa.RecordBatch:
    nothing = [None] * len(bucket)
    both = {**dict(zip(_SEGMENT, segments or [nothing] * 6)), **dict(zip(_RANGE, ranges or [nothing] * 4))}
    return _packed(bucket=pa.array(bucket, pa.int64()), **{n: pa.array(x, pa.binary()) for n, x in both.items()})


def _segments(parts: int):
    """Documents and their places to segments by hash, each once in a batch, and to ranges that are repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, places, again in _streamed(batches, ("key", "dk", "start", "count", "crowded")):
            first: dict[bytes, tuple] = {}
            done: list[tuple] = []
            docs, dks = part.column("doc").to_numpy(), part.column("dk").to_numpy()
            lows, highs = np.searchsorted(places["dk"], dks), np.searchsorted(places["dk"], dks, side="right")
            texts = part.column("text")
            for i in np.flatnonzero((highs > lows) & ~again):
                text = (texts[int(i)].as_py() or "").encode("utf-8", "surrogatepass")
                doc, dk, own = int(docs[i]), int(dks[i]), slice(lows[i], highs[i])
                for k, s, c, crowded in zip(*(places[n][own].tolist() for n in ("key", "start", "count", "crowded"))):
                    for a, n in [(s + x, 1) for x in range(c)] if crowded else [(s, c)]:
                        piece = text[a : a + n + WIDTH - 1]
                        if len(piece) < n + WIDTH - 1:
                            continue  # the place of another row with the same hash
                        if crowded:
                            k = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "big")
                        now = (doc, dk, a, n, k)
                        held = first.setdefault(piece, now)
                        if held[:3] != now[:3]:
                            if now[:3] < held[:3]:
                                first[piece], now = now, held
                            done.append((now[1], now[0], now[2], now[2] + n + WIDTH - 1))
            if done:
                found = list(zip(*_ranges(*(np.array(x, np.int64) for x in zip(*done)), parts)))
                yield _segment_batch(found[0], None, found[1:])
            if not first:
                continue
            pieces = list(first)
            doc, dk, start, count, key = (np.array(x, t) for x, t in zip(zip(*first.values()), (np.int64, np.int64, np.int32, np.uint8, np.uint64)))
            out = [
                (b, _key_bytes(key[rows]), dk[rows].tobytes(), doc[rows].tobytes(), start[rows].tobytes(), count[rows].tobytes(), b"".join([pieces[r] for r in rows]))
                for b, rows in _groups(_bucket(key, parts))
            ]
            columns = list(zip(*out))
            yield _segment_batch(columns[0], columns[1:])

    return run


def _search(parts: int):
    """Segments of this task's hashes to the ranges that are repeats, packed by bucket of their document."""

    def shown(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found))
        return _packed(b=pa.array(columns[0], pa.int64()), **{n: pa.array(x, pa.binary()) for n, x in zip(("dk", "doc", "low", "high"), columns[1:])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            passed = ~np.asarray(batch.column("r_dk").is_null())
            if passed.any():
                some = batch.filter(pa.array(passed))
                yield _packed(b=some.column("bucket"), dk=some.column("r_dk"), doc=some.column("r_doc"), low=some.column("r_low"), high=some.column("r_high"))
            if not passed.all():
                held.append(batch.filter(pa.array(~passed)))
        if not held:
            return
        key, dk, doc, start, count = (_column(held, n) for n in ("key", "dk", "doc", "start", "count"))
        start, count = start.astype(np.int64), count.astype(np.int64)
        size = count + WIDTH - 1
        blob = b"".join(x.as_py() for b in held for x in b.column("blob"))
        held.clear()
        at = np.cumsum(size) - size
        order = np.lexsort((start, dk, doc, key))
        cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        ends = np.r_[cut[1:], len(order)]
        out: list[list[np.ndarray]] = []
        with tempfile.TemporaryDirectory(prefix="collection-", dir=os.environ.get("TMPDIR")) as folder, contextlib.closing(Tables(folder)) as tables:
            low = 0
            while low < len(cut):
                high = low + 1
                while high < len(cut) and ends[high] - cut[low] <= BLOCK:
                    high += 1
                rows = order[cut[low] : ends[high - 1]]
                low = high
                # Equal segments, in order of their places: the first stands for all, the others are repeats.
                first: dict[bytes, int] = {}
                copies = []
                for r in rows.tolist():
                    if first.setdefault(blob[at[r] : at[r] + size[r]], r) != r:
                        copies.append(r)
                own = np.fromiter(first.values(), np.int64, len(first))
                seg, s, group = equal_strings(list(first), count[own], tables)
                who = own[seg]
                place = start[who] + s
                by = np.lexsort((place, dk[who], doc[who], group))
                repeat = np.r_[False, group[by][1:] == group[by][:-1]]
                who, place = who[by[repeat]], place[by[repeat]]
                by = np.lexsort((place, who))
                who, place = who[by], place[by]
                fresh = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1)]) if len(who) else np.zeros(0, int)
                last = np.r_[fresh[1:], len(who)][: len(fresh)] - 1
                copies = np.array(copies, np.int64)
                row = np.r_[who[fresh], copies]
                out.append([dk[row], doc[row], np.r_[place[fresh], start[copies]], np.r_[place[last] + WIDTH, start[copies] + size[copies]]])
        columns = [np.concatenate(x) for x in zip(*out)]
        if len(columns[0]):
            yield shown(list(_ranges(*columns, parts)))

    return run


def _joined_spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ranges in order, those that touch as one."""
    order = np.argsort(low, kind="stable")
    low, top = low[order].astype(np.int64), np.maximum.accumulate(high[order].astype(np.int64))
    begins = np.flatnonzero(np.r_[True, low[1:] > top[:-1]]) if len(low) else np.zeros(0, int)
    return np.c_[low[begins], top[np.r_[begins[1:], len(low)][: len(begins)] - 1]]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and their ranges to what is removed and what is kept."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for part, known, again in _streamed(batches, ("dk", "doc", "low", "high")):
        docs, dks = part.column("doc").to_numpy(), part.column("dk").to_numpy()
        lows, highs = np.searchsorted(known["dk"], dks), np.searchsorted(known["dk"], dks, side="right")
        out = []
        for i, value in enumerate(part.column("text")):
            raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
            if again[i] and len(raw) >= WIDTH:
                spans = np.array([[0, len(raw)]])
            else:
                own = slice(lows[i], highs[i])
                mine = known["doc"][own] == docs[i]
                spans = _joined_spans(known["low"][own][mine], known["high"][own][mine])
            kept, last = [], 0
            for a, b in spans.tolist():
                kept.append(raw[last:a])
                last = b
            kept.append(raw[last:])
            out.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), b"".join(kept), [{"start": a, "stop": b} for a, b in spans.tolist()]))
        n, gone, count, kept, spans = list(zip(*out))
        yield _packed(
            doc_id=part.column("doc_id"), n_bytes=pa.array(n, pa.int64()), n_removed=pa.array(gone, pa.int64()), n_spans=pa.array(count, pa.int64()),
            kept=pa.array(kept, pa.binary()), spans=pa.array(spans, span),
        )


def _beside(base: DataFrame, packed: DataFrame, columns: tuple[str, ...], parts: int) -> DataFrame:
    """Documents and the packed rows of their buckets in one partition, sorted as :func:`_streamed` reads them."""
    left = base.select("*", F.pmod("dk", F.lit(parts)).cast("long").alias("b"), F.lit(1).alias("kind"))
    right = packed.select("b", F.lit(0).alias("kind"), *[F.col(c).alias(f"p_{c}") for c in columns])
    return left.unionByName(right, allowMissingColumns=True).repartition(parts, "b").sortWithinPartitions("b", "kind", "doc", "dk")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")
    base = base.withColumn("dk", F.xxhash64("doc", "text"))
    names = ("key", "dk", "start", "count")
    buckets = base.select("dk", "text").mapInArrow(_places_by_hash(parts), "bucket long, " + ", ".join(f"{n} binary" for n in names))
    repeated = buckets.repartition(parts, "bucket").select(*names).mapInArrow(_repeated(parts), "b long, " + ", ".join(f"{n} binary" for n in (*names, "crowded")))
    repeated = written(repeated, "repeated-places")
    cut = _beside(base.select("dk", "doc", "text"), repeated, (*names, "crowded"), parts)
    segments = cut.mapInArrow(_segments(parts), "bucket long, " + ", ".join(f"{n} binary" for n in (*_SEGMENT, *_RANGE)))
    ranges = segments.repartition(parts, "bucket").mapInArrow(_search(parts), "b long, dk binary, doc binary, low binary, high binary")
    ranges = written(ranges, "repeated-ranges")
    both = _beside(base, ranges, ("dk", "doc", "low", "high"), parts)
    found = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_cleaned, f"doc_id {found}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,stop:long>>")
