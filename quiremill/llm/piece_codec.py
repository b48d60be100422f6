"""SentencePiece encoding and decoding by a table of last tokens.

The encoding of every prefix of a text ends in exactly one token. Walking the text
once, an automaton names the tokens that end at each place, and the one that may
follow the last token of the prefix before it is the last token of this prefix; two
tokens may follow each other if merging their joined text gives just these two.
The ids are then read backwards from the end of the table.

Defined results: a null or empty text has the begin and end ids alone and decodes to
the empty text; texts of any length are coded whole; repeated rows and further columns
pass through, but columns named like the results are replaced; an empty table gives
an empty table. Characters without a piece become their UTF-8 byte pieces.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The mark that stands for a space.
SPACE = "▁"
#: Bytes that a worker's tables of known units and pairs take before they start afresh, about.
UNIT_BYTES = 96_000_000
PAIR_BYTES = 48_000_000
#: Bytes of an entry, about: a unit's beside its characters, and a pair's; and the longest unit that is kept.
ENTRY_BYTES = 240
PAIR_ENTRY_BYTES = 140
LONGEST_KEPT = 200
#: Rows that are coded at once; a batch's lists never hold more than these.
ROWS = 256


class _Known(dict):
    """Values computed at their first use; bounded by bytes, so that memory does not grow with the texts.

    Entries are in two generations: a full young one becomes the old one, and what is used again is young again.
    """

    def __init__(self, compute, most: int, size):
        super().__init__()
        self._compute, self._most, self._size, self._held, self._old = compute, most // 2, size, 0, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        size = self._size(key)
        if size:
            if self._held >= self._most:
                self._old, self._held = dict(self), 0
                self.clear()
            self._held += size
            self[key] = value
        return value


def _unit_size(unit: str) -> int:
    """Bytes that a kept unit takes; 0 for one that is too long to be kept."""
    return ENTRY_BYTES + 2 * len(unit) if len(unit) < LONGEST_KEPT else 0


class PieceDecoder:
    """What decoding needs of a byte-fallback BPE model with an identity normaliser: the bytes of each id."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        probe = "  Aßﬁ  ①\t "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models without a normalisation rule, with a leading space, are supported")
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.score = {piece: model.get_score(i) for piece, i in self.ids.items()}

    def decode(self, ids) -> str:
        """Text of ids: control ids give nothing, marks give spaces, the leading space goes."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")

    def decode_packed(self, packed: bytes | None) -> str:
        return self.decode(struct.unpack(f"<{len(packed or b'') // 4}I", packed or b""))


class PieceCodec(PieceDecoder):
    """Encoder and decoder."""

    def __init__(self, model_path: str):
        import ahocorasick

        super().__init__(model_path)
        inner = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids)
        alone = "".join(re.escape(c) for c in "\n\t\r" if not any(c in piece for piece in self.ids))
        # No piece runs over a space after another character, or over a character without a piece.
        self.unit = re.compile("(?s).+" if inner else f"[{alone}]|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        #: The two tokens whose joining makes a token; none for single characters.
        self.halves: dict[str, tuple[str, str]] = {}
        self._whole = {piece for piece in self.ids if self._merged(piece, self.halves) == [piece]}
        joined = [piece for piece in self._whole if len(piece) > 1]
        #: When a token comes to be, as a rank; single characters are there from the start.
        self.made = {piece: -self.score[piece] if len(piece) > 1 else float("-inf") for piece in self._whole}
        #: Pairs can be tested by undoing merges where ranks grow from parts to wholes and do not tie; not for these.
        shared = Counter(self.score[piece] for piece in joined)
        self._odd: set[str] = set()
        for piece in sorted(joined, key=len):
            parts = self.halves[piece]
            if shared[self.score[piece]] > 1 or any(x in self._odd or not self.made.get(x, float("inf")) < self.made[piece] for x in parts):
                self._odd.add(piece)
        #: Tokens by number, with their packed ids; a pair of tokens is one number of two.
        self.tokens = sorted(self._whole)
        self._packed_ids = [self._packed(piece) for piece in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(self.tokens):
            self.automaton.add_word(piece, (number, len(piece)))
        self.automaton.make_automaton()
        self._pairs = _Known(self._numbers_may_follow, PAIR_BYTES, lambda _: PAIR_ENTRY_BYTES)
        self.units = _Known(self._unit_ids, UNIT_BYTES, _unit_size)

    def _merged(self, text: str, halves: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The definition: again and again join the best-scored adjacent pair, the leftmost of equals."""
        symbols: list[str | None] = list(text)
        after = list(range(1, len(symbols) + 1))
        prior = list(range(-1, len(symbols) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols):
                joined = symbols[i] + symbols[j]
                if joined in self.score:
                    heapq.heappush(queue, (-self.score[joined], i, j, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != joined:
                continue
            if halves is not None and len(joined) == len(text):
                halves[joined] = symbols[i], symbols[j]
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[i] < len(symbols):
                prior[after[i]] = i
            offer(prior[i], i)
            offer(i, after[i])
        return [x for x in symbols if x is not None]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two tokens gives just these two."""
        if left in self._odd or right in self._odd:
            return self._merged(left + right) == [left, right]
        return self._undone(left, right)

    def _numbers_may_follow(self, pair: int) -> bool:
        return self.may_follow(self.tokens[pair >> 32], self.tokens[pair & 0xFFFFFFFF])

    def _undone(self, left: str, right: str) -> bool:
        """Go back through the merges next to the border; a joining over it must never have come first."""
        rank, made, halves = self.score.get, self.made, self.halves
        until, shared = float("inf"), False
        while True:
            over = rank(left + right)
            if over is not None and (-over < until or shared and -over == until):
                return False
            if made[left] > made[right]:
                until, shared, left = made[left], False, halves[left][1]
            elif right in halves:  # the later of the two, or the right one of equals
                until, shared, right = made[right], True, halves[right][0]
            else:
                return True

    def _packed(self, piece: str) -> bytes:
        """Ids of one token, or of the bytes of a character without a piece."""
        known = self.ids.get(piece)
        ids = [known] if known is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit_ids(self, text: str) -> bytes:
        """Packed ids of a text of marks and characters, by the table of last tokens."""
        n, pairs = len(text), self._pairs
        last = [-1] * (n + 1)  # -1: a character without a piece, or the start
        for stop, (number, size) in self.automaton.iter(text):
            if last[stop + 1] < 0:
                before = last[stop + 1 - size]
                if before < 0 or pairs[before << 32 | number]:
                    last[stop + 1] = number
        found = []
        while n:
            number = last[n]
            if number < 0:
                n -= 1
                found.append(self._packed(text[n]))
            else:
                n -= len(self.tokens[number])
                found.append(self._packed_ids[number])
        found.reverse()
        return b"".join(found)

    def encode_packed(self, text: str | None) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        edge = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        if not text:
            return edge[0] + edge[1]
        marked = SPACE + text.replace(" ", SPACE)
        return edge[0] + b"".join(map(self.units.__getitem__, self.unit.findall(marked))) + edge[1]

    def encode(self, text: str | None) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@functools.lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """One codec for each worker and model."""
    return PieceCodec(model_path)


@functools.lru_cache(maxsize=2)
def decoder(model_path: str) -> PieceDecoder:
    """One decoder for each worker and model, without the automaton."""
    return PieceDecoder(model_path)


def _with_columns(df: DataFrame, source: str, added: dict[str, T.DataType], compute) -> DataFrame:
    """Append columns that ``compute`` makes from a list of the values of ``source``; the others pass through as they are."""
    kept = [(i, f) for i, f in enumerate(df.schema.fields) if f.name not in added]
    schema = T.StructType([*(f for _, f in kept), *(T.StructField(n, kind) for n, kind in added.items())])
    names, at = [f.name for f in schema.fields], df.columns.index(source)
    kinds = [pa.binary() if kind == T.BinaryType() else pa.string() for kind in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                made = compute(part.column(at).to_pylist())
                columns = [pa.array(x, kind) for x, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i, _ in kept), *columns], names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append the packed ids of a text column; ``model_path`` must be readable on every executor."""
    return _with_columns(df, text, {out: T.BinaryType()}, lambda xs: [list(map(codec(model_path).encode_packed, xs))])


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the text of a column of packed ids."""
    return _with_columns(df, ids, {out: T.StringType()}, lambda xs: [list(map(decoder(model_path).decode_packed, xs))])


def encode_and_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` of its ids in one step, hence with one worker and one codec a core."""

    def made(texts: list[str | None]) -> list[list]:
        one = codec(model_path)
        packed = list(map(one.encode_packed, texts))
        return [packed, list(map(one.decode_packed, packed))]

    return _with_columns(df, text, {ids: T.BinaryType(), decoded: T.StringType()}, made)
