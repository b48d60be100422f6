"""Licence scan: an automaton finds notices and identifier tags, a parser weighs their expressions.

One Aho-Corasick automaton runs over the words of a text, lower-cased and joined by
single spaces, and finds every place where the words of a phrase stand consecutively.
Where the words of an identifier tag stand, the raw text is read for the expressions
that follow it; a shunting-yard parser turns each into postfix order and evaluates it.

Defined results: a null or empty text has no words, no labels and a score of 0;
expressions that do not parse give the label ``unparsed`` and no value, and identifiers
that are not known the label ``unknown`` and no value; overlapping phrases all count;
repeated rows are scanned alike; texts of any length are scanned whole; an empty table
gives an empty table; further columns pass through unless they are named like a result,
which replaces them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The phrases that are always counted, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notices: their words, their label, and how free the text is to use (0 to 1).
NOTICES = {
    "mit license": ("mit", 1.0),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 1.0),
    "redistribution and use in source and binary forms with or without modification": ("bsd", 1.0),
    "apache license version 2 0": ("apache-2.0", 1.0),
    "licensed under the apache license": ("apache-2.0", 1.0),
    "mozilla public license": ("mpl", 0.7),
    "lesser general public license": ("lgpl", 0.6),
    "affero general public license": ("agpl", 0.4),
    "creative commons attribution": ("cc-by", 0.9),
    "creative commons zero": ("cc0", 1.0),
    "public domain": ("public-domain", 1.0),
    "boost software license": ("bsl", 1.0),
    "isc license": ("isc", 1.0),
    "zlib license": ("zlib", 1.0),
    "bsd license": ("bsd", 1.0),
    "artistic license": ("artistic", 0.8),
    "eclipse public license": ("epl", 0.7),
    "common development and distribution license": ("cddl", 0.7),
    "european union public licence": ("eupl", 0.6),
    "open font license": ("ofl", 0.8),
    "open database license": ("odbl", 0.6),
    "gnu free documentation license": ("gfdl", 0.5),
    "server side public license": ("sspl", 0.2),
    "business source license": ("busl", 0.1),
    "this is free and unencumbered software released into the public domain": ("unlicense", 1.0),
    "attribution sharealike": ("cc-by-sa", 0.6),
    "attribution noncommercial": ("cc-by-nc", 0.2),
    "attribution noderivatives": ("cc-by-nd", 0.2),
    "confidential and proprietary": ("proprietary", 0.0),
    "do not distribute": ("proprietary", 0.0),
}
BASE_VALUES = {"cc-by": 0.9, "gpl": 0.5, "reserved": 0.0}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[\x20\t]*:?[\x20\t]*([^\r\n]*)", re.I)

#: How free texts under an identifier are to use: names by themselves, and families by the start of their names; the
#: longest start counts.
NAMES = {
    "0bsd": 1.0, "blessing": 1.0, "bzip2": 1.0, "curl": 1.0, "fsfap": 1.0, "ftl": 0.9, "hpnd": 1.0, "icu": 1.0, "ijg": 1.0, "isc": 1.0,
    "json": 0.8, "libpng": 1.0, "mirros": 1.0, "mit": 1.0, "ms-pl": 0.9, "ms-rl": 0.6, "ncsa": 1.0, "none": 0.0, "noassertion": 0.0,
    "ntp": 1.0, "openssl": 0.9, "postgresql": 1.0, "ruby": 0.8, "sleepycat": 0.5, "sissl": 0.7, "smlnj": 1.0, "ssh-short": 1.0, "tcl": 1.0,
    "unlicense": 1.0, "vim": 0.8, "w3c": 1.0, "wtfpl": 1.0, "x11": 1.0, "xnet": 1.0, "zlib": 1.0,
}
FAMILIES = {
    "afl-": 1.0, "agpl-": 0.4, "apache-": 1.0, "apsl-": 0.7, "artistic-": 0.8, "blueoak-": 1.0, "bsd-": 1.0, "bsl-": 1.0, "busl-": 0.1,
    "cc-by-": 0.9, "cc-by-nc-": 0.2, "cc-by-nd-": 0.2, "cc-by-sa-": 0.6, "cc-pddc": 1.0, "cc0-": 1.0, "cddl-": 0.7, "cecill-": 0.5,
    "cecill-b": 0.9, "cecill-c": 0.6, "cpal-": 0.6, "cpl-": 0.7, "ecl-": 1.0, "efl-": 1.0, "elastic-": 0.1, "epl-": 0.7, "eupl-": 0.6,
    "gfdl-": 0.5, "gpl-": 0.5, "hpnd-": 1.0, "ipl-": 0.7, "lgpl-": 0.6, "licenseref-": 0.1, "lppl-": 0.7, "mit-": 1.0, "mpl-": 0.7,
    "mulanpsl-": 1.0, "nasa-": 0.8, "odbl-": 0.6, "odc-by-": 0.9, "ofl-": 0.8, "osl-": 0.5, "pddl-": 1.0, "php-": 0.9, "polyform-": 0.1,
    "psf-": 1.0, "python-": 1.0, "qpl-": 0.5, "rpl-": 0.4, "sspl-": 0.2, "unicode-": 1.0, "upl-": 1.0, "w3c-": 1.0, "x11-": 1.0,
    "zpl-": 1.0,
}
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
OPERATORS = {"or": 1, "and": 2, "with": 3}
#: How much an exception adds to the value of a licence, which stays at 1 at most.
EXCEPTION_GAIN = 0.1


def identifier_value(name: str) -> float | None:
    """The value of an identifier; None where it is unknown."""
    low = name.lower().rstrip("+")
    if low in NAMES:
        return NAMES[low]
    fitting = [start for start in FAMILIES if low.startswith(start)]
    return FAMILIES[max(fitting, key=len)] if fitting else None


def postfix(expression: str) -> list[str] | None:
    """Tokens in postfix order by the shunting-yard rules; None if the expression is not well formed."""
    rest = TOKEN.sub("", expression).strip()
    tokens = TOKEN.findall(expression)
    if rest or not tokens:
        return None
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in tokens:
        low = token.lower()
        if low in OPERATORS:
            if operand_next:
                return None
            while held and held[-1] != "(" and OPERATORS[held[-1]] >= OPERATORS[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next or held and held[-1] == "with":
                return None
            held.append(token)
        elif token == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[float | None, list[str]] | None:
    """Value and identifiers of an expression: "or" takes the freer side, "and" the stricter, "with" eases.

    An unknown identifier has no value: it leaves that of the other side, and alone none at all.
    """
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[float | None, list[str], bool]] = []
    for token in order:
        if token in OPERATORS:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                if len(right[1]) != 1 or not left[2]:
                    return None
                eased = None if left[0] is None else min(1.0, left[0] + EXCEPTION_GAIN)
                stack.append((eased, [f"{left[1][0]} with {right[1][0]}"], False))
            else:
                known = [x for x in (left[0], right[0]) if x is not None]
                pick = max if token == "or" else min
                stack.append((pick(known) if known else None, left[1] + right[1], False))
        else:
            stack.append((identifier_value(token), [token.lower()], True))
    value, names, _ = stack.pop()
    return value, names


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


#: Bytes of words as they are, in lower case; all others become spaces.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    at, index = 0, 0
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    values: list[float] = []
    tagged = False
    hits = sorted((stop + 1 - len(phrase) - 2, phrase) for stop, phrase in _automaton().iter(joined))
    for start, phrase in hits:
        index += joined.count(" ", at, start)
        at = start
        if phrase in BASE_PHRASES:
            starts.append(index)
            base.add(BASE_PHRASES[phrase])
            values.append(BASE_VALUES[BASE_PHRASES[phrase]])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase][0])
            values.append(NOTICES[phrase][1])
        tagged |= phrase == TAG
    if tagged:
        for line in TAG_LINE.findall(text):
            # Only the expression itself: comment ends and prose after it do not belong to it.
            own = re.split(r"\*/|-->|\x20{2,}", line)[0].strip().rstrip(".;,")
            found = evaluate(own) or evaluate(own.split(" ")[0])
            if found is None:
                labels.add("unparsed")
            else:
                if found[0] is not None:
                    values.append(found[0])
                labels.update(f"id:{name}" for name in found[1])
                if any(identifier_value(name.split(" with ")[0]) is None for name in found[1]):
                    labels.add("unknown")
    score = round(sum(values) / len(values), 6) if values else 0.0
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
    )


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text column by what :func:`scan_text` finds in it."""
    own = [f.name for f in RESULT.fields]
    kept = [(i, f) for i, f in enumerate(df.schema.fields) if f.name != text and f.name not in own]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(scan_text(x.as_py()) for x in batch.column(at)))) or [[]] * len(own)
            made = [pa.array(list(x), kind) for x, kind in zip(found, _ARROW)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, _ in kept), *made], [*(f.name for _, f in kept), *own])

    return df.mapInArrow(run, T.StructType([*(f for _, f in kept), *RESULT.fields]))
