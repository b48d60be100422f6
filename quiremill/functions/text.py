"""Text functions as column expressions: tokens, hashes, windows, markup."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as documents know it, beyond the ASCII class of the regex engine.
SPACES = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# What marks page footers.
BOILERPLATE = r"(?i)page \d+ of \d+|copyright ©|\(c\)\s*\d{4}|all rights reserved"
# Sources of images without content, while parsing and while cleaning trees.
DECORATIVE = r"(?i)pixel|tracking|spacer|blank|1x1|badge|icon|spinner|logo|avatar|thumb|loading"
DECORATIVE_RULE = r"(?i)pixel|tracking|spacer|blank|1x1|badge|icon|spinner|loading|analytics"

SEGMENTS = r"[A-Za-z0-9_']+|[^A-Za-z0-9_\s]+"
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fast_tokens(text: Column) -> Column:
    """Estimated tokens: 3.5 characters each within a run of word characters or of marks."""
    runs = F.regexp_extract_all(text, F.lit(SEGMENTS), F.lit(0))
    cost = F.transform(runs, lambda x: F.greatest(F.lit(1), F.ceil(F.length(x) / 3.5)).cast("long"))
    return F.aggregate(cost, F.lit(0).cast("long"), lambda a, x: a + x)


def model_tokens(text: Column) -> Column:
    """Estimated tokens of larger vocabularies: 4 characters each, one for each ideograph of a run that has some."""
    runs = F.regexp_extract_all(text, F.lit(SEGMENTS), F.lit(0))
    cost = F.transform(
        runs, lambda x: F.when(x.rlike(CJK), F.length(x).cast("long")).otherwise(F.greatest(F.lit(1), F.ceil(F.length(x) / 4)).cast("long"))
    )
    total = F.aggregate(cost, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(trim_all(text) == "", F.lit(0).cast("long")).otherwise(F.greatest(total, F.lit(1).cast("long")))


def fast_token_ids(text: Column) -> Column:
    """Places of the estimated tokens within their runs."""
    runs = F.regexp_extract_all(text, F.lit(SEGMENTS), F.lit(0))
    return F.flatten(F.transform(runs, lambda x: F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length(x) / 3.5)).cast("int") - 1)))


TOKENIZERS = {"fast-bpe": fast_tokens, "cl100k_base": model_tokens, "o200k_base": model_tokens, "words": word_count}
MODELS = {"gpt-4": "cl100k_base", "gpt-4-turbo": "cl100k_base", "gpt-3.5-turbo": "cl100k_base", "gpt-4o": "o200k_base", "gpt-4o-mini": "o200k_base"}


def token_count(text: Column, tokenizer: str = "fast-bpe") -> Column:
    """By a tokenizer's or a model's name; unknown names count as the first."""
    name = MODELS.get(tokenizer.lower(), tokenizer)
    return TOKENIZERS.get(name, fast_tokens)(text)


def register_tokenizer(name: str, count) -> None:
    """``count`` makes a column of token counts from a text column."""
    TOKENIZERS[name] = count


@functools.cache
def _hasher(seed: int, factor: int):
    """The fold h * factor + code over UTF-16 units as a sum of units times powers, wrapped at 32 bits.

    A fold in the JVM boxes every character as a string; over Arrow it is one product of arrays.
    """

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        held = np.ones(1, np.uint32)

        def one(text: str | None) -> int | None:
            nonlocal held
            if text is None:
                return None
            units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
            n = len(units)
            if len(held) <= n:
                held = np.cumprod(np.r_[np.uint32(1), np.full(2 * n, factor, np.uint32)], dtype=np.uint32)
            total = (int(np.sum(units * held[:n][::-1], dtype=np.uint32)) + seed * int(held[n])) & 0xFFFFFFFF
            return abs(total - (1 << 32) if total >= 1 << 31 else total)

        return pd.Series([one(x) for x in texts], dtype="Int64")

    return hashed


def rolling_hash(text: Column, seed: int, factor: int) -> Column:
    """The 32-bit rolling hash of a text as an unsigned magnitude: h * factor + UTF-16 unit, wrapped as a signed integer."""
    return _hasher(seed, factor)(text)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, where ``use`` reads it in a lambda function or more than once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hex8(number: Column) -> Column:
    digits = F.lower(F.hex(number))
    return F.concat(F.lit("djb2:"), F.lpad(digits, 8, "0"))


def normalised(text: Column) -> Column:
    return trim_all(F.regexp_replace(F.lower(text), f"[{SPACES}]+", " "))


def content_hash(text: Column) -> Column:
    return _hex8(rolling_hash(normalised(text), 5381, 33))


def plain_hash(text: Column) -> Column:
    return _hex8(rolling_hash(text, 5381, 33))


def bundle_hash(text: Column) -> Column:
    return _hex8(rolling_hash(text, 0, 31))


def word_windows(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Windows of words that step by size less overlap and end with the first that reaches the end."""
    step = size - min(max(overlap, 0), max(1, size) - 1)

    def cut(own: Column) -> Column:
        count = F.when(F.size(own) == 0, 0).otherwise(1 + F.ceil(F.greatest(F.lit(0), F.size(own) - size) / step)).cast("int")
        # The range of windows is empty for a text without words.
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.slice(own, i * step + 1, size))

    return bound(words(text), cut)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: x != "")


def without_comments(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, r"(?s)<!--.*?-->", ""))


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]{2,}", " ")


def is_boilerplate(text: Column) -> Column:
    return text.rlike(BOILERPLATE)


def is_decorative(src: Column, width: Column | None = None, height: Column | None = None) -> Column:
    small = (width == 1) & (height == 1) if width is not None and height is not None else F.lit(False)
    inline = src.startswith("data:") & src.contains("base64,") & (F.length(F.element_at(F.split(src, "base64,"), 2)) < 100)
    return src.rlike(DECORATIVE) | F.coalesce(small, F.lit(False)) | F.coalesce(inline, F.lit(False))


def is_footnote(css_class: Column, element_id: Column) -> Column:
    by_class = css_class.rlike(r"(?i)footnote|foot[-_\s]?note|fn[-_\s]?")
    by_id = element_id.rlike(r"(?i)^fn[-_\s]?\d+$|^footnote[-_\s]?\d+$")
    return F.coalesce(by_class, F.lit(False)) | F.coalesce(by_id, F.lit(False))


def is_safe_url(url: Column, image: bool = False) -> Column:
    """No control characters, and relative or of a harmless scheme."""
    own = trim_all(url)
    scheme = F.lower(F.regexp_extract(own, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    fine = scheme.isin("", "http", "https", "mailto")
    if image:
        fine = fine | own.rlike(r"(?i)^data:image/")
    return ~own.rlike(r"[\x00-\x1f\x7f]") & fine


def escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB, with one decimal from KB on."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for unit, power in (("KB", 1), ("MB", 2)):
        out = out.when(size < 1024 ** (power + 1), F.concat(F.format_string("%.1f", size / 1024**power), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", size / 1024**3), F.lit(" GB")))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 3)), F.lit("...")))


# Patterns in the order in which they are applied to Markdown.
TO_PLAIN = (
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*(.*?)\*\*", "$1"),
    (r"\*(.*?)\*", "$1"),
    (r"`(.*?)`", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", "[$1]"),
    (r"(?m)^[-*+]\s+", "• "),
    (r"(?m)^>\s+", ""),
    (r"(?m)^---$", ""),
    (r"\n{3,}", "\n\n"),
)
TO_HTML = (
    (r"(?m)^### (.+)$", "<h3>$1</h3>"),
    (r"(?m)^## (.+)$", "<h2>$1</h2>"),
    (r"(?m)^# (.+)$", "<h1>$1</h1>"),
    (r"\*\*(.*?)\*\*", "<strong>$1</strong>"),
    (r"\*(.*?)\*", "<em>$1</em>"),
    (r"`(.*?)`", "<code>$1</code>"),
    (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'),
    (r"!\[([^\]]*)\]\(([^)]+)\)", '<img src="$2" alt="$1" />'),
    (r"(?m)^> (.+)$", "<blockquote><p>$1</p></blockquote>"),
    (r"(?m)^[-*+] (.+)$", "<li>$1</li>"),
)


def _chain(text: Column, rules) -> Column:
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


def markdown_to_plain(text: Column) -> Column:
    return trim_all(_chain(text, TO_PLAIN))


def markdown_to_html(text: Column) -> Column:
    """Inline marks first, then lines that are no blocks are gathered into paragraphs."""
    lines = F.transform(F.split(_chain(text, TO_HTML), "\n"), trim_all)

    def is_text(line: Column) -> Column:
        return (line != "") & ~line.rlike("^<(h|pre|ul|blockquote|img|a )")

    def marked(own: Column) -> Column:
        """Each line with the paragraph marks before it; a blank line after the last one closes the last paragraph."""

        def one(line: Column, i: Column) -> Column:
            after_text = F.coalesce(is_text(F.get(own, i - 1)), F.lit(False))
            mark = F.when(is_text(line) & ~after_text, F.lit("<p>")).when(~is_text(line) & after_text, F.lit("</p>"))
            return F.concat_ws("\n", mark, F.nullif(line, F.lit("")))

        return F.transform(own, one)

    return F.array_join(F.filter(bound(F.concat(lines, F.array(F.lit(""))), marked), lambda x: x != ""), "\n")


def viewer_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    rules = (*TO_HTML[:3], (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"), (r"`(.+?)`", "<code>$1</code>"), (r"\n", "<br/>"))
    return _chain(text, rules)


def markdown_title(text: Column) -> Column:
    found = trim_all(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    return F.when(found != "", found)


def markdown_words(text: Column) -> Column:
    return word_count(F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"[#*_`\[\]()!]", ""))
