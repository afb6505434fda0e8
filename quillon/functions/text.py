"""Scalar expressions over lines of text. Offsets and lengths are UTF-8 bytes, as searches report them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line longer than this is cut to a window around its match.
LONGEST_LINE, WINDOW = 500, 200
ELLIPSIS = "…"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text: Column | str) -> Column:
    """ASCII letters in lower case; all else as it is."""
    return F.translate(col(text), UPPER, LOWER)


def lines(content: Column | str) -> Column:
    """The lines of a text: no empty line after a last newline, no carriage return before one; none of an empty text."""
    c = col(content)
    body = F.when(F.endswith(c, F.lit("\n")), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    parts = F.when(F.contains(c, F.lit("\r")), F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))).otherwise(F.split(body, "\n", -1))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(parts)


def has(text: Column | str, needle_lower: str) -> Column:
    """Whether a text has a needle (already in lower case), whatever the case of ASCII letters."""
    return F.contains(fold(text), F.lit(needle_lower))


def may_have(text: Column | str, needle_lower: str) -> Column:
    """True where ``has`` is, and a little more often: letters beyond ASCII count in either case. Much faster over long texts."""
    return F.contains(F.lower(col(text)), F.lit(needle_lower))


def byte_offset(text: Column, char: Column) -> Column:
    """Bytes before a character position counted from 1."""
    return F.octet_length(F.substring(text, F.lit(1), char - 1))


def match_start(text: Column | str, needle_lower: str) -> Column:
    """The byte where the needle first begins, null if nowhere; 0 for an empty needle."""
    t = col(text)
    at = F.locate(needle_lower, fold(t)) if needle_lower else F.lit(1)
    return F.when(at > 0, byte_offset(t, at))


def length_factor(line: Column | str) -> Column:
    return F.greatest(1 / (1 + F.log1p(F.octet_length(col(line)) / 100.0)), F.lit(0.3))


def trim_start(line: Column | str) -> Column:
    """Without white space at the start, in the sense of Unicode."""
    return F.regexp_replace(col(line), r"(?U)^\s+", "")


def _inside(raw: Column, at: Column) -> Column:
    """Whether the byte at an offset goes on with a character."""
    byte = F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int")
    return (byte >= 0x80) & (byte < 0xC0)


def _snap(raw: Column, at: Column, step: int) -> Column:
    """The next offset, down or up, where a character begins."""
    out = at + 3 * step
    for k in (2, 1, 0):
        out = F.when(~_inside(raw, at + k * step), at + k * step).otherwise(out)
    return out


def around_match(line: Column, start: Column, end: Column) -> Column:
    """(content, match_start, match_end, content_truncated): a long line is cut to a window around the match."""
    raw, size = F.encode(line, "UTF-8"), F.octet_length(line)
    low, high = F.greatest(start - WINDOW, F.lit(0)), F.least(end + WINDOW, size)
    low = F.when(low == 0, 0).otherwise(_snap(raw, low, -1))
    high = F.when(high >= size, size).otherwise(_snap(raw, high, 1))
    middle = F.decode(F.substring(raw, low + 1, high - low), "UTF-8")
    cut = F.concat(F.when(low > 0, ELLIPSIS).otherwise(""), middle, F.when(high < size, ELLIPSIS).otherwise(""))
    shift = F.when(low > 0, low - len(ELLIPSIS.encode())).otherwise(0)
    long = size > LONGEST_LINE
    return F.struct(
        F.when(long, cut).otherwise(line).alias("content"),
        F.when(long, start - shift).otherwise(start).cast("int").alias("match_start"),
        F.when(long, end - shift).otherwise(end).cast("int").alias("match_end"),
        long.alias("content_truncated"),
    )


def safe_prefix(text: Column | str, most: int) -> Column:
    """At most so many bytes of a text, cut where a character begins."""
    t = col(text)
    raw = F.encode(t, "UTF-8")
    return F.when(F.octet_length(t) <= most, t).otherwise(F.decode(F.substring(raw, F.lit(1), _snap(raw, F.lit(most), -1)), "UTF-8"))


def tokens(text: Column | str) -> Column:
    """Words in lower case of more than two bytes."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: F.octet_length(w) > 2)


def bucket(word: Column | str, buckets: int = 128) -> Column:
    """The sum of a word's bytes, modulo the number of buckets."""
    digits = F.hex(F.encode(col(word), "UTF-8"))
    pairs = F.sequence(F.lit(1), F.length(digits), F.lit(2))
    return F.aggregate(F.transform(pairs, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int")), F.lit(0), lambda a, b: a + b) % buckets


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays in double; 0 where the lengths differ or one has no length."""
    x, y = (F.transform(col(v), lambda e: e.cast("double")) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norm > 0), dot(x, y) / norm).otherwise(0.0)


def highlight(is_symbol: Column | str) -> Column:
    return F.when(col(is_symbol), "SYMBOL_DEFINITION").otherwise("TEXT")


def thousands(n: Column | str) -> Column:
    return F.replace(F.format_number(col(n), 0), F.lit(","), F.lit("_"))


def human_bytes(n: Column | str) -> Column:
    n = col(n)
    two = lambda d, unit: F.concat(F.format_string("%.2f", F.bround(n / float(d), 2)), F.lit(f" {unit}"))
    return F.when(n >= 1 << 30, two(1 << 30, "GB")).when(n >= 1 << 20, two(1 << 20, "MB")).when(n >= 1 << 10, two(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def duration(seconds: Column | str) -> Column:
    s = col(seconds).cast("long")
    d, h, m, x = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60
    return (
        F.when(d > 0, F.format_string("%dd %dh %dm", d, h, m))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, x))
        .when(m > 0, F.format_string("%dm %ds", m, x))
        .otherwise(F.format_string("%ds", x))
    )
