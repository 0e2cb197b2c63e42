"""Scalar text expressions with the semantics of the features: code points, \\n-only line ends, Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def regex(pattern: str, flags: str = "", wide: bool = True) -> str:
    """A Java pattern in which only \\n ends lines and \\w, \\b and \\s are Unicode classes, or without wide those of ASCII."""
    return f"(?d{'U' if wide else ''}{flags}){pattern}"


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def matched(text: Column, pattern: str, flags: str, of) -> Column:
    """of(a literal of the pattern): where all of text is ASCII, with the classes of ASCII, which find the same there in less time."""
    return F.when(is_ascii(text), of(F.lit(regex(pattern, flags, False)))).otherwise(of(F.lit(regex(pattern, flags))))


def hits(text: Column, pattern: str, flags: str = "") -> Column:
    """How often pattern is found, without overlap."""
    return matched(text, pattern, flags, lambda p: F.regexp_count(text, p)).cast("long")


def found(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return matched(text, pattern, flags, lambda p: F.regexp_extract_all(text, p, F.lit(group)))


def occurrences(text: Column, sub: str) -> Column:
    """How often sub occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(sub), F.lit("")))) / len(sub)).cast("long")


def is_blank(text: Column) -> Column:
    """Whether strip() leaves nothing; ends at the first character that it would leave."""
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def begins(text: Column, pattern: str) -> Column:
    """Whether what strip() leaves begins with pattern, which begins with no white space."""
    return text.rlike(rf"(?U)\A[\s\x1c-\x1f]*+(?:{pattern})")


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind that Python's str.strip knows."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+\z", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """0 for an empty array."""
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(total(values) / F.size(values))


def std(values: Column, sample: bool = False) -> Column:
    """Standard deviation of an array; 0 below two values."""
    return F.when(F.size(values) < 2, F.lit(0.0)).otherwise(let(mean(values), lambda m: F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (F.size(values) - (1 if sample else 0)))))


def median(values: Column) -> Column:
    """0 for an empty array."""
    n = F.size(values)
    return F.when(n == 0, F.lit(0.0)).otherwise(let(F.array_sort(values), lambda s: (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2.0))


def largest(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0))


def entropy(items: Column) -> Column:
    """Shannon entropy in bits of the items of an array, by the lengths of runs in its sorted order."""

    def of(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(starts, lambda b: F.log2(n) - F.aggregate(F.transform(b, lambda x, j: F.coalesce(F.get(b, j + 1), n) - x), F.lit(0.0), lambda a, c: a + c * F.log2(c)) / n)

    return F.when(F.size(items) == 0, F.lit(0.0)).otherwise(let(F.array_sort(items), of))


def character_entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters. Where few differ, each is counted in one pass over the text; else, as their number
    times the length may be large, the characters are sorted."""
    n = F.length(text)

    def of(kinds: Column) -> Column:
        counts = F.transform(kinds, lambda x: (n - F.length(F.replace(text, x, F.lit("")))).cast("double"))
        by_kind = F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c)) / n
        return F.when(F.size(kinds) == 0, F.lit(0.0)).when(F.size(kinds) <= 200, by_kind).otherwise(entropy(characters(text)))

    return let(F.array_distinct(characters(text)), of)


def characters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column) -> Column:
    """NaN, infinities and null as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def normalise(code: Column) -> Column:
    """CRLF and CR as LF, tabs as four spaces, no white space at line ends; null is empty."""
    text = F.replace(F.coalesce(code, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    text = F.replace(F.replace(text, F.lit("\r"), F.lit("\n")), F.lit("\t"), F.lit("    "))
    return F.regexp_replace(text, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")


def ascii_only(text: Column) -> Column:
    """Every character beyond ASCII as x, so that engines with and without Unicode classes agree."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", "x")
