"""Text expressions: lines, token estimates, keyword and word overlap, paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WS = r"[\s\p{Z}\x{85}]"
#: Thresholds of the boundary rule, in lines of the current chunk.
HEADER_AT, BREAK_AT, DEFINITION_AT, LIMIT_AT = 15, 20, 30, 40
HEADER = rf"^{WS}*#.*[^\s\p{{Z}}\x{{85}}]|^{WS}*[=\-~^]{{3,}}{WS}*$"
BREAK = rf"^{WS}*$|^{WS}*(```|~~~)"
DEFINITION = rf"^{WS}*(def |class |function |pub fn |fn |const |let )"


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds no line."""
    parts = F.split(text, r"\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def estimate_tokens(text: Column) -> Column:
    """Bytes / 4, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def estimate_tokens_floor(text: Column) -> Column:
    """Bytes / 4, rounded down, at least 1."""
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(1)).cast("long")


def estimate_tokens_points(text: Column) -> Column:
    """Code points / 4, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def estimate_tokens_utf16(text: Column) -> Column:
    """UTF-16 units / 4, rounded up: characters beyond the basic plane count twice."""
    astral = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.ceil((F.length(text) + astral) / 4).cast("long")


def words(text: Column) -> Column:
    """The distinct white-space separated words."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def keyword_score(query: Column, text: Column) -> Column:
    """The share of the query's words that the text contains, ignoring case."""
    keys = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(keys, lambda w: F.contains(F.lower(text), w)))
    return hits / F.greatest(F.size(keys), F.lit(1))


def jaccard_words(a: Column, b: Column) -> Column:
    """Common words over all words of two word arrays; 0 if there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def fold_ascii(text: Column) -> Column:
    """Lower case of the ASCII letters only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
