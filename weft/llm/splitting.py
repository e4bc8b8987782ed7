"""Splitting oversized texts at natural boundaries by lexical cohesion.

Words are counted in sliding blocks of lines on either side of each gap between lines; the cosine of the
two blocks is the gap's cohesion, and the depth of a valley of cohesion marks a change of topic. Each
piece grows to its size window and is cut at the window's deepest valley (blank lines and headings
deepen it). The next piece begins ``overlap_lines`` lines before the cut or, where they do not fit,
``overlap_chars`` characters before it. A line that exceeds the limit, alone or with the overlap before
it, is cut inside, at the end of a sentence or clause, at a blank or, failing these, between two
characters, with ``overlap_chars`` of overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, Window as W

_TOKENS = re.compile(r"[^\W\d_]+|\d+")
_HEADING = re.compile(r"\s*(#{1,6}\s|=+\s*$|-{3,}\s*$|\[[^\]]*\]\s*$)")
_DEFINITION = re.compile(r"(pub |async |export )?(def|fn|function|class|struct|impl)\b")
#: Cuts inside a line, the best first.
_INNER = [re.compile(p) for p in (r"[.!?。！？…؟।]['\"”’»」』)\]]*\s*", r"[;:,、，；：،—–]\s*", r"\s+")]
_CHUNK = 4096
_WIDE = 512
#: Scripts written without blanks between words are compared by pairs of characters.
_UNSPACED = re.compile(r"[฀-໿぀-ヿ㐀-鿿]")


@dataclass(frozen=True)
class Limits:
    max_chars: int
    max_lines: int = 0
    overlap_lines: int = 2
    overlap_chars: int = 200
    block: int = 5
    #: A piece is filled at least to this share of its window.
    least_fill: float = 0.5


class _Places(dict):
    """Counting place of each word, kept for words that come again; emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word) % _WIDE
        return value


_place = _Places()


def _terms(line: str) -> list[int]:
    out: list[str] = []
    for word in _TOKENS.findall(line.lower()):
        if _UNSPACED.search(word):
            out.extend(word[i : i + 2] for i in range(max(1, len(word) - 1)))
        elif len(word) > 2:
            out.append(word)
    return [_place[w] for w in out]


def cohesion(lines: list[str], block: int) -> np.ndarray:
    """Cosine of the word counts before and after each gap; entry g is the gap before line g."""
    n = len(lines)
    out = np.ones(n + 1)
    for begin in range(0, n, _CHUNK):  # long texts in slices that overlap by a block
        low, high = max(0, begin - block), min(n, begin + _CHUNK + block)
        terms = [_terms(lines[i]) for i in range(low, high)]
        row = np.repeat(np.arange(1, high - low + 1), [len(t) for t in terms])
        column = np.fromiter((x for t in terms for x in t), np.int64, len(row))
        counts = np.bincount(row * _WIDE + column, minlength=(high - low + 1) * _WIDE).reshape(-1, _WIDE)
        sums = counts.cumsum(0, dtype=np.float32)
        gaps = np.arange(max(begin, 1), min(n, begin + _CHUNK))
        if len(gaps):
            left = sums[gaps - low] - sums[np.maximum(gaps - block, low) - low]
            right = sums[np.minimum(gaps + block, high) - low] - sums[gaps - low]
            norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
            out[gaps] = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0)
    return out


def depths(similarity: np.ndarray) -> np.ndarray:
    """How far each gap lies below the nearest peaks on its two sides."""
    n = len(similarity)
    left, right = similarity.copy(), similarity.copy()
    for i in range(1, n):
        left[i] = max(similarity[i], left[i - 1]) if similarity[i - 1] >= similarity[i] else similarity[i]
    for i in range(n - 2, -1, -1):
        right[i] = max(similarity[i], right[i + 1]) if similarity[i + 1] >= similarity[i] else similarity[i]
    return left + right - 2 * similarity


def _bonus(before: str, after: str) -> float:
    if not before.strip():
        return 0.5 + (0.5 if _HEADING.match(after) or _DEFINITION.match(after) else 0.0)
    return 0.5 if _HEADING.match(after) or _DEFINITION.match(after) else 0.0


def _cut_line(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of at most ``most`` characters that cover a line, each beginning before the last's end."""
    out, at = [], 0
    while len(text) - at > most:
        low = at + max(overlap + 1, most // 2)
        cut = at + most
        for pattern in _INNER:
            found = [m.end() for m in pattern.finditer(text, low, at + most)]
            if found:
                cut = found[-1]
                break
        out.append((at, cut))
        at = max(at + 1, cut - overlap)
    out.append((at, len(text)))
    return out


def _begin(starts: np.ndarray, done: int, back: int, room: int, few: int, last: int) -> int:
    """Where the piece that goes on with line ``done`` begins; ``last`` is where the piece before began.

    The lines from ``back`` are repeated if they fit into ``room``, else the line before, if it fits and
    has at least ``few`` characters, else ``few`` characters. A piece that would hold all of the piece
    before takes its place and begins at ``last``.
    """
    at = int(starts[done])
    if back < done:
        whole, line = int(starts[back]), int(starts[done - 1])
        if at - whole <= room:
            return max(whole, last)
        if few <= at - line <= room and line > last:
            return line
        return at - min(few, room)
    return at


def split_text(text: str, limits: Limits) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of each piece: code points, end exclusive; lines from 1.

    Pieces cover the text in order, each within the limits, and consecutive pieces overlap.
    """
    lines = text.split("\n")
    if lines[-1] == "" and len(lines) > 1:
        lines.pop()
    ends = np.cumsum([len(x) + 1 for x in lines])
    ends[-1] = len(text)
    starts = np.concatenate(([0], ends[:-1]))
    size = limits.max_chars
    most_lines = limits.max_lines or len(lines)
    if len(text) <= size and len(lines) <= most_lines:
        return [(0, len(text), 1, len(lines))] if text else []
    valley = depths(cohesion(lines, limits.block))
    few = min(limits.overlap_chars, size // 4)
    out: list[tuple[int, int, int, int]] = []
    done = 0  # lines before it are covered
    while done < len(lines):
        back = max(done - min(limits.overlap_lines, most_lines - 1), 0)
        before, here = int(starts[done] - starts[back]), int(ends[done] - starts[done])
        long = here + min(before, few) > size
        begin = _begin(starts, done, back, size // 4 if long else size - here, few, out[-1][0] if out else -1)
        if out and begin == out[-1][0]:
            out.pop()
        first = int(np.searchsorted(starts, begin, "right")) - 1
        if long:
            for a, b in _cut_line(text[begin : ends[done]], size, few):
                out.append((begin + a, begin + b, int(np.searchsorted(starts, begin + a, "right")), done + 1))
            done += 1
            continue
        stop = min(int(np.searchsorted(ends, begin + size, "right")), first + most_lines, len(lines))
        cut = stop
        if stop < len(lines):  # a piece has a line more than the overlap after it, if that fits
            low = max(done + 1, min(stop, first + limits.overlap_lines + 1), first + int((stop - first) * limits.least_fill))
            scores = [valley[g] + _bonus(lines[g - 1], lines[g]) + 1e-6 * g for g in range(low, stop + 1)]
            cut = low + int(np.argmax(scores))
        out.append((begin, int(ends[cut - 1]), first + 1, cut))
        done = cut
    return out


def oversized(items: DataFrame, limits: Limits) -> DataFrame:
    """The rows of (kind, item_id, text, ...) beyond the limits; null texts are not."""
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    lines = breaks + F.when(F.col("text").endswith("\n"), 0).otherwise(1)
    over = F.length("text") > limits.max_chars
    return items.filter(over | (lines > limits.max_lines) if limits.max_lines else over)


_SHAPE = "kind string, item_id string, piece_no int, start_line int, end_line int, start_char long, end_char long, text string"


def split_items(items: DataFrame, limits: Limits) -> DataFrame:
    """Pieces of the oversized rows of ``items`` (kind, item_id, text, from_line).

    Returns kind, item_id, piece_no (from 0), start_line, end_line, start_char, end_char and text.
    Lines count from ``from_line`` (1 where it is null or not positive). Repeated rows count once; null
    and small texts give nothing; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for kind, item, text, line in frame.itertuples(index=False):
                base = int(line) - 1 if pd.notna(line) and line > 0 else 0
                for no, (a, b, top, end) in enumerate(split_text(text, limits)):
                    rows.append((kind, item, no, base + top, base + end, a, b, text[a:b]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SHAPE.split(", ")])

    items = items.select("kind", F.col("item_id").cast("string").alias("item_id"), "text", F.col("from_line").cast("int").alias("from_line"))
    return oversized(items, limits).filter("item_id is not null").dropDuplicates(["kind", "item_id", "text"]).mapInPandas(run, _SHAPE)


ARTIFACT = Limits(12_000)
SPAN = Limits(2_000, 40)


def split_corpus(spans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Pieces of artifact contents over 12,000 characters and of span texts over 2,000 characters or 40 lines.

    A span's lines count from its start_line if its range fits the text, else from 1.
    """
    whole = artifacts.select(F.lit("artifact").alias("kind"), F.col("id").alias("item_id"), F.col("content").alias("text"), F.lit(1).alias("from_line"))
    n_lines = F.size(F.split("text", "\n")) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)
    fits = (F.col("start_line") > 0) & (F.col("end_line") - F.col("start_line") + 1 == n_lines)
    parts = spans.select(F.lit("span").alias("kind"), F.col("id").alias("item_id"), "text", F.when(fits, F.col("start_line")).alias("from_line"))
    return split_items(whole, ARTIFACT).unionByName(split_items(parts, SPAN))


def faults(pieces: DataFrame) -> DataFrame:
    """(kind, item_id, chars, overlong, gaps, apart) of each item of ``split_corpus``: the characters up to
    the last piece's end, the pieces beyond a limit, those that begin behind the end of the one before, and
    those that repeat nothing of it."""
    before = F.lag("end_char").over(W.partitionBy("kind", "item_id").orderBy("piece_no"))
    limit = F.when(F.col("kind") == "span", SPAN.max_chars).otherwise(ARTIFACT.max_chars)
    lines = (F.col("kind") == "span") & (F.col("end_line") - F.col("start_line") + 1 > SPAN.max_lines)
    rows = pieces.select(
        "kind", "item_id", "end_char", ((F.length("text") > limit) | lines | (F.length("text") != F.col("end_char") - F.col("start_char"))).alias("over"),
        F.coalesce(F.col("start_char") > before, F.col("start_char") > 0).alias("gap"), F.coalesce(F.col("start_char") >= before, F.lit(False)).alias("apart"),
    )
    count = lambda c: F.sum(F.col(c).cast("int")).alias
    return rows.groupBy("kind", "item_id").agg(F.max("end_char").alias("chars"), count("over")("overlong"), count("gap")("gaps"), count("apart")("apart"))
