"""Functions for SQL texts: ``register`` makes them known to a session by name."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from weft.functions import text as T

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
_HEADER, _BREAK, _DEFINITION = re.compile(r"\s*(#.*\S|[=\-~^]{3,}\s*$)"), re.compile(r"\s*($|```|~~~)"), re.compile(r"\s*(def |class |function |pub fn |fn |const |let )")


@udtf(returnType="start_line int, end_line int, text string, token_count long")
class ExtractSpans:
    """The spans of one content, as rows: a lateral join cuts a whole table."""

    def eval(self, content: str) -> Iterator[tuple]:
        lines = re.split(r"\r?\n", content) if content else []
        if lines and lines[-1] == "":
            lines.pop()
        begin = 0
        for i, line in enumerate(lines, 1):
            limit = T.HEADER_AT if _HEADER.match(line) else T.BREAK_AT if _BREAK.match(line) else T.DEFINITION_AT if _DEFINITION.match(line) else T.LIMIT_AT
            if i - begin >= limit or i == len(lines):
                body = "\n".join(lines[begin:i])
                yield begin + 1, i, body, -(-len(body.encode()) // 4)
                begin = i


def register(spark: SparkSession, working_sets: DataFrame | None = None) -> None:
    """``estimate_tokens(text)`` and ``cosine_similarity(a, b)`` are expressions, which the optimizer sees
    through; ``extract_spans(content)`` gives rows. ``compile_context`` is a whole plan, so it is a view:
    the given working sets of a batch of requests."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(content STRING) RETURNS BIGINT RETURN CAST(ceil(octet_length(content) / 4) AS BIGINT)")
    dot = _DOT.format("a", "b")
    norms = f"sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN CASE WHEN size(a) = size(b) AND {norms} > 0 THEN {dot} / ({norms}) ELSE 0D END")
    spark.udtf.register("extract_spans", ExtractSpans)
    if working_sets is not None:
        working_sets.createOrReplaceTempView("compile_context")
