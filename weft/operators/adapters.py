"""What retrieval adapters do with a working set: merging, de-duplicating and formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

#: Spans whose lines are this near are joined into one document.
NEAR = 5


def merge_adjacent(cited: DataFrame, near: int = NEAR) -> DataFrame:
    """(query_id, island, source, start_line, end_line, span_count, token_count, avg_score, max_score,
    min_score, text): runs of consecutive citations of one path whose line gap is 0 to ``near``."""
    w = W.partitionBy("query_id").orderBy("citation")
    gap = F.col("start_line") - F.lag("end_line").over(w)
    joins = F.coalesce((F.col("path") == F.lag("path").over(w)) & gap.between(0, near), F.lit(False))
    rows = cited.withColumn("fresh", F.when(joins, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w))
    entry = F.struct("citation", "text", "start_line", "end_line")
    out = rows.groupBy("query_id", "island").agg(
        F.first("path").alias("source"), F.array_sort(F.collect_list(entry)).alias("parts"), F.count("*").alias("span_count"), F.sum("tokens").alias("token_count"),
        F.round(F.avg("score"), 9).alias("avg_score"), F.round(F.max("score"), 9).alias("max_score"), F.round(F.min("score"), 9).alias("min_score"),
    )
    return out.select(
        "query_id", "island", "source", F.get("parts", F.lit(0))["start_line"].alias("start_line"), F.element_at("parts", -1)["end_line"].alias("end_line"),
        "span_count", "token_count", "avg_score", "max_score", "min_score", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n").alias("text"),
    )


def distinct_citations(cited: DataFrame) -> DataFrame:
    """The first citation of each (path, start_line, end_line) of a query."""
    first = F.row_number().over(W.partitionBy("query_id", "path", "start_line", "end_line").orderBy("citation"))
    return cited.withColumn("n", first).filter("n = 1").drop("n")


def format_citations(citations: Column, style: str = "compact") -> Column:
    """citations (path, start_line, end_line) as text in one of three styles."""
    lines = lambda c: F.concat(c["start_line"].cast("string"), F.lit("-"), c["end_line"].cast("string"))
    # The formats.
    entry, gap = {
        "verbose": (lambda c: F.concat(F.lit("  📄 "), c["path"], F.lit(" (lines "), lines(c), F.lit(")")), "\n"),
        "markdown": (lambda c: F.concat(F.lit("- `"), c["path"], F.lit(":"), lines(c), F.lit("`")), "\n"),
    }.get(style, (lambda c: F.concat(c["path"], F.lit(":"), lines(c)), ", "))
    return F.when(F.size(citations) == 0, "No citations").otherwise(F.array_join(F.transform(citations, entry), gap))


def format_working_set(query: Column, citations: Column, tokens_used: Column, context_hash: Column, text: Column) -> Column:
    """A summary with the first 10 citations and the first 500 characters of the text."""
    shown = F.transform(F.slice(citations, 1, 10), lambda c: F.concat(F.lit("\n  - "), c["path"], F.lit(":"), c["start_line"].cast("string"), F.lit("-"), c["end_line"].cast("string")))
    more = F.when(F.size(citations) > 10, F.concat(F.lit("\n  ... and "), (F.size(citations) - 10).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(
        F.lit("Query: "), F.coalesce(query, F.lit("")), F.lit("\nSpans: "), F.size(citations).cast("string"), F.lit("\nTokens Used: "), F.format_number(tokens_used, 0),
        F.lit("\nDeterministic Hash: "), F.left(context_hash, F.lit(16)), F.lit("...\n\nCitations:"), F.array_join(shown, ""), more,
        F.lit("\n\nContext:\n"), F.repeat(F.lit("─"), F.lit(60)), F.lit("\n"), F.left(text, F.lit(500)), F.when(F.length(text) > 500, "\n...").otherwise(""),
    )


def citation_at(citations: Column, number: int) -> Column:
    """The citation with this number, from 1; null if there is none."""
    return F.try_element_at(citations, F.lit(number))


def scored_at_least(cited: DataFrame, least: float) -> DataFrame:
    return cited.filter(F.coalesce("score", F.lit(0.0)) >= least)
