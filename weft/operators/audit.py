"""Comparing working sets and measuring retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from weft.runtime import stage


def diff(before: DataFrame, after: DataFrame, least: float = 0.001) -> DataFrame:
    """(query_id, id, change, old_rank, new_rank, old_score, new_score) of two rankings (query_id, id,
    rank, score): added, removed, or reranked if the rank differs or the score by more than ``least``."""
    a = before.select("query_id", "id", F.col("rank").alias("old_rank"), F.col("score").alias("old_score"))
    b = after.select("query_id", "id", F.col("rank").alias("new_rank"), F.col("score").alias("new_score"))
    moved = (F.col("old_rank") != F.col("new_rank")) | (F.abs(F.col("new_score") - F.col("old_score")) > least)
    change = F.when(F.col("old_rank").isNull(), "added").when(F.col("new_rank").isNull(), "removed").when(F.coalesce(moved, F.lit(False)), "reranked")
    return a.join(b, ["query_id", "id"], "full_outer").withColumn("change", change).filter("change is not null")


def diff_summary(changes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, summary) for every query: ``2 added, 1 removed, 3 reranked`` or ``No changes``."""
    count = lambda c: F.sum(F.when(F.col("change") == c, 1).otherwise(0)).alias(c)
    counts = changes.groupBy("query_id").agg(count("added"), count("removed"), count("reranked"))
    part = lambda c: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" " + c)))
    text = F.concat_ws(", ", part("added"), part("removed"), part("reranked"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.when(text == "", "No changes").otherwise(text).alias("summary"))


def identical(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, same): whether the texts have the same hash."""
    a, b = before.select("query_id", F.col("context_hash").alias("x")), after.select("query_id", F.col("context_hash").alias("y"))
    return a.join(b, "query_id").select("query_id", (F.col("x") == F.col("y")).alias("same"))


def recall(expected: Column, top: Column) -> Column:
    """Share of the distinct expected paths in the top list; 1 if none is expected."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(want, top)) / F.size(want))


def precision(expected: Column, top: Column) -> Column:
    """Distinct expected paths in the top list over its length, repeats included."""
    return F.when(F.size(top) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(F.array_distinct(expected), top)) / F.size(top))


def reciprocal_rank(expected: Column, results: Column) -> Column:
    """1 / place of the first expected path among all results."""
    places = F.filter(F.transform(F.array_distinct(expected), lambda p: F.array_position(results, p)), lambda i: i > 0)
    return F.when(F.size(places) > 0, F.lit(1.0) / F.array_min(places)).otherwise(F.lit(0.0))


def evaluate(golden: DataFrame) -> DataFrame:
    """golden (query_id, expected, results, k) with recall, precision and mrr."""
    top = F.slice("results", F.lit(1), F.col("k"))
    return golden.select(
        "query_id", F.round(recall(F.col("expected"), top), 9).alias("recall"), F.round(precision(F.col("expected"), top), 9).alias("precision"),
        F.round(reciprocal_rank(F.col("expected"), F.col("results")), 9).alias("mrr"),
    )


def quantile_at(values: Column, share: float) -> Column:
    """The value at index floor(share * n), at most the last, of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.floor(F.size(ordered) * share), F.size(ordered) - 1).cast("int"))


def evaluation_summary(results: DataFrame, latency: str | None = None) -> DataFrame:
    """One row: means, and the median and 99th percentile of ``latency`` (a counter table gives exact
    order statistics without gathering all values in one row)."""
    means = results.agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("recall", "precision", "mrr")))
    if latency is None:
        return means
    counts = results.groupBy(F.col(latency).alias("v")).agg(F.count("*").alias("c"))
    both = means.unionByName(order_statistics(counts), allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def order_statistics(counts: DataFrame) -> DataFrame:
    """(p50, p99) of values v with counts c: the values at floor(n / 2) and min(floor(0.99 n), n - 1).

    The values are sorted by ranges; only one row a range is summed up in order, and each range then
    counts on from there.
    """
    rows = stage(counts.select("v", "c").repartitionByRange("v").withColumn("p", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("p").agg(F.sum("c").alias("own"))  # a row a partition
    sums = sums.select("p", (F.sum("own").over(W.orderBy("p")) - F.col("own")).alias("begin"), F.sum("own").over(W.partitionBy()).alias("n"))
    ranked = rows.join(F.broadcast(sums), "p").withColumn("upto", F.col("begin") + F.sum("c").over(W.partitionBy("p").orderBy("v")))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    return ranked.agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1)).alias("p99"))


def term_recall(terms: Column, text: Column) -> Column:
    """Share of the terms that the text contains, ignoring case; 1 if there are none."""
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t))))
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(hits / F.size(terms))


def context_quality(cited: DataFrame) -> DataFrame:
    """(query_id, spans, min/max/avg_score, sources, low_score, few_sources) of cited spans."""
    score = F.coalesce("score", F.lit(0.0))
    out = cited.groupBy("query_id").agg(
        F.count("*").alias("spans"), F.round(F.min(score), 9).alias("min_score"), F.round(F.max(score), 9).alias("max_score"),
        F.round(F.avg(score), 9).alias("avg_score"), F.countDistinct("path").alias("sources"),
    )
    return out.withColumns({"low_score": F.col("avg_score") < 0.5, "few_sources": F.col("sources") < 3})
