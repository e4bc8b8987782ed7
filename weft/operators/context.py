"""The working set of a query: canonical order, citations, text and hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from weft.functions import text as T
from weft.functions.labels import utilisation


def canonical(selected: DataFrame, by: str = "artifact_id") -> DataFrame:
    """selected with citation, from 1, in the order of ``by``, line and id."""
    order = W.partitionBy("query_id").orderBy(by, F.col("start_line").asc_nulls_last(), "id")
    return selected.withColumn("citation", F.row_number().over(order))


def block(citation: Column, path: Column, start: Column, end: Column, text: Column) -> Column:
    line = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    return F.concat(F.lit("["), citation.cast("string"), F.lit("] "), path, F.lit("\nLines "), line(start), F.lit("-"), line(end), F.lit("\n\n"), F.coalesce(text, F.lit("")))


def block_pg(path: Column, start: Column, end: Column, text: Column) -> Column:
    line = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    return F.concat(F.lit("--- "), path, F.lit(" (lines "), line(start), F.lit("-"), line(end), F.lit(") ---\n"), F.coalesce(text, F.lit("")))


def working_sets(cited: DataFrame, requests: DataFrame, pg: bool = False, count: Callable[[Column], Column] = T.estimate_tokens) -> DataFrame:
    """One row a request (query_id, query, budget): text, citations, tokens_used, hashes.

    ``cited`` has query_id, citation, id, artifact_id, path, start_line, end_line, text, tokens, score.
    Requests without a selection have an empty text. ``count`` counts the tokens of a text: an estimate,
    or any expression, such as a UDF over a tokenizer.
    """
    shown = block_pg(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")) if pg else block(F.col("citation"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text"))
    entry = F.struct("citation", shown.alias("block"), "id", "artifact_id", "path", "start_line", "end_line", "score", "tokens")
    sets = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("citations"))
    gap = "\n\n" if pg else "\n\n---\n\n"
    out = requests.select("query_id", "query", "budget").join(sets, "query_id", "left")
    none = F.array().cast(sets.schema["citations"].dataType)
    out = out.withColumn("citations", F.coalesce("citations", none))
    out = out.withColumn("text", F.array_join(F.transform("citations", lambda c: c["block"]), gap))
    span_tokens = F.aggregate("citations", F.lit(0).cast("long"), lambda a, c: a + c["tokens"])
    used = span_tokens if pg else count(F.col("text"))
    out = out.withColumn("tokens_used", used).withColumn("context_hash", F.left(F.sha2("text", 256), F.lit(24)) if pg else F.sha2("text", 256))
    return out.withColumn("utilisation", utilisation(F.col("tokens_used"), F.col("budget"))).withColumn("n_spans", F.size("citations"))


def manifest(sets: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, manifest) with the parameters that made the working set; model and dimension are those
    of its first span (id, model, embedding), or the defaults."""
    # The parameters that a manifest names.
    chunking = F.struct(F.lit(20).alias("min_lines"), F.lit(50).alias("max_lines"), F.lit(30).alias("target_lines"))
    index = F.struct(F.lit(32).alias("m"), F.lit(200).alias("ef_construction"), F.lit(50).alias("ef_search"))
    first = sets.select("query_id", "context_hash", F.get("citations", F.lit(0))["id"].alias("id"))
    made = spans.join(first.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.struct("model", F.size("embedding").alias("dim"))).alias("m"))
    return first.join(made, "id", "left").select(
        "query_id",
        F.struct(
            F.lit("0.1.0").alias("version"), F.lit("cl100k_base").alias("tokenizer"), F.coalesce("m.model", F.lit("all-MiniLM-L6-v2")).alias("embedding_model"),
            F.coalesce("m.dim", F.lit(384)).alias("embedding_dimension"), chunking.alias("chunking"), index.alias("index"), F.col("context_hash"),
        ).alias("manifest"),
    )
