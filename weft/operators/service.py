"""What surrounds the compiler: settings, projects, counters, and the ways in for retrieval adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F

from weft.operators.retrieval import vector_topk
from weft.plans.compile import Compiler

#: Characters of a context that a language model is given.
SHOWN = 1500


def storage_kind(setting: Column, default: str) -> Column:
    """(kind, place) of a storage setting: ``sqlite``, ``sqlite:<path>`` or a postgres address; null, empty
    and unknown settings are the default path."""
    path = F.when(F.startswith(setting, F.lit("sqlite:")), F.substring(setting, 8, 2**31 - 1)).otherwise(F.lit(default))
    server = F.startswith(setting, F.lit("postgres://")) | F.startswith(setting, F.lit("postgresql://"))
    server = F.coalesce(server, F.lit(False))
    return F.struct(F.when(server, "postgres").otherwise("sqlite").alias("kind"), F.when(server, setting).otherwise(F.coalesce(path, F.lit(default))).alias("place"))


def pg_config(json: Column) -> Column:
    """The settings of the other profile from a JSON text: each field that is missing has its default, and
    a text that is no such object has all of them."""
    got = F.from_json(json, "token_budget int, enable_mmr boolean, mmr_lambda double, candidate_limit int", {"mode": "PERMISSIVE"})
    defaults = {"token_budget": F.lit(8000), "enable_mmr": F.lit(True), "mmr_lambda": F.lit(0.5), "candidate_limit": F.lit(50)}
    return F.struct(*(F.coalesce(got[n], d).alias(n) for n, d in defaults.items()))


def project(path: Column) -> Column:
    """The project of a path: its first part."""
    return F.split(path, "/")[0]


def project_catalog(artifacts: DataFrame, spans: DataFrame) -> DataFrame:
    """(project, artifacts, spans, tokens) of every project. A project's own tables are these, filtered."""
    named = artifacts.select(F.col("id").alias("artifact_id"), project(F.col("path")).alias("project"))
    per = spans.groupBy("artifact_id").agg(F.count("*").alias("n"), F.sum(F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0))).alias("t"))
    both = named.join(per, "artifact_id", "left")
    return both.groupBy("project").agg(F.count("*").alias("artifacts"), F.coalesce(F.sum("n"), F.lit(0)).alias("spans"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))


def of_project(artifacts: DataFrame, spans: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    own = artifacts.filter(project(F.col("path")) == name)
    return own, spans.join(own.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi")


def counters(timings: DataFrame, key: str, ms: str) -> DataFrame:
    """(key, count, total_ms, avg_ms): whole milliseconds, the mean rounded down; 0 for nothing."""
    total = F.coalesce(F.sum(F.floor(ms)), F.lit(0)).cast("long")
    return timings.groupBy(key).agg(F.count(ms).alias("count"), total.alias("total_ms")).withColumn("avg_ms", F.when(F.col("count") > 0, F.floor(F.col("total_ms") / F.col("count"))).otherwise(0).cast("long"))


def ask(sets: DataFrame, llm: str = "none", answer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, answer) of compiled working sets: the context itself, or what ``answer`` makes of the
    query and the first ``SHOWN`` characters. ``auto`` falls back to the context where there is no model."""
    if llm == "none" or answer is None and llm == "auto":
        return sets.select("query_id", F.col("text").alias("answer"))
    if answer is None:
        raise LookupError("no language model")
    return sets.select("query_id", answer(F.col("query"), F.left("text", F.lit(SHOWN))).alias("answer"))


def search_spans(queries: DataFrame, spans: DataFrame, artifacts: DataFrame, limit: int = 10, dim: int = 64) -> DataFrame:
    """(query_id, rank, result): the spans nearest to each query (query_id, embedding), as JSON."""
    best = vector_topk(queries, spans.select("id", "artifact_id", "start_line", "embedding"), limit, dim)
    held = spans.join(best.select("id").distinct(), "id", "left_semi").select("id", "artifact_id", "start_line", "end_line", "text", F.col("token_count").alias("tokens")).distinct()
    paths = artifacts.groupBy(F.col("id").alias("artifact_id")).agg(F.min("path").alias("artifact_path"))
    rows = best.join(held, "id").join(paths, "artifact_id", "left")
    entry = F.struct(F.col("id").alias("span_id"), "artifact_path", F.array("start_line", "end_line").alias("lines"), "text", "score", "tokens")
    return rows.select("query_id", "rank", F.to_json(entry).alias("result"))


def delete_spans(spans: DataFrame, doomed: DataFrame) -> DataFrame:
    """The other profile's deletion: the spans of the artifacts ``doomed`` (id) go, the artifacts stay."""
    return spans.join(doomed.select(F.col("id").alias("artifact_id")).distinct(), "artifact_id", "left_anti")


def lazy_documents(cited: DataFrame, least: float | None = None) -> Iterator[Row]:
    """Cited spans one after the other, by query and citation; the driver holds a partition at a time."""
    rows = cited if least is None else cited.filter(F.coalesce("score", F.lit(0.0)) >= least)
    yield from rows.orderBy("query_id", "citation").toLocalIterator()


def retriever(compiler: Compiler, search_type: str = "similarity", k: int = 4, fetch_k: int = 20, weight: float = 0.5, least: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function from requests to their first ``k`` spans: by similarity, by MMR, or those of a least score."""
    if search_type == "mmr":
        return lambda requests: compiler.mmr_search(requests, k, fetch_k, weight)
    if search_type == "similarity_score_threshold":
        return lambda requests: compiler.similarity_search(requests, k).filter(F.coalesce("score", F.lit(0.0)) >= (least or 0.0))
    if search_type != "similarity":
        raise ValueError(search_type)
    return lambda requests: compiler.similarity_search(requests, k)
