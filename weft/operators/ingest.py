"""Incremental ingest as copy-on-write tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weft.functions import text as T
from weft.operators.chunking import chunk


def content_hash(content):
    return F.sha2(content, 256)


def classify(incoming: DataFrame, artifacts: DataFrame) -> DataFrame:
    """incoming (path, content, ...) with content_hash, artifact_id and action: skip if the stored
    content is the same, update if it differs, create if the path is new."""
    held = artifacts.filter("path is not null").groupBy("path").agg(F.min(F.struct(F.col("id"), content_hash(F.col("content")).alias("h"))).alias("held"))
    new = incoming.drop("content_hash").withColumn("content_hash", content_hash(F.col("content")))
    same = F.col("held.h").eqNullSafe(F.col("content_hash"))
    action = F.when(F.col("held").isNull(), "create").when(same, "skip").otherwise("update")
    return new.join(held, "path", "left").withColumn("action", action).withColumn("artifact_id", F.col("held.id")).drop("held")


def latest(incoming: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each path by ``order``."""
    names = [c for c in incoming.columns if c != "path"]
    return incoming.groupBy("path").agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r")).select("path", "r.*")


def upsert(artifacts: DataFrame, incoming: DataFrame) -> DataFrame:
    """artifacts (id, path, content) after ``incoming`` (one row a path): changed paths are replaced,
    new ones added, the others kept. New ids come from the path."""
    judged = classify(incoming, artifacts).filter("action <> 'skip'")
    kept = artifacts.select("id", "path", "content").join(judged.select("path"), "path", "left_anti")
    return kept.select("id", "path", "content").unionByName(judged.select(F.sha2("path", 256).alias("id"), "path", "content"))


def delete_artifacts(artifacts: DataFrame, spans: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artifacts and spans without those of ``doomed`` (id), and the number of spans deleted for each."""
    doomed = doomed.select("id").distinct()
    gone = spans.join(doomed.withColumnRenamed("id", "artifact_id"), "artifact_id", "left_semi").groupBy("artifact_id").agg(F.count("*").alias("spans_deleted"))
    counts = doomed.join(gone.withColumnRenamed("artifact_id", "id"), "id", "left").select("id", F.coalesce("spans_deleted", F.lit(0)).alias("spans_deleted"))
    return artifacts.join(doomed, "id", "left_anti"), spans.join(doomed.withColumnRenamed("id", "artifact_id"), "artifact_id", "left_anti"), counts


def ingest_totals(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, spans_created, tokens_indexed)."""
    return chunk(artifacts).groupBy("artifact_id").agg(F.count("*").alias("spans_created"), F.sum("token_count").alias("tokens_indexed"))


def token_estimates(spans: DataFrame) -> DataFrame:
    t = F.col("text")
    return spans.filter("text is not null").select(
        "id", T.estimate_tokens(t).alias("bytes_up"), T.estimate_tokens_floor(t).alias("bytes_down"), T.estimate_tokens_points(t).alias("points_down"), T.estimate_tokens_utf16(t).alias("units_up")
    )
