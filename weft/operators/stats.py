"""Corpus statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window as W

from weft.functions import labels


def corpus_stats(artifacts: DataFrame, spans: DataFrame, sessions: DataFrame, messages: DataFrame, agents: DataFrame) -> DataFrame:
    """One row of counts, total tokens and integer averages (0 where there is nothing to divide by)."""
    tables = {"artifacts": artifacts, "spans": spans, "sessions": sessions, "messages": messages, "agents": agents}
    counts = reduce(
        DataFrame.unionByName,
        [df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), (F.sum("token_count") if n == "spans" else F.lit(None)).cast("long").alias("t")) for n, df in tables.items()],
    )
    of = lambda n, c: F.coalesce(F.sum(F.when(F.col("name") == n, F.col(c))), F.lit(0))
    row = counts.agg(*(of(n, "n").alias(n) for n in tables), of("spans", "t").alias("tokens"))
    div = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) / F.col(b))).otherwise(0).cast("long")
    return row.withColumns({"tokens_per_span": div("tokens", "spans"), "spans_per_artifact": div("spans", "artifacts"), "status": labels.corpus_status(F.col("spans"))})


def token_histogram(spans: DataFrame) -> DataFrame:
    """(bucket, label, spans, percent) of five buckets of 200 tokens, the last one open; null counts as 0."""
    bucket = F.least(F.floor(F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)) / 200), F.lit(4)).cast("int")
    counts = spans.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("spans"))
    every = spans.sparkSession.range(5).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(counts, "bucket", "left").withColumn("spans", F.coalesce("spans", F.lit(0)))
    label = F.when(F.col("bucket") == 4, "800+").otherwise(F.concat((F.col("bucket") * 200).cast("string"), F.lit("-"), ((F.col("bucket") + 1) * 200).cast("string")))
    share = F.when(F.col("n") > 0, F.floor(F.col("spans") * 100 / F.col("n"))).otherwise(0).cast("long")
    out = out.withColumn("n", F.sum("spans").over(W.partitionBy()))  # five rows
    return out.select("bucket", label.alias("label"), "spans", share.alias("percent"))


def spans_hash(spans: DataFrame) -> DataFrame:
    """(artifact_id, n, spans_hash): changes when ids or vector lengths of an artifact's spans do.

    The spans of an artifact are hashed in up to 256 parts, by the hash of their ids, and the hash of the
    artifact is that of its parts' hashes, so that no row holds all spans of a large artifact.
    """
    entry = F.concat(F.col("id"), F.lit(":"), F.coalesce(F.size("embedding"), F.lit(0)).cast("string"))
    part = F.left(F.sha2("id", 256), F.lit(2))
    parts = spans.groupBy("artifact_id", part.alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256).alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ",")
    return parts.groupBy("artifact_id").agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias("spans_hash"))


def median_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, lowest, highest, mean, median) of a value by key."""
    v = F.col(value)
    return rows.groupBy(key).agg(
        F.count(v).alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.5), 6).alias("median")
    )
