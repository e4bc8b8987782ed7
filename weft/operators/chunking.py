"""Cutting contents into line-ranged spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weft.functions import text as T


def _closing_size(line: Column) -> Column:
    """The size from which a chunk ends with this line."""
    return (
        F.when(line.rlike(T.HEADER), T.HEADER_AT).when(line.rlike(T.BREAK), T.BREAK_AT).when(line.rlike(T.DEFINITION), T.DEFINITION_AT).otherwise(T.LIMIT_AT)
    )


def chunk_ends(lines: Column) -> Column:
    """Numbers of the lines that end a chunk: a fold over the lines keeps the size of the open chunk."""
    state = "struct<size:int,at:int,ends:array<int>>"
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")).cast(state)

    def step(acc: Column, line: Column) -> Column:
        full = acc["size"] + 1 >= _closing_size(line)
        at = acc["at"] + 1
        return F.struct(
            F.when(full, 0).otherwise(acc["size"] + 1).alias("size"), at.alias("at"), F.when(full, F.concat(acc["ends"], F.array(at))).otherwise(acc["ends"]).alias("ends")
        ).cast(state)

    done = lambda acc: F.when(acc["size"] > 0, F.concat(acc["ends"], F.array(acc["at"]))).otherwise(acc["ends"])
    return F.aggregate(lines, start, step, done)


def chunk(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, span_id, start_line, end_line, text, token_count) of artifacts (id, content).

    Spans are contiguous and without gaps. Ids come from the artifact, the place and the text, so they
    stay the same when a content is ingested again. Null and empty contents give nothing.
    """
    rows = artifacts.select(F.col("id").alias("artifact_id"), T.lines(F.col("content")).alias("lines")).filter(F.size("lines") > 0)
    rows = rows.withColumn("ends", chunk_ends(F.col("lines")))
    rows = rows.select("artifact_id", "lines", "ends", F.posexplode("ends").alias("no", "end_line"))
    rows = rows.withColumn("start_line", F.when(F.col("no") == 0, 1).otherwise(F.get(F.col("ends"), F.col("no") - 1) + 1))
    rows = rows.withColumn("text", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    return rows.select(
        "artifact_id", F.sha2(F.concat_ws("|", "artifact_id", F.col("start_line").cast("string"), F.sha2("text", 256)), 256).alias("span_id"),
        "start_line", "end_line", "text", T.estimate_tokens(F.col("text")).alias("token_count"),
    )


def chunk_pg(artifacts: DataFrame, most: int = 50, target: int = 25, least: int = 10) -> DataFrame:
    """The other profile's chunks: up to ``most`` remaining lines are one chunk; else a chunk of
    ``target`` lines, ended earlier before the last blank line that lies at least ``least`` lines in.
    The search looks ahead from where a chunk begins, so it runs line by line on Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for artifact, lines in zip(frame["artifact_id"], frame["lines"]):
                blank = [not x.strip() for x in lines]
                at, n = 0, len(lines)
                while at < n:
                    end = n
                    if n - at > most:
                        end = next((i for i in range(at + target, at + least - 1, -1) if i < n and blank[i]), at + target)
                    rows.append((artifact, at + 1, end, "\n".join(lines[at:end])))
                    at = end
            yield pd.DataFrame(rows, columns=["artifact_id", "start_line", "end_line", "text"])

    rows = artifacts.select(F.col("id").alias("artifact_id"), T.lines(F.col("content")).alias("lines")).filter(F.size("lines") > 0)
    cut = rows.mapInPandas(run, "artifact_id string, start_line int, end_line int, text string")
    return cut.withColumn("token_count", T.estimate_tokens_floor(F.col("text")))
