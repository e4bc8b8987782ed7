"""Mixing sources to target shares of all tokens by Sainte-Laguë apportionment.

The mixture's size is the largest at which no source needs to repeat its documents more often than it
may. It is cut into equal blocks of tokens, and the blocks go to the sources by highest quotients
share / (2 k + 1). A source's blocks are dealt to its shards in the same way, by their tokens, so that
each shard has an integer quota. A shard lays its documents end to end in a seeded order, which cuts
them into blocks of the same size, and takes its quota of them: whole passes first, then the first
blocks of the next pass. Where documents lie across the last block's end, single documents are added,
left out or exchanged as long as that brings the shard's tokens nearer to its quota.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from weft.llm.encoding import count_tokens
from weft.runtime import plain_columns, stage

BLOCKS = 100_000
#: Documents of a source that one task orders and selects from.
SHARD = 20_000


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1); ties go to the earlier weight.

    The divisor that would round to the seats is found by bisection, so the time does not depend on
    their number; the last few seats are dealt one by one.
    """
    total = sum(weights)
    if seats <= 0 or total <= 0:
        return [0] * len(weights)
    given = lambda d: [max(0, math.floor(w / d + 0.5)) if w > 0 else 0 for w in weights]
    low, high = total / (2.0 * seats + 2 * len(weights)), 2 * total / max(1, seats - len(weights) / 2) + max(weights) * 2
    for _ in range(200):
        middle = (low + high) / 2
        if sum(given(middle)) > seats:
            low = middle
        else:
            high = middle
    out = given(high)
    while sum(out) < seats:
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def source_key(column):
    """A source name without outer blanks and letter case."""
    return F.lower(F.trim(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")))


def _sized(documents: DataFrame, targets: DataFrame) -> DataFrame:
    wanted = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats >= 1")
    rows = documents.select("doc_id", source_key("source").alias("source"), "text").filter("doc_id is not null and text is not null")
    sized = count_tokens(rows.join(wanted.select("source").distinct(), "source", "left_semi").select("doc_id", "source", "text"))
    kept = sized.filter("n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d"))
    return kept.select("doc_id", "d.source", "d.n_tokens")


def _dealt(frame: pd.DataFrame) -> pd.DataFrame:
    frame = plain_columns(frame).sort_values("shard")
    frame["quota"] = sainte_lague([float(x) for x in frame["tokens"]], int(frame["blocks"].iloc[0]))
    return frame[["source", "shard", "quota"]]


def _nearest(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of the value of a sorted array that is nearest to each wanted one."""
    at = np.clip(np.searchsorted(values, wanted), 0, len(values) - 1)
    before = np.maximum(at - 1, 0)
    return np.where(np.abs(values[before] - wanted) <= np.abs(values[at] - wanted), before, at)


def taken(tokens: np.ndarray, quota: float, most: int) -> np.ndarray:
    """Copies of each document, in seeded order, for ``quota`` tokens with at most ``most`` copies each."""
    whole = int(min(most, quota // tokens.sum()))
    left = quota - whole * tokens.sum()
    copies = np.full(len(tokens), whole)
    if whole == most:
        return copies
    ends = tokens.cumsum()
    copies[ends - tokens / 2 <= left] += 1  # documents that lie in the first blocks
    gap = quota - float((tokens * copies).sum())
    for _ in range(16):
        more, less = np.flatnonzero(copies < most), np.flatnonzero(copies > 0)
        more, less = more[np.argsort(tokens[more], kind="stable")], less[np.argsort(tokens[less], kind="stable")]
        tries = []  # (what remains, document with a copy more, document with a copy less)
        if len(more):
            i = more[_nearest(tokens[more], np.array([gap]))[0]]
            tries.append((abs(gap - tokens[i]), i, -1))
        if len(less):
            i = less[_nearest(tokens[less], np.array([-gap]))[0]]
            tries.append((abs(gap + tokens[i]), -1, i))
        if len(more) and len(less):
            i = more[_nearest(tokens[more], gap + tokens[less])]
            rest = np.abs(gap - tokens[i] + tokens[less])
            at = int(rest.argmin())
            tries.append((rest[at], i[at], less[at]))
        best, add, drop = min(tries, key=lambda t: t[0], default=(np.inf, -1, -1))
        if best >= abs(gap):
            break
        for i, step in ((add, 1), (drop, -1)):
            if i >= 0:
                copies[i] += step
                gap -= step * float(tokens[i])
    return copies


def _select(block: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = plain_columns(frame).sort_values(["turn", "doc_id"])
        copies = taken(frame["n_tokens"].to_numpy(np.int64), int(frame["quota"].iloc[0]) * block, int(frame["max_repeats"].iloc[0]))
        return pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "n_tokens": frame["n_tokens"], "copies": copies.astype(np.int32)}).query("copies > 0")

    return run


def mix(documents: DataFrame, targets: DataFrame, seed: int = 11, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents taken.

    Source names are compared without outer blanks and letter case. A source of the targets that has no
    tokens is left out, and the other shares are scaled up to sum to 1. Null and empty texts, documents
    of other or null sources and targets without a positive share give nothing; of rows with the same doc_id
    the one with the least source and number of tokens stands. Without targets or documents the result is empty.
    """
    sized = stage(_sized(documents, targets), "sized")
    spark = documents.sparkSession
    wanted = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats >= 1")
    wanted = wanted.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    # One row a source of the target list: the driver deals the blocks.
    plan = wanted.join(held, "source").orderBy("source").toPandas()
    shape = "source string, blocks int, max_repeats int, shards int"
    rows, block = [], 1.0
    if len(plan):
        share = plan["target_share"] / plan["target_share"].sum()
        total = float((plan["tokens"] * plan["max_repeats"] / share).min())
        blocks = max(1, min(blocks, int(total)))
        block = total / blocks
        given = sainte_lague(share.tolist(), blocks)
        rows = [(s, b, int(m), max(1, math.ceil(n / shard))) for s, b, m, n in zip(plan["source"], given, plan["max_repeats"], plan["docs"])]
    dealt = spark.createDataFrame(rows, shape)
    turned = sized.join(F.broadcast(dealt), "source").withColumn("turn", F.xxhash64("doc_id", F.lit(seed)))
    turned = turned.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), "shards").cast("int"))
    quotas = turned.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens"), F.first("blocks").alias("blocks"))
    quotas = quotas.groupBy("source").applyInPandas(_dealt, "source string, shard int, quota int")
    kind = dict(sized.dtypes)["doc_id"]
    return turned.join(quotas, ["source", "shard"]).groupBy("source", "shard").applyInPandas(_select(block), f"doc_id {kind}, source string, n_tokens long, copies int")


def report(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, docs, most_copies) of every source of the targets."""
    wanted = targets.select(source_key("source").alias("source"), "target_share", F.col("max_repeats").alias("allowed")).filter("source is not null")
    got = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("docs"), F.max("copies").alias("most_copies"))
    out = wanted.join(got, "source", "left").withColumn("total", F.sum("tokens").over(W.partitionBy()))  # one row a source
    return out.select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "allowed",
    )
