"""Selecting candidates: diversity re-ranking and packing to a token budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weft.runtime import plain_columns

MMR_CAP, PG_CAP = 30, 20


def mmr_order(scores: np.ndarray, vectors: list, weight: float, cap: int = MMR_CAP) -> list[int]:
    """Indices in order of selection. The first candidate comes first; then always the one of the
    greatest weight * score - (1 - weight) * greatest cosine to a selected one, the earlier on ties.
    A candidate without a vector has similarity 0."""
    n = len(scores)
    has = np.array([v is not None and len(v) > 0 for v in vectors])
    lengths = {len(v) for v, h in zip(vectors, has) if h}
    gram = np.zeros((n, n))
    for d in lengths:  # vectors of different lengths have similarity 0
        at = [i for i in range(n) if has[i] and len(vectors[i]) == d]
        x = np.array([vectors[i] for i in at], np.float64)
        size = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        gram[np.ix_(at, at)] = x @ x.T
    chosen: list[int] = []
    left = np.ones(n, bool)
    close = np.full(n, -np.inf)  # greatest cosine to a selected candidate that has a vector
    while len(chosen) < min(n, cap):
        value = np.where(left, weight * scores - (1 - weight) * np.where(has & np.isfinite(close), close, 0.0), -np.inf)
        i = int(np.argmax(np.round(value, 12))) if chosen else 0
        chosen.append(i)
        left[i] = False
        if has[i]:
            close = np.maximum(close, gram[i])
    return chosen


def mmr(candidates: DataFrame, weight: float = 0.5, cap: int = MMR_CAP) -> DataFrame:
    """candidates (query_id, id, score, rank, embedding) -> (query_id, id, score, rank): the selected
    ones with the rank of selection. A query has at most 70 candidates, the sum of both top-k limits."""
    types = dict(candidates.dtypes)
    shape = f"query_id {types['query_id']}, id {types['id']}, score double, rank int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = plain_columns(frame).sort_values("rank")
        picked = mmr_order(frame["score"].to_numpy(np.float64), frame["embedding"].tolist(), weight, cap)
        out = frame.iloc[picked][["query_id", "id", "score"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    return candidates.select("query_id", "id", "score", "rank", "embedding").groupBy("query_id").applyInPandas(run, shape)


def mmr_words(candidates: DataFrame, weight: float = 0.5, cap: int = PG_CAP) -> DataFrame:
    """The other profile: similarity is the Jaccard index of words, at least 0, the first choice is
    free, and only the first candidate of each (path, start_line / 10) is kept."""
    types = dict(candidates.dtypes)
    shape = f"query_id {types['query_id']}, id {types['id']}, score double, rank int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = plain_columns(frame).sort_values("rank").reset_index(drop=True)
        bags = [set((t or "").split()) for t in frame["text"]]
        left, chosen, keys = list(range(len(frame))), [], set()
        close = np.zeros(len(frame))
        while left and len(chosen) < cap:
            value = [weight * frame["score"][i] - (1 - weight) * close[i] for i in left]
            i = left.pop(int(np.argmax(np.round(value, 12))))
            line = frame["start_line"][i]
            key = (frame["path"][i], None if pd.isna(line) else int(line) // 10)
            if key in keys:
                continue
            keys.add(key)
            chosen.append(i)
            for j in left:
                union = len(bags[i] | bags[j])
                close[j] = max(close[j], len(bags[i] & bags[j]) / union if union else 0.0)
        out = frame.iloc[chosen][["query_id", "id", "score"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    return candidates.groupBy("query_id").applyInPandas(run, shape)


def _fold(items: Column, budget: Column, largest: Column) -> Column:
    """Ids of the items (…, tokens, id) taken in order while they fit the budget."""
    state = "struct<total:long,ids:array<string>>"
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("ids")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        fits = (x["tokens"] <= largest) & (acc["total"] + x["tokens"] <= budget)
        taken = F.struct((acc["total"] + x["tokens"]).alias("total"), F.concat(acc["ids"], F.array(x["id"])).alias("ids")).cast(state)
        return F.when(fits, taken).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: acc["ids"])


def density(score: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, score / tokens).otherwise(F.lit(float("inf")))


def pack(candidates: DataFrame) -> DataFrame:
    """candidates (query_id, id, score, rank, tokens, budget) -> the taken (query_id, id).

    By density (score per token, endless for 0 tokens), then score, then rank, each candidate of at most
    half the budget is taken if it still fits. A budget of 0 or less takes nothing.
    """
    item = F.struct((-density(F.col("score"), F.col("tokens"))).alias("d"), (-F.col("score")).alias("s"), "rank", F.col("id").cast("string").alias("id"), F.col("tokens").cast("long").alias("tokens"))
    rows = candidates.filter("budget > 0").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("budget").cast("long").alias("budget"))
    half = F.floor(F.col("budget") / 2)
    return rows.select("query_id", F.explode(_fold(F.col("items"), F.col("budget"), half)).alias("id"))


def pack_in_order(candidates: DataFrame) -> DataFrame:
    """The other profile: by rank, whatever fits, without a limit for a single candidate."""
    item = F.struct("rank", F.col("id").cast("string").alias("id"), F.col("tokens").cast("long").alias("tokens"))
    rows = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("budget").cast("long").alias("budget"))
    return rows.select("query_id", F.explode(_fold(F.col("items"), F.col("budget"), F.col("budget"))).alias("id"))
