"""The flagship plan: from a batch of queries to cited, hash-verifiable working sets."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from weft.functions import text as T, vectors as V
from weft.operators import context, retrieval, selection
from weft.runtime import stage


@dataclass(frozen=True)
class Config:
    token_budget: int = 8000
    enable_mmr: bool = True
    mmr_lambda: float = 0.5
    semantic_weight: float = 0.7
    lexical_weight: float = 0.3
    dimension: int = 64
    profile: str = "core"


class Compiler:
    """Compiles batches of requests (query_id, query, embedding?, budget?) against a corpus.

    ``spans`` has id, artifact_id, start_line, end_line, text, embedding, token_count; ``artifacts`` id
    and path. A request without an embedding column gets the hash embedding of its text; a null budget
    is the configuration's. Null token counts count as 0. ``count`` counts the tokens of a finished text.
    """

    def __init__(self, spans: DataFrame, artifacts: DataFrame, config: Config = Config(), count: Callable[[Column], Column] = T.estimate_tokens) -> None:
        self.config, self.count = config, count
        self.spans = spans.filter("id is not null").select("id", "artifact_id", "start_line", "end_line", "text", "embedding", "token_count")
        self.paths = artifacts.groupBy(F.col("id").alias("artifact_id")).agg(F.min("path").alias("path"))

    def requests(self, queries: DataFrame) -> DataFrame:
        budget = F.col("budget") if "budget" in queries.columns else F.lit(None)
        vector = F.col("embedding") if "embedding" in queries.columns else V.hash_embedding(F.coalesce("query", F.lit("")), self.config.dimension)
        return queries.select("query_id", "query", vector.alias("embedding"), F.coalesce(budget.cast("long"), F.lit(self.config.token_budget)).alias("budget")).dropDuplicates(["query_id"])

    def stages(self, queries: DataFrame, until: str = "final") -> dict[str, DataFrame]:
        """The candidates after each stage up to ``until``: query_id, id, score, rank.

        The two retrieval stages scan the corpus; what they find is written once, and so are the rows
        of the candidate spans, so the later stages handle at most 70 rows a request.
        """
        c, requests, pg = self.config, self.requests(queries), self.config.profile == "pg"
        vectors = self.spans.select("id", "artifact_id", "start_line", "embedding")
        out = {"semantic": stage(retrieval.vector_topk(requests, vectors, retrieval.SEMANTIC_K, c.dimension), "semantic")}
        if until in out:
            return out
        found = out["semantic"].select("id")
        if not pg:
            out["lexical"] = stage(retrieval.lexical_topk(requests, self.spans).withColumn("score", F.lit(None).cast("double")), "lexical")
            found = found.unionByName(out["lexical"].select("id"))
        tokens = F.greatest(F.coalesce(F.col("token_count"), F.lit(0)), F.lit(0)).cast("long")
        found = stage(found.distinct(), "found")  # small beside the spans: broadcast by its size, shuffled beyond
        names = [n for n in self.spans.columns if n != "id"]
        held = self.spans.join(found, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*names)).alias("r")).select("id", "r.*").withColumn("tokens", tokens).drop("token_count")
        held = held.withColumn("embedding", F.when(V.usable(F.col("embedding"), c.dimension), F.col("embedding")))
        held = stage(held.join(self.paths, "artifact_id", "left").withColumn("path", F.coalesce("path", F.lit("unknown"))), "held")
        last = out["semantic"]
        if not pg:
            fused = retrieval.fuse(out["semantic"], out["lexical"], c.semantic_weight, c.lexical_weight)
            last = retrieval.ordered(fused.join(held.select("id", "artifact_id", "start_line"), "id")).select("query_id", "id", "score", "rank")
            out["hybrid"] = last = last if c.enable_mmr else stage(last, "hybrid")
        if until in out:
            return out
        if c.enable_mmr:
            pick = selection.mmr_words(last.join(held.select("id", "text", "start_line", "path"), "id"), c.mmr_lambda) if pg else selection.mmr(last.join(held.select("id", "embedding"), "id"), c.mmr_lambda)
            out["mmr"] = last = stage(pick, "mmr")
        if until in out:
            return out
        ready = last.join(held.select("id", "tokens"), "id").join(requests.select("query_id", "budget"), "query_id")
        taken = selection.pack_in_order(ready) if pg else selection.pack(ready)
        out["packed"] = last.join(taken, ["query_id", "id"]).select("query_id", "id", "score", "rank")
        out["final"] = context.canonical(out["packed"].drop("rank").join(held.drop("embedding"), "id"), "path" if pg else "artifact_id")
        self.held = held
        return out

    def compile(self, queries: DataFrame) -> DataFrame:
        """One working set a request."""
        return context.working_sets(self.stages(queries)["final"], self.requests(queries), self.config.profile == "pg", self.count)

    def similarity_search(self, queries: DataFrame, k: int = 4) -> DataFrame:
        """The first ``k`` citations in canonical order of each request's compilation to 2,000 * k tokens;
        its own budget does not count."""
        return self._first(queries, k, token_budget=2000 * k)

    def mmr_search(self, queries: DataFrame, k: int = 4, fetch_k: int = 20, weight: float = 0.5) -> DataFrame:
        """The same with MMR, compiled to 1,000 * fetch_k tokens."""
        return self._first(queries, k, token_budget=1000 * fetch_k, enable_mmr=True, mmr_lambda=weight)

    def _first(self, queries: DataFrame, k: int, **options) -> DataFrame:
        other = copy(self)
        other.config = replace(self.config, **options)
        return other.stages(queries.drop("budget"))["final"].filter(F.col("citation") <= k)

    def explain(self, queries: DataFrame) -> DataFrame:
        """(query_id, stage, rank, id, path, start_line, end_line, score, tokens) of every stage."""
        stages = self.stages(queries)
        more = self.held.select("id", "path", "start_line", "end_line", "tokens")
        out = None
        for name, df in stages.items():
            rank = "citation" if name == "final" else "rank"
            rows = df.select("query_id", F.lit(name).alias("stage"), F.col(rank).cast("int").alias("rank"), "id", F.col("score").cast("double").alias("score"))
            out = rows if out is None else out.unionByName(rows)
        return out.join(more, "id").select("query_id", "stage", "rank", "id", "path", "start_line", "end_line", "score", "tokens")
