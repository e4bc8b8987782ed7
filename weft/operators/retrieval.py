"""Retrieval for batches of queries: exact vector top-k, lexical matches and their fusion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from weft.functions import vectors as V
from weft.runtime import plain_columns

SEMANTIC_K, LEXICAL_K, RRF_K = 50, 20, 60
#: Queries that one pass over the corpus carries along; more go in several passes.
BLOCK = 2048
#: Query texts that one pass carries along.
TEXTS = 20_000


def _blocks(queries: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """The query set in blocks of a bounded number of rows, one at a time."""
    part: list = []
    for row in queries.toLocalIterator(prefetchPartitions=True):
        part.append(tuple(row))
        if len(part) == size:
            yield pd.DataFrame(part, columns=queries.columns)
            part = []
    if part:
        yield pd.DataFrame(part, columns=queries.columns)


def _tie(vectors: DataFrame) -> Column:
    """A text that sorts like artifact_id, start_line (null last) and id, as far as there are such columns."""
    out = []
    if "artifact_id" in vectors.columns:
        out.append(F.coalesce(F.col("artifact_id").cast("string"), F.lit("\uffff")))
    if "start_line" in vectors.columns:
        out.append(F.coalesce(F.lpad((F.col("start_line").cast("long") + 2**31).cast("string"), 10, "0"), F.lit("~")))
    if not out and dict(vectors.dtypes)["id"] in ("int", "bigint"):
        return F.lpad((F.col("id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat_ws("\x01", *out, F.col("id").cast("string"))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, dim: int, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k vectors most similar to each query, exactly.

    ``queries`` has query_id and embedding, ``vectors`` id, embedding and, if at hand, artifact_id and
    start_line. Every pass scans the vectors once against a block of queries by matrix products and keeps
    the k best ids of each partition, so that only k rows a query and partition are shuffled. Scores are
    rounded to 9 digits before ranking; ties are by artifact_id, start_line and id. Vectors of another length or with null
    or non-finite entries are left out, zero vectors score 0. Of several rows of an id the best counts.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(V.usable(F.col("embedding"), dim)).select("id", "embedding", _tie(vectors).alias("tie"))
    id_type = dict(rows.dtypes)["id"]
    query_type = dict(queries.dtypes)["query_id"]
    shape = f"query_id {query_type}, id {id_type}, score double, tie string"
    parts = []
    for frame in _blocks(queries.select("query_id", "embedding").filter(V.usable(F.col("embedding"), dim)), block):
        q = np.array(frame["embedding"].tolist(), np.float64).reshape(len(frame), dim)
        held = spark.sparkContext.broadcast((frame["query_id"].tolist(), _unit(q)))  # at most a block of queries

        def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, q = held.value
            best = _Best(len(names), k)
            for f in frames:
                if len(f):
                    s = np.round(q @ _unit(np.array(f["embedding"].tolist(), np.float64).reshape(len(f), dim)).T, 9)
                    best.add(s, f["id"].to_numpy(), f["tie"].to_numpy().astype("U"))
            at, ids, ties, scores = best.take()
            if len(at):
                yield pd.DataFrame({"query_id": [names[i] for i in at], "id": ids.astype(object) if ids.dtype.kind == "U" else ids, "score": scores, "tie": ties.astype(object)})

        parts.append(rows.mapInPandas(run, shape))
    if not parts:
        return spark.createDataFrame([], f"query_id {query_type}, id {id_type}, score double, rank int")
    out = reduce(DataFrame.unionByName, parts)
    best = out.groupBy("query_id", "id").agg(F.max(F.struct("score")).alias("s"), F.min("tie").alias("tie"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("s.score").desc(), "tie"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "s.score", "rank")


class _Best:
    """The k best ids of each query over batches of scores; the rows kept stay within a few times k."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.room = k, 4 * queries * k
        self.least = np.full(queries, -np.inf)
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> None:
        floor = self.least
        names = ids.astype("U") if ids.dtype == object else ids
        if scores.shape[1] > self.k and len(np.unique(names)) == len(names):
            floor = np.maximum(floor, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        q, j = np.nonzero(scores >= floor[:, None])
        self.parts.append((q, names[j], ties[j], scores[q, j]))
        self.held += len(q)
        if self.held > self.room:
            self.take()

    def take(self) -> tuple:
        if not self.parts:
            return (np.empty(0, int),) * 4
        q, ids, ties, scores = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ties, -scores, ids, q))  # the best row of each id
        order = order[np.r_[True, (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])]]
        order = order[np.lexsort((ties[order], -scores[order], q[order]))]
        q, ids, ties, scores = q[order], ids[order], ties[order], scores[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = place < self.k
        last = place == self.k - 1
        self.least[q[last]] = scores[last]
        self.parts = [(q[keep], ids[keep], ties[keep], scores[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def like_pattern(query: str) -> re.Pattern:
    """LIKE '%query%' with live wildcards, on text whose ASCII letters are in lower case."""
    return re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in query), re.S)


def lexical_matches(queries: DataFrame, spans: DataFrame, block: int = TEXTS, carry: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(query_id, id, *carry) of all spans (id, text, *carry) that contain the whole query, ASCII
    letters compared without case, ``%`` and ``_`` being wildcards. Spans given twice count once. With
    ``most``, each partition passes on only the first so many spans of a query by ``carry`` and id.

    One pass over the spans looks for a whole block of queries: an Aho-Corasick automaton finds the
    longest literal piece of each query, and a query with wildcards is then matched in full. Null and
    empty queries match nothing, null texts neither.
    """
    import ahocorasick

    spark = spans.sparkSession
    names = ["id", *carry]
    shape = f"query_id {dict(queries.dtypes)['query_id']}, " + ", ".join(f"{c} {dict(spans.dtypes)[c]}" for c in names)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = []
    for frame in _blocks(queries.select("query_id", "query").filter("query is not null and query <> ''"), block):
        wanted: dict[str, list] = {}
        always = []
        for query_id, query in zip(frame["query_id"], frame["query"]):
            query = query.translate(lower)
            piece = max(re.split("[%_]", query), key=len)
            (wanted.setdefault(piece, []) if piece else always).append((query_id, query, piece == query))
        held = spark.sparkContext.broadcast((wanted, always))

        def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            wanted, always = held.value
            automaton = ahocorasick.Automaton()
            for piece in wanted:
                automaton.add_word(piece, piece)
            if wanted:
                automaton.make_automaton()
            patterns: dict[str, re.Pattern] = {}
            kept = _First(most)
            for f in frames:
                q, s = [], []
                for i, text in enumerate(f["text"]):
                    text = text.translate(lower)
                    asked = [x for piece in {p for _, p in automaton.iter(text)} for x in wanted[piece]] if wanted else []
                    for query_id, query, literal in asked + always:
                        if not literal:
                            if query not in patterns:
                                patterns[query] = like_pattern(query)
                            if not patterns[query].search(text):
                                continue
                        q.append(query_id)
                        s.append(i)
                found = plain_columns(f[names]).iloc[s].assign(query_id=np.array(q, object))[["query_id", *names]]
                yield found if most is None else kept.add(found)
            if most is not None:
                if kept.held:
                    yield kept.rest()

        parts.append(spans.filter("text is not null").select(*names, "text").mapInPandas(run, shape))
    if not parts:
        return spark.createDataFrame([], shape)
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["query_id", "id"])


class _First:
    """The first rows of each query by the carried columns and id, over batches of matches."""

    def __init__(self, most: int | None) -> None:
        self.most, self.held, self.n = most, [], 0

    def add(self, found: pd.DataFrame) -> pd.DataFrame:
        self.held.append(found)
        self.n += len(found)
        if self.n > 100_000:
            self.held = [self._cut()]
            self.n = len(self.held[0])
            if self.n > 50_000:  # very many queries: what is held leaves early
                out, self.held, self.n = self.held[0], [], 0
                return out
        return found.iloc[:0]

    def _cut(self) -> pd.DataFrame:
        rows = pd.concat(self.held).drop_duplicates(["query_id", "id"])
        order = [c for c in rows.columns if c not in ("query_id", "id")] + ["id"]
        return plain_columns(rows.sort_values(order, na_position="last").groupby("query_id").head(self.most))

    def rest(self) -> pd.DataFrame:
        return self._cut() if self.held else pd.DataFrame()


def lexical_topk(queries: DataFrame, spans: DataFrame, k: int = LEXICAL_K) -> DataFrame:
    """(query_id, id, rank): the first k matching spans by artifact, line and id."""
    found = lexical_matches(queries, spans, carry=("artifact_id", "start_line"), most=k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("artifact_id", F.col("start_line").asc_nulls_last(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "rank")


def fuse(semantic: DataFrame, lexical: DataFrame, semantic_weight: float = 0.7, lexical_weight: float = 0.3) -> DataFrame:
    """(query_id, id, score): reciprocal ranks, weighted; the first rank counts as 0."""
    part = lambda df, w: df.select("query_id", "id", (F.lit(float(w)) / (RRF_K + F.col("rank") - 1)).alias("part"))
    both = part(semantic, semantic_weight).unionByName(part(lexical, lexical_weight))
    return both.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def ordered(candidates: DataFrame) -> DataFrame:
    """candidates (query_id, id, score, artifact_id, start_line) with rank by score, artifact, line, id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "artifact_id", F.col("start_line").asc_nulls_last(), "id"))
    return candidates.withColumn("rank", rank)
