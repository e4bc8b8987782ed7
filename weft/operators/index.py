"""Vector indexes behind one interface: exact search and an inverted file over cells, saved and checked.

An index is built from vectors (id, embedding[, artifact_id, start_line]) and answers batches of queries
(query_id, embedding) with ``search``. ``save`` writes it as Parquet with a description that holds a
version and a checksum; ``load`` refuses another version or checksum, and ``load_or_build`` then builds anew.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from weft.functions import vectors as V
from weft.operators.retrieval import _unit, vector_topk
from weft.runtime import stage

VERSION = 1
#: Vectors that the cells are fitted on, at most; every vector is indexed.
SAMPLE = 50_000


class StaleIndex(Exception):
    """The saved index has another version, or its rows do not match its checksum."""


def checksum(rows: DataFrame) -> str:
    """A checksum that does not depend on the order of the rows."""
    names = sorted(c for c in rows.columns if c != "cell")
    n, a, b = rows.agg(F.count("*"), F.sum(F.xxhash64(*names) % 1_000_003), F.sum(F.xxhash64(F.lit(1), *names) % 998_244_353)).first()
    return f"{n}-{a or 0}-{b or 0}"


class VectorIndex(ABC):
    kind = ""

    def __init__(self, rows: DataFrame, dim: int) -> None:
        self.rows, self.dim = rows, dim

    @classmethod
    def build(cls, vectors: DataFrame, dim: int) -> VectorIndex:
        return cls(vectors.filter(V.usable(F.col("embedding"), dim)), dim)

    @abstractmethod
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank) of the k most similar vectors."""

    def size(self) -> int:
        return self.rows.select("id").distinct().count()

    def extra(self) -> dict:
        return {}

    def save(self, folder: str) -> None:
        """Write rows, then the description: a folder without one is no index."""
        spark = self.rows.sparkSession
        out = self.rows.write.mode("overwrite")
        (out.partitionBy("cell") if "cell" in self.rows.columns else out).parquet(f"{folder}/rows")
        about = {"version": VERSION, "kind": self.kind, "dim": self.dim, "checksum": checksum(self.rows), **self.extra()}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> VectorIndex:
        about = json.loads(spark.read.text(f"{folder}/about").first().value)
        if about["version"] != VERSION:
            raise StaleIndex(f"version {about['version']}")
        rows = spark.read.parquet(f"{folder}/rows")
        if checksum(rows) != about["checksum"]:
            raise StaleIndex("checksum")
        kind = {c.kind: c for c in (ExactIndex, CellIndex)}[about["kind"]]
        return kind(rows, about["dim"], *([np.array(about["centres"])] if kind is CellIndex else []))

    @classmethod
    def load_or_build(cls, spark: SparkSession, folder: str, vectors: DataFrame, dim: int) -> VectorIndex:
        from pyspark.errors import PySparkException

        try:
            return VectorIndex.load(spark, folder)
        except (StaleIndex, PySparkException):
            index = cls.build(vectors, dim)
            index.save(folder)
            return VectorIndex.load(spark, folder)


class ExactIndex(VectorIndex):
    kind = "exact"

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return vector_topk(queries, self.rows, k, self.dim)


class CellIndex(VectorIndex):
    """An inverted file: every vector lies in the cell of its nearest centre, a query looks into the
    ``probes`` nearest cells (by default the 0.8th power of their number). The number of cells follows the square root of the collection's size, so a
    search compares a share of it that falls as it grows. The centres (a few thousand) are fitted on a
    sample of at most ``SAMPLE`` vectors by spherical k-means."""

    kind = "cells"

    def __init__(self, rows: DataFrame, dim: int, centres: np.ndarray, probes: int | None = None) -> None:
        super().__init__(rows, dim)
        self.centres = centres
        self.probes = probes or max(1, round(len(centres) ** 0.8))

    @classmethod
    def build(cls, vectors: DataFrame, dim: int, cells: int | None = None, seed: int = 5) -> CellIndex:
        rows = vectors.filter(V.usable(F.col("embedding"), dim))
        n = rows.count()
        k = min(cells or max(1, min(4096, round(n**0.5 / 2))), max(n, 1))
        drawn = rows.withColumn("turn", F.xxhash64("id", F.lit(seed))).orderBy("turn", "id").limit(SAMPLE).select("embedding").toPandas()
        x = _unit(np.array(drawn["embedding"].tolist(), np.float64).reshape(-1, dim))
        centres = x[:k].copy() if len(x) else np.zeros((1, dim))
        for _ in range(8):
            if not len(x):
                break
            near = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            full = np.bincount(near, minlength=len(centres)) > 0
            centres[full] = _unit(sums[full])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                unit = _unit(np.array(f["embedding"].tolist(), np.float64).reshape(len(f), dim))
                yield f.assign(cell=(unit @ centres.T).argmax(1).astype(np.int32) if len(f) else np.empty(0, np.int32))

        shape = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell int"
        return cls(stage(rows.mapInPandas(run, shape), "cells"), dim, centres)

    def extra(self) -> dict:
        return {"centres": self.centres.tolist()}

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Queries meet the vectors of their cells by a join on the cell, each vector is compared where it
        lies; a cell with very many vectors is split by the adaptive skew join."""
        centres, probes, dim = self.centres, self.probes, self.dim
        types = dict(queries.dtypes)

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                unit = _unit(np.array(f["embedding"].tolist(), np.float64).reshape(len(f), dim))
                near = np.argsort(-(unit @ centres.T), 1, kind="stable")[:, :probes] if len(f) else np.empty((0, 1), int)
                at = np.repeat(np.arange(len(f)), near.shape[1])
                yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[at], "q": f["embedding"].to_numpy()[at], "cell": near.reshape(-1).astype(np.int32)})

        asked = queries.select("query_id", "embedding").filter(V.usable(F.col("embedding"), dim)).mapInPandas(route, f"query_id {types['query_id']}, q {types['embedding']}, cell int")
        pairs = asked.join(self.rows, "cell")
        best = pairs.withColumn("score", F.round(V.cosine(F.col("q"), F.col("embedding")), 9)).drop("q", "embedding", "cell")
        ties = [c for c in ("artifact_id", "start_line") if c in best.columns]
        best = best.groupBy("query_id", "id").agg(F.max("score").alias("score"), *(F.min(c).alias(c) for c in ties))
        order = [F.col("score").desc(), *(F.col(c).asc_nulls_last() for c in ties), F.col("id")]
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
        return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def overlap(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, k, overlap): the share of the exact ids that were found."""
    ids = lambda df, n: df.groupBy("query_id").agg(F.collect_set("id").alias(n))
    both = ids(exact, "want").join(ids(found, "got"), "query_id", "left")
    got = F.coalesce(F.size(F.array_intersect("want", "got")), F.lit(0))
    return both.select("query_id", F.size("want").alias("k"), (got / F.size("want")).alias("overlap"))
