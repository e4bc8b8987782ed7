"""Tables behind one interface, for sessions and corpora that are written to and read again."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession


class Store(ABC):
    """Named tables. ``append`` adds rows, ``replace`` puts new rows in place of all; readers see whole
    writes only."""

    @abstractmethod
    def read(self, name: str, schema: str) -> DataFrame: ...

    @abstractmethod
    def append(self, name: str, rows: DataFrame) -> None: ...

    @abstractmethod
    def replace(self, name: str, rows: DataFrame) -> None: ...


class ParquetStore(Store):
    """A folder a table. Every write is a folder of its own, numbered; the table is the last replacement
    and what was appended after it. Writes that have not ended have no success mark and are not read.
    One writer a table at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _writes(self, name: str, ended: bool = True) -> list[tuple[int, str]]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        out = [f.getPath() for f in fs.listStatus(path)]
        out = [p for p in out if not ended or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted((int(p.getName()[:8]), p.getName()) for p in out)

    def _write(self, name: str, rows: DataFrame, kind: str) -> None:
        past = self._writes(name, ended=False)
        rows.write.parquet(f"{self.folder}/{name}/{(past[-1][0] + 1 if past else 0):08}-{kind}")

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, "add")

    def replace(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, "all")

    def read(self, name: str, schema: str) -> DataFrame:
        names = [n for _, n in self._writes(name)]
        begin = max((i for i, n in enumerate(names) if n.endswith("-all")), default=0)
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{name}/{n}" for n in names[begin:]))
