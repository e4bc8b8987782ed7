"""Files as artifacts, and the JSON and Parquet sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from weft.functions.text import extension

# Names that a scan skips, marker files, patterns, extensions and limits.
SKIP = (
    ".git", ".svn", ".hg", "node_modules", ".node_modules", "venv", ".venv", "env", ".env", "__pycache__", ".pytest_cache", "target", "build", "dist", "out", ".next",
    ".cache", ".tox", "vendor", ".bundle", ".idea", ".vscode", ".vs",
)
MARKERS = {
    "python": ("pyproject.toml", "setup.py", "requirements.txt"), "javascript": ("package.json",), "rust": ("Cargo.toml",), "go": ("go.mod",),
    "java": ("pom.xml", "build.gradle"), "cpp": ("Makefile", "CMakeLists.txt"), "ruby": ("Gemfile",), "php": ("composer.json",),
}
PATTERNS = {
    "python": (".py", ".pyi"), "javascript": (".js", ".jsx", ".mjs"), "typescript": (".ts", ".tsx"), "rust": (".rs",), "go": (".go",), "java": (".java", ".kt"),
    "cpp": (".c", ".cpp", ".h", ".hpp"), "ruby": (".rb",), "php": (".php",), "unknown": (".py", ".js", ".ts", ".java", ".go", ".rs"),
}
EXTENSIONS = (".md", ".rs", ".ts", ".py", ".go", ".js", ".tsx", ".jsx", ".sql", ".proto", ".sh", ".toml", ".yaml", ".yml", ".json")
MAX_BYTES, PER_PATTERN, MAX_FILES = 2_000_000, 500, 1000


def skipped(path: Column) -> Column:
    """Whether a part of the path is a name that scans skip."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(s) for s in SKIP)))


def read_tree(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, content) of the text files below a folder, in no order; files that are not UTF-8 and
    skipped names are left out. Paths are relative to the folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    relative = F.regexp_replace("path", r"^.*?" + "".join(f"\\{c}" if not c.isalnum() else c for c in folder.rstrip("/")) + "/", "")
    rows = reader.load(folder).select(relative.alias("path"), F.col("content").alias("raw"))
    return rows.filter(~skipped(F.col("path"))).select("path", F.try_validate_utf8(F.col("raw").cast("string")).alias("content")).filter("content is not null")


def wanted_files(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Rows of (path, bytes, ...) with a known extension, under the size limit and not skipped."""
    return files.filter(extension(F.col("path")).isin(*EXTENSIONS) & (F.col("bytes") < most) & ~skipped(F.col("path")))


def project_type(files: DataFrame, project: str, typescript: Column | None = None) -> DataFrame:
    """(project, project_type) by the marker files among (project, path, ...); the first kind that has
    one wins. ``typescript`` says of a package.json row that it names TypeScript."""
    name = F.element_at(F.split("path", "/"), -1)
    seen = {kind: F.max(name.isin(*marks)) for kind, marks in MARKERS.items()}
    has_ts = F.max((name == "package.json") & typescript) if typescript is not None else F.lit(False)
    rows = files.groupBy(project).agg(*(c.alias(k) for k, c in seen.items()), has_ts.alias("ts"))
    out = F.when(F.col("python"), "python").when(F.col("javascript") & F.col("ts"), "typescript")
    for kind in list(MARKERS)[1:]:
        out = out.when(F.col(kind), kind)
    return rows.select(project, out.otherwise("unknown").alias("project_type"))


def project_files(files: DataFrame, kind: str, per_pattern: int = PER_PATTERN, most: int = MAX_FILES) -> DataFrame:
    """The files of a project type: at most ``per_pattern`` of each pattern, ``most`` in all, by path."""
    ext = extension(F.col("path"))
    rows = files.filter(ext.isin(*PATTERNS[kind])).withColumn("pattern", ext)
    rank = F.row_number().over(W.partitionBy("pattern").orderBy("path"))
    return rows.withColumn("n", rank).filter(F.col("n") <= per_pattern).orderBy("path").limit(most).drop("n")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database. With a whole-number ``key`` it is read in ``parts`` ranges of it, side by side."""
    whole = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    if key is None or parts < 2:
        return whole
    low, high = whole.agg(F.min(key), F.max(key)).first()
    if low is None:
        return whole
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts), **options).load()


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries (query, expected_paths, k) from a JSON array."""
    return spark.read.schema("query string, expected_paths array<string>, k int").json(path, multiLine=True)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions (question, answer_terms) from JSON lines; blank lines are skipped."""
    return spark.read.schema("question string, answer_terms array<string>").json(path).filter("question is not null")


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """The keys and every row as a JSON text."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))


def export_sessions(full: DataFrame, folder: str) -> None:
    """One JSON folder a session hash prefix, one line a session."""
    full.withColumn("part", F.left(F.sha2("id", 256), F.lit(2))).write.mode("overwrite").partitionBy("part").json(folder)


def save_corpus(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the tables as Parquet; each write is atomic."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_corpus(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
