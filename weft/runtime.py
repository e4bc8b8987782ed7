"""Session helpers shared by every operator: table loading, tuning and staged tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Rows here may be long texts; small Arrow batches bound the memory of Python workers.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="weft-package-")) / "weft_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves the file to all executors, later ones too
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the session settings that the operators rely on and send the package to the workers."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


def plain_columns(frame: pd.DataFrame) -> pd.DataFrame:
    """The frame with text columns as plain objects: columns backed by no or several Arrow chunks, as
    after filtering or joining batches, can't be returned to Spark."""
    return frame.astype({c: object for c, t in frame.dtypes.items() if not isinstance(t, np.dtype)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and
    the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, the result survives the
    loss of executors and the folder is deleted when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
