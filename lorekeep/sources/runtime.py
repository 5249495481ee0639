"""Getting this package to the executors' Python workers, and tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the session's Python files, once an application; workers may have no path to it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="lorekeep-src-")) / "lorekeep.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in one process as in tests) a temporary one that is set now."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends here and a lost executor costs no recomputation.

    Then the driver's JVM collects its garbage, so that Spark removes the shuffle files of what is over; else they would
    fill disks until memory runs low. The table's files go with discard(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorekeep-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _fs(spark, path).deleteOnExit(_path(spark, path))
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._lorekeep_path = path
    return out


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by cut() which nothing reads any more."""
    for t in tables:
        _fs(t.sparkSession, t._lorekeep_path).delete(_path(t.sparkSession, t._lorekeep_path), True)
