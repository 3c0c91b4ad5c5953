"""What a session needs before operators with Python code run on its executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and the session has one machine."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or f"/tmp/checkpoints/{os.getuid()}").rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; a session that has ended deletes nothing."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
        pass


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once under the shared folder and read back; it goes when the driver's Python ends."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/lodeloom/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(delete, spark, root)
    df.write.option("compression", "zstd").parquet(root)
    return spark.read.schema(df.schema).parquet(root)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so they need no installation."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lodeloom-")) / "lodeloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, os.path.join("lodeloom", path.relative_to(here)))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
