"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodeloom.session import delete, shared_dir, ship_package

#: Rows in one Arrow batch handed to Python. Texts are long, so batches are short.
ARROW_ROWS = 256
#: Bytes in one, so a run of long texts or sets is several batches (a row of more is its own).
ARROW_BYTES = 4 << 20
#: Whether Spark deletes a query's shuffle files as soon as it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """What a session needs before Python reads texts: this package, and Arrow batches of bounded rows and bytes.

    Bounds that the session's user has set stay as they are.
    """
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if name not in spark.conf.getAll:
            spark.conf.set(name, str(most))
    ship_package(spark)


def fresh(name: str, *taken: list[str]) -> str:
    """``name``, or with underscores before it, so that no column (in any case) is called so."""
    used = {c.lower() for columns in taken for c in columns}
    while name in used:
        name = f"_{name}"
    return name


class Scratch:
    """Parquet tables of one operator call, under the shared folder.

    ``keep`` writes a frame and reads it back, which cuts its lineage: a lost
    executor costs a reread, not a recomputation. Nothing needs the shuffle files
    of the write then, so they go with it; a frame that runs again makes its own.
    ``drop`` removes a table that nothing reads any more; the rest goes when the
    driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodeloom/{name}-{uuid.uuid4().hex[:12]}"
        prepare(spark)
        atexit.register(delete, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))
