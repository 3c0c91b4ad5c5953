"""Work on files as they arrive, each row once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def append_new(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Apply ``work`` to the Parquet files of ``source`` that earlier calls have not seen and append the rows to ``target``.

    Returns the rows read. ``checkpoint`` remembers files and written batches
    (the file sink's log), so a call that breaks off is taken up by the next
    without losing or repeating a row. ``work`` looks at rows, not across them.
    """
    stream = work(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
