"""Writing tables: CSV, JSON lines, samples that are written once, resumed work, reports."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeloom.operators.sampling import dense_index
from lodeloom.operators.tables import pending
from lodeloom.session import delete

BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV parts with a header each; ``bom`` puts the mark of UTF-8 before it."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, fields: list[str], mode: str = "overwrite") -> None:
    """JSON lines with the fields in that order, nulls included."""
    df.select(*fields).write.mode(mode).option("ignoreNullFields", False).json(path)


def digest(df: DataFrame) -> str:
    """Twelve hexadecimal digits that depend on the rows but not on their order or partitions."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    sums = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return sums.select(F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "s", "x"))), 256), 1, 12).alias("d")).first()["d"]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a write has ended there: one that was broken off has left no _SUCCESS."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def write_once(df: DataFrame, path: str, force: bool = False) -> tuple[DataFrame, str]:
    """The table at ``path``, written from ``df`` only where there is none yet (or by ``force``), and its digest."""
    spark = df.sparkSession
    if force or not _written(spark, path):
        df.write.mode("overwrite").parquet(path)
    kept = spark.read.parquet(path)
    return kept, digest(kept)


def resume(df: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], schema: StructType | str) -> DataFrame:
    """Apply ``work`` to the rows whose key is not yet at ``path``, append what it gives, return the whole table.

    A run that breaks off leaves only whole appends, so the next one goes on.
    """
    spark = df.sparkSession
    done = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    work(pending(df, done, key)).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def append_batches(df: DataFrame, path: str, fields: list[str], key: str, batch: int) -> int:
    """Append JSON lines, ``batch`` rows at a time, of rows whose key is not there yet; how many batches were written.

    Each batch is a whole append, so a run that breaks off loses one at most.
    """
    spark = df.sparkSession
    rows = df
    if exists(spark, path):
        rows = pending(df, spark.read.schema(df.select(*fields).schema).json(path), key)
    place = dense_index(rows.withColumn("_key", F.xxhash64(key)), "_key", "_place").drop("_key")
    total = rows.count()
    for k in range(-(-total // batch)):
        some = place.filter(F.floor(F.col("_place") / batch) == k)
        some.select(*fields).write.mode("append").option("ignoreNullFields", False).json(path)
    return -(-total // batch)


def clear(spark: SparkSession, path: str) -> None:
    """Remove saved work when it is no longer needed."""
    delete(spark, path)


def write_status(path: str, status: dict) -> None:
    """A small status file on the driver, replaced as a whole: a reader never sees half of one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(f".{target.name}.{os.getpid()}")
    draft.write_text(json.dumps(status, ensure_ascii=False, sort_keys=True), encoding="utf-8")
    os.replace(draft, target)


def set_config_value(path: str, key: str, value: object) -> bool:
    """Rewrite the line of a top-level key in a configuration; other lines stay as they are. False, and no change, without such a key."""
    target = Path(path)
    lines = target.read_text(encoding="utf-8").splitlines()
    for k, line in enumerate(lines):
        if line.partition(":")[0].strip() == key and not line[:1].isspace():
            lines[k] = f"{key}: {value}"
            target.write_text("\n".join(lines) + "\n", encoding="utf-8")
            return True
    warnings.warn(f"{path} has no {key}", stacklevel=2)
    return False


def save_heads(heads: dict[str, tuple[LogisticRegressionModel, list[str]]], path: str) -> None:
    """Write label heads and their class names under ``path``."""
    for name, (model, _) in heads.items():
        model.write().overwrite().save(f"{path}/{name}")
    spark = SparkSession.active()
    rows = [(name, list(classes)) for name, (_, classes) in sorted(heads.items())]
    spark.createDataFrame(rows, "head string, classes array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/classes")


def load_heads(spark: SparkSession, path: str) -> dict[str, tuple[LogisticRegressionModel, list[str]]]:
    """The heads that ``save_heads`` wrote."""
    if not exists(spark, f"{path}/classes"):
        raise FileNotFoundError(f"no heads under {path}")
    rows = spark.read.schema("head string, classes array<string>").json(f"{path}/classes").collect()
    return {r["head"]: (LogisticRegressionModel.load(f"{path}/{r['head']}"), r["classes"]) for r in rows}


def report(stats: DataFrame, title: str, digits: int = 4) -> str:
    """Markdown of ``stats(metric, system, n, mean, ci_low, ci_high)``: a table for each metric, the best mean in bold.

    The table has a row for each metric and system and comes to the driver.
    """
    rows = stats.select("metric", "system", "n", "mean", "ci_low", "ci_high").orderBy("metric", "system").collect()
    out = [f"# {title}", ""]
    for metric in dict.fromkeys(r["metric"] for r in rows):
        own = [r for r in rows if r["metric"] == metric]
        best = max((r["mean"] for r in own if r["mean"] is not None), default=None)
        out += [f"## {metric}", "", "| system | n | mean | 95 % interval |", "|---|---|---|---|"]
        for r in own:
            mean = "–" if r["mean"] is None else f"{r['mean']:.{digits}f}"
            mean = f"**{mean}**" if best is not None and r["mean"] == best else mean
            span = "–" if r["ci_low"] is None or r["ci_high"] is None else f"{r['ci_low']:.{digits}f} to {r['ci_high']:.{digits}f}"
            out.append(f"| {r['system']} | {r['n']} | {mean} | {span} |")
        out.append("")
    return "\n".join(out)
