"""Bootstrap intervals and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import dense_index


def draws(spark, n: int, resamples: int, seed: int = 42) -> DataFrame:
    """``draw, slot, pos``: positions 0..n-1 drawn with replacement, the same for all systems with n rows.

    resamples * n rows, made on the executors. An evaluation sample is meant (hundreds to millions of rows).
    """
    cells = spark.range(resamples * n).select((F.col("id") / n).cast("long").alias("draw"), (F.col("id") % n).alias("slot"))
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10)
    return cells.withColumn("pos", word.cast("long") % n)


#: Values that a draw's places are looked up in on every executor; more are joined by place.
BROADCAST_VALUES = 1_000_000


def _drawn(spark, rows: DataFrame, n: int, resamples: int, seed: int) -> DataFrame:
    """Draws and the rows at their places: a bounded number of rows goes to the draws, which then need no shuffle."""
    return draws(spark, n, resamples, seed).join(F.broadcast(rows) if n <= BROADCAST_VALUES else rows, "pos")


def _interval(c: str, low: str, high: str) -> list:
    return [F.round(F.percentile(c, 0.025), 4).alias(low), F.round(F.percentile(c, 0.975), 4).alias(high)]


def bootstrap_ci(spark, df: DataFrame, key: str, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """``n, mean, ci_low, ci_high`` of the values that are neither null nor NaN, in key order; 4 places."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(key, F.col(value).alias("v"))
    rows = dense_index(known, key, "pos").select("pos", "v")
    n = known.count()
    if not n:
        return spark.createDataFrame([(0, None, None, None)], "n long, mean double, ci_low double, ci_high double")
    means = _drawn(spark, rows, n, resamples, seed).groupBy("draw").agg(F.avg("v").alias("m"))
    whole = rows.agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))
    return whole.join(F.broadcast(means.agg(*_interval("m", "ci_low", "ci_high"))))


def paired_bootstrap(spark, df: DataFrame, key: str, baseline: str, systems: list[str], resamples: int = 1000, seed: int = 42) -> DataFrame:
    """``system, n, mean, diff, diff_ci_low, diff_ci_high, significant`` against a baseline column.

    Rows with a baseline value count; a system's missing value is its own mean.
    All systems share the draws. Systems without any value are left out, as
    are bases of fewer than two rows.
    """
    known = df.filter(F.col(baseline).isNotNull() & ~F.isnan(baseline))
    rows = dense_index(known, key, "pos").select("pos", F.col(baseline).cast("double").alias("base"), *(F.col(s).cast("double") for s in systems))
    n = rows.count()
    schema = "system string, n long, mean double, diff double, diff_ci_low double, diff_ci_high double, significant boolean"
    if n < 2:
        return spark.createDataFrame([], schema)
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.when(~F.isnan(s), F.col(s)).alias("v")) for s in systems)))
    long = rows.select("pos", "base", pairs.alias("x")).select("pos", "base", "x.system", "x.v")
    means = long.groupBy("system").agg(F.avg("v").alias("own")).filter("own is not null")  # a row for each system
    filled = long.join(F.broadcast(means), "system").select("system", "pos", F.coalesce("v", "own").alias("v"), "base")
    drawn = _drawn(spark, filled, n, resamples, seed).groupBy("system", "draw").agg(F.avg(F.col("v") - F.col("base")).alias("d"))
    spread = drawn.groupBy("system").agg(*_interval("d", "diff_ci_low", "diff_ci_high"))
    whole = filled.groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.avg(F.col("v") - F.col("base")), 4).alias("diff"))
    return whole.join(spread, "system").withColumn("significant", (F.col("diff_ci_low") > 0) | (F.col("diff_ci_high") < 0))


def threshold_sweep(df: DataFrame, score: str, with_context: str, without: str, taus: list[float]) -> DataFrame:
    """``threshold, mean, rag_share, n, best``: mean of the value that each threshold picks; best is the smallest of the best means.

    Each row has its two values already, so a threshold costs a comparison.
    """
    x = F.col(score).try_cast("double")
    spread = df.select(x.alias("s"), F.col(with_context).alias("w"), F.col(without).alias("o")).withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in taus))))
    rag = F.coalesce(F.col("s") >= F.col("threshold"), F.lit(False))
    out = spread.groupBy("threshold").agg(
        F.round(F.avg(F.when(rag, F.col("w")).otherwise(F.col("o"))), 4).alias("mean"), F.round(F.avg(rag.cast("int")), 4).alias("rag_share"), F.count("*").alias("n")
    )
    best = out.agg(F.max(F.struct(F.col("mean"), (-F.col("threshold")).alias("t"))).alias("b"))
    return out.join(F.broadcast(best)).select("threshold", "mean", "rag_share", "n", (F.col("threshold") == -F.col("b.t")).alias("best"))
