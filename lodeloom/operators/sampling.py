"""Seeded samples, splits and flags.

Rows are ordered by md5(seed:id), which does not depend on partitions. Ranks
come from counts of hash ranges, so no window sees more rows than a range.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges (of the first four hex digits) in which rows are ranked: some 150,000 rows each of 10^10.
_RANGE = 4
#: Rows that a range of keys has on average.
IN_RANGE = 100_000


def hash_order(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def unit_draw(seed: int, name: str, key: str) -> Column:
    """A number in [0, 1) for each row and purpose."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_rank(df: DataFrame, seed: int, key: str, groups: list[str]) -> DataFrame:
    """Adds ``hash_rank``: the place, from 1, of each row by md5(seed:key) within its group."""
    df = df.withColumn("_h", hash_order(seed, key)).withColumn("_r", F.substring("_h", 1, _RANGE))
    counts = df.groupBy(*groups, "_r").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_r")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy(*groups, "_r").orderBy("_h", key))
    on = [*groups, "_r"]
    out = df.withColumn("_l", local).join(before, on)  # 65,536 rows for each group at most
    return out.withColumn("hash_rank", (F.col("_l") + F.col("_b")).cast("long")).drop("_h", "_r", "_l", "_b")


def quotas(df: DataFrame, group: str, n: int) -> DataFrame:
    """``group, quota``: equal shares, the remainder to the first groups; what short groups lack is refilled in order.

    One row for each group, so the window over all of them is small.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    whole = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    groups = F.count("*").over(whole)
    share = F.floor(F.lit(n) / groups) + (F.row_number().over(Window.orderBy(group)) <= F.lit(n) % groups).cast("long")
    first = sizes.withColumn("first", F.least(share, F.col("size")))
    spare = F.col("size") - F.col("first")
    lack = F.greatest(F.lit(n) - F.sum("first").over(whole), F.lit(0))
    extra = F.least(spare, F.greatest(lack - F.coalesce(F.sum(spare).over(upto), F.lit(0)), F.lit(0)))
    return first.select(group, (F.col("first") + extra).alias("quota"))


def stratified_sample(df: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with equal shares of each group (all if there are fewer; none if n <= 0)."""
    if n <= 0:
        return df.limit(0)
    ranked = hash_rank(df, seed, key, [group]).join(quotas(df, group, n), group)
    return ranked.filter("hash_rank <= quota").select(*df.columns)


def three_way_split(df: DataFrame, key: str, group: str, n_test: int, n_validate: int, seed: int = 42) -> DataFrame:
    """Adds ``split``: exact counts of test and validate in proportion to the groups (largest remainder), the rest train."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    whole = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sizes.withColumn("total", F.sum("size").over(whole))
    for name, n in (("test", n_test), ("validate", n_validate)):
        exact = F.lit(n) * F.col("size") / F.col("total")
        out = out.withColumn("_floor", F.floor(exact)).withColumn("_part", F.round(exact - F.col("_floor"), 9))
        left = F.lit(n) - F.sum("_floor").over(whole)
        more = F.row_number().over(Window.orderBy(F.desc("_part"), group)) <= left
        out = out.withColumn(name, F.col("_floor") + more.cast("long"))
    ranked = hash_rank(df, seed, key, [group]).join(out.select(group, "test", "validate"), group)
    split = F.when(F.col("hash_rank") <= F.col("test"), "test").when(F.col("hash_rank") <= F.col("test") + F.col("validate"), "validate")
    return ranked.withColumn("split", split.otherwise("train")).select(*df.columns, "split")


def shuffle_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds ``is_val``: round(n * share) rows, at least 1 and at most n - 1 where share > 0 and n > 1."""
    ranked = hash_rank(df.withColumn("_all", F.lit(1)), seed, key, ["_all"])
    total = df.agg(F.count("*").alias("_n"))
    take = F.when((F.lit(share) > 0) & (F.col("_n") > 1), F.greatest(F.lit(1), F.least(F.round(F.col("_n") * share), F.col("_n") - 1))).otherwise(0)
    return ranked.join(F.broadcast(total)).withColumn("is_val", F.col("hash_rank") <= take).select(*df.columns, "is_val")


def dense_index(df: DataFrame, key: str, name: str = "idx", groups: list[str] | None = None) -> DataFrame:
    """Adds a gapless 0-based index by a numeric key, over all rows or within groups, without a window over all of them.

    Rows are ranked in ranges of the key between its quantiles, so ranges hold
    about IN_RANGE rows however the keys lie; counts of the ranges give what
    comes before. Null keys come first.
    """
    groups, n = groups or [], df.count()
    parts = -(-n // IN_RANGE)
    if parts > 1:
        number = F.col(key).cast("double")
        bounds = sorted(set(df.select(number.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)))
        splits = [-math.inf, *bounds, math.inf]
        known = Bucketizer(splits=splits, inputCol="_k", outputCol="_r", handleInvalid="keep")
        df = known.transform(df.withColumn("_k", F.coalesce(number, F.lit(-math.inf)))).drop("_k")
    else:
        df = df.withColumn("_r", F.lit(0.0))
    counts = df.groupBy(*groups, "_r").agg(F.count("*").alias("_n"))
    before = counts.select(*groups, "_r", (F.sum("_n").over(Window.partitionBy(*groups).orderBy("_r")) - F.col("_n")).alias("_b"))
    local = F.row_number().over(Window.partitionBy(*groups, "_r").orderBy(key)) - 1
    left, right = df.withColumn("_l", local), before
    on = [left[c].eqNullSafe(right[c]) for c in [*groups, "_r"]]
    joined = left.join(right, on).select(*(left[c] for c in df.columns if c != "_r"), left["_l"], right["_b"])
    return joined.withColumn(name, (F.col("_l") + F.col("_b")).cast("long")).drop("_l", "_b")


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (all if there are fewer), the first by hash; each task sends at most n."""
    return df.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(max(n, 0)).drop("_h")


def row_ranges(df: DataFrame, key: str, parts: int, name: str = "part") -> DataFrame:
    """Adds the number of each row's share of the rows in key order: equal shares, the last takes the rest."""
    total = max(1, df.count() // parts)
    return dense_index(df, key, "_i").withColumn(name, F.least(F.floor(F.col("_i") / total), F.lit(parts - 1)).cast("int")).drop("_i")


def by_id_text(df: DataFrame, key: str, name: str = "place", groups: list[str] | None = None) -> DataFrame:
    """Adds the place, from 1, of each row by the length of its id as text, then by the text, over all rows or within groups (no null ones).

    Ids are ranked within the ranges of their first characters; counts of these
    give what comes before.
    """
    text, groups = F.col(key).cast("string"), groups or []
    df = df.withColumn("_s", F.length(text)).withColumn("_t", text).withColumn("_r", F.substring("_t", 1, 3))
    counts = df.groupBy(*groups, "_s", "_r").agg(F.count("*").alias("_n"))  # a row for each group, length and beginning
    before = counts.select(*groups, "_s", "_r", (F.sum("_n").over(Window.partitionBy(*groups).orderBy("_s", "_r")) - F.col("_n")).alias("_b"))
    local = F.row_number().over(Window.partitionBy(*groups, "_s", "_r").orderBy("_t"))
    return df.withColumn("_l", local).join(F.broadcast(before), [*groups, "_s", "_r"]).withColumn(name, (F.col("_l") + F.col("_b")).cast("long")).drop("_s", "_t", "_r", "_l", "_b")


def id_range(df: DataFrame, key: str, low: int | None = None, high: int | None = None, strict: bool = True) -> DataFrame:
    """Rows whose id, as a number, is in the range, both ends included; without ends all rows.

    An id that is no number raises when it is read if ``strict``, else its row goes.
    """
    if low is None and high is None:
        return df
    number = F.col(key).cast("string").try_cast("bigint")
    if strict:
        wrong = F.raise_error(F.concat(F.lit(f"{key} must be a number, not "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("bigint")
        number = F.coalesce(number, wrong)
    inside = F.lit(True)
    if low is not None:
        inside = inside & (number >= low)
    if high is not None:
        inside = inside & (number <= high)
    return df.filter(inside)
