"""Joins, guards and upserts on keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, on: list[str], columns: list[str], missing: str = "none") -> DataFrame:
    """Left rows with columns of the right by trimmed keys; stale columns go first, missing values become ``missing``.

    Repeated keys on the right give a row each, as in any join (``require_unique`` guards against them).
    """
    left = left.drop(*[c for c in columns if c in left.columns])
    right = right.select(*(F.trim(F.col(k).cast("string")).alias(f"_{k}") for k in on), *columns)
    joined = left.join(right, [F.trim(F.col(k).cast("string")) == F.col(f"_{k}") for k in on], "left").drop(*(f"_{k}" for k in on))
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns})


def require_unique(df: DataFrame, key: str) -> None:
    """Raises if a key occurs twice."""
    twice = df.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {[r[0] for r in twice]}")


def require_disjoint(one: DataFrame, other: DataFrame, key: str) -> None:
    """Raises if the tables share a key."""
    shared = one.select(key).join(other.select(key), key, "left_semi").limit(5).collect()
    if shared:
        raise ValueError(f"{key} occurs in both: {[r[0] for r in shared]}")


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``item_id, n``: in how many documents the whole text of an item stands, character for character.

    Words are runs between white space. The first and the last word of an item
    may go on in a document, but the words between stand whole: documents and
    items meet on the hash of the first six of these, and what meets is
    compared. An item of one or two words meets every document.
    """
    words = lambda c: F.split(F.trim(F.col(c)), r"\s+")
    of = items.filter(F.trim(item_text) != "").select(F.col(item_id).alias("_item"), F.col(item_text).alias("_text"), words(item_text).alias("w"))
    of = of.withColumn("k", F.least(F.size("w"), F.lit(8)))
    of = of.withColumn("key", F.xxhash64("k", F.slice("w", F.lit(2), F.greatest(F.col("k") - 2, F.lit(0)))))
    said = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_whole"), words(text).alias("w"))
    sizes = [r["k"] for r in of.select("k").distinct().collect()]  # at most eight

    def inner(k: int) -> F.Column:
        """Hashes of the words between the first and the last of every run of k words."""
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(k), F.slice("w", i + 1, F.lit(max(k - 2, 0)))))

    if not sizes:
        return items.limit(0).select(item_id, F.lit(0).cast("long").alias("n"))
    keys = said.select("_doc", F.explode(F.array_distinct(F.flatten(F.array(*map(inner, sizes))))).alias("key"))
    met = keys.join(of.select("key", "_item", "_text"), "key").drop("key").distinct().join(said.select("_doc", "_whole"), "_doc")
    found = met.filter(F.contains("_whole", F.col("_text")))
    return found.groupBy(F.col("_item").alias(item_id)).agg(F.countDistinct("_doc").alias("n"))


def fill_from(left: DataFrame, right: DataFrame, on: list[str], columns: list[str], order: str) -> DataFrame:
    """A left value that is not blank wins; else that of the last right row (by ``order``) with the same key."""
    last = keep_last(right, on, order).select(*on, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = left.join(last, on, "left")
    return joined.withColumns({c: F.when(F.trim(c) != "", F.col(c)).otherwise(F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def fill_from_aspects(tickets: DataFrame, aspects: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``fill_from`` by idx where that is a number from 0 on, without repeats, in both tables; else by language, subject and body."""
    number = lambda df: df.agg(
        F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min(F.col("idx").cast("string").try_cast("bigint")).alias("low"),
        F.count_if(F.col("idx").cast("string").try_cast("bigint").isNull()).alias("bad"),
    ).first()
    both = [number(df) if "idx" in df.columns else None for df in (tickets, aspects)]
    by_idx = all(r is not None and r["n"] == r["d"] and r["low"] == 0 and not r["bad"] for r in both)
    return fill_from(tickets, aspects, ["idx"] if by_idx else ["language", "subject", "body"], columns, order)


def value_share(df: DataFrame, label: str, value: str) -> DataFrame:
    """``share`` of the rows whose label is the value, 4 places."""
    return df.agg(F.round(F.avg(F.coalesce(F.col(label) == value, F.lit(False)).cast("int")), 4).alias("share"))


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, by aggregation: a frequent key is reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_x"))
    return best.select(*key, "_x.*").select(*df.columns)


def first_id(df: DataFrame, key: list[str], id_: str) -> DataFrame:
    """The smallest id of each key."""
    return df.groupBy(*key).agg(F.min(id_).alias(id_))


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key, as text, is not among those done."""
    return df.join(done.select(F.col(key).cast("string").alias("_done")).distinct(), F.col(key).cast("string") == F.col("_done"), "left_anti")


def upsert(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """Old rows of labels that the new table does not have, and all new rows."""
    return old.join(new.select(label).distinct(), label, "left_anti").unionByName(new, allowMissingColumns=True)


def pick_by_route(routed: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """``reply``: the row's own on route ``rag``, else the fallback's; a missing fallback raises when the row is read."""
    joined = routed.join(fallback.select(key, F.col("reply").alias("_other")), key, "left")
    other = F.when(F.col("_other").isNotNull(), F.col("_other")).otherwise(F.raise_error(F.lit("no reply without context for a row that needs one")).cast("string"))
    return joined.withColumn("reply", F.when(F.col("route") == "rag", F.col("reply")).otherwise(other)).drop("_other")


def compare_systems(long: DataFrame, key: str, system: str, value: str, names: list[str]) -> DataFrame:
    """One column for each system."""
    return long.groupBy(key).pivot(system, names).agg(F.first(value))


def aligned(long: DataFrame, key: str, system: str) -> DataFrame:
    """Keys that not every system has."""
    n = long.select(system).distinct().count()
    return long.groupBy(key).agg(F.countDistinct(system).alias("systems")).filter(F.col("systems") < n)


def collapse_stats(df: DataFrame, label: str) -> DataFrame:
    """``distinct_labels, top_label, top_share`` of a label column; ties by name."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("distinct_labels"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l")))["l"].alias("top_label"),
        F.round(F.max("n") / F.sum("n"), 4).alias("top_share"),
    )


def pair_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, question, answer``: each user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("_r"), F.lead("text").over(w).alias("answer"))
    return rows.filter("role = 'user' and _r = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")
