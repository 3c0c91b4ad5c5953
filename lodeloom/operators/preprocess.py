"""Preparing tickets: cleaning, masking, entities, model inputs, splits and disjoint samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.functions import prompts as P
from lodeloom.functions import text as T
from lodeloom.sources.sinks import write_once

from .sampling import hash_rank, stratified_sample, three_way_split
from .tables import require_disjoint

METADATA = ["type", "queue", "priority", "language"]
NO_SUBJECT = "NO SUBJECT"


def preprocess(df: DataFrame) -> DataFrame:
    """Cleaned and masked tickets with ``PII_data, body_clean, body_entities``; rows without a body or an answer go.

    A null subject is NO SUBJECT; what is found in the body is kept before it is
    masked; columns that the table lacks are passed over.
    """
    has = set(df.columns)
    if "subject" in has:
        df = df.withColumn("subject", F.coalesce("subject", F.lit(NO_SUBJECT)))
    df = df.withColumns({c: T.clean_text(T.fix_encoding(F.coalesce(c, F.lit("")))) for c in ("subject", "body", "answer") if c in has})
    if "body" in has:
        df = df.withColumn("PII_data", T.extract_pii(F.col("body"))).withColumn("body", T.mask_pii(F.col("body")))
        df = df.withColumn("body_clean", T.fix_encoding(T.strip_breaks(F.col("body")))).withColumn("body_entities", T.entities(F.col("body")))
    if "answer" in has:
        df = df.withColumn("answer", T.mask_pii(F.col("answer")))
    df = df.withColumns({c: F.coalesce(c, F.lit("")) for c in df.columns if c.startswith("tag_")})
    return df.filter((F.length("body") > 0) & (F.length("answer") > 0))


def training_inputs(df: DataFrame) -> DataFrame:
    """``df`` with the inputs of the model families and ``target_text``."""
    metadata = P.metadata_string(df.columns, METADATA)
    return df.withColumns(P.input_formats(F.col("subject"), F.col("body"), metadata)).withColumn("target_text", F.col("answer"))


def training_split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``split``: 80 percent train by language, the rest in halves for val and test."""
    n = df.count()
    held = n - int(n * 0.8)
    part = three_way_split(df, key, "language", held, 0, seed) if "language" in df.columns else three_way_split(df.withColumn("_one", F.lit("")), key, "_one", held, 0, seed).drop("_one")
    rest = hash_rank(part.filter("split = 'test'").withColumn("_all", F.lit(1)), seed + 1, key, ["_all"]).drop("_all")
    rest = rest.withColumn("split", F.when(F.col("hash_rank") <= (held + 1) // 2, "test").otherwise("val")).drop("hash_rank")
    return part.filter("split = 'train'").unionByName(rest)


def samples(splits: dict[str, DataFrame], sizes: dict[str, int], key: str, group: str, root: str, force: bool = False, seed: int = 42) -> dict[str, tuple[DataFrame, str]]:
    """A stratified sample of each split, written once under ``root``, with its digest; samples that share an id raise."""
    out = {name: write_once(stratified_sample(df, key, group, sizes[name], seed), f"{root}/{name}_{sizes[name]}", force) for name, df in splits.items()}
    names = list(out)
    for i, one in enumerate(names):
        for other in names[i + 1 :]:
            require_disjoint(out[one][0], out[other][0], key)
    return out


def gold_labels(vectors: DataFrame, gold: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """Vectors with the gold labels of the same id; an id without gold raises when it is read."""
    joined = vectors.join(gold.select(F.col(key).cast("string").alias("_key"), *labels, F.lit(True).alias("_known")), F.col(key).cast("string") == F.col("_key"), "left")
    sure = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no gold labels for "), F.col(key).cast("string"))).cast("boolean"))
    return joined.filter(sure).drop("_key", "_known")


def rows_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id, as text, is in the list."""
    return df.join(ids.select(F.col(key).cast("string").alias("_id")).distinct(), F.col(key).cast("string") == F.col("_id"), "left_semi")
