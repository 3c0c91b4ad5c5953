"""Model slots with defaults that need no model files, and label heads on vectors."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeloom.functions.text import tokens


def hashed_embedding(text: Column, size: int = 256) -> Column:
    """The default embedder: signed counts of hashed tokens at length 1; zeros for a text without tokens."""

    @F.pandas_udf("array<float>")
    def embed(words: pd.Series) -> pd.Series:
        out = np.zeros((len(words), size), dtype=np.float32)
        for row, found in zip(out, words, strict=True):
            for word in found if found is not None else ():
                h = zlib.crc32(word.encode())
                row[h % size] += 1 if h & 0x80000000 else -1
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return pd.Series(list(out))

    return embed(tokens(F.coalesce(text, F.lit(""))))


def _known(df: DataFrame, label: str) -> DataFrame:
    name = F.trim(F.col(label).cast("string"))
    return df.withColumn("_label", name).filter((name != "") & (F.lower(name) != "nan"))


def train_head(df: DataFrame, vector: str, label: str, rounds: int = 100) -> tuple[LogisticRegressionModel, list[str]]:
    """A logistic regression with balanced classes, and its class names in order.

    Rows with a null or blank label or a null vector teach nothing. Fewer than
    two classes raise. The penalty is 1 / rows, which stands for C = 1.
    """
    rows = _known(df, label).filter(F.col(vector).isNotNull())
    counts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}  # a row for each class
    names = sorted(counts)
    if len(names) < 2:
        raise ValueError(f"{label} needs two classes or more, not {len(names)}")
    total = sum(counts.values())
    code = F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, float(k))))
    weight = F.create_map(*(F.lit(x) for n in names for x in (n, total / (len(names) * counts[n]))))
    ready = rows.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"), code[F.col("_label")].alias("label"), weight[F.col("_label")].alias("weight")
    )
    return LogisticRegression(weightCol="weight", regParam=1 / total, standardization=False, maxIter=rounds).fit(ready), names


def predict_head(df: DataFrame, vector: str, model: LogisticRegressionModel, names: list[str], into: str = "predicted") -> DataFrame:
    """``df`` with the predicted class. A vector of another width raises when it is read; a null one gives null."""
    width = model.numFeatures
    wrong = F.raise_error(F.concat(F.lit(f"the head needs {width} numbers, not "), F.size(vector).cast("string"))).cast("array<double>")
    checked = F.when(F.col(vector).isNull(), F.array_repeat(F.lit(0.0), width)).when(F.size(vector) == width, F.col(vector).cast("array<double>")).otherwise(wrong)
    scored = model.transform(df.withColumn("features", array_to_vector(checked)))
    named = F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int"))
    return scored.select(*df.columns, F.when(F.col(vector).isNotNull(), named).alias(into))


def evaluate_head(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``accuracy, macro_f1, majority_f1`` and counts of a head, over rows with a label; majority_f1 is that of always the most frequent class."""
    from .metrics import classification

    rows = _known(df, truth)
    top = rows.groupBy("_label").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "_label"))["_label"].alias("_top"))
    base = classification(rows.crossJoin(F.broadcast(top)), "_label", "_top").select(F.col("macro_f1").alias("majority_f1"))  # one row
    return classification(rows, "_label", predicted).select("accuracy", "macro_f1", "correct", "total").crossJoin(F.broadcast(base))


#: The heads and the gold columns that they learn.
HEADS = {"intent": "queue", "ticket_type": "type", "urgency": "priority"}


def train_heads(df: DataFrame, vector: str, heads: dict[str, str] = HEADS) -> dict[str, tuple[LogisticRegressionModel, list[str]]]:
    """A head for each gold column; one that the table lacks raises."""
    missing = [c for c in heads.values() if c not in df.columns]
    if missing:
        raise ValueError(f"the gold columns {missing} are missing; there are {df.columns}")
    return {name: train_head(df, vector, column) for name, column in heads.items()}


def predict_heads(df: DataFrame, vector: str, heads: dict[str, tuple[LogisticRegressionModel, list[str]]]) -> DataFrame:
    """``df`` with a column for each head."""
    for name, (model, classes) in heads.items():
        df = predict_head(df, vector, model, classes, name)
    return df


def evaluate_heads(df: DataFrame, vector: str, heads: dict[str, tuple[LogisticRegressionModel, list[str]]], gold: dict[str, str] = HEADS) -> DataFrame:
    """``head, split, accuracy, macro_f1, majority_f1, n, beats_majority`` over all rows and each language of ``df(language)`` with two rows or more."""
    scored = predict_heads(df.withColumn("_lang", F.lower(F.substring("language", 1, 2))), vector, heads)
    languages = [r["_lang"] for r in scored.groupBy("_lang").count().filter("count >= 2").orderBy("_lang").collect() if r["_lang"]]
    out = None
    for name in heads:
        for split in ["all", *languages]:
            rows = scored if split == "all" else scored.filter(F.col("_lang") == split)
            part = evaluate_head(rows, gold[name], name).select(
                F.lit(name).alias("head"), F.lit(split).alias("split"), "accuracy", "macro_f1", "majority_f1", F.col("total").alias("n"), (F.col("macro_f1") > F.col("majority_f1")).alias("beats_majority")
            )
            out = part if out is None else out.unionByName(part)
    return out
