"""Text and classification metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeloom.functions.text import tokens
from lodeloom.functions.vectors import cosine


def ngrams(w: Column, n: int) -> Column:
    if n == 1:
        return w
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))


def ascii_tokens(text: Column, stem: Callable[[Column], Column] | None = None) -> Column:
    """Lower-cased runs of a to z and digits, the older tokens of ROUGE; words of more than three letters through a caller's stemmer."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return found if stem is None else F.transform(found, lambda w: F.when(F.length(w) > 3, stem(w)).otherwise(w))


Tokens = Callable[[Column], Column]


def _counted(df: DataFrame, key: str, text: str, n: int, name: str, cut: Tokens = tokens) -> DataFrame:
    grams = df.select(key, F.explode(ngrams(cut(F.col(text)), n)).alias("g"))
    return grams.groupBy(key, "g").agg(F.count("*").alias(name))


def rouge_n(df: DataFrame, key: str, hypothesis: str, reference: str, n: int, cut: Tokens = tokens) -> DataFrame:
    """``key, rouge``: F1 of clipped n-gram overlap, 4 places; 0 where either has no n-gram.

    Both sides are counted by row and n-gram and meet on both, so the rows of
    one text are spread over its n-grams.
    """
    both = _counted(df, key, hypothesis, n, "h", cut).join(_counted(df, key, reference, n, "r", cut), [key, "g"], "full")
    sums = both.groupBy(key).agg(
        F.sum(F.least(F.coalesce("h", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("m"), F.sum("h").alias("h"), F.sum("r").alias("r")
    )
    f1 = F.when((F.col("m") > 0), F.round(2 * F.col("m") / (F.col("h") + F.col("r")), 4)).otherwise(F.lit(0.0))
    return df.select(key).distinct().join(sums, key, "left").select(key, F.coalesce(f1, F.lit(0.0)).alias("rouge"))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence by bit vectors: time in words of len(b) bits for each item of a."""
    if not a or not b:
        return 0
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def rouge_l(df: DataFrame, key: str, hypothesis: str, reference: str, cut: Tokens = tokens) -> DataFrame:
    """``key, rouge``: F1 of the longest common subsequence of tokens, 4 places."""

    @F.pandas_udf("int")
    def common(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")

    rows = df.select(key, cut(F.col(hypothesis)).alias("h"), cut(F.col(reference)).alias("r"))
    scored = rows.select(key, F.size("h").alias("nh"), F.size("r").alias("nr"), common("h", "r").alias("m"))
    f1 = F.when(F.col("m") > 0, F.round(2 * F.col("m") / (F.col("nh") + F.col("nr")), 4)).otherwise(F.lit(0.0))
    return scored.select(key, f1.alias("rouge"))


def bleu_counts(df: DataFrame, key: str, hypothesis: str, reference: str, most: int = 4) -> DataFrame:
    """``n, matched, total, hyp_len, ref_len``: clipped n-gram counts summed over the corpus."""
    out = None
    for n in range(1, most + 1):
        h, r = _counted(df, key, hypothesis, n, "h"), _counted(df, key, reference, n, "r")
        part = h.join(r, [key, "g"], "left").agg(
            F.lit(n).alias("n"), F.coalesce(F.sum(F.least("h", F.coalesce("r", F.lit(0)))), F.lit(0)).cast("long").alias("matched"), F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("total")
        )
        out = part if out is None else out.unionByName(part)
    size = lambda c: F.sum(F.size(tokens(F.col(c)))).cast("long")
    return out.join(F.broadcast(df.agg(size(hypothesis).alias("hyp_len"), size(reference).alias("ref_len"))))


def corpus_bleu(counts: DataFrame) -> DataFrame:
    """``bleu, p1, p4`` (0 to 100, 4 places) of ``bleu_counts``; 0 if some precision is 0."""
    p = F.col("matched") / F.col("total")
    row = counts.agg(
        F.sum(F.when(F.col("matched") > 0, F.log(p))).alias("logs"), F.min("matched").alias("least"),
        F.max(F.when(F.col("n") == 1, p)).alias("p1"), F.max(F.when(F.col("n") == 4, p)).alias("p4"),
        F.first("hyp_len").alias("h"), F.first("ref_len").alias("r"), F.count("*").alias("k"),
    )
    brevity = F.when(F.col("h") >= F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    bleu = F.when(F.col("least") > 0, 100 * brevity * F.exp(F.col("logs") / F.col("k"))).otherwise(0.0)
    return row.select(F.round(bleu, 4).alias("bleu"), F.round(100 * F.col("p1"), 4).alias("p1"), F.round(100 * F.col("p4"), 4).alias("p4"))


def classification(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``accuracy, macro_f1, weighted_f1, correct, total`` over the labels of either column; 0 where a rate is undefined.

    Only counts of label pairs are shuffled.
    """
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    ends = pairs.select("n", F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("is_t")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_t")))).alias("x"), (F.col("t") == F.col("p")).alias("hit"))
    by = ends.groupBy("x.label").agg(
        F.sum(F.when(F.col("x.is_t") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.is_t") == 0, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("hit") & (F.col("x.is_t") == 1), F.col("n")).otherwise(0)).alias("tp"),
    )
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return by.withColumn("f1", f1).agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.avg("f1"), 4).alias("macro_f1"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"),
        F.sum("tp").alias("correct"),
        F.sum("support").alias("total"),
    )


def coverage(aspects: DataFrame, sentences: DataFrame) -> DataFrame:
    """``key, coverage``: mean over a row's aspects of the best cosine with any of its sentences; 4 places.

    ``aspects(key, aspect, vector)``, ``sentences(key, vector)``; a row without either is absent.
    """
    both = aspects.join(sentences.select("key", F.col("vector").alias("other")), "key")
    best = both.groupBy("key", "aspect").agg(F.max(cosine(F.col("vector"), F.col("other"))).alias("best"))
    return best.groupBy("key").agg(F.round(F.avg("best"), 4).alias("coverage"))


def greedy_f1(hypothesis: DataFrame, reference: DataFrame) -> DataFrame:
    """``key, precision, recall, f1`` (4 places) of ``hypothesis(key, place, vector)`` and ``reference``: each token's best cosine on the other side, averaged.

    A key without tokens on one side is absent.
    """
    one = hypothesis.select("key", F.col("place").alias("i"), F.col("vector").alias("v"))
    two = reference.select("key", F.col("place").alias("j"), F.col("vector").alias("w"))
    met = one.join(two, "key").select("key", "i", "j", cosine(F.col("v"), F.col("w")).alias("c"))
    p = met.groupBy("key", "i").agg(F.max("c").alias("best")).groupBy("key").agg(F.avg("best").alias("p"))
    r = met.groupBy("key", "j").agg(F.max("c").alias("best")).groupBy("key").agg(F.avg("best").alias("r"))
    f1 = F.when(F.col("p") + F.col("r") != 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return p.join(r, "key").select("key", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))
