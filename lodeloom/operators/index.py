"""A stored search index: written once, read by every search.

The index is split by documents: a row has a document's fields, its vector and
how often each of its terms occurs. A search sends blocks of queries to all rows
and each task sends back its best k for each query, so the postings of a
frequent term are spread over all tasks and never meet in one.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeloom.functions.text import tokens
from lodeloom.session import ship_package
from lodeloom.sources.sinks import exists

K1, B = 1.5, 0.75
#: Queries, and their distinct terms, that go to the executors at once.
QUERIES_AT_ONCE, TERMS_AT_ONCE = 1024, 200_000
#: Documents that are scored at once.
ROWS = 512
#: Metadata that a stored document keeps of its body.
BODY = 1000


def terms(text: Column) -> Column:
    """Tokens of two characters or more, as 64-bit hashes."""
    return F.transform(F.filter(tokens(text), lambda t: F.length(t) >= 2), lambda t: F.xxhash64(t))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``words`` of each row become its distinct terms and their counts."""
    for batch in batches:
        words = batch.column("words")
        flat, at = words.flatten().to_numpy(), words.offsets.to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        order = np.lexsort((flat, row))
        flat, row = flat[order], row[order]
        new = np.ones(len(flat), dtype=bool)
        new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        bounds = pa.array(np.searchsorted(row[first], np.arange(batch.num_rows + 1)).astype(np.int32))
        counts = np.diff(np.append(first, len(flat))).astype(np.int32)
        rest = [batch.column(c) for c in batch.schema.names if c != "words"]
        columns = [*rest, pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(bounds, pa.array(flat[first])), pa.ListArray.from_arrays(bounds, pa.array(counts))]
        yield pa.RecordBatch.from_arrays(columns, names=[c for c in batch.schema.names if c != "words"] + ["dl", "terms", "counts"])


@dataclass
class Index:
    """An index under ``root``. Without its lexical part, searches are dense."""

    spark: SparkSession
    root: str
    lexical: bool = True

    def documents(self) -> DataFrame:
        """``doc_id, subject, body, response, language, aspects``: what a hit shows."""
        return self.spark.read.parquet(f"{self.root}/documents")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vectors")

    def forward(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/forward")

    def frequencies(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/frequencies")

    def totals(self) -> tuple[int, float]:
        row = self.spark.read.parquet(f"{self.root}/totals").first()
        return row["n"], row["avgdl"] or 0.0


def build_index(spark: SparkSession, docs: DataFrame, root: str, body_chars: int = BODY) -> Index:
    """Write the index of ``docs(doc_id, subject, body, response, language, aspects, text, vector)`` under ``root``.

    ``text`` is searched by its terms; a document without a vector is not found
    by vectors. Shown bodies are cut to ``body_chars`` (0: whole). The only rows
    that are shuffled are the terms of each task, to count in how many documents
    each occurs.
    """
    ship_package(spark)
    body = F.col("body") if not body_chars else F.substring("body", 1, body_chars)
    docs.select("doc_id", "subject", body.alias("body"), "response", "language", "aspects").write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/documents")
    docs.filter("vector is not null").select("doc_id", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/vectors")
    forward = docs.select("doc_id", terms(F.col("text")).alias("words")).mapInArrow(_counted, "doc_id long, dl long, terms array<long>, counts array<int>")
    forward.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/forward")
    written = spark.read.parquet(f"{root}/forward")
    written.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/frequencies")
    written.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/totals")
    return Index(spark, root)


def open_index(spark: SparkSession, root: str) -> Index:
    """The index under ``root``; one whose lexical part is missing warns and answers by vectors alone."""
    if not exists(spark, f"{root}/documents/_SUCCESS"):
        raise FileNotFoundError(f"no index under {root}")
    lexical = all(exists(spark, f"{root}/{part}/_SUCCESS") for part in ("forward", "frequencies", "totals"))
    if not lexical:
        warnings.warn(f"the index under {root} has no terms: searches are dense", stacklevel=2)
    return Index(spark, root, lexical)


class Best:
    """The best k of each of n queries among scores that come in blocks; equal scores go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, least: float = -np.inf) -> None:
        """scores[query, document]; only those over ``least`` count."""
        q, d = np.nonzero((scores >= self.floor[:, None]) & (scores > least))
        self.parts.append((q, ids[d], scores[q, d]))
        self.held += len(q)
        if self.held > 4 * self.n * self.k + 10_000:
            self._settle()

    def _settle(self) -> None:
        if not self.parts:
            return
        q, d, s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        first = np.searchsorted(q, np.arange(self.n + 1))
        place = np.arange(len(q)) - first[q]
        keep = place < self.k
        full = place == self.k - 1
        self.floor[q[full]] = s[full]
        self.parts, self.held = [(q[keep], d[keep], s[keep])], int(keep.sum())

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        self._settle()
        q, d, s = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(d.astype(np.int64)), pa.array(s)], names=["query_id", "doc_id", "score"])


def _dense_block(ids: np.ndarray, vectors: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                best.add(np.round(vectors @ flat.reshape(batch.num_rows, -1).T, 6), batch.column("doc_id").to_numpy())
        yield best.rows(ids)

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def _blocks(spark: SparkSession, queries: DataFrame, column: str, most: int) -> Iterator[list]:
    """Rows of a stated set of queries, some at once: at most QUERIES_AT_ONCE, and of ``most`` numbers in all (or one row)."""
    some, size = [], 0
    for row in queries.select("query_id", column).filter(F.col(column).isNotNull()).toLocalIterator():
        if some and (len(some) >= QUERIES_AT_ONCE or size + len(row[1]) > most):
            yield some
            some, size = [], 0
        some.append((row[0], row[1]))
        size += len(row[1])
    if some:
        yield some


_NONE = "query_id long, doc_id long, score double"


def _union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    out = spark.createDataFrame([], _NONE)
    for part in parts:
        out = part if part is parts[0] else out.unionByName(part)
    return out


def dense_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_id, score, rank``: exact best k of ``docs(doc_id, vector)`` by inner product for ``queries(query_id, vector)``.

    Scores are rounded to 6 places before they are ranked; ties go to the
    smaller doc_id. Null vectors find nothing and are not found.
    """
    spark = docs.sparkSession
    ship_package(spark)
    stored = docs.filter("vector is not null").select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    parts = []
    for rows in _blocks(spark, asked, "vector", 1 << 40):
        ids, vectors = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        parts.append(stored.mapInArrow(_dense_block(ids, vectors, k), _NONE))
    return _ranked(_union(parts, spark), k)


class _Lexical:
    """BM25 of a block of queries: their terms, each term's weight, and which queries ask for it."""

    def __init__(self, rows: list, df: dict[int, int], n: int, avgdl: float):
        self.ids = np.array([r[0] for r in rows], np.int64)
        own = [np.unique(np.array(r[1], np.int64)) for r in rows]
        flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        query = np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.terms, of = np.unique(flat, return_inverse=True)
        asked = np.bincount(of, minlength=len(self.terms))
        known = np.array([df.get(int(t), 0) for t in self.terms], np.float64)
        self.idf = np.log(1 + (n - known + 0.5) / (known + 0.5))
        self.avgdl = avgdl or 1.0
        #: Terms of many queries are columns of a matrix; the others list their queries.
        self.column = np.full(len(self.terms), -1)
        common = np.flatnonzero((asked * 16 > len(rows)) & (asked > 1))
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(rows)))
        in_matrix = self.column[of] >= 0
        self.matrix[self.column[of[in_matrix]], query[in_matrix]] = 1.0
        rest = ~in_matrix
        order = np.argsort(of[rest], kind="stable")
        self.queries = query[rest][order]
        self.first = np.searchsorted(of[rest][order], np.arange(len(self.terms) + 1))

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        """[query, document]"""
        n, nq = batch.num_rows, len(self.ids)
        words = batch.column("terms")
        row = np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))
        flat, tf = words.flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.float64)
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        hit = self.terms[at] == flat
        row, at, tf = row[hit], at[hit], tf[hit]
        dl = batch.column("dl").to_numpy()[row]
        weight = self.idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl))
        column = self.column[at]
        dense = column >= 0
        table = np.zeros((n, len(self.matrix)))
        table[row[dense], column[dense]] = weight[dense]
        out = table @ self.matrix
        row, at, weight = row[~dense], at[~dense], weight[~dense]
        times = self.first[at + 1] - self.first[at]
        ends = np.cumsum(times)
        place = np.arange(int(times.sum())) + np.repeat(self.first[at] - (ends - times), times)
        cells = np.repeat(row * nq, times) + self.queries[place]
        out += np.bincount(cells, weights=np.repeat(weight, times), minlength=n * nq).reshape(n, nq)
        return out.T

    def search(self, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(self.ids), k)
            for whole in batches:
                for lo in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(lo, ROWS)
                    best.add(np.round(self.scores(batch), 4), batch.column("doc_id").to_numpy(), 0.0)
            yield best.rows(self.ids)

        return run


def bm25_search(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """``query_id, doc_id, score, rank``: the best k documents by BM25 for ``queries(query_id, text)``.

    Every distinct term of a query counts once, whole texts. Scores have 4
    places; ties go to the smaller doc_id; a score of 0 is no hit. What goes to
    the executors is bounded by QUERIES_AT_ONCE queries and TERMS_AT_ONCE terms.
    """
    spark = index.spark
    ship_package(spark)
    n, avgdl = index.totals()
    asked = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("words"))
    parts = []
    for rows in _blocks(spark, asked, "words", TERMS_AT_ONCE):
        wanted = spark.createDataFrame([(t,) for t in {t for _, own in rows for t in own}], "term long")
        df = {r["term"]: r["df"] for r in index.frequencies().join(F.broadcast(wanted), "term").collect()}  # at most TERMS_AT_ONCE, or one query's
        if df:
            parts.append(index.forward().mapInArrow(_Lexical(rows, df, n, avgdl).search(k), _NONE))
    return _ranked(_union(parts, spark), k)
