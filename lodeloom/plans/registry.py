"""Where queries and their SQL twins are registered, and the tables that they read.

Tickets are ``documents`` (subject: the first 40 characters, body: the text,
language, queue: the source); questions and answers are neighbouring turns of
``conversations``; vectors are ``embeddings``; searches take every id that 20
divides as queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeloom.operators import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"), F.substring("text", 1, 40).alias("subject"), F.col("text").alias("body"), F.col("lang").alias("language"), F.col("source").alias("queue")
    )


TICKETS = "(SELECT doc_id AS idx, substr(text, 1, 40) AS subject, text AS body, lang AS language, source AS queue FROM documents)"
PAIRS = """(SELECT conv_id, turn, question, answer FROM (
    SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"""
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.pair_turns(read(spark, sf, "conversations")).withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn"))
