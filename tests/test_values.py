"""Values as the SQL has them."""

import math

import duckdb
from pyspark.sql import functions as F

from lodeloom.functions import text as T
from lodeloom.functions import vectors as V


def test_small_negative_numbers_round_to_negative_zero(spark):
    got = spark.createDataFrame([(-4e-7,), (4e-7,), (-6e-7,), (0.0,), (None,)], "x double").select(V.round_signed(F.col("x"), 6).alias("y")).collect()
    values = [r["y"] for r in got]
    assert values == [0.0, 0.0, -1e-6, 0.0, None] and [math.copysign(1, v) for v in values[:4]] == [-1, 1, -1, 1]


def test_capitals_are_one_character(spark):
    letters = [c for c in map(chr, range(1, 0x2000)) if len(c.upper()) > 1] + ["a", "ä", "ы", "1", "ﬁ"]
    got = {r["c"]: r["y"] for r in spark.createDataFrame([(c,) for c in letters], "c string").select("c", T.capital(F.col("c")).alias("y")).collect()}
    assert got == {c: duckdb.execute("SELECT upper(?)", [c]).fetchall()[0][0] for c in letters}
    assert spark.createDataFrame([("Hallo ßa b c d",)], "x string").select(T.strip_greeting(F.col("x")).alias("y")).first()["y"] == "ẞa b c d"
