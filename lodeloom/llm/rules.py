"""Host-level quality rules, in DataFrame functions only.

Each text gets its counts in one pass of array functions. Failures of the base
rules are summed by host; the hosts' rates give a beta prior by the method of
moments; each rate is shrunk towards it, and a host whose shrunk rate is too
high takes all its documents down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A host with a larger share of all documents is held against by broadcast: fewer than HOT such hosts can exist.
HOT = 200
#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A host fails where its shrunk failure rate is above this.
HOST_RATE = 0.5


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once for a row, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]`` of a text."""
    parts = F.split(F.translate(text, SPACE, " " * len(SPACE)), " ")
    return F.filter(parts, lambda x: x != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows (64-bit hashes) are sorted with their places, so equal ones are neighbours; the
    places of repeated windows then cover up to three words each. The cost is
    that of a sort, whatever the length of the text.
    """

    def count(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(
            F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i")),
        )
        return _let(F.sort_array(windows), repeated)

    def repeated(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
        places = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return _let(F.sort_array(F.transform(places, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) >= 3, _let(words, count)).otherwise(F.lit(0).cast("long"))


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and the counts of each text; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    found = docs.select("doc_id", "source", text.alias("text")).select(
        "doc_id",
        "source",
        _let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    return found.select(
        "doc_id", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words")
    ).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_verdicts(counted: DataFrame) -> DataFrame:
    """``source, n, failed, rate, host_failed``: each host's shrunk failure rate.

    The beta prior has the mean of all documents and the strength that the
    spread of the hosts' rates tells (between 1 and 1000 documents).
    """
    hosts = counted.filter("source is not null").groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    rate = F.col("failed") / F.col("n")
    spread = hosts.agg(
        (F.sum("failed") / F.sum("n")).alias("mean"),
        F.sum("n").alias("docs"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("var"),
        F.coalesce(F.avg(1 / F.col("n")), F.lit(1.0)).alias("noise"),
    )
    m = F.col("mean")
    own = F.greatest(F.col("var") - m * (1 - m) * F.col("noise"), F.lit(1e-9))  # beyond what chance gives
    strength = F.least(F.greatest(m * (1 - m) / own - 1, F.lit(1.0)), F.lit(1000.0))
    prior = spread.select("docs", (m * strength).alias("alpha"), ((1 - m) * strength).alias("beta"))
    shrunk = (F.col("failed") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta"))
    return hosts.join(F.broadcast(prior)).select("source", "n", "failed", "docs", shrunk.alias("rate"), (shrunk > HOST_RATE).alias("host_failed"))


def host_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each row of ``docs(doc_id, text, source)``.

    base_failed: under 50 words, or over half of them in repeated 3-word
    windows. kept: not base_failed, and the host's shrunk failure rate is at
    most HOST_RATE. A null or wordless text fails; a null source has no host,
    so its documents stand on their own. Repeated rows count as rows. Other
    columns are ignored. Empty table: no rows.
    """
    scratch = Scratch(spark, "rules")
    counted = scratch.keep(counts(docs), "counts")
    hosts = scratch.keep(host_verdicts(counted), "hosts")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # A host with more than 1/HOT of the documents would make a hot key; there are fewer than HOT of them.
    large = F.col("n") * HOT > F.col("docs")
    verdict = ["source", "host_failed"]
    marked = counted.join(F.broadcast(hosts.filter(large).select("source", F.col("host_failed").alias("large_failed"))), "source", "left")
    known = marked.filter("large_failed is not null or source is null").select(*columns, F.col("large_failed").alias("host_failed"))
    rest = marked.filter("large_failed is null and source is not null").join(hosts.filter(~large).select(*verdict), "source", "left")
    out = known.unionByName(rest.select(*columns, "host_failed"))
    return out.select(*columns, (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"))
