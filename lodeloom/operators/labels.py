"""Labels from a judge model, and the examples from which a smaller model learns them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.functions import prompts as P
from lodeloom.functions import text as T
from lodeloom.functions.wording import FIELD_NAMES

from .sampling import shuffle_split
from .tables import pending

#: What is written for each judged ticket.
SILVER = ["idx", "language", "subject", "body", *FIELD_NAMES, "raw"]


def silver_labels(rows: DataFrame, instruction: str, generate: Callable[[DataFrame], DataFrame], done: DataFrame | None = None) -> DataFrame:
    """The columns of SILVER for ``rows(idx, language, subject, body)``: what a judge replies to the instruction and the ticket.

    ``generate`` adds ``generated_answer`` to rows with a prompt. Texts of
    fields that are missing are empty, labels outside the vocabulary are
    snapped to it or take the default. Rows whose idx is in ``done`` are left out.
    """
    rows = rows if done is None else pending(rows, done, "idx")
    asked = rows.withColumn("prompt", P.judge(instruction, F.col("subject"), F.col("body"), F.col("language")))
    raw = F.col("generated_answer")
    texts = {name: F.coalesce(T.json_field(raw, name), F.lit("")) for name in FIELD_NAMES[:3]}
    out = generate(asked).withColumns(texts).withColumn("_labels", T.label_reply(raw))
    return out.select("idx", "language", "subject", "body", *FIELD_NAMES[:3], "_labels.intent", "_labels.ticket_type_nli", raw.alias("raw"))


def learning_examples(silver: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """``idx, prompt, target, is_val`` of judged tickets that have a problem statement; a share is held out."""
    sound = silver.filter(F.trim("prob_statement") != "")
    record = F.create_map(*(x for name in FIELD_NAMES for x in (F.lit(name), F.col(name))))
    rows = sound.select("idx", P.five_fields(F.col("subject"), F.col("body"), F.col("language")).alias("prompt"), P.five_fields_target(record).alias("target"))
    return shuffle_split(rows, "idx", share, seed)


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, filled, total, share`` of rows in which a field is neither null, blank nor none."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields)))
    filled = F.count_if(F.coalesce(~F.lower(F.trim("x.v")).isin("", "none", "nan"), F.lit(False)))
    out = df.select(cells.alias("x")).groupBy("x.field").agg(filled.alias("filled"), F.count("*").alias("total"))
    return out.select("field", "filled", "total", F.round(F.col("filled") / F.col("total"), 4).alias("share"))


def allowed(settings: dict, names: set[str]) -> dict:
    """The settings that a trainer knows: others are left out, so one configuration serves several versions."""
    return {k: v for k, v in settings.items() if k in names}
