"""Joins of rows to their groups that no frequent key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with a larger share of all rows than 1/HOT is hot; there are fewer than HOT of them.
HOT = 200


def meet(rows: DataFrame, groups: DataFrame, key: list[str], total: int, count: str = "n") -> DataFrame:
    """``rows`` (``total`` of them, of which ``groups`` counts some by key) joined to their groups.

    Groups of hot keys are broadcast, as fewer than HOT rows, so their rows stay
    where they are; all others are joined by key.
    """
    hot = F.broadcast(groups.filter(F.col(count) * HOT > total))
    rest = rows.join(hot.select(*key), key, "left_anti").join(groups.filter(F.col(count) * HOT <= total), key)
    return rows.join(hot, key).unionByName(rest)
