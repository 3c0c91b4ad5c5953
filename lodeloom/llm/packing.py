"""Best-two-fit packing of token pieces into sequences.

Only the number of pieces of each length decides how sequences are filled, and
there are at most ``capacity`` lengths. So the driver packs that histogram: it
builds a pattern (how many pieces of which length), repeats it as often as the
pieces last, and goes on. Pieces are ranked within their length by a
distributed count and look their place up in the table of patterns, whose size
depends on the number of lengths and not of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch
from .tokens import encoder, vocabulary, with_end

#: Pieces that are numbered together in one task.
RANKED_TOGETHER = 50_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, (first if s == 0 and first else capacity)) for s in starts]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            ids, ends = with_end(*own.encode_rows(batch.column("text")))
            flat, last = memoryview(ids).cast("B"), 0
            for doc, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                for k, (start, length) in enumerate(cut(end - last, capacity)):
                    at = last + start
                    rows.append((doc, k, start, length, zlib.crc32(flat[4 * at : 4 * (at + length)])))
                last = end
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def fill(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: pieces}, times) that use up ``counts`` (index: length)."""
    left = counts.astype(np.int64).copy()
    out = []
    while left.any():
        pattern, gap = _greedy(left, capacity)
        gap = _two_fit(pattern, gap, left)
        times = min(int(left[n]) // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
        out.append((pattern, times))
    return out


def _greedy(left: np.ndarray, capacity: int) -> tuple[dict[int, int], int]:
    """The longest piece left, then always the longest that fits."""
    lengths = np.flatnonzero(left)
    pattern, gap, top = {}, capacity, len(lengths)
    while gap and top:
        top = min(top, int(np.searchsorted(lengths, gap, side="right")))
        if not top:
            break
        n = int(lengths[top - 1])
        pattern[n] = min(int(left[n]), gap // n)
        gap -= n * pattern[n]
        top -= 1
    return pattern, gap


def _two_fit(pattern: dict[int, int], gap: int, left: np.ndarray) -> int:
    """While a gap is left: swap the smallest piece for two unpacked ones that fill more of it."""
    while gap and sum(pattern.values()) > 1:
        smallest = min(pattern)
        room = gap + smallest
        free = left[: room + 1].copy()
        for n, k in pattern.items():
            if n <= room:
                free[n] -= k
        lengths = np.flatnonzero(free > 0)
        if not len(lengths):
            break
        at = np.searchsorted(lengths, room - lengths, side="right") - 1
        other = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
        alone = (other == lengths) & (free[lengths] < 2)  # its partner would be itself
        other = np.where(alone, np.where(at >= 1, lengths[np.maximum(at - 1, 0)], 0), other)
        total = np.where(other > 0, lengths + other, 0)
        best = int(np.argmax(total))
        if total[best] <= smallest:
            break
        pattern[smallest] -= 1
        if not pattern[smallest]:
            del pattern[smallest]
        for n in (int(lengths[best]), int(other[best])):
            pattern[n] = pattern.get(n, 0) + 1
        gap = room - int(total[best])
    return gap


def places(patterns: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, times, first sequence, offset) by rank."""
    table: dict[int, list] = {}
    ranked = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            table.setdefault(n, []).append((ranked[n], times, sequence, offset))
            ranked[n] += times * pattern[n]
            offset += n * pattern[n]
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in table.items()}


def _place(table: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rank", "length"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                rows, at = table[int(n)], length == n
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + k % row[:, 1]
                offset[at] = row[:, 3] + n * (k // row[:, 1])
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def best_two_fit(spark: SparkSession, docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: each piece of ``docs(doc_id, text)`` and its place.

    A document is its ids and an end id 0. One of more than ``capacity`` ids is
    cut into full pieces, the remainder first; no other is cut. Sequences have
    no gaps before their end. A null or empty text is the end id alone. Rows
    with the same or a null doc_id are packed each. Other columns are ignored.
    Empty table: no rows.
    """
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(
        docs.select("doc_id", "text").mapInArrow(
            _pieces(path or vocabulary(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
        ),
        "pieces",
    )
    total = pieces.count()
    groups = max(1, -(-total // RANKED_TOGETHER))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = pieces.groupBy("length", "group").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    table = places(fill(counts, capacity), capacity)
    before = sizes.select(
        "length", "group", (F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(before, ["length", "group"])
    return ranked.withColumn("rank", F.col("rank") + F.col("before")).mapInArrow(
        _place(table),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
