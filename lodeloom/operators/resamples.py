"""Bootstrap means of many groups at once, on values that stay in chunks.

Which places a draw takes depends only on the number of values, so groups of one
size share how often each place is drawn. A task has some draws: it counts their
places once and meets every chunk of values, one at a time. No task holds a
group, and what it counts is bounded by CELLS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.session import keep, ship_package

#: Values of a chunk, and (draws x places) that a task counts at once (or one draw).
CHUNK, CELLS = 8192, 20_000_000

# MD5.
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 4294967296).astype(np.uint32)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Texts that are hashed at once.
_AT_ONCE = 8192


def _md5_first(cells: np.ndarray) -> np.ndarray:
    """The first 32 bits, as in the hexadecimal text, of the MD5 of each row of bytes (up to 55)."""
    rows, size = cells.shape
    block = np.zeros((rows, 64), np.uint8)
    block[:, :size], block[:, size] = cells, 0x80
    block[:, 56:60] = np.array([size * 8], "<u4").view(np.uint8)
    words = block.view("<u4")
    # Words that all rows share are added as one number.
    same = [g * 4 > size or (words[:, g] == words[0, g]).all() for g in range(16)]
    m = [words[:1, g].copy() if same[g] else np.ascontiguousarray(words[:, g]) for g in range(16)]
    a, b, c, d = (np.full(rows, x, np.uint32) for x in _START)
    f, t = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for i in range(61):  # the last three do not change the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f); np.bitwise_and(f, b, out=f); np.bitwise_xor(f, d, out=f)  # noqa: E702
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f); np.bitwise_and(f, d, out=f); np.bitwise_xor(f, c, out=f)  # noqa: E702
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f); np.bitwise_xor(f, d, out=f)  # noqa: E702
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f); np.bitwise_or(f, b, out=f); np.bitwise_xor(f, c, out=f)  # noqa: E702
            g = 7 * i % 16
        np.add(f, a, out=f)
        if m[g].size == 1:
            np.add(f, m[g] + _SINES[i : i + 1], out=f)
        else:
            np.add(f, m[g], out=f)
            np.add(f, _SINES[i], out=f)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)  # the old a is not needed any more
        a, b, c, d = d, a, b, c
    return (b + _START[0]).byteswap()


def draw_words(seed: int, draw: int, n: int) -> np.ndarray:
    """The first 32 bits of md5('seed:draw:slot') for slots 0 to n - 1."""
    out, head = np.empty(n, np.uint32), np.frombuffer(f"{seed}:{draw}:".encode(), np.uint8)
    low, digits = 0, 1
    while low < n:
        high = min(n, 10**digits)
        for lo in range(low, high, _AT_ONCE):
            slots = np.arange(lo, min(high, lo + _AT_ONCE))
            cells = np.empty((len(slots), len(head) + digits), np.uint8)
            cells[:, : len(head)] = head
            for k in range(digits):
                cells[:, len(head) + k] = slots // 10 ** (digits - 1 - k) % 10 + 48
            out[lo : lo + len(slots)] = _md5_first(cells)
        low, digits = high, digits + 1
    return out


def _mean_of_draws(groups: list[str], columns: list[str], most: int, each: int, resamples: int, seed: int):
    """Chunks, each with the number of a block of ``each`` draws, become sums of every group and draw of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, held, counts, sums = None, None, None, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    if block is not None:
                        raise ValueError("a task has one block of draws")
                    block = row["block"]
                    draws = range(block * each, min(resamples, (block + 1) * each))
                    words = np.stack([draw_words(seed, k, most) for k in draws])
                if row["n"] != held:
                    held = row["n"]
                    counts = np.empty((len(words), held), np.uint32)
                    for k, own in enumerate(words):
                        counts[k] = np.bincount(own[:held] % np.uint32(held), minlength=held)
                values = np.array([row[c] for c in columns], np.float64)
                at = row["chunk"] * CHUNK
                part = counts[:, at : at + values.shape[1]].astype(np.float64) @ values.T
                key = (*(row[g] for g in groups), held)
                sums[key] = sums[key] + part if key in sums else part
        for key, total in sums.items():
            size = len(total)
            cells = [pa.array([x] * size) for x in key[:-1]] + [pa.array(np.arange(size) + block * each)]
            cells += [pa.array(total[:, k] / key[-1]) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(cells, names=[*groups, "draw", *columns])

    return run


class Resamples:
    """Values of groups, written once under the shared folder, and the means of their draws.

    ``values(groups (texts), n, pos, columns (doubles))``: n values of a group at
    places 0 to n - 1.
    """

    def __init__(self, values: DataFrame, groups: list[str], columns: list[str]):
        self.spark, self.groups, self.columns = values.sparkSession, groups, columns
        rows = F.array_sort(F.collect_list(F.struct("pos", *columns)))
        chunks = values.withColumn("chunk", F.floor(F.col("pos") / CHUNK).cast("long")).groupBy("n", *groups, "chunk").agg(rows.alias("x"))
        chunks = chunks.select("n", "chunk", *groups, *(F.col("x")[c].alias(c) for c in columns))
        # In the order of n, so that a task counts the places of each n about once.
        self.chunks = keep(chunks.orderBy("n", *groups, "chunk"), "resamples")

    def totals(self) -> DataFrame:
        """``groups, n, columns``: the sum of each column."""
        total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, v: s + v))
        return self.chunks.groupBy(*self.groups, "n").agg(*(total(c).alias(c) for c in self.columns))

    def means(self, resamples: int, seed: int = 42) -> DataFrame:
        """``groups, draw, columns``: the mean of each column over the places of each draw."""
        ship_package(self.spark)
        schema = ", ".join([f"{g} string" for g in self.groups] + ["draw long"] + [f"{c} double" for c in self.columns])
        most = self.chunks.agg(F.max("n")).first()[0]
        if not most or not resamples:
            return self.spark.createDataFrame([], schema)
        each = max(1, min(-(-resamples // (4 * self.spark.sparkContext.defaultParallelism)), CELLS // most))
        blocks = self.spark.range(0, -(-resamples // each), 1, -(-resamples // each)).withColumnRenamed("id", "block")
        # Every block meets every chunk: a task for each block reads the chunks as they are stored, and nothing is shuffled.
        met = blocks.hint("shuffle_replicate_nl").crossJoin(self.chunks.coalesce(1))
        return met.mapInArrow(_mean_of_draws(self.groups, self.columns, most, each, resamples, seed), schema)
