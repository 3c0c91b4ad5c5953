"""Benchmark decontamination by SimHash of item-sized windows and exact verification.

A fingerprint is the signs of BITS sums over a text's word shingles. Windows of
as many words as an item get one wherever enough of their shingles are ones of
items of that length (a window with fewer cannot be similar enough, so none that
counts is passed over). Fingerprints are cut into blocks: of two that differ in
at most RADIUS bits some block differs in at most BALL bits, so an index of the
values around each item's blocks finds every such pair. What it finds is decided
by the exact similarity of the multisets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w
from .store import Scratch, fresh, prepare

U64 = np.uint64
#: At a similarity of 0.8 two fingerprints differ in 39 bits on average (deviation 6): the radius is four deviations more.
BITS, BLOCKS, RADIUS = 256, 16, 63
_PART = BITS // BLOCKS
BALL = RADIUS // BLOCKS
#: Bits in which the index holds values around an item's block; the rest of the ball is looked up around a window's.
HELD = 2
#: Items that go to the executors at once; a larger benchmark is searched in several passes.
ITEMS_AT_ONCE = 4000
#: Bits of a shingle by which most that no item has are told.
SIEVE = 20
#: Shingles whose signs are summed, and windows that are looked up, at once.
SHINGLES_AT_ONCE, WINDOWS_AT_ONCE = 1 << 15, 1 << 11
#: A text of fewer words than an item, but this share in percent at least, is compared as a whole.
WHOLE = 75


def _masks(most: int) -> np.ndarray:
    """All values of a block with at most ``most`` bits set."""
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(_PART), k)], dtype=np.uint16)


_HELD, _ASKED = _masks(HELD), _masks(BALL - HELD)


def _multiset(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def weighted_similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least counts over sum of largest counts."""
    _, a, b = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    least = np.minimum(one[1][a], other[1][b]).sum()
    return float(least / (one[1].sum() + other[1].sum() - least))


def fingerprints(run: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """[window, word]: the SimHash of ``width`` successive shingles from each start (sorted), as 64-bit words."""
    out = np.empty((len(starts), BITS // 64), dtype=U64)
    step = max(1, SHINGLES_AT_ONCE // width)
    for lo in range(0, len(starts), step):
        some = starts[lo : lo + step]
        places = np.unique((some[:, None] + np.arange(width)).ravel())
        first = np.searchsorted(places, some)
        for k in range(BITS // 64):
            bits = np.unpackbits(w.mix(run[places] + U64(2 * k + 1)).view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.zeros((len(places) + 1, 64), dtype=np.int32)
            np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
            ones = 2 * (sums[first + width] - sums[first]) > width
            out[lo : lo + step, k] = np.packbits(ones, axis=1).view(U64).ravel()
    return out


def _words(texts: pa.Array) -> Iterator[tuple[int, int, w.Words]]:
    data, offsets = w.raw(texts)
    for a, b in w.slices(offsets):
        yield a, b, w.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], strip=True)


@dataclass
class Item:
    """A benchmark item: its id, words and shingles, in order and as a multiset."""

    id: int
    n: int
    run: np.ndarray
    shingles: tuple[np.ndarray, np.ndarray]


def read_items(items: list[tuple[int, str]], shingle: int) -> list[Item]:
    """Items with words; wordless ones match nothing."""
    out = []
    for a, _, words in _words(pa.array([t for _, t in items], pa.string())):
        runs, at = w.shingles(words.h, words.at, shingle)
        for k, n in enumerate(words.counts.tolist()):
            if n:
                run = runs[at[k] : at[k + 1]]
                out.append(Item(items[a + k][0], n, run, _multiset(run)))
    return out


class Group:
    """Items of one length, their fingerprints and, made when first asked, the index of their blocks."""

    def __init__(self, n: int, items: list[Item]):
        self.n, self.items, self.width = n, items, len(items[0].run)
        self.prints = np.concatenate([fingerprints(i.run, np.zeros(1, np.int64), self.width) for i in items])
        self.index = None

    def _index(self) -> tuple[np.ndarray, np.ndarray]:
        """(block << 16 | value) in order, and the item that has a block within HELD bits of that value."""
        if self.index is None:
            blocks = self.prints.view("<u2").reshape(-1, BLOCKS)
            keys = (blocks[:, :, None] ^ _HELD).astype(np.int64) + (np.arange(BLOCKS, dtype=np.int64) << _PART)[None, :, None]
            owners = np.repeat(np.arange(len(self.items), dtype=np.int32), BLOCKS * len(_HELD))
            order = np.argsort(keys.ravel(), kind="stable")
            self.index = keys.ravel()[order], owners[order]
        return self.index

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, bits) of all fingerprints within RADIUS."""
        keys, owners = self._index()
        found = []
        for lo in range(0, len(prints), WINDOWS_AT_ONCE):
            blocks = prints[lo : lo + WINDOWS_AT_ONCE].view("<u2").reshape(-1, BLOCKS)
            asked = (blocks[:, :, None] ^ _ASKED).astype(np.int64) + (np.arange(BLOCKS, dtype=np.int64) << _PART)[None, :, None]
            asked = asked.ravel()
            first = np.searchsorted(keys, asked, side="left")
            counts = np.searchsorted(keys, asked, side="right") - first
            windows = np.repeat(np.repeat(np.arange(len(blocks)) + lo, BLOCKS * len(_ASKED)), counts)
            found.append(np.unique(windows * len(self.items) + owners[w._positions(first, counts)]))
        pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
        windows, items = pairs // len(self.items), pairs % len(self.items)
        bits = np.bitwise_count(prints[windows] ^ self.prints[items]).sum(axis=1)
        close = bits <= RADIUS
        return windows[close], items[close], bits[close]


class Search:
    """Finds items in the words of texts."""

    def __init__(self, items: list[Item], shingle: int, percent: int):
        self.shingle, self.percent = shingle, percent
        lengths: dict[int, list[Item]] = {}
        for item in items:
            lengths.setdefault(item.n, []).append(item)
        self.groups = [Group(n, lengths[n]) for n in sorted(lengths)]
        keys = sorted({(h, g) for g, group in enumerate(self.groups) for item in group.items for h in item.shingles[0].tolist()})
        #: Every shingle of an item and the group that has it.
        self.keys = np.array([h for h, _ in keys], dtype=U64)
        self.owners = np.array([g for _, g in keys], dtype=np.int64)
        self.sieve = None

    def _hits(self, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(groups, places), sorted, of the hashes that are shingles of items."""
        if self.sieve is None:
            self.sieve = np.zeros(1 << SIEVE, dtype=bool)
            self.sieve[self.keys >> U64(64 - SIEVE)] = True
        some = np.flatnonzero(self.sieve[hashes >> U64(64 - SIEVE)])
        hashes, places = hashes[some], places[some]
        first = np.searchsorted(self.keys, hashes, side="left")
        counts = np.searchsorted(self.keys, hashes, side="right") - first
        groups, places = self.owners[w._positions(first, counts)], np.repeat(places, counts)
        order = np.lexsort((places, groups))
        return groups[order], places[order]

    def _least(self, one: int, other: np.ndarray | int) -> np.ndarray | int:
        """Shingles that multisets of these sizes share at least if they are similar enough."""
        return -(-self.percent * (one + other) // (100 + self.percent))

    def _starts(self, at: np.ndarray, words: w.Words, group: Group, need: int) -> np.ndarray:
        """Windows of the group's size, within one text, that hold ``need`` of the places ``at``."""
        if need < 1 or len(at) < need:
            return np.zeros(0, np.int64)
        first, last = at[: len(at) - need + 1], at[need - 1 :]
        doc = np.searchsorted(words.at, first, side="right") - 1
        low = np.maximum(last - group.width + 1, words.at[doc])
        high = np.minimum(first, words.at[doc + 1] - group.n)
        fits = (low <= high) & (last < words.at[doc + 1])
        return np.unique(w._positions(low[fits], (high - low + 1)[fits]))

    def find(self, words: w.Words) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words): the best window of each item found in each text, the first of equals."""
        if not len(words.h) or not self.groups:
            return
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        end_of = np.repeat(words.at[1:], words.counts)
        if len(words.h) >= self.shingle:
            run = w.shingles(words.h, np.array([0, len(words.h)]), self.shingle)[0]
            places = np.flatnonzero(np.arange(len(run)) + self.shingle <= end_of[: len(run)])
            groups, at = self._hits(run[places], places)
            bounds = np.searchsorted(groups, np.arange(len(self.groups) + 1))
            for g in np.unique(groups).tolist():
                group, own = self.groups[g], at[bounds[g] : bounds[g + 1]]
                if group.n >= self.shingle:
                    starts = self._starts(own, words, group, self._least(group.width, group.width))
                    self._compare(best, words, run, group, starts, group.width)
                    self._compare_whole(best, words, run, group, own)
        for g, group in enumerate(self.groups):
            if group.n < self.shingle:  # such an item is one shingle: runs of its length are looked up
                places = np.flatnonzero(np.arange(len(words.h)) + group.n <= end_of)
                begins = words.h[w._positions(places, np.full(len(places), group.n))]
                run = w.shingles(begins, np.arange(len(places) + 1) * group.n, self.shingle)[0]
                groups, at = self._hits(run, np.arange(len(run)))
                same = at[groups == g]
                self._compare(best, words, run[same], group, np.arange(len(same)), 1, places[same])
        for (doc, item), (s, start, size) in best.items():
            yield doc, item, s, -start, size

    def _compare_whole(self, best: dict, words: w.Words, run: np.ndarray, group: Group, at: np.ndarray) -> None:
        """Texts shorter than the group's items, as they are."""
        doc, hits = np.unique(np.searchsorted(words.at, at, side="right") - 1, return_counts=True)
        sizes = words.counts[doc]
        width = sizes - self.shingle + 1
        short = (sizes < group.n) & (100 * sizes >= WHOLE * group.n) & (hits >= self._least(group.width, width))
        for size in np.unique(sizes[short]).tolist():
            starts = words.at[doc[short & (sizes == size)]]
            self._compare(best, words, run, group, starts, size - self.shingle + 1)

    def _compare(self, best: dict, words: w.Words, run: np.ndarray, group: Group, starts: np.ndarray, width: int, places: np.ndarray | None = None) -> None:
        """Windows of ``width`` shingles from the starts in ``run`` (at those words, or at ``places``) against the group's items."""
        if not len(starts):
            return
        window, item, bits = group.near(fingerprints(run, starts, width))
        at = starts if places is None else places
        doc = np.searchsorted(words.at, at[window], side="right") - 1
        size = min(group.n, width + self.shingle - 1)
        for k in np.lexsort((window, bits, item, doc)).tolist():  # the nearest first: an exact copy spares the others
            own, d = group.items[item[k]], int(doc[k])
            key = (d, own.id)
            if key in best and best[key][0] == 1.0:
                continue
            p = int(starts[window[k]])
            s = weighted_similarity(own.shingles, _multiset(run[p : p + width]))
            if 100 * s >= self.percent - 1e-9:
                best[key] = max(best.get(key, (0.0, 0, 0)), (s, int(words.at[d] - at[window[k]]), size))


def _search(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for a, _, words in _words(batch.column("text")):
                rows += [(ids[a + doc], item, s, start, size) for doc, item, s, start, size in search.find(words)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "start", "n_words"]
            )

    return run


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, similarity, start, n_words``: benchmark items found in documents, the best place of each.

    Words are lower-cased and lose ASCII punctuation. An item is found where a
    window of as many words (or a whole text of three quarters of them) has a
    weighted similarity of its ``shingle``-word shingles of at least
    ``percent``; an item of fewer words is one shingle. Of equal places the
    first counts. A similar window is missed only if its fingerprint is more
    than RADIUS bits away, with a probability of about 1e-5 at 0.8. Null or
    wordless items and texts, and items without an id, match nothing; empty
    tables give no rows. Rows are searched each, so a repeated row is found
    again; items with one id count as one, by their best place. Other columns
    are ignored. The benchmark is searched ITEMS_AT_ONCE items at a time; where
    it has more, each pass is written before the next, so what is held and sent
    has a bound.
    """
    prepare(spark)
    texts = docs.select("doc_id", F.lower("text").alias("text"))
    schema = "doc_id long, item_id long, similarity double, start long, n_words long"
    passes = _passes(benchmark)
    scratch = Scratch(spark, "decontaminate") if passes > 1 else None
    out = None
    for k, search in enumerate(_searches(benchmark, passes, shingle, percent)):
        part = texts.mapInArrow(_search(search), schema)
        part = scratch.keep(part, f"pass{k}") if scratch else part
        out = part if out is None else out.unionByName(part)
    if passes == 1:
        return out
    best = F.max_by(F.struct("similarity", "start", "n_words"), F.struct("similarity", -F.col("start")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.filter("item_id is not null and text is not null").select("item_id", F.lower("text").alias("text")).distinct()


def _passes(benchmark: DataFrame) -> int:
    return max(1, -(-_items(benchmark).count() // ITEMS_AT_ONCE))


def _searches(benchmark: DataFrame, passes: int, shingle: int, percent: int) -> Iterator[Search]:
    """Searches for ITEMS_AT_ONCE items each (about: they are dealt by a hash of their id)."""
    for k in range(passes):
        some = _items(benchmark).filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()
        yield Search(read_items(sorted((r["item_id"], r["text"]) for r in some), shingle), shingle, percent)


def _without(search: Search, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for a, _, words in _words(batch.column(column)):
                for doc, *_ in search.find(words):
                    clean[a + doc] = False
            yield batch.filter(pa.array(clean))

    return run


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item is found, all columns as they are (see ``contaminated``).

    Rows with a null or empty text, and all rows where the benchmark is empty,
    stay; repeated rows stay or go each; an empty table stays empty. Columns may
    have any names.
    """
    prepare(spark)
    lower = fresh("lower", docs.columns)
    out = docs.withColumn(lower, F.lower("text"))
    for search in _searches(benchmark, _passes(benchmark), shingle, percent):
        out = out.mapInArrow(_without(search, lower), out.schema)
    return out.select(*docs.columns)
