"""Repeated passages by a sparse suffix array of minimisers.

Of each LEAST - GRAM + 1 successive runs of GRAM words the one with the
smallest hash is a minimiser. Every window of LEAST words has one, at the same
place in all its copies, and the windows of one minimiser follow each other:
together they are its span. Only suffixes that begin at minimisers are kept.

Spans are grouped by their whole content first, which settles all copies but
the first of each group. The suffixes of the first ones whose minimiser's words
stand in several groups are sorted; neighbours that share these words are
compared and their matches are extended to the right and to the left. Where more
than MOST groups share them, their suffixes stand too far apart in any order for
neighbours to meet: there each window is grouped by its content. All of this is
over the whole corpus and exact: each window finds all its copies and the
earliest of them, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words as w
from .skew import meet
from .store import Scratch, fresh

U64 = np.uint64
LEAST, GRAM = 50, 8
#: Groups of spans with the same minimiser whose suffixes are all compared; of more, each window is grouped.
MOST = 16
#: Windows that one batch holds.
ROWS = 1 << 16
_PLACE = 22  # bits of a place in a slice


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` successive values."""
    n = len(x)
    if n < size:
        return np.zeros(0, x.dtype)
    rows = -(-n // size)
    padded = np.full(rows * size, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(rows, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def minimisers(words: w.Words, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the slice: their first windows, how many windows each has, their minimisers, and the hashes of these' words."""
    n = len(words.h)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    grams = w.shingles(words.h, np.array([0, n]), gram)[0]
    bits = U64(max(_PLACE, int(n).bit_length()))
    keyed = (w.mix(grams) >> bits << bits) | np.arange(len(grams), dtype=U64)  # ties: the first
    lowest = _window_min(keyed, least - gram + 1)
    end = np.repeat(words.at[1:], words.counts)
    at = np.flatnonzero(np.arange(len(lowest)) + least <= end[: len(lowest)])
    place = (lowest[at] & U64((1 << int(bits)) - 1)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), place[first], grams[place[first]]


class Runs:
    """Hashes of any runs of a slice's words, by running sums."""

    def __init__(self, words: w.Words):
        n = len(words.h)
        up, self.down = w._powers(1 << max(20, int(n).bit_length()))
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(words.h * up[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return w.mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(U64))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, w.Words]]:
    data, offsets = w.raw(texts)
    for a, b in w.slices(offsets):
        yield a, b, w.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _choose(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in _slices(batch.column("text")):
                at, sizes, place, grams = minimisers(words, least, gram)
                doc = np.searchsorted(words.at, at, side="right") - 1
                rows = pa.array(a + doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("text_hash").take(rows),
                        pa.array((at - words.at[doc]).astype(np.int32)),
                        pa.array(sizes.astype(np.int32)),
                        pa.array((place - at).astype(np.int32)),
                        pa.array(grams.view(np.int64)),
                        pa.array(Runs(words).hashes(at, sizes + least - 1).view(np.int64)),
                    ],
                    names=["doc_id", "text_hash", "start", "windows", "back", "gram", "span"],
                )

    return run


_OPENED = "doc_id long, text_hash long, start int, window long, gram long, right binary, left binary"


def _open(least: int):
    """Of the spans of each text: a row for each window of those in ``many`` (place << 32 | windows), and the suffix of those in ``few``.

    A suffix has its place, the hashes of its words to the end of the span, and
    of the words before it, backwards, to the beginning of the span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _slices(batch.column("text")):
                some, runs = batch.column("many").slice(a, b - a), Runs(words)
                packed = some.flatten().to_numpy()
                sizes = packed & 0xFFFFFFFF
                doc = np.repeat(np.repeat(np.arange(b - a), np.diff(some.offsets.to_numpy())), sizes)
                place = w._positions(packed >> 32, sizes)
                for lo in range(0, len(doc), ROWS):
                    d, p = doc[lo : lo + ROWS], place[lo : lo + ROWS]
                    yield _opened(batch, a + d, p, window=runs.hashes(words.at[d] + p, least).view(np.int64))
                rows, places, grams, right, left = [], [], [], [], []
                for row, spans in enumerate(batch.column("few").slice(a, b - a).to_pylist()):
                    base = int(words.at[row])
                    for span in spans:
                        start, p, stop = base + span["start"], base + span["start"] + span["back"], base + span["start"] + span["windows"] + least - 1
                        rows.append(a + row)
                        places.append(p - base)
                        grams.append(span["gram"])
                        right.append(words.h[p:stop].tobytes())
                        left.append(words.h[start:p][::-1].tobytes())
                if rows:
                    yield _opened(batch, np.array(rows), np.array(places), gram=grams, right=right, left=left)

    return run


def _opened(batch: pa.RecordBatch, rows: np.ndarray, places: np.ndarray, **columns) -> pa.RecordBatch:
    taken, n = pa.array(rows), len(rows)
    kinds = {"window": pa.int64(), "gram": pa.int64(), "right": pa.binary(), "left": pa.binary()}
    rest = [pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(taken), batch.column("text_hash").take(taken), pa.array(places.astype(np.int32)), *rest], names=["doc_id", "text_hash", "start", *kinds]
    )


def _common(one: np.ndarray, other: np.ndarray) -> int:
    """Words at the beginning that both have."""
    n = min(len(one), len(other))
    apart = np.flatnonzero(one[:n] != other[:n])
    return int(apart[0]) if len(apart) else n


def _compare(least: int):
    """Marks of the matches between neighbours in sorted suffixes of the same words.

    Of two places of a match that with the larger doc_id, then place, is later.
    """

    def matches(group: list[tuple]) -> Iterator[tuple]:
        for i, one in enumerate(group):
            for other in group[i + 1 :]:
                r, back = _common(one[3], other[3]), _common(one[4], other[4])
                if r + back >= least:
                    first = one[:3] < other[:3]
                    for (doc, place, text, *_), later in ((one, not first), (other, first)):
                        yield doc, text, (place - back) << 32 | (back + r) << 1 | later

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, words, out = [], None, []
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "text_hash")]
            sides = [[np.frombuffer(x, U64) for x in batch.column(c).to_pylist()] for c in ("right", "left")]
            for gram, *row in zip(grams, *columns, *sides, strict=True):
                if gram != words:
                    out += matches(group)
                    group, words = [], gram
                group.append(tuple(row))
            if len(out) >= ROWS:
                yield _marked(out)
                out = []
        out += matches(group)
        yield _marked(out)

    return run


def _marked(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "text_hash", "mark"])


def _union(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> pa.Array:
    """For each of ``n`` texts its spans, sorted by start, as one list; touching ones become one."""
    far = doc << 32
    reach = np.maximum.accumulate(far + stop) if len(doc) else far
    new = np.ones(len(doc), dtype=bool)
    new[1:] = far[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(start[first].astype(np.int32)), pa.array((reach[last] - far[last]).astype(np.int32))], names=["start", "stop"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32)), spans)


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of each text's ``marks`` (start << 32 | size << 1 | later, sorted): all, and the later ones."""
    for batch in batches:
        marks, n = batch.column("marks"), batch.num_rows
        packed = marks.flatten().to_numpy()
        doc = np.repeat(np.arange(n), np.diff(marks.offsets.to_numpy()))
        start, later = packed >> 32, (packed & 1) == 1
        stop = start + ((packed & 0xFFFFFFFF) >> 1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                _union(doc, start, stop, n),
                _union(doc[later], start[later], stop[later], n),
            ],
            names=["doc_id", "text_hash", "spans", "later"],
        )


_AT = ["doc_id", "start", "text_hash"]


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each key's number of rows, its earliest place and whether it has another."""
    at = F.struct(*_AT)
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return groups.select(*key, "n", "first", (F.col("first") != F.col("last")).alias("repeated"))


def _marks(met: DataFrame, size: F.Column) -> DataFrame:
    """``doc_id, text_hash, mark``: rows that met their groups, as numbers for ``_join_spans``."""
    later = (F.struct(*_AT) != F.col("first")).cast("long")
    start = F.shiftleft(F.col("start").cast("long"), 32)
    return met.select("doc_id", "text_hash", (start + 2 * size.cast("long") + later).alias("mark"))


def repeated_spans(spark: SparkSession, docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``doc_id, text_hash, spans, later``: for each text with a passage of ``least`` words that occurs elsewhere too.

    spans (array of start and stop, in words) are those passages; later are
    the parts of them of which the corpus holds an earlier occurrence (by
    doc_id, then place), so deleting these keeps one of each. Words are compared
    with A-Z lower-cased. Repeats within a text count. Texts that are null or
    shorter than ``least`` words have no row. Rows with the same doc_id and
    text are one document; a row without a doc_id takes no part.
    """
    scratch = Scratch(spark, "suffixes")
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    chosen = scratch.keep(
        texts.mapInArrow(_choose(least, gram), "doc_id long, text_hash long, start int, windows int, back int, gram long, span long"), "chosen"
    )
    total = chosen.count()
    # Copies of whole spans: each but the first is a later one, with all its windows.
    classes = scratch.keep(_groups(chosen, ["gram", "span"]), "classes")
    whole = meet(chosen, classes.filter("repeated").drop("repeated"), ["gram", "span"], total)
    whole = _marks(whole, F.col("windows") + (least - 1))
    # Different spans may share windows only if their minimisers have the same words.
    shared = scratch.keep(classes.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    spans = meet(classes.select("gram", "first"), shared, ["gram"], classes.count()).select("gram", F.col("n").alias("groups"), "first.*")
    heads = chosen.select(*_AT, "windows", "back").join(spans, _AT)
    few = F.col("groups") <= MOST
    places = heads.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.when(~few, F.shiftleft(F.col("start").cast("long"), 32) + F.col("windows"))).alias("many"),
        F.collect_set(F.when(few, F.struct("start", "windows", "back", "gram"))).alias("few"),
    )
    opened = scratch.keep(
        texts.join(places, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).mapInArrow(_open(least), _OPENED), "opened"
    )
    # No words have more than MOST suffixes here, so a group in one task is small.
    suffixes = opened.filter("gram is not null").select(*_AT, "gram", "right", "left")
    near = suffixes.repartition("gram").sortWithinPartitions("gram", "right", *_AT).mapInArrow(_compare(least), "doc_id long, text_hash long, mark long")
    windows = opened.filter("window is not null").select(*_AT, "window")
    found = scratch.keep(_groups(windows, ["window"]).filter("repeated").drop("repeated"), "found")
    single = _marks(meet(windows, found, ["window"], windows.count()), F.lit(least)).unionByName(near)
    marks = whole.unionByName(single).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("mark")).alias("marks"))
    kind = "array<struct<start:int,stop:int>>"
    spans = scratch.keep(marks.mapInArrow(_join_spans, f"doc_id long, text_hash long, spans {kind}, later {kind}"), "spans")
    scratch.drop("chosen", "classes", "shared", "opened", "found")
    return spans


def _cut(column: str):
    """Texts without the words of their spans in ``column`` and the white space after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column(column).to_pylist(), strict=True):
                if not spans:
                    out.append(text.as_py())
                    continue
                raw = text.as_py().encode()
                words = w.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), hashes=False)
                parts, last = [], 0
                for s in spans:
                    parts.append(raw[last : words.start[s["start"]]])
                    last = words.start[s["stop"]] if s["stop"] < len(words.start) else len(raw)
                out.append(b"".join([*parts, raw[last:]]).decode())
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, "text", pa.array(out, pa.string()))

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``docs`` without the passages of which the corpus holds an earlier occurrence.

    All columns stay, whatever their names; n_chars, if there, counts what is
    left. A document of which nothing but white space is left goes; others, and
    those with a null or empty text or without a doc_id, stay as they are.
    Repeated rows (of one doc_id and text) are one document, so they lose the
    same passages and stay each. An empty table stays empty.
    """
    columns = docs.columns
    key, later = fresh("text_hash", columns), fresh("later", columns)
    spans = repeated_spans(spark, docs, least, gram).select(
        F.col("doc_id").alias("_of"), F.col("text_hash").alias(key), F.col("later").alias(later)
    )
    keyed = docs.withColumn(key, F.xxhash64("text"))
    spans = spans.withColumnRenamed("_of", fresh("of", columns, [key, later]))
    marked = keyed.join(spans, [F.col("doc_id") == F.col(spans.columns[0]), keyed[key] == spans[key]], "left").select(*columns, later)
    schema = StructType([*docs.schema.fields, spans.schema[later]])  # add() would change the frame's own schema
    cut = F.size(later) > 0
    out = marked.mapInArrow(_cut(later), schema).filter(~F.coalesce(cut, F.lit(False)) | (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "")) != ""))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``doc_id, start, n_words, first``: a row for each repeated passage of each document (see ``repeated_spans``).

    first: no word of it occurs earlier in such a passage.
    """
    spans = repeated_spans(spark, docs, least, gram).select("doc_id", F.explode("spans").alias("s"), "later")
    overlap = F.exists("later", lambda x: (x["start"] < F.col("s.stop")) & (x["stop"] > F.col("s.start")))
    return spans.select(
        "doc_id", F.col("s.start").cast("long").alias("start"), (F.col("s.stop") - F.col("s.start")).cast("long").alias("n_words"), (~overlap).alias("first")
    )
