"""Near-duplicates: universal-hash minima, bands, verification, components.

1. Each text becomes its set of k-word shingles (64-bit hashes), a 128-bit
   fingerprint of the whole set and ``BANDS`` band keys of ``ROWS`` minima.
2. Texts with the same set form a class; only the class's smallest id goes on.
3. Every member of a band's bucket is compared with the bucket's smallest id:
   first the signatures, then the full sets. The links give components.
4. Where a bucket still holds several components, its members outside the
   bucket's main component are compared with all its members, in blocks of
   bounded size, on full sets. So no pair that shares a bucket stays open,
   and only pairs between unlinked components cost anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w
from .components import components
from .skew import meet
from .store import Scratch

U64 = np.uint64
#: A pair at similarity 0.8 shares no bucket with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: Minima that are held against each other before the sets (one byte of each).
SLACK = 0.2
#: Texts, and shingles, in a block of a bucket.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21


def _minima(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Minima of each group under n functions a*x mod 2**64, a odd, of already mixed x."""
    odd = w._seeded(n, 99) | U64(1)
    out = np.empty((n, len(at) - 1), dtype=U64)
    for j in range(n):
        out[j] = w.group_min(values * odd[j], at)
    return out


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = w.raw(texts)
    for lo, hi in w.slices(offsets):
        words = w.Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, *w.distinct(*w.shingles(words.h, words.at, k))


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = w._seeded(ROWS, 5) | U64(1)
        for batch in batches:
            for lo, hi, values, at in _sets(batch.column("text"), k):
                minima = _minima(values, at, BANDS * ROWS)
                keys = np.empty((hi - lo, BANDS), dtype=U64)
                for b in range(BANDS):
                    keys[:, b] = w.mix((minima[b * ROWS : (b + 1) * ROWS] * weight[:, None]).sum(axis=0, dtype=U64) + U64(b))
                sizes = np.diff(at)
                keys = keys[sizes > 0].reshape(-1).view(np.int64)
                ends = np.concatenate(([0], np.cumsum((sizes > 0) * BANDS))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(w.group_sum(w.mix(values), at).view(np.int64)),
                        pa.array(w.group_sum(w.mix(values ^ U64(0x5BD1E995)), at).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, at in _sets(batch.column("text"), k):
                signature = (_minima(values, at, BANDS * ROWS) >> U64(56)).astype(np.uint8).T
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array([row.tobytes() for row in np.ascontiguousarray(signature)], pa.binary()),
                        pa.array([values[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()),
                    ],
                    names=["node", "signature", "set"],
                )

    return run


def _alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(other) - both)


def _estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal signature bytes (1 in 256 is equal by chance)."""
    return (equal - 1 / 256) / (1 - 1 / 256)


def _confirm(percent: int):
    """Links among pairs: signatures first, then the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in ("s1", "s2", "v1", "v2")}
            keep = []
            for i in range(batch.num_rows):
                s1, s2 = (np.frombuffer(cols[c][i].as_buffer(), np.uint8) for c in ("s1", "s2"))
                if _estimate((s1 == s2).mean()) >= percent / 100 - SLACK:
                    v1, v2 = (np.frombuffer(cols[c][i].as_buffer(), U64) for c in ("v1", "v2"))
                    if _alike(v1, v2, percent):
                        keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _compare_block(percent: int):
    """In one block of a bucket: a link from each probe to each other component that it touches."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        probes, members = pdf[pdf.probe].reset_index(drop=True), pdf[~pdf.probe].reset_index(drop=True)
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if probes.empty or members.empty:
            return empty
        sets = [np.frombuffer(x, U64) for x in members["set"]]
        sizes = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        signs = np.array([np.frombuffer(x, np.uint8) for x in members["signature"]])
        comps, nodes = members["component"].to_numpy(), members["node"].to_numpy()
        out = []
        for node, comp, sign, own in zip(probes["node"], probes["component"], probes["signature"], probes["set"], strict=True):
            likely = _estimate((signs == np.frombuffer(sign, np.uint8)).mean(axis=1)) >= percent / 100 - SLACK
            likely &= comps != comp
            if not likely.any():
                continue
            mine = np.frombuffer(own, U64)
            lo, hi = np.searchsorted(flat, mine), np.searchsorted(flat, mine, side="right")
            both = np.bincount(owner[w._positions(lo, hi - lo)], minlength=len(sets))
            hit = likely & (100 * both >= percent * (sizes + len(mine) - both))
            if hit.any():
                _, first = np.unique(comps[hit], return_index=True)
                out += [(node, x) for x in nodes[hit][first]]
        return pd.DataFrame(out, columns=["a", "b"]) if out else empty

    return run


def minhash_dedup(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Two texts are linked if 100 * intersection >= percent * union of their sets
    of ``shingle``-word runs (A-Z lower-cased; a shorter text is one run).
    component_id is the smallest doc_id reachable; kept marks it. A null or
    wordless text has n_shingles 0 and stands alone. A null doc_id is linked
    with nothing: component_id null, kept. Repeated rows keep their row each.
    Other columns are ignored. Empty table: no rows.
    """
    scratch = Scratch(spark, "minhash")
    docs = docs.select("doc_id", "text")
    features = scratch.keep(
        docs.mapInArrow(_features(shingle), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "features"
    )
    linked = features.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(linked.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")

    reps = linked.join(classes, [linked.doc_id == classes.node, *(linked[c] == classes[c] for c in ("f1", "f2"))], "left_semi")
    banded = reps.select(F.col("doc_id").alias("node"), "n_shingles", F.explode("bands").alias("bucket")).distinct()
    # A bucket of one is dropped on 24-byte partial sums, before any text is read.
    centres = (
        banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last").drop("last")
    )
    buckets = scratch.keep(banded.join(centres, "bucket"), "buckets")

    involved = buckets.select(F.col("node").alias("doc_id")).distinct()
    sets = scratch.keep(
        docs.join(involved, "doc_id", "left_semi")
        .mapInArrow(_full_sets(shingle), "node long, signature binary, set binary")
        .join(buckets.groupBy("node").agg(F.first("n_shingles").alias("n")), "node")
        .filter(F.length("set") == 8 * F.col("n"))
        .drop("n"),
        "sets",
    )
    pairs = buckets.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    side = lambda end, n: sets.select(F.col("node").alias(end), F.col("signature").alias(f"s{n}"), F.col("set").alias(f"v{n}"))
    first = scratch.keep(
        pairs.join(side("a", 1), "a").join(side("b", 2), "b").mapInArrow(_confirm(percent), "a long, b long").distinct(), "first"
    )
    after = components(first, scratch, "cc_a")

    second = scratch.keep(_rest(buckets.filter("node <> centre"), after, sets, percent), "second")
    parts = components(first.unionByName(second), scratch, "cc_b")
    scratch.drop("buckets", "sets")

    named = classes.join(parts, "node", "left").select(
        "f1", "f2", "n_shingles", "copies", F.coalesce("component", "node").alias("component_id")
    )
    columns = ["doc_id", "n_shingles", "component_id"]
    whole = features.select("doc_id", "n_shingles", "f1", "f2")
    own = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = meet(whole.filter(~own), named, ["f1", "f2", "n_shingles"], features.count(), "copies").select(*columns)
    out = out.unionByName(whole.filter(own).withColumn("component_id", F.col("doc_id")).select(*columns))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def _rest(buckets: DataFrame, after: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in a bucket and that its centre does not join."""
    rows = buckets.join(after, "node", "left").select(
        "bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    groups = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    open_ = (
        groups.groupBy("bucket")
        .agg(
            F.max(F.struct("n", "component"))["component"].alias("main"),
            F.sum("n").alias("n"),
            F.sum("size").alias("size"),
            F.max("n").alias("most"),
            F.max(F.struct("n", "size"))["size"].alias("most_size"),
            F.count("*").alias("parts"),
        )
        .filter("parts > 1")
        .select(
            "bucket",
            "main",
            F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
            F.greatest(F.ceil((F.col("n") - F.col("most")) / BLOCK), F.ceil((F.col("size") - F.col("most_size")) / BLOCK_SHINGLES))
            .cast("int")
            .alias("probe_blocks"),
        )
    )
    rows = rows.join(open_, "bucket").join(sets, "node")
    block = F.pmod(F.hash("node"), F.col("blocks"))
    probe_block = F.pmod(F.hash(F.col("node"), F.lit(1)), F.greatest("probe_blocks", F.lit(1)))
    columns = ["bucket", "node", "component", "signature", "set"]
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.col(c), F.lit(1)) - 1))
    members = rows.select(*columns, F.lit(False).alias("probe"), block.alias("block"), upto("probe_blocks").alias("part"))
    probes = rows.filter("component <> main").select(
        *columns, F.lit(True).alias("probe"), upto("blocks").alias("block"), probe_block.alias("part")
    )
    return members.unionByName(probes).groupBy("bucket", "block", "part").applyInPandas(_compare_block(percent), "a long, b long").distinct()


def keep_one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that ``minhash_dedup`` keeps, all columns as they are.

    Of rows with the same doc_id one stays; rows without a doc_id stay all.
    """
    kept = minhash_dedup(spark, docs, shingle, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
