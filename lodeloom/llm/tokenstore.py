"""Content-addressed store of token ids.

A rolling hash over ids cuts each document's stream into chunks where the
content says so; equal content gives equal chunks. ``chunks`` holds every
different chunk once under its digest; ``recipes`` holds for each document, in
ascending doc_id order, its place, the digests of its chunks and the digest of
these, its node; ``manifest`` holds for each recipe file its documents, its ids
and the Merkle root over its documents' nodes in order; ``head`` signs the
files. Reading builds all of these trees again from the recipes and the chunks
and raises where one differs, so no recipe or chunk can be lost, added, moved or
altered.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch
from .tokens import encoder, vocabulary, with_end

U64 = np.uint64
#: Ids under the rolling hash; mean, least and most ids of a chunk.
WINDOW, MEAN, LEAST, MOST = 8, 256, 32, 2048
#: Ids below this take two bytes.
NARROW = 1 << 16
#: Digests of chunks that a task has sent already (so that it need not send them again).
SENT = 200_000
MANIFEST = "part int, n_docs long, n_ids long, root binary"
RECIPE = "doc_id long, n_tokens long, n_chunks int, root binary, digests array<binary>, ends array<long>"


def digest(x: bytes) -> bytes:
    return blake2b(x, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        up = [digest(b"\1" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0]


class Tree:
    """The root of ``merkle`` over leaves that come one by one; holds a node for each level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        node, k = digest(b"\0" + leaf), 0
        while k < len(self.levels) and self.levels[k] is not None:
            node, self.levels[k] = digest(b"\1" + self.levels[k] + node), None
            k += 1
        self.levels[k : k + 1] = [node]

    def root(self) -> bytes:
        up = None
        for node in self.levels:
            if node is not None:
                up = node if up is None else digest(b"\1" + node + up)
        return digest(b"") if up is None else up


def document_root(names: list[bytes], ends: list[int]) -> bytes:
    """A document's node: over the digests and ends of its chunks."""
    return digest(b"\2" + b"".join(names) + struct.pack(f"<{len(ends)}q", *ends))


def _leaf(doc_id: int | None, n_tokens: int, root: bytes) -> bytes:
    return struct.pack("<?qq", doc_id is None, doc_id or 0, n_tokens) + root


def candidates(ids: np.ndarray) -> np.ndarray:
    """Ends that the rolling hash proposes. Only the last WINDOW ids count, so streams may stand one after the other:
    what reaches into the stream before lies within the first LEAST ids, where no chunk ends."""
    x = (ids.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    rolled, odd = x.copy(), 1
    for j in range(1, min(WINDOW, len(ids))):
        odd = odd * 0xD6E8FEB86659FD93 % (1 << 64)
        rolled[j:] += x[:-j] * U64(odd)
    return np.flatnonzero((rolled >> U64(40)) % U64(MEAN) == 0) + 1


def cuts(proposed: list[int], n: int) -> list[int]:
    """Ends of the chunks of one stream of n ids: proposed ones that leave LEAST to MOST ids, and its end."""
    ends, last = [], 0
    for at in [*proposed, n]:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST or (at == n and at > last):
            ends.append(at)
            last = at
    return ends


_KINDS = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
_NAMES = ["key", "content", "doc_id", "n_tokens", "root", "digests", "ends"]


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES
    )


def _split(path: str, wide: bool):
    """Rows of two kinds: chunks under their digest, recipes under their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sent = encoder(path), set()
        for batch in batches:
            ids, ends_at = with_end(*own.encode_rows(batch.column("text")))
            at = np.concatenate(([0], ends_at)).astype(np.int64)
            proposed = candidates(ids)
            of = np.searchsorted(proposed, at, side="right").tolist()
            width = 4 if wide else 2
            stored = memoryview(ids.astype("<u4" if wide else "<u2").tobytes())
            keys, contents, recipes = [], [], []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                base, n = int(at[k]), int(at[k + 1] - at[k])
                ends = cuts((proposed[of[k] : of[k + 1]] - base).tolist(), n)
                names, last = [], base * width
                for end in ends:
                    content = stored[last : (base + end) * width]
                    last = (base + end) * width
                    name = digest(content)
                    names.append(name)
                    if name not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(name)
                        keys.append(name)
                        contents.append(content)
                recipes.append((doc, n, document_root(names, ends), names, ends))
            docs, sizes, roots, names, ends = zip(*recipes, strict=True) if recipes else [[]] * 5
            yield _rows(keys, contents, pa.nulls(len(keys)), pa.nulls(len(keys)), pa.nulls(len(keys)), pa.nulls(len(keys)), pa.nulls(len(keys)))
            yield _rows(roots, pa.nulls(len(roots)), docs, sizes, roots, names, ends)

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running count of ids within a file."""
    seen = 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        local = seen + np.cumsum(n) - n
        seen += int(n.sum())
        yield batch.append_column("local_start", pa.array(local, pa.int64()))


def write_store(spark: SparkSession, docs: DataFrame, root: str, path: str | None = None) -> None:
    """Write the store of ``docs(doc_id, text)`` under ``root``: chunks, recipes, manifest.

    Each text is its ids and an end id 0; a null text is the end id alone.
    Repeated doc_ids stay apart, null ones come first.
    """
    path = path or vocabulary()
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(path).get_vocab_size() > NARROW
    schema = "key binary, content binary, doc_id long, n_tokens long, root binary, digests array<binary>, ends array<long>"
    rows = docs.select("doc_id", "text").mapInArrow(_split(path, wide), schema)
    # Of each chunk one row stays; recipes, of which one root may belong to many, are told apart by their document.
    rows = rows.withColumn("own", F.when(F.col("content").isNull(), F.coalesce("doc_id", F.lit(-1))))
    place = F.row_number().over(Window.partitionBy("key", "own").orderBy("key"))
    rows = rows.withColumn("place", place).filter("place = 1 or content is null").drop("place", "own")
    rows = rows.withColumn("kind", F.when(F.col("content").isNull(), "recipe").otherwise("chunk"))
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{root}/raw")

    recipes = spark.read.schema(schema).parquet(f"{root}/raw/kind=recipe")
    placed = (
        recipes.select("doc_id", "n_tokens", F.size("digests").alias("n_chunks"), "root", "digests", "ends")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "n_tokens", "root")
        .mapInArrow(_place, f"{RECIPE}, local_start long")
        .withColumn("part", F.spark_partition_id())
    )
    placed.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/recipes")
    manifest = _fold(spark, root)
    manifest.write.mode("overwrite").parquet(f"{root}/manifest")
    _head(spark.read.schema(MANIFEST).parquet(f"{root}/manifest"), wide).write.mode("overwrite").parquet(f"{root}/head")


def _fold(spark: SparkSession, root: str) -> DataFrame:
    """The manifest, from the recipes: a few numbers of each document are dealt by file and folded in order."""
    rows = spark.read.schema(f"{RECIPE}, local_start long, part int").parquet(f"{root}/recipes").select("part", "local_start", "doc_id", "n_tokens", "root")
    return rows.repartition("part").sortWithinPartitions("part", "local_start", "doc_id", "root").mapInArrow(_fold_files, MANIFEST)


def _fold_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file, from its documents in order; a document that does not begin where the last one ended raises."""
    done, file, tree, n_docs, n_ids = [], None, Tree(), 0, 0
    for batch in batches:
        for part, start, doc, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "doc_id", "n_tokens", "root")), strict=True):
            if part != file:
                if file is not None:
                    done.append((file, n_docs, n_ids, tree.root()))
                file, tree, n_docs, n_ids = part, Tree(), 0, 0
            if start != n_ids:
                raise ValueError("the recipes of a file do not follow each other")
            tree.add(_leaf(doc, n, root))
            n_docs += 1
            n_ids += n
    if file is not None:
        done.append((file, n_docs, n_ids, tree.root()))
    columns = list(zip(*done, strict=True)) or [[]] * 4
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "n_docs", "n_ids", "root"])


def _head(manifest: DataFrame, wide: bool) -> DataFrame:
    """One row that signs the manifest (as many rows as files) and says how wide ids are."""
    rows = sorted(tuple(r) for r in manifest.collect())
    tree = Tree()
    for part, n_docs, n_ids, root in rows:
        tree.add(struct.pack("<iqq", part, n_docs, n_ids) + bytes(root))
    sums = sum(r[1] for r in rows), sum(r[2] for r in rows)
    return manifest.sparkSession.createDataFrame([(len(rows), *sums, wide, tree.root())], "files int, n_docs long, n_ids long, wide boolean, root binary")


@lru_cache(1)
def _shifts() -> np.ndarray:
    """[b, k, byte]: what byte k of a CRC-32 becomes after 2**b zero bytes."""
    poly = np.uint32(0xEDB88320)
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ poly, byte >> 1)
    one = lambda v: (v >> np.uint32(8)) ^ byte[v & np.uint32(255)]
    table = np.empty((40, 4, 256), dtype=np.uint32)
    for k in range(4):
        table[0, k] = one(np.arange(256, dtype=np.uint32) << np.uint32(8 * k))
    for b in range(1, 40):
        for k in range(4):
            table[b, k] = _apply(table[b - 1], table[b - 1, k])
    return table


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint32)
    return table[0][v & 255] ^ table[1][(v >> 8) & 255] ^ table[2][(v >> 16) & 255] ^ table[3][v >> 24]


def crc_before(crc: np.ndarray, bytes_after: np.ndarray) -> np.ndarray:
    """What CRCs of parts add (by xor) to the CRC of the whole, given the bytes that follow each part."""
    out, after, b = crc.astype(np.uint32), bytes_after.astype(np.int64), 0
    while (after >> b).any():
        on = ((after >> b) & 1).astype(bool)
        out[on] = _apply(_shifts()[b], out[on])
        b += 1
    return out


def _read_chunks(wide: bool):
    """Digest, length and CRC-32 of each stored chunk; its content must match its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, crcs = [], []
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if digest(content) != key:
                    raise ValueError("a stored chunk does not match its digest")
                ids = np.frombuffer(content, dtype="<u4" if wide else "<u2")
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["key", "size", "crc"]
            )

    return run


def _sound_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
            if digest(content) != key:
                raise ValueError("a stored chunk does not match its digest")
        yield batch


def _shift_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, after = batch.column("crc").to_numpy(), batch.column("after").to_numpy()
        term = crc_before(crc.astype(np.uint32), 4 * after)
        yield batch.select(["part", "local_start", "size"]).append_column("term", pa.array(term.astype(np.int64)))


def _check_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for root, names, ends in zip(*(batch.column(c).to_pylist() for c in ("root", "digests", "ends")), strict=True):
            if len(names) != len(ends) or document_root(names, ends) != root:
                raise ValueError("a recipe does not match its Merkle root")
        yield batch


def verify(spark: SparkSession, root: str) -> tuple[DataFrame, bool]:
    """Ids before each recipe file (as many rows as files) and whether ids are wide; raises unless recipes, manifest and head agree."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    head = spark.read.parquet(f"{root}/head").first()
    if tuple(_head(manifest, head["wide"]).first()) != tuple(head):
        raise ValueError("the manifest does not match its head")
    known = sorted(tuple(r) for r in manifest.collect())
    if sorted(tuple(r) for r in _fold(spark, root).collect()) != known:
        raise ValueError("the recipes do not match the manifest")
    before, out = 0, []
    for part, _, n, _ in known:
        out.append((part, before))
        before += n
    return spark.createDataFrame(out, "part int, base long"), head["wide"]


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files under ``root`` alone.

    The recipes are held against the manifest and its head at once. Every chunk
    is held against its digest, every recipe against its root and every
    document's length against its chunks when the rows are read. A mismatch
    raises. The CRCs of chunks are combined, so no content is shuffled.
    """
    starts, wide = verify(spark, root)
    recipes = spark.read.parquet(f"{root}/recipes").mapInArrow(_check_roots, f"{RECIPE}, local_start long, part int")
    chunks = spark.read.schema("key binary, content binary").parquet(f"{root}/raw/kind=chunk")
    chunks = chunks.mapInArrow(_read_chunks(wide), "key binary, size long, crc long")
    used = recipes.select("part", "local_start", "n_tokens", F.explode(F.arrays_zip("digests", "ends")).alias("x")).select(
        "part", "local_start", F.col("x.digests").alias("key"), (F.col("n_tokens") - F.col("x.ends")).alias("after")
    )
    terms = used.join(chunks, "key").select("part", "local_start", "size", "crc", "after").mapInArrow(
        _shift_crcs, "part int, local_start long, size long, term long"
    )
    whole = terms.groupBy("part", "local_start").agg(F.bit_xor("term").alias("ids_crc32"), F.sum("size").alias("size"))
    heads = spark.read.parquet(f"{root}/recipes").select("part", "local_start", "doc_id", "n_tokens")
    read = heads.join(whole, ["part", "local_start"], "left").join(F.broadcast(starts), "part")
    sound = F.when(F.col("size") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(
        F.raise_error(F.lit("the chunks of a document are not all there")).cast("long")
    )
    return read.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", sound.alias("ids_crc32"))


def store_tokens(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the store of ``docs`` in the shared folder and read it back (see ``read_digests``).

    Empty table: no rows.
    """
    root = Scratch(spark, "tokenstore").path("store")
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    write_store(spark, docs, root, path)
    return read_digests(spark, root)


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, start, ids array<int>``: the documents rebuilt from their recipes and the chunks, checked as in ``read_digests``."""
    starts, wide = verify(spark, root)
    recipes = spark.read.parquet(f"{root}/recipes").mapInArrow(_check_roots, f"{RECIPE}, local_start long, part int")
    used = recipes.select("part", "local_start", "doc_id", F.posexplode("digests").alias("k", "key"))
    chunks = spark.read.schema("key binary, content binary").parquet(f"{root}/raw/kind=chunk").mapInArrow(_sound_chunks, "key binary, content binary")
    parts = used.join(chunks, "key").groupBy("part", "local_start", "doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]).alias("contents")
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x), "<u4" if wide else "<u2").astype(np.int32) for x in batch.column("contents").to_pylist()]
            yield batch.select(["part", "local_start", "doc_id"]).append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    whole = parts.mapInArrow(rebuild, "part int, local_start long, doc_id long, ids array<int>")
    return whole.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "ids"
    )
