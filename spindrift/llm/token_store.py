"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give equal chunks
wherever they stand. The store has three Parquet tables under one folder:

    objects    unique chunks (kind 0: SHA-256 of the ids as little-endian unsigned 32-bit integers, the ids,
               as 16-bit integers where they fit) and raw recipes (kind 1)
    recipes    one row per document in ascending doc_id order: its chunks, Merkle root and place in its part
    manifest   one row per part: documents, first id of the part in the whole stream, ids, Merkle root

A recipe's root is that of a binary tree over its chunks' digests. A part's root is that of a tree over its
recipes' roots in their order, where each node has FANOUT children, so that no task needs a whole part.

read_store() reads them back: each chunk's digest is recomputed from its bytes, each recipe's root from its
digests, each part's root from its recipes, and each document's checksum is joined from those of its chunks
(a CRC of a concatenation is linear in theirs), so that no document's bytes need to meet in one place.

Chunks are made unique by an aggregation that combines equal ones in each task before the shuffle, so the
commonest chunk is no hot key there; where recipes meet chunks it is a skewed join, which Spark splits.

Defined cases: a null text counts as empty, and an empty one is its end id alone; the string of a special token
in a text is that token, as in the tokenizers library; repeated rows are stored as documents of their own that
share chunks; null ids come first; an empty table gives empty tables; other columns are never looked at.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import join_salted, shuffle_partitions, slices

END_ID = 2
#: Chunks: ids that the rolling hash sees, ids in the mean, at least and at most.
SPAN, MEAN, LEAST, MOST = 8, 512, 128, 4096
#: Children of a node of a part's Merkle tree.
FANOUT = 1024
OBJECT_SCHEMA = "key long, kind int, digest binary, n_ids long, payload binary, doc_id long, chunks array<binary>, sizes array<int>"
RECIPE_SCHEMA = "part int, place long, doc_id long, local_start long, n_tokens long, root binary, chunks array<binary>, sizes array<int>"
REF_SCHEMA = "part int, place long, doc_id long, start long, n_tokens long, digest binary, size int, bytes_after long"


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last SPAN ids is marked; SPAN or more."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    rolled = (sums[SPAN:] - sums[:-SPAN]) * np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero(rolled >> np.uint64(32) & np.uint64(MEAN - 1) == 0) + SPAN


def cuts(ids: np.ndarray, stops: list[int] | None = None) -> list[list[int]]:
    """Ends of the chunks of each of the streams of ids that end at `stops`."""
    stops = [len(ids)] if stops is None else stops
    marks = marks_of(ids) if len(ids) >= SPAN else np.zeros(0, np.int64)
    out, last = [], 0
    edges = np.searchsorted(marks, [0, *stops]).tolist()
    for stop, low, high in zip(stops, edges[:-1], edges[1:], strict=True):
        ends = []
        if stop - last > LEAST:
            # a mark that is reached with LEAST ids or more has seen ids of this stream only
            for end in [*marks[low:high].tolist(), stop]:
                while end - last > MOST:
                    last += MOST
                    ends.append(last)
                if end - last >= LEAST or end == stop and end > last:
                    ends.append(end)
                    last = end
        else:
            ends.append(stop)
        out.append(ends)
        last = stop
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the tree over the leaves; an odd node moves up, no leaf gives the digest of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def narrow(ids: np.ndarray) -> tuple[bytes, int]:
    """The ids in 16 bits where they fit, and the bytes of each."""
    width = 4 if len(ids) and ids.max() > 65535 else 2
    return ids.astype(f"<u{width}").tobytes(), width


def widen(payload: bytes) -> bytes:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4").tobytes()


@functools.cache
def _crc_powers(levels: int = 44) -> list[np.ndarray]:
    """For k: what each bit of a CRC-32 becomes when 2**k zero bytes follow."""
    one_bit = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)

    def then(m: np.ndarray) -> np.ndarray:
        return np.array([np.bitwise_xor.reduce(m[[i for i in range(32) if int(x) >> i & 1]]) for x in m], np.uint32)

    out = [one_bit]
    for _ in range(levels + 2):
        out.append(then(out[-1]))
    return out[3:]


def shifted_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What CRCs contribute to that of a stream in which `zeros` more bytes follow."""
    crc = crc.astype(np.uint32)
    for k, m in enumerate(_crc_powers()):
        on = (zeros >> k) & 1 == 1
        if not on.any():
            continue
        x = crc[on]
        y = np.zeros_like(x)
        for i in range(32):
            y ^= np.where(x >> np.uint32(i) & np.uint32(1), m[i], np.uint32(0))
        crc[on] = y
    return crc.astype(np.int64)


def lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([y for x in values for y in x], kind))


def object_batch(rows: list[tuple]) -> pa.RecordBatch:
    key, kind, digest, n, payload, doc, chunks, sizes = zip(*rows, strict=True) if rows else [()] * 8
    arrays = [pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(payload, pa.binary()), pa.array(doc, pa.int64()), lists(chunks, pa.binary()), lists(sizes, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in OBJECT_SCHEMA.split(", ")])


def write_store(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text, append end_id, and write objects, recipes and manifest under path."""
    file = tokenizer or tokens.default_path()
    spark = df.sparkSession
    parts = shuffle_partitions(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(file), np.array([end_id], "<u4").tobytes()
        serial = TaskContext.get().partitionId() << 32
        for b in slices(batches):
            streams = [x + end for x in encoder.encode_all(b.column(1).to_pylist())]
            raw = b"".join(streams)
            ids = np.frombuffer(raw, "<u4")
            packed, width = narrow(ids)
            rows, seen, last = [], set(), 0
            for doc, ends in zip(b.column(0).to_pylist(), cuts(ids, np.cumsum([len(x) // 4 for x in streams]).tolist()), strict=True):
                chunks, sizes, first = [], [], last
                for stop in ends:
                    digest = hashlib.sha256(raw[4 * last : 4 * stop]).digest()
                    chunks.append(digest)
                    sizes.append(stop - last)
                    if digest not in seen:
                        seen.add(digest)
                        payload = bytes([width]) + packed[width * last : width * stop]
                        rows.append((int.from_bytes(digest[:8], "little", signed=True), 0, digest, stop - last, payload, None, (), ()))
                    last = stop
                serial += 1
                rows.append((serial, 1, None, last - first, None, doc, chunks, sizes))
            yield object_batch(rows)

    sent = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, OBJECT_SCHEMA)
    objects = sent.dropDuplicates(["key", "kind", "digest"])
    objects.drop("key").write.option("compression", "zstd").parquet(f"{path}/objects")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, start = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column(1).to_numpy()
            ends = start + np.cumsum(sizes)
            roots = [merkle_root(x) for x in b.column(2).to_pylist()]
            n = b.num_rows
            arrays = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), b.column(0), pa.array(ends - sizes), b.column(1), pa.array(roots, pa.binary()), b.column(2), b.column(3)]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in RECIPE_SCHEMA.split(", ")])
            at, start = at + n, start + int(sizes.sum())

    raw = spark.read.parquet(f"{path}/objects").where("kind = 1").select("doc_id", "n_ids", "chunks", "sizes")
    ordered = raw.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(place, RECIPE_SCHEMA)
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")

    found = part_roots(spark.read.parquet(f"{path}/recipes"))
    # one row for each part of the store: a window over as many rows as there are shuffle partitions
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    found.withColumn("first_id", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def part_roots(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, root) of each part: the Merkle root of its recipes' roots in their order."""
    sums = recipes.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    left, level = recipes.agg(F.max("place")).first()[0], recipes.select("part", F.col("place").alias("i"), F.col("root").alias("node"))
    depth = 0
    while depth == 0 or (left or 0) > 0:
        level = level.groupBy("part", F.floor(F.col("i") / FANOUT).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "node"))).alias("children"))
        bytes_of = F.aggregate("children", F.lit(b"\2"), lambda done, x: F.concat(done, x["node"]))
        level = level.select("part", "i", F.unhex(F.sha2(bytes_of, 256)).alias("node"))
        left, depth = (left or 0) // FANOUT, depth + 1
    return sums.join(level.select("part", F.lower(F.hex("node")).alias("root")), "part")


def checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(digest, crc, n) of each chunk from its bytes in the files; a chunk whose digest differs is an error."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = b.column(0).to_pylist()
            raw = [widen(x) for x in b.column(1).to_pylist()]
            for d, x in zip(digests, raw, strict=True):
                if hashlib.sha256(x).digest() != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(zlib.crc32, raw), pa.int64()), pa.array([len(x) // 4 for x in raw], pa.int32())], ["digest", "crc", "n"])

    return spark.read.parquet(f"{path}/objects").where("kind = 0").select("digest", "payload").mapInArrow(check, "digest binary, crc long, n int")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files; damage is an error."""
    manifest = spark.read.parquet(f"{path}/manifest")
    recipes = spark.read.parquet(f"{path}/recipes")
    bad = part_roots(recipes).join(manifest.select("part", F.col("root").alias("stated")), "part", "left").where("stated is null or stated <> root").select("part").take(1)
    if bad:
        raise ValueError(f"part {bad[0].part} of the recipes is damaged")

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in REF_SCHEMA.split(", ")]
        for b in batches:
            chunks, sizes = b.column(6).to_pylist(), b.column(7).to_pylist()
            for root, x in zip(b.column(5).to_pylist(), chunks, strict=True):
                if merkle_root(x) != root:
                    raise ValueError("a recipe is damaged")
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in chunks])
            after = array("q")
            for x in sizes:
                rest = sum(x)
                for n in x:
                    rest -= n
                    after.append(4 * rest)
            taken = [b.column(i).take(pa.array(row)) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array([y for x in chunks for y in x], pa.binary()), pa.array([y for x in sizes for y in x], pa.int32()), pa.array(np.frombuffer(after, np.int64))], names)

    # the manifest has one row for each part, as many as there were shuffle partitions
    placed = recipes.join(F.broadcast(manifest.select("part", "first_id")), "part")
    wanted = placed.select("part", "place", "doc_id", (F.col("first_id") + F.col("local_start")).alias("start"), "n_tokens", "root", "chunks", "sizes").mapInArrow(refs, REF_SCHEMA)
    # the chunk of empty texts, or of a passage in a third of all documents, is wanted very often
    uses = recipes.select(F.explode("chunks").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    joined = join_salted(wanted, checked_chunks(spark, path), "digest", uses)

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(5).null_count or not b.column(6).equals(b.column(7)):
                raise ValueError("a chunk is missing or has another size")
            crc = shifted_crc(b.column(5).to_numpy(), b.column(8).to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(crc), b.column(7)], ["part", "place", "doc_id", "start", "n_tokens", "crc", "n"])

    each = joined.select("part", "place", "doc_id", "start", "n_tokens", "crc", "size", "n", "bytes_after").mapInArrow(contribute, "part int, place long, doc_id long, start long, n_tokens long, crc long, n int")
    whole = each.groupBy("part", "place", "doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"))
    return whole.select("doc_id", "start", F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is not whole")).cast("long")).alias("n_tokens"), "ids_crc32")
