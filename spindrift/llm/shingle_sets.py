"""Sets of word shingles: MinHash bins for candidates, odd sketches that rule pairs out, and exact similarities.

An odd sketch holds for each place the parity of the number of shingles that hash to it. The exclusive or of two
is the odd sketch of the shingles that only one of the sets has, so its number of ones is never more than the
number of these: a pair that it rules out is surely less similar, and no pair is lost. A sketch has four bits
or more for each shingle (up to WIDEST), which rules out nearly all pairs below a similarity of 0.78 for a threshold of 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, slices, stored

#: Words of a shingle, similarity, MinHash bins, bins of a band.
SHINGLE, SIMILARITY, BINS, BAND = 5, 0.8, 128, 4
BANDS = BINS // BAND
#: Bits of an odd sketch, at least and at most.
NARROWEST, WIDEST = 256, 1 << 17
#: Pairs of a document that one task verifies.
FAN = 1000


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the word shingles in order; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b]) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def minhash_bins(hashes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: of each bin of sorted hashes the least one's last 16 bits, 0 if it is empty."""
    out = np.zeros(BINS, np.uint16)
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = np.maximum(hashes[first] & np.uint64(0xFFFF), 1)
    return out


def odd_sketch(hashes: np.ndarray) -> bytes:
    bits = NARROWEST
    while bits < min(4 * len(hashes), WIDEST):
        bits *= 2
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(words: np.ndarray) -> np.ndarray:
    """Odd sketches of half the width."""
    half = words.shape[-1] // 2
    return words[..., :half] ^ words[..., half:]


class Bounds:
    """Sizes and odd sketches of some sets: which of them may be as similar to one as `similarity`."""

    def __init__(self, sizes: list[int], sketches: list[bytes], similarity: float):
        self.sizes = np.array(sizes, np.int64)
        self.similarity, self.share = similarity, (1 - similarity) / (1 + similarity)
        widths = np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.levels = {}
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            words = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1)
            self.levels[width] = at, words, folded(words)

    def near(self, size: int, sketch: bytes, free: np.ndarray) -> np.ndarray:
        """Positions, of those that are free, of the sets that may be so similar to a set of this size and sketch."""
        one, width = np.frombuffer(sketch, np.uint64), len(sketch)
        large, small = np.maximum(self.sizes, size), np.minimum(self.sizes, size)
        free = free & (small >= self.similarity * large - 1e-9) & (large > 0)
        out = []
        # a set of four fifths of the size has a sketch of the same width, or of half or twice it
        for other, shift in ((width, 0), (2 * width, 1), (width // 2, -1)):
            if other in self.levels:
                at, words, half = self.levels[other]
                some = np.flatnonzero(free[at])
                if len(some):
                    differ = (half if shift == 1 else words)[some] ^ (folded(one) if shift == -1 else one)
                    ok = np.bitwise_count(differ).sum(axis=1) <= self.share * (self.sizes[at[some]] + size) + 1e-9
                    out.append(at[some[ok]])
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def with_set(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """pairs with the set of the document `key`; a document of many pairs is copied for each FAN of them."""
    hot = stored(pairs.groupBy(key).count().where(F.col("count") > FAN).select(key, F.ceil(F.col("count") / FAN).cast("int").alias("parts")), "copy-hot")
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(few(hot), key, "left").withColumn("part", F.pmod(F.xxhash64("u", "v"), parts).cast("int")).drop("parts")
    right = sets.select(F.col("x").alias(key), F.col("hashes").alias(f"{key}_set")).join(few(hot), key, "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [key, "part"]).drop("part")


def verified(pairs: DataFrame, vertices: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of `pairs` whose sets of shingles have at least this Jaccard similarity.

    vertices: x and the doc_id and text_hash of a row of texts that has its set.
    """
    pairs = stored(pairs, "copy-pairs")
    named = pairs.select(F.explode(F.array("u", "v")).alias("x")).distinct()
    needed = stored(vertices.select("x", "doc_id", "text_hash").join(named, "x"), "copy-needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_hashes((t or b"").lower().split()).view(np.int64) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column(0), hashes], ["x", "hashes"])

    sets = texts.join(few(needed), ["doc_id", "text_hash"]).select("x", "text").mapInArrow(run, "x long, hashes array<long>")
    # rows that are repeated have equal sets; one is enough
    sets = stored(sets.dropDuplicates(["x"]), "copy-sets")
    both = F.size(F.array_intersect("u_set", "v_set"))
    either = F.size("u_set") + F.size("v_set") - both
    found = with_set(with_set(pairs, sets, "u"), sets, "v")
    return stored(found.where(both >= F.lit(similarity) * either).select("u", "v").distinct(), "copy-verified")
