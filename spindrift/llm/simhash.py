"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of radius+1 bits. For every non-zero v of as many bits there is
a mask of the bits whose vector is not orthogonal to v. Up to `radius` differing bits leave some v that is
orthogonal to the vectors of all of them, and its mask has none of them. So every pair within the radius
agrees under some mask, and no link is lost.

Distinct fingerprints (copies are counted once) are dealt by (mask, masked bits). Within a bucket a link is
kept only if it joins two parts not joined before, so a bucket of n gives n-1 links at most and no pairs are
written out. Buckets of more than SPLIT fingerprints are dealt anew by blocks of the bits that they do not
share yet (a pair within the radius agrees in one of radius+1 blocks), LEVELS-1 times at most; each time fewer
distinct fingerprints fit into a bucket. Components of the
links are found by alternating star contractions.

Near copies (for the pipeline) are chains of pairs of documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more, decided exactly. The links of their SimHash fingerprints are the first candidates;
since similar sets may differ in more bits than any radius that can be covered, documents that share a band of
MinHash bins are candidates too.

Defined cases: null and empty texts have no words and the fingerprint zero, which links like any other;
repeated rows each give a row; null ids are carried and never become a component's id unless it has no
other; an empty table gives an empty table; other columns are never looked at.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, join_hot, slices, stored
from .shingle_sets import BAND, BANDS, SIMILARITY, Bounds, minhash_bins, odd_sketch, shingle_hashes, verified

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in a bucket beyond which it is dealt anew.
SPLIT = 20_000
LEVELS = 3


def covering_masks(bits: list[int], radius: int, seed: int) -> list[int]:
    """2**(radius+1)-1 masks over the given bits; bits that differ in `radius` places at most agree under one."""
    order = random.Random(seed).sample(bits, len(bits))
    # every vector is given to as many bits as any other, so that all masks have about half of the bits
    vectors = {b: 1 + i % (2 ** (radius + 1) - 1) for i, b in enumerate(order)}
    return [sum(1 << b for b in bits if (vectors[b] & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [line[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(shingles), 60_000):
        some = b"".join([digest(s, SEED) for s in shingles[i : i + 60_000]])
        bits = np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > len(shingles)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h = [signed(fingerprint(t or b"", shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.int64())], ["doc_id", "h"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, h long")


class Forest:
    """Disjoint sets over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bucket_links(h: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all positions of a bucket that chains of pairs within the radius join.

    Fingerprints are gathered around pivots: all within the radius of a pivot link to it, and only pairs
    whose pivots are within three radii are compared further.
    """
    n, out, forest = len(h), [], Forest(len(h))
    if n == 2:
        return [(0, 1)] if int(h[0] ^ h[1]).bit_count() <= radius else []
    free = np.ones(n, bool)
    pivots: list[int] = []
    balls: list[np.ndarray] = []
    for i in range(n):
        if not free[i]:
            continue
        near = np.flatnonzero(free & (np.bitwise_count(h ^ h[i]) <= radius))
        free[near] = False
        out += [(i, int(j)) for j in near if j != i and forest.join(i, int(j))]
        pivots.append(i)
        balls.append(near)
    p = h[pivots]
    for a in range(len(pivots)):
        for b in np.flatnonzero(np.bitwise_count(p[a + 1 :] ^ p[a]) <= 3 * radius) + a + 1:
            if forest.root(pivots[a]) == forest.root(pivots[b]):
                continue
            x, y = balls[a], balls[b]
            for i in x:
                hit = np.flatnonzero(np.bitwise_count(h[y] ^ h[i]) <= radius)
                if len(hit):
                    j = int(y[hit[0]])
                    if forest.join(int(i), j):
                        out.append((int(i), j))
                    break
    return out


def _bucket_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket; a bucket may go on in the next batch."""
        held_key, held = None, np.zeros(0, np.uint64)
        for b in batches:
            keys = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], axis=1)
            h = np.asarray(b.column(2)).view(np.uint64)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts = [0, *edges.tolist()]
            stops = [*edges.tolist(), len(h)]
            left, right = [], []

            def take(x: np.ndarray, left=left, right=right) -> None:
                if len(x) > 1:
                    for i, j in bucket_links(x, radius):
                        left.append(x[i])
                        right.append(x[j])

            for s, e in zip(starts, stops, strict=True):
                if s == e:
                    continue
                key = tuple(keys[s])
                if key != held_key:
                    take(held)
                    held_key, held = key, h[s:e]
                else:
                    held = np.concatenate([held, h[s:e]])
            yield link_batch(left, right)
        if len(held) > 1:
            pairs = bucket_links(held, radius)
            yield link_batch([held[i] for i, _ in pairs], [held[j] for _, j in pairs])

    return run


def link_batch(left: list, right: list) -> pa.RecordBatch:
    x, y = (np.array(v, np.uint64).view(np.int64) for v in (left, right))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["u", "v"])


def block_masks(bits: list[int], radius: int) -> list[int]:
    """radius+1 masks that part the bits: bits that differ in `radius` places at most agree under one."""
    return [sum(1 << b for b in bits[k :: radius + 1]) for k in range(radius + 1)]


def links(distinct: DataFrame, radius: int = RADIUS, split: int = SPLIT, seed: int = 7) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints h that join what pairs within the radius join."""
    shared = covering_masks(list(range(64)), radius, seed)  # the bits that each bucket of a level shares
    rows, n, found = distinct.select("h", F.lit(0).alias("bucket")), len(shared), None
    for depth in range(LEVELS):
        masks = F.array(*[F.lit(signed(m)).cast("long") for m in shared])
        dealt = rows.select("h", F.posexplode(F.slice(masks, F.col("bucket") * n + 1, n)).alias("t", "m"), "bucket")
        dealt = dealt.select((F.col("bucket") * n + F.col("t")).cast("long").alias("mask"), F.col("h").bitwiseAND(F.col("m")).alias("key"), "h")
        again = None
        if depth + 1 < LEVELS:
            hot = stored(dealt.groupBy("mask", "key").count().where(F.col("count") > split).select("mask", "key"), "simhash-hot")
            if hot.take(1):
                again = dealt.join(hot, ["mask", "key"], "left_semi").select("h", F.col("mask").cast("int").alias("bucket"))
                dealt = dealt.join(hot, ["mask", "key"], "left_anti")
        here = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_bucket_batches(radius), "u long, v long")
        found = here if found is None else found.unionByName(here)
        if again is None:
            break
        rows, n = stored(again, "simhash-rows"), radius + 1
        shared = [have | m for have in shared for m in block_masks([b for b in range(64) if not have >> b & 1], radius)]
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the least node that u > v is joined to, for edges (u, v) with u > v.

    Large-star and small-star steps in turn (Kiveris et al. 2014): every step keeps what is joined, and at
    the end all edges lead to the least node. Each round is written to the shared folder.
    """
    edges = stored(edges, "stars")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "stars-least")
        # a node of very many links is no hot key: its row of `least` goes to where the links are
        large = join_hot(both, least, "u", "n").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "stars")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "stars-least")
        joined = join_hot(large, least, "u", "n")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small, "stars")
        # done when no node leads to two others and no node that is led to leads on
        open_ends = small.groupBy("u").count().where("count > 1").select("u").unionByName(small.select("v").distinct().join(small.select(F.col("u").alias("v")), "v", "left_semi").select(F.col("v").alias("u")))
        if not open_ends.take(1):
            return small
        edges = small


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """One row per row of df: id_col, fingerprint, component_id."""
    prints = stored(fingerprints(df, id_col, text_col, shingle), "simhash-prints")
    distinct = stored(prints.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    found = components(links(distinct, radius, split))
    rooted = distinct.join(found.withColumnRenamed("u", "h"), "h", "left").select("h", "rep", "n", F.coalesce("v", "h").alias("root"))
    rooted = stored(rooted, "simhash-rooted")
    reps = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    by_print = stored(join_hot(rooted, stored(reps, "simhash-reps"), "root", "prints").select("h", "n", "component_id"), "simhash-components")
    out = join_hot(prints, by_print, "h", "n")
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("h"), 16, "0")).alias("fingerprint"), "component_id")


#: Documents of a bucket that a task compares, and documents that each block of a larger bucket shares.
BLOCK, PIVOTS = 4000, 64


def grouped(found, keys: int):
    """For mapInArrow over rows sorted by their first `keys` columns: found(rows) gives the links of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links_of() -> Iterator[pa.RecordBatch]:
            pairs = iter(found(held) if len(held) > 1 else [])
            while some := list(itertools.islice(pairs, 50_000)):
                u, v = np.array(some, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:keys] != key:
                    yield from links_of()
                    key, held = row[:keys], []
                held.append(row[keys:])
        yield from links_of()

    return run


def star_links(rows: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """Links of rows (x, label, size, sketch) that may be so similar: from each row to those linked to none before.

    A link is kept only if it joins labels not joined before, so there are fewer links than labels.
    """
    bounds = Bounds([r[2] for r in rows], [r[3] for r in rows], similarity)
    labels = np.unique([r[1] for r in rows], return_inverse=True)[1].tolist()
    forest, free, out = Forest(len(rows)), np.ones(len(rows), bool), []
    for i, (x, _, size, sketch) in enumerate(rows):
        if free[i]:
            free[i] = False
            near = bounds.near(size, sketch, free)
            free[near] = False
            out += [(x, rows[j][0]) for j in near.tolist() if forest.join(labels[i], labels[j])]
    return out


def mixed_buckets(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Those of members (k, bucket, x, size) whose bucket has several components so far.

    Added are label (the component), most (the bucket's greatest component), total and rests (the bucket's
    documents, and those outside its greatest component).
    """
    labels = stored(joined.select(F.col("u").alias("x"), F.col("v").alias("label")), "copy-labels")
    labelled = stored(members.join(labels, "x", "left").withColumn("label", F.coalesce("label", "x")), "copy-labelled")
    counts = labelled.groupBy("k", "bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("k", "bucket").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.max("n").alias("n"), F.sum("n").alias("total")).where("n < total")
    mixed = stored(mixed.select("k", "bucket", "most", "total", (F.col("total") - F.col("n")).alias("rests")), "copy-mixed")
    return stored(labelled.join(mixed, ["k", "bucket"]), "copy-mixed-members")


def proposed(mixed: DataFrame, sketches: DataFrame, similarity: float, block: int) -> DataFrame:
    """(u, v), u > v: links that may be so similar and join components within a block of a bucket.

    A bucket of more than `block` documents is dealt to blocks that all hold its PIVOTS least documents.
    """
    own = mixed.withColumn("blocks", F.ceil(F.col("total") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    cols = ["k", "bucket", "part", "x", "label"]
    # each task keeps the least documents of its share of a bucket first, so no task gathers a bucket
    some = own.where("blocks > 1").withColumn("spread", F.spark_partition_id())
    for by in (["k", "bucket", "spread"], ["k", "bucket"]):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("x"))).where(F.col("rank") <= PIVOTS)
    pivots = some.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("at <> part").withColumn("part", F.col("at"))
    dealt = own.select(*cols).unionByName(pivots.select(*cols)).join(sketches, "x").select(*cols, "n_shingles", "odd")
    dealt = dealt.repartition("k", "bucket", "part").sortWithinPartitions(*cols)
    return dealt.mapInArrow(grouped(lambda rows: star_links(rows, similarity), 3), "u long, v long").where("u > v").distinct()


def remaining(mixed: DataFrame, sketches: DataFrame, similarity: float, block: int) -> DataFrame:
    """(u, v), u > v: all pairs of a bucket that may be so similar and are in different components, each once.

    The documents that are not in a bucket's greatest component are compared with all of it, block by block. Similar sets have
    similar sizes, so a bucket is cut into classes of sizes first, as wide as the similarity allows two sizes to be apart, and such a
    document meets its own class and the two beside it only.
    """
    # a little wider, so that rounding cannot put two sizes two classes apart
    width = math.log(1 / similarity) * (1 + 1e-9)
    size_class = F.floor(F.log(F.greatest("n_shingles", F.lit(1)).cast("double")) / width).cast("int")
    sized = stored(mixed.withColumn("other", F.col("label") != F.col("most")).join(sketches, "x").withColumn("c", size_class), "copy-sized")
    keys = ["k", "bucket", "c"]
    beside = sized.where("other").withColumn("c", F.explode(F.array(*[F.col("c") + d for d in (-1, 0, 1)])))
    # blocks of the class, and parts of those that it is compared with; classes that none is compared with are left out
    parts = beside.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    blocks = sized.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    grid = few(stored(blocks.join(parts, keys), "copy-classes"))
    cols, place = [*keys, "a", "r", "rest", "x", "label", "other", "n_shingles", "odd"], F.xxhash64("x")
    whole = sized.join(grid, keys).withColumn("a", F.pmod(place, F.col("blocks")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = beside.join(grid, keys).withColumn("r", F.pmod(place, F.col("parts")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = whole.withColumn("rest", F.lit(False)).select(*cols).unionByName(rest.withColumn("rest", F.lit(True)).select(*cols))

    def found(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        some, against = ([r for r in rows if r[0] == which] for which in (True, False))
        if not some or not against:
            return
        names, labels, other = (np.array([r[c] for r in against]) for c in (1, 2, 3))
        bounds = Bounds([r[4] for r in against], [r[5] for r in against], similarity)
        for _, x, label, _, size, sketch in some:
            # a pair of two such documents is met from both sides
            at = bounds.near(size, sketch, (labels != label) & (~other | (names < x)))
            yield from ((x, int(y)) for y in names[at])

    dealt = dealt.repartition(*keys, "a", "r").sortWithinPartitions(*keys, "a", "r", "rest", "x")
    return dealt.mapInArrow(grouped(found, 5), "u long, v long").where("u > v").distinct()


def fingerprint_links(vertices: DataFrame, split: int = SPLIT) -> DataFrame:
    """(u, v), u > v: the documents of linked fingerprints, and those of equal ones; candidates."""
    by_print = stored(vertices.groupBy("h").agg(F.min("x").alias("first"), F.count(F.lit(1)).alias("n")), "copy-fingerprints")
    equal = join_hot(vertices.select("h", "x"), by_print, "h", "n").select(F.col("x").alias("u"), F.col("first").alias("v"))
    first = by_print.select("h", "first")
    far = links(by_print.select("h"), RADIUS, split)
    far = far.join(first.select(F.col("h").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("h").alias("v"), F.col("first").alias("b")), "v")
    far = far.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return equal.unionByName(far).where("u > v").distinct()


def copy_prints(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, text) of the rows with an id, and their fingerprints, sets' digests, bins and sketches (stored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for t in b.column(2).to_pylist():
                hashes = shingle_hashes((t or b"").lower().split())
                of = signed(fingerprint(t or b"")), xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), minhash_bins(hashes).tobytes(), odd_sketch(hashes)
                for column, x in zip(out, of, strict=True):
                    column.append(x)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["doc_id", "text_hash", "h", "digest", "n_shingles", "bins", "odd"])

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("binary").alias("text")).where("doc_id is not null")
    prints = texts.mapInArrow(run, "doc_id long, text_hash long, h long, digest binary, n_shingles long, bins binary, odd binary")
    return texts, stored(prints, "copy-prints")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, component_id) of the rows with an id: chains of pairs whose five-word shingles are so similar.

    Candidates are the links of fingerprints, and all documents that share a band of MinHash bins: a pair with a
    similarity of 0.8 shares none of 32 bands with a chance of 5e-8. Odd sketches rule candidates out only where they
    prove a lower similarity; the sets of shingles themselves decide the rest. In buckets of several components
    fewer links than documents are decided first; what these leave apart is then compared pair by pair.
    """
    texts, prints = copy_prints(df, id_col, text_col)
    # equal sets of shingles are one vertex, with the least document that has it
    one = F.min(F.struct("doc_id", "text_hash", "h", "n_shingles", "bins", "odd")).alias("one")
    vertices = prints.groupBy("digest").agg(one, F.count(F.lit(1)).alias("copies")).select(F.monotonically_increasing_id().alias("x"), "digest", "copies", "one.*")
    vertices = stored(vertices, "copy-vertices")
    piece = F.expr(f"substring(bins, k * {2 * BAND} + 1, {2 * BAND})")
    bands = vertices.select("x", "bins", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("k")).withColumn("piece", piece)
    bands = bands.where(F.col("piece") != F.lit(bytes(2 * BAND))).select("k", F.xxhash64("piece").alias("bucket"), "x")
    shared = stored(bands.groupBy("k", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("k", "bucket"), "copy-buckets")
    members = stored(bands.join(shared, ["k", "bucket"]), "copy-members")
    sketches = vertices.select("x", "n_shingles", "odd")

    joined = components(verified(fingerprint_links(vertices), vertices, texts, similarity))
    for more in (proposed, remaining):
        some = verified(more(mixed_buckets(members, joined), sketches, similarity, block), vertices, texts, similarity)
        joined = components(joined.unionByName(some))
    found = joined.withColumnRenamed("u", "x")
    rooted = stored(vertices.select("x", "digest", "copies", "doc_id").join(found, "x", "left").withColumn("root", F.coalesce("v", "x")), "copy-rooted")
    least = stored(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "copy-least")
    by_digest = stored(join_hot(rooted, least, "root", "n").select("digest", "copies", "component_id"), "copy-components")
    out = join_hot(prints.select("doc_id", "text_hash", "digest"), by_digest, "digest", "copies")
    return out.select(F.col("doc_id").alias(id_col), "text_hash", "component_id")


def keep_one_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the rows that are near copies of one with a smaller id; all columns stay.

    Rows with a null id stay, since no id tells them apart, and rows that share the least id of a group all stay.
    A row that shares its id with another one goes only if its own text is a near copy.
    """
    gone = near_copies(df, id_col, text_col, **options).where(F.col(id_col) > F.col("component_id"))
    gone = few(stored(gone.select(F.col(id_col).alias("id"), "text_hash").distinct(), "copy-gone"))
    same = (df[id_col].cast("long") == gone["id"]) & (F.xxhash64(df[text_col]) == gone["text_hash"])
    return df.join(gone, same, "left_anti")
