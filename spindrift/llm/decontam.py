"""Benchmark decontamination by greedy string tiling.

Words of a document that no benchmark item has are 0, the others numbers. Running Karp-Rabin hashes of
`least` words find the seeds that a document shares with an item; seeds on one diagonal grow to maximal
matches; the longest match whose words are unmarked on both sides is marked as a tile, again and again,
until no match of `least` words is left. An item is in a document if its tiles cover the threshold of its
words, in whatever order its passages stand there.

A benchmark of up to about BLOCK_WORDS words is sent to the executors whole, and one pass over the documents finds its
items. A larger one stays a table, and the driver holds a filter of FILTER_BITS bits: seeds of documents
that pass it are joined to those of items, pairs that share too few for the threshold are left out, and each text
meets its items in order of its digest, so that a task holds one text and a few of its items. Seeds, items and texts that very
many rows have are dealt to many parts. Both ways give the same rows.

Defined cases: words are runs of characters between white space and ASCII punctuation, without regard to
case; a null text has none; an item of fewer than `least` words is in a document that has all of them in their order, one
behind the other, wherever they stand, and an item without words in none; repeated rows each give their rows; null ids are carried; an empty table on either side finds nothing; other columns are never
looked at.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, fresh_names, join_salted, slices, stored

LEAST, THRESHOLD = 5, 0.8
BLOCK_WORDS = 200_000
#: Bits of the filter of seeds (8 MB); seeds beyond them pass it more often, and the join decides.
FILTER_BITS = 1 << 26
#: Characters of items that a text is compared with at a time, and words whose hashes a task keeps.
ITEM_CHARS, CACHE_WORDS = 200_000, 200_000
SPACES = bytes(32 if c < 33 or c < 128 and not chr(c).isalnum() else c for c in range(256))
FOUND_SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, tiled_words int, item_words int"


def words(text: str) -> list[bytes]:
    return text.lower().encode(errors="replace").translate(SPACES).split()


def maximal_matches(doc: np.ndarray, item: np.ndarray, at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in doc, place in item, length) of the matches that begin with one of the seeds and go on both ways no further.

    Seeds of one hash stand at `at` in the document and at `places` in the item. A match begins where the words
    before differ, so a run of one word gives as many matches as it has words, not their square.
    """
    before_doc = np.where(at > 0, doc[at - 1].astype(np.int64), -1)
    before_item = np.where(places > 0, item[places - 1].astype(np.int64), -2)
    # a word that no item has differs from all others
    before_doc[before_doc == 0] = -3
    left, right = [], []
    for word in np.unique(before_item).tolist():
        p, q = at[before_doc != word], places[before_item == word]
        left.append(np.repeat(p, len(q)))
        right.append(np.tile(q, len(p)))
    p, q = np.concatenate(left), np.concatenate(right)
    n, going = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(going):
        x, y = p[going] + n[going], q[going] + n[going]
        going = going[(x < len(doc)) & (y < len(item))]
        going = going[doc[p[going] + n[going]] == item[q[going] + n[going]]]
        n[going] += 1
    return p, q, n


def tiles(runs: list[tuple[int, int, int]], least: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item of `size` words from maximal matches (document, item, length): the same of each tile."""
    queue = [(-n, p, q) for p, q, n in runs if n >= least]
    heapq.heapify(queue)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out = []
    while queue and size - len(in_item) >= least:
        n, p, q = heapq.heappop(queue)
        n = -n
        free = [p + i not in in_doc and q + i not in in_item for i in range(n)]
        if all(free):
            in_doc.update(range(p, p + n))
            in_item.update(range(q, q + n))
            out.append((p, q, n))
            continue
        i = 0
        while i < n:  # what is still unmarked waits for its turn
            j = i
            while j < n and free[j]:
                j += 1
            if j - i >= least:
                heapq.heappush(queue, (i - j, p + i, q + i))
            i = j + 1
    return out


class Matcher:
    """A block of benchmark items, ready to be looked for in documents."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = LEAST, threshold: float = THRESHOLD):
        self.least, self.threshold = least, threshold
        self.vocabulary: dict[bytes, int] = {}
        self.sizes: list[tuple[int, int]] = []
        self.texts: list[np.ndarray] = []
        self.short: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        places = defaultdict(list)
        for item_id, text in items:
            ws = words(text or "")
            if len(ws) < least:
                if ws:
                    self.short[tuple(ws)].append(item_id)
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.uint64)
            for q, h in enumerate(self.hashes(ids, np.arange(len(ids) - least + 1)).tolist()):
                places[h].append((len(self.sizes), q))
            self.sizes.append((item_id, len(ws)))
            self.texts.append(ids)
        self.places = dict(places)
        self.seeds = np.array(sorted(places), np.uint64)

    def hashes(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(self.least):
            h = h * np.uint64(0x100000001B3) + ids[at + k] * np.uint64(0x9E3779B97F4A7C15)
        return h ^ h >> np.uint64(31)

    def short_items(self, ws: list[bytes]) -> list[tuple[int, float, int, int, int]]:
        """Items of fewer than `least` words, each looked for at every place."""
        found = set()
        for n in {len(k) for k in self.short}:
            found |= self.short.keys() & set(zip(*(ws[i:] for i in range(n)), strict=False))
        return [(item, 1.0, 1, len(k), len(k)) for k in sorted(found) for item in self.short[k]]

    def find(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item, coverage, tiles, tiled words, words) of each item that the text holds."""
        ws = words(text or "")
        out = self.short_items(ws)
        if len(ws) < self.least or not len(self.seeds):
            return out
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in ws], np.uint64)
        known = ids != 0
        n = len(ws) - self.least + 1
        run = known[:n].copy()
        for k in range(1, self.least):
            run &= known[k : k + n]
        at = np.flatnonzero(run)
        if not len(at):
            return out
        h = self.hashes(ids, at)
        hit = self.seeds[np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)] == h
        if not hit.any():
            return out
        at, h = at[hit], h[hit]
        order = np.argsort(h, kind="stable")
        edges = np.flatnonzero(np.diff(h[order], prepend=~h[order[0]]))
        where = dict(zip(h[order[edges]].tolist(), np.split(at[order], edges[1:]), strict=True))
        seen: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for x in where:
            for item, q in self.places[x]:
                seen[item][x].append(q)
        for item, seeds in seen.items():
            item_id, size = self.sizes[item]
            # no more words can be tiled than the seeds' places in the item cover
            covered = np.zeros(size + self.least, bool)
            for q in seeds.values():
                covered[np.array(q)[:, None] + np.arange(self.least)] = True
            if covered.sum() < self.threshold * size:
                continue
            runs: list[tuple[int, int, int]] = []
            for x, q in seeds.items():
                runs += zip(*(v.tolist() for v in maximal_matches(ids, self.texts[item], where[x], np.array(q))), strict=True)
            laid = tiles(runs, self.least, size)
            total = sum(t[2] for t in laid)
            if total >= self.threshold * size:
                out.append((item_id, total / size, len(laid), total, size))
        return out


def text_key(text: Column) -> Column:
    """A digest that stands for a text in shuffles; null for null."""
    return F.unhex(F.md5(text))


class Seeder:
    """Running hashes of `least` words, the same in every task, and of fewer for items that have fewer."""

    def __init__(self, least: int, fewer: list[int]):
        self.least, self.lengths = least, [*fewer, least]
        self.known: dict[bytes, int] = {}

    def hashes(self, ws: list[bytes], n: int) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        for w in set(ws).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        x = np.array([self.known[w] for w in ws], np.uint64)
        h = np.full(max(len(ws) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + x[k : k + len(h)]
        return (h ^ h >> np.uint64(31)).view(np.int64)

    def of_text(self, text: str) -> np.ndarray:
        ws = words(text)
        return np.unique(np.concatenate([self.hashes(ws, n) for n in self.lengths]))


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """(item, seed, places, size): the seeds of each item, at how many places it has them, and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder(least, [])
        for b in slices(batches):
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                if ws:
                    seeds, places = np.unique(seeder.hashes(ws, min(len(ws), least)), return_counts=True)
                    n = len(seeds)
                    columns = [pa.array([item] * n, pa.int64()), pa.array(seeds), pa.array(places, pa.int64()), pa.array([len(ws)] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "seed", "places", "size"])

    return items.select("item", "text").mapInArrow(run, "item long, seed long, places long, size long")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit for each seed at its lowest digits; FILTER_BITS of them however many seeds there are."""
    at = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1))
    slots = seeds.select(F.shiftright(at, 6).alias("slot"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("bit"))
    found = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return out


def text_seeds(texts: DataFrame, bits: np.ndarray, least: int, fewer: list[int]) -> DataFrame:
    """(key, seed) of the seeds of texts that pass the filter, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder(least, fewer)
        for b in slices(batches):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seeds = seeder.of_text(text)
                seeds = seeds[bits[(seeds & FILTER_BITS - 1) >> 6] >> (seeds & 63) & 1 == 1]
                if len(seeds):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(seeds), pa.binary()), pa.array(seeds)], ["key", "seed"])

    return texts.mapInArrow(run, "key binary, seed long").distinct()


def found_in_texts(texts: DataFrame, items: DataFrame, least: int, threshold: float) -> DataFrame:
    """(key, item_id, ...), stored: the items that each distinct text holds, for a benchmark of any size.

    `texts` has (key, text), `items` (item_id, text).
    """
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    seeds = stored(item_seeds(items, least), "benchmark-seeds")
    fewer = sorted(r.size for r in seeds.where(F.col("size") < least).select("size").distinct().collect())
    met = stored(text_seeds(texts, seed_filter(seeds), least, fewer), "text-seeds")
    pairs = join_salted(met, seeds, "seed", met.groupBy("seed").agg(F.count("*").alias("n"))).where("item is not null")
    # a place of a seed covers `least` words at most
    pairs = pairs.groupBy("key", "item").agg(F.sum("places").alias("places"), F.max("size").alias("size"))
    pairs = stored(pairs.where(F.col("places") * least >= F.col("size") * threshold).select("key", "item"), "benchmark-pairs")
    keys = few(stored(pairs.select("key").distinct(), "benchmark-texts"))
    once = texts.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    asked = join_salted(pairs, items, "item", pairs.groupBy("item").agg(F.count("*").alias("n")))
    rows = once.select("key", F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("item_id"), "text")
    rows = rows.unionByName(asked.select("key", "item", "item_id", "text")).repartition("key").sortWithinPartitions("key", F.asc_nulls_first("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text, waiting, size = None, None, [], 0
        for b in slices(batches):
            out = []
            for k, item, item_id, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if waiting and (item is None or size > ITEM_CHARS):
                    out += [(key, *x) for x in Matcher(waiting, least, threshold).find(text)]
                    waiting, size = [], 0
                if item is None:
                    key, text = k, t
                else:
                    waiting.append((item_id, t))
                    size += len(t)
            yield record(out, ("key", pa.binary()))
        if waiting:
            yield record([(key, *x) for x in Matcher(waiting, least, threshold).find(text)], ("key", pa.binary()))

    return stored(rows.mapInArrow(run, FOUND_SCHEMA.replace("doc_id long", "key binary")), "benchmark-found")


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> tuple[DataFrame, list[tuple[int, str]] | None]:
    """(item_id, text) of the items with a text, and their list if they have about block_words words or fewer."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("length(text) > 0")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, sorted(((r.item_id, r.text) for r in items.collect()), key=str) if size <= 5 * block_words else None


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and benchmark item that it holds, with the share of the item that tiles cover."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items, held = benchmark_items(benchmark, item_col, item_text_col, block_words)
    if held is None:
        keyed = docs.where("text is not null").withColumn("key", text_key(F.col("text")))
        found = found_in_texts(keyed.select("key", "text"), items, least, threshold)
        keys = few(stored(found.select("key").distinct(), "benchmark-keys"))
        ids = stored(keyed.select("doc_id", "key").join(keys, "key", "left_semi").select("doc_id", "key"), "benchmark-ids")
        joined = join_salted(ids, found, "key", ids.groupBy("key").agg(F.count("*").alias("n")))
        return joined.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Matcher(held, least, threshold).find
        for b in slices(batches):
            yield record([(doc, *x) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in find(text)])

    return docs.mapInArrow(run, FOUND_SCHEMA)


names = [x.split()[0] for x in FOUND_SCHEMA.split(", ")]
types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]


def record(rows: list[tuple], first: tuple[str, pa.DataType] = ("doc_id", pa.int64())) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [first[1], *types[1:]], strict=True)], [first[0], *names[1:]])


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """df without the rows whose text holds a benchmark item; all columns stay. Nothing is shuffled if the benchmark is small."""
    items, held = benchmark_items(benchmark, item_col, item_text_col, block_words)
    if held is None:
        key, = fresh_names(df, "text_key")
        texts = df.where(F.col(text_col).isNotNull()).select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
        found = found_in_texts(texts, items, least, threshold)
        gone = few(stored(found.select(F.col("key").alias(key)).distinct(), "benchmark-keys"))
        return df.withColumn(key, text_key(F.col(text_col))).join(gone, key, "left_anti").select(*df.columns)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Matcher(held, least, threshold).find
        for b in slices(batches):
            yield b.filter(pa.array([not find(t) for t in b.column(place).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
