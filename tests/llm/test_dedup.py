import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from spindrift.llm import exact_dedup, shingle_sets, simhash


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity", [None, 1, 3])
def test_exact_groups_by_brute_force(spark, messy, capacity):
    hot = spark.createDataFrame([(i, "hot text", None, None, None) for i in range(2000, 2300)], "doc_id long, text string, lang string, source string, n_chars long")
    df = messy.unionByName(hot, allowMissingColumns=True)
    got = sorted(map(tuple, exact_dedup.exact_groups(df, capacity=capacity).collect()), key=repr)
    assert got == brute_groups(df.collect())
    left = exact_dedup.drop_exact_duplicates(df, capacity=capacity)
    assert left.columns == df.columns
    want = sorted(((i, s) for i, _, _, kept, s in got if kept), key=repr)
    assert sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in left.collect()), key=repr) == want


def test_exact_groups_of_nothing(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_misra_gries_keeps_the_frequent():
    rng = np.random.default_rng(1)
    items = [*["a"] * 400, *["b"] * 250, *map(str, range(600))]
    rng.shuffle(items)
    counts: dict = {}
    exact_dedup.misra_gries(counts, items, 5)
    assert len(counts) <= 5 and {"a", "b"} <= counts.keys()
    assert counts["a"] <= 400


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = 0
    for k in range(64):
        if sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) * 2 > len(shingles):
            bits |= 1 << k
    return bits


def test_fingerprint(messy_texts):
    for t in [*messy_texts[:120], "One two", "A b\x0bc\x0cd E f \xa0g", "w " * 500]:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def test_spark_has_the_same_hash(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("größe und zahl",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got == simhash.signed(xxhash.xxh64_intdigest("größe und zahl".encode(), 42))


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_the_radius(radius):
    rng = np.random.default_rng(radius)
    masks = simhash.covering_masks(list(range(64)), radius, 7)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        differ = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False))
        assert any(not differ & m for m in masks)


def brute_components(rows, prints):
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r.doc_id)
    return sorted(((r.doc_id, f"{prints[i]:016x}", min((x for x in ids[root(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("split", [20_000, 2])
def test_components_by_brute_force(spark, messy, split):
    rng = np.random.default_rng(4)
    base = ["of the people by " + " ".join(map(str, rng.integers(0, 50, 60))) for _ in range(4)]
    near = [" ".join("new" if rng.random() < 0.02 else w for w in base[k % 4].split()) for k in range(160)]
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(near)], "doc_id long, text string")
    df = messy.limit(150).unionByName(messy.where("doc_id is null or doc_id >= 1000")).unionByName(extra, allowMissingColumns=True)
    rows = df.collect()
    want = brute_components(rows, [simhash.fingerprint((r.text or "").encode()) for r in rows])
    got = simhash.near_duplicates(df, split=split)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_bucket_links_join_what_pairs_join():
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**63, 6).astype(np.uint64)
    h = np.unique([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for c in centres for _ in range(60)])
    up = simhash.Forest(len(h))
    for i in range(len(h)):
        for j in range(i):
            if int(h[i] ^ h[j]).bit_count() <= 3:
                up.join(i, j)
    got = simhash.Forest(len(h))
    pairs = simhash.bucket_links(h, 3)
    assert len(pairs) < len(h)
    for i, j in pairs:
        assert int(h[i] ^ h[j]).bit_count() <= 3
        got.join(i, j)
    assert [up.root(i) for i in range(len(h))] == [got.root(i) for i in range(len(h))]


def test_star_components(spark):
    rng = np.random.default_rng(2)
    edges = {tuple(sorted(map(int, rng.choice(300, 2, replace=False)), reverse=True)) for _ in range(200)} | {(i + 1001, i + 1000) for i in range(40)}
    up = simhash.Forest(2000)
    for a, b in edges:
        up.join(a, b)
    got = simhash.components(spark.createDataFrame(list(edges), "u long, v long")).collect()
    nodes = {x for e in edges for x in e}
    assert {(r.u, r.v) for r in got} == {(x, up.root(x)) for x in nodes if up.root(x) != x}


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def copies_of(df, **options):
    return sorted((r.doc_id, r.component_id) for r in simhash.near_copies(df, **options).collect())


@pytest.mark.parametrize("block", [20_000, 3])
def test_near_copies_against_jaccard(spark, messy, block):
    rng = np.random.default_rng(6)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 2000, 400)) for _ in range(5)]
    near = [" ".join("new" if rng.random() < 0.006 else w for w in base[k % 5].split()) for k in range(60)]
    other = [" ".join(f"w{x}" for x in rng.integers(0, 2000, 400)) for _ in range(40)]
    far = [" ".join(base[k].split()[:200] + other[k].split()[:200]) for k in range(5)]
    texts = near + other + far
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = messy.where("doc_id is null or doc_id >= 1000").unionByName(extra, allowMissingColumns=True)
    rows = [r for r in df.collect() if r.doc_id is not None]
    sets = [shingles(r.text) for r in rows]
    up = simhash.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up.join(i, j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[up.root(i)].append(r.doc_id)
    want = sorted((r.doc_id, min(least[up.root(i)])) for i, r in enumerate(rows))
    assert copies_of(df, block=block) == want
    kept = simhash.keep_one_each(df, block=block)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, c in want if i == c)
    assert kept.where("doc_id is null").count() == df.where("doc_id is null").count()


def test_odd_sketches_rule_out_only_what_is_below():
    rng = np.random.default_rng(8)
    ruled_out = 0
    for n in (1, 3, 40, 500, 3000, 50_000):
        for same in (0.6, 0.75, 0.85, 0.87, 0.88, 0.89, 0.9, 0.91, 1.0):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            y = np.concatenate([x[: int(same * n)], rng.integers(0, 2**63, int(n * rng.uniform(0, 0.3))).astype(np.uint64)])
            x, y = np.unique(x), np.unique(y)
            common = len(np.intersect1d(x, y))
            alike = common >= 0.8 * (len(x) + len(y) - common)
            bounds = shingle_sets.Bounds([len(x)], [shingle_sets.odd_sketch(x)], 0.8)
            near = len(bounds.near(len(y), shingle_sets.odd_sketch(y), np.ones(1, bool)))
            assert near or not alike or not len(x)
            ruled_out += not near and not alike
    assert ruled_out > 25


def random_words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def test_near_copies_that_grow_or_shrink(spark):
    rng = np.random.default_rng(11)
    rows, want = [], []
    for k in range(40):
        words, more = random_words(rng, 400), random_words(rng, 400)
        copy = [words + more[:72], words[:340], words + more[:94], words[-326:]][k % 4]
        x, y = shingles(" ".join(words)), shingles(" ".join(copy))
        assert 0.8 <= len(x & y) / len(x | y) < 0.87
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        want += [(2 * k, 2 * k), (2 * k + 1, 2 * k)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert copies_of(df) == want


def test_near_copies_keep_what_is_below(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(40):
        words = random_words(rng, 400)
        copy = words[: 306 + k % 14]
        x, y = shingles(" ".join(words)), shingles(" ".join(copy))
        assert 0.75 < len(x & y) / len(x | y) < 0.8
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.keep_one_each(df).count() == len(rows)


@pytest.mark.parametrize("block", [20_000, 4])
def test_near_copies_in_large_buckets(spark, block, monkeypatch):
    """Chains around 0.8 in buckets that hold many blocks and few pivots: all that is left between blocks is decided."""
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    monkeypatch.setattr(shingle_sets, "FAN", 3)
    rng = np.random.default_rng(13)
    words = random_words(rng, 900)
    texts = [words[k : k + 200] for k in [*range(0, 300, 9), *range(420, 600, 23)]]
    order = rng.permutation(len(texts)).tolist()
    sets = [shingles(" ".join(texts[i])) for i in order]
    up = simhash.Forest(len(order))
    for i in range(len(order)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up.join(i, j)
    want = [(i, up.root(i)) for i in range(len(order))]
    assert 1 < len({r for _, r in want}) < len(order)
    df = spark.createDataFrame([(i, " ".join(texts[o])) for i, o in enumerate(order)], "doc_id long, text string")
    assert copies_of(df, block=block) == want


def test_blocks_of_a_large_bucket_are_bounded(spark):
    from pyspark.sql import functions as F

    hashes = np.unique(np.random.default_rng(14).integers(0, 2**63, 400).astype(np.uint64))
    sketches = spark.createDataFrame([(i, len(hashes), shingle_sets.odd_sketch(hashes)) for i in range(600)], "x long, n_shingles long, odd binary")
    members = sketches.select(F.lit(0).alias("k"), F.lit(1).cast("long").alias("bucket"), "x")
    none = spark.createDataFrame([], "u long, v long")
    pairs = [(r.u, r.v) for r in simhash.proposed(simhash.mixed_buckets(members, none), sketches, 0.8, 50).collect()]
    # all blocks share their first pivot, so one star joins the bucket
    assert sorted(pairs) == [(i, 0) for i in range(1, 600)]
    half = spark.createDataFrame([(i, 0) for i in range(1, 500)], "u long, v long")
    left = {(r.u, r.v) for r in simhash.remaining(simhash.mixed_buckets(members, half), sketches, 0.8, 50).collect()}
    assert left == {(i, j) for i in range(500, 600) for j in range(i)}
    some = simhash.mixed_buckets(members.where("x < 60"), none)
    assert simhash.remaining(some, sketches, 0.8, 50).count() == 60 * 59 // 2


def test_rows_that_share_an_id_are_told_apart(spark):
    rng = np.random.default_rng(15)
    a, b = " ".join(random_words(rng, 60)), " ".join(random_words(rng, 60))
    df = spark.createDataFrame([(1, a, "x"), (2, a + " end", "x"), (2, b, "y"), (3, b, "z"), (4, None, "w"), (5, "", "w")], "id long, text string, text_hash string")
    kept = simhash.keep_one_each(df.withColumnRenamed("id", "doc_id")).collect()
    assert sorted((r.doc_id, r.text_hash) for r in kept) == [(1, "x"), (2, "y"), (4, "w")]


def test_equal_sets_of_shingles_are_one_vertex(spark):
    texts = ["a b c d e f g", "A  b c\nd e f g", "a b c d e f g", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert copies_of(df) == [(0, 0), (1, 0), (2, 0), (3, 3)]
