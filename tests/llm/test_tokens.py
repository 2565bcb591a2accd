import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import common, packing, token_counts, token_store, tokens


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False)


def test_cached_encoding_is_the_librarys(library, messy_texts):
    small = tokens.Encoder(tokens.default_path(), cache_pieces=64)
    texts = [*messy_texts, "a <|endoftext|>b", "<|endoftext|>", "x" * 40 + " " + "é" * 30, "'s", "a's b'", "''ll 'll'll", "\n 's\n\n", "don't we'RE 're've x'v'dé", "\uffff a", "a \U0001f600b"]
    for text, got in zip(texts, tokens.Encoder(tokens.default_path()).encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library(text).ids, text
    for text in texts:
        want = library(text)
        assert np.frombuffer(small.encode(text), "<u4").tolist() == want.ids
        ids, first, end = small.encode_spans(text)
        assert ids.tolist() == want.ids
        assert list(zip(first.tolist(), end.tolist(), strict=True)) == want.offsets


def test_random_texts_by_the_library(library):
    rng = np.random.default_rng(12)
    bits = ["'", "s", "re", "ll", "ve", "v", "L", " ", "  ", "\n", "\t", "1", "23", ".", "!?", "é", "ñandú", "дом", "한국", "the", "Hello", "x" * 17, "_", "—", "\r\n"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(4000)]
    for text, got in zip(texts, tokens.Encoder(tokens.default_path()).encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library(text).ids, text


def ids_of(library, text, end):
    return np.array([*library(text).ids, end], "<u4")


def test_packing_covers_every_id_once(spark, messy, library):
    rows = packing.pack_documents(messy.repartition(2), with_ids=True).collect()
    want = Counter((r.doc_id, ids_of(library, r.text, 1).tobytes()) for r in messy.collect())
    by_sequence = defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
        by_sequence[r.sequence_id].append(r)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    unfilled = [s for s, held in by_sequence.items() if sum(r.length for r in held) < packing.WINDOW]
    assert len(unfilled) <= 2
    for doc, whole in want:
        have = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == doc and r.doc_tokens * 4 == len(whole))
        if want[(doc, whole)] == 1 and len([1 for d, w in want if d == doc]) == 1:
            assert b"".join(x for _, x in have) == whole
    assert sum(r.length for r in rows) == sum(len(w) // 4 * n for (_, w), n in want.items())


def test_sum_of_squares_chooses_the_least(monkeypatch):
    rng = np.random.default_rng(3)
    packer = packing.SumOfSquares(window=12)
    for size in rng.integers(1, 12, 400).tolist():
        n = packer.count[:12].copy()
        n[0] = 0

        def total(h, n=n, size=size):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < 12:
                m[h + size] += 1
            return int((m**2).sum())

        options = [h for h in range(12 - size + 1) if h == 0 or n[h]]
        assert total(packer.level_for(size)) == min(map(total, options))
        packer.add(0, bytes(4 * size))


def test_consolidation_bounds_open_windows():
    packer = packing.SumOfSquares(window=100, max_open=20)
    for i in range(500):
        packer.add(i, bytes(4 * 70))
        assert packer.open <= 21
    packer.finish()
    assert sum(len(p[2]) for w in packer.closed for p in w) == 500 * 280
    assert sum(sum(len(p[2]) for p in w) < 400 for w in packer.closed) <= 1


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_by_brute_force(spark, messy_texts, library, rule):
    df = spark.createDataFrame(list(enumerate(messy_texts)), "doc_id long, text string")
    got = {(r.doc_id, r.section): r for r in token_counts.section_token_counts(df, rule=rule).collect()}
    for doc, text in enumerate(messy_texts):
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + [lines[-1]] * (lines[-1] != "" or len(lines) == 1)
        owner = [i for i, x in enumerate(lines) for _ in x]
        counts, crossing = Counter(), Counter()
        for a, b in library(text).offsets:
            chars = Counter(owner[a:b])
            most = min(chars, key=lambda s: (-chars[s], s))
            counts[owner[a] if rule == "start" else owner[b - 1] if rule == "end" else most] += 1
            if len(chars) > 1:
                crossing.update(chars.keys())
        for i, x in enumerate(lines):
            r = got.pop((doc, i))
            assert (r.n_tokens, r.n_crossing, r.char_end - r.char_start) == (counts[i], crossing[i], len(x))
    assert not got


def test_sections_of_fields_and_messy_rows(messy, empty):
    rows = token_counts.section_token_counts(messy, fields=("lang", "text", "source")).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc in (3, 1000, 1002, 1003):
        assert sum(r.n_tokens for r in by_doc[doc]) == by_doc[doc][0].doc_tokens
        assert {r.field for r in by_doc[doc]} == {"lang", "text", "source"}
    assert token_counts.section_token_counts(empty).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_token_counts(empty, rule="none")


def test_store_round_trip(spark, messy, library, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(messy, path)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, path).collect())
    want = Counter()
    total = 0
    for r in messy.collect():
        ids = ids_of(library, r.text, 2)
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
        total += len(ids)
    assert Counter((i if known else None, n, crc) for known, i, _, n, crc in got) == want
    at = 0
    for _, _, start, n, _ in sorted(got, key=lambda x: x[2]):
        assert start == at
        at += n
    assert at == total
    assert [x[:2] for x in sorted(got, key=lambda x: x[2])] == [x[:2] for x in got]
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 0")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_finds_damage(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(i, f"text number {i} " * 300) for i in range(20)], "doc_id long, text string")
    token_store.write_store(df, path)
    objects = spark.read.parquet(f"{path}/objects").collect()
    i = next(k for k, r in enumerate(objects) if r.kind == 0)
    rows = [r.asDict() for r in objects]
    rows[i]["payload"] = rows[i]["payload"][:-2] + b"\7\7"
    spark.createDataFrame(rows, spark.read.parquet(f"{path}/objects").schema).write.mode("overwrite").parquet(f"{path}/objects")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_store(spark, path).collect()


def test_join_of_hot_keys(spark):
    """Every row once and with its match, though one key has two thirds of the rows; keys without a match stay."""
    keys = ["hot"] * 600 + [f"k{i % 50}" for i in range(300)] + [None] * 5
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i int")
    right = spark.createDataFrame([("hot", 7)] + [(f"k{i}", i) for i in range(40)], "key string, value int")
    counts = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = sorted(map(tuple, common.join_salted(left, right, "key", counts).select("i", "key", "value").collect()))
    assert got == [(i, k, 7 if k == "hot" else int(k[1:]) if k and int(k[1:]) < 40 else None) for i, k in enumerate(keys)]


def test_store_of_one_chunk_in_most_documents(spark, library, tmp_path):
    df = spark.createDataFrame([(i, "" if i % 3 else f"text {i}") for i in range(300)], "doc_id long, text string")
    token_store.write_store(df, str(tmp_path / "store"))
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, str(tmp_path / "store")).collect())
    start, want = 0, []
    for i in range(300):
        ids = np.array([*library("" if i % 3 else f"text {i}").ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_store_of_nothing(spark, empty, tmp_path):
    token_store.write_store(empty, str(tmp_path / "store"))
    assert token_store.read_store(spark, str(tmp_path / "store")).count() == 0


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 50_000, 20_000)
    a = np.concatenate([rng.integers(0, 50_000, 700), shared]).astype("<u4")
    b = np.concatenate([rng.integers(0, 50_000, 1300), shared]).astype("<u4")

    def digests(x):
        (ends,) = token_store.cuts(x)
        assert ends[-1] == len(x) and all(q - p <= token_store.MOST for p, q in zip([0, *ends], ends, strict=False))
        return {x[p:q].tobytes() for p, q in zip([0, *ends[:-1]], ends, strict=True)}

    assert len(digests(a) & digests(b)) > 25


def test_streams_are_cut_as_if_alone():
    rng = np.random.default_rng(4)
    streams = [rng.integers(0, 50_000, n).astype("<u4") for n in (1, 5000, 3, 20_000, 128, 129, 900)]
    stops = np.cumsum([len(x) for x in streams]).tolist()
    together = token_store.cuts(np.concatenate(streams), stops)
    assert together == [[stop - len(x) + e for e in token_store.cuts(x)[0]] for x, stop in zip(streams, stops, strict=True)]


def test_part_roots_by_brute_force(spark, monkeypatch):
    import hashlib

    from pyspark.sql import functions as F

    monkeypatch.setattr(token_store, "FANOUT", 3)
    recipes = spark.range(40).select((F.col("id") % 3).cast("int").alias("part"), F.floor(F.col("id") / 3).alias("place"), F.lit(2).cast("long").alias("n_tokens"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("root"))
    got = {r.part: (r.n_docs, r.n_tokens, r.root) for r in token_store.part_roots(recipes).collect()}
    for part in range(3):
        level = [hashlib.sha256(str(i).encode()).digest() for i in range(part, 40, 3)]
        n = len(level)
        for _ in range(3):
            level = [hashlib.sha256(b"\2" + b"".join(level[i : i + 3])).digest() for i in range(0, len(level), 3)]
        assert len(level) == 1 and got[part] == (n, 2 * n, level[0].hex())


def test_crc_shift():
    rng = np.random.default_rng(2)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 3000, 12)]
    after = [sum(map(len, parts[i + 1 :])) for i in range(12)]
    got = token_store.shifted_crc(np.array([zlib.crc32(p) for p in parts]), np.array(after))
    assert int(np.bitwise_xor.reduce(got)) == zlib.crc32(b"".join(parts))
