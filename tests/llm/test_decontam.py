import numpy as np

from spindrift.llm import decontam


def plain_tiling(doc, item, least):
    """Greedy string tiling as first published: scan all pairs of places for the longest unmarked match, again and again."""
    marked_doc, marked_item, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in marked_doc and q + n not in marked_item:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < least:
            return total
        n, p, q = best
        marked_doc.update(range(p, p + n))
        marked_item.update(range(q, q + n))
        total += n


def test_tiling_by_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(60):
        item = [f"w{x}" for x in rng.integers(0, 30, rng.integers(5, 25))]
        filler = [f"w{x}" for x in rng.integers(0, 40, 20)]
        cut = int(rng.integers(0, len(item)))
        doc = filler + item[cut:] + filler[:5] + item[:cut] + filler
        m = decontam.Matcher([(trial, " ".join(item))], threshold=1e-9)
        got = m.find(" ".join(doc))
        assert (got[0][3] if got else 0) == plain_tiling(doc, item, 5)


def test_repetitive_texts_by_brute_force():
    rng = np.random.default_rng(5)
    for trial in range(60):
        item = [f"w{x}" for x in rng.integers(0, 2 + trial % 3, rng.integers(5, 18))]
        doc = [f"w{x}" for x in rng.integers(0, 3 + trial % 2, rng.integers(5, 40))]
        got = decontam.Matcher([(trial, " ".join(item))], threshold=1e-9).find(" ".join(doc))
        lengths = sorted(n for n in (got[0][3] if got else 0, plain_tiling(doc, item, 5)))
        # of matches of equal length either may come first, which may leave other words for the next
        assert lengths[0] == lengths[1] or lengths[1] - lengths[0] < 5


def test_one_word_very_often_is_quick():
    import time

    m = decontam.Matcher([(1, "ha " * 300)])
    began = time.process_time()
    assert m.find("ha " * 60_000) == [(1, 1.0, 1, 300, 300)]
    assert time.process_time() - began < 20


def test_items_too_short_for_a_seed():
    m = decontam.Matcher([(1, "so short"), (2, "..."), (3, "one two three four five six")])
    assert m.find("So, short!") == [(1, 1.0, 1, 2, 2)]
    # the item counts inside a longer text too, wherever its words stand together
    assert m.find("this is so short a text that it has the item") == [(1, 1.0, 1, 2, 2)] == m.find("it is so, short")
    assert not m.find("so it is short") and not m.find("so") and not m.find("...") and not m.find("")
    assert sorted(m.find("so short one two three four five six so short")) == [(1, 1.0, 1, 2, 2), (3, 1.0, 1, 6, 6)]


def test_reordered_and_changed_passages():
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly boil fresh green tea at dawn"
    m = decontam.Matcher([(1, item)])
    first, second = item.split(" while ")
    assert m.find(f"Before. {second.upper()}, and then: the quick -- brown fox jumps over the lazy dog while!")[0][0] == 1
    assert m.find("a " + item.replace("wizards", "witches") + " z")
    assert not m.find("the quick brown fox jumps over the lazy dog and then nothing else that matters")
    assert not m.find(None) and not m.find("")


def test_messy_rows_and_blocks(spark, messy, empty):
    items = [(k, f"item {k} has these words in this very order and number {k} again") for k in range(12)] + [(None, None), (50, "too short"), (51, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    leak = spark.createDataFrame([(9000 + k, f"x y {items[k][1]} z") for k in (2, 7)] + [(9100, None)], "doc_id long, text string")
    df = messy.unionByName(leak, allowMissingColumns=True)
    for block_words in (decontam.BLOCK_WORDS, 20):
        got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, block_words=block_words).collect()}
        assert got == {(9002, 2), (9007, 7)}
        left = decontam.drop_contaminated(df, bench, block_words=block_words)
        assert left.columns == df.columns and left.count() == df.count() - 2
        assert decontam.contaminated(empty, bench, block_words=block_words).count() == 0
    none = bench.limit(0)
    assert decontam.contaminated(df, none).count() == 0 and decontam.contaminated(empty, bench).count() == 0
    assert decontam.drop_contaminated(df, none).count() == df.count()


def test_large_benchmarks_are_joined(spark):
    """The join of seeds finds what the pass with all items finds, with hot items, hot texts, repeats and short items."""
    rng = np.random.default_rng(8)
    text = lambda n, most=300: " ".join(f"w{x}" for x in rng.integers(0, most, n))
    items = [(k, text(int(rng.integers(5, 40)))) for k in range(60)] + [(60, "w1 w2 w3 w4 w5 w6 w7"), (60, "w1 w2 w3 w4 w5 w6 w7"), (None, text(12)), (61, "w1 w2"), (62, "w3"), (63, "..."), (64, "ha " * 40)]
    docs = []
    for k in range(150):
        parts = [text(30)]
        for i in rng.integers(0, 60, 3):
            ws = items[i][1].split()
            cut = int(rng.integers(0, len(ws)))
            parts += [" ".join(ws[cut:]), text(6), " ".join(ws[: max(cut - int(rng.integers(0, 6)), 0)])]
        docs.append((k, " ".join(parts)))
    docs += [(1000 + k, f"{text(0)} w1 w2 w3 w4 w5 w6 w7 {items[k % 3][1]}") for k in range(100)] + [(5, docs[5][1]), (None, docs[6][1]), (2000, "ha " * 3000), (2001, None), (2002, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, joined = (sorted(map(str, decontam.contaminated(df, bench, block_words=n).collect())) for n in (decontam.BLOCK_WORDS, 1))
    assert len(whole) > 500 and whole == joined
    left = [sorted(map(str, decontam.drop_contaminated(df, bench.where("item_id < 60"), block_words=n).collect())) for n in (decontam.BLOCK_WORDS, 1)]
    assert left[0] == left[1] and 0 < len(left[0]) < len(docs)


def test_documents_table(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    items = [(r.item_id, b" ".join(decontam.words(r.text))) for r in bench.collect()]
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items if b" " + t + b" " in b" " + b" ".join(decontam.words(r.text)) + b" "}
    assert whole and whole <= got
