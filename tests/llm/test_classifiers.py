import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import html_text, language_id, quality, toxicity
from spindrift.llm.common import crc_bucket


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").persist()


def test_crc_bucket(spark):
    import zlib

    rows = spark.createDataFrame([(7,), (123456,)], "doc_id long").select("doc_id", crc_bucket("doc_id", 4).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows)


def test_language_held_out(spark, messy, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").drop("source", "n_chars")
    model = language_id.train(docs.where(crc_bucket("doc_id", 4) != 2))
    got = language_id.predict(docs, model).join(docs, "doc_id").where(crc_bucket("doc_id", 4) == 2).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    rows = {r.doc_id: r for r in language_id.predict(messy, model).collect()}
    assert rows[1000].lang_pred == rows[1001].lang_pred == "und" and rows[1000].score == 0
    assert language_id.predict(messy, model).count() == messy.count()
    assert language_id.predict(empty, model).count() == 0
    none = language_id.train(empty)
    assert none is None and {r.lang_pred for r in language_id.predict(messy.limit(5), none).collect()} == {"und"}
    assert language_id.train(messy.where("lang is null")) is None


def test_language_kernel_is_that_of_sets():
    a, b = "The  cat, sat!", "the hat sat"

    def spectrum(t):
        raw = language_id.letters(t).tobytes()
        return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}

    model = language_id.fit([("x", language_id.spectrum(a)), ("y", language_id.spectrum(b))])
    both = len(spectrum(a) & spectrum(b)) / np.sqrt(len(spectrum(a)) * len(spectrum(b)))
    presence = np.isin(model.codes, language_id.spectrum(a)).astype(np.float32)[None]
    k = language_id.kernel(presence, np.array([len(spectrum(a))]), model.spectra)[0]
    assert np.allclose(sorted(k), sorted([1, both]), atol=1e-6)


def test_runs_that_no_landmark_has_count_in_the_norm(spark):
    """Scores of the whole path against kernels of sets, for texts with runs that the model has never seen."""
    rng = np.random.default_rng(1)
    texts = [("x" if i % 2 else "y", " ".join("".join(rng.choice(list("abcdef" if i % 2 else "efghij"), 4)) for _ in range(6))) for i in range(12)]
    model = language_id.fit([(lang, language_id.spectrum(t)) for lang, t in texts])
    new = ["abcd qqqq zzzz wxyw", "ghij hhhh", "qqqq"]
    rows = language_id.predict(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), model).collect()
    chosen = [t for x in "xy" for lang, t in texts if lang == x]
    for r in rows:
        s = set(language_id.spectrum(new[r.doc_id]).tolist())
        k = np.array([len(s & set(language_id.spectrum(t).tolist())) / np.sqrt(len(s) * len(language_id.spectrum(t))) for t in chosen])
        out = np.maximum(k @ model.weights, 0)
        assert r.lang_pred == model.languages[int((k @ model.weights).argmax())]
        assert np.isclose(r.score, out.max() / max(out.sum(), 1e-9), atol=1e-4)


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = order[label == 1]
    return (pos.sum() - len(pos) * (len(pos) - 1) / 2) / (len(pos) * (label == 0).sum())


def test_quality_held_out(labelled, messy, empty):
    net = quality.train(labelled, labelled.where(crc_bucket("doc_id", 4) != 2), "quality")
    test = labelled.where(crc_bucket("doc_id", 4) == 2)
    got = quality.predict(test, net).join(test.select("doc_id", "quality"), "doc_id").collect()
    assert auc(np.array([r.score for r in got]), np.array([r.quality for r in got])) > 0.9
    scores = [r.score for r in quality.predict(messy, net).collect()]
    assert len(scores) == messy.count() and all(0 <= s <= 1 for s in scores)
    assert quality.predict(empty, net).count() == 0
    one = quality.train(labelled, labelled.where("quality = 1"), "quality")
    assert {r.score for r in quality.predict(messy.limit(3), one).collect()} == {0.5}


def test_quality_scoring_is_the_network():
    net = quality.Network(3)
    scorer = quality.Scorer(net.p, net.tables())
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 31, 32, 33, 256, 257, 480, 481, 700, 5000):
        raw = rng.bytes(n)
        chunks = np.stack([quality.chunk_at(raw, s) for s in quality.chunk_starts(n)]).astype(int)
        hidden = []
        for s, c in zip(quality.chunk_starts(n), chunks, strict=True):
            e = net.p["embed"][c]
            outs = [e[i : i + quality.WIDTH].ravel() @ net.p["filters"] for i in range(min(quality.CHUNK, n - s))]
            pooled = (np.max(outs, axis=0) if outs else np.full(quality.FILTERS, -1e9)) + net.p["bias"]
            hidden.append(np.maximum(np.maximum(pooled, 0) @ net.p["hidden"] + net.p["hidden_bias"], 0))
        z = np.concatenate([np.max(hidden, axis=0), np.mean(hidden, axis=0)]) @ net.p["out"] + net.p["out_bias"][0]
        assert abs(scorer.score(raw) - 1 / (1 + np.exp(-z))) < 1e-4


def test_quality_gradients():
    net = quality.Network(5)
    rng = np.random.default_rng(2)
    chunks = rng.integers(0, 256, (5, quality.CHUNK + quality.WIDTH - 1))
    doc, label = np.array([0, 0, 1, 1, 1]), np.array([0.0, 1.0], np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    g = net.step(chunks, doc, label)

    def loss():
        e = net.p["embed"][chunks]
        w = np.lib.stride_tricks.sliding_window_view(e, quality.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(5, quality.CHUNK, -1)
        act = np.maximum((w @ net.p["filters"] + net.p["bias"]).max(axis=1), 0)
        h = np.maximum(act @ net.p["hidden"] + net.p["hidden_bias"], 0)
        z = np.stack([np.r_[h[doc == d].max(axis=0), h[doc == d].mean(axis=0)] for d in (0, 1)])
        p = 1 / (1 + np.exp(-(z @ net.p["out"] + net.p["out_bias"])))
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for name in ("out", "hidden", "hidden_bias", "bias", "filters"):
        flat = net.p[name].reshape(-1)
        for i in rng.choice(flat.size, 4):
            old, e = flat[i], 1e-5
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - g[name].reshape(-1)[i]) < 2e-3


def test_toxicity_held_out(labelled, messy, empty):
    model = toxicity.train(labelled, labelled.where(crc_bucket("doc_id", 5) != 0), "toxic")
    test = labelled.where(crc_bucket("doc_id", 5) == 0)
    got = toxicity.predict(test, model).join(test.select("doc_id", "toxic"), "doc_id").collect()
    label, score = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    assert auc(score, label) > 0.8 and (score[label == 0] < 0.5).mean() > 0.95
    scorer = toxicity.Scorer(model)
    plain, gaps, inserted, clean = scorer.scores(["the idiot was", "the i-d-i o t was", "the worthlxess was", "the nation was"])
    assert plain > 0.5 and gaps > 0.5 and inserted > clean and clean < 0.5
    scores = [r.score for r in toxicity.predict(messy, model).collect()]
    assert len(scores) == messy.count() and all(0 <= s <= 1 for s in scores)
    left = toxicity.drop_toxic(messy, model)
    assert left.columns == messy.columns
    assert toxicity.predict(empty, model).count() == 0
    assert toxicity.train(labelled, labelled.where("toxic = 1"), "toxic") == 1.0 and toxicity.train(labelled, labelled.limit(0), "toxic") == 0.0


def test_toxicity_where_all_texts_share_words(spark):
    """Rows that share their commonest words are no copies of each other; one hit by chance in a long text is no insult."""
    rng = np.random.default_rng(5)
    parts = ["ba", "do", "fi", "gu", "ke", "lo", "mi", "nu", "pa", "re", "si", "tu"]
    plain = ["".join(rng.choice(parts, 3)) for _ in range(400)]
    insults = [f"zwexq{x}" for x in parts]

    def row(i):
        toxic = i % 4 == 0
        words = [*plain[:60], *rng.choice(plain, 60 if toxic else 500)]
        words += list(rng.choice(insults, 5 if toxic else int(i % 3 == 0), replace=False))
        return i, " ".join(rng.permutation(words)), int(toxic)

    docs = spark.createDataFrame([row(i) for i in range(400)], "doc_id long, text string, toxic int").persist()
    model = toxicity.train(docs, docs.where("doc_id < 300"), "toxic")
    left = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert left == {i for i in range(400) if i % 4}
    copies = ["one two three four five six", "One  two three four five six\n"]
    assert len({toxicity.sketch(t) for t in copies}) == 1
    assert len({toxicity.sketch(" ".join(rng.permutation(plain))) for _ in range(50)}) == 50


def test_subsequence_kernel():
    words = ["idiot", "aaaa", "x" * 40]
    word, feature, weight, own = toxicity.triples(words)
    for k, w in enumerate(words):
        text = "\2" + w + "\3"
        plain = {}
        for i in range(len(text)):
            for a in range(i + 1, len(text)):
                for b in range(a + 1, min(len(text), i + toxicity.SPAN)):
                    key = (text[i], text[a], text[b])
                    plain[key] = plain.get(key, 0) + toxicity.DECAY ** (b - i - 2)
        assert np.isclose(own[k], sum(v * v for v in plain.values()))
        assert np.isclose(weight[word == k].sum(), sum(plain.values()))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><a href=x>Home</a></header><nav><a>a</a> <a>b</a></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it better for all of you who come here often.</p></div>
<main><article><header><h1>The Title &amp; more</h1></header><p>First para with <a href=y>a link</a> and
 text&nbsp;here.</p><div class="ad">Buy now this great thing today it is cheap.</div><p>x</p><blockquote>Quoted words here.</blockquote><ul><li>One item</li><li>Two</li></ul><form><p>Sign up</p><input></form>
<script>if (a<b) document.write("<p>no</p>")</script><!-- <p>hidden</p> --><p>a < b and <b>c<br>d</p></article><aside><p>Related thing one with many many words to look like content here.</p></aside></main>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this article a lot and want to write many words on it now.</p></div></section>
<footer>&copy; 2020</footer></body><p"""


def test_page():
    want = "The Title & more\nFirst para with a link and text here.\nx\nQuoted words here.\nOne item\nTwo\na < b and c d"
    assert html_text.main_text(PAGE, html_text.tree()) == want
    assert html_text.main_text(None, html_text.tree()) == html_text.main_text("<nav><p>x", html_text.tree()) == ""


def test_tree_fits_its_table():
    root = html_text.tree()
    assert np.mean([html_text.decide(root, list(x)) == y for x, y in html_text.LABELLED]) > 0.95


def test_pages_without_article():
    root = html_text.tree()
    text = lambda page: html_text.main_text(page, root)
    assert text("<div class='c1'><p>Hello there.</p></div>") == "Hello there."
    assert text("Only some words, without any tag.") == "Only some words, without any tag."
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Topic {k}</a></li>" for k in range(6)) + "</ul>"
    body = ["A long paragraph " + "about many things " * 12, "Another one " + "with more of them " * 15, "The last one " + "ends the page " * 11]
    page = f"<body>{menu}<div>" + "".join(f"<p>{x} <a href='/x'>more</a></p>" for x in body) + f"</div>{menu}</body>"
    assert text(page) == "\n".join(" ".join(f"{x} more".split()) for x in body)
    features = set()

    def walk(node):
        if node.feature >= 0:
            features.add(node.feature)
            walk(node.low)
            walk(node.high)

    walk(root)
    # the link density of a block or of its neighbours takes part
    assert features & {1, 3, 5} and features & {0, 2, 4}


def test_blocks_of_furniture_and_links():
    found = html_text.blocks("<p>one <span class='ad'>buy <span>now</span></span> two</p><p class='notice'>old<p>new <a href=x>lin<div>ked</div></a> free")
    assert [(b.text, b.named, b.linked) for b in found] == [("buy now", 1, 0), ("one two", 0, 0), ("old", 1, 0), ("new lin", 0, 1), ("ked", 0, 1), ("free", 0, 0)]
    found = html_text.blocks("<div><a href=x>menu</div><p>text")
    assert [(b.text, b.linked) for b in found] == [("menu", 1), ("text", 0)]


@pytest.mark.parametrize("mark", ["class='ad-free-notes'", "class='tags-explained'", "class='social-science'", "id='meta-analysis'", "id='comments-on-method'", "class='lead banner-of-hope'"])
def test_names_that_are_not_furniture(mark):
    page = f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><div {mark}><p>Some words of the article.</p><p>And a <label>few</label> more.</p></div></article>"
    assert html_text.main_text(page, html_text.tree()) == "Title\nSome words of the article.\nAnd a few more."


@pytest.mark.parametrize("mark", ["class='ad'", "class='cookie-notice'", "id='commentsList'", "class='big sidebar-left'", "class='promo_box2'"])
def test_names_of_furniture(mark):
    body = "<p>" + "Words of the article. " * 20 + "</p>"
    page = f"<article><h1>Title</h1>{body}<div {mark}><p>Buy this thing now, it is cheap.</p></div>{body}</article><div {mark}><p>{'All of you may buy it. ' * 20}</p></div>"
    text = html_text.main_text(page, html_text.tree())
    assert "buy" not in text.lower() and text.count("article") == 40
    # a named box of many words without links is text inside an article
    assert html_text.main_text(f"<article>{body}<div {mark}>{body}</div></article>", html_text.tree()).count("article") == 40


def test_pages_without_marks(spark, sf):
    """The given pages with neither classes nor elements that say what they hold: words and links alone decide."""
    import re
    from collections import Counter

    kept = wrong = total = 0
    root = html_text.tree()
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        want = html_text.main_text(r.html, root).split("\n")
        bare = re.sub(r"<(/?)(?:article|nav|footer|main|header|aside)\b[^>]*>", r"<\1div>", re.sub(r"<(\w+)[^>]*?(?: class| id| role)=[^>]*>", r"<\1>", r.html))
        got = html_text.main_text(bare, root).split("\n")
        same = (Counter(want) & Counter(got)).total()
        total, kept, wrong = total + len(want), kept + same, wrong + len(got) - same
    assert kept / total > 0.97 and kept / (kept + wrong) > 0.8


def test_broken_pages_take_linear_time():
    import time

    began = time.process_time()
    for page in ("<span class='ad'>x" * 40_000, "<p class='notice'>x" * 40_000, "<div><span>x</nav></p>" * 40_000, "<a href=x>y<div>" * 40_000):
        html_text.blocks(page)
    assert time.process_time() - began < 20


def test_pages_table(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inside = r.html.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside))
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_messy_pages(spark):
    rows = [(1, "u", None), (None, None, "<p>" + "word " * 50), (2, "v", ""), (2, "v", ""), (3, None, "< <> </ <p <div class=\"x><p>t"), (4, "w", "<p>" * 5000 + "deep"), (5, "w", "<a " + "b='" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = html_text.extract(df).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id is None] == [" ".join(["word"] * 50)]
    assert html_text.extract(df.limit(0)).count() == 0
