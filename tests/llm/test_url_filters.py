import random

import pytest
from pyspark.sql import functions as F

from spindrift.llm import url_filters

RULES = "host string, path string, verdict string"


def parted(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return host, rest[:end]


def brute(url, rules):
    host, path = parted(url)
    fit = [(len(h + p), len(h), h + p) for h, p, _ in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    if not fit:
        return host, path, None, "allow"
    rule = max(fit)
    return host, path, rule[2], min(v for h, p, v in rules if (h + p, len(h)) == (rule[2], rule[1]))


URLS = [
    None, "", "no scheme", "http://", "http:///x", "http://a.net", "http://a.net/", "http://A.NET/B?c#d", "http://net/en/", "ftp://example.net/en/x", "http://example.net/EN/x", "x://y://net/",
    "http://sub.example.net?x/en/", "http://sub.example.net#/en/", "http://notexample.net/en/", "http://a.example.net/en", "http://a.b.c.example.net/en/1", "http://a.org/fr/", "http://a.org:80/fr/",
    "http://user@a.org/fr/", "http://a.org./fr/", "http://ÄÖ.org/fr/Ü?ß", "http://a.org/fr/\nx", " http://a.org/fr/", "http://" + "a." * 3000 + "net/" + "x" * 5000, "http://.net/", "http://a..net/",
]


def test_production_rules(spark):
    from spindrift.llm.queries import URL_RULES

    df = spark.createDataFrame([(i % 20, u, "x", "y") for i, u in enumerate(URLS + URLS)], "page_id long, url string, prefix string, full string")
    rules = spark.createDataFrame(URL_RULES, RULES)
    found = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, rules, keep=["page_id"]).collect()), key=str)
    assert found == sorted(((i % 20, *brute(u, URL_RULES)) for i, u in enumerate(URLS + URLS)), key=str)


@pytest.mark.parametrize("few", [True, False])
def test_random_rules_against_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(url_filters, "FEW_BYTES", 0)
    monkeypatch.setattr(url_filters, "PREFIX", 1)  # prefixes meet by chance often, full digests must tell
    rng = random.Random(7)
    host = lambda: ".".join(rng.choice(["a", "b", "aa", "A", ""]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "x", "/x", "y/"]) for _ in range(rng.randint(0, 4)))
    rules = [(host().lower(), path(), rng.choice(["block", "allow"])) for _ in range(60)]
    urls = [f"http://{host()}{rng.choice(['', '/'])}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(300)] + ["http://a.b/x"] * 200
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    null = [(None, "/", "block"), ("a", None, "block"), ("a", "/", None)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, spark.createDataFrame(rules + null, RULES)).collect()}
    for i, u in enumerate(urls):
        assert got[i] == brute(u, rules), u


def test_no_rules_no_rows_and_no_python(spark):
    none = spark.createDataFrame([], RULES)
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_filters.judge(df, none, keep=["page_id"], default="block").collect()] == [(1, "a", "/b", None, "block")]
    rules = spark.range(1).select(F.lit("a").alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    assert url_filters.judge(df.limit(0), rules).count() == 0
    plan = url_filters.judge(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
