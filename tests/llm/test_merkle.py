import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spindrift.llm import merkle
from spindrift.llm.common import lowered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, arity):
    """Root, and for each leaf its siblings level by level as (before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for k, p in enumerate(at):
            run = runs[p // arity]
            paths[k].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
        at, level = [p // arity for p in at], [h(*run) for run in runs]
    return (level[0] if level else None), paths


def brute(rows, arity, forge):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r, h(*[enc(r[c]) for c in FIELDS])))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by_lang[x].sort(key=lambda p: (p[0]["doc_id"] is not None, p[0]["doc_id"] or 0, p[1]))
    trees = [tree([d for _, d in by_lang[x]], arity) for x in langs]
    root, upper = tree([t[0] for t in trees], arity)
    out = []
    for x, (subroot, paths), above in zip(langs, trees, upper, strict=True):
        for (r, leaf), path in zip(by_lang[x], paths, strict=True):
            whole = path + above
            d = h(*[enc(forge(r) if c == "text" else r[c]) for c in FIELDS])
            for before, after in whole:
                d = h(before, d, after)
            out.append((r["doc_id"], leaf, subroot, root, h(*[b + a for b, a in whole]), d, d == root))
    return out


def forge(r):
    bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]) if bad else r["text"]


def manifest(df, arity):
    fields = [F.col(c) for c in FIELDS]
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(df, "doc_id", "lang", fields, [*fields[:4], forged], arity)


def key(t):
    return tuple(str(x) for x in t)


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_messy_rows_against_brute_force(messy, arity):
    rows = [r.asDict() for r in messy.select(*FIELDS).collect()]
    found = [tuple(r) for r in manifest(messy, arity).collect()]
    assert sorted(found, key=key) == sorted(brute(rows, arity, forge), key=key)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8], [9, 1], [64, 65, 7], [3] * 20])
def test_tree_shapes(spark, sizes):
    rng, rows = random.Random(len(sizes)), []
    for g, n in enumerate(sizes):
        rows += [{"doc_id": rng.randint(-50, 10**9), "source": None, "lang": f"l{g:02d}" if g else None, "n_chars": i, "text": rng.choice(["Ab", "é", ""])} for i in range(n)]
    df = spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted([tuple(r) for r in manifest(df, 8).collect()], key=key) == sorted(brute(rows, 8, forge), key=key)


def test_empty_table(empty):
    out = manifest(empty, 8)
    assert out.count() == 0
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
