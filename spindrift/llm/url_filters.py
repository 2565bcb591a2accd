"""URL filters in columns alone: expressions of each URL, met with rules on short hash prefixes.

A rule is a host and a beginning of a path. Each URL is expanded into its host suffixes joined with the beginnings
of its path; only numbers of labels and lengths of paths that some rule has are taken, since no other expression
can meet a rule. Expressions and rules meet by an equi-join on the first bytes of their SHA-256 digests, full
digests confirm, and of the rules that fit the longest wins.

A verdict depends on host and path alone, so equal URLs are counted first and judged once, and verdicts go back to
the rows by a join that deals hot URLs to many parts. Rules are broadcast when they have been counted and measured as few;
else they are joined by a shuffle in which hot expressions are dealt to many parts too.

Defined cases: a null URL, or one without `://`, has an empty host and path; an empty host is a host like others; a
port or user name is part of the host; a URL that no rule fits gets the default verdict and a null rule; of rules
that fit, the one with more characters in host and path wins, of equals the one with the longer host; of one rule with several verdicts
the one that is first in the alphabet; rules with a null host, path or verdict are left out; without rules every URL gets the
default; repeated rows stay repeated; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, join_hot, join_salted, lowered, stored

#: Hexadecimal digits of the digest that rules and expressions meet on, and bytes of rules that may be broadcast.
PREFIX, FEW_BYTES = 8, 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first `://` up to `/`, `?`, `#` or the end, lower-cased; path: from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return lowered(host), path


def digest(host: Column, path: Column) -> Column:
    """SHA-256 of a host and a beginning of a path, told apart by the host's length."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path).cast("binary"), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """(prefix, found): one row for each hash prefix with all its rules, as an array of (digest, size, host_size, rule, verdict)."""
    host, path = lowered(F.col("host")), F.col("path")
    # the least verdict of a rule that is given twice
    known = rules.dropna(subset=["host", "path", "verdict"]).groupBy(host.alias("host"), path.alias("path")).agg(F.min("verdict").alias("verdict"))
    full = digest(F.col("host"), F.col("path"))
    one = F.struct(full.alias("digest"), F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    return known.groupBy(F.left(full, F.lit(PREFIX)).alias("prefix")).agg(F.collect_list(one).alias("found"))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Digests of the host's suffixes of so many labels with the path's beginnings of so many characters."""
    n = F.size(F.split(host, r"\."))
    each = [F.when((n >= k) & (F.length(path) >= m), digest(F.substring_index(host, ".", -k), F.left(path, F.lit(m)))) for k in labels for m in lengths]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of each page (all, if none are named) with host, path, rule and verdict.

    rules: (host, path, verdict). Columns of pages that are kept must not have the new columns' names.
    """
    kept = pages.columns if keep is None else keep
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    key = F.unhex(digest(F.col("host"), F.col("path")))
    rows = rows.withColumn("__url", key)
    # equal URLs are counted within each task before any shuffle
    urls = stored(rows.groupBy("__url", "host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    shape = rules.dropna(subset=["host", "path", "verdict"]).agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count(F.lit(1)).alias("n"), F.sum(F.length("host") + F.length("path") + F.length("verdict")).alias("size")
    ).first()
    labels, lengths = sorted(shape.labels), sorted(shape.lengths)
    each = urls.select("__url", F.explode(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("full"))
    each = each.withColumn("prefix", F.left("full", F.lit(PREFIX)))
    table = prepared(rules)
    if shape.n <= FEW_ROWS and (shape.size or 0) <= FEW_BYTES:
        met = each.join(F.broadcast(table), "prefix")
    else:
        each, table = stored(each, "url-expressions"), stored(table, "url-rules")
        counts = stored(each.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")), "url-prefixes")
        met = join_salted(each, table, "prefix", counts)
    # the full digest confirms what the prefix proposes
    confirmed = met.select("__url", F.explode(F.filter("found", lambda r: r["digest"] == F.col("full"))).alias("r"))
    best = confirmed.groupBy("__url").agg(F.max(F.struct("r.size", "r.host_size", "r.rule", "r.verdict")).alias("best"))
    verdicts = urls.join(best, "__url", "left").select("__url", "n", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return join_hot(rows, stored(verdicts, "url-verdicts"), "__url", "n").select(*kept, "host", "path", "rule", "verdict")
