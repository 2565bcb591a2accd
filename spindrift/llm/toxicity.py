"""Toxicity by a subsequence string-kernel support vector machine.

The kernel of two strings counts the triples of characters that both have in order, gaps allowed: a triple
that spans s characters (SPAN at most) weighs DECAY**(s-3), and kernels are divided by the root of the
strings' own. So an insult with gaps or inserted characters stays near the insult. Strings are the words of
a sentence, bare of all but letters and digits, between markers; letters that stand apart ("a b c") also
form a word.

Training words come from the labelled sentences of a bounded sample of documents: words that those of toxic
documents use beyond what chance explains (a likelihood ratio over documents, near copies of which, told by
their shingles, count once, at a false discovery rate of DISCOVERY) against words of clean ones. Landmarks of both kinds, taken from
all along the likely words, give the Nyström map, on which a
squared-hinge support vector machine is solved by Newton steps; candidates that it puts among the clean
are dropped and it is solved anew. Since the map is linear in the triples, scoring folds landmarks, whitening
and machine into one weight for each (hashed) triple. A word is a hit by its output of the machine, cut to 0 to 1.
A word like an insult also comes about by chance, above all in long texts, so a document is judged by all its distinct
words: a logistic curve over the number of hits and over their share gives the score, and neither lowers it.

Defined cases: a text that is null or has no word scores as one of clean words; null labels are not learned
from; without labelled rows of both kinds every score is the share of label 1, or 0; repeated rows each give
a row; null ids are carried; an empty table gives an empty table; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .sampling import labelled_sample

#: Documents of each label that are sampled for training; words of each kind; landmarks of each kind.
PER_LABEL, POSITIVE, NEGATIVE, LANDMARKS = 4000, 600, 5000, 256
SPAN, DECAY, FEATURES = 5, 0.6, 1 << 18
PENALTY, LEAST_DOCUMENTS, DISCOVERY = 4.0, 2, 0.1
#: Words longer than this are looked at in overlapping windows.
LONGEST = 32
FLOOR = -3.0
#: Words of the shingles that near copies are told by; words added to a text's own, and the least share of hits that counts.
SHINGLE, MORE_WORDS, LEAST_SHARE = 3, 10, 0.001
CACHE_WORDS = 100_000
#: Words whose triples are laid out at a time (about 3 kB each).
WORDS_AT_ONCE = 1_000
APART = re.compile(r"(?<!\S)\w(?:[\W_]+\w(?!\w)){2,}(?!\w)")
SENTENCE_END = re.compile(r"[.!?\n]+")
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def bare(word: str) -> str:
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def apart(text: str) -> list[str]:
    """Words whose letters stand apart in a lower-cased text."""
    return [w for m in APART.finditer(text) for w in windows(bare(m.group()))]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, weight) of the distinct features of each word, and each word's own kernel."""
    text = "".join("\2" + w + "\3" + "\0" * (SPAN - 1) for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 1 + SPAN for w in words])
    n = len(c) - SPAN + 1
    head = c[:n]
    keys, weights = [], []
    for a, b in OFFSETS:
        y, z = c[a : a + n], c[b : b + n]
        ok = np.flatnonzero((head > 0) & (y > 0) & (z > 0))
        mixed = ((head[ok] * 0x9E3779B1 + y[ok]) * 0x85EBCA77 + z[ok]) * 0xC2B2AE3D & (1 << 62) - 1
        keys.append(owner[ok] * FEATURES + (mixed >> 20) % FEATURES)
        weights.append(np.full(len(ok), DECAY ** (b - 2)))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    distinct, where = np.unique(keys, return_inverse=True)
    weight = np.bincount(where, weights)
    word = distinct // FEATURES
    return word, distinct % FEATURES, weight, np.bincount(word, weight**2, minlength=len(words))


@dataclass
class Model:
    weights: np.ndarray  # of each feature
    bias: float
    curve: np.ndarray  # of the logistic curve: weights of the number and of the share of hits, and its offset

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's output for each word; not-words get FLOOR."""
        word, feature, weight, own = triples(words)
        f = np.bincount(word, weight * self.weights[feature], minlength=len(words)) / np.sqrt(np.maximum(own, 1e-9)) + self.bias
        return np.where([len(w) > 1 for w in words], f, FLOOR)


def features(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the logistic curve sees of texts with so many hits among so many distinct words."""
    return np.stack([np.log1p(hits), np.log(LEAST_SHARE + hits / (words + MORE_WORDS))], axis=1)


class Scorer:
    """Hits of texts, with a bounded cache of those of raw words."""

    def __init__(self, model: Model):
        self.model, self.young, self.old = model, {}, {}

    def learn(self, raw: list[str]) -> None:
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        for k in range(0, len(raw), WORDS_AT_ONCE):
            some = raw[k : k + WORDS_AT_ONCE]
            parts = [windows(bare(w)) for w in some]
            values = self.model.values([p for ps in parts for p in ps])
            first = np.cumsum([0, *[len(p) for p in parts[:-1]]])
            self.young.update(zip(some, np.clip(np.maximum.reduceat(values, first), 0, 1).tolist(), strict=True))

    def hits(self, texts: list[str | None]) -> list[tuple[float, int]]:
        """The hits among the distinct words of each text, and the number of those words."""
        out, todo, missing = [(0.0, 0)] * len(texts), [], set()
        for i, text in enumerate(texts):
            if not text:
                continue
            text = text.lower()
            words = set(text.split())
            spaced = apart(text)
            missing.update(filterfalse(self.young.__contains__, words))
            todo.append((i, words, spaced))
            if len(missing) > 20_000:
                self.settle(out, todo, missing)
                todo, missing = [], set()
        self.settle(out, todo, missing)
        return out

    def settle(self, out: list[tuple[float, int]], todo: list[tuple], missing: set[str]) -> None:
        known = {w: x for w in missing if (x := self.old.get(w)) is not None}
        before = self.young
        self.young.update(known)
        self.learn(list(missing - known.keys()))
        get = self.young.__getitem__ if self.young is before else lambda w: x if (x := self.young.get(w)) is not None else before[w]
        for i, words, spaced in todo:
            # exactly rounded: a score doesn't depend on the order of a set
            values = list(map(get, words))
            if spaced:
                spaced = list(dict.fromkeys(spaced))
                values += np.clip(self.model.values(spaced), 0, 1).tolist()
            out[i] = math.fsum(values), len(values)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        hits, words = np.array(self.hits(texts), float).reshape(-1, 2).T
        *slopes, offset = self.model.curve
        return 1 / (1 + np.exp(-np.clip(features(hits, words) @ np.array(slopes) + offset, -30, 30)))


def sentence_words(text: str) -> set[str]:
    """The words of the sentences of a text."""
    return {p for sentence in SENTENCE_END.split(text.lower()) for w in sentence.split() for p in windows(bare(w)) if len(p) > 1}


def sketch(text: str) -> int:
    """A hash that near copies of a document share as a rule: the least hash of its shingles.

    Words alone don't do: most texts of a language share the commonest ones, and the least hash may be one of theirs.
    """
    words = text.lower().split()
    shingles = {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    return min(int.from_bytes(hashlib.blake2b(w.encode(errors="replace"), digest_size=8).digest(), "little", signed=True) for w in shingles)


def with_insertions(word: str) -> list[str]:
    """The word with one foreign letter put in, at two places."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    seed = hashlib.sha256(word.encode(errors="replace")).digest()
    return [word[:i] + letters[seed[k] % 26] + word[i:] for k, i in enumerate({1 + len(word) // 3, 2 * len(word) // 3}) if 0 < i < len(word)]


def fit_machine(positive: list[tuple[str, float]], negative: list[str], landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """Feature weights and bias from (word, weight) and words."""
    for _ in range(3):
        words = [w for w, _ in positive] + negative
        word, feature, weight, own = triples(words)
        chosen = np.r_[np.unique(np.linspace(0, len(positive) - 1, landmarks).astype(int)), len(positive) + np.arange(min(landmarks, len(negative)))]
        rank = np.full(len(words), -1)
        rank[chosen] = np.arange(len(chosen))
        held = rank[word] >= 0
        used = np.unique(feature[held])
        column = np.full(FEATURES, -1)
        column[used] = np.arange(len(used))
        phi = np.zeros((len(chosen), len(used)), np.float32)
        phi[rank[word[held]], column[feature[held]]] = weight[held] / np.sqrt(own[word[held]])
        # kernels of all words with the landmarks, in batches
        k = np.zeros((len(words), len(chosen)))
        edges = np.searchsorted(word, np.arange(0, len(words) + 500, 500))
        for i, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            n = min(500, len(words) - 500 * i)
            if n <= 0:
                break
            some = np.zeros((n, len(used)), np.float32)
            ok = column[feature[s:e]] >= 0
            some[word[s:e][ok] - 500 * i, column[feature[s:e][ok]]] = weight[s:e][ok] / np.sqrt(own[word[s:e][ok]])
            k[500 * i : 500 * i + n] = some @ phi.T
        values, vectors = np.linalg.eigh(k[chosen])
        keep = values > 1e-6 * values[-1]
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        z = np.concatenate([k @ whiten, np.ones((len(words), 1))], axis=1)
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        share = np.array([w for _, w in positive])
        c = np.r_[share * max(1.0, len(negative) / (4 * max(share.sum(), 1e-9))), np.ones(len(negative))] * PENALTY
        w = np.zeros(z.shape[1])
        ridge = np.r_[np.ones(z.shape[1] - 1), 1e-3]
        for _ in range(40):
            margin = y * (z @ w)
            sv = margin < 1
            grad = ridge * w - z[sv].T @ (c[sv] * y[sv] * (1 - margin[sv]))
            step = np.linalg.solve(np.diag(ridge) + z[sv].T @ (z[sv] * c[sv, None]), grad)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        f = z @ w
        dropped = f[: len(positive)] <= 0
        if not dropped.any() or dropped.all():
            break
        positive = [p for p, d in zip(positive, dropped, strict=True) if not d]
    out = np.zeros(FEATURES)
    out[used] = phi.T @ (whiten @ w[:-1])
    return out, float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of x, none below 0, and the offset of the logistic curve that fits labels y best, lightly held back."""
    out, used = np.zeros(x.shape[1] + 1), np.arange(x.shape[1])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    while True:
        design = np.concatenate([((x - mean) / scale)[:, used], np.ones((len(x), 1))], axis=1)
        ridge = np.r_[np.full(len(used), 0.02), 1e-6]
        w = np.zeros(len(ridge))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (p - y) + ridge * w
            h = design.T @ (design * (p * (1 - p) + 1e-6)[:, None]) + np.diag(ridge)
            step = np.clip(np.linalg.solve(h, grad), -2, 2)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= 0).all():
            break
        used = used[w[:-1] >= 0]
    out[used] = w[:-1] / scale[used]
    out[-1] = w[-1] - out[used] @ mean[used]
    return out


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> Model | float:
    """A model from a bounded sample of documents with a label 0 or 1; the share of label 1 where only one occurs."""
    sample, counts = labelled_sample(docs, labels, label_col, per_label, id_col, text_col)
    if len(counts) < 2:
        return 1.0 if 1 in counts else 0.0
    sample = sample.where("text is not null")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = sentence_words(text)
                if ws:
                    same = [sketch(text)] * len(ws)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(ws), pa.int32()), pa.array(ws, pa.string()), pa.array(same, pa.int64())], ["label", "word", "sketch"])

    # the vocabulary of the sample is bounded, so a fixed number of partitions holds it and sends the driver little
    seen = sample.select("label", "text").mapInArrow(read, "label int, word string, sketch long").repartition(16, "word").distinct()
    words = seen.groupBy("word").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))
    words = words.persist()
    try:
        total = words.agg(F.sum("pos"), F.sum("neg"), F.count_if(F.col("pos") + F.col("neg") >= LEAST_DOCUMENTS)).first()
        if not total[0] or not total[1]:
            return counts[1] / (counts[0] + counts[1])
        share = total[0] / (total[0] + total[1])
        n = F.col("pos") + F.col("neg")
        ratio = 2 * (F.col("pos") * F.log(F.col("pos") / (n * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - share)))).otherwise(0.0))
        likely = words.where((F.col("pos") >= LEAST_DOCUMENTS) & (F.col("pos") > 4 * share / (1 - share) * F.col("neg"))).select("word", ratio.alias("g"))
        positive = likely.orderBy(F.desc("g"), "word").limit(POSITIVE).collect()
        # the commonest clean words and as many of any kind
        clean = words.where(F.col("neg") > 4 * (1 - share) * F.col("pos"))
        common = clean.orderBy(F.desc("neg"), "word").limit(NEGATIVE // 2).collect()
        other = clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVE // 2).collect()
    finally:
        words.unpersist()
    # chance gives a ratio of g with probability exp(-g/2) at most (Benjamini and Hochberg 1995)
    passed = [k for k, r in enumerate(positive, 1) if np.exp(-r.g / 2) <= DISCOVERY * k / total[2]]
    positive = positive[: max(passed, default=0)]
    # a ratio of 24 is beyond chance for a vocabulary of some hundred thousand words
    chosen = [(r.word, min(1.0, r.g / 24)) for r in positive]
    chosen += [(v, x / 2) for w, x in chosen if len(w) > 4 for v in with_insertions(w)]
    if not chosen:
        return counts[1] / (counts[0] + counts[1])
    negative = sorted({r.word for r in other} | {r.word for r in common}, key=lambda w: hashlib.sha256(w.encode(errors="replace")).digest())
    weights, bias = fit_machine(chosen, negative)
    model = Model(weights.astype(np.float32), bias, np.zeros(3))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            hits, words = zip(*scorer.hits(b.column(1).to_pylist()), strict=True) if b.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.float64()), pa.array(words, pa.int64())], ["label", "hits", "words"])

    found = sample.select("label", "text").mapInArrow(evidence, "label int, hits double, words long").collect()
    known = features(np.array([r.hits for r in found]), np.array([r.words for r in found], float))
    model.curve = logistic(known, np.array([r.label for r in found], float))
    return model


def predict(df: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if isinstance(model, float) else Scorer(model)
        for b in slices(batches):
            scores = np.full(b.num_rows, model) if scorer is None else scorer.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, score double")


def drop_toxic(df: DataFrame, model: Model | float, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df without the rows that score `threshold` or more; all columns stay, and nothing is shuffled."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if isinstance(model, float) else Scorer(model)
        for b in slices(batches):
            keep = np.full(b.num_rows, model < threshold) if scorer is None else scorer.scores(b.column(place).to_pylist()) < threshold
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
