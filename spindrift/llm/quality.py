"""Document quality by a byte-level convolutional network in numpy.

A text is the bytes of its UTF-8. FILTERS learned filters of WIDTH bytes (over a learned embedding) slide
over every byte; their outputs are max-pooled in overlapping chunks of CHUNK bytes that together cover the
whole document, a hidden layer looks at each chunk, and the greatest and the mean hidden values over all
chunks give one probability. Training is by gradient descent (Adam) on all chunks of about PER_LABEL
documents of each label, none of them over LONGEST bytes; the network's prior is then set to the labels'
shares. The sample is thus at most 4 * PER_LABEL * LONGEST bytes, a few MB as a rule.

Embedding and filters are folded into one table for each pair of neighbouring bytes.

Defined cases: null and empty texts are one empty chunk and get a score like any other; null labels are not
learned from; where only one label (or none) occurs, 0.5 is every score, and a label whose documents all exceed LONGEST bytes
counts as one that does not occur; repeated rows each give
a row; null ids are carried; an empty table gives an empty table; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample

#: Training documents of each label, the bytes of the longest of them, and passes over the sample.
PER_LABEL, LONGEST, EPOCHS = 1500, 1 << 16, 14
#: Chunks whose gradients are computed at once.
AT_ONCE = 1024
WIDTH, FILTERS, EMBED, HIDDEN = 6, 16, 8, 16
BLOCK, STRIDE = 32, 7
#: A chunk is this many positions; the next begins STRIDE blocks later, so neighbours share one block.
CHUNK = BLOCK * (STRIDE + 1)
PAD = 256
SEGMENT = 1 << 20


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "embed": f32(257, EMBED, scale=0.5), "filters": f32(WIDTH * EMBED, FILTERS, scale=0.25), "bias": np.zeros(FILTERS, np.float32),
            "hidden": f32(FILTERS, HIDDEN, scale=0.35), "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": f32(2 * HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32),
        }
        self.p["embed"][PAD] = 0

    def step(self, chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, docs: int | None = None) -> dict[str, np.ndarray]:
        """Gradients of the summed cross entropy over `docs` (by default, all of label) for chunks (n x CHUNK+WIDTH-1 bytes) of documents doc."""
        p, n, docs = self.p, len(chunks), docs or len(label)
        chunks = chunks.astype(np.int32)
        pair = chunks[:, :-1] * 257 + chunks[:, 1:]
        tables = self.tables()
        conv = tables[0].take(pair[:, :CHUNK], axis=0)
        for k, t in enumerate(tables[1:], 1):
            conv += t.take(pair[:, 2 * k : 2 * k + CHUNK], axis=0)
        conv[chunks[:, :CHUNK] == PAD] = -1e9  # behind the end, as in scoring
        at = conv.argmax(axis=1)
        pooled = np.take_along_axis(conv, at[:, None], axis=1)[:, 0] + p["bias"]
        act = np.maximum(pooled, 0)
        h = np.maximum(act @ p["hidden"] + p["hidden_bias"], 0)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        size = np.diff([*first, n])[:, None]
        top, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / size
        z = np.concatenate([top, mean], axis=1)
        prob = 1 / (1 + np.exp(-(z @ p["out"] + p["out_bias"])))
        d = ((prob - label) / docs).astype(np.float32)
        g = {"out": z.T @ d, "out_bias": d.sum(keepdims=True)}
        dz = d[:, None] * p["out"]
        is_top = (h == top[doc]) & (h > 0)
        dh = is_top * dz[doc, :HIDDEN] + (dz[:, HIDDEN:] / size)[doc]
        dh *= h > 0
        g["hidden"], g["hidden_bias"] = act.T @ dh, dh.sum(axis=0)
        da = (dh @ p["hidden"].T) * (pooled > 0)
        g["bias"] = da.sum(axis=0)
        # only the windows where a filter was greatest take part
        where = chunks[np.arange(n)[:, None, None], at[:, :, None] + np.arange(WIDTH)]
        g["filters"] = np.einsum("nfw,nf->wf", p["embed"][where].reshape(n, FILTERS, WIDTH * EMBED), da)
        de = (da[:, :, None] * p["filters"].T[None]).reshape(n, FILTERS, WIDTH, EMBED)
        flat = where.ravel()
        g["embed"] = np.stack([np.bincount(flat, weights=x, minlength=PAD + 1) for x in de.reshape(-1, EMBED).T], axis=1).astype(p["embed"].dtype)
        g["embed"][PAD] = 0
        return g

    def fit(self, chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.004, seed: int = 1) -> None:
        rng, t = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        rows = np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1)
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                some, g, t = order[k : k + batch], {}, t + 1
                # whole documents with about AT_ONCE chunks at a time; their gradients add up
                turn = np.cumsum([len(rows[i]) for i in some]) // AT_ONCE
                for part in np.split(some, np.flatnonzero(np.diff(turn)) + 1):
                    index = np.concatenate([rows[i] for i in part])
                    own = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
                    for name, x in self.step(chunks[index], own, label[part], len(some)).items():
                        g[name] = g[name] + x if name in g else x
                now = rate * (1 - epoch / epochs)
                for name, x in g.items():
                    m[name] += 0.1 * (x - m[name])
                    v[name] += 0.001 * (x * x - v[name])
                    self.p[name] -= (now * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> list[np.ndarray]:
        """For each pair of window places, what each pair of bytes adds to the filters."""
        p = self.p
        each = [p["embed"] @ p["filters"][k * EMBED : (k + 1) * EMBED] for k in range(WIDTH)]
        return [np.ascontiguousarray((a[:, None] + b[None]).reshape(-1, FILTERS)) for a, b in zip(each[::2], each[1::2], strict=True)]


class Scorer:
    def __init__(self, p: dict[str, np.ndarray], tables: list[np.ndarray]):
        self.p, self.tables = p, tables

    def blocks(self, raw: bytes) -> np.ndarray:
        """The greatest filter outputs in each block of BLOCK positions."""
        out = []
        for at in range(0, len(raw), SEGMENT):
            size = min(SEGMENT, len(raw) - at)
            padded = -(-size // BLOCK) * BLOCK
            x = np.full(padded + WIDTH, PAD, np.int64)
            some = np.frombuffer(raw[at : at + size + WIDTH], np.uint8)
            x[: len(some)] = some[: len(x)]
            pair = x[:-1] * 257 + x[1:]
            total = self.tables[0].take(pair[:padded], axis=0)
            for k, t in enumerate(self.tables[1:], 1):
                total += t.take(pair[2 * k : 2 * k + padded], axis=0)
            total[size:] = -1e9
            out.append(total.reshape(-1, BLOCK, FILTERS).max(axis=1))
        return np.concatenate(out) if out else np.full((1, FILTERS), -1e9, np.float32)

    def score(self, raw: bytes) -> float:
        p, b = self.p, self.blocks(raw)
        starts = np.arange(0, max(1, len(b) - 1), STRIDE)
        stops = np.minimum(starts + STRIDE + 1, len(b))
        body = np.maximum.reduceat(b, starts)  # up to the next chunk's first block, which belongs to both
        pooled = np.maximum(body, b[stops - 1]) + p["bias"]
        h = np.maximum(np.maximum(pooled, 0) @ p["hidden"] + p["hidden_bias"], 0)
        z = np.concatenate([h.max(axis=0), h.mean(axis=0)])
        return float(1 / (1 + np.exp(-np.clip(z @ p["out"] + p["out_bias"][0], -30, 30))))


def chunk_starts(n: int) -> range:
    """First positions of the chunks of n bytes."""
    return range(0, max(1, -(-n // BLOCK) - 1) * BLOCK, STRIDE * BLOCK)


def chunk_at(raw: bytes, start: int) -> np.ndarray:
    x = np.full(CHUNK + WIDTH - 1, PAD, np.int16)
    some = np.frombuffer(raw[start : start + len(x)], np.uint8)
    x[: len(some)] = some
    return x


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL, longest: int = LONGEST) -> Network | float:
    """A network from a bounded sample of whole documents that have a label 0 or 1; 0.5 if only one occurs."""
    sample, counts = labelled_sample(docs, labels, label_col, per_label, id_col, text_col)
    if len(counts) < 2:
        return 0.5
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    found = sorted((r.label, bytes(r.raw)) for r in sample.select("label", text.alias("raw")).where(F.octet_length("raw") <= longest).collect())
    if len({label for label, _ in found}) < 2:
        return 0.5
    return fit([(label, np.stack([chunk_at(raw, s) for s in chunk_starts(len(raw))])) for label, raw in found], counts[1] / counts[0])


def fit(samples: list[tuple[int, np.ndarray]], odds: float) -> Network:
    """A network from (label, chunks) pairs; odds: rows of label 1 for each of label 0 outside the sample."""
    label = np.array([x for x, _ in samples], np.float32)
    doc = np.repeat(np.arange(len(samples)), [len(c) for _, c in samples])
    net = Network()
    net.fit(np.concatenate([c for _, c in samples]), doc, label)
    ones = label.sum()
    net.p["out_bias"] += np.float32(np.log(odds) - np.log(ones / (len(label) - ones)))
    return net


def predict(df: DataFrame, net: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 of each whole text."""
    share = net if isinstance(net, float) else None
    p = None if share is not None else net.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if share is None:
            fresh = Network()
            fresh.p = p
            scorer = Scorer(p, fresh.tables())
        for b in batches:
            scores = [share if scorer is None else scorer.score(raw or b"") for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` long, score double")
