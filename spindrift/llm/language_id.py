"""Language identification by a string kernel.

The blended spectrum of a text is the set of all runs of 1 to 3 bytes in its lower-cased letters. The kernel
of two texts is the number of runs that both have over the root of the product of their numbers of runs.
The Nyström method maps a text to its kernels with `landmarks` sample texts of each language, whitened by
their own kernel matrix, and one ridge regression for each language against the rest is solved on that map.
Scoring a batch is two matrix products: presence times landmark spectra, and kernels times weights.

The sample has about PER_LANGUAGE labelled rows of each language; spectra, not texts, reach the driver. Kernels are exact: a run
that no landmark has adds nothing to them but to the number of the text's runs, so only the landmarks' runs are kept, all of them.

Defined cases: a text that is null or has no letter is `und` with score 0; rows with a null language are
not learned from; with no labelled row at all every text is `und`; repeated rows each give a row; null ids
are carried; an empty table gives an empty table; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import balanced_sample

PER_LANGUAGE, LANDMARKS, RIDGE = 300, 32, 0.01
UNKNOWN = "und"
LETTERS_ONLY = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
BATCH = 64


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def letters(text: str) -> np.ndarray:
    """Bytes of the lower-cased text, all but letters as spaces, one space at least at either end."""
    return np.frombuffer(b" " + text.lower().encode(errors="replace").translate(LETTERS_ONLY) + b" ", np.uint8)


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all runs of 1, 2 and 3 bytes; a shorter run has leading zero bytes, which no text has."""
    a = letters(text).astype(np.uint32)
    pair = a[:-1] << 8 | a[1:]
    return a, pair, pair[:-1] << 8 | a[2:]


def spectrum(text: str) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(x) for x in runs(text)]))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # of the runs of all landmarks
    spectra: np.ndarray  # landmarks x runs, each divided by the root of its number of runs
    weights: np.ndarray  # landmarks x languages


def kernel(presence: np.ndarray, sizes: np.ndarray, spectra: np.ndarray) -> np.ndarray:
    """presence: which of the landmarks' runs each text has; sizes: how many runs of any kind."""
    return (presence @ spectra.T) / np.sqrt(np.maximum(sizes, 1))[:, None]


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from (language, spectrum) pairs."""
    if not samples:
        return None
    languages = sorted({x for x, _ in samples})
    label = np.array([languages.index(x) for x, _ in samples])
    chosen = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(languages))])
    codes = np.unique(np.concatenate([samples[i][1] for i in chosen]))
    sizes = np.array([len(s) for _, s in samples])
    presence = np.zeros((len(samples), len(codes)), np.float32)
    for i, (_, s) in enumerate(samples):
        presence[i, np.searchsorted(codes, s[np.isin(s, codes)])] = 1
    spectra = presence[chosen] / np.sqrt(np.maximum(sizes[chosen], 1))[:, None]
    values, vectors = np.linalg.eigh(kernel(presence[chosen], sizes[chosen], spectra).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    mapped = kernel(presence, sizes, spectra) @ whiten
    # every language weighs the same however many rows it has
    weight = (1 / np.bincount(label, minlength=len(languages)))[label]
    target = (label[:, None] == np.arange(len(languages))).astype(np.float64)
    left = mapped.T @ (mapped * weight[:, None]) + ridge * len(languages) / len(samples) * np.eye(mapped.shape[1])
    solved = np.linalg.solve(left, mapped.T @ (target * weight[:, None]))
    return Model(languages, codes, spectra.astype(np.float32), (whiten @ solved).astype(np.float32))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from a bounded sample of the rows of df that have a language and a letter."""
    rows = balanced_sample(df.select(id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), lang_col, per_language, id_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang, spectrum(t).tobytes()) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.binary()))], ["lang", "runs"])

    found = rows.select(F.col(lang_col), F.col(text_col)).mapInArrow(read, "lang string, runs binary").collect()
    return fit(sorted(((r.lang, np.frombuffer(r.runs, np.uint32)) for r in found), key=lambda x: (x[0], x[1].tobytes())))


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, lang_pred, score (the share of the best language among the positive outputs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = np.zeros(1 << 24, np.int32), np.zeros(1 << 24, np.int32)
        if model:
            place[model.codes] = np.arange(1, len(model.codes) + 1)
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for k in range(0, len(todo), BATCH):
                some = todo[k : k + BATCH]
                presence = np.zeros((len(some), len(model.codes) + 1), np.float32)
                sizes = np.zeros(len(some))
                for row, i in enumerate(some):
                    for codes in runs(texts[i]):
                        presence[row, place[codes]] = 1
                        # each run counts once: where it comes last
                        order = np.arange(len(codes), dtype=np.int32)
                        last[codes] = order
                        sizes[row] += np.count_nonzero(last[codes] == order)
                out = kernel(presence[:, 1:], sizes, model.spectra) @ model.weights
                best = out.argmax(axis=1)
                positive = np.maximum(out, 0)
                share = positive[np.arange(len(some)), best] / np.maximum(positive.sum(axis=1), 1e-9)
                for i, j in zip(some, best.tolist(), strict=True):
                    lang[i] = model.languages[j]
                score[some] = share
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")
