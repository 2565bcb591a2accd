"""Token counts of sections by offset-mapped attribution.

A whole document (all its fields, joined by a separator) is encoded once. The character spans of its tokens
are joined to the intervals of its sections, and each token that crosses a boundary is allocated by a rule:

    start      the section that holds its first character
    end        the section that holds its last character
    majority   the section that holds most of its characters, of equals the earliest

Sections are the lines of each field; a section owns the line end or separator behind it, so the sections
tile the document and their counts add up to its number of tokens. Defined cases: null fields count as
empty; a document without characters has one empty section per field; the string of a special token in a text is
that token, as in the tokenizers library; repeated rows count each; null ids
are carried; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import slices

RULES = ("start", "end", "majority")
SECTION_SCHEMA = "doc_id long, field string, section int, char_start long, char_end long, n_tokens int, n_crossing int, doc_tokens long"


def line_starts(text: str) -> list[int]:
    """The first characters of the lines; what follows a last line end is no line unless it is all there is."""
    starts, at = [0], text.find("\n") + 1
    while 0 < at < len(text):
        starts.append(at)
        at = text.find("\n", at) + 1
    return starts


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For sections that begin at `starts`: the tokens allocated to each, and the crossing ones that touch it."""
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, np.maximum(end - 1, first), "right") - 1
    owner = b.copy() if rule == "end" else a.copy()
    crossing = np.zeros(len(starts), np.int64)
    for i in np.flatnonzero(b > a):
        edges = np.concatenate([[first[i]], starts[a[i] + 1 : b[i] + 1], [end[i]]])
        if rule == "majority":
            owner[i] = a[i] + np.argmax(np.diff(edges))
        crossing[a[i] : b[i] + 1] += np.diff(edges) > 0
    return np.bincount(owner, minlength=len(starts)), crossing


def section_token_counts(df: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = ("text",), separator: str = "\n\n", rule: str = "majority", tokenizer: str | None = None) -> DataFrame:
    """One row per section: its field, number, characters, tokens, crossing tokens, and its document's tokens."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    path, fields = tokenizer or tokens.default_path(), list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for b in slices(batches):  # few at a time: a document may have very many sections
            docs = list(zip(*(b.column(i).to_pylist() for i in range(len(fields) + 1)), strict=True))
            yield pa.RecordBatch.from_arrays(of(docs, encoder), names)

    names = [x.split()[0] for x in SECTION_SCHEMA.split(", ")]

    def of(docs: list[tuple], encoder: tokens.Encoder) -> list[pa.Array]:
        ids, field_no, section, begin, stop, n, crossing, size = ([] for _ in range(8))
        whole = [separator.join([t or "" for t in texts]) for _, *texts in docs]
        for (doc, *texts), text, raw in zip(docs, whole, encoder.encode_all(whole), strict=True):
            texts = [t or "" for t in texts]
            starts, fs, base = [], [], 0
            for f, t in enumerate(texts):
                at = line_starts(t)
                starts += [base + x for x in at]
                fs += [f] * len(at)
                base += len(t) + len(separator)
            total = base - len(separator)
            token_ids = np.frombuffer(raw, "<u4")
            first, end = encoder.spans(text, token_ids)
            # an empty field in front shares its beginning with the next one and gets nothing
            counts, cross = attribute(first, end, np.array(starts), rule)
            ids += [doc] * len(starts)
            field_no += fs
            section += [i - fs.index(f) for i, f in enumerate(fs)] if len(fields) > 1 else range(len(fs))
            begin += starts
            stop += [*starts[1:], total]
            n += counts.tolist()
            crossing += cross.tolist()
            size += [len(token_ids)] * len(starts)
        named = pa.DictionaryArray.from_arrays(pa.array(field_no, pa.int32()), pa.array(fields, pa.string())).cast(pa.string())
        return [pa.array(ids, pa.int64()), named, *(pa.array(x, t) for x, t in ((section, pa.int32()), (begin, pa.int64()), (stop, pa.int64()), (n, pa.int32()), (crossing, pa.int32()), (size, pa.int64())))]

    return df.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).mapInArrow(count, SECTION_SCHEMA)
