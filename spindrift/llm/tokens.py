"""Encoding of whole texts with a public tokenizer file, quick where words recur.

A byte-level tokenizer first cuts a text into pieces (words with the space before them, runs of digits,
of marks and of white space) and merges bytes only within a piece. Here the pieces of many texts are found at
once, and the ids that the tokenizers library's model gives for each distinct piece are kept in a bounded
table, which is looked up by the bytes of a piece themselves. A text that has characters outside the blocks
listed below is cut at single spaces only, and its parts are encoded by the library as they are; so are special
tokens, whose strings in a text give their own ids as in the library. Tests compare with the library's
encoding of whole texts.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces in a worker's table; a full one is emptied. About 80 bytes each.
CACHE_PIECES = 1 << 20
#: Bytes of a piece that is looked up in the table; longer ones are kept in a dict of as many as CACHE_LONG.
SHORT, CACHE_LONG = 16, 20_000
#: Characters whose pieces are found at a time (about 30 bytes each).
AT_ONCE = 1 << 17
#: Letters, and other visible characters, whose class is the same in every Unicode version.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏΈ-ΊΎ-ΡΣ-ϿЀ-ҁҊ-ԧぁ-ゖァ-ヺ一-鿌가-힣"
MARKS = "!-/:-@\\[-`{-~¡§«»¿–—‘-„…€、。"
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Classes of characters. STOP ends a text; a text with OTHER is left to the library.
OTHER, SPACE, LETTER, DIGIT, MARK, STOP = range(6)
LIMITS = np.array([0xFFFFFFFFFFFFFFFF >> 8 * (8 - k) if k else 0 for k in range(9)], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    of = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return "".join(of[b] for b in range(256))


@functools.cache
def classes() -> np.ndarray:
    """The class of each character of the basic plane, and OTHER for what stands for all beyond it."""
    out = np.full(0x10001, OTHER, np.uint8)
    for kind, chars in ((SPACE, "\t-\r "), (LETTER, LETTERS), (DIGIT, "0-9"), (MARK, MARKS)):
        listed = re.compile(f"[{chars}]")
        out[[c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and listed.match(chr(c))]] = kind
    return out


def piece_starts(chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pieces of byte-level BPE begin among characters of known classes; texts are ended by STOP."""
    n = len(chars)
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    starts = run.copy()
    after = np.append(kind[1:], STOP)
    # of white space before anything else the last character is a piece of its own, or goes with what follows if it is a blank
    last = (kind == SPACE) & (after != SPACE) & (after != STOP)
    starts |= last
    blank = np.flatnonzero(last & (chars == 32)) + 1
    starts[blank] = False
    # an apostrophe that stands alone and begins a piece takes a short ending with it
    at = np.flatnonzero((chars == 39) & starts & (after == LETTER))
    if len(at):
        next1, next2 = chars[at + 1], np.append(chars, 0)[at + 2]
        one = np.isin(next1, [ord(c) for c in "stmd"])
        two = ((next1 == ord("r")) | (next1 == ord("v"))) & (next2 == ord("e")) | (next1 == ord("l")) & (next2 == ord("l"))
        some = at[one | two]
        starts[some + 1] = False
        # STOP ends every text, so there is a character after the ending
        end = some + np.where(one, 2, 3)[one | two]
        starts[end] |= kind[end] == LETTER
    return np.flatnonzero(starts)


class Table:
    """ids of pieces of up to SHORT bytes, by their bytes and length: open addressing in arrays."""

    def __init__(self, limit: int):
        self.limit, self.slots = limit, 1 << max(4, (2 * limit - 1).bit_length())
        self.forget()

    def forget(self) -> None:
        # pages of zeros take no memory until they are written to: a value of 0 is free, others are entries from 1 on
        self.keys, self.value = np.zeros((self.slots, 2), np.uint64), np.zeros(self.slots, np.int32)
        self.size, self.lengths, self.first, self.ids = 0, np.zeros(1024, np.uint8), np.zeros(1025, np.int32), np.zeros(4096, np.uint32)

    def slot(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (low ^ length.astype(np.uint64) << np.uint64(56)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(29) ^ high) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(33)).astype(np.int64) & self.slots - 1

    def find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where there is none."""
        slot = self.slot(low, high, length)
        out = self.value[slot] - 1
        same = (out >= 0) & (self.keys[slot, 0] == low) & (self.keys[slot, 1] == high) & (self.lengths[out] == length)
        todo = np.flatnonzero((out >= 0) & ~same)
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.slots - 1
            s, found = slot[todo], self.value[slot[todo]] - 1
            out[todo] = found
            same = (self.keys[s, 0] == low[todo]) & (self.keys[s, 1] == high[todo]) & (self.lengths[found] == length[todo])
            todo = todo[(found >= 0) & ~same]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, ids: list[list[int]]) -> None:
        """Pieces that the table does not have, each once."""
        n, sizes = len(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        ends = int(self.first[self.size]) + np.cumsum(sizes)
        self.lengths, self.first = grown(self.lengths, self.size + n), grown(self.first, self.size + n + 1)
        self.ids = grown(self.ids, int(ends[-1]))
        self.ids[self.first[self.size] : ends[-1]] = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        self.lengths[self.size : self.size + n], self.first[self.size + 1 : self.size + n + 1] = length, ends
        slot, entry = self.slot(low, high, length), np.arange(self.size, self.size + n)
        while len(entry):
            free = np.flatnonzero(self.value[slot] == 0)
            # of several that want a free slot the last one written has it
            self.value[slot[free]] = entry[free] + 1
            placed = self.value[slot] == entry + 1
            self.keys[slot[placed], 0], self.keys[slot[placed], 1] = low[placed], high[placed]
            slot, entry, low, high = slot[~placed] + 1 & self.slots - 1, entry[~placed], low[~placed], high[~placed]
        self.size += n


def grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first+1, ... of each size, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit integers, and their character spans."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.table, self.long = Table(cache_pieces), {}

    def forget(self) -> None:
        """Empty the table: at the end of a task, since a worker's memory also serves other stages."""
        self.table.forget()
        self.long.clear()

    def piece_ids(self, piece: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]

    def long_ids(self, piece: bytes) -> list[int]:
        ids = self.long.get(piece)
        if ids is None:
            if len(self.long) >= CACHE_LONG:
                self.long.clear()
            ids = self.long[piece] = self.piece_ids(piece)
        return ids

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, null as empty."""
        out: list[bytes] = [b""] * len(texts)
        parts, owner = [], []
        for i, text in enumerate(texts):
            if text and self.special and self.special.search(text):
                out[i] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            elif text:
                cut = list(portions(text))
                parts += cut
                owner += [i] * len(cut)
        done: list[bytes] = [b""] * len(parts)
        for group, ids, ends in self._known(parts):
            raw, at = ids.tobytes(), 0
            for k, end in zip(group, ends.tolist(), strict=True):
                done[k] = raw[4 * at : 4 * end]
                at = end
        for k, i in enumerate(owner):
            ids = done[k] or self._by_library(parts[k])
            out[i] = out[i] + ids if out[i] else ids
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def _by_library(self, text: str) -> bytes:
        first, *more = SAFE_SPACE.split(text)
        return array("I", [i for part in [first, *[" " + x for x in more]] for i in self.tokenizer.encode(part, add_special_tokens=False).ids]).tobytes()

    def _known(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(positions, ids, ends) of groups of those texts that have known characters only; the others are left out."""
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(i)
            size += len(text)
            if size >= AT_ONCE or i + 1 == len(texts):
                yield from self._group(texts, group)
                group, size = [], 0

    def _group(self, texts: list[str], group: list[int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        joined = "￿".join([texts[i] for i in group]) + "￿"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes()[np.minimum(chars, 0x10000)]
        stops = np.cumsum([len(texts[i]) + 1 for i in group]) - 1
        odd = np.flatnonzero(kind == OTHER)
        if len(odd) > len(stops):
            # the texts of other characters are left out, and the group is read again without them
            which = np.bincount(np.searchsorted(stops, odd), minlength=len(group)) > 1
            group = [i for i, skip in zip(group, which.tolist(), strict=True) if not skip]
            if group:
                yield from self._group(texts, group)
            return
        kind[stops] = STOP
        starts = piece_starts(chars, kind)
        raw = joined.encode("utf-8", "surrogatepass")
        place = starts if len(raw) == len(chars) else utf8_places(chars)[starts]
        length = np.diff(np.append(place, len(raw)))
        # each text's last piece is its STOP
        ended = np.searchsorted(starts, stops)
        use = np.ones(len(place), bool)
        use[ended] = False
        words = np.ndarray(len(raw) + 1, "<u8", raw + bytes(SHORT + 8), strides=(1,))
        n = self.table.limit
        # no more pieces at a time than the table can hold
        found = [self._look_up(raw, words, place[k : k + n], length[k : k + n], use[k : k + n]) for k in range(0, len(place), n)]
        ids, size = (found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found, strict=True)))
        yield group, ids, np.cumsum(size)[ended]

    def _look_up(self, raw: bytes, words: np.ndarray, place: np.ndarray, length: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pieces that are of use, and how many each has."""
        low = words[place] & LIMITS[np.minimum(length, 8)]
        high = words[np.minimum(place + 8, len(raw))] & LIMITS[np.clip(length - 8, 0, 8)]
        some, far = np.flatnonzero(use & (length <= SHORT)), np.flatnonzero(use & (length > SHORT))
        low, high, short = low[some], high[some], length[some]
        entry = self.table.find(low, high, short).astype(np.int64)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.table.size + len(new) > self.table.limit:
                self.table.forget()
                new = np.arange(len(some))
            key = np.empty(len(new), [("low", "<u8"), ("high", "<u8"), ("length", "<i8")])
            key["low"], key["high"], key["length"] = low[new], high[new], short[new]
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            first, before = new[first], self.table.size
            pieces = [raw[a : a + n] for a, n in zip(place[some[first]].tolist(), short[first].tolist(), strict=True)]
            self.table.add(low[first], high[first], short[first], [self.piece_ids(x) for x in pieces])
            entry[new] = before + which.ravel()
        start, size = self.table.first[entry].astype(np.int64), np.zeros(len(place), np.int64)
        size[some] = self.table.first[entry + 1] - start
        found = self.table.ids[ranges(start, size[some])]
        if not len(far):
            return found, size
        long = [self.long_ids(raw[a : a + n]) for a, n in zip(place[far].tolist(), length[far].tolist(), strict=True)]
        size[far] = np.fromiter(map(len, long), np.int64, len(far))
        ends = np.cumsum(size)
        ids = np.empty(ends[-1], "<u4")
        ids[ranges(ends[some] - size[some], size[some])] = found
        ids[ranges(ends[far] - size[far], size[far])] = np.fromiter((i for x in long for i in x), np.uint32, int(size[far].sum()))
        return ids, size

    @functools.cached_property
    def bytes_of(self) -> np.ndarray:
        """How many bytes each id stands for."""
        out = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[i] = len(token)
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = len(t.content.encode())
        return out

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First characters and ends (exclusive) of the tokens of a text: a token that has a part of a character spans all of it."""
        size = self.bytes_of[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return ends, ends
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) == len(text):
            return ends - size, ends
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[ends - size], char[ends - 1] + 1

    def encode_spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, first characters and ends (exclusive) of the tokens of one text."""
        ids = np.frombuffer(self.encode(text), "<u4")
        return ids, *self.spans(text or "", ids)


def portions(text: str) -> Iterator[str]:
    """A long text in parts that begin with a single space between two words, where pieces part in any case."""
    at = 0
    while len(text) - at > 2 * AT_ONCE and (m := SAFE_SPACE.search(text, at + AT_ONCE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def utf8_places(chars: np.ndarray) -> np.ndarray:
    """The first byte of each character."""
    size = 1 + (chars > 0x7F).astype(np.uint8) + (chars > 0x7FF) + (chars > 0xFFFF)
    ends = np.cumsum(size, dtype=np.int64)
    return ends - size


@functools.cache
def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, cache_pieces)
