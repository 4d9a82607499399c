"""Token ids of whole texts by a public tokenizer, one dictionary of pieces per block.

A text is cut where its tokenizer cuts anyway, each different piece of a block is encoded once, and the ids are gathered.
First come chunks: byte-level BPE with the usual pattern (a space goes with what follows) is cut before a single space, and
around a single line feed, between two characters that are no white space; a tokenizer that drops white space is cut at
white space. A chunk of Latin letters, digits and punctuation without apostrophe is then cut where the kind of character
changes, which makes it pieces that only the tokenizer's merges have to see. All other chunks go through the whole tokenizer.
So do, in one piece, texts with special tokens or with white space outside ASCII.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from fathom.llm import repeats as R
from fathom.llm import shared as S

#: Pieces that are remembered from block to block, at most.
REMEMBERED = 500_000
SPACE, LETTER, DIGIT, MARK, ODD = range(5)


def kinds() -> bytes:
    """The kind of each byte, if it stands alone."""
    out = np.full(256, ODD, np.uint8)
    out[0x21:0x7F] = MARK
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    out[0x27] = ODD  # an apostrophe may start a piece of its own
    return out.tobytes()


KINDS = kinds()


def kinds_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and where two bytes make a Latin letter."""
    kind = np.frombuffer(bytearray(data).translate(KINDS), np.uint8)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    pair = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    kind[pair] = kind[pair + 1] = LETTER
    return kind, pair


def of_one_kind(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that have letters, digits or marks only, with a space before them or not; no row is empty."""
    if len(at) < 2:
        return np.zeros(0, bool)
    kind, _ = kinds_of(data)
    head = at[:-1][(data[at[:-1]] == 0x20) & (np.diff(at) > 1)]
    kind[head] = kind[head + 1]
    least = np.minimum.reduceat(kind, at[:-1])
    return (least == np.maximum.reduceat(kind, at[:-1])) & (least != SPACE) & (least != ODD)


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space outside ASCII begins, in UTF-8."""
    lead = np.flatnonzero((data == 0xC2) | (data - 0xE1 < 3))
    a, b, c = data[lead], data.take(lead + 1, mode="clip"), data.take(lead + 2, mode="clip")
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & ((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return lead[two | general | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)]


def byte_names() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if it is printable, else the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


NAMES = byte_names()
LETTERS = np.array([ord(NAMES[b]) for b in range(256)], np.uint32)


class Encoder:
    """Encodes columns of texts. One for each worker: it remembers pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        split = lambda x: [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(x)]
        self.keeps_space = split("ab c.d") == ["ab", NAMES[0x20] + "c", ".", "d"]
        self.drops_space = split("ab c.d") == ["ab", "c", ".", "d"]
        self.splits_digits = split("12") == ["1", "2"]
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AbÉ") == "abé"
        self.plain = (self.keeps_space or self.drops_space) and split("é") == ["Ã©"] and (self.lowers or self.tokenizer.normalizer is None)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Start with no piece remembered: their bytes, where each one's ids are, and all their ids."""
        self.memory = pa.array([], pa.large_binary())
        self.base, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows that must not be cut."""
        if not (self.keeps_space or self.drops_space):
            return np.arange(len(at) - 1)
        text = data.tobytes()
        places = wide_spaces(data).tolist()
        for token in self.special:
            low = text.find(token)
            while low >= 0:
                places.append(low)
                low = text.find(token, low + 1)
        return np.unique(np.searchsorted(at, places, "right") - 1) if places else np.zeros(0, np.int64)

    def pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The pieces of all rows, and each row's first piece."""
        n = len(data)
        whole = self.whole(data, at)
        some = at[:-1] < at[1:]
        head, last = at[:-1][some], at[1:][some] - 1
        kind, pair = kinds_of(data)
        cut = np.zeros(n + 1, bool)
        if self.keeps_space:
            dark = (data > 0x20) & (data != 0x7F)
            between = np.zeros(n, bool)
            between[1:-1] = dark[:-2] & dark[2:]
            between[head] = between[last] = False
            space, feed = np.flatnonzero((data == 0x20) & between), np.flatnonzero((data == 0x0A) & between)
            cut[space] = cut[feed] = cut[feed + 1] = True
            kind[kind == SPACE] = ODD  # white space that goes with what follows it is of that kind, any other is odd
            kind[space] = kind[space + 1]
            inside = np.ones(n, bool)
        else:
            inside = kind != SPACE
            cut[:-1] = inside
            cut[1:-1] &= ~inside[:-1]
        for k in whole:
            cut[at[k] : at[k + 1]] = False
            kind[at[k] : at[k + 1]] = ODD
            inside[at[k] : at[k + 1]] = True
        cut[head] = inside[head]
        start = np.flatnonzero(cut[:-1])
        if self.plain and len(start):
            plain = np.zeros(n, bool)
            plain[start[0] :] = np.repeat(np.maximum.reduceat(kind, start) != ODD, np.diff(start, append=n))  # by chunk
            plain &= inside
            change = kind[1:] != kind[:-1]
            if self.splits_digits:
                change |= (kind[1:] == DIGIT) & (kind[:-1] == DIGIT)
            cut[1:-1] |= change & plain[1:]
            start = np.flatnonzero(cut[:-1])
            if self.lowers:
                data = data + (((data - 0x41 < 26) & plain).view(np.uint8) << 5)
                second = pair + 1
                data[second[plain[second] & (data[second] <= 0x9E)]] += 0x20
        if inside.all():
            edges = np.append(start, n)
        else:
            data = data[inside]
            edges = np.append(np.flatnonzero(cut[:-1][inside]), len(data))
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return out, np.searchsorted(start, at)

    def ids_of(self, names: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of these pieces: where each one's begin, how many there are, and all of them."""
        plain = of_one_kind(*S.utf8(names)) if self.plain else np.zeros(len(names), bool)
        rest = np.flatnonzero(~plain)
        data, at = S.utf8(names.filter(pa.array(plain)))
        letters = with_end(LETTERS[data], at, 0x0A)[0].astype("<u4").tobytes().decode("utf-32-le").split("\n")  # no byte's letter is a line feed
        merge, flat, size = self.tokenizer.model.tokenize, [], []
        for x in letters[:-1]:
            ids = [t.id for t in merge(x)]
            flat += ids
            size.append(len(ids))
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for low in range(0, len(rest), 50_000):
            for e in fast([x.decode() for x in names.take(rest[low : low + 50_000]).to_pylist()], add_special_tokens=False):
                flat += e.ids
                size.append(len(e.ids))
        order = np.concatenate([np.flatnonzero(plain), rest])
        base, sizes = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        sizes[order] = size
        base[order] = np.cumsum(sizes[order]) - sizes[order]
        return base, sizes, np.array(flat, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (32 bits), and each row's first one (with the number of ids at the end)."""
        pieces, first = self.pieces(*S.utf8(column))
        named = pieces.dictionary_encode()
        both = pa.concat_arrays([self.memory, named.dictionary]).dictionary_encode()  # remembered pieces keep their numbers
        if len(both.dictionary) > REMEMBERED and len(self.memory):
            self.forget()
            both = named.dictionary.dictionary_encode()
        known = len(self.memory)
        base, size, flat = self.ids_of(both.dictionary[known:])
        self.memory = both.dictionary
        self.base = np.append(self.base, len(self.flat) + base)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, flat)
        of = both.indices.to_numpy()[known:][named.indices.to_numpy()]
        count = self.size[of]
        ids = self.flat[np.repeat(self.base[of], count) + R.ramp(count)]
        return ids, np.append(0, np.cumsum(count))[first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        S.at_end(_encoders[path].forget)
    return _encoders[path]


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id at the end of each row."""
    out = np.full(len(ids) + len(first) - 1, end, np.uint32)
    moved = first + np.arange(len(first))
    keep = np.ones(len(out), bool)
    keep[moved[1:] - 1] = False
    out[keep] = ids
    return out, moved
