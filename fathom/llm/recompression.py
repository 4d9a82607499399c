"""Substring dedup on words by recompression.

Words get 64-bit names. Each round first names runs of one symbol, then pairs: a symbol of the left class followed by one
of the right class becomes one new symbol. Classes and names come from the symbols themselves, so they are the same all
over the corpus without a shuffle, and equal substrings get equal symbols inside, whatever is around them. Each symbol
carries the stretch of words that its being there depends on. A window's anchor is the highest symbol whose stretch lies
in the window (ties: smallest hash, then leftmost); a word is a symbol of level 0, so there always is one. Shared symbols
reveal the repeats, and names of whole regions and windows verify them (see repeats.py).

Defined results: null and empty texts have no words and lose nothing; texts under 50 words lose nothing; rows that repeat
a doc_id never remove each other's words; a null doc_id counts as the largest; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.llm import repeats as R
from fathom.llm import shared as S

WORD = S.table_of(S.SPACES)
ROUNDS = 3
#: Words after an anchor's first that its window has at least.
REACH = 24
#: Words in a named run or pair at most: what an anchor may depend on.
CAP = REACH
U = np.uint64


class Level:
    """Symbols in order: name, first word, number of words, words they depend on, and whether a row's end matters."""

    def __init__(self, name, start, size, low, high, edge, opens):
        self.name, self.start, self.size, self.low, self.high, self.edge, self.opens = name, start, size, low, high, edge, opens


def neighbours(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Is there a symbol of the same row before, and after?"""
    before = ~level.opens
    after = np.append(before[1:], False)
    return before, after


def name_runs(level: Level, seed: int) -> Level:
    n = len(level.name)
    same = np.zeros(n, bool)
    same[1:] = (level.name[1:] == level.name[:-1]) & ~level.opens[1:]
    head = np.flatnonzero(~same)
    size = np.add.reduceat(level.size, head)
    times = np.diff(np.append(head, n))
    long = (size > CAP) & (times > 1)
    before, after = neighbours(level)
    last = np.append(head[1:], n) - 1
    low = np.where(before[head], level.low[np.maximum(head - 1, 0)], level.low[head])
    low = np.minimum(low, level.low[head])
    high = np.where(after[last], level.high[np.minimum(last + 1, n - 1)], level.high[last])
    high = np.maximum(high, level.high[last])
    edge = np.logical_or.reduceat(level.edge, head) | ~before[head] | ~after[last] | level.edge[np.maximum(head - 1, 0)] & before[head] | level.edge[np.minimum(last + 1, n - 1)] & after[last]
    name = np.where(times > 1, S.mixed(level.name[head] + times.astype(np.uint64), seed), level.name[head])
    if long.any():  # such a run stays as it was, but what becomes of it depends on all of it
        again = np.where(long, times, 1)
        index = np.repeat(np.arange(len(head)), again)
        stays = long[index]
        at = head[index] + R.ramp(again)
        return Level(np.where(stays, level.name[at], name[index]), level.start[at], np.where(stays, level.size[at], size[index]), low[index], high[index], edge[index] | stays, level.opens[at])
    return Level(name, level.start[head], size, low, high, edge, level.opens[head])


def name_pairs(level: Level, seed: int) -> Level:
    n = len(level.name)
    left = (S.mixed(level.name, seed) & U(1)) == 0
    before, after = neighbours(level)
    joins = np.zeros(n, bool)  # with the next one
    joins[:-1] = left[:-1] & ~left[1:] & after[:-1] & (level.size[:-1] + level.size[1:] <= CAP)
    tail = np.zeros(n, bool)
    tail[1:] = joins[:-1]
    right_of, left_of = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    other = np.where(left, right_of, left_of)  # the only neighbour that a symbol could have joined
    there = np.where(left, after, before)
    low = np.where(there, np.minimum(level.low, level.low[other]), level.low)
    high = np.where(there, np.maximum(level.high, level.high[other]), level.high)
    edge = level.edge | ~there | level.edge[other]
    head = np.flatnonzero(~tail)
    pair = joins[head]
    following = right_of[head]
    name = np.where(pair, S.mixed(level.name[head] * U(S.BASES[0]) + S.mixed(level.name[following], seed + 1), seed), level.name[head])
    size = np.where(pair, level.size[head] + level.size[following], level.size[head])
    return Level(name, level.start[head], size, low[head], high[head], edge[head], level.opens[head])


def levels(values: np.ndarray, first: np.ndarray) -> list[Level]:
    n = len(values)
    opens = np.zeros(n, bool)
    opens[first[:-1][first[:-1] < first[1:]]] = True
    at = np.arange(n)
    out = [Level(values, at, np.ones(n, np.int64), at, at + 1, np.zeros(n, bool), opens)]
    for k in range(ROUNDS):
        out.append(name_pairs(name_runs(out[-1], 20 + 4 * k), 21 + 4 * k))
    return out


class Words(R.Method):
    reach = REACH

    def units(self, data, at):
        start, end, first = S.spans(data, at, WORD)
        return S.word_hashes(data, start, end), first

    def anchors(self, values, first):
        n = len(values)
        best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        for depth, level in enumerate(levels(values, first)):  # a symbol stands where the words begin that it depends on
            good = np.flatnonzero(~level.edge & (level.high - level.low <= REACH))
            low = level.low[good]
            rank = U(ROUNDS - depth) << U(62) | (S.mixed(level.name[good], 40 + depth) >> U(26)) << U(24) | low.astype(np.uint64)
            np.minimum.at(best, low, rank)
        least = R.lowest(best, R.WIDTH - REACH + 1)[: n - R.WIDTH + 1]
        return (least & U((1 << 24) - 1)).astype(np.int64)

    def piece(self, block, start, end):
        """The words, a space after each."""
        low, high, _ = S.spans(block.data, block.at, WORD)
        words = np.repeat(start, end - start) + R.ramp(end - start)
        size = high[words] - low[words] + 1
        content = block.data[np.minimum(np.repeat(low[words], size) + R.ramp(size), len(block.data) - 1)] if len(words) else np.zeros(0, np.uint8)
        content[np.cumsum(size) - 1] = 0x20
        return content, np.diff(np.append(0, np.cumsum(size))[np.append(0, np.cumsum(end - start))])

    def codes(self, content):
        """The words numbered by what they are, not by a hash."""
        ends = np.flatnonzero(content == 0x20)
        offsets = np.append(0, ends + 1).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(content))])
        return words.dictionary_encode().indices.to_numpy().astype(np.uint32)

    def settle(self, codes, count, doc):
        """Rounds of exact names, each for twice as many words as the one before; two names of 32 words make a window's."""
        name, have = codes.astype(np.int64), 1
        while have < R.WIDTH:
            step = min(have, R.WIDTH - have)
            pair = name[: len(name) - step] * np.int64(len(codes)) + name[step:]  # names are below the number of words
            _, name = np.unique(pair, return_inverse=True)
            have += step
        lengths = count + R.WIDTH - 1
        name = name[np.repeat(np.cumsum(lengths) - lengths, count) + R.ramp(count)]
        docs = np.repeat(doc, count)
        least = np.full(len(codes), R.NULL_ID)
        np.minimum.at(least, name, docs)
        return docs > least[name]

    def kept(self, data, at, first, gone):
        start, end, _ = S.spans(data, at, WORD)
        out = []
        whole = np.append(0, np.cumsum(gone))
        for k in range(len(at) - 1):
            low, high = first[k], first[k + 1]
            stay = np.flatnonzero(~gone[low:high]) + low if whole[high] - whole[low] else np.arange(low, high)
            out.append(b" ".join(data[at[k] : at[k + 1]].tobytes().split()) if len(stay) == high - low else b" ".join(data[a:b].tobytes() for a, b in zip(start[stay], end[stay], strict=True)))
        return out


def dedup_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_units (words), n_removed, spans (of words), kept (the words that are left, joined by one space)."""
    return R.without_repeats(docs, Words())
