"""Substring dedup on bytes with blockwise suffix arrays.

A window of 50 bytes is anchored at the gram of GRAM bytes inside it with the smallest hash; windows whose contexts stand in
one document only can't repeat (see repeats.py). The suffixes at all other windows are dealt into buckets by the context of their anchor,
which equal windows have in common, as pieces: the bytes under the windows of one anchor. A bucket's pieces are sorted by all
their bytes, so copies stand together; then the suffixes at the windows of the different ones are sorted blockwise:

* The sample is ranked beforehand, over all of the bucket's text, to the depth that matters. It holds the positions whose
  remainders modulo the period are in a difference cover, so any two suffixes have a common shift below the period that takes
  both into the sample.
* Suffix buckets of SUFFIXES suffixes or so, which are ranges of leading bytes, are sorted one at a time: by their first eight bytes,
  and where these tie by the ranks of the sample at the common shift. So memory beyond text and ranks is that of one bucket.

Neighbours in the sorted order whose common prefix reaches 50 bytes, which is looked up in the bytes, are equal windows; each
group's smallest doc_id settles what goes.

Defined results: null and empty texts lose nothing; texts under 50 bytes lose nothing; rows that repeat a doc_id never
remove each other's bytes; a null doc_id counts as the largest; ties in the order of suffixes are equal windows and decide nothing; very
long texts are whole rows of a block; other columns are ignored. What is kept need not be UTF-8.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from fathom.llm import repeats as R
from fathom.llm import shared as S

GRAM = 12
#: Suffixes that are sorted in one go, if their first eight bytes are not all the same.
SUFFIXES = 1 << 18
U = np.uint64
#: Difference covers by period: every remainder is a difference of two of the numbers. Shifts stay within the eight bytes
#: that tied suffixes share, so a period is 9 at most.
COVERS = {3: (0, 1), 7: (0, 1, 3)}
PERIOD = 7


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number that sorts like them; zeros stand after the end."""
    out = np.zeros(len(data), np.uint64)
    padded = np.append(data, np.zeros(7, np.uint8))
    for k in range(8):
        out |= padded[k : k + len(data)].astype(np.uint64) << U(56 - 8 * k)
    return out


def sample_ranks(eight: np.ndarray, sample: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the sampled suffixes by their first `depth` bytes (rounded up to eights); -1 elsewhere."""
    n = len(eight)
    rank = np.full(n, -1, np.int64)
    if not len(sample):
        return rank
    _, now = np.unique(eight[sample], return_inverse=True)
    for step in range(8, depth, 8):
        sizes = np.bincount(now)
        tied = np.flatnonzero(sizes[now] > 1)
        if not len(tied):
            break
        at = sample[tied] + step
        key = np.where(at < n, eight[np.minimum(at, n - 1)], U(0))
        order = np.lexsort((key, now[tied]))
        group, key = now[tied][order], key[order]
        starts = np.ones(len(order), bool)
        starts[1:] = np.diff(group) != 0
        new = starts.copy()
        new[1:] |= key[1:] != key[:-1]
        first = np.cumsum(sizes) - sizes  # ranks become the number of smaller suffixes, so that groups can be split in place
        index = np.arange(len(order))
        base = np.maximum.accumulate(np.where(starts, index, 0))
        value = first[group] + np.maximum.accumulate(np.where(new, index, 0)) - base
        spread = first[now]
        spread[tied[order]] = value
        _, now = np.unique(spread, return_inverse=True)
    rank[sample] = now
    return rank


def sorted_suffixes(data: np.ndarray, wanted: np.ndarray, depth: int = R.WIDTH, period: int = PERIOD, limit: int = SUFFIXES) -> np.ndarray:
    """The suffixes at `wanted`, sorted by their first `depth` bytes at least."""
    eight = words8(data)
    sample = np.flatnonzero(np.isin(np.arange(period), COVERS[period])[np.arange(len(data)) % period])
    rank = np.append(sample_ranks(eight, sample, depth), np.full(period, -1))
    edges = np.unique(np.sort(eight[wanted])[limit::limit])
    if not len(edges):
        return one_bucket(eight, rank, wanted, period)
    bucket = np.searchsorted(edges, eight[wanted], "right")
    return np.concatenate([one_bucket(eight, rank, wanted[bucket == b], period) for b in range(len(edges) + 1)])


def one_bucket(eight: np.ndarray, rank: np.ndarray, wanted: np.ndarray, period: int) -> np.ndarray:
    """These suffixes, sorted by their first eight bytes and then by the sample's ranks."""
    cover = COVERS[period]
    order = wanted[np.argsort(eight[wanted], kind="stable")]
    key = eight[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(order) else np.zeros(0, np.int64)
    if not len(tied):
        return order
    ties, of = order[tied], group[tied]
    span = np.int64(len(rank) + 2)
    below = np.zeros(len(ties), np.int64)  # suffixes of the same group that come before
    kind = ties % period
    members = [np.flatnonzero(kind == c) for c in range(period)]
    for a in range(period):
        for b in range(period):
            if len(members[a]) and len(members[b]):
                shift = next(k for k in range(period) if (a + k) % period in cover and (b + k) % period in cover)
                score = lambda m: of[m] * span + rank[ties[m] + shift] + 1  # noqa: B023, E731
                mine, theirs = score(members[a]), np.sort(score(members[b]))
                below[members[a]] += np.searchsorted(theirs, mine) - np.searchsorted(theirs, of[members[a]] * span)
    order[tied] = ties[np.lexsort((below, of))]
    return order


class Bytes(R.Method):
    reach = GRAM

    def units(self, data, at):
        return data, at

    def anchors(self, values, first):
        n = len(values)
        roll = S.Rolling(S.mixed(np.arange(256, dtype=np.uint64), 31)[values], S.BASES[0])
        grams = S.mixed((roll.sums[GRAM:] - roll.sums[: n + 1 - GRAM]) * roll.inverse[: n + 1 - GRAM], 33)
        rank = (grams >> U(24)) << U(24) | np.arange(len(grams), dtype=np.uint64)
        return (R.lowest(rank, R.WIDTH - self.reach + 1) & U((1 << 24) - 1)).astype(np.int64)

    def piece(self, block, start, end):
        lengths = end - start
        return block.data[np.repeat(start, lengths) + R.ramp(lengths)], lengths

    def codes(self, content):
        return content

    def settle(self, codes, count, doc):
        lengths = count + R.WIDTH - 1
        wanted = np.repeat(np.cumsum(lengths) - lengths, count) + R.ramp(count)
        docs = np.full(len(codes), R.NULL_ID)
        docs[wanted] = np.repeat(doc, count)
        order = sorted_suffixes(codes, wanted)
        eight = words8(codes)
        alike = np.ones(len(order) - 1, bool)  # is the common prefix of neighbours at least WIDTH bytes?
        for step in [*range(0, R.WIDTH - 8, 8), R.WIDTH - 8]:
            alike &= eight[order[1:] + step] == eight[order[:-1] + step]
        head = np.flatnonzero(np.append(True, ~alike))
        least = np.repeat(np.minimum.reduceat(docs[order], head), np.diff(np.append(head, len(order))))
        smaller = np.zeros(len(codes), bool)
        smaller[order] = docs[order] > least
        return smaller[wanted]

    def kept(self, data, at, first, gone):
        return [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_units (bytes), n_removed, spans (of bytes), kept (the bytes that are left)."""
    return R.without_repeats(docs, Bytes())
