"""Best-fit packing by large-item matching, on the histogram of lengths.

Documents are tokenised, closed with an end id and cut into pieces only where they are longer than a sequence. How pieces
share sequences depends on nothing but how many there are of each length, which is a table of at most `capacity` numbers
however large the corpus is. Pieces longer than a third of the capacity can share a sequence with one other such piece at
most: from the longest on, each is matched with the longest one that still fits. The rest fill the gaps, longest first and
each in the smallest gap that takes it, and open new sequences when none does. Sequences with equal contents are handled
together, so the plan stays small; each length's pieces are numbered (by task, then within it) and look up their place.

Defined results: a null or empty text is a piece of one end id; repeated rows are packed as often as they are there; other
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm import shared as S
from fathom.llm import tokens

CAPACITY = 2048
END = 0
CUT = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, number long"


def cut_pieces(docs: DataFrame, path: str, capacity: int, end: int, keep_ids: bool = False) -> DataFrame:
    """The stored pieces of docs; each has its number among those of its task and length."""

    def cut(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows in S.blocks(batches, 2 * S.BLOCK_BYTES):
            ids, first = tokens.with_end(*tokens.encoder(path).encode(rows.column("text")), end)
            size = np.diff(first)
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = size - (count - 1) * capacity  # the first piece takes what is left over
            start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[row])
            raw, low = ids.astype("<u4"), first[row] + start
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(low.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_length = length[order]
            within = np.arange(len(order)) - np.searchsorted(sorted_length, sorted_length)
            number = np.empty(len(order), np.int64)
            number[order] = seen[sorted_length] + within
            seen += np.bincount(length, minlength=capacity + 1)
            out = {"doc_id": rows.column("doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length.astype(np.int32), "ids_crc32": pa.array(crc, pa.int64()), "task": np.full(len(row), task, np.int32), "number": number}
            if keep_ids:
                out["ids"] = pa.array([raw[a : a + n].tobytes() for a, n in zip(low.tolist(), length.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return S.stored(S.texts(docs).mapInArrow(S.tidy(cut), CUT + ", ids binary" * keep_ids), "pieces")


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first number, pieces, first sequence, offset, pieces of this length side by side), and the number of sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    by_gap: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]  # sequences alike: how many, [(length, pieces in each)]
    open_at = np.zeros(capacity + 1, np.int64)

    def add(count: int, gap: int, items: list[tuple[int, int]]) -> None:
        if count:
            by_gap[gap].append((count, items))
            open_at[gap] += 1

    third = capacity // 3
    for length in range(capacity, third, -1):
        while left[length]:
            fits = np.flatnonzero(left[third + 1 : min(length, capacity - length) + 1])
            partner = third + 1 + int(fits[-1]) if len(fits) else 0
            if partner == length and left[length] == 1:  # the longest other one
                partner = third + 1 + int(fits[-2]) if len(fits) > 1 else 0
            if not partner:
                add(int(left[length]), capacity - length, [(length, 1)])
                left[length] = 0
            elif partner == length:
                add(int(left[length] // 2), capacity - 2 * length, [(length, 2)])
                left[length] %= 2
            else:
                pairs = int(min(left[length], left[partner]))
                add(pairs, capacity - length - partner, [(length, 1), (partner, 1)])
                left[length] -= pairs
                left[partner] -= pairs
    for length in range(third, 0, -1):
        while left[length]:
            fits = np.flatnonzero(open_at[length:])
            if len(fits):
                gap = length + int(fits[0])
                count, items = by_gap[gap].pop()
                open_at[gap] -= 1
            else:
                gap, items = capacity, []
                count = int(-(-left[length] // (capacity // length)))
            each = gap // length
            full = int(min(count, left[length] // each))
            add(full, gap - each * length, [*items, (length, each)])
            left[length] -= full * each
            rest = int(left[length]) if full < count else 0
            if rest:
                add(1, gap - rest * length, [*items, (length, rest)])
                left[length] = 0
            if items:
                add(count - full - bool(rest), gap, items)
    rows, sequences, given = [], 0, np.zeros(capacity + 1, np.int64)
    for groups in by_gap:
        for count, items in groups:
            offset = 0
            for length, each in items:
                rows.append((length, given[length], count * each, sequences, offset, each))
                given[length] += count * each
                offset += length * each
            sequences += count
    return np.array(sorted(rows), np.int64).reshape(-1, 6), sequences


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    counts = S.stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(histogram, capacity)
    sent = pieces.sparkSession.sparkContext.broadcast(rows)  # its size depends on the capacity alone
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))

    def place(batches):
        rows = sent.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy() + batch.column("base").to_numpy()
            row = rows[np.searchsorted(key, length << 44 | number, "right") - 1]
            step = number - row[:, 1]
            columns = {name: batch.column(name) for name in batch.schema.names if name not in ("task", "number", "base")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": row[:, 3] + step // row[:, 5], "offset": row[:, 4] + step % row[:, 5] * length})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("task", "number"))
    return pieces.join(base.hint("shuffle_merge"), ["task", "length"]).select(*pieces.columns, "base").mapInArrow(S.tidy(place), kinds + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """For each piece of docs: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return packed(cut_pieces(docs, path, capacity, end, keep_ids), capacity)
