"""Repeats of at least WIDTH units (words or bytes) across documents, found without moving the texts.

The texts are stored once, as blocks of whole documents in a table bucketed by block. Every window of WIDTH consecutive
units picks an anchor inside itself by a rule that sees nothing but the window, so equal windows pick the same anchor at
the same place. Neighbouring windows mostly pick the same one; a stretch of windows with one anchor is an occurrence. A
window that starts `left` units or more before its anchor covers the anchor's left context, any other one its right context;
so equal windows have a context in common. Two exchanges follow. In each, a block sends packed arrays to buckets and gets bits
back; the bits are joined to the bucketed blocks, so only they are shuffled.

1. names of contexts (30 bits in a bucket, each once a block): which are in two documents? No other window is looked at further.
2. pieces: the units under the windows of an occurrence over one context, each different piece once a block with its smallest doc_id.
   The operator's method settles a bucket: which windows stand in a document with a smaller doc_id? All verdicts come from there.

Names only choose what is looked at more closely; what is removed has been compared unit by unit, inside a block and inside a
bucket. A context found in more than HOT blocks has its windows dealt one by one in 2, so no bucket grows with one key; a key is
sent once by a block at most. The number of buckets follows the size of the texts.

A null doc_id counts as larger than all others, and as equal to another null. A text of any length is one row of a block; it is
looked at in stretches of STEP units, and places in it are 64-bit numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import shared as S

WIDTH = 50
#: A context in more blocks than this has its windows dealt one by one.
HOT = 4096
#: Bytes of text that one block holds at most, if it has more than one document.
BLOCK_BYTES = 1 << 20
#: Bytes of text for each bucket of an exchange.
BUCKET_BYTES = 8 << 20
#: Units that are looked at in one go; the windows' places must fit in 24 bits.
STEP = 1 << 20
NULL_ID = np.iinfo(np.int64).max
#: Bits that tell contexts of a bucket apart; its number stands above them.
LOW_BITS = 30
LOW = np.uint64((1 << LOW_BITS) - 1)
U = np.uint64


class Method:
    """How an operator cuts texts into units, picks anchors and settles windows. Pickled into the tasks."""

    #: Units from a window's anchor that the window covers at least; the choice of the anchor depends on no more.
    reach: int

    @property
    def left(self) -> int:
        """The left context starts so many units before the anchor; so both contexts have about the same size."""
        return (WIDTH - self.reach + 1) // 2

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit value for each unit, and each row's first unit (with the number of units at the end)."""
        raise NotImplementedError

    def anchors(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For every window start, the place of its anchor: at most WIDTH - reach units on (ignored where no window fits)."""
        raise NotImplementedError

    def piece(self, block: Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the units start ... end-1 of each piece, and how many they are; equal units have equal bytes."""
        raise NotImplementedError

    def codes(self, content: np.ndarray) -> np.ndarray:
        """The units of all pieces as small numbers, equal if and only if the units are: uint8 or uint32."""
        raise NotImplementedError

    def settle(self, codes: np.ndarray, count: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For all windows of these different pieces: is an equal one in a smaller document?"""
        raise NotImplementedError

    def kept(self, data: np.ndarray, at: np.ndarray, first: np.ndarray, gone: np.ndarray) -> list[bytes]:
        """What is left of each row."""
        raise NotImplementedError


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def occurrences(method: Method, values: np.ndarray, first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in each occurrence, and how far its anchor is from its first window's start. In order, they tile all windows."""
    places, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n = int(first[-1])
    row_end = np.repeat(first[1:], np.diff(first))
    for low in range(0, n - WIDTH + 1, step):
        high = min(n, low + step + WIDTH - 1)
        place = method.anchors(values[low:high], np.unique(np.clip(first, low, high)) - low)
        fits = np.flatnonzero(row_end[low : high - WIDTH + 1] - np.arange(low, high - WIDTH + 1) >= WIDTH)
        places.append(place[fits] + low)
        starts.append(fits + low)
    place, start = np.concatenate(places), np.concatenate(starts)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    opens = np.flatnonzero(new)
    return np.diff(np.append(opens, len(start))).astype(np.uint8), (place - start)[opens].astype(np.uint8)


class Block:
    """One block's occurrences, contexts and pieces; the same each time it is made from the same row."""

    def __init__(self, method: Method, row: dict, buckets: int):
        self.method, self.buckets = method, buckets
        self.data, self.at = np.frombuffer(row["data"], np.uint8), np.frombuffer(row["at"], np.int64)
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        values, self.first = method.units(self.data, self.at)
        self.roll = S.Rolling(S.mixed(values.astype(np.uint64), 11), S.BASES[1])
        self.count = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
        self.off = np.frombuffer(row["offs"], np.uint8).astype(np.int64)
        before = np.append(0, np.cumsum(np.maximum(np.diff(self.first) - WIDTH + 1, 0)))  # windows of earlier rows
        window = np.cumsum(self.count) - self.count
        doc = np.searchsorted(before, window, "right") - 1
        self.start = self.first[doc] + window - before[doc]
        self.doc = self.ids[doc] if len(doc) else window
        place, reach, back = self.start + self.off, method.reach, method.left
        left, right = np.flatnonzero(self.off >= back), np.flatnonzero(self.off - self.count + 1 < back)
        a = S.mixed(self.roll(place[left] - back, place[left] + reach), 3)
        b = S.mixed(self.roll(place[right], place[right] + WIDTH - back + 1), 4)
        self.context, of = np.unique(self.bucketed(np.concatenate([a, b])), return_inverse=True)
        self.left, self.right = np.full(len(self.start), -1), np.full(len(self.start), -1)
        self.left[left], self.right[right] = of[: len(left)], of[len(left) :]

    def bucketed(self, key: np.ndarray) -> np.ndarray:
        return ((key >> U(40)) % U(self.buckets)) << U(LOW_BITS) | key & LOW

    def split(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The buckets of sorted keys."""
        if not len(keys):
            return
        bucket = (keys >> U(LOW_BITS)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for low, high in zip(edges, np.append(edges[1:], len(keys)), strict=True):
            yield int(bucket[low]), slice(low, high)

    def spread(self) -> np.ndarray:
        """For each context: is it in two documents of this block?"""
        return several(len(self.context), [self.left, self.right], [self.doc, self.doc])

    def pieces(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """The pieces over shared contexts (or each of their windows by itself where the context is hot), and the different ones:
        key, bytes, windows, smallest doc_id."""
        of_left = np.clip(self.off - self.method.left + 1, 0, self.count)
        found = []
        for side, skip, count in ((self.left, np.zeros_like(of_left), of_left), (self.right, of_left, self.count - of_left)):
            some = np.flatnonzero(np.append(shared, False)[side] & (count > 0))
            single = hot[side[some]]
            times = np.where(single, count[some], 1)
            step, single, some = ramp(times), np.repeat(single, times), np.repeat(some, times)
            start = self.start[some] + skip[some] + step
            key = np.where(single, self.bucketed(S.mixed(self.roll(start, start + WIDTH), 13)), self.context[side[some]]) if len(some) else np.zeros(0, np.uint64)
            found.append((key, start, np.where(single, 1, count[some]), self.doc[some]))
        key, self.start_of, self.count_of, self.doc_of = (np.concatenate(x) for x in zip(*found, strict=True))
        name = self.roll(self.start_of, self.start_of + self.count_of + WIDTH - 1) + self.count_of.astype(np.uint64)
        order = np.lexsort((self.doc_of, name, key))
        key, name = key[order], name[order]
        self.start_of, self.count_of, self.doc_of = self.start_of[order], self.count_of[order], self.doc_of[order]
        content, lengths = self.method.piece(self, self.start_of, self.start_of + self.count_of + WIDTH - 1)
        at = np.append(0, np.cumsum(lengths))
        alike = np.zeros(len(key), bool)
        alike[1:] = (key[1:] == key[:-1]) & (name[1:] == name[:-1]) & (self.count_of[1:] == self.count_of[:-1]) & (lengths[1:] == lengths[:-1])
        again = np.flatnonzero(alike)  # names are alike: are the bytes those of the piece before?
        size = lengths[again]
        place = np.repeat(at[again], size) + ramp(size)
        wrong = content[place] != content[place - np.repeat(size, size)]
        alike[again[np.add.reduceat(wrong, np.cumsum(size) - size) > 0] if len(again) else again] = False
        top = np.flatnonzero(~alike)
        self.piece_of = np.cumsum(~alike) - 1
        self.piece_key, self.piece_count, self.piece_doc, self.piece_length = key[top], self.count_of[top], self.doc_of[top], lengths[top]
        self.content = content[np.repeat(at[top], lengths[top]) + ramp(lengths[top])]

    def removed(self, found: np.ndarray) -> np.ndarray:
        """For each unit: is it covered by a window that starts in a smaller document, too? found: the different pieces' windows."""
        base = np.cumsum(self.piece_count) - self.piece_count
        some = found[np.repeat(base[self.piece_of], self.count_of) + ramp(self.count_of)] | np.repeat(self.doc_of > self.piece_doc[self.piece_of], self.count_of)
        start = (np.repeat(self.start_of, self.count_of) + ramp(self.count_of))[some]
        n = int(self.first[-1])
        cover = np.bincount(start, minlength=n + 1) - np.bincount(start + WIDTH, minlength=n + 1)
        return np.cumsum(cover[:n]) > 0


def several(size: int, index: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """For each number below size: do different values stand at its places? -1 is no place."""
    if not size:
        return np.zeros(0, bool)
    kind = np.iinfo(values[0].dtype)
    low, high = np.full(size, kind.max, values[0].dtype), np.full(size, kind.min, values[0].dtype)
    for i, v in zip(index, values, strict=True):
        some = i >= 0
        np.minimum.at(low, i[some], v[some])
        np.maximum.at(high, i[some], v[some])
    return low < high


def ramp(counts: np.ndarray) -> np.ndarray:
    """0 ... c-1 for each c."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def narrow(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in as few bytes as the largest takes."""
    steps = np.diff(keys, prepend=U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(packed: bytes) -> np.ndarray:
    width = packed[0]
    out = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(out.view("<u8")[:, 0], dtype=np.uint64)


def squeezed(content: np.ndarray) -> bytes:
    """The bytes compressed, after their number."""
    return len(content).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(content.tobytes(), asbytes=True)


def spread_out(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True), np.uint8)


def numbers(count: np.ndarray, doc: np.ndarray) -> bytes:
    """One byte for each count; doc_ids in four bytes where they fit, or eight."""
    small = not len(doc) or bool(doc.min() >= 0 and doc.max() < 1 << 32)
    return bytes([small]) + count.astype(np.uint8).tobytes() + doc.astype("<u4" if small else "<i8").tobytes()


def numbers_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.dtype("<u4" if packed[0] else "<i8")
    n = (len(packed) - 1) // (1 + kind.itemsize)
    return np.frombuffer(packed, np.uint8, n, 1).astype(np.int64), np.frombuffer(packed, kind, n, 1 + n).astype(np.int64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def joined(answers: list[dict] | None, name: str, sizes: list[tuple[int, int]]) -> np.ndarray:
    """The flags that came back from all buckets, in the order of the keys. sizes: bucket, number of flags."""
    by = {a["bucket"]: a[name] for a in answers or []}
    return np.concatenate([flags(by[b], n) for b, n in sizes]) if sizes else np.zeros(0, bool)


def answer_names(rows: list[dict], hot: int) -> list[tuple[bytes, bytes]]:
    """1: is a name in two blocks, or in two documents of one; is it in more than `hot` blocks?"""
    keys = [widened(r["a"]) for r in rows]
    spread = [flags(r["b"], len(k)) for r, k in zip(rows, keys, strict=True)]
    _, of, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    twice = times > 1
    twice[of[np.concatenate(spread)]] = True
    ends = np.cumsum([len(k) for k in keys])[:-1]
    return [(bits(x), bits(y)) for x, y in zip(np.split(twice[of], ends), np.split((times > hot)[of], ends), strict=True)]


def packed_columns(codes: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Each piece's codes as 64-bit numbers that sort like them, column by column; zeros stand after its end."""
    each = 8 // codes.itemsize
    width = 8 * codes.itemsize
    first = np.cumsum(size) - size
    out = []
    for low in range(0, int(size.max(initial=0)), each):
        column = np.zeros(len(size), np.uint64)
        for k in range(low, low + each):
            some = np.flatnonzero(size > k)
            column[some] |= codes[first[some] + k].astype(np.uint64) << U(64 - width * (k - low + 1))
        out.append(column)
    return out


def answer_pieces(method: Method, rows: list[dict]) -> list[tuple[bytes, bytes]]:
    """2: for each window of each piece: is an equal one in a smaller document?

    The pieces are sorted by key and by all their units. Neighbours that agree to the end are copies, and the smallest doc_id settles
    them. Where a key has different pieces, the method compares the windows of one copy of each.
    """
    key, count, doc = (np.concatenate(x) for x in zip(*[(widened(r["a"]), *numbers_of(r["c"])) for r in rows], strict=True))
    codes = method.codes(np.concatenate([spread_out(r["b"]) for r in rows]))
    size = count + WIDTH - 1
    columns = [*packed_columns(codes, size)[::-1], size, key]
    order = np.lexsort((doc, *columns))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    top, of = order[new], np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    several_here = np.zeros(len(top), bool)
    same_key = key[top][1:] == key[top][:-1]
    several_here[1:] |= same_key
    several_here[:-1] |= same_key
    rest = top[several_here]
    first = np.cumsum(size) - size
    smaller = np.zeros(count[top].sum(), bool)
    base = np.cumsum(count[top]) - count[top]
    if len(rest):
        found = method.settle(codes[np.repeat(first[rest], size[rest]) + ramp(size[rest])], count[rest], doc[rest])
        smaller[np.repeat(base[several_here], count[rest]) + ramp(count[rest])] = found
    out = smaller[np.repeat(base[of], count) + ramp(count)] | np.repeat(doc > doc[top][of], count)
    n = [len(numbers_of(r["c"])[0]) for r in rows]
    windows = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(n))]
    return [(bits(out[a:b]), b"") for a, b in zip(windows[:-1], windows[1:], strict=True)]


SENT = "bucket int, block long, a binary, b binary, c binary"
ANSWER = "bucket int, block long, x binary, y binary"


def sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "block", "a", "b", "c"])


def blocked(docs: DataFrame, method: Method, buckets: int, block_bytes: int, step: int) -> DataFrame:
    """docs as blocks, with their occurrences, in a table of the shared warehouse, bucketed by block."""

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for rows in S.blocks(batches, block_bytes):
            data, at = S.utf8(rows.column("text"))
            ids = rows.column("doc_id").fill_null(NULL_ID).to_numpy().astype(np.int64)
            counts, offs = occurrences(method, *method.units(data, at), step)
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "doc_ids": [ids.tobytes()], "at": [at.tobytes()], "data": [data.tobytes()], "counts": [counts.tobytes()], "offs": [offs.tobytes()]})
            number += 1

    spark, name = docs.sparkSession, f"fathom_blocks_{uuid.uuid4().hex}"
    cut_rows = S.texts(docs).mapInArrow(S.tidy(cut), "block long, doc_ids binary, at binary, data binary, counts binary, offs binary")
    cut_rows.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    S.keep_table(name)
    return spark.table(name)


def without_repeats(docs: DataFrame, method: Method, hot: int = HOT, block_bytes: int = BLOCK_BYTES, step: int = STEP) -> DataFrame:
    """For each row of docs: doc_id, n_units, n_removed, spans (removed units, maximal runs), kept (bytes that are left)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocked(docs, method, parts, block_bytes, step)
    size = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = min(1 << 24, max(16, size // BUCKET_BYTES))

    def made(row: dict, upto: int) -> Block:
        """The block as far as the answers go."""
        block = Block(method, row, buckets)
        if upto >= 1:
            sizes = [(b, s.stop - s.start) for b, s in block.split(block.context)]
            block.pieces(joined(row["x1"], "x", sizes), joined(row["x1"], "y", sizes))
        return block

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.slice(k, 1).to_pylist()[0]

    def send_names(batches):
        for row in each(batches):
            block = made(row, 0)
            spread = block.spread()
            yield sent([(b, row["block"], narrow(block.context[s] & LOW), bits(spread[s]), b"") for b, s in block.split(block.context)])

    def send_pieces(batches):
        for row in each(batches):
            block = made(row, 1)
            ends = np.append(0, np.cumsum(block.piece_length))
            yield sent([(b, row["block"], narrow(block.piece_key[s] & LOW), squeezed(block.content[ends[s.start] : ends[s.stop]]), numbers(block.piece_count[s], block.piece_doc[s])) for b, s in block.split(block.piece_key)])

    def answered(source: DataFrame, send, answer, name: str) -> DataFrame:
        """The answers to what the blocks of source send, one row for each block."""

        def reduce(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            out = answer(rows)
            return pa.table({"bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "block": pa.array([r["block"] for r in rows], pa.int64()), "x": pa.array([x for x, _ in out], pa.binary()), "y": pa.array([y for _, y in out], pa.binary())})

        back = source.mapInArrow(S.tidy(send), SENT).groupBy("bucket").applyInArrow(reduce, ANSWER)
        return S.stored(back.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "x", "y")).alias(name)), f"answers-{name}")

    def with_answers(*answers: DataFrame) -> DataFrame:
        out = blocks
        for a in answers:
            out = out.join(a.hint("shuffle_hash"), "block", "left")
        return out

    first = answered(blocks, send_names, lambda rows: answer_names(rows, hot), "x1")
    second = answered(with_answers(first), send_pieces, lambda rows: answer_pieces(method, rows), "x2")

    def finish(batches):
        for row in each(batches):
            block = made(row, 1)
            gone = block.removed(joined(row["x2"], "x", [(b, int(block.piece_count[s].sum())) for b, s in block.split(block.piece_key)]))
            n_docs, first_unit = len(block.ids), block.first
            total = np.append(0, np.cumsum(gone))
            some = first_unit[:-1] < first_unit[1:]
            begin, last = first_unit[:-1][some], first_unit[1:][some] - 1
            opens, closes = gone.copy(), gone.copy()
            opens[1:] &= ~gone[:-1]
            opens[begin] = gone[begin]
            closes[:-1] &= ~gone[1:]
            closes[last] = gone[last]
            low, high = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            doc = np.searchsorted(first_unit, low, "right") - 1
            values = pa.StructArray.from_arrays([pa.array(low - first_unit[doc], pa.int64()), pa.array(high - first_unit[doc], pa.int64())], ["start", "end"])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(block.ids, pa.int64(), mask=block.ids == NULL_ID),
                    "n_units": np.diff(first_unit),
                    "n_removed": np.diff(total[first_unit]),
                    "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), values),
                    "kept": pa.array(method.kept(block.data, block.at, first_unit, gone), pa.binary()),
                }
            )

    return with_answers(first, second).mapInArrow(S.tidy(finish), "doc_id long, n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
