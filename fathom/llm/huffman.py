"""Token ids in a compact binary form: canonical length-limited Huffman codes from the counts of the whole corpus.

A file (one row of the stored table, so that any store that Spark writes to will do) is self-contained:

    magic 8 bytes | header: 6 little-endian 64-bit numbers (vocabulary, documents, ids, ids in a block, bytes of the packed
    code lengths, bytes of bits) | code lengths, one byte an id, zlib | doc_ids, 64 bits | 1 if the doc_id is known, 1 byte |
    ids of each document, 64 bits | bit offset of each block, 64 bits | bits, most significant first

Code words are canonical (by length, then id), so the lengths are enough to rebuild them. Blocks hold BLOCK ids and can be
decoded alone from their checkpoint; a file is decoded with all its blocks in step, one table look-up per id.

Defined results: files are in ascending order of doc_id, null last; rows that repeat a doc_id follow each other by the
checksum of their ids; a null or empty text is one end id; other columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm import shared as S
from fathom.llm import tokens

MAGIC = b"FTHMHUF1"
END = 2
BLOCK = 256
#: Bits of a code word at most.
LIMIT = 18
#: Ids that are encoded in one go; a multiple of BLOCK.
STRETCH = 1 << 16
#: Ids in a file, unless one document has more.
FILE_IDS = 2_000_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most `limit` bits for the ids that occur (package-merge); 0 for the others."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than code words")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    merged, leaves = weight, []
    leaves.append(np.ones(len(weight), bool))
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        leaves.append(by < len(weight))
    length, take = np.zeros(len(weight), np.int64), 2 * len(weight) - 2
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code word of each id, and the ids by code word."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    top = int(lengths.max(initial=1))
    room = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
    start = np.cumsum(room) - room  # code words filled up with zeros to the longest length
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = start >> (top - lengths[order]).astype(np.uint64)
    return codes, order


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, and each block's bit offset. A code word lies in one or two 32-bit words."""
    widths = lengths.astype(np.int64)
    offsets = np.zeros(-(-len(ids) // BLOCK), np.int64)
    parts, at = [], 0
    for low in range(0, len(ids), STRETCH):
        part = ids[low : low + STRETCH]
        size = widths[part]
        end = np.cumsum(size) + at
        start = end - size
        offsets[low // BLOCK : low // BLOCK + -(-len(part) // BLOCK)] = start[::BLOCK]
        parts.append(words_of(start, codes[part] << (64 - size - (start & 31)).astype(np.uint64)))
        at = int(end[-1])
    out = np.zeros(at // 32 + 2, np.uint64)
    for first, word in parts:
        out[first : first + len(word)] += word
    return out.astype(">u4").tobytes()[: (at + 7) // 8], offsets


def words_of(start: np.ndarray, shifted: np.ndarray) -> tuple[int, np.ndarray]:
    """The first 32-bit word these codes lie in, and all their words."""
    word = start >> 5
    head = np.flatnonzero(np.diff(word, prepend=word[0] - 1))
    both = np.add.reduceat(shifted, head)
    at = word[head] - word[0]
    out = np.zeros(int(at[-1]) + 2, np.uint64)
    out[at] = both >> np.uint64(32)
    out[at + 1] += both & np.uint64(0xFFFFFFFF)
    return int(word[0]), out


def decode(packed: bytes, offsets: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """The n ids of these bits; all blocks advance together."""
    _, order = canonical(lengths)
    top = int(lengths.max(initial=1))
    symbol = np.zeros(1 << top, np.uint32)
    filled = np.repeat(order.astype(np.uint32), 1 << (top - lengths[order]).astype(np.int64))
    symbol[: len(filled)] = filled
    step = np.zeros(1 << top, np.int64)
    step[: len(filled)] = lengths[filled]
    data = np.frombuffer(packed + bytes(8), np.uint8).astype(np.uint32)
    four = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
    out = np.zeros((len(offsets), BLOCK), np.uint32)
    at = offsets.astype(np.int64)
    last = n - (len(offsets) - 1) * BLOCK
    for k in range(BLOCK):
        live = at if k < last else at[:-1]
        if not len(live):
            break
        code = (four[live >> 3] >> (32 - top - (live & 7)).astype(np.uint32)) & np.uint32((1 << top) - 1)
        out[: len(live), k] = symbol[code]
        at[: len(live)] += step[code]
    return out.reshape(-1)[:n]


def file_bytes(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    bits, offsets = encode(ids, lengths, codes)
    table = zlib.compress(lengths.tobytes(), 6)
    header = np.array([len(lengths), len(doc_ids), len(ids), BLOCK, len(table), len(bits)], "<i8")
    return b"".join([MAGIC, header.tobytes(), table, doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), counts.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), bits])


def parse(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, which are known, ids of each document, all ids."""
    if content[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    vocabulary, docs, n, block, table, size = np.frombuffer(content, "<i8", 6, 8).tolist()
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    low = 56
    lengths = np.frombuffer(zlib.decompress(content[low : low + table]), np.uint8)
    low += table
    doc_ids = np.frombuffer(content, "<i8", docs, low)
    known = np.frombuffer(content, np.uint8, docs, low + 8 * docs).astype(bool)
    counts = np.frombuffer(content, "<i8", docs, low + 9 * docs)
    low += 17 * docs
    blocks = -(-n // BLOCK)
    offsets = np.frombuffer(content, "<i8", blocks, low)
    assert len(lengths) == vocabulary
    return doc_ids, known, counts, decode(content[low + 8 * blocks : low + 8 * blocks + size], offsets, n, lengths)


def write_files(docs: DataFrame, path: str, end: int = END, limit: int = LIMIT) -> DataFrame:
    """The stored files of docs: part and number give their order, n_before the ids of the same part in files before, n_ids, content."""
    spark = docs.sparkSession

    def tokenise(batches):
        for rows in S.blocks(batches, 2 * S.BLOCK_BYTES):
            ids, first = tokens.with_end(*tokens.encoder(path).encode(rows.column("text")), end)
            raw = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids.astype("<u4")
            parts = [raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "check": pa.array(map(zlib.crc32, parts), pa.int64()), "width": np.full(len(parts), raw.itemsize, np.int32), "ids": pa.array(parts, pa.binary())})

    rows = S.stored(S.texts(docs).mapInArrow(S.tidy(tokenise), "doc_id long, check long, width int, ids binary"), "token-ids")

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for width, kind in ((2, "<u2"), (4, "<u4")):
                import pyarrow.compute as pc

                data, _ = S.utf8(batch.column("ids").filter(pc.equal(batch.column("width"), width)))
                seen = np.bincount(np.frombuffer(data.tobytes(), kind))
                if len(seen) > len(total):
                    total = np.append(total, np.zeros(len(seen) - len(total), np.int64))
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used, "n": total[used]})

    counted = rows.select("width", "ids").mapInArrow(S.tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    counts = np.zeros(max((r["id"] for r in counted), default=end) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    sent = spark.sparkContext.broadcast((lengths, canonical(lengths)[0]))

    def write(batches):
        from pyspark import TaskContext

        lengths, codes = sent.value
        part, number, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            width = batch.column("width").to_numpy()
            sizes = np.diff(S.utf8(batch.column("ids"))[1]) // width
            low = 0
            while low < batch.num_rows:  # files of whole documents
                total = np.cumsum(sizes[low:])
                high = low + max(1, int(np.searchsorted(total, FILE_IDS, "right")))
                rows = batch.slice(low, high - low)
                data, cuts = S.utf8(rows.column("ids"))
                if (width[low:high] == 2).all():
                    ids = np.frombuffer(data.tobytes(), "<u2")
                else:
                    ids = np.concatenate([np.frombuffer(data[a:b].tobytes(), f"<u{w}").astype(np.uint32) for a, b, w in zip(cuts[:-1], cuts[1:], width[low:high], strict=True)])
                doc_ids = rows.column("doc_id")
                content = file_bytes(doc_ids.fill_null(0).to_numpy(), doc_ids.is_valid().to_numpy(zero_copy_only=False), sizes[low:high], ids, lengths, codes)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int64()), "n_before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "content": pa.array([content], pa.binary())})
                number, before, low = number + 1, before + len(ids), high

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_last(), F.col("check").asc()]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return S.stored(ordered.mapInArrow(S.tidy(write), "part int, number long, n_before long, n_ids long, content binary"), "token-files")


def read_files(files: DataFrame, keep_ids: bool = False) -> DataFrame:
    """For each document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of 32-bit ids), (ids)."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each partition that wrote files

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, known, counts, ids = parse(batch.column("content")[k].as_py())
                start = np.cumsum(counts) - counts
                raw = ids.astype("<u4")
                parts = [raw[a : a + n] for a, n in zip(start.tolist(), counts.tolist(), strict=True)]
                out = {"doc_id": pa.array(doc_ids, pa.int64(), mask=~known), "start": start + batch.column("base")[k].as_py() + batch.column("n_before")[k].as_py(), "n_tokens": counts, "ids_crc32": pa.array(map(zlib.crc32, parts), pa.int64())}
                if keep_ids:
                    out["ids"] = pa.array([x.tobytes() for x in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return files.join(F.broadcast(base), "part").select("base", "n_before", "content").mapInArrow(S.tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
