"""Benchmark decontamination with a positional inverted index.

The training texts are cut into blocks of whole documents. Each block gets an index of its own, stored as one row: its
term dictionary, and for each term the list of positions where it stands. A search looks up the terms of a test window in
a block's dictionary, starts from the list of the rarest term, moves it back by the term's offset in the window and
intersects it with the other lists, moved likewise, from rare to frequent. What is left are the exact starts of the phrase
(slop 0), or of proximity matches (each term at most `slop` words from its place).

An index by document block needs no shuffle, and no term's list is ever in one place, however frequent the term is. Test
items are sent to the blocks in chunks of at most CHUNK_BYTES of text; there are as many passes over the stored index as
there are chunks.

Defined results: a null text has no words; rows keep their number, so a repeated row is reported as often as it is there;
a null item text has no windows; equal item texts count once each; without items nothing is hit; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import shared as S

#: Words: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
WORD = S.table_of(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WINDOW = 10
#: Bytes of test texts in one pass over the index; an item is never split.
CHUNK_BYTES = 4 << 20
INDEX_SCHEMA = "block long, doc_ids binary, first_word binary, terms binary, term_ends binary, counts binary, postings binary"
FOUND_SCHEMA = "block long, at int, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def words_of(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    data, at = S.utf8(column)
    data = S.lowered(data)
    start, end, first = S.spans(data, at, WORD)
    return S.packed(data, start, end), first


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text): one row per block. Postings are kept as differences of 32-bit positions."""

    def index(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for rows in S.blocks(batches):
            words, first = words_of(rows.column("text"))
            terms = words.dictionary_encode()
            ids = terms.indices.to_numpy()
            order = np.argsort(ids, kind="stable").astype(np.uint32)
            names, name_ends = S.utf8(terms.dictionary)
            ids_of_docs = rows.column("doc_id")
            known = ids_of_docs.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "doc_ids": [np.append(ids_of_docs.fill_null(0).to_numpy().astype(np.int64), known.astype(np.int64)).tobytes()],
                    "first_word": [first.astype(np.uint32).tobytes()],
                    "terms": [names.tobytes()],
                    "term_ends": [name_ends.astype(np.uint32).tobytes()],
                    "counts": [np.bincount(ids, minlength=len(name_ends) - 1).astype(np.uint32).tobytes()],
                    "postings": [np.diff(order, prepend=np.uint32(0)).tobytes()],
                }
            )
            number += 1

    return S.stored(S.texts(docs).mapInArrow(S.tidy(index), INDEX_SCHEMA), "postings")


class Windows:
    """The windows of some test items: item of each, term numbers in a vocabulary (-1 after a short window's end), length."""

    def __init__(self, item_ids: list[int], item_texts: list[str | None], size: int):
        words, first = words_of(pa.array(item_texts, pa.large_string()))
        terms = words.dictionary_encode()
        ids = terms.indices.to_numpy()
        n = np.diff(first)
        count = np.where(n > size, n - size + 1, (n > 0).astype(np.int64))
        item = np.repeat(np.arange(len(item_ids)), count)
        start = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        self.vocabulary = terms.dictionary
        self.item = np.asarray(item_ids, np.int64)[item] if len(item) else np.zeros(0, np.int64)
        self.length = np.minimum(n[item], size)
        place = np.arange(size)
        within = place < self.length[:, None]
        self.terms = np.where(within, ids[np.minimum(start[:, None] + place, max(len(ids) - 1, 0))] if len(ids) else -1, -1).astype(np.int64)


def intersect(windows: Windows, terms: pa.Array, counts: np.ndarray, order: np.ndarray, first: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which window starts where in a block. order: the block's positions, by term and then by position."""
    import pyarrow.compute as pc

    n = max(len(order), 1)
    found = pc.index_in(windows.vocabulary, value_set=terms).fill_null(-1).to_numpy().astype(np.int64)
    here = np.where(windows.terms >= 0, found[windows.terms] if len(found) else -1, -1)
    rows = np.flatnonzero(((here >= 0) | (windows.terms < 0)).all(axis=1) & (windows.length > 0))
    here, length = here[rows], windows.length[rows]
    frequency = np.where(here >= 0, counts[here] if len(counts) else 0, np.iinfo(np.int64).max)
    rank = np.argsort(frequency, axis=1, kind="stable")  # offsets, rarest term first
    list_start = np.cumsum(counts) - counts
    rarest, offset = here[np.arange(len(rows)), rank[:, 0]], rank[:, 0]
    many = counts[rarest] if len(rows) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(rows)), many)
    at = order[np.repeat(list_start[rarest] if len(rows) else many, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)].astype(np.int64)
    start = at - offset[which]
    doc = np.searchsorted(first, at, "right") - 1
    fits = (start >= first[doc]) & (start + length[which] <= first[doc + 1])
    which, start, doc = which[fits], start[fits], doc[fits]
    keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * n + order  # all lists, each moved to a range of its own
    for k in range(1, windows.terms.shape[1]):
        place = rank[which, k]
        term = here[which, place]
        want = start + place
        low = np.searchsorted(keys, term * n + np.maximum(want - slop, first[doc]))
        hit = keys[np.minimum(low, len(keys) - 1)] if len(keys) else low
        keep = (term < 0) | ((low < len(keys)) & (hit <= term * n + np.minimum(want + slop, first[doc + 1] - 1)) & (hit // n == term))
        which, start, doc = which[keep], start[keep], doc[keep]
    return rows[which], start


def search_index(index: DataFrame, items: list[tuple[int, str | None]], window: int = WINDOW, slop: int = 0) -> DataFrame:
    """For each document of the index: its words, the merged spans of words that matches cover, and the items matched."""
    sent = index.sparkSession.sparkContext.broadcast(Windows([i for i, _ in items], [t for _, t in items], window))

    def search(batches):
        windows = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), kind)  # noqa: B023, E731
                ids, first = get("doc_ids", np.int64), get("first_word", np.uint32).astype(np.int64)
                n_docs = len(first) - 1
                ends = get("term_ends", np.uint32).astype(np.int64)
                terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(batch.column("terms")[row].as_py())])
                counts = get("counts", np.uint32).astype(np.int64)
                order = np.cumsum(get("postings", np.uint32), dtype=np.uint32).astype(np.int64)
                which, start = intersect(windows, terms, counts, order, first, slop)
                doc = np.searchsorted(first, start, "right") - 1
                cover = np.zeros(first[-1] + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + windows.length[which], -1)
                inside = (np.cumsum(cover) > 0).astype(np.int8)
                inside[-1] = 0
                step = np.diff(inside, prepend=np.int8(0))
                step[first[:-1][(first[:-1] < first[1:])]] = inside[first[:-1][(first[:-1] < first[1:])]]  # runs end with their document
                opens = np.flatnonzero((step == 1) & (inside == 1))
                after = inside[1:] == 0
                edge = np.zeros(first[-1], bool)
                edge[first[1:][first[:-1] < first[1:]] - 1] = True
                closes = np.flatnonzero((inside[:-1] == 1) & (after | edge)) + 1
                span_doc = np.searchsorted(first, opens, "right") - 1
                pairs = np.unique(np.stack([doc, windows.item[which]], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
                span_at, item_at = np.searchsorted(span_doc, np.arange(n_docs + 1)), np.searchsorted(pairs[:, 0], np.arange(n_docs + 1))
                span_values = pa.StructArray.from_arrays([pa.array(opens - first[span_doc], pa.int64()), pa.array(closes - first[span_doc], pa.int64())], ["start", "end"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": np.repeat(batch.column("block")[row].as_py(), n_docs),
                        "at": np.arange(n_docs, dtype=np.int32),
                        "doc_id": pa.array(ids[:n_docs], pa.int64(), mask=ids[n_docs:] == 0),
                        "n_words": np.diff(first),
                        "spans": pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), span_values),
                        "items": pa.ListArray.from_arrays(pa.array(item_at, pa.int32()), pa.array(pairs[:, 1], pa.int64())),
                    }
                )

    return index.mapInArrow(S.tidy(search), FOUND_SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """For each row of docs: doc_id, n_words, spans (words covered by matches, merged, from the document's start), items (sorted), n_hit."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-total // CHUNK_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))
    index = build_index(docs)
    passes = [search_index(index, [(r[0], r[1]) for r in items.filter(part == k).collect()], window, slop) for k in range(chunks)]
    found = passes[0]
    if chunks > 1:
        for more in passes[1:]:
            found = found.unionByName(more)
        found = found.groupBy("block", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
        lambda a: a["n"],
    )
    return found.select("doc_id", "n_words", "spans", "items", covered.alias("n_hit"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a benchmark window, and without a row whose doc_id is that of such a document."""
    hit = contamination(docs, benchmark, window).filter("n_hit > 0").select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, docs["doc_id"].cast("long") == hit["hit_id"], "left_anti")
