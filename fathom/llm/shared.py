"""What the training-data operators have in common: stored tables, text blocks, words and 64-bit mixing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import runtime

#: Bytes of text that one block holds at most, if it has more than one document.
BLOCK_BYTES = 4 << 20
#: The same for functions whose arrays take dozens of times a block's bytes: executors hold such a worker for each core beside a grown heap.
SMALL_BLOCK_BYTES = 1 << 20
#: `[^\x20\x09-\x0D]+`
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, the context's checkpoint folder or, where both are unset, one in the warehouse."""
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not spark.conf.get("spark.checkpoint.dir", None) and set_dir.isDefined():
        return set_dir.get().rstrip("/")
    return runtime.shared_dir(spark)


#: What is stored and not removed yet: folders and, for bucketed blocks, tables of the warehouse.
_folders: list[str] = []
_tables: list[str] = []
_passing: list[list[str]] = []


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and survives lost executors. `keep` outlasts
    the innermost `passing`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folders = _passing[:-1] if keep else _passing
    (folders[-1] if folders else _folders).append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is stored inside goes at the end, but for what is to be kept; so do the shuffles that nothing refers to any more."""
    paths: list[str] = []
    _passing.append(paths)
    try:
        yield
    finally:
        _passing.remove(paths)
        removed(spark, paths)
        gc.collect()
        spark._jvm.System.gc()


def keep_table(name: str) -> None:
    """Have remove_stored drop this table of the warehouse, too."""
    _tables.append(name)


def remove_stored(spark: SparkSession) -> None:
    """Remove all intermediate tables of this process. Frames that the operators have returned can't be read afterwards."""
    removed(spark, _folders)
    _folders.clear()
    for table in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    _tables.clear()


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that docs has no column of."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text with null as empty; other columns are left behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in more])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each row starts and the last one ends. Nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8) if ends is not None and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices with at most `limit` bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column("text"))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


_at_end: list[Callable[[], None]] = []


def at_end(clean: Callable[[], None]) -> None:
    """Have something called whenever a task of a tidy function ends."""
    if clean not in _at_end:
        _at_end.append(clean)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task; at its end the worker, which lives on for other tasks, gives back the memory it has kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fathom.llm import shared

        try:
            yield from task(batches)
        finally:
            shared.clean_up()

    return run


def clean_up() -> None:
    _powers.clear()
    for clean in _at_end:
        clean()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table_of(chars: bytes) -> np.ndarray:
    """True for all bytes but these."""
    out = np.ones(256, bool)
    out[list(chars)] = False
    return out


def spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and the index of each row's first word (with the count of words at the end)."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    rows = at[:-1][at[:-1] < at[1:]]
    before[:1] = False
    before[rows] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    after[at[1:][at[:-1] < at[1:]] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at)


def packed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The slices data[start:end], in order and without overlaps, as an Arrow array."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table[data]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply, public constants of SplitMix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multipliers of the two rolling hashes.
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64, kept for later calls."""
    if len(_powers.get(base, ())) <= n:
        out = np.full(max(n + 1, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][: n + 1]


class Rolling:
    """Hashes of slices of a sequence of 64-bit values, from prefix sums: equal slices have equal hashes wherever they are."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.inverse = powers(pow(base, -1, 2**64), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    roll = Rolling(mixed(np.arange(256, dtype=np.uint64), 7 + seed)[data], BASES[seed % 2])
    return mixed(roll(start, end) + (end - start).astype(np.uint64), seed)


def hex_digest(column: Column) -> Column:
    """Lowercase sha-256 of a string column's UTF-8 bytes."""
    return F.sha2(column.cast("binary"), 256)
