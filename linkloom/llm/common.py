"""Shared pieces of the corpus operators: reading tables, Arrow batches, byte-level words."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch that goes to Python: bounds a worker's memory also where texts are long.
BATCH_ROWS = 512


#: Bytes of words that a Python worker remembers, about, in each of two generations.
MEMORY_BYTES = 40 << 20
#: What an entry of a dictionary of words takes besides its characters and ids, about.
ENTRY_BYTES = 260

_kept: dict[tuple[str, str], object] = {}


def give_back() -> None:
    """Have the allocators return to the system what is free in this process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for a task of a Python worker, which gives back what it took when the task is over.

    Workers wait for their next task beside the JVM and beside each other; what
    their allocators hold meanwhile counts for the executor.
    """

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)  # its variables are gone after this
        give_back()

    return task


def kept(kind: str, key: str, make: Callable[[], object]):
    """``make()``, once for all tasks of a Python worker that follow one another.

    A worker outlives its task and serves the next stage too, so only the
    objects of one kind and key stay: what an earlier stage kept goes, and its
    memory goes back to the system.
    """
    got = _kept.get((kind, key))
    if got is None:
        if _kept:
            _kept.clear()
            gc.collect()
            give_back()
        got = _kept[kind, key] = make()
    return got


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches by rows, and where Spark knows the setting by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


def vocabulary_path(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    """Place of a public tokenizer's file; ``folder`` or LINKLOOM_TOKENIZERS overrides the installed one."""
    folder = folder or os.environ.get("LINKLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of maximal runs of word bytes that stay within a text, and each text's first word.

    ``is_word``: 256 booleans. The result's third item has n + 1 entries: words
    of text k are numbered from first[k] to first[k + 1].
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[raw]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    prev[cut] = False
    starts = np.flatnonzero(inside & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = inside[1:]
    nxt[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from 8 bytes at a time."""
    if not len(starts):
        return np.empty(0, np.uint64)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    lanes = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * _M1 + np.uint64(seed)
    at, todo, pos = starts, None, None
    first = mix((lanes[at] & MASKS[np.minimum(left, 8)]) ^ h)
    h = first
    todo = np.flatnonzero(left > 8)
    while len(todo):
        pos = starts[todo] + 8 if pos is None else pos + 8
        rest = ends[todo] - pos
        h[todo] = mix((lanes[pos] & MASKS[np.minimum(rest, 8)]) + h[todo] * _M1)
        more = rest > 8
        todo, pos = todo[more], pos[more]
    return h


def batches_of(it: Iterator[pa.RecordBatch], nbytes: int, column: str) -> Iterator[pa.Table]:
    """Join small batches to tables of about ``nbytes`` of ``column``; every row in exactly one table."""
    held, size = [], 0
    for b in it:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(column).nbytes
        if size >= nbytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
