"""Finding values that occur twice anywhere, for values that are many and short.

Documents lie in blocks (a table with a block number, written once, so that a
block has the same rows on every read). Each block sends the values it has,
sorted and merged, to buckets by value; a bucket sends back to every block
those of the block's values that some other place has too. So a value costs
one entry per block, however often it occurs, no group is ever gathered whole,
and the texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import giving_back
from linkloom.plans.tables import arrow_fs, materialize, new_path

#: A wide value: 64 and 32 bits of hash. Of a narrow one RESIDUAL bits below those that number its bucket are kept.
VALUE = np.dtype([("a", "<u8"), ("b", "<u4")])
RESIDUAL = 40
#: Bytes of values that a bucket holds at most, about.
BUCKET_BYTES = 6 << 20
#: Blocks whose repeated values lie in one folder.
SHELF = 4


def into_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``block``, written as a table: the tasks of this one pass make the blocks."""
    return materialize(docs.withColumn("block", F.spark_partition_id()), "blocks")


def order(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
    """Sort order of values; b is None where 64 bits are all there is."""
    return np.argsort(a) if b is None else np.lexsort((b, a))


def _twice(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
    """For sorted values: whether the next one is the same."""
    same = a[1:] == a[:-1]
    return same if b is None else same & (b[1:] == b[:-1])


def bits_for(nbytes: int) -> int:
    """log2 of the number of buckets for so many bytes of values."""
    return min(64 - RESIDUAL, (nbytes // BUCKET_BYTES).bit_length())


def narrow(a: np.ndarray, bits: int) -> np.ndarray:
    """What is kept of 64-bit hashes: the number of their bucket and RESIDUAL bits more."""
    return a >> np.uint64(64 - RESIDUAL - bits)


def pack(a: np.ndarray, b: np.ndarray | None) -> bytes:
    """Values of one bucket; of narrow ones the last RESIDUAL bits."""
    if b is None:
        return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : RESIDUAL // 8]).tobytes()
    out = np.empty(len(a), VALUE)
    out["a"], out["b"] = a, b
    return out.tobytes()


def unpack(raw: bytes, wide: bool, bucket: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    if not wide:
        out = np.zeros((len(raw) * 8 // RESIDUAL, 8), np.uint8)
        out[:, : RESIDUAL // 8] = np.frombuffer(raw, np.uint8).reshape(-1, RESIDUAL // 8)
        return out.reshape(-1).view("<u8") | np.uint64(bucket << RESIDUAL), None
    x = np.frombuffer(raw, VALUE)
    return x["a"], x["b"]


def merged(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Sorted, each value once, or twice where there are two or more."""
    if not len(a):
        return a, b
    o = order(a, b)
    a, b = a[o], None if b is None else b[o]
    keep = np.ones(len(a), bool)
    keep[2:] = ~(_twice(a, b)[1:] & _twice(a, b)[:-1])
    return a[keep], None if b is None else b[keep]


def member(a: np.ndarray, b: np.ndarray | None, ra: np.ndarray, rb: np.ndarray | None) -> np.ndarray:
    """Which values (a, b) are among the sorted values (ra, rb)."""
    if not len(ra) or not len(a):
        return np.zeros(len(a), bool)
    at = np.searchsorted(ra, a)
    if b is None:
        at[at == len(ra)] = 0
        return ra[at] == a
    hit = np.zeros(len(a), bool)
    todo = np.flatnonzero(at < len(ra))
    while len(todo):  # equal a with another b: step on
        p = at[todo]
        todo, p = todo[ra[p] == a[todo]], p[ra[p] == a[todo]]
        found = rb[p] == b[todo]
        hit[todo[found]] = True
        todo = todo[~found]
        at[todo] += 1
        todo = todo[at[todo] < len(ra)]
    return hit


SENT = "bucket int, block int, vals binary"


def send(block: int, a: np.ndarray, b: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """A block's values as a row for each bucket that gets any. The first ``bits`` bits number the buckets."""
    if b is None:
        a = narrow(a, bits)
    a, b = merged(a, b)
    shift = RESIDUAL if b is None else 64 - bits
    which = (a >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(a), np.int64)
    cut = np.searchsorted(which, np.arange((1 << bits) + 1))
    full = np.flatnonzero(np.diff(cut))
    blobs = [pack(a[cut[k] : cut[k + 1]], None if b is None else b[cut[k] : cut[k + 1]]) for k in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "block", "vals"])


#: Text bytes of a piece of a block that a task holds at once, about; a single longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def by_block(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Pieces of blocks: whole rows of one block, about ``PIECE_BYTES`` of them."""
    held, size, now = [], 0, None
    for batch in it:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for s, e in zip(cuts, cuts[1:]):
            part = batch.slice(s, e - s)
            if held and (block[s] != now or size >= PIECE_BYTES):
                yield now, pa.Table.from_batches(held)
                held, size = [], 0
            now = int(block[s])
            held.append(part)
            size += batch.nbytes * (e - s) // len(block)
    if held:
        yield now, pa.Table.from_batches(held)


def repeats(sent: DataFrame, wide: bool, bits: int) -> str:
    """Path of a table with, by block, the values that occur twice or more in all blocks together.

    A partition is one bucket. The table has a folder for every ``SHELF``
    blocks, in which rows are sorted by block.
    """

    def bucket(number: int, blocks: list[int], raw: list[bytes]) -> Iterator[tuple[int, bytes]]:
        parts = [unpack(r, wide) for r in raw]
        a = np.concatenate([p[0] for p in parts])
        b = np.concatenate([p[1] for p in parts]) if wide else None
        o = order(a, b)
        sa, sb = a[o], None if b is None else b[o]
        t = np.flatnonzero(_twice(sa, sb))
        ra, rb = sa[t], None if sb is None else sb[t]
        for k, (pa_, pb) in zip(blocks, parts):
            hit = member(pa_, pb, ra, rb)
            hit[1:] &= ~(_twice(pa_, pb))
            if hit.any():
                yield k, pack(pa_[hit], None if pb is None else pb[hit])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(number: int, blocks: list[int], raw: list[bytes]) -> Iterator[pa.RecordBatch]:
            rows = list(bucket(number, blocks, raw))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["bucket", "block", "vals"])

        now, blocks, raw = None, [], []
        for batch in it:
            for k, block, v in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), batch.column("vals").to_pylist()):
                if k != now and blocks:
                    yield from out(now, blocks, raw)
                    blocks, raw = [], []
                now = k
                blocks.append(block)
                raw.append(v)
        if blocks:
            yield from out(now, blocks, raw)

    path = new_path(sent.sparkSession, "repeats")
    back = sent.repartitionById(1 << bits, F.col("bucket")).mapInArrow(giving_back(run), SENT)
    shelf = F.expr(f"block div {SHELF}").alias("shelf")
    # so that the rows of one block, and few others, are one row group
    back.select("*", shelf).repartition("shelf").sortWithinPartitions("shelf", "block", "bucket").write.option("parquet.block.size", 2 << 20).partitionBy("shelf").parquet(path)
    return path


def block_repeats(path: str, block: int, wide: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Sorted repeated values of one block, read from the shared folder."""
    fs, base = arrow_fs(path)
    folder = f"{base}/shelf={block // SHELF}"
    parts = []
    if fs.get_file_info(folder).type != pafs.FileType.NotFound:
        for f in fs.get_file_info(pafs.FileSelector(folder)):
            if f.path.endswith(".parquet"):
                rows = pq.read_table(f.path, filesystem=fs, columns=["bucket", "block", "vals"], filters=[("block", "=", block)], partitioning=None)
                parts += [unpack(v, wide, k) for k, v in zip(rows.column("bucket").to_pylist(), rows.column("vals").to_pylist())]
    if not parts:
        return unpack(b"", wide)
    a = np.concatenate([p[0] for p in parts])
    b = np.concatenate([p[1] for p in parts]) if wide else None
    o = order(a, b)
    return a[o], None if b is None else b[o]


def map_blocks(table: DataFrame, fn: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over every piece of every block. A block may be cut between tasks: values
    of both parts then meet in their bucket as those of two blocks would."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in by_block(it):
            yield from fn(block, rows)

    return table.mapInArrow(giving_back(run), schema)
