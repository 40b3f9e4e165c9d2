"""Benchmark decontamination by an FM-index per training shard (operator 3).

A shard is some whole documents, about ``PIECE_BYTES`` of text. Its words are
sorted by all their suffixes (each document ends in a mark of its own), the
Burrows-Wheeler transform lies in a wavelet matrix, and of the suffix array
only every ``SAMPLE``-th position and the documents' starts are kept. Windows
of the benchmark run through backward search together; the rows found walk
back to sampled positions. Windows that were found are merged to removal spans
per document.

Windows are read from a written table in blocks, so neither their number nor
their size need fit anything; nothing is broadcast.

Defined cases: null texts have no words and no hits; null or wordless
benchmark items have no windows; items of fewer than ``WINDOW`` words are one
window; equal windows of several items are searched once and count for each of
them; windows of items with a null item_id hit and are cut, but are no item of
``n_items``; documents with a null doc_id are treated like others; repeated
rows are treated alike; empty tables give no hits or no rows; texts of any
length are one document of one shard; extra columns stay in ``cut``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.blocks import PIECE_BYTES
from linkloom.llm.common import batches_of, giving_back, kept, small_batches, table, text_bytes, word_hashes, word_spans
from linkloom.plans.tables import arrow_fs, new_path

WINDOW = 10
#: Every so-many-th position of the suffix array is kept.
SAMPLE = 32
#: Windows that go through an index together.
PATTERNS = 1 << 16
#: Bytes of text of a shard in ``cut``, which runs beside what the stages before it left in the JVM.
CUT_BYTES = PIECE_BYTES // 4
#: Items of one window in a row; a window of more has several rows.
ITEMS = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros(-(-(n + 1) // 64) * 8, np.uint8)
        b = np.packbits(bits, bitorder="little")
        packed[: len(b)] = b
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix of a sequence of symbols below 2 ** bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(bits - 1, -1, -1):
            on = (seq >> level & 1).astype(bool)
            zeros = seq[~on]
            self.levels.append((level, Bits(on), len(zeros)))
            seq = np.concatenate([zeros, seq[on]])

    def walk(self, c: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Where the places go on the way to symbol c; differences are numbers of c."""
        out = list(places)
        for level, bits, zeros in self.levels:
            on = (c >> level & 1).astype(bool)
            for k, i in enumerate(out):
                r = bits.rank(i)
                out[k] = np.where(on, zeros + r, i - r)
        return out

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and where the place goes."""
        c = np.zeros(len(i), np.int64)
        for level, bits, zeros in self.levels:
            on, r = bits.get(i), bits.rank(i)
            c |= on.astype(np.int64) << level
            i = np.where(on, zeros + r, i - r)
        return c, i


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling; only what is still tied is sorted again."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def groups(slots: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Give tied rows the slot of their group's first; the slots still tied."""
        first = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[sa[slots]] = first
        ends = np.append(fresh[1:], True)
        return slots[~(fresh & ends)]

    sorted_text = text[sa]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_text[1:] != sorted_text[:-1]
    tied, h = groups(np.arange(n), fresh), 1
    while len(tied):
        p = sa[tied]
        key = (rank[p] << 32) | (rank[np.minimum(p + h, n)] + 1)
        o = np.argsort(key)
        sa[tied] = p[o]
        key = key[o]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        tied = groups(tied, fresh)
        h *= 2
    return sa


class FMIndex:
    """Index over the words (64-bit hashes) of documents; ``first`` has n + 1 word offsets."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        docs, n = len(first) - 1, len(words)
        sizes = np.diff(first)
        self.first = first
        # each document is followed by a mark below all words, its own for sorting, 0 in the transform
        place = np.arange(n) + np.repeat(np.arange(docs), sizes)
        ends = first[1:] + np.arange(docs)
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        text = np.empty(n + docs, np.int64)
        text[place] = ids + docs
        text[ends] = np.arange(docs)
        sa = suffix_array(text)
        del text  # each array goes as soon as it can: a worker's peak counts for the executor
        symbol = np.zeros(n + docs, np.int64)
        symbol[place] = ids + 1
        last = symbol[sa - 1]  # before the first word of all lies a mark
        del symbol, ids, place
        self.rows = len(sa)
        self.before = np.zeros(len(self.vocabulary) + 2, np.int64)
        np.cumsum(np.bincount(last, minlength=len(self.vocabulary) + 1), out=self.before[1:])
        self.wavelet = Wavelet(last, max(1, len(self.vocabulary).bit_length()))
        del last
        starts = np.zeros(n + docs, bool)
        starts[(first[:-1] + np.arange(docs))[: max(docs, 0)]] = True
        kept = starts[sa] | (sa % SAMPLE == 0)
        self.kept, self.samples = Bits(kept), sa[kept]
        self.owner = np.append(ends, n + docs)

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of rows of word hashes (left-aligned, ``sizes`` words): numbers of those found, and their row ranges."""
        if not len(self.vocabulary) or not len(patterns):
            return (np.empty(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.vocabulary, patterns), len(self.vocabulary) - 1)
        known = (self.vocabulary[at] == patterns) | (np.arange(patterns.shape[1]) >= sizes[:, None])
        live = np.flatnonzero(known.all(axis=1))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.rows, np.int64)
        for step in range(int(sizes.max())):
            j = sizes[live] - 1 - step
            go = j >= 0
            c = at[live[go], j[go]] + 1
            zero, a, b = self.wavelet.walk(c, np.zeros(len(c), np.int64), lo[go], hi[go])
            lo[go], hi[go] = self.before[c] + a - zero, self.before[c] + b - zero
            stay = lo < hi
            live, lo, hi = live[stay], lo[stay], hi[stay]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Word number of each row's suffix, by steps back to a sampled position."""
        out = np.zeros(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            there = self.kept.get(row)
            out[todo[there]] = self.samples[self.kept.rank(row[there])] + steps
            todo, row = todo[~there], row[~there]
            if len(todo):
                c, place = self.wavelet.access(row)
                zero = self.wavelet.walk(c, np.zeros(len(c), np.int64))[0]
                row = self.before[c] + place - zero
            steps += 1
        return out - np.searchsorted(self.owner, out, side="left")  # without the marks before it


def _words(rows: pa.Table) -> tuple[np.ndarray, ...]:
    raw, offsets = text_bytes(rows.column("text"))
    low = _LOWER[raw]
    starts, ends, first = word_spans(low, offsets, _IS_WORD)
    return word_hashes(low, starts, ends), first, starts, ends, raw, offsets


class Windows(NamedTuple):
    """Distinct windows: the items of each, hashes of the words (left-aligned rows), numbers of words."""

    items: list[list[str]]
    words: np.ndarray
    sizes: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Windows:
        return cls([], np.zeros((0, width), np.uint64), np.zeros(0, np.int64))


def write_windows(benchmark: DataFrame, window: int = WINDOW) -> str:
    """Path of a table with a row per distinct window: the words' hashes, their number, at most about ITEMS of its items.

    Windows of more items have a row for each part of these.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h, first, *_ = _words(pa.Table.from_batches([b]))
            items, rows, sizes = [], [], []
            for k, item in enumerate(b.column("item_id").to_pylist()):
                w = h[first[k] : first[k + 1]].view(np.int64)
                n = min(window, len(w))
                for s in range(len(w) - n + 1 if n else 0):
                    items.append(item)
                    rows.append(w[s : s + n])
                    sizes.append(n)
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(rows, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], names=["item_id", "words", "size"])

    path = new_path(benchmark.sparkSession, "windows")
    made = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, words array<long>, size int").distinct()
    parts = made.groupBy("words").agg(F.ceil(F.count(F.lit(1)) / ITEMS).alias("parts"))
    part = F.pmod(F.xxhash64("item_id"), F.col("parts")).alias("part")
    made.join(parts, "words").select("words", "size", part, "item_id").groupBy("words", "size", "part").agg(F.sort_array(F.collect_set("item_id")).alias("items")).drop("part").write.parquet(path)
    return path


def windows_of(path: str, width: int) -> Iterator[Windows]:
    """The table's windows in blocks."""
    fs, base = arrow_fs(path)
    for f in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet")):
        with fs.open_input_file(f) as source:
            for b in pq.ParquetFile(source).iter_batches(PATTERNS):
                if not b.num_rows:
                    continue
                sizes = b.column("size").to_numpy().astype(np.int64)
                flat = b.column("words").flatten().to_numpy().view(np.uint64)
                rows = np.zeros((b.num_rows, width), np.uint64)
                rows[np.arange(width) < sizes[:, None]] = flat
                yield Windows(b.column("items").to_pylist(), rows, sizes)


def _blocks(path: str, width: int) -> Iterator[Windows]:
    """Blocks of windows; a single block stays in the worker's memory."""
    held: list[Windows] = kept("windows", path, list)
    if held:
        yield from held
        return
    seen = 0
    for block in windows_of(path, width):
        seen += 1
        if seen == 1:
            one = block
        yield block
    if seen <= 1:
        held[:] = [one if seen else Windows.empty(width)]


def find_hits(words: np.ndarray, first: np.ndarray, path: str, width: int) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are hit, and the items that each document has windows of."""
    kept("windows", path, list)  # what another stage remembers goes before the index is made
    index = FMIndex(words, first)
    marks = np.zeros(len(words) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(first) - 1)]
    for names, patterns, sizes in _blocks(path, width):
        live, lo, hi = index.search(patterns, sizes)
        count = hi - lo
        if not len(live):
            continue
        which = np.repeat(live, count)
        row = np.arange(len(which)) + np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        at = index.locate(row)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + sizes[which], -1)
        doc = np.searchsorted(first, at, side="right") - 1
        pairs = np.unique(doc * len(names) + which)
        for d, w in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist()):
            items[d].update(names[w])
    return np.cumsum(marks)[:-1] > 0, items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    path = write_windows(benchmark, window)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of(it, PIECE_BYTES, "text"):
            words, first, *_ = _words(rows)
            hit, items = find_hits(words, first, path, window)
            hits = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
            shas = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").combine_chunks(), pa.array(np.diff(first)), pa.array(hits, pa.int64()), pa.array([len(s) for s in items], pa.int64()), pa.array(shas, pa.string()), pa.array(hits > 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def cut(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the merged removal spans cut from ``text``; documents of which no word is left go.

    A span runs from the first to the end of the last of neighbouring hit
    words; a line end takes its place. Documents without hits are unchanged,
    also those without words.
    """
    path = write_windows(benchmark, window)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of(it, CUT_BYTES, "text"):
            words, first, starts, ends, raw, offsets = _words(rows)
            hit, _ = find_hits(words, first, path, window)
            total = np.concatenate([[0], np.cumsum(hit)])
            hits = np.diff(total[first])
            column = rows.column("text").to_pylist()
            data = raw.tobytes()
            for d in np.flatnonzero(hits).tolist():
                a, b = int(first[d]), int(first[d + 1])
                edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                out, at = [], int(offsets[d])
                for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    out.append(data[at : int(starts[a + s])])
                    at = int(ends[a + e - 1])
                out.append(data[at : int(offsets[d + 1])])
                column[d] = b"\n".join(out).decode("utf-8")
            keep = pa.array((hits == 0) | (hits < np.diff(first)))
            k = rows.schema.get_field_index("text")
            done = rows.set_column(k, "text", pa.array(column, pa.string())).filter(keep)
            yield from done.combine_chunks().to_batches()

    return docs.mapInArrow(giving_back(run), docs.schema)


def op3_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w"

SQL = f"""
with d as (select row_number() over () as r, doc_id, {_SQL_WORDS} from documents),
i as (select cast(item_id as varchar) as item, {_SQL_WORDS} from benchmark),
pattern as (select distinct item, least(len(w), {WINDOW}) as size, array_to_string(w[s : s + least(len(w), {WINDOW}) - 1], ' ') as x
  from (select item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as s from i where len(w) > 0)),
place as (select r, size, s, array_to_string(w[s : s + size - 1], ' ') as x
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as s from d, (select distinct size from pattern) where len(w) >= size)),
met as (select r, s, place.size, item from place join pattern on pattern.x = place.x and pattern.size = place.size),
hit as (select r, count(distinct p) as n from (select r, s + unnest(range(0, size)) as p from met) group by r),
found as (select r, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct r, item from met where item is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(found.n, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit on hit.r = d.r left join found on found.r = d.r
"""
