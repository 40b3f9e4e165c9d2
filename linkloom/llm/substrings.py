"""Substring dedup by difference-cover anchors (operator 8).

A window is a run of ``WINDOW`` words of one document. Anchors, shorter runs,
are hashed only where the position modulo a period is in a difference cover:
for any two positions some shift below the period brings both to cover
positions, so two equal windows share an anchor at one shift. Anchors that
occur twice are found first; they extend to every window that holds one, and
only these windows are hashed (96 bits) and counted. The result is exact but
for hash collisions.

Defined cases: a null text has no words; texts with fewer words than a window
lose nothing; equal texts of a window or more lose every word of every copy,
as the rule has it; repeated rows count as copies; an empty table gives no
rows; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import blocks
from linkloom.llm.common import mix, small_batches, table, text_bytes, word_hashes, word_spans

#: Words of a window.
WINDOW = 35

_COVERS = {1: [0], 3: [0, 1], 7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [0, 1, 4, 14, 16], 31: [0, 1, 3, 8, 12, 18]}
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def cover_for(window: int) -> tuple[int, list[int]]:
    """The longest period of a perfect difference set that leaves anchors 2/5 of a window."""
    period = max(v for v in _COVERS if v == 1 or window - v + 1 >= 2 * window / 5)
    return period, _COVERS[period]


_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


@lru_cache(maxsize=4)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[which]
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    ones = np.ones(n + 1, np.uint64)
    p, q = ones.copy(), ones
    p[1:] = base
    q[1:] = inverse
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


class Rolling:
    """Hashes of any run of words, from prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, h: np.ndarray, which: int = 0):
        size = 1 << max(16, int(len(h)).bit_length())
        self.p, self.q = _powers(size, which)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum((mix(h + _BASES[1]) if which else h) * self.p[: len(h)], out=self.sums[1:])

    def __call__(self, at: np.ndarray, n: int) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.q[at])


class Piece:
    """The words of some documents, and their windows."""

    def __init__(self, rows: pa.Table, window: int):
        self.raw, self.offsets = text_bytes(rows.column("text"))
        self.starts, self.ends, self.first = word_spans(self.raw, self.offsets, _IS_WORD)
        self.hash = word_hashes(self.raw, self.starts, self.ends)
        self.window = window
        self.n = len(self.starts)
        sizes = np.diff(self.first)
        self.place = np.arange(self.n) - np.repeat(self.first[:-1], sizes)  # in its document
        self.left = np.repeat(sizes, sizes) - self.place  # words from here to the document's end
        self.rolling = Rolling(self.hash)

    def anchors(self, period: int, cover: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors."""
        size = self.window - period + 1
        inside = np.zeros(period, bool)
        inside[cover] = True
        # where no window of this document could hold it, an anchor tells nothing
        whole = self.place + self.left >= self.window
        at = np.flatnonzero(inside[self.place % period] & (self.left >= size) & whole)
        return at, self.rolling(at, size)

    def windows(self, at: np.ndarray, period: int) -> np.ndarray:
        """Starts of the windows that hold one of the anchors at ``at``."""
        marks = np.zeros(self.n + period + 1, np.int64)
        marks[at + 1] = 1
        np.cumsum(marks, out=marks)
        start = np.arange(self.n)
        return np.flatnonzero((marks[start + period] > marks[start]) & (self.left >= self.window))


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return _run(docs, window, "n_words long, n_removed long, kept_sha256 string", _digest)


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by a space, as ``text``."""
    return _run(docs, window, "n_words long, n_removed long, text string", lambda words: words.decode("utf-8"))


def _digest(words: bytes) -> str:
    return hashlib.sha256(words).hexdigest()


def _run(docs: DataFrame, window: int, schema: str, shown) -> DataFrame:
    period, cover = cover_for(window)
    stored = blocks.into_blocks(docs.select("doc_id", "text"))
    nbytes = stored.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = nbytes // 6 + 1
    few, many = (blocks.bits_for(words * per) for per in (blocks.RESIDUAL // 8 * len(cover) // period + 1, 4))

    def anchors(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        p = Piece(rows, window)
        yield blocks.send(block, p.anchors(period, cover)[1], None, few)

    anchor_path = blocks.repeats(blocks.map_blocks(stored, anchors, blocks.SENT), False, few)
    kept: dict[tuple[str, int], tuple] = {}

    def repeated(path: str, block: int, wide: bool) -> tuple:
        if (path, block) not in kept:
            for k in [k for k in kept if k[0] == path]:
                del kept[k]
            kept[path, block] = blocks.block_repeats(path, block, wide)
        return kept[path, block]

    def candidates(p: Piece, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, h = p.anchors(period, cover)
        starts = p.windows(at[blocks.member(blocks.narrow(h, few), None, *repeated(anchor_path, block, False))], period)
        return starts, p.rolling(starts, window), (Rolling(p.hash, 1)(starts, window) >> np.uint64(32)).astype(np.uint32)

    def full(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        _, a, b = candidates(Piece(rows, window), block)
        yield blocks.send(block, a, b, many)

    window_path = blocks.repeats(blocks.map_blocks(stored, full, blocks.SENT), True, many)

    def finish(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        p = Piece(rows, window)
        starts, a, b = candidates(p, block)
        hit = starts[blocks.member(a, b, *repeated(window_path, block, True))]
        marks = np.zeros(p.n + window + 1, np.int64)
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + window, -1)
        stays = np.cumsum(marks)[: p.n] == 0
        first, off = p.first.tolist(), p.offsets.tolist()
        gone = np.concatenate([[0], np.cumsum(~stays)])[p.first]
        gone = np.diff(gone).tolist()
        data, texts = p.raw.tobytes(), []
        for k, g in enumerate(gone):
            words = data[off[k] : off[k + 1]].split()
            texts.append(shown(b" ".join(compress(words, stays[first[k] : first[k + 1]].tolist()) if g else words)))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(np.diff(p.first)), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=names)

    names = ["doc_id", *(f.split()[0] for f in schema.split(", "))]
    return blocks.map_blocks(stored, finish, f"doc_id long, {schema}")


def op8_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repeated_words(table(spark, sf_dir, "documents"))


SQL = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') as w from documents),
win as (select r, s, md5(array_to_string(w[s : s + {WINDOW - 1}], ' ')) as h from (select r, w, unnest(range(1, len(w) - {WINDOW - 2})) as s from d where len(w) >= {WINDOW})),
hit as (select r, s from win where h in (select h from win group by h having count(*) > 1)),
gone as (select distinct r, s + k as p from (select r, s, unnest(range(0, {WINDOW})) as k from hit)),
word as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select word.r, string_agg(x, ' ' order by word.p) as t from word anti join gone on gone.r = word.r and gone.p = word.p group by word.r),
lost as (select r, count(*) as n from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept on kept.r = d.r left join lost on lost.r = d.r
"""
