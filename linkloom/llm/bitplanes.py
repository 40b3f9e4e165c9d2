"""Token ids as bit-plane shuffled, compressed files (operator 2).

A file is a magic, chunks one after another, the index of the chunks, and a
footer that points to the index. A chunk holds whole documents' ids in blocks
of ``BLOCK`` ids; within a block the bits are transposed, so that plane k has
bit k of every id; the planes of a chunk lie one after another and each is
compressed with zstandard on its own (an all-zero plane takes no bytes). The
index has, per chunk, its place, the ids in it, its documents and the length
of each plane.

Defined cases: a null text is empty and has the end id alone; rows with a null
doc_id come before all others (a bit per document tells them apart); an empty
table gives no files and no rows; repeated rows are kept, in any order among
themselves if even their doc_id is the same; extra columns are not stored.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.blocks import PIECE_BYTES
from linkloom.llm.common import ENTRY_BYTES, MASKS, MEMORY_BYTES, batches_of, kept, small_batches, table, text_bytes, vocabulary_path, word_hashes, word_spans
from linkloom.plans.tables import arrow_fs, new_path

MAGIC = b"LLBITPL2"
#: Ids of a block: the unit of transposing. Ids of a chunk, about: the unit of reading.
BLOCK, CHUNK = 4096, 1 << 18
END_ID = 2
#: Marks that make one pre-token after a word, whatever their number.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space that splits texts into words here: some of what the tokenizer takes for it.
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Words that are remembered at most: bounds a worker's memory to some 40 bytes for each.
WORDS = 1 << 21


class Remembered:
    """Ids by word, in arrays: an open hash table over 64-bit hashes; the words' first bytes are compared too."""

    def __init__(self, kind: str, words: int = WORDS):
        self.bits = (2 * words - 1).bit_length()
        self.most = words
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.n = self.end = 0
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.hash, self.head = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.at, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, self.kind)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those not met yet."""
        slot = self._slot(h)
        k = self.slots[slot]
        out = np.where((k >= 0) & (self.hash[k] == h) & (self.head[k] == head), k, -1)
        todo = np.flatnonzero((out < 0) & (k >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            k = self.slots[slot]
            same = (k >= 0) & (self.hash[k] == h[todo]) & (self.head[k] == head[todo])
            out[todo[same]] = k[same]
            more = ~same & (k >= 0)
            todo, slot = todo[more], slot[more]
        return out

    def add(self, h: np.ndarray, head: np.ndarray, ids: list[bytes]) -> None:
        """Words that are not in yet, each once."""
        n, raw = len(h), np.frombuffer(b"".join(ids), self.kind)
        size = np.array([len(x) for x in ids], np.int64) // raw.itemsize

        def room(x: np.ndarray, need: int) -> np.ndarray:
            return x if len(x) >= need else np.concatenate([x, np.zeros(max(len(x), need - len(x)), x.dtype)])

        self.hash, self.head, self.at, self.size = (room(x, self.n + n) for x in (self.hash, self.head, self.at, self.size))
        self.ids = room(self.ids, self.end + len(raw))
        new = slice(self.n, self.n + n)
        self.hash[new], self.head[new], self.size[new] = h, head, size
        self.at[new] = self.end + np.cumsum(size) - size
        self.ids[self.end : self.end + len(raw)] = raw
        number, slot = np.arange(self.n, self.n + n, dtype=np.int32), self._slot(h)
        self.n += n
        self.end += len(raw)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            left = self.slots[slot] != number
            number, slot = number[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def joined(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words one after another, and how many each has."""
        size = self.size[k].astype(np.int64)
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.at[k] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


class WordEncoder:
    """The tokenizers library, with whole words remembered.

    The tokenizer never merges over white space, so the ids of a text are
    those of its white-space separated words; and of a word that is, after
    normalising, Latin letters and then marks, those of the letters and of
    the marks. Words not met yet go through the library many in a call.
    Texts with added tokens go through it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = "<u2" if len(spec["model"]["vocab"]) + len(spec["added_tokens"]) <= 1 << 16 else "<u4"
        self.added = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.is_end = np.zeros(1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]), bool)
        self.is_end[[i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)]] = True
        self.words = Remembered(self.kind)
        #: two generations of parts of words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = MEMORY_BYTES

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts that are one pre-token each, by one call of the library."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.kind)
        ends = ((np.flatnonzero(self.is_end[ids]) + 1) * ids.itemsize).tolist()
        if len(ends) != len(parts):  # some was more than one
            return {p: self.whole(p) for p in parts}
        raw, start, out = ids.tobytes(), 0, {}
        for p, end in zip(parts, ends):
            out[p] = raw[start:end]
            start = end
        return out

    @staticmethod
    def parts(word: str) -> tuple[str, ...]:
        """Parts of a word that are one pre-token each, as far as that is sure; else the word alone, after an empty part."""
        body = word.rstrip(_MARKS)
        marks = word[len(body) :]
        if body.isascii():
            body = body.lower()
        elif max(body) >= "\u0250" or not unicodedata.normalize("NFC", body).lower().isalpha():
            return "", word
        if not body:
            return (marks,)
        if not body.isalpha():
            return "", word
        return (body, marks) if marks else (body,)

    def resolve(self, words: list[str]) -> list[bytes]:
        """The ids of words that are not remembered."""
        if self.room < 0:
            self.old, self.young, self.room = self.young, {}, MEMORY_BYTES
        known, before, fresh = self.young, self.old, set()
        cuts = [self.parts(w) for w in words]
        for c in cuts:
            if c[0]:
                for p in c:
                    if p not in known:
                        got = before.get(p)
                        if got is None:
                            fresh.add(p)
                        else:
                            known[p] = got
                            self.room -= ENTRY_BYTES + len(p)
        if fresh:
            found = self.learn(list(fresh))
            known.update(found)
            self.room -= sum([ENTRY_BYTES + len(p) for p in found])
        return [self.whole(c[1]) if not c[0] else known[c[0]] if len(c) == 1 else known[c[0]] + known[c[1]] for c in cuts]

    def encode_column(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        raw, offsets = text_bytes(texts)
        starts, ends, first = word_spans(raw, offsets, _IS_WORD)
        h = word_hashes(raw, starts, ends)
        padded = np.zeros(len(raw) + 8, np.uint8)
        padded[: len(raw)] = raw
        head = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[starts] & MASKS[np.minimum(ends - starts, 8)]
        memory = self.words
        k = memory.find(h, head)
        lacking = np.flatnonzero(k < 0)
        if len(lacking):
            one = lacking[np.unique(h[lacking], return_index=True)[1]]
            if memory.n + len(one) > memory.most:
                memory.clear()
                lacking = np.arange(len(h))
                one = np.unique(h, return_index=True)[1]
            if len(one) > memory.most:  # more words than fit, in one piece
                return self._apart(texts)
            data = raw.tobytes()
            ids = self.resolve([data[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist())])
            memory.add(h[one], head[one], ids)
            k[lacking] = memory.find(h[lacking], head[lacking])
            if (k < 0).any():  # two words with one hash
                return self._apart(texts)
        ids, sizes = memory.joined(k)
        counts = np.diff(np.concatenate([[0], np.cumsum(sizes)])[first])
        marked = np.unique(np.searchsorted(offsets, np.flatnonzero(raw == 0x3C), side="right") - 1).tolist()  # have a "<"
        odd = {i: t for i in marked if (t := texts[i].as_py()) and any(a in t for a in self.added)}
        if odd:
            at = np.concatenate([[0], np.cumsum(counts)])
            parts = [np.frombuffer(self.whole(odd[i]), self.kind) if i in odd else ids[at[i] : at[i + 1]] for i in range(len(counts))]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def _apart(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Without memory: every text whole."""
        parts = [np.frombuffer(self.whole(t or ""), self.kind) for t in texts.to_pylist()]
        return np.concatenate(parts) if parts else np.zeros(0, self.kind), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian numbers."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        at = np.concatenate([[0], np.cumsum(counts)]).tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


def encoder(path: str) -> WordEncoder:
    return kept("words", path, lambda: WordEncoder(path))


def planes_of(ids: np.ndarray) -> list[bytes]:
    """The 32 bit planes of ids of 16 or 32 bits, block by block; each plane's bits packed from the low end."""
    n = len(ids)
    used = max(1, int(ids.max()).bit_length()) if n else 0
    wide = 8 * ids.dtype.itemsize
    planes = [[] for _ in range(used)]
    for at in range(0, n, BLOCK):
        block = np.zeros(BLOCK, ids.dtype)
        part = ids[at : at + BLOCK]
        block[: len(part)] = part
        bits = np.unpackbits(block.view(np.uint8), bitorder="little").reshape(BLOCK, wide)
        rows = np.packbits(np.ascontiguousarray(bits[:, :used].T), axis=1, bitorder="little")
        for k in range(used):
            planes[k].append(rows[k].tobytes())
    return [b"".join(p) for p in planes] + [b""] * (32 - used)


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    """Inverse of ``planes_of``, as 32-bit ids."""
    used = max((k + 1 for k, p in enumerate(planes) if p), default=0)
    kind = np.dtype("<u2" if used <= 16 else "<u4")
    out = np.zeros(-(-n // BLOCK) * BLOCK, kind)
    rows = [np.frombuffer(p, np.uint8) if p else None for p in planes[:used]]
    size = BLOCK // 8
    bits = np.zeros((8 * kind.itemsize, BLOCK), np.uint8)
    for b in range(len(out) // BLOCK if used else 0):
        for k, row in enumerate(rows):
            bits[k] = 0 if row is None else np.unpackbits(row[b * size : (b + 1) * size], bitorder="little")
        out[b * BLOCK : (b + 1) * BLOCK] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").reshape(-1).view(kind)
    return out[:n].astype("<u4")


def write_file(stream, documents: Iterator[tuple[int | None, np.ndarray]], level: int = 1) -> int:
    """Write pairs of a doc_id and ids of 16 or 32 bits; the number of chunks."""
    press = zstandard.ZstdCompressor(level=level)
    index, at = [], len(MAGIC)
    stream.write(MAGIC)

    def flush(docs: list[int | None], parts: list[np.ndarray]) -> None:
        nonlocal at
        sizes = np.array([len(p) for p in parts], "<u4")
        ids = np.concatenate(parts)
        known = np.packbits([d is not None for d in docs], bitorder="little")
        head = press.compress(np.array([d or 0 for d in docs], "<i8").tobytes() + sizes.tobytes() + known.tobytes())
        body = [press.compress(p) if p else b"" for p in planes_of(ids)]
        index.append((at, len(docs), len(ids), len(head), [len(b) for b in body]))
        for b in (head, *body):
            stream.write(b)
            at += len(b)

    docs, parts, held = [], [], 0
    for doc, ids in documents:
        docs.append(doc)
        parts.append(ids)
        held += len(ids)
        if held >= CHUNK:
            flush(docs, parts)
            docs, parts, held = [], [], 0
    if docs:
        flush(docs, parts)
    packed = b"".join(struct.pack("<QIQI32I", a, d, n, h, *b) for a, d, n, h, b in index)
    stream.write(packed)
    stream.write(struct.pack("<QI", at, len(index)) + MAGIC)
    return len(index)


_ENTRY, _FOOT = struct.calcsize("<QIQI32I"), struct.calcsize("<QI") + len(MAGIC)


def read_index(source, size: int) -> list[tuple]:
    """Entries (place, documents, ids, bytes of the document list, bytes of each plane)."""
    source.seek(size - _FOOT)
    at, n = struct.unpack("<QI", source.read(_FOOT - len(MAGIC)))
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a bit-plane file")
    source.seek(at)
    raw = source.read(n * _ENTRY)
    out = []
    for k in range(n):
        a, d, m, h, *b = struct.unpack_from("<QIQI32I", raw, k * _ENTRY)
        out.append((a, d, m, h, b))
    return out


def read_chunk(source, entry: tuple) -> Iterator[tuple[int | None, np.ndarray]]:
    """The (doc_id, ids) pairs of one chunk."""
    docs, sizes, ids = read_whole(source, entry)
    start = 0
    for doc, size in zip(docs, sizes.tolist()):
        yield doc, ids[start : start + size]
        start += size


def read_whole(source, entry: tuple) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The doc_ids of one chunk, their numbers of ids, and all ids."""
    at, d, n, head, lengths = entry
    source.seek(at)
    press = zstandard.ZstdDecompressor()
    raw = press.decompress(source.read(head))
    docs, sizes = np.frombuffer(raw, "<i8", d).tolist(), np.frombuffer(raw, "<u4", d, 8 * d)
    known = np.unpackbits(np.frombuffer(raw, np.uint8, -(-d // 8), 12 * d), bitorder="little")[:d]
    if not known.all():
        docs = [x if k else None for x, k in zip(docs, known)]
    return docs, sizes, ids_of([press.decompress(source.read(b)) if b else b"" for b in lengths], n)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Encode ``docs`` and write files in ascending doc_id order below ``folder``.

    Files are named by the attempt that wrote them; the returned manifest
    (part, file, n_docs, n_ids, n_bytes; a row per file), itself written
    through Spark's commit protocol to ``folder``/manifest, names those that
    count. Parts ascend with doc_id.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        part = TaskContext.get().partitionId()
        count = [0, 0]

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for rows in batches_of(it, PIECE_BYTES, "text"):
                ids, counts = enc.encode_column(rows.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                count[0] += len(counts)
                count[1] += len(ids)
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                for doc, a, b in zip(rows.column("doc_id").to_pylist(), at, at[1:]):
                    yield doc, ids[a:b]

        fs, base = arrow_fs(folder)
        name = f"ids-{part:05d}-{uuid.uuid4().hex}.bpl"
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}") as out:
            write_file(out, documents())
        size = fs.get_file_info(f"{base}/{name}").size
        if count[0]:
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [count[0]], "n_ids": [count[1]], "n_bytes": [size]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))
        else:
            fs.delete_file(f"{base}/{name}")

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = ordered.mapInArrow(run, "part int, file string, n_docs long, n_ids long, n_bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Read files back: doc_id, start, n_tokens, ids_crc32 of each document, in any order of rows.

    Only a count per file is gathered to know how many ids lie before it.
    """
    spark = manifest.sparkSession
    before, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # a row per file
        rows.append((r["file"], before))
        before += r["n_ids"]
    files = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)), "file")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_fs(folder)
        for b in it:
            for name, start in zip(b.column("file").to_pylist(), b.column("before").to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as source:
                    for entry in read_index(source, source.size()):
                        docs, sizes, ids = read_whole(source, entry)
                        ends = np.cumsum(sizes, dtype=np.int64)
                        raw, sums, at = memoryview(ids.tobytes()), [], 0
                        for to in (4 * ends).tolist():
                            sums.append(zlib.crc32(raw[at:to]))
                            at = to
                        columns = [docs, ends - sizes + start, sizes.astype(np.int64), sums]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += len(ids)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    folder = new_path(spark, "ids")
    return read_ids(write_ids(table(spark, sf_dir, "documents"), folder), folder)
