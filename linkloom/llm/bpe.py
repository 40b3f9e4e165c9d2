"""BPE encoding and decoding (operator 6).

A priority queue holds the ranks of the merges that are possible now; symbols
form a doubly linked list. The lowest rank (leftmost on ties) is taken; an
entry whose two symbols have changed since it was queued is stale and skipped.
Decoding puts the strings of the vocabulary one after another, with the
tokenizer file's separator (a space where the file has no decoder).

Defined cases: a null text is the empty text, which has no ids and decodes to
the empty string; repeated rows are encoded alike; extra columns stay. What is
a letter goes by the regex module's Unicode tables.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from linkloom.llm.common import ENTRY_BYTES, MEMORY_BYTES, giving_back, kept, small_batches, table, vocabulary_path

#: White space of the tokenizer's patterns (Unicode White_Space): other than str.split, no \x1c-\x1f.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: str.split takes these for spaces, the pattern does not.
_ODD = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, k = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + k))
            k += 1
    return out


class BPE:
    """Encoder and decoder for a tokenizer file with a BPE model and byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError("the file's model is not BPE")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        #: left id and right id in one number: rank and merged id in one number
        self.merges = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.joint = " " if spec.get("decoder") is None else ""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        symbols = byte_symbols()
        self.inner, self.last = [self.vocab[c] for c in symbols], [self.vocab[c + self.suffix] for c in symbols]
        self.shown = {i: str(i) for i in self.strings}
        self.known: dict[str, list[int]] = {}
        self.drawn: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        #: bytes that may still be remembered
        self.known_room = self.drawn_room = MEMORY_BYTES

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token.

        The queue holds numbers: rank, then place of the pair's left symbol.
        want[i] is the rank of the pair that begins at i now; an entry with
        another rank is stale.
        """
        raw = word.encode("utf-8")
        inner, get = self.inner, self.merges.get
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        if n == 1:
            return ids
        want = [m >> 20 for m in [get(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]]
        want.append(-1)
        queue = [m << 32 | i for i, m in enumerate(want) if m >= 0]
        if not queue:
            return ids
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            if want[i] != top >> 32:
                continue  # stale
            j = after[i]
            made = get(ids[i] << 20 | ids[j]) & 0xFFFFF
            ids[i], ids[j] = made, -1
            want[i] = want[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                m = get(made << 20 | ids[k])
                if m is not None:
                    want[i] = m = m >> 20
                    heappush(queue, m << 32 | i)
            h = before[i]
            if h >= 0:
                m = get(ids[h] << 20 | made)
                if m is not None:
                    want[h] = m = m >> 20
                    heappush(queue, m << 32 | h)
                else:
                    want[h] = -1
        return [x for x in ids if x >= 0]

    def normal(self, chunk: str) -> str:
        if not chunk.isascii():
            if self.nfc:
                chunk = unicodedata.normalize("NFC", chunk)
            chunk = chunk.replace("Σ", "σ")  # str.lower looks at a capital sigma's place
        return chunk.lower() if self.lower else chunk

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a text between two white spaces, without added tokens."""
        known = self.known
        got = known.get(chunk)
        if got is not None:
            return got
        if self.known_room < 0:
            known.clear()
            self.known_room = MEMORY_BYTES
        plain = self.normal(chunk)
        if plain.isalpha():
            got = known.get(plain)
            if got is None:
                got = known[plain] = self.merge(plain)
        elif plain[:-1].isalpha() and plain[-1] in ".,":
            got = self.chunk_ids(plain[:-1]) + self.merge(plain[-1])
        else:
            got = []
            for w in self.words.findall(plain):
                got += self.merge(w)
        known[chunk] = got
        self.known_room -= ENTRY_BYTES + len(chunk) + 8 * len(got)
        return got

    def _split(self, text: str) -> list[str]:
        return [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        parts = self.special.split(text) if self.special and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part])
            else:
                for c in self._split(part):
                    out += self.chunk_ids(c)
        return out

    def decode(self, ids: list[int]) -> str:
        """Ids that the vocabulary lacks are left out."""
        return self.joint.join(s for i in ids if (s := self.strings.get(i)) is not None)

    def _drawn(self, ids: list[int]) -> tuple[int, str, str]:
        shown, strings = self.shown, self.strings
        return len(ids), " ".join([shown[i] for i in ids]), " ".join([strings[i] for i in ids])

    def draw(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, ids and decoded strings of a chunk, as ``rendered`` joins them."""
        drawn, older = self.drawn, self.older
        got = older.get(chunk)
        if got is None:
            plain = self.normal(chunk)
            if plain.isalpha():
                if plain is not chunk:
                    got = drawn.get(plain) or older.get(plain)
                if got is None:
                    got = self._drawn(self.merge(plain))
                    chunk = plain
            else:
                body = plain[:-1]
                if plain[-1] in ".," and body.isalpha():
                    known = drawn.get(body) or older.get(body)
                    k, x, y = known or self._drawn(self.merge(body))
                    mark = self.merge(plain[-1])[0]
                    got = (k + 1, f"{x} {self.shown[mark]}", f"{y} {self.strings[mark]}")
                    if not known:  # a word that may never come again is kept without its mark
                        drawn[body] = (k, x, y)
                        self.drawn_room -= ENTRY_BYTES + len(body) + len(x) + len(y)
                        return got
                else:
                    got = self._drawn([i for w in self.words.findall(plain) for i in self.merge(w)])
        if self.drawn_room < 0:
            self.older, self.drawn, self.drawn_room = drawn, {}, MEMORY_BYTES
        self.drawn[chunk] = got
        self.drawn_room -= ENTRY_BYTES + len(chunk) + len(got[1]) + len(got[2])
        return got

    def rendered(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids as decimals joined by a space, and the decoded text."""
        if not text:
            return 0, "", ""
        if self.joint != " " or (self.special and "<" in text and self.special.search(text)):
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        drawn, make, n, a, b = self.drawn, self.draw, 0, [], []
        for c in self._split(text):
            got = drawn.get(c)
            if got is None:
                got = make(c)
                drawn = self.drawn
            k, x, y = got
            if k:
                n += k
                a.append(x)
                b.append(y)
        return n, " ".join(a), " ".join(b)


def bpe(path: str) -> BPE:
    """One per Python worker: words met in one task are remembered in the next."""
    return kept("bpe", path, lambda: BPE(path))


def encode_decode(docs: DataFrame, path: str | None = None, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the ids of ``text`` and the text decoded from them again.

    Both new columns replace columns of the same name.
    """
    path = path or vocabulary_path()
    base = docs.drop(ids_col, decoded_col)
    schema = T.StructType([*base.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for b in it:
            ids = [model.encode(t) for t in b.column("text").to_pylist()]
            texts = [model.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=[*b.schema.names, ids_col, decoded_col])

    return base.mapInArrow(giving_back(run), schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    path = path or vocabulary_path()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sha = bpe(path), hashlib.sha256
        for b in it:
            n, x, y = [], [], []
            for t in b.column("text").to_pylist():
                k, ids, text = model.rendered(t)
                n.append(k)
                x.append(sha(ids.encode()).hexdigest())
                y.append(sha(text.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(x), pa.array(y)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents"))
