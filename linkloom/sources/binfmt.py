"""The compact binary graph format, in its three layouts.

All numbers are little-endian. ``A``: magic, version, number of pages, then
out-degrees (16 bits), links (32), title lengths (16), titles. ``B`` has the
total of links and of title bytes after the number of pages. ``C`` is ``B``
with zeros after the degrees up to a multiple of 8 bytes.
version = date << 8 | format number.
"""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.graph import adjacency
from linkloom.plans.tables import arrow_fs, drop_table, materialize, qualified

MAGIC = b"WIKI"
LIMIT = 65_536


class FormatError(ValueError):
    """Not a graph file of this layout."""


def header(date: int, version: int, layout: str, pages: int, links: int, title_bytes: int) -> bytes:
    h = MAGIC + struct.pack("<Ii", date << 8 | version, pages)
    return h if layout == "A" else h + struct.pack("<II", links, title_bytes)


def parse(data: bytes, layout: str = "C", version: int | None = 1) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Header, degrees, links, title lengths and title bytes of a file, XZ-packed or not."""
    if data[:4] != MAGIC:
        try:
            data = lzma.decompress(data)
        except lzma.LZMAError:
            raise FormatError("neither a graph file nor XZ") from None
        if data[:4] != MAGIC:
            raise FormatError("wrong magic")
    tag, n = struct.unpack_from("<Ii", data, 4)
    if version is not None and tag & 255 != version:
        raise FormatError(f"format number {tag & 255}, not {version}")
    at = 12 if layout == "A" else 20
    degrees = np.frombuffer(data, "<u2", n, at)
    at += 2 * n + (-2 * n % 8 if layout == "C" else 0)
    links = np.frombuffer(data, "<i4", int(degrees.sum(dtype=np.int64)), at)
    at += 4 * len(links)
    lengths = np.frombuffer(data, "<u2", n, at)
    at += 2 * n
    titles = np.frombuffer(data, np.uint8, int(lengths.sum(dtype=np.int64)), at)
    info = {"dump_date": tag >> 8, "version": tag & 255, "n_pages": n, "total_links": len(links), "total_title_bytes": len(titles)}
    if layout != "A" and struct.unpack_from("<II", data, 12) != (len(links), len(titles)):
        raise FormatError("totals do not fit the contents")
    return info, degrees, links, lengths, titles


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_header(spark: SparkSession, path: str, layout: str = "C", version: int | None = 1) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data in b.column("content").to_pylist():
                yield pa.RecordBatch.from_pylist([parse(data, layout, version)[0]])

    return _files(spark, path).mapInArrow(run, "dump_date long, version long, n_pages long, total_links long, total_title_bytes long")


_ROWS = 1 << 16


def read_nodes(spark: SparkSession, path: str, layout: str = "C", version: int | None = 1) -> DataFrame:
    """(id, title)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data in b.column("content").to_pylist():
                _, _, _, lengths, titles = parse(data, layout, version)
                offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                for s in range(0, len(lengths), _ROWS):
                    o = offsets[s : s + _ROWS + 1]
                    raw = pa.py_buffer(titles[o[0] : o[-1]].tobytes())
                    text = pa.LargeStringArray.from_buffers(len(o) - 1, pa.py_buffer((o - o[0]).tobytes()), raw).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(text)), pa.int32()), text], names=["id", "title"])

    return _files(spark, path).mapInArrow(run, "id int, title string")


def read_edges(spark: SparkSession, path: str, layout: str = "C", version: int | None = 1) -> DataFrame:
    """(src, pos, dst)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data in b.column("content").to_pylist():
                _, degrees, links, _, _ = parse(data, layout, version)
                src = np.repeat(np.arange(len(degrees)), degrees)
                first = np.cumsum(degrees, dtype=np.int64) - degrees
                pos = np.arange(len(links)) - first[src]
                for s in range(0, len(links), _ROWS):
                    cut = slice(s, s + _ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (src[cut], pos[cut], links[cut])], names=["src", "pos", "dst"])

    return _files(spark, path).mapInArrow(run, "src int, pos int, dst int")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, layout: str = "C", date: int = 221201, version: int = 1) -> None:
    """Write one file, anywhere Spark can write to. Nodes have ids 0 to n - 1.

    Every task packs its range of ids; the driver only strings the packed
    pieces together, one at a time, since the format is a single file.
    """
    full = nodes.select("id", "title").join(adjacency(edges).withColumnRenamed("src", "id"), "id", "left").select("id", "title", F.coalesce("links", F.array().cast("array<int>")).alias("links"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, titles, links = (b.column(c).to_pylist() for c in ("id", "title", "links"))
            raw = [t.encode() for t in titles]
            if any(len(x) >= LIMIT for x in links) or any(len(t) >= LIMIT for t in raw):
                raise FormatError("more than 65535 links of a page or bytes of a title")
            parts = [
                np.array([len(x) for x in links], "<u2").tobytes(),
                np.array([d for x in links for d in x], "<i4").tobytes(),
                np.array([len(t) for t in raw], "<u2").tobytes(),
                b"".join(raw),
            ]
            if ids:
                yield pa.RecordBatch.from_pydict({"section": [0, 1, 2, 3], "first": [ids[0]] * 4, "part": parts}, schema=pa.schema([("section", pa.int32()), ("first", pa.int64()), ("part", pa.binary())]))

    packed = materialize(full.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, "section int, first long, part binary"), "packed")
    n = nodes.count()
    size = {r["section"]: r["n"] for r in packed.groupBy("section").agg(F.sum(F.octet_length("part")).alias("n")).collect()}
    fs, place = arrow_fs(qualified(nodes.sparkSession, path))
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(place) as out:
        out.write(header(date, version, layout, n, size.get(1, 0) // 4, size.get(3, 0)))
        for section in range(4):
            for r in packed.where(F.col("section") == section).orderBy("first").select("part").toLocalIterator():
                out.write(r["part"])
            if section == 0 and layout == "C":
                out.write(bytes(-2 * n % 8))
    drop_table(packed)


def update_graph(spark: SparkSession, source: str, path: str, layout: str = "A") -> None:
    """Write a file again with the next format number."""
    info = read_header(spark, source, layout).first()
    write_graph(read_nodes(spark, source, layout), read_edges(spark, source, layout).select("src", "dst"), path, layout, info["dump_date"], info["version"] + 1)
