"""MinHash near-dedup by a containment ensemble (operator 4).

Two texts are near copies if the smaller shingle set is contained in the
larger one by ``CONTAINMENT`` at least, whatever the larger's size; a smaller
set of under ``LEAST_SHINGLES`` (a licence line, say, that unrelated texts
quote) also needs a Jaccard similarity of ``SHORT_JACCARD``. Documents are
partitioned by set size; a query size and a partition's largest size turn the
containment into a Jaccard threshold, for which every partition tunes its own
bands and rows. A document is indexed in its own partition and queries that
one and the next larger by bands. In all larger ones the threshold leaves
bands of one or two rows, which boilerplate fills; there it asks exactly, by
an index of the shingles that several texts have: of a text that another one
contains, one of its rarest shingles, a few more than may be missing, is in
the other. So no link between texts of different partitions depends on chance.

Equal texts collapse first, to the least doc_id. In ``LEADER_ROUNDS`` rounds
every document is checked, exactly, against one leader of its buckets, which
joins copies by as many checks as there are documents. Only where a bucket still holds several components of the
links found are pairs of different components checked too, all of them, so no
link that would join two classes is lost. Components of these links, between
texts of like size, are the inner classes. An inner class of which a member is
contained in a longer text joins one class that contains it, the least; so a
short text that many contain goes to one of them and does not make one class
of them all. Every link counts in ``n_links``: those within inner classes by
checking all pairs of a class, block by block, the others as they are found.

Defined cases: null texts are never copies of anything; texts without words
are copies only of equal texts; texts below ``SHINGLE`` words have one
shingle; ties go to the least doc_id; rows with one doc_id count as one
document, the text with the least digest; rows with a null doc_id have no row
and stay in ``keep_one``; an empty table gives no rows; extra columns stay in
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import blocks
from linkloom.llm.blocks import PIECE_BYTES
from linkloom.llm.common import batches_of, giving_back, kept, mix, small_batches, table, text_bytes, word_hashes, word_spans
from linkloom.llm.components import connected_components
from linkloom.llm.substrings import Rolling
from linkloom.plans.tables import drop_path, drop_table, materialize, release

#: RATIO: growth of the size partitions, up to which bands find a pair.
SHINGLE, CONTAINMENT, RATIO = 3, 0.75, 1.2
#: From so many shingles on containment alone counts; below, the Jaccard similarity too.
LEAST_SHINGLES, SHORT_JACCARD = 32, 0.4
#: Most times its shingles that a near copy of a text below LEAST_SHINGLES can have.
SHORT_RATIO = 1 / SHORT_JACCARD
#: Members of a class that are compared with as many others at a time, and shingles of them at a time.
LINK_BLOCK, LINK_CHUNK = 64, 1 << 14
#: Rounds in which a document is checked against one leader.
LEADER_ROUNDS = 2
#: Hash functions of a signature; least chance that a pair at the threshold meets in a bucket.
HASHES, LEAST_CHANCE = 160, 0.94
#: Share of its shingles that a text must have in common with a longer one, among those it asks for, beyond the first.
MORE = 0.06
#: Shingles that go through all hash functions while they lie in the processor's cache.
CACHED = 1 << 15

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
IS_WORD[[*range(0x41, 0x5B)]] = True

_rng = np.random.default_rng(11)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def jaccard_threshold(containment: float, query: float, largest: float) -> float:
    """Least Jaccard similarity of a set of ``query`` elements that is contained by that much in one of ``largest`` at most."""
    return containment / (1 + largest / query - containment)


def tune(threshold: float, hashes: int = HASHES, chance: float = LEAST_CHANCE) -> tuple[int, int]:
    """(bands, rows): the most rows that let a pair at the threshold meet with ``chance``."""
    for rows in range(12, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= chance:
            return bands, rows
    return hashes, 1


def partitions(largest: int, ratio: float = RATIO) -> np.ndarray:
    """Upper ends of the size partitions, so that sizes ``ratio`` apart are in one partition or in neighbours."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * ratio)))
    return np.array(ends)


_ENDS = partitions(1 << 40)


def bandings(containment: float = CONTAINMENT) -> list[tuple[int, int]]:
    """By partition: (bands, rows) for queries from the same partition and from the one below."""
    low = np.concatenate([[1], _ENDS[:-1] + 1])
    out = []
    for k, u in enumerate(_ENDS):
        query = max(low[max(0, k - 1)], u / RATIO)  # a smaller one is no copy of the largest
        out.append(tune(jaccard_threshold(containment, query, u)))
    return out


def shingles(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted within a document) and n + 1 offsets."""
    raw, offsets = text_bytes(rows.column("text"))
    starts, ends, first = word_spans(raw, offsets, IS_WORD)
    h = word_hashes(raw, starts, ends)
    del raw, starts, ends
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(first[1:], sizes) - np.arange(len(h))
    rolling = Rolling(h)
    at = np.flatnonzero(left >= SHINGLE)
    del h, left
    values = rolling(at, SHINGLE)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    owner = np.concatenate([doc[at], short])
    del doc
    values = np.concatenate([values, *(rolling(first[s : s + 1], int(sizes[s])) for s in short)]) if len(short) else values
    o = np.lexsort((values, owner))
    owner, values = owner[o], values[o]
    del o, at
    fresh = np.ones(len(values), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[fresh], values[fresh]
    return values, np.searchsorted(owner, np.arange(len(sizes) + 1))


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x HASHES minima; documents without shingles have rows of no meaning."""
    n = len(offsets) - 1
    out = np.zeros((n, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    x = (values >> np.uint64(32)).astype(np.uint32)
    hashed, k = np.empty(0, np.uint32), 0
    while k < len(full):
        low = offsets[full[k]]
        end = max(k + 1, int(np.searchsorted(offsets[full + 1], low + CACHED, side="right")))
        docs = full[k:end]
        part = x[low : offsets[docs[-1] + 1]]
        at = offsets[docs] - low
        if len(hashed) < len(part):
            hashed = np.empty(len(part), np.uint32)
        h = hashed[: len(part)]
        for j in range(HASHES):
            np.multiply(part, _A[j], out=h)
            np.add(h, _B[j], out=h)
            out[docs, j] = np.minimum.reduceat(h, at)
        k = end
    return out


def band_hashes(sig: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each document the hashes of all buckets it is in, as 64-bit integers."""
    banding = bandings()
    part = np.searchsorted(_ENDS, sizes)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(sizes)
    for p in np.unique(part[sizes > 0]):
        rows = np.flatnonzero((part == p) & (sizes > 0))
        made = []
        # in its own partition it is indexed and asks; in the next one it asks
        for place in (p, p + 1):
            bands, r = banding[place]
            for b in range(bands):
                h = mix(np.full(len(rows), (int(place) << 20) + b, np.uint64))
                for k in range(b * r, b * r + r):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[rows, k])
                made.append(h.view(np.int64))
        block = np.stack(made, axis=1)
        for i, d in enumerate(rows):
            out[d] = block[i]
    return out


def _sketch(docs: DataFrame) -> DataFrame:
    """id, n_shingles and bucket hashes of each (id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("neardup", "", dict)  # what another stage remembers goes
        for rows in batches_of(it, PIECE_BYTES // 2, "text"):
            values, offsets = shingles(rows)
            sizes = np.diff(offsets)
            buckets = band_hashes(signatures(values, offsets), sizes)
            yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))], names=["id", "n_shingles", "buckets"])

    return docs.select("id", "text").mapInArrow(giving_back(run), "id long, n_shingles long, buckets array<long>")


def _sets(stored: DataFrame, total: int) -> DataFrame:
    """(id, n, s): for each text the number of its shingles, and those that occur in other texts too, sorted.

    ``stored``: (id, text, block), each text once; ``total``: shingles of all
    texts. No two texts share a shingle that is not in ``s``.
    """
    bits = blocks.bits_for(total * blocks.RESIDUAL // 8)

    def find(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield blocks.send(block, shingles(rows)[0], None, bits)

    path = blocks.repeats(blocks.map_blocks(stored, find, blocks.SENT), False, bits)
    release(stored.sparkSession)
    last: dict[int, np.ndarray] = {}

    def keep(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        values, offsets = shingles(rows)
        if block not in last:
            last.clear()
            last[block] = blocks.block_repeats(path, block, False)[0]
        hit = blocks.member(blocks.narrow(values, bits), None, last[block], None)
        at = np.concatenate([[0], np.cumsum(hit)])[offsets]
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values[hit].view(np.int64)))
        yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), pa.array(np.diff(offsets), pa.int64()), lists], names=["id", "n", "s"])

    out = materialize(blocks.map_blocks(stored, keep, "id long, n long, s array<long>"), "sets")
    drop_path(stored.sparkSession, path)
    return out


def _wide_pairs(sets: DataFrame) -> DataFrame:
    """(id, lead): candidate pairs further apart in size than bands look, the smaller text first.

    Of a contained text at most a share 1 - CONTAINMENT of the shingles is
    missing in the other. So of any shingles of it that are more than may be
    missing by k, k at least are in both. Chosen are first those that no text
    so much longer has, which need no look-up (a text with too many of them is
    contained nowhere), then the rarest; k grows with the text by ``MORE``.
    """
    able = F.size("s") >= F.col("n") * CONTAINMENT - 1e-9
    # the sign of n tells who may ask; each shingle travels once, for the counts and for the rows
    rows = sets.select("id", F.when(able, F.col("n")).otherwise(-F.col("n")).alias("n"), F.explode("s").alias("h")).repartition("h")
    facts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.max(F.abs("n")).alias("top"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("low"))
    longer = lambda n, m: F.col(n) > F.floor(F.col(m) * RATIO + 1e-9)
    both = rows.join(facts.where(longer("top", "low")), "h").select("h", "id", F.abs("n").alias("n"), "f", ((F.col("n") > 0) & longer("top", "n")).alias("asks"), (F.abs("n") > F.floor(F.col("low") * RATIO + 1e-9)).alias("answers"))
    used = materialize(both.where("asks or answers"), "shared")
    may = F.floor(F.col("n") * (1 - CONTAINMENT) + 1e-9)
    more = F.floor(F.col("n") * MORE)
    own = used.where("asks").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("s")).withColumn("missing", F.col("n") - F.size("s")).where(F.col("missing") <= may)
    own = own.withColumn("k", (more + 1).cast("int")).withColumn("ask", F.slice("s", 1, (may + 1 + more - F.col("missing")).cast("int")))
    asks = materialize(own.select(F.col("id").alias("a"), F.col("n").alias("m"), "k", F.explode("ask.h").alias("h")), "asks")
    least = asks.groupBy("h").agg(F.min("m").alias("low"))
    posts = used.where("answers").join(least, "h").where(longer("n", "low")).select("h", "id", "n")
    met = asks.join(posts, "h").where(longer("n", "m") & _sizes_fit("m", "n"))
    out = materialize(met.groupBy("a", "id", "k").agg(F.count(F.lit(1)).alias("c")).where("c >= k").select(F.col("a").alias("id"), F.col("id").alias("lead")), "wide")
    drop_table(asks)
    drop_table(used)
    return out


def passes(a: str, n: str, b: str, m: str) -> F.Column:
    """Whether texts of n and m shingles, of which those in columns a and b can be common, are near copies."""
    lo, hi = F.least(n, m), F.greatest(n, m)
    both = F.size(F.array_intersect(a, b))
    return (both >= lo * CONTAINMENT - 1e-9) & ((lo >= LEAST_SHINGLES) | (both >= (lo + hi - both) * SHORT_JACCARD - 1e-9))


def _sizes_fit(n: str, m: str) -> F.Column:
    """Whether sets of these sizes can be near copies."""
    lo, hi = F.least(n, m), F.greatest(n, m)
    return (lo >= LEAST_SHINGLES) | (hi <= lo * SHORT_RATIO + 1e-9)


def _in_bands(n: str, m: str) -> F.Column:
    """Whether sets of these sizes lie so near that bands find their pair."""
    return F.greatest(n, m) <= F.floor(F.least(n, m) * RATIO + 1e-9)


def _labelled(live: DataFrame, linked: DataFrame | None) -> DataFrame:
    """(bucket, id, n, c): rows of buckets with their component so far, at first the row itself."""
    if linked is None:
        return live.select("bucket", "id", "n", F.col("id").alias("c"))
    return live.join(linked.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("c"))


def _check(pairs: DataFrame, sets: DataFrame, leads: DataFrame) -> DataFrame:
    """(id, lead, ok): the exact test of candidate pairs; the set of ``id`` travels with the pair."""
    both = pairs.join(sets, "id").join(leads.select(F.col("id").alias("lead"), F.col("n").alias("m"), F.col("s").alias("t")), "lead")
    return both.select("id", "lead", passes("s", "n", "t", "m").alias("ok"))


def _edges(checked: DataFrame) -> DataFrame:
    return checked.where("ok").select(F.col("id").alias("a"), F.col("lead").alias("b"))


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Booleans: which of the texts a are near copies, of like size, of which of the texts b, in chunks of shingles.

    a and b: the shingles that can be common; n and m: numbers of all shingles.
    """
    both = np.zeros((len(a), len(b)))
    left, right = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(left, right)
    rows = []
    sizes_of = [np.array([len(x) for x in side]) for side in (a, b)]
    for x, sizes in zip((left, right), sizes_of):
        at = np.searchsorted(common, x)
        at[at == len(common)] = 0
        hit = np.flatnonzero(common[at] == x) if len(common) else np.empty(0, np.int64)
        rows.append((np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]))
    for low in range(0, len(common), LINK_CHUNK):
        parts = []
        for (doc, at), sizes in zip(rows, sizes_of):
            here = (at >= low) & (at < low + LINK_CHUNK)
            part = np.zeros((len(sizes), min(LINK_CHUNK, len(common) - low)), np.float32)
            part[doc[here], at[here] - low] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    lo, hi = np.minimum(n[:, None], m), np.maximum(n[:, None], m)
    return (hi <= np.floor(lo * RATIO + 1e-9)) & (both >= lo * CONTAINMENT - 1e-9) & ((lo >= LEAST_SHINGLES) | (both >= (lo + hi - both) * SHORT_JACCARD - 1e-9))


def count_links(linked: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n): the near copies of like size of each member of an inner class (node, component) among all its members.

    A class is cut into blocks of about ``LINK_BLOCK`` members; each pair of blocks is one small group.
    """
    size = linked.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.count(F.lit(1)) / LINK_BLOCK).cast("int").alias("blocks"))
    two = linked.join(size.where("members = 2"), "component").select("node", F.lit(1).cast("long").alias("n"))  # what joins them is their one link
    size = size.where("members > 2")
    member = linked.join(size, "component").select("component", F.col("node").alias("id"), "blocks", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("at"))
    # a block meets every block, so each pair of blocks comes once, as (lower, higher)
    spread = member.select("component", "id", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("component", "id", "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        ids, at, i, j = group.column("id").to_numpy(), group.column("at").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        s = [x.values.to_numpy() for x in group.column("s")]
        sizes = group.column("n").to_numpy()
        a, b = np.flatnonzero(at == i), np.flatnonzero(at == j)
        n = np.zeros(len(ids), np.int64)
        if len(a) and len(b):
            ok = linked_pairs([s[k] for k in a], [s[k] for k in b], sizes[a], sizes[b])
            if i == j:
                np.fill_diagonal(ok, False)
                n[a] = ok.sum(axis=1)
            else:
                n[a], n[b] = ok.sum(axis=1), ok.sum(axis=0)
        return pa.table({"node": ids, "n": n})

    counted = spread.join(sets, "id").select("component", "i", "j", "id", "at", "n", "s").groupBy("component", "i", "j").applyInArrow(run, "node long, n long")
    return counted.unionByName(two).groupBy("node").agg(F.sum("n").alias("n"))


def _attached(linked: DataFrame, wide: DataFrame) -> DataFrame:
    """(component, top): inner classes with a member that a longer text contains, and the class they join.

    ``wide``: (id, lead) links. Each such class names the least class that
    contains it; what these names tie together is one class.
    """
    part = linked.select(F.col("node"), F.col("component"))
    a = wide.join(part.withColumnsRenamed({"node": "id", "component": "ca"}), "id", "left").join(part.withColumnsRenamed({"node": "lead", "component": "cb"}), "lead", "left")
    named = a.select(F.coalesce("ca", "id").alias("a"), F.coalesce("cb", "lead").alias("b")).where("a <> b").groupBy("a").agg(F.min("b").alias("b"))
    return connected_components(named).select(F.col("node").alias("component"), F.col("component").alias("top"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_of, n_copies, n_links, n_shingles: a row per doc_id.

    ``class_id``: the least doc_id of the class. ``copy_of``: the least doc_id
    with the same text; ``n_copies``: documents with that text. ``n_links``:
    other texts that the text is a near copy of.
    """
    spark = docs.sparkSession
    one = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("key")).where("doc_id is not null")
    keyed = materialize(one.groupBy("doc_id").agg(F.min("key").alias("key")), "keys")
    first = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"))
    member = materialize(keyed.join(first, "key", "left").select("doc_id", "key", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")), "members")
    drop_table(keyed)
    # each text once, under the least doc_id that has it
    lead = member.where("key is not null and doc_id = copy_of").select("doc_id", "key")
    # grouped by what joins them, so that the texts travel once
    texts = one.join(lead, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first(F.lower("text")).alias("text"))
    stored = blocks.into_blocks(texts.select(F.col("doc_id").alias("id"), "text"))
    release(spark)
    sketch = materialize(_sketch(stored), "sketch")
    rows = sketch.select("id", F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket")).repartition("bucket")  # both uses read one exchange
    shared = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket")
    live = materialize(rows.join(shared, "bucket"), "buckets")
    sizes = materialize(sketch.select("id", "n_shingles"), "sizes")
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    drop_table(sketch)
    release(spark)
    sets = _sets(stored, total)
    drop_table(stored)
    release(spark)
    wide = _wide_pairs(sets)
    # only texts that have so much in common with others can have a link to one of like size, or be contained in a longer one
    near = materialize(sets.where(F.size("s") >= F.col("n") * CONTAINMENT / RATIO - 1e-9), "near")
    far = materialize(_check(wide, near, sets).where("ok").select("id", "lead"), "far")
    drop_table(wide)
    drop_table(sets)
    live0, live = live, materialize(live.join(near.select("id"), "id", "left_semi"), "buckets")
    drop_table(live0)
    release(spark)
    checked = None
    linked = None
    # each member against the leader of one of its buckets at a time, as long as the leader is of another component
    for _ in range(LEADER_ROUNDS):
        label = _labelled(live, linked)
        lead = label.groupBy("bucket").agg(F.min(F.struct("id", "n", "c")).alias("l")).select("bucket", F.col("l.id").alias("lead"), F.col("l.n").alias("m"), F.col("l.c").alias("d"))
        pairs = label.join(lead, "bucket").where("id > lead and c <> d").where(_in_bands("n", "m")).select("id", "lead").distinct()
        if checked is not None:
            pairs = pairs.join(checked.select("id", "lead"), ["id", "lead"], "left_anti")
        pairs = pairs.groupBy("id").agg(F.min("lead").alias("lead"))
        fresh = materialize(_check(pairs, near, near), "checked")
        release(spark)
        if fresh.isEmpty():
            break
        checked = fresh if checked is None else checked.unionByName(fresh)
        if not fresh.where("ok").isEmpty():
            drop_table(linked)
            linked = materialize(connected_components(_edges(checked)), "classes")
    # what lies in one bucket and in several components yet: all such pairs of different components
    label = materialize(_labelled(live, linked), "labels")
    split = label.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    label2 = label.join(split, "bucket")
    other = label2.select("bucket", F.col("id").alias("lead"), F.col("n").alias("m"), F.col("c").alias("d"))
    cross = label2.join(other, "bucket").where("id > lead and c <> d").where(_in_bands("n", "m")).select("id", "lead").distinct()
    if checked is not None:
        cross = cross.join(checked.select("id", "lead"), ["id", "lead"], "left_anti")
    more = materialize(_check(cross, near, near), "checked")
    checked = more if checked is None else checked.unionByName(more)
    if linked is None or not more.where("ok").isEmpty():
        drop_table(linked)
        linked = materialize(connected_components(_edges(checked)), "classes")
    release(spark)
    ends = far.select(F.explode(F.array("id", "lead")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    degree = materialize(count_links(linked, near).unionByName(ends).groupBy("node").agg(F.sum("n").alias("n_links")), "links")
    top = materialize(_attached(linked, far), "tops")
    for t in (live, near, label, far):
        drop_table(t)
    release(spark)
    inner = member.join(linked, member.copy_of == F.col("node"), "left").select("doc_id", "copy_of", "n_copies", F.coalesce("component", "copy_of").alias("component"))
    out = inner.join(top, "component", "left").join(degree, inner.copy_of == degree.node, "left")
    return out.join(sizes.select(F.col("id").alias("copy_of"), "n_shingles"), "copy_of", "left").select(
        "doc_id", F.coalesce("top", "component").alias("class_id"), "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that with the most shingles, or the least doc_id of several.

    So a text that goes is contained in one that is left or is a near copy of
    such a one. Rows with a null doc_id stay.
    """
    found = classes(docs)
    kept = found.groupBy("class_id").agg(F.max_by("doc_id", F.struct("n_shingles", -F.col("doc_id"))).alias("kept"))
    gone = found.join(kept, "class_id").where("doc_id <> kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op4_containment_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return classes(table(spark, sf_dir, "documents"))
