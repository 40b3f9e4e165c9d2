"""The operators as Spark plans, on small tables, against brute force."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from contextlib import suppress
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import bitplanes, blocks, bpe, common, components, fmindex, neardup, pii, sharding, substrings, toxicity, urls, webp
from linkloom.llm.common import vocabulary_path
from linkloom.plans.tables import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, block int, position long, id long, key string"
RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


PASSAGE = prose(60, 1)
BENCH = [(0, prose(25, 2)), (1, "only Four words here"), (2, None), (3, " ..., "), (4, prose(25, 2)), (5, prose(12, 3))]
BASE = prose(120, 4)
TEXTS = {
    1: BASE,
    2: BASE,  # an exact copy
    3: BASE.replace(BASE.split()[50], "changed", 1),  # a near copy
    4: None,
    5: "",
    6: " \n\t ",
    7: prose(3000, 5) + " " + PASSAGE + " " + prose(4000, 6),  # very long
    8: prose(40, 7) + "\n" + PASSAGE + " " + prose(40, 8),
    9: prose(80, 9) + " " + BENCH[0][1] + " " + prose(20, 10),
    10: "x Only four WORDS here y",
    11: "one",
    12: "one",
    13: 'write to jo.e@mail.example.org from 10.0.0.1 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" now',
    14: "a " * 100,
    15: "!!! ???",
    16: prose(30, 11) + " é ÄÖ ñandú 中文",
    17: "",
}


def rows(texts=TEXTS):
    return [(k, t, "en", "s", None if t is None else len(t), "x", 1, 2, 3, "k") for k, t in texts.items()] + [(11, "one", "en", "s", 3, "x", 1, 2, 3, "k")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "docs")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe(docs, empty):
    lib = Tokenizer.from_file(vocabulary_path())
    want = set()
    for k, t, *_ in rows():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((k, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert set(map(tuple, bpe.digests(docs).collect())) == want
    assert bpe.digests(empty).count() == 0
    full = bpe.encode_decode(docs)
    assert full.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"] and full.count() == len(rows())


def test_bitplane_files(spark, docs, empty):
    lib = Tokenizer.from_file(vocabulary_path())
    folder = new_path(spark, "ids")
    got = sorted(map(tuple, bitplanes.read_ids(bitplanes.write_ids(docs, folder), folder).collect()))
    want, start = [], 0
    for k, t, *_ in sorted(rows(), key=lambda r: r[0]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((k, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert got == want
    folder = new_path(spark, "ids")
    assert bitplanes.read_ids(bitplanes.write_ids(empty, folder), folder).count() == 0


def brute_windows(text, rx=re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
    return rx.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontamination(docs, empty, bench):
    windows = defaultdict(set)
    for k, t in BENCH:
        w = brute_windows(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(k))
    want = set()
    for k, t, *_ in rows():
        w, hit, items = brute_windows(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    items |= found
                    hit |= set(range(s, s + n))
        want.add((k, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    assert set(map(tuple, fmindex.contamination(docs, bench).collect())) == want
    assert {r[0] for r in want if r[5]} == {9, 10}
    assert fmindex.contamination(empty, bench).count() == 0
    assert not fmindex.contamination(docs, bench.limit(0)).where("contaminated").count()
    cut = fmindex.cut(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(rows()) and not fmindex.contamination(cut, bench).where("contaminated").count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[10] == "x \n y" and all(texts[k] == t for k, t in TEXTS.items() if k not in (9, 10))


def brute_repeats(data, window):
    words = [(k, (t or "").encode().split()) for k, t in data]
    count = Counter(tuple(w[s : s + window]) for _, w in words for s in range(len(w) - window + 1))
    out = []
    for k, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone |= set(range(s, s + window))
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [35, 8])
def test_substring_dedup(docs, window):
    assert sorted(map(tuple, substrings.repeated_words(docs, window).collect())) == brute_repeats([r[:2] for r in rows()], window)


def test_substring_dedup_of_few_words(spark, empty):
    r = random.Random(4)
    data = [(k, " ".join(r.choice("ab") for _ in range(r.randint(0, 40)))) for k in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, substrings.repeated_words(df, 12).collect())) == brute_repeats(data, 12)
    assert substrings.repeated_words(empty).count() == 0


def test_near_dedup(docs, empty):
    got = {r["doc_id"]: r for r in neardup.classes(docs).collect()}
    assert len(got) == len(TEXTS)
    assert [got[k]["class_id"] for k in (1, 2, 3)] == [1, 1, 1] and got[2]["copy_of"] == 1 and got[3]["copy_of"] == 3 and got[3]["n_links"] == 1
    assert got[12]["class_id"] == 11 and got[4]["class_id"] == 4 and got[17]["class_id"] == 5
    assert {k for k in got if got[k]["class_id"] != k} == {2, 3, 12, 17}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted([k for k in TEXTS if k not in (2, 3, 12, 17)] + [11])
    assert neardup.classes(empty).count() == 0


def test_near_dedup_against_all_pairs(spark):
    r = random.Random(12)
    data = []
    for g in range(12):
        base = prose(r.randint(15, 90), 100 + g).split()
        for c in range(5):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(WORDS)
            data.append((g * 10 + c, " ".join(w)))
    sets = {k: (lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)})(brute_windows(t)) for k, t in data}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            lo, hi = sorted((len(sets[a]), len(sets[b])))
            if a < b and hi <= int(lo * neardup.RATIO + 1e-9) and len(sets[a] & sets[b]) >= lo * neardup.CONTAINMENT:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in sets}


def test_near_copies_with_added_lines(spark):
    """Contained texts are found in much longer ones; a short line that unrelated texts quote ties nothing."""
    line = " ".join(prose(12, 700).split())
    data = []
    for g in range(30):
        base = prose(60 + g, 710 + g)
        data += [(g * 10, base), (g * 10 + 1, prose(9, 750 + g) + "\n" + base + "\n" + prose(9, 790 + g)), (g * 10 + 2, prose(200 + 50 * g, 830 + g) + "\n" + base + "\n" + prose(400, 870 + g))]
    short = prose(14, 701)
    data += [(400, short), (401, prose(5, 702) + "\n" + short + "\n" + prose(5, 703)), (402, line), (403, prose(80, 704) + "\n" + line), (404, prose(90, 705) + "\n" + line)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {k: {401: 400}.get(k, k if k >= 400 else k // 10 * 10) for k, _ in data}


def test_links_of_large_classes_are_counted(spark):
    r = random.Random(31)
    base = prose(90, 900).split()
    data = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        data.append((k, " ".join(w[: r.randint(75, 90)])))
    text = {}
    for k, t in data:
        text.setdefault(t, k)
    sets = {k: (lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)})(brute_windows(t)) for t, k in text.items()}
    want = {a: sum(a != b and len(sets[a] & sets[b]) >= min(len(sets[a]), len(sets[b])) * neardup.CONTAINMENT - 1e-9 for b in sets) for a in sets}
    got = {x["doc_id"]: x for x in neardup.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {k: got[k]["n_links"] for k in sets} == want and max(want.values()) > 100
    assert {k: got[k]["class_id"] for k in sets} == {k: 0 for k in sets}


def test_near_dedup_holds_few_shuffle_files(spark, monkeypatch):
    """The texts are shuffled once, and what a step has shuffled is gone before later ones add theirs."""
    r = random.Random(40)
    data = [(k, " ".join(f"{r.randrange(1 << 16):04x}" for _ in range(400))) for k in range(300)]
    whole = sum(len(t) for _, t in data)
    folders = [Path(f.getPath()) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*.data")}
    old, held = files(), {}

    def size():
        total = 0
        for f in files() - old:
            with suppress(FileNotFoundError):
                total += f.stat().st_size
        return total / whole

    def into_blocks(docs, real=neardup.blocks.into_blocks):
        out = real(docs)
        held["blocks"] = size()
        return out

    def materialize(df, name, real=neardup.materialize):
        if name in ("sketch", "sets"):
            end = time.time() + 20
            while (left := size()) > 0.3 and time.time() < end:  # Spark deletes them in a thread of its own
                time.sleep(0.1)
            held[name] = left
        return real(df, name)

    monkeypatch.setattr(neardup.blocks, "into_blocks", into_blocks)
    monkeypatch.setattr(neardup, "materialize", materialize)
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for x in limits:  # as with large tables
            spark.conf.set(x, "-1")
        got = neardup.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    finally:
        for x in limits:
            spark.conf.unset(x)
    assert {x["doc_id"]: x["class_id"] for x in got} == {k: k for k, _ in data}
    assert 0.5 < held["blocks"] < 1.5 and held["sketch"] < 0.3 and held["sets"] < 0.3, held


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 430)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {row["node"]: row["component"] for row in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in list(root)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    pages = [
        (1, "https://m.shop.example.net/x/7.html?utm=1"), (2, "http://shop.example.net/x/7/"), (3, "http://shop.example.net/x/8"), (4, "http://a.EXAMPLE.org/es/q#t"), (5, "http://example.org/en/12"), (6, "http://other.org/"),
        (7, None), (8, "nothing"), (9, "http://x.com/fr/a"), (10, "http://y.com/de/a"), (11, "http://xcom/fr/"), (12, "http://z.org"), (13, "http://q.net/1"), (14, "http://q.net/1"),
    ]
    html = {3: '<link rel="canonical" href="http://y.com/de/b">', 13: '<meta http-equiv="refresh" content="0; url=http://y.com/de/z"> <link href="http://x.com/fr/a" rel=canonical>', 10: None}
    df = spark.createDataFrame([(k, u, html.get(k, "<p>")) for k, u in pages] + [(20, "https://y.com/de/b", ""), (21, "https://m.y.com/de/z", "")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["reason"]) for r in urls.judge(df).collect()}
    assert got[1] == ("m.shop.example.net", "/x/7.html", None, "allow", "default")
    assert got[4] == ("a.example.org", "/es/q", "example.org/es/", "block", "rule") and got[5][2:4] == ("example.org/en/1", "block") and got[6][2:4] == ("org/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow", "default") and got[11][2] is None and got[12][2] is None
    assert got[3][2:] == (None, "block", "alias")  # canonical link to a blocked page
    assert got[13][2:] == got[14][2:] == (None, "allow", "alias")  # both a blocked and an allowed alias
    chain = [
        (30, "http://s.net/a?url=http%3A%2F%2Ft.net%2Fb&page=2", "<p>"), (31, "http://t.net/b/", '<link rel="canonical" href="/c/d">'), (32, "https://t.net/c/d.html?utm_source=x", '<link rel=canonical href="//u.net/e">'),
        (33, "http://u.net/e", '<meta http-equiv="refresh" content="0; url=http://v.com/de/f">'), (34, "http://v.com/de/f", '<link rel="canonical" href="http://s.net/a?page=2&url=http%3A%2F%2Ft.net%2Fb">'), (35, "http://s.net/a?page=3", "<p>"),
        (36, "http://w.net/g/h", '<link rel="canonical" href="i?x=1">'), (37, "http://w.net/g/i?x=1&ref=q", '<link rel="canonical" href="http://y.com/de/b">'), (38, "http://w.net/g/i?x=2", '<link rel="canonical" href="mailto:a@b.c">'),
    ]
    found = {r["page_id"]: (r["verdict"], r["reason"]) for r in urls.judge(spark.createDataFrame(chain, "page_id long, url string, html string").unionByName(df)).collect()}
    assert [found[k] for k in (30, 31, 32, 33)] == [("block", "alias")] * 4 and found[34] == ("block", "rule")  # a cycle of five
    assert found[35] == found[38] == ("allow", "default") and found[36] == found[37] == ("block", "alias")
    assert {k: found[k] for k in got} == {k: v[3:] for k, v in got.items()}
    more = urls.judge(df, spark.createDataFrame([], "a string, b string"))
    assert more.where("reason = 'alias'").count() == 0 and urls.judge(df.limit(0)).count() == 0


def test_pii(docs, empty):
    w = pii.train()
    got = sorted(map(tuple, pii.digests(docs).collect()), key=repr)
    want = []
    for k, t, *_ in rows():
        base, spans = pii.find_spans(t, w)
        kinds = [x[2] for x in base]
        want.append((k, *(kinds.count(x) for x in ("email", "ip", "card", "phone")), sha(pii._line(base)), pii._line(spans)))
    assert got == sorted(want, key=repr)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[13] == 'write to <email> from <ip> token = "<secret>" now' and clean[1] == BASE and clean[4] is None
    assert pii.digests(empty).count() == 0


def test_media(docs, empty):
    got = {r["doc_id"]: r for r in webp.media_digests(webp.media_column(docs)).collect()}
    for k, t in TEXTS.items():
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert got[1]["media_sha256"] == got[2]["media_sha256"] and webp.media_digests(webp.media_column(empty)).count() == 0


def test_shards(spark, docs, empty):
    out = sharding.assign(docs).collect()
    assert len(out) == len(rows())
    per = Counter(r["shard"] for r in out)
    assert max(per.values()) - min(per.values()) <= 1 and set(per) == set(range(8))
    for s, n in per.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    for r in out:
        raw = (dict(enumerate([])) or TEXTS)[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw.encode()) + 1, zlib.crc32(raw.encode()), "rows", None)
    assert sharding.assign(empty).count() == 0


def test_shards_keep_groups_together(spark):
    data = [(k, "hot" if k % 3 == 0 else f"pair{k // 3 % 150}" if k % 3 == 1 else f"alone{k}") for k in range(900)]
    out = sharding.assign(spark.createDataFrame(data, "doc_id long, text string")).collect()
    per = Counter(r["shard"] for r in out)
    assert max(per.values()) - min(per.values()) <= 1
    where = {r["doc_id"]: r["shard"] for r in out}
    groups = defaultdict(set)
    for k, t in data:
        groups[t].add(where[k])
    pairs = [g for t, g in groups.items() if t.startswith("pair")]
    assert sum(len(g) > 1 for g in pairs) <= 15 and len(groups["hot"]) >= 3  # a third of the rows cannot lie in one of eight shards


def test_toxicity(spark, docs, empty):
    r = random.Random(3)
    bad = ["idiot", "stupid", "moron", "worthless"]
    data = [(k, " ".join([prose(30, 500 + k)] + (r.sample(bad, 2) if k % 4 == 0 else []))) for k in range(240)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k, _ in data], "doc_id long, quality int, toxic int")
    model = toxicity.fit(*toxicity.training_rows(df, labels))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    for k, _ in data:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
    held = [k for k, _ in data if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == int(k % 4 == 0) for k in held) >= 0.95 * len(held)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows())
    assert toxicity.score(empty, model).count() == 0 and toxicity.training_rows(df, labels.limit(0)) == ([], [])
    assert toxicity.score(docs, toxicity.fit([], [])).agg(F.max("score")).first()[0] == 0


def test_stages_hold_little_memory(spark, bench, monkeypatch):
    """A stage's task cuts a few hundred texts at a time, and gives memory back once, when it is over."""
    rows = [pa.RecordBatch.from_pydict({"doc_id": list(range(k, k + 64)), "text": [prose(3500, k * 64 + j) for j in range(64)]}) for k in range(0, 256, 64)]
    docs = SimpleNamespace(schema="doc_id long, text string", mapInArrow=lambda run, schema: run)
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    common.kept("windows", "none", list)  # else what other tests left goes now
    run = fmindex.cut(docs, bench)
    given.clear()
    tracemalloc.start()
    try:
        out = sum(b.num_rows for b in run(iter(rows)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out == 256
    assert peak < 40 * rows[0].nbytes
    ended = len(given)
    assert ended and sum(b.num_rows for b in blocks.map_blocks(docs, lambda block, part: part.to_batches(), "")(iter([b.append_column("block", pa.array([0] * 64, pa.int32())) for b in rows]))) == 256
    assert len(given) == ended + 1
