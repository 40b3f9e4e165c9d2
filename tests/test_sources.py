import gzip
import lzma

import pytest

from linkloom.build import from_tables, from_xml
from linkloom.sources import binfmt, dumps

PAGES = r"""-- comment
INSERT INTO `page` VALUES (0,0,'T\'_0),(x',0,0,0,0.5,'2022','2022',0,'wiki(text)',NULL),(1,0,'Plain_title',0,1,0,0.5,'2022','2022',1,'wikitext',NULL);
CREATE TABLE `page` (x);
"""


def test_pages_from_gzip(spark, tmp_path):
    path = tmp_path / "page.sql.gz"
    path.write_bytes(gzip.compress(PAGES.encode()))
    rows = dumps.read_pages(dumps.read_lines(spark, str(path), 2)).orderBy("old_id").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "T' 0),(x", False), (1, 0, "Plain title", True)]


def test_arity(spark):
    lines = spark.createDataFrame([("INSERT INTO `pagelinks` VALUES (1,0,'a',0),(2,0,'b'),(3,0,'c',0);",)], "value string")
    assert dumps.bad_tuples(lines, "pagelinks").first()["n_fields"] == 3
    assert {r["src_old_id"] for r in dumps.read_links(lines, "DROPMALFORMED").collect()} == {1, 3}
    with pytest.raises(Exception, match="wrong number of fields"):
        dumps.read_links(lines).collect()


def test_index_fails_unless_done(spark):
    doc = '{"wikis":{"w":{"jobs":{"pagetable":{"status":"waiting","files":{"w-20221201-p":{"url":"/p"}}}}}}}'
    with pytest.raises(Exception, match="not complete"):
        dumps.dump_index(spark.createDataFrame([(doc,)], "value string"), "w").collect()


def test_build_from_tables(spark):
    pages = spark.createDataFrame([(10, 0, "A", False), (11, 0, "B", False), (12, 0, "C", False), (13, 0, "R", True), (14, 1, "N", False)], "old_id long, ns int, title string, is_redirect boolean")
    red = spark.createDataFrame([(13, 0, "B")], "src_old_id long, ns int, title string")
    links = spark.createDataFrame([(10, 0, "R"), (11, 0, "A"), (10, 0, "C"), (13, 0, "A"), (11, 0, "B")], "src_old_id long, ns int, title string")
    nodes, edges = from_tables(pages, red, links, "resolve")
    assert [tuple(r) for r in nodes.orderBy("id").collect()] == [(0, "A"), (1, "B")]
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 0), (1, 0)]
    nodes, edges = from_tables(pages, red, links)  # strict: R is unknown, so A has no live link
    assert nodes.count() == 0 and edges.count() == 0


def test_build_from_xml(spark, tmp_path):
    page = lambda t, x="", ns=0, r="": f"<page><title>{t}</title><ns>{ns}</ns>{r}<revision><text>{x}</text></revision></page>"
    xml = "<mediawiki>" + page("A", "[[b]] [[Red]]") + page("B", "[[A]] [[dead]]") + page("Dead") + page("Self", "[[self]]") + page("Talk", "[[A]]", 1) + page("Red", r='<redirect title="B"/>') + "</mediawiki>"
    path = tmp_path / "d.xml"
    path.write_text(xml)
    nodes, edges = from_xml(dumps.read_xml(spark, str(path)))
    assert [tuple(r) for r in nodes.orderBy("id").collect()] == [(0, "A"), (1, "B"), (2, "Self")]
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (0, 1), (1, 0), (2, 2)]


@pytest.mark.parametrize("layout, n", [("A", 3), ("B", 4), ("C", 0), ("C", 1), ("C", 5)])
def test_binary_round_trip(spark, tmp_path, layout, n):
    titles = [f"té{k}" for k in range(n)]
    pairs = [(k, (k * 3 + j) % n) for k in range(n) for j in range(k % 3)]
    nodes = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    edges = spark.createDataFrame(pairs, "src int, dst int")
    path = str(tmp_path / "g.bin")
    binfmt.write_graph(nodes, edges, path, layout)
    assert [r["title"] for r in binfmt.read_nodes(spark, path, layout).orderBy("id").collect()] == titles
    got = binfmt.read_edges(spark, path, layout).orderBy("src", "pos").collect()
    assert [(r["src"], r["dst"]) for r in got] == sorted(pairs)
    data = open(path, "rb").read()
    if layout == "C":
        assert len(data) == 20 + 2 * n + -2 * n % 8 + 4 * len(pairs) + 2 * n + sum(len(t.encode()) for t in titles)
    assert binfmt.parse(lzma.compress(data), layout)[0]["n_pages"] == n
    with pytest.raises(binfmt.FormatError):
        binfmt.parse(b"nonsense", layout)
    with pytest.raises(binfmt.FormatError):
        binfmt.parse(data, layout, version=2)
    if layout == "A":
        binfmt.update_graph(spark, path, path + "2")
        assert binfmt.read_header(spark, path + "2", "A", None).first()["version"] == 2


def test_degree_limit(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "a")], "id int, title string")
    with pytest.raises(Exception, match="65535"):
        binfmt.write_graph(nodes, spark.range(65_536).selectExpr("0 as src", "0 as dst"), str(tmp_path / "x"), "C")
