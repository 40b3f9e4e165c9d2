import random
from collections import deque

from linkloom.operators import graph, lookup, resolve, search
from linkloom.streaming.paths import answer_stream


def model_path(edges, s, t, cap=10):
    """Distances to t, then the least next node each time."""
    back = {}
    for a, b in edges:
        back.setdefault(b, set()).add(a)
    dist, queue = {t: 0}, deque([t])
    while queue:
        x = queue.popleft()
        for y in back.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                queue.append(y)
    if dist.get(s, cap + 1) > cap:
        return None
    path = [s]
    while path[-1] != t:
        path.append(min(b for a, b in edges if a == path[-1] and dist.get(b) == dist[path[-1]] - 1))
    return path


def model_trim(nodes, edges):
    nodes, edges, rounds = set(nodes), list(edges), []
    while dead := nodes - {a for a, _ in edges}:
        rounds.append(len(dead))
        nodes -= dead
        edges = [(a, b) for a, b in edges if b not in dead]
    return nodes, edges, rounds


def frames(spark, n, edges):
    return spark.createDataFrame([(k, f"t{k:03d}") for k in range(n)], "id int, title string"), spark.createDataFrame(edges, "src int, dst int")


def test_paths_against_model(spark):
    rng = random.Random(3)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(85)] + [(k, k + 1) for k in range(40, 55)] + [(1, 2), (1, 2), (3, 3)]
    nodes, e = frames(spark, n, edges)
    asked = [(k, rng.randrange(n), rng.randrange(n)) for k in range(60)] + [(60, 40, 50), (61, 40, 51), (62, 7, 7)]
    q = spark.createDataFrame([(k, f"t{s:03d}", f"t{t:03d}") for k, s, t in asked] + [(90, "no", "t001"), (91, "t001", "no"), (92, "no", "no")], "query_id int, start string, target string")
    got = {r["query_id"]: r for r in search.shortest_paths(nodes, e, q).collect()}
    for k, s, t in asked:
        want = model_path(set(edges), s, t)
        assert got[k]["status"] == ("ok" if want else "no_path")
        assert got[k]["path"] == (want and [f"t{x:03d}" for x in want]) and got[k]["hops"] == (len(want) - 1 if want else None)
    assert [got[k]["status"] for k in (90, 91, 92)] == ["start_missing", "target_missing", "start_missing"]


def test_trim_against_model(spark):
    rng = random.Random(5)
    n = 50
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(60)]
    nodes, e = frames(spark, n, edges)
    alive, kept, removed = graph.trim(nodes, e)
    want = model_trim(range(n), edges)
    assert {r["id"] for r in alive.collect()} == want[0] and sorted(map(tuple, kept.collect())) == sorted(want[1]) and removed == want[2]
    ids, new = graph.reindex(alive, kept)
    order = {x: k for k, x in enumerate(sorted(want[0]))}
    assert sorted(map(tuple, new.collect())) == sorted((order[a], order[b]) for a, b in want[1])
    assert graph.trim(*frames(spark, 3, [(0, 1), (1, 2)]))[2] == [1, 1, 1]


def test_byte_order(spark):
    titles = ["�", "a", "\U0001f600", "Z", "é"]
    rows = graph.dense_ids(spark.createDataFrame(list(enumerate(titles)), "old_id long, title string")).orderBy("new_id").collect()
    assert [r["title"] for r in rows] == ["Z", "a", "é", "�", "\U0001f600"]


def test_redirect_closure(spark):
    chain = [(k, k + 1) for k in range(1000, 1101)]  # 101 links from 1000
    long = [(k, k + 1) for k in range(2000, 2102)]  # 102 from 2000
    rows = [(1, 2), (2, 3), (10, 11), (11, 10), (9, 10)] + chain + long
    got = {r["src"]: (r["dst"], r["hops"]) for r in resolve.close_redirects(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got[1] == (3, 2) and got[2] == (3, 1) and got[1000] == (1101, 101) and got[2001] == (2102, 101)
    assert not {9, 10, 11, 2000} & set(got)


def test_lookups(spark):
    nodes = spark.createDataFrame(list(enumerate(["ab", "abc", "abcd", "abx", "b"])), "id int, title string")
    assert tuple(lookup.prefix_range(nodes, "abc").first()) == (1, 2) and tuple(lookup.prefix_range(nodes, "z").first()) == (-1, -1)
    assert [r[0] for r in lookup.complete(nodes, "ab").collect()] == ["abc", "abcd", "abx"]
    assert [r[0] for r in lookup.complete(nodes, "b").collect()] == ["b"]
    assert lookup.hint(nodes, "ab").first()[0] == "c" and lookup.hint(nodes, "q").first()[0] == " (not found)" and lookup.hint(nodes, "b").first()[0] == ""


def test_stream_of_queries(spark, tmp_path):
    nodes, e = frames(spark, 3, [(0, 1), (1, 2), (2, 0)])
    spark.createDataFrame([(1, "t000", "t002")], "query_id int, start string, target string").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("query_id int, start string, target string").parquet(str(tmp_path / "q"))
    answer_stream(stream, nodes, e, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["path"] == ["t000", "t001", "t002"]
