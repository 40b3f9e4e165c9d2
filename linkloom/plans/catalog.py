"""Queries over the driver tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import graph, lookup, resolve, search
from linkloom import build
from linkloom.plans import fixtures as fx
from linkloom.plans.tables import arrow_fs, materialize, new_path
from linkloom.sources import binfmt, dumps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_E = """e as (select distinct s, d from (select o_custkey s, lead(o_custkey) over (order by o_orderkey) d, o_orderpriority p, o_orderstatus f from orders)
  where d is not null and s <> d and {where})"""
_URGENT = _E.format(where="p = '1-URGENT'")
_FINISHED = _E.format(where="f = 'F'")
_MULTI = _URGENT.replace("select distinct s, d from", "select s, d from")
_ALIVE = "w(k, id) as (select 0, c_custkey from customer union select k + 1, e.s from w join e on e.d = w.id where k < 64), alive as (select id from w group by id having max(k) = 64)"
_ASKED = "asked(query_id, s, t) as (values " + ", ".join(f"({k}, {s}, {t})" for k, (s, t) in enumerate([(0, 0), (0, 3), (0, 5), (0, 17), (0, 44), (0, 100), (0, 321), (0, 777), (0, 1400), (100, 0), (5, 777), (21, 3)])) + ")"


def query(sql: str | None = None):
    """Register a query under its name, and the SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _page_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.load(spark, sf, "customer")
    flag = F.when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0)
    ns = F.when(F.col("c_nationkey") == 7, 1).otherwise(0)
    filler = [F.lit(x) for x in ("0", "0.5", "'2022'", "'2022'", "1", "'wiki(te),(xt)'", "NULL")]
    return fx.render(c, "page", "c_custkey", [F.col("c_custkey"), ns, fx.quoted(F.concat(F.col("c_name"), F.lit(" it's a \\b, (x),(y)"))), F.lit(0), flag, *filler])


@query("select c_custkey old_id, case when c_nationkey = 7 then 1 else 0 end ns, c_name || ' it''s a \\b, (x),(y)' title, c_mktsegment = 'MACHINERY' is_redirect from customer")
def dump_tokenize_pages(spark, sf):
    return dumps.read_pages(_page_lines(spark, sf))


@query("select c_custkey src_old_id, 0 ns, 'Customer ' || c_custkey title from customer where c_mktsegment = 'MACHINERY'")
def dump_tokenize_redirects(spark, sf):
    c = fx.load(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'")
    lines = fx.render(c, "redirect", "c_custkey", [F.col("c_custkey"), F.lit(0), fx.quoted(F.concat(F.lit("Customer "), F.col("c_custkey"))), F.lit("''"), F.lit("NULL")])
    return dumps.read_redirects(lines)


@query("select o_custkey src_old_id, cast(o_orderkey % 3 as integer) ns, o_orderpriority title from orders")
def dump_tokenize_links(spark, sf):
    o = fx.load(spark, sf, "orders")
    return dumps.read_links(fx.render(o, "pagelinks", "o_orderkey", [F.col("o_custkey"), F.col("o_orderkey") % 3, fx.quoted(F.col("o_orderpriority")), F.lit(0)]))


@query("select cast(5 as integer) n_fields, count(*) n from customer where c_mktsegment = 'MACHINERY'")
def dump_bad_arity(spark, sf):
    c = fx.load(spark, sf, "customer")
    tail = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("0,7")).otherwise(F.lit("0"))
    lines = fx.render(c, "pagelinks", "c_custkey", [F.col("c_custkey"), F.lit(0), fx.quoted(F.col("c_name")), tail])
    return dumps.bad_tuples(lines, "pagelinks").groupBy("n_fields").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) n, cast(sum(c_custkey) as bigint) total from customer where c_mktsegment <> 'MACHINERY'")
def dump_drop_malformed(spark, sf):
    c = fx.load(spark, sf, "customer")
    tail = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("0,7")).otherwise(F.lit("0"))
    lines = fx.render(c, "pagelinks", "c_custkey", [F.col("c_custkey"), F.lit(0), fx.quoted(F.col("c_name")), tail])
    return dumps.read_links(lines, "DROPMALFORMED").agg(F.count(F.lit(1)).alias("n"), F.sum("src_old_id").alias("total"))


@query("select c_custkey old_id, c_name || ' it''s a \\b, (x),(y)' title from customer where c_nationkey <> 7 and c_mktsegment <> 'MACHINERY'")
def namespace_filter(spark, sf):
    return resolve.article_pages(dumps.read_pages(_page_lines(spark, sf)))


@query("select p_partkey, trim(replace(p_name, '_', ' ')) || '''s \"x\" \\' title from part")
def title_clean(spark, sf):
    p = fx.load(spark, sf, "part")
    raw = F.concat(F.lit("'__"), F.translate("p_name", " ", "_"), F.lit("\\'s_\\\"x\\\"_\\\\_'"))
    return p.select("p_partkey", text.clean_title(raw).alias("title"))


@query("""select p_partkey, case when ascii(p_name) between 97 and 122 then upper(substr(p_name, 1, 1)) || substr(p_name, 2) else p_name end up,
  substr(p_name, 3, greatest(length(p_name) - 4, 0)) cut, strpos(p_name, 'a') - 1 found, split_part(p_name || '|' || p_brand, '|', 1) alias, split_part(p_name || '#' || p_brand, '#', 1) frag from part""")
def string_functions(spark, sf):
    p, n = fx.load(spark, sf, "part"), F.col("p_name")
    return p.select(
        "p_partkey", text.first_upper(n).alias("up"), text.slice_text(n, 2, -2).alias("cut"), text.find_text(n, F.lit("a")).cast("long").alias("found"),
        text.before_alias(F.concat_ws("|", n, "p_brand")).alias("alias"), text.before_fragment(F.concat_ws("#", n, "p_brand")).alias("frag"),
    )


@query("select o_orderkey, cast(strftime(o_orderdate, '%Y%m%d') as integer) - 20000000 dump_date, strftime(o_orderdate, '%Y.%m.%d') shown from orders")
def dump_dates(spark, sf):
    o = fx.load(spark, sf, "orders")
    d = text.dump_date(F.concat(F.lit("xxwiki-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-page.sql.gz")))
    return o.select("o_orderkey", d.alias("dump_date"), text.show_date(d).alias("shown"))


@query("select p_name title, max(p_partkey) old_id from part group by 1")
def last_wins(spark, sf):
    return resolve.last_by_title(fx.load(spark, sf, "part").select(F.col("p_partkey").alias("old_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("at")), "at")


@query("select cast(row_number() over (order by c_name) - 1 as integer) new_id, c_custkey old_id, c_name title from customer")
def dense_page_ids(spark, sf):
    return graph.dense_ids(fx.pages(spark, sf))


_REDIRECT = "r as (select c_custkey s, (c_custkey + 1) % (select count(*) from customer) t from customer where c_mktsegment = 'MACHINERY')"


@query(f"with {_REDIRECT}, p as (select c_custkey k from customer where c_nationkey <> 3) select r.s src, r.t dst from r where r.s in (select k from p) and r.t in (select k from p)")
def redirect_semi_inner(spark, sf):
    p = fx.pages(spark, sf)
    rows = fx.redirects(spark, sf).join(p.withColumnRenamed("old_id", "dst"), "dst").select(F.col("src").alias("src_old_id"), F.lit(0).alias("ns"), "title")
    known = fx.load(spark, sf, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("old_id"), F.col("c_name").alias("title"))
    return resolve.resolve_redirects(rows, known, "strict")


@query(f"""with recursive {_REDIRECT}, ch(s, t, h) as (select s, t, 1 from r union all select ch.s, r.t, h + 1 from ch join r on r.s = ch.t where h < 101)
  select s src, t dst, h hops from ch where t not in (select s from r)""")
def redirect_closure(spark, sf):
    return resolve.close_redirects(fx.redirects(spark, sf))


@query(f"""with {_REDIRECT}, l as (select o_orderkey k, o_custkey s from orders)
  select k, coalesce(r.t, c.c_custkey) src from l left join r on r.s = l.s left join customer c on c.c_custkey = l.s and c.c_nationkey <> 3 where coalesce(r.t, c.c_custkey) is not null""")
def link_source_remap(spark, sf):
    ids = fx.load(spark, sf, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("new_id"), F.col("c_custkey").alias("old_id"), F.col("c_name").alias("title"))
    r = fx.redirects(spark, sf).select(F.col("src").alias("src_old_id"), F.col("dst").alias("dst_new_id"))
    l = fx.load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("src_old_id"))
    return resolve.remap_sources(l, r, ids).select("k", "src")


@query("""select o_custkey src, c.c_custkey dst from orders join customer c on c.c_custkey = o_orderkey % (select count(*) from customer) where o_orderstatus = 'O' and o_custkey <> c.c_custkey""")
def link_target_resolve(spark, sf):
    c = fx.load(spark, sf, "customer").select(F.col("c_custkey").alias("new_id"), F.col("c_name").alias("title"))
    ns = F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    named = fx.load(spark, sf, "orders").select(F.col("o_custkey").alias("src"), ns.alias("ns"), F.format_string("Customer#%09d", F.col("o_orderkey") % c.count()).alias("title"))
    return resolve.resolve_targets(named, c)


@query("""with l as (select o_custkey s, o_orderkey % (select count(*) from customer) t from orders), p as (select c_custkey k from customer where c_mktsegment <> 'MACHINERY'),
  r as (select c_custkey k, c_custkey + 1 t from customer where c_mktsegment in ('MACHINERY', 'BUILDING'))
  select l.s src, coalesce(p.k, q.k) dst from l left join p on p.k = l.t left join r on r.k = l.t left join p q on q.k = r.t where coalesce(p.k, q.k) is not null""")
def xml_target_fallback(spark, sf):
    c = fx.load(spark, sf, "customer")
    name = lambda k: F.format_string("t%d", k)
    pages = c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("new_id"), name(F.col("c_custkey")).alias("title"))
    red = c.where("c_mktsegment in ('MACHINERY', 'BUILDING')").select(name(F.col("c_custkey")).alias("title"), name(F.col("c_custkey") + 1).alias("target"))
    l = fx.load(spark, sf, "orders").select(F.col("o_custkey").alias("src"), name(F.col("o_orderkey") % c.count()).alias("title"))
    return resolve.resolve_targets(l, pages, red, drop_self=False)


@query(f"with {_E.format(where='true')} select s src, d dst from e")
def link_distinct(spark, sf):
    return fx.links(spark, sf, "all").distinct()


@query(f"with {_MULTI} select s src, string_agg(d, ',' order by d) links from e group by s")
def adjacency_sorted(spark, sf):
    return graph.adjacency(fx.links(spark, sf)).select("src", F.array_join(F.col("links").cast("array<string>"), ",").alias("links"))


@query(f"with {_MULTI} select c_custkey id, count(e.s) degree from customer left join e on e.s = c_custkey group by 1")
def out_degree(spark, sf):
    return graph.out_degree(*fx.graph(spark, sf))


@query(f"with {_MULTI} select c_custkey id, count(e.d) degree from customer left join e on e.d = c_custkey group by 1")
def in_degree(spark, sf):
    return graph.in_degree(*fx.graph(spark, sf))


@query(f"with {_MULTI} select count(*) n_pages, (select count(*) from e) total_links, cast(sum(octet_length(encode(c_name))) as bigint) total_title_bytes from customer")
def graph_totals(spark, sf):
    return graph.totals(*fx.graph(spark, sf))


@query(f"with {_URGENT} select c_custkey id from customer where c_custkey not in (select s from e)")
def dead_ends_round1(spark, sf):
    return graph.dead_ends(*fx.graph(spark, sf))


@query(f"with recursive {_URGENT}, {_ALIVE} select cast(r as integer) round, count(*) removed from (select id, max(k) + 1 r from w group by id having max(k) < 64) group by 1")
def trim_rounds(spark, sf):
    _, _, removed = graph.trim(*fx.graph(spark, sf))
    return spark.createDataFrame([(k + 1, n) for k, n in enumerate(removed)], "round int, removed long")


@query(f"""with recursive {_URGENT}, {_ALIVE}, ids as (select id, cast(row_number() over (order by id) - 1 as integer) n from alive)
  select a.n src, b.n dst from e join ids a on a.id = e.s join ids b on b.id = e.d""")
def trimmed_graph_reindexed(spark, sf):
    nodes, edges = fx.graph(spark, sf)
    nodes, edges, _ = graph.trim(nodes, edges.distinct())
    return graph.reindex(nodes, edges)[1]


@query(f"with recursive {_FINISHED}, {_ALIVE} select id, cast(row_number() over (order by id) - 1 as integer) new_id from alive")
def trim_survivors(spark, sf):
    nodes, _, _ = graph.trim(*fx.graph(spark, sf, "F"))
    from linkloom.plans.tables import with_position

    return with_position(nodes.select("id"), ["id"], "new_id").select("id", F.col("new_id").cast("int").alias("new_id"))


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    return fx.pages(spark, sf).select(F.col("old_id").alias("id"), "title")


@query("select c_custkey id, c_name title from customer where c_name = 'Customer#000000077'")
def title_exact(spark, sf):
    return lookup.exact(_titles(spark, sf), "Customer#000000077")


@query("select coalesce(min(c_custkey), -1) first, coalesce(max(c_custkey), -1) last from customer where starts_with(c_name, 'Customer#0000001')")
def title_prefix(spark, sf):
    return lookup.prefix_range(_titles(spark, sf), "Customer#0000001")


@query("""with m as (select c_name t from customer where starts_with(c_name, 'Customer#00000001') order by 1 limit 101), s as (select count(*) n, min(t) a from m)
  select t title from m, s where not (n > 1 and t = a and strlen(a) <= 18) order by t limit 100""")
def title_complete(spark, sf):
    return lookup.complete(_titles(spark, sf), "Customer#00000001")


@query("""with m as (select c_name t from customer where starts_with(c_name, 'Customer#00000001') order by 1 limit 2), s as (select min(t) a, max(t) b, count(*) n from m)
  select case when n = 0 then ' (not found)' when n > 1 and strlen(a) <= 18 then substr(b, 18) else substr(a, 18) end hint from s""")
def title_hint(spark, sf):
    return lookup.hint(_titles(spark, sf), "Customer#00000001")


@query(f"""with recursive {_URGENT}, b(id, k) as (select 0, 0 union select e.d, k + 1 from b join e on e.s = b.id where k < 10)
  select k, count(*) n from (select id, cast(min(k) as integer) k from b group by id) group by k""")
def bfs_levels(spark, sf):
    _, edges = fx.graph(spark, sf)
    starts = spark.createDataFrame([(0,)], "start long")
    return search.bfs_levels(edges, starts).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = fx.graph(spark, sf)
    nodes, edges, _ = graph.trim(nodes, edges.distinct())
    asked = [(0, 0), (0, 3), (0, 5), (0, 17), (0, 44), (0, 100), (0, 321), (0, 777), (0, 1400), (100, 0), (5, 777), (21, 3)]
    rows = [(k, f"Customer#{s:09d}", f"Customer#{t:09d}") for k, (s, t) in enumerate(asked)]
    return search.shortest_paths(materialize(nodes, "nodes"), edges, spark.createDataFrame(rows, "query_id int, start string, target string"))


_PATHS = f"""with recursive {_URGENT}, {_ALIVE}, {_ASKED}, x as (select * from e where s in (select id from alive) and d in (select id from alive)),
  back(dst, id, k) as (select t, t, 0 from asked where t in (select id from alive) union select dst, x.s, k + 1 from back join x on x.d = back.id where k < 10),
  dist as (select dst, id, min(k) k from back group by dst, id),
  walk(query_id, dst, cur, k, step) as (
    select query_id, t, s, dist.k, 0 from asked join dist on dist.dst = t and dist.id = s
    union all
    select query_id, dst, n, k - 1, step + 1 from (
      select w.query_id, w.dst, w.k, w.step, min(x.d) n from walk w join x on x.s = w.cur join dist on dist.dst = w.dst and dist.id = x.d and dist.k = w.k - 1 group by 1, 2, 3, 4)),
  named as (select query_id, step, c_name title from walk join customer on c_custkey = cur)"""


@query(_PATHS + """ select a.query_id, case when a.s not in (select id from alive) then 'start_missing' when a.t not in (select id from alive) then 'target_missing'
    when p.path is null then 'no_path' else 'ok' end status, p.hops, p.path
  from asked a left join (select query_id, cast(max(step) as integer) hops, string_agg(title, ' -> ' order by step) path from named group by 1) p using (query_id)""")
def shortest_path_batch(spark, sf):
    return _paths(spark, sf).withColumn("path", F.array_join("path", " -> "))


@query(_PATHS + " select query_id, step, title from named")
def path_steps(spark, sf):
    return search.path_steps(_paths(spark, sf))


@query(_PATHS + """, lost as (select a.query_id, case when a.s not in (select id from alive) or a.t not in (select id from alive) then (case when a.s not in (select id from alive) then 'start' else 'target' end) || ' is not in the graph' else 'No path found' end line
  from asked a where a.query_id not in (select query_id from named)) select * from lost""")
def no_path_report(spark, sf):
    return search.show_path(_paths(spark, sf).where("status <> 'ok'"))


@query(f"with {_URGENT} select s src, 'C' || d target from e union select distinct s, 'Seen' from e")
def wikitext_links(spark, sf):
    edges = fx.links(spark, sf).distinct()
    piece = F.concat(F.lit("see [[c"), F.col("dst"), F.lit("#h|text]] {{box|[[Hidden]] {{x}} }} [[File:a.png]] [[seen]]"))
    t = edges.select("src", piece.alias("text"))
    return t.select("src", F.explode(text.extract_links("text")).alias("target")).distinct()


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) k from events")
def json_index_extract(spark, sf):
    e = fx.load(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""select * from (values ('pagetable', 'https://m/p-20221201-page.sql.gz', 221201), ('redirecttable', 'https://m/r.sql.gz', 221201), ('pagelinkstable', 'https://m/l.sql.gz', 221201)) v(job, url, dump_date)""")
def dump_index(spark, sf):
    files = {"pagetable": "/p-20221201-page.sql.gz", "redirecttable": "/r.sql.gz", "pagelinkstable": "/l.sql.gz", "other": "/o"}
    jobs = ",".join(f'"{j}":{{"status":"done","files":{{"xxwiki-20221201-{j}.sql.gz":{{"url":"{u}"}}}}}}' for j, u in files.items())
    doc = spark.createDataFrame([(f'{{"wikis":{{"xxwiki":{{"jobs":{{{jobs}}}}}}}}}',)], "value string")
    return dumps.dump_index(doc, "xxwiki", "https://m")


@query("select value, case when value < 1 then '1ms' when value < 1000 then cast(cast(floor(value) as bigint) as varchar) || 'ms' else printf('%.1f sec', value / 1000) end shown from (select distinct round(value, 0) as value from events)")
def duration_format(spark, sf):
    e = fx.load(spark, sf, "events").select(F.round("value", 0).alias("value")).distinct()
    return e.select("value", text.show_duration(F.col("value")).alias("shown"))


def _zipped(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Lines that went through gzipped files."""
    path = new_path(spark, "dump")
    lines.write.option("compression", "gzip").text(path)
    return dumps.read_lines(spark, path, spark.sparkContext.defaultParallelism)


def _dumps(spark: SparkSession, sf: str, redirected: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Page, redirect and link tables of the customers' graph, read from gzipped statements.

    Machinery customers are redirect pages; those of segment ``redirected`` have a redirect to the next customer.
    """
    c, n = fx.load(spark, sf, "customer"), fx.load(spark, sf, "customer").count()
    name = lambda k: fx.quoted(F.format_string("Customer#%09d", k))
    rest = [F.lit(x) for x in ("0", "0.5", "'2022'", "'2022'", "1", "'wikitext'", "NULL")]
    flag = F.when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0)
    pages = fx.render(c, "page", "c_custkey", [F.col("c_custkey"), F.lit(0), fx.quoted(F.col("c_name")), F.lit(0), flag, *rest])
    red = c.where(F.col("c_mktsegment") == redirected)
    red = fx.render(red, "redirect", "c_custkey", [F.col("c_custkey"), F.lit(0), name((F.col("c_custkey") + 1) % n), F.lit("''"), F.lit("NULL")])
    links = fx.render(fx.links(spark, sf).select("src", "dst"), "pagelinks", "src", [F.col("src"), F.lit(0), name(F.col("dst")), F.lit(0)])
    return dumps.read_pages(_zipped(spark, pages)), dumps.read_redirects(_zipped(spark, red)), dumps.read_links(_zipped(spark, links))


_ART = "art as (select c_custkey k from customer where c_mktsegment <> 'MACHINERY')"
_BUILT = """, w(k, id) as (select 0, k from art union select k + 1, x.s from w join x on x.d = w.id where k < 64), alive as (select id from w group by id having max(k) = 64),
  ids as (select id, cast(row_number() over (order by id) - 1 as integer) n from alive) select a.n src, b.n dst from x join ids a on a.id = x.s join ids b on b.id = x.d"""


@query(f"""with recursive {_MULTI}, {_ART}, r as (select c_custkey s, (c_custkey + 1) % (select count(*) from customer) t from customer where c_mktsegment = 'BUILDING'),
  q as (select s, t from r where t in (select k from art)), ch(s, t, h) as (select s, t, 1 from q union all select ch.s, q.t, h + 1 from ch join q on q.s = ch.t where h < 101),
  ends as (select s, t from ch where t not in (select s from q)),
  x as (select coalesce(ends.t, art.k) s, e.d from e left join ends on ends.s = e.s left join art on art.k = e.s where coalesce(ends.t, art.k) <> e.d and e.d in (select k from art)){_BUILT}""")
def dump_build_strict(spark, sf):
    return build.from_tables(*_dumps(spark, sf, "BUILDING"), "strict")[1]


@query(f"""with recursive {_MULTI}, {_ART}, {_REDIRECT}, ch(s, t, h) as (select s, t, 1 from r union all select ch.s, r.t, h + 1 from ch join r on r.s = ch.t where h < 101),
  ends as (select s, t from ch where t not in (select s from r)),
  x as (select coalesce(a.t, p.k) s, coalesce(q.k, b.t) d from e left join ends a on a.s = e.s left join art p on p.k = e.s left join ends b on b.s = e.d left join art q on q.k = e.d
    where coalesce(a.t, p.k) <> coalesce(q.k, b.t)){_BUILT}""")
def dump_build_resolve(spark, sf):
    return build.from_tables(*_dumps(spark, sf, "MACHINERY"), "resolve")[1]


@query(f"""with recursive {_URGENT}, {_ART}, {_REDIRECT},
  x as (select e.s, coalesce(p.k, q.k) d from e left join art p on p.k = e.d left join r on r.s = e.d left join art q on q.k = r.t where e.s in (select k from art) and coalesce(p.k, q.k) is not null){_BUILT}""")
def xml_build(spark, sf):
    c, n = fx.load(spark, sf, "customer"), fx.load(spark, sf, "customer").count()
    name = lambda k: F.format_string("C%09d", k)
    out = fx.links(spark, sf).groupBy(F.col("src").alias("c_custkey")).agg(F.array_join(F.collect_list(F.concat(F.lit("[["), name(F.col("dst")), F.lit("|see]] "))), "").alias("text"))
    to = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit('<redirect title="'), name((F.col("c_custkey") + 1) % n), F.lit('" />'))).otherwise("")
    page = F.concat(F.lit("<page><title>"), name(F.col("c_custkey")), F.lit("</title><ns>0</ns>"), to, F.lit("<revision><text>"), F.coalesce("text", F.lit("")), F.lit("</text></revision></page>"))
    path = new_path(spark, "xml")
    ends = spark.createDataFrame([(-1, "<mediawiki>"), (1 << 60, "</mediawiki>")], "k long, value string")
    lines = c.join(out, "c_custkey", "left").select(F.col("c_custkey").cast("long").alias("k"), page.alias("value")).unionByName(ends)
    lines.repartition(1).sortWithinPartitions("k").select("value").write.text(path)  # a dump is one document
    return build.from_xml(dumps.read_xml(spark, path))[1]


def _graph_files(spark: SparkSession, sf: str) -> dict[str, tuple[str, str, int]]:
    """By name the path, layout and format number of files of one graph: each layout, one packed, one updated."""
    import lzma

    nodes, edges = fx.graph(spark, sf)
    edges = materialize(edges, "edges")
    folder = new_path(spark, "files")
    files = {k: (f"{folder}/{k}", k, 1) for k in "ABC"} | {"packed": (f"{folder}/packed", "C", 1), "updated": (f"{folder}/updated", "A", 2)}
    for k in "ABC":
        binfmt.write_graph(nodes, edges, files[k][0], k)
    fs, base = arrow_fs(folder)
    with fs.open_input_stream(f"{base}/C") as source, fs.open_output_stream(f"{base}/packed") as out:
        out.write(lzma.compress(source.read()))
    binfmt.update_graph(spark, files["A"][0], files["updated"][0])
    return files


_FILES = "f(file, version) as (values ('A', 1), ('B', 1), ('C', 1), ('packed', 1), ('updated', 2))"


@query(f"with {_MULTI}, {_FILES} select file, cast(s as integer) src, cast(row_number() over (partition by file, s order by d) - 1 as integer) pos, cast(d as integer) dst from e, f")
def graph_file_edges(spark, sf):
    parts = [binfmt.read_edges(spark, path, layout, version).select(F.lit(k).alias("file"), "src", "pos", "dst") for k, (path, layout, version) in _graph_files(spark, sf).items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"with {_FILES} select file, cast(c_custkey as integer) id, c_name title from customer, f")
def graph_file_nodes(spark, sf):
    parts = [binfmt.read_nodes(spark, path, layout, version).select(F.lit(k).alias("file"), "id", "title") for k, (path, layout, version) in _graph_files(spark, sf).items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"""with {_MULTI}, {_FILES} select file, cast(221201 as bigint) dump_date, cast(version as bigint) as version, (select count(*) from customer) n_pages, (select count(*) from e) total_links,
  (select cast(sum(octet_length(encode(c_name))) as bigint) from customer) total_title_bytes from f""")
def graph_file_headers(spark, sf):
    parts = [binfmt.read_header(spark, path, layout, version).withColumn("file", F.lit(k)) for k, (path, layout, version) in _graph_files(spark, sf).items()]
    return reduce(DataFrame.unionByName, parts)
