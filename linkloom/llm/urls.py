"""URL filters with redirect equivalence (operator 7).

Pages that a redirect or a canonical link ties together are aliases: the usual
redirects of sites (scheme, ``m.`` and ``www.``, end slash, ``.html``, tracking
keys of the query), targets that a url carries in a query key, canonical
links and meta refreshes in the html, also relative ones. Rules
decide what they fit; connected components over the edges carry a block to
those aliases that no rule fits, unless an explicit allow is in the same
component, which goes before. Without either the verdict is allow.

Defined cases: a null url, or one without ``://``, has empty host and path,
fits no rule, has no aliases and is allowed; repeated urls get equal verdicts;
an empty table gives no rows; null html has no links; extra columns are not
carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.llm.components import connected_components

#: (action, rule): host, then a path prefix that begins with a slash.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Keys of a query that change nothing of what is shown, and keys whose value is where the page sends one.
TRACKING = r"^(?:utm_[a-z_]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid)(?:=|$)"
TARGET = r"^(?:url|u|to|goto|next|target|dest|destination|redirect|redirect_uri|redirect_url|return|return_url)=[A-Za-z][A-Za-z0-9+.-]*(?:://|%3[Aa]%2[Ff]%2[Ff])"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))


def host_path(pages: DataFrame) -> DataFrame:
    """Adds host and path, replacing columns of these names."""
    rest = _after_scheme(F.col("url"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def fitting_rule(rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits host and path; nulls where none does.

    The rules become one conditional expression, longest first; of equally
    long ones that fit, the one listed first counts.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def query_keys(url: Column) -> Column:
    """The parts of a url's query, as an array."""
    return F.split(F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1), "&")


def canonical(host: Column, path: Column, url: Column) -> Column:
    """The address that a site's usual redirects end at: no scheme, m. or www., fragment, end slash, .html
    or tracking key; the other parts of the query in their order."""
    bare = F.regexp_replace(host, r"^(?:www\.|m\.)+(?=[^.]+\.)", "")
    rest = F.array_join(F.array_sort(F.filter(query_keys(url), lambda x: (x != "") & ~F.rlike(x, F.lit(TRACKING)))), "&")
    query = F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise("")
    return F.concat(bare, F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", ""), query)


def absolute(target: Column, url: Column) -> Column:
    """A link's target seen from a url; null for an empty one or one of a scheme without host."""
    scheme = F.regexp_extract(url, r"^([^:]*):", 1)
    host = F.regexp_extract(url, r"^[^:]*://[^/?#]*", 0)
    page = F.regexp_extract(url, r"^[^:]*://[^?#]*", 0)
    folder = F.when(F.rlike(page, F.lit(r"^[^:]*://[^/]*$")), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(host, target))
        .when(F.startswith(target, F.lit("?")), F.concat(page, target))
        .when((target == "") | F.startswith(target, F.lit("#")) | F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), None)
        .otherwise(F.concat(folder, target))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) hex digests of addresses: each page to its canonical address, and to the targets of its
    query and of the canonical links and meta refreshes in its html."""
    key = lambda c: F.md5(c.cast("binary"))
    here = pages.where(F.col("host") != "").withColumn("a", key(F.col("url")))
    redirect = here.select("a", key(canonical(F.col("host"), F.col("path"), F.col("url"))).alias("b"))
    sent = here.select("a", F.explode(F.filter(query_keys(F.col("url")), lambda x: F.rlike(x, F.lit(TARGET)))).alias("part"))
    goals = sent.select("a", F.try_url_decode(F.regexp_replace("part", r"^[^=]*=", "")).alias("url")).where(F.contains("url", F.lit("://")))
    if "html" in pages.columns:
        marked = here.where(F.contains(F.lower("html"), F.lit("canonical")) | F.contains(F.lower("html"), F.lit("http-equiv")))
        tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b([^>]*)>"), F.lit(1))
        tag = marked.select("a", "url", F.explode(tags).alias("tag"))
        href = F.when(F.col("tag").rlike(r"(?i)rel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)", 1))
        fresh = F.when(F.col("tag").rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?i)url\s*=\s*'?([^\"'\s>;]+)", 1))
        goals = goals.unionByName(tag.select("a", absolute(F.coalesce(href, fresh), F.col("url")).alias("url")))
    goal = host_path(goals.where("url is not null"))
    return redirect.unionByName(goal.select("a", key(canonical(F.col("host"), F.col("path"), F.col("url"))).alias("b")))


def judge(pages: DataFrame, edges: DataFrame | None = None, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and reason (rule, alias or default) of every page."""
    parsed = host_path(pages.select("page_id", "url", *[c for c in ("html",) if c in pages.columns]))
    rule, action = fitting_rule(rules)
    ruled = parsed.drop("html").withColumn("rule", rule).withColumn("action", action).withColumn("node", F.when(F.col("host") != "", F.md5(F.col("url").cast("binary"))))
    members = connected_components(link_edges(parsed) if edges is None else edges)
    # one row per address that a rule decides, then one row per component
    decided = ruled.where("action is not null").groupBy("node").agg(F.max(F.col("action") == "allow").alias("allow"), F.max(F.col("action") == "block").alias("block"))
    voice = members.join(decided, "node").groupBy("component").agg(F.when(F.max("allow"), "allow").when(F.max("block"), "block").alias("alias"))
    known = members.join(voice, "component").select("node", "alias")
    out = ruled.join(known, "node", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", "alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default").alias("reason"),
    )


def op7_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_RULE_SQL = "".join(f" when (host = '{t.partition('/')[0]}' or ends_with(host, '.{t.partition('/')[0]}')) and starts_with(path, '/{t.partition('/')[2]}') then '{{{k}}}'" for k, (_, t) in enumerate(sorted(RULES, key=lambda r: -len(r[1]))))


def _cases(values: list[str]) -> str:
    return "case" + _RULE_SQL.format(*values) + " end"


_ordered = sorted(RULES, key=lambda r: -len(r[1]))

#: Edges from the urls (the html of these tables has no canonical link or refresh), and their closure.
SQL = f"""
with recursive parts as (
  select page_id, url,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
hp as (
  select page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path, string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&') as keys from parts),
ruled as (
  select *, {_cases([t for _, t in _ordered])} as rule, {_cases([a for a, _ in _ordered])} as action,
    array_to_string(list_sort([x for x in keys if x <> '' and not regexp_matches(x, '{TRACKING}')]), '&') as query from hp),
edges as (
  select distinct url as a, (case when regexp_matches(host, '^(www\\.|m\\.)+[^.]+\\.') then regexp_replace(host, '^(www\\.|m\\.)+', '') else host end)
      || regexp_replace(regexp_replace(path, '\\.html?$', ''), '/+$', '') || case when query <> '' then '?' || query else '' end as b
  from ruled where host <> ''),
both_ways as (select a, b from edges union select b, a from edges),
reach(node, other) as (
  select a, b from both_ways union select r.node, e.b from reach r join both_ways e on e.a = r.other),
voice as (
  select node, case when bool_or(action = 'allow') then 'allow' when bool_or(action = 'block') then 'block' end as alias
  from reach join ruled on ruled.url = reach.other group by node)
select page_id, host, path, rule, coalesce(action, alias, 'allow') as verdict,
  case when rule is not null then 'rule' when alias is not null then 'alias' else 'default' end as reason
from ruled left join voice on ruled.url = voice.node and ruled.host <> ''
"""
