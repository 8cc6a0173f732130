"""URL filters with redirect equivalence.

A url's host and path pick the longest rule that fits. Pages that no rule
reaches take the decision of their aliases: redirects and canonical links join
urls into classes by distributed connected components; an explicit allow
anywhere in a class wins over any block, a block over the default. Pages are
judged by their own urls; of the ends of links, only those that are no page of
the table bring a rule of their own into a class.

Only DataFrame operations. Rules are broadcast: they are a list kept by hand,
and ``MAX_RULES`` bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, need

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MAX_RULES = 100_000
#: Rows of hosts, classes or decisions (under 400 bytes each) that are broadcast; beyond, they are joined.
MAX_SMALL = 100_000
#: Query parameters that say where a visitor came from, not which page it is.
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref)=[^&#]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """A key of the page that a url names: no scheme, fragment, tracking parameters or last slash."""
    key = F.regexp_replace(url, r"(?s)#.*$", "")
    key = F.regexp_replace(key, r"(?s)^[^:/?#]*://", "")
    key = F.regexp_replace(key, rf"(?<=[?&]){TRACKING}&?", "")
    key = F.regexp_replace(key, r"[?&]+$", "")
    key = F.regexp_replace(key, r"/+$", "")
    host = F.regexp_extract(key, r"(?s)^([^/?]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.translate(host, _UPPER, _LOWER), F.substr(key, F.length(host) + 1)))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule (as ``net/es/``) and its verdict, both null where none fits.

    A host offers its suffixes at dots as keys, so rules are found by an equi-join
    on the host, not by trying each rule on each page; the longest rule wins, by
    host first and then by path, and a block wins over an allow of the same text.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = pages.sparkSession
    by_host: dict[str, list] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host.translate(str.maketrans(_UPPER, _LOWER)), []).append((len(host), len(path), verdict, host + path, path))
    table = spark.createDataFrame([(h, [tuple(r) for r in rs]) for h, rs in by_host.items()], "__key string, __rules array<struct<h:int,p:int,verdict:string,rule:string,path:string>>")
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    parts = F.split("host", r"\.", -1)
    keyed = pages.select("host").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    # a row for each host that has a rule; a host has no more suffixes than labels
    found = _small(cut(keyed.select("host", F.explode(suffixes).alias("__key")).join(F.broadcast(table), "__key").groupBy("host").agg(F.flatten(F.collect_list("__rules")).alias("__rules"))))
    fits = F.filter("__rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["h"] + r["p"], r["h"], r["verdict"], r["rule"])))
    return pages.join(found, "host", "left").withColumn("__best", best).withColumn("rule", F.col("__best.rule")).withColumn("__verdict", F.col("__best.verdict")).drop("__best", "__rules")


def _small(df: DataFrame) -> DataFrame:
    """``df``, a frame from ``cut``, broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= MAX_SMALL else df


def _let(value: Column, then) -> Column:
    """``then`` of a value that is made once: a plain column would be written out at each of its uses."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def resolve(to: Column, base: Column) -> Column:
    """The url that ``to`` names on a page of url ``base``; null for other schemes, fragments and empty links."""

    def clean(joined: Column) -> Column:
        """Without . and .. between the slashes of the path."""
        walk = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
        none = F.array().cast("array<string>")
        end = lambda parts: F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
        path = _let(F.split(F.regexp_extract(joined, r"(?s)^/([^?#]*)", 1), "/", -1), lambda parts: F.array_join(F.concat(F.aggregate(parts, none, walk), end(parts)), "/"))
        return F.concat(F.lit("/"), path, F.regexp_extract(joined, r"(?s)^[^?#]*(.*)$", 1))

    def found(link: Column) -> Column:
        to, base = link["to"], link["base"]
        scheme = F.regexp_extract(base, r"(?s)^([^:/?#]*)://", 1)
        site = F.regexp_extract(base, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
        path = F.regexp_extract(base, r"(?s)^[^:/?#]*://[^/?#]*([^?#]*)", 1)
        joined = F.when(F.startswith(to, F.lit("/")), to).otherwise(F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/?(.*/)?", 1), to))
        return (
            F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
            .when((F.instr(base, "://") == 0) | (to == "") | F.startswith(to, F.lit("#")) | to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
            .when(F.startswith(to, F.lit("?")), F.concat(site, path, to))
            .otherwise(F.concat(site, _let(joined, clean)))
        )

    return _let(F.named_struct(F.lit("to"), F.regexp_replace(F.trim(to), "&amp;", "&"), F.lit("base"), base), found)


def link_edges(pages: DataFrame, key: str = "__key") -> DataFrame:
    """(a, b, url): a page's key, and the key and the url of what it names as canonical or redirects to.

    Relative links count from the page's url, or from its base tag.
    """
    html = F.col("html")
    tag = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta|base)\b[^>]*+>)"), 1)
    tags = pages.where(F.lower(html).contains("canonical") | F.lower(html).contains("refresh") | F.lower(html).contains("og:url")).select(F.col(key).alias("a"), "url", tag.alias("tags"))
    href = lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    is_base = lambda t: t.rlike(r"(?is)^<base\b")
    base = F.transform(F.filter("tags", is_base), lambda t: resolve(href(t), F.col("url")))
    tags = cut(tags.select("a", F.coalesce(F.get(base, F.lit(0)), "url").alias("base"), F.explode(F.filter("tags", lambda t: ~is_base(t))).alias("tag")))
    content = F.regexp_extract("tag", r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1)
    to = (
        F.when(F.col("tag").rlike(r"""(?is)\brel\s*=\s*["']?canonical\b"""), href(F.col("tag")))
        .when(F.col("tag").rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract(content, r"(?is)url\s*=\s*(\S+)", 1))
        .when(F.col("tag").rlike(r"""(?is)\bproperty\s*=\s*["']?og:url\b"""), content)
    )
    named = cut(tags.select("a", resolve(to, F.col("base")).alias("url")).where("url is not null"))
    return named.select("a", canonical(F.col("url")).alias("b"), "url").where("a is not null and b is not null and b != '' and a != b").distinct()


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, source of every row of ``pages(page_id, url, html)``.

    ``redirects(src, dst)`` are further redirects, as urls. Null or malformed urls
    have an empty host and path, no alias and the default verdict. Repeated rows
    each get theirs; an empty table gives an empty result; other columns are dropped.
    ``source`` says what decided: rule, alias or default.
    """
    pages = pages.select(*need(pages, "page_id", "url", "html"))
    ruled = with_rule(pages, rules).withColumn("__key", canonical(F.col("url")))
    named = cut(link_edges(pages.withColumn("__key", canonical(F.col("url")))))
    ends = named.select(F.col("b").alias("node"), "url")
    edges = named.select("a", "b")
    if redirects is not None:
        more = redirects.where("src is not null and dst is not null").select(canonical(F.col("src")).alias("a"), canonical(F.col("dst")).alias("b"), "src", "dst")
        edges = edges.union(more.select("a", "b"))
        ends = ends.union(more.select("a", "src")).union(more.select("b", "dst"))
    edges, ends = cut(edges), cut(ends.where("node is not null").distinct())
    classes = cut(components(edges))
    # an alias that is no page of the table still brings its rule into the class
    own = ruled.select(F.col("__key").alias("node"))
    outside = with_rule(ends.join(own, "node", "left_anti"), rules).select("node", "__verdict")
    said = ruled.select(F.col("__key").alias("node"), "__verdict").union(outside).where("__verdict is not null and node is not null")
    # one row a node first: allow sorts before block, so the minimum is allow wherever one page or rule allows
    said = said.groupBy("node").agg(F.min("__verdict").alias("__verdict"))
    keyed = said.join(_small(classes), "node", "left").select(F.coalesce("component", "node").alias("__class"), "__verdict")
    decided = cut(keyed.groupBy("__class").agg(F.min("__verdict").alias("__by_class")))
    # rows without a key or with a rule of their own ask nobody: their keys are spread, and meet nothing
    asks = F.when(F.col("rule").isNull(), F.col("__key"))
    out = ruled.drop("html").withColumn("__ask", F.coalesce(asks, F.concat(F.lit("\0"), F.xxhash64("page_id", "url").cast("string"))))
    out = out.join(_small(classes).withColumnRenamed("node", "__ask"), "__ask", "left").withColumn("__class", F.coalesce("component", "__ask"))
    out = out.join(_small(decided), "__class", "left")
    source = F.when(F.col("rule").isNotNull(), "rule").when(F.col("__by_class").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("__verdict", "__by_class", F.lit(default)).alias("verdict"), source.alias("source"))


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with made-up redirects, as theirs hold none: every page to the first of its four neighbours by page_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    first = pages.select(F.col("page_id").alias("first"), F.col("url").alias("dst"))
    redirects = pages.select((F.col("page_id") - F.col("page_id") % 4).alias("first"), F.col("url").alias("src")).join(first, "first").select("src", "dst")
    return filter_urls(pages, redirects=redirects)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages)


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), hp AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM p
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM hp LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS source FROM best
"""

ALIAS_SQL = (
    ORACLE_SQL[: ORACLE_SQL.rindex("SELECT page_id, host, path, rule")].replace("WITH p AS", "WITH RECURSIVE p AS")
    + r"""
, k1 AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^[^:/?#]*://', '', 's'),
    '([?&])((utm_[a-z]+|gclid|fbclid|ref)=[^&#]*(&|$))+', '', 'g') AS k FROM pages WHERE instr(url, '://') > 0
), keyed AS (
  SELECT page_id, page_id - page_id % 4 AS g, regexp_replace(regexp_replace(k, '[?&]+$', ''), '/+$', '') AS k FROM k1
), met AS (
  SELECT DISTINCT a.g AS g, b.g AS h FROM keyed a JOIN keyed b ON lower(a.k) = lower(b.k)
), reach(g, h) AS (
  SELECT g, h FROM met UNION SELECT r.g, m.h FROM reach r JOIN met m ON r.h = m.g
), class AS (
  SELECT g, min(h) AS c FROM reach GROUP BY g
), said AS (
  SELECT c, min(verdict) AS by_class FROM best JOIN keyed USING (page_id) JOIN class USING (g) WHERE verdict IS NOT NULL GROUP BY c
)
SELECT best.page_id, host, path, rule, coalesce(verdict, by_class, 'allow') AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN by_class IS NOT NULL THEN 'alias' ELSE 'default' END AS source
FROM best LEFT JOIN keyed USING (page_id) LEFT JOIN class USING (g) LEFT JOIN said USING (c)
"""
)
