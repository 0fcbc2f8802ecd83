"""URL filters by redirect equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: action, host, path. The longest rule that fits decides.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: So many rules are compiled into the plan; more meet the urls in a join.
COMPILED_RULES = 1000


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url_, instr(url_, '://') + 3)"))


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path: host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased;
    path what follows it up to `?`, `#` or the end. Both are empty for null urls and those without `://`."""
    rest = F.coalesce(_after_scheme(F.col("url_")), F.lit(""))
    host = F.regexp_extract(F.col("rest_"), r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("url_", F.col(url)).withColumn("rest_", rest).withColumn("host", lowered).withColumn("path", F.regexp_extract(F.col("rest_"), r"^[^/?#]*([^?#]*)", 1)).drop("url_", "rest_")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, action) of the longest rule that fits a host and path, or null. A rule fits its host and
    all subdomains where the path starts with the rule's; of equally long ones the last in text order decides. For short lists: the rules travel inside the plan."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def with_rules(split: DataFrame, rules=RULES) -> DataFrame:
    """Adds fit_, the struct of rule_of, to rows with host and path. rules: a list of (action, host, path), or a table with these columns.

    Long lists are a table: a host's suffixes and its path's prefixes of the lengths that rules have meet the rules in an equi join, once for
    each different host and path, however many rules a host has."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= COMPILED_RULES:
            return split.withColumn("fit_", rule_of(F.col("host"), F.col("path"), rules))
        rules = split.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    table = rules.select(F.col("host").alias("suffix_"), F.col("path").alias("prefix_"), "action").groupBy("suffix_", "prefix_").agg(F.max("action").alias("action"))
    # One row: the different lengths of the rules' paths, at most as many as the longest has characters.
    lengths = table.agg(F.array_sort(F.collect_set(F.length("prefix_"))).alias("lengths_"))
    labels = F.split("host", r"\.")
    places = split.select("host", "path").distinct().withColumn("suffix_", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    places = places.join(F.broadcast(lengths)).withColumn("n_", F.explode(F.filter("lengths_", lambda n: n <= F.length("path")))).withColumn("prefix_", F.expr("left(path, n_)"))
    rule = F.concat("suffix_", "prefix_")
    best = places.join(table, ["suffix_", "prefix_"]).groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "action")).alias("m"))
    return split.join(best, ["host", "path"], "left").withColumn("fit_", F.when(F.col("m").isNotNull(), F.struct("m.rule", "m.action"))).drop("m")


def canonical_form(url: Column) -> Column:
    """The address a site serves a page's variants under: no fragment, no query parameters that only track or
    page, no `www.` or `m.`, no trailing slash or `.html`, scheme https."""
    x = F.regexp_replace(url, r"#.*$", "")
    x = F.regexp_replace(x, r"(?<=[?&])(?:utm_\w+|ref|fbclid|gclid)=[^&]*&?", "")
    x = F.regexp_replace(x, r"[?&]+$", "")
    x = F.regexp_replace(x, r"^https?://(?:www\.|m\.)?", "https://")
    return F.regexp_replace(x, r"(?:\.html|/)$", "")


def resolve(base: Column, target: Column) -> Column:
    """The absolute address of a link target on a page (RFC 3986, 5.2); null for an empty target or one that leads only to a fragment."""
    scheme = F.regexp_extract(base, r"^[^:/?#]*:", 0)
    origin = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*", 0)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(page, r"^.*/", 0))
    joined = F.when(target.startswith("/"), F.concat(origin, target)).when(target.startswith("?"), F.concat(page, target)).otherwise(F.concat(folder, target))
    path = F.regexp_replace(F.regexp_extract(joined, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1), r"/\.(?=/|$)", "")
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, p: F.when(p != "..", F.array_append(acc, p)).when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
    slash = F.when(path.endswith("/.."), "/").otherwise("")
    short = F.concat(origin, F.array_join(parts, "/"), slash, F.regexp_extract(joined, r"^[^?#]*(.*)$", 1))
    relative = F.when(F.regexp_like(joined, F.lit(r"/\.\.?(?:[/?#]|$)")), short).otherwise(joined)
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(origin != "", relative)
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between a page's url and what it stands for: its canonical link elements, its refresh
    redirects and its canonical form. Null urls have none; relative targets are resolved against the page's address."""
    head = F.coalesce(F.col(html), F.lit(""))
    value = lambda e, name: F.regexp_extract(e, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    bare = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"(?is)^\s*[\w-]+\s*=\s*", ""), r"""^["']|["']$""", ""))
    elements = lambda tag: F.regexp_extract_all(head, F.lit(rf"""(?is)(<{tag}\s(?:[^>"']|"[^"]*"|'[^']*')*+>)"""))
    links = F.filter(elements("link"), lambda e: F.lower(bare(value(e, "rel"))).rlike(r"(?:^|\s)canonical(?:\s|$)"))
    metas = F.filter(elements("meta"), lambda e: F.lower(bare(value(e, "http-equiv"))) == "refresh")
    after = lambda e: F.regexp_extract(bare(value(e, "content")), r"""(?i)\burl\s*=\s*["']?([^"'>\s]+)""", 1)
    named = F.concat(F.transform(links, lambda e: bare(value(e, "href"))), F.transform(metas, after))
    named = F.transform(named, lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))
    marked = F.when(F.instr(F.lower(head), "canonical") + F.instr(F.lower(head), "http-equiv") > 0, F.transform(named, lambda t: resolve(F.col(url), t))).otherwise(F.array().cast("array<string>"))
    targets = F.array_compact(F.array_append(marked, canonical_form(F.col(url))))
    return pages.where(F.col(url).isNotNull()).select(F.col(url).alias("a"), F.explode(targets).alias("b")).where("a <> b").distinct()


def filter_urls(urls: DataFrame, links: DataFrame, url: str = "url", rules=RULES, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of urls. rules: a list of (action, host, path), or a table with these columns.

    A url that a rule fits gets the longest rule's action. Any other url takes the decision of its redirect
    equivalence class, the connected component of `links` (a, b): if some address of the class is blocked by
    a rule and none is explicitly allowed, it is blocked, else allowed; explicit allows take precedence. A url
    outside all links gets `default`. Null urls have an empty host and path, no rule and the default verdict.
    Repeated rows are all judged, extra columns of any name are kept (only columns named host, path, rule or verdict are
    replaced), an empty table stays empty. A hot host or canonical target is only ever grouped by minima and
    flags, never collected."""
    edges = materialize(links.select("a", "b"), "links")
    member = connected_components(edges)
    judged = with_rules(split_url(member, "node"), rules).withColumn("action_", F.col("fit_.action"))
    classes = judged.groupBy("component").agg(F.max(F.col("action_") == "block").alias("blocks_"), F.max(F.col("action_") == "allow").alias("allows_"))
    # Written, so that Spark can split the join below where a class is hot.
    blocked = materialize(classes.where(F.coalesce("blocks_", F.lit(False)) & ~F.coalesce("allows_", F.lit(False))).select("component"), "blocked")
    hit = judged.join(blocked, "component").select(F.col("node").alias("node_"), F.lit("block").alias("passed_"))
    rows = urls.drop("host", "path", "rule", "verdict").select(F.struct("*").alias("row_"))
    base = with_rules(split_url(rows.withColumn("own_", F.col(f"row_.{url}")), "own_"), rules)
    out = base.join(hit, F.col("own_") == F.col("node_"), "left")
    return out.select("row_.*", "host", "path", F.col("fit_.rule").alias("rule"), F.coalesce(F.col("fit_.action"), F.col("passed_"), F.lit(default)).alias("verdict"))
