"""URL filters with redirect equivalence, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, few
from .components import connected_components

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Up to so many rules are literals of the plan; more are a table that is joined.
MOST_RULES = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_META = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
# The character references that URLs in attributes hold, the ampersand's own last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&#47;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")]
_DOTS = r"(^|/)\.\.?(/|$)"
_GOTO = r"(?i)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*['\"]?([^\"'\s>]+)"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    return F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise(F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null.

    A rule fits its host and all subdomains, if the path starts with the rule's path. Of
    rules of equal length the first of the list wins. The rules are literals of the plan.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for _, (verdict, at, start) in sorted(enumerate(rules), key=lambda r: (len(r[1][1] + r[1][2]), -r[0])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(at + start).alias("rule"))).otherwise(out)
    return out


def rule_hits(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, hit) of the `places` that a rule of the table (verdict, host, path, place) fits; hit as `match_rule` gives it, the least `place` first.

    Each host's suffixes are joined with the hosts that rules name, which brings the lengths of
    their paths; the path's beginnings of these lengths are joined with the rules. Both
    tables have one row a key, and places are distinct, so neither a long list nor a
    frequent host multiplies rows by more than the different lengths of one host's rules.
    """
    once = rules.groupBy(F.col("host").alias("at"), F.col("path").alias("start")).agg(F.min(F.struct("place", "verdict")).alias("first"))
    lengths = once.groupBy("at").agg(F.collect_set(F.length("start")).alias("lengths"))
    labels = F.split("host", "[.]")
    parts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cut = places.select("host", "path").distinct().withColumn("at", F.explode(parts)).join(lengths, "at")
    cut = cut.withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path"))
    cut = cut.withColumn("start", F.substring("path", F.lit(1), F.col("n"))).join(once, ["at", "start"])
    best = F.max_by(F.struct(F.col("first.verdict").alias("verdict"), F.concat("at", "start").alias("rule")), F.struct(F.length("at") + F.col("n"), -F.col("first.place")))
    return cut.groupBy("host", "path").agg(best.alias("hit"))


def with_hits(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """`rows` (host, path, ...) with the column hit."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= MOST_RULES:
            return rows.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
        rules = rows.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(rules)], "verdict string, host string, path string, place long")
    return rows.join(rule_hits(rows, rules), ["host", "path"], "left")


def _decoded(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _folded(path: Column) -> Column:
    """A path that begins with `/`, without its segments `.` and `..`."""
    parts = F.split(F.substring(path, F.lit(2), F.lit(2147483647)), "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    done = F.aggregate(parts, F.lit(None).cast("array<string>"), lambda d, x: step(F.coalesce(d, F.array().cast("array<string>")), x))
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(_DOTS), F.concat(F.lit("/"), F.array_join(F.concat(done, tail), "/"))).otherwise(path)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target) of canonical links and refresh redirects.

    Targets are resolved against the page's own url: absolute ones, and those relative to the scheme,
    the host, the page's folder or its query; `.` and `..` are folded and character
    references decoded. Targets of other schemes (mailto:) and mere fragments are no links.
    """
    found = pages.where(F.col(html).isNotNull() & F.col(url).isNotNull()).select(
        F.col(url).alias("url"),
        F.concat(
            F.transform(F.regexp_extract_all(html, F.lit(_LINK), 0), lambda x: F.regexp_extract(x, _HREF, 1)),
            F.transform(F.regexp_extract_all(html, F.lit(_META), 0), lambda x: F.regexp_extract(x, _GOTO, 1)),
        ).alias("targets"),
    )
    found = found.select("url", F.explode(F.array_distinct("targets")).alias("to"))
    # Links are few and short: stored, their long expressions are reckoned once and not copied into one another.
    found = checkpoint(found.select("url", _decoded(F.col("to")).alias("to")))
    base = F.regexp_extract("url", r"^([^:/?#]+://[^/?#]*)", 1)
    scheme = F.regexp_extract("url", r"^([^:/?#]+:)//", 1)
    path, to = url_path(F.col("url")), F.col("to")
    whole = (
        F.when(F.locate("://", to) > 0, to)
        .when((to == "") | F.startswith(to, F.lit("#")) | to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, to))
        .when(base == "", F.lit(None))
        .when(F.startswith(to, F.lit("/")), F.concat(base, to))
        .when(F.startswith(to, F.lit("?")), F.concat(base, path, to))
        .otherwise(F.concat(base, F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", "")), to))
    )
    found = checkpoint(found.select("url", whole.alias("whole")).where("whole is not null"))
    start, rest = F.regexp_extract("whole", r"^([^:/?#]+://[^/?#]*)", 1), F.regexp_extract("whole", r"(?s)^[^:/?#]+://[^/?#]*[^?#]*(.*)$", 1)
    target = F.when(start == "", F.col("whole")).otherwise(F.concat(start, _folded(url_path(F.col("whole"))), rest))
    return found.select("url", target.alias("target")).where("target is not null and target <> url")


def alias_key(url: Column) -> Column:
    """The same address without its fragment, its host in lower case; null without `://`."""
    bare = F.substring_index(url, "#", 1)
    at = F.locate("://", bare)
    key = F.concat(F.translate(F.substring(bare, F.lit(1), at + 2), UPPER, LOWER), url_host(bare), F.substring(_after(bare), F.length(url_host(bare)) + 1, F.lit(2147483647)))
    return F.when(at > 0, key)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A page takes the verdict of the longest rule that fits its url. Else its class decides: the
    addresses that redirects (`meta refresh`) and canonical links join, whether pages of
    their own or not. If a rule allows any address of the class, it is allowed; else, if
    a rule blocks one, blocked; else `default`. Rules are a list of (verdict, host, path) or, for long lists, a
    table that also has `place`; of equally long ones the first wins. Null urls and urls without `://` have an
    empty host and path, no rule and no aliases. Repeated rows are judged alike, each for
    itself. Other columns are not read. No rows: no rows.

    An alias is named by its address; an address's vote is joined back by the class's least one.
    """
    links = page_links(pages).select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b"))
    links = checkpoint(links.where("a is not null and b is not null and a <> b").distinct())
    aliases = connected_components(links, "a", "b")
    aliases = with_hits(aliases.select("node", "root", url_host(F.col("node")).alias("host"), url_path(F.col("node")).alias("path")), rules)
    aliases = checkpoint(aliases.select("node", "root", F.col("hit.verdict").alias("own")))
    votes = aliases.groupBy("root").agg(
        F.max(F.when(F.col("own") == "allow", 2).when(F.col("own") == "block", 1)).alias("vote")
    )
    spread = aliases.join(few(checkpoint(votes)), "root").select("node", F.when(F.col("vote") == 2, "allow").when(F.col("vote") == 1, "block").alias("spread"))
    judged = pages.select("page_id", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"), alias_key(F.col("url")).alias("node"))
    return with_hits(judged, rules).join(spread, "node", "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "spread", F.lit(default)).alias("verdict")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages` under the rules of RULES."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replaced(x: str) -> str:
    for name, sign in ENTITIES:
        x = f"replace({x}, {_quoted(name)}, {_quoted(sign)})"
    return x


OP10_SQL = rf"""
with recursive rules(verdict, rhost, rpath, place) as (values {", ".join(f"({_quoted(v)}, {_quoted(h)}, {_quoted(p)}, {k})" for k, (v, h, p) in enumerate(RULES))}),
found as (
    select url, unnest(list_distinct(list_concat(
        list_transform(regexp_extract_all(html, {_quoted(_LINK)}), lambda x: regexp_extract(x, {_quoted(_HREF)}, 1)),
        list_transform(regexp_extract_all(html, {_quoted(_META)}), lambda x: regexp_extract(x, {_quoted(_GOTO)}, 1))))) as link
    from pages where url is not null and html is not null),
decoded as (select url, {_replaced("link")} as link, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) as base,
        case when contains(url, '://') then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from found),
whole as (
    select url, case when contains(link, '://') then link
        when link = '' or starts_with(link, '#') or regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
        when starts_with(link, '//') then regexp_extract(url, '^([^:/?#]+:)//', 1) || link
        when base = '' then null
        when starts_with(link, '/') then base || link
        when starts_with(link, '?') then base || path || link
        else base || case when path = '' then '/' else regexp_replace(path, '[^/]*$', '') end || link end as whole
    from decoded),
cuts as (
    select url, whole, regexp_extract(whole, '^([^:/?#]+://[^/?#]*)', 1) as start, regexp_extract(whole, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) as path,
        regexp_extract(whole, '^[^:/?#]+://[^/?#]*[^?#]*([\s\S]*)$', 1) as rest
    from whole where whole is not null),
segments as (select *, list_transform(string_split(substr(path, 2), '/'), lambda x: [x]) as parts from cuts),
linked as (
    select url, case when start = '' then whole when not regexp_matches(path, {_quoted(_DOTS)}) then start || path || rest
        else start || '/' || array_to_string(list_concat(
            list_reduce(list_concat([[]::varchar[]], parts), lambda d, x: case x[1] when '.' then d when '..' then d[1:len(d) - 1] else list_concat(d, x) end),
            case when parts[-1][1] in ('.', '..') then [''] else []::varchar[] end), '/') || rest end as target
    from segments),
addresses as (select url from pages union select url from linked union select target from linked),
cut as (
    select url, substr(split_part(url, '#', 1), 1, instr(split_part(url, '#', 1), '://') + 2) as scheme,
        case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as after,
        case when contains(split_part(url, '#', 1), '://') then substr(split_part(url, '#', 1), instr(split_part(url, '#', 1), '://') + 3) end as bare
    from addresses where url is not null),
known as (
    select url, translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
        regexp_extract(after, '^[^/?#]*([^?#]*)', 1) as path,
        translate(scheme || regexp_extract(bare, '^[^/?#]*'), '{UPPER}', '{LOWER}') || substr(bare, length(regexp_extract(bare, '^[^/?#]*')) + 1) as node
    from cut),
ruled as (
    select url, arg_max(verdict, length(rhost || rpath) * 10 - place) as verdict, arg_max(rhost || rpath, length(rhost || rpath) * 10 - place) as rule
    from known, rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by url),
edges as (
    select distinct a.node as a, b.node as b from linked l join known a on a.url = l.url join known b on b.url = l.target where a.node <> b.node),
pairs as (select a, b from edges union select b, a from edges),
reach(node, other) as (select a, a from pairs union select r.node, p.b from reach r join pairs p on p.a = r.other),
spread as (
    select reach.node, case when bool_or(verdict = 'allow') then 'allow' when bool_or(verdict = 'block') then 'block' end as verdict
    from reach join known on known.node = other join ruled using (url) group by reach.node)
select page_id, coalesce(k.host, '') as host, coalesce(k.path, '') as path, r.rule, coalesce(r.verdict, s.verdict, 'allow') as verdict
from pages p left join known k on k.url = p.url left join ruled r on r.url = p.url left join spread s on s.node = k.node
"""
