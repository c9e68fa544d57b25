"""URL rules with redirect equivalence, in DataFrame functions only.

A rule is a host and a path; it fits the host and all its subdomains if the url's path starts with the rule's.  The longest
fitting rule decides a url.  Pages without a rule take the decision of their aliases: pages and targets are nodes, named by host, path and
query; all redirects (meta refresh) and canonical links of a page are edges; in a component an allowed member makes the undecided ones
allowed, else a blocked member makes them blocked, else they are allowed.  A url's own rule is never overruled.

Defined results: a null url, or one without ://, has empty host and path, fits no rule, has no aliases and is allowed;
null html has no edges; repeated rows are each judged; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.components import components
from skeinwork.llm.runtime import settle

# The rules of the query.
RULES: tuple[tuple[str, str], ...] = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The name of a url as an alias: host, path (/ if empty) and query; null without a host."""
    path, query = path_of(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict); null without one.  Of equally long ones allow wins, then the smaller text."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == "allow", [-ord(c) for c in r[0]])):
        name, _, rest = rule.partition("/")
        fits = ((host == name.lower()) | host.endswith("." + name.lower())) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


# Character references by name; the ampersand is dealt with last.
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def decoded(c: Column) -> Column:
    """c without character references: the named ones above and numbers below 256; an ampersand that one gives begins no other."""
    for name, value in _NAMED.items():
        c = F.replace(c, F.lit(name), F.lit(value))

    def one(part: Column, at: Column) -> Column:
        ten, hex_ = F.regexp_extract(part, r"^0*([0-9]{1,3});", 1), F.regexp_extract(part, r"^[xX]0*([0-9a-fA-F]{1,2});", 1)
        code = F.coalesce(F.nullif(ten, F.lit("")).cast("int"), F.conv(F.nullif(hex_, F.lit("")), 16, 10).cast("int"))
        rest = F.regexp_replace(part, "^[xX]?[0-9a-fA-F]+;", "")
        return F.when(at == 0, part).when(code.between(1, 255), F.concat(F.when(code == 38, "\1").otherwise(F.chr(code)), rest)).otherwise(F.concat(F.lit("&#"), part))

    joined = F.array_join(F.transform(F.split(c, "&#"), one), "")
    return F.translate(F.replace(joined, F.lit("&amp;"), F.lit("\1")), "\1", "&")


def _targets(html: Column, tag: str, mark: str, value: str) -> Column:
    """Attribute values of all such tags."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)(<{tag}\s[^>]*>)")), lambda t: t.rlike(mark))
    return F.transform(tags, lambda t: decoded(F.regexp_extract(t, value, 1)))


def link_targets(html: Column) -> Column:
    """Canonical and redirect targets of a page, as written but for character references."""
    canonical = _targets(html, "link", r"(?is)\srel\s*=\s*[\"']?canonical\b", r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = _targets(html, "meta", r"(?is)\shttp-equiv\s*=\s*[\"']?refresh\b", r"(?is)\scontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*[\"']?([^\"'\s>]+)")
    return F.filter(F.array_distinct(F.concat(canonical, refresh)), lambda t: t != "")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and component (the node that names the alias group, null without aliases)."""
    given = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    found = given.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.lit("")).alias("scheme"), node_of(F.col("url")).alias("node"), "html")
    found = found.withColumn("folder", F.concat("host", F.regexp_extract(F.when(F.col("path") == "", "/").otherwise(F.col("path")), r"(?s)^(.*/)", 1)))
    target = F.explode(link_targets(F.col("html"))).alias("to")
    raw = found.filter("node is not null and html is not null").select("scheme", "host", "folder", "node", target)
    to = F.col("to")
    # A relative target is taken from the page's host, or from the folder of its path.
    full = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat("scheme", F.lit(":"), to))
        .when(to.startswith("/"), F.concat("scheme", F.lit("://"), "host", to))
        .otherwise(F.concat("scheme", F.lit("://"), "folder", to))
    )
    edges = settle(raw.select(F.col("node").alias("a"), node_of(full).alias("b")).filter("b is not null and a <> b").distinct(), "aliases")
    base = found.select("page_id", "host", "path", "node", rule_for(F.col("host"), F.col("path"), rules).alias("own"))
    if edges.isEmpty():
        return base.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    groups = components(edges)
    # The rules also judge targets that are no pages here: a block of either end of a link counts.
    member = groups.select("label", rule_for(F.regexp_extract("node", r"(?s)^([^/]*)", 1), F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1), rules)["verdict"].alias("v"))
    verdicts = member.groupBy("label").agg(F.min("v").alias("group_verdict"))  # "allow" sorts before "block"
    alias = groups.join(verdicts, "label").select("node", F.col("label").alias("component"), "group_verdict")
    return base.join(alias, "node", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "group_verdict", F.lit("allow")).alias("verdict"), "component")
