"""URL filter with decisions carried along redirects and canonical links.

Nodes are URLs without fragment and tracking parameters. Edges come from the pages: a canonical
link (``link rel=canonical``), a meta refresh, and the page's own URL to its bare form. Links are
resolved as a browser does (absolute, rooted, relative, dotted, a query alone; entities decoded). Connected
components (distributed, see ``components``) join the aliases of a page. A page that a rule fits
gets the rule's verdict. Of the others, those in a component where some alias has an explicit
allow are allowed, else those where some alias is blocked are blocked, and all others allowed:
an explicit allow comes before a block at every step.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Rows
that repeat a page_id or url are judged alike; null page_ids are kept. Null html has no links. An
empty table gives an empty result; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneforge.llm.common import written
from tuneforge.llm.components import components
from tuneforge.llm.windows import ascii_lower


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules.
RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """name and verdict of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest last, so that it is tested first
        out = F.when(fits(r, host, path), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def bare(url: Column) -> Column:
    """A URL without fragment, tracking parameters and a lone question mark; scheme and host folded."""
    cut = F.regexp_replace(url, r"(?s)#.*$", "")
    cut = F.regexp_replace(cut, r"([?&])(?:(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*(?:&|$))+", "$1")
    cut = F.regexp_replace(cut, r"[?&]$", "")
    head = F.regexp_extract(cut, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(ascii_lower(head), F.substring(cut, F.char_length(head) + 1, F.char_length(cut)))


LINK = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
#: Entities that stand in links, the ampersand last.
ENTITIES = [("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")]
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
ORIGIN = SCHEME + "//[^/?#]*"


def targets(html: Column) -> Column:
    """URLs that a page names as its canonical form or refreshes to."""
    link = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, TARGET, 1))
    return F.concat(link, refresh)


def decoded(target: Column) -> Column:
    for entity, char in ENTITIES:
        target = F.replace(target, F.lit(entity), F.lit(char))
    return target


def without_dots(links: DataFrame, path: str) -> DataFrame:
    """``links`` with the ``.`` and ``..`` segments of the rooted paths in column ``path`` carried out."""
    parts, last = F.col("__parts"), F.element_at("__parts", -1)
    links = links.withColumn("__parts", F.split(F.substring(path, 2, F.char_length(path)), "/", -1))
    kept = F.aggregate(parts, F.expr("CAST(array() AS array<string>)"), lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    kept = F.concat(kept, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.expr("CAST(array() AS array<string>)")))
    return links.withColumn(path, F.when(F.col(path).contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(F.col(path))).drop("__parts")


def resolved(links: DataFrame) -> DataFrame:
    """``links`` with ``to``, the URL that a link ``target`` names on the page ``url``: absolute, without scheme,
    rooted, relative or a query alone; null for other schemes (mailto:), places in the page itself, and pages
    without an origin. A step at a time: written into each other, the steps would repeat one another's text."""
    target, base, to = F.col("target"), F.col("url"), F.col("to")
    links = links.withColumns({"__scheme": F.regexp_extract(base, f"({SCHEME})//", 1), "__origin": F.regexp_extract(base, f"({ORIGIN})", 1), "__path": F.regexp_extract(base, f"{ORIGIN}([^?#]*)", 1)})
    folder = F.when(F.col("__path").contains("/"), F.regexp_extract("__path", r"(?s)^(.*/)", 1)).otherwise(F.lit("/"))
    links = links.withColumn(
        "to",
        F.when(target.rlike(SCHEME + "//"), target)
        .when(target.rlike(SCHEME) | (F.col("__origin") == "") | (target == "") | target.startswith("#"), F.lit(None))
        .when(target.startswith("//"), F.concat("__scheme", target))
        .when(target.startswith("/"), F.concat("__origin", target))
        .when(target.startswith("?"), F.concat("__origin", "__path", target))
        .otherwise(F.concat("__origin", folder, target)),
    )
    links = links.withColumn("__head", F.regexp_extract(to, f"({ORIGIN})", 1))
    links = links.withColumn("__rest", F.substring(to, F.char_length("__head") + 1, F.char_length(to)))
    links = links.withColumn("__place", F.regexp_extract("__rest", r"^([^?#]*)", 1))
    links = links.withColumn("__rest", F.substring("__rest", F.char_length("__place") + 1, F.char_length("__rest")))
    links = without_dots(links, "__place")
    cleaned = F.when(target.startswith("?"), to).otherwise(F.concat("__head", "__place", "__rest"))
    return links.withColumn("to", cleaned).drop("__scheme", "__origin", "__path", "__head", "__rest", "__place")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's own bare URL and the bare form of each target. One scan of the html."""
    rows = pages.where("url is not null and html is not null").select("url", F.explode(targets(F.col("html"))).alias("target"))
    links = resolved(rows.withColumn("target", decoded(F.col("target"))))
    # A filter on the columns would be pushed below all steps, written into one expression; one inside the row is not.
    link = F.array(F.struct(bare(F.col("url")).alias("a"), bare(F.col("to")).alias("b")))
    return links.select(F.inline(F.filter(link, lambda x: x["b"].isNotNull() & (x["a"] != x["b"])))).distinct()


def judge_pages(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, component and verdict of every page."""
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), bare(url).alias("alias"))
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    edges = written(alias_edges(pages))
    found = written(components(edges))
    ends = edges.select(F.col("a").alias("url")).union(edges.select(F.col("b").alias("url")))
    known = ends.union(pages.where("url is not null").select("url")).distinct()
    named = known.select(bare(F.col("url")).alias("alias"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("v")).where("v is not null")
    named = named.join(found.withColumnRenamed("node", "alias"), "alias", "left").withColumn("component", F.coalesce("component", "alias"))
    spread = named.groupBy("component").agg(F.min(F.when(F.col("v") == "allow", F.lit("allow")).otherwise(F.lit("block"))).alias("carried"))  # allow sorts first
    placed = rows.join(found.withColumnRenamed("node", "alias"), "alias", "left").withColumn("component", F.coalesce("component", "alias"))
    judged = placed.join(spread, "component", "left")
    verdict = F.coalesce(F.col("ruled.verdict"), F.col("carried"), F.lit("allow"))
    return judged.select("page_id", "url", "host", "path", F.col("ruled.name").alias("rule"), "component", verdict.alias("verdict"))
