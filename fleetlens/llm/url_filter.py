"""URL filter with redirect equivalence (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import connected_components
from fleetlens.llm.frames import ascii_lower, without
from fleetlens.session import scratch_path, stored

# fixed values: the rules of the contract (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Query parameters that name the way to a page, not the page.
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)(?:=[^&]*)?"
LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def page_of(url: Column) -> Column:
    """The page that a url names: scheme, fragment, closing slashes and tracking parameters go; null without a host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(?<![^&]){TRACKING}(?:&|$)", "")
    query = F.regexp_replace(query, "&+$", "")
    page = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host_of(url) != "", page)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host`` + ``path``) and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):  # a longer rule is asked before
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments of a path resolved."""
    none = F.array().cast("array<string>")
    parts = F.aggregate(F.split(path, "/", -1), none, lambda a, x: F.when(x == ".", a).when(
        x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(x))))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(parts, "/")).otherwise(path)


def resolved(href: Column, base: Column) -> Column:
    """The url that ``href`` names on the page ``base``; null where it names no other page (fragments, mailto: and the like)."""
    path, tail = F.regexp_replace(href, r"(?s)[?#].*$", ""), F.regexp_extract(href, r"(?s)[?#].*$", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    at = lambda p: F.concat(F.lit("http://"), host_of(base), without_dots(p), tail)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("#") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(href.startswith("?"), at(path_of(base)))
        .when(href.startswith("/"), at(path))
        .otherwise(at(F.concat(folder, path)))
    )


def links_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src url, dst url): all canonical links and refresh redirects of the pages, resolved against their page."""
    found = F.concat(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), F.regexp_extract_all(html, F.lit(REFRESH), F.lit(1)))
    marked = F.col(html).rlike(r"(?i)canonical|refresh")
    links = pages.where(marked & F.col(url).contains("://")).select(F.col(url).alias("src"), F.explode(found).alias("href")).where("href <> ''")
    return links.select("src", resolved(F.col("href"), F.col("src")).alias("dst")).where("dst is not null")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    Urls that name one page (``page_of``) are one node; canonical links and
    refresh redirects in ``html`` and further ``edges`` (src, dst urls) tie nodes
    together, components of any size and shape. A url with a rule gets the rule's
    verdict. A url without one follows its component: allow if any url there is
    allowed by a rule (explicit allow goes first), else block if any is blocked,
    else allow. Urls that occur as link targets only count with their rules too.
    ``rules`` is a short list: it becomes one expression.

    A null url, or one without ``://``, has an empty host and path, no rule, no
    aliases and is allowed. Repeated rows get the same verdict each. Columns
    named like the new ones are replaced; an empty table gives an empty result.
    """
    pages = without(pages, "host", "path", "rule", "verdict")
    spark = pages.sparkSession
    links = links_of(pages, url, html)
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst"))
    links = stored(links.select(page_of(F.col("src")).alias("src"), page_of(F.col("dst")).alias("dst"), host_of(F.col("dst")).alias("host"), path_of(F.col("dst")).alias("path")), scratch_path(spark, "links"))
    component = connected_components(links)

    keep = [F.col(f"`{c}`") for c in pages.columns]
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "__page": page_of(F.col(url))}).withColumns({"rule": rule, "__own": verdict})
    said = judged.select("__page", "__own").unionByName(links.select(F.col("dst").alias("__page"), verdict.alias("__own")))
    said = said.where("__page is not null and __own is not null").groupBy("__page").agg(F.min("__own").alias("__own"))  # allow < block
    node = F.coalesce("component", "__page")
    said = said.join(component, F.col("__page") == F.col("node"), "left").groupBy(node.alias("__of")).agg(F.min("__own").alias("__said"))

    # every page that a rule's verdict reaches by an alias
    told = component.join(said, F.col("component") == F.col("__of")).select(F.col("node").alias("__page"), "__said")
    lone = said.join(component, F.col("__of") == F.col("node"), "left_anti").select(F.col("__of").alias("__page"), "__said")
    out = judged.join(told.unionByName(lone), "__page", "left")
    return out.select(*keep, "host", "path", "rule", F.coalesce("__own", "__said", F.lit("allow")).alias("verdict"))
