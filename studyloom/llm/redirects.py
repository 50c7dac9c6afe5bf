"""URL verdicts by host and path rules, spread over redirect and canonical-link aliases.

A page names an alias by ``<link rel="canonical" href=...>`` or by a refresh redirect in its HTML. Pages and their aliases form
equivalence classes (distributed connected components). A url that a rule fits gets the rule's verdict. Any other page is
blocked when a url of its class is blocked, unless a url of the class is explicitly allowed: an explicit allow goes first.

DataFrame operations only. Only pages that name an alias, and pages that they name, take part in joins.
"""
from pyspark.sql import functions as F

from studyloom.llm.components import components
from studyloom.llm.tables import Scratch

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for NULL."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host, path, rules=RULES):
    """(rule, verdict) columns: of the rules that fit, the one with the longest host, then path; NULL if none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    rule = verdict = None
    for h, p, v in ranked:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def key_of(url):
    """Name of a url's place: host, path and query, without scheme and fragment; NULL without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def _without_dots(path):
    """A path with its ``.`` and ``..`` segments carried out."""
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, x: (
        F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))))
    ends = F.when(path.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(parts, "/"), ends)).otherwise(path)


def resolve(url, target):
    """A link's target as an absolute url, as seen from the page ``url``; NULL for other schemes, the page itself, or a page without a host."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)))
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    return (F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|#|$)"), None)
            .when(target.startswith("//"), F.when(site.isNotNull(), F.concat(scheme, F.lit(":"), target)))
            .when(target.startswith("/"), F.concat(site, _without_dots(path), rest))
            .when(target.startswith("?"), F.concat(site, path_of(url), target))
            .otherwise(F.concat(site, _without_dots(F.concat(folder, path)), rest)))


def aliases(url, html):
    """Array of the absolute urls that a page names as itself: canonical links and refresh redirects."""
    tag = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\b[^>]*>)"), 1)
    attr = lambda t, a: F.regexp_extract(t, rf"""(?is)\b{a}\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    rel = lambda t: F.regexp_extract(t, r"""(?is)\brel\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    links = F.transform(F.filter(tag("link"), lambda t: F.array_contains(F.split(F.lower(rel(t)), r"""[\s"']+"""), "canonical")), lambda t: attr(t, "href"))
    moved = F.transform(F.filter(tag("meta"), lambda t: F.lower(attr(t, "http-equiv")) == "refresh"),
                        lambda t: F.regexp_extract(t, r"""(?is)url\s*=\s*["']?\s*([^"'\s>]+)""", 1))
    found = F.array_compact(F.transform(F.concat(links, moved), lambda u: resolve(url, u)))
    return F.when(F.lower(html).rlike("canonical|refresh"), found)


def judge(spark, pages, id_col="page_id", url_col="url", html_col="html", rules=RULES):
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    NULL urls and urls without ``://`` have an empty host and path; such a page is judged by its aliases alone. Pages of one
    place (same host, path and query) are one node. Without a rule and without a blocked alias the verdict is allow. Repeated
    rows are returned each; an empty table gives an empty result.
    """
    tables = Scratch(spark)
    url = F.col(url_col)
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    base = (pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.col(html_col).alias("html"))
            .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(key_of(F.col("url")), F.concat(F.lit("#"), F.col("page_id").cast("string"))).alias("place"),
                    aliases(F.col("url"), F.col("html")).alias("also"))
            .select("*", rule.alias("rule"), verdict.alias("own")))
    base = tables.keep(base.select("page_id", "host", "path", "place", "rule", "own", F.when(F.size("also") > 0, F.col("also")).alias("also")))
    edges = base.where("also is not null").select("place", F.explode("also").alias("other")).select("place", "other", key_of(F.col("other")).alias("to"))
    rule2, verdict2 = decide(host_of(F.col("other")), path_of(F.col("other")), rules)
    classes = components(tables, edges, "place", "to")
    # verdicts of the urls in the classes: of pages, and of urls that only links name
    said = (base.where("own is not null").select("place", "own").unionByName(edges.select(F.col("to").alias("place"), verdict2.alias("own")).where("own is not null"))
            .groupBy("place").agg(F.min("own").alias("lo"), F.max("own").alias("hi")))
    of_class = (classes.join(said, classes.node == said.place).groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .select("component", F.when(F.col("lo") == "allow", "allow").when(F.col("hi") == "block", "block").alias("class_verdict")))
    known = tables.keep(classes.join(of_class, "component").select(F.col("node").alias("place"), "class_verdict"))
    free = base.where("rule is null")
    judged = free.join(known, "place", "left").select("page_id", "host", "path", "rule", F.coalesce("class_verdict", F.lit("allow")).alias("verdict"))
    return base.where("rule is not null").select("page_id", "host", "path", "rule", F.col("own").alias("verdict")).unionByName(judged)
