"""Address policies: rule lists as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.functions import urls as u


def policy(
    url: Column, allow: Sequence[str] = (), deny: Sequence[str] = (), block_ip: bool = False
) -> Column:
    """Is the address allowed?  Pattern lists, tested in the usual order: browser pages, inline data,
    no host, IP addresses, the allow list alone if there is one, else the deny list.
    """
    verdict = (
        F.when(url.isin("about:blank", "chrome://new-tab-page/", "chrome://new-tab-page", "chrome://newtab/"), True)
        .when(u.scheme(url).isin("data", "blob"), True)
        .when(u.host(url) == "", False)
    )
    if block_ip:
        verdict = verdict.when(u.is_ip(u.host(url)), False)
    if allow:
        return verdict.otherwise(u.rules_match(url, list(allow)))
    return verdict.otherwise(~u.rules_match(url, list(deny))) if deny else verdict.otherwise(True)


def policy_by_sets(urls: DataFrame, hosts: DataFrame, allowing: bool, url: str = "url") -> DataFrame:
    """Adds ``allowed`` for host sets of any size: the host or its www form is in ``hosts`` (``host``).

    The two forms are one exploded hash join on distinct hosts, not a scan of the set per address.
    """
    special = F.col(url).isin("about:blank", "chrome://new-tab-page/", "chrome://new-tab-page", "chrome://newtab/")
    inline = u.scheme(F.col(url)).isin("data", "blob")
    sites = urls.select(u.host(F.col(url)).alias("__host")).distinct().where("__host <> ''")
    known = hosts.select(F.lower("host").alias("__form")).distinct()
    hit = sites.select("__host", F.explode(u.www_variants(F.col("__host"))).alias("__form")).join(known, "__form").select(
        "__host"
    ).distinct().withColumn("__hit", F.lit(True))
    joined = urls.withColumn("__host", u.host(F.col(url))).join(hit, "__host", "left")
    inside = F.coalesce("__hit", F.lit(False))
    return joined.withColumn(
        "allowed",
        F.when(special | inline, True).when(F.col("__host") == "", False).otherwise(inside if allowing else ~inside),
    ).drop("__host", "__hit")


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def apply_rules(urls: DataFrame, rules: Sequence[str], url: str = "url") -> DataFrame:
    """Adds ``matched``: any rule covers the address.

    Exact hosts and ``*.domain`` rules, of which there may be many, are hash joins on the distinct
    hosts and their parent domains.  The rest (schemes, paths, other globs) compiles into one regex.
    """
    exact = [r.lower() for r in rules if "*" not in r and "://" not in r]
    exact += ["www." + r for r in exact if r.count(".") == 1]
    below = [r[2:] for r in rules if r.startswith("*.")]
    others = [r for r in rules if not (r.startswith("*.") or ("*" not in r and "://" not in r))]
    spark = urls.sparkSession
    schema = "__name string, __kind string"
    named = spark.createDataFrame([(r, "exact") for r in exact] + [(r, "below") for r in below], schema).distinct()
    keyed = urls.withColumn("__host", u.host(F.col(url)))
    sites = keyed.select("__host").distinct().where("__host <> ''")
    names = sites.select("__host", F.explode(host_suffixes(F.col("__host"))).alias("__name"))
    hits = (
        names.join(named, "__name")
        .where((F.col("__kind") == "below") | (F.col("__name") == F.col("__host")))
        .groupBy("__host").agg(F.max(F.col("__kind") == "exact").alias("__exact"), F.max(F.col("__kind") == "below").alias("__below"))
    )
    web = u.scheme(F.col(url)).isin("http", "https")
    rest = u.rules_match(F.col(url), others) if others else F.lit(False)
    matched = F.coalesce("__exact", F.lit(False)) | (F.coalesce("__below", F.lit(False)) & web) | rest
    return keyed.join(hits, "__host", "left").withColumn("matched", matched).drop("__host", "__exact", "__below")


def site_dispatch(urls: DataFrame, hints: DataFrame, url: str = "url") -> DataFrame:
    """First non-empty ``result`` among the site hints (``host, ord, result``) that cover the address.

    A hint covers its host and all hosts below it; hints are tried by ``ord``.
    """
    keyed = urls.withColumn("__host", u.host(u.clean_url(F.col(url))))
    sites = keyed.select("__host").distinct().where("__host <> ''")
    best = (
        sites.select("__host", F.explode(host_suffixes(F.col("__host"))).alias("host"))
        .join(hints.where(F.coalesce("result", F.lit("")) != ""), "host")
        .groupBy("__host").agg(F.min_by("result", "ord").alias("hint"))
    )
    return keyed.join(best, "__host", "left").drop("__host")


# Marks of advertising and tracking addresses.
TRACKERS = [
    "doubleclick.net", "googlesyndication.com", "googletagmanager.com", "facebook.net", "analytics", "ads", "tracking", "pixel",
    "hotjar.com", "clarity.ms", "mixpanel.com", "segment.com", "demdex.net", "omtrdc.net", "adobedtm.com", "ensighten.com",
    "newrelic.com", "nr-data.net", "google-analytics.com", "connect.facebook.net", "platform.twitter.com", "platform.linkedin.com",
    ".cloudfront.net/image/", ".akamaized.net/image/", "/tracker/", "/collector/", "/beacon/", "/telemetry/", "/log/", "/events/",
    "/eventBatch", "/track.", "/metrics/",
]


def tracker_filter(requests: DataFrame) -> DataFrame:
    """Requests that still matter: no tracker, no inline or very long address, not loading for too long."""
    slow = F.col("duration_ms") > 3000
    light = F.col("type").isin("img", "image", "icon", "font") | F.col("url").rlike(r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|ico)(?:\?|$)")
    tracker = F.col("url").rlike("|".join(f"\\Q{t}\\E" for t in TRACKERS))
    return requests.where(
        ~tracker & ~F.col("url").startswith("data:") & (F.length("url") <= 500) & (F.col("duration_ms") <= 10000) & ~(light & slow)
    )


def domains_seen(requests: DataFrame, shown: int = 5) -> DataFrame:
    """The first hosts in order, and how many more there are."""
    hosts = requests.select(u.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    first = hosts.orderBy("host").limit(shown)
    listed = first.agg(F.array_join(F.array_sort(F.collect_list("host")), ", ").alias("listed"))
    total = hosts.agg(F.count("*")).scalar()
    return listed.select(
        F.when(F.col("listed") == "", "none")
        .when(total > shown, F.concat("listed", F.lit(" +"), (total - shown).cast("string"), F.lit(" more")))
        .otherwise(F.col("listed")).alias("domains")
    )
