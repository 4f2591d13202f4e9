"""URL expressions.  All of them are column expressions; none throws on a bad URL."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986, appendix B.  ``parse_url`` rejects many crawled URLs, this never does.
PARTS = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


HOST = r"(?s)^(?:[^:/?#]+:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user info and port; IPv6 without brackets."""
    return F.lower(F.translate(F.regexp_extract(url, HOST, 1), "[]", ""))


def origin(url: Column) -> Column:
    """``https://host[:port]``, or '' where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("https://"), rest)).otherwise("")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(F.trim(url)), "/"), lambda s: s != "")


def clean_url(url: Column) -> Column:
    """Trim blanks, then quotes and backticks, then closing brackets and punctuation at the end."""
    text = F.regexp_replace(
        F.coalesce(url, F.lit("")), "(?U)^\\s*[`\"' \\t\\r\\n]*|[`\"' \\t\\r\\n]*\\s*$", ""
    )
    return F.regexp_replace(text, r"[\])},，.;；]+$", "")


SITE = r"[^:/?#]+://[^/?#]+"
# Path and query behind the site, without trailing slashes, an empty query and the fragment.
REST = rf"(?s)^{SITE}(?:([^?#]*\?[^#]+?)/*|([^?#]*?)/*\??)(?:#.*)?$"


def normalize_url(url: Column) -> Column:
    """Cleaned URL with a lower-case host, no fragment, no empty query and no trailing slash.

    A text without scheme and host matches neither pattern and stays as it is.  The cleaned address is
    mentioned twice only, since not every operator shares common subexpressions.
    """
    u = clean_url(url)
    return F.concat(F.lower(F.regexp_extract(u, f"^{SITE}", 0)), F.regexp_replace(u, REST, "$1$2"))


def source_hash(page_url: Column, image_url: Column, index: Column | None = None) -> Column:
    n = F.lit(0) if index is None else index
    return F.sha2(F.concat_ws("|", normalize_url(page_url), normalize_url(image_url), n.cast("string")), 256)


@dataclass(frozen=True)
class CollectionSite:
    """Hosts of one collection: item pages at ``/collection/{id}``, data at ``/iiif/3/…``."""

    page_host: str
    data_host: str


HEX_ID = r"^[A-Fa-f0-9]{24,64}$"


def _collection_id(url: Column) -> Column:
    return F.regexp_extract(path(url), r"^/*collection/([^/]*)", 1)


def _is_root(url: Column) -> Column:
    return F.regexp_replace(path(url), "^/+|/+$", "") == "collection"


def valid_item_page(url: Column, site: CollectionSite) -> Column:
    u = clean_url(url)
    return (host(u) == site.page_host) & (_is_root(u) | _collection_id(u).rlike(HEX_ID))


def invalid_item_page(url: Column, site: CollectionSite) -> Column:
    u = clean_url(url)
    item = F.trim(_collection_id(u))
    return (host(u) == site.page_host) & ~_is_root(u) & (item != "") & ~item.rlike(HEX_ID)


def manifest_url(url: Column, site: CollectionSite) -> Column:
    """Manifest address of an item page; a manifest address passes through."""
    u = F.trim(url)
    item = _collection_id(u)
    is_item = (host(u) == site.page_host) & item.rlike(HEX_ID)
    is_manifest = (host(u) == site.data_host) & (F.instr(F.concat(path(u), F.lit("/")), "/iiif/3/manifest/") > 0)
    return (
        F.when(is_item, F.concat(F.lit(f"https://{site.data_host}/iiif/3/manifest/"), F.upper(item)))
        .when(is_manifest, F.regexp_replace(u, "/+$", ""))
        .otherwise("")
    )


def _site_id_of(url: Column, site: CollectionSite) -> Column:
    parts = segments(F.coalesce(url, F.lit("")))
    h = host(F.trim(F.coalesce(url, F.lit(""))))

    def after(word: str) -> Column:
        at = F.array_position(parts, word)
        return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))

    return (
        F.when(
            (h == site.page_host) & (F.size(parts) >= 2) & (F.try_element_at(parts, F.lit(1)) == "collection"),
            F.try_element_at(parts, F.lit(2)),
        )
        .when(
            h == site.data_host,
            F.coalesce(after("manifest"), F.when(F.array_contains(parts, "iiif"), after("3"))),
        )
    )


def site_item_id(page_url: Column, image_url: Column, site: CollectionSite, upper: bool = True) -> Column:
    """Item id from the page address, else from the image address, else ''."""
    found = F.coalesce(_site_id_of(page_url, site), _site_id_of(image_url, site), F.lit(""))
    return F.upper(found) if upper else found


def generic_item_id(page_url: Column, image_url: Column) -> Column:
    """Last path segment with a non-digit and no dot, upper-cased."""

    def last(url: Column) -> Column:
        usable = F.filter(segments(F.coalesce(url, F.lit(""))), lambda s: ~s.rlike(r"^\d+$") & ~s.contains("."))
        return F.try_element_at(usable, F.lit(-1))

    return F.upper(F.coalesce(last(page_url), last(image_url), F.lit("")))


def canonical_item_url(url: Column, base: str) -> Column:
    """``{base}{id}/`` for addresses with an ``/item/{id}`` part, else without the trailing slash."""
    u = F.trim(url)
    item = F.regexp_extract(F.regexp_replace(path(u), "/+$", ""), r"/item/([^/]*)", 1)
    return F.when(F.regexp_replace(path(u), "/+$", "").contains("/item/"), F.concat(F.lit(base), item, F.lit("/"))).otherwise(
        F.regexp_replace(u, "/+$", "")
    )


def canonical_plain_url(url: Column) -> Column:
    """Scheme, host and path only."""
    u = F.trim(url)
    s = F.when(scheme(u) == "", "https").otherwise(scheme(u))
    return F.when(netloc(u) == "", u).otherwise(
        F.concat(s, F.lit("://"), netloc(u), F.regexp_replace(path(u), "/+$", ""))
    )


def query_value(url: Column, name: str) -> Column:
    """First non-empty value of a query parameter, decoded; NULL where absent."""
    raw = F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]+)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def search_keyword(url: Column, name: str = "q") -> Column:
    return F.coalesce(query_value(url, name), F.lit(""))


def search_page(url: Column, name: str = "page") -> Column:
    return F.greatest(F.lit(1), F.coalesce(query_value(url, name).try_cast("bigint"), F.lit(1))).cast("bigint")


def search_limit(url: Column, name: str = "limit", default: int = 50, highest: int = 100) -> Column:
    n = F.coalesce(query_value(url, name).try_cast("bigint"), F.lit(default))
    return F.least(F.greatest(F.lit(1), n), F.lit(highest)).cast("bigint")


def build_search_url(base: str, keyword: Column, page: Column, limit: Column) -> Column:
    text = F.trim(F.regexp_replace(keyword, r"(?U)\s+", " "))
    return F.concat(
        F.lit(base + "?q="), F.url_encode(text),
        F.lit("&limit="), F.least(F.greatest(F.lit(1), limit), F.lit(100)).cast("string"),
        F.lit("&page="), F.greatest(F.lit(1), page).cast("string"),
    )


def is_results_url(url: Column, results_host: str, results_path: str, name: str = "q") -> Column:
    """Search result address: host, path and a non-empty keyword parameter agree."""
    p = F.lower(F.regexp_replace(path(url), "/+$", ""))
    return (host(url) == results_host) & (p == results_path) & query(url).rlike(rf"(?:^|&){name}=[^&]")


def looks_like_manifest(url: Column) -> Column:
    p = F.regexp_replace(F.lower(path(F.trim(url))), "/+$", "")
    return p.contains("/iiif/") & (p.contains("/manifest/") | p.endswith("/manifest"))


def looks_like_image_service(url: Column) -> Column:
    return path(F.trim(url)).rlike(r"^/*image/iiif/[23]/[^/]")


DEFAULT_IMAGE = r"(?i)/full/[^/]+/[^/]+/default\.(?:jpe?g|png|webp|tiff?)$"


def default_image_url(url: Column) -> Column:
    """Full-size address of an image service; other addresses unchanged."""
    u = F.regexp_replace(F.trim(url), "/+$", "")
    return F.when(path(u).rlike(DEFAULT_IMAGE) | ~looks_like_image_service(u), u).otherwise(
        F.concat(u, F.lit("/full/max/0/default.jpg"))
    )


def iiif_score(url: Column) -> Column:
    """Preference of an image address; the weights are fixed values."""
    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    return (
        points(url.contains("/image/iiif/"), 500)
        + points(url.contains("/full/"), 250)
        + points(url.rlike(r"(?i)/full/(?:max|full)/"), 120)
        + points(path(url).rlike(r"(?i)/default\.(?:jpe?g|png|webp|tiff?)$"), 80)
        + points(url.rlike(r"(?i)preview|thumb|thumbnail|small"), -300)
    )


def image_candidate_score(url: Column, source: Column, natural_area: Column, area: Column) -> Column:
    """Score of an image found on a page; the weights are fixed values."""
    def points(pattern: str, n: int) -> Column:
        return F.when(url.rlike(pattern), n).otherwise(0)

    return (
        points(r"(?i)/iiif/|image/iiif", 300)
        + points(r"(?i)/full/(?:max|full|\^?!?\d)", 180)
        + points(r"(?i)(?:large|original|full|master|default)\.(?:jpe?g|png|webp|tiff?)(?:[?#]|$)", 120)
        + points(r"(?i)\.(?:jpe?g|png|webp|tiff?)(?:[?#]|$)", 80)
        + points(r"(?i)-L\.(?:jpe?g|png|webp)(?:[?#]|$)", 80)
        + points(r"(?i)-M\.(?:jpe?g|png|webp)(?:[?#]|$)", 40)
        - points(r"(?i)thumb|thumbnail|small|icon|logo|sprite|avatar|button|banner", 180)
        + F.when(source.rlike("(?i)download"), 20).otherwise(0)
        + F.least(F.coalesce(natural_area, F.lit(0)), F.lit(4_000_000)) / 40_000
        + F.least(F.coalesce(area, F.lit(0)), F.lit(1_000_000)) / 20_000
    )


OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"

# Names and addresses that are not public.  IPv4 ranges are those reserved for
# private, loopback, link-local, documentation, benchmark, multicast and future use; IPv6 covers
# loopback, unspecified, link-local, unique-local, multicast, documentation and mapped IPv4.
LOCAL_NAMES = r"localhost|localhost\.localdomain|.*\.(?:localhost|local|internal)"
PRIVATE_IPV4 = (
    r"(?:0|10|127|22[4-9]|23\d|24\d|25[0-5])\..*|169\.254\..*|172\.(?:1[6-9]|2\d|3[01])\..*|192\.0\.[02]\..*"
    r"|192\.168\..*|198\.1[89]\..*|198\.51\.100\..*|203\.0\.113\..*"
)
PRIVATE_IPV6 = r"::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|ff[0-9a-f]{2}:.*|2001:db8:.*|::ffff:.*"
NOT_PUBLIC = rf"^(?:{LOCAL_NAMES}|(?={IPV4}$)(?:{PRIVATE_IPV4})|{PRIVATE_IPV6})?\.*$"


def public_image_url(url: Column, suffixes: list[str] | None = None) -> Column:
    """True for http(s) addresses of public hosts, within ``suffixes`` where given.

    One regex per test: a filter has no common-subexpression elimination, so every further
    mention of the host would parse the address again.
    """
    u = clean_url(url)
    ok = u.rlike("(?i)^https?:") & ~host(u).rlike(NOT_PUBLIC)
    if suffixes:
        names = "|".join(s.replace(".", r"\.") for s in suffixes)
        ok = ok & host(u).rlike(rf"^(?:.*\.)?(?:{names})\.*$")
    return ok


def is_ip(h: Column) -> Column:
    return h.rlike(rf"^{IPV4}$|:")


def http_protocol(raw: Column) -> Column:
    p = F.lower(raw)
    return (
        F.when((p == "h2") | p.startswith("http/2"), "HTTP/2.0")
        .when(p.startswith("http/1.1"), "HTTP/1.1")
        .when(p.startswith("http/1.0"), "HTTP/1.0")
        .otherwise(F.upper(raw))
    )


def headers_size(method: Column, url: Column, headers: Column) -> Column:
    """Bytes of the request line, the ``name: value`` lines and the closing line break."""
    line = F.length(F.concat(method, F.lit(" "), url, F.lit(" HTTP/1.1"))) + 2
    fields = F.aggregate(
        F.map_entries(headers),
        F.lit(0),
        lambda n, e: n + F.length(e["key"]) + F.length(e["value"]) + 4,
    )
    return F.coalesce(line, F.lit(0)) + F.coalesce(fields, F.lit(0)) + 2


def request_body_size(method: Column, content_length: Column, body: Column) -> Column:
    return F.coalesce(
        content_length.try_cast("bigint"),
        F.when(content_length.isNotNull(), F.lit(-1)),
        F.octet_length(body).cast("bigint"),
        F.when(F.upper(method).isin("GET", "HEAD"), F.lit(0)),
        F.lit(-1),
    ).cast("bigint")


# ---- rules -----------------------------------------------------------------------------------

# Pages a browser opens by itself.
NEW_TAB = ["about:blank", "chrome://new-tab-page/", "chrome://new-tab-page", "chrome://newtab/", "chrome://newtab"]


def glob_regex(pattern: str) -> str:
    """Regex source of a shell glob, without anchors."""
    return fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")


def _quoted(text: str) -> str:
    return re.escape(text)


def rules_regex(patterns: list[str]) -> tuple[str | None, str | None]:
    """(regex over ``scheme://host``, regex over the whole address) that cover all list patterns."""
    by_host: list[str] = []
    by_url: list[str] = []
    for p in patterns:
        if p.startswith("*."):
            by_host.append(rf"https?://(?:.*\.)?{_quoted(p[2:])}")
        elif "*" in p and p.endswith("/*"):
            by_url.append(glob_regex(p) + "$")
        elif "*" in p:
            by_host.append(glob_regex(p) if "://" in p else rf"[^:]*://{glob_regex(p)}")
        elif "://" in p:
            by_url.append(_quoted(p))
        else:
            www = r"(?:www\.)?" if p.count(".") == 1 else ""
            by_host.append(rf"[^:]*://{www}{_quoted(p.lower())}")
    host_regex = rf"(?s)^(?:{'|'.join(by_host)})$" if by_host else None
    url_regex = rf"(?s)^(?:{'|'.join(by_url)})" if by_url else None
    return host_regex, url_regex


def site_key(url: Column) -> Column:
    """``scheme://host``."""
    return F.concat(scheme(url), F.lit("://"), host(url))


def rules_match(url: Column, patterns: list[str]) -> Column:
    """Does any list pattern cover the address?  All patterns compile into one or two regexes."""
    host_regex, url_regex = rules_regex(patterns)
    hit = F.lit(False)
    if host_regex:
        hit = hit | site_key(url).rlike(host_regex)
    if url_regex:
        hit = hit | url.rlike(url_regex)
    return hit


def domain_pattern_regex(pattern: str) -> str | None:
    """Regex over ``scheme://host`` of the strict pattern form, or None for an unsafe pattern.

    https unless the pattern says more; one leading ``*.`` (or a bare ``*``) is all the globbing allowed.
    """
    p = pattern.lower()
    scheme_part, dom = p.split("://", 1) if "://" in p else ("https", p)
    if ":" in dom and not dom.startswith(":"):
        dom = dom.split(":", 1)[0]
    head = rf"(?s)^{glob_regex(scheme_part)}://"
    if dom == "*":
        return head + ".+$"
    if "*" not in dom:
        return head + _quoted(dom) + "$"
    if dom.count("*.") > 1 or dom.count(".*") > 1 or dom.endswith(".*") or "*" in dom.replace("*.", ""):
        return None
    if dom.startswith("*."):
        return head + rf"(?:.*\.)?{_quoted(dom[2:])}$"
    return head + glob_regex(dom) + "$"


def domain_pattern_match(url: Column, pattern: str) -> Column:
    regex = domain_pattern_regex(pattern)
    if regex is None:
        return F.lit(False)
    return F.coalesce(~url.isin(NEW_TAB) & ~site_key(url).rlike("^://|://$") & site_key(url).rlike(regex), F.lit(False))


def www_variants(h: Column) -> Column:
    """The host and its form with or without ``www.``."""
    return F.array(h, F.when(h.startswith("www."), F.substr(h, F.lit(5))).otherwise(F.concat(F.lit("www."), h)))
