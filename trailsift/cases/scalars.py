"""FN-* and FIL-* column expressions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailsift.cases import fixtures as fx
from trailsift.cases.base import case
from trailsift.functions import elements as el
from trailsift.functions import text as tx
from trailsift.functions import trace as tr
from trailsift.functions import urls as u

SITE = u.CollectionSite(page_host="coll.example.uk", data_host="data.example.uk")

# ---- SQL fragments ---------------------------------------------------------------------------

_PARTS = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def s_part(x: str, i: int) -> str:
    return f"regexp_extract({x}, '{_PARTS}', {i})"


def s_scheme(x: str) -> str:
    return f"lower({s_part(x, 1)})"


def s_path(x: str) -> str:
    return s_part(x, 3)


def s_host(x: str) -> str:
    bare = f"regexp_replace({s_part(x, 2)}, '^.*@', '')"
    return f"lower(regexp_replace({bare}, ':.*$', ''))"


def s_clean(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"
    t = f"regexp_replace({t}, '^[`\"'' \\t\\r\\n]+|[`\"'' \\t\\r\\n]+$', '', 'g')"
    return f"regexp_replace({t}, '[\\]\\)\\}},，.;；]+$', '')"


def s_norm(x: str) -> str:
    c = s_clean(x)
    q = f"CASE WHEN {s_part(c, 4)} <> '' THEN '?' || {s_part(c, 4)} ELSE '' END"
    whole = f"{s_scheme(c)} || '://' || lower({s_part(c, 2)}) || {s_path(c)} || {q}"
    return (
        f"CASE WHEN {s_scheme(c)} = '' OR {s_part(c, 2)} = '' THEN {c} "
        f"ELSE rtrim({whole}, '/') END"
    )


def s_segments(x: str) -> str:
    return f"list_filter(string_split({s_path(f'trim({x})')}, '/'), lambda s: s <> '')"


def urls_case(name: str, columns: Callable[[], dict[str, Column]], sql_columns: dict[str, str]) -> None:
    """A query of expressions over the address fixture and its twin."""
    sql = "SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in sql_columns.items()) + " FROM fx_urls"

    @case(name, sql)
    def _query(spark, sf):
        return fx.urls(spark, sf).select("event_id", *[c.alias(n) for n, c in columns().items()])


# ---- addresses -------------------------------------------------------------------------------

urls_case("fn_1_clean_url", lambda: {"clean": u.clean_url(F.col("url"))}, {"clean": s_clean("url")})
urls_case("fn_2_normalize_url", lambda: {"normal": u.normalize_url(F.col("url"))}, {"normal": s_norm("url")})
urls_case(
    "fn_3_source_hash",
    lambda: {"h": u.source_hash(F.col("url"), F.concat(F.col("url"), F.lit("/img")), F.col("k"))},
    {"h": f"sha256(({s_norm('url')}) || '|' || ({s_norm(chr(40) + 'url || ' + chr(39) + '/img' + chr(39) + chr(41))}) || '|' || k)"},
)

_id_case = r"""
WITH a AS (
  SELECT event_id, url, """ + s_host("trim(url)") + r""" AS h, """ + s_segments("url") + r""" AS p FROM fx_urls
)
SELECT event_id, """
_site_id = """coalesce(CASE WHEN h = 'coll.example.uk' AND len(p) >= 2 AND p[1] = 'collection' THEN p[2]
  WHEN h = 'data.example.uk' THEN coalesce(
    CASE WHEN list_position(p, 'manifest') > 0 THEN p[list_position(p, 'manifest') + 1] END,
    CASE WHEN list_contains(p, 'iiif') AND list_position(p, '3') > 0 THEN p[list_position(p, '3') + 1] END) END, '')"""


@case("fn_6_site_item_id", _id_case + f"upper({_site_id}) AS item, {_site_id} AS item_as_is FROM a")
def _(spark, sf):
    none = F.lit("")
    return fx.urls(spark, sf).select(
        "event_id",
        u.site_item_id(F.col("url"), none, SITE).alias("item"),
        u.site_item_id(none, F.col("url"), SITE, upper=False).alias("item_as_is"),
    )


@case(
    "fn_7_generic_item_id",
    _id_case
    + r"coalesce(upper(list_filter(p, lambda s: NOT regexp_matches(s, '^\d+$') AND NOT contains(s, '.'))[-1]), '') AS item FROM a",
)
def _(spark, sf):
    return fx.urls(spark, sf).select("event_id", u.generic_item_id(F.col("url"), F.lit("")).alias("item"))


_page_id = f"regexp_extract({s_path('trim(url)')}, '^/*collection/([^/]*)', 1)"
urls_case(
    "fn_8_manifest_url",
    lambda: {"manifest": u.manifest_url(F.col("url"), SITE)},
    {
        "manifest": f"""CASE WHEN {s_host('trim(url)')} = 'coll.example.uk' AND regexp_matches({_page_id}, '^[A-Fa-f0-9]{{24,64}}$')
          THEN 'https://data.example.uk/iiif/3/manifest/' || upper({_page_id})
          WHEN {s_host('trim(url)')} = 'data.example.uk' AND contains({s_path('trim(url)')} || '/', '/iiif/3/manifest/')
          THEN rtrim(trim(url), '/') ELSE '' END"""
    },
)
urls_case(
    "fn_9_canonical_url",
    lambda: {
        "item_url": u.canonical_item_url(F.col("url"), "https://www.library.example.gov/item/"),
        "plain_url": u.canonical_plain_url(F.col("url")),
    },
    {
        "item_url": f"""CASE WHEN contains(rtrim({s_path('trim(url)')}, '/'), '/item/')
          THEN 'https://www.library.example.gov/item/' || regexp_extract(rtrim({s_path('trim(url)')}, '/'), '/item/([^/]*)', 1) || '/'
          ELSE rtrim(trim(url), '/') END""",
        "plain_url": f"""CASE WHEN {s_part('trim(url)', 2)} = '' THEN trim(url)
          ELSE CASE WHEN {s_scheme('trim(url)')} = '' THEN 'https' ELSE {s_scheme('trim(url)')} END
            || '://' || {s_part('trim(url)', 2)} || rtrim({s_path('trim(url)')}, '/') END""",
    },
)


def _s_param(name: str) -> str:
    return f"nullif(regexp_extract({s_part('url', 4)}, '(?:^|&){name}=([^&]+)', 1), '')"


urls_case(
    "fn_10_parse_search_url",
    lambda: {"keyword": u.search_keyword(F.col("url")), "page": u.search_page(F.col("url")), "page_limit": u.search_limit(F.col("url"))},
    {
        "keyword": f"coalesce(url_decode(replace({_s_param('q')}, '+', ' ')), '')",
        "page": f"greatest(1, coalesce(try_cast({_s_param('page')} AS BIGINT), 1))",
        "page_limit": f"least(greatest(1, coalesce(try_cast({_s_param('limit')} AS BIGINT), 50)), 100)",
    },
)


@case(
    "fn_10_build_search_url",
    r"""SELECT event_id, 'https://search.example.org/results?q='
      || replace(url_encode(trim(regexp_replace('  old ' || event_type || '  temple ' || k, '\s+', ' ', 'g'))), '%20', '+')
      || '&limit=' || least(greatest(1, k * 2), 100) || '&page=' || greatest(1, user_id % 9) AS built FROM fx_events""",
)
def _(spark, sf):
    words = F.concat(F.lit("  old "), F.col("event_type"), F.lit("  temple "), F.col("k").cast("string"))
    return fx.events(spark, sf).select(
        "event_id",
        u.build_search_url("https://search.example.org/results", words, F.col("user_id") % 9, F.col("k") * 2).alias("built"),
    )


urls_case(
    "fn_11_iiif_shape",
    lambda: {
        "is_manifest": u.looks_like_manifest(F.col("url")),
        "is_service": u.looks_like_image_service(F.col("url")),
        "image_url": u.default_image_url(F.col("url")),
    },
    {
        "is_manifest": f"""contains(lower({s_path('trim(url)')}), '/iiif/') AND (contains(rtrim(lower({s_path('trim(url)')}), '/'), '/manifest/')
          OR ends_with(rtrim(lower({s_path('trim(url)')}), '/'), '/manifest'))""",
        "is_service": f"regexp_matches({s_path('trim(url)')}, '^/*image/iiif/[23]/[^/]')",
        "image_url": f"""CASE WHEN regexp_matches({s_path('url')}, '(?i)/full/[^/]+/[^/]+/default\\.(jpe?g|png|webp|tiff?)$')
          OR NOT regexp_matches({s_path('trim(url)')}, '^/*image/iiif/[23]/[^/]') THEN rtrim(trim(url), '/')
          ELSE rtrim(trim(url), '/') || '/full/max/0/default.jpg' END""",
    },
)
urls_case(
    "fn_12_iiif_score",
    lambda: {"score": u.iiif_score(F.col("url"))},
    {
        "score": r"""CASE WHEN contains(url, '/image/iiif/') THEN 500 ELSE 0 END + CASE WHEN contains(url, '/full/') THEN 250 ELSE 0 END
          + CASE WHEN regexp_matches(url, '(?i)/full/(max|full)/') THEN 120 ELSE 0 END
          + CASE WHEN regexp_matches(url, '(?i)/default\.(jpe?g|png|webp|tiff?)($|[?#])') THEN 80 ELSE 0 END
          - CASE WHEN regexp_matches(url, '(?i)preview|thumb|small') THEN 300 ELSE 0 END"""
    },
)
urls_case(
    "fn_13_image_candidate_score",
    lambda: {"score": F.round(u.image_candidate_score(F.col("url"), F.col("event_type"), F.col("k") * 90000, F.col("k") * 20000), 4)},
    {
        "score": r"""round(CASE WHEN regexp_matches(url, '(?i)/iiif/|image/iiif') THEN 300 ELSE 0 END
          + CASE WHEN regexp_matches(url, '(?i)/full/(max|full|\^?!?\d)') THEN 180 ELSE 0 END
          + CASE WHEN regexp_matches(url, '(?i)(large|original|full|master|default)\.(jpe?g|png|webp|tiff?)([?#]|$)') THEN 120 ELSE 0 END
          + CASE WHEN regexp_matches(url, '(?i)\.(jpe?g|png|webp|tiff?)([?#]|$)') THEN 80 ELSE 0 END
          + CASE WHEN regexp_matches(url, '(?i)-L\.(jpe?g|png|webp)([?#]|$)') THEN 80 ELSE 0 END
          + CASE WHEN regexp_matches(url, '(?i)-M\.(jpe?g|png|webp)([?#]|$)') THEN 40 ELSE 0 END
          - CASE WHEN regexp_matches(url, '(?i)thumb|small|icon|logo|sprite|avatar|button|banner') THEN 180 ELSE 0 END
          + least(k * 90000, 4000000) / 40000 + least(k * 20000, 1000000) / 20000, 4)"""
    },
)

_RANGES = [  # reserved IPv4 ranges (address, prefix length)
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
]


def _range_sql(address: str, bits: int) -> str:
    first = sum(int(o) << (24 - 8 * i) for i, o in enumerate(address.split(".")))
    return f"n4 BETWEEN {first} AND {first + (1 << (32 - bits)) - 1}"


_private4 = " OR ".join(_range_sql(a, b) for a, b in _RANGES)
_octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_with_ip = f"""
WITH h AS (SELECT *, {s_clean('url')} AS c FROM fx_urls),
g AS (SELECT *, {s_host('c')} AS host FROM h),
ip AS (SELECT *, CASE WHEN regexp_matches(host, '^{_octet}(\\.{_octet}){{3}}$') THEN
  try_cast(split_part(host, '.', 1) AS BIGINT) * 16777216 + try_cast(split_part(host, '.', 2) AS BIGINT) * 65536
  + try_cast(split_part(host, '.', 3) AS BIGINT) * 256 + try_cast(split_part(host, '.', 4) AS BIGINT) END AS n4 FROM g)
"""


@case(
    "fil_6_public_image_url",
    _with_ip
    + f"""SELECT event_id, url FROM ip WHERE {s_scheme('c')} IN ('http', 'https') AND host <> ''
      AND NOT regexp_matches(host, '(^localhost$|\\.localhost$|\\.local$|\\.internal$)')
      AND NOT coalesce({_private4}, false)""",
)
def _(spark, sf):
    return fx.urls(spark, sf).where(u.public_image_url(F.col("url"))).select("event_id", "url")


urls_case(
    "fil_7_item_page",
    lambda: {"valid": u.valid_item_page(F.col("url"), SITE), "invalid": u.invalid_item_page(F.col("url"), SITE)},
    {
        "valid": f"""{s_host(s_clean('url'))} = 'coll.example.uk' AND (trim({s_path(s_clean('url'))}, '/') = 'collection'
           OR regexp_matches(regexp_extract({s_path(s_clean('url'))}, '^/*collection/([^/]*)', 1), '^[A-Fa-f0-9]{{24,64}}$'))""",
        "invalid": f"""{s_host(s_clean('url'))} = 'coll.example.uk' AND trim({s_path(s_clean('url'))}, '/') <> 'collection'
           AND regexp_matches({s_path(s_clean('url'))}, '^/*collection/[^/]')
           AND NOT regexp_matches(regexp_extract({s_path(s_clean('url'))}, '^/*collection/([^/]*)', 1), '^[A-Fa-f0-9]{{24,64}}$')""",
    },
)

# Subject words of the collected items and of items that only look alike.
INCLUDE = ["buddh", "temple", "monaster", "pagoda", "shrine", "item"]
EXCLUDE = ["committee", "yankee stadium", "search"]


@case(
    "fil_8_relevant",
    r"""SELECT event_id, url FROM fx_urls WHERE trim('View ' || event_type || ' ' || url) <> ''
      AND regexp_matches(lower('View ' || event_type || ' ' || url), 'buddh|temple|monaster|pagoda|shrine|item')
      AND NOT regexp_matches(lower('View ' || event_type || ' ' || url), 'committee|yankee stadium|search')""",
)
def _(spark, sf):
    title = F.concat(F.lit("View "), F.col("event_type"))
    return fx.urls(spark, sf).where(tx.relevant(title, F.col("url"), INCLUDE, EXCLUDE)).select("event_id", "url")


@case(
    "fil_13_results_url",
    f"""SELECT event_id, url FROM fx_urls WHERE {s_host('url')} = 'search.example.org'
      AND lower(rtrim({s_path('url')}, '/')) = '/results' AND regexp_matches({s_part('url', 4)}, '(^|&)q=[^&]')""",
)
def _(spark, sf):
    return fx.urls(spark, sf).where(u.is_results_url(F.col("url"), "search.example.org", "/results")).select("event_id", "url")


@case("fil_14_loop_exempt", "SELECT run, pos, name FROM fx_actions WHERE name NOT IN ('wait', 'done', 'go_back')")
def _(spark, sf):
    return fx.actions(spark, sf).where(~tr.loop_exempt(F.col("name"))).select("run", "pos", "name")


# ---- names and numbers -----------------------------------------------------------------------


@case(
    "fn_4_text_hash",
    r"""SELECT doc_id, sha256(text) AS h256, sha1(text) AS h1, md5(source) AS h5, 'img_' || substr(sha256(text), 1, 16) AS image_id,
      'orphan_' || substr(sha256(text), 1, 16) AS orphan_id, substr(sha256(text), 1, 8) AS short_id FROM documents""",
)
def _(spark, sf):
    text = F.col("text")
    h = F.sha2(text, 256)
    return fx.table(spark, sf, "documents").select(
        "doc_id", h.alias("h256"), F.sha1(text).alias("h1"), F.md5("source").alias("h5"),
        tx.row_id(h, "img_").alias("image_id"), tx.row_id(h, "orphan_").alias("orphan_id"),
        F.substring(h, 1, 8).alias("short_id"),
    )


_hash_in = "CASE WHEN k % 3 = 0 THEN ' ' || upper(sha256) || ' ' WHEN k % 3 = 1 THEN substr(sha256, 1, 40) ELSE sha256 END"
_r_with_k = "(SELECT r.*, e.k FROM fx_records r JOIN fx_events e ON e.event_id = r.pos)"


@case(
    "fn_5_valid_sha256",
    f"SELECT pos, CASE WHEN regexp_matches(lower(trim({_hash_in})), '^[0-9a-f]{{64}}$') THEN lower(trim({_hash_in})) ELSE '' END AS h FROM {_r_with_k}",
)
def _(spark, sf):
    k = F.col("pos") * 0 + F.regexp_extract("image_url", r"img/(\d+)/", 1).cast("bigint")
    raw = (
        F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper("sha256"), F.lit(" ")))
        .when(k % 3 == 1, F.substring("sha256", 1, 40))
        .otherwise(F.col("sha256"))
    )
    return fx.records(spark, sf).select("pos", tx.valid_sha256(raw).alias("h"))


_title = "CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN '  Temple_12_Old' || chr(10) || 'gate|' || k ELSE 'image_7_Stone: lamp ' || k || '?' END"


def _titles(spark, sf):
    k = F.col("k")
    title = (
        F.when(k % 4 == 0, "")
        .when(k % 4 == 1, F.concat(F.lit("  Temple_12_Old\ngate|"), k.cast("string")))
        .otherwise(F.concat(F.lit("image_7_Stone: lamp "), k.cast("string"), F.lit("?")))
    )
    return fx.events(spark, sf).select("event_id", title.alias("title"), "k", "user_id")


_t = f"(SELECT event_id, {_title} AS title, k, user_id FROM fx_events)"
_norm_title = r"CASE WHEN trim(regexp_replace(title, '\s+', ' ', 'g')) = '' THEN 'untitled' ELSE trim(regexp_replace(title, '\s+', ' ', 'g')) END"


@case(
    "fn_14_titles_and_names",
    f"""SELECT event_id, {_norm_title} AS title, trim(regexp_replace(replace(title, '|', '\\|'), '\\s+', ' ', 'g')) AS cell,
      trim(substr(regexp_replace(regexp_replace({_norm_title}, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '\\s+', '_', 'g'), 1, 400), '._ ') AS file_stem
      FROM {_t}""",
)
def _(spark, sf):
    t = F.col("title")
    return _titles(spark, sf).select(
        "event_id",
        tx.normalize_title(t, F.lit("untitled")).alias("title"),
        tx.markdown_cell(t).alias("cell"),
        tx.sanitize_filename(t).alias("file_stem"),
    )


_pad = "CASE WHEN length(CAST(event_id AS VARCHAR)) < 3 THEN lpad(CAST(event_id AS VARCHAR), 3, '0') ELSE CAST(event_id AS VARCHAR) END"


@case(
    "fn_15_final_file_name",
    f"""WITH a AS (SELECT event_id, k, md5(CAST(user_id AS VARCHAR)) AS digest, {_pad} AS seq,
        CASE WHEN trim(regexp_replace(title, '\\s+', ' ', 'g')) = '' THEN 'image_' || {_pad}
             ELSE trim(regexp_replace(title, '\\s+', ' ', 'g')) END AS t FROM {_t}),
      b AS (SELECT *, regexp_replace(t, '(?i)^(temple|image)_\\d{{1,6}}_?', '') AS t2 FROM a),
      c AS (SELECT *, CASE WHEN regexp_matches(t2, '_\\d{{3,}}(_|$)') THEN t2 ELSE seq || '_' || t2 END AS t3 FROM b),
      d AS (SELECT *, trim(regexp_replace(regexp_replace(t3, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '_+', '_', 'g'), '._ ') AS t4 FROM c)
      SELECT event_id, CASE WHEN t4 = '' THEN 'image_' || seq ELSE t4 END || '_' || substr(digest, 1, 8)
        || CASE WHEN k % 2 = 0 THEN '.tiff' ELSE '.jpg' END AS file_name FROM d""",
)
def _(spark, sf):
    ext = F.when(F.col("k") % 2 == 0, "TIFF").otherwise(".gif")
    name = tx.final_file_name(F.col("title"), F.col("event_id"), F.md5(F.col("user_id").cast("string")), ext)
    return _titles(spark, sf).select("event_id", name.alias("file_name"))


_name = "'hall_' || CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k * 37 AS VARCHAR) || '_' END || 'w' || user_id || '.jpg'"


@case(
    "fn_16_sequence_names",
    f"""WITH a AS (SELECT event_id, k, {_name} AS f FROM fx_events),
      b AS (SELECT *, regexp_replace(f, '\\.[^.]*$', '') AS stem FROM a)
      SELECT event_id, try_cast(nullif(regexp_extract(stem, '_(\\d{{3,}})(\\D|$)', 1), '') AS BIGINT) AS seq,
        CASE WHEN regexp_extract(stem, '^(.+?)_\\d{{3,}}(\\D.*)?$', 1) = '' THEN 'temple' ELSE regexp_extract(stem, '^(.+?)_\\d{{3,}}(\\D.*)?$', 1) END AS prefix,
        regexp_replace(stem, '_(\\d{{1,4}})_', '_' || {_pad} || '_') AS renumbered,
        CASE WHEN regexp_extract(stem, '^(.+?)_\\d{{3,}}(\\D.*)?$', 1) = '' THEN 'temple' ELSE regexp_extract(stem, '^(.+?)_\\d{{3,}}(\\D.*)?$', 1) END
          || '_' || {_pad} AS numbered FROM b""",
)
def _(spark, sf):
    k = F.col("k")
    name = F.concat(
        F.lit("hall_"),
        F.when(k % 3 == 0, "").otherwise(F.concat((k * 37).cast("string"), F.lit("_"))),
        F.lit("w"), F.col("user_id").cast("string"), F.lit(".jpg"),
    )
    f = F.col("f")
    return fx.events(spark, sf).select("event_id", name.alias("f")).select(
        "event_id",
        tx.sequence_from_name(f).alias("seq"),
        tx.prefix_from_name(f).alias("prefix"),
        tx.renumber_title(tx.stem_of(f), F.col("event_id")).alias("renumbered"),
        tx.numbered_stem(f, F.col("event_id")).alias("numbered"),
    )


_types = ["image/jpeg", "IMAGE/PNG; charset=x", "application/ld+json", "application/json;v=1", "text/html", "image/svg+xml", "font/woff2", ""]
_type_sql = "list_extract([" + ", ".join(f"'{t}'" for t in _types) + "], k % 8 + 1)"
_media_sql = f"trim(split_part(lower({_type_sql}), ';', 1))"
_map = lambda m: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"


@case(
    "fn_17_extensions",
    f"""SELECT event_id, coalesce(({_map(tx.CONTENT_TYPE_EXT)})[{_media_sql}], '.jpg') AS image_ext,
      coalesce(({_map(tx.MIME_EXT)})[{_media_sql}], 'bin') AS body_ext,
      {_media_sql} = 'application/json' OR ends_with({_media_sql}, '+json') AS is_json,
      CASE k % 5 WHEN 0 THEN '.tif' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 3 THEN '.png' ELSE '.png' END AS normal_ext,
      CASE WHEN regexp_matches({s_path('url')}, '(?i)\\.(jpg|jpeg|png|webp|bmp|tif|tiff)$')
        THEN lower(regexp_extract({s_path('url')}, '(\\.[^./]+)$', 1)) ELSE '.jpg' END AS url_ext
      FROM fx_urls""",
)
def _(spark, sf):
    kind = F.element_at(F.array(*[F.lit(t) for t in _types]), (F.col("k") % 8 + 1).cast("int"))
    raw = F.element_at(F.array(*[F.lit(t) for t in ("TIF", ".jpe", "gif", "", ".png")]), (F.col("k") % 5 + 1).cast("int"))
    return fx.urls(spark, sf).select(
        "event_id",
        tx.ext_from_content_type(kind).alias("image_ext"),
        tx.mime_to_ext(kind).alias("body_ext"),
        tx.is_json_type(kind).alias("is_json"),
        tx.normalize_ext(raw).alias("normal_ext"),
        tx.ext_from_path(u.path(F.col("url"))).alias("url_ext"),
    )


@case(
    "fn_18_coerce_int",
    r"""SELECT event_id, least(greatest(coalesce(try_cast(nullif(regexp_extract(url, '\d+'), '') AS BIGINT),
      CASE WHEN regexp_matches(url, '\d') THEN 900 ELSE 50 END), 1), 900) AS n FROM fx_urls""",
)
def _(spark, sf):
    return fx.urls(spark, sf).select("event_id", tx.coerce_int(F.col("url"), 50, 1, 900).alias("n"))


@case(
    "fn_19_metadata",
    """SELECT pos, 'kind: ' || split_part(title, '_', 3) || '; site: s' || (pos % 3) || '; k: ' || regexp_extract(image_url, 'img/(\\d+)/', 1) AS merged
       FROM fx_records""",
)
def _(spark, sf):
    overview = F.concat(
        F.lit("kind: "), F.element_at(F.split("title", "_"), 3), F.lit("; empty: ; site: s"), (F.col("pos") % 3).cast("string"),
        F.lit("; kind: twice"),
    )
    return fx.records(spark, sf).select("pos", tx.pairs_text(tx.merge_metadata(overview, F.col("metadata"))).alias("merged"))


# ---- actions, texts, secrets ------------------------------------------------------------------

_norm_action = r"""CASE name
  WHEN 'search' THEN 'search|google|' || CASE WHEN k % 2 = 0 THEN '0|old|temple' ELSE '1|old|temple' END
  WHEN 'click' THEN 'click|' || (k % 6) WHEN 'input' THEN 'input|' || (k % 6) || '|t' || (k % 2)
  WHEN 'navigate' THEN 'navigate|' || url ELSE name || '|{"seconds": ' || (k % 3) || '}' END"""
fx.SQL["fx_hashed"] = f"SELECT *, substr(sha256({_norm_action}), 1, 12) AS action_hash FROM fx_steps"


@case("fn_21_action_hash", f"SELECT run, pos, {_norm_action} AS normal, action_hash FROM fx_hashed")
def _(spark, sf):
    name, params = F.col("name"), F.col("params")
    return fx.actions(spark, sf).select(
        "run", "pos", tr.normalize_action(name, params).alias("normal"), tr.action_hash(name, params).alias("action_hash")
    )


@case(
    "fn_22_page_fingerprint",
    "SELECT run, pos, url || '|' || element_count || '|' || substr(sha256(dom_text), 1, 16) AS fp FROM fx_actions",
)
def _(spark, sf):
    fp = tr.page_fingerprint(F.col("url"), F.col("dom_text"), F.col("element_count"))
    return fx.actions(spark, sf).select("run", "pos", fp.alias("fp"))


_values = ["ann@example.org", "+1 (555) 010-{n}99", "2024-01-05", "Maria", "Maria Lopez", "Ana Maria Lopez", "{n}", "no match, x"]
_value_sql = "replace(list_extract([" + ", ".join(f"'{v}'" for v in _values) + "], event_id % 8 + 1), '{n}', CAST(1000 + user_id AS VARCHAR))"
_hints = ["", "billing-street", "user_comment", "first name", "zip", "cellular", "company", "e-mail box", "ADDR shipping"]
_hint_sql = "list_extract([" + ", ".join(f"'{h}'" for h in _hints) + "], user_id % 9 + 1)"


@case(
    "fn_23_detect_variable",
    f"""WITH a AS (SELECT event_id, {_value_sql} AS v, {_hint_sql} AS h, k % 10 = 9 AS typed FROM fx_events)
      SELECT event_id, CASE WHEN typed THEN 'phone' WHEN h = 'billing-street' THEN 'billing_address' WHEN h = 'user_comment' THEN 'comment'
        WHEN h = 'first name' THEN 'first_name' WHEN h = 'zip' THEN 'zip_code' WHEN h = 'cellular' THEN 'phone'
        WHEN h = 'company' THEN 'company' WHEN h = 'e-mail box' THEN 'email' WHEN h = 'ADDR shipping' THEN 'shipping_address'
        WHEN contains(v, '@') THEN 'email' WHEN starts_with(v, '+') THEN 'phone' WHEN v = '2024-01-05' THEN 'date'
        WHEN v = 'Maria' THEN 'first_name' WHEN v = 'Maria Lopez' THEN 'full_name' WHEN v = 'Ana Maria Lopez' THEN 'name'
        WHEN regexp_matches(v, '^\\d+$') THEN 'number' END AS name,
      CASE WHEN typed THEN 'phone' WHEN h IN ('billing-street', 'user_comment', 'first name', 'company', 'ADDR shipping') THEN NULL
        WHEN h = 'zip' THEN 'postal_code' WHEN h = 'cellular' THEN 'phone' WHEN h = 'e-mail box' THEN 'email'
        WHEN contains(v, '@') THEN 'email' WHEN starts_with(v, '+') THEN 'phone' WHEN v = '2024-01-05' THEN 'date'
        WHEN regexp_matches(v, '^\\d+$') THEN 'number' END AS format FROM a""",
)
def _(spark, sf):
    e = fx.events(spark, sf)
    value = F.replace(
        F.element_at(F.array(*[F.lit(v) for v in _values]), (F.col("event_id") % 8 + 1).cast("int")),
        F.lit("{n}"), (1000 + F.col("user_id")).cast("string"),
    )
    hint = F.element_at(F.array(*[F.lit(h) for h in _hints]), (F.col("user_id") % 9 + 1).cast("int"))
    attrs = F.create_map(F.lit("type"), F.when(F.col("k") % 10 == 9, "tel").otherwise("text"), F.lit("id"), hint)
    return e.select("event_id", tr.detect_variable(value, attrs).alias("d")).select("event_id", "d.name", "d.format")


def _texts(spark, sf):
    """Documents with an address spliced in."""
    doc = F.col("doc_id").cast("string")
    text = F.concat(
        F.col("text"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" see https://ex.org/p/"), doc, F.lit("?q="), F.repeat(F.lit("z"), 40), F.lit("#end.")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" never go to www.bad.example/x"), doc))
        .otherwise(F.concat(F.lit(" mail a@b.org or shop.example.com/report.pdf"))),
    )
    return fx.table(spark, sf, "documents").select("doc_id", text.alias("text"))


fx.SQL["fx_texts"] = """
SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' see https://ex.org/p/' || doc_id || '?q=' || repeat('z', 40) || '#end.'
  WHEN 1 THEN ' never go to www.bad.example/x' || doc_id ELSE ' mail a@b.org or shop.example.com/report.pdf' END AS text FROM documents"""


@case("fn_24_extract_urls", r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '', 'g') AS t FROM fx_texts),
m AS (SELECT doc_id, list_concat(regexp_extract_all(t, 'https?://[^\s<>"'']+'),
  regexp_extract_all(t, '(?:www\.)?[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*\.[a-zA-Z]{2,}(?:/[^\s<>"'']*)?')) AS l FROM a),
u AS (SELECT doc_id, list_transform(list_transform(l, lambda x: regexp_replace(x, '[.,;:!?()\[\]]+$', '')),
  lambda x: CASE WHEN regexp_matches(x, '^https?://') THEN x ELSE 'https://' || x END) AS l FROM m)
SELECT doc_id, array_to_string(list_sort(list_distinct(l)), ' ') AS urls FROM u""")
def _(spark, sf):
    return _texts(spark, sf).select("doc_id", F.array_join(F.array_sort(tr.extract_urls(F.col("text"))), " ").alias("urls"))


@case("fn_24_single_url")
def _(spark, sf):
    found = _texts(spark, sf).select("doc_id", tr.extract_urls(F.col("text"), guarded=True).alias("guarded"))
    return found.select("doc_id", F.array_join("guarded", " ").alias("guarded_urls"), tr.only_url(F.col("guarded")).alias("only_url"))


_tail = "'?q=' || repeat('z', 40) || '#end.'"


@case(
    "fn_25_shorten_urls",
    f"""SELECT doc_id, url AS original, 'https://ex.org/p/' || doc_id || substr({_tail}, 1, 25) || '...' || substr(md5({_tail}), 1, 7) AS short_url,
      true AS restored FROM (SELECT doc_id, 'https://ex.org/p/' || doc_id || {_tail} AS url FROM documents)""",
)
def _(spark, sf):
    # Every whole text takes part; its address stands at the end, so all other words have to come through unchanged.
    address = F.concat(F.lit("https://ex.org/p/"), F.col("doc_id").cast("string"), F.lit("?q="), F.repeat(F.lit("z"), 40), F.lit("#end."))
    whole = F.concat(F.regexp_replace("text", r"(?i)https?://|www\.", ""), F.lit(" see "), address)
    out, pairs = tr.shorten_urls(F.col("whole"), 25)
    return (
        fx.table(spark, sf, "documents").select("doc_id", whole.alias("whole"))
        .select("doc_id", "whole", out.alias("t"), pairs.alias("pairs"))
        .select("doc_id", "whole", "t", "pairs", F.explode("pairs").alias("p"))
        .select(
            "doc_id", F.col("p.original").alias("original"), F.col("p.short").alias("short_url"),
            (tr.restore_urls(F.col("t"), F.col("pairs")) == F.col("whole")).alias("restored"),
        )
    )


@case(
    "fn_26_strip_think",
    r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(text, E' \t\n\r') ELSE trim(substr(text, 20), E' \t\n\r') END AS answer
        FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^[\s\x{85}\x{a0}\x{2028}]+|[\s\x{85}\x{a0}\x{2028}]+$', '', 'g'), '^', '') AS text FROM documents)""",
)
def _(spark, sf):
    t = tx.strip(F.col("text"))
    noisy = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("<think>plan\n a</think>"), t, F.lit("<think>b</think>"))
    ).otherwise(F.concat(F.substring(t, 1, 19), F.lit("</think>"), F.substr(t, F.lit(20))))
    return fx.table(spark, sf, "documents").select("doc_id", tx.strip_think(noisy).alias("answer"))


SECRETS = [("first", "the"), ("second", "an"), ("unset", "")]


@case(
    "fn_27_mask_secrets",
    "SELECT doc_id, md5(replace(replace(text, 'the', '<secret>first</secret>'), 'an', '<secret>second</secret>')) AS masked FROM documents",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.md5(tr.mask_secrets(F.col("text"), SECRETS)).alias("masked"))


SCOPED = [("*.allowed.example.net", "pass", "P1"), (None, "user", "U1"), ("https://coll.example.uk", "pass", "P2"), (None, "gone", "")]
_unmask_sql = f"""
WITH a AS (SELECT event_id, url, CASE WHEN k % 3 = 0 THEN 'user' ELSE 'say <secret>pass</secret> as <secret>user</secret> <secret>gone</secret>' END AS t,
  CASE WHEN {s_scheme('url')} = 'https' AND {s_host('url')} = 'coll.example.uk' THEN 'P2'
       WHEN {s_scheme('url')} = 'https' AND ({s_host('url')} = 'allowed.example.net' OR ends_with({s_host('url')}, '.allowed.example.net')) THEN 'P1' END AS pass FROM fx_urls)
SELECT event_id, CASE WHEN t = 'user' THEN 'U1' ELSE 'say ' || coalesce(pass, '<secret>pass</secret>') || ' as U1 <secret>gone</secret>' END AS filled,
  CASE WHEN t = 'user' THEN '' WHEN pass IS NULL THEN 'gone,pass' ELSE 'gone' END AS missing FROM a"""


@case("fn_28_unmask_secrets", _unmask_sql)
def _(spark, sf):
    t = F.when(F.col("k") % 3 == 0, "user").otherwise("say <secret>pass</secret> as <secret>user</secret> <secret>gone</secret>")
    return fx.urls(spark, sf).select(
        "event_id",
        tr.unmask_secrets(t, F.col("url"), SCOPED).alias("filled"),
        F.array_join(tr.missing_secrets(t, F.col("url"), SCOPED), ",").alias("missing"),
    )


@case(
    "fn_29_substitute_variables",
    """SELECT run, pos, replace(replace(params, '"https://h/1"', '"https://new/$1"'), '" T1"', '"typed"') AS params FROM fx_actions""",
)
def _(spark, sf):
    new = tr.substitute_values(F.col("params"), [("https://h/1", "https://new/$1"), (" T1", "typed"), ("url", "never")])
    return fx.actions(spark, sf).select("run", "pos", new.alias("params"))


@case(
    "fn_30_format_tokens",
    """SELECT event_id, CASE WHEN n >= 1000000000 THEN printf('%.1fB', n / 1000000000) WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000)
       WHEN n >= 1000 THEN printf('%.1fk', n / 1000) ELSE CAST(n AS VARCHAR) END AS shown
       FROM (SELECT event_id, CAST(k AS BIGINT) * k * k * CAST(10 ** (event_id % 5) AS BIGINT) + 7 AS n FROM fx_events)""",
)
def _(spark, sf):
    k = F.col("k")
    n = k * k * k * F.element_at(F.array(*[F.lit(10**i).cast("bigint") for i in range(5)]), (F.col("event_id") % 5 + 1).cast("int")) + 7
    return fx.events(spark, sf).select("event_id", tx.format_tokens(n).alias("shown"))


@case(
    "fn_31_truncate",
    r"""SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 100) || '......' || right(text, 100) ELSE text END AS err,
      CASE WHEN length(text) > 300 THEN substr(text, 1, 277) || '...[text truncated]...' ELSE text END AS head,
      CASE WHEN length(text) > 300 THEN '...[text truncated]' || right(text, 277) ELSE text END AS tail,
      md5(CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || chr(10) || '[... truncated ' || (length(text) - 1000) || ' characters for history]'
        ELSE text END) AS history FROM documents""",
)
def _(spark, sf):
    t = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id", tx.truncate_error(t).alias("err"), tx.truncate_head(t, 300).alias("head"),
        tx.truncate_tail(t, 300).alias("tail"), F.md5(tx.truncate_history(t, 1000)).alias("history"),
    )


@case(
    "fn_34_clean_markdown",
    r"""WITH a AS (SELECT doc_id, text || chr(10) || chr(10) || chr(10) || chr(10) || '   ' || chr(10) || 'a%20b `{"k": 1}` end'
        || chr(10) || '[' || repeat('x', 120) AS t FROM documents),
      b AS (SELECT doc_id, length(t) AS n, regexp_replace(regexp_replace(t, '%[0-9A-Fa-f]{2}', '', 'g'), '(?s)`\{["\w].*?\}`', '', 'g') AS t FROM a),
      c AS (SELECT doc_id, n, array_to_string(list_filter(string_split(regexp_replace(t, '\n{4,}', E'\n\n\n', 'g'), chr(10)),
          lambda l: regexp_matches(l, '[^\s]') AND NOT (regexp_matches(l, '^\s*[{\[]') AND length(trim(l)) > 100)), chr(10)) AS t FROM b)
      SELECT doc_id, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS cleaned, n - length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS removed FROM c""",
)
def _(spark, sf):
    t = F.concat(F.col("text"), F.lit("\n\n\n\n   \na%20b `{\"k\": 1}` end\n["), F.repeat(F.lit("x"), 120))
    out = tx.clean_markdown(t)
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.md5(out).alias("cleaned"), (F.length(t) - F.length(out)).cast("bigint").alias("removed")
    )


@case("fn_35_drop_surrogates", "SELECT doc_id, md5(text) AS h FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.md5(tx.drop_surrogates(F.col("text"))).alias("h"))


@case(
    "fn_36_degenerate_output",
    """SELECT doc_id, doc_id % 11 = 0 OR (n_chars / (n_chars + 1000)) >= 0.9 OR (length(t) >= 6 AND
       (length(t) - length(replace(t, right(t, 6), ''))) / 6 >= 40) AS bad
       FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 7 = 0 THEN text || repeat('loop ! ', 50) ELSE text END AS t FROM documents)""",
)
def _(spark, sf):
    t = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.repeat(F.lit("loop ! "), 50))).otherwise(F.col("text"))
    bad = tx.degenerate_output(t, F.col("n_chars"), F.col("n_chars") + 1000, F.when(F.col("doc_id") % 11 == 0, "max_tokens"))
    return fx.table(spark, sf, "documents").select("doc_id", bad.alias("bad"))


@case(
    "fn_39_scroll_metrics",
    """WITH a AS (SELECT event_id, CAST(k * 13 AS DOUBLE) AS t, CAST(k AS DOUBLE) AS l, CAST(user_id * 10 AS DOUBLE) AS h, CAST(user_id AS DOUBLE) AS w,
         CAST(event_id % 800 AS DOUBLE) AS vh, CAST(event_id % 60 AS DOUBLE) AS vw FROM fx_events)
       SELECT event_id, t AS content_above, greatest(0.0, h - vh - t) AS content_below, l AS content_left, greatest(0.0, w - vw - l) AS content_right,
         round_even(CASE WHEN h > vh THEN t / (h - vh) * 100 ELSE 0 END, 1) AS vertical_pct,
         round_even(CASE WHEN w > vw THEN l / (w - vw) * 100 ELSE 0 END, 1) AS horizontal_pct,
         round_even(CASE WHEN vh > 0 THEN t / vh ELSE 0 END, 1) AS pages_above,
         round_even(CASE WHEN vh > 0 THEN greatest(0.0, h - vh - t) / vh ELSE 0 END, 1) AS pages_below,
         round_even(CASE WHEN vh > 0 THEN h / vh ELSE 1 END, 1) AS total_pages FROM a""",
)
def _(spark, sf):
    d = lambda c: c.cast("double")
    m = el.scroll_metrics(
        d(F.col("k") * 13), d(F.col("k")), d(F.col("user_id") * 10), d(F.col("user_id")),
        d(F.col("event_id") % 800), d(F.col("event_id") % 60),
    )
    return fx.events(spark, sf).select("event_id", *[c.alias(n) for n, c in m.items()])


_proto = ["h2", "http/1.1", "HTTP/2", "http/1.0", "quic", "h3"]


@case(
    "fn_40_http_fields",
    f"""SELECT event_id, list_extract(['HTTP/2.0', 'HTTP/1.1', 'HTTP/2.0', 'HTTP/1.0', 'QUIC', 'H3'], k % 6 + 1) AS protocol,
      CASE WHEN contains(url, '://') THEN 'https://' || regexp_extract(url, '^.*?://([^/]*)', 1) ELSE '' END AS origin,
      length('GET ' || url || ' HTTP/1.1') + 2 + length('accept') + 3 + 4 + length('x-k') + length(CAST(k AS VARCHAR)) + 4 + 2 AS header_bytes,
      CASE WHEN k % 4 = 0 THEN k WHEN k % 4 = 1 THEN length(event_type) WHEN k % 4 = 2 THEN 0 ELSE -1 END AS body_bytes
      FROM fx_urls""",
)
def _(spark, sf):
    k = F.col("k")
    raw = F.element_at(F.array(*[F.lit(p) for p in _proto]), (k % 6 + 1).cast("int"))
    headers = F.create_map(F.lit("accept"), F.lit("*/*"), F.lit("x-k"), k.cast("string"))
    body = u.request_body_size(
        F.when(k % 4 == 2, "head").otherwise("POST"),
        F.when(k % 4 == 0, k.cast("string")),
        F.when(k % 4 == 1, F.col("event_type")),
    )
    return fx.urls(spark, sf).select(
        "event_id", u.http_protocol(raw).alias("protocol"), u.origin(F.col("url")).alias("origin"),
        u.headers_size(F.lit("GET"), F.col("url"), headers).cast("bigint").alias("header_bytes"), body.alias("body_bytes"),
    )


@case(
    "fn_41_literal_pattern",
    """SELECT event_id, list_count(list_filter(range(1, length(url) + 1), lambda i: substr(url, i, 2) = '.e')) AS hits,
         contains(url, '?q=') AS found FROM fx_urls""",
)
def _(spark, sf):
    return fx.urls(spark, sf).select(
        "event_id",
        F.regexp_count(F.col("url"), tx.escape_regex(F.lit(".e"))).cast("bigint").alias("hits"),
        F.rlike(F.col("url"), tx.escape_regex(F.lit("?q="))).alias("found"),
    )


@case(
    "fn_42_budget_ratio",
    """SELECT run, pos, step, CAST(step * 100 // steps AS BIGINT) AS pct, steps - step AS left_over
       FROM fx_steps WHERE step / steps >= 0.75 AND step - 1 < steps - 1""",
)
def _(spark, sf):
    from trailsift.operators import history as hi

    steps = hi.number_steps(fx.actions(spark, sf), "run", "pos")
    total = steps.groupBy("run").agg(F.count("*").alias("steps"))
    warn, pct, left = tr.budget_used(F.col("step") - 1, F.col("steps"))
    return steps.join(total, "run").where(warn).select("run", "pos", "step", pct.alias("pct"), left.alias("left_over"))


@case(
    "fn_44_time_text",
    r"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso,
       CASE WHEN k % 2 = 0 THEN epoch_us(ts) // 1000000 ELSE 0 END AS epoch FROM fx_events""",
)
def _(spark, sf):
    text = F.when(F.col("k") % 2 == 0, tx.iso_utc(F.col("ts"))).otherwise("not a time")
    return fx.events(spark, sf).select(
        "event_id",
        tx.iso_utc(F.col("ts")).alias("iso"),
        F.unix_seconds(tx.parse_time_or(text, F.timestamp_seconds(F.lit(0)))).alias("epoch"),
    )
