"""Inputs derived from the driver tables: a DataFrame builder and a SQL twin for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailsift.plans.lookup import spread

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # Texts are costly per row; a small file is one split and would keep one core busy.
    return spread(df) if name == "documents" else df


def events(spark: SparkSession, sf: str) -> DataFrame:
    """events with ``k`` taken out of ``props`` and ``ts`` as an instant."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


SQL["fx_events"] = r"""
SELECT event_id, ts, user_id, event_type, value,
       CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT) AS k
FROM events"""


def _s(column) -> F.Column:
    return column.cast("string")


def records(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    item = F.md5(_s(F.col("user_id")))
    page_url = F.concat(
        F.lit("https://site"), _s(F.col("user_id") % 5), F.lit(".example.org/collection/"), item, F.lit("/")
    )
    title = F.concat(F.lit("item_"), _s(F.col("event_id")), F.lit("_"), F.col("event_type"))
    return e.select(
        F.col("event_id").alias("pos"),
        (F.col("event_id") + 1).alias("sequence"),
        F.when(F.col("event_type") == "error", "failed").otherwise("downloaded").alias("status"),
        item.alias("item"),
        page_url.alias("page_url"),
        F.concat(page_url, F.lit("img/"), _s(F.col("k")), F.lit("/full/max/0/default.jpg")).alias("image_url"),
        F.sha2(_s(F.col("k") * 100 + F.col("user_id") % 7), 256).alias("sha256"),
        title.alias("title"),
        F.concat(title, F.lit(".jpg")).alias("file_name"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("file_size"),
        F.when(F.col("event_id") % 11 != 0, F.col("user_id") % 20 + 1).alias("source_page"),
        F.col("ts").alias("recorded_at"),
        F.concat(F.lit("kind: "), F.col("event_type"), F.lit("; k: "), _s(F.col("k"))).alias("metadata"),
    )


SQL["fx_records"] = r"""
SELECT event_id AS pos, event_id + 1 AS sequence,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'downloaded' END AS status,
       md5(CAST(user_id AS VARCHAR)) AS item,
       'https://site' || (user_id % 5) || '.example.org/collection/' || md5(CAST(user_id AS VARCHAR)) || '/' AS page_url,
       'https://site' || (user_id % 5) || '.example.org/collection/' || md5(CAST(user_id AS VARCHAR)) || '/img/' || k
         || '/full/max/0/default.jpg' AS image_url,
       sha256(CAST(k * 100 + user_id % 7 AS VARCHAR)) AS sha256,
       'item_' || event_id || '_' || event_type AS title,
       'item_' || event_id || '_' || event_type || '.jpg' AS file_name,
       CAST(floor(value * 1000) AS BIGINT) AS file_size,
       CASE WHEN event_id % 11 <> 0 THEN user_id % 20 + 1 END AS source_page,
       ts AS recorded_at,
       'kind: ' || event_type || '; k: ' || k AS metadata
FROM fx_events"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory: some record files missing, some altered, plus files of no record."""
    e = events(spark, sf)
    title = F.concat(F.lit("item_"), _s(F.col("event_id")), F.lit("_"), F.col("event_type"), F.lit(".jpg"))
    altered = F.sha2(F.concat(_s(F.col("event_id")), F.lit("x")), 256)
    size = F.floor(F.col("value") * 1000).cast("bigint")
    shape = [size.alias("file_size"), (200 + F.col("k")).alias("width"), (150 + 2 * F.col("k")).alias("height")]
    of_records = e.where("event_id % 10 <> 3").select(
        title.alias("file_name"),
        F.when(F.col("event_id") % 13 == 0, altered)
        .otherwise(F.sha2(_s(F.col("k") * 100 + F.col("user_id") % 7), 256))
        .alias("sha256"),
        *shape,
    )
    strays = e.where("event_id % 17 = 0").select(
        F.concat(F.lit("orphan_"), _s(F.col("event_id")), F.lit(".png")).alias("file_name"),
        F.sha2(F.concat(F.lit("orphan"), _s(F.col("event_id") % 34)), 256).alias("sha256"),
        *shape,
    )
    return of_records.unionByName(strays)


SQL["fx_files"] = r"""
SELECT 'item_' || event_id || '_' || event_type || '.jpg' AS file_name,
       CASE WHEN event_id % 13 = 0 THEN sha256(event_id || 'x')
            ELSE sha256(CAST(k * 100 + user_id % 7 AS VARCHAR)) END AS sha256,
       CAST(floor(value * 1000) AS BIGINT) AS file_size, 200 + k AS width, 150 + 2 * k AS height
FROM fx_events WHERE event_id % 10 <> 3
UNION ALL
SELECT 'orphan_' || event_id || '.png', sha256('orphan' || (event_id % 34)),
       CAST(floor(value * 1000) AS BIGINT), 200 + k, 150 + 2 * k
FROM fx_events WHERE event_id % 17 = 0"""


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(already recorded, incoming batch): split at half of the largest position."""
    r = records(spark, sf)
    middle = r.agg((F.max("pos") / 2).alias("middle")).scalar()
    return r.where(F.col("pos") < middle), r.where(F.col("pos") >= middle)


SQL["fx_existing"] = "SELECT * FROM fx_records WHERE pos < (SELECT max(pos) / 2 FROM fx_records)"
SQL["fx_incoming"] = "SELECT * FROM fx_records WHERE pos >= (SELECT max(pos) / 2 FROM fx_records)"


def queue(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    status = (
        F.when(F.col("event_type") == "click", "pending")
        .when(F.col("event_type") == "view", "in_progress")
        .when(F.col("event_type") == "purchase", "downloaded")
        .when(F.col("event_type") == "signup", "skipped")
        .otherwise("failed")
    )
    return e.select(
        (F.col("event_id") % 2).alias("file"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("https://site/item/"), _s(F.col("user_id") * 10 + F.col("k") % 10)).alias("url"),
        F.concat(F.lit("Temple  view "), _s(F.col("k"))).alias("title"),
        status.alias("status"),
        F.when(status.isin("failed", "pending"), F.concat(F.lit("e"), _s(F.col("k")))).alias("error"),
    )


SQL["fx_queue"] = r"""
SELECT event_id % 2 AS file, event_id AS pos, 'https://site/item/' || (user_id * 10 + k % 10) AS url,
       'Temple  view ' || k AS title,
       CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'downloaded'
            WHEN 'signup' THEN 'skipped' ELSE 'failed' END AS status,
       CASE WHEN event_type NOT IN ('view', 'purchase', 'signup') THEN 'e' || k END AS error
FROM fx_events"""


def batches(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.select(
        (F.col("user_id") % 20 + 1).alias("page"),
        F.col("event_id").alias("pos"),
        (F.col("event_id") % 40).alias("start_index"),
        F.lit(5).cast("bigint").alias("processed"),
        (F.col("k") % 6).alias("downloaded"),
        (F.col("k") % 4 + F.col("k") % 3).alias("skipped"),
        (F.col("k") % 3).alias("errors"),
        F.lit(40).cast("bigint").alias("total_found"),
    )


SQL["fx_batches"] = r"""
SELECT user_id % 20 + 1 AS page, event_id AS pos, event_id % 40 AS start_index, CAST(5 AS BIGINT) AS processed,
       k % 6 AS downloaded, k % 4 + k % 3 AS skipped, k % 3 AS errors, CAST(40 AS BIGINT) AS total_found
FROM fx_events"""


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """One action per event; ``run`` is the user and ``pos`` the order within it."""
    e = events(spark, sf)
    t = F.col("event_type")
    k = F.col("k")
    name = (
        F.when(t == "click", "click")
        .when(t == "view", "navigate")
        .when(t == "purchase", "input")
        .when(t == "signup", "search")
        .otherwise("wait")
    )
    params = (
        F.when(t == "click", F.to_json(F.struct((k % 6).alias("index"))))
        .when(t == "view", F.to_json(F.struct(F.concat(F.lit("https://h/"), _s(k % 3)).alias("url"))))
        .when(t == "purchase", F.to_json(F.struct((k % 6).alias("index"), F.concat(F.lit(" T"), _s(k % 2)).alias("text"))))
        .when(t == "signup", F.to_json(F.struct(F.concat(F.lit("Old Temple, "), _s(k % 2), F.lit(" old")).alias("query"))))
        .otherwise(F.to_json(F.struct((k % 3).alias("seconds"))))
    )
    return e.select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("pos"),
        F.col("ts"),
        name.alias("name"),
        params.alias("params"),
        F.when(t == "error", F.concat(F.lit("failed "), _s(k))).alias("error"),
        (F.col("value") / 1000).alias("seconds"),
        F.concat(F.lit("https://h/"), _s(k % 3)).alias("url"),
        _s(k % 2).alias("dom_text"),
        (k % 2 + 1).alias("element_count"),
        k,
    )


SQL["fx_actions"] = r"""
SELECT user_id AS run, event_id AS pos, ts,
       CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'navigate' WHEN 'purchase' THEN 'input'
            WHEN 'signup' THEN 'search' ELSE 'wait' END AS name,
       CASE event_type WHEN 'click' THEN '{"index":' || (k % 6) || '}'
            WHEN 'view' THEN '{"url":"https://h/' || (k % 3) || '"}'
            WHEN 'purchase' THEN '{"index":' || (k % 6) || ',"text":" T' || (k % 2) || '"}'
            WHEN 'signup' THEN '{"query":"Old Temple, ' || (k % 2) || ' old"}'
            ELSE '{"seconds":' || (k % 3) || '}' END AS params,
       CASE WHEN event_type = 'error' THEN 'failed ' || k END AS error,
       value / 1000 AS seconds,
       'https://h/' || (k % 3) AS url, CAST(k % 2 AS VARCHAR) AS dom_text, k % 2 + 1 AS element_count, k
FROM fx_events"""
SQL["fx_steps"] = r"""
SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) AS step, count(*) OVER (PARTITION BY run) AS steps
FROM fx_actions"""


def usage(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    n = F.length("text").cast("bigint")
    return c.select(
        F.when(F.col("conv_id") % 4 == 0, "small")
        .when(F.col("conv_id") % 4 == 1, "premium")
        .when(F.col("conv_id") % 4 == 2, "smart")
        .otherwise("unknown")
        .alias("model"),
        F.col("conv_id"),
        F.col("turn"),
        (F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60 + F.col("conv_id"))).alias("ts"),
        (n + 100).alias("prompt_tokens"),
        F.when(F.col("conv_id") % 2 == 0, F.floor((n + 100) / 2).cast("bigint")).alias("cached_tokens"),
        F.when(F.col("conv_id") % 5 == 0, F.lit(10).cast("bigint")).alias("creation_tokens"),
        (F.floor(n / 4).cast("bigint") + 1).alias("completion_tokens"),
    )


SQL["fx_usage"] = r"""
SELECT CASE conv_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'premium' WHEN 2 THEN 'smart' ELSE 'unknown' END AS model,
       conv_id, turn, 1704067200 + turn * 60 + conv_id AS epoch,
       length(text) + 100 AS prompt_tokens,
       CASE WHEN conv_id % 2 = 0 THEN (length(text) + 100) // 2 END AS cached_tokens,
       CASE WHEN conv_id % 5 = 0 THEN CAST(10 AS BIGINT) END AS creation_tokens,
       length(text) // 4 + 1 AS completion_tokens
FROM conversations WHERE role = 'assistant'"""

# Token prices in dollars per token of the two published models and
# their alias, and one row standing for the public price list.
PRICES = [
    ("small", "custom", 0.2e-6, 2.0e-6, 0.02e-6, None),
    ("premium", "custom", 0.6e-6, 3.5e-6, 0.06e-6, None),
    ("small", "list", 9.0e-6, 9.0e-6, 9.0e-6, 9.0e-6),
    ("list-smart", "list", 0.2e-6, 2.0e-6, 0.02e-6, 0.25e-6),
]
ALIASES = [("smart", "list-smart")]
PRICE_SCHEMA = "model string, origin string, input double, output double, cache_read double, cache_creation double"


def pricing(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame(PRICES, PRICE_SCHEMA),
        spark.createDataFrame(ALIASES, "model string, listed string"),
    )


SQL["fx_prices"] = r"""
SELECT * FROM (VALUES ('small', CAST(0.2e-6 AS DOUBLE), CAST(2.0e-6 AS DOUBLE), CAST(0.02e-6 AS DOUBLE), CAST(NULL AS DOUBLE)),
  ('premium', 0.6e-6, 3.5e-6, 0.06e-6, NULL), ('smart', 0.2e-6, 2.0e-6, 0.02e-6, 0.25e-6))
  t(model, input, output, cache_read, cache_creation)"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Element trees of 32 nodes: event ``i`` of a block of 32 hangs below event ``(i+1)//2``.

    Columns are those of the node table that the page parser gives, plus geometry.
    """
    e = events(spark, sf)
    n = F.col("event_id")
    local = n % 32 + 1
    page = F.floor(n / 32).cast("bigint")
    up = [F.floor(local / (1 << i)).cast("bigint") for i in range(1, 6)]
    anc = F.filter(F.array(*[F.when(u >= 1, page * 32 + u - 1) for u in reversed(up)]), lambda x: x.isNotNull())
    tag = F.element_at(
        F.array(*[F.lit(t) for t in ("div", "a", "button", "span", "input", "li", "label", "p")]),
        (F.col("k") % 8 + 1).cast("int"),
    )
    base = e.select(
        page.alias("page_id"),
        n.alias("node_id"),
        F.when(local > 1, page * 32 + up[0] - 1).alias("parent_id"),
        (n % 32).alias("ord"),
        anc.alias("anc_ids"),
        F.size(anc).cast("bigint").alias("depth"),
        F.when(local == 1, "html").otherwise(tag).alias("tag"),
        F.concat_ws(" ", F.concat(F.lit("c"), _s(F.col("user_id") % 7)), F.when(F.col("k") % 3 == 0, "is-active"), F.lit("box")).alias("class"),
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("n"), _s(n))).alias("id"),
        F.when(F.col("k") % 7 == 0, "button").alias("role"),
        F.when(F.col("k") % 6 == 0, F.concat(F.lit("name"), _s(F.col("user_id")))).alias("name"),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("ax"), _s(F.col("user_id") % 50))).alias("ax_name"),
        F.concat(F.col("event_type"), _s(F.col("k"))).alias("text"),
        ((n * 37) % 1200).cast("double").alias("x"),
        ((n * 53) % 4000).cast("double").alias("y"),
        (20 + n % 300).cast("double").alias("w"),
        (10 + n % 80).cast("double").alias("h"),
        (n % 50).alias("paint_order"),
        F.when(n % 7 == 3, 0.5).otherwise(1.0).alias("opacity"),
        F.when(n % 7 == 5, "none").otherwise("block").alias("display"),
        F.col("k"),
    )
    pairs = [x for n in ("class", "id", "role", "name") for x in (F.lit(n), F.col(n))]
    return base.withColumn("attrs", F.map_filter(F.create_map(*pairs), lambda name, v: v.isNotNull()))


SQL["fx_nodes"] = r"""
SELECT event_id // 32 AS page_id, event_id AS node_id,
       CASE WHEN event_id % 32 > 0 THEN event_id // 32 * 32 + (event_id % 32 + 1) // 2 - 1 END AS parent_id,
       event_id % 32 AS ord,
       CASE WHEN event_id % 32 = 0 THEN 'html' ELSE
         list_extract(['div', 'a', 'button', 'span', 'input', 'li', 'label', 'p'], k % 8 + 1) END AS tag,
       'c' || (user_id % 7) || CASE WHEN k % 3 = 0 THEN ' is-active' ELSE '' END || ' box' AS class,
       CASE WHEN k % 5 = 0 THEN 'n' || event_id END AS id,
       CASE WHEN k % 7 = 0 THEN 'button' END AS role,
       CASE WHEN k % 6 = 0 THEN 'name' || user_id END AS name,
       CASE WHEN k % 4 = 0 THEN 'ax' || (user_id % 50) END AS ax_name,
       event_type || k AS text,
       CAST((event_id * 37) % 1200 AS DOUBLE) AS x, CAST((event_id * 53) % 4000 AS DOUBLE) AS y,
       CAST(20 + event_id % 300 AS DOUBLE) AS w, CAST(10 + event_id % 80 AS DOUBLE) AS h,
       event_id % 50 AS paint_order,
       CASE WHEN event_id % 7 = 3 THEN 0.5 ELSE 1.0 END AS opacity,
       CASE WHEN event_id % 7 = 5 THEN 'none' ELSE 'block' END AS display, k,
       (event_id % 32 + 1) AS heap
FROM fx_events"""
# Every (node, proper ancestor) pair of the heap-shaped trees; distance 1 is the parent.
SQL["fx_ancestors"] = r"""
SELECT page_id, node_id, page_id * 32 + (heap >> d) - 1 AS anc_id, d AS distance
FROM fx_nodes, (VALUES (1), (2), (3), (4), (5)) t(d) WHERE (heap >> d) >= 1"""


def network(spark: SparkSession, sf: str) -> DataFrame:
    """Raw network events, several per request, times in seconds."""
    e = events(spark, sf)
    at = F.unix_micros("ts") / 1e6
    lag = F.col("value") / 1000
    kind = F.col("event_type")
    rid = F.concat(F.lit("r"), _s(F.col("event_id")))
    url = F.concat(
        F.when(F.col("k") % 5 > 0, "https").otherwise("http"),
        F.lit("://h"), _s(F.col("user_id") % 11), F.lit(".example.org/"),
        F.when(F.col("k") % 10 == 4, "favicon.ico").otherwise(F.concat(F.lit("p/"), _s(F.col("k")))),
    )
    doc = F.col("k") % 9 == 0
    frame = F.concat(F.lit("f"), _s(F.col("user_id")))
    none = F.lit(None)
    e = e.select("*", at.alias("at"), lag.alias("lag"), rid.alias("request_id"), url.alias("u"), frame.alias("f"))

    # The arrival order: the events of one request follow each other.
    stages = ["early", "requestWillBeSent", "responseReceived", "dataReceived", "loadingFinished", "loadingFailed", "DOMContentLoaded", "load"]

    def part(where, event, t, url=none, type_=none, size=none, name=none, request=True, stage=None):
        return e.where(where).select(
            F.lit(event).alias("event"),
            (F.col("request_id") if request else none.cast("string")).alias("request_id"),
            F.col("f").alias("frame_id"),
            t.alias("at"),
            url.cast("string").alias("url"),
            type_.cast("string").alias("type"),
            size.cast("bigint").alias("size"),
            name.cast("string").alias("name"),
            (F.col("event_id") * 8 + stages.index(stage or event)).alias("pos"),
        )

    finished = kind.isin("click", "purchase", "view")
    return (
        part(F.lit(True), "requestWillBeSent", F.col("at"), F.col("u"), F.when(doc, "Document").otherwise("Image"))
        # Bytes of a request that was not seen yet do not count.
        .unionByName(part(F.col("k") % 4 == 0, "dataReceived", F.col("at"), size=F.lit(1000), stage="early"))
        .unionByName(part(kind != "signup", "responseReceived", F.col("at") + F.col("lag"), size=F.col("k") * 10))
        .unionByName(part(finished, "dataReceived", F.col("at") + F.col("lag"), size=F.col("k")))
        .unionByName(part(finished, "loadingFinished", F.col("at") + 2 * F.col("lag"), size=F.col("k") * 7))
        .unionByName(part(kind == "error", "loadingFailed", F.col("at") + F.col("lag"), name=F.lit("net::ERR")))
        .unionByName(part(doc, "lifecycleEvent", F.col("at") + 0.25, name=F.lit("DOMContentLoaded"), request=False, stage="DOMContentLoaded"))
        .unionByName(part(doc, "lifecycleEvent", F.col("at") + 0.5, name=F.lit("load"), request=False, stage="load"))
    )


SQL["fx_requests"] = r"""
SELECT 'r' || event_id AS request_id, 'f' || user_id AS frame_id, event_id AS pos, event_type, k,
       epoch_us(ts) / 1e6 AS sent, value / 1000 AS lag, k % 9 = 0 AS is_doc,
       CASE WHEN k % 5 > 0 THEN 'https' ELSE 'http' END || '://h' || (user_id % 11) || '.example.org/'
         || CASE WHEN k % 10 = 4 THEN 'favicon.ico' ELSE 'p/' || k END AS url
FROM fx_events"""

# Address shapes of crawled data; {n} is the user, {h} a 32-digit hex id.
URL_SHAPES = [
    "https://coll.example.uk/collection/{h}/",
    "  `https://COLL.example.uk/collection/{h}/?x=1#top`.,  ",
    "https://data.example.uk/iiif/3/manifest/{h}/",
    "https://data.example.uk/iiif/3/{h}/canvas/1",
    "https://coll.example.uk/collection/",
    "https://coll.example.uk/collection/search?q=temple&page={n}",
    "http://User{n}:pw@WWW.Shop.example.com:8080/Item/{n}/?b=2#f",
    "https://data.example.uk/image/iiif/3/{h}",
    "https://data.example.uk/image/iiif/2/{h}/full/max/0/default.jpg",
    "https://data.example.uk/image/iiif/3/{h}/full/!200,200/0/thumb.png",
    "http://10.0.{n}.1/a.png",
    "http://192.168.1.{n}/x/small.jpg",
    "http://8.8.4.{n}/img/Photo-L.jpg?size=2",
    "https://sub.allowed.example.net/p/{n}/view.html",
    "data:image/png;base64,AAAA{n}",
    "about:blank",
    "https://search.example.org/results?q=old+temple%20{n}&page={n}&limit=500",
    "https://search.example.org/results/?q=&page=abc",
    "//cdn.example.org/lib/{n}.js",
    "not a url {n}",
    "https://www.library.example.gov/item/{n}/resource/?st=gallery",
    "https://gallery.local/pic{n}.webp",
    "https://allowed.example.net/download/original.tif",
    "",
]


def urls(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    shape = F.element_at(F.array(*[F.lit(s) for s in URL_SHAPES]), (F.col("event_id") % len(URL_SHAPES) + 1).cast("int"))
    url = F.replace(F.replace(shape, F.lit("{n}"), _s(F.col("user_id"))), F.lit("{h}"), F.md5(_s(F.col("user_id"))))
    return e.select("event_id", url.alias("url"), "user_id", "k", "event_type", "value")


_shapes = ", ".join("'" + s + "'" for s in URL_SHAPES)
SQL["fx_urls"] = f"""
SELECT event_id, replace(replace(list_extract([{_shapes}], event_id % {len(URL_SHAPES)} + 1), '{{n}}', CAST(user_id AS VARCHAR)),
       '{{h}}', md5(CAST(user_id AS VARCHAR))) AS url, user_id, k, event_type, value
FROM fx_events"""
