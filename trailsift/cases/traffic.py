"""Rules, network events, files on disk, streams and registered functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from trailsift.cases import fixtures as fx
from trailsift.cases.base import case
from trailsift.cases.scalars import s_clean, s_host, s_part, s_scheme
from trailsift.functions import registry as rg
from trailsift.functions import tables as tb
from trailsift.functions import urls as u
from trailsift.operators import catalog as ca
from trailsift.operators import network as nw
from trailsift.operators import reconcile as rc
from trailsift.operators import rules as ru
from trailsift.sources import records as sr
from trailsift.sources import sinks
from trailsift.sources.tables import VersionedTable, case_path, foldered, read_or_empty
from trailsift.streaming import keyed
from trailsift.streaming import streams as st

URL = "url"

# ---- rules -----------------------------------------------------------------------------------

RULES = ["*.allowed.example.net", "library.example.gov", "https://coll.example.uk/collection/", "http://*.local/*", "data.*.uk", "shop.example.com", "http*://8.8.*"]
_h, _s = s_host("url"), s_scheme("url")
_RULE_SQL = f"""((({_s}) IN ('http', 'https') AND ({_h} = 'allowed.example.net' OR ends_with({_h}, '.allowed.example.net')))
 OR {_h} = 'library.example.gov' OR starts_with(url, 'https://coll.example.uk/collection/') OR regexp_matches(url, '^http://.*\\.local/.*$')
 OR regexp_matches({_h}, '^data\\..*\\.uk$') OR {_h} = 'shop.example.com' OR regexp_matches({_s} || '://' || {_h}, '^http.*://8\\.8\\..*$'))"""


@case("fil_4_rule_match", f"SELECT event_id, url, {_RULE_SQL} AS matched FROM fx_urls")
def _(spark, sf):
    return fx.urls(spark, sf).select("event_id", URL, u.rules_match(F.col(URL), RULES).alias("matched"))


@case("j_14_apply_rules", f"SELECT event_id, {_RULE_SQL} OR {_h} = 'www.sole.org' AS matched FROM fx_urls")
def _(spark, sf):
    return ru.apply_rules(fx.urls(spark, sf), [*RULES, "sole.org"]).select("event_id", "matched")


_octets = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
_head = f"CASE WHEN url = 'about:blank' THEN true WHEN {_s} IN ('data', 'blob') THEN true WHEN {_h} = '' THEN false"


@case("fil_3_url_policy", f"""SELECT event_id, {_head} WHEN regexp_matches({_h}, '{_octets}') THEN false ELSE {_RULE_SQL} END AS allow_list,
  {_head} ELSE NOT {_RULE_SQL} END AS deny_list, {_head} ELSE true END AS no_list FROM fx_urls""")
def _(spark, sf):
    c = F.col(URL)
    return fx.urls(spark, sf).select(
        "event_id", ru.policy(c, allow=RULES, block_ip=True).alias("allow_list"), ru.policy(c, deny=RULES).alias("deny_list"),
        ru.policy(c).alias("no_list"),
    )


@case("fil_3_url_policy_sets", f"""SELECT event_id, {_head} ELSE {_h} IN ('library.example.gov', 'www.library.example.gov', 'www.shop.example.com', 'shop.example.com', '8.8.4.3') END AS allowed FROM fx_urls""")
def _(spark, sf):
    hosts = spark.createDataFrame([("library.example.gov",), ("www.shop.example.com",), ("8.8.4.3",)], "host string")
    return ru.policy_by_sets(fx.urls(spark, sf), hosts, allowing=True).select("event_id", "allowed")


@case("fil_5_domain_pattern", f"""SELECT event_id, {_s} = 'https' AND ({_h} = 'allowed.example.net' OR ends_with({_h}, '.allowed.example.net')) AS below,
  {_s} = 'https' AND {_h} = 'coll.example.uk' AS exact, {_s} IN ('http', 'https') AND {_h} <> '' AS any_web, false AS unsafe FROM fx_urls""")
def _(spark, sf):
    c = F.col(URL)
    return fx.urls(spark, sf).select(
        "event_id", u.domain_pattern_match(c, "*.allowed.example.net").alias("below"),
        u.domain_pattern_match(c, "COLL.example.uk:443").alias("exact"), u.domain_pattern_match(c, "http*://*").alias("any_web"),
        (u.domain_pattern_match(c, "*.*.example.net") | u.domain_pattern_match(c, "example.*") | u.domain_pattern_match(c, "ex*mple.org")).alias("unsafe"),
    )


_c, _ch = s_clean("url"), s_host(s_clean("url"))


@case("j_15_site_dispatch", f"""SELECT event_id, CASE WHEN {_ch} = 'data.example.uk' THEN 'data' WHEN {_ch} = 'example.uk' OR ends_with({_ch}, '.example.uk') THEN 'uk'
  WHEN {_ch} = 'example.org' OR ends_with({_ch}, '.example.org') THEN 'org' END AS hint FROM fx_urls""")
def _(spark, sf):
    hints = spark.createDataFrame(
        [("coll.example.uk", 0, ""), ("data.example.uk", 1, "data"), ("example.uk", 2, "uk"), ("example.org", 3, "org")], "host string, ord int, result string"
    )
    return ru.site_dispatch(fx.urls(spark, sf), hints).select("event_id", "hint")


@case("j_12_merge_state", """
WITH o AS (SELECT user_id % 40 AS name, user_id % 3 AS place, arg_max(k, event_id) AS v FROM fx_events WHERE event_id % 2 = 0 GROUP BY ALL),
n AS (SELECT user_id % 60 AS name, user_id % 3 AS place, arg_max(k, event_id) AS v FROM fx_events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(o.name, n.name) AS name, coalesce(o.place, n.place) AS place, coalesce(n.v, o.v) AS value FROM o FULL JOIN n ON o.name = n.name AND o.place = n.place""")
def _(spark, sf):
    e = fx.events(spark, sf)

    def cookies(parity, by):
        place = (F.col("user_id") % 3).alias("place")
        return e.where(F.col("event_id") % 2 == parity).select((F.col("user_id") % by).alias("name"), place, F.col("k").alias("value"), "event_id")

    return ca.merge_state(cookies(0, 40), cookies(1, 60), ["name", "place"], "event_id")


@case("j_12_merge_origins", """
WITH e AS (SELECT 'https://h' || (user_id % 7) AS origin, 'key' || (k % 20) AS name, event_id, value FROM fx_events)
SELECT origin, name, coalesce(arg_max(value, event_id) FILTER (WHERE event_id % 3 > 0), arg_max(value, event_id)) AS value FROM e GROUP BY origin, name""")
def _(spark, sf):
    e = fx.events(spark, sf).select(
        F.concat(F.lit("https://h"), (F.col("user_id") % 7).cast("string")).alias("origin"), F.concat(F.lit("key"), (F.col("k") % 20).cast("string")).alias("name"), "event_id", "value"
    )
    return ca.merge_state(e.where("event_id % 3 = 0"), e.where("event_id % 3 > 0"), ["origin", "name"], "event_id")


# ---- one-to-one assignment -----------------------------------------------------------------------


@case("j_2_assign_files_once")
def _(spark, sf):
    r = fx.records(spark, sf).select(
        "pos", F.when(F.col("pos") % 3 == 0, F.lit(None)).otherwise(F.col("file_name")).alias("file_path"),
        F.when(F.col("pos") % 5 == 0, F.concat(F.lit("item_"), (F.col("pos") + 1).cast("string"), F.lit("_click.jpg"))).alias("target"),
        "file_size",
    )
    return rc.assign_files_once(r, fx.files(spark, sf), ["file_path", "target"]).select("pos", "assigned")


@case("j_10_reconcile_late")
def _(spark, sf):
    e = fx.events(spark, sf)
    r = e.select(
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", "failed").otherwise("downloaded").alias("status"),
        F.concat(F.lit("https://www.library.example.gov/item/"), F.col("user_id").cast("string"), F.lit("/")).alias("page_url"),
        F.concat(F.lit("https://dl/scan"), F.col("event_id").cast("string"), F.lit("_m.tif")).alias("url"),
        F.lit(None).cast("string").alias("file_name"),
    )
    files = e.where("event_id % 3 <> 0").select(
        F.concat(F.lit("Scan"), F.col("event_id").cast("string"), F.lit("_M ("), (F.col("k") % 3).cast("string"), F.lit(").tif")).alias("file_name"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("file_size"),
    )
    return rc.reconcile_late(r, files, "https://www.library.example.gov/item/")


# ---- network --------------------------------------------------------------------------------------

fx.SQL["fx_entries"] = """
SELECT request_id, url, frame_id, pos, is_doc, sent AS ts_request, CASE WHEN event_type <> 'signup' THEN sent + lag END AS ts_response,
  CASE WHEN event_type IN ('click', 'purchase', 'view') THEN sent + 2 * lag END AS ts_finished, CASE WHEN event_type <> 'signup' THEN k * 10 END AS content_length,
  CASE WHEN event_type IN ('click', 'purchase', 'view') THEN k * 7 END AS encoded_length, event_type = 'error' AS failed,
  CASE WHEN event_type IN ('click', 'purchase', 'view') THEN k ELSE 0 END AS received FROM fx_requests WHERE starts_with(url, 'https')"""
fx.SQL["fx_doc_pages"] = """
SELECT frame_id, arg_min(url, pos) AS page_url, min(ts_request) AS started, min(pos) AS first_pos FROM fx_entries WHERE is_doc GROUP BY frame_id"""


@case("str_1_har_entries", "SELECT request_id, url, frame_id, round(ts_request, 3) AS ts_request, round(ts_response, 3) AS ts_response, round(ts_finished, 3) AS ts_finished, received, failed FROM fx_entries")
def _(spark, sf):
    return nw.har_entries(fx.network(spark, sf)).select(
        "request_id", "url", "frame_id", *[F.round(c, 3).alias(c) for c in ("ts_request", "ts_response", "ts_finished")], "received", "failed"
    )


@case("str_2_har_timings", """SELECT request_id, coalesce(CAST(round_even((ts_response - ts_request) * 1000, 0) AS BIGINT), 0) AS wait_ms,
  coalesce(CAST(round_even((ts_finished - ts_response) * 1000, 0) AS BIGINT), 0) AS receive_ms,
  CASE WHEN content_length IS NOT NULL AND encoded_length IS NOT NULL THEN greatest(0, content_length - encoded_length) ELSE 0 END AS compression FROM fx_entries""")
def _(spark, sf):
    return nw.har_timings(nw.har_entries(fx.network(spark, sf))).select("request_id", "wait_ms", "receive_ms", "compression")


@case("str_3_har_filter", r"""SELECT request_id, 'page@' || e.frame_id AS pageref FROM fx_entries e JOIN fx_doc_pages p ON p.frame_id = e.frame_id
  WHERE NOT contains(lower(url), '/favicon.ico') AND regexp_extract(url, '://([^/]*)', 1) = regexp_extract(page_url, '://([^/]*)', 1)""")
def _(spark, sf):
    n = fx.network(spark, sf)
    return nw.har_filter(nw.har_entries(n), nw.page_timings(n), "minimal").select("request_id", "pageref")


@case("j_23_page_ref", """SELECT request_id, CASE WHEN p.frame_id IS NOT NULL THEN 'page@' || e.frame_id END AS pageref FROM fx_entries e LEFT JOIN fx_doc_pages p ON p.frame_id = e.frame_id""")
def _(spark, sf):
    n = fx.network(spark, sf)
    return nw.with_page(nw.har_entries(n), nw.page_timings(n)).select("request_id", "pageref")


@case("str_4_page_timings", """
WITH l AS (SELECT frame_id, pos, sent FROM fx_requests WHERE is_doc),
m AS (SELECT p.frame_id, arg_max(sent, pos) AS sent FROM fx_doc_pages p JOIN l ON l.frame_id = p.frame_id AND l.pos >= p.first_pos GROUP BY p.frame_id)
SELECT frame_id, page_url, CAST(round_even((m.sent + 0.25 - started) * 1000, 0) AS BIGINT) AS on_content_load, CAST(round_even((m.sent + 0.5 - started) * 1000, 0) AS BIGINT) AS on_load
FROM fx_doc_pages JOIN m USING (frame_id)""")
def _(spark, sf):
    return nw.page_timings(fx.network(spark, sf)).select("frame_id", "page_url", "on_content_load", "on_load")


# The fixture's events lie minutes apart; here time runs 5000 times faster, so that requests overlap.
MOMENT = 259.2
_SENT = "((sent - 1704067200) / 5000)"
_open = f"""SELECT request_id, url, is_doc, ({MOMENT} - {_SENT}) * 1000 AS ms FROM fx_requests WHERE {_SENT} <= {MOMENT}
  AND NOT (event_type IN ('click', 'purchase', 'view') AND {_SENT} + 2 * lag / 5000 <= {MOMENT}) AND NOT (event_type = 'error' AND {_SENT} + lag / 5000 <= {MOMENT})"""


def _quick(spark, sf):
    return fx.network(spark, sf).where("request_id IS NOT NULL").withColumn("at", (F.col("at") - 1704067200) / 5000)


@case("str_5_request_timeouts", f"SELECT request_id, url FROM ({_open}) WHERE ms >= 30000")
def _(spark, sf):
    return nw.request_timeouts(_quick(spark, sf), MOMENT, 30).select("request_id", "url")


@case("str_6_pending_requests", f"SELECT request_id, url FROM ({_open}) WHERE ms <= 10000 AND NOT (regexp_matches(url, '\\.ico$') AND ms > 3000)")
def _(spark, sf):
    n = _quick(spark, sf).withColumn("type", F.lower("type").substr(1, 3))
    return nw.pending_requests(n, MOMENT).select("request_id", "url")


@case("fil_9_tracker_filter", """SELECT event_id, url FROM fx_urls WHERE NOT regexp_matches(url, 'doubleclick|analytics|ads|tracking|pixel|/log/|/events/') AND NOT starts_with(url, 'data:') AND k * 150 <= 10000
  AND NOT (k * 150 > 3000 AND (event_type = 'click' OR regexp_matches(url, '(?i)\\.(jpg|jpeg|png|gif|webp|svg|ico)(\\?|$)')))""")
def _(spark, sf):
    requests = fx.urls(spark, sf).select(
        "event_id", URL, (F.col("k") * 150).alias("duration_ms"), F.when(F.col("event_type") == "click", "img").otherwise("fetch").alias("type")
    )
    return ru.tracker_filter(requests).select("event_id", URL)


@case("agg_18_domains_seen", r"""
WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages)
SELECT (SELECT string_agg(host, ', ' ORDER BY host) FROM (SELECT host FROM h ORDER BY host LIMIT 5)) || ' +' || (count(*) - 5) || ' more' AS domains FROM h""")
def _(spark, sf):
    return ru.domains_seen(fx.table(spark, sf, "pages"))


# ---- files on disk ----------------------------------------------------------------------------------


def _in_parts(lines, position, rows, path):
    """Text files of ``rows`` neighbouring positions each, in order; no task holds more than a few of them."""
    named = lines.withColumn("part", F.lpad(F.floor(F.col(position) / rows).cast("string"), 9, "0"))
    named.repartition("part").sortWithinPartitions("part", position).drop(position).write.partitionBy("part").text(path)
    return f"{path}/*"


def _part():
    return F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part")


def _record_lines(spark, sf, path):
    """fx_records as JSON lines with some blank, broken and non-object ones."""
    r = fx.records(spark, sf).withColumn("recorded_at", F.col("recorded_at").cast("string"))
    good = F.to_json(F.struct("pos", "sequence", "status", "title", "page_url", "image_url", "sha256", "file_name"))
    line = F.when(F.col("pos") % 50 == 7, "").when(F.col("pos") % 50 == 8, F.lit('{"broken": ')).when(F.col("pos") % 50 == 9, "[1, 2]").otherwise(good)
    return _in_parts(r.select("pos", line.alias("value")), "pos", 1000, path)


@case("src_1_read_records", """SELECT pos // 1000 AS part, pos % 1000 + 1 AS line_number,
  CASE pos % 50 WHEN 8 THEN 'line ' || (pos % 1000 + 1) || ': invalid JSON' WHEN 9 THEN 'line ' || (pos % 1000 + 1) || ': JSON value is not an object' END AS error,
  CASE WHEN pos % 50 NOT IN (8, 9) THEN title END AS title, CASE WHEN pos % 50 NOT IN (8, 9) THEN sha256 END AS sha256 FROM fx_records WHERE pos % 50 <> 7""")
def _(spark, sf):
    rows = sr.read_records(spark, _record_lines(spark, sf, case_path(spark, "records")))
    return rows.select(_part(), "line_number", "error", "title", "sha256")


@case("src_3_read_json_array", "SELECT pos, url, status FROM fx_queue WHERE file = 0")
def _(spark, sf):
    path = case_path(spark, "queues")
    q = fx.queue(spark, sf)
    # One list per user, and documents that are no lists.
    lists = q.groupBy("file", (F.col("pos") % 64).alias("doc")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", URL, "status")))).alias("value"))
    value = F.when(F.col("file") == 0, F.col("value")).otherwise(F.concat(F.lit('{"queue": '), "value", F.lit("}")))
    lists.select("file", "doc", value.alias("value")).repartition(16, "file", "doc").write.partitionBy("file", "doc").option("maxRecordsPerFile", 1).text(path)
    return sr.read_json_array(spark, f"{path}/*/*", "pos bigint, url string, status string").select(
        "pos", URL, "status"
    )


HISTORY_DOC = """
concat('{"history": [', array_join(transform(array_sort(collect_list(struct(pos, js))), x -> x.js), ','), ']}')"""


@case("src_4_read_history", """SELECT run, step, CASE WHEN k % 4 > 0 THEN true END AS has_output, url, round(seconds, 5) AS seconds, error, step = steps AS is_done FROM fx_steps""")
def _(spark, sf):
    path = case_path(spark, "histories")
    a = fx.actions(spark, sf)
    last = a.groupBy("run").agg(F.max("pos").alias("last"))
    js = F.concat(
        F.lit('{"model_output": '), F.when(F.col("k") % 4 > 0, F.concat(F.lit('{"action": ['), "params", F.lit("]}"))).otherwise('"text"'),
        F.lit(', "result": [{"error": '), F.coalesce(F.concat(F.lit('"'), "error", F.lit('"')), F.lit("null")),
        F.lit(', "is_done": '), (F.col("pos") == F.col("last")).cast("string"),
        F.lit('}], "state": {"url": "'), URL, F.lit('"}, "metadata": {"step_start_time": 0, "step_end_time": '), F.col("seconds").cast("string"), F.lit("}}"),
    )
    docs = a.join(last, "run").withColumn("js", js).groupBy("run").agg(F.expr(HISTORY_DOC).alias("value"))
    foldered(docs, "run").option("maxRecordsPerFile", 1).text(path)
    h = sr.read_history(spark, f"{path}/*")
    return h.select(
        F.regexp_extract("run", r"run=(\d+)", 1).cast("bigint").alias("run"), "step", F.when(F.col("model_output").isNotNull(), True).alias("has_output"),
        URL, F.round("seconds", 5).alias("seconds"), "error", "is_done",
    )


@case("src_5_file_inventory", """SELECT p_partkey // 1000 AS folder, CAST(sum(length(p_type) + 1) AS BIGINT) AS file_size, sha256(string_agg(p_type || chr(10), '' ORDER BY p_partkey)) AS sha256
  FROM part GROUP BY p_partkey // 1000""")
def _(spark, sf):
    path = case_path(spark, "inventory")
    rows = fx.table(spark, sf, "part").select("p_partkey", "p_type", F.floor(F.col("p_partkey") / 1000).cast("bigint").alias("folder"))
    rows.repartition("folder").sortWithinPartitions("folder", "p_partkey").drop("p_partkey").write.partitionBy("folder").text(path)
    listed = sr.file_inventory(spark, f"{path}/*", (".txt", ".jpg"))
    return listed.select(F.regexp_extract("file_path", r"folder=(\d+)", 1).cast("bigint").alias("folder"), "file_size", "sha256")


fx.SQL["fx_log_meta"] = """
SELECT event_id // 3 + 1 AS sequence, 'pic_' || (event_id // 3 + 1) || '.jpg' AS file_name,
  max(CASE WHEN event_id % 3 = 1 THEN 'https://h/p' || k END) AS page_url, max(CASE WHEN event_id % 3 = 2 THEN 'https://h/i' || k END) AS image_url
FROM fx_events GROUP BY event_id // 3"""


LOG_ROWS = 1000  # of a log file; groups of three lines run over from one file to the next
fx.SQL["fx_log_lines"] = f"""
SELECT event_id // {LOG_ROWS} AS part, event_id % {LOG_ROWS} + 1 AS line_number, CASE event_id % 3
  WHEN 0 THEN 'INFO 已记录图片 #' || (event_id // 3 + 1) || ': `pic_' || (event_id // 3 + 1) || '.jpg`, ok' WHEN 1 THEN 'page_url: https://h/p' || k ELSE '  image_url: https://h/i' || k || ';' END AS line
FROM fx_events"""


def _logs(spark, sf):
    """Log files of three-line groups: a recorded picture, its page, its image."""
    path = case_path(spark, "logs")
    e = fx.events(spark, sf)
    n = F.floor(F.col("event_id") / 3) + 1
    k = F.col("k").cast("string")
    line = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("INFO 已记录图片 #"), n.cast("string"), F.lit(": `pic_"), n.cast("string"), F.lit(".jpg`, ok")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("page_url: https://h/p"), k))
        .otherwise(F.concat(F.lit("  image_url: https://h/i"), k, F.lit(";")))
    )
    return _in_parts(e.select("event_id", line.alias("value")), "event_id", LOG_ROWS, path)


@case("src_6_read_logs", "SELECT part, line_number, line FROM fx_log_lines")
def _(spark, sf):
    return sr.read_logs(spark, _logs(spark, sf)).select(_part(), "line_number", "line")


@case("win_7_log_carry_forward", "SELECT * FROM fx_log_meta")
def _(spark, sf):
    return sr.log_carry_forward(sr.read_logs(spark, _logs(spark, sf)))


@case("src_11_recent_lines", "SELECT part, line_number, line FROM fx_log_lines ORDER BY part DESC, line_number DESC LIMIT 300")
def _(spark, sf):
    return sr.recent_lines(sr.read_logs(spark, _logs(spark, sf)), 300).select(_part(), "line_number", "line")


@case("src_7_read_catalog", "SELECT pos, title, CAST(0 AS BIGINT) AS missing FROM fx_records")
def _(spark, sf):
    path = case_path(spark, "catalog")
    fx.records(spark, sf).select("pos", "title").write.parquet(path)
    absent = read_or_empty(spark, path + "-absent", "pos bigint, title string")
    return read_or_empty(spark, path, "pos bigint, title string").withColumn("missing", absent.agg(F.count("*")).scalar())


@case("src_8_pricing_snapshot", """SELECT p_brand AS model, 'list' AS origin, max(p_size) / 1e6 AS input FROM part GROUP BY p_brand""")
def _(spark, sf):
    path = case_path(spark, "prices")
    prices = fx.table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg((F.max("p_size") / 1e6).alias("c"))
    entry = F.struct("model", F.struct(F.col("c").alias("input_cost_per_token"), F.lit(None).cast("double").alias("output_cost_per_token")).alias("p"))
    doc = prices.agg(F.map_from_entries(F.collect_list(entry)).alias("data"))
    for at, factor in (("2024-01-02T10:00:00", 1), ("2024-01-02T02:00:00", 2), ("2023-12-30T00:00:00", 3)):
        # Only the newest document holds prices; the others must not be read.
        scaled = F.col("data") if factor == 1 else F.map_filter("data", lambda m, p: F.lit(False))
        doc.select(F.lit(at).alias("timestamp"), scaled.alias("data")).write.mode("append").json(f"{path}/{factor}")
    snapshot = sr.pricing_snapshot(spark, f"{path}/*", "2024-01-02 12:00:00")
    return snapshot.select("model", "origin", "input")


@case("src_12_read_text_like", """SELECT doc_id // 16 AS folder, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY doc_id // 16""")
def _(spark, sf):
    path = case_path(spark, "texts")
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 16).cast("bigint").alias("folder"))
    foldered(docs, "folder", "doc_id").text(path)
    read = sr.read_text_like(spark, f"{path}/*", "txt")
    return read.select(F.regexp_extract("file", r"folder=(\d+)", 1).cast("bigint").alias("folder"), F.md5("text").alias("digest"))


@case("src_12_read_csv", "SELECT p_partkey, p_name, p_type FROM part")
def _(spark, sf):
    path = case_path(spark, "sheets")
    fx.table(spark, sf, "part").select("p_partkey", "p_name", "p_type").write.option("header", True).csv(path)
    return sr.read_text_like(spark, path, "csv").withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@case("src_12_read_jsonl", "SELECT pos, title FROM fx_records")
def _(spark, sf):
    path = case_path(spark, "lines")
    fx.records(spark, sf).select("pos", "title").write.json(path)
    parsed = sr.read_text_like(spark, path, "jsonl").select(F.from_json("line", "pos bigint, title string").alias("r"))
    return parsed.select("r.pos", "r.title")


@case("src_12_read_xml", "SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part")
def _(spark, sf):
    path = case_path(spark, "markup")
    rows = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    rows.write.format("xml").option("rootTag", "items").option("rowTag", "item").save(path)
    return sr.read_xml_rows(spark, path, "item", "id bigint, name string, brand string")


@case("snk_1_append_records", "SELECT pos, title, page_url FROM fx_records UNION ALL SELECT pos, '图 ' || title, page_url FROM fx_records WHERE pos % 2 = 0")
def _(spark, sf):
    path = case_path(spark, "append")
    r = fx.records(spark, sf).select("pos", "title", "page_url")
    sinks.append_records(r, path)
    sinks.append_records(r.where("pos % 2 = 0").withColumn("title", F.concat(F.lit("图 "), "title")), path)
    return spark.read.schema("pos bigint, title string, page_url string").json(path)


@case("snk_3_write_info_table", """SELECT '| ' || sequence || ' | ' || file_name || ' | ' || title || '\\|x | ' || page_url || ' |' AS line FROM fx_records WHERE status = 'downloaded'""")
def _(spark, sf):
    path = case_path(spark, "info")
    r = fx.records(spark, sf).select("status", "sequence", "file_name", F.concat("title", F.lit("|x\n")).alias("title"), "page_url")
    sinks.write_info_table(r, path)
    return spark.read.text(f"{path}/01-rows").select(F.col("value").alias("line"))


fx.SQL["fx_report"] = """
SELECT (SELECT count(*) FROM fx_records WHERE status = 'downloaded') AS done, (SELECT count(*) FROM fx_files) AS images,
  (SELECT count(*) FROM fx_files WHERE file_size < 10240 OR width < 200 OR height < 200) AS bad,
  (SELECT count(*) FROM (SELECT sha256 FROM fx_files GROUP BY 1 HAVING count(*) > 1)) AS twice,
  5000 - (SELECT count(*) FROM fx_records WHERE status = 'downloaded' AND sequence <= 5000) AS gaps,
  (SELECT count(*) FROM fx_files WHERE file_name NOT IN (SELECT file_name FROM fx_records WHERE status = 'downloaded')) AS stray"""


@case("snk_4_write_report", """
SELECT 'summary' AS part, 'Final download validation: INCOMPLETE' AS line
UNION ALL SELECT 'summary', '- ' || unnest(['downloaded_records: ' || done, 'remaining_records_needed: ' || greatest(0, 5000 - done), 'image_files: ' || images, 'sequence_gaps_warning_only: ' || gaps,
  'bad_or_empty_images: ' || bad, 'duplicate_image_hash_groups: ' || twice, 'orphan_files_warning_only: ' || stray]) FROM fx_report
UNION ALL SELECT 'bad', '- bad or empty image: ' || file_name FROM fx_files WHERE file_size < 10240 OR width < 200 OR height < 200
UNION ALL SELECT 'duplicate', '- duplicate ' || sha256 || ': ' || file_name FROM fx_files WHERE sha256 IN (SELECT sha256 FROM fx_files GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'gap', '- missing sequence: ' || range FROM range(1, 5001) WHERE range NOT IN (SELECT sequence FROM fx_records WHERE status = 'downloaded')""")
def _(spark, sf):
    path = case_path(spark, "report")
    r, f = fx.records(spark, sf), fx.files(spark, sf)
    sinks.write_report(ca.validate_completeness(r, f, 5000), sinks.report_details(r, f, 5000), path)
    summary = spark.read.text(f"{path}/summary").select(F.lit("summary").alias("part"), F.col("value").alias("line"))
    return summary.unionByName(spark.read.text(f"{path}/details").select(F.col("kind").alias("part"), F.col("value").alias("line")))


@case("snk_5_write_har", """
SELECT request_id, strftime(make_timestamp(CAST(round_even(ts_request * 1000, 0) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS started, e.url, coalesce(CAST(round_even((ts_response - ts_request) * 1000, 0) AS BIGINT), 0) AS wait,
  coalesce(CAST(round_even((ts_finished - ts_response) * 1000, 0) AS BIGINT), 0) AS receive, CASE WHEN ts_response IS NOT NULL AND NOT failed THEN 200 ELSE 0 END AS status,
  coalesce(content_length, 0) AS size, coalesce(encoded_length, -1) AS body, received, CASE WHEN p.frame_id IS NOT NULL THEN 'page@' || e.frame_id END AS pageref
FROM fx_entries e LEFT JOIN fx_doc_pages p ON p.frame_id = e.frame_id WHERE NOT contains(lower(e.url), '/favicon.ico')""")
def _(spark, sf):
    field = lambda name, path, kind="string": F.get_json_object("value", path).cast(kind).alias(name)
    return spark.read.text(f"{_har(spark, sf)}/entries").select(
        field("request_id", "$._id"), field("started", "$.startedDateTime"), field(URL, "$.request.url"), field("wait", "$.timings.wait", "bigint"),
        field("receive", "$.timings.receive", "bigint"), field("status", "$.response.status", "int"), field("size", "$.response.content.size", "bigint"),
        field("body", "$.response.bodySize", "bigint"), field("received", "$.response._transferSize", "bigint"), field("pageref", "$.pageref"),
    )


@case("snk_5_write_har_pages", """
SELECT 'page@' || frame_id AS id, page_url AS title, strftime(make_timestamp(CAST(round_even(started * 1000, 0) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS started, '1.2' AS version FROM fx_doc_pages""")
def _(spark, sf):
    path = _har(spark, sf)
    version = spark.read.text(f"{path}/log").select(F.get_json_object("value", "$.version")).scalar()
    return spark.read.text(f"{path}/pages").select(
        F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.title").alias("title"), F.get_json_object("value", "$.startedDateTime").alias("started"), version.alias("version")
    )


def _har(spark, sf):
    path = case_path(spark, "har")
    n = fx.network(spark, sf)
    pages = nw.page_timings(n)
    sinks.write_har(nw.har_document(nw.har_timings(nw.har_filter(nw.har_entries(n), pages))), nw.har_pages(pages), path)
    return path


@case("snk_6_write_inventory", """SELECT 'queue.' || status AS name, count(*) AS n FROM fx_queue GROUP BY status
  UNION ALL SELECT 'image_file_count', count(*) FROM fx_files UNION ALL SELECT 'downloaded_record_count', count(DISTINCT page_url) FROM fx_records WHERE status = 'downloaded'""")
def _(spark, sf):
    path = case_path(spark, "counts")
    sinks.write_inventory(fx.queue(spark, sf), fx.files(spark, sf), fx.records(spark, sf), path)
    return spark.read.schema("name string, n bigint").json(f"{path}/counts")


@case("snk_7_write_history", """SELECT run, pos, CASE WHEN name = 'input' THEN replace(params, ' T1', '<secret>word</secret>') ELSE params END AS params FROM fx_actions""")
def _(spark, sf):
    path = case_path(spark, "masked")
    sinks.write_history(fx.actions(spark, sf).select("run", "pos", "name", "params"), path, [("word", " T1"), ("site", "")])
    return spark.read.schema("run bigint, pos bigint, params string").json(path)


# ---- streams ------------------------------------------------------------------------------------------


def _stream(df, label, build, parts=3, order="pos", mode="append"):
    """Feed the frame in ``order`` as JSON files, part by part, and drain the stream after each part.

    Every drain is a new start from the checkpoint, and its files are one micro-batch.
    """
    spark = df.sparkSession
    path = case_path(spark, label)
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) // parts + 1
    for i in range(parts):
        df.where((F.col(order) >= low + i * step) & (F.col(order) < low + (i + 1) * step)).write.json(f"{path}/in/{i}")
        out = st.drain(build(f"{path}/in"), path, mode)
    return out


def _schema(df):
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


@case("src_9_records_stream", "SELECT pos, title FROM fx_records")
def _(spark, sf):
    r = fx.records(spark, sf).select("pos", "title", "status")
    return _stream(r, "records-stream", lambda p: st.records_stream(spark, p, _schema(r))).select("pos", "title")


@case("src_10_network_events_stream", """
WITH e AS (SELECT *, event_type IN ('click', 'purchase', 'view') AS ended FROM fx_requests)
SELECT 'requestWillBeSent' AS event, frame_id, count(*) AS n, CAST(NULL AS BIGINT) AS size, count(DISTINCT url) AS urls FROM e GROUP BY frame_id
UNION ALL SELECT 'responseReceived', frame_id, count(*), CAST(sum(k * 10) AS BIGINT), 0 FROM e WHERE event_type <> 'signup' GROUP BY frame_id
UNION ALL SELECT 'dataReceived', frame_id, count(*), CAST(sum(size) AS BIGINT), 0 FROM (SELECT frame_id, k AS size FROM e WHERE ended UNION ALL SELECT frame_id, 1000 FROM e WHERE k % 4 = 0) GROUP BY frame_id
UNION ALL SELECT 'loadingFinished', frame_id, count(*), CAST(sum(k * 7) AS BIGINT), 0 FROM e WHERE ended GROUP BY frame_id
UNION ALL SELECT 'loadingFailed', frame_id, count(*), NULL, 0 FROM e WHERE event_type = 'error' GROUP BY frame_id
UNION ALL SELECT 'lifecycleEvent', frame_id, 2 * count(*), NULL, 0 FROM e WHERE is_doc GROUP BY frame_id""")
def _(spark, sf):
    rows = _stream(fx.network(spark, sf), "network-stream", lambda p: st.network_events_stream(spark, p))
    return rows.groupBy("event", "frame_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count_distinct("url").alias("urls"))


@case("src_11_log_stream", "SELECT line, count(*) AS n FROM fx_log_lines GROUP BY line")
def _(spark, sf):
    path = _logs(spark, sf)
    return st.drain(st.log_stream(spark, path), case_path(spark, "log-stream")).groupBy("line").agg(F.count("*").alias("n"))


# What the last watermark closes: the largest time seen, less the delay of ten seconds.
_LAST = f"""(SELECT max({_SENT} + CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 2 * lag / 5000 WHEN event_type = 'error' THEN lag / 5000 ELSE 0 END) FROM fx_requests) - 10"""


# Of one request in seven the answer comes 90 s, the data 150 s and the end 240 s later: it is silent for longer than any gap.
_LATE = "CASE WHEN pos % 7 = 0 THEN {} ELSE 0 END"
_ENDED = f"""{_SENT} + CASE WHEN event_type = 'error' THEN lag / 5000 ELSE 2 * lag / 5000 END + {_LATE.format(240)}"""


def _silent(spark, sf):
    """Requests of which every seventh is silent for long stretches."""
    late = F.when(F.col("event") == "responseReceived", 90).when(F.col("event") == "dataReceived", 150).when(F.col("event").isin("loadingFinished", "loadingFailed"), 240)
    slow = F.col("request_id").substr(F.lit(2), F.lit(20)).cast("bigint") % 7 == 0
    return _quick(spark, sf).withColumn("at", F.col("at") + F.when(slow, F.coalesce(late, F.lit(0))).otherwise(0))


@case("str_1_har_stream", f"""
WITH r AS (SELECT *, CASE event_type WHEN 'signup' THEN NULL ELSE {_ENDED} END AS ended,
  greatest({_SENT}, CASE WHEN event_type <> 'signup' THEN {_SENT} + lag / 5000 + {_LATE.format(90)} END, CASE WHEN event_type IN ('click', 'purchase', 'view', 'error') THEN {_ENDED} END) AS last FROM fx_requests)
SELECT request_id, e.url, received, failed, CASE WHEN NOT failed THEN round(ended, 3) END AS ended FROM fx_entries e JOIN r USING (request_id)
WHERE coalesce(ended + 1, {_SENT} + 600) < (SELECT max(last) - 10 FROM r)""")
def _(spark, sf):
    rows = _stream(_silent(spark, sf), "har-stream", lambda p: keyed.har_stream(st.network_events_stream(spark, p), "10 minutes"), order="at")
    ended = F.when(F.col("failed"), F.lit(None)).otherwise(F.col("ts_finished"))
    return rows.select("request_id", URL, "received", "failed", F.round(ended, 3).alias("ended"))


@case("str_7_dedup_seen", "SELECT DISTINCT url, md5(url) AS hash FROM pages")
def _(spark, sf):
    pages = fx.table(spark, sf, "pages").select("page_id", URL, F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("pulled_at"))
    # Every page twice, the second time later; a second per page, so all of them lie within the delay.
    seen = pages.unionByName(pages.withColumn("pulled_at", F.col("pulled_at") + F.expr("INTERVAL 1 HOUR")))
    rows = _stream(seen, "news", lambda p: st.dedup_seen(st.json_stream(spark, p, _schema(seen)), "pulled_at", "30 days"), order="page_id")
    return rows.select(URL, "hash")


fx.SQL["fx_import"] = """
SELECT r.pos, r.title, f.sha256 AS content, (r.pos - (SELECT min(pos) FROM fx_records)) // ((SELECT max(pos) - min(pos) FROM fx_records) // 3 + 1) AS batch,
  CASE WHEN r.status <> 'downloaded' THEN 'skipped' WHEN f.file_name IS NULL THEN 'no_file' WHEN r.sha256 <> f.sha256 THEN 'hash_mismatch' ELSE 'imported' END AS outcome
FROM fx_records r LEFT JOIN fx_files f USING (file_name)"""


def _imported(spark, sf):
    r = fx.records(spark, sf).select("pos", "status", "sha256", "file_name", "title", "page_url", "image_url")
    return _stream(r, "import", lambda p: keyed.import_changes(st.records_stream(spark, p, _schema(r)), fx.files(spark, sf)))


@case("str_8_import_stream", """
SELECT content AS sha256, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS records, arg_max(title, pos) AS title
FROM fx_import WHERE outcome = 'imported' GROUP BY content""")
def _(spark, sf):
    return keyed.images_of(_imported(spark, sf)).select("sha256", "first_pos", "last_pos", "records", "title")


@case("str_8_import_runs", """
WITH c AS (SELECT *, outcome = 'imported' AND pos = min(pos) FILTER (WHERE outcome = 'imported') OVER (PARTITION BY content) AS is_first FROM fx_import),
g AS (SELECT batch, count(*) AS total_records, count(*) FILTER (WHERE outcome = 'imported') AS imported_count, count(*) FILTER (WHERE outcome = 'skipped') AS skipped_count,
  count(*) FILTER (WHERE outcome IN ('no_file', 'hash_mismatch')) AS error_count, count(*) FILTER (WHERE is_first) AS inserted,
  count(DISTINCT content) FILTER (WHERE outcome = 'imported') - count(*) FILTER (WHERE is_first) AS refreshed FROM c GROUP BY batch)
SELECT CAST(batch AS INTEGER) AS batch, total_records, imported_count, skipped_count, error_count, inserted, refreshed, inserted AS adopted,
  CASE WHEN error_count > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM g""")
def _(spark, sf):
    return keyed.import_runs(_imported(spark, sf))


@case("str_9_loop_stream", """
WITH a AS (SELECT run, pos, name, action_hash AS h, url || dom_text || element_count AS f, row_number() OVER (PARTITION BY run ORDER BY pos) AS rn,
   count(*) FILTER (WHERE name <> 'wait') OVER (PARTITION BY run ORDER BY pos) AS en FROM fx_hashed),
x AS (SELECT run, h, en FROM a WHERE name <> 'wait'),
c AS (SELECT a.run, a.pos, x.h, count(*) AS c FROM a JOIN x ON x.run = a.run AND x.en BETWEEN a.en - 19 AND a.en GROUP BY a.run, a.pos, x.h),
m AS (SELECT run, pos, max(c) AS repetitions FROM c GROUP BY run, pos),
b AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY run ORDER BY pos) THEN rn END AS s FROM a),
d AS (SELECT run, pos, rn - max(s) OVER (PARTITION BY run ORDER BY pos) AS stagnant FROM b)
SELECT run, pos, coalesce(repetitions, 0) AS repetitions, stagnant FROM d LEFT JOIN m USING (run, pos) JOIN (SELECT event_id AS pos, ts FROM fx_events) USING (pos)
WHERE (epoch_ms(ts) // 3600000 + 1) * 3600000 < (SELECT max(epoch_ms(ts)) - 60000 FROM fx_events)""")
def _(spark, sf):
    a = fx.actions(spark, sf).select("run", "pos", "ts", "name", "params", URL, "dom_text", "element_count", F.unix_seconds("ts").alias("at"))
    rows = _stream(a, "loops", lambda p: keyed.loop_stream(st.json_stream(spark, p, _schema(a)), span="1 hour", keep="365 days"), order="at")
    return rows.select("run", "pos", "repetitions", "stagnant")


@case("str_10_page_progress_stream", "SELECT * FROM fx_progress WHERE attempts > 0")
def _(spark, sf):
    b = fx.batches(spark, sf)
    rows = _stream(b, "progress", lambda p: st.page_progress_stream(st.json_stream(spark, p, _schema(b))), mode="update")
    return st.latest(rows, ["page"])


@case("str_5_timeout_stream", f"SELECT request_id, url FROM fx_requests WHERE event_type = 'signup' AND {_SENT} + 30 <= {_LAST}")
def _(spark, sf):
    rows = _stream(_quick(spark, sf), "timeouts", lambda p: st.timeout_stream(st.network_events_stream(spark, p), 30))
    return rows.select("request_id", URL)


@case("str_12_usage_stream", """SELECT model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) AS invocations,
  round(coalesce(sum(prompt_cost + completion_cost), 0), 6) AS total_cost FROM fx_priced GROUP BY model""")
def _(spark, sf):
    use = fx.usage(spark, sf).drop("ts")
    rows = _stream(
        use, "usage", lambda p: st.usage_stream(st.json_stream(spark, p, _schema(use)), *fx.pricing(spark)), order="conv_id", mode="update"
    )
    return st.latest(rows, ["model"]).select("model", "prompt_tokens", "completion_tokens", "invocations", F.round("total_cost", 6).alias("total_cost"))


# ---- registered functions ----------------------------------------------------------------------------


# An e and its accent as two code points.
DECOMPOSED = " cafe\N{COMBINING ACUTE ACCENT}"


@case("udf_1_register_action", f"""SELECT event_id, CASE WHEN {_s} = 'https' AND ({_h} = 'allowed.example.net' OR ends_with({_h}, '.allowed.example.net')) THEN upper(event_type) END AS shouted,
  nfc_normalize(event_type || '{DECOMPOSED}') AS composed, false AS has_hidden FROM fx_urls""")
def _(spark, sf):
    actions = rg.ActionRegistry(exclude=["hidden"])
    actions.action("shout", ["*.allowed.example.net"])(F.upper)
    actions.action("hidden")(F.lower)
    actions.pandas_action(spark, "composed", _composed, "string")
    rows = fx.urls(spark, sf)
    return rows.select(
        "event_id", actions.call("shout", F.col(URL), F.col("event_type")).alias("shouted"),
        actions.call("composed", F.col(URL), F.concat("event_type", F.lit(DECOMPOSED))).alias("composed"), F.lit("hidden" in actions.actions).alias("has_hidden"),
    )


def _composed(text: pd.Series) -> pd.Series:
    """Unicode composition, which SQL functions lack."""
    return text.str.normalize("NFC")


PROFILE = {
    "site_id": " Gallery ", "item_link_selector": "nav a[href]", "item_id_regex": r"//[^/]+/([A-Za-z]+)", "manifest_template": "https://m/{id}",
    "results_host": "search.example.org", "results_path": "/results", "host_suffixes": ["example.org"],
}


@case("udf_2_site_profile", f"""SELECT event_id, 'gallery' AS site, {_h} = 'example.org' OR ends_with({_h}, '.example.org') AS covered,
  {_h} = 'search.example.org' AND lower(rtrim({s_part('url', 3)}, '/')) = '/results' AND regexp_matches({s_part('url', 4)}, '(^|&)q=[^&]') AS is_results FROM fx_urls""")
def _(spark, sf):
    p = rg.SiteProfile.of(json.loads(json.dumps(PROFILE)))
    c = F.col(URL)
    return fx.urls(spark, sf).select(
        "event_id", F.lit(p.site_id).alias("site"), p.covers(c).alias("covered"),
        u.is_results_url(c, p.results_host, p.results_path).alias("is_results"),
    )


@case("udf_3_markdown_tables", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text <> ''")
def _(spark, sf):
    tb.register_tables(spark)
    fx.table(spark, sf, "documents").createOrReplaceTempView("udtf_documents")
    return spark.sql(
        "SELECT doc_id, max(b.end) - max(CAST(text LIKE '%\\n' AS INT)) AS chars FROM udtf_documents, LATERAL markdown_blocks(text) b GROUP BY doc_id"
    )
