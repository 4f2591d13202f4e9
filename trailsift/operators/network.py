"""Network events of browser sessions: one entry per request, page timings, what is pending or too slow.

Event rows have ``event, request_id, frame_id, at, url, type, size, name, pos``; ``pos`` is the (unique)
order of arrival and ``at`` the time in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.functions import urls as u
from trailsift.operators.rules import tracker_filter


def _is(event: str) -> Column:
    return F.col("event") == event


def har_entries(events: DataFrame) -> DataFrame:
    """One row per https request, the later event winning; events before the request do not count.

    The request and the last event of each kind are found in one aggregate per id; received bytes are summed from the
    request on.  No event list is built.
    """
    e = events.where("request_id IS NOT NULL")
    facts = e.groupBy("request_id").agg(*entry_facts()).where("__since IS NOT NULL")
    data = e.where(_is("dataReceived")).select("request_id", "pos", "size")
    later = data.join(facts.select("request_id", "__since"), "request_id").where(F.col("pos") > F.col("__since"))
    received = later.groupBy("request_id").agg(F.sum("size").alias("__data"))
    return entry_columns(facts.join(received, "request_id", "left"))


def entry_facts() -> list[Column]:
    """Aggregates of one request's events, for batch and streaming grouping alike."""
    order = F.col("pos")
    https = _is("requestWillBeSent") & F.lower("url").startswith("https://")
    return [
        F.min(F.when(https, order)).alias("__since"),
        F.max_by(F.struct("url", "frame_id", "type", F.col("at").alias("at")), F.when(https, order)).alias("q"),
        F.max_by(F.struct(F.col("at").alias("at"), F.col("size").alias("size")), F.when(_is("responseReceived"), order)).alias("__r"),
        F.max(F.when(_is("responseReceived"), order)).alias("__r_at"),
        F.max_by(F.struct(F.col("at").alias("at"), F.col("size").alias("size")), F.when(_is("loadingFinished"), order)).alias("__f"),
        F.max(F.when(_is("loadingFinished"), order)).alias("__f_at"),
        F.max(F.when(_is("loadingFailed"), order)).alias("__x_at"),
    ]


def entry_columns(facts: DataFrame) -> DataFrame:
    after_r, after_f = F.col("__r_at") > F.col("__since"), F.col("__f_at") > F.col("__since")
    return facts.select(
        "request_id", F.col("q.url").alias("url"), F.col("q.frame_id").alias("frame_id"), F.col("q.type").alias("type"),
        F.col("q.at").alias("ts_request"),
        F.when(after_r, F.col("__r.at")).alias("ts_response"),
        F.when(after_f, F.col("__f.at")).alias("ts_finished"),
        F.when(after_r, F.col("__r.size")).alias("content_length"),
        F.when(after_f, F.col("__f.size")).alias("encoded_length"),
        F.coalesce("__data", F.lit(0)).alias("received"),
        F.coalesce(F.col("__x_at") > F.col("__since"), F.lit(False)).alias("failed"),
    )


def har_timings(entries: DataFrame) -> DataFrame:
    """wait, receive and total milliseconds, never negative, and the bytes compression saved."""
    def ms(a: str, b: str) -> Column:
        return F.coalesce(F.greatest(F.lit(0), F.rint((F.col(b) - F.col(a)) * 1000).cast("bigint")), F.lit(0))

    both = F.col("content_length").isNotNull() & F.col("encoded_length").isNotNull()
    saved = F.when(both, F.greatest(F.lit(0), F.col("content_length") - F.col("encoded_length"))).otherwise(F.lit(0))
    out = entries.withColumn("wait_ms", F.when(F.col("ts_response").isNotNull(), ms("ts_request", "ts_response")).otherwise(F.lit(0)))
    known = F.col("ts_response").isNotNull() & F.col("ts_finished").isNotNull()
    return (
        out.withColumn("receive_ms", F.when(known, ms("ts_response", "ts_finished")).otherwise(F.lit(0)))
        .withColumn("total_ms", F.col("wait_ms") + F.col("receive_ms"))
        .withColumn("compression", saved)
    )


def page_timings(events: DataFrame) -> DataFrame:
    """Pages by frame: address of the first document, earliest start, ms to content and to load (-1 unknown)."""
    https_doc = _is("requestWillBeSent") & (F.col("type") == "Document") & F.lower("url").startswith("https://")
    pages = events.where(https_doc & F.col("frame_id").isNotNull()).groupBy("frame_id").agg(
        F.min_by("url", "pos").alias("page_url"), F.min("at").alias("started"),
        F.min("pos").alias("__first"),
    )
    life = events.where(_is("lifecycleEvent") & F.col("name").isin("DOMContentLoaded", "load"))
    # A lifecycle event counts once its page is known; the last one of each kind stays.
    joined = life.select("frame_id", "name", F.col("at").alias("__at"), F.col("pos").alias("__order")).join(pages, "frame_id")
    ms = F.greatest(F.lit(0), F.rint((F.col("__at") - F.col("started")) * 1000).cast("bigint"))
    seen = joined.where(F.col("__order") > F.col("__first")).groupBy("frame_id").agg(
        F.max_by(ms, F.when(F.col("name") == "DOMContentLoaded", F.col("__order"))).alias("on_content_load"),
        F.max_by(ms, F.when(F.col("name") == "load", F.col("__order"))).alias("on_load"),
    )
    return pages.drop("__first").join(seen, "frame_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(-1)) for c in ("on_content_load", "on_load")}
    )


def with_page(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries with the page of their frame, where it is known."""
    known = pages.select("frame_id", "page_url", F.concat(F.lit("page@"), "frame_id").alias("pageref"))
    return entries.join(known, "frame_id", "left")


def har_filter(entries: DataFrame, pages: DataFrame, mode: str = "full") -> DataFrame:
    """Without favicons; ``minimal`` keeps what has the origin of its page."""
    kept = with_page(entries, pages).where(~F.lower("url").contains("/favicon.ico"))
    if mode == "full":
        return kept
    return kept.where(F.col("page_url").isNotNull() & (u.origin(F.col("url")) == u.origin(F.col("page_url"))))


def _open_at(events: DataFrame, moment: float) -> DataFrame:
    """Requests sent and not ended by ``moment``."""
    ended = _is("loadingFinished") | _is("loadingFailed")
    return (
        events.where((F.col("at") <= moment) & F.col("request_id").isNotNull()).groupBy("request_id").agg(
            F.max_by(F.struct("url", "type", F.col("at").alias("at")), F.when(_is("requestWillBeSent"), F.col("at"))).alias("q"),
            F.max(F.when(ended, F.col("at"))).alias("__ended"),
        )
        .where(F.col("q").isNotNull() & (F.col("__ended").isNull() | (F.col("__ended") < F.col("q.at"))))
        .select("request_id", "q.url", "q.type", ((F.lit(moment) - F.col("q.at")) * 1000).alias("duration_ms"))
    )


def request_timeouts(events: DataFrame, moment: float, threshold_seconds: float) -> DataFrame:
    """Requests that have been active for at least the threshold."""
    return _open_at(events, moment).where(F.col("duration_ms") >= threshold_seconds * 1000)


def pending_requests(events: DataFrame, moment: float) -> DataFrame:
    """Requests that are still loading and matter."""
    return tracker_filter(_open_at(events, moment))


def _iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_millis(F.rint(seconds * 1000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def har_pages(pages: DataFrame) -> DataFrame:
    """Pages as JSON, one per row."""
    timings = F.struct(F.col("on_content_load").alias("onContentLoad"), F.col("on_load").alias("onLoad"))
    body = F.struct(
        _iso(F.col("started")).alias("startedDateTime"), F.concat(F.lit("page@"), "frame_id").alias("id"), F.col("page_url").alias("title"), timings.alias("pageTimings")
    )
    return pages.select("frame_id", F.to_json(body).alias("page"))


def har_document(entries: DataFrame) -> DataFrame:
    """Entries as JSON, one per row: sessions have no bound on their requests."""
    unknown = F.lit(-1)
    query = F.coalesce(F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda p: p != ""), F.array().cast("array<string>"))
    named = F.transform(query, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("value")))
    none = F.array().cast("array<struct<name: string, value: string>>")
    request = F.struct(
        F.lit("GET").alias("method"), F.col("url"), F.lit("HTTP/1.1").alias("httpVersion"), none.alias("cookies"), none.alias("headers"),
        named.alias("queryString"), unknown.alias("headersSize"), F.lit(0).alias("bodySize"),
    )
    # A request without a response has status 0.
    answered = F.col("ts_response").isNotNull()
    content = F.struct(F.coalesce("content_length", F.lit(0)).alias("size"), F.col("compression"), F.lower(F.coalesce("type", F.lit(""))).alias("mimeType"))
    response = F.struct(
        F.when(answered & ~F.col("failed"), 200).otherwise(0).alias("status"), F.lit("HTTP/1.1").alias("httpVersion"), none.alias("cookies"), none.alias("headers"),
        content.alias("content"), unknown.alias("headersSize"), F.coalesce("encoded_length", unknown).alias("bodySize"), F.col("received").alias("_transferSize"),
    )
    body = F.struct(
        F.col("request_id").alias("_id"), _iso(F.col("ts_request")).alias("startedDateTime"), F.col("total_ms").alias("time"),
        request.alias("request"), response.alias("response"), F.struct().alias("cache"),
        F.struct(F.lit(0).alias("dns"), F.lit(0).alias("connect"), F.lit(0).alias("ssl"), F.lit(0).alias("send"),
                 F.col("wait_ms").alias("wait"), F.col("receive_ms").alias("receive")).alias("timings"),
        F.col("pageref"),
    )
    return entries.select("request_id", F.to_json(body).alias("entry"))
