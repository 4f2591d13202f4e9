"""Streams: replays change nothing, batch and stream agree."""

import shutil
from datetime import datetime, timezone

from pyspark.sql import functions as F

from trailsift.operators import progress as pr
from trailsift.session import scratch_path
from trailsift.sources import records as sr
from trailsift.sources.tables import VersionedTable, read_or_empty
from trailsift.streaming import keyed
from trailsift.streaming import streams as st

FIELDS = "pos bigint, status string, sha256 string, file_name string, page_url string, image_url string, title string"
INVENTORY = [(f"f{i}.jpg", f"{i % 7:064x}") for i in range(20)] + [("stray.png", "ab" * 32)]


def record(i, status="downloaded", sha=None, name=None):
    return (i, status, f"{i % 7:064x}" if sha is None else sha, name or f"dir/f{i % 20}.jpg", f"https://h/p{i % 7}", f"https://h/i{i}", f" t{i} ")


def feed(spark, path, part, rows, schema=FIELDS):
    spark.createDataFrame(rows, schema).write.json(f"{path}/in/{part}")


def test_import_in_rounds_and_replayed(spark):
    files = spark.createDataFrame(INVENTORY, "file_name string, sha256 string")
    path, again = scratch_path(spark, "in"), scratch_path(spark, "again")
    rounds = [
        [record(i) for i in range(0, 5)] + [record(5, status="failed"), record(6, name="none.jpg")],
        [record(i) for i in range(7, 13)] + [record(13, sha="0" * 64)],
        [record(1000 + i, sha="", name="f3.jpg") for i in range(500)],
    ]
    for k, rows in enumerate(rounds):
        feed(spark, path, k, rows)
        changes = st.import_stream(st.records_stream(spark, f"{path}/in", FIELDS), files, path)
    images = {int(r["sha256"], 16): tuple(r)[1:5] for r in keyed.images_of(changes).collect()}
    assert images == {0: (7, 1, 7, "t7"), 1: (1, 2, 8, "t8"), 2: (2, 2, 9, "t9"), 3: (3, 502, 1499, "t1499"), 4: (4, 2, 11, "t11"), 5: (12, 1, 12, "t12")} | {0: (0, 2, 7, "t7")}
    runs = {r["batch"]: r.asDict() for r in keyed.import_runs(changes).collect()}
    assert [(r["total_records"], r["imported_count"], r["skipped_count"], r["error_count"], r["inserted"], r["refreshed"], r["adopted"]) for _, r in sorted(runs.items())] == [
        (7, 5, 1, 1, 5, 0, 5), (7, 6, 0, 1, 1, 5, 1), (500, 500, 0, 0, 0, 1, 0),
    ]
    # Everything replayed in one batch, twice without a checkpoint: the batch overwrites itself, and the images are the same.
    shutil.copytree(f"{path}/in", f"{again}/in")
    for lost in ("one", "two"):
        stream = keyed.import_changes(st.records_stream(spark, f"{again}/in", FIELDS), files)
        st.drain_with(stream, f"{again}/{lost}", lambda batch, n: batch.write.mode("overwrite").parquet(f"{again}/out/batch={n}"))
    replayed = spark.read.option("basePath", f"{again}/out").parquet(f"{again}/out")
    assert replayed.agg(F.sum("records")).first()[0] == sum(map(len, rounds))
    assert sorted(map(tuple, keyed.images_of(replayed).collect())) == sorted(map(tuple, keyed.images_of(changes).collect()))
    # Nothing that is stored is read by a batch: stored images come in as state.
    stored = spark.createDataFrame([(f"{3:064x}", 1)], "sha256 string, first_pos bigint")
    fresh = scratch_path(spark, "fresh")
    feed(spark, fresh, 0, [record(3)])
    only = st.import_stream(st.records_stream(spark, f"{fresh}/in", FIELDS), files, fresh, stored).collect()
    assert [(r["kind"], r["first_pos"], r["adopted"]) for r in only] == [("refresh", 1, False)]


def network(i, event, at, pos, url="https://h/x", size=None):
    return (event, i, "f", 1e6 + at, url if event == "requestWillBeSent" else None, "Document", size, None, pos)


def test_silent_requests_come_out_once_and_whole(spark):
    path = scratch_path(spark, "har")
    rounds = [
        [network("slow", "requestWillBeSent", 0, 1), network("early", "dataReceived", 1, 2, size=5), network("early", "requestWillBeSent", 2, 3), network("early", "dataReceived", 3, 4, size=7),
         network("never", "requestWillBeSent", 4, 5), network("plain", "requestWillBeSent", 5, 6, "http://h/x"), network("early", "loadingFailed", 6, 7)],
        [network("slow", "responseReceived", 400, 8, size=100), network("tick", "requestWillBeSent", 401, 9)],
        [network("slow", "dataReceived", 800, 10, size=60), network("slow", "loadingFinished", 810, 11, size=50)],
        [network("other", "requestWillBeSent", 5000, 12)],
        [network("tick", "loadingFinished", 5001, 13)],
    ]
    for k, rows in enumerate(rounds):
        feed(spark, path, k, rows, st.NETWORK_EVENTS)
        out = st.drain(keyed.har_stream(st.network_events_stream(spark, f"{path}/in"), "20 minutes"), path)
    past = lambda t: None if t is None else t - 1e6
    got = {r["request_id"]: (past(r["ts_request"]), past(r["ts_response"]), past(r["ts_finished"]), r["content_length"], r["encoded_length"], r["received"], r["failed"]) for r in out.collect()}
    assert got["slow"] == (0.0, 400.0, 810.0, 100, 50, 60, False) and out.count() == len(got)
    assert got["early"] == (2.0, None, None, None, None, 7, True) and got["never"] == (4.0, None, None, None, None, 0, False)
    assert set(got) == {"slow", "early", "never", "tick"} and got["tick"][2] is None  # the end came after its time


def test_state_is_kept_by_buckets(spark):
    path = scratch_path(spark, "many")
    events = spark.range(3000).select(F.lit("requestWillBeSent").alias("event"), F.concat(F.lit("r"), "id").alias("request_id"), F.lit("f").alias("frame_id"),
        (1e6 + F.col("id") / 1000).alias("at"), F.lit("https://h/x").alias("url"), F.col("id").alias("pos"))
    events.write.json(f"{path}/in/0")
    assert st.drain(keyed.har_stream(st.network_events_stream(spark, f"{path}/in")), path).count() == 0
    assert spark.read.format("statestore").option("stateVarName", "held").load(f"{path}/checkpoint").count() <= keyed.BUCKETS
    schema = "run bigint, pos bigint, ts timestamp, name string, params string, url string, dom_text string, element_count int"
    acts = spark.range(3000).selectExpr("id run", "id pos", "timestamp_seconds(1000 + id % 7) ts", "'click' name", "'{}' params", "'u' url", "'d' dom_text", "1 element_count")
    acts.write.json(f"{path}/acts")
    assert st.drain(keyed.loop_stream(st.json_stream(spark, f"{path}/acts", schema), span="1 minute"), f"{path}/loops").count() == 0
    assert spark.read.format("statestore").option("stateVarName", "held").load(f"{path}/loops/checkpoint").count() <= keyed.RUN_BUCKETS


def test_the_inventory_is_no_state(spark):
    files = spark.createDataFrame(INVENTORY, "file_name string, sha256 string")
    path = scratch_path(spark, "few")
    feed(spark, path, 0, [record(3), record(4, sha="")])
    assert sorted((r["kind"], r["adopted"]) for r in st.import_stream(st.records_stream(spark, f"{path}/in", FIELDS), files, path).collect()) == [("insert", True)] * 2
    assert spark.read.format("statestore").option("stateVarName", "image").load(f"{path}/checkpoint").count() == 2
    assert "Distinct" not in keyed.import_changes(st.records_stream(spark, f"{path}/in", FIELDS), files)._jdf.queryExecution().analyzed().toString()


def test_loops_keep_little_and_are_forgotten(spark):
    path = scratch_path(spark, "loops")
    schema = "run bigint, pos bigint, ts timestamp, name string, params string, url string, dom_text string, element_count int"

    def act(pos, at, run=1, k=0):
        return (run, pos, datetime.fromtimestamp(at, timezone.utc), "click", f'{{"index": {k}}}', "https://h/", "text", 3)

    feed(spark, path, 0, [act(i, 60 + i) for i in range(2000)], schema)  # one run holds the whole batch
    feed(spark, path, 1, [act(3000, 100_000, run=2)], schema)
    feed(spark, path, 2, [act(4000, 100_100), act(4001, 300_000, run=2)], schema)
    for folder in ("0", "1", "2"):
        shutil.copytree(f"{path}/in/{folder}", f"{path}/fed/{folder}")
        out = st.drain(keyed.loop_stream(st.json_stream(spark, f"{path}/fed", schema), span="1 minute", keep="1 hour"), path)
    rows = {r["pos"]: (r["run"], r["repetitions"], r["stagnant"]) for r in out.collect()}
    assert len(rows) == 2002 and rows[0] == (1, 1, 0) and rows[10] == (1, 11, 10) and rows[1999] == (1, 20, 1999)
    assert rows[4000] == (1, 1, 0) and rows[3000] == (2, 1, 0)  # forgotten after an hour


def test_versions_skip_unfinished_writes(spark):
    table = VersionedTable(spark, scratch_path(spark, "v"))
    table.publish(spark.range(3))
    unfinished = scratch_path(spark, "x")
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table.path}/v00000002")
    assert unfinished and table.versions() == [1] and table.read().count() == 3


def test_frontier(spark):
    def records(pages):
        return spark.createDataFrame([(p,) for p in pages], "source_page bigint")

    none = spark.createDataFrame([], "page bigint, status string, next_index bigint")
    done = pr.reconcile_frontier(records([1, 2, 3, 3, None]), none, 200)
    assert {r["page"]: r["status"] for r in done.collect()} == {1: "done", 2: "done", 3: "in_progress"}
    assert pr.frontier_summary(done, records([1, 2, 3, 3, None]), 200).first().asDict() == {
        "frontier": 3, "healed_pages": 2, "pages_with_records": 3, "gap_pages": 0, "pages_beyond": 0,
    }
    gaps = pr.reconcile_frontier(records([1, 4]), none, 200)
    assert {r["page"]: r["status"] for r in gaps.collect()} == {1: "done", 2: "pending", 3: "pending", 4: "in_progress"}
    assert pr.frontier_summary(gaps, records([1, 4]), 200).first()["gap_pages"] == 2
    empty = pr.reconcile_frontier(records([None]), none, 200)
    assert pr.frontier_summary(empty, records([None]), 200).count() == 0


def test_pages_beyond_reason_are_flagged(spark):
    far = spark.createDataFrame([(1,), (2,), (999,)], "source_page bigint")
    out = pr.reconcile_frontier(far, spark.createDataFrame([], "page bigint, status string, next_index bigint"), 200)
    assert {(r["page"], r["status"], r["beyond"]) for r in out.collect()} == {(1, "done", False), (2, "in_progress", False), (999, None, True)}


def test_next_page(spark):
    def pages(*rows_):
        return spark.createDataFrame(list(rows_), "page bigint, status string, next_index bigint")

    assert tuple(pr.next_page(pages((1, "done", 0), (5, "pending", 2), (7, "in_progress", 3)), 200).first()) == (7, 3)
    assert tuple(pr.next_page(pages((1, "done", 0), (3, "blocked", 0)), 200).first()) == (4, 0)
    assert tuple(pr.next_page(pages((200, "done", 0)), 200, fallback=2).first()) == (2, 0)
    assert tuple(pr.next_page(pages((999, "in_progress", 4)), 200, fallback=1).first()) == (1, 0)


def test_tolerant_lines_over_several_files(spark):
    path = scratch_path(spark, "lines")
    for name, lines in (("a", ['{"status": "x"}', "", "[1]", "{oops"]), ("b", ['{"status": "图"}'])):
        spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{path}/{name}")
    got = sr.read_records(spark, f"{path}/*").select("line_number", "error", "status").collect()
    assert sorted((r["line_number"], r["error"] or r["status"]) for r in got) == [
        (1, "x"), (1, "图"), (3, "line 3: JSON value is not an object"), (4, "line 4: invalid JSON"),
    ]


def test_missing_table_is_empty(spark):
    assert read_or_empty(spark, scratch_path(spark, "none"), "a int").count() == 0


def test_dedup_with_watermark_matches_batch(spark):
    path = scratch_path(spark, "news")
    df = spark.range(40).select(F.concat(F.lit("u"), (F.col("id") % 9).cast("string")).alias("url"), F.timestamp_seconds(F.col("id")).alias("at"))
    df.write.json(f"{path}/in/0")
    stream = st.json_stream(spark, f"{path}/in", "url string, at timestamp")
    got = st.drain(st.dedup_seen(stream, "at", "1 hour"), path)
    assert sorted(r["url"] for r in got.collect()) == [f"u{i}" for i in range(9)]
