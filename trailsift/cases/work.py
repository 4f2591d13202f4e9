"""Queues, page progress, run histories and token usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailsift.cases import fixtures as fx
from trailsift.cases.base import case
from trailsift.operators import history as hi
from trailsift.operators import methodlock
from trailsift.operators import progress as pr
from trailsift.operators import queue as qu
from trailsift.operators import usage as us

BASE = "https://site/item/"

# ---- queues ----------------------------------------------------------------------------------

_RANK = "CASE status WHEN 'downloaded' THEN 4 WHEN 'failed' THEN 3 WHEN 'skipped' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END"
fx.SQL["fx_merged_queue"] = f"""
SELECT url, title, status, error, file, pos FROM (
  SELECT url || '/' AS url, replace(title, '  ', ' ') AS title, status, CASE WHEN status NOT IN ('pending', 'downloaded') THEN error END AS error, file, pos,
    row_number() OVER (PARTITION BY url ORDER BY {_RANK} DESC, file, pos) AS rn FROM fx_queue) WHERE rn = 1"""


def _merged(spark, sf):
    return qu.merge_queues(fx.queue(spark, sf), BASE)


@case("set_1_merge_queues", "SELECT * FROM fx_merged_queue")
def _(spark, sf):
    return _merged(spark, sf)


@case("set_1_merge_queues_reset", f"""
WITH q AS (SELECT url || '/' AS url, replace(title, '  ', ' ') AS title, CASE WHEN status = 'in_progress' THEN 'pending' ELSE status END AS status, error, file, pos
  FROM fx_queue WHERE NOT contains(title, 'view 7')),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_RANK} DESC, file, pos) AS rn FROM q)
SELECT url, title, status, CASE WHEN status NOT IN ('pending', 'downloaded') THEN error END AS error, file, pos FROM r WHERE rn = 1""")
def _(spark, sf):
    return qu.merge_queues(fx.queue(spark, sf), BASE, reset_in_progress=True, include=["temple"], exclude=["view 7"])


@case("agg_2_queue_counts", """SELECT coalesce(nullif(CASE WHEN status = 'skipped' THEN '' ELSE status END, ''), 'pending') AS status, count(*) AS n
  FROM fx_queue GROUP BY 1""")
def _(spark, sf):
    q = fx.queue(spark, sf).withColumn("status", F.when(F.col("status") == "skipped", "").otherwise(F.col("status")))
    return qu.queue_counts(q)


@case("j_9_merge_queue_status", """
WITH q AS (SELECT * FROM fx_merged_queue WHERE file = 0),
r AS (SELECT 'https://site/item/' || (user_id * 10 + k % 10) || '/' AS url, event_id AS pos, 'rec ' || k AS title,
   CASE event_type WHEN 'purchase' THEN 'downloaded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'pending' END AS status,
   CASE WHEN k % 2 = 0 THEN 'r' || k END AS error FROM fx_events WHERE event_id % 3 = 0),
f AS (SELECT url, arg_max(title, pos) FILTER (WHERE status = 'downloaded') AS dt, bool_or(status = 'downloaded') AS done,
   arg_max(status, pos) FILTER (WHERE status IN ('failed', 'skipped')) AS miss,
   arg_max(error, pos) FILTER (WHERE status IN ('failed', 'skipped') AND error IS NOT NULL) AS me, arg_min(title, pos) AS ft FROM r GROUP BY url)
SELECT coalesce(q.url, f.url) AS url, CASE WHEN done THEN dt ELSE coalesce(q.title, ft) END AS title,
  CASE WHEN done OR q.status = 'downloaded' THEN 'downloaded' ELSE coalesce(miss, q.status, 'pending') END AS status,
  CASE WHEN done THEN NULL WHEN q.status = 'downloaded' THEN q.error ELSE coalesce(me, q.error) END AS error
FROM q FULL JOIN f ON q.url = f.url""")
def _(spark, sf):
    t = F.col("event_type")
    r = fx.events(spark, sf).where("event_id % 3 = 0").select(
        F.concat(F.lit("https://site/item/"), (F.col("user_id") * 10 + F.col("k") % 10).cast("string"), F.lit("?x=1")).alias("page_url"),
        F.lit("").alias("url"), F.col("event_id").alias("pos"), F.concat(F.lit("rec "), F.col("k").cast("string")).alias("title"),
        F.when(t == "purchase", "downloaded").when(t == "error", "failed").when(t == "signup", "skipped").otherwise("pending").alias("status"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("r"), F.col("k").cast("string"))).alias("error"),
    )
    return qu.merge_queue_status(_merged(spark, sf).where("file = 0"), r, BASE)


@case("set_3_collect_queue", """
WITH old AS (SELECT url, title, status, pos FROM fx_queue WHERE file = 0 AND pos % 4 = 0),
n AS (SELECT url, title, pos FROM fx_queue WHERE file = 1 AND regexp_matches(lower(title || ' ' || url), 'view 1|view 2') AND NOT contains(title, '3')),
f AS (SELECT url, arg_min(title, pos) AS title, min(pos) AS pos FROM n GROUP BY url)
SELECT * FROM old UNION ALL SELECT url, title, 'pending', pos FROM f WHERE url NOT IN (SELECT url FROM old)""")
def _(spark, sf):
    q = fx.queue(spark, sf)
    old = q.where("file = 0 AND pos % 4 = 0").select("url", "title", "status", "pos")
    return qu.collect_queue(old, q.where("file = 1 AND title NOT LIKE '%3%'").select("url", "title", "pos"), ["view 1", "view 2"], [])


@case("top_8_next_pending", """SELECT pos, url, CASE WHEN pos IN (SELECT pos FROM fx_queue WHERE status = 'pending' ORDER BY pos LIMIT 25) THEN 'in_progress' ELSE status END AS status
  FROM fx_queue""")
def _(spark, sf):
    return qu.claim_pending(fx.queue(spark, sf), 25).select("pos", "url", "status")


@case("set_2_processed_set", """SELECT DISTINCT url AS address FROM fx_queue WHERE status = 'downloaded'
  UNION SELECT rtrim(page_url, '/') FROM fx_records""")
def _(spark, sf):
    return qu.processed_set(fx.queue(spark, sf).where("status = 'downloaded'").select("url"), fx.records(spark, sf))


@case("top_4_next_item", """
WITH done AS (SELECT DISTINCT url FROM fx_queue WHERE status IN ('downloaded', 'failed')
  UNION SELECT 'https://site/item/' || (user_id * 10 + k % 10) FROM fx_events WHERE event_id % 7 = 0),
i AS (SELECT event_id % 97 AS page, event_id AS index, 'https://site/item/' || (user_id * 10 + k % 10) AS url FROM fx_events),
m AS (SELECT *, url NOT IN (SELECT url FROM done) AS open FROM i)
SELECT page, arg_min(url, index) FILTER (WHERE open) AS next_url, coalesce(min(index) FILTER (WHERE open), -1) AS next_index, count(*) AS total_found,
  count(*) FILTER (WHERE NOT open) AS processed_count, NOT bool_or(open) AS page_done FROM m GROUP BY page""")
def _(spark, sf):
    done = qu.processed_set(
        fx.queue(spark, sf).where("status IN ('downloaded', 'failed')").select("url"),
        fx.events(spark, sf).where("event_id % 7 = 0").select(F.concat(F.lit("https://site/item/"), (F.col("user_id") * 10 + F.col("k") % 10).cast("string")).alias("page_url")),
    )
    items = fx.events(spark, sf).select(
        (F.col("event_id") % 97).alias("page"), F.col("event_id").alias("index"),
        F.concat(F.lit("https://SITE/item/"), (F.col("user_id") * 10 + F.col("k") % 10).cast("string"), F.lit("/#a")).alias("url"),
    )
    return qu.next_item(items, done).withColumn(
        "next_url", F.regexp_replace("next_url", "https://SITE(.*)/#a$", "https://site$1")
    )


# ---- page progress -----------------------------------------------------------------------------

fx.SQL["fx_transitions"] = """
SELECT *, start_index + processed AS reached,
  CASE WHEN start_index + processed >= total_found THEN 'done' WHEN downloaded = 0 AND errors > 0 THEN 'blocked'
       WHEN downloaded = 0 AND skipped >= processed THEN 'done' ELSE 'in_progress' END AS status FROM fx_batches"""
fx.SQL["fx_progress"] = """
WITH p AS (SELECT page, count(*) AS attempts, CAST(sum(downloaded) AS BIGINT) AS downloaded_count, CAST(sum(skipped) AS BIGINT) AS skipped_count,
  CAST(sum(errors) AS BIGINT) AS error_count, arg_max(status, pos) AS status,
  arg_max(CASE WHEN status = 'done' THEN 0 ELSE reached END, pos) AS next_index, bool_or(status <> 'in_progress') AS opened FROM fx_transitions GROUP BY page)
SELECT page, attempts, downloaded_count, skipped_count, error_count, status, next_index FROM p
UNION ALL SELECT page + 1, 0, 0, 0, 0, 'pending', 0 FROM p WHERE opened AND page + 1 NOT IN (SELECT page FROM p)"""


def _progress(spark, sf):
    return pr.fold_batches(fx.batches(spark, sf))


@case("str_10_page_progress_fold", "SELECT * FROM fx_progress")
def _(spark, sf):
    return _progress(spark, sf)


# A bound that cuts into the pages of the fixture.
LAST_PAGE = 18


def _sparse(spark, sf):
    return fx.records(spark, sf).where("source_page IS NULL OR source_page NOT IN (4, 9, 20)")


fx.SQL["fx_frontier"] = """
WITH have AS (SELECT DISTINCT source_page AS page FROM fx_records WHERE source_page NOT IN (4, 9, 20)),
fr AS (SELECT max(page) AS f FROM have WHERE page <= 18),
old AS (SELECT page, CASE WHEN page = 4 THEN 'failed' ELSE status END AS status, next_index FROM fx_progress WHERE page <> 9),
allp AS (SELECT coalesce(old.page, r.range) AS page, old.status, old.next_index FROM old FULL JOIN (SELECT range FROM range(1, (SELECT f + 1 FROM fr)) UNION SELECT page FROM have) r ON r.range = old.page)
SELECT a.page, a.page IN (SELECT page FROM have) AND coalesce(a.status, '') NOT IN ('done', 'blocked') AND a.page < f AS healed,
  a.page NOT IN (SELECT page FROM have) AND coalesce(a.status, '') NOT IN ('done', 'blocked', 'in_progress', 'pending') AND a.page < f AS gap,
  a.page IN (SELECT page FROM have) AND a.page > 18 AS beyond, a.status AS old, a.next_index AS old_index, f FROM allp a, fr"""


def _frontier(spark, sf):
    progress = _progress(spark, sf).where("page <> 9").withColumn(
        "status", F.when(F.col("page") == 4, "failed").otherwise(F.col("status"))
    )
    return pr.reconcile_frontier(_sparse(spark, sf), progress, LAST_PAGE)


@case("str_11_frontier_reconcile", """
SELECT page, healed, gap, beyond, CASE WHEN healed THEN 'done' WHEN page = f AND coalesce(old, '') NOT IN ('done', 'blocked') THEN 'in_progress' WHEN gap THEN 'pending' ELSE old END AS status,
  CASE WHEN healed OR (page = f AND coalesce(old, '') NOT IN ('done', 'blocked')) THEN 0 ELSE coalesce(old_index, 0) END AS next_index FROM fx_frontier""")
def _(spark, sf):
    return _frontier(spark, sf)


@case("str_11_frontier_summary", """SELECT max(f) AS frontier, count(*) FILTER (WHERE healed) AS healed_pages,
  (SELECT count(DISTINCT source_page) FROM fx_records WHERE source_page NOT IN (4, 9, 20) AND source_page <= 18) AS pages_with_records,
  count(*) FILTER (WHERE gap) AS gap_pages, count(*) FILTER (WHERE beyond) AS pages_beyond FROM fx_frontier""")
def _(spark, sf):
    return pr.frontier_summary(_frontier(spark, sf), _sparse(spark, sf), LAST_PAGE)


@case("top_3_next_page", """
SELECT coalesce((SELECT page FROM fx_progress WHERE status IN ('in_progress', 'pending', 'failed') AND page <= 18 ORDER BY status <> 'in_progress', page LIMIT 1),
    (SELECT CASE WHEN max(page) + 1 > 18 THEN 1 ELSE max(page) + 1 END FROM fx_progress WHERE page <= 18)) AS page,
  coalesce((SELECT next_index FROM fx_progress WHERE status IN ('in_progress', 'pending', 'failed') AND page <= 18 ORDER BY status <> 'in_progress', page LIMIT 1), 0) AS next_index""")
def _(spark, sf):
    return pr.next_page(_progress(spark, sf), LAST_PAGE)


@case("fil_16_page_bound", """SELECT event_id, CASE WHEN user_id > 60 THEN 3 ELSE user_id END AS page, CASE WHEN user_id > 60 THEN 0 ELSE k END AS next_index,
  CASE WHEN user_id > 60 AND event_type NOT IN ('blocked', 'done') THEN 'blocked' ELSE event_type END AS status FROM fx_events""")
def _(spark, sf):
    limit = pr.max_reasonable_page(1000)  # 1000 / 25 + 20
    page, index = pr.bound_page(F.col("page"), F.col("next_index"), limit, 3)
    p = fx.events(spark, sf).select("event_id", F.col("user_id").alias("page"), F.col("k").alias("next_index"), F.col("event_type").alias("status"))
    return pr.block_far_pages(p, limit).select("event_id", page.alias("page"), index.alias("next_index"), "status")


@case("agg_14_round_delta", """
WITH t AS (SELECT page, pos, CAST(sum(downloaded) OVER (PARTITION BY page ORDER BY pos) AS BIGINT) AS total FROM fx_batches)
SELECT page, pos, total, coalesce(lag(total) OVER (PARTITION BY page ORDER BY pos), 0) AS before, total - coalesce(lag(total) OVER (PARTITION BY page ORDER BY pos), 0) AS delta,
  greatest(0, 500 - total) AS remaining, total >= 500 AS completed FROM t""")
def _(spark, sf):
    from trailsift.plans import ordered

    totals = ordered.scan(
        fx.batches(spark, sf).select("page", "pos", "downloaded"), ["page"], ["pos"], ordered.position_block("pos", 512),
        [ordered.Scan("total", "sum", F.col("downloaded"))],
    ).drop("downloaded")
    return pr.round_delta(totals, ["page"], "pos", "total", 500)


_streak = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS rn FROM fx_batches),
m AS (SELECT *, max(CASE WHEN NOT ({hit}) THEN rn END) OVER (PARTITION BY page ORDER BY pos) AS miss FROM n)
SELECT page, pos, rn - coalesce(miss, 0) AS {out}{more} FROM m"""


@case("win_5_no_progress_backoff", "SELECT page, pos, idle_rounds, CAST(CASE WHEN idle_rounds > 0 THEN least(30 * 2 ** (idle_rounds - 1), 100) ELSE 0 END AS BIGINT) AS pause, idle_rounds >= 3 AS stop FROM ("
      + _streak.format(hit="downloaded <= 0", out="idle_rounds", more="") + ")")
def _(spark, sf):
    return pr.backoff(fx.batches(spark, sf), ["page"], "pos", "downloaded", 30, 100, 3).select("page", "pos", "idle_rounds", "pause", "stop")


@case("win_6_failure_streak", _streak.format(hit="errors > 0", out="failures", more=", rn - coalesce(miss, 0) >= 2 AS over"))
def _(spark, sf):
    s = pr.streak(fx.batches(spark, sf), ["page"], "pos", F.col("errors") > 0, "failures")
    return s.select("page", "pos", "failures", (F.col("failures") >= 2).alias("over"))


@case("win_12_monotone_index", "SELECT page, pos, max(start_index) OVER (PARTITION BY page ORDER BY pos) AS effective FROM fx_batches")
def _(spark, sf):
    return pr.monotone_index(fx.batches(spark, sf), ["page"], "pos", "start_index").select("page", "pos", "effective")


METHODS = ["python_direct", "browser_context_fetch", "clean_screenshot"]
fx.SQL["fx_methods"] = """
SELECT user_id % 5 AS site, event_id AS pos, list_extract(['python_direct', 'browser_context_fetch', 'clean_screenshot'],
  CASE WHEN k % 20 < 17 THEN event_id // 400 % 2 + 1 ELSE k % 3 + 1 END) AS method, event_type <> 'error' OR k % 2 = 0 AS ok FROM fx_events"""


@case("win_4_method_lock", """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos) AS rn FROM fx_methods),
f AS (SELECT site, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS pos, '' AS last_method, CAST(0 AS BIGINT) AS streak, '' AS preferred FROM (SELECT DISTINCT site FROM e)
  UNION ALL
  SELECT e.site, e.rn, e.pos, CASE WHEN ok THEN method ELSE last_method END,
    CASE WHEN ok THEN CASE WHEN method = last_method THEN streak + 1 ELSE 1 END WHEN preferred = method THEN 0 ELSE streak END,
    CASE WHEN ok THEN CASE WHEN method = last_method AND streak + 1 >= 5 THEN method ELSE preferred END WHEN preferred = method THEN '' ELSE preferred END
  FROM f JOIN e ON e.site = f.site AND e.rn = f.rn + 1)
SELECT site, pos, streak, nullif(preferred, '') AS preferred FROM f WHERE rn > 0""")
def _(spark, sf):
    return methodlock.method_lock(_method_events(spark, sf), METHODS, block_rows=512).select("site", "pos", "streak", "preferred")


def _method_events(spark, sf):
    k = F.col("k")
    index = F.when(k % 20 < 17, F.floor(F.col("event_id") / 400) % 2 + 1).otherwise(k % 3 + 1)
    return fx.events(spark, sf).select(
        (F.col("user_id") % 5).alias("site"), F.col("event_id").alias("pos"),
        F.element_at(F.array(*[F.lit(m) for m in METHODS]), index.cast("int")).alias("method"),
        ((F.col("event_type") != "error") | (k % 2 == 0)).alias("ok"),
    )


@case("udf_4_method_order", """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos) AS rn, count(*) OVER (PARTITION BY site) AS n FROM fx_methods),
f AS (SELECT site, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS n, '' AS last_method, CAST(0 AS BIGINT) AS streak, '' AS preferred FROM (SELECT DISTINCT site FROM e)
  UNION ALL
  SELECT e.site, e.rn, e.n, CASE WHEN ok THEN method ELSE last_method END,
    CASE WHEN ok THEN CASE WHEN method = last_method THEN streak + 1 ELSE 1 END WHEN preferred = method THEN 0 ELSE streak END,
    CASE WHEN ok THEN CASE WHEN method = last_method AND streak + 1 >= 5 THEN method ELSE preferred END WHEN preferred = method THEN '' ELSE preferred END
  FROM f JOIN e ON e.site = f.site AND e.rn = f.rn + 1)
SELECT site, CASE preferred WHEN 'browser_context_fetch' THEN 'browser_context_fetch,python_direct,clean_screenshot'
  WHEN 'clean_screenshot' THEN 'clean_screenshot,python_direct,browser_context_fetch' ELSE 'python_direct,browser_context_fetch,clean_screenshot' END AS methods
FROM f WHERE rn = n""")
def _(spark, sf):
    locked = methodlock.method_lock(_method_events(spark, sf), METHODS)
    final = locked.groupBy("site").agg(F.max_by("preferred", "pos").alias("preferred"))
    return final.select("site", F.array_join(methodlock.method_order(F.col("preferred"), METHODS), ",").alias("methods"))


# ---- run histories -----------------------------------------------------------------------------


def _steps(spark, sf):
    a = hi.number_steps(fx.actions(spark, sf))
    total = a.groupBy("run").agg(F.count("*").alias("steps"))
    last = F.col("step") == F.col("steps")
    return a.join(total, "run").select(
        "run", "pos", "step", "name", "params", "error", "seconds", "url", "k",
        last.alias("is_done"), (F.col("k") % 2 == 0).alias("success"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("c"), F.col("k").cast("string"))).alias("extracted"),
        F.when(last & (F.col("k") % 5 < 3), F.col("k") % 5 == 1).alias("verdict"),
    )


_EXEMPT = "(SELECT * FROM fx_hashed WHERE name <> 'wait')"


@case("win_1_loop_detector", f"""
WITH a AS (SELECT run, pos, action_hash AS h, row_number() OVER (PARTITION BY run ORDER BY pos) AS rn FROM {_EXEMPT}),
p AS (SELECT a.run, a.pos, b.h, count(*) AS c, min(b.rn) AS first FROM a JOIN a b ON a.run = b.run AND b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY a.run, a.pos, b.h),
m AS (SELECT run, pos, max(c) AS repetitions, arg_min(h, -c * 100000000 + first) AS most_repeated FROM p GROUP BY run, pos)
SELECT run, pos, repetitions, most_repeated, CASE WHEN repetitions >= 12 THEN 3 WHEN repetitions >= 8 THEN 2 WHEN repetitions >= 5 THEN 1 ELSE 0 END AS tier FROM m""")
def _(spark, sf):
    return hi.loop_detector(fx.actions(spark, sf)).select("run", "pos", F.col("repetitions").cast("bigint"), "most_repeated", "tier")


@case("win_2_page_stagnation", """
WITH a AS (SELECT run, pos, url || dom_text || element_count AS f, row_number() OVER (PARTITION BY run ORDER BY pos) AS rn FROM fx_actions),
b AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY run ORDER BY pos) THEN rn END AS s FROM a),
c AS (SELECT run, pos, rn - max(s) OVER (PARTITION BY run ORDER BY pos) AS stagnant FROM b)
SELECT run, pos, stagnant, stagnant >= 5 AS flagged FROM c""")
def _(spark, sf):
    return hi.page_stagnation(fx.actions(spark, sf)).select("run", "pos", "stagnant", "flagged")


@case("win_3_redundant_retry", """
WITH a AS (SELECT run, pos, name, error, CASE WHEN k % 4 > 0 THEN 'h' || (k % 6) END AS eh, CASE WHEN k % 5 > 0 THEN 's' || (k % 3) END AS sh, 'x' || (k % 7) AS xp FROM fx_actions),
b AS (SELECT *, lag(error) OVER w AS pe, lag(eh) OVER w AS peh, lag(sh) OVER w AS psh, lag(xp) OVER w AS pxp, lag(name) OVER w AS pn FROM a WINDOW w AS (PARTITION BY run ORDER BY pos))
SELECT run, pos, coalesce(pe IS NULL AND eh IS NOT NULL AND peh IS NOT NULL AND (eh = peh OR coalesce(sh = psh, false) OR xp = pxp) AND name = pn, false) AS redundant FROM b""")
def _(spark, sf):
    k = F.col("k")
    s = fx.actions(spark, sf).select(
        "run", "pos", "name", "error",
        F.when(k % 4 > 0, F.concat(F.lit("h"), (k % 6).cast("string"))).alias("element_hash"),
        F.when(k % 5 > 0, F.concat(F.lit("s"), (k % 3).cast("string"))).alias("stable_hash"),
        F.concat(F.lit("x"), (k % 7).cast("string")).alias("x_path"),
    )
    return hi.redundant_retry(s).select("run", "pos", "redundant")


fx.SQL["fx_history"] = """
SELECT run, pos, step, name, params, error, seconds, url, k, step = steps AS is_done, k % 2 = 0 AS success,
  CASE WHEN k % 3 <> 0 THEN 'c' || k END AS extracted, CASE WHEN step = steps AND k % 5 < 3 THEN k % 5 = 1 END AS verdict FROM fx_steps"""
fx.SQL["fx_summary"] = """
SELECT run, count(*) AS steps, round(sum(seconds), 5) AS seconds, count(error) AS error_steps, count(error) > 0 AS has_errors, arg_max(name, step) AS last_action,
  true AS is_done, arg_max(success, step) AS is_successful, max(CASE WHEN is_done THEN extracted END) AS final_result, bool_or(verdict) AS verdict FROM fx_history GROUP BY run"""


@case("agg_9_run_summary", "SELECT * FROM fx_summary")
def _(spark, sf):
    return hi.run_summary(_steps(spark, sf)).withColumn("seconds", F.round("seconds", 5))


@case("agg_9_run_errors", "SELECT run, step, error FROM fx_history WHERE error IS NOT NULL")
def _(spark, sf):
    return hi.run_errors(_steps(spark, sf))


@case("agg_9_run_urls", "SELECT run, step, url FROM fx_history WHERE url <> ''")
def _(spark, sf):
    return hi.run_urls(_steps(spark, sf))


@case("agg_9_step_actions", "SELECT run, pos // 50 AS step, row_number() OVER (PARTITION BY run, pos // 50 ORDER BY pos) AS nth, name FROM fx_actions")
def _(spark, sf):
    return hi.step_actions(fx.actions(spark, sf).withColumn("step", F.floor(F.col("pos") / 50).cast("bigint")))


@case("agg_9_judgements", """SELECT run, arg_max(verdict, step) AS verdict, max(step) AS judged_at, count(*) AS times, min(verdict) <> max(verdict) AS changed
  FROM fx_history WHERE verdict IS NOT NULL GROUP BY run""")
def _(spark, sf):
    return hi.judgements(_steps(spark, sf))


@case("agg_9_run_contents", "SELECT run, step, extracted FROM fx_history WHERE extracted IS NOT NULL")
def _(spark, sf):
    return hi.run_contents(_steps(spark, sf))


@case("agg_9_action_counts", "SELECT run, name, count(*) AS n FROM fx_actions GROUP BY run, name")
def _(spark, sf):
    return hi.action_counts(fx.actions(spark, sf))


@case("agg_10_filter_actions", "SELECT run, pos, name FROM fx_actions WHERE name IN ('click', 'wait') UNION ALL SELECT run, pos, name FROM fx_actions WHERE name = 'click'")
def _(spark, sf):
    return hi.filter_actions(fx.actions(spark, sf), ["click", "wait", "click"]).select("run", "pos", "name")


@case("agg_11_agent_event", """
WITH t AS (SELECT conv_id AS run, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) AS calls
  FROM fx_usage GROUP BY conv_id)
SELECT s.run, steps, error_steps, is_done, verdict, prompt_tokens, completion_tokens, calls FROM fx_summary s LEFT JOIN t USING (run)""")
def _(spark, sf):
    # A conversation is the talk of the run with its number.
    tokens = us.usage_for_run(fx.usage(spark, sf).withColumnRenamed("conv_id", "run"))
    return hi.agent_event(hi.run_summary(_steps(spark, sf)), tokens).select(
        "run", "steps", "error_steps", "is_done", "verdict", "prompt_tokens", "completion_tokens", "calls"
    )


@case("agg_19_expected_elements", """SELECT run, pos // 50 AS step, CAST(coalesce(least(max(CASE WHEN name IN ('click', 'input') THEN k % 6 END) + 1, 50), 0) AS BIGINT) AS expected
  FROM fx_actions GROUP BY run, pos // 50""")
def _(spark, sf):
    grouped = fx.actions(spark, sf).withColumn("step", F.floor(F.col("pos") / 50).cast("bigint"))
    return hi.expected_elements(grouped)


@case("j_20_secret_name_of", """SELECT run, pos, CASE url WHEN 'https://h/1' THEN 'one' WHEN 'https://h/2' THEN 'two' END AS secret_name FROM fx_actions""")
def _(spark, sf):
    secrets = spark.createDataFrame(
        [(0, "one", "https://h/1"), (1, "again", "https://h/1"), (2, "two", "https://h/2"), (3, "none", "")], "ord int, name string, value string"
    )
    return hi.secret_name_of(fx.actions(spark, sf), secrets, "url").select("run", "pos", "secret_name")


@case("j_21_zip_steps", """SELECT event_id, least(k % 4, k % 3, k % 5) AS pairs,
  array_to_string(list_transform(range(1, least(k % 4, k % 3, k % 5) + 1), lambda i: 'a' || i || 'e' || (i * 2)), ',') AS shown FROM fx_events""")
def _(spark, sf):
    k = F.col("k")

    def upto(n, f):
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), f)).otherwise(F.array().cast("array<string>"))

    e = fx.events(spark, sf).select(
        "event_id",
        upto(k % 4, lambda i: F.concat(F.lit("a"), i.cast("string"))).alias("actions"),
        upto(k % 3, lambda i: F.concat(F.lit("e"), (i * 2).cast("string"))).alias("elements"),
        upto(k % 5, lambda i: F.lit("r")).alias("results"),
    )
    z = e.select("event_id", hi.zip_steps(["actions", "elements", "results"]))
    return z.select(
        "event_id", F.size("zipped").cast("bigint").alias("pairs"),
        F.array_join(F.transform("zipped", lambda x: F.concat(x["actions"], x["elements"])), ",").alias("shown"),
    )


@case("win_9_keep_first_last", """
SELECT run, step AS nth, name AS text FROM fx_steps WHERE steps <= 10 OR step = 1 OR step > steps - 9
UNION ALL SELECT DISTINCT run, CAST(2 AS BIGINT), '[... ' || (steps - 10) || ' previous steps omitted...]' FROM fx_steps WHERE steps > 10""")
def _(spark, sf):
    return hi.keep_first_last(fx.actions(spark, sf), 10, text="name")


@case("win_9_last_n", "SELECT run, pos FROM fx_steps WHERE step > steps - 7")
def _(spark, sf):
    return hi.last_n(fx.actions(spark, sf), 7).select("run", "pos")


@case("win_10_unique_names", """
WITH a AS (SELECT run, pos, CASE WHEN k % 10 = 0 THEN 'click_2' ELSE name END AS name FROM fx_actions),
n AS (SELECT *, row_number() OVER (PARTITION BY run, name ORDER BY pos) AS rn FROM a),
l AS (SELECT DISTINCT run FROM a WHERE name = 'click_2')
SELECT run, pos, CASE WHEN rn = 1 THEN name ELSE name || '_' || (rn + CASE WHEN name = 'click' AND run IN (SELECT run FROM l) THEN 1 ELSE 0 END) END AS unique_name FROM n""")
def _(spark, sf):
    a = fx.actions(spark, sf).select("run", "pos", F.when(F.col("k") % 10 == 0, "click_2").otherwise(F.col("name")).alias("name"))
    return hi.unique_names(a, ["run"], "name", "pos").select("run", "pos", "unique_name")


@case("win_10_unique_paths", """
WITH a AS (SELECT pos, 'dir' || (run % 3) AS folder, 'scan' || (pos % 40) AS stem, CASE WHEN pos % 5 = 0 THEN '' ELSE '.tif' END AS suffix FROM fx_actions),
p AS (SELECT *, left(sha1(folder || '/' || stem || suffix), 8) AS digest, pos % 40 AS c, row_number() OVER (PARTITION BY folder, stem, suffix ORDER BY pos) AS rn FROM a),
i AS (SELECT *, rn - 1 + CASE WHEN c % 4 = 0 THEN 1 ELSE 0 END AS idx,
  list_filter(range(0, rn + 4), lambda x: NOT ((x = 0 AND c % 3 = 0) OR (x = 2 AND c % 6 = 0))) AS free FROM p),
n AS (SELECT *, CASE WHEN idx > 0 THEN free[idx] END AS number FROM i)
SELECT pos, folder, stem || CASE WHEN number IS NULL THEN '' WHEN number = 0 THEN '_' || digest ELSE '_' || digest || '_' || number END || suffix AS unique_name FROM n""")
def _(spark, sf):
    c = F.col("pos") % 40
    suffix = F.when(F.col("pos") % 5 == 0, "").otherwise(".tif")
    stem = F.concat(F.lit("scan"), c.cast("string"))
    a = fx.actions(spark, sf).select("pos", F.concat(F.lit("dir"), (F.col("run") % 3).cast("string")).alias("folder"), F.concat(stem, suffix).alias("name"), c.alias("c"), stem.alias("stem"), suffix.alias("suffix"))
    digest = F.substring(F.sha1(F.concat_ws("/", "folder", "name")), 1, 8)
    # Files that are there: some names, some hashed names, some with a counter.
    paths = a.select("folder", "name", "c", "stem", "suffix").distinct()
    there = F.array_compact(F.array(
        F.when(F.col("c") % 4 == 0, F.col("name")), F.when(F.col("c") % 3 == 0, F.concat("stem", F.lit("_"), digest, "suffix")),
        F.when(F.col("c") % 6 == 0, F.concat("stem", F.lit("_"), digest, F.lit("_2"), "suffix")),
    ))
    existing = paths.select("folder", F.explode(there).alias("name"))
    return hi.unique_paths(a.select("pos", "folder", "name"), existing, "folder", "name", "pos").select("pos", "folder", "unique_name")


@case("win_11_first_seen", "SELECT run, url, min(pos) AS pos, arg_min(name, pos) AS name FROM fx_actions GROUP BY run, url")
def _(spark, sf):
    return hi.first_seen(fx.actions(spark, sf), ["run", "url"], "pos", ["name"])


@case("fil_17_menu_elements", """SELECT event_id, CASE k % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS opener,
  CASE k % 6 WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN user_id % 2 = 0 ELSE false END AS item FROM fx_events""")
def _(spark, sf):
    k = F.col("k") % 6
    attrs = F.create_map(
        F.lit("aria-haspopup"), F.when(k == 0, "menu").otherwise(""),
        F.lit("class"), F.when(k == 1, "big expand-button").when(k == 4, "Dropdown-row").otherwise("row"),
        F.lit("role"), F.when(k == 2, "menuitem").when(k == 3, "option").otherwise(""),
        F.lit("aria-expanded"), F.when(k == 2, "false").otherwise(""),
    )
    ax = F.when(F.col("user_id") % 2 == 0, "Save")
    return fx.events(spark, sf).select("event_id", hi.menu_opener(attrs).alias("opener"), hi.menu_item(attrs, ax).alias("item"))


# ---- token usage -------------------------------------------------------------------------------

fx.SQL["fx_priced"] = """
SELECT u.*, (prompt_tokens - coalesce(cached_tokens, 0)) * input AS new_prompt_cost, cached_tokens * cache_read AS cached_cost,
  creation_tokens * cache_creation AS creation_cost, completion_tokens * output AS completion_cost,
  (prompt_tokens - coalesce(cached_tokens, 0)) * input + coalesce(cached_tokens * cache_read, 0) + coalesce(creation_tokens * cache_creation, 0) AS prompt_cost
FROM fx_usage u LEFT JOIN fx_prices p ON p.model = u.model"""


def _priced(spark, sf):
    return us.price_usage(fx.usage(spark, sf), *fx.pricing(spark))


@case("j_13_price_usage", """SELECT conv_id, turn, u.model, p.input IS NOT NULL AS priced, p.input * 1e9 AS nano_input, p.output * 1e9 AS nano_output
  FROM fx_usage u LEFT JOIN fx_prices p ON p.model = u.model""")
def _(spark, sf):
    prices = us.price_table(*fx.pricing(spark))
    return fx.usage(spark, sf).join(prices, "model", "left").select(
        "conv_id", "turn", "model", F.col("price").isNotNull().alias("priced"),
        (F.col("price.input") * 1e9).alias("nano_input"), (F.col("price.output") * 1e9).alias("nano_output"),
    )


@case("agg_7_cost_row", """SELECT conv_id, turn, round(new_prompt_cost, 9) AS new_prompt_cost, round(cached_cost, 9) AS cached_cost, round(creation_cost, 9) AS creation_cost,
  round(completion_cost, 9) AS completion_cost, round(prompt_cost + completion_cost, 9) AS total_cost FROM fx_priced""")
def _(spark, sf):
    parts = ["new_prompt_cost", "cached_cost", "creation_cost", "completion_cost", "total_cost"]
    return _priced(spark, sf).select("conv_id", "turn", *[F.round(c, 9).alias(c) for c in parts])


_measures = """CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(cached_tokens, 0)) AS BIGINT) AS cached_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, count(*) AS invocations,
  round(coalesce(sum(prompt_cost), 0), 6) AS prompt_cost, round(coalesce(sum(completion_cost), 0), 6) AS completion_cost,
  round(coalesce(sum(prompt_cost + completion_cost), 0), 6) AS total_cost,
  round(coalesce(sum(prompt_cost + completion_cost), 0) + coalesce(sum(cached_cost), 0), 6) AS total_cost_ref,
  round(sum(prompt_tokens + completion_tokens) / count(*), 4) AS average_tokens"""


@case("agg_6_usage_summary", f"SELECT model, CAST(0 AS TINYINT) AS overall, {_measures} FROM fx_priced GROUP BY model UNION ALL SELECT NULL, CAST(1 AS TINYINT), {_measures} FROM fx_priced")
def _(spark, sf):
    out = us.usage_summary(_priced(spark, sf))
    costs = ["prompt_cost", "completion_cost", "total_cost", "total_cost_ref"]
    return out.select(
        "model", "overall", "prompt_tokens", "cached_tokens", "completion_tokens", "total_tokens", "invocations",
        *[F.round(c, 6).alias(c) for c in costs], F.round("average_tokens", 4).alias("average_tokens"),
    )


@case("agg_8_usage_for_model", """SELECT model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(cached_tokens, 0)) AS BIGINT) AS cached_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM fx_usage GROUP BY model""")
def _(spark, sf):
    return us.usage_for_model(fx.usage(spark, sf))


@case("fil_15_usage_filter", "SELECT conv_id, turn FROM fx_usage WHERE model = 'smart' AND epoch >= 1704067260")
def _(spark, sf):
    since = F.timestamp_seconds(F.lit(1704067260))
    return us.usage_filter(fx.usage(spark, sf), "smart", since).select("conv_id", "turn")
