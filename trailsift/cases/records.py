"""Crawl-record catalog over the event-derived records."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from trailsift.cases import fixtures as fx
from trailsift.cases.base import case
from trailsift.functions import text as tx
from trailsift.functions import urls as u
from trailsift.operators import catalog as ca

fx.SQL["fx_old_files"] = """
SELECT * FROM fx_files WHERE file_name IN (SELECT file_name FROM fx_existing) OR starts_with(file_name, 'orphan')"""
fx.SQL["fx_classified"] = """
SELECT r.*, f.file_name AS found_name, f.sha256 AS actual_sha256,
  CASE WHEN r.status <> 'downloaded' THEN 'skipped' WHEN f.file_name IS NULL THEN 'no_file'
       WHEN r.sha256 <> f.sha256 THEN 'hash_mismatch' ELSE 'imported' END AS outcome
FROM fx_records r LEFT JOIN fx_files f ON f.file_name = r.file_name AND r.status = 'downloaded'"""
fx.SQL["fx_orphans"] = """
SELECT * FROM fx_files WHERE sha256 NOT IN (SELECT actual_sha256 FROM fx_classified WHERE outcome = 'imported')
  AND file_name NOT IN (SELECT found_name FROM fx_classified WHERE outcome = 'imported')"""


def _old_files(spark, sf):
    old, _ = fx.halves(spark, sf)
    files = fx.files(spark, sf)
    return files.join(old.select("file_name"), "file_name", "left_semi").unionByName(
        files.where(F.col("file_name").startswith("orphan"))
    )


def _classified(spark, sf):
    return ca.classify_import(fx.records(spark, sf), fx.files(spark, sf))


def _orphans(spark, sf):
    return ca.orphans(fx.files(spark, sf), _classified(spark, sf).where("outcome = 'imported'"))


@case(
    "slice_0_items_per_site",
    """WITH p AS (SELECT page_id, url, sha256(html) AS h, regexp_replace(url, '#.*$', '') AS n FROM pages),
      q AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS site,
        row_number() OVER (PARTITION BY rtrim(regexp_replace(n, '^([a-z]+://[^/?]*)', lower(regexp_extract(n, '^([a-z]+://[^/?]*)', 1))), '/') ORDER BY page_id) AS nu,
        row_number() OVER (PARTITION BY h ORDER BY page_id) AS nh FROM p)
      SELECT site, count(*) AS pages, count(*) FILTER (WHERE nu > 1) AS same_address,
        count(*) FILTER (WHERE nu = 1 AND nh > 1) AS same_content, count(*) FILTER (WHERE nu = 1 AND nh = 1) AS items
      FROM q GROUP BY site""",
)
def _(spark, sf):
    pages = fx.table(spark, sf, "pages").select(
        "page_id", u.host(F.col("url")).alias("site"), u.normalize_url(F.col("url")).alias("address"),
        F.sha2("html", 256).alias("content"),
    )
    first = [pages.groupBy(k).agg(F.min("page_id").alias(f"first_{k}")) for k in ("address", "content")]
    marked = pages.join(first[0], "address").join(first[1], "content")
    again = F.col("first_address") < F.col("page_id")
    copy = ~again & (F.col("first_content") < F.col("page_id"))
    return marked.groupBy("site").agg(
        F.count("*").alias("pages"), F.count_if(again).alias("same_address"),
        F.count_if(copy).alias("same_content"), F.count_if(~again & ~copy).alias("items"),
    )


@case("src_2_downloaded", "SELECT pos, title FROM fx_records WHERE status = 'downloaded'")
def _(spark, sf):
    return ca.downloaded(fx.records(spark, sf), titled=True).select("pos", "title")


@case("j_1_resolve_files", """
WITH r AS (SELECT pos, title, CASE WHEN pos % 3 = 0 THEN '' ELSE file_name END AS file_name,
             CASE WHEN pos % 5 = 0 THEN '/data/img/item_' || (pos + 1) || '_click.jpg' ELSE '' END AS file_path FROM fx_records),
c AS (SELECT r.pos, 0 AS p, f.file_name AS found_name FROM r JOIN fx_files f ON f.file_name = regexp_replace(r.file_path, '^.*/', '')
  UNION ALL SELECT r.pos, 1, f.file_name FROM r JOIN fx_files f ON f.file_name = r.file_name
  UNION ALL SELECT r.pos, 2, f.file_name FROM r JOIN fx_files f ON f.file_name = r.title || '.jpg')
SELECT r.pos, (SELECT arg_min(found_name, p) FROM c WHERE c.pos = r.pos) AS found_name FROM r""")
def _(spark, sf):
    r = fx.records(spark, sf).select(
        "pos", "title",
        F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("file_name")).alias("file_name"),
        F.when(F.col("pos") % 5 == 0, F.concat(F.lit("/data/img/item_"), (F.col("pos") + 1).cast("string"), F.lit("_click.jpg"))).alias("file_path"),
    )
    return ca.resolve_files(r, fx.files(spark, sf), ["file_path", "file_name"]).select("pos", "found_name")


@case("j_3_orphans", "SELECT file_name, sha256 FROM fx_orphans")
def _(spark, sf):
    return _orphans(spark, sf).select("file_name", "sha256")


@case("j_3_orphans_by_name", """SELECT file_name FROM fx_files WHERE file_name NOT IN (SELECT file_name FROM fx_records WHERE status = 'downloaded')
  AND regexp_replace(file_name, '\\.[^.]*$', '') NOT IN (SELECT title FROM fx_records WHERE status = 'downloaded')""")
def _(spark, sf):
    return ca.orphans_by_name(fx.files(spark, sf), fx.records(spark, sf)).select("file_name")


@case("j_4_dedup_new", """
WITH old AS (SELECT * FROM fx_existing WHERE status = 'downloaded'),
a AS (SELECT pos, sha256, CASE WHEN image_url IN (SELECT image_url FROM old) THEN 'image_url'
        WHEN sha256 IN (SELECT sha256 FROM old) THEN 'content'
        WHEN sha256 IN (SELECT sha256 FROM fx_old_files) THEN 'file' END AS rule FROM fx_incoming)
SELECT pos, coalesce(rule, CASE WHEN row_number() OVER (PARTITION BY sha256, rule ORDER BY pos) > 1 THEN 'content' END) AS reason FROM a""")
def _(spark, sf):
    old, new = fx.halves(spark, sf)
    return ca.dedup_new(new, old, _old_files(spark, sf)).select("pos", "reason")


@case("j_5_hash_mismatch", "SELECT pos, sha256, actual_sha256 FROM fx_classified WHERE outcome = 'hash_mismatch'")
def _(spark, sf):
    return ca.hash_mismatch(fx.records(spark, sf), fx.files(spark, sf)).select("pos", "sha256", "actual_sha256")


@case("j_6_known_urls", """SELECT pos, page_url IN (SELECT page_url FROM fx_existing WHERE pos % 2 = 0) AS known FROM fx_incoming""")
def _(spark, sf):
    old, new = fx.halves(spark, sf)
    return ca.known_urls(new, old.where("pos % 2 = 0")).select("pos", "known")


@case("j_7_backfill", """
WITH r AS (SELECT sequence, CASE WHEN pos % 4 = 0 THEN '  ' ELSE page_url END AS page_url, CASE WHEN pos % 6 = 0 THEN '' ELSE image_url END AS image_url FROM fx_records),
l AS (SELECT sequence, page_url AS lp, CASE WHEN pos % 9 = 0 THEN '' ELSE image_url END AS li FROM fx_records WHERE pos % 2 = 0)
SELECT sequence, CASE WHEN trim(page_url) = '' AND lp IS NOT NULL THEN lp ELSE page_url END AS page_url,
  CASE WHEN trim(image_url) = '' AND coalesce(li, '') <> '' THEN li ELSE image_url END AS image_url,
  concat_ws(',', CASE WHEN trim(page_url) = '' AND lp IS NOT NULL THEN 'page_url' END,
    CASE WHEN trim(image_url) = '' AND coalesce(li, '') <> '' THEN 'image_url' END) AS updated
FROM r LEFT JOIN l USING (sequence)""")
def _(spark, sf):
    base = fx.records(spark, sf)
    r = base.select(
        "sequence",
        F.when(F.col("pos") % 4 == 0, "  ").otherwise(F.col("page_url")).alias("page_url"),
        F.when(F.col("pos") % 6 == 0, "").otherwise(F.col("image_url")).alias("image_url"),
    )
    log = base.where("pos % 2 = 0").select(
        "sequence", "page_url", F.when(F.col("pos") % 9 == 0, "").otherwise(F.col("image_url")).alias("image_url")
    )
    return ca.backfill(r, log).select("sequence", "page_url", "image_url", F.array_join("updated_fields", ",").alias("updated"))


_images = """
SELECT sha256, 'img_' || substr(sha256, 1, 16) AS id, min(pos) AS imported_at, max(pos) AS updated_at, arg_max(title, pos) AS title, arg_max(file_size, pos) AS file_size"""


def _upsert_inputs(spark, sf):
    def shaped(df):
        return df.select(
            "sha256", tx.row_id(F.col("sha256"), "img_").alias("id"), F.col("pos").alias("imported_at"),
            F.col("pos").alias("updated_at"), "title", "file_size", "pos",
        )

    old, new = (shaped(ca.downloaded(d)) for d in fx.halves(spark, sf))
    none = old.limit(0).drop("pos")
    return ca.upsert_by_key(none, old, "sha256", "pos"), new


@case("j_8_upsert_by_key", """
WITH o AS (SELECT sha256, max(pos) AS p, arg_max(title, pos) AS t, arg_max(file_size, pos) AS s FROM fx_existing WHERE status = 'downloaded' GROUP BY 1),
n AS (SELECT sha256, max(pos) AS p, arg_max(title, pos) AS t, arg_max(file_size, pos) AS s FROM fx_incoming WHERE status = 'downloaded' GROUP BY 1)
SELECT coalesce(n.sha256, o.sha256) AS sha256, 'img_' || substr(coalesce(n.sha256, o.sha256), 1, 16) AS id,
  coalesce(o.p, n.p) AS imported_at, coalesce(n.p, o.p) AS updated_at, coalesce(n.t, o.t) AS title, coalesce(n.s, o.s) AS file_size
FROM o FULL JOIN n ON o.sha256 = n.sha256""")
def _(spark, sf):
    target, new = _upsert_inputs(spark, sf)
    return ca.upsert_by_key(target, new, "sha256", "pos")


@case("j_11_update_by_sequence", """
WITH n AS (SELECT pos % 5000 + 1 AS sequence, arg_max('new_' || title, pos) AS new_name FROM fx_records WHERE pos % 3 = 1 GROUP BY 1)
SELECT r.sequence, coalesce(n.new_name, r.file_name) AS file_name, CASE WHEN n.new_name IS NOT NULL THEN coalesce(
  CASE WHEN r.pos % 2 = 0 THEN 'first.jpg' END, r.file_name) ELSE CASE WHEN r.pos % 2 = 0 THEN 'first.jpg' END END AS original_file_name
FROM fx_records r LEFT JOIN n ON n.sequence = r.sequence""")
def _(spark, sf):
    r = fx.records(spark, sf)
    renames = r.where("pos % 3 = 1").select(
        (F.col("pos") % 5000 + 1).alias("sequence"), F.concat(F.lit("new_"), "title").alias("new_name"), F.col("pos").alias("order")
    )
    base = r.select("sequence", "file_name", F.when(F.col("pos") % 2 == 0, "first.jpg").alias("original_file_name"))
    return ca.update_by_sequence(base, renames)


@case("j_22_gap_fill", """
WITH u AS (SELECT DISTINCT k * 7 + 1 AS n FROM fx_events)
SELECT range AS n FROM range(1, 1001) WHERE range NOT IN (SELECT n FROM u)""")
def _(spark, sf):
    used = fx.events(spark, sf).select((F.col("k") * 7 + 1).alias("n"))
    return ca.missing_numbers(used, "n", 1000)


@case("agg_1_catalog_stats", r"""
SELECT 'status' AS kind, status AS key, count(*) AS n FROM fx_records GROUP BY status
UNION ALL SELECT 'site', regexp_extract(page_url, '//([^/]*)', 1), count(*) FROM fx_records GROUP BY 2
UNION ALL SELECT 'total', 'downloaded_bytes', CAST(coalesce(sum(file_size), 0) AS BIGINT) FROM fx_records WHERE status = 'downloaded'
UNION ALL SELECT 'total', 'orphans', count(*) FROM fx_orphans""")
def _(spark, sf):
    return ca.catalog_stats(fx.records(spark, sf), _orphans(spark, sf))


@case("agg_3_duplicate_hash_groups", """
SELECT * FROM (SELECT sha256, file_name, count(*) OVER (PARTITION BY sha256) AS copies,
  row_number() OVER (PARTITION BY sha256 ORDER BY lower(file_name), file_name) AS nth FROM fx_files) WHERE copies > 1""")
def _(spark, sf):
    return ca.duplicate_hash_groups(fx.files(spark, sf))


@case("agg_4_record_index", """
WITH d AS (SELECT * FROM fx_records WHERE status = 'downloaded')
SELECT 'image_url' AS kind, image_url AS key, arg_max(sequence, pos) AS sequence, count(*) AS records FROM d GROUP BY image_url
UNION ALL SELECT 'content', sha256, arg_max(sequence, pos), count(*) FROM d GROUP BY sha256
UNION ALL SELECT 'source', sha256(rtrim(page_url, '/') || '|' || image_url || '|0'), arg_max(sequence, pos), count(*) FROM d GROUP BY 2""")
def _(spark, sf):
    return ca.record_index(fx.records(spark, sf))


@case("agg_5_next_sequence", r"""
SELECT greatest((SELECT max(sequence) FROM fx_records WHERE status = 'downloaded'),
  (SELECT max(try_cast(regexp_extract(file_name, '(?i)^orphan_(\d+)([_-].*)?\.', 1) AS BIGINT)) FROM fx_files WHERE starts_with(file_name, 'orphan'))) + 1 AS next_sequence""")
def _(spark, sf):
    return ca.next_sequence(fx.records(spark, sf), fx.files(spark, sf), "orphan")


@case("agg_12_validate_completeness", """
SELECT (SELECT count(*) FROM fx_records WHERE status = 'downloaded') AS downloaded_records,
  (SELECT count(*) FROM fx_files) AS image_files,
  (SELECT count(*) FROM fx_files WHERE file_size < 10240 OR width < 200 OR height < 200) AS bad_files,
  (SELECT count(*) FROM (SELECT sha256 FROM fx_files GROUP BY 1 HAVING count(*) > 1)) AS duplicate_groups,
  5000 - (SELECT count(*) FROM fx_records WHERE status = 'downloaded' AND sequence <= 5000) AS missing_sequences,
  (SELECT count(*) FROM fx_files WHERE file_name NOT IN (SELECT file_name FROM fx_records WHERE status = 'downloaded')) AS orphan_files,
  greatest(0, 5000 - (SELECT count(*) FROM fx_records WHERE status = 'downloaded')) AS remaining_records, false AS complete""")
def _(spark, sf):
    return ca.validate_completeness(fx.records(spark, sf), fx.files(spark, sf), 5000)


@case("agg_13_import_run_stats", """
SELECT count(*) AS total_records, count(*) FILTER (WHERE outcome = 'imported') AS imported_count,
  count(*) FILTER (WHERE outcome = 'skipped') AS skipped_count,
  count(*) FILTER (WHERE outcome IN ('no_file', 'hash_mismatch')) AS error_count,
  (SELECT count(*) FROM fx_orphans) AS orphan_count, 'completed_with_errors' AS status FROM fx_classified""")
def _(spark, sf):
    return ca.import_run_stats(_classified(spark, sf), _orphans(spark, sf))


@case("agg_20_distinct_used", "SELECT DISTINCT source_page FROM fx_records WHERE source_page BETWEEN 1 AND 15")
def _(spark, sf):
    return ca.used_sequences(fx.records(spark, sf), "source_page", 15)


@case("fil_1_search_catalog", """
WITH h AS (SELECT pos, title, page_url FROM fx_records WHERE (title ILIKE '%m_1%CLI%' OR page_url ILIKE '%m_1%CLI%') AND status = 'downloaded')
SELECT pos, title, (SELECT count(*) FROM h) AS total FROM h ORDER BY title DESC, pos LIMIT 40 OFFSET 40""")
def _(spark, sf):
    return ca.search_catalog(
        fx.records(spark, sf), "m_1%CLI", "downloaded", "title", True, page=2, page_size=40, key="pos"
    ).select("pos", "title", "total")


@case("fil_2_get_by_id", "SELECT 'img_' || substr(sha256(CAST(pos AS VARCHAR)), 1, 16) AS id, pos, title FROM fx_records WHERE pos = 100")
def _(spark, sf):
    images = fx.records(spark, sf).select(tx.row_id(F.sha2(F.col("pos").cast("string"), 256), "img_").alias("id"), "pos", "title")
    return ca.get_by_id(images, "img_" + hashlib.sha256(b"100").hexdigest()[:16])


@case("fil_10_image_quality", """SELECT file_name FROM fx_files WHERE NOT (file_size < 10240 OR width < 200 OR height < 200)""")
def _(spark, sf):
    return ca.image_quality(fx.files(spark, sf)).select("file_name")


@case("top_1_order_records", """SELECT pos, row_number() OVER (ORDER BY coalesce(try_cast(q AS BIGINT), 1000000000), file_name) AS nth
  FROM (SELECT pos, file_name, CASE WHEN pos % 4 = 0 THEN 'x' WHEN pos % 4 = 1 THEN NULL ELSE CAST(pos % 50 AS VARCHAR) END AS q FROM fx_records)""")
def _(spark, sf):
    r = fx.records(spark, sf).select(
        "pos", "file_name",
        F.when(F.col("pos") % 4 == 0, "x").when(F.col("pos") % 4 == 1, F.lit(None)).otherwise((F.col("pos") % 50).cast("string")).alias("sequence"),
    )
    return ca.rank_records(r).select("pos", "nth")


@case("top_5_recent_runs", "SELECT event_id AS id, event_type AS status FROM fx_events ORDER BY ts DESC, event_id LIMIT 25")
def _(spark, sf):
    runs = fx.events(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"))
    return ca.recent_runs(runs, 25).select("id", "status")


@case("set_4_append_recovered", """
WITH r AS (SELECT pos, status, CASE WHEN pos % 2 = 0 THEN sha256(CAST(pos AS VARCHAR)) ELSE sha256 END AS sha256,
   CASE WHEN pos % 5 < 2 THEN (SELECT CASE WHEN r0.pos % 5 = 0 THEN min(file_name) FILTER (WHERE status = 'downloaded') ELSE min(file_name) FILTER (WHERE status <> 'downloaded') END FROM fx_existing)
     ELSE file_name END AS file_name FROM fx_incoming r0)
SELECT pos, status, sha256, file_name FROM fx_existing
UNION ALL SELECT pos, status, sha256, file_name FROM r WHERE sha256 NOT IN (SELECT sha256 FROM fx_existing WHERE status = 'downloaded')
  AND file_name NOT IN (SELECT file_name FROM fx_existing WHERE status = 'downloaded')""")
def _(spark, sf):
    old, new = fx.halves(spark, sf)
    # Some recovered files have the name of a downloaded record, some that of a failed one.
    taken = old.where("status = 'downloaded'").agg(F.min("file_name")).scalar()
    failed = old.where("status <> 'downloaded'").agg(F.min("file_name")).scalar()
    recovered = new.select(
        "pos", "status",
        F.when(F.col("pos") % 2 == 0, F.sha2(F.col("pos").cast("string"), 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(F.col("pos") % 5 == 0, taken).when(F.col("pos") % 5 == 1, failed).otherwise(F.col("file_name")).alias("file_name"),
    )
    return ca.append_recovered(old.select("pos", "status", "sha256", "file_name"), recovered)


@case("win_8_assign_sequences", """
WITH u AS (SELECT DISTINCT sequence * 2 AS n FROM fx_existing WHERE status = 'downloaded' AND pos % 3 <> 0),
free AS (SELECT range AS n, row_number() OVER (ORDER BY range) AS i FROM range(11, (SELECT CAST(max(pos) * 4 + 100 AS BIGINT) FROM fx_records)) WHERE range NOT IN (SELECT n FROM u)),
rows AS (SELECT pos, row_number() OVER (ORDER BY pos) AS i FROM fx_incoming)
SELECT pos, n AS sequence FROM rows JOIN free USING (i)""")
def _(spark, sf):
    old, new = fx.halves(spark, sf)
    used = ca.downloaded(old).where("pos % 3 <> 0").select((F.col("sequence") * 2).alias("sequence"))
    return ca.assign_sequences(new, used, 11).select("pos", "sequence")


@case("win_8_recover_sequences", """
WITH used AS (SELECT DISTINCT sequence * 2 AS n FROM fx_existing WHERE status = 'downloaded' AND pos % 3 <> 0),
f AS (SELECT pos, CASE WHEN pos % 4 = 1 THEN NULL WHEN pos % 4 = 2 THEN pos // 2 ELSE pos * 2 + 5 * (pos % 3) END AS own FROM fx_incoming),
kept AS (SELECT own AS n, min(pos) AS pos FROM f WHERE own >= 1 AND own NOT IN (SELECT n FROM used) GROUP BY own),
reserved AS (SELECT n FROM used UNION SELECT n FROM kept),
free AS (SELECT range AS n, row_number() OVER (ORDER BY range) AS rank FROM range(1, (SELECT CAST(max(n) * 2 + 1000 AS BIGINT) FROM reserved)) WHERE range NOT IN (SELECT n FROM reserved)),
tops AS (
  SELECT f.pos, k.n AS kept, greatest((SELECT max(n) FROM used), coalesce(max(k.n) OVER (ORDER BY f.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS top
  FROM f LEFT JOIN kept k USING (pos)
), movers AS (SELECT pos, top, row_number() OVER (ORDER BY pos) AS i FROM tops WHERE kept IS NULL),
leads AS (SELECT m.pos, i, (SELECT count(*) FROM free WHERE free.n <= m.top) AS below FROM movers m),
ranks AS (SELECT pos, i + 1 + max(below - i) OVER (ORDER BY pos) AS rank FROM leads)
SELECT pos, n AS sequence FROM ranks JOIN free USING (rank) UNION ALL SELECT pos, n FROM kept""")
def _(spark, sf):
    old, new = fx.halves(spark, sf)
    used = ca.downloaded(old).where("pos % 3 <> 0").select((F.col("sequence") * 2).alias("sequence"))
    files = new.select("pos", F.expr("CASE WHEN pos % 4 = 1 THEN NULL WHEN pos % 4 = 2 THEN pos DIV 2 ELSE pos * 2 + 5 * (pos % 3) END").alias("own"))
    return ca.recover_sequences(files, used).select("pos", "sequence")


@case("snk_2_upsert", """
WITH o AS (SELECT sha256, max(pos) AS p FROM fx_existing WHERE status = 'downloaded' GROUP BY 1),
n AS (SELECT sha256, max(pos) AS p, arg_max(title, pos) AS t FROM fx_incoming WHERE status = 'downloaded' GROUP BY 1),
m AS (SELECT sha256, min(p) AS imported_at, max(p) AS updated_at FROM (SELECT * FROM o UNION ALL SELECT sha256, p FROM n) GROUP BY 1)
SELECT sha256, imported_at, updated_at FROM m""")
def _(spark, sf):
    from trailsift.sources import tables

    target, new = _upsert_inputs(spark, sf)
    store = tables.VersionedTable(spark, tables.case_path(spark, "images"))
    store.publish(target)
    store.upsert(new, "sha256", "pos")
    return store.read().select("sha256", "imported_at", "updated_at")


@case("snk_8_run_ledger", """
SELECT 'run-1' AS id, 'completed_with_errors' AS status, count(*) AS total_records,
  count(*) FILTER (WHERE outcome = 'imported') AS imported_count FROM fx_classified""")
def _(spark, sf):
    from trailsift.sources import tables

    ledger = tables.RunLedger(spark, tables.case_path(spark, "ledger"))
    ledger.start("run-1", "records", "images", started_at="2024-01-01T00:00:00+00:00")
    ledger.finish("run-1", ca.import_run_stats(_classified(spark, sf), _orphans(spark, sf)), "2024-01-01T01:00:00+00:00")
    return ledger.read().select("id", "status", "total_records", "imported_count")


@case("top_7_capped_list", """SELECT status, pos, total, total > 20 AS has_more FROM (SELECT status, pos, row_number() OVER (PARTITION BY status ORDER BY pos) AS rn,
  count(*) OVER (PARTITION BY status) AS total FROM fx_records) WHERE rn <= 20""")
def _(spark, sf):
    return ca.capped_list(fx.records(spark, sf).select("status", "pos"), ["status"], "pos", 20)
