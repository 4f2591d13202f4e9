"""Element operators over event-derived trees, and page operators over the page and document tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from trailsift.cases import fixtures as fx
from trailsift.cases.base import case
from trailsift.functions import elements as el
from trailsift.functions import registry as rg
from trailsift.operators import corpus as co
from trailsift.operators import markdown as md
from trailsift.operators import tree
from trailsift.session import scratch_path
from trailsift.sources import html as ht

# ---- element trees ---------------------------------------------------------------------------

fx.SQL["fx_paths"] = """
SELECT n.page_id, n.node_id, coalesce(string_agg(a.tag, '/' ORDER BY x.distance DESC) || '/', '') || any_value(n.tag) AS path
FROM fx_nodes n LEFT JOIN fx_ancestors x ON x.node_id = n.node_id LEFT JOIN fx_nodes a ON a.node_id = x.anc_id GROUP BY n.page_id, n.node_id"""
_STABLE = "CASE WHEN k % 3 = 0 THEN 'box ' ELSE 'box ' END || 'c' || regexp_extract(class, '^c(\\d+)', 1)"
_ATTRS = "'{c}' || CASE WHEN id IS NOT NULL THEN 'id=' || id ELSE '' END || CASE WHEN name IS NOT NULL THEN 'name=' || name ELSE '' END || CASE WHEN role IS NOT NULL THEN 'role=' || role ELSE '' END"
_AX = "CASE WHEN ax_name IS NOT NULL THEN '|ax_name=' || ax_name ELSE '' END"


def _attr_text(cls: str) -> str:
    return "'class=' || " + cls + _ATTRS.replace("'{c}'", "")


fx.SQL["fx_hashed_nodes"] = f"""
SELECT n.*, p.path, substr(sha256(p.path || '|' || {_attr_text('class')} || {_AX}), 1, 16) AS element_hash,
  substr(sha256(p.path || '|' || {_attr_text(_STABLE)} || {_AX}), 1, 16) AS stable_hash,
  substr(sha256(p.path), 1, 16) AS parent_hash FROM fx_nodes n JOIN fx_paths p USING (page_id, node_id)"""


def _hashed(spark, sf):
    return tree.with_hashes(tree.with_path(fx.nodes(spark, sf)))


@case("fn_32_stable_classes", f"SELECT node_id, {_STABLE} AS stable FROM fx_nodes")
def _(spark, sf):
    return fx.nodes(spark, sf).select("node_id", el.stable_classes(F.col("class")).alias("stable"))


@case("fn_33_element_hash", "SELECT node_id, path, element_hash, stable_hash, parent_hash FROM fx_hashed_nodes")
def _(spark, sf):
    return _hashed(spark, sf).select("node_id", F.array_join("path", "/").alias("path"), "element_hash", "stable_hash", "parent_hash")


@case("fil_18_node_skip_rules", """
SELECT node_id FROM fx_nodes n WHERE NOT (tag = 'label' AND k % 3 = 0) AND NOT EXISTS (
  SELECT 1 FROM fx_ancestors x JOIN fx_nodes a ON a.node_id = x.anc_id WHERE x.node_id = n.node_id AND a.tag = 'label' AND a.k % 3 = 0)""")
def _(spark, sf):
    # Some labels are made style elements, which the rule drops with all that is inside.
    n = fx.nodes(spark, sf).withColumn("tag", F.when((F.col("tag") == "label") & (F.col("k") % 3 == 0), "style").otherwise(F.col("tag")))
    return tree.drop_subtrees(n, tree.skip_rule()).select("node_id")


@case("win_13_xpath", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY page_id, parent_id, tag ORDER BY ord) AS rn, count(*) OVER (PARTITION BY page_id, parent_id, tag) AS c FROM fx_nodes),
t AS (SELECT *, tag || CASE WHEN c > 1 AND parent_id IS NOT NULL THEN '[' || rn || ']' ELSE '' END AS step FROM s)
SELECT n.node_id, coalesce(string_agg(a.step, '/' ORDER BY x.distance DESC) || '/', '') || any_value(n.step) AS xpath
FROM t n LEFT JOIN fx_ancestors x ON x.node_id = n.node_id LEFT JOIN t a ON a.node_id = x.anc_id GROUP BY n.node_id""")
def _(spark, sf):
    return tree.with_xpath(fx.nodes(spark, sf)).select("node_id", "xpath")


@case("pg_14_subtree_text", """
WITH r AS (SELECT node_id, anc_id FROM fx_ancestors UNION ALL SELECT node_id, node_id FROM fx_nodes)
SELECT r.anc_id AS node_id, string_agg(n.text, chr(10) ORDER BY n.ord) AS subtree_text FROM r JOIN fx_nodes n ON n.node_id = r.node_id GROUP BY r.anc_id""")
def _(spark, sf):
    return tree.subtree_text(fx.nodes(spark, sf)).select("node_id", "subtree_text")


@case("pg_14_subtree_text_depth", """
WITH r AS (SELECT node_id, anc_id FROM fx_ancestors WHERE distance = 1 UNION ALL SELECT node_id, node_id FROM fx_nodes)
SELECT r.anc_id AS node_id, string_agg(n.text, chr(10) ORDER BY n.ord) AS subtree_text FROM r JOIN fx_nodes n ON n.node_id = r.node_id GROUP BY r.anc_id""")
def _(spark, sf):
    return tree.subtree_text(fx.nodes(spark, sf), 1).select("node_id", "subtree_text")


def _interactive(spark, sf):
    k = F.col("k")
    prop = F.struct(F.when(k % 11 == 0, "disabled").when(k % 11 == 1, "focusable").otherwise("level").alias("name"), (k % 2 == 0).alias("value"))
    n = fx.nodes(spark, sf).withColumns(
        {
            "js_listener": k % 23 == 0,
            "ax_props": F.array(F.struct(F.lit("level").alias("name"), F.lit(True).alias("value")), prop),
            "ax_role": F.when(k % 13 == 0, "listbox"),
            "cursor": F.when(k % 17 == 0, "pointer").otherwise("auto"),
        }
    )
    search = F.when(F.col("node_id") % 29 == 0, F.concat("class", F.lit(" Search-box"))).otherwise(F.col("class"))
    return n.withColumn("attrs", F.map_concat(F.map_filter("attrs", lambda name, v: name != "class"), F.create_map(F.lit("class"), search)))


@case("fil_11_is_interactive", """
WITH w AS (SELECT DISTINCT x.anc_id FROM fx_ancestors x JOIN fx_nodes n ON n.node_id = x.node_id WHERE n.tag = 'input' AND x.distance <= 2)
SELECT node_id, CASE WHEN tag = 'html' THEN false WHEN k % 23 = 0 THEN true
  WHEN tag IN ('label', 'span') AND node_id IN (SELECT anc_id FROM w) THEN true
  WHEN node_id % 29 = 0 THEN true
  WHEN k % 11 = 0 AND k % 2 = 0 THEN false WHEN k % 11 = 1 AND k % 2 = 0 THEN true
  WHEN tag IN ('button', 'input', 'a') THEN true WHEN role = 'button' THEN true WHEN k % 13 = 0 THEN true
  WHEN w BETWEEN 10 AND 50 AND h BETWEEN 10 AND 50 THEN true ELSE k % 17 = 0 END AS interactive FROM fx_nodes""")
def _(spark, sf):
    return tree.is_interactive(_interactive(spark, sf)).select("node_id", "interactive")


@case("fil_12_css_visible", """
SELECT node_id, display <> 'none' AND opacity > 0 AND (tag = 'html' OR (x - 5 < 1280 AND x - 5 + w > 0
  AND y - (page_id % 40) * 50 < 800 + 1000 AND y - (page_id % 40) * 50 + h > -1000)) AS visible FROM fx_nodes""")
def _(spark, sf):
    root = F.col("tag") == "html"
    n = fx.nodes(spark, sf).withColumns(
        {
            "visibility": F.lit("visible"),
            "scroll_x": F.when(root, 5.0), "scroll_y": F.when(root, ((F.col("page_id") % 40) * 50).cast("double")),
            "view_w": F.when(root, 1280.0), "view_h": F.when(root, 800.0),
        }
    )
    return tree.css_visible(n).select("node_id", "visible")


@case("j_18_new_nodes", """SELECT node_id, (tag IN ('a', 'button') AND (node_id % 9 = 0 OR k % 12 = 0)) AS is_new FROM fx_nodes""")
def _(spark, sf):
    n = fx.nodes(spark, sf).withColumn("interactive", F.col("tag").isin("a", "button")).withColumn("compound", F.col("k") % 12 == 0)
    return tree.new_nodes(n, n.where("node_id % 9 <> 0")).select("node_id", "is_new")


@case("j_19_bbox_exclude", """
WITH g AS (SELECT *, x / 4 AS gx, y / 40 AS gy, w * 3 / ((ord + 1) / 2 + 1) AS gw, h * 3 / ((ord + 1) / 2 + 1) AS gh,
    tag IN ('a', 'button') OR (tag IN ('div', 'span') AND coalesce(role, '') = 'button') AS prop FROM fx_nodes),
b AS (SELECT x.node_id, arg_min(a.node_id, x.distance) AS anc FROM fx_ancestors x JOIN g a ON a.node_id = x.anc_id AND a.prop GROUP BY x.node_id),
o AS (SELECT n.node_id, n.tag, n.role, n.prop, CASE WHEN b.anc IS NOT NULL THEN greatest(0.0, least(n.gx + n.gw, a.gx + a.gw) - greatest(n.gx, a.gx)) * greatest(0.0, least(n.gy + n.gh, a.gy + a.gh) - greatest(n.gy, a.gy)) / (n.gw * n.gh) END AS r
  FROM g n LEFT JOIN b ON b.node_id = n.node_id LEFT JOIN g a ON a.node_id = b.anc)
SELECT node_id, coalesce(r >= 0.9, false) AND tag NOT IN ('input', 'label') AND NOT prop AND coalesce(role, '') <> 'button' AS excluded FROM o""")
def _(spark, sf):
    shrink = (F.col("ord") + 1) / 2 + 1
    n = fx.nodes(spark, sf).withColumns(
        {"x": F.col("x") / 4, "y": F.col("y") / 40, "w": F.col("w") * 3 / shrink, "h": F.col("h") * 3 / shrink}
    )
    return tree.bbox_exclude(n, 0.9).select("node_id", "excluded")


_later = """SELECT page_id, node_id, ord, tag, path, ax_name, CASE WHEN k % 4 = 0 THEN 'new ' || class ELSE class END AS class, id, name, role, k,
  element_hash, stable_hash, 'x' || (node_id % 16) AS xpath FROM fx_hashed_nodes WHERE node_id % 9 <> 0"""


@case("j_17_rematch_elements", f"""
WITH hist AS (SELECT page_id, node_id, ord, lower(tag) AS tag, ax_name, name, id, element_hash AS eh, stable_hash AS sh, 'x' || (node_id % 16) AS xp FROM fx_hashed_nodes),
cur AS (SELECT page_id, node_id, ord, lower(tag) AS tag, ax_name, CASE WHEN node_id % 6 <> 0 THEN name END AS name, id,
   CASE WHEN k % 4 = 0 THEN element_hash || 'e' ELSE element_hash END AS eh, CASE WHEN k % 8 = 0 THEN stable_hash || 's' ELSE stable_hash END AS sh,
   'x' || (node_id % 16) || CASE WHEN k % 5 < 4 THEN 'moved' ELSE '' END AS xp FROM fx_hashed_nodes WHERE node_id % 9 <> 0),
m AS (SELECT h.page_id, h.node_id, 1 AS level, c.ord, c.node_id AS mid FROM hist h JOIN cur c ON c.page_id = h.page_id AND c.eh = h.eh
  UNION ALL SELECT h.page_id, h.node_id, 2, c.ord, c.node_id FROM hist h JOIN cur c ON c.page_id = h.page_id AND c.sh = h.sh
  UNION ALL SELECT h.page_id, h.node_id, 3, c.ord, c.node_id FROM hist h JOIN cur c ON c.page_id = h.page_id AND c.xp = h.xp
  UNION ALL SELECT h.page_id, h.node_id, 4, c.ord, c.node_id FROM hist h JOIN cur c ON c.page_id = h.page_id AND c.tag = h.tag AND c.ax_name = h.ax_name
  UNION ALL SELECT h.page_id, h.node_id, 5, c.ord, c.node_id FROM hist h JOIN cur c ON c.page_id = h.page_id AND c.tag = h.tag AND c.name = h.name
  UNION ALL SELECT h.page_id, h.node_id, 6, c.ord, c.node_id FROM hist h JOIN cur c ON c.page_id = h.page_id AND c.tag = h.tag AND c.id = h.id),
b AS (SELECT page_id, node_id, arg_min(mid, level * 1000 + ord) AS match_id, min(level) AS level FROM m GROUP BY page_id, node_id)
SELECT h.node_id, match_id, list_extract(['EXACT', 'STABLE', 'XPATH', 'AX_NAME', 'ATTRIBUTE'], least(level, 5)) AS match_level FROM hist h LEFT JOIN b USING (page_id, node_id)""")
def _(spark, sf):
    h = _hashed(spark, sf).withColumn("xpath", F.concat(F.lit("x"), (F.col("node_id") % 16).cast("string")))
    k = F.col("k")
    later = h.where("node_id % 9 <> 0").withColumns(
        {
            "attrs": F.when(F.col("node_id") % 6 == 0, F.map_filter("attrs", lambda n, v: n != "name")).otherwise(F.col("attrs")),
            "element_hash": F.when(k % 4 == 0, F.concat("element_hash", F.lit("e"))).otherwise(F.col("element_hash")),
            "stable_hash": F.when(k % 8 == 0, F.concat("stable_hash", F.lit("s"))).otherwise(F.col("stable_hash")),
            "xpath": F.when(k % 5 < 4, F.concat("xpath", F.lit("moved"))).otherwise(F.col("xpath")),
        }
    )
    return tree.rematch_elements(h, later).select("node_id", "match_id", "match_level")


@case("j_16_dom_join", """
SELECT node_id, x / 2 AS x, w / 2 AS w, CASE WHEN k % 3 > 0 THEN display END AS display, ax_name FROM fx_nodes""")
def _(spark, sf):
    def twice(field, more=0):
        return F.concat(F.transform("l", lambda e: e[field]), F.transform("l", lambda e: e[field] + more))

    n = fx.nodes(spark, sf)
    entry = F.struct("ord", "node_id", "x", "y", "w", "h", F.when(F.col("k") % 3 > 0, F.when(F.col("display") == "none", 1).otherwise(0)).otherwise(9).cast("bigint").alias("style"))
    snapshots = n.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("l")).select(
        "page_id", F.lit(2.0).alias("ratio"), F.array(F.lit("block"), F.lit("none")).alias("strings"),
        # Each node has a second entry, as for later text boxes; only the first counts.
        twice("node_id").alias("layout_node"),
        *[twice(c, 7).alias(f"bounds_{c}") for c in "xywh"],
        twice("style").alias("style"),
    )
    ax = n.select("page_id", "node_id", "ax_name", F.lit("x").alias("ax_role"))
    return tree.dom_join(n.select("page_id", "node_id"), snapshots, ax).select("node_id", "x", "w", "display", "ax_name")


@case("pg_9_pagination_buttons", """
WITH t AS (SELECT *, list_extract(['Next', '«', '12', 'last one', 'view', '3'], k % 6 + 1) AS label FROM fx_nodes),
r AS (SELECT node_id, anc_id FROM fx_ancestors UNION ALL SELECT node_id, node_id FROM t),
s AS (SELECT r.anc_id AS node_id, string_agg(n.label, chr(10) ORDER BY n.ord) AS st FROM r JOIN t n ON n.node_id = r.node_id GROUP BY r.anc_id),
c AS (SELECT t.node_id, s.st, CASE WHEN regexp_matches(lower(s.st || ' ' || t.class), 'next|>|»|→|siguiente|suivant|weiter|volgende') THEN 'next'
   WHEN regexp_matches(lower(s.st), 'prev|<|«|←|anterior|précédent|zurück|vorige') THEN 'prev'
   WHEN regexp_matches(lower(s.st), 'first|⇤') THEN 'first' WHEN regexp_matches(lower(s.st), 'last|⇥') THEN 'last'
   WHEN regexp_matches(s.st, '^\\d{1,2}$') THEN 'page_number' END AS button_type FROM t JOIN s USING (node_id) WHERE t.tag IN ('a', 'button'))
SELECT node_id, button_type, st AS text, false AS is_disabled FROM c WHERE button_type IS NOT NULL""")
def _(spark, sf):
    label = F.element_at(F.array(*[F.lit(x) for x in ("Next", "«", "12", "last one", "view", "3")]), (F.col("k") % 6 + 1).cast("int"))
    n = tree.subtree_text(fx.nodes(spark, sf).withColumn("text", label)).withColumn("clickable", F.col("tag").isin("a", "button"))
    return tree.pagination_buttons(n).select("node_id", "button_type", "text", "is_disabled")


@case("pg_11_occluded", """
WITH g AS (SELECT page_id, node_id, paint_order, x / 4 AS x1, y / 40 AS y1, x / 4 + w AS x2, y / 40 + h AS y2, opacity >= 0.8 AND k % 2 = 0 AS opaque FROM fx_nodes),
xs AS (SELECT DISTINCT page_id, x1 AS v FROM g UNION SELECT page_id, x2 FROM g), ys AS (SELECT DISTINCT page_id, y1 AS v FROM g UNION SELECT page_id, y2 FROM g),
xi AS (SELECT page_id, v AS a, lead(v) OVER (PARTITION BY page_id ORDER BY v) AS b FROM xs), yi AS (SELECT page_id, v AS a, lead(v) OVER (PARTITION BY page_id ORDER BY v) AS b FROM ys),
cells AS (SELECT g.page_id, g.node_id, g.paint_order, xi.a AS xa, xi.b AS xb, yi.a AS ya, yi.b AS yb FROM g JOIN xi ON xi.page_id = g.page_id AND xi.a >= g.x1 AND xi.b <= g.x2
  JOIN yi ON yi.page_id = g.page_id AND yi.a >= g.y1 AND yi.b <= g.y2),
open AS (SELECT DISTINCT c.node_id FROM cells c WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.page_id = c.page_id AND o.opaque AND o.paint_order > c.paint_order
  AND o.x1 <= c.xa AND o.x2 >= c.xb AND o.y1 <= c.ya AND o.y2 >= c.yb))
SELECT page_id, node_id FROM g WHERE node_id NOT IN (SELECT node_id FROM open)""")
def _(spark, sf):
    n = fx.nodes(spark, sf).withColumns(
        {"x": F.col("x") / 4, "y": F.col("y") / 40, "background": F.when(F.col("k") % 2 == 0, "rgb(1, 2, 3)").otherwise("rgba(0, 0, 0, 0)")}
    )
    return tree.occluded(n)


# ---- pages -------------------------------------------------------------------------------------


def _pages(spark, sf):
    return fx.table(spark, sf, "pages")


def _nodes(spark, sf):
    return ht.stored_nodes(_pages(spark, sf), scratch_path(spark, "nodes"))


@case("pg_1_html_nodes", r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script>.*?</script>', '<script>', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag""")
def _(spark, sf):
    n = ht.html_nodes(_pages(spark, sf))
    return n.where(~F.col("tag").startswith("#")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@case("pg_1_html_node_table")
def _(spark, sf):
    return ht.html_nodes(_pages(spark, sf)).select(
        "page_id", "node_id", "parent_id", "depth", "tag", F.array_join("path", "/").alias("path"),
        F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("attrs"), "text",
    )


@case("pg_5_find_elements", r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages),
b AS (SELECT page_id, len(hrefs) AS total, unnest(range(0, len(hrefs))) AS i, hrefs, texts FROM a)
SELECT page_id, i AS index, 'a' AS tag, hrefs[i + 1] AS href, trim(texts[i + 1]) AS text, CAST(0 AS BIGINT) AS children_count, total FROM b WHERE i < 4""")
def _(spark, sf):
    return tree.find_elements(_nodes(spark, sf), "nav li > a[href], aside a", ["href"], 4).select(
        "page_id", "index", "tag", "href", "text", "children_count", "total"
    )


_LINKS = r"""
WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs FROM pages),
b AS (SELECT page_id, root, unnest(hrefs) AS href, unnest(range(0, len(hrefs))) AS i FROM a),
c AS (SELECT page_id, root || href AS url, regexp_extract(href, '^/([A-Za-z]+)', 1) AS id, i FROM b),
d AS (SELECT page_id, id, arg_min(url, i) AS url, min(i) AS i FROM c WHERE id <> '' GROUP BY page_id, id),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS index, count(*) OVER (PARTITION BY page_id) AS total_found FROM d)
"""


@case("pg_6_result_items", _LINKS + "SELECT page_id, index, id, url, 'https://m/' || id || '.json' AS manifest_url, total_found FROM e")
def _(spark, sf):
    return co.result_items(
        _nodes(spark, sf), _pages(spark, sf), "nav a[href]", r"//[^/]+/([A-Za-z]+)", "https://m/{id}.json"
    ).select("page_id", "index", "id", "url", "manifest_url", "total_found")


@case("win_16_first_item_per_id", _LINKS + "SELECT page_id, index, id, total_found FROM e WHERE index >= 1 AND index < 4")
def _(spark, sf):
    return co.result_items(
        _nodes(spark, sf), _pages(spark, sf), "nav a[href]", r"//[^/]+/([A-Za-z]+)", "", 1, 4
    ).select("page_id", "index", "id", "total_found")


@case("pg_4_search_pages")
def _(spark, sf):
    return co.search_pages(_nodes(spark, sf), "the", scope="article", max_results=5)


@case("pg_4_search_text", r"""
WITH a AS (SELECT doc_id, text, string_split_regex(text, '(?i)ing') AS p FROM documents),
b AS (SELECT doc_id, text, len(p) - 1 AS total, unnest(range(1, len(p))) AS nth, p FROM a),
c AS (SELECT doc_id, text, total, nth, CAST(list_sum(list_transform(p[1:nth], lambda x: length(x))) + 3 * (nth - 1) AS BIGINT) AS position FROM b WHERE nth <= 6)
SELECT doc_id, nth, substr(text, position + 1, 3) AS match_text, position,
  CASE WHEN position > 20 THEN '...' ELSE '' END || substr(text, greatest(position - 20, 0) + 1, least(position + 23, length(text)) - greatest(position - 20, 0))
   || CASE WHEN position + 23 < length(text) THEN '...' ELSE '' END AS context, total, total > 6 AS has_more
FROM c""")
def _(spark, sf):
    return co.search_text(fx.table(spark, sf, "documents"), "ing", context=20, max_results=6, doc="doc_id", text="text")


DETAIL = """
concat('<html><body><h1 class="t">', p_name, '</h1><dl><dt>Brand</dt><dd>', p_brand, ' <b>', p_size, '</b></dd><dt> Type </dt><dd>', p_type,
 '</dd><dt>Brand</dt><dd>again</dd><dt>open</dt></dl><section><h4>Kinds</h4><a>', p_brand, '</a><a>', p_type, '</a><a>', p_brand, '</a></section>',
 '<section><h4>Size</h4> about ', p_size, ' cm</section><table><tr><th>Price</th><td>', p_size, '</td></tr><tr><td>x</td></tr></table></body></html>') AS html"""


def _details(spark, sf):
    pages = fx.table(spark, sf, "part").selectExpr("p_partkey AS page_id", DETAIL)
    return ht.stored_nodes(pages, scratch_path(spark, "nodes"))


@case("pg_7_label_values_dl", """
SELECT p_partkey AS page_id, CAST(1 AS BIGINT) AS ordinal, 'Title' AS label, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS value FROM part
UNION ALL SELECT p_partkey, 2, 'Brand', p_brand || ' ' || p_size FROM part UNION ALL SELECT p_partkey, 3, 'Type', p_type FROM part""")
def _(spark, sf):
    return co.label_values(_details(spark, sf), {"mode": "dl", "header_fields": [{"selector": "h1.t", "label": "Title"}]})


@case("pg_7_label_values_sections", """
SELECT p_partkey AS page_id, CAST(1 AS BIGINT) AS ordinal, 'Kinds' AS label, p_brand || ', ' || p_type AS value FROM part UNION ALL SELECT p_partkey, 2, 'Size', 'about ' || p_size || ' cm' FROM part""")
def _(spark, sf):
    return co.label_values(_details(spark, sf), {"section_selector": "section"})


@case("pg_7_label_values_table", "SELECT p_partkey AS page_id, CAST(1 AS BIGINT) AS ordinal, 'Price' AS label, CAST(p_size AS VARCHAR) AS value FROM part")
def _(spark, sf):
    return co.label_values(_details(spark, sf), {"mode": "table"})


# Three sites whose result pages and detail pages are read by different rules.
SITES = [
    {"site_id": "Org", "item_link_selector": "nav a[href]", "item_id_regex": r"//[^/]+/([A-Za-z]+)", "manifest_template": "https://org/{id}.json", "host_suffixes": ["example.org"],
     "detail": {"mode": "dl", "header_fields": [{"selector": "body > h1.t", "label": "Title"}]}},
    {"site_id": "net", "item_link_selector": "ul > li > a[href^='/t'], nav li a[href*='der']", "item_id_regex": r"/([a-z]{2,})$", "manifest_template": "https://net/{id}", "host_suffixes": ["example.net"],
     "detail": {"section_selector": "section", "label_selector": "h4"}},
    {"site_id": "com", "item_link_selector": "div a, article a", "item_id_regex": "/(.+)", "manifest_template": "https://com/{id}", "host_suffixes": ["example.com", "example.example"],
     "detail": {"mode": "table", "section_selector": "body table", "header_fields": [{"selector": "h1", "label": "Name"}, {"selector": "section h4", "label": "Kind"}]}},
]


@case("udf_2_site_items", r"""
WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(url, '\.example\.([a-z]+)[/?#:]', 1) AS site, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs FROM pages),
b AS (SELECT page_id, root, site, unnest(hrefs) AS href, unnest(range(0, len(hrefs))) AS i FROM a),
c AS (SELECT page_id, site, root || href AS url, CASE site WHEN 'org' THEN regexp_extract(href, '^/([A-Za-z]+)', 1)
  WHEN 'net' THEN CASE WHEN starts_with(href, '/t') OR contains(href, 'der') THEN regexp_extract(href, '/([a-z]{2,})$', 1) END END AS id, i FROM b),
d AS (SELECT page_id, site, id, arg_min(url, i) AS url, min(i) AS i FROM c WHERE id <> '' GROUP BY page_id, site, id)
SELECT page_id, site, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS index, id, url, CASE site WHEN 'org' THEN 'https://org/' || id || '.json' ELSE 'https://net/' || id END AS manifest_url,
  count(*) OVER (PARTITION BY page_id) AS total_found FROM d""")
def _(spark, sf):
    profiles = [rg.SiteProfile.of(p) for p in SITES]
    return co.site_items(_nodes(spark, sf), _pages(spark, sf), profiles).select("page_id", "site", "index", "id", "url", "manifest_url", "total_found")


@case("udf_2_site_labels", r"""
WITH p AS (SELECT p_partkey AS page_id, p_partkey % 4 AS s, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part)
SELECT page_id, CAST(1 AS BIGINT) AS ordinal, 'Title' AS label, name AS value FROM p WHERE s = 0
UNION ALL SELECT page_id, 2, 'Brand', brand || ' ' || size FROM p WHERE s = 0 UNION ALL SELECT page_id, 3, 'Type', type FROM p WHERE s = 0
UNION ALL SELECT page_id, 1, 'Kinds', brand || ', ' || type FROM p WHERE s = 1 UNION ALL SELECT page_id, 2, 'Size', 'about ' || size || ' cm' FROM p WHERE s = 1
UNION ALL SELECT page_id, 1, 'Name', name FROM p WHERE s = 2 UNION ALL SELECT page_id, 2, 'Kind', 'Kinds' FROM p WHERE s = 2
UNION ALL SELECT page_id, 3, 'Price', CAST(size AS VARCHAR) FROM p WHERE s = 2""")
def _(spark, sf):
    parts = fx.table(spark, sf, "part")
    host = F.element_at(F.array(*map(F.lit, ["www.example.org", "example.net", "a.b.example.com", "elsewhere.example.edu"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    pages = parts.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://"), host, F.lit("/item")).alias("url"))
    return co.site_labels(_details(spark, sf), pages, [rg.SiteProfile.of(p) for p in SITES])


MANIFEST = """
concat('{"id":"https://data.example.org/iiif/3/manifest/', p_partkey, '","label":{"en":["', p_brand, '"]},"metadata":[{"label":{"en":["Type"]},"value":{"en":["', p_type,
 '"]}}],"items":[{"items":[{"body":{"type":"Image","id":"https://data.example.org/image/iiif/3/a', p_partkey, '","service":[{"id":"https://data.example.org/image/iiif/3/a', p_partkey,
 '"}]}},{"type":"Image","id":"https://cdn.example.org/full/max/0/', p_partkey, '.jpg"}]}],"thumbnail":[{"type":"Image","id":"https://data.example.org/image/iiif/2/t', p_partkey,
 '/full/200,/0/thumb.jpg"}],"logo":{"type":"Image","id":"ftp://x/y"}}') AS manifest"""


def _manifest_images(spark, sf):
    return co.iiif_images(fx.table(spark, sf, "part").selectExpr("p_partkey AS id", MANIFEST))


fx.SQL["fx_manifest_images"] = """
SELECT p_partkey AS id, 'https://data.example.org/image/iiif/3/a' || p_partkey || '/full/max/0/default.jpg' AS url, 950 AS score, p_brand AS label, p_type FROM part
UNION ALL SELECT p_partkey, 'https://data.example.org/image/iiif/2/t' || p_partkey || '/full/200,/0/thumb.jpg/full/max/0/default.jpg', 650, p_brand, p_type FROM part
UNION ALL SELECT p_partkey, 'https://cdn.example.org/full/max/0/' || p_partkey || '.jpg', 370, p_brand, p_type FROM part"""


@case("pg_8_iiif_images", """SELECT id, url, score, label, 'Type: ' || p_type AS metadata, row_number() OVER (PARTITION BY id ORDER BY score DESC, url DESC) AS rank FROM fx_manifest_images""")
def _(spark, sf):
    return _manifest_images(spark, sf)


@case("top_2_best_image", "SELECT id, arg_max(url, score) AS url FROM fx_manifest_images GROUP BY id")
def _(spark, sf):
    return co.best_image(_manifest_images(spark, sf), ["id"])


IMAGES = """
concat('<html><head><meta property="og:image" content="/og/', p_partkey, '.png"></head><body><img src="pic', p_partkey, '-L.jpg" srcset="/a/full/max/x', p_partkey, '.jpg 2x, /icon.svg 1x">',
 '<a href="data:image/png;base64,xx">d</a><div style="background: url(&quot;/bg/', p_partkey, '.webp&quot;)">https://cdn.example.org/media/', p_partkey, '/z.jpg</div><img src="http://10.0.0.1/x.png"></body></html>') AS html"""


fx.SQL["fx_page_images"] = """
SELECT p_partkey AS page_id, 'https://h.example.org/a/full/max/x' || p_partkey || '.jpg' AS url, 'srcset' AS source, CAST(260 AS BIGINT) AS score FROM part
UNION ALL SELECT p_partkey, 'https://h.example.org/d/pic' || p_partkey || '-L.jpg', 'src', 160 FROM part
UNION ALL SELECT p_partkey, 'https://cdn.example.org/media/' || p_partkey || '/z.jpg', 'html', 80 FROM part
UNION ALL SELECT p_partkey, 'https://h.example.org/bg/' || p_partkey || '.webp', 'background', 80 FROM part
UNION ALL SELECT p_partkey, 'https://h.example.org/og/' || p_partkey || '.png', 'meta', 80 FROM part"""


def _image_pages(spark, sf):
    return fx.table(spark, sf, "part").selectExpr("p_partkey AS page_id", "'https://h.example.org/d/p.html' AS url", IMAGES)


# The part of an inline image after its comma reads as a relative address.
@case("pg_10_image_candidates", "SELECT * FROM fx_page_images UNION ALL SELECT p_partkey, 'https://h.example.org/d/xx', 'href', 0 FROM part")
def _(spark, sf):
    pages = _image_pages(spark, sf)
    return co.image_candidates(ht.stored_nodes(pages, scratch_path(spark, "nodes")), pages).select("page_id", "url", "source", F.col("score").cast("bigint").alias("score"))


@case("top_6_image_candidates", """SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS rn FROM (
  SELECT page_id, url, score FROM fx_page_images UNION ALL SELECT p_partkey, 'http://10.0.0.1/x.png', 80 FROM part)) WHERE rn <= 4 AND NOT starts_with(url, 'http://10.')""")
def _(spark, sf):
    pages = _image_pages(spark, sf)
    return co.image_candidates(ht.stored_nodes(pages, scratch_path(spark, "nodes")), pages, top=4).select("page_id", "url")


def _markdown(spark, sf):
    return ht.html_to_markdown(_pages(spark, sf), extract_links=True)


@case("pg_2_html_to_markdown")
def _(spark, sf):
    return _markdown(spark, sf).select("page_id", F.md5("markdown").alias("digest"), F.length("markdown").alias("chars"))


@case("pg_2_markdown_links", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href FROM pages)
SELECT page_id, count(*) AS links, md5(string_agg(href, ' ' ORDER BY href)) AS digest FROM a GROUP BY page_id""")
def _(spark, sf):
    found = F.regexp_extract_all("markdown", F.lit(r"(?m)^- \[[^\]]*\]\(([^)\n]*)\)$"), F.lit(1))
    return _markdown(spark, sf).select("page_id", found.alias("l")).select(
        "page_id", F.size("l").cast("bigint").alias("links"), F.md5(F.array_join(F.array_sort("l"), " ")).alias("digest")
    )


@case("agg_17_content_stats")
def _(spark, sf):
    both = _pages(spark, sf).join(_markdown(spark, sf), "page_id")
    return co.content_stats(both, "html", "markdown")


# The prose of the documents with markdown made of it: sentences are lines, and what a line begins with tells what it becomes.
_MARKS = [(r"([.!?]) ", r"\1\n"), (r"\n([AEI])", r"\n\n# \1"), (r"\n([LM])", r"\n- \1"), (r"\n([SD])", r"\n  \1"), (r"\n(T)", r"\n| \1 | t |\n| --- | --- |\n| x | y |\n| z |\n\1"), (r"\n(U)", r"\n```\n\1")]
fx.SQL["fx_markdown"] = "SELECT doc_id, " + functools.reduce(
    lambda t, m: f"regexp_replace({t}, '{m[0]}', '" + m[1].replace(r"\n", "' || chr(10) || '") + "', 'g')", _MARKS, "coalesce(text, '')"
) + " AS text FROM documents"


def _prose(spark, sf):
    text = functools.reduce(lambda t, m: F.regexp_replace(t, m[0], m[1].replace(r"\1", "$1").replace(r"\n", "\n")), _MARKS, F.coalesce("text", F.lit("")))
    return fx.table(spark, sf, "documents").select("doc_id", text.alias("text"))


# Lines, the letters they get, and the blocks that one expression cuts from the letters.
_BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1C}-\x{1F}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
fx.SQL["fx_md_lines"] = rf"""
SELECT doc_id, text, n, line, CASE WHEN regexp_matches(line, '^({_BLANK}{{2}}|\t)') AND letter NOT IN ('B', 'I') THEN lower(letter) ELSE letter END AS letter FROM (
  SELECT *, CASE WHEN bare = '' THEN 'B' WHEN starts_with(bare, '```') THEN 'F' WHEN starts_with(bare, '#') THEN 'H'
    WHEN starts_with(bare, '|') AND ends_with(bare, '|') AND length(bare) > 1 THEN CASE WHEN contains(line, '---') THEN 'S' ELSE 'T' END
    WHEN regexp_matches(line, '^{_BLANK}*([-+*]|[0-9]+[).]) ') THEN 'I' ELSE 'P' END AS letter
  FROM (SELECT doc_id, text, n, line, regexp_replace(regexp_replace(line, '^{_BLANK}+', ''), '{_BLANK}+$', '') AS bare
    FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM fx_markdown)))"""
fx.SQL["fx_md_runs"] = """
SELECT doc_id, run, ord, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS ord FROM (
  SELECT doc_id, regexp_extract_all(string_agg(letter, '' ORDER BY n), 'B|[Ff][^Ff]*[Ff]?|[Hh]|[TtSs]+|I[Ifhtsp]*|[Pp]+') AS r FROM fx_md_lines GROUP BY doc_id))"""
fx.SQL["fx_md_placed"] = """
SELECT l.doc_id, l.n, l.line, l.text, r.ord, upper(left(r.run, 1)) AS kind,
  CASE WHEN regexp_matches(r.run, '^[TtSs]') THEN CASE WHEN l.n - before = 2 AND upper(substr(r.run, 2, 1)) = 'S' THEN 1 ELSE l.n - before END ELSE 1 END AS sub
FROM fx_md_lines l JOIN fx_md_runs r ON r.doc_id = l.doc_id AND l.n > r.before AND l.n <= r.before + length(r.run)"""
fx.SQL["fx_md_blocks"] = """
SELECT doc_id, row_number() OVER w - 1 AS i, kind, content, of_lines, CAST(sum(size) OVER w - size AS BIGINT) AS a, CAST(sum(size) OVER w AS BIGINT) AS z FROM (
  SELECT doc_id, ord, sub, min(kind) AS kind, string_agg(line, chr(10) ORDER BY n) AS content, count(*) AS of_lines,
    sum(length(line) + CASE WHEN n = last AND line <> '' THEN 0 ELSE 1 END) AS size
  FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS last FROM fx_md_placed) GROUP BY doc_id, ord, sub
) WINDOW w AS (PARTITION BY doc_id ORDER BY ord, sub ROWS UNBOUNDED PRECEDING)"""


@case("pg_3_markdown_blocks", """
SELECT doc_id, i AS block_index, CASE kind WHEN 'B' THEN 'blank' WHEN 'F' THEN 'fence' WHEN 'H' THEN 'header' WHEN 'I' THEN 'list' WHEN 'P' THEN 'paragraph' ELSE 'table' END AS kind,
  md5(content) AS digest, a AS start, z AS "end" FROM fx_md_blocks""")
def _(spark, sf):
    return md.markdown_blocks(_prose(spark, sf)).select("doc_id", "block_index", "kind", F.md5("content").alias("digest"), "start", "end")


@case("win_14_chunk_markdown", """
WITH RECURSIVE walk(doc_id, first, k, chunk) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, 0 FROM fx_md_blocks WHERE i = 0
  UNION ALL (
    WITH over AS (
      SELECT w.doc_id, w.first, w.chunk, min(f.a) AS a, min(b.i) AS k FROM walk w JOIN fx_md_blocks f ON f.doc_id = w.doc_id AND f.i = w.first
      JOIN fx_md_blocks b ON b.doc_id = w.doc_id AND b.i > w.k AND b.z - f.a > 2000 GROUP BY w.doc_id, w.first, w.chunk
    )
    SELECT o.doc_id, coalesce(max(CASE WHEN 2 * (h.a - o.a) >= 2000 THEN h.i END), o.k), o.k, o.chunk + 1
    FROM over o LEFT JOIN fx_md_blocks h ON h.doc_id = o.doc_id AND h.kind = 'H' AND h.i > o.first AND h.i < o.k GROUP BY o.doc_id, o.k, o.chunk
  )
), spans AS (SELECT doc_id, chunk, first, lead(first, 1, 9223372036854775807) OVER (PARTITION BY doc_id ORDER BY chunk) AS next, count(*) OVER (PARTITION BY doc_id) AS total FROM walk),
c AS (
  SELECT s.doc_id, s.chunk, total, string_agg(content, chr(10) ORDER BY i) AS content, min(a) AS start, max(z) AS z, arg_min(kind, i) AS kind,
    arg_max(content, i) FILTER (WHERE kind IN ('T', 'S') AND of_lines = 2) AS heading
  FROM spans s JOIN fx_md_blocks b ON b.doc_id = s.doc_id AND b.i >= s.first AND b.i < s.next GROUP BY s.doc_id, s.chunk, total
), o AS (
  SELECT *, string_split(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), chr(10)) AS carried,
    string_split(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk), chr(10))[-3:] AS tail FROM c
), t AS (SELECT *, CASE WHEN chunk = 0 THEN '' WHEN kind IN ('T', 'S') AND carried IS NOT NULL
    THEN array_to_string(list_concat(carried, list_transform(list_filter(tail, lambda x, k: NOT list_contains(carried, x) AND NOT list_contains(tail[:k - 1], x)), lambda x: x)), chr(10))
  ELSE array_to_string(tail, chr(10)) END AS overlap FROM o)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk_index, total AS total_chunks, md5(content) AS digest, start, CASE WHEN content = '' AND total = 1 AND z = 1 THEN 0 ELSE z END AS "end",
  length(overlap) AS overlap_chars, chunk < total - 1 AS has_more FROM t""")
def _(spark, sf):
    return md.chunk_markdown(_prose(spark, sf), 2000, 3).select(
        "doc_id", "chunk_index", "total_chunks", F.md5("content").alias("digest"), "start", "end", F.length("overlap").alias("overlap_chars"), "has_more"
    )


@case("agg_15_idf_page_score", r"""
WITH w AS (SELECT source, doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z]{4,}$')))) AS word FROM documents),
d AS (SELECT source, word, count(*) AS df FROM w GROUP BY source, word), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
s AS (SELECT w.source, w.doc_id, sum(ln(n.n / d.df)) AS score FROM w JOIN d USING (source, word) JOIN n USING (source) GROUP BY w.source, w.doc_id)
SELECT source, doc_id, round(coalesce(score, 0), 4) AS score FROM documents LEFT JOIN s USING (source, doc_id)""")
def _(spark, sf):
    scores = co.idf_page_score(fx.table(spark, sf, "documents"), "source", "doc_id", "text")
    return scores.withColumn("score", F.round("score", 4))


_POSITIONS = """
WITH t AS (SELECT unnest(['the', 'ing', 'der']) AS term),
a AS (SELECT doc_id, term, string_split_regex(text, '(?i)' || term) AS p FROM documents, t),
b AS (SELECT doc_id, term, unnest(range(1, len(p))) AS nth, p FROM a),
c AS (SELECT doc_id, term, CAST(list_sum(list_transform(p[1:nth], lambda x: length(x))) + 3 * (nth - 1) AS BIGINT) AS position FROM b)
"""
TERMS = ["the", "ing", "der"]


@case("agg_16_term_relevance", _POSITIONS + "SELECT doc_id, position // 2000 AS chunk, count(*) AS score FROM c GROUP BY doc_id, position // 2000")
def _(spark, sf):
    return co.term_relevance(fx.table(spark, sf, "documents"), TERMS)


@case("agg_16_page_relevance", """SELECT source, doc_id, contains(lower(text), 'the')::BIGINT + contains(lower(text), 'ing')::BIGINT + contains(lower(text), 'der')::BIGINT AS score
  FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'ing') OR contains(lower(text), 'der')""")
def _(spark, sf):
    return co.page_relevance(fx.table(spark, sf, "documents"), TERMS, "source", "doc_id", "text")


@case("pg_13_relevant_sections", """
WITH RECURSIVE l AS (SELECT doc_id, text, length(text) AS n FROM documents),
t AS (SELECT unnest(['thening', 'handand']) AS term),
a AS (SELECT doc_id, term, string_split_regex(text, '(?i)' || term) AS p FROM l, t WHERE n > 5000),
b AS (SELECT doc_id, unnest(range(1, len(p))) AS nth, p FROM a),
c AS (SELECT DISTINCT doc_id, CAST(list_sum(list_transform(p[1:nth], lambda x: length(x))) + 7 * (nth - 1) AS BIGINT) // 2000 AS chunk FROM b),
s AS (SELECT doc_id, chunk FROM c UNION SELECT doc_id, 0 FROM c),
u AS (SELECT doc_id, chunk, text, sum(least(2000, n - chunk * 2000)) OVER (PARTITION BY doc_id ORDER BY chunk) AS used,
  chunk > 0 AND lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk) <> chunk - 1 AS gap FROM s JOIN l USING (doc_id)),
g AS (SELECT doc_id, string_agg(CASE WHEN gap THEN chr(10) || '[...]' || chr(10) ELSE '' END || substr(text, chunk * 2000 + 1, 2000), '' ORDER BY chunk) AS body FROM u WHERE used <= 5000 GROUP BY doc_id)
SELECT l.doc_id, md5(CASE WHEN n <= 5000 THEN text WHEN l.doc_id NOT IN (SELECT doc_id FROM c) THEN substr(text, 1, 5000) ELSE coalesce(body, '') END) AS digest FROM l LEFT JOIN g USING (doc_id)""")
def _(spark, sf):
    out = co.relevant_sections(fx.table(spark, sf, "documents"), ["thening", "handand"], 5000)
    return out.select("doc_id", F.md5("content").alias("digest"))


@case("win_15_greedy_budget", r"""
WITH RECURSIVE i AS (SELECT source, doc_id, '--- Page ' || doc_id || ' ---' || chr(10) AS head, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE regexp_matches(text, '\S')),
f AS (SELECT source, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS used, '' AS content, false AS stop FROM (SELECT DISTINCT source FROM i)
 UNION ALL
 SELECT i.source, i.rn, i.doc_id, used + least(length(head || text), 60000 - used),
   CASE WHEN length(head || text) > 60000 - used THEN substr(head || text, 1, CAST(60000 - used - 15 AS BIGINT)) || chr(10) || '[...truncated]' ELSE head || text END,
   60000 - used < length(head) + 15 + 50
 FROM f JOIN i ON i.source = f.source AND i.rn = f.rn + 1 WHERE NOT f.stop)
SELECT source, doc_id, md5(content) AS digest FROM f WHERE rn > 0 AND NOT stop""")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumn("rank", F.col("doc_id"))
    return co.greedy_budget(docs, "source", "doc_id", "rank", "text", 60000).select("source", "doc_id", F.md5("content").alias("digest"))


ANSWER = """
concat(text, '\n', CASE doc_id % 5 WHEN 0 THEN concat('Sure\n```js view\nlet x = ', doc_id, ';\n```\n```python\nprint(1)\n```\n```Python\nprint(2)\n```\n') WHEN 1 THEN concat('```\n plain ', doc_id, ' \n```')
 WHEN 2 THEN concat('```sh\nls -l\n```\n```bash\nignored ', doc_id, '\n```') WHEN 3 THEN 'no code' ELSE concat('```md\na b\n```\n```markdown\nc d ', doc_id, '\n```\n') END) AS text"""


@case("fn_38_code_blocks", """
SELECT doc_id, 'view' AS key, 'let x = ' || doc_id || ';' AS content FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, unnest(['python_0', 'python_1', 'python']), unnest(['print(1)', 'print(2)', 'print(1)']) FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'python', 'plain ' || doc_id FROM documents WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id, 'bash', 'ls -l' FROM documents WHERE doc_id % 5 = 2
UNION ALL SELECT doc_id, 'markdown', 'c d ' || doc_id FROM documents WHERE doc_id % 5 = 4""")
def _(spark, sf):
    return co.code_blocks(fx.table(spark, sf, "documents").selectExpr("doc_id", ANSWER))


# The text of the document, with its line breaks as they are, is a member of the object.
JSON_ANSWER = r"""
CASE doc_id % 6 WHEN 0 THEN concat('<json>', obj, '</json>') WHEN 1 THEN concat('Here is the result: ', obj) WHEN 2 THEN concat('```json\n', obj, '\n```')
 WHEN 3 THEN concat('noise ', obj, ' more {"id": 0}') WHEN 4 THEN obj ELSE concat('nothing {here ', body) END AS text"""


@case("fn_37_repair_json", """
SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN doc_id END AS id, CASE WHEN doc_id % 6 < 5 THEN md5(regexp_replace(text, '["\\\\{}\\r]', '', 'g')) END AS digest FROM documents""")
def _(spark, sf):
    bodies = fx.table(spark, sf, "documents").withColumn("body", F.regexp_replace("text", r'["\\{}\r]', ""))
    answers = bodies.withColumn("obj", F.concat(F.lit('{"id": '), "doc_id", F.lit(', "t": "'), "body", F.lit('"}'))).selectExpr("doc_id", JSON_ANSWER)
    found = co.repair_json(answers)
    return found.select("doc_id", F.get_json_object("json", "$.id").cast("bigint").alias("id"), F.md5(F.get_json_object("json", "$.t")).alias("digest"))


SCHEMA = {
    "type": "object",
    "properties": {
        "name": {"type": "string"}, "count": {"type": "integer"}, "price": {"type": "number", "nullable": True},
        "kind": {"enum": ["a", "b"]}, "tags": {"type": "array", "items": {"type": "string"}},
        "box": {"type": "object", "properties": {"side": {"type": "integer"}}, "required": ["side"]},
        "unit": {"type": "string", "default": "cm"},
    },
    "required": ["name"],
}
PAYLOAD = """
CASE p_partkey % 8 WHEN 0 THEN concat('{"name": "', p_brand, '", "count": ', p_size, ', "tags": ["x", "y"], "box": {"side": ', p_size, '}}')
 WHEN 1 THEN concat('{"name": "', p_brand, '", "price": null, "unit": "mm"}') WHEN 2 THEN '{"count": 3}' WHEN 3 THEN '{"name": "n", "other": 1}'
 WHEN 4 THEN '{"name": null}' WHEN 5 THEN '[1]' WHEN 6 THEN '{"name": "n", "box": {"side": "wide"}}' ELSE 'broken {' END AS payload"""


@case("pg_12_validate_extraction", """
SELECT p_partkey AS id, p_partkey % 8 < 2 AS accepted, CASE WHEN p_partkey % 8 < 2 THEN p_brand END AS name,
  CAST(CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN 0 END AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS kind,
  CASE p_partkey % 8 WHEN 0 THEN 'x,y' WHEN 1 THEN '' END AS tags, CAST(CASE p_partkey % 8 WHEN 0 THEN p_size END AS BIGINT) AS side,
  CASE p_partkey % 8 WHEN 0 THEN 'cm' WHEN 1 THEN 'mm' END AS unit FROM part""")
def _(spark, sf):
    rows = fx.table(spark, sf, "part").selectExpr("p_partkey AS id", PAYLOAD)
    d = F.col("data")
    return co.validate_extraction(rows, SCHEMA).select(
        "id", "accepted", d["name"].alias("name"), d["count"].alias("count"), d["price"].alias("price"), d["kind"].alias("kind"),
        F.array_join(d["tags"], ",").alias("tags"), d["box"]["side"].alias("side"), d["unit"].alias("unit"),
    )
