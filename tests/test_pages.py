"""Markdown blocks and chunks, page parsing, selectors, extraction."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailsift.functions import registry as rg
from trailsift.functions import tables as tb
from trailsift.functions import trace as tr
from trailsift.operators import catalog as ca
from trailsift.operators import corpus as co
from trailsift.operators import markdown as md
from trailsift.operators import network as nw
from trailsift.operators import tree
from trailsift.session import scratch_path
from trailsift.sources import html as ht


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def detail_nodes(spark):
    html = "<dl><dt>A</dt><dd>1</dd></dl><section><h4>K</h4><a>x</a></section><table><tr><th>P</th><td>7</td></tr></table>"
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit(html).alias("html"))
    return ht.stored_nodes(pages, scratch_path(spark, "nodes"))


@pytest.mark.parametrize("profile", [{"section_selector": "section"}, {"mode": "dl"}, {"mode": "table"}])
def test_label_pairs_are_not_gathered_in_the_driver(spark, profile):
    found = co.label_values(detail_nodes(spark), profile)
    assert "Broadcast" not in planned(found)
    label, value = {"section_selector": ("K", "x"), "dl": ("A", "1"), "table": ("P", "7")}[profile.get("mode", "section_selector")]
    assert {tuple(r)[1:] for r in found.collect()} == {(1, label, value)} and found.count() == 40


def test_rules_of_sites_gather_only_the_rules_in_the_driver(spark):
    nodes = detail_nodes(spark)
    rows = [*tree.selector_steps("s", "table", "table tr"), *tree.selector_steps("s", "label", "section > h4")]
    assert "BroadcastHashJoin [page_id" not in planned(tree.select_by_rules(nodes.withColumn("site", F.lit("s")), rows))
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("https://example.org/x").alias("url"))
    profile = rg.SiteProfile.of({"site_id": "s", "item_link_selector": "a", "item_id_regex": "x", "manifest_template": "{id}", "host_suffixes": ["example.org"]})
    assert "BroadcastHashJoin [page_id" not in planned(co._sited(nodes, pages, [profile]))


def test_small_pages_go_out_together():
    pages = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["<p>a</p>"] * 99 + [None])], names=["page_id", "html"])
    out = list(ht.node_batches([pages]))
    assert len(out) == 1 and out[0].num_rows == 198
    long = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(["<br>" * ht.NODES_TOGETHER] * 3 + [""])], names=["page_id", "html"])
    assert [b.num_rows for b in ht.node_batches([long])] == [ht.NODES_TOGETHER] * 3


def test_an_address_is_not_looked_for_once_a_match(spark):
    found = spark.createDataFrame([("never go to www.a.org or see https://b.org/x, b.org",)], "t string").select(tr.extract_urls(F.col("t"), guarded=True).alias("u"))
    assert found._jdf.queryExecution().analyzed().toString().count(tr.FULL_URL) == 1
    assert found.first()["u"] == ["https://b.org/x", "https://b.org"]


def blocks(spark, text):
    """Blocks of one text, the same by the operator and by the table function."""
    rows = sorted(tuple(r)[1:] for r in md.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect())
    assert rows == tb.blocks_of(text or "")
    return rows


def chunks(spark, text, limit, overlap, start_from=0):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = sorted(tuple(r)[1:] for r in md.chunk_markdown(docs, limit, overlap, start_from).collect())
    if not start_from:
        assert rows == [(n, total, content, a, z, o, more) for n, total, content, a, z, o, more in tb.MarkdownChunks().eval(text, limit, overlap)]
    return rows


def test_blocks_tile_the_text(spark):
    text = "# T\n\npara one\npara two\n```py\ncode # x\n```\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n- i\n  more\n- j\nend"
    found = blocks(spark, text)
    assert [b[1] for b in found] == ["header", "blank", "paragraph", "fence", "table", "table", "table", "list", "paragraph"]
    assert [b[3] for b in found[1:]] == [b[4] for b in found[:-1]] and found[-1][4] == len(text)
    assert found[4][2] == "| a | b |\n| --- | --- |"


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("a\n```\nx\n\n# y", ["paragraph", "fence"]),
        ("- i\n  ```\n  code\n\n```\nx\n```", ["list", "blank", "fence"]),
        ("```\n- x\n  ```\n  y\n\t# z", ["fence", "paragraph", "header"]),
        ("|a|\n|---|\n|b|\n|---|\n|\n| c |", ["table", "table", "table", "paragraph", "table"]),
        ("1) x\n2. y\n   | t |\n| u |\n1.z", ["list", "table", "paragraph"]),
        ("", ["blank"]), (None, ["blank"]), ("x\n", ["paragraph", "blank"]), ("\n\n", ["blank"] * 3), ("  # h\n\u2003\u3000\n--\n* ", ["header", "blank", "paragraph", "list"]),
    ],
)
def test_kinds_of_blocks(spark, text, kinds):
    assert [b[1] for b in blocks(spark, text)] == kinds


def test_chunks_of_random_texts(spark):
    rng = random.Random(5)
    parts = ["# head", "", "text " * 5, "- item", "  more", "| a | b |", "|---|---|", "| 1 | 2 |", "```", "code", "  ```"]
    docs = [(k, "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    frame = spark.createDataFrame(docs + [(7, docs[7][1])], "doc_id int, text string")  # one of them twice
    got = sorted(tuple(r) for r in md.chunk_markdown(frame, 90, 2).collect())
    want = sorted((k, *row) for k, text in [*docs, docs[7]] for row in tb.MarkdownChunks().eval(text, 90, 2))
    assert got == want
    for k, text in docs:
        assert "\n".join(content for key, _, _, content, *_ in sorted(set(want)) if key == k) == text


def test_chunks(spark):
    (only,) = chunks(spark, "hello\nworld", 100, 5)
    assert only == (0, 1, "hello\nworld", 0, 11, "", False)
    assert chunks(spark, "", 100, 5) == [(0, 1, "", 0, 0, "", False)]
    text = "# A\n\n" + "a" * 60 + "\n\n# B\n\n" + "b" * 60 + "\n"
    found = chunks(spark, text, 90, 0)
    assert found[1][2].startswith("# B") and found[0][3] == 0 and found[0][4] == found[1][3] and [c[6] for c in found] == [True, False]
    assert any(len(c[2]) > 300 for c in chunks(spark, "x\n\n```\n" + "y" * 300 + "\n```\n\nz", 50, 0))
    rows = "\n".join(f"| r{i} | {i} |" for i in range(30))
    found = chunks(spark, "| h | v |\n| --- | --- |\n" + rows, 120, 2)
    assert len(found) >= 3 and all(c[5].startswith("| h | v |\n| --- | --- |") for c in found[1:])
    text = "\n\n".join(f"paragraph number {i}" for i in range(20))
    found = chunks(spark, text, 80, 2)
    assert found[1][5] == "\n".join(found[0][2].split("\n")[-2:])
    assert chunks(spark, text, 80, 2, found[2][3] + 1)[0][0] == 2 and chunks(spark, text, 80, 2, len(text)) == []


HTML = (
    '<html><head><title>Shop</title></head><body><h1 id="top">Products</h1><table id="products"><thead><tr><th>Name</th><th>Price</th></tr></thead>'
    '<tbody><tr class="product-row sale"><td>Widget A</td><td>$29.99</td></tr><tr class="product-row"><td>Widget B</td><td>$49.99</td></tr></tbody></table>'
    '<div class="pagination"><a href="/page/1">1</a><a href="/page/2" class="next">Next</a></div><p>one<p>two<footer>Contact: <b>info</b></footer></body></html>'
)


@pytest.fixture(scope="module")
def nodes(spark):
    return ht.html_nodes(spark.createDataFrame([(1, HTML)], "page_id bigint, html string")).cache()


def texts(df):
    return [r["text"] for r in sorted(df.collect(), key=lambda r: r["index"])]


def test_selectors(nodes):
    assert texts(tree.find_elements(nodes, "tr.product-row td")) == ["Widget A", "$29.99", "Widget B", "$49.99"]
    assert texts(tree.find_elements(nodes, "tr.sale > td, #top")) == ["Products", "Widget A", "$29.99"]
    assert texts(tree.find_elements(nodes, 'a[href$="/2"].next')) == ["Next"]
    assert tree.find_elements(nodes, "tbody > td").count() == 0
    row = tree.find_elements(nodes, "tr.product-row", ["class"], 1).first()
    assert (row["total"], row["children_count"], row["class"]) == (2, 2, "product-row sale")
    with pytest.raises(ValueError):
        tree.find_elements(nodes, "a:hover")


def test_implied_ends(nodes):
    assert texts(tree.find_elements(nodes, "body > p")) == ["one", "two"]


def test_search(nodes):
    hits = co.search_pages(nodes, "widget [ab]", regex=True, context=3).collect()
    assert [h["match_text"] for h in sorted(hits, key=lambda h: h["nth"])] == ["Widget A", "Widget B"]
    assert hits[0]["element_path"] == "table#products > tbody > tr.product-row.sale > td" or hits[1]["element_path"].endswith("tr.product-row.sale > td")
    assert co.search_pages(nodes, "widget", case_sensitive=True).count() == 0
    assert co.search_pages(nodes, "$", scope="table").first()["total"] == 2
    assert co.search_pages(nodes, "info", scope="table").count() == 0


def test_markdown():
    assert ht.markdown_of("<h2>A <b>b</b></h2><p>x<br>y</p><ul><li>1<li>2</ul>").replace("\n\n\n", "\n") .startswith("## A **b**")
    table = ht.markdown_of("<table><tr><th>h</th></tr><tr><td>a|b</td></tr></table>")
    assert table == "| h |\n| --- |\n| a\\|b |"
    assert ht.markdown_of('<a href="/x">t</a>') == "t"
    assert ht.markdown_of('<a href="/x">t</a>', True) == "[t](/x)"
    assert ht.markdown_of('<code style="display: none">{}</code><img src="data:image/png;base64,x">z') == "z"


def test_schema_refusals(spark):
    df = spark.createDataFrame([("{}",)], "payload string")
    for schema in ({"type": "array"}, {"type": "object"}, {"type": "object", "properties": {"a": {"anyOf": []}}}, {"$ref": "x"}):
        with pytest.raises(ValueError):
            co.validate_extraction(df, schema)


def test_schema_defaults(spark):
    schema = {
        "type": "object",
        "properties": {
            "s": {"type": "string"}, "n": {"type": "number"}, "i": {"type": "integer"}, "b": {"type": "boolean"}, "l": {"type": "array", "items": {"type": "integer"}},
            "o": {"type": "object", "properties": {"x": {"type": "string"}}}, "e": {"enum": ["u", "v"]}, "d": {"type": "string", "default": "dd"},
        },
    }
    df = spark.createDataFrame([("{}",), ('{"l": [1, "a"]}',), ('{"i": 1.5}',), ('{"s": null}',), ('{"o": {"x": "y"}, "b": true, "n": 2}',)], "payload string")
    out = co.validate_extraction(df, schema).collect()
    assert [r["accepted"] for r in out] == [True, False, False, False, True]
    assert tuple(out[0]["data"]) == ("", 0.0, 0, False, [], None, None, "dd")
    assert out[4]["data"]["o"]["x"] == "y" and out[4]["data"]["n"] == 2.0


def test_profile_lacks_fields():
    with pytest.raises(ValueError, match="item_id_regex"):
        rg.SiteProfile.of({"site_id": "x", "item_link_selector": "a", "manifest_template": "m"})


def test_markdown_of_lists_tables_and_depth():
    nested = ht.markdown_of("<ul><li>a<ol><li>b<li>c <b>d</b></ol><li>e</ul>")
    assert nested == "- a\n  1. b\n  2. c **d**\n- e"
    assert ht.markdown_of("<table><tbody><tr><td>x <i>y</i></td><td>z</td></tr></tbody></table>") == "| x *y* | z |\n| --- | --- |"
    assert ht.markdown_of("<div>" * 3000 + "deep") == "deep" and ht.markdown_of("<b>" * 3000 + "x").strip("*") == "x"


def test_model_answers(spark):
    answers = {
        '{"a": {"b": "x"}, "b": 3}': '{"a": {"b": "x"}, "b": 3}', 'Here is it: {"t": "a\nb"} bye': '{"t": "a\\nb"}', "```json\n{\"a\": 1}\n```": '{"a": 1}',
        "[" * 2000 + "]" * 2000: None, "[1, 2]": None, "": None, 'x {bad} {"ok": true}': '{"ok": true}',
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(answers)], "doc_id bigint, text string")
    found = {r["text"]: r["json"] for r in co.repair_json(df).collect()}
    assert found == answers


def test_code_blocks_by_lines(spark):
    text = "see ```js view\nlet x;\n```\n````python\n```\nprint(1)\n````\n```nolang\nq\n```\n```sh\nopen"
    rows = co.code_blocks(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert {(r["key"], r["content"]) for r in rows} == {("view", "let x;"), ("python_0", "```\nprint(1)"), ("python", "```\nprint(1)")}


def test_members_keep_their_own_kind(spark):
    df = spark.createDataFrame([('{"a": {"b": "x"}, "b": 3, "c": "7"}',)], "params string")
    assert df.select(tr.sorted_json(df["params"])).first()[0] == '{"a": {"b":"x"}, "b": 3, "c": "7"}'


def test_order_of_large_and_missing_sequences(spark):
    rows = [(1, 10**9 + 1, "a"), (2, None, "b"), (3, 5, "c"), (4, None, "a")]
    ranked = ca.rank_records(spark.createDataFrame(rows, "pos bigint, sequence bigint, file_name string"))
    assert {r["pos"]: r["nth"] for r in ranked.collect()} == {3: 1, 1: 2, 4: 3, 2: 4}


def test_bytes_before_the_request_do_not_count(spark):
    rows = [("dataReceived", "r", 0, 100, None), ("requestWillBeSent", "r", 1, None, "https://h/"), ("dataReceived", "r", 2, 7, None)]
    df = spark.createDataFrame(rows, "event string, request_id string, pos bigint, size bigint, url string")
    for name, kind in (("frame_id", "string"), ("type", "string"), ("name", "string"), ("at", "double")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    assert nw.har_entries(df).first()["received"] == 7


def slow_hidden(boxes):
    """boxes: (node, layer, x, y, w, h, opaque) in whole numbers"""
    hidden = set()
    for node, layer, x, y, w, h, _ in boxes:
        covers = [(b[2], b[3], b[2] + b[4], b[3] + b[5]) for b in boxes if b[6] and b[1] > layer]
        if all(any(c[0] <= px < c[2] and c[1] <= py < c[3] for c in covers) for px in range(x, x + w) for py in range(y, y + h)):
            hidden.add(node)
    return hidden


@pytest.mark.parametrize("band", [5, 2_000])
def test_boxes_under_others(spark, monkeypatch, band):
    monkeypatch.setattr(tree, "BAND_BOXES", band)
    rng = random.Random(band)
    pages = {p: [(n, rng.randint(1, 12), rng.randint(0, 12), rng.randint(0, 12), rng.randint(1, 9), rng.randint(1, 9), rng.random() < 0.6) for n in range(40)] for p in range(6)}
    rows = [(p, n, layer, float(x), float(y), float(w), float(h), "red" if opaque else "rgba(0, 0, 0, 0)", 1.0) for p, boxes in pages.items() for n, layer, x, y, w, h, opaque in boxes]
    schema = "page_id bigint, node_id bigint, paint_order int, x double, y double, w double, h double, background string, opacity double"
    odd = [(9, 1, 1, 2.0, 2.0, 0.0, 0.0, None, None), (9, 2, 2, 0.0, 0.0, 5.0, 5.0, "red", 0.9), (9, 3, 3, 0.0, 0.0, 9.0, 9.0, "red", 0.7), (9, 4, None, 0.0, 0.0, 1.0, 1.0, None, None), (9, 5, 1, 5.0, 1.0, 0.0, 1.0, None, None)]
    got = {(r["page_id"], r["node_id"]) for r in tree.occluded(spark.createDataFrame(rows + odd, schema)).collect()}
    want = {(p, n) for p, boxes in pages.items() for n in slow_hidden(boxes)}
    assert got == want | {(9, 1)} and 20 < len(want) < 220


def test_ten_thousand_boxes_on_a_page(spark):
    n = spark.range(10_000).selectExpr(
        "1L AS page_id", "id AS node_id", "CAST(id AS INT) AS paint_order", "CAST(id % 100 AS DOUBLE) AS x", "CAST(id DIV 100 AS DOUBLE) AS y", "2.0D AS w", "2.0D AS h", "'red' AS background", "1.0D AS opacity"
    )
    # A box lies under its right and lower neighbours but for its first cell; the last ones cover nothing further.
    assert tree.occluded(n).count() == 0
    assert tree.occluded(n.withColumn("w", F.when(F.col("node_id") == 9_999, 1000.0).otherwise(2.0)).withColumn("x", F.when(F.col("node_id") == 9_999, -1.0).otherwise(F.col("x")))).count() == 99
    covered = n.unionByName(n.limit(1).selectExpr("page_id", "-1L AS node_id", "20000 AS paint_order", "-1.0D AS x", "-1.0D AS y", "60.0D AS w", "500.0D AS h", "background", "opacity"))
    assert tree.occluded(covered).count() == 59 * 100  # the 59th column lies half under its neighbours


def test_rules_of_many_sites_are_those_of_each(spark, nodes):
    selectors = ["tr.product-row > td", "table#products th, .pagination a.next", "div a[href^='/page']", "body p, html footer b", "[class~=sale]", "a[class]", "tbody td", "div > p"]
    sited = nodes.withColumn("site", F.lit("s"))
    rows = [row for n, s in enumerate(selectors) for row in tree.selector_steps("s", str(n), s)] + tree.selector_steps("other", "9", "a")
    got = sorted((int(r["rule"]), r["node_id"]) for r in tree.select_by_rules(sited, rows).collect())
    assert got == sorted((n, r["node_id"]) for n, s in enumerate(selectors) for r in tree.select_nodes(nodes, s).collect()) and len(got) > 12
    with pytest.raises(ValueError, match="unsupported"):
        tree.selector_steps("s", "x", "a:hover")


def test_deep_manifest_labels(spark):
    deep = '{"id": "https://x/manifest/1", "label": ' + '{"en": [' * 300 + '"deep"' + "]}" * 300 + "}"
    assert co._plain({"a": ["x ", {"b": None}], "c": " y"}) == "x y"
    nested = "z"
    for _ in range(5_000):
        nested = [nested]
    assert co._plain(nested) == "z"
    assert co.iiif_images(spark.createDataFrame([(1, deep), (2, "[" * 100_000)], "id bigint, manifest string")).count() >= 0
