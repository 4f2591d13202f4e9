"""Relational operators over node tables.

A node row has ``page_id, node_id, parent_id, ord, anc_ids, tag, attrs, text`` and, where a layout
is known, ``x, y, w, h`` and styles.  Ancestry is the materialised ``anc_ids`` array (root first),
so ancestor questions are one explode and one equi join on ``(page_id, node_id)``, never a recursion.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailsift.functions import elements as el
from trailsift.plans.lookup import sorted_side

KEY = ["page_id", "node_id"]


def attr(name: str) -> Column:
    """Attribute value, '' where absent."""
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def has_attr(name: str) -> Column:
    return F.coalesce(F.map_contains_key("attrs", name), F.lit(False))


def ancestors(nodes: DataFrame, facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(page, node, distance) with ``columns`` of every proper ancestor that is in ``facts``.

    Distance 1 is the parent.  ``facts`` is keyed by (page_id, node_id).
    """
    pairs = nodes.select("page_id", "node_id", F.posexplode(F.reverse("anc_ids")).alias("__i", "__anc"))
    above = facts.select("page_id", F.col("node_id").alias("__anc"), *columns)
    return pairs.join(above, ["page_id", "__anc"]).withColumn("distance", F.col("__i") + 1).drop("__i")


def drop_subtrees(nodes: DataFrame, dropped: Column) -> DataFrame:
    """Nodes that are not dropped themselves and have no dropped ancestor."""
    roots = nodes.where(dropped).select("page_id", F.col("node_id").alias("__anc"))
    hit = (
        nodes.select("page_id", "node_id", F.explode(F.concat("anc_ids", F.array("node_id"))).alias("__anc"))
        .join(roots, ["page_id", "__anc"], "left_semi").select(*KEY)
    )
    return nodes.join(hit, KEY, "left_anti")


def skip_rule() -> Column:
    """Elements without readable content, hidden JSON state in ``code``, inline image data, comments."""
    style = F.replace(attr("style"), F.lit(" "), F.lit(""))
    state = style.contains("display:none") | attr("id").rlike("bpr-guid|data|state")
    return (
        F.col("tag").isin("style", "script", "head", "meta", "link", "title", "#comment")
        | ((F.col("tag") == "code") & state)
        | ((F.col("tag") == "img") & attr("src").startswith("data:image/"))
    )


def with_path(nodes: DataFrame) -> DataFrame:
    """Adds ``path``: tags from the root to the node."""
    above = ancestors(nodes.select(*KEY, "anc_ids"), nodes, ["tag"]).groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "tag"))), lambda s: s["tag"]).alias("__above")
    )
    empty = F.array().cast("array<string>")
    return nodes.join(above, KEY, "left").withColumn(
        "path", F.concat(F.coalesce("__above", empty), F.array("tag"))
    ).drop("__above")


# Attributes that identify an element.
STATIC_ATTRIBUTES = [
    "class", "id", "name", "type", "placeholder", "aria-label", "title", "role", "data-testid", "data-test", "data-cy",
    "data-selenium", "for", "required", "disabled", "readonly", "checked", "selected", "multiple", "accept", "href", "target",
    "rel", "aria-describedby", "aria-labelledby", "aria-controls", "aria-owns", "aria-live", "aria-atomic", "aria-busy",
    "aria-disabled", "aria-hidden", "aria-pressed", "aria-autocomplete", "aria-checked", "aria-selected", "list", "tabindex",
    "alt", "src", "lang", "itemscope", "itemtype", "itemprop", "pseudo", "aria-valuemin", "aria-valuemax", "aria-valuenow",
    "aria-placeholder",
]


def with_hashes(nodes: DataFrame) -> DataFrame:
    """Adds ``element_hash``, ``stable_hash`` and ``parent_hash`` (needs ``path`` and ``ax_name``)."""
    names = F.array(*[F.lit(a) for a in STATIC_ATTRIBUTES])
    static = F.map_filter("attrs", lambda k, v: F.array_contains(names, k))
    return nodes.withColumn("__static", static).withColumns(
        {
            "element_hash": el.element_hash(F.col("path"), F.col("__static"), F.col("ax_name")),
            "stable_hash": el.stable_hash(F.col("path"), F.col("__static"), F.col("ax_name")),
            "parent_hash": el.parent_hash(F.col("path")),
        }
    ).drop("__static")


def with_xpath(nodes: DataFrame) -> DataFrame:
    """Adds ``xpath``: tags with their place among same-tag siblings, cut below an iframe.

    Shadow roots (``#shadow-root``) are passed through.
    """
    siblings = Window.partitionBy("page_id", "parent_id", "tag")
    place = F.row_number().over(siblings.orderBy("ord"))
    many = F.count("*").over(siblings) > 1
    parents = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("__parent_tag"))
    steps = (
        nodes.select(*KEY, "parent_id", "ord", "tag")
        .withColumn("__step", F.concat("tag", F.when(many & F.col("parent_id").isNotNull(), F.concat(F.lit("["), place.cast("string"), F.lit("]"))).otherwise("")))
        .join(parents, ["page_id", "parent_id"], "left")
        .withColumn("__cut", F.coalesce(F.col("__parent_tag").isin("iframe", "frame"), F.lit(False)))
        .select(*KEY, "__step", "__cut", F.col("tag").startswith("#").alias("__pass"))
    )
    own = nodes.select(*KEY, F.lit(0).alias("distance")).join(steps, KEY)
    chain = ancestors(nodes.select(*KEY, "anc_ids"), steps, ["__step", "__cut", "__pass"]).select(
        *KEY, "distance", "__step", "__cut", "__pass"
    )
    per_node = own.unionByName(chain).groupBy(*KEY).agg(
        F.min(F.when(F.col("__cut"), F.col("distance"))).alias("__stop"),
        F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("__step").alias("s"), F.col("__pass").alias("p")))).alias("__all"),
    )
    kept = F.filter("__all", lambda x: ~x["p"] & (F.col("__stop").isNull() | (-x["d"] < F.col("__stop"))))
    paths = per_node.select(*KEY, F.array_join(F.transform(kept, lambda x: x["s"]), "/").alias("xpath"))
    return nodes.join(paths, KEY)


def subtree_text(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Text of every node and its descendants in document order, a line per text node."""
    texts = nodes.where(F.coalesce("text", F.lit("")) != "").select("page_id", "node_id", "ord", "text", "anc_ids")
    reach = texts.select(
        "page_id", "ord", "text", F.posexplode(F.reverse(F.concat("anc_ids", F.array("node_id")))).alias("__d", "node_id")
    )
    if max_depth is not None:
        reach = reach.where(F.col("__d") <= max_depth)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])
    joined = reach.groupBy(*KEY).agg(F.trim(F.array_join(lines, "\n")).alias("subtree_text"))
    return nodes.join(joined, KEY, "left").withColumn("subtree_text", F.coalesce("subtree_text", F.lit("")))


# ---- interactivity and visibility ------------------------------------------------------------------

# Words, tags, attributes and roles that tell an element can be used.
SEARCH_WORDS = "search|magnify|glass|lookup|find|query"
INTERACTIVE_TAGS = "button input select textarea a details summary option optgroup".split()
HANDLER_ATTRIBUTES = "onclick onmousedown onmouseup onkeydown onkeyup tabindex".split()
INTERACTIVE_ROLES = (
    "button link menuitem option radio checkbox tab textbox combobox slider spinbutton search searchbox row cell gridcell"
).split()
ICON_ATTRIBUTES = "class role onclick data-action aria-label".split()


def _decisive_property() -> Column:
    """Verdict of the first accessibility property that decides, NULL when none does."""

    def verdict(p: Column) -> Column:
        name, on = p["name"], p["value"]
        return (
            F.when(name.isin("disabled", "hidden") & on, F.lit(False))
            .when(name.isin("focusable", "editable", "settable", "required", "autocomplete", "keyshortcuts") & on, F.lit(True))
            .when(name.isin("checked", "expanded", "pressed", "selected"), F.lit(True))
        )

    found = F.filter(F.transform("ax_props", verdict), lambda v: v.isNotNull())
    return F.try_element_at(found, F.lit(1))


def is_interactive(nodes: DataFrame) -> DataFrame:
    """Adds ``interactive`` by rules in order; needs ``js_listener, ax_props, ax_role, cursor, w, h``."""
    controls = nodes.where(F.col("tag").isin("input", "select", "textarea")).select(
        "page_id", F.explode(F.slice("anc_ids", F.greatest(F.size("anc_ids") - 1, F.lit(1)), F.lit(2))).alias("node_id")
    ).distinct().withColumn("__wraps", F.lit(True))
    tag = F.lower("tag")
    wraps = F.coalesce("__wraps", F.lit(False))
    data = F.array_join(F.map_values(F.map_filter("attrs", lambda k, v: k.startswith("data-"))), " ")
    searching = (
        F.lower(attr("class")).rlike(SEARCH_WORDS) | F.lower(attr("id")).rlike(SEARCH_WORDS) | F.lower(data).rlike(SEARCH_WORDS)
    )
    prop = _decisive_property()
    handlers = F.arrays_overlap(F.map_keys("attrs"), F.array(*[F.lit(a) for a in HANDLER_ATTRIBUTES]))
    icon = (
        F.col("w").between(10, 50) & F.col("h").between(10, 50)
        & F.arrays_overlap(F.map_keys("attrs"), F.array(*[F.lit(a) for a in ICON_ATTRIBUTES]))
    )
    verdict = (
        F.when(tag.startswith("#") | tag.isin("html", "body"), F.lit(False))
        .when(F.col("js_listener"), F.lit(True))
        .when(tag.isin("iframe", "frame") & (F.col("w") > 100) & (F.col("h") > 100), F.lit(True))
        .when((tag == "label") & (attr("for") != ""), F.lit(False))
        .when(tag.isin("label", "span") & wraps, F.lit(True))
        .when(searching, F.lit(True))
        .when(prop.isNotNull(), prop)
        .when(tag.isin(INTERACTIVE_TAGS), F.lit(True))
        .when(handlers, F.lit(True))
        .when(attr("role").isin(INTERACTIVE_ROLES), F.lit(True))
        .when(F.col("ax_role").isin([*INTERACTIVE_ROLES, "listbox"]), F.lit(True))
        .when(icon, F.lit(True))
        .otherwise(F.coalesce(F.col("cursor") == "pointer", F.lit(False)))
    )
    return nodes.join(controls, KEY, "left").withColumn("interactive", F.coalesce(verdict, F.lit(False))).drop("__wraps")


def css_visible(nodes: DataFrame, threshold: float = 1000.0) -> DataFrame:
    """Adds ``visible``: styles allow it, and the box meets the view of every frame around it.

    Frames are ``iframe``/``frame`` elements (offset) and ``html`` elements with ``scroll_x, scroll_y,
    view_w, view_h``; the innermost comes first.
    """
    is_frame = F.col("tag").isin("iframe", "frame")
    frames = nodes.where(is_frame | ((F.col("tag") == "html") & F.col("view_w").isNotNull()))
    around = ancestors(
        nodes.select(*KEY, "anc_ids"),
        frames.select(
            *KEY,
            F.struct(
                is_frame.alias("shift"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"),
                "scroll_x", "scroll_y", "view_w", "view_h",
            ).alias("__frame"),
        ),
        ["__frame"],
    ).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("distance", "__frame"))).alias("__frames"))

    def enter(acc: Column, f: Column) -> Column:
        fr = f["__frame"]
        px, py = acc["x"] - fr["scroll_x"], acc["y"] - fr["scroll_y"]
        meets = (
            (px < fr["view_w"]) & (px + F.col("w") > 0) & (py < fr["view_h"] + threshold) & (py + F.col("h") > -threshold)
        )
        return F.when(
            fr["shift"], F.struct((acc["x"] + fr["x"]).alias("x"), (acc["y"] + fr["y"]).alias("y"), acc["ok"].alias("ok"))
        ).otherwise(F.struct(px.alias("x"), py.alias("y"), (acc["ok"] & meets).alias("ok")))

    start = F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.lit(True).alias("ok"))
    seen = F.when(F.col("__frames").isNull(), F.lit(True)).otherwise(F.aggregate("__frames", start, enter)["ok"])
    styled = (
        (F.lower(F.coalesce("display", F.lit(""))) != "none")
        & (F.lower(F.coalesce("visibility", F.lit(""))) != "hidden")
        & (F.coalesce("opacity", F.lit(1.0)) > 0)
        & F.col("x").isNotNull()
    )
    return nodes.join(around, KEY, "left").withColumn("visible", styled & F.coalesce(seen, F.lit(False))).drop("__frames")


def propagates(tag: Column, role: Column) -> Column:
    """Elements whose box stands for everything inside."""
    return tag.isin("a", "button") | (tag.isin("div", "span") & role.isin("button", "combobox")) | ((tag == "input") & (role == "combobox"))


def bbox_exclude(nodes: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Adds ``excluded``: at least ``threshold`` of the box lies in the nearest propagating ancestor's.

    Texts, form fields, propagating elements, handlers, labelled elements and usable roles stay.
    """
    tag, role = F.lower("tag"), attr("role")
    boxes = nodes.where(propagates(tag, role) & F.col("x").isNotNull()).select(*KEY, F.struct("x", "y", "w", "h").alias("box"))
    nearest = ancestors(nodes.select(*KEY, "anc_ids"), boxes, ["box"]).groupBy(*KEY).agg(
        F.min_by("box", "distance").alias("__box")
    )
    b = F.col("__box")
    across = F.greatest(F.lit(0.0), F.least(F.col("x") + F.col("w"), b["x"] + b["w"]) - F.greatest("x", b["x"]))
    down = F.greatest(F.lit(0.0), F.least(F.col("y") + F.col("h"), b["y"] + b["h"]) - F.greatest("y", b["y"]))
    area = F.col("w") * F.col("h")
    inside = (area > 0) & (across * down / area >= threshold)
    keep = (
        tag.startswith("#") | tag.isin("input", "select", "textarea", "label") | propagates(tag, role) | has_attr("onclick")
        | (F.trim(attr("aria-label")) != "")
        | role.isin("button", "link", "checkbox", "radio", "tab", "menuitem", "option")
    )
    return nodes.join(nearest, KEY, "left").withColumn(
        "excluded", F.coalesce(b.isNotNull() & inside & ~keep, F.lit(False))
    ).drop("__box")


def new_nodes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Adds ``is_new``: usable elements that the previous snapshot lacks."""
    seen = previous.select(*KEY, F.lit(True).alias("__seen"))
    return current.join(seen, KEY, "left").withColumn(
        "is_new", F.col("interactive") & (F.col("__seen").isNull() | F.coalesce("compound", F.lit(False)))
    ).drop("__seen")


# Levels of re-matching, strictest first.
LEVELS = ["EXACT", "STABLE", "XPATH", "AX_NAME", "ATTRIBUTE"]


def _match_keys() -> Column:
    """(level, key) pairs under which an element can be found."""
    tag = F.lower("tag")

    def tagged(value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat_ws("\u0001", tag, value))

    keys = [
        (1, F.col("element_hash")), (2, F.col("stable_hash")), (3, F.nullif(F.col("xpath"), F.lit(""))),
        (4, tagged(F.col("ax_name"))),
        (5, tagged(F.col("attrs")["name"])), (6, tagged(F.col("attrs")["id"])), (7, tagged(F.col("attrs")["aria-label"])),
    ]
    return F.array(*[F.struct(F.lit(level).alias("level"), key.alias("key")) for level, key in keys])


def _with_keys(elements: DataFrame) -> DataFrame:
    return elements.withColumn("__keys", _match_keys())


def rematch_elements(history: DataFrame, current: DataFrame, scope: str = "page_id") -> DataFrame:
    """For each historic element the current one it is, by the strictest level that finds any.

    Current elements are reduced to the first in page order per (level, key) before the join, so no
    key has more than one partner and all levels share one join.
    """
    targets = (
        _with_keys(current).select(scope, "node_id", "ord", F.explode_outer("__keys").alias("m"))
        .select(scope, "node_id", "ord", "m.level", "m.key").where("key IS NOT NULL")
        .groupBy(scope, "level", "key").agg(F.min_by("node_id", "ord").alias("match_id"))
    )
    wanted = (
        _with_keys(history).select(scope, "node_id", F.explode_outer("__keys").alias("m"))
        .select(scope, "node_id", "m.level", "m.key").where("key IS NOT NULL")
    )
    hits = wanted.join(targets, [scope, "level", "key"]).groupBy(scope, "node_id").agg(
        F.min(F.struct("level", "match_id")).alias("best")
    )
    names = F.array(*[F.lit(n) for n in LEVELS])
    return history.select(scope, "node_id").join(hits, [scope, "node_id"], "left").select(
        scope, "node_id", F.col("best.match_id").alias("match_id"),
        F.element_at(names, F.least(F.col("best.level"), F.lit(5))).alias("match_level"),
    )


def dom_join(dom: DataFrame, snapshots: DataFrame, ax: DataFrame) -> DataFrame:
    """DOM nodes with layout and accessibility facts.

    A snapshot row holds parallel arrays per page (``node_index, bounds_x, …, style``), a string table
    and the pixel ratio; the first layout entry of a node counts; style indexes point into the table.
    """
    entry = F.posexplode(
        F.arrays_zip("layout_node", "bounds_x", "bounds_y", "bounds_w", "bounds_h", "style")
    ).alias("__i", "l")
    rows = snapshots.select("page_id", "ratio", "strings", entry).select(
        "page_id", F.col("l.layout_node").alias("node_id"), "__i",
        *[(F.col(f"l.bounds_{c}") / F.col("ratio")).alias(c) for c in "xywh"],
        F.try_element_at("strings", (F.col("l.style") + 1).cast("int")).alias("display"),
    )
    first = rows.groupBy("page_id", "node_id").agg(F.min_by(F.struct("x", "y", "w", "h", "display"), "__i").alias("f")).select(
        "page_id", "node_id", "f.*"
    )
    return dom.join(first, KEY, "left").join(ax.select(*KEY, "ax_name", "ax_role"), KEY, "left")


# Words on paging buttons, tested in this order.
PAGING = [
    ("next", r"next|>|»|→|siguiente|suivant|weiter|volgende"),
    ("prev", r"prev|<|«|←|anterior|précédent|zurück|vorige"),
    ("first", r"first|⇤|«|primera|première|erste|eerste"),
    ("last", r"last|⇥|»|última|dernier|letzte|laatste"),
]


def pagination_buttons(nodes: DataFrame) -> DataFrame:
    """Usable elements (``clickable``) that turn pages, by their text and labels; needs ``subtree_text``."""
    text = F.lower(F.trim("subtree_text"))
    label, title, css = F.lower(attr("aria-label")), F.lower(attr("title")), F.lower(attr("class"))
    everything = F.concat_ws(" ", text, label, title, css)
    kind = F.when(F.lit(False), "")
    for name, words in PAGING:
        kind = kind.when(everything.rlike(words), name)
    number = text.rlike(r"^\d{1,2}$") & F.lower(attr("role")).isin("button", "link", "")
    kind = kind.when(number, "page_number")
    disabled = (attr("disabled") == "true") | (attr("aria-disabled") == "true") | css.contains("disabled")
    shown = F.coalesce(F.nullif(F.trim("subtree_text"), F.lit("")), F.nullif(label, F.lit("")), title)
    return (
        nodes.where("clickable").withColumn("button_type", kind).where("button_type IS NOT NULL")
        .select(*KEY, "button_type", shown.alias("text"), disabled.alias("is_disabled"))
    )


# ---- selectors -----------------------------------------------------------------------------------


COMPOUND = r"""(?P<tag>^(?:[\w-]+|\*))|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[\^$*~]?=)\s*["']?(?P<val>[^"'\]]*)["']?\s*(?:i\s*)?)?\]"""


def compound(selector: str) -> Column:
    """Predicate of one compound selector: ``tag#id.class[attr]``, ``[attr=v]``, ``^=``, ``$=``, ``*=``, ``~=``."""
    test = ~F.col("tag").startswith("#")
    covered = 0
    for m in re.finditer(COMPOUND, selector, re.VERBOSE):
        covered += len(m.group(0))
        if m["tag"] and m["tag"] != "*":
            test = test & (F.col("tag") == m["tag"].lower())
        elif m["id"]:
            test = test & (attr("id") == m["id"])
        elif m["cls"]:
            test = test & F.array_contains(F.split(attr("class"), r"\s+"), m["cls"])
        elif m["attr"]:
            value, name = attr(m["attr"]), m["attr"]
            checks = {
                None: has_attr(name), "=": value == m["val"], "^=": value.startswith(m["val"] or ""),
                "$=": value.endswith(m["val"] or ""), "*=": value.contains(m["val"] or ""),
                "~=": F.array_contains(F.split(value, r"\s+"), m["val"] or ""),
            }
            test = test & checks[m["op"]]
    if covered != len(selector):
        raise ValueError(f"unsupported selector: {selector}")
    return test


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """Nodes a selector names.  Alternatives are unions, descendants and children are semi joins."""
    found: DataFrame | None = None
    for alternative in selector.split(","):
        parts = alternative.replace(">", " > ").split()
        hits = nodes.where(compound(parts[0]))
        child = False
        for part in parts[1:]:
            if part == ">":
                child = True
                continue
            holders = hits.select("page_id", F.col("node_id").alias("__anc"))
            below = nodes.where(compound(part))
            if child:
                hits = below.join(sorted_side(holders), (below["page_id"] == holders["page_id"]) & (below["parent_id"] == holders["__anc"]), "left_semi")
            else:
                reach = below.select("page_id", "node_id", F.explode("anc_ids").alias("__anc"))
                hits = below.join(sorted_side(reach.join(sorted_side(holders), ["page_id", "__anc"], "left_semi").select(*KEY)), KEY, "left_semi")
            child = False
        found = hits if found is None else found.unionByName(hits).dropDuplicates(KEY)
    return found


STEPS = (
    "site string, rule string, alternative int, k int, child boolean, last boolean, tag_is string, id_is string, classes array<string>, "
    "tests array<struct<name: string, op: string, value: string>>"
)


def selector_steps(site: str, rule: str, selector: str) -> list[tuple]:
    """A selector as rows, one for each compound of each alternative; ``rule`` tells what the site uses it for."""
    rows = []
    for n, alternative in enumerate(selector.split(",")):
        parts = alternative.replace(">", " > ").split()
        steps = [(part, k > 0 and parts[k - 1] == ">") for k, part in enumerate(parts) if part != ">"]
        for k, (part, child) in enumerate(steps):
            found = list(re.finditer(COMPOUND, part, re.VERBOSE))
            if sum(len(m.group(0)) for m in found) != len(part):
                raise ValueError(f"unsupported selector: {part}")
            tag = next((m["tag"].lower() for m in found if m["tag"] and m["tag"] != "*"), None)
            own_id = next((m["id"] for m in found if m["id"]), None)
            tests = [(m["attr"], m["op"], m["val"] or "") for m in found if m["attr"]]
            rows.append((site, rule, n, k, child, k == len(steps) - 1, tag, own_id, [m["cls"] for m in found if m["cls"]], tests))
    return rows


def _passes(test: Column) -> Column:
    value = F.coalesce(F.try_element_at("attrs", test["name"]), F.lit(""))
    return (
        F.when(test["op"].isNull(), F.array_contains(F.map_keys("attrs"), test["name"])).when(test["op"] == "=", value == test["value"])
        .when(test["op"] == "^=", value.startswith(test["value"])).when(test["op"] == "$=", value.endswith(test["value"]))
        .when(test["op"] == "*=", value.contains(test["value"])).otherwise(F.array_contains(F.split(value, r"\s+"), test["value"]))
    )


def select_by_rules(nodes: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """Nodes (with their ``site``) that the selectors of their site name, with ``rule``: all sites and rules in one plan.

    ``rows`` are those of ``selector_steps``.  A node meets the compounds of its own site in an equi-join; what stands left of a compound
    is then looked for among its ancestors, one join for each level of the longest selector.
    """
    steps = nodes.sparkSession.createDataFrame(list(rows), STEPS)
    classes = F.split(attr("class"), r"\s+")
    fits = (
        ~F.col("tag").startswith("#") & (F.col("tag_is").isNull() | (F.col("tag") == F.col("tag_is"))) & (F.col("id_is").isNull() | (attr("id") == F.col("id_is")))
        & F.forall("classes", lambda c: F.array_contains(classes, c)) & F.forall("tests", _passes)
    )
    kept = ["page_id", "node_id", "parent_id", "ord", "tag", "attrs", "anc_ids", "site", "rule", "alternative", "k", "child", "last"]
    matched = nodes.join(steps, "site").where(fits).select(*kept)
    valid = matched.where("k = 0")
    found = valid.where("last")
    own = [*KEY, "rule", "alternative"]
    for k in range(1, max((row[3] for row in rows), default=0) + 1):
        holders = valid.select("page_id", "rule", "alternative", F.col("node_id").alias("__anc"))
        asked = matched.where(F.col("k") == k)
        reach = asked.select(*own, F.explode(F.when(F.col("child"), F.array("parent_id")).otherwise(F.col("anc_ids"))).alias("__anc"))
        reached = reach.join(sorted_side(holders), ["page_id", "rule", "alternative", "__anc"], "left_semi").select(*own)
        valid = asked.join(sorted_side(reached), own, "left_semi")
        found = found.unionByName(valid.where("last"))
    return found.drop("alternative", "k", "child", "last").dropDuplicates([*KEY, "rule"])


def clipped(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def node_text(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """``text_content`` of the chosen elements: their text nodes in document order, joined as they are."""
    texts = nodes.where(F.col("tag") == "#text").select("page_id", "ord", "text", F.explode("anc_ids").alias("node_id"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "")
    # Only texts below chosen elements are gathered.
    joined = texts.join(sorted_side(chosen.select(*KEY)), KEY, "left_semi").groupBy(*KEY).agg(whole.alias("text_content"))
    return chosen.join(sorted_side(joined), KEY, "left").withColumn("text_content", F.coalesce("text_content", F.lit("")))


def find_elements(nodes: DataFrame, selector: str, attributes: Sequence[str] = (), max_results: int = 50) -> DataFrame:
    """The first ``max_results`` matches per page with text, attributes, child count and the total."""
    hits = select_nodes(nodes, selector).select(*KEY, "ord", "tag", "attrs")
    totals = hits.groupBy("page_id").agg(F.count("*").alias("total"))
    # Spark prunes a rank filter before the shuffle, so at most max_results rows per task and page move.
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))
    top = hits.withColumn("__rank", rank).where(F.col("__rank") <= max_results).withColumn(
        "index", (F.col("__rank") - 1).cast("bigint")
    ).drop("__rank")
    children = nodes.where(~F.col("tag").startswith("#")).groupBy("page_id", F.col("parent_id").alias("node_id")).agg(
        F.count("*").alias("children_count")
    )
    shown = node_text(nodes, top).join(children, KEY, "left").join(totals, "page_id")
    text = clipped(F.regexp_replace("text_content", r"(?U)^\s+|\s+$", ""), 300)
    return shown.select(
        *KEY, "index", "tag", text.alias("text"),
        *[clipped(F.col("attrs")[a], 500).alias(a.replace("-", "_")) for a in attributes],
        F.coalesce("children_count", F.lit(0)).alias("children_count"), "total",
    )


# Boxes of a page in one band, on average.
BAND_BOXES = 2_000


def occluded(nodes: DataFrame) -> DataFrame:
    """Nodes whose box is wholly under opaque boxes painted above it (a layer does not cover itself).

    A box shows if somewhere in it no opaque box of a higher layer lies.  Pages are cut into bands, and a box is looked at in every band
    it reaches into, so a page of any number of boxes is several tasks; a band is swept from left to right.  A box without width or
    height counts as the least one that has both; nodes without place, size or paint order are no boxes.
    """
    opaque = (F.coalesce("background", F.lit("rgba(0, 0, 0, 0)")) != "rgba(0, 0, 0, 0)") & (
        F.coalesce("opacity", F.lit(1.0)) >= 0.8
    )
    placed = nodes.where("paint_order IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL")
    boxes = placed.select(
        "page_id", "node_id", F.col("paint_order").cast("double").alias("layer"), opaque.alias("opaque"),
        *(F.col(c).cast("double").alias(c) for c in ("x", "y")), (F.col("x") + F.greatest("w", F.lit(0))).cast("double").alias("right"), (F.col("y") + F.greatest("h", F.lit(0))).cast("double").alias("bottom"),
    )
    pages = boxes.groupBy("page_id").agg(F.min("x").alias("__from"), F.max("right").alias("__to"), (1 + F.floor(F.count("*") / BAND_BOXES)).cast("int").alias("__bands"))
    wide = F.greatest((F.col("__to") - F.col("__from")) / F.col("__bands"), F.lit(1e-9))
    # A little more on both sides, against rounding.
    band_of = lambda at, by: F.least(F.greatest(F.floor((F.col(at) - F.col("__from")) / wide + by).cast("int"), F.lit(0)), F.col("__bands") - 1)
    banded = boxes.join(pages, "page_id").withColumn("band", F.explode(F.sequence(band_of("x", -1e-6), band_of("right", 1e-6))))
    start = F.when(F.col("band") > 0, F.col("__from") + F.col("band") * wide).otherwise(F.lit(float("-inf")))
    stop = F.when(F.col("band") < F.col("__bands") - 1, F.col("__from") + (F.col("band") + 1) * wide).otherwise(F.lit(float("inf")))
    banded = banded.select(*boxes.columns, "band", start.alias("start"), stop.alias("stop"))

    def sweep(band: pd.DataFrame) -> pd.DataFrame:
        return band.loc[_showing(band), ["page_id", "node_id"]]

    showing = banded.groupBy("page_id", "band").applyInPandas(sweep, "page_id bigint, node_id bigint").distinct()
    return boxes.select("page_id", "node_id").join(showing, ["page_id", "node_id"], "left_anti")


def _showing(band: pd.DataFrame) -> np.ndarray:
    """Which boxes of a band show: in a strip between edges of opaque boxes, the highest opaque layer along the height is known."""
    x, right, y, bottom, layer = (band[c].to_numpy(float) for c in ("x", "right", "y", "bottom", "layer"))
    right, bottom = np.maximum(right, np.nextafter(x, np.inf)), np.maximum(bottom, np.nextafter(y, np.inf))
    start, stop = band["start"].iat[0], band["stop"].iat[0]
    opaque = band["opaque"].to_numpy(bool)
    edges = np.unique(np.concatenate([x[opaque], right[opaque]]))
    edges = np.concatenate([[start], edges[(edges > start) & (edges < stop)], [stop]])
    heights = np.unique(np.concatenate([y, bottom]))
    top, low = np.searchsorted(heights, y), np.searchsorted(heights, bottom)
    # Strips that a box reaches into: the first one, and the one after the last.
    first, last = np.searchsorted(edges, x, "right") - 1, np.searchsorted(edges, right, "left")
    first = np.maximum(first, 0)
    covers = np.flatnonzero(opaque)[np.argsort(layer[opaque], kind="stable")]
    shows = np.zeros(len(band), bool)
    for strip in range(len(edges) - 1):
        asked = np.flatnonzero(~shows & (first <= strip) & (last > strip))
        if not len(asked):
            continue
        highest = np.full(len(heights), -np.inf)
        for k in covers[(first[covers] <= strip) & (last[covers] > strip)]:
            highest[top[k] : low[k]] = layer[k]
        for k in asked:
            shows[k] = highest[top[k] : low[k]].min() <= layer[k]
    return shows
