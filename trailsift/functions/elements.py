"""Expressions over page elements: classes, hashes, scroll numbers, visibility rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in class names that tell a passing state.
STATE_WORDS = [
    "focus", "hover", "active", "selected", "disabled", "animation", "transition", "loading", "open", "closed",
    "expanded", "collapsed", "visible", "hidden", "pressed", "checked", "highlighted", "current", "entering", "leaving",
]


def stable_classes(classes: Column) -> Column:
    """Classes without state words, sorted."""
    state = "|".join(STATE_WORDS)
    parts = F.filter(F.split(F.coalesce(classes, F.lit("")), r"\s+"), lambda c: (c != "") & ~F.lower(c).rlike(state))
    return F.array_join(F.array_sort(parts), " ")


def _hash(path: Column, attrs: Column, ax_name: Column) -> Column:
    entries = F.array_sort(F.map_entries(F.map_filter(attrs, lambda k, v: v.isNotNull())))
    body = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "")
    name = F.when(F.coalesce(ax_name, F.lit("")) != "", F.concat(F.lit("|ax_name="), ax_name)).otherwise("")
    # 16 hex digits are an unsigned 64-bit number, too large for BIGINT, so they stay text.
    return F.substring(F.sha2(F.concat(F.array_join(path, "/"), F.lit("|"), body, name), 256), 1, 16)


def element_hash(path: Column, attrs: Column, ax_name: Column) -> Column:
    """Hash of the tag path, the static attributes in name order and the accessible name."""
    return _hash(path, attrs, ax_name)


def stable_hash(path: Column, attrs: Column, ax_name: Column) -> Column:
    """The same with state classes left out."""
    cleaned = F.map_filter(
        F.transform_values(attrs, lambda k, v: F.when(k == "class", stable_classes(v)).otherwise(v)),
        lambda k, v: ~((k == "class") & (v == "")),
    )
    return _hash(path, cleaned, ax_name)


def parent_hash(path: Column) -> Column:
    return F.substring(F.sha2(F.array_join(path, "/"), 256), 1, 16)


def scroll_metrics(top: Column, left: Column, height: Column, width: Column, view_h: Column, view_w: Column) -> dict[str, Column]:
    """Content above, below, left and right of the view, in pixels, percent and pages."""
    below = F.greatest(F.lit(0.0), height - view_h - top)
    right = F.greatest(F.lit(0.0), width - view_w - left)
    above = F.greatest(F.lit(0.0), top)

    def pages(x: Column, otherwise: float) -> Column:
        return F.bround(F.when(view_h > 0, x / view_h).otherwise(F.lit(otherwise)), 1)

    return {
        "content_above": above,
        "content_below": below,
        "content_left": F.greatest(F.lit(0.0), left),
        "content_right": right,
        "vertical_pct": F.bround(F.when(height > view_h, top / (height - view_h) * 100).otherwise(F.lit(0.0)), 1),
        "horizontal_pct": F.bround(F.when(width > view_w, left / (width - view_w) * 100).otherwise(F.lit(0.0)), 1),
        "pages_above": pages(above, 0.0),
        "pages_below": pages(below, 0.0),
        "total_pages": pages(height, 1.0),
    }
