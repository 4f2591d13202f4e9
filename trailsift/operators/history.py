"""Run histories: repetition, stagnation, retries, summaries, windows over steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailsift.functions import trace as tr
from trailsift.operators.catalog import assign_sequences
from trailsift.plans import ordered

STAGNANT_AT = 5  # fixed value
WINDOW = 20  # fixed value


def number_steps(actions: DataFrame, run: str = "run", position: str = "pos", block: Column | None = None) -> DataFrame:
    """Dense 1-based step within each run; long runs are cut into blocks of positions."""
    chosen = ordered.position_block(position) if block is None else block
    return ordered.number_rows(actions, [run], [position], chosen, "step")


def loop_detector(actions: DataFrame, run: str = "run", position: str = "pos", window: int = WINDOW) -> DataFrame:
    """Most repeated action among the last ``window`` ones, ties to the earliest, and the warning tier."""
    counted = actions.where(~tr.loop_exempt(F.col("name"))).withColumn(
        "action_hash", tr.action_hash(F.col("name"), F.col("params"))
    )
    rolled = ordered.rolling_list(
        counted, [run], [position], ordered.position_block(position), F.col("action_hash"), window, "recent"
    )
    different = rolled.withColumn("__kinds", F.array_distinct("recent"))
    counts = different.withColumn(
        "__counts", F.transform("__kinds", lambda h: F.size(F.filter("recent", lambda x: x == h)))
    )
    best = counts.withColumn("repetitions", F.array_max("__counts"))
    tier = F.lit(0)
    for level, at in enumerate(reversed(tr.LOOP_TIERS), start=1):
        tier = F.when(F.col("repetitions") >= at, level).otherwise(tier)
    return (
        best.withColumn(
            "most_repeated", F.element_at("__kinds", F.array_position("__counts", F.col("repetitions")).cast("int"))
        )
        .withColumn("tier", tier)
        .drop("__kinds", "__counts")
    )


def page_stagnation(states: DataFrame, run: str = "run", position: str = "pos") -> DataFrame:
    """How many steps in a row the page stayed the same; the first of a stretch counts 0."""
    block = ordered.position_block(position)
    marked = states.withColumn("fingerprint", tr.page_fingerprint(F.col("url"), F.col("dom_text"), F.col("element_count")))
    seen = ordered.previous(marked, [run], [position], block, {"__before": F.col("fingerprint")})
    changed = ~F.col("__before").eqNullSafe(F.col("fingerprint"))
    out = ordered.island_ordinal(seen, [run], [position], block, changed, "__nth")
    return out.withColumn("stagnant", F.col("__nth") - 1).withColumn(
        "flagged", F.col("stagnant") >= STAGNANT_AT
    ).drop("__before", "__nth")


def redundant_retry(steps: DataFrame, run: str = "run", position: str = "pos") -> DataFrame:
    """Steps that repeat the previous, successful one: the same element by any identity, the same action."""
    before = {
        "__ok": F.col("error").isNull(), "__hash": F.col("element_hash"), "__stable": F.col("stable_hash"),
        "__xpath": F.col("x_path"), "__name": F.col("name"),
    }
    seen = ordered.previous(steps, [run], [position], ordered.position_block(position), before)
    same = (
        (F.col("element_hash") == F.col("__hash"))
        | F.coalesce(F.col("stable_hash") == F.col("__stable"), F.lit(False))
        | F.col("x_path").eqNullSafe(F.col("__xpath"))
    )
    both = F.col("element_hash").isNotNull() & F.col("__hash").isNotNull()
    redundant = F.coalesce(F.col("__ok") & both & same & (F.col("name") == F.col("__name")), F.lit(False))
    return seen.withColumn("redundant", redundant).drop(*before)


def run_summary(steps: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """One row per run: steps, time, errors, and what the last step's last result says.

    Lists (addresses, errors, contents) stay as rows, see ``run_errors`` and ``run_contents``: a run
    has no bound on its length.
    """
    return steps.groupBy(run).agg(
        F.count("*").alias("steps"),
        F.sum("seconds").alias("seconds"),
        F.count_if(F.col("error").isNotNull()).alias("error_steps"),
        F.max(F.col("error").isNotNull()).alias("has_errors"),
        F.max_by("name", step).alias("last_action"),
        F.max_by("is_done", step).alias("is_done"),
        F.max_by(F.when(F.col("is_done"), F.col("success")), step).alias("is_successful"),
        F.max_by("extracted", step).alias("final_result"),
        F.max_by("verdict", step).alias("verdict"),
    )


def run_errors(steps: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """The first error of each failed step."""
    return steps.where("error IS NOT NULL").select(run, step, "error")


def run_contents(steps: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Extracted contents in step order (a row each)."""
    return steps.where(F.coalesce("extracted", F.lit("")) != "").select(run, step, "extracted")


def run_urls(steps: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """The address of each step that has one (a row each, in step order)."""
    return steps.where(F.coalesce("url", F.lit("")) != "").select(run, step, "url")


def step_actions(actions: DataFrame, run: str = "run", step: str = "step", position: str = "pos") -> DataFrame:
    """Action names of each step with their place in it; long runs are cut into blocks."""
    placed = actions.withColumn("nth", F.row_number().over(Window.partitionBy(run, step).orderBy(position)))
    return placed.select(run, step, F.col("nth").cast("bigint").alias("nth"), "name")


def judgements(steps: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Per judged run: the last verdict, the step it was given at, how often it was given, and whether it ever changed."""
    judged = steps.where("verdict IS NOT NULL")
    return judged.groupBy(run).agg(
        F.max_by("verdict", step).alias("verdict"), F.max(step).alias("judged_at"), F.count("*").alias("times"),
        (F.min("verdict") != F.max("verdict")).alias("changed"),
    )


def action_counts(actions: DataFrame, run: str = "run") -> DataFrame:
    return actions.groupBy(run, "name").agg(F.count("*").alias("n"))


def filter_actions(actions: DataFrame, include: Sequence[str]) -> DataFrame:
    """Actions whose name is in ``include``; a name given twice gives its actions twice."""
    times = F.array(*[F.when(F.col("name") == n, F.lit(n)) for n in include])
    return actions.withColumn("__hit", F.explode(F.array_compact(times))).drop("__hit")


def agent_event(summary: DataFrame, run_tokens: DataFrame, run: str = "run") -> DataFrame:
    """One event per run: its summary and the tokens that this run used."""
    return summary.join(run_tokens, run, "left")


def expected_elements(actions: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Elements a page must have for a step's actions: the largest index plus one, at most 50."""
    index = F.get_json_object("params", "$.index").try_cast("bigint")
    return actions.groupBy(run, step).agg(
        F.coalesce(F.least(F.max(index) + 1, F.lit(50)), F.lit(0)).cast("bigint").alias("expected")
    )


def zip_steps(columns: Sequence[str], out: str = "zipped") -> Column:
    """Elements of several arrays side by side, as long as the shortest (``arrays_zip`` alone pads)."""
    shortest = F.least(*[F.size(c) for c in columns])
    return F.slice(F.arrays_zip(*columns), F.lit(1), F.greatest(shortest, F.lit(0))).alias(out)


def keep_first_last(items: DataFrame, keep: int, run: str = "run", position: str = "pos", text: str = "text") -> DataFrame:
    """The first item, a marker for what is left out, and the last ``keep - 1``; short runs stay whole."""
    numbered = ordered.number_rows(items, [run], [position], ordered.position_block(position), "nth")
    totals = items.groupBy(run).agg(F.count("*").alias("total"))
    sized = numbered.join(totals, run)
    kept = sized.where(
        (F.col("total") <= keep) | (F.col("nth") == 1) | (F.col("nth") > F.col("total") - (keep - 1))
    ).select(run, "nth", F.col(text).alias("text"))
    note = F.concat(F.lit("[... "), (F.col("total") - keep).cast("string"), F.lit(" previous steps omitted...]"))
    marker = totals.where(F.col("total") > keep).select(run, F.lit(2).cast("bigint").alias("nth"), note.alias("text"))
    # The marker stands second; the kept tail begins at total - keep + 2 > 2.
    return kept.unionByName(marker)


def last_n(items: DataFrame, n: int, run: str = "run", position: str = "pos") -> DataFrame:
    """The last ``n`` rows of each run."""
    numbered = ordered.number_rows(items, [run], [position], ordered.position_block(position), "__nth")
    totals = items.groupBy(run).agg(F.count("*").alias("__total"))
    return numbered.join(totals, run).where(F.col("__nth") > F.col("__total") - n).drop("__nth", "__total")


def unique_names(rows: DataFrame, scope: Sequence[str], name: str, position: str, first: int = 2, out: str = "unique_name") -> DataFrame:
    """Repeats of a name get the suffixes ``_2``, ``_3`` …; suffixed forms that stand in the data are skipped."""
    keys = [*scope, name]
    block = ordered.position_block(position)
    numbered = ordered.number_rows(rows, keys, [position], block, "__nth")
    literal = rows.select(
        *scope, F.regexp_extract(name, r"(?s)^(.*)_\d+$", 1).alias(name),
        F.regexp_extract(name, r"_(\d+)$", 1).try_cast("bigint").alias("__suffix"),  # beyond a long no row gets there
    ).where(F.col("__suffix").isNotNull())
    again = assign_sequences(
        numbered.where("__nth > 1").select(*keys, position), literal, first, position, keys, "__suffix"
    )
    joined = numbered.join(again, [*keys, position], "left")
    return joined.withColumn(
        out, F.when(F.col("__suffix").isNull(), F.col(name)).otherwise(F.concat(name, F.lit("_"), F.col("__suffix").cast("string")))
    ).drop("__nth", "__suffix")


def unique_paths(rows: DataFrame, existing: DataFrame, folder: str, name: str, position: str, out: str = "unique_name") -> DataFrame:
    """File names that overwrite nothing: the first of a path keeps its name if no file has it, the others get the path's hash.

    ``a.tif`` becomes ``a_`` and eight digits of the SHA-1 of the path, then the same with ``_1``, ``_2`` …  Forms that stand among the
    existing files or in the data are skipped.
    """
    keys = [folder, name]
    block = ordered.position_block(position)
    parts = r"(?s)^(.+?)(\.[^.]+)?$"
    digest = lambda n: F.substring(F.sha1(F.concat_ws("/", folder, n)), 1, 8)
    everything = rows.select(*keys).unionByName(existing.select(*keys))
    hashed = r"(?s)^(.+)_([0-9a-f]{8})(?:_([1-9]\d*))?(\.[^.]+)?$"
    bare = F.concat(F.regexp_extract(name, hashed, 1), F.regexp_extract(name, hashed, 4))
    literal = everything.where(F.col(name).rlike(hashed) & (digest(bare) == F.regexp_extract(name, hashed, 2))).select(
        folder, bare.alias(name), F.coalesce(F.regexp_extract(name, hashed, 3).try_cast("bigint"), F.lit(0)).alias("__suffix")
    )
    numbered = ordered.number_rows(rows, keys, [position], block, "__nth")
    held = existing.select(*keys).distinct().withColumn("__held", F.lit(True))
    late = numbered.join(held, keys, "left").where((F.col("__nth") > 1) | F.col("__held"))
    again = assign_sequences(late.select(*keys, position), literal, 0, position, keys, "__suffix")
    count = F.when(F.col("__suffix") > 0, F.concat(F.lit("_"), F.col("__suffix").cast("string"))).otherwise("")
    moved = F.concat(F.regexp_extract(name, parts, 1), F.lit("_"), digest(F.col(name)), count, F.regexp_extract(name, parts, 2))
    joined = numbered.join(again, [*keys, position], "left")
    return joined.withColumn(out, F.when(F.col("__suffix").isNull(), F.col(name)).otherwise(moved)).drop("__nth", "__suffix")


def first_seen(rows: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str]) -> DataFrame:
    """The first row of each distinct value, as a combining aggregate."""
    picked = F.min_by(F.struct(position, *columns), position).alias("__p")
    return rows.groupBy(*keys).agg(picked).select(*keys, "__p.*")


def secret_name_of(values: DataFrame, secrets: DataFrame, value: str = "value") -> DataFrame:
    """Name of the secret a value is; the first secret (``ord``) of equal values wins."""
    names = secrets.where(F.coalesce("value", F.lit("")) != "").groupBy(F.col("value").alias(value)).agg(
        F.min_by("name", "ord").alias("secret_name")
    )
    return values.join(names, value, "left")


def menu_opener(attrs: Column) -> Column:
    """Does the element open a menu?"""
    def a(name: str) -> Column:
        return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))

    return (
        a("aria-haspopup").isin("true", "menu", "listbox")
        | (a("data-gw-click") == "toggleSubMenu")
        | a("class").contains("expand-button")
        | (a("role").isin("menuitem", "button") & a("aria-expanded").isin("true", "false"))
    )


def menu_item(attrs: Column, ax_name: Column) -> Column:
    """Does the element look like an entry of a menu?"""
    def a(name: str) -> Column:
        return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))

    lower = F.lower(a("class"))
    return (
        a("role").isin("menuitem", "option", "menuitemcheckbox", "menuitemradio", "treeitem")
        | a("class").contains("gw-action--inner")
        | lower.contains("menuitem")
        | ((F.coalesce(ax_name, F.lit("")) != "") & lower.rlike("dropdown|popup|menu|action"))
    )
