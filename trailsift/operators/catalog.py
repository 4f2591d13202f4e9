"""Crawl-record catalog: resolve, deduplicate, upsert, validate, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailsift.functions import text as tx
from trailsift.functions import urls as u
from trailsift.plans import ordered
from trailsift.plans.lookup import narrowed, pick
from trailsift.session import cut


def downloaded(records: DataFrame, titled: bool = False) -> DataFrame:
    """Records that were downloaded (and, if asked, have a title)."""
    kept = records.where(F.col("status") == "downloaded")
    return kept.where(tx.strip(F.coalesce("title", F.lit(""))) != "") if titled else kept


# ---- files of records --------------------------------------------------------------------------


def base_name(column: Column) -> Column:
    return F.regexp_replace(tx.strip(F.coalesce(column, F.lit(""))), r"^.*[/\\]", "")


def resolve_files(records: DataFrame, files: DataFrame, names: Sequence[str], key: str = "pos") -> DataFrame:
    """The first existing file of each record: the ``names`` columns in order, then title plus extension.

    Returns ``key`` and the file's columns, NULL where no file exists.  Extensions are tried in
    alphabetical order.  A title joins on the file stem, one row per record, not one per extension.
    """
    by_name = records.select(
        key,
        F.posexplode_outer(F.array(*[base_name(F.col(n)) for n in names])).alias("priority", "__name"),
    ).where("__name <> ''")
    named = by_name.join(
        files.withColumnRenamed("file_name", "__file"), F.col("__name") == F.col("__file")
    ).select(key, F.col("priority").cast("bigint"), F.col("__file").alias("found_name"), *_payload(files))
    found = named
    if "title" in records.columns:
        title = tx.strip(F.coalesce("title", F.lit("")))
        stems = files.withColumn("__ext", F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1))).where(
            F.col("__ext").isin(tx.IMAGE_EXTENSIONS)
        )
        rank = F.array_position(F.array(*[F.lit(e) for e in sorted(tx.IMAGE_EXTENSIONS)]), F.col("__ext"))
        titled = (
            records.select(key, title.alias("__title")).where("__title <> ''")
            .join(stems.withColumn("__stem", F.regexp_replace("file_name", r"\.[^.]*$", "")), F.col("__title") == F.col("__stem"))
            .select(key, (rank + len(names)).alias("priority"), F.col("file_name").alias("found_name"), *_payload(files))
        )
        found = named.unionByName(titled)
    best = pick(found, [key], F.col("priority"), ["found_name", *_payload(files)])
    return records.select(key).join(best, key, "left")


def _payload(files: DataFrame) -> list[str]:
    return [c for c in files.columns if c != "file_name"]


def import_outcome() -> Column:
    """Outcome of a record next to its file: skipped, no_file, hash_mismatch or imported."""
    recorded = F.lower(tx.strip(F.coalesce("sha256", F.lit(""))))
    return (
        F.when(F.coalesce("status", F.lit("")) != "downloaded", "skipped")
        .when(F.col("found_name").isNull(), "no_file")
        .when((recorded != "") & (recorded != F.col("actual_sha256")), "hash_mismatch")
        .otherwise("imported")
    )


def classify_import(records: DataFrame, files: DataFrame, names: Sequence[str] = ("file_name",)) -> DataFrame:
    """Outcome of importing each record: skipped, no_file, hash_mismatch or imported."""
    wanted = downloaded(records)
    resolved = resolve_files(wanted, files.withColumnRenamed("sha256", "actual_sha256"), names).select(
        "pos", "found_name", "actual_sha256"
    )
    return records.join(resolved, "pos", "left").withColumn("outcome", import_outcome())


def import_run_stats(classified: DataFrame, orphan_files: DataFrame) -> DataFrame:
    """One row: totals, imported, skipped, errors, orphans and the run's status."""
    counts = classified.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("outcome") == "imported").alias("imported_count"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped_count"),
        F.count_if(F.col("outcome").isin("no_file", "hash_mismatch")).alias("error_count"),
    )
    orphan_count = orphan_files.agg(F.count("*")).scalar()
    return counts.withColumn("orphan_count", orphan_count).withColumn(
        "status", F.when(F.col("error_count") > 0, "completed_with_errors").otherwise("completed")
    )


def hash_mismatch(records: DataFrame, files: DataFrame) -> DataFrame:
    """Downloaded records whose stored hash differs from the file's."""
    return classify_import(records, files).where("outcome = 'hash_mismatch'")


def orphans(files: DataFrame, referenced: DataFrame) -> DataFrame:
    """Files whose hash and name are both unreferenced.

    ``NOT (hash = … OR name = …)`` would be a nested-loop join.  Both become keys of one kind of row, so that
    ``referenced`` (``found_name`` and ``actual_sha256``), the costly side, is computed once.
    """

    def marks(sha256: str, name: str) -> Column:
        kinds = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind, c in (("hash", sha256), ("name", name))]
        return F.explode(F.array(*kinds)).alias("__m")

    used = referenced.select(marks("actual_sha256", "found_name")).where("__m.key IS NOT NULL").distinct()
    hit = files.select("sha256", "file_name", marks("sha256", "file_name")).join(used, "__m", "left_semi")
    taken = hit.select(F.col("sha256").alias("__sha256"), F.col("file_name").alias("__name")).distinct()
    same = F.col("sha256").eqNullSafe(F.col("__sha256")) & F.col("file_name").eqNullSafe(F.col("__name"))
    return files.join(taken, same, "left_anti")


def orphans_by_name(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files named by no downloaded record, neither by a file name nor as title plus extension."""
    kept = downloaded(records)
    image = files.withColumn("__stem", F.regexp_replace("file_name", r"\.[^.]*$", "")).withColumn(
        "__known", F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1)).isin(tx.IMAGE_EXTENSIONS)
    ).where("__known")
    names = kept.select(base_name(F.col("file_name")).alias("file_name"))
    titles = kept.select(tx.strip(F.coalesce("title", F.lit(""))).alias("__stem")).where("__stem <> ''")
    return image.join(names, "file_name", "left_anti").join(titles, "__stem", "left_anti").drop("__stem", "__known")


def duplicate_hash_groups(files: DataFrame) -> DataFrame:
    """Files whose hash occurs more than once, numbered by name within the hash.

    One row per file, not one array per hash: a hash may have any number of files.  The number
    comes from blocks of neighbouring names, so one hash is not one task.
    """
    sizes = files.groupBy("sha256").agg(F.count("*").alias("copies")).where("copies > 1")
    again = files.select("sha256", "file_name").join(sizes, "sha256").withColumn("__lower", F.lower("file_name"))
    block = ordered.text_block(again, "__lower")
    return ordered.number_rows(again, ["sha256"], ["__lower", "file_name"], block, "nth").drop("__lower")


# ---- new against known --------------------------------------------------------------------------


def known_urls(incoming: DataFrame, existing: DataFrame, url: str = "page_url") -> DataFrame:
    """Adds ``known``: does an existing row have the same normalised address?"""
    addresses = existing.select(u.normalize_url(F.col(url)).alias("__address")).distinct().withColumn("__hit", F.lit(True))
    keyed = incoming.withColumn("__address", u.normalize_url(F.col(url)))
    joined = keyed.join(addresses, "__address", "left").withColumn("known", F.coalesce("__hit", F.lit(False)))
    return joined.select(*incoming.columns, "known")


def merge_state(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Entries of a stored browser state (cookies by name and place, items by origin): the newest of each key stays.

    A key's new entry replaces its old one; keys on one side only stay.  ``order`` tells the newest of a side.
    """
    payload = [c for c in old.columns if c not in (*keys, order)]
    sides = old.select(*keys, F.lit(0).alias("__side"), order, *payload).unionByName(new.select(*keys, F.lit(1).alias("__side"), order, *payload))
    return pick(sides, keys, F.struct("__side", order), payload, last=True)


def _keys(records: DataFrame, kinds: dict[str, Column], carried: Sequence[str] = ("pos",)) -> DataFrame:
    """One narrow row per record and kind of key.

    The keys are computed in a projection of their own: a generator shares no subexpressions.  Its array
    is never empty; the outer form keeps Spark from inferring a filter that would compute the keys again.
    """
    computed = records.select(*carried, *[value.alias(f"__{kind}") for kind, value in kinds.items()])
    pairs = [F.struct(F.lit(kind).alias("kind"), F.col(f"__{kind}").alias("key")) for kind in kinds]
    return (
        computed.select(*carried, F.explode_outer(F.array(*pairs)).alias("p"))
        .select(*carried, "p.kind", "p.key")
        .where(F.coalesce("key", F.lit("")) != "")
    )


def dedup_new(candidates: DataFrame, existing: DataFrame, files: DataFrame) -> DataFrame:
    """Accept or reject each candidate, as if they came one by one in ``pos`` order.

    Rules in order: address recorded, content recorded (or accepted earlier in the batch), content
    on disk, source recorded (or accepted earlier).  Adds ``reason``, NULL for accepted rows.

    All rules share one join on narrow ``(kind, key)`` rows.  Inside the batch the one-by-one
    result is a greedy matching of content and source keys: a candidate that is first for both its
    keys is accepted, those that share a key with it are out, and so on with the rest.  A hot key
    is settled in one round, whatever its size.
    """
    source = u.source_hash(F.col("page_url"), F.col("image_url"))
    # The narrow keys are read three times, so they are computed once.
    new_keys = cut(
        _keys(
            candidates,
            {"1_image_url": F.trim("image_url"), "2_content": tx.valid_sha256(F.col("sha256")),
             "3_file": tx.valid_sha256(F.col("sha256")), "4_source": source},
        )
    )
    known = downloaded(existing)
    known_keys = (
        _keys(
            known,
            {"1_image_url": F.trim("image_url"), "2_content": tx.valid_sha256(F.col("sha256")), "4_source": source},
        )
        .select("kind", "key")
        .unionByName(files.select(F.lit("3_file").alias("kind"), F.col("sha256").alias("key")))
    )
    known_keys = narrowed(known_keys, new_keys, ["kind", "key"]).distinct()
    by_rule = cut(new_keys.join(known_keys, ["kind", "key"], "left_semi").groupBy("pos").agg(F.min("kind").alias("rule")))
    wide = candidates.join(by_rule, "pos", "left")
    fresh = cut(
        wide.where("rule IS NULL").select(
            "pos",
            F.coalesce(F.nullif(tx.valid_sha256(F.col("sha256")), F.lit("")), F.concat(F.lit("p"), F.col("pos").cast("string"))).alias("content"),
            source.alias("source"),
        )
    )
    accepted = greedy_pairs(fresh, "content", "source")
    taken = [
        accepted.groupBy(side).agg(F.min("pos").alias(f"{side}_pos")).alias(side) for side in ("content", "source")
    ]
    late = (
        fresh.join(taken[0], "content", "left").join(taken[1], "source", "left")
        .select(
            "pos",
            F.when(F.col("content_pos") < F.col("pos"), "2_content")
            .when(F.col("source_pos") < F.col("pos"), "4_source")
            .alias("batch_rule"),
        )
    )
    return (
        wide.join(late, "pos", "left")
        .withColumn("reason", F.regexp_replace(F.coalesce("rule", "batch_rule"), r"^\d_", ""))
        .drop("rule", "batch_rule")
    )


def greedy_pairs(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Rows that win when each row, in ``pos`` order, claims its two keys if both are free.

    Each round is two pre-aggregated minima and two joins; the lineage is cut after it.
    """
    open_rows = rows.select("pos", left, right)
    won: DataFrame | None = None
    while True:
        first_left = open_rows.groupBy(left).agg(F.min("pos").alias("__l"))
        first_right = open_rows.groupBy(right).agg(F.min("pos").alias("__r"))
        marked = open_rows.join(first_left, left).join(first_right, right)
        winners = cut(marked.where("pos = __l AND pos = __r").select("pos", left, right))
        won = winners if won is None else won.unionByName(winners)
        open_rows = cut(
            open_rows.join(winners.select(left), left, "left_anti").join(winners.select(right), right, "left_anti")
        )
        if open_rows.isEmpty():
            return won


def upsert_by_key(
    target: DataFrame, source: DataFrame, key: str, order: str, keep: Sequence[str] = ("id", "imported_at")
) -> DataFrame:
    """Insert or update: the last source row per key wins, ``keep`` columns stay as they were."""
    columns = [c for c in target.columns if c != key]
    latest = pick(source, [key], F.col(order), columns, last=True)
    old = target.select(F.col(key).alias("__key"), F.struct(*columns).alias("__old"))
    both = latest.select(F.col(key), F.struct(*columns).alias("__new")).join(
        old, F.col(key) == F.col("__key"), "full_outer"
    )
    merged = [
        F.coalesce(F.col("__old")[c], F.col("__new")[c]).alias(c)
        if c in keep
        else F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col("__old")[c]).alias(c)
        for c in columns
    ]
    return both.select(F.coalesce(key, "__key").alias(key), *merged)


def drop_found_orphans(orphan_table: DataFrame, imported: DataFrame) -> DataFrame:
    """Orphans whose hash a record now refers to are no orphans any more."""
    return orphan_table.join(imported.select("sha256"), "sha256", "left_anti")


def backfill(records: DataFrame, recovered: DataFrame) -> DataFrame:
    """Fill empty addresses of recovered records from the log, by sequence; name the filled fields."""
    log = recovered.select(
        "sequence", F.col("page_url").alias("__page"), F.col("image_url").alias("__image")
    )
    joined = records.join(log, "sequence", "left")
    out = joined
    changed = []
    for field, found in (("page_url", "__page"), ("image_url", "__image")):
        empty = tx.strip(F.coalesce(field, F.lit(""))) == ""
        fill = empty & (F.coalesce(found, F.lit("")) != "")
        changed.append(F.when(fill, F.lit(field)))
        out = out.withColumn(f"__new_{field}", F.when(fill, F.col(found)).otherwise(F.col(field)))
    out = out.withColumn("updated_fields", F.array_compact(F.array(*changed)))
    return out.withColumn("page_url", F.col("__new_page_url")).withColumn("image_url", F.col("__new_image_url")).drop(
        "__page", "__image", "__new_page_url", "__new_image_url"
    )


def update_by_sequence(records: DataFrame, renames: DataFrame) -> DataFrame:
    """Apply the last rename of each sequence; the first name is remembered once."""
    last = pick(renames, ["sequence"], F.col("order"), ["new_name"], last=True)
    return (
        records.join(last, "sequence", "left")
        .withColumn(
            "original_file_name",
            F.when(F.col("new_name").isNotNull(), F.coalesce("original_file_name", "file_name")).otherwise(
                F.col("original_file_name")
            ),
        )
        .withColumn("file_name", F.coalesce("new_name", "file_name"))
        .drop("new_name")
    )


def append_recovered(existing: DataFrame, recovered: DataFrame) -> DataFrame:
    """Existing records and the recovered ones whose hash and file name no downloaded record has."""
    known = downloaded(existing)
    fresh = recovered.join(known.select("sha256"), "sha256", "left_anti").join(
        known.select("file_name"), "file_name", "left_anti"
    )
    return existing.unionByName(fresh, allowMissingColumns=True)


# ---- counts and sequences ------------------------------------------------------------------------


def record_index(records: DataFrame) -> DataFrame:
    """Last downloaded record per image address, content hash and source hash."""
    kinds = {
        "image_url": F.trim("image_url"),
        "content": tx.valid_sha256(F.col("sha256")),
        "source": u.source_hash(F.col("page_url"), F.col("image_url")),
    }
    exploded = _keys(downloaded(records), kinds, ["pos", "sequence"])
    return exploded.groupBy("kind", "key").agg(
        F.max_by("sequence", "pos").alias("sequence"), F.count("*").alias("records")
    )


def next_sequence(records: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """Largest sequence of downloaded records and of files named ``prefix_number…``, plus one."""
    from_records = downloaded(records).agg(F.max(F.col("sequence").try_cast("bigint"))).scalar()
    number = F.regexp_extract(tx.stem_of(F.col("file_name")), rf"(?i)^\Q{prefix}\E_(\d+)(?:[_-].*)?$", 1)
    return files.agg(F.max(F.nullif(number, F.lit("")).try_cast("bigint")).alias("m")).select(
        (F.greatest(F.coalesce("m", F.lit(0)), F.coalesce(from_records, F.lit(0))) + 1).alias("next_sequence")
    )


def used_sequences(records: DataFrame, column: str = "sequence", highest: int | None = None) -> DataFrame:
    """Distinct numbers in use."""
    used = records.select(F.col(column).try_cast("bigint").alias(column)).where(F.col(column) >= 1)
    return (used if highest is None else used.where(F.col(column) <= highest)).distinct()


def missing_numbers(used: DataFrame, column: str, last: Column | int) -> DataFrame:
    """Integers of 1..last that are absent, built from the gaps between neighbours.

    ``last`` is a number; ranges are exploded in the executors, one range per gap.
    """
    bound = F.lit(last) if isinstance(last, int) else last
    inside = used.where((F.col(column) >= 1) & (F.col(column) <= bound)).select(F.col(column).alias("n")).distinct()
    ends = used.sparkSession.range(1).select((bound + 1).cast("bigint").alias("n"))
    lagged = ordered.previous(
        inside.unionByName(ends), [], ["n"], ordered.position_block("n"), {"before": F.col("n")}
    )
    first, end = F.coalesce("before", F.lit(0)) + 1, F.col("n") - 1
    # A wide gap is cut into slices, so no row builds an unbounded array.
    size = 1 << 16
    slices = lagged.where(end >= first).select(first.alias("a"), end.alias("b")).select(
        F.col("b"), F.explode(F.sequence("a", "b", F.lit(size).cast("bigint"))).alias("a")
    )
    return slices.select(F.explode(F.sequence("a", F.least("b", F.col("a") + size - 1))).alias(column))


def nth_free(rows: DataFrame, used: DataFrame, start: int, row: str, keys: Sequence[str] = (), out: str = "sequence") -> DataFrame:
    """For rows with ``at``: the ``at``-th integer from ``start`` that is not in use (per ``keys``), as ``row`` and ``out``.

    It lies in the gap whose running count of free integers reaches ``at``.  Gaps and rows are merged by that count and each row takes the
    gap that was last seen before it.
    """
    keys = list(keys)
    taken = used.where(F.col(out) >= start).select(*keys, F.col(out).alias("n")).distinct()
    numbered = ordered.number_rows(taken, keys, ["n"], ordered.position_block("n"), "nth")
    # Free integers before a taken one: its offset from the start minus the taken ones before it.
    gaps = (
        numbered.select(*keys, (F.col("n") - start - (F.col("nth") - 1)).alias("at"), "nth")
        .groupBy(*keys, "at").agg(F.max("nth").alias("skipped"))
    )
    narrow = rows.select(*keys, "at", F.lit(None).cast("bigint").alias("skipped"), F.col(row).alias("__row"))
    merged = gaps.select(*keys, "at", "skipped", F.lit(None).cast("bigint").alias("__row")).unionByName(narrow)
    # A gap that opens after ``at`` free integers serves rows at + 1 and later, so rows sort before it.
    placed = ordered.scan(
        merged.withColumn("__side", F.col("__row").isNull().cast("int")),
        keys, ["at", "__side"], ordered.position_block("at"),
        [ordered.Scan("__skip", "max", F.col("skipped"))],
    ).where("__row IS NOT NULL")
    return placed.select(*keys, F.col("__row").alias(row), (F.lit(start - 1) + F.col("at") + F.coalesce("__skip", F.lit(0))).alias(out))


def assign_sequences(
    new_rows: DataFrame, used: DataFrame, start: int, order: str = "pos", keys: Sequence[str] = (), out: str = "sequence"
) -> DataFrame:
    """Give new rows, in order, the next integers from ``start`` that are not in use (per ``keys``)."""
    keys = list(keys)
    rows = ordered.number_rows(new_rows, keys, [order], ordered.position_block(order), "at")
    numbers = nth_free(rows, used, start, order, keys, out)
    return rows.drop("at", out).join(numbers, [*keys, order])


def recover_sequences(files: DataFrame, used: DataFrame, order: str = "pos", own: str = "own", out: str = "sequence") -> DataFrame:
    """Number recovered files: a file keeps its own number if nobody has it, others go on behind the largest number so far.

    Own numbers that are free are reserved first, each for the first file (by ``order``) that bears it.  Then the others, in order, take
    the next integer that is larger than every number so far, stored or kept before them, and not reserved.  Counted in free integers
    that is a running maximum: the j-th of them gets at least one more than the one before, and more than lie below the largest number.
    """
    taken = used.select(F.col(out).cast("bigint").alias(out)).where(F.col(out) >= 1).distinct()
    free = files.where(F.col(own) >= 1).select(F.col(own).cast("bigint").alias(out), order).join(taken, out, "left_anti")
    # The file list is read again below, so the few columns that decide are cut off here.
    kept = cut(free.groupBy(out).agg(F.min(order).alias(order)))
    reserved = cut(taken.unionByName(kept.select(out)))
    highest = taken.agg(F.coalesce(F.max(out), F.lit(0))).scalar()
    marked = files.select(order).join(kept.withColumnRenamed(out, "__kept"), order, "left").withColumn("__stored", highest)
    # In the order of the files: the largest number so far, and how many had to move on.
    seen = ordered.scan(
        marked, [], [order], ordered.position_block(order),
        [ordered.Scan("__before", "max", F.col("__kept"), before=True), ordered.Scan("__i", "sum", F.col("__kept").isNull().cast("bigint"))],
    )
    movers = seen.where("__kept IS NULL").select(order, "__i", F.greatest("__stored", F.coalesce("__before", F.lit(0))).alias("__top"))
    below = ordered.number_rows(reserved, [], [out], ordered.position_block(out), "__nth").select(F.col(out).alias("__top"), (F.col(out) - F.col("__nth")).alias("__free"))
    ranked = movers.join(below, "__top", "left").withColumn("__lead", F.coalesce("__free", F.lit(0)) - F.col("__i"))
    ahead = ordered.scan(ranked, [], [order], ordered.position_block(order), [ordered.Scan("__most", "max", F.col("__lead"))])
    rows = ahead.select(order, (F.col("__most") + F.col("__i") + 1).alias("at"))
    numbers = nth_free(rows, reserved, 1, order, (), out).unionByName(kept.select(order, out))
    return files.drop(out).join(numbers, order)


def rank_records(records: DataFrame) -> DataFrame:
    """Records with their place in the order (sequence, file name)."""
    names = ["__last", "__seq", "__name"]
    keyed = records.withColumns(dict(zip(names, record_order(), strict=True)))
    # Only "no sequence" can hold many rows; those are cut further by name.
    among_last = F.when(F.col("__last"), ordered.text_block(keyed, "__name")).otherwise(F.lit(0))
    block = F.struct("__last", ordered.position_block("__seq").alias("s"), among_last.cast("bigint").alias("t"))
    return ordered.number_rows(keyed, [], names, block, "nth").drop(*names)


def catalog_stats(images: DataFrame, orphan_files: DataFrame) -> DataFrame:
    """Long form: images by status and by site, bytes downloaded, orphans."""
    site = u.host(F.col("page_url"))
    one_pass = images.groupBy("status", site.alias("site")).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("status") == "downloaded", F.col("file_size"))).alias("bytes"),
    )
    by_status = one_pass.groupBy(F.lit("status").alias("kind"), F.col("status").alias("key")).agg(F.sum("n").alias("n"))
    by_site = one_pass.groupBy(F.lit("site").alias("kind"), F.col("site").alias("key")).agg(F.sum("n").alias("n"))
    size = one_pass.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).select(
        F.lit("total").alias("kind"), F.lit("downloaded_bytes").alias("key"), "n"
    )
    stray = orphan_files.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("orphans").alias("key"), "n")
    return by_status.unionByName(by_site).unionByName(size).unionByName(stray)


def validate_completeness(records: DataFrame, files: DataFrame, target: int, min_bytes: int = 10 * 1024) -> DataFrame:
    """One row: counts, problems and whether ``target`` is reached; sequence gaps only warn."""
    kept = downloaded(records)
    image = files.where(F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1)).isin(tx.IMAGE_EXTENSIONS))
    n = kept.agg(F.count("*").alias("downloaded_records"))
    file_counts = image.agg(
        F.count("*").alias("image_files"), F.count_if(bad_image(min_bytes)).alias("bad_files")
    )
    groups = image.groupBy("sha256").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("g"))
    inside = used_sequences(kept).where(F.col("sequence") <= target).agg(F.count("*").alias("c"))
    stray = orphans_by_name(files, records).agg(F.count("*").alias("c"))
    out = n.select(
        "downloaded_records",
        file_counts.select("image_files").scalar().alias("image_files"),
        file_counts.select("bad_files").scalar().alias("bad_files"),
        groups.scalar().alias("duplicate_groups"),
        (F.lit(target) - inside.scalar()).alias("missing_sequences"),
        stray.scalar().alias("orphan_files"),
    )
    return out.withColumn("remaining_records", F.greatest(F.lit(0), F.lit(target) - F.col("downloaded_records"))).withColumn(
        "complete",
        (F.col("downloaded_records") >= target)
        & (F.col("image_files") >= target)
        & (F.col("bad_files") == 0)
        & (F.col("duplicate_groups") == 0),
    )


def bad_image(min_bytes: int = 10 * 1024, min_side: int = 200) -> Column:
    """Too small to be a picture: in bytes, or in width or height."""
    return (F.col("file_size") < min_bytes) | (F.col("width") < min_side) | (F.col("height") < min_side)


def image_quality(files: DataFrame, min_bytes: int = 10 * 1024, min_side: int = 200) -> DataFrame:
    """Files that pass; with ``lo``/``hi`` arrays of the colour channels, nearly blank ones are out too."""
    kept = files.where(~bad_image(min_bytes, min_side))
    if "channel_range" in files.columns:
        kept = kept.where(F.exists("channel_range", lambda r: r >= 8))
    return kept


# ---- look-ups ------------------------------------------------------------------------------------

# Columns a search may look into and sort by.
SEARCHED = ["title", "collection_title", "page_url", "summary", "metadata_text"]
SORTABLE = ["sequence", "title", "collection_title", "file_name", "file_size", "source_site", "status", "imported_at", "recorded_at"]


def search_catalog(
    images: DataFrame, q: str = "", status: str = "", sort: str = "sequence", descending: bool = False,
    page: int = 1, page_size: int = 50, key: str = "id",
) -> DataFrame:
    """One page of matches, with the total.  ``%`` and ``_`` in ``q`` stay wildcards; ``key`` breaks ties."""
    hits = images
    if q:
        any_field = F.lit(False)
        for field in [c for c in SEARCHED if c in images.columns]:
            any_field = any_field | F.coalesce(F.col(field).ilike(f"%{q}%"), F.lit(False))
        hits = hits.where(any_field)
    if status:
        hits = hits.where(F.col("status") == status)
    column = F.col(sort if sort in SORTABLE and sort in images.columns else "sequence")
    size = min(500, max(1, page_size))
    total = hits.agg(F.count("*")).scalar()
    ordering = column.desc_nulls_last() if descending else column.asc_nulls_first()
    rows = hits.orderBy(ordering, F.col(key)).offset((max(1, page) - 1) * size).limit(size)
    return rows.withColumn("total", total)


def get_by_id(images: DataFrame, image_id: str) -> DataFrame:
    return images.where(F.col("id") == image_id)


def record_order() -> list[Column]:
    """Sequence, missing and unparsable ones last, then file name."""
    sequence = F.col("sequence").try_cast("bigint")
    return [sequence.isNull(), F.coalesce(sequence, F.lit(0)), F.coalesce("file_name", F.lit(""))]


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id")).limit(n)


def capped_list(rows: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows per key with the total and whether there are more.

    Spark applies the rank limit before the shuffle, so a hot key sends at most ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    top = rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
    return top.join(totals, list(keys)).withColumn("has_more", F.col("total") > n)
