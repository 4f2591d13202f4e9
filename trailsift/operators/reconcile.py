"""One-to-one assignment of files to records, in record order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailsift.functions import text as tx
from trailsift.functions import urls as u
from trailsift.session import cut

GRAM = 8
NEVER = (1 << 63) - 1  # later than any turn


def assign_files_once(records: DataFrame, files: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each record, in ``pos`` order, takes its first candidate that is unused at its turn.

    Candidates are the ``names`` columns in order; failing those, the only unused file of the record's
    ``file_size``.  Adds ``assigned`` (NULL without a file).  Rows of one ``pos`` are one turn.  A size that lists
    a file twice gives none away.

    First the names alone are settled; with the size rule a file can only go earlier than that, never later.
    A size gives away at most one file by the rule, its last one, between the turns that take its last two files
    by name.  Such a gift may take a file from the record that was to have it, which then goes on to its other
    names or its own size.  Those moves are worked out again, with the sizes they touch, until nothing moves.
    That state is the only one: each round is right for one more turn, and wrong guesses settle side by side.
    """
    listed = F.transform(F.array(*names), lambda n: F.regexp_replace(F.coalesce(n, F.lit("")), r"^.*/", ""))
    known = records.where("pos IS NOT NULL")
    size = F.when(F.col("file_size") > 0, F.col("file_size"))
    turns = cut(known.select("pos", size.alias("file_size")).distinct())
    wanted = known.select("pos", F.posexplode(F.array_distinct(listed)).alias("p", "file_name")).where("file_name <> ''")
    pairs = cut(wanted.join(files.select("file_name").distinct(), "file_name").select("pos", "p", "file_name"))
    taken = _first_come(pairs)
    owners = cut(taken.join(turns, "pos").select("pos", "p", "file_name", F.col("file_size").alias("own_size")))
    owned = owners.select("file_name", F.col("pos").alias("owner"), F.col("own_size").alias("owner_size"))
    never = F.lit(NEVER).cast("bigint")
    listings = files.where("file_size > 0").groupBy("file_size", "file_name").agg(F.count("*").alias("__n"))
    unclear = listings.where("__n > 1").select("file_size")
    lots = cut(
        listings.join(owned, "file_name", "left").join(unclear, "file_size", "left_anti")
        .select("file_size", "file_name", F.coalesce("owner", never).alias("owner"), "owner_size")
    )
    idle = cut(turns.where("file_size IS NOT NULL").join(owners, "pos", "left_anti"))
    # The other names a record could still get, once it has lost its file.
    spare = pairs.join(owners.select("pos", F.col("p").alias("__p")).distinct(), "pos").where("p > __p").drop("__p")
    spare = spare.join(owned, "file_name", "left").where("owner IS NULL OR pos < owner")
    homes = lots.join(spare.select("file_name"), "file_name", "left_semi").groupBy("file_name").agg(F.collect_set("file_size").alias("homes"))
    spare = cut(spare.join(homes, "file_name", "left"))

    base = cut(_last_of_sizes(lots.withColumn("named_at", F.col("owner")), idle))
    move = ["pos", "own_size", "file_name"]
    gifts, moves, count = base, None, 0
    while True:
        gone = gifts.select("file_name", "pos")
        losers = gifts.where(F.col("owner") < never).select(
            F.col("owner").alias("pos"), F.col("owner_size").alias("own_size"), F.col("file_size").alias("by_size")
        )
        if moves is not None:
            moved = moves.where("file_name IS NOT NULL")
            gone = gone.unionByName(moved.select("file_name", "pos"))
            losers = losers.unionByName(
                moved.where("owner IS NOT NULL").select(
                    F.col("owner").alias("pos"), F.col("owner_size").alias("own_size"), F.lit(None).cast("bigint").alias("by_size")
                )
            )
        gone = gone.groupBy("file_name").agg(F.min("pos").alias("__gone"))
        choices = (
            spare.join(losers.select("pos"), "pos", "left_semi").join(gone, "file_name", "left")
            .where("__gone IS NULL OR __gone >= pos").groupBy("pos")
            .agg(F.min(F.struct("p", "file_name", "owner", "owner_size", "homes")).alias("__to"))
        )
        # Who lost the last file of their own size finds no other there.
        now = cut(
            losers.join(choices, "pos", "left").where("__to IS NOT NULL OR own_size <> coalesce(by_size, -1)")
            .select("pos", "own_size", *[F.col("__to")[c].alias(c) for c in ("file_name", "owner", "owner_size", "homes")]).distinct()
        )
        was, count = count, now.count()
        if count == was and (count == 0 or now.select(*move).subtract(moves.select(*move)).isEmpty()):
            break
        moves = now
        claims = moves.where("file_name IS NOT NULL").groupBy("file_name").agg(F.min("pos").alias("__claim"))
        late = moves.where("file_name IS NULL").select(F.col("own_size").alias("file_size"), "pos")
        touched = cut(
            late.select("file_size").unionByName(moves.select(F.explode("homes").alias("file_size"))).distinct()
        )
        again = _last_of_sizes(
            lots.join(touched, "file_size", "left_semi").join(claims, "file_name", "left")
            .withColumn("named_at", F.least("owner", "__claim")).drop("__claim"),
            idle.join(touched, "file_size", "left_semi").select("file_size", "pos").unionByName(late),
        )
        gifts = cut(base.join(touched, "file_size", "left_anti").unionByName(again))
    won = owners.select("pos", "file_name").distinct().join(losers.select("pos"), "pos", "left_anti").unionByName(gifts.select("pos", "file_name"))
    if moves is not None:
        won = won.unionByName(moves.where("file_name IS NOT NULL").select("pos", "file_name").distinct())
    return records.join(won.select("pos", F.col("file_name").alias("assigned")), "pos", "left")


def _first_come(pairs: DataFrame) -> DataFrame:
    """(pos, p, file_name) when each record, in ``pos`` order, takes its first unused name.

    Rounds, each settling all records that are the first namer of their best file.
    """
    won = pairs.limit(0)
    while not pairs.isEmpty():
        first = pairs.groupBy("file_name").agg(F.min("pos").alias("pos"))
        best = pairs.groupBy("pos").agg(F.min(F.struct("p", "file_name")).alias("__best")).select("pos", "__best.p", "__best.file_name")
        heads = cut(best.join(first, ["pos", "file_name"]).select("pos", "p", "file_name"))
        won = won.unionByName(heads)
        pairs = cut(pairs.join(heads.select("pos"), "pos", "left_anti").join(heads.select("file_name"), "file_name", "left_anti"))
    return won


def _last_of_sizes(lots: DataFrame, idle: DataFrame) -> DataFrame:
    """For each size the first record without a name to take that finds one file left there, and that file.

    ``lots`` has the turn at which each file is ``named_at``.  One file is left after the last turn but one of the
    size's files, until the last.
    """
    late_first = Window.partitionBy("file_size").orderBy(F.desc("named_at"))
    ends = (
        lots.withColumn("__n", F.row_number().over(late_first)).where("__n <= 2").groupBy("file_size").agg(
            F.max_by(F.struct("file_name", "owner", "owner_size"), "named_at").alias("__last"), F.max("named_at").alias("__until"),
            F.when(F.count("*") > 1, F.min("named_at")).alias("__after"),
        ).where("__after IS NULL OR __after < __until")
    )
    return (
        idle.join(ends, "file_size").where("pos <= __until AND (__after IS NULL OR pos > __after)")
        .groupBy("file_size").agg(F.min("pos").alias("pos"), F.any_value("__last").alias("__last"))
        .select("file_size", "pos", "__last.file_name", "__last.owner", "__last.owner_size")
    )


def contains_pairs(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """(needle, text) pairs where the text contains the needle, without comparing all pairs.

    Each needle is looked up by its rarest run of eight characters (all of it when it is shorter)
    among the runs of the texts; only those pairs are verified.
    """
    lengths = [
        r[0] for r in needles.where(F.length(needle) > 0).select(F.least(F.length(needle), F.lit(GRAM)).alias("n")).distinct().collect()
    ]  # at most eight numbers
    if not lengths:
        return needles.select(needle).limit(0).join(texts.select(text).limit(0))

    def runs(column: str, n: int):
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(column) - n + 1, F.lit(1))), lambda i: F.substr(F.col(column), i, F.lit(n))
        )

    grams = F.array_distinct(F.concat(*[F.when(F.length(text) >= n, runs(text, n)).otherwise(F.array().cast("array<string>")) for n in lengths]))
    index = texts.select(text, F.explode(grams).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = needles.select(needle).distinct().where(F.length(needle) > 0).withColumn(
        "gram", F.explode(F.array_distinct(F.when(F.length(needle) >= GRAM, runs(needle, GRAM)).otherwise(F.array(needle))))
    )
    # A gram that no text has rules the needle out, which the left join keeps visible as 0.
    rarest = own.join(counts, "gram", "left").groupBy(needle).agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    return rarest.join(index, "gram").where(F.contains(F.col(text), F.col(needle))).select(needle, text)


def reconcile_late(records: DataFrame, files: DataFrame, item_base: str) -> DataFrame:
    """Files that landed after their download was recorded as failed.

    A failed record without a success for the same page and address takes the file whose stem contains
    the address's stem, if it is the only unused one; records take turns in ``pos`` order.
    """
    page = u.canonical_item_url(F.coalesce("page_url", F.lit("")), item_base)
    keyed = records.withColumn("__page", page).withColumn("__url", F.coalesce("url", F.lit("")))
    done = keyed.where("status = 'downloaded'").select("__page", "__url")
    stem = F.lower(tx.stem_of(u.path(F.col("__url"))))
    failed = keyed.where("status = 'failed'").join(done, ["__page", "__url"], "left_anti").select("pos", stem.alias("stem")).where("stem <> ''")
    used = records.where("status = 'downloaded' AND file_name IS NOT NULL").select("file_name")
    free = files.where("file_size > 0").join(used, "file_name", "left_anti").withColumn("file_stem", F.lower(tx.stem_of(F.col("file_name"))))
    stems = contains_pairs(failed.select("stem"), free.select("file_stem").distinct(), "stem", "file_stem")
    open_files = cut(stems.join(free.select("file_name", "file_stem"), "file_stem").select("stem", "file_name"))
    turns = cut(failed.join(open_files.select("stem").distinct(), "stem", "left_semi"))
    won: DataFrame | None = None
    while not turns.isEmpty():
        head = turns.groupBy("stem").agg(F.min("pos").alias("pos"))
        rivals = open_files.join(head, "stem")
        # A stem may go ahead while its head is before the heads of all stems it shares a file with.
        least = rivals.groupBy("file_name").agg(F.min("pos").alias("least"))
        limits = rivals.join(least, "file_name").groupBy("stem", "pos").agg(F.min("least").alias("least"), F.count("*").alias("n"))
        ready = limits.where("pos = least").select("stem", "pos", "n")
        single = ready.where("n = 1").select("stem", "pos")
        taken = cut(single.join(open_files, "stem").select("pos", "stem", "file_name"))
        won = taken if won is None else won.unionByName(taken)
        # All turns of a ready stem before its nearest rival's head come out the same.
        second = rivals.join(least, "file_name").groupBy("file_name").agg(
            F.min(F.when(F.col("pos") > F.col("least"), F.col("pos"))).alias("second")
        )
        others = rivals.join(second, "file_name").groupBy("stem").agg(F.min("second").alias("until"))
        settled = ready.select("stem").join(others, "stem", "left")
        still = turns.join(settled.withColumn("__ready", F.lit(True)), "stem", "left").where(
            F.col("__ready").isNull() | (F.col("until").isNotNull() & (F.col("pos") > F.col("until")))
        ).select("pos", "stem")
        open_files = cut(open_files.join(taken.select("file_name"), "file_name", "left_anti"))
        turns = cut(still.join(open_files.select("stem").distinct(), "stem", "left_semi"))
    empty = failed.limit(0).select("pos", F.lit("").alias("file_name"))
    return (empty if won is None else won.select("pos", "file_name"))
