"""Streaming operators with state of their own per key, dropped by timers of the event time.

State lives in the state store of the query (RocksDB), not in Python: a key that holds a third of a batch's rows is read piece by piece,
and what it keeps is bounded by its state, not by its rows.  A batch asks only for the state of the buckets its keys lie in.
"""

from __future__ import annotations

import pickle
from collections import Counter, deque
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailsift.functions import text as tx
from trailsift.functions import trace as tr
from trailsift.operators import catalog as ca


def _given(value: Any) -> Any:
    """NULL comes out of Arrow as NaN or NaT."""
    return None if pd.isna(value) else value


def _milliseconds(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


# Buckets of keys whose state is kept together.  A call to the state store costs more than the work on a row, so many keys share each.
BUCKETS = 256
# Waiting actions cost calls for each bucket and slice of time, so there are fewer.
RUN_BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


class _Timed:
    """The value of a bucket and its one timer."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value binary, timer bigint")
        self.timer: int | None = None

    def get(self, empty: Any) -> Any:
        found = self.held.get()
        self.timer = None if found is None else found[1]
        return empty if found is None else pickle.loads(found[0])

    def put(self, value: Any, timer: int | None) -> None:
        """Keep ``value`` until ``timer``; follows ``get``.  Without a timer nothing is kept."""
        if self.timer is not None and self.timer != timer:
            self.handle.deleteTimer(self.timer)
        if timer is None:
            self.held.clear()
            return
        if self.timer != timer:
            self.handle.registerTimer(timer)
        self.held.update((pickle.dumps(value), timer))

    def passed(self, timerValues: Any, expiredTimerInfo: Any) -> int:
        """Times before this have passed: the watermark, as timers go off below it."""
        return max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)


# ---- requests ------------------------------------------------------------------------------------------

ENTRY = (
    "request_id string, url string, frame_id string, type string, ts_request double, ts_response double, ts_finished double, "
    "content_length bigint, encoded_length bigint, received bigint, failed boolean"
)


class Requests(StatefulProcessor):
    """One entry per https request, out a while after it ended, or when it has had its time.

    The later event of a kind wins by ``pos``; events before the request do not count.  Sizes of data that came before its request
    wait under their position, because an even earlier request may still claim them.

    Requests are kept by buckets of their ids: a bucket's open requests are one value with one timer, the earliest of theirs.  A state
    and a timer for each request would cost several calls to the state store for each.
    """

    FACTS = [
        "since", "sent_pos", "url", "frame_id", "type", "sent", "answered_pos", "answered", "content", "finished_pos", "finished", "encoded", "failed_pos",
        "failed", "received", "early", "due",
    ]

    def __init__(self, timeout: str, grace: str) -> None:
        self.timeout, self.grace = _milliseconds(timeout), _milliseconds(grace)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timed = _Timed(handle)

    def _later(self, facts: dict, kind: str, pos: int, values: dict) -> None:
        if facts[f"{kind}_pos"] is None or pos > facts[f"{kind}_pos"]:
            facts.update(values)
            facts[f"{kind}_pos"] = pos

    def _take(self, facts: dict, event: str, pos: int, at: float, size: int | None, url: str | None, frame: str | None, kind: str | None) -> None:
        if event == "requestWillBeSent" and (url or "").lower().startswith("https://"):
            self._later(facts, "sent", pos, {"url": url, "frame_id": frame, "type": kind, "sent": at})
            if facts["since"] is None or pos < facts["since"]:
                facts["since"] = pos
                for held in [held for held in facts["early"] or () if held > pos]:
                    facts["received"] += facts["early"].pop(held)
        elif event == "responseReceived":
            self._later(facts, "answered", pos, {"answered": at, "content": size})
        elif event == "loadingFinished":
            self._later(facts, "finished", pos, {"finished": at, "encoded": size})
        elif event == "loadingFailed":
            self._later(facts, "failed", pos, {"failed": at})
        elif event == "dataReceived":
            if facts["since"] is not None and pos > facts["since"]:
                facts["received"] += size or 0
            else:
                if facts["early"] is None:
                    facts["early"] = {}
                facts["early"][pos] = size or 0

    def _after(self, facts: dict, kind: str) -> bool:
        return facts["since"] is not None and facts[f"{kind}_pos"] is not None and facts[f"{kind}_pos"] > facts["since"]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        open_, first = self.timed.get({}), {}
        for piece in rows:
            sizes = [size if given else None for size, given in zip(piece["size"].tolist(), piece["sized"].tolist(), strict=True)]
            columns = [piece[c].tolist() for c in ("request_id", "event", "pos", "at", "url", "frame_id", "type")]
            for (rid, event, pos, at, url, frame, kind), size in zip(zip(*columns, strict=True), sizes, strict=True):
                if rid not in open_:
                    open_[rid] = dict.fromkeys(self.FACTS) | {"received": 0}
                self._take(open_[rid], event, pos, at, size, url, frame, kind)
                if rid not in first or at < first[rid]:
                    first[rid] = at
        for rid, began in first.items():
            facts = open_[rid]
            ends = [facts[kind] for kind in ("finished", "failed") if self._after(facts, kind)]
            if ends:
                facts["due"] = int(max(ends) * 1000) + self.grace
            else:
                facts["due"] = int((began if facts["sent"] is None else facts["sent"]) * 1000) + self.timeout
        self.timed.put(open_, min((facts["due"] for facts in open_.values()), default=None))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = self.timed.passed(timerValues, expiredTimerInfo)
        open_, out = self.timed.get({}), []
        for rid in [rid for rid, facts in open_.items() if facts["due"] < passed]:
            facts = open_.pop(rid)
            if facts["since"] is not None:
                answered, finished = self._after(facts, "answered"), self._after(facts, "finished")
                out.append((
                    rid, facts["url"], facts["frame_id"], facts["type"], facts["sent"], facts["answered"] if answered else None, facts["finished"] if finished else None,
                    facts["content"] if answered else None, facts["encoded"] if finished else None, facts["received"], self._after(facts, "failed"),
                ))
        self.timed.put(open_, min((facts["due"] for facts in open_.values()), default=None))
        if out:
            yield pd.DataFrame(out, columns=[part.strip().split(" ")[0] for part in ENTRY.split(",")], dtype=object)

    def close(self) -> None:
        pass


def har_stream(events: DataFrame, timeout: str = "30 minutes", grace: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """One entry per https request: ``grace`` after it finished or failed, or ``timeout`` after it was sent.

    However long a request is silent in between, it comes out once and whole.  Events that come after that do not count.
    """
    at = F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint"))
    timed = events.where("request_id IS NOT NULL AND at IS NOT NULL AND pos IS NOT NULL").withColumn("time", at).withWatermark("time", delay)
    asked = timed.select(
        _bucket("request_id", BUCKETS), "request_id", "time", "pos", "event", "url", "frame_id", "type", "at", F.coalesce("size", F.lit(0)).alias("size"), F.col("size").isNotNull().alias("sized")
    )
    return asked.groupBy("bucket").transformWithStateInPandas(Requests(timeout, grace), ENTRY, "append", "eventTime")


# ---- loops ---------------------------------------------------------------------------------------------

STEPS_TOGETHER = 200_000


class Loops(StatefulProcessor):
    """Repetition among the last actions and stagnation of the page, in the order of time and position.

    Actions wait in slices of time until the watermark has passed their slice; a timer then takes the slices' actions in order.  A run
    keeps ``window`` hashes and the last fingerprint; it is forgotten after ``keep`` without actions.

    Runs are kept by buckets: a slice holds the waiting actions of all runs of its bucket, and the bucket has one timer.
    """

    def __init__(self, window: int, span: str, keep: str) -> None:
        self.window, self.span, self.keep = window, _milliseconds(span), _milliseconds(keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timed = _Timed(handle)
        self.waiting = handle.getMapState("waiting", "slice bigint", "steps binary")

    def _wait(self, slices: set[int], steps: dict[int, list[tuple]]) -> None:
        for end, added in steps.items():
            if end in slices:
                added = pickle.loads(self.waiting.getValue((end,))[0]) + added
            slices.add(end)
            self.waiting.updateValue((end,), (pickle.dumps(added),))
        steps.clear()

    def _put(self, slices: set[int], runs: dict) -> None:
        times = [*([min(slices)] if slices else ()), *(until for _, _, _, until in runs.values())]
        self.timed.put((slices, runs), min(times, default=None))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        slices, runs = self.timed.get((set(), {}))
        steps: dict[int, list[tuple]] = {}
        taken = 0
        for piece in rows:
            for end, *step in zip(*(piece[c].tolist() for c in ("end", "run", "pos", "exempt", "hash", "fingerprint")), strict=True):
                steps.setdefault(int(end), []).append(tuple(step))
            taken += len(piece)
            if taken >= STEPS_TOGETHER:
                self._wait(slices, steps)
                taken = 0
        self._wait(slices, steps)
        self._put(slices, runs)
        return iter(())

    def _follow(self, runs: dict, end: int, steps: list[tuple]) -> Iterator[tuple]:
        for run, of_run in groupby(sorted(steps, key=lambda s: (s[0] or "", s[1], s[2], s[3] or "", s[4] or "")), key=itemgetter(0)):
            held, fingerprint, stagnant, until = runs.get(run, ((), None, 0, end))
            if until < end:  # forgotten
                held, fingerprint, stagnant = (), None, 0
            recent, counts = deque(held), Counter(held)
            for _, pos, exempt, digest, seen in of_run:
                stagnant = stagnant + 1 if seen == fingerprint else 0
                fingerprint = seen
                if not exempt:
                    recent.append(digest)
                    counts[digest] += 1
                    if len(recent) > self.window:
                        gone = recent.popleft()
                        counts[gone] -= 1
                        if not counts[gone]:
                            del counts[gone]
                yield None if run is None else int(run), pos, max(counts.values(), default=0), stagnant
            runs[run] = (tuple(recent), fingerprint, stagnant, end + self.keep)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = self.timed.passed(timerValues, expiredTimerInfo)
        slices, runs = self.timed.get((set(), {}))
        out: list[tuple] = []
        for end in sorted(end for end in slices if end < passed):
            out.extend(self._follow(runs, end, pickle.loads(self.waiting.getValue((end,))[0])))
            self.waiting.removeKey((end,))
            slices.remove(end)
            if len(out) >= STEPS_TOGETHER:
                yield pd.DataFrame(out, columns=["run", "pos", "repetitions", "stagnant"], dtype=object)
                out = []
        self._put(slices, {run: held for run, held in runs.items() if held[3] >= passed})
        if out:
            yield pd.DataFrame(out, columns=["run", "pos", "repetitions", "stagnant"], dtype=object)

    def close(self) -> None:
        pass


def loop_stream(actions: DataFrame, window: int = 20, span: str = "10 seconds", delay: str = "1 minute", keep: str = "7 days") -> DataFrame:
    """Repetition and page stagnation after each action (``run``, ``pos``, ``ts`` and the action), per run, as time passes.

    A slice of ``span`` comes out once the watermark has passed it; its actions are all that is held of a batch's rows.
    """
    length = _milliseconds(span)
    ready = actions.withWatermark("ts", delay).select(
        _bucket("run", RUN_BUCKETS), F.col("ts").alias("time"), ((F.floor(F.unix_millis("ts") / length) + 1) * length).alias("end"), F.col("run").cast("bigint").cast("string").alias("run"), "pos",
        tr.loop_exempt(F.col("name")).alias("exempt"), tr.action_hash(F.col("name"), F.col("params")).alias("hash"),
        tr.page_fingerprint(F.col("url"), F.col("dom_text"), F.col("element_count")).alias("fingerprint"),
    )
    return ready.groupBy("bucket").transformWithStateInPandas(
        Loops(window, span, keep), "run bigint, pos bigint, repetitions bigint, stagnant bigint", "append", "eventTime"
    )


# ---- import --------------------------------------------------------------------------------------------

CHANGE = "content string, kind string, first_pos bigint, last_pos bigint, records bigint, title string, page_url string, image_url string, adopted boolean"
# Records that are not imported are only counted, under this many keys of each outcome.
COUNTERS = 64


class Import(StatefulProcessor):
    """Insert or refresh by content; a file nobody referred to is adopted by the first record that does.

    State per content: the position it was first imported at.  Stored images come in as initial state, so a batch does not read them.
    An imported content is that of a file of the inventory, so the file is an orphan until the content is first inserted; the inventory
    needs no state of its own, which would be a key for every file.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.image = handle.getValueState("image", "first_pos bigint")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for row in initialState.itertuples(index=False):
            self.image.update((int(row.first_pos),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        count, first, last = 0, None, None
        for piece in rows:
            count += len(piece)
            low, high = piece.loc[piece["pos"].idxmin()], piece.loc[piece["pos"].idxmax()]
            first = low if first is None or low["pos"] < first["pos"] else first
            last = high if last is None or high["pos"] > last["pos"] else last
        kind, adopted, began = last["outcome"], False, int(first["pos"])
        if kind == "imported":
            kind = "refresh" if self.image.exists() else "insert"
            if kind == "insert":
                self.image.update((began,))
            began = self.image.get()[0]
            adopted = kind == "insert" and _given(key[0]) is not None
        said = [_given(last[c]) for c in ("title", "page_url", "image_url")] if kind in ("insert", "refresh") else [None] * 3
        content = key[0] if kind in ("insert", "refresh") else None
        yield pd.DataFrame([(content, kind, began, int(last["pos"]), count, *said, adopted)], columns=[part.strip().split(" ")[0] for part in CHANGE.split(",")])

    def close(self) -> None:
        pass


def import_changes(records: DataFrame, files: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """What each micro-batch of records changes: a row per content that it inserts or refreshes, and counts of all that it does not.

    ``files`` is the inventory (unique ``file_name``, ``sha256``), ``images`` what is stored already (``sha256``, ``first_pos``).
    """
    known = files.select(F.col("file_name").alias("found_name"), F.col("sha256").alias("actual_sha256"))
    joined = records.withColumn("__name", ca.base_name(F.col("file_name"))).join(known, F.col("__name") == F.col("found_name"), "left")
    outcome = ca.import_outcome()
    other = F.concat(F.lit("~"), F.col("outcome"), F.lit("~"), F.pmod(F.xxhash64("pos"), F.lit(COUNTERS)).cast("string"))
    keyed = joined.withColumn("outcome", outcome).select(
        F.when(F.col("outcome") == "imported", F.col("actual_sha256")).otherwise(other).alias("content"),
        "pos", "outcome", *(tx.strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "page_url", "image_url")),
    )
    held = None if images is None else images.select(F.col("sha256").alias("content"), "first_pos").groupBy("content")
    return keyed.groupBy("content").transformWithStateInPandas(Import(), CHANGE, "append", "none", held)


def images_of(changes: DataFrame) -> DataFrame:
    """The stored images after all changes: one row per content, the last record's fields, the first import kept."""
    kept = changes.where(F.col("kind").isin("insert", "refresh")).groupBy("content")
    return kept.agg(
        F.min("first_pos").alias("first_pos"), F.sum("records").alias("records"), F.max_by(F.struct("last_pos", "title", "page_url", "image_url"), F.struct("batch", "last_pos")).alias("s")
    ).select(F.col("content").alias("sha256"), "first_pos", "records", "s.*")


def import_runs(changes: DataFrame) -> DataFrame:
    """Statistics of each micro-batch: its run row."""
    records = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("records"))), F.lit(0))
    counted = changes.groupBy("batch").agg(
        F.sum("records").alias("total_records"), records("insert", "refresh").alias("imported_count"), records("skipped").alias("skipped_count"),
        records("no_file", "hash_mismatch").alias("error_count"), F.count_if(F.col("kind") == "insert").alias("inserted"),
        F.count_if(F.col("kind") == "refresh").alias("refreshed"), F.count_if("adopted").alias("adopted"),
    )
    return counted.withColumn("status", F.when(F.col("error_count") > 0, "completed_with_errors").otherwise("completed"))
