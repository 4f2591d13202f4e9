"""Secret scan: base patterns, and tokens that look live because few owners share them.

All expressions run inside the JVM.  The gaps that ``split`` leaves between the matches of a pattern give the place of each match.
Every candidate value is hashed; the hashes are counted over the whole corpus by distinct owners and by distinct repositories (an
owner's parts).  A value is a widely copied example if more than ``max_owners`` owners hold it, or more than one owner and more than
``max_repositories`` repositories in all.  A value in ever so many repositories of one owner is that owner's own: such a token looks live
and is reported as a span of its own.  Base spans are always reported, with both counts beside them.

Counting combines per map task (value, owner, repository), so an example that a third of all rows repeat costs one row per task.

Defined results: a null text counts as empty and has no spans; null owners and repositories count as one owner and repository;
repeated rows each get the full result; a very long text is one row, searched whole by expressions of the JVM; an empty table gives an
empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.llm.common import stored, text_or_empty

# Base patterns (fixed values): kind, pattern, group that holds the value, least code points of that group.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
# Tokens of mixed letters and digits that no base span covers.
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
TOKEN_PARTS = ["[a-z]", "[A-Z]", "[0-9]"]
TOKEN_CHARACTERS = 12  # different characters at least
KINDS = [*(kind for kind, *_ in BASE), "live"]
MAX_OWNERS = 3
MAX_REPOSITORIES = 8

SPAN = "struct<start: int, kind: int, end: int, hash: binary>"


def matches(text: Column, pattern: str, group: int) -> Column:
    """All leftmost matches without overlap: array of (start, end, value), in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), values.alias("value"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, value: string>>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(part["hit"].isNotNull(), F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

    return F.aggregate(parts, begin, step, lambda state: state["out"])


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    kept = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.unhex(F.sha2(m["value"], 256)).alias("hash")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array()).cast(f"array<{SPAN}>")


def _tokens(text: Column, base: Column) -> Column:
    def looks_random(m: Column) -> Column:
        mixed = F.size(F.array_distinct(F.split(m["value"], ""))) >= TOKEN_CHARACTERS
        for part in TOKEN_PARTS:
            mixed = mixed & m["value"].rlike(part)
        return mixed

    free = lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    kept = F.filter(F.filter(matches(text, TOKEN, 0), looks_random), free)
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(len(BASE)).alias("kind"), m["end"].alias("end"), F.unhex(F.sha2(m["value"], 256)).alias("hash")))
    return F.when(text.rlike(TOKEN), spans).otherwise(F.array()).cast(f"array<{SPAN}>")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """Per document: a key of id and text, owner, repository, base spans and free tokens with the hash of their value."""
    text = text_or_empty(text_col)
    row = F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit(":"), text), 256))
    base = F.concat(*(_spans(F.col("__text"), k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(BASE)))
    found = docs.select(
        F.col(id_col).alias("id"), row.alias("row"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), text.alias("__text"),
    )
    return found.withColumn("base", base).withColumn("tokens", _tokens(F.col("__text"), F.col("base"))).drop("__text")


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: in how many repositories and with how many owners it occurs."""
    held = found.select("owner", "repository", F.explode(F.concat("base.hash", "tokens.hash")).alias("hash"))
    each = held.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("parts"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("parts").alias("repositories"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    word = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(F.sort_array(spans), word), ",")


def scan(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text",
         max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Per document: id, base spans, all spans (array of start, kind, end), and how many base values are widely copied.

    ``base`` and ``spans`` are arrays; ``base_text`` and ``spans_text`` say them as ``kind:start:end`` in order of start and kind.
    ``held`` tells of every candidate, reported or not, how many owners and repositories have its value, and whether it is copied.
    """
    found = stored(candidates(docs, id_col, text_col, owner, repository), "secret-candidates")
    widely = (F.col("owners") > max_owners) | ((F.col("owners") > 1) & (F.col("repositories") > max_repositories))
    owners = ownership(found).withColumn("copied", widely)
    spans = found.select("row", F.explode(F.concat("base", "tokens")).alias("span")).select("row", "span.*")
    judged = spans.join(owners, "hash").groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end", "copied", "owners", "repositories")).alias("judged"))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    seen = F.coalesce("judged", F.array().cast("array<struct<start: int, kind: int, end: int, copied: boolean, owners: bigint, repositories: bigint>>"))
    base = F.transform("base", plain)
    live = F.transform(F.filter(seen, lambda s: (s["kind"] == len(BASE)) & ~s["copied"]), plain)
    out = found.join(judged, "row", "left").select(
        "id", base.alias("base"), F.concat(base, live).alias("spans"), F.size(live).alias("n_live"),
        F.size(F.filter(seen, lambda s: (s["kind"] < len(BASE)) & s["copied"])).alias("n_copied"), F.sort_array(seen).alias("held"),
    )
    return out.withColumns({"base_text": _joined(F.col("base")), "spans_text": _joined(F.col("spans"))})


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
