"""Expressions over run histories: action hashes, fingerprints, variables, secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailsift.functions import text as tx
from trailsift.functions import urls as u


def _param(params: Column, name: str) -> Column:
    return F.get_json_object(params, f"$.{name}")


def _or_none(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def sorted_json(params: Column) -> Column:
    """Object members in key order, nulls left out, with ``", "`` and ``": "`` separators.

    Member values keep their JSON text, so numbers and nested objects are not re-typed.
    """
    keys = F.array_sort(F.coalesce(F.json_object_keys(params), F.array().cast("array<string>")))
    members = F.from_json(params, "map<string,string>")
    # Strings come unquoted out of the map; the parsed member tells whether it was one.
    kinds = F.try_variant_get(F.try_parse_json(params), "$", "map<string,variant>")
    in_quotes = lambda text: F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)
    pairs = F.transform(
        F.filter(keys, lambda k: members[k].isNotNull()),
        lambda k: F.concat(
            in_quotes(k), F.lit(": "), F.when(F.schema_of_variant(kinds[k]) == "STRING", in_quotes(members[k])).otherwise(members[k])
        ),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def normalize_action(name: Column, params: Column) -> Column:
    """Text that is equal for actions that count as the same."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(_param(params, "query"), F.lit(""))), r"(?U)[^\w]+", " ")), " ")
    tokens = F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))
    index = _or_none(_param(params, "index"))
    down = F.coalesce(_param(params, "down"), F.lit("true")) != "false"
    return (
        F.when(
            name == "search",
            F.concat_ws("|", F.lit("search"), F.coalesce(_param(params, "engine"), F.lit("google")), F.array_join(tokens, "|")),
        )
        .when(name == "click", F.concat(F.lit("click|"), index))
        .when(
            name == "input",
            F.concat_ws("|", F.lit("input"), index, F.lower(tx.strip(F.coalesce(_param(params, "text"), F.lit(""))))),
        )
        .when(name == "navigate", F.concat(F.lit("navigate|"), F.coalesce(_param(params, "url"), F.lit(""))))
        .when(name == "scroll", F.concat_ws("|", F.lit("scroll"), F.when(down, "down").otherwise("up"), index))
        .otherwise(F.concat(name, F.lit("|"), sorted_json(params)))
    )


def action_hash(name: Column, params: Column) -> Column:
    return F.substring(F.sha2(normalize_action(name, params), 256), 1, 12)


def page_fingerprint(url: Column, dom_text: Column, element_count: Column) -> Column:
    return F.concat_ws("|", url, element_count.cast("string"), F.substring(F.sha2(dom_text, 256), 1, 16))


# Actions that repeat by nature, and the repetition tiers.
LOOP_EXEMPT = ["wait", "done", "go_back"]
LOOP_TIERS = [12, 8, 5]


def loop_exempt(name: Column) -> Column:
    return name.isin(LOOP_EXEMPT)


def budget_used(step: Column, max_steps: Column) -> tuple[Column, Column, Column]:
    """(warn, percent used, steps remaining) for a 0-based step."""
    used = step + 1
    warn = (used / max_steps >= 0.75) & (step < max_steps - 1)
    return warn, F.floor(used * 100 / max_steps).cast("bigint"), max_steps - used


# Input types, attribute keywords and value patterns of detected variables, in test order.
INPUT_TYPES = {"email": "email", "tel": "phone", "date": "date", "number": "number", "url": "url"}
ADDRESS_WORDS = "address|street|addr"
KEYWORDS = [
    ("comment|note|message|description", "comment", None),
    ("email|e-mail", "email", "email"),
    ("phone|tel|mobile|cell", "phone", "phone"),
    (("first", "name"), "first_name", None),
    (("last", "name"), "last_name", None),
    (("full", "name"), "full_name", None),
    ("name", "name", None),
    ("date|dob|birth", "date", "date"),
    ("city", "city", None),
    ("state|province", "state", None),
    ("country", "country", None),
    ("zip|postal|postcode", "zip_code", "postal_code"),
    ("company|organization", "company", None),
]


def detect_variable(value: Column, attrs: Column) -> Column:
    """struct(name, format) from the element attributes, else from the value; NULL when neither tells."""

    def found(name: str, fmt: str | None) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(fmt).cast("string").alias("format"))

    def attr(name: str) -> Column:
        return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))

    hints = F.lower(F.concat_ws(" ", attr("id"), attr("name"), attr("placeholder"), attr("aria-label")))
    kind = F.lower(attr("type"))
    out = F.when(F.lit(False), found("", None))
    for type_name, name in INPUT_TYPES.items():
        out = out.when(kind == type_name, found(name, name))
    is_address = hints.rlike(ADDRESS_WORDS)
    out = out.when(is_address & hints.contains("billing"), found("billing_address", None))
    out = out.when(is_address & hints.contains("shipping"), found("shipping_address", None))
    out = out.when(is_address, found("address", None))
    for words, name, fmt in KEYWORDS:
        test = hints.rlike(words) if isinstance(words, str) else hints.contains(words[0]) & hints.contains(words[1])
        out = out.when(test, found(name, fmt))

    digits = F.regexp_replace(value, r"[\s\-()+]", "")
    words_in = F.size(F.filter(F.split(value, WS_SPLIT), lambda w: w != ""))
    out = out.when(value.rlike(r"(?U)^[\w.\-]+@[\w.\-]+\.\w+$"), found("email", "email"))
    out = out.when(value.rlike(r"^[\d\s\-()+]+$") & (F.length(digits) >= 10), found("phone", "phone"))
    out = out.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), found("date", "date"))
    letters = value.rlike(r"^\p{Lu}[\p{L} \-]*$") & F.length(value).between(2, 30)
    out = out.when(letters & (words_in == 1), found("first_name", None))
    out = out.when(letters & (words_in == 2), found("full_name", None))
    out = out.when(letters, found("name", None))
    return out.when(value.rlike(r"^\d{1,9}$"), found("number", "number"))


WS_SPLIT = r"(?U)\s+"


def mask_secrets(text: Column, secrets: list[tuple[str, str]]) -> Column:
    """Each secret value becomes ``<secret>name</secret>``, in the order given; empty values are skipped."""
    out = text
    for name, value in secrets:
        if value:
            out = F.replace(out, F.lit(value), F.lit(f"<secret>{name}</secret>"))
    return out


def unmask_secrets(text: Column, url: Column, secrets: list[tuple[str | None, str, str]]) -> Column:
    """Tags become values where the page matches the secret's domain pattern (None: everywhere).

    A text that is nothing but a secret's name is replaced as well.
    """
    latest: dict[str, list[tuple[str | None, str]]] = {}
    for pattern, name, value in secrets:
        if value:
            latest.setdefault(name, []).append((pattern, value))

    def value_of(entries: list[tuple[str | None, str]]) -> Column:
        chosen = F.lit(None).cast("string")
        for pattern, value in entries:  # a later pattern that also matches wins
            applies = F.lit(True) if pattern is None else u.domain_pattern_match(url, pattern)
            chosen = F.when(applies, F.lit(value)).otherwise(chosen)
        return chosen

    out = text
    for name, entries in latest.items():
        value = value_of(entries)
        tag = F.lit(f"<secret>{name}</secret>")
        out = F.when(value.isNotNull(), F.replace(out, tag, value)).otherwise(out)
    for name, entries in latest.items():
        value = value_of(entries)
        out = F.when((out == name) & value.isNotNull(), value).otherwise(out)
    return out


def missing_secrets(text: Column, url: Column, secrets: list[tuple[str | None, str, str]]) -> Column:
    """Names of the tags that stay unresolved, sorted."""
    left = unmask_secrets(text, url, secrets)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(left, F.lit(r"<secret>(.*?)</secret>"), F.lit(1))))


def substitute_values(params: Column, old_to_new: list[tuple[str, str]]) -> Column:
    """Replace member values that equal an old value exactly, at any depth.

    Works on the JSON text: a string literal equal to the old value and not followed by ``:`` is a value.
    """
    out = params
    for old, new in old_to_new:
        literal = '"' + old.replace("\\", "\\\\").replace('"', '\\"') + '"'
        replacement = '"' + new.replace("\\", "\\\\").replace('"', '\\"') + '"'
        safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, r"(?<=[:\[,])(\s*)\Q" + literal + r"\E(?!\s*:)", "$1" + safe)
    return out


# ---- addresses inside free text -----------------------------------------------------------------

START, END = "\u0001", "\u0002"  # marks that are taken out of the text first
# What counts as a mail address, a full address and a bare domain in free text (the stray bar in the last class included).
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
FULL_URL = r"(?U)https?://[^\s<>\"']+"
BARE_DOMAIN = r"(?U)(?:www\.)?[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*\.[a-zA-Z]{2,}(?:/[^\s<>\"']*)?"
# Endings of names that are files rather than pages, and words that forbid a visit.
FILE_ENDINGS = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "txt", "md", "csv", "json", "xml", "yaml", "yml",
    "zip", "rar", "7z", "tar", "gz", "bz2", "xz", "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "ico", "mp3", "mp4", "avi",
    "mkv", "mov", "wav", "flac", "ogg", "py", "js", "css", "java", "cpp", "bib", "bibtex", "tex", "latex", "cls", "sty", "exe",
    "msi", "dmg", "pkg", "deb", "rpm", "iso", "polynomial",
]
NEGATIONS = r"(?i)never|dont|not|don't"


def extract_urls(text: Column, guarded: bool = False) -> Column:
    """Distinct addresses of a text: full ones first, then bare domains as https.

    ``guarded`` leaves out file names and addresses that follow a negation within 20 characters.
    """
    bare = F.translate(F.regexp_replace(text, EMAIL, ""), START + END, "")

    def matches(pattern: str) -> Column:
        # Marks around each match: a piece is then "match END text up to the next match".
        marked = F.split(F.regexp_replace(bare, f"({pattern})", f"{START}$1{END}"), START)
        # As the element of a list the pieces are a variable below; named as they are, every match would search the whole text again.
        return F.flatten(F.transform(F.array(marked), found))

    def found(pieces: Column) -> Column:
        # Every earlier piece holds a match of four characters or more, so six cover the 20 before.
        def before(i: Column) -> Column:
            near = F.slice(pieces, F.greatest(i - 5, F.lit(1)), F.least(i, F.lit(6)))
            return F.right(F.translate(F.array_join(near, ""), END, ""), F.lit(20))

        return F.filter(
            F.transform(
                pieces,
                lambda piece, i: F.struct(
                    F.when(i > 0, F.regexp_replace(F.substring_index(piece, END, 1), r"[.,;:!?()\[\]]+$", "")).alias("url"),
                    (F.when(i > 0, before(i)) if guarded else F.lit("")).alias("before"),
                ),
            ),
            lambda m: m["url"].isNotNull(),
        )

    both = F.concat(matches(FULL_URL), matches(BARE_DOMAIN))
    if guarded:
        ending = r"(?i)\.(?:" + "|".join(FILE_ENDINGS) + ")"
        both = F.filter(both, lambda m: ~m["url"].rlike(ending) & ~m["before"].rlike(NEGATIONS))
    return F.array_distinct(
        F.transform(
            both,
            lambda m: F.when(m["url"].rlike("^https?://"), m["url"]).otherwise(F.concat(F.lit("https://"), m["url"])),
        )
    )


def single_url(text: Column) -> Column:
    """The one address a text names; NULL for none or several."""
    return only_url(extract_urls(text, guarded=True))


def only_url(found: Column) -> Column:
    return F.when(F.size(found) == 1, F.element_at(found, 1))


URL_IN_TEXT = r"(?i)https?://[^\s<>\"']+|www\.[^\s<>\"']+|[^\s<>\"']+\.[a-z]{2,}(?:/[^\s<>\"']*)?"


def shortened(url: Column, limit: int) -> Column:
    """``first limit characters...md5[0:7]`` for a long query or fragment, only where that is shorter."""
    base = F.regexp_extract(url, r"(?s)^[^?#]*", 0)
    tail = F.substr(url, F.length(base) + 1)
    short = F.concat(base, F.substr(tail, F.lit(1), F.lit(limit)), F.lit("..."), F.substring(F.md5(tail), 1, 7))
    return F.when((F.length(tail) > limit) & (F.length(short) < F.length(url)), short).otherwise(url)


def shorten_urls(text: Column, limit: int) -> tuple[Column, Column]:
    """(text with long addresses shortened, array of struct(short, original))."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(URL_IN_TEXT), F.lit(0)))
    pairs = F.filter(
        F.transform(found, lambda m: F.struct(shortened(m, limit).alias("short"), m.alias("original"))),
        lambda p: p["short"] != p["original"],
    )
    longest_first = F.array_sort(pairs, lambda a, b: F.length(b["original"]) - F.length(a["original"]))
    out = F.aggregate(longest_first, text, lambda t, p: F.replace(t, p["original"], p["short"]))
    return out, pairs


def restore_urls(text: Column, pairs: Column) -> Column:
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["short"], p["original"]))
