"""Text, file-name and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"
STRIP = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Trim every kind of blank (``trim`` takes spaces only)."""
    return F.regexp_replace(text, STRIP, "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS, " "))


def valid_sha256(value: Column) -> Column:
    v = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(v.rlike("^[0-9a-f]{64}$"), v).otherwise("")


def row_id(sha256: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(sha256, 1, 16))


def normalize_title(title: Column, fallback: Column) -> Column:
    t = collapse(title)
    return F.when(t == "", fallback).otherwise(t)


def markdown_cell(value: Column) -> Column:
    text = F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return collapse(text)


RESERVED = r'[<>:"/\\|?*\x00-\x1f]'


def sanitize_filename(title: Column) -> Column:
    """File stem without characters Windows reserves; at most 180 characters."""
    t = normalize_title(title, F.lit("untitled"))
    t = F.regexp_replace(F.regexp_replace(t, RESERVED, "_"), WS, "_")
    t = F.substring(F.regexp_replace(t, r"^[._ ]+|[._ ]+$", ""), 1, 180)
    return F.when(t == "", "untitled").otherwise(t)


def three_digits(n: Column) -> Column:
    """``%03d``: pads, never cuts (``lpad`` alone would cut longer numbers)."""
    s = n.cast("string")
    return F.when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s)


# File extensions with a known image format.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff"]


def normalize_ext(ext: Column, fallback: str = ".png") -> Column:
    e = F.lower(ext)
    dotted = F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e))
    return (
        F.when(F.coalesce(ext, F.lit("")) == "", fallback)
        .when(dotted == ".jpe", ".jpg")
        .when(dotted.isin(IMAGE_EXTENSIONS), dotted)
        .otherwise(fallback)
    )


def ext_from_path(path: Column, fallback: str = ".jpg") -> Column:
    return normalize_ext(F.regexp_extract(path, r"[^/.](\.[^/.]+)$", 1), fallback)


# Image extensions and body-file extensions by content type.
CONTENT_TYPE_EXT = {
    "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp",
    "image/bmp": ".bmp", "image/tiff": ".tiff", "image/tif": ".tif",
}
MIME_EXT = {
    "text/html": "html", "text/css": "css", "text/javascript": "js", "application/javascript": "js",
    "application/x-javascript": "js", "application/json": "json", "application/xml": "xml", "text/xml": "xml",
    "text/plain": "txt", "image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif",
    "image/webp": "webp", "image/svg+xml": "svg", "image/x-icon": "ico", "font/woff": "woff",
    "font/woff2": "woff2", "application/font-woff": "woff", "application/font-woff2": "woff2",
    "application/x-font-woff": "woff", "application/x-font-woff2": "woff2", "font/ttf": "ttf",
    "application/x-font-ttf": "ttf", "font/otf": "otf", "application/x-font-opentype": "otf",
    "application/pdf": "pdf", "application/zip": "zip", "application/x-zip-compressed": "zip",
    "video/mp4": "mp4", "video/webm": "webm", "audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/wav": "wav",
    "audio/ogg": "ogg",
}


def _media_type(content_type: Column) -> Column:
    return F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))


def _mapped(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def ext_from_content_type(content_type: Column) -> Column:
    return _mapped(_media_type(content_type), CONTENT_TYPE_EXT, ".jpg")


def mime_to_ext(mime: Column) -> Column:
    return _mapped(_media_type(mime), MIME_EXT, "bin")


def is_json_type(content_type: Column) -> Column:
    m = _media_type(content_type)
    return (m == "application/json") | m.endswith("+json")


def titled_stem(title: Column, sequence: Column) -> Column:
    """``sequence_title``, without a generic prefix, safe as a file stem."""
    numbered = F.concat(F.lit("image_"), three_digits(sequence))
    t = normalize_title(title, numbered)
    t = F.regexp_replace(t, r"(?i)^(?:temple|image)_\d{1,6}_?", "")
    t = F.when(t.rlike(r"_\d{3,}(?:_|$)"), t).otherwise(F.concat(three_digits(sequence), F.lit("_"), t))
    t = F.regexp_replace(F.regexp_replace(t, RESERVED, "_"), "_+", "_")
    t = F.substring(F.regexp_replace(t, r"^[._ ]+|[._ ]+$", ""), 1, 180)
    return F.when(t == "", numbered).otherwise(t)


def final_file_name(title: Column, sequence: Column, digest: Column, ext: Column) -> Column:
    """``sequence_title_hash8.ext``."""
    head = F.substring(F.coalesce(digest, F.lit("")), 1, 8)
    short = F.concat(F.lit("_"), F.when(head == "", "nohash").otherwise(head))
    stem = titled_stem(title, sequence)
    whole = F.when(F.endswith(stem, short), stem).otherwise(F.concat(stem, short))
    return F.concat(whole, normalize_ext(ext, ".jpg"))


def stem_of(file_name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def sequence_from_name(file_name: Column) -> Column:
    return F.nullif(F.regexp_extract(stem_of(file_name), r"_(\d{3,})(?:\D|$)", 1), F.lit("")).try_cast("bigint")


def prefix_from_name(file_name: Column, default: str = "temple") -> Column:
    found = F.trim(F.regexp_extract(stem_of(file_name), r"^(.+?)_\d{3,}(?:\D.*)?$", 1))
    return F.when(found == "", default).otherwise(found)


def renumber_title(title: Column, sequence: Column) -> Column:
    """Put ``sequence`` in place of the first ``_dddd`` that another underscore follows."""
    before = F.regexp_extract(title, r"(?s)^(.*?)_\d{1,4}_", 1)
    rest = F.regexp_extract(title, r"(?s)^.*?_\d{1,4}(_.*)$", 1)
    return F.when(title.rlike(r"(?s)_\d{1,4}_"), F.concat(before, F.lit("_"), three_digits(sequence), rest)).otherwise(title)


def numbered_stem(file_name: Column, sequence: Column, default: str = "temple") -> Column:
    return F.concat(prefix_from_name(file_name, default), F.lit("_"), three_digits(sequence))


def coerce_int(value: Column, default: int, low: int, high: int) -> Column:
    """First run of digits, else the default, kept within the bounds."""
    digits = F.nullif(F.regexp_extract(value, r"\d+", 0), F.lit(""))
    n = F.when(digits.isNull(), F.lit(default)).otherwise(
        F.coalesce(digits.try_cast("bigint"), F.lit(high))
    )
    return F.least(F.greatest(n, F.lit(low)), F.lit(high)).cast("bigint")


def metadata_pairs(text: Column) -> Column:
    """``k: v; k2: v2`` as an ordered array of (k, v); the first of equal keys wins."""
    chunks = F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), ";"), strip), lambda c: c.contains(":")
    )
    pairs = F.transform(
        chunks,
        lambda c: F.struct(
            strip(F.substring_index(c, ":", 1)).alias("k"),
            strip(F.regexp_replace(c, r"(?s)^[^:]*:", "")).alias("v"),
        ),
    )
    full = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    keys = F.transform(full, lambda p: p["k"])
    return F.filter(full, lambda p, i: F.array_position(keys, p["k"]) == i + 1)


def merge_metadata(overview: Column, manifest: Column) -> Column:
    """Overview pairs, then the manifest pairs whose key the overview lacks."""
    first = metadata_pairs(overview)
    known = F.transform(first, lambda p: p["k"])
    return F.concat(first, F.filter(metadata_pairs(manifest), lambda p: ~F.array_contains(known, p["k"])))


def pairs_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit(": "), p["v"])), "; ")


def relevant(title: Column, url: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include word and no exclude word in title and address, ignoring case."""
    text = F.lower(F.concat(title, F.lit(" "), url))
    wanted = text.rlike("|".join(f"\\Q{w}\\E" for w in include))
    unwanted = text.rlike("|".join(f"\\Q{w}\\E" for w in exclude)) if exclude else F.lit(False)
    return (F.trim(text) != "") & wanted & ~unwanted


def strip_think(text: Column) -> Column:
    once = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return strip(F.substring_index(once, "</think>", -1))


def format_tokens(n: Column) -> Column:
    def scaled(by: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", n / by), F.lit(unit))

    return (
        F.when(n >= 1_000_000_000, scaled(1_000_000_000, "B"))
        .when(n >= 1_000_000, scaled(1_000_000, "M"))
        .when(n >= 1_000, scaled(1_000, "k"))
        .otherwise(n.cast("string"))
    )


def truncate_error(text: Column) -> Column:
    return F.when(
        F.length(text) > 200, F.concat(F.substring(text, 1, 100), F.lit("......"), F.right(text, F.lit(100)))
    ).otherwise(text)


def truncate_head(text: Column, limit: int) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 23), F.lit("...[text truncated]..."))
    ).otherwise(text)


def truncate_tail(text: Column, limit: int) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.lit("...[text truncated]"), F.right(text, F.lit(limit - 23)))
    ).otherwise(text)


def truncate_history(text: Column, limit: int) -> Column:
    left_out = (F.length(text) - limit).cast("string")
    note = F.concat(F.lit("\n\n[... truncated "), left_out, F.lit(" characters for history]"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), note)).otherwise(text)


def degenerate_output(text: Column, tokens: Column, max_tokens: Column, stop_reason: Column) -> Column:
    """Cut off at the token limit, or the last six characters repeated 40 times."""
    tail = F.right(text, F.lit(6))
    repeats = (F.length(text) - F.length(F.replace(text, tail, F.lit("")))) / 6
    return F.coalesce(
        (stop_reason == "max_tokens")
        | F.coalesce((max_tokens > 0) & (tokens / max_tokens >= 0.9), F.lit(False))
        | ((F.length(text) >= 6) & (repeats >= 40)),
        F.lit(False),
    )


def escape_regex(text: Column) -> Column:
    """User text as a literal pattern."""
    return F.regexp_replace(text, r"([.\\+*?^$(){}|\[\]])", r"\\$1")


def clean_markdown(text: Column) -> Column:
    """Drop percent escapes, embedded JSON state, blank lines and long JSON lines."""
    t = F.regexp_replace(text, "%[0-9A-Fa-f]{2}", "")
    t = F.regexp_replace(t, r'(?s)`\{["\w].*?\}`', "")
    t = F.regexp_replace(t, r'\{"\$type":[^}]{100,}\}', "")
    t = F.regexp_replace(t, r'\{"[^"]{5,}":\{[^}]{100,}\}', "")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    lines = F.filter(
        F.split(t, "\n"),
        lambda line: (strip(line) != "") & ~(strip(line).rlike(r"^[{\[]") & (F.length(strip(line)) > 100)),
    )
    return strip(F.array_join(lines, "\n"))


def drop_surrogates(text: Column) -> Column:
    """Spark strings are UTF-8 and hold no lone surrogates; invalid bytes become U+FFFD."""
    return F.make_valid_utf8(text)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def parse_time_or(text: Column, default: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), default)


