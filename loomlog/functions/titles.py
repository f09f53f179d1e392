"""Titles, scope prefixes and log file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title prefix -> scope.
SCOPE_PREFIXES = {
    "[work]": "work",
    "[private]": "private",
    "[both]": "both",
    "[nolog]": "nolog",
}
# Characters a file name may not hold.
ILLEGAL_CHARS = '<>:"/\\|?*'

SCOPES = ("private", "work", "both", "unset", "nolog")

_BLANKS = r"[\s\x1c-\x1f]"


def strip_blanks(c: Column) -> Column:
    """Trim Unicode blanks on both ends."""
    return F.regexp_replace(c, rf"(?U)\A{_BLANKS}+|{_BLANKS}+\z", "")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sanitize_title(title: Column) -> Column:
    """Title as a safe file name part; NULL stays NULL, nothing left gives `session`."""
    bare = strip_blanks(F.btrim(F.btrim(strip_blanks(title), F.lit('"')), F.lit("'")))
    dashed = F.translate(bare, ILLEGAL_CHARS, "-" * len(ILLEGAL_CHARS))
    edges = F.btrim(dashed, F.lit(" -."))
    words = F.trim(F.regexp_replace(edges, rf"(?U){_BLANKS}+", " "))
    return F.coalesce(empty_to_null(words), F.when(title.isNotNull(), F.lit("session")))


def prefix_scope(title: Column) -> Column:
    """Scope named by a `[scope]` title prefix, else NULL."""
    lowered = F.lower(strip_blanks(title))
    out = None
    for marker, scope in SCOPE_PREFIXES.items():
        hit = F.startswith(lowered, F.lit(marker))
        out = F.when(hit, F.lit(scope)) if out is None else out.when(hit, F.lit(scope))
    return out


def clean_title(title: Column) -> Column:
    """Title without its scope prefix, trimmed; empty gives NULL."""
    markers = "|".join(m.strip("[]") for m in SCOPE_PREFIXES)
    return empty_to_null(strip_blanks(
        F.regexp_replace(strip_blanks(title), rf"(?i)\A\[(?:{markers})\]", "")))


def normalize_cwd(cwd: Column) -> Column:
    return F.translate(F.coalesce(cwd, F.lit("")), "\\", "/")


def log_file_name(hhmmss: Column, title: Column, session_id: Column) -> Column:
    """`HHMMSS_<title>_<id>`, or `HHMMSS_<id>` without a title."""
    return F.concat_ws("_", hhmmss, sanitize_title(empty_to_null(title)), session_id)


def log_name_time(name: Column) -> Column:
    """Time key of a log file name, NULL when the name does not start with one."""
    return empty_to_null(F.regexp_extract(name, r"\A(\d{6})_", 1))


def log_name_session(name: Column) -> Column:
    """Session id of a log file name: its last `_` part without the extension."""
    return F.regexp_extract(name, r"([^_/]*?)(?:\.(?:md|jsonl))?\z", 1)


def log_summary_line(title: Column, session_id: Column, scope: Column) -> Column:
    return F.format_string("log: %s (%s)", F.coalesce(empty_to_null(title), session_id), scope)


def truncate_text(c: Column, limit: int = 500) -> Column:
    return F.substring(c, 1, limit)


def token_estimate(c: Column) -> Column:
    """Rough token count: a quarter of the characters, rounded down."""
    return F.floor(F.length(c) / F.lit(4)).cast("bigint")
