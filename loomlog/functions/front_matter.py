"""Article front matter, paths and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIBRARY_ROOT = "library/"
# Files the jobs write themselves, at the library root only.
GENERATED_FILES = ("index.md", "CHANGELOG.md")
# What counts as a set share flag.
SHARE_VALUES = ("true", "yes", "1")

_BLOCK = r"\A---\s*\n(.*?)\n---\s*\n"


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def front_matter(text: Column) -> Column:
    """Text between the two `---` lines at the start of the file, else empty."""
    return F.regexp_extract(text, "(?sd)" + _BLOCK, 1)


def article_body(text: Column) -> Column:
    return F.regexp_replace(text, "(?sd)" + _BLOCK, "")


def field(block: Column, name: str) -> Column:
    """First `name: value` line of a front matter block, value trimmed; absent or empty -> NULL."""
    return _first(block, rf"(?md)^{name}:[^\S\n]*(\S.*)$")


def _first(text: Column, pattern: str) -> Column:
    """First group of the first match, trimmed; NULL without one. Refers to `text` once, so
    nested uses stay small when Spark pushes a filter through them."""
    return F.trim(F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0)))


def first_word(value: Column) -> Column:
    return F.regexp_extract(value, r"\A(\S+)", 1)


def field_anywhere(text: Column, name: str) -> Column:
    """Looser reading: any line of the file, and an empty value takes the next line."""
    return _first(text, rf"(?md)^{name}:\s*(\S.*)$")


def share_flag(block: Column, strict: bool = False) -> Column:
    """True when the first `share` key of the block is set; a trailing `# note` is ignored
    unless `strict`."""
    value = F.regexp_extract(block, r"(?md)^[^\S\n]*share[^\S\n]*(?::(.*))?$", 1)
    if not strict:
        value = F.regexp_replace(value, r"(?:\A|\s)#.*\z", "")
    return F.coalesce(F.lower(F.trim(value)).isin(*SHARE_VALUES), F.lit(False))


def list_field(block: Column, name: str) -> Column:
    """`name: [a, b]` as an array without blank members; absent -> empty array."""
    inner = F.regexp_extract(block, rf"(?md)^{name}:[^\S\n]*\[([^\]\n]*)\]", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda s: F.trim(s)), lambda s: s != "")


def ttl_expiry(updated: Column, ttl: Column) -> Column:
    """Date on which an article runs out; `stable`, absent or odd TTLs never do. Only the
    first word of the value counts."""
    span = ttl
    for unit, word in (("w", "weeks"), ("mo", "months"), ("y", "years")):
        span = F.regexp_replace(span, rf"\A(\d{{1,4}}){unit}(?:\s.*)?\z", f"$1 {word}")
    return updated + span.try_cast("interval")


def display_path(path: Column, root: str = LIBRARY_ROOT) -> Column:
    return F.regexp_replace(path, r"\A\Q" + root + r"\E", "")


def article_category(rel: Column) -> Column:
    return F.when(F.contains(rel, F.lit("/")), F.substring_index(rel, "/", 1)).otherwise("uncategorized")


def article_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.md)?\z", 1)


def slug_valid(stem: Column) -> Column:
    return stem.rlike(r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z")


def wiki_links(text: Column) -> Column:
    """Targets of `[[slug]]` links, each once; alias and anchor parts dropped."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\]\[|#\n]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda s: F.trim(s)), lambda s: s != ""))


def is_generated(rel: Column) -> Column:
    return rel.isin(*GENERATED_FILES)


def escapes_root(rel: Column) -> Column:
    """True when a path below the root is empty or has a `..` segment."""
    return (rel == "") | rel.rlike(r"(?:\A|/)\.\.(?:/|\z)")


def email_hits(text: Column) -> Column:
    """E-mail addresses, counted at the `@`: one character of the local part is enough, so
    long runs without an `@` are not tried again at every position."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}"))


def phone_hits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\+?[0-9][0-9 ().-]{7,18}[0-9]"))
