"""Column functions on text: tokens, spaces, titles, ids, page keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(col: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits; null text has none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def words_at_least(col: Column | str, n: int, letters_only: bool = False) -> Column:
    """Distinct lower-case words of `n` characters or more."""
    c = F.col(col) if isinstance(col, str) else col
    kind = "[a-z]" if letters_only else "[a-z0-9]"
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({kind}{{{n},}})"), F.lit(1)))


def one_space(col: Column | str) -> Column:
    """Hard spaces made plain, runs of white space made one space, ends trimmed, lower case."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, " ", " "), r"[ \t\n\r\f\x0B]+", " ")))


def has_any(text: Column, patterns) -> Column:
    """Whether the text contains one of the patterns as a substring; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    out = F.lit(False)
    for p in patterns:
        out = out | t.contains(p)
    return out


def count_of(text: Column, patterns) -> Column:
    """How many of the patterns the text contains."""
    t = F.coalesce(text, F.lit(""))
    return sum((t.contains(p).cast("int") for p in patterns), F.lit(0))


def section_title(text: Column, index: Column) -> Column:
    """First line, cut to 120 characters, where longer than 10; else a numbered section."""
    line = F.substring(F.split(F.trim(text), "\n")[0], 1, 120)
    return F.when(F.length(line) > 10, line).otherwise(F.concat(F.lit("Section "), (index + 1).cast("string")))


def content_id(text: Column) -> Column:
    """First 12 hex digits of the md5 of the first 200 characters."""
    return F.substring(F.md5(F.substring(text, 1, 200).cast("binary")), 1, 12)


def page_key(chunk_id: Column) -> Column:
    """`SOURCE_pgN` of a chunk id that has it, else the id."""
    found = F.regexp_extract(chunk_id, r"^(.*?_pg[0-9]+)_", 1)
    return F.when(found != "", found).otherwise(chunk_id)


def page_number(chunk_id: Column) -> Column:
    """The page in a chunk id, or null."""
    return F.nullif(F.regexp_extract(chunk_id, "_pg([0-9]+)", 1), F.lit("")).cast("bigint")


def joined_ids(col: Column) -> Column:
    """Comma-joined ids as a sorted set of trimmed, non-empty ids."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")))


def without_fences(col: Column) -> Column:
    """Text without a leading and a closing code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", ""))
