"""Strings as the archival tools treat them: Unicode white space, trims, words, title case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode as the inside of a character class; Java and RE2 read it alike.
WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same without the line feed.
WS_IN_LINE = r"\t\x0B-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str, chars: str = WS) -> Column:
    """c without leading and trailing characters of a class (its inside)."""
    return F.regexp_replace(col(c), rf"\A[{chars}]+|[{chars}]+\z", "")


def collapse(c: Column | str) -> Column:
    """c trimmed, runs of white space made one space."""
    return F.trim(F.regexp_replace(col(c), f"[{WS}]+", " "))


def tokens(c: Column | str) -> Column:
    """Words between white space; none in a blank string."""
    return F.filter(F.split(col(c), f"[{WS}]+"), lambda t: t != "")


def nonempty(c: Column | str) -> Column:
    """Whether c has anything but white space; false for null."""
    return F.coalesce(strip(c) != "", F.lit(False))


def title_case(c: Column | str) -> Column:
    """Lower case with a capital at the start of each run of letters, also behind digits, hyphens and apostrophes."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substr(r, F.lit(1), F.lit(1))), F.substr(r, F.lit(2)))), "")


def slug(c: Column | str) -> Column:
    """Lower-case ASCII letters and digits, anything else made single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def file_stem(c: Column | str) -> Column:
    """A file name without its last extension; a leading dot starts none."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\A.*/", ""), r"(?s)(?<=.)\.[^.]*\z", "")


def file_slug(c: Column | str) -> Column:
    """Slug base of a file: its stem, underscores and dots as hyphens, other signs dropped."""
    kept = F.regexp_replace(F.translate(F.lower(file_stem(c)), "_.", "--"), r"[^a-z0-9\-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), r"\A-|-\z", "")
