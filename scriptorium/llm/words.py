"""Words as the matching operators take them, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """text with A-Z alone in lower case; lower() does the same wherever no other letter has case."""
    return F.when(text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters and anything beyond ASCII, A-Z lowered; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(ws: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; none where there are fewer words."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, k)))
    return F.when(F.size(ws) >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def winnow(hashes: Column, window: int) -> Column:
    """Distinct minima of all runs of window hashes; none where there are fewer hashes."""
    least = F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.array_min(F.slice(hashes, i, window)))
    return F.when(F.size(hashes) >= window, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))
