"""Indel similarity of strings: an Arrow-batched form by bit-parallel LCS, and a native one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .text import col, tokens


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a bit of an integer stands for a character of a."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    open_bits = full
    for c in b:
        met = open_bits & where.get(c, 0)
        open_bits = ((open_bits + met) | (open_bits - met)) & full
    return len(a) - open_bits.bit_count()


def indel(a: str | None, b: str | None) -> float | None:
    """100 times twice the LCS over both lengths; 100 for two empty strings, null for null."""
    if a is None or b is None:
        return None
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs_length(a, b) / n


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio(spark: SparkSession, a: Column | str, b: Column | str) -> Column:
    """Indel ratio of two columns, 0 to 100."""
    ship(spark)
    return F.pandas_udf(_ratios, "double")(col(a), col(b))


def pair_scores(spark: SparkSession, skip: Column, a: Column, b: Column, c: Column, d: Column, least: float) -> Column:
    """score (of a and b) and guard (of c and d, where the score reaches least); nulls where skip holds. One call a row, whatever is made of it."""
    ship(spark)

    def of(skip: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        scores = [None if k else indel(x, y) for k, x, y in zip(skip, a, b)]
        guards = [indel(x, y) if s is not None and s >= least else None for s, x, y in zip(scores, c, d)]
        return pd.DataFrame({"score": pd.Series(scores, dtype="float64"), "guard": pd.Series(guards, dtype="float64")})

    # taken for non-deterministic, so that a filter on its result does not run it a second time
    return F.pandas_udf(of, "score double, guard double").asNondeterministic()(skip, a, b, c, d)


def token_sort(c: Column | str) -> Column:
    """Words of c in order, joined by spaces; the ratio of two of these is the token-sort ratio."""
    return F.array_join(F.array_sort(tokens(c)), " ")


def ratio_native(a: Column, b: Column) -> Column:
    """ratio in built-in expressions: a row of the LCS table is folded over the characters of b. For short strings."""
    chars = F.filter(F.split(a, ""), lambda x: x != "")
    start = F.transform(chars, lambda _: F.lit(0))

    def step(row: Column, c: Column) -> Column:
        # the best so far runs along as the last entry of what is built
        before = F.concat(F.array(F.lit(0)), row)
        pairs = F.zip_with(F.zip_with(row, before, lambda up, left: F.struct(up.alias("up"), left.alias("left"))), chars, lambda x, y: F.struct(x["up"].alias("up"), x["left"].alias("left"), y.alias("y")))
        return F.transform(
            F.filter(F.aggregate(
                F.filter(pairs, lambda p: p["up"].isNotNull()), F.array(F.lit(0)),
                lambda acc, p: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), p["up"], F.when(p["y"] == c, p["left"] + 1).otherwise(0)))),
            ), lambda v, i: i > 0), lambda v: v
        )

    best = F.aggregate(F.filter(F.split(b, ""), lambda x: x != ""), start, step, lambda row: F.coalesce(F.element_at(F.when(F.size(row) > 0, row), -1), F.lit(0)))
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 100.0).otherwise(200.0 * best / F.nullif(n, F.lit(0)))
