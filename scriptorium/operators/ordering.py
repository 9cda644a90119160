"""Global order without one task for all rows: positions, and slices of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stash


def numbered(rows: DataFrame, order: list[Column], out: str = "position") -> tuple[DataFrame, int]:
    """rows with their position, 0 to n-1 in the given order, and n. Rows that are equal in order are numbered in any order among themselves.

    Rows are dealt by range and sorted within the ranges, and written. What reaches the driver is one count a range.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the last range key spreads rows that are equal in all others
    ranged = rows.withColumn("__any", F.monotonically_increasing_id()).repartitionByRange(n, *order, "__any").sortWithinPartitions(*order, "__any")
    ranged = stash(ranged.drop("__any").withColumn("__row_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__row_at", 33)
    counts = sorted((r.p, r.n) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, k in counts:
        starts.append((p, total))
        total += k
    first = spark.createDataFrame(starts, "__row_part long, __row_start long")  # a row for each range
    found = ranged.withColumn("__row_part", part).join(F.broadcast(first), "__row_part")
    return found.withColumn(out, F.col("__row_start") + F.col("__row_at").bitwiseAND((1 << 33) - 1)).drop("__row_part", "__row_start", "__row_at"), total


def by_name(rows: DataFrame, name: str = "name", tie: str = "idx") -> DataFrame:
    """rows with position in order of the name whatever its case, ties by another column."""
    return numbered(rows, [F.lower(name).asc(), F.col(tie).asc()])[0]


def by_score(rows: DataFrame, ties: list[str], score: str = "similarity_score") -> DataFrame:
    """rows with position from the highest score down, ties by other columns."""
    return numbered(rows, [F.col(score).desc(), *(F.col(c).asc() for c in ties)])[0]


def between(rows: DataFrame, start: int, end: int, order: list[Column]) -> DataFrame:
    """Rows from start to end (exclusive) in the given order; only these are sorted again, as files are read in any order."""
    return numbered(rows, order, "__position")[0].where(F.col("__position").between(start, end - 1)).orderBy("__position").drop("__position")


def distinct_sorted(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Each token once, with its position in order of code points."""
    return numbered(tokens.select(token).where(F.col(token).isNotNull()).distinct(), [F.col(token).asc()])[0]


def first_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order, for previews and reports."""
    return rows.orderBy(*order).limit(n)
