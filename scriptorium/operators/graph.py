"""Joins on hot keys and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stash

#: Rows of numbers up to which a table is broadcast: 32 MB at four columns of eight bytes.
MOST_BROADCAST = 1_000_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a key may hold any share of left's rows.

    A further key, computed from the others, keeps Spark from reusing the partitioning that an aggregation of
    right left behind: then both sides come straight from an exchange, and adaptive execution can cut the
    partition of a hot key into pieces.
    """
    mark = F.xxhash64(*keys)
    return left.withColumn("__mark", mark).join(right.withColumn("__mark", mark), [*keys, "__mark"], how).drop("__mark")


def hinted(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """table (stashed, of numbers only) marked for a broadcast if a count shows that it has at most that many rows; else as it is, and a join with it shuffles."""
    if any(kind not in ("boolean", "int", "bigint", "double") for _, kind in table.dtypes):
        raise ValueError("rows of numbers have a size that is known, others have not")
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def with_ids(rows: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """rows whose key is among ids (how left_semi) or not among them (left_anti), all columns as they were; null counts as a value.

    ids: one column, stashed. Up to MOST_BROADCAST of them rows stay where they are; beyond that they are shuffled once.
    """
    named = hinted(ids.toDF("__among"))
    return rows.join(named, rows[key].eqNullSafe(F.col("__among")), how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph with long node ids.

    edges: columns a and b. Returns node, component (the smallest id reachable) for every node that is not the
    smallest of its own component. Alternates large-star and small-star steps until the edges no longer change; each step is an
    aggregation and a spread_join, each round a written table. No round holds a node's neighbours in one task.
    """
    now = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = _mark_of(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stash(large.distinct(), "large_star")
        discard(now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, ["a"]).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.*").where("a <> b")
        now = stash(small.distinct(), "small_star")
        discard(large)
        after = _mark_of(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _mark_of(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"] or 0
