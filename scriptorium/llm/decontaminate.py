"""Benchmark decontamination by winnowing, in built-in expressions only.

Of every WINDOW - GRAM + 1 consecutive gram hashes the least is kept, on both sides: a shared span of WINDOW words
has a kept hash in common. Documents meet the benchmark by kept hashes; each hit is extended to the windows around
it, and these are compared word by word. Items shorter than a window are sought by grams of their own length.
Documents go in blocks of BLOCK words, each with the words behind it that its last window needs, so work and memory
are in proportion to a text's length however often it is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import grams, let, winnow, words

WINDOW, GRAM, BLOCK = 13, 8, 2048


def _seeds(ws: Column, short: list[int]) -> Column:
    kept = let(grams(ws, GRAM), lambda hs: winnow(hs, WINDOW - GRAM + 1))
    return F.array_distinct(F.concat(kept, *(grams(ws, n) for n in short)))


def _starts(ws: Column, seeds: Column, short: list[int]) -> Column:
    """Of the windows around hits, the first words' places (from 0) and lengths."""
    n = F.size(ws)

    def at(k: int, length: int) -> Column:
        hits = F.filter(F.transform(grams(ws, k), lambda h, i: F.when(F.array_contains(seeds, h), i)), lambda i: i.isNotNull())
        around = F.transform(hits, lambda p: F.sequence(F.greatest(p - (length - k), F.lit(0)), F.least(p, n - length)))
        places = F.array_distinct(F.flatten(around))
        found = F.transform(places, lambda s: F.struct(s.alias("s"), F.lit(length).alias("n")))
        return F.when(n >= length, found).otherwise(F.array().cast("array<struct<s:int,n:int>>"))

    return F.concat(at(GRAM, WINDOW), *(at(k, k) for k in short))


def _blocks(text: Column) -> Column:
    """Blocks of a text's words: at (the first word's place), n_words (of the whole text) and ws; one block where there are no words."""

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)) - F.pmod(F.greatest(n - 1, F.lit(0)), F.lit(BLOCK)), F.lit(BLOCK))
        return F.transform(starts, lambda a: F.struct(a.alias("at"), n.alias("n_words"), F.slice(ws, a + 1, BLOCK + WINDOW - 1).alias("ws")))

    return let(words(text), cut)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Words of each row of docs that stand in a benchmark window: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, whole_window.

    docs: doc_id, text; items: item_id, text; other columns are ignored whatever their names. Null and empty texts
    have no words; an item without words has no window. A null item_id hits words but is not listed. Repeated rows of
    docs each get their result, repeated items count once. Without items nothing is hit; no documents give no rows.
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. whole_window: a window of WINDOW words is hit, not only items
    that are shorter.
    """
    worded = items.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(WINDOW))
    texts = F.transform(F.sequence(F.lit(1), F.size("ws") - length + 1), lambda i: F.array_join(F.slice("ws", i, length), " "))
    windows = common.stash(worded.select("item_id", F.explode(texts).alias("window")).distinct(), "windows")
    short = [r[0] for r in worded.select(F.size("ws").alias("n")).where(F.col("n") < WINDOW).distinct().collect()]  # at most 12 lengths
    exact = F.when(F.size("ws") < WINDOW, F.array(F.xxhash64("ws")))
    seeds = worded.select(F.explode(F.coalesce(exact, _seeds(F.col("ws"), []))).alias("h")).distinct().withColumn("known", F.lit(True))
    seeds = common.stash(seeds, "seeds")  # written, so that Spark knows its size and broadcasts it only if that is small

    # doc_id and a hash of the text name a row, also where rows repeat a doc_id; of each row one entry carries
    # n_words on whether a seed is met or not, under a hash of its own, so that no key of the join is hot
    row = F.xxhash64("text").alias("row")
    own = docs.select("doc_id", row, F.explode(_blocks(F.col("text"))).alias("b")).select("doc_id", "row", "b.*")
    entries = let(F.col("ws"), lambda ws: F.transform(_seeds(ws, short), lambda h: F.struct(F.lit(False).alias("own"), h.alias("h"))))
    first = F.array(F.struct(F.lit(True).alias("own"), F.xxhash64("doc_id", "row", F.lit("own")).alias("h")))
    own = own.select("doc_id", "row", "at", "n_words", F.explode(F.when(F.col("at") == 0, F.concat(first, entries)).otherwise(entries)).alias("x"))
    met = common.stash(own.select("doc_id", "row", "at", "n_words", "x.*").join(seeds, "h", "left").where("own or known").drop("known"), "met")
    chosen = met.where("not own").groupBy("doc_id", "row", "at").agg(F.collect_set("h").alias("seeds"))
    chosen = common.stash(chosen.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("at").alias("__at"), "seeds"), "candidates")

    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))
    texts = docs.select("doc_id", row, "text").join(chosen.select("__id", "__row").distinct(), same, "left_semi")
    blocks = texts.select("doc_id", "row", F.explode(_blocks(F.col("text"))).alias("b")).select("doc_id", "row", "b.at", "b.ws")
    near = blocks.join(chosen, same & (F.col("at") == F.col("__at"))).select("doc_id", "row", "at", "ws", "seeds")
    spans = near.select("doc_id", "row", F.explode(F.transform(_starts(F.col("ws"), F.col("seeds"), short), lambda x: F.struct(
        (F.col("at") + x["s"]).alias("s"), (F.col("at") + x["s"] + x["n"]).alias("e"), F.array_join(F.slice("ws", x["s"] + 1, x["n"]), " ").alias("window")
    ))).alias("x")).select("doc_id", "row", "x.*").distinct()
    hits = common.stash(common.spread_join(spans, windows.select("window").distinct(), ["window"]), "hits")

    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("s", "e"))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"],
    )
    counts = hits.groupBy("doc_id", "row").agg(covered.alias("n_hit"), F.max(F.col("e") - F.col("s") == WINDOW).alias("whole_window"))
    named = common.spread_join(hits.select("doc_id", "row", "window").distinct(), windows, ["window"])
    listed = named.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    result = met.where("own").select("doc_id", "row", "n_words")
    for part in (counts, listed):
        result = result.join(part.withColumnsRenamed({"doc_id": "__id", "row": "__row"}), same, "left").drop("__id", "__row")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return result.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("whole_window", F.lit(False)).alias("whole_window"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without benchmark passages, all columns as they were: those with a whole window go, whatever its share of them, and those that contamination() calls contaminated. Rows that share a doc_id go together.

    An item shorter than a window is too short to speak of a passage wherever it occurs, so it drops a document only
    by its share.
    """
    bad = contamination(docs, items).where("contaminated or whole_window").select("doc_id").distinct()
    return common.with_ids(docs, common.stash(bad, "contaminated"), "left_anti")
