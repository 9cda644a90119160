"""Reconciliation of name variants: comparison forms, blocks, scored pairs, clusters, canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy, values
from ..functions.phonetic import block_keys
from ..functions.text import WS, col, collapse, let, tokens
from .graph import components

# Thresholds of scores, days between date ranges, largest block that is compared.
FUZZY, WITH_DIGIT, TEMPORAL, DAYS, LARGEST_BLOCK = 88, 80, 78, 365, 150
# Letters that OCR reads as the digits 0 to 9.
DIGIT_LETTERS = "olzeasbteg"


def ocr_letters(c: Column) -> Column:
    return F.translate(F.lower(c), "0123456789", DIGIT_LETTERS)


def person_form(name: Column | str, profile: str = "full") -> Column:
    """Comparison form of a person: digits as letters, occupations off the front, the first name spelt in full."""
    context = values.CONTEXT_WORDS if profile == "full" else values.BASIC_CONTEXT_WORDS
    words = tokens(collapse(F.regexp_replace(ocr_letters(col(name)), rf"[^a-z{WS}'\-]", "")))
    full = F.create_map(*(F.lit(x) for pair in values.NICKNAMES.items() for x in pair))

    def of(ws: Column) -> Column:
        first = F.array_position(F.transform(ws, lambda w: w.isin(context)), F.lit(False))
        return let(F.when(first > 0, F.slice(ws, first.cast("int"), F.size(ws))).otherwise(F.array().cast("array<string>")), spelt)

    def spelt(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w, i: F.when(i == 0, F.coalesce(F.try_element_at(full, w), w)).otherwise(w)), " ")

    return let(words, of)


def _no_article(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\A(?i:a |an |the )", ""))


def place_form(name: Column | str) -> Column:
    """Comparison form of a place: no qualifier in brackets, no article, digits as letters."""
    bare = _no_article(F.regexp_replace(col(name), rf"[{WS}]*\([^)]+\)", ""))
    return collapse(F.regexp_replace(ocr_letters(bare), rf"[^a-z0-9{WS}'.\-]", " "))


def is_place_name(name: Column | str) -> Column:
    """Whether a name of the people list is that of a place."""
    return col(name).rlike("(?i)" + "|".join(values.PLACE_KEYWORDS)) | col(name).rlike(rf"(?i)\bbuilding[{WS}]*\z")


def has_digit(name: Column | str) -> Column:
    return col(name).rlike("[0-9]")


def case_score(name: Column | str) -> Column:
    """Sum over words: 2 for a capital and at most two more, 1 for one or two letters, 0 for more capitals or none, -1 for a lower-case start, -2 for capitals only."""

    def of(word: Column) -> Column:
        def judged(t: Column) -> Column:
            inner = F.length(F.regexp_replace(F.substr(t, F.lit(2)), "[^A-Z]", ""))
            return (
                F.when(t == "", 0).when(F.length(t) <= 2, 1).when(t.rlike(r"\A[A-Z]+\z"), -2)
                .when(t.rlike(r"\A[a-z]"), -1).when(inner <= 2, 2).otherwise(0)
            )

        return let(F.regexp_replace(word, "[^A-Za-z]", ""), judged)

    return F.aggregate(F.transform(tokens(name), of), F.lit(0), lambda a, x: a + x)


# What marks a place that stood among the people.
MOVED = "  [moved from people — review LCSH form]"


def moved_suffix(name: Column | str) -> Column:
    """A name of the people list as it goes to the places, marked for review."""
    return F.concat(col(name), F.lit(MOVED))


def split_people(people: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The people (name and more) that are no places, and places (the same columns) with those that are, marked."""
    is_place = F.coalesce(is_place_name("name"), F.lit(False))
    moved = people.where(is_place).withColumn("name", moved_suffix("name"))
    return people.where(~is_place), places.unionByName(moved.select(places.columns))


def with_campus(classified: DataFrame) -> DataFrame:
    """Of classified places those to reconcile: kept ones and campus facilities, under their form as name, with lcsh_status."""
    return classified.where(F.col("decision").isin("keep", "campus")).withColumn("name", F.col("form")).withColumnRenamed("status", "lcsh_status").drop("decision", "form")


def by_status(canonical: DataFrame) -> dict[str, DataFrame]:
    """Canonical places by status: matched, unresolved, campus."""
    return {s: canonical.where(F.col("lcsh_status") == s) for s in ("matched", "unresolved", "campus")}


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """merged_groups, variants (rows that another name stands for) and singletons, in one row."""
    sizes = clustered.groupBy("cluster").count()
    many = F.col("count") > 1
    return sizes.agg(F.count_if(many).alias("merged_groups"), F.coalesce(F.sum(F.when(many, F.col("count") - 1)), F.lit(0)).alias("variants"), F.count_if(~many).alias("singletons"))


def left_out_blocks(blocked: DataFrame, largest: int = LARGEST_BLOCK) -> DataFrame:
    """block_key and rows of the blocks that candidate_pairs does not compare, so that a report can name them."""
    return blocked.groupBy("block_key").agg(F.count("*").alias("rows")).where(F.col("rows") > largest)


def blocks(rows: DataFrame, kind: str = "people", profile: str = "full") -> DataFrame:
    """rows (idx, name and more) with norm and block_key, a row for each key."""
    norm = person_form("name", profile) if kind == "people" else place_form("name")
    return rows.withColumn("norm", norm).withColumn("block_key", F.explode(block_keys("norm", kind)))


def candidate_pairs(blocked: DataFrame, largest: int = LARGEST_BLOCK) -> DataFrame:
    """block_key with a and b, structs of blocked's other columns, for pairs of a block by idx.

    Blocks above the size are left out, which is part of the rule: their members can still meet under another key.
    Their rows go before the self-join, by counts, so no block is gathered in one task.
    """
    sizes = blocked.groupBy("block_key").count().where(F.col("count").between(2, largest)).select("block_key")
    kept = blocked.join(sizes, "block_key", "left_semi")
    fields = [c for c in blocked.columns if c != "block_key"]
    a = kept.select("block_key", F.struct(*fields).alias("a"))
    b = kept.select("block_key", F.struct(*fields).alias("b"))
    return a.join(b, "block_key").where("a.idx < b.idx")


def is_prefix(a: Column, b: Column, least_words: int = 1) -> Column:
    """Whether the shorter form is the other's beginning, up to a word's end."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.size(tokens(short)) >= (0 if least_words <= 1 else least_words)) & ((short == long) | F.startswith(long, F.concat(short, F.lit(" "))) | ((short == "") & F.startswith(long, F.lit(" "))))


def dates_close(a: Column, b: Column, days: int = DAYS) -> Column:
    """Whether two structs' ranges (earliest_date, latest_date) overlap or lie within the days; false without dates."""
    lo, hi = (lambda x: F.least(x["earliest_date"], x["latest_date"])), (lambda x: F.greatest(x["earliest_date"], x["latest_date"]))
    gap = F.greatest(F.datediff(lo(a), hi(b)), F.datediff(lo(b), hi(a)))
    return F.coalesce(gap <= days, F.lit(False))


def match_edges(pairs: DataFrame, kind: str = "people", profile: str = "full") -> DataFrame:
    """Pairs that match: idx_a, idx_b, block_key, score, reason (prefix, fuzzy or temporal_proximity).

    pairs: of candidate_pairs over rows with idx, name, norm, earliest_date, latest_date (dates), and for places
    lcsh_status. A pair in two blocks is there twice.
    """
    a, b = F.col("a"), F.col("b")
    at = -1 if kind == "people" else 0  # the last word of people, the first of places

    def guard_word(x: Column) -> Column:
        return F.coalesce(F.get(tokens(x["norm"]), F.lit(0)) if at == 0 else F.try_element_at(tokens(x["norm"]), F.lit(at)), F.lit(""))

    # 200 min / (m + n) bounds the ratio from above; pairs that cannot reach the least threshold are not scored
    rows = pairs.withColumn("__prefix", is_prefix(a["norm"], b["norm"], 1 if kind == "people" else 2))
    rows = rows.withColumn("__a", fuzzy.token_sort(a["norm"])).withColumn("__b", fuzzy.token_sort(b["norm"]))
    m, n = F.length("__a"), F.length("__b")
    rows = rows.where(F.col("__prefix") | (200 * F.least(m, n) >= TEMPORAL * (m + n)))
    rows = rows.withColumn("__s", fuzzy.pair_scores(pairs.sparkSession, F.col("__prefix"), F.col("__a"), F.col("__b"), guard_word(a), guard_word(b), TEMPORAL))
    score = F.when(F.col("__prefix"), 100.0).otherwise(F.col("__s.score"))
    threshold = F.when(has_digit(a["name"]) | has_digit(b["name"]), WITH_DIGIT).otherwise(FUZZY)
    near = F.lit(profile == "full") & (score >= TEMPORAL) & dates_close(a, b) & (F.col("__s.guard") >= TEMPORAL)
    if kind == "places":
        near = near & ~F.coalesce((a["lcsh_status"] == "matched") & (b["lcsh_status"] == "matched") & (a["name"] != b["name"]), F.lit(False))
    reason = F.when(F.col("__prefix"), "prefix").when(score >= threshold, "fuzzy").when(near, "temporal_proximity")
    judged = rows.select(a["idx"].alias("idx_a"), b["idx"].alias("idx_b"), "block_key", score.alias("score"), reason.alias("reason"))
    return judged.where("reason is not null")


def clusters(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with cluster: the smallest idx that edges lead to."""
    found = components(edges.select(F.col("idx_a").alias("a"), F.col("idx_b").alias("b")))
    return rows.join(found.withColumnRenamed("node", "idx"), "idx", "left").withColumn("cluster", F.coalesce("component", "idx")).drop("component")


def canonical_rows(clustered: DataFrame) -> DataFrame:
    """A row a cluster: cluster, name, earliest_date, latest_date, files, n_variants, and lcsh_status where there is one.

    The name is that of a confirmed heading (lcsh_status matched) where rows have a status, without digits, in most
    files, with the best capitals, the first in order of idx. files: arrays.
    """
    known = [F.coalesce((F.col("lcsh_status") == "matched").cast("int"), F.lit(0)).alias("m")] if "lcsh_status" in clustered.columns else []
    merit = F.struct(*known, (~has_digit("name")).cast("int").alias("d"), F.size("files").alias("f"), case_score("name").alias("c"), (-F.col("idx")).alias("i"))
    best = ["name"] + (["lcsh_status"] if "lcsh_status" in clustered.columns else [])
    heads = clustered.groupBy("cluster").agg(
        F.max_by(F.struct(*best), merit).alias("best"), F.min(F.least("earliest_date", "latest_date")).alias("earliest_date"),
        F.max(F.greatest("earliest_date", "latest_date")).alias("latest_date"), F.count("*").alias("n_variants"),
    )
    files = clustered.select("cluster", F.explode("files").alias("f")).distinct().groupBy("cluster").agg(F.array_sort(F.collect_list("f")).alias("files"))
    return heads.join(files, "cluster", "left").select("cluster", "best.*", "earliest_date", "latest_date", "files", "n_variants")


def merge_report(rows: DataFrame, edges: DataFrame, canonical: DataFrame, clustered: DataFrame) -> DataFrame:
    """An audit row for each edge: name_a, files_a, name_b, files_b, similarity_score, canonical_chosen, block_key, merge_reason."""
    side = lambda s: rows.select(F.col("idx").alias(f"idx_{s}"), F.col("name").alias(f"name_{s}"), F.size("files").alias(f"files_{s}"))
    chosen = clustered.select(F.col("idx").alias("idx_a"), "cluster").join(canonical.select("cluster", F.col("name").alias("canonical_chosen")), "cluster").drop("cluster")
    out = edges.join(side("a"), "idx_a").join(side("b"), "idx_b").join(chosen, "idx_a")
    return out.select("name_a", "files_a", "name_b", "files_b", F.col("score").alias("similarity_score"), "canonical_chosen", "block_key", F.col("reason").alias("merge_reason"))


def given_name_support(rows: DataFrame, given: DataFrame) -> DataFrame:
    """rows (name, files) with supported: two words or more, and three files or a first word among the given names (token) that is one."""
    words = tokens(person_form("name"))
    known = given.select(F.col("token").alias("__given")).where(~F.col("token").isin(values.NOT_GIVEN_NAMES)).distinct()
    first = F.get(words, F.lit(0))
    out = rows.withColumn("__first", first).join(known, F.col("__first") == F.col("__given"), "left")
    return out.withColumn("supported", (F.size(words) >= 2) & ((F.size("files") >= 3) | F.col("__given").isNotNull())).drop("__first", "__given")
