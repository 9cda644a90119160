"""Named entities: normal forms, classes, and rollups by document and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.text import WS, col, collapse, let, tokens

_NAME = r"\A[A-Z][A-Za-z'\-]+\z"


def normal_form(raw: Column | str) -> Column:
    """White space collapsed, signs off both ends; a full stop or closing bracket may end a name."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(raw), r"\A[^A-Za-z]+", ""), r"[^A-Za-z.)]+\z", ""))


def file_date(name: Column | str) -> Column:
    """The date in a file name spec-YYYY-MM-DD..., null without one."""
    found = F.regexp_extract(col(name), r"spec-(\d{4}-\d{2}-\d{2})", 1)
    return F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd")


def is_garbled(text: Column | str) -> Column:
    t = col(text)
    return (F.length(t) <= 1) | ~t.rlike("[A-Za-z]") | t.rlike(rf"\A[A-Z{WS}.\-]{{5,}}\z")


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"[.,;:]+\z", "")


def _named(word: Column) -> Column:
    return _bare(word).rlike(_NAME)


def title_of(words: Column) -> Column:
    """The first word in lower case without full stops, if it is a title; else null."""
    first = F.lower(F.regexp_replace(F.get(words, F.lit(0)), r"\.+\z", ""))
    return F.when(first.isin(*values.PROFESSIONAL_TITLES, *values.COURTESY_TITLES), first)


def classify_person(raw: Column | str) -> Column:
    """decision (keep_full, keep_if_rec or drop) and value (the name, or with a courtesy title the surname)."""

    def judged(name: Column) -> Column:
        def of(words: Column) -> Column:
            rest = F.slice(words, 2, 5)
            title = title_of(words)
            valid = lambda ws: F.forall(ws, lambda w: (_bare(w) == "") | F.lower(_bare(w)).isin(values.NAME_CONNECTORS) | _named(w))
            full = F.struct(F.lit("keep_full").alias("decision"), name.alias("value"))
            drop = F.struct(F.lit("drop").alias("decision"), F.lit(None).cast("string").alias("value"))
            surname = F.struct(F.lit("keep_if_rec").alias("decision"), _bare(F.element_at(words, -1)).alias("value"))
            out = (F.size(words) < 2) | (F.size(words) > 5) | is_garbled(name) | F.lower(name).isin(values.NOT_PEOPLE)
            return (
                F.when(out, drop)
                .when(title.isin(values.PROFESSIONAL_TITLES), F.when(F.exists(rest, _named) & valid(rest), full).otherwise(drop))
                .when(title.isin(values.COURTESY_TITLES), F.when(valid(rest) & _named(F.element_at(F.when(F.size(words) > 0, words), -1)), surname).otherwise(drop))
                .when(valid(words) & (F.size(F.filter(words, _named)) >= 2), full).otherwise(drop)
            )

        return let(tokens(name), lambda w: of(F.when(F.size(w) > 0, w).otherwise(F.array(F.lit("")))))

    return let(normal_form(raw), judged)


def keeps_organisation(name: Column | str) -> Column:
    """Whether an organisation or event, in normal form, is kept."""
    n = col(name)
    return n.rlike(r"\A\p{L}") & n.rlike("[A-Z][A-Za-z]{2,}") & ~n.contains("|") & ~n.rlike(r"\d{3,}")


def keeps_place(name: Column | str) -> Column:
    return col(name).rlike("[A-Za-z]{3,}")


def accepted(mentions: DataFrame) -> DataFrame:
    """The mentions that count, with kind (people, orgs or places) and name. mentions: filename, doc_date, label, raw. Courtesy-title people never count."""
    named = mentions.withColumn("__name", normal_form("raw")).where((F.col("__name") != "") & ~is_garbled("__name"))
    kind = F.when(F.col("label") == "PERSON", "people").when(F.col("label").isin("ORG", "EVENT"), "orgs").when(F.col("label").isin("GPE", "LOC"), "places")
    good = F.when(F.col("label") == "PERSON", classify_person("__name")["decision"] == "keep_full").when(kind == "orgs", keeps_organisation("__name")).when(kind == "places", keeps_place("__name"))
    return named.where(good).select("filename", "doc_date", kind.alias("kind"), F.col("__name").alias("name"))


def rollup(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First and last date and the sorted files of each entity: keys, earliest_date, latest_date, files.

    found: the keys (kind and name unless given), doc_date, filename. Null dates do not count. Distinct rows are taken
    first, so that a name in many files is gathered from one row a file and date range.
    """
    keys = keys or ["kind", "name"]
    per_file = found.groupBy(*keys, "filename").agg(F.min("doc_date").alias("a"), F.max("doc_date").alias("b"))
    return per_file.groupBy(*keys).agg(F.min("a").alias("earliest_date"), F.max("b").alias("latest_date"), F.array_sort(F.collect_list("filename")).alias("files"))


def rollup_long(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rollup as a row for each file of an entity: keys, filename, earliest_date, latest_date. For names in any number of files."""
    keys = keys or ["kind", "name"]
    return found.groupBy(*keys, "filename").agg(F.min("doc_date").alias("earliest_date"), F.max("doc_date").alias("latest_date"))


def combine(partials: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Rollups of chunks made one; equal to the rollup of all."""
    keys = keys or ["kind", "name"]
    rows = partials[0]
    for p in partials[1:]:
        rows = rows.unionByName(p)
    long = rows.select(*keys, "earliest_date", "latest_date", F.explode_outer("files").alias("filename"))
    per_file = long.groupBy(*keys, "filename").agg(F.min("earliest_date").alias("a"), F.max("latest_date").alias("b"))
    return per_file.groupBy(*keys).agg(F.min("a").alias("earliest_date"), F.max("b").alias("latest_date"), F.array_sort(F.collect_list("filename")).alias("files"))


def standardise(names: DataFrame, headings: DataFrame, name: str = "name") -> DataFrame:
    """names with heading: that of the dimension (key, heading) for the lower-cased normal form, else the normal form."""
    dim = headings.select(F.col("key").alias("__key"), F.col("heading").alias("__heading"))
    form = normal_form(name)
    return names.join(dim, F.lower(form) == F.col("__key"), "left").withColumn("heading", F.coalesce("__heading", form)).drop("__key", "__heading")
