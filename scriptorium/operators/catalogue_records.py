"""Catalogue records: validation, enhancement, profiles, combined columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import values
from ..functions.text import nonempty, strip, title_case, tokens

SCHEMA = StructType([StructField(f, StringType()) for f in values.FIELDS])


def _has(df: DataFrame, field: str) -> Column:
    """Whether a field is there and not empty; null counts as empty."""
    return nonempty(field) if field in df.columns else F.lit(False)


def _set(df: DataFrame, field: str) -> Column:
    """Whether a field has any character, blanks too."""
    return F.coalesce(F.col(field) != "", F.lit(False)) if field in df.columns else F.lit(False)


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def validate(records: DataFrame) -> DataFrame:
    """records with errors, warnings (arrays) and is_valid. Missing columns count as empty; null counts as empty."""
    # The texts of the messages.
    errors = [F.when(~_has(records, f), F.lit(f"Required field '{f}' is missing or empty")) for f in values.REQUIRED_FIELDS]
    kind, lang = (F.col(f) if f in records.columns else F.lit(None).cast("string") for f in ("type", "language"))
    known = "[" + ", ".join(f"'{t}'" for t in values.VALID_TYPES) + "]"
    geo, place, point = (_set(records, f) for f in ("subject_geographic", "geographic_location", "subject_cartographic_coordinates"))
    warnings = [
        F.when(_set(records, "type") & ~kind.isin(values.VALID_TYPES), F.concat(F.lit("Type '"), kind, F.lit(f"' not in standard list: {known}"))),
        F.when(_set(records, "language") & ~F.substr(F.lower(lang), F.lit(1), F.lit(2)).isin(values.VALID_LANGUAGES), F.concat(F.lit("Language code '"), lang, F.lit("' not recognized"))),
        F.when(~_any([_set(records, f) for f in values.FILE_FIELDS]), "No file resources specified (audios, images, models, videos, documents)"),
        F.when(~_set(records, "ismemberof"), "Field 'ismemberof' is recommended to establish collection membership"),
        F.when(~_any([_set(records, f) for f in [*values.PERSONAL_NAME_FIELDS, *values.CORPORATE_NAME_FIELDS]]), "Consider adding at least one personal or corporate name field"),
        F.when(point & ~geo, "Has cartographic coordinates but no subject_geographic description"),
        F.when(place & ~(geo | point), "Has geographic_location but no geographic subject or coordinates"),
    ]
    out = records.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("warnings", F.array_compact(F.array(*warnings)))
    return out.withColumn("is_valid", F.size("errors") == 0)


def summary(validated: DataFrame) -> DataFrame:
    """total, valid, invalid, with_warnings in one row."""
    count = lambda c: F.count_if(c).alias
    return validated.agg(F.count("*").alias("total"), count(F.col("is_valid"))("valid"), count(~F.col("is_valid"))("invalid"), count(F.size("warnings") > 0)("with_warnings"))


def details(validated: DataFrame, key: str = "local_identifier") -> DataFrame:
    """key, kind (error or warning), position, message: a row for each message of records that have any."""
    each = lambda kind, c: validated.select(key, F.lit(kind).alias("kind"), F.posexplode(c).alias("position", "message"))
    return each("error", "errors").unionByName(each("warning", "warnings"))


def top_fields(profiled: DataFrame, n: int = 10) -> DataFrame:
    """The n fields that most records have, ties in order of their names, for a report."""
    return profiled.orderBy(F.col("percentage").desc(), "field").limit(n)


def name_case(name: Column | str) -> Column:
    """Title case by words, articles in lower case but for the first word."""
    return F.array_join(F.transform(tokens(name), lambda w, i: F.when((i > 0) & F.lower(w).isin(values.SMALL_WORDS), F.lower(w)).otherwise(title_case(w))), " ")


def enhance(records: DataFrame, fill_defaults: bool = True, normalize_names: bool = False, timestamp: bool = False) -> DataFrame:
    """records with defaults in empty fields, names in title case and a time of generation, as asked. Columns that are not there are not added but for the last, _generation_timestamp."""
    out = records
    if fill_defaults:
        out = out.withColumns({f: F.when(~nonempty(f), F.lit(v)).otherwise(F.col(f)) for f, v in values.DEFAULTS.items() if f in out.columns})
    if normalize_names:
        own = {f: F.when(_set(out, f), name_case(strip(f))).otherwise(F.col(f)) for f in values.PERSONAL_NAME_FIELDS if f in out.columns}
        own |= {f: F.when(_set(out, f), title_case(strip(f))).otherwise(F.col(f)) for f in values.CORPORATE_NAME_FIELDS if f in out.columns}
        out = out.withColumns(own) if own else out
    return out.withColumn("_generation_timestamp", F.current_timestamp()) if timestamp else out


def profile(records: DataFrame) -> DataFrame:
    """field, total, populated, percentage, a row for each column, from one pass of one aggregation."""
    counts = records.agg(F.count("*").alias("__n"), *(F.count_if(nonempty(F.col(f"`{c}`").cast("string"))).alias(f"__{k}") for k, c in enumerate(records.columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col("__n").alias("total"), F.col(f"__{k}").alias("populated")) for k, c in enumerate(records.columns))))
    share = F.when(F.col("total") > 0, F.col("populated") / F.col("total") * 100).otherwise(0.0)
    return counts.select(rows.alias("x")).select("x.*").withColumn("percentage", share)


def fully_populated(records: DataFrame) -> DataFrame:
    """Records in which no field is empty, counted: n."""
    return records.agg(F.count_if(reduce(lambda a, b: a & b, [nonempty(F.col(f"`{c}`").cast("string")) for c in records.columns])).alias("n"))


def combine_columns(records: DataFrame, prefix: str = "personal_name", out: str = "personal_name_combined", separator: str = "|@|") -> DataFrame:
    """records with out: what is not empty in the columns that begin with prefix, trimmed and joined; out itself is never a source, so a second run changes nothing."""
    sources = [c for c in records.columns if c.startswith(prefix) and c != out]
    parts = F.filter(F.array(*(strip(F.coalesce(c, F.lit(""))) for c in sources)), lambda x: x != "") if sources else F.array().cast("array<string>")
    return records.withColumn(out, F.array_join(parts, separator))


def ordered_for_export(records: DataFrame) -> DataFrame:
    """Columns of the schema first, in its order, then the others; null as empty. Missing ones of the schema are added empty."""
    rest = [c for c in records.columns if c not in values.FIELDS]
    own = [(F.col(f) if f in records.columns else F.lit("")).alias(f) for f in values.FIELDS]
    return records.select(*own, *rest).fillna("")


def template(spark) -> DataFrame:
    """A record of the schema, empty but for defaults."""
    return spark.createDataFrame([[values.DEFAULTS.get(f, "") for f in values.FIELDS]], SCHEMA)

