"""Places against authority lists: exact and fuzzy lookups, and the cascade that keeps, drops or sets apart a name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, values
from ..functions.text import WS, col, collapse, strip, tokens
from ..session import ship
from .matching import has_digit, place_form

# Least score of a fuzzy heading, files that an unknown name needs, letters that OCR takes for the first.
FUZZY, FEWEST_FILES = 85, 2
FIRST_LETTERS = "a b c d e f g h i l m n o p r s t u v w".split()
#: Keys up to which a dimension is held by each task and compared whole; of a larger one candidates are joined, with the same result.
MOST_KEYS = 5_000
_MOVED = rf"(?i)[{WS}]*\[moved from people[^\]]*\]"


def _no_article(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\A(?i:a |an |the )", ""), rf"\A[{WS}]+|[{WS}]+\z", "")


def heading_key(name: Column | str) -> Column:
    """Key of a subject heading: no article, no qualifier, no full stop at the end."""
    bare = F.regexp_replace(_no_article(col(name)), rf"[{WS}]*\([^)]+\)", "")
    return F.regexp_replace(F.lower(collapse(F.regexp_replace(bare, rf"[^a-zA-Z0-9{WS}.\-]", " "))), r"\.+\z", "")


def full_key(name: Column | str) -> Column:
    """Key that keeps the qualifier's words."""
    opened = F.regexp_replace(_no_article(col(name)), r"\(([^)]+)\)", " $1")
    return F.lower(collapse(F.regexp_replace(opened, rf"[^a-zA-Z0-9{WS}\-]", " ")))


def bare_key(name: Column | str) -> Column:
    """Key without the qualifier."""
    bare = F.regexp_replace(_no_article(col(name)), rf"[{WS}]*\([^)]+\)", "")
    return F.lower(collapse(F.regexp_replace(bare, rf"[^a-zA-Z0-9{WS}\-]", " ")))


def authority_index(headings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full keys (key, heading, ord) and unambiguous bare keys of a list of headings (heading, ord). Of equal full keys the last heading counts."""
    full = headings.withColumn("key", full_key("heading")).where("key <> ''").groupBy("key").agg(F.max_by("heading", "ord").alias("heading"), F.min("ord").alias("ord"))
    bare = headings.withColumn("key", bare_key("heading")).where("key <> ''").groupBy("key").agg(F.count_distinct("heading").alias("n"), F.min("heading").alias("heading"), F.min("ord").alias("ord"))
    return full, bare.where("n = 1").select("key", "heading", "ord")


def labelled_index(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full and bare keys of authority records: labels has pref, label, is_pref, ord. A preferred label wins over others, the last of these; among variants the first wins. Bare keys come from preferred labels alone."""
    rank = F.struct("is_pref", F.when(F.col("is_pref"), F.col("ord")).otherwise(-F.col("ord")))
    full = labels.withColumn("key", full_key("label")).where("key <> ''").groupBy("key").agg(F.max_by("pref", rank).alias("heading"), F.min("ord").alias("ord"))
    _, bare = authority_index(labels.where("is_pref").select(F.col("pref").alias("heading"), "ord"))
    return full, bare


def _probe(rows: DataFrame, dim: DataFrame, key: Column, out: str) -> DataFrame:
    small = dim.select(F.col("key").alias("__key"), F.col("heading").alias(out))
    return rows.join(small, key == F.col("__key"), "left").drop("__key")


def heading_lookup(rows: DataFrame, headings: DataFrame, name: str, out: str) -> DataFrame:
    """rows with out: the heading of the key, of the key without full stops, or of its first word where it has two at most."""
    key = heading_key(name)
    words = tokens(key)
    first = F.when(F.size(words) <= 2, F.get(words, F.lit(0)))
    for k, probe in enumerate((key, F.trim(F.replace(key, F.lit("."), F.lit(""))), first)):
        rows = _probe(rows, headings, probe, f"__h{k}")
    return rows.withColumn(out, F.coalesce("__h0", "__h1", "__h2")).drop("__h0", "__h1", "__h2")


def list_lookup(rows: DataFrame, full: DataFrame, bare: DataFrame, name: str, out: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """rows with out: the override of the bare key, else the heading of the full key, else of the bare key."""
    own = values.OVERRIDES if overrides is None else overrides
    rows = _probe(_probe(rows, full, full_key(name), "__full"), bare, bare_key(name), "__bare")
    first = F.try_element_at(F.create_map(*(F.lit(x) for p in own.items() for x in p)), bare_key(name)) if own else F.lit(None).cast("string")
    return rows.withColumn(out, F.coalesce(first, "__full", "__bare")).drop("__full", "__bare")


def best_heading(names: DataFrame, headings: DataFrame, least: float = FUZZY) -> DataFrame:
    """name, heading: the heading (key, heading, ord) whose key is most like a name's comparison form, the first of equals; null below least.

    names: distinct name.
    """
    spark = names.sparkSession
    forms = names.select("name", place_form("name").alias("form"))
    if headings.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        return _best_of_many(forms, headings, least)
    keys = [(r.key, r.heading) for r in headings.orderBy("ord").collect()]  # at most MOST_KEYS
    ship(spark)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for form in batch.column(1).to_pylist():
                top, best = 0.0, None
                for key, heading in keys if form and len(form.split()) <= 2 else ():
                    n = len(form) + len(key)
                    if 200 * min(len(form), len(key)) > top * n and (score := fuzzy.indel(form, key)) > top:
                        top, best = score, heading
                found.append(best if top >= least else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["name", "heading"])

    return forms.mapInArrow(of, "name string, heading string")


def _best_of_many(forms: DataFrame, headings: DataFrame, least: float) -> DataFrame:
    """best_heading by an equi-join.

    At the least ratio a form of m characters and a key of n differ by (1 - least / 100) (m + n) insertions and
    deletions at most, with n at most m (200 / least - 1). Cut into one piece more than that, the form has a piece that
    the key holds unbroken; forms meet keys by pieces.
    """
    if least < FUZZY:
        raise ValueError(f"pieces are of three characters at most from a ratio of {FUZZY} on")
    m = F.length("form")
    asked = forms.where((F.col("form") != "") & (F.size(tokens("form")) <= 2))
    edits = F.floor((1 - least / 100) * (200 / least) * m + 1e-9)
    n = F.least(edits + 1, m)
    cut = lambda i: F.floor(i * m / n).cast("int")
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substr("form", cut(i) + 1, cut(i + 1) - cut(i)))
    size = F.length("key")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), size)), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substr("key", i, k))))
    index = headings.where("key <> ''").select("key", "heading", "ord", F.explode(F.array_distinct(grams)).alias("piece"))
    met = asked.select("name", "form", F.explode(F.array_distinct(pieces)).alias("piece")).join(index, "piece")
    met = met.where(200 * F.least(m, size) >= least * (m + size)).select("name", "form", "key", "heading", "ord").distinct()
    scored = met.withColumn("score", fuzzy.ratio(forms.sparkSession, "form", "key")).where(F.col("score") >= least)
    best = scored.groupBy("name").agg(F.max_by("heading", F.struct("score", -F.col("ord"))).alias("heading"))
    return forms.select("name").join(best, "name", "left")


def prefix_heading(names: DataFrame, full: DataFrame, bare: DataFrame, least: float = FUZZY, overrides: dict[str, str] | None = None) -> DataFrame:
    """name, heading: the bare key most like a name's comparison form among those that share its first three characters, or do with another first letter.

    An equi-join on prefixes, so the index may be of any size. Of equal scores the first prefix and the first key wins.
    An override counts only where the full index has its heading.
    """
    spark = names.sparkSession
    own = values.OVERRIDES if overrides is None else overrides
    forms = names.select("name", place_form("name").alias("form")).where((F.col("form") != "") & (F.size(tokens("form")) <= 2))
    start = F.substr("form", F.lit(1), F.lit(3))
    others = F.when(F.length("form") >= 3, F.filter(F.transform(F.array(*(F.lit(x) for x in FIRST_LETTERS)), lambda x: F.concat(x, F.substr("form", F.lit(2), F.lit(2)))), lambda p: p != start)).otherwise(F.array().cast("array<string>"))
    probes = forms.select("name", "form", F.posexplode(F.concat(F.array(start), others)).alias("at", "prefix"))
    index = bare.select("key", "heading", "ord", F.substr("key", F.lit(1), F.lit(3)).alias("prefix"))
    m, n = F.length("form"), F.length("key")
    scored = probes.join(index, "prefix").where(200 * F.least(m, n) >= least * (m + n)).withColumn("score", fuzzy.ratio(spark, "form", "key"))
    best = scored.where(F.col("score") >= least).groupBy("name").agg(F.max_by(F.struct("key", "heading"), F.struct("score", -F.col("at"), -F.col("ord"))).alias("b")).select("name", "b.*")
    if not own:
        return best.select("name", "heading")
    best = best.withColumn("__own", F.try_element_at(F.create_map(*(F.lit(x) for p in own.items() for x in p)), F.col("key")))
    held = full.select(F.col("key").alias("__held")).distinct()
    best = best.join(held, full_key("__own") == F.col("__held"), "left")
    return best.select("name", F.when(F.col("__held").isNotNull(), F.col("__own")).otherwise(F.col("heading")).alias("heading"))


def classify_places(
    rows: DataFrame, headings: DataFrame, regional: tuple[DataFrame, DataFrame] | None = None, authority: tuple[DataFrame, DataFrame] | None = None,
    campus: DataFrame | None = None, fewest_files: int = FEWEST_FILES, overrides: dict[str, str] | None = None,
) -> DataFrame:
    """rows (name, files: array, and more) with decision (keep, drop, campus), form and status (matched, unresolved, campus or a reason to drop).

    headings: key, heading, ord; regional and authority: full and bare keys; campus: name in lower case without signs.
    Fuzzy lookups run for the residual of rare unknown names only. A name that is empty but for an article is dropped
    as noise_empty.
    """
    stripped = _no_article(F.col("name"))
    low = stripped == F.lower(stripped)
    out = rows.withColumn("__s", stripped).withColumn("__asked", F.when(low, stripped).otherwise(F.col("name")))
    out = heading_lookup(out, headings, "__asked", "__heading")
    none = F.lit(None).cast("string")
    out = list_lookup(out, *regional, "name", "__regional", overrides) if regional else out.withColumn("__regional", none)
    out = list_lookup(out, *authority, "name", "__authority", overrides) if authority else out.withColumn("__authority", none)
    if campus is not None:
        flat = F.regexp_replace(F.lower(F.trim("name")), r"[^a-z0-9\s]", "")
        out = out.join(campus.select(F.col("name").alias("__campus")).distinct(), flat == F.col("__campus"), "left")
    else:
        out = out.withColumn("__campus", none)
    exact = F.coalesce("__heading", "__regional", "__authority")
    digit = has_digit("__s")
    caps = (F.size(tokens("__s")) == 1) & (F.col("__s") == F.upper("__s")) & F.col("__s").rlike(r"\p{L}") & (F.length("__s") > 2)
    rare = F.size("files") < fewest_files
    moved = F.col("name").rlike(_MOVED)
    open_case = ~moved & F.col("__campus").isNull() & (F.col("__s") != "") & ~(low & ~F.col("__s").rlike(r"\A\p{N}")) & ~F.lower("__s").isin(values.NOT_PLACES) & exact.isNull() & F.col("__s").rlike(r"\A\p{Lu}") & rare & (digit | ~caps)
    out = out.withColumn("__rescue", F.coalesce(open_case, F.lit(False)))
    residual = out.where("__rescue").select(F.col("__s").alias("name")).distinct()
    found = best_heading(residual, headings).withColumnRenamed("heading", "__f0")
    if regional:
        found = list_lookup(found, *regional, "name", "__f1", overrides)
    if authority:
        found = found.join(prefix_heading(residual, *authority, overrides=overrides).withColumnRenamed("heading", "__f2"), "name", "left")
    rescued = F.coalesce(*(c for c in ("__f0", "__f1", "__f2") if c in found.columns))
    found = found.select(F.col("name").alias("__name"), rescued.alias("__found")).where("__found is not null")
    out = out.join(found, F.col("__rescue") & (F.col("__s") == F.col("__name")), "left")

    def verdict(decision: str, form: Column, status: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), form.alias("form"), F.lit(status).alias("status"))

    s = F.col("__s")
    chain = (
        F.when(moved, verdict("campus", F.trim(F.regexp_replace("name", _MOVED, "")), "campus"))
        .when(F.col("__campus").isNotNull(), verdict("campus", F.col("name"), "campus"))
        .when(s == "", verdict("drop", s, "noise_empty"))
        .when(low & ~s.rlike(r"\A\p{N}"), F.when(F.col("__heading").isNotNull(), verdict("keep", F.col("__heading"), "matched")).otherwise(verdict("drop", s, "noise_lowercase")))
        .when(F.lower(s).isin(values.NOT_PLACES), verdict("drop", s, "noise_blocklist"))
        .when(exact.isNotNull(), verdict("keep", exact, "matched"))
        .when(~s.rlike(r"\A\p{Lu}"), verdict("drop", s, "noise_no_capital"))
        .when(F.col("__found").isNotNull(), verdict("keep", F.col("__found"), "matched"))
        .when(digit & rare, verdict("drop", s, "noise_ocr_digit"))
        .when(caps, verdict("drop", s, "noise_allcaps"))
        .when(rare, verdict("drop", s, "noise_low_freq"))
        .otherwise(verdict("keep", s, "unresolved"))
    )
    return out.withColumn("__v", chain).select(*rows.columns, "__v.*")


# Mean radius of the Earth in miles.
EARTH_MILES = 3958.8


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    a = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * EARTH_MILES * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def nearby(gazetteer: DataFrame, lat: float, lon: float, radius: float, classes: list[str] | None = None) -> DataFrame:
    """heading of each place within the radius, the first in row_no of those alike but for case: heading, distance.

    gazetteer: row_no, feature_name, feature_class, state_name, prim_lat_dec, prim_long_dec (strings; blank or
    non-numeric coordinates drop the row). A box of degrees is asked before the distance.
    """
    classes = classes or values.FEATURE_CLASSES
    la, lo = (F.expr(f"try_cast({c} AS double)") for c in ("prim_lat_dec", "prim_long_dec"))
    gazetteer = gazetteer.withColumns({c: strip(c) for c in ("feature_class", "state_name")})
    rows = gazetteer.where(F.col("feature_class").isin(classes)).withColumn("__la", la).withColumn("__lo", lo).where("__la is not null and __lo is not null")
    rows = rows.where(F.abs(F.col("__la") - lat) <= radius / 69.0 + 0.01).withColumn("distance", miles(F.lit(lat), F.lit(lon), F.col("__la"), F.col("__lo"))).where(F.col("distance") <= radius)
    code = F.try_element_at(F.create_map(*(F.lit(x) for p in values.STATE_CODES.items() for x in p)), F.col("state_name"))
    dotted = F.concat(F.substr(code, F.lit(1), F.lit(1)), F.lit("."), F.substr(code, F.lit(2), F.lit(1)), F.lit("."))
    name, state = collapse("feature_name"), F.coalesce(dotted, F.nullif(F.col("state_name"), F.lit("")))
    heading = F.when(state.isNull(), name).otherwise(F.concat(name, F.lit(" ("), state, F.lit(")")))
    rows = rows.withColumn("heading", heading).where(name != "")
    return rows.groupBy(F.lower("heading").alias("__k")).agg(F.min_by(F.struct("heading", "distance"), "row_no").alias("x")).select("x.*")


def personal_names(headings: DataFrame, label: str = "label") -> DataFrame:
    """headings with surname and given (null for an initial) of inverted personal names; other headings are left out."""
    clean = lambda c: F.regexp_replace(c, r"""\A[ .,;:()'"\-]+|[ .,;:()'"\-]+\z""", "")
    trimmed = F.regexp_replace(col(label), rf"\A[{WS}]+|[{WS}]+\z", "")
    pattern = rf"\A([^\n]+?),[{WS}]+([^\p{{Nd}}{WS}(][\p{{L}}\p{{N}}_'\x{{C0}}-\x{{17E}}\x{{180}}-\x{{24F}}\-]*)"
    rows = headings.withColumn("__last", clean(F.regexp_extract(trimmed, pattern, 1))).withColumn("__first", F.lower(clean(F.regexp_extract(trimmed, pattern, 2))))
    last, first = F.col("__last"), F.col("__first")
    corporate = F.exists(F.split(F.lower(last), rf"[{WS}\-]+"), lambda w: w.isin(values.CORPORATE_WORDS))
    good = (first != "") & ~first.rlike(r"\A\p{N}") & ~first.isin(values.NOT_FORENAMES) & ~first.isin(values.RANKS) & (last != "") & ~corporate
    good = good & (F.size(tokens(last)) <= 6) & ~last.contains("(") & ~last.rlike(r"\A\p{N}")
    initial = first.rlike(r"\A\p{L}\.*\z")
    return rows.where(good).withColumn("surname", F.lower(last)).withColumn("given", F.when(~initial, first)).drop("__last", "__first")


def name_tokens(names: DataFrame) -> DataFrame:
    """kind (surname or given), token, n: words of the names that count, by occurrence in records. names: surname, given."""

    def words(c: str) -> Column:
        cut = F.transform(tokens(F.coalesce(F.col(c), F.lit(""))), lambda w: F.regexp_replace(w, r"""\A[ .,;:"'!?*\-]+|[ .,;:"'!?*\-]+\z""", ""))
        return F.filter(cut, lambda w: (F.length(w) >= 2) & ~w.isin(values.PARTICLES) & w.rlike(r"\A\p{L}"))

    def tagged(c: str) -> Column:
        return F.transform(words(c), lambda w: F.struct(F.lit(c).alias("kind"), w.alias("token")))

    both = F.concat(tagged("surname"), tagged("given"))
    return names.select(F.explode(both).alias("x")).groupBy("x.kind", "x.token").agg(F.count("*").alias("n"))


def common_tokens(counted: DataFrame, least: int = 5) -> DataFrame:
    return counted.where(F.col("n") >= least)


def token_cardinalities(counted: DataFrame, thresholds: tuple[int, ...] = (2, 5, 10, 20)) -> DataFrame:
    """kind, words, and at_least_k for each threshold: how many words of a kind occur that often."""
    return counted.groupBy("kind").agg(F.count("*").alias("words"), *(F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in thresholds))


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, heading string, ord long")
