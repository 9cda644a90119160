"""Queries of mentions, authority lists and place reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import entities, matching, ordering, places
from ..storage import stash
from . import oracle as o
from .catalogue import _CASE, _COUNTED, _EDGES, _OWN, _all, _CLUSTERS, _NAMED, _edges
from .inputs import derived, duck
from .registry import query

_KEPT = f"(SELECT *, earliest_date AS a, latest_date AS b FROM {duck('kept_places')})"
_PLACES = o.reconciled(_KEPT, o.place_form("name"), o.place_keys("norm"), 2, 1, "NOT (x.lcsh_status = 'matched' AND y.lcsh_status = 'matched' AND x.name <> y.name)")
_PLACE_CANONICAL = f"""{_PLACES},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY lcsh_status = 'matched' DESC, regexp_matches(name, '[0-9]'), n_files DESC, list_sum(list_transform({o.tokens('name')}, lambda w: {_CASE})) DESC, idx) AS k FROM clustered),
    canonical AS MATERIALIZED (SELECT cluster, max(name) FILTER (k = 1) AS name, max(lcsh_status) FILTER (k = 1) AS lcsh_status, min(a) AS earliest_date, max(b) AS latest_date, count(*) AS n_variants FROM ranked GROUP BY cluster)"""


def _place_rows(spark, sf_dir):
    """Places to reconcile, with as many file names as they have files."""
    rows = derived(spark, sf_dir, "kept_places")
    return rows.withColumn("files", F.transform(F.sequence(F.lit(1), F.col("n_files")), lambda k: F.concat(F.lit("f"), k.cast("string"))))


def _place_clusters(spark, sf_dir):
    rows = _place_rows(spark, sf_dir)
    edges = stash(matching.match_edges(matching.candidate_pairs(matching.blocks(rows, "places")), "places"), "place_edges")
    return matching.clusters(rows, edges), edges


@query(f"SELECT idx, norm, unnest({o.place_keys('norm')}) AS block_key FROM (SELECT idx, {o.place_form('name')} AS norm FROM {duck('kept_places')})")
def place_block_keys(spark, sf_dir):
    """Comparison form and block keys of each place."""
    return matching.blocks(_place_rows(spark, sf_dir), "places").select("idx", "norm", "block_key")


@query(f"WITH RECURSIVE {_PLACES} SELECT idx_a, idx_b, block_key, round(score, 6) AS score, reason FROM edges")
def place_edges(spark, sf_dir):
    """Pairs of places that match; two confirmed headings never do by their dates alone."""
    return _place_clusters(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


@query(f"WITH RECURSIVE {_PLACE_CANONICAL} SELECT * FROM canonical")
def place_canonical(spark, sf_dir):
    """The canonical row of each cluster of places: a confirmed heading before all else."""
    return matching.canonical_rows(_place_clusters(spark, sf_dir)[0]).drop("files")


@query(f"WITH RECURSIVE {_PLACE_CANONICAL} SELECT lcsh_status, count(*) AS n FROM canonical GROUP BY 1")
def places_by_status(spark, sf_dir):
    """Canonical places in each of the lists that they are split into."""
    parts = matching.by_status(matching.canonical_rows(_place_clusters(spark, sf_dir)[0]))
    counts = [part.groupBy("lcsh_status").agg(F.count("*").alias("n")) for part in parts.values()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH RECURSIVE {_CLUSTERS}, s AS (SELECT count(*) AS n FROM clustered GROUP BY cluster) SELECT count(*) FILTER (n > 1) AS merged_groups, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS variants, count(*) FILTER (n = 1) AS singletons FROM s")
def cluster_summary(spark, sf_dir):
    """Merged groups, variants and singletons of the people."""
    return matching.cluster_summary(matching.clusters(*_edges(spark, sf_dir)))


@query(f"WITH {_EDGES} SELECT idx_a, idx_b, block_key, row_number() OVER (ORDER BY round(score, 6) DESC, idx_a, idx_b, block_key) - 1 AS position FROM edges")
def merge_report_order(spark, sf_dir):
    """Merges from the highest score down."""
    edges = _edges(spark, sf_dir)[1].withColumn("score", F.round("score", 6))
    return ordering.by_score(edges, ["idx_a", "idx_b", "block_key"], "score").select("idx_a", "idx_b", "block_key", "position")


_BASIC = o.reconciled(
    f"(SELECT name, min(idx) AS idx, min(doc_date) AS a, max(doc_date) AS b FROM {duck('mentions')} GROUP BY name)", o.person_form("name", values.BASIC_CONTEXT_WORDS), o.person_keys("norm"), 0, -1, "false"
)


@query(f"WITH RECURSIVE {_BASIC} SELECT idx_a, idx_b, block_key, round(score, 6) AS score, reason FROM edges")
def match_edges_basic(spark, sf_dir):
    """Pairs that match by the basic profile: fewer occupations, no dates."""
    rows = derived(spark, sf_dir, "mentions").groupBy("name").agg(F.min("idx").alias("idx"), F.min("doc_date").alias("earliest_date"), F.max("doc_date").alias("latest_date"))
    edges = matching.match_edges(matching.candidate_pairs(matching.blocks(rows, profile="basic")), profile="basic")
    return edges.withColumn("score", F.round("score", 6))


# mentions and checks of the people list


@query(f"""
    WITH a AS (SELECT filename, label, TRY_CAST(regexp_extract(filename, 'spec-(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE) AS doc_date, {o.normal_form('raw')} AS n FROM {duck('tagger')}),
    b AS (SELECT *, {o.tokens('n')} AS ws FROM a WHERE n <> '' AND length(n) > 1 AND regexp_matches(n, '[A-Za-z]') AND NOT regexp_matches(n, '\\A[A-Z{o.WS}.\\-]{{5,}}\\z')),
    c AS (SELECT *, lower({o.rx('ws[1]', r'\.+\z')}) AS t FROM b),
    d AS (SELECT *, CASE WHEN label IN ('ORG', 'EVENT') THEN regexp_matches(n, '\\A\\p{{L}}') AND regexp_matches(n, '[A-Z][A-Za-z]{{2,}}') AND NOT contains(n, '|') AND NOT regexp_matches(n, '[0-9]{{3,}}')
        WHEN label IN ('GPE', 'LOC') THEN regexp_matches(n, '[A-Za-z]{{3,}}')
        WHEN label <> 'PERSON' OR len(ws) < 2 OR len(ws) > 5 OR list_contains({o.quoted(values.NOT_PEOPLE)}, lower(n)) THEN false
        WHEN list_contains({o.quoted(values.PROFESSIONAL_TITLES)}, t) THEN len(list_filter(ws[2:], lambda w: {_NAMED})) > 0 AND {_all('ws[2:]')}
        WHEN list_contains({o.quoted(values.COURTESY_TITLES)}, t) THEN false
        ELSE {_all('ws')} AND len(list_filter(ws, lambda w: {_NAMED})) >= 2 END AS good FROM c)
    SELECT CASE WHEN label = 'PERSON' THEN 'people' WHEN label IN ('ORG', 'EVENT') THEN 'orgs' ELSE 'places' END AS kind, n AS name, doc_date, filename FROM d WHERE good""")
def mentions_accepted(spark, sf_dir):
    """The mentions of a tagger that count, with the date of their file."""
    rows = derived(spark, sf_dir, "tagger").withColumn("doc_date", entities.file_date("filename"))
    return entities.accepted(rows).select("kind", "name", "doc_date", "filename")


_IS_PLACE = f"(regexp_matches(name, '(?i){'|'.join(values.PLACE_KEYWORDS)}') OR regexp_matches(name, '(?i)\\bbuilding[{o.WS}]*\\z'))"


@query(f"""SELECT 'people' AS kind, name, count(*) AS n FROM {duck('people_list')} WHERE NOT {_IS_PLACE} GROUP BY name
    UNION ALL SELECT 'places', name, count(*) FROM (SELECT n_name AS name FROM nation UNION ALL SELECT name || '  [moved from people — review LCSH form]' FROM {duck('people_list')} WHERE {_IS_PLACE}) GROUP BY name""")
def people_moved_to_places(spark, sf_dir):
    """The people list without places, and the places with those that it held."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"))
    people, found = matching.split_people(derived(spark, sf_dir, "people_list"), nations)
    count = lambda kind, rows: rows.groupBy("name").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count("people", people).unionByName(count("places", found))


@query(f"""WITH {_COUNTED}, g AS (SELECT token FROM counted WHERE kind = 'given' AND n >= 5 AND NOT list_contains({o.quoted(values.NOT_GIVEN_NAMES)}, token)),
    p AS (SELECT idx, n_files, {o.person_form('name')} AS norm FROM {duck('people_list')})
    SELECT idx, len({o.tokens('norm')}) >= 2 AND (n_files >= 3 OR string_split(norm, ' ')[1] IN (SELECT token FROM g)) AS supported FROM p""")
def given_name_check(spark, sf_dir):
    """Whether the given names of an authority list bear out each name."""
    counted = places.common_tokens(places.name_tokens(places.personal_names(derived(spark, sf_dir, "labels_text"))))
    rows = derived(spark, sf_dir, "people_list").withColumn("files", F.array_repeat(F.lit("f"), F.col("n_files")))
    return matching.given_name_support(rows, counted.where("kind = 'given'").select("token")).select("idx", "supported")


# authority lists


_FULL = f"SELECT key, coalesce(max_by(pref, ord) FILTER (is_pref), min_by(pref, ord)) AS heading, min(ord) AS ord FROM (SELECT *, {o.key('label', 'full')} AS key FROM {duck('variants')}) WHERE key <> '' GROUP BY key"
_BARE = f"SELECT {o.key('pref', 'bare')} AS key, min(pref) AS heading, min(ord) AS ord FROM {duck('variants')} WHERE is_pref GROUP BY 1 HAVING count(DISTINCT pref) = 1"


@query(f"""WITH f AS MATERIALIZED ({_FULL}), b AS MATERIALIZED ({_BARE})
    SELECT idx, p.name, coalesce({_OWN}, f.heading, b.heading) AS heading FROM {duck('place_probes')} p LEFT JOIN f ON f.key = {o.key('p.name', 'full')} LEFT JOIN b ON b.key = {o.key('p.name', 'bare')}""")
def place_authority(spark, sf_dir):
    """The heading of each name: an override, else by its full key, else by its bare key."""
    full, bare = places.labelled_index(derived(spark, sf_dir, "variants"))
    return places.list_lookup(derived(spark, sf_dir, "place_probes"), full, bare, "name", "heading").select("idx", "name", "heading")


_HEADED = f"SELECT {o.key('heading', 'full')} AS full_key, {o.key('heading', 'bare')} AS bare_key, heading FROM (SELECT DISTINCT heading FROM {duck('headings')})"


@query(f"""WITH h AS MATERIALIZED ({_HEADED}), f AS (SELECT full_key AS key, min(heading) AS heading FROM h GROUP BY 1), b AS (SELECT bare_key AS key, min(heading) AS heading FROM h GROUP BY 1 HAVING count(*) = 1)
    SELECT idx, p.name, coalesce({_OWN}, f.heading, b.heading) AS heading FROM {duck('places')} p LEFT JOIN f ON f.key = {o.key('p.name', 'full')} LEFT JOIN b ON b.key = {o.key('p.name', 'bare')}""")
def place_regional(spark, sf_dir):
    """The heading of each name in a regional list, which has headings only."""
    headings = derived(spark, sf_dir, "headings").groupBy("heading").agg(F.min("ord").alias("ord"))
    return places.list_lookup(derived(spark, sf_dir, "places"), *places.authority_index(headings), "name", "heading").select("idx", "name", "heading")


_STARTS = "list_concat([substring(form, 1, 3)], CASE WHEN length(form) >= 3 THEN list_filter(list_transform(" + o.quoted(places.FIRST_LETTERS) + ", lambda x: x || substring(form, 2, 2)), lambda x: x <> substring(form, 1, 3)) ELSE [] END)"


_GARBLED = f"(SELECT DISTINCT CASE WHEN idx % 24 < 12 THEN 'Q' || substring(name, 2) ELSE name END AS name FROM {duck('places')})"


@query(f"""WITH h AS MATERIALIZED (SELECT {o.key('heading', 'full')} AS full_key, {o.key('heading', 'bare')} AS key, heading, ord FROM (SELECT heading, min(ord) AS ord FROM {duck('headings')} GROUP BY heading)),
    b AS MATERIALIZED (SELECT key, min(heading) AS heading, min(ord) AS ord FROM h GROUP BY key HAVING count(*) = 1),
    n AS MATERIALIZED (SELECT name, {o.place_form('name')} AS form FROM {_GARBLED}),
    q AS (SELECT name, form, unnest({_STARTS}) AS prefix, unnest(range(len({_STARTS}))) AS nth FROM n WHERE form <> '' AND len(string_split(form, ' ')) <= 2),
    s AS MATERIALIZED (SELECT q.name, nth, b.key, heading, ord, {o.ratio('form', 'b.key')} AS score FROM q JOIN b ON substring(b.key, 1, 3) = prefix),
    t AS (SELECT name, max_by({{'key': key, 'heading': heading}}, {{'score': score, 'nth': -nth, 'ord': -ord}}) AS m FROM s WHERE score >= 85 GROUP BY name),
    u AS (SELECT name, m.heading AS found, ({o.quoted(values.OVERRIDES.values())})[nullif(list_position({o.quoted(values.OVERRIDES)}, m.key), 0)] AS own FROM t)
    SELECT name, CASE WHEN own IS NOT NULL AND {o.key('own', 'full')} IN (SELECT full_key FROM h) THEN own ELSE found END AS heading FROM u""")
def place_prefix_rescue(spark, sf_dir):
    """The heading most like a garbled name, among those that begin alike but for a first letter."""
    headings = derived(spark, sf_dir, "headings").groupBy("heading").agg(F.min("ord").alias("ord"))
    garbled = F.when(F.col("idx") % 24 < 12, F.concat(F.lit("Q"), F.substr("name", F.lit(2)))).otherwise(F.col("name"))
    return places.prefix_heading(derived(spark, sf_dir, "places").select(garbled.alias("name")).distinct(), *places.authority_index(headings))


@query(f"SELECT token, row_number() OVER (ORDER BY token) - 1 AS position FROM (WITH {_COUNTED} SELECT DISTINCT token FROM counted)")
def tokens_sorted(spark, sf_dir):
    """Each name word once, in order."""
    counted = places.name_tokens(places.personal_names(derived(spark, sf_dir, "labels_text")))
    return ordering.distinct_sorted(counted)


@query(f"WITH {_COUNTED} SELECT kind, count(*) AS words, count(*) FILTER (n >= 2) AS at_least_2, count(*) FILTER (n >= 5) AS at_least_5, count(*) FILTER (n >= 10) AS at_least_10, count(*) FILTER (n >= 20) AS at_least_20 FROM counted GROUP BY kind")
def token_thresholds(spark, sf_dir):
    """How many name words occur how often at least."""
    return places.token_cardinalities(places.name_tokens(places.personal_names(derived(spark, sf_dir, "labels_text"))))
