"""The library's queries by name, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, values
from ..functions.phonetic import soundex
from ..operators import catalogue_records as records
from ..operators import cleaning, entities, matching, pages, places, routing
from ..sources.readers import html_texts
from ..storage import dealt, stash
from . import oracle as o
from .inputs import derived, duck
from .registry import QUERIES, SQL, query
from .registry import read as _read

__all__ = ["QUERIES", "SQL"]

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(_read(spark, sf_dir, "documents"))


def _wrapped(docs: DataFrame) -> DataFrame:
    """Texts as a scanner leaves them: a gutter before each fifth line, a blank line behind each eighth word break of a kind."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "([a-z]{3}) ([a-z]{2}[^ \n]{2,}) ", "$1 | $2\n"), "\n([A-Z])", "\n\n ~ $1")
    return docs.select("doc_id", F.regexp_replace(text, "([a-z]{4})([a-z]{4}) ", "$1-\n$2 ").alias("text"))


_W = rf"(SELECT doc_id, {o.rx(o.rx(o.rx("coalesce(text, '')", '([a-z]{3}) ([a-z]{2}[^ \n]{2,}) ', r'\1 | \2' + chr(10)), r'\n([A-Z])', chr(10) * 2 + r' ~ \1'), '([a-z]{4})([a-z]{4}) ', r'\1-' + chr(10) + r'\2 ')} AS text FROM documents)"


@query(f"WITH {o.cleaned(_W)} SELECT doc_id, n_lines AS original_lines, n_noise AS noise_removed, n_stripped AS artifacts_stripped, n_hyphens AS hyphens_resolved, CAST(len(paragraphs) AS BIGINT) AS output_paragraphs FROM cleaned")
def ocr_clean_stats(spark, sf_dir):
    """Counters of cleaning, for each document."""
    rows = cleaning.clean(_wrapped(_documents(spark, sf_dir)))
    return rows.select("doc_id", *(F.col(f"stats.{c}").cast("long").alias(c) for c in ("original_lines", "noise_removed", "artifacts_stripped", "hyphens_resolved", "output_paragraphs")))


@query(f"WITH {o.cleaned(_W)} SELECT doc_id, md5(array_to_string(paragraphs, chr(10) || chr(10))) AS clean_md5 FROM cleaned")
def ocr_clean_text(spark, sf_dir):
    """Digest of each cleaned text."""
    return cleaning.clean(_wrapped(_documents(spark, sf_dir))).select("doc_id", F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


@query(f"SELECT doc_id, count(*) AS lines, count(*) FILTER (x) AS noise FROM (SELECT doc_id, {o.noise('s')} AS x FROM (SELECT doc_id, {o.strip(o.gutter('line'))} AS s FROM (SELECT doc_id, unnest(string_split(substring(coalesce(text, ''), 1), chr(10))) AS line FROM documents))) GROUP BY doc_id")
def ocr_noise_flags(spark, sf_dir):
    """Lines and noise lines of each document."""
    flags = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: cleaning.is_noise(cleaning.strip_gutter(x)))
    return _documents(spark, sf_dir).select("doc_id", flags.alias("f")).select("doc_id", F.size("f").cast("long").alias("lines"), F.size(F.filter("f", lambda x: x)).cast("long").alias("noise"))


_LIG = "text"
for _a, _b in cleaning.LIGATURES.items():
    _LIG = f"replace({_LIG}, '{_a}', '{_b}')"


@query(f"""SELECT doc_id, md5({o.rx("array_to_string(list_filter(string_split(" + o.rx(_LIG, '[ \t]{2,}', ' ') + ", chr(10)), lambda x: NOT regexp_matches(x, '" + r"\A[ \t]*[!-/:-@\[-`{-~]+[ \t]*\z" + "')), chr(10))", r'\n{3,}', chr(10) * 2)}) AS repaired_md5
    FROM (SELECT doc_id, replace(replace(coalesce(text, ''), 'fi', 'ﬁ'), '. ', '.   ' || chr(10) || '--' || chr(10) || chr(10) || chr(10) || chr(10)) AS text FROM documents)""")
def ocr_repair(spark, sf_dir):
    """Digest of each text, broken by ligatures and rules and repaired."""
    broken = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("fi"), F.lit("ﬁ")), F.lit(". "), F.lit(".   \n--\n\n\n\n"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(cleaning.repair(broken).cast("binary")).alias("repaired_md5"))


_DENSE = o.rx("coalesce(text, '')", "[" + o.WS + "]")


@query(f"""
    WITH q AS (SELECT doc_id, coalesce(text, '') AS text, len({o.tokens("coalesce(text, '')")}) AS w, length({o.rx(_DENSE, r'\P{L}')}) AS a, length({_DENSE}) AS n FROM documents)
    SELECT doc_id, w >= 15 AND n > 0 AND a >= 0.45::DOUBLE * n AND n >= 2.0::DOUBLE * w AS page_ok, w >= 100 AND n > 0 AND a::DOUBLE / n >= 0.4::DOUBLE AS document_ok,
        CASE WHEN w < 100 THEN 'few' WHEN n = 0 THEN 'blank' WHEN a::DOUBLE / n < 0.4::DOUBLE THEN 'noisy' ELSE 'good' END AS reason,
        length({o.rx('text', '[ \n\t]')}) < 100 AS is_scan FROM q""")
def ocr_quality_gate(spark, sf_dir):
    """Whether the text of each document would pass as a page and as a document, and whether it looks like a scan."""
    docs = _documents(spark, sf_dir).withColumn("q", cleaning.quality("text")).withColumn("d", cleaning.document_ok("text", counted=F.col("q")))
    why = F.when(F.startswith("d.reason", F.lit("too few")), "few").when(F.startswith("d.reason", F.lit("no ")), "blank").when(F.startswith("d.reason", F.lit("alpha")), "noisy").otherwise("good")
    return docs.select("doc_id", cleaning.page_ok("text", counted=F.col("q")).alias("page_ok"), F.col("d.ok").alias("document_ok"), why.alias("reason"), cleaning.is_scan("text").alias("is_scan"))


_BARE = o.rx("w", r"[.,;:]+\z")
_NAMED = f"regexp_matches({_BARE}, '\\A[A-Z][A-Za-z''\\-]+\\z')"
_VALID = f"({_BARE} = '' OR list_contains({o.quoted(values.NAME_CONNECTORS)}, lower({_BARE})) OR {_NAMED})"


def _all(ws: str) -> str:
    return f"len(list_filter({ws}, lambda w: NOT {_VALID})) = 0"


@query(f"""
    WITH a AS (SELECT idx, {o.normal_form('raw')} AS n FROM {duck('tagged')}), b AS (SELECT *, {o.tokens('n')} AS ws FROM a),
    c AS (SELECT *, lower({o.rx('ws[1]', r'\.+\z')}) AS t FROM b),
    d AS (SELECT *, CASE WHEN len(ws) < 2 OR len(ws) > 5 OR length(n) <= 1 OR regexp_matches(n, '\\A[A-Z{o.WS}.\\-]{{5,}}\\z') OR list_contains({o.quoted(values.NOT_PEOPLE)}, lower(n)) THEN 'drop'
        WHEN list_contains({o.quoted(values.PROFESSIONAL_TITLES)}, t) THEN CASE WHEN len(list_filter(ws[2:], lambda w: {_NAMED})) > 0 AND {_all('ws[2:]')} THEN 'keep_full' ELSE 'drop' END
        WHEN list_contains({o.quoted(values.COURTESY_TITLES)}, t) THEN CASE WHEN {_all('ws[2:]')} AND len(list_filter(ws[-1:], lambda w: {_NAMED})) > 0 THEN 'keep_if_rec' ELSE 'drop' END
        WHEN {_all('ws')} AND len(list_filter(ws, lambda w: {_NAMED})) >= 2 THEN 'keep_full' ELSE 'drop' END AS decision FROM c)
    SELECT idx, decision, CASE decision WHEN 'keep_full' THEN n WHEN 'keep_if_rec' THEN {o.rx('ws[-1]', r'[.,;:]+\z')} END AS value FROM d""")
def entity_classify(spark, sf_dir):
    """Decision and value for people as a tagger hands them over."""
    return derived(spark, sf_dir, "tagged").select("idx", entities.classify_person("raw").alias("c")).select("idx", "c.*")


_ROLLUP = f"SELECT kind, name, min(doc_date) AS earliest_date, max(doc_date) AS latest_date, array_to_string(list_sort(list(DISTINCT filename)), ';') AS files FROM {duck('mentions')} GROUP BY kind, name"


@query(_ROLLUP)
def entity_rollup(spark, sf_dir):
    """Dates and files of each entity."""
    return entities.rollup(derived(spark, sf_dir, "mentions")).withColumn("files", F.array_join("files", ";"))


@query(_ROLLUP)
def entity_chunk_combine(spark, sf_dir):
    """The same from rollups of three chunks."""
    rows = derived(spark, sf_dir, "mentions")
    return entities.combine([entities.rollup(rows.where(F.col("idx") % 3 == k)) for k in range(3)]).withColumn("files", F.array_join("files", ";"))


@query(f"SELECT p.idx, p.name, coalesce(h.heading, {o.normal_form('p.name')}) AS heading FROM {duck('places')} p LEFT JOIN {duck('headings')} h ON lower({o.normal_form('p.name')}) = h.key")
def place_standardise(spark, sf_dir):
    """The heading of each place, or its normal form."""
    return entities.standardise(derived(spark, sf_dir, "places"), derived(spark, sf_dir, "headings")).select("idx", "name", "heading")


def _people(spark, sf_dir):
    """Rows to reconcile: idx, name, dates, files."""
    return derived(spark, sf_dir, "mentions").groupBy("name").agg(F.min("idx").alias("idx"), F.min("doc_date").alias("earliest_date"), F.max("doc_date").alias("latest_date"), F.array_sort(F.collect_set("filename")).alias("files"))


_NORMED = f"""
    m AS MATERIALIZED (SELECT * FROM {duck('mentions')}),
    people AS MATERIALIZED (SELECT name, min(idx) AS idx, min(doc_date) AS a, max(doc_date) AS b, list_sort(list(DISTINCT filename)) AS files FROM m GROUP BY name),
    normed AS MATERIALIZED (SELECT *, {o.person_form('name')} AS norm FROM people),
    blocked AS MATERIALIZED (SELECT *, unnest({o.person_keys('norm')}) AS block_key FROM normed)"""
_PAIRS = f"""{_NORMED},
    sized AS (SELECT block_key FROM blocked GROUP BY block_key HAVING count(*) BETWEEN 2 AND 150),
    pairs AS MATERIALIZED (SELECT x.block_key, x.idx AS idx_a, y.idx AS idx_b, x.name AS name_a, y.name AS name_b, x.norm AS na, y.norm AS nb, x.a AS aa, x.b AS ab, y.a AS ba, y.b AS bb FROM blocked x JOIN blocked y USING (block_key) JOIN sized USING (block_key) WHERE x.idx < y.idx)"""
_EDGES = f"""{_PAIRS},
    shaped AS (SELECT *, na = nb OR (length(na) <= length(nb) AND starts_with(nb, na || ' ')) OR (length(nb) < length(na) AND starts_with(na, nb || ' ')) AS is_prefix, {o.token_sort('na')} AS sa, {o.token_sort('nb')} AS sb FROM pairs),
    scored AS MATERIALIZED (SELECT *, CASE WHEN is_prefix THEN 100.0 ELSE {o.ratio('sa', 'sb')} END AS score, {o.ratio("string_split(na, ' ')[-1]", "string_split(nb, ' ')[-1]")} AS last_score FROM shaped),
    judged AS (SELECT *, CASE WHEN is_prefix THEN 'prefix' WHEN score >= CASE WHEN regexp_matches(name_a || name_b, '[0-9]') THEN 80 ELSE 88 END THEN 'fuzzy'
        WHEN score >= 78 AND greatest(aa - bb, ba - ab) <= 365 AND last_score >= 78 THEN 'temporal_proximity' END AS reason FROM scored),
    edges AS MATERIALIZED (SELECT idx_a, idx_b, block_key, score, reason FROM judged WHERE reason IS NOT NULL)"""
_CLUSTERS = f"""{_EDGES},
    both_ways AS (SELECT idx_a AS a, idx_b AS b FROM edges UNION SELECT idx_b, idx_a FROM edges UNION SELECT idx, idx FROM people),
    reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
    clustered AS MATERIALIZED (SELECT p.*, c.cluster FROM people p JOIN (SELECT a AS idx, min(b) AS cluster FROM reach GROUP BY a) c USING (idx))"""
_WORD = "regexp_replace(w, '[^A-Za-z]', '', 'g')"
_CASE = f"CASE WHEN {_WORD} = '' THEN 0 WHEN length({_WORD}) <= 2 THEN 1 WHEN regexp_matches({_WORD}, '\\A[A-Z]+\\z') THEN -2 WHEN regexp_matches({_WORD}, '\\A[a-z]') THEN -1 WHEN length(regexp_replace(substring({_WORD}, 2), '[^A-Z]', '', 'g')) <= 2 THEN 2 ELSE 0 END"
_CANONICAL = f"""{_CLUSTERS},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY regexp_matches(name, '[0-9]'), len(files) DESC, list_sum(list_transform({o.tokens('name')}, lambda w: {_CASE})) DESC, idx) AS k FROM clustered),
    canonical AS MATERIALIZED (SELECT cluster, max(name) FILTER (k = 1) AS name, min(a) AS earliest_date, max(b) AS latest_date, array_to_string(list_sort(list_distinct(flatten(list(files)))), ';') AS files, count(*) AS n_variants FROM ranked GROUP BY cluster)"""


@query(f"WITH {_NORMED} SELECT idx, norm, block_key FROM blocked")
def person_block_keys(spark, sf_dir):
    """Comparison form and block keys of each name."""
    return matching.blocks(_people(spark, sf_dir)).select("idx", "norm", "block_key")


@query(f"SELECT p_partkey, {o.soundex('p_name')} AS code FROM part")
def sound_codes(spark, sf_dir):
    """Sound code of each part's name."""
    return _read(spark, sf_dir, "part").select("p_partkey", soundex("p_name").alias("code"))


@query(f"WITH {_PAIRS} SELECT block_key, idx_a, idx_b FROM pairs")
def candidate_pairs(spark, sf_dir):
    """Pairs within blocks."""
    return matching.candidate_pairs(matching.blocks(_people(spark, sf_dir))).select("block_key", F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"))


def _edges(spark, sf_dir):
    rows = _people(spark, sf_dir)
    return rows, stash(matching.match_edges(matching.candidate_pairs(matching.blocks(rows))), "match_edges")


@query(f"WITH {_EDGES} SELECT idx_a, idx_b, block_key, round(score, 6) AS score, reason FROM edges")
def match_edges(spark, sf_dir):
    """Pairs that match, with score and reason."""
    return _edges(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT idx, name, cluster FROM clustered")
def entity_clusters(spark, sf_dir):
    """The cluster of each name."""
    return matching.clusters(*_edges(spark, sf_dir)).select("idx", "name", "cluster")


@query(f"WITH RECURSIVE {_CANONICAL} SELECT * FROM canonical")
def entity_canonical(spark, sf_dir):
    """The canonical row of each cluster."""
    return matching.canonical_rows(matching.clusters(*_edges(spark, sf_dir))).withColumn("files", F.array_join("files", ";"))


@query(f"WITH RECURSIVE {_CANONICAL} SELECT x.name AS name_a, len(x.files) AS files_a, y.name AS name_b, len(y.files) AS files_b, round(score, 6) AS similarity_score, c.name AS canonical_chosen, block_key, reason AS merge_reason FROM edges e JOIN clustered x ON x.idx = idx_a JOIN people y ON y.idx = idx_b JOIN canonical c USING (cluster)")
def merge_report(spark, sf_dir):
    """Audit rows of merges."""
    rows, edges = _edges(spark, sf_dir)
    clustered = matching.clusters(rows, edges)
    out = matching.merge_report(rows, edges, matching.canonical_rows(clustered), clustered)
    return out.withColumn("similarity_score", F.round("similarity_score", 6)).withColumn("files_a", F.col("files_a").cast("long")).withColumn("files_b", F.col("files_b").cast("long"))


@query("""WITH r AS (SELECT o_custkey AS c, o_orderpriority AS p, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY ALL)
    SELECT x.c AS custkey, count(*) AS n_pairs, count(*) FILTER (greatest(x.a - y.b, y.a - x.b) <= 365) AS n_close FROM r x JOIN r y ON x.c = y.c AND x.p < y.p GROUP BY x.c""")
def temporal_pairs(spark, sf_dir):
    """Of a customer's order priorities, the pairs whose date ranges are close."""
    rows = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p")).agg(F.min(F.to_date("o_orderdate")).alias("earliest_date"), F.max(F.to_date("o_orderdate")).alias("latest_date"))
    side = lambda s: rows.select("c", F.struct("p", "earliest_date", "latest_date").alias(s))
    pairs = side("a").join(side("b"), "c").where("a.p < b.p")
    return pairs.groupBy(F.col("c").alias("custkey")).agg(F.count("*").alias("n_pairs"), F.count_if(matching.dates_close(F.col("a"), F.col("b"))).alias("n_close"))


_TRIM = r"""[ .,;:()''"\-]+"""
_NAMES = rf"""
    t AS (SELECT idx, regexp_extract(label, '\A([^\n]+?),[{o.WS}]+([^\p{{Nd}}{o.WS}(][\p{{L}}\p{{N}}_''\x{{C0}}-\x{{17E}}\x{{180}}-\x{{24F}}\-]*)', ['l', 'f']) AS g FROM {duck('labels_text')}),
    u AS (SELECT idx, regexp_replace(g.l, '\A{_TRIM}|{_TRIM}\z', '', 'g') AS l, lower(regexp_replace(g.f, '\A{_TRIM}|{_TRIM}\z', '', 'g')) AS f FROM t),
    names AS (SELECT idx, lower(l) AS surname, CASE WHEN NOT regexp_matches(f, '\A\p{{L}}\.*\z') THEN f END AS given FROM u WHERE f <> '' AND l <> '' AND NOT regexp_matches(f, '\A\p{{N}}')
        AND NOT list_contains({o.quoted(values.NOT_FORENAMES)}, f) AND NOT list_contains({o.quoted(values.RANKS)}, f) AND NOT list_has_any(regexp_split_to_array(lower(l), '[{o.WS}\-]+'), {o.quoted(values.CORPORATE_WORDS)})
        AND len({o.tokens('l')}) <= 6 AND NOT contains(l, '(') AND NOT regexp_matches(l, '\A\p{{N}}'))"""
_EACH = r"""regexp_replace(w, '\A[ .,;:"''!?*\-]+|[ .,;:"''!?*\-]+\z', '', 'g')"""
_COUNTED = f"""{_NAMES}, each AS (SELECT kind, {_EACH} AS token FROM (SELECT 'surname' AS kind, unnest({o.tokens('surname')}) AS w FROM names UNION ALL SELECT 'given', unnest({o.tokens("coalesce(given, '')")}) FROM names)),
    counted AS (SELECT kind, token, count(*) AS n FROM each WHERE length(token) >= 2 AND NOT list_contains({o.quoted(values.PARTICLES)}, token) AND regexp_matches(token, '\\A\\p{{L}}') GROUP BY ALL)"""


@query(f"WITH {_NAMES} SELECT * FROM names")
def personal_names(spark, sf_dir):
    """Surname and given name of inverted headings that are people."""
    return places.personal_names(derived(spark, sf_dir, "labels_text")).select("idx", "surname", "given")


@query(f"WITH {_COUNTED} SELECT * FROM counted")
def name_tokens(spark, sf_dir):
    """Counts of name words."""
    return places.name_tokens(places.personal_names(derived(spark, sf_dir, "labels_text")))


@query(f"WITH {_COUNTED} SELECT * FROM counted WHERE n >= 5")
def name_tokens_common(spark, sf_dir):
    """Name words that occur five times or more."""
    return places.common_tokens(places.name_tokens(places.personal_names(derived(spark, sf_dir, "labels_text"))))


@query(f"SELECT {o.key('pref', 'bare')} AS key, min(pref) AS heading FROM {duck('variants')} WHERE is_pref GROUP BY 1 HAVING count(DISTINCT pref) = 1")
def geo_index_bare(spark, sf_dir):
    """Bare keys that stand for one heading."""
    return places.labelled_index(derived(spark, sf_dir, "variants"))[1].select("key", "heading")


@query(f"SELECT key, coalesce(max_by(pref, ord) FILTER (is_pref), min_by(pref, ord)) AS heading FROM (SELECT *, {o.key('label', 'full')} AS key FROM {duck('variants')}) GROUP BY key")
def geo_index_full(spark, sf_dir):
    """Full keys with the preferred heading."""
    return places.labelled_index(derived(spark, sf_dir, "variants"))[0].select("key", "heading")


_OWN = f"({o.quoted(values.OVERRIDES.values())})[nullif(list_position({o.quoted(values.OVERRIDES)}, {o.key('name', 'bare')}), 0)]"
_PLACE_FORM = "trim(regexp_replace(regexp_replace(translate(lower(trim(regexp_replace(s, '[ ]*\\([^)]+\\)', '', 'g'))), '0123456789', '" + matching.DIGIT_LETTERS + "'), '[^a-z0-9\\s''.\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
    WITH h AS MATERIALIZED (SELECT * FROM {duck('headings')}), p AS (SELECT *, {o.strip(o.rx('name', r'\A(?i:a |an |the )'))} AS s FROM {duck('places')}),
    q AS (SELECT *, {o.key('s', 'bare', dots=True)} AS k, s = lower(s) AS low, regexp_matches(name, '\\[moved from people') AS moved FROM p),
    x AS (SELECT q.*, coalesce(a.heading, b.heading, c.heading) AS lcsh, {_OWN} AS own FROM q LEFT JOIN h a ON a.key = k LEFT JOIN h b ON b.key = replace(k, '.', '') LEFT JOIN h c ON c.key = string_split(k, ' ')[1] AND len(string_split(k, ' ')) <= 2),
    f AS (SELECT s, max_by(h.heading, {{'score': score, 'ord': -ord}}) AS found FROM (SELECT s, form, heading, ord, {o.ratio('form', 'key')} AS score FROM (SELECT DISTINCT s, {_PLACE_FORM} AS form FROM x) CROSS JOIN h WHERE form <> '' AND len(string_split(form, ' ')) <= 2) h WHERE score >= 85 GROUP BY s),
    y AS (SELECT x.*, coalesce(lcsh, own) AS hit, f.found FROM x LEFT JOIN f USING (s)),
    z AS (SELECT *, CASE WHEN moved THEN 'campus' WHEN lower(name) = 'root hall' THEN 'campus' WHEN s = '' THEN 'noise_empty' WHEN low THEN CASE WHEN lcsh IS NOT NULL THEN 'matched' ELSE 'noise_lowercase' END
        WHEN list_contains({o.quoted(values.NOT_PLACES)}, lower(s)) THEN 'noise_blocklist' WHEN hit IS NOT NULL THEN 'matched' WHEN NOT regexp_matches(s, '\\A[A-Z]') THEN 'noise_no_capital'
        WHEN n_files < 2 AND regexp_matches(s, '[0-9]') THEN CASE WHEN found IS NOT NULL THEN 'matched' ELSE 'noise_ocr_digit' END
        WHEN s = upper(s) AND NOT contains(s, ' ') AND length(s) > 2 THEN 'noise_allcaps' WHEN n_files < 2 THEN CASE WHEN found IS NOT NULL THEN 'matched' ELSE 'noise_low_freq' END ELSE 'unresolved' END AS status FROM y)
    SELECT idx, name, status, CASE WHEN status IN ('matched', 'unresolved') THEN 'keep' WHEN status = 'campus' THEN 'campus' ELSE 'drop' END AS decision,
        CASE WHEN moved THEN trim(regexp_replace(name, '\\s*\\[moved from people[^\\]]*\\]', '')) WHEN status = 'campus' THEN name WHEN status = 'matched' THEN CASE WHEN low THEN lcsh ELSE coalesce(hit, found) END ELSE s END AS form FROM z""")
def place_classify(spark, sf_dir):
    """Decision, form and status of each place name."""
    rows = derived(spark, sf_dir, "places").withColumn("files", F.array_repeat(F.lit("f"), F.col("n_files")))
    headings = derived(spark, sf_dir, "headings")
    campus = spark.createDataFrame([("root hall",)], "name string")
    empty = places.empty_index(spark)
    return places.classify_places(rows, headings, regional=(empty, empty), campus=campus).select("idx", "name", "status", "decision", "form")


@query(f"""WITH n AS (SELECT DISTINCT name AS s FROM {duck('places')}), h AS (SELECT * FROM {duck('headings')}),
    x AS (SELECT s, heading, ord, {o.ratio('form', 'key')} AS score FROM (SELECT s AS s, {_PLACE_FORM.replace('(s,', "(regexp_replace(s, '^(A|An|The|a|an|the) ', ''),")} AS form FROM n) CROSS JOIN h WHERE form <> '' AND len(string_split(form, ' ')) <= 2)
    SELECT n.s AS name, max_by(heading, {{'score': score, 'ord': -ord}}) FILTER (score >= 85) AS heading FROM n LEFT JOIN x USING (s) GROUP BY n.s""")
def place_fuzzy_rescue(spark, sf_dir):
    """The heading most like each place name."""
    return places.best_heading(derived(spark, sf_dir, "places").select("name").distinct(), derived(spark, sf_dir, "headings"))


@query(f"""WITH n AS (SELECT DISTINCT name FROM {duck('mentions')}) SELECT a.name, round({o.ratio('lower(a.name)', "'blue anvil'")}, 6) AS score FROM n a""")
def name_ratio_native(spark, sf_dir):
    """Similarity of each name to one, in built-in expressions."""
    return derived(spark, sf_dir, "mentions").select("name").distinct().select("name", F.round(fuzzy.ratio_native(F.lower("name"), F.lit("blue anvil")), 6).alias("score"))


_STATE = f"({o.quoted(values.STATE_CODES.values())})[nullif(list_position({o.quoted(values.STATE_CODES)}, state_name), 0)]"


@query(f"""WITH g AS (SELECT *, TRY_CAST(prim_lat_dec AS DOUBLE) AS la, TRY_CAST(prim_long_dec AS DOUBLE) AS lo, {o.collapse('feature_name')} AS n, coalesce({_STATE}[1] || '.' || {_STATE}[2] || '.', nullif(state_name, '')) AS st FROM {duck('gazetteer')} WHERE feature_class = 'Populated Place'),
    d AS (SELECT *, pow(sin(radians(la - 43.048852) / 2), 2) + cos(radians(43.048852)) * cos(radians(la)) * pow(sin(radians(lo + 75.38025) / 2), 2) AS a FROM g WHERE la IS NOT NULL AND lo IS NOT NULL),
    e AS (SELECT *, 2 * 3958.8 * atan2(sqrt(a), sqrt(1 - a)) AS miles, CASE WHEN st IS NULL THEN n ELSE n || ' (' || st || ')' END AS heading FROM d)
    SELECT heading, round(miles, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY lower(heading) ORDER BY row_no) AS k FROM e WHERE miles <= 150) WHERE k = 1""")
def nearby_places(spark, sf_dir):
    """Places within 150 miles of a centre."""
    return places.nearby(derived(spark, sf_dir, "gazetteer"), 43.048852, -75.38025, 150).withColumn("distance", F.round("distance", 6))


_FULL_FIELD = lambda f: f"coalesce({o.strip(f)}, '') <> ''"
_IN = set("local_identifier title type genre subgenre_audiovisual_materials subgenre_ephemera subgenre_manuscripts subgenre_publications subgenre_visual_materials ismemberof description rights_statements language personal_name personal_name_author corporate_name subject_cartographic_coordinates subject_geographic geographic_location images".split())
_SET = lambda f: f"coalesce({f}, '') <> ''"
_ERRORS = ", ".join(f"CASE WHEN NOT {_FULL_FIELD(f)} THEN 'Required field ''{f}'' is missing or empty' END" for f in values.REQUIRED_FIELDS)
_KNOWN = "[" + ", ".join(f"''{t}''" for t in values.VALID_TYPES) + "]"
_WARN = f"""CASE WHEN {_SET('type')} AND NOT list_contains({o.quoted(values.VALID_TYPES)}, type) THEN 'Type ''' || type || ''' not in standard list: {_KNOWN}' END,
    CASE WHEN {_SET('language')} AND NOT list_contains({o.quoted(values.VALID_LANGUAGES)}, substring(lower(language), 1, 2)) THEN 'Language code ''' || language || ''' not recognized' END,
    CASE WHEN NOT {_SET('images')} THEN 'No file resources specified (audios, images, models, videos, documents)' END,
    CASE WHEN NOT {_SET('ismemberof')} THEN 'Field ''ismemberof'' is recommended to establish collection membership' END,
    CASE WHEN NOT ({_SET('personal_name')} OR {_SET('personal_name_author')} OR {_SET('corporate_name')}) THEN 'Consider adding at least one personal or corporate name field' END,
    CASE WHEN {_SET('subject_cartographic_coordinates')} AND NOT {_SET('subject_geographic')} THEN 'Has cartographic coordinates but no subject_geographic description' END,
    CASE WHEN {_SET('geographic_location')} AND NOT ({_SET('subject_geographic')} OR {_SET('subject_cartographic_coordinates')}) THEN 'Has geographic_location but no geographic subject or coordinates' END"""
_VALIDATED = f"SELECT local_identifier, list_filter([{_ERRORS}], lambda x: x IS NOT NULL) AS e, list_filter([{_WARN}], lambda x: x IS NOT NULL) AS w FROM {duck('records')}"


@query(f"SELECT local_identifier, len(e) = 0 AS is_valid, array_to_string(e, '|') AS errors, array_to_string(w, '|') AS warnings FROM ({_VALIDATED})")
def metadata_validate(spark, sf_dir):
    """Errors and warnings of each catalogue record."""
    out = records.validate(derived(spark, sf_dir, "records"))
    return out.select("local_identifier", "is_valid", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


@query(f"SELECT count(*) AS total, count(*) FILTER (len(e) = 0) AS valid, count(*) FILTER (len(e) > 0) AS invalid, count(*) FILTER (len(w) > 0) AS with_warnings FROM ({_VALIDATED})")
def metadata_validate_summary(spark, sf_dir):
    """Counts of valid and invalid records."""
    return records.summary(records.validate(derived(spark, sf_dir, "records")))


_SMALL = o.quoted(values.SMALL_WORDS)


@query(f"""SELECT local_identifier, CASE WHEN NOT {_FULL_FIELD('type')} THEN 'object' ELSE type END AS type, CASE WHEN NOT {_FULL_FIELD('language')} THEN 'en' ELSE language END AS language,
    array_to_string(list_transform({o.tokens("coalesce(personal_name, '')")}, lambda w, i: CASE WHEN i > 1 AND list_contains({_SMALL}, lower(w)) THEN lower(w) ELSE {o.title('w')} END), ' ') AS personal_name,
    array_to_string(list_transform({o.tokens("coalesce(personal_name_author, '')")}, lambda w, i: {o.title('w')}), ' ') AS personal_name_author, {o.title("trim(coalesce(corporate_name, ''))")} AS corporate_name FROM {duck('records')}""")
def metadata_enhance(spark, sf_dir):
    """Records with defaults and names in title case."""
    out = records.enhance(derived(spark, sf_dir, "records"), normalize_names=True)
    return out.select("local_identifier", "type", "language", *(F.coalesce(c, F.lit("")).alias(c) for c in ("personal_name", "personal_name_author", "corporate_name")))


_PROFILE = " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS total, count(*) FILTER ({_FULL_FIELD(f)}) AS populated FROM r" for f in sorted(_IN))


@query(f"WITH r AS MATERIALIZED (SELECT * FROM {duck('records')}) SELECT *, round(populated * 100.0 / total, 6) AS percentage FROM ({_PROFILE})")
def metadata_profile(spark, sf_dir):
    """How many records have each field."""
    return records.profile(derived(spark, sf_dir, "records")).withColumn("percentage", F.round("percentage", 6))


@query(f"SELECT local_identifier, array_to_string(list_filter([{o.strip("coalesce(personal_name, '')")}, {o.strip("coalesce(personal_name_author, '')")}], lambda x: x <> ''), '|@|') AS personal_name_combined FROM {duck('records')}")
def combine_columns(spark, sf_dir):
    """Names of all roles in one column."""
    return records.combine_columns(derived(spark, sf_dir, "records")).select("local_identifier", "personal_name_combined")


@query("WITH f AS (SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents) SELECT doc_id, md5 FROM f WHERE md5 NOT IN (SELECT md5 FROM f WHERE doc_id % 3 = 0)")
def manifest_unprocessed(spark, sf_dir):
    """Documents whose content a manifest of every third has not."""
    files = _read(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))
    return pages.unprocessed(files, files.where("doc_id % 3 = 0")).select("doc_id", "md5")


@query("SELECT md5(coalesce(text, '')) AS md5, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    """The first document of each content."""
    return pages.first_of_content(_read(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5")), order="doc_id")


_BASE = o.rx(o.rx(o.rx("translate(lower(regexp_replace(filename, '(.)\\.[^.]*\\z', '\\1')), '_.', '--')", r"[^a-z0-9\-]"), "-+", "-"), r"\A-|-\z")


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY idx) AS k, count(*) OVER (PARTITION BY base) AS c FROM (SELECT idx, filename, {_BASE} AS base FROM {duck('files')})),
    s AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS slug
        UNION ALL SELECT k, list_append(taken, slug), slug FROM (SELECT f.k, taken, CASE WHEN NOT list_contains(taken, base) THEN base ELSE list_filter(list_transform(range(2, c + 3), lambda n: base || '-' || CAST(n AS VARCHAR)), lambda x: NOT list_contains(taken, x))[1] END AS slug FROM s JOIN f ON f.k = s.k + 1))
    SELECT idx, filename, slug FROM f JOIN s USING (k)""")
def slug_assign(spark, sf_dir):
    """A unique slug for each file; numbers that collide are settled in rounds."""
    return pages.assign_slugs(derived(spark, sf_dir, "files").select("idx", "filename")).select("idx", "filename", "slug")


TOPICS = [
    {"slug": "overview", "keywords": [], "threshold": 0},
    {"slug": "english", "keywords": [" the ", " and ", " of "], "threshold": 2},
    {"slug": "licences", "keywords": ["license", "copyright"], "threshold": 1},
]
_LOW = "lower(CASE WHEN instr(body, '## Content' || chr(10) || chr(10)) > 0 THEN substring(body, instr(body, '## Content' || chr(10) || chr(10)) + 12) ELSE body END)"
_TOPIC = ", ".join("CASE WHEN " + " + ".join(["0", *(f"CAST(contains(low, '{k}') AS INT)" for k in t["keywords"])]) + f" >= {t['threshold']} THEN '{t['slug']}' END" for t in TOPICS)
_LINKS = f"SELECT slug, unnest(list_filter([{_TOPIC}], lambda x: x IS NOT NULL)) AS topic FROM (SELECT slug, {_LOW} AS low FROM {duck('source_pages')} WHERE NOT contains(body, '## Related Topics'))"


@query(_LINKS)
def topic_links(spark, sf_dir):
    """Topics of each page."""
    return pages.topic_links(derived(spark, sf_dir, "source_pages"), TOPICS)


@query(f"SELECT topic, count(*) AS n FROM ({_LINKS}) GROUP BY topic")
def topic_counts(spark, sf_dir):
    """Pages of each topic."""
    return pages.topic_counts(pages.topic_links(derived(spark, sf_dir, "source_pages"), TOPICS))


@query(r"""SELECT slug, regexp_extract(body, '\A---\ntitle: "(.*)"\n', 1) AS title, regexp_extract(body, '\nlang: (.*)\n', 1) AS lang, 'notes' AS kind, md5(substring(body, instr(body, '## Content'))) AS body_md5 FROM """ + duck("source_pages"))
def frontmatter_parse(spark, sf_dir):
    """Front matter of each page and a digest of its body."""
    rows = derived(spark, sf_dir, "source_pages").withColumn("p", pages.front_matter("body"))
    return rows.select("slug", *(F.col("p.front")[k].alias(k) for k in ("title", "lang", "kind")), F.md5(F.col("p.body").cast("binary")).alias("body_md5"))


@query("SELECT doc_id, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS tokens, round(length(coalesce(text, '')) // 4 / 1e6 * 3.0 + 500 / 1e6 * 15.0, 9) AS cost FROM documents")
def token_estimate_cost(spark, sf_dir):
    """Estimated tokens of each text and what a summary of 500 tokens would cost."""
    t = pages.estimate_tokens("text")
    return _read(spark, sf_dir, "documents").select("doc_id", t.alias("tokens"), F.round(pages.cost(t, F.lit(500)), 9).alias("cost"))


_PARAS = "string_split(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10))"


@query(f"""
    WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_PARAS} AS ps FROM documents),
    q AS MATERIALIZED (SELECT r, doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS para FROM p),
    w AS (SELECT r, doc_id, i, 1 AS chunk, length(para) + 2 AS size FROM q WHERE i = 1
        UNION ALL SELECT q.r, q.doc_id, q.i, CASE WHEN w.size + length(para) > 400 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.size + length(para) > 400 THEN 0 ELSE w.size END + length(para) + 2 FROM w JOIN q ON q.r = w.r AND q.i = w.i + 1),
    c AS (SELECT w.r, w.doc_id, chunk, string_agg(para, chr(10) || chr(10) ORDER BY w.i) AS t FROM w JOIN q USING (r, i) GROUP BY ALL)
    SELECT doc_id, count(*) AS chunks, md5(string_agg(t, '|' ORDER BY chunk)) AS chunks_md5 FROM c GROUP BY r, doc_id""")
def paragraph_chunks(spark, sf_dir):
    """Chunks of paragraphs up to 400 characters."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n"))
    rows = _documents(spark, sf_dir).withColumn("c", pages.pack_paragraphs(text, 400))
    return rows.select("doc_id", F.size("c").cast("long").alias("chunks"), F.md5(F.array_join("c", "|").cast("binary")).alias("chunks_md5"))


@query(f"SELECT idx, CAST(greatest(1, round_even(floor(width * s) * floor(height * s) / 750, 0)) + 150 AS BIGINT) AS tokens FROM (SELECT idx, width::DOUBLE AS width, height::DOUBLE AS height, least(1.0::DOUBLE, 1500.0::DOUBLE / greatest(width, height)) AS s FROM {duck('files')})")
def image_tokens(spark, sf_dir):
    """Tokens of each image."""
    return derived(spark, sf_dir, "files").select("idx", pages.image_tokens("width", "height").alias("tokens"))


@query(f"SELECT split_part(image, '_', 1) AS prefix, count(*) AS files, CAST(sum(frames) AS BIGINT) AS pages FROM {duck('files')} GROUP BY 1")
def file_groups(spark, sf_dir):
    """Files and pages of each group of images."""
    return pages.file_groups(derived(spark, sf_dir, "files"), "image")


@query(f"SELECT event_id, CASE event_id % 4 WHEN 2 THEN '' ELSE event_type END AS place_1, CASE event_id % 4 WHEN 0 THEN 'b' ELSE '' END AS place_2, CASE event_id % 4 WHEN 0 THEN 'c' ELSE '' END AS place_3 FROM events WHERE event_id % 4 <> 3")
def vision_places_slots(spark, sf_dir):
    """Places in a model's answers, three slots each."""
    rows = derived(spark, sf_dir, "answers").withColumn("s", pages.place_slots("raw")).where("s is not null")
    return rows.select("event_id", *(F.col("s")[k].alias(f"place_{k + 1}") for k in range(3)))


@query(f"""WITH t AS (SELECT gid, project_gid, row_number() OVER (PARTITION BY project_gid ORDER BY modified_at DESC, gid) AS k FROM {duck('tasks')}),
    c AS (SELECT project_gid, max_by(text, {{'a': created_at, 'b': task_gid}}) AS text FROM {duck('comments')} JOIN t ON gid = task_gid WHERE k <= 5 AND type = 'comment' GROUP BY project_gid)
    SELECT gid, coalesce(regexp_replace(c.text, 'https://app\\.asana\\.com/0/profile/[0-9]+[ \\t]*', '', 'g'), '*[From project status, ' || strftime(status_at, '%b %Y') || '] ' || status_text || '*', '*[No recent activity on record]*') AS line FROM {duck('projects')} LEFT JOIN c ON project_gid = gid""")
def digest_latest(spark, sf_dir):
    """The line that a digest has for each project."""
    return pages.latest_comments(derived(spark, sf_dir, "projects"), derived(spark, sf_dir, "tasks"), derived(spark, sf_dir, "comments")).select("gid", "line")


@query(f"SELECT event_id, day FROM {duck('meetings')} WHERE day BETWEEN DATE '2024-01-15' - 7 AND DATE '2024-01-15' + 14 AND n_attendees >= 2 AND NOT all_day")
def calendar_window(spark, sf_dir):
    """Meetings from a week before a day to two weeks after, of two people or more, no blocks of whole days."""
    return routing.meetings(derived(spark, sf_dir, "meetings"), F.to_date(F.lit("2024-01-15"))).select("event_id", "day")


@query(f"SELECT DISTINCT attendee FROM {duck('meetings')} WHERE attendee NOT IN (SELECT 'user' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0)")
def new_contacts(spark, sf_dir):
    """Attendees who have no page yet."""
    known = _read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("attendee"))
    return routing.new_contacts(derived(spark, sf_dir, "meetings"), known)


_MAIL = f"(SELECT * FROM {duck('threads')} WHERE NOT regexp_matches(lower(sender), 'noreply|no-reply|mailer-daemon|donotreply|forms-receipts|notifications') AND NOT contains(lower(subject), '[github]'))"


@query(f"""WITH m AS (SELECT * FROM {_MAIL}), p AS (SELECT person, count(DISTINCT thread_id) AS threads, bool_or(substantive) AS s FROM m WHERE person IS NOT NULL GROUP BY person), r AS (SELECT count(DISTINCT thread_id) AS threads FROM m WHERE person IS NULL)
    SELECT 'person' AS kind, person AS entity, threads FROM p WHERE threads >= 2 OR s OR person IN (SELECT 'q' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'catch-all', '', threads FROM r WHERE threads >= 2""")
def mail_clusters(spark, sf_dir):
    """The clusters that mail without noise gets pages for."""
    threads = derived(spark, sf_dir, "threads").where(~routing.is_mail_noise("sender", "subject"))
    known = _read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("person"))
    return routing.mail_clusters(threads, known)


@query("SELECT 'source' AS kind, 'doc-' || CAST(doc_id AS VARCHAR) AS title FROM documents UNION ALL SELECT 'topic', n_name FROM nation UNION ALL SELECT 'person', c_name FROM customer")
def wiki_index(spark, sf_dir):
    """Pages of all kinds in one list."""
    titles = lambda table, title: _read(spark, sf_dir, table).select(title.alias("title"))
    return pages.index_of({"source": titles("documents", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))), "topic": titles("nation", F.col("n_name")), "person": titles("customer", F.col("c_name"))})


_PLAIN = "coalesce(html, '')"
for _tag in ("<!--.*?-->", "<head[ >].*?</head>", "<style[ >].*?</style>", "<script[ >].*?</script>", "<[^>]*>"):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_tag}', chr(10), 'gs')"
_ENTITIES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _spelt(c: str) -> str:
    for a, b in _ENTITIES.items():
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query(f"""SELECT page_id, trim({_spelt("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title, CAST(len(ls) AS BIGINT) AS lines, md5(array_to_string(ls, chr(10))) AS text_md5
    FROM (SELECT page_id, html, list_filter(list_transform(string_split({_spelt(_PLAIN)}, chr(10)), lambda x: {o.strip('x')}), lambda x: x <> '') AS ls FROM pages)""")
def html_text_stats(spark, sf_dir):
    """Title, lines and digest of the visible text of each page."""
    rows = html_texts(_read(spark, sf_dir, "pages"))
    title = F.when(F.col("html").isNotNull(), F.col("html_title"))
    lines = F.when(F.col("html_text") == "", 0).otherwise(F.size(F.split("html_text", "\n")))
    return rows.select("page_id", title.alias("title"), lines.cast("long").alias("lines"), F.md5(F.col("html_text").cast("binary")).alias("text_md5"))


@query("SELECT md5(coalesce(text, '')) AS md5, min(CAST(doc_id AS VARCHAR)) AS filename FROM documents GROUP BY 1")
def ingest_stream(spark, sf_dir):
    """Documents taken in as a stream: each content once."""
    from ..storage import fresh_path
    from ..streaming.ingest import ingest

    schema = _read(spark, sf_dir, "documents").schema
    files = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents.parquet")
    out = fresh_path(spark, "ingest")
    ingest(files.select(F.col("doc_id").cast("string").alias("filename"), "text"), f"{out}/manifest", f"{out}/pages", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("md5 string, filename string, text string, batch long").parquet(f"{out}/pages").select("md5", "filename")


@query("SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Events by hour and type."""
    from ..streaming.ingest import windowed_counts

    return windowed_counts(_read(spark, sf_dir, "events"))


@query("""SELECT thread_id, sent_at, subject FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC, subject) AS k
    FROM (SELECT user_id AS thread_id, ts AS sent_at, CAST(event_id AS VARCHAR) AS subject FROM events WHERE event_type IN ('click', 'view')) WHERE sent_at >= TIMESTAMP '2024-01-10') WHERE k = 1""")
def mail_threads(spark, sf_dir):
    """The latest message of each thread of two folders."""
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), F.col("ts").alias("sent_at"), F.col("event_id").cast("string").alias("subject"), "event_type")
    box = lambda kind: rows.where(F.col("event_type") == kind).drop("event_type")
    return routing.mail_threads(box("click"), box("view"), F.to_timestamp(F.lit("2024-01-10")))


@query(f"""WITH q AS (SELECT doc_id, doc_id // 4 AS doc, len({o.tokens("coalesce(text, '')")}) AS w, length({o.rx(_DENSE, r'\P{L}')}) AS a, length({_DENSE}) AS n FROM documents),
    k AS (SELECT doc, doc_id, w >= 15 AND n > 0 AND a >= 0.45::DOUBLE * n AND n >= 2.0::DOUBLE * w AS ok FROM q), f AS (SELECT doc, min_by(ok, doc_id) AS first FROM k GROUP BY doc),
    e AS (SELECT doc, CASE WHEN first AND ok THEN 'quick' ELSE 'slow' END AS engine FROM k JOIN f USING (doc))
    SELECT doc, CASE WHEN min(engine) = max(engine) THEN min(engine) ELSE 'mixed' END AS method FROM e GROUP BY doc""")
def ocr_routing(spark, sf_dir):
    """The engine of each document of four pages."""
    rows = _documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 4).alias("doc"), F.col("doc_id").alias("page"), F.col("text").alias("quick"), F.col("source").alias("slow"))
    return routing.document_methods(routing.page_routes(rows))


from . import files, reconcile, summaries  # noqa: E402, F401  they register their queries
