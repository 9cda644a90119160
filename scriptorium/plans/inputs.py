"""Inputs that queries derive from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CAP = "upper(substring(split_part(p_name, ' ', {k}), 1, 1)) || substring(split_part(p_name, ' ', {k}), 2)"
_FULL = f"{_CAP.format(k=1)} || ' ' || {_CAP.format(k=2)}"

DERIVED = {
    # names as OCR leaves them, with the date and file of an issue
    "mentions": f"""
        SELECT idx, kind, CASE WHEN idx % 17 = 0 THEN 'Student ' || n WHEN idx % 13 = 0 THEN n || ' Arts' WHEN idx % 11 = 0 THEN substring(n, 1, length(n) - 1)
            WHEN idx % 7 = 0 THEN replace(n, 'l', '1') ELSE n END AS name, d AS doc_date, 'spec-' || CAST(d AS STRING) || '_djvu.txt' AS filename
        FROM (SELECT p_partkey AS idx, CASE WHEN p_partkey % 5 = 0 THEN 'places' ELSE 'people' END AS kind, {_FULL} AS n, DATE '1947-01-03' + CAST((p_partkey % 900) * 7 AS INT) AS d FROM {{part}})
    """,
    # what a tagger may hand over
    "tagged": f"""
        SELECT idx, CASE idx % 12 WHEN 0 THEN 'Dr. ' || n WHEN 1 THEN 'Mr. ' || s WHEN 2 THEN upper(n) WHEN 3 THEN '-' || n || ';' WHEN 4 THEN n || ' crushed Squires'
            WHEN 5 THEN 'Alma  Mater' WHEN 6 THEN n || ' van der Berg' WHEN 7 THEN n || ' One Two Three Four' WHEN 8 THEN s WHEN 9 THEN 'Prof. 1' || s WHEN 10 THEN 'Miss ' || s || ' 2nd' ELSE n END AS raw
        FROM (SELECT p_partkey AS idx, {_FULL} AS n, {_CAP.format(k=2)} AS s FROM {{part}})
    """,
    "places": f"""
        SELECT p_partkey AS idx, CASE p_partkey % 12 WHEN 0 THEN 'Clintqn' WHEN 1 THEN 'the ' || n WHEN 2 THEN lower(n) WHEN 3 THEN 'ARTS' WHEN 4 THEN 'Ut1ca' WHEN 5 THEN 'Campus'
            WHEN 6 THEN 'Commons Hall [moved from people - review]' WHEN 7 THEN 'Nation ' || CAST(p_size AS STRING) WHEN 8 THEN n || ' (Wis.)' WHEN 9 THEN 'the ' WHEN 10 THEN 'Root Hall' ELSE n END AS name,
            CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS n_files
        FROM (SELECT *, {_FULL} AS n FROM {{part}})
    """,
    # places as classification leaves them
    "kept_places": f"""
        SELECT name, min(idx) AS idx, CASE min(idx) % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'unresolved' ELSE 'campus' END AS lcsh_status, min(d) AS earliest_date, max(d) AS latest_date, count(*) AS n_files
        FROM (SELECT p_partkey AS idx, CASE p_partkey % 9 WHEN 0 THEN 'the ' || n WHEN 1 THEN n || ' (N.Y.)' WHEN 2 THEN n || ' Hall Road' WHEN 3 THEN substring(n, 1, length(n) - 1) WHEN 4 THEN replace(n, 'l', '1')
            WHEN 5 THEN {_CAP.format(k=1)} WHEN 6 THEN n || 's' ELSE n END AS name, DATE '1947-01-03' + CAST((p_partkey % 900) * 7 AS INT) AS d FROM (SELECT p_partkey, p_name, {_FULL} AS n FROM {{part}}) x) y
        GROUP BY name
    """,
    # what a tagger finds, label by label
    "tagger": f"""
        SELECT 'spec-' || CAST(DATE '1947-01-03' + CAST((idx % 900) * 7 AS INT) AS STRING) || '_djvu.txt' AS filename, CASE idx % 5 WHEN 0 THEN 'ORG' WHEN 1 THEN 'GPE' WHEN 2 THEN 'EVENT' WHEN 3 THEN 'DATE' ELSE 'PERSON' END AS label,
            CASE idx % 7 WHEN 0 THEN '& ' || n WHEN 1 THEN n || ' | x' WHEN 2 THEN n || ' 1234' WHEN 3 THEN 'ab ' || lower(n) WHEN 4 THEN '--' || n || ';;' WHEN 5 THEN 'Dean ' || n ELSE n END AS raw
        FROM (SELECT p_partkey AS idx, {_FULL} AS n FROM {{part}})
    """,
    # names of people, some of which are places
    "people_list": f"""
        SELECT idx, CASE idx % 6 WHEN 0 THEN n || ' Dormitory' WHEN 1 THEN n || ' Building ' WHEN 2 THEN 'Building ' || n WHEN 3 THEN 'Mc' || n ELSE n END AS name, CAST(1 + idx % 4 AS INT) AS n_files
        FROM (SELECT p_partkey AS idx, {_FULL} AS n FROM {{part}})
    """,
    "place_probes": f"""
        SELECT idx, CASE idx % 6 WHEN 0 THEN pref WHEN 1 THEN 'The ' || p_name || ' ' || CAST(idx % 50 AS STRING) WHEN 2 THEN 'Clinton' WHEN 3 THEN 'the ' || p_name || ', ' || p_type WHEN 4 THEN 'Q' || substring(p_name, 2) ELSE 'Ohio (State)' END AS name
        FROM (SELECT p_partkey AS idx, p_name, p_type, p_name || ' ' || CAST(p_partkey % 50 AS STRING) || ' (' || p_type || ')' AS pref FROM {{part}})
    """,
    "headings": "SELECT 'nation ' || CAST(n_nationkey AS STRING) AS key, 'Nation ' || CAST(n_nationkey AS STRING) || ' (Land)' AS heading, CAST(n_nationkey AS BIGINT) AS ord FROM {nation} UNION ALL SELECT 'clinton', 'Clinton (N.Y.)', 100 UNION ALL SELECT 'utica', 'Utica (N.Y.)', 101",
    "records": """
        SELECT CAST(p_partkey AS STRING) AS local_identifier, nullif(p_name, 'red widget') AS title, CASE WHEN p_size % 5 = 0 THEN 'thing' WHEN p_size % 7 = 0 THEN '' ELSE 'image' END AS type,
            p_brand AS genre, p_type AS subgenre_audiovisual_materials, p_type AS subgenre_ephemera, p_type AS subgenre_manuscripts, p_type AS subgenre_publications, p_type AS subgenre_visual_materials,
            CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_brand END AS ismemberof, p_name AS description, 'open' AS rights_statements,
            CASE p_size % 6 WHEN 0 THEN 'EN-us' WHEN 1 THEN 'xx' WHEN 2 THEN '' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'fr' END AS language,
            CASE WHEN p_size % 3 = 0 THEN p_name || ' van der o''neil' ELSE '' END AS personal_name, CASE WHEN p_size % 2 = 0 THEN ' smith, jane ' ELSE CAST(NULL AS STRING) END AS personal_name_author,
            CASE WHEN p_size % 8 = 0 THEN p_brand || ' & 3rd co.' ELSE '' END AS corporate_name, CASE WHEN p_size % 9 = 0 THEN '43,-75' ELSE '' END AS subject_cartographic_coordinates,
            CASE WHEN p_size % 10 = 0 THEN p_type ELSE '' END AS subject_geographic, CASE WHEN p_size % 11 = 0 THEN '{lat}' ELSE '' END AS geographic_location, CASE WHEN p_size % 2 = 1 THEN 'a.tif' ELSE '' END AS images
        FROM {part}
    """,
    "gazetteer": """
        SELECT s_suppkey AS row_no, CASE WHEN s_suppkey % 3 = 0 THEN 'Old  Forge' WHEN s_suppkey % 3 = 1 THEN 'OLD FORGE' ELSE 'Place ' || CAST(s_suppkey AS STRING) END AS feature_name,
            CASE WHEN s_suppkey % 10 = 9 THEN 'Airport' ELSE 'Populated Place' END AS feature_class, CASE s_nationkey % 4 WHEN 0 THEN 'New York' WHEN 1 THEN 'Ohio' WHEN 2 THEN 'Ontario' ELSE '' END AS state_name,
            CASE WHEN s_suppkey % 14 = 13 THEN '' ELSE CAST(40 + (s_suppkey % 70) / 10.0 AS STRING) END AS prim_lat_dec, CASE WHEN s_suppkey % 15 = 14 THEN 'n/a' ELSE CAST(-78 + (s_suppkey % 50) / 10.0 AS STRING) END AS prim_long_dec
        FROM {supplier}
    """,
    "labels_text": "SELECT idx, CASE idx % 8 WHEN 0 THEN s || ', ' || f || ', 1964-' WHEN 1 THEN 'de la ' || s || ', ' || f WHEN 2 THEN s || ', A.' WHEN 3 THEN s || ', 1920-1990' WHEN 4 THEN 'Workshop on ' || s || ', Tokyo' WHEN 5 THEN s || ', Sir' WHEN 6 THEN s || ' (firm), ' || f ELSE s || '-' || f || ', ' || f END AS label FROM (SELECT p_partkey AS idx, " + _CAP.format(k=2) + " AS s, " + _CAP.format(k=1) + " AS f FROM {part})",
    "variants": """
        SELECT ord, pref, CASE WHEN is_pref THEN pref ELSE 'the ' || p_name || ', ' || p_type END AS label, is_pref
        FROM (SELECT CAST(p_partkey AS BIGINT) AS ord, p_name || ' ' || CAST(p_partkey % 50 AS STRING) || ' (' || p_type || ')' AS pref, p_name, p_type, p_partkey % 2 = 0 AS is_pref FROM {part})
    """,
    "files": "SELECT p_partkey AS idx, CASE WHEN p_partkey % 6 = 0 THEN replace(p_name, ' ', '_') || '-2.txt' ELSE replace(p_name, ' ', '_') || '.pdf' END AS filename, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) || '.tif' AS image, p_size AS frames, p_size * 97 + 5 AS width, p_size * 53 + 11 AS height FROM {part}",
    "source_pages": "SELECT doc_id AS slug, '---' || chr(10) || 'title: \"Doc ' || CAST(doc_id AS STRING) || '\"' || chr(10) || 'lang: ' || coalesce(lang, '') || chr(10) || '# note' || chr(10) || 'kind: ''notes''' || chr(10) || '---' || chr(10) || '## Content' || chr(10) || chr(10) || coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN chr(10) || '## Related Topics' ELSE '' END AS body FROM {documents}",
    "answers": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"places\": [\"' || event_type || '\", \"b\", \"c\", \"d\"]}' WHEN 1 THEN '```json' || chr(10) || '{\"places\": [\"' || event_type || '\"]}' || chr(10) || '```' WHEN 2 THEN '{\"places\": []}' ELSE 'none' END AS raw FROM {events}",
    "tasks": "SELECT event_id AS gid, user_id AS project_gid, ts AS modified_at FROM {events} WHERE event_type <> 'view'",
    "comments": "SELECT event_id AS task_gid, CASE WHEN event_type = 'click' THEN 'system' ELSE 'comment' END AS type, 'https://app.asana.com/0/profile/' || CAST(user_id AS STRING) || ' note ' || CAST(event_id AS STRING) AS text, ts AS created_at FROM {events} WHERE user_id % 3 <> 0",
    "projects": "SELECT user_id AS gid, 'Project ' || CAST(user_id AS STRING) AS name, CASE WHEN user_id % 2 = 0 THEN 'on track' END AS status_text, max(ts) AS status_at FROM {events} GROUP BY user_id",
    "threads": "SELECT conv_id AS thread_id, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'p' || CAST(conv_id % 37 AS STRING) ELSE 'q' || CAST(conv_id AS STRING) END AS person, CASE WHEN conv_id % 5 = 0 THEN 'No-Reply@x' ELSE 'a@b' END AS sender, CASE WHEN conv_id % 7 = 0 THEN '[GitHub] x' ELSE 'Re: y' END AS subject, max(length(coalesce(text, ''))) > 300 AS substantive FROM {conversations} GROUP BY conv_id",
    "scans": "SELECT doc_id, CAST(floor(doc_id / 3) AS BIGINT) AS doc, doc_id % 3 AS page, CASE WHEN doc_id % 2 = 0 THEN text END AS quick, CASE WHEN doc_id % 5 < 3 THEN source END AS slow FROM {documents}",
    "archive": "SELECT doc_id AS identifier, CASE WHEN doc_id % 9 = 0 THEN 'audio' ELSE 'texts' END AS mediatype, CASE WHEN doc_id % 2 = 0 THEN text END AS djvu_text, CASE WHEN doc_id % 3 < 2 THEN substring(text, 1, 400) END AS pdf_text, CASE WHEN doc_id % 13 = 0 THEN 'broken' END AS pdf_error, CASE WHEN doc_id % 5 < 3 THEN source END AS ocr_text, 'tesseract' AS ocr_method FROM {documents}",
    "meetings": "SELECT event_id, CAST(ts AS DATE) AS day, CAST(event_id % 3 AS INT) AS n_attendees, event_id % 11 = 0 AS all_day, 'Weekly sync #' || CAST(event_id % 4 AS STRING) || CASE WHEN event_id % 2 = 0 THEN ' ' || event_type ELSE ' with user' || CAST(user_id AS STRING) END AS title, 'user' || CAST(user_id AS STRING) AS attendee FROM {events}",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _needs(sql: str) -> list[str]:
    known = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    return [n for n in known if "{" + n + "}" in sql]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = DERIVED[name].replace("'{lat}'", "concat(chr(123), 'lat', chr(125))").replace("'{\"places\"", "chr(123) || '\"places\"").replace("]}'", "]' || chr(125)")
    return spark.sql(sql, **tables(spark, sf_dir, *_needs(sql)))


def duck(name: str) -> str:
    """The same input as a subquery for DuckDB."""
    sql = DERIVED[name]
    for n in _needs(sql):
        sql = sql.replace("{" + n + "}", n)
    return f"({sql})"
