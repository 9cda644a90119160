"""Queries of summaries, orders, page parts, routes and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue_records as records
from ..operators import entities, ordering, pages, routing
from ..storage import fresh_path
from ..streaming import ingest
from . import oracle as o
from .catalogue import _DENSE, _FULL_FIELD, _IN, _VALIDATED
from .inputs import derived, duck
from .registry import query, read

# catalogue records


@query(f"""SELECT local_identifier, kind, position, message FROM (SELECT local_identifier, 'error' AS kind, unnest(e) AS message, unnest(range(len(e)))::INT AS position FROM ({_VALIDATED})
    UNION ALL SELECT local_identifier, 'warning', unnest(w), unnest(range(len(w)))::INT FROM ({_VALIDATED}))""")
def validation_details(spark, sf_dir):
    """Each error and warning of each record."""
    return records.details(records.validate(derived(spark, sf_dir, "records")))


_COUNTS = " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER ({_FULL_FIELD(f)}) * 100.0 / count(*) AS p FROM r" for f in sorted(_IN))


@query(f"WITH r AS MATERIALIZED (SELECT * FROM {duck('records')}) SELECT field, round(p, 6) AS percentage FROM ({_COUNTS}) ORDER BY p DESC, field LIMIT 10")
def top_fields(spark, sf_dir):
    """The ten fields that most records have."""
    return records.top_fields(records.profile(derived(spark, sf_dir, "records"))).select("field", F.round("percentage", 6).alias("percentage"))


@query(f"SELECT count(*) FILTER ({' AND '.join(_FULL_FIELD(f) for f in sorted(_IN))}) AS n FROM {duck('records')}")
def fully_populated(spark, sf_dir):
    """Records that have every field."""
    return records.fully_populated(derived(spark, sf_dir, "records").select(*sorted(_IN)))


@query("SELECT 'There are no restrictions on access to this resource.' AS restrictions_on_access, 'en' AS language, 'object' AS type, '' AS title")
def record_template(spark, sf_dir):
    """The blank record that a cataloguer fills in."""
    return records.template(spark).select("restrictions_on_access", "language", "type", "title")


# totals of runs


@query("SELECT count(*) AS calls, CAST(sum(length(coalesce(text, '')) // 4) AS BIGINT) AS tokens_in, CAST(500 * count(*) AS BIGINT) AS tokens_out, round(sum(length(coalesce(text, '')) // 4) / 1e6 * 3.0 + 500 * count(*) / 1e6 * 15.0, 6) AS cost FROM documents")
def usage_totals(spark, sf_dir):
    """Tokens and cost of a summary of every document."""
    calls = read(spark, sf_dir, "documents").select(pages.estimate_tokens("text").alias("tokens_in"), F.lit(500).cast("long").alias("tokens_out"))
    return pages.usage_totals(calls).withColumn("cost", F.round("cost", 6))


@query("SELECT count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 <> 0) AS processed, count(*) FILTER (doc_id % 3 = 0) AS skipped, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 = 0) AS errors FROM documents")
def run_counters(spark, sf_dir):
    """What a run processed, skipped and failed at."""
    items = read(spark, sf_dir, "documents").select((F.col("doc_id") % 3 == 0).alias("known"), F.when(F.col("doc_id") % 7 == 0, "failed").alias("error"))
    return pages.run_counters(items)


# orders


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY lower(c_name), c_custkey) - 1 AS position FROM customer")
def names_sorted(spark, sf_dir):
    """Names in order whatever their case, with their places."""
    return ordering.by_name(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey")


@query(f"SELECT gid, name, row_number() OVER (ORDER BY lower(name), gid) - 1 AS position FROM {duck('projects')}")
def projects_sorted(spark, sf_dir):
    """Projects from A to Z."""
    return ordering.by_name(derived(spark, sf_dir, "projects").select("gid", "name"), "name", "gid")


@query(f"SELECT image FROM {duck('files')} ORDER BY image LIMIT 50 OFFSET 25")
def file_slice(spark, sf_dir):
    """The files of one batch: places 25 to 74 of the sorted list."""
    return routing.file_slice(derived(spark, sf_dir, "files").select("image"), 25, 75, "image")


@query(f"SELECT local_identifier, title FROM {duck('records')} ORDER BY local_identifier LIMIT 10")
def preview(spark, sf_dir):
    """The first ten records."""
    return ordering.first_rows(derived(spark, sf_dir, "records").select("local_identifier", "title"), 10, F.col("local_identifier"))


# pages and prompts


@query("""SELECT doc_id, md5('--- Page 1 ---' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '--- Page 2 ---' || chr(10) || source) AS joined_md5 FROM documents""")
def page_join(spark, sf_dir):
    """Texts of pages under their numbers."""
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(pages.page_join(F.array(F.coalesce("text", F.lit("")), "source")).cast("binary")).alias("joined_md5"))


@query(f"""SELECT gid, '- [' || name || '](https://x/' || CAST(gid AS VARCHAR) || ')' || CASE WHEN gid % 3 = 0 THEN ' (Ann)' ELSE '' END || CASE WHEN gid % 2 = 0 THEN ' *(On Hold)*' ELSE '' END || chr(10) || '  - one' || chr(10) || '  - ' || name AS bullet FROM {duck('projects')}""")
def digest_bullets(spark, sf_dir):
    """Projects as lines of a digest."""
    rows = derived(spark, sf_dir, "projects")
    gid = F.col("gid")
    bullet = pages.digest_bullet(
        F.col("name"), F.concat(F.lit("https://x/"), gid.cast("string")), F.when(gid % 3 == 0, "Ann"), F.when(gid % 2 == 0, "On Hold").otherwise("In Progress"), F.concat(F.lit("one\n \n"), "name"), "In Progress"
    )
    return rows.select("gid", bullet.alias("bullet"))


@query(r"""SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'title: x' || chr(10) || 'last_updated: 2024-05-01' || chr(10) || 'tags: a' || chr(10) || '---' || chr(10) || 'NEW $1 \ ' || source || chr(10) || '<a>later</a>'
    WHEN 1 THEN '---' || chr(10) || 'title: x' || chr(10) || 'last_updated: 2024-05-01' || chr(10) || '---' || chr(10) || 'mine' || chr(10) || 'NEW $1 \ ' || source
    ELSE 'no marks' || chr(10) || chr(10) || '## Refreshed snapshot (2024-05-01)' || chr(10) || chr(10) || 'NEW $1 \ ' || source || chr(10) END) AS page_md5 FROM documents""")
def page_refresh(spark, sf_dir):
    """Pages with their automatic block renewed and their date set."""
    old = {0: "---\ntitle: x\nlast_updated: 2020-01-01\ntags: a\n---\n<a>old\nblock</a>\n<a>later</a>", 1: "---\ntitle: x\n---\nmine\n<a>old</a>", 2: "no marks\n\n"}
    kind = F.col("doc_id") % 3
    page = F.when(kind == 0, old[0]).when(kind == 1, old[1]).otherwise(old[2])
    fresh = pages.refresh(page, F.concat(F.lit("NEW $1 \\ "), "source"), "<a>", "</a>", F.lit("2024-05-01"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(fresh.cast("binary")).alias("page_md5"))


_TABLE = "array_to_string(list_transform(range({0}), lambda k: 'r' || CAST(k AS VARCHAR)), chr(10))"


@query(f"""SELECT p_partkey AS idx, md5('---' || chr(10) || 'title: "List ' || CAST(p_partkey AS VARCHAR) || '"' || chr(10) || 'type: "data"' || chr(10) || 'ingested: "2024-05-01"' || chr(10) || 'original_file: "list_' || CAST(p_partkey AS VARCHAR) || '.csv"' || chr(10) || 'tags:' || chr(10) || '  - structured-data' || chr(10) || '---' || chr(10) || chr(10) || '# List ' || CAST(p_partkey AS VARCHAR)
    || chr(10) || chr(10) || CAST(p_size AS VARCHAR) || ' records. Columns: `a`, `b`.' || chr(10) || chr(10) || '## Content' || chr(10) || chr(10) || CASE WHEN p_size > 25 THEN {_TABLE.format(26)} || chr(10) || chr(10) || '*[Preview: first 25 of ' || CAST(p_size AS VARCHAR) || ' records shown.]*' ELSE {_TABLE.format('p_size + 1')} END || chr(10)) AS page_md5 FROM part""")
def table_pages(spark, sf_dir):
    """Pages around the first records of tables."""
    name = F.concat(F.lit("list_"), F.col("p_partkey").cast("string"), F.lit(".csv"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size").cast("int")), lambda k: F.concat(F.lit("r"), k.cast("string"))), "\n")
    page = routing.table_page(name, text, F.array(F.lit("a"), F.lit("b")), F.col("p_size"), F.lit("2024-05-01"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.md5(page.cast("binary")).alias("page_md5"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 3 END AS n, md5(CASE WHEN doc_id % 4 = 0 THEN '{routing.WHOLE_PROMPT.replace("{text}", "").strip()}' || chr(10) || chr(10) || source || ' {{n}}'
    ELSE 'This is part 2 of 3 of a transcript. Write a summary of this part and nothing else.' || chr(10) || chr(10) || 'b' || source END) AS prompt_md5 FROM documents""")
def summary_prompts(spark, sf_dir):
    """The number of prompts for a text's chunks, and the one in the middle."""
    chunks = F.when(F.col("doc_id") % 4 == 0, F.array(F.concat("source", F.lit(" {n}")))).otherwise(F.array(F.lit("a"), F.concat(F.lit("b"), "source"), F.lit("c")))
    asked = read(spark, sf_dir, "documents").select("doc_id", routing.prompts(chunks).alias("p"))
    return asked.select("doc_id", F.size("p").alias("n"), F.md5(F.element_at("p", ((F.size("p") + 1) / 2).cast("int")).cast("binary")).alias("prompt_md5"))


@query("""SELECT n_nationkey, 'data:' || CASE n_nationkey % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'application/pdf' ELSE 'application/octet-stream' END || ';base64,' || to_base64(encode(n_name)) AS url,
    CAST(greatest(1.0, n_nationkey * 0.75) AS DOUBLE) AS font_size, CAST(10.0 + n_nationkey AS DOUBLE) AS right_edge, strftime(DATE '2024-01-01' + CAST(n_nationkey AS INT) * 16, '%B %-d, %Y') AS day FROM nation""")
def page_parts(spark, sf_dir):
    """Data URLs, boxes of lines and dates as pages have them."""
    k = F.col("n_nationkey")
    name = F.concat(F.lit("a."), F.when(k % 3 == 0, "JPG").when(k % 3 == 1, "pdf").otherwise("zzz"))
    box = routing.bounding_box(F.lit(10.0), F.lit(0.0), k.cast("double"), k.cast("double"))
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (k * 16).cast("int"))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", routing.data_url(name, F.col("n_name").cast("binary")).alias("url"), box.alias("b"), routing.long_date(day).alias("day"))
    return rows.select("n_nationkey", "url", F.col("b.font_size").alias("font_size"), F.col("b.bbox")[2].alias("right_edge"), "day")


# routes


@query(f"SELECT doc, page, CASE WHEN quick IS NOT NULL THEN 'quick' WHEN slow IS NOT NULL THEN 'slow' ELSE 'failed' END AS engine, md5(coalesce(quick, slow, 'OCR Failed.')) AS text_md5 FROM {duck('scans')}")
def page_texts(spark, sf_dir):
    """The text of each page by the engine that has one, or a page that says that none has."""
    rows = routing.page_texts(derived(spark, sf_dir, "scans"))
    return rows.select("doc", "page", "engine", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH q AS (SELECT *, {_DENSE.replace("coalesce(text, '')", "coalesce(djvu_text, '')")} AS dense FROM {duck('archive')}),
    r AS (SELECT *, djvu_text IS NOT NULL AND len({o.tokens("coalesce(djvu_text, '')")}) >= 100 AND length(dense) > 0 AND length({o.rx('dense', r'\P{L}')})::DOUBLE / nullif(length(dense), 0) >= 0.4 AS good,
        pdf_text IS NOT NULL AND length({o.rx("coalesce(pdf_text, '')", '[ \n\t]')}) >= 100 AS layer FROM q)
    SELECT identifier, CASE WHEN mediatype <> 'texts' THEN NULL WHEN good THEN 'ia-tesseract' WHEN pdf_error IS NOT NULL THEN NULL WHEN layer THEN 'pdfminer' WHEN ocr_text IS NOT NULL THEN ocr_method END AS source,
        CASE WHEN mediatype <> 'texts' THEN 'no texts item' WHEN good THEN 'archive text' WHEN pdf_error IS NOT NULL THEN 'extraction failed' WHEN layer THEN 'text layer' WHEN ocr_text IS NOT NULL THEN 'OCR' ELSE 'nothing readable' END AS reason FROM r""")
def archive_routes(spark, sf_dir):
    """How the text of each item of an archive is got."""
    return routing.archive_route(derived(spark, sf_dir, "archive")).select("identifier", "source", "reason")


_ROUTED = "CASE p_partkey % 6 WHEN 0 THEN 'a-hw.pdf' WHEN 1 THEN 'a.PDF' WHEN 2 THEN 'b-Handwritten.jpg' WHEN 3 THEN 'b.tif' WHEN 4 THEN 'c.docx' ELSE 'd-written.pdf' END"


@query("""SELECT p_partkey AS idx, CASE p_partkey % 6 WHEN 2 THEN 'handwritten' WHEN 3 THEN 'print' WHEN 4 THEN 'native' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'print' ELSE 'native_pdf' END ELSE CASE WHEN p_size % 2 = 0 THEN 'handwritten' ELSE 'native_pdf' END END AS route FROM part""")
def content_routes(spark, sf_dir):
    """How the text of each file is got, by its name and whether it is a scan."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.expr(_ROUTED).alias("name"), (F.col("p_size") % 2 == 0).alias("scan"))
    return rows.select("idx", routing.content_route("name", F.col("scan")).alias("route"))


@query("""WITH p AS (SELECT c_custkey AS gid, CASE c_custkey % 4 WHEN 0 THEN ' Done ' WHEN 1 THEN 'Active' WHEN 2 THEN NULL ELSE 'On hold' END AS c FROM customer)
    SELECT 'active' AS kind, c AS category, count(*) AS n FROM p WHERE trim(coalesce(c, '')) <> '' AND lower(trim(c)) NOT IN ('done') GROUP BY c UNION ALL SELECT 'skipped', lower(trim(coalesce(c, ''))), count(*) FROM p WHERE trim(coalesce(c, '')) = '' OR lower(trim(c)) = 'done' GROUP BY 2""")
def active_projects(spark, sf_dir):
    """Projects by category, and those left out."""
    kind = F.col("c_custkey") % 4
    value = F.when(kind == 0, " Done ").when(kind == 1, "Active").when(kind == 3, "On hold")
    fields = F.array(F.struct(F.lit("other").alias("name"), F.lit("x").alias("display_value")), F.struct(F.lit("Category").alias("name"), value.alias("display_value")))
    active, skipped = routing.active_projects(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gid"), fields.alias("custom_fields")), "Category", ["Done"])
    counted = active.groupBy("category").agg(F.count("*").alias("n")).select(F.lit("active").alias("kind"), "category", "n")
    return counted.unionByName(skipped.select(F.lit("skipped").alias("kind"), "category", F.col("skipped").alias("n")))


@query(f"SELECT series, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM (SELECT day, trim(regexp_replace(regexp_replace(lower(title), '[\\d/.:#-]+', ' ', 'g'), ' +', ' ', 'g')) AS series FROM {duck('meetings')}) GROUP BY series HAVING count(*) >= 2")
def meeting_series(spark, sf_dir):
    """Meetings that come again."""
    return routing.recurring_series(derived(spark, sf_dir, "meetings")).select("series", "n", "first_day", "last_day")


# state


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'created' WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'updated' ELSE 'kept' END AS action,
    CASE WHEN doc_id % 2 = 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 0) THEN 'new' ELSE 'old' END AS seen FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def page_upsert(spark, sf_dir):
    """Pages after a refresh: unchanged ones are kept as they were."""
    docs = read(spark, sf_dir, "documents")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    state = docs.where("doc_id % 3 <> 0").select("doc_id", digest.alias("digest"), F.lit("old").alias("seen"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.lit("changed")).otherwise(digest)
    fresh = docs.where("doc_id % 2 = 0").select("doc_id", changed.alias("digest"), F.lit("new").alias("seen"))
    return ingest.upsert(state, fresh, "doc_id", "digest").select("doc_id", "action", "seen")


@query("SELECT filename, CAST(n AS BIGINT) AS n FROM (SELECT source AS filename, count(*) - count(*) FILTER (doc_id % 2 = 0) AS n FROM documents GROUP BY source) WHERE n > 0")
def new_files(spark, sf_dir):
    """Files of a listing that an earlier one has not."""
    listing = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename"))
    fresh = ingest.new_files(listing.where("doc_id % 2 = 0").select("filename"), listing.select("filename"))
    return fresh.groupBy("filename").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'page' END AS kind, min(CAST(doc_id AS VARCHAR)) AS filename FROM documents GROUP BY doc_id % 7 = 0, CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id AS VARCHAR) ELSE coalesce(text, '') END""")
def quarantine_stream(spark, sf_dir):
    """Documents taken in as a stream, those that fail put aside and never tried again."""
    schema = read(spark, sf_dir, "documents").schema
    out = fresh_path(spark, "quarantine")

    def run(name: str) -> None:
        files = ingest.file_stream(spark, f"{sf_dir}/documents.parquet", schema, "parquet")
        rows = files.select(F.col("doc_id").cast("string").alias("filename"), "text", F.when(F.col("doc_id") % 7 == 0, "unreadable").alias("error"))
        ingest.ingest(rows, f"{out}/manifest", f"{out}/pages", f"{out}/checkpoint", failed=f"{out}/failed").awaitTermination()

    run("first")
    run("second")  # all is known: nothing is added
    kept = spark.read.schema("md5 string, filename string, text string, batch long").parquet(f"{out}/pages").select(F.lit("page").alias("kind"), "filename")
    return kept.unionByName(spark.read.schema("md5 string, filename string, error string, batch long").parquet(f"{out}/failed").select(F.lit("failed").alias("kind"), "filename"))


@query(f"SELECT kind, token, n FROM (SELECT 'files' AS kind, filename AS token, count(DISTINCT name) AS n FROM {duck('mentions')} GROUP BY filename)")
def file_entities(spark, sf_dir):
    """How many entities each file has, from the long form of the rollup."""
    rows = entities.rollup_long(derived(spark, sf_dir, "mentions"), ["name"])
    return rows.groupBy(F.col("filename").alias("token")).agg(F.count("*").alias("n")).select(F.lit("files").alias("kind"), "token", "n")
