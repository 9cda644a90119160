"""Queries that write tables in the formats of files, read these back, and show what came."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import pages
from ..session import ship
from ..sources import paged, readers, sinks
from ..storage import fresh_path
from .inputs import derived, duck
from .registry import query, read


def _zipped(members: list[str]):
    """A UDF: texts as members of a zip file."""

    def of(texts: list[str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in zip(members, texts):
                z.writestr(zipfile.ZipInfo(name), text or "")
        return out.getvalue()

    return F.udf(of, "binary")


_FIELDS = [f for f in "local_identifier title type genre ismemberof description language personal_name corporate_name images".split()]


@query("SELECT " + ", ".join(f"coalesce({f}, '') AS {f}" for f in _FIELDS) + f" FROM {duck('records')}")
def csv_round_trip(spark, sf_dir):
    """Catalogue records as a CSV with all cells in quotes, read back as strings."""
    path = fresh_path(spark, "csv")
    sinks.write_csv(derived(spark, sf_dir, "records").select(*_FIELDS), path, quote_all=True)
    back = readers.strings_csv(spark, path, _FIELDS)
    return back.select(*(F.coalesce(f, F.lit("")).alias(f) for f in _FIELDS))


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, o_orderpriority FROM orders")
def csv_typed(spark, sf_dir):
    """Orders as a CSV, read back with the types that its cells have."""
    path = fresh_path(spark, "csv")
    sinks.write_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority"), path)
    found = readers.typed_csv(spark, path, line_breaks=False)
    return found.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_totalprice", "o_orderpriority")


@query("SELECT n_name, r_name, CAST(n_nationkey AS VARCHAR) AS key FROM nation JOIN region ON n_regionkey = r_regionkey")
def tsv_report(spark, sf_dir):
    """A report parted by tabs, and back."""
    path = fresh_path(spark, "tsv")
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sinks.write_tsv(rows.select("n_name", "r_name", F.col("n_nationkey").alias("key")), path)
    return readers.strings_csv(spark, path, ["n_name", "r_name", "key"], sep="\t")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'note \"' || n_name || '\"' END AS note FROM nation")
def json_array_round_trip(spark, sf_dir):
    """A report as one indented JSON array, and back."""
    path = fresh_path(spark, "json")
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit('note "'), "n_name", F.lit('"'))).alias("note"))
    sinks.write_json_array(rows, path)
    return readers.json_records(spark, path, "n_nationkey long, n_name string, note string")


@query(f"SELECT kind, name, filename, count(*) AS n FROM (SELECT DISTINCT kind, name, filename, idx % 3 AS chunk FROM {duck('mentions')}) GROUP BY ALL")
def checkpoint_scan(spark, sf_dir):
    """Partial results of three chunks as JSON checkpoints, and back."""
    path = fresh_path(spark, "checkpoints")
    rows = derived(spark, sf_dir, "mentions").withColumn("chunk", F.col("idx") % 3)
    names = rows.groupBy("chunk", "kind", "name").agg(F.struct(F.array_sort(F.collect_set(F.col("doc_date").cast("string"))).alias("dates"), F.array_sort(F.collect_set("filename")).alias("files")).alias("x"))
    kinds = names.groupBy("chunk", "kind").agg(F.map_from_entries(F.collect_list(F.struct("name", "x"))).alias("names"))
    chunks = kinds.groupBy("chunk").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("kind", "names")))).alias("text"))
    sinks.write_files(chunks.select(F.concat(F.lit("chunk_"), F.col("chunk").cast("string"), F.lit(".json")).alias("filename"), "text"), path)
    return readers.checkpoints(spark, path).groupBy("kind", "name", "filename").agg(F.count("*").alias("n"))


_COLUMNS = ["feature_name", "feature_class", "state_name", "prim_lat_dec", "prim_long_dec"]


@query(f"SELECT feature_name || CASE WHEN row_no % 5 = 0 THEN ' \"Old\"' ELSE '' END AS feature_name, feature_class, state_name, TRY_CAST(prim_lat_dec AS DOUBLE) AS lat, TRY_CAST(prim_long_dec AS DOUBLE) AS lon FROM {duck('gazetteer')}")
def gazetteer_zip(spark, sf_dir):
    """A gazetteer as zipped lines parted by bars, one file a state, and back."""
    ship(spark)
    path = fresh_path(spark, "gazetteer")
    rows = derived(spark, sf_dir, "gazetteer").withColumn("feature_name", F.when(F.col("row_no") % 5 == 0, F.concat("feature_name", F.lit(' "Old"'))).otherwise(F.col("feature_name")))
    quoted = F.concat(F.lit('"'), F.replace("feature_name", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws("|", F.col("row_no").cast("string"), quoted, *_COLUMNS[1:])
    files = rows.groupBy("state_name").agg(F.concat(F.lit("feature_id|" + "|".join(_COLUMNS) + "\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    packed = files.select(F.concat(F.xxhash64("state_name").cast("string"), F.lit(".zip")).alias("filename"), _zipped(["Text/g.txt"])(F.array("text")).alias("content"))
    sinks.write_files(packed, path, content="content")
    back = readers.gazetteer(spark, path, "Text/g.txt")
    return back.select("feature_name", "feature_class", "state_name", F.expr("try_cast(prim_lat_dec AS double)").alias("lat"), F.expr("try_cast(prim_long_dec AS double)").alias("lon"))


def _record(pref, alt, kind: str):
    """A JSON-LD line of an authority record."""
    notation = F.struct(F.lit(kind).alias("@type"), F.lit("x").alias("@value"))
    graph = F.array(F.struct(F.concat(F.lit(readers.AUTHORITY + "n"), F.col("ord").cast("string")).alias("@id"), pref.alias("skos:prefLabel"), alt.alias("skos:altLabel"), notation.alias("skos:notation")))
    return F.to_json(F.struct(graph.alias("@graph")))


_ALT = "CASE WHEN ord % 2 = 0 THEN 'the ' || pref END"


@query(f"""SELECT pref, label, is_pref, count(*) AS n FROM (SELECT pref, pref AS label, true AS is_pref FROM {duck('variants')} WHERE ord % 5 <> 0
    UNION ALL SELECT pref, {_ALT}, false FROM {duck('variants')} WHERE ord % 5 <> 0 AND {_ALT} IS NOT NULL) GROUP BY ALL""")
def jsonld_geographic(spark, sf_dir):
    """Geographic authority records as JSON-LD lines among others, and their labels."""
    path = fresh_path(spark, "jsonld")
    rows = derived(spark, sf_dir, "variants")
    alt = F.array_compact(F.array(F.when(F.col("ord") % 2 == 0, F.concat(F.lit("the "), "pref"))))
    plain = _record(F.col("pref"), alt, readers.GEOGRAPHIC)
    spoken = _record(F.struct(F.lit("en").alias("@language"), F.col("pref").alias("@value")), alt, readers.GEOGRAPHIC)
    other = _record(F.col("pref"), alt, "other")
    rows.select(F.when(F.col("ord") % 5 == 0, other).when(F.col("ord") % 3 == 0, spoken).otherwise(plain).alias("value")).write.text(path)
    return readers.authority_labels(spark, path).groupBy("pref", "label", "is_pref").agg(F.count("*").alias("n"))


@query(f"SELECT label, count(*) AS n FROM (SELECT label || ' é' AS label FROM {duck('labels_text')}) WHERE instr(label, ',') BETWEEN 1 AND 120 GROUP BY label")
def jsonld_personal(spark, sf_dir):
    """Personal authority records as JSON-LD lines with escapes, and their labels."""
    path = fresh_path(spark, "jsonld")
    rows = derived(spark, sf_dir, "labels_text").select(F.col("idx").alias("ord"), F.concat("label", F.lit(" é")).alias("pref"))
    line = F.replace(_record(F.col("pref"), F.array(F.lit("x")), "other"), F.lit("é"), F.lit("\\u00e9"))
    rows.select(line.alias("value")).write.text(path)
    return readers.personal_labels(spark, path).groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT heading, count(*) AS n FROM {duck('headings')} GROUP BY heading")
def authority_list_scan(spark, sf_dir):
    """A flat list of headings with comments and blank lines, and back."""
    path = fresh_path(spark, "list")
    rows = derived(spark, sf_dir, "headings")
    lines = F.array(F.concat(F.lit("  "), "heading", F.lit("\t")), F.concat(F.lit("# "), "key"), F.lit(""))
    rows.select(F.explode(lines).alias("value")).write.text(path)
    return readers.authority_list(spark, path).groupBy("heading").agg(F.count("*").alias("n"))


@query("SELECT 'id-' || CAST(c_custkey AS VARCHAR) AS identifier FROM customer")
def identifiers_scan(spark, sf_dir):
    """Identifiers in the first column of a CSV with a header, and back."""
    path = fresh_path(spark, "identifiers")
    line = F.concat(F.lit('"id-'), F.col("c_custkey").cast("string"), F.lit('",'), "c_name")
    rows = read(spark, sf_dir, "customer").select(line.alias("value"))
    rows.unionByName(spark.range(1).select(F.lit("Identifier,name").alias("value"))).write.text(path)
    return readers.identifiers(spark, path)


_ISSUE = "CASE doc_id % 3 WHEN 0 THEN 'spec-' || CAST(doc_id AS STRING) || '.txt' WHEN 1 THEN CAST(doc_id AS STRING) || '_djvu.txt' ELSE CAST(doc_id AS STRING) || '.txt' END"


@query(f"SELECT {_ISSUE} AS filename, md5(coalesce(text, '')) AS md5 FROM documents WHERE doc_id % 3 < 2")
def issues_scan(spark, sf_dir):
    """A text file for each document, and those files that are OCR of an issue read back."""
    path = fresh_path(spark, "texts")
    sinks.write_files(read(spark, sf_dir, "documents").select(F.expr(_ISSUE).alias("filename"), "text"), path)
    return readers.issues(spark, path).select("filename", F.md5(F.col("text").cast("binary")).alias("md5"))


_DOCX = '<w:document xmlns:w="w"><w:p><w:r><w:t>{0}</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>by {1}</w:t></w:r></w:p></w:document>'
_CORE = '<c:coreProperties xmlns:c="c" xmlns:dc="d"><dc:title>T{0}</dc:title><dc:creator>{1}</dc:creator></c:coreProperties>'
_ODT = '<o:document xmlns:o="o" xmlns:t="t"><t:h>{0}</t:h><t:p>by <t:span>{1}</t:span></t:p></o:document>'
_META = '<o:meta xmlns:o="o" xmlns:dc="d" xmlns:m="m"><dc:title>T{0}</dc:title><m:initial-creator>{1}</m:initial-creator></o:meta>'
_TYPES = ["txt", "md", "csv", "html", "eml", "docx", "odt", "pdf", "xyz"]


def _filled(template: str):
    """A template with {0} for the number of a document and {1} for its source."""
    before, rest = template.split("{0}")
    middle, after = rest.split("{1}")
    return F.concat(F.lit(before), F.col("n"), F.lit(middle), "source", F.lit(after))


def _uploads(spark, sf_dir):
    """path, filename, ext, content: files of all kinds below a folder, hidden and failed ones among them."""
    ship(spark)
    path = fresh_path(spark, "uploads")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("n"), "source", F.element_at(F.array(*(F.lit(x) for x in _TYPES)), (F.col("doc_id") % 9 + 1).cast("int")).alias("ext"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    of = lambda *kinds: docs.where(F.col("ext").isin(*kinds))
    where = F.when(F.col("doc_id") % 5 == 0, "failed/").when(F.col("doc_id") % 7 == 0, "sub/.").otherwise("sub/")
    name = F.concat(where, F.col("n"), F.lit("."), F.col("ext")).alias("filename")
    as_bytes = lambda c: c.cast("binary").alias("content")
    plain = of("txt", "md", "xyz").select(name, as_bytes(F.col("text")))
    table = of("csv").select(name, as_bytes(_filled('id,kind\n\n{0}," a, {1} "\n,\n')))
    web = of("html").select(name, as_bytes(_filled("<html><head><title>T{0}</title><style>p{}</style></head><body><p>one</p><script>x()</script>by {1}</body></html>")))
    mail = of("eml").select(name, as_bytes(_filled('Subject: T{0}\nFrom: {1}@x\nContent-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/plain; charset=utf-8\n\n  one \n--q\nContent-Type: text/plain\n\n  \n--q\nContent-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\n\nno\n--q--\n')))
    word = of("docx").select(name, _zipped(["word/document.xml", "docProps/core.xml"])(F.array(_filled(_DOCX), _filled(_CORE))).alias("content"))
    open_text = of("odt").select(name, _zipped(["content.xml", "meta.xml"])(F.array(_filled(_ODT), _filled(_META))).alias("content"))
    line = lambda text, top: F.struct(text.alias("text"), F.lit(10.0).alias("left"), F.lit(top).alias("top"), F.lit(200.0).alias("width"), F.lit(16.0).alias("height"))
    page = F.array(line(F.concat(F.lit("Page ("), "n", F.lit(")")), 10.0), line(F.concat(F.lit("by "), "source"), 30.0))
    scans = sinks.searchable_pages(of("pdf").select(name, F.concat(F.lit("T"), "n").alias("title"), F.array(page, page).alias("pages")))
    sinks.write_files(reduce(DataFrame.unionByName, (plain, table, web, mail, word, open_text, scans)), path, content="content")
    return readers.ingest_files(spark, path, [*readers.EXTRACTORS, "xyz"])


_N = "CAST(doc_id AS VARCHAR)"
_EXT = "CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_TYPES)) + " END"
_BODY = f"""CASE doc_id % 9 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN coalesce(text, '') WHEN 2 THEN 'id | kind' || chr(10) || {_N} || ' | a, ' || source WHEN 3 THEN 'one' || chr(10) || 'by ' || source
    WHEN 4 THEN 'one' WHEN 5 THEN {_N} || chr(10) || chr(10) || 'by ' || source WHEN 6 THEN {_N} || chr(10) || chr(10) || 'by ' || source
    WHEN 7 THEN repeat('Page (' || {_N} || ')' || chr(10) || 'by ' || source || chr(10) || chr(12), 2) END"""
_ABOUT = f"""CASE doc_id % 9 WHEN 2 THEN 'columns=id, kind;row_count=3' WHEN 3 THEN 'title=T' || {_N} WHEN 4 THEN 'from=' || source || '@x;subject=T' || {_N}
    WHEN 5 THEN 'author=' || source || ';title=T' || {_N} WHEN 6 THEN 'author=' || source || ';title=T' || {_N} WHEN 7 THEN 'title=T' || {_N} ELSE '' END"""


@query(f"""SELECT {_N} || '.' || {_EXT} AS filename, {_EXT} AS type, md5({_BODY}) AS text_md5, {_ABOUT} AS about,
    CASE WHEN doc_id % 9 = 8 THEN 'unsupported type: xyz' END AS error, doc_id % 9 = 7 AS is_scan FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def extract_uploads(spark, sf_dir):
    """Text and properties of files of all kinds, as an ingest finds them."""
    found = readers.extract(_uploads(spark, sf_dir))
    about = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("filename", "type", F.md5(F.col("text").cast("binary")).alias("text_md5"), about.alias("about"), "error", "is_scan")


@query("SELECT event_type, user_id, 'user | kind | event' || chr(10) || string_agg(CAST(user_id AS VARCHAR) || ' | ' || event_type || ' | ' || CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id) AS text, CAST(count(*) AS VARCHAR) AS row_count FROM events GROUP BY event_type, user_id")
def csv_pipe_text(spark, sf_dir):
    """A CSV of each user's events of a type as lines of text."""
    line = F.concat_ws(",", F.col("user_id").cast("string"), F.concat(F.lit('" '), "event_type", F.lit(' "')), F.col("event_id").cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"])
    files = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.concat(F.lit("user,kind,event\n"), F.array_join(lines, "\n")).alias("text"))
    files = files.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("path"), F.lit("t.csv").alias("filename"), F.lit("csv").alias("ext"), F.col("text").cast("binary").alias("content"))
    found = readers.extract(files)
    at = F.split("path", "/")
    return found.select(at[0].alias("event_type"), at[1].cast("long").alias("user_id"), "text", F.col("metadata")["row_count"].alias("row_count"))


_IMAGE = "'Img_' || CAST(n_nationkey AS STRING) || CASE n_nationkey % 8 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.TIF' WHEN 3 THEN '.tiff' WHEN 4 THEN '.gif' WHEN 5 THEN '.pdf' WHEN 6 THEN '.webp' ELSE '.txt' END"
_LISTS = {"tiff": ("tif", "tiff"), "photo": ("jpg", "jpeg", "png"), "scan": ("jpg", "jpeg", "png", "gif", "webp", "pdf")}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS list, {_IMAGE} AS filename FROM nation WHERE lower(split_part({_IMAGE}, '.', 2)) IN {ends}" for kind, ends in _LISTS.items()))
def image_lists(spark, sf_dir):
    """The files that each tool for images takes, whatever the case of their extension."""
    path = fresh_path(spark, "images")
    sinks.write_files(read(spark, sf_dir, "nation").select(F.expr(_IMAGE).alias("filename"), F.lit("x").alias("text")), path)
    parts = [readers.images(spark, path, ends).select(F.lit(kind).alias("list"), "filename") for kind, ends in _LISTS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT CAST(slug AS VARCHAR) || '.md' AS filename, md5(body) AS md5 FROM {duck('source_pages')}")
def pages_sink(spark, sf_dir):
    """A Markdown file for each page, and back."""
    path = fresh_path(spark, "pages")
    sinks.write_pages(derived(spark, sf_dir, "source_pages"), path)
    return readers.text_documents(spark, path, "*.md").select("filename", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("SELECT n_name AS name, r_name AS place_1, '' AS place_2, '' AS place_3 FROM nation JOIN region ON n_regionkey = r_regionkey")
def append_rows(spark, sf_dir):
    """Rows put behind those of an earlier run, in a CSV with one header and three slots."""
    path = fresh_path(spark, "appended")
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    slots = pages.place_slots(F.to_json(F.struct(F.array("r_name").alias("places"))))
    rows = rows.select(F.col("n_name").alias("name"), "n_nationkey", *(slots[k].alias(f"place_{k + 1}") for k in range(3)))
    for part in (rows.where("n_nationkey < 10"), rows.where("n_nationkey >= 10")):
        sinks.append_csv(part.drop("n_nationkey"), path)
    back = spark.read.csv(path, schema="name string, place_1 string, place_2 string, place_3 string", quote='"', escape='"').where("name <> 'name'")
    return back.select("name", *(F.coalesce(f"place_{k}", F.lit("")).alias(f"place_{k}") for k in (1, 2, 3)))


@query("SELECT " + ", ".join(f"'{f}' AS c{k}" for k, f in enumerate(values.FIELDS[:5])) + f", {len(values.FIELDS)} AS n_fields, (SELECT count(*) FROM part) AS n_rows")
def export_order(spark, sf_dir):
    """The first columns of an export, which come in the order of the schema."""
    from ..operators.catalogue_records import ordered_for_export

    out = ordered_for_export(derived(spark, sf_dir, "records"))
    names = out.columns
    return out.agg(*(F.lit(names[k]).alias(f"c{k}") for k in range(5)), F.lit(len([c for c in names if c in values.FIELDS])).alias("n_fields"), F.count("*").alias("n_rows"))


@query("""WITH r AS (SELECT c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT CAST(c_nationkey AS VARCHAR) AS portfolio, CAST(k - 1 AS INT) AS place, c_custkey AS gid, c_name AS name, n > 50 AS truncated FROM r WHERE k <= 50""")
def portfolio_pages(spark, sf_dir):
    """Items of portfolios, exported in pages of 20 and followed from page to page, 50 of a portfolio at most."""
    at = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = read(spark, sf_dir, "customer").select("c_nationkey", F.floor(at / 20).alias("page"), F.struct(F.col("c_custkey").alias("gid"), F.col("c_name").alias("name")).alias("item"))
    found = rows.groupBy("c_nationkey", "page").agg(F.array_sort(F.collect_list("item")).alias("data"))
    last = F.max("page").over(Window.partitionBy("c_nationkey"))
    following = F.when(F.col("page") < last, F.struct((F.col("page") + 1).cast("string").alias("offset"))).alias("next_page")
    path = fresh_path(spark, "portfolios")
    named = F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), F.col("page").cast("string"), F.lit(".json"))
    sinks.write_files(found.select(named.alias("filename"), F.to_json(F.struct("data", following)).alias("text")), path).count()
    keys = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("gid")).distinct()
    got = paged.paged(keys, paged.exported(path), "gid long, name string", page=20, cap=50)
    return got.select(F.col("parent").alias("portfolio"), F.col("at").alias("place"), "item.gid", "item.name", "truncated")


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'audio' ELSE 'texts' END AS mediatype, doc_id % 2 = 0 AS has_text, 'item' || CAST(doc_id AS VARCHAR) || '.pdf' AS pdf_name
    FROM documents WHERE doc_id % 5 <> 0""")
def archive_items(spark, sf_dir):
    """What an archive says of its items; of every fifth it says nothing."""
    name = F.concat(F.lit("item"), F.col("doc_id").cast("string"))
    files = F.array(F.struct(F.concat(name, F.when(F.col("doc_id") % 2 == 0, "_djvu.txt").otherwise(".jp2")).alias("name"), F.lit("x").alias("format")))
    about = F.struct(F.struct(F.when(F.col("doc_id") % 9 == 0, "audio").otherwise("texts").alias("mediatype")).alias("metadata"), files.alias("files"))
    rows = read(spark, sf_dir, "documents").select("doc_id", name.alias("identifier"), F.when(F.col("doc_id") % 5 != 0, F.to_json(about)).alias("meta"))
    return rows.withColumn("x", paged.archive_item("identifier", "meta")).where("x is not null").select("doc_id", "x.*")
