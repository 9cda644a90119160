"""Routes of files and pages to engines, page texts and prompts around models, and selections of connectors' rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, file_stem, strip, title_case
from ..session import ship
from .cleaning import document_ok, is_scan, page_ok
from .ordering import between

# MIME types by extension, rows and lines of a preview.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "pdf": "application/pdf"}
CSV_ROWS, TEXT_LINES = 25, 100


def extension(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(name), r"\.([^./]+)\z", 1))


def file_slice(files: DataFrame, start: int, end: int, name: str = "filename") -> DataFrame:
    """Files start to end (exclusive) of the list in order of their names."""
    return between(files, start, end, [F.col(name).asc()])


def content_route(name: Column | str, scan: Column) -> Column:
    """native, native_pdf, handwritten or print: how the text of a file is got. Handwriting shows in the end of its stem."""
    hand = F.lower(file_stem(name)).rlike("-(hw|handwritten|written)$")
    ext = extension(name)
    image = ext.isin("jpg", "jpeg", "png", "tif", "tiff")
    return F.when((ext == "pdf") & ~scan, "native_pdf").when((image | (ext == "pdf")) & hand, "handwritten").when(image | (ext == "pdf"), "print").otherwise("native")


def page_routes(pages: DataFrame) -> DataFrame:
    """pages (doc, page, quick, slow: texts by the fast engine and the other) with engine, and text of the engine chosen.

    Where the first page fails under the fast engine, the document goes to the other; else each page that fails does.
    """
    judged = pages.withColumn("__ok", page_ok("quick"))
    first = judged.groupBy("doc").agg(F.min_by("__ok", "page").alias("__first"))
    routed = judged.join(first, "doc").withColumn("engine", F.when(F.col("__first") & F.col("__ok"), "quick").otherwise("slow"))
    return routed.withColumn("text", F.when(F.col("engine") == "quick", F.col("quick")).otherwise(F.col("slow"))).drop("__first", "__ok")


def document_methods(routed: DataFrame) -> DataFrame:
    """doc, method: the one engine of its pages, or mixed."""
    return routed.groupBy("doc").agg(F.when(F.min("engine") == F.max("engine"), F.min("engine")).otherwise("mixed").alias("method"))


def active_projects(projects: DataFrame, field: str, excluded: list[str]) -> tuple[DataFrame, DataFrame]:
    """Projects (custom_fields: array of name, display_value) whose category is neither blank nor excluded, with category; and the counts of the others by category."""
    value = F.get(F.filter("custom_fields", lambda f: f["name"] == field), F.lit(0))["display_value"]
    rows = projects.withColumn("category", value).withColumn("__c", F.lower(F.trim(F.coalesce(value, F.lit("")))))
    good = (F.col("__c") != "") & ~F.col("__c").isin([x.strip().lower() for x in excluded])
    return rows.where(good).drop("__c"), rows.where(~good).groupBy(F.col("__c").alias("category")).agg(F.count("*").alias("skipped"))


def mail_threads(inbox: DataFrame, sent: DataFrame, since: Column) -> DataFrame:
    """Threads of both folders since a time, one row each: the latest message, the smallest in order of its columns where times are equal."""
    both = inbox.unionByName(sent).where(F.col("sent_at") >= since)
    rest = [c for c in both.columns if c not in ("thread_id", "sent_at")]
    first = F.min(F.struct((-F.unix_micros(F.col("sent_at").cast("timestamp"))).alias("__age"), F.col("sent_at"), *rest)).alias("m")
    return both.groupBy("thread_id").agg(first).select("thread_id", "m.sent_at", *(F.col("m")[c].alias(c) for c in rest)).select(*both.columns)


# Parts of senders and of subjects that mark mail as noise.
NOISE_SENDERS = ["noreply", "no-reply", "mailer-daemon", "donotreply", "forms-receipts", "notifications"]
NOISE_SUBJECTS = ["[github]"]


def is_mail_noise(sender: Column | str, subject: Column | str) -> Column:
    """Whether a message comes from a machine; when unsure it does not."""
    has = lambda c, words: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(w)) for w in words])
    return has(sender, NOISE_SENDERS) | has(subject, NOISE_SUBJECTS)


def mail_clusters(threads: DataFrame, known: DataFrame) -> DataFrame:
    """kind (person or catch-all), entity, threads: the clusters that mail gets a page for.

    threads: thread_id, person (null where it concerns none), substantive. A person has one who is known (known:
    person), is in two threads or more, or in one with substance. The other threads share a catch-all page where
    there are two at least.
    """
    rows = threads.select("thread_id", "person", F.coalesce("substantive", F.lit(False)).alias("substantive")).distinct()
    people = rows.where("person is not null").groupBy("person").agg(F.count_distinct("thread_id").alias("threads"), F.max("substantive").alias("substantive"))
    there = known.select("person").distinct().withColumn("known", F.lit(True))
    good = people.join(there, "person", "left").where("known or threads >= 2 or substantive")
    rest = rows.where("person is null").agg(F.count_distinct("thread_id").alias("threads")).where("threads >= 2")
    named = lambda kind, entity, df: df.select(F.lit(kind).alias("kind"), entity.alias("entity"), "threads")
    return named("person", F.col("person"), good).unionByName(named("catch-all", F.lit(""), rest))


def meetings(events: DataFrame, day: Column, before: int = 7, after: int = 14) -> DataFrame:
    """Events (day, n_attendees, all_day) from some days before a day to some days after, of two people or more, without blocks of whole days."""
    inside = F.col("day").between(F.date_sub(day, before), F.date_add(day, after))
    return events.where(inside & (F.col("n_attendees") >= 2) & ~F.coalesce("all_day", F.lit(False)))


def new_contacts(attendees: DataFrame, people: DataFrame) -> DataFrame:
    """attendee, once each, of those who have no page (people: attendee)."""
    return attendees.select("attendee").distinct().join(people.select("attendee"), "attendee", "left_anti")


def recurring_series(events: DataFrame, least: int = 2) -> DataFrame:
    """series, n, first_day, last_day, days_between (on average) of titles, without dates and numbers, that come again."""
    series = F.trim(F.regexp_replace(F.regexp_replace(F.lower("title"), r"[\d/.:#-]+", " "), " +", " "))
    rows = events.groupBy(series.alias("series")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return rows.where(F.col("n") >= least).withColumn("days_between", F.datediff("last_day", "first_day") / (F.col("n") - 1))


# What a page says whose text no engine could read.
FAILED_PAGE = "OCR Failed."


def page_texts(pages: DataFrame) -> DataFrame:
    """pages (doc, page, quick, slow: texts, null where an engine failed) with text, engine and log: the quick engine's text, else the other's, else a page that says so."""
    engine = F.when(F.col("quick").isNotNull(), "quick").when(F.col("slow").isNotNull(), "slow").otherwise("failed")
    text = F.coalesce("quick", "slow", F.lit(FAILED_PAGE))
    head = F.concat(F.lit("[Source: "), F.col("doc").cast("string"), F.lit(" | Page: "), F.col("page").cast("string"), F.lit("]\n"))
    failed = F.concat(F.lit("ERROR on "), F.col("doc").cast("string"), F.lit(" page "), F.col("page").cast("string"))
    return pages.withColumn("engine", engine).withColumn("text", text).withColumn("log", F.when(F.col("engine") == "failed", failed).otherwise(F.concat(head, "text")))


def archive_route(items: DataFrame) -> DataFrame:
    """items with ok, source (how the text is got) and reason, for an item of an archive.

    items: identifier, mediatype, djvu_text, pdf_text, pdf_error, ocr_text, ocr_method; null where there is none. The
    archive's own text is taken where it is good, else a text layer that is no scan's, else the text of OCR.
    """
    kind = F.coalesce("mediatype", F.lit(""))
    rows = items.withColumn("__good", F.when(F.col("djvu_text").isNotNull(), document_ok("djvu_text")["ok"]).otherwise(False))
    layer = F.col("pdf_text").isNotNull() & ~is_scan("pdf_text") & (strip(F.coalesce("pdf_text", F.lit(""))) != "")
    source = (
        F.when(kind != "texts", F.lit(None)).when(F.col("__good"), "ia-tesseract").when(F.col("pdf_error").isNotNull(), F.lit(None))
        .when(layer, "pdfminer").when(F.col("ocr_text").isNotNull(), F.col("ocr_method"))
    )
    reason = (
        F.when(kind != "texts", "no texts item").when(F.col("__good"), "archive text").when(F.col("pdf_error").isNotNull(), "extraction failed")
        .when(layer, "text layer").when(F.col("ocr_text").isNotNull(), "OCR").otherwise("nothing readable")
    )
    return rows.withColumn("source", source).withColumn("ok", F.col("source").isNotNull()).withColumn("reason", reason).drop("__good")


def bounding_box(left: Column, top: Column, width: Column, height: Column) -> Column:
    """Corners of a line of text and the size of type that covers it."""
    return F.struct(F.array(left, top, left + width, top + height).alias("bbox"), F.greatest(F.lit(1.0), height * 0.75).alias("font_size"))


def data_url(name: Column | str, content: Column | str) -> Column:
    kind = F.try_element_at(F.create_map(*(F.lit(x) for p in MIME.items() for x in p)), extension(name))
    return F.concat(F.lit("data:"), F.coalesce(kind, F.lit("application/octet-stream")), F.lit(";base64,"), F.base64(col(content)))


def document_page(name: Column | str, text: Column | str, day: Column, kind: str = "notes", lines: int | None = None) -> Column:
    """A Markdown page with front matter around a text, or around its first lines with a note of how many there are."""
    heading = title_case(F.translate(file_stem(name), "_-.", "   "))
    parts = F.split(col(text), "\n", -1)
    if lines is None:
        body = col(text)
    else:
        note = F.concat(F.lit(f"\n\n*[Preview: first {lines} of "), F.format_number(F.size(parts), 0), F.lit(" lines shown.]*"))
        body = F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), note)).otherwise(col(text))
    front = F.concat(F.lit('---\ntitle: "'), heading, F.lit(f'"\ntype: "{kind}"\ningested: "'), day, F.lit('"\noriginal_file: "'), col(name), F.lit('"\ntags:\n  - source\n---\n\n# '), heading)
    return F.concat(front, F.lit("\n\n## Content\n\n"), body, F.lit("\n"))


def table_page(name: Column | str, text: Column | str, columns: Column, rows: Column, day: Column, shown: int = CSV_ROWS) -> Column:
    """A Markdown page around the first rows of a table (text: a line a row, the header first; rows: how many records; columns: their names)."""
    heading = title_case(F.translate(file_stem(name), "_-", "  "))
    note = F.concat(F.lit(f"\n\n*[Preview: first {shown} of "), F.format_number(rows, 0), F.lit(" records shown.]*"))
    body = F.when(rows > shown, F.concat(F.array_join(F.slice(F.split(col(text), "\n", -1), 1, shown + 1), "\n"), note)).otherwise(col(text))
    front = F.concat(F.lit('---\ntitle: "'), heading, F.lit('"\ntype: "data"\ningested: "'), day, F.lit('"\noriginal_file: "'), col(name), F.lit('"\ntags:\n  - structured-data\n---\n\n# '), heading)
    about = F.concat(F.lit("\n\n"), F.format_number(rows, 0), F.lit(" records. Columns: "), F.array_join(F.transform(columns, lambda c: F.concat(F.lit("`"), c, F.lit("`"))), ", "), F.lit("."))
    return F.concat(front, about, F.lit("\n\n## Content\n\n"), body, F.lit("\n"))


#: What a model is asked: of a whole text, of a part of it, and to bring the answers on parts together.
WHOLE_PROMPT = "Write a summary of this transcript and nothing else.\n\n{text}"
PART_PROMPT = "This is part {n} of {total} of a transcript. Write a summary of this part and nothing else.\n\n{text}"
TOGETHER_PROMPT = "These are summaries of the parts of one document, in order. Make one summary of them.\n\n{text}"


def filled(template: str, **values: Column) -> Column:
    """A template with columns in place of {names}; what stands in the columns is not looked at for names."""
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return F.concat(*(F.lit(p) if k % 2 == 0 else values[p].cast("string") for k, p in enumerate(parts)))


def prompts(chunks: Column) -> Column:
    """The prompts for the chunks of a text: one of the whole where there is one chunk, else one a part."""
    total = F.size(chunks)
    parts = F.transform(chunks, lambda c, i: filled(PART_PROMPT, n=i + 1, total=total, text=c))
    return F.when(total <= 1, F.transform(chunks, lambda c: filled(WHOLE_PROMPT, text=c))).otherwise(parts)


def part_headers(parts: Column) -> Column:
    """Partial texts under their numbers, for a pass that brings them together."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("[Part "), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n")


def long_date(day: Column | str) -> Column:
    return F.date_format(col(day), "MMMM d, yyyy")


Model = Callable[[list[str]], list[str]]


def apply_model(rows: DataFrame, make: Callable[[], Model], text: str = "text", out: str = "answer") -> DataFrame:
    """rows with a model's answer to each text; null where it raises, with the reason in out_error.

    make builds the model, once for each task; it stands for a tagger, an OCR engine, a vision model or a summariser,
    which this library does not contain. Rows pass in batches; a batch that fails is tried row by row.
    """
    ship(rows.sparkSession)
    at, names = rows.columns.index(text), [*rows.columns, out, f"{out}_error"]

    def one(model: Model, value: str) -> tuple[str | None, str | None]:
        try:
            return model([value])[0], None
        except Exception as e:  # an answer that fails must not end the job
            return None, f"{type(e).__name__}: {e}"[:500]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            try:
                found = [(a, None) for a in model(texts)]
            except Exception:  # then row by row
                found = [one(model, t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=names)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(of, f"{shape}, `{out}` string, `{out}_error` string")
