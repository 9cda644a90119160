"""Pages, manifests, topics, chunks and digests of incremental ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, col, file_slug, strip
from ..storage import stash
from .graph import spread_join
from .ordering import numbered

# Fixed values of the language-model tools: tokens of a single call and of a chunk, characters a token, prices a
# million tokens, longest image side, pixels a token, tokens of a prompt.
SINGLE_PASS, CHUNK, CHARS = 180_000, 60_000, 4
PRICE_IN, PRICE_OUT = 3.0, 15.0
LONGEST_SIDE, PIXELS, PROMPT = 1500, 750, 150


def unprocessed(files: DataFrame, manifest: DataFrame, key: str = "md5") -> DataFrame:
    """Files whose key the manifest has not."""
    return files.join(manifest.select(key).distinct(), key, "left_anti")


def first_of_content(files: DataFrame, key: str = "md5", order: str = "filename") -> DataFrame:
    """Of files with equal content the first: key, first, copies."""
    return files.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def assign_slugs(files: DataFrame, existing: DataFrame | None = None, name: str = "filename", order: str = "idx") -> DataFrame:
    """files with slug: unique, the base or base-2, base-3 and so on in order, none that exists already.

    Rounds: every file takes its rank among those of its base. Where a slug exists already, or several files come to
    the same one, all but the first of them are late and move on with the later files of their base, until nothing
    collides. Ranks come from positions in one order over all files, so a base may have any number of them.
    """
    placed, _ = numbered(files.withColumn("__base", file_slug(name)), [F.col("__base").asc(), F.col(order).asc()], "__at")
    rows = stash(placed, "placed")
    first = rows.groupBy("__base").agg(F.min("__at").alias("__first"))
    rows = spread_join(rows, first, ["__base"]).withColumn("__n", F.col("__at") - F.col("__first") + 1).drop("__at", "__first")
    slug = F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), F.col("__n").cast("string")))
    taken = existing.select(F.col("slug").alias("__slug")).distinct().withColumn("__old", F.lit(True)) if existing is not None else None
    while True:
        rows = stash(rows.withColumn("__slug", slug), "slugs")
        counts = rows.groupBy("__slug").agg(F.min(order).alias("__earliest"), F.count("*").alias("__many"))
        clash = (counts.join(taken, "__slug", "left") if taken is not None else counts.withColumn("__old", F.lit(None).cast("boolean"))).where("__old or __many > 1")
        clash = stash(clash, "clash")
        if clash.isEmpty():
            return rows.withColumn("slug", F.col("__slug")).drop("__base", "__n", "__slug")
        late = rows.join(clash, "__slug").where(F.col("__old") | (F.col(order) != F.col("__earliest")))
        # later files of the same base move with the late one, so that numbers stay in order
        moved = late.groupBy("__base").agg(F.min("__n").alias("__from"))
        rows = spread_join(rows.drop("__slug"), moved, ["__base"], "left").withColumn("__n", F.col("__n") + F.when(F.col("__n") >= F.col("__from"), 1).otherwise(0)).drop("__from")


def body_of(page: Column | str) -> Column:
    """What stands below the content heading, or all without one."""
    at = F.instr(col(page), "## Content\n\n")
    return F.when(at > 0, F.substr(col(page), at + F.lit(len("## Content\n\n")))).otherwise(col(page))


def topic_links(pages: DataFrame, topics: list[dict], text: str = "body", key: str = "slug") -> DataFrame:
    """key, topic: pages without related topics, and the topics (slug, keywords, threshold) of which enough keywords occur below the content heading; a threshold of 0 matches always."""
    low = F.lower(body_of(text))
    hits = [
        F.when(F.lit(t["threshold"]) <= reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in t["keywords"]], F.lit(0)), F.lit(t["slug"]))
        for t in topics
    ]
    rows = pages.where(~F.contains(F.coalesce(text, F.lit("")), F.lit("## Related Topics")))
    return rows.select(key, F.explode(F.array_compact(F.array(*hits))).alias("topic"))


def topic_counts(links: DataFrame) -> DataFrame:
    """topic, n: pages of each topic."""
    return links.groupBy("topic").agg(F.count("*").alias("n"))


def index_of(catalogues: dict[str, DataFrame], title: str = "title") -> DataFrame:
    """kind, title: the pages of all catalogues in one list."""
    return reduce(lambda a, b: a.unionByName(b), [rows.select(F.lit(kind).alias("kind"), F.col(title).alias("title")) for kind, rows in catalogues.items()])


def related_section(topics: Column) -> Column:
    """Markdown for an array of structs (title, path)."""
    return F.concat(F.lit("## Related Topics\n\n"), F.array_join(F.transform(topics, lambda t: F.concat(F.lit("- ["), t["title"], F.lit("]("), t["path"], F.lit(")"))), "\n"), F.lit("\n"))


_FRONT = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*\n?(.*)\z"


def front_matter(page: Column | str) -> Column:
    """front (map) and body of a page; null where it has no block. The last of equal keys counts; quotes around values go."""
    block = F.regexp_extract(col(page), _FRONT, 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":") & ~x.rlike(rf"\A[{WS}]*#"))
    unquoted = lambda v: F.when(F.length(v) >= 2, F.regexp_replace(v, r"""\A"(.*)"\z|\A'(.*)'\z""", "$1$2")).otherwise(v)
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), unquoted(strip(F.substr(x, F.instr(x, ":") + 1))).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.when(col(page).rlike(_FRONT), F.struct(F.map_from_entries(last).alias("front"), F.regexp_extract(col(page), _FRONT, 2).alias("body")))


def replace_block(page: Column | str, block: Column, start: str, end: str, day: Column) -> Column:
    """page with the first text between the marks replaced by block (which has its own marks); without marks, block is added under a dated heading. Nothing in block is taken for a pattern."""
    p = col(page)
    a = F.instr(p, start)
    tail = F.substr(p, a)
    b = F.instr(tail, end)
    inside = F.concat(F.substr(p, F.lit(1), a - 1), block, F.substr(tail, b + F.lit(len(end))))
    added = F.concat(F.regexp_replace(p, rf"[{WS}]+\z", ""), F.lit("\n\n## Refreshed snapshot ("), day, F.lit(")\n\n"), block, F.lit("\n"))
    return F.when((a > 0) & (b > 0), inside).otherwise(added)


def touch(page: Column | str, day: Column) -> Column:
    """page with last_updated in its front matter set to a day, or put in at its end; a page without front matter stays as it is."""
    p = col(page)
    pattern = r"(?s)\A(---[ \t]*\n)(.*?)(\n---[ \t]*\n)(.*)\z"
    part = lambda k: F.regexp_extract(p, pattern, k)
    at = F.regexp_instr(part(2), F.lit("(?m)^last_updated:"))
    rest = F.substr(part(2), at)
    line = F.concat(F.lit("last_updated: "), day)
    told = F.concat(F.substr(part(2), F.lit(1), at - 1), line, F.regexp_replace(rest, r"\A[^\n]*", ""))
    added = F.concat(F.regexp_replace(part(2), rf"[{WS}]+\z", ""), F.lit("\n"), line)
    return F.when(p.rlike(pattern), F.concat(part(1), F.when(at > 0, told).otherwise(added), part(3), part(4))).otherwise(p)


def refresh(page: Column | str, block: Column, start: str, end: str, day: Column) -> Column:
    """replace_block, and the day in the front matter where the marks were there."""
    marked = F.contains(col(page), F.lit(start)) & F.contains(col(page), F.lit(end))
    changed = replace_block(page, block, start, end, day)
    return F.when(marked, touch(changed, day)).otherwise(changed)


def usage_totals(calls: DataFrame) -> DataFrame:
    """calls, tokens_in, tokens_out and cost of all calls (tokens_in, tokens_out), in one row."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = calls.agg(F.count("*").alias("calls"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"))
    return sums.withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out")))


def run_counters(items: DataFrame) -> DataFrame:
    """processed, skipped (known to the manifest) and errors of a run's items (known: boolean, error: string or null), in one row."""
    known = F.coalesce("known", F.lit(False))
    return items.agg(F.count_if(~known & F.col("error").isNull()).alias("processed"), F.count_if(known).alias("skipped"), F.count_if(~known & F.col("error").isNotNull()).alias("errors"))


def estimate_tokens(text: Column | str) -> Column:
    return F.floor(F.length(F.coalesce(col(text), F.lit(""))) / CHARS).cast("long")


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT


def pack_paragraphs(text: Column | str, target: int = CHUNK * CHARS) -> Column:
    """Chunks of paragraphs: one is closed when the next paragraph would take it beyond target. A longer paragraph is a chunk by itself.

    The fold carries where chunks begin; their texts are cut afterwards, so no text is copied along.
    """
    parts = F.split(F.coalesce(col(text), F.lit("")), "\n\n", -1)
    state = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("at"))

    def step(s: Column, n: Column) -> Column:
        opens = (s["at"] == 0) | ((s["size"] + n > target) & (s["size"] > 0))
        return F.struct(
            F.when(opens, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"),
            (F.when(opens, F.lit(0).cast("long")).otherwise(s["size"]) + n + 2).alias("size"), (s["at"] + 1).alias("at"),
        )

    starts = F.aggregate(F.transform(parts, lambda p: F.length(p).cast("long")), state, step, lambda s: F.concat(s["starts"], F.array(s["at"])))
    cut = lambda ss: F.transform(F.slice(ss, 1, F.size(ss) - 1), lambda a, i: F.array_join(F.slice(parts, a + 1, F.element_at(ss, i + 2) - a), "\n\n"))
    return F.transform(F.array(starts), cut)[0]


def image_tokens(width: Column | str, height: Column | str) -> Column:
    """Tokens of an image scaled to its longest side at most, and of the prompt."""
    w, h = col(width).cast("double"), col(height).cast("double")
    scale = F.least(F.lit(1.0), F.lit(float(LONGEST_SIDE)) / F.greatest(w, h))
    return (F.greatest(F.lit(1), F.bround(F.floor(w * scale) * F.floor(h * scale) / PIXELS)) + PROMPT).cast("long")


def place_slots(raw: Column | str, slots: int = 3) -> Column:
    """The first places of a model's JSON answer, with or without a code fence, padded with empty strings; null where it does not parse."""
    bare = F.regexp_replace(strip(raw), r"(?s)\A```(?:json)?\s*|\s*```\z", "")
    places = F.from_json(bare, "places array<string>")["places"]
    return F.when(places.isNotNull(), F.slice(F.concat(places, F.array_repeat(F.lit(""), slots)), 1, slots))


def page_join(pages: Column) -> Column:
    """Texts of pages, each under its number."""
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), p)), "\n\n")


def latest_comments(projects: DataFrame, tasks: DataFrame, comments: DataFrame, top: int = 5) -> DataFrame:
    """projects (gid, name, status_text, status_at) with line: the newest comment on the tasks last modified, else the status with its month, else a note that there is none.

    tasks: gid, project_gid, modified_at; comments: task_gid, type, text, created_at. Ties go to the smallest gid.
    """
    order = Window.partitionBy("project_gid").orderBy(F.col("modified_at").desc(), "gid")
    recent = tasks.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top).select(F.col("gid").alias("task_gid"), "project_gid")
    said = comments.where("type = 'comment'").join(recent, "task_gid").groupBy(F.col("project_gid").alias("gid")).agg(F.max_by("text", F.struct("created_at", "task_gid")).alias("__comment"))
    link = F.regexp_replace("__comment", r"https://app\.asana\.com/0/profile/[0-9]+[ \t]*", "")
    clean = F.nullif(F.regexp_replace(link, rf"\A[{WS}]*\n|\A\n+|\n[{WS}]*\z", ""), F.lit(""))
    status = F.concat(F.lit("*[From project status, "), F.date_format("status_at", "MMM yyyy"), F.lit("] "), F.col("status_text"), F.lit("*"))
    return projects.join(said, "gid", "left").withColumn("line", F.coalesce(clean, status, F.lit("*[No recent activity on record]*"))).drop("__comment")


def digest_bullet(name: Column, link: Column, responsible: Column, category: Column, line: Column, default: str) -> Column:
    """Markdown of a project: its link, who is responsible, the category unless it is the default, and a bullet for each line."""
    who = F.when(F.coalesce(responsible, F.lit("")) != "", F.concat(F.lit(" ("), responsible, F.lit(")"))).otherwise("")
    kind = F.when(category != default, F.concat(F.lit(" *("), category, F.lit(")*"))).otherwise("")
    under = F.array_join(F.transform(F.filter(F.split(line, "\n"), lambda x: strip(x) != ""), lambda x: F.concat(F.lit("  - "), x)), "\n")
    return F.concat(F.lit("- ["), name, F.lit("]("), link, F.lit(")"), who, kind, F.lit("\n"), under)


def file_groups(files: DataFrame, name: str = "filename", frames: str = "frames") -> DataFrame:
    """prefix (up to the first underscore), files and pages of each group of images."""
    prefix = F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1)).otherwise(F.regexp_replace(name, r"\.[^.]*\z", ""))
    return files.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("files"), F.sum(frames).alias("pages"))
