"""Exact duplicates by recipes of content-defined chunks.

Each normalised text is cut where a rolling (gear) hash of its last 32 bytes has twelve zero bits, so equal passages
are cut alike wherever they stand. A chunk is named by a 64-bit identifier and vouched for by its SHA-256; where one
identifier stands for several contents, these are numbered, so that identifiers are verified. A text is then its
ordered list of verified identifiers, its recipe, and texts are equal when their recipes are. Texts are read once and
never shuffled: what moves is about 40 bytes a chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, MOST, ZERO_BITS, WINDOW = 1024, 16384, 12, 32
_BLOCK = 1 << 20
_GEAR = np.frombuffer(hashlib.shake_256(b"gear table").digest(1024), dtype="<u4").copy()
_RUNS = re.compile(rb"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ASCII white space made one space; null counts as empty."""
    return _RUNS.sub(b" ", (text or "").encode())


def cut_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of data; the last is its length. Chunks have LEAST to MOST bytes, but for the last."""
    n = len(data)
    if n <= LEAST:
        return [n]
    marks = []
    for at in range(0, n, _BLOCK):
        lead = min(at, WINDOW - 1)
        h = _GEAR[np.frombuffer(data, np.uint8, count=min(_BLOCK, n - at) + lead, offset=at - lead)]
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        marks.append(np.flatnonzero((h[lead:] >> np.uint32(32 - ZERO_BITS)) == 0) + (at + 1))
    ends, last = [], 0
    for mark in [*np.concatenate(marks).tolist(), n]:
        while mark - last > MOST:
            last += MOST
            ends.append(last)
        if mark - last >= LEAST:
            last = mark
            ends.append(mark)
    if last < n:
        ends.append(n)
    return ends


_RECIPE = "doc_id long, text_digest binary, ids array<long>, digests array<binary>"


def _recipes(id_bits: int):
    shift = 64 - id_bits
    schema = pa.schema([("doc_id", pa.int64()), ("text_digest", pa.binary()), ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wholes, ids, digests = [], [], []
            for text in batch.column(1).to_pylist():
                data = normalise(text)
                ends = cut_ends(data)
                whole = hashlib.sha256(data).digest()
                starts = [0, *ends[:-1]]
                wholes.append(whole)
                ids.append([(xxhash.xxh3_64_intdigest(data[a:b]) >> shift) - (1 << (id_bits - 1)) for a, b in zip(starts, ends)])
                digests.append([whole] if len(ends) == 1 else [hashlib.sha256(data[a:b]).digest() for a, b in zip(starts, ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(wholes, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))], schema=schema)

    return of


def exact_groups(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, one row per row of docs.

    docs: doc_id, text; other columns are ignored whatever their names. Null text counts as empty; empty texts are
    equal to one another. keep_id is the group's smallest doc_id (null only where every doc_id of the group is
    null). Of repeated rows with that doc_id exactly one is kept. No rows give no rows. id_bits shortens chunk
    identifiers, for tests of how clashes are resolved.
    """
    common.small_batches(docs.sparkSession)
    # the tag tells repeated rows apart; it is stable because it is written before it is used
    recipes = common.stash(
        docs.select("doc_id", "text").mapInArrow(common.lean(_recipes(id_bits)), _RECIPE).withColumn("tag", F.monotonically_increasing_id()), "recipes"
    )
    chunks = recipes.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests").distinct()
    clashes = common.stash(
        chunks.groupBy("ids").agg(F.collect_set("digests").alias("all")).where(F.size("all") > 1), "clashes"
    )
    named = recipes.withColumn("list", F.col("ids"))
    if not clashes.isEmpty():
        parts = recipes.select("tag", F.posexplode(F.arrays_zip("ids", "digests")).alias("at", "c")).select("tag", "at", "c.ids", "c.digests")
        number = F.coalesce(F.array_position(F.array_sort("all"), F.col("digests")), F.lit(0))
        parts = parts.join(clashes, "ids", "left").select("tag", F.struct("at", "ids", number.alias("n")).alias("p"))
        lists = parts.groupBy("tag").agg(F.array_sort(F.collect_list("p")).alias("p")).select(
            "tag", F.flatten(F.transform("p", lambda p: F.array(p["ids"], p["n"]))).alias("list")
        )
        named = recipes.join(lists, "tag")
    groups = named.groupBy("list").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first"), F.count("*").alias("group_size")
    )
    return common.spread_join(named, groups, ["list"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("first.tag") == F.col("tag")).alias("kept"),
        F.lower(F.hex("text_digest")).alias("text_sha256"), F.size("ids").alias("n_chunks"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs with one row for each distinct text, all columns as they were.

    Usually doc_id names a row, and the ids that are dropped decide. Where rows share a doc_id (null is a value like
    others), the text's digest decides with it, and of rows that repeat both one stays; only these rows are shuffled.
    """
    groups = common.stash(exact_groups(docs), "exact_groups")
    shared = common.stash(groups.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "shared_ids")
    plain = common.with_ids(docs, common.stash(groups.where("not kept").select("doc_id").union(shared).distinct(), "dropped"), "left_anti")
    if shared.isEmpty():
        return plain
    kept = common.with_ids(groups.where("kept"), shared, "left_semi").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    named = common.with_ids(docs, shared, "left_semi").withColumn("__sha", F.sha2(text.cast("binary"), 256))
    found = named.join(kept, named["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__kept")), "left_semi")
    return plain.unionByName(found.dropDuplicates(["doc_id", "__sha"]).select(*docs.columns))
