"""Services that answer in pages (portfolios, tasks, comments) and items of an archive; the client is a callable, so nothing here opens a connection."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Of a key, an offset (null at first) and a limit: items, and the offset of the next page, null where there is none.
Fetch = Callable[[str, str | None, int], tuple[list[dict], str | None]]
PAGE, CAP = 100, 500


def _items(fetch: Fetch, key: str, page: int, cap: int) -> tuple[list[dict], bool, str | None]:
    items, offset, seen = [], None, set()
    try:
        while len(items) < cap:
            got, offset = fetch(key, offset, min(page, cap - len(items)))
            items += got
            if offset is None:
                break
            if offset in seen:
                raise ValueError(f"page {offset} comes again")
            seen.add(offset)
    except Exception as e:  # noqa: BLE001  a service's failure is a value
        return items[:cap], False, f"{type(e).__name__}: {e}"
    return items[:cap], offset is not None or len(items) > cap, None


def paged(parents: DataFrame, make: Callable[[], Fetch], schema: str, key: str = "gid", page: int = PAGE, cap: int = CAP) -> DataFrame:
    """parent, at (from 0), item (of the schema), truncated and error: what a service lists under each key of parents.

    A client is made once a task. Of each parent at most cap items are asked for, and truncated says on all its rows
    whether there were more. A parent whose fetch fails keeps what came before and has one more row, without item and
    place, with the error; one without items has no rows, nor has a null key.
    """
    ship(parents.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = make()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                items, truncated, error = _items(fetch, name, page, cap)
                rows = [(name, k, json.dumps(x), truncated, None) for k, x in enumerate(items)]
                rows += [(name, None, None, truncated, error)] if error else []
                if rows:
                    types = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["parent", "at", "item", "truncated", "error"])

    keys = parents.select(F.col(key).cast("string")).where(F.col(key).isNotNull())
    found = keys.mapInArrow(of, "parent string, at int, item string, truncated boolean, error string")
    return found.withColumn("item", F.from_json("item", schema))


def exported(folder: str) -> Callable[[], Fetch]:
    """For paged(): an export of a service, pages folder/key/offset.json (0 the first), each {data: items, next_page: {offset} or null}."""

    def make() -> Fetch:
        files, root = fs.FileSystem.from_uri(folder)

        def fetch(key: str, offset: str | None, limit: int) -> tuple[list[dict], str | None]:
            with files.open_input_stream(f"{root}/{quote(key, safe='')}/{offset or 0}.json") as f:
                answer = json.loads(f.read())
            return answer["data"], (answer.get("next_page") or {}).get("offset")

        return fetch

    return make


def archive_item(identifier: Column | str, meta: Column | str) -> Column:
    """mediatype, has_text (the archive has its own OCR) and pdf_name of an item, by the archive's JSON about it; null where that is none."""
    about = F.from_json(meta, "metadata struct<mediatype: string>, files array<struct<name: string, format: string>>")
    has_text = F.coalesce(F.exists(about["files"], lambda f: F.endswith(F.coalesce(f["name"], F.lit("")), F.lit("_djvu.txt"))), F.lit(False))
    name = F.concat(F.col(identifier) if isinstance(identifier, str) else identifier, F.lit(".pdf"))
    found = F.struct(about["metadata"]["mediatype"].alias("mediatype"), has_text.alias("has_text"), name.alias("pdf_name"))
    return F.when(about["metadata"].isNotNull() | about["files"].isNotNull(), found)


def downloads(files: DataFrame, make: Callable[[], Callable[[str, str], bytes]]) -> DataFrame:
    """identifier, name, content and error of files (identifier, name) by a client made once a task; one that fails has an error and no content."""
    ship(files.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = make()
        for batch in batches:
            for identifier, name in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    content, error = fetch(identifier, name), None
                except Exception as e:  # noqa: BLE001
                    content, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((identifier, pa.string()), (name, pa.string()), (content, pa.binary()), (error, pa.string()))], names=["identifier", "name", "content", "error"])

    return files.select(F.col("identifier").cast("string"), "name").mapInArrow(of, "identifier string, name string, content binary, error string")
