"""Writers of the file formats that archival tools exchange."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..storage import stash
from .pdf import searchable_pdf

#: Rows up to which a report may go into one file.
MOST_IN_ONE_FILE = 100_000
#: Spark's writer would trim cells.
_AS_IT_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def flat(rows: DataFrame, separator: str = ";") -> DataFrame:
    """Arrays joined into strings, dates as ISO strings, null as empty: what a CSV can hold."""
    out = [F.array_join(c, separator).alias(c) if kind.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, kind in rows.dtypes]
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str, quote_all: bool = False, sep: str = ",", mode: str = "overwrite") -> None:
    flat(rows).write.mode(mode).csv(path, header=True, sep=sep, quote='"', escape='"', quoteAll=quote_all, emptyValue="", **_AS_IT_IS)


def write_tsv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_csv(rows, path, sep="\t", mode=mode)


def append_csv(rows: DataFrame, path: str) -> None:
    """rows behind those that the folder holds: one file each time, of which only the first has a header. For the few rows of a run."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    _few(flat(rows)).coalesce(1).write.mode("append").csv(path, header=not there, quote='"', escape='"', emptyValue="", **_AS_IT_IS)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An object a line."""
    rows.write.mode(mode).json(path, ignoreNullFields=False)


def _few(rows: DataFrame) -> DataFrame:
    if rows.limit(MOST_IN_ONE_FILE + 1).count() > MOST_IN_ONE_FILE:
        raise ValueError(f"more than {MOST_IN_ONE_FILE} rows do not go into one file")
    return rows


def write_json_array(rows: DataFrame, folder: str, name: str = "report.json") -> DataFrame:
    """A report as one JSON array, indented by two; refused beyond MOST_IN_ONE_FILE rows."""
    spark = rows.sparkSession
    found = [json.loads(r.j) for r in _few(rows).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).collect()]
    one = spark.createDataFrame([(name, json.dumps(found, indent=2, ensure_ascii=False))], "name string, text string")
    return write_files(one, folder, "name", "text")


def write_files(rows: DataFrame, folder: str, name: str = "filename", content: str = "text") -> DataFrame:
    """Writes a file for each row below a folder that all executors share, and returns their list: path, bytes.

    content: a column of strings (UTF-8) or bytes; null is an empty file. A task that runs again writes the same files
    again. Names may have folders in them; the last of equal names stays.
    """
    ship(rows.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        # on a mounted folder Arrow's stream takes ten times as long as a plain file, and no less on more cores
        create = partial(open, mode="wb") if isinstance(system, fs.LocalFileSystem) else partial(system.open_output_stream, compression=None)
        made: set[str] = set()
        for batch in batches:
            paths, sizes = [], []
            for file, body in zip(*(c.to_pylist() for c in batch.columns)):
                data = body.encode() if isinstance(body, str) else body or b""
                at = f"{top}/{file}"
                parent = at.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with create(at) as out:
                    out.write(data)
                paths.append(f"{folder}/{file}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return stash(rows.select(name, content).mapInArrow(of, "path string, bytes long"), "files")


def write_pages(pages: DataFrame, folder: str, body: str = "body", by: str = "slug") -> DataFrame:
    """A Markdown file for each page, named by its slug."""
    return write_files(pages.select(F.concat(F.col(by).cast("string"), F.lit(".md")).alias("filename"), F.col(body).alias("text")), folder)


def searchable_pages(documents: DataFrame) -> DataFrame:
    """filename, content: a PDF with an invisible text layer for each document. documents: filename, title, pages: array of arrays of (text, left, top, width, height)."""
    ship(documents.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, files = [], []
            for name, title, pages in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [[(x["text"] or "", x["left"], x["top"], x["width"], x["height"]) for x in page or []] for page in pages or []]
                names.append(name)
                files.append(searchable_pdf(lines, {"title": title} if title else None))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(files, pa.binary())], names=["filename", "content"])

    return documents.select("filename", "title", "pages").mapInArrow(of, "filename string, content binary")
