"""Incremental ingest: a file stream whose content hashes are held against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def seen(spark: SparkSession, manifest: str) -> DataFrame:
    """The manifest: md5, filename, batch. Missing is empty."""
    schema = "md5 string, filename string, batch long"
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(manifest) if there else spark.createDataFrame([], schema)


def file_stream(spark: SparkSession, folder: str, schema: str, kind: str = "json", files_each: int | None = None) -> DataFrame:
    """A stream of the files below a folder; files_each is how many a micro-batch takes at most, which with a pace in ingest() is the rate at which a service behind it is asked."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).format(kind).load(folder)


def ingest(files: DataFrame, manifest: str, pages: str, checkpoint: str, files_at_once: bool = True, failed: str | None = None, pace: str | None = None) -> StreamingQuery:
    """Starts a query that writes each content once: files is a stream of filename and text, and error where failed is given.

    Each micro-batch keeps the first file of each content, leaves out what the manifest has, and writes pages and
    manifest below folders of its own number. A batch that is run again after a failure overwrites what it had
    written, and does not see it in the manifest, so its result is the same. Rows with an error go to the folder
    failed and into the manifest, under a digest of their name, and so are never tried again. pace (such as "6
    seconds") starts a micro-batch at most that often, and the query then runs until it is stopped.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        error = F.col("error") if failed else F.lit(None).cast("string")
        known = F.when(error.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.concat(F.lit("failed:"), "filename"))
        hashed = rows.select("filename", "text", error.alias("error"), F.md5(known.cast("binary")).alias("md5"))
        first = hashed.groupBy("md5").agg(F.min_by(F.struct("filename", "text", "error"), "filename").alias("x")).select("md5", "x.*")
        old = seen(spark, manifest).where(F.col("batch") < batch).select("md5")
        fresh = first.join(old, "md5", "left_anti")
        if failed:
            fresh.where("error is not null").select("md5", "filename", "error").write.mode("overwrite").parquet(f"{failed}/batch={batch}")
        fresh.where("error is null").drop("error").write.mode("overwrite").parquet(f"{pages}/batch={batch}")
        done = spark.read.schema("md5 string, filename string, text string").parquet(f"{pages}/batch={batch}").select("md5", "filename")
        if failed:
            done = done.unionByName(spark.read.schema("md5 string, filename string, error string").parquet(f"{failed}/batch={batch}").select("md5", "filename"))
        done.write.mode("overwrite").parquet(f"{manifest}/batch={batch}")

    writer = files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    if pace:
        return writer.trigger(processingTime=pace).start()
    return (writer.trigger(availableNow=True) if files_at_once else writer).start()


def new_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of a listing that an earlier one has not; one that is there more often than before comes that many times."""
    return after.exceptAll(before)


def windowed_counts(events: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events by window and type, late ones up to the watermark: a stream or a table of ts, event_type."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def upsert(state: DataFrame, fresh: DataFrame, key: str, digest: str) -> DataFrame:
    """state after fresh rows: those whose digest is as before change nothing, others replace or join theirs; action tells which (kept, created, updated)."""
    old = state.select(F.col(key).alias("__key"), F.col(digest).alias("__digest"))
    judged = fresh.join(old, fresh[key] == F.col("__key"), "left").withColumn("action", F.when(F.col("__key").isNull(), "created").when(F.col(digest) == F.col("__digest"), "kept").otherwise("updated"))
    changed = judged.where("action <> 'kept'").select(*fresh.columns, "action")
    rest = state.join(changed.select(key), key, "left_anti").select(*fresh.columns, F.lit("kept").alias("action"))
    return rest.unionByName(changed)
