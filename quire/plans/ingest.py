"""The whole way: list files, skip what is settled, parse, merge what is the same, write trees to a sink, report on every path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.status import classify
from ..functions.text import parent_path
from ..operators.index import merge_paths
from ..operators.reports import latest, to_do
from ..operators.tree import gate
from ..sinks.outputs import IndexTable
from ..sources.parsers import Options, parse
from ..state import exists, remove, shared_folder
from ..streaming.drain import drain, queue_stream

REPORTS = "path string, code int, exception_class string, exception_message string, ts timestamp"


def report_of(docs: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """(path, code, exception_class, exception_message, ts) from the roots; an embedded document's failure to be parsed isn't its path's.

    ``saved`` is a sink's (id, path, error): a path of which any document couldn't be written isn't saved (code 9), unless it failed before, and is tried again.
    """
    roots = docs.where("level = 0").select("path", "error", F.lit("parse").alias("stage"))
    if saved is not None:
        failed = saved.where("error is not null").groupBy("path").agg(F.min("error").alias("sink_error"))
        roots = roots.join(failed, "path", "left").select("path", F.coalesce("error", "sink_error").alias("error"), F.when(F.col("error").isNull() & F.col("sink_error").isNotNull(), "save").otherwise("parse").alias("stage"))
    exception = F.nullif(F.split_part(F.coalesce("error", F.lit("")), F.lit(":"), F.lit(1)), F.lit(""))
    return roots.select(
        "path", classify(exception, F.lit(None).cast("string"), F.col("stage")).alias("code"), exception.alias("exception_class"),
        F.when(F.col("error").isNotNull(), F.regexp_replace("error", "^[^:]*: ?", "")).alias("exception_message"), F.current_timestamp().alias("ts"),
    )


class ReportStore:
    """Reports in a folder, by path or URL, to which each run adds. With a ``journal``, a folder elsewhere, reports that can't be written go there, the failure is raised all the same, and the next that can be written takes them along."""

    def __init__(self, spark: SparkSession, folder: str, journal: str | None = None) -> None:
        self.spark, self.folder, self.journal = spark, folder, journal

    def read(self) -> DataFrame:
        """All reports, the oldest ones too."""
        return self.spark.read.schema(REPORTS).parquet(self.folder) if exists(self.spark, self.folder) else self.spark.createDataFrame([], REPORTS)

    def latest(self) -> DataFrame:
        return latest(self.read())

    def add(self, reports: DataFrame) -> None:
        try:
            reports.write.mode("append").parquet(self.folder)
        except Exception:
            if self.journal:
                reports.write.mode("append").parquet(self.journal)
            raise
        self.flush()

    def flush(self) -> None:
        """Moves the journal's reports to the others."""
        if self.journal and exists(self.spark, self.journal):
            self.spark.read.schema(REPORTS).parquet(self.journal).write.mode("append").parquet(self.folder)
            remove(self.spark, self.journal)


def sightings(docs: DataFrame) -> DataFrame:
    """(id, path, parent_path, name) of each root: under which paths a content was seen."""
    return docs.where("level = 0").select("id", "path", parent_path(F.col("path")).alias("parent_path"), "name")


def seen_at(spark: SparkSession, index: str) -> DataFrame:
    """All sightings of an index, each once. They are a table of their own, a row each, as a content may be seen at any number of paths; ``merge_paths`` makes the sets of them."""
    folder = f"{index.rstrip('/')}-seen"
    kind = "id string, path string, parent_path string, name string"
    return spark.read.schema(kind).parquet(folder).distinct() if exists(spark, folder) else spark.createDataFrame([], kind)


def merged(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Trees as they go into an index: one row for each id. Of roots with equal content the one with the least path, in ``docs``, stays with all that is embedded in it; it gets the least path under which it was ever seen, and ``n_paths``."""
    kept = gate(docs)
    roots = kept.where("level = 0").select("id")
    known = seen.join(roots, "id", "left_semi").groupBy("id").agg(F.min("path").alias("_path"), F.count_distinct("path").alias("_n"))
    joined = kept.join(known.withColumnRenamed("id", "_id"), (F.col("level") == 0) & (F.col("id") == F.col("_id")), "left")
    return joined.select(*[F.coalesce("_path", "path").alias("path") if c == "path" else F.col(c) for c in kept.columns], F.col("_n").alias("n_paths"))


def with_paths(index: DataFrame, seen: DataFrame) -> DataFrame:
    """An index with the sorted sets of paths, parent paths and names of each root."""
    sets = merge_paths(seen, name="name").select(F.col("id").alias("_id"), "paths", "parent_paths", "names")
    return index.join(sets, F.col("id") == F.col("_id"), "left").drop("_id")


def ingest(spark: SparkSession, paths: DataFrame, index: str, reports: str, options: Options = Options(), partitions: int | None = None, journal: str | None = None) -> dict[str, int]:
    """Parses what has no final report yet, merges it into the index table and adds to the reports; run again, it has nothing to do.

    Parsed trees are written once, to the shared folder, and read from there for the index, the reports and the counts, then removed. Where the index can't be written, all paths are
    reported as not saved, and the failure is raised. Files of equal content are one row of the index (``merged``).
    """
    store = ReportStore(spark, reports, journal)
    work = to_do(paths.select("path"), store.latest()).distinct()
    if partitions:
        work = work.repartition(partitions)
    aside = f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}"
    try:
        parse(work, options).write.parquet(aside)
        docs = spark.read.parquet(aside)
        good = docs.where("digest is not null")  # what couldn't even be read is a single row, without content to index
        saved = None
        try:
            if not good.isEmpty():
                sightings(good).write.mode("append").parquet(f"{index.rstrip('/')}-seen")
                IndexTable(spark, index).write_trees(merged(good, seen_at(spark, index)))
        except Exception as e:
            saved = docs.select("id", "path", F.lit(f"{type(e).__name__}: {str(e)[:200]}").alias("error"))
            raise
        finally:
            store.add(report_of(docs, saved))
        counts = docs.agg(F.count_if(F.col("level") == 0).alias("roots"), F.count_if(F.col("level") > 0).alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("errors")).first()
        return {k: int(v or 0) for k, v in counts.asDict().items()}
    finally:
        remove(spark, aside)


def streaming_ingest(spark: SparkSession, queue: str, index: str, reports: str, checkpoint: str, options: Options = Options(), once: bool = True, files_per_batch: int | None = None, **drain_options) -> StreamingQuery:
    """``ingest`` of a queue's paths as they come, batch by batch: children and roots of a batch are committed to the index at once, then its reports. A batch that is repeated changes nothing."""
    return drain(queue_stream(spark, queue, files_per_batch), lambda batch, _: ingest(spark, batch, index, reports, options), checkpoint, once, **drain_options)
