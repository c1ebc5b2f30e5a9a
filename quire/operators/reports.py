"""The report of each path: what became of it, and what to do about it in the next run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import FINAL, status_name


def latest(reports: DataFrame, path: str = "path", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last report of each path; a single aggregation with partial results on the map side."""
    rest = [c for c in reports.columns if c != path]
    return reports.groupBy(path).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(path, *[F.col(f"r.{c}").alias(c) for c in rest])


def to_do(paths: DataFrame, reports: DataFrame, path: str = "path") -> DataFrame:
    """Paths without a report that settles them: only success, timeout and fatal errors do."""
    return paths.join(reports.where(F.col("code").isin(*FINAL)).select(path), path, "left_anti")


def with_status(reports: DataFrame, code: int | None) -> DataFrame:
    return reports if code is None else reports.where(F.col("code") == code)


def clean(reports: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Reports of paths that still exist."""
    return reports.join(listing.select(path), path, "left_semi")


def view(reports: DataFrame, paths: list[str], path: str = "path") -> DataFrame:
    """Status and error of some paths; a path without a report has a null status."""
    asked = reports.sparkSession.createDataFrame([(p,) for p in paths], f"{path} string")
    return asked.join(reports, path, "left").select(path, status_name(F.col("code")).alias("status"), "exception_class", "exception_message")


def histogram(reports: DataFrame) -> DataFrame:
    """Reports by status."""
    return reports.groupBy("code").agg(F.count("*").alias("n")).withColumn("status", status_name(F.col("code")))


def progress(events: DataFrame, path: str = "path") -> DataFrame:
    """Counters of each path from events (path, kind, amount): embedded documents, OCR, skips, units."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("amount")).otherwise(0)).cast("bigint").alias(kind)
    kinds = ("embeds", "ocr_submitted", "ocr_completed", "skipped_depth", "skipped_size", "units")
    return events.groupBy(path).agg(*map(of, kinds), F.min(F.when(F.col("kind") == "expected_units", F.col("amount"))).alias("expected_units"))


def in_flight(running: DataFrame, now: Column, path: str = "path", started: str = "started") -> DataFrame:
    """One line with every running path and its seconds, ``none`` if there is none."""
    each = F.concat(F.col(path), F.lit(" ("), F.floor((F.unix_millis(now) - F.unix_millis(F.col(started))) / 1000).cast("string"), F.lit("s)"))
    return running.agg(F.array_join(F.sort_array(F.collect_list(each)), "; ").alias("s")).select(F.when(F.col("s") == "", "none").otherwise(F.col("s")).alias("in_flight"))


def contains(table: DataFrame, value: str, path: str = "path") -> bool:
    """Whether a queue or report table has a path; the scan stops at the first."""
    return not table.where(F.col(path) == value).isEmpty()
