"""Queues, reports and index records in files and databases."""

from __future__ import annotations

from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _elements(spark: SparkSession, path: str, element: str, brackets: str, whole):
    """Elements of a JSON file. One that has an element a line, as ``write_json`` leaves it, is read line by line by many tasks; any other as a whole."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where(F.length("value") > 0)
    if lines.where(~F.col("value").isin(*brackets) & ~F.col("value").rlike(f"^{element},?$")).isEmpty():
        return lines.where(~F.col("value").isin(*brackets)).select(F.regexp_replace("value", ",$", "").alias("value"))
    return whole(spark.read.text(path, wholetext=True))


_STRING = r'"(?:[^"\\]|\\.)*"'


def queue_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(path) from a JSON array of strings."""
    each = _elements(spark, path, _STRING, "[]", lambda t: t.select(F.explode(F.from_json("value", "array<string>")).alias("path")))
    return each if "path" in each.columns else each.select(F.element_at(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"), 1).alias("path"))


def queue_from_csv(spark: SparkSession, path: str, field: str = "path") -> DataFrame:
    """(path) from a column of a CSV file with a header; fields may hold quoted commas and line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').select(F.col(f"`{field}`").alias("path"))


def report_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, code) from a JSON object of codes by path."""
    each = _elements(spark, path, _STRING + r"\s*:\s*-?\d+", "{}", lambda t: t.select(F.explode(F.from_json("value", "map<string,int>")).alias("path", "code")))
    return each if "path" in each.columns else each.select(F.explode(F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string,int>")).alias("path", "code"))


def _string(column: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(column.alias("v"))), r"^\{\"v\":([\s\S]*)\}$", 1)


def queue_lines(queue: DataFrame, path: str = "path") -> DataFrame:
    """(path, json): each path as an element of a JSON array."""
    return queue.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), _string(F.col(path)).alias("json"))


def report_lines(reports: DataFrame, code: int | None = None, path: str = "path") -> DataFrame:
    """(path, json): each path and its code as a member of a JSON object, optionally of one status only."""
    kept = reports if code is None else reports.where(F.col("code") == code)
    return kept.where(F.col(path).isNotNull() & F.col("code").isNotNull()).select(F.col(path).alias("path"), F.concat(_string(F.col(path)), F.lit(": "), F.col("code").cast("string")).alias("json"))


def _joined(items: DataFrame, brackets: str) -> DataFrame:
    """(json): one row with all of (path, json) between brackets, sorted by path, a null path last; null without any row. It is one string, so it is put together in one task and can't pass 2 GB; ``write_json`` has no such bound."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("path").isNull().alias("last"), "path", "json")))
    whole = F.concat(F.lit(brackets[0]), F.array_join(F.transform(parts, lambda x: x["json"]), ","), F.lit(brackets[1]))
    return items.agg(F.when(F.count("*") > 0, whole).alias("json"))


def queue_json(queue: DataFrame, path: str = "path") -> DataFrame:
    """(json): one row with a JSON array of all paths, sorted, repeated ones as often as they are there and null ones as null at the end; null for an empty queue."""
    return _joined(queue.select(F.col(path).alias("path"), F.when(F.col(path).isNull(), "null").otherwise(_string(F.col(path))).alias("json")), "[]")


def report_json(reports: DataFrame, path: str = "path") -> DataFrame:
    """(json): one row with a JSON object of codes by path, sorted by path, then code, as often as they are there; reports without path or code are left out; null where none is left."""
    kept = reports.where(F.col(path).isNotNull() & F.col("code").isNotNull())
    return _joined(kept.select(F.col(path).alias("path"), F.concat(_string(F.col(path)), F.lit(":"), F.col("code").cast("string")).alias("json")), "{}")


def write_json(lines: DataFrame, out: TextIO, brackets: str) -> int:
    """Writes a JSON array or object with an element a line, sorted by path, and returns the number of elements. Tasks sort and format; the driver passes partition after partition on and holds none beyond it."""
    n = 0
    out.write(brackets[0])
    for row in lines.orderBy("path").select("json").toLocalIterator():
        out.write(",\n" if n else "\n")
        out.write(row[0])
        n += 1
    out.write(f"\n{brackets[1]}\n" if n else f"{brackets[1]}\n")
    return n


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A queue or report table of a database; filters and columns are pushed down to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def to_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Adds to a queue or report table of a database; each task writes its rows in one transaction."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def dead_letters(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Index records that couldn't be written, to be written again."""
    return spark.read.schema(schema).parquet(path)
