"""Pages of a document: their places in its text, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(pages: DataFrame, ident: str = "id", number: str = "page_no", text: str = "text", gap: int = 1) -> DataFrame:
    """``pages`` with start and end (excluded) in the joined text, which has ``gap`` characters between pages."""
    before = Window.partitionBy(ident).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)).cast("bigint")
    return pages.withColumn("start", start).withColumn("end", (start + F.length(text)).cast("bigint"))


def split(docs: DataFrame, ident: str = "id", content: str = "content", separator: str = "\f") -> DataFrame:
    """(id, page_no, text): pages from 0; a document without a separator is one page."""
    return docs.select(ident, F.posexplode(F.split(content, separator)).alias("page_no", "text"))


def page_text(content: Column, start: Column, end: Column) -> Column:
    return F.substring(content, (start + 1).cast("int"), (end - start).cast("int"))


def indices_json(parser: str, pages: DataFrame, ident: str = "id") -> DataFrame:
    """(id, indices): ``{"extractor": ..., "pages": [[start, end], ...]}``."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "start", "end"))), lambda p: F.array(p["start"], p["end"]))
    return pages.groupBy(ident).agg(F.to_json(F.struct(F.lit(parser).alias("extractor"), pairs.alias("pages"))).alias("indices"))


def parse_indices(text: Column) -> Column:
    return F.from_json(text, "struct<extractor:string,pages:array<array<bigint>>>")


def cached(keys: DataFrame, cache: DataFrame, compute, key: str) -> tuple[DataFrame, DataFrame]:
    """(results, to add to the cache): each distinct key that the cache lacks goes through ``compute`` once, whatever the number of rows that have it."""
    missing = keys.select(key).distinct().join(cache.select(key), key, "left_anti")
    made = compute(missing)
    return keys.join(cache.unionByName(made), key, "left"), made


def of_parsed(docs: DataFrame) -> DataFrame:
    """(id, page_no, text, start, end) of parsed documents with pages."""
    return offsets(docs.select("id", F.posexplode("pages").alias("page_no", "text")))
