"""Identity: content and path digests, ids of embedded documents, names and places derived from ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALGORITHMS = {"MD5": None, "SHA-1": 1, "SHA-224": 224, "SHA-256": 256, "SHA-384": 384, "SHA-512": 512}


def digest(content: Column, algorithm: str = "SHA-256") -> Column:
    """Lower-case hex digest of a string's UTF-8 bytes or of a binary column."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown digest algorithm {algorithm}")
    if algorithm == "MD5":
        return F.md5(content)
    return F.sha1(content) if algorithm == "SHA-1" else F.sha2(content, ALGORITHMS[algorithm])


def salted_digest(content: Column, project: str, algorithm: str = "SHA-256") -> Column:
    """Digest of the project name's bytes followed by the content's, so that equal contents differ between projects."""
    return digest(F.concat(F.lit(project.encode()), content.cast("binary")), algorithm)


def path_id(path: Column) -> Column:
    return path


def path_digest_id(path: Column, algorithm: str = "SHA-256") -> Column:
    return digest(path, algorithm)


def content_id(content_digest: Column) -> Column:
    return F.lower(content_digest)


def embed_id(content_digest: Column, parent_id: Column, relation: Column, name: Column, algorithm: str = "SHA-256") -> Column:
    """Digest of what is known of an embedded document, in this order; what is null takes no part."""
    return digest(F.concat_ws("", content_digest, parent_id, relation, name), algorithm)


def supplied_id(given: Column, computed: Column) -> Column:
    return F.coalesce(given, computed)


def shorten(ident: Column, n: int) -> Column:
    return F.concat(F.left(ident, F.lit(n)), F.lit("..."), F.right(ident, F.lit(n)))


def is_content_addressable(ident: Column) -> Column:
    """Whether an id can name a place in a store sharded by its first four hex digits."""
    return ident.rlike("^[0-9a-f]{4,}$")


def artifact_path(ident: Column) -> Column:
    """``aa/bb/<id>/raw``; an id that isn't hexadecimal has a flat place of its own, its SHA-256."""
    sharded = F.concat_ws("/", F.substring(ident, 1, 2), F.substring(ident, 3, 2), ident, F.lit("raw"))
    return F.when(is_content_addressable(ident), sharded).otherwise(F.sha2(ident, 256))


def untitled_names(children: DataFrame, parent: str = "parent_id", order: str = "ordinal", name: str = "name", out: str = "name") -> DataFrame:
    """Nameless children get ``untitled_<parent>_<number>``, counted from 0 among the nameless ones of a parent."""
    nameless = F.coalesce(F.trim(F.col(name)), F.lit("")) == ""
    number = F.row_number().over(Window.partitionBy(parent, nameless).orderBy(order)) - 1
    return children.withColumn(out, F.when(nameless, F.concat(F.lit("untitled_"), F.col(parent), F.lit("_"), number)).otherwise(F.col(name)))


def legacy_untitled_names(children: DataFrame, order: list[str], out: str = "name") -> DataFrame:
    """``untitled_<number>`` counted from 1 over everything in ``order``.

    Rows are range-partitioned by the order and numbered from the sizes of the partitions before, so no task sees all rows.
    """
    ranged = children.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = ranged.withColumn("_in_part", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.concat(F.lit("untitled_"), F.col("_in_part") + F.col("_before"))).drop("_part", "_in_part", "_before")


def engine_version(text: Column) -> Column:
    """``struct<major, minor, patch>`` from a version string such as ``Parser 3.2.3``."""
    part = lambda i: F.expr("null").cast("int") if i is None else F.nullif(F.regexp_extract(text, r"(\d+)\.(\d+)(?:\.(\d+))?", i), F.lit("")).cast("int")
    return F.struct(part(1).alias("major"), part(2).alias("minor"), F.coalesce(part(3), F.lit(0)).alias("patch"))


def digests_untranslated(text: Column) -> Column:
    """Whether ids written by this version (3.2.3 or before) stand for the bytes as they lay in the container, not as decoded."""
    v = engine_version(text)
    return (v["major"] < 3) | ((v["major"] == 3) & ((v["minor"] < 2) | ((v["minor"] == 2) & (v["patch"] <= 3))))
