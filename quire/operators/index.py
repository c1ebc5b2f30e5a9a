"""Bulk jobs over an index, that is, a table of documents by id: sets, tags, copies, ids, merges, deletions.

All of them are joins and projections without hints; Spark broadcasts a side when it has seen that it is small and sorts otherwise.
Only ids go into the set operations, so no content is shuffled for them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import digest
from ..functions.text import parent_path

MISMATCH = "ERROR:SCHEMA-INDEX-MISMATCH,stringValue="


def tag(docs: DataFrame, literals: Mapping[str, str], ident: str = "id", condition: Column | None = None) -> DataFrame:
    """(id, literals...) for every document that meets the condition."""
    return (docs if condition is None else docs.where(condition)).select(ident, *[F.lit(v).alias(k) for k, v in literals.items()])


def intersection(a: DataFrame, b: DataFrame, literals: Mapping[str, str], ident: str = "id", condition: Column | None = None) -> DataFrame:
    """Tags for the documents of ``a`` whose id ``b`` has."""
    return tag((a if condition is None else a.where(condition)).join(b.select(ident), ident, "left_semi"), literals, ident)


def complement(a: DataFrame, b: DataFrame, literals: Mapping[str, str], ident: str = "id", condition: Column | None = None) -> DataFrame:
    """Tags for the documents of ``a`` whose id ``b`` lacks."""
    return tag((a if condition is None else a.where(condition)).join(b.select(ident), ident, "left_anti"), literals, ident)


def copy_fields(docs: DataFrame, mapping: Mapping[str, str | None], ident: str = "id") -> DataFrame:
    """Fields under other names (or, without one, their own), freed from what a schema mismatch put before the value. ``field_*`` copies all fields that start so."""
    out = []
    for source, target in mapping.items():
        names = [c for c in docs.columns if c.startswith(source[:-1])] if source.endswith("*") else [source]
        for name in names:
            new = (target[:-1] + name[len(source) - 1 :] if target and target.endswith("*") else target) or name
            value = F.col(name)
            out.append((F.regexp_replace(value, "^" + MISMATCH, "") if dict(docs.dtypes)[name] == "string" and name != ident else value).alias(new))
    return docs.select(ident, *[c for c in out])


def rehash(docs: DataFrame, pattern: str, replacement: str, ident: str = "id", path: str = "path", algorithm: str = "SHA-256") -> DataFrame:
    """Documents whose id changes as a regular expression rewrites their paths: the new path and parent path, its upper-case digest as id, and ``old_id``, the one to delete."""
    moved = docs.withColumn("old_id", F.col(ident)).withColumn(path, F.regexp_replace(path, pattern, replacement))
    return moved.withColumn("parent_path", parent_path(F.col(path))).withColumn(ident, F.upper(digest(F.col(path), algorithm))).where(F.col(ident) != F.col("old_id"))


def apply_rehash(docs: DataFrame, pattern: str, replacement: str, **options) -> DataFrame:
    """The index after ``rehash``: new rows instead of the old ones. A projection, as each row has all that it takes."""
    ident, path, algorithm = options.get("ident", "id"), options.get("path", "path"), options.get("algorithm", "SHA-256")
    new_path = F.regexp_replace(path, pattern, replacement)
    return docs.withColumns({ident: F.upper(digest(new_path, algorithm)), path: new_path})


def delete(docs: DataFrame, condition: Column | None = None, ids: list[str] | DataFrame | None = None, ident: str = "id") -> DataFrame:
    """What is left after deleting by query, by ids, or, with neither, everything. Rows for which the condition is null stay."""
    if condition is None and ids is None:
        return docs.limit(0)
    if condition is not None:
        docs = docs.where(~F.coalesce(condition, F.lit(False)))
    if isinstance(ids, DataFrame):
        return docs.join(ids.select(ident), ident, "left_anti")
    return docs.where(~F.coalesce(F.col(ident).isin(*ids), F.lit(False))) if ids else docs


def merge_paths(docs: DataFrame, ident: str = "id", path: str = "path", name: str | None = None) -> DataFrame:
    """One row for each id, with the sorted sets of paths, parent paths and resource names under which it was seen."""
    sets = [F.sort_array(F.collect_set(path)).alias("paths"), F.sort_array(F.collect_set(parent_path(F.col(path)))).alias("parent_paths")]
    if name:
        sets.append(F.sort_array(F.collect_set(name)).alias("names"))
    return docs.groupBy(ident).agg(*sets, F.count("*").alias("n_seen"))


def merge_into(old: DataFrame, new: DataFrame, ident: str = "id", atomic: bool = True, sets: tuple[str, ...] = ()) -> DataFrame:
    """The index with ``new`` merged in: atomic writes keep fields that aren't sent (null), the others replace the row. ``sets`` are array fields that are united.

    A full outer join on the id; several new rows of an id must have been merged before (``merge_paths``, ``report latest``).
    """
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{ident}") == F.col(f"n.{ident}"), "full")
    sent = F.col(f"n.{ident}").isNotNull()

    def field(c: str) -> Column:
        before = F.col(f"o.{c}") if c in old.columns else F.lit(None)
        after = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c == ident:
            return F.coalesce(after, before).alias(c)
        if c in sets and c in old.columns and c in new.columns:
            return F.coalesce(F.sort_array(F.array_union(before, after)), before, after).alias(c)
        return (F.coalesce(after, before) if atomic else F.when(sent, after).otherwise(before)).alias(c)

    return joined.select(*[field(c) for c in dict.fromkeys([*old.columns, *new.columns])])


def replace_children(old: DataFrame, new: DataFrame, ident: str = "id", root: str = "root_id", level: str = "level") -> DataFrame:
    """The index after writing whole trees again: embedded documents of the roots that come are dropped first, then everything new replaces its id."""
    roots = new.where(F.col(level) == 0).select(F.col(ident).alias(root)).distinct()
    kids = old.where(F.col(level) >= 1).join(roots, root, "left_anti").select(*old.columns)
    kept = old.where(F.col(level) == 0).unionByName(kids).join(new.select(ident), ident, "left_anti").select(*old.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def first_of_each(docs: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def duplicates_removed(docs: DataFrame, key: str) -> DataFrame:
    """(removed, left) if one row of each key stays."""
    return docs.agg((F.count(key) - F.count_distinct(key)).alias("removed"), F.count_distinct(key).alias("left"))


def remove_n(docs: DataFrame, key: str, value, n: int, order: list[str]) -> DataFrame:
    """Without the first ``n`` rows of a value; without any of them for 0."""
    same = F.col(key).eqNullSafe(F.lit(value))
    if n == 0:
        return docs.where(~same)
    numbered = docs.where(same).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") > n).drop("_n")
    return docs.where(~same).unionByName(numbered)


def page(docs: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of a total order, for display; jobs read the whole table instead."""
    return docs.orderBy(*order).offset(offset).limit(limit)


def scan(docs: DataFrame, condition: Column | str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Documents that match, with some of their fields (``prefix*`` stands for several); both reach the file scan."""
    out = docs if condition is None else docs.where(condition)
    if not fields:
        return out
    names = [c for f in fields for c in ([n for n in docs.columns if n.startswith(f[:-1])] if f.endswith("*") else [f])]
    return out.select(*dict.fromkeys(names))
