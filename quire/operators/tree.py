"""Trees of embedded documents as adjacency rows: levels, roots, ids, order, guards, losses."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import data_uri, replace_tokens
from ..state import cut, shared_folder
from .filters import too_deep, too_large


def _descend(nodes: DataFrame, key: str, parent: str, root: dict[str, Column], below: dict[str, Column], most: int) -> DataFrame:
    """Rows with the columns of ``root`` for all nodes under a root, placed by one join per level until no node is left.

    ``below`` makes a child's columns from its own (``n.``) and its parent's (``t.``). Where each node has one row, whatever hangs from a root ends by itself, at any
    depth; only with repeated keys it can go round for ever, and then more than ``most`` levels are refused.
    """
    spark, folder = nodes.sparkSession, f"{shared_folder(nodes.sparkSession)}/tree-{uuid.uuid4().hex}"
    nodes = cut(nodes)

    def kept(step: DataFrame, level: int) -> tuple[DataFrame, int]:
        """A level, written once, and its number of rows. Its size is known from then on, so that Spark sends a small one to all tasks and sorts for a large one."""
        seen = Observation()
        step.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/{level}")
        return spark.read.schema(step.schema).parquet(f"{folder}/{level}"), seen.get["n"]

    level = 0
    step, n = kept(nodes.where(F.col(parent).isNull()).select(*[c.alias(k) for k, c in root.items()]), 0)
    while n:
        level += 1
        if level == most + 1 and nodes.groupBy(key).count().where(F.col("count") > 1).where(F.col(key).isNotNull()).limit(1).count():
            raise ValueError(f"more than {most} levels among nodes with repeated keys")
        step, n = kept(step.alias("t").join(nodes.alias("n"), F.col(f"n.{parent}") == F.col(f"t.{key}")).select(*[c.alias(k) for k, c in below.items()]), level)
    return spark.read.schema(step.schema).parquet(f"{folder}/*")


def levels(nodes: DataFrame, ident: str = "id", parent: str = "parent_id", most: int = 100, ordinal: str | None = None) -> DataFrame:
    """(id, root_id, level, trail): level 0 for roots; trail is the array of ids from the root. With ``ordinal``, the column of a node's place among its siblings, also
    ``position``: the array of (place, id) from the root, by which ``depth_first`` sorts.

    One join per level with the nodes not yet placed, to any depth (``most``: see ``_descend``). Nodes on a cycle have no root and don't come out.
    """
    own = nodes.select(F.col(ident).cast("string").alias("id"), F.col(parent).cast("string").alias("parent_id"), *([F.col(ordinal).cast("bigint").alias("place")] if ordinal else []))
    root = {"id": F.col("id"), "root_id": F.col("id"), "level": F.lit(0), "trail": F.array("id")}
    below = {"id": F.col("n.id"), "root_id": F.col("t.root_id"), "level": F.col("t.level") + 1, "trail": F.concat("t.trail", F.array("n.id"))}
    if ordinal:
        root["position"] = F.array(F.struct("place", "id"))
        below["position"] = F.concat("t.position", F.array(F.struct("n.place", "n.id")))
    return _descend(own, "id", "parent_id", root, below, most)


def recursive_ids(nodes: DataFrame, key: str = "key", parent: str = "parent_key", most: int = 100) -> DataFrame:
    """(key, id, root_id, level) with ids that depend on the parents' ids: for a root its content digest, below it the SHA-256 of what is known of
    (digest, parent id, relation, name).

    ``nodes`` has the columns key, parent_key, digest, relation, name.
    """
    own = nodes.select(F.col(key).alias("key"), F.col(parent).alias("parent_key"), "digest", "relation", "name")
    root = {"key": F.col("key"), "id": F.lower("digest"), "root_id": F.lower("digest"), "level": F.lit(0)}
    below = {"key": F.col("n.key"), "id": F.sha2(F.concat_ws("", "n.digest", "t.id", "n.relation", "n.name"), 256), "root_id": F.col("t.root_id"), "level": F.col("t.level") + 1}
    return _descend(own, "key", "parent_key", root, below, most)


def folder_paths(folders: DataFrame, ident: str = "id", parent: str = "parent_id", name: str = "name", most: int = 100) -> DataFrame:
    """(id, path): names from the root, which is ``/``; ``?`` stands for a name that can't be read. A root is a folder without a parent, or its own parent; cycles don't come out."""
    own = folders.select(F.col(ident).alias("id"), F.when(F.col(parent) != F.col(ident), F.col(parent)).alias("parent_id"), F.coalesce(F.col(name), F.lit("?")).alias("name"))
    below = {"id": F.col("n.id"), "path": F.concat("t.path", F.lit("/"), "n.name")}
    placed = _descend(own, "id", "parent_id", {"id": F.col("id"), "path": F.lit("")}, below, most)
    return placed.select("id", F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"))


def depth_first(placed: DataFrame, order: Column | str | None = None) -> DataFrame:
    """Rows in pre-order: a root, then each child with all below it; siblings by their ordinals where ``levels`` was given these, else by id. Sorting is a range partitioning, no tree is built."""
    return placed.orderBy(order if order is not None else "position" if "position" in placed.columns else "trail")


def numbered_depth_first(placed: DataFrame) -> DataFrame:
    """``placed`` with ``n``, each row's number in pre-order over all trees from 0, counted from the sizes of the sorted partitions, so that no task sees all rows."""
    key = "position" if "position" in placed.columns else "trail"
    ranged = cut(placed.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition
    return ranged.join(F.broadcast(sizes.withColumn("_before", before)), "_part").withColumn("n", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_n", "_first", "_before")


def parents(nodes: DataFrame, fields: list[str], key: str = "id", parent: str = "parent_id", prefix: str = "parent_") -> DataFrame:
    """``nodes`` that have a parent, with some of its fields, prefixed. Roots don't come out, nor do nodes whose parent is missing."""
    above = nodes.select(F.col(key).alias("_key"), *[F.col(f).alias(prefix + f) for f in fields])
    return nodes.join(above, F.col(parent) == F.col("_key")).drop("_key")


def without_embeds(tree: DataFrame, level: str = "level") -> DataFrame:
    """Roots only: what is left of trees when embedded documents are ignored."""
    return tree.where(F.col(level) == 0)


def visit(tree: DataFrame, root: str, ident: str = "id", root_id: str = "root_id") -> DataFrame:
    """A root and all below it, for whatever is to be done with each."""
    return tree.where((F.col(root_id) == root) | (F.col(ident) == root))


def gate(docs: DataFrame, ident: str = "id", root: str = "root_id", path: str = "path", level: str = "level") -> DataFrame:
    """Whole trees of which each root's id stands once: of files with equal content the one with the least path keeps its tree, the others go with everything embedded in them.

    Only ids and paths are compared; (root, path) pairs of the others are taken out by an anti-join, and nothing is shuffled for it where they are few.
    """
    roots = docs.where(F.col(level) == 0).select(F.col(ident).alias("_root"), F.col(path).alias("_path"))
    first = roots.groupBy("_root").agg(F.min("_path").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    others = roots.join(first, "_root").where("_path > _first").select("_root", "_path").distinct()
    return docs.join(others, (F.col(root) == F.col("_root")) & (F.col(path) == F.col("_path")), "left_anti")


def guard(children: DataFrame, max_depth: int = 20, max_bytes: int = 0, level: str = "level", declared: str = "declared_length") -> DataFrame:
    """``children`` with the column ``refused``: ``depth``, ``size`` or null. The deeper rule comes first."""
    return children.withColumn("refused", F.when(too_deep(F.col(level), max_depth), "depth").when(too_large(F.col(declared).cast("string"), max_bytes), "size"))


def skip_counts(guarded: DataFrame, parent: str = "parent_id") -> DataFrame:
    """(parent, skipped_depth, skipped_size) of the parents that lost children."""
    return guarded.where("refused is not null").groupBy(parent).agg(F.count_if(F.col("refused") == "depth").alias("skipped_depth"), F.count_if(F.col("refused") == "size").alias("skipped_size"))


def without_duplicate_roots(tree: DataFrame, ident: str = "id", root: str = "root_id") -> DataFrame:
    """Without the embedded documents of roots marked as duplicates; the roots themselves stay."""
    dup = tree.where("level = 0 and is_duplicate").select(F.col(ident).alias(root))
    return tree.where("level = 0").unionByName(tree.where("level > 0").join(dup, root, "left_anti").select(*tree.columns))


def child_counts(tree: DataFrame, root: str = "root_id") -> DataFrame:
    """(root_id, n_children): embedded documents of each root, 0 where there is none."""
    return tree.groupBy(root).agg(F.count_if(F.col("level") > 0).alias("n_children"))


def concatenate(children: DataFrame, parent: str, ordinal: str, text: str, name: Column | None = None) -> DataFrame:
    """(parent, content): children's texts in their order within their parent's; with ``name`` each in a ``package-entry`` block under its name."""
    block = F.coalesce(F.col(text), F.lit("")) if name is None else F.concat(F.lit('<div class="package-entry"><h1>'), name, F.lit("</h1>"), F.coalesce(F.col(text), F.lit("")), F.lit("</div>"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), block.alias("t"))))
    return children.groupBy(parent).agg(ordered.alias("c")).select(parent, F.array_join(F.transform("c", lambda x: x["t"]), "\n").alias("content"))


def recover_orphans(descriptors: DataFrame, emitted: DataFrame, folders: DataFrame, ident: str = "id", folder: str = "folder_id") -> DataFrame:
    """Messages that were listed and not emitted, with their folder's path, or ``/[recovered]`` where that is unknown."""
    lost = descriptors.join(emitted.select(ident), ident, "left_anti")
    return lost.join(folders.select(F.col("id").alias(folder), F.col("path").alias("_path")), folder, "left").select(ident, folder, F.coalesce("_path", F.lit("/[recovered]")).alias("path"))


def emitted_once(emissions: DataFrame, ident: str = "id", order: str = "attempt") -> DataFrame:
    """The first successful emission of each descriptor; failed ones leave it open for another attempt."""
    return emissions.where("ok").withColumn("_n", F.row_number().over(Window.partitionBy(ident).orderBy(order))).where("_n = 1").drop("_n")


def reconcile(expected: DataFrame, emitted: DataFrame, key: str) -> DataFrame:
    """(key, expected, emitted, failed): failed is what is missing, at least 0; all but ``emitted`` are null where nothing could be counted beforehand."""
    e = expected.groupBy(key).agg(F.sum("expected").alias("expected"))
    m = emitted.groupBy(key).agg(F.count("*").alias("emitted"))
    both = e.join(m, key, "full")
    n = F.coalesce("emitted", F.lit(0))
    return both.select(key, "expected", n.alias("emitted"), F.greatest(F.lit(0), F.col("expected") - n).alias("failed"), F.when(F.col("expected").isNull(), "unknown").when(F.col("expected") <= n, "complete").otherwise("incomplete").alias("state"))


def attachment_losses(attachments: DataFrame, key: str) -> DataFrame:
    """Counts by key of attachments that were truncated or unreadable: recovered, unrecovered, encrypted."""
    broken = F.col("state").isin("truncated", "unreadable")
    return attachments.groupBy(key).agg(
        F.count("*").alias("attachments"), F.count_if(broken).alias("broken"), F.count_if(broken & F.col("recovered")).alias("recovered"),
        F.count_if(broken & ~F.col("recovered") & ~F.col("encrypted")).alias("unrecovered"), F.count_if(broken & F.col("encrypted") & ~F.col("recovered")).alias("encrypted"),
    )


class ContentNotFound(Exception):
    pass


def resolve(artifacts: DataFrame, ident: str, parse_root) -> DataFrame:
    """The embedded document with an id: from the artifact table, or, if it isn't there, from ``parse_root()``, which parses its root again (``sources.parsers.find_embedded`` stops at the document). ``ContentNotFound`` if neither has it."""
    found = artifacts.where(F.col("id") == ident).limit(1)
    if found.isEmpty():
        found = parse_root().where(F.col("id") == ident).limit(1)
        if found.isEmpty():
            raise ContentNotFound(ident)
    return found


def inline_embeds(docs: DataFrame, artifacts: DataFrame, opening: str = "embedded:", closing: str = ":", ident: str = "id", content: str = "content") -> DataFrame:
    """``docs`` with links to their embedded documents (``opening`` name ``closing``) replaced by ``data:`` URIs; links to what isn't there stay.

    ``artifacts`` has (parent_id, name, content_type, raw). Only documents that have any are rewritten.
    """
    uri = data_uri(F.col("content_type"), F.col("raw"))
    known = artifacts.groupBy("parent_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.regexp_replace(uri, "[\r\n]", "").alias("uri")))).alias("_known"))
    joined = docs.join(known.withColumnRenamed("parent_id", "_parent"), F.col(ident) == F.col("_parent"), "left")
    return joined.withColumn(content, F.when(F.col("_known").isNull(), F.col(content)).otherwise(replace_tokens(F.col(content), opening, closing, F.col("_known")))).drop("_known", "_parent")
