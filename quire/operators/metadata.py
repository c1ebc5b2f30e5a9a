"""Normalising free-form metadata: many keys, each with many values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import multi_date, normalise_date
from ..functions.globs import any_glob
from ..functions.text import ISO_POSTFIX, METADATA_PREFIX, TAG_PREFIX, base_type, field_name, parent_path
from .filters import BLOCKED_FIELDS

#: Keys, in lower case, whose repeated values mean nothing.
DISTINCT_KEYS = ("content-type", "dc:title", "title", "originator", "generator", "progid")
#: Keys that hold dates, as they are written.
DATE_KEYS = ("dc:date", "dcterms:created", "dcterms:modified", "exif:DateTimeOriginal", "meta:creation-date", "meta:print-date", "meta:save-date", "pdf:docinfo:created", "pdf:docinfo:modified")


def exploded(docs: DataFrame, ident: str = "id", metadata: str = "metadata") -> DataFrame:
    """(id, name, values) for each key."""
    return docs.select(ident, F.explode(metadata).alias("name", "values"))


def cleaned_values(name: Column, values: Column) -> Column:
    """Values without null and empty ones; of ``title`` only the first; of some keys each value once."""
    some = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    some = F.when(name == "title", F.slice(some, 1, 1)).otherwise(some)
    return F.when(F.lower(name).isin(*DISTINCT_KEYS), F.array_distinct(some)).otherwise(some)


def normalise(pairs: DataFrame, ident: str = "id", prefix: str = METADATA_PREFIX, blocked: Iterable[str] = BLOCKED_FIELDS) -> DataFrame:
    """(id, field, name, values) from (id, name, values): keys that become the same field are one, values in the order of the keys; blocked and empty fields are left out."""
    field = field_name(F.col("name"), prefix)
    named = pairs.select(ident, "name", field.alias("field"), cleaned_values(F.col("name"), F.col("values")).alias("values")).where(F.size("values") > 0)
    blocked = list(blocked)
    if blocked:
        named = named.where(~F.col("field").rlike(any_glob(blocked)))
    grouped = named.groupBy(ident, "field").agg(F.array_sort(F.collect_list(F.struct("name", "values"))).alias("g"))
    return grouped.select(ident, "field", F.element_at("g", 1)["name"].alias("name"), F.flatten(F.transform("g", lambda x: x["values"])).alias("values"))


def with_dates(fields: DataFrame, ident: str = "id", keys: Iterable[str] = DATE_KEYS) -> DataFrame:
    """Adds ``<field>_iso8601`` for date keys with one value that can be read, and turns arrays of strict ISO dates into instants.

    (id, field, value, values): ``value`` for a single value or a joined array, ``values`` for an array.
    """
    is_date = F.col("name").isin(*keys)
    one = F.size("values") == 1
    first = F.element_at("values", 1)
    dates = multi_date(F.col("values"))
    plain = fields.select(ident, "field", F.when(one, first).when(is_date & dates.isNull(), F.array_join("values", ",")).alias("value"), F.when(~one & is_date, dates).when(~one, F.col("values")).alias("values"))
    iso = fields.where(is_date & one).select(ident, F.concat("field", F.lit(ISO_POSTFIX)).alias("field"), normalise_date(first).alias("value"), F.expr("cast(null as array<string>)").alias("values")).where("value is not null")
    return plain.unionByName(iso)


def as_map(fields: DataFrame, ident: str = "id") -> DataFrame:
    """(id, metadata) as one map for each document; fields are unique by then, so no key repeats."""
    value = F.coalesce("values", F.array("value"))
    return fields.groupBy(ident).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("field"), value.alias("v"))))).alias("metadata"))


def as_json(metadata: Column) -> Column:
    """All keys as they were found, each with an array."""
    return F.to_json(metadata)


def parse_sidecar(text: Column, strip_prefix: bool = True) -> Column:
    """The inverse of ``as_json``; with ``strip_prefix`` keys lose the field prefix."""
    parsed = F.from_json(text, "map<string,array<string>>")
    return F.transform_keys(parsed, lambda k, _: F.regexp_replace(k, f"^{METADATA_PREFIX}", "")) if strip_prefix else parsed


def parse_tags(pairs: Iterable[str]) -> dict[str, str]:
    """``name:value`` pairs, split at the first colon."""
    out = {}
    for pair in pairs:
        name, colon, value = pair.partition(":")
        if not colon or not name:
            raise ValueError(f"not a tag: {pair}")
        out[name] = value
    return out


def with_tags(docs: DataFrame, tags: dict[str, str]) -> DataFrame:
    return docs.withColumns({TAG_PREFIX + k: F.lit(v) for k, v in tags.items()}) if tags else docs


def structural(docs: DataFrame) -> DataFrame:
    """The fields that every index record has: id, root, parent, level, path, parent path, base type and text."""
    return docs.select("id", "root_id", F.when(F.col("level") > 0, F.col("parent_id")).alias("parent_id"), "level", "path", F.nullif(parent_path(F.col("path")), F.lit("")).alias("parent_path"), base_type(F.col("content_type")).alias("base_type"), "content")
