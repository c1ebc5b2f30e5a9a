"""Scalar functions over names, paths, types, durations, codes and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA_PREFIX, TAG_PREFIX, ISO_POSTFIX = "tika_metadata_", "tag_", "_iso8601"


def field_name(name: Column, prefix: str = METADATA_PREFIX) -> Column:
    """A metadata key as a field: lower case, anything but letters, digits and ``_`` replaced, prefixed."""
    return F.concat(F.lit(prefix), F.lower(F.regexp_replace(name, "[^A-Za-z0-9_]", "_")))


def base_type(content_type: Column) -> Column:
    """Media type without parameters; what isn't a media type stays as it is."""
    bare = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.when(bare.rlike(r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$"), bare).otherwise(content_type)


def parent_path(path: Column) -> Column:
    """Directory part; empty for a bare name, ``/`` for what lies in the root, and empty for the root itself."""
    clean = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when(clean == "/", "").when(clean.rlike("^/[^/]*$"), "/").when(~clean.contains("/"), "").otherwise(F.regexp_replace(clean, "/[^/]*$", ""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


_UNITS = {"d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000, "ms": 1}


def parse_duration(text: Column) -> Column:
    """Milliseconds of ``500ms``, ``60s``, ``5m``, ``1h``, ``1d`` or a plain number of milliseconds; null for anything else."""
    part = lambda k: F.regexp_extract(text, r"^(\d+)(d|h|m|s|ms)?$", k)
    factors = F.create_map(*(F.lit(x) for pair in {**_UNITS, "": 1}.items() for x in pair))
    return part(1).try_cast("bigint") * factors[part(2)]


def format_duration(millis: Column) -> Column:
    """Whole number of the largest unit that fits at least once. ``millis`` occurs in it nine times: what is costly belongs into a column before."""
    out = F.concat(millis.cast("string"), F.lit("ms"))
    for name, value in sorted(_UNITS.items(), key=lambda x: x[1]):
        if value > 1:
            out = F.when(millis >= value, F.concat(F.call_function("div", millis.cast("bigint"), F.lit(value)).cast("string"), F.lit(name))).otherwise(out)
    return out


def parse_boolean(text: Column, strict: bool = False) -> Column:
    """yes/on/true/1 and no/off/false/0 in any case; null for null, and for anything else null or, if ``strict``, an error."""
    t = F.lower(text)
    known = F.when(t.isin("yes", "on", "true", "1"), True).when(t.isin("no", "off", "false", "0"), False)
    return F.when(text.isNotNull() & known.isNull(), F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")).otherwise(known) if strict else known


def html_escape(text: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def data_uri(content_type: Column, content: Column) -> Column:
    """``data:`` URI: text URL-encoded, anything else in base64."""
    body = F.when(content_type.startswith("text/"), F.concat(F.lit(","), F.url_encode(content.cast("string")))).otherwise(F.concat(F.lit(";base64,"), F.base64(content.cast("binary"))))
    return F.concat(F.lit("data:"), content_type, body)


def replace_tokens(text: Column, opening: str, closing: str, resolved: Column) -> Column:
    """Each ``opening key closing`` replaced by ``resolved[key]`` (a map column); keys that it lacks stay verbatim."""
    import re

    o, c = re.escape(opening), re.escape(closing)
    keys = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{o}(.*?){c}"), F.lit(1)))
    known = F.filter(keys, lambda k: F.coalesce(F.map_contains_key(resolved, k), F.lit(False)))
    return F.aggregate(known, text, lambda acc, k: F.replace(acc, F.concat(F.lit(opening), k, F.lit(closing)), F.element_at(resolved, k)))


def preview(text: Column, limit: int = 100) -> Column:
    """The first characters, and how many there are besides."""
    more = F.length(text) - limit
    return F.when(more > 0, F.concat(F.left(text, F.lit(limit)), F.lit("… ("), more.cast("string"), F.lit(" other characters)"))).otherwise(text)


def preview_list(values: Column, limit: int = 10) -> Column:
    more = F.size(values) - limit
    return F.when(more > 0, F.concat(F.slice(values, 1, limit), F.array(F.concat(F.lit("… ("), more.cast("string"), F.lit(" other values)"))))).otherwise(values)


def preview_warning(text: Column, values: Column) -> Column:
    """Why a value may not fit an index field; measured before it is shortened."""
    return F.when(F.length(text) > 65_535, "long-value").when(F.size(values) > 1000, "many-values")


def restore_ocr_type(content_type: Column) -> Column:
    return F.regexp_replace(content_type, "/ocr-", "/")


def progress_line(embeds: Column, expected: Column, units: Column) -> Column:
    """``embeds/~total embeds (~percent%)``; only the count where the number of units isn't known."""
    known = (expected > 0) & (units > 0)
    total = F.greatest(embeds, F.round(embeds * expected / F.when(known, units)).cast("bigint"))
    pct = F.least(F.lit(100), F.floor(units * 100 / F.when(expected > 0, expected)))
    return F.when(known, F.concat(embeds.cast("string"), F.lit("/~"), total.cast("string"), F.lit(" embeds (~"), pct.cast("string"), F.lit("%)"))).otherwise(F.concat(embeds.cast("string"), F.lit(" embeds")))
