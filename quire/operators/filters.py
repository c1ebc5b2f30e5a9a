"""Predicates over paths, metadata, embedded documents and log lines, as Column expressions that Catalyst can push down."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import any_glob, matches
from ..functions.text import METADATA_PREFIX

SYSTEM_FILES = (".DS_Store", ".AppleDouble", ".Spotlight-V100", ".Trashes", "._.", ".fseventsd", "lost+found", "Thumbs.db", "$RECYCLE.BIN", "._.lost+found")

#: Metadata fields that are left out, by glob on the field name: raw headers, vendors' own fields, unknown tags.
BLOCKED_FIELDS = tuple(METADATA_PREFIX + rest for rest in ("message_raw_header__", "message_raw_header_?_*", "message_raw_header_[123456789]*", "xmpmm_*", "mboxparser_*", "unknown_tag_*", "custom_*"))


def include(path: Column, globs: Iterable[str]) -> Column:
    """Whether a file is wanted: any glob matches its full path, or there is none."""
    globs = list(globs)
    return matches(path, globs) if globs else F.lit(True)


def exclude(path: Column, globs: Iterable[str]) -> Column:
    """Whether a path is left out: any glob matches it or one of the directories it lies in."""
    globs = list(globs)
    if not globs:
        return F.lit(False)
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.exists(above, lambda p: p.rlike(any_glob(globs)))


def hidden(path: Column) -> Column:
    """Whether any element of the path starts with a dot."""
    return F.exists(F.split(path, "/"), lambda n: n.startswith(".") & ~n.isin(".", ".."))


def system(path: Column) -> Column:
    """Whether any element of the path is a file or directory that operating systems make for themselves."""
    return F.exists(F.split(path, "/"), lambda n: n.isin(*SYSTEM_FILES) | n.startswith("._"))


def depth(path: Column, root: str) -> Column:
    """Levels below ``root``; its direct children have 1."""
    rest = F.regexp_replace(F.substring(path, len(root.rstrip("/")) + 1, 1 << 20), "^/+", "")
    return F.size(F.split(rest, "/+"))


def wanted(paths: DataFrame, include_globs: Iterable[str] = (), exclude_globs: Iterable[str] = (), ignore_hidden: bool = False, ignore_system: bool = True, path: str = "path") -> DataFrame:
    p = F.col(path)
    keep = include(p, include_globs) & ~exclude(p, exclude_globs)
    if ignore_hidden:
        keep = keep & ~hidden(p)
    if ignore_system:
        keep = keep & ~system(p)
    return paths.where(keep)


def blocked_field(field: Column, globs: Iterable[str] = BLOCKED_FIELDS) -> Column:
    return matches(field, globs)


def too_deep(level: Column, most: int = 20) -> Column:
    """Whether an embedded document lies deeper than allowed; no limit at 0 or below."""
    return level > most if most > 0 else F.lit(False)


def too_large(declared: Column, most: int) -> Column:
    """Whether a declared length is above the limit. What isn't an integer is let through, what has more than 38 digits isn't; no limit at 0 or below."""
    if most <= 0:
        return F.lit(False)
    t = F.trim(declared)
    whole = t.rlike(r"^[+-]?[0-9]+$")
    value = F.when(whole, t.try_cast("decimal(38,0)"))
    return F.coalesce(F.when(whole & value.isNull(), ~t.startswith("-")).otherwise(value > most), F.lit(False))


def ocr_eligible(content_type: Column, resource_type: Column, declared: Column, least_bytes: int = 0) -> Column:
    """Images that aren't inline resources and, if they say so, aren't smaller than worth while."""
    length = F.when(F.trim(declared).rlike(r"^\d+$"), F.trim(declared).try_cast("bigint"))
    return F.coalesce(content_type.startswith("image/"), F.lit(False)) & (F.coalesce(resource_type, F.lit("")) != "INLINE") & F.coalesce(length >= least_bytes, F.lit(True))


NOISE = ("found wrong object number", "No Unicode mapping", "No current font", "Using fallback font")


def log_noise(logger: Column, level: Column, message: Column) -> Column:
    """Log lines below ERROR in which the PDF and font libraries complain about single glyphs and objects. A line without a logger or a message is none."""
    theirs = logger.startswith("org.apache.pdfbox") | logger.startswith("org.apache.fontbox")
    about = F.exists(F.array(*map(F.lit, NOISE)), lambda n: F.contains(message, n))
    return F.coalesce(theirs & ~level.isin("ERROR", "FATAL") & about, F.lit(False))
