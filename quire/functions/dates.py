"""Dates as found in metadata, brought to ISO-8601 instants, by expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO_DATE = r"^[+-]?\d{4,9}-\d{2}-\d{2}$"
_ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:\d{2}){0,2})?$"


def _try(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def parse_instant(text: Column) -> Column:
    """Strict ISO: instant, date-time with offset, date-time (as UTC), date (midnight UTC). The shape is tested first, as the parser by itself takes much more."""
    return F.when(text.rlike(_ISO_TIME) | text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text))


def parse_compact(text: Column) -> Column:
    """17, 14, 12 or 8 digits: year to milliseconds, seconds, minutes or days."""
    size = F.length(text)
    digits = text.rlike(r"^\d+$")
    return (
        F.when(digits & (size == 17), _try(F.concat(F.left(text, F.lit(14)), F.lit("."), F.right(text, F.lit(3))), "yyyyMMddHHmmss.SSS"))
        .when(digits & (size == 14), _try(text, "yyyyMMddHHmmss"))
        .when(digits & (size == 12), _try(text, "yyyyMMddHHmm"))
        .when(digits & (size == 8), _try(text, "yyyyMMdd"))
    )


def parse_epoch(text: Column) -> Column:
    """At least 13 digits: milliseconds; 10 to 12: seconds. Only the years 1970 to 2100 count."""
    number = F.when(text.rlike(r"^\d{10,18}$"), text.try_cast("bigint"))
    seconds = F.when(F.length(text) >= 13, number / 1000.0).otherwise(number.cast("double"))
    inside = (seconds >= 0) & (seconds < 4133980800)  # 2101-01-01
    return F.when(inside, F.when(F.length(text) >= 13, F.timestamp_millis(F.when(inside, number))).otherwise(F.timestamp_seconds(F.when(inside, number))))


def parse_fallback(text: Column) -> Column:
    """Other written forms: RFC 1123, ``EEE MMM d HH:mm:ss yyyy`` (as UTC), compact digits, epoch numbers; blanks around and between don't count."""
    t = F.regexp_replace(F.trim(text), r"\s+", " ")
    bare = F.regexp_replace(t, r"^[A-Za-z]{3},? ", "")
    return F.coalesce(
        F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{1,4}$"), _try(bare, "d MMM yyyy HH:mm:ss z")),
        F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), _try(bare, "d MMM yyyy HH:mm:ss Z")),
        F.when(bare.rlike(r"^[A-Za-z]{3} \d{1,2} \d{2}:\d{2}:\d{2} \d{4}$"), _try(bare, "MMM d HH:mm:ss yyyy")),
        parse_compact(t),
        parse_epoch(t),
    )


def format_instant(ts: Column) -> Column:
    """ISO instant in UTC; a fraction only where there is one, in groups of three digits; ``+`` before years beyond 9999."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, "").when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.when((F.year(ts) > 9999) & ~base.startswith("+"), "+").otherwise(""), base, fraction, F.lit("Z"))


def normalise_date(text: Column) -> Column:
    """What a date property's companion field holds: a date without a time (with or without offset) is noon UTC, any other ISO form its instant, else the fallback forms; null if none fits."""
    t = F.trim(text)
    day = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(Z|[+-]\d{2}:\d{2})?$", 1)
    noon = F.when(day != "", F.try_to_timestamp(F.concat(day, F.lit("T12:00:00Z"))))
    far = F.when(t.rlike(r"^\d{5,6}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.try_to_timestamp(F.concat(F.lit("+"), t)))
    return format_instant(F.coalesce(noon, parse_instant(t), far, parse_fallback(t)))


def multi_date(values: Column) -> Column:
    """An array of dates: instants if every value is strict ISO, else null (the values are then joined as they are)."""
    return F.when(F.forall(values, lambda v: parse_instant(v).isNotNull()), F.transform(values, lambda v: format_instant(parse_instant(v))))
