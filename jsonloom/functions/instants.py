"""Reading moments of time that are spelled in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jsonloom.functions.text import bound

# The months of RFC 2822 dates, in order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

ISO = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?) ?(Z|z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(Z|z|[+-]\d{2}:?\d{2})?$"
MAIL = (
    r"^(?:[A-Za-z]{3},? +)?(\d{1,2}) +([A-Za-z]{3})[a-z]* +(\d{4}) +(\d{2}:\d{2}(?::\d{2})?)"
    r" *(Z|UTC?|GMT|[+-]\d{4}|[+-]\d{2}:\d{2})?(?: *\(.*\))?$"
)


def _zone(z: Column) -> Column:
    short = F.regexp_replace(z, ":", "")
    return F.when(z.rlike(r"^[+-]"), F.concat(F.substring(short, 1, 3), F.lit(":"), F.rpad(F.substring(short, 4, 2), 2, "0"))).otherwise(
        F.lit("Z")
    )


def _seconds(date: Column, clock: Column, zone: Column) -> Column:
    full = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(F.regexp_replace(clock, ",", "."))
    iso = F.concat(date, F.lit("T"), full, _zone(zone))
    return F.unix_seconds(iso.try_cast("timestamp"))


def instant_seconds(c: Column) -> Column:
    """Whole seconds since 1970-01-01 UTC of a written moment; without a stated zone it is UTC.

    Reads ISO 8601 (with blank or T, fractions, zones), its compact form, RFC 2822 dates, and epoch
    seconds or milliseconds. NULL for anything else, also for dates that don't exist and times
    without a date. Doesn't depend on the session's time zone."""
    return bound(F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " ")), _read)


def _read(text: Column) -> Column:
    def part(pattern: str, n: int) -> Column:
        return F.regexp_extract(text, pattern, n)

    def mail(place: Column) -> Column:
        month = F.lpad(((place + 2) / 3).cast("int").cast("string"), 2, "0")
        date = F.concat_ws("-", part(MAIL, 3), month, F.lpad(part(MAIL, 1), 2, "0"))
        return F.when(place % 3 == 1, _seconds(date, part(MAIL, 4), part(MAIL, 5)))

    compact_date = F.concat_ws("-", part(COMPACT, 1), part(COMPACT, 2), part(COMPACT, 3))
    compact_clock = F.concat_ws(":", part(COMPACT, 4), part(COMPACT, 5), part(COMPACT, 6))
    return (
        F.when(text.rlike(ISO), _seconds(part(ISO, 1), part(ISO, 2), part(ISO, 3)))
        .when(text.rlike(r"^\d{9,10}(\.\d+)?$"), F.substring_index(text, ".", 1).try_cast("bigint"))
        .when(text.rlike(r"^\d{12,13}$"), F.floor(text.try_cast("bigint") / F.lit(1000)).cast("bigint"))
        .when(text.rlike(COMPACT), _seconds(compact_date, compact_clock, part(COMPACT, 7)))
        .when(text.rlike(MAIL), bound(F.instr(F.lit(MONTHS), F.lower(part(MAIL, 2))), mail))
    )
