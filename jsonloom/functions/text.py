"""String helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row. Spark copies an expression to each place of its use, also
    into filters and join keys; a lambda's variable keeps what is planned small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_form(c: Column) -> Column:
    """Lower case, outer white space removed, inner runs of it as one blank. NULL if nothing is left."""
    text = F.trim(F.lower(F.regexp_replace(c.cast("string"), WHITE, " ")))
    return F.nullif(text, F.lit(""))


def denoted_number(c: Column) -> Column:
    """The whole number a text denotes, as BIGINT, in any spelling: leading zeros, sign, exponent, a
    fraction of zeros, white space around it. NULL for every other text, a number with a fraction and
    a number beyond BIGINT. Decided on the digits as written; nothing is rounded."""

    def spelled(text: Column) -> Column:
        fraction = F.regexp_extract(text, r"\.([0-9]*)", 1)
        digits = F.ltrim(F.concat(F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), fraction), F.lit("0"))
        core = F.rtrim(digits, F.lit("0"))
        exponent = F.when(text.rlike("[eE]"), F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int")).otherwise(0)
        zeros = F.length(digits) - F.length(core) + exponent.cast("bigint") - F.length(fraction)  # behind the last other digit
        value = F.concat(F.when(text.startswith("-"), "-").otherwise(""), core, F.repeat(F.lit("0"), zeros.cast("int")))
        fits = zeros.between(0, 18) & (F.length(core) <= 19)
        return F.when(core == "", F.lit(0).cast("bigint")).when(fits, value.try_cast("decimal(38,0)").try_cast("bigint"))

    def read(text: Column) -> Column:
        plain = F.when(text.rlike(r"^[0-9]{1,18}$"), text.try_cast("bigint"))
        number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        return F.coalesce(plain, F.when(number, spelled(text)))

    return bound(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), read)
