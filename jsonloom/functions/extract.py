"""Kinds and typed extraction of VARIANT values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from jsonloom.functions.numbers import number_kind, number_text
from jsonloom.functions.text import bound
from jsonloom.kinds import ACCEPTS, SQL_TYPE


WHOLE = 9_007_199_254_740_992.0  # 2^53: doubles from here on have no fraction, and may be rounded
_TEXTS = ("STRING", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "BINARY")


def kind_of(v: Column) -> Column:
    """The narrowest kind of a VARIANT: whole numbers by range; fractions are float or double where the
    shortest text of one is the very number, else bigdec. Dates, times and bytes are strings, as in JSON.
    NULL for SQL NULL (a missing value).

    VARIANT reads a number with an exponent or more than 38 digits as a double; its kind is that of the double here.
    ``exact_kind`` goes by the text."""

    def whole(n: Column) -> Column:
        out = F.when(n.between(-128, 127), "byte").when(n.between(-32768, 32767), "short").when(n.between(-(2**31), 2**31 - 1), "int")
        low, high = (F.lit(x).cast("decimal(38,0)") for x in (-(2**63), 2**63 - 1))
        return out.when(n.between(low, high), "long").otherwise("bigint")

    def equal(text: Column, other: Column, small: Column) -> Column:
        """Whether two number texts are the same number; digits beyond what a double can have make them differ."""
        near = text.try_cast("decimal(38,37)") == other.try_cast("decimal(38,37)")
        wide = ~text.rlike(r"\.[0-9]{19,}$") & (text.try_cast("decimal(38,18)") == other.try_cast("decimal(38,18)"))
        return F.coalesce(F.when(small, near).otherwise(wide), F.lit(False))

    def decimal(text: Column) -> Column:
        def fraction(double: Column) -> Column:
            small = double.between(-1, 1)
            single = equal(text, double.cast("float").cast("string"), small)
            return F.when(single, "float").when(equal(text, double.cast("string"), small), "double").otherwise("bigdec")

        is_whole = text.rlike(r"^-?[0-9]+(\.0*)?$")
        return F.when(is_whole, bound(F.substring_index(text, ".", 1).try_cast("decimal(38,0)"), whole)).otherwise(bound(text.try_cast("double"), fraction))

    def real(double: Column) -> Column:
        n = double.try_cast("decimal(38,0)")
        kind = F.when(double.cast("float").cast("string") == double.cast("string"), "float").otherwise("double")
        is_whole = (F.abs(double) >= WHOLE) | (double == F.floor(double))
        return F.when(is_whole, F.when(n.isNull(), "bigint").otherwise(whole(n))).otherwise(kind)

    def by_schema(schema: Column) -> Column:
        return (
            F.when(schema == "BOOLEAN", "bit")
            .when(schema.isin(*_TEXTS), "string")
            .when(schema.startswith("OBJECT"), "object")
            .when(schema.startswith("ARRAY"), "array")
            .when(schema == "BIGINT", bound(F.try_variant_get(v, "$", "decimal(38,0)"), whole))
            .when(schema.startswith("DECIMAL"), bound(F.try_variant_get(v, "$", "string"), decimal))
            .when(schema.isin("DOUBLE", "FLOAT"), bound(F.try_variant_get(v, "$", "double"), real))
        )

    # containers are told by a look inside; the schema of a whole subtree would be worked out only to say "object"
    known = F.when(F.is_variant_null(v), "null").when(F.try_variant_get(v, "$[0]", "variant").isNotNull(), "array")
    known = known.when(v.try_cast("map<string,variant>").isNotNull(), "object").otherwise(bound(F.schema_of_variant(v), by_schema))
    return F.when(v.isNotNull(), known)


def _rounded(v: Column) -> Column:
    """Whether a VARIANT is a number that may not be what its text said."""
    container = F.try_variant_get(v, "$[0]", "variant").isNotNull() | v.try_cast("map<string,variant>").isNotNull()
    return F.coalesce(F.when(~container, F.schema_of_variant(v).isin("DOUBLE", "FLOAT")), F.lit(False))


def exact_kind(v: Column, literal: Column) -> Column:
    """As ``kind_of``, but of a number that VARIANT may have rounded by ``literal``, its text."""
    return F.coalesce(number_kind(F.when(_rounded(v), literal)), kind_of(v))


def may_round(text: Column) -> Column:
    """Whether JSON text may hold a number that VARIANT rounds: one with an exponent or more than 38 digits. (It may stand
    in a string, which does no harm.)"""
    return text.rlike(r"[0-9][eE][+-]?[0-9]|[0-9.]{39}")


def literal_at(body: Column, steps: Sequence[str | int]) -> Column:
    """The text of the number at a path of JSON text; NULL where there is none. Reads the text in Arrow batches."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda t: None if t is None else _literal(t, steps))

    return run(body)


def _literal(text: str, steps: Sequence[str | int]) -> str | None:
    from jsonloom.operators.shred import Number, parse_exact

    try:
        at = parse_exact(text)
        for s in steps:
            if isinstance(at, dict):
                at = at[s]
            elif isinstance(at, list):
                at = at[int(s)]
            else:
                return None
    except (ValueError, KeyError, IndexError):
        return None
    return str(at) if isinstance(at, Number) else None


def as_kind(v: Column, target: str, strict: bool = False, literal: Column | None = None) -> Column:
    """The value as ``target`` (byte, short, int, long, bigint, float, double, bigdec, string, bit) if its kind
    widens to that without loss of kind; else NULL, or an error if ``strict``.

    bigint and bigdec come as text with all their digits (``number_parts`` takes it apart). A number that VARIANT may
    have rounded (a double of 2^53 or more) is no bigint or bigdec without its ``literal``: NULL rather than other digits."""
    kind = kind_of(v) if literal is None else exact_kind(v, literal)
    accepted = kind.isin(*ACCEPTS[target])
    if target in ("bigint", "bigdec"):
        plain = F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(\.[0-9]*?)0+$", "$1")
        plain = F.regexp_replace(plain, r"\.$", "")
        double = F.try_variant_get(v, "$", "double")
        near = F.when(F.abs(double) < WHOLE, F.when(double == F.floor(double), double.try_cast("bigint").cast("string")).otherwise(double.cast("string")))
        told = near if literal is None else number_text(F.when(_rounded(v), literal))
        value = F.when(accepted, F.when(_rounded(v), told).otherwise(plain))
    else:
        value = F.when(accepted, F.try_variant_get(v, "$", SQL_TYPE[target]))
    if strict:
        message = F.concat(F.lit(f"not a {target}: "), F.coalesce(kind, F.lit("missing")))
        value = F.coalesce(value, F.raise_error(message).cast(SQL_TYPE[target]))
    return value


def match_kind(v: Column, branches: Mapping[str, Column], default: Column | None = None) -> Column:
    """The branch for the value's kind; kinds without one give ``default``, or NULL."""
    kind = kind_of(v)
    out = None
    for k, branch in branches.items():
        out = F.when(kind == k, branch) if out is None else out.when(kind == k, branch)
    if out is None:
        return default if default is not None else F.lit(None)
    return out.otherwise(default) if default is not None else out


def is_json_null(v: Column) -> Column:
    """Whether a value is there and is JSON null; False for a missing one."""
    return F.coalesce(F.is_variant_null(v), F.lit(False))


def size_of(v: Column) -> Column:
    """Elements of an array or members of an object; NULL for scalars and missing values."""
    return F.coalesce(F.size(v.try_cast("array<variant>")), F.size(F.map_keys(v.try_cast("map<string,variant>"))))


def elements(v: Column) -> Column:
    """The elements of an array as ARRAY<VARIANT>; NULL if it isn't one."""
    return v.try_cast("array<variant>")
