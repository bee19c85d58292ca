"""Number literals classified by their exact text."""

from __future__ import annotations

import re
from decimal import Decimal
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = re.compile(r"(-?)(0|[1-9]\d*)(?:\.(\d+))?(?:[eE]([+-]?\d+))?", re.A)
PLAIN = 1_000  # digits up to which a number is written out without an exponent
_DIGITS = 4_000  # of an exponent, that Python reads as a number


class Exact(NamedTuple):
    """A decimal number, whatever its size: sign, digits (no zeros at the ends) times ten to the exponent. Equal numbers
    are equal here, however they were spelled; 0 is ("", "0", 0)."""

    sign: str
    digits: str
    exponent: int

    def whole(self) -> bool:
        return self.exponent >= 0

    def text(self) -> str:
        """The number's one text: written out up to PLAIN digits, else with an exponent."""
        n, e = len(self.digits), self.exponent
        if e >= 0 and n + e <= PLAIN:
            return self.sign + self.digits + "0" * e
        if e < 0 and max(n, -e) <= PLAIN:
            all_ = self.digits.rjust(1 - e, "0")
            return f"{self.sign}{all_[:e]}.{all_[e:]}"
        head = self.digits[0] + ("." + self.digits[1:] if n > 1 else "")
        return f"{self.sign}{head}E{e + n - 1:+d}"

    def parts(self) -> tuple[str, int, int, int]:
        """(unscaled digits, scale, precision, signum), as the container stores it."""
        zero = self.digits == "0"
        return self.digits, -self.exponent, len(self.digits), 0 if zero else (-1 if self.sign else 1)


def exact(text: str) -> Exact | None:
    """The number that a JSON number literal states, None for any other text."""
    m = _NUMBER.fullmatch(text)
    if m is None or len(m[4] or "") > _DIGITS:
        return None
    return _exact(m[1], m[2] + (m[3] or ""), int(m[4] or 0) - len(m[3] or ""))


def _exact(sign: str, digits: str, exponent: int) -> Exact:
    digits = digits.lstrip("0")
    core = digits.rstrip("0")
    return Exact(sign, core, exponent + len(digits) - len(core)) if core else Exact("", "0", 0)


def _shortest(value: Any) -> Exact | None:
    """What the shortest text of a float says; None for infinity."""
    if not np.isfinite(value):
        return None
    sign, digits, exponent = Decimal(str(value)).as_tuple()
    return _exact("-" if sign else "", "".join(map(str, digits)), int(exponent))


def classify(text: str, mode: str = "exact") -> tuple[str, Any] | None:
    """(kind, value) of a literal, None if it isn't a number. The value is an int, a float or, for bigint and
    bigdec, Exact. No number is too large or too long.

    exact: by the decimal value. Whole numbers (also 1.0 and 1e3) take the smallest whole kind; others
        are float or double if the shortest text of one is the same number, else bigdec.
    fast: literals written as whole numbers as in exact; others through double, float if that keeps the
        double; beyond double's range as in exact.
    narrow: literals written as whole numbers as in exact; others float within float's range, else double."""
    d = exact(text)
    if d is None:
        return None
    if mode != "exact" and re.search(r"[.eE]", text):
        real = float(text)
        with np.errstate(over="ignore", under="ignore"):
            small = np.float32(real)
        if mode == "narrow":
            return ("float", float(small)) if np.isfinite(small) else (("double", real) if np.isfinite(real) else classify(text))
        if np.isfinite(real):
            return ("float", real) if float(small) == real else ("double", real)
        return classify(text)
    if d.whole():
        if len(d.digits) + d.exponent <= 19:
            n = int(d.sign + d.digits) * 10**d.exponent
            for kind, bits in (("byte", 8), ("short", 16), ("int", 32), ("long", 64)):
                if -(1 << (bits - 1)) <= n < 1 << (bits - 1):
                    return kind, n
        return "bigint", d
    if len(d.digits) <= 17:  # more digits than the shortest text of any double has
        real = float(text)
        with np.errstate(over="ignore", under="ignore"):
            small = np.float32(real)
        if len(d.digits) <= 9 and _shortest(small) == d:
            return "float", float(str(small))
        if _shortest(real) == d:
            return "double", real
    return "bigdec", d


def written_parts(text: str) -> tuple[str, int, int, int] | None:
    """(unscaled digits, scale, precision, signum) of a literal as written, zeros at its end included; 0 has precision 1."""
    m = _NUMBER.fullmatch(text)
    if m is None or len(m[4] or "") > _DIGITS:
        return None
    digits = (m[2] + (m[3] or "")).lstrip("0") or "0"
    return digits, len(m[3] or "") - int(m[4] or 0), len(digits), 0 if digits == "0" else (-1 if m[1] else 1)


def from_parts(unscaled: str, scale: int, signum: int) -> Exact:
    return _exact("-" if signum < 0 else "", unscaled.lstrip("-"), -scale)


def whole_digits(n: int) -> str:
    """Decimal digits of an int of any length."""
    return format(Decimal(n), "f")


def int_bytes(n: int) -> bytes:
    """Two's complement, big-endian, shortest."""
    return n.to_bytes((n.bit_length() if n >= 0 else (n + 1).bit_length()) // 8 + 1, "big", signed=True)


def int_from_bytes(data: bytes) -> int:
    return int.from_bytes(data, "big", signed=True)


def whole_bytes(literal: Column) -> Column:
    """The bytes of a whole number of any length, as the container stores them; NULL for other text."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        found = [None if t is None else exact(t) for t in s]
        return pd.Series([int_bytes(int(Decimal(e.sign + e.digits + "0" * e.exponent))) if e is not None and 0 <= e.exponent <= PLAIN else None for e in found], dtype=object)

    return run(F.trim(literal))


def number_kind(literal: Column, mode: str = "exact") -> Column:
    """The kind of a literal's text (outer white space ignored); NULL if it is no JSON number. Literals of up to 15
    digits without fraction stay in the JVM."""

    @F.pandas_udf("string")
    def by_text(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else (classify(t, mode) or (None,))[0])

    text = F.trim(literal)
    short = F.when(text.rlike(r"^-?(0|[1-9][0-9]{0,14})$"), text.try_cast("bigint"))
    return (
        F.when(short.between(-128, 127), "byte")
        .when(short.between(-32768, 32767), "short")
        .when(short.between(-(2**31), 2**31 - 1), "int")
        .when(short.isNotNull(), "long")
        .otherwise(by_text(F.when(short.isNull(), text)))
    )


def number_parts(literal: Column) -> Column:
    """STRUCT(unscaled, scale, precision, signum) of a literal as written; NULL if it is no JSON number."""

    @F.pandas_udf("unscaled string, scale bigint, precision int, signum int")
    def parts(s: pd.Series) -> pd.DataFrame:
        rows = [(t is not None and written_parts(t)) or (None, None, None, None) for t in s]
        return pd.DataFrame(rows, columns=["unscaled", "scale", "precision", "signum"]).astype({"scale": "Int64", "precision": "Int32", "signum": "Int32"})

    return parts(F.trim(literal))


def number_text(literal: Column) -> Column:
    """The one exact text of a literal's number (1.50 and 15e-1 are both 1.5); NULL if it is no JSON number. Plain literals stay in the JVM."""

    @F.pandas_udf("string")
    def by_text(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None or (e := exact(t)) is None else e.text())

    text = F.trim(literal)
    plain = text.rlike(r"^(0|-?[1-9][0-9]{0,17})$|^-?(0|[1-9][0-9]{0,17})\.[0-9]{0,17}[1-9]$")
    return F.when(plain, text).otherwise(by_text(F.when(~plain, text)))
