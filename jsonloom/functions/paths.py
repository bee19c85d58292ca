"""The path language: text to steps, and steps to a Column over a VARIANT."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = str | int
_TOKEN = re.compile(
    r"""\[\s*(?P<index>-?\d+)\s*\] | \[\s*"(?P<dq>(?:[^"\\]|\\.)*)"\s*\] | \[\s*'(?P<sq>(?:[^'\\]|\\.)*)'\s*\] | (?P<name>[^.\[\]]+) | (?P<dot>\.)""",
    re.X,
)
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_WHOLE = re.compile(r"-?\d+")


def parse_path(path: str) -> list[Step]:
    """Steps of ``a.b[0]["x.y"][-1]``. Whole numbers in brackets are indices (int); a bare number is a name
    that may also be an index, as the value's kind decides. Empty parts between dots are dropped.
    ValueError for a path without steps or with a stray bracket."""
    steps: list[Step] = []
    at = 0
    while at < len(path):
        m = _TOKEN.match(path, at)
        if not m:
            raise ValueError(f"can't read the path {path!r} from character {at}")
        if m["index"] is not None:
            steps.append(int(m["index"]))
        elif m["dq"] is not None or m["sq"] is not None:
            steps.append(re.sub(r"\\(.)", r"\1", m["dq"] if m["dq"] is not None else m["sq"]))
        elif m["name"] is not None:
            steps.append(m["name"])
        at = m.end()
    if not steps:
        raise ValueError("the path is empty")
    return steps


def render_path(steps: Sequence[Step]) -> str:
    """The steps as text that parses back to them."""
    out = ""
    for s in steps:
        if isinstance(s, int):
            out += f"[{s}]"
        elif s and not re.search(r"[.\[\]\"'\\]", s):
            out += ("." if out else "") + s
        else:
            out += '["' + s.replace("\\", "\\\\").replace('"', '\\"') + '"]'
    return out


def path_steps(path: Column) -> Column:
    """The steps of paths in a column, as ARRAY<STRING>: cut at dots and brackets, without empty parts."""
    return F.filter(F.split(path, r"[.\[\]]"), lambda x: x != "")


def _field(v: Column, key: Column) -> Column:
    return F.try_element_at(v.try_cast("map<string,variant>"), key)


def _element(v: Column, i: int) -> Column:
    return F.try_element_at(v.try_cast("array<variant>"), F.lit(i + 1 if i >= 0 else i))


def compile_steps(v: Column, steps: Sequence[Step], strict: bool = False) -> Column:
    """The value at ``steps`` in a VARIANT column. Where there is none (missing key, index out of range, a
    step into a scalar): NULL, or an error if ``strict``. Runs of plain names go to one ``variant_get``."""
    out, plain = v, ""

    def flush(c: Column) -> Column:
        return F.try_variant_get(c, "$" + plain, "variant") if plain else c

    for s in steps:
        if isinstance(s, str) and _PLAIN.fullmatch(s):
            plain += "." + s
            continue
        out, plain = flush(out), ""
        if isinstance(s, int):
            out = _element(out, s)
        elif _WHOLE.fullmatch(s):
            out = F.coalesce(_field(out, F.lit(s)), _element(out, int(s)))
        else:
            out = _field(out, F.lit(s))
    out = flush(out)
    if strict:
        out = F.coalesce(out, F.raise_error(F.lit(f"no value at {render_path(steps)}")).cast("variant"))
    return out


def query(v: Column, path: str | Sequence[Step], strict: bool = False) -> Column:
    """The value at a path (text, or steps already split) of a VARIANT column."""
    return compile_steps(v, parse_path(path) if isinstance(path, str) else list(path), strict)


def field_of(v: Column, key: Column | str) -> Column:
    """The member of an object by exact key, which may be empty, hold dots, or come from a column."""
    return _field(v, F.lit(key) if isinstance(key, str) else key)
