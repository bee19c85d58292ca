"""Shredding: documents to rows of nodes, with exact numbers and content hashes."""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.khash import khash_of
from jsonloom.functions.extract import kind_of
from jsonloom.functions.json_text import TooDeep, read_deep
from jsonloom.functions.numbers import classify
from jsonloom.kinds import MARKER
from jsonloom.session import stage

NODES = (
    "doc string, node_id string, parent_id string, depth int, pos int, key string, kind string, v_bool boolean, v_long bigint, "
    "v_double double, v_big string, v_str string, n_children int, chash string, key_hash bigint, "
    "height int"
)
PATH = ", path string"
ENTRIES = ", entries array<struct<khash:bigint,key:string,kind:string,ref:string>>"
_ARROW = [
    ("doc", pa.string()), ("node_id", pa.string()), ("parent_id", pa.string()), ("depth", pa.int32()), ("pos", pa.int32()), ("key", pa.string()),
    ("kind", pa.string()), ("v_bool", pa.bool_()), ("v_long", pa.int64()), ("v_double", pa.float64()), ("v_big", pa.string()), ("v_str", pa.string()),
    ("n_children", pa.int32()), ("chash", pa.string()), ("key_hash", pa.int64()), ("height", pa.int32()),
]


COLUMNS = tuple(n for n, _ in _ARROW)


class Number(str):
    """The text of a number literal."""


def _refused(text: str) -> Any:
    raise ValueError(text)


_parser = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refused)


def parse_exact(text: str | None) -> Any:
    """The document, its numbers as literals (Number). ValueError if it is no JSON, also if it has more than LEVELS
    levels. Of repeated keys the last counts."""
    if text is None:
        raise ValueError("NULL")
    try:
        return _parser.decode(text)
    except RecursionError:
        return read_deep(text, Number, Number)


@functools.lru_cache(maxsize=65_536)
def _key_hash(key: str | None) -> int | None:
    return None if key is None else khash_of(key)


#: Characters of a hash as text; longer values are told by one.
HASH_CHARS = 22


def content_hash(*parts: str) -> str:
    """128 bits of a hash in URL-safe base64, of a kind and the text that identifies a value within it."""
    return base64.urlsafe_b64encode(xxhash.xxh3_128_digest("\x1f".join(parts).encode("utf-8", "surrogatepass")))[:HASH_CHARS].decode()


def value_id(kind: str, text: str) -> str:
    """The id of a scalar within its kind: its own text where that is as short as a hash, of a string behind a mark that no hash
    has, so that it can be read without its table; else its hash. ``text`` identifies the value within the kind."""
    if kind == "string":
        return "'" + text if len(text) < HASH_CHARS and "\x1f" not in text else content_hash(kind, text)
    return content_hash(kind, text) if kind in ("bigint", "bigdec") else text or "0"


@functools.lru_cache(maxsize=65_536)
def _number(literal: str, mode: str) -> tuple:
    """What ``_scalar`` says of a number, and its id; repeated literals are classified once."""
    out = _scalar(Number(literal), mode)
    return (*out, value_id(out[0], out[6]))


def _scalar(value: Any, mode: str) -> tuple[str, bool | None, int | None, float | None, str | None, str | None, str]:
    """(kind, bool, long, double, big, string, text that identifies the value within its kind)."""
    if value is None:
        return "null", None, None, None, None, None, ""
    if value is True or value is False:
        return "bit", value, None, None, None, None, str(int(value))
    if isinstance(value, Number):
        found = classify(value, mode)
        if found is None:  # an exponent of thousands of digits; kept as written
            return "bigdec", None, None, None, str(value), None, str(value)
        kind, v = found
        if kind in ("byte", "short", "int", "long"):
            return kind, None, v, None, None, None, str(v)
        if kind in ("float", "double"):
            return kind, None, None, v, None, None, repr(v)
        text = v.text()  # one text for equal numbers, with all their digits
        return kind, None, None, None, text, None, text
    return "string", None, None, None, None, value, value


def shred_document(doc: str | None, value: Any, mode: str = "exact", entries: bool = False, hashes: bool = True, labels: bool = True) -> list[tuple]:
    """The node rows of a parsed document, in pre-order. node_id is the Dewey label, parent_id that label
    cut by one. chash identifies a value or subtree within its kind by content (``value_id``, or a hash of what a container
    holds, and its height): equal trees have equal hashes whatever the order of object keys. ``key`` is an object member's key, ``key_hash`` its hash; ``pos`` the place within the
    parent; ``height`` the levels below. With ``entries`` also what a container holds: of each child key hash, key,
    kind and chash (of a small scalar, the value itself); so no join brings parent and child together.
    Without ``hashes`` chash is None, which saves half of the time; without ``labels`` node_id and parent_id are empty."""
    rows: list[list[Any]] = []
    stack: list[tuple[Any, str, str | None, int, int, str | None, int]] = [(value, "1", None, 0, 0, None, -1)]
    parents: list[int] = []
    while stack:
        v, label, parent, depth, pos, key, at = stack.pop()
        me = len(rows)
        parents.append(at)
        if isinstance(v, dict) or isinstance(v, list):
            kind = "object" if isinstance(v, dict) else "array"
            rows.append([doc, label, parent, depth, pos, key, kind, None, None, None, None, None, len(v), None, _key_hash(key)])
            inner = list(v.items()) if kind == "object" else [(None, x) for x in v]
            for i in range(len(inner) - 1, -1, -1):
                stack.append((inner[i][1], f"{label}.{i + 1}" if labels else "", label, depth + 1, i, inner[i][0], me))
        elif isinstance(v, Number) and len(v) < 40:
            kind, b, n, d, big, s, _, chash = _number(str(v), mode)
            rows.append([doc, label, parent, depth, pos, key, kind, b, n, d, big, s, 0, chash, _key_hash(key)])
        else:
            kind, b, n, d, big, s, text = _scalar(v, mode)
            rows.append([doc, label, parent, depth, pos, key, kind, b, n, d, big, s, 0, value_id(kind, text) if hashes else None, _key_hash(key)])
    inside: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        if p >= 0:
            inside.setdefault(p, []).append(i)
    heights = [0] * len(rows)
    for i in range(len(rows) - 1, -1, -1):  # children come after their parents
        row = rows[i]
        if row[6] in ("object", "array"):
            held = inside.get(i, [])
            heights[i] = 1 + max((heights[c] for c in held), default=0)
            if not hashes:
                continue
            if row[6] == "object":
                hashed = content_hash("object", *(x for k, c in sorted((rows[c][5], c) for c in held) for x in (f"{len(k)}:{k}", rows[c][6], rows[c][13])))
            else:
                hashed = content_hash("array", *(x for c in held for x in (rows[c][6], rows[c][13])))
            row[13] = f"{hashed}.{heights[i]}"
    if not entries:
        return [(*r, h) for r, h in zip(rows, heights, strict=True)]
    return [(*r, h, [(rows[c][14], rows[c][5], rows[c][6], rows[c][13]) for c in inside.get(i, ())]) for i, (r, h) in enumerate(zip(rows, heights, strict=True))]


def node_paths(rows: list[tuple]) -> list[str]:
    """The path of each node of a document's rows: keys and positions from the root."""
    paths: dict[str, str] = {}
    out = []
    for _, label, parent, _, pos, key, *_ in rows:  # parents come before their children
        if parent is None:
            path = ""
        elif key is None:
            path = f"{paths[parent]}[{pos}]"
        else:
            path = (paths[parent] + "." if paths[parent] else "") + key
        paths[label] = path
        out.append(path)
    return out


def _once(rows: list[tuple], seen: set[tuple]) -> list[tuple]:
    """Roots, and of other values each under each key once; ``seen`` is kept small."""
    if len(seen) > 200_000:
        seen.clear()
    out = []
    for r in rows:
        what = (r[6], r[13], r[5])
        if r[3] == 0 or what not in seen:
            out.append(r)
            if r[3]:
                seen.add(what)
    return out


def _shredder(mode: str, strict: bool, names: Sequence[str], once: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    paths, entries = "path" in names, "entries" in names
    hashes = entries or "chash" in names
    labels = paths or "node_id" in names or "parent_id" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            seen: set[tuple] = set()
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = shred_document(doc, parse_exact(body), mode, entries, hashes, labels)
                except ValueError:
                    if strict:
                        raise
                    continue
                if once:
                    found = _once(found, seen)
                deep = labels and len(found) > 1000 and max(r[3] for r in found) > 1000
                if deep and rows:  # its labels are long: batches of its own
                    yield node_batch(rows, names)
                    rows = []
                rows += [(*r, p) for r, p in zip(found, node_paths(found), strict=True)] if paths else found
                most = 1000 if deep else 50_000
                while len(rows) > most:
                    yield node_batch(rows[:most], names)
                    del rows[:most]
            yield node_batch(rows, names)

    return run


def node_batch(rows: list[tuple], names: Sequence[str] = COLUMNS) -> pa.RecordBatch:
    """Rows of ``shred_document`` as an Arrow batch of the columns asked for."""
    fields = [*_ARROW, *([("entries", None)] if "entries" in names else []), *([("path", pa.string())] if "path" in names else [])]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    made = {n: _entries(c) if t is None else pa.array(c, t) for c, (n, t) in zip(cols, fields, strict=True) if n in names}
    return pa.RecordBatch.from_arrays([made[n] for n in names], names=list(names))


def _entries(column: tuple[list[tuple], ...]) -> pa.Array:
    ends, flat = [0], []
    for held in column:
        flat += held
        ends.append(len(flat))
    cols = list(zip(*flat, strict=True)) if flat else [()] * 4
    types = (pa.int64(), pa.string(), pa.string(), pa.string())
    inner = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["khash", "key", "kind", "ref"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)


def shred(
    documents: DataFrame, doc: Column, body: Column, *, numeric_mode: str = "exact", strict: bool = False, paths: bool = False, entries: bool = False, columns: Sequence[str] | None = None, once: bool = False
) -> DataFrame:
    """The nodes of all documents (schema NODES), one row each; with ``entries`` also what each container holds, with
    ``paths`` the path of each, keys and positions from the root. No exchange: every document is shredded where it is read.
    columns: only these; others aren't made at all (Spark prunes columns of a scan, but not those that Python makes).
    once: only what differs in value or key: of equal values under one key, roots apart, a batch gives the first (needs chash, no labels).

    body: JSON as STRING, BINARY (UTF-8), VARIANT or STRUCT. A NULL, empty or unreadable one gives no
    nodes, or an error if ``strict`` (``unreadable`` lists them). Numbers of any size are read exactly. doc may
    be NULL or repeat: the rows are as many as the documents give."""
    if numeric_mode not in ("exact", "fast", "narrow"):
        raise ValueError(f"unknown numeric mode {numeric_mode}")
    slim, text = _bodies(documents, doc, body)
    types = dict(x.split(" ", 1) for x in re.split(r", (?![^<]*>)", NODES + ENTRIES + PATH))
    names = list(columns) if columns is not None else [*COLUMNS, *["entries"] * entries, *["path"] * paths]
    schema = ", ".join(f"{n} {types[n]}" for n in names)
    return slim.select("doc", text.alias("body")).mapInArrow(_shredder(numeric_mode, strict, names, once), schema)


def _bodies(documents: DataFrame, doc: Column, body: Column) -> tuple[DataFrame, Column]:
    slim = documents.select(doc.cast("string").alias("doc"), body.alias("body"))
    kind = dict(slim.dtypes)["body"]
    return slim, F.col("body").cast("string") if kind in ("string", "binary") else F.to_json("body", {"ignoreNullFields": "false"})


def _refusals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, reasons = [], []
        for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                parse_exact(body)
                continue
            except TooDeep:
                reason = "too deep"
            except ValueError:
                reason = "null" if body is None else "empty" if not body.strip() else "no JSON"
            docs.append(doc)
            reasons.append(reason)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(reasons, pa.string())], names=["doc", "reason"])


def unreadable(documents: DataFrame, doc: Column, body: Column) -> DataFrame:
    """(doc, reason): the documents that ``shred`` leaves out: "null", "empty", "no JSON" or "too deep"."""
    slim, text = _bodies(documents, doc, body)
    return slim.select("doc", text.alias("body")).mapInArrow(_refusals, "doc string, reason string")


def kind_marker(kind: Column) -> Column:
    """The marker byte of a kind."""
    return F.element_at(F.create_map(*[x for k, n in MARKER.items() for x in (F.lit(k), F.lit(n))]), kind)


def shred_native(documents: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(doc, node_id, parent_id, depth, key, kind, v): nodes of VARIANT documents (doc, v) by built-in functions,
    without Python. Each level explodes the containers of the one before; levels are written to the shared
    folder, so nothing is computed twice. Numbers have the kinds that VARIANT keeps (no literal text).
    Documents that are NULL have no nodes. ValueError beyond ``max_depth`` levels."""
    spark = documents.sparkSession
    level = documents.where(F.col("v").isNotNull()).select(
        F.col("doc"), F.lit("1").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), kind_of(F.col("v")).alias("kind"), "v"
    )
    found: DataFrame | None = None
    for depth in range(1, max_depth + 1):
        level = stage(level, "variants")
        found = level if found is None else found.unionByName(level)
        containers = level.where("kind in ('array', 'object')").select("doc", F.col("node_id").alias("up"), F.col("v").alias("inner"))
        if containers.isEmpty():
            return found
        inside = containers.lateralJoin(spark.tvf.variant_explode(F.col("inner").outer()))
        label = F.concat_ws(".", "up", (F.col("pos") + 1).cast("string"))
        level = inside.select("doc", label.alias("node_id"), F.col("up").alias("parent_id"), F.lit(depth).alias("depth"), "key", kind_of(F.col("value")).alias("kind"), F.col("value").alias("v"))
    raise ValueError(f"documents deeper than {max_depth} levels")
