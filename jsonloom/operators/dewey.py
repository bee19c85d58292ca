"""Deeply nested documents as flat tables with parent-child links, by Dewey labels.

Every node of a document gets the path of its ordinals from the root ("1.4.2": second child of the
fourth child of the root). A label cut short is the label of an ancestor, which is how links between
tables are derived; nodes are grouped to tables by their schema path (the keys on the way, with array
steps left out of the pattern, so that one object and a list of objects read alike)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.json_text import read_deep
from jsonloom.session import stage


class Literal(str):
    """The text of a JSON number with fraction or exponent, kept as written."""


def _no_constant(text: str) -> Any:
    raise ValueError(text)


_decoder = json.JSONDecoder(parse_float=Literal, parse_constant=_no_constant)
#: Not a value: what unreadable text gives.
UNREADABLE = object()


def read_json(text: str | None) -> Any:
    """The value of a JSON text; text inside a JSON string counts as JSON, at any number of levels.
    UNREADABLE for NULL, incomplete or empty text, NaN and Infinity, and nesting beyond LEVELS levels."""
    if text is None:
        return UNREADABLE
    try:
        value = _decoded(text)
        while isinstance(value, str) and not isinstance(value, Literal):
            value = _decoded(value)
    except ValueError:
        return UNREADABLE
    return value


def _decoded(text: str) -> Any:
    try:
        return _decoder.decode(text)
    except json.JSONDecodeError:
        raise
    except (ValueError, RecursionError):  # very long whole numbers, very deep nesting
        return read_deep(text, Literal, Literal)


def embedded(value: str) -> Any:
    """The object or array that a string member holds as JSON text, else UNREADABLE."""
    head = value.lstrip()[:1]
    if head not in ("{", "[", '"'):
        return UNREADABLE
    found = read_json(value)
    return found if isinstance(found, (dict, list)) else UNREADABLE


def scalar_text(value: Any) -> str | None:
    """A JSON scalar as text: numbers as written, true and false, NULL for null."""
    if value is None:
        return None
    if value is True or value is False:
        return "true" if value else "false"
    return str(value)


@dataclass(frozen=True)
class NodeTable:
    """Nodes that make one table.

    path: the keys from the root; array steps aren't written. deep: also objects anywhere below it.
    columns: members to keep (scalars as text, NULL where missing or not scalar). requires: objects
    without these members don't count. parent: the table whose nearest enclosing row is the parent."""

    name: str
    path: tuple[str, ...]
    columns: tuple[str, ...]
    parent: str | None = None
    deep: bool = False
    requires: tuple[str, ...] = ()


class _Step:
    __slots__ = ("children", "table")

    def __init__(self) -> None:
        self.children: dict[str, _Step] = {}
        self.table: NodeTable | None = None


def _steps(tables: Sequence[NodeTable]) -> _Step:
    root = _Step()
    for t in tables:
        at = root
        for key in t.path:
            at = at.children.setdefault(key, _Step())
        if at.table is not None:
            raise ValueError(f"{at.table.name} and {t.name} have the same path")
        at.table = t
    return root


#: (table, label, depth of the parent row's label or 0, members, own value if the node is a scalar)
Row = tuple[str, str, int, list[tuple[str, str | None]], str | None]


def label_nodes(document: Any, root: _Step) -> list[Row]:
    """The rows of all tables in one document, with Dewey labels. No recursion: depth is bounded by
    the parser alone. Parts of the document that no table's path reaches aren't visited."""
    out: list[Row] = []
    stack: list[tuple[Any, _Step, tuple[int, ...], dict[str, int]]] = [(document, root, (1,), {})]
    while stack:
        value, step, label, around = stack.pop()
        if isinstance(value, str) and not isinstance(value, Literal):
            inner = embedded(value)
            if inner is not UNREADABLE:
                value = inner
        table = step.table
        if isinstance(value, list):
            stack.extend((x, step, (*label, i), around) for i, x in enumerate(value, 1) if x is not None)
        elif isinstance(value, dict):
            if table is not None and all(r in value for r in table.requires):
                members = []
                for c in table.columns:
                    m = value.get(c)
                    if m is not None and not isinstance(m, (dict, list)):
                        members.append((c, scalar_text(m)))
                out.append((table.name, ".".join(map(str, label)), around.get(table.parent or "", 0), members, None))
                around = around | {table.name: len(label)}
            deep = table is not None and table.deep
            for i, (k, v) in enumerate(value.items(), 1):
                nxt = step.children.get(k)
                if nxt is None and deep and isinstance(v, (dict, list, str)):
                    nxt = step
                if nxt is not None and v is not None:
                    stack.append((v, nxt, (*label, i), around))
        elif table is not None and not table.requires:
            out.append((table.name, ".".join(map(str, label)), around.get(table.parent or "", 0), [], scalar_text(value)))
    return out


_MEMBERS = pa.map_(pa.string(), pa.string())


def _labeller(key_type: pa.DataType, tables: tuple[NodeTable, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = _steps(tables)
        for batch in batches:
            keys: list[Any] = []
            numbers: list[int] = []
            rows: list[Row] = []
            for key, text, number in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc = read_json(text)
                if doc is UNREADABLE:
                    continue
                found = label_nodes(doc, root)
                rows += found
                keys += [key] * len(found)
                numbers += [number] * len(found)
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, key_type), pa.array(numbers, pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                    pa.array(cols[2], pa.int32()), pa.array(cols[3], _MEMBERS), pa.array(cols[4], pa.string()),
                ],
                names=["doc_key", "doc_row", "node_table", "label", "parent_depth", "members", "value"],
            )

    return run


def dewey_rows(documents: DataFrame, key: Column, body: Column, tables: Sequence[NodeTable]) -> DataFrame:
    """(doc_key, doc_row, node_table, label, parent_label, members, value): one row per node of ``tables``. doc_row tells
    documents of one key apart, within what is written of one run.

    ``key`` must be a string or a BIGINT. Only (key, body) reach Python, as Arrow batches; a body
    that can't hold any of the first keys of the paths is dropped before, in the scan's stage.

    Edge cases: a NULL, empty or incomplete body gives no rows, null elements and missing members
    neither; repeated documents give their rows again; tables are empty for an empty input."""
    slim = documents.select(key.alias("doc_key"), body.cast("string").alias("body"))
    kind = dict(slim.dtypes)["doc_key"]
    if kind not in ("string", "bigint"):
        raise ValueError(f"the key is a {kind}, not a string or a bigint")
    possible = F.col("body").contains("\\u")  # a key may be spelled with escapes
    for first in {t.path[0] for t in tables if t.path}:
        possible = possible | F.col("body").contains(first)
    if all(t.path for t in tables):
        slim = slim.where(possible)
    slim = slim.withColumn("doc_row", F.monotonically_increasing_id())
    schema = f"doc_key {kind}, doc_row bigint, node_table string, label string, parent_depth int, members map<string,string>, value string"
    rows = slim.mapInArrow(_labeller(pa.string() if kind == "string" else pa.int64(), tuple(tables)), schema)
    parent = F.when(
        F.col("parent_depth") > 0, F.array_join(F.slice(F.split("label", r"\."), F.lit(1), F.col("parent_depth")), ".")
    )
    return rows.select("doc_key", "doc_row", "node_table", "label", parent.alias("parent_label"), "members", "value")


def dewey_tables(documents: DataFrame, key: Column, body: Column, tables: Sequence[NodeTable]) -> dict[str, DataFrame]:
    """One flat DataFrame per table: doc_key, doc_row, label, parent_label, value and the table's columns.

    The labelled rows are written once to the shared folder, partitioned by table, so that each
    table reads its own files only and the documents are parsed once."""
    rows = stage(dewey_rows(documents, key, body, tables), "dewey", by="node_table")
    out = {}
    for t in tables:
        mine = rows.where(F.col("node_table") == t.name)
        out[t.name] = mine.select(
            "doc_key", "doc_row", "label", "parent_label", "value", *[F.element_at("members", c).alias(c) for c in t.columns]
        )
    return out


def with_parent(child: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``child`` with columns of its parent row, joined by document and truncated label; documents of one key are kept
    apart. Children outside any parent row are left out."""
    p = parent.select("doc_row", F.col("label").alias("parent_label"), *[F.col(c).alias(a) for c, a in columns.items()])
    return child.join(p, ["doc_row", "parent_label"])
