"""Spark sources and sinks: JSON text, and the binary container as format ``jsonloom_blob``."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, DataType, DateType, MapType, Row, StructType, TimestampNTZType, TimestampType

from jsonloom.functions.paths import Step, parse_path
from jsonloom.kinds import ACCEPTS, KIND
from jsonloom.operators.shred import parse_exact
from jsonloom.sources.blob import BlobBuilder, BlobReader, json_text

MAX_BYTES = 256 * 1024 * 1024


def read_json_files(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """(root, body, v): a document a file, or a line. ``v`` is NULL where the text is no JSON."""
    text = spark.read.text(path, wholetext=not lines).withColumn("root", F.col("_metadata.file_name"))
    return text.select("root", F.col("value").alias("body"), F.try_parse_json("value").alias("v"))


def _is_text(t: DataType) -> bool:
    """Whether a type holds, at any depth, what JSON can only say as a string: dates, times, bytes."""
    if isinstance(t, StructType):
        return any(_is_text(f.dataType) for f in t.fields)
    if isinstance(t, ArrayType):
        return _is_text(t.elementType)
    if isinstance(t, MapType):
        return _is_text(t.valueType)
    return isinstance(t, (DateType, TimestampType, TimestampNTZType, BinaryType))


def to_variant(body: Column, kind: str | DataType) -> Column:
    """A VARIANT of STRING, BINARY (UTF-8), STRUCT, ARRAY, MAP or VARIANT input; NULL where the text is no JSON. Dates, times
    and bytes in a typed input become the strings that ``to_json`` makes of them (if the type is given, not its name)."""
    name = kind if isinstance(kind, str) else kind.typeName()
    if name == "variant":
        return body
    if name in ("string", "binary"):
        return F.try_parse_json(body.cast("string"))
    if isinstance(kind, DataType) and _is_text(kind):
        return F.parse_json(F.to_json(body, {"ignoreNullFields": "false"}))
    return F.to_variant_object(body)


def _path(options: dict[str, str]) -> str:
    path = options["path"]
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme and scheme[1] != "file":
        raise ValueError(f"jsonloom_blob reads and writes a shared file system only, not {scheme[1]}:; use pack_blobs and read_blobs there")
    return path.removeprefix("file://").removeprefix("file:")


class BlobDataSource(DataSource):
    """``spark.read.format("jsonloom_blob").load(folder)`` gives (root, body); the writer packs each partition's
    rows to blob files of several documents. The folder must be one that all executors share, under a plain path or
    ``file:``; other schemes are refused (``pack_blobs`` and ``read_blobs`` go through Hadoop's file systems).

    Reading: query (a path: body is the value there, read without the rest of the document), roots (names,
    separated by commas: only these), signed_hash. Writing: buckets, numeric_mode, signed_hash, max_bytes (of JSON
    text a blob, 256 MB: a blob's offsets end at 2 GB), bad ("error", or "skip": rows without a name or readable body)."""

    @classmethod
    def name(cls) -> str:
        return "jsonloom_blob"

    def schema(self) -> str:
        return "root string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        path, roots = self.options.get("query"), self.options.get("roots")
        return _Reader(_path(self.options), parse_path(path) if path else [], set(roots.split(",")) if roots else None, self._signed())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        bad = self.options.get("bad", "error")
        if bad not in ("error", "skip"):
            raise ValueError(f"bad is {bad}, not error or skip")
        settings = {"buckets": int(self.options.get("buckets", 128)), "numeric_mode": self.options.get("numeric_mode", "exact"), "signed_hash": self._signed()}
        return _Writer(_path(self.options), overwrite, settings, int(self.options.get("max_bytes", MAX_BYTES)), bad == "skip")

    def _signed(self) -> bool:
        return self.options.get("signed_hash", "false").lower() == "true"


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, folder: str, steps: list[Step], roots: set[str] | None, signed: bool) -> None:
        self.folder, self.steps, self.roots, self.signed = folder, steps, roots, signed

    def partitions(self) -> list[InputPartition]:
        return [_File(os.path.join(self.folder, n)) for n in sorted(os.listdir(self.folder)) if n.endswith(".blob")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:  # type: ignore[attr-defined]
            reader = BlobReader(f.read(), self.signed)
        yield from _rows(reader, self.steps, self.roots)


def _rows(reader: BlobReader, steps: Sequence[Step], roots: set[str] | None) -> Iterator[tuple[str, str | None]]:
    for name in reader.roots:
        if roots is None or name in roots:
            try:
                yield name, json_text(reader.value(reader.follow(name, steps)))
            except KeyError:
                yield name, None


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


def _blobs(rows: Iterator[tuple[str | None, str | None]], settings: dict, max_bytes: int, skip: bool) -> Iterator[tuple[list[str], bytes]]:
    """(names, blob) of documents one after another, a new blob after so many bytes of text."""
    builder, held = BlobBuilder(**settings), 0
    for name, body in rows:
        try:
            if name is None:
                raise ValueError("a document without a name")
            value = parse_exact(body)
        except ValueError as e:
            if skip:
                continue
            raise ValueError(f"document {name}: {e}") from e
        if builder.names and held + len(body or "") > max_bytes:
            yield sorted(builder.names), builder.build()
            builder, held = BlobBuilder(**settings), 0
        builder.append(name, value)
        held += len(body or "")
    if builder.names:
        yield sorted(builder.names), builder.build()


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool, settings: dict, max_bytes: int, skip: bool) -> None:
        self.folder, self.overwrite, self.settings, self.max_bytes, self.skip = folder, overwrite, settings, max_bytes, skip

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        paths = []
        for _, blob in _blobs(((r["root"], r["body"]) for r in iterator), self.settings, self.max_bytes, self.skip):
            os.makedirs(self.folder, exist_ok=True)
            path = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.tmp")
            with open(path, "wb") as f:
                f.write(blob)
            paths.append(path)
        return _Written(paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        new = [p for m in messages if isinstance(m, _Written) for p in m.paths]
        if self.overwrite:
            for n in os.listdir(self.folder):
                if n.endswith(".blob"):
                    os.remove(os.path.join(self.folder, n))
        for p in new:
            os.replace(p, p.removesuffix(".tmp") + ".blob")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for p in m.paths if isinstance(m, _Written) else ():
                if os.path.exists(p):
                    os.remove(p)


def pack_blobs(documents: DataFrame, root: Column, body: Column, *, max_bytes: int = MAX_BYTES, skip_bad: bool = False, **settings: object) -> DataFrame:
    """(roots, blob): the documents of each partition in blobs of several documents, as rows that any sink of Spark
    can write (Parquet, for one, on any file system). settings: those of ``BlobBuilder``. A name occurs once in a
    blob (ValueError); a document without a name or readable body is an error, or left out with ``skip_bad``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for names, blob in _blobs(rows, settings, max_bytes, skip_bad):
            yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([blob], pa.binary())], names=["roots", "blob"])

    return documents.select(root.cast("string").alias("root"), body.cast("string").alias("body")).mapInArrow(run, "roots array<string>, blob binary")


def read_blobs(blobs: DataFrame, blob: Column, *, query: str | None = None, roots: Sequence[str] | None = None, signed_hash: bool = False) -> DataFrame:
    """(root, body) of a column of blobs: all roots or only ``roots``, whole or only the value at the path ``query`` (NULL where
    there is none), which is read without the rest. Blob files come through ``spark.read.format("binaryFile")``,
    from any file system, as its column ``content``."""
    steps, wanted = parse_path(query) if query else [], None if roots is None else set(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                found = list(_rows(BlobReader(data, signed_hash), steps, wanted)) if data is not None else []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in (0, 1)], names=["root", "body"])

    return blobs.select(blob.alias("blob")).mapInArrow(run, "root string, body string")


def encode_blob(root: Column, body: Column) -> Column:
    """A blob of each document, as BINARY; NULL where the text is no JSON."""

    @F.pandas_udf("binary")
    def run(roots: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for r, b in zip(roots, bodies, strict=True):
            try:
                builder = BlobBuilder()
                builder.append(r, parse_exact(b))
                out.append(builder.build())
            except ValueError:
                out.append(None)
        return pd.Series(out)

    return run(root, body)


def decode_blob(blob: Column) -> Column:
    """ARRAY<STRUCT<root, body>> of all documents in a blob; an error for other bytes."""

    @F.pandas_udf("array<struct<root:string,body:string>>")
    def run(blobs: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> list[dict[str, str]] | None:
            if data is None:
                return None
            reader = BlobReader(bytes(data))
            return [{"root": n, "body": json_text(reader.value(r))} for n, r in reader.roots.items()]

        return blobs.map(one)

    return run(blob)


def read_path(blob: bytes | None, root: str | None, path: str | Sequence[Step] | None, accepted: frozenset[str] | None = None) -> tuple[str | None, str | None]:
    """(kind, JSON text) of the value at a path of a document in a blob; NULLs where there is none, or of another kind than ``accepted``."""
    if blob is None or root is None or path is None:
        return None, None
    reader = BlobReader(bytes(blob))
    try:
        ref = reader.follow(root, parse_path(path) if isinstance(path, str) else path)
    except KeyError:
        return None, None
    kind = KIND[ref[0]]
    return (kind, json_text(reader.value(ref))) if accepted is None or kind in accepted else (None, None)


def blob_query(blob: Column, root: Column, path: str | Sequence[Step] = (), target: str | None = None) -> Column:
    """STRUCT<kind, body> of the value at a path of a document in a blob, without decoding anything else: keys are found by
    their bucket. body is JSON text. NULL where the path leads nowhere, there is no such root or the blob is NULL.
    target: only kinds that it accepts, as in ``Cursor.as_``; others give NULL."""
    steps = parse_path(path) if isinstance(path, str) else list(path)
    accepted = None if target is None else frozenset(ACCEPTS[target])

    @F.pandas_udf("kind string, body string")
    def run(blobs: pd.Series, roots: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_path(b, r, steps, accepted) for b, r in zip(blobs, roots, strict=True)], columns=["kind", "body"])

    found = run(blob, root)
    return F.when(found["kind"].isNotNull(), found)
