"""Functions for use in SQL text."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from jsonloom.functions.khash import MASK, SEED
from jsonloom.functions.numbers import classify, exact
from jsonloom.operators.shred import NODES, node_batch, parse_exact, shred_document
from jsonloom.sources.datasource import read_path

_KHASH = f"""CREATE OR REPLACE TEMPORARY FUNCTION khash(key STRING) RETURNS BIGINT RETURN
 CASE WHEN key = '' THEN {SEED}L ELSE aggregate(transform(sequence(1, octet_length(key)), i -> CAST(conv(hex(substring(encode(key, 'UTF-8'), i, 1)), 16, 10) AS BIGINT)), {SEED}L,
 (a, b) -> (((a ^ shiftleft(a, 13)) & {MASK}L) + shiftleft(((a ^ shiftleft(a, 13)) & {MASK}L) ^ b, 8)) & {MASK}L) END"""


def _shredded(body: pa.Array) -> pa.Array:
    ends, rows = [0], []
    for text in body.to_pylist():
        try:
            rows += shred_document(None, parse_exact(text))
        except ValueError:
            pass
        ends.append(len(rows))
    batch = node_batch(rows)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(batch.columns, names=batch.schema.names))


def register(spark: SparkSession) -> None:
    """``shred_json(body)`` (the nodes of a document as an array, for ``LATERAL VIEW inline(shred_json(t.body))``; unreadable
    text has none), ``khash``, ``number_kind`` and ``number_text``, ``blob_query(blob, root, path)``. All work on Arrow batches."""
    spark.udf.register("shred_json", F.arrow_udf(_shredded, f"array<struct<{NODES.replace(' ', ':').replace(',:', ',')}>>"))
    spark.sql(_KHASH)

    @F.pandas_udf("string")
    def number_kind(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else (classify(t.strip()) or (None,))[0])

    @F.pandas_udf("string")
    def number_text(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None or (e := exact(t.strip())) is None else e.text())

    @F.pandas_udf("string")
    def blob_query(blobs: pd.Series, roots: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([read_path(*x)[1] for x in zip(blobs, roots, paths, strict=True)], dtype=object)

    for name, f in (("number_kind", number_kind), ("number_text", number_text), ("blob_query", blob_query)):
        spark.udf.register(name, f)
