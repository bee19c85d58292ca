"""Streams of documents and of facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.kinds import TABLES
from jsonloom.operators.aggregate import Aggregate
from jsonloom.operators.shred import shred


def shred_stream(documents: DataFrame, doc: Column, body: Column, **options: object) -> DataFrame:
    """Streaming documents to streaming nodes; stateless, so any trigger and output mode goes."""
    return shred(documents, doc, body, **options)  # type: ignore[arg-type]


def appender(path: str, *, root: str = "root", body: str = "body") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds a batch of documents to the aggregate at ``path``, to be read by ``appended``.

    A batch writes the folder ``batch=<number>`` of each table and nothing else: what is there already is neither
    read nor changed, so a batch costs the same however large the aggregate is. Run again, it replaces its own
    folders. The roots are written last, and only batches that have them count; so a batch is there wholly or not at all.
    Two documents of one name in a batch are an error."""

    def run(batch: DataFrame, number: int) -> None:
        new = Aggregate.pack(batch, F.col(root), F.col(body))
        for t in [t for t in TABLES if t != "root"] + ["root"]:
            new[t].write.mode("overwrite").parquet(f"{path}/{t}/batch={number}")

    return run


def appended(spark: SparkSession, path: str) -> Aggregate:
    """The aggregate that ``appender`` wrote: of equal values, which have equal ids, one each; of documents of one name the first.
    (Written with ``write``, it is compacted.)"""
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    done = [r.batch for r in tables["root"].select("batch").distinct().collect()]  # one number a batch
    for t, df in tables.items():
        rows = df.where(F.col("batch").isin(done))
        if t == "root":
            tables[t] = rows.groupBy("name").agg(F.min_by("value", "batch").alias("value"))
        else:
            tables[t] = rows.drop("batch").dropDuplicates(["id"])
    return Aggregate(tables)


def latest_facts(facts: DataFrame, key: list[str], sequence: Column, removed: Column) -> DataFrame:
    """What holds after a set of facts, in whatever order they came: of each key the fact with the highest
    sequence, unless that one removes it. Combined within the map task before the exchange."""
    value = F.struct(*[F.col(c) for c in facts.columns if c not in key])
    last = facts.groupBy(*key).agg(F.max_by(F.struct(value.alias("v"), F.coalesce(removed, F.lit(False)).alias("gone")), F.coalesce(sequence, F.lit(-1))).alias("f"))
    return last.where(~F.col("f.gone")).select(*key, "f.v.*")
