"""Queries of the document engine itself, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jsonloom.api import ArrayCursor, Cursor
from jsonloom.functions.extract import kind_of, match_kind
from jsonloom.functions.khash import khash, khash_bucket
from jsonloom.functions.numbers import number_kind, number_parts, number_text, whole_bytes
from jsonloom.functions.paths import path_steps
from jsonloom.operators.aggregate import VALUE_COLUMNS, Aggregate, dense_ids, distinct_trees, json_of_nodes, rebuild, string_id, value_frequencies
from jsonloom.functions.sql import register
from jsonloom.operators.shred import shred, shred_native, unreadable
from jsonloom.session import fresh_path, stage, table
from jsonloom.sources.datasource import BlobDataSource, blob_query, decode_blob, encode_blob, pack_blobs, read_blobs, read_json_files, to_variant
from jsonloom.streaming.shred_stream import latest_facts, shred_stream

# Documents made of the relational tables


def _props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", "props", F.try_parse_json("props").alias("v"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Order documents with their lines in order; an order has few lines."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    body = F.struct(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), (F.col("o_orderstatus") == "O").alias("open"),
        F.struct(F.col("o_custkey").alias("key"), F.lit(None).cast("string").alias("note")).alias("customer"), F.struct(F.col("o_orderpriority").alias("a.b")).alias("x.y"), "lines",
    )
    return o.select("o_orderkey", body.alias("body"))


def _order_cursor(spark: SparkSession, d: str) -> tuple[DataFrame, Cursor]:
    docs = _orders(spark, d).select("o_orderkey", F.to_variant_object("body").alias("v"))
    return docs, Cursor(F.col("v"))


def _clients(spark: SparkSession, d: str) -> DataFrame:
    """Customer documents that share their nations and regions."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region = F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    nation = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), region.alias("region"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    body = F.struct(F.col("c_name").alias("name"), F.array("c_mktsegment", "n_name").alias("tags"), nation.alias("nation"))
    return c.select(F.col("c_custkey").cast("string").alias("root"), body.alias("body"))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("root"), F.struct(F.col("c_name").alias("name"), tags.alias("tags"), F.col("c_nationkey").alias("nation")).alias("body"))


def _specs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_spec").select("spec_id", "body", F.try_parse_json("body").alias("v"))


# Sources


def json_source(spark: SparkSession, d: str) -> DataFrame:
    """Every JSON text column parsed: how many texts are documents."""
    out = None
    for t, c in (("events", "props"), ("api_spec", "body"), ("theater_page", "body"), ("event_log", "payload")):
        row = table(spark, d, t).agg(F.count(F.lit(1)).alias("texts"), F.count(F.try_parse_json(c)).alias("documents")).select(F.lit(t).alias("source"), "texts", "documents")
        out = row if out is None else out.unionByName(row)
    return out


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """The properties of all events as files of JSON lines, read by the source."""
    path = fresh_path(spark, "lines")
    table(spark, d, "events").select("props").write.text(path)
    k = Cursor(F.col("v")).field("k").as_("long")
    return read_json_files(spark, path, lines=True).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def encode_from_struct(spark: SparkSession, d: str) -> DataFrame:
    docs = _customers(spark, d).select("root", to_variant(F.col("body"), "struct").alias("v"))
    c = Cursor(F.col("v"))
    return docs.select(F.col("root").cast("bigint").alias("c_custkey"), c.field("name").as_("string").alias("c_name"), c.query("tags[0]").as_("string").alias("segment"))


def struct_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates in typed input are strings in the document."""
    o = table(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("by")).alias("body"))
    c = Cursor(to_variant(F.col("body"), o.schema["body"].dataType)).field("day")
    return o.select("o_orderkey", c.kind().alias("kind"), c.as_("string").alias("day"))


def encode_from_string(spark: SparkSession, d: str) -> DataFrame:
    """The same from UTF-8 bytes of JSON text."""
    docs = _customers(spark, d).select("root", F.encode(F.to_json("body"), "UTF-8").alias("body")).select("root", to_variant(F.col("body"), "binary").alias("v"))
    c = Cursor(F.col("v"))
    return docs.select(F.col("root").cast("bigint").alias("c_custkey"), c.query("tags[-1]").as_("string").alias("nation"), c.size().alias("members"))


def decode_all_roots(spark: SparkSession, d: str) -> DataFrame:
    """Documents through the binary container and back."""
    blobs = _customers(spark, d).select(encode_blob(F.col("root"), F.to_json("body")).alias("blob"))
    back = blobs.select(F.explode(decode_blob(F.col("blob"))).alias("r")).select("r.root", F.parse_json("r.body").alias("v"))
    c = Cursor(F.col("v"))
    return back.select(F.col("root").cast("bigint").alias("c_custkey"), c.field("name").as_("string").alias("c_name"), c.field("nation").as_("int").alias("c_nationkey"))


def blob_path_query(spark: SparkSession, d: str) -> DataFrame:
    """Paths followed inside containers of one document each, nothing else decoded."""
    blobs = _clients(spark, d).select("root", encode_blob(F.col("root"), F.to_json("body")).alias("blob"))
    found = blobs.select("root", blob_query(F.col("blob"), F.col("root"), "nation.region").alias("r"), blob_query(F.col("blob"), F.col("root"), "tags[-1]").alias("t"), blob_query(F.col("blob"), F.col("root"), "tags.name").alias("none"))
    return found.select(F.col("root").cast("bigint").alias("c_custkey"), F.col("r.kind").alias("kind"), F.col("r.body").alias("region"), F.col("t.body").alias("tag"), F.col("none.body").alias("none"))


def blob_typed_read(spark: SparkSession, d: str) -> DataFrame:
    """The same, typed: a value of another kind is refused."""
    docs = _orders(spark, d).select(F.col("o_orderkey").cast("string").alias("root"), F.to_json("body").alias("body"))
    blobs = docs.select("root", encode_blob(F.col("root"), F.col("body")).alias("blob"))

    def read(path: str, target: str) -> F.Column:
        return blob_query(F.col("blob"), F.col("root"), path, target)["body"]

    return blobs.select(
        F.col("root").cast("bigint").alias("o_orderkey"), read("customer.key", "long").cast("bigint").alias("custkey"), read("total", "double").cast("double").alias("total"),
        read("lines[-1].n", "byte").cast("int").alias("last"), read("status", "long").alias("refused"),
    )


def blob_source_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents to containers of many roots each, as Parquet on the shared folder, and single paths read back."""
    path = fresh_path(spark, "blobs")
    pack_blobs(_clients(spark, d), F.col("root"), F.to_json("body"), max_bytes=200_000).write.parquet(path)
    back = read_blobs(spark.read.parquet(path), F.col("blob"), query="nation.name")
    return back.select(F.col("root").cast("bigint").alias("c_custkey"), "body")


def blob_format(spark: SparkSession, d: str) -> DataFrame:
    """The same through the format ``jsonloom_blob``, whole documents."""
    spark.dataSource.register(BlobDataSource)
    path = fresh_path(spark, "blobs")
    _clients(spark, d).select("root", F.to_json("body").alias("body")).write.format("jsonloom_blob").mode("append").option("max_bytes", 200_000).save(path)
    return spark.read.format("jsonloom_blob").load(path).select(F.col("root").cast("bigint").alias("c_custkey"), "body")


# Paths
def field_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _props(spark, d).select("event_id", Cursor(F.col("v")).field("k").as_("long").alias("k"))


def path_query(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _order_cursor(spark, d)
    return docs.select("o_orderkey", c.query("customer.key").as_("long").alias("custkey"), c.query("lines[0].part").as_("long").alias("first_part"))


def array_index(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _order_cursor(spark, d)
    return docs.select("o_orderkey", c.field("lines").index(0).field("n").as_("int").alias("line"), c.field("lines").index(2).field("n").as_("int").alias("third"))


def array_neg_index(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _order_cursor(spark, d)
    return docs.select("o_orderkey", c.query("lines[-1].n").as_("int").alias("last"), c.query("lines.-3.n").as_("int").alias("third_last"))


def read_segments(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _order_cursor(spark, d)
    return docs.select("o_orderkey", c.read("x.y", "a.b").as_("string").alias("priority"), c.query('["x.y"]["a.b"]').as_("string").alias("same"), c.query("x.y.a.b").as_("string").alias("none"))


def try_query(spark: SparkSession, d: str) -> DataFrame:
    """Paths that lead nowhere give NULL: missing keys, out of range, steps into scalars."""
    docs, c = _order_cursor(spark, d)
    paths = ("customer.missing", "lines[99].n", "status.deeper", "key[0]", "lines.n", "customer.note")
    docs = docs.select(*[c.query(p).value.isNotNull().cast("int").alias(f"p{i}") for i, p in enumerate(paths)])
    return docs.agg(*[F.sum(f"p{i}").alias(f"found_{i}") for i in range(len(paths))])


# Kinds and typed values


def kind_filter(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _order_cursor(spark, d)
    kinds = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.query(f).kind().alias("kind")) for f in ("key", "status", "open", "customer", "customer.note", "lines", "lines[0].qty")]))
    return docs.select(kinds.alias("k")).groupBy("k.field", "k.kind").agg(F.count(F.lit(1)).alias("n"))


def _as(target: str, path: str, name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs, c = _order_cursor(spark, d)
        other = c.query("status" if target != "string" else "key").as_(target)
        return docs.select("o_orderkey", c.query(path).as_(target).alias(name), other.isNull().alias("refused"))

    run.__name__ = f"as_{'bool' if target == 'bit' else target}"
    return run


as_int, as_long, as_double, as_string, as_bool = _as("int", "key", "value"), _as("long", "customer.key", "value"), _as("double", "total", "value"), _as("string", "status", "value"), _as("bit", "open", "value")
as_short = _as("short", "key", "value")


def as_null(spark: SparkSession, d: str) -> DataFrame:
    """JSON null, told from a missing member and from other values."""
    docs, c = _order_cursor(spark, d)
    note, gone, key = c.query("customer.note"), c.query("customer.gone"), c.field("key")
    return docs.select("o_orderkey", note.is_null().alias("note"), gone.is_null().alias("gone"), key.is_null().alias("key"), gone.kind().alias("no_kind"))


def strict_reads(spark: SparkSession, d: str) -> DataFrame:
    """Strict cursors where everything is there and of its kind (elsewhere the query fails)."""
    docs, c = _order_cursor(spark, d)
    c = Cursor(c.value, strict=True)
    return docs.select(
        "o_orderkey", c.query("customer.key").as_("long").alias("custkey"), c.field("status").as_("string").alias("status"), c.field("open").as_("bit").alias("open"),
        c.field("total").as_("double").alias("total"), c.field("lines").down_array().field("part").as_("long").alias("first_part"), c.field("customer").as_object().size().alias("members"),
    )


def _number_docs(spark: SparkSession, d: str) -> tuple[DataFrame, Cursor]:
    """Every literal as a member of a document; a literal that is no JSON gives no document."""
    text = F.concat(F.lit('{"n":'), "literal", F.lit("}"))
    docs = table(spark, d, "number_sheet").select("entry_id", text.alias("body")).withColumn("v", F.try_parse_json("body"))
    return docs, Cursor(F.col("v"), text=F.col("body")).field("n")


def number_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds inside documents, by each number's own text where VARIANT rounds it."""
    docs, c = _number_docs(spark, d)
    return docs.select("entry_id", c.kind().alias("kind"))


def _number(target: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs, c = _number_docs(spark, d)
        return docs.select("entry_id", c.as_(target).alias("value"))

    run.__name__ = f"as_{target}"
    return run


as_byte, as_bigint, as_float, as_bigdec = map(_number, ("byte", "bigint", "float", "bigdec"))


def bigint_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers of up to 19 digits as the container stores those beyond 64 bits."""
    n = F.col("o_orderkey") * F.col("o_custkey") * 1_000_003 - F.col("o_custkey") * F.lit(9_876_543_210)
    return table(spark, d, "orders").select("o_orderkey", F.hex(whole_bytes(n.cast("string"))).alias("stored"))


def reconstruct_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every literal packed to its value table and put together again: the same number, digit for digit."""
    sheet = table(spark, d, "number_sheet").select("entry_id", F.trim("literal").alias("literal"))
    back = Aggregate.pack(sheet, F.col("entry_id"), F.col("literal")).reconstruct()
    return back.select(F.col("doc").cast("bigint").alias("entry_id"), number_text(F.col("body")).alias("value"))


def match_kinds(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _order_cursor(spark, d)
    e = F.explode(F.array(*[c.query(f).value for f in ("status", "open", "customer", "lines", "customer.note")])).alias("e")
    text = {"string": F.try_variant_get(F.col("e"), "$", "string"), "bit": F.lit("yes/no"), "array": F.lit("list"), "null": F.lit("nothing")}
    return docs.select(e).select(match_kind(F.col("e"), text, F.lit("other")).alias("shown")).groupBy("shown").agg(F.count(F.lit(1)).alias("n"))


def classify_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Kind of every literal, by its exact text, in all three modes."""
    text = F.col("literal")
    return table(spark, d, "number_sheet").select("entry_id", *[number_kind(text, m).alias(m) for m in ("exact", "fast", "narrow")])


def classify_prices(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), r"\.00$", ".0")
    return table(spark, d, "orders").select(number_kind(text).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def bigdec_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = number_parts(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", parts.alias("p")).select("o_orderkey", "p.unscaled", F.col("p.scale").cast("int").alias("scale"), "p.precision", "p.signum")


# Enumeration


def object_entries(spark: SparkSession, d: str) -> DataFrame:
    return _specs(spark, d).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("spec_id", "key", kind_of(F.col("value")).alias("kind"))


def array_elements(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _order_cursor(spark, d)
    e = docs.select("o_orderkey", F.posexplode(c.field("lines").elements()).alias("pos", "e"))
    i = Cursor(F.col("e"))
    return e.select("o_orderkey", "pos", i.field("n").as_("int").alias("n"), i.field("qty").as_("double").alias("qty"), i.field("flag").as_("string").alias("flag"))


def container_size(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _order_cursor(spark, d)
    return docs.select("o_orderkey", c.field("lines").size().alias("lines"), c.size().alias("members"), c.field("status").size().alias("scalar"))


def array_left_right(spark: SparkSession, d: str) -> DataFrame:
    """Each line with its neighbours, by cursors that move; within the array, so without an exchange. Each line's part is
    taken out and read once, not again by each cursor that comes by."""
    docs, c = _order_cursor(spark, d)
    members = docs.select("o_orderkey", F.transform(c.query("lines").elements(), lambda e: Cursor(e).query("part").value).alias("members"))
    parts = members.select("o_orderkey", F.transform("members", lambda m: Cursor(m).as_("long")).alias("parts"))
    # outer, as from an inner one Spark infers filters on the array, and works it out in each of them again
    e = parts.select("o_orderkey", "parts", F.posexplode_outer("parts").alias("pos", "part")).where("pos is not null")
    at = ArrayCursor.over(F.col("parts"), F.col("pos"))
    return e.select("o_orderkey", "pos", *[x.value.alias(n) for x, n in ((at, "part"), (at.left(), "left"), (at.right(), "right"), (at.right().left(), "back"))])


def cursor_moves(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _order_cursor(spark, d)
    first, last = c.field("lines").down_array(), c.field("lines").down_index(-1)
    moves = {"first": first, "second": first.right(), "before": first.left(), "last": last, "behind": last.right(), "last_but_one": last.left()}
    stored = c.field("customer").read_key(0).as_("long")
    return docs.select("o_orderkey", stored.alias("stored_first"), *[m.field("n").as_("int").alias(n) for n, m in moves.items()])


# Key hashes


def _keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_name").alias("key")).unionByName(table(spark, d, "part").select(F.col("p_name").alias("key")))
    return c.unionByName(table(spark, d, "documents").select(F.col("mailbox").alias("key"))).where("key is not null").distinct()


def khash_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("key", khash(F.col("key")).alias("khash"))


def khash_buckets(spark: SparkSession, d: str) -> DataFrame:
    return khash_keys(spark, d).groupBy(khash_bucket(F.col("khash")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def entries_by_khash(spark: SparkSession, d: str) -> DataFrame:
    """Top-level keys of each document in stored order."""
    docs = _specs(spark, d).where(F.col("v").try_cast("map<string,variant>").isNotNull())
    return docs.select("spec_id", F.array_join(F.transform(Cursor(F.col("v")).entries(), lambda e: e["key"]), ",").alias("stored_order"))


def nth_key(spark: SparkSession, d: str) -> DataFrame:
    """The second entry in stored order of every document."""
    docs = _specs(spark, d).select("spec_id", F.try_element_at(Cursor(F.col("v")).entries(), F.lit(2))["key"].alias("key"))
    return docs.where("key is not null")


def path_split(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.lit("."), "p_brand", F.lit(".["), F.col("p_size").cast("string"), F.lit("]."), "p_type", F.lit("[-1]"))
    return table(spark, d, "part").select("p_partkey", F.array_join(path_steps(p), "/").alias("steps"))


# Shredding


def shred_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node of every specification."""
    nodes = shred(table(spark, d, "api_spec"), F.col("spec_id"), F.col("body"))
    whole = F.col("kind").isin("byte", "short", "int", "long")
    shown = F.coalesce("v_str", F.when(whole, F.col("v_long").cast("string")), F.col("v_bool").cast("string"))
    kind = F.when(whole, "whole").otherwise(F.col("kind"))
    return nodes.select(F.col("doc").cast("bigint").alias("spec_id"), "key", "depth", kind.alias("kind"), shown.alias("value"), "n_children")


def node_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = shred(_props(spark, d), F.col("event_id"), F.col("props"), columns=["doc", "path", "v_long"])
    return nodes.select(F.col("doc").cast("bigint").alias("event_id"), "path", "v_long")


def spec_paths(spark: SparkSession, d: str) -> DataFrame:
    """The distinct schema of all specifications: paths of every depth and kinds with the number of documents."""
    nodes = shred(table(spark, d, "api_spec"), F.col("spec_id"), F.col("body"), columns=["doc", "depth", "path", "kind"])
    return nodes.where("depth > 0").groupBy("path", "kind").agg(F.countDistinct("doc").alias("documents"))


def shred_refused(spark: SparkSession, d: str) -> DataFrame:
    """Why documents have no nodes."""
    out = None
    for t, k, c in (("event_log", "delivery_no", "payload"), ("theater_page", "page_id", "body"), ("api_spec", "spec_id", "body")):
        rows = unreadable(table(spark, d, t), F.col(k), F.col(c)).select(F.lit(t).alias("source"), "reason")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("documents"))


def shred_pages(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of all nodes of all pages and payloads."""
    p = shred(table(spark, d, "theater_page"), F.col("page_id"), F.col("body"), columns=["kind"])
    e = shred(table(spark, d, "event_log"), F.col("delivery_no"), F.col("payload"), columns=["kind"])
    both = p.select(F.lit("theater_page").alias("source"), "kind").unionByName(e.select(F.lit("event_log").alias("source"), "kind"))
    return both.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


def streamed_shred(spark: SparkSession, d: str) -> DataFrame:
    """The properties' nodes by a stream over the same file."""
    work = fresh_path(spark, "stream")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d.rstrip('/')}/events.parquet*")
    nodes = shred_stream(source, F.col("event_id"), F.col("props")).where("key = 'k'").select("doc", "v_long")
    nodes.writeStream.format("parquet").option("checkpointLocation", f"{work}/progress").option("path", f"{work}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(nodes.schema).parquet(f"{work}/out").select(F.col("doc").cast("bigint").alias("event_id"), F.col("v_long").alias("k"))


def facts_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event type, removed if it is an error."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return latest_facts(e, ["user_id"], F.col("event_id"), F.col("event_type") == "error")


# Deduplication


def _customer_nodes(spark: SparkSession, d: str) -> DataFrame:
    return shred(_customers(spark, d), F.col("root"), F.col("body"), columns=VALUE_COLUMNS)


def dedup_strings(spark: SparkSession, d: str) -> DataFrame:
    return value_frequencies(_customer_nodes(spark, d), ("string",)).select("value")


def dedup_numbers(spark: SparkSession, d: str) -> DataFrame:
    docs = _orders(spark, d).select("o_orderkey", F.struct("body.key", "body.customer").alias("body"))
    return value_frequencies(shred(docs, F.col("o_orderkey"), F.col("body"), columns=VALUE_COLUMNS), ("byte", "short", "int", "long")).select("kind", F.col("value").cast("bigint").alias("value"))


def value_freq(spark: SparkSession, d: str) -> DataFrame:
    return value_frequencies(_customer_nodes(spark, d), ("string",)).select("value", "n")


def _distinct_texts(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The distinct containers of the customers' documents with their content, and how often each occurs."""
    docs = _clients(spark, d)
    nodes = shred(docs, F.col("root"), F.col("body"), columns=["kind", "chash", "n_children"])
    texts = Aggregate.pack(docs, F.col("root"), F.col("body")).texts().where(F.col("kind") == kind)
    return distinct_trees(nodes, kind).join(texts, F.col("chash") == F.col("ref")).select("json", "n", "n_children")


def dedup_arrays(spark: SparkSession, d: str) -> DataFrame:
    return _distinct_texts(spark, d, "array")


def dedup_objects(spark: SparkSession, d: str) -> DataFrame:
    return _distinct_texts(spark, d, "object")


def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = dense_ids(table(spark, d, "customer").select("c_name").distinct(), "c_name")
    return ids.agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))


# Aggregates


def _packed(spark: SparkSession, d: str, **options: bool) -> Aggregate:
    return Aggregate.pack(_clients(spark, d), F.col("root"), F.col("body"), **options)


def pack_multi_root(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).summary()


def union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Two aggregates with shared values, united."""
    docs = _clients(spark, d)
    even = F.pmod(F.col("root").cast("int"), F.lit(2)) == 0
    one, two = Aggregate.pack(docs.where(even), F.col("root"), F.col("body")), Aggregate.pack(docs.where(~even), F.col("root"), F.col("body"))
    return one.union(two).summary()


def table_listing(spark: SparkSession, d: str) -> DataFrame:
    """Tables without sharing: a row for each occurrence, and one for each key."""
    return _packed(spark, d, dedup=False, dedup_primitives=False).summary()


def summary(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the orders' documents by kind."""
    return shred(_orders(spark, d), F.col("o_orderkey"), F.col("body"), columns=["kind"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def root_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One document of many, whole."""
    a = _packed(spark, d)
    one = Aggregate({**a.tables(), "root": a.root("7")}).reconstruct()
    return one.select(F.col("doc").cast("bigint").alias("c_custkey"), "body")


def aggregate_query(spark: SparkSession, d: str) -> DataFrame:
    """A path over the written tables, for all roots: only the references on the way and the values at its end are read."""
    path = fresh_path(spark, "aggregate")
    _packed(spark, d).write(path)
    found = Aggregate.read(spark, path).query("nation.region.name")
    return found.select(F.col("name").cast("bigint").alias("c_custkey"), "kind", "json")


def aggregate_roots(spark: SparkSession, d: str) -> DataFrame:
    """The same for three roots, a container with its content."""
    found = _packed(spark, d).query("nation.region", ["1", "2", "3"], whole=True)
    return found.select(F.col("name").cast("bigint").alias("c_custkey"), "kind", "json")


def deref_join(spark: SparkSession, d: str) -> DataFrame:
    """Members of all root objects with what their references point to: scalars of every kind; containers by kind alone."""
    a = Aggregate.pack(_orders(spark, d), F.col("o_orderkey"), F.col("body"))
    roots = a["root"].select("name", F.col("value.ref").alias("id"))
    members = roots.join(a["object"], "id").select("name", F.explode("value").alias("e")).select("name", "e.key", "e.ref.kind", "e.ref.ref")
    return a.values(members).select(F.col("name").cast("bigint").alias("o_orderkey"), "key", F.when(F.col("kind").isin("array", "object", "string", "bit"), F.col("kind")).otherwise("number").alias("kind"), "json")


def value_lookup(spark: SparkSession, d: str) -> DataFrame:
    """From a value to its id, and from there to the objects that refer to it."""
    a = _packed(spark, d)
    ids = a.lookup("string", "ASIA").select(F.col("id").alias("ref"), "value")
    e = a["object"].select("id", F.explode("value").alias("e")).select("id", "e.key", F.col("e.ref.ref").alias("ref"))
    return e.join(ids, "ref").groupBy("key", "value").agg(F.count(F.lit(1)).alias("objects"))


def key_join(spark: SparkSession, d: str) -> DataFrame:
    """Keys of all distinct objects by their string rows."""
    a = _packed(spark, d)
    keys = a["object"].select(F.explode("value").alias("e")).groupBy("e.key").agg(F.count(F.lit(1)).alias("objects")).select(string_id(F.col("key")).alias("id"), "objects")
    return keys.join(a["string"], "id").select(F.col("value").alias("key"), "objects")


def eager_scan(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate written, read again, and its strings listed."""
    path = fresh_path(spark, "aggregate")
    Aggregate.pack(_customers(spark, d), F.col("root"), F.col("body")).write(path)
    return Aggregate.read(spark, path)["string"].select("value")


def reconstruct_json(spark: SparkSession, d: str) -> DataFrame:
    """Orders packed to value tables and put together again: the whole text, members in stored order."""
    back = Aggregate.pack(_orders(spark, d), F.col("o_orderkey"), F.col("body")).reconstruct()
    return back.select(F.col("doc").cast("bigint").alias("o_orderkey"), "body")


def rebuild_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Properties shredded and put together again."""
    back = rebuild(json_of_nodes(shred(_props(spark, d), F.col("event_id"), F.col("props"))))
    return back.select(F.col("doc").cast("bigint").alias("event_id"), Cursor(F.parse_json("body")).field("k").as_("long").alias("k"))


def rewrite_strings(spark: SparkSession, d: str) -> DataFrame:
    """A packed table mapped value by value: every string in lower case, read back through the documents."""
    a = _packed(spark, d).rewrite("string", F.lower)
    return a.reconstruct().select(F.col("doc").cast("bigint").alias("c_custkey"), "body")


def sql_surface(spark: SparkSession, d: str) -> DataFrame:
    """The registered SQL functions: shredding and key hashes."""
    register(spark)
    table(spark, d, "events").createOrReplaceTempView("jsonloom_events")
    return spark.sql("SELECT event_id, n.key, khash(n.key) AS khash, n.v_long AS k FROM jsonloom_events LATERAL VIEW inline(shred_json(props)) n WHERE n.parent_id IS NOT NULL")


def native_shred(spark: SparkSession, d: str) -> DataFrame:
    """Specifications shredded by built-in functions alone, level by level: nodes by depth and kind."""
    return shred_native(_specs(spark, d).select(F.col("spec_id").alias("doc"), "v")).groupBy("depth", "kind").agg(F.count(F.lit(1)).alias("n"))


def sum_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The sum of the members named k over all nodes, by type of event."""
    nodes = shred(_props(spark, d), F.col("event_type"), F.col("props"), columns=["doc", "key", "kind", "v_long"])
    k = nodes.where("key = 'k' and kind in ('byte', 'short', 'int', 'long')")
    return k.groupBy(F.col("doc").alias("event_type")).agg(F.sum("v_long").alias("total"), F.count(F.lit(1)).alias("n"))


_NAMES = {"match_kinds": "match_kind", "khash_keys": "khash", "khash_buckets": "khash_bucket"}
QUERIES = {
    _NAMES.get(f.__name__, f.__name__): f
    for f in (
        json_source, json_lines, encode_from_struct, struct_dates, encode_from_string, decode_all_roots, blob_path_query, blob_typed_read, blob_source_roundtrip, blob_format, field_lookup,
        path_query, array_index, array_neg_index, read_segments, try_query, kind_filter, as_short, as_int, as_long, as_double, as_string, as_bool, as_byte, as_bigint, as_float, as_bigdec, as_null,
        strict_reads, number_kinds, match_kinds, classify_numbers, classify_prices, bigdec_parts, bigint_bytes, reconstruct_numbers, object_entries, array_elements, container_size, array_left_right, cursor_moves,
        khash_keys, khash_buckets, entries_by_khash, nth_key, path_split, shred_nodes, node_paths, spec_paths, shred_pages, shred_refused, streamed_shred, facts_latest, dedup_strings,
        dedup_numbers, value_freq, dedup_arrays, dedup_objects, assign_ids, pack_multi_root, union_dedup, table_listing, summary, root_lookup, aggregate_query, aggregate_roots, deref_join,
        value_lookup, key_join, eager_scan, reconstruct_json, rebuild_nodes, sum_by_key, rewrite_strings, sql_surface, native_shred,
    )
}

# The same results in SQL.

_KHASH = """CASE WHEN key = '' THEN 1806548719 ELSE list_reduce(list_transform(range(0, octet_length(encode(key))), lambda i: ('0x' || substr(hex(encode(key)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT),
 lambda a, b: (xor(a, (a << 13) & 4294967295) + ((xor(xor(a, (a << 13) & 4294967295), b) << 8) & 4294967295)) & 4294967295, CAST(1806548719 AS BIGINT)) END"""
_LINES = """l AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n_lines,
 lag(l_partkey) OVER w AS lft, lead(l_partkey) OVER w AS rgt FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag))"""
_ORDERS = f"WITH {_LINES}, o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"
#: The shortest decimal that reads back as the same FLOAT f.
_SHORTEST = "CASE " + " ".join(f"WHEN CAST(format('{{:.{n}g}}', CAST(f AS DOUBLE)) AS FLOAT) = f THEN CAST(format('{{:.{n}g}}', CAST(f AS DOUBLE)) AS DOUBLE)" for n in (6, 7, 8, 9)) + " END"
_KEYS = "k AS (SELECT DISTINCT key FROM (SELECT c_name AS key FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT mailbox FROM documents) WHERE key IS NOT NULL)"
_SPEC = f"e AS (SELECT spec_id, key, {_KHASH} AS khash FROM (SELECT spec_id, unnest(json_keys(body)) AS key FROM api_spec WHERE json_valid(body)))"
_CLIENT = "n AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
#: Texts of the documents of ``_clients``, members in order of key hash.
_REGION = """'{"key":' || r_regionkey || ',"name":"' || r_name || '"}'"""
_NATION = f"""'{{"region":' || {_REGION} || ',"key":' || n_nationkey || ',"name":"' || n_name || '"}}'"""
_TAGS = """'["' || c_mktsegment || '","' || n_name || '"]'"""
_DOC = f"""'{{"tags":' || {_TAGS} || ',"nation":' || {_NATION} || ',"name":"' || c_name || '"}}'"""


def _number_sql(c: str) -> str:
    """A DOUBLE as JSON text: whole numbers without a fraction."""
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


def _whole_kind(c: str) -> str:
    return f"CASE WHEN {c} BETWEEN -128 AND 127 THEN 'byte' WHEN {c} BETWEEN -32768 AND 32767 THEN 'short' WHEN {c} BETWEEN -2147483648 AND 2147483647 THEN 'int' ELSE 'long' END"


def _tree_kind(t: str = "") -> str:
    """The kind of a row of json_tree; its whole numbers by range (the documents have no others)."""
    names = {"OBJECT": "object", "ARRAY": "array", "VARCHAR": "string", "BOOLEAN": "bit", "NULL": "null"}
    return f"CASE {t}type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {_whole_kind(f'CAST({t}atom AS HUGEINT)')} END"


# Numbers by their digits: the literal (or a float's shortest text) as sign, digits without zeros at the ends, and exponent.


def _digits_sql(c: str) -> str:
    m = f"regexp_extract({c}, '^(-?)(0|[1-9][0-9]*)(?:\\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$', ['s', 'i', 'f', 'e'])"
    d = f"ltrim({m}.i || {m}.f, '0')"
    return f"""CASE WHEN regexp_full_match({c}, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN CASE WHEN {d} = '' THEN {{'s': '', 'd': '0', 'e': CAST(0 AS BIGINT)}}
 ELSE {{'s': {m}.s, 'd': rtrim({d}, '0'), 'e': CAST(CASE WHEN {m}.e = '' THEN '0' ELSE {m}.e END AS BIGINT) - length({m}.f) + length({d}) - length(rtrim({d}, '0'))}} END END"""


_NUMBERS = f"""WITH t AS (SELECT entry_id, literal, trim(literal) AS x FROM number_sheet),
d AS (SELECT *, {_digits_sql("x")} AS n, try_cast(x AS DOUBLE) AS r, try_cast(try_cast(x AS DOUBLE) AS FLOAT) AS f, regexp_matches(x, '[.eE]') AS real FROM t),
b AS (SELECT *, isfinite(r) AS has_r, coalesce(isfinite(f), false) AS has_f, {_digits_sql("CAST(r AS VARCHAR)")} AS rn, {_digits_sql("CAST(f AS VARCHAR)")} AS fn,
 CASE WHEN n.e >= 0 AND length(n.d) + n.e <= 19 THEN CAST(n.s || n.d || repeat('0', CAST(n.e AS INT)) AS HUGEINT) END AS w FROM d),
k AS (SELECT *, CASE WHEN n IS NULL THEN NULL WHEN n.e >= 0 THEN CASE WHEN w IS NULL OR w > 9223372036854775807 OR w < -9223372036854775808 THEN 'bigint' ELSE {_whole_kind("w")} END
 WHEN has_f AND fn = n THEN 'float' WHEN has_r AND rn = n THEN 'double' ELSE 'bigdec' END AS exact FROM b),
m AS (SELECT *, CASE WHEN n IS NULL OR NOT real OR NOT has_r THEN exact WHEN has_f AND CAST(f AS DOUBLE) = r THEN 'float' ELSE 'double' END AS fast,
 CASE WHEN n IS NULL OR NOT real THEN exact WHEN has_f THEN 'float' WHEN has_r THEN 'double' ELSE exact END AS narrow,
 CASE WHEN n.e >= 0 AND length(n.d) + n.e <= 1000 THEN n.s || n.d || repeat('0', CAST(n.e AS INT))
  WHEN n.e < 0 AND length(n.d) + n.e > 0 THEN n.s || left(n.d, CAST(length(n.d) + n.e AS INT)) || '.' || right(n.d, CAST(-n.e AS INT))
  WHEN n.e < 0 AND n.e >= -1000 THEN n.s || '0.' || repeat('0', CAST(-n.e - length(n.d) AS INT)) || n.d END AS value FROM k)"""


def _nth(i: str, c: str) -> str:
    return f"max({c}) FILTER (pos = {i})"


def _sizes(strings: str, objects: str, roots: str, arrays: str) -> str:
    rows = {"string": strings, "object": objects, "root": roots, "array": arrays}
    names = ("int", "long", "bigint", "float", "double", "bigdec", "string", "array", "object", "root")
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({rows.get(t, '0')} AS BIGINT) AS n" for t in names)


_SHARED = f"WITH {_CLIENT} " + _sizes(
    "(SELECT count(*) FROM (SELECT c_name FROM n UNION SELECT c_mktsegment FROM n UNION SELECT n_name FROM n UNION SELECT r_name FROM n UNION SELECT unnest(['name', 'tags', 'nation', 'region', 'key'])))",
    "(SELECT count(DISTINCT c_custkey) + count(DISTINCT n_nationkey) + count(DISTINCT r_regionkey) FROM n)", "(SELECT count(*) FROM n)",
    "(SELECT count(DISTINCT (c_mktsegment, n_name)) FROM n)",
)

SQL = {
    "json_source": " UNION ALL ".join(
        f"SELECT '{t}' AS source, count(*) AS texts, count(*) FILTER (json_valid({c})) AS documents FROM {t}" for t, c in (("events", "props"), ("api_spec", "body"), ("theater_page", "body"), ("event_log", "payload"))
    ),
    "encode_from_struct": "SELECT c_custkey, c_name, c_mktsegment AS segment FROM customer",
    "encode_from_string": "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, CAST(3 AS INT) AS members FROM customer",
    "decode_all_roots": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "field_lookup": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "path_query": f"{_ORDERS} SELECT o_orderkey, any_value(o_custkey) AS custkey, {_nth('0', 'l_partkey')} AS first_part FROM l GROUP BY o_orderkey",
    "array_index": f"{_ORDERS} SELECT o_orderkey, {_nth('0', 'l_linenumber')} AS line, {_nth('2', 'l_linenumber')} AS third FROM l GROUP BY o_orderkey",
    "array_neg_index": f"{_ORDERS} SELECT o_orderkey, {_nth('n_lines - 1', 'l_linenumber')} AS last, {_nth('n_lines - 3', 'l_linenumber')} AS third_last FROM l GROUP BY o_orderkey",
    "read_segments": f"{_ORDERS} SELECT o_orderkey, o_orderpriority AS priority, o_orderpriority AS same, CAST(NULL AS VARCHAR) AS none FROM o",
    "try_query": f"{_ORDERS} SELECT CAST(0 AS BIGINT) AS found_0, CAST(0 AS BIGINT) AS found_1, CAST(0 AS BIGINT) AS found_2, CAST(0 AS BIGINT) AS found_3, CAST(0 AS BIGINT) AS found_4, count(*) AS found_5 FROM o",
    "kind_filter": f"""{_ORDERS}, f AS (SELECT 'key' AS field, CASE WHEN o_orderkey BETWEEN -128 AND 127 THEN 'byte' WHEN o_orderkey BETWEEN -32768 AND 32767 THEN 'short' WHEN o_orderkey < 2147483648 THEN 'int' ELSE 'long' END AS kind FROM o
UNION ALL SELECT unnest(['status', 'open', 'customer', 'customer.note', 'lines']), unnest(['string', 'bit', 'object', 'null', 'array']) FROM o
UNION ALL SELECT 'lines[0].qty', CASE WHEN l_quantity <> floor(l_quantity) THEN 'float' WHEN l_quantity < 128 THEN 'byte' ELSE 'short' END FROM l WHERE pos = 0)
SELECT field, kind, count(*) AS n FROM f GROUP BY field, kind""",
    "as_short": f"{_ORDERS} SELECT o_orderkey, CASE WHEN o_orderkey < 32768 THEN CAST(o_orderkey AS SMALLINT) END AS value, true AS refused FROM o",
    "as_int": f"{_ORDERS} SELECT o_orderkey, CAST(o_orderkey AS INT) AS value, true AS refused FROM o",
    "as_long": f"{_ORDERS} SELECT o_orderkey, o_custkey AS value, true AS refused FROM o",
    "as_double": f"{_ORDERS} SELECT o_orderkey, o_totalprice AS value, true AS refused FROM o",
    "as_string": f"{_ORDERS} SELECT o_orderkey, o_orderstatus AS value, true AS refused FROM o",
    "as_bool": f"{_ORDERS} SELECT o_orderkey, o_orderstatus = 'O' AS value, true AS refused FROM o",
    "match_kind": f"{_ORDERS} SELECT shown, count(*) AS n FROM (SELECT unnest([o_orderstatus, 'yes/no', 'other', 'list', 'nothing']) AS shown FROM o) GROUP BY shown",
    "classify_prices": f"""SELECT CASE WHEN o_totalprice = floor(o_totalprice) THEN CASE WHEN o_totalprice < 128 THEN 'byte' WHEN o_totalprice < 32768 THEN 'short' ELSE 'int' END
 WHEN CAST({_SHORTEST} AS DECIMAL(18,6)) = CAST(o_totalprice AS DECIMAL(18,2)) THEN 'float' ELSE 'double' END AS kind, count(*) AS n FROM (SELECT *, CAST(o_totalprice AS FLOAT) AS f FROM orders) GROUP BY 1""",
    "bigdec_parts": """SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR) AS unscaled, CAST(2 AS INT) AS scale,
 CAST(length(CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR)) AS INT) AS precision, CAST(sign(o_totalprice) AS INT) AS signum FROM orders""",
    "object_entries": f"""SELECT spec_id, j.key AS key, {_tree_kind("j.")} AS kind FROM api_spec, json_each(CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END) j""",
    "array_elements": f"{_ORDERS} SELECT o_orderkey, CAST(pos AS INT) AS pos, l_linenumber AS n, l_quantity AS qty, l_returnflag AS flag FROM l",
    "container_size": f"{_ORDERS} SELECT o_orderkey, CAST(count(*) AS INT) AS lines, CAST(7 AS INT) AS members, CAST(NULL AS INT) AS scalar FROM l GROUP BY o_orderkey",
    "array_left_right": f'{_ORDERS} SELECT o_orderkey, CAST(pos AS INT) AS pos, l_partkey AS part, lft AS "left", rgt AS "right", CASE WHEN rgt IS NOT NULL THEN l_partkey END AS back FROM l',
    "khash": f"WITH {_KEYS} SELECT key, {_KHASH} AS khash FROM k",
    "khash_bucket": f"WITH {_KEYS} SELECT CAST(({_KHASH}) // 33554432 AS INT) AS bucket, count(*) AS n FROM k GROUP BY 1",
    "entries_by_khash": f"WITH {_SPEC} SELECT spec_id, string_agg(key, ',' ORDER BY khash, key) AS stored_order FROM e GROUP BY spec_id",
    "nth_key": f"WITH {_SPEC} SELECT spec_id, key FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY khash, key) AS i FROM e) WHERE i = 2",
    "path_split": "SELECT p_partkey, p_brand || '/' || p_size || '/' || p_type || '/-1' AS steps FROM part",
    "shred_nodes": """SELECT spec_id, CASE WHEN parent IS NULL OR pt = 'ARRAY' THEN NULL ELSE key END AS key, CAST(depth AS INT) AS depth,
 CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bit' WHEN 'NULL' THEN 'null' ELSE 'whole' END AS kind,
 CASE WHEN type = 'VARCHAR' THEN json_extract_string(atom, '$') WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN CAST(atom AS VARCHAR) END AS value, CAST(n AS INT) AS n_children
FROM (WITH RECURSIVE t AS (SELECT spec_id, j.* FROM api_spec, json_tree(CASE WHEN json_valid(body) THEN body END) j),
 d AS (SELECT spec_id, id, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.spec_id, t.id, d.depth + 1 FROM t JOIN d ON t.spec_id = d.spec_id AND t.parent = d.id)
 SELECT t.*, d.depth, p.type AS pt, coalesce(c.n, 0) AS n FROM t JOIN d USING (spec_id, id) LEFT JOIN t p ON p.spec_id = t.spec_id AND p.id = t.parent
 LEFT JOIN (SELECT spec_id, parent, count(*) AS n FROM t GROUP BY ALL) c ON c.spec_id = t.spec_id AND c.parent = t.id)""",
    "node_paths": "SELECT event_id, unnest(['', 'k']) AS path, unnest([NULL, CAST(json_extract(props, '$.k') AS BIGINT)]) AS v_long FROM events",
    "spec_paths": f"""SELECT path, kind, count(DISTINCT spec_id) AS documents FROM (WITH RECURSIVE t AS (SELECT spec_id, j.* FROM api_spec, json_tree(CASE WHEN json_valid(body) THEN body END) j),
 d AS (SELECT spec_id, id, type, atom, '' AS path FROM t WHERE parent IS NULL UNION ALL
  SELECT t.spec_id, t.id, t.type, t.atom, CASE WHEN d.type = 'ARRAY' THEN d.path || '[' || t.key || ']' WHEN d.path = '' THEN t.key ELSE d.path || '.' || t.key END FROM t JOIN d ON t.spec_id = d.spec_id AND t.parent = d.id)
 SELECT spec_id, path, {_tree_kind()} AS kind FROM d WHERE path <> '') GROUP BY path, kind""",
    "streamed_shred": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "facts_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) WHERE i = 1 AND event_type <> 'error'",
    "dedup_strings": "SELECT c_name AS value FROM customer UNION SELECT c_mktsegment FROM customer UNION SELECT CAST(c_nationkey AS VARCHAR) FROM customer",
    "dedup_numbers": f"{_ORDERS} SELECT CASE WHEN value < 128 THEN 'byte' WHEN value < 32768 THEN 'short' WHEN value < 2147483648 THEN 'int' ELSE 'long' END AS kind, value FROM (SELECT o_orderkey AS value FROM o UNION SELECT o_custkey FROM o)",
    "value_freq": "SELECT value, count(*) AS n FROM (SELECT c_name AS value FROM customer UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY value",
    "dedup_arrays": f"WITH {_CLIENT} SELECT {_TAGS} AS json, count(*) AS n, CAST(2 AS INT) AS n_children FROM n GROUP BY 1",
    "dedup_objects": f"""WITH {_CLIENT} SELECT {_DOC} AS json, count(*) AS n, CAST(3 AS INT) AS n_children FROM n GROUP BY 1
UNION ALL SELECT {_NATION}, count(*), CAST(3 AS INT) FROM n GROUP BY 1 UNION ALL SELECT {_REGION}, count(*), CAST(2 AS INT) FROM n GROUP BY 1""",
    "assign_ids": "SELECT CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) AS n, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS total FROM (SELECT DISTINCT c_name FROM customer)",
    "pack_multi_root": _SHARED,
    "union_dedup": _SHARED,
    "table_listing": f"WITH {_CLIENT} {_sizes('(SELECT 5 * count(*) + 5 FROM n)', '(SELECT 3 * count(*) FROM n)', '(SELECT count(*) FROM n)', '(SELECT count(*) FROM n)')}",
    "summary": f"""{_ORDERS}, w AS (SELECT o_orderkey AS w FROM o UNION ALL SELECT o_custkey FROM o UNION ALL SELECT unnest([l_partkey, l_suppkey, l_linenumber]) FROM l),
r AS (SELECT o_totalprice AS r FROM o UNION ALL SELECT l_quantity FROM l)
SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {_whole_kind("w")} AS kind, count(*) AS n FROM w GROUP BY 1
UNION ALL SELECT CASE WHEN r = floor(r) THEN {_whole_kind("r")} WHEN CAST({_SHORTEST} AS DECIMAL(18,6)) = CAST(r AS DECIMAL(18,6)) THEN 'float' ELSE 'double' END, count(*) FROM (SELECT r, CAST(r AS FLOAT) AS f FROM r) GROUP BY 1
UNION ALL SELECT 'object', (SELECT 3 * count(*) FROM o) + (SELECT count(*) FROM l) UNION ALL SELECT unnest(['array', 'bit', 'null']), count(*) FROM o
UNION ALL SELECT 'string', (SELECT 2 * count(*) FROM o) + (SELECT count(*) FROM l)) GROUP BY kind""",
    "root_lookup": f"WITH {_CLIENT} SELECT c_custkey, {_DOC} AS body FROM n WHERE c_custkey = 7",
    "deref_join": f"""{_ORDERS} SELECT o_orderkey, unnest(['lines', 'status', 'customer', 'open', 'x.y', 'key', 'total']) AS key, unnest(['array', 'string', 'object', 'bit', 'object', 'number', 'number']) AS kind,
 unnest([NULL, '"' || o_orderstatus || '"', NULL, CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END, NULL, CAST(o_orderkey AS VARCHAR), {_number_sql("o_totalprice")}]) AS json FROM o""",
    "key_join": f"""WITH {_CLIENT} SELECT key, CAST(sum(objects) AS BIGINT) AS objects FROM (SELECT unnest(['name', 'tags', 'nation']) AS key, count(*) AS objects FROM n
UNION ALL SELECT unnest(['name', 'region', 'key']), count(DISTINCT n_nationkey) FROM n UNION ALL SELECT unnest(['name', 'key']), count(DISTINCT r_regionkey) FROM n) GROUP BY key""",
    "eager_scan": "SELECT c_name AS value FROM customer UNION SELECT c_mktsegment FROM customer UNION SELECT CAST(c_nationkey AS VARCHAR) FROM customer UNION SELECT unnest(['name', 'tags', 'nation'])",
    "reconstruct_json": f"""{_ORDERS} SELECT o_orderkey, '{{"lines":[' || string_agg('{{"part":' || l_partkey || ',"n":' || l_linenumber || ',"supp":' || l_suppkey || ',"flag":"' || l_returnflag || '","qty":' || {_number_sql("l_quantity")} || '}}', ',' ORDER BY pos)
 || '],"status":"' || any_value(o_orderstatus) || '","customer":{{"key":' || any_value(o_custkey) || ',"note":null}},"open":' || any_value(CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END)
 || ',"x.y":{{"a.b":"' || any_value(o_orderpriority) || '"}},"key":' || o_orderkey || ',"total":' || any_value({_number_sql("o_totalprice")}) || '}}' AS body FROM l GROUP BY o_orderkey""",
    "rebuild_nodes": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "rewrite_strings": f"WITH {_CLIENT} SELECT c_custkey, {_DOC.replace('c_mktsegment', 'lower(c_mktsegment)').replace('n_name', 'lower(n_name)').replace('r_name', 'lower(r_name)').replace('c_name', 'lower(c_name)')} AS body FROM n",
    "sql_surface": f"SELECT event_id, key, {_KHASH} AS khash, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM (SELECT *, 'k' AS key FROM events)",
    "native_shred": f"""SELECT depth, {_tree_kind()} AS kind, count(*) AS n
FROM (WITH RECURSIVE t AS (SELECT spec_id, j.* FROM api_spec, json_tree(CASE WHEN json_valid(body) THEN body END) j),
 d AS (SELECT spec_id, id, CAST(0 AS INT) AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.spec_id, t.id, d.depth + 1 FROM t JOIN d ON t.spec_id = d.spec_id AND t.parent = d.id)
 SELECT t.type, t.atom, d.depth FROM t JOIN d USING (spec_id, id)) GROUP BY 1, 2""",
    "sum_by_key": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type",
    "json_lines": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1",
    "struct_dates": "SELECT o_orderkey, 'string' AS kind, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders",
    "blob_path_query": f"WITH {_CLIENT} SELECT c_custkey, 'object' AS kind, {_REGION} AS region, '\"' || n_name || '\"' AS tag, CAST(NULL AS VARCHAR) AS none FROM n",
    "blob_typed_read": f"{_ORDERS} SELECT o_orderkey, any_value(o_custkey) AS custkey, any_value(o_totalprice) AS total, {_nth('n_lines - 1', 'l_linenumber')} AS last, CAST(NULL AS VARCHAR) AS refused FROM l GROUP BY o_orderkey",
    "blob_source_roundtrip": f"WITH {_CLIENT} SELECT c_custkey, '\"' || n_name || '\"' AS body FROM n",
    "blob_format": f"WITH {_CLIENT} SELECT c_custkey, {_DOC} AS body FROM n",
    "as_null": f"{_ORDERS} SELECT o_orderkey, true AS note, false AS gone, false AS key, CAST(NULL AS VARCHAR) AS no_kind FROM o",
    "strict_reads": f"""{_ORDERS} SELECT o_orderkey, any_value(o_custkey) AS custkey, any_value(o_orderstatus) AS status, any_value(o_orderstatus = 'O') AS open, any_value(o_totalprice) AS total,
 {_nth('0', 'l_partkey')} AS first_part, CAST(2 AS INT) AS members FROM l GROUP BY o_orderkey""",
    "number_kinds": f"{_NUMBERS} SELECT entry_id, exact AS kind FROM m",
    "classify_numbers": f"{_NUMBERS} SELECT entry_id, exact, fast, narrow FROM m",
    "as_byte": f"{_NUMBERS} SELECT entry_id, CASE WHEN exact = 'byte' THEN CAST(w AS TINYINT) END AS value FROM m",
    "as_bigint": f"{_NUMBERS} SELECT entry_id, CASE WHEN n.e >= 0 THEN value END AS value FROM m",
    "as_float": f"{_NUMBERS} SELECT entry_id, CASE WHEN exact IN ('byte', 'short', 'int', 'long', 'float') THEN CAST(r AS FLOAT) END AS value FROM m",
    "as_bigdec": f"{_NUMBERS} SELECT entry_id, CASE WHEN exact <> 'bigint' THEN value END AS value FROM m",
    "reconstruct_numbers": f"{_NUMBERS} SELECT entry_id, value FROM m WHERE n IS NOT NULL",
    "cursor_moves": f"""{_ORDERS} SELECT o_orderkey, any_value(o_custkey) AS stored_first, {_nth('0', 'l_linenumber')} AS first, {_nth('1', 'l_linenumber')} AS second, CAST(NULL AS INT) AS before,
 {_nth('n_lines - 1', 'l_linenumber')} AS last, CAST(NULL AS INT) AS behind, {_nth('n_lines - 2', 'l_linenumber')} AS last_but_one FROM l GROUP BY o_orderkey""",
    "shred_pages": f"""SELECT source, {_tree_kind("j.")} AS kind, count(*) AS n FROM (SELECT 'theater_page' AS source, body AS b FROM theater_page UNION ALL SELECT 'event_log', payload FROM event_log) s,
 json_tree(CASE WHEN json_valid(b) THEN b END) j GROUP BY 1, 2""",
    "shred_refused": " UNION ALL ".join(
        f"SELECT '{t}' AS source, CASE WHEN {c} IS NULL THEN 'null' WHEN trim({c}) = '' THEN 'empty' ELSE 'no JSON' END AS reason, count(*) AS documents FROM {t} WHERE {c} IS NULL OR NOT json_valid({c}) GROUP BY 2"
        for t, c in (("event_log", "payload"), ("theater_page", "body"), ("api_spec", "body"))
    ),
    "aggregate_query": f"WITH {_CLIENT} SELECT c_custkey, 'string' AS kind, '\"' || r_name || '\"' AS json FROM n",
    "aggregate_roots": f"WITH {_CLIENT} SELECT c_custkey, 'object' AS kind, {_REGION} AS json FROM n WHERE c_custkey BETWEEN 1 AND 3",
    "value_lookup": f"WITH {_CLIENT} SELECT 'name' AS key, 'ASIA' AS value, count(DISTINCT r_regionkey) AS objects FROM n WHERE r_name = 'ASIA' GROUP BY ALL",
    "bigint_bytes": """WITH n AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * o_custkey * 1000003 - CAST(o_custkey AS HUGEINT) * 9876543210 AS n FROM orders),
b AS (SELECT *, list_filter([1, 2, 3, 4, 5, 6, 7, 8], lambda k: n >= -CAST(pow(2, 8 * k - 1) AS HUGEINT) AND n < CAST(pow(2, 8 * k - 1) AS HUGEINT))[1] AS k FROM n)
SELECT o_orderkey, lpad(to_hex(CASE WHEN n < 0 THEN n + CAST(pow(2, 8 * k) AS HUGEINT) ELSE n END), CAST(2 * k AS INT), '0') AS stored FROM b""",
}
