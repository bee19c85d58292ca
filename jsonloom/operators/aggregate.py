"""The aggregate: many documents as ten deduplicated value tables, and back."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.functions.paths import Step, parse_path
from jsonloom.kinds import INLINE, TABLES
from jsonloom.operators.shred import HASH_CHARS, shred, value_id
from jsonloom.session import stage

_VALUE = {"int": "v_long", "long": "v_long", "bigint": "v_big", "float": "v_double", "double": "v_double", "bigdec": "v_big", "string": "v_str"}
_PIECE = ("up_kind", "up", "height", "i", "key", "json")
#: Kinds whose ids say their values, of strings the short ones.
_OWN = ("int", "long", "float", "double", "string")
BUCKETS = 4096
#: What ``value_frequencies`` needs of nodes.
VALUE_COLUMNS = ("kind", "v_bool", "v_long", "v_double", "v_big", "v_str")


def string_id(text: Column) -> Column:
    """The id of a string, as value or as key."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else value_id("string", t))

    return run(text)


class Aggregate:
    """Ten tables: one row for each distinct value of a kind, array, object and root.

    Ids follow from content (``value_id``), so tables of different aggregates can be united and deduplicated again;
    dense ids are made on export (``dense_ids``). Entries of objects are sorted by key hash.

    own: the kinds of scalars whose ids still say their values (not after ``rewrite``; unknown of tables from elsewhere), which
    need no look into their tables. containers: arrays and objects before equal ones were dropped, roots before their names were checked."""

    def __init__(self, tables: dict[str, DataFrame], own: frozenset[str] = frozenset(), containers: dict[str, DataFrame] | None = None) -> None:
        self._tables, self._own, self._containers = tables, own, containers or {}

    @staticmethod
    def pack(documents: DataFrame, root: Column, body: Column, *, numeric_mode: str = "exact", dedup: bool = True, dedup_primitives: bool = True) -> Aggregate:
        """Pack documents under their root names. Off, ``dedup`` (arrays, objects, roots) and
        ``dedup_primitives`` give a row for each occurrence; what is read back is the same.

        Root names must be distinct, NULL counting as one: whatever reads the roots of others fails. Documents that
        can't be read are left out (``unreadable`` lists them). Nodes are written once, parted by kind, so that each
        table reads its own; with both on, a batch of documents writes equal ones once."""
        placed = [] if dedup and dedup_primitives else ["node_id"]  # else nothing depends on where a value stands
        columns = ["doc", *placed, "depth", "key", *VALUE_COLUMNS, "chash", "height", "entries"]
        nodes = shred(documents, root, body, numeric_mode=numeric_mode, columns=columns, once=not placed)
        if not placed:
            nodes = nodes.withColumn("doc", F.when(F.col("depth") == 0, F.col("doc"))).withColumn("node_id", F.lit(None).cast("string"))
        nodes = stage(nodes, "nodes", by="kind", codec="zstd")
        return Aggregate.of_nodes(nodes, dedup=dedup, dedup_primitives=dedup_primitives)

    @staticmethod
    def of_nodes(nodes: DataFrame, *, dedup: bool = True, dedup_primitives: bool = True) -> Aggregate:
        """From nodes with their entries (``shred(..., entries=True)``)."""
        where = (F.length("doc").cast("string"), F.col("doc"))  # the length, as names and values may hold any character
        place = F.concat_ws("#", *where, "node_id", "chash")  # an id for each occurrence
        is_nested = F.col("kind").isin("array", "object")
        rows = nodes.withColumn("id_", F.when(is_nested, F.col("chash") if dedup else place).otherwise(F.col("chash") if dedup_primitives else place))
        ref = F.struct(F.col("kind"), F.when(F.col("kind").isin(*INLINE), F.col("chash")).otherwise(F.col("id_")).alias("ref"))
        tables: dict[str, DataFrame] = {}
        for kind, column in _VALUE.items():
            values = rows.where(F.col("kind") == kind).select(F.col("id_").alias("id"), F.col(column).alias("value"))
            values = values.dropDuplicates(["id"]) if dedup_primitives else values
            if kind == "string":
                keys = rows.where("key is not null").select("key").distinct().select(string_id(F.col("key")).alias("id"), F.col("key").alias("value"))
                values = values.unionByName(keys)
                values = values.dropDuplicates(["id"]) if dedup_primitives else values
            tables[kind] = values

        def entry(e: Column, i: Column) -> Column:
            own = F.concat_ws("#", *where, F.concat("node_id", F.lit("."), (i + 1).cast("string")), e["ref"])
            shared = F.lit(dedup) if dedup == dedup_primitives else F.when(e["kind"].isin("array", "object"), dedup).otherwise(dedup_primitives)
            id_ = F.when(e["kind"].isin(*INLINE) | shared, e["ref"]).otherwise(own)
            return F.struct(e["khash"].alias("khash"), e["key"].alias("key"), F.struct(e["kind"].alias("kind"), id_.alias("ref")).alias("ref"))

        held = F.transform("entries", entry)
        containers = {}
        for kind, value in (("array", F.transform(held, lambda e: e["ref"])), ("object", F.array_sort(held))):
            mine = rows.where(F.col("kind") == kind).select(F.col("id_").alias("id"), "entries", "height", "doc", "node_id")
            containers[kind] = mine.select("id", value.alias("value"), "height")
            mine = mine.dropDuplicates(["id"]) if dedup else mine
            tables[kind] = mine.select("id", value.alias("value"), "height")
        containers["root"] = rows.where("depth = 0").select(F.col("doc").alias("name"), ref.alias("value"))
        tables["root"] = _distinct_names(containers["root"])
        return Aggregate({t: tables[t] for t in TABLES}, frozenset(_OWN) if dedup_primitives else frozenset(), containers)

    def tables(self) -> dict[str, DataFrame]:
        return dict(self._tables)

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def write(self, path: str) -> None:
        """A folder of Parquet tables; objects and arrays clustered by id."""
        for name, df in self._tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Aggregate:
        """Lazy: only the tables and columns that a query touches are read."""
        return Aggregate({t: spark.read.parquet(f"{path}/{t}") for t in TABLES})

    def rewrite(self, name: str, f: Callable[[Column], Column]) -> Aggregate:
        """One scalar table mapped value by value. Ids stay, so whatever refers to a value sees the new one;
        keys of objects are kept with the objects and don't change."""
        if name not in _VALUE:
            raise ValueError(f"{name} isn't a table of scalars")
        mapped = self._tables[name].select("id", f(F.col("value")).alias("value"))
        return Aggregate({**self._tables, name: mapped}, self._own - {name}, self._containers)

    def union(self, other: Aggregate) -> Aggregate:
        """Both aggregates' documents, values shared between them once. A root name of both is an error."""
        both = {t: self._tables[t].unionByName(other._tables[t]) for t in TABLES}
        return Aggregate({t: _distinct_names(df) if t == "root" else df.dropDuplicates(["id"]) for t, df in both.items()}, self._own & other._own)

    def summary(self) -> DataFrame:
        """(table_name, n): rows of each table."""
        out = None
        for t, df in self._tables.items():
            row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
            out = row if out is None else out.unionByName(row)
        assert out is not None
        return out

    def root(self, name: str) -> DataFrame:
        """The root of that name; no row if there is none."""
        return self._tables["root"].where(F.col("name") == name)

    def scalars(self) -> DataFrame:
        """(kind, ref, json): every value that has a row of its own, as JSON text."""
        out = None
        for kind in _VALUE:
            value = F.col("value")
            text = _quoted("value") if kind == "string" else shortest(value) if kind in ("float", "double") else value.cast("string")
            one = self._tables[kind].select(F.lit(kind).alias("kind"), F.col("id").alias("ref"), text.alias("json"))
            out = one if out is None else out.unionByName(one)
        assert out is not None
        return out

    def values(self, refs: DataFrame, kind: str = "kind", ref: str = "ref") -> DataFrame:
        """``refs`` with ``json``, the text of the scalar that each reference of kind and ref points to; NULL for containers."""
        known = self.scalars().select(F.col("kind").alias("kind_"), F.col("ref").alias("ref_"), F.col("json").alias("json_"))
        told = self._told(F.col(kind), F.col(ref))
        stored = F.when(~F.col(kind).isin(*INLINE, "array", "object") & told.isNull(), F.col(ref))
        found = refs.join(known, (F.col(kind) == F.col("kind_")) & (stored == F.col("ref_")), "left")
        return found.withColumn("json", F.coalesce(told, F.col("json_"))).drop("kind_", "ref_", "json_")

    def lookup(self, kind: str, value: Column | str | float) -> DataFrame:
        """(id, value): the row of a scalar, by its value."""
        if kind not in _VALUE:
            raise ValueError(f"{kind} isn't a table of scalars")
        return self._tables[kind].where(F.col("value") == value).select("id", "value")

    def follow(self, path: str | Sequence[Step], roots: Sequence[str] | None = None) -> DataFrame:
        """(name, kind, ref): the references at a path of every root, or only of ``roots``; none where it leads nowhere.

        Each step is one join of the references with the arrays or objects by id, which keeps of them the one
        member asked for; scalars and the rest of the documents aren't read."""
        at = self._tables["root"] if roots is None else self._tables["root"].where(F.col("name").isin(*roots))
        at = at.select("name", "value.kind", "value.ref")
        for step in parse_path(path) if isinstance(path, str) else path:
            moves = []
            if isinstance(step, str):
                entry = F.try_element_at(F.filter("value", _has_key(step)), F.lit(1))
                moves.append(("object", self._tables["object"].select(F.col("id").alias("ref"), entry["ref"].alias("to"))))
            if isinstance(step, int) or re.fullmatch(r"-?[0-9]+", step):
                i = int(step)
                moves.append(("array", self._tables["array"].select(F.col("id").alias("ref"), F.try_element_at("value", F.lit(i + 1 if i >= 0 else i)).alias("to"))))
            steps = [at.where(F.col("kind") == k).join(t.where("to is not null"), "ref").select("name", "to.kind", "to.ref") for k, t in moves]
            at = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
        return at

    def query(self, path: str | Sequence[Step], roots: Sequence[str] | None = None, *, whole: bool = False) -> DataFrame:
        """(name, kind, json): the values at a path of every root, or of ``roots``. Containers have json only with ``whole``."""
        found = self.values(self.follow(path, roots))
        if not whole:
            return found.select("name", "kind", "json")
        texts = self.texts().select("kind", "ref", F.col("json").alias("text_"))
        return found.join(texts, ["kind", "ref"], "left").select("name", "kind", F.coalesce("json", "text_").alias("json"))

    def texts(self) -> DataFrame:
        """(kind, ref, json): the text of every distinct array and object, members in stored order."""
        out = None
        for level in self._levels().values():
            out = level if out is None else out.unionByName(level)
        assert out is not None
        return out

    def _levels(self) -> dict[int, DataFrame]:
        """The texts by height of the containers (1 is always there).

        Bottom-up, in the JVM: containers whose members' references say their values are put together where they are
        read, and equal ones dropped. The others are taken apart; each height's texts are joined once with all the members
        that refer to them (a reference says the height), and the next height follows by one aggregation by container; so a
        shared subtree is written once, however often it occurs. Scalar tables are read only if some reference doesn't
        tell its value. A hot value's join is split by adaptive execution."""
        simple, parts = zip(*(self._parted(t) for t in ("array", "object")), strict=True)
        first = simple[0].unionByName(simple[1])
        levels = {1: first.dropDuplicates(["kind", "ref"]) if self._containers else first}
        entries = parts[0].unionByName(parts[1]).select("up_kind", "up", "height", "e.i", "e.key", "e.kind", "e.ref").withColumn("json", self._told(F.col("kind"), F.col("ref")))
        below = F.when(F.col("json").isNotNull(), -1).when(F.col("kind").isin("array", "object"), _height(F.col("ref"))).otherwise(0)  # what it waits for: nothing, scalars, a height
        staged = stage(entries.withColumn("below", below), "pieces", by="height", codec="zstd")
        if not staged.where("below is null").isEmpty():
            raise ValueError("references without their heights, of tables packed before there were any: pack them again")
        pairs = {(r.height, r.below) for r in staged.select("height", "below").distinct().collect()}
        solved = {-1: staged.where("below = -1").select(*_PIECE)}
        if any(b == 0 for _, b in pairs):
            solved[0] = stage(staged.where("below = 0").drop("json").join(self.scalars(), ["kind", "ref"]).select(*_PIECE), "scalars", by="height", codec="zstd")
        for height in sorted({h for pair in pairs for h in pair if h > 0}):
            pieces: DataFrame | None = None
            for b in sorted(b for h, b in pairs if h == height):
                some = solved[b].where(F.col("height") == height)
                pieces = some if pieces is None else pieces.unionByName(some)
            if pieces is not None:
                key = F.when(F.col("key").isNotNull(), F.concat(_quoted("key"), F.lit(":"))).otherwise("")
                held = F.array_sort(F.collect_list(F.struct("i", F.concat(key, F.col("json")).alias("text"))))
                inner = F.array_join(F.transform(held, lambda x: x["text"]), ",")
                is_array = F.col("up_kind") == "array"
                level = pieces.groupBy("up_kind", "up").agg(inner.alias("inner")).select(
                    F.col("up_kind").alias("kind"), F.col("up").alias("ref"),
                    F.concat(F.when(is_array, "[").otherwise("{"), "inner", F.when(is_array, "]").otherwise("}")).alias("json"),
                )
                level = stage(level, "texts", codec="zstd")
                levels[height] = levels[height].unionByName(level) if height in levels else level
            if any(b == height for _, b in pairs):
                waiting = staged.where(F.col("below") == height).drop("json")
                solved[height] = stage(waiting.join(levels[height], ["kind", "ref"]).select(*_PIECE), "members", by="height", codec="zstd")
        return levels

    def _parted(self, name: str) -> tuple[DataFrame, DataFrame]:
        """Of one table of containers: the texts of those whose members all say their values, and the members of the others."""
        is_array = name == "array"

        def of(e: Column) -> Column:
            return e if is_array else e["ref"]

        def text(e: Column) -> Column:
            value = self._told(of(e)["kind"], of(e)["ref"])
            return value if is_array else F.concat(_quoted_short(e["key"]), F.lit(":"), value)

        def member(e: Column, i: Column) -> Column:
            return F.struct(i.alias("i"), (F.lit(None).cast("string") if is_array else e["key"]).alias("key"), of(e)["kind"].alias("kind"), of(e)["ref"].alias("ref"))

        rows = self._containers.get(name, self._tables[name])
        told = F.forall("value", lambda e: self._tells(of(e)["kind"], of(e)["ref"]))
        joined = F.array_join(F.transform("value", text), ",")
        whole = rows.where(told).select(F.lit(name).alias("kind"), F.col("id").alias("ref"), F.concat(F.lit("[" if is_array else "{"), joined, F.lit("]" if is_array else "}")).alias("json"))
        mixed = rows.where(~told).select("id", "height", "value")
        mixed = mixed.dropDuplicates(["id"]) if self._containers else mixed
        return whole, mixed.select(F.lit(name).alias("up_kind"), F.col("id").alias("up"), "height", F.explode(F.transform("value", member)).alias("e"))

    def _tells(self, kind: Column, ref: Column) -> Column:
        """Whether ``_told`` is a text."""
        tells = kind.isin(*INLINE, *(self._own - {"string"}))
        return tells | ((kind == "string") & ref.startswith("'")) if "string" in self._own else tells

    def _told(self, kind: Column, ref: Column) -> Column:
        """The text of a value that its reference says; NULL for others. (The mark of a string is no part of it.)"""
        numbers = sorted(self._own - {"string"})
        told = _inline(kind, ref).when(kind.isin(*numbers), ref) if numbers else _inline(kind, ref)
        if "string" in self._own:
            told = told.when((kind == "string") & ref.startswith("'"), _quoted_short(F.substring(ref, 2, HASH_CHARS)))
        return told

    def reconstruct(self) -> DataFrame:
        """(doc, body): every root as JSON text again."""
        roots = self._tables["root"].select(F.col("name").alias("doc"), "value.kind", "value.ref")
        scalar = ~F.col("kind").isin("array", "object")
        seen = self._containers["root"].select("value.kind", "value.ref") if "root" in self._containers else None  # cheap to look through
        unknown = seen is None or not seen.where(scalar & ~self._tells(F.col("kind"), F.col("ref"))).isEmpty()
        told = roots.where(scalar | _height(F.col("ref")).isNull())
        told = self.values(told) if unknown else told.withColumn("json", self._told(F.col("kind"), F.col("ref")))
        unnamed = F.raise_error(F.lit("a reference without its height, of tables packed before there was one: pack them again")).cast("string")
        out = told.select("doc", F.when(scalar, F.col("json")).otherwise(unnamed).alias("body"))
        levels = self._levels()
        heights = levels if seen is None else {r.h for r in seen.where(~scalar).select(_height(F.col("ref")).alias("h")).distinct().collect()}
        for h in sorted(heights):
            out = out.unionByName(roots.where(~scalar & (_height(F.col("ref")) == h)).join(levels[h], ["kind", "ref"]).select("doc", F.col("json").alias("body")))
        return out


def _has_key(key: str) -> Callable[[Column], Column]:
    return lambda entry: entry["key"] == key


def _distinct_names(roots: DataFrame) -> DataFrame:
    """The roots; an error in the query if a name occurs twice."""
    once = roots.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
    message = F.concat(F.lit("two roots are named "), F.coalesce("name", F.lit("NULL")))
    return once.select("name", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(message).cast(dict(once.dtypes)["value"])).alias("value"))


def _height(ref: Column) -> Column:
    """The height that a container's reference says; NULL of what is none."""
    return F.substring_index(ref, ".", -1).try_cast("int")


def _inline(kind: Column, ref: Column) -> Column:
    """The text of a value that its reference holds itself; NULL for others."""
    return F.when(kind == "null", "null").when(kind == "bit", F.when(ref == "1", "true").otherwise("false")).when(kind.isin("byte", "short"), ref)


def _quoted_short(text: Column) -> Column:
    """The same of a column; at once where nothing needs an escape."""
    made = F.to_json(F.struct(text.alias("v")))
    return F.when(text.rlike(r"^[ !#-\[\]-~]*$"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.substring(made, 6, F.length(made) - 6))


def _quoted(name: str) -> Column:
    """A string as JSON text."""
    return F.expr(f"substring(to_json(named_struct('v', {name})), 6, length(to_json(named_struct('v', {name}))) - 6)")


def shortest(value: Column) -> Column:
    """A double as the shortest text that reads back as it. (The JVM writes a longer one now and then, which is another number.)"""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x else repr(x) for x in s.tolist()], dtype=object)

    return run(value)


def rebuild(nodes: DataFrame) -> DataFrame:
    """(doc, body) of nodes (doc, node_id, key, kind, json). One exchange by document; a document's nodes are
    put together in one task, as its text is."""
    packed = nodes.groupBy("doc").agg(F.collect_list(F.struct("node_id", "key", "kind", "json")).alias("nodes"))

    @F.pandas_udf("string")
    def joined(nodes: pd.Series) -> pd.Series:
        return nodes.map(lambda rows: document_text([(r["node_id"], r["key"], r["kind"], r["json"]) for r in rows]))

    return packed.select("doc", joined("nodes").alias("body"))


def document_text(rows: list[tuple[str, str | None, str, str | None]]) -> str:
    """JSON text of a document's nodes."""
    text: dict[str, str] = {}
    inside: dict[str, list[tuple[tuple[int, ...], str | None, str]]] = {}
    for label, key, kind, value in sorted(rows, key=lambda r: (-r[0].count("."), r[0])):
        if kind in ("array", "object"):
            held = sorted(inside.pop(label, []), key=lambda x: x[0])
            if kind == "array":
                value = "[" + ",".join(text.pop(x[2]) for x in held) + "]"
            else:
                value = "{" + ",".join(json.dumps(x[1], ensure_ascii=False) + ":" + text.pop(x[2]) for x in held) + "}"
        text[label] = value or "null"
        parent = label.rpartition(".")[0]
        if parent:
            inside.setdefault(parent, []).append((tuple(map(int, label.split("."))), key, label))
    return text["1"]


def json_of_nodes(nodes: DataFrame) -> DataFrame:
    """Shredded nodes (schema NODES) with ``json``, the text of scalars, ready for ``rebuild``."""
    value = (
        F.when(F.col("kind") == "null", "null")
        .when(F.col("kind") == "bit", F.col("v_bool").cast("string"))
        .when(F.col("kind") == "string", _quoted("v_str"))
        .otherwise(F.coalesce(F.col("v_long").cast("string"), F.col("v_big"), shortest(F.col("v_double"))))
    )
    return nodes.select("doc", "node_id", "key", "kind", value.alias("json"))


def dense_ids(rows: DataFrame, by: str, name: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ids 0, 1, 2 ... without a gap, in an order that a hash of ``by`` (distinct values) gives.

    Hash buckets are numbered within themselves, and a table of as many sums shifts each; so no task
    sees more than its buckets, and the broadcast has ``buckets`` rows at most. Choose them so that one
    has some million rows."""
    from pyspark.sql import Window

    marked = rows.withColumn("bucket_", F.pmod(F.xxhash64(F.col(by)), F.lit(buckets)))
    sizes = marked.groupBy("bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.select("bucket_", (F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))).alias("before_"))
    within = F.row_number().over(Window.partitionBy("bucket_").orderBy(F.col(by))) - 1
    numbered = marked.join(F.broadcast(before), "bucket_").withColumn(name, (within + F.coalesce("before_", F.lit(0))).cast("bigint"))
    return numbered.drop("bucket_", "before_")


def value_frequencies(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, value, n): how often each distinct scalar of ``kinds`` occurs; values as text."""
    value = F.coalesce("v_str", F.col("v_long").cast("string"), "v_big", F.col("v_double").cast("string"), F.col("v_bool").cast("string"))
    return nodes.where(F.col("kind").isin(*kinds)).groupBy("kind", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_trees(nodes: DataFrame, kind: str) -> DataFrame:
    """(chash, n, n_children): the distinct arrays or objects by content, and how often each occurs."""
    return nodes.where(F.col("kind") == kind).groupBy("chash").agg(F.count(F.lit(1)).alias("n"), F.max("n_children").alias("n_children"))
