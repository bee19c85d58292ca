import json
import math
import struct
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jsonloom.api import Aggregate, ArrayCursor, Cursor, documents
from jsonloom.functions.extract import as_kind, kind_of, match_kind
from jsonloom.functions.khash import khash, khash_bucket, khash_of
from jsonloom.functions.numbers import classify, exact, from_parts, int_bytes, int_from_bytes, number_kind, number_text, written_parts
from jsonloom.functions.paths import parse_path, path_steps, render_path
from jsonloom.operators.aggregate import dense_ids, document_text, json_of_nodes, rebuild
from jsonloom.operators.shred import NODES, Number, parse_exact, shred, shred_document, unreadable
from jsonloom.plans.documents import QUERIES
from jsonloom.session import fresh_path
from jsonloom.sources.blob import BlobBuilder, BlobError, BlobReader, decode, encode
from jsonloom.sources.datasource import BlobDataSource, blob_query, encode_blob, pack_blobs, read_blobs, read_json_files
from jsonloom.streaming.shred_stream import appended, appender, latest_facts

SHIP = '{"crew":{"cook":{"called":"Mara","shoe":41,"port":"Riga"}},"decks":["low","mid","top"]}'
KINDS = {
    "none": ("null", "null"), "flag": ("false", "bit"), "tiny": ("-9", "byte"), "small": ("12345", "short"), "medium": ("-1200300400", "int"), "large": ("7000000000001", "long"),
    "huge": ("98765432109876543210987", "bigint"), "single": ("0.25", "float"), "wide": ("6.62607015", "double"), "fine": ("2.71828182845904523536", "bigdec"),
    "word": ('"salt"', "string"), "inner": ('{"depth":[7]}', "object"), "list": ("[1]", "array"),
}
ALL_KINDS = "{" + ",".join(f'"{k}":{v}' for k, (v, _) in KINDS.items()) + "}"


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "body string").select(F.parse_json("body").alias("v")).select(*cols).first()


# paths


@pytest.mark.parametrize(
    "text,steps",
    [("a.b", ["a", "b"]), ("a[0].c", ["a", 0, "c"]), ("a.[0]", ["a", 0]), ("a[-1]", ["a", -1]), ("a[0][1]", ["a", 0, 1]), ('["x.y"].z', ["x.y", "z"]), ("a['b\\'c']", ["a", "b'c"]), ("a.0", ["a", "0"]), ('[""]', [""])],
)
def test_parse_path(text, steps):
    assert parse_path(text) == steps


@pytest.mark.parametrize("text", ["", ".", "a[", "a]", "a[x"])
def test_bad_paths(text):
    with pytest.raises(ValueError):
        parse_path(text)


@given(st.lists(st.one_of(st.integers(-9, 9), st.text(max_size=6)), min_size=1, max_size=5))
def test_paths_round_trip(steps):
    assert parse_path(render_path(steps)) == steps


def test_queries(spark):
    c = Cursor(F.col("v"))
    cols = [c.query(p).as_("string") for p in ("crew.cook.called", "decks[1]", "decks.[-1]", "decks.0", "decks[9]", "crew.cook.called.x", "crew.gone")]
    assert list(one(spark, SHIP, *cols)) == ["Mara", "mid", "top", "low", None, None, None]
    assert one(spark, SHIP, c.read("decks", "[1]").as_("string").alias("x")).x == "mid"
    assert one(spark, '{"a.b":{"":{"q\\"x":7}}}', c.read("a.b", "", 'q"x').as_("byte").alias("x")).x == 7
    assert one(spark, '{"0":"field"}', c.query("0").as_("string").alias("x")).x == "field"
    assert one(spark, SHIP, path_steps(F.lit("a..b[0].c[-1]")).alias("x")).x == ["a", "b", "0", "c", "-1"]


def test_cursor_moves(spark):
    c = Cursor(F.col("v"))
    decks = c.field("decks")
    first, last = decks.down_array(), decks.down_index(-1)
    moves = [first, first.right(), first.right().right(), last.left(), last, first.left(), last.right(), last.right().left(), first.left().right(), decks.index(7), c.field("crew").index(0)]
    assert list(one(spark, SHIP, *[m.as_("string").alias(f"m{i}") for i, m in enumerate(moves)])) == ["low", "mid", "top", "mid", "top"] + [None] * 6
    at = spark.createDataFrame([(SHIP, i) for i in (-1, 0, 2, 3)], "b string, i int").select(F.parse_json("b").alias("v"), "i")
    here = ArrayCursor(decks, F.col("i"))
    assert [tuple(r) for r in at.select(here.as_("string").alias("a"), here.left().as_("string").alias("b"), here.right().as_("string").alias("c")).collect()] == [(None,) * 3, ("low", None, "mid"), ("top", "mid", None), (None,) * 3]
    cook = c.query("crew.cook")
    keys = sorted(("called", "shoe", "port"), key=khash_of)
    row = one(spark, SHIP, F.transform(cook.entries(), lambda e: e["key"]).alias("k"), *[cook.read_key(i).kind().alias(f"k{i}") for i in (0, 1, 2, 3, -1)], cook.as_object().size().alias("o"), decks.as_object().kind().alias("none"))
    kinds = ["byte" if k == "shoe" else "string" for k in keys]
    assert row.k == keys and list(row)[1:6] == [*kinds, None, kinds[-1]] and row.o == 3 and row.none is None
    with pytest.raises(PySparkException):
        one(spark, SHIP, Cursor(F.col("v"), strict=True).field("decks").as_object().kind().alias("x"))


def test_moves_over_elements_taken_out_before(spark):
    df = spark.createDataFrame([([7, None, 9], i) for i in (None, -1, 0, 1, 2, 3)] + [(None, 0), ([], 0)], "a array<int>, i int")
    here = ArrayCursor.over(F.col("a"), F.col("i"))
    moves = (here, here.left(), here.right(), here.right().left(), here.left().left().right())
    none = (None,) * 5
    assert [tuple(r) for r in df.select(*[m.value for m in moves]).collect()] == [none, none, (7, None, None, 7, None), (None, 7, 9, None, None), (9, None, None, None, None), none, none, none]


def test_neighbours_take_lines_out_once(spark, small):
    plan = QUERIES["array_left_right"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as array<variant>") == 1


def test_strict_queries_fail(spark):
    c = Cursor(F.col("v"), strict=True)
    for move in (lambda: c.query("crew.gone").value, lambda: c.field("x").value, lambda: c.query("crew").index(0).value, lambda: c.query("crew.cook.called").as_("int")):
        with pytest.raises(PySparkException):
            one(spark, SHIP, F.to_json(move()) if "variant" in str(type(move())) else F.isnull(move()).alias("x"))


# kinds and extraction


def test_all_kinds_and_matrix(spark):
    c = Cursor(F.col("v"))
    assert one(spark, ALL_KINDS, *[c.field(k).kind().alias(k) for k in KINDS]).asDict() == {k: kind for k, (_, kind) in KINDS.items()}
    whole = ["tiny", "small", "medium", "large", "huge"]
    real = ["tiny", "small", "medium", "large", "single", "wide"]
    accepts = {"byte": whole[:1], "short": whole[:2], "int": whole[:3], "long": whole[:4], "bigint": whole, "float": real[:5], "double": real, "bigdec": [*real, "fine"], "string": ["word"], "bit": ["flag"]}
    for target, keys in accepts.items():
        row = one(spark, ALL_KINDS, *[as_kind(c.field(k).value, target).alias(k) for k in KINDS]).asDict()
        assert {k for k, x in row.items() if x is not None} == set(keys), target
        if target in ("bigint", "bigdec"):
            assert {k: row[k] for k in keys} == {k: KINDS[k][0] for k in keys}
    row = one(spark, ALL_KINDS, c.field("wide").as_("double").alias("a"), c.field("single").as_("double").alias("b"), c.field("flag").as_("bit").alias("d"), c.field("none").is_null().alias("e"), c.field("gone").is_null().alias("f"), c.field("gone").kind().alias("g"))
    assert list(row) == [6.62607015, 0.25, False, True, False, None]


NUMBERS = {  # literal: (kind, exact text)
    "1234567890.12345678901234567890123456789": ("bigdec", "1234567890.12345678901234567890123456789"), "0.1234567890123456789012345": ("bigdec", "0.1234567890123456789012345"),
    "9" * 45: ("bigint", "9" * 45), "1e400": ("bigint", "1" + "0" * 400), "15e-1": ("float", "1.5"), "2.50": ("float", "2.5"), "1e3": ("short", "1000"), "-0.0": ("byte", "0"), "1e-400": ("bigdec", "0." + "0" * 399 + "1"),
    "1E+9999": ("bigint", "1E+9999"), "7.000": ("byte", "7"), "123456789012345678": ("long", "123456789012345678"), "9007199254740993": ("long", "9007199254740993"),
}


def test_numbers_that_variant_rounds(spark):
    """By their text every number is exact, and as shredding has it; without it none comes out with other digits."""
    text = "[" + ",".join(NUMBERS) + "]"
    df = spark.createDataFrame([(text,)], "body string").withColumn("v", F.try_parse_json("body"))
    c = Cursor(F.col("v"), text=F.col("body"))
    row = df.select(*[c.index(i).kind().alias(f"k{i}") for i in range(len(NUMBERS))], *[F.coalesce(c.index(i).as_("bigint"), c.index(i).as_("bigdec")).alias(f"v{i}") for i in range(len(NUMBERS))]).first()
    assert list(zip(row[: len(NUMBERS)], row[len(NUMBERS) :], strict=True)) == list(NUMBERS.values())
    nodes = shred(df, F.lit("d"), F.col("body")).where("depth = 1").orderBy("pos").collect()
    assert [r.kind for r in nodes] == [k for k, _ in NUMBERS.values()]
    plain = Cursor(F.col("v"))
    row = df.select(*[F.coalesce(plain.index(i).as_("bigint"), plain.index(i).as_("bigdec")).alias(f"v{i}") for i in range(len(NUMBERS))]).first()
    assert all(got is None or Decimal(got) == Decimal(t) or float(got) == float(t) for got, t in zip(row, NUMBERS, strict=True))
    assert row[2] is None and row[3] is None


def test_typed_input_with_dates(spark):
    from datetime import date, datetime

    df = spark.createDataFrame([("r", (date(2024, 2, 29), [datetime(2024, 1, 2, 3, 4, 5)], bytearray(b"ab"), None))], "r string, b struct<d:date,t:array<timestamp_ntz>,x:binary,n:date>")
    c = Cursor(F.col("v"))
    row = documents(df, "r", "b").select(c.field("d").as_("string"), c.query("t[0]").as_("string"), c.field("x").as_("string"), c.field("n").kind(), c.field("d").kind()).first()
    nodes = {r.key: r.v_str for r in shred(df, F.col("r"), F.col("b")).where("kind = 'string'").collect()}
    assert list(row) == ["2024-02-29", nodes[None], nodes["x"], "null", "string"] and nodes["d"] == row[0]
    bare = spark.sql("SELECT to_variant_object(named_struct('d', DATE'2024-02-29')) AS v")
    assert list(bare.select(c.field("d").kind(), c.field("d").as_("string")).first()) == ["string", "2024-02-29"]


def test_match_and_sizes(spark):
    c = Cursor(F.col("v"))
    row = one(spark, ALL_KINDS, c.size().alias("a"), c.field("list").size().alias("b"), c.field("medium").size().alias("c"), match_kind(c.field("word").value, {"string": F.lit(1)}).alias("d"), match_kind(c.field("flag").value, {"string": F.lit(1)}, F.lit(0)).alias("e"))
    assert list(row) == [13, 1, None, 1, 0]


@pytest.mark.parametrize(
    "text,kind",
    [("1.0", "byte"), ("1e2", "byte"), ("1.23e200", "bigint"), ("1.2", "float"), ("6.62607015", "double"), ("2.71828182845904523536", "bigdec"), ("-129", "short"), ("128", "short"), ("2147483648", "long"), ("9223372036854775808", "bigint"), ("1e-400", "bigdec"), ("-0.0", "byte"), ("1e999999", "bigint"), ("1e" + "9" * 30, "bigint"), ("1e-" + "9" * 30, "bigdec"), ("0x1", None), ("01", None), ("", None), ("NaN", None), ("9" * 5000, "bigint")],
)
def test_exact_classification(text, kind):
    found = classify(text)
    assert (found[0] if found else None) == kind


def test_other_modes_agree_as_doubles():
    for text in ("6.62607015", "1.5", "0.1", "1e300", "1e400", "-7", "3.4e39"):
        values = {m: classify(text, m) for m in ("exact", "fast", "narrow")}
        assert values["narrow"][0] in ("float", "double", "byte", "bigint")
        if values["exact"][0] != "bigint":
            assert float(values["exact"][1]) == float(values["fast"][1])


def test_number_kind_column(spark):
    rows = ["7", " 7", "30000", "63.5", "2e-187", "x", None, "9" * 60]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(number_kind(F.col("t")).alias("k")).collect()
    assert [r.k for r in got] == ["byte", "byte", "short", "float", "double", None, None, "bigint"]


def test_number_codecs():
    vectors = {100: "64", -100: "9C", -10000000000: "FDABF41C00", 10000000000: "02540BE400", 10000000: "00989680", -10000000: "FF676980", 0: "00", 127: "7F", 128: "0080", -128: "80"}
    for n, h in vectors.items():
        assert int_bytes(n).hex().upper() == h and int_from_bytes(int_bytes(n)) == n
    assert written_parts("123.45") == ("12345", 2, 5, 1) and written_parts("-2.71828") == ("271828", 5, 6, -1) and written_parts("0") == ("0", 0, 1, 0) and written_parts("1.20") == ("120", 2, 3, 1)
    for t in ("1.2300", "-5e-60", "7E+140", "0.000"):
        u, s, _, g = exact(t).parts()
        assert from_parts(u, s, g) == exact(t)
    assert exact("1e400") == exact("10e399") and exact("-0") == exact("0.0e7") and exact("01") is None


@settings(max_examples=300, deadline=None)
@given(st.integers(-(10**60), 10**60), st.integers(-80, 80))
def test_equal_numbers_have_one_text(n, e):
    '''However it is spelled, and no two numbers share one, with any number of digits.'''
    d = exact(f"{n}e{e}")
    assert exact(f"{n}.000e{e}") == d and exact(d.text()) == d
    assert Fraction(d.text()) == n * Fraction(10) ** e
    assert exact(f"{n * 10 + 1}e{e - 1}") != d


def test_denoted_numbers(spark):
    from jsonloom.functions.text import denoted_number

    want = {
        "5.00000000001": None, "1e0001": 10, " +0012 ": 12, "-7.000": -7, "1.5e1": 15, "1.5": None, "120e-1": 12, "125e-1": None, ".5e1": 5, "5.": 5, ".": None, "": None, "e5": None, "1e": None,
        "9223372036854775807": 2**63 - 1, "9223372036854775808": None, "-9223372036854775808": -(2**63), "9223372036854775807.0000000000000000000000": 2**63 - 1, "0e99999999999999": 0, "-0": 0, "1e19": None,
        "0." + "0" * 30 + "1e31": 1, "1" + "0" * 40 + "e-40": 1, "0x1F": None, "1e99999999999999": None, "x": None, "1,5": None, "12 3": None, "000000000000000000000000000000000001": 1,
    }
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", denoted_number(F.col("t")).alias("n")).collect()}
    assert got == want


def test_khash(spark):
    # Fixed values of the published algorithm.
    want = {"name": 4166048239, "age": 3644260079, "city": 3296231919, "é": 821932271}
    assert {k: khash_of(k) for k in want} == want and khash_of("é", signed=True) == 283226351
    df = spark.createDataFrame([(k,) for k in [*want, "", None]], "k string").select("k", khash(F.col("k")).alias("h")).withColumn("b", khash_bucket(F.col("h")))
    got = {r.k: (r.h, r.b) for r in df.collect()}
    assert got["name"] == (4166048239, 124) and got["é"] == (821932271, 24) and got[""][0] == khash_of("") and got[None] == (None, None)


# shredding, packing, reconstruction

JSON = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-(2**70), 2**70), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8)),
    lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.text(max_size=5), x, max_size=4)),
    max_leaves=12,
)


def same(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, bool) or isinstance(b, bool) or a is None or isinstance(a, str):
        return a == b and type(a) is type(b)
    return Decimal(str(a)) == Decimal(str(b)) or math.isclose(float(a), float(b), rel_tol=1e-15)


@settings(max_examples=60, deadline=None)
@given(JSON)
def test_shred_and_blob_round_trips(doc):
    text = json.dumps(doc)
    rows = shred_document("d", parse_exact(text))
    assert len({r[1] for r in rows}) == len(rows)
    assert same(decode(encode({"r": text}))["r"], doc)


def test_content_hash_ignores_key_order_only():
    h = lambda t: shred_document("d", parse_exact(t))[0][13]
    assert h('{"a":1,"b":[1,2]}') == h('{"b":[1.0,2],"a":1e0}') != h('{"a":1,"b":[2,1]}') and h('"1"') != h("1") and h('["a","b"]') != h('["ab"]') and h("[]") != h("{}")


def test_pack_counts_and_reconstruction(spark):
    docs = [("file.json", '[{"some key":"some value"},{"some key":"some value"},{"some value":"some key"}]'), ("k", ALL_KINDS), ("s", '"x\\n\\"é\\u0001"'), ("e", "[]"), ("o", '{"a":{},"b":[[],null,false]}')]
    df = spark.createDataFrame(docs, "root string, body string")
    for dedup, primitives in ((True, True), (False, True), (True, False), (False, False)):
        a = Aggregate.pack(df, F.col("root"), F.col("body"), dedup=dedup, dedup_primitives=primitives)
        back = {r.doc: json.loads(r.body, parse_float=Decimal) for r in a.reconstruct().collect()}
        assert back == {k: json.loads(t, parse_float=Decimal) for k, t in docs}
    first = Aggregate.pack(df.where("root = 'file.json'"), F.col("root"), F.col("body"))
    counts = {r.table_name: r.n for r in first.summary().collect()}
    assert counts["object"] == 2 and counts["array"] == 1 and counts["string"] == 2 and counts["root"] == 1


def test_references_say_short_values(spark):
    """They need no table; longer ones do, also those of rewritten tables and of tables read from a folder."""
    texts = ["", "'", "''x", "a\x1fb", "é\"\\\n\u0001/", "q" * 21, "q" * 22, "'" + "q" * 21, "z" * 300, "12", "[1]", "\U0001f600" * 21, "\U0001f600" * 22, "a.1"]
    values = [*texts, 1, 12, 40000, 2**40, -(2**40), 0.5, 0.1, 1.5e-300, 2.5e-7, 2**80, True, None, {}, [], [[]], {"'": ["''"]}]
    docs = [(str(i), json.dumps(v)) for i, v in enumerate(values)] + [("all", json.dumps(values)), ("twice", json.dumps({"a.1": values, "b": [values, {"\\\"": texts[6]}]}))]
    df = spark.createDataFrame(docs, "root string, body string")
    a = Aggregate.pack(df, F.col("root"), F.col("body"))
    assert all(r.id == str(r.value) for t in ("int", "long", "float", "double") for r in a[t].collect())
    assert {r.value for r in a["string"].collect() if r.id == "'" + r.value} >= {t for t in texts if len(t) < 22 and "\x1f" not in t}
    read = fresh_path(spark, "t")
    a.write(read)
    for b in (a, Aggregate.read(spark, read), Aggregate(a.tables())):
        assert {r.doc: json.loads(r.body) for r in b.reconstruct().collect()} == {k: json.loads(t) for k, t in docs}
    more = {r.doc: json.loads(r.body) for r in a.rewrite("int", lambda c: c + 1).rewrite("string", F.upper).reconstruct().collect()}
    assert more["all"] == [v + 1 if v == 40000 else v.upper() if isinstance(v, str) else {"'": ["''"]} if v == {"'": ["''"]} else v for v in values]


def test_equal_nodes_of_a_batch_are_written_once(spark):
    df = spark.createDataFrame([(str(i), '{"x":{"y":"low","n":[7,7]},"z":"low"}') for i in range(500)], "root string, body string").coalesce(1)
    every, once = (shred(df, F.col("root"), F.col("body"), columns=["depth", "kind", "key", "chash", "entries"], once=o).collect() for o in (False, True))
    assert len(every) == 500 * 7 and len(once) == 500 + 5 and {(r.kind, r.key, r.chash) for r in once} == {(r.kind, r.key, r.chash) for r in every}
    a = Aggregate.pack(df, F.col("root"), F.col("body"))
    back = a.reconstruct().collect()
    assert len(back) == 500 and {json.dumps(json.loads(r.body), sort_keys=True) for r in back} == {json.dumps({"x": {"y": "low", "n": [7, 7]}, "z": "low"}, sort_keys=True)}


def test_references_of_old_tables_are_refused(spark):
    a = Aggregate.pack(spark.createDataFrame([("a", '{"x":[{"y":1}]}')], "root string, body string"), F.col("root"), F.col("body"))
    cut = {t: df.withColumn("value", F.struct("value.kind", F.regexp_replace("value.ref", r"\..*", "").alias("ref"))) if t == "root" else df for t, df in a.tables().items()}
    with pytest.raises(PySparkException, match="pack them again"):
        Aggregate(cut).reconstruct().collect()


def test_root_names_are_distinct(spark):
    """Two documents of one name, also NULL, are an error for whoever reads the roots, in one aggregate or two united."""
    for rows in ([("a", "[1]"), ("a", "[2]")], [("a", "1"), ("a", "1")], [(None, "1"), (None, "2")]):
        df = spark.createDataFrame(rows, "root string, body string")
        packed = Aggregate.pack(df, F.col("root"), F.col("body"))
        for read in (packed["root"], packed.reconstruct()):
            with pytest.raises(PySparkException, match="two roots"):
                read.collect()
        halves = [Aggregate.pack(df.limit(1), F.col("root"), F.col("body")) for _ in range(2)]
        with pytest.raises(PySparkException, match="two roots"):
            halves[0].union(halves[1])["root"].collect()
    one_null = Aggregate.pack(spark.createDataFrame([(None, "[7]"), ("b", None)], "root string, body string"), F.col("root"), F.col("body"))
    assert [tuple(r) for r in one_null.reconstruct().collect()] == [(None, "[7]")]
    none = Aggregate.pack(spark.createDataFrame([], "root string, body string"), F.col("root"), F.col("body"))
    assert none.reconstruct().collect() == [] and none.query("a[0]").collect() == []


def test_numbers_survive_packing(spark):
    """Digit for digit, those beyond 28 digits too; equal ones in other spellings are one value."""
    rng = np.random.default_rng(11)
    digits = ["".join(map(str, rng.integers(0, 10, 60))).lstrip("0") for _ in range(200)]
    literals = [f"{d[:k]}.{d[k:]}" for d in digits for k in (1, 9, 30)] + [f"{d}e{k}" for d in digits[:40] for k in (-300, -31, 0, 31, 300)] + [*NUMBERS, "1e300000", "1.20", "1.2", "12e-1"]
    near = ["1234567890.12345678901234567890123456789", "1234567890.12345678901234567890199999999"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(literals + near)], "root string, body string")
    packed = Aggregate.pack(df, F.col("root"), F.col("body"))
    back = {int(r.doc): r.body for r in packed.reconstruct().collect()}
    assert [exact(back[i]) for i in range(len(back))] == [exact(t) for t in literals + near] and exact(near[0]) != exact(near[1])
    assert packed["float"].where("value = 1.2").count() == 1


def test_paths_over_tables(spark):
    df = spark.createDataFrame([("s", SHIP), ("k", ALL_KINDS), ("t", '{"decks":{"1":"x"}}'), ("u", "[5]")], "root string, body string")
    a = Aggregate.pack(df, F.col("root"), F.col("body"))
    ask = lambda *x, **y: sorted(tuple(r) for r in a.query(*x, **y).collect())
    assert ask("decks.1") == [("s", "string", '"mid"'), ("t", "string", '"x"')] and ask("decks[1]") == [("s", "string", '"mid"')]
    assert ask("crew.cook.shoe") == [("s", "byte", "41")] and ask("huge") == [("k", "bigint", KINDS["huge"][0])] and ask("none") == [("k", "null", "null")] and ask("[-1]") == [("u", "byte", "5")]
    assert ask("decks") == [("s", "array", None), ("t", "object", None)] and ask("decks", ["s"], whole=True) == [("s", "array", '["low","mid","top"]')] and ask("gone.x") == []
    known = a.lookup("string", "mid").collect()
    assert len(known) == 1 and a.lookup("string", "no").count() == 0
    with pytest.raises(ValueError):
        a.lookup("array", "x")


def test_deep_documents(spark):
    """Deeper than the parser's stack; beyond the bound they are listed, not lost silently."""
    from jsonloom.functions.json_text import LEVELS

    deep = '{"a":' * 1500 + "1" + "}" * 1500
    df = spark.createDataFrame([("d", deep), ("x", "[" * (LEVELS + 1) + "]" * (LEVELS + 1)), ("n", None), ("e", " "), ("c", "[1"), ("ok", "[1e99999999, 2]")], "root string, body string")
    nodes = shred(df, F.col("root"), F.col("body"))
    assert {r.doc: r["max(depth)"] for r in nodes.groupBy("doc").agg(F.max("depth")).collect()} == {"d": 1500, "ok": 1}
    assert {r.doc: r.reason for r in unreadable(df, F.col("root"), F.col("body")).collect()} == {"x": "too deep", "n": "null", "e": "empty", "c": "no JSON"}
    assert len(shred_document("d", parse_exact("[" * 6000 + "]" * 6000))) == 6000


def test_write_read_union_and_root(spark):
    df = spark.createDataFrame([("a", '{"x":[1,2]}'), ("b", '{"y":[1,2]}')], "root string, body string")
    path = fresh_path(spark, "t")
    Aggregate.pack(df.where("root = 'a'"), F.col("root"), F.col("body")).write(path)
    both = Aggregate.read(spark, path).union(Aggregate.pack(df.where("root = 'b'"), F.col("root"), F.col("body")))
    assert both["array"].count() == 1 and {r.doc: r.body for r in both.reconstruct().collect()} == {"a": '{"x":[1,2]}', "b": '{"y":[1,2]}'}
    assert both.root("a").count() == 1 and both.root("gone").count() == 0


def test_shred_edges(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "{"), ("d", "1e"), (None, "[1]"), ("a", '{"k":1,"k":2}')], "root string, body string")
    nodes = shred(df, F.col("root"), F.col("body"))
    assert nodes.schema.simpleString() == spark.createDataFrame([], NODES).schema.simpleString()
    assert sorted((r.doc or "", r.kind, r.v_long or 0) for r in nodes.collect()) == [("", "array", 0), ("", "byte", 1), ("a", "byte", 2), ("a", "object", 0)]
    with pytest.raises(PySparkException):
        shred(df, F.col("root"), F.col("body"), strict=True).count()
    with pytest.raises(ValueError):
        shred(df, F.col("root"), F.col("body"), numeric_mode="other")


def test_paths_of_nodes_and_rebuild(spark):
    df = spark.createDataFrame([("a", '{"x":{"y.z":[1,{"w":null}]}}')], "root string, body string")
    nodes = shred(df, F.col("root"), F.col("body"), paths=True)
    assert {r.path for r in nodes.collect()} == {"", "x", "x.y.z", "x.y.z[0]", "x.y.z[1]", "x.y.z[1].w"}
    assert [r.body for r in rebuild(json_of_nodes(nodes)).collect()] == ['{"x":{"y.z":[1,{"w":null}]}}']


def test_dense_ids(spark):
    df = spark.range(1000).select(F.concat(F.lit("v"), "id").alias("v"))
    assert sorted(r.id for r in dense_ids(df, "v").collect()) == list(range(1000)) and dense_ids(df.limit(0), "v").count() == 0


def test_inputs_and_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x":\n1}')
    (tmp_path / "b.json").write_text("{")
    got = {r.root: (r.body is not None, r.ok) for r in read_json_files(spark, str(tmp_path)).select("root", "body", F.col("v").isNotNull().alias("ok")).collect()}
    assert got == {"a.json": (True, True), "b.json": (True, False)}
    df = spark.createDataFrame([("r", '{"x":1}', bytearray(b'{"x":1}'))], "r string, s string, b binary").select("*", F.struct(F.lit(1).alias("x")).alias("st"), F.parse_json("s").alias("va"))
    for c in ("s", "b", "st", "va"):
        assert documents(df, "r", c).select(Cursor(F.col("v")).field("x").as_("byte").alias("x")).first().x == 1


# the binary container


def test_blob_index_and_queries():
    doc = {f"key {i}": i for i in range(300)} | {"é": [1, [2, {"deep": "x"}]]}
    for buckets in (1, 128, 1024):
        r = BlobReader(encode({"root": doc}, buckets=buckets))
        assert all(r.query("root", [k]) == v for k, v in doc.items()) and r.query("root", ["é", -1, "1", "deep"]) == "x"
        for bad in (["gone"], ["é", 5], ["key 1", "x"]):
            with pytest.raises(KeyError):
                r.query("root", bad)


def test_blob_sharing_and_header():
    data = encode({"a": '[{"k":"v"},{"k":"v"}]', "b": b'{"k":"v"}'})
    r = BlobReader(data)
    assert (r.count("object"), r.count("string"), r.count("root")) == (1, 4, 2) and decode(data) == {"a": [{"k": "v"}] * 2, "b": {"k": "v"}}
    assert struct.unpack_from(">ii", data) == (0, 10)
    for bad in (b"", data[:40], struct.pack(">i", 1) + data[4:], data[:8] + struct.pack(">i", 9) + data[12:]):
        with pytest.raises(BlobError):
            BlobReader(bad)
    b = BlobBuilder(dedup=False, dedup_primitives=False)
    b.append("a", ["x", "x"])
    assert BlobReader(b.build()).count("string") == 3
    with pytest.raises(ValueError):
        b.append("a", 1)
    with pytest.raises(ValueError):
        BlobBuilder(buckets=100)


def test_blob_numbers():
    doc = [Number(t) for t in ("1.20", "1e2", "-0.1", "2.71828182845904523536", "9" * 50, "-" + "9" * 50, "1.23e-300", "3.4028235e38")]
    back = decode(encode({"n": doc}))["n"]
    assert all(Decimal(str(x)) == Decimal(str(y)) for x, y in zip(back, doc, strict=True)) and np.isclose(back[2], -0.1)
    long = Number("7" * 6000)
    assert decode(encode({"n": [long, Number("0." + "3" * 6000)]}))["n"][0] == int(Decimal(long))
    with pytest.raises(ValueError):
        encode({"n": Number("1e99999999")})


def test_blob_source(spark, tmp_path):
    spark.dataSource.register(BlobDataSource)
    df = spark.createDataFrame([(f"r{i}", json.dumps({"i": i, "s": ["x"] * i})) for i in range(20)], "root string, body string")
    for _ in range(2):
        df.repartition(3).write.format("jsonloom_blob").mode("overwrite").save(str(tmp_path))
    assert {r.root: json.loads(r.body) for r in spark.read.format("jsonloom_blob").load(str(tmp_path)).collect()} == {f"r{i}": {"i": i, "s": ["x"] * i} for i in range(20)}


def test_blob_source_options(spark, tmp_path):
    spark.dataSource.register(BlobDataSource)
    df = spark.createDataFrame([(f"r{i}", json.dumps({"i": i, "s": ["x", i]})) for i in range(9)] + [("bad", "{"), (None, "1"), ("nil", None)], "root string, body string")
    out = df.coalesce(1).write.format("jsonloom_blob").mode("append")
    with pytest.raises(PySparkException):
        out.save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".blob")] == []
    out.option("bad", "skip").option("max_bytes", 60).save("file://" + str(tmp_path))
    assert len(list(tmp_path.glob("*.blob"))) > 2
    read = spark.read.format("jsonloom_blob")
    assert {r.root: r.body for r in read.option("query", "s[-1]").option("roots", "r2,r7,gone").load(str(tmp_path)).collect()} == {"r2": "2", "r7": "7"}
    for path in ("hdfs://x/y", "s3a://x/y"):
        with pytest.raises(PySparkException):
            read.load(path).collect()
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.blob")
    assert read_blobs(files, F.col("content"), query="i").count() == 9


def test_blob_columns(spark):
    df = spark.createDataFrame([("s", SHIP), ("k", ALL_KINDS), ("n", None)], "root string, body string")
    blobs = df.select("root", encode_blob(F.col("root"), F.col("body")).alias("blob"))
    got = {r.root: (r.a, r.b, r.c) for r in blobs.select("root", blob_query(F.col("blob"), F.col("root"), "decks[-1]").alias("a"), blob_query(F.col("blob"), F.col("root"), "tiny", "long")["body"].alias("b"), blob_query(F.col("blob"), F.lit("gone"), "x").alias("c")).collect()}
    assert got == {"s": (("string", '"top"'), None, None), "k": (None, "-9", None), "n": (None, None, None)}
    packed = pack_blobs(df.where("root <> 'n'"), F.col("root"), F.col("body"))
    assert sorted(x for r in packed.collect() for x in r.roots) == ["k", "s"]
    assert sorted(tuple(r) for r in read_blobs(packed, F.col("blob"), query="crew.cook.shoe").collect()) == [("k", None), ("s", "41")]


# streams


def test_streamed_aggregate_is_idempotent(spark):
    path = fresh_path(spark, "agg")
    add = appender(path)
    one_, two = ([(n, '{"k":["v",1.5]}')] for n in ("a", "b"))
    for number, batch in enumerate((one_, two, [("a", "[2]")])):
        for _ in range(2):
            add(spark.createDataFrame(batch, "root string, body string"), number)
    a = appended(spark, path)
    assert {r.table_name: r.n for r in a.summary().where("n > 0").collect()} == {"float": 1, "string": 2, "array": 2, "object": 1, "root": 2}
    assert {r.doc: r.body for r in a.reconstruct().collect()} == {"a": '{"k":["v",1.5]}', "b": '{"k":["v",1.5]}'}
    Aggregate.pack(spark.createDataFrame([("z", '["new"]')], "root string, body string"), F.col("root"), F.col("body"))["string"].write.parquet(f"{path}/string/batch=9")
    assert appended(spark, path)["string"].count() == 2  # a batch without roots isn't there


def test_latest_facts_in_any_order(spark):
    rows = [("a", 1, "x", False), ("a", 3, None, True), ("a", 2, "y", False), ("b", 5, "z", None), ("b", 4, "w", True)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, s int, v string, gone boolean")
        assert [(r.k, r.v) for r in latest_facts(df, ["k"], F.col("s"), F.col("gone")).collect()] == [("b", "z")]


def test_document_text_orders_children_by_place():
    rows = [("1", None, "array", None)] + [(f"1.{i}", None, "byte", str(i)) for i in range(1, 13)]
    assert document_text(rows) == "[" + ",".join(map(str, range(1, 13))) + "]"
    assert kind_of is not None


def test_sql_functions(spark):
    from jsonloom.functions.sql import register

    register(spark)
    row = spark.sql("SELECT khash('name') AS a, khash('') AS b, khash(CAST(NULL AS STRING)) AS c, number_kind(' 1.5 ') AS d, number_kind('x') AS e").first()
    assert list(row) == [4166048239, khash_of(""), None, "float", None]
    assert spark.sql("SELECT kind FROM VALUES ('[1]'), ('{'), (NULL) AS t(b) LATERAL VIEW inline(shred_json(b)) n ORDER BY kind").collect() == [("array",), ("byte",)]


def test_native_shredding_matches_exact(spark):
    from jsonloom.operators.shred import shred_native

    df = spark.createDataFrame([("a", ALL_KINDS), ("b", "[[],{},[null,[1]]]"), ("c", "7"), ("d", None)], "root string, body string")
    native = shred_native(df.select(F.col("root").alias("doc"), F.try_parse_json("body").alias("v")))
    exact = shred(df, F.col("root"), F.col("body"))
    assert sorted((r.doc, r.depth, r.key or "", r.kind) for r in native.collect()) == sorted((r.doc, r.depth, r.key or "", r.kind) for r in exact.collect())


def test_rewrite(spark):
    df = spark.createDataFrame([("a", '{"k":"v","n":[1.5,"v"]}')], "root string, body string")
    a = Aggregate.pack(df, F.col("root"), F.col("body")).rewrite("string", F.upper).rewrite("float", lambda c: c + 1)
    assert [json.loads(r.body) for r in a.reconstruct().collect()] == [{"k": "V", "n": [2.5, "V"]}]
    with pytest.raises(ValueError):
        a.rewrite("object", F.upper)


def test_number_sheet_matches_brute_force(spark, small):
    from fractions import Fraction

    from jsonloom.session import table

    for r in table(spark, small, "number_sheet").select("literal", number_kind(F.col("literal")).alias("k")).collect():
        t = (r.literal or "").strip()
        try:
            exact = Fraction(t) if t and t[-1].isdigit() and not t.startswith("+") and "/" not in t and "_" not in t else None
        except ValueError:
            exact = None
        if exact is None or (t.lstrip("-")[:1] == "0" and t.lstrip("-")[1:2].isdigit()) or t.lstrip("-").startswith("."):
            want = None
        elif exact.denominator == 1:
            want = next((k for k, b in (("byte", 7), ("short", 15), ("int", 31), ("long", 63)) if -(2**b) <= exact < 2**b), "bigint")
        else:
            single = np.float32(t)
            want = "float" if np.isfinite(single) and Fraction(str(single)) == exact else "double" if Fraction(repr(float(t))) == exact else "bigdec"
        assert r.k == want, t


def test_spec_paths_have_every_depth(spark, small):
    """Paths of every depth, against a walk of the parsed specifications."""
    from jsonloom.plans.documents import QUERIES

    kinds = {dict: "object", list: "array", str: "string", bool: "bit", type(None): "null"}
    want = {}

    def walk(doc, steps, v):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            at = [*steps, k]
            want.setdefault((render_path(at), kinds.get(type(x), "number")), set()).add(doc)
            walk(doc, at, x)

    for r in spark.read.parquet(f"{small}/api_spec.parquet").collect():
        try:
            walk(r.spec_id, [], json.loads(r.body or ""))
        except ValueError:
            pass
    rows = QUERIES["spec_paths"](spark, small).collect()
    named = set(kinds.values())
    got = {(r.path, r.kind if r.kind in named else "number"): r.documents for r in rows}
    assert len(got) == len(rows) and got == {k: len(v) for k, v in want.items()}
    assert max(len(parse_path(p)) for p, _ in got) > 3
