import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jsonloom.operators.dewey import NodeTable, dewey_rows, dewey_tables, label_nodes, read_json, UNREADABLE, with_parent, _steps

T = (
    NodeTable("theater", ("results",), ("id",)),
    NodeTable("group", ("results", "group"), ("code",), "theater"),
    NodeTable("show", ("results", "showtimes"), ("id", "start"), "theater", deep=True, requires=("start",)),
)


def rows(spark, bodies, tables=T):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "k bigint, body string")
    return dewey_rows(df, F.col("k"), F.col("body"), tables)


def test_labels_and_parents(spark):
    body = json.dumps({"n": 1, "results": [{"id": 7, "group": [{"code": "x"}, "y"], "showtimes": {"d": [{"id": 1, "start": "s", "more": {"start": 1}}, None]}}, None]})
    got = {(r.node_table, r.label, r.parent_label, r.value) for r in rows(spark, [body]).collect()}
    assert got == {
        ("theater", "1.2.1", None, None), ("group", "1.2.1.2.1", "1.2.1", None), ("group", "1.2.1.2.2", "1.2.1", "y"),
        ("show", "1.2.1.3.1.1", "1.2.1", None), ("show", "1.2.1.3.1.1.3", "1.2.1", None),
    }


def test_unreadable_bodies_give_nothing(spark):
    bad = [None, "", "  ", '{"results": [{"id": 1}', "results", "NaN", '{"results": NaN}', "[" * 100_000 + "results"]
    assert rows(spark, bad).collect() == []


def test_json_in_strings_counts(spark):
    inner = json.dumps({"results": json.dumps([{"id": "5"}])})
    assert [(r.node_table, dict(r.members)) for r in rows(spark, [json.dumps(json.dumps(inner))]).collect()] == [("theater", {"id": "5"})]


def test_escaped_keys_and_repeated_documents(spark):
    body = '{"r\\u0065sults": {"id": 1.50}}'
    assert [dict(r.members) for r in rows(spark, [body, body]).collect()] == [{"id": "1.50"}] * 2


def test_tables_join_by_truncated_labels(spark):
    df = spark.createDataFrame([(1, '{"results":[{"id":1,"group":"g"},{"id":2,"group":{"code":"h"}}]}', 0)], "k bigint, body string, label int")
    flat = dewey_tables(df, F.col("k"), F.col("body"), T)
    linked = with_parent(flat["group"], flat["theater"], {"id": "theater"})
    assert sorted((r.theater, r.code or r.value) for r in linked.collect()) == [("1", "g"), ("2", "h")]
    assert flat["show"].collect() == []


def test_empty_table_and_bad_specs(spark):
    assert rows(spark, []).collect() == []
    with pytest.raises(ValueError):
        _steps((T[0], NodeTable("again", ("results",), ())))


def test_very_deep_document_is_walked_without_recursion():
    doc = {"start": 1, "id": 1}
    for _ in range(50_000):
        doc = {"x": doc}
    root = _steps((NodeTable("t", (), (), deep=True, requires=("start",)),))
    assert len(label_nodes(doc, root)) == 1


def _values(v):
    while isinstance(v, str):
        v = read_json(v)
        if v is UNREADABLE:
            return None
    return v


def brute_p3(d):
    con = duckdb.connect()
    out = set()
    for i, payload in con.execute(f"select id, payload from '{d}/event_log.parquet'").fetchall():
        try:
            n = int(float((i or "").strip()))
            v = json.loads(payload)
            v = json.loads(v) if isinstance(v, str) else v
        except (ValueError, TypeError):
            continue
        c = v.get("commits") if isinstance(v, dict) else None
        for x in c if isinstance(c, list) else [c]:
            if isinstance(x, dict) and x.get("sha") is not None:
                out.add(("commit", str(n), x["sha"].lower()))
    for page, body in con.execute(f"select page_id, body from '{d}/theater_page.parquet'").fetchall():
        try:
            v = json.loads(body)
        except (ValueError, TypeError):
            continue
        for t in v["results"]:
            parent = f"{page}/{t['id']}"
            g = t.get("group")
            for x in g if isinstance(g, list) else [g]:
                code = x.get("code") if isinstance(x, dict) else x
                code = " ".join(code.lower().split()) if code else None
                if code:
                    out.add(("theater_group", parent, code))

            def walk(o):
                if isinstance(o, dict):
                    if "start" in o and o.get("id") is not None:
                        out.add(("showtime", parent, str(o["id"])))
                    for x in o.values():
                        walk(x)
                elif isinstance(o, list):
                    for x in o:
                        walk(x)

            walk(t.get("showtimes"))
    return out


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_p3_found_matches_brute_force(spark, d):
    got = [tuple(r) for r in entry.queries()["p3_found"](spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_p3(d)


def test_repeated_keys_and_deep_bodies(spark):
    """Documents of one key keep their own parents; a body deeper than the parser's stack is read; so is one with a number of thousands of digits."""
    from pyspark.sql import functions as F

    from jsonloom.operators.dewey import NodeTable, dewey_tables, with_parent

    tables = [NodeTable("outer", ("rows",), ("name",)), NodeTable("inner", ("rows", "in"), ("v",), "outer")]
    bodies = ['{"rows":[{"name":"a","in":{"v":1}}]}', '{"rows":[{"name":"b","in":{"v":2}}]}', '{"x":' + "[" * 6000 + "]" * 6000 + ',"rows":[{"name":"c","in":{"v":3}}]}', '{"rows":[{"name":"d","in":{"v":' + "4" * 5000 + "}}]}"]
    flat = dewey_tables(spark.createDataFrame([(7, b) for b in bodies], "k bigint, b string"), F.col("k"), F.col("b"), tables)
    got = sorted((r.name, r.v) for r in with_parent(flat["inner"], flat["outer"], {"name": "name"}).collect())
    assert got == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4" * 5000)]
