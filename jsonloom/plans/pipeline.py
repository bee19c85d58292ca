"""The pN_ queries of the general training-data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.functions.text import denoted_number, normal_form
from jsonloom.operators.dewey import NodeTable, dewey_rows, dewey_tables, with_parent
from jsonloom.operators.events import deliveries, distinct_events
from jsonloom.operators.keyed_totals import heavy_keys, keyed_distinct, keyed_totals, stacked_keys
from jsonloom.operators.redelivery import keep_one_delivery, merge_batch, with_repeats
from jsonloom.operators.term_frequency import term_frequencies
from jsonloom.session import stage, table
from jsonloom.streaming.session_timers import sessions

COMMIT = NodeTable("commit", ("commits",), ("sha", "message"))
COMMIT_FULL = (COMMIT, NodeTable("author", ("commits", "author"), ("name", "email"), "commit"))
THEATER = NodeTable("theater", ("results",), ("id", "location"))
THEATERS = (
    THEATER,
    NodeTable("theater_group", ("results", "group"), ("code",), "theater"),
    NodeTable("showtime", ("results", "showtimes"), ("id", "start"), "theater", deep=True, requires=("start", "id")),
)


# 1 - messages delivered more than once


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    """One row per event: the delivery kept, and how many there were."""
    log = deliveries(table(spark, d, "event_log"))
    order = [F.col("instant_s").isNull(), F.col("payload").isNull(), F.col("received_at").isNull(), F.col("received_at"), F.col("delivery_no")]
    return keep_one_delivery(log, F.col("event_id"), order)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_events(spark, d).where(F.col("deliveries") > 1).select(F.col("message_key").alias("event_id"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    return p1_events(spark, d).select("message_key", "deliveries", "delivery_no", "instant_s", "type")


def p1_next_batch(spark: SparkSession, d: str) -> DataFrame:
    """All batches but the last as stored messages, then the last one merged in."""
    log = deliveries(table(spark, d, "event_log")).select("event_id", "delivery_no", "batch_id", "received_at")
    last = log.agg(F.max("batch_id")).first()[0] or 0
    order = [F.col("received_at").isNull(), F.col("received_at"), F.col("delivery_no")]
    old = keep_one_delivery(log.where(F.col("batch_id") < last), F.col("event_id"), order)
    new = log.where((F.col("batch_id") >= last) | F.col("batch_id").isNull())
    stored = stage(old, "stored")
    fresh, repeats = merge_batch(new, stored, F.col("event_id"), order)
    return with_repeats(stored, fresh, repeats).select("message_key", "deliveries", "delivery_no", "batch_id")


# 2 - sessions


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = sessions(distinct_events(table(spark, d, "event_log")), F.col("actor_id"), F.col("instant_s"))
    return found.select(F.col("key_").cast("bigint").alias("actor_id"), "start_s", "end_s")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every session with its duration, number of events, and number for each type (``PushEvent=3,WatchEvent=1``)."""
    events = distinct_events(table(spark, d, "event_log"))
    found = sessions(events, F.col("actor_id"), F.col("instant_s"), kind=F.col("type"))
    types = F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select(
        F.col("key_").cast("bigint").alias("actor_id"), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"),
        "events", F.array_join(types, ",").alias("types"),
    )


# 3 - nested records


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "event_log").select(denoted_number(F.col("id")).alias("event_id"), "payload").where("event_id is not null")
    commits = dewey_rows(log, F.col("event_id"), F.col("payload"), [COMMIT])
    sha = F.lower(F.element_at("members", "sha"))
    commit = commits.select(F.lit("commit").alias("child_table"), F.col("doc_key").cast("string").alias("parent_id"), sha.alias("child_key"))
    flat = dewey_tables(table(spark, d, "theater_page"), F.col("page_id"), F.col("body"), THEATERS)
    theater = flat["theater"]

    def children(name: str, key: F.Column) -> DataFrame:
        linked = with_parent(flat[name], theater, {"id": "theater_id"})
        parent = F.concat_ws("/", F.col("doc_key").cast("string"), F.col("theater_id"))
        return linked.where("theater_id is not null").select(F.lit(name).alias("child_table"), parent.alias("parent_id"), key.alias("child_key"))

    groups = children("theater_group", normal_form(F.coalesce("code", "value")))
    shows = children("showtime", F.col("id"))
    rows = commit.unionByName(groups).unionByName(shows).where("child_key is not null and parent_id is not null")
    return rows.groupBy("child_table", "parent_id", "child_key").agg(F.lit(1).alias("one_")).drop("one_")


def p3_commits(spark: SparkSession, d: str) -> DataFrame:
    """The commit table with message and author, linked to the delivery."""
    log = table(spark, d, "event_log")
    flat = dewey_tables(log, F.col("delivery_no"), F.col("payload"), COMMIT_FULL)
    author = flat["author"].select("doc_row", F.col("parent_label").alias("label"), "name", "email")
    return flat["commit"].join(author, ["doc_row", "label"], "left").select(
        F.col("doc_key").alias("delivery_no"), F.col("label").alias("commit_label"), "sha", "message", "name", "email"
    )


def p3_showtimes(spark: SparkSession, d: str) -> DataFrame:
    flat = dewey_tables(table(spark, d, "theater_page"), F.col("page_id"), F.col("body"), THEATERS)
    linked = with_parent(flat["showtime"], flat["theater"], {"id": "theater_id"})
    return linked.select(F.col("doc_key").alias("page_id"), "parent_label", "label", "theater_id", F.col("id").alias("showtime_id"), "start")


# 4 - frequencies


def _term_occurrences(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "event_log").select(
        denoted_number(F.col("id")).alias("event_id"), "delivery_no", F.col("repo.name").alias("repo"), F.col("actor.login").alias("login")
    )
    record = F.coalesce(F.concat(F.lit("e"), F.col("event_id").cast("string")), F.concat(F.lit("d"), F.col("delivery_no").cast("string")))
    fields = {"event.repo.name": normal_form(F.col("repo")), "event.actor.login": normal_form(F.col("login"))}
    events = stacked_keys(log.withColumn("record", record), fields, ["record"]).withColumnRenamed("key_value", "term")
    pages = dewey_rows(table(spark, d, "theater_page"), F.col("page_id"), F.col("body"), [THEATER])
    theaters = pages.select(
        F.lit("movies.location").alias("field"), F.element_at("members", "id").alias("record"), normal_form(F.element_at("members", "location")).alias("term")
    )
    return events.select("field", "record", "term").unionByName(theaters)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(_term_occurrences(spark, d)).where("mark is not null").select("field", "term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(_term_occurrences(spark, d)).drop("field_records")


# 5 - heavy keys


def _keys() -> dict[str, F.Column]:
    return {"event.repo.name": normal_form(F.col("repo.name")), "event.actor.id": F.col("actor.id")}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "event_log"), _keys(), 0.015).select("field", "key_value")


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Results of every repository and every actor, whole table."""
    log = deliveries(table(spark, d, "event_log"))
    log = log.withColumn("push", (F.col("type") == "PushEvent").cast("int")).withColumn("size", F.length("payload").cast("bigint"))
    rows = stacked_keys(log, _keys(), ["push", "size", "instant_s"])
    aggs = [
        F.count(F.lit(1)).alias("deliveries"), F.sum("push").alias("pushes"), F.sum("size").alias("payload_chars"),
        F.min("instant_s").alias("first_s"), F.max("instant_s").alias("last_s"),
    ]
    return keyed_totals(rows, ["field", "key_value"], aggs)


def p5_actors(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of different actors of each repository."""
    log = table(spark, d, "event_log").select(normal_form(F.col("repo.name")).alias("repo"), F.col("actor.id").alias("actor"))
    return keyed_distinct(log, "repo", "actor", "actors")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_kept, p1_next_batch, p2_found, p2_sessions, p3_found, p3_commits, p3_showtimes, p4_found, p4_terms, p5_found, p5_totals, p5_actors,
    )
}

# The same results in SQL.

_WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


def _sql_normal(c: str) -> str:
    return f"nullif(trim(regexp_replace(lower({c}), '{_WHITE}+', ' ', 'g')), '')"


_SQL_TRIMMED = f"regexp_replace(id, '^{_WHITE}+|{_WHITE}+$', '', 'g')"
#: By arithmetic on the mantissa as a whole number and the power of ten it stands for.
_SQL_MANTISSA = f"try_cast(replace(regexp_replace({_SQL_TRIMMED}, '[eE].*$', ''), '.', '') AS HUGEINT)"
_SQL_POWER = f"""(coalesce(try_cast(nullif(regexp_extract({_SQL_TRIMMED}, '[eE]([+-]?[0-9]+)$', 1), '') AS INT), 0)
 - coalesce(length(regexp_extract({_SQL_TRIMMED}, '[.]([0-9]*)', 1)), 0))"""
_SQL_NUMBER = rf"""CASE WHEN NOT regexp_full_match({_SQL_TRIMMED}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN NULL
 WHEN {_SQL_MANTISSA} = 0 THEN 0
 WHEN {_SQL_POWER} BETWEEN 0 AND 18 THEN try_cast({_SQL_MANTISSA} * CAST(pow(10, {_SQL_POWER}) AS HUGEINT) AS BIGINT)
 WHEN {_SQL_POWER} BETWEEN -18 AND -1 AND {_SQL_MANTISSA} % CAST(pow(10, -{_SQL_POWER}) AS HUGEINT) = 0 THEN try_cast({_SQL_MANTISSA} // CAST(pow(10, -{_SQL_POWER}) AS HUGEINT) AS BIGINT) END"""
_SQL_INSTANT = r"""CASE
 WHEN regexp_matches(created_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$')
  THEN CAST(floor(epoch(try_cast(regexp_replace(created_at, '(Z|[+-][0-9]{2}:?[0-9]{2})$', '') AS TIMESTAMP))) AS BIGINT)
  - (CASE WHEN regexp_matches(created_at, '-[0-9]{2}:?[0-9]{2}$') AND length(created_at) > 16 THEN -1 ELSE 1 END)
  * CASE WHEN regexp_matches(created_at, ':[0-9]{2}(\.[0-9]+)?[+-][0-9]{2}:?[0-9]{2}$')
    THEN CAST(regexp_extract(created_at, '[+-]([0-9]{2}):?[0-9]{2}$', 1) AS BIGINT) * 3600 + CAST(regexp_extract(created_at, '([0-9]{2})$', 1) AS BIGINT) * 60 ELSE 0 END
 WHEN regexp_matches(created_at, '^[0-9]{9,10}$') THEN try_cast(created_at AS BIGINT)
 WHEN regexp_matches(created_at, '^[0-9]{12,13}$') THEN try_cast(created_at AS BIGINT) // 1000
 WHEN regexp_matches(created_at, '^[0-9]{8}T[0-9]{6}Z$') THEN CAST(epoch(try_strptime(created_at, '%Y%m%dT%H%M%SZ')) AS BIGINT)
 WHEN regexp_matches(created_at, '^[A-Z][a-z][a-z], ') THEN
  CAST(epoch(try_strptime(substr(created_at, 6, 20), '%d %b %Y %H:%M:%S')) AS BIGINT)
  - (CASE WHEN substr(created_at, 27, 1) = '-' THEN -1 ELSE 1 END)
  * (CAST(substr(created_at, 28, 2) AS BIGINT) * 3600 + CAST(substr(created_at, 30, 2) AS BIGINT) * 60) END"""
_SQL_LOG = f"log AS (SELECT *, {_SQL_NUMBER} AS event_id, {_SQL_INSTANT} AS instant_s FROM event_log)"
_SQL_EVENTS = """ev AS (SELECT event_id, max(actor.id) AS actor_id, max(instant_s) AS instant_s, max(type) AS type FROM log WHERE event_id IS NOT NULL GROUP BY event_id
 UNION ALL SELECT event_id, actor.id, instant_s, type FROM log WHERE event_id IS NULL)"""
_SQL_SESSIONS = f"""WITH {_SQL_LOG}, {_SQL_EVENTS},
g AS (SELECT *, instant_s - lag(instant_s) OVER (PARTITION BY actor_id ORDER BY instant_s) AS gap FROM ev WHERE actor_id IS NOT NULL AND instant_s IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN gap <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY actor_id ORDER BY instant_s ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT actor_id, min(instant_s) AS start_s, max(instant_s) AS end_s"""
_SQL_TERMS = f"""WITH {_SQL_LOG},
occ AS (SELECT 'event.repo.name' AS field, coalesce('e' || event_id, 'd' || delivery_no) AS record, {_sql_normal("repo.name")} AS term FROM log
 UNION ALL SELECT 'event.actor.login', coalesce('e' || event_id, 'd' || delivery_no), {_sql_normal("actor.login")} FROM log
 UNION ALL SELECT 'movies.location', t->>'id', {_sql_normal("CASE WHEN json_type(t->'location') NOT IN ('OBJECT', 'ARRAY') THEN t->>'location' END")}
  FROM (SELECT unnest(json_extract(body, '$.results[*]')) AS t FROM theater_page WHERE json_valid(body))),
ok AS (SELECT * FROM occ WHERE record IS NOT NULL AND term IS NOT NULL),
n AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM ok GROUP BY field, term),
h AS (SELECT field, count(DISTINCT record) AS field_records FROM ok GROUP BY field),
m AS (SELECT n.*, CASE WHEN records <= 2 THEN 'rare' WHEN records >= 10 AND records > field_records * 0.02 THEN 'common' END AS mark FROM n JOIN h USING (field))"""
_SQL_KEYS = f"""WITH {_SQL_LOG}, k AS (SELECT 'event.repo.name' AS field, {_sql_normal("repo.name")} AS key_value, * FROM log
 UNION ALL SELECT 'event.actor.id', CAST(actor.id AS VARCHAR), * FROM log), ok AS (SELECT * FROM k WHERE key_value IS NOT NULL)"""
_SQL_NESTED = f"""WITH {_SQL_LOG},
p AS (SELECT event_id, CASE WHEN json_type(payload) = 'VARCHAR' THEN payload->>'$' ELSE payload END AS b FROM log WHERE json_valid(payload) AND event_id IS NOT NULL),
c AS (SELECT event_id, json_extract(b, '$.commits') AS c FROM p WHERE json_valid(b)),
e AS (SELECT event_id, unnest(CASE json_type(c) WHEN 'ARRAY' THEN json_extract(c, '$[*]') ELSE [c] END) AS e FROM c),
t AS (SELECT page_id || '/' || (t->>'id') AS parent_id, t->'group' AS g, t->'showtimes' AS s FROM (SELECT page_id, unnest(json_extract(body, '$.results[*]')) AS t FROM theater_page WHERE json_valid(body))),
g AS (SELECT parent_id, unnest(CASE json_type(g) WHEN 'ARRAY' THEN json_extract(g, '$[*]') ELSE [g] END) AS g FROM t),
s AS (SELECT parent_id, j.value->>'id' AS id FROM t, json_tree(t.s) j WHERE j.type = 'OBJECT' AND list_contains(json_keys(j.value), 'start'))
SELECT DISTINCT * FROM (SELECT 'commit' AS child_table, CAST(event_id AS VARCHAR) AS parent_id, lower(e->>'sha') AS child_key FROM e WHERE json_type(e) = 'OBJECT'
 UNION ALL SELECT 'theater_group', parent_id, {_sql_normal("CASE json_type(g) WHEN 'OBJECT' THEN g->>'code' WHEN 'VARCHAR' THEN g->>'$' END")} FROM g
 UNION ALL SELECT 'showtime', parent_id, id FROM s) WHERE child_key IS NOT NULL AND parent_id IS NOT NULL"""
#: Nodes of JSON texts b with their Dewey labels; text inside a JSON string is read as JSON at the top.
_SQL_LABELS = """j AS (SELECT key_, CASE WHEN json_type(b) = 'VARCHAR' THEN b->>'$' ELSE b END AS b FROM docs WHERE json_valid(b)),
t AS (SELECT key_, x.* FROM j, json_tree(CASE WHEN json_valid(b) THEN b END) x),
o AS (SELECT *, row_number() OVER (PARTITION BY key_, parent ORDER BY id) AS place FROM t),
d AS (SELECT key_, id, '1' AS label, '' AS path, type, value, CAST(NULL AS VARCHAR) AS parent_label FROM o WHERE parent IS NULL
 UNION ALL SELECT o.key_, o.id, d.label || '.' || o.place, CASE WHEN d.type = 'ARRAY' THEN d.path ELSE d.path || '/' || o.key END, o.type, o.value, d.label
 FROM o JOIN d ON o.key_ = d.key_ AND o.parent = d.id)"""


def _sql_scalar(object_: str, member: str) -> str:
    return f"CASE WHEN json_type({object_}->'{member}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {object_}->>'{member}' END"


_SQL_COMMITS = f"""WITH RECURSIVE docs AS (SELECT delivery_no AS key_, payload AS b FROM event_log WHERE payload LIKE '%commits%'), {_SQL_LABELS},
c AS (SELECT * FROM d WHERE path = '/commits' AND type = 'OBJECT'), a AS (SELECT * FROM d WHERE path = '/commits/author' AND type = 'OBJECT')
SELECT c.key_ AS delivery_no, c.label AS commit_label, {_sql_scalar("c.value", "sha")} AS sha, {_sql_scalar("c.value", "message")} AS message,
 {_sql_scalar("a.value", "name")} AS name, {_sql_scalar("a.value", "email")} AS email FROM c LEFT JOIN a ON a.key_ = c.key_ AND a.parent_label = c.label"""
_SQL_SHOWTIMES = f"""WITH RECURSIVE docs AS (SELECT page_id AS key_, body AS b FROM theater_page), {_SQL_LABELS},
r AS (SELECT * FROM d WHERE path = '/results' AND type = 'OBJECT'),
s AS (SELECT * FROM d WHERE path LIKE '/results/showtimes%' AND type = 'OBJECT' AND list_contains(json_keys(value), 'start') AND list_contains(json_keys(value), 'id')),
x AS (SELECT s.*, r.label AS theater, r.value AS theater_value FROM s JOIN r ON r.key_ = s.key_ AND starts_with(s.label, r.label || '.'))
SELECT key_ AS page_id, theater AS parent_label, label, {_sql_scalar("theater_value", "id")} AS theater_id, {_sql_scalar("value", "id")} AS showtime_id, {_sql_scalar("value", "start")} AS start FROM x"""
_SQL_RANKED = f"""WITH {_SQL_LOG}, r AS (SELECT *, coalesce(CAST(event_id AS VARCHAR), 'd' || delivery_no) AS k FROM log),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY instant_s IS NULL, payload IS NULL, received_at NULLS LAST, delivery_no) AS no, count(*) OVER (PARTITION BY k) AS deliveries FROM r)"""

SQL = {
    "p1_found": f"WITH {_SQL_LOG} SELECT event_id FROM log WHERE event_id IS NOT NULL GROUP BY event_id HAVING count(*) > 1",
    "p1_kept": f"{_SQL_RANKED} SELECT event_id AS message_key, deliveries, delivery_no, instant_s, type FROM o WHERE no = 1",
    "p1_next_batch": f"""WITH {_SQL_LOG}, r AS (SELECT *, coalesce(CAST(event_id AS VARCHAR), 'd' || delivery_no) AS k, coalesce(batch_id >= (SELECT max(batch_id) FROM log), true) AS fresh FROM log),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fresh, received_at NULLS LAST, delivery_no) AS no, count(*) OVER (PARTITION BY k) AS deliveries FROM r)
SELECT event_id AS message_key, deliveries, delivery_no, batch_id FROM o WHERE no = 1""",
    "p2_found": f"{_SQL_SESSIONS} FROM s GROUP BY actor_id, no",
    "p2_sessions": f"""WITH t AS ({_SQL_SESSIONS}, coalesce(type, '') AS type, count(*) AS n, no FROM s GROUP BY actor_id, no, coalesce(type, ''))
SELECT actor_id, min(start_s) AS start_s, max(end_s) AS end_s, max(end_s) - min(start_s) AS duration_s, CAST(sum(n) AS BIGINT) AS events,
 string_agg(type || '=' || n, ',' ORDER BY type) AS types FROM t GROUP BY actor_id, no""",
    "p3_found": _SQL_NESTED,
    "p3_commits": _SQL_COMMITS,
    "p3_showtimes": _SQL_SHOWTIMES,
    "p4_found": f"{_SQL_TERMS} SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p4_terms": f"{_SQL_TERMS} SELECT field, term, occurrences, records, mark FROM m",
    "p5_found": f"""{_SQL_KEYS}, n AS (SELECT field, key_value, count(*) AS n FROM ok GROUP BY field, key_value)
SELECT field, key_value FROM n JOIN (SELECT field, count(*) AS total FROM ok GROUP BY field) USING (field) WHERE n > 0.015 * total""",
    "p5_totals": f"""{_SQL_KEYS} SELECT field, key_value, count(*) AS deliveries, CAST(sum(CAST(type = 'PushEvent' AS INT)) AS BIGINT) AS pushes,
CAST(sum(length(payload)) AS BIGINT) AS payload_chars, min(instant_s) AS first_s, max(instant_s) AS last_s FROM ok GROUP BY field, key_value""",
    "p5_actors": f"""SELECT {_sql_normal("repo.name")} AS repo, count(DISTINCT actor.id) AS actors FROM event_log
WHERE {_sql_normal("repo.name")} IS NOT NULL AND actor.id IS NOT NULL GROUP BY 1""",
}
