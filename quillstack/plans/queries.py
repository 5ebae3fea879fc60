"""The engine's operators over the driver's tables (plans.views), each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as s
from ..functions import times as t
from ..operators import ledger as ops
from ..schemas import LEDGER
from ..sources import logs
from ..sources.catalog import parsed as parsed_files
from ..sources.ledger import live, unfinished
from . import rollbacks, views

Query = Callable[[SparkSession, str], DataFrame]
#: Queries whose rows are in order, as their SQL is.
ORDERED = ("executed", "pending", "status", "by_batch", "rollback_last_batch", "rollback_batch", "rollback_steps", "rollback_to", "rollback_all", "history", "history_untimed", "orphans", "list", "drift", "unfinished", "table_names")
_NAME_SQL = "CASE WHEN event_id % 10 <> 0 OR event_type = 'error' THEN 'evt_' || CAST(event_id AS VARCHAR) ELSE 'mig_' || CAST(event_id // 10 AS VARCHAR) END"
LEDGER_SQL = f"""ledger AS (
    SELECT event_id AS id, {_NAME_SQL} AS migration, CAST(event_id // 100 + 1 AS INTEGER) AS batch, ts AS executed_at,
           CAST(floor(value) AS INTEGER) AS execution_time, sha256(props) AS checksum
    FROM events
)"""
CATALOG_SQL = """catalog AS (
    SELECT 'mig_' || CAST(doc_id AS VARCHAR) AS name, source || '_' || CAST(doc_id AS VARCHAR) AS filename, sha256(text) AS checksum FROM documents
)"""
BOTH_SQL = f"WITH {LEDGER_SQL}, {CATALOG_SQL}"
_PLAN = "SELECT id, migration, batch, executed_at, execution_time, {from_}.checksum AS checksum, name, filename, c.checksum AS current FROM {from_} JOIN catalog c ON migration = name"


def _both(use) -> Query:
    return lambda spark, d: use(views.catalog(spark, d), views.ledger(spark, d))


def _ledger(use) -> Query:
    return lambda spark, d: use(views.ledger(spark, d))


def _table(name: str, use) -> Query:
    return lambda spark, d: use(views.table(spark, d, name))


def _statements(pages: DataFrame) -> DataFrame:
    return s.statements(pages.select("page_id", "html"), "html").select("page_id", F.col("statement_no").cast("long").alias("statement_no"), "statement")


def _padding(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        s.padded_left(F.col("lang"), 6, "*").alias("padded_left"),
        s.padded_right(F.col("source"), 8, ".").alias("padded_right"),
        F.octet_length("text").cast("long").alias("bytes"),
        s.truncated(F.col("source"), 4).alias("truncated"),
        s.truncated(F.col("source"), 2).alias("truncated_short"),
        s.is_blank(F.col("text")).alias("blank"),
        s.short_checksum(s.checksum(F.col("text"))).alias("short_checksum"),
    )


def _names(part: DataFrame) -> DataFrame:
    p = F.col("p_name")
    return part.select(
        "p_partkey", s.snake_case(p).alias("snake"), s.pascal_case(p).alias("pascal"), s.camel_case(p).alias("camel"), s.sanitized_name(p).alias("sanitized"), s.is_valid_name(p).alias("valid"),
        s.table_of(F.concat(F.lit("create_"), s.sanitized_name(p), F.lit("_table"))).alias("table_name"),
    )


def _filenames(orders: DataFrame) -> DataFrame:
    name = F.concat(t.migration_timestamp(F.col("o_orderdate")), F.lit("_order_"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(".txt ")).otherwise(F.lit(".sql")))
    bad = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), name)).otherwise(name)
    p = s.parsed_filename(bad)
    return orders.select("o_orderkey", p["timestamp"].alias("stamp"), p["name"].alias("name"), p["valid"].alias("valid"), t.display_timestamp(t.parsed_timestamp(p["timestamp"])).alias("shown"))


def _durations(lineitem: DataFrame) -> DataFrame:
    ns = (F.col("l_extendedprice") * 1_000_000).cast("long")
    return lineitem.select("l_orderkey", "l_linenumber", t.duration(ns - ns % 1_000_000).alias("took"), t.whole_milliseconds(F.col("l_quantity")).alias("ms"))


def _fine_durations(lineitem: DataFrame) -> DataFrame:
    """Nanoseconds over all magnitudes, with parts of a millisecond."""
    power = F.lit(10).cast("double") ** (F.col("l_suppkey") % 9)
    ns = ((F.col("l_partkey") * 1009 + F.col("l_orderkey")) % 100_003 * power.cast("long")).cast("long")
    return lineitem.select("l_orderkey", "l_linenumber", ns.alias("ns"), t.duration(ns).alias("took"))


def _catalog_parse(files: DataFrame) -> DataFrame:
    return parsed_files(files).select("name", "filename", "filepath", "checksum", "up_sql", "down_sql", "valid")


def _generated(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", s.generated_filename(F.concat("o_orderpriority", F.lit(" Order"), "o_orderstatus"), F.col("o_orderdate")).alias("filename"), t.migration_timestamp(F.col("o_orderdate")).alias("stamp"))


def _zones(events: DataFrame) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return events.select("event_id", t.display_timestamp(t.in_zone(at, "America/New_York")).alias("new_york"), t.display_timestamp(t.in_zone(at, "Asia/Kolkata")).alias("kolkata"), t.display_timestamp(t.in_zone(at, "No/Where")).alias("nowhere"))


_PLURALS = "person child foot tooth mouse goose Person wolf knife leaf roof city day key box bus dish church quiz fizz table s y fe f users company index".split()


def _plurals(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(w,) for w in [*_PLURALS, ""]], "word string")
    return rows.select("word", s.plural(F.col("word")).alias("plural"), s.table_of(F.concat(F.lit("create_"), F.lower("word"), F.lit("_table"))).alias("table_name"))


def _column_check(spark: SparkSession, d: str) -> DataFrame:
    """The columns of `events` against those that a ledger must have."""
    columns = lambda schema: spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema.fields], "name string, type string")
    return ops.column_problems(columns(LEDGER), columns(views.ledger(spark, d).drop("checksum").withColumn("batch", F.col("batch").cast("long")).schema))


def _plain_times(log: DataFrame) -> DataFrame:
    """The log with times as they are written, without a zone."""
    return log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _parameters(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT event_id, value FROM {rows} WHERE event_type = :kind AND value > :least", args={"kind": "purchase", "least": 30.0}, rows=views.table(spark, d, "events"))


def _array_functions(orders: DataFrame) -> DataFrame:
    items = F.array("o_orderstatus", F.substring("o_orderpriority", 3, 1), "o_orderstatus")
    return orders.select("o_orderkey", F.array_join(s.without_repeats(items), ",").alias("distinct_items"), s.contains(items, F.lit("F")).alias("has_f"), s.is_vowel(F.lower(F.substring("o_orderpriority", 3, 1))).alias("vowel"))


QUERIES: dict[str, Query] = {
    "executed": _ledger(ops.executed),
    "pending": _both(ops.pending),
    "status": _both(ops.status),
    "status_table": _both(ops.status_table),
    "last_batch": _ledger(ops.last_batch),
    "last_batch_empty": _ledger(lambda rows: ops.last_batch(rows.where("batch < 0"))),
    "by_batch": _ledger(lambda rows: ops.by_batch(rows, 7)),
    "by_name": _ledger(lambda rows: ops.by_name(rows, "mig_12")),
    "rollback_last_batch": _both(rollbacks.rollback_batch),
    "rollback_batch": _both(lambda c, rows: rollbacks.rollback_batch(c, rows, 5)),
    "rollback_steps": _both(lambda c, rows: rollbacks.rollback_steps(c, rows, 50)),
    "rollback_to": _both(lambda c, rows: rollbacks.rollback_to(c, rows, "mig_40")),
    "rollback_all": _both(rollbacks.rollback_all),
    "run_plan": _both(lambda c, rows: rollbacks.run_plan(c, rows, 25)),
    "drift": lambda spark, d: ops.drift(views.catalog(spark, d), views.drifting_ledger(spark, d)),
    "history": _ledger(ops.history),
    "history_table": _ledger(ops.history_table),
    "list": lambda spark, d: ops.listing_table(views.catalog(spark, d)),
    "orphans": _both(ops.orphans),
    "ledger_unique": _ledger(ops.repeated_names),
    "ledger_exists": _ledger(lambda rows: ops.exists(rows, F.col("migration") == "mig_3")),
    "next_batch": _ledger(ops.next_batch),
    "progress": _both(ops.progress),
    "one_per_name": lambda spark, d: ops.one_per_name(views.catalog(spark, d).withColumn("name", F.split("filename", "_")[0])),
    "history_untimed": lambda spark, d: ops.history(views.untimed_ledger(spark, d)),
    "ledger_repeats": lambda spark, d: ops.repeated_names(views.ledger_events(spark, d)),
    "live_ledger": lambda spark, d: live(views.ledger_events(spark, d)),
    "unfinished": lambda spark, d: unfinished(views.ledger_events(spark, d)),
    "other_sessions": _table("events", lambda e: ops.other_sessions(e.select("event_id", F.col("user_id").alias("pid"), F.col("event_type").alias("datname")), "view", 7)),
    "table_exists": _both(lambda c, rows: ops.exists(c, (F.col("name") == "mig_3") & F.col("filename").startswith("no-such"))),
    "column_check": _column_check,
    "table_names": _table("documents", lambda x: x.select(F.concat(s.snake_case(F.col("source")), F.lit("_"), "lang").alias("table_name")).distinct().orderBy("table_name")),
    "parameters": _parameters,
    "first_row": _ledger(lambda rows: ops.limited(ops.executed(rows), 1)),
    "catalog_parse": lambda spark, d: _catalog_parse(views.script_files(spark, d)),
    "suffix_filter": _table("orders", lambda o: ops.script_names(o.select(F.concat("o_orderstatus", F.lit("_"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".SQL").when(F.col("o_orderkey") % 3 == 1, ".sql").otherwise(".sql.bak")).alias("filename")))),
    "log_parse": lambda spark, d: _plain_times(logs.parsed(views.log_lines(spark, d))),
    "log_threshold": lambda spark, d: _plain_times(logs.parsed(views.log_lines(spark, d)).where(logs.at_least("warning"))),
    "statements": _table("pages", _statements),
    "padding": _table("documents", _padding),
    "names": _table("part", _names),
    "filenames": _table("orders", _filenames),
    "generated_filename": _table("orders", _generated),
    "durations": _table("lineitem", _durations),
    "durations_fine": _table("lineitem", _fine_durations),
    "zones": _table("events", _zones),
    "ports": _table("orders", lambda o: o.select("o_orderkey", t.is_port((F.col("o_orderkey") * 37 % 70_000 - 100).cast("int")).alias("valid"))),
    "arrays": _table("orders", _array_functions),
    "plurals": _plurals,
    "pluralize": _table("nation", lambda n: n.select("n_nationkey", s.plural(F.col("n_name")).alias("plural"))),
    "distinct": _table("events", lambda e: e.select("event_type").distinct()),
}

_SNAKE = r"regexp_replace(regexp_replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[ _-]+', '_', 'g'), '^_|_$', '', 'g')"
_WORDS = "list_filter(regexp_split_to_array({0}, '[^a-zA-Z0-9]+'), lambda x: x <> '')"
_PASCAL = f"array_to_string(list_transform({_WORDS}, lambda x: upper(x[1]) || lower(x[2:])), '')"
_PLURAL = """CASE WHEN {0} = '' THEN '' WHEN {0} = 'person' THEN 'people' WHEN {0} = 'child' THEN 'children' WHEN {0} = 'foot' THEN 'feet' WHEN {0} = 'tooth' THEN 'teeth'
    WHEN {0} = 'mouse' THEN 'mice' WHEN {0} = 'goose' THEN 'geese' WHEN regexp_matches({0}, '[^aeiou]y$') THEN regexp_replace({0}, 'y$', 'ies')
    WHEN regexp_matches({0}, '(s|sh|ch|x|z)$') THEN {0} || 'es' WHEN {0} LIKE '%f' THEN regexp_replace({0}, 'f$', 'ves') WHEN {0} LIKE '%fe' THEN regexp_replace({0}, 'fe$', 'ves')
    ELSE {0} || 's' END"""
_SNAKED = _SNAKE.format("p_name")
_CLEAN = f"regexp_replace({_SNAKED}, '[^a-zA-Z0-9_]', '', 'g')"
_STATUS = "SELECT c.*, l.id IS NOT NULL AS executed, l.executed_at, l.batch, l.execution_time FROM catalog c LEFT JOIN ledger l ON l.migration = c.name"

_EVENTS_SQL = """WITH rows AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'reverted' WHEN 'view' THEN 'intent:up' ELSE 'applied' END AS event, 'user_' || CAST(user_id AS VARCHAR) AS migration,
    CAST(event_id // 100 + 1 AS INTEGER) AS batch, ts AS executed_at, CAST(floor(value) AS INTEGER) AS execution_time, sha256(props) AS checksum FROM events)"""
_LOG_SQL = """WITH log AS (SELECT date_trunc('second', ts) AS ts, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value < 20 THEN 'DEBUG' WHEN value < 50 THEN 'warning' ELSE 'INFO' END AS level,
    event_type AS category, coalesce(props, '') AS message FROM events WHERE event_type <> 'click')"""

ORACLE_SQL: dict[str, str] = {
    "executed": f"{BOTH_SQL} SELECT * FROM ledger ORDER BY id",
    "pending": f"{BOTH_SQL} SELECT c.* FROM catalog c ANTI JOIN ledger l ON l.migration = c.name ORDER BY filename",
    "status": f"{BOTH_SQL} {_STATUS} ORDER BY filename",
    "status_table": f"""{BOTH_SQL} SELECT name, CASE WHEN executed THEN 'Executed' ELSE 'Pending' END AS status, coalesce(CAST(batch AS VARCHAR), '-') AS batch,
        coalesce(strftime(executed_at, '%Y-%m-%d %H:%M:%S'), '-') AS executed_at FROM ({_STATUS})""",
    "last_batch": f"{BOTH_SQL} SELECT coalesce(max(batch), 0) AS last_batch FROM ledger",
    "last_batch_empty": f"{BOTH_SQL} SELECT coalesce(max(batch), 0) AS last_batch FROM ledger WHERE batch < 0",
    "by_batch": f"{BOTH_SQL} SELECT * FROM ledger WHERE batch = 7 ORDER BY id DESC",
    "by_name": f"{BOTH_SQL} SELECT * FROM ledger WHERE migration = 'mig_12'",
    "rollback_last_batch": f"{BOTH_SQL}, l AS (SELECT * FROM ledger WHERE batch = (SELECT max(batch) FROM ledger)) {_PLAN.format(from_='l')} ORDER BY id DESC",
    "rollback_batch": f"{BOTH_SQL}, l AS (SELECT * FROM ledger WHERE batch = 5) {_PLAN.format(from_='l')} ORDER BY id DESC",
    "rollback_steps": f"{BOTH_SQL}, l AS (SELECT * FROM ledger ORDER BY id DESC LIMIT 50) {_PLAN.format(from_='l')} ORDER BY id DESC",
    "rollback_to": f"{BOTH_SQL}, l AS (SELECT * FROM ledger WHERE id > (SELECT max(id) FROM ledger WHERE migration = 'mig_40')) {_PLAN.format(from_='l')} ORDER BY id DESC",
    "rollback_all": f"{BOTH_SQL} {_PLAN.format(from_='ledger')} ORDER BY id DESC",
    "run_plan": f"""{BOTH_SQL} SELECT c.*, (SELECT coalesce(max(batch), 0) + 1 FROM ledger) AS batch FROM catalog c ANTI JOIN ledger l ON l.migration = c.name
        ORDER BY filename LIMIT 25""",
    "drift": f"""WITH {CATALOG_SQL}, stored AS (
        SELECT c.name, c.filename, c.checksum AS current, CASE WHEN e.value < 50 THEN c.checksum ELSE sha256(e.props) END AS stored
        FROM events e JOIN catalog c ON c.name = {_NAME_SQL})
        SELECT name, filename, stored, current FROM stored WHERE stored <> current ORDER BY filename""",
    "history": f"{BOTH_SQL} SELECT * FROM ledger ORDER BY executed_at DESC NULLS FIRST, id DESC",
    "history_table": f"{BOTH_SQL} SELECT migration, batch, strftime(executed_at, '%Y-%m-%d %H:%M:%S') AS executed_at, CAST(execution_time AS VARCHAR) || 'ms' AS execution_time FROM ledger",
    "list": f"{BOTH_SQL} SELECT name, filename, CASE WHEN length(checksum) > 12 THEN checksum[:12] || '...' ELSE checksum END AS checksum FROM catalog ORDER BY filename",
    "orphans": f"{BOTH_SQL} SELECT l.* FROM ledger l ANTI JOIN catalog c ON l.migration = c.name ORDER BY id DESC",
    "ledger_unique": f"{BOTH_SQL} SELECT migration, count(*) AS n FROM ledger GROUP BY migration HAVING count(*) > 1",
    "ledger_exists": f"{BOTH_SQL} SELECT EXISTS (SELECT 1 FROM ledger WHERE migration = 'mig_3') AS found",
    "next_batch": f"{BOTH_SQL} SELECT CAST(coalesce(max(batch), 0) + 1 AS INTEGER) AS next_batch FROM ledger",
    "progress": f"""{BOTH_SQL} SELECT count(*) AS scripts, count(*) FILTER (executed) AS executed, count(*) FILTER (NOT executed) AS pending, count(*) FILTER (NOT executed) = 0 AS up_to_date FROM ({_STATUS})""",
    "one_per_name": f"{BOTH_SQL}, n AS (SELECT string_split(filename, '_')[1] AS name, filename, checksum FROM catalog) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY filename DESC) = 1",
    "history_untimed": f"""{BOTH_SQL}, u AS (SELECT l.id, l.migration, l.batch, CASE WHEN event_type <> 'error' THEN l.executed_at END AS executed_at, l.execution_time, l.checksum FROM ledger l JOIN events e ON e.event_id = l.id)
        SELECT * FROM u ORDER BY executed_at DESC NULLS FIRST, id DESC""",
    "ledger_repeats": "SELECT 'user_' || CAST(user_id AS VARCHAR) AS migration, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1",
    "live_ledger": f"""{_EVENTS_SQL} SELECT seq AS id, migration, batch, executed_at, execution_time, checksum
        FROM (SELECT *, row_number() OVER (PARTITION BY migration ORDER BY seq DESC) AS k FROM rows WHERE event <> 'intent:up') WHERE k = 1 AND event = 'applied'""",
    "unfinished": f"{_EVENTS_SQL} SELECT migration, arg_max(event, seq) AS event, max(seq) AS seq FROM rows GROUP BY migration HAVING arg_max(event, seq) LIKE 'intent:%' ORDER BY seq",
    "other_sessions": "SELECT event_id, user_id AS pid, event_type AS datname FROM events WHERE event_type = 'view' AND user_id <> 7",
    "table_exists": f"{BOTH_SQL} SELECT EXISTS (SELECT 1 FROM catalog WHERE name = 'mig_3' AND starts_with(filename, 'no-such')) AS found",
    "column_check": "SELECT * FROM (VALUES ('batch', 'int', 'bigint'), ('checksum', 'string', NULL), ('executed_at', 'timestamp', 'timestamp_ntz')) AS v(name, expected, found)",
    "table_names": r"SELECT DISTINCT regexp_replace(lower(regexp_replace(source, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[ _-]+', '_', 'g') || '_' || lang AS table_name FROM documents ORDER BY 1",
    "parameters": "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 30",
    "first_row": f"{BOTH_SQL} SELECT * FROM ledger ORDER BY id LIMIT 1",
    "catalog_parse": r"""WITH f AS (
            SELECT CASE WHEN lang = 'de' THEN 'x' ELSE '' END || strftime(to_timestamp(1600000000 + doc_id) AT TIME ZONE 'UTC', '%Y_%m_%d_%H%M%S') || '_doc_' || CAST(doc_id AS VARCHAR) AS stem,
                CASE WHEN lang = 'de' THEN '' ELSE 'doc_' || CAST(doc_id AS VARCHAR) END AS name, source,
                '-- head' || chr(10) || '-- +migrate Up' || chr(10) || coalesce(text, '') || chr(10) || '  -- +migrate Down, if need be' || chr(10) || 'DROP doc_' || CAST(doc_id AS VARCHAR) || chr(10) || '-- +migrate Up' || chr(10) || 'last' AS content FROM documents),
        l AS (SELECT stem, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM f),
        m AS (SELECT *, CASE WHEN contains(line, '-- +migrate Up') THEN 'up' WHEN contains(line, '-- +migrate Down') THEN 'down' END AS mark FROM l),
        o AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY stem ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now FROM m),
        s AS (SELECT stem, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (now = 'up'), '') AS up_sql, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (now = 'down'), '') AS down_sql FROM o WHERE mark IS NULL GROUP BY stem)
        SELECT name, stem || '.sql' AS filename, 'scripts/' || source || '/' || stem || '.sql' AS filepath, sha256(content) AS checksum, up_sql, down_sql, name <> '' AS valid FROM f JOIN s USING (stem)""",
    "suffix_filter": "SELECT o_orderstatus || '_' || CAST(o_orderkey AS VARCHAR) || '.sql' AS filename FROM orders WHERE o_orderkey % 3 = 1",
    "log_parse": f"{_LOG_SQL} SELECT * FROM log",
    "log_threshold": f"{_LOG_SQL} SELECT * FROM log WHERE upper(level) IN ('WARNING', 'ERROR', 'FATAL')",
    "generated_filename": f"""WITH n AS (SELECT o_orderkey, strftime(o_orderdate, '%Y_%m_%d_%H%M%S') AS stamp, {_SNAKE.format("(o_orderpriority || ' Order' || o_orderstatus)")} AS n FROM orders),
        c AS (SELECT *, regexp_replace(n, '[^a-zA-Z0-9_]', '', 'g') AS clean FROM n)
        SELECT o_orderkey, stamp || '_' || CASE WHEN regexp_matches(clean, '^[0-9]') THEN 'migration_' ELSE '' END || clean || '.sql' AS filename, stamp FROM c""",
    "durations_fine": """WITH d AS (SELECT l_orderkey, l_linenumber, CAST((l_partkey * 1009 + l_orderkey) % 100003 * CAST(power(10, l_suppkey % 9) AS BIGINT) AS BIGINT) AS ns FROM lineitem),
        c AS (SELECT *, CASE WHEN ns >= 1000000000 AND ns < 10000000000 THEN ns - ns % 10000000 WHEN ns >= 10000000000 AND ns < 60000000000 THEN ns - ns % 100000000 ELSE ns END AS v FROM d),
        u AS (SELECT *, CASE WHEN v < 1000000 THEN 1000 WHEN v < 1000000000 THEN 1000000 ELSE 1000000000 END AS unit FROM c),
        x AS (SELECT *, rtrim(rtrim(CAST(v // unit % 60 + CASE WHEN unit < 1000000000 THEN v // unit // 60 * 60 ELSE 0 END AS VARCHAR) || '.' || lpad(CAST(v % unit AS VARCHAR), CAST(log10(unit) AS INTEGER), '0'), '0'), '.') AS tail FROM u)
        SELECT l_orderkey, l_linenumber, ns, CASE WHEN ns = 0 THEN '0s' WHEN ns < 1000 THEN CAST(ns AS VARCHAR) || 'ns' WHEN ns < 1000000 THEN tail || 'µs' WHEN ns < 2000000 THEN '1ms' WHEN v < 1000000000 THEN tail || 'ms'
            WHEN v < 60000000000 THEN tail || 's' WHEN v < 3600000000000 THEN CAST(v // 60000000000 AS VARCHAR) || 'm' || tail || 's'
            ELSE CAST(v // 3600000000000 AS VARCHAR) || 'h' || CAST(v // 60000000000 % 60 AS VARCHAR) || 'm' || tail || 's' END AS took FROM x""",
    "zones": """SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS new_york,
        strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Kolkata', '%Y-%m-%d %H:%M:%S') AS kolkata, strftime(ts, '%Y-%m-%d %H:%M:%S') AS nowhere FROM events""",
    "ports": "SELECT o_orderkey, o_orderkey * 37 % 70000 - 100 BETWEEN 1 AND 65535 AS valid FROM orders",
    "plurals": "SELECT word, {} AS plural, CASE WHEN lower(word) LIKE '%s' THEN lower(word) ELSE {} END AS table_name FROM (VALUES {}) AS v(word)".format(_PLURAL.format("lower(word)"), _PLURAL.format("lower(word)"), ", ".join(f"('{w}')" for w in [*_PLURALS, ""])),
    "statements": r"""WITH chunks AS (SELECT page_id, list_filter(list_transform(string_split(html, ';'), lambda x: regexp_replace(x, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS c FROM pages),
        numbered AS (SELECT page_id, unnest(c) AS statement, unnest(range(len(c))) AS statement_no FROM chunks)
        SELECT page_id, statement_no, statement FROM numbered WHERE NOT starts_with(statement, '--')""",
    "padding": r"""SELECT doc_id, repeat('*', greatest(0, 6 - strlen(lang))::INT) || lang AS padded_left, source || repeat('.', greatest(0, 8 - strlen(source))::INT) AS padded_right, strlen(text) AS bytes,
        CASE WHEN strlen(source) <= 4 THEN source ELSE source[:1] || '...' END AS truncated,
        source[:2] AS truncated_short, NOT regexp_matches(text, '[^\s\x0B\x{85}\p{Z}]') AS blank, sha256(text)[:12] || '...' AS short_checksum FROM documents""",
    "names": f"""SELECT p_partkey, {_SNAKED} AS snake, {_PASCAL.format("p_name")} AS pascal, lower(({_PASCAL.format("p_name")})[1]) || ({_PASCAL.format("p_name")})[2:] AS camel,
        CASE WHEN regexp_matches({_CLEAN}, '^[0-9]') THEN 'migration_' || {_CLEAN} ELSE {_CLEAN} END AS sanitized, regexp_matches(p_name, '^[a-zA-Z0-9_]+$') AS valid,
        CASE WHEN {_CLEAN} LIKE '%s' THEN {_CLEAN} ELSE {_PLURAL.format(f"({_CLEAN})")} END AS table_name FROM part""",
    "filenames": """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END || strftime(o_orderdate, '%Y_%m_%d_%H%M%S') || '_order_' || CAST(o_orderkey AS VARCHAR)
            || CASE WHEN o_orderkey % 3 = 0 THEN '.txt ' ELSE '.sql' END AS f FROM orders),
        p AS (SELECT o_orderkey, regexp_replace(f, '[.]sql$', '') AS f FROM n),
        m AS (SELECT o_orderkey, regexp_extract(f, '^(\\d{4}_\\d{2}_\\d{2}_\\d{6})_([^\\n]+)$', 1) AS stamp, regexp_extract(f, '^(\\d{4}_\\d{2}_\\d{2}_\\d{6})_([^\\n]+)$', 2) AS name FROM p)
        SELECT o_orderkey, stamp, name, name <> '' AS valid, strftime(try_strptime(stamp, '%Y_%m_%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS shown FROM m""",
    "durations": """WITH d AS (SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice * 1000000) AS BIGINT) // 1000000 AS ms, CAST(floor(l_quantity * 1000) AS INTEGER) AS q FROM lineitem),
        c AS (SELECT *, CASE WHEN ms >= 1000 AND ms < 10000 THEN ms - ms % 10 WHEN ms >= 10000 AND ms < 60000 THEN ms - ms % 100 ELSE ms END AS v FROM d),
        x AS (SELECT *, CAST(v // 1000 % 60 AS VARCHAR) || rtrim(rtrim('.' || lpad(CAST(v % 1000 AS VARCHAR), 3, '0'), '0'), '.') || 's' AS tail FROM c)
        SELECT l_orderkey, l_linenumber, q AS ms, CASE WHEN v = 0 THEN '0s' WHEN v < 1000 THEN CAST(v AS VARCHAR) || 'ms' WHEN v < 60000 THEN tail
            WHEN v < 3600000 THEN CAST(v // 60000 AS VARCHAR) || 'm' || tail ELSE CAST(v // 3600000 AS VARCHAR) || 'h' || CAST(v // 60000 % 60 AS VARCHAR) || 'm' || tail END AS took FROM x""",
    "arrays": """SELECT o_orderkey, CASE WHEN o_orderstatus = o_orderpriority[3:3] THEN o_orderstatus ELSE o_orderstatus || ',' || o_orderpriority[3:3] END AS distinct_items,
        o_orderstatus = 'F' OR o_orderpriority[3:3] = 'F' AS has_f, lower(o_orderpriority[3:3]) IN ('a', 'e', 'i', 'o', 'u') AS vowel FROM orders""",
    "pluralize": f"SELECT n_nationkey, {_PLURAL.format('lower(n_name)')} AS plural FROM nation",
    "distinct": "SELECT DISTINCT event_type FROM events",
}
