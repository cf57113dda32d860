"""Registered queries of logs, catalogs and streams: inputs are written from the driver's tables, then read back as a user would."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import streaming
from ..operators import audit, reports
from ..schemas import USAGE_KEY
from ..sources import bridge, catalog, logs
from ..sources.scratch import fresh_dir
from . import oracle as O
from .queries import Tables, query

#: Log files end in what Spark's text writer ends them in.
GLOB = "*.txt"
#: Files of one batch of a stream.
BATCH_FILES = 8
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


#: Events whose lines are put in order together.
BLOCK = 4096


def _write_lines(rows: DataFrame, name: str, *order: str) -> str:
    """Lines, one file per value of ``p``, in order; returns the folder.

    Many tasks put blocks of lines in order; the one that writes a file only strings its blocks together."""
    root = fresh_dir(rows.sparkSession, name)
    blocks = rows.groupBy("p", F.floor(F.col("event_id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("x"))
    kept = blocks.select("p", "block", F.array_join("x.line", "\n").alias("line")).repartition("p").sortWithinPartitions("p", "block").select("p", "line")
    kept.write.partitionBy("p").text(f"{root}/projects")
    return root


#: Events whose lines go to one file of a folder.
EVENTS = 200_000


def _write_files(t: Tables, rows: DataFrame, name: str, *order: str) -> str:
    """Lines, for each value of ``p`` a folder with a file for every ``EVENTS`` events or so, each in order; returns the folder."""
    root = fresh_dir(rows.sparkSession, name)
    blocks = bridge.events(t.spark, t.sf_dir).count() // EVENTS + 1
    kept = rows.repartition(4 * blocks, "p", F.floor(F.col("event_id") / EVENTS)).sortWithinPartitions("p", *order).select("p", "line")
    kept.write.partitionBy("p").text(f"{root}/projects")
    return root


def _claude_lines(t: Tables) -> DataFrame:
    """Two lines for each event, the second one with more output; one in ten is broken, foreign, negative, synthetic or nameless."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    kind = i % 10
    usage = F.struct(
        F.when(kind == 2, -1).otherwise(i % 1000).cast("long").alias("input_tokens"), (k * 7 + F.col("copy") * 5).alias("output_tokens"),
        F.struct((i % 3).alias("ephemeral_5m_input_tokens"), (i % 2).alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
        F.when(i % 4 == 0, "priority").otherwise(" ").alias("service_tier"),
    )
    message = F.struct(F.when(kind == 3, "<synthetic>").otherwise(F.concat(F.lit("claude-opus-"), (i % 3).cast("string"))).alias("model"),
        usage.alias("usage"))
    line = F.to_json(F.struct(
        F.when(kind == 1, "user").otherwise("assistant").alias("type"), F.date_format(F.col("ts").cast("timestamp"), STAMP).alias("timestamp"),
        F.when(kind == 4, "").otherwise(F.concat(F.lit("req-"), i.cast("string"))).alias("requestId"),
        F.concat(F.lit("sess-"), F.col("user_id").cast("string")).alias("sessionId"), message.alias("message"),
    ))
    rows = bridge.events(t.spark, t.sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.withColumns({"p": F.concat(F.lit("app"), (F.col("user_id") % 4).cast("string")),
            "line": F.when(kind == 0, F.concat(F.lit("{broken "), i)).otherwise(line)})


def _codex_lines(t: Tables) -> DataFrame:
    """Sign-ups open a session, purchases set a model, all other events count tokens."""
    i, k, kind = F.col("event_id"), F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    say = lambda **f: F.to_json(F.struct(*(v.alias(n) for n, v in f.items())))
    stamp = F.date_format(F.col("ts").cast("timestamp"), STAMP)
    meta = F.struct(F.concat(F.lit("s"), i).alias("id"), F.concat(F.lit("/home/me/repo"), F.col("user_id") % 5).alias("cwd"))
    turn = F.struct(F.when(i % 2 == 0, "gpt-5.5").otherwise("gpt-5.4").alias("model"))
    usage = F.struct((i % 500).alias("input_tokens"), (i % 100).alias("cached_input_tokens"), (k * 3).alias("output_tokens"))
    count = F.struct(F.lit("token_count").alias("type"), F.struct(usage.alias("last_token_usage")).alias("info"))
    line = (
        F.when(kind == "signup", say(timestamp=stamp, type=F.lit("session_meta"), payload=meta)).when(kind == "purchase",
            say(timestamp=stamp, type=F.lit("turn_context"), payload=turn))
        .otherwise(say(timestamp=stamp, type=F.lit("event_msg"), payload=count))
    )
    return bridge.events(t.spark, t.sf_dir).withColumns({"p": F.concat(F.lit("dir"), (F.col("user_id") % 4).cast("string")), "line": line})


LINES = """lines AS (SELECT event_id AS i, event_id % 10 AS kind, user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, copy FROM events, (VALUES (0), (1)) AS c(copy)),
states AS (SELECT *, CASE WHEN kind IN (0, 2) THEN 'bad' WHEN kind IN (1, 3, 4) THEN 'skipped' ELSE 'kept' END AS state FROM lines)"""
TURNS = """turns AS (SELECT event_id AS i, ts, event_type, user_id % 4 AS p, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  last_value(CASE WHEN event_type = 'signup' THEN 's' || event_id END IGNORE NULLS) OVER w AS session, last_value(CASE WHEN event_type = 'signup' THEN 'repo' || (user_id % 5) END IGNORE NULLS) OVER w AS project,
  last_value(CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'gpt-5.5' ELSE 'gpt-5.4' END END IGNORE NULLS) OVER w AS model
  FROM events WINDOW w AS (PARTITION BY user_id % 4 ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""
KEPT = "SELECT * FROM states WHERE state = 'kept' AND copy = 1"


@query("S1_S3_line_states", O.base(LINES) + " SELECT 'p=app' || (user_id % 4) AS folder, state, count(*) AS n FROM states GROUP BY ALL")
def _(t):
    root = _write_files(t, _claude_lines(t), "claude-logs", "event_id", "copy")
    parsed = logs.parse_claude(logs.discover(t.spark, root, GLOB))
    return parsed.groupBy(F.regexp_extract("path", "(p=app[0-9])", 1).alias("folder"), "state").agg(F.count(F.lit(1)).alias("n"))


@query("S2_S4_claude_records", O.base(LINES) + f""" SELECT 'req-' || i AS request_id, 'sess-' || user_id AS session_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'claude-opus-' || (i % 3) AS model_id, i % 1000 AS input_tokens, k * 7 + 5 AS output_tokens,
i % 3 + i % 2 AS cache_creation_tokens, CASE WHEN i % 4 = 0 THEN 'priority' END AS service_tier, 'p=app' || (user_id % 4) AS project, false AS is_subagent FROM ({KEPT})""")
def _(t):
    root = _write_files(t, _claude_lines(t), "claude-logs", "event_id", "copy")
    kept = logs.kept_records(logs.parse_claude(logs.discover(t.spark, root, GLOB)), "claude-code")
    return kept.select("request_id", "session_id", audit.text_of(F.col("timestamp")).alias("at"), "model_id", "input_tokens", "output_tokens",
        "cache_creation_tokens", "service_tier", "project", "is_subagent")


@query("S5_S6_codex_records", O.base(TURNS) + """ SELECT session AS session_id, project, model AS model_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, i % 500 AS input_tokens, i % 100 AS cached_input_tokens, k * 3 AS output_tokens, 'standard' AS processing_mode
FROM turns WHERE event_type NOT IN ('signup', 'purchase') AND model IS NOT NULL AND session IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY session, ts, i % 500, i % 100, k ORDER BY p, i) = 1""")
def _(t):
    root = _write_lines(_codex_lines(t), "codex-logs", "event_id")
    kept = logs.kept_records(logs.parse_codex(logs.discover(t.spark, root, GLOB)), "codex").filter("session_id like 's%'")
    return kept.select("session_id", "project", "model_id", audit.text_of(F.col("timestamp")).alias("at"), "input_tokens", "cached_input_tokens",
        "output_tokens", "processing_mode")


@query("S7_line_offsets", O.base("""flat AS (SELECT event_id, user_id % 4 AS p, 'x' || event_id || repeat('é', CAST(event_id % 5 AS INTEGER)) AS line FROM events)""") + """ SELECT event_id,
row_number() OVER w - 1 AS pos, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY p ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM flat WINDOW w AS (PARTITION BY p ORDER BY event_id)""")
def _(t):
    line = F.concat(F.lit("x"), F.col("event_id"), F.repeat(F.lit("é"), (F.col("event_id") % 5).cast("int")))
    rows = bridge.events(t.spark, t.sf_dir).withColumns({"p": F.col("user_id") % 4, "line": line})
    found = logs.lines(logs.discover(t.spark, _write_lines(rows, "offsets", "event_id"), GLOB))
    return found.select(F.regexp_extract("line", "x([0-9]+)", 1).cast("long").alias("event_id"), F.col("pos").cast("long").alias("pos"), "start")


def _store(t: Tables) -> tuple[str, str, DataFrame, DataFrame]:
    """A first half of the logs read into a store, then all of them."""
    lines, store = _claude_lines(t), fresh_dir(t.spark, "store")
    half, whole = (_write_lines(x, "claude-logs", "event_id", "copy") for x in (lines.filter("user_id % 4 < 2"), lines))
    first = logs.ingest(t.spark, {"claude-code": half, "codex": f"{half}/none"}, store, glob=GLOB)
    second = logs.ingest(t.spark, {"claude-code": whole}, store, glob=GLOB)
    return store, whole, first, second


@query("S8_S13_ingest_reports", O.base(LINES) + """, halves AS (SELECT 1 AS run, * FROM states WHERE user_id % 4 < 2 UNION ALL SELECT 2, * FROM states)
SELECT run, 'claude-code' AS provider, CAST(count(DISTINCT user_id % 4) AS BIGINT) AS discovered, CAST(count(DISTINCT user_id % 4) AS BIGINT) AS processed,
  count(*) FILTER (state = 'kept' AND copy = 1 AND (run = 1 OR user_id % 4 >= 2)) AS inserted, count(*) FILTER (state = 'bad') AS parse_errors, 0::BIGINT AS file_errors FROM halves GROUP BY run
UNION ALL SELECT 1, 'codex', 0, 0, 0, 0, 0""")
def _(t):
    _, _, first, second = _store(t)
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2))).drop("last_record_at", "last_ingested_at", "status",
        "findings")


@query("S13_report_details", O.base(LINES) + """, halves AS (SELECT 1 AS run, * FROM states WHERE user_id % 4 < 2 UNION ALL SELECT 2, * FROM states)
SELECT run, 'claude-code' AS provider, 'partial' AS status,
  strftime(max(ts) FILTER (state = 'kept' AND copy = 1 AND (run = 1 OR user_id % 4 >= 2)), '%Y-%m-%d %H:%M:%S') AS last_record_at, true AS ingested,
  CAST(count(DISTINCT user_id % 4) FILTER (state = 'bad') AS BIGINT) AS files_with_findings, count(*) FILTER (state = 'bad') AS bad_lines FROM halves GROUP BY run
UNION ALL SELECT 1, 'codex', 'missing', NULL, false, 0, 0""")
def _(t):
    _, _, first, second = _store(t)
    bad = F.aggregate("findings", F.lit(0).cast("long"), lambda n, f: n + f["bad_lines"])
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2))).select(
        "run", "provider", "status", audit.text_of(F.col("last_record_at")).alias("last_record_at"), F.col("last_ingested_at").isNotNull().alias("ingested"),
        F.size("findings").cast("long").alias("files_with_findings"), bad.alias("bad_lines"))


@query("S9_changed_files", """WITH f AS (SELECT event_id AS i, 100 + event_id % 5 * 10 AS size, 100 + event_id % 3 * 10 AS was, 100 + event_id % 3 * 10 - event_id % 4 * 10 AS consumed,
  event_id % 7 > 0 AS known, event_id % 2 = 0 AS touched FROM events)
SELECT i, CAST(CASE WHEN known AND size >= was AND size > consumed THEN consumed ELSE 0 END AS BIGINT) AS start FROM f
WHERE NOT (known AND size = was AND NOT touched AND consumed >= size)""")
def _(t):
    i = F.col("event_id")
    at = F.col("ts").cast("timestamp")
    rows = bridge.events(t.spark, t.sf_dir).select(F.concat(F.lit("/logs/"), i).alias("path"), i, (100 + i % 5 * 10).cast("long").alias("size"), at.alias("mtime"))
    before = F.when(i % 2 == 0, at - F.expr("interval 1 hour")).otherwise(at)
    known = bridge.events(t.spark, t.sf_dir).filter(i % 7 > 0).select(
        F.lit("codex").alias("provider"), F.concat(F.lit("/logs/"), i).alias("path"), (100 + i % 3 * 10).cast("long").alias("size"), before.alias("mtime"),
        (100 + i % 3 * 10 - i % 4 * 10).cast("long").alias("consumed"), at.alias("ingested_at"))
    return logs.changed(rows, known, "codex").select(F.col("event_id").alias("i"), F.col("offset").cast("long").alias("start"))


@query("S11_invalid_records", O.base(O.USAGE) + """ SELECT problem, count(*) AS n FROM (SELECT CASE WHEN CAST(split_part(request_id, '-', 2) AS BIGINT) % 11 = 0 THEN 'blank id, model or file'
  WHEN CAST(split_part(request_id, '-', 2) AS BIGINT) % 13 = 0 OR CAST(split_part(request_id, '-', 2) AS BIGINT) % 17 = 0 THEN 'token count out of range' END AS problem FROM usage)
WHERE problem IS NOT NULL GROUP BY 1""")
def _(t):
    i, most = F.substring_index("request_id", "-", -1).cast("long"), F.lit(2**63 - 1)
    rows = t.usage.withColumns({"model_id": F.when(i % 11 == 0, " ").otherwise(F.col("model_id")), "source_file": F.lit("f"),
            "input_tokens": F.when(i % 13 == 0, -1).when(i % 17 == 0, most).otherwise(F.col("input_tokens")),
            "output_tokens": F.when(i % 17 == 0, most).otherwise(F.col("output_tokens"))})
    return logs.invalid_records(rows).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("S11_S12_S15_stored_usage",
    O.base(LINES) + f" SELECT 'claude-code' AS provider, strftime(ts, '%Y-%m-%d') AS usage_date, count(*) AS n, CAST(sum(k * 7 + 5) AS BIGINT) AS output_tokens FROM ({KEPT}) GROUP BY ALL")
def _(t):
    store, whole, _, _ = _store(t)
    logs.ingest(t.spark, {"claude-code": whole}, store, glob=GLOB)  # nothing is read again
    return logs.stored_usage(t.spark, store).groupBy("provider",
        F.col("usage_date").cast("string").alias("usage_date")).agg(F.count(F.lit(1)).alias("n"), F.sum("output_tokens").alias("output_tokens"))


@query("S16_rebuilt_usage",
    O.base(LINES) + f" SELECT 'p=app' || (user_id % 4) AS project, count(*) AS n FROM ({KEPT}) WHERE user_id % 4 = 3 AND ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL")
def _(t):
    store, _, _, _ = _store(t)
    left = _write_lines(_claude_lines(t).filter("user_id % 4 = 3 and ts < timestamp_ntz'2024-01-15 00:00:00'"), "claude-logs", "event_id", "copy")
    logs.ingest(t.spark, {"claude-code": left}, store, rebuild=True, glob=GLOB)
    return logs.stored_usage(t.spark, store).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query("A15_inventory_of_files", O.base(LINES) + f""" SELECT 'usage_rows' AS item, '' AS key, CAST(count(*) AS VARCHAR) AS value FROM ({KEPT}) UNION ALL
SELECT 'files_by_provider', 'claude-code', CAST(count(DISTINCT user_id % 4) + count(DISTINCT CASE WHEN user_id % 4 < 2 THEN user_id % 4 END) AS VARCHAR) FROM lines""")
def _(t):
    store, _, _, _ = _store(t)
    usage, files = logs.stored_usage(t.spark, store), logs.stored_manifest(t.spark, store)
    return reports.inventory(usage, t.prices, files).filter("item in ('usage_rows', 'files_by_provider')")


# -- catalogs


#: Entries of one document of a catalog, some 5 MB.
DOCUMENT = 10_000


def _catalog(t: Tables, faults: bool = False) -> str:
    """A catalog made from parts, a document a file; returns its folder."""
    part, k = t.spark.read.parquet(f"{t.sf_dir}/part.parquet"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    bad = lambda n, x, y: F.when(k % n == 0, x).otherwise(y) if faults else y
    rates = F.map_from_arrays(F.array(F.lit("input"), F.lit("output")),
        F.array(F.col("p_size").cast("decimal(18,6)"), (F.col("p_size") * 5).cast("decimal(18,6)")))
    entry = F.struct(
        F.lit("codex").alias("provider"), F.array(bad(7, F.lit(" "), F.concat(F.lit("part-"), k)),
            F.concat(F.lit("part-"), k, F.lit("-x"))).alias("model_ids"), F.array().cast("array<string>").alias("model_aliases"),
        F.lit("USD").alias("currency"),
        F.when(k % 2 == 0, "2024-01-01").otherwise("2024-01-01T06:00:00Z").alias("effective_from"), none.alias("effective_to"),
        bad(11, F.lit(""), F.concat(F.lit("list-"), k % 3)).alias("source"),
        bad(5, F.lit("nowhere"), F.concat(F.lit("s"), k % 3)).alias("source_ref"),
        F.struct(none.alias("service_tier"), none.alias("speed"), F.when(k % 3 == 0, "us").alias("region"),
            F.lit("standard").alias("processing_mode"), none.alias("source_detail")).alias("dimensions"),
        rates.alias("rates_per_1m_tokens"), F.concat(F.lit("n"), k).alias("notes"),
    )
    source = lambda i: F.struct(F.lit(f"s{i}").alias("id"), F.lit(f"http{'' if faults and i == 1 else 's'}://example.org/{i}").alias("url"),
        F.lit("2024-01-02").alias("retrieved_at"), F.lit("").alias("notes"))
    # a document is one row, so it has a bounded number of entries; the first one tells the sources
    block = F.floor(k / DOCUMENT)
    parts = part.select(k.alias("k"), entry.alias("e"), block.alias("block")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "e")), lambda a,
            b: (a["k"] - b["k"]).cast("int")).alias("x"))
    told, none_told = F.array(*(source(i) for i in range(3))), F.array().cast("array<struct<id:string,url:string,retrieved_at:string,notes:string>>")
    first = F.col("block") == part.agg(F.min(block)).first()[0]
    whole = parts.select(
        F.lit(2 if faults else 1).alias("schema_version"), F.lit("").alias("notes"), (F.col("block") * DOCUMENT).alias("first_position"),
        F.when(first, told).otherwise(none_told).alias("sources"), F.transform("x", lambda x: x["e"]).alias("entries"),
    )
    path = fresh_dir(t.spark, "catalog")
    whole.write.option("maxRecordsPerFile", 1).json(path)
    return path


_PRICED = """SELECT 'codex' AS provider, 'part-' || p_partkey || s AS model_id, c.cat AS token_category, CASE WHEN p_partkey % 3 = 0 THEN 'us' END AS region, CAST(p_size * c.f AS DOUBLE) AS rate,
CASE WHEN p_partkey % 2 = 0 THEN '2024-01-01 00:00:00' ELSE '2024-01-01 06:00:00' END AS effective_from, 'list-' || (p_partkey % 3) AS source FROM part, (VALUES (''), ('-x')) AS m(s), (VALUES ('input', 1), ('output', 5)) AS c(cat, f)"""


def _listed(df: DataFrame) -> DataFrame:
    return df.select("provider", "model_id", "token_category", "region", F.col("rate_per_1m_tokens").cast("double").alias("rate"),
        audit.text_of(F.col("effective_from")).alias("effective_from"), "source")


@query("S17_S18_catalog_prices", _PRICED)
def _(t):
    return _listed(catalog.catalog_prices(catalog.read_catalog(t.spark, _catalog(t))))


@query("C5_imported_catalog", f"""SELECT *, 0 AS source_count FROM ({_PRICED}) UNION ALL SELECT 'codex', 'old', 'input', NULL, 1.0::DOUBLE, '2023-01-01 00:00:00', 'list-0', 0
UNION ALL SELECT 'source', source_url, NULL, NULL, NULL, NULL, source, n FROM (SELECT 'list-' || (p_partkey % 3) AS source, 'https://example.org/' || (p_partkey % 3) AS source_url, 1 AS n FROM part GROUP BY ALL)""")
def _(t):
    one = catalog.catalog_prices(catalog.read_catalog(t.spark, _catalog(t))).limit(1)
    old = one.withColumns({"model_id": F.lit("old"), "token_category": F.lit("input"), "region": F.lit(None).cast("string"),
            "rate_per_1m_tokens": F.lit("1").cast("decimal(18,6)"), "effective_from": F.lit(dt.datetime(2023, 1, 1)).cast("timestamp"),
            "source": F.lit("list-0")})
    meta = bridge.sources(t.spark).limit(0)
    prices, sources = catalog.import_catalog(t.spark, _catalog(t), old, meta)
    none = F.lit(None).cast("string")
    shown = sources.select(F.lit("source").alias("provider"), F.col("source_url").alias("model_id"), none.alias("token_category"),
        none.alias("region"), F.lit(None).cast("double").alias("rate"), none.alias("effective_from"), "source", F.lit(1).alias("source_count"))
    return _listed(prices).withColumn("source_count", F.lit(0)).unionByName(shown)


@query("C7_catalog_violations", """SELECT problem, count(*) AS n FROM (SELECT 'unsupported version' AS problem UNION ALL SELECT 'source url is not https' UNION ALL SELECT 'no or blank model ids' FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT 'blank source' FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT 'unknown source_ref' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT 'repeated price' FROM (SELECT c.cat, p_partkey % 3 = 0, p_partkey % 2 FROM part, (VALUES ('input'), ('output')) AS c(cat) WHERE p_partkey % 7 = 0 GROUP BY ALL HAVING count(*) > 1)) GROUP BY 1""")
def _(t):
    return catalog.catalog_violations(catalog.read_catalog(t.spark, _catalog(t, faults=True))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# -- streams


def _stream(t: Tables, *parts: Column) -> DataFrame:
    """Usage as a stream of one batch of files per part."""
    path = fresh_dir(t.spark, "usage-stream")
    for when in parts or [F.lit(True)]:
        # dealt round, so that every part has as many files as a batch takes
        t.usage.filter(when).repartition(BATCH_FILES).write.mode("append").parquet(path)
    return t.spark.readStream.schema(t.usage.schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(path)


@query("T1_appended_usage",
    O.base(O.USAGE) + " SELECT provider, strftime(\"timestamp\", '%Y-%m-%d') AS usage_date, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM usage GROUP BY ALL")
def _(t):
    i, store = F.substring_index("request_id", "-", -1).cast("long"), fresh_dir(t.spark, "usage")
    # the second part repeats a third of the first one's records
    streaming.append_usage(_stream(t, i % 2 == 0, (i % 2 == 1) | (i % 3 == 0)), store, fresh_dir(t.spark, "offsets")).awaitTermination()
    return t.spark.read.parquet(store).groupBy("provider", F.col("usage_date").cast("string").alias("usage_date")).agg(F.count(F.lit(1)).alias("n"),
        F.sum("total_tokens").alias("total_tokens"))


def _collected(t: Tables, df: DataFrame, mode: str) -> DataFrame:
    """What a stream has put out in the end."""
    path = fresh_dir(t.spark, "stream-result")
    how = "overwrite" if mode == "complete" else "append"
    write = lambda batch, epoch: batch.write.mode(how).parquet(path)
    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation",
        fresh_dir(t.spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path)


@query("T2_stream_rollup",
    O.base(O.USAGE) + " SELECT strftime(date_trunc('hour', \"timestamp\"), '%Y-%m-%d %H:%M:%S') AS period_start, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in O.SUMS) + ", count(*) AS request_count FROM usage GROUP BY 1")
def _(t):
    i = F.substring_index("request_id", "-", -1).cast("long")
    out = _collected(t, streaming.rollup(_stream(t, i % 2 == 0, i % 2 == 1), "hourly"), "complete")
    return out.withColumn("period_start", audit.text_of(F.col("period_start"))).drop("session_count")


@query("T2_final_rollup",
    O.base(O.USAGE) + """, parts AS (SELECT *, CAST(split_part(request_id, '-', 2) AS BIGINT) AS i, date_trunc('hour', "timestamp") AS h FROM usage),
first AS (SELECT max("timestamp") - INTERVAL 1 HOUR AS w FROM parts WHERE i % 5 > 0 AND "timestamp" < TIMESTAMP '2024-01-20 00:00:00'),
last AS (SELECT max("timestamp") - INTERVAL 1 HOUR AS w FROM parts),
kept AS (SELECT * FROM parts WHERE i % 5 > 0 OR h + INTERVAL 1 HOUR > (SELECT w FROM first))
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS period_start, """ + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in O.SUMS) + """, count(*) AS request_count,
  count(DISTINCT (provider, session_id)) AS session_count FROM kept WHERE h + INTERVAL 1 HOUR <= (SELECT w FROM last) GROUP BY h""")
def _(t):
    i = F.substring_index("request_id", "-", -1).cast("long")
    # the third part has a fifth of all rows, most of which come behind the watermark of the first
    fifth, early = i % 5 == 0, F.col("timestamp") < F.lit("2024-01-20 00:00:00").cast("timestamp")
    out = _collected(t, streaming.final_rollup(_stream(t, ~fifth & early, ~fifth & ~early, fifth), "hourly"), "append")
    return out.withColumn("period_start", audit.text_of(F.col("period_start")))


@query("T3_stream_costs",
    O.priced(f"SELECT c.provider, c.request_id, c.token_category, c.component_ordinal, c.tokens, CAST(p.rate AS DOUBLE) AS rate, CAST(round(CAST(c.tokens AS DECIMAL(20,0)) * p.rate, 0) AS DOUBLE) / 1e6 AS cost_usd FROM components c LEFT JOIN prices p ON {O.MATCH} AND p.currency = 'USD' AND {O.IN_FORCE}"))
def _(t):
    out = _collected(t, streaming.component_costs(_stream(t), t.prices), "append")
    return out.select(*USAGE_KEY, "token_category", F.col("component_ordinal").cast("long").alias("component_ordinal"), "tokens",
        F.col("rate").cast("double").alias("rate"), "cost_usd")


@query("T4_deduplicated_stream", O.base(O.USAGE) + " SELECT provider, count(*) AS n FROM usage GROUP BY 1")
def _(t):
    i = F.substring_index("request_id", "-", -1).cast("long")
    out = _collected(t, streaming.deduplicated(_stream(t, F.lit(True), i % 3 == 0), "60 days"), "append")
    return out.groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
