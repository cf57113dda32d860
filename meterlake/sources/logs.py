"""Session logs of two providers to usage records, in batches over whole directories."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from ..functions.columns import RFC3339, cache_creation_total, classify_family, codex_request_id, first_present, is_subagent, processing_mode, project_from_cwd, project_from_dir, session_from_path, total_tokens
from ..schemas import TOKEN_COLUMNS, USAGE, USAGE_COLUMNS, USAGE_KEY

_USAGE = (
    "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,"
    "cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,service_tier:string,speed:string,inference_geo:string>"
)
CLAUDE = (
    "type string, timestamp string, serviceTier string, speed string, inferenceGeo string, requestId string, sessionId string, uuid string, "
    f"message struct<model:string,service_tier:string,speed:string,inference_geo:string,usage:{_USAGE}>, _bad string"
)
CODEX_COUNTS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
MANIFEST = "provider string, path string, size long, mtime timestamp, consumed long, ingested_at timestamp"


class InvalidRecord(ValueError):
    """A usage record that may not be stored."""


def listing(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """Every log file below a directory: path, size, mtime; nothing of its content is read.  A missing directory is empty.

    Empty files are not listed.  Where the file system shows links as the files they lead to, as Spark's local one does, they count as files.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "path string, size long, mtime timestamp")
        raise
    return files.select(plain_path("path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def plain_path(path: Column | str) -> Column:
    return F.regexp_replace(path, r"^file:/*", "/")


def raw_lines(spark: SparkSession, root: str | list[str], glob: str = "*.jsonl", since: dt.datetime | None = None) -> DataFrame:
    """(path, split, seq, value): the lines of all logs, split by split, in order of ``seq`` within a split.

    Spark deals out large files in splits, each of which has the lines that begin in it.  Files older than ``since`` are not opened."""
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True)
    text = reader.option("pathGlobFilter", glob).text(root, lineSep="\n")
    if since is not None:
        text = text.filter(F.col("_metadata.file_modification_time") >= F.lit(since))
    return text.select(plain_path(F.url_decode("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), "value")


#: Lines placed together, as a power of two, and bytes of logs that one task places.
CHUNK_BITS, TASK_BYTES = 12, 16 << 20
CHUNK = ["path", "split", "_chunk"]


def places(files: DataFrame, root: str | None = None, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """The raw lines in ``CHUNK``s, and ``files`` with a row for each of their chunks: lines and bytes of the file before it, and
    whether the file is ``there``.  A file that can't be read has one row.

    A chunk is some lines in a row of one split.  Without a ``root`` the folders of the files are read.
    """
    spark = files.sparkSession
    least = files.agg(F.min("mtime")).first()[0]
    where = root or sorted(r[0] for r in files.select(F.regexp_extract("path", "^(.*)/", 1)).distinct().collect())
    kinds = "path string, split long, seq long, value string"
    try:
        raw = raw_lines(spark, where, glob, least) if least else spark.createDataFrame([], kinds)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], kinds)
    raw = raw.withColumn("_chunk", F.shiftright("seq", CHUNK_BITS))
    whole, before = Window.partitionBy("path"), Window.partitionBy("path").orderBy("split", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = raw.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("value") + 1).alias("_bytes"))
    sums = sums.select(*CHUNK, F.sum("_bytes").over(whole).alias("_total"), F.coalesce(F.sum("_n").over(before), zero).alias("_lines"),
        F.coalesce(F.sum("_bytes").over(before), zero).alias("_start"))
    # readers drop a mark of three bytes at a file's start
    mark = F.when(F.col("size") - F.col("_total") >= 2, 3).otherwise(0)
    there = F.coalesce(F.col("_total") + 3 >= F.col("size"), F.lit(False))
    return raw, files.join(sums, "path", "left").withColumns({"_start": F.col("_start") + mark, "there": there}).drop("_total")


def placed_lines(raw: DataFrame, placed: DataFrame) -> DataFrame:
    """The lines of files that are there: split, value, pos, start (in bytes), ended (by a line feed).

    A line's offset is what earlier chunks of its file hold and what earlier lines of its chunk do; ``split`` tells where its chunk
    starts.  As many tasks deal with chunks as the files' size asks for, whatever their text shrinks to in a shuffle, of which there
    is one.  What a file has gained since it was listed waits.
    """
    held = placed.select("path", "size").distinct().agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    size = F.octet_length("value") + 1
    inside = Window.partitionBy(*CHUNK).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # placed within a chunk before chunks are placed, so that the join finds its order made
    own = raw.repartition(max(1, -(-held // TASK_BYTES)), *CHUNK).withColumns({"_nth": F.row_number().over(inside) - 1,
            "_at": F.sum(size).over(inside) - size})
    pos, start = F.col("_lines") + F.col("_nth"), F.col("_start") + F.col("_at")
    out = [*(c for c in placed.columns if c not in ("split", "_chunk", "_lines", "_start", "there")), "split", "value", "pos", "start", "ended"]
    rows = own.join(placed.filter("there"), CHUNK).withColumns({"pos": pos, "start": start})
    return rows.withColumns({"split": F.col("_start"), "ended": F.col("start") + size <= F.col("size")}).filter("start < size").select(*out)


def opened(files: list[str], placed: DataFrame) -> DataFrame:
    """One row a file, with a null ``value`` if it can't be read."""
    return placed.groupBy(*files).agg(F.when(F.max("there"), "").alias("value"))


def read(files: DataFrame, root: str | None = None, glob: str = "*") -> DataFrame:
    """``files`` with their lines, as ``placed_lines`` gives them; one row with a null value for a file that can't be read, which
    does not stop the others."""
    raw, placed = places(files, root, glob)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    rest = placed.filter("not there").select(*files.columns).distinct()
    return placed_lines(raw, placed).unionByName(rest.select(*files.columns, zero.alias("split"), none.alias("value"), zero.alias("pos"),
        zero.alias("start"), F.lit(False).alias("ended")))


def discover(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """Every log file below a directory with its lines, as ``read`` gives them."""
    return read(file_columns(listing(spark, root, glob)), root, glob)


def file_columns(files: DataFrame) -> DataFrame:
    """What a path tells, worked out for files rather than for each of their lines."""
    return files.withColumns({"project": project_from_dir("path"), "is_subagent": F.coalesce(is_subagent("path"), F.lit(False)),
            "file_session": session_from_path("path")})


def changed(files: DataFrame, manifest: DataFrame, provider: str) -> DataFrame:
    """Files to read, with the offset from which errors count.

    Unchanged ones are skipped; a grown file resumes; a shrunk one, or one with a new time only, restarts at 0.
    """
    known = manifest.filter(F.col("provider") == provider).select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"),
        F.col("consumed").alias("_consumed"))
    rows = files.join(known, "path", "left")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")) & (F.col("_consumed") >= F.col("size"))
    offset = F.when((F.col("size") >= F.col("_size")) & (F.col("size") > F.col("_consumed")), F.col("_consumed")).otherwise(0)
    return rows.filter(~F.coalesce(same, F.lit(False))).withColumn("offset", F.coalesce(offset, F.lit(0))).drop("_size", "_mtime", "_consumed")


def lines(files: DataFrame) -> DataFrame:
    """What ``read`` found, one row per line that is not blank."""
    return files.withColumnRenamed("value", "line").filter(F.trim("line") != "")


def carried(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], chunk: Column | None = None) -> DataFrame:
    """``rows`` with the last value of some columns that was set so far, by key in order, under new names.

    With ``chunk``, which must not fall in order, a key's rows are scanned chunk by chunk: the last value set in each chunk, a
    running last one over a row per chunk, and what is set inside each.  No task then holds more of a key than a chunk.
    """
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({new: F.last(c, ignorenulls=True).over(w) for c, new in columns.items()})
    rows = rows.withColumn("_chunk", chunk)
    at = F.struct(*order)
    last = rows.groupBy(*keys, "_chunk").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_last_{c}") for c in columns))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    told = last.select(*keys, "_chunk", *(F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_last_{c}") for c in columns))
    meets = F.col("r._chunk").eqNullSafe(F.col("t._chunk"))
    for k in keys:
        meets = meets & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    both = rows.alias("r").join(told.alias("t"), meets).select("r.*", *(f"t._last_{c}" for c in columns))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({new: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_last_{c}")) for c, new in columns.items()}).drop("_chunk",
        *(f"_last_{c}" for c in columns))


def resumed(rows: DataFrame) -> DataFrame:
    """Lines from each file's offset on."""
    return rows.filter(F.col("start") >= F.col("offset")) if "offset" in rows.columns else rows


def _types(obj: Column) -> Column:
    return F.schema_of_variant(obj)


def _count(v: Column, path: str) -> Column:
    """A count of a variant: absent is 0, anything but a whole number from 0 is null."""
    at = F.variant_get(v, path, "variant")
    return F.when(at.isNull(), F.lit(0).cast("long")).when(_types(at) == "BIGINT", F.try_variant_get(v, path, "long"))


def parse_claude(files: DataFrame) -> DataFrame:
    """Lines of the first provider, each ``kept``, ``skipped``, ``bad`` or a ``tail`` still being written."""
    rows = resumed(lines(files if "file_session" in files.columns else file_columns(files)))
    v = F.try_parse_json("line")
    rows = rows.withColumn("j", F.from_json("line", CLAUDE, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})).withColumn("v", v)
    u = "$.message.usage"
    counts = [f"{u}.{c}" for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
            "cache_creation.ephemeral_5m_input_tokens", "cache_creation.ephemeral_1h_input_tokens")]
    # a count that is no whole number makes a line corrupt to begin with; a null one is told from none by the variant alone
    below, absent = F.lit(False), F.lit(False)
    for c in counts:
        below = below | F.coalesce(F.col(f"j{c[1:]}") < 0, F.lit(False))
        absent = absent | F.coalesce(F.is_variant_null(F.variant_get("v", c, "variant")), F.lit(False))
    wrong = below | (F.col("line").contains("null") & absent)
    kind = F.variant_get("v", "$.type", "variant")
    ts = F.col("j.timestamp")
    bad = (
        F.col("v").isNull() | F.col("j._bad").isNotNull() | F.coalesce(_types(kind) != "STRING", F.lit(True)) | wrong
        | (ts.isNotNull() & (~ts.rlike(RFC3339) | F.try_to_timestamp(ts).isNull()))
    )
    m = F.col("j.message")
    keep = (
        (F.col("j.type") == "assistant") & m["usage"].isNotNull() & (F.coalesce("j.requestId", F.lit("")) != "") & ~F.coalesce(m["model"],
            F.lit("")).isin("", "<synthetic>") & ts.isNotNull()
    )
    state = F.when(bad, F.when(F.col("ended"), "bad").otherwise("tail")).when(F.coalesce(keep, F.lit(False)), "kept").otherwise("skipped")
    usage, split = m["usage"], m["usage"]["cache_creation"]
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = rows.withColumn("state", state).select(
        "path", "size", "mtime", "offset" if "offset" in files.columns else F.lit(0).alias("offset"), "pos", "start", "state",
        F.lit("claude-code").alias("provider"),
        F.col("j.requestId").alias("request_id"), F.coalesce(F.col("j.sessionId"), F.col("file_session")).alias("session_id"),
        F.col("j.uuid").alias("uuid"), F.try_to_timestamp(ts).alias("timestamp"),
        classify_family(m["model"]).alias("model_family"), m["model"].alias("model_id"), n(usage["input_tokens"]).alias("input_tokens"),
        n(usage["output_tokens"]).alias("output_tokens"),
        cache_creation_total(usage["cache_creation_input_tokens"], split["ephemeral_5m_input_tokens"],
            split["ephemeral_1h_input_tokens"]).alias("cache_creation_tokens"),
        n(usage["cache_read_input_tokens"]).alias("cache_read_tokens"), F.lit(0).cast("long").alias("cached_input_tokens"),
        F.lit(0).cast("long").alias("reasoning_output_tokens"),
        n(split["ephemeral_5m_input_tokens"]).alias("cache_creation_5m_tokens"),
        n(split["ephemeral_1h_input_tokens"]).alias("cache_creation_1h_tokens"),
        first_present(usage["service_tier"], m["service_tier"], F.col("j.serviceTier")).alias("service_tier"),
        first_present(usage["speed"], m["speed"], F.col("j.speed")).alias("speed"),
        first_present(usage["inference_geo"], m["inference_geo"], F.col("j.inferenceGeo")).alias("region"),
        F.lit(None).cast("string").alias("processing_mode"), "project", F.col("path").alias("source_file"), "is_subagent",
    )
    return out.withColumn("total_tokens", total_tokens())


def max_output_wins(records: DataFrame) -> DataFrame:
    """Per file and request the record with most output; the first of equals."""
    best = F.row_number().over(Window.partitionBy("path", "request_id").orderBy(F.desc("output_tokens"), "pos"))
    return records.withColumn("_r", best).filter("_r = 1").drop("_r")


def first_wins(records: DataFrame) -> DataFrame:
    """Per key the first record, by path and position."""
    first = F.row_number().over(Window.partitionBy(*USAGE_KEY).orderBy("path", "pos"))
    return records.withColumn("_r", first).filter("_r = 1").drop("_r")


def parse_codex(files: DataFrame) -> DataFrame:
    """Lines of the second provider; session, directory, model and mode carry forward within a file."""
    rows = lines(files if "file_session" in files.columns else file_columns(files)).withColumn("v", F.try_parse_json("line"))
    g = lambda p: F.try_variant_get("v", p, "string")
    ts = g("$.timestamp")
    bad = F.col("v").isNull() | F.coalesce(_types(F.variant_get("v", "$.type", "variant")) != "STRING", F.lit(True)) | F.variant_get("v", "$.payload",
        "variant").isNull()
    kind, inner = g("$.type"), g("$.payload.type")
    sets = lambda p, *kinds: F.when(kind.isin(*kinds), first_present(g(p)))
    rows = rows.withColumn("bad", bad).withColumns({
        "_session": sets("$.payload.id", "session_meta"), "_cwd": sets("$.payload.cwd", "session_meta", "turn_context"),
        "_model": sets("$.payload.model", "turn_context"),
        "_mode": sets("$.payload.processing_mode", "session_meta", "turn_context"),
    })
    # what was said before the offset still holds after it
    rows = resumed(carried(rows, ["path"], ["pos"], {"_session": "s_session", "_cwd": "s_cwd", "_model": "s_model", "_mode": "s_mode"}, F.col("split")))
    places = ("$.payload.info.last_token_usage", "$.payload.response.usage", "$.payload.usage")
    at = F.coalesce(*(F.variant_get("v", p, "variant") for p in places))
    rows = rows.withColumn("u", at)
    pick = lambda *paths: F.coalesce(*(F.when(F.variant_get("u", p, "variant").isNotNull(), _count(F.col("u"), p)) for p in paths),
        F.lit(0).cast("long"))
    cached = F.when(F.variant_get("u", "$.cached_input_tokens", "variant").isNotNull(),
        _count(F.col("u"), "$.cached_input_tokens")).otherwise(_count(F.col("u"), "$.input_token_details.cached_tokens"))
    reason = F.when(F.variant_get("u", "$.reasoning_output_tokens", "variant").isNotNull(),
        _count(F.col("u"), "$.reasoning_output_tokens")).otherwise(_count(F.col("u"), "$.output_token_details.reasoning_tokens"))
    n_in, n_out = _count(F.col("u"), "$.input_tokens"), _count(F.col("u"), "$.output_tokens")
    decodes = F.coalesce(_types(F.col("u")).startswith("OBJECT"),
        F.lit(False)) & (F.coalesce(n_in, F.lit(-1)) >= 0) & (F.coalesce(n_out, F.lit(-1)) >= 0) & (F.coalesce(cached,
            F.lit(-1)) >= 0) & (F.coalesce(reason, F.lit(-1)) >= 0)
    good_ts = F.coalesce(ts.rlike(RFC3339), F.lit(False)) & F.try_to_timestamp(ts).isNotNull()
    keep = (kind == "event_msg") & (inner == "token_count") & F.col("s_model").isNotNull() & F.col("u").isNotNull() & decodes & good_ts
    state = F.when(F.col("bad"), F.when(F.col("ended"), "bad").otherwise("tail")).when(F.coalesce(keep, F.lit(False)), "kept").otherwise("skipped")
    mode = processing_mode(F.try_variant_get("u", "$.processing_mode", "string"), g("$.payload.info.processing_mode"),
        g("$.payload.response.processing_mode"), g("$.payload.processing_mode"), F.col("s_mode"))
    session = F.coalesce("s_session", "file_session")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    out = rows.withColumn("state", state).withColumns({"n_in": n_in, "n_out": n_out, "n_cached": cached, "n_reason": reason, "mode": mode,
            "session_id": session})
    stamp = F.regexp_replace(F.regexp_replace(ts, " ", "T"), r"[Zz]$", "+00:00")
    return out.select(
        "path", "size", "mtime", "offset" if "offset" in files.columns else F.lit(0).alias("offset"), "pos", "start", "state",
        F.lit("codex").alias("provider"),
        codex_request_id(F.col("session_id"), stamp, F.col("n_in"), F.col("n_cached"), F.col("n_out"), F.col("n_reason"),
            F.col("mode")).alias("request_id"), "session_id", none.alias("uuid"), F.try_to_timestamp(ts).alias("timestamp"),
        classify_family("s_model").alias("model_family"), F.col("s_model").alias("model_id"), F.col("n_in").alias("input_tokens"),
        F.col("n_out").alias("output_tokens"), zero.alias("cache_creation_tokens"), zero.alias("cache_read_tokens"),
        F.col("n_cached").alias("cached_input_tokens"), F.col("n_reason").alias("reasoning_output_tokens"), zero.alias("cache_creation_5m_tokens"),
        zero.alias("cache_creation_1h_tokens"), none.alias("service_tier"), none.alias("speed"), none.alias("region"),
        F.col("mode").alias("processing_mode"), project_from_cwd("s_cwd").alias("project"), F.col("path").alias("source_file"),
        F.lit(False).alias("is_subagent"),
    ).withColumn("total_tokens", total_tokens())


#: Provider name to its parser; a new provider is one more entry.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"claude-code": parse_claude, "codex": parse_codex}


def kept_records(parsed: DataFrame, provider: str) -> DataFrame:
    """Per key the first record by path and position; of the first provider's, that of its file with most output.

    A request's records of its first file, most output first, begin with what ``first_wins`` finds after ``max_output_wins``."""
    order = ["path", F.desc("output_tokens"), "pos"] if provider == "claude-code" else ["path", "pos"]
    none_before = F.lag(F.lit(1)).over(Window.partitionBy(*USAGE_KEY).orderBy(*order)).isNull()
    return parsed.filter("state = 'kept'").withColumn("_first", none_before).filter("_first").drop("_first")


def invalid_records(records: DataFrame) -> DataFrame:
    """Records with ``problem``: a blank id, model or file, or a token count that is null, below 0 or whose sum exceeds a long."""
    blank, wrong, total = F.lit(False), F.lit(False), F.lit(0).cast("decimal(38,0)")
    for c in ("request_id", "model_id", "source_file"):
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    for c in TOKEN_COLUMNS:
        wrong = wrong | F.col(c).isNull() | (F.col(c) < 0)
    for c in TOKEN_COLUMNS[:4]:
        total = total + F.coalesce(c, F.lit(0)).cast("decimal(20,0)")
    problem = F.when(blank, "blank id, model or file").when(wrong | (total > F.lit(str(2**63 - 1)).cast("decimal(38,0)")), "token count out of range")
    return records.withColumn("problem", problem).filter("problem is not null")


def validate(records: DataFrame) -> None:
    bad = invalid_records(records).limit(1).collect()
    if bad:
        raise InvalidRecord(f"{bad[0]['problem']} in {bad[0]['source_file']}")


def new_records(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records whose key is not stored yet: insert or ignore.

    A request that was stored under another day still counts, so days can't prune the stored side; its keys alone are read.
    """
    return records.join(stored.select(*USAGE_KEY), USAGE_KEY, "left_anti").select(*USAGE_COLUMNS)


def consumed(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Per file the bytes that are read for good: all, or up to a tail that is still being written."""
    tail = parsed.filter("state = 'tail'").groupBy("path").agg(F.min("start").alias("tail"))
    return files.select("path", "size", "mtime").distinct().join(tail, "path", "left").select("path", "size", "mtime",
        F.coalesce("tail", "size").alias("consumed"))


def upsert_manifest(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    both = manifest.withColumn("_w", F.lit(0)).unionByName(fresh.withColumn("_w", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("provider", "path").orderBy(F.desc("_w"), F.desc("ingested_at")))
    return both.withColumn("_r", last).filter("_r = 1").drop("_w", "_r")


REPORT = (
    "provider string, discovered long, processed long, inserted long, parse_errors long, file_errors long, last_record_at timestamp, "
    "last_ingested_at timestamp, status string, findings array<struct<path:string,bad_lines:long>>"
)
#: Files with findings that a report names; ``parse_findings`` has them all.
NAMED = 100


def ingest_report(provider: str, discovered: DataFrame, files: DataFrame, parsed: DataFrame, inserted: DataFrame,
    ingested_at: Column | None = None) -> DataFrame:
    """One row: files found and read, records stored, bad lines past each file's offset, files that can't be read, latest
    record, when this provider was last ingested, the first ``NAMED`` files with findings by path, and a status: ``ok``,
    ``partial`` (with findings), ``failed`` (no file of those to read could be), ``unchanged`` or ``missing`` (no file at all)."""
    found = discovered.agg(F.count(F.lit(1)).alias("discovered"))
    each = files.groupBy("path").agg(F.max(F.col("value").isNotNull()).alias("there"))
    opened = each.agg(F.count_if("there").alias("processed"), F.count_if(~F.col("there")).alias("file_errors"))
    bad = parsed.agg(F.count_if((F.col("state") == "bad") & (F.col("start") >= F.col("offset"))).alias("parse_errors"))
    stored = inserted.agg(F.count(F.lit(1)).alias("inserted"), F.max("timestamp").alias("last_record_at"))
    some = parse_findings(parsed, files).orderBy("path").limit(NAMED).agg(F.array_sort(F.collect_list(F.struct("path", "bad_lines"))).alias("findings"))
    # one-row results side by side
    out = found.join(F.broadcast(opened)).join(F.broadcast(bad)).join(F.broadcast(stored)).join(F.broadcast(some))
    c = F.col
    status = (
        F.when(c("discovered") == 0, "missing").when(c("processed") + c("file_errors") == 0, "unchanged").when(c("processed") == 0, "failed")
        .when(F.size("findings") > 0, "partial").otherwise("ok")
    )
    return out.select(F.lit(provider).alias("provider"), "discovered", "processed", "inserted", "parse_errors", "file_errors", "last_record_at",
        (F.lit(None).cast("timestamp") if ingested_at is None else ingested_at).alias("last_ingested_at"), status.alias("status"), "findings")


def parse_findings(parsed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per file how many bad lines it has past its offset; one that can't be read has null."""
    out = parsed.filter("state = 'bad' and start >= offset").groupBy("path").agg(F.count(F.lit(1)).alias("bad_lines"))
    return out if files is None else out.unionByName(files.filter("value is null").select("path", F.lit(None).cast("long").alias("bad_lines")))


def stored_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def current(spark: SparkSession, store: str) -> int:
    """The version that readers see; 0 before the first ingest."""
    names = _names(spark, f"{store}/versions")
    return max((int(n) for n in names if n.isdigit()), default=0)


def _names(spark: SparkSession, folder: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def publish(spark: SparkSession, store: str, version: int) -> None:
    """Make a version the current one: its marker is written aside and moved into place, which readers see whole or not at all.

    Fails where another ingest has published that version meanwhile."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    mark, aside = path(f"{store}/versions/{version}"), path(f"{store}/versions/.{version}-{uuid.uuid4().hex}")
    files = mark.getFileSystem(spark._jsc.hadoopConfiguration())
    files.create(aside).close()
    if files.exists(mark) or not files.rename(aside, mark):
        files.delete(aside, False)
        raise RuntimeError(f"version {version} of {store} is there already")


def stored_usage(spark: SparkSession, store: str) -> DataFrame:
    return _stored(spark, store, "usage", f"{USAGE}, usage_date date")


def stored_manifest(spark: SparkSession, store: str) -> DataFrame:
    return _stored(spark, store, "manifest", MANIFEST)


def _stored(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    """What the current version holds: rows that came no later, and went no earlier."""
    now = current(spark, store)
    rows = stored_table(spark, f"{store}/{table}", f"{schema}, version int")
    gone = stored_table(spark, f"{store}/rebuilt", "version int, provider string").filter(F.col("version") <= now)
    last = {r["provider"]: r["v"] for r in gone.groupBy("provider").agg(F.max("version").alias("v")).collect()}  # a row a provider
    kept = F.col("version") <= now
    for provider, version in last.items():
        kept = kept & ((F.col("provider") != provider) | (F.col("version") >= version))
    return rows.filter(kept).drop("version")


def ingest(spark: SparkSession, roots: dict[str, str], store: str, rebuild: bool = False, glob: str = "*.jsonl") -> DataFrame:
    """Read changed logs of each provider into ``store``; returns the reports.

    Files are listed first, and only changed ones are read, grown ones from where they were left.  Usage and manifest are written
    into partitions of a new version, and a marker then makes both visible at once: readers (``stored_usage``, ``stored_manifest``) and later
    runs never see a part of a run, and a run that stopped half way leaves nothing that counts.  A rebuild reads everything; its
    version also says that what the provider had before is gone, which is then deleted.
    """
    reports = None
    for provider, root in roots.items():
        version = current(spark, store) + 1
        # what a run that stopped has left under this number
        for table in ("usage", "manifest", "rebuilt"):
            delete(spark, f"{store}/{table}/version={version}")
        log = upsert_manifest(stored_manifest(spark, store).limit(0), stored_manifest(spark, store)).filter(F.col("provider") == provider)
        found = listing(spark, root, glob)
        due = changed(found, log.limit(0) if rebuild else log, provider)
        raw, placed = places(file_columns(due), root, glob)
        placed = placed.persist()
        files = opened(due.columns, placed)
        parsed = PARSERS[provider](placed_lines(raw, placed)).filter("state != 'skipped'").persist()
        records = kept_records(parsed, provider)
        if invalid_records(parsed.filter("state = 'kept'")).count():  # else none of the records is
            validate(records)
        stored = stored_usage(spark, store).filter(F.col("provider") == provider)
        fresh = new_records(records, stored.limit(0) if rebuild else stored).withColumn("usage_date", F.to_date("timestamp"))
        # days are dealt to tasks by their size, so that there is no file for each task and day
        fresh.hint("rebalance", "usage_date").write.partitionBy("provider", "usage_date").parquet(f"{store}/usage/version={version}")
        written = stored_table(spark, f"{store}/usage/version={version}", f"{USAGE}, usage_date date")
        now = spark.range(1).select(F.current_timestamp()).first()[0]
        done = consumed(parsed, files.filter("value is not null")).select(F.lit(provider).alias("provider"), "path", "size", "mtime", "consumed",
            F.lit(now).alias("ingested_at"))
        before = log.agg(F.max("ingested_at")).first()[0]
        last = F.when((F.col("processed") > 0), F.lit(now)).otherwise(F.lit(before).cast("timestamp"))
        report = spark.createDataFrame(ingest_report(provider, found, files, parsed, written, last).collect(), REPORT)
        done.write.partitionBy("provider").parquet(f"{store}/manifest/version={version}")
        if rebuild:
            spark.createDataFrame([(provider,)], "provider string").write.parquet(f"{store}/rebuilt/version={version}")
        publish(spark, store, version)
        if rebuild:
            compact(spark, store)
        for df in (placed, parsed):
            df.unpersist()
        reports = report if reports is None else reports.unionByName(report)
    return reports


def compact(spark: SparkSession, store: str) -> None:
    """Delete what the current version does not see any more: what providers had before they were rebuilt."""
    now = current(spark, store)
    gone = stored_table(spark, f"{store}/rebuilt", "version int, provider string").filter(F.col("version") <= now)
    for r in gone.groupBy("provider").agg(F.max("version").alias("v")).collect():  # a row a provider
        for table in ("usage", "manifest"):
            for name in _names(spark, f"{store}/{table}"):
                if name.startswith("version=") and int(name[8:]) < r["v"]:
                    delete(spark, f"{store}/{table}/{name}/provider={r['provider']}")
