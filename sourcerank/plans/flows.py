"""Queries: file scans and sinks, and streaming jobs run over the tables' files.

Files are written to a fresh folder under the cluster's shared checkpoint
location and read back by the operator under test.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import assemble, metrics
from ..session import ensure_checkpoint_dir
from ..sources import readers, sinks
from ..streaming import jobs
from . import frames as fr
from .catalog import query
from .retrieval import KS, METRICS, judged_by_function, rounded

D = f"WITH docs AS ({fr.DOCS_SQL})"


def scratch(t) -> str:
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/files-{uuid4().hex}"


@query("jsonl_strict_scan", f"{D} SELECT uid, md5(text) AS digest, func, role, CAST(constant AS INTEGER) AS constant, hop_depth, source FROM docs")
def jsonl_strict_scan(t):
    path = scratch(t)
    sinks.jsonl(fr.docs(t), path)
    rows = readers.strict_jsonl(t.spark, path, readers.DOCUMENT)
    return rows.select("uid", F.md5("text").alias("digest"), "func", "role", "constant", "hop_depth", "source")


PROPS = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("text", T.StringType())])


def event_lines(t) -> str:
    """Event properties as JSON lines, some broken, some blank."""
    path = scratch(t)
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("oops "), "props")).when(F.col("event_type") == "view", "  ").otherwise(F.col("props"))
    t.events.select(line.alias("value")).write.text(path)
    return path


GOOD = "event_type NOT IN ('error', 'view')"


@query("jsonl_lenient_records", f"SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events WHERE {GOOD} GROUP BY 1")
def jsonl_lenient_records(t):
    good, _ = readers.lenient_jsonl(t.spark, event_lines(t), PROPS)
    return good.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("jsonl_rejected_lines", "SELECT 'oops ' || props AS line, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def jsonl_rejected_lines(t):
    _, bad = readers.lenient_jsonl(t.spark, event_lines(t), PROPS)
    return bad.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jsonl_bad_line_as_text",
    f"SELECT coalesce(CAST(k AS VARCHAR), '') AS k, coalesce(text, '') AS text, count(*) AS n FROM (SELECT CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k, CASE WHEN event_type = 'error' THEN 'oops ' || props END AS text FROM events WHERE event_type <> 'view') GROUP BY ALL",
)
def jsonl_bad_line_as_text(t):
    rows = readers.jsonl_or_text(t.spark, event_lines(t), PROPS)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select(blank("k"), blank("text")).groupBy("k", "text").agg(F.count(F.lit(1)).alias("n"))


@query("numbered_lines", "SELECT count(*) AS n, count(*) AS n_positions FROM events WHERE event_type <> 'view'")
def numbered_lines(t):
    rows = readers.lines(t.spark, event_lines(t))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file", "ordinal").alias("n_positions"))


# Lines of eight files by doc_id: a record, then a blank line after every fifth and a bad one after every seventh.
LINES_SQL = """SELECT doc_id, doc_id % 8 AS part, unnest(CASE WHEN doc_id % 5 = 0 THEN [0, 1] WHEN doc_id % 7 = 0 THEN [0, 2] ELSE [0] END) AS kind FROM documents"""
PLACED_SQL = f"SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, kind) AS line_no FROM ({LINES_SQL})"


def written_lines(t) -> str:
    """JSON lines of all documents in eight ordered files, with blank and bad lines among them."""
    path = scratch(t)
    record = F.to_json(F.struct("doc_id", F.md5("text").alias("digest"), F.repeat(F.lit("é"), F.pmod("doc_id", F.lit(9)).cast("int")).alias("pad")))
    kinds = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).when(F.col("doc_id") % 7 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    rows = t.documents.select("doc_id", (F.col("doc_id") % 8).alias("part"), record.alias("record"), F.explode(kinds).alias("kind"))
    value = F.when(F.col("kind") == 0, F.col("record")).when(F.col("kind") == 1, "  ").otherwise(F.concat(F.lit("{bad "), F.col("doc_id").cast("string")))
    lines = rows.select("part", "doc_id", "kind", value.alias("value")).repartition("part").sortWithinPartitions("part", "doc_id", "kind")
    lines.select("part", "value").write.partitionBy("part").text(path)
    return path


NUMBERED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("pad", T.StringType())])


@query(
    "records_by_line_number",
    f"SELECT l.doc_id, md5(d.text) AS digest, l.part, l.line_no FROM ({PLACED_SQL}) l JOIN documents d ON d.doc_id = l.doc_id WHERE kind = 0",
)
def records_by_line_number(t):
    """Records with the number of their line, read in splits far smaller than a file."""
    good, _ = readers.numbered_jsonl(t.spark, written_lines(t), NUMBERED, split_bytes=4096, pattern="part-*")
    return good.select("doc_id", "digest", part_of("file"), "line_no")


@query("rejects_by_line_number", f"SELECT '{{bad ' || doc_id AS line, part, line_no FROM ({PLACED_SQL}) WHERE kind = 2")
def rejects_by_line_number(t):
    _, bad = readers.numbered_jsonl(t.spark, written_lines(t), NUMBERED, split_bytes=4096, pattern="part-*")
    return bad.select("line", part_of("file"), "line_no")


def part_of(file):
    return F.regexp_extract(file, r"part=(\d+)", 1).cast("bigint").alias("part")


@query(
    "plain_text_scan",
    "SELECT md5(trim(line)) AS digest, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1",
)
def plain_text_scan(t):
    path = scratch(t)
    t.documents.select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return readers.plain_text(t.spark, path).groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])


@query("json_array_scan", "SELECT c_custkey, c_name FROM customer")
def json_array_scan(t):
    path = scratch(t)
    # Arrays of at most 1,000 records, one file each.
    arrays = t.customer.groupBy(F.floor(F.col("c_custkey") / 1000).alias("g")).agg(
        F.to_json(F.collect_list(F.struct("c_custkey", "c_name"))).alias("value")
    )
    arrays.repartition("g").write.partitionBy("g").text(path)
    return readers.json_array(t.spark, path, CUSTOMER).select("c_custkey", "c_name")


@query("compressed_jsonl_scan", "SELECT c_custkey, c_name FROM customer")
def compressed_jsonl_scan(t):
    path = scratch(t)
    t.customer.select("c_custkey", "c_name").write.option("compression", "gzip").json(path)
    return readers.strict_jsonl(t.spark, path, CUSTOMER)


@query("zstandard_jsonl_scan", "SELECT c_custkey, c_name FROM customer")
def zstandard_jsonl_scan(t):
    """Several .zst files of JSON lines, written by the tasks that hold the rows."""
    path = scratch(t)
    sinks.zstandard_jsonl(t.customer.select("c_custkey", "c_name").repartition(4, "c_custkey"), path)
    return readers.strict_jsonl(t.spark, path, CUSTOMER)


@query(
    "pooled_file_sample",
    """SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY md5('11:' || md5('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}'))) AS r FROM customer) WHERE r <= 100""",
)
def pooled_file_sample(t):
    base = scratch(t)
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    first = F.col("c_mktsegment") == "BUILDING"
    rows.filter(first).drop("c_mktsegment").write.json(f"{base}/a")
    rows.filter(~first).drop("c_mktsegment").write.json(f"{base}/b")
    return readers.pooled_sample(t.spark, [f"{base}/a", f"{base}/b"], CUSTOMER, 100, seed=11)


ENDING_RS = "conversations customer documents embeddings events orders pages supplier".split()


def tables_by_pattern(t) -> list[str]:
    """Names of the tables that a pattern finds, be they one file or a folder of files."""
    found = readers.discover(t.spark, t.folder, "*[rs].parquet", exclude="l*.parquet").select("name")
    parent = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("name")
    folders = readers.discover(t.spark, t.folder, "*.parquet", recursive=True).select(parent).filter(r"name rlike '[rs][.]parquet$' and name not like 'l%'")
    return [r["name"] for r in found.union(folders).distinct().orderBy("name").collect()]  # one row for each table


def over_tables(t, measure):
    parts = [measure(t.spark.read.parquet(f"{t.folder}/{n}")).select(F.lit(n).alias("name"), "*") for n in tables_by_pattern(t)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "discovered_files",
    " UNION ALL ".join(f"SELECT '{n}.parquet' AS name, count(*) AS n, (SELECT count(*) FROM (DESCRIBE {n})) AS n_columns FROM {n}" for n in ENDING_RS),
)
def discovered_files(t):
    """Files by pattern, read by the names found: rows and columns of each."""
    return over_tables(t, lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.lit(len(df.columns)).cast("bigint").alias("n_columns")))


@query("discovered_files_all", " UNION ALL ".join(f"SELECT '{n}.parquet' AS name, count(*) AS n FROM {n}" for n in ENDING_RS))
def discovered_files_all(t):
    """Rows of every table that the pattern finds."""
    return over_tables(t, lambda df: df.agg(F.count(F.lit(1)).alias("n")))


@query("hop_depth_folders", f"{D} SELECT hop_depth, count(*) AS n FROM docs WHERE role IS NOT NULL GROUP BY hop_depth")
def hop_depth_folders(t):
    path = scratch(t)
    rows = fr.docs(t).withColumn("hop_depth", F.when(F.col("role").isNotNull(), F.col("hop_depth")))
    sinks.by_hop_depth(rows, path)
    return t.spark.read.json(path).groupBy("hop_depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cumulative_folders",
    "SELECT CAST(n AS INTEGER) AS n, count(*) AS docs FROM (SELECT doc_id % 3 + 1 AS r FROM documents), (SELECT unnest([1,2,3]) AS n) WHERE r <= n GROUP BY n",
)
def cumulative_folders(t):
    path = scratch(t)
    rows = t.documents.select("doc_id", (F.col("doc_id") % 3 + 1).cast("int").alias("repeat"))
    sinks.cumulative_folders(assemble.cumulative(rows, 3), path)
    return t.spark.read.json(path).groupBy("n").agg(F.count(F.lit(1)).alias("docs"))


@query("per_query_records", f"{fr.RETRIEVAL} SELECT query_uid, uid, score FROM scores")
def per_query_records(t):
    path = scratch(t)
    sinks.jsonl(sinks.per_query_records(fr.scores(t), fr.queries(t), t.documents.count(), part_size=250), path)
    records = readers.strict_jsonl(t.spark, path, readers.PER_QUERY)
    return readers.per_query_scores(records, "bm25").drop("method")


LONG = " UNION ALL ".join(
    f"SELECT 'bm25' AS method, 'r1' AS run, '{m}' AS metric, k, func, round({m}, 6) AS value FROM perf"
    for m in ["recall", "recall_var", "precision", "precision_var", "success", "success_var", "constant_gt", "identity_gt", "distractor", "other"]
)


@query("metrics_long_table", f"{METRICS} {LONG}")
def metrics_long_table(t):
    judged, sizes = judged_by_function(t)
    out = metrics.metrics_long(metrics.per_function(metrics.per_query(judged, sizes, KS)), "bm25", "r1")
    return rounded(out, ["method", "run", "metric", "k", "func"])


@query(
    "metrics_records",
    f"{METRICS} SELECT k, count(*) AS n_entries, round(sum(recall), 5) AS recall_sum, round(avg(recall), 6) AS recall_overall_avg FROM perf GROUP BY k",
)
def metrics_records(t):
    judged, sizes = judged_by_function(t)
    by_func = metrics.per_function(metrics.per_query(judged, sizes, KS))
    path = scratch(t)
    sinks.jsonl(sinks.metrics_records(by_func, metrics.overall(by_func)), path)
    schema = "k int, recall_per_function map<string,double>, recall_overall_avg double"
    values = F.map_values("recall_per_function")
    return t.spark.read.schema(schema).json(path).select(
        "k",
        F.size(values).cast("bigint").alias("n_entries"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 5).alias("recall_sum"),
        F.round("recall_overall_avg", 6).alias("recall_overall_avg"),
    )


# --- streams -----------------------------------------------------------------------
def stream(t, table):
    schema = getattr(t, table).schema
    return jobs.parquet_stream(t.spark, t.folder, schema, glob=f"{table}.parquet")


def event_stream(t):
    """Events with ``ts`` as an instant: the file stores a zone-less UTC time."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return stream(t, "events").withColumn("ts", F.timestamp_micros(micros))


def finished(handle, t, out):
    handle.awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_completed_uids", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS uid FROM events")
def stream_completed_uids(t):
    base = scratch(t)
    rows = event_stream(t).select(F.col("user_id").cast("string").alias("uid"), "ts")
    done = jobs.completed_scores(rows, delay="366 days")  # longer than a run, so none is named twice
    return finished(jobs.start(done, f"{base}/out", f"{base}/ckpt"), t, f"{base}/out").select("uid")


@query(
    "stream_checkpoint_evaluations",
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS checkpoint, ts FROM events WHERE event_type = 'click'), e AS (SELECT CAST(user_id AS VARCHAR) AS checkpoint, ts, value FROM events WHERE event_type = 'purchase')
SELECT s.checkpoint, epoch_us(s.ts) AS saved_at, epoch_us(e.ts) AS evaluated_at, round(value, 6) AS score FROM s LEFT JOIN e ON e.checkpoint = s.checkpoint AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 6 HOUR""",
)
def stream_checkpoint_evaluations(t):
    """Clicks as saved checkpoints, purchases of the same user within six hours as their evaluations."""
    base = scratch(t)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    log = t.events.select(F.col("user_id").cast("string").alias("checkpoint"), F.timestamp_micros(micros).alias("at"), "event_type", "value")
    schemas = {"saved": "checkpoint string, saved_at timestamp", "evaluated": "checkpoint string, evaluated_at timestamp, score double"}

    def add(rows, days_later):
        """Rows to both streams; a marker of each moves the time on."""
        moved = rows.withColumn("at", F.col("at") + F.make_dt_interval(F.lit(days_later)))
        name = F.col("checkpoint") if not days_later else F.concat(F.lit("marker "), F.col("event_type"))
        moved.filter("event_type = 'click'").select(name.alias("checkpoint"), F.col("at").alias("saved_at")).write.mode("append").parquet(f"{base}/saved")
        moved.filter("event_type = 'purchase'").select(name.alias("checkpoint"), F.col("at").alias("evaluated_at"), F.col("value").alias("score")).write.mode("append").parquet(f"{base}/evaluated")

    add(log, 0)
    last = log.groupBy("event_type").agg(F.max("at").alias("at"), F.lit("").alias("checkpoint"), F.lit(0.0).alias("value"))
    for days in (0, 30, 60):
        if days:
            add(last, days)
        saved, evaluated = (jobs.parquet_stream(t.spark, f"{base}/{n}", T._parse_datatype_string(c)) for n, c in schemas.items())
        joined = jobs.checkpoint_evaluations(saved, evaluated, "6 HOURS", "1 hour")
        jobs.start(joined, f"{base}/out", f"{base}/ckpt").awaitTermination()
    found = t.spark.read.parquet(f"{base}/out").filter("checkpoint NOT LIKE 'marker%'")
    return found.select("checkpoint", F.unix_micros("saved_at").alias("saved_at"), F.unix_micros("evaluated_at").alias("evaluated_at"), F.round("score", 6).alias("score"))


@query(
    "stream_checkpoint_accuracy",
    f"SELECT step, input AS hop_depth, count(*) AS n, round(avg(CAST(is_correct AS INT)), 6) AS accuracy FROM ({fr.EVAL_SQL}) GROUP BY ALL",
)
def stream_checkpoint_accuracy(t):
    base = scratch(t)
    rows = fr.eval_columns(stream(t, "lineitem")).withColumn("hop_depth", F.col("input"))
    jobs.start_updates(jobs.accuracy_by_checkpoint(rows), f"{base}/out", f"{base}/ckpt").awaitTermination()
    return rounded(jobs.latest(t.spark, f"{base}/out", ["step", "hop_depth"]), ["step", "hop_depth", "n"])


def event_log(rows):
    return rows.select("ts", F.col("event_type").alias("series"), "value")


def stamped(df):
    """Window starts as seconds, and rounded means."""
    return df.select(F.col("start").cast("bigint").alias("start"), "series", "n", F.round("value", 6).alias("value"))


@query(
    "stream_tumbling_windows",
    """WITH w AS (SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, event_type AS series, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY ALL)
SELECT * FROM w WHERE start + 21600 <= (SELECT epoch(max(ts)) - 3600 FROM events)""",
)
def stream_tumbling_windows(t):
    base = scratch(t)
    agg = jobs.windowed_series(event_log(event_stream(t)), "6 hours", "1 hour")
    return stamped(finished(jobs.start(agg, f"{base}/out", f"{base}/ckpt"), t, f"{base}/out"))


@query(
    "stream_sliding_windows",
    """WITH x AS (SELECT ts, event_type, value, unnest([0, 1]) AS s FROM events), w AS (SELECT CAST(floor(epoch(ts) / 43200) * 43200 - s * 43200 AS BIGINT) AS start, event_type AS series, count(*) AS n, round(avg(value), 6) AS value FROM x GROUP BY ALL)
SELECT * FROM w WHERE start + 86400 <= (SELECT epoch(max(ts)) - 3600 FROM events)""",
)
def stream_sliding_windows(t):
    base = scratch(t)
    agg = jobs.windowed_series(event_log(event_stream(t)), "24 hours", "1 hour", slide="12 hours")
    return stamped(finished(jobs.start(agg, f"{base}/out", f"{base}/ckpt"), t, f"{base}/out"))


@query(
    "stream_session_windows",
    """WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) <= 1200 THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY ts) AS sid FROM g), w AS (SELECT min(ts) AS a, max(ts) AS z, event_type AS series, count(*) AS n, round(avg(value), 6) AS value FROM s GROUP BY event_type, sid)
SELECT CAST(floor(epoch(a)) AS BIGINT) AS start, series, n, value FROM w WHERE epoch(z) + 1200 <= (SELECT epoch(max(ts)) - 3600 FROM events)""",
)
def stream_session_windows(t):
    base = scratch(t)
    agg = jobs.session_series(event_log(event_stream(t)), "20 minutes", "1 hour")
    return stamped(finished(jobs.start(agg, f"{base}/out", f"{base}/ckpt"), t, f"{base}/out"))


@query(
    "metric_series_long",
    "SELECT CAST(o_orderkey AS VARCHAR) AS step, 'loss' AS series, round(o_totalprice, 6) AS value FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'loss_d1', o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
def metric_series_long(t):
    log = t.orders.select(
        F.col("o_orderkey").cast("string").alias("step"), F.col("o_totalprice").alias("loss"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("loss_d1")
    )
    return rounded(jobs.metric_long(log), ["step", "series"])


@query(
    "stream_progress",
    """SELECT count(DISTINCT user_id) AS completed, CAST(1000000 AS BIGINT) AS total, round(count(DISTINCT user_id) / 1000000, 9) AS fraction,
 round(count(DISTINCT user_id) / (epoch(max(ts)) - epoch(min(ts))), 9) AS rate,
 round((1000000 - count(DISTINCT user_id)) * (epoch(max(ts)) - epoch(min(ts))) / count(DISTINCT user_id), 3) AS eta FROM events""",
)
def stream_progress(t):
    base = scratch(t)
    rows = event_stream(t).select(F.col("user_id").cast("string").alias("uid"), "ts")
    jobs.start_progress(rows, 1000000, base, f"{base}/ckpt").awaitTermination()
    out = t.spark.read.schema("completed bigint, total bigint, fraction double, rate double, eta double").json(f"{base}/progress")
    return rounded(out, ["completed", "total", "eta"], 9).withColumn("eta", F.round("eta", 3))
