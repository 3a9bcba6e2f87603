"""Queries and oracles: sources (A), scalar functions (B), streaming (I).

Raw lines are built from the derived rows by concatenation; the oracle of a parser is the
original columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import scalars
from sigloom.operators import rules
from sigloom.plans import behaviour, detections
from sigloom.plans.behaviour import SEC, process_report
from sigloom.plans.detections import DAY, _keyed, signals
from sigloom.plans.fixtures import derived, scratch, sec_events
from sigloom.sources import parsers, sinks
from sigloom.streaming import jobs
from sigloom.streaming.alerts import alert_states


def _iso():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def json_line():
    body = F.to_json(F.struct(_iso().alias("timestamp"), "host", "event_type", "process_name", "pid", "file_path", "operation", "dest_ip", "dest_port", "command_line"))
    return F.when(F.col("k") % 50 == 7, F.lit("  ")).when(F.col("k") % 50 == 9, F.lit("{broken")).otherwise(body)


def json_lines(events: DataFrame) -> DataFrame:
    return events.select("event_id", json_line().alias("value"))


def src_jsonl(spark, sf_dir):
    rows = parsers.jsonl(json_lines(sec_events(spark, sf_dir)))
    return rows.filter("NOT malformed").select("host", "event_type", "process_name", "pid", "file_path", "operation", "dest_ip", "command_line", F.unix_micros("ts").alias("us"))


def rfc5424_line():
    return F.concat(F.lit("<"), (F.col("k") + 30).cast("string"), F.lit(">1 "), _iso(), F.lit("Z "), F.col("host"), F.lit(" app "), F.col("pid").cast("string"), F.lit(' - [x@1 a="b"][y@2 c="v'), F.col("k").cast("string"), F.lit('\\]" d="say \\"] it\\""] '), F.to_json(F.struct("event_id", "process_name")))


def _rfc5424(events: DataFrame) -> DataFrame:
    return events.select("event_id", rfc5424_line().alias("value"))


def src_rfc5424(spark, sf_dir):
    p = parsers.rfc5424(F.col("value"))
    rows = _rfc5424(sec_events(spark, sf_dir)).select("event_id", p.alias("p"))
    second = F.get(parsers.structured_data(F.col("p.structured")), 1)
    params = F.array_join(F.transform(second["params"], lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",")
    return rows.select("event_id", "p.priority", "p.host", second["id"].alias("sd_id"), params.alias("sd_params"), F.col("p.procid").cast("long").alias("pid"), F.get_json_object("p.message", "$.process_name").alias("process_name"), F.unix_micros(F.col("p.time").try_cast("timestamp")).alias("us"))


def rfc3164_line():
    return F.concat(F.lit("<134>"), F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" "), F.col("host"), F.lit(" proc["), F.col("pid").cast("string"), F.lit("]: hello: "), F.col("process_name"))


def _rfc3164(events: DataFrame) -> DataFrame:
    return events.select("event_id", rfc3164_line().alias("value"))


def src_rfc3164(spark, sf_dir):
    rows = _rfc3164(sec_events(spark, sf_dir)).select("event_id", parsers.rfc3164(F.col("value"), 2024).alias("p"))
    return rows.select("event_id", "p.host", "p.pid", F.col("p.tag").alias("tag"), "p.message", F.unix_seconds("p.ts").alias("at"))


def cef_line():
    return F.concat(F.lit("<134>Jan 1 00:00:00 h CEF:0|Ven\\|dor|Prod|1.0|"), F.col("k").cast("string"), F.lit("|Name of|5|shost="), F.col("host"), F.lit(" sproc="), F.col("process_name"), F.lit(" cs1="), F.replace(F.coalesce("command_line", F.lit("none at all")), F.lit("="), F.lit("\\=")), F.lit(" duser=bob dpt="), F.coalesce(F.col("dest_port").cast("string"), F.lit("0")))


def _cef(events: DataFrame) -> DataFrame:
    return events.select("event_id", cef_line().alias("value"))


def src_cef(spark, sf_dir):
    rows = _cef(sec_events(spark, sf_dir)).select("event_id", parsers.cef(F.col("value")).alias("p"))
    return rows.select("event_id", "p.vendor", "p.class_id", "p.name", "p.severity", "p.host", "p.process_name", "p.command_line", "p.user", F.col("p.dest_port").cast("int").alias("dest_port"))


def _windows(events: DataFrame) -> DataFrame:
    nx = F.to_json(F.struct(F.col("host").alias("Hostname"), F.col("event_code").alias("EventID"), F.struct(F.col("image").alias("NewProcessName"), F.col("command_line").alias("CommandLine"), F.col("username").alias("SubjectUserName")).alias("EventData")))
    wl = F.to_json(F.struct(F.struct(F.col("host").alias("hostname")).alias("host"), F.struct(F.col("event_code").alias("code")).alias("event"), F.struct(F.struct(F.col("image").alias("NewProcessName"), F.col("command_line").alias("CommandLine")).alias("event_data"), F.struct(F.col("username").alias("name")).alias("user")).alias("winlog")))
    return events.filter("event_type = 'process'").select("event_id", F.when(F.col("k") % 2 == 0, nx).otherwise(wl).alias("value"))


def src_windows_json(spark, sf_dir):
    rows = _windows(sec_events(spark, sf_dir)).select("event_id", parsers.windows_json(F.col("value")).alias("p"))
    return rows.select("event_id", "p.host", "p.event_code", "p.image", "p.command_line", "p.user")


def mixed_lines(events: DataFrame) -> DataFrame:
    """One line an event, its format by k % 6; the last two are blank and unreadable."""
    k = F.col("k") % 6
    line = F.when(k == 0, json_line()).when(k == 1, cef_line()).when(k == 2, rfc5424_line()).when(k == 3, rfc3164_line()).when(k == 4, F.lit("   ")).otherwise(F.lit("plain words"))
    return events.filter("NOT (k % 6 = 0 AND k % 50 IN (7, 9))").select("event_id", line.alias("value"))


def src_autodetect(spark, sf_dir):
    return parsers.autodetect(mixed_lines(sec_events(spark, sf_dir))).groupBy("fmt", "host", "accepted").agg(F.count("*").alias("n"))


def syslog_priority(spark, sf_dir):
    rows = _rfc5424(sec_events(spark, sf_dir)).select("event_id", parsers.rfc5424(F.col("value"))["priority"].alias("priority"))
    return rows.select("event_id", parsers.priority_parts(F.col("priority")).alias("p")).select("event_id", "p.*")


def _auditd_lines(events: DataFrame) -> DataFrame:
    rows = events.filter("event_type = 'process'")
    stamp = F.concat(F.lit(" msg=audit(17040"), F.lpad(F.col("k").cast("string"), 5, "0"), F.lit(".5:"), F.col("seq").cast("string"), F.lit("): "))
    syscall = F.concat(F.lit("type=SYSCALL"), stamp, F.lit("arch=c000003e syscall=59 uid="), F.col("u").cast("string"), F.lit(' auid=1000 exe="/usr/bin/'), F.col("u").cast("string"), F.lit('"'))
    execve = F.concat(F.lit("type=EXECVE"), stamp, F.lit('argc=2 a0="run" a1='), F.hex(F.col("command_line")))
    path = F.concat(F.lit("type=PATH"), stamp, F.lit('item=0 name="/p/'), F.col("k").cast("string"), F.lit('" inode=1'))
    return rows.select("host", F.explode(F.array(syscall, execve, path)).alias("value"))


def src_auditd(spark, sf_dir):
    return parsers.auditd(_auditd_lines(sec_events(spark, sf_dir))).select("host", "serial", "syscall", "uid", "exe", "command", "path")


def src_auth(spark, sf_dir):
    k = F.col("k") % 4
    line = F.when(k == 0, F.concat(F.lit("sshd[1]: Failed password for invalid user "), F.col("username"), F.lit(" from "), F.col("src_ip"), F.lit(" port 22 ssh2")))
    line = line.when(k == 1, F.concat(F.lit("sshd[1]: Accepted publickey for "), F.col("username"), F.lit(" from "), F.col("src_ip"), F.lit(" port 22")))
    line = line.when(k == 2, F.concat(F.lit("sudo:  "), F.col("username"), F.lit(" : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/bash -i")))
    line = line.otherwise(F.concat(F.lit("pam_unix(sshd:auth): authentication failure; logname= uid=0 user="), F.col("username")))
    rows = sec_events(spark, sf_dir).filter("event_type = 'auth'").select("event_id", line.alias("value"))
    return rows.select("event_id", parsers.auth(F.col("value")).alias("p")).select("event_id", "p.*")


def src_csv(spark, sf_dir):
    """Network rows written as CSV with a header, quotes and commas in them, and read back."""
    rows = sec_events(spark, sf_dir).filter("event_type = 'network'").select("event_id", "host", "dest_ip", F.col("dest_port").cast("int").alias("dest_port"), F.concat(F.lit('a "note", of '), F.col("k").cast("string")).alias("note"))
    path = scratch(spark)
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return parsers.read_csv(spark, path, "event_id string, host string, dest_ip string, dest_port int, note string")


def src_csv_ecs_snort(spark, sf_dir):
    rows = sec_events(spark, sf_dir).filter("event_type = 'network'")
    ecs = F.to_json(F.struct(F.struct(F.col("host").alias("name")).alias("host"), F.struct(F.col("dest_ip").alias("ip"), F.col("dest_port").alias("port")).alias("destination")))
    snort = F.concat(F.lit("01/01-00:00:00.000000  [**] [1:"), F.col("k").cast("string"), F.lit(":1] Bad thing [**] [Classification: Misc] [Priority: 2] {TCP} 10.0.0.1:5555 -> "), F.col("host"), F.lit(":"), F.col("dest_port").cast("string"))
    parsed = rows.select("event_id", parsers.ecs(ecs).alias("e"), parsers.snort(snort).alias("s"))
    return parsed.select("event_id", F.col("e.host").alias("host"), F.col("e.dest_ip").alias("dest_ip"), F.col("e.dest_port").cast("int").alias("dest_port"), "s.sid", "s.message", F.col("s.dest_ip").alias("snort_dest"), F.col("s.dest_port").alias("snort_port"))


def _sourced(events: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("auditd", "evtx", "syslog", "json", "pcap", "snort", "sshd")])
    return events.withColumn("source", F.element_at(names, (F.col("k") % 7 + 1).cast("int")))


def src_profile_gate(spark, sf_dir):
    return parsers.profile_gate(_sourced(sec_events(spark, sf_dir)), "siem_host").groupBy("source", "refused").agg(F.count("*").alias("n"))


def sink_artifacts(spark, sf_dir):
    """What is read back from the written artifacts: rows of each kind."""
    events, found = sec_events(spark, sf_dir), signals(spark, sf_dir)
    alerts = found.filter("score >= 0.8").withColumn("alert_id", F.concat(F.lit("A-"), F.col("event_id"))).select("alert_id", "event_id", "score")
    lines = alerts.join(events.select("event_id", "us"), "event_id").withColumn("place", F.lit(1))
    path = scratch(spark)
    sinks.write_artifacts(path, events.select("event_id", "host", "us"), found, alerts, lines)
    count = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), "n")
    out = count("normalized_events", "event_id string")
    for name in ("signals", "alerts", "timelines"):
        out = out.unionByName(count(name, "event_id string"))
    return out


def sink_report(spark, sf_dir):
    return sinks.report(process_report(spark, sf_dir), burst_window_seconds=60, min_risk_score=0.15).select(F.get_json_object("value", "$.process.process_name").alias("process_name"), F.get_json_object("value", "$.process.pid").cast("long").alias("pid"), F.get_json_object("value", "$.burst_window_seconds").cast("int").alias("burst"))


def sink_report_document(spark, sf_dir):
    """The report as one document, read back: its parameters and its processes."""
    rows = process_report(spark, sf_dir).select("process_name", "pid", "risk_score")
    text = sinks.document(rows, burst_window_seconds=60, min_risk_score=0.15)
    kind = "burst_window_seconds int, min_risk_score double, suspicious_processes array<struct<process_name:string,pid:long,risk_score:double>>"
    return text.select(F.from_json("value", kind).alias("d")).select("d.burst_window_seconds", "d.min_risk_score", F.explode("d.suspicious_processes").alias("p")).select("burst_window_seconds", "min_risk_score", "p.*")


def normalize(spark, sf_dir):
    rows = parsers.jsonl(json_lines(sec_events(spark, sf_dir))).filter("NOT malformed").drop("malformed", "ts")
    rows = parsers.normalized(rows.withColumn("host", F.when(F.col("host") != "host-0", F.col("host"))), "default")
    return rows.select("event_id", F.unix_micros("event_time_utc").alias("us"), "event_type", F.col("host.hostname").alias("hostname"), F.col("process.name").alias("process_name"), F.col("process.pid").alias("pid"), F.col("file.operation").alias("operation"), F.col("network.dest_port").alias("dest_port"))


def event_type_coerce(spark, sf_dir):
    kind = F.when(F.col("k") % 5 == 0, F.lit("")).when(F.col("k") % 5 == 1, F.lit(None)).when(F.col("k") % 5 == 2, F.lit("registry")).otherwise(F.upper("event_type"))
    return sec_events(spark, sf_dir).select("event_id", scalars.event_type_coerced(kind).alias("kind"))


def stable_event_id(spark, sf_dir):
    """Ids of rows with nulls, nested fields and text beyond ASCII."""
    rows = sec_events(spark, sf_dir).select("event_id", "pid", "event_type", "operation", F.struct("username", F.concat(F.lit("höst-\U0001f5a5-"), F.col("k").cast("string")).alias("host")).alias("origin"))
    return rows.select("event_id", scalars.stable_event_id(scalars.row_json(rows.schema)).alias("id"))


def canonical_json(spark, sf_dir):
    """Two spellings of each row's JSON give one canonical text."""
    rows = sec_events(spark, sf_dir).select("event_id", F.to_json(F.struct("pid", "host")).alias("a"), F.concat(F.lit('{ "host" : "'), F.col("host"), F.lit('", "pid": '), F.col("pid").cast("string"), F.lit(" }")).alias("b"))
    return rows.select("event_id", scalars.canonical_json(F.col("a")).alias("json"), (scalars.canonical_json(F.col("a")) == scalars.canonical_json(F.col("b"))).alias("same"))


def process_key(spark, sf_dir):
    return _keyed(sec_events(spark, sf_dir)).select("event_id", "process_key", scalars.process_key(F.lit(""), F.lit(None), F.lit(None).cast("string")).alias("empty_key"))


def parse_to_utc(spark, sf_dir):
    text = F.when(F.col("k") % 4 == 0, _iso()).when(F.col("k") % 4 == 1, F.concat(_iso(), F.lit("+01:00"))).when(F.col("k") % 4 == 2, F.unix_seconds("ts").cast("string")).otherwise(F.lit("no time"))
    return sec_events(spark, sf_dir).select("event_id", F.unix_micros(scalars.parse_to_utc(text, F.timestamp_seconds(F.lit(0)))).alias("us"))


def path_parts(spark, sf_dir):
    p = F.col("file_path")
    return sec_events(spark, sf_dir).filter("event_type = 'file'").select("event_id", scalars.extension(p).alias("extension"), scalars.directory(p).alias("directory"), scalars.basename(p).alias("basename"))


def is_private_ip(spark, sf_dir):
    return sec_events(spark, sf_dir).filter("dest_ip IS NOT NULL").select("event_id", scalars.is_private_ip(F.when(F.col("u") == 0, F.lit("fe80::1%eth0")).otherwise(F.col("dest_ip"))).alias("private"))


def route_source(spark, sf_dir):
    return parsers.routed(_sourced(sec_events(spark, sf_dir))).groupBy("source", "route").agg(F.count("*").alias("n"))


def raw_lookup(spark, sf_dir):
    k, name = F.col("k"), F.concat(F.lit("task"), F.col("k").cast("string"))
    raw = F.when(k % 4 == 0, F.to_json(F.struct(name.alias("TaskName")))).when(k % 4 == 1, F.to_json(F.struct(F.struct(name.alias("TaskName")).alias("event_data")))).when(k % 4 == 2, F.to_json(F.struct(F.struct(name.alias("TaskName")).alias("EventData")))).otherwise(F.lit("not json"))
    return sec_events(spark, sf_dir).select("event_id", F.coalesce(parsers.task_name(raw), F.lit("unknown_task")).alias("task"))


def mutating_filter(spark, sf_dir):
    return sec_events(spark, sf_dir).filter(scalars.is_mutating(F.col("operation"), F.col("file_path"))).select("event_id", "operation")


def severity_bucket(spark, sf_dir):
    return sec_events(spark, sf_dir).select("event_id", scalars.severity(F.col("k") / 100).alias("severity"))


def score_100_json(spark, sf_dir):
    body = F.to_json(F.struct(F.round(F.col("score") * 100).cast("int").alias("score"), F.array("signal_type").alias("indicators"), scalars.severity(F.col("score")).alias("classification")))
    return signals(spark, sf_dir).select("event_id", "signal_type", body.alias("alert"))


def _stream(spark, sf_dir) -> DataFrame:
    """The derived rows as a stream over the events table."""
    return derived(jobs.read_events(spark, sf_dir))


def _ran(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    jobs.run_once(stream, f"{path}/out", f"{path}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def stream_ingest(spark, sf_dir):
    lines = _rfc5424(_stream(spark, sf_dir)).select("value")
    return _ran(jobs.ingest(lines)).groupBy("fmt", "host", "accepted").agg(F.count("*").alias("n"))


def stream_dedup(spark, sf_dir):
    rows = _stream(spark, sf_dir).select("event_id", "host", "ts")
    return _ran(jobs.dedup(rows.union(rows))).select("event_id", "host")


def stream_burst(spark, sf_dir):
    """Windows of 6 h every 3 h that the watermark has closed, on distinct (process, path, window) rows."""
    rows = _stream(spark, sf_dir).filter("event_type = 'file'").withColumn("path", F.translate("file_path", "\\", "/")).withColumn("mutating", scalars.is_mutating(F.col("operation"), F.col("file_path")))
    found = _ran(jobs.burst(rows, "6 hours", "3 hours"))
    return found.select(F.unix_micros("window.start").alias("start_us"), "process_name", "pid", "unique_files")


def stream_bruteforce(spark, sf_dir):
    rows = _stream(spark, sf_dir).filter("outcome = 'failure'").select("ts", "host", "src_ip", "event_id")
    return _ran(jobs.bruteforce(rows, 5, "24 hours", "12 hours")).select(F.unix_micros("window.start").alias("start_us"), "host", "src_ip", "n")


def stream_recon(spark, sf_dir):
    kind = F.when(F.col("command_line").contains("whoami"), "recon_identity").when(F.col("command_line").contains("net user"), "recon_enum")
    hits = _keyed(_stream(spark, sf_dir)).withColumn("kind", kind).filter("kind IS NOT NULL").select("ts", "host", "process_key", "us", "event_id", "kind")
    return _ran(jobs.recon(hits, DAY))


def stream_alerts(spark, sf_dir):
    """Signals of the stream, all of them twice, as alerts: each id comes out once."""
    rows = _stream(spark, sf_dir)
    found = rules.with_signal_id(rules.lotl_cmdline(rows, kept=("us",)).withColumn("signal_type", F.concat(F.lit("lotl."), F.col("rule_id"))))
    found = found.select("signal_id", "us", "event_id", "score")
    return _ran(alert_states(found.union(found))).select("signal_id", "event_id", "score")


HALF = 43_200_000_000  # half a day in microseconds
_K6 = "CASE WHEN k % 6 IN (0, 1, 2, 3) THEN host END"
_FMT = "CASE k % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'cef' WHEN 2 THEN 'rfc5424' WHEN 3 THEN 'rfc3164' ELSE 'raw' END"
_SOURCE = "['auditd', 'evtx', 'syslog', 'json', 'pcap', 'snort', 'sshd'][k % 7 + 1]"
_PK = "lower(process_name) || '|' || pid || '|' || lower(process_path)"
_PATH = "replace(file_path, chr(92), '/')"
# the canonical JSON of json_line()
_RAW = (
    "'{' || concat_ws(',', '\"command_line\":\"' || command_line || '\"', '\"dest_ip\":\"' || dest_ip || '\"', '\"dest_port\":' || dest_port, '\"event_type\":\"' || event_type || '\"', '\"file_path\":\"' || replace(file_path, chr(92), chr(92) || chr(92)) || '\"', "
    "'\"host\":\"' || host || '\"', '\"operation\":\"' || operation || '\"', '\"pid\":' || pid, '\"process_name\":\"' || process_name || '\"', '\"timestamp\":\"' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') || '\"') || '}'"
)
_LAST = f"split_part({_PATH}, '/', -1)"
_LOTL_ID = "SELECT 'sig-' || substr(sha256('lotl.LOTL-' || r || '|' || event_id || '|'), 1, 16) AS signal_id, event_id, CAST(score AS DOUBLE) AS score FROM sec JOIN (VALUES (0, '001', 0.92), (1, '002', 0.8), (2, '004', 0.82), (6, '006', 0.75)) v(m, r, score) ON k % 10 = m WHERE event_type = 'process'"

QUERIES = {
    f.__name__: f
    for f in (
        src_jsonl, src_rfc5424, src_rfc3164, src_cef, src_windows_json, src_autodetect, syslog_priority, src_auditd, src_auth, src_csv, src_csv_ecs_snort, src_profile_gate, sink_artifacts, sink_report, sink_report_document,
        normalize, event_type_coerce, stable_event_id, canonical_json, process_key, parse_to_utc, path_parts, is_private_ip, route_source, raw_lookup, mutating_filter, severity_bucket, score_100_json,
        stream_ingest, stream_dedup, stream_burst, stream_bruteforce, stream_recon, stream_alerts,
    )
}
ORACLES = {
    "src_jsonl": f"{SEC} SELECT host, event_type, process_name, pid, file_path, operation, dest_ip, command_line, us FROM sec WHERE k % 50 NOT IN (7, 9)",
    "src_rfc5424": f"{SEC} SELECT event_id, k + 30 AS priority, host, 'y@2' AS sd_id, 'c=v' || k || '],d=say \"] it\"' AS sd_params, pid, process_name, us FROM sec",
    "src_rfc3164": f"{SEC} SELECT event_id, host, pid, 'proc' AS tag, 'hello: ' || process_name AS message, us // 1000000 AS \"at\" FROM sec",
    "src_cef": f"{SEC} SELECT event_id, 'Ven|dor' AS vendor, CAST(k AS VARCHAR) AS class_id, 'Name of' AS name, 5 AS severity, host, process_name, coalesce(command_line, 'none at all') AS command_line, 'bob' AS \"user\", coalesce(dest_port, 0) AS dest_port FROM sec",
    "src_windows_json": f"{SEC} SELECT event_id, host, event_code, image, command_line, username AS \"user\" FROM sec WHERE event_type = 'process'",
    "src_autodetect": f"{SEC} SELECT {_FMT} AS fmt, {_K6} AS host, k % 6 < 4 AS accepted, count(*) AS n FROM sec WHERE k % 6 <> 4 AND NOT (k % 6 = 0 AND k % 50 IN (7, 9)) GROUP BY ALL",
    "syslog_priority": f"{SEC} SELECT event_id, (k + 30) // 8 AS facility, (k + 30) % 8 AS severity, ['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'informational', 'debug'][(k + 30) % 8 + 1] AS severity_name FROM sec",
    "src_auditd": f"{SEC} SELECT host, seq AS serial, '59' AS syscall, CAST(u AS VARCHAR) AS uid, '/usr/bin/' || u AS exe, 'run ' || command_line AS command, '/p/' || k AS path FROM sec WHERE event_type = 'process'",
    "src_auth": f"{SEC} SELECT event_id, CASE WHEN k % 4 IN (0, 3) THEN 'failure' ELSE 'success' END AS outcome, username AS \"user\", CASE WHEN k % 4 < 2 THEN src_ip END AS src_ip, CASE WHEN k % 4 = 2 THEN '/bin/bash -i' END AS command FROM sec WHERE event_type = 'auth'",
    "src_csv": f"{SEC} SELECT event_id, host, dest_ip, dest_port, 'a \"note\", of ' || k AS note FROM sec WHERE event_type = 'network'",
    "src_csv_ecs_snort": f"{SEC} SELECT event_id, host, dest_ip, dest_port, k AS sid, 'Bad thing' AS message, host AS snort_dest, dest_port AS snort_port FROM sec WHERE event_type = 'network'",
    "src_profile_gate": f"{SEC} SELECT {_SOURCE} AS source, {_SOURCE} NOT IN ('auditd', 'evtx', 'syslog', 'json') AS refused, count(*) AS n FROM sec GROUP BY ALL",
    "normalize": f"{SEC} SELECT sha256('v1|' || {_RAW}) AS event_id, us, event_type, CASE host WHEN 'host-0' THEN 'default' ELSE host END AS hostname, process_name, pid, lower(operation) AS operation, dest_port FROM sec WHERE k % 50 NOT IN (7, 9)",
    "event_type_coerce": f"{SEC} SELECT event_id, CASE WHEN k % 5 < 2 THEN 'file' WHEN k % 5 = 2 THEN 'other' ELSE event_type END AS kind FROM sec",
    "stable_event_id": f"""{SEC} SELECT event_id, sha256('v1|{{"event_id":"' || event_id || '","event_type":"' || event_type || '","operation":' || coalesce('"' || operation || '"', 'null') || ',"origin":{{"host":"h\\u00f6st-\\ud83d\\udda5-' || k || '","username":"' || username || '"}},"pid":' || pid || '}}') AS id FROM sec""",
    "canonical_json": f"""{SEC} SELECT event_id, '{{"host":"' || host || '","pid":' || pid || '}}' AS json, true AS same FROM sec""",
    "process_key": f"{SEC} SELECT event_id, {_PK} AS process_key, 'unknown|na|' AS empty_key FROM sec",
    "parse_to_utc": f"{SEC} SELECT event_id, CAST(CASE k % 4 WHEN 0 THEN us WHEN 1 THEN us - 3600000000 WHEN 2 THEN us // 1000000 * 1000000 ELSE 0 END AS BIGINT) AS us FROM sec",
    "path_parts": f"{SEC} SELECT event_id, CASE WHEN contains({_LAST}, '.') THEN lower(split_part({_LAST}, '.', -1)) ELSE '' END AS extension, regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) AS directory, lower({_LAST}) AS basename FROM sec WHERE event_type = 'file'",
    "is_private_ip": f"{SEC} SELECT event_id, u = 0 OR dest_ip LIKE '10.%' OR dest_ip LIKE 'fd00:%' OR dest_ip LIKE '::ffff:10.%' AS private FROM sec WHERE dest_ip IS NOT NULL",
    "route_source": f"{SEC} SELECT {_SOURCE} AS source, CASE {_SOURCE} WHEN 'auditd' THEN 'auditd' WHEN 'sshd' THEN 'auth' ELSE 'generic' END AS route, count(*) AS n FROM sec GROUP BY ALL",
    "raw_lookup": f"{SEC} SELECT event_id, CASE WHEN k % 4 < 3 THEN 'task' || k ELSE 'unknown_task' END AS task FROM sec",
    "mutating_filter": f"{SEC} SELECT event_id, operation FROM sec WHERE operation IN ('write', 'MODIFY', 'rename', 'delete')",
    "severity_bucket": f"{SEC} SELECT event_id, CASE WHEN k >= 85 THEN 'critical' WHEN k >= 60 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END AS severity FROM sec",
    "stream_ingest": f"{SEC} SELECT 'rfc5424' AS fmt, host, true AS accepted, count(*) AS n FROM sec GROUP BY host",
    "stream_dedup": f"{SEC} SELECT event_id, host FROM sec",
    "stream_alerts": f"{SEC} {_LOTL_ID}",
    # single-batch streams: what the watermark (10 minutes behind the last row) has closed
    "stream_recon": "SELECT host, process_key, event_id, us, identity_us FROM (" + detections.ORACLES["recon_sequence"] + ")",
    "stream_bruteforce": f"{SEC}, f AS (SELECT * FROM sec WHERE outcome = 'failure'), w AS (SELECT host, src_ip, (us // {HALF} - d) * {HALF} AS start_us FROM f, (VALUES (0), (1)) v(d)) SELECT start_us, host, src_ip, count(*) AS n FROM w WHERE start_us + 2 * {HALF} <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM f) GROUP BY ALL HAVING count(*) >= 5",
    "stream_burst": f"{SEC}, f AS (SELECT *, {_PATH} AS path FROM sec WHERE event_type = 'file'), m AS (SELECT max(us) // 1000 * 1000 - 600000000 AS mark FROM f), w AS (SELECT process_name, pid, path, (us // {HALF // 4} - d) * {HALF // 4} AS start_us FROM f, (VALUES (0), (1)) v(d) WHERE lower(operation) IN ('write', 'modify', 'rename', 'delete')) SELECT start_us, process_name, pid, count(DISTINCT path) AS unique_files FROM w, m WHERE start_us + 2 * {HALF // 4} <= mark GROUP BY ALL",
    "sink_artifacts": detections.S + ", al AS (SELECT * FROM sg WHERE score >= 0.8) SELECT 'normalized_events' AS artifact, count(*) AS n FROM sec UNION ALL SELECT 'signals', count(*) FROM sg UNION ALL SELECT 'alerts', count(*) FROM al UNION ALL SELECT 'timelines', count(*) FROM al",
    "sink_report_document": "SELECT 60 AS burst_window_seconds, 0.15::DOUBLE AS min_risk_score, process_name, pid, risk_score FROM (" + behaviour.ORACLES["process_report"] + ")",
    "sink_report": "SELECT process_name, pid, 60 AS burst FROM (" + behaviour.ORACLES["process_report"] + ")",
    "score_100_json": detections.S + """ SELECT event_id, signal_type, '{"score":' || CAST(round(score * 100) AS INT) || ',"indicators":["' || signal_type || '"],"classification":"' || CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END || '"}' AS alert FROM sg""",
}
