"""Log line parsers: every parser is a projection of a `value STRING` column, one pass, no error on bad lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalars import canonical_json, event_type_coerced, row_json, stable_event_id, syslog_facility, syslog_severity

# Line formats
# structured data: none, or elements one behind the other, in whose quoted values `"`, `]` and `\` are escaped
_ELEMENTS = r'(?:\[(?:[^\]"\\]|\\.|"(?:\\.|[^"\\])*+")*+\])++'
RFC5424 = rf"^<(\d{{1,3}})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|{_ELEMENTS}) ?(.*)$"
RFC3164 = r"^<(\d{1,3})>(\w{3}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$"
JSON_SCHEMA = "timestamp STRING, host STRING, event_type STRING, source STRING, process_name STRING, pid BIGINT, ppid BIGINT, process_path STRING, command_line STRING, integrity_level STRING, username STRING, file_path STRING, operation STRING, direction STRING, dest_ip STRING, dest_port INT, protocol STRING"
CEF_FIELDS = {"host": ("shost", "dhost"), "user": ("suser", "duser"), "process_name": ("sproc", "dproc"), "command_line": ("cs1",), "parent_image": ("cs2",), "file_path": ("fname",), "dest_ip": ("dst",), "dest_port": ("dpt",), "operation": ("act",)}
NXLOG = {"host": "$.Hostname", "event_code": "$.EventID", "image": "$.EventData.NewProcessName", "command_line": "$.EventData.CommandLine", "parent_image": "$.EventData.ParentProcessName", "user": "$.EventData.SubjectUserName", "pid": "$.EventData.ProcessId"}
WINLOGBEAT = {"host": "$.host.hostname", "event_code": "$.event.code", "image": "$.winlog.event_data.NewProcessName", "command_line": "$.winlog.event_data.CommandLine", "parent_image": "$.winlog.event_data.ParentProcessName", "user": "$.winlog.user.name", "pid": "$.winlog.event_data.ProcessId"}
ECS = {"host": "$.host.name", "event_type": "$.event.category", "process_name": "$.process.name", "pid": "$.process.pid", "dest_ip": "$.destination.ip", "dest_port": "$.destination.port", "user": "$.user.name"}
SNORT = r"^(\S+) +\[\*\*\] \[(\d+):(\d+):(\d+)\] (.*?) \[\*\*\] (?:\[Classification: ([^\]]*)\] )?\[Priority: (\d+)\] \{(\w+)\} ([^:\s]+)(?::(\d+))? -> ([^:\s]+)(?::(\d+))?$"
PROFILES = {"siem_host": ("auditd", "evtx", "syslog", "json"), "siem_network": ("pcap", "snort"), "siem_full": ("auditd", "evtx", "syslog", "json", "pcap", "snort"), "soar_local": (), "soar_remote": ("remote",)}


def _group(line: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))


def lines(df: DataFrame) -> DataFrame:
    """Lines that are not blank."""
    return df.filter(F.trim("value") != "")


def jsonl(df: DataFrame) -> DataFrame:
    """JSON lines to typed columns; `malformed` marks lines that are no JSON object, raw keeps the line.

    Exploding the one row keeps filters behind from making and parsing a line once more."""
    parsed = F.from_json("value", JSON_SCHEMA + ", _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"})
    made = F.when(F.trim("value") != "", F.array(F.struct(parsed.alias("j"), F.col("value").alias("raw"))))
    rows = df.select(F.explode(made).alias("r")).select("r.j.*", "r.raw")
    return rows.withColumn("malformed", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record").withColumn("ts", F.col("timestamp").try_cast("timestamp"))


def rfc5424(line: Column) -> Column:
    """One match tells whether a line has the format; its blank-separated head is split once."""
    at = F.split(F.when(line.rlike(RFC5424), line), " ", 7)
    return F.struct(
        F.regexp_extract(at[0], r"^<(\d{1,3})>", 1).try_cast("int").alias("priority"),
        at[1].alias("time"),
        at[2].alias("host"),
        at[3].alias("app"),
        at[4].alias("procid"),
        at[5].alias("msgid"),
        F.nullif(F.regexp_replace(at[6], rf"^(?:-|{_ELEMENTS}) ?", ""), F.lit("")).alias("message"),
        F.nullif(F.regexp_extract(at[6], rf"^{_ELEMENTS}", 0), F.lit("")).alias("structured"),
    )


def structured_data(elements: Column) -> Column:
    """RFC 5424 structured data as an array of (id, params); escapes in values are undone, a repeated name keeps each value."""
    param = r'([^\s=\]"\[]+)="((?:\\.|[^"\\])*+)"'
    value = lambda p: F.regexp_replace(F.regexp_extract(p, param, 2), r'\\(["\\\]])', "$1")
    pair = lambda p: F.struct(F.regexp_extract(p, param, 1).alias("name"), value(p).alias("value"))
    one = lambda e: F.struct(F.regexp_extract(e, r"^\[([^\s\]=\"]+)", 1).alias("id"), F.transform(F.regexp_extract_all(e, F.lit(param), 0), pair).alias("params"))
    return F.transform(F.regexp_extract_all(elements, F.lit(_ELEMENTS.removesuffix("++")), 0), one)


def rfc3164(line: Column, year: int) -> Column:
    """The format has no year: it is a parameter."""
    g = lambda i: _group(line, RFC3164, i)
    at = F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), g(2), g(3), g(4)), F.lit("yyyy MMM d HH:mm:ss"))
    return F.struct(g(1).try_cast("int").alias("priority"), at.alias("ts"), g(5).alias("host"), g(6).alias("tag"), g(7).try_cast("bigint").alias("pid"), g(8).alias("message"))


def cef(line: Column) -> Column:
    """Header fields and mapped extensions; escaped bars and equal signs are undone."""
    body = F.regexp_extract(line, r"CEF:0\|(.*)$", 1)
    part = lambda i: F.regexp_replace(F.regexp_extract(body, r"^(?:(?:\\.|[^|\\])*\|){%d}((?:\\.|[^|\\])*)\|" % i, 1), r"\\(.)", "$1")  # noqa: E731, UP031
    extension = F.regexp_extract(body, r"^(?:(?:\\.|[^|\\])*\|){6}(.*)$", 1)
    value = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(extension, rf"(?:^|\s){k}=(.*?)(?=\s\w+=|$)", 1), r"\\(.)", "$1"), F.lit(""))
    mapped = [F.coalesce(*[value(k) for k in keys]).alias(name) for name, keys in CEF_FIELDS.items()]
    return F.struct(part(0).alias("vendor"), part(1).alias("product"), part(3).alias("class_id"), part(4).alias("name"), part(5).try_cast("int").alias("severity"), *mapped)


def windows_json(line: Column) -> Column:
    """Both collectors' JSON layouts to the same fields; a line is parsed once, to a VARIANT value."""
    return variant_fields(F.try_parse_json(line), {f: (NXLOG[f], WINLOGBEAT[f]) for f in NXLOG})


def variant_fields(value: Column, paths: dict[str, tuple[str, ...]]) -> Column:
    """A struct of texts out of a VARIANT: for each name the first of its paths that holds something."""
    text = lambda v, path: F.try_variant_get(v, path, "string")
    made = lambda v: F.struct(*[F.coalesce(*[text(v, p) for p in several]).alias(name) for name, several in paths.items()])
    return F.get(F.transform(F.array(value), made), 0)


def raw_schema(rows: DataFrame, column: str = "value") -> DataFrame:
    """(layout, n): the layouts of JSON lines, as schemas of their VARIANT values, most frequent first; lines that
    are no JSON have a null one.  What all of them have together is in `merged`."""
    made = rows.select(F.try_parse_json(column).alias("v"))
    each = made.groupBy(F.schema_of_variant("v").alias("layout")).agg(F.count("*").alias("n"), F.schema_of_variant_agg("v").alias("merged"))
    return each.orderBy(F.desc("n"), "layout")


def task_name(raw: Column) -> Column:
    return F.coalesce(F.get_json_object(raw, "$.TaskName"), F.get_json_object(raw, "$.event_data.TaskName"), F.get_json_object(raw, "$.EventData.TaskName"))


def line_format(line: Column) -> Column:
    text = F.trim(line)
    return F.when(text.startswith("{"), "json").when(text.contains("CEF:0|"), "cef").when(text.rlike(r"^<\d+>1\s"), "rfc5424").when(text.rlike(r"^<\d+>"), "rfc3164").otherwise("raw")


def autodetect(df: DataFrame, mode: str = "auto", year: int = 2024) -> DataFrame:
    """(fmt, host, message, accepted, value) of each non-blank line; mode json or syslog accepts only its formats.

    Lines that no parser reads are kept with accepted = false: the dead-letter rows.
    """
    line = F.col("value")
    rows = lines(df).withColumn("fmt", line_format(line))
    five, three, c = rfc5424(line), rfc3164(line, year), cef(line)
    host = F.when(F.col("fmt") == "json", F.coalesce(F.get_json_object(line, "$.host"), F.get_json_object(line, "$.Hostname"), F.get_json_object(line, "$.host.hostname")))
    host = host.when(F.col("fmt") == "cef", c["host"]).when(F.col("fmt") == "rfc5424", five["host"]).when(F.col("fmt") == "rfc3164", three["host"])
    message = F.when(F.col("fmt") == "rfc5424", five["message"]).when(F.col("fmt") == "rfc3164", three["message"]).otherwise(line)
    allowed = {"auto": ("json", "cef", "rfc5424", "rfc3164"), "json": ("json",), "syslog": ("cef", "rfc5424", "rfc3164")}[mode]
    return rows.select("fmt", host.alias("host"), message.alias("message"), (F.col("fmt").isin(*allowed) & host.isNotNull()).alias("accepted"), "value")


def priority_parts(priority: Column) -> Column:
    return F.struct(syslog_facility(priority).alias("facility"), priority.bitwiseAND(F.lit(7)).alias("severity"), syslog_severity(priority).alias("severity_name"))


def auditd(df: DataFrame) -> DataFrame:
    """Kernel audit lines to one row per (host, serial): syscall fields, command line from EXECVE arguments, paths.

    Arguments are quoted text, or hex where they hold blanks (unquoted, even length).
    """
    line = F.col("value")
    head = r"^type=(\w+) msg=audit\((\d+(?:\.\d+)?):(\d+)\):(.*)$"
    rows = df.select("host", _group(line, head, 1).alias("type"), _group(line, head, 2).try_cast("double").alias("epoch"), _group(line, head, 3).try_cast("bigint").alias("serial"), _group(line, head, 4).alias("body")).filter("type IS NOT NULL")
    field = lambda k: F.nullif(F.regexp_replace(F.regexp_extract("body", rf'(?:^|\s){k}=("[^"]*"|\S+)', 1), '"', ""), F.lit(""))
    raw_arguments = F.regexp_extract_all("body", F.lit(r'\sa\d+=("[^"]*"|\S+)'), 1)
    decode = lambda a: F.when(a.startswith('"'), F.regexp_replace(a, '"', "")).when(a.rlike("^([0-9A-F]{2})+$"), F.decode(F.unhex(a), "UTF-8")).otherwise(a)
    command = F.when(F.col("type") == "EXECVE", F.array_join(F.transform(raw_arguments, decode), " "))
    only = lambda c, t: F.when(F.col("type") == t, c)
    parts = rows.select("host", "serial", "epoch", only(field("syscall"), "SYSCALL").alias("syscall"), only(field("uid"), "SYSCALL").alias("uid"), only(field("auid"), "SYSCALL").alias("auid"), only(field("exe"), "SYSCALL").alias("exe"), command.alias("command"), only(field("name"), "PATH").alias("path"))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    return parts.groupBy("host", "serial").agg(F.min("epoch").alias("epoch"), *[first(c) for c in ("syscall", "uid", "auid", "exe", "command", "path")])


def auth(line: Column) -> Column:
    """sshd, sudo and PAM messages to outcome, user, src_ip, command."""
    ssh = r"(Failed|Accepted) (\w+) for (?:invalid user )?(\S+) from (\S+)"
    sudo = r"sudo: +(\S+) : .*COMMAND=(.*)$"
    pam = r"authentication failure;.* user=(\S+)"
    outcome = F.when(line.rlike("Failed|authentication failure"), "failure").when(line.rlike(r"Accepted|COMMAND="), "success")
    user = F.coalesce(_group(line, ssh, 3), _group(line, sudo, 1), _group(line, pam, 1))
    return F.struct(outcome.alias("outcome"), user.alias("user"), _group(line, ssh, 4).alias("src_ip"), _group(line, sudo, 2).alias("command"))


def ecs(line: Column) -> Column:
    return F.struct(*[F.get_json_object(line, p).alias(n) for n, p in ECS.items()])


def snort(line: Column) -> Column:
    g = lambda i: _group(line, SNORT, i)
    return F.struct(g(3).try_cast("int").alias("sid"), g(5).alias("message"), g(7).try_cast("int").alias("priority"), g(8).alias("protocol"), g(9).alias("src_ip"), g(11).alias("dest_ip"), g(12).try_cast("int").alias("dest_port"))


def read_csv(spark, path: str, schema: str | None = None, multiline: bool = True) -> DataFrame:
    """CSV with a header line; without a schema every column is text.  Quotes in values are doubled.

    multiline: values may hold line ends, and a file is one task; without it large files are split."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).csv(path)


def profile_gate(rows: DataFrame, profile: str) -> DataFrame:
    """Rows with `refused`: true where the profile does not take the row's source."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    return rows.withColumn("refused", ~F.coalesce(F.col("source").isin(*PROFILES[profile]), F.lit(False)))


def normalized(rows: DataFrame, default_host: str = "unknown", ingest: Column | None = None) -> DataFrame:
    """Typed event with nested references; what is absent is null, never an error.

    event_id hashes the whole raw event: the canonical form of the column `raw` where rows have
    one and it is JSON, else that of all columns.
    """
    have = set(rows.columns)
    col = lambda c, kind="string": (F.col(c) if c in have else F.lit(None)).try_cast(kind)
    now = F.current_timestamp() if ingest is None else ingest
    host = F.struct(F.coalesce(F.nullif(col("host"), F.lit("")), F.lit(default_host)).alias("hostname"))
    process = F.struct(col("process_name").alias("name"), col("pid", "bigint").alias("pid"), col("ppid", "bigint").alias("ppid"), col("process_path").alias("image_path"), col("command_line").alias("command_line"), col("integrity_level").alias("integrity_level"))
    file = F.struct(col("file_path").alias("path"), F.lower(col("operation")).alias("operation"))
    network = F.struct(col("direction").alias("direction"), col("dest_ip").alias("dest_ip"), col("dest_port", "int").alias("dest_port"), col("protocol").alias("protocol"))
    whole = row_json(rows.drop("raw").schema)
    whole = F.coalesce(canonical_json(F.col("raw").cast("string")), whole) if "raw" in have else whole
    return rows.select(
        stable_event_id(whole).alias("event_id"),
        F.coalesce(col("timestamp", "timestamp"), now).alias("event_time_utc"),
        event_type_coerced(col("event_type")).alias("event_type"),
        host.alias("host"),
        F.struct(col("username").alias("username")).alias("user"),
        process.alias("process"),
        file.alias("file"),
        network.alias("network"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("raw"),
    )


def routed(rows: DataFrame) -> DataFrame:
    """`route` by source: auditd and auth rows to their own normalisers, the rest to the generic one."""
    return rows.withColumn("route", F.when(F.col("source") == "auditd", "auditd").when(F.col("source").isin("auth", "sshd", "sudo", "pam"), "auth").otherwise("generic"))
