"""Queries and oracles: ransomware behaviour (C) and the learning stage (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import learning, ransomware
from sigloom.plans.fixtures import scratch, sec_events, sql

BURST = 21600  # the fixture has 67 events a user over 30 days, so windows are wide
LONG = 10080
KEY = "process_name, pid"

SEC = f"WITH RECURSIVE sec AS ({sql('duckdb')})"
FILES = SEC + """, fe AS (SELECT *, replace(file_path, chr(92), '/') AS path, coalesce(lower(operation) IN ('write', 'modify', 'rename', 'delete') AND file_path <> '', false) AS mutating FROM sec WHERE event_type = 'file'),
named AS (SELECT *, CASE WHEN contains(split_part(path, '/', -1), '.') THEN lower(split_part(path, '/', -1)[length(split_part(path, '/', -1)) - length(split_part(split_part(path, '/', -1), '.', -1)) + 1 :]) ELSE '' END AS ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM fe)"""
_CONSUMED = "SELECT {key}, anchor, count(DISTINCT CASE WHEN mutating THEN path END) AS n, max(us) AS seg_end FROM (SELECT *, min(us) OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) AS anchor FROM {rows}) GROUP BY {key}, anchor"
PRIVATE = "(CASE WHEN dest_ip = 'not-an-ip' THEN false ELSE dest_ip LIKE '10.%' OR dest_ip LIKE 'fd00:%' OR dest_ip LIKE '::ffff:10.%' END)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ransomware.file_events(sec_events(spark, sf_dir))


def burst_report_v1(spark, sf_dir):
    return ransomware.burst_report_v1(sec_events(spark, sf_dir), BURST, 2)


def burst_consume_once(spark, sf_dir):
    return ransomware.burst_consume_once(files(spark, sf_dir), BURST)


def burst_sliding(spark, sf_dir):
    return ransomware.burst_sliding(files(spark, sf_dir), BURST)


def long_window_files(spark, sf_dir):
    return ransomware.long_window_files(files(spark, sf_dir), LONG)


def file_touch_stats(spark, sf_dir):
    return ransomware.file_touch_stats(files(spark, sf_dir))


def _flat(c: str, *fields: str):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ";")


def suspicious_extensions(spark, sf_dir):
    found = ransomware.suspicious_extensions(files(spark, sf_dir))
    return found.select("process_name", "pid", F.explode("suspicious_extensions").alias("e")).select("process_name", "pid", "e.*")


def outbound_external(spark, sf_dir):
    found = ransomware.outbound_external(sec_events(spark, sf_dir))
    return found.select("process_name", "pid", "n_outbound", _flat("outbound", "event_id", "dest_ip", "dest_port").alias("connections"))


def process_metadata(spark, sf_dir):
    return ransomware.process_metadata(sec_events(spark, sf_dir))


def _profile(spark, sf_dir):
    return ransomware.process_profile(sec_events(spark, sf_dir), BURST, LONG)


def location_integrity_flags(spark, sf_dir):
    return _profile(spark, sf_dir).select("process_name", "pid", "unique_files", "abnormal_location", "elevated_integrity")


def _score(df: DataFrame) -> DataFrame:
    return df.select("process_name", "pid", F.array_join("risk_factors", ",").alias("risk_factors"), F.round("risk_score", 6).alias("risk_score"))


def risk_factors_score(spark, sf_dir):
    return _score(ransomware.risk_factors(_profile(spark, sf_dir), 3, 10))


def recommended_actions(spark, sf_dir):
    scored = ransomware.risk_factors(_profile(spark, sf_dir), 3, 10)
    return scored.select("process_name", "pid", F.array_join(ransomware.recommended_actions(F.col("risk_score")), ",").alias("actions"))


def min_score_filter(spark, sf_dir):
    return _score(ransomware.process_report(sec_events(spark, sf_dir), BURST, LONG, 3, 10))


def process_report(spark, sf_dir):
    report = ransomware.process_report(sec_events(spark, sf_dir), BURST, LONG, 3, 10)
    return report.select(
        "process_name", "pid", "first_us", "last_us", "max_burst", "unique_files", "long_files", "directory_spread",
        F.coalesce(_flat("suspicious_extensions", "extension", "count"), F.lit("")).alias("extensions"),
        F.coalesce("n_outbound", F.lit(0)).alias("n_outbound"), "process_path", "integrity_level", "abnormal_location", "elevated_integrity",
        F.array_join("risk_factors", ",").alias("risk_factors"), F.round("risk_score", 6).alias("risk_score"), F.array_join("recommended_actions", ",").alias("actions"),
    )


def _signal(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_factors", F.array_join("risk_factors", ","))


def ransomware_signal(spark, sf_dir):
    return _signal(ransomware.ransomware_signal(sec_events(spark, sf_dir), BURST, 2))


def linux_rows(events: DataFrame) -> DataFrame:
    """The fixture as Linux rows: paths in /tmp, notes and tools by rule."""
    tool = F.when(F.col("k") % 10 == 1, "openssl enc -aes-256-cbc -in a").otherwise(F.col("command_line"))
    note = F.when(F.col("k") % 13 == 0, "/home/u/README_DECRYPT.txt").otherwise(F.translate("file_path", "\\", "/"))
    return (
        events.withColumn("command_line", F.when(F.col("event_type") == "process", tool))
        .withColumn("file_path", F.when(F.col("event_type") == "file", note))
        .withColumn("process_path", F.when(F.col("u") == 1, "/tmp/x").otherwise("/usr/bin/y"))
        .withColumn("uid", F.when(F.col("u") == 4, 0).otherwise(1000))
    )


def ransomware_linux(spark, sf_dir):
    return _signal(ransomware.ransomware_linux(linux_rows(sec_events(spark, sf_dir)), BURST, 2))


_SLIDING = """sw AS (SELECT {key}, path, us, lag(us) OVER (PARTITION BY {key}, path ORDER BY us) AS b FROM {rows} WHERE mutating),
st AS (SELECT {key}, greatest(coalesce(b + 1, us - {w}), us - {w}) AS pos, 1 AS d FROM sw WHERE b IS NULL OR b < us UNION ALL SELECT {key}, us + 1, -1 FROM sw WHERE b IS NULL OR b < us),
ag AS (SELECT {key}, pos, sum(d) AS d FROM st GROUP BY ALL),
bs AS (SELECT {key}, max(l) AS max_unique FROM (SELECT {key}, sum(d) OVER (PARTITION BY {key} ORDER BY pos) AS l FROM ag) GROUP BY ALL)"""
W = BURST * 1_000_000
_PROFILE = f"""{FILES},
cw AS ({_CONSUMED.format(key=KEY, w=W, rows="fe")}),
b AS (SELECT {KEY}, max(n) AS max_burst FROM cw GROUP BY ALL),
l AS (SELECT {KEY}, count(DISTINCT CASE WHEN mutating AND us >= last - {LONG * 60_000_000} THEN path END) AS long_files FROM (SELECT *, max(us) OVER (PARTITION BY {KEY}) AS last FROM fe) GROUP BY ALL),
s AS (SELECT {KEY}, count(DISTINCT path) AS unique_files, count(DISTINCT CASE WHEN contains(path, '/') THEN dir END) AS directory_spread, min(us) AS first_us, max(us) AS last_us FROM named GROUP BY ALL),
xc AS (SELECT {KEY}, ext AS extension, count(*) AS "count" FROM named WHERE ext <> '' GROUP BY ALL),
x AS (SELECT *, round("count" / sum("count") OVER (PARTITION BY {KEY}), 6) AS ratio, "count" / sum("count") OVER (PARTITION BY {KEY}) AS r FROM xc),
xs AS (SELECT {KEY}, extension, "count", ratio FROM x WHERE r >= 0.2 AND (length(extension) > 5 OR extension IN ('locked', 'encrypted', 'enc', 'crypt'))),
xj AS (SELECT {KEY}, string_agg(extension || ':' || "count", ';' ORDER BY extension) AS extensions FROM xs GROUP BY ALL),
o AS (SELECT {KEY}, count(*) AS n_outbound, string_agg(event_id || ':' || dest_ip || ':' || dest_port, ';' ORDER BY us, event_id) AS connections FROM sec WHERE event_type = 'network' AND direction = 'outbound' AND NOT {PRIVATE} GROUP BY ALL),
m AS (SELECT {KEY}, min(process_path) AS process_path, min(integrity_level) AS integrity_level FROM sec GROUP BY ALL),
p AS (SELECT *, (lower(process_path) LIKE '%appdata%' OR lower(process_path) LIKE '%temp%' OR lower(process_path) LIKE '%downloads%') AND unique_files >= 50 AS abnormal_location,
    lower(integrity_level) IN ('high', 'system') AND lower(process_path) NOT LIKE '%program files%' AND lower(process_path) NOT LIKE '%windows%' AS elevated_integrity
    FROM b JOIN l USING ({KEY}) JOIN s USING ({KEY}) LEFT JOIN xj USING ({KEY}) LEFT JOIN o USING ({KEY}) LEFT JOIN m USING ({KEY})),
f AS (SELECT *, list_filter([CASE WHEN max_burst >= 3 THEN '{ransomware.FACTORS[0]}' END, CASE WHEN long_files >= 10 THEN '{ransomware.FACTORS[1]}' END, CASE WHEN extensions IS NOT NULL THEN '{ransomware.FACTORS[2]}' END,
    CASE WHEN n_outbound > 0 THEN '{ransomware.FACTORS[3]}' END, CASE WHEN abnormal_location THEN '{ransomware.FACTORS[4]}' END, CASE WHEN elevated_integrity THEN '{ransomware.FACTORS[5]}' END, CASE WHEN directory_spread >= 3 THEN '{ransomware.FACTORS[6]}' END], lambda v: v IS NOT NULL) AS fs FROM p),
r AS (SELECT *, len(fs) / 7.0 AS score, CASE WHEN len(fs) / 7.0 >= 0.85 THEN 'kill_process,isolate_host,block_network,alert_human,preserve_forensics' WHEN len(fs) / 7.0 >= 0.6 THEN 'alert_human,increase_monitoring,collect_additional_logs'
    WHEN len(fs) / 7.0 >= 0.3 THEN 'log_suspicious,monitor_process' ELSE 'log_suspicious' END AS actions FROM f)"""


def _signal_sql(rows: str, ext: str, vss: str, public: str, port: str, high: str) -> str:
    key = "host, process_key"
    return f"""{SEC}, z AS (SELECT *, lower(process_name) || '|' || pid || '|' || lower(process_path) AS process_key FROM ({rows})),
fe AS (SELECT *, replace(file_path, chr(92), '/') AS path, lower(operation) IN ('write', 'modify', 'rename', 'delete') AS mutating FROM z WHERE event_type = 'file'),
{_SLIDING.format(key=key, rows="fe", w=W)},
fl AS (SELECT {key}, bool_or({ext}) AS ext, bool_or({vss}) AS vss, bool_or({public}) AS pub, bool_or({port}) AS port, bool_or({high}) AS high FROM z GROUP BY ALL),
g AS (SELECT {key}, coalesce(max_unique, 0) > 2 AS mass, coalesce(ext, false) AS ext, coalesce(vss, false) AS vss, (coalesce(max_unique, 0) > 2 AND coalesce(pub, false)) OR coalesce(port, false) OR coalesce(high, false) AS c2 FROM fl LEFT JOIN bs USING ({key})),
sc AS (SELECT *, round(least(1.0, 0.4::DOUBLE * mass::INT + 0.3::DOUBLE * ext::INT + 0.4::DOUBLE * vss::INT + 0.25::DOUBLE * c2::INT), 6) AS score FROM g)
SELECT {key}, 'rw_' || process_key AS signal_id, 'ransomware_behavior' AS signal_type, score, score AS confidence,
    concat_ws(',', CASE WHEN mass THEN 'mass_file_write' END, CASE WHEN ext THEN 'suspicious_extension' END, CASE WHEN vss THEN 'vss_deletion' END, CASE WHEN c2 THEN 'c2_network' END) AS risk_factors FROM sc WHERE score > 0"""


_WINDOWS = _signal_sql("SELECT * FROM sec", "file_path LIKE '%.encrypted' OR file_path LIKE '%.locked'", "command_line LIKE 'vssadmin delete shadows%'", f"direction = 'outbound' AND NOT {PRIVATE}", "dest_port IN (4444, 8080)", "direction = 'outbound' AND protocol = 'tcp' AND integrity_level = 'High'")
_LINUX = _signal_sql(
    "SELECT * REPLACE (CASE WHEN event_type = 'process' THEN CASE WHEN k % 10 = 1 THEN 'openssl enc' ELSE command_line END END AS command_line, CASE WHEN event_type = 'file' THEN CASE WHEN k % 13 = 0 THEN '/home/u/README_DECRYPT.txt' ELSE file_path END END AS file_path, CASE WHEN u = 1 THEN '/tmp/x' ELSE '/usr/bin/y' END AS process_path) FROM sec",
    "file_path LIKE '%README_DECRYPT%'", "command_line = 'openssl enc'", "false", "process_path LIKE '/tmp/%'", "u = 4",
)


def ml_rows(spark, sf_dir):
    """Feature rows of every process that has file events, factors kept as they come."""
    return learning.features(ransomware.risk_factors(_profile(spark, sf_dir), 3, 10))


def labels(spark, sf_dir):
    """Process labels: the encrypting process is 1; every row is given twice, the later one wins."""
    rows = sec_events(spark, sf_dir).select("process_name", "pid", (F.col("u") == 1).cast("int").alias("label")).distinct()
    return rows.filter("pid % 4 <> 3").withColumn("label", 1 - F.col("label")).withColumn("seq", F.lit(0)).union(rows.filter("pid % 4 <> 3").withColumn("seq", F.lit(1)))


def ml_features(spark, sf_dir):
    return ml_rows(spark, sf_dir).withColumn("risk_score", F.round("risk_score", 6))


def ml_label_join(spark, sf_dir):
    return learning.label_join(ml_rows(spark, sf_dir), labels(spark, sf_dir)).select("process_name", "pid", "label", "max_burst_unique_files_in_window")


def ml_split(spark, sf_dir):
    return learning.split(learning.label_join(ml_rows(spark, sf_dir), labels(spark, sf_dir))).select("process_name", "pid", "label", "train")


def _written(df: DataFrame) -> DataFrame:
    """df as a table: what reads it several times, as fitting does, makes it from the events once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ml_train(spark, sf_dir):
    data = _written(learning.split(_written(learning.label_join(ml_rows(spark, sf_dir), labels(spark, sf_dir)))))
    return learning.importances(learning.train(data.filter("train")))


def ml_evaluate(spark, sf_dir):
    rows = learning.label_join(ml_rows(spark, sf_dir), labels(spark, sf_dir))
    return learning.evaluate(rows.withColumn("prediction", (F.col("risk_score") >= 0.5).cast("int")))


def ml_rank(spark, sf_dir):
    rows = _written(ml_rows(spark, sf_dir))
    data = _written(learning.split(_written(learning.label_join(rows, labels(spark, sf_dir)))))
    return learning.rank(learning.train(data.filter("train")), rows).select("process_name", "pid", "probability", "predicted", "rank")


_LABELS = f", lb AS (SELECT DISTINCT {KEY}, CASE WHEN u = 1 THEN 1 ELSE 0 END AS label FROM sec WHERE pid % 4 <> 3)"
QUERIES = {
    f.__name__: f
    for f in (
        burst_report_v1, burst_consume_once, burst_sliding, long_window_files, file_touch_stats, suspicious_extensions, outbound_external, process_metadata, location_integrity_flags, risk_factors_score,
        recommended_actions, min_score_filter, process_report, ransomware_signal, ransomware_linux, ml_features, ml_label_join, ml_split, ml_train, ml_evaluate, ml_rank,
    )
}
ORACLES = {
    "burst_report_v1": f"{SEC}, fe AS (SELECT *, file_path AS path, coalesce(lower(operation) IN ('write', 'modify', 'rename', 'delete'), false) AS mutating FROM sec), cw AS ({_CONSUMED.format(key=KEY, w=W, rows='fe')}) SELECT {KEY}, min(anchor) AS first_seen_us, max(seg_end) AS last_seen_us, max(n) AS unique_files FROM cw WHERE n >= 2 GROUP BY ALL",
    "burst_consume_once": f"{_PROFILE} SELECT * FROM b",
    "burst_sliding": f"{FILES}, {_SLIDING.format(key=KEY, rows='fe', w=W)} SELECT * FROM bs",
    "long_window_files": f"{_PROFILE} SELECT * FROM l",
    "file_touch_stats": f"{_PROFILE} SELECT * FROM s",
    "suspicious_extensions": f"{_PROFILE} SELECT * FROM xs",
    "outbound_external": f"{_PROFILE} SELECT * FROM o",
    "process_metadata": f"{_PROFILE} SELECT * FROM m",
    "location_integrity_flags": f"{_PROFILE} SELECT {KEY}, unique_files, abnormal_location, elevated_integrity FROM p",
    "risk_factors_score": f"{_PROFILE} SELECT {KEY}, array_to_string(fs, ',') AS risk_factors, round(score, 6) AS risk_score FROM r",
    "recommended_actions": f"{_PROFILE} SELECT {KEY}, actions FROM r",
    "min_score_filter": f"{_PROFILE} SELECT {KEY}, array_to_string(fs, ',') AS risk_factors, round(score, 6) AS risk_score FROM r WHERE len(fs) > 0 AND score >= 0.15",
    "process_report": f"{_PROFILE} SELECT {KEY}, first_us, last_us, max_burst, unique_files, long_files, directory_spread, coalesce(extensions, '') AS extensions, coalesce(n_outbound, 0) AS n_outbound, process_path, integrity_level, abnormal_location, elevated_integrity, array_to_string(fs, ',') AS risk_factors, round(score, 6) AS risk_score, actions FROM r WHERE len(fs) > 0 AND score >= 0.15",
    "ransomware_signal": _WINDOWS,
    "ransomware_linux": _LINUX,
    "ml_features": f"{_PROFILE} SELECT {KEY}, round(score, 6) AS risk_score, max_burst AS max_burst_unique_files_in_window, unique_files AS total_unique_files_touched, long_files AS unique_files_in_long_window, directory_spread, (SELECT count(*) FROM xs WHERE xs.pid = r.pid AND xs.process_name = r.process_name) AS num_suspicious_extensions, coalesce(n_outbound, 0) AS num_outbound_external_connections, abnormal_location::INT AS abnormal_location, elevated_integrity::INT AS elevated_integrity, len(fs) AS num_risk_factors, (last_us - first_us) / 1e6 AS lifetime_seconds FROM r",
    "ml_label_join": f"{_PROFILE}{_LABELS} SELECT {KEY}, label, max_burst AS max_burst_unique_files_in_window FROM r JOIN lb USING ({KEY})",
    "ml_split": f"{_PROFILE}{_LABELS} SELECT {KEY}, label, (row_number() OVER (PARTITION BY label ORDER BY sha256(process_name || '|' || pid || '|42'), process_name, pid)) <= ceil(0.7 * count(*) OVER (PARTITION BY label)) AS train FROM r JOIN lb USING ({KEY})",
    "ml_evaluate": f"{_PROFILE}{_LABELS}, c AS (SELECT label, (score >= 0.5)::INT AS prediction, count(*) AS n FROM r JOIN lb USING ({KEY}) GROUP BY ALL), k AS (SELECT unnest([0, 1]) AS label), t AS (SELECT k.label, (SELECT coalesce(sum(n), 0) FROM c WHERE c.label = k.label AND c.prediction = k.label) AS tp, (SELECT coalesce(sum(n), 0) FROM c WHERE c.prediction = k.label) AS pp, (SELECT coalesce(sum(n), 0) FROM c WHERE c.label = k.label) AS support FROM k) SELECT label, CAST(support AS BIGINT) AS support, CASE WHEN pp > 0 THEN round(tp / pp, 6) ELSE 0.0 END AS \"precision\", CASE WHEN support > 0 THEN round(tp / support, 6) ELSE 0.0 END AS recall FROM t",
}
