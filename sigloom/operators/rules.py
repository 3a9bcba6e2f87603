"""Rule matching over command lines, event codes, process pairs, ports and binary content.

Packs compile to column expressions: one map-only pass over the events, no join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalars import basename, signal_id
from sigloom.operators import packs


def _any(column: Column, needles: tuple[str, ...]) -> Column:
    """Whether the column holds any needle; behind `re:` a needle is a pattern."""
    out = F.lit(False)
    for n in needles:
        out = out | (column.rlike(n[3:]) if n.startswith("re:") else column.contains(n))
    return F.coalesce(out, F.lit(False))


def _selections(field: Column, pack: str, lower: bool = False) -> Column:
    """The pack's selections that hit the field."""
    low = lambda n: n if n.startswith("re:") else n.lower()
    field = F.lower(field) if lower else field
    return F.array_compact(F.array(*[F.when(_any(field, tuple(map(low, v)) if lower else v), n) for n, v in packs.PACKS[pack].items()]))


def sigma_all(events: DataFrame, names: tuple[str, ...], lower: bool = False) -> DataFrame:
    """(event_id, host, pack, selections, score) of all known packs of the list, in one pass over the
    events; a missing pack is left out.  A hit needs one selection; score .6 + .1 each, at most 1."""
    field = F.coalesce("script_block", "command_line") if "script_block" in events.columns else F.col("command_line")
    hits = [F.struct(F.lit(n).alias("pack"), _selections(field, n, lower).alias("selections")) for n in names if n in packs.PACKS]
    if not hits:
        return events.select("event_id", "host", F.lit("").alias("pack"), F.array().cast("array<string>").alias("selections"), F.lit(0.0).alias("score")).filter("false")
    found = events.select("event_id", "host", F.explode(F.array(*hits)).alias("hit")).select("event_id", "host", "hit.*").filter(F.size("selections") > 0)
    return found.withColumn("score", F.round(F.least(F.lit(1.0), 0.6 + 0.1 * F.size("selections")), 6))


def sigma_match(events: DataFrame, pack: str, lower: bool = False) -> DataFrame:
    """sigma_all() of one pack."""
    return sigma_all(events, (pack,), lower)


def ps_hits() -> Column:
    """A struct (signal_type, score) for each detector that the command line hits."""
    return F.array_compact(F.array(*[F.when(F.col("command_line").rlike("|".join(f"(?:{r})" for r in regexes)), F.struct(F.lit(f"ps.{name}").alias("signal_type"), F.lit(score).alias("score"))) for name, (score, regexes) in packs.PS_DETECTORS.items()]))


def ps_detectors(events: DataFrame) -> DataFrame:
    """(event_id, host, signal_type, score): a row for each detector that a command line hits."""
    return events.select("event_id", "host", F.explode(ps_hits()).alias("s")).select("event_id", "host", "s.*")


def lotl_hits(rules: tuple = packs.LOTL) -> Column:
    """The first rule that a process event matches, as an array of one struct or none."""
    name, text = basename(F.col("image")), F.lower(F.coalesce("command_line", F.lit("")))
    hit = F.lit(None)
    for rule, image, score, confidence, tactic, technique, regexes in reversed(rules):
        for r in regexes:
            re.compile(r)
        test = name == image
        if regexes:
            test = test & text.rlike("|".join(f"(?:{r})" for r in regexes))
        made = F.struct(F.lit(rule).alias("rule_id"), F.lit(score).alias("score"), F.lit(confidence).alias("confidence"), F.lit(tactic).alias("tactic"), F.lit(technique).alias("technique"))
        hit = F.when(test, made).otherwise(hit)
    return F.array_compact(F.array(F.when(F.col("event_type").isin("process", "other"), hit)))


def lotl_cmdline(events: DataFrame, rules: tuple = packs.LOTL, kept: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, host, rule_id, score, confidence, tactic, technique): first matching rule wins; kept: further columns."""
    # exploding the one hit keeps the rule chain from being repeated for each of its fields
    rows = events.filter(F.col("event_type").isin("process", "other"))
    return rows.select("event_id", "host", *kept, F.explode(lotl_hits(rules)).alias("r")).select("event_id", "host", *kept, "r.*")


def task_hits() -> Column:
    """The scheduled-task rule of the event code, as an array of one struct or none."""
    hit = F.lit(None)
    for code, (score, confidence, title, tactic, technique) in packs.TASK_EVENTS.items():
        made = F.struct(F.lit(f"lotl.scheduled_task.{code}").alias("signal_type"), F.lit(score).alias("score"), F.lit(confidence).alias("confidence"), F.lit(title).alias("title"), F.lit(tactic).alias("tactic"), F.lit(technique).alias("technique"))
        hit = F.when(F.col("event_code") == code, made).otherwise(hit)
    return F.array_compact(F.array(hit))


def _small(events: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table: a constant of the library, a few dozen rows."""
    return F.broadcast(events.sparkSession.createDataFrame(rows, schema))


def lotl_eventid(events: DataFrame, task_name: Column) -> DataFrame:
    rows = events.select("event_id", "host", "event_code", F.coalesce(task_name, F.lit("unknown_task")).alias("task_name"), F.explode(task_hits()).alias("r"))
    return rows.select("event_id", "host", "event_code", "task_name", "r.*")


def spawn_suspect(spawns: DataFrame) -> DataFrame:
    """Rows with parent_image and image whose pair of base names is listed: score .78, confidence .72."""
    pairs = _small(spawns, list(packs.SPAWN_PAIRS), "parent string, child string")
    rows = spawns.withColumn("parent", basename(F.col("parent_image"))).withColumn("child", basename(F.col("image")))
    return rows.join(pairs, ["parent", "child"], "left_semi").withColumns({"score": F.lit(0.78), "confidence": F.lit(0.72), "technique": F.lit("T1059")})


def with_signal_id(signals: DataFrame, kind: str = "signal_type", extra: str | None = None) -> DataFrame:
    return signals.withColumn("signal_id", signal_id(F.col(kind), F.col("event_id"), F.col(extra) if extra else F.lit("")))


def auditd_detectors(records: DataFrame, score: float = 0.80) -> DataFrame:
    """Kernel audit records (event_id, host, syscall, path, mode, exe, cmd) to tagged rows, one flat score."""
    text = F.coalesce("cmd", F.lit(""))
    tests = {
        "T1003.008": _any(F.col("path"), packs.SENSITIVE_PATHS),
        "T1548.001": (F.col("syscall") == "chmod") & F.col("mode").rlike("^0?[46][0-7]{3}$"),
        "T1136.001": text.contains("useradd -o -u 0"),
        "T1071.001": (F.col("syscall") == "connect") & F.substring_index("exe", "/", -1).isin(*packs.SCRIPT_SHELLS),
        "T1059.004": _any(text, packs.EXEC_TOOLS),
    }
    hits = F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))
    return records.select("event_id", "host", F.explode(hits).alias("technique")).withColumn("score", F.lit(score))


def auth_rules(rows: DataFrame) -> DataFrame:
    """Authentication rows (event_id, host, outcome, user, method, command, file_path, operation) to techniques."""
    command = F.coalesce("command", F.lit(""))
    tests = {
        "T1078.003": (F.col("outcome") == "success") & (F.col("user") == "root") & (F.col("method") == "ssh"),
        "T1548.003": command.rlike(r"^sudo (/bin/bash|-s|/usr/bin/vim)(\s|$)"),
        "T1098.004": F.coalesce(F.col("file_path").contains("authorized_keys"), F.lit(False)) & F.lower("operation").isin("write", "create"),
    }
    hits = F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))
    return rows.select("event_id", "host", F.explode(hits).alias("technique"))


def ai_network(rows: DataFrame) -> DataFrame:
    """Rows (event_id, process, port, direction) on a known AI port by a process that is not expected there."""
    known = _small(rows, list(packs.AI_SERVERS), "process string, port int")
    odd = rows.join(F.broadcast(known.select("port").distinct()), "port", "left_semi").join(known, ["process", "port"], "left_anti")
    binding = F.col("direction") == "inbound"
    return odd.select("event_id", "process", "port", F.when(binding, 0.90).otherwise(0.70).alias("score"), F.when(binding, "AML.T0012").otherwise("AML.T0040").alias("technique"))


def ai_integrity(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """Model files (host, path, hash) whose hash is not the baseline's."""
    suffix = F.lit(False)
    for s in packs.MODEL_SUFFIXES:
        suffix = suffix | F.lower("path").endswith(s)
    base = baseline.select("host", "path", F.col("hash").alias("base_hash"))
    changed = files.filter(suffix).join(base, ["host", "path"]).filter("hash <> base_hash")
    return changed.withColumns({"score": F.lit(0.92), "technique": F.lit("AML.T0018")})


def ai_baseline_observe(observed: DataFrame, known: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new baseline rows, signals): only expected (process, port) pairs are learned, others signal."""
    fine = observed.join(known, ["process", "port"], "left_semi")
    new = fine.select("host", "process", "port").distinct().join(learned, ["host", "process", "port"], "left_anti")
    return learned.select("host", "process", "port").unionByName(new), observed.join(known, ["process", "port"], "left_anti")


def blob_scan(blobs: DataFrame, content: str = "content") -> DataFrame:
    """(id columns, rule) for each binary rule that the content matches; bytes are read as one text of as many characters."""
    text, tests = F.col("__text"), []
    for rule, (names, least, magic, pattern) in packs.BLOB_RULES.items():
        count = sum((F.when(F.instr(text, n) > 0, 1).otherwise(0) for n in names), F.lit(0))
        codes = [pattern[i : i + 2] for i in range(0, len(pattern), 2)]
        bytes_at = "(?s)" + "".join("." if c == "??" else rf"\x{c}" for c in codes)
        starts = F.substring(content, 1, len(magic) // 2) == F.unhex(F.lit(magic))
        tests.append(F.when(starts & (count >= least) & text.rlike(bytes_at), rule))
    rows = blobs.withColumn("__text", F.decode(content, "ISO-8859-1"))
    return rows.select(*[c for c in blobs.columns if c != content], F.explode(F.array_compact(F.array(*tests))).alias("rule"))
