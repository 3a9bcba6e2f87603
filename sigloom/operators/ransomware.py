"""Ransomware behaviour of processes: bursts, touched files, risk factors, reports, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.scalars import basename, directory, extension, is_mutating, is_private_ip, process_key, slashed

KEY = ("process_name", "pid")
# Extensions, shadow-copy commands, ports and weights of the behaviour signal
REPORT_EXTENSIONS = ("locked", "encrypted", "enc", "crypt")
SIGNAL_EXTENSIONS = ("encrypted", "enc", "locked", "crypt", "crypto", "vault", "zepto", "locky", "cerber", "wnry")
USUAL_EXTENSIONS = ("docx", "xlsx", "pptx", "pdf", "txt", "csv", "log", "tmp", "jpg", "png", "json", "xml", "html", "dll", "exe", "db")  # a decision: files that one program often changes alone
SHADOW_COMMANDS = ("vssadmin delete shadows", "wmic shadowcopy delete", "wbadmin delete catalog", "bcdedit /set {default} recoveryenabled no", "bcdedit /set {default} bootstatuspolicy ignoreallfailures")
C2_PORTS = (4444, 1337, 8080, 9999)
WEIGHTS = {"mass_file_write": 0.40, "suspicious_extension": 0.30, "vss_deletion": 0.40, "c2_network": 0.25}
EXTENSION_SHARE = 0.2
FACTORS = ("high_burst_file_activity", "slow_mass_encryption_pattern", "suspicious_extensions_pattern", "external_network_activity_during_encryption", "abnormal_process_location_for_mass_file_access", "elevated_integrity_with_non_system_path", "wide_directory_spread")


def keyed(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    for c in key:
        events = events.filter(F.col(c).isNotNull())
    return events


def file_events(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """File events with path (slashes forward) and whether they change a file."""
    rows = keyed(events, key).filter(F.coalesce("event_type", F.lit("file")) == "file")
    return rows.withColumn("path", slashed(F.col("file_path"))).withColumn("mutating", is_mutating(F.col("operation"), F.col("file_path")))


SPANS = 16  # a time bucket is so many windows wide


def anchored(rows: DataFrame, seconds: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """rows with `anchor`: the first event at most `seconds` before an event, among those of its key.

    Keys are cut into time buckets, and the end of a bucket is seen by the next one too, so a busy
    process is the work of many tasks.
    """
    width = seconds * 1_000_000
    span = SPANS * width
    bucket = F.floor(F.col("us") / span)
    ending = F.pmod("us", F.lit(span)) >= span - width
    dealt = rows.withColumn("__bucket", F.explode(F.when(ending, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))))
    anchor = F.first("us").over(Window.partitionBy(*key, "__bucket").orderBy("us").rangeBetween(-width, 0))
    return dealt.withColumn("anchor", anchor).filter(F.col("__bucket").eqNullSafe(bucket)).drop("__bucket")


def consumed_windows(rows: DataFrame, seconds: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """Windows in which each event is counted once: an event belongs to the first event at most
    `seconds` before it.  Columns: key, anchor, n (changed files), seg_end."""
    return anchored(rows, seconds, key).groupBy(*key, "anchor").agg(F.count_distinct(F.when(F.col("mutating"), F.col("path"))).alias("n"), F.max("us").alias("seg_end"))


def burst_consume_once(rows: DataFrame, seconds: int = 60, key: tuple[str, ...] = KEY) -> DataFrame:
    return consumed_windows(rows, seconds, key).groupBy(*key).agg(F.max("n").alias("max_burst"))


def burst_report_v1(events: DataFrame, seconds: int = 60, least: int = 40, key: tuple[str, ...] = KEY) -> DataFrame:
    """First version's report: all events count, a process needs one window of `least` changed files."""
    rows = keyed(events, key).withColumn("path", F.col("file_path")).withColumn("mutating", is_mutating(F.col("operation"), F.col("file_path")))
    found = consumed_windows(rows, seconds, key).filter(F.col("n") >= least)
    return found.groupBy(*key).agg(F.min("anchor").alias("first_seen_us"), F.max("seg_end").alias("last_seen_us"), F.max("n").alias("unique_files"))


def burst_sliding(rows: DataFrame, seconds: int = 60, key: tuple[str, ...] = KEY) -> DataFrame:
    """Largest number of distinct changed files in any sliding window, by a sweep over intervals:
    each event opens its file `seconds` ahead unless the file is open already."""
    width = seconds * 1_000_000
    changed = rows.filter("mutating").select(*key, "path", "us")
    before = F.lag("us").over(Window.partitionBy(*key, "path").orderBy("us"))
    spans = changed.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") < F.col("us")))
    start = F.greatest(F.coalesce(F.col("before") + 1, F.col("us") - width), F.col("us") - width)
    steps = spans.select(*key, F.explode(F.array(F.struct(start.alias("at"), F.lit(1).alias("d")), F.struct((F.col("us") + 1).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(*key, F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    # running sums within time buckets, then over the buckets' totals
    bucket = F.floor(F.col("at") / (SPANS * width)).alias("bucket")
    steps = steps.select(*key, bucket, "at", "d").withColumn("level", F.sum("d").over(Window.partitionBy(*key, "bucket").orderBy("at")))
    buckets = steps.groupBy(*key, "bucket").agg(F.max("level").alias("peak"), F.sum("d").alias("d"))
    before = F.coalesce(F.sum("d").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return buckets.withColumn("level", before + F.col("peak")).groupBy(*key).agg(F.max("level").alias("max_unique"))


def last_seen(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return rows.groupBy(*key).agg(F.max("us").alias("last_us"))


def long_window_files(rows: DataFrame, minutes: int = 10, key: tuple[str, ...] = KEY) -> DataFrame:
    """Distinct changed files in the last minutes of each process's file activity."""
    files = rows.groupBy(*key, "path").agg(F.max(F.when(F.col("mutating"), F.col("us"))).alias("changed"))
    late = F.col("changed") >= F.col("last_us") - minutes * 60_000_000
    return files.join(last_seen(rows, key), list(key)).groupBy(*key).agg(F.count(F.when(late, F.col("path"))).alias("long_files"))


def file_touch_stats(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Distinct files, directories, first and last time.  Grouped by path first: one shuffle, no expand."""
    path = F.when(F.col("path") != "", F.col("path"))
    by_path = rows.withColumn("p", path).groupBy(*key, "p").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    folder = F.when(F.instr("p", "/") > 0, directory(F.col("p")))
    by_folder = by_path.groupBy(*key, folder.alias("folder")).agg(F.count("p").alias("files"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return by_folder.groupBy(*key).agg(F.sum("files").alias("unique_files"), F.count("folder").alias("directory_spread"), F.min("lo").alias("first_us"), F.max("hi").alias("last_us"))


def suspicious_extensions(rows: DataFrame, share: float = EXTENSION_SHARE, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per process, the listed or long extensions that make up a share of its extensions."""
    counts = rows.withColumn("extension", extension(F.col("path"))).filter("extension <> ''").groupBy(*key, "extension").agg(F.count("*").alias("n"))
    counts = counts.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))
    odd = (F.length("extension") > 5) | F.col("extension").isin(*REPORT_EXTENSIONS)
    item = F.struct("extension", F.col("n").alias("count"), F.round("ratio", 6).alias("ratio"))
    return counts.filter(odd & (F.col("ratio") >= share)).groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("suspicious_extensions"))


def outbound_connections(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Outbound connections to public addresses, a row each."""
    rows = keyed(events, key).filter((F.col("event_type") == "network") & (F.lower("direction") == "outbound") & (F.coalesce("dest_ip", F.lit("")) != "") & ~is_private_ip(F.col("dest_ip")))
    return rows.select(*key, "us", "event_id", "dest_ip", "dest_port", "protocol")


def outbound_external(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per process, the count and the whole list of outbound connections, in time order.

    A list is one row's value; outbound_connections() has the same connections as rows.
    """
    item = F.struct("us", "event_id", "dest_ip", "dest_port", "protocol")
    return outbound_connections(events, key).groupBy(*key).agg(F.count("*").alias("n_outbound"), F.sort_array(F.collect_list(item)).alias("outbound"))


def process_metadata(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """First non-empty path and integrity level of each process, each on its own."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("us", "event_id"))).alias(c)
    return keyed(events, key).groupBy(*key).agg(first("process_path"), first("integrity_level"))


def location_flags(rows: DataFrame) -> DataFrame:
    path = F.lower(F.coalesce("process_path", F.lit("")))
    where = path.contains("appdata") | path.contains("temp") | path.contains("downloads")
    elevated = F.lower("integrity_level").isin("high", "system") & (path != "") & ~path.contains("program files") & ~path.contains("windows")
    return rows.withColumn("abnormal_location", where & (F.col("unique_files") >= 50)).withColumn("elevated_integrity", F.coalesce(elevated, F.lit(False)))


def risk_factors(rows: DataFrame, burst: int = 40, long: int = 200, spread: int = 3) -> DataFrame:
    """risk_factors in fixed order and risk_score; spread=None leaves directory spread out (six factors)."""
    tests: list[Column] = [
        F.col("max_burst") >= burst,
        F.col("long_files") >= long,
        F.size(F.coalesce("suspicious_extensions", F.array())) > 0,
        F.coalesce("n_outbound", F.lit(0)) > 0,
        F.col("abnormal_location"),
        F.col("elevated_integrity"),
    ]
    if spread is not None:
        tests.append(F.col("directory_spread") >= spread)
    factors = F.array_compact(F.array(*[F.when(t, name) for t, name in zip(tests, FACTORS, strict=False)]))
    return rows.withColumn("risk_factors", factors).withColumn("risk_score", F.least(F.lit(1.0), F.size("risk_factors") / len(tests)))


def recommended_actions(score: Column) -> Column:
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    # Names of the actions
    return (
        F.when(score >= 0.85, names("kill_process", "isolate_host", "block_network", "alert_human", "preserve_forensics"))
        .when(score >= 0.6, names("alert_human", "increase_monitoring", "collect_additional_logs"))
        .when(score >= 0.3, names("log_suspicious", "monitor_process"))
        .otherwise(names("log_suspicious"))
    )


def process_profile(events: DataFrame, burst_seconds: int = 60, long_minutes: int = 10, key: tuple[str, ...] = KEY) -> DataFrame:
    """All statistics of each process that has file events, before scoring.

    Three narrow reads that share nothing wide: the time of a process's last file event; its path, level and
    connections, combined once; and a chain over file rows: anchors of the bursts, then rows of (process, window, path),
    of (process, path), of (process, directory or extension) and of processes.  Every step combines before its shuffle
    and none deals rows by the process alone until few are left.
    """
    k = list(key)
    rows = keyed(events, key)
    file = F.coalesce("event_type", F.lit("file")) == "file"
    outbound = (F.col("event_type") == "network") & (F.lower("direction") == "outbound") & (F.coalesce("dest_ip", F.lit("")) != "") & ~is_private_ip(F.col("dest_ip"))
    given = lambda c: F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("us", "event_id", c)))[c].alias(c)
    connection = F.when(outbound, F.struct("us", "event_id", "dest_ip", "dest_port", "protocol"))
    about = rows.groupBy(*k).agg(F.sort_array(F.collect_list(connection)).alias("outbound"), given("process_path"), given("integrity_level"))
    slim = rows.filter(file).select(*k, "us", slashed(F.col("file_path")).alias("path"), is_mutating(F.col("operation"), F.col("file_path")).alias("mutating"))
    # a window's changed files; each path once
    parts = anchored(slim, burst_seconds, key).groupBy(*k, "anchor", "path").agg(
        F.max("mutating").cast("int").alias("changed"), F.max(F.when(F.col("mutating"), F.col("us"))).alias("changed_us"), F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n")
    )
    parts = parts.withColumn("burst", F.sum(F.when(F.col("path").isNotNull(), F.col("changed"))).over(Window.partitionBy(*k, "anchor")))
    paths = parts.groupBy(*k, "path").agg(F.max("burst").alias("burst"), F.max("changed_us").alias("changed_us"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    late = F.when(F.col("path").isNotNull() & (F.col("changed_us") >= F.col("last_us") - long_minutes * 60_000_000), 1)
    folder = F.when(F.instr("path", "/") > 0, directory(F.col("path")))
    kinds = F.array(F.struct(F.lit("folder").alias("kind"), folder.alias("value")), F.struct(F.lit("extension").alias("kind"), extension(F.col("path")).alias("value")))
    paths = paths.join(last_seen(rows.filter(file), key), k).select("*", late.alias("late"), F.when(F.col("path") != "", 1).alias("named"))
    # the two kinds share a path's rows: sums count with the folder alone
    spread = paths.select(*k, "burst", "late", "named", "lo", "hi", "n", F.explode(kinds).alias("of"))
    values = spread.groupBy(*k, "of").agg(F.max("burst").alias("burst"), F.sum("late").alias("late"), F.sum("named").alias("named"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    once = F.col("of.kind") == "folder"
    mine = lambda c: F.coalesce(F.sum(F.when(once, F.col(c))), F.lit(0))
    item = F.when(~once & (F.col("of.value") != ""), F.struct(F.col("of.value").alias("extension"), F.col("n").alias("count")))
    out = values.groupBy(*k).agg(
        F.max(F.coalesce("burst", F.lit(0))).alias("max_burst"),
        mine("late").alias("long_files"),
        mine("named").alias("unique_files"),
        F.count(F.when(once, F.col("of.value"))).alias("directory_spread"),
        F.min("lo").alias("first_us"),
        F.max("hi").alias("last_us"),
        F.collect_list(item).alias("extensions"),
    )
    out = out.join(about, k)
    total = F.aggregate("extensions", F.lit(0).cast("long"), lambda s, x: s + x["count"])
    shares = F.transform("extensions", lambda x: F.struct(x["extension"].alias("extension"), x["count"].alias("count"), (x["count"] / total).alias("ratio")))
    odd = F.filter(shares, lambda x: ((F.length(x["extension"]) > 5) | x["extension"].isin(*REPORT_EXTENSIONS)) & (x["ratio"] >= EXTENSION_SHARE))
    rounded = F.sort_array(F.transform(odd, lambda x: F.struct(x["extension"].alias("extension"), x["count"].alias("count"), F.round(x["ratio"], 6).alias("ratio"))))
    out = out.filter("first_us IS NOT NULL").withColumn("suspicious_extensions", F.when(F.size(rounded) > 0, rounded)).drop("extensions")
    return location_flags(out.withColumn("n_outbound", F.size("outbound").cast("long")))


def process_report(events: DataFrame, burst_seconds: int = 60, long_minutes: int = 10, burst: int = 40, long: int = 200, least: float = 0.15, key: tuple[str, ...] = KEY) -> DataFrame:
    """One row per suspicious process, with factors, score and actions."""
    scored = risk_factors(process_profile(events, burst_seconds, long_minutes, key), burst, long)
    kept = scored.filter((F.size("risk_factors") > 0) & (F.col("risk_score") >= least))
    return kept.withColumn("recommended_actions", recommended_actions(F.col("risk_score")))


def ransomware_signal(events: DataFrame, seconds: int = 60, more_than: int = 20) -> DataFrame:
    """Behaviour signal of each (host, process): weighted factors, capped at 1."""
    key = ("host", "process_key")
    named = events.withColumn("process_key", process_key(F.col("process_name"), F.col("pid"), F.col("process_path")))
    rows = file_events(named, key)
    burst = burst_sliding(rows, seconds, key)
    text = F.lower(F.coalesce("command_line", F.lit("")))
    shadow = F.lit(False)
    for needle in SHADOW_COMMANDS:
        shadow = shadow | text.contains(needle)
    network = F.col("event_type") == "network"
    outward = network & (F.lower("direction") == "outbound")
    public = F.max(outward & ~is_private_ip(F.col("dest_ip")))
    odd_port = F.max(network & F.col("dest_port").isin(*C2_PORTS))
    privileged = F.max(outward & (F.lower("protocol") == "tcp") & (F.lower("integrity_level") == "high"))
    changed = (F.coalesce("event_type", F.lit("file")) == "file") & is_mutating(F.col("operation"), F.col("file_path"))
    suffix = F.when(changed, extension(F.col("file_path")))
    # the alternative to a listed extension: one extension on all of many changed files, and not a usual one
    repeated = (F.count(suffix) > more_than) & (F.min(suffix) == F.max(suffix)) & ~F.max(suffix).isin("", *USUAL_EXTENSIONS)
    flags = named.groupBy(*key).agg(
        (F.max(F.coalesce(extension(F.col("file_path")).isin(*SIGNAL_EXTENSIONS), F.lit(False))) | F.coalesce(repeated, F.lit(False))).alias("ext"),
        F.max(shadow).alias("vss"),
        public.alias("public"),
        odd_port.alias("odd_port"),
        privileged.alias("privileged"),
    )
    return behaviour(flags.join(burst, list(key), "left"), more_than)


def behaviour(flags: DataFrame, more_than: int) -> DataFrame:
    no = F.lit(False)
    mass = F.coalesce("max_unique", F.lit(0)) > more_than
    c2 = (mass & F.coalesce("public", no)) | F.coalesce("odd_port", no) | F.coalesce("privileged", no)
    tests = {"mass_file_write": mass, "suspicious_extension": F.coalesce("ext", no), "vss_deletion": F.coalesce("vss", no), "c2_network": c2}
    score = sum((F.when(t, F.lit(WEIGHTS[name])).otherwise(F.lit(0.0)) for name, t in tests.items()), F.lit(0.0))
    out = flags.withColumn("score", F.round(F.least(F.lit(1.0), score), 6)).withColumn("risk_factors", F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()])))
    return out.filter("score > 0").select("host", "process_key", F.concat(F.lit("rw_"), F.col("process_key")).alias("signal_id"), F.lit("ransomware_behavior").alias("signal_type"), "score", F.col("score").alias("confidence"), "risk_factors")


# Tool names and note names of the Linux variant
ENCRYPTION_TOOLS = ("openssl enc", "gpg --symmetric", "gpg -c", "ccrypt", "7z a -p")
NOTE_NAMES = ("readme_decrypt", "how_to_decrypt", "restore_files", "recover_files", "ransom")


def ransomware_linux(events: DataFrame, seconds: int = 60, more_than: int = 20) -> DataFrame:
    """Linux variant: a binary in /tmp, uid 0 with encryption tools, ransom notes, bursts.

    The weights of the four factors are those of the general signal, in this order: burst .40,
    ransom note .30, encryption tool .40, process run from /tmp or as uid 0 .25.
    """
    key = ("host", "process_key")
    named = events.withColumn("process_key", process_key(F.col("process_name"), F.col("pid"), F.col("process_path")))
    text, name = F.lower(F.coalesce("command_line", F.lit(""))), basename(F.coalesce("file_path", F.lit("")))
    tool, note = F.lit(False), F.lit(False)
    for needle in ENCRYPTION_TOOLS:
        tool = tool | text.contains(needle)
    for needle in NOTE_NAMES:
        note = note | name.contains(needle)
    flags = named.groupBy(*key).agg(
        F.max(note).alias("ext"),
        F.max(tool).alias("vss"),
        F.max(F.lit(False)).alias("public"),
        F.max(F.coalesce(F.col("process_path").startswith("/tmp/"), F.lit(False))).alias("odd_port"),
        F.max(F.coalesce(F.col("uid") == 0, F.lit(False))).alias("privileged"),
    )
    return behaviour(flags.join(burst_sliding(file_events(named, key), seconds, key), list(key), "left"), more_than)
