"""Column functions over security events, all of built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of events, and operations that change a file
EVENT_TYPES = ("process", "file", "network", "auth", "other")
MUTATING = ("write", "modify", "rename", "delete")
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
# IPv4 blocks that are not public
PRIVATE_V4 = (
    r"^(0|10|127)\.",
    r"^169\.254\.",
    r"^172\.(1[6-9]|2[0-9]|3[01])\.",
    r"^192\.0\.0\.([0-8]|1[1-9]|[2-9][0-9]|[12][0-9][0-9])$",
    r"^192\.0\.2\.",
    r"^192\.168\.",
    r"^198\.1[89]\.",
    r"^198\.51\.100\.",
    r"^203\.0\.113\.",
    r"^2(4[0-9]|5[0-5])\.",
)
# IPv6 blocks that are not public, those within them that are, and the block that holds IPv4 addresses
PRIVATE_V6 = (
    "0:0:0:0:0:0:0:0/128",
    "0:0:0:0:0:0:0:1/128",
    "64:ff9b:1:0:0:0:0:0/48",
    "100:0:0:0:0:0:0:0/64",
    "2001:0:0:0:0:0:0:0/23",
    "2001:db8:0:0:0:0:0:0/32",
    "2002:0:0:0:0:0:0:0/16",
    "fc00:0:0:0:0:0:0:0/7",
    "fe80:0:0:0:0:0:0:0/10",
)
PUBLIC_V6 = (
    "2001:1:0:0:0:0:0:1/128",
    "2001:1:0:0:0:0:0:2/128",
    "2001:3:0:0:0:0:0:0/32",
    "2001:4:112:0:0:0:0:0/48",
    "2001:20:0:0:0:0:0:0/28",
    "2001:30:0:0:0:0:0:0/28",
)
MAPPED_V4 = "00000000000000000000ffff"
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug")


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.lower(F.substring_index(slashed(path), "/", -1))


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the last segment, '' without one."""
    name = F.substring_index(slashed(path), "/", -1)
    return F.when(path.isNotNull(), F.lower(F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise("")))


def directory(path: Column) -> Column:
    """All but the last segment, '' without a slash."""
    p = slashed(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_extract(p, "^(.*)/[^/]*$", 1)).otherwise(F.when(path.isNotNull(), ""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once and not repeated in the plan."""
    return F.get(F.transform(F.array(value), use), 0)


def ipv6_hex(address: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits (lower case), which sort as addresses do; null where it is none.

    Reads `::`, a dotted IPv4 tail and a zone (`%eth0`, left out)."""

    def dotted(text: Column) -> Column:
        """A dotted tail as two groups."""
        byte = lambda bytes_, i: F.lpad(F.hex(F.get(bytes_, i).cast("int")), 2, "0")
        groups = lambda x: F.concat(byte(x, 0), byte(x, 1), F.lit(":"), byte(x, 2), byte(x, 3))
        tail = F.substring_index(text, ":", -1)
        made = F.concat(F.regexp_extract(text, "^(.*:)", 1), _let(F.split(tail, "[.]"), groups))
        return F.when(F.instr(text, ".") == 0, text).when(tail.rlike(IPV4), made)

    def digits(sides: Column) -> Column:
        """Sides of `::`, each a list of groups, as digits."""
        given = F.size(F.flatten(sides))
        fine = F.forall(F.flatten(sides), lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & ((F.size(sides) == 1) & (given == 8) | (F.size(sides) == 2) & (given <= 7))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0)))
        whole = F.concat(F.get(sides, 0), zeros, F.coalesce(F.get(sides, 1), F.array().cast("array<string>")))
        return F.when(fine, F.lower(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))

    text = F.regexp_extract(address, r"^([0-9A-Fa-f:.]+)(?:%[^%]+)?$", 1)
    groups = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))
    return _let(F.transform(F.split(_let(text, dotted), "::"), groups), digits)


def _in_blocks(digits: Column, blocks: tuple[str, ...]) -> Column:
    """Whether an address of 32 digits is in a block: a range of addresses each."""
    out = F.lit(False)
    for block in blocks:
        start, _, bits = block.partition("/")
        width = int(bits) // 4
        low = f"{int(''.join(g.zfill(4) for g in start.split(':')), 16):032x}"
        high = f"{int(low, 16) | ((1 << (128 - int(bits))) - 1):032x}"
        same = digits.startswith(low[:width]) if int(bits) % 4 == 0 else digits.between(low, high)
        out = out | same
    return out


def _private_v4(address: Column) -> Column:
    return F.coalesce(address.rlike(IPV4) & address.rlike("|".join(PRIVATE_V4)), F.lit(False))


def is_private_ip(address: Column) -> Column:
    """Whether an IPv4 or IPv6 address is not public; anything that is no address counts as public.

    An IPv4 address inside an IPv6 one (::ffff:a.b.c.d) counts as itself."""

    def six(digits: Column) -> Column:
        part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10)
        inner = F.concat_ws(".", *[part(i) for i in (25, 27, 29, 31)])
        private = F.when(digits.startswith(MAPPED_V4), _let(inner, _private_v4)).otherwise(_in_blocks(digits, PRIVATE_V6) & ~_in_blocks(digits, PUBLIC_V6))
        return F.coalesce(private, F.lit(False))

    return F.when(F.instr(address, ":") > 0, _let(ipv6_hex(address), six)).otherwise(_private_v4(address))


def event_type_coerced(kind: Column) -> Column:
    """Missing is `file`, anything outside the enumeration is `other`."""
    low = F.lower(kind)
    return F.when(F.coalesce(kind, F.lit("")) == "", "file").when(low.isin(*EVENT_TYPES), low).otherwise("other")


def process_key(name: Column, pid: Column, path: Column) -> Column:
    text = lambda c, default: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))
    return F.concat_ws("|", F.lower(text(name, "unknown")), text(pid, "na"), F.lower(text(path, "")))


def _ascii(json: Column) -> Column:
    """JSON text with every character outside the printable ASCII range as \\uXXXX (lower case, surrogate pairs)."""
    four = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(token: Column) -> Column:
        n = F.ascii(token)
        high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))
        outside = F.when(n > 0xFFFF, F.concat(four(high), four(low))).otherwise(four(n))
        return F.when(token.startswith("\\u"), F.lower(token)).when((F.char_length(token) == 1) & ((n < 32) | (n > 126)), outside).otherwise(token)

    # an escaped backslash before a `u` is no escaped character; what needs no change is one token
    odd = lambda text: text.rlike("[^ -~]") | F.replace(text, F.lit("\\\\"), F.lit("")).contains("\\u")
    tokens = lambda text: F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\.|[ -\[\]-~]+|."), 0)
    return _let(json, lambda text: F.when(odd(text), F.array_join(F.transform(tokens(text), escaped), "")).otherwise(text))


def _sorted(value: Column, kind: T.DataType) -> Column:
    """value with the fields of its structs and maps in order of their names."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        made = F.struct(*[_sorted(value.getField(f.name), f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(value), lambda x: F.struct(x["key"].alias("key"), _sorted(x["value"], kind.valueType).alias("value")))))
    return value


def row_json(schema: T.StructType) -> Column:
    """Canonical JSON of a row of this schema: sorted keys, no blanks, nulls kept, ASCII only.

    Floats are written as Spark writes them.
    """
    fields = sorted(schema.fields, key=lambda f: f.name)
    return _ascii(F.to_json(F.struct(*[_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"}))


def canonical_json(raw: Column) -> Column:
    """Canonical form of JSON text (see row_json); null where it is no JSON or an object repeats a key."""
    return _ascii(F.to_json(F.try_parse_json(raw)))


def stable_event_id(json: Column, salt: str = "v1") -> Column:
    """sha256 of a version tag and an event's canonical JSON."""
    return F.sha2(F.concat(F.lit(f"{salt}|"), json), 256)


def parse_to_utc(text: Column, ingest: Column) -> Column:
    """ISO time with or without offset, else epoch digits, else the ingest time."""
    epoch = F.timestamp_seconds(F.when(text.rlike(r"^[0-9]{1,11}$"), text).try_cast("long"))
    return F.coalesce(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), text.try_cast("timestamp")), epoch, ingest)


def severity(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.60, "high").when(score >= 0.40, "medium").otherwise("low")


def syslog_facility(priority: Column) -> Column:
    return F.shiftright(priority, 3)


def syslog_severity(priority: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), priority.bitwiseAND(F.lit(7)) + 1)


def signal_id(kind: Column, event_id: Column, extra: Column) -> Column:
    return F.concat(F.lit("sig-"), F.substring(F.sha2(F.concat_ws("|", kind, event_id, extra), 256), 1, 16))


def is_mutating(operation: Column, path: Column) -> Column:
    return F.coalesce(F.lower(operation).isin(*MUTATING) & (path != ""), F.lit(False))


def decoded_command(command: Column) -> Column:
    """Text behind -enc/-EncodedCommand: base64 of UTF-16LE; null where it is neither."""
    payload = F.regexp_extract(command, r"-[Ee]nc(?:odedCommand)?\s+([A-Za-z0-9+/=]{20,})", 1)
    raw = F.try_to_binary(F.nullif(payload, F.lit("")), F.lit("base64"))
    return F.when((F.octet_length(raw) % 2) == 0, F.decode(raw, "UTF-16LE"))
