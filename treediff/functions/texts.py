"""Columns over names: URLs, paths below roots, sizes, keys, ids of jobs, globs."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The default port, and the units of sizes.
DEFAULT_PORT = 2049
UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}


def _address(host: str | None) -> str | None:
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return None
    return str(getattr(ip, "ipv4_mapped", None) or ip)


@F.pandas_udf(StringType())
def canonical_address(host: pd.Series) -> pd.Series:
    """An IP literal in one text form (IPv4 mapped into IPv6 is IPv4), null for other names."""
    return host.map(_address, na_action="ignore")


def url_parts(url: Column) -> Column:
    """struct(host, port, path, query) of nfs://host[:port]/path[?options], null where it isn't one.

    Hosts in lower case without dots at the end; the default port is dropped;
    slashes collapse; options are sorted, each once. IP literals need
    canonical_address besides.
    """
    text = F.trim(url)
    before = F.substring_index(text, "?", 1)
    main = F.regexp_extract(before, r"^nfs://(\[[^\]]*\]|[^/:\[]*)(?::([0-9]{1,5}))?(/.*)$", 0)
    part = lambda k: F.regexp_extract(before, r"^nfs://(\[[^\]]*\]|[^/:\[]*)(?::([0-9]{1,5}))?(/.*)$", k)
    host = F.lower(F.regexp_replace(F.trim(F.regexp_replace(part(1), r"[\[\]]", "")), r"\.+$", ""))
    port = F.when(part(2) != "", part(2).cast("int"))
    options = F.when(F.instr(text, "?") > 0, F.substring(text, F.instr(text, "?") + 1, F.length(text))).otherwise("")
    query = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(options, "&"), lambda x: F.trim(x)), lambda x: x != ""))), "&")
    path = F.concat(F.lit("/"), F.array_join(components(part(3)), "/"))
    good = (main != "") & (host != "") & (port.isNull() | (port <= 65535))
    return F.when(good, F.struct(host.alias("host"), F.when(port != DEFAULT_PORT, port).alias("port"), path.alias("path"), F.when(query != "", query).alias("query")))


def with_address(parts: Column) -> Column:
    """url_parts with an IP literal as host in its one form; only hosts that may be one (a colon, or digits and dots) go through Python's parser."""
    literal = F.when(parts["host"].rlike("^([0-9.]+|.*:.*)$"), parts["host"])
    return F.when(parts.isNotNull(), F.struct(F.coalesce(canonical_address(literal), parts["host"]).alias("host"), parts["port"].alias("port"), parts["path"].alias("path"), parts["query"].alias("query")))


def url_text(parts: Column) -> Column:
    host = F.when(F.instr(parts["host"], ":") > 0, F.concat(F.lit("["), parts["host"], F.lit("]"))).otherwise(parts["host"])
    return F.concat(F.lit("nfs://"), host, F.coalesce(F.concat(F.lit(":"), parts["port"].cast("string")), F.lit("")), parts["path"], F.coalesce(F.concat(F.lit("?"), parts["query"]), F.lit("")))


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def relate_paths(source: Column, dest: Column) -> Column:
    """Same, DestInsideSource, SourceInsideDest or Disjoint, by whole components."""
    s, d = components(source), components(dest)
    under = lambda a, b: (F.size(a) > F.size(b)) & (F.slice(a, 1, F.size(b)) == b)
    return F.when(s == d, "Same").when((F.size(s) == 0) | under(d, s), "DestInsideSource").when((F.size(d) == 0) | under(s, d), "SourceInsideDest").otherwise("Disjoint")


def normal_root(root: Column) -> Column:
    cut = F.when(root.endswith("/"), F.substring(root, F.lit(1), F.length(root) - 1)).otherwise(root)
    return F.when(cut == "", "/").otherwise(cut)


def roots_overlap(source: Column, dest: Column) -> Column:
    """identical, source_prefix, dest_prefix, or null where neither root holds the other."""
    s, d = normal_root(source), normal_root(dest)
    holds = lambda a, b: (a != b) & F.when(a == "/", b.startswith("/")).otherwise(F.startswith(b, F.concat(a, F.lit("/"))))
    return F.when(s == d, "identical").when(holds(s, d), "source_prefix").when(holds(d, s), "dest_prefix")


def join_root(root: Column, path: Column) -> Column:
    """The path below a root, which loses one slash at its end; a path without a leading slash stands alone."""
    cut = F.when(root.endswith("/"), F.substring(root, F.lit(1), F.length(root) - 1)).otherwise(root)
    lead = F.when(cut.startswith("/"), cut).otherwise(F.concat(F.lit("/"), cut))
    return F.when(~path.startswith("/"), F.concat(F.lit("/"), path)).when(cut == "", path).otherwise(F.concat(lead, path))


def partial_path(path: Column, host: Column, pid: Column) -> Column:
    """struct(path, error): the hidden name that a file has while it is written; EINVAL for no name or a NUL, EISDIR for a slash at the end."""
    error = F.when((path == "") | (F.instr(path, "\0") > 0), "EINVAL").when(path.endswith("/"), "EISDIR")
    base = F.substring_index(path, "/", -1)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(base))
    name = F.concat(folder, F.lit("."), base, F.lit("."), host, F.lit("."), pid.cast("string"), F.lit(".partial"))
    return F.struct(F.when(error.isNull(), name).alias("path"), error.alias("error"))


def parse_size(text: Column) -> Column:
    """Bytes of "8 GiB"; null for other units, signs, fractions and what 64 bits don't hold."""
    pattern = r"^\s*\+?([0-9]+)\s*([A-Za-z]*)\s*$"
    number, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    times = None
    for name, n in UNITS.items():
        times = F.when(unit == name, F.lit(n)) if times is None else times.when(unit == name, F.lit(n))
    value = F.when((number != "") & (F.length(number) <= 19), number.cast("decimal(19,0)")) * times.cast("decimal(18,0)")
    return F.when(value <= F.lit(2**63 - 1).cast("decimal(38,0)"), value.cast("long"))


def one_digit(x: Column) -> Column:
    """A number from 0 to 2^22 with one digit after the point, rounded from its exact binary value, ties to even."""
    bits = F.when(x < 2048, F.lit(float(1 << 52))).otherwise(F.lit(float(1 << 41)))
    unit = bits.cast("long").cast("decimal(20,0)")
    tens = (x * bits).cast("long").cast("decimal(20,0)") * F.lit(10).cast("decimal(2,0)")
    rest = F.pmod(tens, unit)
    low = ((tens - rest) / unit).cast("long")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (low % 2 == 1))
    n = low + up.cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def duration_text(us: Column) -> Column:
    """1.2s, 14ms, 1.4ms or 400µs."""
    return F.when(us >= 1_000_000, F.concat(one_digit(us / 1e6), F.lit("s"))).when(us >= 10_000, F.concat(F.floor(us / 1000).cast("string"), F.lit("ms"))).when(us >= 1000, F.concat(one_digit(us / 1000.0), F.lit("ms"))).otherwise(F.concat(us.cast("string"), F.lit("µs")))


def machine_name(host: Column, pid: Column) -> Column:
    """The host's name without the process id that some workers append."""
    tail = F.concat(F.lit("-"), pid.cast("string"))
    return F.when(F.endswith(host, tail), F.substring(host, F.lit(1), F.length(host) - F.length(tail))).otherwise(host)


def job_id_error(job: Column) -> Column:
    """Why a job id isn't accepted, or null."""
    return (
        F.when(job.isNull() | (job == ""), "empty").when(F.octet_length(job) > 128, "too long").when(job.isin("_cluster", ".", ".."), "reserved")
        .when(F.instr(job, "/") > 0, "slash").when(job.rlike("[\\x00-\\x1F\\x7F]"), "control character")
    )


def seq_key(prefix: str, seq: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(seq.cast("string"), 20, "0"), F.lit(".jsonl"))


def key_seq(key: Column) -> Column:
    return F.regexp_extract(key, r"([0-9]{20})\.jsonl$", 1).cast("long")


def claim_key(shard: Column) -> Column:
    return F.concat(F.lit("shards/"), shard, F.lit(".claim"))


def shard_of_claim(key: Column) -> Column:
    return F.regexp_extract(key, r"^shards/(.*)\.claim$", 1)


def glob_pattern(glob: str) -> str:
    """An anchored pattern for a name glob of * ? [...] [!...] and \\x; ValueError for an open bracket or a lone backslash."""
    out, k = "^", 0
    while k < len(glob):
        c = glob[k]
        if c in "*?":
            out += {"*": ".*", "?": "."}[c]
        elif c == "[":
            end = glob.find("]", k + 3 if glob[k + 1 : k + 2] == "!" else k + 2)
            if end < 0:
                raise ValueError(f"open bracket in {glob!r}")
            inner = glob[k + 1 : end]
            negated = inner.startswith("!")
            out += "[" + "^" * negated + inner[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&") + "]"
            k = end
        elif c == "\\":
            k += 1
            if k == len(glob):
                raise ValueError(f"lone backslash in {glob!r}")
            out += "\\Q" + glob[k] + "\\E"
        else:
            out += "\\Q" + c + "\\E"
        k += 1
    return "(?s)" + out + "\\z"
