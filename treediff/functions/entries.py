"""Columns of file-tree entries: ids, types, modes, times, owners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the index format: type tags, the bits of S_IFMT, and three spellings of names.
TYPE_BITS = {1: 0o100000, 2: 0o040000, 3: 0o120000, 4: 0o010000, 5: 0o140000, 6: 0o060000, 7: 0o020000}
WALKER_TYPES = {"file": 1, "directory": 2, "symlink": 3, "fifo": 4, "socket": 5, "block_device": 6, "char_device": 7}
TAG_NAMES = {0: "unknown", 1: "regular", 2: "dir", 3: "symlink", 4: "fifo", 5: "socket", 6: "block_dev", 7: "char_dev"}
REPORT_NAMES = {0: "unknown", 1: "file", 2: "dir", 3: "symlink", 4: "fifo", 5: "socket", 6: "blockdev", 7: "chardev"}
FORMAT_MASK, PERMISSION_MASK, SHARD_BITS = 0o170000, 0o7777, 40


def pick(key: Column, values: dict, otherwise: Column | None = None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out if otherwise is None else out.otherwise(otherwise)


def make_row_id(shard: Column, row: Column) -> Column:
    return F.shiftleft(shard.cast("long"), SHARD_BITS).bitwiseOR(row.cast("long"))


def shard_of(row_id: Column) -> Column:
    return F.shiftrightunsigned(row_id, SHARD_BITS)


def row_of(row_id: Column) -> Column:
    return row_id.bitwiseAND(F.lit((1 << SHARD_BITS) - 1))


def split_us(us: Column) -> Column:
    """Microseconds as struct(sec, nsec), nsec in [0, 1e9) before the epoch too."""
    us = us.cast("long")
    rest = F.pmod(us, F.lit(1_000_000).cast("long"))
    return F.struct(F.floor((us - rest).cast("decimal(20,0)") / 1_000_000).cast("long").alias("sec"), (rest * 1000).cast("int").alias("nsec"))


def type_bits(tag: Column) -> Column:
    return pick(tag, TYPE_BITS).cast("long")


def tag_of_mode(mode: Column) -> Column:
    """The type tag that a mode's bits name, 0 for none."""
    return pick(mode.cast("long").bitwiseAND(F.lit(FORMAT_MASK).cast("long")), {v: F.lit(k) for k, v in TYPE_BITS.items()}, F.lit(0)).cast("int")


def is_special(tag: Column) -> Column:
    return tag.isin(4, 5, 6, 7)


def has_data(tag: Column) -> Column:
    return tag == 1


def corrupt_reason(tag: Column, mode: Column) -> Column:
    """Why a row can't be read, or null: an unknown type, or bits of the mode that name another."""
    bits = mode.cast("long").bitwiseAND(F.lit(FORMAT_MASK).cast("long"))
    known = tag.between(1, 7)
    return F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("file_type "), F.coalesce(tag.cast("string"), F.lit("null")))).when(~F.coalesce(bits == type_bits(tag), F.lit(False)), "mode bits disagree with file_type")


def canonical_mode(walker_type: Column, permissions: Column) -> Column:
    """Permissions and the bits of an exactly spelled type; null for any other spelling."""
    return permissions.cast("long").bitwiseAND(F.lit(PERMISSION_MASK).cast("long")).bitwiseOR(type_bits(pick(walker_type, WALKER_TYPES)))


def strip_root(path: Column, root: str) -> Column:
    """The path below a root, with a leading slash; null outside it (a longer name is outside too)."""
    return F.when(path == root, "/").when(F.substring(path, 1, len(root) + 1) == root + "/", F.substring(path, len(root) + 1, 1 << 20))


def time_pair(sec: Column, nsec: Column, us: Column) -> Column:
    """struct(sec, nsec): the precise pair where both parts are there, else microseconds, else null."""
    return F.when(sec.isNotNull() & nsec.isNotNull(), F.struct(sec.cast("long").alias("sec"), nsec.cast("int").alias("nsec"))).when(us.isNotNull(), split_us(us))


def scan_mtime(sec: Column, nsec: Column) -> Column:
    """What the diff compares: null without seconds; missing nanoseconds are 0."""
    return F.when(sec.isNotNull(), F.struct(sec.cast("long").alias("sec"), F.coalesce(nsec.cast("int"), F.lit(0)).alias("nsec")))


def time_text(sec: Column, nsec: Column) -> Column:
    """Seconds and six digits of microseconds."""
    return F.concat(sec.cast("string"), F.lit("."), F.lpad(F.floor(nsec / 1000).cast("string"), 6, "0"))


def owner_text(uid: Column, gid: Column) -> Column:
    return F.concat(F.coalesce(uid.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(gid.cast("string"), F.lit("-")))


def mode_text(mode: Column) -> Column:
    return F.lpad(F.conv(mode.cast("long").bitwiseAND(F.lit(PERMISSION_MASK).cast("long")).cast("string"), 10, 8), 4, "0")


def path_lossy(path: Column) -> Column:
    return F.make_valid_utf8(path.cast("string"))


def parent_dir(path: Column) -> Column:
    """The directory above; / for what lies in the root, and for the root."""
    head = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(head == "", "/").otherwise(head)


def depth(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")


def size_class(size: Column) -> Column:
    return F.when(size < 1 << 20, "small").when(size < 1 << 30, "medium").otherwise("large")


def attributes(blob: Column) -> Column:
    """Extended attributes packed as big-endian length and bytes, names and values in turn: struct(attrs: array<struct(name, value)>, error).

    A null blob (not looked at) gives nulls, an empty one no attributes. Lengths
    that reach beyond the end give an error, with the attributes before it. Each
    attribute takes eight bytes at least, which bounds the steps.
    """
    size = F.octet_length(blob)
    number = lambda at: F.conv(F.hex(F.substring(blob, at + 1, F.lit(4))), 16, 10).cast("long")
    bytes_ = lambda at, n: F.substring(blob, (at + 1).cast("int"), n.cast("int"))
    empty = F.array().cast("array<struct<name:binary,value:binary>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("attrs"), F.lit(None).cast("string").alias("error"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        name_len = number(at.cast("int"))
        value_at = at + 4 + name_len
        value_len = number(value_at.cast("int"))
        fault = (
            F.when(at + 4 > size, "torn name length").when(value_at > size, "name beyond the end")
            .when(value_at + 4 > size, "torn value length").when(value_at + 4 + value_len > size, "value beyond the end")
        )
        one = F.struct(bytes_(at + 4, name_len).alias("name"), bytes_(value_at + 4, value_len).alias("value"))
        more = F.struct((value_at + 4 + value_len).alias("at"), F.concat(s["attrs"], F.array(one)).alias("attrs"), F.lit(None).cast("string").alias("error"))
        bad = F.struct(at.alias("at"), s["attrs"].alias("attrs"), F.concat(fault, F.lit(" at byte "), at.cast("string")).alias("error"))
        return F.when(s["error"].isNotNull() | (at >= size), s).when(fault.isNotNull(), bad).otherwise(more)

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(size / 8).cast("int")))
    return F.when(blob.isNotNull(), F.aggregate(steps, start, step, lambda s: F.struct(s["attrs"].alias("attrs"), s["error"].alias("error"))))
