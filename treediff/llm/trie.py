"""The prefix trie of conversations: a Patricia tree over sorted sequences of turns, built by ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.llm.common import partitions, read, stash

#: Bytes of a turn in a sequence: a digest of role and text, then the text's code points.
DIGEST, TURN = 16, 20
#: Bytes of member ids that travel as one row.
PACKED = 1 << 16
#: Turns that another conversation may lend at most, and the ids that share one lender.
MOST_LENT, FAMILY = 5, 100
#: Characters of a text that order turns of one number and role; digests order the rest.
ORDERING = 64

PARTS = "part int, kind int, seq binary, conv_id long, n long, before int, after int, firsts array<int>, lasts array<int>, last binary"
POINTS = "id binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, said long, own long, suffix array<long>"


def depth_of(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with in common."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * TURN] == b[: mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


def name(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()[:DIGEST]


def name_of(seq: Column) -> Column:
    return F.substring(F.unhex(F.sha2(seq, 256)), 1, DIGEST)


def chars(seq: bytes, depth: int) -> int:
    """Code points of the text at a depth, from 1."""
    return int.from_bytes(seq[depth * TURN - TURN + DIGEST : depth * TURN], "big")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))])


PARTS_ARROW, POINTS_ARROW = _arrow(PARTS), _arrow(POINTS)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns in order, TURN bytes each, after its first turns have been replaced by its lender's."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    turn = F.struct("turn", role.alias("role"), F.substring(text, 1, ORDERING).alias("start"), F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0")).alias("key"))
    own = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    own = own.select("conv_id", F.transform("turns", lambda t: t["key"]).alias("keys"))
    lent = F.crc32(F.col("conv_id").cast("string")) % (MOST_LENT + 1)
    own = own.withColumns({"lent": lent.cast("int"), "lender": F.col("conv_id") - F.col("conv_id") % FAMILY})
    heads = own.where("conv_id = lender").select(F.col("conv_id").alias("of"), F.slice("keys", 1, MOST_LENT).alias("head"))
    both = own.join(heads, F.col("lender") == F.col("of"), "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("lent"))
    rest = F.slice("keys", F.col("lent") + 1, F.greatest(F.size("keys"), F.lit(1)))
    return both.select("conv_id", F.unhex(F.concat(F.array_join(head, ""), F.array_join(rest, ""))).alias("seq"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's sorted sequences with its number, then a row with its first and last one and the depths of the points on their paths."""
    part, first, last, firsts, open_ = TaskContext.get().partitionId(), None, b"", [], []
    for batch in batches:
        rows = []
        for seq, conv, n in zip(*[c.to_pylist() for c in batch.columns]):
            rows.append((part, 1, seq, conv, n, None, None, None, None, None))
            if first is None:
                first, firsts, open_, common = seq, [len(seq) // TURN], [], len(seq) // TURN
            else:
                depth = depth_of(last, seq)
                if depth <= common:  # the path of the first sequence branches here
                    common = depth
                    firsts.append(depth)
                open_ = [d for d in open_ if d < depth] + [depth]
            open_.append(len(seq) // TURN)
            last = seq
        yield _batch(rows, PARTS_ARROW)
    if first is not None:
        yield _batch([(part, 2, first, None, None, None, None, sorted(set(firsts)), sorted(set(open_)), last)], PARTS_ARROW)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range what its neighbours know: how deep it shares the sequence before and after it, and the depths of points
    of other ranges on the paths of its first and its last sequence. One row a range comes in."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    shared = [-1, *[depth_of(a["last"], b["seq"]) for a, b in zip(rows, rows[1:])], -1]
    inner = [depth_of(r["seq"], r["last"]) for r in rows]
    ahead, behind, known = [], [], set()
    for k, r in enumerate(rows):
        known = {d for d in known if d <= shared[k]} | ({shared[k]} if k else set())
        ahead.append(known)
        known = {d for d in known if d <= inner[k]} | set(r["lasts"])
    known = set()
    for k in reversed(range(len(rows))):
        known = {d for d in known if d <= shared[k + 1]} | ({shared[k + 1]} if k + 1 < len(rows) else set())
        behind.append(known)
        known = {d for d in known if d <= inner[k]} | set(rows[k]["firsts"])
    out = []
    for k, (r, a, b) in enumerate(zip(rows, ahead, reversed(behind))):
        on_first, on_last = a | {d for d in b if d <= inner[k]}, b | {d for d in a if d <= inner[k]}
        out.append((r["part"], 0, None, None, None, shared[k], shared[k + 1], sorted(on_first), sorted(on_last), r["last"]))
    yield _batch(out, PARTS_ARROW)


class _Point:
    """A branch, end or leaf that is still open, with what the range adds to it: its members, the code points that they say
    from its depth on (said), and those of nodes that come up in this range first (own)."""

    __slots__ = ("depth", "conv", "n", "children", "leaves", "said", "own")

    def __init__(self, depth: int, own: int):
        self.depth, self.conv, self.n, self.children, self.leaves, self.said, self.own = depth, None, 0, 0, 0, 0, own


class _Range:
    """The Patricia tree of one range, by a stack of the points on the current sequence's path."""

    def __init__(self, sign: dict):
        self.before, self.after, self.on_first, self.on_last, self.end = sign["before"], sign["after"], sign["firsts"], sign["lasts"], sign["last"]
        self.first = self.last = None
        self.stack: list[_Point] = []
        self.rows: list[tuple] = []

    def _new(self, seq: bytes, depth: int) -> bool:
        """Whether the node at this depth of seq's path comes up in this range first."""
        return depth > self.before or (depth > 0 and seq[: depth * TURN] != self.first[: depth * TURN])

    def _point(self, seq: bytes, depth: int) -> _Point:
        return _Point(depth, chars(seq, depth) if depth and self._new(seq, depth) else 0)

    def _close(self, seq: bytes, depth: int) -> None:
        """Close the points below a depth of seq's path, and open one there if they hang on it."""
        while self.stack and self.stack[-1].depth > depth:
            p = self.stack.pop()
            if not self.stack or self.stack[-1].depth < depth:
                self.stack.append(self._point(seq, depth))
            up = self.stack[-1]
            edge = [chars(seq, d) for d in range(up.depth + 1, p.depth + 1)]
            suffix, total = [], 0
            for x in reversed([*edge[:-1], 0]):
                total += x
                suffix.append(total)
            self._emit(seq, p, seq[: up.depth * TURN], suffix[::-1])
            up.conv = p.conv if up.conv is None else min(up.conv, p.conv)
            up.n, up.leaves = up.n + p.n, up.leaves + p.leaves
            up.said += p.said + p.n * ((chars(seq, up.depth) if up.depth else 0) + sum(edge[:-1]))
            up.own += p.own + sum(x for d, x in enumerate(edge[:-1], up.depth + 1) if self._new(seq, d))
            up.children += self._new(seq, up.depth + 1)

    def _emit(self, seq: bytes, p: _Point, parent: bytes | None, suffix: list[int]) -> None:
        self.rows.append((name(seq[: p.depth * TURN]), None if parent is None else name(parent), p.depth, p.conv, p.n, p.children, p.leaves, p.said, p.own, suffix))

    def add(self, seq: bytes, conv: int, n: int) -> None:
        size = len(seq) // TURN
        if self.first is None:
            self.first, wanted, shared = seq, {0, *(d for d in self.on_first if d <= size)}, -1
        else:
            shared = depth_of(self.last, seq)
            if self.stack[-1].depth == len(self.last) // TURN and shared < self.stack[-1].depth:
                self.stack[-1].leaves = 1
            self._close(self.last, shared)
            wanted = set()
        to_end = depth_of(seq, self.end)
        wanted |= {d for d in self.on_last if shared < d <= to_end} | {size}
        for depth in sorted(wanted):
            self.stack.append(self._point(seq, depth))
        top = self.stack[-1]
        top.conv, top.n, top.said = conv, n, n * (chars(seq, size) if size else 0)
        self.last = seq

    def finish(self) -> None:
        top = self.stack[-1]
        if self.after < top.depth:
            top.leaves = 1
        self._close(self.last, 0)
        self._emit(self.last, self.stack[0], None, [0])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of each range: its sign comes first, then its sequences in order."""
    now = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 0:
                if now is not None:
                    now.finish()
                    yield _batch(now.rows, POINTS_ARROW)
                now = _Range(r)
            else:
                now.add(r["seq"], r["conv_id"], r["n"])
                if len(now.rows) >= 5000:
                    yield _batch(now.rows, POINTS_ARROW)
                    now.rows = []
    if now is not None:
        now.finish()
        yield _batch(now.rows, POINTS_ARROW)


ENDS, SHA = "id binary, first long, ids binary", "id binary, ends_sha256 string"
ENDS_ARROW, SHA_ARROW = _arrow(ENDS), _arrow(SHA)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, conv_id) with up to PACKED bytes of an id's members in one row."""
    key, first, held, size = None, None, [], 0
    for batch in batches:
        out = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (k != key or size > PACKED):
                out.append((key, first, ",".join(held).encode()))
                held, size = [], 0
            if not held:
                key, first = k, c
            held.append(str(c))
            size += len(held[-1]) + 1
        if out:
            yield _batch(out, ENDS_ARROW)
    if held:
        yield _batch([(key, first, ",".join(held).encode())], ENDS_ARROW)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == key:
                sha.update(b"," + ids)
                continue
            if sha is not None:
                out.append((key, sha.hexdigest()))
            key, sha = k, hashlib.sha256(ids)
        if out:
            yield _batch(out, SHA_ARROW)
    if sha is not None:
        yield _batch([(key, sha.hexdigest())], SHA_ARROW)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. A conversation's turns are ordered
    by turn (null first), role, the first ORDERING characters and a digest of
    the text; null roles and texts are empty. Its first crc32(conv_id) % 6 turns
    are those of the conversation whose id ends in 00 (conv_id - conv_id % 100,
    with the sign of conv_id), or none where that is absent. Rows without a
    conv_id belong to no conversation. Repeated rows are repeated turns; texts of
    any length are one digest; extra columns aren't read; an empty table gives
    no rows.

    Distinct sequences are sorted by ranges, so equal conversations are counted
    before they travel. Each range builds the tree of its own sequences with a
    stack, and knows from one row a range which points of others lie on the
    paths of its first and its last sequence. Sums of points that several ranges
    share are added up; then each compressed edge gives its unary nodes. A
    sequence has TURN bytes a turn and is one row; the members of a node are
    hashed in order of their ids from rows of PACKED bytes.
    """
    spark = conversations.sparkSession
    seqs = stash(sequences(conversations), "sequences")
    distinct = seqs.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    parts = stash(distinct.repartitionByRange(partitions(spark), "seq").sortWithinPartitions("seq").mapInArrow(_mark, PARTS), "ranges")
    signs = parts.where("kind = 2").repartition(1).sortWithinPartitions("part").mapInArrow(_neighbours, PARTS)
    ranges = parts.where("kind = 1").unionByName(signs).repartition(partitions(spark), "part").sortWithinPartitions("part", "kind", "seq")
    sums = {k: F.sum(k) for k in ("n_convs", "n_children", "n_leaves", "said", "own")}
    points = ranges.mapInArrow(_build, POINTS).groupBy("id").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("suffix").alias("suffix"), *[v.alias(k) for k, v in sums.items()]
    )
    points = stash(points, "points")
    members = seqs.select(name_of(F.col("seq")).alias("id"), "conv_id").repartitionByRange(partitions(spark), "id", "conv_id").sortWithinPartitions("id", "conv_id")
    packed = members.mapInArrow(_pack, ENDS).repartition(partitions(spark), "id").sortWithinPartitions("id", "first")
    ends = packed.mapInArrow(_digest, SHA).withColumnRenamed("id", "end_id")
    above = points.select(F.col("id").alias("above_id"), F.col("conv_id").alias("above_conv"))
    whole = points.join(ends, F.col("id") == F.col("end_id"), "left").join(above, F.col("parent") == F.col("above_id"), "left")
    nodes = whole.select("*", F.posexplode("suffix").alias("at", "below"))
    last = F.col("at") == F.size("suffix") - 1
    return nodes.select(
        "conv_id", (F.col("depth") - F.size("suffix") + 1 + F.col("at")).cast("long").alias("depth"),
        F.when(F.col("at") == 0, F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("said") - F.col("own") + (F.col("n_convs") - 1) * F.col("below")).alias("saved_tokens"),
        F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(hashlib.sha256(b"").hexdigest()).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


#: Every prefix of every conversation, grouped by a digest of its turns; the checksum is CRC-32 by a table of bytes.
SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substr(coalesce(text, ''), 1, 64), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, sha256(length(role) || ':' || role || text) AS k, length(text) AS chars FROM r),
p AS (SELECT conv_id, depth, sha256(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS id, chars FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM c),
m AS (SELECT *, lag(id) OVER w AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT id, any_value(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM m GROUP BY id, depth),
k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT m.id, sum((v.n_convs - 1) * v.chars) AS saved_tokens, count(*) FILTER (WHERE v.id NOT IN (SELECT parent FROM k)) AS n_leaves FROM n v JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.id)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.id = n.id LEFT JOIN k ON k.parent = n.id LEFT JOIN n u ON u.id = n.parent
"""
