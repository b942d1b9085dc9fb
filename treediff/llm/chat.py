"""Reply trees to conversations; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treediff.llm.common import read, stash

#: A turn is OPEN role MID text CLOSE. Inside roles and texts a backslash is written \\b
#: and < is written \\l, in roles > is written \\g, so that no mark can stand inside.
OPEN, MID, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def format_turns(turns: Column) -> Column:
    """array<struct<role,text>> as one string."""
    role = lambda t: F.replace(escape(t["role"]), F.lit(">"), F.lit("\\g"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), role(t), F.lit(MID), escape(t["text"]), F.lit(CLOSE))), "")


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text, start, length>>, the last two in the formatted string, from 0."""
    parts = F.split(formatted, CLOSE, -1)
    first = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(p.alias("p"), F.instr(p, MID).alias("at")))
    empty = F.array().cast("array<struct<role:string,text:string,start:int,length:int>>")

    def add(done: Column, x: Column) -> Column:
        before = F.when(F.size(done) == 0, 0).otherwise(F.element_at(done, -1)["start"] + F.element_at(done, -1)["length"] + len(CLOSE))
        role = unescape(F.substring(x["p"], F.lit(len(OPEN) + 1), x["at"] - len(OPEN) - 1))
        body = F.substring(x["p"], x["at"] + len(MID), F.length(x["p"]))
        return F.concat(done, F.array(F.struct(role.alias("role"), unescape(body).alias("text"), (before + x["at"] - 1 + len(MID)).alias("start"), F.length(body).alias("length"))))

    return F.aggregate(first, empty, add)


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, up) of the ancestors 1, 2, 4, ... steps up, and (tree, node, total, depth) for nodes that hang on a root.

    Each round joins the nodes that haven't reached their root with the table
    itself, which doubles the steps: the rounds grow with the logarithm of the
    deepest path, and a round's join makes a row for each node still on its way.
    """
    known = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    on = F.col("tree").eqNullSafe(F.col("t2")) & (F.col("parent") == F.col("n2"))
    now = nodes.join(known, on, "left").select("tree", "node", F.col("n2").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    now, tables = stash(now, "jump"), []
    most = now.count()
    while True:
        tables.append(now.select("tree", "node", "up").where("up is not null"))
        if tables[-1].isEmpty():
            return tables[:-1], now
        if 2 ** (len(tables) - 1) > most:  # only nodes above which a circle lies still go up
            return tables[:-1], now.where("up is null")
        above = now.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        on = F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2"))
        going = now.where("up is not null").join(above, on).select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"))
        now = stash(now.where("up is null").unionByName(going), "jump")


def format_branches(messages: DataFrame, best: int | None = 1, answer: str = "assistant") -> DataFrame:
    """Root-to-leaf branches of reply trees, each formatted as one conversation.

    messages: tree, node (unique in its tree), parent (null, or unknown: a root),
    role, text, score. A branch scores the sum of its nodes' scores; the `best`
    ones of each tree (None: all) are returned as tree, leaf, rank, score,
    formatted, loss_spans (array of struct(start, length), code points from 0 in
    `formatted`: the texts whose role is `answer`). Ties go to the smaller leaf.
    Null roles and texts count as empty, null scores as 0, texts of any length
    are formatted whole; nodes in or below a
    circle of parents have no root and give no branch; extra columns aren't
    read; an empty table gives no rows.

    The paths are made from the jump tables, largest jump first, so that each
    (leaf, distance) is made once: the rows are those of the chosen paths.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    jumps, ends = _jumps(nodes)
    leaves = ends
    if jumps:
        parents = jumps[0].select(F.col("tree").alias("t2"), F.col("up").alias("n2")).distinct()
        leaves = ends.join(parents, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    leaves = leaves.withColumn("rank", rank)
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    paths = leaves.select("tree", F.col("node").alias("leaf"), "rank", "total", "node", F.lit(0).cast("long").alias("dist"))
    for k in reversed(range(len(jumps))):
        up = jumps[k].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        more = paths.join(up, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select("tree", "leaf", "rank", "total", F.col("up").alias("node"), (F.col("dist") + 2**k).alias("dist"))
        paths = stash(paths.unionByName(more), "paths")
    texts = messages.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    full = paths.join(texts, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
    out = full.groupBy("tree", "leaf", "rank", "total").agg(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), "role", "text"))).alias("turns"))
    out = out.select("tree", "leaf", "rank", F.col("total").alias("score"), format_turns(F.col("turns")).alias("formatted"))
    own = F.filter(F.col("parsed"), lambda t: t["role"] == answer)
    return out.withColumn("parsed", parse_turns(F.col("formatted"))).withColumn("loss_spans", F.transform(own, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))).drop("parsed")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches; rows with an equal turn follow by role, then text, nulls first."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", at)
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_branches(stash(linear_trees(rows.unionByName(extra)), "turns")).withColumn("turns", parse_turns(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    out = out.select(F.col("tree").alias("conv_id"), "turns", whole.alias("whole"), loss.alias("loss"), "formatted")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("whole", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\\', '')) + length(text) - length(replace(text, '<', '')) AS text_len,
  length(role) + length(role) - length(replace(role, '\\', '')) + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, '>', '')) AS role_len FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(text_len + role_len + 16)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
