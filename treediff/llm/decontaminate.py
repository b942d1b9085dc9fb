"""Test items inside documents: size-partitioned MinHash containment search; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.llm.common import column, free_names, read, stash
from treediff.llm.licences import normal_words

SHINGLE, FIFTHS = 5, 4
#: Items of fewer words aren't searched: ordinary prose has them ("the", "of the").
LEAST_WORDS = 3
#: Rows of the items' shingles that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shingles(w: Column, k: int) -> Column:
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.concat_ws(" ", *[F.element_at(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(w: Column, k: int) -> Column:
    """A hash of each shingle, equal for equal words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def item_index(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, k, n, need, shingle, hash, sketch): a row for each shingle of each item.

    An item of n distinct shingles is contained by 4/5 in a text that has at
    least `need` of them, so any n - need + 1 of them include one that the text
    has. The sketch is the item's smallest hashes, as many as the largest item
    of its size partition (powers of two) needs; no contained item is missed.
    Items of three or four words are one shingle, which must be in the text as it
    is; items of fewer than LEAST_WORDS words have no rows and are in no result.
    """
    t = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), normal_words(F.coalesce(F.col(text), F.lit(""))).alias("w")).distinct().where(F.size("w") >= LEAST_WORDS)
    t = t.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    own = F.lit(None).cast("array<string>")
    for k in range(1, SHINGLE + 1):
        own = F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(own)
    t = t.withColumn("s", F.array_distinct(own)).withColumn("n", F.size("s")).withColumn("need", F.expr(f"(n * {FIFTHS} + 4) div 5"))
    t = t.withColumn("part", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    size = t.groupBy("part").agg(F.max(F.col("n") - F.col("need") + 1).alias("take"))
    words_of = lambda s: F.split(s, " ")
    hashed = F.transform("s", lambda s: F.struct(F.coalesce(*[F.when(F.size(words_of(s)) == k, F.xxhash64(*[F.element_at(words_of(s), j + 1) for j in range(k)])) for k in range(1, SHINGLE + 1)]).alias("hash"), s.alias("shingle")))
    t = t.join(F.broadcast(size), "part").withColumn("s", F.sort_array(hashed))
    return t.select("item", "k", "n", "need", "take", F.posexplode("s").alias("at", "x")).select("item", "k", "n", "need", "x.shingle", "x.hash", (F.col("at") < F.col("take")).alias("sketch"))


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, __text_hash, item_id, n_shingles, n_found, containment): pairs of containment >= 4/5, once each.

    Words are lower-case runs of letters and digits, shingles five of them.
    Null and empty texts and items match nothing; repeated rows of docs give one
    row, items that share an id are items of their own (the better one counts);
    an empty table on either side gives no rows; extra columns aren't read.

    The first pass joins the documents' shingle hashes with the items' sketches
    and keeps distinct pairs. Only documents with a candidate are read again,
    and their shingles counted exactly, as strings.
    """
    index = stash(item_index(items, item_key, item_text), "items")
    kinds = sorted(r[0] for r in index.select("k").distinct().collect())  # at most five values
    small = index.count() <= BROADCAST_ROWS
    held = F.broadcast if small else (lambda df: df)
    body = F.coalesce(column(docs, text), F.lit(""))
    rows = docs.select(column(docs, key).alias("doc_id"), F.xxhash64(body).alias("text_hash"), normal_words(body).alias("w"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    hashes = F.concat(*[shingle_hashes(F.col("w"), k) for k in kinds], empty("bigint"))
    sketch = index.where("sketch").select("item", "hash").distinct()
    likely = rows.select("doc_id", "text_hash", F.explode(hashes).alias("hash")).join(held(sketch), "hash").select("doc_id", "text_hash", "item").distinct()
    likely = stash(likely, "candidates")
    keys = likely.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    again = docs.select(column(docs, key).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    again = again.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    again = again.select("doc_id", "text_hash", normal_words(F.col("body")).alias("w"))
    texts = F.array_distinct(F.concat(*[shingles(F.col("w"), k) for k in kinds], empty("string")))
    met = again.select("doc_id", "text_hash", F.explode(texts).alias("shingle"))
    met = met.join(held(index.select("shingle", "item", "k", "n", "need")), "shingle")
    met = met.select("doc_id", "text_hash", "item", "n", "need", "shingle").distinct()
    found = met.groupBy("doc_id", "text_hash", "item", "n", "need").agg(F.count("*").alias("n_found")).where("n_found >= need")
    found = found.groupBy("doc_id", "text_hash", "item").agg(F.max_by(F.struct("n", "n_found"), F.col("n_found") / F.col("n")).alias("b"))
    mate = likely.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("item").alias("i"))
    found = found.join(mate, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("item") == F.col("i")), "left_semi")
    return found.select("doc_id", F.col("text_hash").alias("__text_hash"), F.col("item").alias("item_id"), F.col("b.n").cast("long").alias("n_shingles"), F.col("b.n_found").alias("n_found"), (F.col("b.n_found") / F.col("b.n")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that contain no item.

    All columns are carried, whatever their names. Null and empty texts contain
    nothing and stay, rows without a key are judged by their texts alone,
    repeated rows stay or go together; without items all rows stay.
    """
    body = F.coalesce(column(docs, text), F.lit(""))
    k, h = free_names(docs, "hit_key", "hit_text")
    hit = contained(docs, items, key, text).select(F.col("doc_id").alias(k), F.col("__text_hash").alias(h)).distinct()
    return docs.join(hit, column(docs, key).eqNullSafe(hit[k]) & (F.xxhash64(body) == hit[h]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shingles", "n_found", "containment"), "containment").alias("b")).select("doc_id", "item_id", "b.*")


SQL = """
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ik AS (SELECT item_id, least(len(w), 5) AS k, w FROM i WHERE len(w) >= 3),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM ik)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
d AS (SELECT row_number() OVER () AS u, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT DISTINCT u, doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT u, doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k)),
m AS (SELECT u, doc_id, item_id, count(*) AS f FROM ds JOIN s USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, max(f)::BIGINT AS n_found, (max(f) / n)::DOUBLE AS containment
FROM m JOIN n USING (item_id) WHERE 5 * f >= 4 * n GROUP BY doc_id, item_id, n
"""
