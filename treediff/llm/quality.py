"""Quality rules as a short-circuit cascade; DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.llm.common import SPACE_RE, column, read, stash, words

#: Bound of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once and only where the result is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def repeat_words(w: Column) -> Column:
    """How many words lie in 3-word windows that the text has twice or more.

    Windows are grouped by 64-bit hash and neighbours of a group compared word
    by word. Texts without an equal pair of hashes aren't sorted.
    """

    def covered(pos: Column) -> Column:
        gap = lambda a, j: a + F.least(F.lit(3), F.element_at(pos, j) - F.element_at(pos, j - 1))
        return F.when(F.size(pos) == 0, 0).when(F.size(pos) == 1, 3).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(pos)), F.lit(3), gap))

    def in_groups(s: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            at = lambda x, k: F.element_at(w, x["i"] + k)
            a, b = F.element_at(s, a), F.element_at(s, b)
            return (a["h"] == b["h"]) & (at(a, 1) == at(b, 1)) & (at(a, 2) == at(b, 2)) & (at(a, 3) == at(b, 3))

        n = F.size(s)
        found = F.filter(F.sequence(F.lit(1), n), lambda k: F.when(k < n, same(k, k + 1)).otherwise(False) | F.when(k > 1, same(k - 1, k)).otherwise(False))
        return let(F.sort_array(F.transform(found, lambda k: F.element_at(s, k)["i"])), covered)

    def sorted_windows(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), in_groups))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    return F.when(F.size(w) < 4, 0).otherwise(let(hashes, sorted_windows)).cast("long")


def features(text: Column, w: Column) -> dict[str, Column]:
    """The measures that the rules read, each as an expression over the text and its words."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": count_matches(text, SYMBOLS).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w),
        "n_capitals": count_matches(text, "[A-Z]").cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """A text is rejected where `rejects` holds; f: a column for each measure."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


#: The limits sit far outside what prose in the corpus's languages shows: symbols are
#: rarer than one in three words, lines seldom repeat, words have 2 to 12 letters on
#: average, and capitals are a small part of the letters.
RULES = (
    Rule("short", lambda f: f["n_words"] < 50),
    Rule("repeats", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    Rule("symbols", lambda f: 10 * f["n_symbols"] > 3 * f["n_words"]),
    Rule("dup_lines", lambda f: 10 * f["n_dup_lines"] > 3 * f["n_lines"]),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 12 * f["n_words"])),
    Rule("capitals", lambda f: 2 * f["n_capitals"] > f["word_chars"]),
)
BASE = ("short", "repeats")


def sample_of(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About `rows` rows, each drawn by itself, in the shared folder."""
    total = docs.count()
    own = docs.select(F.coalesce(column(docs, text), F.lit("")).alias("text"))
    return stash(own if total <= rows else own.sample(fraction=rows / total, seed=7), "sample")


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules in the order of rejections per second on a sample, with what was estimated.

    A rule's cost is the time of its own scan of the sample beyond that of the
    word splitting alone. Rejections are conditional: each next rule is the one
    that rejects most, per cost, of what those before it left. Ties and an empty
    sample keep the given order. The order changes how much work is done and
    never which texts are rejected.
    """
    sample = sample_of(docs, text, rows).select("text", words(F.col("text")).alias("w"))
    f = features(F.col("text"), F.col("w"))

    def timed(rejects: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.count_if(rejects & (F.size("w") >= 0))).first()
        return time.perf_counter() - began

    if not rules:
        return []
    timed(F.lit(False))
    floor = timed(F.lit(False))
    cost = [max(timed(rule.rejects(f)) - floor, 0.005) for rule in rules]
    hits = sample.select(F.array(*[F.coalesce(rule.rejects(f), F.lit(False)) for rule in rules]).alias("hits"))
    groups = [(r["hits"], r["n"]) for r in hits.groupBy("hits").agg(F.count("*").alias("n")).collect()]  # at most 2 ** len(rules) rows
    total, found, left = max(1, sum(n for _, n in groups)), [], list(range(len(rules)))
    while left:
        gain = {k: sum(n for h, n in groups if h[k]) for k in left}
        best = max(left, key=lambda k: gain[k] / cost[k])
        found.append({"rule": rules[best], "cost": cost[best] / total, "rejects": gain[best] / total})
        groups = [(h, n) for h, n in groups if not h[best]]
        left.remove(best)
    return found


def verdict(f: dict[str, Column], order: list[Rule]) -> Column:
    """The first rule of the order that rejects, else null; later rules aren't evaluated."""
    out = None
    for rule in order:
        hit = F.lit(rule.name)
        out = F.when(rule.rejects(f), hit) if out is None else out.when(rule.rejects(f), hit)
    return out if out is not None else F.lit(None).cast("string")


#: What the result of `measure` shows of every row; other measures are taken when a rule that reads them is reached.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, the measures in SHOWN, base_failed, kept, rejected_by.

    A null or blank text has no words and fails the base rules. Repeated rows
    are judged alike and all returned; an empty table gives no rows; other
    columns of docs aren't read; very long texts are measured whole. Rules beside
    the base ones are tried in the planned order, on rows that passed all before.
    """
    order = [x["rule"] for x in plan_cascade(docs, rules, text)]
    body = docs.select(column(docs, key).alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    body = body.withColumn("w", words(F.col("text")))
    every = features(F.col("text"), F.col("w"))
    each = body.select("doc_id", "text", "w", *(every[k].alias(k) for k in SHOWN))
    f = every | {k: F.col(k) for k in SHOWN}
    base = [r for r in rules if r.name in BASE]
    failed = F.coalesce(*[F.when(r.rejects(f), True) for r in base], F.lit(False)) if base else F.lit(False)
    by = F.when(failed, verdict(f, base)).otherwise(verdict(f, [r for r in order if r.name not in BASE]))
    return each.select("doc_id", *SHOWN, failed.alias("base_failed"), by.alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, unchanged; a measure is taken only when its rule is reached.

    Null and blank texts have no words and go (the rule on short texts); repeated
    rows stay or go together; all columns are carried, whatever their names; an
    empty table gives no rows.
    """
    order = [x["rule"] for x in plan_cascade(docs, rules, text)]
    # bound by let: the optimiser moves a filter below the column that it reads, which would split the text anew for each word
    body = F.coalesce(column(docs, text), F.lit(""))
    by = let(body, lambda t: let(words(t), lambda w: verdict(features(t, w), order)))
    return docs.where(by.isNull())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT u, doc_id, text, list_filter(string_split_regex(text, '{SPACE_RE}'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
m AS (SELECT u, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals FROM w),
p AS (SELECT u, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT u, i, count(*) OVER (PARTITION BY u, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT u, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT u, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY u),
f AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (u))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 2 * n_capitals > word_chars) AS kept
FROM f
"""
