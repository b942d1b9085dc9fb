"""The training-data operators against brute force, exact round trips and SQL, over small tables with odd rows."""

import os
import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from treediff.llm import bpe, chat, components, decontaminate, licences, mixing, quality, sharding, simhash, substrings, toxicity
from treediff.llm.common import SPACES, words

VOCAB = "abcdefghij"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __x string"


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) * rng.randint(1, 4) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, repeated rows, nulls, blank and long texts."""
    rng = random.Random(11)
    passage, long = prose(rng, 60), prose(rng, 3000)
    rows = [(k, prose(rng, rng.randint(1, 120))) for k in range(40)]
    rows += [(100 + k, f"{prose(rng, 20)} {passage}\n{prose(rng, 10)}") for k in range(5)]
    rows += [(200 + k, long) for k in range(3)] + [(210, long + " tail"), (210, long + " tail")]
    return [*rows, (300, None), (301, ""), (302, " \t\n"), (303, "Ünï code Zwölf\x0bmal"), (None, "no id here")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x") for k, t in texts], DOCS).repartition(3).cache()


def split(t):
    return [w for w in "".join(" " if c in SPACES else c for c in t or "").split(" ") if w]


def test_words(docs, texts):
    got = Counter(tuple(r["w"]) for r in docs.select(words(F.col("text")).alias("w")).collect())
    assert got == Counter(tuple(split(t)) for _, t in texts)


def test_quality_against_a_loop(docs, texts):
    want = Counter()
    for k, t in texts:
        w, t = split(t), t or ""
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if split(x)]
        want[k, len(w), len("".join(w)), len(rep), len(lines) - len(set(lines)), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    rows = quality.measure(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"], r["base_failed"]) for r in rows) == want
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])
    assert quality.measure(docs.limit(0)).count() == 0


def test_later_rules_dont_run_on_rejected_rows(spark):
    """A rule that fails when it is evaluated isn't, where an earlier one rejects; samples keep their bound."""
    boom = quality.Rule("boom", lambda f: F.raise_error(F.lit("evaluated")).cast("boolean"))
    short = quality.Rule("short", lambda f: f["n_words"] < 50)
    f = {"n_words": F.col("n")}
    rows = spark.range(100).select((F.col("id") % 50).alias("n"))
    assert {r[0] for r in rows.select(quality.verdict(f, [short, boom])).collect()} == {"short"}
    with pytest.raises(Exception, match="evaluated"):
        rows.select(quality.verdict(f, [boom, short])).collect()
    many = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "a b c").alias("text"))
    assert 500 < quality.sample_of(many, "text", 1000).count() < 1500
    plan = quality.plan_cascade(many)
    assert {x["rule"].name for x in plan} == {r.name for r in quality.RULES} and sum(x["rejects"] for x in plan) <= 1.0 + 1e-9


def test_substrings_against_a_loop(docs, texts):
    ws = [split(t) for _, t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in ws for i in range(len(w) - 34))
    want = Counter()
    for (k, _), w in zip(texts, ws):
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        want[k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    got = substrings.remove_repeats(docs)
    assert Counter((r["doc_id"], r["__n_words"], r["__n_removed"], r["__kept"]) for r in got.collect()) == want
    assert sum(n for (_, _, n, _) in want) > 0
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    clash = docs.withColumnsRenamed({"lang": "__kept", "source": "__n_words"}).withColumn("a.b", F.lit(1))
    got = substrings.remove_repeats(clash, replace=True)
    assert got.columns == [*clash.columns, "___n_words", "__n_removed"]
    put = {(k, n, g): kept for k, n, g, kept in want}
    whole = {(k, len(split(t))): t for k, t in texts}
    for r in got.collect():
        k = (r["doc_id"], r["___n_words"], r["__n_removed"])
        assert r["text"] == (put[k] if k[2] else whole[k[:2]])


def test_substrings_of_one_passage_in_every_text(spark, monkeypatch):
    """A passage that all texts share, over many chunks and split buckets, gives the same as a loop."""
    rng = random.Random(5)
    passage = prose(rng, 90)
    rows = [(k, f"{prose(rng, rng.randint(0, 60))} {passage} {prose(rng, rng.randint(0, 60))}") for k in range(60)]
    ws = [split(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in ws for i in range(len(w) - 34))
    want = {(k, len({i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)})) for (k, _), w in zip(rows, ws)}
    import pyarrow as pa

    monkeypatch.setattr(substrings, "CHUNK", 2000)
    monkeypatch.setattr(substrings, "SPLIT", 3000)
    for remembered in (0, 10**6):
        monkeypatch.setattr(substrings, "REMEMBERED", remembered)
        batches, gone = [], {k: set() for k, _ in rows}
        for part in (rows[:20], rows[20:]):
            batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([7 for _ in part]), pa.array([t for _, t in part])], ["doc_id", "mark", "text"])
            batches += substrings.deal_out(35, 3, 2)(iter([batch]))
        table = pa.Table.from_batches(batches)
        for bucket in (0, 1):
            own = table.filter(pa.compute.equal(table["bucket"], bucket))
            for r in substrings.count_windows(35, 3)(own).to_pylist():
                gone[r["doc_id"]] |= set(range(r["first"], r["last"]))
        assert {(k, len(v)) for k, v in gone.items()} == want
        sent = sum(len(x) for x in table["texts"].drop_null().to_pylist())
    assert sent  # the second, remembering run


def brute_fingerprint(t):
    w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(pairs, keys):
    low = {k: k for k in keys}
    for _ in keys:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_simhash_against_all_pairs(docs, texts):
    rows = [(k, brute_fingerprint(t)) for k, t in texts]
    fps = sorted({f for _, f in rows})
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    root = union(near, fps)
    first = {}
    for k, f in rows:
        if k is not None:
            first[root[f]] = min(k, first.get(root[f], k))
    got = {(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(k, f, first.get(root[f])) for k, f in rows}
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(first.values()))


def test_one_row_of_each_component_stays_whatever_ids_are_shared(spark):
    rng = random.Random(41)
    a, b, c = (prose_of(rng, 80) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (6, b), (6, c), (6, c), (7, c + " x"), (None, c), (8, None), (8, ""), (9, " ")]
    kept = Counter((r["k"], r["t"]) for r in simhash.keep_one(spark.createDataFrame(rows, "k long, t string").repartition(4), "k", "t").collect())
    near = brute_fingerprint(c) ^ brute_fingerprint(c + " x")
    blank = [x for x in kept if x[0] == 8]
    assert len(blank) == 1 and not (x := {k for k in kept if k[0] == 9}), x
    assert kept - Counter(blank) == Counter([(1, a), (5, b), (6, c), (None, c)] + [(7, c + " x")] * (near.bit_count() > 4))


def prose_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_many_equal_rows_lose_their_passages_in_one_set_of_ranges(spark):
    text, n = prose_of(random.Random(42), 60), 20_000
    rows = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(1, text.upper())], "doc_id long, text string"))
    out = substrings.remove_repeats(rows.repartition(8)).groupBy("__n_words", "__n_removed").count().collect()
    assert {(r["__n_words"], r["__n_removed"], r["count"]) for r in out} == {(60, 60, n), (60, 0, 1)}


def test_byte_triples_meet_every_four_bytes():
    from itertools import combinations

    triples = [set(t) for t in simhash.byte_triples()]
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_components_against_union(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    want = union(edges, sorted({v for e in edges for v in e}))
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {v: r for v, r in want.items() if v in got} and set(want) - set(got) <= {a for a, b in edges if a == b}


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    lib = Tokenizer.from_file(path)
    lib.no_truncation(), lib.no_padding()
    odd = ["<|endoftext|> hi <|startoftext|>", "don't we'LL 3D 日本語 ﬁ", "é \U0001f600​ x", "a" * 5000]
    rows = [(k, t) for k, t in enumerate([*(t for _, t in texts), *odd])]
    got = {r["doc_id"]: r for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert [int.from_bytes(got[k]["ids"][i : i + 4], "little") for i in range(0, len(got[k]["ids"]), 4)] == ids, t
        assert got[k]["decoded"] == lib.decode(ids, skip_special_tokens=False) and got[k]["n_tokens"] == len(ids)


def test_contained_items(spark, docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "tiny little item"), (3, None), (4, "")], "item_id long, text string")
    extra = spark.createDataFrame([(1, "x One two, three four five six seven eight nine TEN y"), (2, "one two three four five six six seven"), (3, "a tiny little item here"), (4, None), (1, "clean")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_found"]) for r in decontaminate.contained(extra, items).collect()}
    assert got == {(1, 1, 6), (3, 2, 1)}
    left = decontaminate.remove_contaminated(extra, items).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"] == 1) == [(1, "clean")] and len(left) == 3
    assert decontaminate.contained(docs, items.limit(0)).count() == 0


def test_licences(spark):
    notice = licences.NOTICES["gpl-3.0"]
    rows = [(1, f"text\n{notice}\nmore"), (2, notice.replace("version 3", "version 2")), (3, "Released, perhaps."), (4, None)]
    got = {(r["doc_id"], r["line"], r["licence"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (1, 1, "gpl-3.0") in got and (2, 0, "gpl-2.0") in got and {k for k, _, _ in got} == {1, 2}


def brute_windows(text):
    """(line, licence, dice) of windows, tried one by one."""
    import re

    norm = lambda x: re.findall(r"[^\W_]+", x.lower())
    bag = lambda w: Counter(zip(w, w[1:]))
    temps = {k: norm(v) for k, v in licences.NOTICES.items()}

    def dice(w, t):
        return 2.0 * (bag(w) & bag(t)).total() / max(1, len(w) + len(t) - 2)

    unit = lambda w: len(w) > 1 and any(dice(w, t) >= 0.8 for t in temps.values())
    lines = [norm(x) for x in text.split("\n")]
    w, of = [x for ws in lines for x in ws], [k for k, ws in enumerate(lines) for _ in ws]
    if len(lines) > 1 and unit(w):
        return []

    def apart(xs, place):
        out = []
        for x in xs:
            s, e = place(x)
            if all(e < a or b < s for a, b in map(place, out)):
                out.append(x)
        return out

    found = []
    for k, t in temps.items():
        best = []
        for s in range(len(w) - 1):
            d, e = max(((dice(w[s : e + 1], t), -e) for e in range(s + 1, min(len(w), s + 2 * len(t)))), default=(0, 0))
            if d >= 0.8:
                best.append((-d, s, -e))
        found += [(-(bag(w[s : e + 1]) & bag(t)).total(), d, k, s, e) for d, s, e in apart(sorted(best), lambda x: x[1:])]
    return [(of[s], k, -d) for _, d, k, s, e in apart(sorted(found), lambda x: x[3:]) if of[s] != of[e] or not unit(lines[of[s]])]


def test_licences_in_windows(spark):
    rng, n = random.Random(6), licences.NOTICES
    wrap = lambda x, k: "\n".join(" # " + " ".join(x.split()[i : i + k]) for i in range(0, len(x.split()), k))
    texts = [
        f"{prose(rng, 150)}\n{wrap(n['apache-2.0-header'], 11)}\n{prose(rng, 150)}",
        f"{wrap(n['mit-grant'], 9)}\n{prose(rng, 200)}",
        f"{prose(rng, 30)} it is licensed under the Apache License, Version 2.0, and {prose(rng, 30)}",
        f"{prose(rng, 40)} {n['mit']} {n['mit']}\n{prose(rng, 9)} Released under\nthe MIT License. {prose(rng, 9)}",
        f"{prose(rng, 20)}\n{n['gpl-3.0']}\n{prose(rng, 20)}",
        f"{prose(rng, 5)} Licensed under CC BY-NC 4.0, or this work is licensed under the GNU General Public License version 2 or later {prose(rng, 5)}",
        "license", "Released under", "the the license of the software the software", "",
    ]
    header = n["mit-grant"].split()
    for _ in range(2):
        texts.append(" ".join([*prose(rng, 60).split(), *(x for x in header if rng.random() < 0.95), *prose(rng, 60).split()]))
    rows = [(k, x) for k, x in enumerate([*texts, texts[2]])] + [(2, texts[2]), (99, None)]
    got = Counter((r["doc_id"], r["line"], r["licence"], r["dice"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {(k, c) for k, _, c, _ in got} >= {(0, "apache-2.0-header"), (1, "mit-grant"), (2, "apache-2.0"), (3, "mit"), (5, "cc-by-nc-4.0"), (5, "gpl-2.0")}
    want = Counter((k, *x) for k, t in rows for x in brute_windows(t or ""))
    assert not want - got
    extra = {(k, line, c) for k, line, c, _ in got - want}
    assert extra == {(4, 1, "gpl-3.0")} and got[2, 0, "apache-2.0", 1.0] == 2
    assert sum(n for (k, *_), n in got.items() if k == 3) == 3


def test_items_of_few_words(spark):
    items = spark.createDataFrame([(1, "The"), (2, "of the"), (3, "three words here"), (4, "now four words here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "The end of the day: three words, here and now."), (2, "Three words. Here!")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()} == {(1, 3), (2, 3)}


def test_removal_carries_clashing_names(spark):
    rows = spark.createDataFrame([(1, "one two three four five six", "x", 1, "y"), (1, None, "x", 2, None), (None, "z one two three four five six", None, None, None)], "doc_id long, text string, hit_key string, kept long, `a.b` string")
    items = spark.createDataFrame([(7, "two three four five six")], "item_id long, text string")
    assert [r["kept"] for r in decontaminate.remove_contaminated(rows, items).collect()] == [2]
    assert decontaminate.remove_contaminated(rows, items.limit(0)).count() == 3
    assert sorted(str(r["kept"]) for r in simhash.keep_one(rows).collect()) == ["1", "2", "None"]
    assert simhash.keep_one(rows.limit(0)).count() == 0 and simhash.keep_one(rows).columns == rows.columns
    assert quality.keep(rows, ()).columns == rows.columns


def test_jump_hash_moves_only_into_new_shards(spark):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = [*range(-50, 400), 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), 8).alias("a"), sharding.jump_hash(F.col("k"), 9).alias("b")).collect()
    for r in rows:
        assert r["a"] == jump(r["k"] % 2**64, 8) and r["b"] == jump(r["k"] % 2**64, 9) and r["b"] in (r["a"], 8)


def test_shards_have_gapless_slots(docs, texts):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)


def test_branches_round_trip(spark):
    nasty = "\\### </turn>\n<turn user>\n\\b<b>"
    rows = [("t", 1, None, "user", nasty, 1.0), ("t", 2, 1, "assistant", "ok <", 1.0), ("t", 3, 1, "assistant", None, 5.0), ("t", 4, 2, "user", "more", 1.0), ("t", 8, 9, "user", "circle", 1.0), ("t", 9, 8, "user", "circle", 1.0), (None, 1, None, None, "solo", None)]
    msgs = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_branches(msgs, best=None).withColumn("turns", chat.parse_turns(F.col("formatted"))).collect()
    got = {(r["tree"], r["leaf"], r["rank"]): [(t["role"], t["text"]) for t in r["turns"]] for r in out}
    assert got == {("t", 3, 1): [("user", nasty), ("assistant", "")], ("t", 4, 2): [("user", nasty), ("assistant", "ok <"), ("user", "more")], (None, 1, 1): [("", "solo")]}


def test_mixing_scores_beat_counts_on_held_out_texts(spark):
    rng = random.Random(2)
    after = {w: [rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(2)] for w in [a + b for a in VOCAB for b in VOCAB]}

    def text():
        w = [rng.choice(list(after))]
        for _ in range(rng.randint(1, 80)):
            w.append(rng.choice(after[w[-1]]))
        return " ".join(w)

    rows = [(k, text()) for k in range(400)] + [(1000, None), (1001, "never Seen wordz")]
    got = {r["doc_id"]: r for r in mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    toks = lambda t: [*split((t or "").lower()), "\n"]
    c = Counter(w for k, t in rows if not held(k) for w in toks(t))
    n, v = sum(c.values()), len(c)
    import math

    for k, t in rows:
        w = toks(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(k), len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.8 * sum(r["base_score"] for r in out)


def test_code_is_a_probability():
    import numpy as np

    code = mixing.Code(np.array([3.0, 5.0, 1.0, 0.5]))
    assert abs(sum(2.0 ** -int(n) for n in code.length) - 1) < 1e-9


def small_model(n_words, slots=22, seed=0):
    """A model with counts, learned from random symbols, and uneven weights."""
    import numpy as np

    rng = np.random.default_rng(seed)
    code = mixing.Code(rng.integers(1, 50, n_words + 1).astype(float))
    states = [rng.integers(0, 1 << 16, n, dtype=np.uint16) for n in (len(code.masses), 1 << slots, 1 << slots)]
    weights = np.round(rng.uniform(0, 0.6, (mixing.GATES, mixing.INPUTS)), 4).astype(np.float32)
    return mixing.Model(code, slots, states, weights, [mixing.ODDS.take(x) for x in states])


def slow_score(model, symbols):
    """One text, bit by bit, with dictionaries for what it has shown."""
    import math

    import numpy as np

    code, none = model.code, len(model.code.masses)
    ln = lambda zero, one: math.log((one + 0.4) / (zero + 0.4))
    seen3, seen4 = {}, {}
    factor, weight = [1.0] * 5, [0.0] * 5
    cells = [[0, 0] for _ in range(mixing.CELLS)]
    total, at = 0.0, 0
    bounds = [32 << k for k in range(8)]
    while at < len(symbols):
        end = next((b for b in bounds if b > at), 4096 * (at // 4096 + 1))
        slope, new = [0.0] * 5, []
        for i in range(at, min(end, len(symbols))):
            one = int(symbols[i - 1]) if i > 0 else none
            two = int(symbols[i - 2]) if i > 1 else none
            bits = mixing.decide(code, model.slots, np.array([symbols[i]]), np.array([one], np.int32), np.array([two], np.int32))
            for j in range(len(bits.bit)):
                y, depth = int(bits.bit[j]), int(bits.depth[j])
                x = [float(model.odds[k][bits.slots[k][j]]) / mixing.STEPS for k in range(3)]
                c3, c4 = seen3.setdefault(int(bits.mark[j]), [0, 0]), seen4.setdefault(int(bits.after[j]), [0, 0])
                x += [ln(*c3), ln(*c4)]
                gate = 3 * depth + (2 if x[4] else 1 if x[2] else 0)
                v = [float(model.weights[gate, k]) * x[k] for k in range(5)]
                dot = min(11.0, max(-11.0, sum(f * z for f, z in zip(factor, v))))
                q = 1 / (1 + math.exp(-dot))
                cell = int(min(mixing.CELLS - 1, max(0, dot * 2 + mixing.CELLS // 2)))
                n, n1 = cells[cell]
                p = 0.5 * q + 0.5 * (n1 + mixing.MAP_PRIOR * q) / (n + mixing.MAP_PRIOR)
                total += math.log(p if y else 1 - p)
                new.append((cell, y))
                slope = [g + z * (y - q) for g, z in zip(slope, v)]
                c3[y] += 1
                c4[y] += 1
        for cell, y in new:
            cells[cell][0] += 1
            cells[cell][1] += y
        weight = [w + g * g for w, g in zip(weight, slope)]
        factor = [min(3.0, max(0.0, f + mixing.RATE * g / math.sqrt(w + mixing.FACTOR_PRIOR))) for f, g, w in zip(factor, slope, weight)]
        at = end
    return total / math.log(10)


def test_mixer_equals_a_bit_by_bit_one():
    import numpy as np

    rng = np.random.default_rng(1)
    model = small_model(60)
    texts = [rng.integers(0, 61, n).astype(np.uint16) for n in (1, 2, 33, 150, 700, 1)]
    got = mixing.score_texts(model, texts)
    for x, s in zip(texts, got):
        assert abs(s - slow_score(model, x)) < 2e-4 * abs(s) + 1e-3
        assert abs(s - mixing.score_texts(model, [x])[0]) < 1e-5 * abs(s) + 1e-6


def test_mixer_goes_through_a_long_text_in_pieces():
    """Pieces of a long text remember what came before: a text that repeats itself after a piece is cheap there."""
    import numpy as np

    rng = np.random.default_rng(2)
    model = small_model(3000)
    model.weights[:] = [0, 0, 0, 0.3, 1]  # only the text's own contexts
    half = rng.integers(0, 3001, mixing.PIECE).astype(np.uint16)
    once, twice = (mixing.score_texts(model, [np.concatenate(x)])[0] for x in ([half, rng.integers(0, 3001, mixing.PIECE).astype(np.uint16)], [half, half]))
    assert twice > 0.9 * once
    short = rng.integers(0, 61, 2 * mixing.PIECE + 5).astype(np.uint16)
    assert np.isfinite(mixing.score_texts(small_model(60), [short])).all()


def test_history_counts_what_came_before():
    import numpy as np

    rng = np.random.default_rng(3)
    lane, mark = np.sort(rng.integers(0, 5, 400)).astype(np.int32), (rng.integers(0, 7, 400) * 123456789).astype(np.uint32)
    bit, seen = rng.integers(0, 2, 400).astype(np.uint8), {}
    got = mixing.history(lane, mark, bit)
    past, again = mixing.Past(), []
    for i in range(400):
        zero, one = seen.setdefault((lane[i], mark[i]), [0, 0])
        assert abs(got[i] - np.log((one + 0.4) / (zero + 0.4))) < 1e-5
        seen[lane[i], mark[i]][bit[i]] += 1
    lane[:] = 0
    whole = mixing.history(lane, mark, bit)
    for part in (slice(0, 150), slice(150, 390), slice(390, 400)):
        again.append(mixing.history(lane[part], mark[part], bit[part], past))
    assert np.allclose(np.concatenate(again), whole, atol=1e-5)


def test_texts_own_contexts_are_counted_exactly():
    """Of long texts side by side too: no two contexts of a text share counts."""
    import numpy as np

    rng = np.random.default_rng(6)
    model = small_model(40_000, slots=16)
    texts = [np.append(rng.integers(0, 40_001, n), rng.integers(0, 9, n // 20)).astype(np.uint16) for n in (15_000, 12_000, 3, 1)]
    bits, lane, one, _ = mixing.lay_out(model, texts)
    each = np.repeat(lane, bits.size)
    x, _ = mixing.inputs(model, bits, each, mixing.recurring(lane, one), None, False)
    before, seen3, seen4 = np.repeat(one, bits.size), {}, {}
    want = np.empty((2, len(each)))
    for i, (t, node, w, y) in enumerate(zip(each.tolist(), bits.slots[0].tolist(), before.tolist(), bits.bit.tolist())):
        for k, c in enumerate((seen3.setdefault((t, node), [0, 0]), seen4.setdefault((t, node, w), [0, 0]))):
            want[k, i] = (c[1] + 0.4) / (c[0] + 0.4)
            c[y] += 1
    assert np.abs(x[3:] - np.log(want)).max() < 1e-4


def test_words_told_apart_in_slices_are_those_of_split(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(mixing, "SLICE", 20)
    texts = ["A\x0bB\tb  a\r\n", None, "", " \n ", "é x\x1cy Ä \u2003", "a b\x00 A", "word " * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = []
    for begin, part in mixing.slices(batch, 0):
        assert begin == len(got)
        w = mixing.Words.of(part)
        kinds, at = w.kinds.to_pylist(), 0
        for end in w.ends.tolist():
            got.append([kinds[c] for c in w.codes[at:end].tolist()])
            at = end
    assert got == [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    found = Counter()
    for b in mixing._count_words(iter([batch])):
        for r in b.to_pylist():
            found[r["word"]] += r["c"]
    assert found == Counter(w for t in got for w in t)


def test_weights_follow_the_slope():
    """The gradient over the weights is that of the log likelihood, by differences."""
    import numpy as np

    model = small_model(40)
    texts = [np.random.default_rng(4).integers(0, 41, 90).astype(np.uint16)]

    def likelihood(weights):
        bits, lane, one, _ = mixing.lay_out(model, texts)
        x, gate = mixing.inputs(model, bits, np.repeat(lane, bits.size), mixing.recurring(lane, one), None, True)
        z = np.clip((weights[gate].T * x).sum(axis=0), -11, 11)
        return np.sum(np.where(bits.bit == 1, -np.logaddexp(0, -z), -np.logaddexp(0, z)))

    w = model.weights.astype(float) * 0.2
    model.weights = w
    g, h = mixing.slopes(model, texts)
    for j, k in ((3, 0), (7, 3), (12, 1)):
        up, down = w.copy(), w.copy()
        up[j, k] += 1e-4
        down[j, k] -= 1e-4
        assert abs((likelihood(up) - likelihood(down)) / 2e-4 - g[j, k]) < 1e-2 * max(1, abs(g[j, k]))
    assert likelihood(mixing.newton(w, g, h)) > likelihood(w)


def test_weights_are_fitted_on_all_training_texts(spark, monkeypatch):
    """However many tokens the corpus has, no text is left out of the fit."""
    import dataclasses

    import numpy as np

    monkeypatch.setattr(mixing, "MOST_SLOTS", mixing.LEAST_SLOTS)  # the same slots for both
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 41, 60).astype(np.uint16) for _ in range(30)]
    of = np.bincount(np.concatenate(texts), minlength=41)
    encoded = spark.createDataFrame([(k, len(x), bytearray(x.tobytes())) for k, x in enumerate(texts)], "doc_id long, n_tokens long, symbols binary")
    few = mixing.Vocabulary(mixing.Names([b"x"], 40), of[:1], of + 0.5, 1800, 41)
    small, large = (mixing.train(encoded, v).weights for v in (few, dataclasses.replace(few, known=1 << 40)))
    assert (small == large).all() and (large != np.tile(mixing.START, (mixing.GATES, 1))).any()


def test_scores_dont_depend_on_partitions(spark, docs):
    rows = docs.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), F.reverse("text").alias("text")))
    got = [{(r["doc_id"], r["n_tokens"], r["text_bytes"]): r for r in mixing.score(rows.repartition(n)).collect()} for n in (1, 8)]
    assert got[0].keys() == got[1].keys()
    for k, r in got[0].items():
        assert abs(r["score"] - got[1][k]["score"]) <= 1e-6 * abs(r["score"]) and abs(r["base_score"] - got[1][k]["base_score"]) < 1e-9 * abs(r["base_score"])
        assert abs(r["bits"] + r["score"] * 3.321928094887362) < 1e-6 * r["bits"] and (r["bits_per_byte"] is None) == (r["text_bytes"] == 0)
    assert mixing.score(docs.limit(0)).count() == 0


def test_toxicity_finds_marked_texts(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, 40) + (" vile scum" if k % 4 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 8 > 3), int(k % 4 == 0)) for k in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.severity(docs, toxicity.fit_sample(docs, labels)).collect()}
    hits = [got[k]["toxic"] == (k % 4 == 0) for k in range(200, 400)]
    assert sum(hits) >= 190 and not got[900]["toxic"]
    assert toxicity.fit([]).above(__import__("numpy").zeros(1)).shape[1] >= 1


def test_toxicity_slopes_are_those_of_the_likelihood():
    """The gradient by differences, and the fit in memory against that on the executors' counts."""
    import numpy as np

    rng = np.random.default_rng(5)
    n, k = 40, 6
    row, col, grades = np.repeat(np.arange(n), 3), rng.integers(0, k, 3 * n), rng.integers(0, 3, n)
    weight, first, gap = rng.normal(size=k), 0.3, np.array([0.2])

    def brute(w, f, g):
        theta = [f, f + np.exp(g[0])]
        total = 0.0
        for i in range(n):
            z = sum(w[col[j]] for j in range(3 * n) if row[j] == i)
            above = [1.0, *(1 / (1 + np.exp(-(z - t))) for t in theta), 0.0]
            total -= np.log(above[grades[i]] - above[grades[i] + 1])
        return total

    value, (g_w, g_f, g_g) = toxicity.loss(weight, first, gap, col, row, grades)
    assert abs(value - brute(weight, first, gap)) < 1e-8
    e = 1e-6
    for j in range(k):
        d = np.eye(k)[j] * e
        assert abs((brute(weight + d, first, gap) - brute(weight - d, first, gap)) / (2 * e) - g_w[j]) < 1e-4
    assert abs((brute(weight, first + e, gap) - brute(weight, first - e, gap)) / (2 * e) - g_f[0]) < 1e-4
    assert abs((brute(weight, first, gap + e) - brute(weight, first, gap - e)) / (2 * e) - g_g[0]) < 1e-4


def test_toxicity_on_executors_equals_that_in_memory(spark):
    rng = random.Random(21)
    rows = [(k, prose(rng, 30) + (" Vile scum" if k % 4 == 0 else "") + (" worse" if k % 8 == 0 else "")) for k in range(120)]
    docs = spark.createDataFrame([*rows, *rows[:30], (500, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 8 > 0), int(k % 4 == 0)) for k in range(120)] + [(4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_sample(docs, labels)
    want = toxicity.fit([(toxicity.text_words(t), 0 if k % 4 else 2 if k % 8 == 0 else 1) for k, t in rows])
    assert model.weights.keys() == want.weights.keys() and all(abs(model.weights[w] - want.weights[w]) < 1e-3 for w in want.weights)
    assert abs(model.thresholds - want.thresholds).max() < 1e-3
    got = {r["doc_id"]: r for r in toxicity.severity(docs, model).collect()}
    assert got[0]["severity"] > got[4]["severity"] > got[1]["severity"] and got[500]["severity"] < toxicity.CUT
    assert len(toxicity.fit_sample(docs, labels, rows=10).thresholds) >= 1
    assert toxicity.severity(docs.limit(0), model).count() == 0


def test_toxicity_learns_from_few_labels():
    """No word is in 8 texts: 87 labelled ones, 10 of them toxic; words of single texts are no features."""
    rng = random.Random(12)
    clean = lambda k: {*prose(rng, 40).split(), f"only{k}"}
    rows = [(clean(k) | ({"vile" if k % 2 else "scum"} if k < 10 else set()), int(k < 10)) for k in range(87)]
    model = toxicity.fit(rows)
    assert {"vile", "scum"} <= set(model.weights) and not any(w.startswith("only") for w in model.weights)
    severity = lambda words: model.above(__import__("numpy").array([model.score(words)])).sum()
    assert severity(clean(100) | {"vile"}) >= toxicity.CUT > severity(clean(101))


def vocabulary_prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(n))


def brute_quality(t):
    w = split(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if split(x)]
    chars, n = len("".join(w)), len(w)
    symbols, capitals = sum(c in "#*$%&|<>" for c in t or ""), sum("A" <= c <= "Z" for c in t or "")
    bad = n < 50 or 100 * len(rep) > 50 * n or 10 * symbols > 3 * n or 10 * (len(lines) - len(set(lines))) > 3 * len(lines)
    return not (bad or chars < 2 * n or chars > 12 * n or 2 * capitals > chars)


def brute_contains(text, item):
    import re

    norm = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    w, i = norm(text), norm(item)
    if len(i) < 3:
        return False
    k = min(5, len(i))
    grams = lambda x: {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
    return 5 * len(grams(i) & grams(w)) >= 4 * len(grams(i))


def brute_pipeline(rows, items):
    """The rows behind each of the first four stages; rows: (doc_id, text); an id may stand at texts of different components."""
    out = []
    rows = [r for r in rows if brute_quality(r[1])]
    out.append(rows)
    prints = {brute_fingerprint(t) for k, t in rows if k is not None}
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    root, first = union(near, sorted(prints)), {}
    for k, t in rows:
        if k is not None:
            r = root[brute_fingerprint(t)]
            first[r] = min(k, first.get(r, k))
    rows = [(k, t) for k, t in rows if k is None or k == first[root[brute_fingerprint(t)]]]
    rows = [r for i, r in enumerate(rows) if r[0] is None or r not in rows[:i]]
    out.append(rows)
    ws = [split(t) for _, t in rows]
    seen, left = Counter(tuple(w[i : i + 35]) for w in ws for i in range(len(w) - 34)), []
    for (k, t), w in zip(rows, ws):
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
        if kept or not gone:
            left.append((k, kept))
    out.append(left)
    out.append([(k, t) for k, t in left if not any(brute_contains(t, i) for i in items)])
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on planted copies, near copies, passages, items, junk, nulls and clean documents."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(31)
    passage, items = vocabulary_prose(rng, 55), [vocabulary_prose(rng, 20) for _ in range(3)] + [None, "the"]
    rows = [(k, vocabulary_prose(rng, rng.randint(40, 160))) for k in range(60)]
    long = vocabulary_prose(rng, 900)
    rows += [(100, rows[7][1]), (101, rows[7][1]), (9, rows[7][1]), (8, vocabulary_prose(rng, 90)), (102, long), (103, long + " tail"), (104, long.upper())]
    rows += [(110 + k, f"{vocabulary_prose(rng, 60)}\n{passage} {vocabulary_prose(rng, 30)}") for k in range(4)]
    rows += [(120 + k, f"{vocabulary_prose(rng, 60)} {items[k].upper()}. {vocabulary_prose(rng, 10)}") for k in range(3)]
    rows += [(130, None), (131, ""), (132, " \n"), (133, "# * " * 60 + vocabulary_prose(rng, 60)), (134, "same line here\n" * 40), (135, "AB CD EF " * 40), (None, vocabulary_prose(rng, 70)), (136, "x" * 3000 + " " + vocabulary_prose(rng, 60))]
    spark.createDataFrame([(k, t, "en", None, len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), brute_pipeline(rows, items)
    for (_, stage), rest in zip(corpus_pipeline.STAGES, want):
        docs = corpus_pipeline.stash(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(rest)
    sizes = [len(rows), *map(len, want)]
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] - 3 and sizes[4] == sizes[3] - 3 and {k for k, _ in rows[:60] if brute_quality(dict(rows)[k])} <= {k for k, _ in want[3]}
    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_truncation(), lib.no_padding()
    final = Counter((r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert final == Counter((k, b"".join(i.to_bytes(4, "little") for i in lib.encode(t, add_special_tokens=False).ids)) for k, t in want[3])


@pytest.mark.parametrize("name", ["mixing", "licences", "chat", "quality", "substrings", "bpe", "decontaminate", "toxicity", "simhash", "sharding"])
def test_empty_tables_repeated_rows_and_extra_columns(spark, name):
    """An empty table gives no rows; repeated rows give repeated rows; extra columns with names of the operators' own change nothing."""
    rows = [(1, f"{licences.NOTICES['mit']} word"), (1, f"{licences.NOTICES['mit']} word"), (2, "a b c d"), (3, None), (None, ""), (4, "a b c d")]
    docs = spark.createDataFrame([(k, t, k, "e", 1) for k, t in rows], "doc_id long, text string, h long, w string, `class` int")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    model = toxicity.fit([({"vile"}, 1), ({"fine"}, 0)] * 30)
    turns = lambda d: d.select(F.col("doc_id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), "w", F.lit("user").alias("role"), "text", "h")
    run = {
        "mixing": mixing.score, "licences": licences.scan, "quality": quality.measure, "substrings": substrings.remove_repeats, "bpe": lambda d: bpe.encode(d, bpe.default_path()),
        "chat": lambda d: chat.format_branches(chat.linear_trees(turns(d))), "decontaminate": lambda d: decontaminate.contained(d, items), "toxicity": lambda d: toxicity.severity(d, model),
        "simhash": simhash.near_duplicates, "sharding": sharding.shard_documents,
    }[name]
    assert run(docs.limit(0)).count() == 0
    got = run(docs).collect()
    if name == "licences":
        assert Counter((r["doc_id"], r["licence"]) for r in got) == {(1, "mit"): 2}
    elif name == "decontaminate":
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(2, 1), (4, 1)}
    elif name == "chat":
        assert {r["tree"]: len(r["loss_spans"]) for r in got} == {1: 0, 2: 0, 3: 0, 4: 0, None: 0}
        parsed = chat.format_branches(chat.linear_trees(turns(docs))).select("tree", F.size(chat.parse_turns(F.col("formatted"))).alias("n")).collect()
        assert {r["tree"]: r["n"] for r in parsed} == {1: 2, 2: 1, 3: 1, 4: 1, None: 1}
    else:
        assert Counter(r["doc_id"] for r in got) == {1: 2, 2: 1, 3: 1, 4: 1, None: 1}


def test_very_long_texts(spark):
    """One text of 90,000 words beside short ones, through the operators that take texts in slices."""
    rng = random.Random(77)
    long = vocabulary_prose(rng, 90_000)
    rows = [(1, long), (2, long + " more"), (3, "short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    prints = {r["doc_id"]: r["fp"] % 2**64 for r in simhash.near_duplicates(docs).collect()}
    assert prints[1] == brute_fingerprint(long)
    cut = {r["doc_id"]: (r["__n_words"], r["__n_removed"], r["__kept"]) for r in substrings.remove_repeats(docs).collect()}
    assert cut == {1: (90_000, 90_000, ""), 2: (90_001, 90_000, "more"), 3: (2, 0, "short one")}
    assert {r["doc_id"]: r["n_words"] for r in quality.measure(docs).collect()} == {1: 90_000, 2: 90_001, 3: 2}
    item = spark.createDataFrame([(9, " ".join(long.split()[80_000:80_020]))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contained(docs, item).collect()} == {1, 2}
    assert len(toxicity.severity(docs, toxicity.fit([])).collect()) == 3
    scores = {r["doc_id"]: r for r in mixing.score(docs).collect()}
    assert scores[1]["n_tokens"] == 90_001 and all(r["score"] < 0 for r in scores.values())
    assert licences.scan(docs).count() == 0
    lib = __import__("tokenizers").Tokenizer.from_file(bpe.default_path())
    lib.no_truncation(), lib.no_padding()
    coded = {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in bpe.encode(docs, bpe.default_path()).collect()}
    ids = lib.encode(long, add_special_tokens=False).ids
    assert coded[1] == (b"".join(i.to_bytes(4, "little") for i in ids), lib.decode(ids, skip_special_tokens=False))
    talk = spark.createDataFrame([(1, 0, "user", long + " </turn> \\"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    said = chat.format_branches(chat.linear_trees(talk)).withColumn("turns", chat.parse_turns(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in said["turns"]] == [("user", long + " </turn> \\"), ("assistant", long)]
    assert [said["formatted"][x["start"] : x["start"] + x["length"]] for x in said["loss_spans"]] == [long]
    placed = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.shard_documents(docs).collect()}
    assert placed == {k: (len(t.encode()) + 1, __import__("zlib").crc32(t.encode())) for k, t in rows}


def test_jumps_stop_at_the_landing(spark):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    for n in (1, 37, 1000):  # beyond 12 + 2 bits of steps only keys that are still going go on
        rows = spark.range(2000).select("id", sharding.jump_hash(F.col("id") * 7919 - 9000, n).alias("x")).collect()
        assert all(r["x"] == jump((r["id"] * 7919 - 9000) % 2**64, n) for r in rows)


def test_too_many_templates_are_refused_first(spark, monkeypatch):
    monkeypatch.setattr(licences, "BROADCAST_BYTES", 100)
    bad = spark.range(1).select(F.raise_error(F.lit("read")).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    with pytest.raises(ValueError, match="at most 100"):
        licences.scan(bad)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stash(stage(spark, docs, d), "test")
        assert stage is corpus_pipeline.STAGES[-1][1] or set(out.columns) == set(docs.columns)
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * spark.read.parquet(f"{d}/documents.parquet").count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
@pytest.mark.parametrize("name", ["op2_licences", "op3_chat_format", "op4_quality_rules", "op5_substring_dedup", "op7_decontamination", "op10_jump_shards"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    plain = lambda x: round(x, 9) if isinstance(x, float) else bytes(x) if isinstance(x, bytearray) else x
    df = __spark_entry__.queries()[name](spark, d)
    con.execute(__spark_entry__.oracle_sql()[name])
    at = [[c[0] for c in con.description].index(c) for c in df.columns]
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == Counter(tuple(plain(r[k]) for k in at) for r in con.fetchall())
