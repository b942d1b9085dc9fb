"""Pieces, token alignment and the prefix trie against the libraries and plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from treediff.llm import alignment, pieces, trie
from treediff.llm.bpe import byte_letters

PARTS = [" ", "  ", "\n", "▁", "a", "the", "é", "中", "\U0001f642", "\t", "\0", "0", "12", "'s", "<s>", "<0x0A>", " ", "́", "zq", " x", "ﬁ", "�", "<|endoftext|>", "\n\n", " \n", "\x1c", "\x85", " foo", "bar", "Hello world", "don't"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    long = " ".join("".join(rng.choice("abcdeist") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    return [*made, "", None, " ", "  ", "\n", " a", "a ", "x" * 5000, "ab" * 3000 + " " * 300 + "\n" * 100, long, "same", "same"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


@pytest.fixture(scope="module")
def own():
    with open(pieces.default_path(), "rb") as f:
        return pieces.Pieces(f.read())


def test_pieces_equal_the_library(spark, texts, library):
    rows = spark.createDataFrame([(k if k % 7 else None, t, "x") for k, t in enumerate(texts)], "key long, body string, n_tokens string").repartition(3)
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in pieces.encode(rows, pieces.default_path(), "key", "body").collect())
    want = Counter()
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[(k if k % 7 else None, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids))] += 1
    assert got == want
    assert pieces.encode(rows.limit(0), pieces.default_path(), "key", "body").count() == 0


def test_decoding_any_ids_equals_the_library(library, own):
    rng = random.Random(2)
    ids = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(131, 259), 1, 2, 29871]) for _ in range(rng.randint(0, 12))] for _ in range(4000)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert own.decode(offsets, np.array(sum(ids, []), "<u4")).to_pylist() == library.decode(ids)


def test_a_heap_and_rows_side_by_side_agree(own, monkeypatch, texts):
    some = pa.array([t for t in texts[:400] if t])
    side = own.ids(some)
    monkeypatch.setattr(pieces, "SIDE_BY_SIDE", 0)
    heap = own.ids(some)
    assert all(np.array_equal(a, b) for a, b in zip(side, heap))
    monkeypatch.setattr(own, "cuts", False)  # whole texts as chunks
    whole = own.ids(some)
    assert all(np.array_equal(a, b) for a, b in zip(side, whole))


def test_other_ids_than_the_library_are_an_error(own, monkeypatch):
    monkeypatch.setattr(own, "rank", own.rank[::-1].copy())
    with pytest.raises(ValueError, match="the library has other ids"):
        own.ids(pa.array(["international understanding"]))


def brute_alignment(rows, library):
    first = Tokenizer.from_file(alignment.default_paths()[0])
    first.encode_special_tokens = True
    letters = {c: b for b, c in byte_letters().items()}
    out, total = [], Counter()
    for d, t in rows:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = library.encode(t) if t else []
        spelled = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        pieced = [bytes([int(library.id_to_piece(i)[3:-1], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = f" {t}".encode()
        if not t or b"".join(spelled) != whole or b"".join(pieced) != whole:
            out.append((d, [], [], [], []))
            continue
        ends = []
        for x in (spelled, pieced):
            at, e = 0, {}
            for n, y in enumerate(x):
                at += len(y)
                e[at] = n
            ends.append(e)
        groups, links, i, j = [], [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0][c] + 1, ends[1][c] + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        total.update(links)
        out.append((d, a, b, groups, links))
    best = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    counted = Counter((d, len(a), len(b), len(g), len(x), sum(total[y] == best[y[1]] for y in x), sum(total[y] for y in x), sha(g)) for d, a, b, g, x in out)
    return counted, out


@pytest.mark.parametrize("together", [alignment.TOGETHER, 2000])
def test_alignment_equals_offsets(spark, texts, library, monkeypatch, together):
    monkeypatch.setattr(alignment, "TOGETHER", together)
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, block int").repartition(3)
    want, each = brute_alignment(rows, library)
    names = [c.split()[0] for c in alignment.COUNTED.split(", ")]
    assert Counter(tuple(r[n] for n in names) for r in alignment.count_links(df, *alignment.default_paths()).collect()) == want
    if together > 2000:
        got = {r["doc_id"]: (r["n_a"], r["n_b"], r["groups"], [(x["a"], x["b"]) for x in r["links"]]) for r in alignment.align(df, *alignment.default_paths()).where("doc_id is not null").collect()}
        assert got == {d: (len(a), len(b), ";".join(g), x) for d, a, b, g, x in each if d is not None}
        assert alignment.count_links(df.limit(0), *alignment.default_paths()).count() == alignment.align(df.limit(0), *alignment.default_paths()).count() == 0


def test_a_transducer_knows_each_transition_once():
    t = alignment.Transducer([b"ab", b"c", b"a"], [b"a", b"bc", b"abca"])
    ends = t.ends([0, 1, 2, 0, 1, 2], [0, 1, 0, 2])
    assert [x.tolist() for x in ends] == [[2, 3, 6], [2, 3, 4]]
    known = sum(map(len, t.states.values()))
    t.ends([0, 1] * 50, [0, 1] * 50)
    assert sum(map(len, t.states.values())) == known
    with pytest.raises(ValueError, match="stands against"):
        t.ends([1], [0])


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    digest = lambda v: hashlib.sha256(f"{len(v[2])}:{v[2]}{v[3]}".encode()).hexdigest()
    own = {c: [v[2:] for v in sorted(x, key=lambda v: (*v[:3], v[3][:64], digest(v)))] for c, x in own.items()}
    full = {c: own.get(c - int(np.fmod(c, 100)), [])[: zlib.crc32(str(c).encode()) % 6] + x[zlib.crc32(str(c).encode()) % 6 :] for c, x in own.items()}
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), Counter(), Counter()
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not kids[k]
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha([c for c in m if len(full[c]) == len(k)])) for k, m in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(df):
    return Counter(tuple(r[c] for c in NODE) for r in df.collect())


def conversations(rng, turns, n=120):
    rows = []
    for c in rng.sample(range(400), n) + [None, -7, -200]:
        some, kinds = rng.choice(turns), rng.choice([1, 2, 3])
        rows += [(c, rng.choice([t, t, None, 1]), rng.choice(["u", None]) if kinds > 1 else "u", rng.choice(["x", "yy", "zzz" * 40, None][:kinds])) for t in range(some)]
    return rows


@pytest.mark.parametrize("parts, packed", [(1, trie.PACKED), (5, 10), (40, 0)])
def test_trie_against_every_prefix(spark, monkeypatch, parts, packed):
    monkeypatch.setattr(trie, "PACKED", packed)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for seed, turns in enumerate(([1, 2, 3, 4, 6, 9], [1, 20, 60])):
            rows = conversations(random.Random(seed + parts), turns)
            df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(4)
            assert nodes(trie.prefix_trie(df)) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trie_of_nothing_copies_and_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    lent = [c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 > 2][:3]
    rows = [(c, 0, "u", "gone") for c in lent]  # replaced by an absent lender's: nothing is left
    assert nodes(trie.prefix_trie(spark.createDataFrame(rows, schema))) == brute_trie(rows)
    one = nodes(trie.prefix_trie(spark.createDataFrame(rows, schema)))
    assert len(one) == 1 and next(iter(one))[1:6] == (0, None, 3, 0, 1)
    keep = [c for c in range(1000, 4000) if zlib.crc32(str(c).encode()) % 6 == 0]
    rows = [(c, t, "u", f"turn {t}") for c in keep for t in range(3)] + [(keep[0] + 100_000, 0, "u", "y" * 100_000)]
    assert nodes(trie.prefix_trie(spark.createDataFrame(rows, schema).repartition(6))) == brute_trie(rows)


def test_trie_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet')")
    found = con.execute(trie.SQL)
    names = [c[0] for c in found.description]
    want = Counter(tuple(dict(zip(names, r))[c] for c in NODE) for r in found.fetchall())
    assert nodes(trie.op12_prefix_trie(spark, folder)) == want == brute_trie([tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_queries_of_tokens_return_every_document(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.op11_sentencepiece(spark, folder).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {d: library.encode(t or "", add_bos=True, add_eos=True) for d, t in docs}
    assert got == {d: (len(i), sha(np.array(i, "<u4").tobytes()), sha(library.decode(i).encode())) for d, i in want.items()}
    names = [c.split()[0] for c in alignment.COUNTED.split(", ")]
    assert Counter(tuple(r[n] for n in names) for r in alignment.op13_token_alignment(spark, folder).collect()) == brute_alignment(docs, library)[0]
