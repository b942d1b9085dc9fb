"""Scores of texts by online logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens: its words, A-Z in lower case, then one end. Each
token is a symbol: the end, one of the most frequent words, or a bucket of all
other words by checksum, in which a word has its share of the bucket's counts
(a word never seen has half a count). Each symbol is a row of binary decisions,
those of a Huffman code. Every decision has five predictors:

    0  the decision itself                      (counts of the corpus)
    1  the decision after the symbol before     (counts, hashed slots)
    2  the decision after the two before        (counts, hashed slots)
    3  the decision, earlier in this text       (counts, exact up to each bit)
    4  the decision after the symbol before, earlier in this text (the same)

Their log odds are weighted by a set that the decision's depth and the evidence
of contexts 2 and 4 select, times factors of the text; an adaptive map of the
text refines the outcome. Counts come from all training texts. The weights that a text starts with
are fitted to predictions that leave each decision's own count out; their sums
don't depend on how rows are dealt out. Factors and map start anew with each text
and learn at the ends of its blocks of 32, 32, 64, 128, ... 2048 and from then on
4096 tokens. A text's score depends on the model and the text alone, so many texts
run side by side as arrays.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.llm.common import SPACES, partitions, read, stash
from treediff.llm.simhash import LOWER

#: Words with a symbol of their own; buckets of all others (at least, at most, words in each where neither binds).
HEAD, LEAST_BUCKETS, MOST_BUCKETS, BUCKET_WORDS = 49_151, 256, 16_384, 32
#: Slots of contexts 1 and 2 as powers of two: eight for each training token, within these bounds.
LEAST_SLOTS, MOST_SLOTS = 16, 22
#: Tokens of whole texts that are taken at once; longer texts than the second go in pieces of that size.
GROUP, PIECE = 32_768, 16_384
INPUTS, DEPTHS, BLOCK = 5, 12, 1 << 15
#: Parts of a unit in which the log odds of the corpus's contexts are held, in 8 bits.
STEPS = 18
GATES = 3 * DEPTHS
#: No word contains white space, so the end's name is none.
END = b"\n"
#: What makes lower case of A-Z and one kind of white space of all; bytes of texts whose words are told apart at once.
TO_WORDS, SLICE = LOWER.translate(bytes.maketrans(SPACES.encode(), b" " * len(SPACES))), 1 << 22
START = np.array([0.5, 0.3, 0.2, 0.3, 0.4], np.float32)
#: Tokens of the first block, and of those from the last doubling on.
FIRST_BLOCK, LAST_BLOCK = 32, 4096
#: Bits of a context's hash that pieces of one long text leave out, whatever their own number of decisions.
PAST_DROPS = 6
#: The weights of the gates, GATES * INPUTS numbers, are a logistic classifier of bits, fitted on all training texts
#: in so many damped Newton steps.
FIT_STEPS = 1
#: Strength of what holds back weights, factors and the map, and the cells of the map.
RIDGE, RATE, FACTOR_PRIOR, MAP_PRIOR, CELLS = 50.0, 0.4, 1000.0, 10.0, 24
COUNTS = "word binary, c long"
TABLES = "kind int, block int, data binary"
SUMS = "at int, x double"


def keep_memory() -> None:
    """From now on glibc's malloc keeps freed arrays of up to this size (at most twice as much in all) for the next ones.

    By default it gives them back to the system, and each group of texts pays for page faults again.
    """
    np.empty(31 << 20, np.uint8)


def scatter(x: np.ndarray) -> np.ndarray:
    """Hashes of 32 bits."""
    x = x.astype(np.uint32)
    x += np.uint32(1)
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x


class Names(dict):
    """Words to symbols; all other words have those of buckets, by checksum."""

    def __init__(self, words: list[bytes], buckets: int) -> None:
        super().__init__((w, k) for k, w in enumerate(words))
        self.first, self.mask = len(words), buckets - 1

    def symbols(self, words: list[bytes]) -> np.ndarray:
        s = np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))
        for k in np.flatnonzero(s < 0).tolist():
            s[k] = self.first + (zlib.crc32(words[k]) & self.mask)
        return s.astype(np.uint16)


@dataclass
class Code:
    """A Huffman code over symbols: for each the inner nodes and the bits on its way from the root."""

    masses: np.ndarray
    start: np.ndarray = field(init=False)
    length: np.ndarray = field(init=False)
    ways: np.ndarray = field(init=False)  # of all symbols in turn: node, whether its 1 and its 0 end a way, depth (4 bits) and bit in one number

    def __post_init__(self) -> None:
        n = len(self.masses)
        heap = [(float(c), k) for k, c in enumerate(self.masses)]
        heapq.heapify(heap)
        up, side, new = np.full(2 * n, -1), np.zeros(2 * n, np.uint8), n
        while len(heap) > 1:
            (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
            up[a] = up[b] = new
            side[b] = 1
            heapq.heappush(heap, (x + y, new))
            new += 1
        ways = []
        up, side = up.tolist(), side.tolist()
        for k in range(n):
            way, at = [], k
            while up[at] >= 0:
                way.append((up[at] - n, side[at]))
                at = up[at]
            ways.append(way[::-1])
        self.length = np.array([len(w) for w in ways], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        flat = [x for w in ways for x in w]
        deep = np.minimum(np.arange(len(flat)) - np.repeat(self.start, self.length), DEPTHS - 1)
        node, bit = np.array([x for x, _ in flat], np.uint32), np.array([x for _, x in flat], np.uint32)
        ends = np.zeros(n, np.uint32)  # by node
        last = (self.start + self.length)[self.length > 0] - 1
        np.bitwise_or.at(ends, node[last], np.uint32(1) << bit[last])
        self.ways = node << np.uint32(7) | ends[node] << np.uint32(5) | (deep << 1).astype(np.uint32) | bit

    def node_counts(self, symbols: np.ndarray) -> np.ndarray:
        """How often each node's bit was 0 and 1, of how often each symbol came; flat."""
        node, bit = self.ways >> np.uint32(7), self.ways & np.uint32(1)
        return np.bincount(2 * node.astype(np.int64) + bit, weights=np.repeat(symbols, self.length), minlength=2 * len(self.masses)).astype(np.int64)


@dataclass
class Model:
    code: Code
    slots: int  # as a power of two
    states: list[np.ndarray]  # of contexts 0 to 2
    weights: np.ndarray
    odds: list[np.ndarray] = field(default_factory=list)  # the states' log odds, for scoring

    @cached_property
    def odds_without(self) -> list[np.ndarray]:
        """The states' log odds without one count of a bit; flat by state and bit. Made where they are used, once a task."""
        return [ODDS_WITHOUT.reshape(-1, 2).take(x, axis=0).ravel() for x in self.states]


# words and symbols


@dataclass
class Words:
    """Tokens of whole texts: the number of each among the distinct ones, and where each text's tokens end."""

    codes: np.ndarray
    ends: np.ndarray
    kinds: pa.BinaryArray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        buf = b" \n ".join([x.translate(TO_WORDS) for x in texts] + [b""])  # the end is a word of its own
        b = np.frombuffer(buf, np.uint8)
        at = np.concatenate([[0], np.flatnonzero(b == 32) + 1]).astype(np.int32)  # words with the space after them
        found = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(buf)]).dictionary_encode()
        full = np.flatnonzero(np.diff(at) > 1)
        codes = found.indices.to_numpy().take(full)
        return cls(codes, np.flatnonzero(b.take(at.take(full)) == END[0]) + 1, pc.binary_slice(found.dictionary, 0, -1))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of about SLICE bytes in all, and the number of the first."""
    held, size = [], 0
    for k, x in enumerate(batch.column(column).cast(pa.binary())):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= SLICE:
            yield k + 1 - len(held), held
            held, size = [], 0
    if held:
        yield batch.num_rows - len(held), held


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_memory()
    for batch in batches:
        for _, texts in slices(batch, 0):
            w = Words.of(texts)
            n = np.bincount(w.codes, minlength=len(w.kinds))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([w.kinds.take(pa.array(some)), pa.array(n.take(some))], ["word", "c"])


@dataclass
class Vocabulary:
    names: Names
    counts: np.ndarray  # of the symbols that are one word
    masses: np.ndarray  # of all symbols: the counts of their words and a half for each of them, and for words never seen
    known: int  # tokens in training
    kinds: int  # distinct ones

    @property
    def unit(self) -> float:
        """What 0.5 and each count are parts of in the base score."""
        return self.known + 0.5 * (self.kinds + 1)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Of the counts of all words; the driver gets the head and one sum a bucket."""
    known, kinds, end = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    rank = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(head).collect()
    names, of = [END, *(bytes(r["word"]) for r in rank)], np.array([end, *(r["c"] for r in rank)], np.int64)
    rest = max(0, kinds - len(rank) - 1)
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (rest // BUCKET_WORDS).bit_length()))
    least = (int(of[-1]), names[-1]) if rank else None
    tail = counts.where(F.col("word") != F.lit(END))
    # words that come after the head's last one in its order
    tail = tail.where((F.col("c") < least[0]) | ((F.col("c") == least[0]) & (F.col("word") > F.lit(least[1])))) if least else tail.limit(0)
    sums = tail.groupBy(F.crc32("word").bitwiseAND(F.lit(buckets - 1)).alias("b")).agg((F.sum("c") + 0.5 * F.count("*")).cast("double").alias("m")).collect()  # at most MOST_BUCKETS rows
    masses = np.full(buckets, 0.5)
    masses[[r["b"] for r in sums]] += [r["m"] for r in sums]
    return Vocabulary(Names(names, buckets), of, np.concatenate([of + 0.5, masses]), int(known), int(kinds))


ENCODED = "doc_id long, held_out boolean, text_bytes long, n_tokens long, head_known long, head_base double, head_score double, symbols binary, rare array<struct<word:binary,n:long>>"


def _encode(words_of):
    """Texts as 16-bit symbols; what single-word symbols add to the base score; the words behind buckets, counted by text.

    head_score is minus the logarithm of the masses of the buckets used: with
    the logarithms of the words' own counts it gives their shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = words_of.value
        first = v.names.first
        base = np.concatenate([np.log10((v.counts + 0.5) / v.unit), np.zeros(len(v.masses) - first)])
        share = np.concatenate([np.zeros(first), -np.log10(v.masses[first:])])
        seen = np.concatenate([v.counts > 0, np.zeros(len(v.masses) - first, bool)])
        keep_memory()
        for whole in batches:
            for begin, texts in slices(whole, 2):
                batch, w = whole.slice(begin, len(texts)), Words.of(texts)
                s = v.names.symbols(w.kinds.to_numpy(zero_copy_only=False).tolist()).take(w.codes)
                starts = np.concatenate([[0], w.ends[:-1]])
                behind = np.flatnonzero(s >= first)
                text = np.searchsorted(w.ends, behind, "right")
                pair, times = np.unique(text * len(w.kinds) + w.codes.take(behind), return_counts=True)
                text, kind = np.divmod(pair, len(w.kinds))
                rare = pa.StructArray.from_arrays([w.kinds.take(pa.array(kind)), pa.array(times, pa.int64())], ["word", "n"])
                at = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
                raw = s.tobytes()
                columns = [
                    pa.array([len(x) for x in texts], pa.int64()), pa.array(w.ends - starts, pa.int64()),
                    *(pa.array(np.add.reduceat(x.take(s), starts, dtype=kind), kind.__name__) for x, kind in ((seen, np.int64), (base, np.float64), (share, np.float64))),
                    pa.array([raw[2 * a : 2 * b] for a, b in zip(starts.tolist(), w.ends.tolist())], pa.binary()), pa.ListArray.from_arrays(at, rare),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [x.split()[0] for x in ENCODED.split(", ")])

    return run


# decisions


@dataclass
class Bits:
    """Decisions, token by token."""

    size: np.ndarray  # of each token
    one: np.ndarray  # symbol before each token
    bit: np.ndarray
    ends: np.ndarray  # whether a bit of 0 (1) and of 1 (2) at this node is a token's last one
    depth: np.ndarray
    mark: np.ndarray  # hash of the node
    after: np.ndarray  # hash of node and symbol before
    slots: list[np.ndarray]  # of contexts 0 to 2


def decide(code: Code, slots: int, symbols: np.ndarray, one: np.ndarray, two: np.ndarray) -> Bits:
    """The decisions of symbols, each after two others (the number of symbols stands for none)."""
    size = code.length.take(symbols)
    begins = np.cumsum(size) - size
    way = np.repeat(code.start.take(symbols) - begins, size)
    way += np.arange(len(way))
    way = code.ways.take(way)
    low = way.astype(np.uint8)
    node, bit, depth, ends = way >> np.uint32(7), low & np.uint8(1), (low >> np.uint8(1)) & np.uint8(15), (low >> np.uint8(5)) & np.uint8(3)
    mark, last = scatter(node), scatter(one) * np.uint32(0x165667B1)
    after = np.repeat(last, size)
    after ^= mark
    after *= np.uint32(0xC2B2AE3D)
    after ^= after >> np.uint32(15)
    pair = np.repeat(scatter(two) * np.uint32(3) ^ last, size)
    pair ^= mark
    pair *= np.uint32(0x27D4EB2F)
    down = np.uint32(32 - slots)
    pair >>= down
    return Bits(size, one, bit, ends, depth, mark, after, [node.view(np.int32), (after >> down).view(np.int32), pair.view(np.int32)])


def preceding(symbols: np.ndarray, place: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each and that before it, within its text. place: in the text."""
    one, two = np.full(len(symbols), none, np.int32), np.full(len(symbols), none, np.int32)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    one[place < 1] = none
    two[place < 2] = none
    return one, two


def pieces(rows: Iterator[tuple[object, np.ndarray]]) -> Iterator[tuple[list, list[np.ndarray], bool]]:
    """Whole texts of GROUP tokens in all or a little more, or one text that is longer than PIECE (third item: true)."""
    keys, held, size = [], [], 0
    for key, symbols in rows:
        if len(symbols) > PIECE:
            yield [key], [symbols], True
            continue
        keys.append(key)
        held.append(symbols)
        size += len(symbols)
        if size >= GROUP:
            yield keys, held, False
            keys, held, size = [], [], 0
    if keys:
        yield keys, held, False


def _symbols(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    n = 0
    for batch in batches:
        for x in batch.column(column):
            yield n, np.frombuffer(x.as_py(), np.uint16)
            n += 1


# counts of the corpus


def _count_bits(code_of, slots: int):
    """A task's counts of all decisions by context, as blocks of tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        code: Code = code_of.value
        tables = [np.zeros(len(code.masses), np.int64), *(np.zeros(2 << slots, np.int32) for _ in range(2))]
        some = False
        for _, held, _ in pieces(_symbols(batches)):
            some = True
            symbols, lengths = np.concatenate(held), np.array([len(x) for x in held])
            place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            one, two = preceding(symbols, place, len(code.masses))
            tables[0] += np.bincount(symbols, minlength=len(code.masses))
            for k in range(0, len(symbols), GROUP):
                part = slice(k, k + GROUP)
                bits = decide(code, slots, symbols[part], one[part], two[part])
                ones = np.ones(len(bits.bit), np.int32)
                for t, s in zip(tables[1:], bits.slots[1:]):
                    np.add.at(t, s * np.int64(2) + bits.bit, ones)
        if some:
            tables[0] = code.node_counts(tables[0])
        rows = [(kind, k // BLOCK, t[k : k + BLOCK]) for kind, t in enumerate(tables) for k in range(0, len(t), BLOCK)] if some else []
        for k in range(0, len(rows), 16):
            yield _blocks([x for x in rows[k : k + 16] if x[2].any()])

    return run


def _blocks(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """Blocks of 32-bit counts, byte by byte position so that they compress."""
    data = [zstandard.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes(), 1) for *_, x in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(data, pa.binary())], ["kind", "block", "data"])


def _block(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(6, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :6] = flat.T
    return out.view("<i8")[:, 0]


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tables' blocks as states; a task holds one sum for each block that it gets, however many rows come."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, block, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
            x = _block(data)
            sums[kind, block] = sums[kind, block] + x if (kind, block) in sums else x
    if sums:
        keys = list(sums)
        states = [zstandard.compress(state(sums[k].reshape(-1, 2)).tobytes(), 3) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([b for _, b in keys], pa.int32()), pa.array(states, pa.binary())], ["kind", "block", "data"])


def state(counts: np.ndarray) -> np.ndarray:
    """Two counts (0, 1) as one 16-bit state; above 255 both shrink in proportion."""
    most = counts.max(axis=1)
    scale = np.where(most > 255, 255 / np.maximum(most, 1), 1.0)
    c = np.rint(counts * scale[:, None]).astype(np.uint16)
    return c[:, 0] << np.uint16(8) | c[:, 1]


def log_odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of the times that a decision was 0 and 1."""
    return np.log((one.astype(np.float32) + np.float32(0.4)) / (zero.astype(np.float32) + np.float32(0.4)))


def _odds_of_states() -> tuple[np.ndarray, np.ndarray]:
    """Log odds, in parts of 1 / STEPS, by state; and, by state and bit (the last), without one count of that bit where the state has its counts in full."""
    zero, one = np.divmod(np.arange(1 << 16), 256)
    exact = np.maximum(zero, one) < 255
    less = [log_odds(np.maximum(zero - exact, 0), one), log_odds(zero, np.maximum(one - exact, 0))]
    part = lambda x: np.rint(x * STEPS).astype(np.int8)
    return part(log_odds(zero, one)), part(np.stack(less, axis=1).ravel())


ODDS, ODDS_WITHOUT = _odds_of_states()


#: Log odds of decisions that came fewer than OFTEN times, by times * OFTEN + ones; 0 for none.
OFTEN = 256
ODDS_OF_TIMES = log_odds(np.maximum(np.arange(OFTEN)[:, None] - np.arange(OFTEN), 0), np.arange(OFTEN)).ravel()
ODDS_OF_TIMES[:OFTEN] = 0
#: Logarithms that log odds are the difference of, for all that a text of one piece can count.
LOGS = np.log(np.arange(GROUP, dtype=np.float32) + np.float32(0.4))


# what a text has shown so far


class Past:
    """Counts by context of the pieces of one long text so far: sorted keys, times, ones."""

    def __init__(self) -> None:
        self.keys, self.times, self.ones = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)

    def before(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[at] == keys
        return self.times[at] * same, self.ones[at] * same

    def add(self, keys: np.ndarray, times: np.ndarray, ones: np.ndarray) -> None:
        all_keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = lambda a, b: np.bincount(at, weights=np.concatenate([a, b]), minlength=len(all_keys)).astype(np.int64)
        self.keys, self.times, self.ones = all_keys, total(self.times, times), total(self.ones, ones)


def history(lane: np.ndarray, mark: np.ndarray, bit: np.ndarray, past: Past | None = None) -> np.ndarray:
    """Log odds of each decision from the earlier ones of its text and context; 0 where there are none.

    Keys of text, context, position and bit are sorted, so that the decisions of
    a context follow one another in the text's order.
    """
    m = len(mark)
    low = max(1, (m - 1).bit_length()) + 1
    high = max(0, low - 17)  # 15 bits for the text, 32 less these for the context
    key = lane.astype(np.uint64)
    key <<= np.uint64(32)
    key |= mark
    key >>= np.uint64(high)
    key <<= np.uint64(low)
    rest = np.arange(0, 2 * m, 2, dtype=np.uint32)
    rest |= bit
    key |= rest
    key.sort()
    rest = key.astype(np.uint32)
    rest &= np.uint32((1 << low) - 1)
    y = (rest & np.uint32(1)).view(np.int32)
    key >>= np.uint64(low)
    again = np.empty(m, bool)
    again[0] = False
    np.equal(key[1:], key[:-1], out=again[1:])
    ones = np.cumsum(y, dtype=np.int32)
    ones -= y
    heads = np.flatnonzero(~again)
    size = np.diff(np.append(heads, m))
    times = np.arange(m, dtype=np.int32)
    times -= np.repeat(heads.astype(np.int32), size)
    ones -= np.repeat(ones[heads], size)
    if past is not None:
        k, total = key[heads] >> np.uint64(PAST_DROPS - high), np.add.reduceat(y, heads, dtype=np.int64)
        was, was_one = past.before(k)
        times, ones = times + np.repeat(was, size), ones + np.repeat(was_one, size)
        past.add(k, size, total)
    often = np.flatnonzero(times >= OFTEN)
    found = ODDS_OF_TIMES.take(times * OFTEN + ones, mode="clip")
    if len(often):
        found[often] = log_odds(times[often] - ones[often], ones[often])
    odds = np.empty(m, np.float32)
    rest >>= np.uint32(1)
    odds[rest.astype(np.intp)] = found
    return odds


def within(group: np.ndarray, at: np.ndarray, bits: Bits, odds: np.ndarray) -> None:
    """Put in odds what history finds for tokens' decisions, told from the earlier ones of their groups. at: the tokens' first decisions.

    Decision by decision, the tokens of a group that came to the same node stand
    together in the text's order; then those of either bit go on to the next one.
    A token that is alone at a node has nothing before it there or further down.
    """
    low = np.uint64(max(1, len(at).bit_length()))
    key = group.astype(np.uint64)
    key <<= low
    key |= np.arange(len(at), dtype=np.uint64)
    key.sort()
    at = at.take((key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.intp))
    key >>= low
    size = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))) if len(key) else np.empty(0, np.intp)
    at, size = at.take(np.flatnonzero(np.repeat(size > 1, size))), size[size > 1]
    steps = np.arange(0, OFTEN * len(at), OFTEN, dtype=np.int32)
    while len(at):
        heads, bit = np.cumsum(size) - size, bits.bit.take(at)
        both = np.cumsum(bit, dtype=np.int32)
        both -= bit
        first = both.take(heads)
        both += steps[: len(at)]
        both -= np.repeat(first + steps.take(heads), size)  # times and ones before in one number
        found = ODDS_OF_TIMES.take(both, mode="clip")
        often = np.flatnonzero(both >= OFTEN * OFTEN)
        if len(often):
            times = often - np.repeat(heads, size).take(often)
            ones = both.take(often) - times * OFTEN
            found[often] = LOGS.take(ones, mode="clip") - LOGS.take(times - ones, mode="clip")
        odds[at] = found
        ones = np.add.reduceat(bit, heads, dtype=np.intp)
        zeros, ends = size - ones, bits.ends.take(at.take(heads))
        on = (zeros > 1) & (ends & np.uint8(1) == 0), (ones > 1) & (ends < 2)
        go = np.repeat(on[0].view(np.uint8) | on[1].view(np.uint8) << np.uint8(1), size)
        go >>= bit
        go &= np.uint8(1)
        go ^= np.uint8(1)
        go <<= np.uint8(1)
        go |= bit  # 0 and 1 for those who go on, more for the others
        size = np.concatenate([zeros[on[0]], ones[on[1]]])
        at = at.take(np.argsort(go, kind="stable")[: size.sum()])  # of 8 bits: a radix sort, without branches
        at += 1


class Reader:
    """What texts that run side by side have learned: factors of the inputs and a map of predictions to outcomes."""

    def __init__(self, lanes: int) -> None:
        self.factor = np.ones((lanes, INPUTS), np.float32)
        self.weight = np.zeros((lanes, INPUTS))
        self.times, self.ones = np.zeros(lanes * CELLS, np.float32), np.zeros(lanes * CELLS, np.float32)
        self.past = None

    @classmethod
    def of_long_text(cls) -> Reader:
        one = cls(1)
        one.past = (Past(), Past())
        return one


def inputs(model: Model, bits: Bits, lane: np.ndarray, again: np.ndarray, past: tuple[Past, Past] | None, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the five contexts of each decision, and its gate.

    lane: the text of each decision. again: tokens whose symbol before comes
    before others too; for the rest context 4 has nothing to say. own: the
    texts are training texts, whose own counts are left out.
    """
    x = np.empty((INPUTS, len(bits.bit)), np.float32)
    for k, slots in enumerate(bits.slots):
        if own:
            x[k] = model.odds_without[k].take(slots << np.int32(1) | bits.bit)
        else:
            x[k] = model.odds[k].take(slots)
    x[:3] *= np.float32(1 / STEPS)
    x[4] = 0
    gate = bits.depth * np.uint8(3)
    if past is None:
        x[3] = 0
        some = np.flatnonzero(bits.size)
        first = (np.cumsum(bits.size) - bits.size)[some]
        text, told = lane.take(first).astype(np.int64), again[some]
        within(text, first, bits, x[3])
        within(text[told] << 32 | bits.one[some[told]], first[told], bits, x[4])
    else:
        x[3] = history(lane, bits.mark, bits.bit, past[0])
        told = np.flatnonzero(np.repeat(again, bits.size))
        x[4, told] = history(lane[told], bits.after[told], bits.bit[told], past[1])
    gate += np.maximum(x[2] != 0, (x[4] != 0).view(np.uint8) << np.uint8(1))
    return x, gate


def block_of(place: np.ndarray) -> np.ndarray:
    """Blocks of a text's tokens: FIRST_BLOCK, then doubling up to LAST_BLOCK."""
    doubling = np.frexp(np.maximum(place // FIRST_BLOCK, 0))[1]
    most = (LAST_BLOCK // FIRST_BLOCK).bit_length()
    return np.where(place < LAST_BLOCK, doubling, most - 1 + place // LAST_BLOCK).astype(np.uint16)


def recurring(lane: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Whether the symbol before a token comes before another token of its text too."""
    key = lane.astype(np.uint64) << np.uint64(48) | one.astype(np.uint64) << np.uint64(24) | np.arange(len(one), dtype=np.uint64)
    key.sort()
    same = (key[1:] >> np.uint64(24)) == (key[:-1] >> np.uint64(24))
    at = (key & np.uint64((1 << 24) - 1)).astype(np.intp)
    found = np.zeros(len(key), bool)
    found[at[1:][same]] = True
    found[at[:-1][same]] = True
    return found


def lay_out(model: Model, held: list[np.ndarray], offset: int = 0, before: tuple[int, int] | None = None):
    """Decisions of texts block by block, in each block text by text: decisions, text of each token, where blocks' tokens end."""
    symbols, lengths = np.concatenate(held).astype(np.int32), np.array([len(x) for x in held])
    lane = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    none = len(model.code.masses)
    one, two = preceding(symbols, place, none)
    if before is not None:  # a later piece of a long text
        one[0], two[:2] = before[1], [before[0], before[1]][: len(two)]
    block = block_of(place + offset)
    order = np.argsort(block, kind="stable")
    lane, one = lane[order], one[order]
    bits = decide(model.code, model.slots, symbols[order], one, two[order])
    ends = np.flatnonzero(np.diff(block[order], append=-1)) + 1
    return bits, lane, one, ends


def run_mixer(model: Model, bits: Bits, lane: np.ndarray, one: np.ndarray, ends: np.ndarray, reader: Reader, score: np.ndarray) -> None:
    """Add to score (by text) the natural logarithms of the decisions' probabilities, learning after each block."""
    each = np.repeat(lane, bits.size)
    again = recurring(lane, one) if reader.past is None else np.ones(len(lane), bool)
    x, gate = inputs(model, bits, each, again, reader.past, False)
    weights, at = np.ascontiguousarray(model.weights.T, np.float32), gate.astype(np.intp)
    for k in range(INPUTS):
        x[k] *= weights[k].take(at, mode="clip")
    fresh = np.flatnonzero(np.diff(lane, prepend=-1))  # tokens that are their texts' first of a block
    fresh = np.union1d(fresh, np.append(0, ends[:-1]))
    stops, starts = np.cumsum(bits.size)[ends - 1].tolist(), (np.cumsum(bits.size) - bits.size)[fresh]
    parts = np.searchsorted(fresh, ends).tolist()
    unit, half, zero = np.float32(1), np.float32(0.5), bits.bit ^ np.uint8(1)
    begin = part = 0
    for stop, to in zip(stops, parts):
        here, of, heads = slice(begin, stop), each[begin:stop], starts[part:to] - begin
        lanes, v = of[heads], x[:, here]
        spans = [slice(*p) for p in zip(heads.tolist(), [*heads[1:].tolist(), len(of)])]
        factor, dot, slope = reader.factor[lanes], np.empty(len(of), np.float32), np.empty((len(lanes), INPUTS), np.float32)
        for f, span in zip(factor, spans):
            np.matmul(f, v[:, span], out=dot[span])
        np.clip(dot, -11, 11, out=dot)
        q = np.exp(-dot)
        q += unit
        np.divide(unit, q, out=q)
        dot *= np.float32(2)
        dot += np.float32(CELLS // 2)
        np.clip(dot, 0, CELLS - 1, out=dot)
        cell = dot.astype(np.intp)
        cell += of * np.int32(CELLS)
        hold = half / (reader.times + MAP_PRIOR)
        p = (MAP_PRIOR * hold + 0.5).astype(np.float32).take(cell, mode="clip")
        p *= q
        p += (reader.ones * hold).astype(np.float32).take(cell, mode="clip")
        p -= zero[here]
        np.abs(p, out=p)
        np.log(p, out=p)
        score[lanes] += np.add.reduceat(p, heads, dtype=np.float64)
        cell *= 2
        cell += bits.bit[here]
        both = np.bincount(cell, minlength=2 * len(reader.times)).reshape(-1, 2)
        reader.times += both.sum(axis=1)
        reader.ones += both[:, 1]
        error = np.subtract(bits.bit[here], q, out=q)
        for s, span in zip(slope, spans):
            np.matmul(v[:, span], error[span], out=s)
        weight = reader.weight[lanes] + slope.astype(np.float64) ** 2
        reader.weight[lanes] = weight
        reader.factor[lanes] = np.clip(factor + RATE * slope / np.sqrt(weight + FACTOR_PRIOR), 0, 3)
        begin, part = stop, to


def score_texts(model: Model, held: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of the symbols of texts, none longer than PIECE, or of one text of any length."""
    score = np.zeros(len(held))
    if len(held) == 1 and len(held[0]) > PIECE:
        reader, symbols = Reader.of_long_text(), held[0]
        for k in range(0, len(symbols), PIECE):
            before = (int(symbols[k - 2]), int(symbols[k - 1])) if k else None
            run_mixer(model, *lay_out(model, [symbols[k : k + PIECE]], k, before), reader, score)
    else:
        run_mixer(model, *lay_out(model, held), Reader(len(held)), score)
    return score / np.log(10)


# weights


def slopes(model: Model, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the texts' log likelihood over the weights, by gate."""
    g, h = np.zeros((GATES, INPUTS)), np.zeros((GATES, INPUTS, INPUTS))
    past = (Past(), Past()) if len(held) == 1 and len(held[0]) > PIECE else None
    for k in range(0, len(held[0]) if past else 1, PIECE):
        part = [held[0][k : k + PIECE]] if past else held
        bits, lane, one, _ = lay_out(model, part, k, (int(held[0][k - 2]), int(held[0][k - 1])) if k else None)
        again = np.ones(len(lane), bool) if past else recurring(lane, one)
        x, gate = inputs(model, bits, np.repeat(lane, bits.size), again, past, True)
        order = np.argsort(gate, kind="stable")  # of 8 bits: a radix sort
        x, y, sizes = x.take(order, axis=1), bits.bit.take(order).astype(np.float32), np.bincount(gate, minlength=GATES)
        begin = 0
        for j, n in enumerate(sizes.tolist()):
            v, t = x[:, begin : begin + n], y[begin : begin + n]
            p = 1 / (1 + np.exp(-np.clip(model.weights[j] @ v, -11, 11)))
            g[j] += v @ (t - p)
            h[j] += (v * (p * (1 - p))) @ v.T
            begin += n
    return g, h


def _slopes(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        total = np.zeros(GATES * INPUTS * (1 + INPUTS))
        for _, held, _ in pieces(_symbols(batches)):
            total += np.concatenate([x.ravel() for x in slopes(model_of.value, held)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "x"])

    return run


def newton(weights: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One step for each gate, held back towards the given weights; rounded, so that the order of sums doesn't show."""
    step = np.stack([np.linalg.solve(h[k] + RIDGE * np.eye(INPUTS), g[k]) for k in range(len(g))])
    return np.round(weights + np.clip(step, -0.6, 0.6), 4).astype(np.float32)


def train(encoded: DataFrame, v: Vocabulary) -> Model:
    """encoded: symbols of the training texts. All of them are counted, and the weights are fitted on all."""
    spark, code = encoded.sparkSession, Code(v.masses)
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, (8 * v.known).bit_length()))
    held = spark.sparkContext.broadcast(code)
    tables = encoded.select("symbols").mapInArrow(_count_bits(held, slots), TABLES).repartition(partitions(spark), "kind", "block").mapInArrow(_add_up, TABLES)
    states = [np.zeros(n, np.uint16) for n in (len(code.masses), 1 << slots, 1 << slots)]
    for kind, block, data in tables.toLocalIterator():  # 2 bytes a slot in all
        states[kind][block * BLOCK // 2 : (block + 1) * BLOCK // 2] = np.frombuffer(zstandard.decompress(bytes(data)), np.uint16)
    model = Model(code, slots, states, np.tile(START, (GATES, 1)), [ODDS.take(x) for x in states])
    cut = GATES * INPUTS
    for _ in range(FIT_STEPS):
        sums = encoded.select("symbols").mapInArrow(_slopes(spark.sparkContext.broadcast(model)), SUMS).groupBy("at").agg(F.sum("x").alias("x")).collect()  # GATES * INPUTS * 6 rows
        flat = np.zeros(cut * (1 + INPUTS))
        flat[[r["at"] for r in sums]] = [r["x"] for r in sums]
        model.weights = newton(model.weights, flat[:cut].reshape(GATES, INPUTS), flat[cut:].reshape(GATES, INPUTS, INPUTS))
    model.states = []
    return model


# scores


def _score(model_of):
    """Rows and their symbols (the last column) to rows and the logarithm of the symbols' probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        rows: list[list] = []

        def each() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                rows.append([batch.column(k).to_numpy() for k in range(batch.num_columns - 1)])
                for x in batch.column(batch.num_columns - 1):
                    yield 0, np.frombuffer(x.as_py(), np.uint16)

        at: list[int] = []
        found: list[float] = []
        for keys, symbols in numbered(each()):
            at += keys
            found += score_texts(model_of.value, symbols).tolist()
        if at:
            score = np.empty(len(at))
            score[at] = found
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[0] for r in rows])), pa.array(score)], ["row", "mixed"])

    def numbered(texts):
        for keys, symbols, _ in pieces((n, s) for n, (_, s) in enumerate(texts)):
            yield keys, symbols

    return run


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(5)) == 1


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, text_bytes, bits_per_byte: one row per row of docs.

    The model learns from the rows whose key's checksum leaves another rest than
    1 and scores all. score: log10; bits: the same as bits; bits_per_byte: over the
    text's bytes, null where it has none. Null and blank texts are one end;
    repeated rows are counted and scored each; with an empty training set all
    words are unseen; an empty table gives no rows; extra columns aren't read.

    Texts are turned into symbols once; counts, weights and scores read those.
    Broadcasts are bounded: HEAD words, MOST_BUCKETS sums, 2 bytes for each slot.
    Words behind buckets, counted by text, are joined with the table of all
    counts by a shuffle.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    counts = stash(rows.where(~F.col("held_out")).select("text").mapInArrow(_count_words, COUNTS).groupBy("word").agg(F.sum("c").alias("c")), "words")
    v = vocabulary(counts, head)
    encoded = stash(rows.mapInArrow(_encode(spark.sparkContext.broadcast(v)), ENCODED).withColumn("row", F.monotonically_increasing_id()), "symbols")
    model = train(encoded.where(~F.col("held_out")).select("symbols"), v)
    mixed = encoded.select("row", "symbols").mapInArrow(_score(spark.sparkContext.broadcast(model)), "row long, mixed double")
    rare = encoded.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    rare = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    part = rare.select("row", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10((F.col("c") + 0.5) / v.unit)).alias("base"), (F.col("n") * F.log10(F.col("c") + 0.5)).alias("own"))
    part = part.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "base", "own")])
    out = encoded.drop("rare", "symbols").join(mixed, "row").join(part, "row", "left")
    or_zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = out.withColumn("score", F.col("mixed") + F.col("head_score") + or_zero("own")).withColumn("bits", -F.col("score") * float(np.log2(10)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.known).cast("long").alias("train_tokens"),
        (F.col("head_base") + or_zero("base")).alias("base_score"), "score", "bits", "text_bytes", F.when(F.col("text_bytes") > 0, F.col("bits") / F.col("text_bytes")).alias("bits_per_byte"),
    )


def op1_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
