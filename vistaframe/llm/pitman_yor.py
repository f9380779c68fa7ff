"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants. A token's leaf restaurant is its whole context, the two words before it; the
leaf's parent is the middle restaurant of the one word before it, and all of these share
the root, whose base is uniform over the V training words and one more. Words are told
apart by 64-bit codes, and the leaves below one middle restaurant by LEAF_BITS bits of the
second word's code (of a thousand leaves about one shares its place), so the contexts
learned are those of the corpus and grow with it.

Distribution. Documents are cut into chunks of tokens. Each chunk sends its tokens, packed
by context, to partitions of middle restaurants; a middle restaurant lies in one partition
with all leaves below it, so all of its numbers are local. The root is shared: for each
sweep, partitions send the root's customers of their words to buckets of words, which seat
them and send back what a word's probability needs. The COMMON most frequent words travel as
short numbers, by a list that the driver sends out; others as their codes. The tokens of a
middle restaurant with more than a room's share of a partition are dealt to rooms by leaf, and
those of a leaf that alone is that frequent (passages that many documents share) by document;
rooms may lie in different partitions. Such restaurants stay whole: they are shared as the
root is. The buckets of words sum their groups over the partitions, seat them and send back
customers and tables; the driver sums customers and tables of each shared restaurant.
Partitions therefore keep their size whatever the corpus, and which restaurants are shared,
the number of partitions and that of buckets change no result. Which are shared, and which
words are common, is planned on one document in PLANNED (by a hash of its place): that
balances the work and shortens messages, while every token counts once, in one restaurant.
Per-document sums travel back packed by chunk. The driver sees sums of the root and of shared
restaurants and their list (at most about sixteen a partition). The partitions lie in the
shared folder as a bucketed table, which outlives lost executors and is read again for each
sweep without another shuffle.

Inference. A sweep draws, level by level, the number of tables of every group (the
customers of one word in one restaurant) from its conditional distribution given the other
groups under the Chinese-restaurant law: the seatings of c customers at t tables have the
summed weight of a generalised Stirling number, which is exact for groups of up to
STIRLING customers and carried on by its scaling limit (t against c to the discount) for
larger ones. A group's seating itself has no further use, so it is not kept. The groups of
a level are drawn at the same time, given the parent's probabilities of the sweep before.
Tables are the customers of the parent. After BURN_IN sweeps SAMPLES seatings are kept,
and the predictive probabilities averaged over them. The numbers behind the draws are hashes
of sweep, restaurant and word. The tables of a partition's groups travel to its next pass
with the messages.

Everything counted covers all training documents and grows with them.

Defined cases: a null or empty text is its end token alone; a null id belongs to the
training part; repeated rows count and score each; without training tokens every word
has the base's probability; an empty table gives an empty result; texts of any length
are read whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import crc_fold, mix, scratch, table, tidy, trim, written

END = xxhash.xxh3_64_intdigest(b" end")
BEGIN = xxhash.xxh3_64_intdigest(b" begin")
#: Discounts and strengths of leaf, middle and root restaurants.
DISCOUNT, STRENGTH = (0.8, 0.8, 0.7), (2.0, 5.0, 20.0)
BURN_IN, SAMPLES = 1, 2
STIRLING = 1024
CHUNK_TOKENS, CHUNK_DOCS, PART_TOKENS = 1_000_000, 30_000, 1_000_000
#: A middle restaurant with more than this share of a partition's tokens is opened as rooms.
ROOM = 1 / 8
#: Words that travel as numbers; bits that tell leaves of a middle restaurant apart.
COMMON, LEAF_BITS = 60_000, 20
LEAST_PARTS, PLANNED = 18, 8
_HELD = 1 << 15


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; the bytes of equal weight of an array lie together."""
    head = np.array([len(arrays), *[v for a in arrays for v in (np.dtype(a.dtype).num, len(a))]], np.int64)
    planes = (np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.int32, np.uint32, np.int64, np.uint64, np.float32, np.float64)}


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for kind, size in head.tolist():
        width = _TYPES[kind].itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(_TYPES[kind]).ravel())
        at += size * width
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of rising codes, which need fewer bytes than the codes."""
    return np.diff(ascending, prepend=np.uint64(0)) if len(ascending) else ascending


def _rising(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys from 0; key and place are sorted as one number where they fit."""
    bits = max(1, (len(keys) - 1).bit_length())
    if not len(keys) or int(keys.max()) >> (63 - bits):
        return np.argsort(keys, kind="stable")
    return np.sort((keys.astype(np.int64) << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (as common.words), and the tokens of each text, its end with them."""
    # a copy, as ascii_lower misreads a cast slice
    texts = pa.concat_arrays([texts, texts.slice(0, 0)]).fill_null("").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, edges = lists.flatten(), lists.offsets.to_numpy()
    counts = np.diff(edges) + 1
    # an empty word stands before leading space and after trailing
    full = pc.not_equal(pc.binary_length(flat), 0)
    none = np.flatnonzero(~full.to_numpy(zero_copy_only=False))
    if len(none):
        counts -= np.bincount(np.searchsorted(edges, none, "right") - 1, minlength=len(counts))
        flat = flat.filter(full)
    return flat, counts


def tokens(words: list[pa.Array], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of all tokens, and the 64-bit codes of the numbers; 0 is the end, 1 the beginning."""
    flat = np.zeros(int(counts.sum()), np.int32)
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(counts) - 1] = False
    # each different word is hashed once
    coded = pa.concat_arrays(words).dictionary_encode()
    own = coded.dictionary.cast(pa.large_binary()).to_pylist()
    flat[inner] = coded.indices.to_numpy() + 2
    return flat, np.fromiter(chain((END, BEGIN), map(xxhash.xxh3_64_intdigest, own)), np.uint64, len(own) + 2)


def contexts(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the word before each token and of the one before that."""
    first = np.cumsum(counts) - counts
    before, earlier = np.ones_like(flat), np.ones_like(flat)
    before[1:] = flat[:-1]
    before[first] = 1
    earlier[1:] = before[:-1]
    earlier[first] = 1
    return before, earlier


# -- rooms of busy restaurants ---------------------------------------------------------


def leaf_number(codes: np.ndarray) -> np.ndarray:
    """What tells the leaves below a middle restaurant apart, from the second word before."""
    return (mix(codes) >> np.uint64(64 - LEAF_BITS)).astype(np.uint32)


def pair_code(before: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Of a leaf, from the code of the word before and the leaf's number, which is its last bits."""
    return (mix(before) >> np.uint64(LEAF_BITS) << np.uint64(LEAF_BITS)) | leaf.astype(np.uint64)


def mid_key(before: np.ndarray) -> np.ndarray:
    """Of middle restaurants, for the seeds of their draws."""
    return (mix(before) >> np.uint64(32)).astype(np.uint32)


class Busy:
    """Words, and leaves, before which more than a room's tokens stand, with their numbers of
    rooms: the middle restaurants and leaves that partitions share."""

    def __init__(self, keys: dict[int, list[tuple[int, int]]], room: float):
        self.keys, self.rooms = [], []
        for kind in (0, 1):
            rows = sorted((int(np.int64(k).astype(np.uint64)), n) for k, n in keys.get(kind, []))
            self.keys.append(np.array([k for k, _ in rows], np.uint64))
            self.rooms.append(np.array([2 * int(np.ceil(n / room)) for _, n in rows], np.uint64))
        # the middle restaurant above each leaf; a leaf without a busy one stays in its room
        bits = np.uint64(LEAF_BITS)
        above = {int(m): i for i, m in enumerate(mix(self.keys[0]) >> bits)}
        mids = np.array([above.get(int(k), -1) for k in self.keys[1] >> bits], np.int64)
        self.keys[1], self.rooms[1], self.leaf_mid = self.keys[1][mids >= 0], self.rooms[1][mids >= 0], mids[mids >= 0]
        self.mid_key = mid_key(self.keys[0])
        self.leaf_number = (self.keys[1] & np.uint64((1 << LEAF_BITS) - 1)).astype(np.uint32)

    def place(self, kind: int, code: np.ndarray) -> np.ndarray:
        """Place of each code among the busy ones, -1 if it is none."""
        keys = self.keys[kind]
        if not len(keys):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        return np.where(keys[at] == code, at, -1)

    def of(self, kind: int, code: np.ndarray) -> np.ndarray:
        """Number of rooms of each code, 0 if it is not busy."""
        at = self.place(kind, code)
        return np.where(at >= 0, self.rooms[kind][at], np.uint64(0)) if len(self.keys[kind]) else np.zeros(len(code), np.uint64)

    def rooms_of(self, before: np.ndarray, leaf: np.ndarray, codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The room of each token: 0 where the word before is not busy.

        before: word numbers; leaf: numbers of leaves; codes: of the words; doc: a code of
        each token's document.
        """
        out = np.zeros(len(before), np.uint64)
        at = np.flatnonzero(self.of(0, codes)[before])
        if len(at):
            one, two = codes[before[at]], leaf[at].astype(np.uint64)
            out[at] = 1 + mix(two) % self.of(0, one)
            many = self.of(1, pair_code(one, two))
            hot = np.flatnonzero(many)
            out[at[hot]] = mix(mix(two[hot]) + mix(doc[at[hot]]) % many[hot] + np.uint64(1)) | np.uint64(1 << 63)
        return out


def _counting(share: float):
    """Tokens of each task, its pairs of context above a quarter of the share, and its words
    above that or with eight occurrences."""
    names = ("kind", "key", "n")

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=names)

    def found(rows: list) -> pa.RecordBatch:
        counts = np.concatenate([r[1] for r in rows])
        flat, codes = tokens([r[0] for r in rows], counts)
        before, earlier = contexts(flat, counts)
        least = share * len(flat) / 4
        n = np.bincount(before, minlength=len(codes))
        often = n > least
        listed = often | (n >= 8)
        some = np.flatnonzero(often[before])
        pair, m = np.unique((before[some].astype(np.int64) << 32) | earlier[some], return_counts=True)
        pair, m = pair[m > least], m[m > least]
        key = pair_code(codes[pair >> 32], leaf_number(codes)[pair & 0xFFFFFFFF])
        got = [(0, k, c) for k, c in zip(codes[listed].astype(np.int64).tolist(), n[listed].tolist(), strict=True)]
        return out(got + [(1, k, c) for k, c in zip(key.astype(np.int64).tolist(), m.tolist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, total = [], 0, 0
        for batch in batches:
            rows.append(split(batch.column("text")))
            n = int(rows[-1][1].sum())
            size, total = size + n, total + n
            if size >= CHUNK_TOKENS:
                yield found(rows)
                rows, size = [], 0
        if rows:
            yield found(rows)
        yield out([(-1, None, total)])

    return run


# -- packing ---------------------------------------------------------------------------


def middle(before: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Codes by which middle restaurants and their rooms are dealt to partitions."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + room)


def _chunks(parts: int, busy: Busy, common: np.ndarray):
    """common: codes of the words that travel as their places in it, the most frequent first."""
    rising = np.argsort(common)
    known = common[rising]

    def emit(name: int, rows: list) -> pa.RecordBatch:
        counts = np.concatenate([r[1] for r in rows])
        ids = [i for r in rows for i in r[2]]
        held = np.concatenate([r[3] for r in rows])
        flat, codes = tokens([r[0] for r in rows], counts)
        rows.clear()
        before, earlier = contexts(flat, counts)
        doc = np.repeat(np.arange(len(counts), dtype=np.uint16) | (held * np.uint16(_HELD)), counts)
        place = np.empty(len(codes), np.int64)
        place[np.argsort(codes)] = np.arange(len(codes))
        leaf = leaf_number(codes)[earlier]
        kind = np.uint16 if parts <= 65536 else np.int64
        dealt = lambda code, room: ((middle(code, room) >> np.uint64(33)) % np.uint64(parts)).astype(kind)
        part, room = dealt(codes, np.uint64(0))[before], np.zeros(len(flat), np.uint64)
        if len(busy.keys[0]):
            code = (doc & np.uint16(_HELD - 1)) + np.uint64(name) * np.uint64(CHUNK_DOCS * 2)
            room = busy.rooms_of(before, leaf, codes, code)
            opened = np.flatnonzero(room)
            part[opened] = dealt(codes[before[opened]], room[opened])
        del earlier, room
        # by the code of the word before and the leaf
        order = _rising((place[before] << LEAF_BITS) | leaf)
        order = order[np.argsort(part[order], kind="stable")]
        part, flat, before, leaf, doc = (a[order] for a in (part, flat, before, leaf, doc))
        del order
        other = np.r_[True, (before[1:] != before[:-1]) | (part[1:] != part[:-1])]
        new = other | np.r_[True, leaf[1:] != leaf[:-1]]
        edges = np.searchsorted(part, np.arange(parts + 1))
        to, body = [-1 - int(mix(np.array([name], np.uint64))[0] >> np.uint64(34))], [_pack(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), counts.astype(np.int32), held.astype(np.uint8))]
        at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
        listed = (known[at] == codes) if len(known) else np.zeros(len(codes), bool)
        at = rising[at] if len(known) else at
        for p in np.flatnonzero(np.diff(edges)).tolist():
            a, b = int(edges[p]), int(edges[p + 1])
            start = np.flatnonzero(new[a:b])
            first = np.flatnonzero(other[a:b][start])  # runs that begin another word before
            word = at[flat[a:b]].astype(np.int32)
            rare = np.flatnonzero(~listed[flat[a:b]])
            names, index = np.unique(codes[flat[a:b][rare]], return_inverse=True)
            word[rare] = COMMON + index
            # words before stand in the order of their codes
            mids = codes[before[a:b][start[first]]]
            to.append(p)
            body.append(
                _pack(
                    _steps(names), word, np.diff(mids, prepend=np.uint64(0)), np.diff(np.r_[first, len(start)]).astype(np.int32), np.diff(leaf[a:b][start], prepend=np.uint32(0)) & np.uint32((1 << LEAF_BITS) - 1),
                    np.diff(np.r_[start, b - a]).astype(np.int32), doc[a:b], np.array([len(counts)], np.int32),
                )
            )
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([name] * len(to), pa.int64()), pa.array(body, pa.binary())], names=["part", "chunk", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, docs, made = [], 0, 0, 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, held = batch.column("doc_id").to_pylist(), np.array(batch.column("held_out").to_pylist(), bool)
            rows.append((*split(batch.column("text")), ids, held))
            size, docs = size + int(rows[-1][1].sum()), docs + len(ids)
            if size >= CHUNK_TOKENS or docs >= CHUNK_DOCS:
                yield emit(task + made, rows)
                rows, size, docs, made = [], 0, 0, made + 1
        if docs:
            yield emit(task + made, rows)

    return run


# -- seating ---------------------------------------------------------------------------


def stirling(discount: float, most: int = STIRLING) -> np.ndarray:
    """Logs of generalised Stirling numbers [customers, tables]: the summed weight of the
    seatings of so many customers at so many tables, without the weights of new tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
        out[c + 1] = np.logaddexp(stay, np.r_[-np.inf, out[c, :-1]])
    return out


_LOG_STIRLING: dict[float, np.ndarray] = {}


def _log_stirling(discount: float) -> np.ndarray:
    if discount not in _LOG_STIRLING:
        _LOG_STIRLING[discount] = stirling(discount)
    return _LOG_STIRLING[discount]


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of positive numbers (Stirling's series from 10 on)."""
    shift = np.zeros(np.shape(x))
    y = x.astype(float)
    for _ in range(10):
        low = y < 10
        shift -= np.where(low, np.log(np.where(low, y, 1.0)), 0.0)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


def log_weight(t: np.ndarray, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, level: int) -> np.ndarray:
    """Log weight of t tables of groups of more than STIRLING customers.

    For a fixed t * c ** -d the Stirling numbers of c customers stand to those of one table
    as a function of that product to (t - 1)! d ** (t - 1); the function is that of the
    largest exact number of customers.
    """
    d, s = DISCOUNT[level], STRENGTH[level]
    row, n = _log_stirling(d)[STIRLING], np.arange(1, STIRLING + 1)
    limit = row[1:] - row[1] + lgamma(n) + (n - 1) * np.log(d)
    scaled = np.interp(t * customers**-d, n * float(STIRLING) ** -d, limit)
    return scaled - lgamma(t) - (t - 1) * np.log(d) + t * np.log(d * parent) + lgamma(s / d + others + t) - lgamma(s / d + others)


def _draw_large(u: np.ndarray, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, level: int) -> np.ndarray:
    """Tables of large groups, from a grid around the peak of their weights."""
    weight = lambda t: log_weight(t, *(x[:, None] for x in (customers, others, parent)), level) if t.ndim > 1 else log_weight(t, customers, others, parent, level)
    low, high = np.ones(len(customers)), customers.copy()
    while (high - low > 2).any():
        third = np.floor((high - low) / 3)
        a, b = low + third, high - third
        up = weight(a) < weight(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    peak = np.round((low + high) / 2)
    h = np.maximum(1, np.floor(np.sqrt(peak) / 4))
    bend = 2 * weight(peak) - weight(peak + h) - weight(np.maximum(1, peak - h))
    width = h / np.sqrt(np.maximum(bend, 1e-12))
    step = np.maximum(1, np.floor(np.minimum(width, customers / 64) / 5))
    t = peak[:, None] + step[:, None] * np.arange(-32, 33)
    log = np.where((t >= 1) & (t <= customers[:, None]), weight(np.maximum(t, 1)), -np.inf)
    mass = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
    pick = (mass < u[:, None] * mass[:, -1:]).sum(axis=1)
    out = t[np.arange(len(peak)), pick] + np.floor((u * 2**26 % 1 - 0.5) * step + 0.5)
    return np.clip(out, 1, customers)


def draw(rng: np.random.Generator, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, level: int) -> np.ndarray:
    """Tables of groups of at least two customers, from their conditional distribution.

    others: tables of the restaurant's other groups; parent: the parent's probability.
    """
    return drawn(rng.random(len(customers)), customers, others, parent, level)


def uniform(group: np.ndarray, word: np.ndarray, sweep: int, level: int) -> np.ndarray:
    """A number from 0 to 1 for each word in a restaurant, wherever it is drawn."""
    return (mix(mix(group) + mix(word + np.uint64(4 * sweep + level))) >> np.uint64(11)) * 2.0**-53


def drawn(u: np.ndarray, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, level: int) -> np.ndarray:
    """As draw, from a uniform number for each group."""
    d, s = DISCOUNT[level], STRENGTH[level]
    out = np.ones(len(customers))
    top = 2
    while top <= STIRLING:
        at = np.flatnonzero((customers > top // 2) & (customers <= top))
        rows = max(1, (1 << 19) // top)
        t = np.arange(top)
        for a in range(0, len(at), rows):
            i = at[a : a + rows]
            log = np.cumsum(np.log((s + d * (others[i, None] + t)) * parent[i, None]), axis=1)
            log += _log_stirling(d)[customers[i].astype(np.int64), 1 : top + 1]
            mass = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            out[i] = 1 + (mass < u[i, None] * mass[:, -1:]).sum(axis=1)
        top *= 2
    large = np.flatnonzero(customers > STIRLING)
    if len(large):
        out[large] = _draw_large(u[large], customers[large], others[large], parent[large], level)
    return out


class Root:
    """Sums of the root after a sweep: customers, tables and the vocabulary; and of the shared
    middle restaurants and leaves (rows of totals: their customers and tables)."""

    def __init__(self, customers: float, tables: float, vocabulary: int, mids: np.ndarray | None = None, leaves: np.ndarray | None = None):
        self.customers, self.tables, self.vocabulary = customers, tables, vocabulary
        self.mids, self.leaves = (np.zeros((2, 0)) if x is None else x for x in (mids, leaves))

    @property
    def base(self) -> float:
        return 1.0 / (self.vocabulary + 1)

    def probabilities(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of words, from their customers and tables."""
        own = np.maximum(0, customers - DISCOUNT[2] * tables)
        return (own + (STRENGTH[2] + DISCOUNT[2] * self.tables) * self.base) / (STRENGTH[2] + self.customers)


def seated(customers: np.ndarray, tables: np.ndarray, every: np.ndarray, all_tables: np.ndarray, parent: np.ndarray, level: int) -> np.ndarray:
    """Predictive probability of words in leaves or middle restaurants, from the word's and
    the restaurant's customers and tables."""
    d, s = DISCOUNT[level], STRENGTH[level]
    return (np.maximum(0, customers - d * tables) + (s + d * all_tables) * parent) / (s + every)


def leaf_group(mid: np.ndarray, number: np.ndarray) -> np.ndarray:
    return (mid.astype(np.uint64) << np.uint64(LEAF_BITS)) | number


class Shared(NamedTuple):
    """What a partition is told of shared restaurants after a sweep, each customers and tables:
    of its pairs, its types, and of the whole restaurants."""

    pairs: Sequence[np.ndarray] = ()
    types: Sequence[np.ndarray] = ()
    mids: Sequence[np.ndarray] = ()
    leaves: Sequence[np.ndarray] = ()


class Part:
    """The tokens of one partition of middle restaurants, counted.

    Words are ordered by their bucket, then by code; types (a word in a leaf) by leaf, then
    by word; pairs (a word in a middle restaurant) alike; tokens by type. Of a shared
    restaurant the partition holds a part; its groups are seated in the buckets of words.
    """

    @classmethod
    def of(cls, messages: list[list[np.ndarray]], chunks: list[int], buckets: int, common: np.ndarray, busy: Busy | None = None) -> Part:
        """From what _chunks packed for the partition; the restaurants of busy are shared."""
        self = cls()
        rare = [np.cumsum(m[0], dtype=np.uint64) for m in messages]
        used = np.zeros(COMMON, bool)
        for m in messages:
            used[m[1][m[1] < COMMON]] = True
        names = np.unique(np.concatenate([common[np.flatnonzero(used)], *rare]))
        order = np.argsort(bucket_of(names, buckets), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words = names[order]
        self.edges = np.searchsorted(bucket_of(self.words, buckets), np.arange(buckets + 1))
        find = lambda codes: place[np.searchsorted(names, codes)]
        numbers = np.zeros(COMMON, np.int64)
        numbers[np.flatnonzero(used)] = find(common[np.flatnonzero(used)])
        word = np.concatenate([np.r_[numbers, find(r)][m[1]] for m, r in zip(messages, rare, strict=True)])
        mid = np.concatenate([np.repeat(np.cumsum(m[2], dtype=np.uint64), m[3]) for m in messages])
        mids, mid = np.unique(mid, return_inverse=True)
        below = np.concatenate([np.cumsum(m[4], dtype=np.uint32) & np.uint32((1 << LEAF_BITS) - 1) for m in messages])
        leaves, leaf = np.unique((mid << LEAF_BITS) | below, return_inverse=True)
        many = np.concatenate([m[5] for m in messages])
        key = (np.repeat(leaf, many) << max(1, len(names).bit_length())) | word
        order = _rising(key)
        key = key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.size = np.diff(np.r_[start, len(key)])
        bits = max(1, len(names).bit_length())
        self.leaf, self.w = key[start] >> bits, key[start] & ((1 << bits) - 1)
        self.leaf_mid = leaves >> LEAF_BITS
        pairs, self.pair_of = np.unique((self.leaf_mid[self.leaf] << 32) | self.w, return_inverse=True)
        self.mid, self.pw = pairs >> 32, pairs & 0xFFFFFFFF
        self.mids = len(mids)
        self.chunks, self.docs = np.array(chunks, np.int64), np.array([int(m[7][0]) for m in messages], np.int64)
        self.message = np.repeat(np.arange(len(messages), dtype=np.uint16), [len(m[6]) for m in messages])[order]
        doc = np.concatenate([m[6] for m in messages])[order]
        self.doc, trained = doc & np.uint16(_HELD - 1), doc < _HELD
        self.c = np.add.reduceat(trained, start, dtype=np.int64).astype(float) if len(start) else np.empty(0)
        # the numbers of leaves are needed where groups are drawn
        self.mid_key = mid_key(mids)
        below = (leaves & ((1 << LEAF_BITS) - 1)).astype(np.uint32)
        self.drawn_leaves = below[self._with_draws()]
        busy = busy or Busy({}, 1.0)
        to = busy.place(0, mids)
        self.mid_at = np.flatnonzero(to >= 0)
        self.mid_to = to[self.mid_at]
        at = np.flatnonzero(to[self.leaf_mid] >= 0)
        to = busy.place(1, pair_code(mids[self.leaf_mid[at]], below[at]))
        self.leaf_at, self.leaf_to = at[to >= 0], to[to >= 0]
        self._share()
        return self

    def _with_draws(self) -> np.ndarray:
        """Leaves in which a word has two customers or more."""
        return np.flatnonzero(np.bincount(self.leaf, self.c >= 2, len(self.leaf_mid)) > 0)

    def _share(self) -> None:
        """The pairs and types of shared restaurants, by bucket, place and word."""
        buckets = len(self.edges) - 1
        bucket = np.repeat(np.arange(buckets), np.diff(self.edges)).astype(np.uint16 if buckets <= 65536 else np.int64)
        own = np.ones(self.mids, bool)
        own[self.mid_at] = False
        self.own_pair = own[self.mid]
        at = np.flatnonzero(~self.own_pair)
        to = np.full(self.mids, -1)
        to[self.mid_at] = self.mid_to
        self.pairs = at[np.argsort(bucket[self.pw[at]], kind="stable")]
        self.pair_to = to[self.mid[self.pairs]]
        self.pair_edges = np.searchsorted(bucket[self.pw[self.pairs]], np.arange(buckets + 1))
        to = np.full(len(self.leaf_mid), -1)
        to[self.leaf_at] = self.leaf_to
        self.own_type = to[self.leaf] < 0
        at = np.flatnonzero(~self.own_type)
        self.types = at[np.lexsort((self.w[at], to[self.leaf[at]], bucket[self.w[at]]))]
        self.type_to = to[self.leaf[self.types]]
        self.type_edges = np.searchsorted(bucket[self.w[self.types]], np.arange(buckets + 1))

    _SAVED = ("size", "leaf", "leaf_mid", "pair_in_mid", "mid", "pw", "c", "mid_at", "mid_to", "leaf_at", "leaf_to")
    _RISING = ("leaf", "leaf_mid", "mid")

    def _first_pair(self) -> np.ndarray:
        """Of the middle restaurant of each type."""
        return np.searchsorted(self.mid, np.arange(self.mids))[self.leaf_mid[self.leaf]]

    def save(self) -> bytes:
        self.pair_in_mid = self.pair_of - self._first_pair()
        kept = [np.diff(v, prepend=0) if n in self._RISING else v for n in self._SAVED for v in (getattr(self, n),)]
        below = np.diff(self.drawn_leaves, prepend=np.uint32(0)) & np.uint32((1 << LEAF_BITS) - 1)
        return _pack(_steps(self.words), self.edges.astype(np.int64), self.chunks, self.docs, self.message, self.doc, self.mid_key, below, *[k.astype(np.int32) for k in kept])

    @classmethod
    def load(cls, data: bytes) -> Part:
        self = cls()
        self.words, self.edges, self.chunks, self.docs, self.message, self.doc, self.mid_key, below, *kept = _unpack(data)
        self.drawn_leaves = np.cumsum(below, dtype=np.uint32) & np.uint32((1 << LEAF_BITS) - 1)
        for name, v in zip(cls._SAVED, kept, strict=True):
            setattr(self, name, np.cumsum(v, dtype=np.int64) if name in cls._RISING else v)
        self.c = self.c.astype(float)
        self.mids, self.words = len(self.mid_key), np.cumsum(self.words, dtype=np.uint64)
        self.pair_of = self.pair_in_mid + self._first_pair()
        self.w = self.pw[self.pair_of]
        self._share()
        return self

    @property
    def leaf_c(self) -> np.ndarray:
        """Customers of each leaf."""
        return np.bincount(self.leaf, self.c, len(self.leaf_mid))

    def sums(self, of_type: np.ndarray) -> list[np.ndarray]:
        """Sums over the tokens of each document, for each message."""
        ends = np.cumsum(self.docs)
        at = (ends - self.docs)[self.message] + self.doc
        every = np.bincount(at, np.repeat(of_type, self.size), int(ends[-1]) if len(ends) else 0)
        return np.split(every, ends[:-1])

    @property
    def count(self) -> np.ndarray:
        """Training tokens of each word in this partition."""
        return np.bincount(self.w, self.c, len(self.words))

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Every group at one table."""
        t = ((self.c > 0) & self.own_type).astype(float)
        return t, ((np.bincount(self.pair_of, t, len(self.pw)) > 0) & self.own_pair).astype(float)

    def root_customers(self, state) -> np.ndarray:
        return np.bincount(self.pw, state[1], len(self.words))

    def messages(self, state, counts: np.ndarray | None, tokens: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
        """bucket and what is sent to it: codes, the root's customers and at first (without
        counts) the training tokens; of shared middle restaurants the pairs, their customers and
        at first their training tokens; of shared leaves the types and their customers. Later
        only words and pairs with two training tokens (counts, tokens) or more are sent."""
        customers, first = self.root_customers(state).astype(np.int32), self.count.astype(np.int64)
        if len(self.pairs):
            of_pairs = np.bincount(self.pair_of, state[0], len(self.pw))[self.pairs].astype(np.int32)
            trained = np.bincount(self.pair_of, self.c, len(self.pw))[self.pairs].astype(np.int64)
            open_pair, open_type = self._open(tokens)
        for bucket in np.flatnonzero(np.diff(self.edges)).tolist():
            at = np.arange(self.edges[bucket], self.edges[bucket + 1])
            if counts is not None:
                at = at[counts[at] >= 2]
                if not len(at):
                    continue
            shared = [np.empty(0, np.int64)] * (5 if counts is None else 4)
            if len(self.pairs):
                i, j = (np.arange(e[bucket], e[bucket + 1]) for e in (self.pair_edges, self.type_edges))
                if counts is not None:
                    i, j = i[open_pair[i]], j[open_type[j]]
                key = lambda to, w: to.astype(np.int64) * len(at) + np.searchsorted(at, w)  # noqa: B023, E731
                shared = [key(self.pair_to[i], self.pw[self.pairs[i]]), of_pairs[i]]
                shared += [trained[i]] if counts is None else []
                shared += [key(self.type_to[j], self.w[self.types[j]]), self.c[self.types[j]].astype(np.int64)]
            yield bucket, [self.words[at], customers[at], *([first[at]] if counts is None else []), *shared]

    def _open(self, tokens: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Shared pairs with two training tokens or more, and the types of such pairs."""
        if tokens is None:
            return np.ones(len(self.pairs), bool), np.ones(len(self.types), bool)
        of_pair = np.zeros(len(self.pw), bool)
        of_pair[self.pairs] = tokens >= 2
        return tokens >= 2, of_pair[self.pair_of[self.types]]

    def shared(self, got: list[list[list[np.ndarray]]], known: list[Root]) -> tuple[list[Shared], np.ndarray | None]:
        """What the answers say of the shared restaurants after each sweep, and the training
        tokens of the shared pairs."""
        if not known or not len(self.pairs):
            return [Shared()] * len(known), None
        out, now, tokens = [], None, None
        for root, each in zip(known, got, strict=True):
            if now is None:
                now = [np.concatenate([g[j] for g in each]).astype(float) for j in (3, 4, 6, 7)]
                tokens = np.concatenate([g[5] for g in each])
                opened = self._open(tokens)
            else:
                now = [x.copy() for x in now]
                if each:
                    for x, j in zip(now, (2, 3, 4, 5), strict=True):
                        x[opened[j > 3]] = np.concatenate([g[j] for g in each])
            out.append(Shared(now[:2], now[2:], root.mids[:, self.mid_to], root.leaves[:, self.leaf_to]))
        return out, tokens

    def in_middle(self, state, root: np.ndarray, shared: Shared | None = None) -> np.ndarray:
        """Predictive probability of each word in its middle restaurants."""
        t, tm = state
        customers = np.bincount(self.pair_of, t, len(self.pw))
        tables, every = (np.bincount(self.mid, x, self.mids) for x in (tm, customers))
        if shared and len(self.pairs):
            tm = tm.copy()
            customers[self.pairs], tm[self.pairs] = shared.pairs
            every[self.mid_at], tables[self.mid_at] = shared.mids
        return seated(customers, tm, every[self.mid], tables[self.mid], root[self.pw], 1)

    def probabilities(self, state, root: np.ndarray, shared: Shared | None = None) -> np.ndarray:
        """Predictive probability of each word in its leaf restaurants."""
        c, t, every = self.c, state[0], self.leaf_c
        tables = np.bincount(self.leaf, t, len(self.leaf_mid))
        if shared and len(self.types):
            c, t = c.copy(), t.copy()
            c[self.types], t[self.types] = shared.types
            every[self.leaf_at], tables[self.leaf_at] = shared.leaves
        return seated(c, t, every[self.leaf], tables[self.leaf], self.in_middle(state, root, shared)[self.pair_of], 0)

    def sweep(self, k: int, state, root: np.ndarray, shared: Shared | None = None) -> tuple[np.ndarray, np.ndarray]:
        """New tables of all groups of the partition's own leaves, then middle restaurants."""
        t, tm = state[0].copy(), state[1]
        some = np.flatnonzero((self.c >= 2) & self.own_type)
        if len(some):
            others = np.bincount(self.leaf, t, len(self.leaf_mid))[self.leaf[some]] - t[some]
            below = np.zeros(len(self.leaf_mid), np.uint32)
            below[self._with_draws()] = self.drawn_leaves
            u = uniform(leaf_group(self.mid_key[self.leaf_mid[self.leaf[some]]], below[self.leaf[some]]), self.words[self.w[some]], k, 0)
            t[some] = drawn(u, self.c[some], others, self.in_middle(state, root, shared)[self.pair_of[some]], 0)
        customers = np.bincount(self.pair_of, t, len(self.pw))
        others = np.bincount(self.mid, tm, self.mids)[self.mid] - tm
        tm = np.minimum(customers, 1.0) * self.own_pair
        some = np.flatnonzero((customers >= 2) & self.own_pair)
        if len(some):
            u = uniform(self.mid_key[self.mid[some]], self.words[self.pw[some]], k, 1)
            tm[some] = drawn(u, customers[some], others[some], root[self.pw[some]], 1)
        return t, tm

    def pack_state(self, state) -> bytes:
        """What a sweep draws: tables of own groups of two customers or more."""
        t, tm = state
        customers = np.bincount(self.pair_of, t, len(self.pw))
        return _pack(t[(self.c >= 2) & self.own_type].astype(np.int32), tm[(customers >= 2) & self.own_pair].astype(np.int32))

    def unpack_state(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        of_leaves, of_mids = _unpack(data)
        t, _ = self.first()
        t[(self.c >= 2) & self.own_type] = of_leaves
        customers = np.bincount(self.pair_of, t, len(self.pw))
        tm = np.minimum(customers, 1.0) * self.own_pair
        tm[(customers >= 2) & self.own_pair] = of_mids
        return t, tm

    def states(self, number: int, roots: list[np.ndarray], shared: list[Shared] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The first state and the one after each sweep with the root's probabilities and what
        is known of shared restaurants, whatever the partition's number."""
        state = self.first()
        yield state
        for k, root in enumerate(roots):
            state = self.sweep(k, state, root, shared[k] if shared else None)
            yield state


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(codes) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, np.int64)


def seated_root(bucket: int, sweep: int, messages: list[list[np.ndarray]], held: list | None, before: Root | None, busy: Busy | None = None):
    """The groups of one bucket of words in shared leaves, then in shared middle restaurants,
    then in the root, from what the partitions sent.

    Gives state (codes, customers, tables; sums of the settled words, of shared pairs customers
    and tables, of shared types tables, the words' tables in settled pairs, totals of the settled
    pairs and types, totals), one answer for each
    message (customers and tables of words, shared pairs and types; at first also the training
    tokens of words and pairs), and the root's sums. Words and pairs with fewer than two training
    tokens are settled at once and not sent again.
    """
    first, busy = sweep == 0, busy or Busy({}, 1.0)
    m_, l_ = len(busy.keys[0]), len(busy.keys[1])
    codes, at = np.unique(_joined([m[0] for m in messages]).astype(np.uint64), return_inverse=True)
    n = len(codes)
    heres = np.split(at, np.cumsum([len(m[0]) for m in messages])[:-1])[: len(messages)]

    def groups(j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and words of the groups with keys in the messages, and which each entry is."""
        keys = [m[j] // max(1, len(m[0])) * n + h[m[j] % max(1, len(m[0]))] for m, h in zip(messages, heres, strict=True)]
        found, which = np.unique(_joined(keys).astype(np.int64), return_inverse=True)
        return found, found // max(1, n), found % max(1, n), which

    add = lambda which, j, size: np.bincount(which, _joined([m[j] for m in messages]), size)
    at_pair = 3 if first else 2
    pairs, mid, word, of_pair = groups(at_pair)
    types, leaf, type_word, of_type = groups(-2)
    c = add(of_type, -1, len(types))
    t = np.minimum(c, 1.0)
    above = np.searchsorted(pairs, busy.leaf_mid[leaf] * n + type_word)
    customers = add(at, 1, n)
    pc = add(of_pair, at_pair + 1, len(pairs))
    if before is not None and held is not None:
        root = before.probabilities(held[1], held[2])
        pc_, pt_, t_, below = held[3][1:5]
        customers = customers + below
        some = np.flatnonzero(c >= 2)
        if len(some):
            inside = seated(pc_, pt_, *before.mids[:, mid], root[word], 1)[above[some]]
            u = uniform(leaf_group(busy.mid_key[busy.leaf_mid[leaf[some]]], busy.leaf_number[leaf[some]]), codes[type_word[some]], sweep - 1, 0)
            t[some] = drawn(u, c[some], before.leaves[1, leaf[some]] - t_[some], inside, 0)
    pc = pc + np.bincount(above, t, len(pairs))
    pt = np.minimum(pc, 1.0)
    some = np.flatnonzero(pc >= 2)
    if before is not None and held is not None and len(some):
        u = uniform(busy.mid_key[mid[some]], codes[word[some]], sweep - 1, 1)
        pt[some] = drawn(u, pc[some], before.mids[1, mid[some]] - pt_[some], root[word[some]], 1)
    customers = customers + np.bincount(word, pt, n)
    tables = np.minimum(customers, 1.0)
    some = np.flatnonzero(customers >= 2)
    if before is not None and len(some):
        own = np.ones(n) if held is None else held[2]
        tables[some] = drawn(uniform(np.zeros(1, np.uint64), codes[some], sweep, 2), customers[some], before.tables - own[some], np.full(len(some), before.base), 2)
    # words and pairs with two training tokens or more stay open
    counts, trained = (add(at, 2, n), add(of_pair, 5, len(pairs))) if first else (None, None)
    answers, starts = [], [0, 0]
    for m, here in zip(messages, heres, strict=True):
        i, j = (which[a : a + len(m[k])] for which, a, k in zip((of_pair, of_type), starts, (at_pair, -2), strict=True))
        starts = [starts[0] + len(i), starts[1] + len(j)]
        of_words = [customers[here].astype(np.int32), tables[here].astype(np.int32), *([counts[here].astype(np.int64)] if first else [])]
        of_pairs = [pc[i].astype(np.int32), pt[i].astype(np.int32), *([trained[i].astype(np.int64)] if first else [])]
        answers.append([*of_words, *of_pairs, c[j].astype(np.int64), t[j].astype(np.int32)])
    sums = lambda i, j: np.concatenate([np.bincount(x[k], y[k], size) for x, k, ys, size in ((mid, i, (pc, pt), m_), (leaf, j, (c, t), l_)) for y in ys])
    if first:
        open_, open_pair = counts >= 2, trained >= 2
        open_type = open_pair[above]
        settled = np.array([customers[~open_].sum(), tables[~open_].sum()])
        rest = [settled, pc[open_pair], pt[open_pair], t[open_type], np.bincount(word[~open_pair], pt[~open_pair], n)[open_], sums(~open_pair, ~open_type)]
        state = [codes[open_], customers[open_], tables[open_], [*rest, sums(slice(None), slice(None))]]
        every = (float(customers.sum()), float(tables.sum()), int((counts > 0).sum()), int(counts.sum()))
    else:
        settled, closed = held[3][0], held[3][5]
        state = [codes, customers, tables, [settled, pc, pt, t, below, closed, closed + sums(slice(None), slice(None))]]
        every = (float(customers.sum() + settled[0]), float(tables.sum() + settled[1]), 0, 0)
    return state, answers, every


# -- kernels ---------------------------------------------------------------------------

ROOT = "bucket int, part int, sweep int, body binary, customers double, tables double, vocabulary long, tokens long, totals array<double>"


def _answers(one: Part, right: pa.Table, known: list[Root]):
    """After the sweeps in right (the first, and later ones) the root's probabilities in the order
    of the words, and their counts; what is shared, and its pairs' training tokens; the states."""
    rows = sorted(right.select(["sweep", "bucket", "body"]).to_pylist(), key=lambda r: (r["sweep"], r["bucket"]))
    sweeps = sorted({r["sweep"] for r in rows})
    got: list[list[list[np.ndarray]]] = [[] for _ in sweeps]
    states = []
    for r in rows:
        if r["bucket"] < 0:
            states.append(one.unpack_state(r["body"]))
        else:
            got[sweeps.index(r["sweep"])].append(_unpack(r["body"]))
    known = [known[k] for k in sweeps]
    return *told(got, known), *one.shared(got, known), states


def told(got: list[list[list[np.ndarray]]], known: list[Root]) -> tuple[list[np.ndarray], np.ndarray | None]:
    """What the answers of each sweep (a list of those of the buckets) say of all words; after
    the first they speak of words with two training tokens or more."""
    if not known:
        return [], None
    customers, tables, counts = (np.concatenate([g[j] for g in got[0]]) for j in range(3))
    roots = [known[0].probabilities(customers, tables)]
    for root, each in zip(known[1:], got[1:], strict=True):
        customers, tables = customers.copy(), tables.copy()
        if each:
            customers[counts >= 2], tables[counts >= 2] = (np.concatenate([g[j] for g in each]) for j in (0, 1))
        roots.append(root.probabilities(customers, tables))
    return roots, counts


def _preparing(buckets: int, common, busy: Busy):
    """The messages of a partition to one row, the counted partition."""

    def run(left: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["chunk"])
        if rows[0]["part"] < 0:
            return left.select(["part", "chunk", "body"])
        one = Part.of([_unpack(r["body"]) for r in rows], [r["chunk"] for r in rows], buckets, common.value, busy)
        body = one.save()
        trim()
        return pa.table({"part": pa.array([rows[0]["part"]], pa.int32()), "chunk": pa.array([None], pa.int64()), "body": pa.array([body], pa.binary())})

    return run


def _counted(left: pa.Table) -> tuple[int, Part]:
    return left.column("part")[0].as_py(), Part.load(left.column("body")[0].as_py())


def _sending(known: list[Root]):
    """What a partition sends after as many sweeps as the buckets have answered, and its state
    (as part -2 - number, that a bucket sends back)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number, one = _counted(left)
        roots, counts, shared, tokens, states = _answers(one, right, known)
        state = one.sweep(len(known) - 1, states[-1], roots[-1], shared[-1]) if known else one.first()
        at, body = [number % (len(one.edges) - 1)], [one.pack_state(state)]
        for bucket, message in one.messages(state, counts, tokens):
            for j in (3 if counts is None else 2, -2):
                message[j] = np.diff(message[j], prepend=0)
            at.append(bucket)
            body.append(_pack(_steps(message[0]), *message[1:]))
        trim()
        return pa.table({"bucket": pa.array(at, pa.int32()), "part": pa.array([-2 - number] + [number] * (len(at) - 1), pa.int32()), "body": pa.array(body, pa.binary())})

    return run


def _seating(sweep: int, before: Root | None, busy: Busy):
    """Rows of a bucket (the state of the sweep before has part -1, those of partitions lie below)
    to its answers and state; the states of partitions go back with a bucket below zero."""

    def rows_of(bucket: list[int], parts: list[int], body: list[bytes], sums: tuple, totals: list[float]) -> pa.RecordBatch:
        """The last of the rows has the sums."""
        n = len(parts)
        last = [pa.array([zero] * (n - 1) + [v], kind) for v, zero, kind in zip(sums, (0.0, 0.0, 0, 0), (pa.float64(),) * 2 + (pa.int64(),) * 2, strict=True)]
        columns = [pa.array(bucket, pa.int32()), pa.array(parts, pa.int32()), pa.array([sweep] * n, pa.int32()), pa.array(body, pa.binary()), *last, pa.array([None] * (n - 1) + [totals], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROOT.split(", ")])

    def work(bucket: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        # of the sweep before, without the codes of the words
        held = next(([None, x[0].astype(float), x[1].astype(float), [x[2], *(y.astype(float) for y in x[3:7]), x[7]]] for part, body in rows if part == -1 for x in (_unpack(body),)), None)
        sent = [(part, _unpack(body)) for part, body in rows if part >= 0]
        for _, m in sent:
            m[0] = np.cumsum(m[0], dtype=np.uint64)
            for j in (3 if sweep == 0 else 2, -2):
                m[j] = np.cumsum(m[j])
        state, answers, sums = seated_root(bucket, sweep, [m for _, m in sent], held, before, busy)
        settled, *shared, closed, totals = state[3]
        body = _pack(state[1].astype(np.int32), state[2].astype(np.int32), settled, *(x.astype(np.int32) for x in shared), closed)
        back = [(-2 - part, b) for part, b in rows if part < -1]
        buckets, parts = [-1 - bucket] * len(back) + [bucket] * (len(sent) + 1), [p for p, _ in back + sent]
        return rows_of(buckets, [*parts, -1], [*[b for _, b in back], *[_pack(*a) for a in answers], body], sums, totals.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for bucket, part, body in zip(*[batch.column(c).to_pylist() for c in ("bucket", "part", "body")], strict=True):
                if bucket != now and rows:
                    yield work(now, rows)
                    rows = []
                now = bucket
                rows.append((part, body))
        if rows:
            yield work(now, rows)

    return run


SUMS = "chunk long, ids boolean, body binary"


def _scoring(known: list[Root]):
    """Sums of the log probabilities of a partition's tokens for the documents of each chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, one = _counted(left)
        roots, count, shared, _, states = _answers(one, right, known)
        p = np.zeros(len(one.w))
        for state, root, told_shared in zip(states, roots[-SAMPLES:], shared[-SAMPLES:], strict=True):
            p += one.probabilities(state, root, told_shared)
        sums = [one.sums(v) for v in (np.log10(p / SAMPLES), np.log10(count + 0.1)[one.w], (count > 0)[one.w])]
        body = [_pack(a, b, c.astype(np.int32)) for a, b, c in zip(*sums, strict=True)]
        n = len(one.chunks)
        trim()
        return pa.table({"chunk": pa.array(one.chunks, pa.int64()), "ids": pa.array([False] * n), "body": pa.array(body, pa.binary())})

    return run


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _documents(train_tokens: int, vocabulary: int):
    """Sorted rows of chunks (ids first) to the rows of their documents."""
    per_token = np.log10(train_tokens + 0.1 * (vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, meta, sums = None, None, None

        def out() -> pa.RecordBatch:
            ids, missing, counts, held = meta
            n = len(ids)
            columns = [
                pa.array(ids, pa.int64(), mask=missing.astype(bool)),
                pa.array(held.astype(bool)),
                pa.array(counts.astype(np.int64)),
                pa.array(sums[2].astype(np.int64)),
                pa.array(np.full(n, train_tokens), pa.int64()),
                pa.array(sums[1] - counts * per_token),
                pa.array(sums[0]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

        for batch in batches:
            for chunk, ids, body in zip(batch.column("chunk").to_pylist(), batch.column("ids").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if chunk != now and meta is not None:
                    yield out()
                now = chunk
                got = _unpack(body)
                if ids:
                    meta, sums = got, [np.zeros(len(got[0])) for _ in range(3)]
                else:
                    for s, g in zip(sums, got, strict=True):
                        s += g
        if meta is not None:
            yield out()

    return run


def busy_contexts(source: DataFrame, part_tokens: int) -> tuple[Busy, np.ndarray, int]:
    """Busy words and pairs, the codes of the common words by falling number, and about the
    number of tokens: from one document in PLANNED, and the bytes of all."""
    room = max(1.0, part_tokens * ROOM)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    part = F.pmod(F.xxhash64(F.lit(3), "doc_id", F.monotonically_increasing_id()), F.lit(PLANNED)) == 0
    marked = source.select("text", size.alias("size"), part.alias("part"))
    sums = marked.agg(F.sum("size").alias("every"), F.sum(F.when(F.col("part"), F.col("size"))).alias("some")).first()
    every, some = sums["every"] or 0, sums["some"] or 0
    seen = marked.filter("part").select("text").mapInArrow(tidy(_counting(room / max(1.0, every / 6))), "kind long, key long, n long")
    seen = written(seen.groupBy("kind", "key").agg(F.sum("n").alias("n")), "seen")
    row = seen.filter("kind < 0").first()
    scale = every / some if some else 1.0
    total = int(row["n"] * scale) if row and some else every
    keys: dict[int, list[tuple[int, int]]] = {}
    for r in seen.filter((F.col("kind") >= 0) & (F.col("n") * scale > room / 2)).select("kind", "key", "n").collect():
        keys.setdefault(r["kind"], []).append((r["key"], int(r["n"] * scale)))
    common = seen.filter("kind = 0").orderBy(F.col("n").desc(), "key").limit(COMMON).select("key").collect()
    common = np.array([r["key"] for r in common], np.int64).astype(np.uint64)
    return Busy(keys, room), common, total


def _bucketed(parts: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """parts as a table of the shared folder in buckets by part, and the table's name."""
    spark, path = parts.sparkSession, scratch(parts.sparkSession)
    name = "counted_" + path.rsplit("-", 1)[-1]
    parts.write.bucketBy(buckets, "part").sortBy("part").option("path", path).option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.block.size", str(16 << 20)).saveAsTable(name)
    return spark.table(name), name


def _totals(got: DataFrame, busy: Busy) -> list[np.ndarray]:
    """Customers and tables of the shared middle restaurants and leaves, summed over the buckets."""
    m, n = len(busy.keys[0]), len(busy.keys[1])
    every = np.zeros(2 * (m + n))
    if m:
        for r in got.filter("part < 0").select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col").alias("x")).collect():
            every[r["pos"]] = r["x"]
    return [every[: 2 * m].reshape(2, m), every[2 * m :].reshape(2, n)]


def scored(docs: DataFrame, held_out, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    held_out: the column expression of the rows that are not learned from.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    busy, common, total = busy_contexts(source, part_tokens)
    sent_common = spark.sparkContext.broadcast(common)
    parts = max(LEAST_PARTS, -(-total // part_tokens))
    buckets = max(8, parts // 4)
    packed = source.mapInArrow(tidy(_chunks(parts, busy, common)), "part int, chunk long, body binary").repartition(parts, "part")
    # the rows of chunks (each a part below zero) pass through unchanged
    counted, name = _bucketed(packed.groupBy("part").applyInArrow(_preparing(buckets, sent_common, busy), "part int, chunk long, body binary"), parts)
    spark.sparkContext._jvm.System.gc()  # what the shuffle left behind can go
    body = counted.filter("part >= 0").select("part", "body").groupBy("part")
    answers, state, known, train, every = spark.createDataFrame([], ROOT), None, [], 0, []
    for sweep in range(1 + BURN_IN + SAMPLES):
        sent = body.cogroup(answers.groupBy("part")).applyInArrow(_sending(list(known)), "bucket int, part int, body binary")
        sent = sent if state is None else sent.unionByName(state)
        got = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(tidy(_seating(sweep, known[-1] if known else None, busy)), ROOT)
        got = written(got, f"root-{sweep}")
        spark.sparkContext._jvm.System.gc()
        sums = got.agg(F.sum("customers").alias("c"), F.sum("tables").alias("t"), F.sum("vocabulary").alias("v"), F.sum("tokens").alias("n")).first()
        train = train if known else sums["n"] or 0
        known.append(Root(sums["c"] or 0.0, sums["t"] or 0.0, known[0].vocabulary if known else sums["v"] or 0, *_totals(got, busy)))
        state = got.filter("part < 0").select("bucket", "part", "body")
        every.append(got.filter("part >= 0"))
        # the first answers tell of settled words too
        answers = every[0].unionByName(every[-1]) if sweep else every[0]
    answers = every[0].filter("bucket >= 0")
    for got in every[-SAMPLES:]:
        answers = answers.unionByName(got)
    sums = body.cogroup(answers.groupBy("part")).applyInArrow(_scoring(known), SUMS)
    ids = counted.filter("part < 0").select("chunk", F.lit(True).alias("ids"), "body")
    both = ids.unionByName(sums).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("ids").desc())
    out = written(both.mapInArrow(tidy(_documents(train, known[0].vocabulary)), OUT), "scores")
    spark.sql(f"DROP TABLE {name}")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), crc_fold("doc_id", 10) == 0)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
