"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up every adjacent
pair by binary search in the sorted pair keys, takes the lowest rank of each word,
and merges all its occurrences from the left; words without a known pair are done.
Words come from cutting the composed, lower-cased text; each distinct word of a batch
is encoded once and remembered up to a bound. The vocabulary file is read on the
driver and sent as a broadcast of fixed size; executors open no local file.

Defined cases: a null text counts as empty (no ids); special tokens that occur in a
text become their ids; white space separates words and is dropped, as the vocabulary
has it; very long texts and words need memory in proportion to themselves only (a word of
more than LONG bytes is merged by a heap of its pairs instead of by rounds over all of
it); columns named as the results give way to them; repeated rows give repeated results;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import ship
from .common import KEPT, table, tidy, without

END = "</w>"
# Letters and numbers of Unicode 17, which the vocabulary's cutter (Unicode 16)
# does not know as such, as ranges of code points.
NEWER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# Capitals of Unicode 16 and 17 that Python's tables do not lower yet, as code
# points or ranges of them, each with the small letter of its first.
NEWER_CAPITALS = "1C89>1C8A A7CB>264 A7CC>A7CD A7CE>A7CF A7D2>A7D3 A7D4>A7D5 A7DA>A7DB A7DC>19B 10D50-10D65>10D70 16EA0-16EB8>16EBB"
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _class(ranges: str) -> str:
    ends = [r.split("-") for r in ranges.split()]
    return "".join(f"\\U{int(e[0], 16):08X}-\\U{int(e[-1], 16):08X}" for e in ends)


_L, _N = f"[\\p{{L}}--[{_class(NEWER_LETTERS)}]]", f"[\\p{{N}}--[{_class(NEWER_NUMBERS)}]]"
#: Pattern of the vocabulary's word cutter.
CUTTER = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{_L}+|{_N}|(?:(?!{_L}|{_N})\S)+"
_WORDS_KEPT = 80_000
#: Bytes of a word from which its pairs are merged by a heap.
LONG = 2048


def _lowered() -> dict[int, int]:
    """Small letters of NEWER_CAPITALS, of those that str.lower() leaves alone."""
    out = {}
    for entry in NEWER_CAPITALS.split():
        capitals, small = entry.split(">")
        ends = [int(x, 16) for x in capitals.split("-")]
        for i, c in enumerate(range(ends[0], ends[-1] + 1)):
            if chr(c).lower() == chr(c):
                out[c] = int(small, 16) + i
    return out


_LOWERED = _lowered()


def _within_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = [""] * 256
    for b in shown:
        letters[b] = chr(b)
    for i, b in enumerate(hidden):
        letters[b] = chr(256 + i)
    return letters


class Vocabulary:
    """Sorted pair keys with ranks and results, names of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + END] for x in letters], np.int64)

    def merged(self, ids: np.ndarray) -> list[int]:
        """The symbols of one long word, merged: a heap gives the lowest rank, then the leftmost."""
        symbol = ids.tolist()
        before, after = list(range(-1, len(symbol) - 1)), [*range(1, len(symbol)), -1]

        def ranked(at: int, a: int, b: int):
            key = (a << 32) | b
            k = int(np.searchsorted(self.keys, key))
            if k < len(self.keys) and self.keys[k] == key:
                heapq.heappush(heap, (int(self.ranks[k]), at, a, b, int(self.made[k])))

        key = (ids[:-1] << 32) | ids[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        heap = [(int(self.ranks[k]), i, symbol[i], symbol[i + 1], int(self.made[k])) for i, k in zip(np.flatnonzero(self.keys[at] == key).tolist(), at[self.keys[at] == key].tolist(), strict=True)]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbol[i] != a or symbol[j] != b:
                continue  # one of the pair has been merged since
            symbol[i], symbol[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                ranked(i, made, symbol[after[i]])
            if before[i] >= 0:
                ranked(before[i], symbol[before[i]], made)
        return [x for x in symbol if x >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each non-empty word."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            out = self._rounds([b"" if len(w) > LONG else w for w in words])
            for i in long:
                raw = np.frombuffer(words[i], np.uint8)
                ids = self.inner[raw]
                ids[-1] = self.last[raw[-1]]
                out[i] = self.merged(ids)
            return out
        return self._rounds(words)

    def _rounds(self, words: list[bytes]) -> list[list[int]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(lengths)[lengths > 0]
        ids[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_owner = [], []
        none = np.int64(len(self.keys))
        while len(ids):
            key = (ids[:-1] << 32) | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            lowest = np.repeat(np.minimum.reduceat(np.r_[rank, none], starts), sizes)
            idle = lowest == none
            hit = np.flatnonzero((rank == lowest[:-1]) & (rank != none))
            # of touching occurrences (a pair of equal symbols), every second one
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1]) if len(hit) else hit
            offset = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)])) if len(hit) else hit
            hit = hit[offset % 2 == 0]
            ids[hit] = self.made[at[hit]]
            keep = ~idle
            keep[hit + 1] = False
            done_ids.append(ids[idle])
            done_owner.append(owner[idle])
            ids, owner = ids[keep], owner[keep]
        owner = np.concatenate(done_owner) if done_owner else np.empty(0, np.int64)
        flat = np.concatenate(done_ids) if done_ids else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        ids = flat[order].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Encodes and decodes texts in batches with a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cut = regex.compile(CUTTER).findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.digits = [str(i) for i in range(len(vocabulary.names))]
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def chunks(self, text: str | None) -> list[str]:
        """Stretches without white space (composed and lower-cased), and special tokens."""
        if not text:
            return []
        if self.marks is not None and "<|" in text and (parts := self.marks.split(text)):
            if len(parts) > 1:
                out: list[str] = []
                for i, part in enumerate(parts):
                    out += ["\0" + part] if i % 2 else self._plain(part)
                return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and not _within_latin(text):
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(_LOWERED)
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() would cut there
            return regex.findall(r"[^\p{White_Space}]+", text)
        return text.split()

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are not known yet, all at once.

        Two generations are remembered: chunks that come again outlive the older one.
        """
        if len(self.known) > _WORDS_KEPT:
            self.known, self.older = {}, self.known
        new = self._unknown(chunks)
        special = self.v.special
        pieces = {c: [] if c[0] == "\0" and c[1:] in special else self._pieces(c) for c in new}
        words = self._unknown({w for ws in pieces.values() for w in ws})
        names, digits = self.v.names, self.digits
        for word, ids in zip(words, self.v.encode_words([w.encode("utf-8", "surrogatepass") for w in words]) if words else [], strict=True):
            self.known[word] = (len(ids), " ".join([digits[i] for i in ids]), " ".join([names[i] for i in ids]))
        known = self.known
        for chunk, ws in pieces.items():
            if len(ws) == 2:
                (n, ids, text), (m, more, rest) = known[ws[0]], known[ws[1]]
                known[chunk] = (n + m, f"{ids} {more}", f"{text} {rest}")
            elif not ws:
                i = special.get(chunk[1:]) if chunk[0] == "\0" else None
                known[chunk] = (0, "", "") if i is None else (1, digits[i], names[i])
            elif len(ws) > 2:
                n, ids, text = zip(*[known[w] for w in ws], strict=True)
                known[chunk] = (sum(n), " ".join(ids), " ".join(text))

    def _pieces(self, chunk: str) -> list[str]:
        """The words of a chunk; a run of letters, and one with a mark behind it, need no pattern."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.cut(chunk)

    def _unknown(self, chunks: set[str]) -> list[str]:
        """Those of neither generation; the ones of the older move to the newer."""
        new = []
        for c in chunks.difference(self.known):
            got = self.older.get(c)
            if got is None:
                new.append(c)
            else:
                self.known[c] = got
        return new

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, the ids in decimal, the decoded text (joined by a space)."""
        cut = [self.chunks(t) for t in texts]
        self.learn({c for cs in cut for c in cs})
        find = self.known.__getitem__
        out = []
        for cs in cut:
            if cs:
                sizes, ids, names = zip(*map(find, cs), strict=True)
                n = sum(sizes)
                if 0 in sizes:  # chunks without an id take no space between ids
                    ids, names = filter(None, ids), filter(None, names)
                out.append((n, " ".join(ids), " ".join(names)))
            else:
                out.append((0, "", ""))
        return out

    def restore(self, ids: list[int]) -> str:
        """Readable text of ids: bytes joined, a space after each word."""
        back = {x: b for b, x in enumerate(byte_letters())}
        out = bytearray()
        for i in ids:
            name = self.v.names[i]
            if name in self.v.special:
                out += name.encode()
                continue
            ends = name.endswith(END)
            out += bytes(back[c] for c in (name[: -len(END)] if ends else name))
            out += b" " if ends else b""
        return out.decode("utf-8", "replace").rstrip(" ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(sent) -> Encoder:
    """One encoder a worker process, with its remembered words."""
    kept = KEPT.get("bpe")
    if kept is None or kept[0] != sent.id:
        kept = KEPT["bpe"] = (sent.id, Encoder(sent.value))
    return kept[1]


class _Sent:
    """A broadcast vocabulary and a name for it."""

    def __init__(self, spark, path: str):
        self.id, self.box = path, spark.sparkContext.broadcast(Vocabulary(path))

    @property
    def value(self) -> Vocabulary:
        return self.box.value


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: bool = True, digests: bool = False, decoded: bool = True) -> DataFrame:
    """The columns of df, and of each text: n_tokens, with ids also ids (and decoded),
    with digests also ids_sha256 and decoded_sha256. text itself is dropped (select it
    under another name to keep it), and so are columns named as those that are added."""
    ship(df.sparkSession)
    sent = _Sent(df.sparkSession, path or default_path())
    added = ["n_tokens long"] + ["ids array<int>"] * ids + ["decoded string"] * (ids and decoded) + ["ids_sha256 string", "decoded_sha256 string"] * digests
    from pyspark.sql.types import StructType

    keep = without(df, text, *[a.split()[0] for a in added]).columns
    schema = StructType([df.schema[c] for c in keep] + list(StructType.fromDDL(", ".join(added)).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent)
        for batch in batches:
            got = encoder.encode(batch.column(text).to_pylist())
            columns = [batch.column(c) for c in keep] + [pa.array([g[0] for g in got], pa.int64())]
            if ids:
                flat = [np.array(g[1].split(" "), np.int32) if g[0] else np.empty(0, np.int32) for g in got]
                ends = np.cumsum([0, *map(len, flat)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))))
                if decoded:
                    columns.append(pa.array([g[2] for g in got], pa.string()))
            if digests:
                sha = [[hashlib.sha256(g[j].encode("utf-8")).hexdigest() for g in got] for j in (1, 2)]
                columns += [pa.array(s, pa.string()) for s in sha]
            yield pa.RecordBatch.from_arrays(columns, names=keep + [a.split()[0] for a in added])

    return df.select(*keep, text).mapInArrow(tidy(run, "bpe"), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return encode(docs, ids=False, digests=True)
