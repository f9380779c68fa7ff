"""Toxic spans by a linear-chain conditional random field, and document scores.

The tables label documents, so the tokens to learn from are labelled first: cue words
are chosen greedily among words that occur in toxic documents of the training folds
and (nearly) never in clean ones, each time the word that explains most toxic
documents not explained yet; their occurrences in toxic documents are the tagged
tokens. The field has two states; a token's evidence comes from hashed weights of the
word and its two neighbours. It is trained with AdaGrad on the exact gradient
(forward-backward marginals minus tags) over stretches of CHAIN tokens; every stretch of
a sampled document is trained on.

With two states the forward and backward messages are odds, and each step is one
fractional linear map, done for all stretches of a batch at once. In scoring a text is one
chain: the maps of its stretches are composed first, and then give each stretch the
messages that enter it from both sides. Beyond its end a text counts as clean. A document's score is
a logistic of its largest marginal, of the sum of its raised marginals and of its
length, calibrated on the training sample;
offending offsets are runs of tokens whose marginal reaches one half, as character
positions in the text.

The fit reads at most SAMPLE labelled documents, evenly by class, and chooses at most CUES
cues (documented bounds); features as frequent and as one-sided as these join them.
Scoring reads whole texts. The model has a fixed size and is sent as a broadcast.

Defined cases: a null or empty text has no token and scores as no evidence; null
labels are not learned from; with one class or none learned, every score is the share
of toxic labels (0 without labels); repeated rows repeat; an empty table gives an
empty result; further columns are kept, but for those named score and spans, which the
results replace.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import crc_fold, table, tidy, utf8, without
from .quality import labelled_sample

BITS = 17
CHAIN = 64
SAMPLE = 5000
EPOCHS, RATE = 6, 0.5
CUE_LIFT, CUE_LEAST, CUES = 6.0, 0.004, 400
_KEPT = 80_000
_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: Beginnings of a word, in bytes, that have weights of their own beside the whole word.
STEMS = (4, 5, 6, 7, 8)
KINDS = 1 + len(STEMS)


class Types(dict):
    """Numbers of the distinct raw words of a worker, and the weight numbers of each:
    of the whole word (lower-cased, outer punctuation stripped) and of its beginnings."""

    def __init__(self):
        super().__init__()
        self.lists: list[list[int]] = [[] for _ in range(KINDS)]

    def __missing__(self, word: bytes) -> int:
        plain = word.lower().strip(_EDGE)
        for k, size in enumerate((None, *STEMS)):
            part = plain[:size]
            self.lists[k].append(1 + xxhash.xxh3_64_intdigest(part, seed=k) % ((1 << BITS) - 1) if part and (size is None or len(plain) > size) else 0)
        n = self[word] = len(self.lists[0]) - 1
        return n

    def arrays(self) -> np.ndarray:
        return np.array(self.lists, np.int64).reshape(KINDS, -1)


def types(text: str | None, known: Types) -> np.ndarray:
    ws = utf8(text).split()
    return np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))


def neighbours(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes before and after each token, 0 outside the text."""
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    return before, after


def _step(e: np.ndarray, f: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward odds at a token with evidence odds e, from those at the token before."""
    return e * (a[0, 1] + a[1, 1] * f) / (a[0, 0] + a[1, 0] * f)


def _back(m: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Backward odds at a token, from evidence times backward odds at the next."""
    return (a[1, 0] + a[1, 1] * m) / (a[0, 0] + a[0, 1] * m)


def _composed(steps: list[tuple], size: int) -> np.ndarray:
    """The product of fractional linear maps ((p, q), (r, s)), the last one outermost."""
    out = np.zeros((2, 2, size))
    out[0, 0] = out[1, 1] = 1.0
    for p, q, r, s in steps:
        out = np.stack([p * out[0] + q * out[1], r * out[0] + s * out[1]])
        out /= out.max(axis=(0, 1))
    return out


def linked_odds(u: np.ndarray, a: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of texts whose stretches stand in consecutive rows of u.

    stretches: the number of rows of each text. The same as marginal_odds of whole texts.
    """
    e = np.exp(np.clip(u, -30, 30)).T.copy()
    size, first = e.shape[1], np.cumsum(np.r_[0, stretches[:-1]])
    enter, leave = np.ones(size), np.ones(size)
    if (stretches > 1).any():
        ahead = _composed([(a[1, 1] * e[t], a[0, 1] * e[t], a[1, 0], a[0, 0]) for t in range(len(e))], size)
        behind = _composed([(a[1, 1] * e[t], a[1, 0], a[0, 1] * e[t], a[0, 0]) for t in range(len(e) - 1, 0, -1)], size)
        apply = lambda m, i, x: (m[0, 0, i] * x + m[0, 1, i]) / (m[1, 0, i] * x + m[1, 1, i])
        # the first token of a text has no step before it: its odds are the evidence alone
        out = e[0].copy()
        inner = _composed([(a[1, 1] * e[t], a[0, 1] * e[t], a[1, 0], a[0, 0]) for t in range(1, len(e))], size)
        last_out = np.empty(size)
        for k in range(int(stretches.max())):
            at = first[stretches > k] + k
            if k:
                enter[at] = last_out[at - 1]
                last_out[at] = apply(ahead, at, enter[at])
            else:
                last_out[at] = apply(inner, at, out[at])
        for k in range(int(stretches.max()) - 1, 0, -1):
            at = first[stretches > k] + k
            leave[at - 1] = _back(e[0, at] * apply(behind, at, leave[at]), a)
    f, b = np.empty_like(e), np.empty_like(e)
    f[0] = _step(e[0], enter, a)
    f[0, first] = e[0, first]
    for t in range(1, len(e)):
        f[t] = _step(e[t], f[t - 1], a)
    b[-1] = leave
    for t in range(len(e) - 2, -1, -1):
        b[t] = _back(e[t + 1] * b[t + 1], a)
    return f.T, b.T


def marginal_odds(u: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of state 1 for chains in rows: forward, backward, and evidence odds.

    a holds the transition factors a[from][to]; the marginal odds are forward * backward.
    """
    e = np.exp(np.clip(u, -30, 30)).T.copy()
    f, b = np.empty_like(e), np.empty_like(e)
    f[0] = e[0]
    for t in range(1, len(e)):
        f[t] = _step(e[t], f[t - 1], a)
    b[-1] = 1.0
    for t in range(len(e) - 2, -1, -1):
        b[t] = _back(e[t + 1] * b[t + 1], a)
    return f.T, b.T, e.T


def summary(marginal: np.ndarray) -> np.ndarray:
    """Log odds of the largest marginal, log sum of the raised ones, log length, one."""
    if not len(marginal):
        return np.array([-12.0, np.log(1e-3), 0.0, 1.0])
    top = min(max(float(marginal.max()), 1e-6), 1 - 1e-6)
    raised = float(marginal[marginal > 0.01].sum())
    return np.array([np.log(top / (1 - top)), np.log(raised + 1e-3), np.log1p(len(marginal)), 1.0])


class Field:
    """Weights of the field and its training."""

    def __init__(self):
        self.w = np.zeros((KINDS + 2, 1 << BITS))
        self.bias, self.trans = -4.0, np.zeros((2, 2))
        self.doc = np.array([1.0, 0.0, 0.0, 0.0])

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        """rows: codes of word, beginnings, previous and next word; code 0 has no weight."""
        return sum(self.w[k][rows[k]] for k in range(KINDS + 2)) + self.bias

    def train(self, rows: np.ndarray, tags: np.ndarray, seed: int = 3) -> None:
        """rows: (KINDS + 2, chains, CHAIN) codes as for evidence; padding has code -1."""
        rng = np.random.default_rng(seed)
        g2w, g2b, g2t = np.full_like(self.w, 1e-2), 1e-2, np.full((2, 2), 1e-2)
        real = rows[0] >= 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(tags))
            for at in range(0, len(order), 64):
                i = order[at : at + 64]
                ok, y = real[i], tags[i].astype(float)
                x = np.maximum(rows[:, i], 0)
                u = np.where(ok, self.evidence(x), -30.0)
                a = np.exp(self.trans)
                f, b, e = marginal_odds(u, a)
                odds = f * b
                p = odds / (1 + odds)
                d = np.where(ok, p - y, 0.0)
                # pair marginals: forward odds at t, evidence and backward odds at t + 1
                n = np.stack([np.ones_like(f[:, 1:]), e[:, 1:] * b[:, 1:]], axis=-1)
                pair = np.stack([np.ones_like(f[:, :-1]), f[:, :-1]], axis=-1)[..., :, None] * a * n[..., None, :]
                pair /= pair.sum(axis=(-1, -2), keepdims=True)
                both = (ok[:, 1:] & ok[:, :-1])[..., None, None]
                seen = np.zeros_like(pair)
                np.put_along_axis(seen.reshape(*seen.shape[:2], 4), (2 * y[:, :-1] + y[:, 1:]).astype(int)[..., None], 1.0, 2)
                gt = ((pair - seen) * both).sum(axis=(0, 1)) / len(i) + 1e-3 * self.trans
                g2t += gt**2
                self.trans -= RATE * gt / np.sqrt(g2t)
                gb = d.sum() / len(i)
                g2b += gb**2
                self.bias -= RATE * gb / np.sqrt(g2b)
                for k in range(KINDS + 2):
                    index, inverse = np.unique(x[k][ok], return_inverse=True)
                    g = np.bincount(inverse, d[ok], len(index)) / len(i) + (1e-5 if k < KINDS else 3e-4) * self.w[k][index]
                    g2w[k][index] += g**2
                    self.w[k][index] -= np.where(index > 0, RATE * g / np.sqrt(g2w[k][index]), 0.0)

    def marginals(self, lists: list[np.ndarray], codes: np.ndarray) -> list[np.ndarray]:
        """Marginal probability of the toxic state for every token of every text.

        lists: numbers of the tokens' types; codes: the weight numbers of each type.
        """
        sizes = np.array([len(c) for c in lists], np.int64)
        chains = -(-sizes // CHAIN)
        u = np.full(int(chains.sum()) * CHAIN, -30.0)
        if not len(u):
            return [np.empty(0) for _ in lists]
        own = sum(self.w[k][codes[k]] for k in range(KINDS)) + self.bias
        as_before, as_after = self.w[KINDS][codes[0]], self.w[KINDS + 1][codes[0]]
        starts = np.cumsum(np.r_[0, chains[:-1]]) * CHAIN
        for start, at in zip(starts.tolist(), lists, strict=True):
            if len(at):
                part = own[at]
                part[1:] += as_before[at[:-1]]
                part[:-1] += as_after[at[1:]]
                u[start : start + len(at)] = part
        f, b = linked_odds(u.reshape(-1, CHAIN), np.exp(self.trans), chains[chains > 0])
        odds = (f * b).ravel()
        p = odds / (1 + odds)
        return [p[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]

    def score(self, marginal: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(summary(marginal) @ self.doc, -35, 35))))

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, w=self.w.astype(np.float32), bias=self.bias, trans=self.trans, doc=self.doc)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Field:
        field = cls()
        with np.load(io.BytesIO(data)) as f:
            field.w, field.trans = f["w"].astype(float), f["trans"]
            field.bias, field.doc = float(f["bias"]), f["doc"]
        return field


def cue_features(docs: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Features (kind << BITS | code) that tag tokens: a greedy cover of the toxic documents.

    docs: codes (KINDS, tokens) and label of each document.
    """
    kinds = np.arange(KINDS, dtype=np.int64)[:, None] << BITS
    sets = [np.unique((c + kinds)[c > 0]).astype(np.int32) for c, _ in docs]
    label = np.array([y for _, y in docs])
    size = KINDS << BITS

    def frequency(which: np.ndarray) -> np.ndarray:
        parts = [sets[i] for i in which]
        return np.bincount(np.concatenate(parts), minlength=size) if parts else np.zeros(size, np.int64)

    toxic, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    every = frequency(toxic)
    lift = (every / max(1, len(toxic))) / ((frequency(clean) + 0.5) / max(1, len(clean)))
    fit = lift >= CUE_LIFT
    feats = [sets[i][fit[sets[i]]] for i in toxic]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    feat = np.concatenate(feats) if feats else np.empty(0, np.int64)
    open_ = np.ones(len(feat), bool)
    least, cues = max(3, CUE_LEAST * len(toxic)), []
    while len(cues) < CUES and open_.any():
        count = np.bincount(feat[open_], minlength=size)
        word = int(np.argmax(count * (1 << 20) + np.minimum(every, (1 << 20) - 1)))  # then the more frequent, then the first
        if count[word] < least:
            break
        cues.append(word)
        covered = owner[open_ & (feat == word)]
        open_ &= ~np.isin(owner, covered)
    # features as frequent and as one-sided as the cues stand beside them
    floor = 0.5 * min((every[w] for w in cues if every[w] >= 0.1 * len(toxic)), default=len(toxic))
    return np.union1d(np.array(cues, np.int64), np.flatnonzero(fit & (every >= max(floor, 0.1 * len(toxic)))))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = Types()
        lists = [types(t, known) for t in batch.column("text").to_pylist()]
        codes = known.arrays()
        got = [codes[:, at].astype(np.int32).tobytes() for at in lists]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(got, pa.binary())], names=["label", "codes"])


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic by damped Newton steps."""
    theta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        g = x.T @ (p - y) + 0.1 * theta
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(theta))
        step = np.linalg.solve(h, g)
        theta -= step * min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
    return theta


def training_chains(docs: list[tuple[np.ndarray, int]], cues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chains of the documents (rows as for Field.train), and the tags of their tokens."""
    kinds = np.arange(KINDS, dtype=np.int64)[:, None] << BITS
    sizes = [-(-code.shape[1] // CHAIN) * CHAIN for code, _ in docs]
    rows, tags = np.full((KINDS + 2, sum(sizes)), -1, np.int32), np.zeros(sum(sizes), np.int8)
    for (code, y), at in zip(docs, np.cumsum([0, *sizes[:-1]]).tolist(), strict=True):
        here = slice(at, at + code.shape[1])
        rows[:KINDS, here] = code
        rows[KINDS:, here] = neighbours(code[0])
        if y == 1:
            tags[here] = np.isin(code + kinds, cues).any(axis=0)
    return rows.reshape(KINDS + 2, -1, CHAIN), tags.reshape(-1, CHAIN)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", parts: int = 5, bound: int = SAMPLE) -> bytes:
    """A field learned from labels of documents whose fold is not 0."""
    rows = labelled_sample(docs, labels, column, parts, bound).mapInArrow(tidy(_extract), "label int, codes binary").collect()
    data = sorted((bytes(r["codes"]), r["label"]) for r in rows)
    del rows
    data = [(np.frombuffer(c, np.int32).reshape(KINDS, -1), y) for c, y in data]
    field = Field()
    if len({y for _, y in data}) < 2:
        share = float(np.mean([y for _, y in data])) if data else 0.0
        field.doc = np.array([0.0, 0.0, 0.0, 35.0 * (2 * share - 1)])
        return field.save()
    cues = cue_features(data)
    rows, marks = training_chains(data, cues)
    field.train(rows, marks)
    del rows, marks
    x = np.stack([summary(field.marginals([np.arange(code.shape[1])], code)[0]) for code, _ in data])
    field.doc = _calibrate(x, np.array([y for _, y in data], float))
    return field.save()


def offsets(text: str, marginal: np.ndarray, least: float = 0.5) -> list[dict]:
    """Character positions [start, end) of runs of tokens whose marginal reaches least."""
    if not len(marginal) or marginal.max() < least:
        return []
    out: list[dict] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if i < len(marginal) and marginal[i] >= least:
            if last == i - 1:
                out[-1]["stop"], out[-1]["marginal"] = m.end(), max(out[-1]["marginal"], float(marginal[i]))
            else:
                out.append({"start": m.start(), "stop": m.end(), "marginal": float(marginal[i])})
            last = i
    return out


def tagged(docs: DataFrame, model: bytes, spans: bool = True) -> DataFrame:
    """The columns of docs, score, and with spans the offending offsets (columns of docs so
    named give way)."""
    from pyspark.sql.types import StructType

    ship(docs.sparkSession)
    docs = without(docs, "score", *["spans"] * spans)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = "score double" + (", spans array<struct<start:int,stop:int,marginal:double>>" if spans else "")
    schema = StructType(list(docs.schema.fields) + list(StructType.fromDDL(added).fields))
    names = docs.columns
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, known = Field.load(sent.value), Types()
        for batch in batches:
            if len(known) >= _KEPT:
                known = Types()
            texts = batch.column("text").to_pylist()
            lists = [types(t, known) for t in texts]
            got = field.marginals(lists, known.arrays())
            columns = [*batch.columns, pa.array([field.score(m) for m in got], pa.float64())]
            if spans:
                columns.append(pa.array([offsets(t or "", m) for t, m in zip(texts, got, strict=True)], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", *["spans"] * spans])

    return docs.mapInArrow(tidy(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    out = tagged(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), model)
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
