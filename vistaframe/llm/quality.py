"""Quality classifier: hashed word n-gram logistic regression trained by FTRL.

Features are hashes of words, of word shapes, and of adjacent pairs of both; the shape
of a pair also says whether the words are equal. A document is the sparse vector of
its features' relative frequencies (square-rooted and of length one). Weights are
trained one document at a time with follow-the-regularised-leader updates (per-weight
rates, L1 and L2), and a score is the logistic of a sparse dot product. Whole texts
are read, in training and in scoring; a word of more than LONG bytes (text without
spaces) counts as its pieces of PIECE bytes, which are words of their own.

The fit reads at most SAMPLE labelled documents of the training folds (a documented
bound, spread by a hash of the id); everything else covers all rows. The weights are
a vector of fixed size, sent as a broadcast.

Defined cases: a null or empty text has only the bias, so its score is the bias's;
labels that are null or whose document is absent are not learned from; repeated label
rows of an id count once each; without any usable label, or with one class only, the
score is the share of that class (0.5 without labels); an empty table gives an empty
result; ties need no rule; further columns are kept, but for one named score, which
the score replaces.
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
from .common import crc_fold, kept_rows, mix, sample_ids, table, tidy, utf8, without

BITS = 18
SAMPLE = 4000
EPOCHS = 4
LONG, PIECE = 64, 6
_KEPT = 80_000
_SHAPE = re.compile(rb"([A-Z]+|[a-z\x80-\xff]+|[0-9]+)|([^A-Za-z0-9\x80-\xff])\2*")


def shape(word: bytes) -> bytes:
    """Runs of letters and digits to one mark each; the first of other repeated marks stays."""
    out = []
    for m in _SHAPE.finditer(word):
        run = m.group()
        c = run[:1]
        if c.isupper():
            out.append(b"A" if len(run) == 1 else b"AA")
        elif c.isdigit():
            out.append(b"9")
        elif c.islower() or c >= b"\x80":
            out.append(b"a")
        else:
            out.append(c if len(run) == 1 else c + c)
    return b"".join(out)


def pieces(text: str | None) -> list[bytes]:
    """The words of a text, long ones in pieces."""
    ws = utf8(text).split()
    if max(map(len, ws), default=0) <= LONG:
        return ws
    return [p for w in ws for p in ([w] if len(w) <= LONG else [w[i : i + PIECE] for i in range(0, len(w), PIECE)])]


class _Seen(dict):
    """Numbers of the distinct words of a worker; their codes lie in two lists."""

    def __init__(self):
        super().__init__()
        self.word: list[int] = []
        self.form: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self.word.append(xxhash.xxh3_64_intdigest(word.lower()))
        self.form.append(xxhash.xxh3_64_intdigest(shape(word), seed=7))
        n = self[word] = len(self.word) - 1
        return n


class Features:
    """Hashed features of texts, with the codes of words remembered up to a bound."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = _Seen()

    def of_batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted feature numbers and their values of each text."""
        if len(self.seen) >= _KEPT:
            self.seen = _Seen()
        find = self.seen.__getitem__
        lists = [np.fromiter(map(find, ws), np.int64, len(ws)) for ws in map(pieces, texts)]
        words, forms = np.array(self.seen.word, np.uint64), np.array(self.seen.form, np.uint64)
        for at in lists:
            yield self._of(words[at], forms[at]) if len(at) else (np.empty(0, np.int64), np.empty(0))

    def _of(self, word: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = (word[1:] == word[:-1]).astype(np.uint64)
        pair = mix(word[:-1] * np.uint64(3) + word[1:])
        forms = mix(form[:-1] * np.uint64(5) + form[1:] + same)
        number = (mix(np.concatenate([word, form + np.uint64(11), pair, forms])) & self.mask).astype(np.int64)
        index, count = np.unique(number, return_counts=True)
        value = np.sqrt(count / len(word))
        return index, value / np.sqrt((value**2).sum())


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.2, seed: int = 1) -> np.ndarray:
    """Weights (the bias last) by per-coordinate FTRL-proximal updates."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for e in rng.permutation(len(examples)):
            index, value, label = examples[e]
            i = np.append(index, size - 1)
            x = np.append(value, 1.0)
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(size))


def score(weights: np.ndarray, index: np.ndarray, value: np.ndarray) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(weights[index] @ value + weights[-1], -35, 35))))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        got = list(features.of_batch(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([g[0].astype(np.int32).tobytes() for g in got], pa.binary()), pa.array([g[1].astype(np.float32).tobytes() for g in got], pa.binary())],
            names=["label", "index", "value"],
        )


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, parts: int, bound: int) -> DataFrame:
    """text, label of at most bound labelled documents outside the held-out fold.

    The ids are chosen from the narrow label table, evenly by class; the bounded list
    of ids is then broadcast to find their texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("pick"), F.col(column).cast("int").alias("label")).filter("pick IS NOT NULL AND label IN (0, 1)")
    known = known.filter(crc_fold("pick", parts) != 0)
    picked = sample_ids(known, "pick", bound, ["label"])
    return docs.join(F.broadcast(picked), F.col("doc_id").cast("long") == F.col("pick")).select(F.col("text").cast("string").alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", parts: int = 5, bound: int = SAMPLE) -> bytes:
    """Weights as bytes: learned from labels of documents whose fold is not 0."""
    ship(docs.sparkSession)
    rows = labelled_sample(docs, labels, column, parts, bound).mapInArrow(tidy(_extract), "label int, index binary, value binary").collect()
    rows.sort(key=lambda r: (bytes(r["index"]), bytes(r["value"]), r["label"]))
    data = [(np.frombuffer(r["index"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float), r["label"]) for r in rows]
    if len({d[2] for d in data}) < 2:
        weights = np.zeros((1 << BITS) + 1)
        share = float(np.mean([d[2] for d in data])) if data else 0.5
        weights[-1] = 35.0 * (2 * share - 1)
    else:
        weights = train(data)
    out = io.BytesIO()
    np.save(out, weights.astype(np.float32))
    return out.getvalue()


def scored(docs: DataFrame, model: bytes) -> DataFrame:
    """The columns of docs and score, the probability of label 1 (a column score of docs
    gives way to it)."""
    from pyspark.sql.types import DoubleType, StructType

    spark = docs.sparkSession
    ship(spark)
    docs = without(docs, "score")
    sent = spark.sparkContext.broadcast(model)
    names = docs.columns
    schema = StructType(list(docs.schema.fields)).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.load(io.BytesIO(sent.value)).astype(float)
        features = Features()
        for batch in batches:
            got = [score(weights, *f) for f in features.of_batch(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(tidy(run), schema)


THRESHOLD = 0.3


def accepted(docs: DataFrame, model: bytes, least: float = THRESHOLD) -> DataFrame:
    """Rows of docs, unchanged, that score at least least."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        weights, features = np.load(io.BytesIO(sent.value)).astype(float), Features()
        return lambda texts: [score(weights, *f) >= least for f in features.of_batch(texts)]

    return kept_rows(docs, "text", make)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    out = scored(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), model)
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
