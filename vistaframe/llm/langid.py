"""Language identification by a byte convolutional network.

Texts are lower-cased UTF-8 cut into windows of WINDOW bytes (the last one padded).
Embedded bytes pass filters of several widths; each filter's largest response in a
window, rectified, feeds a softmax over the languages. The network is trained in numpy
with Adam on windows of labelled texts. For scoring, embedding and filters are folded
into tables indexed by byte pairs and bytes, so a batch of windows needs only look-ups,
sums and a maximum. A text's prediction is the softmax of the mean logits of all of its
windows, so whole texts count, never prefixes.

The fit reads at most SAMPLE documents of the training folds, evenly by language, and at
most WINDOWS windows spread over each (documented bounds). The model has a fixed size
and is sent as a broadcast.

Defined cases: a null text or one without a letter is `und` with score 0; rows without a
language are not learned from; with one language learned, every text with a letter is
that language; with none, `und`; repeated rows repeat; an empty table gives an empty
result; further columns are kept as the caller selects.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import crc_fold, has_letter, kept_rows, sample_ids, table, tidy, without

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 8
SAMPLE, WINDOWS = 2400, 4
EPOCHS, BATCH, RATE = 6, 64, 0.004
UNKNOWN = "und"
_PAD = max(WIDTHS) - 1


def windows(text: str) -> np.ndarray:
    """The text's windows, each with a padded tail for the widest filter."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    rows = max(1, -(-len(raw) // WINDOW))
    out = np.zeros((rows, WINDOW + _PAD), np.uint8)
    flat = np.zeros(rows * WINDOW, np.uint8)
    flat[: len(raw)] = raw
    out[:, :WINDOW] = flat.reshape(rows, WINDOW)
    return out


class Network:
    """Parameters, training and folded tables of the network."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)}
        for k in WIDTHS:
            self.p[f"w{k}"] = rng.normal(0, 1 / np.sqrt(k * EMBED), (k, EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{k}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.p["bias"] = np.zeros(len(languages), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["embed"][x]
        pooled, where = [], []
        for k in WIDTHS:
            r = sum(e[:, j : j + WINDOW] @ p[f"w{k}"][j] for j in range(k)) + p[f"b{k}"]
            at = r.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        logits = h @ p["out"] + p["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"out": h.T @ q, "bias": q.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = (q @ p["out"].T) * (h > 0)
        row = np.arange(n)[:, None]
        for i, k in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{k}"] = d.sum(axis=0)
            gw = np.empty_like(p[f"w{k}"])
            for j in range(k):
                byte = x[row, where[i] + j]
                gw[j] = np.einsum("nfe,nf->ef", p["embed"][byte], d)
                np.add.at(g["embed"], byte.ravel(), (d[:, :, None] * p[f"w{k}"][j].T[None]).reshape(-1, EMBED))
            g[f"w{k}"] = gw
        return g

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                step += 1
                rate = RATE * (1 - epoch / (EPOCHS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in self.gradients(x[rows], y[rows]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages, dtype=str), **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as f:
            net = cls([str(x) for x in f["languages"]])
            net.p = {k: f[k] for k in net.p}
        return net


class Scorer:
    """Folded tables: responses of all filters to a byte pair, and to the third and fourth byte."""

    def __init__(self, net: Network):
        self.net, self.size = net, len(WIDTHS) * FILTERS
        parts = {(k, j): net.p["embed"] @ net.p[f"w{k}"][j] for k in WIDTHS for j in range(k)}
        at = {k: slice(i * FILTERS, (i + 1) * FILTERS) for i, k in enumerate(WIDTHS)}
        self.pair = np.zeros((256, 256, self.size), np.float32)
        self.rest = [np.zeros((256, self.size), np.float32) for _ in range(2, max(WIDTHS))]
        for k in WIDTHS:
            self.pair[:, :, at[k]] = parts[k, 0][:, None] + parts[k, 1][None] + net.p[f"b{k}"]
            for j in range(2, k):
                self.rest[j - 2][:, at[k]] = parts[k, j]
        self.pair = self.pair.reshape(65536, self.size)
        # filters are ordered by width, so byte j only touches those from the first width above j on
        self.start = [next(i for i, k in enumerate(WIDTHS) if k > j) * FILTERS for j in range(2, max(WIDTHS))]
        self.rest = [np.ascontiguousarray(r[:, s:]) for r, s in zip(self.rest, self.start, strict=True)]

    def logits(self, x: np.ndarray, rows: int = 16) -> np.ndarray:
        out = np.empty((len(x), self.size), np.float32)
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            code = part[:, :WINDOW].astype(np.intp) << 8 | part[:, 1 : WINDOW + 1]
            r = self.pair[code]
            for j, (extra, start) in enumerate(zip(self.rest, self.start, strict=True), 2):
                r[:, :, start:] += extra[part[:, j : WINDOW + j]]
            out[at : at + rows] = r.max(axis=1)
        return np.maximum(out, 0) @ self.net.p["out"] + self.net.p["bias"]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        who = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.net.languages:
            return names, scores
        for start in range(0, len(who), 64):
            some = who[start : start + 64]
            cut = [windows(texts[i]) for i in some]
            logits = self.logits(np.concatenate(cut))
            at = np.cumsum([0] + [len(c) for c in cut[:-1]])
            mean = np.add.reduceat(logits.astype(float), at, axis=0) / np.array([len(c) for c in cut])[:, None]
            q = np.exp(mean - mean.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            best = q.argmax(axis=1)
            for i, b, row in zip(some, best.tolist(), q, strict=True):
                names[i], scores[i] = self.net.languages[b], float(row[b])
        return names, scores


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, out = [], []
        for lang, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if has_letter(text):
                w = windows(text)
                langs.append(lang)
                out.append(w[np.unique(np.linspace(0, len(w) - 1, WINDOWS).astype(int))].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["label", "body"])


def fit(docs: DataFrame, parts: int = 3, held: int = 1, bound: int = SAMPLE) -> bytes:
    """A network learned from documents whose fold is not held."""
    ship(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("pick"), F.col("lang").cast("string").alias("label")).filter("pick IS NOT NULL AND label IS NOT NULL")
    picked = sample_ids(known.filter(crc_fold("pick", parts) != held), "pick", bound, ["label"])
    rows = docs.join(F.broadcast(picked), F.col("doc_id").cast("long") == F.col("pick")).select(F.col("text").cast("string").alias("text"), "label").mapInArrow(tidy(_spread), "label string, body binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["body"])))
    languages = sorted({r["label"] for r in rows})
    net = Network(languages)
    if len(languages) > 1:
        bodies = [np.frombuffer(r["body"], np.uint8).reshape(-1, WINDOW + _PAD) for r in rows]
        y = np.repeat([languages.index(r["label"]) for r in rows], [len(b) for b in bodies])
        net.train(np.concatenate(bodies), y)
    return net.save()


def identified(docs: DataFrame, model: bytes) -> DataFrame:
    """The columns of docs, lang_pred and score (columns of docs so named give way)."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    ship(docs.sparkSession)
    docs = without(docs, "lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network.load(sent.value))
        for batch in batches:
            langs, scores = scorer.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), schema)


def recognised(docs: DataFrame, model: bytes, least: float = 0.5) -> DataFrame:
    """Rows of docs, unchanged, with a letter and a language at least that probable."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(Network.load(sent.value))

        def test(texts):
            langs, scores = scorer.predict(texts)
            return [lang != UNKNOWN and p >= least for lang, p in zip(langs, scores, strict=True)]

        return test

    return kept_rows(docs, "text", make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    out = identified(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), model)
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
