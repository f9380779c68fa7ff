"""Helpers of the training-data operators: tables, scratch tables, words, folds."""

from __future__ import annotations

import uuid

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder, ship

#: Rows and bytes that a kernel takes of an Arrow batch at once (the batches themselves are
#: bounded by Spark, at 64 MB); one longer text is a piece of its own.
DOC_BATCH, DOC_BYTES = 256, 8 << 20
_CACHE_WORDS = 80_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces_of(batch, rows: int = DOC_BATCH, size: int = DOC_BYTES):
    """A batch in pieces of at most so many rows and (beyond one row) bytes."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > size:
            n = (n + 1) // 2
        yield batch.slice(at, n)
        at += n


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the session's shared one (session.shared_folder)."""
    return f"{shared_folder(spark)}/vistaframe-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut lineage
    that outlives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small driver-made table as literals of the plan (no RDD, no Python scan)."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def crc_fold(column: str, parts: int) -> Column:
    """crc32 of the id as decimal text, modulo parts; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(-1))


#: What a worker process keeps between tasks of one kernel, by the kernel's name.
KEPT: dict[str, object] = {}


def tidy(run, keeps: str = ""):
    """A kernel that sees batches in bounded pieces and leaves a reused worker process small:
    what other kernels kept goes first, and freed memory returns to the system at the end
    of the task."""

    def wrapped(batches):
        for name in [k for k in KEPT if k != keeps]:
            del KEPT[name]
        yield from run(piece for batch in batches for piece in pieces_of(batch))
        release()

    return wrapped


def release() -> None:
    import gc

    gc.collect()
    trim()


def trim() -> None:
    """Return freed memory to the system, without a search for cycles."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


class WordCodes(dict):
    """64-bit codes of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.

    bytes.lower() and bytes.split() touch exactly those ASCII characters.
    """
    return utf8(text).lower().split()


def word_codes(texts: list[str | None], cache: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of the texts in one array, and the words of each text."""
    lists = [words(t) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((cache[w] for ws in lists for w in ws), np.uint64, int(counts.sum()))
    return flat, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that a result's columns of these names are to replace."""
    taken = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in taken])


def has_letter(text: str | None) -> bool:
    """Whether the text has a character of the Unicode categories L* (numerals are none)."""
    return text is not None and LETTER.search(text) is not None


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept_rows(docs: DataFrame, text: str, make_test) -> DataFrame:
    """Rows of docs, unchanged and with its schema, whose text passes; make_test() gives, in
    the worker, a function from a list of texts to a list of booleans."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        test = make_test()
        for batch in batches:
            keep = test(batch.column(text).cast(pa.string()).to_pylist())
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


WORD_PATTERN = r"[^\x20\x09-\x0D]+"
LETTER = regex.compile(r"\p{L}")


def sample_ids(df: DataFrame, key: str, bound: int, by: list[str] | None = None) -> DataFrame:
    """At most bound rows of the narrow table df, spread by a hash of key (of each class in by).

    Every class that is not null has a row at least; so with more classes than bound, there
    are as many rows as classes.
    """
    rank = F.xxhash64(F.lit(17), F.col(key))
    if not by:
        return df.orderBy(rank, key).limit(bound)
    known = df.filter(F.col(by[0]).isNotNull())
    sizes = known.groupBy(F.col(by[0]).alias("_class")).agg(F.approx_count_distinct(key).alias("_keys"))
    quota = max(1, bound // max(1, sizes.count()))
    # of a large class only about twice the quota's keys, those with the least hashes, are sorted
    place = rank.cast("double") / 2.0**64 + 0.5
    near = known.join(F.broadcast(sizes), F.col(by[0]) == F.col("_class")).filter(place * F.col("_keys") <= 2 * quota + 100)
    order = Window.partitionBy(by[0]).orderBy(rank, key)
    return near.withColumn("_turn", F.row_number().over(order)).filter(F.col("_turn") <= quota).select(*df.columns)
