"""Exact top-k search with block-at-a-time pruning.

Documents are vectors of integer term weights. Each shard of them is ordered into
ranges of similar documents (median cuts along the widest term) and cut into blocks.
A block keeps the largest and smallest weight of every term, so that the sum over
the query's terms bounds the score of any document in it, and a forward index of its
documents. A query visits blocks in falling order of that bound, scores whole blocks
through their forward indexes, and stops when the next bound is below its k-th score.
Equal bounds are still scored, so ties end with the smaller id.

Queries travel in packets to every shard (a stated query set against all rows, in
blocks); each shard returns k rows a query, and the best k of all shards remain.

Defined cases: vectors that are null, empty, or hold null or non-finite components
take no part; a vector whose length differs from the query's is no candidate of it;
repeated ids are candidates one by one, a row never matches its own id; fewer than k
candidates give fewer rows; an empty table gives an empty result. Scores are exact
integers; those outside the range of a long are clipped to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

SHARD_ROWS = 8192
BLOCK_ROWS = 32
PACKET_QUERIES = 1024
_EXACT = 2.0**53


def usable(column: str) -> Column:
    """True for arrays with only finite components."""
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def cut_ranges(matrix: np.ndarray, block: int = BLOCK_ROWS) -> np.ndarray:
    """Row order in which neighbouring rows are alike: median cuts of the widest column."""
    done, todo = [], [np.arange(len(matrix))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            done.append(rows)
            continue
        part = matrix[rows]
        widest = int(np.argmax(part.std(axis=0)))
        half = max(block, (len(rows) // (2 * block)) * block)
        order = np.argsort(part[:, widest], kind="stable")
        todo += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(done) if done else np.arange(0)


_whole = np.frompyfunc(int, 1, 1)  # integers of any size


class BlockIndex:
    """Blocks of one shard: term maxima and minima, and forward indexes."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, block: int = BLOCK_ROWS):
        order = cut_ranges(weights, block)
        self.ids, self.weights, self.block = ids[order], weights[order], block
        starts = np.arange(0, len(order), block)
        self.high = np.maximum.reduceat(self.weights, starts, axis=0)
        self.low = np.minimum.reduceat(self.weights, starts, axis=0)
        pad = len(starts) * block - len(order)
        self.forward = np.concatenate([self.weights, np.zeros((pad, weights.shape[1]))]).reshape(len(starts), block, -1)
        self.block_ids = np.concatenate([self.ids, np.full(pad, -1, np.int64)]).reshape(len(starts), block)
        self.real = (np.arange(len(starts) * block) < len(order)).reshape(len(starts), block)
        self.scored = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return plus @ self.high.T + minus @ self.low.T

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best other rows, best first."""
        order = np.argsort(-bound, kind="stable")
        ids, scores, at, wave, floor = np.empty(0, np.int64), np.empty(0), 0, 2, -np.inf
        exact = float(np.abs(query).sum()) * max(1.0, float(np.abs(self.weights).max(initial=0))) < _EXACT
        slack = 0.0 if exact else 1e-9 * float(np.abs(bound).max(initial=0))
        while at < len(order) and (len(ids) < k or bound[order[at]] + slack >= floor):
            take = order[at : at + wave]
            if len(ids) >= k:
                take = take[bound[take] + slack >= floor]
            at, wave = at + wave, wave * 2
            block = self.forward[take].reshape(-1, len(query))
            got = block @ query if exact else _whole(block) @ _whole(query)
            name = self.block_ids[take].ravel()
            real = self.real[take].ravel() & (name != own)
            self.scored += len(take)
            ids, scores = np.concatenate([ids, name[real]]), np.concatenate([scores, got[real]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) >= k:
                floor = float(scores[-1])
        return ids, scores


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack the rows of a task into binary packets of bounded size."""
    held: dict[tuple[int, int], list] = {}

    def flush(kind: int, width: int, rows: list) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], np.int64)
        body = np.stack([r[1] for r in rows]).astype(np.float64)
        return pa.RecordBatch.from_pydict(
            {"is_query": pa.array([bool(kind)]), "width": pa.array([width], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "body": pa.array([body.tobytes()], pa.binary())}
        )

    for batch in batches:
        asked = batch.column("is_query").to_pylist()
        for i, (name, vector) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("vector"), strict=True)):
            row = (name, np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64))
            for kind in (0, 1) if asked[i] else (0,):
                rows = held.setdefault((kind, len(row[1])), [])
                rows.append(row)
                if len(rows) >= (PACKET_QUERIES if kind else 1024):
                    yield flush(kind, len(row[1]), rows)
                    rows.clear()
    for (kind, width), rows in held.items():
        if rows:
            yield flush(kind, width, rows)


PACKET = "is_query boolean, width int, ids binary, body binary"
FOUND = "query_id long, vec_id long, score long"


def over_shards(build, answer):
    """A kernel for sharded_search: build(ids, vectors) makes a shard's index, and
    answer(index, ids, vectors) gives rows (query_id, vec_id, score) of a query packet.

    A task holds whole shards, one at a time; a shard's candidates come before its queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, held = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["width"]) != shard:
                    shard, index, held = (row["shard"], row["width"]), None, []
                ids = np.frombuffer(row["ids"], np.int64)
                body = np.frombuffer(row["body"], np.float64).reshape(len(ids), -1)
                if not row["is_query"]:
                    held.append((ids, body))
                    continue
                if index is None and held:
                    index = build(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held = []
                if index is not None:
                    yield answer(index, ids, body)

    return run


def found_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind)], names=["query_id", "vec_id", "score"])


def _answer(k: int):
    def run(index: BlockIndex, ids: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        for own, query, bound in zip(ids.tolist(), body, index.bounds(body), strict=True):
            names, scores = index.search(own, query, bound, k)
            out += [(own, n, min(max(int(s), -(2**63)), 2**63 - 1)) for n, s in zip(names.tolist(), scores.tolist(), strict=True)]
        return found_batch(out, pa.int64())

    return run


def sharded_search(vectors: DataFrame, kernel, found: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Run kernel over every (shard of candidates, all query packets).

    vectors: vec_id, vector, is_query. Shards have a bounded number of rows; the
    number of shards follows the table.
    """
    ship(vectors.sparkSession)
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(shards)).cast("int"))
    candidates = (
        dealt.select("vec_id", "vector", F.lit(False).alias("is_query"), "shard")
        .repartition(shards, "shard")
        .groupBy("shard")
        .applyInArrow(_pack_group, "shard int, " + PACKET)
    )
    asked = vectors.filter("is_query").mapInArrow(_only_queries, PACKET)
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", *[c.split()[0] for c in PACKET.split(", ")])
    both = candidates.unionByName(asked)
    return both.repartition(shards, "shard").sortWithinPartitions("shard", "width", "is_query").mapInArrow(kernel, found)


def _only_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for packet in _packets(batches):
        if packet.column("is_query")[0].as_py():
            yield packet


def _pack_group(group: pa.Table) -> pa.Table:
    shard = group.column("shard")[0].as_py()
    packets = list(_packets(iter(group.combine_chunks().to_batches())))
    out = pa.Table.from_batches(packets)
    return out.add_column(0, pa.field("shard", pa.int32()), pa.array([shard] * out.num_rows, pa.int32()))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query over all shards, ties to the smaller id.

    A ranked window with a limit: each task keeps k rows of a query before the shuffle.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, vector of integers as doubles, is_query."""
    return best_of(sharded_search(vectors, over_shards(BlockIndex, _answer(k)), FOUND), k)


def integers(df: DataFrame, scale: float = 256.0, every: int = 50) -> DataFrame:
    """The query's vectors: floor(scale * x) of each component."""
    ok = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("raw")).filter(F.col("vec_id").isNotNull() & usable("raw"))
    return ok.select("vec_id", F.transform("raw", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("vector"), (F.col("vec_id") % every == 0).alias("is_query"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return search(integers(table(spark, sf_dir, "embeddings")))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
