"""MinHash near-duplicate detection with a multi-index Hamming join.

Each document's shingle set gives POSITIONS min-hashes, of which b = 16 bits are kept;
two sets of Jaccard similarity J agree at a position with probability about J. The
signature distance of two sets is the number of positions that differ. The positions
are split into chunks; by pigeonhole two signatures within the signature threshold
CHUNKS * (ERRORS + 1) - 1 have a chunk with at most ERRORS differences, and the allowed
errors are enumerated by leaving out every choice of ERRORS positions of the chunk.
All pairs within the threshold therefore share an index key. At J = 0.8 a pair lies
beyond the threshold of 23 of 48 with a probability near 1e-6, less above it.

Documents of equal sets are one class. A bucket (one key) is first joined as a star
around its smallest member, each star pair is confirmed on the full sets, and the
confirmed links are contracted to components. Pairs inside one component need no
further look. Buckets that still hold several components are compared by signatures
in square cells of bounded size, and pairs within the threshold by bit maps of their
sets, which bound the similarity from above (sets of more than 512 shingles by a
sample of them, five standard deviations wide); only pairs of different components
that pass leave a cell, to be confirmed as well. No bucket is held whole in a task,
nothing is capped, and the final components come from all confirmed links.

Defined cases: a text that is null or without words has an empty set, is linked with
nothing and is its own component; fewer words than a shingle has count as one shingle;
rows of equal id and text are equal members; a null id is never the smallest of a
component, and a component of null ids only has a null component_id; texts of any
length count whole; an empty table gives an empty result; further columns are ignored.
Sets are held as 64-bit shingle codes, so two different shingles are taken for one
with a probability of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import WordCodes, fresh, mix, table, tidy, word_codes, written

POSITIONS, CHUNKS, ERRORS = 48, 12, 1
WIDTH = POSITIONS // CHUNKS
THRESHOLD = CHUNKS * (ERRORS + 1) - 1
PERCENT = 80
CELL = 2048
MAP_BITS, MAP_SHINGLES = 8192, 512
BEST_PAIRS = 2
BROADCAST_ROWS = 2_000_000

_rng = np.random.default_rng(1999)
_FLIP = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int, cache: WordCodes) -> list[np.ndarray]:
    """The sorted distinct shingle codes of each text."""
    flat, counts = word_codes(texts, cache)
    ends = np.cumsum(counts)
    code = flat.copy()
    for j in range(1, width):
        code = mix(code)
        code[: len(flat) - j] += flat[j:]
        # the last j entries hold no whole shingle and are never read below
    code = mix(code)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(code[end - n : end - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[end - n : end].tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(codes: np.ndarray) -> np.ndarray:
    """16 bits of each min-hash."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 4096):
        part = (codes[at : at + 4096, None] ^ _FLIP) * _TIMES
        least = np.minimum(least, part.min(axis=0))
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def bit_map(codes: np.ndarray) -> tuple[int, int, bytes]:
    """Level, number of shingles and bit map of the set's part of that level: all of its
    shingles at level 0, and half as many at each level more."""
    level = max(0, int(np.ceil(np.log2(len(codes) / MAP_SHINGLES)))) if len(codes) else 0
    part = mix(codes + np.uint64(0x5851F42D4C957F2D))
    part = part[(part >> np.uint64(64 - level)) == 0] if level else part
    bits = np.zeros(MAP_BITS, np.uint8)
    bits[(part & np.uint64(MAP_BITS - 1)).astype(np.int64)] = 1
    return level, len(part), np.packbits(bits).tobytes()


def _may_reach(size, level, taken, spare, maps, i: int, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rows ask can reach the similarity with row i, by their bit maps, and
    how alike they are at most.

    spare: shingles of a row that share a bit with another of its own.
    """
    both = np.bitwise_count(maps[ask] & maps[i]).sum(axis=1) + np.minimum(spare[ask], spare[i])
    both = np.minimum(both, np.minimum(taken[ask], taken[i]))
    whole = 100 * both >= PERCENT * (size[ask] + size[i] - both)
    union = np.maximum(1, taken[ask] + taken[i] - both)
    part = both / union >= PERCENT / 100 - 5 * np.sqrt(0.16 / union)
    return np.where(level[ask] != level[i], True, np.where(level[ask] == 0, whole, part)), both / union


def _node(codes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(codes.tobytes())).astype(np.int64))


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), width, cache)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_code"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_code", "n_shingles", "node", "sig"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column("text").to_pylist(), width, cache) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "codes"])

    return run


def _bit_maps(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column("text").to_pylist(), width, cache) if len(s)]
            maps = [bit_map(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(s) for s in sets], pa.int64()), pa.array([m[0] for m in maps], pa.int32()), pa.array([m[1] for m in maps], pa.int32()), pa.array([m[2] for m in maps], pa.binary())],
                names=["node", "level", "taken", "map"],
            )

    return run


def index_keys(sigs: np.ndarray) -> np.ndarray:
    """The keys of each signature: chunk, places left out, and the symbols that remain."""
    out = []
    for chunk in range(CHUNKS):
        part = sigs[:, chunk * WIDTH : (chunk + 1) * WIDTH].astype(np.uint64)
        for n, left_out in enumerate(combinations(range(WIDTH), ERRORS)):
            key = np.full(len(sigs), chunk * 64 + n, np.uint64)
            for place in range(WIDTH):
                if place not in left_out:
                    key = (key << np.uint64(16)) | part[:, place]
            out.append(key.astype(np.int64))
    return np.stack(out, axis=1) if len(sigs) else np.empty((0, 0), np.int64)


def first_shared(same: np.ndarray) -> np.ndarray:
    """Number (chunk * 64 + choice) of the first key that pairs share, from their equal
    positions: a pair meets in many buckets and is looked at in this one only."""
    choices = list(combinations(range(WIDTH), ERRORS))
    differ = ~same.reshape(len(same), CHUNKS, WIDTH)
    hit = np.stack([(differ.sum(axis=2) - differ[:, :, list(c)].sum(axis=2)) == 0 for c in choices], axis=2)
    at = hit.reshape(len(same), -1).argmax(axis=1)
    return at // len(choices) * 64 + at % len(choices)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), POSITIONS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = index_keys(_signatures(batch.column("sig")))
            node = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])


def _sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, their sizes and signatures) within the signature threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        apart = (_signatures(batch.column("sig_a")) != _signatures(batch.column("sig_b"))).sum(axis=1)
        fit = _sizes_fit(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
        keep = pa.array((apart <= THRESHOLD) & fit)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _cell_pairs(best: int | None):
    """Sorted rows of cells to the pairs of different components within the threshold: the
    best of every two components in a cell (by their bit maps), or all."""

    def pairs(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        node = np.array([r["node"] for r in rows], np.int64)
        size = np.array([r["n"] for r in rows], np.int64)
        part = np.array([r["part"] for r in rows], np.int64)
        if (part == part[0]).all():
            return node[:0], node[:0]
        block = np.array([r["block"] for r in rows])
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(len(rows), POSITIONS)
        level, taken = (np.array([r[c] for r in rows], np.int64) for c in ("level", "taken"))
        maps = np.frombuffer(b"".join(r["map"] for r in rows), np.uint64).reshape(len(rows), -1)
        spare = taken - np.bitwise_count(maps).sum(axis=1)
        cross = rows[0]["low"] != rows[0]["high"]
        rank = (rows[0]["key"] >> (16 * (WIDTH - ERRORS))) & 0xFFFF
        found, scores = [], []
        for i in range(len(rows)):
            rest = slice(i + 1, None)
            other = (block[rest] != block[i]) if cross else np.ones(len(rows) - i - 1, bool)
            ask = np.flatnonzero(other & (part[rest] != part[i]) & _sizes_fit(size[rest], size[i])) + i + 1
            if len(ask):
                ask = ask[(sig[ask] != sig[i]).sum(axis=1) <= THRESHOLD]
            if len(ask):
                ask = ask[first_shared(sig[ask] == sig[i]) == rank]
            if len(ask):
                fine, alike = _may_reach(size, level, taken, spare, maps, i, ask)
                found.append(np.column_stack([np.full(int(fine.sum()), i), ask[fine]]))
                scores.append(alike[fine])
        if not found:
            return node[:0], node[:0]
        at, score = np.concatenate(found), np.concatenate(scores)
        if best is not None:
            two = np.sort(part[at], axis=1)
            order = np.lexsort((-score, two[:, 1], two[:, 0]))
            start = np.r_[True, (np.diff(two[order], axis=0) != 0).any(axis=1)] if len(order) else np.empty(0, bool)
            turn = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
            at = at[order[turn < best]]
        return node[at[:, 0]], node[at[:, 1]]

    def flush(rows: list[dict]) -> pa.RecordBatch:
        a, b = pairs(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["key"], row["low"], row["high"])
                if now != name and rows:
                    yield flush(rows)
                    rows = []
                name = now
                rows.append(row)
        if rows:
            yield flush(rows)

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets reach the similarity."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("codes_a"), batch.column("codes_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows (of a few longs) are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class NearDuplicates:
    """Classes, links and components of one table of documents."""

    def __init__(self, docs: DataFrame, width: int = 5):
        self.spark, self.width = docs.sparkSession, width
        ship(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        coded = self.docs.withColumn("text_code", F.xxhash64("text"))
        self.described = written(coded.mapInArrow(tidy(_describe(width)), "doc_id long, text_code long, n_shingles long, node long, sig binary"), "described")
        members = self.described.filter("node IS NOT NULL")
        self.classes = written(members.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_code")).alias("row"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")

    def _texts(self, nodes: DataFrame, name: str) -> DataFrame | None:
        """One text of each of the nodes (and perhaps of others that share its id and code)."""
        need = written(nodes.distinct().join(self.classes, "node").select(F.col("row.doc_id").alias("rep"), F.col("row.text_code").alias("text_code")).distinct(), f"need-{name}")
        count = need.count()
        if not count:
            return None
        coded = self.docs.withColumn("text_code", F.xxhash64("text"))
        need = checked_broadcast(need, count)
        found = coded.join(need, (coded["text_code"] == need["text_code"]) & coded["doc_id"].eqNullSafe(need["rep"]), "left_semi")
        return found.dropDuplicates(["doc_id", "text_code"]).select("text")

    def _confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) of nodes that reach the similarity on their full sets."""
        texts = self._texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), name)
        if texts is None:
            return pairs.limit(0)
        sets = written(texts.mapInArrow(tidy(_full_sets(self.width)), "node long, codes binary"), f"sets-{name}")
        left = sets.select(F.col("node").alias("a"), F.col("codes").alias("codes_a"))
        right = sets.select(F.col("node").alias("b"), F.col("codes").alias("codes_b"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "codes_a", "codes_b")
        return written(both.mapInArrow(tidy(_confirm), "a long, b long"), f"links-{name}")

    def _with_signatures(self, pairs: DataFrame) -> DataFrame:
        one = self.classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        two = self.classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        return pairs.join(one, "a").join(two, "b").mapInArrow(tidy(_near_pairs), "a long, b long")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Confirmed links (a, b), and node, part of the components that they make; a node
        without a link is not listed. Every pair of similar classes is in one component."""
        keys = self.classes.select("node", "sig").mapInArrow(tidy(_keys), "key long, node long")
        stars = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
        placed = written(keys.join(stars, "key").select("key", "hub", "node", "members"), "buckets")
        spokes = placed.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        tried = written(self._with_signatures(spokes), "spokes")
        found = self._confirmed(tried, "stars")
        stars = contract(found)
        parts = stars.select("node", F.col("root").alias("part")).union(stars.select("root", "root").distinct())
        maps = None
        # first the best pairs of every two parts that meet in a cell, which joins most of
        # them; then every pair of what is left apart
        for name, each in (("best", BEST_PAIRS), ("all", None)):
            marked = placed.filter("members > 2").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
            open_keys = marked.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
            rest = written(marked.join(open_keys, "key", "left_semi").select("key", "node", "part", "members"), f"open-{name}")
            if maps is None:
                texts = self._texts(rest.select("node"), "open")
                if texts is None:
                    break
                maps = written(texts.mapInArrow(tidy(_bit_maps(self.width)), "node long, level int, taken int, map binary"), "maps")
            more = self._cells(rest, maps).mapInArrow(tidy(_cell_pairs(each)), "a long, b long").distinct()
            more = written(more.join(tried, ["a", "b"], "left_anti"), f"pairs-{name}")
            got = self._confirmed(more, name)
            parts, found, tried = joined(parts, got), found.union(got), tried.union(more)
        return found, parts

    def _cells(self, rest: DataFrame, maps: DataFrame) -> DataFrame:
        """Members of open buckets in square cells of bounded size, sorted by cell."""
        cells = F.ceil(F.col("members") / CELL).cast("int")
        return (
            rest.withColumn("cells", cells)
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
            .select("key", "node", "part", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
            .join(self.classes.select("node", "n", "sig").join(maps, "node"), "node")
            .repartition("key", "low", "high")
            .sortWithinPartitions("key", "low", "high")
        )

    def components(self) -> DataFrame:
        """doc_id, text_code, n_shingles, component_id of every row."""
        parts = self.links()[1].select("node", F.col("part").alias("root"))
        labels = self.classes.select("node", "rep").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = labels.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = labels.join(least, "root").select("node", "component_id")
        rows = self.described.select("doc_id", "text_code", "n_shingles", "node").join(named, "node", "left")
        return rows.select("doc_id", "text_code", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """node, part after more links: what the links join, contracted part by part.

    parts lists every linked node, the node that names its part too.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    known = parts.unionByName(ends.join(parts, "node", "left_anti").withColumn("part", F.col("node")))
    for end in ("a", "b"):  # links between parts, each once
        side = known.select(F.col("node").alias(end), F.col("part").alias(f"part_{end}"))
        links = links.join(side, end)
    roots = contract(links.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct())
    both = known.join(roots.select(F.col("node").alias("part"), "root"), "part", "left")
    return written(both.select("node", F.coalesce("root", "part").alias("part")), "parts")


def contract(links: DataFrame) -> DataFrame:
    """node, root of every linked node: alternating large and small stars.

    Each round is written to the shared folder; the driver sees a count and a checksum.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def detect(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    out = NearDuplicates(docs, width).components()
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with one document of each group of near duplicates (the smallest id)."""
    rows = NearDuplicates(docs, width).components()
    rows = written(rows.select("doc_id", "text_code", (F.col("n_shingles") > 0).alias("has"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "verdicts")
    gone = rows.filter("has AND NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_code").alias("gone_code")).distinct()
    twice = rows.filter("has AND kept").groupBy("doc_id", "text_code").count().filter("count > 1").select(F.col("doc_id").alias("gone_id"), F.col("text_code").alias("gone_code"))
    code = fresh(docs, "code")
    coded = docs.withColumn(code, F.xxhash64(F.col("text").cast("string")))

    def hit(side: DataFrame):
        return (coded[code] == side["gone_code"]) & coded["doc_id"].cast("long").eqNullSafe(side["gone_id"])

    out = gone.unionByName(twice)
    n_out, n_twice = out.count(), twice.count()
    out = checked_broadcast(out, n_out)
    kept = coded.join(out, hit(out), "left_anti").drop(code)
    if n_twice:
        side = checked_broadcast(twice, n_twice)
        kept = kept.unionByName(coded.join(side, hit(side), "left_semi").dropDuplicates(["doc_id", code]).drop(code))
    return kept


def query(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), width=4)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS s
  FROM w WHERE ws IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, e.b FROM reach r JOIN edge e ON r.v = e.a),
comp AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp c ON c.doc_id = d.doc_id
"""
