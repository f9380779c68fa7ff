"""Mixing sources to target weights by capped water-filling.

The weighted share of each source is clamped at a maximum number of epochs; what a
clamp cuts off goes to the other sources by weight until none is above its clamp.
The level is found in one ordered pass over the sources. Every document is then
taken a whole number of times, and the fraction that is left is sampled without
replacement: it is a prefix of a seeded order of the documents of the source, whose
last one is taken in part. Where each prefix ends is searched level by level: sums by
ever longer beginnings of the order's key, each level only within the group in which the
level before ends. So no source, however large, is ordered in one task, and a document
knows its share by comparing its own key with its source's cut. Rows that share the cut's
key are summed to one row with a count before they are shared out.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own, ordered last; rows of equal id, source and size are interchangeable
(in the mix as rows: of equal id, source and text, any one of which may stand for the
others at the cut); a source of size 0 has target 0; an empty table gives an empty
result; documents without a word are not in the mix; further columns are kept, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh, table, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2.0
SEED = "mix-1"
#: Beginnings of the order's key by which the cut is searched; the last is the whole key. Of
#: plan(): 32 digits of the mark, 16 of the size; of mixed(): 16 of the text's hash instead.
LEVELS, TEXT_LEVELS = (3, 6, 48), (3, 6, 32, 35, 48)
#: Sources whose cuts are broadcast; those of more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _tag(source: Column) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _key(doc_id: Column, then: Column) -> Column:
    """The seeded order: md5 of the id, then a long."""
    mark = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("long").cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(mark, F.lpad(F.hex(then), 16, "0"))


def sized(df: DataFrame, by_text: bool = False) -> DataFrame:
    """The narrow columns that mixing needs: doc_id, source, tag, size and the order's key."""
    size = _size(df["text"])
    then = F.xxhash64(df["text"].cast("string")) if by_text else size
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["source"].cast("string").alias("source"), _tag(df["source"]).alias("tag"), size.alias("size"), _key(df["doc_id"], then).alias("key"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of each source (the water-filling)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = per.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("n") % len(WEIGHTS) + 1).cast("int"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "n").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        named.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(EPOCHS))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(SHARE))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("budget") - F.col("caps_before")))
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0)))
        .withColumn("open", F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every), F.lit(1.0)))
    )
    share = F.col("weight") * (F.col("budget") - F.col("spent")) / F.col("open")
    return level.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"))


def _hint(small: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(small) if sources <= BROADCAST_SOURCES else small


def cuts(sizes: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """Of each source: tag, source_size, target, whole (full repetitions of every document),
    cut_key where the prefix taken once more ends, left (words it takes of the rows of that
    key), and sources (their number)."""
    goal = targets(sizes).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.select(_tag(F.col("source")).alias("tag"), "source_size", "target", "whole", (F.col("words") - F.col("whole") * F.col("source_size")).alias("left"), F.lit("").alias("cut_key"))
    goal = written(goal, "goal")
    sources = goal.count()
    at = goal.select("tag", "left", "cut_key")
    for n, length in enumerate(levels):
        side = at.select("tag", F.col("cut_key").alias("begin"))
        part = sizes.withColumn("begin", F.substring("key", 1, levels[n - 1])).join(_hint(side, sources), ["tag", "begin"]) if n else sizes
        group = part.groupBy("tag", F.substring("key", 1, length).alias("cut_key")).agg(F.sum("size").alias("words")).filter("words > 0")
        before = Window.partitionBy("tag").orderBy("cut_key").rowsBetween(Window.unboundedPreceding, -1)
        group = group.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        group = group.join(_hint(at.select("tag", "left"), sources), "tag").filter("before <= left AND left < before + words")
        at = written(group.select("tag", (F.col("left") - F.col("before")).alias("left"), "cut_key"), "cut")
    return goal.drop("left", "cut_key").join(at, "tag", "left").withColumn("sources", F.lit(sources))


def plan(df: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, whole, rest, cut.

    whole: full repetitions of every document of the source; rest: words taken once
    more; cut: rest is less than the document.
    """
    sizes = written(sized(df), "sizes")
    ends = written(cuts(sizes, LEVELS), "cuts")
    rows = sizes.join(_hint(ends, ends.count()), "tag")
    at_cut = F.col("key").eqNullSafe(F.col("cut_key"))
    plain = rows.filter(~at_cut).withColumn("rest", F.when(F.col("key") < F.col("cut_key"), F.col("size")).otherwise(0))
    keys = ["doc_id", "source", "size", "source_size", "target", "whole", "left"]
    tied = rows.filter(at_cut).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    tied = tied.withColumn("rest", F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - F.col("i") * F.col("size"))))
    out = plain.select(*keys, "rest").unionByName(tied.select(*keys, "rest"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("rest")).cast("long").alias("taken"), "whole", "rest", ((F.col("rest") > 0) & (F.col("rest") < F.col("size"))).alias("cut"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as rows: every document as often as it is taken.

    Rows stay whole texts here: the one document of each source that the sample cuts
    is taken once more if at least half of it is, so a source is at most half a
    document off its target. Only a source's cut travels to the rows, not the rows.
    """
    sizes = written(sized(docs, by_text=True), "sizes")
    found = cuts(sizes, TEXT_LEVELS)
    width = sizes.groupBy("tag", F.col("key").alias("cut_key")).agg(F.max("size").alias("size"))
    found = written(found.join(width, ["tag", "cut_key"], "left"), "cuts")
    tag, key, end, times = (fresh(docs, n) for n in ("tag", "key", "end", "times"))
    rows = docs.filter(docs["text"].cast("string").rlike(WORD_PATTERN)).withColumn(tag, _tag(docs["source"])).withColumn(key, _key(docs["doc_id"], F.xxhash64(docs["text"].cast("string"))))
    ends = found.select(F.col("tag").alias(tag), F.struct("whole", "cut_key", "left", "size").alias(end))
    rows = rows.join(_hint(ends, found.count()), tag)
    e = F.col(end)
    at_cut = F.col(key).eqNullSafe(e["cut_key"])
    copies = e["whole"] + F.coalesce((F.col(key) < e["cut_key"]).cast("long"), F.lit(0))
    names = docs.columns
    plain = rows.filter(~at_cut).withColumn(times, copies).filter(F.col(times) > 0).select(*names, times)
    # words of the cut left over: whole documents, and one more from a half on
    more = F.floor(e["left"] / e["size"]) + (2 * (e["left"] % e["size"]) >= e["size"]).cast("long")
    tied = rows.filter(at_cut).groupBy(tag, key).agg(F.first(F.struct(*names)).alias("row"), F.first(e).alias(end), F.count(F.lit(1)).alias("n"))
    tied = tied.withColumn(times, F.col("n") * e["whole"] + more).filter(F.col(times) > 0).select("row.*", times)
    return plain.unionByName(tied).withColumn(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS mark
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM per),
weighed AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM named),
level AS (
  SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight FROM weighed),
run AS (
  SELECT *,
    coalesce(sum(cap) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
    coalesce(sum(weight) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM level),
clamp AS (SELECT *, cap * (all_weight - weight_before) <= weight * (budget - caps_before) AS capped FROM run),
goal AS (
  SELECT source, source_size,
    CASE WHEN capped THEN cap ELSE weight * (budget - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))
      / coalesce(sum(CASE WHEN NOT capped THEN weight END) OVER (), 1) END AS target
  FROM clamp),
aim AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS whole,
    CAST(floor(target + 0.5) AS BIGINT) AS words FROM goal),
ordered AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s)
SELECT o.doc_id, o.size, a.source_size, a.target,
  CAST(a.whole * o.size + least(o.size, greatest(0, a.words - a.whole * a.source_size - o.before)) AS BIGINT) AS taken
FROM ordered o JOIN aim a ON o.source IS NOT DISTINCT FROM a.source
"""
