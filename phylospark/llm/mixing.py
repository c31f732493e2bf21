"""Mixing sources to target weights.

Words are summed per source; sources in code point order (null last) get the weights in rotation and share the whole
corpus by weight. No target exceeds `most` times its source: what is over is shared again by weight among the others,
which ends at the level L where target = least(most * size, L * weight) adds up to the whole. A document is emitted
floor(rate) times, and once more if a hash of the seed, its id and its text falls below the rate's fraction; so no
document is emitted more than `most` times, and reruns agree. Sources are numbered and levelled by distributed
aggregates, so there may be as many as there are hosts.

Nulls: a null text has no words; a null source is a source; rows with a null doc_id draw by their texts. Rows that are
equal in id and text share their draw. Sources without words have a target of 0 and emit nothing. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospark.llm import common as c

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3.0, 17
#: Sources up to which their table is broadcast (a name and five numbers each); beyond, it is joined by shuffle.
BROADCAST = 10_000


def rates(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target, rate from rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # places in the order: ranges of it are numbered apart, then shifted by the rows of those before (a row for each range)
    ranged = c.stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    shift = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", shift.alias("shift"))
    place = F.col("shift") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = ranged.join(shifts, "part").select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    weighed = c.stored(weighed, "weighed")
    level = _level(weighed)
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return weighed.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _level(weighed: DataFrame) -> float:
    """The level at which targets add up to the whole. What they add up to is concave in the level, so Newton's steps
    from below reach it after finitely many: each shares what full sources leave among those that aren't full."""
    level = 0.0
    while True:
        full = F.col("cap") <= level * F.col("weight")
        left = F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0))
        found = weighed.agg(left.cast("double").alias("left"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not found["weight"]:
            return level
        now = found["left"] / found["weight"]
        if now <= level:
            return level
        level = now


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) by the seed, the id and the text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(16**12)


def copies(drawn: Column, rate: Column) -> Column:
    """How often a document is emitted."""
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def with_rates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs (which has a column source) with their source's source_size, target and rate."""
    named = found.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    if found.count() <= BROADCAST:
        named = F.broadcast(named)
    return docs.join(named, docs["source"].eqNullSafe(named["_source"])).drop("_source")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies of every row."""
    sizes = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), c.n_words(c.text_of(docs)).alias("size"), c.text_of(docs).alias("text"))
    sizes = c.stored(sizes.select("doc_id", "source", "size", draw(F.col("doc_id"), F.col("text"), seed).alias("drawn")), "sizes")
    return with_rates(sizes, rates(sizes, weights, most)).select("doc_id", "size", "source_size", "target", copies(F.col("drawn"), F.col("rate")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs. Only sizes are written and only
    the sources' rates are joined; texts stay where they are."""
    sizes = c.stored(docs.select(docs["source"].cast("string").alias("source"), c.n_words(c.text_of(docs)).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    found = rates(sizes, weights, most).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"))
    if found.count() <= BROADCAST:
        found = F.broadcast(found)
    joined = docs.join(found, docs["source"].cast("string").eqNullSafe(found["_mix_source"]))
    n = copies(draw(docs["doc_id"], c.text_of(docs), seed), F.col("_mix_rate")).cast("int")
    return joined.where(n > 0).withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)


#: The same in DuckDB's SQL.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS h FROM documents
), sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM sources
), levels AS (
  SELECT cap / weight AS full_at, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), found AS (
  SELECT arg_min(level, full_at) AS level FROM levels WHERE level <= full_at
), rated AS (
  SELECT source, source_size, least(cap, level * weight) AS target, CASE WHEN source_size > 0 THEN least(cap, level * weight) / source_size ELSE 0 END AS rate FROM weighed, found
), drawn AS (
  SELECT doc_id, source, size, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || h), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u FROM sizes
)
SELECT d.doc_id, d.size::BIGINT AS size, r.source_size::BIGINT AS source_size, r.target AS target,
       (d.size * (floor(r.rate) + CASE WHEN d.u < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""
