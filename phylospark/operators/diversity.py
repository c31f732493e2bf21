"""Node counts, phylogenetic diversity, and pairwise distances.

All plans carry `rep`, the subsample they belong to, so that several subsamples are one job.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.functions import metrics, tiles
from phylospark.session import materialized

#: Samples of a tile.
TILE = 128


def with_rep(rows: DataFrame) -> DataFrame:
    return rows if "rep" in rows.columns else rows.withColumn("rep", F.lit(0))


def totals(abundance: DataFrame) -> DataFrame:
    """rep, sample_id, total."""
    return with_rep(abundance).groupBy("rep", "sample_id").agg(F.sum("count").alias("total"))


def node_counts(abundance: DataFrame, closure: DataFrame, bypass_tips: bool = False) -> DataFrame:
    """rep, sample_id, node_id, length, is_tip, c: counts summed over the tips below each edge."""
    edges = closure.where("NOT is_tip") if bypass_tips else closure
    joined = with_rep(abundance).where("count <> 0").join(edges, "feature_id")
    return joined.groupBy("rep", "sample_id", "node_id").agg(F.first("length").alias("length"), F.first("is_tip").alias("is_tip"), F.sum("count").alias("c"))


def faith(abundance: DataFrame, closure: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """rep, sample_id, faith_pd: the length of all edges above what a sample has; 0 for samples without counts."""
    edges = with_rep(abundance).where("count > 0").join(closure, "feature_id").groupBy("rep", "sample_id", "node_id").agg(F.first("length").alias("length"))
    found = edges.groupBy("rep", "sample_id").agg(F.sum("length").alias("faith_pd"))
    if samples is None:
        return found
    reps = with_rep(abundance).select("rep").distinct() if "rep" in abundance.columns else None
    every = samples.select("sample_id") if reps is None else samples.select("sample_id").join(F.broadcast(reps))
    every = with_rep(every)
    return every.join(found, ["rep", "sample_id"], "left").select("rep", "sample_id", F.coalesce("faith_pd", F.lit(0.0)).alias("faith_pd"))


def _tiling(samples: DataFrame, n_substeps: int) -> DataFrame:
    """One row: n samples, the size of a tile, and the number of tiles. `n_substeps` tile pairs are made at least, as
    far as there are samples."""
    least = math.ceil((math.sqrt(8 * max(1, n_substeps) + 1) - 1) / 2)
    n = F.greatest(F.coalesce(F.max("ord"), F.lit(-1)) + 1, F.lit(1))
    return samples.agg(n.cast("int").alias("n")).select("n", F.least(F.lit(TILE), F.ceil(F.col("n") / least)).cast("int").alias("size")).withColumn("tiles", F.ceil(F.col("n") / F.col("size")).cast("int"))


def _dealt(rows: DataFrame, tiling: DataFrame, tiles_where: str | None) -> DataFrame:
    """rows (with ord) once for each tile pair (tile_i <= tile_j) that their sample is in."""
    tiled = rows.join(F.broadcast(tiling)).withColumn("tile", F.floor(F.col("ord") / F.col("size")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumns({"tile_i": F.least("tile", "other"), "tile_j": F.greatest("tile", "other")})
    return tiled.where(tiles_where) if tiles_where else tiled


def pair_table(samples: DataFrame, abundance: DataFrame, tiling: DataFrame | None = None, tiles_where: str | None = None) -> DataFrame:
    """Every pair of samples once; the result has these rows whatever the plan. Pairs meet tile by tile, so no task has
    more than those of some tiles."""
    if "rep" in abundance.columns and "rep" not in samples.columns:
        known = abundance.select("rep", "sample_id").distinct().join(samples, "sample_id")
    else:
        known = with_rep(samples)
    dealt = _dealt(known.select("rep", "sample_id", "ord"), _tiling(samples, 1) if tiling is None else tiling, tiles_where)
    keys = ["rep", "tile_i", "tile_j"]
    a = dealt.where("tile = tile_i").select(*keys, F.col("sample_id").alias("sample_id_i"), F.col("ord").alias("ord_i"))
    b = dealt.where("tile = tile_j").select(*keys, F.col("sample_id").alias("sample_id_j"), F.col("ord").alias("ord_j"))
    return a.join(b, keys).where("ord_i < ord_j").select("rep", "sample_id_i", "sample_id_j", "ord_i", "ord_j")


def beta(abundance: DataFrame, closure: DataFrame, samples: DataFrame, method: str = "unweighted", alpha: float = 1.0, variance_adjusted: bool = False, bypass_tips: bool = False, pairs_where: str | None = None, tiles_where: str | None = None, n_substeps: int = 1) -> DataFrame:
    """rep, sample_i, sample_j, ord_i, ord_j, distance of every pair (ord_i < ord_j), double or float by the method.

    Samples are cut into tiles. Each node count goes to the tile pairs that its sample is in, where a vectorised kernel
    sums the branches' terms for all pairs at once; branches of a tile pair are dealt to as many parts as keep all
    shuffle partitions busy, and the parts' sums are added. So no branch that all samples have is a hot key, and the
    rows that are shuffled grow with samples / tile, not with the partners of a sample.

    `pairs_where` keeps some of the pairs (by ord_i, ord_j); `tiles_where` is a condition on tile_i, tile_j, size and n
    that all tile pairs with such pairs meet, applied before anything is shuffled.
    """
    family, precision = metrics.split_method(method)
    tiling = _tiling(samples, n_substeps)
    nodes = node_counts(abundance, closure, bypass_tips).select("rep", "sample_id", "node_id", "length", "c")
    sized = nodes.join(totals(abundance), ["rep", "sample_id"]).join(samples.select("sample_id", "ord"), "sample_id")
    tiled = _dealt(sized, tiling, tiles_where)
    busy = F.lit(int(abundance.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = F.ceil(2 * busy / (F.col("tiles") * (F.col("tiles") + 1)))
    keys = ["rep", "tile_i", "tile_j", "part"]
    tiled = tiled.select(*keys[:3], F.pmod(F.xxhash64("node_id"), parts).cast("int").alias("part"), "size", "ord", F.concat(F.lit("b"), "node_id").alias("node_id"), F.col("length").cast("double").alias("length"), F.col("c").cast("double").alias("c"), F.col("total").cast("double").alias("t"))
    if variance_adjusted:  # a branch's term depends on the totals of samples that don't have it, too
        every = _dealt(totals(abundance).join(samples.select("sample_id", "ord"), "sample_id"), tiling, tiles_where)
        tiled = tiled.unionByName(every.select(*keys[:3], F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("part"), "size", "ord", F.lit("").alias("node_id"), F.lit(0.0).alias("length"), F.lit(0.0).alias("c"), F.col("total").cast("double").alias("t")))
    sums = tiled.repartition(*keys).sortWithinPartitions(*keys, "node_id").mapInArrow(tiles.summed(family, float(alpha), variance_adjusted), tiles.SCHEMA)
    sums = sums.groupBy("rep", "ord_i", "ord_j").agg(F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
    pairs = pair_table(samples, abundance, tiling, tiles_where)
    if pairs_where:
        pairs = pairs.where(pairs_where)
    zero = F.lit(0.0)
    distance = metrics.ratio(family, F.coalesce("top", zero), F.coalesce("bottom", zero))
    if precision == "fp32":
        distance = distance.cast("float")
    return pairs.join(sums, ["rep", "ord_i", "ord_j"], "left").select("rep", F.col("sample_id_i").alias("sample_i"), F.col("sample_id_j").alias("sample_j"), "ord_i", "ord_j", distance.alias("distance"))


def subsample(abundance: DataFrame, depth: int, n: int = 1, seed: int = 42, replacement: bool = True) -> DataFrame:
    """rep, sample_id, feature_id, count of `n` subsamples of `depth` individuals. Samples with fewer are left out.
    Draws are MD5 hashes, so reruns and retries agree."""
    abundance = materialized(abundance, "abundance")
    whole = abundance.groupBy("sample_id").agg(F.sum("count").cast("bigint").alias("total")).where(F.col("total") >= depth)
    reps = abundance.sparkSession.range(n).select(F.col("id").cast("int").alias("rep"))
    draws = whole.join(F.broadcast(reps))
    if replacement:
        # each feature owns a stretch of the sample's individuals; a draw takes the last stretch that begins at or below it
        draws = draws.select("rep", "sample_id", "total", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("k"))
        draws = draws.select("rep", "sample_id", F.pmod(metrics.uniform(str(seed), F.col("rep"), F.col("sample_id"), F.col("k")), F.col("total")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("feature_id"))
        upto = Window.partitionBy("sample_id").orderBy("feature_id").rowsBetween(Window.unboundedPreceding, -1)
        starts = abundance.withColumn("at", F.coalesce(F.sum("count").over(upto), F.lit(0.0)).cast("bigint")).join(whole, "sample_id").join(F.broadcast(reps))
        starts = starts.select("rep", "sample_id", "at", F.lit(0).alias("kind"), "feature_id")
        along = Window.partitionBy("rep", "sample_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
        taken = starts.unionAll(draws).withColumn("feature_id", F.last("feature_id", ignorenulls=True).over(along)).where("kind = 1")
    else:

        def each(rows: DataFrame) -> DataFrame:
            one = rows.select("rep", "sample_id", "feature_id", bound.alias("bound"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count").cast("bigint"))).alias("k"))
            return one.withColumn("u", metrics.uniform(str(seed), F.col("rep"), F.col("sample_id"), F.col("feature_id"), F.col("k")))

        # the `depth` least hashes lie below this bound, but for 1 sample in 10^10; only those are ordered
        bound = F.ceil((depth + 8 * math.sqrt(depth) + 16) / F.col("total") * float(1 << 48))
        rows = abundance.join(whole, "sample_id").join(F.broadcast(reps))
        near = materialized(each(rows).where("u < bound").select("rep", "sample_id", "feature_id", "k", "u"), "near")
        # where they don't, all others of the sample are ordered, too
        short = draws.join(near.groupBy("rep", "sample_id").agg(F.count(F.lit(1)).alias("n")), ["rep", "sample_id"], "left").where(F.coalesce("n", F.lit(0)) < depth).select("rep", "sample_id")
        far = each(rows.join(materialized(short, "short"), ["rep", "sample_id"])).where("u >= bound").select("rep", "sample_id", "feature_id", "k", "u")
        order = Window.partitionBy("rep", "sample_id").orderBy("u", "feature_id", "k")
        taken = near.unionAll(far).withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth)
    return taken.groupBy("rep", "sample_id", "feature_id").agg(F.count(F.lit(1)).cast("double").alias("count"))
