"""One distance matrix from several over different sets of samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.operators.diversity import pair_table

CONSOLIDATIONS = ("skipping_missing_matrices", "missing_zero", "missing_one", "skipping_missing_values")


def consolidate(distances: list[DataFrame], samples: list[DataFrame], weights: list[float], how: str = "skipping_missing_values") -> DataFrame:
    """sample_i < sample_j, distance over the union of all samples. Where no matrix has a pair: null, or 0, or 1."""
    whole = float(sum(weights))
    share = [w / whole for w in weights]
    named = [s.select("sample_id", F.lit(k).alias("k")) for k, s in enumerate(samples)]
    have = reduce(DataFrame.unionAll, named).distinct()
    every = have.select("sample_id").distinct()
    if how == "skipping_missing_matrices":
        n = every.count()
        full = {r["k"] for r in have.groupBy("k").count().where(F.col("count") == n).collect()}  # one row a matrix
        if not full:
            raise ValueError("No matrix has all samples.")
        distances = [d for k, d in enumerate(distances) if k in full]
        share = [w for k, w in enumerate(share) if k in full]
    tagged = [d.select(F.least("sample_i", "sample_j").alias("sample_i"), F.greatest("sample_i", "sample_j").alias("sample_j"), (F.lit(w) * F.col("distance").cast("double")).alias("wd"), F.lit(w).alias("w")) for d, w in zip(distances, share, strict=True)]
    sums = reduce(DataFrame.unionAll, tagged).groupBy("sample_i", "sample_j").agg(F.sum("wd").alias("wd"), F.sum("w").alias("w"))
    ordered = every.withColumn("ord", (F.row_number().over(Window.orderBy("sample_id")) - 1).cast("int"))  # one row a sample
    pairs = pair_table(ordered, ordered).select(F.col("sample_id_i").alias("sample_i"), F.col("sample_id_j").alias("sample_j")).join(sums, ["sample_i", "sample_j"], "left")
    wd, w = F.coalesce("wd", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
    value = {"missing_zero": wd, "missing_one": wd + (1.0 - w)}.get(how, F.when(w > 0, wd / w))
    return pairs.select("sample_i", "sample_j", value.alias("distance"))
