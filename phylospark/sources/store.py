"""A result directory of Parquet datasets: order, distance, pcoa_axes, pcoa_coords, permanova, info. Several subsamples
are partitions by rep."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark import errors
from phylospark.operators import ordination
from phylospark.session import scratch

FORMATS = ("hdf5", "hdf5_fp32", "hdf5_fp64", "hdf5_nodist")


def write(path: str, distance: DataFrame, format: str = "hdf5", pcoa_dims: int = 10, groups: DataFrame | None = None, columns: list[str] | None = None, permutations: int = 0, seed: int = 42, mode: str = "errorifexists") -> str:
    """Writes the distances (unless hdf5_nodist) and what follows from them; returns the path. The distances are
    computed once, written, and reread by the steps after."""
    if format not in FORMATS:
        raise ValueError(errors.INVALID_METHOD)
    if permutations and groups is None:
        raise errors.MissingInput(errors.GROUPING_MISSING)
    spark = distance.sparkSession
    kind = {"hdf5_fp32": "float", "hdf5_fp64": "double"}.get(format)
    if kind:
        distance = distance.withColumn("distance", F.col("distance").cast(kind))
    _claim(spark, path, mode)
    at = scratch(spark, "distance") if format == "hdf5_nodist" else f"{path}/distance"
    distance.write.partitionBy("rep").mode(mode).parquet(at)
    kept = spark.read.parquet(at)
    ids = kept.select(F.col("ord_i").alias("ord"), F.col("sample_i").alias("sample_id")).unionAll(kept.select("ord_j", "sample_j")).distinct()
    ids.write.mode(mode).parquet(f"{path}/order")
    if pcoa_dims:
        axes, coords = ordination.pcoa(kept, pcoa_dims, seed)
        axes.withColumn("method", F.lit("FSVD")).write.mode(mode).parquet(f"{path}/pcoa_axes")
        coords.write.mode(mode).parquet(f"{path}/pcoa_coords")
    if permutations:
        ordination.permanova(kept, groups, columns, permutations, seed).withColumn("place", F.monotonically_increasing_id()).write.mode(mode).parquet(f"{path}/permanova")
    return path


def _claim(spark: SparkSession, path: str, mode: str) -> None:
    """Raises OSError unless the directory can be made, and is new if it has to be."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if mode == "errorifexists" and system.exists(at) or not system.mkdirs(at):
            raise OSError(errors.OUTPUT_ERROR)
    except Py4JJavaError as e:
        raise OSError(errors.OUTPUT_ERROR) from e


class Results(Sequence):
    """Reads a result directory. As a sequence: the dense matrix of each subsample, with the last one remembered."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.closed, self.cached = spark, path, False, (None, None)
        order = self._read("order").orderBy("ord").collect()  # one row a sample; the matrix below is dense anyway
        self.ids = [r["sample_id"] for r in order]

    def _read(self, name: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            raise (OSError(f"{self.path} is not a result directory") if name == "order" else KeyError(name)) from e

    def distance_table(self) -> DataFrame:
        return self._read("distance")

    def axes_table(self) -> DataFrame:
        return self._read("pcoa_axes")

    def coords_table(self) -> DataFrame:
        return self._read("pcoa_coords")

    def permanova_table(self) -> DataFrame:
        return self._read("permanova")

    def __len__(self) -> int:
        return 0 if self.closed else self.distance_table().select("rep").distinct().count()

    def __getitem__(self, i: int) -> np.ndarray:
        if self.closed:
            raise IndexError(i)
        if self.cached[0] != i:
            rows = self.distance_table().where(F.col("rep") == i)
            if rows.isEmpty():
                raise IndexError(i)
            self.cached = (i, dense(rows, len(self.ids)))
        return self.cached[1]

    def close(self) -> None:
        self.closed, self.cached = True, (None, None)


def dense(rows: DataFrame, n: int) -> np.ndarray:
    """A symmetric, hollow n by n matrix on the driver."""
    out = np.zeros((n, n), dtype=np.float32 if dict(rows.dtypes)["distance"] == "float" else np.float64)
    for r in rows.select("ord_i", "ord_j", "distance").toLocalIterator():
        out[r[0], r[1]] = out[r[1], r[0]] = r[2]
    return out


def ordinations(results: Results) -> list[dict]:
    """Per subsample: eigvals and proportion_explained by PC1, PC2, ..., samples (ids by axes), long_method_name."""
    import pandas as pd

    axes, coords = results.axes_table().toPandas(), results.coords_table().toPandas()
    out = []
    for rep, own in axes.sort_values("axis").groupby("rep"):
        names = [f"PC{a}" for a in own["axis"]]
        values = coords[coords["rep"] == rep].pivot(index="sample_id", columns="axis", values="value").loc[results.ids]
        values.columns = names
        tag = own["method"].iloc[0]
        long = "Approximate Principal Coordinate Analysis using FSVD" if tag == "FSVD" else f"Possibly Approximate Principal Coordinate Analysis using {tag}"
        out.append({"method": "PCoA", "long_method_name": long, "eigvals": pd.Series(own["eigval"].to_numpy(), names), "proportion_explained": pd.Series(own["proportion_explained"].to_numpy(), names), "samples": values})
    return out


def tests(results: Results) -> dict[str, dict]:
    """The first subsample's PERMANOVA of each grouping, the last row of a name winning."""
    rows = results.permanova_table().where("method = 'PERMANOVA' AND test_name = 'pseudo-F'").orderBy("rep", "place").collect()
    first = min((r["rep"] for r in rows), default=0)
    return {r["grouping"]: {"method name": r["method"], "test statistic name": r["test_name"], "sample size": r["sample_size"], "number of groups": r["n_groups"], "test statistic": r["statistic"], "p-value": r["p_value"], "number of permutations": r["n_permutations"]} for r in rows if r["rep"] == first}
