"""Feature tables: long Parquet, dense TSV, and BIOM 2.1 where h5py is installed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylospark import errors, schemas


@dataclass
class Table:
    """abundance (sample_id, feature_id, count; zeros dropped), samples (sample_id, ord), features (feature_id)."""

    abundance: DataFrame
    samples: DataFrame
    features: DataFrame


def table_of(abundance: DataFrame, samples: DataFrame | None = None) -> Table:
    """From long rows; samples are ordered by id unless given, so those without counts can be kept."""
    rows = abundance.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("feature_id").cast("string").alias("feature_id"), F.col("count").cast("double").alias("count"))
    if samples is None:
        samples = rows.select("sample_id").distinct().withColumn("ord", (F.row_number().over(Window.orderBy("sample_id")) - 1).cast("int"))
    return Table(rows.where("count <> 0"), samples, rows.select("feature_id").distinct())


def table_from_matrix(spark: SparkSession, counts, sample_ids, feature_ids) -> Table:
    """From a dense samples-by-features matrix in memory."""
    rows = [(s, f, float(x)) for s, line in zip(sample_ids, counts, strict=True) for f, x in zip(feature_ids, line, strict=True)]
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(sample_ids)], schemas.SAMPLES)
    return table_of(spark.createDataFrame(rows, schemas.ABUNDANCE), samples)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_text(spark: SparkSession, path: str, missing: str) -> str:
    """A small text file through Spark's own file systems."""
    if not _exists(spark, path):
        raise errors.MissingInput(missing)
    return spark.read.text(path, wholetext=True).first()[0]


def read_table(spark: SparkSession, path: str) -> Table:
    """.tsv/.txt: first column feature id, one column a sample; .biom: BIOM 2.1; anything else: long Parquet."""
    if not _exists(spark, path):
        raise errors.MissingInput(errors.TABLE_MISSING)
    if path.endswith((".tsv", ".txt")):
        wide = spark.read.csv(path, sep="\t", header=True)
        names = wide.columns[1:]
        pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("sample_id"), F.array(*(F.col(f"`{n}`").cast("double") for n in names)).alias("count")))
        long = wide.select(F.col(f"`{wide.columns[0]}`").alias("feature_id"), pairs.alias("x")).select("x.sample_id", "feature_id", "x.count")
        return table_of(long, spark.createDataFrame([(n, i) for i, n in enumerate(names)], schemas.SAMPLES))
    if path.endswith(".biom"):
        return _read_biom(spark, path)
    try:
        rows = spark.read.parquet(path)
    except Exception as e:
        raise ValueError(errors.NOT_A_TABLE) from e
    if not {"sample_id", "feature_id", "count"} <= set(rows.columns):
        raise ValueError(errors.NOT_A_TABLE)
    return table_of(rows)


def _read_biom(spark: SparkSession, path: str) -> Table:
    """BIOM 2.1 from a path of the driver's file system: arrays of non-zeros become a table without a loop over them."""
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("BIOM files need h5py") from e
    if not h5py.is_hdf5(path):
        raise ValueError(errors.NOT_A_TABLE)
    with h5py.File(path, "r") as f:
        if tuple(f.attrs.get("format-version", ())) != (2, 1):
            raise ValueError(errors.NOT_A_TABLE)
        names = [[x.decode() if isinstance(x, bytes) else x for x in f[f"{axis}/ids"][:]] for axis in ("sample", "observation")]
        starts, at, data = (f[f"sample/matrix/{k}"][:] for k in ("indptr", "indices", "data"))
    return table_from_sparse(spark, *names, starts, at, data)


def table_from_sparse(spark: SparkSession, sample_ids: list[str], feature_ids: list[str], starts, at, data) -> Table:
    """From compressed rows in memory: sample i has the counts data[starts[i]:starts[i + 1]] of the features at."""
    import numpy as np
    import pyarrow as pa

    rows = pa.table(
        {
            "sample_id": pa.array(sample_ids, pa.string()).take(pa.array(np.repeat(np.arange(len(sample_ids)), np.diff(starts)))),
            "feature_id": pa.array(feature_ids, pa.string()).take(pa.array(np.asarray(at, dtype=np.int64))),
            "count": pa.array(np.asarray(data, dtype=np.float64)),
        }
    )
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(sample_ids)], schemas.SAMPLES)
    found = table_of(spark.createDataFrame(rows), samples)
    # features without counts are features of the table, too
    return Table(found.abundance, samples, spark.createDataFrame([(x,) for x in feature_ids], "feature_id string"))


def validate(table: Table, files: bool = True) -> None:
    """Raises for the first of: no samples, fewer than two (files only), negative counts (files only)."""
    found = table.samples.limit(2).count()
    if found == 0:
        raise ValueError(errors.NO_SAMPLES)
    if files:
        if found < 2:
            raise ValueError(errors.ONE_SAMPLE)
        if not table.abundance.where("count < 0").limit(1).isEmpty():
            raise ValueError(errors.NEGATIVES)


def check_overlap(table: Table, closure: DataFrame) -> None:
    """Every feature of the table must be a tip, whatever its counts."""
    if not table.features.join(closure.select("feature_id").distinct(), "feature_id", "left_anti").limit(1).isEmpty():
        raise ValueError(errors.NO_OVERLAP)
