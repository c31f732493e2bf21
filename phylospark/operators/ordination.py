"""Gower centring, principal coordinates and PERMANOVA over long distance tables."""

from __future__ import annotations

import hashlib
import math
import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.session import materialized

#: Samples up to which the centred matrix is decomposed exactly on the driver unless asked otherwise (8 bytes * n^2: 200
#: MB at most); cells that come to it at a time; bytes of labels or of a thin matrix that are broadcast at most.
EXACT, CELLS, BROADCAST = 5_000, 2_000_000, 64_000_000
#: Tasks that permute labels.
PERMUTERS = 64
#: Approximate eigenvalues are iterated until they change by no more than this share of the largest, or so often.
TOLERANCE, ROUNDS = 1e-9, 60


def gower(distance: DataFrame) -> DataFrame:
    """rep, sample_i, sample_j, g over all ordered pairs and the diagonal: -1/2 (d^2 - row mean - column mean + mean)."""
    square = distance.select("rep", "sample_i", "sample_j", (F.col("distance").cast("double") ** 2).alias("q"))
    ids = square.select("rep", F.col("sample_i").alias("s")).unionAll(square.select("rep", F.col("sample_j").alias("s"))).distinct()
    both = square.unionAll(square.select("rep", F.col("sample_j").alias("sample_i"), F.col("sample_i").alias("sample_j"), "q"))
    both = both.unionAll(ids.select("rep", F.col("s").alias("sample_i"), F.col("s").alias("sample_j"), F.lit(0.0).alias("q")))
    rows = both.groupBy("rep", "sample_i").agg(F.avg("q").alias("mean"))
    whole = rows.groupBy("rep").agg(F.avg("mean").alias("grand"))
    out = both.join(rows.withColumnRenamed("mean", "mi"), ["rep", "sample_i"]).join(rows.select("rep", F.col("sample_i").alias("sample_j"), F.col("mean").alias("mj")), ["rep", "sample_j"]).join(F.broadcast(whole), "rep")
    return out.select("rep", "sample_i", "sample_j", (-0.5 * (F.col("q") - F.col("mi") - F.col("mj") + F.col("grand"))).alias("g"))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each axis with its largest entry positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _times(centred: DataFrame, place: dict[str, int], right: np.ndarray) -> np.ndarray:
    """The centred matrix times a thin matrix: partial products on the executors, summed by row."""
    shared = centred.sparkSession.sparkContext.broadcast((place, right))  # samples * axes numbers

    def partial(batches):
        at, thin = shared.value
        for pdf in batches:
            products = pdf["g"].to_numpy()[:, None] * thin[[at[s] for s in pdf["sample_j"]]]
            names, inverse = np.unique(pdf["sample_i"].to_numpy(dtype=str), return_inverse=True)
            sums = np.zeros((len(names), thin.shape[1]))
            np.add.at(sums, inverse, products)
            pdf = type(pdf)({"sample_i": np.repeat(names, thin.shape[1]), "axis": np.tile(np.arange(thin.shape[1]), len(names)), "v": sums.ravel()})
            yield pdf

    out = np.zeros_like(right)
    for r in centred.select("sample_i", "sample_j", "g").mapInPandas(partial, "sample_i string, axis int, v double").groupBy("sample_i", "axis").agg(F.sum("v").alias("v")).toLocalIterator():
        out[place[r["sample_i"]], r["axis"]] = r["v"]
    return out


def decompose(centred: DataFrame, dims: int, seed: int = 42, exact: bool | None = None) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Sample ids, the largest `dims` eigenvalues, their unit vectors, and the trace, of one centred matrix. exact: the
    matrix is decomposed on the driver (8 bytes a cell); not exact: a randomized subspace iteration keeps it on the
    executors, and only samples * axes numbers come to the driver; its
    eigenvalues settle to TOLERANCE. None: exact up to EXACT samples, with a warning
    beyond."""
    ids = sorted(r[0] for r in centred.select("sample_i").distinct().toLocalIterator())
    place = {s: i for i, s in enumerate(ids)}
    trace = float(centred.where("sample_i = sample_j").agg(F.sum("g")).first()[0] or 0.0)
    n, k = len(ids), min(dims, len(ids))
    if exact is None:
        exact = n <= EXACT
        if not exact:
            warnings.warn(f"{n} samples are decomposed approximately; pass exact=True for an exact decomposition on the driver.", stacklevel=3)
    if exact:
        g = np.zeros((n, n))
        # a stripe of rows at a time comes as Arrow blocks
        for stripe in range(math.ceil(n * n / CELLS)):
            own = centred.where(F.pmod(F.xxhash64("sample_i"), F.lit(math.ceil(n * n / CELLS))) == stripe).select("sample_i", "sample_j", "g").toArrow()
            names = own.column("sample_i").combine_chunks().dictionary_encode(), own.column("sample_j").combine_chunks().dictionary_encode()
            at = [np.array([place[s] for s in x.dictionary.to_pylist()], dtype=np.int64)[x.indices.to_numpy()] if len(x) else np.empty(0, dtype=np.int64) for x in names]
            g[at[0], at[1]] = own.column("g").to_numpy()
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        order = np.argsort(values)[::-1][:k]
        return ids, values[order], _signed(vectors[:, order]), trace
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, k + 10))))[0]
    if basis.nbytes > BROADCAST:
        raise ValueError(f"{n} samples and {k} axes need a broadcast of {basis.nbytes} bytes; {BROADCAST} are allowed")
    last = None
    for _ in range(ROUNDS):
        image = _times(centred, place, basis)
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:k]
        if last is not None and np.abs(values[order] - last).max() <= TOLERANCE * np.abs(values).max():
            break
        last, used, basis = values[order], basis, np.linalg.qr(image)[0]
    else:
        basis = used
        warnings.warn(f"the eigenvalues still changed by more than {TOLERANCE} of the largest after {ROUNDS} rounds", stacklevel=3)
    return ids, values[order], _signed(basis @ vectors[:, order]), trace


def pcoa(distance: DataFrame, dims: int = 10, seed: int = 42, exact: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """axes (rep, axis, eigval, proportion_explained) and coords (rep, sample_id, axis, value)."""
    spark: SparkSession = distance.sparkSession
    centred = materialized(gower(materialized(distance, "distance")), "centred")
    axes, coords = [], []
    for rep in sorted(r[0] for r in centred.select("rep").distinct().collect()):
        ids, values, vectors, trace = decompose(centred.where(F.col("rep") == rep), dims, seed, exact)
        scaled = vectors * np.sqrt(np.maximum(values, 0.0))
        axes += [(rep, i + 1, float(v), float(v / trace) if trace else 0.0) for i, v in enumerate(values)]
        coords += [(rep, s, i + 1, float(scaled[j, i])) for j, s in enumerate(ids) for i in range(len(values))]
    return spark.createDataFrame(axes, "rep int, axis int, eigval double, proportion_explained double"), spark.createDataFrame(coords, "rep int, sample_id string, axis int, value double")


def _within(shared, first: int):
    """For mapInPandas: (rep, perm, total, within) of a batch's squared distances, for some permutations at once."""

    def run(batches):
        import pandas as pd

        ids, codes, inverse = shared.value  # ids; group of each id in each permutation; 1 / group size
        place = pd.Index(ids)
        step = max(1, 4_000_000 // codes.shape[1])
        for pdf in batches:
            at = [place.get_indexer(pdf[k]) for k in ("sample_i", "sample_j")]
            known = (at[0] >= 0) & (at[1] >= 0)
            reps, squares = pdf["rep"].to_numpy(), pdf["distance"].to_numpy() ** 2
            for rep in np.unique(reps[known]):
                own = np.flatnonzero(known & (reps == rep))
                sums = np.zeros(codes.shape[1])
                for k in range(0, len(own), step):
                    some = own[k : k + step]
                    i, j = codes[at[0][some]], codes[at[1][some]]
                    sums += np.where(i == j, squares[some][:, None] * inverse[i], 0.0).sum(axis=0)
                yield type(pdf)({"rep": rep, "perm": first + np.arange(codes.shape[1]), "total": squares[own].sum(), "within": sums})

    return run


def permanova(distance: DataFrame, groups: DataFrame, columns: list[str], permutations: int = 999, seed: int = 42) -> DataFrame:
    """rep, grouping, method, test_name, sample_size, n_groups, statistic, p_value, n_permutations for each column of
    groups (sample_id, ...). Samples without a label are left out. Permutation 0 is the data as it is.

    Labels are broadcast for as many permutations at a time as BROADCAST allows; each distance meets all of those as
    vectors. Raises ValueError unless there are two groups or more, and more samples than groups. Where groups have no
    distances inside, the statistic is infinite; where there are none at all, it and p are null."""
    spark, out = distance.sparkSession, None
    distance = materialized(distance.select("rep", "sample_i", "sample_j", F.col("distance").cast("double").alias("distance")), "distance")
    ids = distance.select(F.col("sample_i").alias("sample_id")).unionAll(distance.select("sample_j")).distinct()
    for column in columns:
        label = groups.join(ids, "sample_id").where(F.col(column).isNotNull()).select("sample_id", F.col(column).cast("string").alias("label"))
        label = materialized(label, "label")
        rows = sorted(map(tuple, label.toLocalIterator()))  # as many as the distance matrix has rows
        names, codes, sizes = np.unique([r[1] for r in rows], return_inverse=True, return_counts=True) if rows else ([], [], [])
        n, a = len(rows), len(names)
        if a < 2 or n <= a:
            raise ValueError(f"The grouping '{column}' has {a} groups for {n} samples; two groups are needed, and more samples than groups.")
        if len({r[0] for r in rows}) < n:
            raise ValueError(f"The grouping '{column}' has several labels for a sample.")
        ordered, codes = [r[0] for r in rows], codes.astype(np.int32)
        own_labels = spark.sparkContext.broadcast((ordered, codes))
        chunk, sums = max(1, BROADCAST // (4 * n)), None
        for first in range(0, permutations + 1, chunk):
            last = min(first + chunk, permutations + 1)
            dealt = spark.range(first, last, 1, min(last - first, PERMUTERS)).mapInPandas(_dealt(own_labels, seed), "perm long, codes binary").orderBy("perm").collect()
            shared = spark.sparkContext.broadcast((ordered, np.stack([np.frombuffer(r["codes"], dtype=np.int32) for r in dealt], axis=1), 1.0 / sizes))
            part = distance.mapInPandas(_within(shared, first), "rep int, perm int, total double, within double").groupBy("rep", "perm").agg((F.sum("total") / n).alias("total"), F.sum("within").alias("within"))
            sums = part if sums is None else sums.unionAll(part)
        between = F.greatest(F.col("total") - F.col("within"), F.lit(0.0))
        ratio = F.try_divide(between / (a - 1), F.col("within") / (n - a))
        f = materialized(sums.select("rep", "perm", F.coalesce(ratio, F.when(F.col("total") > 0, F.lit(float("inf")))).alias("f")), "tests")
        own = f.where("perm = 0").select("rep", F.col("f").alias("statistic"))
        found = f.where("perm > 0").join(own, "rep", "right").groupBy("rep", "statistic").agg(F.sum(F.when(F.col("f") >= F.col("statistic") - 1e-12, 1).otherwise(0)).alias("over"))
        p = F.when(F.col("statistic").isNotNull(), (1.0 + F.col("over")) / (1.0 + permutations)) if permutations else F.lit(None).cast("double")
        rows = found.select("rep", F.lit(column).alias("grouping"), F.lit("PERMANOVA").alias("method"), F.lit("pseudo-F").alias("test_name"), F.lit(n).cast("int").alias("sample_size"), F.lit(a).cast("int").alias("n_groups"), "statistic", p.alias("p_value"), F.lit(permutations).alias("n_permutations"))
        out = rows if out is None else out.unionAll(rows)
    return out


def _dealt(shared, seed: int):
    """For mapInPandas: of each permutation the groups of the ids, as 32-bit integers. The label of the id whose hash has
    rank r goes to the r-th id."""

    def run(batches):
        ids, codes = shared.value
        for pdf in batches:
            dealt = []
            for perm in pdf["id"].tolist():
                keys = [(hashlib.md5(f"{seed}|{perm}|{s}".encode()).hexdigest()[:12], s) for s in ids]
                dealt.append((codes[sorted(range(len(keys)), key=keys.__getitem__)] if perm else codes).tobytes())
            yield type(pdf)({"perm": pdf["id"], "codes": dealt})

    return run
