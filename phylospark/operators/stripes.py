"""Pairs by circular stripes, so that parts of a matrix can be computed apart and merged.

Stripe k holds the pairs (i, i + k + 1 mod n); there are floor(n / 2) of them, and every pair is in exactly one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.operators.diversity import beta
from phylospark.session import materialized


def count(n_samples: int) -> int:
    return n_samples // 2


def report(n_samples: int, n_partials: int) -> list[tuple[int, int]]:
    """Start and stop of `n_partials` ranges of stripes, as even as they can be; empty ranges are left out."""
    n = count(n_samples)
    edges = [n * k // n_partials for k in range(n_partials + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def partial(abundance: DataFrame, closure: DataFrame, samples: DataFrame, start: int, stop: int, method: str = "unweighted", **more) -> DataFrame:
    """The distances of the stripes start, ..., stop - 1. Only tile pairs that reach into them are computed."""
    n = samples.count()
    stripe = f"least(ord_j - ord_i, {n} - (ord_j - ord_i)) - 1"
    # ord_j - ord_i runs from `least` to `most` in a tile pair; the stripes' pairs are d in (start, stop] and n - d
    least, most = "greatest(1, (tile_j - tile_i - 1) * size + 1)", "(tile_j - tile_i + 1) * size - 1"
    reach = f"({least} <= {stop} AND {most} > {start}) OR ({least} < {n - start} AND {most} >= {n - stop})"
    return beta(abundance, closure, samples, method, pairs_where=f"{stripe} >= {start} AND {stripe} < {stop}", tiles_where=reach, **more)


def merge(parts: list[DataFrame], n_samples: int) -> DataFrame:
    """All parts as one matrix; raises if pairs are missing or come twice."""
    whole = materialized(reduce(DataFrame.unionByName, parts), "stripes")
    found = whole.groupBy("rep", "sample_i", "sample_j").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (found[0] or 0) != n_samples * (n_samples - 1) // 2 or (found[1] or 1) > 1:
        raise ValueError("The partial results do not make a whole matrix.")
    return whole
