"""Names of the distance families, and how summed terms become a distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phylospark import errors

FAMILIES = ("unweighted", "unweighted_unnormalized", "weighted_normalized", "weighted_unnormalized", "generalized")


def split_method(method: str) -> tuple[str, str]:
    """'x', 'x_fp32' or 'x_fp64' as (x, precision); a plain name is single precision."""
    for suffix in ("fp64", "fp32"):
        if method.endswith(f"_{suffix}"):
            method = method[: -len(suffix) - 1]
            break
    else:
        suffix = "fp32"
    if method not in FAMILIES:
        raise ValueError(errors.UNKNOWN_METHOD)
    return method, suffix


def ratio(family: str, top: Column, bottom: Column) -> Column:
    """The distance from summed terms; 0 over 0 is 0, and rounding never makes it negative."""
    if family.endswith("unnormalized"):
        return F.greatest(top, F.lit(0.0))
    return F.when(bottom > 0, F.greatest(top, F.lit(0.0)) / bottom).otherwise(F.lit(0.0))


def uniform(*parts: Column | str) -> Column:
    """48 bits of MD5 over the parts joined by '|', as a BIGINT."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))), 1, 12), 16, 10).cast("bigint")
