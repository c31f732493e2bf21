"""What the corpus operators share: the shared work folder, text columns, and vectorised hashes of words."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.session import scratch

#: A word: a maximal run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Stands in for a null id inside join keys.
NO_ID = -(2**63)


#: Folders of the temporary blocks that are open.
_TEMPORARY: list[str] = []


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path inside the shared folder."""
    return scratch(spark, tag)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is stored inside the block, unless it is kept, is deleted at its end; nothing may read it afterwards."""
    _TEMPORARY.append(work_dir(spark, "temporary"))
    try:
        yield
    finally:
        deleted(spark, _TEMPORARY.pop())


def stored(df: DataFrame, tag: str, kept: bool = False) -> DataFrame:
    """df written once to the shared folder and reread: cuts the lineage and outlives executors."""
    path = work_dir(df.sparkSession, tag)
    if _TEMPORARY and not kept:
        path = f"{_TEMPORARY[-1]}/{path.rpartition('/')[2]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words in a text: words and gaps alternate, so they are counted without keeping them."""
    return F.size(F.filter(F.split(text, GAP), lambda w: w != "")).cast("long")


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xC2B2AE3D27D4EB4F


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) <= n:
            with np.errstate(over="ignore"):
                m = len(self.up)
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])


_POWERS = {b: _Powers(b) for b in (_BASE, _BASE2)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a polynomial hash depend on all values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hashes of values[s:e] for each span, from one pass of prefix sums: equal sequences get equal hashes wherever they
    stand."""
    p = _POWERS[base]
    p.need(len(values))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p.up[: len(values)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * p.down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(values: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hashes of every k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    p = _POWERS[base]
    p.need(len(values))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p.up[: len(values)], out=sums[1:])
        return mixed((sums[k:] - sums[:-k]) * p.down[:n])


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and the first and past-the-last byte of each word."""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[b]
    step = np.diff(inside)
    return b, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the words' spans in bytes."""
    b, starts, ends = word_spans(raw)
    return (span_hashes(b, starts, ends) if len(starts) else np.empty(0, dtype=np.uint64)), starts, ends


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every `width` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        a = pick(a[:-n], a[n:])
        n *= 2
    rest = width - n
    return pick(a[:-rest], a[rest:]) if rest else a


class Rows:
    """Gathers rows for an Arrow batch and hands the batch over once it weighs enough, so that memory stays bounded
    however long the texts are."""

    def __init__(self, schema, most: int = 4_000_000) -> None:
        self.schema, self.most = schema, most
        self.clear()

    def clear(self) -> None:
        self.columns, self.weight = [[] for _ in self.schema], 0

    def add(self, weight: int, *values) -> bool:
        """True if it is time to flush."""
        for c, v in zip(self.columns, values, strict=True):
            c.append(v)
        self.weight += weight + 64
        return self.weight >= self.most

    def flush(self):
        import pyarrow as pa

        out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.clear()
        return out
