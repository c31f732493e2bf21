"""Document fingerprints by winnowing.

Every k code points are hashed; of each `window` consecutive hashes the smallest is selected, the rightmost of equal
ones, with its position. Two texts that share k + window - 1 code points or more therefore share a selected hash, and
its positions in both say where. Texts shorter than k are one hash of all they have; an empty text has no fingerprint.

Nulls: a null text is an empty one. Order for `with_next`: doc_id descending, null ids last, equal ids by a hash of
their text; after the last comes the first, so a table of one row follows itself. Repeated rows count each. Empty
tables give empty results. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.llm import common as c

K, WINDOW = 12, 24
#: Windows that are selected from at a time.
STRETCH = 1 << 23


class Fingerprint:
    """Selected hashes (40 bits) and their positions in code points."""

    def __init__(self, points: np.ndarray, k: int = K, window: int = WINDOW) -> None:
        n = len(points)
        hashes = c.window_hashes(points, min(k, n)) if n else np.empty(0, dtype=np.uint64)
        # 40 bits of the hash and the reversed place inside a stretch of 2^24 in one integer: the smallest is the smallest
        # hash at its rightmost place; stretches overlap by a window, so long texts are selected from as short ones are
        width, mask, found = min(window, len(hashes)), np.uint64((1 << 24) - 1), []
        for start in range(0, len(hashes) - width + 1 if n else 0, STRETCH):
            own = hashes[start : start + STRETCH + width - 1]
            low = c.sliding((own & ~mask) | (mask - np.arange(len(own), dtype=np.uint64)), width, np.minimum)
            low = low[np.concatenate([[True], low[1:] != low[:-1]])]
            found.append((mask - (low & mask)).astype(np.int64) + start)
        at = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        self.at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        self.hashes = hashes[self.at] >> np.uint64(24)
        self.distinct = np.unique(self.hashes)

    def text(self) -> str:
        """Eighteen hexadecimal digits for each selected hash: ten of the hash, eight of its position."""
        out = np.empty((len(self.at), 9), dtype=np.uint8)
        out[:, :5] = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
        out[:, 5:] = self.at.astype(">u4").view(np.uint8).reshape(-1, 4)
        return out.tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """Share of the distinct hashes of both that both have; 1 if neither has any."""
        a, b = len(self.distinct), len(other.distinct)
        if not a or not b:
            return float(a == b)
        both = a + b - len(np.unique(np.concatenate([self.distinct, other.distinct])))
        return both / (a + b - both)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, and hashes and positions (both arrays, in text order) of every row's text."""

    def run(batches):
        for batch in batches:
            prints = [Fingerprint(points_of(t.as_py()), k, window) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([p.hashes.astype(np.int64) for p in prints], pa.list_(pa.int64())), pa.array([p.at.astype(np.int64) for p in prints], pa.list_(pa.int64()))],
                names=["doc_id", "hashes", "positions"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), c.text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


_KEYS = ("k0", "k1", "k2")


def _starts(keys: DataFrame, parts: int) -> list[tuple]:
    """The least key of each stretch, in order: as many as there are parts, at most. Keys are ranged without texts."""
    with c.temporary(keys.sparkSession):
        ranged = c.stored(keys, "keys").repartitionByRange(parts, *_KEYS).groupBy(F.spark_partition_id().alias("part"))
        return sorted(tuple(r["least"]) for r in ranged.agg(F.min(F.struct(*_KEYS)).alias("least")).collect())


def _stretch(starts: list[tuple]) -> Column:
    """The number of the stretch that a row's key is in, by binary search."""
    bounds = [F.array(*(F.lit(s[i]).cast("long") for s in starts)) for i in range(len(_KEYS))]

    def step(a: Column, _: Column) -> Column:
        middle = F.shiftright(a["low"] + a["high"], 1)
        inside = (a["low"] < a["high"]) & (F.struct(*_KEYS) >= F.struct(*(F.get(b, middle).alias(k) for b, k in zip(bounds, _KEYS, strict=True))))
        return F.struct(F.when(inside, middle + 1).otherwise(a["low"]).alias("low"), F.when(inside | (a["low"] >= a["high"]), a["high"]).otherwise(middle).alias("high"))

    rounds = F.array(*map(F.lit, range(len(starts).bit_length() + 1)))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.lit(len(starts)).alias("high")), step, lambda a: a["low"] - 1)


def _with_next(rows: DataFrame) -> DataFrame:
    """Rows dealt into stretches of the order, each followed by the first row of the next stretch, marked `extra`. There
    are as many stretches as shuffle partitions, of about equal numbers of rows, whatever the ids; only rows that are
    equal in id and text stay together."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ascending as the order is: ids descending and nulls last, then hashes descending
    keys = F.col("doc_id").isNull().cast("long").alias("k0"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("k1"), F.bitwise_not("tie").alias("k2")
    starts = _starts(rows.select(*keys), parts)
    if not starts:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("extra"), "doc_id", "text")
    placed = rows.select("doc_id", "text", "tie", *keys).withColumn("part", _stretch(starts))
    # the row at the head of a stretch also goes to the stretch before it, the very first to the last stretch
    heads = [F.array(*(F.lit(s[i]).cast("long") for s in starts)) for i in range(len(_KEYS))]
    is_head = F.struct(*_KEYS) == F.struct(*(F.get(h, F.col("part")).alias(k) for h, k in zip(heads, _KEYS, strict=True)))
    before = F.when(is_head, F.pmod(F.col("part") - 1, F.lit(len(starts))))
    both = F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.struct(before.alias("part"), F.lit(True).alias("extra")))
    dealt = placed.select("doc_id", "text", "tie", F.explode(F.filter(both, lambda x: x["part"].isNotNull())).alias("to"))
    dealt = dealt.select("doc_id", "text", "tie", F.col("to.part").alias("part"), F.col("to.extra").alias("extra"))
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()).select("part", "extra", "doc_id", "text")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_with_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """For every row its fingerprint, that of its edited text (the last third replaced by the head of the next text in
    the order), and the likeness of its fingerprint to that one's and to the next text's."""

    def run(batches):
        out = c.Rows(_OUT)
        held = None

        def close(held, follower):
            doc_id, text, own = held
            after, theirs = follower
            n = len(text)
            edited = text[: n - n // 3] + after[: n // 3]
            other = Fingerprint(points_of(edited), k, window)
            a, b = own.text(), other.text()
            return out.add(len(a) + len(b), doc_id, n, hashlib.sha256(edited.encode("utf-8")).hexdigest(), a, b, own.likeness(other), own.likeness(theirs))

        part = None
        for batch in batches:
            for p, extra, doc_id, text in zip(batch.column("part"), batch.column("extra"), batch.column("doc_id"), batch.column("text"), strict=True):
                p, extra, text = p.as_py(), extra.as_py(), text.as_py()
                if p != part:
                    part, held = p, None
                elif held is None:
                    continue  # a further row with the id of the head
                own = Fingerprint(points_of(text), k, window)
                if held is not None and close(held, (text, own)):
                    yield out.flush()
                held = None if extra else (doc_id.as_py(), text, own)
        yield out.flush()

    text = c.text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    return _with_next(rows).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
