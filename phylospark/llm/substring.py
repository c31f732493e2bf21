"""Substring dedup with a log-structured index of window fingerprints.

Each window of `window` words is stood for by the smallest hash among its `gram`-word grams: equal windows have equal
minima, and consecutive windows mostly share theirs, so the index holds a tenth as many hashes as there are windows.
A run is an immutable table, bucketed and sorted by hash, so that runs meet in merge joins without a shuffle. A new
batch becomes a run after a merge join with the earlier ones, which marks what was seen before; once there are `fanout`
runs they are compacted into one. Windows whose minimum repeats anywhere are verified by 96 bits over all their words,
drawn from two independent polynomial hashes; the hash takes the place of word-by-word comparison.

Windows of a fingerprint with n occurrences are counted in ceil(n / part) parts, dealt by document. What is alone in its
part meets one row of each other part, so no task sees a common window more than about `part` times.

Nulls: a null text is an empty one, a null doc_id is an id of its own. Repeated rows are documents of their own, so
each word of theirs that a window covers goes. Texts under `window` words lose nothing. Empty tables give empty
results. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylospark.llm import common as c

WINDOW, GRAM = 35, 12
#: Occurrences of one fingerprint whose windows are counted together.
PART = 4_096


def _minima(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes that are the minimum of some window (all ties), and each window's minimum."""
    grams = c.window_hashes(words, gram)
    width = window - gram + 1
    low = c.sliding(grams, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    return grams[c.sliding(np.concatenate([pad, low, pad]), width, np.maximum) == grams], low


def _count_fingerprints(window: int, gram: int):
    def run(batches):
        for batch in batches:
            found = []
            for raw in batch.column("text").cast(pa.binary()):
                words, _, _ = c.word_hashes(raw.as_py())
                if len(words) >= window:
                    found.append(_minima(words, window, gram)[0])
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _own_fingerprints(window: int, gram: int):
    def run(batches):
        for batch in batches:
            rows, hashes = [], []
            for i, raw in enumerate(batch.column("text").cast(pa.binary())):
                words, _, _ = c.word_hashes(raw.as_py())
                if len(words) >= window:
                    h = np.unique(_minima(words, window, gram)[0])
                    rows.append(np.full(len(h), i))
                    hashes.append(h)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(at), batch.column("k2").take(at), pa.array(np.concatenate(hashes).view(np.int64))], names=["k1", "k2", "h"])

    return run


def _candidate_windows(window: int, gram: int):
    def run(batches):
        for batch in batches:
            keys = batch.column("k1"), batch.column("k2")
            for i, (raw, seen, parts) in enumerate(zip(batch.column("text").cast(pa.binary()), batch.column("seen"), batch.column("parts"), strict=True)):
                words, _, _ = c.word_hashes(raw.as_py())
                low = _minima(words, window, gram)[1]
                seen, parts = seen.values.to_numpy().view(np.uint64), parts.values.to_numpy()
                order = np.argsort(seen)
                place = order[np.minimum(np.searchsorted(seen, low, sorter=order), len(seen) - 1)]
                at = np.flatnonzero(seen[place] == low)
                if not len(at):
                    continue
                w1 = c.window_hashes(words, window)[at].view(np.int64)
                w2 = (c.window_hashes(words, window, c._BASE2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                one = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([keys[0].take(one), keys[1].take(one), pa.array(at.astype(np.int32)), pa.array(w1), pa.array(w2), pa.array(parts[place[at]])], names=["k1", "k2", "at", "w1", "w2", "parts"])

    return run


def _cut(window: int, keep: int, as_was: bool, most: int = 4_000_000):
    """Rows of (doc_id, n_words, n_removed, kept_text, then the `keep` first columns), handed over by weight. as_was: a
    text that loses nothing stays as it is."""

    def run(batches):
        for batch in batches:
            held, weight, start = ([], [], []), 0, 0
            end = batch.num_rows - 1
            for i, (raw, at) in enumerate(zip(batch.column("text").cast(pa.binary()), batch.column("at"), strict=True)):
                raw = raw.as_py()
                kept, removed = raw.split(), 0
                n = len(kept)
                if at.is_valid:
                    steps = np.zeros(n + 1, dtype=np.int64)
                    starts = np.unique(at.values.to_numpy())
                    steps[starts] += 1
                    steps[starts + window] -= 1
                    gone = np.cumsum(steps[:-1]) > 0
                    removed = int(gone.sum())
                    kept = [w for w, g in zip(kept, gone.tolist(), strict=True) if not g]
                out = raw if as_was and not removed else b" ".join(kept)
                for column, value in zip(held, (n, removed, out.decode("utf-8")), strict=True):
                    column.append(value)
                weight += len(raw) + 64
                if weight >= most or i == end:
                    rest = [batch.column(k).slice(start, i + 1 - start) for k in range(keep + 1)]
                    yield pa.RecordBatch.from_arrays([rest[0], pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.string()), *rest[1:]], names=["doc_id", "n_words", "n_removed", "kept_text", *(f"_{k}" for k in range(keep))])
                    held, weight, start = ([], [], []), 0, i + 1

    return run


class FingerprintIndex:
    """Immutable runs of window fingerprints in the shared folder, bucketed and sorted by h: (h, n occurrences,
    repeated). `buckets` is as many as there are shuffle partitions unless given."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path or c.work_dir(spark, "fingerprints")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs, self.window, self.gram, self.fanout, self.made = [], window, gram, fanout, 0

    def _write(self, rows: DataFrame) -> str:
        """A run's table; its files lie in the index's folder."""
        self.made += 1
        name = f"run_{self.made:06d}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "h")

    def append(self, docs: DataFrame) -> None:
        """Adds a batch of (text): its fingerprints are merge-joined with each earlier run and become a run."""
        fresh = self._dealt(docs.select(c.text_of(docs).alias("text")).mapInArrow(_count_fingerprints(self.window, self.gram), "h long, n long"))
        fresh = fresh.groupBy("h").agg(F.sum("n").alias("n")).withColumn("repeated", F.col("n") > 1)
        for run in self.runs:
            old = self.spark.table(run).select("h", F.lit(True).alias("old"))
            fresh = fresh.join(old.hint("merge"), "h", "left").select("h", "n", (F.col("repeated") | F.col("old").isNotNull()).alias("repeated"))
        self.runs.append(self._write(fresh))
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        """One run in place of all."""
        if len(self.runs) > 1:
            whole = self.spark.table(self.runs[0])
            for run in self.runs[1:]:
                more = self.spark.table(run).select("h", F.col("n").alias("more"), F.col("repeated").alias("also"))
                n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
                whole = whole.join(more.hint("merge"), "h", "full").select("h", n.alias("n"), (F.coalesce("repeated", F.lit(False)) | F.coalesce("also", F.lit(False))).alias("repeated"))
            merged = self._write(whole)
            self.drop()
            self.runs = [merged]

    def drop(self) -> None:
        """Forgets the runs and deletes their files."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            c.deleted(self.spark, f"{self.path}/{run}")
        self.runs = []

    def repeated(self) -> DataFrame:
        """(h, n) of the fingerprints that occur twice or more. The latest run that has one is marked."""
        self.compact()
        # read as plain files: then a join can be split where a fingerprint is common
        return self.spark.read.schema("h long, n long, repeated boolean").parquet(f"{self.path}/{self.runs[0]}").where("repeated").select("h", "n")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 2, keep: tuple[Column, ...] = (), as_was: bool = False, part: int = PART) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space; with as_was a text that loses nothing stays
    as it is) of every row, then its columns in `keep` as _0, _1, ...: gone is each word that a window covers whose words
    also start anywhere else. The rows reach the index in `batches` batches."""
    spark = docs.sparkSession
    text = c.text_of(docs)
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.coalesce(docs["doc_id"].cast("long"), F.lit(c.NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), *(k.alias(f"_{i}") for i, k in enumerate(keep)))
    kept = [f"_{i}" for i in range(len(keep))]
    index = FingerprintIndex(spark, window=window, gram=gram, fanout=max(2, batches))
    for b in range(batches):
        index.append(base.where(F.pmod(F.xxhash64("k1"), F.lit(batches)) == b).select("text"))
    seen = index.repeated()
    owners = base.select("k1", "k2", "text").mapInArrow(_own_fingerprints(window, gram), "k1 long, k2 long, h long")
    seen = seen.select("h", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    found = owners.join(seen, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "parts")).alias("x")).select("k1", "k2", F.col("x.h").alias("seen"), F.col("x.parts").alias("parts"))
    # both joins read the same columns of the same rows, so the texts are shuffled once
    windows = base.select("doc_id", *kept, "text", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", *kept, "k1", "k2", "text", "seen", "parts")
    windows = windows.mapInArrow(_candidate_windows(window, gram), "k1 long, k2 long, at int, w1 long, w2 int, parts int")
    twice = _repeated(windows).groupBy("k1", "k2").agg(F.collect_set("at").alias("at"))
    whole = base.select("doc_id", *kept, "text", "k1", "k2").join(twice, ["k1", "k2"], "left").select("doc_id", *kept, "text", "at")
    extra = "".join(f", {k} {base.schema[k].dataType.simpleString()}" for k in kept)
    return whole.mapInArrow(_cut(window, len(keep), as_was), f"doc_id long, n_words long, n_removed long, kept_text string{extra}")


def _repeated(windows: DataFrame) -> DataFrame:
    """(k1, k2, at) of windows whose words occur twice or more. Equal windows have the same number of parts."""
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("k1", "k2"), "parts").cast("int")).repartition("w1", "w2", "part")
    # nothing is added to the number of parts, but as it could be random, what is asked of it stays above the shuffle, which
    # so serves both uses
    parts = F.coalesce("parts", F.lit(0)) + F.floor(F.rand(0))
    within = dealt.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("w1", "w2", "part"))).where((F.col("n") > 1) & (parts > 0)).select("k1", "k2", "at")
    # of several parts each sends one row for a window; where a part has no other, that one row may meet those of others
    heads = dealt.where(parts > 1).groupBy("w1", "w2", "part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("head"))
    met = heads.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("w1", "w2"))).where("n = 1 AND c > 1")
    return within.unionAll(met.select("head.k1", "head.k2", "head.at"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Rows of docs with the repeated words cut out of their texts, and n_chars, where docs has it, counted anew. A text
    that loses nothing stays as it is, null too; another one's words are joined by one space."""
    others = tuple(k for k in docs.columns if k != "text")
    cut = remove_repeats(docs, keep=(*(docs[k] for k in others), docs["text"].isNull()), as_was=True)
    was = {k: f"_{i}" for i, k in enumerate(others)}
    fresh = {"text": F.when(~F.col(f"_{len(others)}"), F.col("kept_text"))}
    if "n_chars" in was:
        fresh["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col(was["n_chars"]))
    return cut.select(*((fresh[k] if k in fresh else F.col(was[k])).cast(docs.schema[k].dataType).alias(k) for k in docs.columns))


#: What remove_repeats with the default window gives, in DuckDB's SQL.
SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(list_slice(w, i, i + 34), ' '))) AS c FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)
), gone AS (
  SELECT DISTINCT r, i + j AS p FROM windows, (SELECT unnest(range(35)) AS j) WHERE c > 1
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM split LEFT JOIN kept k USING (r)
"""
