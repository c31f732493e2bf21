"""Toxicity as ordinal regression: a cumulative-link model over sparse token counts.

P(grade <= k) = 1 / (1 + exp(s - t_k)) with one score s = sum of weight * log(1 + count) for all thresholds
t_0 < t_1 < t_2; the expected severity is the sum of P(grade > k). Features are the tokens (lower case, without
punctuation at either end) whose share of toxic documents is far above chance.

Labels are grades as far as they tell: 0 is grade 0, and where labels go beyond 1 they are the grades themselves. Where
they only say toxic or not, a toxic document's grade is known to be 1 to 3 and no more, and that is its part of the
likelihood (interval censoring). Thresholds that no label separates then follow from SHARES: of the toxic documents
these shares are expected above them. No grade is made up from the text.

The model is fitted on at most TRAIN_ROWS labelled documents (those with the least hash of their id, one row an id, so
reruns agree) and at most FEATURES tokens; every document is scored, over its whole text.

Nulls: a null text is an empty one; null labels or ids don't train; a document with several labels has the largest,
an id with several texts trains with the one of the least hash.
Repeated rows are scored each. Without labels of both kinds nothing is called toxic and severity is 0. Empty tables
give empty results. Columns other than doc_id, text and toxic are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm import common as c
from phylospark.llm.bpe import Remembered

TRAIN_ROWS, FEATURES, LEAST_Z, LEAST_DOCS, GRADES = 20_000, 2_000, 5.0, 3, 4
#: Of toxic documents, those expected above the second and the third threshold where labels don't tell.
SHARES = (2 / 3, 1 / 3)
_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "¡¿«»„“”‘’…–—"


def token(word: bytes) -> str:
    return word.decode("utf-8").strip(_EDGES).lower()


class Model:
    """Weights by token, and thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: tuple[float, ...]) -> None:
        self.weights, self.thresholds = weights, thresholds
        #: The model's token for a word, or None.
        self.known = Remembered(lambda w: t if (t := token(w)) in weights else None, longest=48)

    def __reduce__(self):
        return Model, (self.weights, self.thresholds)

    def score(self, raw: bytes) -> float:
        counts = Counter(filter(None, map(self.known.__getitem__, raw.split())))
        return sum(self.weights[t] * float(np.log1p(n)) for t, n in sorted(counts.items()))

    def above(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [float(1 / (1 + np.exp(t - score))) for t in self.thresholds]


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, lower: np.ndarray, upper: np.ndarray, width: int, grades_n: int = GRADES, ridge: float = 2e-5, steps: int = 800, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the mean negative log likelihood of grades from lower to upper; x is
    given as coordinates."""
    n, k = len(lower), grades_n - 1
    told = np.array([((lower == i + 1) | (upper == i)).any() for i in range(k)])
    tail = np.array([np.clip((lower > i).mean(), 1e-4, 1 - 1e-4) for i in range(k)])
    first = np.log((1 - tail) / tail)
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    p = np.concatenate([np.zeros(width), first[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w = p[:width]
        t = np.concatenate([p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))])
        s = np.bincount(rows, weights=values * w[columns], minlength=n)
        cu = _sigmoid(np.concatenate([t, [np.inf]])[upper] - s)
        cl = _sigmoid(np.concatenate([[-np.inf], t])[lower] - s)
        mass = np.maximum(cu - cl, 1e-12)
        du, dl = cu * (1 - cu) / mass, cl * (1 - cl) / mass
        gs = (du - dl) / n
        gt = np.zeros(k)
        np.add.at(gt, upper[upper < k], -du[upper < k] / n)
        np.add.at(gt, lower[lower > 0] - 1, dl[lower > 0] / n)
        gw = np.bincount(columns, weights=values * gs[rows], minlength=width) + ridge * w
        rest = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, rest[:1], rest[1:] * np.exp(p[width + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = np.concatenate([p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))])
    scores = np.bincount(rows, weights=values * p[:width][columns], minlength=n)[lower > 0]
    for i, share in enumerate(SHARES, start=1):
        if i < k and not told[i]:
            # as far as the share itself lies above the threshold before
            t[i] = _quantile(scores, min(share, 0.999 * float(_sigmoid(scores - t[i - 1]).mean())))
    return p[:width], t


def _quantile(scores: np.ndarray, share: float) -> float:
    """The threshold above which this share of the rows is expected."""
    low, high = scores.min() - 40.0, scores.max() + 40.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(scores - middle).mean() > share else (low, middle)
    return (low + high) / 2


def _count_tokens(batches):
    for batch in batches:
        docs, toxic = Counter(), Counter()
        for raw, y in zip(batch.column("text").cast(pa.binary()), batch.column("toxic"), strict=True):
            own = {token(w) for w in set(raw.as_py().split())} - {""}
            docs.update(own)
            if y.as_py() > 0:
                toxic.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([toxic[t] for t in docs], pa.int64())], names=["token", "docs", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    with c.temporary(docs.sparkSession):
        return _fit(docs, labels, train_rows)


def _fit(docs: DataFrame, labels: DataFrame, train_rows: int) -> Model:
    own = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("id")).agg(F.max(labels["toxic"].cast("int")).alias("toxic"))
    sample = own.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), c.text_of(docs).alias("text"))
    train = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    train = c.stored(train.select("text", "toxic"), "train")
    n, positive, most = train.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)), F.max("toxic")).first()
    if not 0 < positive < n:
        return Model({}, (np.inf,) * (GRADES - 1))
    rate = positive / n
    counted = train.mapInArrow(_count_tokens, "token string, docs long, toxic long").groupBy("token").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("docs") * rate) / F.sqrt(F.col("docs") * rate * (1 - rate))
    chosen = [r["token"] for r in counted.where((F.col("toxic") >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(z.desc(), "token").limit(FEATURES).collect()]
    place = {t: i for i, t in enumerate(sorted(chosen))}

    def sparse(batches):
        for batch in batches:
            at, n = [], []
            for raw in batch.column("text").cast(pa.binary()):
                found = Counter(place[t] for w in raw.as_py().split() if (t := token(w)) in place)
                at.append(sorted(found))
                n.append([found[i] for i in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["toxic", "at", "n"])

    rows = sorted((r["toxic"], list(r["at"]), list(r["n"])) for r in train.mapInArrow(sparse, "toxic int, at array<int>, n array<int>").toLocalIterator())
    lower = np.clip(np.array([r[0] for r in rows]), 0, GRADES - 1)
    upper = lower if most > 1 else np.where(lower > 0, GRADES - 1, 0)
    index = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    columns = np.array([i for r in rows for i in r[1]], dtype=np.int64)
    values = np.log1p(np.array([x for r in rows for x in r[2]], dtype=np.float64))
    weights, thresholds = fit_ordinal(index, columns, values, lower, upper, max(1, len(place)))
    return Model({t: float(weights[i]) for t, i in place.items()}, tuple(map(float, thresholds)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (the median), p_toxic, toxic (p_toxic >= 0.5) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES tokens

    def run(batches):
        own = shared.value
        for batch in batches:
            above = [own.above(own.score(raw.as_py())) for raw in batch.column("text").cast(pa.binary())]
            grade = [sum(x >= 0.5 for x in a) for a in above]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(sum, above), pa.float64()), pa.array(grade, pa.int32()), pa.array([a[0] for a in above], pa.float64()), pa.array([a[0] >= 0.5 for a in above])],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), c.text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
