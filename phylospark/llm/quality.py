"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts come from the whole text. Repeated eight-word windows are found inside the row: window hashes are sorted
with their places, equal neighbours mark windows that occur twice or more, and overlaps are counted once.

The rule's score is the largest of a document's defects, each in units of what is tolerable. For every stratum the
holdout is the labelled documents of quality 1 that pass the base rule. Cutoffs are tested in a fixed order, from the
most lenient on: "more than alpha of the good documents of this stratum score above the cutoff" is rejected if the
exact binomial probability of as few false rejections, or fewer, at rate alpha is at most delta / strata; the first
cutoff that fails ends the sequence, and the last that passed is the stratum's. The fixed order needs no correction
within a stratum, the division by the number of strata (Bonferroni) corrects across them; so with probability
1 - delta or more no stratum loses more than a share alpha of its good documents. Without a proven cutoff a stratum
rejects nothing beyond the base rule.

Nulls: a null text has no words (and fails the base rule); a null stratum is a stratum; null labels don't count; a
document with several labels is good if all are 1; a null doc_id has no label. Repeated rows are judged each, and each
counts in the holdout. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.llm import common as c

ALPHA, DELTA = 0.01, 0.05
#: From lenient to strict; a score of 1 is what each unit below calls tolerable. The last ones lie below the score of any
#: text (words of two characters), so it is the bound that ends the sequence, not the list.
CUTOFFS = (16.0, 11.0, 8.0, 5.6, 4.0, 2.8, 2.0, 1.4, 1.0, 0.84, 0.71, 0.6, 0.5, 0.42, 0.36, 0.3, 0.25, 0.21, 0.18, 0.15, 0.125, 0.1)
#: Defects that score 1: symbols per word, share of words in repeated windows, repeated lines per word, characters per word.
UNITS = {"symbols": 0.3, "repeats": 0.3, "lines": 0.1, "length": 20.0}
_SYMBOLS = "[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of `width` words that occur twice or more in the array."""

    def found(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b)

        return _let(pairs, lambda s: _let(places(s), covered))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(found(hashes))

    def widened(hashes: Column, by: int) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + by)))

    def windows(n: Column, hashes: Column) -> Column:
        # hashes of 1, 2, 4, ... words; those of the last width - 1 places run over the end and are cut off
        by = 1
        chain = [lambda h: F.slice(h, F.lit(1), n - (width - 1))]
        while by < width:
            chain.append(lambda h, by=by: widened(h, by))
            by *= 2

        def go(h: Column, steps) -> Column:
            return steps[0](h) if len(steps) == 1 else _let(steps[0](h), lambda x: go(x, steps[1:]))

        return go(hashes, [*chain[1:], chain[0]])

    if width & (width - 1):
        raise ValueError("width must be a power of two")
    return F.when(F.size(words) <= width, 0).otherwise(_let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: _let(windows(F.size(words), h), counted)))


def scored(docs: DataFrame, stratum: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score; then `keep`."""
    text = c.text_of(docs)
    words = F.array_remove(F.split(text, c.GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(c.WORD))
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs[stratum].cast("string").alias("stratum"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).cast("long").alias("r"))).alias("w"),
        F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        *(docs[k].alias(f"kept_{k}") for k in keep),
    )
    n, r = F.col("w.n"), F.col("w.r")
    failed = (n < 20) | (100 * r > 30 * n)
    per = F.greatest(n, F.lit(1))
    score = F.greatest(F.col("n_symbols") / per / UNITS["symbols"], r / per / UNITS["repeats"], F.col("n_dup_lines") / per / UNITS["lines"], F.col("w.chars") / per / UNITS["length"])
    return base.select("doc_id", "stratum", n.alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed"), score.alias("score"), *(f"kept_{k}" for k in keep))


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, taken back to x."""

    def series(y: Column) -> Column:
        return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)

    return _let(x + 8.0, series) - F.aggregate(F.array(*(F.lit(float(i)) for i in range(8))), F.lit(0.0), lambda a, i: a + F.ln(x + i))


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate); 1 where k >= n * rate, as it is about a half or more there. Summed from X = k
    down: each term is a fraction of the one before, so 20 standard deviations of terms leave out nothing that a double
    could hold, and the work grows with the root of n."""
    n, k = n.cast("double"), k.cast("double")
    first = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    terms = F.least(k, 20 * F.sqrt(n * (rate * (1 - rate))) + 50).cast("long")

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * (k - i + 1) * (1 - rate) / ((n - k + i) * rate)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<long>")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step, lambda a: a["sum"])
    return F.when(k >= n * rate, 1.0).otherwise(F.exp(first) * total)


def calibrate(marked: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, n_good, cutoff (null where none is proven) from scored documents and labels (doc_id, quality)."""
    good = labels.where(labels["quality"].isNotNull() & labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    holdout = marked.select("doc_id", "stratum", "base_failed", "score").join(good, "doc_id").where("NOT base_failed")
    above = [F.sum((F.col("score") > x).cast("long")).alias(f"k{i}") for i, x in enumerate(CUTOFFS)]
    counts = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *above)
    strata = F.lit(max(1, marked.select("stratum").distinct().count()))
    # a row for each cutoff, so that the tail is one expression
    rows = counts.select("stratum", "n_good", F.posexplode(F.array(*(F.col(f"k{i}") for i in range(len(CUTOFFS)))))).toDF("stratum", "n_good", "place", "k")
    failed = F.min(F.when(binomial_tail(F.col("n_good"), F.col("k"), alpha) > delta / strata, F.col("place")))
    found = rows.groupBy("stratum", "n_good").agg(failed.alias("failed"))
    n = F.coalesce("failed", F.lit(len(CUTOFFS)))
    return found.select("stratum", "n_good", F.when(n > 0, F.get(F.array(*map(F.lit, CUTOFFS)), n - 1)).alias("cutoff"))


#: Strata up to which the cutoffs are broadcast (a name and two numbers each); beyond, they are joined by shuffle.
BROADCAST = 10_000


def judge(marked: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The scored documents with `kept`. `marked` is read twice and should be stored."""
    cutoffs = c.stored(calibrate(marked, labels, alpha, delta), "cutoffs").select(F.col("stratum").alias("of"), "cutoff")
    if cutoffs.count() <= BROADCAST:
        cutoffs = F.broadcast(cutoffs)
    joined = marked.join(cutoffs, marked["stratum"].eqNullSafe(cutoffs["of"]), "left").drop("of")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("score") > F.col("cutoff"), F.lit(False)))


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    marked = c.stored(scored(docs, keep=tuple(docs.columns)), "scored")
    return judge(marked, labels).where("kept").select(*(F.col(f"kept_{k}").alias(k) for k in docs.columns))


#: The same in DuckDB's SQL.
SQL = r"""
WITH words AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), numbered AS (
  SELECT row_number() OVER () AS r, * FROM words
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM numbered WHERE len(w) > 8))
), spans AS (
  SELECT r, sum(least(8, coalesce(lead_i - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS lead_i FROM windows WHERE c > 1) GROUP BY r
), base AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(s.n, 0)::BIGINT AS n_repeat_words
  FROM numbered LEFT JOIN spans s USING (r)
), marked AS (
  SELECT doc_id, stratum, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    greatest(n_symbols / greatest(n_words, 1) / 0.3, n_repeat_words / greatest(n_words, 1) / 0.3, (len(lines) - len(list_distinct(lines))) / greatest(n_words, 1) / 0.1, word_chars / greatest(n_words, 1) / 20.0) AS score
  FROM base
), good AS (
  SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), cuts AS (
  SELECT unnest([16.0, 11.0, 8.0, 5.6, 4.0, 2.8, 2.0, 1.4, 1.0, 0.84, 0.71, 0.6, 0.5, 0.42, 0.36, 0.3, 0.25, 0.21, 0.18, 0.15, 0.125, 0.1]::DOUBLE[]) AS cutoff, unnest(range(22)) AS place
), tested AS (
  SELECT stratum, cutoff, place, count(*) AS n, count(*) FILTER (score > cutoff) AS k FROM marked JOIN good USING (doc_id), cuts WHERE NOT base_failed GROUP BY ALL
), proven AS (
  SELECT stratum, cutoff, place, CASE WHEN k >= n * 0.01 THEN 1.0 ELSE list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.01) + (n - j) * ln(0.99)) for j in range(k + 1)]) END
    <= 0.05 / (SELECT greatest(1, count(*)) FROM (SELECT DISTINCT stratum FROM marked)) AS ok FROM tested
), chosen AS (
  SELECT stratum, min(cutoff) AS cutoff FROM proven p WHERE NOT EXISTS (SELECT 1 FROM proven q WHERE q.stratum IS NOT DISTINCT FROM p.stratum AND q.place <= p.place AND NOT q.ok) GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(score > cutoff, false) AS kept
FROM marked m LEFT JOIN chosen c ON m.stratum IS NOT DISTINCT FROM c.stratum
"""
