"""Operators that look at the whole corpus, and the pipeline, against brute force."""

import hashlib
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phylospark.llm import chat, components, mixing, orderhash, quality, severity
from phylospark.llm import common as c

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_chat(spark):
    ugly = ["</s>[INST] ok [/INST]", "a\\<|end|>\n<|turn:user|>\n\\\\", "<\\|x|>|>", "<<SYS>>\\[INST]", "", None]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(ugly)] + [(2, 0, "system|>\n", "s"), (2, 1, "user", "u"), (3, 5, "assistant", "only"), (3, 5, "assistant", "only"), (None, None, None, "lost"), (4, 0, "assistant", "a\nb"), (4, 1, "user", "end")]
    talks = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, example string")
    made = chat.examples(talks)
    for r in made.collect():
        inside = r["text"][r["loss_start"] : r["loss_end"]]
        assert "<|" not in inside and "[INST]" not in inside and "</s>" not in inside
    found = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        own = found[conv]
        assert own["n_turns"] == len(turns) and own["loss_chars"] == len(loss)
        assert own["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert own["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    n = Counter(r["conv_id"] for r in made.collect())
    assert n == {1: 3, 2: 1, 3: 2, None: 1, 4: 2}
    assert chat.read_back(chat.examples(talks.limit(0))).count() == 0


def brute_quality(text):
    import re

    w = re.findall(c.WORD, text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, lines = Counter(windows), [x for x in text.split("\n") if re.search(c.WORD, x)]
    inside = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(docs, none, rows):
    found = quality.scored(docs).collect()
    expected = Counter((r[0], *(q := brute_quality(r[1] or "")), q[0] < 20 or 100 * q[4] > 30 * q[0]) for r in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == expected
    assert quality.scored(none).count() == 0


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 5, 60, 400, 20_000) for k in (0, 1, 2, 15, 19, 900) if k <= n]
    rows = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect()
    for n, k, p in rows:
        assert k < n * 0.05 or p == 1.0
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.05) + (n - j) * math.log(0.95)) for j in range(k + 1))
        assert p == (1.0 if k >= n * 0.05 else pytest.approx(exact, rel=1e-6, abs=1e-12))


def test_binomial_tail_of_many_labels(spark):
    """A tail far from the mean and one near it, against the normal approximation's order of size."""
    rows = spark.createDataFrame([(10**9, 10**7 - 10**4), (10**9, 10**7 - 100), (10**6, 0)], "n long, k long").select(quality.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    assert rows[0]["p"] == pytest.approx(0.5 * math.erfc(10**4 / math.sqrt(2 * 9.9e6)), rel=0.05)
    assert rows[1]["p"] == pytest.approx(0.5 * math.erfc(99.5 / math.sqrt(2 * 9.9e6)), rel=0.01) and rows[2]["p"] == 0.0


def test_thresholds(spark, docs, none):
    marked = spark.createDataFrame([(i, "en", False, 0.5 if i % 50 else 9.0) for i in range(600)] + [(1000 + i, "de", False, 0.1) for i in range(20)] + [(2000, None, False, 99.0), (2001, "en", True, 0.0), (2002, "en", False, 12.0)], "doc_id long, stratum string, base_failed boolean, score double")
    labels = spark.createDataFrame([(i, 1, "x") for i in range(600)] + [(1000 + i, 1, "x") for i in range(20)] + [(2002, 0, "x"), (None, 1, "x"), (3, None, "x"), (2002, 1, "x")], "doc_id long, quality int, stratum string")
    cutoffs = {r["stratum"]: r["cutoff"] for r in quality.calibrate(marked, labels, alpha=0.05).collect()}
    # the bound ends the sequence: below 0.5 all would go
    assert cutoffs == {"en": 0.5, "de": None}
    assert {r["stratum"]: r["cutoff"] for r in quality.calibrate(marked, labels).collect()} == {"en": 11.0, "de": None}
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(marked, labels, alpha=0.05).collect()}
    assert kept[1] and not kept[50] and kept[1000] and kept[2000] and not kept[2001] and not kept[2002]
    strict = {r["stratum"]: r["cutoff"] for r in quality.calibrate(marked, labels, alpha=0.015).collect()}
    assert strict["en"] is None or strict["en"] >= 9.0
    assert quality.judge(quality.scored(none), labels).count() == 0 and quality.judge(quality.scored(docs), labels.limit(0)).count() == docs.count()
    passed = quality.passing(docs, labels)
    assert passed.columns == docs.columns and 0 < passed.count() < docs.count()


def water(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark, docs, none, rows):
    found = mixing.plan(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += brute_quality(r[1] or "")[0]
    targets = water(dict(sizes))
    assert len(found) == len(rows) and {round(r["target"], 6) for r in found} == {round(t, 6) for t in targets.values()}
    assert all(0 <= r["copies"] <= 3 for r in found)
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.plan(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)
    many = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', 1 + int(id % 40)) AS text", "if(id % 3 = 0, 'big', concat('s', id % 7)) AS source")
    by = mixing.plan(many).join(many.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(by) == 8
    assert all(abs(r["taken"] / r["target"] - 1) < 0.05 for r in by)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0 and mixing.plan(docs.where("doc_id < 3")).count() == 3


def shingles(text):
    import re

    w = re.findall(c.WORD, text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_order_minhash(docs, none, rows):
    found = orderhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] not in (None, 5)}
    assert by[6] == by[7] == 5 and by[8] == 8 and by[0] == by[1] == 0 and by[10] == 10 and by[3] == 3
    kept = orderhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(10) == 1 and 6 not in ids and 7 not in ids and 8 in ids
    assert orderhash.near_duplicates(none).count() == 0 and orderhash.one_of_each(none).count() == 0


def test_alignment():
    a = orderhash.labelled(" ".join(f"w{i}" for i in range(400)).encode())
    assert orderhash.similarity(a, a) == 1.0 and orderhash.similarity(a, a[:0]) == 0.0
    edited = orderhash.labelled(" ".join(f"w{i}" if i != 200 else "x" for i in range(400)).encode())
    assert orderhash.similarity(a, edited) == pytest.approx(391 / 401)
    swapped = orderhash.labelled(" ".join(f"w{(i + 200) % 400}" for i in range(400)).encode())
    assert orderhash.similarity(a, swapped) < 0.8
    assert len(set(orderhash.labelled(b"a " * 50).tolist())) == 46


def test_refinement_links_what_hubs_miss(spark):
    """A chain of edits whose ends are unlike each other is one class, whichever member is a hub."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for step in range(8):
        text = list(words)
        for j in range(3 * step):
            text[(37 * j) % 300] = f"e{j}"
        rows.append((step, " ".join(text)))
    rows.append((100, " ".join(f"z{i}" for i in range(300))))
    found = {r["doc_id"]: r["class_id"] for r in orderhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i] for i in range(8)} == {0} and found[100] == 100


def brute_classes(rows):
    """Least id of each text's class, from all pairs by the operator's own measure."""
    kmers = {i: orderhash.labelled(t.encode()) for i, t in rows}
    sets = {i: frozenset(k.tolist()) for i, k in kmers.items()}
    root = {i: i for i in kmers}
    ids = sorted(kmers)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            need = orderhash.SIMILARITY * (len(sets[i]) + len(sets[j])) / (1 + orderhash.SIMILARITY)
            if root[i] != root[j] and len(sets[i] & sets[j]) >= need - 1e-9 and orderhash.similarity(kmers[i], kmers[j]) >= orderhash.SIMILARITY:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def edited(pick, words, share, tag):
    """words with new ones in about this share of the five-word shingles."""
    out = list(words)
    for j in range(max(1, round(share * len(words) / 5))):
        out[pick.randrange(len(out))] = f"{tag}e{j}"
    return out


def hold_against_brute_force(spark, rows):
    found = {r["doc_id"]: r["class_id"] for r in orderhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    expected = brute_classes(rows)
    assert 1 < len(set(expected.values())) < len(rows)
    assert found == expected


def test_drift_equals_brute_force(spark):
    """Copies of random earlier copies of two texts: large buckets that are no star around one text."""
    pick = random.Random(11)
    texts = [[f"{name}{i}" for i in range(204)] for name in "wz"]
    for i in range(2, 800):
        texts.append(edited(pick, pick.choice(texts), 0.1, f"d{i}"))
    hold_against_brute_force(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])


def test_template_family_equals_brute_force(spark):
    """Documents of one template below the threshold, some with a near copy: large buckets that hubs do not link."""
    pick = random.Random(12)
    rows, base = [], [f"w{i}" for i in range(204)]
    for i in range(1200):
        own = edited(pick, base, 0.2, f"t{i}")
        rows.append((len(rows), " ".join(own)))
        if i % 2 == 0:
            rows.append((len(rows), " ".join(edited(pick, own, 0.1, f"c{i}"))))
    hold_against_brute_force(spark, rows)


def test_bridged_communities_equal_brute_force(spark):
    """Two communities of near copies, and one text that is alike to one member of each only."""
    pick, rows = random.Random(14), []
    for g in range(3):
        first = [f"g{g}w{i}" for i in range(204)]
        second = [w if i < 150 else f"g{g}z{i}" for i, w in enumerate(first)]
        bridge = [w if i < 177 else f"g{g}z{i}" for i, w in enumerate(first)]
        for base in (first, second):
            rows += [(len(rows) + k, " ".join(edited(pick, base, 0.08, f"g{g}k{len(rows)}x{k}"))) for k in range(30)]
        rows.append((len(rows), " ".join(bridge)))
    hold_against_brute_force(spark, rows)


def test_one_of_each_leaves_no_pair_at_the_threshold(spark):
    """A star around one text and a drift, as near_dedup of the pipeline sees them: 0.8 by the operator's own measure."""
    pick = random.Random(13)
    star, drift = [f"s{i}" for i in range(204)], [[f"w{i}" for i in range(204)]]
    for i in range(1, 400):
        drift.append(edited(pick, pick.choice(drift), 0.1, f"d{i}"))
    texts = [star, *(edited(pick, star, 0.1, f"c{i}") for i in range(300)), *drift]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    left = [tuple(r) for r in orderhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {r[0] for r in left} == set(brute_classes(rows).values())
    kmers = [orderhash.labelled(t.encode()) for _, t in left]
    assert all(orderhash.similarity(a, b) < orderhash.SIMILARITY for i, a in enumerate(kmers) for b in kmers[:i])


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(50, 51), (52, 51), (60, 60)] + [(100, i) for i in range(101, 130)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and found[52] == 50 and found[129] == 100 and 60 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_severity(spark, docs, none):
    rows = [(i, f"plain words number {i % 17} here" + (" you idiot!" * (1 + i % 3) if i % 5 == 0 else "")) for i in range(300)]
    talks = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), "x") for i in range(0, 200)] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    model = severity.fit(talks, labels)
    assert "idiot" in model.weights and list(model.thresholds) == sorted(model.thresholds)
    found = {r["doc_id"]: r for r in severity.predict(talks, model).collect()}
    held = range(200, 300)
    assert all(found[i]["toxic"] == (i % 5 == 0) for i in held)
    mean = [sum(found[i]["severity"] for i in held if i % 5 == 0 and i % 3 == k) for k in range(3)]
    assert mean[0] / 7 < mean[2] / 6 and all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in found.values())
    assert severity.predict(docs, model).count() == docs.count() and severity.predict(none, model).count() == 0
    empty = severity.fit(none, labels)
    assert not empty.weights and not severity.predict(talks, empty).where("toxic OR severity > 0").count()


def test_severity_of_given_grades(spark):
    """Labels beyond 1 are the grades; one row an id is trained on, however often it comes."""
    marks = ["", " rude", " rude rude vile", " rude vile vile vile foul foul"]
    talks = spark.createDataFrame([(i, f"plain words number {i % 17} here" + marks[i % 4]) for i in range(400)] + [(4, "plain again")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4) for i in range(300)], "doc_id long, toxic int")
    found = severity.predict(talks.where("doc_id >= 300"), severity.fit(talks, labels)).collect()
    assert sum(r["grade"] == r["doc_id"] % 4 for r in found) >= 0.95 * len(found)


def test_ordinal_thresholds_by_shares():
    import numpy as np

    pick = np.random.default_rng(5)
    x = pick.normal(size=2000)
    toxic = x + pick.logistic(size=2000) > 1
    weights, t = severity.fit_ordinal(np.arange(2000), np.zeros(2000, dtype=int), x, toxic.astype(int), np.where(toxic, 3, 0), 1)
    above = [float((1 / (1 + np.exp(k - x[toxic] * weights[0]))).mean()) for k in t]
    assert weights[0] == pytest.approx(1.0, abs=0.25) and t[0] == pytest.approx(1.0, abs=0.25) and list(t) == sorted(t)
    # the shares hold as far as as many lie above the first threshold
    assert above[1] == pytest.approx(min(2 / 3, 0.999 * above[0]), abs=1e-6) and above[2] == pytest.approx(1 / 3, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_match_sql(spark):
    import duckdb

    from phylospark.llm import queries
    from tests.test_queries import same

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, SF).toPandas(), con.execute(sql).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline
    from tests.llm.test_texts import brute_cut

    docs = c.table(spark, SF, "documents")
    columns = docs.columns
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = [tuple(r) for r in docs.collect()]
        docs = c.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns or name == "byte_bpe"
    judged = quality.judge(c.stored(quality.scored(c.table(spark, SF, "documents")), "scored"), c.table(spark, SF, "labels"))
    kept = {r["doc_id"] for r in judged.where("kept").collect()}
    assert {r[0] for r in before["near_dedup"]} == kept
    left = {r[0]: shingles(r[1]) for r in before["substring_dedup"]}
    for i in left:
        for j in left:
            if i < j and len(left[i]) and 0.7 < len(left[i]) / max(1, len(left[j])) < 1.5:
                both = sum((left[i] & left[j]).values())
                assert both / (sum((left[i] | left[j]).values()) or 1) < 0.85, (i, j)
    cut = brute_cut(before["substring_dedup"], 35)
    texts = {r[0]: r[1] for r in before["substring_dedup"]}
    expected = Counter((doc_id, kept if removed else texts[doc_id]) for doc_id, _, removed, kept in cut.elements())
    assert Counter((r[0], r[1]) for r in before["source_mixing"]) == expected
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, docs.collect()))
    assert all(r["decoded_sha256"] in {hashlib.sha256(x[1].encode()).hexdigest() for x in before["byte_bpe"]} for r in docs.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("empty", [True, False])
def test_stages_of_odd_tables(spark, docs, none, empty):
    """Nulls, repeated rows and columns named as the operators' own pass through every stage; no rows give none."""
    import corpus_pipeline

    table = at = none if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        at = c.stored(stage(spark, at, SF), name)
        assert at.dtypes == table.dtypes or name == "byte_bpe"
        assert (at.count() == 0) == empty
