"""Small trees and tables against dense brute force, edge cases, and argument checks."""

import math

import numpy as np
import pytest

import phylospark as ps
from phylospark import api
from phylospark.operators import diversity, ordination, stripes
from phylospark.sources import newick, store, tables

TREE = "(((kelp:0.7,(moss:0.3,fern:1.1)green:0.4)shore:0.9,moor:0.35):0.15,((oak:1.3,elm:0.2)wood:0.6,reed:0.8):0.5)root;"
#: The tree's branches: length, and the tips below.
BRANCHES = [(0.15, "kelp moss fern moor"), (0.9, "kelp moss fern"), (0.7, "kelp"), (0.4, "moss fern"), (0.3, "moss"), (1.1, "fern"), (0.35, "moor"), (0.5, "oak elm reed"), (0.6, "oak elm"), (1.3, "oak"), (0.2, "elm"), (0.8, "reed")]
TIPS = "kelp moss fern moor oak elm reed".split()
COUNTS = {"bay": [4, 0, 2, 0, 0, 1, 0], "cliff": [0, 3, 3, 1, 0, 0, 0], "dune": [0, 0, 0, 5, 0, 0, 2], "fen": [1, 1, 1, 1, 1, 1, 1], "gorge": [0, 0, 0, 0, 7, 2, 0], "heath": [0, 0, 0, 0, 0, 0, 0], "isle": [9, 0, 0, 0, 0, 0, 0], "knoll": [0, 2, 0, 0, 0, 6, 3]}
FAMILIES = ("unweighted", "unweighted_unnormalized", "weighted_normalized", "weighted_unnormalized", "generalized")


def dense(family, a, b, alpha=1.0, adjusted=False, bypass=False):
    """The distance of two count vectors, branch by branch."""
    ta, tb, top, bottom = sum(a), sum(b), 0.0, 0.0
    for length, below in BRANCHES:
        at = [TIPS.index(t) for t in below.split()]
        if bypass and len(at) == 1:
            continue
        ca, cb = sum(a[i] for i in at), sum(b[i] for i in at)
        if not ca + cb:
            continue
        weight = length
        if adjusted:
            m, total = ca + cb, ta + tb
            weight = length / math.sqrt(m * (total - m)) if m < total else 0.0
        if family.startswith("unweighted"):
            top += weight * ((ca > 0) != (cb > 0))
            bottom += weight
        else:
            x, y = ca / ta if ta else 0.0, cb / tb if tb else 0.0
            power = alpha if family == "generalized" else 1.0
            top += weight * (x + y) ** (power - 1.0) * abs(x - y)
            bottom += weight * (x + y) ** power
    return top if family.endswith("unnormalized") else top / bottom if bottom else 0.0


def matrix(family, **more):
    rows = list(COUNTS.values())
    return [dense(family, rows[i], rows[j], **more) for i in range(len(rows)) for j in range(i + 1, len(rows))]


@pytest.fixture(scope="module")
def study(spark):
    table = tables.table_from_matrix(spark, COUNTS.values(), list(COUNTS), TIPS)
    return table, newick.closure(newick.node_table(spark, TREE))


def values(rows):
    return [r["distance"] for r in rows.orderBy("ord_i", "ord_j").collect()]


@pytest.mark.parametrize("more", [{}, {"variance_adjusted": True}, {"bypass_tips": True}, {"n_substeps": 9, "variance_adjusted": True}])
@pytest.mark.parametrize("family, alpha", [*((f, 1.0) for f in FAMILIES[:4]), ("generalized", 0.0), ("generalized", 0.5)])
def test_distances(study, family, alpha, more):
    table, closure = study
    expected = matrix(family, alpha=alpha, adjusted="variance_adjusted" in more, bypass="bypass_tips" in more)
    np.testing.assert_allclose(values(diversity.beta(table.abundance, closure, table.samples, f"{family}_fp64", alpha, **more)), expected, atol=1e-9)


def test_sparse_arrays(spark, study):
    rows = np.array(list(COUNTS.values()), dtype=float)
    starts = np.concatenate([[0], np.cumsum((rows != 0).sum(axis=1))])
    table = tables.table_from_sparse(spark, list(COUNTS), TIPS, starts, np.nonzero(rows)[1], rows[rows != 0])
    assert sorted(map(tuple, table.abundance.collect())) == sorted(map(tuple, study[0].abundance.collect()))
    assert table.samples.count() == len(COUNTS) and table.features.count() == len(TIPS)


def test_many_tiles_and_batches(spark, study, monkeypatch):
    """More samples than a tile holds, and batches that end inside branches."""
    pick = np.random.default_rng(3)
    counts = pick.integers(0, 9, (30, 7)) * pick.integers(0, 2, (30, 7))
    table = tables.table_from_matrix(spark, counts.tolist(), [f"s{i:02}" for i in range(30)], TIPS)
    monkeypatch.setattr(diversity, "TILE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for family, adjusted in (("weighted_normalized", False), ("unweighted", True)):
            found = values(diversity.beta(table.abundance, study[1], table.samples, f"{family}_fp64", variance_adjusted=adjusted))
            expected = [dense(family, counts[i].tolist(), counts[j].tolist(), adjusted=adjusted) for i in range(30) for j in range(i + 1, 30)]
            np.testing.assert_allclose(found, expected, atol=1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_unobserved_tips_change_nothing(spark, study):
    table, closure = study
    other = newick.closure(newick.node_table(spark, TREE.replace("reed:0.8", "(reed:0.55,(rush:2,sedge:1):3):0.25")))
    assert values(diversity.beta(table.abundance, other, table.samples, "unweighted_fp64")) == pytest.approx(matrix("unweighted"), abs=1e-12)


def test_faith(spark, study):
    table, closure = study
    found = {r["sample_id"]: r["faith_pd"] for r in diversity.faith(table.abundance, closure, table.samples).collect()}
    assert found == pytest.approx({s: dense("unweighted_unnormalized", row, [0] * 7) for s, row in COUNTS.items()})
    empty = tables.table_from_matrix(spark, [[0, 0, 0], [1, 1, 0]], ["x", "y"], ["p", "q", "r"])
    nolength = newick.closure(newick.node_table(spark, "((p:0.25,q:0.5),(r:1.0,s));"))
    assert {r["sample_id"]: r["faith_pd"] for r in api.raw_faith_pd(empty, nolength).collect()} == {"x": 0.0, "y": 0.75}


def test_dense_pairs(spark):
    tree, a, b = newick.node_table(spark, TREE), COUNTS["bay"], COUNTS["knoll"]
    for family in FAMILIES[:4]:
        assert getattr(ps, f"{family}_dense_pair")(TIPS, a, b, tree) == pytest.approx(dense(family, a, b))
    assert ps.generalized_dense_pair(TIPS, a, b, tree, alpha=0.3) == pytest.approx(dense("generalized", a, b, alpha=0.3))
    assert ps.unweighted_dense_pair(TIPS, a, [0] * 7, tree) == 1.0
    assert ps.unweighted_dense_pair(TIPS, [0] * 7, [0] * 7, tree) == 0.0
    with pytest.raises(ValueError):
        ps.unweighted_dense_pair(TIPS[:2], [1], [0, 0], tree)
    with pytest.raises(ValueError, match="Empty ID"):
        ps.unweighted_dense_pair(["", "moss"], [1, 0], [0, 0], tree)


def test_meta(spark, study):
    """Two tables over different samples and trees, weighed 1 to 3."""
    table, closure = study
    few = {"bay": [1, 0], "cliff": [1, 1], "extra": [0, 2]}
    second = tables.table_from_matrix(spark, few.values(), list(few), ["u", "v"])
    tree = newick.closure(newick.node_table(spark, "(u:1,v:3);"))
    found = {(r["sample_i"], r["sample_j"]): r["distance"] for r in ps.meta([table, second], [closure, tree], method="unweighted_fp64", weights=(1, 3), consolidation="skipping-missing-values").collect()}
    names = sorted({*COUNTS, *few})
    assert set(found) == {(a, b) for a in names for b in names if a < b}
    first = dict(zip([(a, b) for i, a in enumerate(COUNTS) for b in list(COUNTS)[i + 1 :]], matrix("unweighted"), strict=True))
    assert found["bay", "cliff"] == pytest.approx((first["bay", "cliff"] + 3 * 0.75) / 4)
    assert found["cliff", "extra"] == pytest.approx(0.25) and found["dune", "fen"] == pytest.approx(first["dune", "fen"]) and found["dune", "extra"] is None


@pytest.mark.parametrize(
    "args, text",
    [
        (((), ()), "No tables"),
        ((("a",), ()), "No trees"),
        ((("a",), ("b", "c")), "Number of trees"),
    ],
)
def test_meta_arguments(args, text):
    with pytest.raises(ValueError, match=text):
        ps.meta(*args, method="unweighted")


def test_meta_names():
    with pytest.raises(ValueError, match="weights"):
        ps.meta(("a",), ("b",), weights=(1, 2), method="unweighted")
    with pytest.raises(ValueError, match="No method"):
        ps.meta(("a",), ("b",))
    with pytest.raises(ValueError, match=r"Method \(bar\)"):
        ps.meta(("a",), ("b",), method="bar")
    with pytest.raises(ValueError, match=r"Consolidation \(foo\)"):
        ps.meta(("a",), ("b",), method="unweighted", consolidation="foo")
    with pytest.raises(ValueError, match="alpha"):
        ps.meta(("a",), ("b",), method="generalized_fp64", alpha=0.5)


def test_newick():
    nodes = newick.parse("(('a b;c[x]':1e-1,(b_1:2)in)'it''s':3,d)r;")
    assert [(n.name, n.length, n.parent_id) for n in nodes] == [("r", 0.0, None), ("it's", 3.0, 0), ("a b;c[x]", 0.1, 1), ("in", 0.0, 1), ("b_1", 2.0, 3), ("d", 0.0, 0)]
    assert nodes[0].subtree_end == 5 and nodes[4].ancestors == [1, 3, 4]
    assert newick.is_newick("(a,b);") and newick.is_newick("[c] (a , b) ;")
    for bad in ("(a,b)", "(a,b));", "a b;", "((a,b);", "(a:x,b);", "", "(a,b); c"):
        assert not newick.is_newick(bad), bad
    assert len(newick.parse("(" * 5000 + "a" + ")" * 5000 + ";")) == 5001


def test_validation(spark, tmp_path):
    tree, path = tmp_path / "t.nwk", str(tmp_path / "t.tsv")
    tree.write_text(TREE)
    with pytest.raises(OSError, match="Table file not found"):
        ps.unweighted("/no/such", str(tree))
    with pytest.raises(ValueError, match="incompatible"):
        ps.unweighted(path, 3)

    def write(text):
        with open(path, "w") as f:
            f.write(text)

    write("#id\tA\tB\nkelp\t1\t0\nmoss\t0\t2\n")
    with pytest.raises(OSError, match="Tree file not found"):
        ps.unweighted(path, "/no/such")
    with pytest.raises(ValueError, match="Unknown method"):
        ps.one_off(path, str(tree), "nothing")
    assert ps.unweighted(path, str(tree)).count() == 1
    write("#id\tA\nkelp\t1\n")
    with pytest.raises(ValueError, match="two samples"):
        ps.faith_pd(path, str(tree))
    write("#id\tA\tB\nkelp\t-1\t3\n")
    with pytest.raises(ValueError, match="negatives"):
        ps.unweighted(path, str(tree))
    write("#id\tA\tB\nnowhere\t0\t0\n")
    with pytest.raises(ValueError, match="completely represented"):
        ps.unweighted(path, str(tree))
    tree.write_text("(a,b")
    write("#id\tA\tB\nkelp\t1\t3\n")
    with pytest.raises(ValueError, match="newick"):
        ps.unweighted(path, str(tree))
    with pytest.raises(ValueError, match="any samples"):
        ps.unweighted(spark.createDataFrame([], "sample_id string, feature_id string, count double"), newick.node_table(spark, TREE))


def test_generalized_of_one_is_weighted(spark, study):
    with pytest.warns(UserWarning, match="alpha of 1.0"):
        rows = ps.generalized_fp64(study[0], study[1], alpha=1.0)
    assert values(rows) == pytest.approx(matrix("weighted_normalized"), abs=1e-9)


def test_ordination(study):
    table, closure = study
    distance = diversity.beta(table.abundance, closure, table.samples, "unweighted_fp64")
    n = len(COUNTS)
    square, centre = np.zeros((n, n)), np.eye(n) - 1 / n
    square[np.triu_indices(n, 1)] = np.square(matrix("unweighted"))
    gram = -0.5 * centre @ (square + square.T) @ centre
    expected = np.sort(np.linalg.eigvalsh(gram))[::-1]
    axes, coords = ordination.pcoa(distance, n)
    np.testing.assert_allclose([r["eigval"] for r in axes.orderBy("axis").collect()], expected, atol=1e-9)
    assert coords.count() == n * n
    approximate, _ = ordination.pcoa(distance, 2, exact=False)
    np.testing.assert_allclose([r["eigval"] for r in approximate.orderBy("axis").collect()], expected[:2], atol=1e-7)


def pseudo_f(groups):
    n, names = len(COUNTS), sorted(set(groups))
    at = [(i, j) for i in range(n) for j in range(i + 1, n)]
    squares = dict(zip(at, np.square(matrix("unweighted")), strict=True))
    within = sum(q / groups.count(groups[i]) for (i, j), q in squares.items() if groups[i] == groups[j])
    return (sum(squares.values()) / n - within) / (len(names) - 1) / (within / (n - len(names)))


def test_permanova(spark, study, monkeypatch):
    table, closure = study
    distance = diversity.beta(table.abundance, closure, table.samples, "unweighted_fp64")
    groups = ["g" + "01101100"[i] for i in range(len(COUNTS))]
    rows = spark.createDataFrame(list(zip(COUNTS, groups, ["x"] * 8, COUNTS, strict=True)), "sample_id string, g string, one string, each string")
    found = ordination.permanova(distance, rows, ["g"], 199).first()
    assert found["statistic"] == pytest.approx(pseudo_f(groups)) and found["sample_size"] == 8 and found["n_groups"] == 2
    assert 0.0 < found["p_value"] <= 1.0
    monkeypatch.setattr(ordination, "BROADCAST", 4 * 8 * 60)  # four rounds of 60 permutations or less
    again = ordination.permanova(distance, rows, ["g"], 199).first()
    assert again["p_value"] == found["p_value"] and again["statistic"] == pytest.approx(found["statistic"])


def test_permanova_without_spread(spark, study):
    table, closure = study
    distance = diversity.beta(table.abundance, closure, table.samples, "unweighted_fp64")
    rows = spark.createDataFrame([(s, "x", s) for s in COUNTS], "sample_id string, one string, each string")
    for column in ("one", "each"):
        with pytest.raises(ValueError, match="two groups are needed"):
            ordination.permanova(distance, rows, [column], 9)
    names = list("abcd")
    groups = spark.createDataFrame([(s, "p" if s in "ab" else "q") for s in names], "sample_id string, g string")
    for apart, expected in ((1.0, float("inf")), (0.0, None)):
        made = [(0, a, b, 0.0 if (a in "ab") == (b in "ab") else apart) for i, a in enumerate(names) for b in names[i + 1 :]]
        found = ordination.permanova(spark.createDataFrame(made, "rep int, sample_i string, sample_j string, distance double"), groups, ["g"], 9).first()
        assert found["statistic"] == expected and (found["p_value"] is None) == (expected is None)


def test_store(spark, study, tmp_path):
    path, groups = str(tmp_path / "out"), tmp_path / "groups.tsv"
    groups.write_text("#SampleID\tg\th\n" + "".join(f"{s}\t{i % 2}\t{i // 3}\n" for i, s in enumerate(COUNTS)))
    with pytest.raises(OSError, match="PERMANOVA groupping"):
        ps.unweighted_to_file(*study, path, permanova_perms=9, grouping_filename="/no/such", grouping_columns="g")
    with pytest.raises(ValueError, match="subsample_depth"):
        ps.unweighted_to_file(*study, path, n_subsamples=2)
    assert ps.weighted_normalized_fp64_to_file(*study, path, pcoa_dims=2, permanova_perms=9, grouping_filename=str(groups), grouping_columns="g,h") == path
    assert values(ps.read_distance(path)) == pytest.approx(matrix("weighted_normalized"), abs=1e-9)
    every = ps.read_distance_all(path)
    assert len(every) == 1 and every[0].shape == (8, 8) and [m.shape for m in every] == [(8, 8)]
    every.close()
    assert len(every) == 0
    assert list(ps.read_pcoa(path)["eigvals"].index) == ["PC1", "PC2"]
    assert set(ps.read_permanova_dict(path)) == {"g", "h"} and ps.read_permanova(path)["sample size"] == 8
    several = str(tmp_path / "several")
    ps.unweighted_to_file(*study, several, pcoa_dims=2, n_subsamples=2, subsample_depth=5)
    assert len(ps.read_pcoa_all(several)) == 2
    with pytest.raises(KeyError):
        ps.read_distance(several)
    with pytest.raises(OSError):
        ps.read_distance(str(tmp_path / "none"))


def test_subsamples(study):
    table, _ = study
    for replacement in (True, False):
        drawn = diversity.subsample(table.abundance, 5, 3, replacement=replacement)
        sums = {(r["rep"], r["sample_id"]): r["n"] for r in drawn.groupBy("rep", "sample_id").agg({"count": "sum"}).withColumnRenamed("sum(count)", "n").collect()}
        assert set(sums.values()) == {5.0} and {s for _, s in sums} == {s for s, row in COUNTS.items() if sum(row) >= 5}
        if not replacement:
            whole = {(r["sample_id"], r["feature_id"]): r["count"] for r in table.abundance.collect()}
            assert all(r["count"] <= whole[r["sample_id"], r["feature_id"]] for r in drawn.collect())


def test_subsamples_whatever_the_bound(study, monkeypatch):
    """If too few hashes lie below the bound, the rest are ordered, too."""
    expected = sorted(map(tuple, diversity.subsample(study[0].abundance, 5, 3, replacement=False).collect()))
    monkeypatch.setattr(diversity.math, "sqrt", lambda x: -2.4)
    assert sorted(map(tuple, diversity.subsample(study[0].abundance, 5, 3, replacement=False).collect())) == expected


def test_stripes(study, monkeypatch):
    table, closure = study
    for n in (2, 5, 6, 7):
        stripe = [min(j - i, n - (j - i)) - 1 for i in range(n) for j in range(i + 1, n)]
        assert set(stripe) == set(range(stripes.count(n)))
    parts = [stripes.partial(table.abundance, closure, table.samples, a, b, "unweighted_fp64") for a, b in stripes.report(8, 3)]
    assert values(stripes.merge(parts, 8)) == pytest.approx(matrix("unweighted"), abs=1e-9)
    with pytest.raises(ValueError):
        stripes.merge(parts[:1], 8)
    with pytest.raises(ValueError):
        stripes.merge([*parts, parts[0]], 8)
    monkeypatch.setattr(diversity, "TILE", 2)
    for a, b in stripes.report(8, 3):
        few = stripes.partial(table.abundance, closure, table.samples, a, b, "unweighted_fp64").collect()
        assert len(few) == 8 * (b - a) - (4 if b == 4 else 0)
        assert all(r["distance"] == pytest.approx(dense("unweighted", COUNTS[r["sample_i"]], COUNTS[r["sample_j"]])) for r in few)


def test_command_line(tmp_path, study):
    from phylospark.__main__ import main

    tree, table = tmp_path / "t.nwk", tmp_path / "t.tsv"
    tree.write_text(TREE)
    table.write_text("#id\t" + "\t".join(COUNTS) + "\n" + "".join("\t".join([o, *(str(COUNTS[s][i]) for s in COUNTS)]) + "\n" for i, o in enumerate(TIPS)))
    assert main(["faith", "-i", str(table), "-t", str(tree), "-o", str(tmp_path / "f.tsv")]) == 0
    assert (tmp_path / "f.tsv").read_text().splitlines()[0].split("\t")[0] == "bay"
    assert main(["beta", "-i", str(table), "-t", str(tree), "-o", str(tmp_path / "d.tsv"), "-m", "unweighted_fp64"]) == 0
    lines = [x.split("\t") for x in (tmp_path / "d.tsv").read_text().splitlines()]
    assert lines[0][1:] == list(COUNTS) and float(lines[1][2]) == pytest.approx(matrix("unweighted")[0])


def test_dense_matrix(study):
    table, closure = study
    square = store.dense(diversity.beta(table.abundance, closure, table.samples, "unweighted"), 8)
    assert square.dtype == np.float32 and (square == square.T).all() and (np.diag(square) == 0).all()
