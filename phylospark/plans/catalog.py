"""Registered queries of the diversity engine, with DuckDB SQL that computes the same in another way: the plans use
sparse edge joins and per-sample sums, the SQL meets every pair with every edge. Values are rounded to six places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark import api
from phylospark.operators import consolidate, diversity, ordination, stripes
from phylospark.plans import model
from phylospark.session import materialized, scratch
from phylospark.sources import newick, store

ROUND = 6
FAMILIES = ("unweighted", "unweighted_unnormalized", "weighted_normalized", "weighted_unnormalized")
#: Half of the nations each, so that both tables of `meta` lack samples the other has.
FIRST, SECOND = "n < 18", "n > 4"
DEPTH, REPS, SEED, PERMUTATIONS = 50, 3, 42, 49
AXES = 10


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(F.col(n).cast("double"), ROUND) for n in names})


def _pairs(rows: DataFrame, rep: bool = False) -> DataFrame:
    return _rounded(rows.select(*(["rep"] if rep else []), "sample_i", "sample_j", "distance"), "distance")


def _beta(method: str, alpha: float = 1.0, adjusted: bool = False, bypass: bool = False):
    def query(spark, sf_dir):
        t = model.study(spark, sf_dir)
        return _pairs(diversity.beta(t.abundance, model.tree(spark, sf_dir), t.samples, method, alpha, adjusted, bypass))

    return query


def _beta_sql(family: str, alpha: float = 1.0, adjusted: bool = False, bypass: bool = False, single: bool = False) -> str:
    value = "distance::FLOAT::DOUBLE" if single else "distance"
    return f"WITH {model.TREE_SQL}, {model.study_sql()}, {model.beta_sql(family, alpha, adjusted, bypass)} SELECT sample_i, sample_j, round({value}, 6) AS distance FROM dist"


def _wide(spark, sf_dir):
    """All 125 nation-segments, weighted: the bench's largest pair join."""
    t = model.study(spark, sf_dir, segments=True)
    return _pairs(diversity.beta(t.abundance, model.tree(spark, sf_dir), t.samples, "weighted_normalized_fp64"))


def _faith(spark, sf_dir):
    t = model.study(spark, sf_dir, segments=True)
    return _rounded(diversity.faith(t.abundance, model.tree(spark, sf_dir), t.samples).select("sample_id", "faith_pd"), "faith_pd")


def _node_counts(spark, sf_dir):
    t = model.study(spark, sf_dir)
    return diversity.node_counts(t.abundance, model.tree(spark, sf_dir)).select("sample_id", "node_id", "length", "is_tip", "c")


def _totals(spark, sf_dir):
    return diversity.totals(model.study(spark, sf_dir, segments=True).abundance).select("sample_id", "total")


def _validate(spark, sf_dir):
    """One row of what validation looks at."""
    t = model.study(spark, sf_dir, segments=True)
    tips = model.tree(spark, sf_dir).where("is_tip").select("feature_id").distinct()
    facts = t.abundance.agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("feature_id").alias("n_features"), F.count(F.lit(1)).alias("n_counts"), F.sum((F.col("count") < 0).cast("long")).alias("n_negative"))
    missing = t.features.join(tips, "feature_id", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    return facts.join(missing)


def _dense_pair(family: str, alpha: float = 1.0):
    def query(spark, sf_dir):
        t = model.study(spark, sf_dir, keep="n IN (3, 17)")
        return _pairs(diversity.beta(t.abundance, model.tree(spark, sf_dir), t.samples, f"{family}_fp64", alpha))

    return query


def _dense_pair_sql(family: str, alpha: float = 1.0) -> str:
    return f"WITH {model.TREE_SQL}, {model.study_sql(keep='n IN (3, 17)')}, {model.beta_sql(family, alpha)} SELECT sample_i, sample_j, round(distance, 6) AS distance FROM dist"


def _meta(how: str):
    def query(spark, sf_dir):
        # for whole matrices the second table has every nation, or none would be complete
        keep = (FIRST, None if how == "skipping_missing_matrices" else SECOND)
        tables = [model.study(spark, sf_dir, keep=k) for k in keep]
        trees = [model.tree(spark, sf_dir), model.tree(spark, sf_dir, second=True)]
        found = [diversity.beta(t.abundance, c, t.samples, "unweighted_fp64") for t, c in zip(tables, trees, strict=True)]
        return _pairs(consolidate.consolidate(found, [t.samples for t in tables], [1.0, 2.0], how))

    return query


def _meta_sql(how: str) -> str:
    whole = how == "skipping_missing_matrices"
    value = {
        "missing_zero": "coalesce(sum(w * distance), 0)",
        "missing_one": "coalesce(sum(w * distance), 0) + 1 - coalesce(sum(w), 0)",
    }.get(how, "sum(w * distance) / sum(w)")
    return f"""WITH {model.TREE_SQL}, {model.TREE2_SQL}, {model.study_sql(keep=FIRST, suffix="_a")}, {model.study_sql(keep=None if whole else SECOND, suffix="_b")},
{model.beta_sql("unweighted", suffix="_a", name="dist_a")}, {model.beta_sql("unweighted", suffix="_b", closure="closure2", name="dist_b")},
tagged AS ({"" if whole else "SELECT sample_i, sample_j, distance, 1 / 3.0::DOUBLE AS w FROM dist_a UNION ALL "}SELECT sample_i, sample_j, distance, 2 / 3.0::DOUBLE FROM dist_b),
every AS (SELECT sample_id FROM samples_a UNION SELECT sample_id FROM samples_b),
named AS (SELECT * FROM tagged AS t(sample_i, sample_j, distance, w))
SELECT a.sample_id AS sample_i, b.sample_id AS sample_j, round({value}, 6) AS distance FROM every a JOIN every b ON a.sample_id < b.sample_id LEFT JOIN named ON sample_i = a.sample_id AND sample_j = b.sample_id GROUP BY ALL"""


def _draw(spark, sf_dir, replacement: bool, reps: int):
    return diversity.subsample(model.study(spark, sf_dir).abundance, DEPTH, reps, SEED, replacement)


def _draw_sql(replacement: bool, reps: int = REPS) -> str:
    whole = f"whole AS (SELECT sample_id, sum(count)::BIGINT AS total FROM abundance GROUP BY 1 HAVING sum(count) >= {DEPTH}), reps AS (SELECT unnest(range({reps}))::INT AS rep)"
    hashed = "('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 12))::BIGINT"
    if replacement:
        u = hashed.format(seed=SEED, parts="rep, sample_id, k")
        drawn = f"""stretches AS (SELECT sample_id, feature_id, coalesce(sum(count) OVER (PARTITION BY sample_id ORDER BY feature_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, count FROM abundance),
draws AS (SELECT rep, sample_id, {u} % total AS spot FROM whole, reps, (SELECT unnest(range({DEPTH})) AS k)),
drawn AS (SELECT rep, d.sample_id, feature_id, count(*)::DOUBLE AS count FROM draws d JOIN stretches s ON d.sample_id = s.sample_id AND spot >= lo AND spot < lo + s.count GROUP BY ALL)"""
    else:
        u = hashed.format(seed=SEED, parts="rep, sample_id, feature_id, k")
        drawn = f"""placed AS (SELECT rep, sample_id, feature_id, row_number() OVER (PARTITION BY rep, sample_id ORDER BY {u}, feature_id, k) AS place
  FROM (SELECT sample_id, feature_id, unnest(range(1, count::INT + 1)) AS k FROM abundance JOIN whole USING (sample_id)), reps),
drawn AS (SELECT rep, sample_id, feature_id, count(*)::DOUBLE AS count FROM placed WHERE place <= {DEPTH} GROUP BY ALL)"""
    return f"WITH {model.TREE_SQL}, {model.study_sql()}, {whole}, {drawn}"


def _subsample(replacement: bool):
    return lambda spark, sf_dir: _draw(spark, sf_dir, replacement, REPS)


def _subsample_faith(spark, sf_dir):
    found = diversity.faith(_draw(spark, sf_dir, True, REPS), model.tree(spark, sf_dir))
    return _rounded(found, "faith_pd")


def _multi_beta(spark, sf_dir):
    drawn = _draw(spark, sf_dir, True, 2)
    return _pairs(diversity.beta(drawn, model.tree(spark, sf_dir), model.study(spark, sf_dir).samples, "unweighted_fp64"), rep=True)


def _distance(spark, sf_dir):
    t = model.study(spark, sf_dir)
    return diversity.beta(t.abundance, model.tree(spark, sf_dir), t.samples, "unweighted_fp64")


def _permanova(columns: list[str], *wanted: str):
    def query(spark, sf_dir):
        found = ordination.permanova(_distance(spark, sf_dir), model.groups(spark, sf_dir), columns, PERMUTATIONS, SEED)
        rounded = [w for w in wanted if w in ("statistic", "p_value")]
        return _rounded(found.select("grouping", *wanted), *rounded)

    return query


def _permanova_sql(columns: list[str], *wanted: str) -> str:
    u = f"('0x' || substr(md5(concat_ws('|', '{SEED}', perm, sample_id)), 1, 12))::BIGINT"
    expression = {
        "statistic": "round(max(f) FILTER (perm = 0), 6) AS statistic",
        "p_value": f"round((1 + count(*) FILTER (perm > 0 AND f >= own - 1e-12)) / (1.0::DOUBLE + {PERMUTATIONS}), 6) AS p_value",
        "sample_size": "any_value(n)::INT AS sample_size",
        "n_groups": "any_value(a)::INT AS n_groups",
    }
    return f"""WITH {model.TREE_SQL}, {model.study_sql()}, {model.beta_sql("unweighted")},
labels AS ({" UNION ALL ".join(f"SELECT '{c}' AS grouping, lpad(n_nationkey::VARCHAR, 2, '0') AS sample_id, {'n_regionkey' if c == 'region' else '(n_nationkey % 2)'}::VARCHAR AS label FROM nation WHERE lpad(n_nationkey::VARCHAR, 2, '0') IN (SELECT sample_id FROM samples)" for c in columns)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY grouping ORDER BY sample_id) AS spot FROM labels),
shuffled AS (SELECT grouping, perm, label, CASE WHEN perm = 0 THEN spot ELSE row_number() OVER (PARTITION BY grouping, perm ORDER BY {u}, sample_id) END AS spot FROM numbered, (SELECT unnest(range({PERMUTATIONS + 1})) AS perm)),
dealt AS (SELECT s.grouping, perm, sample_id, s.label FROM shuffled s JOIN numbered n USING (grouping, spot)),
sizes AS (SELECT grouping, label, count(*) AS size FROM labels GROUP BY ALL),
whole AS (SELECT grouping, count(*) AS n, count(DISTINCT label) AS a FROM labels GROUP BY 1),
sums AS (SELECT i.grouping, i.perm, sum(distance * distance) AS q, sum(CASE WHEN i.label = j.label THEN distance * distance / size ELSE 0 END) AS within_
  FROM dist JOIN dealt i ON i.sample_id = sample_i JOIN dealt j ON j.sample_id = sample_j AND j.perm = i.perm AND j.grouping = i.grouping JOIN sizes z ON z.grouping = i.grouping AND z.label = i.label GROUP BY ALL),
tests AS (SELECT grouping, perm, n, a, (q / n - within_) / (a - 1) / (within_ / (n - a)) AS f FROM sums JOIN whole USING (grouping)),
owned AS (SELECT *, max(f) FILTER (perm = 0) OVER (PARTITION BY grouping) AS own FROM tests)
SELECT grouping, {", ".join(expression[w] for w in wanted)} FROM owned GROUP BY grouping"""


_GOWER = """square AS (SELECT sample_i, sample_j, distance * distance AS q FROM dist), full_ AS (SELECT * FROM square UNION ALL SELECT sample_j, sample_i, q FROM square UNION ALL SELECT sample_id, sample_id, 0 FROM samples),
means AS (SELECT sample_i AS s, avg(q) AS m FROM full_ GROUP BY 1), g AS (SELECT sample_i, sample_j, -0.5 * (q - a.m - b.m + (SELECT avg(m) FROM means)) AS g FROM full_ JOIN means a ON a.s = sample_i JOIN means b ON b.s = sample_j)"""


def _gower_sql(select: str) -> str:
    return f"WITH {model.TREE_SQL}, {model.study_sql()}, {model.beta_sql('unweighted')}, {_GOWER} {select}"


def _gower(spark, sf_dir):
    # half a unit in the seventh place separates no sums here; + 0.0 makes -0 into 0
    found = ordination.gower(_distance(spark, sf_dir)).select("sample_i", "sample_j", "g")
    return found.withColumn("g", F.round("g", ROUND) + F.lit(0.0))


def _pcoa_trace(spark, sf_dir):
    return _rounded(ordination.gower(_distance(spark, sf_dir)).where("sample_i = sample_j").agg(F.sum("g").alias("trace")), "trace")


def _pcoa_total(spark, sf_dir):
    """All axes: eigenvalues add up to the trace, so their shares to 1."""
    axes, _ = ordination.pcoa(_distance(spark, sf_dir), 10_000)
    return _rounded(axes.agg(F.sum("eigval").alias("total"), F.sum("proportion_explained").alias("proportion")), "total", "proportion")


def _pcoa_axes(spark, sf_dir):
    return _rounded(ordination.pcoa(_distance(spark, sf_dir), 10)[0], "eigval", "proportion_explained")


def _pcoa_coords(spark, sf_dir):
    return _rounded(ordination.pcoa(_distance(spark, sf_dir), 10)[1], "value")


def _stored(read):
    def query(spark, sf_dir):
        path = scratch(spark, "result")
        store.write(path, _distance(spark, sf_dir), pcoa_dims=3, groups=model.groups(spark, sf_dir), columns=["region", "parity"], permutations=PERMUTATIONS, seed=SEED)
        return read(store.Results(spark, path))

    return query


def _stripes(spark, sf_dir):
    """Every stripe range computed on its own from the stored table, then merged."""
    t = model.study(spark, sf_dir)
    abundance, samples = materialized(t.abundance, "abundance"), materialized(t.samples, "samples")
    n = samples.count()
    return _pairs(stripes.merge([stripes.partial(abundance, model.tree(spark, sf_dir), samples, start, stop, "unweighted_fp64") for start, stop in stripes.report(n, 3)], n))


def _residual(spark, sf_dir):
    """What the ordination's axes miss of the definition: the centred matrix times an axis is its eigenvalue times the
    axis, and an axis is as long as the root of its eigenvalue says."""
    distance = materialized(_distance(spark, sf_dir), "distance")
    axes, coords = ordination.pcoa(distance, AXES)
    image = ordination.gower(distance).join(coords.withColumnRenamed("sample_id", "sample_j"), ["rep", "sample_j"]).groupBy("rep", "axis", F.col("sample_i").alias("sample_id")).agg(F.sum(F.col("g") * F.col("value")).alias("image"))
    rows = image.join(coords, ["rep", "axis", "sample_id"]).join(axes, ["rep", "axis"])
    off = F.max(F.abs(F.col("image") - F.col("eigval") * F.col("value"))).alias("residual")
    found = rows.groupBy("axis").agg(off, F.abs(F.sum(F.col("value") ** 2) - F.greatest(F.first("eigval"), F.lit(0.0))).alias("excess"))
    return _rounded(found, "residual", "excess")


# --- the public functions ---


def _public(family: str, alpha: float = 1.0):
    """A matrix function on values in memory."""

    def query(spark, sf_dir):
        more = {"alpha": alpha} if family == "generalized" else {}
        return _pairs(getattr(api, f"{family}_fp64")(model.study(spark, sf_dir), model.tree(spark, sf_dir), **more))

    return query


def _public_file(family: str):
    """A to_file function, and what is read back."""

    def query(spark, sf_dir):
        path = scratch(spark, "file")
        getattr(api, f"{family}_fp64_to_file")(model.study(spark, sf_dir), model.tree(spark, sf_dir), path, 0)
        return _pairs(api.read_distance(path))

    return query


def _public_meta(spark, sf_dir):
    found = api.meta([model.study(spark, sf_dir, keep=FIRST), model.study(spark, sf_dir, keep=SECOND)], [model.tree(spark, sf_dir), model.tree(spark, sf_dir, second=True)], weights=[1.0, 2.0], consolidation="skipping-missing-values", method="unweighted_fp64")
    return _pairs(found)


def _public_faith(spark, sf_dir):
    return _rounded(api.faith_pd(model.study(spark, sf_dir, segments=True), model.tree(spark, sf_dir)), "faith_pd")


def _public_pair(family: str, alpha: float = 1.0):
    """A dense pair function on the vectors of two nations."""

    def query(spark, sf_dir):
        rows = model.study(spark, sf_dir, keep="n IN (3, 17)").abundance.groupBy("feature_id").pivot("sample_id", ["03", "17"]).agg(F.sum("count")).na.fill(0.0).orderBy("feature_id").collect()  # two vectors, as the function takes them
        more = {"alpha": alpha} if family == "generalized" else {}
        value = getattr(api, f"{family}_dense_pair")([r["feature_id"] for r in rows], [r["03"] for r in rows], [r["17"] for r in rows], model.tree(spark, sf_dir), **more)
        return _rounded(spark.createDataFrame([("03", "17", value)], "sample_i string, sample_j string, distance double"), "distance")

    return query


def _newick(spark, sf_dir):
    """The parts' tree written as text and parsed."""
    return newick.node_table(spark, model.newick_text(spark, sf_dir)).select("name", "length", "is_tip", "depth")


def queries():
    out = {"faith_pd": _faith, "node_counts": _node_counts, "sample_totals": _totals, "abundance_validate": _validate, "weighted_normalized_wide": _wide}
    for family in FAMILIES:
        out |= {family: _beta(family), f"{family}_fp64": _beta(f"{family}_fp64"), f"{family}_vaw": _beta(f"{family}_fp64", adjusted=True), f"{family}_bypass": _beta(f"{family}_fp64", bypass=True), f"{family}_dense_pair": _dense_pair(family)}
    out |= {f"generalized_a{str(a).replace('.', '').rstrip('0') or '0'}": _beta("generalized_fp64", alpha=a) for a in (0.0, 0.5, 1.0)}
    out |= {"generalized_fp32": _beta("generalized_fp32", alpha=0.3), "generalized_vaw": _beta("generalized_fp64", alpha=0.5, adjusted=True), "generalized_bypass": _beta("generalized_fp64", alpha=0.5, bypass=True), "generalized_dense_pair": _dense_pair("generalized", 0.5)}
    out |= {f"meta_{how}": _meta(how) for how in consolidate.CONSOLIDATIONS}
    out |= {"subsample_with": _subsample(True), "subsample_without": _subsample(False), "subsample_faith": _subsample_faith, "multi_subsample_unweighted": _multi_beta}
    out |= {"permanova_f": _permanova(["region"], "statistic", "sample_size", "n_groups"), "permanova_p": _permanova(["region"], "p_value"), "permanova_multi_column": _permanova(["region", "parity"], "statistic", "p_value")}
    out |= {"gower_center": _gower, "pcoa_trace": _pcoa_trace, "pcoa_total": _pcoa_total, "pcoa_axes": _pcoa_axes, "pcoa_coords": _pcoa_coords}
    out |= {
        "store_roundtrip_distance": _stored(lambda r: _pairs(r.distance_table())),
        "store_roundtrip_permanova": _stored(lambda r: _rounded(r.permanova_table().select("grouping", "statistic", "p_value"), "statistic", "p_value")),
        "store_roundtrip_pcoa": _stored(lambda r: _rounded(r.coords_table(), "value")),
        "stripes_partial_merge": _stripes,
        "pcoa_residual": _residual,
    }
    out |= {f"api_{family}": _public(family) for family in FAMILIES} | {f"api_{family}_to_file": _public_file(family) for family in FAMILIES} | {f"api_{family}_dense_pair": _public_pair(family) for family in FAMILIES}
    out |= {"api_generalized": _public("generalized", 0.5), "api_generalized_dense_pair": _public_pair("generalized", 0.5), "api_meta": _public_meta, "api_faith_pd": _public_faith, "newick_parse": _newick}
    return out


def _beta_oracles() -> dict[str, str]:
    out, unweighted = {}, _beta_sql("unweighted")
    for family in FAMILIES:
        out |= {family: _beta_sql(family, single=True), f"{family}_fp64": _beta_sql(family), f"{family}_vaw": _beta_sql(family, adjusted=True), f"{family}_bypass": _beta_sql(family, bypass=True), f"{family}_dense_pair": _dense_pair_sql(family)}
    out |= {f"generalized_a{str(a).replace('.', '').rstrip('0') or '0'}": _beta_sql("generalized", alpha=a) for a in (0.0, 0.5, 1.0)}
    out |= {"generalized_fp32": _beta_sql("generalized", alpha=0.3, single=True), "generalized_vaw": _beta_sql("generalized", alpha=0.5, adjusted=True), "generalized_bypass": _beta_sql("generalized", alpha=0.5, bypass=True), "generalized_dense_pair": _dense_pair_sql("generalized", 0.5)}
    out |= {f"meta_{how}": _meta_sql(how) for how in consolidate.CONSOLIDATIONS}
    out |= {f"subsample_{'with' if r else 'without'}": f"{_draw_sql(r)} SELECT rep, sample_id, feature_id, count FROM drawn" for r in (True, False)}
    out["subsample_faith"] = f"{_draw_sql(True)} SELECT rep, sample_id, round(sum(length), 6) AS faith_pd FROM (SELECT DISTINCT rep, sample_id, node_id, length FROM drawn JOIN closure USING (feature_id)) GROUP BY 1, 2"
    out["multi_subsample_unweighted"] = f"{_draw_sql(True, 2)}, abundance_r AS (SELECT * FROM drawn), left_in AS (SELECT sample_id, ord FROM samples WHERE sample_id IN (SELECT sample_id FROM whole)), {model.beta_sql('unweighted', suffix='_r', by='rep', samples='left_in')} SELECT rep, sample_i, sample_j, round(distance, 6) AS distance FROM dist"
    out |= {"permanova_f": _permanova_sql(["region"], "statistic", "sample_size", "n_groups"), "permanova_p": _permanova_sql(["region"], "p_value"), "permanova_multi_column": _permanova_sql(["region", "parity"], "statistic", "p_value")}
    out |= {
        "gower_center": _gower_sql("SELECT sample_i, sample_j, round(g, 6) + 0.0 AS g FROM g"),
        "pcoa_trace": _gower_sql("SELECT round(sum(g), 6) AS trace FROM g WHERE sample_i = sample_j"),
        "pcoa_total": _gower_sql("SELECT round(sum(g), 6) AS total, round(sum(g) / sum(g), 6) AS proportion FROM g WHERE sample_i = sample_j"),
        "store_roundtrip_distance": unweighted,
        "store_roundtrip_permanova": _permanova_sql(["region", "parity"], "statistic", "p_value"),
        "stripes_partial_merge": unweighted,
        "pcoa_residual": f"SELECT unnest(range(1, {AXES} + 1))::INT AS axis, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS excess",
    }
    out |= {f"api_{family}{suffix}": _beta_sql(family) for family in FAMILIES for suffix in ("", "_to_file")} | {f"api_{family}_dense_pair": _dense_pair_sql(family) for family in FAMILIES}
    out |= {"api_generalized": _beta_sql("generalized", alpha=0.5), "api_generalized_dense_pair": _dense_pair_sql("generalized", 0.5), "api_meta": _meta_sql("skipping_missing_values"), "newick_parse": model.NEWICK_SQL}
    return out


def oracle_sql():
    segments, nations = model.study_sql(segments=True), model.study_sql()
    out = {
        "faith_pd": f"WITH {model.TREE_SQL}, {segments}, e AS (SELECT DISTINCT sample_id, node_id, length FROM abundance JOIN closure USING (feature_id) WHERE count > 0) SELECT sample_id, round(coalesce(sum(length), 0), 6) AS faith_pd FROM samples LEFT JOIN e USING (sample_id) GROUP BY 1",
        "api_faith_pd": f"WITH {model.TREE_SQL}, {segments}, e AS (SELECT DISTINCT sample_id, node_id, length FROM abundance JOIN closure USING (feature_id) WHERE count > 0) SELECT sample_id, round(coalesce(sum(length), 0), 6) AS faith_pd FROM samples LEFT JOIN e USING (sample_id) GROUP BY 1",
        "node_counts": f"WITH {model.TREE_SQL}, {nations} SELECT sample_id, node_id, any_value(length) AS length, any_value(is_tip) AS is_tip, sum(count) AS c FROM abundance JOIN closure USING (feature_id) GROUP BY 1, 2",
        "sample_totals": f"WITH {segments} SELECT sample_id, sum(count) AS total FROM abundance GROUP BY 1",
        "abundance_validate": f"WITH {segments} SELECT count(DISTINCT sample_id) AS n_samples, count(DISTINCT feature_id) AS n_features, count(*) AS n_counts, count(*) FILTER (count < 0) AS n_negative, (SELECT count(DISTINCT feature_id) FROM abundance WHERE feature_id NOT IN (SELECT p_partkey::VARCHAR FROM part)) AS n_missing FROM abundance",
        "weighted_normalized_wide": f"WITH {model.TREE_SQL}, {segments}, {model.beta_sql('weighted_normalized')} SELECT sample_i, sample_j, round(distance, 6) AS distance FROM dist",
    }
    return out | _beta_oracles()
