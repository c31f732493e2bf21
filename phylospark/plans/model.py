"""The star schema read as a study: parts are features, the part hierarchy is the tree, customers' nations or
nation-segments are samples, ordered quantities are counts. Lengths are integers, so sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.sources.tables import Table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """Closure of: type (4), brand within it (2), part (1 + size mod 5); or: brand (3), type within it (2), part
    (1 + key mod 3)."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("feature_id"), "p_type", "p_brand", "p_size", "p_partkey")
    pair = F.concat_ws("|", "p_type", "p_brand")
    if second:
        levels = [("b:", F.col("p_brand"), F.lit(3.0), False), ("t:", pair, F.lit(2.0), False), ("p:", F.col("feature_id"), 1.0 + F.col("p_partkey") % 3, True)]
    else:
        levels = [("t:", F.col("p_type"), F.lit(4.0), False), ("b:", pair, F.lit(2.0), False), ("p:", F.col("feature_id"), 1.0 + F.col("p_size") % 5, True)]
    edges = F.array(*(F.struct(F.concat(F.lit(mark), name).alias("node_id"), length.cast("double").alias("length"), F.lit(tip).alias("is_tip")) for mark, name, length, tip in levels))
    return part.select("feature_id", F.explode(edges).alias("e")).select("feature_id", "e.node_id", "e.length", "e.is_tip")


def newick_text(spark: SparkSession, sf_dir: str) -> str:
    """The tree of `tree` as text; like any tree, it is read whole."""
    below: dict[str, dict[str, list[str]]] = {}
    for r in load(spark, sf_dir, "part").select("p_type", "p_brand", "p_partkey", "p_size").toLocalIterator():
        below.setdefault(r["p_type"], {}).setdefault(r["p_brand"], []).append(f"'p:{r['p_partkey']}':{1 + r['p_size'] % 5}")
    types = []
    for kind, brands in sorted(below.items()):
        own = [f"({','.join(sorted(tips))})'b:{kind}|{brand}':2" for brand, tips in sorted(brands.items())]
        types.append(f"({','.join(own)})'t:{kind}':4")
    return f"({','.join(types)})root;"


def study(spark: SparkSession, sf_dir: str, segments: bool = False, month: int | None = None, keep: str | None = None) -> Table:
    """Counts by nation (or nation-segment), over all months or one; samples come from the customers, so some may have
    no counts. `keep` is a condition on n, the nation's number."""
    customer = load(spark, sf_dir, "customer").where("c_custkey IS NOT NULL")
    if keep:
        customer = customer.where(keep.replace("n ", "c_nationkey "))
    name = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    if segments:
        name = F.concat_ws("-", name, "c_mktsegment")
    customer = customer.select("c_custkey", name.alias("sample_id"))
    lineitem = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    if month:
        lineitem = lineitem.where(F.month("l_shipdate") == month)
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # quantities meet their customer once, then are summed map-side by (sample, part)
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    abundance = rows.groupBy("sample_id", F.col("l_partkey").cast("string").alias("feature_id")).agg(F.sum("l_quantity").alias("count"))
    from pyspark.sql import Window

    samples = customer.select("sample_id").distinct().withColumn("ord", (F.row_number().over(Window.orderBy("sample_id")) - 1).cast("int"))
    return Table(abundance, samples, abundance.select("feature_id").distinct())


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, region, parity of each nation."""
    return load(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("sample_id"), F.col("n_regionkey").cast("string").alias("region"), (F.col("n_nationkey") % 2).cast("string").alias("parity"))


# --- the same in DuckDB's SQL ---

TREE_SQL = """closure AS (
  SELECT p_partkey::VARCHAR AS feature_id, 't:' || p_type AS node_id, 4.0::DOUBLE AS length, false AS is_tip FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'b:' || p_type || '|' || p_brand, 2.0, false FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'p:' || p_partkey, 1.0 + p_size % 5, true FROM part)"""
TREE2_SQL = """closure2 AS (
  SELECT p_partkey::VARCHAR AS feature_id, 'b:' || p_brand AS node_id, 3.0::DOUBLE AS length, false AS is_tip FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 't:' || p_type || '|' || p_brand, 2.0, false FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'p:' || p_partkey, 1.0 + p_partkey % 3, true FROM part)"""


NEWICK_SQL = """SELECT 'root' AS name, 0.0::DOUBLE AS length, false AS is_tip, 0 AS depth
  UNION ALL SELECT DISTINCT 't:' || p_type, 4.0, false, 1 FROM part
  UNION ALL SELECT DISTINCT 'b:' || p_type || '|' || p_brand, 2.0, false, 2 FROM part
  UNION ALL SELECT 'p:' || p_partkey, 1.0 + p_size % 5, true, 3 FROM part"""


def study_sql(segments: bool = False, month: int | None = None, keep: str | None = None, suffix: str = "") -> str:
    name = "lpad(c_nationkey::VARCHAR, 2, '0')" + (" || '-' || c_mktsegment" if segments else "")
    where = f" WHERE {keep.replace('n ', 'c_nationkey ')}" if keep else ""
    when = f" WHERE month(l_shipdate) = {month}" if month else ""
    return f"""people{suffix} AS (SELECT c_custkey, {name} AS sample_id FROM customer{where}),
abundance{suffix} AS (SELECT sample_id, l_partkey::VARCHAR AS feature_id, sum(l_quantity) AS count
  FROM (SELECT * FROM lineitem{when}) JOIN orders ON l_orderkey = o_orderkey JOIN people{suffix} ON o_custkey = c_custkey GROUP BY ALL),
samples{suffix} AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS ord FROM (SELECT DISTINCT sample_id FROM people{suffix}))"""


def beta_sql(family: str, alpha: float = 1.0, adjusted: bool = False, bypass: bool = False, suffix: str = "", closure: str = "closure", by: str = "", samples: str | None = None, name: str = "dist") -> str:
    """The dense form: every pair meets every edge that any sample has. `by`: a column of abundance (rep)."""
    samples = samples or f"samples{suffix}"
    rep, on = (f"{by}, ", f" AND a.{by} = n.{by}") if by else ("", "")
    a, b = "coalesce(a.c, 0)", "coalesce(b.c, 0)"
    ta, tb = "coalesce(x.total, 0)", "coalesce(y.total, 0)"
    if family.startswith("unweighted"):
        top, bottom = f"(({a} > 0)::INT - ({b} > 0)::INT)", f"greatest(({a} > 0)::INT, ({b} > 0)::INT)"
        top = f"abs{top}"
    else:
        p, q = (f"(CASE WHEN {t} > 0 THEN {v} / {t} ELSE 0 END)" for v, t in ((a, ta), (b, tb)))
        top, bottom = f"abs({p} - {q})", f"({p} + {q})"
        if family == "generalized":
            top, bottom = f"CASE WHEN {p} + {q} > 0 THEN pow({p} + {q}, {alpha - 1.0}) * abs({p} - {q}) ELSE 0 END", f"CASE WHEN {p} + {q} > 0 THEN pow({p} + {q}, {float(alpha)}) ELSE 0 END"
    weight = f"CASE WHEN {a} + {b} > 0 AND {a} + {b} < {ta} + {tb} THEN 1 / sqrt(({a} + {b}) * ({ta} + {tb} - {a} - {b})) ELSE 0 END" if adjusted else "1"
    value = "greatest(0, sum(top))" if family.endswith("unnormalized") else "CASE WHEN sum(bottom) > 0 THEN greatest(0, sum(top)) / sum(bottom) ELSE 0 END"
    k = name
    return f"""{k}_nodes AS (SELECT {rep}sample_id, node_id, any_value(length) AS length, sum(count) AS c FROM abundance{suffix} JOIN {closure} USING (feature_id){" WHERE NOT is_tip" if bypass else ""} GROUP BY ALL),
{k}_total AS (SELECT {rep}sample_id, sum(count) AS total FROM abundance{suffix} GROUP BY ALL),
{k}_edges AS (SELECT {rep}node_id, any_value(length) AS length FROM {k}_nodes GROUP BY ALL),
{k}_terms AS (SELECT {"n." + by + " AS " + by + ", " if by else ""}s.sample_id AS sample_i, t.sample_id AS sample_j, n.length * ({top}) * ({weight}) AS top, n.length * ({bottom}) * ({weight}) AS bottom
  FROM {samples} s JOIN {samples} t ON s.ord < t.ord CROSS JOIN {k}_edges n
  LEFT JOIN {k}_nodes a ON a.sample_id = s.sample_id AND a.node_id = n.node_id{on} LEFT JOIN {k}_nodes b ON b.sample_id = t.sample_id AND b.node_id = n.node_id{on.replace("a.", "b.")}
  LEFT JOIN {k}_total x ON x.sample_id = s.sample_id{on.replace("a.", "x.")} LEFT JOIN {k}_total y ON y.sample_id = t.sample_id{on.replace("a.", "y.")}),
{name} AS (SELECT {rep}sample_i, sample_j, {value} AS distance FROM {k}_terms GROUP BY ALL)"""
