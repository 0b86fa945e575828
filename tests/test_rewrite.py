"""Queries factored by key give the rows, names and types of Spark's own plan."""

import os
import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import fused, matrix
from heddle.plans import rewrite
from heddle.plans.engine import Engine
from heddle.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
TAKEN = [
    "SELECT COUNT(*) AS n FROM A, B WHERE A.k = B.k",
    "SELECT a.g, b.g, SUM(a.v * b.v) AS v FROM A a, B b WHERE a.k = b.k GROUP BY a.g, b.g",
    "SELECT a.g AS x, SUM(a.v) s, COUNT(b.v) c, MIN(b.v) m, MAX(a.d) q, ROUND(SUM(a.v * b.v) + COUNT(*), 2) z FROM A a JOIN B b ON a.k = b.k AND a.v > 1 WHERE b.g <> 'x' GROUP BY a.g ORDER BY x DESC LIMIT 2",
    "SELECT a.g, b.g FROM A a, B b WHERE a.k = b.k AND a.g = b.g GROUP BY a.g, b.g",
    "SELECT a.v + 1 AS w, SUM(CAST(b.v AS DECIMAL(12,2))) s FROM A a, A b WHERE a.k = b.k GROUP BY a.v + 1 ORDER BY s NULLS LAST, w",
    "SELECT SUM(a.v * (b.v * a.v)) s FROM A a, B b WHERE a.k = b.k",
    "WITH m AS (SELECT k, g, SUM(v) AS v FROM A GROUP BY k, g) SELECT a.g, SUM(a.v * b.v) AS v FROM m a, m b WHERE a.k = b.k GROUP BY a.g",
    "SELECT SUM(a.v) s, COUNT(*) n FROM A a, B b, B c WHERE a.k = b.k AND a.k = c.k",
]
LEFT_ALONE = [
    "SELECT SUM(a.v + b.v) s FROM A a, B b WHERE a.k = b.k",
    "SELECT COUNT(DISTINCT a.v) s FROM A a, B b WHERE a.k = b.k",
    "SELECT SUM(a.v) s FROM A a LEFT JOIN B b ON a.k = b.k",
    "SELECT SUM(a.v) s FROM A a, B b WHERE a.k < b.k",
    "SELECT SUM(a.v) s FROM A a, B b WHERE a.k = b.k AND a.v < b.v",
    "SELECT a.g, SUM(a.v) s FROM A a, B b WHERE a.k = b.k GROUP BY a.g HAVING SUM(a.v) > 1",
    "SELECT a.g, SUM(a.v) s FROM A a, B b WHERE a.k = b.k GROUP BY ROLLUP(a.g)",
    "SELECT SUM(CAST(a.v AS DECIMAL(18,8))) s FROM A a, B b WHERE a.k = b.k",
    "SELECT SUM(a.v) s FROM A a, B b WHERE a.k = b.k AND a.v IN (SELECT v FROM B)",
]


def engine(spark, factor, empty=False):
    e, r = Engine(spark, factor), random.Random(1)
    for name, n in (("A", 60), ("B", 50)):
        rows = [(r.choice([None, 1, 2, 3, 4]), r.choice("xyz"), r.choice([None, 1, 2, 5, -3]), r.random()) for _ in range(n)]
        e.create(name, spark.createDataFrame([] if empty else rows, "k int, g string, v int, d double"))
    return e


def aggregates(df):
    return df._jdf.queryExecution().analyzed().toString().count("Aggregate [")


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("query", TAKEN + LEFT_ALONE)
def test_same_rows(spark, query, empty):
    plain, made = (engine(spark, f, empty).sql(query) for f in ("never", "always"))
    ordered = list if "ORDER BY" in query else lambda rows: sorted(rows, key=str)
    assert ordered(plain.collect()) == ordered(made.collect())
    assert [(f.name, f.dataType) for f in plain.schema] == [(f.name, f.dataType) for f in made.schema]
    assert (aggregates(made) > aggregates(plain)) == (query in TAKEN)


def test_factored_only_where_keys_repeat_on_both_sides(spark):
    e = engine(spark, "auto")
    query = "SELECT SUM(a.v) AS s FROM A a, {} b WHERE a.k = b.k"
    e.create("U", spark.createDataFrame([(k,) for k in range(5)], "k int"))
    assert aggregates(e.sql(query.format("B"))) == 3
    assert aggregates(e.sql(query.format("U"))) == 1
    assert Engine(spark, "never").factor == "never"
    with pytest.raises(ValueError):
        engine(spark, "sometimes").sql(query.format("B"))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", ["sql_matmul", "sql_matmul_cte", "sql_join_groupby_both", "sql_join_count"])
def test_registered_queries_aggregate_before_the_join(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan[plan.index("Join Inner") :]


def test_large_results_of_few_keys_are_not_shuffled(spark, monkeypatch):
    """The same rows with keys as columns, and no exchange of joined rows; nulls, single keys and one-sided extremes."""
    rows = [(k % 5 if k % 11 else None, k % 13, k % 7 if k % 3 else None, k / 4) for k in range(400)] + [(9, 50, 1, 1.0), (8, 51, None, 2.0)]
    a = spark.createDataFrame(rows, "k int, g int, v int, w double").withColumn("d", F.col("w").cast("decimal(12,2)"))
    b = spark.createDataFrame([(8 if r[0] == 0 else r[0], r[1] % 6, r[2], r[3]) for r in rows if r[1] < 50] + [(77, 99, 1, 1.0)], a.drop("d").schema)
    a.createOrReplaceTempView("few_a")
    b.createOrReplaceTempView("few_b")
    text = "SELECT x.g, y.g AS h, SUM(x.v * y.v) AS s, SUM(x.d * y.v) AS t, COUNT(y.v) AS n, COUNT(*) AS c, MIN(x.v) AS lo, MAX(y.w) AS hi FROM few_a x JOIN few_b y ON x.k = y.k GROUP BY x.g, y.g"
    monkeypatch.setattr(fused, "LEAST_PAIRS", 1)
    plain, wide = spark.sql(text), rewrite.factored(spark.sql(text), "always")
    m = matrix.coo(a, "g", "k", F.col("v").cast("long"))
    products = [matrix.matmul(m, matrix.transpose(m), "sparse")]
    monkeypatch.setattr(fused, "MOST_KEYS", 0)
    products.append(matrix.matmul(m, matrix.transpose(m), "sparse"))
    for x, y in ((plain, wide), products[::-1]):
        assert x.dtypes == y.dtypes
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    for df in (wide, products[0]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        top = plan[: plan.index("NestedLoopJoin")]
        assert "Exchange" not in top and "HashAggregate" not in top


@pytest.fixture
def many(spark, monkeypatch):
    """Two sides of 44 keys and some hundred groups, nulls among keys, groups and values; each has keys that the other has not."""
    monkeypatch.setattr(fused, "LEAST_PAIRS", 1)
    rows = [(k % 41 if k % 17 else None, (k * 7) % 101 or None, k % 9 if k % 5 else None, float("nan") if k % 41 == 3 else k % 41 / 4) for k in range(3000)]
    a = spark.createDataFrame([*rows, *[(50 + k, k, k, -1.0 - k) for k in range(3)]], "k int, g int, v long, w double")
    return a, spark.createDataFrame([*rows[::-2], *[(60 + k, 7, k, None) for k in range(3)]], "k long, g int, v long, w double")


def meets_in_one_task(df):
    """Whether pairs are made and summed up without an exchange between."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Generate explode(_s1" in plan and "Exchange" not in plan[: plan.index("Generate explode(_s1")]


def test_products_over_many_keys_are_not_shuffled(many):
    a, b = (matrix.coo(m.dropna(), "g", "k", "v") for m in many)
    got = matrix.matmul(a, matrix.transpose(b), "sparse")
    x, y = a.select("j", "i", F.col("v").alias("x")), b.select("j", F.col("i").alias("h"), F.col("v").alias("y"))
    plain = x.join(y, "j").groupBy("i", "h").agg(F.sum(F.col("x") * F.col("y")))
    assert meets_in_one_task(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("on", ["x.k = y.k", "x.w = y.w AND x.k = y.k", "x.w = y.w"])
def test_sql_over_many_keys_is_not_shuffled(spark, many, on):
    """Keys of unlike whole types, keys that are not numbers or null; groups of several types and sides without a match."""
    for name, m in zip(("many_a", "many_b"), many, strict=True):
        m.withColumn("d", F.col("w").cast("decimal(12,2)")).createOrReplaceTempView(name)
    text = f"SELECT x.g, CAST(x.g % 7 AS STRING) AS t, y.g AS h, y.g / 2 AS f, SUM(x.v * y.v) AS s, SUM(x.d * y.v) AS d, COUNT(y.v) AS n, COUNT(*) AS c, MIN(x.v) AS lo, MAX(y.d) AS hi FROM many_a x JOIN many_b y ON {on} GROUP BY x.g, CAST(x.g % 7 AS STRING), y.g, y.g / 2"
    plain, made = spark.sql(text), rewrite.factored(spark.sql(text), "always")
    assert plain.dtypes == made.dtypes
    assert meets_in_one_task(made)
    assert sorted(map(str, plain.collect())) == sorted(map(str, made.collect()))
