"""Two-level scans against plain loops, with columns beyond the order."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import relational as R
from factloom.operators import scan
from factloom.sources import files
from factloom.streaming import incremental

X = random.Random(4)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_with_more_columns_and_partitions(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        d = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
        order = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"]
        got = R.with_ordinal(d.select(*order, "l_extendedprice", "l_shipdate"), *order, partitions=64)
        n, least, most, distinct = got.agg(F.count("*"), F.min("_ord"), F.max("_ord"), F.countDistinct("_ord")).first()
        assert (n, least, most, distinct) == (d.count(), 0, d.count() - 1, d.count())
        turned = got.join(got.select((F.col("_ord") - 1).alias("_ord"), F.struct(*order).alias("after")), "_ord").where(F.struct(*order) > F.col("after")).count()
        assert turned == 0
        sample = R.systematic(d.select(*order, "l_extendedprice"), 1000, *order)
        assert sample.count() == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_positions_descending_nulls_and_nothing(spark):
    rows = [(None, 1), (3, 2), (3, 1), (1, 9), (None, 0)]
    d = spark.createDataFrame(rows, "a int, b int").repartition(4)
    got = {r._ord: (r.a, r.b) for r in R.with_ordinal(d, F.desc("a"), "b").collect()}
    assert [got[k] for k in range(5)] == [(3, 1), (3, 2), (1, 9), (None, 0), (None, 1)]
    assert R.with_ordinal(d.where("b > 10"), "a").count() == 0


def test_pacing_is_the_loop(spark):
    rows, t = [], 0
    for k in range(200_000):
        t += X.choice([0, 0, 1, 2, 9])
        rows.append((k, t, X.choice([0, 1, 3])))
    d = spark.createDataFrame(rows, "k long, t long, g long")
    got = {r.k: r["at"] for r in scan.paced(d, "t", F.col("g"), "k").collect()}
    at = None
    for k, t, g in rows:
        at = t if at is None else max(t, at + g)
        assert got[k] == at


def test_budget_and_running_mean(spark):
    rows = [(k, X.randint(1, 40)) for k in range(3000)]
    got = {r.k: (r.running, r.mean_pages) for r in incremental.admitted(spark.createDataFrame(rows, "k long, pages long").repartition(5), "pages", "k", 20_000).collect()}
    total, want = 0, {}
    for n, (k, p) in enumerate(rows, 1):
        total += p
        if total <= 20_000:
            want[k] = (total, total / n)
    assert got == want


def test_order_statistics_with_ties_and_a_hot_key(spark):
    rows = [(X.choice(["a"] * 6 + ["b", None]), X.choice([None, 1.0, 2.0, 2.0, 5.5, 7.25])) for _ in range(5000)] + [("one", 3.0), ("none", None)]
    d = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: (r.n, r.upper_median, r.median) for r in scan.medians(d, ["g"], "x").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        if v:
            want[g] = (len(v), v[len(v) // 2], (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)
    assert got == want
    v = sorted(x for _, x in rows if x is not None)
    assert R.upper_median_of(d, "x").first().x == v[len(v) // 2]
    got = sorted(((r.g, r.x, round(r.share, 9)) for r in R.ecdf(d.where("g is not null and x is not null"), "x", ["g"]).collect()))
    want = sorted((g, x, round((k + 1) / len(own), 9)) for g in ("a", "b", "one") for own in [sorted(x for h, x in rows if h == g and x is not None)] for k, x in enumerate(own))
    assert got == want


def test_a_key_is_stored_once(spark):
    rows = [("a", "%PDF-1"), ("a", "%PDF-2"), ("a", "no"), ("b", "%PDF-1"), ("b", "%PDF-1"), ("c", None), ("d", "%PDF-9")]
    path = files.scratch(spark, "objects")
    got = sorted((r.key, r.status) for r in files.put_objects(spark.createDataFrame(rows, "key string, body string"), spark.createDataFrame([("d",)], "key string"), path).collect())
    assert got == [("a", "exists"), ("a", "not-a-pdf"), ("a", "uploaded"), ("b", "exists"), ("b", "uploaded"), ("c", "not-a-pdf"), ("d", "exists")]
    assert sorted(r.key for r in spark.read.parquet(path).collect()) == ["a", "b"]
