"""Sums of prices in the order of the file."""

from factloom.catalog import rules


def test_prices_are_added_in_the_order_of_the_file(spark, tmp_path):
    """Files are read by their size and partial sums come in any order; by name and row 1e16 + 1 - 1e16 is 0, else it may be 1."""
    line = lambda k, price: (k, 1.0, 0.1, price)
    parts = [[line(1, 1e16)] + [line(k, k * 1.1) for k in range(9, 3000)], [line(1, 1.0)], [line(1, -1e16)] + [line(k, k * 1.3) for k in range(9, 1000)]]
    (tmp_path / "lineitem.parquet").mkdir()
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_discount double, l_extendedprice double").coalesce(1).toPandas().to_parquet(tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    spark.createDataFrame([(1, "F", "1-URGENT", 5.0)], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").toPandas().to_parquet(tmp_path / "orders.parquet")
    own = rules.facts(spark, str(tmp_path)).where("subject = 1 and name = 'price_sum'")
    assert [r.value for r in own.collect()] == ["0"]
