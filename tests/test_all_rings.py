"""Rings of customers of any id."""

from geostrata.plans.catalogue import QUERIES


def test_rectangles_of_all_customers(spark, tmp_path):
    # x is the id modulo 97: the first ring spans 0 to 9 with ids of 291 and more, the second has such ids only
    ids = {1: [291, 292, 293, 300], 2: [388, 390, 392]}
    rows = [(k, n, 100.0 * (j % 2)) for n, ks in ids.items() for j, k in enumerate(ks)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.id: r for r in QUERIES["min_area_rectangles"](spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2}
    assert got[1].length > 8
