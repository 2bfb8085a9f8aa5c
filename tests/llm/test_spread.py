"""Joins with frequent keys give what plain joins give."""

import pytest

from wardline.llm import spread


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(spread, "ROWS", 20)
    left = spark.createDataFrame([(k % 3 if k % 2 else k, "x" if k % 5 else None, k) for k in range(300)], "a int, b string, id int").cache()
    right = spark.createDataFrame([(k, "x", k * 10) for k in range(0, 200, 2)] + [(1, "x", 5), (1, None, 6)], "a int, b string, v int")
    for keys in (["a"], ["a", "b"]):
        right_ = right if len(keys) > 1 else right.drop("b")
        got, want = spread.spread_join(left, right_, keys, ["id"], how), left.join(right_, keys, how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "__piece" in spread.spread_join(left, right, ["a", "b"], ["id"])._jdf.queryExecution().toString()
