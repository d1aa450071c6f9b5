import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators.quantiles import exact_quantiles, quantile_table

PROBS = [0.0, 0.001, 0.25, 0.5, 0.95, 0.999, 1.0]


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_exact_for_skewed_groups_and_ties(spark, accuracy):
    """With accuracy 100 the two large groups go through brackets, the small one whole."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 60, "tiny").otherwise("zeros").alias("k"),
        F.when(F.col("id") % 3 == 0, F.randn(7)).when(F.rand(8) < 0.9, 0.0).otherwise(F.rand(9)).alias("v"),
    ).cache()
    got = exact_quantiles(df, ["k"], {"v": F.col("v")}, PROBS, accuracy).toPandas()
    assert len(got) == 3 * len(PROBS)
    for key, part in df.toPandas().groupby("k"):
        mine = got[got["k"] == key].sort_values("prob")["quantile"]
        np.testing.assert_allclose(mine, np.quantile(part["v"], PROBS), rtol=1e-12, atol=1e-12)


def test_missing_values_and_wide_form(rows):
    df = rows("k string, v double, w double", ("a", 1.0, None), ("a", 4.0, None), ("a", None, 2.0), (None, 9.0, 9.0))
    out = quantile_table(df, ["k"], {"m": (F.col("v"), 0.5), "q": (F.col("v"), 0.25), "w": (F.col("w"), 0.5)})
    assert [tuple(r) for r in out.collect()] == [("a", 2.5, 1.75, 2.0)]


def test_approximate_form_is_one_pass(rows):
    df = rows("v double", *[(float(i),) for i in range(101)])
    out = quantile_table(df, [], {"m": (F.col("v"), 0.5)}, exact=False)
    assert abs(out.first().m - 50) <= 1
