import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.binding import Binding
from panelforge.operators import aggregates as agg
from panelforge.operators import sampling


def test_null_keys_belong_to_no_group(rows):
    df = rows("k string, v double", ("a", 1.0), ("a", None), (None, 5.0), ("b", 3.0))
    out = {r.k: (r.m, r.n) for r in agg.group_means(df, ["k"], {"m": "v"}, count="n").collect()}
    assert out == {"a": (1.0, 2), "b": (3.0, 1)}
    assert [r.k for r in agg.group_means(df, ["k"], {"m": "v"}, least=2).collect()] == ["a"]


def test_means_of_means_and_common_values(rows):
    df = rows("y int, m int, v double", (1, 1, 1.0), (1, 1, 3.0), (1, 2, 10.0), (2, 1, 4.0), (2, 3, 0.0))
    assert [r.m for r in agg.common_values(df, "m", "y").collect()] == [1]
    out = {r.y: r.v for r in agg.mean_of_means(df, "y", "m", {"v": "v"}).collect()}
    assert out == {1: 6.0, 2: 2.0}


def test_shares_and_reindex_show_empty_categories(rows):
    df = rows("c string", ("x",), ("x",), ("y",), ("other",), (None,))
    out = agg.category_share(df, F.col("c"), ["y", "z", "x"]).orderBy("position").collect()
    assert [r.category for r in out] == ["y", "z", "x"]
    assert [r.share_pct for r in out] == pytest.approx([100 / 3, 0, 200 / 3])


def test_top_values_trim_and_break_ties(rows):
    df = rows("c string", (" b",), ("a ",), ("b",), ("a",), ("c",), (None,))
    assert [(r.c, r.n) for r in agg.top_values(df, "c", 2).collect()] == [("a", 2), ("b", 2)]


def test_group_summary_takes_the_first_known_value(rows):
    df = rows("k string, t int, c string, v double", ("a", 1, None, 1.0), ("a", 2, "x", 2.0), ("a", 3, "y", 6.0))
    out = agg.group_summary(df, Binding(("k",), "t"), "k", {"mean": "v"}, 1, {"c": "c"}, {"mid": "v"}).first()
    assert (out.c, out.mean, out.mid, out.observations) == ("x", 3.0, 2.0, 3)


def test_correlation_is_pairwise_complete(rows):
    data = [(1.0, 2.0, 1.0), (2.0, 4.5, None), (3.0, 5.0, 3.0), (4.0, None, 2.0)]
    df = rows("a double, b double, c double", *data)
    out = {(r["row"], r["column"]): r.r for r in agg.correlations(df, ["a", "b", "c"]).collect()}
    assert len(out) == 9
    assert out["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 5])[0, 1])
    assert out["c", "a"] == pytest.approx(np.corrcoef([1, 3, 4], [1, 3, 2])[0, 1])
    assert out["a", "a"] == pytest.approx(1)


def test_histogram_counts_every_value_once(rows):
    df = rows("v double", *[(float(i),) for i in range(11)], (None,))
    out = agg.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r.n for r in out] == [2, 2, 2, 2, 3]
    assert out[0].left_edge == 0 and out[-1].right_edge == pytest.approx(10)


def test_whiskers_stop_at_the_last_value_inside(rows):
    df = rows("k string, v double", *[("a", float(v)) for v in (1, 2, 3, 4, 5, 100)])
    r = agg.box_stats(df, "k", "v").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high) == (2.25, 3.5, 4.75, 1.0, 5.0)


def test_metrics_skip_small_actuals_and_flat_series(rows):
    df = rows(
        "m string, y_true double, y_pred double", ("a", 0.0, 1.0), ("a", 0.001, 1.0), ("a", 2.0, 1.0),
        ("flat", 3.0, 2.0), ("flat", 3.0, 4.0),
    )
    out = {r.m: r for r in agg.regression_metrics(df, ["m"]).collect()}
    assert out["a"].mape == pytest.approx(50.0)
    assert out["flat"].r2 is None and out["flat"].rmse == 1.0
    y, p = np.array([0, 0.001, 2]), np.ones(3)
    assert out["a"].r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_quadratic_fit_recovers_coefficients(rows):
    df = rows("x double, y double", *[(float(x), 2.0 * x * x - 3.0 * x + 1.0) for x in range(-50, 90, 7)])
    fit = agg.quadratic_fit(df, "x", "y")
    r = fit.first()
    assert (r.c2, r.c1, r.c0) == pytest.approx((2, -3, 1))
    curve = agg.quadratic_curve(fit, 5).orderBy("point").collect()
    assert curve[0].x == -50 and curve[-1].x == pytest.approx(r.x_max)


def test_weights_of_a_constant_are_zero_and_caps_apply(rows):
    df = rows("v double, w double", (1.0, 5.0), (3.0, 5.0), (2.0, 5.0))
    assert sorted(r.weight for r in agg.minmax_weight(df, "v").collect()) == [0.0, 0.5, 1.0]
    assert {r.weight for r in agg.minmax_weight(df, "w").collect()} == {0.0}
    assert max(r.s for r in agg.cap_at_quantile(df, "v", 0.5, "s").collect()) == 2.0


def test_detectors_and_drivers(rows):
    df = rows("a boolean, b boolean, x double, y double", (True, True, 9.0, 1.0), (True, False, 8.0, 2.0),
              (False, False, 1.0, 1.0), (False, False, 2.0, 2.0))
    r = agg.detector_agreement(df, "a", "b").first()
    assert (r.n_samples, r.flagged_both, r.flagged_either, r.jaccard) == (4, 1, 2, 0.5)
    drivers = agg.flag_drivers(df, "a", ["x", "y"]).collect()
    assert drivers[0].feature == "x" and drivers[0].mean_z == pytest.approx(3.5 / np.std([9, 8, 1, 2], ddof=1))
    assert agg.detector_agreement(df.where("not a"), "a", "b").first().jaccard == 0.0


def test_hash_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    one = {r.id for r in sampling.hash_sample(df.repartition(1), ["id"], 100).collect()}
    many = {r.id for r in sampling.hash_sample(df.repartition(13), ["id"], 100).collect()}
    assert one == many and len(one) == 100
    share = sampling.hash_split(df, ["id"]).agg(F.avg(F.col("is_train").cast("int"))).first()[0]
    assert 0.75 < share < 0.85


def test_describe_and_extremes(rows):
    df = rows("a double, d string", (1.0, "x"), (5.0, "y"), (5.0, "w"), (None, "z"))
    r = agg.describe(df, ["a"]).first()
    assert (r.n, r.min, r.max, r.q50) == (3, 1.0, 5.0, 5.0)
    out = {x.kind: (x.d, x.a) for x in agg.extremes(df, "a", "d").collect()}
    assert out == {"max": ("w", 5.0), "min": ("x", 1.0)}
