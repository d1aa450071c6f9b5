import pytest
from pyspark.sql import functions as F

from panelforge.binding import Binding
from panelforge.operators import cleaning
from panelforge.operators.aggregates import mode_per_column, null_counts

B = Binding(("city",), "t", ("id",))
SCHEMA = "id int, city string, t string, v double, kind string"


def by_id(df, *names):
    return {r["id"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_dedupe_keeps_the_first_and_handles_copies_and_null_times(rows):
    df = rows(
        SCHEMA, (1, "a", "x", 1.0, "p"), (1, "a", "x", 1.0, "p"), (2, "a", "x", 2.0, "q"),
        (3, "a", None, 3.0, "r"), (4, "a", None, 4.0, "s"), (5, "b", "x", None, None),
    )
    assert by_id(cleaning.dedupe(df, B), "v", "kind") == {1: (1.0, "p"), 3: (3.0, "r"), 5: (None, None)}


def test_median_of_the_city_then_of_all_after_the_first_fill(rows):
    df = rows(
        SCHEMA, (1, "a", "1", 1.0, "p"), (2, "a", "2", 3.0, "p"), (3, "a", "3", None, "p"),
        (4, "b", "1", None, "p"), (5, "c", "1", 10.0, "p"),
    )
    filled = by_id(cleaning.impute_median(df, ["city"], ["v"]), "v")
    # Known after the first fill: 1, 2, 3, 10; their median is 2.5.
    assert filled == {1: 1.0, 2: 3.0, 3: 2.0, 4: 2.5, 5: 10.0}


def test_mode_ties_and_empty_columns(rows):
    df = rows("id int, a string, b string", (1, "y", None), (2, "x", None), (3, None, None))
    assert {r.column: (r.mode, r.n) for r in mode_per_column(df, ["a", "b"]).collect()} == {"a": ("x", 1)}
    out = by_id(cleaning.impute_mode(df, ["a", "b"]), "a", "b")
    assert out == {1: ("y", "Unknown"), 2: ("x", "Unknown"), 3: ("x", "Unknown")}
    assert {r.column: r.missing for r in null_counts(df).collect()} == {"id": 0, "a": 1, "b": 3}


def test_winsorize_skips_columns_without_spread_and_keeps_hard_limits(rows):
    data = [(i, 0.0 if i < 95 else 50.0, float(i % 10), 1000.0 if i == 99 else float(i % 7)) for i in range(100)]
    df = rows("id int, rain double, cloud double, wind double", *data)
    out = cleaning.winsorize(df, ["rain", "cloud", "wind"], hard={"wind": (0.0, 20.0), "cloud": (0.0, 5.0)})
    top = out.agg(F.max("rain"), F.max("cloud"), F.max("wind")).first()
    assert top[0] == 50.0  # the quartiles coincide, so there is no fence
    assert top[1] == 5.0 and top[2] == 20.0
    counts = {r.column: r.capped for r in cleaning.capped_counts(
        df, ["rain", "cloud", "wind"], hard={"wind": (0.0, 20.0), "cloud": (0.0, 5.0)}).collect()}
    assert counts == {"rain": 0, "cloud": 40, "wind": 1}


def test_tail_quantile_widens_the_fence(rows):
    df = rows("v double", *[(float(i),) for i in range(1000)], (10_000.0,))
    bounds = cleaning.winsor_bounds(df, ["v"], multiplier=0.1, hard={}).first()
    assert bounds.low_0 == pytest.approx(1.0) and bounds.high_0 == pytest.approx(999.0)


def test_standardize_uses_the_population_deviation(rows):
    df = rows("v double, same double, latitude double", (1.0, 4.0, 9.0), (3.0, 4.0, 8.0))
    out = sorted(tuple(r) for r in cleaning.standardize(df).collect())
    assert out == [(-1.0, 0.0, 9.0), (1.0, 0.0, 8.0)]


def test_label_codes_follow_byte_order(rows):
    df = rows("x string", *[(v,) for v in ("b", "B", "", "a", "b", None)])
    codes = {r.label: r.code for r in cleaning.label_codes(df, "x").collect()}
    assert codes == {"": 0, "B": 1, "a": 2, "b": 3, "nan": 4}


def test_label_codes_are_dense_over_many_ranges(spark):
    df = spark.range(5000).select(F.format_string("c%05d", F.col("id")).alias("x"))
    codes = cleaning.label_codes(df, "x").orderBy("label").toPandas()
    assert codes["code"].tolist() == list(range(5000))
