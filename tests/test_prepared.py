"""Scaling and label codes come back; a constant column and missing labels included."""

from pyspark.sql import functions as F

from panelforge.operators import cleaning


def test_scaling_comes_back(rows):
    df = rows("i int, v double, c double", (1, 1.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0), (4, -2.5, None))
    stats = cleaning.scaling_stats(df, ["v", "c"])
    back = cleaning.unstandardize(cleaning.standardize(df, ["v", "c"]), stats, ["v", "c"])
    for a, b in zip(df.orderBy("i").collect(), back.orderBy("i").collect()):
        for x, y in zip(a[1:], b[1:]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-12)


def test_labels_come_back(rows):
    df = rows("i int, s string", (1, "b"), (2, "a"), (3, None), (4, "b"))
    codes = cleaning.label_codes(df, "s")
    coded = cleaning.encode_labels(df, ["s"]).drop("s")
    back = cleaning.decode_labels(coded, codes, "s").orderBy("i").select("i", "s").collect()
    assert [r.s for r in back] == ["b", "a", "nan", "b"]
    unknown = coded.withColumn("s_encoded", F.lit(99))
    assert {r.s for r in cleaning.decode_labels(unknown, codes, "s").collect()} == {None}
