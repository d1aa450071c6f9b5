from datetime import datetime, timedelta

from pyspark.sql import functions as F

from panelforge.binding import Binding
from panelforge.streaming import arrivals, daily_means, deduped, finished

B = Binding(("k",), "ts", ("id",), ("v",))
START = datetime(2024, 3, 1)


def put(spark, folder, rows):
    spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v double").coalesce(1).write.mode("append").parquet(folder)


def observed(day, n, first=0):
    return [("ab"[i % 2], START + timedelta(days=day, minutes=7 * i), first + i, float(i)) for i in range(n)]


def test_duplicates_across_batches_and_a_second_run(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "k string, ts timestamp_ntz, id long, v double"

    def run():
        return finished(deduped(arrivals(spark, folder, schema, "ts", "1 day", files=1), B), out)

    put(spark, folder, observed(0, 40) + observed(0, 5))
    put(spark, folder, observed(0, 40, 1000))
    put(spark, folder, [(None, START, 1, 1.0), (None, START, 2, 1.0)])
    got = run()
    assert got.count() == 41 and got.select("k", "ts").distinct().count() == 41
    assert run().count() == 41  # nothing new, nothing again
    put(spark, folder, observed(0, 45, 2000))
    assert run().count() == 46


def test_days_close_once_and_late_rows_stay_out(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "k string, ts timestamp_ntz, id long, v double"

    def run():
        stream = arrivals(spark, folder, schema, "ts", "1 day", files=1)
        return finished(daily_means(stream, ["k"], "ts", {"mean": F.col("v")}), out)

    put(spark, folder, observed(0, 50))
    assert run().count() == 0  # the day may still go on
    put(spark, folder, observed(1, 20) + observed(0, 10, 500))  # late, but within a day
    put(spark, folder, observed(3, 4))
    days = {(r.k, r.date.day): (r.n, r["mean"]) for r in run().collect()}
    want = {}
    for k, ts, _, v in observed(0, 50) + observed(0, 10) + observed(1, 20):
        want.setdefault((k, ts.day), []).append(v)
    assert days == {at: (len(v), sum(v) / len(v)) for at, v in want.items()}
    put(spark, folder, observed(0, 6, 900))  # too late
    put(spark, folder, observed(6, 2))
    after = {(r.k, r.date.day): r.n for r in run().collect()}
    assert {at: n for at, n in after.items() if at in days} == {at: n for at, (n, _) in days.items()}
    assert after[("a", 4)] == 2


def test_rows_without_a_time(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "k string, ts timestamp_ntz, id long, v double"
    put(spark, folder, [("a", None, 1, 1.0), ("a", None, 2, 3.0), ("a", START, 3, 5.0), ("a", START, 4, 5.0)])
    put(spark, folder, observed(4, 1))
    assert sorted((r.k, r.ts is None) for r in finished(deduped(arrivals(spark, folder, schema, "ts", "1 day", 1), B), f"{tmp_path}/a").collect()) == [
        ("a", False), ("a", False), ("a", True)]
    stream = arrivals(spark, folder, schema, "ts", "1 day", 1)
    assert [(r.date.day, r.n) for r in finished(daily_means(stream, ["k"], "ts", {"m": F.col("v")}), f"{tmp_path}/b").collect()] == [(1, 2)]


def test_rows_without_a_time_after_the_first_batch(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "k string, ts timestamp_ntz, id long, v double"
    timed = [("a", START + timedelta(days=i), i, 1.0) for i in range(4)]
    for rows in ([timed[0]], [timed[1]], [timed[2], ("b", None, 10, 1.0), ("b", None, 11, 1.0)], [timed[3], ("b", None, 12, 1.0)]):
        put(spark, folder, rows)
    got = finished(deduped(arrivals(spark, folder, schema, "ts", "1 day", 1), B), f"{tmp_path}/a").collect()
    assert sorted(r.id for r in got if r.ts is not None) == [0, 1, 2, 3]
    assert sorted(10 if r.id < 12 else 11 for r in got if r.ts is None) == [10, 11]
