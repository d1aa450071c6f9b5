"""Ensembles of forecasts: chosen and weighted on a first window, judged on the rest.

``keys`` name the series (and target); each has a few dozen test days per
model, so the windows and groups here are small and spread over the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.binding import col
from panelforge.operators.aggregates import regression_metrics
from panelforge.operators.windows import top_per_group
from panelforge.session import durable

TOP = 3
TIE_DIGITS = 6


def by_rmse() -> list[Column]:
    """Order of models: RMSE, then name. Errors equal to six decimals tie, so that the
    order in which an engine adds up the same errors does not decide a ranking."""
    return [F.round("rmse", TIE_DIGITS), F.col("model")]


def split(
    predictions: DataFrame, keys: Sequence[str], date: str = "date", cut: bool = True
) -> DataFrame:
    """Mark the first third of the days of each key as ``is_blend``; one row per day and model.

    The marked rows are few and read many times (to choose, weigh and judge), so
    ``cut`` writes them down instead of running the forecasts again each time.
    """
    unique = predictions.dropDuplicates([*keys, date, "model"])
    w = Window.partitionBy(*[col(k) for k in keys])
    ranked = unique.withColumn("_d", F.dense_rank().over(w.orderBy(date)))
    days = F.max("_d").over(w)
    marked = ranked.withColumn("is_blend", F.col("_d") <= F.floor(days / 3)).drop("_d")
    return durable(marked) if cut else marked


def blend_rmse(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    error = F.col("y_true") - F.col("y_pred")
    return marked.where("is_blend").groupBy(*[col(k) for k in keys], "model").agg(
        F.sqrt(F.avg(error * error)).alias("rmse")
    )


def select_top(marked: DataFrame, keys: Sequence[str], n: int = TOP) -> DataFrame:
    """Best models of each key by RMSE on the blend window, with inverse-RMSE weights."""
    best = top_per_group(
        blend_rmse(marked, keys), keys, by_rmse(), n, rank="rank"
    )
    inverse = 1 / F.greatest(F.col("rmse"), F.lit(1e-12))
    total = F.sum(inverse).over(Window.partitionBy(*[col(k) for k in keys]))
    return best.withColumn("weight", inverse / total)


def _combine(
    marked: DataFrame, top: DataFrame, keys: Sequence[str], date: str, name: str, how
) -> DataFrame:
    chosen = marked.where(~F.col("is_blend")).join(
        top.select(*[col(k) for k in keys], "model", "weight"), [*keys, "model"]
    )
    return chosen.groupBy(*[col(k) for k in keys], date).agg(
        F.lit(name).alias("model"), F.first("y_true").alias("y_true"), how.alias("y_pred")
    )


def voting(marked: DataFrame, top: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Plain mean of the chosen models."""
    return _combine(marked, top, keys, date, "Voting", F.avg("y_pred"))


def weighted(marked: DataFrame, top: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Mean of the chosen models weighted by inverse RMSE."""
    return _combine(
        marked, top, keys, date, "WeightedAverage", F.sum(F.col("weight") * F.col("y_pred"))
    )


def ridge_columns(df: DataFrame, count: Column, gram: dict[tuple[int, int], Column], rhs: dict[int, Column], alpha: float) -> DataFrame:
    """Ridge coefficients ``_b0``, ``_b1``, ... of each row's system, by a Cholesky factor in expressions.

    ``gram[i, j]`` (i >= j) and ``rhs[i]`` are covariances; times ``count`` they
    are the sums of products about the means. Every entry of the factor is a
    column of its own, so that none is worked out twice.
    """
    m = len(rhs)

    def add(name: str, value: Column) -> None:
        nonlocal df
        df = df.withColumn(name, value)

    def less(value: Column, pairs: list[tuple[str, str]]) -> Column:
        for a, b in pairs:
            value = value - F.col(a) * F.col(b)
        return value

    for j in range(m):
        own = count * gram[j, j] + F.lit(float(alpha))
        add(f"_l{j}_{j}", F.sqrt(less(own, [(f"_l{j}_{k}", f"_l{j}_{k}") for k in range(j)])))
        for i in range(j + 1, m):
            value = less(count * gram[i, j], [(f"_l{i}_{k}", f"_l{j}_{k}") for k in range(j)])
            add(f"_l{i}_{j}", value / F.col(f"_l{j}_{j}"))
    for i in range(m):
        add(f"_z{i}", less(count * rhs[i], [(f"_l{i}_{k}", f"_z{k}") for k in range(i)]) / F.col(f"_l{i}_{i}"))
    for i in reversed(range(m)):
        add(f"_b{i}", less(F.col(f"_z{i}"), [(f"_l{k}_{i}", f"_b{k}") for k in range(i + 1, m)]) / F.col(f"_l{i}_{i}"))
    return df


def stacking(
    marked: DataFrame, keys: Sequence[str], date: str = "date", alpha: float = 1.0
) -> DataFrame:
    """Ridge regression on the predictions of all models, fitted per key on the complete days of the blend window.

    One aggregation gives each key the means of its days and their
    covariances, as many as pairs of models; the system is solved in
    expressions on that one row, written down before and after, so that code
    is generated for each step by itself. The intercept is not penalised. ``alpha`` is above 0.

    A day on which a model is missing is not fitted on and gets NULL; so do
    all days of a key without a complete day. A model without any row under a key takes no part
    there. :func:`unstacked` names the keys and days that are left out.
    """
    by = [col(k) for k in keys]
    names = sorted(r["model"] for r in marked.select("model").distinct().where("model is not null").collect())
    every = range(len(names))

    def sound(c: Column) -> Column:
        return F.when(F.abs(c) < F.lit(float("inf")), c)  # neither NaN nor infinite

    of = [F.when(F.col("model") == n, sound(col("y_pred"))) for n in names]
    days = marked.groupBy(*by, col(date)).agg(
        F.first("is_blend", ignorenulls=True).alias("is_blend"), F.first("y_true", ignorenulls=True).alias("y_true"),
        *[F.max(x).alias(f"_x{i}") for i, x in enumerate(of)], *[F.count_if(F.col("model") == n).alias(f"_n{i}") for i, n in enumerate(names)],
    )
    of_key = Window.partitionBy(*by)
    days = days.withColumns({f"_x{i}": F.when(F.sum(f"_n{i}").over(of_key) > 0, F.col(f"_x{i}")).otherwise(0.0) for i in every})
    complete = F.col("is_blend") & sound(F.col("y_true")).isNotNull()
    for i in every:
        complete = complete & F.col(f"_x{i}").isNotNull()
    x = [F.when(complete, F.col(f"_x{i}")) for i in every]
    y = F.when(complete, F.col("y_true").cast("double"))
    pairs = [(i, j) for i in every for j in range(i + 1)]
    sums = days.groupBy(*by).agg(
        F.count(y).cast("double").alias("_n"), F.avg(y).alias("_my"), *[F.avg(x[i]).alias(f"_m{i}") for i in every],
        *[F.covar_pop(x[i], x[j]).alias(f"_g{i}_{j}") for i, j in pairs], *[F.covar_pop(x[i], y).alias(f"_r{i}") for i in every],
    )
    solved = ridge_columns(durable(sums), F.col("_n"), {p: F.col(f"_g{p[0]}_{p[1]}") for p in pairs}, {i: F.col(f"_r{i}") for i in every}, alpha)
    fits = durable(solved.select(*[col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_my", *[f"_m{i}" for i in every], *[f"_b{i}" for i in every]))
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"_k{n}"))
    predicted = F.col("_my")
    for i in every:
        predicted = predicted + F.col(f"_b{i}") * (F.col(f"_x{i}") - F.col(f"_m{i}"))
    return days.where(~F.col("is_blend")).join(fits, same).select(
        *by, col(date), F.lit("Stacking").alias("model"), F.col("y_true").cast("double").alias("y_true"), predicted.alias("y_pred")
    )


def unstacked(marked: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Days that :func:`stacking` leaves out: ``(keys..., date, is_blend, models)``, models missing or without value.

    A key whose blend days all stand here gets no stacked forecast at all.
    """
    by = [col(k) for k in keys]
    models = marked.groupBy(*by).agg(F.collect_set("model").alias("_all"))
    present = F.collect_set(F.when(F.col("y_pred").isNotNull() & ~F.isnan("y_pred"), F.col("model")))
    days = marked.groupBy(*by, col(date), "is_blend").agg(present.alias("_there"))
    missing = F.array_sort(F.array_except("_all", "_there"))
    out = days.join(models, list(keys)).withColumn("models", missing).where(F.size("models") > 0)
    return out.drop("_all", "_there")


def evaluate(
    marked: DataFrame, keys: Sequence[str], n: int = TOP, date: str = "date", stack: bool = True
) -> DataFrame:
    """Metrics of base models and ensembles on the evaluation window."""
    top = select_top(marked, keys, n)
    columns = [*keys, date, "model", "y_true", "y_pred"]
    parts = marked.where(~F.col("is_blend")).select(*[col(c) for c in columns])
    for extra in (voting(marked, top, keys, date), weighted(marked, top, keys, date)):
        parts = parts.unionByName(extra.select(*[col(c) for c in columns]))
    if stack:
        parts = parts.unionByName(stacking(marked, keys, date).select(*[col(c) for c in columns]))
    return regression_metrics(parts, [*keys, "model"])


def leaderboard(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Models of each key ranked by RMSE."""
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*by_rmse())
    return metrics.withColumn("rank", F.row_number().over(w))


def best_model(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model with the lowest RMSE per key."""
    best = F.min_by(F.struct("rmse", "model", "n"), F.struct(*by_rmse()))
    return metrics.groupBy(*[col(k) for k in keys]).agg(best.alias("_b")).select(
        *[col(k) for k in keys], F.col("_b.model").alias("best_model"),
        F.col("_b.rmse").alias("rmse"), F.col("_b.n").alias("eval_days"),
    )
