"""Errors, skill, the four arms and what the evaluation's bias is made of.

A: gap-aware features on valid rows; B: naive features on A's rows; C: naive features on all rows of A's calendar window;
D: C's model scored on A's test rows. Bias C - A = (B - A) features + (D - B) training + (C - D) composition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rmse, skill
from .grid import KEYS


def error_summary(df: DataFrame, prediction: Column, keys: list[str] = KEYS) -> DataFrame:
    """n, rmse, mae of predictions of target."""
    e = F.col("target") - prediction
    return df.groupBy(*keys).agg(F.count(e).alias("n"), rmse(e).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def fit_ridge1(train: DataFrame, x: str = "lag_0", alpha: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    """Ridge on one standardised feature (population deviation), per series: intercept + slope * (x - mean).

    Sums are those of the centred series, so one pass of aggregates fits every series at once.
    """
    mean, var, n = F.avg(x), F.var_pop(x), F.count("*")
    cov = F.covar_pop(x, "target")
    slope = F.when(var > 0, n * cov / (n * var + alpha * var) ).otherwise(0.0)
    return train.groupBy(*keys).agg(mean.alias("_mx"), F.avg("target").alias("_my"), slope.alias("_b"))


def predict_ridge1(df: DataFrame, model: DataFrame, x: str = "lag_0", keys: list[str] = KEYS) -> DataFrame:
    return df.join(model, keys).withColumn("prediction", F.col("_my") + F.col("_b") * (F.col(x) - F.col("_mx"))).drop("_mx", "_my", "_b")


def skill_summary(scored: DataFrame, keys: list[str] = KEYS, persistence: str = "v") -> DataFrame:
    """n, rmse of model and persistence, and skill in percent."""
    em, ep = F.col("target") - F.col("prediction"), F.col("target") - F.col(persistence)
    sm, sp = F.sum(em * em), F.sum(ep * ep)
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), rmse(em).alias("rmse_m"), rmse(ep).alias("rmse_p"), skill(sm, sp).alias("skill"))


def decompose(skills: DataFrame) -> DataFrame:
    """feature, training, composition, total from skill_a, skill_b, skill_c, skill_d."""
    a, b, c, d = (F.col(f"skill_{x}") for x in "abcd")
    return skills.select("*", (b - a).alias("feature"), (d - b).alias("training"), (c - d).alias("composition"), (c - a).alias("total"))


def four_arms(aware: DataFrame, naive: DataFrame, x_aware: str, x_naive: str, keys: list[str] = KEYS) -> DataFrame:
    """Skills of the arms and their decomposition. aware, naive: splits with target, v and the arms' feature columns.

    aware rows must carry both features; C's rows are naive's. Each arm is one fit and one aggregate for all series.
    """
    train, test = "split = 'train'", "split = 'test'"
    a = predict_ridge1(aware.where(test), fit_ridge1(aware.where(train), x_aware, keys=keys), x_aware, keys)
    b = predict_ridge1(aware.where(test), fit_ridge1(aware.where(train), x_naive, keys=keys), x_naive, keys)
    scored = predict_ridge1(naive.where(test), fit_ridge1(naive.where(train), x_naive, keys=keys), x_naive, keys)
    d = scored.join(aware.where(test).select(*keys, "t"), [*keys, "t"], "left_semi")
    out = None
    for name, arm in (("a", a), ("b", b), ("c", scored), ("d", d)):
        s = skill_summary(arm, keys).select(*keys, F.col("skill").alias(f"skill_{name}"), F.col("n").alias(f"n_{name}"))
        out = s if out is None else out.join(s, keys)
    return decompose(out)


def arm_rows(design: DataFrame, aware: list[str], naive: list[str], keep: tuple[str, ...] = (), keys: list[str] = KEYS, only: str = "abc") -> DataFrame:
    """keys, t, v, target, in_a (a test row of A), arm (a, b, c), role (train, test), x0, x1, ...: the rows of all arms in one frame.

    design: rows with split_a and split_c and the features of both designs.
    """
    arm = lambda name, role, xs: F.struct(F.lit(name).alias("arm"), F.col(role).alias("role"), F.array(*xs).alias("x"))
    of = {"a": arm("a", "split_a", aware), "b": arm("b", "split_a", naive), "c": arm("c", "split_c", naive)}
    arms = F.explode(F.array(*[of[a] for a in only]))
    long = design.select(*keys, "t", "v", "target", *keep, (F.coalesce(F.col("split_a") == "test", F.lit(False))).alias("in_a"), arms.alias("_arm")).where("_arm.role is not null")
    return long.select(*keys, "t", "v", "target", *keep, "in_a", "_arm.arm", "_arm.role", *[F.col("_arm.x")[k].alias(f"x{k}") for k in range(len(aware))])


def arm_skills(predicted: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Skills, rows and errors of the four arms and their decomposition, in one aggregate. predicted: test rows of arm_rows with prediction.

    D is C's predictions on A's rows. Rows without a prediction don't count.
    """
    p = predicted.where("prediction is not null")
    em, ep = F.col("target") - F.col("prediction"), F.col("target") - F.col("v")
    rows = {"a": F.col("arm") == "a", "b": F.col("arm") == "b", "c": F.col("arm") == "c", "d": (F.col("arm") == "c") & F.col("in_a")}
    part = lambda c, x: F.sum(F.when(c, x))
    out = []
    for k, c in rows.items():
        out += [skill(part(c, em * em), part(c, ep * ep)).alias(f"skill_{k}"), F.count(F.when(c, 1)).alias(f"n_{k}")]
    out += [F.sqrt(F.avg(F.when(rows[k], e * e))).alias(f"rmse_{x}_{k}") for k in "ac" for x, e in (("p", ep), ("m", em))]
    return decompose(p.groupBy(*keys).agg(*out))


def lead_time_channels(predicted: DataFrame, horizon: int, step: int, keys: list[str] = KEYS) -> DataFrame:
    """C's test rows by class: valid (A's rows), input-only (the target lies `horizon` steps ahead, the inputs reach over a gap) and
    target-crossing. Counts, error ratios to valid rows, skills D (valid), E (with input-only), C (all), and what each class adds.

    predicted: rows of arm c with t, target_t, in_a and prediction.
    """
    late = F.col("target_t") - F.col("t") != horizon * step
    valid, inputs, crossing = F.col("in_a"), ~F.col("in_a") & ~late, ~F.col("in_a") & late
    em, ep = F.col("target") - F.col("prediction"), F.col("target") - F.col("v")
    mean = lambda c, e: F.sqrt(F.avg(F.when(c, e * e)))
    of = lambda c: skill(F.sum(F.when(c, em * em)), F.sum(F.when(c, ep * ep)))
    out = predicted.where("prediction is not null").groupBy(*keys).agg(
        *[F.count(F.when(c, 1)).alias(f"n_{n}") for n, c in (("valid", valid), ("input_only", inputs), ("target_crossing", crossing))],
        *[(mean(c, e) / mean(valid, e)).alias(f"rho_{x}_{n}") for n, c in (("input_only", inputs), ("target_crossing", crossing)) for x, e in (("p", ep), ("m", em))],
        of(valid).alias("skill_d"), of(valid | inputs).alias("skill_e"), of(F.lit(True)).alias("skill_c"),
    )
    return out.withColumns({"comp_total": F.col("skill_c") - F.col("skill_d"), "comp_input_only": F.col("skill_e") - F.col("skill_d"), "comp_target_crossing": F.col("skill_c") - F.col("skill_e")})


def injection_mixture(runs: DataFrame, depth: int, horizon: Column) -> DataFrame:
    """f, rho_p, rho_m, bias_hat (the exact identity) and f_design of injected runs whose exposure is above 0 and whose displaced rows'
    mean squared errors, as the identity gives them, are positive.

    runs: n_a, n_c, rmse_p_a, rmse_m_a, rmse_p_c, rmse_m_c, missing (share), mean_gap.
    """
    d = runs.withColumn("f", 1 - F.col("n_a") / F.col("n_c")).where("f > 1e-6")
    hidden = lambda x: (F.col(f"rmse_{x}_c") * F.col(f"rmse_{x}_c") - (1 - F.col("f")) * F.col(f"rmse_{x}_a") * F.col(f"rmse_{x}_a")) / F.col("f")
    d = d.withColumn("_p", hidden("p")).withColumn("_m", hidden("m")).where("_p > 0 and _m > 0")
    d = d.withColumn("rho_p", F.sqrt("_p") / F.col("rmse_p_a")).withColumn("rho_m", F.sqrt("_m") / F.col("rmse_m_a")).drop("_p", "_m")
    over = lambda x: 1 + F.col("f") * (F.col(f"rho_{x}") * F.col(f"rho_{x}") - 1)
    d = d.withColumn("bias_hat", 100 * F.col("rmse_m_a") / F.col("rmse_p_a") * (1 - F.sqrt(over("m") / over("p"))))
    return d.withColumn("f_design", design_exposure(F.col("missing"), depth, horizon, F.col("mean_gap")))


def channel_shares(parts: DataFrame, by: list[str]) -> DataFrame:
    """Shares of feature, training and composition, pooled by mean absolute value and by signed sum; null where all are 0."""
    names = ("feature", "training", "composition")
    def shares(method: str, value):
        agg = parts.groupBy(*by).agg(*[value(n).alias(n) for n in names], value("total").alias("total"))
        whole = F.abs(F.col("feature")) + F.abs(F.col("training")) + F.abs(F.col("composition"))
        return agg.select(*by, F.lit(method).alias("method"), *names, "total", *[F.when(whole > 0, 100 * F.abs(F.col(n)) / whole).alias(f"share_{n}") for n in names])

    return shares("mean_abs", lambda n: F.avg(F.abs(F.col(n)))).unionByName(shares("signed_sum", lambda n: F.sum(n)))


def mixture_identity(df: DataFrame) -> DataFrame:
    """Exposure f, error ratios of displaced to valid rows, composition by the exact identity and to first order.

    df: n_valid, n_displaced, mp_valid, mp_displaced (mean squared persistence errors), mm_valid, mm_displaced (model).
    """
    f = F.col("n_displaced") / (F.col("n_valid") + F.col("n_displaced"))
    rho2 = lambda k: F.col(f"{k}_displaced") / F.col(f"{k}_valid")
    base = F.sqrt(F.col("mm_valid") / F.col("mp_valid"))
    out = df.withColumn("f", f).withColumn("rho_p", F.sqrt(rho2("mp"))).withColumn("rho_m", F.sqrt(rho2("mm")))
    exact = 100 * base * (1 - F.sqrt((1 - f + f * rho2("mm")) / (1 - f + f * rho2("mp"))))
    first = 50 * base * f * (rho2("mp") - rho2("mm"))
    return out.withColumn("exact", exact).withColumn("first_order", first)


def design_exposure(p: Column, depth: int, horizon: int | Column, gap: Column) -> Column:
    """Expected exposure of a missing share p in gaps of a given length."""
    return F.least(F.lit(1.0), p * (depth + horizon) / ((1 - p) * gap))


def turbine_power(v: Column, density: float = 1.225, area: float = 1.0, cp: float = 0.4) -> Column:
    """Power in the wind that a rotor takes: density * area * cp * v^3 / 2; its slope in v is 3 P / v."""
    return 0.5 * density * area * cp * v * v * v
