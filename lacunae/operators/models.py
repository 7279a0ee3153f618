"""Models on the full feature set: exact ridge, and a small autoregression. Trees are in trees.py."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_order, so_far
from .blocked import numbered, with_halo
from .grid import KEYS


def fit_ridge(train: DataFrame, features: list[str], alpha: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    """keys, intercept, weights: ridge on features standardised by their population deviation, for all series in one aggregate.

    Sums, products and counts are map-side aggregates; only a matrix of features x features a series reaches the solver.
    """
    cols = [*features, "target"]
    got = train.dropna(subset=cols).groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("mean"), F.array(*[F.covar_pop(x, y) for x, y in _pairs(cols)]).alias("cov"))

    @F.pandas_udf("struct<intercept double, weights array<double>>")
    def solve(count: pd.Series, mean: pd.Series, cov: pd.Series) -> pd.DataFrame:
        rows = []
        for m, mu, c in zip(count, mean, cov, strict=True):
            w = _weights(m, _matrix(c, len(mu)), alpha)
            rows.append((float(mu[-1] - w @ np.asarray(mu[:-1])), w.tolist()))
        return pd.DataFrame(rows, columns=["intercept", "weights"])

    return got.select(*keys, solve("n", "mean", "cov").alias("m")).select(*keys, "m.intercept", "m.weights")


def _pairs(cols: list) -> list[tuple]:
    return [(x, y) for i, x in enumerate(cols) for y in cols[i:]]


def _matrix(cov, n: int) -> np.ndarray:
    """The covariances of n columns, the target last, from those of _pairs."""
    s = np.zeros((n, n))
    for (i, j), x in zip(_pairs(range(n)), cov, strict=True):
        s[i, j] = s[j, i] = x
    return s


def _weights(m: float, s: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge weights of m rows with covariances s (the target last), on the features' own scales."""
    sd = np.sqrt(np.diag(s)[:-1])
    sd[sd == 0] = 1
    z = s[:-1, :-1] / np.outer(sd, sd)
    return np.linalg.solve(z * m + alpha * np.eye(len(sd)), s[:-1, -1] / sd * m) / sd


def moments(cols: list[str], strict: Column, error: Column) -> Column:
    """n, mean, cov (of features, the target last) and the mean square of `error`, of the rows that have all cols; where strict, without NaN in them
    (as fit_ridge leaves them out)."""
    some = F.lit(True)
    for c in cols:
        some = some & F.col(c).isNotNull() & ~(strict & F.isnan(c))
    at = lambda c: F.when(some, c)
    return F.struct(F.count(at(F.lit(1))).alias("n"), F.array(*[F.avg(at(F.col(c))) for c in cols]).alias("mean"), F.array(*[F.covar_pop(at(F.col(x)), at(F.col(y))) for x, y in _pairs(cols)]).alias("cov"), F.avg(at(error * error)).alias("square"))


def ridge_error(train: str, test: str, alpha: float = 1.0) -> Column:
    """Mean squared error on test rows of the ridge fitted to training rows, from the moments of either; null where one has no rows.

    With w and b of the fit, the error's mean is that of the target less b + w x, and its variance y - 2 w xy + w xx w in the test rows' covariances.
    """

    @F.pandas_udf("double")
    def error(m: pd.Series, mean: pd.Series, cov: pd.Series, k: pd.Series, mean_: pd.Series, cov_: pd.Series) -> pd.Series:
        out = []
        for n, mu, c, also, mu_, c_ in zip(m, mean, cov, k, mean_, cov_, strict=True):
            if not n > 0 or not also > 0:
                out.append(None)
                continue
            w, s = _weights(n, _matrix(c, len(mu)), alpha), _matrix(c_, len(mu_))
            off = np.asarray(mu_) - np.asarray(mu)
            out.append(float(np.maximum(0.0, s[-1, -1] - 2 * w @ s[:-1, -1] + w @ s[:-1, :-1] @ w) + (off[-1] - w @ off[:-1]) ** 2))
        return pd.Series(out, dtype="float64")

    return error(*[F.col(f"{x}.{c}") for x in (train, test) for c in ("n", "mean", "cov")])


def predict_ridge(df: DataFrame, model: DataFrame, features: list[str], keys: list[str] = KEYS) -> DataFrame:
    value = F.col("intercept")
    for k, f in enumerate(features):
        value = value + F.col("weights")[k] * F.col(f)
    return df.join(model, keys).withColumn("prediction", value).drop("intercept", "weights")


#: Rows back from which on an autoregression's errors count as 0, and bound of the moving-average weight, within which it can be inverted.
ERRORS, THETA = 30, 0.9


def arma_coefficients(rows: DataFrame) -> DataFrame:
    """p1, p2, theta of an ARMA(2, 1) from autocovariances c0 to c3; null where there is no variance.

    An autoregression of order 3 by Yule-Walker, then the ARMA whose own autoregressive form has its coefficients a1, a2, a3:
    theta = -a3 / a2 (within +-THETA), p1 = a1 - theta, p2 = a2 + theta a1.
    """
    r = rows.where("true")
    for k in (1, 2, 3):
        r = r.withColumn(f"_r{k}", F.when(F.col("c0") > 1e-12, F.col(f"c{k}") / F.col("c0")))
    # Durbin-Levinson, order by order
    r = r.withColumn("_f2", (F.col("_r2") - F.col("_r1") * F.col("_r1")) / (1 - F.col("_r1") * F.col("_r1")))
    r = r.withColumn("_b1", F.col("_r1") * (1 - F.col("_f2")))
    den = 1 - F.col("_b1") * F.col("_r1") - F.col("_f2") * F.col("_r2")
    r = r.withColumn("_a3", (F.col("_r3") - F.col("_b1") * F.col("_r2") - F.col("_f2") * F.col("_r1")) / den)
    r = r.withColumns({"_a1": F.col("_b1") - F.col("_a3") * F.col("_f2"), "_a2": F.col("_f2") - F.col("_a3") * F.col("_b1")})
    theta = F.greatest(F.lit(-THETA), F.least(F.lit(THETA), F.when(F.col("_a2") == 0, 0.0).otherwise(-F.col("_a3") / F.col("_a2"))))
    r = r.withColumn("theta", theta).withColumns({"p1": F.col("_a1") - F.col("theta"), "p2": F.col("_a2") + F.col("theta") * F.col("_a1")})
    return r.drop(*[c for c in r.columns if c.startswith("_") and c not in rows.columns])


def arma_predictions(segmented: DataFrame, horizon: int, window: int = 301, least: int = 30, keys: list[str] = KEYS) -> DataFrame:
    """segmented (keys, seg, t, v) with prediction: the ARMA forecast `horizon` rows ahead from the last `window` rows of the segment, null where
    there are fewer than `least` or no variance.

    Autocovariances slide: running sums of values and of products of neighbours, less what they were a window ago, in blocks of rows with
    a halo. The errors of the last ERRORS rows come from lags. All in column expressions.
    """
    seg = [*keys, "seg"]
    own = [*seg, "_blk"]
    d = with_halo(numbered(segmented, seg), window + ERRORS, 0)
    order, here = in_order(own), so_far(own)
    lag = lambda c, n: F.lag(c, n).over(order)
    d = d.withColumn("_m", F.least(F.lit(window), F.col("_r") + 1).cast("double"))
    sums = {"_s": F.sum("v").over(here)} | {f"_q{k}": F.coalesce(F.sum(F.col("v") * (lag("v", k) if k else F.col("v"))).over(here), F.lit(0.0)) for k in range(4)}
    d = d.withColumns(sums)
    slide = {"_s1": F.col("_s") - F.coalesce(lag("_s", window), F.lit(0.0))} | {f"_w{k}": F.col(f"_q{k}") - F.coalesce(lag(f"_q{k}", window - k), F.lit(0.0)) for k in range(4)}
    # the first three values of the window: those of the segment while it is shorter, else those a window ago
    first = {f"_e{k}": F.when(F.col("_r") + 1 <= window, F.nth_value("v", k + 1).over(here)).otherwise(lag("v", window - 1 - k)) for k in range(3)}
    d = d.withColumns(slide | first | {"_back": F.array(*[F.col("v") if k == 0 else lag("v", k) for k in range(ERRORS + 3)])})
    d = d.withColumn("_mu", F.col("_s1") / F.col("_m"))
    cov = {}
    for k in range(4):
        early = sum((F.col(f"_e{i}") for i in range(k)), F.lit(0.0))
        late = sum((F.col("_back")[i] for i in range(k)), F.lit(0.0))
        cov[f"c{k}"] = (F.col(f"_w{k}") - F.col("_mu") * (2 * F.col("_s1") - early - late) + (F.col("_m") - k) * F.col("_mu") * F.col("_mu")) / F.col("_m")
    d = arma_coefficients(d.where(F.col("_own")).withColumns(cov))
    z = F.expr("transform(_back, x -> x - _mu)")
    u = F.expr(f"transform(sequence({ERRORS}, 0, -1), j -> coalesce(_z[j] - p1 * _z[j + 1] - p2 * _z[j + 2], 0D))")
    d = d.withColumn("_z", z).withColumn("_u", u).withColumn("_e", F.expr("aggregate(_u, 0D, (e, x) -> x - theta * e)"))
    before, now = F.col("_z")[1], F.col("_z")[0]
    ahead = F.col("p1") * now + F.col("p2") * before + F.col("theta") * F.col("_e")
    for _ in range(horizon - 1):
        ahead, now, before = F.col("p1") * ahead + F.col("p2") * now, ahead, now
    return d.withColumn("prediction", F.when(F.col("_m") >= least, F.col("_mu") + ahead)).select(*segmented.columns, "prediction")
