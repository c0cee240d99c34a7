"""Calibration and evaluation of scores: logistic calibration, Cllr, EER, AUC, ROC and Tippett tables.

Group keys are always a list of columns (may be empty); targets are booleans. Rows of null score or target never count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.running import running
from glyphmill.session import cut

EPS = 1e-15  # fixed value: keeps odds of probability 1 finite


def log10_odds(p: Column) -> Column:
    return F.log10(p / (1 - p + EPS))


def _usable(df: DataFrame, value: str, target: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(target).isNotNull())


def _log2_1p_pow10(x: Column) -> Column:
    """log2(1 + 10^x) without overflow."""
    t = x * float(np.log(10.0))
    return (F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))) / float(np.log(2.0))


def cllr(df: DataFrame, keys: list[str], llr: str = "llr", target: str = "target") -> DataFrame:
    """``(*keys, cllr)``: cost of log10 likelihood ratios; null where a class is missing."""
    t, x = F.col(target), F.col(llr)
    return _usable(df, llr, target).groupBy(*keys).agg(
        ((F.avg(F.when(t, _log2_1p_pow10(-x))) + F.avg(F.when(~t, _log2_1p_pow10(x)))) / 2).alias("cllr")
    )


def cllr_min(df: DataFrame, keys: list[str], llr: str = "llr", target: str = "target", low: float = -10.0, high: float = 10.0, steps: int = 1001) -> DataFrame:
    """``(*keys, cllr_min)``: least Cllr over equally spaced additive offsets. Equal ratios are counted together first."""
    rows = _usable(df, llr, target).groupBy(*keys, F.col(llr).alias("_x"), F.col(target).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    shift = F.lit(low) + F.col("_k") * ((high - low) / (steps - 1))
    grid = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("_y", F.col("_x") + shift)
    t, n = F.col("_t"), F.col("_n")
    side = lambda c, cost: F.sum(F.when(c, n * cost)) / F.sum(F.when(c, n))
    per = grid.groupBy(*keys, "_k").agg(((side(t, _log2_1p_pow10(-F.col("_y"))) + side(~t, _log2_1p_pow10(F.col("_y")))) / 2).alias("_c"))
    return per.groupBy(*keys).agg(F.min("_c").alias("cllr_min"))


def operating_points(df: DataFrame, keys: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """``(*keys, threshold, pos, neg, tp, fp, n_pos, n_neg, tpr, fpr)`` for every distinct score taken as threshold (score >= threshold); ``pos`` and ``neg`` are the trials of that score.

    Equal scores are counted together before anything is ordered; a group of very many scores is spread over tasks.
    """
    per = _usable(df, score, target).groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.count(F.when(F.col(target), 1)).alias("pos"), F.count(F.when(~F.col(target), 1)).alias("neg")
    )
    pts = running(per, keys, [F.desc("threshold")], {"tp": "pos", "fp": "neg"}, "_rank").drop("_rank")
    whole = per.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pts = pts.join(whole, keys) if keys else pts.crossJoin(whole)  # one row a group
    return pts.withColumn("tpr", F.try_divide("tp", "n_pos")).withColumn("fpr", F.try_divide("fp", "n_neg"))


def auc(points: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, auc)``: area under the operating points; ties count half. Null where a class is missing."""
    area = points.select(*keys, "n_pos", "n_neg", (F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0).alias("_a"))
    return area.groupBy(*keys).agg(F.try_divide(F.sum("_a"), F.max("n_pos") * F.max("n_neg").cast("double")).alias("auc"))


def eer(points: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, eer)``: false-positive rate where it is nearest to the false-negative rate, the point without any acceptance included;
    of equals the higher threshold's. All points are used, also those on straight lines."""
    gap = lambda tpr, fpr: F.abs(1 - tpr - fpr)
    best = F.min(F.struct(gap(F.col("tpr"), F.col("fpr")).alias("gap"), (-F.col("threshold")).alias("t"), F.col("fpr").alias("fpr")))
    e = points.where("n_pos > 0 and n_neg > 0").groupBy(*keys).agg(best.alias("b"))
    return e.select(*keys, F.when(F.col("b.gap") < 1.0, F.col("b.fpr")).otherwise(F.lit(0.0)).alias("eer"))


def eer_interpolated(points: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, eer)``: where the line through neighbouring operating points meets 1 - fpr = tpr."""
    before = lambda all_, own, n: (F.col(all_) - F.col(own)) / F.col(n)
    seg = points.where("n_pos > 0 and n_neg > 0").select(*keys, "tpr", "fpr", before("tp", "pos", "n_pos").alias("t0"), before("fp", "neg", "n_neg").alias("f0"))
    a, b = 1 - F.col("f0") - F.col("t0"), 1 - F.col("fpr") - F.col("tpr")
    cross = seg.where((a >= 0) & (b <= 0))
    at = F.col("f0") + (F.col("fpr") - F.col("f0")) * F.coalesce(F.try_divide(a, a - b), F.lit(0.0))
    return cross.groupBy(*keys).agg(F.min(at).alias("eer"))


def youden(points: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, threshold, tpr, fpr, tp, fp, tn, fn, accuracy, f1)`` at the threshold of the greatest tpr - fpr (of equals the highest)."""
    best = points.where("n_pos > 0 and n_neg > 0").groupBy(*keys).agg(
        F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), F.col("threshold"), "tpr", "fpr", "tp", "fp", "n_pos", "n_neg")).alias("b")
    )
    b = lambda c: F.col(f"b.{c}")
    tn, fn = b("n_neg") - b("fp"), b("n_pos") - b("tp")
    return best.select(
        *keys, *[b(c).alias(c) for c in ("threshold", "tpr", "fpr", "tp", "fp")], tn.alias("tn"), fn.alias("fn"),
        ((b("tp") + tn) / (b("n_pos") + b("n_neg"))).alias("accuracy"), (2 * b("tp") / (2 * b("tp") + b("fp") + fn)).alias("f1"),
    )


def tippett(df: DataFrame, keys: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """``(*keys, threshold, share_true_at_least, share_false_at_most)`` for every distinct score."""
    p = operating_points(df, keys, score, target)
    below = F.col("n_neg") - F.col("fp") + F.col("neg")
    return p.select(*keys, "threshold", F.col("tpr").alias("share_true_at_least"), F.try_divide(below, F.col("n_neg")).alias("share_false_at_most"))


def confusion(df: DataFrame, keys: list[str], predicted: Column, target: str = "target") -> DataFrame:
    """``(*keys, tp, fp, fn, tn, balanced_accuracy, precision, recall, f1)``; ratios without a denominator are 0."""
    t = F.col(target)
    n = lambda c: F.count(F.when(c, 1))
    c = df.where(t.isNotNull() & predicted.isNotNull()).groupBy(*keys).agg(n(t & predicted).alias("tp"), n(~t & predicted).alias("fp"), n(t & ~predicted).alias("fn"), n(~t & ~predicted).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "*", ((div(tp, tp + fn) + div(tn, tn + fp)) / 2).alias("balanced_accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"),
        div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def metrics_by_probability(df: DataFrame, keys: list[str], p: str = "p", target: str = "target") -> DataFrame:
    """Older profile: decision at 0.5, costs in natural logarithms, least cost from the mean log-odds, interpolated EER."""
    t, x = F.col(target), F.log(F.col(p) / (1 - F.col(p)))
    rows = _usable(df, p, target).where((F.col(p) > 0) & (F.col(p) < 1)).withColumn("_x", x)
    ln_sig = lambda v: -F.log1p(F.exp(-v))
    costs = rows.groupBy(*keys).agg(
        F.avg(F.when(t, F.col("_x"))).alias("mean_true_llr"), (-F.avg(F.when(~t, F.col("_x")))).alias("mean_false_llr"),
        F.count(F.when(t, 1)).alias("true_trials"), F.count(F.when(~t, 1)).alias("false_trials"),
        ((F.avg(F.when(t, ln_sig(F.col("_x")))) + F.avg(F.when(~t, ln_sig(-F.col("_x"))))) * -0.5).alias("cllr"),
    )
    costs = costs.withColumn("cllr_min", (ln_sig(F.col("mean_true_llr")) + ln_sig(F.col("mean_false_llr"))) * -0.5)
    points = operating_points(rows, keys, p, target)
    out = costs
    for part in (confusion(rows, keys, F.col(p) > 0.5, target), auc(points, keys), eer_interpolated(points, keys)):
        out = out.join(part, keys) if keys else out.crossJoin(part)  # without keys each side is a single row
    return out


def _fits(x: np.ndarray, y: np.ndarray, n: np.ndarray, left_out: np.ndarray, penalty: float, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of the logistic fits on (score, class, times) with one trial of each kind of ``left_out`` (places; -1 for none) taken off; the intercept is not penalised."""
    w, b = np.zeros(len(left_out)), np.zeros(len(left_out))
    if len(left_out) > 1 or left_out[0] >= 0:  # they all lie near the fit on all trials
        w0, b0 = _fits(x, y, n, np.array([-1]), penalty, steps)
        w, b = w + w0, b + b0
    off, at = (left_out >= 0).astype(float), np.maximum(left_out, 0)
    ox, oy = x[at], y[at]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[:, None] * x + b[:, None], -500, 500)))
        op = p[np.arange(len(at)), at]
        r, v = n * (p - y), n * p * (1 - p)
        own, ov = off * (op - oy), off * op * (1 - op)
        g0, g1 = r @ x - own * ox + penalty * w, r.sum(axis=1) - own
        h00, h01, h11 = v @ (x * x) - ov * ox * ox + penalty + 1e-12, v @ x - ov * ox, v.sum(axis=1) - ov + 1e-12
        det = h00 * h11 - h01 * h01
        dw, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        size = np.maximum(1.0, np.maximum(np.abs(dw), np.abs(db)) / 10.0)
        w, b = w - dw / size, b - db / size
        if max(np.abs(dw).max(), np.abs(db).max()) < 1e-10:
            break
    return w, b


#: Terms of the series that leave-one-out fits use, and how far a trial's log-odds may move from the fit on all for it to hold to the last digits (it converges up to pi).
TERMS, NEAR = 14, 0.25


def _near_fits(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(w, b, ok)``: for every kind the fit with one of its trials taken off, in time linear in the kinds.

    Such fits lie near the fit on all, so the sums over all trials are a polynomial in how far weight and intercept move: the Taylor series of the logistic function, with moments of the scores
    as coefficients. ``ok`` is false where a fit has not converged or moves any trial's log-odds by more than ``NEAR``; these are to be made in full.
    """
    (w0,), (b0,) = _fits(x, y, n, np.array([-1]), penalty, steps)
    mean, scale = np.average(x, weights=n), max(float(np.abs(x - np.average(x, weights=n)).max()), 1e-300)
    z, p = (x - mean) / scale, 1 / (1 + np.exp(-np.clip(w0 * x + b0, -500, 500)))
    # derivatives of the logistic function are polynomials in its value
    poly, terms = np.array([0.0, 1.0]), [p - y]
    for k in range(1, TERMS + 1):
        poly = np.polynomial.polynomial.polymul(np.polynomial.polynomial.polyder(poly), [0.0, 1.0, -1.0]) / k
        terms.append(np.polynomial.polynomial.polyval(p, poly))
    powers = np.stack([z**j for j in range(TERMS + 3)])
    moments = np.stack([powers @ (n * t) for t in terms])  # [k, j]: sum of n * (k-th coefficient) * z^j
    choose = [[float(math.comb(k, j)) for j in range(k + 1)] for k in range(TERMS + 1)]

    def sums(u: np.ndarray, v: np.ndarray, a: int, derived: int) -> np.ndarray:
        """Sum of n * z^a * (value, or slope if ``derived``) at weight and intercept moved by u and v."""
        out = np.zeros(len(u))
        for k in range(TERMS + 1 - derived):
            row = moments[k + derived] * (k + 1 if derived else 1)
            for j in range(k + 1):
                out += choose[k][j] * row[a + j] * u**j * v ** (k - j)
        return out

    u, v, done = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), bool)
    soft = penalty / scale**2  # weights are in units of the scaled scores
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(w0 * x + b0 + u * z + v, -500, 500)))
        r, s = q - y, q * (1 - q)
        g0, g1 = sums(u, v, 1, 0) - r * z + soft * (w0 * scale + u), sums(u, v, 0, 0) - r
        h00, h01, h11 = sums(u, v, 2, 1) - s * z * z + soft, sums(u, v, 1, 1) - s * z, sums(u, v, 0, 1) - s
        with np.errstate(all="ignore"):
            det = h00 * h11 - h01 * h01
            du, dv = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        good = np.isfinite(du) & np.isfinite(dv) & (np.abs(u - du) + np.abs(v - dv) <= 4 * NEAR)
        u, v = np.where(good, u - du, u), np.where(good, v - dv, v)
        done = good & (np.maximum(np.abs(du), np.abs(dv)) < 1e-11)
        if (done | ~good).all():
            break
    ok = done & (np.abs(u) + np.abs(v) <= NEAR)  # no scaled score is beyond 1
    return w0 + u / scale, b0 + v - u * mean / scale, ok


def fit_logistic(df: DataFrame, keys: list[str], score: str = "score", target: str = "target", c: float | None = 1.0, steps: int = 30) -> pd.DataFrame:
    """Weight and intercept by group, one row a group, by Newton steps whose sums are distributed aggregates.

    ``c`` is the inverse L2 penalty on the weight (None: no penalty; steps are then capped, since separable scores have no finite fit).
    """
    rows = cut(_usable(df, score, target).groupBy(*keys, F.col(score).cast("double").alias("_x"), F.col(target).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_n")))
    spark = df.sparkSession
    fit = rows.select(*keys).distinct().toPandas()
    fit["w"], fit["b"] = 0.0, 0.0
    penalty = 0.0 if c is None else 1.0 / c
    for _ in range(steps):
        if not len(fit):
            break
        params = spark.createDataFrame(fit)
        j = rows.join(F.broadcast(params), keys) if keys else rows.crossJoin(F.broadcast(params))  # one row a group
        p = 1 / (1 + F.exp(-(F.col("w") * F.col("_x") + F.col("b"))))
        x, n = F.col("_x"), F.col("_n")
        v = n * p * (1 - p)
        s = j.groupBy(*keys, "w", "b").agg(
            F.sum(n * (p - F.col("_y")) * x).alias("g0"), F.sum(n * (p - F.col("_y"))).alias("g1"), F.sum(v * x * x).alias("h00"), F.sum(v * x).alias("h01"), F.sum(v).alias("h11")
        ).toPandas()
        h00, h11 = s.h00 + penalty + 1e-12, s.h11 + 1e-12
        g0 = s.g0 + penalty * s.w
        det = h00 * h11 - s.h01 * s.h01
        dw, db = (h11 * g0 - s.h01 * s.g1) / det, (h00 * s.g1 - s.h01 * g0) / det
        size = np.maximum(1.0, np.maximum(dw.abs(), db.abs()) / 10.0)
        s["w"], s["b"] = s.w - dw / size, s.b - db / size
        fit = s[[*keys, "w", "b"]]
        if max(dw.abs().max(), db.abs().max()) < 1e-9:
            break
    return fit


def calibrate(train: DataFrame, test: DataFrame, keys: list[str], score: str = "score", target: str = "target", c: float | None = 1.0) -> DataFrame:
    """``test`` with ``pred_prob`` and ``pred_llr`` (log10 odds with the training prior) from a fit on ``train`` by group."""
    fit = test.sparkSession.createDataFrame(fit_logistic(train, keys, score, target, c))
    j = test.join(F.broadcast(fit), keys) if keys else test.crossJoin(F.broadcast(fit))  # one row a group
    p = 1 / (1 + F.exp(-(F.col("w") * F.col(score) + F.col("b"))))
    return j.withColumn("pred_prob", p).withColumn("pred_llr", log10_odds(F.col("pred_prob"))).drop("w", "b")


#: Kinds of trials left out in one task.
LEFT_OUT = 512
#: Cells of (fit, kind) held at once.
CELLS = 1 << 20


def calibrate_loo(df: DataFrame, keys: list[str], ident: str, score: str = "score", target: str = "target", c: float | None = 1.0, standardise: bool = False, block: int = LEFT_OUT) -> DataFrame:
    """``(*keys, ident, score, target, pred_prob, pred_llr)``: each trial calibrated by a fit on the others of its group.

    Leaving one out needs a fit a trial; equal (score, target) share one. A group of more than ``block`` kinds is fitted by a series about the fit on all (``_near_fits``), in time linear in its kinds; the
    fits of smaller groups, and those that the series does not hold for, are made in full, ``block`` kinds a task against their group's table of (score, class, times), a part of them at once. With ``standardise`` scores
    are first brought to mean 0 and population deviation 1 of the whole group. Where nothing of a class is left the probability is null.
    """
    rows = _usable(df, score, target).select(*keys, ident, score, target, F.col(score).cast("double").alias("_x"))
    if standardise:
        of = rows.groupBy(*keys).agg(F.avg("_x").alias("_m"), F.nullif(F.stddev_pop("_x"), F.lit(0.0)).alias("_d"))
        rows = rows.join(of, keys) if keys else rows.crossJoin(of)  # one row a group
        rows = rows.withColumn("_x", (F.col("_x") - F.col("_m")) / F.coalesce("_d", F.lit(1.0))).drop("_m", "_d")
    rows = cut(rows)
    kinds = rows.groupBy(*keys, "_x", F.col(target).alias("_t")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    tables = cut(kinds.groupBy(*keys).agg(F.collect_list(F.struct("_x", "_t", "_n")).alias("_table")))
    penalty = 0.0 if c is None else 1.0 / c
    schema = ", ".join([*(f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in keys), "_x double, _t boolean, pred_prob double, _ok boolean"])

    def full(x: np.ndarray, y: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = max(1, CELLS // len(x))
        parts = [_fits(x, y, n, at[k : k + size], penalty) for k in range(0, len(at), size)]
        return np.concatenate([w for w, _ in parts]), np.concatenate([b for _, b in parts])

    def fit(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for k in range(batch.num_rows):
                columns = [batch.column(len(keys) + j).slice(k, 1).flatten() for j in range(batch.num_columns - len(keys))]
                table, out = columns[0], columns[-1]  # without kinds of its own all of the table
                x, n = (table.field(f).to_numpy(zero_copy_only=False) for f in ("_x", "_n"))
                y = table.field("_t").to_numpy(zero_copy_only=False).astype(float)
                ox, oy = out.field("_x").to_numpy(zero_copy_only=False), out.field("_t").to_numpy(zero_copy_only=False).astype(float)
                ok = np.ones(len(ox), bool)
                if len(columns) > 1:
                    place = {kind: j for j, kind in enumerate(zip(x.tolist(), y.tolist(), strict=True))}
                    w, b = full(x, y, n, np.array([place[kind] for kind in zip(ox.tolist(), oy.tolist(), strict=True)]))
                elif len(x) <= block:
                    w, b = full(x, y, n, np.arange(len(x)))
                else:
                    w, b, ok = _near_fits(x, y, n, penalty)
                p = 1 / (1 + np.exp(-np.clip(w * ox + b, -500, 500)))
                rest = n[y == 1].sum() - oy, n[y == 0].sum() - (1 - oy)
                bare = (rest[0] <= 0) | (rest[1] <= 0)
                p[bare] = np.nan
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).take(pa.array([k] * len(p))) for j in range(len(keys))), out.field("_x"), out.field("_t"), pa.array(p, from_pandas=True), pa.array(ok | bare)], names=[*keys, "_x", "_t", "pred_prob", "_ok"]
                )

    done = cut(tables.select(*keys, "_table").mapInArrow(fit, schema))
    if (open_ := done.where("not _ok")).limit(1).count():
        sizes = tables.select(*keys, F.ceil(F.size("_table") / block).cast("int").alias("_blocks"))
        left = open_.join(sizes, keys) if keys else open_.crossJoin(sizes)  # one row a group
        left = left.groupBy(*keys, F.pmod(F.xxhash64("_x", "_t"), "_blocks").alias("_block")).agg(F.collect_list(F.struct("_x", "_t")).alias("_out"))
        met = left.join(tables, keys) if keys else left.crossJoin(tables)
        done = done.where("_ok").unionByName(met.select(*keys, "_table", "_out").mapInArrow(fit, schema))
    return rows.join(done.withColumnRenamed("_t", target), [*keys, "_x", target]).select(*keys, ident, score, target, "pred_prob", log10_odds(F.col("pred_prob")).alias("pred_llr"))


def performance(predictions: DataFrame, keys: list[str], target: str = "target", decision_llr: float = 0.0) -> DataFrame:
    """All metrics of calibrated predictions by group: Cllr, least Cllr, EER, mean ratios, trials, AUC and the decision metrics. A group that a metric cannot be had for (a class is missing) has null there and keeps the others."""
    t = F.col(target)
    means = predictions.groupBy(*keys).agg(
        F.avg(F.when(t, F.col("pred_llr"))).alias("mean_true_llr"), F.avg(F.when(~t, F.col("pred_llr"))).alias("mean_false_llr"),
        F.count(F.when(t, 1)).alias("true_trials"), F.count(F.when(~t, 1)).alias("false_trials"),
    )
    points = operating_points(predictions, keys, "pred_prob", target)
    out = means
    for part in (cllr(predictions, keys, "pred_llr", target), cllr_min(predictions, keys, "pred_llr", target), eer(points, keys), auc(points, keys), confusion(predictions, keys, F.col("pred_llr") > decision_llr, target)):
        out = out.join(part, keys, "left") if keys else out.crossJoin(part)  # without keys each side is a single row
    return out


def compare_models(frames: dict[str, DataFrame], keys: list[str], ident: str, score: str = "score", target: str = "target", decision_llr: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Predictions and metrics of several models: ``(ident, target, <model>_score, <model>_llr, <model>_error)`` by full join, and
    ``(*keys, model, <metrics>)``. Each model is calibrated by leave-one-out in its group; a trial missing in a model has nulls there."""
    from glyphmill.operators.phrases import join_all
    from glyphmill.operators.results import labelled_errors

    rows, metrics = [], None
    for name, df in frames.items():
        p = calibrate_loo(df, keys, ident, score, target).where("pred_prob is not null")
        e = labelled_errors(p.withColumn("_p", F.col("pred_llr") > decision_llr), target, "_p")
        rows.append(e.select(ident, target, F.col(score).alias(f"{name}_score"), F.col("pred_llr").alias(f"{name}_llr"), F.col("error").alias(f"{name}_error")))
        m = performance(p, keys, target, decision_llr).withColumn("model", F.lit(name))
        metrics = m if metrics is None else metrics.unionByName(m)
    return join_all(rows, [ident, target]), metrics


def single_valued(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(*keys, *columns)``: columns that have one value in each group; raises where a group has several."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    one = lambda c: F.when(F.countDistinct(c) <= 1, F.max(c)).otherwise(F.raise_error(F.lit(f"{c} has several values in a group")).cast(df.schema[c].dataType))
    return df.groupBy(*keys).agg(*[one(c).alias(c) for c in columns])
