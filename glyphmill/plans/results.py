"""Queries that roll results up and evaluate them.

A problem's score is the mean log-probability of its phrases' candidates; the target says whether both authors are the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import evaluate as E
from glyphmill.operators import results as R
from glyphmill.plans import base as B
from glyphmill.plans.phrases import C as _C
from glyphmill.plans.phrases import candidates
from glyphmill.session import table


def trials(spark, d):  # noqa: ANN001, ANN201
    """``(sample_id, corpus, problem, target, score)`` of the samples with any scored candidate."""
    mean = candidates(spark, d).where("sample_id is not null").groupBy("sample_id").agg(F.round(F.avg("sum_log_probs"), 10).alias("score"))
    m = table(spark, d, "agg_metadata").dropDuplicates(["sample_id"]).select("sample_id", "corpus", "problem", (F.col("known_author") == F.col("unknown_author")).alias("target"))
    return m.join(mean, "sample_id").where("target is not null and corpus is not null")


def _r(df):  # noqa: ANN001, ANN202
    return df.select(*[B.r6(c).alias(c) if t == "double" and not c.endswith(("threshold", "score")) else F.col(c) for c, t in df.dtypes])


def av_results(spark, d):  # noqa: ANN001, ANN201
    return trials(spark, d)


def mean_scores(spark, d):  # noqa: ANN001, ANN201
    return R.mean_scores(trials(spark, d), ["problem", "target"]).withColumn("score", F.round("score", 9))


def complete_problems(spark, d):  # noqa: ANN001, ANN201
    return R.complete_problems(trials(spark, d), ["corpus"])


def both_classes_pivot(spark, d):  # noqa: ANN001, ANN201
    return R.both_classes(trials(spark, d), ["corpus"])


def merge_model_metrics(spark, d):  # noqa: ANN001, ANN201
    """A model for each paraphrasing method: mean score and count by sample."""
    c = candidates(spark, d)
    frames = {m: c.where(F.col("phrase_method") == m).groupBy("sample_id").agg(F.round(F.avg("sum_log_probs"), 10).alias("score"), F.count(F.lit(1)).alias("n")) for m in ("mask_fill", "varlen_fill")}
    return R.merge_models(frames, ["sample_id"], ["score", "n"]).fillna(0, ["n_mask_fill", "n_varlen_fill"])


def count_sum_by_prefix(spark, d):  # noqa: ANN001, ANN201
    return _r(R.by_prefix(merge_model_metrics(spark, d).withColumn("part", F.col("sample_id") % 10), ["part"], ["score_", "n_"]))


def mean_then_sum(spark, d):  # noqa: ANN001, ANN201
    return _r(R.mean_then_sum(candidates(spark, d).where("phrase_type = 'reference'"), ["sample_id", "phrase_num"], ["sample_id"], "sum_log_probs", "sum_of_means"))


def describe_scores(spark, d):  # noqa: ANN001, ANN201
    return _r(R.describe(table(spark, d, "events"), ["event_type"], "value"))


def histogram_table(spark, d):  # noqa: ANN001, ANN201
    return _r(R.histogram(table(spark, d, "events"), "value", 30, "event_type"))


def score_distribution(spark, d):  # noqa: ANN001, ANN201
    return _r(R.histogram(trials(spark, d), "score", 20, "target"))


def stratified_split(spark, d):  # noqa: ANN001, ANN201
    return R.stratified(trials(spark, d), ["corpus", "target"], "sample_id").select("sample_id", "part")


def _llrs(spark, d):  # noqa: ANN001, ANN202
    """A log10 likelihood ratio for each trial: the score less its corpus mean."""
    t = trials(spark, d)
    return t.join(t.groupBy("corpus").agg(F.avg("score").alias("m")), "corpus").withColumn("llr", F.round(F.col("score") - F.col("m"), 6)).drop("m")


def cllr(spark, d):  # noqa: ANN001, ANN201
    return _r(E.cllr(_llrs(spark, d), ["corpus"]))


def cllr_min(spark, d):  # noqa: ANN001, ANN201
    return _r(E.cllr_min(_llrs(spark, d), ["corpus"]))


def confusion_metrics(spark, d):  # noqa: ANN001, ANN201
    return _r(E.confusion(_llrs(spark, d), ["corpus"], F.col("llr") > 0))


def labelled_errors(spark, d):  # noqa: ANN001, ANN201
    return R.labelled_errors(_llrs(spark, d).withColumn("y_pred", F.col("llr") > 0), "target", "y_pred").select("sample_id", "error")


def _points(spark, d):  # noqa: ANN001, ANN202
    return E.operating_points(trials(spark, d), ["corpus"])


def roc(spark, d):  # noqa: ANN001, ANN201
    return _r(_points(spark, d).drop("pos", "neg"))


def auc(spark, d):  # noqa: ANN001, ANN201
    return _r(E.auc(_points(spark, d), ["corpus"]))


def eer(spark, d):  # noqa: ANN001, ANN201
    return _r(E.eer(_points(spark, d), ["corpus"]))


def roc_youden(spark, d):  # noqa: ANN001, ANN201
    return _r(E.youden(_points(spark, d), ["corpus"]))


def tippett(spark, d):  # noqa: ANN001, ANN201
    return _r(E.tippett(trials(spark, d), ["corpus"]))


def metrics_v1(spark, d):  # noqa: ANN001, ANN201
    p = _llrs(spark, d).withColumn("p", F.round(1 / (1 + F.exp(-F.col("llr"))), 6))
    return _r(E.metrics_by_probability(p, ["corpus"]))


def calibrate_loo(spark, d):  # noqa: ANN001, ANN201
    return _r(E.calibrate_loo(trials(spark, d), ["corpus"], "sample_id"))


def calibrate_loo_paraphrase(spark, d):  # noqa: ANN001, ANN201
    return _r(E.calibrate_loo(trials(spark, d), ["corpus"], "sample_id", c=None, standardise=True))


def calibrate_train_test(spark, d):  # noqa: ANN001, ANN201
    t = R.stratified(trials(spark, d), ["corpus", "target"], "sample_id")
    return _r(E.calibrate(t.where("part = 'train'"), t.where("part = 'test'"), ["corpus"]).select("sample_id", "corpus", "target", "score", "pred_prob", "pred_llr"))


def _models(spark, d):  # noqa: ANN001, ANN202
    """Trials of two paraphrasing methods as two models."""
    t = trials(spark, d).drop("score")
    c = candidates(spark, d).where("sample_id is not null")
    mean = lambda m: c.where(F.col("phrase_method") == m).groupBy("sample_id").agg(F.round(F.avg("sum_log_probs"), 10).alias("score"))
    return E.compare_models({m: t.join(mean(m), "sample_id") for m in ("mask_fill", "varlen_fill")}, ["corpus"], "sample_id")


def model_predictions(spark, d):  # noqa: ANN001, ANN201
    return _r(_models(spark, d)[0])


def model_performance(spark, d):  # noqa: ANN001, ANN201
    return _r(_models(spark, d)[1])


def performance(spark, d):  # noqa: ANN001, ANN201
    return _r(E.performance(E.calibrate_loo(trials(spark, d), ["corpus"], "sample_id").where("pred_prob is not null"), ["corpus"]))


QUERIES = {f.__name__: f for f in (
    av_results, mean_scores, complete_problems, both_classes_pivot, merge_model_metrics, count_sum_by_prefix, mean_then_sum, describe_scores, histogram_table, score_distribution, stratified_split,
    cllr, cllr_min, confusion_metrics, labelled_errors, roc, auc, eer, roc_youden, tippett, metrics_v1, calibrate_loo, calibrate_loo_paraphrase, calibrate_train_test, performance, model_predictions, model_performance,
)}

_T = f"""WITH {_C}, mm AS (SELECT sample_id, round(avg(lp), 10) AS score FROM c WHERE sample_id IS NOT NULL GROUP BY sample_id),
    a AS (SELECT sample_id, any_value(corpus) AS corpus, any_value(problem) AS problem, any_value(known_author = unknown_author) AS target FROM agg_metadata GROUP BY sample_id),
    t AS (SELECT * FROM a JOIN mm USING (sample_id) WHERE target IS NOT NULL AND corpus IS NOT NULL),
    v AS (SELECT *, round(score - avg(score) OVER (PARTITION BY corpus), 6) AS llr FROM t),
    g AS (SELECT corpus, score AS threshold, count(*) FILTER (target) AS p, count(*) FILTER (NOT target) AS n FROM t GROUP BY ALL),
    o AS (SELECT corpus, threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER (PARTITION BY corpus) AS BIGINT) AS n_pos, CAST(sum(n) OVER (PARTITION BY corpus) AS BIGINT) AS n_neg FROM g WINDOW w AS (PARTITION BY corpus ORDER BY threshold DESC)),
    roc AS (SELECT *, tp / nullif(n_pos, 0) AS tpr, fp / nullif(n_neg, 0) AS fpr FROM o)
"""
_SOFT = "(greatest({x} * ln(10), 0) + ln(1 + exp(-abs({x} * ln(10))))) / ln(2)"
_COST = "(sum(CASE WHEN target THEN " + _SOFT.format(x="(-{y})") + " END) / count(*) FILTER (target) + sum(CASE WHEN NOT target THEN " + _SOFT.format(x="({y})") + " END) / count(*) FILTER (NOT target)) / 2"
_CONF = """round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) + 0.0 AS balanced_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1"""
_COUNTS = "count(*) FILTER (target AND {c}) AS tp, count(*) FILTER (NOT target AND {c}) AS fp, count(*) FILTER (target AND NOT ({c})) AS fn, count(*) FILTER (NOT target AND NOT ({c})) AS tn"
_MERGE = """a AS (SELECT sample_id, round(avg(lp), 10) AS s, count(*) AS n FROM c WHERE phrase_method = 'mask_fill' GROUP BY sample_id), b AS (SELECT sample_id, round(avg(lp), 10) AS s, count(*) AS n FROM c WHERE phrase_method = 'varlen_fill' GROUP BY sample_id),
    j AS (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, a.s AS score_mask_fill, coalesce(a.n, 0) AS n_mask_fill, b.s AS score_varlen_fill, coalesce(b.n, 0) AS n_varlen_fill FROM a FULL JOIN b ON a.sample_id IS NOT DISTINCT FROM b.sample_id)"""
_EER = "SELECT corpus, CASE WHEN g < 1 THEN round(fpr, 6) + 0.0 ELSE 0.0::DOUBLE END AS eer FROM (SELECT corpus, abs(1 - tpr - fpr) AS g, fpr, row_number() OVER (PARTITION BY corpus ORDER BY abs(1 - tpr - fpr), threshold DESC) AS k FROM roc WHERE n_pos > 0 AND n_neg > 0) WHERE k = 1"
_AUC = "SELECT corpus, round(sum((fp - f0) * (tp + t0) / 2.0) / nullif(max(n_pos) * max(n_neg), 0), 6) + 0.0 AS auc FROM (SELECT *, coalesce(lag(tp) OVER w, 0) AS t0, coalesce(lag(fp) OVER w, 0) AS f0 FROM roc WINDOW w AS (PARTITION BY corpus ORDER BY threshold DESC)) GROUP BY corpus"


def _newton(rows: str, key: str, penalty: float, steps: int = 40) -> str:
    """CTEs down to ``fit`` (key, w, b): logistic fits on ``rows`` (key, x, y, n) by Newton steps from 0, each one statement."""
    parts = [f"n0 AS (SELECT DISTINCT {key}, 0::DOUBLE AS w, 0::DOUBLE AS b FROM {rows})"]
    for k in range(1, steps + 1):
        parts.append(f"""n{k} AS MATERIALIZED (SELECT {key}, w - dw / greatest(1, greatest(abs(dw), abs(db)) / 10) AS w, b - db / greatest(1, greatest(abs(dw), abs(db)) / 10) AS b FROM (
            SELECT {key}, w, b, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS dw, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS db FROM (
                SELECT {key}, w, b, sum(n * (p - y) * x) + {penalty} * w AS g0, sum(n * (p - y)) AS g1, sum(n * p * (1 - p) * x * x) + {penalty} + 1e-12 AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p)) + 1e-12 AS h11
                FROM (SELECT *, 1 / (1 + exp(-greatest(-500, least(500, w * x + b)))) AS p FROM {rows} JOIN n{k - 1} USING ({key})) GROUP BY {key}, w, b)))""")
    return ",\n".join([*parts, f"fit AS (SELECT * FROM n{steps})"])


def _loo(trials: str, group: str = "corpus", penalty: float = 1.0, scaled: bool = False) -> str:
    """CTEs down to ``pr`` (group, sample_id, target, score, p, l): each trial of ``trials`` by the fit on the others of its group."""
    x = "(score - avg(score) OVER w) / coalesce(nullif(stddev_pop(score) OVER w, 0), 1)" if scaled else "score"
    return f"""tx AS MATERIALIZED (SELECT {group}, sample_id, target, score, {x} AS x FROM {trials} WINDOW w AS (PARTITION BY {group})),
    lr AS MATERIALIZED (SELECT a.sample_id || '|' || a.{group} AS k, b.x, CAST(b.target AS INTEGER)::DOUBLE AS y, 1::DOUBLE AS n FROM tx a JOIN tx b ON a.{group} = b.{group} AND a.sample_id <> b.sample_id),
    ok AS (SELECT k FROM lr GROUP BY k HAVING min(y) < max(y)), {_newton('lr', 'k', penalty)},
    pr AS MATERIALIZED (SELECT {group}, sample_id, target, score, CASE WHEN ok.k IS NOT NULL THEN 1 / (1 + exp(-(w * x + b))) END AS p FROM tx LEFT JOIN fit ON k = sample_id || '|' || {group} LEFT JOIN ok USING (k))"""


_PL = "log10(p / (1 - p + 1e-15))"


def _performance(pred: str, group: str) -> str:
    """CTEs down to ``pf``: all metrics of ``pred`` (group, target, p) by group."""
    return f"""pq AS MATERIALIZED (SELECT {group}, target, p, {_PL} AS llr FROM {pred} WHERE p IS NOT NULL),
    pm AS (SELECT {group}, avg(llr) FILTER (target) AS mean_true_llr, avg(llr) FILTER (NOT target) AS mean_false_llr, count(*) FILTER (target) AS true_trials, count(*) FILTER (NOT target) AS false_trials, {_COST.format(y='llr')} AS cllr, {_COUNTS.format(c='llr > 0')} FROM pq GROUP BY {group}),
    pc AS (SELECT {group}, min(x) AS cllr_min FROM (SELECT {group}, k, {_COST.format(y='(llr - 10 + k * 0.02::DOUBLE)')} AS x FROM pq, range(1001) AS r(k) GROUP BY {group}, k) GROUP BY {group}),
    pg AS (SELECT {group}, p AS threshold, count(*) FILTER (target) AS np, count(*) FILTER (NOT target) AS nn FROM pq GROUP BY ALL),
    po AS (SELECT {group}, threshold, np, nn, sum(np) OVER w AS tp, sum(nn) OVER w AS fp, sum(np) OVER (PARTITION BY {group}) AS n_pos, sum(nn) OVER (PARTITION BY {group}) AS n_neg FROM pg WINDOW w AS (PARTITION BY {group} ORDER BY threshold DESC)),
    pa AS (SELECT {group}, sum(nn * (2 * tp - np) / 2.0) / max(n_pos * n_neg) AS auc FROM po GROUP BY {group}),
    pe AS (SELECT {group}, CASE WHEN gap < 1 THEN f ELSE 0 END AS eer FROM (SELECT {group}, abs(1 - tp / n_pos - fp / n_neg) AS gap, fp / n_neg AS f, row_number() OVER (PARTITION BY {group} ORDER BY abs(1 - tp / n_pos - fp / n_neg), threshold DESC) AS k FROM po WHERE n_pos > 0 AND n_neg > 0) WHERE k = 1),
    pf AS (SELECT {group}, round(mean_true_llr, 6) + 0.0 AS mean_true_llr, round(mean_false_llr, 6) + 0.0 AS mean_false_llr, true_trials, false_trials, round(cllr, 6) + 0.0 AS cllr, round(cllr_min, 6) + 0.0 AS cllr_min, round(eer, 6) + 0.0 AS eer, round(auc, 6) + 0.0 AS auc,
        tp, fp, fn, tn, {_CONF} FROM pm JOIN pc USING ({group}) JOIN pa USING ({group}) JOIN pe USING ({group}))"""


_PRED = f"sample_id, target, score, round(p, 6) + 0.0 AS pred_prob, round({_PL}, 6) + 0.0 AS pred_llr FROM pr"
_TWO = "mt AS (SELECT m AS model, sample_id, corpus, target, score FROM (SELECT sample_id, phrase_method AS m, round(avg(lp), 10) AS score FROM c WHERE sample_id IS NOT NULL AND phrase_method IN ('mask_fill', 'varlen_fill') GROUP BY ALL) JOIN (SELECT sample_id, corpus, target FROM t) USING (sample_id)), gt AS (SELECT model || '|' || corpus AS g, * FROM mt)"
_ERR = "CASE WHEN target AND {l} > 0 THEN 'TP' WHEN {l} > 0 THEN 'FP' WHEN target THEN 'FN' ELSE 'TN' END"
SQL = {
    "av_results": _T + "SELECT sample_id, corpus, problem, target, score FROM t",
    "mean_scores": _T + "SELECT problem, target, round(avg(score), 9) AS score FROM t WHERE problem IS NOT NULL GROUP BY problem, target",
    "complete_problems": _T + "SELECT corpus, problem, n_docs FROM (SELECT corpus, problem, count(DISTINCT sample_id) AS n_docs, max(count(DISTINCT sample_id)) OVER (PARTITION BY corpus) AS m FROM t GROUP BY corpus, problem) WHERE n_docs = m",
    "both_classes_pivot": _T + "SELECT corpus, count(DISTINCT CASE WHEN NOT target THEN problem END) AS n_false, count(DISTINCT CASE WHEN target THEN problem END) AS n_true FROM t GROUP BY corpus",
    "merge_model_metrics": f"WITH {_C}, {_MERGE} SELECT * FROM j",
    "count_sum_by_prefix": f"WITH {_C}, {_MERGE} SELECT sample_id % 10 AS part, " + ", ".join(f"count({c}) AS {c}_count, " + (f"round(sum({c}), 6) + 0.0 AS {c}_sum" if c.startswith("score") else f"CAST(sum({c}) AS BIGINT) AS {c}_sum") for c in ("score_mask_fill", "n_mask_fill", "score_varlen_fill", "n_varlen_fill")) + " FROM j GROUP BY part",
    "mean_then_sum": f"WITH {_C}, i AS (SELECT sample_id, phrase_num, avg(lp) AS m FROM c WHERE phrase_type = 'reference' GROUP BY ALL) SELECT sample_id, round(sum(m), 6) + 0.0 AS sum_of_means FROM i GROUP BY sample_id",
    "describe_scores": 'SELECT event_type, count(value) AS "count", round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std, min(value) AS "min", round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(value, 0.5), 6) + 0.0 AS q50, round(quantile_cont(value, 0.75), 6) + 0.0 AS q75, max(value) AS "max" FROM events GROUP BY event_type',
    "histogram_table": """WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events), b AS (SELECT event_type, least(CAST(floor((value - lo) / w) AS INTEGER), 29) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY ALL),
        k AS (SELECT event_type, CAST(t.k AS INTEGER) AS bin FROM (SELECT DISTINCT event_type FROM events WHERE value IS NOT NULL), range(30) AS t(k))
        SELECT event_type, bin, round(lo + bin * w, 6) + 0.0 AS low, round(lo + (bin + 1) * w, 6) + 0.0 AS high, coalesce(n, 0) AS n FROM k LEFT JOIN b USING (event_type, bin), e""",
    "score_distribution": _T + """, e AS (SELECT min(score) AS lo, (max(score) - min(score)) / 20 AS w FROM t), b AS (SELECT target, least(CAST(floor((score - lo) / w) AS INTEGER), 19) AS bin, count(*) AS n FROM t, e GROUP BY ALL),
        k AS (SELECT target, CAST(r.k AS INTEGER) AS bin FROM (SELECT DISTINCT target FROM t), range(20) AS r(k))
        SELECT target, bin, round(lo + bin * w, 6) + 0.0 AS low, round(lo + (bin + 1) * w, 6) + 0.0 AS high, coalesce(n, 0) AS n FROM k LEFT JOIN b USING (target, bin), e""",
    "stratified_split": _T + "SELECT sample_id, CASE WHEN row_number() OVER (PARTITION BY corpus, target ORDER BY md5('42|' || sample_id), sample_id) <= floor(count(*) OVER (PARTITION BY corpus, target) * 0.6::DOUBLE + 0.5) THEN 'train' ELSE 'test' END AS part FROM t",
    "cllr": _T + "SELECT corpus, round(" + _COST.format(y="llr") + ", 6) + 0.0 AS cllr FROM v GROUP BY corpus",
    "cllr_min": _T + "SELECT corpus, round(min(x), 6) + 0.0 AS cllr_min FROM (SELECT corpus, k, " + _COST.format(y="(llr - 10 + k * 0.02::DOUBLE)") + " AS x FROM v, range(1001) AS r(k) GROUP BY corpus, k) GROUP BY corpus",
    "confusion_metrics": _T + f", x AS (SELECT corpus, {_COUNTS.format(c='llr > 0')} FROM v GROUP BY corpus) SELECT *, {_CONF} FROM x",
    "labelled_errors": _T + "SELECT sample_id, CASE WHEN target AND llr > 0 THEN 'TP' WHEN llr > 0 THEN 'FP' WHEN target THEN 'FN' ELSE 'TN' END AS error FROM v",
    "roc": _T + "SELECT corpus, threshold, tp, fp, n_pos, n_neg, round(tpr, 6) + 0.0 AS tpr, round(fpr, 6) + 0.0 AS fpr FROM roc",
    "auc": _T + _AUC,
    "eer": _T + _EER,
    "roc_youden": _T + """SELECT corpus, threshold, round(tpr, 6) + 0.0 AS tpr, round(fpr, 6) + 0.0 AS fpr, tp, fp, n_neg - fp AS tn, n_pos - tp AS fn, round((tp + n_neg - fp) / (n_pos + n_neg), 6) AS accuracy, round(2 * tp / (2 * tp + fp + n_pos - tp), 6) + 0.0 AS f1
        FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY tpr - fpr DESC, threshold DESC) AS k FROM roc WHERE n_pos > 0 AND n_neg > 0) WHERE k = 1""",
    "tippett": _T + "SELECT corpus, threshold, round(tpr, 6) + 0.0 AS share_true_at_least, round((n_neg - coalesce(lag(fp) OVER (PARTITION BY corpus ORDER BY threshold DESC), 0)) / nullif(n_neg, 0), 6) + 0.0 AS share_false_at_most FROM roc",
    "metrics_v1": _T + f""", q AS (SELECT corpus, target, round(1 / (1 + exp(-llr)), 6) AS p FROM v), x AS (SELECT *, ln(p / (1 - p)) AS x FROM q WHERE p > 0 AND p < 1),
        cost AS (SELECT corpus, avg(x) FILTER (target) AS mean_true_llr, -avg(x) FILTER (NOT target) AS mean_false_llr, count(*) FILTER (target) AS true_trials, count(*) FILTER (NOT target) AS false_trials,
            (avg(-ln(1 + exp(-x))) FILTER (target) + avg(-ln(1 + exp(x))) FILTER (NOT target)) * -0.5 AS cllr, {_COUNTS.format(c='p > 0.5')} FROM x GROUP BY corpus),
        pg AS (SELECT corpus, p AS threshold, count(*) FILTER (target) AS np, count(*) FILTER (NOT target) AS nn FROM x GROUP BY ALL),
        po AS (SELECT corpus, threshold, sum(np) OVER w AS tp, sum(nn) OVER w AS fp, sum(np) OVER (PARTITION BY corpus) AS n_pos, sum(nn) OVER (PARTITION BY corpus) AS n_neg FROM pg WINDOW w AS (PARTITION BY corpus ORDER BY threshold DESC)),
        seg AS (SELECT corpus, n_pos, n_neg, tp, fp, tp / n_pos AS tpr, fp / n_neg AS fpr, coalesce(lag(tp) OVER w, 0) AS tp0, coalesce(lag(fp) OVER w, 0) AS fp0 FROM po WINDOW w AS (PARTITION BY corpus ORDER BY threshold DESC)),
        au AS (SELECT corpus, sum((fp - fp0) * (tp + tp0) / 2.0) / max(n_pos * n_neg) AS auc FROM seg GROUP BY corpus),
        er AS (SELECT corpus, min(fp0 / n_neg + (fpr - fp0 / n_neg) * coalesce(a / nullif(a - b, 0), 0)) AS eer FROM (SELECT *, 1 - fp0 / n_neg - tp0 / n_pos AS a, 1 - fpr - tpr AS b FROM seg) WHERE a >= 0 AND b <= 0 GROUP BY corpus)
        SELECT corpus, round(mean_true_llr, 6) + 0.0 AS mean_true_llr, round(mean_false_llr, 6) + 0.0 AS mean_false_llr, true_trials, false_trials, round(cllr, 6) AS cllr,
            round((ln(1 + exp(-mean_true_llr)) + ln(1 + exp(-mean_false_llr))) * 0.5, 6) AS cllr_min, tp, fp, fn, tn, {_CONF}, round(auc, 6) + 0.0 AS auc, round(eer, 6) + 0.0 AS eer FROM cost JOIN au USING (corpus) JOIN er USING (corpus)""",
    "calibrate_loo": _T + "," + _loo("t") + f" SELECT corpus, {_PRED}",
    "calibrate_loo_paraphrase": _T + "," + _loo("t", penalty=0.0, scaled=True) + f" SELECT corpus, {_PRED}",
    "calibrate_train_test": _T + """, sp AS (SELECT *, row_number() OVER (PARTITION BY corpus, target ORDER BY md5('42|' || sample_id), sample_id) <= floor(count(*) OVER (PARTITION BY corpus, target) * 0.6::DOUBLE + 0.5) AS train FROM t),
        lr AS (SELECT corpus, score AS x, CAST(target AS INTEGER)::DOUBLE AS y, 1::DOUBLE AS n FROM sp WHERE train), """ + _newton("lr", "corpus", 1.0)
        + f" SELECT corpus, {_PRED.replace('FROM pr', 'FROM (SELECT *, 1 / (1 + exp(-(w * score + b))) AS p FROM sp JOIN fit USING (corpus) WHERE NOT train)')}",
    "performance": _T + "," + _loo("t") + "," + _performance("pr", "corpus") + " SELECT * FROM pf",
    "model_predictions": _T + "," + _TWO + "," + _loo("gt", "g") + f""", e AS (SELECT split_part(g, '|', 1) AS model, sample_id, target, score, {_PL} AS l FROM pr WHERE p IS NOT NULL)
        SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.target, b.target) AS target, {", ".join(f"{x}.score AS {m}_score, round({x}.l, 6) + 0.0 AS {m}_llr, CASE WHEN {x}.l IS NOT NULL THEN {_ERR.format(l=f'{x}.l').replace('target', f'{x}.target')} END AS {m}_error" for x, m in (("a", "mask_fill"), ("b", "varlen_fill")))}
        FROM (SELECT * FROM e WHERE model = 'mask_fill') a FULL JOIN (SELECT * FROM e WHERE model = 'varlen_fill') b ON a.sample_id = b.sample_id""",
    "model_performance": _T + "," + _TWO + "," + _loo("gt", "g") + "," + _performance("pr", "g") + " SELECT split_part(g, '|', 1) AS model, split_part(g, '|', 2) AS corpus, * EXCLUDE g FROM pf",
}
