"""Evaluation and calibration goldens, and roll-ups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import evaluate as E
from glyphmill.operators import phrases as P
from glyphmill.operators import results as R

LLRS = [(1.2, True), (0.3, True), (-0.4, True), (-0.9, False), (0.1, False), (-1.5, False)]


def test_cllr_goldens(spark):
    df = spark.createDataFrame([("g", x, t) for x, t in LLRS], "g string, llr double, target boolean")
    assert E.cllr(df, ["g"]).first().cllr == pytest.approx(0.646373823835)
    assert E.cllr_min(df, ["g"]).first().cllr_min == pytest.approx(0.623089044477)


def test_logistic_golden(spark):
    df = spark.createDataFrame([("g", float(x), bool(y)) for x, y in zip([0, 0.5, 1, 1.5, 0.9], [0, 0, 1, 1, 0])], "g string, score double, target boolean")
    fit = E.fit_logistic(df, ["g"])
    assert (fit.w[0], fit.b[0]) == (pytest.approx(0.725407, abs=1e-6), pytest.approx(-0.985086, abs=1e-6))


def test_leave_one_out_equals_separate_fits(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=24) + np.repeat([0, 1], 12), 2)
    y = np.repeat([False, True], 12)
    df = spark.createDataFrame([("g", k, float(a), bool(b)) for k, (a, b) in enumerate(zip(x, y))], "g string, i int, score double, target boolean")
    for block in (512, 5):  # all kinds in one task, or spread
        got = {r.i: r.pred_prob for r in E.calibrate_loo(df, ["g"], "i", block=block).collect()}
        assert len(got) == 24
        for k in (0, 7, 23):
            rest = df.where(F.col("i") != k)
            fit = E.fit_logistic(rest, ["g"])
            assert got[k] == pytest.approx(1 / (1 + np.exp(-(fit.w[0] * x[k] + fit.b[0]))), abs=1e-7)
    z = E.calibrate_loo(df.union(df.limit(0)), [], "i", standardise=True).count()
    assert z == 24 and E.calibrate_loo(df.where("i = 0"), ["g"], "i").first().pred_prob is None and E.calibrate_loo(df.where("false"), ["g"], "i").count() == 0


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_near_fits_equal_full_fits(penalty):
    """Leave-one-out fits of a large group by series are those made in full, outliers and repeated trials included, without a table of fits by kinds."""
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(-40, 3, 900), 25.0, -90.0]
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-(x + 40) / 3))).astype(float)
    n = rng.integers(1, 4, len(x)).astype(float)
    w, b, ok = E._near_fits(x, y, n, penalty)
    v, c = E._fits(x, y, n, np.arange(len(x)), penalty)
    assert ok.mean() > 0.99 and np.abs(w - v)[ok].max() < 1e-9 and np.abs(w * x + b - v * x - c)[ok].max() < 1e-9
    apart = np.arange(40.0)
    assert not E._near_fits(apart, (apart > 20).astype(float), np.ones(40), 0.0)[2].any()  # no finite fit: made in full


def test_leave_one_out_of_a_large_group_holds_few_cells(spark, monkeypatch):
    """Memory does not grow with fits by kinds; what the series does not hold for is made in full."""
    rng = np.random.default_rng(5)
    rows = [("g", k, float(rng.normal() + k % 2), k % 2 == 1) for k in range(700)] + [("apart", k, float(k), k >= 350) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, i int, score double, target boolean")
    cells = []
    fits = E._fits
    monkeypatch.setattr(E, "_fits", lambda x, y, n, out, *more: cells.append(len(x) * len(out)) or fits(x, y, n, out, *more))
    x, y = np.array([r[2] for r in rows[:700]]), np.array([float(r[3]) for r in rows[:700]])
    E._near_fits(x, y, np.ones(700), 1.0)
    assert max(cells) <= 700
    monkeypatch.undo()
    for c in (1.0, None):
        got = {(r.g, r.i): r.pred_prob for r in E.calibrate_loo(df, ["g"], "i", c=c).collect()}
        for g, lo in (("g", 0), ("apart", 700)):
            x, y = np.array([r[2] for r in rows[lo : lo + 700]]), np.array([float(r[3]) for r in rows[lo : lo + 700]])
            w, b = fits(x, y, np.ones(700), np.arange(0, 700, 50), 0.0 if c is None else 1.0)
            for j, k in enumerate(range(0, 700, 50)):
                assert got[g, k] == pytest.approx(1 / (1 + np.exp(-np.clip(w[j] * x[k] + b[j], -500, 500))), abs=1e-9)
        assert len(got) == 1400


def test_models_of_large_groups_need_little_memory():
    """Both models of a comparison are calibrated by the series: memory grows with the kinds, not with fits times kinds."""
    import tracemalloc

    rng = np.random.default_rng(6)
    x = rng.normal(size=6000)
    tracemalloc.start()
    for y in (rng.random(6000) < 0.4, x + rng.normal(size=6000) > 0):
        assert E._near_fits(x, y.astype(float), np.ones(6000), 1.0)[2].all()
    assert tracemalloc.get_traced_memory()[1] < 16e6  # 512 fits on 6000 kinds take 24 MB for one array alone
    tracemalloc.stop()


def test_workers_that_compare_models_stay_small(spark):
    """The comparison as model_performance runs it, measured in the Python workers: what they hold at most is little more than before it."""
    rng = np.random.default_rng(7)
    of = lambda shift: spark.createDataFrame([("g", k, float(rng.normal() + shift * (k % 2)), k % 2 == 1) for k in range(8000)], "g string, i int, score double, target boolean")

    def peaks(afresh: bool) -> list[int]:
        def read(batches):  # noqa: ANN001, ANN202
            import time
            from pathlib import Path

            import pyarrow as pa

            for _ in batches:
                pass
            if afresh:
                Path("/proc/self/clear_refs").write_text("5")  # the peak counts from here
            time.sleep(0.2)  # else one worker may serve several tasks
            peak = next(x for x in Path("/proc/self/status").read_text().splitlines() if x.startswith("VmHWM"))
            yield pa.RecordBatch.from_pydict({"kb": [int(peak.split()[1])]})

        return [r.kb for r in spark.range(0, 16, 1, 16).mapInArrow(read, "kb long").collect()]  # more tasks than idle workers

    before = max(peaks(True))
    both = E.compare_models({"a": of(1), "b": of(2)}, ["g"], "i")[1].select("model", "true_trials", "false_trials").collect()
    assert {(r.model, r.true_trials, r.false_trials) for r in both} == {("a", 4000, 4000), ("b", 4000, 4000)}
    assert max(peaks(False)) - before < 100_000  # KB; 512 fits on 8000 kinds take 33 MB for one array alone, a table beside every kind takes gigabytes of heap


def test_auc_and_eer_with_ties(spark):
    rows = [(0.9, True), (0.5, True), (0.5, False), (0.5, False), (0.1, False), (0.1, True)]
    df = spark.createDataFrame([("g", s, t) for s, t in rows], "g string, score double, target boolean")
    pts = E.operating_points(df, ["g"])
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / 9
    assert E.auc(pts, ["g"]).first().auc == pytest.approx(want)
    assert E.eer(pts, ["g"]).first().eer in (0.0, 1 / 3, 2 / 3, 1.0)


def test_one_class_only(spark):
    df = spark.createDataFrame([("g", 0.3, True)], "g string, score double, target boolean")
    pts = E.operating_points(df, ["g"])
    assert E.auc(pts, ["g"]).first().auc is None and E.eer(pts, ["g"]).count() == 0
    assert E.cllr(df.withColumnRenamed("score", "llr"), ["g"]).first().cllr is None


def test_single_valued(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "g string, v int")
    with pytest.raises(KeyError):
        E.single_valued(df, ["g"], ["w"])
    with pytest.raises(Exception, match="several values"):
        E.single_valued(df, ["g"], ["v"]).collect()


def test_mass_and_excluded(spark):
    rows = [("1", "reference", -1.0), ("1", "paraphrase", -2.0), ("1", "paraphrase", -3.0), ("2", "reference", -1.0), ("3", "paraphrase", -1.0)]
    df = spark.createDataFrame(rows, "phrase_num string, phrase_type string, sum_log_probs double")
    m = {r.phrase_num: r for r in P.mass(df, ["phrase_num"], "x").collect()}
    e = [np.exp(-1), np.exp(-2), np.exp(-3)]
    assert m["1"].pmf_x == pytest.approx(e[0] / sum(e)) and m["2"].pmf_x == 1.0 and m["3"].pmf_x == 0.0 and m["3"].llr_x == 0.0
    x = {r.phrase_num: r for r in P.excluded_ratio(df, ["phrase_num"]).collect()}
    assert x["1"].llr_excl_nats == pytest.approx(-1 - np.log(e[1] + e[2])) and x["2"].llr_excl_nats == float("inf") and x["2"].p_two_bin == 1.0 and x["3"].llr_excl_nats is None


def test_p_ref_golden(spark):
    df = spark.createDataFrame([("1", "reference", -21.993745), ("1", "rest", float(np.log(3.0710422436889754e-10 - np.exp(-21.993745))))], "phrase_num string, phrase_type string, sum_log_probs double")
    assert P.mass(df, ["phrase_num"], "x").first().pmf_x == pytest.approx(0.9140124674341824, abs=1e-9)


def test_softmax_sums_to_one_and_takes_nulls(spark):
    df = spark.createDataFrame([("1", -1000.0), ("1", -1001.0), ("1", None)], "k string, sum_log_probs double")
    p = [r.pmf for r in P.softmax(df, ["k"]).collect()]
    assert sum(p) == pytest.approx(1.0) and min(p) == 0.0


def test_describe_quartiles(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 4, 9)], "g string, v double")
    r = R.describe(df, ["g"], "v").first()
    assert (r.q25, r.q50, r.q75) == (1.75, 3.0, 5.25)


def test_histogram_closes_the_last_bin_and_takes_empty(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 10)], "v double")
    assert [r.n for r in R.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 1, 0, 0, 1]
    assert R.histogram(df.where("false"), "v", 5).count() == 0


def test_merge_models_with_null_keys(spark):
    a = spark.createDataFrame([(None, 1.0), ("x", 2.0)], "k string, m double")
    b = spark.createDataFrame([(None, 3.0)], "k string, m double")
    rows = {r.k: (r.m_a, r.m_b) for r in R.merge_models({"a": a, "b": b}, ["k"], ["m"]).collect()}
    assert rows == {None: (1.0, 3.0), "x": (2.0, None)}


def test_saturation_stops(spark):
    rows = [("p", 1, 0.0), ("p", 2, -9.0), ("p", 3, -9.0), ("p", 4, 0.0)]
    df = spark.createDataFrame(rows, "k string, round int, log_prob double")
    assert tuple(P.saturation(df, "k").first()) == ("p", 3, 3)
