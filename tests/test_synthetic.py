"""Synthetic control: solver optimality, search, and whole studies on a planted panel."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators import simplex, synthetic
from creditloom.operators.synthetic import VARIANT, ScmSpec
from creditloom.plans import scm_study
from creditloom.session import cut_lineage

c = F.col


@pytest.mark.parametrize("donors, predictors", [(3, 5), (24, 13), (126, 46)])
def test_weights_satisfy_the_optimality_conditions(donors, predictors):
    rng = np.random.default_rng(donors)
    for noise in (0.0, 0.5):
        x0 = rng.normal(size=(predictors, donors))
        x1 = x0 @ rng.dirichlet(np.full(donors, 0.2)) + noise * rng.normal(size=predictors)
        w, settled = simplex.weights_for(np.full(predictors, 1 / predictors), x1, x0)
        assert settled
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        gradient = x0.T @ (x0 @ w - x1) / predictors
        assert gradient @ w - gradient.min() < 1e-7


def planted(spark, effect=3.0, units=8, periods=30, hole=False, noise=0.0):
    """Unit 1 is the mean of units 2 and 3 before t0 and jumps by the effect afterwards."""
    rng = np.random.default_rng(5)
    base = 10 + rng.normal(size=(units + 1, periods)).cumsum(axis=1) * 0.3
    other = 50 + rng.normal(size=(units + 1, periods)).cumsum(axis=1)
    for series in (base, other):
        series[1] = (series[2] + series[3]) / 2
    base[1] += noise * rng.normal(size=periods)
    base[1, 18:] += effect
    rows = []
    for u in range(1, units + 1):
        for t in range(periods):
            if hole and u == units and t == 4:
                continue
            rows.append((u, dt.date(2014 + t // 12, t % 12 + 1, 1), float(base[u, t]), float(other[u, t])))
    df = spark.createDataFrame(rows, "unit_id int, run_date date, y double, z double")
    return df.withColumn(VARIANT, F.lit("v"))


SPEC = ScmSpec(
    "y", "z", ("y", "z"), ("yr14_q1", "yr14_q2", "yr14_q3", "yr14_q4", "yr15_q1"),
    (dt.date(2014, 1, 1), dt.date(2016, 6, 1)), dt.date(2015, 6, 1),
)


@pytest.fixture(scope="module")
def study(spark):
    rows = planted(spark).cache()
    out = scm_study.placebo_study(rows, SPEC, 1, families=(), tasks=4)
    return rows, {k: v.cache() for k, v in out.items()}


def test_planted_effect_is_recovered(study):
    _, out = study
    weights = {r.donor: r.weight for r in out["weights"].where("job = '1'").collect()}
    assert weights[2] == pytest.approx(0.5, abs=1e-3) and weights[3] == pytest.approx(0.5, abs=1e-3)
    gaps = out["gaps"].where("unit_id = 1").toPandas()
    assert abs(gaps[gaps.pre == 1].gap).max() < 0.01
    assert gaps[gaps.pre == 0].gap.mean() == pytest.approx(3.0, abs=0.05)
    assert out["pvalue"].first().pvalue == pytest.approx(1 / 8)
    assert [r.donor for r in out["top_weights"].orderBy("rank").limit(2).collect()] in ([2, 3], [3, 2])


def test_every_unit_is_fitted_on_all_others(study):
    _, out = study
    sums = out["weights"].groupBy("job").agg(F.sum("weight").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 8 and all(r.n == 7 and r.s == pytest.approx(1) for r in sums)
    assert out["weights"].where("job = donor").count() == 0


def direct_search(y, w, own, post, family, precision):
    """Test inversion on whole matrices: y[unit, t], w[unit, donor], re-evaluated per candidate."""
    n = len(y)
    gap = lambda null: np.array(
        [
            y[j] + (null if j != own else 0) - w[j] @ (y + 0)
            + (w[j, own] * null if j != own else 0) - null
            for j in range(n)
        ]
    )
    base = y[own] - w[own] @ y
    k = np.cumsum(post)
    path = {"uniform": lambda p: (base + p) * post, "constant": lambda p: p * post, "linear": lambda p: p * k * post}[family]
    start = {"uniform": 0.0, "constant": base[post].mean(), "linear": base[-1] / post.sum()}[family]
    size = 1.0 if family == "uniform" else abs(start)
    alpha = np.ceil(0.05 * n) / n

    def accepted(p):
        g = gap(path(p))
        ts = (g[:, post] ** 2).mean(axis=1) / (g[:, ~post] ** 2).mean(axis=1)
        return (ts >= ts[own]).sum() / n > alpha

    if not accepted(start):
        return None
    ends = []
    for side in (-1, 1):
        bound = start
        for p in range(precision + 1):
            while accepted(bound + side * size * 0.5**p):
                bound += side * size * 0.5**p
        ends.append(bound)
    return ends


@pytest.mark.parametrize("family", synthetic.FAMILIES)
@pytest.mark.parametrize("noise", [0.0, 0.8])
def test_confidence_band_equals_direct_inversion(spark, noise, family):
    rows = planted(spark, noise=noise, effect=1.0)
    out = scm_study.placebo_study(rows, SPEC, 1, families=(family,), precision=12, tasks=4, materialise=cut_lineage)
    wide = rows.toPandas().pivot(index="unit_id", columns="run_date", values="y")
    post = np.array([d > SPEC.t0 for d in wide.columns])
    w = np.zeros((8, 8))
    for r in out["weights"].collect():
        w[int(r.job) - 1, r.donor - 1] = r.weight
    ends = direct_search(wide.to_numpy(), w, 0, post, family, 12)
    band = out[f"conf_{family}"].orderBy("run_date").toPandas()
    if ends is None:
        assert noise == 0.0 and band.lower.isna().all() and band.upper.isna().all()
        return
    low, high = ends
    own = wide.to_numpy()[0] - w[0] @ wide.to_numpy()
    k = np.cumsum(post)
    want = {"uniform": (own + low, own + high), "constant": (low + 0 * own, high + 0 * own), "linear": (low * k, high * k)}[family]
    assert band.lower[post].to_numpy() == pytest.approx(want[0][post], abs=1e-6)
    assert band.upper[post].to_numpy() == pytest.approx(want[1][post], abs=1e-6)
    assert band.lower[~post].isna().all()
    if family == "uniform":
        assert (band.lower[post] <= band.gap[post]).all() and (band.gap[post] <= band.upper[post]).all()


def test_leave_one_out_never_uses_the_dropped_donor(study):
    rows, out = study
    x, y = synthetic.predictors(rows, SPEC), synthetic.outcomes(rows, SPEC)
    jobs = synthetic.leave_one_out_jobs(synthetic.complete_units(x, y), out["weights"], 1, tolerance=1e-2)
    fitted = synthetic.donor_weights(synthetic.fit(jobs, synthetic.pack_units(x, y), tasks=2))
    seen = {(r.job, r.donor) for r in fitted.collect()}
    assert {j for j, _ in seen} == {"1-2", "1-3"}
    assert ("1-2", 2) not in seen and ("1-3", 3) not in seen and ("1-2", 3) in seen
    gaps = scm_study.leave_one_out(rows, SPEC, 1, out["weights"], tasks=2)
    assert gaps.where("pre = 0").agg(F.avg("gap")).first()[0] > 1


def test_backdating_shortens_windows():
    spec = SPEC.backdate(dt.date(2015, 1, 1), "yr14_q3")
    assert spec.quarters == ("yr14_q1", "yr14_q2", "yr14_q3") and spec.t0 == dt.date(2015, 1, 1)
    assert spec.window == SPEC.window


def test_unit_with_a_hole_leaves_the_donor_pool(spark):
    rows = planted(spark, hole=True)
    out = scm_study.placebo_study(rows, SPEC, 1, tasks=2)
    assert {r.job for r in out["weights"].select("job").distinct().collect()} == set("1234567")
    assert out["fits"].where("kind = 'failed'").count() == 0


def test_failed_fit_is_dropped_as_job_and_donor(spark):
    rows = planted(spark).withColumn("y", F.when(c("unit_id") == 4, float("nan")).otherwise(c("y")))
    x, y = synthetic.predictors(rows, SPEC), synthetic.outcomes(rows, SPEC)
    units = rows.select(VARIANT, "unit_id").distinct()
    jobs = synthetic.treated_job(units, 1)
    fitted = synthetic.fit(jobs, synthetic.pack_units(x, y), tasks=2)
    assert [(r.kind, r.job) for r in fitted.collect()] == [("failed", "1")]
    weights = synthetic.uniform_weights(units)
    kept = synthetic.drop_failed(weights, units.where("unit_id = 4"))
    assert kept.where("donor = 4 OR job = '4'").count() == 0
    assert all(r.s == pytest.approx(1) for r in kept.groupBy("job").agg(F.sum("weight").alias("s")).collect())


def test_nested_fit_is_no_worse_than_equal_importance(spark):
    rows = planted(spark)
    x, y = synthetic.predictors(rows, SPEC), synthetic.outcomes(rows, SPEC)
    packed = synthetic.pack_units(x, y)
    jobs = synthetic.treated_job(rows.select(VARIANT, "unit_id").distinct(), 5)
    loss = [synthetic.fit(jobs, packed, nested=n, tasks=1).first().loss for n in (False, True)]
    assert loss[1] <= loss[0] + 1e-12


def error_of_random_units(seed, predictors=9, donors=12, periods=14):
    rng = np.random.default_rng(seed)
    x0, y0 = rng.normal(size=(predictors, donors)), rng.normal(size=(periods, donors))
    w = rng.dirichlet(np.full(donors, 0.3))
    x1, y1 = x0 @ w + 0.3 * rng.normal(size=predictors), y0 @ w + 0.3 * rng.normal(size=periods)
    return simplex.OutcomeError(x1, x0, y1, y0), simplex.shares(rng.random(predictors) + 0.1)


@pytest.mark.parametrize("seed", range(4))
def test_slope_of_the_outcome_error_equals_differences(seed):
    error, v = error_of_random_units(seed)
    loss, slope = error.with_slope(v)
    steps = [(error.at(v + 1e-6 * d) - error.at(v - 1e-6 * d)) / 2e-6 for d in np.eye(len(v))]
    assert loss == pytest.approx(error.at(v)) and slope == pytest.approx(np.array(steps), abs=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_searches_lower_the_error_and_tell_whether_they_ended(seed):
    error, v = error_of_random_units(seed)
    for method in (simplex.downhill_simplex, simplex.quasi_newton):
        found, _ = method(error, v, 60)
        assert found.min() >= 0 and found.sum() == pytest.approx(1) and error.at(found) <= error.at(v)
        assert method(error, v, 1)[1] is False
    best, converged = simplex.best_importance(error, [v], 200)
    assert converged and error.at(best) <= min(error.at(m(error, v, 200)[0]) for m in (simplex.downhill_simplex, simplex.quasi_newton))


def test_a_search_that_breaks_down_is_left_out(monkeypatch):
    def broken(*_):
        raise np.linalg.LinAlgError

    error, v = error_of_random_units(1)
    monkeypatch.setattr(simplex, "downhill_simplex", broken)
    found, converged = simplex.best_importance(error, [v], 200)
    assert converged and error.at(found) < error.at(v)
    monkeypatch.setattr(simplex, "quasi_newton", broken)
    found, converged = simplex.best_importance(error, [v], 200)
    assert not converged and (found == v).all()


def test_rows_into_the_fit_are_jobs_and_units_per_part(spark):
    rows = planted(spark, units=20)
    x, y = synthetic.predictors(rows, SPEC), synthetic.outcomes(rows, SPEC)
    units = synthetic.complete_units(x, y)
    jobs = synthetic.placebo_jobs(units)
    assert jobs.count() == 20 and set(jobs.columns) == {VARIANT, "job", "treated", "dropped"}
    packed = synthetic.pack_units(x, y, units)
    by_parts = [
        sorted((r.job, r.donor, round(r.weight, 9)) for r in synthetic.donor_weights(synthetic.fit(jobs, packed, tasks=n)).collect())
        for n in (1, 3)
    ]
    assert by_parts[0] == by_parts[1] and len(by_parts[0]) == 20 * 19
    missing = synthetic.fit(synthetic.treated_job(units, 99), packed, tasks=2).collect()
    assert [(r.kind, r.job, r.converged) for r in missing] == [("failed", "99", None)]
    assert synthetic.fit(jobs.limit(0), packed, tasks=2).collect() == []
    nothing = synthetic.fit(jobs, packed.limit(0), tasks=2).collect()
    assert {(r.kind, r.job) for r in nothing} == {("failed", str(u)) for u in range(1, 21)}


def test_sensitivity_moves_the_p_value(spark):
    stats = spark.createDataFrame([("v", i, float(i)) for i in range(1, 11)], "variant string, unit_id int, ts double")
    p = lambda phi: synthetic.placebo_pvalue(stats, 9, phi, (c("unit_id") > 8).cast("int")).first().pvalue
    assert p(0.0) == pytest.approx(0.2) and p(2.0) > p(1.0) > p(0.0)


def test_arguments_are_checked(spark):
    coefs = spark.createDataFrame([], "variant string, unit_id int, a double, b double, k double, pre_ms double, start double")
    for bad in ({"precision": -1}, {"phi": -0.1}, {"significance": 1.0}):
        with pytest.raises(ValueError):
            synthetic.conf_set(coefs, 1, "uniform", **bad)
    with pytest.raises(ValueError):
        synthetic.conf_set(coefs, 1, "cubic")


def invert_test(
    pdf: pd.DataFrame, own: np.ndarray, family: str, precision: int, phi: float,
    significance: float | None,
) -> tuple[float, float, str]:
    """Plain definition: widest parameters not rejected, refining the step from 1 to 2^−precision on each side."""
    a, b, k, pre = (pdf[c].to_numpy(dtype=float) for c in ("a", "b", "k", "pre_ms"))
    odds = np.exp(phi * pdf["v"].to_numpy(dtype=float))
    n = len(pdf)
    if not np.isin(pdf["v"].to_numpy(dtype=float), (0.0, 1.0)).all():
        raise ValueError("v must be 0 or 1 for every unit")
    if own.sum() != 1 or not np.isfinite(pdf.loc[own, ["a", "b", "k"]].to_numpy(dtype=float)).all():
        return np.nan, np.nan, "no treated unit"
    alpha = np.ceil(0.05 * n) / n if significance is None else significance
    # Non-treated units carry no start value.
    start = float(np.nanmax(np.where(own, pdf["start"].to_numpy(dtype=float), np.nan)))

    def accepted(c: float) -> bool:
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (a + 2.0 * b * c + k * c * c) / pre
        extreme = ratio >= ratio[own][0]
        return odds[extreme].sum() / odds.sum() > alpha

    if not accepted(start):
        return np.nan, np.nan, "empty"
    # Constant and linear sets move by multiples of the start value's size.
    unit_step = 1.0 if family == "uniform" else abs(start)
    limit = 1e6 if family == "uniform" else 100.0 * abs(start)
    if unit_step == 0.0:
        return np.nan, np.nan, "degenerate"
    ends = []
    for sign in (-1.0, 1.0):
        bound = start
        for power in range(precision + 1):
            step = sign * unit_step * 0.5**power
            while accepted(bound + step):
                bound += step
                if abs(bound) > limit:
                    return np.nan, np.nan, "unbounded"
        ends.append(bound)
    return ends[0], ends[1], "found"


COEFS = "variant string, unit_id int, a double, b double, k double, pre_ms double, start double, v int"


def both_searches(spark, coefs, family, precision, phi=0.0):
    """Bounds by the plain search per variant, and those of the sweep."""
    own = (coefs["unit_id"] == 1).to_numpy()
    plain = {
        name: invert_test(part, own[part.index], family, precision, phi, None) for name, part in coefs.groupby("variant")
    }
    frame = spark.createDataFrame(coefs.astype(object).where(coefs.notna(), None).values.tolist(), COEFS)
    swept = {r.variant: (r.lower, r.upper, r.status) for r in synthetic.conf_set(frame, 1, family, precision, phi, c("v")).collect()}
    return plain, swept


@pytest.mark.parametrize("family, phi", [("uniform", 0.0), ("uniform", 0.8), ("constant", 0.0), ("linear", 0.3)])
def test_confidence_sets_equal_the_plain_search(spark, family, phi):
    rng = np.random.default_rng(len(family) + int(10 * phi))
    parts = []
    for i in range(40):
        n = int(rng.integers(2, 45))
        gap, slope = rng.normal(0, 1 + i % 3, (n, 4)), rng.normal(0, 0.4, (n, 1)) * np.ones((1, 4))
        slope[0], gap[0] = -1.0, gap[0] + (i % 5)
        if i % 4 == 0:
            slope[1:] *= rng.random((n - 1, 1)) < 0.5
        part = pd.DataFrame({"variant": f"v{i:02}", "unit_id": range(1, n + 1), "a": (gap**2).mean(1), "b": (gap * slope).mean(1), "k": (slope**2).mean(1)})
        part["pre_ms"] = rng.gamma(2.0, 1.0, n)
        part["start"] = [gap[0].mean() if family != "uniform" else 0.0] + [None] * (n - 1)
        part["v"] = rng.integers(0, 2, n)
        if i % 7 == 3:
            part.loc[n - 1, "pre_ms"] = 0.0
        if i % 7 == 5 and n > 3:
            part.loc[n - 2, ["a", "b", "k"]] = None
        parts.append(part)
    plain, swept = both_searches(spark, pd.concat(parts, ignore_index=True), family, 20, phi)
    assert plain.keys() == swept.keys() and len({s for *_, s in plain.values()}) > 1
    for name, (lower, upper, status) in plain.items():
        assert swept[name][2] == status, name
        if status == "found":
            assert swept[name][:2] == pytest.approx((lower, upper), abs=1e-9)
        else:
            assert swept[name][:2] == (None, None)


def test_confidence_sets_run_no_python_and_know_odd_inputs(spark, capsys):
    unit = lambda u, a, b, k, pre, start=0.0, v=0: ("x", u, a, b, k, pre, start, v)
    found = lambda *rows: synthetic.conf_set(spark.createDataFrame(rows, COEFS), 1, "constant", 3, v=c("v"))
    own, other = unit(1, 1.0, -1.0, 1.0, 1.0, 1.0), unit(2, 2.0, 0.0, 0.0, 1.0)
    found(own, other).explain("formatted")
    assert "Python" not in capsys.readouterr().out and "Pandas" not in str(found(own, other)._jdf.queryExecution())
    assert found(own, own, other).first().status == "no treated unit" and found(other).first().status == "no treated unit"
    assert found(unit(1, 1.0, -1.0, 1.0, None, 1.0), other).first().status == "empty"
    assert found(unit(1, 1.0, 0.0, 1.0, 1.0, 0.0), other).first().status == "degenerate"
    assert found().collect() == []
    with pytest.raises(Exception, match="v must be 0 or 1"):
        found(own, unit(2, 2.0, 0.0, 0.0, 1.0, 0.0, 2)).collect()


def test_empty_confidence_set_is_reported(spark):
    pdf = pd.DataFrame({"a": [9.0, 1.0, 1.0], "b": [0.0] * 3, "k": [0.0] * 3, "pre_ms": [1.0] * 3, "start": [0.0] * 3, "v": [0.0] * 3})
    assert invert_test(pdf, np.array([True, False, False]), "uniform", 3, 0.0, None)[2] == "empty"
    pdf = pdf.assign(variant="v", unit_id=[1, 2, 3])
    assert synthetic.conf_set(spark.createDataFrame(pdf), 1, "uniform", 3, v=c("v")).first().status == "empty"


def test_a_study_without_its_treated_unit_is_not_significant(spark):
    stats = spark.createDataFrame([("v", 2, 5.0), ("v", 3, 1.0), ("w", 1, None), ("w", 2, 4.0)], "variant string, unit_id int, ts double")
    for row in synthetic.placebo_pvalue(stats, 1).collect():
        assert (row.pvalue, row.reject, row.status) == (None, None, "no treated unit")
    pdf = pd.DataFrame({k: [1.0, 2.0] for k in ("a", "b", "k", "pre_ms", "start")} | {"v": [0.0, 0.0]})
    assert invert_test(pdf, np.array([False, False]), "uniform", 3, 0.0, None)[2] == "no treated unit"
    pdf = pdf.assign(variant="v", unit_id=[2, 3])
    assert synthetic.conf_set(spark.createDataFrame(pdf), 1, "uniform", 3, v=c("v")).first().status == "no treated unit"


def test_a_perfect_fit_before_treatment_is_as_extreme_as_can_be(spark):
    rows = [("v", u, pre, gap) for u, pre, gap in ((1, 1, 1.0), (1, 0, 9.0), (2, 1, 0.0), (2, 0, 1.0), (3, 1, 0.0), (3, 0, 0.0))]
    stats = synthetic.rmspe_ratio(spark.createDataFrame(rows, "variant string, unit_id int, pre int, gap double"))
    assert {r.unit_id: r.ts for r in stats.collect()} == {1: 81.0, 2: float("inf"), 3: None}
    assert synthetic.placebo_pvalue(stats, 1).first().pvalue == pytest.approx(2 / 3)


def test_units_with_holes_are_named(spark):
    rows = planted(spark, hole=True)
    x, y = synthetic.predictors(rows, SPEC), synthetic.outcomes(rows, SPEC)
    found = synthetic.incomplete_units(x, y).collect()
    assert [(r.unit_id, r.missing_periods, r.missing_predictors) for r in found] == [(8, 1, 0)]
    assert synthetic.complete_units(x, y).count() == 7


def test_quarters_are_ordered_across_the_century():
    spec = ScmSpec("y", "z", (), ("yr98_q4", "yr99_q4", "yr00_q1", "yr01_q2"), (dt.date(1998, 1, 1), dt.date(2002, 1, 1)), dt.date(2001, 1, 1))
    assert spec.backdate(dt.date(2000, 1, 1), "yr99_q4").quarters == ("yr98_q4", "yr99_q4")
