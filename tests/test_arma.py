"""Moving-average and seasonal terms: parameters recovered, recursions against plain loops, the search against trying all."""

import numpy as np
import pytest

from almanac.plans import arma, sarima
from almanac.plans import autoregression as A


def simulate(rng, n, phi=0.0, big_phi=0.0, theta=0.0, big_theta=0.0, before=200):
    """Values of (1 - phi B)(1 - PHI B^12) z = (1 + theta B)(1 + THETA B^12) e."""
    e, z = rng.normal(size=n + before), np.zeros(n + before)
    for t in range(13, n + before):
        z[t] = phi * z[t - 1] + big_phi * z[t - 12] - phi * big_phi * z[t - 13]
        z[t] += e[t] + theta * e[t - 1] + big_theta * e[t - 12] + theta * big_theta * e[t - 13]
    return z[before:]


def seasonal_sums(z):
    """A series whose seasonal difference of differences is z."""
    y = list(np.linspace(50, 60, 13))
    for x in z:
        y.append(x + y[-1] + y[-12] - y[-13])
    return y


def by_series(df):
    return {r.series_id: r for r in df.collect()}


# --- ARIMA(1,1,1) -------------------------------------------------------------------------


def test_theta_and_phi_are_recovered(monthly):
    rng = np.random.default_rng(4)
    steps = [simulate(rng, 700, phi=0.5, theta=0.4) + 0.2 for _ in range(12)]
    df = monthly({f"s{i}": np.cumsum(s).tolist() for i, s in enumerate(steps)})
    found = arma.arma_fit(arma.arma_rows(df)).collect()
    assert np.mean([r.phi for r in found]) == pytest.approx(0.5, abs=0.06)
    assert np.mean([r.theta for r in found]) == pytest.approx(0.4, abs=0.06)
    assert np.mean([r.const / (1 - r.phi) for r in found]) == pytest.approx(np.mean([s[:560].mean() for s in steps]), abs=0.02)


def brute_arma(y):
    n_train = len(y) - -(-len(y) // 5)
    d = np.diff(y[:n_train])
    lags = np.column_stack([np.ones(len(d) - arma.LONG), *[d[arma.LONG - k : len(d) - k] for k in range(1, arma.LONG + 1)]])
    shock = d[arma.LONG :] - lags @ np.linalg.lstsq(lags, d[arma.LONG :], rcond=None)[0]
    x = np.column_stack([np.ones(len(shock) - 1), d[arma.LONG : -1], shock[:-1]])
    const, phi, theta = np.linalg.lstsq(x, d[arma.LONG + 1 :], rcond=None)[0]
    e, fitted = 0.0, [None, None]
    for t in range(1, len(d)):
        e = d[t] - const - phi * d[t - 1] - theta * e
        fitted.append(y[t + 1] - e)
    last, step = y[n_train - 1], const + phi * d[-1] + theta * e
    for _ in range(len(y) - n_train):
        last += step
        fitted.append(last)
        step = const + phi * step
    return (phi, theta, const), fitted


def test_arma_against_plain_loops(monthly):
    rng = np.random.default_rng(6)
    y = np.cumsum(simulate(rng, 90, phi=0.3, theta=-0.5)).tolist()
    df = monthly({"a": y, "short": [1, 2, 3], "flat": [2] * 40})
    (phi, theta, const), fitted = brute_arma(y)
    rows = sorted((r for r in arma.arma_predictions(df).collect() if r.series_id == "a"), key=lambda r: (r.year, r.month))
    assert (rows[0].phi, rows[0].theta, rows[0].const) == pytest.approx((phi, theta, const))
    assert [r.predicted for r in rows[:2]] == [None, None]
    assert [r.predicted for r in rows[2:]] == pytest.approx(fitted[2:])


def test_series_that_cannot_be_fitted_stay(monthly):
    report = by_series(arma.arma_report(monthly({"short": [1, 2, 3], "flat": [2] * 40, "one": [5]})))
    assert set(report) == {"short", "flat", "one"}
    assert report["short"].phi is None and report["one"].theta is None
    assert (report["flat"].phi, report["flat"].theta, report["flat"].test_mae) == (0.0, 0.0, 0.0)


# --- Seasonal -----------------------------------------------------------------------------


def test_seasonal_parameters_are_recovered(monthly):
    rng = np.random.default_rng(5)
    df = monthly({f"s{i}": seasonal_sums(simulate(rng, 480, 0.5, 0.5, 0.3, 0.4)) for i in range(16)})
    models = sarima.sarima_fit(df).collect()
    mean = [np.mean([r[c][0] for r in models]) for c in ("phi", "seasonal_phi", "theta", "seasonal_theta")]
    assert mean == pytest.approx([0.5, 0.5, 0.3, 0.4], abs=0.08)


def test_aic_counts_all_parameters_and_the_variance(monthly):
    rng = np.random.default_rng(7)
    df = monthly({"a": seasonal_sums(simulate(rng, 120, 0.5))})
    for orders in ((1, 1, 1, 1), (0, 0, 0, 0), (2, 1, 0, 1)):
        m = sarima.sarima_fit(df, orders).first()
        assert m.aic == pytest.approx(m.n * np.log(m.sse / m.n) + 2 * (sum(orders) + 1))
        assert [len(m[c]) for c in ("phi", "theta", "seasonal_phi", "seasonal_theta")] == list(orders)


def plain_innovations(z, phi, big_phi, theta, big_theta):
    e = np.zeros(len(z))
    for t in range(sarima.SKIP, len(z)):
        e[t] = z[t] - phi * z[t - 1] - big_phi * z[t - 12] + phi * big_phi * z[t - 13]
        e[t] -= theta * e[t - 1] + big_theta * e[t - 12] + theta * big_theta * e[t - 13]
    return e


def test_fit_is_a_minimum_and_forecasts_follow_the_recursion(monthly):
    rng = np.random.default_rng(8)
    y = np.array(seasonal_sums(simulate(rng, 150, 0.4, 0.2, 0.3, -0.5)))
    df = monthly({"a": y.tolist(), "short": [1.0] * 30})
    m = sarima.sarima_fit(df).first()
    n_train = len(y) - -(-len(y) // 5)
    z = (y[12:] - y[:-12])[1:n_train - 12] - (y[12:] - y[:-12])[: n_train - 13]
    given = [m[c][0] for c in ("phi", "seasonal_phi", "theta", "seasonal_theta")]
    e = plain_innovations(z, *given)
    assert m.innovations == pytest.approx(list(e)) and m.sse == pytest.approx((e**2).sum())
    for i in range(4):
        for change in (-0.01, 0.01):
            moved = [g + change * (i == j) for j, g in enumerate(given)]
            assert (plain_innovations(z, *moved) ** 2).sum() > m.sse
    values, zs, es = list(y[:n_train]), list(z), list(e)
    phi, big_phi, theta, big_theta = given
    for x in m.path:
        following = phi * zs[-1] + big_phi * zs[-12] - phi * big_phi * zs[-13] + theta * es[-1] + big_theta * es[-12] + theta * big_theta * es[-13]
        values.append(following + values[-1] + values[-12] - values[-13])
        zs.append(following)
        es.append(0.0)
        assert x == pytest.approx(values[-1])
    report = by_series(sarima.sarima_report(df))
    assert report["short"].aic is None and report["a"].test_rmse == pytest.approx(np.sqrt(np.mean((np.array(m.path) - y[n_train:]) ** 2)))


def test_better_than_two_lags_on_the_registered_panel(spark):
    from almanac.catalog import panels

    panel = panels.supplier_monthly(spark, "/root/testdata/sf0.01")
    mean = lambda report: np.mean([r.test_rmse for r in report.collect()])
    assert mean(sarima.sarima_report(panel)) < mean(A.seasonal_report(panel))
    assert mean(arma.arma_report(panel)) < mean(A.ar1_report(panel))


def test_stepwise_search_finds_what_trying_all_finds(monthly):
    rng = np.random.default_rng(9)
    kinds = [(0.6, 0, 0, 0), (0, 0, 0.6, 0), (0.5, 0, 0, -0.6), (0, 0.5, 0.4, 0), (0.4, 0, 0.5, -0.5)]
    df = monthly({f"s{i:02d}": seasonal_sums(simulate(rng, 170, *kinds[i % 5])) for i in range(20)})
    tried = sarima.order_search(df)
    everything = sarima.fit_models(sarima._with_orders(sarima.histories(df), sarima.every_order()), detail=False)
    key = lambda r: tuple(r[c] for c in sarima.ORDERS)
    stepwise, exhaustive = ({r.series_id: key(r) for r in sarima.best_orders(x).collect()} for x in (tried, everything))
    assert len(stepwise) == 20 and stepwise == exhaustive
    assert tried.count() < everything.count()
    assert tried.select("series_id", *sarima.ORDERS).distinct().count() == tried.count()


def test_search_over_no_series(monthly):
    df = monthly({"short": [1.0] * 20})
    assert sarima.order_search(df).count() == 0 and sarima.sarima_fit(df).count() == 0
