"""The cumulative-link fit against another optimiser of the same likelihood, and on ratings that decided nothing."""

from __future__ import annotations

import numpy as np
import pytest

from pipewright.llm import quality


def value(weights, thresholds, rows, grades, scale, counted):
    """Log-likelihood of the grades, each counted as often as the fit does, less the ridge; and its gradient, by the definition."""
    total, by_weight, by_threshold = -quality.RIDGE / 2 * (weights**2).sum(), -quality.RIDGE * weights, np.zeros(len(thresholds))
    for row, grade, times in zip(rows, grades, counted, strict=True):
        score = (weights[row] * scale[row]).sum()
        below = lambda k: 0.0 if k < 0 else 1.0 if k >= len(thresholds) else 1 / (1 + np.exp(score - thresholds[k]))  # noqa: E731, B023  P(grade <= k)
        upper, lower = below(grade), below(grade - 1)
        p = upper - lower
        total += times * np.log(p)
        slope_up, slope_low = upper * (1 - upper), lower * (1 - lower)
        by_weight[row] += times * -(slope_up - slope_low) / p * scale[row]
        if grade < len(thresholds):
            by_threshold[grade] += times * slope_up / p
        if grade > 0:
            by_threshold[grade - 1] -= times * slope_low / p
    return total, by_weight, by_threshold


def climbed(rows, grades, n_grades, size, scale, counted):
    """Projected gradient ascent with step halving, from other starting points than the fit's."""
    weights, thresholds = np.full(size, -0.1), np.linspace(-1.0, 1.0, n_grades - 1)
    best, step = value(weights, thresholds, rows, grades, scale, counted), 0.1
    for _ in range(600):
        while step > 1e-9:
            w, t = np.minimum(0.0, weights + step * best[1]), thresholds + step * best[2]
            if (np.diff(t) > 0).all():
                found = value(w, t, rows, grades, scale, counted)
                if found[0] > best[0]:
                    break
            step /= 2
        else:
            break
        gain, weights, thresholds, best = found[0] - best[0], w, t, found
        step *= 1.6
        if gain < 1e-7:
            break
    return weights, thresholds, best[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_fit_reaches_another_optimisers_likelihood(seed):
    r = np.random.default_rng(seed)
    size, n, n_grades = 12, 150, 3
    true = -r.uniform(0, 2.5, size)
    rows = [np.sort(r.choice(size, r.integers(0, 6), replace=False)) for _ in range(n)]
    scale = r.uniform(0.5, 2, size)
    scores = np.array([(true[x] * scale[x]).sum() for x in rows])
    grades = (r.logistic(size=n) + scores > np.array([[-4.0], [-1.5]])).sum(axis=0)
    counted = np.minimum(quality.MOST_WEIGHT, n / n_grades / np.maximum(1, np.bincount(grades, minlength=n_grades)))[grades]
    model = quality.fit(rows, grades, n_grades, np.arange(size), scale)
    mine = value(model.weights / scale, model.thresholds, rows, grades, scale, counted)[0]
    weights, thresholds, other = climbed(rows, grades, n_grades, size, scale, counted)
    nothing = value(np.zeros(size), np.quantile(scores, [0.2, 0.6]), rows, grades, scale, counted)[0]
    assert mine > other - 0.01 * (other - nothing)
    tails = lambda w, t: 1 / (1 + np.exp(t[None, :] - np.array([(w[x] * scale[x]).sum() for x in rows])[:, None]))
    assert np.abs(tails(weights, thresholds) - tails(model.weights / scale, model.thresholds)).mean() < 0.03
