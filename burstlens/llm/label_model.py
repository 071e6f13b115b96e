"""A generative model of voters that may be wrong and may copy each other."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np

ROUNDS = 25
# Voters whose errors correlate less than this are taken as independent.
LEAST_CORRELATION = 0.1


def _logit(p):
    return np.log(p) - np.log1p(-p)


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> SimpleNamespace:
    """How often each voter fires in either class, how voters correlate, and the posterior.

    ``votes`` (rows x voters, 0/1) come from one of two hidden classes; ``start`` is a
    first guess of the chance of class 1. In turns, firing rates per class are estimated
    from the posterior, then the correlations that voters keep within the likelier class,
    and then the posterior from the votes. A voter counts in inverse proportion to the sum of its
    correlations, so several voters that say the same weigh about as much as one.
    """
    votes = votes.astype(float)
    posterior = np.clip(start, 0.02, 0.98)
    n_voters = votes.shape[1]
    for _ in range(rounds):
        w1, w0 = posterior.sum(), (1 - posterior).sum()
        fires1 = (posterior @ votes + 0.5) / (w1 + 1.0)
        fires0 = ((1 - posterior) @ votes + 0.5) / (w0 + 1.0)
        # Within the likelier class: an undecided posterior would leave the classes' own
        # difference in the rest, make voters look correlated, and so undecide itself.
        likely = (posterior > 0.5).astype(float)
        mean1 = likely @ votes / max(likely.sum(), 1.0)
        mean0 = (1 - likely) @ votes / max((1 - likely).sum(), 1.0)
        rest = votes - np.outer(likely, mean1) - np.outer(1 - likely, mean0)
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        correlation = (rest.T @ rest) / len(votes) / np.outer(spread, spread)
        strength = np.abs(np.clip(correlation, -1, 1))
        strength[strength < LEAST_CORRELATION] = 0.0
        weight = 1 / np.maximum(strength.sum(axis=1), 1.0)
        prior = np.clip(w1 / len(votes), 1e-4, 1 - 1e-4)
        on = weight * (np.log(fires1) - np.log(fires0))
        off = weight * (np.log1p(-fires1) - np.log1p(-fires0))
        evidence = _logit(prior) + votes @ on + (1 - votes) @ off
        after = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
        moved = np.abs(after - posterior).max(initial=0.0)
        posterior = after
        if moved < 1e-4:
            break
    accuracy = np.where(fires1 + fires0 > 0, fires1 / (fires1 + fires0), 0.5)
    return SimpleNamespace(
        posterior=posterior, fires1=fires1, fires0=fires0, accuracy=accuracy,
        correlation=correlation, weight=weight, prior=prior, n_voters=n_voters,
    )


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, rounds: int = 20):
    """Logistic regression on target chances by Newton steps: weights, the last the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - target) + ridge * weights
        curve = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(ridge), gradient)
        # A long step may overshoot where the target is nearly separable.
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        weights -= step
        if np.abs(step).max() < 1e-5:
            break
    return weights
