"""Response distributions: link, log-likelihood, derivatives and quantiles, on numpy arrays of one series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tidecast.functions import special as S


def expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class Family:
    """``parts(y, eta, phi, n)`` gives the log-likelihoods, their derivative by eta and the Fisher weight."""

    name: str
    link: str
    parts: Callable
    quantile: Callable  # (q, mean, phi, capacity)
    lower: bool = False
    upper: bool = False
    counts_of: bool = False  # y out of a capacity
    dispersion: Callable | None = None  # kappa, mean of y, variance bound, capacity -> phi
    kappa_top: Callable | None = None


def _normal(y, eta, phi, n):
    r = y - eta
    return -0.5 * (r / phi) ** 2 - np.log(phi) - 0.5 * np.log(2 * np.pi), r / phi**2, np.full_like(eta, 1 / phi**2)


def _poisson(y, eta, phi, n):
    mu = np.exp(np.clip(eta, -700, 700))
    return y * eta - mu - S.lgamma(y + 1), y - mu, mu


def _binomial(y, eta, phi, n):
    p = expit(eta)
    ll = y * -np.logaddexp(0, -eta) + (n - y) * -np.logaddexp(0, eta) + S.lgamma(n + 1) - S.lgamma(y + 1) - S.lgamma(n - y + 1)
    return ll, y - n * p, n * p * (1 - p)


def _negative_binomial(y, eta, phi, n):
    mu = np.exp(np.clip(eta, -700, 700))
    ll = S.lgamma(y + phi) - S.lgamma(np.full_like(mu, phi)) - S.lgamma(y + 1) + phi * np.log(phi / (phi + mu)) + y * (eta - np.log(phi + mu))
    return ll, (y - mu) * phi / (phi + mu), mu * phi / (phi + mu)


def _gamma(y, eta, phi, n):
    a = np.clip(phi * np.exp(np.clip(eta, -700, 700)), 1e-10, 1e12)
    ly = np.log(y)
    ll = a * np.log(phi) - S.lgamma(a) + (a - 1) * ly - phi * y
    return ll, a * (np.log(phi) - S.digamma(a) + ly), a * a * S.trigamma(a)


def _beta(y, eta, phi, n):
    p = np.clip(expit(eta), 1e-9, 1 - 1e-9)
    a, b = p * phi, (1 - p) * phi
    ll = S.lgamma(np.full_like(p, phi)) - S.lgamma(a) - S.lgamma(b) + (a - 1) * np.log(y) + (b - 1) * np.log1p(-y)
    g = p * (1 - p)
    return ll, phi * (np.log(y / (1 - y)) - S.digamma(a) + S.digamma(b)) * g, phi**2 * (S.trigamma(a) + S.trigamma(b)) * g * g


def _beta_binomial(y, eta, phi, n):
    p = np.clip(expit(eta), 1e-9, 1 - 1e-9)
    a, b, g = p * phi, (1 - p) * phi, p * (1 - p)
    phi = np.broadcast_to(phi, p.shape)
    ll = S.lgamma(n + 1) - S.lgamma(y + 1) - S.lgamma(n - y + 1) + S.lgamma(y + a) + S.lgamma(n - y + b) - S.lgamma(n + phi) + S.lgamma(phi) - S.lgamma(a) - S.lgamma(b)
    return ll, phi * (S.digamma(y + a) - S.digamma(a) - S.digamma(n - y + b) + S.digamma(b)) * g, n * g / (1 + (n - 1) / (phi + 1))


def _of_mean(mean, n):
    return np.clip(mean / np.maximum(n, 1e-300), 0, 1)


FAMILIES: dict[str, Family] = {
    f.name: f
    for f in (
        Family("normal", "identity", _normal, lambda q, mean, phi, n: mean + phi * S.normal_ppf(q), dispersion=lambda k, ybar, v, n: np.sqrt(v) * k),
        Family("poisson", "log", _poisson, lambda q, mean, phi, n: S.poisson_ppf(q, mean), lower=True),
        Family("binomial", "logit", _binomial, lambda q, mean, phi, n: S.binomial_ppf(q, n, _of_mean(mean, n)), True, True, True),
        Family(
            "negative binomial", "log", _negative_binomial, lambda q, mean, phi, n: S.negative_binomial_ppf(q, np.maximum(mean, 1e-12), phi), lower=True,
            # An under-dispersed series has no such distribution; the bound on the variance is kept above the mean.
            dispersion=lambda k, ybar, v, n: ybar**2 / (max(v - ybar, 1e-3 * ybar) * k**2),
        ),
        Family("gamma", "log", _gamma, lambda q, mean, phi, n: S.gamma_ppf(q, np.maximum(mean * phi, 1e-10), 1 / phi), lower=True, dispersion=lambda k, ybar, v, n: ybar / (v * k**2)),
        Family(
            "beta", "logit", _beta, lambda q, mean, phi, n: S.beta_ppf(q, np.clip(mean, 1e-9, 1 - 1e-9) * phi, (1 - np.clip(mean, 1e-9, 1 - 1e-9)) * phi), True, True,
            dispersion=lambda k, ybar, v, n: np.maximum(ybar * (1 - ybar) / (v * k**2) - 1, 1e-6), kappa_top=lambda ybar, v: min(ybar * (1 - ybar) / v - 1e-9, 2.0),
        ),
        Family(
            "beta-binomial", "logit", _beta_binomial, lambda q, mean, phi, n: S.beta_binomial_ppf(q, n, np.maximum(_of_mean(mean, n) * phi, 1e-9), np.maximum((1 - _of_mean(mean, n)) * phi, 1e-9)), True, True, True,
            dispersion=lambda k, ybar, v, n: np.maximum(4 * (n - 1) / (np.maximum(n, 1) * k**2) - 1, 1e-6),
        ),
    )
}

LINK = {"identity": lambda y: y, "log": np.log, "logit": lambda y: np.log(y / (1 - y))}
INVERSE = {"identity": lambda x: x, "log": lambda x: np.exp(np.clip(x, -700, 700)), "logit": expit}
