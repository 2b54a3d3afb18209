"""Log-probabilities and gradients of the network against a plain computation: values, whatever the size of the weights, and work."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tidemark.llm import pseudolikelihood as pl


def plain_choices(weights, bias, h, chosen):
    """Log-probability of each choice and the probabilities of all; every logit has its bias added and its maximum taken off."""
    x = weights.T @ h + bias[:, None]
    x -= x.max(axis=0)
    at = x[chosen, np.arange(len(chosen))]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x /= total
    return at - np.log(total), x


def plain(w, tokens, around):
    order = np.argsort(tokens // pl.SIZE, kind="stable")
    t = tokens[order]
    h = np.tanh(w["w1"].T @ w["embed"][around[order]].reshape(len(t), -1).T + w["b1"][:, None])
    out = np.empty(len(t))
    found, p = plain_choices(w["wc"], w["bc"], h, t // pl.SIZE)
    p[t // pl.SIZE, np.arange(len(t))] -= 1
    g = {"wc": h @ p.T / len(t), "bc": p.sum(axis=1) / len(t), "ww": np.zeros_like(w["ww"]), "bw": np.zeros_like(w["bw"])}
    for c in np.unique(t // pl.SIZE):
        part = np.flatnonzero(t // pl.SIZE == c)
        more, p = plain_choices(w["ww"][c], w["bw"][c], h[:, part], t[part] % pl.SIZE)
        found[part] += more
        p[t[part] % pl.SIZE, np.arange(len(part))] -= 1
        g["ww"][c], g["bw"][c] = h[:, part] @ p.T / len(t), p.sum(axis=1) / len(t)
    out[order] = found
    return out, g


def some(n, kind):
    rng = np.random.default_rng(4)
    tokens = np.minimum(rng.zipf(1.3, n) - 1, pl.IDS - 1).astype(np.int32)
    return {k: v.astype(kind) for k, v in pl.first_weights(np.bincount(tokens, minlength=pl.IDS)).items()}, tokens, pl.windows(tokens, np.array([0, n // 3, n]))


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("times", [1, 40, 4000])
def test_weights_of_any_size(times, kind):
    """Logits of several thousands are beyond what an exponential can hold."""
    w, tokens, around = some(5000, kind)
    w |= {k: w[k] * kind(times) for k in ("wc", "ww")}
    assert pl._joint(w)[2] == (times < 4000)
    want, of = plain({k: v.astype(float) for k, v in w.items()}, tokens, around)
    near = 1e-9 if kind is np.float64 else 2e-5 * times
    assert np.abs(pl.log_probs(w, tokens, around) - want).max() < near
    g = pl.gradients(w, tokens, around)
    for k in of:
        assert np.isfinite(g[k]).all() and (times > 1 and kind is np.float32 or np.abs(g[k] - of[k]).max() < (1e-12 if kind is np.float64 else 1e-6)), k


def test_scoring_costs_less_than_the_plain_computation():
    w, tokens, around = some(1 << 16, np.float32)
    took = {"own": [], "plain": []}
    for _ in range(5):
        for name, f in (("own", pl.log_probs), ("plain", one_pass)):
            began = time.process_time()
            f(w, tokens, around)
            took[name].append(time.process_time() - began)
    assert min(took["own"]) < 0.85 * min(took["plain"]), took


def one_pass(w, tokens, around):
    """Log-probabilities with a pass each for the bias, the maximum, taking it off and the sum, in the same blocks."""
    order, classes = pl._by_class(tokens)
    t = tokens[order]
    h = np.tanh(w["w1"].T @ w["embed"][around[order]].reshape(len(t), -1).T + w["b1"][:, None])
    found = np.zeros(len(t))
    for weights, bias, own, part in [(w["wc"], w["bc"], t // pl.SIZE, slice(None)), *((w["ww"][c], w["bw"][c], t[part] % pl.SIZE, part) for c, part in classes)]:
        of, sums = h[:, part], np.empty(len(own))
        for i in range(0, len(own), pl.CACHED):
            x = weights.T @ of[:, i : i + pl.CACHED]
            x += bias[:, None]
            x -= x.max(axis=0)
            at = x[own[i : i + pl.CACHED], np.arange(x.shape[1])]
            sums[i : i + pl.CACHED] = at - np.log(np.exp(x, out=x).sum(axis=0))
        found[part] += sums
    out = np.empty_like(found)
    out[order] = found
    return out
