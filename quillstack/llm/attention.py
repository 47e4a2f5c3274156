"""The causal self-attention network of the language model, in numpy: forward, backward and Adam.

One head over windows of ``LENGTH`` inputs; the last ``STRIDE`` positions of a window are scored, the ones before them
are context, so windows that overlap by LENGTH - STRIDE score each token once. The network predicts the class of the
next word's first piece, as a correction of the class odds after the piece before.
"""

from __future__ import annotations

import numpy as np

LENGTH, STRIDE, WIDTH, HIDDEN = 32, 20, 16, 24
#: Windows that one step works on.
BATCH = 1024

#: Which inputs of the window each scored position may look at.
MASK = np.where(np.arange(LENGTH)[None, :] <= (LENGTH - STRIDE) + np.arange(STRIDE)[:, None], 0, -1e9).astype(np.float32)


def start(pieces: int, classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    """First weights: with the last layer zero, the network gives the prior odds."""
    r = np.random.default_rng(seed)
    normal = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    return {
        "embed": (r.standard_normal((pieces, WIDTH)) * 0.3).astype(np.float32), "place": (r.standard_normal((LENGTH, WIDTH)) * 0.1).astype(np.float32),
        "query": normal(WIDTH, WIDTH), "key": normal(WIDTH, WIDTH), "value": normal(WIDTH, WIDTH),
        "hidden": normal(WIDTH, HIDDEN), "shift": np.zeros(HIDDEN, np.float32), "out": np.zeros((HIDDEN, classes), np.float32),
    }


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many tokens: the padded length of each, the start of each window in the padded row of all texts,
    and the window's text."""
    count = -(-lengths // STRIDE)
    padded = count * STRIDE + (LENGTH - STRIDE)
    first = np.cumsum(padded) - padded
    text = np.repeat(np.arange(len(lengths)), count)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return padded, first[text] + rank * STRIDE, text


def body(w: dict[str, np.ndarray], inputs: np.ndarray) -> tuple:
    """(hidden units of the scored positions [windows * STRIDE, HIDDEN], what backward needs)."""
    n = len(inputs)
    h = w["embed"].take(inputs, 0)
    h += w["place"]
    late = h[:, LENGTH - STRIDE :]
    flat, flat_late = h.reshape(-1, WIDTH), np.ascontiguousarray(late).reshape(-1, WIDTH)
    q = (flat_late @ (w["query"] / np.float32(WIDTH**0.5))).reshape(n, STRIDE, WIDTH)
    k, v = (flat @ w["key"]).reshape(n, LENGTH, WIDTH), (flat @ w["value"]).reshape(n, LENGTH, WIDTH)
    a = q @ k.transpose(0, 2, 1)
    a += MASK
    np.minimum(a, 30, out=a)
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    found = (a @ v).reshape(-1, WIDTH)
    u = flat_late + found
    r = u @ w["hidden"]
    r += w["shift"]
    np.maximum(r, 0, out=r)
    return r, (flat, flat_late, q, k, v, a, found, u, r)


def odds(w: dict[str, np.ndarray], inputs: np.ndarray, prior: np.ndarray) -> tuple:
    """(class log odds of the scored positions [windows * STRIDE, classes], what backward needs)."""
    r, kept = body(w, inputs)
    logits = r @ w["out"]
    logits += prior.take(inputs[:, LENGTH - STRIDE :].reshape(-1), 0)
    return logits, kept


def chances(w: dict[str, np.ndarray], inputs: np.ndarray, prior: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Log chances of the targets at the scored positions."""
    logits, _ = odds(w, inputs, prior)
    aim = logits[np.arange(len(targets)), targets]
    np.exp(logits, out=logits)
    return aim - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def gradients(w: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, prior: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the ``live`` scored positions and its gradients."""
    d, kept = odds(w, inputs, prior)
    m = max(int(live.sum()), 1)
    at = np.arange(len(targets))
    aim = d[at, targets]
    np.exp(d, out=d)
    whole = d @ np.ones(d.shape[1], d.dtype)
    loss = float((np.log(whole) - aim)[live].sum()) / m
    share = (live / m).astype(d.dtype)
    d *= (share / whole)[:, None]
    d[at, targets] -= share
    return loss, {"out": kept[-1].T @ d, **body_gradients(w, inputs, kept, d @ w["out"].T)}


def body_gradients(w: dict[str, np.ndarray], inputs: np.ndarray, kept: tuple, dr: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of what makes the hidden units, from theirs, ``dr``."""
    flat, flat_late, q, k, v, a, found, u, r = kept
    n = len(inputs)
    dr *= r > 0
    g = {"hidden": u.T @ dr, "shift": dr.sum(0)}
    du = dr @ w["hidden"].T
    dz = du.reshape(n, STRIDE, WIDTH)
    dv = a.transpose(0, 2, 1) @ dz
    ds = dz @ v.transpose(0, 2, 1)
    # The sum of ds * a over the inputs, which is dz times what was found.
    ds -= np.einsum("ij,ij->i", du, found).reshape(n, STRIDE, 1)
    ds *= a
    scale = np.float32(WIDTH**0.5)
    dq, dk = (ds @ k).reshape(-1, WIDTH), ds.transpose(0, 2, 1) @ q
    g["query"] = flat_late.T @ dq / scale
    dk, dv = dk.reshape(-1, WIDTH), dv.reshape(-1, WIDTH)
    g["key"], g["value"] = flat.T @ dk, flat.T @ dv
    dh = (dk @ w["key"].T + dv @ w["value"].T).reshape(n, LENGTH, WIDTH)
    dh[:, LENGTH - STRIDE :] += (du + dq @ w["query"].T / scale).reshape(n, STRIDE, WIDTH)
    g["place"] = dh.sum(0)
    pieces, dh = inputs.reshape(-1).astype(np.intp), dh.reshape(-1, WIDTH)
    g["embed"] = np.stack([np.bincount(pieces, dh[:, i], len(w["embed"])) for i in range(WIDTH)], 1).astype(w["embed"].dtype)
    return g


class Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = w, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in w.items()}
        self.v = {k: np.zeros_like(x) for k, x in w.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in self.w.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.01 * (g[k] ** 2 - self.v[k])
            x -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def flatten(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflatten(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
