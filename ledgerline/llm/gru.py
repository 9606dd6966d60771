"""A bidirectional gated recurrent network over bytes, in numpy: forward pass, backpropagation through time, Adam.

A step reads a patch of bytes (its own `stride` bytes and one to either side), turns them into features by one rectified layer,
and hands those to two recurrent layers, one for either direction. Both directions go through the time loop together, as arrays with the
batch last, so each numpy call works on contiguous memory.
"""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]


def init(classes: int, *, hidden: int, embed: int, stride: int, features: int, seed: int = 1) -> Weights:
    """Random weights. Each byte of a patch goes through the same table of 256 vectors."""
    r = np.random.default_rng(seed)
    wide = (stride + 2) * embed

    def uniform(*shape: int) -> np.ndarray:
        return r.uniform(-1, 1, shape).astype(np.float32) / np.float32(np.sqrt(shape[-2]))

    return {
        "E": r.normal(0, 0.7, (256, embed)).astype(np.float32),
        "P": uniform(wide, features) * np.float32(1.4),
        "p": np.zeros(features, np.float32),
        "W": uniform(2, features, 3 * hidden),
        "U": uniform(2, hidden, 3 * hidden),
        "b": np.zeros((2, 3 * hidden, 1), np.float32),
        "V": uniform(2 * hidden, classes),
        "c": np.zeros((classes, 1), np.float32),
    }


def _patches(data: np.ndarray, stride: int) -> np.ndarray:
    """(steps, batch, stride + 2) bytes of windows (batch, steps * stride + 2), whose first and last byte only border on the steps."""
    batch, n = data.shape
    steps = (n - 2) // stride
    return data[:, np.arange(steps)[:, None] * stride + np.arange(stride + 2)].transpose(1, 0, 2)


def _features(w: Weights, patches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = w["E"][patches].reshape(-1, w["P"].shape[0])
    x = flat @ w["P"]
    x += w["p"]
    np.maximum(x, 0, out=x)
    return flat, x


def _gates(w: Weights, x: np.ndarray, steps: int, batch: int) -> np.ndarray:
    """(steps, 2, 3 * hidden, batch): what the inputs add to the gates (update, reset, new); the second direction has the time turned round."""
    xt = x.reshape(steps, batch, -1).transpose(0, 2, 1)
    g = np.empty((steps, 2, w["W"].shape[2], batch), np.float32)
    np.matmul(w["W"][0].T, xt, out=g[:, 0])
    np.matmul(w["W"][1].T, xt[::-1], out=g[:, 1])
    g += w["b"]
    return g


def _run(gates: np.ndarray, u: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Hidden states (steps, 2, hidden, batch)."""
    steps, _, three, batch = gates.shape
    h3 = three // 3
    ut = np.ascontiguousarray(u.transpose(0, 2, 1))
    h = np.zeros((2, h3, batch), np.float32)
    out = np.empty((steps, 2, h3, batch), np.float32)
    hu = np.empty((2, three, batch), np.float32)
    for t in range(steps):
        np.matmul(ut, h, out=hu)
        x = gates[t]
        zr = x[:, : 2 * h3] + hu[:, : 2 * h3]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        n = zr[:, h3:] * hu[:, 2 * h3 :]
        n += x[:, 2 * h3 :]
        np.tanh(n, out=n)
        if keep is not None:
            keep["z"][t], keep["r"][t], keep["n"][t], keep["hn"][t], keep["h"][t] = zr[:, :h3], zr[:, h3:], n, hu[:, 2 * h3 :], h
        new = out[t]
        np.subtract(h, n, out=new)
        new *= zr[:, :h3]
        new += n
        h = new
    return out


def _logits(w: Weights, states: np.ndarray) -> np.ndarray:
    h = w["U"].shape[1]
    y = np.matmul(w["V"][:h].T, states[:, 0])
    y += np.matmul(w["V"][h:].T, states[::-1, 1])
    y += w["c"]
    y -= y.max(1, keepdims=True)
    return y


def log_probabilities(w: Weights, data: np.ndarray, stride: int) -> np.ndarray:
    """(steps, classes, batch): log probabilities of each class at each step, whose bytes share them. data: (batch, steps * stride + 2) bytes."""
    patches = _patches(data, stride)
    steps, batch, _ = patches.shape
    y = _logits(w, _run(_gates(w, _features(w, patches)[1], steps, batch), w["U"]))
    y -= np.log(np.exp(y).sum(1, keepdims=True))
    return y


def loss_and_gradients(w: Weights, data: np.ndarray, label: np.ndarray, weight: np.ndarray, stride: int) -> tuple[float, Weights]:
    """Mean cross-entropy over the weighted steps, and its gradients by backpropagation through time.

    data (batch, bytes), label and weight (steps, batch).
    """
    patches = _patches(data, stride)
    steps, batch, _ = patches.shape
    h = w["U"].shape[1]
    flat, x = _features(w, patches)
    k = {name: np.empty((steps, 2, h, batch), np.float32) for name in ("z", "r", "n", "hn", "h")}
    states = _run(_gates(w, x, steps, batch), w["U"], k)
    p = np.exp(_logits(w, states))
    p /= p.sum(1, keepdims=True)
    wt = (weight / max(float(weight.sum()), 1.0)).astype(np.float32)
    at = np.arange(steps)[:, None], label, np.arange(batch)
    loss = float(-(np.log(p[at] + 1e-9) * wt).sum())
    p[at] -= 1
    p *= wt[:, None, :]
    f, b = states[:, 0], states[::-1, 1]
    g: Weights = {"V": np.concatenate((np.einsum("thb,tcb->hc", f, p, optimize=True), np.einsum("thb,tcb->hc", b, p, optimize=True))), "c": p.sum((0, 2))[:, None]}
    outer = np.stack((np.matmul(w["V"][:h], p), np.matmul(w["V"][h:], p)[::-1]), 1)
    dgate = np.empty((steps, 2, 3 * h, batch), np.float32)
    du = np.zeros_like(w["U"])
    dh = np.zeros((2, h, batch), np.float32)
    for t in range(steps - 1, -1, -1):
        dh = dh + outer[t]
        z, r, n, hn, old = k["z"][t], k["r"][t], k["n"][t], k["hn"][t], k["h"][t]
        dn = dh * (1 - z) * (1 - n * n)
        a = dgate[t]
        a[:, :h] = dh * (old - n) * z * (1 - z)
        a[:, h : 2 * h] = dn * hn * r * (1 - r)
        a[:, 2 * h :] = dn
        inner = np.concatenate((a[:, : 2 * h], dn * r), 1)
        du += old @ inner.transpose(0, 2, 1)
        dh = dh * z + w["U"] @ inner
    g["U"], g["b"] = du, dgate.sum((0, 3))[:, :, None]
    d0 = dgate[:, 0].transpose(0, 2, 1).reshape(steps * batch, -1)
    d1 = dgate[::-1, 1].transpose(0, 2, 1).reshape(steps * batch, -1)
    g["W"] = np.stack((x.T @ d0, x.T @ d1))
    dx = d0 @ w["W"][0].T + d1 @ w["W"][1].T
    dx[x <= 0] = 0
    g["P"], g["p"] = flat.T @ dx, dx.sum(0)
    embed = w["E"].shape[1]
    dxe = (dx @ w["P"].T).reshape(-1, embed)
    order = patches.reshape(-1)
    g["E"] = np.stack([np.bincount(order, dxe[:, j], 256) for j in range(embed)], 1)
    return loss, g


def fit(w: Weights, draw, *, steps: int, stride: int, rate: float = 0.01) -> float:
    """Adam over so many drawn batches (draw(i) gives data, label, weight); the rate falls to a tenth. Changes w; returns the last losses' mean."""
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    last: list[float] = []
    for i in range(1, steps + 1):
        data, label, weight = draw(i)
        loss, g = loss_and_gradients(w, data, label, weight, stride)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        lr = rate * (1 - 0.9 * i / steps)
        for k, x in g.items():
            x = x * scale
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            w[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        last = [*last[-19:], loss]
    return float(np.mean(last))
