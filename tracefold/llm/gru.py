"""A bidirectional gated recurrent network over bytes, in numpy: training by backpropagation through time, and labelling.

Arrays are (feature, row): all elementwise work runs along the rows. A direction has an input table X (3H x 256) for the
reset gate, the update gate and the candidate state, recurrent weights U (3H x H) and a bias c of the candidate's recurrent
part:

    r = sigmoid(Xr[b] + Ur h)    z = sigmoid(Xz[b] + Uz h)    n = tanh(Xn[b] + r (Un h + c))    h' = n + z (h - n)

Each position is labelled from the states of both directions.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(hidden: int, labels: int, seed: int) -> Params:
    r = np.random.default_rng(seed)
    p: Params = {"d": np.zeros((labels, 1), dtype=np.float32)}
    for side in "fb":
        p[f"X{side}"] = r.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        p[f"X{side}"][hidden : 2 * hidden] += 1  # open update gates: states last from the start
        p[f"U{side}"] = (r.normal(0, 1, (3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        p[f"c{side}"] = np.zeros((hidden, 1), dtype=np.float32)
        p[f"V{side}"] = (r.normal(0, 1, (labels, hidden)) / np.sqrt(hidden)).astype(np.float32)
    return p


def _run(p: Params, side: str, x: np.ndarray) -> dict:
    """The states over x (T x N bytes), with what the backward pass needs."""
    hidden = p[f"U{side}"].shape[1]
    t, n = x.shape
    order = range(t) if side == "f" else range(t - 1, -1, -1)
    h = np.zeros((hidden, n), dtype=np.float32)
    keep: dict = {"order": list(order), "h": {}, "r": {}, "z": {}, "n": {}, "g": {}, "out": np.empty((t, hidden, n), dtype=np.float32)}
    for i in keep["order"]:
        a, g = p[f"X{side}"][:, x[i]], p[f"U{side}"] @ h
        r, z = sigmoid(a[:hidden] + g[:hidden]), sigmoid(a[hidden : 2 * hidden] + g[hidden : 2 * hidden])
        gn = g[2 * hidden :] + p[f"c{side}"]
        c = np.tanh(a[2 * hidden :] + r * gn)
        keep["h"][i], keep["r"][i], keep["z"][i], keep["n"][i], keep["g"][i] = h, r, z, c, gn
        h = c + z * (h - c)
        keep["out"][i] = h
    return keep


def gradients(p: Params, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy of all positions of x (T x N) against the row labels y, and its gradient."""
    t, n = x.shape
    runs = {s: _run(p, s, x) for s in "fb"}
    logits = np.einsum("lh,thn->tln", p["Vf"], runs["f"]["out"]) + np.einsum("lh,thn->tln", p["Vb"], runs["b"]["out"]) + p["d"]
    logits -= logits.max(axis=1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=1, keepdims=True)
    loss = float(-(np.log(prob[:, y, np.arange(n)] + 1e-9) * weight).mean())
    prob[:, y, np.arange(n)] -= 1
    dl = (prob * weight / (t * n)).astype(np.float32)
    grad: Params = {"d": dl.sum(axis=(0, 2))[:, None]}
    for s in "fb":
        k, hidden = runs[s], p[f"U{s}"].shape[1]
        grad[f"V{s}"] = np.einsum("tln,thn->lh", dl, k["out"])
        out = np.einsum("lh,tln->thn", p[f"V{s}"], dl)
        dx, du, dc = np.zeros_like(p[f"X{s}"]), np.zeros_like(p[f"U{s}"]), np.zeros_like(p[f"c{s}"])
        dh = np.zeros((hidden, n), dtype=np.float32)
        for i in reversed(k["order"]):
            dh = dh + out[i]
            h, r, z, c, gn = (k[q][i] for q in ("h", "r", "z", "n", "g"))
            dan = dh * (1 - z) * (1 - c * c)
            dar, daz, dgn = dan * gn * r * (1 - r), dh * (h - c) * z * (1 - z), dan * r
            np.add.at(dx.T, x[i], np.concatenate((dar, daz, dan)).T)
            dg = np.concatenate((dar, daz, dgn))
            du += dg @ h.T
            dc += dgn.sum(axis=1, keepdims=True)
            dh = dh * z + p[f"U{s}"].T @ dg
        grad |= {f"X{s}": dx, f"U{s}": du, f"c{s}": dc}
    return loss, grad


def train(x: np.ndarray, y: np.ndarray, labels: int, hidden: int, steps: int, batch: int = 192, rate: float = 0.02, seed: int = 3) -> Params:
    """Parameters for windows x (N x T bytes) with labels y, by Adam; classes count alike, whatever their sizes."""
    p = init(hidden, labels, seed)
    r = np.random.default_rng(seed)
    share = np.bincount(y, minlength=labels) / len(y)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        at = r.integers(0, len(x), min(batch, len(x)))
        weight = (1 / (labels * np.maximum(share[y[at]], 1e-6))).astype(np.float32)
        _, g = gradients(p, x[at].T, y[at], weight)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        lr = rate * min(1.0, step / 10) * (1 - 0.9 * step / steps)
        for k in p:
            d = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


class Labeller:
    """The network made ready for many windows: gate weights are halved once, so that a sigmoid is one tanh."""

    def __init__(self, p: Params):
        self.hidden, self.labels = p["Uf"].shape[1], len(p["d"])
        self.d = p["d"]
        self.sides = {}
        for s in "fb":
            half = np.ones((3 * self.hidden, 1), dtype=np.float32)
            half[: 2 * self.hidden] = 0.5
            self.sides[s] = (np.ascontiguousarray(p[f"X{s}"] * half), np.ascontiguousarray(p[f"U{s}"] * half), p[f"c{s}"], p[f"V{s}"])

    def sums(self, x: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """The label probabilities summed over the positions of each window: (labels, N) for x (T x N bytes).

        lengths: how many positions of each window count, all where it is None.
        """
        t, n = x.shape
        hidden, two = self.hidden, 2 * self.hidden
        a, g = np.empty((3 * hidden, n), dtype=np.float32), np.empty((3 * hidden, n), dtype=np.float32)
        logits = np.empty((t, self.labels, n), dtype=np.float32)
        total = np.zeros((self.labels, n), dtype=np.float32)
        for s in "fb":
            table, u, c, out = self.sides[s]
            h = np.zeros((hidden, n), dtype=np.float32)
            for i in range(t) if s == "f" else range(t - 1, -1, -1):
                np.take(table, x[i], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=g)
                gates, cand = a[:two], a[two:]
                gates += g[:two]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                rest = g[two:]
                rest += c
                rest *= gates[:hidden]
                cand += rest
                np.tanh(cand, out=cand)
                h -= cand
                h *= gates[hidden:]
                h += cand
                if s == "f":
                    np.matmul(out, h, out=logits[i])
                    continue
                if lengths is not None:
                    h *= lengths > i  # nothing is carried in from behind the end of a window
                one = out @ h
                one += logits[i]
                one += self.d
                one -= one.max(axis=0)
                np.exp(one, out=one)
                one /= one.sum(axis=0)
                if lengths is not None:
                    one *= lengths > i
                total += one
        return total
