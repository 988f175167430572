"""A log-bilinear language model in numpy: noise-contrastive training and normalised scores."""

from __future__ import annotations

import numpy as np

CONTEXT, DIM, BATCH, NOISE = 2, 24, 1024, 64


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices (below n) and the sums of their rows."""
    width = rows.shape[1]
    cells = (at * width)[:, None] + np.arange(width)
    sums = np.bincount(cells.ravel(), rows.ravel(), n * width).reshape(n, width)
    distinct = np.flatnonzero(np.bincount(at, minlength=n))
    return distinct, sums.take(distinct, 0).astype(np.float32)


def share(y: np.ndarray, whole: np.float32) -> np.ndarray:
    """whole * sigmoid(-y), in place of y."""
    np.exp(np.minimum(y, np.float32(80), out=y), out=y)
    y += np.float32(1)
    return np.divide(whole, y, out=y)


class Model:
    """P(w | context) is a softmax of (sum over j of T[w_j] C_j) . R[w] + b[w].

    T and R have a row for each symbol, T one more for the place before a text. R starts at zero and b at
    the log frequencies: before training the model is the frequencies alone.
    """

    def __init__(self, frequency: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = len(frequency)
        self.p = frequency / frequency.sum()
        self.w = {"T": rng.normal(0, 0.3, (n + 1, DIM)), "R": np.zeros((n, DIM)), "C": rng.normal(0, DIM**-0.5, (CONTEXT * DIM, DIM)), "b": np.log(self.p)[:, None]}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.seen = {k: np.full(len(v), 1e-6, np.float32) for k, v in self.w.items()}
        self.rng = np.random.default_rng(seed + 1)
        self.steps = np.cumsum(self.p)
        self.noise = np.log(NOISE * self.p).astype(np.float32)
        self.table: np.ndarray | None = None

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The CONTEXT symbols before each place, the nearest first; starts marks the first places of texts."""
        start = len(self.p)
        out = np.full((len(ids), CONTEXT), start, np.int64)
        since = np.arange(len(ids)) - np.maximum.accumulate(np.where(starts, np.arange(len(ids)), 0))
        for j in range(CONTEXT):
            ok = since > j
            out[ok, j] = ids[np.flatnonzero(ok) - 1 - j]
        return out

    def _move(self, name: str, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
        seen = self.seen[name].take(at) + np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
        self.seen[name][at] = seen
        w = self.w[name]
        w[at] = w.take(at, 0) - grad * (np.float32(rate) / np.sqrt(seen))[:, None]

    def train(self, ids: np.ndarray, starts: np.ndarray, rate: float = 0.05) -> None:
        """One pass of minibatches; NOISE symbols drawn by frequency serve a whole minibatch, so its scores are a matrix product."""
        before = self.contexts(ids, starts)
        order = self.rng.permutation(len(ids))
        w = self.w
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            c, t = before[at], ids[at]
            noise = np.minimum(np.searchsorted(self.steps, self.rng.random(NOISE)), len(self.p) - 1)
            x = w["T"].take(c, 0).reshape(len(at), CONTEXT * DIM)
            q = x @ w["C"]
            r, rn = w["R"].take(t, 0), w["R"].take(noise, 0)
            one = np.float32(1) / np.float32(len(at))
            g = share(np.einsum("ij,ij->i", q, r) + (w["b"].take(t) - self.noise.take(t)), -one)
            gn = q @ np.negative(rn).T
            gn += self.noise.take(noise) - w["b"].take(noise)
            share(gn, one)
            dq = gn @ rn
            dq += g[:, None] * r
            rows = np.empty((len(at) + NOISE, DIM + 1), np.float32)
            np.multiply(q, g[:, None], out=rows[: len(at), :DIM])
            rows[: len(at), DIM] = g
            rows[len(at) :, :DIM], rows[len(at) :, DIM] = gn.T @ q, gn.sum(0)
            both, grad = summed(np.concatenate((t, noise)), rows, len(self.p))
            dx = dq @ w["C"].T
            self._move("C", np.arange(CONTEXT * DIM), x.T @ dq, rate)
            self._move("R", both, grad[:, :DIM], rate)
            self._move("b", both, grad[:, DIM:], rate * 0.2)
            self._move("T", *summed(c.ravel(), dx.reshape(-1, DIM), len(w["T"])), rate)

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The normalised log10 probability of each symbol; normalisers are kept per context, as contexts recur."""
        n = len(self.p)
        if self.table is None:
            self.table = np.full((n + 1) ** CONTEXT, np.nan, np.float32)
            self.part = [self.w["T"] @ self.w["C"][j * DIM : (j + 1) * DIM] for j in range(CONTEXT)]
        before = self.contexts(ids, starts)
        key = before[:, 0]
        for j in range(1, CONTEXT):
            key = key * (n + 1) + before[:, j]
        fresh = np.unique(key[np.isnan(self.table[key])])
        out_of, own = np.ascontiguousarray(self.w["R"].T), self.w["b"][:, 0]
        for i in range(0, len(fresh), 128):  # scores of so many contexts stay in a core's cache
            k = fresh[i : i + 128]
            q, rest = 0, k
            for j in reversed(range(CONTEXT)):
                q = q + self.part[j][rest % (n + 1)]
                rest = rest // (n + 1)
            s = q @ out_of
            s += own
            m = s.max(1)
            s -= m[:, None]
            self.table[k] = m + np.log(np.exp(s, out=s).sum(1))
        out = np.empty(len(ids))
        for i in range(0, len(ids), 65536):
            c, t = before[i : i + 65536], ids[i : i + 65536]
            q = sum(self.part[j][c[:, j]] for j in range(CONTEXT))
            out[i : i + 65536] = (q * self.w["R"][t]).sum(1) + self.w["b"][t, 0] - self.table[key[i : i + 65536]]
        return out / np.log(10)
