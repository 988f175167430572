"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, marginals, decoding."""

from __future__ import annotations

import numpy as np

#: Characters: pad, other letter, other mark, line break, then space to tilde.
N_CHARS = 4 + 95
KINDS = ("email", "ip", "card", "phone")
N_TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def encoded(text: str, width: int) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    plain = (codes >= 32) & (codes < 127)
    odd = np.array([1 if c.isalnum() else 3 if c == "\n" else 2 for c in text], np.int64)
    out = np.zeros(width, np.int64)
    out[: len(codes)] = np.where(plain, codes - 32 + 4, odd)
    return out


def tags_of(spans, width: int) -> np.ndarray:
    """spans: (kind number, start, end)."""
    out = np.zeros(width, np.int64)
    for kind, start, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def allowed() -> np.ndarray:
    """Added to the transitions: I of a kind follows B or I of that kind only."""
    bad = np.zeros((N_TAGS, N_TAGS))
    for to in range(2, N_TAGS, 2):
        bad[:, to] = -1e4
        bad[[to - 1, to], to] = 0
    return bad


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, embed: int = 12, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden = hidden
        self.w = {"E": rng.normal(0, 0.3, (N_CHARS, embed)).astype(f), "O": rng.normal(0, 0.1, (2 * hidden, N_TAGS)).astype(f), "ob": np.zeros(N_TAGS, f), "T": np.zeros((N_TAGS, N_TAGS), f), "S": np.zeros(N_TAGS, f)}
        for d in "fb":
            self.w["X" + d] = rng.normal(0, embed**-0.5, (embed, 4 * hidden)).astype(f)
            self.w["H" + d] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(f)
            self.w["B" + d] = np.zeros(4 * hidden, f)
            self.w["B" + d][hidden : 2 * hidden] = 1

    def _one_way(self, x, d):
        """x: T, B, embed in reading order. Hidden states and what the backward pass needs."""
        n = self.hidden
        pre = x @ self.w["X" + d] + self.w["B" + d]
        h = c = np.zeros((x.shape[1], n), np.float32)
        kept = []
        for z in pre:
            z = z + h @ self.w["H" + d]
            s = _sigmoid(z[:, : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            before, h0 = c, h
            c = s[:, n : 2 * n] * c + s[:, :n] * g
            t = np.tanh(c)
            h = s[:, 2 * n :] * t
            kept.append((s, g, before, t, h0, h))
        return np.stack([k[5] for k in kept]), kept

    def _back(self, x, d, kept, dh_all, grad):
        n = self.hidden
        dz_all = np.empty((len(kept), x.shape[1], 4 * n), np.float32)
        dh = dc = 0
        for t in range(len(kept) - 1, -1, -1):
            s, g, before, tanh_c, h0, _ = kept[t]
            dh = dh_all[t] + dh
            dc = dc + dh * s[:, 2 * n :] * (1 - tanh_c**2)
            ds = np.concatenate([dc * g, dc * before, dh * tanh_c], 1) * s * (1 - s)
            dz = dz_all[t]
            dz[:, : 3 * n], dz[:, 3 * n :] = ds, dc * s[:, :n] * (1 - g**2)
            dc = dc * s[:, n : 2 * n]
            dh = dz @ self.w["H" + d].T
            grad["H" + d] += h0.T @ dz
        grad["X" + d] += x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * n)
        grad["B" + d] += dz_all.sum((0, 1))
        return dz_all @ self.w["X" + d].T

    def emissions(self, chars: np.ndarray):
        x = self.w["E"][chars.T]
        hf, kf = self._one_way(x, "f")
        hb, kb = self._one_way(x[::-1], "b")
        h = np.concatenate([hf, hb[::-1]], 2)
        return h @ self.w["O"] + self.w["ob"], (x, h, kf, kb)

    def forward_backward(self, e):
        """log Z by row; tag marginals T, B, K; pair marginals summed over all."""
        tr = self.w["T"] + allowed()
        start = self.w["S"] + allowed()[0]
        a, b = np.empty(e.shape), np.zeros(e.shape)
        a[0] = start + e[0]
        for t in range(1, len(e)):
            a[t] = _lse(a[t - 1][:, :, None] + tr, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            b[t] = _lse(tr + (e[t + 1] + b[t + 1])[:, None, :], 2)
        z = _lse(a[-1], 1)
        pairs = np.zeros(tr.shape)
        for t in range(1, len(e)):
            pairs += np.exp(a[t - 1][:, :, None] + tr + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
        return z, np.exp(a + b - z[None, :, None]), pairs

    def step(self, chars, tags, adam, rate):
        e, (x, h, kf, kb) = self.emissions(chars)
        z, marginal, pairs = self.forward_backward(e)
        size, t = tags.size, tags.T
        gold = np.eye(N_TAGS)[t]
        de = ((marginal - gold) / size).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        seen = np.zeros_like(pairs)
        np.add.at(seen, (t[:-1].ravel(), t[1:].ravel()), 1)
        grad["T"] += ((pairs - seen) / size).astype(np.float32)
        grad["S"] += ((marginal[0] - gold[0]).sum(0) / size).astype(np.float32)
        grad["O"] += h.reshape(-1, h.shape[2]).T @ de.reshape(-1, N_TAGS)
        grad["ob"] += de.sum((0, 1))
        dh = de @ self.w["O"].T
        dx = self._back(x, "f", kf, dh[:, :, : self.hidden], grad)
        dx = dx + self._back(x[::-1], "b", kb, dh[::-1, :, self.hidden :], grad)[::-1]
        np.add.at(grad["E"], chars.T.ravel(), dx.reshape(-1, dx.shape[2]))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        adam["n"] = adam.get("n", 0) + 1
        for k, g in grad.items():
            g = g * min(1, 1 / (norm + 1e-9))
            m, v = adam.setdefault(k, [np.zeros_like(g), np.zeros_like(g)])
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            self.w[k] = (self.w[k] - rate * (m / (1 - 0.9 ** adam["n"])) / (np.sqrt(v / (1 - 0.99 ** adam["n"])) + 1e-8)).astype(np.float32)

    def fit(self, chars, tags, steps: int = 220, batch: int = 64, rate: float = 0.02, seed: int = 3):
        rng, adam = np.random.default_rng(seed), {}
        for k in range(steps):
            at = rng.integers(0, len(chars), batch)
            self.step(chars[at], tags[at], adam, rate * (1 - 0.9 * k / steps))
        return self

    def decode(self, chars, batch: int = 256):
        """For each row its best spans: (kind number, start, end, the least marginal of its tags)."""
        tr, start = self.w["T"] + allowed(), self.w["S"] + allowed()[0]
        for i in range(0, len(chars), batch):
            e, _ = self.emissions(chars[i : i + batch])
            _, marginal, _ = self.forward_backward(e)
            score, back = start + e[0], []
            for t in range(1, len(e)):
                all_ = score[:, :, None] + tr
                back.append(all_.argmax(1))
                score = all_.max(1) + e[t]
            best = [score.argmax(1)]
            for b in reversed(back):
                best.append(b[np.arange(len(best[-1])), best[-1]])
            path = np.stack(best[::-1])
            for r in range(path.shape[1]):
                spans, tags = [], path[:, r]
                for t in np.flatnonzero(tags % 2 == 1):
                    end = t + 1
                    while end < len(tags) and tags[end] == tags[t] + 1:
                        end += 1
                    spans.append((int(tags[t]) // 2, int(t), int(end), float(marginal[np.arange(t, end), r, tags[t:end]].min())))
                yield spans
