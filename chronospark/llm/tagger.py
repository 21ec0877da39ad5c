"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding of fixed windows."""

from __future__ import annotations

import numpy as np

#: Characters by class: printable ASCII each for itself, other letters, other digits, white space, the rest, padding.
CLASSES = 96 + 5
#: Kinds of characters: marks, digits, capitals, small letters, letters beyond ASCII, white space, the rest.
KIND = np.array([1 if 16 <= c <= 25 else 2 if 33 <= c <= 58 else 3 if 65 <= c <= 90 else 0 if c < 95 else {95: 4, 96: 4, 97: 5}.get(c, 6) for c in range(CLASSES)])


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    out = np.where((codes > 32) & (codes < 127), codes - 32, 98)
    out[(codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 160)] = 97
    out[(codes >= 192) & (codes < 0x2000)] = 95
    out[codes > 0x2FFF] = 96
    return out


def _act(z: np.ndarray, h: int) -> tuple[np.ndarray, ...]:
    z[:, : 3 * h] *= 0.5
    np.tanh(z, out=z)
    s = z[:, : 3 * h]
    s += 1
    s *= 0.5
    return s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], z[:, 3 * h :]


class Tagger:
    """Weights by name in ``p``: for each direction the input table E by character and K by its kind, the recurrence U; emissions W, b; transitions A, first a."""

    def __init__(self, tags: int, hidden: int = 16, seed: int = 5):
        r, h = np.random.default_rng(seed), hidden
        self.h, self.k = hidden, tags
        self.p = {"W": r.normal(0, 0.2, (2 * h, tags)), "b": np.zeros(tags), "A": r.normal(0, 0.1, (tags, tags)), "a": np.zeros(tags)}
        for d in "fb":
            bias = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
            self.p |= {f"E{d}": r.normal(0, 0.1, (CLASSES, 4 * h)) + bias, f"K{d}": r.normal(0, 0.3, (7, 4 * h)), f"U{d}": r.normal(0, 1 / np.sqrt(h), (h, 4 * h))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, ids: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, t = ids.shape
        table, u = self.p[f"E{d}"] + self.p[f"K{d}"][KIND], self.p[f"U{d}"]
        h = c = np.zeros((n, self.h), dtype=np.float32)
        out, kept = np.empty((t, n, self.h), dtype=np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            gates = _act(table[ids[:, i]] + h @ u, self.h)
            before, prior = h, c
            c = gates[1] * c + gates[0] * gates[3]
            tc = np.tanh(c)
            h = gates[2] * tc
            out[i] = h
            if keep:
                kept.append((i, gates, before, prior, tc))
        return out, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(ids, "f", False)[0], self._run(ids, "b", False)[0]], axis=2)
        return both @ self.p["W"] + self.p["b"]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags and its gradient by every weight."""
        p, (n, t), k = self.p, ids.shape, self.k
        (hf, kf), (hb, kb) = self._run(ids, "f", True), self._run(ids, "b", True)
        both = np.concatenate([hf, hb], axis=2)
        emit = both @ p["W"] + p["b"]
        alpha, post, step, gold = self._posteriors(emit)
        rows, times = np.arange(n)[None, :], np.arange(t)[:, None]
        path = tags.T
        loss = gold - p["a"][path[0]] - emit[times, rows, path].sum(0) - p["A"][path[:-1], path[1:]].sum(0)
        d_emit = post.copy()
        d_emit[times, rows, path] -= 1
        d_emit /= n
        pairs = np.bincount((path[:-1] * k + path[1:]).ravel(), minlength=k * k).reshape(k, k)
        d_a = np.einsum("tnj,tnk->jk", alpha[:-1], step) * np.exp(p["A"] - p["A"].max()) - pairs
        g = {"A": d_a / n, "a": d_emit[0].sum(0), "W": np.einsum("tnh,tnk->hk", both, d_emit, optimize=True), "b": d_emit.sum((0, 1))}
        d_both = d_emit @ p["W"].T
        letters = np.zeros((t * n, CLASSES), dtype=both.dtype)
        letters[np.arange(t * n), ids.T.ravel()] = 1
        for d, kept, part in (("f", kf, d_both[:, :, : self.h]), ("b", kb, d_both[:, :, self.h :])):
            u = p[f"U{d}"]
            dz, prior_h = np.empty((t, n, 4 * self.h), dtype=both.dtype), np.empty((t, n, self.h), dtype=both.dtype)
            dh = dc = np.zeros((n, self.h), dtype=both.dtype)
            for i, (ig, fg, og, cg), before, prior, tc in reversed(kept):
                dh = dh + part[i]
                dc = dc + dh * og * (1 - tc * tc)
                dz[i] = np.concatenate([dc * cg * ig * (1 - ig), dc * prior * fg * (1 - fg), dh * tc * og * (1 - og), dc * ig * (1 - cg * cg)], axis=1)
                prior_h[i] = before
                dh, dc = dz[i] @ u.T, dc * fg
            flat = dz.reshape(t * n, -1)
            by_letter = letters.T @ flat
            g |= {f"E{d}": by_letter, f"K{d}": np.eye(7, dtype=both.dtype)[KIND].T @ by_letter, f"U{d}": prior_h.reshape(t * n, -1).T @ flat}
        return float(loss.mean()), g

    def _posteriors(self, emit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of emissions (time, window, tag): scaled forward values, posteriors, what follows each step, log of the sum over all paths."""
        top = emit.max(axis=2, keepdims=True)
        e, move, t = np.exp(emit - top), np.exp(self.p["A"] - self.p["A"].max()), len(emit)
        alpha, scale = np.empty_like(e), np.empty(emit.shape[:2], dtype=emit.dtype)
        first = self.p["a"] - self.p["a"].max()
        for i in range(t):
            a = np.exp(first) * e[0] if i == 0 else (alpha[i - 1] @ move) * e[i]
            scale[i] = a.sum(axis=1)
            alpha[i] = a / scale[i][:, None]
        beta, step, post = np.ones_like(e[0]), np.empty_like(e[1:]), np.empty_like(e)
        for i in range(t - 1, -1, -1):
            post[i] = alpha[i] * beta
            if i:
                step[i - 1] = e[i] * beta / scale[i][:, None]
                beta = step[i - 1] @ move.T
        whole = np.log(scale).sum(0) + top.sum((0, 2)) + (t - 1) * self.p["A"].max() + self.p["a"].max()
        return alpha, post, step, whole

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 96, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        r, step, losses = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            seen = []
            for part in np.array_split(r.permutation(len(ids)), max(1, len(ids) // batch)):
                loss, g = self.gradients(ids[part], tags[part])
                step += 1
                scale = min(1.0, 5 / (1e-9 + np.sqrt(sum(float((x * x).sum()) for x in g.values()))))
                for k, x in g.items():
                    x = x * scale
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.01 * (x * x - v[k])
                    self.p[k] -= (rate * (0.03 ** (epoch / epochs)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (Viterbi)."""
        emit = self.emissions(ids)
        best, back = self.p["a"] + emit[0], []
        for i in range(1, ids.shape[1]):
            step = best[:, :, None] + self.p["A"]
            back.append(step.argmax(axis=1))
            best = step.max(axis=1) + emit[i]
        out = np.empty(ids.shape, dtype=np.int64)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(ids))
        for i in range(ids.shape[1] - 2, -1, -1):
            out[:, i] = back[i][rows, out[:, i + 1]]
        return out

    def confidence(self, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The probability of each given tag, over all tag sequences of its window."""
        post = self._posteriors(self.emissions(ids))[1]
        return np.take_along_axis(post, tags.T[:, :, None], axis=2)[:, :, 0].T
