"""A gated recurrent language model in numpy with a class-factored output.

Words 0..n-1 are the model's vocabulary in order of frequency; class k holds
words k*PER..k*PER+PER-1; one more class stands for every other word ("rare").
P(word) = P(class | state) * P(word | class, state).  Output biases start at
the unigram distribution, so training only moves away from it.
"""

from __future__ import annotations

import math

import numpy as np

HIDDEN, PER, SPAN = 16, 128, 16
_F = np.float32


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    if logits.max(initial=0) > 60:  # else exp can't overflow
        logits -= logits.max(1, keepdims=True)
    own = logits[np.arange(len(logits)), at].astype(np.float64)
    np.exp(logits, out=logits)
    return own - np.log(logits.sum(1))


def _slopes(logits: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``weight`` times the gradient of -ln softmax(logits)[at], in place."""
    if logits.max(initial=0) > 60:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (weight / logits.sum(1))[:, None]
    logits[np.arange(len(logits)), at] -= weight
    return logits


class Gru:
    NAMES = ("x", "u", "cw", "cb", "iw", "ib")

    def __init__(self, counts: np.ndarray, rare: float, seed: int = 5):
        """``counts`` of the vocabulary, most frequent first; ``rare``: of all other words."""
        self.n = len(counts)
        self.classes = -(-self.n // PER)
        rng = np.random.default_rng(seed)
        size = self.classes * PER
        c = np.zeros(size)
        c[: self.n] = counts + 0.5
        per = c.reshape(self.classes, PER)
        mass = np.r_[per.sum(1), rare + 0.5]
        with np.errstate(divide="ignore"):
            self.ib = np.maximum(np.log(per / np.maximum(per.sum(1, keepdims=True), 1e-9)), -40).astype(_F)
        self.cb = np.log(mass / mass.sum()).astype(_F)
        self.x = (rng.standard_normal((self.n + 2, 3 * HIDDEN)) * 0.1).astype(_F)  # words, rare, start
        self.x[:, :HIDDEN] += 1.0  # the update gate starts by keeping
        self.u = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(_F)
        self.cw = np.zeros((HIDDEN, self.classes + 1), _F)
        self.iw = np.zeros((self.classes, HIDDEN, PER), _F)

    @property
    def start(self) -> int:
        return self.n + 1

    def pack(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(_F))
            at += old.size

    def step(self, h: np.ndarray, words: np.ndarray):
        x, hu = self.x[words], h @ self.u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        return n + z * (h - n), z, r, n, hu[:, 2 * HIDDEN :]

    def tables(self) -> list[np.ndarray]:
        k = 2 * HIDDEN
        return [np.ascontiguousarray(t) for t in (self.x[:, :k], self.x[:, k:], self.u[:, :k], self.u[:, k:])]

    @staticmethod
    def advance(tables: list[np.ndarray], h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """``step`` without what only training needs, on contiguous tables and in place."""
        x_zr, x_n, u_zr, u_n = tables
        zr = h @ u_zr
        zr += np.take(x_zr, words, axis=0)
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        n = h @ u_n
        n *= zr[:, HIDDEN:]
        n += np.take(x_n, words, axis=0)
        np.tanh(n, out=n)
        h = h - n
        h *= zr[:, :HIDDEN]
        h += n
        return h

    def log_probs(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """ln P of each target (a word, or n for rare) given its state, in float64."""
        cls = np.minimum(targets // PER, self.classes) * (targets < self.n) + self.classes * (targets >= self.n)
        out = _log_softmax_at(h @ self.cw + self.cb, cls)
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.classes + 1))
        for k in range(self.classes):
            mine = order[edges[k] : edges[k + 1]]
            if len(mine):
                out[mine] += _log_softmax_at(np.take(h, mine, axis=0) @ self.iw[k] + self.ib[k], targets[mine] % PER)
        return out

    def score(self, docs: list[np.ndarray], chunk: int = 32768) -> np.ndarray:
        """ln-likelihood of whole documents (word ids ending with the end token).

        Documents advance together, longest first; each one's state runs through
        all its windows.  States are scored in bulk."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        total = np.zeros(len(docs))
        if not len(docs):
            return total
        sizes = np.array([len(docs[i]) for i in order])
        flat = np.concatenate([docs[i] for i in order])
        base = np.r_[0, np.cumsum(sizes)[:-1]]
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right") if len(sizes) else []
        h = np.zeros((len(docs), HIDDEN), _F)
        words = np.full(len(docs), self.start)
        held_h, held_t, held_d, held = [], [], [], 0
        tables = self.tables()
        for t, m in enumerate(active):
            h = self.advance(tables, h[:m], words[:m])
            words = np.take(flat, base[:m] + t)
            held_h.append(h)
            held_t.append(words)
            held_d.append(m)
            held += m
            if held >= chunk or t == len(active) - 1:
                got = self.log_probs(np.concatenate(held_h), np.concatenate(held_t))
                at = 0
                for m2 in held_d:
                    total[order[:m2]] += got[at : at + m2]
                    at += m2
                held_h, held_t, held_d, held = [], [], [], 0
        return total


class Trainer:
    """Truncated backpropagation through SPAN steps with Adam."""

    def __init__(self, model: Gru, rate: float = 0.008):
        self.model, self.full, self.rate, self.t = model, rate, rate, 0
        self.m = {k: np.zeros_like(getattr(model, k)) for k in Gru.NAMES}
        self.v = {k: np.zeros_like(getattr(model, k)) for k in Gru.NAMES}

    def window(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray) -> np.ndarray:
        """One window (steps x sequences); ``live`` marks real targets. Returns the carried state.

        Where the input is the start symbol a document begins: no state reaches that step, and no gradient leaves it."""
        g, steps, count = self.model, len(inputs), max(1, int(live.sum()))
        two, wide = 2 * HIDDEN, inputs.shape[1]
        x_zr, x_n, u_zr, u_n = g.tables()
        in_zr, in_n = np.take(x_zr, inputs, axis=0), np.take(x_n, inputs, axis=0)
        goes_on = (inputs != g.start).astype(_F)[:, :, None]
        before, states = np.empty((steps, wide, HIDDEN), _F), np.empty((steps, wide, HIDDEN), _F)
        kept = []
        for t in range(steps):  # as ``Gru.step``
            h = np.multiply(states[t - 1] if t else h, goes_on[t], out=before[t])
            zr = h @ u_zr
            zr += in_zr[t]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            hn = h @ u_n
            n = r * hn
            n += in_n[t]
            np.tanh(n, out=n)
            np.subtract(h, n, out=states[t])
            states[t] *= z
            states[t] += n
            kept.append((zr, n, hn))
        flat, goal, real = states.reshape(-1, HIDDEN), targets.ravel(), live.ravel()
        grad = {k: np.zeros_like(getattr(g, k)) for k in ("u", "cw", "cb", "iw", "ib", "x")}
        cls = np.where(goal < g.n, goal // PER, g.classes)
        p = _slopes(flat @ g.cw + g.cb, cls, (real / count).astype(_F))
        grad["cw"], grad["cb"] = flat.T @ p, p.sum(0)
        dh = p @ g.cw.T
        order = np.argsort(cls, kind="stable")
        order = order[real[order]]
        edges = np.searchsorted(cls[order], np.arange(g.classes + 1))
        for k in range(g.classes):
            mine = order[edges[k] : edges[k + 1]]
            if len(mine):
                own = np.take(flat, mine, axis=0)
                q = _slopes(own @ g.iw[k] + g.ib[k], goal[mine] % PER, np.full(len(mine), 1 / count, _F))
                grad["iw"][k], grad["ib"][k] = own.T @ q, q.sum(0)
                dh[mine] += q @ g.iw[k].T
        dh = dh.reshape(steps, -1, HIDDEN)
        dx, du = np.empty((steps, wide, 3 * HIDDEN), _F), np.empty((steps, wide, 3 * HIDDEN), _F)
        back, turned = _F(0), np.ascontiguousarray(g.u.T)
        for t in range(steps - 1, -1, -1):
            zr, n, hn = kept[t]
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            d = dh[t]
            d += back
            back = d * z
            dn = d - back
            dn *= 1 - n * n
            slope = zr * (1 - zr)
            d *= before[t] - n
            np.multiply(d, slope[:, :HIDDEN], out=dx[t, :, :HIDDEN])
            np.multiply(dn, hn, out=d)
            np.multiply(d, slope[:, HIDDEN:], out=dx[t, :, HIDDEN:two])
            dx[t, :, two:] = dn
            du[t, :, :two] = dx[t, :, :two]
            np.multiply(dn, r, out=du[t, :, two:])
            back += du[t] @ turned
            back *= goes_on[t]
        grad["u"] = before.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
        ids = inputs.ravel()
        by = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(ids[by]) != 0])
        grad["x"][ids[by][first]] = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[by], first, axis=0)
        self._move(grad)
        return states[-1]

    def _move(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(d, d)) for d in grad.values()))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        for k, d in grad.items():
            d *= _F(clip)
            m, v, a = self.m[k], self.v[k], getattr(self.model, k)
            m *= _F(0.9)
            m += _F(0.1) * d
            d *= d
            d *= _F(0.01)
            v *= _F(0.99)
            v += d
            np.sqrt(v, out=d)
            d *= _F(1 / math.sqrt(1 - 0.99**self.t))
            d += _F(1e-6)
            np.divide(m, d, out=d)
            d *= _F(self.rate / (1 - 0.9**self.t))
            a -= d

    def fit(self, docs: list[np.ndarray], lanes: int = 64) -> int:
        """One pass over documents, dealt to lanes; a lane's state starts anew with each document. Returns words seen."""
        g = self.model
        if not docs:
            return 0
        loads, lane_docs = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
        for d in sorted(docs, key=len, reverse=True):
            k = int(loads.argmin())
            lane_docs[k].append(d)
            loads[k] += len(d)
        by = np.argsort(-loads, kind="stable")  # lanes that end early are the last ones and drop out
        sizes = loads[by]
        laid = [d for k in by for d in lane_docs[k]]
        targets = np.concatenate(laid)
        first = np.zeros(len(targets), bool)
        first[np.r_[0, np.cumsum([len(d) for d in laid])[:-1]]] = True
        inputs = np.where(first, g.start, np.r_[g.start, targets[:-1]])
        base, most, steps = np.r_[0, np.cumsum(sizes)[:-1]], -(-int(sizes[0]) // SPAN) * SPAN, np.arange(SPAN)[:, None]
        h = np.zeros((lanes, HIDDEN), _F)
        for at in range(0, most, SPAN):
            m = int(np.searchsorted(-sizes, -at))
            live = at + steps < sizes[:m]
            spot = np.where(live, base[:m] + at + steps, 0)
            self.rate = self.full * (1 - at / most)
            h = self.window(h[:m], np.where(live, inputs[spot], g.start), np.where(live, targets[spot], g.n), live)
        return int(sum(len(d) for d in docs))
