"""A gated recurrent language model in numpy, with a class-factored output softmax.

Symbols are the most frequent words and, for all other words, classes of word shapes.  The
first output softmax is over classes of frequent words and the shape classes, the second
over the words of a class; both start as the unigram distribution.  Gates are hard
sigmoids (piecewise linear), the candidate state is a tanh.

Documents run in parallel streams, window by window: training back-propagates through a
window only (truncated), while the state is carried from window to window in training and
scoring, through documents of any length, and is reset where a document starts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Rows of a softmax worked on at once: they stay in the processor's cache.
_ROWS = 1024
#: Rows of a product summed over them: up to a million multiplications are small for BLAS.
_FEW = 256
#: Logits known to be within this need no shift before exp.
_SAFE = 60.0
#: They are bounded again once training may have moved one by this; exp of both together is far from an overflow.
_DRIFT = 10.0
#: Adam moves a weight by at most this many rates, by Cauchy and Schwarz: 0.1 / sqrt(0.001 * (1 - 0.81 / 0.999)).
_ADAM_STEP = 7.3


@dataclass(frozen=True)
class Shape:
    words: int
    shapes: int
    classes: int
    hidden: int = 32
    embedding: int = 24


@dataclass
class Gru:
    shape: Shape
    #: Class of each frequent word (sorted by frequency, so classes are runs), and their bounds.
    class_of: np.ndarray
    bounds: np.ndarray
    p: dict[str, np.ndarray]
    #: What ``_shifted`` would say, while training knows it.
    shift: bool | None = None

    @classmethod
    def start(cls, counts: np.ndarray, shape: Shape, seed: int = 7) -> Gru:
        """``counts``: of the frequent words, most frequent first, then of the shape classes."""
        rng = np.random.default_rng(seed)
        k = shape.words
        root = np.sqrt(np.maximum(counts[:k], 0.5))
        class_of = np.minimum((np.cumsum(root) - root / 2) / root.sum() * shape.classes, shape.classes - 1).astype(np.int64)
        class_of = np.unique(class_of, return_inverse=True)[1]  # no empty class
        n = int(class_of[-1]) + 1 if k else 0
        bounds = np.searchsorted(class_of, np.arange(n + 1))
        mass = np.maximum(counts, 0.5).astype(np.float64)
        by_class = np.add.reduceat(mass[:k], bounds[:-1]) if k else np.zeros(0)
        top = np.concatenate([by_class, mass[k:]])
        h, d, f = shape.hidden, shape.embedding, np.float32
        gates = np.repeat([0.25, 0.25, 1.0], h)  # a hard sigmoid rises by a quarter around 0
        p = {
            "E": rng.normal(0, 0.3, (k + shape.shapes, d)), "Wx": rng.normal(0, d**-0.5, (d, 3 * h)) * gates, "U": rng.normal(0, 0.7 * h**-0.5, (h, 3 * h)) * gates,
            "b": np.repeat([0.5, 0.5, 0.0], h), "bn": np.zeros(h),
            # with their biases: those of the last state, which is 1
            "Wc": np.vstack([rng.normal(0, 0.02, (h, len(top))), np.log(top / top.sum())]),
            "Ww": np.column_stack([rng.normal(0, 0.02, (k, h)), np.log(mass[:k] / by_class[class_of]) if k else np.zeros(0)]),
        }
        return cls(shape, class_of, bounds, {a: x.astype(f) for a, x in p.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def with_flat(self, flat: np.ndarray) -> Gru:
        """The same network with these weights; they are views of ``flat`` if it is of 32-bit floats."""
        out, at = {}, 0
        for a, x in self.p.items():
            out[a] = flat[at : at + x.size].reshape(x.shape).astype(np.float32, copy=False)
            at += x.size
        return Gru(self.shape, self.class_of, self.bounds, out)

    # one window -----------------------------------------------------------------------

    def _recur(self, x: tuple[np.ndarray, np.ndarray], fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """States, and a 1, after each step; the state is zero where ``fresh``.

        ``x``: [step, stream] inputs of the gates (2 * hidden) and of the candidate (hidden).
        """
        gates_in, candidate_in = x
        n, (steps, streams) = self.shape.hidden, fresh.shape
        out = np.empty((steps, streams, n + 1), h.dtype)
        out[:, :, n] = 1
        # states before the steps and after the last, gates, candidate, its part of the state
        tape = [np.empty((k, streams, w), h.dtype) for k, w in ((steps + 1 if keep else 2, n), (steps if keep else 1, 2 * n), (steps if keep else 1, n), (steps if keep else 1, n))]
        states, gates, candidates, parts = tape
        to_gates, to_part = np.ascontiguousarray(self.p["U"][:, : 2 * n]), np.ascontiguousarray(self.p["U"][:, 2 * n :])
        # as whole arrays: numpy has vector code for these, not for a number or a row
        none, full = np.zeros((streams, 2 * n), h.dtype), np.ones((streams, 2 * n), h.dtype)
        bn = np.repeat(self.p["bn"][None], streams, 0)
        some = fresh.any(1)
        states[0] = h
        for t in range(steps):
            before, h = (states[t], states[t + 1]) if keep else (states[t & 1], states[~t & 1])
            g, c, hn = (gates[t], candidates[t], parts[t]) if keep else (gates[0], candidates[0], parts[0])
            if some[t]:
                before[fresh[t]] = 0
            np.matmul(before, to_gates, out=g)
            np.matmul(before, to_part, out=hn)
            g += gates_in[t]
            np.maximum(g, none, out=g)
            np.minimum(g, full, out=g)
            hn += bn
            np.multiply(g[:, :n], hn, out=c)
            c += candidate_in[t]
            np.tanh(c, out=c)
            np.subtract(before, c, out=h)
            h *= g[:, n:]
            h += c
            out[t, :, :n] = h
        return out, (states[:steps], gates, candidates, parts)

    def _inputs(self, symbols: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the gates and of the candidate by symbol."""
        own = self.p["E"][symbols] @ self.p["Wx"]
        own += self.p["b"]
        k = 2 * self.shape.hidden
        return np.ascontiguousarray(own[:, :k]), np.ascontiguousarray(own[:, k:])

    def _targets(self, y: np.ndarray) -> np.ndarray:
        """The top softmax's outcome of each symbol."""
        k = self.shape.words
        n = len(self.bounds) - 1
        at = np.concatenate([self.class_of, n + np.arange(self.shape.shapes)])
        return at[y] if k else y

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int, int, int]]]:
        """Logits within classes lie in one buffer, class by class and row by row.

        (positions of the frequent words in ``y`` in that order, where each one's logits begin, and end, its
        own logit's place, and (rows' start, end, words' start, end, logits' start, end) of each class).
        """
        at = np.flatnonzero(y < self.shape.words)
        own = self.class_of[y[at]]
        order = _order(own, len(self.bounds))
        at, own = at[order], own[order]
        size = np.diff(self.bounds)[own]
        end = np.cumsum(size)
        begin = end - size
        edge = np.searchsorted(own, np.arange(len(self.bounds)))
        some = np.flatnonzero(np.diff(edge))
        stops = np.append(begin, end[-1] if len(end) else 0)
        runs = np.column_stack([edge[some], edge[some + 1], self.bounds[some], self.bounds[some + 1], stops[edge[some]], stops[edge[some + 1]]]).tolist()
        return at, begin, begin + y[at] - self.bounds[own], runs

    def _within(self, own: np.ndarray, runs: list) -> np.ndarray:
        """The buffer of logits within classes of rows ``own``."""
        out, w = np.empty(runs[-1][5] if runs else 0, own.dtype), self.p["Ww"]
        for s, e, a, b, i, j in runs:
            np.dot(own[s:e], w[a:b].T, out=out[i:j].reshape(e - s, b - a))
        return out

    def _shifted(self) -> bool:
        """Whether logits may be too large for exp: states are within -1 and 1, which bounds them."""
        n = self.shape.hidden
        for w in (self.p["Wc"].T, self.p["Ww"]):
            # by Cauchy and Schwarz, which takes a pass; sums of weights are nearer but take two
            if len(w) and not float((np.sqrt(n * np.einsum("ij,ij->i", w[:, :n], w[:, :n])) + np.abs(w[:, n])).max()) < _SAFE and not float(np.abs(w).sum(1).max()) < _SAFE:
                return True
        return False

    def log_probabilities(self, hs: np.ndarray, y: np.ndarray, shift: bool | None = None) -> np.ndarray:
        """Of symbols ``y`` after states ``hs``, whose last column is 1."""
        shift = self._shifted() if shift is None else shift
        target = self._targets(y)
        out = np.empty(len(y))
        for s in range(0, len(y), _ROWS):
            logits = hs[s : s + _ROWS] @ self.p["Wc"]
            if shift:
                logits -= logits.max(1, keepdims=True)
            got = logits[np.arange(len(logits)), target[s : s + _ROWS]].astype(np.float64)
            np.exp(logits, out=logits)
            out[s : s + _ROWS] = got - np.log(logits @ np.ones(logits.shape[1], logits.dtype))
        at, begin, place, runs = self._by_class(y)
        if len(at):
            logits = self._within(hs[at], runs)
            if shift:
                logits -= np.repeat(np.maximum.reduceat(logits, begin), np.diff(begin, append=len(logits)))
            got = logits[place].astype(np.float64)
            np.exp(logits, out=logits)
            out[at] += got - np.log(np.add.reduceat(logits, begin))
        return out

    # documents ------------------------------------------------------------------------

    def score(self, docs: list[np.ndarray], streams: int = 256, window: int = 32) -> np.ndarray:
        """Natural log-probability of each whole document (its symbols, the end last)."""
        total = np.zeros(len(docs))
        table, shift = self._inputs(slice(None)), self._shifted()
        for x, y, fresh, owner in _blocks(docs, streams):
            h = np.zeros((x.shape[1], self.shape.hidden), np.float32)
            for s in range(0, len(x), window):
                cut = slice(s, s + window)
                hs, _ = self._recur(tuple(np.take(own, x[cut], 0) for own in table), fresh[cut], h, False)
                h = hs[-1, :, :-1]
                own = owner[cut].ravel()
                real = np.flatnonzero(own >= 0)
                hs = hs.reshape(-1, hs.shape[2])
                got = self.log_probabilities(hs if len(real) == len(own) else hs[real], y[cut].ravel()[real], shift)
                total += np.bincount(own[real], got, len(docs))
                live = owner[s + window] >= 0 if s + window < len(x) else None
                if live is not None and live.mean() < 0.7:  # drop streams that have ended
                    x, y, fresh, owner, h = x[:, live], y[:, live], fresh[:, live], owner[:, live], h[live]
        return total

    def train(self, docs: Iterator[np.ndarray] | list[np.ndarray], symbols: int | None = None, streams: int = 128, window: int = 24, rate: float = 5e-3) -> tuple[Gru, int]:
        """(network, symbols seen) after a pass of truncated back-propagation over the documents.

        Documents are taken as they come, each by the first stream that is free, so memory
        is that of a window, and the state is carried through a document of any length.
        Adam; its rate falls to a tenth over about ``symbols`` symbols.
        """
        if symbols is None:
            docs = list(docs)
            symbols = sum(map(len, docs))
        flat = self.flat()
        me = self.with_flat(flat)
        grads = self.with_flat(np.zeros_like(flat))
        grad = np.concatenate([x.ravel() for x in grads.p.values()])
        grads = self.with_flat(grad).p
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        streams = max(1, min(streams, symbols // (32 * window)))
        seen = step = 0
        drift = np.inf
        h = np.zeros((streams, self.shape.hidden), np.float32)
        for x, y, fresh, real, live in windows(docs, streams, window):
            if live is not None:
                h = h[live]
            if not drift < _DRIFT:
                me.shift, drift = me._shifted(), 0.0
            h = me._gradients(x, y, fresh, real, h, grads)
            seen += int(real.sum())
            step += 1
            norm = float(np.sqrt(np.dot(grad, grad)))
            now = rate * (1 - 0.9 * min(1.0, seen / max(1, symbols))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            _adam(flat, grad, m, v, min(1.0, 1.0 / max(norm, 1e-9)), now)
            drift += _ADAM_STEP * now * (self.shape.hidden + 1)
        me.shift = None
        return me, seen

    def _gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
        """Gradients of the mean loss of a window into ``g``; returns the last states."""
        p, n = self.p, self.shape.hidden
        kind = p["U"].dtype
        # inputs are computed once for each symbol of the window
        ids = x.ravel()
        order = _order(ids, len(p["E"]))
        ordered, new = ids[order], np.ones(len(ids), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        first = np.flatnonzero(new)
        symbols = ordered[first]
        number = np.empty(len(p["E"]), np.int64)
        number[symbols] = np.arange(len(symbols))
        number = number[ids]
        table = self._inputs(symbols)
        hs, (before, gates, c, hn) = self._recur(tuple(np.take(own, number, 0).reshape(*x.shape, -1) for own in table), fresh, h, True)
        flat = hs.reshape(-1, n + 1)
        whole = bool(real.all())
        at = None if whole else np.flatnonzero(real.ravel())
        out, t = (flat, y.ravel()) if whole else (flat[at], y.ravel()[at])
        w = kind.type(1 / max(1, len(t)))
        d_out = self._output_gradients(out, t, w, g)
        if whole:
            d_hs = d_out
        else:
            d_hs = np.zeros((len(flat), n), kind)
            d_hs[at] = d_out
        d_hs = d_hs.reshape(*x.shape, n)
        r, z = gates[:, :, :n], gates[:, :, n:]
        inside = ((gates > 0) & (gates < 1)).astype(kind)
        to_z = before - c
        to_z *= inside[:, :, n:]
        to_r = hn
        to_r *= inside[:, :, :n]
        to_c = np.multiply(c, c, out=c)
        np.subtract(1, to_c, out=to_c)
        to_c *= 1 - z
        d_a, d_c = np.empty((*x.shape, 3 * n), kind), np.empty((*x.shape, n), kind)
        dh, across = np.zeros_like(h), np.ascontiguousarray(p["U"].T)
        back, some = np.empty_like(h), fresh.any(1)
        for i in range(len(x) - 1, -1, -1):
            dh += d_hs[i]
            dc, own = d_c[i], d_a[i]
            np.multiply(dh, to_c[i], out=dc)
            np.multiply(dc, to_r[i], out=own[:, :n])
            np.multiply(dh, to_z[i], out=own[:, n : 2 * n])
            np.multiply(dc, r[i], out=own[:, 2 * n :])
            dh *= z[i]
            np.matmul(own, across, out=back)
            dh += back
            if some[i]:
                dh[fresh[i]] = 0
        d_a = d_a.reshape(-1, 3 * n)
        _products(before.reshape(-1, n), d_a, g["U"])
        ones = np.ones(len(d_a), kind)
        g["b"][:] = ones @ d_a
        g["bn"][:] = g["b"][2 * n :]
        d_a[:, 2 * n :] = d_c.reshape(-1, n)  # of the inputs; the reset gate acts on the state's part alone
        g["b"][2 * n :] = ones @ d_a[:, 2 * n :]
        _products(np.take(p["E"], ids, 0), d_a, g["Wx"])
        g["E"][:] = 0
        g["E"][symbols] = np.add.reduceat(np.take(d_a @ p["Wx"].T, order, 0), first)
        return hs[-1, :, :n].copy()

    def _output_gradients(self, out: np.ndarray, t: np.ndarray, w: float, g: dict[str, np.ndarray]) -> np.ndarray:
        p, n, shift = self.p, self.shape.hidden, self._shifted() if self.shift is None else self.shift
        d_out = np.empty((len(out), n), out.dtype)
        g["Ww"][:] = 0
        target, to_states = self._targets(t), p["Wc"][:n].T.copy()
        for s in range(0, len(t), _ROWS):
            own = out[s : s + _ROWS]
            top = own @ p["Wc"]
            if shift:
                top -= top.max(1, keepdims=True)
            np.exp(top, out=top)
            top *= (w / (top @ np.ones(top.shape[1], top.dtype)))[:, None]
            top[np.arange(len(own)), target[s : s + _ROWS]] -= w
            _products(own, top, g["Wc"], s > 0)
            np.matmul(top, to_states, out=d_out[s : s + _ROWS])
        at, begin, place, runs = self._by_class(t)
        if len(at):
            own = out[at]
            back = np.empty_like(own)
            x = self._within(own, runs)
            size = np.diff(begin, append=len(x))
            if shift:
                x -= np.repeat(np.maximum.reduceat(x, begin), size)
            np.exp(x, out=x)
            x *= np.repeat(w / np.add.reduceat(x, begin), size)
            x[place] -= w
            weights, grad = p["Ww"], g["Ww"]
            for s, e, a, b, i, j in runs:
                own_x = x[i:j].reshape(e - s, b - a)
                np.dot(own_x.T, own[s:e], out=grad[a:b])
                np.dot(own_x, weights[a:b], out=back[s:e])
            d_out[at] += back[:, :n]
        return d_out


def _order(numbers: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers below ``most``; those of 16 bits are sorted by radix."""
    return np.argsort(numbers.astype(np.uint16) if most <= 1 << 16 else numbers, kind="stable")


def _products(a: np.ndarray, b: np.ndarray, out: np.ndarray, add: bool = False) -> None:
    """``a.T @ b`` into ``out``, or added to it, by rows so few that BLAS takes its code for small matrices, twice as fast."""
    if not add:
        out[:] = 0
    for s in range(0, len(a), _FEW):
        out += a[s : s + _FEW].T @ b[s : s + _FEW]


def _adam(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, scale: float, rate: float, size: int = 1 << 15) -> None:
    """A step of Adam in place, some weights at a time; ``g`` is overwritten.

    ``m`` and ``v`` are sums, not means: 10 and 1000 times the usual moments, which saves two passes.
    """
    f = np.float32
    for s in range(0, len(p), size):
        own = slice(s, s + size)
        x, a, b = g[own], m[own], v[own]
        if scale != 1:
            x *= f(scale)
        a *= f(0.9)
        a += x
        np.multiply(x, x, out=x)
        b *= f(0.999)
        b += x
        np.sqrt(b, out=x)
        x += f(1e-7 * 1000**0.5)
        np.divide(a, x, out=x)
        x *= f(rate * 0.1 * 1000**0.5)
        p[own] -= x


def windows(docs, streams: int, window: int, ahead: int = 8):
    """([step, stream] inputs, targets, document starts, which are real, streams kept or None), window by window.

    A document's inputs are the end symbol (0) and all symbols but its last.  Each stream
    takes the next document when it is through with one; ``ahead`` windows are filled at once.
    Once there are no more documents, streams that ended are dropped when half have.
    """
    source = iter(docs)
    own: list[np.ndarray | None] = [None] * streams
    at = [0] * streams
    before = np.zeros(streams, np.int32)
    ended = False
    span = window * ahead
    while True:
        keep = None
        if ended:
            kept = [j for j, d in enumerate(own) if d is not None]
            if not kept:
                return
            if 2 * len(kept) <= len(own):
                keep, own, at = np.array(kept), [own[j] for j in kept], [at[j] for j in kept]
                before = before[keep]
        n = len(own)
        y, length, starts = np.zeros((n, span), np.int32), [0] * n, []
        for j in range(n):
            t, row = 0, y[j]
            while t < span:
                d = own[j]
                if d is None:
                    d = None if ended else next(source, None)
                    if d is None:
                        ended = True
                        break
                    if not len(d):
                        continue
                    own[j] = d
                    at[j] = 0
                    starts.append(j * span + t)
                a = at[j]
                k = min(span - t, len(d) - a)
                row[t : t + k] = d[a : a + k]
                t += k
                at[j] = a + k
                if a + k == len(d):
                    own[j] = None
            length[j] = t
        x = np.empty_like(y)
        x[:, 0], x[:, 1:] = before, y[:, :-1]
        before = y[:, -1].copy()
        fresh = np.zeros((n, span), bool)
        fresh.ravel()[starts] = True
        x[fresh] = 0
        real = np.arange(span)[:, None] < np.array(length)
        x, y, fresh = (np.ascontiguousarray(v.T) for v in (x, y, fresh))
        for s in range(0, max(length), window):
            cut = slice(s, s + window)
            yield x[cut], y[cut], fresh[cut], real[cut], keep
            keep = None


def _blocks(docs: list[np.ndarray], streams: int, budget: int = 1 << 20):
    """([step, stream] inputs, targets, document starts, document numbers or -1) in blocks of about ``budget`` symbols.

    Inputs as in ``windows``; the documents are known, so the streams end at about the same step.
    """
    first = 0
    while first < len(docs):
        last, total = first, 0
        while last < len(docs) and (last == first or total + len(docs[last]) <= budget):
            total += len(docs[last])
            last += 1
        own = sorted(range(first, last), key=lambda i: -len(docs[i]))
        n = min(streams, len(own))
        heap = [(0, j) for j in range(n)]
        plan: list[list[int]] = [[] for _ in range(n)]
        for i in own:
            used, j = heapq.heappop(heap)
            plan[j].append(i)
            heapq.heappush(heap, (used + len(docs[i]), j))
        steps = max(u for u, _ in heap)
        x, y = np.zeros((n, steps), np.int32), np.zeros((n, steps), np.int32)
        fresh, owner = np.zeros((n, steps), bool), np.full((n, steps), -1, np.int32)
        for j, mine in enumerate(plan):
            at = 0
            for i in mine:
                d = docs[i]
                y[j, at : at + len(d)] = d
                x[j, at + 1 : at + len(d)] = d[:-1]
                fresh[j, at] = True
                owner[j, at : at + len(d)] = i
                at += len(d)
        yield tuple(np.ascontiguousarray(v.T) for v in (x, y, fresh, owner))
        first = last
